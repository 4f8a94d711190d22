"""DataFrame operators: filters, deduplication, joins, statistics, retrieval, segmentation, sampling, records, evaluation."""
