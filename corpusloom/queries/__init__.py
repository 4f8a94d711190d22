"""Queries of the curation operators and the SQL they are compared with."""

from . import corpus, edges, more, pairs, tasks

QUERIES: dict = pairs.QUERIES | corpus.QUERIES | tasks.QUERIES | edges.QUERIES | more.QUERIES
ORACLES: dict = pairs.ORACLES | corpus.ORACLES | tasks.ORACLES | edges.ORACLES | more.ORACLES
ORACLES |= {"greedy_pack": more.PACKED, "random_paragraphs": more.PARAGRAPHS, "mcq_variants": more.VARIANTS, "bleu_chrf": more.BLEU}
