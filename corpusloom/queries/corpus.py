"""Deduplication, retrieval, segmentation, statistics and mixtures over `documents`, `embeddings`, `conversations` and `labels`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import clean, dedup, filters, joins, retrieve, sample, segment, stats
from .pairs import _words, table


def unicode_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with zero-width, control and blank characters and a decomposed letter put in before they are cleaned."""
    noisy = F.concat(F.lit("​ \t"), "text", F.lit(" é­ ’\u0007 \t xʼ  "))
    return table(spark, sf_dir, "documents").select("doc_id", T.unicode_clean(noisy).alias("text"))


_UNICODE = r"""with d as (select doc_id, nfc_normalize(chr(8203) || ' ' || chr(9) || text || ' e' || chr(769) || chr(173) || ' ' || chr(8217) || chr(7) || ' ' || chr(9) || ' x' || chr(700) || chr(160) || ' ') t from documents)
select doc_id, regexp_replace(regexp_replace(regexp_replace(translate(t, chr(700) || chr(8217) || chr(8203) || chr(8204) || chr(8205) || chr(8206) || chr(8207) || chr(65279) || chr(173), ''''''), '[\x7f\x0e-\x1f\x0b\x0c\x00-\x08]', '', 'g'), '[ \t\r\f\v]+', ' ', 'g'), '^[\s\x{A0}]+|[\s\x{A0}]+$', '', 'g') as text from d"""


def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("source"), F.col("text").alias("target"))
    return dedup.exact(docs, "doc_id").select("doc_id")


def priority_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of equal texts the one of the source that comes last in the alphabet."""
    rank = F.col("source_rank")
    ranks = table(spark, sf_dir, "documents").select("source").distinct()
    from pyspark.sql import Window

    ranked = ranks.select("source", F.row_number().over(Window.orderBy(F.col("source").desc())).alias("source_rank"))
    return dedup.by_priority(table(spark, sf_dir, "documents").join(ranked, "source"), ["text"], rank, "doc_id").select("doc_id", "source")


def near_dup_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths are taken before documents are joined with what goes, so texts aren't shuffled for it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.length("text").alias("n_chars"))
    return dedup.near_keep(docs, "doc_id", "text").select("doc_id", "n_chars")


def decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents none of whose lines is a benchmark item, by normalised text."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", T.question_key(F.col("line")).alias("key"))
    items = table(spark, sf_dir, "benchmark").select(T.question_key(F.col("text")).alias("key"))
    bad = lines.join(items.distinct(), "key", "left_semi").select("doc_id").distinct()
    return joins.without_leaks(table(spark, sf_dir, "documents"), bad, "doc_id").select("doc_id")


def _key(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(nfc_normalize({c})), '[^\\p{{L}}\\p{{N}}\\p{{M}}_]', ' ', 'g'), '\\s+', ' ', 'g'))"


def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return table(spark, sf_dir, "documents").join(labels, "doc_id").where(filters.reasoned(F.col("quality"), F.col("text")) & (F.col("toxic") == 0)).select("doc_id", "lang")


def topk_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as a query: its 5 nearest, itself among them."""
    e = table(spark, sf_dir, "embeddings")
    return retrieve.top_k(e, e, "vec_id", "embedding", 5).select("query", "key", F.round("similarity", 5).alias("similarity"))


def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(after, "vec_id").select("vec_id", F.round(clean.cosine(F.col("embedding"), F.col("other")), 5).alias("similarity"))


def pseudo_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents joined by the cluster label of the vector that shares their number."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    return stats.joined_text(table(spark, sf_dir, "documents").join(e, "doc_id"), "label", "doc_id", ["text"]).select("label", "n", F.col("word_count").cast("long").alias("word_count"), F.md5("text").alias("digest"))


def clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return retrieve.clusters(e, "embedding", e.count(), 25).select("vec_id", "cluster")


def length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucket = filters.length_bucket(T.word_count(F.col("text")))
    return table(spark, sf_dir, "documents").groupBy(F.coalesce(bucket, F.lit("other")).alias("bucket")).agg(F.count("*").alias("n"))


def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.fixed(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text", 3)


def islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = segment.islands(table(spark, sf_dir, "documents"), ["lang"], "doc_id", F.col("source"))
    return numbered.groupBy("lang", "island").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


def greedy_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", segment.sentences(F.col("text")).alias("sentences"))
    return segment.pack(docs, "sentences").select("doc_id", "position", F.size("chunk").alias("n"), T.word_count(F.col("body")).alias("words"))


def random_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of a source in order of document and position."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("position", "text"))
    return segment.paragraphs(docs.select("source", F.struct("doc_id", "position").alias("at"), "text"), ["source"], "at", ["text"], (3, 15), (80, 400_000)).select("source", "window", "n", F.length("text").alias("n_chars"))


def corpus_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.corpus(table(spark, sf_dir, "documents"), "lang", "text").select("lang", "n", *(F.col(c).cast("long") for c in ("min", "p25", "p50", "p75", "p95", "max")))


def score_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.described(table(spark, sf_dir, "documents"), ["n_chars", "text"])
    return out.select("column", *(F.round(c, 4).alias(c) for c in ("mean", "p25", "p50", "p75", "min", "max")))


def document_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = stats.document_stats(table(spark, sf_dir, "documents"), T.word_count(F.col("text")).cast("long"))
    return d.select("n", F.round("mean", 6).alias("mean"), "min", "max")


def source_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(table(spark, sf_dir, "documents"), "source")


def source_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.by_source(table(spark, sf_dir, "documents"), "source")


def md5_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.in_share(F.col("text")).alias("implicit"))


_DIGIT = "(strpos('0123456789abcdef', {}) - 1)"
_MD5 = f"""select doc_id, (6 * list_sum(list_transform(range(1, 32), lambda i: {_DIGIT.format("substr(md5(text), i, 1)")})) + {_DIGIT.format("substr(md5(text), 32, 1)")}) % 10 < 7 as implicit from documents"""


def seeded_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.capped(table(spark, sf_dir, "documents"), "lang", "doc_id", {"en": 100, "de": 20}, 50, seed=7).select("doc_id", "lang")


def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.sampled(table(spark, sf_dir, "documents"), "doc_id", 100, seed=3).select("doc_id")


def mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, pages and conversations by shares, until all were used in full."""
    parts = {"documents": table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), "pages": table(spark, sf_dir, "pages").select(F.col("page_id").alias("id")), "conversations": table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id")).distinct()}
    return sample.interleaved(parts, {"documents": 0.5, "pages": 0.25, "conversations": 0.25}, "id").select("part", "id", "copy")


_MIXTURE = """with a as (select 'documents' part, doc_id id, 0.5 share from documents union all select 'pages', page_id, 0.25 from pages union all select distinct 'conversations', conv_id, 0.25 from conversations),
r as (select *, row_number() over (partition by part order by md5('42|' || part || '|' || id), id) k, count(*) over (partition by part) n from a),
t as (select max(ceil(n / share)) total from r), w as (select r.*, round(total * share)::bigint want from r, t)
select part, id, unnest(range(0, (floor((want - k) / n) + 1)::bigint)) as copy from w where want >= k"""


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of equal name endings as edges (each with the next), and what hangs together."""
    e = table(spark, sf_dir, "embeddings")
    from pyspark.sql import Window

    edges = e.select(F.col("vec_id").alias("a"), F.lead("vec_id").over(Window.partitionBy("label").orderBy("vec_id")).alias("b")).where("b is not null")
    return dedup.components(edges)


QUERIES = {f.__name__: f for f in (unicode_clean, exact_dedup, priority_dedup, near_dup_keep, decontaminate, quality_gate, topk_retrieval, cosine_pairs, pseudo_docs, clustered, length_buckets, fixed_chunks, islands, greedy_pack, random_paragraphs, corpus_describe, score_describe, document_stats, source_histogram, source_rollup, md5_split, seeded_cap, seeded_sample, mixture, components)}
ORACLES = {
    "unicode_clean": _UNICODE,
    "exact_dedup": "select min(doc_id) as doc_id from documents group by lang, text",
    "priority_dedup": "select arg_max(doc_id, (source, -doc_id)) as doc_id, max(source) as source from documents group by text",
    "decontaminate": f"with l as (select doc_id, unnest(string_split(text, chr(10))) x from documents) select doc_id from documents where doc_id not in (select doc_id from l where {_key('x')} in (select {_key('text')} from benchmark))",
    "quality_gate": "select doc_id, lang from documents join labels using (doc_id) where quality = 1 and toxic = 0 and regexp_matches(text, '\\S')",
    "topk_retrieval": "with s as (select a.vec_id q, b.vec_id k, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) sim from embeddings a, embeddings b), r as (select *, row_number() over (partition by q order by round(sim, 12) desc, k) n from s) select q as query, k as key, round(sim, 5) as similarity from r where n <= 5",
    "cosine_pairs": "select a.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 5) as similarity from embeddings a join embeddings b on b.vec_id = a.vec_id + 1",
    "pseudo_docs": f"with g as (select label, count(*) n, string_agg(text, ' ' order by doc_id) t from documents join embeddings on vec_id = doc_id group by label having count(*) >= 2) select label, n, {_words('t')} as word_count, md5(t) as digest from g",
    "length_buckets": f"with w as (select {_words('text')} w from documents) select case when w between 50 and 250 then 'short' when w > 250 and w < 800 then 'medium' else 'other' end as bucket, count(*) as n from w group by bucket",
    "fixed_chunks": "with n as (select *, (row_number() over (partition by conv_id order by turn) - 1) // 3 chunk from conversations) select conv_id, chunk, count(*) as n, string_agg(text, ' ' order by turn) as text from n group by conv_id, chunk",
    "islands": "with l as (select *, coalesce((source <> lag(source) over w)::int, 1) fresh from documents window w as (partition by lang order by doc_id)), i as (select *, sum(fresh) over (partition by lang order by doc_id) island from l) select lang, island::bigint as island, count(*) as n, min(doc_id) as first_id from i group by lang, island",
    "corpus_describe": "with r as (select lang, length(text) len, row_number() over (partition by lang order by length(text)) k, count(*) over (partition by lang) n from documents) select lang, count(*) as n, min(len) as min, " + ", ".join(f"max(len) filter (where k = greatest(1, floor(n * {p}))) as p{int(p * 100)}" for p in (0.25, 0.5, 0.75, 0.95)) + ", max(len) as max from r group by lang",
    "score_describe": "with l as (select 'n_chars' c, n_chars::double v from documents union all select 'text', try_cast(text as double) from documents) select c as column, round(avg(v), 4) as mean, " + ", ".join(f"round(quantile_cont(v, {p}), 4) as p{int(p * 100)}" for p in (0.25, 0.5, 0.75)) + ", round(min(v), 4) as min, round(max(v), 4) as max from l group by c",
    "document_stats": f"with w as (select {_words('text')} w from documents) select count(*) as n, round(avg(w), 6) as mean, min(w) as min, max(w) as max from w",
    "source_histogram": "select source, count(*) as n from documents group by source",
    "source_rollup": "select source, count(*) as n from documents group by rollup(source)",
    "md5_split": _MD5,
    "seeded_cap": "with r as (select doc_id, lang, row_number() over (partition by lang order by md5('7|' || doc_id), doc_id) k from documents) select doc_id, lang from r where k <= case lang when 'en' then 100 when 'de' then 20 else 50 end",
    "seeded_sample": "select doc_id from documents order by md5('3|' || doc_id), doc_id limit 100",
    "mixture": _MIXTURE,
    "components": "select vec_id as node, min(vec_id) over (partition by label) as root from embeddings where label in (select label from embeddings group by label having count(*) > 1)",
}
