"""Operators over whole tables, each with its SQL: fields, joins, draws, builders, mixtures, files and streams."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chunking, parse
from ..functions import text as T
from ..operators import clean, dedup, errors, evaluate, filters, joins, records, retrieve, sample, segment, stats, translate
from ..operators.tables import shared_folder
from ..plans import examples, mixtures
from ..plans.pipeline import Config, judge, report
from ..sources import read, write
from .pairs import _EN, _PAIRS, _STRUCTURAL, _structural, pairs_from_turns, table
from .tasks import _questions

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Registers a query with its SQL."""

    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _new(spark: SparkSession, what: str) -> str:
    import uuid

    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


_CYR = "translate(lower(text), 'abcdefghijklmnopqrstuvwxyz', 'абцдефгхијклмнопярстуvwхyз')"


def _cyrillic() -> F.Column:
    return F.translate(F.lower("text"), "abcdefghijklmnopqrstuvwxyz", "абцдефгхијклмнопярстуvwхyз")


# fields


@query("select conv_id, turn, len(list_distinct(list_transform(range(1, greatest(0, length(text) - 4) + 1), lambda i: substr(lower(text), i::bigint, 5)))) as n from conversations")
def turn_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(T.char_ngrams(F.col("text"))).cast("long").alias("n"))


@query(f"""select doc_id, source as word, lang || chr(9) || source as key, sha256(text) as digest, least(1024, greatest(384, trunc(length(text) * 0.75 + 64)))::int as budget,
length(regexp_replace({_CYR}, '[^{T.UKRAINIAN.replace("'", "''")}]', '', 'g')) as letters, case when doc_id % 3 = 0 then 'CORRECT' else source || ' -> ' || lang end as target,
['low', 'medium', 'default'][doc_id % 3 + 1] as level, case when doc_id % 2 = 0 then lang else source end as named from documents""")
def document_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, c = table(spark, sf_dir, "documents"), F.col
    level = F.concat(F.get(F.array(*map(F.lit, ("low-", "medium-", "high-"))), (c("doc_id") % 3).cast("int")), c("doc_id").cast("string"))
    return d.select(
        "doc_id",
        T.strip_line_number(F.concat(c("doc_id").cast("string"), F.lit("\t"), "source")).alias("word"),
        T.document_key(F.concat_ws("\t", "lang", "source", "doc_id")).alias("key"),
        T.content_key(c("text")).alias("digest"),
        T.token_budget(c("text")).alias("budget"),
        T.ukrainian_letters(_cyrillic()).cast("long").alias("letters"),
        T.error_target(F.when(c("doc_id") % 3 == 0, F.lit("CORRECT")).otherwise(c("source")), c("lang")).alias("target"),
        T.difficulty(level).alias("level"),
        T.first_of(F.when(c("doc_id") % 2 == 0, F.lit("")).otherwise(c("source")), c("lang")).alias("named"),
    )


@query("select doc_id, source as fenced, source as peeled, 'x ' || lang as said from documents")
def wrapped_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "documents").select("doc_id", T.strip_fences(F.concat(F.lit("```json\n"), "source", F.lit("\n```"))).alias("fenced"), T.peel_quotes(F.concat(F.lit(" «“"), "source", F.lit("”» "))).alias("peeled"), T.prediction_text(F.concat(F.lit('<think>a\nb</think>"x  '), c("lang"), F.lit('"'))).alias("said"))


@query("select p_partkey, '0. ' || p_brand || chr(10) || '1. ' || p_type || chr(10) || '2. ' || p_size as numbered, 'А: ' || p_brand || chr(10) || 'Б: ' || p_type || chr(10) || 'В: ' || p_size as lettered, 'head' || chr(10) || chr(10) || p_brand || chr(10) || chr(10) || p_name as passage from part")
def option_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = T.choices_map(F.array("p_brand", "p_type", F.col("p_size").cast("string")))
    return table(spark, sf_dir, "part").select("p_partkey", T.format_options(options).alias("numbered"), T.format_lettered(options).alias("lettered"), T.with_passage("head", F.col("p_brand"), F.col("p_name")).alias("passage"))


@query("select doc_id, md5(text) as digest, true as fits from documents")
def break_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts in pieces at breaks: together they are the text, and none is too long."""
    cut = table(spark, sf_dir, "documents").select("doc_id", chunking.split_at_breaks(F.col("text"), 700).alias("p"))
    return cut.select("doc_id", F.md5(F.array_join("p", "")).alias("digest"), F.forall("p", lambda x: F.length(x) <= 700).alias("fits"))


@query("select doc_id, md5(regexp_replace(text, '\\s', '', 'g')) as digest from documents")
def byte_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts in pieces of sentences and in blocks: nothing but white space is lost."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.array_join(chunking.split_by_bytes(F.col("text"), 900), " ").alias("text"))
    whole = chunking.from_pieces(chunking.to_pieces(docs, "doc_id", "text", 300), "doc_id")
    return whole.select("doc_id", F.md5(F.regexp_replace("text", r"(?U)\s", "")).alias("digest"))


@query("select vec_id, round(embedding[1] / sqrt(list_inner_product(embedding::double[], embedding::double[])), 5) as first, 1.0::double as norm from embeddings")
def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", retrieve.normalised(F.col("embedding")).alias("v"))
    return e.select("vec_id", F.round(F.col("v")[0], 5).alias("first"), F.round(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)), 5).alias("norm"))


# filters


_LASER = "((seq % 130)::double / 100)"


@query(f"""with {_PAIRS}, m as (select *, {_LASER} laser, 0.9 + (seq % 12) / 100 lid from pairs) select seq, laser >= 1.17 and lid between 0.95 and 9 and lid between 0.98 and 9 as mined, laser >= 1.17 and lid between 0.97 and 1.01 and lid between 0.99 and 1.01 as strict,
seq % 5 = 0 or laser >= 1.2 as kept, length(source) between 80 and 4000 and length(target) between 80 and 4000 as in_window, length(source) >= 30 and length(target) >= 30 and len(string_split(source, ' ')) >= 5 and len(string_split(target, ' ')) >= 5 and regexp_matches(source, '\\S') and regexp_matches(target, '\\S') as long_enough,
seq % 3 <= 1 as single, seq % 2 = 0 as of_pair from m""")
def pair_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, c = pairs_from_turns(spark, sf_dir), F.col
    laser = ((c("seq") % 130) / 100).cast("string")
    lid = F.round(F.lit(0.9) + (c("seq") % 12) / 100, 2).cast("string")
    return p.select(
        "seq",
        filters.mined(laser, lid, lid).alias("mined"),
        filters.mined(laser, lid, lid, 1.17, **filters.STRICT).alias("strict"),
        filters.laser_or_unscored(F.when(c("seq") % 5 != 0, laser.cast("double"))).alias("kept"),
        filters.char_window(c("source"), c("target"), 80, 4000).alias("in_window"),
        filters.long_enough(c("source"), c("target")).alias("long_enough"),
        filters.single_error(c("seq") % 3).alias("single"),
        filters.of_pair(F.when(c("seq") % 4 == 0, F.lit("en_uk")).when(c("seq") % 2 == 1, F.lit("cs_uk")), None).alias("of_pair"),
    )


@query(f"""with d as (select doc_id, lang, {_CYR} t from documents), n as (select *, len(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}_]')) w from d)
select doc_id, w > 0 and len(regexp_extract_all(t, '[\\x{{0400}}-\\x{{04FF}}]')) / w >= 0.6 and len(regexp_extract_all(t, '\\p{{Nd}}')) / greatest(length(t), 1) <= 0.15 as clean, doc_id % 2 = 0 as dialogue,
length(trim(t, ' ' || chr(9) || chr(10) || chr(13))) >= 12 and length(regexp_replace(t, '[^{T.UKRAINIAN.replace("'", "''")}]', '', 'g')) >= 4 as usable, lang in ('en', 'de') as included from n""")
def prose_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _cyrillic()
    said = F.when(F.col("doc_id") % 2 == 0, F.lit("— так")).otherwise(F.lit("так"))
    return table(spark, sf_dir, "documents").select("doc_id", filters.clean_prose(t).alias("clean"), filters.dialogue(said).alias("dialogue"), filters.usable_choice(t).alias("usable"), filters.subjects(F.col("lang"), ["en", "de"]).alias("included"))


_ONE = "p_size % 3 = 0"


@query(f"select p_partkey, {_ONE} as one, p_size % 4 < 3 as numbered, p_size % 2 = 0 as keyed, p_size % 5 <> 0 as translated, p_size % 2 = 0 as solved, true as sound from part")
def question_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, size = F.col, F.col("p_size")
    answers = F.array(*(F.struct(F.lit(m).alias("marker"), c(x).cast("string").alias("text")) for m, x in zip("АБВ", ("p_brand", "p_type", "p_size"))))
    texts = F.transform(answers, lambda a: a["text"])
    correct = F.when(size % 3 == 0, F.array(F.lit("Б"))).when(size % 3 == 1, F.array(F.lit("А"), F.lit("Б"))).otherwise(F.array(F.lit("Д")))
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        filters.one_correct(answers, correct).alias("one"),
        filters.numbered_question((size % 4 + 1).cast("string"), texts, c("p_name")).alias("numbered"),
        filters.keyed_question(F.when(size % 2 == 0, F.concat(F.lit(" "), "p_brand")).otherwise(F.lit("none")), texts).alias("keyed"),
        filters.translated_row(c("p_name"), F.when(size % 5 != 0, F.create_map(F.lit("0"), "p_brand"))).alias("translated"),
        filters.maths_row(c("p_name"), c("p_brand"), F.when(size % 2 == 0, F.lit("low")).otherwise(F.lit("high")), "low").alias("solved"),
        filters.sound_latex(c("p_type")).alias("sound"),
    )


@query("select doc_id from documents where source not in (select source from documents where lang = 'de')")
def excluded_corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return filters.excluding(d, "source", d.where("lang = 'de'").select("source")).select("doc_id")


# joins


@query("with l as (select user_id, max_by(event_type, event_id) t, max(event_id) e from events where event_type <> 'view' group by user_id) select c_custkey, t as event_type from customer left join l on user_id = c_custkey")
def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer with the last event of the user of that number, if there is one."""
    local = table(spark, sf_dir, "events").where("event_type <> 'view'").select(F.col("user_id").alias("c_custkey"), "event_id", "event_type")
    return joins.enrich(table(spark, sf_dir, "customer").select("c_custkey"), local, "c_custkey", "event_id")


@query("select doc_id, doc_id in (select doc_id from labels) as labelled from documents")
def flagged_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.flagged(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id", "labelled")


@query("select 'hit' as side, count(*) as n, sum(quality)::bigint as quality from documents join labels using (doc_id) union all select 'miss', count(*), null from documents where doc_id not in (select doc_id from labels)")
def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, unknown = joins.cached(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    side = lambda d, name, q: d.agg(F.lit(name).alias("side"), F.count("*").alias("n"), q.alias("quality"))
    return side(known, "hit", F.sum("quality")).unionByName(side(unknown, "miss", F.lit(None).cast("long")))


@query("select conv_id, string_agg(turn || '=' || role, ',' order by turn) as fields from conversations group by conv_id")
def scattered_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = joins.scattered(table(spark, sf_dir, "conversations").withColumn("turn", F.col("turn").cast("int")), "conv_id", "turn", "role")
    entries = F.transform(F.array_sort(F.map_entries("fields")), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"]))
    return rows.select("conv_id", F.array_join(entries, ",").alias("fields"))


@query("select c_custkey, c_acctbal, max_by(o_totalprice, o_orderkey) as o_totalprice from customer join orders on o_custkey = c_custkey group by c_custkey, c_acctbal")
def ordered_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last order of each customer, in the customers' order of balance."""
    inputs = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    said = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    return joins.in_input_order(inputs, said, "c_custkey", "c_acctbal", "o_orderkey").select("c_custkey", "c_acctbal", "o_totalprice")


@query("with r as (select doc_id, source, lang, row_number() over (partition by lang order by doc_id) k from documents) select doc_id, lang from r where k <= case lang when 'en' then 30 when 'es' then 7 else k end")
def config_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    caps = spark.createDataFrame([("en", 30), ("es", 7)], "lang string, cap int")
    return joins.capped(table(spark, sf_dir, "documents"), caps, "lang", ["doc_id"]).select("doc_id", "lang")


@query("select ord, doc_id, vec_id from (select doc_id, row_number() over (order by doc_id) ord from documents) join (select vec_id, row_number() over (order by vec_id) ord from embeddings) using (ord)")
def aligned_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = sample.ranks(table(spark, sf_dir, "documents").select("doc_id"), [F.col("doc_id")]).withColumnRenamed("rank", "ord")
    right = sample.ranks(table(spark, sf_dir, "embeddings").select("vec_id"), [F.col("vec_id")]).withColumnRenamed("rank", "ord")
    return joins.aligned(left, right).select("ord", "doc_id", "vec_id")


# aggregates


@query("select case when turn % 3 = 0 then 'correct' else 'error' end as label, count(*) as n from conversations group by 1")
def label_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.label_balance(table(spark, sf_dir, "conversations"), F.when(F.col("turn") % 3 == 0, F.lit("CORRECT")).otherwise(F.col("role")))


@query("select count(*) as n, round(avg((o_orderstatus = 'F')::int), 6) as detection, round(avg((o_orderpriority = '1-URGENT')::int), 6) as correction, 1.0::double as parsed from orders")
def error_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.struct(F.col("o_orderstatus").alias("wrong"), F.col("o_orderpriority").alias("right"))
    out = evaluate.error_scores(table(spark, sf_dir, "orders"), said, F.lit("F"), F.lit("1-URGENT"))
    return out.select("n", *(F.round(c, 6).alias(c) for c in ("detection", "correction", "parsed")))


@query("select l_returnflag, count(*) as n, round(avg((l_quantity > 5 and l_linenumber = 1)::int), 6) as accuracy, round(avg((l_quantity > 5)::int), 6) as parsed from lineitem group by l_returnflag")
def task_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers predicted for larger quantities alone; the gold number is 1."""
    out = evaluate.accuracy(table(spark, sf_dir, "lineitem"), F.when(F.col("l_quantity") > 5, F.col("l_linenumber")), F.lit(1), ["l_returnflag"])
    return out.select("l_returnflag", "n", F.round("accuracy", 6).alias("accuracy"), F.round("parsed", 6).alias("parsed"))


@query("with g as (select lower(trim(regexp_replace(regexp_replace(text, '[^\\p{L}\\p{N}\\p{M}_]', ' ', 'g'), '\\s+', ' ', 'g'))) k, doc_id from documents) select min(doc_id) as first_id, count(*) as n from g group by k")
def variant_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by their normalised text: the first of each group, and how many they are."""
    out = stats.grouped_variants(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "doc_id")
    return out.select(F.col("variants")[0]["doc_id"].alias("first_id"), "n")


@query("with r as (select lang, doc_id, len(regexp_extract_all(text, '\\S+')) len, row_number() over (partition by lang order by len(regexp_extract_all(text, '\\S+'))) k, count(*) over (partition by lang) n, row_number() over (partition by lang order by md5('42|' || doc_id), doc_id) d from documents) select lang, count(*) as n, min(len) as words_min, " + ", ".join(f"max(len) filter (where k = greatest(1, floor(n * {p}))) as words_p{int(p * 100)}" for p in (0.25, 0.5, 0.75, 0.95)) + ", max(len) as words_max, string_agg(doc_id::varchar, ',' order by doc_id) filter (where d <= 4) as sample from r group by lang")
def corpus_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.described_corpus(table(spark, sf_dir, "documents"), "lang", "text", "doc_id")
    return out.select("lang", "n", *(F.col(f"words_{c}").cast("long").alias(f"words_{c}") for c in ("min", "p25", "p50", "p75", "p95", "max")), F.array_join(F.col("sample").cast("array<string>"), ",").alias("sample"))


@query(f"with {_PAIRS}, s as (select seq, {_structural(_EN)} reason from pairs), c as (select reason, count(*) k from s where reason <> 'pass' group by reason) select 'structural' as stage, (select count(*) from s) as n_in, (select count(*) from s where reason = 'pass') as n_out, coalesce(string_agg(reason || '=' || k, ',' order by reason), '') as reasons from c")
def stage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = report(judge(pairs_from_turns(spark, sf_dir), [5], Config()), [5])
    entries = F.transform(F.map_entries(F.coalesce("reasons", F.create_map().cast("map<string,bigint>"))), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return out.select("stage", "n_in", "n_out", F.array_join(entries, ",").alias("reasons"))


def _uniform(seed: str, key: str) -> str:
    return f"(('0x' || substr(md5('{seed}|' || {key}), 1, 13))::bigint / 4503599627370496)"


@query(f"with {_PAIRS}, s as (select seq, {_structural(_EN)} reason from pairs) select seq, reason from s where reason <> 'pass' and {_uniform('42', 'seq')} < 0.5")
def audit_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.audited(judge(pairs_from_turns(spark, sf_dir), [5], Config()), 0.5).select("seq", "reason")


# order, draws, sets


@query("select doc_id, n_chars from documents order by n_chars desc, doc_id limit 50")
def best_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.best(table(spark, sf_dir, "documents"), "n_chars", "doc_id", 50).select("doc_id", "n_chars")


@query("select doc_id from documents order by doc_id limit 40")
def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.first_n(table(spark, sf_dir, "documents"), "doc_id", 40).select("doc_id")


@query("select c_name as name, regexp_extract(c_name, '([0-9]+)$', 1)::int as step from customer")
def checkpoint_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), sample.by_suffix(F.col("c_name")).alias("step")).orderBy("step")


@query("select doc_id, row_number() over (order by md5('9|' || doc_id), doc_id) as place from documents")
def shuffled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and its place in a random order."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    return sample.ranks(d.withColumn("draw", sample.draw(9, "doc_id")), [F.col("draw"), F.col("doc_id")]).select("doc_id", F.col("rank").alias("place"))


@query(f"select doc_id, {_uniform('5', 'doc_id')} < 0.3 as correct from documents")
def bernoulli_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", sample.chosen(0.3, 5, "doc_id").alias("correct"))


@query("with p as (select 'pages' part, page_id id from pages), d as (select 'documents' part, doc_id id from documents order by md5('42|' || doc_id), doc_id limit 60) select part, id from p union all select part, id from d")
def capped_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = {"pages": table(spark, sf_dir, "pages").select(F.col("page_id").alias("id")), "documents": table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))}
    return sample.mixed(parts, {"documents": 60, "pages": -1}, "id").select("part", "id")


@query("with s as (select a.vec_id q, b.vec_id k, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) sim from embeddings a, embeddings b where a.vec_id % 50 = 0), r as (select *, row_number() over (partition by q order by round(sim, 12) desc, k) n from s) select distinct k as key from r where n <= 5")
def retrieved_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct neighbours of the queries, the vectors whose number 50 divides."""
    e = table(spark, sf_dir, "embeddings")
    return retrieve.retrieved(retrieve.top_k(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", 5))


@query("select count(*) as n, count(distinct t) as different from (select regexp_replace(lower(text), '[^\\p{L}\\p{N}\\p{M}_]', ' ', 'g') t from documents)")
def first_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with and without deduplication by the normalised question."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}\p{M}_]", " ").alias("text"))
    kept = d.groupBy("text").agg(F.min("doc_id")).agg(F.count("*").alias("different"))
    both = dedup.first_questions(d, "text", "doc_id", dedup=False).agg(F.count("*").alias("n"))
    return both.join(kept)


# segments


_LIST = "list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"
PACKED = f"""with recursive s as (select doc_id, list_transform({_LIST}, lambda s: len(regexp_extract_all(s, '\\S+'))) w from documents),
r(doc_id, i, k, n, done) as (select doc_id, 0, 0, 0, []::struct(k int, n int)[] from s union all
select doc_id, i + 1, case when x > 700 then 0 when n + x > 700 and n >= 300 then 1 else k + 1 end, case when x > 700 then 0 when n + x > 700 and n >= 300 then x else n + x end,
case when x > 700 then done || case when k > 0 then [struct_pack(k := k::int, n := n::int)] else [] end || [struct_pack(k := 1::int, n := x::int)] when n + x > 700 and n >= 300 then done || [struct_pack(k := k::int, n := n::int)] else done end
from (select r.*, w[i + 1]::int x from r join s using (doc_id) where i < len(w))),
f as (select doc_id, case when k = 0 then done when len(done) > 0 and n < 300 then done[1:len(done) - 1] || [struct_pack(k := (done[len(done)].k + k)::int, n := (done[len(done)].n + n)::int)] else done || [struct_pack(k := k::int, n := n::int)] end c from r join s using (doc_id) where i = len(w))
select doc_id, (unnest(range(0, len(c))))::int as position, (unnest(c)).k as n, (unnest(c)).n as words from f"""

PARAGRAPHS = """with l as (select source, doc_id, unnest(string_split(text, chr(10))) t, generate_subscripts(string_split(text, chr(10)), 1) p from documents),
a as (select source, t, row_number() over (partition by source order by doc_id, p) r from l), g as (select source, count(*) n from a group by source),
d as (select source, n, unnest(range(1, ceil(n / 3)::bigint + 1)) k from g), z as (select *, 3 + floor(13 * ('0x' || substr(md5('42|' || source || '|' || k), 1, 13))::bigint / 4503599627370496) size from d),
b as (select source, n, k - 1 win, sum(size) over (partition by source order by k) hi, size from z), w as (select source, win, hi - size lo, least(hi, n) hi from b where least(hi, n) - (hi - size) >= 3),
j as (select w.source, win, count(*) n, string_agg(t, ' ' order by r) x from w join a on a.source = w.source and r > lo and r <= hi group by w.source, win)
select source, win as "window", n, length(x) as n_chars from j where length(x) between 80 and 400000"""


# questions, variants and records


_PERMS = [",".join(map(str, p)) for p in permutations(range(4))]
_AT = "{}[string_split(o, ',')[{}]::int + 1]"
_TEXTS = "[p_brand, p_type, p_size::varchar, p_name]"
VARIANTS = f"""with o as (select unnest([{", ".join(f"'{p}'" for p in _PERMS[1:])}]) o), r as (select part.*, o, row_number() over (partition by p_partkey order by md5('42|' || p_partkey || '|' || o), o) variant from part, o),
v as (select *, variant::int v from r where variant <= 2 union all by name select *, '{_PERMS[0]}' o, 0 v from part)
select p_partkey, v as variant, ['А', 'Б', 'В', 'Г'][list_position(string_split(o, ','), '1')] as marker,
case v when 2 then '{records.PREFIXES[1]}' else '' end || 'What is part ' || p_partkey || '?' || chr(10) || chr(10) || """ + " || chr(10) || ".join(f"'{m}: ' || {_AT.format(_TEXTS, k + 1)}" for k, m in enumerate("АБВГ")) + " as prompt from v"


def _im(role: str, body: str) -> str:
    return f"'<|im_start|>{role}' || chr(10) || {body} || '<|im_end|>' || chr(10)"


def _quoted(task: str) -> str:
    return "'" + records.PROMPTS[task].replace("'", "''") + "'"


_OPTS = "'0. ' || p_brand || chr(10) || '1. ' || p_type"
_ASKED = f"p_name || chr(10) || chr(10) || {_OPTS} || chr(10) || chr(10) || 'Answer:'"


@query(f"select p_partkey, {_im('system', _quoted('qa'))} || {_im('user', _ASKED)} || {_im('assistant', chr(39) + '1' + chr(39))} as qa, {_im('system', _quoted('qa_en'))} || {_im('user', _ASKED)} || {_im('assistant', f'{chr(39)}Question (Ukrainian): {chr(39)} || p_name || chr(10) || chr(10) || {_OPTS} || chr(10) || chr(10) || {chr(39)}Answer: 1{chr(39)}')} as qa_en, "
       f"{_im('system', _quoted('gc'))} || {_im('user', 'p_name')} || {_im('assistant', 'p_brand || ' + chr(39) + ' -> ' + chr(39) + ' || p_type')} as gc, {_im('system', _quoted('mr'))} || {_im('user', 'p_name || chr(10) || chr(10) || ' + chr(39) + 'Answer:' + chr(39))} || {_im('assistant', 'p_type || chr(10) || chr(10) || ' + chr(39) + 'Answer: ' + chr(39) + ' || p_size')} as mr, "
       f"{_im('system', _quoted('mr_en'))} || {_im('user', 'p_name || chr(10) || chr(10) || ' + chr(39) + 'Answer:' + chr(39))} || {_im('assistant', chr(39) + 'Question (Ukrainian): ' + chr(39) + ' || p_brand || chr(10) || chr(10) || ' + chr(39) + 'Solution:' + chr(39) + ' || chr(10) || p_type')} as mr_en from part")
def task_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    options = T.choices_map(F.array("p_brand", "p_type"))
    made = {
        "qa": records.question(c("p_name"), options, F.lit(1)),
        "qa_en": records.bilingual_question(c("p_name"), options, c("p_name"), options, F.lit(1)),
        "gc": records.correction("gc", c("p_name"), c("p_brand"), c("p_type")),
        "mr": records.problem(c("p_name"), c("p_type"), c("p_size")),
        "mr_en": records.bilingual_problem(c("p_name"), c("p_brand"), c("p_type")),
    }
    return table(spark, sf_dir, "part").select("p_partkey", *(records.rendered(m).alias(k) for k, m in made.items()))


@query("select p_partkey, 'mmlu-en-' || lpad(p_partkey::varchar, 6, '0') as id, '[{\"role\":\"system\",\"content\":\"s\"},{\"role\":\"user\",\"content\":\"' || p_brand || '\"}]' as messages from part")
def numbered_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", records.numbered("mmlu-en-", F.col("p_partkey"), 6).alias("id"), records.as_json(records.chat("s", F.col("p_brand"))).alias("messages"))


@query("with v as (select p_partkey, p_size, unnest([0, 1, 2]) variant from part) select p_partkey, variant from v where case when p_size % 2 = 0 then variant in (1, 2) else variant in (0, 2) end")
def picked_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = records.variants(_questions(spark, sf_dir), "p_partkey", 3).join(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey")
    return records.picked(made, "p_partkey", F.col("p_size") % 2 == 0).select("p_partkey", "variant")


_ITEM = "'{\"question\":\"Q' || p_partkey || '\",\"answers\":[{\"marker\":\"А\",\"text\":\"' || p_brand || '\"}],\"correct_answers\":[\"А\"],\"subject\":\"s\"' || case when p_size % 2 = 0 then ',\"passage\":\"' || p_brand || '\"}' else '}' end"


@query(f"select p_partkey, case when p_size % 2 = 0 then '{examples.READING}' else '{examples.EXAM}' end as system, case when p_size % 2 = 0 then p_brand || chr(10) || chr(10) else '' end || 'Q' || p_partkey || chr(10) || chr(10) || 'А: ' || p_brand as asked, {_ITEM} as item from part")
def augmented_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers, correct = F.array(F.struct(F.lit("А").alias("marker"), F.col("p_brand").alias("text"))), F.array(F.lit("А"))
    passage = F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(F.lit(""))
    number = F.col("p_partkey").cast("string")
    chat = examples.augmented_chat(F.lit("Q"), number, answers, correct, passage)
    return table(spark, sf_dir, "part").select("p_partkey", chat[0]["content"].alias("system"), chat[1]["content"].alias("asked"), F.to_json(examples.augmented_item(F.lit("Q"), number, answers, correct, F.lit("s"), passage)).alias("item"))


@query(f"""select 'MT' as task, p_partkey::varchar as id, p_name as asked, p_brand as reference, null::varchar as correct_word from part union all select 'QA', 'zno::' || p_partkey, {_ASKED}, '1', null from part
union all select 'SC', p_partkey::varchar, p_name, null, p_type from part union all select 'MR', p_partkey::varchar, p_name || chr(10) || chr(10) || 'Answer:', p_type, null from part""")
def development_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, c = table(spark, sf_dir, "part"), F.col
    key = c("p_partkey").cast("string").alias("id")
    tables = {
        "MT": part.select(key.alias("sent_id"), c("p_name").alias("en"), c("p_brand").alias("uk")),
        "QA": part.select(F.lit("zno").alias("dataset_id"), c("p_name").alias("question"), T.choices_map(F.array("p_brand", "p_type")).alias("possible_answers"), F.lit(1).alias("correct_answer_num"), c("p_partkey").alias("ord")),
        "SC": part.select(key, c("p_name").alias("input_sentence"), c("p_brand").alias("incorrect_word"), c("p_type").alias("correct_word")),
        "MR": part.select(key, c("p_name").alias("question"), c("p_type").alias("answer")),
    }
    return examples.all_development(tables).select("task", "id", F.col("messages")[1]["content"].alias("asked"), "reference", "correct_word")


@query("select p_partkey as key, p_name || chr(10) || chr(10) || 'Answer:' as asked, case when p_partkey % 2 = 0 then 'low' else 'default' end as difficulty from part")
def test_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.concat(F.when(F.col("p_partkey") % 2 == 0, F.lit("low-")).otherwise(F.lit("x-")), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("question"), "p_partkey")
    return examples.test("MR", rows).select(F.col("row.p_partkey").alias("key"), F.col("messages")[1]["content"].alias("asked"), "difficulty")


# mixtures


def _tasks(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Raw rows of every task, from parts, customers and suppliers."""
    part, customer, supplier, c = table(spark, sf_dir, "part"), table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier"), F.col
    options = T.choices_map(F.array("p_brand", "p_type"))
    pairs = lambda d, k, a, b: d.select(c(k).alias("id"), c(a).alias("src"), c(b).alias("tgt"))
    wrong = lambda d, k, a: d.select(c(k).alias("id"), c(a).alias("input_sentence"), F.lit("CORRECT").alias("incorrect_word"), F.lit("CORRECT").alias("correct_word"))
    return {
        "mt": pairs(customer, "c_custkey", "c_name", "c_mktsegment"),
        "gc": wrong(supplier, "s_suppkey", "s_name"),
        "sc": wrong(part, "p_partkey", "p_name"),
        "qa_en": part.select(c("p_partkey").alias("id"), c("p_name").alias("question_en"), options.alias("possible_answers_en"), c("p_name").alias("question_uk"), F.when(c("p_size") % 2 == 0, options).alias("possible_answers_uk"), F.lit(1).alias("correct_answer_num")),
        "qa_uk": supplier.select(c("s_suppkey").alias("id"), c("s_name").alias("question"), F.array("s_name", F.lit("b")).alias("choices"), F.lit(0).alias("answer")),
        "qa_zno": part.select(c("p_partkey").alias("id"), c("p_name").alias("question"), options.alias("possible_answers"), F.lit(0).alias("correct_answer_num")),
        "mr": customer.select(c("c_custkey").alias("id"), c("c_name").alias("question_en"), c("c_name").alias("question_uk"), F.when(c("c_custkey") % 3 > 0, c("c_mktsegment")).alias("answer_uk"), F.lit("1").alias("final_answer")),
        "mt_cs": supplier.select(c("s_suppkey").alias("id"), records.chat("from Czech", c("s_name"), c("s_name")).alias("messages")),
    }


def _mixed_sql(parts: dict[str, str], name: str = "x") -> str:
    """The interleaving of equal shares: parts are SELECTs of id."""
    share = 1 / len(parts)
    rows = " union all ".join(f"select '{k}' part, id::varchar id, {share} share from ({q})" for k, q in parts.items())
    return f"""{name}_a as ({rows}), {name}_r as (select *, row_number() over (partition by part order by md5('42|' || part || '|' || id), id) k, count(*) over (partition by part) n from {name}_a),
{name}_t as (select max(ceil(n / share)) total from {name}_r), {name}_w as (select {name}_r.*, round(total * share)::bigint want from {name}_r, {name}_t),
{name} as (select part, id, unnest(range(0, (floor((want - k) / n) + 1)::bigint)) as copy from {name}_w where want >= k)"""


_IDS = {"mt": "select c_custkey id from customer", "gc": "select s_suppkey id from supplier", "sc": "select p_partkey id from part", "qa_en": "select p_partkey id from part", "qa_en_uk": "select p_partkey id from part where p_size % 2 = 0", "qa_uk": "select s_suppkey id from supplier", "qa_zno": "select p_partkey id from part", "mr": "select c_custkey id from customer where c_custkey % 3 > 0", "mr_en": "select c_custkey id from customer"}
_pick = lambda *k: {x: _IDS[x] for x in k}


def _counted(df: DataFrame) -> DataFrame:
    return df.select("part", "id", "copy")


@query(f"with {_mixed_sql(_pick('mt', 'gc', 'sc'))} select part, id, copy from x")
def first_stage_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tasks(spark, sf_dir)
    return _counted(mixtures.first_stage(t["mt"], t["gc"], t["sc"]))


@query(f"with {_mixed_sql(_pick('mt', 'sc'))} select part, id, copy from x")
def first_stage_without_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tasks(spark, sf_dir)
    return _counted(mixtures.first_stage_without_grammar(t["mt"], t["sc"]))


def _nested_sql(qa: str, mr: str) -> str:
    inner = _mixed_sql(_pick(qa, "qa_uk"), "i")
    return f"with {inner}, {_mixed_sql({'qa': 'select part || chr(124) || id || chr(124) || copy id from i', 'mr': _IDS[mr]})} select part, id, copy from x"


@query(_nested_sql("qa_en", "mr_en"))
def second_stage_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tasks(spark, sf_dir)
    return _counted(mixtures.second_stage(t["qa_en"], t["qa_uk"], t["mr"]))


@query(_nested_sql("qa_en_uk", "mr"))
def second_stage_ukrainian_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tasks(spark, sf_dir)
    return _counted(mixtures.second_stage_ukrainian(t["qa_en"], t["qa_uk"], t["mr"]))


_SAMPLE = "(select id from ({}) order by md5('42|' || id), id limit {})"


@query(" union all ".join(f"select '{k}' as part, id::varchar as id from ({_IDS[k]})" for k in ("qa_en_uk", "qa_uk", "qa_zno", "mr")) + f" union all select 'mt', id::varchar from {_SAMPLE.format(_IDS['mt'], 40)} union all select 'mt_cs', id::varchar from (select s_suppkey id from supplier order by 1 limit 5) union all select 'gc', id::varchar from {_SAMPLE.format(_IDS['gc'], 4)}")
def second_stage_mix_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tasks(spark, sf_dir)
    return mixtures.second_stage_mix(t["qa_en"], t["qa_uk"], t["qa_zno"], t["mr"], mt=t["mt"], mt_cs=t["mt_cs"], gc=t["gc"], n_mt=40, n_gc=4, n_mt_cs=5).select("part", "id")


@query(f"with {_mixed_sql(_pick('mt', 'gc', 'sc', 'qa_en_uk', 'qa_uk', 'qa_zno', 'mr'))} select part, id, copy from x")
def joint_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tasks(spark, sf_dir)
    return _counted(mixtures.joint(t["mt"], t["gc"], t["sc"], t["qa_en"], t["qa_uk"], t["qa_zno"], t["mr"]))


@query("with r as (select lang, doc_id, row_number() over (partition by lang order by md5('42|' || doc_id), doc_id) k from documents where regexp_matches(text, '\\S')) select lang as corpus, doc_id::varchar as id from r where case when lang = 'en' then k <= 30 else true end and lang not in ('open_subtitles')")
def translation_train_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "documents").select(F.col("lang").alias("corpus"), F.col("doc_id").alias("id"), F.col("text").alias("source"), F.col("text").alias("target")).where(filters.filled(F.col("source")))
    return mixtures.translation_set(pairs, "en-uk", "train", {"en": 30}).select("corpus", "id")


@query("select 'official' as corpus, s_suppkey::varchar as id from supplier union all select 'docs', p_partkey::varchar from part")
def translation_validation_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, supplier, c = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier"), F.col
    rows = lambda d, k, n, corpus: d.select(F.lit(corpus).alias("corpus"), c(k).alias("id"), c(n).alias("source"), c(n).alias("target"))
    both = rows(part, "p_partkey", "p_name", "docs").unionByName(rows(part, "p_partkey", "p_name", "tilde"))
    return mixtures.translation_set(both, "en-uk", "validation", official=rows(supplier, "s_suppkey", "s_name", "x").drop("corpus")).select("corpus", "id")


@query("select 0 as part_no, p_partkey as id from part union all select 1, s_suppkey from supplier")
def submission_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [table(spark, sf_dir, t).select(F.lit(i).alias("part_no"), F.col(k).alias("id"), F.lit("x").alias("other")) for i, (t, k) in enumerate((("part", "p_partkey"), ("supplier", "s_suppkey")))]
    return evaluate.submission(parts, ["part_no", "id"], "id")


# errors


@query("select conv_id, turn, text from conversations")
def typos_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with an error, which the given words undo: the wrong one stands there once."""
    made = errors.injected(F.col("text"), F.concat_ws("-", "conv_id", "turn"), F.col("turn") % 2 == 0, alphabet=frozenset("abcdefghijklmnopqrstuvwxyz"))
    m = F.col("m")
    undone = F.when(m["wrong"] == "CORRECT", m["input"]).otherwise(F.replace(m["input"], m["wrong"], m["right"]))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", made.alias("m")).select("conv_id", "turn", undone.alias("text"))


@query("select conv_id, turn, case when turn % 2 = 0 then 'CORRECT' else 'wrongword' end as wrong, case when turn % 2 = 0 then 'CORRECT' else 'rightword' end as right, (turn % 2)::int as regions from conversations")
def planted_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    with_ = lambda w: F.concat(F.lit(w + " "), "text")
    source = F.when(F.col("turn") % 2 == 0, with_("rightword")).otherwise(with_("wrongword"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", errors.differing(source, with_("rightword")).alias("d")).select("conv_id", "turn", "d.wrong", "d.right", "d.regions")


@query("select p_partkey, upper(p_name) as translation from part")
def cached_translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' names by a seam that writes capitals; half of them are in the cache."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    cache = part.where("p_partkey % 2 = 0").select(T.content_key(F.col("p_name")).alias("key"), F.upper("p_name").alias("translation"))
    return translate.with_cache(part, "p_name", cache, lambda ts: [t.upper() for t in ts])[0].select("p_partkey", "translation")


@query("select doc_id, md5(replace(regexp_replace(text, '\\s', '', 'g'), 'a', '@')) as digest from documents")
def translated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = translate.in_pieces(table(spark, sf_dir, "documents"), "doc_id", "text", lambda ts: [t.replace("a", "@") for t in ts], 500)
    return done.select("doc_id", F.md5(F.regexp_replace("text", r"(?U)\s", "")).alias("digest"))


# files and streams


_FLAT = "regexp_replace(regexp_replace({0}, '\\s+', ' ', 'g'), '^ | $', '', 'g')"


@query(f"with {_PAIRS} select {_FLAT.format('source')} as source, {_FLAT.format('target')} as target from pairs where regexp_matches(source, '\\S') and regexp_matches(target, '\\S')")
def tsv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _new(spark, "tsv")
    write.tsv(pairs_from_turns(spark, sf_dir), path, "gzip")
    return read.tsv(spark, path)


@query(f"with {_PAIRS} select trim(source, ' ' || chr(9) || chr(10) || chr(13)) as source, trim(target, ' ' || chr(9) || chr(10) || chr(13)) as target from pairs where regexp_matches(source, '\\S') and regexp_matches(target, '\\S')")
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _new(spark, "jsonl")
    write.jsonl(pairs_from_turns(spark, sf_dir).withColumnsRenamed({"source": "src", "target": "uk"}), path, ["uk", "src"], compression="gzip")
    return read.pairs_jsonl(spark, path)


_LINE = "trim(translate({}, chr(10) || chr(9) || chr(13), '   '))"


@query(f"with {_PAIRS} select row_number() over (order by seq) - 1 as seq, {_LINE.format('source')} as source, {_LINE.format('target')} as target from pairs qualify regexp_matches(source, '\\S') and regexp_matches(target, '\\S')")
def parallel_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _new(spark, "source"), _new(spark, "target")
    write.parallel(pairs_from_turns(spark, sf_dir), a, b)
    return read.parallel(spark, a, b, strict=True)


@query("select doc_id, lang from documents where lang <> 'en'")
def parquet_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _new(spark, "parquet")
    table(spark, sf_dir, "documents").withColumn("part", F.col("lang")).write.partitionBy("part").parquet(path)
    return read.parquet(spark, path, "*.parquet", "part=en").select("doc_id", "lang")


@query("select p_partkey as key, p_brand as text, 'А' as correct, p_type as answer from part")
def passages_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading-comprehension files of two questions each, one of which has no valid key."""
    path, c = _new(spark, "passages"), F.col
    question = lambda key: F.struct(c("p_partkey").cast("string").alias("stem"), F.array(c("p_type"), F.lit("other")).alias("choices"), key.alias("key"))
    write.json_arrays(table(spark, sf_dir, "part").select(c("p_brand").alias("text"), F.array(question(c("p_type")), question(F.lit("none"))).alias("mcqs")), path)
    return read.passages(spark, path).select(c("question").cast("long").alias("key"), "text", "correct", c("key").alias("answer"))


@query("select 'What is part ' || p_partkey || '?' as question, 'Б' as correct, 4 as n from part")
def questions_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _new(spark, "questions") + ".jsonl"
    rows = _questions(spark, sf_dir)
    numbered = rows.select("question", T.choices_map(F.transform("answers", lambda a: a["text"])).alias("possible_answers"), F.lit(1).alias("correct_answer_num"))
    write.jsonl(numbered, path)
    return read.questions(spark, path).select("question", F.col("correct_answers")[0].alias("correct"), F.size("answers").alias("n"))


@query("select doc_id, n_chars * 2 as doubled from documents")
def resumed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over half of the documents, and one over all that goes on where it was."""
    path, docs = _new(spark, "resumed"), table(spark, sf_dir, "documents")
    work = lambda d: d.select("doc_id", (F.col("n_chars") * 2).alias("doubled"))
    write.resumed(docs.where("doc_id % 2 = 0"), path, "doc_id", work, "doc_id long, doubled long")
    return write.resumed(docs, path, "doc_id", work, "doc_id long, doubled long")


@query("select o_orderkey || '-a' || o_custkey || '-' || lpad(n::varchar, 5, '0') as id, ['a', 'b'][n + 1] as source, ['c', 'd'][n + 1] as target from (select o_orderkey, o_custkey, unnest([0, 1]) n from orders)")
def annotated_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("doc"), F.col("o_custkey").alias("annotator"), F.array(F.lit("a"), F.lit("b")).alias("source"), F.array(F.lit("c"), F.lit("d")).alias("target"))
    return read.annotated(docs)


@query(_STRUCTURAL + " select seq, case when reason <> 'pass' then 'structural' end as failed_stage, case when reason <> 'pass' then reason end as reason from s")
def streamed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row stages over a stream of pairs, written as they come."""
    from .. import streaming

    source, sink, state = (_new(spark, x) for x in ("stream", "judged", "state"))
    pairs_from_turns(spark, sf_dir).write.parquet(source)
    stream = spark.readStream.schema("seq long, source string, target string").parquet(source)
    out = streaming.judged(stream, [5]).select("seq", "failed_stage", "reason")
    out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("seq long, failed_stage string, reason string").parquet(sink)


@query("select event_type, count(distinct user_id) as n from events group by event_type")
def streamed_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each type and user within the watermark, counted by type."""
    from .. import streaming

    source, sink, state = (_new(spark, x) for x in ("stream", "first", "state"))
    table(spark, sf_dir, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts")).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("user_id long, event_type string, ts timestamp").parquet(source)
    out = streaming.first_seen(stream, ["user_id", "event_type"], "ts", "3650 days").select("user_id", "event_type")
    out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("user_id long, event_type string").parquet(sink).groupBy("event_type").agg(F.count("*").alias("n"))


# scores


_TOKENS = "regexp_extract_all({}, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+|[^\\s\\p{{L}}\\p{{M}}\\p{{N}}_]')"
_CHARS = "list_filter(string_split(regexp_replace({}, '\\s', '', 'g'), ''), lambda x: x <> '')"


def _grams_sql(name: str, pred: str, ref: str, orders: int) -> str:
    parts = " union all ".join(
        f"select seq, {n} n, unnest(list_transform(range(1, len(t) - {n} + 2), lambda i: array_to_string(t[i:i + {n - 1}], chr(1)))) g, side from {name}_t" for n in range(1, orders + 1)
    )
    return f"""{name}_t as (select seq, 'p' side, {pred} t from pairs union all select seq, 'r', {ref} from pairs), {name}_g as ({parts}),
{name}_c as (select seq, n, g, count(*) filter (where side = 'p') p, count(*) filter (where side = 'r') r from {name}_g group by seq, n, g), {name} as (select n, sum(least(p, r)) m, sum(p) p, sum(r) r from {name}_c group by n)"""


BLEU = f"""with {_PAIRS}, {_grams_sql('w', _TOKENS.format('target'), _TOKENS.format('source'), 4)}, {_grams_sql('c', _CHARS.format('target'), _CHARS.format('source'), 6)},
h as (select n, m, p, sum((m = 0 and p > 0)::int) over (order by n) zeros from w), b as (select exp(avg(ln(case when m = 0 then 1 / (pow(2, zeros) * p) else m / p end))) * 100 s, (select p from w where n = 1) p1, (select r from w where n = 1) r1, (select m from w where n = 1) m1 from h),
f as (select m / p p, m / r r from (select * from c union all select * from w where n <= 2) where p > 0 or r > 0)
select round(case when m1 = 0 then 0 else s * case when p1 >= r1 then 1 else exp(1 - r1 / p1) end end, 4) as bleu, (select round(avg(coalesce(5 * p * r / nullif(4 * p + r, 0), 0)) * 100, 4) from f) as chrf from b"""
