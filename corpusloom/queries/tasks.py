"""Records, parsers, scores and relational shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import chunking, maths, parse
from ..functions import text as T
from ..operators import errors, evaluate, joins, records, segment, stats
from .pairs import pairs_from_turns, table

_SUBJECTS = {"orders": "order|deliver|ship", "money": "price|pay|cost"}


def parse_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns read as answers to a question of four options."""
    options = F.create_map(*map(F.lit, ("0", "the", "1", "a model", "2", "data", "3", "zzz")))
    said = F.concat("text", F.when(F.col("turn") % 2 == 0, F.concat(F.lit(" Answer: "), (F.col("turn") % 5).cast("string"))).otherwise(F.lit("")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", parse.choice(said, options).alias("choice"))


_SAID = "text || case when turn % 2 = 0 then ' Answer: ' || (turn % 5) else '' end"
_CHOICE = f"""with s as (select conv_id, turn, trim({_SAID}) t from conversations),
n as (select *, regexp_extract(t, '(?i)(?:Answer|Відповідь)\\s*[:\\-]?\\s*([0-9]+)', 1) a, regexp_extract(t, '^\\s*([0-9]+)\\s*[).:\\-]?', 1) b, regexp_extract(t, '\\b([0-9]+)\\b', 1) c, lower(regexp_replace(t, '\\s+', ' ', 'g')) low from s)
select conv_id, turn, case when a in ('0', '1', '2', '3') then a when b in ('0', '1', '2', '3') then b when c in ('0', '1', '2', '3') then c
when contains(low, 'the') then '0' when contains(low, 'a model') then '1' when contains(low, 'data') then '2' when contains(low, 'zzz') then '3' end as choice from n"""


def final_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("<think>x\ny</think>"), "text", F.when(F.col("turn") % 3 == 0, F.lit(" Answer: a answer :  b ")).when(F.col("turn") % 3 == 1, F.lit(" #### 1 #### 2")).otherwise(F.lit("")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", maths.final_answer(said).alias("answer"))


_FINAL = "select conv_id, turn, case turn % 3 when 0 then 'b' when 1 then '2' else regexp_replace(text, '^\\s+|\\s+$', '', 'g') end as answer from conversations"


def boxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat("text", F.when(F.col("turn") % 2 == 0, F.lit(" \\boxed{1} and \\boxed{ 2 } end")).otherwise(F.lit("")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", maths.simple_box(said).alias("answer"))


def solutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decimals to fractions, marks and boxes gone, the answer boxed."""
    body = F.concat("text", F.lit(" <<3*.5=1.5>> so 0,25 and \\boxed{1.5}"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(maths.finished(body, F.lit("1.5"))).alias("digest"))


def subject_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.subject(F.col("text"), _SUBJECTS, "other").alias("subject"))


_N = {k: f"len(regexp_extract_all(text, '(?i){v}'))" for k, v in _SUBJECTS.items()}


def accuracy_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long documents predicted to be good, against the labels, by source and in all."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    out = evaluate.accuracy_by_source(rows, (F.col("n_chars") > 500).cast("int"), F.col("quality"), "source")
    return out.select("source", "n", F.round("accuracy", 6).alias("accuracy"))


def agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return stats.agreement(rows, "lang", F.col("quality") == 1, F.col("toxic"))


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ("MT.BLEU", "GC.detection", "GC.correction", "SC.detection", "SC.correction", "QA.accuracy")))
    return table(spark, sf_dir, "events").groupBy((F.col("user_id") % 10).alias("run"), F.element_at(names, (F.col("user_id") % 6 + 1).cast("int")).alias("metric")).agg(F.round(F.max("value"), 6).alias("value"))


_METRICS = "m as (select user_id % 10 run, ['MT.BLEU', 'GC.detection', 'GC.correction', 'SC.detection', 'SC.correction', 'QA.accuracy'][user_id % 6 + 1] metric, round(max(value), 6) value from events group by all)"


def checkpoint_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.checkpoint_score(_metrics(spark, sf_dir), "run", 2)
    return out.select("run", F.round("score", 5).alias("score"))


def checkpoint_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.arg_max(checkpoint_scores(spark, sf_dir), "run")


_V = lambda m: f"coalesce(max(value) filter (where metric = '{m}'), 0)"
_SCORES = f"with {_METRICS}, s as (select run, round({_V('MT.BLEU')} / 100 + ({_V('GC.detection')} + {_V('GC.correction')}) / 2 + ({_V('SC.detection')} + {_V('SC.correction')}) / 2 + {_V('QA.accuracy')}, 5) score from m group by run)"


def metric_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.compared(_metrics(spark, sf_dir), "metric", "run", "value", list(range(10))).select("metric", *(F.col(str(i)).alias(f"run_{i}") for i in range(10)))


def bleu_chrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistants' turns scored against the users' turns before them."""
    p = pairs_from_turns(spark, sf_dir)
    return evaluate.bleu(p, "seq", "target", "source").join(evaluate.chrf(p, "seq", "target", "source")).select(F.round("bleu", 4).alias("bleu"), F.round("chrf", 4).alias("chrf"))


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question of four answers for every part."""
    answers = F.array(*(F.struct(F.lit(m).alias("marker"), c.cast("string").alias("text")) for m, c in zip("АБВГ", (F.col("p_brand"), F.col("p_type"), F.col("p_size"), F.col("p_name")))))
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("What is part "), F.col("p_partkey").cast("string"), F.lit("?")).alias("question"), answers.alias("answers"), F.array(F.lit("Б")).alias("correct_answers"))


def mcq_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = records.variants(_questions(spark, sf_dir), "p_partkey", 3)
    return v.select("p_partkey", "variant", F.element_at("correct_answers", 1).alias("marker"), T.question_prompt(F.col("question"), F.col("answers"), F.col("prefix")).alias("prompt"))


def mcq_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _questions(spark, sf_dir).select("p_partkey", T.question_prompt(F.col("question"), F.col("answers")).alias("prompt"))


_PROMPTS = "select p_partkey, 'What is part ' || p_partkey || '?' || chr(10) || chr(10) || 'А: ' || p_brand || chr(10) || 'Б: ' || p_type || chr(10) || 'В: ' || p_size || chr(10) || 'Г: ' || p_name as prompt from part"


def typo_inject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors in about half of the turns."""
    made = errors.injected(F.col("text"), F.concat_ws("-", "conv_id", "turn"), F.col("turn") % 2 == 0, alphabet=frozenset("abcdefghijklmnopqrstuvwxyz"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", made.alias("m")).select("conv_id", "turn", "m.input", "m.wrong", "m.right")


def first_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typo_inject(spark, sf_dir).join(table(spark, sf_dir, "conversations"), ["conv_id", "turn"]).select("conv_id", "turn", errors.differing(F.col("input"), F.col("text")).alias("d")).select("conv_id", "turn", "d.wrong", "d.right", "d.regions")


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in pieces of 1000 characters and together again."""
    docs = table(spark, sf_dir, "documents")
    return chunking.from_pieces(chunking.to_pieces(docs, "doc_id", "text", 1000), "doc_id").select("doc_id", F.length("text").alias("n_chars"))


def resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have no label yet."""
    return joins.remaining(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id")


def overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that even and odd documents share, with the last row of each side."""
    side = lambda rest: table(spark, sf_dir, "documents").where(F.col("doc_id") % 2 == rest).select("text", "doc_id")
    return joins.overlap(side(0), side(1), "text", "doc_id").select(F.md5("text").alias("digest"), F.col("left.doc_id").alias("left_id"), F.col("right.doc_id").alias("right_id"))


def story_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts read as lines: stories and their paragraphs."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n", -1)).alias("ord", "line"))
    return segment.stories(lines, "file", "ord", "line").groupBy("file").agg(F.countDistinct("story").alias("stories"), F.count("*").alias("paragraphs"))


_STORIES = r"""with d as (select doc_id, string_split(text, chr(10)) l from documents), x as (select doc_id, unnest(l) line, generate_subscripts(l, 1) p from d),
b as (select doc_id, p, p - coalesce(lag(p) over (partition by doc_id order by p), 0) - 1 gap, row_number() over (partition by doc_id order by p) k from x where regexp_matches(line, '\S'))
select doc_id as file, count(*) filter (where k = 1 or gap >= 3) as stories, count(*) filter (where k = 1 or gap >= 1) as paragraphs from b group by doc_id"""


def revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


def last_event_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return table(spark, sf_dir, "events").withColumn("k", F.row_number().over(w)).where("k = 1").select("user_id", "event_id", "event_type")


QUERIES = {f.__name__: f for f in (parse_choice, final_answer, boxed, solutions, subject_labels, accuracy_by_source, agreement, checkpoint_scores, checkpoint_argmax, metric_pivot, bleu_chrf, mcq_variants, mcq_prompts, typo_inject, first_difference, pieces, resume, overlap, story_runs, revenue_by_nation, last_event_by_user)}
ORACLES = {
    "parse_choice": _CHOICE,
    "final_answer": _FINAL,
    "boxed": "select conv_id, turn, case when turn % 2 = 0 then '2' else regexp_replace(text, '^\\s+|\\s+$', '', 'g') end as answer from conversations",
    "subject_labels": f"with n as (select conv_id, turn, {_N['orders']} a, {_N['money']} b from conversations) select conv_id, turn, case when a = 0 and b = 0 then 'other' when a >= b then 'orders' else 'money' end as subject from n",
    "accuracy_by_source": "select source, count(*) as n, round(avg(((n_chars > 500)::int = quality)::int), 6) as accuracy from documents join labels using (doc_id) group by rollup(source)",
    "agreement": "select lang, count(*) as n, count(*) filter (where quality = 1) as hits, round(100 * count(*) filter (where quality = 1) / count(*), 2) as percent, sum(toxic)::bigint as score from documents join labels using (doc_id) group by lang",
    "checkpoint_scores": _SCORES + " select run, score from s",
    "checkpoint_argmax": _SCORES + " select run, score from s order by score desc, run limit 1",
    "metric_pivot": f"with {_METRICS} select metric, " + ", ".join(f"max(value) filter (where run = {i}) as run_{i}" for i in range(10)) + " from m group by metric",
    "mcq_prompts": _PROMPTS,
    "resume": "select doc_id from documents where doc_id not in (select doc_id from labels)",
    "overlap": "select md5(a.text) as digest, a.i as left_id, b.i as right_id from (select text, max(doc_id) i from documents where doc_id % 2 = 0 group by text) a join (select text, max(doc_id) i from documents where doc_id % 2 = 1 group by text) b on a.text = b.text",
    "story_runs": _STORIES,
    "revenue_by_nation": "select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as n from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by n_name",
    "last_event_by_user": "select user_id, arg_max(event_id, (ts, event_id)) as event_id, arg_max(event_type, (ts, event_id)) as event_type from events group by user_id",
}
