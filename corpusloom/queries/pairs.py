"""Cleaning of pairs: the user's and the assistant's adjacent turns of `conversations` stand for the two sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import clean, filters, records, sample, segment, stats
from ..plans.pipeline import Config, judge, run_stages, statistics



def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pairs_from_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, source, target: a user's turn and the assistant's that follows it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").withColumn("next", F.lead(F.struct("role", "text")).over(w))
    return turns.where((F.col("role") == "user") & (F.col("next.role") == "assistant")).select((F.col("conv_id") * 100_000 + F.col("turn")).alias("seq"), F.col("text").alias("source"), F.col("next.text").alias("target"))


_PAIRS = """t as (select conv_id, turn, role, text, lead(role) over w nrole, lead(text) over w ntext from conversations window w as (partition by conv_id order by turn)),
pairs as (select conv_id * 100000 + turn seq, text source, ntext target from t where role = 'user' and nrole = 'assistant')"""


def _sides():
    return F.col("source"), F.col("target")


def _flat(df: DataFrame, outcome) -> DataFrame:
    return df.select("seq", outcome.alias("o")).select("seq", F.coalesce("o.reason", F.lit("pass")).alias("reason"), F.round("o.score", 6).alias("score"))


def structural_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs_from_turns(spark, sf_dir)
    return stats.reasons(p.select(clean.structural(*_sides())["reason"].alias("reason")))


def structural_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(pairs_from_turns(spark, sf_dir), clean.structural(*_sides()))


def _words(c: str) -> str:
    return f"len(regexp_extract_all({c}, '\\S+'))"


def _n(c: str, pattern: str) -> str:
    return f"len(regexp_extract_all({c}, '{pattern}'))"


def _balance(c: str, a: str = "\\(", b: str = "\\)") -> str:
    return f"({_n(c, a)} - {_n(c, b)})"


def _structural(t: dict) -> str:
    return f"""case when length(source) < {t['src'][0]} then 'src_too_short' when length(source) > {t['src'][1]} then 'src_too_long'
when length(target) < {t['tgt'][0]} then 'tgt_too_short' when length(target) > {t['tgt'][1]} then 'tgt_too_long'
when length(target) = 0 or not length(source) / length(target) between {t['chars'][0]} and {t['chars'][1]} then 'char_ratio'
when {_words('target')} > 0 and not {_words('source')} / {_words('target')} between {t['words'][0]} and {t['words'][1]} then 'word_ratio' else 'pass' end"""


_QUOTES = "[\"''«»]"
_TERMINAL = "case when not (regexp_matches(source, '[.!?]\\s*$') or trim(source) = '') or regexp_matches(target, '[.!?]\\s*$') or trim(target) = '' then 1.0 else 0.5 end"
_BRACKETS = f"case when {_balance('source')} = 0 and {_balance('target')} = 0 then 1.0 when abs({_balance('source')}) = abs({_balance('target')}) then 0.8 else 0.4 end"
_APART = f"abs({_n('source', _QUOTES)} - {_n('target', _QUOTES)})"
_SOFT = f"(({_TERMINAL}) + ({_BRACKETS}) + (case when {_APART} = 0 then 1.0 when {_APART} <= 1 then 0.7 else 0.3 end)) / 3"
_EN = clean.THRESHOLDS["en-uk"]
_STRUCTURAL = f"with {_PAIRS}, s as (select seq, {_structural(_EN)} reason, {_SOFT} soft from pairs)"


def entity_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(pairs_from_turns(spark, sf_dir), clean.entity(*_sides()))


_NUMBER = "\\b\\d(?:[\\s\\d''.,]*\\d|\\b)"
_URL = clean.URL
_ENTITY = f"""with {_PAIRS}, n as (select *, regexp_extract_all(source, '{_NUMBER}') a, regexp_extract_all(target, '{_NUMBER}') b, abs({_n('source', _URL)} - {_n('target', _URL)}) urls,
abs({_n('source', '[0-9]+\\s*%')} - {_n('target', '[0-9]+\\s*%')}) pct, abs({_balance('source', '[(\\[{]', '[)\\]}]')} - {_balance('target', '[(\\[{]', '[)\\]}]')}) br from pairs),
s as (select seq, case when abs(len(a) - len(b)) > greatest(1, len(a) // 4) then 'number_count' when len(list_filter(a, lambda x: length(replace(replace(x, ',', ''), '.', '')) >= 4 and not contains(target, x))) > 0 then 'large_number'
when urls > 0 then 'url' when pct > 1 then 'percent' else 'pass' end reason, ((1 - least(1.0, abs(len(a) - len(b)) * 0.3)) + 1 + case when br <= 1 then 1.0 else 0.5 end + (1 - pct * 0.2)) / 4 soft from n)"""
_SCORED = " select seq, reason, round(case when reason = 'pass' then soft else 0 end::double, 6) as score from s"


def copy_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any share of Latin letters is allowed: the test tables hold no other."""
    return _flat(pairs_from_turns(spark, sf_dir), clean.copied(*_sides(), latin=1.0)).drop("score")


_COPY = f"""with {_PAIRS}, w as (select *, list_distinct(regexp_extract_all(lower(source), '\\S+')) a, list_distinct(regexp_extract_all(lower(target), '\\S+')) b, greatest(length(target), 1) / greatest(length(source), 1) r from pairs)
select seq, case when r <= 0.5 or r >= 2.2 then 'char_ratio_oob' when len(a) > 3 and len(b) > 3 and len(list_intersect(a, b)) / greatest(len(a), len(b)) > 0.7 then 'high_token_overlap' else 'pass' end as reason from w"""

_LATIN, _CYRILLIC = "abcdefghijklmnopqrstuvwxyz", "абцдефгхијклмнопярстувыэїз"


def uk_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts written in Cyrillic letter by letter, so that all terms of the score count."""
    c = F.translate(F.lower("text"), _LATIN, _CYRILLIC)
    return table(spark, sf_dir, "documents").select("doc_id", F.round(clean.uk_quality(c), 6).alias("score"))


_UK = f"""with d as (select doc_id, translate(lower(text), '{_LATIN}', '{_CYRILLIC}') t from documents),
n as (select doc_id, {_n('t', '[А-яҐґЄєІіЇї]')} cyr, {_n('t', '[іїєґІЇЄҐ]')} uk, {_n('t', '[ыэъЫЭЪ]')} ru, regexp_extract_all(t, '\\S+') w from d)
select doc_id, round(case when cyr = 0 then 0.5 else greatest(0, least(1, uk / cyr * 0.5 + (1 - least(1, ru / cyr * 5)) * 0.3 + (1 - coalesce(least(1, len(list_filter(w, lambda x: x in ({", ".join(f"'{x}'" for x in clean.RUSSIAN)}))) / nullif(len(w), 0) * 10), 0)) * 0.2)) end::double, 6) as score from n"""


def composite_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs_from_turns(spark, sf_dir)
    score = clean.composite({"structural": clean.structural(*_sides())["score"], "uk_quality": F.when(F.length("target") % 2 == 0, clean.uk_quality(F.col("target")))})
    return p.select("seq", F.round(score, 6).alias("score"))


_COMPOSITE = _STRUCTURAL + """, c as (select seq, case when reason = 'pass' then soft else 0 end st, length(target) % 2 = 0 even from s join pairs using (seq))
select seq, round((case when even then (st * 0.15 + 0.5 * 0.35) / 0.5 else st end)::double, 6) as score from c"""


def word_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs_from_turns(spark, sf_dir).where(filters.word_window(*_sides())).select("seq", T.word_count(F.col("source")).cast("long").alias("n_source"), T.word_count(F.col("target")).cast("long").alias("n_target"))


_WINDOW = f"""with {_PAIRS}, w as (select seq, {_words('source')} a, {_words('target')} b from pairs)
select seq, a as n_source, b as n_target from w where a between 3 and 100 and b between 3 and 100 and a / greatest(b, 1) between {1 / 3} and 3.0"""

_OPEN = Config(latin=1.0, overrides={"chars": (0.05, 20.0), "tgt": (5, 5000), "src": (2, 5000), "words": (0.05, 20.0)}, compose=False, near_threshold=None)


def stage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics(judge(pairs_from_turns(spark, sf_dir), [1, 2, 5], _OPEN), [1, 2, 5]).select("stage", "n_in", "n_out", "n_rejected", "retention")


_TIDY = "regexp_replace(regexp_replace(translate({c}, chr(700) || chr(8217), ''''''), '[ \\t\\r\\f]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"
_JUDGED = f"""with {_PAIRS}, u as (select seq, {_TIDY.format(c="source")} source, {_TIDY.format(c="target")} target from pairs), e as (select *, source = '' or target = '' empty from u),
d as (select *, not empty and row_number() over (partition by empty, source, target order by seq) > 1 again from e),
f as (select *, case when empty then 'unicode' when again then 'dedup' when ({_structural(_EN | _OPEN.overrides)}) <> 'pass' then 'structural' end failed from d)"""
_STATS = _JUDGED + """, g as (select failed, count(*) n from f group by failed), k as (select * from (values (0, 'unicode'), (1, 'dedup'), (2, 'structural')) v(i, stage)),
r as (select i, stage, coalesce(n, 0) lost, (select count(*) from f) total from k left join g on failed = stage),
x as (select *, total - coalesce(sum(lost) over (order by i rows between unbounded preceding and 1 preceding), 0) n_in from r)
select stage, n_in::bigint as n_in, (n_in - lost)::bigint as n_out, lost as n_rejected, case when n_in > 0 then round((n_in - lost) / n_in * 100, 2) else 0 end::double as retention from x"""


def cleaned_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_stages(pairs_from_turns(spark, sf_dir), [1, 2, 5], _OPEN)


_CLEANED = _JUDGED + " select source, target from f where failed is null"


def cleaned_all_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nine stages; those whose models aren't there pass everything."""
    return judge(pairs_from_turns(spark, sf_dir), "all", Config(latin=1.0, near_threshold=0.85)).select("seq", "failed_stage", "reason", "composite_score")


def calibrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.calibrated(pairs_from_turns(spark, sf_dir))
    return out.select("measure", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


_MEASURES = {"src_chars": "length(source)", "tgt_chars": "length(target)", "char_ratio": "length(source) / greatest(length(target), 1)", "word_ratio": "len(string_split(source, ' ')) / greatest(len(string_split(target, ' ')), 1)"}
_CALIBRATE = f"with {_PAIRS} " + " union all ".join(f"select '{k}' as measure, round(quantile_disc(({v})::double, 0.025), 6) as low, round(quantile_disc(({v})::double, 0.975), 6) as high from pairs" for k, v in _MEASURES.items())


def quality_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked by length and structure; the best pairs for validation."""
    scored = pairs_from_turns(spark, sf_dir).withColumn("quality", F.round(segment.quality(*_sides(), clean.structural(*_sides())["score"], F.lit(0.5), 600, (0.55, 0.25, 0.20)), 6))
    return sample.quality_split(scored, "quality", "seq", 60, 100).select("seq", "quality", "split")


_SPLIT = _STRUCTURAL + """, q as (select seq, round((least(1, (length(source) + length(target)) / 2 / 600) * 0.55 + case when reason = 'pass' then soft else 0 end * 0.25 + 0.1)::double, 6) quality from s join pairs using (seq)),
r as (select *, row_number() over (order by quality desc, seq) k, count(*) over () n from q), v as (select *, greatest(50, least(60, floor(n * 0.05))) v0 from r),
z as (select *, case when v0 >= n then greatest(1, floor(n / 10)) else v0 end v from v)
select seq, quality, case when k <= v then 'validation' else 'train' end as split from z where k <= v + 100"""


def chat_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs_from_turns(spark, sf_dir).select("seq", records.rendered(records.translation(*_sides())).alias("chat"))


_CHAT = f"with {_PAIRS} select seq, '<|im_start|>system' || chr(10) || '{records.PROMPTS['mt']}' || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || source || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || target || '<|im_end|>' || chr(10) as chat from pairs"

QUERIES = {f.__name__: f for f in (pairs_from_turns, structural_reasons, structural_score, entity_consistency, copy_source, uk_quality, composite_score, word_window, stage_stats, cleaned_pairs, cleaned_all_stages, calibrate, quality_split, chat_records)}
ORACLES = {
    "pairs_from_turns": f"with {_PAIRS} select seq, source, target from pairs",
    "structural_reasons": _STRUCTURAL + " select reason, count(*) as n from s group by reason",
    "structural_score": _STRUCTURAL + _SCORED,
    "entity_consistency": _ENTITY + _SCORED,
    "copy_source": _COPY,
    "uk_quality": _UK,
    "composite_score": _COMPOSITE,
    "word_window": _WINDOW,
    "stage_stats": _STATS,
    "cleaned_pairs": _CLEANED,
    "calibrate": _CALIBRATE,
    "quality_split": _SPLIT,
    "chat_records": _CHAT,
}
