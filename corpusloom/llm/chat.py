"""Operator 3, chat formatting: cumulative-snapshot collapse.

Chat logs often hold one conversation many times, each time a few turns longer.
Every turn gets a rolling hash of the turns up to it (two sums over position-
tagged turn hashes modulo primes, so a window sum yields them without a loop and
without collecting a conversation).  A conversation whose last prefix hash is a
proper prefix hash of another one is a snapshot of it; an anti-join removes it.
Of equal conversations the smallest id stays.  What remains is rendered.

Defined results: turns are ordered by turn, role, text (null turns first), so
ties and shuffled input give one result; rows that repeat (conv_id, turn, role,
text) count once; a null role or text counts as empty; rows of a null conv_id
belong to no conversation and are left out; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_PRIMES = (2147483647, 2147483629)
_WINDOW_ORDER = ("__turn", "__role", "__body")


def _turns(conversations: DataFrame) -> DataFrame:
    return (
        conversations.where("conv_id is not null")
        .select("conv_id", F.col("turn").alias("__turn"), F.coalesce("role", F.lit("")).alias("__role"), F.coalesce("text", F.lit("")).alias("__body"))
        .distinct()
    )


def prefixes(conversations: DataFrame) -> DataFrame:
    """Every turn with its 1-based position, the rolling hash of the prefix it ends, and the length of its conversation."""
    by = Window.partitionBy("conv_id").orderBy(*_WINDOW_ORDER)
    far = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = _turns(conversations).withColumn("__pos", F.row_number().over(by))
    # a turn's hash holds its position, so a sum over the prefix depends on order
    for k, p in enumerate(_PRIMES):
        numbered = numbered.withColumn(f"__h{k}", F.sum(F.pmod(F.xxhash64(F.lit(k), "__pos", "__role", "__body"), F.lit(p))).over(far))
    whole = Window.partitionBy("conv_id")
    return numbered.withColumn("__key", F.struct("__pos", "__h0", "__h1")).withColumn("__len", F.count("*").over(whole))


def maximal(conversations: DataFrame) -> DataFrame:
    """Turns (as prefixes()) of the conversations that no other one continues or, with a smaller id, equals."""
    p = prefixes(conversations)
    inner = p.where("__pos < __len").select(F.col("__pos").alias("__ip"), F.col("__h0").alias("__i0"), F.col("__h1").alias("__i1"))
    last = p.where("__pos = __len").select("conv_id", "__pos", "__h0", "__h1")
    first = last.groupBy("__pos", "__h0", "__h1").agg(F.min("conv_id").alias("conv_id"))
    stays = first.join(inner, (F.col("__pos") == F.col("__ip")) & (F.col("__h0") == F.col("__i0")) & (F.col("__h1") == F.col("__i1")), "left_anti")
    return p.join(stays.select("conv_id"), "conv_id", "left_semi")


def rendered(role: Column, body: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), body, F.lit("<|im_end|>\n"))


def collapse(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns and the rendered chat of every maximal conversation."""
    turns = F.array_sort(F.collect_list(F.struct("__pos", "__role", "__body")))
    return (
        maximal(conversations)
        .groupBy("conv_id")
        .agg(turns.alias("__turns"))
        .select("conv_id", F.size("__turns").cast("long").alias("n_turns"), F.array_join(F.transform("__turns", lambda t: rendered(t["__role"], t["__body"])), "").alias("chat"))
    )


ORACLE = """
with t as (select distinct conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as body from conversations where conv_id is not null),
s as (select conv_id, md5(string_agg(length(role) || ':' || length(body) || ':' || role || body, '') over w) h, row_number() over w pos,
             count(*) over (partition by conv_id) n, role, body
      from t window w as (partition by conv_id order by turn nulls first, role, body)),
e as (select min(conv_id) conv_id, n, h from s where pos = n group by n, h),
k as (select conv_id from e where not exists (select 1 from s where s.h = e.h and s.pos = e.n and s.pos < s.n))
select conv_id, count(*) as n_turns,
       string_agg('<|im_start|>' || role || chr(10) || body || '<|im_end|>' || chr(10), '' order by pos) as chat
from s where conv_id in (select conv_id from k) group by conv_id
"""
