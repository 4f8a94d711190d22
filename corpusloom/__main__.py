"""Command lines: `python -m corpusloom COMMAND --help`. Each reads files, runs one plan on Spark and writes files."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import dedup, errors, evaluate, records, retrieve, sample, stats
from .plans import corpora, mixtures
from .plans import pipeline as P
from .sources import ingest, read, write


def _numbered(df: DataFrame) -> DataFrame:
    """The rows with seq, in the order in which they were read."""
    return df.withColumn("seq", F.monotonically_increasing_id())


def clean(spark: SparkSession, a: argparse.Namespace) -> None:
    pairs = _numbered(read.tsv(spark, a.input))
    if a.stats_only:
        table = read.tsv_columns(spark, a.input)
        stats.described(table, table.columns).show(truncate=False)
        return
    if not a.output:
        raise SystemExit("--output is needed unless --stats-only is given")
    config = P.Config(pair=a.lang_pair, embed_sim_min=a.embed_sim, uk_quality_min=a.uk_quality_min, near_threshold=None if a.no_near else a.near)
    if a.calibrate:
        config = P.with_calibration(pairs, config)
    judged = P.judge(pairs, a.stages, config).cache()
    write.tsv(judged.where("failed_stage is null").orderBy("seq"), a.output, mode=a.mode)
    name = Path(a.input.rstrip("/")).name.split(".")[0]
    said = write.statistics(P.report(judged, a.stages), a.stats or f"{a.output.rstrip('/')}.stats.json", a.lang_pair, name)
    if a.audit and a.audit_rate > 0:
        write.jsonl(stats.audited(judged, a.audit_rate), a.audit, mode=a.mode)
    print(json.dumps(said, ensure_ascii=False, indent=2))


def corpus(spark: SparkSession, a: argparse.Namespace) -> None:
    source, target = a.lang_pair.split("-")
    pairs = read.moses_zip(spark, a.input, source, target) if a.input.endswith(".zip") else _numbered(read.tsv(spark, a.input))
    group = "id" if a.input.endswith(".zip") else None
    if group:
        pairs = pairs.withColumn("id", F.coalesce(T.document_key(F.col("id")), F.col("file")))
    config = P.Config(pair=a.lang_pair)
    built = _numbered(corpora.build(a.corpus, pairs, config, group))
    out = built if a.max_pairs is None else sample.first_n(built, "seq", a.max_pairs)
    if a.n_val:
        split = corpora.splits(a.corpus, out, a.n_val, a.max_train, a.lang_pair).cache()
        write.tsv(split.where("split = 'validation'"), f"{a.output}/validation", mode=a.mode)
        out = split.where("split = 'train'")
    write.tsv(out, f"{a.output}/train", mode=a.mode)


def select(spark: SparkSession, a: argparse.Namespace) -> None:
    """Pairs nearest to a development set, by embeddings that are given as Parquet (seq, embedding)."""
    found = retrieve.top_k(spark.read.parquet(a.queries), spark.read.parquet(a.vectors), "seq", "embedding", a.top_k)
    kept = _numbered(read.tsv(spark, a.input)).join(retrieve.retrieved(found).select(F.col("key").alias("seq")), "seq")
    rows = kept.select("seq", F.col("source").alias("src"), F.col("target").alias("tgt"), T.word_count(F.col("source")).alias("word_count"), F.lit(1).alias("n_sentences"))
    write.jsonl(rows.orderBy("seq"), a.output, ["src", "tgt", "word_count", "n_sentences"], mode=a.mode)


def pseudo(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = spark.read.parquet(a.input)  # seq, source, target, embedding
    docs = retrieve.pseudo_documents(rows, "seq", "source", "target", "embedding", tuple(a.sizes))
    write.jsonl(docs.select(F.col("source").alias("src"), F.col("target").alias("tgt"), "n_sentences", "word_count"), a.output, mode=a.mode)
    if a.copy_to:
        ingest.copied(a.output, a.copy_to)


def convert(spark: SparkSession, a: argparse.Namespace) -> None:
    """A folder of <pair>/<corpus>.tsv to <pair>/<split>.jsonl of chat records."""
    for folder in sorted(p for p in Path(a.input).iterdir() if p.is_dir()):
        files = sorted(folder.glob("*.tsv*"))
        if not files:
            continue
        parts = [read.pairs_tsv(spark, str(f)).withColumn("corpus", F.lit(f.name.split(".tsv")[0])) for f in files]
        rows = sample.concatenated(parts).withColumn("id", F.md5(F.concat_ws("\t", "source", "target")))
        pair = folder.name.replace("cz-", "cs-")
        built = mixtures.translation_set(rows, pair, a.split, corpora.CAPS.get(pair))
        print(folder.name, built.groupBy("corpus").count().orderBy("corpus").collect() if a.dry_run else "")
        write.nowhere(built) if a.dry_run else write.jsonl(built, f"{a.output}/{folder.name}/{a.split}", ["messages"], mode=a.mode)


def augment(spark: SparkSession, a: argparse.Namespace) -> None:
    """Lettered questions to several variants of each, as chats."""
    rows = read.questions(spark, a.input)
    keyed = dedup.first_questions(rows.withColumn("key", T.question_key(F.col("question"))), "question", "key")
    made = records.variants(keyed, "key", a.factor, a.seed)
    asked = T.question_prompt(F.col("question"), F.col("answers"), F.col("prefix"))
    write.jsonl(made.select("key", "variant", records.chat(records.PROMPTS["qa"], asked, F.element_at("correct_answers", 1)).alias("messages")), a.output, mode=a.mode)


def spelling(spark: SparkSession, a: argparse.Namespace) -> None:
    """Sentences (a line each) to spelling records, a share of them correct."""
    lines = read.numbered_lines(spark, a.input).where(F.length(F.trim("line")) > 0)
    made = lines.select(records.numbered("", F.col("ord")).alias("id"), errors.injected(F.col("line"), F.col("ord"), sample.chosen(a.correct_ratio, a.seed, "ord"), a.seed).alias("m"), F.col("line").alias("original_sentence"))
    write.jsonl(made.select("id", F.col("m.input").alias("input_sentence"), "original_sentence", F.col("m.wrong").alias("incorrect_word"), F.col("m.right").alias("correct_word")), a.output, mode=a.mode)


def choose(spark: SparkSession, a: argparse.Namespace) -> None:
    """The best run of a table of metrics (run, metric, value)."""
    scores = evaluate.checkpoint_score(read.jsonl(spark, a.input, "run string, metric string, value double"), "run", a.stage)
    scores.orderBy(F.col("score").desc(), "run").show(truncate=False)
    for r in evaluate.arg_max(scores, "run").collect():
        print(r.run)


def export(spark: SparkSession, a: argparse.Namespace) -> None:
    """Folders of predictions as one archive."""
    print(write.archive(a.input, a.output, a.prefix))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corpusloom", description=__doc__)
    p.add_argument("--master", default=None, help="Spark master, else what the session is configured with")
    p.add_argument("--log-level", default="INFO", choices=["DEBUG", "INFO", "WARNING", "ERROR"])
    sub = p.add_subparsers(dest="command", required=True)

    def add(run, text: str, output: bool = True) -> argparse.ArgumentParser:
        c = sub.add_parser(run.__name__, help=text)
        c.set_defaults(run=run)
        c.add_argument("--input", required=True)
        c.add_argument("--output", required=output)
        c.add_argument("--mode", default="errorifexists", choices=["errorifexists", "overwrite", "append"])
        return c

    c = add(clean, "clean a TSV of pairs by stages", output=False)
    c.add_argument("--lang-pair", default="en-uk", choices=["en-uk", "cs-uk"])
    c.add_argument("--stages", default="all")
    c.add_argument("--calibrate", action="store_true")
    c.add_argument("--stats-only", action="store_true")
    c.add_argument("--embed-sim", type=float, default=0.60)
    c.add_argument("--uk-quality-min", type=float, default=0.0)
    c.add_argument("--near", type=float, default=0.90)
    c.add_argument("--no-near", action="store_true")
    c.add_argument("--stats", help="statistics file, else next to the output")
    c.add_argument("--audit", help="folder for a sample of rejected rows")
    c.add_argument("--audit-rate", type=float, default=0.01)
    c = add(corpus, "build a corpus: windows, stages, split")
    c.add_argument("corpus", choices=sorted(corpora.CORPORA))
    c.add_argument("--lang-pair", default="cs-uk", choices=["en-uk", "cs-uk"])
    c.add_argument("--max-pairs", type=int)
    c.add_argument("--max-train", type=int)
    c.add_argument("--n-val", type=int, default=0)
    c = add(select, "pairs nearest to a development set")
    c.add_argument("--queries", required=True)
    c.add_argument("--vectors", required=True)
    c.add_argument("--top-k", type=int, default=75)
    c = add(pseudo, "pseudo-documents of clusters")
    c.add_argument("--sizes", type=int, nargs="+", default=[3, 5, 8, 12])
    c.add_argument("--copy-to")
    c = add(convert, "TSVs to chat records", output=False)
    c.add_argument("--split", default="train", choices=["train", "validation"])
    c.add_argument("--dry-run", action="store_true")
    c = add(augment, "variants of questions")
    c.add_argument("--factor", type=int, default=3)
    c.add_argument("--seed", type=int, default=42)
    c = add(spelling, "sentences with spelling errors")
    c.add_argument("--correct-ratio", type=float, default=0.5)
    c.add_argument("--seed", type=int, default=42)
    c = add(choose, "the best checkpoint", output=False)
    c.add_argument("--stage", type=int, default=1, choices=[1, 2])
    c = add(export, "an archive of predictions")
    c.add_argument("--prefix", default="submission")
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    logging.basicConfig(level=a.log_level)
    builder = SparkSession.builder.appName("corpusloom")
    spark = (builder.master(a.master) if a.master else builder).getOrCreate()
    a.run(spark, a)


if __name__ == "__main__":
    main(sys.argv[1:])
