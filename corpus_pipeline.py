"""A training-corpus pipeline over ``documents``: each stage works on what its predecessor kept.

All stages but the last return the columns of ``documents``; the last one returns the pieces of
packed windows. A null or empty text, or one of white space alone, passes every filter, whatever
the classifier gives to no features; a null or empty one is packed as its end id alone.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slopecast.llm.decontaminate import decontaminate
from slopecast.llm.lines import dedup_lines
from slopecast.llm.minhash import near_duplicates
from slopecast.llm.packing import pack
from slopecast.llm.quality import score
from slopecast.llm.queries import KEEP, quality_model, vocabulary
from slopecast.llm.sampling import only
from slopecast.session import discard, reused, scratch_scope

VISIBLE = r"[^ \t\n\x0B\f\r]"  # anything but white space is a feature to the classifier
_left: list[str] = []  # scratch tables of the stage before, whose result has been written when the next begins


def stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """Deletes what the stage before has left in the shared folder, then notes what this one leaves."""

    @wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard(spark, *_left)
        _left.clear()
        with scratch_scope() as made:
            out = work(spark, docs, sf_dir)
        _left.extend(made)
        return out

    return run_stage


def _new(name: str, docs: DataFrame) -> str:
    """A column name that ``docs`` does not have."""
    while name in docs.columns:
        name += "_"
    return name


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good ones, and those without a text it could judge."""
    bare = ~F.coalesce(F.col("text").rlike(VISIBLE), F.lit(False))
    out = _new("_score", docs)
    return score(docs, quality_model(spark, sf_dir), out=out).where((F.col(out) >= KEEP) | bare).drop(out)


@stage
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that repeat an earlier one; a document of which nothing is left goes."""
    own = {c: _new(f"own_{c}", docs) for c in ("n_lines", "n_removed", "removed") if c in docs.columns}
    cleaned = dedup_lines(docs.withColumnsRenamed(own))
    left = cleaned.where((F.col("n_removed") == 0) | F.coalesce(F.col("text").rlike(VISIBLE), F.lit(False)))
    sized = F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    out = left.withColumn("n_chars", sized).drop("n_lines", "n_removed", "removed")
    return out.withColumnsRenamed({v: k for k, v in own.items()}).select(docs.columns)


@stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the least id, of each group with a similarity of 0.8 on five-word shingles."""
    gone = reused(near_duplicates(docs, shingle=5, percent=80).where("not kept").select("doc_id").distinct(), "gone")
    return only(docs, gone, "doc_id", "left_anti").select(docs.columns)


@stage
def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hit = reused(decontaminate(docs, items).where("contaminated").select("doc_id").distinct(), "hit")
    return only(docs, hit, "doc_id", "left_anti").select(docs.columns)


@stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents as pieces of 4096-token windows."""
    return pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("benchmark", benchmark), ("packing", packing)]

# A fitted classifier decides which documents stay, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, work in STAGES[:-1]:
        docs = reused(work(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
