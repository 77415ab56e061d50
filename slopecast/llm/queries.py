"""The subpackage's registered queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .caps import OP8_SQL, op8_cap_filters
from .chat import OP5_SQL, op5_chat_format
from .decontaminate import OP10_SQL, op10_decontaminate
from .holdout import held_out
from .idfiles import read_ids, write_ids
from .langid import identify, learn
from .lines import op9_line_dedup
from .manifest import OP11_SQL, op11_merkle_manifest
from .minhash import op4_minhash
from .packing import pack
from .quality import fit, score
from .spelling import OP12_SQL, op12_spelling_variants
from .tokencounts import token_counts
from .urls import OP6_SQL, op6_url_filter


KEEP = 0.7  # score from which a document counts as good
LIMIT = 1024  # tokens above which a document is marked


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    judged = identify(docs.select("doc_id", "text"), learn(docs.where(~held_out())))
    return judged.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "n_phrases")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_ids(documents(spark, sf_dir), scratch_path(spark, "ids"), vocabulary("byte_bpe_50k.json"))
    return read_ids(files).select("doc_id", "start", "n_tokens", "ids_crc32")


def quality_model(spark: SparkSession, sf_dir: str):
    """Fitted on labelled documents that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label")).where(~held_out())
    return fit(documents(spark, sf_dir), labels)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(documents(spark, sf_dir).select("doc_id", "text"), quality_model(spark, sf_dir))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > LIMIT)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_packing": op2_packing,
    "op3_token_files": op3_token_files,
    "op4_minhash": op4_minhash,
    "op5_chat_format": op5_chat_format,
    "op6_url_filter": op6_url_filter,
    "op7_quality": op7_quality,
    "op8_cap_filters": op8_cap_filters,
    "op9_line_dedup": op9_line_dedup,
    "op10_decontaminate": op10_decontaminate,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_token_counts": op13_token_counts,
}
SQL: dict[str, str] = {
    "op5_chat_format": OP5_SQL,
    "op6_url_filter": OP6_SQL,
    "op8_cap_filters": OP8_SQL,
    "op10_decontaminate": OP10_SQL,
    "op11_merkle_manifest": OP11_SQL,
    "op12_spelling_variants": OP12_SQL,
}
