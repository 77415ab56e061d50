"""Token counts of whole texts; huge texts are encoded in overlapping chunks and resynchronised.

A text of up to ``CHUNK`` bytes is encoded whole. A longer one is cut into chunks that overlap
their successor, and the chunks of all texts are dealt over the cluster, so neither a task nor
the library ever holds the offsets of a whole huge text. Every chunk is encoded with offsets, and
neighbours are spliced at a stable common boundary: a place in the overlap where both of them
begin a new piece of the pre-tokenizer.

Why that is exact: the pre-tokenizer scans from left to right without looking back, and merges
never leave a piece. So from a place where two scans both begin a piece they agree for ever
(but for their right edge), and the left chunk's scan is the true one by induction from the
first chunk. At its right edge a scan may lack what follows; a boundary counts as stable only
if the longest look ahead, that of an added special token, ends before the edge.

Where two neighbours share no boundary (a run of thousands of letters, say), the texts concerned
are cut again with wider overlaps and longer chunks, until they align or are one chunk.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import reused
from .kernel import raw_text
from .sampling import only
from .tokens import encoder

CHUNK = 1 << 15  # bytes a chunk advances, and the longest text that is encoded whole
OVERLAP = 1 << 9  # bytes that a chunk reaches into its successor
WIDEN = 8  # growth of the overlap when chunks do not align
LOOKAHEAD = 4  # characters that the pattern of pieces looks at beyond the end of a piece
ROWS = 256  # chunks encoded between two batches of results

CHUNKS = "key string, k int, body string, seam long"
SIDES = "key string, seam int, side string, at array<int>, before array<long>"


class Library:
    """The library that a vocabulary file belongs to, as it comes: special strings by its default."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path, self.pieces, self.margin = path, None, 0
        if path.endswith(".model"):
            import sentencepiece

            self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
            return
        self.sp = None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        added = spec["added_tokens"]
        plain = not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added)
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre["add_prefix_space"] and not spec["normalizer"] and plain:
            from tokenizers import Tokenizer, processors

            self.pieces = Tokenizer.from_file(path)
            self.pieces.post_processor = processors.ByteLevel(trim_offsets=False)  # keeps spaces inside offsets, changes no id
            self.margin = LOOKAHEAD + max((len(t["content"]) for t in added), default=0)

    def counts(self, texts: pa.Array) -> list[int]:
        """Tokens of each whole text; a null text has none."""
        if self.sp:
            return [len(self.sp.encode(t or "")) for t in texts.to_pylist()]
        return [len(ids) for _, ids in encoder(self.path).encode_column(texts)]

    def boundaries(self, body: str) -> tuple[np.ndarray, np.ndarray, int]:
        """(places where a piece begins, tokens before each, all tokens) of a chunk."""
        e = self.pieces.encode(body, add_special_tokens=False)
        if not len(e):
            return np.zeros(1, np.int64), np.zeros(1, np.int64), 0
        piece = np.array(e.word_ids)
        first = np.flatnonzero(np.append(True, piece[1:] != piece[:-1]))
        return np.array(e.offsets)[first, 0], first, len(piece)


@lru_cache(maxsize=2)
def library(path: str) -> Library:
    return Library(path)


def cut(data: np.ndarray, chunk: int, overlap: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, start of the next or -1) of the chunks of a text's bytes, never inside a character."""

    def at(p: int) -> int:
        while p < len(data) and data[p] & 0xC0 == 0x80:
            p += 1
        return p

    start = 0
    while True:
        nxt, end = at(start + chunk), at(start + chunk + overlap)
        if end >= len(data):
            yield start, len(data), -1
            return
        yield start, end, nxt
        start = nxt


def _chunks(texts: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """Chunks of ``texts`` (key, text), each once however many copies of its text there are."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, (data, off) = b.column(0).to_pylist(), raw_text(b.column(1))
            for i, key in enumerate(keys):
                whole, rows = data[off[i] : off[i + 1]], []
                for k, (start, end, nxt) in enumerate(cut(whole, chunk, overlap)):
                    seam = -1 if nxt < 0 else int(((whole[start:nxt] & 0xC0) != 0x80).sum())
                    rows.append((key, k, whole[start:end].tobytes().decode("utf-8", "replace"), seam))
                    if len(rows) == ROWS:
                        yield _batch(rows, (pa.string(), pa.int32(), pa.string(), pa.int64()), CHUNKS)
                        rows = []
                if rows:
                    yield _batch(rows, (pa.string(), pa.int32(), pa.string(), pa.int64()), CHUNKS)

    return texts.select("key", "text").mapInArrow(run, CHUNKS).dropDuplicates(["key", "k"])


def _batch(rows: list[tuple], kinds: tuple, schema: str) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _sides(chunks: DataFrame, tokenizer: str, overlap: int) -> DataFrame:
    """What each chunk says about the seams at its ends: boundaries, counted from the seam's start, and tokens before them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = library(tokenizer)
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                rows = []
                for r in b.slice(i, ROWS).to_pylist():
                    at, before, total = lib.boundaries(r["body"])
                    if r["k"]:
                        near = at <= overlap
                        rows.append((r["key"], r["k"] - 1, "right", at[near], before[near]))
                    if r["seam"] < 0:
                        rows.append((r["key"], r["k"], "end", np.zeros(1, np.int64), np.array([total])))
                    else:
                        safe = (at >= r["seam"]) & (at + lib.margin <= len(r["body"]))
                        rows.append((r["key"], r["k"], "left", at[safe] - r["seam"], before[safe]))
                yield _batch(rows, (pa.string(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64())), SIDES)

    return chunks.mapInArrow(run, SIDES)


def _spliced(sides: DataFrame) -> DataFrame:
    """(key, n_tokens) of every text; null where two of its chunks share no boundary."""
    left = sides.where("side = 'left'").select("key", "seam", F.col("at").alias("a"), F.col("before").alias("a_before"))
    right = sides.where("side = 'right'").select("key", "seam", F.col("at").alias("b"), F.col("before").alias("b_before"))
    met = left.join(right, ["key", "seam"]).withColumn("p", F.array_min(F.array_intersect("a", "b")))
    # the left chunk's tokens up to the common boundary count, the right one's before it do not
    part = F.expr("element_at(a_before, cast(array_position(a, p) as int)) - element_at(b_before, cast(array_position(b, p) as int))")
    parts = met.select("key", part.alias("n")).unionByName(sides.where("side = 'end'").select("key", F.col("before")[0].alias("n")))
    return parts.groupBy("key").agg(F.when(F.count("n") == F.count("*"), F.sum("n")).alias("n_tokens"))


def token_counts(
    docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """``doc_id``, ``n_bytes`` (UTF-8) and ``n_tokens`` of every row, as the vocabulary's library counts the whole text.

    No begin, end or added special tokens; nothing is truncated or padded. A null text counts
    as an empty one; rows are kept as they are, also repeated ids and null ids; an empty table
    gives an empty one. Other columns of ``docs`` are ignored, whatever their names. Chunks need
    a byte-level vocabulary whose pieces are found without looking back; with any other file
    (a normalizer, a sentencepiece model) every text is encoded whole.
    """
    size = F.octet_length("text").cast("long")
    rows = docs.select(docs[doc_id].alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("text")).withColumn("n_bytes", size)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = library(tokenizer)
        for b in batches:
            n = pa.array(lib.counts(b.column("text")), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), n], names=["doc_id", "n_bytes", "n_tokens"])

    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long"
    if library(tokenizer).pieces is None:
        return rows.mapInArrow(run, schema)
    short = rows.where(F.col("n_bytes") <= chunk).mapInArrow(run, schema)
    # a count belongs to a text, not to a row: copies share it, and rows need no identity
    long = rows.where(F.col("n_bytes") > chunk).withColumn("key", F.sha2("text", 256))
    pending, done = long.select("key", "text"), None
    while True:
        counted = reused(_spliced(reused(_sides(_chunks(pending, chunk, overlap), tokenizer, overlap), "seams")), "counts")
        apart = counted.where("n_tokens is null").select("key")
        aligned = counted.where("n_tokens is not null")
        done = aligned if done is None else done.unionByName(aligned)
        if apart.isEmpty():
            break
        overlap *= WIDEN
        chunk = max(chunk, 4 * overlap)
        pending = only(long.select("key", "text"), apart, "key")
    return short.unionByName(long.select("doc_id", "n_bytes", "key").join(done, "key").select("doc_id", "n_bytes", "n_tokens"))
