"""Token-id files: documents compressed one by one against a shared zstandard dictionary.

A shard file is, all little-endian::

    header   magic "IDZ1", item width 2 or 4 (u32), SHA-256 of the dictionary (32 bytes)
    frames   one zstandard frame per document: its ids as unsigned integers of the item width
    index    per document: id (i64, the smallest value for null), frame offset (u64),
             frame length (u64), number of ids (u64)
    tail     index offset (u64), number of documents (u64), magic

The dictionary stands once beside the shards, in a file named by its hash. A short document is
read by one index entry, one seek and one small frame: the dictionary gives it the context that
its own few ids lack.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..session import reused
from .tokens import encoder

MAGIC = b"IDZ1"
HEAD = 4 + 4 + 32
TAIL = 8 + 8 + 4
ENTRY = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("size", "<u8"), ("n", "<u8")])
NULL_ID = -(1 << 63)
SHARD_BYTES = 32 << 20
DICTIONARY_BYTES = 64 << 10
SAMPLE_DOCS = 512  # documents that the dictionary is trained on, chosen by hash
SAMPLE_IDS = 2048  # ids of each, from a place chosen by hash
LEVEL = 3

INDEX = "part int, shard int, path string, n_docs long, n_tokens long, bytes long"
TOKENS = "doc_id long, start long, n_tokens long, ids_crc32 long, path string, frame_offset long, frame_bytes long"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)


@dataclass(frozen=True)
class IdFiles:
    """Written files: the folder, the dictionary, and one row per shard in ``shards``."""

    folder: str
    dictionary: bytes
    shards: DataFrame


def width_of(tokenizer: str) -> int:
    return 2 if encoder(tokenizer).tok.get_vocab_size() <= 1 << 16 else 4


def train_dictionary(docs: DataFrame, tokenizer: str, width: int) -> bytes:
    """A dictionary of at most ``DICTIONARY_BYTES`` from a bounded sample.

    The sample is the ``SAMPLE_DOCS`` texts with the smallest hash (one of each run of copies),
    and ``SAMPLE_IDS`` ids of each. Where there is too little to train on, the sample itself
    serves as a dictionary.
    """
    from .sampling import smallest_hashes

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            keys, out = b.column(1).to_pylist(), []
            for i, ids in enc.encode_column(b.column(0)):
                at = keys[i] % max(1, len(ids) - SAMPLE_IDS + 1)
                out.append(ids[at : at + SAMPLE_IDS].astype(f"<u{width}").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["ids"])

    sample = [bytes(r.ids) for r in smallest_hashes(docs, "text", SAMPLE_DOCS).mapInArrow(run, "ids binary").collect()]
    sample = sorted(x for x in sample if x)
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(sample)[:DICTIONARY_BYTES]


def _as_dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


class _Shard:
    def __init__(self, folder: str, part: int, no: int, width: int, digest: bytes):
        self.path = f"{folder}/ids-{part:06d}-{no:04d}-{uuid.uuid4().hex}.idz"
        fs, p = _open(self.path)
        self.out, self.part, self.no, self.entries, self.tokens, self.at = fs.open_output_stream(p), part, no, [], 0, HEAD
        self.out.write(MAGIC + width.to_bytes(4, "little") + digest)

    def add(self, doc, frame: bytes, n: int) -> None:
        self.out.write(frame)
        self.entries.append((NULL_ID if doc is None else doc, self.at, len(frame), n))
        self.at += len(frame)
        self.tokens += n

    def close(self) -> tuple:
        index = np.array(self.entries, ENTRY).tobytes()
        self.out.write(index + self.at.to_bytes(8, "little") + len(self.entries).to_bytes(8, "little") + MAGIC)
        self.out.close()
        return self.part, self.no, self.path, len(self.entries), self.tokens, self.at + len(index) + TAIL


def write_ids(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, doc_id: str = "doc_id", text: str = "text"
) -> IdFiles:
    """Write every document's ids (then ``end_id``) in ascending id order to shards in a shared folder.

    Documents are dealt out by ranges of the id, so shard order is id order; equal ids are
    ordered by their text. A task that runs again writes files of new names, and only the files
    named in the index of the attempt that succeeded are ever read.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    width = width_of(tokenizer)
    dictionary = train_dictionary(rows, tokenizer, width)
    digest = hashlib.sha256(dictionary).digest()
    fs, p = _open(folder)
    fs.create_dir(p, recursive=True)
    with fs.open_output_stream(f"{p}/dictionary-{digest.hex()}.zdict") as f:
        f.write(dictionary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, no, shard, done = encoder(tokenizer), TaskContext.get().partitionId(), 0, None, []
        comp = zstandard.ZstdCompressor(level=LEVEL, dict_data=_as_dictionary(dictionary), write_checksum=False)
        end = np.array([end_id], np.uint32)
        for b in batches:
            ids = b.column(0).to_pylist()
            for i, tok in enc.encode_column(b.column(1)):
                whole = np.concatenate((tok, end)).astype(f"<u{width}")
                if shard is None:
                    shard = _Shard(folder, part, no, width, digest)
                shard.add(ids[i], comp.compress(whole.tobytes()), len(whole))
                if shard.at >= SHARD_BYTES:
                    done.append(shard.close())
                    shard, no = None, no + 1
        if shard is not None:
            done.append(shard.close())
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        cols = list(zip(*done, strict=True)) if done else [[]] * len(kinds)
        names = [c.split()[0] for c in INDEX.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    ordered = rows.withColumn("_tie", F.xxhash64("text")).repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie")
    return IdFiles(folder, dictionary, reused(ordered.select("doc_id", "text").mapInArrow(run, INDEX), "id-shards"))


def _index(src, size: int) -> tuple[int, bytes, np.ndarray]:
    tail = src.read_at(TAIL, size - TAIL)
    head = src.read_at(HEAD, 0)
    if tail[-4:] != MAGIC or head[:4] != MAGIC:
        raise ValueError("not a token-id file")
    at, n = int.from_bytes(tail[:8], "little"), int.from_bytes(tail[8:16], "little")
    return int.from_bytes(head[4:8], "little"), head[8:HEAD], np.frombuffer(src.read_at(n * ENTRY.itemsize, at), ENTRY)


def _documents(path: str, size: int, dictionary: bytes, wanted: set[int] | None = None):
    """(index entry, ids) of the documents of a shard; with ``wanted``, only those frames are read."""
    fs, p = _open(path)
    with fs.open_input_file(p) as src:
        width, digest, index = _index(src, size)
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError("the file was written with another dictionary")
        unpack = zstandard.ZstdDecompressor(dict_data=_as_dictionary(dictionary))
        for e in index:
            if wanted is None or int(e["doc_id"]) in wanted:
                raw = unpack.decompress(src.read_at(int(e["size"]), int(e["offset"])), max_output_size=int(e["n"]) * width)
                yield e, np.frombuffer(raw, f"<u{width}").astype("<u4")


def fetch(files: IdFiles, doc_ids: Iterable[int]) -> dict[int, list[int]]:
    """Ids of a few documents, by index and seek."""
    wanted, out = set(doc_ids), {}
    for s in files.shards.select("path", "bytes").toLocalIterator():
        for e, ids in _documents(s.path, s.bytes, files.dictionary, wanted):
            out[int(e["doc_id"])] = ids.tolist()
    return out


def read_ids(files: IdFiles) -> DataFrame:
    """One row per document, read back from the shards: where its ids start among all, how many, their CRC-32.

    The place of a shard is a running total over one row per shard of some 32 MB.
    """
    dictionary = files.dictionary
    before = F.coalesce(F.sum("n_tokens").over(W.orderBy("part", "shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = files.shards.withColumn("base", before.cast("long")).select("path", "bytes", "base", "part", "shard")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                rows, start = [], r["base"]
                for e, ids in _documents(r["path"], r["bytes"], dictionary):
                    doc = int(e["doc_id"])
                    rows.append((None if doc == NULL_ID else doc, start, len(ids), zlib.crc32(ids.tobytes()), r["path"], int(e["offset"]), int(e["size"])))
                    start += len(ids)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
                names = [c.split()[0] for c in TOKENS.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    n = max(1, files.shards.count())
    return placed.repartitionByRange(n, "part", "shard").mapInArrow(run, TOKENS)
