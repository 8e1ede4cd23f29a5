"""Word blocks: about ``BLOCK_BYTES`` of text as word ids, packed into one row.

Some operators need facts about all occurrences of a key (a word run, an
n-gram) next to the text it came from.  Sending every occurrence through a
shuffle costs several times the input, and a frequent key lands in one task.
Here each block sends every distinct key once, packed by key bucket, and gets
the answers back packed in the order it asked: ``ask`` is one shuffle of
requests by bucket, one of answers by block.  A key has one entry per block at
most, so buckets are even however often a key occurs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmodes.llm.tables import keep, partitions
from fieldmodes.llm.words import give_back, hash_strings, slices, split_words

BLOCK_BYTES = 4 << 20  # text of a block: its keys and answers are in a task's memory together
BUCKET_WORDS = 1 << 20


def pack(a: np.ndarray) -> bytes:
    """An array as bytes: planes of the items' bytes, compressed."""
    raw = np.ascontiguousarray(np.frombuffer(a.tobytes(), dtype=np.uint8).reshape(-1, a.dtype.itemsize).T).tobytes() if len(a) else b""
    return len(a).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if len(a) else b"")


def unpack(b: bytes, dtype) -> np.ndarray:
    n, size = int.from_bytes(b[:8], "little"), np.dtype(dtype).itemsize
    if not n:
        return np.zeros(0, dtype=dtype)
    raw = pa.decompress(b[8:], decompressed_size=n * size, codec="zstd", asbytes=True)
    return np.frombuffer(np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(size, n).T).tobytes(), dtype=dtype)


BLOCK_SCHEMA = "block long, doc_ids array<long>, hashes array<long>, counts array<int>, vocab binary, codes binary"


class Block:
    """One block: documents in the order (id, text hash, null ids last) and their words.

    ``ids`` are 64-bit word ids, ``start`` the first word of each document."""

    def __init__(self, row: dict):
        self.block = row["block"]
        self.doc_ids, self.hashes = row["doc_ids"], row["hashes"]
        self.counts = np.array(row["counts"], dtype=np.int64)
        self.vocab = unpack(row["vocab"], np.uint64)
        self.codes = unpack(row["codes"], np.int32)
        self.start = np.cumsum(self.counts) - self.counts
        self.owner = np.repeat(np.arange(len(self.counts)), self.counts)

    @property
    def ids(self) -> np.ndarray:
        return self.vocab[self.codes]


def word_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lower: bool = False,
                block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The blocks of ``docs`` as a kept table.  A document is named by its id and the XXH64 of its text."""
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"),
                       F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))).alias("_hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for k, b in enumerate(slices(batches, "_text", block_bytes)):
            b = pa.Table.from_batches([b]).sort_by([("_id", "ascending"), ("_hash", "ascending")]).combine_chunks().to_batches()[0]
            text = pc.fill_null(b["_text"], "")
            w = split_words(pc.ascii_lower(text) if lower else text)
            yield pa.RecordBatch.from_arrays([
                pa.array([(part << 24) + k], pa.int64()), pa.array([b["_id"].to_pylist()], pa.list_(pa.int64())),
                pa.array([b["_hash"].to_pylist()], pa.list_(pa.int64())), pa.array([w.counts.tolist()], pa.list_(pa.int32())),
                pa.array([pack(hash_strings(w.vocab))], pa.binary()), pa.array([pack(w.codes.astype(np.int32))], pa.binary())],
                names=["block", "doc_ids", "hashes", "counts", "vocab", "codes"])

    return keep(slim.mapInArrow(run, BLOCK_SCHEMA), "word-blocks", bucket_by="block")


def n_buckets(blocks: DataFrame) -> int:
    """Key buckets for the words of ``blocks``: as many as keep a bucket, which a task holds whole, below ``BUCKET_WORDS``
    requests (a block asks for a key once, so requests are at most words, and hashing deals them evenly)."""
    words = blocks.agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n))).first()[0] or 0
    return max(2 * partitions(blocks.sparkSession), -(-words // BUCKET_WORDS))


def by_bucket(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each key, order that sorts by bucket and is stable)."""
    bucket = ((keys >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    return bucket, np.argsort(bucket, kind="stable")


def per_bucket(order: np.ndarray, bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, its keys) in order, from what ``by_bucket`` gave."""
    b = bucket[order]
    edges = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else []
    for k, i in enumerate(edges):
        yield int(b[i]), order[i : edges[k + 1] if k + 1 < len(edges) else len(b)]


def ask(rows: DataFrame, requests: Callable[[dict, int], list[dict]], fields: list[str],
        answer: Callable[..., list[dict]], answers: list[str], name: str, buckets: int, table: DataFrame | None = None) -> DataFrame:
    """One round of questions.  Returns (block, told array<struct<bucket, answers...>>), kept.

    ``requests(row, buckets)`` gives the packed requests of one row of ``rows`` (which has ``block``):
    dicts of ``bucket`` and the binary ``fields``.  ``answer(list)`` gets all requests of one bucket and
    gives one dict of binary ``answers`` for each, in the same order.  With a ``table`` (it has a column
    ``bucket``, see ``by_bucket``) it also gets the table's rows of the bucket."""
    spark = rows.sparkSession
    sent = ["block", "bucket", *fields]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                out = requests(row, buckets)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["block"]] * len(out), pa.int64()), pa.array([r["bucket"] for r in out], pa.int32()),
                     *(pa.array([r[f] for r in out], pa.binary()) for f in fields)], names=sent)
                del row, out
                give_back()

    asked = rows.mapInArrow(send, "block long, bucket int, " + ", ".join(f"{f} binary" for f in fields))

    def reply(got: pa.Table, *known: pa.Table) -> pa.Table:
        out = answer(got.to_pylist(), *known) if got.num_rows else []
        return pa.Table.from_arrays([got["block"], got["bucket"], *(pa.array([r[a] for r in out], pa.binary()) for a in answers)],
                                    names=["block", "bucket", *answers])

    def reply_from(got: pa.Table, known: pa.Table) -> pa.Table:
        return reply(got, known)

    schema = "block long, bucket int, " + ", ".join(f"{a} binary" for a in answers)
    dealt = asked.repartition(partitions(spark), "bucket").groupBy("bucket")
    if table is None:
        told = dealt.applyInArrow(lambda got: reply(got), schema)
    else:
        told = dealt.cogroup(table.groupBy("bucket")).applyInArrow(reply_from, schema)
    return keep(told.groupBy("block").agg(F.collect_list(F.struct("bucket", *answers)).alias("told")), name)
