"""Operator 12, cross-tokenizer alignment by merge-path partitioning.

Both tokenizers cut the bytes of ``space + text`` into tokens.  Merging the ends
of A's tokens with the ends of B's walks through every pair of tokens that
overlap: a step of the merge that moves forward in the text lies in exactly one
token of each side, and a place where both sides end closes a group.

Merge path: the merge of n + m ends is a staircase through the n x m grid.  A
binary search on every ``PIECE``-th diagonal finds where the staircase crosses
it, which cuts the merge into independent pieces of equal work whatever the
lengths of texts and tokens.  All pieces of a block advance in step and emit the
overlaps of their stretch; what a piece starts inside of is stitched to its left
neighbour by a running sum of the groups closed before it.

A block is about ``BLOCK_BYTES`` of text in one row of a kept table, with its
distinct id pairs and the pair of every link.  Pair counts are a Spark
aggregate over the blocks' distinct pairs; the totals go back to the blocks by
a join, one row per block and distinct pair, so a frequent pair weighs no more
than a rare one.

Tokenizers run once per distinct atom of a worker: texts are cut where a single
space stands between two other characters, which no token of either side
crosses (A starts a new pre-token at such a space; B is cut there only if none
of its pieces holds the space after another character).  Texts above
``SPLIT_CHARS`` are cut into rows at such places and worked on by several tasks.

Defined cases: null and empty texts, and texts whose tokens do not spell them
byte for byte (the escape character U+2581 does that), have no tokens: zeros and
empty groups, and they add nothing to the pair counts.  Repeated rows are
aligned and counted row by row; null ids stay null; an empty table gives no
rows; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmodes.llm.blocks import pack, unpack
from fieldmodes.llm.tables import keep, partitions
from fieldmodes.llm.words import give_back, slices

MODEL_A = "/opt/tokenizers/byte_bpe_50k.json"
MODEL_B = "/opt/tokenizers/piece_bpe_32k.model"
ESCAPE = "▁"
PIECE = 512  # merge steps of a piece
BLOCK_BYTES = 2 << 20
SPLIT_CHARS = 1 << 20
CACHE_ATOMS, CACHE_CHARS = 200_000, 4 << 20  # atoms a worker remembers
CLEAN = re.compile(r"(?<=\S) (?=\S)")
COMMA, BAR, SEMICOLON, NOTHING = range(4)
SEPARATORS = (",", "|", ";", "")


def byte_alphabet() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the other bytes for U+0100 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def merge_path(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Merge of two ascending arrays of ends that cover the same bytes, by independent pieces.

    Step t of the merge passes the next end, A's before B's where they are equal.  Returns for every step
    the tokens (i, j) it lies in, whether it moves forward (then i and j overlap) and whether both sides end there."""
    n, m = len(a), len(b)
    diag = np.arange(0, n + m, piece)
    lo, hi = np.maximum(diag - m, 0), np.minimum(diag, n)
    while (open_ := lo < hi).any():  # how many of A's ends come before the diagonal
        mid = (lo + hi) // 2
        right = open_ & (a[np.minimum(mid, n - 1)] <= b[np.clip(diag - 1 - mid, 0, m - 1)])
        lo, hi = np.where(right, mid + 1, lo), np.where(open_ & ~right, mid, hi)
    i, j = lo, diag - lo
    a_, b_ = np.r_[a, np.iinfo(np.int64).max], np.r_[b, np.iinfo(np.int64).max]
    at = np.maximum(np.where(i > 0, a_[i - 1], 0), np.where(j > 0, b_[j - 1], 0))
    width = min(piece, n + m)
    si, sj = np.zeros((2, len(diag), width), dtype=np.int32)
    ahead, close = np.zeros((2, len(diag), width), dtype=bool)
    for t in range(width):
        ea, eb = a_[i], b_[j]
        first = ea <= eb
        end = np.where(first, ea, eb)
        si[:, t], sj[:, t] = i, j
        ahead[:, t] = end > at
        close[:, t] = ~first & (end == at)  # A ended here a step ago
        at = end
        i, j = np.minimum(i + first, n), np.minimum(j + ~first, m)
    return tuple(x.reshape(-1)[: n + m] for x in (si, sj, ahead, close))


class Pair:
    """Both tokenizers and the atoms a worker has met; one per Python worker."""

    def __init__(self, raw_a: bytes, raw_b: bytes):
        self.a = tokenizers.Tokenizer.from_str(raw_a.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=raw_b)
        alphabet = byte_alphabet()
        vocab = json.loads(raw_a)["model"]["vocab"]
        bytes_a = [b""] * (max([*vocab.values(), self.a.get_vocab_size()]) + 1)
        for token, i in vocab.items():
            if all(c in alphabet for c in token):
                bytes_a[i] = bytes(alphabet[c] for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(ESCAPE, " ").encode() for i, p in enumerate(pieces)]
        self.bytes_a, self.bytes_b = pa.array(bytes_a, pa.large_binary()), pa.array(bytes_b, pa.large_binary())
        self.size_a, self.size_b = (pc.binary_length(x).to_numpy().astype(np.int64) for x in (self.bytes_a, self.bytes_b))
        self.cuts = not any(y == ESCAPE and x != ESCAPE for p in pieces for x, y in zip(p, p[1:]))
        #: whatever the text, bytes stand for characters without a piece, so a part is spelt if it has no escape character
        self.splits = self.cuts and sum(self.b.is_byte(i) for i in range(len(pieces))) == 256
        self.most = max(len(bytes_a), len(bytes_b))
        self.words = pa.array([str(i) + s for s in SEPARATORS for i in range(self.most)], pa.large_binary())
        self.word_size = pc.binary_length(self.words).to_numpy().astype(np.int64)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.chars = 0
        self.ok = np.zeros(0, dtype=bool)
        self.offs = [np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)]
        self.ids = [np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int32)]

    def atoms(self, text: str) -> list[str]:
        return CLEAN.split(text) if self.cuts else [text]

    def _learn(self, new: list[str]) -> None:
        got_a = [e.ids for e in self.a.encode_batch([" " + x for x in new], add_special_tokens=False)]
        got_b = self.b.encode(new, num_threads=1)
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        self.chars += sum(map(len, new))
        spelt, ok = pa.array([" " + x for x in new], pa.large_string()).cast(pa.large_binary()), np.ones(len(new), dtype=bool)
        size, text = pc.binary_length(spelt).to_numpy().astype(np.int64), spelt.buffers()[2]
        for side, (got, words, sizes) in enumerate(((got_a, self.bytes_a, self.size_a), (got_b, self.bytes_b, self.size_b))):
            ids = np.fromiter(chain.from_iterable(got), dtype=np.int32)
            ends = np.cumsum(np.fromiter(map(len, got), dtype=np.int64, count=len(got)))
            same = np.diff(np.r_[0, np.r_[0, np.cumsum(sizes[ids])][ends]]) == size
            if not same.all() or not words.take(pa.array(ids)).buffers()[2].equals(text):
                joined = words.to_pylist()
                same = np.array([b"".join(joined[i] for i in x) == y for x, y in zip(got, spelt.to_pylist())], dtype=bool)
            ok &= same
            self.offs[side] = np.r_[self.offs[side], self.offs[side][-1] + ends]
            self.ids[side] = np.r_[self.ids[side], ids]
        self.ok = np.r_[self.ok, ok]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(tokens per text, ids) of A and of B; a text that is not spelt byte for byte has none."""
        if len(self.known) > CACHE_ATOMS or self.chars > CACHE_CHARS:
            self._forget()
        cut = [self.atoms(x) if x else [] for x in texts]
        per_text = np.array([len(c) for c in cut], dtype=np.int64)
        flat = [x for c in cut for x in c]
        if new := [x for x in dict.fromkeys(flat) if x not in self.known]:
            self._learn(new)
        code = np.fromiter(map(self.known.__getitem__, flat), dtype=np.int64, count=len(flat))
        owner = np.repeat(np.arange(len(texts)), per_text)
        bad = np.zeros(len(texts), dtype=bool)
        bad[owner[~self.ok[code]]] = True
        code, owner = code[~bad[owner]], owner[~bad[owner]]
        out = []
        for offs, ids in zip(self.offs, self.ids):
            width = offs[code + 1] - offs[code]
            ends = np.cumsum(width)
            take = np.repeat(offs[code] - ends + width, width) + np.arange(ends[-1] if len(ends) else 0)
            out.append((np.bincount(owner, weights=width, minlength=len(texts)).astype(np.int64), ids[take]))
        return out

    def align(self, texts: list[str]) -> dict:
        """Everything about a block's texts: token, group and link counts, links as places in the
        distinct id pairs, and the groups of each text as bytes (``offs``, ``buffer``)."""
        (per_a, a), (per_b, b) = self.encode(texts)
        n = len(texts)
        si, sj, ahead, close = merge_path(np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b]))
        owner_a = np.repeat(np.arange(n), per_a)
        at = np.flatnonzero(ahead)
        link_a, link_b = si[at], sj[at]
        keys = a[link_a].astype(np.int64) << 32 | b[link_b]
        d = pa.array(keys).dictionary_encode()
        codes, pairs = d.indices.to_numpy().astype(np.int32), d.dictionary.to_numpy()
        links = np.bincount(owner_a[link_a], minlength=n)

        # Groups: a closing step ends at token i - 1 of A and j of B.
        stop = np.flatnonzero(close)
        end_a, end_b = si[stop].astype(np.int64), sj[stop].astype(np.int64) + 1  # tokens up to and with each group
        del si, sj, ahead, close, at, link_a, link_b, keys, d
        group_a = np.repeat(np.arange(len(stop)), np.diff(np.r_[0, end_a]))
        group_b = np.repeat(np.arange(len(stop)), np.diff(np.r_[0, end_b]))
        sep = np.full(len(a) + len(b), COMMA, dtype=np.int64)
        place_a = np.arange(len(a)) + np.r_[0, end_b][group_a]
        place_b = np.arange(len(b)) + end_a[group_b]
        sep[place_a[end_a - 1]] = BAR
        sep[place_b[end_b - 1]] = SEMICOLON
        closes = np.cumsum(per_b)[per_b > 0] - 1  # last tokens of texts
        sep[place_b[closes]] = NOTHING
        word = sep * self.most
        word[place_a] += a
        word[place_b] += b
        del sep, place_a, place_b, group_a, group_b
        offs = np.r_[0, np.cumsum(self.word_size[word])][np.r_[0, np.cumsum(per_a + per_b)]]
        shown = self.words.take(pa.array(word)).buffers()[2]  # the words one after another
        return {"n_a": per_a, "n_b": per_b, "n_groups": np.bincount(owner_a[end_a - 1], minlength=n),
                "n_links": links, "codes": codes, "pairs": pairs,
                "n": np.bincount(codes, minlength=len(pairs)), "offs": offs, "buffer": memoryview(shown or b"")}


@functools.lru_cache(maxsize=2)
def _pair(raw_a: bytes, raw_b: bytes) -> Pair:
    return Pair(raw_a, raw_b)


PER_DOC = ("n_a", "n_b", "n_groups", "n_links")
_BLOCK_SCHEMA = ("block long, uid array<long>, part array<long>, " + ", ".join(f"{c} array<long>" for c in PER_DOC)
                 + ", groups array<string>, codes binary, a array<int>, b array<int>, n array<long>")


def align(docs: DataFrame, model_a: str = MODEL_A, model_b: str = MODEL_B, id_col: str = "doc_id", text_col: str = "text",
          digest: bool = False, split_chars: int = SPLIT_CHARS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: (id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups).

    ``groups`` reads ``a1,a2|b1;a3|b2,b3``: the ids of A and B in each group; with ``digest`` its SHA-256 in
    its place ('' without tokens).  A pair's count is the number of links in ``docs`` that hold it; ``count_sum``
    adds it over the links, ``n_best`` counts the links whose count is the highest of their B id.

    The model files are read on the driver (they have a fixed size) and sent to the tasks."""
    spark = docs.sparkSession
    with open(model_a, "rb") as fa, open(model_b, "rb") as fb:
        raw = spark.sparkContext.broadcast((fa.read(), fb.read()))
    splits = Pair(*raw.value).splits
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("uid"), F.when(text.contains(ESCAPE), "").otherwise(text).alias("text"))
    whole = rows.where(F.length("text") <= split_chars) if splits else rows
    whole = whole.select("uid", F.lit(0).cast("long").alias("part"), "text")

    def table(parts: DataFrame, digest: bool, name: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            task = TaskContext.get().partitionId()
            for k, b in enumerate(slices(batches, "text", block_bytes)):
                got = _pair(*raw.value).align(b["text"].to_pylist())
                cut = list(zip(got["offs"].tolist(), got["offs"][1:].tolist()))
                buf = got["buffer"]
                groups = [(hashlib.sha256(buf[x:y]).hexdigest() if digest else bytes(buf[x:y]).decode()) if y > x else "" for x, y in cut]
                one = lambda x, t: pa.array([x], pa.list_(t))
                yield pa.RecordBatch.from_arrays([
                    pa.array([(task << 24) + k], pa.int64()), one(b["uid"].to_pylist(), pa.int64()), one(b["part"].to_pylist(), pa.int64()),
                    *(one(got[c], pa.int64()) for c in PER_DOC), one(groups, pa.string()), pa.array([pack(got["codes"])], pa.binary()),
                    one((got["pairs"] >> 32).astype(np.int32), pa.int32()), one((got["pairs"] & 0xFFFFFFFF).astype(np.int32), pa.int32()),
                    one(got["n"], pa.int64())], schema=arrow_schema)
                del got, buf
                give_back()

        arrow_schema = pa.schema([("block", pa.int64()), ("uid", pa.list_(pa.int64())), ("part", pa.list_(pa.int64())),
                                  *((c, pa.list_(pa.int64())) for c in PER_DOC), ("groups", pa.list_(pa.string())), ("codes", pa.binary()),
                                  ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32())), ("n", pa.list_(pa.int64()))])
        return keep(parts.mapInArrow(run, _BLOCK_SCHEMA), name)

    blocks = table(whole, digest, "align-blocks").withColumn("giant", F.lit(False))
    if splits:
        # Giant texts: numbered once in a written table, then cut at clean places into rows of their own.
        giants = keep(rows.where(F.length("text") > split_chars).withColumn("no", F.monotonically_increasing_id()), "align-giants")

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for no, text in zip(b["no"].to_pylist(), b["text"].to_pylist()):
                    edges, last = [0], 0
                    for m in CLEAN.finditer(text):  # a part ends before a space, the next starts after it
                        if m.start() - last > split_chars:
                            edges.append(last := m.end())
                    parts = [text[x : y - 1] for x, y in zip(edges, edges[1:])] + [text[edges[-1] :]]
                    for k, part in enumerate(parts):
                        yield pa.RecordBatch.from_arrays([pa.array([no], pa.int64()), pa.array([k], pa.int64()), pa.array([part], pa.string())],
                                                         names=["uid", "part", "text"])

        parts = giants.select("no", "text").mapInArrow(cut, "uid long, part long, text string").repartition(partitions(spark), "uid", "part")
        blocks = blocks.unionByName(table(parts, False, "align-parts").withColumn("giant", F.lit(True))
                                    .withColumn("block", -1 - F.col("block")))

    flat = blocks.select("block", F.posexplode(F.arrays_zip("a", "b", "n")).alias("at", "x")).select("block", "at", "x.a", "x.b", "x.n")
    count = keep(flat.groupBy("a", "b").agg(F.sum("n").alias("count")), "align-counts")
    best = count.groupBy("b").agg(F.max("count").alias("most"))
    count = count.join(best, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))
    told = (flat.drop("n").join(count, ["a", "b"]).groupBy("block")  # one row per distinct pair of a block
            .agg(F.array_sort(F.collect_list(F.struct("at", "count", "best"))).alias("told")))
    asked = blocks.select("block", "giant", "uid", "part", *PER_DOC, "groups", "codes").join(
        told.select("block", F.col("told.count").alias("count"), F.col("told.best").alias("best")), "block", "left")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(i, 1) for b in batches for i in range(b.num_rows)):
            per = b["n_links"].values[b["n_links"].offsets[0].as_py() : b["n_links"].offsets[1].as_py()].to_numpy()
            codes = unpack(b["codes"][0].as_py(), np.int32)
            first = np.cumsum(per) - per
            total, most = np.zeros(len(per), dtype=np.int64), np.zeros(len(per), dtype=np.int64)
            if len(codes):
                full = per > 0
                total[full] = np.add.reduceat(b["count"][0].values.to_numpy()[codes], first[full])
                most[full] = np.add.reduceat(b["best"][0].values.to_numpy(zero_copy_only=False)[codes].astype(np.int64), first[full])
            size = len(per)
            yield pa.RecordBatch.from_arrays([
                pa.array([b["giant"][0].as_py()] * size, pa.bool_()), b["uid"].flatten(), b["part"].flatten(), *(b[c].flatten() for c in PER_DOC),
                pa.array(most), pa.array(total), b["groups"].flatten()], names=["giant", "uid", "part", *PER_DOC, "n_best", "count_sum", "groups"])

    sums = (*PER_DOC, "n_best", "count_sum")
    out = asked.mapInArrow(finish, "giant boolean, uid long, part long, " + ", ".join(f"{c} long" for c in sums) + ", groups string")
    if not splits:
        return out.select(F.col("uid").alias("id"), *sums, "groups")
    out = keep(out, "align-rows")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "groups"))), lambda x: x["groups"]), ";")
    long = out.where("giant").groupBy("uid").agg(*[F.sum(c).alias(c) for c in sums], joined.alias("groups")).withColumnRenamed("uid", "no")
    long = long.join(giants.select("no", "uid"), "no").withColumn("groups", F.sha2("groups", 256) if digest else F.col("groups"))
    return out.where("NOT giant").select(F.col("uid").alias("id"), *sums, "groups").unionByName(long.select(F.col("uid").alias("id"), *sums, "groups"))
