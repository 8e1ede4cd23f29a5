"""Operator 10, SimHash near-duplicates by pigeonhole blocks.

Fingerprint: 64-bit majority vote over the XXH64 of word shingles.  Two
fingerprints are linked when at most ``max_bits`` bits differ.  The 64 bits are
cut into ``max_bits + shared`` blocks; a linked pair differs in at most
``max_bits`` blocks, so it agrees on at least ``shared`` of them.  Every choice
of ``shared`` blocks gives a join key, and rows that meet under a key are
verified by Hamming distance.

Exact copies collapse first (one row per distinct fingerprint).  Keys are
counted first: rows of a key with more than ``HOT`` rows are dealt by a further
pigeonhole level, the bits outside the key in ``max_bits + 1`` blocks, of which
a linked pair agrees on at least one, and rows that still share a key with more
than ``FURTHER`` rows by another, until all groups are bounded.  (Families of
linked rows are cheap inside a group and would multiply with every level, so the
bound of the further levels is the larger one.)  Under a key only a spanning forest of the
links leaves the task, never all pairs, and rows that are linked already are
not compared with one another in groups above ``LARGE``; links are joined into
components by alternating large-star / small-star rounds, each written to the
shared folder.

Defined cases: null and empty texts have fingerprint zero and link to each
other; a text shorter than the shingle is one shingle; repeated rows are linked
to themselves; a row with a null id takes part in linking but never names a component: where all ids
of a component are null, so is the component id.  Ids lie below 2^62.  An empty
table gives no rows, very long texts are hashed whole, other columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmodes.llm.tables import free_name, keep, partitions
from fieldmodes.llm.words import as_text, slices, split_words

SEED = 42
NAMELESS = 1 << 62  # nodes from here on stand for fingerprints without any id
VOTE_ROWS = 1 << 15
HOT = 4096  # rows of a key that one group may hold before it is split
FURTHER = 1 << 18  # the same for a key of the second level on
LARGE = 256  # rows of a group from which on its links are searched from the linked rows outward
CELLS = 1 << 16  # comparisons at a time


def _fingerprints(texts: pa.Array, width: int) -> np.ndarray:
    w = split_words(pc.ascii_lower(as_text(texts)))
    n = len(w.counts)
    out = np.zeros(n, dtype=np.uint64)
    if not len(w.codes):
        return out
    # All words of the batch in one buffer, one space after each: a shingle is a byte range.
    buf = memoryview(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(w.codes)], pa.int32()),
                                                            w.vocab.take(pa.array(w.codes))), " ").cast(pa.binary())[0].as_buffer())
    length = pc.binary_length(w.vocab).to_numpy(zero_copy_only=False).astype(np.int64)[w.codes]
    end = np.cumsum(length + 1) - 1
    start = end - length
    shingles = np.where(w.counts > 0, np.maximum(w.counts - width + 1, 1), 0)
    doc = np.repeat(np.arange(n), shingles)
    first = w.offsets[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    last = np.minimum(first + width, w.offsets[doc + 1]) - 1
    h = xxhash.xxh64_intdigest
    votes = np.zeros((n, 64), dtype=np.int64)
    for lo in range(0, len(doc), VOTE_ROWS):
        part = slice(lo, lo + VOTE_ROWS)
        hashes = np.array([h(buf[a:b], SEED) for a, b in zip(start[first[part]].tolist(), end[last[part]].tolist())], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = doc[part]
        at = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        votes[own[at]] += np.add.reduceat(bits, at, axis=0, dtype=np.int64)
    ones = (2 * votes > shingles[:, None]).astype(np.uint8)
    return np.packbits(ones, axis=1, bitorder="little").view("<u8").reshape(-1)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(id, text_hash, fp) of each row; the 64-bit fingerprint as a signed long."""
    text = F.col(f"`{text_col}`").cast("string")
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            fp = _fingerprints(b.column("text"), width).view(np.int64)
            yield pa.RecordBatch.from_arrays([b["id"], b["text_hash"], pa.array(fp)], names=["id", "text_hash", "fp"])

    return slim.mapInArrow(run, "id long, text_hash long, fp long")


def block_masks(max_bits: int, shared: int) -> list[int]:
    """Bit masks of every choice of ``shared`` out of ``max_bits + shared`` blocks (signed 64-bit)."""
    blocks = np.array_split(np.arange(64), max_bits + shared)
    masks = [sum(1 << int(b) for blk in pick for b in blk) for pick in combinations(blocks, shared)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def second_masks(mask: int, max_bits: int) -> list[int]:
    """``mask`` with each of ``max_bits + 1`` blocks of the bits outside it (signed 64-bit)."""
    free = [b for b in range(64) if not mask >> b & 1]
    masks = [mask | sum(1 << int(b) for b in blk) for blk in np.array_split(free, max_bits + 1)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def _grow(fp: np.ndarray, node: np.ndarray, max_bits: int) -> tuple[list, list]:
    """Spanning forest of the links of one group: each row is compared with the rows not reached yet."""
    us, vs = [], []
    queue = np.empty(len(fp), dtype=np.int64)
    left = np.arange(len(fp))
    head = tail = 0
    while len(left):
        if head == tail:
            queue[tail], left = left[0], left[1:]
            tail += 1
        a = queue[head : min(tail, head + max(1, CELLS // max(len(left), 1)))]
        head += len(a)
        close = np.bitwise_count(fp[a][:, None] ^ fp[left][None, :]) <= max_bits
        hit = close.any(axis=0)
        new = left[hit]
        us.extend(node[a[close[:, hit].argmax(axis=0)]].tolist())
        vs.extend(node[new].tolist())
        queue[tail : tail + len(new)] = new
        tail += len(new)
        left = left[~hit]
    return us, vs


def _forest(fp: np.ndarray, node: np.ndarray, group: np.ndarray, max_bits: int) -> tuple[list, list]:
    """Spanning forest of the links inside each run of equal ``group`` (rows are sorted by it)."""
    edges = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[edges, len(group)])
    large = size > LARGE
    us, vs = [], []
    for at, n in zip(edges[large].tolist(), size[large].tolist()):
        u, v = _grow(fp[at : at + n], node[at : at + n], max_bits)
        us += u
        vs += v
    small = np.repeat(~large, size)
    u, v = _small_forests(fp[small], node[small], group[small], max_bits)
    return us + u, vs + v


def _small_forests(fp: np.ndarray, node: np.ndarray, group: np.ndarray, max_bits: int) -> tuple[list, list]:
    """All groups at a time: rows 1, 2, ... places apart are compared."""
    n = len(fp)
    label = np.arange(n)
    us, vs = [], []
    alive = np.arange(n - 1)
    step = 1
    while len(alive):
        alive = alive[alive + step < n]
        alive = alive[group[alive] == group[alive + step]]
        if not len(alive):
            break
        i, j = alive, alive + step
        i = i[(close := (np.bitwise_count(fp[i] ^ fp[j]) <= max_bits) & (label[i] != label[j]))]
        j = j[close]
        for a, b in zip(i.tolist(), j.tolist()):
            while label[a] != a:
                label[a] = label[label[a]]
                a = label[a]
            while label[b] != b:
                label[b] = label[label[b]]
                b = label[b]
            if a != b:
                label[max(a, b)] = min(a, b)
                us.append(node[a])
                vs.append(node[b])
        if len(i):  # flatten, so that linked rows are skipped from now on
            while (up := label[label])[...].tobytes() != label.tobytes():
                label = up
        step += 1
    return us, vs


def keyed(reps: DataFrame, max_bits: int = 4, shared: int = 2) -> DataFrame:
    """(fp, node, mask, key): every row under its keys, and under those of further levels where a key is hot."""
    spark = reps.sparkSession
    masks = block_masks(max_bits, shared)
    rows = reps.select("fp", "node", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("mask"))
    rows = rows.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
    done: list[DataFrame] = []
    while True:
        crowded = keep(rows.groupBy("mask", "key").agg(F.count("*").alias("n")).where(F.col("n") > (FURTHER if done else HOT)).select("mask", "key"), "simhash-hot")
        masks = [r[0] for r in crowded.select("mask").distinct().collect()]  # of 64 bits: at most 15 at first, 5 times as many a level
        masks = [m for m in masks if 64 - bin(m & 0xFFFFFFFFFFFFFFFF).count("1") > max_bits]
        if not masks:
            done.append(rows)
            return reduce(DataFrame.unionByName, done)
        finer = spark.createDataFrame([(m, x) for m in masks for x in second_masks(m, max_bits)], "mask long, finer long")
        crowded = crowded.join(F.broadcast(finer.select("mask").distinct()), "mask", "left_semi")
        done.append(rows.join(crowded, ["mask", "key"], "left_anti"))
        rows = (keep(rows.join(crowded, ["mask", "key"], "left_semi"), "simhash-keys").join(F.broadcast(finer), "mask").select("fp", "node", F.col("finer").alias("mask"))
                .withColumn("key", F.col("fp").bitwiseAND(F.col("mask"))))


def links(reps: DataFrame, max_bits: int = 4, shared: int = 2) -> DataFrame:
    """(u, v): edges whose components are those of all pairs within ``max_bits``.

    ``reps`` has one row (fp, node) per distinct fingerprint."""
    spark = reps.sparkSession
    dealt = keyed(reps, max_bits, shared).repartition(partitions(spark), "mask", "key").sortWithinPartitions("mask", "key", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: list[pa.RecordBatch] = []  # rows of one key

        def solve(b: pa.RecordBatch) -> pa.RecordBatch:
            mask, key = b["mask"].to_numpy(), b["key"].to_numpy()
            group = np.cumsum(np.r_[False, (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])])
            us, vs = _forest(b["fp"].to_numpy().view(np.uint64), b["node"].to_numpy(), group, max_bits)
            return pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

        for b in batches:
            if not b.num_rows:
                continue
            mask, key = b["mask"].to_numpy(), b["key"].to_numpy()
            if carry and (mask[-1], key[-1]) == (carry[0]["mask"][0].as_py(), carry[0]["key"][0].as_py()):
                carry.append(b)
                continue
            at = int(np.flatnonzero((mask != mask[-1]) | (key != key[-1]))[-1]) + 1 if (mask[0], key[0]) != (mask[-1], key[-1]) else 0
            done = [*carry, b.slice(0, at)]
            if sum(x.num_rows for x in done):
                yield solve(pa.Table.from_batches(done).combine_chunks().to_batches()[0])
            carry = [b.slice(at)]
        if carry:
            yield solve(pa.Table.from_batches(carry).combine_chunks().to_batches()[0])

    return dealt.mapInArrow(run, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): smallest node reachable, for every node that has an edge.

    Alternating star rounds: each keeps connectivity and shortens paths, so the
    number of rounds is logarithmic in practice; the loop ends when a round
    changes nothing."""
    e = keep(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc-edges")
    last = None
    while True:
        # large star: every larger neighbour of u goes to the smallest neighbour of u
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = keep(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "cc-low")
        large = keep(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                     .where("u <> v").distinct(), "cc-large")
        # small star: the smaller neighbours of u go to the smallest of them
        low = keep(large.groupBy("u").agg(F.min("v").alias("m")), "cc-low")
        e = keep(large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "cc-edges")
        state = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1000003)).first()
        if state == last:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        last = state


def _classes(fps: DataFrame, max_bits: int, shared: int) -> DataFrame:
    """(fp, node): the node that names the component of each distinct fingerprint (from ``NAMELESS`` on: no id in it)."""
    nameless = F.lit(NAMELESS) + F.pmod(F.xxhash64("fp"), F.lit(1 << 61))
    reps = keep(fps.groupBy("fp").agg(F.min("id").alias("node")).withColumn("node", F.coalesce("node", nameless)), "simhash-reps")
    comp = components(links(reps, max_bits, shared))
    return keep(reps.join(comp, "node", "left").select("fp", F.coalesce("component", "node").alias("node")), "simhash-components")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4,
                       max_bits: int = 4, shared: int = 2) -> DataFrame:
    """(id, text_hash, fp, component_id) for every row of ``docs``; ids are integers."""
    fps = keep(fingerprints(docs, id_col, text_col, width), "simhash-fp")
    named = F.when(F.col("node") < NAMELESS, F.col("node")).alias("component_id")
    return fps.join(_classes(fps, max_bits, shared), "fp").select("id", "text_hash", "fp", named)


def keep_one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4,
                           max_bits: int = 4, shared: int = 2) -> DataFrame:
    """One row of each component stays: the smallest id (null last), then the smallest text hash, then any one of the
    rows that repeat both (the one with the smallest hash of its columns)."""
    fps = keep(fingerprints(docs, id_col, text_col, width), "simhash-fp")
    comp = fps.join(_classes(fps, max_bits, shared), "fp").select("id", "text_hash", "node")
    first = F.struct(F.col("id").isNull().alias("last"), "id", "text_hash")
    counted = comp.groupBy("node", "id", "text_hash").agg(F.count("*").alias("n"))  # copies of a row are counted per task
    one = keep(counted.groupBy("node").agg(F.min(first).alias("one")), "simhash-kept")
    rows = keep(counted.join(one, "node").select("id", "text_hash", "n", ((F.col("one.text_hash") == F.col("text_hash"))
                                                                         & F.col("one.id").eqNullSafe(F.col("id"))).alias("stays")), "simhash-verdicts")
    id_, hash_ = F.col(f"`{id_col}`").cast("long"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    left = docs.join(rows.where("NOT stays").select("id", "text_hash").transform(_keys), _same(id_, hash_), "left_anti")
    again = rows.where("stays AND n > 1").select("id", "text_hash").transform(_keys)
    if again.isEmpty():
        return left
    place = Window.partitionBy(id_, hash_).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t]))
    number = free_name(docs, "n")
    alone = left.join(again, _same(id_, hash_), "left_semi").withColumn(number, F.row_number().over(place)).where(F.col(number) == 1).drop(number)
    return left.join(again, _same(id_, hash_), "left_anti").unionByName(alone)


def _keys(rows: DataFrame) -> DataFrame:
    """One struct column, which clashes with no document column but its own name."""
    return rows.select(F.struct("id", "text_hash").alias("simhash key"))


def _same(id_: Column, hash_: Column) -> Column:
    return id_.eqNullSafe(F.col("`simhash key`.id")) & (hash_ == F.col("`simhash key`.text_hash"))
