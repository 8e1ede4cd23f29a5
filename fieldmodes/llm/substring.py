"""Operator 8, substring dedup by recompression.

A word covered by a window of ``window`` consecutive words is removed when the
same word sequence also starts earlier (smaller document id, or the same
document at an earlier word).  Windows are judged on the input.

Recompression names runs and pairs of symbols, level by level.  A name depends
on the content alone (a hash of what it stands for), so all tasks give equal
substrings the same names without exchanging them; at each level a symbol's coin
says whether it opens or closes a pair.  Along with each symbol goes the stretch
of words that decided it.  A symbol decided inside a window is part of every
occurrence of that window, so a window that holds a symbol found once in the
corpus occurs once.  Round one asks which top symbols are shared; round two asks,
for the windows that no unique symbol rules out, whether a 96-bit hash of their
words is seen earlier.  Both rounds go through ``blocks.ask``.

Defined cases: null and empty texts and texts shorter than the window lose
nothing; null ids sort after all others; rows with equal id and text are one
document (each of them keeps or loses the same words); rows with equal id and
different texts are ordered by a text hash; very long texts are words of one
block; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmodes.llm.blocks import Block, ask, by_bucket, n_buckets, pack, per_bucket, unpack, word_blocks
from fieldmodes.llm.tables import keep, packed, unpacked
from fieldmodes.llm.words import give_back, mix64, window_hash

LEVELS = 4
FAR = 1 << 40
NO_ID = (1 << 63) - 1
PAIR = np.uint64(0x9E3779B97F4A7C15)


def recompress(ids: np.ndarray, owner: np.ndarray, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Top-level symbols of documents laid end to end: (name, lo, hi).

    Words lo..hi-1 decide that the symbol is there; they reach over a document's edge if the edge did."""
    n = len(ids)
    sym = mix64(ids)
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = (sym[1:] != sym[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(fresh)
    run = np.diff(np.r_[at, n])
    own, sym = owner[at], sym[at]
    with np.errstate(over="ignore"):
        sym = np.where(run > 1, mix64(sym + PAIR * run.astype(np.uint64), 1), sym)
        lo, hi = at - 1, at + run + 1
        for level in range(levels):
            if not len(sym):
                break
            opens = (mix64(sym, 2 + level) & np.uint64(1)) == 0
            with_next = np.r_[own[1:] == own[:-1], False]
            with_prev = np.r_[False, with_next[:-1]]
            next_sym, next_lo, next_hi = (np.r_[x[1:], x[:1]] for x in (sym, lo, hi))
            prev_lo = np.r_[lo[:1], lo[:-1]]
            pair = opens & with_next & ~np.r_[opens[1:], True]
            # A lone symbol was decided by the neighbour it could have paired with.
            new_hi = np.where(pair, np.maximum(hi, next_hi), np.where(opens, np.where(with_next, np.maximum(hi, next_hi), FAR), hi))
            new_lo = np.where(pair, np.minimum(lo, next_lo), np.where(opens, lo, np.where(with_prev, np.minimum(lo, prev_lo), -FAR)))
            sym = np.where(pair, mix64(sym * PAIR + next_sym, 100 + level), sym)
            stay = ~np.r_[False, pair[:-1]]
            sym, own, lo, hi = sym[stay], own[stay], new_lo[stay], new_hi[stay]
    return sym, lo, hi


def _usable(block: Block, window: int, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sym, lo, hi = recompress(block.ids, block.owner, levels)
    ok = hi - lo <= window
    return sym[ok], lo[ok], hi[ok]


def _window_starts(block: Block, window: int) -> np.ndarray:
    """Which words start a window."""
    return np.arange(len(block.codes)) + window <= (block.start + block.counts)[block.owner]


def _symbol_requests(window: int, levels: int):
    def requests(row: dict, buckets: int) -> list[dict]:
        names, count = np.unique(_usable(Block(row), window, levels)[0], return_counts=True)
        bucket, order = by_bucket(names, buckets)
        return [{"bucket": k, "names": pack(names[i]), "twice": np.packbits(count[i] > 1).tobytes()} for k, i in per_bucket(order, bucket)]
    return requests


def _shared_symbols(got: list[dict]) -> list[dict]:
    names = [unpack(r["names"], np.uint64) for r in got]
    twice = [np.unpackbits(np.frombuffer(r["twice"], np.uint8), count=len(x)) for r, x in zip(got, names)]
    uniq, back, count = np.unique(np.concatenate(names), return_inverse=True, return_counts=True)
    shared = count > 1
    shared |= np.bincount(back, weights=np.concatenate(twice), minlength=len(uniq)) > 0
    out, at = [], 0
    for x in names:
        out.append({"shared": np.packbits(shared[back[at : at + len(x)]]).tobytes()})
        at += len(x)
    return out


def _candidates(row: dict, buckets: int, window: int, levels: int) -> tuple[Block, np.ndarray]:
    """Window starts that no unique symbol rules out; ``row`` has the answers of round one."""
    block = Block(row)
    sym, lo, hi = _usable(block, window, levels)
    names = np.unique(sym)
    shared = np.zeros(len(names), dtype=bool)
    bucket, order = by_bucket(names, buckets)
    told = {t["bucket"]: t["shared"] for t in row["told"] or ()}
    for k, i in per_bucket(order, bucket):
        shared[i] = np.unpackbits(np.frombuffer(told[k], np.uint8), count=len(i)).astype(bool)
    single = ~shared[np.searchsorted(names, sym)]
    n = len(block.codes)
    edge = np.zeros(n + 1, dtype=np.int64)
    first, last = np.maximum(hi[single] - window, 0), lo[single] + 1  # windows that hold the symbol's stretch
    some = first < last
    np.add.at(edge, first[some], 1)
    np.add.at(edge, last[some], -1)
    return block, np.flatnonzero((np.cumsum(edge)[:n] == 0) & _window_starts(block, window))


def _local(block: Block, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct windows among ``starts``: (hash, second hash, earliest start, which one each start is).

    Documents lie in order, so the smallest word index is the earliest start of the block."""
    a = window_hash(block.ids, window)[starts]
    b = (window_hash(block.ids, window, salt=7)[starts] >> np.uint64(32)).astype(np.uint32)
    order = np.lexsort((starts, b, a))
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    which = np.empty(len(order), dtype=np.int64)
    which[order] = np.cumsum(fresh) - 1
    lead = order[fresh]
    return a[lead], b[lead], starts[lead], which


def _window_requests(window: int, levels: int):
    def requests(row: dict, buckets: int) -> list[dict]:
        block, starts = _candidates(row, buckets, window, levels)
        a, b, first, _ = _local(block, starts, window)
        bucket, order = by_bucket(a, buckets)
        ids = np.array([NO_ID if d is None else d for d in block.doc_ids], dtype=np.int64)
        hashes = np.array(block.hashes, dtype=np.int64)
        out = []
        for k, i in per_bucket(order, bucket):
            i = i[np.argsort(first[i], kind="stable")]
            doc = block.owner[first[i]]
            docs, per = np.unique(doc, return_counts=True)
            out.append({"bucket": k, "a": pack(a[i]), "b": pack(b[i]), "place": pack((first[i] - block.start[doc]).astype(np.int32)),
                        "ids": pack(ids[docs]), "hashes": pack(hashes[docs]), "per": pack(per.astype(np.int32))})
        return out
    return requests


def _seen_earlier(got: list[dict]) -> list[dict]:
    a, b, place = (np.concatenate([unpack(r[f], t) for r in got]) for f, t in (("a", np.uint64), ("b", np.uint32), ("place", np.int32)))
    per = np.concatenate([unpack(r["per"], np.int32) for r in got])
    ids, hashes = (np.repeat(np.concatenate([unpack(r[f], np.int64) for r in got]), per) for f in ("ids", "hashes"))
    order = np.lexsort((place, hashes, ids, b, a))
    fresh = np.ones(len(order), dtype=bool)
    sa, sb = a[order], b[order]
    fresh[1:] = (sa[1:] != sa[:-1]) | (sb[1:] != sb[:-1])
    lead = order[fresh][np.cumsum(fresh) - 1]  # the earliest start with the same words
    later = np.empty(len(order), dtype=bool)
    later[order] = (place[order] != place[lead]) | (ids[order] != ids[lead]) | (hashes[order] != hashes[lead])
    out, at = [], 0
    for r in got:
        n = int.from_bytes(r["a"][:8], "little")
        out.append({"later": np.packbits(later[at : at + n]).tobytes()})
        at += n
    return out


def _removed(row: dict, buckets: int, window: int, levels: int) -> tuple[Block, np.ndarray]:
    """Which words of the block go; ``row`` has the answers of both rounds."""
    block, starts = _candidates(row, buckets, window, levels)
    a, _, first, which = _local(block, starts, window)
    later = np.zeros(len(a), dtype=bool)
    bucket, order = by_bucket(a, buckets)
    told = {t["bucket"]: t["later"] for t in row["told2"] or ()}
    for k, i in per_bucket(order, bucket):
        i = i[np.argsort(first[i], kind="stable")]
        later[i] = np.unpackbits(np.frombuffer(told[k], np.uint8), count=len(i)).astype(bool)
    # A start is a repeat if its words are seen earlier elsewhere, or earlier in this block
    # (a repeated row is the same document: its starts are the first ones again).
    lead = first[which]
    here, there = block.owner[starts], block.owner[lead]
    ids = np.array([NO_ID if d is None else d for d in block.doc_ids], dtype=np.int64)
    hashes = np.array(block.hashes, dtype=np.int64)
    same = (ids[here] == ids[there]) & (hashes[here] == hashes[there]) & (starts - block.start[here] == lead - block.start[there])
    hit = starts[later[which] | ~same] if len(starts) else starts
    edge = np.zeros(len(block.codes) + 1, dtype=np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + window, -1)
    return block, np.cumsum(edge[:-1]) > 0


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20,
                   levels: int = LEVELS) -> DataFrame:
    """(doc_id, text_hash, spans): word ranges [from, to) to remove, flat, for documents that lose words."""
    blocks = word_blocks(docs, id_col, text_col)
    buckets = n_buckets(blocks)
    shared = ask(blocks, _symbol_requests(window, levels), ["names", "twice"], _shared_symbols, ["shared"], "shared-symbols", buckets)
    told = blocks.join(shared, "block", "left")
    earlier = ask(told, _window_requests(window, levels), ["a", "b", "place", "ids", "hashes", "per"], _seen_earlier, ["later"], "seen-windows", buckets)

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                block, gone = _removed(batch.slice(r, 1).to_pylist()[0], buckets, window, levels)
                step = np.diff(np.r_[False, gone, False].astype(np.int8))
                inner = np.flatnonzero(gone[1:] & gone[:-1] & (block.owner[1:] != block.owner[:-1])) + 1  # spans end with their document
                begin, end = np.r_[np.flatnonzero(step == 1), inner], np.r_[np.flatnonzero(step == -1), inner]
                begin.sort()
                end.sort()
                own = block.owner[begin]
                docs_hit, at = np.unique(own, return_index=True)
                flat = np.stack([begin, end], axis=1) - block.start[own][:, None]
                parts = np.split(flat, at[1:]) if len(at) else []
                yield pa.RecordBatch.from_arrays([
                    pa.array([block.doc_ids[i] for i in docs_hit], pa.int64()), pa.array([block.hashes[i] for i in docs_hit], pa.int64()),
                    pa.array([p.reshape(-1).tolist() for p in parts], pa.list_(pa.int32()))], names=["doc_id", "text_hash", "spans"])
                del block, gone, parts
                give_back()

    found = told.join(earlier.withColumnRenamed("told", "told2"), "block", "left").mapInArrow(
        spans, "doc_id long, text_hash long, spans array<int>")
    return keep(found.groupBy("doc_id", "text_hash").agg(F.first("spans").alias("spans")), "repeated-spans")


WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _without(text: str, spans: list[int]) -> str:
    """The text without the words of the spans and the white space before them."""
    data = text.encode()
    ends = [0, *(m.end() for m in WORD.finditer(data))]
    out, at = [], 0
    for a, b in zip(spans[::2], spans[1::2]):
        out.append(data[at : ends[a]])
        at = ends[b]
    out.append(data[at:])
    return b"".join(out).decode()


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20,
                    levels: int = LEVELS, count_col: str = "_n_removed") -> DataFrame:
    """``docs`` with the repeated words cut out of the text, plus ``count_col`` (bigint), in place of a column of that name.

    Texts that lose nothing are unchanged."""
    spans = repeated_spans(docs, id_col, text_col, window, levels)
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(packed(docs, text_col), text.alias("text"), F.col(f"`{id_col}`").cast("long").alias("id"),
                       F.xxhash64(F.coalesce(text, F.lit(""))).alias("hash"))
    both = rows.join(spans.hint("merge"), F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash")), "left")
    n_removed = F.coalesce(F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0),
                                       lambda s, x: s + x), F.lit(0)).cast("long")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gone = b["spans"]
            if gone.null_count < b.num_rows:
                new = pa.array([t if s is None else _without(t, s) for t, s in zip(b["text"].to_pylist(), gone.to_pylist())], pa.string())
                b = b.set_column(b.schema.get_field_index("text"), "text", new)
            yield b.drop_columns(["spans"])

    slim = both.select("row", "text", n_removed.alias("n"), "spans")
    out = slim.mapInArrow(cut, slim.drop("spans").schema)
    return out.select(*unpacked(docs, text_col, "text", (count_col,)), F.col("n").alias(count_col))
