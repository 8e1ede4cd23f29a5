"""Operator 11, source divergence audit with duplicate-text collapse.

How far is the word use of each source from that of the other sources, and of
the whole, of its language?  Equal texts of a language are one row with the
number of copies in each source; every text is tokenized once and its counts
and document frequencies are added with those weights.  Texts that are copied a
thousand times cost one tokenization, and a partial aggregate takes the copies
of a task out before anything is shuffled.

Terms are runs of letters A-Z, a-z and of any characters beyond ASCII; A-Z are
lower-cased.  A language keeps the terms found in at least ``MIN_DOCS`` of its
documents, V of them.  A group (a source of a language, or the language itself)
with N occurrences of kept terms gives a term it has ``count`` times the scaled
share p = 1 + floor(SCALE * (count + 1) / (N + V)); a group's divergence from
another that gives it q is floor((p - q)^2 / q).

Pairs are summed sparsely.  With p0 and q0 the shares of absent terms, the sum
over all V terms of f(p, q) is

    V f(p0, q0) + sum over terms of the group      of f(p, q0) - f(p0, q0)
                + sum over terms of the other      of f(p0, q) - f(p0, q0)
                + sum over terms that both have    of f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0).

The first three need only how many terms each group has how often (one row per
group and count); the last is taken inside buckets of terms, where every task
adds up its terms and sends one row per pair of sources that meet.  All
arithmetic is in integers.

Defined cases: null text, lang and source are ''; empty texts have no terms but
their group occurs; repeated rows are documents of their own; a language without
kept terms has pair values 0 and no term rows; an empty table gives no rows;
very long texts are tokenized whole; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmodes.llm.tables import keep, partitions
from fieldmodes.llm.words import as_text, slices, split_words

SCALE = 1_000_000_000
MIN_DOCS = 3
TOP_TERMS = 200
BUCKET_ROWS = 200_000  # kept (term, source) rows of a bucket of terms

# Bytes of UTF-8 that belong to a term, lower-cased; the rest as blanks.
_FOLD = np.full(256, 0x20, dtype=np.uint8)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)


def terms_of(texts: pa.Array):
    """The terms of each text, as :class:`~fieldmodes.llm.words.Words`."""
    texts = as_text(texts).cast(pa.large_string())
    offs = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offs[0] : offs[-1]]
    folded = pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(offs - offs[0]), pa.py_buffer(_FOLD[raw])])
    return split_words(folded)


def _add(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys and the sums of ``values`` over equal keys."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[at], *(np.add.reduceat(v[order], at) if len(at) else v[:0] for v in values)


def collapse(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, digest, text, copies array<struct<source, n>>): one row per distinct text of a language.

    Rows are named by the SHA-256 of their text; copies are counted without moving texts, and of the texts
    one copy per task is moved."""
    of = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = docs.select(of(lang_col).alias("lang"), of(source_col).alias("source"), of(text_col).alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    copies = (rows.groupBy("lang", "digest", "source").agg(F.count("*").alias("n"))
              .groupBy("lang", "digest").agg(F.collect_list(F.struct("source", "n")).alias("copies")))
    texts = rows.groupBy("lang", "digest").agg(F.first("text").alias("text"))
    return texts.join(copies, ["lang", "digest"])


def term_counts(texts: DataFrame) -> DataFrame:
    """(lang, source, term, count, docs) of the rows of :func:`collapse`; a text without terms gives a row
    with a null term, so that every group occurs."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("count", pa.int64()), ("docs", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 8 << 20):
            w = terms_of(b["text"])
            size = max(len(w.vocab), 1)
            pair, tf = _add(w.owner * size + w.codes, np.ones(len(w.codes), dtype=np.int64))
            text, term = pair // size, pair % size
            # each text's copies: (group, multiplicity)
            lists = b["copies"]
            flat = lists.flatten()
            per = pc.list_value_length(lists).to_numpy().astype(np.int64)
            lang = b["lang"].dictionary_encode()
            source = flat.field("source").dictionary_encode()
            sources = max(len(source.dictionary), 1)
            group = (np.repeat(lang.indices.to_numpy().astype(np.int64), per) * sources + source.indices.to_numpy())
            groups, group = np.unique(group, return_inverse=True)
            n, first = flat.field("n").to_numpy(), np.cumsum(per) - per
            times = per[text]
            at = np.repeat(first[text] - np.cumsum(times) + times, times) + np.arange(times.sum())
            key, count, docs = _add(group[at] * size + np.repeat(term, times), n[at] * np.repeat(tf, times), n[at])
            own = np.r_[groups[key // size], groups]  # and every group without a term
            term = pa.array(np.r_[key % size, np.zeros(len(groups), dtype=np.int64)], mask=np.r_[np.zeros(len(key), bool), np.ones(len(groups), bool)])
            none = np.zeros(len(groups), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([
                lang.dictionary.take(pa.array(own // sources)), source.dictionary.take(pa.array(own % sources)), w.vocab.cast(pa.string()).take(term),
                pa.array(np.r_[count, none]), pa.array(np.r_[docs, none])], schema=schema)

    return texts.mapInArrow(run, "lang string, source string, term string, count long, docs long")


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def scaled(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / total) in 64 bits, three digits at a time (totals below 9e15)."""
    share, rest = F.lit(0).cast("long"), count + 1
    for _ in range(3):
        step = rest * 1000
        share, rest = share * 1000 + _div(step, total), step % total
    return share + 1


def _scaled(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    share, rest = np.zeros(np.broadcast(count, total).shape, dtype=np.int64), count + 1 + np.zeros_like(total)
    for _ in range(3):
        step = rest * 1000
        share, rest = share * 1000 + step // total, step % total
    return share + 1


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
               min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` has the divergence of each source from every other
    source of its language, part ``term`` the ``top_terms`` terms it has more often than its language.

    Ranks go from 1 in each (lang, source, part), values descending, items ascending by their UTF-8."""
    spark = docs.sparkSession
    flat = term_counts(collapse(docs, text_col, lang_col, source_col))
    counts = keep(flat.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs")), "divergence-counts")
    kept = (counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("count").alias("lang_count"), F.sum("docs").alias("docs"))
            .where(F.col("docs") >= min_docs).select("lang", "term", "lang_count"))
    kept = keep(kept, "divergence-terms")
    sparse = keep(counts.where("term IS NOT NULL").drop("docs").join(kept, ["lang", "term"]), "divergence-kept")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_count").alias("lang_n"))
    groups = keep(counts.select("lang", "source").distinct()
                  .join(sparse.groupBy("lang", "source").agg(F.sum("count").alias("n")), ["lang", "source"], "left")
                  .join(langs, "lang", "left")
                  .select("lang", "source", F.coalesce("v", F.lit(0)).cast("long").alias("v"),
                          (F.coalesce("n", F.lit(0)) + F.coalesce("v", F.lit(0))).cast("long").alias("total"),
                          (F.coalesce("lang_n", F.lit(0)) + F.coalesce("v", F.lit(0))).cast("long").alias("lang_total")), "divergence-groups")

    # part term: rows of one group are ranked after the best of each task are taken (a group limit before the shuffle)
    p, q = F.col("p"), F.col("q")
    terms = (sparse.join(groups, ["lang", "source"])
             .withColumns({"p": scaled(F.col("count"), F.col("total")), "q": scaled(F.col("lang_count"), F.col("lang_total"))}).where(p > q)
             .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _div((p - q) * (p - q), q).alias("value")))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms)

    # part pair: what each group's own terms add, against every other group of its language
    spectrum = sparse.groupBy("lang", "source", "count").agg(F.count("*").alias("terms"))
    others = groups.select("lang", "source", "v", "total").join(
        groups.select("lang", F.col("source").alias("item"), F.col("total").alias("item_total")), "lang").where(F.col("source") != F.col("item"))

    def own_terms(key: tuple, mine: pa.Table, them: pa.Table) -> pa.Table:
        if not them.num_rows or not them["v"][0].as_py():
            to = them["item"]
            zero = pa.array(np.zeros(len(to), dtype=np.int64))
            return pa.Table.from_arrays([them["lang"], them["source"], to, zero], names=["lang", "source", "item", "value"])
        total, v = them["total"][0].as_py(), them["v"][0].as_py()
        theirs = them["item_total"].to_numpy()
        p0, q0 = _scaled(np.zeros(1, np.int64), np.array([total])), _scaled(np.zeros(len(theirs), np.int64), theirs)
        to_them, from_them = v * _gap(p0, q0), np.zeros(len(theirs), dtype=np.int64)
        count, n = mine["count"].to_numpy(), mine["terms"].to_numpy()
        own = _scaled(count, np.array([total]))
        for lo in range(0, len(own), 1 << 10):
            x, k = own[lo : lo + (1 << 10), None], n[lo : lo + (1 << 10), None]
            to_them += (k * (_gap(x, q0) - _gap(p0, q0))).sum(axis=0)
            from_them += (k * (_gap(q0, x) - _gap(q0, p0))).sum(axis=0)
        lang, me = pa.repeat(them["lang"][0], 2 * len(theirs)), pa.chunked_array([pa.repeat(them["source"][0], len(theirs))])
        items = them["item"]
        return pa.Table.from_arrays([lang, pa.chunked_array([*me.chunks, *items.chunks]), pa.chunked_array([*items.chunks, *me.chunks]),
                                     pa.array(np.r_[to_them, from_them])], names=["lang", "source", "item", "value"])

    partial = "lang string, source string, item string, value long"
    alone = spectrum.groupBy("lang", "source").cogroup(others.groupBy("lang", "source")).applyInArrow(own_terms, partial)

    # ... and what terms add that both have
    def both_have(got: pa.Table) -> pa.Table:
        lang, source = got["lang"].combine_chunks().dictionary_encode(), got["source"].combine_chunks().dictionary_encode()
        term = got["term"].combine_chunks().dictionary_encode()
        lc, sc = (x.indices.to_numpy().astype(np.int64) for x in (lang, source))
        tc = lc * len(term.dictionary) + term.indices.to_numpy()
        order = np.argsort(tc, kind="stable")
        tc, lc, sc = tc[order], lc[order], sc[order]
        total = got["total"].to_numpy()[order]
        p, p0 = _scaled(got["count"].to_numpy()[order], total), _scaled(np.zeros(1, np.int64), total)
        sums: dict[int, int] = {}
        sources = len(source.dictionary)
        left = np.arange(len(tc) - 1)
        step = 1
        while len(left := left[left + step < len(tc)]) and len(left := left[tc[left] == tc[left + step]]):
            for i, j in ((left, left + step), (left + step, left)):
                value = _gap(p[i], p[j]) - _gap(p[i], p0[j]) - _gap(p0[i], p[j]) + _gap(p0[i], p0[j])
                for key, s in zip(*(x.tolist() for x in _add((lc[i] * sources + sc[i]) * sources + sc[j], value))):
                    sums[key] = sums.get(key, 0) + s
            step += 1
        key = np.fromiter(sums, dtype=np.int64, count=len(sums))
        return pa.Table.from_arrays([
            lang.dictionary.take(pa.array(key // sources // sources)), source.dictionary.take(pa.array(key // sources % sources)),
            source.dictionary.take(pa.array(key % sources)), pa.array(list(sums.values()), pa.int64())], names=["lang", "source", "item", "value"])

    buckets = max(1, -(-sparse.count() // bucket_rows))
    met = (sparse.select("lang", "source", "term", "count").join(groups.select("lang", "source", "total"), ["lang", "source"])
           .withColumn("bucket", F.pmod(F.xxhash64("lang", "term"), F.lit(buckets)))
           .groupBy("bucket").applyInArrow(both_have, partial))
    pairs = (alone.unionByName(met).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
             .select("lang", "source", F.lit("pair").alias("part"), "item", "value"))
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(terms)
