"""Operator 5, LM scoring: a Katz backoff model of any order (2 by default).

Tokens of a text are its words, A-Z in lower case, then one end token.  With
counts c over the training texts, N tokens and V distinct ones, and h' for the
context h without its first token (for one word: no context)

    p(w)   = d1(c(w)) c(w) / N              for known words, the rest of the mass for the one unknown class
    p(w|h) = dn(c(h,w)) c(h,w) / c(h)       for n-grams seen in training
           = alpha(h) p(w|h')               otherwise; alpha(h) = 1 for contexts never seen

``d`` is Katz's Good-Turing discount for counts up to ``TOP`` and 1 above, from
the counts of counts of the order.  Where one of the raw values is not strictly
between 0 and 1 (a bump in the counts of counts, as groups of copies make at any
size), the counts of counts are smoothed first, by the log-linear fit of Simple
Good-Turing.  Absolute discounting is left only for counts of counts that fall
no faster than 1/c, or that have a single count (no Good-Turing value exists).
alpha(h) makes the sum over all words and the unknown class exactly 1; a context
(or the unigrams) whose discounts leave no mass gets one more count in its
denominator.

The model is tables partitioned by hash: unigrams (word, count), and for each
order n-grams (context, word, count, lower_count, from order 3 lower_total: the
count of the n-gram, and from order 3 the total of the context, without the
first token) and contexts (context, total, alpha); words and contexts are 64-bit
ids.  ``save`` and ``load`` store it, ``score`` scores other texts from its
tables.  Texts are packed in word blocks; a round of ``ask`` brings each block
the counts of its words, and two rounds an order the counts of its n-grams and
its contexts' weights.  The first block to ask for a key owns it and writes its
model row.  A frequent word or n-gram has one entry a block; sums over a
context's followers are a Spark aggregation with partial sums.

Defined cases: null and empty texts are the end token alone; very long texts
are words of one block; a null id is training; repeated rows count and are
scored each; other columns are not read; an empty table gives no rows; without
training texts every token is unknown and has probability 1 (score 0), and the
base is that of N = V = 0.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmodes.llm.blocks import BUCKET_WORDS, Block, ask, by_bucket, n_buckets, pack, per_bucket, unpack, word_blocks
from fieldmodes.llm.tables import keep
from fieldmodes.llm.words import give_back, mix64

TOP = 5
BEGIN, END = np.uint64(1), np.uint64(2)  # ids of the start context and the end token
PARTS = 16


def crc_fold(doc_id: int | None, folds: int = 5, fold: int = 1) -> bool:
    """Is the id in the held-out fold?"""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == fold


class Grams(NamedTuple):
    """The n-grams of a block: distinct ones by code."""

    which: np.ndarray  # code of the n-gram that ends at each token
    context: np.ndarray  # code of the context at each token
    of_context: np.ndarray  # by code: its context, its word, the code of its last n - 1 tokens
    of_word: np.ndarray
    shorter: np.ndarray
    key: np.ndarray  # by code: its 64-bit id
    context_key: np.ndarray  # by context code


class Tokens:
    """The tokens of a block as codes into ``vocab`` (the words, then BEGIN, then END), and their n-grams up to ``order``."""

    def __init__(self, block: Block, held_out: Callable[[int | None], bool], order: int = 2):
        n, docs = len(block.codes), len(block.counts)
        begin, end = len(block.vocab), len(block.vocab) + 1
        self.vocab = np.r_[block.vocab, BEGIN, END].astype(np.uint64)
        self.counts = block.counts + 1
        last = np.cumsum(self.counts) - 1
        self.token = np.full(n + docs, end, dtype=np.int32)
        word = np.ones(n + docs, dtype=bool)
        word[last] = False
        self.token[word] = block.codes
        self.held_out = np.array([held_out(d) for d in block.doc_ids], dtype=bool)
        self.train = np.repeat(~self.held_out, self.counts)
        context = np.empty_like(self.token)
        context[1:] = self.token[:-1]
        context[last - block.counts] = begin
        context_key, shorter = self.vocab, self.token
        self.grams: dict[int, Grams] = {}
        for k in range(2, order + 1):
            code = context.astype(np.int64) * len(self.vocab) + self.token
            if k == 2:
                pairs, which = np.unique(code, return_inverse=True)
                of_word = pairs % len(self.vocab)
                shorter_of = of_word
            else:
                pairs, at, which = np.unique(code, return_index=True, return_inverse=True)
                of_word, shorter_of = pairs % len(self.vocab), shorter[at]
            of_context = pairs // len(self.vocab)
            self.grams[k] = Grams(which, context, of_context, of_word, shorter_of, gram_key(context_key[of_context], self.vocab[of_word]), context_key)
            if k == order:
                break
            # A context of k tokens is the k-gram that ends one token before; at the start all of it is BEGIN.
            context = np.empty(len(which), dtype=np.int64)
            context[1:] = which[:-1]
            context[last - block.counts] = len(pairs)
            start = gram_key(context_key[begin : begin + 1] if k == 2 else context_key[-1:], np.array([BEGIN]))
            context_key, shorter = np.r_[self.grams[k].key, start], which

    def words(self) -> np.ndarray:
        """Codes that occur as tokens (all but BEGIN, END only if there are texts)."""
        return np.unique(self.token)


def gram_key(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Id of context and word, which is also the id of the context they make."""
    with np.errstate(over="ignore"):
        return mix64(mix64(context, 3) * np.uint64(0x9E3779B97F4A7C15) + mix64(word, 5))


def _train_counts(n: int, t: Tokens) -> np.ndarray:
    """Training count by code."""
    which, size = (t.token, len(t.vocab)) if n == 1 else (t.grams[n].which, len(t.grams[n].key))
    return np.bincount(which[t.train], minlength=size)


def _ask_counts(n: int, held_out: Callable[[int | None], bool], counts_too: bool = True):
    """Requests for the totals of a block's n-grams, with the block's own counts if they make up the total."""
    def requests(row: dict, buckets: int) -> list[dict]:
        t = Tokens(Block(row), held_out, n)
        codes = t.words() if n == 1 else slice(None)
        keys = t.vocab[codes] if n == 1 else t.grams[n].key
        counts = _train_counts(n, t)[codes].astype(np.int32) if counts_too else None
        bucket, order = by_bucket(keys, buckets)
        return [{"bucket": k, "keys": pack(keys[i])} | ({"counts": pack(counts[i])} if counts_too else {}) for k, i in per_bucket(order, bucket)]
    return requests


def _ask_contexts(n: int):
    """Requests for the total and weight of a block's contexts of order ``n``."""
    def requests(row: dict, buckets: int) -> list[dict]:
        g = Tokens(Block(row), lambda d: False, n).grams[n]
        keys = g.context_key[np.unique(g.context)]
        bucket, order = by_bucket(keys, buckets)
        return [{"bucket": k, "keys": pack(keys[i])} for k, i in per_bucket(order, bucket)]
    return requests


def _looked_up(key: str, absent: dict[str, tuple[str, np.generic]]):
    """Answers from a table's rows of the bucket: column -> (name of the answer, value where the key is not there)."""
    def answer(got: list[dict], table: pa.Table) -> list[dict]:
        known = table[key].to_numpy().view(np.uint64)
        order = np.argsort(known)
        known = np.r_[known[order], np.uint64(0)]
        columns = {name: np.append(table[c].to_numpy()[order], missing).astype(type(missing)) for c, (name, missing) in absent.items()}
        out = []
        for r in got:
            ask_for = unpack(r["keys"], np.uint64)
            at = np.searchsorted(known[:-1], ask_for)
            at = np.where(known[at] == ask_for, at, len(known) - 1)  # the last entry stands for keys that are not there
            out.append({name: pack(x[at]) for name, x in columns.items()})
        return out
    return answer


_weights = _looked_up("context", {"total": ("totals", np.int64(0)), "alpha": ("alphas", np.float64(1))})
_counts = _looked_up("key", {"count": ("totals", np.int64(0))})


def _bucket_of(key: str, buckets: int) -> Column:
    """The bucket of a 64-bit id as ``by_bucket`` gives it, from the upper half of the unsigned id."""
    return F.pmod(F.shiftrightunsigned(key, 32), F.lit(buckets)).cast("int")


def _add_counts(got: list[dict]) -> list[dict]:
    """Total count of each key, and which entry is the key's first."""
    keys = [unpack(r["keys"], np.uint64) for r in got]
    uniq, first, back = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    total = np.bincount(back, weights=np.concatenate([unpack(r["counts"], np.int32) for r in got]), minlength=len(uniq)).astype(np.int64)
    own = np.zeros(len(back), dtype=bool)
    own[first] = True
    out, at = [], 0
    for k in keys:
        out.append({"totals": pack(total[back[at : at + len(k)]]), "own": np.packbits(own[at : at + len(k)]).tobytes()})
        at += len(k)
    return out


def _told(row: dict, field: str, keys: np.ndarray, buckets: int, **parts) -> list[np.ndarray]:
    """Answers laid out as the keys were; parts: name -> dtype (None: bits)."""
    bucket, order = by_bucket(keys, buckets)
    told = {t["bucket"]: t for t in row[field] or ()}
    out = [np.zeros(len(keys), dtype=bool if t is None else t) for t in parts.values()]
    for k, i in per_bucket(order, bucket):
        for a, (name, dtype) in zip(out, parts.items()):
            a[i] = np.unpackbits(np.frombuffer(told[k][name], np.uint8), count=len(i)).astype(bool) if dtype is None else unpack(told[k][name], dtype)
    return out


class Discounts(NamedTuple):
    """d(c) for c = 1..TOP; 1 above."""

    values: tuple[float, ...]

    def of(self, c: np.ndarray) -> np.ndarray:
        return np.array([1.0, *self.values])[np.where(c <= TOP, c, 0)]

    def sql(self, c: str) -> str:
        return "CASE " + " ".join(f"WHEN {c} = {i + 1} THEN {v!r}D" for i, v in enumerate(self.values)) + " ELSE 1D END"


def _katz(n: list[float]) -> tuple[float, ...] | None:
    """Katz's formula on the counts of counts n[1..TOP+1]; None if a discount is not strictly between 0 and 1."""
    if not all(x > 0 for x in n[1 : TOP + 2]):
        return None
    cut = (TOP + 1) * n[TOP + 1] / n[1]
    if not cut < 1:
        return None
    d = tuple(((c + 1) * n[c + 1] / (c * n[c]) - cut) / (1 - cut) for c in range(1, TOP + 1))
    return d if all(0 < x < 1 for x in d) else None


def _log_linear(n: list[int]) -> list[float] | None:
    """n[1..TOP+1] on the line of Simple Good-Turing, log Z = a + b log c; None if there is no line.

    Z spreads a count of counts over the empty ones beside it (Gale and Sampson).  With b < -1 every
    discount is strictly between 0 and 1 and they grow with c."""
    at = [c for c in range(1, TOP + 2) if n[c] > 0]
    if len(at) < 2:
        return None
    before, after = [0, *at[:-1]], [*at[1:], 2 * at[-1] - at[-2]]
    z = [2 * n[c] / (t - q) for c, q, t in zip(at, before, after)]
    b, a = np.polyfit(np.log(at), np.log(z), 1)
    return [0.0, *(float(np.exp(a + b * np.log(c))) for c in range(1, TOP + 2))]


def good_turing(n: list[int]) -> Discounts:
    """Katz's discounts from the counts of counts n[1..TOP+1] (n[0] unused): raw, else smoothed, else absolute."""
    for counts in (n, _log_linear(n)):
        if counts and (d := _katz(counts)):
            return Discounts(d)
    gap = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    return Discounts(tuple((c - gap) / c for c in range(1, TOP + 1)))


class Model(NamedTuple):
    """Tables and numbers of a trained model; ``grams[0]``, ``weights[0]`` are of order 2, ``discounts[0]`` of order 1."""

    unigrams: DataFrame
    grams: tuple[DataFrame, ...]
    weights: tuple[DataFrame, ...]
    tokens: int
    types: int
    discounts: tuple[Discounts, ...]
    denominator: int  # N, or N + 1 if the discounts leave no mass
    unknown: float  # probability of the unknown class

    @property
    def order(self) -> int:
        return len(self.discounts)

    @property
    def bigrams(self) -> DataFrame:
        return self.grams[0]

    @property
    def contexts(self) -> DataFrame:
        return self.weights[0]

    @property
    def d1(self) -> Discounts:
        return self.discounts[0]

    def word_prob(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.d1.of(c) * c / max(self.denominator, 1), self.unknown)

    def without_tables(self) -> Model:
        """What tasks need of the model beside the answers they get."""
        return self._replace(unigrams=None, grams=(), weights=())

    def shorter_prob(self, n: int) -> str:
        """SQL: p(w | h without its first token) of a row of ``grams`` of order ``n``; such a row's shorter n-gram was seen too."""
        return f"({self.discounts[n - 2].sql('lower_count')}) * lower_count / " + (f"{max(self.denominator, 1)}D" if n == 2 else "lower_total")


def _counts_of_counts(table: DataFrame) -> list[int]:
    rows = table.where(F.col("count") <= TOP + 1).groupBy("count").agg(F.count("*").alias("n")).collect()  # at most TOP + 1 rows
    got = {r["count"]: r["n"] for r in rows}
    return [0, *(got.get(c, 0) for c in range(1, TOP + 2))]


def _rows(batches: Iterator[pa.RecordBatch], held_out: Callable[[int | None], bool], order: int) -> Iterator[tuple[dict, Tokens]]:
    for b in batches:
        for i in range(b.num_rows):
            row = b.slice(i, 1).to_pylist()[0]
            yield row, Tokens(Block(row), held_out, order)
            del row
            give_back()


def _totals(row: dict, t: Tokens, n: int, buckets: int, own: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(training count, does this block write the model's row) by code of the n-grams; the latter only if ``own``."""
    codes = t.words() if n == 1 else slice(None)
    keys = t.vocab[codes] if n == 1 else t.grams[n].key
    size = len(t.vocab) if n == 1 else len(keys)
    total, mine = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=bool)
    parts = {"totals": np.int64} | ({"own": None} if own else {})
    for to, x in zip((total, mine), _told(row, f"grams{n}", keys, buckets, **parts)):
        to[codes] = x
    return total, mine


def _context_weights(row: dict, t: Tokens, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(total, alpha) by context code of order ``n``."""
    g = t.grams[n]
    codes = np.unique(g.context)
    total, alpha = np.zeros(len(g.context_key), dtype=np.int64), np.ones(len(g.context_key))
    total[codes], alpha[codes] = _told(row, f"contexts{n}", g.context_key[codes], buckets, totals=np.int64, alphas=np.float64)
    return total, alpha


def _with(frame: DataFrame, told: DataFrame, name: str) -> DataFrame:
    return frame.join(told.withColumnRenamed("told", name), "block")


def train(blocks: DataFrame, buckets: int, order: int = 2, held_out: Callable[[int | None], bool] = crc_fold) -> tuple[Model, DataFrame]:
    """The model of the blocks' training texts, and the blocks with all counts and weights their texts need for scores.

    Each order is two rounds: counts of the n-grams, from which the order's table is written, and weights of the contexts."""
    words = ask(blocks, _ask_counts(1, held_out), ["keys", "counts"], _add_counts, ["totals", "own"], "word-counts", buckets)
    known = _with(blocks, words, "grams1")

    def unigram_rows(batches):
        for row, t in _rows(batches, held_out, 1):
            total, own = _totals(row, t, 1, buckets, own=True)
            mine = np.flatnonzero(own & (total > 0))
            key = t.vocab[mine]
            yield pa.RecordBatch.from_arrays([pa.array((key % np.uint64(PARTS)).astype(np.int32)), pa.array(key.view(np.int64)), pa.array(total[mine])],
                                             names=["part", "word", "count"])

    unigrams = keep(known.mapInArrow(unigram_rows, "part int, word long, count long"), "unigrams", partition_by="part")
    n_tokens, n_types = unigrams.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
    d1 = good_turing(_counts_of_counts(unigrams))
    mass = unigrams.agg(F.coalesce(F.sum(F.expr(f"({d1.sql('count')}) * count")), F.lit(0.0))).first()[0]
    denominator = n_tokens if mass < n_tokens else n_tokens + 1
    model = Model(unigrams, (), (), n_tokens, n_types, (d1,), denominator, 1.0 - mass / denominator if n_tokens else 1.0)
    for n in range(2, order + 1):
        model, known = _add_order(model, blocks, known, n, buckets, held_out)
    return model, known


def _add_order(model: Model, blocks: DataFrame, known: DataFrame, n: int, buckets: int,
               held_out: Callable[[int | None], bool]) -> tuple[Model, DataFrame]:
    """The model with n-grams, and ``known`` with the answers about them."""
    counts = ask(blocks, _ask_counts(n, held_out), ["keys", "counts"], _add_counts, ["totals", "own"], f"{n}-gram-counts", buckets)
    known = _with(known, counts, f"grams{n}")

    def gram_rows(batches):
        for row, t in _rows(batches, held_out, n):
            g = t.grams[n]
            total, own = _totals(row, t, n, buckets, own=True)
            mine = np.flatnonzero(own & (total > 0))
            h, shorter = g.context_key[g.of_context[mine]], g.shorter[mine]
            columns = {"part": (h % np.uint64(PARTS)).astype(np.int32), "context": h.view(np.int64), "word": t.vocab[g.of_word[mine]].view(np.int64),
                       "count": total[mine], "lower_count": _totals(row, t, n - 1, buckets)[0][shorter]}
            if n > 2:
                columns["lower_total"] = _context_weights(row, t, n - 1, buckets)[0][t.grams[n - 1].of_context[shorter]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns.values()], names=list(columns))

    schema = "part int, context long, word long, count long, lower_count long" + (", lower_total long" if n > 2 else "")
    grams = keep(known.mapInArrow(gram_rows, schema), f"{n}-grams", partition_by="part")
    d = good_turing(_counts_of_counts(grams))
    model = model._replace(grams=(*model.grams, grams), discounts=(*model.discounts, d))
    sums = grams.groupBy("context").agg(F.sum("count").alias("total"), F.sum(F.expr(f"({d.sql('count')}) * count")).alias("kept"),
                                        F.sum(F.expr(model.shorter_prob(n))).alias("lower"))
    # No mass left: one more count below the line.
    sums = sums.withColumn("total", F.when(F.col("kept") < F.col("total"), F.col("total")).otherwise(F.col("total") + 1))
    weights = keep(sums.select("context", "total", ((1 - F.col("kept") / F.col("total")) / (1 - F.col("lower"))).alias("alpha")), f"contexts-{n}")
    told = ask(blocks, _ask_contexts(n), ["keys"], _weights, ["totals", "alphas"], f"context-weights-{n}", buckets,
               table=weights.withColumn("bucket", _bucket_of("context", buckets)))
    return model._replace(weights=(*model.weights, weights)), _with(known, told, f"contexts{n}")


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scores(model: Model, known: DataFrame, buckets: int, held_out: Callable[[int | None], bool]) -> DataFrame:
    """Scores of the texts of blocks that have their counts and weights: backoff from the longest n-gram down, order by order."""
    numbers = model.without_tables()

    def score_rows(batches):
        for row, t in _rows(batches, held_out, numbers.order):
            counts, _ = _totals(row, t, 1, buckets)
            p, which = numbers.word_prob(counts), t.token
            for n in range(2, numbers.order + 1):
                g = t.grams[n]
                c, _ = _totals(row, t, n, buckets)
                total, alpha = _context_weights(row, t, n, buckets)
                h = g.of_context
                p = np.where(c > 0, numbers.discounts[n - 1].of(c) * c / np.maximum(total[h], 1), alpha[h] * p[g.shorter])
                which = g.which
            logs = np.log10(p)[which]
            base = np.log10((counts + 0.5) / (numbers.tokens + 0.5 * (numbers.types + 1)))[t.token]
            at = np.cumsum(t.counts) - t.counts
            add = lambda x: np.add.reduceat(x, at) if len(at) else x[:0]  # noqa: E731  every text has a token
            yield pa.RecordBatch.from_arrays([
                pa.array(row["doc_ids"], pa.int64()), pa.array(t.held_out), pa.array(t.counts), pa.array(add((counts[t.token] > 0).astype(np.int64))),
                pa.array(np.full(len(at), numbers.tokens, dtype=np.int64)), pa.array(add(base)), pa.array(add(logs))],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return known.mapInArrow(score_rows, SCORES)


def train_and_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    held_out: Callable[[int | None], bool] = crc_fold, order: int = 2) -> tuple[Model, DataFrame]:
    """Train on the texts that are not held out, score all: the model, and
    (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    blocks = word_blocks(docs, id_col, text_col, lower=True)
    buckets = n_buckets(blocks)
    model, known = train(blocks, buckets, order, held_out)
    return model, _scores(model, known, buckets, held_out)


def score(model: Model, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of texts by a stored model, from its tables: the columns of ``train_and_score``; every text is held out."""
    held_out = lambda d: True
    blocks = word_blocks(docs, id_col, text_col, lower=True)
    sizes = [t.count() for t in (model.unigrams, *model.grams)]
    buckets = max(n_buckets(blocks), -(-max(sizes) // BUCKET_WORDS))
    known = blocks
    for n in range(1, model.order + 1):
        table = _keyed(model, n).withColumn("bucket", _bucket_of("key", buckets))
        told = ask(blocks, _ask_counts(n, held_out, counts_too=False), ["keys"], _counts, ["totals"], f"known-{n}-grams", buckets, table=table)
        known = _with(known, told, f"grams{n}")
        if n > 1:
            table = model.weights[n - 2].withColumn("bucket", _bucket_of("context", buckets))
            told = ask(blocks, _ask_contexts(n), ["keys"], _weights, ["totals", "alphas"], f"known-contexts-{n}", buckets, table=table)
            known = _with(known, told, f"contexts{n}")
    return _scores(model, known, buckets, held_out)


def _keyed(model: Model, n: int) -> DataFrame:
    """(key, count) of the model's n-grams."""
    if n == 1:
        return model.unigrams.select(F.col("word").alias("key"), "count")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, w = (b[c].to_numpy().view(np.uint64) for c in ("context", "word"))
            yield pa.RecordBatch.from_arrays([pa.array(gram_key(h, w).view(np.int64)), b["count"]], names=["key", "count"])

    return model.grams[n - 2].select("context", "word", "count").mapInArrow(keys, "key long, count long")


NUMBERS = "tokens long, types long, denominator long, unknown double, discounts array<array<double>>"


def save(model: Model, path: str) -> None:
    """The model as tables under ``path``."""
    spark = model.unigrams.sparkSession
    for name, table in _tables(model):
        table.write.parquet(f"{path}/{name}", partitionBy="part" if "part" in table.columns else None)
    numbers = (model.tokens, model.types, model.denominator, model.unknown, [list(d.values) for d in model.discounts])
    spark.createDataFrame([numbers], NUMBERS).coalesce(1).write.parquet(f"{path}/numbers")


def load(spark: SparkSession, path: str) -> Model:
    """A model that ``save`` wrote."""
    r = spark.read.schema(NUMBERS).parquet(f"{path}/numbers").first()
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    orders = range(2, len(r["discounts"]) + 1)
    return Model(read("unigrams"), tuple(read(f"grams{n}") for n in orders), tuple(read(f"contexts{n}") for n in orders), r["tokens"], r["types"],
                 tuple(Discounts(tuple(d)) for d in r["discounts"]), r["denominator"], r["unknown"])


def _tables(model: Model) -> list[tuple[str, DataFrame]]:
    return [("unigrams", model.unigrams), *((f"grams{n}", t) for n, t in enumerate(model.grams, 2)),
            *((f"contexts{n}", t) for n, t in enumerate(model.weights, 2))]


def context_mass(model: Model, d: Discounts, n: int = 2) -> DataFrame:
    """(context, mass): sum of p(w|context) over all words and the unknown class, for contexts of order ``n``; 1 up to rounding."""
    lower = F.expr(model.shorter_prob(n))
    return (model.grams[n - 2].join(model.weights[n - 2], "context").groupBy("context")
            .agg((F.sum(F.expr(f"({d.sql('count')}) * count / total")) + F.first("alpha") * (1 - F.sum(lower))).alias("mass")))
