"""Source divergence, token alignment and exact top-k search against plain Python versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from fieldmodes.llm import align, divergence, queries, topk

SF = "/root/testdata/sf0.001"


# ---- source divergence -------------------------------------------------------------


def brute_divergence(docs, min_docs=3, top=200):
    """docs: (lang, source, text).  Every kept term of every pair of sources, nothing sparse."""
    rows = [(a or "", b or "", [x.translate({c: c + 32 for c in range(65, 91)}) for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")]) for a, b, t in docs]
    out = []
    for lang in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == lang]
        df = Counter(x for r in mine for x in set(r[2]))
        kept = [x for x in df if df[x] >= min_docs]
        counts = defaultdict(Counter)
        for _, source, terms in mine:
            counts[source].update(x for x in terms if df[x] >= min_docs)
        everything = sum(counts.values(), Counter())

        def share(c):
            total = sum(c.values()) + len(kept)
            return {x: 1 + 10**9 * (c[x] + 1) // total for x in kept}
        p = {s: share(counts[s]) for s in {r[1] for r in mine}}
        q = share(everything)
        f = lambda a, b: (a - b) ** 2 // b
        for s in p:
            pair = sorted((-sum(f(p[s][x], p[o][x]) for x in kept), o.encode(), o) for o in p if o != s)
            out += [(lang, s, "pair", o, -v, k + 1) for k, (v, _, o) in enumerate(pair)]
            term = sorted((-f(p[s][x], q[x]), x.encode(), x) for x in kept if counts[s][x] and p[s][x] > q[x])
            out += [(lang, s, "term", x, -v, k + 1) for k, (v, _, x) in enumerate(term[:top])]
    return sorted(out)


def divergence_of(spark, docs, **how):
    df = spark.createDataFrame([(*d, 1, "p", 2.0) for d in docs], "lang string, source string, text string, rank int, part string, value double")
    return sorted(tuple(r) for r in divergence.divergence(df.repartition(3), **how).select("lang", "source", "part", "item", "value", "rank").collect())


def odd_documents(seed=3):
    rng = random.Random(seed)
    words = ["the", "The", "été", "x1y", "日本", "a-b", "zz", "Q", "ÀB", "rare"]
    docs = [(rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "S", None]), " ".join(rng.choices(words, k=rng.randrange(12)))) for _ in range(80)]
    docs += [("en", "hot", "the same text again and again")] * 40 + [("en", "s1", "the same text again and again")] * 2
    docs += [("fr", "alone", "un deux"), ("it", "a", "uno"), ("it", "b", None), ("it", "c", ""), ("en", "big", "the été " * 20000)]
    return docs


@pytest.mark.parametrize("how", [{}, {"bucket_rows": 5, "top_terms": 2}])
def test_divergence(spark, how):
    docs = odd_documents()
    assert divergence_of(spark, docs, **how) == brute_divergence(docs, top=how.get("top_terms", 200))


def test_divergence_empty(spark):
    assert divergence_of(spark, []) == []
    assert divergence_of(spark, [("a", "b", None)]) == []


def test_scaled_is_exact(spark):
    rows = [(0, 1), (0, 10**9 + 7), (6, 7), (5 * 10**14, 5 * 10**14 + 1), (123456789012345, 987654321098765), (2, 9)]
    got = spark.createDataFrame(rows, "c long, t long").select(divergence.scaled(F.col("c"), F.col("t"))).collect()
    want = [1 + 10**9 * (c + 1) // t for c, t in rows]
    assert [r[0] for r in got] == want
    assert divergence._scaled(np.array([c for c, _ in rows]), np.array([t for _, t in rows])).tolist() == want


# ---- token alignment ---------------------------------------------------------------


class Plain:
    def __init__(self):
        self.a = tokenizers.Tokenizer.from_file(align.MODEL_A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=align.MODEL_B)
        self.alphabet = align.byte_alphabet()
        self.piece = {}

    def bytes_a(self, i):
        return bytes(self.alphabet[c] for c in self.a.id_to_token(i))

    def bytes_b(self, i):
        p = self.b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()

    def tokens(self, text):
        if not text:
            return [], []
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        sides = [(a, [self.bytes_a(i) for i in a]), (b, [self.bytes_b(i) for i in b])]
        if any(b"".join(x) != (" " + text).encode() for _, x in sides):
            return [], []
        return [list(zip(ids, np.cumsum([len(x) for x in words]).tolist())) for ids, words in sides]

    def align(self, text):
        """(A tokens, B tokens, groups text, links)"""
        a, b = self.tokens(text)
        both = sorted({e for _, e in a} & {e for _, e in b})
        groups, links, last = [], [], 0
        for end in both:
            ga = [(i, e) for i, e in a if last < e <= end]
            gb = [(i, e) for i, e in b if last < e <= end]
            groups.append(",".join(str(i) for i, _ in ga) + "|" + ",".join(str(i) for i, _ in gb))
            starts = lambda g: [last, *(e for _, e in g)]  # noqa: E731, B023
            links += [(i, j) for (i, e), s in zip(ga, starts(ga)) for (j, f), t in zip(gb, starts(gb)) if s < f and t < e]
            last = end
        return a, b, ";".join(groups), links


def brute_alignment(docs, plain=None):
    plain = plain or Plain()
    known = {t: plain.align(t) for t in {t for _, t in docs}}
    count = Counter(x for _, t in docs for x in known[t][3])
    most = defaultdict(int)
    for (_, j), c in count.items():
        most[j] = max(most[j], c)
    rows = []
    for d, t in docs:
        a, b, groups, links = known[t]
        rows.append((d, len(a), len(b), len(groups.split(";")) if groups else 0, len(links), sum(count[x] == most[x[1]] for x in links),
                     sum(count[x] for x in links), groups))
    return sorted(rows, key=str)


ODD_TEXTS = [None, "", " ", "a", "▁", "x▁y", "  two  blanks ", "<s> <|endoftext|> </s>", "日本語 テスト a b", "a\n b\tc", "é é ☃ 👍🏽", "x" * 3000,
             "1 2 3 a1 b2", "İ ı ß 's don't", "\x00 a\x1fb \x7f", " x y z", "hello world again", "hello world again", "word " * 300]


@pytest.mark.parametrize("split_chars, block_bytes, piece", [(1 << 20, 4 << 20, 512), (40, 60, 3)])
def test_alignment(spark, monkeypatch, split_chars, block_bytes, piece):
    monkeypatch.setattr(align.merge_path, "__defaults__", (piece,))
    docs = [(k if k != 3 else None, t) for k, t in enumerate(ODD_TEXTS)] + [(5, "x▁y"), (16, "hello world again")]
    df = spark.createDataFrame([(*d, 1, 2, "g", 3) for d in docs], "doc_id long, text string, uid int, part int, groups string, block int").repartition(2)
    want = brute_alignment(docs)
    cols = ("id", *align.PER_DOC, "n_best", "count_sum", "groups")
    got = align.align(df, split_chars=split_chars, block_bytes=block_bytes).select(*cols).collect()
    assert sorted((tuple(r) for r in got), key=str) == want
    digests = align.align(df, split_chars=split_chars, block_bytes=block_bytes, digest=True).select(*cols).collect()
    assert sorted((tuple(r) for r in digests), key=str) == sorted(((*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "") for r in want), key=str)


def test_alignment_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert align.align(df).collect() == []
    assert [tuple(r) for r in align.align(spark.createDataFrame([(None, None)], "doc_id long, text string")).collect()] == [(None, 0, 0, 0, 0, 0, 0, "")]


def test_alignment_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = [(*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "") for r in brute_alignment(docs)]
    got = queries.op12_token_alignment(spark, SF).select("doc_id", *align.PER_DOC, "n_best", "count_sum", "groups_sha256").collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)


def test_merge_path_is_the_merge():
    rng = random.Random(5)
    for n in (1, 2, 9, 200):
        for piece in (1, 2, 7, 1000):
            total = rng.randrange(n, 3 * n + 2)
            a = np.array(sorted({total, *rng.sample(range(1, total + 1), min(n, total))}))
            b = np.array(sorted({total, *rng.sample(range(1, total + 1), rng.randrange(1, total + 1))}))
            i, j, ahead, close = align.merge_path(a, b, piece)
            spans = [list(zip([0, *x[:-1]], x)) for x in (a.tolist(), b.tolist())]
            want = [(x, y) for x, (s, e) in enumerate(spans[0]) for y, (t, f) in enumerate(spans[1]) if s < f and t < e]
            assert list(zip(i[ahead].tolist(), j[ahead].tolist())) == want
            assert b[j[close]].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


# ---- exact top-k -------------------------------------------------------------------


def brute_top_k(rows, k, every):
    """rows: (id, vector); every row but the query's own."""
    ok = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for at, (qid, q) in enumerate(ok):
        if qid % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(q, v)), i) for n, (i, v) in enumerate(ok) if n != at)
            out += [(qid, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def top_k_of(spark, rows, every, **how):
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], "vec_id long, embedding array<double>, rank int, score string").repartition(3)
    return sorted(tuple(r) for r in topk.top_k(df, F.col("id") % every == 0, **how).collect())


def clustered(n=400, dims=6, seed=1):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(8, dims)) * 20
    return [(i, (centre[i % 8] + rng.normal(size=dims) * 0.05).tolist()) for i in range(n)]


@pytest.mark.parametrize("how", [{}, {"pivots": 8, "group_queries": 3, "piece_rows": 10}, {"pivots": 1, "piece_rows": 1000}])
def test_top_k(spark, how):
    rows = clustered()
    rows += [(1000 + i, [0.5] * 6) for i in range(60)] + [(i, [0.5] * 6) for i in (1000, 1000, 1005)]  # a common vector, repeated rows
    rows += [(None, [1.0] * 6), (5000, None), (5010, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (5020, [float("nan")] * 6), (5030, [float("inf")] * 6), (5040, []), (5050, [3.0, -2.0])]
    assert top_k_of(spark, rows, 5, k=10, **how) == brute_top_k(rows, 10, 5)


def test_top_k_few_rows_and_none(spark):
    assert top_k_of(spark, [], 5) == []
    assert top_k_of(spark, [(1, [1.0])], 5) == []
    assert top_k_of(spark, [(5, [1.0])], 5) == []
    assert top_k_of(spark, [(5, [1.0]), (7, [-1.0]), (-5, [2.0])], 5) == brute_top_k([(5, [1.0]), (7, [-1.0]), (-5, [2.0])], 10, 5)


def test_top_k_large_components(spark):
    rows = [(i, [float(2**20 + 977 * i), float(-i)]) for i in range(40)]  # squares beyond 2^53
    assert top_k_of(spark, rows, 5) == brute_top_k(rows, 10, 5)
    with pytest.raises(ValueError):
        top_k_of(spark, [(0, [1e18]), (1, [1.0])], 5)


def test_bounds_exclude_rows_of_far_cells():
    rows = np.floor(1024 * np.array([v for _, v in clustered(2000)]))
    pivots = topk.choose_pivots(rows[:500], 8)
    cell, far = topk.nearest(rows, pivots)
    norm = np.linalg.norm(rows, axis=1)
    data = [(c, int((cell == c).sum()), far[cell == c].max(), sorted(far[cell == c])[:11]) for c in range(8) if (cell == c).any()]
    asked = [(c, 5, far[cell == c].max(), norm[cell == c].max()) for c, *_ in data]
    plan = topk.Plan(pivots, data, asked, 11, 1, 100)
    row, group = plan.groups_of_rows(rows)
    assert len(row) < 0.5 * len(rows) * len(plan.members)
