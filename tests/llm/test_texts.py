"""Word splitting, quality rules, SimHash, substring dedup and decontamination against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldmodes.llm import contamination, quality, queries, simhash, substring
from fieldmodes.llm.words import split_words, window_hash
from tests.llm import brute

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977}" for i in range(30000))


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def frame(spark, rows):
    """Documents with nulls allowed everywhere and columns that clash with the operators' names."""
    return spark.createDataFrame([(*r, 1, "x", 2.0, "h") for r in rows],
                                 "doc_id long, text string, lang string, n_words long, row string, id double, text_hash string")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \t\n\x0b\x0c\r\x1c é", max_size=20), max_size=6))
def test_split_words(texts):
    w = split_words(pa.array(texts, pa.string()))
    got = [[w.vocab[c].as_py() for c in w.codes[a:b]] for a, b in zip(w.offsets, w.offsets[1:])]
    assert got == [brute.words(t) for t in texts]


def test_window_hash_is_the_window():
    ids = np.array([1, 2, 3, 1, 2, 3, 4, 2, 1], dtype=np.uint64)
    for width in (1, 2, 3, 7):
        h = window_hash(ids, width)
        for i in range(len(h)):
            for j in range(len(h)):
                assert (h[i] == h[j]) == (ids[i:i + width].tolist() == ids[j:j + width].tolist())


# ---- quality rules ---------------------------------------------------------------


def test_quality_query_equals_brute_force(spark):
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in documents(spark).collect()]
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    want = brute.quality(docs, labels, quality.CUTOFFS)
    rows = queries.op3_quality_rules(spark, SF).collect()
    assert {r["doc_id"]: r["kept"] for r in rows} == want
    for d, t, _ in docs:
        r = next(x for x in rows if x["doc_id"] == d)
        f = brute.features(t)
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == f[:5]
        assert r["base_failed"] == brute.base_failed(f)


def test_cutoffs_limit_false_rejection(spark):
    rnd = random.Random(5)
    clean = lambda: " ".join(f"word{rnd.randint(0, 10**6)}" for _ in range(30))
    rows = [(i, clean() if i % 4 else clean() + "".join(f" #{k}##" for k in range(20)), "en") for i in range(4000)]
    rows += [(i, clean(), None) for i in range(4000, 4020)]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(4020)] + [(1, None), (None, 1), (999999, 1)], "doc_id long, quality int")
    out = {r["id"]: r for r in quality.quality_rules(docs, labels, alpha=0.05).collect()}
    assert all(out[i]["kept"] for i in range(4020) if i % 4)  # no clean document goes
    assert not any(out[i]["kept"] for i in range(0, 4000, 4)) and out[0]["failed_rules"] == ["symbols"]
    assert all(out[i]["kept"] for i in range(4000, 4020))  # 20 labels certify nothing
    assert quality.keep_good(docs, labels, alpha=0.05).columns == docs.columns


def test_small_stratum_gets_rules_and_a_harmful_rule_is_left_out(spark):
    """321 good documents certify rules by their union; where repeats hits 10 of them, the others still are on."""
    word = lambda i, k: f"w{i}x{k}"
    clean = lambda i: " ".join(word(i, k) for k in range(30))
    repeated = lambda i: " ".join([" ".join(word(i, k) for k in range(10))] * 2 + [word(i, k) for k in range(10, 30)])  # noqa: E731  40 % of the words
    spam = lambda i: clean(i) + "".join(f" #{k}##" for k in range(20))
    rows = [(i, clean(i), "de") for i in range(321)] + [(i, spam(i), "de") for i in range(1000, 1050)]
    rows += [(2000 + i, repeated(i) if i < 10 else clean(i), "es") for i in range(321)] + [(i, spam(i), "es") for i in range(3000, 3050)]
    labels = spark.createDataFrame([(d, int(t.count("#") == 0)) for d, t, _ in rows], "doc_id long, quality int")
    docs = frame(spark, rows)
    feats = quality.rule_features(docs.select("doc_id", "text", "lang"))
    on = {}
    for r in quality.fit_cutoffs(feats, labels).collect():
        on.setdefault(r["stratum"], {})[r["rule"]] = r["cutoff"]
        assert r["good"] == 321 and r["rejected"] <= 1 and r["tail"] <= 0.05 / 2 * 5 / 36
    assert set(on["de"]) == set(quality.RULES) and set(on["es"]) == set(quality.RULES) - {"repeats"}
    gone = {r["id"] for r in quality.quality_rules(docs, labels).where("size(failed_rules) > 0").collect()}
    assert gone == {*range(1000, 1050), *range(3000, 3050)}


def test_all_former_cutoffs_are_still_certified():
    """Whatever one rule alone certified at alpha / rules, delta / (strata x rules x cutoffs), its path still reaches."""
    rnd = np.random.default_rng(3)
    for good in (1500, 2076, 5000):
        first = np.minimum(rnd.integers(1, 4000, good), 7)
        lost = [int((first <= k).sum()) for k in range(1, 7)]
        level = 0.05 / (4 * 30)
        former = max([k for k in range(1, 7) if quality.binomial_tail(lost[k - 1], good, 0.004) <= level], default=0)
        path, parts, share = quality.PATHS[0]
        assert quality._end_of_path(first, np.ones(good, dtype=np.int64), 6, 0.02 / parts, 0.05 / 4 * share)[0] >= former
    assert sum(share for *_, share in quality.PATHS) == pytest.approx(1.0)


def test_false_certificates_are_as_rare_as_promised():
    """Rules whose union loses a little over alpha of the good documents: certified in at most delta of the trials (0.2 here)."""
    rnd = np.random.default_rng(1)
    wrong = 0
    for _ in range(300):
        levels = np.full((400, 5), quality.OFF)
        lost = rnd.random(400) < 0.021  # at the first cutoff of a rule, each rule a fifth
        levels[lost, rnd.integers(0, 5, int(lost.sum()))] = 1
        levels = np.vstack([levels, np.ones((1, 5), dtype=int)])  # one bad document, rejected by all
        got = quality.choose_levels(levels, np.arange(401) < 400, np.ones(401, dtype=np.int64), 0.02, 0.2)
        wrong += len(got) == 5
    assert wrong <= 0.2 * 300


def test_binomial_tail():
    assert quality.binomial_tail(0, 100, 0.02) == pytest.approx(0.98**100)
    assert quality.binomial_tail(5, 5, 0.3) == 1.0


def test_quality_edges(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = [(None, None, None), (1, "", "en"), (2, LONG, "en"), (2, LONG, "en"), (3, " \n\t", None)]
    out = quality.quality_rules(frame(spark, rows), none).collect()
    assert len(out) == 5 and sorted(r["n_words"] for r in out) == [0, 0, 0, 30000, 30000]
    assert [r["kept"] for r in out if r["n_words"] == 0] == [False] * 3
    kept = quality.keep_good(frame(spark, rows + [(2, " ".join(map(str, range(50))), "en")]), none)
    assert [r["doc_id"] for r in kept.collect()] == [2]  # decided row by row
    assert quality.quality_rules(frame(spark, []), none).count() == 0


# ---- SimHash ---------------------------------------------------------------------


def test_simhash_query_equals_brute_force(spark):
    fps = {r["doc_id"]: brute.fingerprint(r["text"]) for r in documents(spark).collect()}
    comp = brute.components(fps)
    for r in queries.op10_simhash_near_dedup(spark, SF).collect():
        assert r["fingerprint"] == format(fps[r["doc_id"]], "016x") and r["component_id"] == comp[r["doc_id"]]


def test_links_of_a_dense_group(spark):
    """Hundreds of fingerprints close to one another, and chains of exactly 4 bits."""
    rnd = random.Random(2)
    base = rnd.getrandbits(64)
    fps = {base ^ sum(1 << b for b in rnd.sample(range(14), rnd.randint(0, 5))) for _ in range(400)}
    chain = rnd.getrandbits(64)
    for k in range(0, 60, 4):
        fps.add(chain)
        chain ^= 0b1111 << k
    fps |= {rnd.getrandbits(64) for _ in range(300)}
    fps = dict(enumerate(sorted(fps)))
    signed = [(f - (1 << 64) if f >> 63 else f, i) for i, f in fps.items()]
    edges = simhash.links(spark.createDataFrame(signed, "fp long, node long"))
    comp = {r["node"]: r["component"] for r in simhash.components(edges).collect()}
    want = brute.components(fps)
    assert {i: comp.get(i, i) for i in fps} == want
    assert edges.count() < 15 * len(fps)  # a forest under each key, never all pairs


def hot_family(n, rnd):
    """A family around one fingerprint, rows that share a key's blocks but nothing else, and strangers."""
    base = rnd.getrandbits(64)
    fps = {base ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 3))) for _ in range(n)}
    low = (1 << 22) - 1
    fps |= {(base & low) | (rnd.getrandbits(42) << 22) for _ in range(n)} | {rnd.getrandbits(64) for _ in range(n)}
    return dict(enumerate(sorted(fps)))


def signed_frame(spark, fps):
    return spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in fps.items()], "fp long, node long")


@pytest.mark.parametrize("large", [4, 256])
def test_hot_keys_are_split_without_losing_links(spark, monkeypatch, large):
    monkeypatch.setattr(simhash, "HOT", 100)
    monkeypatch.setattr(simhash, "LARGE", large)
    fps = hot_family(400, random.Random(8))
    reps = signed_frame(spark, fps)
    comp = {r["node"]: r["component"] for r in simhash.components(simhash.links(reps)).collect()}
    assert {i: comp.get(i, i) for i in fps} == brute.components(fps)


def test_second_masks_are_lossless():
    rnd = random.Random(1)
    for m in simhash.block_masks(4, 2):
        free = [b for b in range(64) if not m >> b & 1]
        for _ in range(200):
            d = sum(1 << b for b in rnd.sample(free, 4))
            assert any(not d & x & (1 << 64) - 1 for x in simhash.second_masks(m, 4))


def test_groups_stay_below_the_bound(spark, monkeypatch):
    """3,000 rows that share 22 bits and nothing else were one group."""
    rnd = random.Random(9)
    fps = dict(enumerate({(rnd.getrandbits(42) << 22) | 12345 for _ in range(3000)}))
    monkeypatch.setattr(simhash, "HOT", 200)
    assert simhash.keyed(signed_frame(spark, fps)).groupBy("mask", "key").count().agg({"count": "max"}).first()[0] <= 200


def test_further_levels_keep_groups_bounded_and_lose_no_links(spark, monkeypatch):
    """Rows that share 44 bits outnumber a key of the second level too."""
    rnd = random.Random(4)
    base = rnd.getrandbits(64)
    fps = dict(enumerate(sorted({base ^ sum(rnd.getrandbits(1) << b for b in range(20)) for _ in range(300)})))
    monkeypatch.setattr(simhash, "HOT", 100)
    monkeypatch.setattr(simhash, "FURTHER", 150)
    reps = signed_frame(spark, fps)
    free = lambda m: 64 - bin(m & (1 << 64) - 1).count("1")
    sizes = simhash.keyed(reps).groupBy("mask", "key").agg(F.count_distinct("fp").alias("count")).collect()
    assert max(64 - free(r["mask"]) for r in sizes) > 36 and all(r["count"] <= 150 or free(r["mask"]) <= 4 for r in sizes)
    comp = {r["node"]: r["component"] for r in simhash.components(simhash.links(reps)).collect()}
    assert {i: comp.get(i, i) for i in fps} == brute.components(fps)


def test_linked_rows_are_not_compared_again(monkeypatch):
    rnd = random.Random(3)
    base = rnd.getrandbits(64)
    fp = np.array(sorted({base ^ sum(1 << b for b in rnd.sample(range(24), rnd.randint(1, 3))) for _ in range(6000)}), dtype=np.uint64)
    cells, count = [], np.bitwise_count
    monkeypatch.setattr(simhash.np, "bitwise_count", lambda x: (cells.append(x.size), count(x))[1])
    us, vs = simhash._forest(fp, np.arange(len(fp)), np.zeros(len(fp), dtype=np.int64), 4)
    assert len(us) == len(vs) == len(fp) - 1 and sum(cells) < len(fp) ** 2 / 2 / 4


def test_simhash_edges(spark):
    rows = [(5, "a b c d e", "en"), (3, "A b C d e", "en"), (3, "A b C d e", "en"), (None, "a b c d e", "en"), (None, "zz yy xx ww vv", None),
            (7, None, None), (8, "", "en"), (9, " \t", "en"), (4, "a b", "en"), (5, "q w e r t y u i o p", "en"), (6, LONG, "en")]
    df = frame(spark, rows)
    got = {(r["id"], r["text_hash"]): r["component_id"] for r in simhash.simhash_components(df).collect()}
    by = {}
    for (i, _), c in got.items():
        by.setdefault(i, set()).add(c)
    assert by[3] == {3} and by[5] == {3, 5} and by[None] == {3, None} and by[7] == by[8] == by[9] == {7} and by[4] == {4}
    left = simhash.keep_one_per_component(df)
    assert left.columns == df.columns
    # the row with id 3 stays once, of the component without any id one row stays
    assert sorted(((r["doc_id"] if r["doc_id"] is not None else -1) for r in left.collect())) == [-1, 3, 4, 5, 6, 7]
    odd = frame(spark, [(None, "n o b o d y", "en"), (None, "n o b o d y", "en"), (None, "N o b o d y", "fr"), (1, "x y z", "a"), (1, "X y z", "b"), (1, "x y z", "a")])
    left = simhash.keep_one_per_component(odd.withColumnRenamed("row", "n"))
    assert sorted(str(r["doc_id"]) for r in left.collect()) == ["1", "None"] and left.columns[4] == "n"
    assert simhash.simhash_components(frame(spark, [])).count() == 0


# ---- substring dedup -------------------------------------------------------------


def check_substring(spark, rows, window=20):
    docs = frame(spark, rows)
    out = substring.substring_dedup(docs, window=window).collect()
    order = sorted({(d, t) for d, t, _ in rows}, key=lambda x: (x[0] is None, x[0]))
    want = brute.substrings([((d, t), t) for d, t in order], window)
    assert len(out) == len(rows)
    have = {}
    for r in out:
        have.setdefault(r["doc_id"], []).append((r["_n_removed"], r["text"]))
    for d, t, _ in rows:
        w, gone = want[d, t]
        text = t if not any(gone) else brute.cut(t, gone)
        assert (sum(gone), text) in have[d], (d, gone)


def test_substring_query_equals_brute_force(spark):
    want = brute.substrings(sorted((r["doc_id"], r["text"]) for r in documents(spark).collect()))
    for r in queries.op8_substring_dedup(spark, SF).collect():
        w, gone = want[r["doc_id"]]
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())


@pytest.mark.parametrize("seed", range(3))
def test_substring_random(spark, seed):
    """Few words, many repeats, runs of one word, windows across levels."""
    rnd = random.Random(seed)
    passage = [rnd.choice("abcdefgh") for _ in range(60)]
    rows = []
    for d in range(25):
        parts = [rnd.choice([rnd.choices("abcdefghijklmnop", k=rnd.randint(1, 40)), passage[rnd.randint(0, 20):rnd.randint(30, 60)], ["z"] * rnd.randint(1, 50)])
                 for _ in range(rnd.randint(0, 4))]
        rows.append((d, rnd.choice([" ", "\n", " \t"]).join(w for p in parts for w in p), "en"))
    check_substring(spark, rows, window=rnd.choice([8, 20]))


def test_substring_edges(spark):
    p = " ".join(f"p{i}" for i in range(25))
    check_substring(spark, [(4, p, "en"), (2, "x " + p + " y", "en"), (2, "x " + p + " y", "en"), (None, p, None), (1, None, "en"), (0, "", "en"),
                            (9, LONG, "en"), (8, "short", "en"), (10, p + "\n" + p, "en")])
    assert substring.substring_dedup(frame(spark, [])).count() == 0


def test_recompression_is_consistent():
    """A symbol decided inside a stretch is there wherever the stretch is."""
    rnd = np.random.default_rng(0)
    core = rnd.integers(0, 5, 60).astype(np.uint64)
    seen = []
    for _ in range(5):
        left = rnd.integers(0, 5, 30).astype(np.uint64)
        ids = np.r_[left, core, rnd.integers(0, 5, 30).astype(np.uint64)]
        sym, lo, hi = substring.recompress(ids, np.zeros(len(ids), dtype=np.int64))
        inside = (lo >= 30) & (hi <= 90)
        seen.append({(int(s), int(a) - 30) for s, a in zip(sym[inside], lo[inside])})
    assert seen[0] and all(s == seen[0] for s in seen)


# ---- decontamination -------------------------------------------------------------


def test_masks_are_lossless():
    from itertools import combinations
    places = [[o + p for p in m] for m in contamination.MASKS for o in range(contamination.WINDOW - m[-1])]
    for wrong in combinations(range(contamination.WINDOW), contamination.SUBSTITUTIONS):
        assert any(not set(wrong) & set(p) for p in places)


@pytest.mark.parametrize("bound", [contamination.BROADCAST_ROWS, 0])
def test_decontamination_random(spark, monkeypatch, bound):
    """Both joins: the benchmark broadcast, and shuffled because it is too large for that."""
    monkeypatch.setattr(contamination, "BROADCAST_ROWS", bound)
    rnd = random.Random(4)
    vocab = [f"t{i}" for i in range(60)]
    items = [(i, " ".join(rnd.choices(vocab, k=n))) for i, n in enumerate([5, 9, 12, 13, 14, 20, 30])] + [(70, None), (71, " "), (None, "n1 n2 n3 n4 n5 n6")]
    docs = []
    for d in range(60):
        w = rnd.choices(vocab, k=rnd.randint(0, 40))
        x = brute.words(rnd.choice(items)[1])
        a = rnd.randint(0, max(0, len(x) - 13))
        x = x[a:a + rnd.randint(11, 20)]
        for _ in range(rnd.randint(0, 3)):
            if x:
                x[rnd.randrange(len(x))] = "sub"
        at = rnd.randint(0, len(w))
        docs.append((d, " ".join(w[:at] + [t.upper() + "," for t in x] + w[at:]), "en"))
    docs += [(100, None, None), (101, "", "en"), (None, "n1 n2 n3 n4 n5 n6", "en"), (102, LONG, "en"), (102, LONG, "en")]
    out = contamination.decontaminate(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert out.columns == [*frame(spark, []).columns, "_leaked"]
    named = [(-1 if i is None else i, t) for i, t in items]
    for r in out.collect():
        assert sorted(-1 if i is None else i for i in r["_leaked"]) == brute.leaked(r["text"], named)
    assert out.count() == len(docs)


@pytest.mark.parametrize("bound", [contamination.BROADCAST_BYTES, 1000])
def test_long_items_are_broadcast_once_or_not_at_all(spark, monkeypatch, bound):
    """40 items of 500 words: their words are in one row each, not in one of each of their 39,000 seeds."""
    monkeypatch.setattr(contamination, "BROADCAST_BYTES", bound)
    sent, real = [], contamination.F.broadcast
    monkeypatch.setattr(contamination.F, "broadcast", lambda df: (sent.append(df), real(df))[1])
    items = [(i, " ".join(f"i{i}w{k}" for k in range(500))) for i in range(40)]
    docs = [(i, "a b " + " ".join(f"i{i}w{k}" for k in range(100 + i, 113 + i)) + " c", "en") for i in range(0, 40, 2)] + [(99, "a b c", "en")]
    out = contamination.decontaminate(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r["doc_id"]: r["_leaked"] for r in out} == {**{i: [i] for i in range(0, 40, 2)}, 99: []}
    words = sum(df.agg({"n": "sum"}).first()[0] for df in (d.selectExpr("size(test) AS n") for d in sent if "test" in d.columns))
    assert words == (40 * 500 if bound > 1000 else 0) and bool(sent) == (bound > 1000)


def exchanged(plan):
    """Column names of every shuffle in a plan."""
    plan = plan.initialPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan
    below = [names for i in range(plan.children().size()) for names in exchanged(plan.children().apply(i))]
    return below + [{plan.output().apply(i).name() for i in range(plan.output().size())}] * (plan.nodeName() == "Exchange")


@pytest.mark.parametrize("bound", [contamination.BROADCAST_ROWS, 0])
def test_search_shuffles_no_texts_and_equal_items_once(spark, monkeypatch, bound):
    """What leaves a task are a hit's few words, not those of its text; 30 items of the same words are one in the search, and each is found."""
    monkeypatch.setattr(contamination, "BROADCAST_ROWS", bound)
    kept, real = {}, contamination.keep
    monkeypatch.setattr(contamination, "keep", lambda df, name: kept.setdefault(name, (df, real(df, name)))[1])
    passage = " ".join(f"p{k}" for k in range(20))
    items = [(i, passage if i % 2 else passage.upper()) for i in range(30)] + [(30, " ".join(f"q{k}" for k in range(500)))]
    docs = [(1, f"{LONG} {passage.replace('p9', 'x').replace('p12', 'y')} {LONG}", "en"), (2, LONG, "en"), (3, " ".join(f"q{k}" for k in range(13)), "en")]
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if all tables were large
    try:
        out = contamination.decontaminate(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
        shuffled = exchanged(kept["benchmark-leaks"][0]._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
    assert {r["doc_id"]: r["_leaked"] for r in out} == {1: list(range(30)), 2: [], 3: [30]}
    assert shuffled and not any(names & {"words", "ids"} for names in shuffled)
    assert kept["benchmark-words"][1].count() == 2
    assert kept["benchmark-seeds"][1].count() == sum(n - m[-1] for n in (20, 500) for m in contamination.MASKS)


def test_bit_table_rules_out_most_but_no_hash_of_the_benchmark(spark):
    tests = spark.range(20_000).select(F.xxhash64("id").alias("hash"))
    placed = spark.range(100_000).select(F.col("id").alias("place"), F.xxhash64("id").alias("hash"))
    passed = {r["place"] for r in contamination._possible(placed, tests, 20_000).select("place").collect()}
    assert passed >= set(range(20_000)) and len(passed) < 22_000


def test_decontamination_empty_sides(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    assert [r["_leaked"] for r in contamination.decontaminate(frame(spark, [(1, "a b", "en")]), items).collect()] == [[]]
    assert contamination.decontaminate(frame(spark, []), items).count() == 0


def test_native_plan(spark):
    plan = queries.op6_benchmark_decontamination(spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
