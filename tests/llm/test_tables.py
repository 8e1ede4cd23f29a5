"""Token rollups, WARC archives, Katz scores, tool calls and URL rules."""

import base64
import gzip
import hashlib
import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from fieldmodes.llm import katz, queries, toolcalls, urls, warc
from fieldmodes.llm import tokencounts as tc
from fieldmodes.session import scratch_path
from tests.llm import brute

SF = "/root/testdata/sf0.001"


# ---- token counts ----------------------------------------------------------------

CHANGE = "doc_id long, version string, op string, source string, lang string, tokens long, chars long"


def totals(rollup):
    return {(r["source"], r["lang"], r["version"]): (r["docs"], r["tokens"], r["chars"]) for r in rollup.totals().collect()}


def test_rollup_batches(spark):
    r = tc.Rollup(spark, scratch_path(spark, "rollup-test"))
    assert totals(r) == {} and r.state().count() == 0
    one = spark.createDataFrame([(1, "v1", "insert", "a", "en", 10, 50), (2, "v1", "insert", "a", "en", 5, 20), (2, "v1", "insert", "a", "en", 5, 20),
                                 (3, "v1", "insert", None, None, 7, 30), (1, "v2", "insert", "a", "en", 11, 50), (None, "v1", "insert", "a", "en", 99, 99)], CHANGE)
    assert r.apply(1, one)
    first = {("a", "en", "v1"): (2, 15, 70), (None, None, "v1"): (1, 7, 30), ("a", "en", "v2"): (1, 11, 50)}
    assert totals(r) == first
    assert not r.apply(1, one) and totals(r) == first  # sent again
    two = spark.createDataFrame([(1, "v1", "delete", None, None, None, None), (2, "v1", "revise", "b", "fr", 6, 21), (77, "v1", "delete", "a", "en", 1, 1),
                                 (3, "v1", "delete", None, None, None, None), (3, "v1", "revise", "b", "fr", 1, 1), (4, "v1", "insert", "b", "fr", 2, 3),
                                 (4, "v1", "insert", "b", "fr", 3, 1)], CHANGE)
    assert r.apply(2, two)
    assert totals(r) == {("b", "fr", "v1"): (2, 9, 22), ("a", "en", "v2"): (1, 11, 50)}
    assert r.apply(3, spark.createDataFrame([], CHANGE)) and r.committed() == [1, 2, 3]
    with pytest.raises(ValueError):
        tc.Rollup(spark, r.folder).apply(0, one)


def test_rollup_survives_a_batch_that_died(spark):
    """Files of an uncommitted batch are not read, and the batch can be sent again."""
    r = tc.Rollup(spark, scratch_path(spark, "rollup-died"))
    rows = spark.createDataFrame([(1, "v", "insert", "a", "en", 10, 50)], CHANGE)
    r.apply(1, rows)
    spark.createDataFrame([("a", "en", "v", 5, 5, 5)], tc.Rollup.DELTA).write.parquet(f"{r.folder}/deltas/batch=2")
    spark.createDataFrame([(1, "v", "x", "x", 1, 1)], tc.Rollup.STATE).write.parquet(f"{r.folder}/state/batch=2")
    assert totals(r) == {("a", "en", "v"): (1, 10, 50)}
    r.apply(2, spark.createDataFrame([(1, "v", "revise", "a", "en", 4, 9)], CHANGE))
    assert totals(r) == {("a", "en", "v"): (1, 4, 9)}


def test_token_query_equals_brute_force(spark):
    import base64

    import tiktoken
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tc.VOCAB, "rb"))}
    enc = tiktoken.Encoding("t", pat_str=tc.PATTERN, mergeable_ranks=ranks, special_tokens={})
    seen, want = set(), {}
    for r in sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: r["doc_id"]):
        if r["text"] in seen:
            continue
        seen.add(r["text"])
        text = re.sub(r"[\x20\x09-\x0D]+", " ", r["text"])
        k = r["source"], r["lang"], "byte_bpe_50k"
        a = want.get(k, (0, 0, 0))
        want[k] = a[0] + 1, a[1] + len(enc.encode_ordinary(text)), a[2] + len(text)
    got = {(r["source"], r["lang"], r["version"]): (r["docs"], r["tokens"], r["chars"]) for r in queries.op2_token_counts(spark, SF).collect()}
    assert got == want


def test_count_tokens_edges(spark):
    long = "word " * 40000
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, long, "x"), (3, long, "x"), (4, "<|endoftext|>", "x")], "doc_id long, text string, tokens string")
    rows = {r["doc_id"]: r for r in tc.count_tokens(df).collect()}
    assert (rows[1]["tokens"], rows[2]["tokens"], rows[1]["chars"]) == (0, 0, 0)
    assert rows[3]["tokens"] == 40001 and rows[4]["tokens"] > 1
    assert {r["tokens_"] for r in rows.values()} == {"x"}  # the input's own column
    clash = spark.createDataFrame([(1, "a b", 5, 6, 7)], "doc_id long, text string, chars long, _text long, row long")
    assert tc.count_tokens(clash).first().asDict() == {"doc_id": 1, "chars_": 5, "_text": 6, "row": 7, "tokens": 2, "chars": 3}
    assert tc.count_tokens(df.limit(0)).count() == 0


# ---- WARC ------------------------------------------------------------------------


def test_archives_round_trip(spark):
    big = "é" * 300000
    rows = [(3, "http://a/é \r\n x", big, 1), (1, None, big, 1), (2, "http://b", None, 1), (4, "u", "", 1), (5, "u", "short", 1), (6, "u", "short", 1),
            (None, "u", big, 1), (1, None, big, 1), (7, "u", "x" * 100, 1), (8, "u", "x" * 100, 1), (9, "u", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n" * 9, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    files = warc.write_archives(pages, file_bytes=100000)
    assert files.count() > 1
    index = warc.normalise(files)
    out = warc.read_archives(index).collect()
    assert len(out) == len(rows)
    for r in out:
        html = next(h or "" for p, _, h, _ in rows if p == r["page_id"]).encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(html), hashlib.sha256(html).hexdigest())
        assert r["payload"] == (html if r["record_type"] == "response" else None)
    kinds = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in out)
    assert kinds == [(0, "revisit", 1), (1, "response", None), (1, "response", None), (2, "response", None), (3, "revisit", 1), (4, "response", None),
                     (5, "response", None), (6, "response", None), (7, "response", None), (8, "revisit", 7), (9, "response", None)]
    # Each record is a gzip member of its own, at the offset of the index and of the sidecar.
    for path in {r["path"] for r in index.select("path").collect()}:
        local = path.removeprefix("file:")
        data = open(local, "rb").read()
        side = [json.loads(x) for x in open(local + ".idx")]
        assert sum(x["length"] for x in side) == len(data)
        for x in side:
            assert gzip.decompress(data[x["offset"]:x["offset"] + x["length"]]).startswith(b"WARC/1.1\r\n")
    for path in (r["path"].removeprefix("file:") for r in files.collect()):
        data = open(path, "rb").read()
        assert gzip.decompress(data).count(b"WARC-Record-ID: ") >= 1 and len(re.findall(rb"\x1f\x8b\x08", data[:3])) == 1


def _foreign(kind: str, rid: str, block: bytes, *more: str) -> bytes:
    head = ["WARC/1.0", f"warc-type:{kind}", f"WARC-RECORD-ID: <urn:uuid:{rid}>", *more, f"content-length:{len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def _foreign_file(path, records, members):
    data = b"".join(records) if members == 1 else None
    with open(path, "wb") as f:
        f.write(gzip.compress(data) if members == 1 else b"".join(gzip.compress(r) for r in records))


@pytest.mark.parametrize("members", [1, 6])
def test_archives_of_other_writers(spark, tmp_path, members):
    body = "body é".encode() * 40
    http = b"HTTP/1.1 200 OK\r\ncontent-length: %d\r\n\r\n" % len(body)
    sha1 = base64.b32encode(hashlib.sha1(body).digest()).decode()
    kind = "Content-Type: application/http; msgtype=response"
    records = [
        _foreign("warcinfo", "a", b"software: x\r\n", "Content-Type: application/warc-fields"),
        _foreign("request", "b", b"GET / HTTP/1.1\r\nHost: h\r\n\r\n", "WARC-Target-URI: http://h/", "Content-Type: application/http; msgtype=request"),
        b"\r\n" + _foreign("response", "c", http + body, "WARC-Target-URI:", "\thttp://h/", f"WARC-Payload-Digest: sha1:{sha1}", kind),
        _foreign("revisit", "d", http, "WARC-Refers-To: <urn:uuid:c>", f"WARC-Payload-Digest: sha1:{sha1}", kind),
        _foreign("resource", "e", body, "WARC-Payload-Digest: unknown:1"),
        _foreign("metadata", "f", b"")]
    _foreign_file(tmp_path / "x.warc.gz", records, members)
    files = spark.createDataFrame([(f"file://{tmp_path}/x.warc.gz",)], "path string")
    got = {r["record_id"][10:-1]: r for r in warc.read_archives(warc.normalise(files)).collect()}
    assert {k: (r["record_type"], r["url"], r["payload"]) for k, r in got.items()} == {
        "a": ("warcinfo", None, b"software: x\r\n"), "b": ("request", "http://h/", b""), "c": ("response", "http://h/", body),
        "d": ("revisit", None, None), "e": ("resource", None, body), "f": ("metadata", None, b"")}
    assert {r["payload_bytes"] for k, r in got.items() if k in "cde"} == {len(body)} and got["d"]["refers_to_id"] == "<urn:uuid:c>"
    assert got["c"]["payload_digest"] == got["e"]["payload_digest"] == hashlib.sha256(body).hexdigest() and got["d"]["payload_digest"] is None
    assert all(r["page_id"] is None and r["refers_to"] is None for r in got.values())


def test_damaged_archives_fail(spark, tmp_path):
    wrong = _foreign("resource", "a", b"body", "WARC-Payload-Digest: sha1:" + hashlib.sha1(b"other").hexdigest())
    _foreign_file(tmp_path / "wrong.warc.gz", [wrong], 1)
    _foreign_file(tmp_path / "short.warc.gz", [wrong[:-10]], 1)
    for name, what in (("wrong", "is damaged"), ("short", "ends inside a record")):
        files = spark.createDataFrame([(f"file://{tmp_path}/{name}.warc.gz",)], "path string")
        with pytest.raises(Exception, match=what):
            warc.read_archives(warc.normalise(files)).collect()


def test_no_pages(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.normalise(warc.write_archives(none))).count() == 0


# ---- Katz ------------------------------------------------------------------------


def near(got, want):
    assert (got["held_out"], got["n_tokens"], got["n_known"], got["train_tokens"]) == want[:4]
    assert got["base_score"] == pytest.approx(want[4], abs=1e-6) and got["score"] == pytest.approx(want[5], abs=1e-6)


def test_scores_equal_brute_force_and_beat_the_base(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute.katz(docs, katz.good_turing)
    rows = queries.op5_lm_scoring(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        near(r, want[r["doc_id"]])
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_masses_are_one(spark):
    rnd = random.Random(0)
    vocab = [f"v{i}" for i in range(40)]
    docs = [(i, " ".join(rnd.choices(vocab, weights=range(1, 41), k=rnd.randint(0, 60)))) for i in range(80)] + [(200, "z z"), (None, None)]
    model, scores = katz.train_and_score(spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, block int, codes int"))
    counts = katz._counts_of_counts(model.bigrams)
    for r in katz.context_mass(model, katz.good_turing(counts)).collect():
        assert r["mass"] == pytest.approx(1.0, abs=1e-9)
    p = sum(float(model.word_prob(__import__("numpy").array([r["count"]]))[0]) for r in model.unigrams.collect())
    assert p + model.unknown == pytest.approx(1.0, abs=1e-9)
    want = brute.katz(docs, katz.good_turing)
    for r in scores.collect():
        near(r, want[r["doc_id"]])


def test_katz_edges(spark):
    long = " ".join(f"w{i % 50}" for i in range(30000))
    docs = [(None, None), (1, ""), (2, long), (3, "A a É")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute.katz(docs, katz.good_turing)
    for r in katz.train_and_score(df)[1].collect():
        near(r, want[r["doc_id"]])
    twice = katz.train_and_score(df.union(df))[1]
    assert twice.count() == 8
    assert katz.train_and_score(df.limit(0))[1].count() == 0
    alone = katz.train_and_score(df, held_out=lambda d: True)[1].collect()  # nothing to learn from
    assert all(r["score"] == 0 and r["train_tokens"] == 0 and r["n_known"] == 0 for r in alone)


def test_good_turing_falls_back():
    d = katz.good_turing([0, 100, 40, 25, 16, 12, 10]).values
    assert all(0 < x < 1 for x in d) and list(d) == sorted(d)
    assert katz.good_turing([0, 3, 0, 0, 0, 0, 0]).values[0] == 0.5


#: n1..n6 of the training fold's words and pairs; n5 is a bump that makes raw Good-Turing discounts exceed 1
BUMPED = {"sf0.01": ([47735, 12166, 4990, 2407, 2203, 1012], [184712, 23127, 5984, 1951, 2262, 607]),
          "sf0.1": ([200420, 57120, 23804, 13644, 12859, 6775], [1482341, 227973, 46941, 19718, 17404, 6993])}


@pytest.mark.parametrize("n", [n for both in BUMPED.values() for n in both])
def test_discounts_stay_good_turing_on_a_bump(n):
    """Closed form of Katz's discounts on a line log n = a + b log c: with e = b + 1, c*/c = (1 + 1/c)^e and the cut is 6^e."""
    assert any(not 0 < (c + 1) * n[c] / (c * n[c - 1]) < 1 for c in range(1, 6))
    x, y = [math.log(c) for c in range(1, 7)], [math.log(v) for v in n]
    b = (6 * sum(p * q for p, q in zip(x, y)) - sum(x) * sum(y)) / (6 * sum(p * p for p in x) - sum(x) ** 2)
    want = [((1 + 1 / c) ** (b + 1) - 6 ** (b + 1)) / (1 - 6 ** (b + 1)) for c in range(1, 6)]
    got = katz.good_turing([0, *n]).values
    assert list(got) == pytest.approx(want, abs=1e-12)
    assert all(0 < d < 1 for d in got) and list(got) == sorted(got)


def test_discounts_with_gaps_and_without_a_fall():
    zero = katz.good_turing([0, 5000, 900, 0, 200, 90, 40]).values  # an empty count: its neighbours' counts are spread over it
    x, z = [math.log(c) for c in (1, 2, 4, 5, 6)], [math.log(v) for v in (2 * 5000 / 2, 2 * 900 / 3, 2 * 200 / 3, 90, 40)]
    mx, mz = sum(x) / 5, sum(z) / 5
    e = sum((p - mx) * (q - mz) for p, q in zip(x, z)) / sum((p - mx) ** 2 for p in x) + 1
    assert list(zero) == pytest.approx([((1 + 1 / c) ** e - 6 ** e) / (1 - 6 ** e) for c in range(1, 6)], abs=1e-12)
    assert katz.good_turing([0, 10, 10, 10, 10, 10, 10]).values == tuple((c - 1 / 3) / c for c in range(1, 6))  # no fall: absolute


def test_discounts_of_a_larger_table(spark):
    """The query's own counts of counts on sf0.01, where the raw discounts are not valid."""
    model, _ = katz.train_and_score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text"))
    assert katz._counts_of_counts(model.unigrams)[1:] == BUMPED["sf0.01"][0] and katz._counts_of_counts(model.bigrams)[1:] == BUMPED["sf0.01"][1]
    assert model.d1.values[0] == pytest.approx(0.3833, abs=1e-4)


# ---- tool calls ------------------------------------------------------------------

MESSAGE = "conv_id long, turn long, role string, text string, call_id string, tool string, arguments string, needs array<string>, rank int, id int"
SCHEMA = {"add": {"x": {"type": "number", "required": True, "minimum": 0}, "note": {"type": "string", "enum": ["a", "b"]}}}


def chat(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], MESSAGE)
    return {(r["conv_id"], r["turn"], r["kind"]): r for r in toolcalls.format_tool_chat(df, SCHEMA).collect()}


def call(conv, turn, cid, args='{"x":1}', needs=(), tool="add"):
    return conv, turn, "assistant", None, cid, tool, args, list(needs)


def test_links_errors_and_json(spark):
    got = chat(spark, [
        call(1, 1, "a", '{ "note":"b", "x": 2.50 }'), (1, 2, "tool", 'ok "é"\n', "a", None, None, None), call(1, 3, "b", '{"x":-1,"note":"c","y":1}', ["a", "gone"]),
        call(1, 4, "c", "{bad"), call(1, 5, "d", "[1]"), call(1, 6, "e", "{}", tool="sub"), call(1, 7, "f", '{"note":1}'), (1, 8, "tool", "?", "zz", None, None, None),
        (1, 9, "user", "hi", None, None, None, None), (1, 10, "tool", "early", "late", None, None, None), call(1, 11, "late"),
        (None, None, None, None, None, None, None, None), call(2, 1, "a"), call(2, 2, "a")])
    err = {k: r["errors"] for k, r in got.items()}
    assert err[1, 1, "call"] == [] and got[1, 1, "call"]["json"] == '{"arguments":{"note":"b","x":2.5},"call_id":"a","content":null,"name":"add","role":"assistant"}'
    assert got[1, 2, "result"]["linked_turn"] == 1 and got[1, 2, "result"]["json"] == '{"call_id":"a","content":"ok \\"é\\"\\n","role":"tool"}'
    assert err[1, 3, "call"] == ["range:note", "range:x", "unanswered", "unknown:y", "unresolved:gone"]
    assert err[1, 4, "call"] == ["arguments_not_json", "unanswered"] and json.loads(got[1, 4, "call"]["json"])["arguments"] == "{bad"
    assert err[1, 5, "call"] == ["arguments_not_object", "unanswered"] and err[1, 6, "call"] == ["unanswered", "unknown_tool"]
    assert err[1, 7, "call"] == ["missing:x", "type:note", "unanswered"]
    assert err[1, 8, "result"] == ["orphan_result"] and err[1, 10, "result"] == ["result_not_after_call"]
    assert got[1, 9, "message"]["json"] == '{"content":"hi","role":"user"}' and got[None, None, "message"]["json"] == '{"content":null,"role":null}'
    assert err[2, 1, "call"] == err[2, 2, "call"] == ["duplicate_id", "unanswered"]


def test_topological_rank(spark):
    rnd = random.Random(6)
    rows, needs = [], {}
    for conv in range(6):
        for t in range(12):
            needs[conv, t] = {rnd.randrange(12) for _ in range(rnd.choice([0, 0, 1, 2]))} if conv else {t - 1} - {-1}
            rows.append(call(conv, t, f"c{t}", needs=[f"c{n}" for n in needs[conv, t]]))
    got = chat(spark, rows)
    for conv in range(6):
        deps = {t: needs[conv, t] for t in range(12)}
        behind = set()  # on a cycle, or needing one: what Kahn's rounds cannot free
        free = set()
        while more := {t for t in deps if t not in free and deps[t] <= free}:
            free |= more
        behind = set(deps) - free
        for t in range(12):
            r = got[conv, t, "call"]
            assert (r["rank"] is None) == (t in behind) and ("cyclic" in r["errors"]) == (t in behind)
            if t not in behind:
                assert all((got[conv, n, "call"]["rank"], n) < (r["rank"], t) for n in deps[t])
        if conv == 0:
            assert all(got[0, t, "call"]["rank"] == 0 for t in range(12))


def test_long_chains_take_few_rounds(spark, monkeypatch):
    """A forward chain of 100 calls, one that ends in a cycle, one behind a call with two needs; very long arguments."""
    kept = []
    monkeypatch.setattr(toolcalls, "keep", lambda df, name, real=toolcalls.keep: (kept.append(name), real(df, name))[1])
    rows = [call(1, t, f"c{t}", needs=[f"c{t + 1}"] if t < 99 else []) for t in range(100)]
    rows += [call(2, t, f"c{t}", needs=[f"c{min(t + 1, 30)}"]) for t in range(31)]
    rows += [call(3, t, f"c{t}", needs=[f"c{t + 1}"]) for t in range(10)] + [call(3, 10, "c10", needs=["c11", "c12"]), call(3, 11, "c11"), call(3, 12, "c12", needs=["c13"]), call(3, 13, "c13")]
    rows += [call(4, 1, "long", json.dumps({"x": 1, "note": "a" * 300000}))]
    got = chat(spark, rows)
    assert [got[1, t, "call"]["rank"] for t in range(100)] == list(range(99, -1, -1))
    assert all(got[2, t, "call"]["rank"] is None for t in range(31))
    assert [got[3, t, "call"]["rank"] for t in range(14)] == [12, 11, 10, 9, 8, 7, 6, 5, 4, 3, 2, 0, 1, 0]
    assert got[4, 1, "call"]["errors"] == ["range:note", "unanswered"]
    assert kept.count("call-jumps") <= 9


def test_query_orders_forward_references(spark):
    rows = queries.op7_tool_call_linking(spark, SF).collect()
    calls = {(r["conv_id"], r["turn"]): r["rank"] for r in rows if r["kind"] == "call"}
    assert max(calls.values()) >= 2
    assert all(rank == calls[c, t + 2] + 1 for (c, t), rank in calls.items() if t // 2 % 4 < 3 and (c, t + 2) in calls)
    assert all(r["order_rank"] == calls[r["conv_id"], r["linked_turn"]] for r in rows if r["linked_turn"] is not None)


def test_chat_empty_and_native(spark):
    assert chat(spark, []) == {}
    assert queries.op7_tool_call_linking(spark, SF).count() == spark.read.parquet(f"{SF}/conversations.parquet").count()
    plan = toolcalls.format_tool_chat(spark.createDataFrame([(*call(1, 1, "a"), 1, 2)], MESSAGE), SCHEMA)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# ---- URLs ------------------------------------------------------------------------


def glob(pattern, text):
    return re.fullmatch("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern), text, re.S) is not None


def test_automaton_equals_globs(spark):
    rnd = random.Random(8)
    some = lambda alphabet, n: "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, n)))
    rules = [urls.Rule("block", some("ab.*?", 5), some("/ab*?", 5), f"r{i}") for i in range(60)]
    keys = ["." + some("ab.", 6) + urls.SEP + some("/ab?", 8) for _ in range(300)]
    import pyarrow as pa
    hit = urls.Automaton(rules).match(pa.array(keys))
    assert urls.Automaton(rules).words > 1
    for k, row in zip(keys, hit):
        host, path = k.split(urls.SEP)
        assert row.tolist() == [glob(r.host, host) and glob(r.path, path) for r in rules], k


def test_verdicts(spark):
    rows = ["http://A.Example.NET/en/x?q#f", "https://example.net", "http://x.net/", "xnet://net/a", "ftp://a.example.com/de/y/z", "http://notexample.com/de/",
            "http://a.org/fr/", None, "", "no scheme", "http://cheap-pills.example.com/en/", "a://b://net/", "http://org/fr/#x", "http://é.org/" + "a" * 5000]
    df = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(rows)], "page_id int, url string, host string, _rule int")
    out = urls.url_verdicts(df, queries.SITES + queries.GLOBS)
    assert out.columns == ["page_id", "url", "host", "_host", "_path", "_rule", "_tier", "_verdict"]
    got = {r["page_id"]: (r["_host"], r["_path"], r["_rule"], r["_verdict"]) for r in out.collect()}
    assert got[0] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[1] == ("example.net", "", None, "allow") and got[2] == ("x.net", "/", "net/", "block") and got[3] == ("net", "/a", "net/", "block")
    assert got[4][2:] == ("example.com/de/", "block") and got[5][2:] == (None, "allow") and got[6][2:] == ("org/fr/", "allow")
    assert got[7] == got[8] == got[9] == ("", "", None, "allow") and got[10][3] == "block" and got[11][:2] == ("b:", "//net/")
    assert got[12][2] == "org/fr/" and got[13][0] == "é.org"
    assert urls.url_verdicts(df.limit(0), queries.SITES).count() == 0 and urls.url_verdicts(df, []).where(F.col("_verdict") == "allow").count() == len(rows)


# ---- Katz models of other orders, stored models ------------------------------------


def _sentences(n, seed=5, first=0):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(25)]
    phrases = [" ".join(rnd.choices(vocab, k=rnd.randint(3, 7))) for _ in range(30)]
    return [(first + i, " ".join(rnd.choices(phrases, weights=[1 / (k + 1) for k in range(30)], k=rnd.randint(0, 6))) + rnd.choice(["", " " + rnd.choice(vocab).upper()]))
            for i in range(n)]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_of_any_order(spark, order):
    docs = _sentences(120) + [(500, None), (501, ""), (None, "w1 w2 w3"), (502, "never seen words"), (503, " ".join(f"w{i % 9}" for i in range(20000)))]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, grams1 int").repartition(5)
    model, scores = katz.train_and_score(df, order=order)
    want = brute.katz_of_order(docs, order)
    rows = scores.collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r["held_out"] == want[r["doc_id"]][0] and r["score"] == pytest.approx(want[r["doc_id"]][1], rel=1e-9, abs=1e-7)
    for n in range(2, order + 1):
        for r in katz.context_mass(model, model.discounts[n - 1], n).collect():
            assert r["mass"] == pytest.approx(1.0, abs=1e-9)


def test_longer_context_helps_on_held_out_text(spark):
    df = spark.createDataFrame(_sentences(400), "doc_id long, text string")
    got = [katz.train_and_score(df, order=n)[1].where("held_out").agg({"score": "sum"}).first()[0] for n in (1, 2, 3)]
    assert got[0] < got[1] < got[2]


def test_a_stored_model_scores_other_texts(spark):
    from fieldmodes.session import scratch_path
    docs, new = _sentences(80), [*_sentences(30, 9, 1000), (2000, None), (2001, "w1 unseen w2"), (2002, "")]
    train = spark.createDataFrame(docs, "doc_id long, text string")
    model, scores = katz.train_and_score(train, order=3)
    path = scratch_path(spark, "model")
    katz.save(model, path)
    stored = katz.load(spark, path)
    assert stored.order == 3 and stored.without_tables() == model.without_tables()
    want = brute.katz_of_order(docs, 3, new=new)
    got = katz.score(stored, spark.createDataFrame(new, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in got} == {d for d, _ in new}
    for r in got:
        assert r["held_out"] and r["score"] == pytest.approx(want[r["doc_id"]][1], rel=1e-9, abs=1e-7)
    again = {r["doc_id"]: r for r in katz.score(stored, train).collect()}  # the training texts: as scored beside the training
    for r in scores.collect():
        assert {k: v for k, v in r.asDict().items() if k != "held_out"} == {k: v for k, v in again[r["doc_id"]].asDict().items() if k != "held_out"}
    assert katz.score(stored, train.limit(0)).count() == 0


def test_query_agrees_with_independent_discounts(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute.katz_of_order(docs, 2)
    for r in queries.op5_lm_scoring(spark, SF).collect():
        assert r["score"] == pytest.approx(want[r["doc_id"]][1], rel=1e-9)
    for n in BUMPED.values():
        for counts in n:
            have = [c for c, k in enumerate(counts, 1) for _ in range(k)]
            assert brute.discounts(have) == pytest.approx(list(katz.good_turing([0, *counts]).values), abs=1e-12)
