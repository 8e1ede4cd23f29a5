"""The pipeline against a plain Python version of all its stages."""

import corpus_pipeline
import sentencepiece

from fieldmodes.llm import pieces, quality
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_run_equals_brute_force(spark):
    docs = sorted(tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect())
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = brute.quality([d[:3] for d in docs], labels, quality.CUTOFFS)
    docs = [d for d in docs if kept[d[0]]]
    comp = brute.components({d[0]: brute.fingerprint(d[1]) for d in docs})
    docs = [d for d in docs if comp[d[0]] == d[0]]
    gone = brute.substrings([d[:2] for d in docs])
    docs = [(i, brute.cut(t, gone[i][1]) if any(gone[i][1]) else t, la, s, n) for i, t, la, s, n in docs if not gone[i][0] or not all(gone[i][1])]
    docs = [(i, t, la, s, len(t) if any(gone[i][1]) else n) for i, t, la, s, n in docs]
    docs = [d for d in docs if not brute.leaked(d[1], bench)]
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    want = {d[0]: (*d, sp.encode(d[1])) for d in docs}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"]: (r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], r["ids"]) for r in rows} == want
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in rows) and len(rows) == len(want)


def test_stages_on_odd_rows(spark):
    """Null ids and texts, repeated rows, an empty table, extra columns that clash; the columns stay."""
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text, None, None, None, 1), (1, text + " x", "en", "s", 5, 1), (1, text + " x", "en", "s", 5, 1), (None, text, None, None, None, 1), (2, None, "en", None, None, 1), (3, "", None, "s", 0, 1),
            (4, " ".join(f"v{i}" for i in range(40000)), "fr", "s", 1, 1)]
    names = ["row", "ids", "n_tokens", "round_trip", "decoded", "_n_removed", "n_removed", "_text", "text_hash", "hash", "spans", "stratum", "failed_rules",
             "kept", "_leaked", "n", "all", "_n_words", "id"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} long" for c in names)
    width = 5 + len(names)
    for rows in ([(*r, *range(7, 6 + len(names))) for r in rows], []):
        df = spark.createDataFrame(rows, schema)
        docs = df
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, SF)
            assert docs.columns[:width] == df.columns and (len(docs.columns) == width) == (k < 4)
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.columns[width:] == ["ids_", "n_tokens_", "round_trip_"]
        out = docs.collect()
        assert sorted(r["doc_id"] for r in out) == ([1, 4] if rows else [])  # the copies of a row go
        assert all(r["round_trip_"] and [r[c] for c in names] == [1, *range(7, 6 + len(names))] for r in out)
