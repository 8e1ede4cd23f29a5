import random

import pyarrow as pa
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

from fieldmodes.llm import pieces as P
from fieldmodes.llm.queries import op1_sentencepiece

RND = random.Random(1)
TEXTS = [None, "", " ", "  a  b", "x\ny", "日本語 テスト", "😀😀 a", "a" * 480, "".join(RND.choice("abcdeiou") for _ in range(1500)), "▁a ▁▁ b",
         " " * 300, "".join(RND.choice("ab ▁c\n\té😀") for _ in range(1500)), "\x00a", "The quick brown fox; el niño comió. " * 30]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=P.MODEL)


@pytest.mark.parametrize("chunk", [7, 100, 32768])
def test_ids_equal_the_library(spark, library, chunk):
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in enumerate(TEXTS)], "doc_id int, text string, uid string, row int")
    out = P.encode(df, chunk_chars=chunk)
    assert out.columns == ["doc_id", "text", "uid", "row", "ids"]
    rows = {r["doc_id"]: r for r in P.decode(out).collect()}
    assert len(rows) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        assert rows[i]["ids"] == (None if t is None else library.encode(t)), i
        assert rows[i]["uid"] == "x" and rows[i]["row"] == 5
        assert rows[i]["decoded"] == (None if t is None else t.replace("▁", " "))


def test_query_on_the_table(spark, library):
    rows = op1_sentencepiece(spark, "/root/testdata/sf0.001").collect()
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(text)
    for r in rows:
        assert r["ids"] == library.encode(text[r["doc_id"]] or "") and r["round_trip"] and r["n_tokens"] == len(r["ids"])


def test_empty_table_and_replaced_column(spark):
    df = spark.createDataFrame([], "doc_id long, text string, ids string")
    assert P.encode(df).columns == ["doc_id", "text", "ids"] and P.encode(df).count() == 0
    only = P.encode(spark.createDataFrame([("a b",), ("a b",)], "text string"))
    assert only.columns == ["text", "ids"] and only.count() == 2


def unigram(pieces):
    m = pb.ModelProto()
    m.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces, m.normalizer_spec.escape_whitespaces = True, False, True
    m.pieces.add(piece="<unk>", score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    for p, s in pieces.items():
        m.pieces.add(piece=p, score=s, type=pb.ModelProto.SentencePiece.NORMAL)
    return P.Model(m.SerializeToString())


def test_unigram_scan_finds_the_best_path():
    rnd = random.Random(3)
    pieces = {c: -rnd.uniform(4, 8) for c in "abc▁"}
    while len(pieces) < 30:
        pieces["".join(rnd.choice("abc") for _ in range(rnd.randint(2, 5)))] = -rnd.uniform(2, 9)
    m = unigram(pieces)
    for n in (5, 50, 700):  # 700: one stretch, through the scan over blocks
        text = "".join(rnd.choice("abc") for _ in range(n))
        ids = m.encode_clean(pa.array([text]))[0].as_py()
        assert "".join(m.piece_of[i] for i in ids) == text
        best = [0.0] + [-1e18] * n
        for e in range(1, n + 1):
            best[e] = max(best[b] + pieces[text[b:e]] for b in range(max(0, e - 5), e) if text[b:e] in pieces)
        assert sum(m.score[i] for i in ids) == pytest.approx(best[n], abs=1e-4)


def test_bad_ids_fail(spark):
    with pytest.raises(Exception, match="outside the model"):
        P.decode(spark.createDataFrame([([99999999],)], "ids array<int>")).collect()
