"""Operator 2, token counts as delta-maintained rollups.

``Rollup`` keeps, under one folder of the shared store, what is needed to know
the totals by (source, language, tokenizer version) without counting again:

* ``state/batch=<n>``: the documents a batch touched, with their counts (null: deleted);
* ``deltas/batch=<n>``: signed sums of the batch by (source, lang, version);
* ``commits/batch=<n>``: written last; only committed batches are read.

A batch brings inserts, deletes and revised counts.  For each (document, version)
it touches, the current entry is taken back (negative) and the new one added
(positive), so totals are sums of deltas: nothing else is read.  A batch number
that is committed is skipped, an uncommitted one is overwritten, so a batch can
be sent any number of times.  Batches are applied in the order of their numbers.

Defined cases: a delete of an unknown document and a null id change nothing; an
insert of a known document is a revision; equal rows of a batch count once, and
of different rows for one (document, version) a delete wins, then the greatest
(tokens, chars, source, lang); null source and lang are values of their own; an
empty batch commits empty tables.  ``count_tokens`` counts null texts as empty and
cuts very long ones where the pattern cuts.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmodes.llm.tables import free_name, packed, prepare, unpacked
from fieldmodes.llm.words import slices

VOCAB = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split pattern the vocabulary was made with (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEYS = ["source", "lang", "version"]


@functools.lru_cache(maxsize=2)
def _encoding(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def count_tokens(docs: DataFrame, vocab_path: str = VOCAB, pattern: str = PATTERN, text_col: str = "text", out_col: str = "tokens",
                 chars_col: str = "chars") -> DataFrame:
    """``docs`` with the text replaced by ``out_col`` (bigint) and ``chars_col`` (bigint); a null text has 0 of both.

    Other columns pass through; one that has the name of a count is kept under that name with ``_`` behind it.
    The vocabulary file (fixed size) is read on the driver and sent to the tasks."""
    for c in [c for c in docs.columns if c != text_col and c.lower() in (out_col.lower(), chars_col.lower())]:
        docs = docs.withColumnRenamed(c, free_name(docs, c))
    with open(vocab_path, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    slim = docs.select(packed(docs, text_col), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(ranks.value, pattern)
        for b in slices(batches, "text", 1 << 20):
            n = [sum(len(enc.encode_ordinary(part)) for part in _parts(t)) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["row"], pa.array(n, pa.int64()), pc.utf8_length(b["text"]).cast(pa.int64())], names=["row", "n", "c"])

    schema = slim.select("row", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("c")).schema
    rest = unpacked(docs, text_col, "n", (text_col,))
    return slim.mapInArrow(run, schema).select(*rest, F.col("n").alias(out_col), F.col("c").alias(chars_col))


def _parts(text: str, size: int = 1 << 16) -> Iterator[str]:
    """A text cut where the pattern always cuts (before a space between letters), so counts add up."""
    at = 0
    while len(text) - at > size:
        cut = at + size
        while cut > at and not (text[cut] == " " and text[cut - 1].isascii() and text[cut - 1].isalpha() and text[cut + 1 : cut + 2].isascii() and text[cut + 1 : cut + 2].isalpha()):
            cut -= 1
        if cut == at:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


class Rollup:
    def __init__(self, spark: SparkSession, folder: str):
        prepare(spark)
        self.spark, self.folder = spark, folder.rstrip("/")

    # -- store -----------------------------------------------------------------

    def _path(self, table: str, batch: int) -> str:
        return f"{self.folder}/{table}/batch={batch}"

    def committed(self) -> list[int]:
        """Numbers of the committed batches, in order."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/commits")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [x.getPath() for x in fs.listStatus(path)]
        return sorted(int(p.getName().split("=")[1]) for p in names if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def _read(self, table: str, schema: str) -> DataFrame:
        paths = [self._path(table, n) for n in self.committed()]
        if not paths:
            return self.spark.createDataFrame([], schema + ", batch int")
        return self.spark.read.option("basePath", f"{self.folder}/{table}").schema(schema + ", batch int").parquet(*paths)

    STATE = "doc_id long, version string, source string, lang string, tokens long, chars long"
    DELTA = "source string, lang string, version string, docs long, tokens long, chars long"

    def state(self) -> DataFrame:
        """(doc_id, version, source, lang, tokens, chars) of the documents there are now."""
        latest = self._read("state", self.STATE).groupBy("doc_id", "version").agg(
            F.max_by(F.struct("source", "lang", "tokens", "chars"), "batch").alias("now"))
        return latest.where("now.tokens IS NOT NULL").select("doc_id", "version", "now.*")

    def totals(self) -> DataFrame:
        """(source, lang, version, docs, tokens, chars): the sums of all deltas; groups without documents are left out."""
        return (self._read("deltas", self.DELTA).groupBy(*KEYS)
                .agg(*[F.sum(c).alias(c) for c in ("docs", "tokens", "chars")]).where("docs <> 0"))

    # -- batches ---------------------------------------------------------------

    def apply(self, batch: int, changes: DataFrame) -> bool:
        """Apply one batch: rows (doc_id, version, op, source, lang, tokens, chars), op insert, revise or delete.

        Returns whether anything was done: a committed batch is not applied again."""
        done = self.committed()
        if batch in done:
            return False
        if done and batch < done[-1]:
            raise ValueError(f"batch {batch} comes after batch {done[-1]}")
        value = F.when(F.col("op") != "delete", F.struct("tokens", "chars", "source", "lang"))
        new = (changes.where("doc_id IS NOT NULL").select("doc_id", "version", value.alias("new"), (F.col("op") == "delete").alias("gone"))
               .groupBy("doc_id", "version").agg(F.max("gone").alias("gone"), F.max("new").alias("new")))
        old = self.state().select("doc_id", "version", F.struct("tokens", "chars", "source", "lang").alias("old"))
        both = new.join(old, ["doc_id", "version"], "left").where("old IS NOT NULL OR NOT gone")
        rows = both.select("doc_id", "version", F.when(~F.col("gone"), F.col("new")).alias("new"), "old")
        # The state rows carry what they replace, so the deltas are read back from them.
        rows.write.mode("overwrite").parquet(self._path("work", batch))
        rows = self.spark.read.schema(rows.schema).parquet(self._path("work", batch))
        rows.select("doc_id", "version", "new.source", "new.lang", "new.tokens", "new.chars").write.mode("overwrite").parquet(self._path("state", batch))
        signed = rows.select("version", F.explode(F.array(F.struct(F.lit(1).alias("sign"), F.col("new").alias("v")),
                                                          F.struct(F.lit(-1).alias("sign"), F.col("old").alias("v")))).alias("s")).where("s.v IS NOT NULL")
        (signed.groupBy("s.v.source", "s.v.lang", "version")
         .agg(F.sum(F.col("s.sign").cast("long")).alias("docs"), F.sum(F.col("s.sign") * F.col("s.v.tokens")).alias("tokens"),
              F.sum(F.col("s.sign") * F.col("s.v.chars")).alias("chars"))
         .where("docs <> 0 OR tokens <> 0 OR chars <> 0").select(*KEYS, "docs", "tokens", "chars")
         .write.mode("overwrite").parquet(self._path("deltas", batch)))
        self.spark.range(1).select(F.lit(batch).alias("id")).write.mode("overwrite").parquet(self._path("commits", batch))
        return True
