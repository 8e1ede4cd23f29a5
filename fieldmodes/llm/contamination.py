"""Operator 6, benchmark decontamination by spaced-seed hashing.  DataFrame functions only.

A document is contaminated by a benchmark item when ``WINDOW`` consecutive words
of the item line up with as many words of the document and at most
``SUBSTITUTIONS`` of the pairs differ.  Words are compared in lower case (A-Z)
without ``.,;:!?"()``.

Search: each mask keeps six positions of a stretch and ignores the others.  The
masks are lossless: whichever ``SUBSTITUTIONS`` of the ``WINDOW`` positions
differ, one mask has a placement inside the window whose kept positions all
agree.  So the join of the masked hashes of benchmark and documents finds every
contaminated pair.  Of the document a hit takes on only the words that a window
around its placement can reach, at most 18, and these are compared in full: no
join after the search holds the words of a text.

Items shorter than the window are matched whole and exactly, through a mask of
their own length.  Defined cases: null or empty texts and items without words
match nothing; repeated documents are judged row by row, repeated items each
count, though equal word lists are searched once; null item ids are reported as
null.  The benchmark's hashes and, one row a word list, its words are broadcast
only if the hashes, at a measured count, fit ``BROADCAST_ROWS`` and the words, at
measured bytes, ``BROADCAST_BYTES``; beyond either the joins shuffle.  Then the
placements that a bit table of the benchmark's hashes rules out are dropped where
they arise; the table, of at most ``FILTER_BLOCKS`` rows, is all that is broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmodes.llm.tables import keep, packed, unpacked

WINDOW, SUBSTITUTIONS = 13, 2
MASKS = ((0, 1, 4, 5, 6, 7), (0, 1, 2, 6, 8, 9))
UPPER, LOWER, DROPPED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", '.,;:!?"()'
WHITE = r"[\x20\x09-\x0D]+"
BROADCAST_ROWS = 200_000  # of (mask, hash, item number, place), 40 bytes each
BROADCAST_BYTES = 16 << 20  # of the items' words, 16 bytes a word besides its own
FILTER_BLOCKS = 1 << 20  # of 64 bits; at 4 hashes a block about 0.5 % of the other placements pass
BEFORE = WINDOW - min(m[-1] + 1 for m in MASKS)  # words that a window with a placement can have before it


def plain_words(text: Column) -> Column:
    """Lower-cased words without punctuation; null: none."""
    return F.filter(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER + DROPPED, LOWER), WHITE), lambda w: w != "")


def _masked(words: str, masks: list[tuple[int, ...]]) -> Column:
    """array<struct<mask, place, hash>> of every placement of every mask on the word hashes in ``words``."""
    def of(k: int, mask: tuple[int, ...]) -> Column:
        span = mask[-1] + 1
        places = F.when(F.size(words) >= span, F.sequence(F.lit(0), F.size(words) - span)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.struct(
            F.lit(k).alias("mask"), i.alias("place"), F.xxhash64(*[F.col(words)[i + F.lit(p)] for p in mask]).alias("hash")))
    return F.concat(*[of(k, m) for k, m in enumerate(masks)])


def _placed(rows: DataFrame, columns: list[str], masks: list[tuple[int, ...]]) -> DataFrame:
    """``columns`` of ``rows`` with (mask, place, hash) of every placement of every mask on ``ids``, as ``_masked`` gives
    them; built from plain column expressions, which run in generated code.  A mask that does not fit has no hash."""
    places = rows.where(F.size("ids") > 0).select(*columns, "ids", F.explode(F.sequence(F.lit(0), F.size("ids") - 1)).alias("place"))
    return places.select(*columns, "place", F.inline(F.array(*[F.struct(
        F.lit(k).alias("mask"), F.when(F.col("place") + m[-1] < F.size("ids"), F.xxhash64(*[F.get("ids", F.col("place") + p) for p in m])).alias("hash"))
        for k, m in enumerate(masks)])))


def _hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _near(words: str, place: str) -> list[Column]:
    """``near``, the words that a window with the placement at ``place`` can have, and ``near_at``, where it is in them."""
    before = F.least(F.col(place), F.lit(BEFORE))
    return [F.slice(words, F.col(place) - before + 1, before + WINDOW).alias("near"), before.alias("near_at")]


def _verified(near: Column, near_at: Column, test: Column, item_place: Column) -> Column:
    """Some window of the item that has the placement at ``item_place`` has few enough differences when that placement
    stands at ``near_at`` in the document's words ``near``.

    A window beyond ``near`` does not have the placement or is not in the document."""
    n = F.size(test)
    need = F.when(n >= WINDOW, F.lit(WINDOW - SUBSTITUTIONS)).otherwise(n)
    width = F.least(n, F.lit(WINDOW))
    at = near_at - item_place
    starts = F.sequence(F.greatest(item_place - BEFORE, F.lit(0)), F.least(item_place, n - width))
    same = lambda s: F.transform(F.slice(test, s + 1, width), lambda w, j: F.coalesce(F.get(near, at + s + j) == w, F.lit(False)).cast("int"))
    return F.exists(starts, lambda s: (
        (at + s >= 0) & (at + s + width <= F.size(near)) & (F.aggregate(same(s), F.lit(0), lambda a, x: a + x) >= need)))


def _block_and_bits(blocks: int) -> list[Column]:
    """Where the bit table keeps ``hash``: one of ``blocks`` (a power of two) and three bits of its 64."""
    def bit(k: int) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright("hash", k).bitwiseAND(F.lit(63).cast("long")).cast("int"))
    return [F.col("hash").bitwiseAND(F.lit(blocks - 1).cast("long")).alias("block"), bit(40).bitwiseOR(bit(48)).bitwiseOR(bit(56)).alias("bits")]


def _possible(placed: DataFrame, tests: DataFrame, n_tests: int) -> DataFrame:
    """Rows of ``placed`` whose ``hash`` the bit table of ``tests`` does not rule out."""
    blocks = min(FILTER_BLOCKS, 1 << max(6, (n_tests // 4).bit_length()))
    table = keep(tests.select(*_block_and_bits(blocks)).groupBy("block").agg(F.bit_or("bits").alias("bits_there")), "benchmark-bits")
    marked = placed.select("*", *_block_and_bits(blocks)).join(table.hint("broadcast"), "block")
    return marked.where(F.col("bits").bitwiseAND(F.col("bits_there")) == F.col("bits")).select(*placed.columns)


def text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))


def leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
          item_text_col: str = "text") -> DataFrame:
    """(text_hash, items): the distinct items found in each text that has any, sorted; kept."""
    named = benchmark.select(F.col(f"`{item_col}`").alias("item"), plain_words(F.col(f"`{item_text_col}`")).alias("test")).where(F.size("test") > 0)
    items = keep(named.select("test").distinct().select(F.monotonically_increasing_id().alias("no"), "test"), "benchmark-words")
    names = keep(named.join(items, "test").select("no", "item").distinct(), "benchmark-names")
    # Lengths below the window, at most WINDOW - 1 values: each has a mask of its own.
    short = sorted(r[0] for r in items.where(F.size("test") < WINDOW).select(F.size("test")).distinct().collect())
    masks = [*MASKS, *[tuple(range(n)) for n in short]]
    tests = items.withColumn("ids", _hashed(F.col("test"))).select("no", F.size("test").alias("n"), F.inline(_masked("ids", masks)))
    fits = (F.col("n") >= WINDOW) & (F.col("mask") < len(MASKS))
    whole = reduce(lambda a, b: a | b, [(F.col("n") == n) & (F.col("mask") == len(MASKS) + k) for k, n in enumerate(short)], F.lit(False))
    tests = keep(tests.where(fits | whole).select("mask", "hash", "no", F.col("place").alias("item_place")), "benchmark-seeds")
    rows = docs.select(text_hash(text_col).alias("text_hash"), plain_words(F.col(f"`{text_col}`")).alias("words")).withColumn("ids", _hashed(F.col("words")))
    placed = _placed(rows, ["text_hash", "words"], masks)
    n_tests = tests.count()
    n_bytes = items.agg(F.coalesce(F.sum(F.aggregate("test", F.lit(0).cast("long"), lambda a, w: a + F.octet_length(w) + 16)), F.lit(0))).first()[0]
    if n_tests <= BROADCAST_ROWS and n_bytes <= BROADCAST_BYTES:
        # The words are at hand where a hit is found: verify it there.
        hits = placed.join(F.broadcast(tests), ["mask", "hash"]).select("text_hash", "no", "item_place", *_near("words", "place"))
        hits = hits.join(F.broadcast(items), "no")
    else:
        hits = _possible(placed, tests, n_tests).select("mask", "hash", "text_hash", *_near("words", "place"))
        hits = hits.join(tests, ["mask", "hash"]).drop("mask", "hash").join(items, "no")
    found = hits.where(_verified(F.col("near"), F.col("near_at"), F.col("test"), F.col("item_place"))).select("text_hash", "no").distinct()
    found = found.join(names, "no").select("text_hash", "item")
    # An item is found once per text, whatever the number of hits; an array holds benchmark items only.
    return keep(found.distinct().groupBy("text_hash").agg(F.array_sort(F.array_compact(F.collect_list("item"))).alias("items"),
                                                          F.count_if(F.col("item").isNull()).alias("nulls"))
                .select("text_hash", F.when(F.col("nulls") > 0, F.concat("items", F.array(F.lit(None)))).otherwise(F.col("items")).alias("items")), "benchmark-leaks")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text") -> DataFrame:
    """``docs`` plus ``_leaked``: array of the distinct item ids found in the text, sorted, null last (empty: clean)."""
    found = leaks(docs, benchmark, text_col, item_col, item_text_col)
    rows = docs.select(packed(docs, text_col), F.col(f"`{text_col}`").alias("text"), text_hash(text_col).alias("text_hash"))
    leaked = F.coalesce("items", F.array().cast(dict(found.dtypes)["items"]))
    return rows.join(found, "text_hash", "left").select(*unpacked(docs, text_col, "text", ("_leaked",)), leaked.alias("_leaked"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
               item_text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose text has no benchmark passage."""
    found = leaks(docs, benchmark, text_col, item_col, item_text_col).select("text_hash")
    return docs.join(found, F.xxhash64(F.coalesce(docs[f"`{text_col}`"].cast("string"), F.lit(""))) == found["text_hash"], "left_anti")
