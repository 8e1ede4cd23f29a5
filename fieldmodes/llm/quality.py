"""Operator 3, quality rules with risk-controlled thresholds.

Every text gets rule scores (higher is worse).  Cutoffs are not fixed by hand:
a set of cutoffs of a fixed grid is used in a stratum only if the hypothesis "it
rejects more than a share ``p`` of the good documents of the stratum" is refuted
on the labelled documents, that is if the exact binomial tail ``P(Bin(good, p)
<= rejected good)`` is at most the level (the Clopper-Pearson bound).

Sets are tried along paths, each from all rules off to the strictest cutoffs,
one rule one cutoff tighter at a step.  Along a path rejections only grow, and
it ends at the first set that is not refuted, so its steps share one level
(fixed-sequence testing).  Paths of one rule have ``p = alpha / rules`` and are
used together; the path of all rules and those of all rules but one (a single
harmful rule does not hold up the others) bound their union, ``p = alpha``.
``delta`` is split over strata and paths (Bonferroni).  So with confidence
``1 - delta`` all ends of paths are right at once, whichever is used, and no
stratum loses more than ``alpha`` of its good documents to the rules.  Of the
refuted sets of a stratum the one that rejects most labelled documents that are
not good is used; where there is none all rules stay off.

Defined cases: a null text has no words; a null stratum value is a stratum of
its own; a document labelled more than once counts as good only if all its
labels say so; null labels and labels of unknown documents are ignored; without
labels no rule is active.  Repeated rows are judged row by row; very long texts
are counted whole; an empty table gives no rows.  Other columns pass through
``rule_features`` and ``keep_good`` whatever their names (``rule_features``
replaces columns that are named like its counts).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmodes.llm.tables import keep, packed, unpacked
from fieldmodes.llm.words import as_text, slices, split_words, window_hash

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
REPEAT_WINDOW = 8
#: rule -> score of a row; a document is rejected where the score exceeds the cutoff.
RULES = {
    "symbols": lambda: F.col("_n_symbols") / F.col("_n_words"),
    "dup_lines": lambda: F.when(F.col("_n_lines") > 0, F.col("_n_dup_lines") / F.col("_n_lines")).otherwise(F.lit(0.0)),
    "repeats": lambda: F.col("_n_repeat_words") / F.col("_n_words"),
    "long_words": lambda: F.col("_word_chars") / F.col("_n_words"),
    "short_words": lambda: -F.col("_word_chars") / F.col("_n_words"),
}
#: strictest first
CUTOFFS = {
    "symbols": (0.02, 0.05, 0.1, 0.2, 0.4, 0.8),
    "dup_lines": (0.05, 0.1, 0.2, 0.3, 0.5, 0.7),
    "repeats": (0.05, 0.1, 0.15, 0.2, 0.25, 0.3),
    "long_words": (7.0, 8.0, 9.0, 10.0, 12.0, 15.0),
    "short_words": (-4.0, -3.5, -3.0, -2.5, -2.0, -1.5),
}


def _features(texts: pa.Array) -> dict[str, np.ndarray]:
    texts = as_text(texts)
    n = len(texts)
    w = split_words(texts)
    n_words, owner = w.counts, w.owner
    chars = np.zeros(n, dtype=np.int64)
    if len(w.codes):
        lengths = pc.utf8_length(w.vocab).to_numpy(zero_copy_only=False).astype(np.int64)
        chars = np.bincount(owner, weights=lengths[w.codes], minlength=n).astype(np.int64)
    symbols = pc.count_substring_regex(texts, "[#*$%&|<>]").to_numpy(zero_copy_only=False).astype(np.int64)

    lists = pc.split_pattern(texts, "\n")
    lines = lists.flatten()
    line_owner = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
    worded = pc.match_substring_regex(lines, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)
    code = lines.filter(pa.array(worded)).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    line_owner = line_owner[worded]
    n_lines = np.bincount(line_owner, minlength=n)
    distinct = np.unique(line_owner * (int(code.max(initial=0)) + 1) + code)
    n_distinct = np.bincount(distinct // (int(code.max(initial=0)) + 1), minlength=n)

    repeat = np.zeros(n, dtype=np.int64)
    h = window_hash(w.codes.astype(np.uint64), REPEAT_WINDOW)
    if len(h):
        inside = owner[: len(h)] == owner[REPEAT_WINDOW - 1 :]
        starts = np.flatnonzero(inside)
        order = starts[np.lexsort((h[starts], owner[starts]))]
        same = (h[order[1:]] == h[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
        twice = np.zeros(len(order), dtype=bool)
        twice[1:] |= same
        twice[:-1] |= same
        edge = np.zeros(len(w.codes) + 1, dtype=np.int64)
        hit = order[twice]
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + REPEAT_WINDOW, -1)
        covered = np.cumsum(edge[:-1]) > 0
        repeat = np.bincount(owner[covered], minlength=n)
    return {"n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": n_lines - n_distinct,
            "n_repeat_words": repeat, "n_lines": n_lines}


def rule_features(docs: DataFrame, text_col: str = "text", prefix: str = "_", with_text: bool = False) -> DataFrame:
    """All columns but the text (``with_text``: all), plus the counts the rules use (bigint, named ``prefix + name``)."""
    slim = docs.select(packed(docs, text_col), F.col(f"`{text_col}`").cast("string").alias("text"))
    kept = ["row", "text"] if with_text else ["row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            f = _features(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column(c) for c in kept] + [pa.array(f[k].astype(np.int64)) for k in FEATURES],
                                             names=[*kept, *FEATURES])

    schema = slim.select(*kept, *[F.lit(0).cast("long").alias(k) for k in FEATURES]).schema
    without = tuple(prefix + k for k in FEATURES) + (() if with_text else (text_col,))
    return slim.mapInArrow(run, schema).select(*unpacked(docs, text_col, "text", without), *[F.col(k).alias(prefix + k) for k in FEATURES])


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), summed exactly from the point probabilities."""
    if k >= n:
        return 1.0
    logp, logq = math.log(p), math.log1p(-p)
    terms = (math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * logp + (n - i) * logq)
             for i in range(k + 1))
    return min(1.0, math.fsum(terms))


#: (rules tightened in turn, 1 / share of alpha, share of a stratum's delta).  The first are used together.
_R = len(RULES)
PATHS = [((r,), _R, 1 / (6 * _R)) for r in RULES]
PATHS += [(rs, 1, 5 / (6 * (_R + 1))) for rs in (tuple(RULES), *(tuple(r for r in RULES if r != out) for out in RULES))]
OFF = 1 + max(map(len, CUTOFFS.values()))  # level of a document that a rule rejects at no cutoff


def _end_of_path(first: np.ndarray, n: np.ndarray, steps: int, p: float, level: float) -> tuple[int, int, float]:
    """(steps refuted, good documents lost, tail) where ``n`` good documents are first rejected at step ``first``."""
    good, lost = int(n.sum()), np.cumsum(np.bincount(np.minimum(first, steps + 1), weights=n, minlength=steps + 2)).astype(np.int64)
    end = (0, 0, 1.0)
    for step in range(1, steps + 1):
        if step > 1 and lost[step] == end[1] and end[0]:
            end = (step, *end[1:])
        elif (tail := binomial_tail(int(lost[step]), good, p)) <= level:
            end = (step, int(lost[step]), tail)
        else:
            break
    return end


def choose_levels(levels: np.ndarray, good: np.ndarray, n: np.ndarray, alpha: float, delta: float) -> list[tuple[str, int, int, int, float]]:
    """(rule, level, good, rejected, tail) of the rules to use in one stratum.

    ``n`` documents are rejected by rule k from level ``levels[:, k]`` on (1: loosest cutoff, ``OFF``: never);
    ``delta`` is the stratum's share."""
    rules, total = list(RULES), int(n[good].sum())
    alone, ends = {}, []
    for path, parts, share in PATHS:
        at = [rules.index(r) for r in path]
        width, steps = len(path), sum(len(CUTOFFS[r]) for r in path)
        step = np.where(levels[:, at] < OFF, (levels[:, at] - 1) * width + np.arange(1, width + 1), steps + 1).min(axis=1)
        end, lost, tail = _end_of_path(step[good], n[good], steps, alpha / parts, delta * share)
        ends_at = {r: (end // width + (i < end % width), lost, tail) for i, r in enumerate(path) if end > i}
        if parts > 1:
            alone |= ends_at
        else:
            ends.append(ends_at)

    def caught(chosen: dict) -> tuple[int, int]:
        gone = np.zeros(len(n), dtype=bool)
        for r, (level, *_) in chosen.items():
            gone |= levels[:, rules.index(r)] <= level
        return int(n[gone & ~good].sum()), sum(level for level, *_ in chosen.values())

    best = max([alone, *ends], key=caught)  # the first of equals
    return [(r, level, total, lost, tail) for r, (level, lost, tail) in best.items()]


def fit_cutoffs(feats: DataFrame, labels: DataFrame, id_col: str = "doc_id", stratum_col: str = "lang",
                alpha: float = 0.02, delta: float = 0.05, good: str = "quality = 1") -> DataFrame:
    """(stratum, rule, cutoff, good, rejected, tail): the chosen cutoff of each stratum and rule.

    ``feats`` is the output of :func:`rule_features`; ``good`` is an SQL condition on a label row.
    ``rejected`` and ``tail`` are those of the path that ends at the cutoff.  Documents without words
    are left out (no rule is defined on them)."""
    lab = (labels.select(F.col(f"`{id_col}`").alias("_id"), F.expr(good).alias("_good"))
           .where("_id IS NOT NULL AND _good IS NOT NULL").groupBy("_id").agg(F.min("_good").alias("_good")))
    # Scores that fall between the same cutoffs are one row: 7 ** rules rows a stratum and label at most.
    level = [F.coalesce(*[F.when(score() > c, F.lit(k + 1)) for k, c in enumerate(CUTOFFS[r][::-1])], F.lit(OFF)).alias(r)
             for r, score in RULES.items()]
    stats = (feats.where("_n_words > 0").join(lab, F.col(id_col) == F.col("_id"))
             .select(F.coalesce(F.col(f"`{stratum_col}`").cast("string"), F.lit("\u0000null")).alias("stratum"), F.col("_good").alias("good"), *level)
             .groupBy("stratum", "good", *RULES).agg(F.count("*").alias("n")))
    stats = keep(stats, "quality-stats")
    strata = stats.where("good").agg(F.count_distinct("stratum").alias("strata"))

    def choose(got: pa.Table) -> pa.Table:
        levels = np.stack([got[r].to_numpy() for r in RULES], axis=1)
        is_good = got["good"].to_numpy()
        rows = choose_levels(levels, is_good, got["n"].to_numpy(), alpha, delta / max(got["strata"][0].as_py(), 1)) if is_good.any() else []
        out = [(got["stratum"][0].as_py(), r, CUTOFFS[r][-k], *rest) for r, k, *rest in rows]
        return pa.Table.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(
            (pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.float64()))], names=["stratum", "rule", "cutoff", "good", "rejected", "tail"])

    return (stats.crossJoin(F.broadcast(strata)).groupBy("stratum")  # one row
            .applyInArrow(choose, "stratum string, rule string, cutoff double, good long, rejected long, tail double"))


def judge(feats: DataFrame, cutoffs: DataFrame, stratum_col: str = "lang") -> DataFrame:
    """``feats`` plus ``failed_rules``: names of the active rules each row breaks (empty: none)."""
    wide = keep(cutoffs.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("_cut")),
                "quality-cutoffs")  # one row per stratum
    key = F.coalesce(F.col(f"`{stratum_col}`").cast("string"), F.lit("\u0000null"))
    broken = F.filter(F.array(*[F.when((F.col("_n_words") > 0) & (score() > F.col("_cut")[r]), F.lit(r))
                                for r, score in RULES.items()]), lambda r: r.isNotNull())
    return (feats.withColumn("_stratum", key).join(wide.withColumnRenamed("stratum", "_stratum"), "_stratum", "left")
            .withColumn("failed_rules", broken).drop("_cut", "_stratum"))


BASE_FAILED = "_n_words < 20 OR 100 * _n_repeat_words > 30 * _n_words"


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  stratum_col: str = "lang", alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """(id, stratum, counts, ``base_failed``, ``failed_rules``, ``kept``) for every row of ``docs``."""
    feats = keep(rule_features(_slim(docs, id_col, text_col, stratum_col)), "quality-features")
    out = judge(feats, fit_cutoffs(feats, labels.withColumn("id", F.col(f"`{id_col}`")), "id", "stratum", alpha, delta), "stratum")
    return (out.withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
            .select("id", "stratum", *[F.col("_" + f).alias(f) for f in FEATURES], "base_failed", "failed_rules", "kept"))


def _slim(docs: DataFrame, id_col: str, text_col: str, stratum_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{stratum_col}`").cast("string").alias("stratum"),
                       F.col(f"`{text_col}`").cast("string").alias("text"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang",
              alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """Rows of ``docs`` that the base rules and the chosen cutoffs keep.

    One pass counts and fits the cutoffs on the labelled rows, a second counts, judges and filters: texts are
    read twice and never shuffled."""
    feats = rule_features(_slim(docs, id_col, text_col, stratum_col))
    cutoffs = fit_cutoffs(feats, labels.withColumn("id", F.col(f"`{id_col}`")), "id", "stratum", alpha, delta)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("all"), F.col(f"`{stratum_col}`").cast("string").alias("stratum"),
                       F.col(f"`{text_col}`").cast("string").alias("text"))
    judged = judge(rule_features(rows), cutoffs, "stratum")
    return judged.where(~F.expr(BASE_FAILED) & (F.size("failed_rules") == 0)).select(*[F.col(f"all.`{c}`").alias(c) for c in docs.columns])
