"""Operator 9, URL filter by a bit-parallel wildcard automaton.

A rule is an action with a host glob and a path glob (``*``: any bytes, ``?``:
one byte).  All rules are packed into one multiword Shift-And automaton: a bit
per pattern byte plus a start bit, the bits of all patterns side by side in
64-bit words.  A byte ``c`` of the URL moves every pattern at once:

    D = ((D << 1) & ACCEPT[c]) | (D & STAY[c])

where ACCEPT has the bits whose pattern byte takes ``c`` and STAY those that a
``*`` keeps alive on ``c``.  All URLs of a batch advance in step.

The text matched is canonical: ``.`` + host in lower case + a separator + path
+ query, no fragment.  A ``*`` of the host glob never crosses the separator.

Verdict: of the rules of the lowest tier that match, the one with the longest
glob text wins (ties: block, then the smaller text); if none matches, the
default.  Null and unparsable URLs have an empty host and path and get the
default unless a rule matches them; repeated rows are judged row by row.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmodes.llm.tables import packed, unpacked
from fieldmodes.llm.words import slices

SEP = "\x01"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?"


class Rule(NamedTuple):
    action: str
    host: str  # glob over "." + host, so "*.net" is net and all its subdomains
    path: str  # glob over path + query
    name: str
    tier: int = 0


def site(action: str, host: str, path: str) -> Rule:
    """A rule for a host, its subdomains and all paths that start with ``path``."""
    return Rule(action, "*." + host, path + "*", host + path)


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), URL, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), URL, 2)


def canonical(url: Column) -> Column:
    return F.concat(F.lit("."), host_of(url), F.lit(SEP), path_of(url), F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), URL, 3))


class Automaton:
    """Masks of all rules; ``match`` gives a (URL, rule) table of bits."""

    def __init__(self, rules: list[Rule]):
        patterns = []
        for r in rules:
            cells: list[tuple[str, int | None]] = [("start", None)]  # (kind, byte), stars become loops
            loops: dict[int, str] = {}
            for part, glob in (("host", r.host), ("sep", SEP), ("path", r.path)):
                for b in glob.encode():
                    if b == ord("*") and part != "sep":
                        loops[len(cells) - 1] = part if loops.get(len(cells) - 1) != "path" else "path"
                    elif b == ord("?") and part != "sep":
                        cells.append((part, None))
                    else:
                        cells.append((part, b))
            patterns.append((cells, loops))
        total = sum(len(c) for c, _ in patterns)
        self.words = max(1, -(-total // 64))
        accept = np.zeros((256, self.words * 64), dtype=bool)
        stay = np.zeros((256, self.words * 64), dtype=bool)
        self.start, self.final = [], []
        at = 0
        for cells, loops in patterns:
            self.start.append(at)
            for k, (part, byte) in enumerate(cells):
                if k and byte is None:
                    accept[:, at + k] = True
                    accept[ord(SEP), at + k] = False
                elif k:
                    accept[byte, at + k] = True
                if k in loops:
                    stay[:, at + k] = True
                    if loops[k] == "host":
                        stay[ord(SEP), at + k] = False
            at += len(cells)
            self.final.append(at - 1)
        self.accept, self.stay = (np.packbits(x, axis=1, bitorder="little").view("<u8") for x in (accept, stay))
        begin = np.zeros(self.words * 64, dtype=bool)
        begin[self.start] = True
        self.begin = np.packbits(begin, bitorder="little").view("<u8")

    def match(self, texts: pa.Array) -> np.ndarray:
        raw = texts.cast(pa.binary())
        size = pc.binary_length(raw).to_numpy(zero_copy_only=False).astype(np.int64)
        data = np.frombuffer(b"".join(raw.to_pylist()), dtype=np.uint8)
        order = np.argsort(-size, kind="stable")
        begin, size = (np.cumsum(size) - size)[order], size[order]
        d = np.tile(self.begin, (len(order), 1))
        for j in range(int(size[0]) if len(size) else 0):
            k = int(np.searchsorted(-size, -j, side="left"))  # URLs with more than j bytes
            c = data[begin[:k] + j]
            shifted = d[:k] << np.uint64(1)
            shifted[:, 1:] |= d[:k, :-1] >> np.uint64(63)
            d[:k] = (shifted & self.accept[c]) | (d[:k] & self.stay[c])
        bits = np.unpackbits(d.view(np.uint8).reshape(len(order), -1), axis=1, bitorder="little")[:, self.final].astype(bool)
        out = np.empty_like(bits)
        out[order] = bits
        return out


def url_verdicts(pages: DataFrame, rules: list[Rule], url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` plus ``_host``, ``_path``, ``_rule`` (name of the winning rule or null), ``_tier`` and ``_verdict``."""
    # Preference is fixed by the rules alone: the first match in this order wins.
    rules = sorted(rules, key=lambda r: (r.tier, -len(r.name), r.action != "block", r.name))
    url = F.col(f"`{url_col}`")
    keyed = pages.select(packed(pages, url_col), url.cast("string").alias("url"), host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("key"))
    schema = keyed.drop("key").withColumns({n: F.lit(None).cast(t) for n, t in (("rule", "string"), ("tier", "int"), ("verdict", "string"))}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Automaton(rules)
        for b in slices(batches, "key", 1 << 20):
            hit = machine.match(b["key"])
            won = np.where(hit.any(axis=1), hit.argmax(axis=1), len(rules)) if rules else np.zeros(b.num_rows, dtype=np.int64)
            names = [*(r.name for r in rules), None], [*(r.tier for r in rules), None], [*(r.action for r in rules), default]
            cols_out = [pa.array(x, t).take(pa.array(won)) for x, t in zip(names, (pa.string(), pa.int32(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*b.drop_columns(["key"]).columns, *cols_out], names=schema.names)

    made = ("host", "path", "rule", "tier", "verdict")
    return keyed.mapInArrow(run, schema).select(*unpacked(pages, url_col, "url", tuple("_" + m for m in made)), *[F.col(m).alias("_" + m) for m in made])
