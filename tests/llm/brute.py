"""Plain Python versions of the operators, for small inputs."""

import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall(text or "")


def features(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines)."""
    text = text or ""
    w = words(text)
    win = Counter(tuple(w[k:k + 8]) for k in range(len(w) - 7))
    covered = {j for k in range(len(w) - 7) if win[tuple(w[k:k + 8])] > 1 for j in range(k, k + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(lines)


def scores(f):
    n, chars, symbols, dup, rep, lines = f
    return {"symbols": symbols / n, "dup_lines": dup / lines if lines else 0.0, "repeats": rep / n, "long_words": chars / n, "short_words": -chars / n}


def base_failed(f):
    return f[0] < 20 or 100 * f[4] > 30 * f[0]


def quality(docs, labels, cutoffs, alpha=0.02, delta=0.05):
    """{doc_id: kept} by the exact binomial bound; docs: (doc_id, text, lang), labels: (doc_id, quality)."""
    feats = {d: (features(t), lang) for d, t, lang in docs}
    good = defaultdict(lambda: True)
    for d, q in labels:
        if q is not None:
            good[d] &= q == 1
    cells = {}
    for d, (f, lang) in feats.items():
        if d in good and good[d] and f[0]:
            for r, s in scores(f).items():
                for c in cutoffs[r]:
                    n, k = cells.get((lang, r, c), (0, 0))
                    cells[lang, r, c] = n + 1, k + (s > c)
    p = alpha / len(cutoffs)
    best = {}
    for (lang, r, c), (n, k) in cells.items():
        tail = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        if tail <= delta / len(cells):
            best[lang, r] = min(c, best.get((lang, r), math.inf))
    return {d: not base_failed(f) and not (f[0] and any(s > best.get((lang, r), math.inf) for r, s in scores(f).items()))
            for d, (f, lang) in feats.items()}


def fingerprint(text, width=4):
    w = words((text or "").translate(LOWER))
    shingles = [" ".join(w[k:k + width]) for k in range(max(1, len(w) - width + 1))] if w else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(fps, bits=4):
    """{id: smallest id reachable}."""
    ids, parent = sorted(fps), {i: i for i in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, i in enumerate(ids):
        for j in ids[a + 1:]:
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def substrings(docs, window=20):
    """{doc_id: (words, covered flags)}; docs in the order of their ids."""
    seen, out = set(), {}
    for d, t in docs:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            x = tuple(w[k:k + window])
            if x in seen:
                gone[k:k + window] = [True] * window
            seen.add(x)
        out[d] = w, gone
    return out


def cut(text, gone):
    """The text without the flagged words and the white space before them."""
    out, at = [], 0
    for m, g in zip(WORD.finditer(text), gone):
        if not g:
            out.append(text[at:m.end()])
        at = m.end()
    return "".join(out) + text[at:]


PLAIN = {**LOWER, **{ord(c): None for c in '.,;:!?"()'}}


def leaked(text, items, window=13, subs=2):
    """Item ids found in the text."""
    w = words((text or "").translate(PLAIN))
    found = set()
    for item, t in items:
        x = words((t or "").translate(PLAIN))
        if not x:
            continue
        need = window - subs if len(x) >= window else len(x)
        width = min(window, len(x))
        if any(sum(a == b for a, b in zip(w[i:i + width], x[j:j + width])) >= need
               for i in range(len(w) - width + 1) for j in range(len(x) - width + 1)):
            found.add(item)
    return sorted(found)


def katz(docs, discounts, top=5):
    """{doc_id: (held out, tokens, known, N, base, score)}; docs: (doc_id, text)."""
    toks = {d: words((t or "").translate(LOWER)) + [None] for d, t in docs}
    held = {d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1 for d in toks}
    uni, bi = Counter(), Counter()
    for d, t in toks.items():
        if not held[d]:
            uni.update(t)
            bi.update(zip(["<s>"] + t[:-1], t))

    def table(c):
        k = Counter(c.values())
        return discounts([0, *(k.get(x, 0) for x in range(1, top + 2))]).values

    d1, d2 = table(uni), table(bi)
    of = lambda d, c: d[c - 1] if c <= top else 1.0
    n, v = sum(uni.values()), len(uni)
    kept = sum(of(d1, c) * c for c in uni.values())
    below = n if kept < n else n + 1
    unknown = 1 - kept / below if n else 1.0
    p1 = lambda w: of(d1, uni[w]) * uni[w] / below if uni[w] else unknown
    ctx = defaultdict(lambda: [0, 0.0, 0.0])
    for (h, w), c in bi.items():
        x = ctx[h]
        x[0] += c
        x[1] += of(d2, c) * c
        x[2] += p1(w)
    alpha = {}
    for h, x in ctx.items():
        if not x[1] < x[0]:
            x[0] += 1
        alpha[h] = (1 - x[1] / x[0]) / (1 - x[2])
    out = {}
    for d, t in toks.items():
        base = sum(math.log10((uni[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        score = 0.0
        for h, w in zip(["<s>"] + t[:-1], t):
            c = bi[h, w]
            score += math.log10(of(d2, c) * c / ctx[h][0] if c else (alpha[h] if h in ctx else 1) * p1(w))
        out[d] = held[d], len(t), sum(uni[w] > 0 for w in t), n, base, score
    return out


def discounts(counts, top=5):
    """Katz's discounts d(1..top), written anew: raw Good-Turing if all lie in (0, 1), else on the line of log Z against log c."""
    have = Counter(counts)
    raw = {c: have.get(c, 0) for c in range(1, top + 2)}

    def by(n):
        if min(n.values()) <= 0:
            return None
        tail = (top + 1) * n[top + 1] / n[1]
        d = [((c + 1) * n[c + 1] / n[c] / c - tail) / (1 - tail) if tail < 1 else 2 for c in range(1, top + 1)]
        return d if all(0 < x < 1 for x in d) else None

    some = [c for c in raw if raw[c]]
    got = by(raw)
    if got is None and len(some) > 1:
        pts = []
        for i, c in enumerate(some):
            low = some[i - 1] if i else 0
            high = some[i + 1] if i + 1 < len(some) else 2 * c - low
            pts.append((math.log(c), math.log(2 * raw[c] / (high - low))))
        mx, my = (sum(p[k] for p in pts) / len(pts) for k in (0, 1))
        slope = sum((x - mx) * (y - my) for x, y in pts) / sum((x - mx) ** 2 for x, _ in pts)
        got = by({c: math.exp(my + slope * (math.log(c) - mx)) for c in raw})
    if got is None:
        gap = raw[1] / (raw[1] + 2 * raw[2]) if raw[1] and raw[2] else 0.5
        got = [1 - gap / c for c in range(1, top + 1)]
    return got


def katz_of_order(docs, order, top=5, new=None):
    """{doc_id: (held out, score)} of a Katz model of any order, by its recursive definition; ``new`` are scored in place of ``docs``."""
    split = lambda ds: {d: words((t or "").translate(LOWER)) + [None] for d, t in ds}
    toks = split(docs)
    held = {d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1 for d in toks}
    pad = ("<s>",) * (order - 1)
    grams = [Counter() for _ in range(order)]
    for d, t in toks.items():
        if not held[d]:
            t = (*pad, *t)
            for i in range(len(pad), len(t)):
                for k in range(order):
                    grams[k][t[i - k:i + 1]] += 1
    ds = [discounts(g.values(), top) for g in grams]
    star = lambda k, c: c * (ds[k][c - 1] if c <= top else 1.0)
    followers = [defaultdict(dict) for _ in range(order)]
    for k, g in enumerate(grams):
        for x, c in g.items():
            followers[k][x[:-1]][x[-1]] = c

    def below(h):
        f = followers[len(h)].get(h, {})
        n, kept = sum(f.values()), sum(star(len(h), c) for c in f.values())
        return (n if kept < n else n + 1), kept

    left = {}

    def prob(h, w):
        f = followers[len(h)].get(h, {})
        if not h:
            n, kept = below(h)
            return star(0, f[w]) / n if w in f else 1 - kept / n if f else 1.0
        if not f:
            return prob(h[1:], w)
        if w in f:
            return star(len(h), f[w]) / below(h)[0]
        if h not in left:
            n, kept = below(h)
            left[h] = (1 - kept / n) / (1 - sum(prob(h[1:], x) for x in f))
        return left[h] * prob(h[1:], w)

    out = {}
    for d, t in (toks if new is None else split(new)).items():
        t = (*pad, *t)
        out[d] = held.get(d), sum(math.log10(prob(t[i - order + 1:i], t[i])) for i in range(len(pad), len(t)))
    return out
