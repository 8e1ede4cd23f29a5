"""Operator 1, SentencePiece encoding and decoding by a max-plus parallel scan.

Segmentation is a best path through the text: a node is "piece t ends at
character j", an edge appends a piece.  For unigram models an edge weighs the
piece's score.  For BPE models an edge weighs 0 if the two neighbouring pieces
are exactly what the merges make of their concatenation, else -inf; the BPE
segmentation is the one path that is never -inf (merges never cross a boundary
that both neighbours keep, so pairwise agreement is agreement of the whole).

Scan: a text is cut into chunks of ``chunk_chars`` characters.  The states at a
cut are the pieces that can cover it (they start before it and end at or after
it).  Each chunk gives the transfer matrix (max, +) between the states at its
two cuts, each document combines its matrices (an associative product) into the
entry state of every chunk, and every chunk is then backtraced on its own.
Inside a chunk, places that no piece crosses cut it into atoms that do not
influence each other, so equal atoms are solved once per batch, all lengths in
step, by NumPy.

Rows: a null text encodes as null, an empty text as no ids; repeated rows are
encoded row by row; other columns pass through.  A character outside the
vocabulary becomes byte pieces if the model has them, else the unknown id (which
decodes to " ⁇ "); the escape character ▁ in a text decodes to a space, as the format has it.  Models whose normaliser rewrites characters, collapses
spaces or defines user symbols are refused.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as pb

from fieldmodes.llm.tables import keep, packed, unpacked
from fieldmodes.llm.words import slices

SPACE = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
NEG = -np.inf
BASE = np.uint64(0x9E3779B97F4A7C15)
START = -1  # state before the first piece
LONG_ATOM = 192  # longer stretches without a clean cut go through the scan
TABLE, SLOT_SHIFT = 1 << 20, np.uint64(44)  # lookup slots: the top 20 bits of a product
SLICE = 2 << 20  # bytes of text a task encodes at once
CACHE_ATOMS = 150_000  # solved atoms a worker remembers
BLOCK = 96  # characters of a block of the scan inside a task


class Model:
    """A model file, with the tables the scan needs; one per Python worker."""

    def __init__(self, raw: bytes):
        m = pb.ModelProto()
        m.ParseFromString(raw)
        kinds = pb.ModelProto.SentencePiece
        self.bpe = m.trainer_spec.model_type == pb.TrainerSpec.BPE
        if not self.bpe and m.trainer_spec.model_type != pb.TrainerSpec.UNIGRAM:
            raise ValueError("only BPE and unigram models can be encoded")
        norm = m.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("the model's normaliser rewrites text; only identity with escaped spaces is supported")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in m.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.prefix = SPACE if norm.add_dummy_prefix else ""
        self.size = len(m.pieces)
        self.unk = next(i for i, p in enumerate(m.pieces) if p.type == kinds.UNKNOWN)
        self.byte = np.full(256, -1, dtype=np.int64)
        normal = []
        surface: list[bytes] = []
        for i, p in enumerate(m.pieces):
            if p.type == kinds.BYTE:
                self.byte[int(p.piece[3:5], 16)] = i
                surface.append(bytes([int(p.piece[3:5], 16)]))
            elif p.type == kinds.NORMAL:
                normal.append((p.piece, i, p.score))
                surface.append(p.piece.replace(SPACE, " ").encode())
            else:
                surface.append(" ⁇ ".encode() if p.type == kinds.UNKNOWN else b"")
        #: what an id stands for in a text; + size: as the first id, whose dummy prefix is not part of the text
        bare = [x[1:] if self.prefix and x.startswith(b" ") else x for x in surface]
        self.surface = pa.array(surface + bare, pa.binary())
        self.rank = {p: s for p, _, s in normal}
        if self.bpe:
            normal = self._merge_tables(normal)
        self.id_of = {p: i for p, i, _ in normal}
        self.piece_of = {i: p for p, i in self.id_of.items()}
        self.score = np.zeros(self.size + 1)
        self.score[[i for _, i, _ in normal]] = 0.0 if self.bpe else [s for _, _, s in normal]
        self.score[self.unk] = 0.0 if self.bpe else min((s for _, _, s in normal), default=0.0) - 10.0
        self.longest = max(map(len, self.id_of), default=1)
        self.length_of = np.ones(self.size, dtype=np.int64)
        for p, i in self.id_of.items():
            self.length_of[i] = len(p)
        h = np.array([self._hash(p) for p in self.id_of], dtype=np.uint64)
        if len(np.unique(h)) != len(h):
            raise ValueError("two pieces have one hash")
        # Lookup tables addressed by hash bits; a piece whose slot is taken goes to the next table.
        self.hashes, self.hash_ids = np.r_[h, np.uint64(0)], np.r_[np.array(list(self.id_of.values()), dtype=np.int64), -1]
        self.tables, rest = [], np.arange(len(h))
        while len(rest):
            mult = np.uint64(0xFF51AFD7ED558CCD + 2 * len(self.tables) * 0x9E3779B9)
            slot = (h[rest] * mult) >> SLOT_SHIFT
            _, firsts = np.unique(slot, return_index=True)
            table = np.full(TABLE, len(h), dtype=np.int32)
            table[slot[firsts]] = rest[firsts]
            self.tables.append((mult, table))
            rest = np.delete(rest, firsts)
        self.lengths = sorted({len(p) for p in self.id_of})
        inner = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}
        joined = set("".join(inner))
        self.alone = np.array([b for b in range(128) if chr(b) not in joined], dtype=np.uint8)  # ASCII in no longer piece
        self.alone_set = set(self.alone.tolist())
        self.space_opens = not any(x[1] == SPACE and x[0] != SPACE for x in inner)
        self.cache: dict[str, int] = {}
        self.cache_offs, self.cache_ids = np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.pair_keys, self.pair_ok = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)

    @staticmethod
    def _hash(s: str) -> np.uint64:
        h = 0
        for c in s:
            h = (h * int(BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return np.uint64(h)

    def merge(self, text: str) -> tuple[list[str], list[str]]:
        """BPE merges over a short string, best score first, leftmost among equals: what is left, and what was there one merge before."""
        parts = before = list(text)
        while len(parts) > 1:
            best = max(((self.rank[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.rank), default=None)
            if best is None:
                break
            i = -best[1]
            parts, before = [*parts[:i], parts[i] + parts[i + 1], *parts[i + 2 :]], parts
        return parts, before

    def _merge_tables(self, normal: list[tuple]) -> list[tuple]:
        """What ``_keep_apart`` needs: the turn of every merge, the two parts of each piece's last merge, and the turn
        of every pair of pieces that merges.  Returns the pieces without those the merges never leave whole."""
        ids = {p: i for p, i, _ in normal}
        turns = {s: k for k, s in enumerate(sorted({s for p, _, s in normal if len(p) > 1}, reverse=True))}
        self.turn = np.full(self.size, -1, dtype=np.int64)  # -1: a character
        self.head, self.tail = np.arange(self.size), np.arange(self.size)
        pairs, whole = {}, []
        for p, i, s in normal:
            if len(p) == 1:
                whole.append((p, i, s))
                continue
            self.turn[i] = turns[s]
            for k in range(1, len(p)):
                if p[:k] in ids and p[k:] in ids:
                    pairs[ids[p[:k]] * self.size + ids[p[k:]]] = turns[s]
            left, before = self.merge(p)
            if len(left) == 1:
                whole.append((p, i, s))
                self.head[i], self.tail[i] = (ids[x] if x in ids else -1 for x in before)
        keys = np.fromiter(pairs, dtype=np.int64, count=len(pairs))
        order = np.argsort(keys)
        self.merge_keys, self.merge_turn = np.r_[keys[order], np.iinfo(np.int64).max], np.r_[np.fromiter(pairs.values(), np.int64, len(pairs))[order], 0]
        return whole

    def _keep_apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Do the merges over the text of two pieces leave just these two?

        Undo the later of the two last merges again and again, the right one among equals.  The parts that meet
        in the middle at any time must not merge at an earlier turn than the merge undone last (one to the right
        would come later at the same turn)."""
        never = np.iinfo(np.int64).max
        ok, live = np.ones(len(left), dtype=bool), np.arange(len(left))
        a, b, before = left.copy(), right.copy(), np.full(len(left), never)
        while len(live):
            keys = a * self.size + b
            at = np.searchsorted(self.merge_keys, keys)
            joins = np.where((self.merge_keys[at] == keys) & (a >= 0) & (b >= 0), self.merge_turn[at], never) < before
            ok[live[joins]] = False
            ta, tb = self.turn[a], self.turn[b]
            go = ~joins & ((ta >= 0) | (tb >= 0))
            live, a, b, ta, tb = live[go], a[go], b[go], ta[go], tb[go]
            undo_left = ta > tb
            before = np.where(undo_left, ta, tb + 1)
            a, b = np.where(undo_left, self.tail[a], a), np.where(undo_left, b, self.head[b])
        return ok

    def agree(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """May piece ``right`` follow piece ``left``?  START and the unknown piece go with anything."""
        ok = np.ones(len(left), dtype=bool)
        if not self.bpe:
            return ok
        ask = np.flatnonzero((left != START) & (left != self.unk) & (right != self.unk))
        if not len(ask):
            return ok
        keys = left[ask] * self.size + right[ask]
        uniq, back = np.unique(keys, return_inverse=True)
        at = np.searchsorted(self.pair_keys, uniq)
        known = at < len(self.pair_keys)
        known[known] = self.pair_keys[at[known]] == uniq[known]
        if not known.all():
            new = uniq[~known]
            fresh = self._keep_apart(new // self.size, new % self.size)
            keys_all = np.concatenate([self.pair_keys, new])
            order = np.argsort(keys_all, kind="stable")
            self.pair_keys, self.pair_ok = keys_all[order], np.concatenate([self.pair_ok, fresh])[order]
            at = np.searchsorted(self.pair_keys, uniq)
        ok[ask] = self.pair_ok[at][back]
        return ok

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece ids of substring hashes, -1 where there is none."""
        out = np.full(len(h), -1, dtype=np.int64)
        for mult, table in self.tables:
            at = table[(h * mult) >> SLOT_SHIFT]
            hit = np.flatnonzero(self.hashes[at] == h)
            out[hit] = self.hash_ids[at[hit]]
        return out

    # ---- atoms -----------------------------------------------------------------

    def _forward(self, data: pa.Array, first: np.ndarray, limit: np.ndarray) -> dict:
        """Best paths through every string at once.  Row r starts in piece ``first[r]`` (START: none);
        pieces may start before position ``limit[r]`` only.  Node ``node0[r] + j`` is position j."""
        n = len(data)
        chars = np.frombuffer("".join(data.to_pylist()).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        size = pc.utf8_length(data).to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.argsort(-size, kind="stable")
        begin = (np.cumsum(size) - size)[order]  # first character, longest string first
        size, limit = size[order], limit[order]
        longest = int(size[0]) if n else 0
        node0 = np.cumsum(size + 1) - (size + 1)
        total = int((size + 1).sum())
        best = np.full(total, NEG)
        last = np.full(total, -2, dtype=np.int64)
        best[node0], last[node0] = 0.0, first[order]
        with np.errstate(over="ignore"):
            pref = np.zeros(total, dtype=np.uint64)
            active = np.searchsorted(-size, -np.arange(longest + 1), side="right")  # strings with at least j characters
            for j in range(1, longest + 1):
                k = active[j]
                pref[node0[:k] + j] = pref[node0[:k] + j - 1] * BASE + chars[begin[:k] + j - 1].astype(np.uint64) + np.uint64(1)
            powers = np.ones(self.longest + 1, dtype=np.uint64)
            for l in range(1, self.longest + 1):
                powers[l] = powers[l - 1] * BASE
            for j in range(1, longest + 1):
                k = active[j]
                end = node0[:k] + j
                for l in self.lengths:
                    if l > j:
                        break
                    src = end - l
                    go = np.flatnonzero((best[src] > NEG) & (j - l < limit[:k]))
                    if not len(go):
                        continue
                    src = src[go]
                    tok = self.find(pref[end[go]] - pref[src] * powers[l])
                    if l == 1:
                        tok = np.where(tok < 0, self.unk, tok)
                    hit = np.flatnonzero(tok >= 0)
                    if not len(hit):
                        continue
                    src, tok, e = src[hit], tok[hit], end[go[hit]]
                    cand = np.where(self.agree(last[src], tok), best[src] + self.score[tok], NEG)
                    better = cand > best[e]
                    e = e[better]
                    best[e], last[e] = cand[better], tok[better]
        return {"order": order, "begin": begin, "size": size, "node0": node0, "best": best, "last": last, "chars": chars}

    def _backtrace(self, f: dict, rows: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, position, piece) of the path that ends at ``pos`` of each of ``rows``, all rows in step."""
        pos, live = pos.copy(), np.arange(len(rows))
        got = [], [], []
        while len(live := live[pos[live] > 0]):
            t = f["last"][f["node0"][rows[live]] + pos[live]]
            pos[live] -= self.length_of[t]
            for out, x in zip(got, (rows[live], pos[live].copy(), t)):
                out.append(x)
        if not got[0]:
            return (np.zeros(0, dtype=np.int64),) * 3
        row, at, ids = map(np.concatenate, got)
        by = np.lexsort((at, row))
        return row[by], at[by], ids[by]

    def spell(self, ids: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unknown pieces as byte pieces; (ids, how many ids each input piece became)."""
        wide = np.ones(len(ids), dtype=np.int64)
        odd = np.flatnonzero(ids == self.unk)
        if self.byte[0] < 0 or not len(odd):
            return ids, wide
        as_bytes = [chr(c).encode("utf-8", "surrogatepass") for c in chars[odd].tolist()]
        wide[odd] = [len(b) for b in as_bytes]
        grown = np.repeat(ids, wide)
        grown[np.repeat(ids == self.unk, wide)] = self.byte[np.frombuffer(b"".join(as_bytes), dtype=np.uint8)]
        return grown, wide

    def solve(self, atoms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Best segmentation of each atom: (offsets, ids)."""
        n = len(atoms)
        size = pc.utf8_length(atoms).to_numpy(zero_copy_only=False).astype(np.int64)
        long = np.flatnonzero(size > LONG_ATOM)
        short = np.flatnonzero(size <= LONG_ATOM)
        data = atoms.take(pa.array(short)) if len(long) else atoms
        f = self._forward(data, np.full(len(data), START), np.full(len(data), LONG_ATOM + 1))
        row, at, ids = self._backtrace(f, np.arange(len(data)), f["size"])
        ids, wide = self.spell(ids, f["chars"][f["begin"][row] + at])
        row = short[f["order"][np.repeat(row, wide)]]
        if len(long):
            parts = [(i, self.scan(atoms[i].as_py())) for i in long.tolist()]
            row = np.concatenate([row, *(np.full(len(x), i) for i, x in parts)])
            ids = np.concatenate([ids, *(x for _, x in parts)])
        by = np.argsort(row, kind="stable")
        return np.r_[0, np.cumsum(np.bincount(row, minlength=n))], ids[by]

    # ---- the scan: blocks, transfer matrices, combination, backtrace -----------------

    def covers(self, text: str, at: int) -> list[tuple[int, int]]:
        """States at a cut: (start, piece) of every piece over it, start < at <= end."""
        found = []
        for s in range(max(0, at - self.longest), at):
            for e in range(at, min(len(text), s + self.longest) + 1):
                i = self.id_of.get(text[s:e])
                if i is not None:
                    found.append((s, i))
        if text[at - 1] not in self.id_of:
            found.append((at - 1, self.unk))
        return found

    def transfer(self, jobs: list[tuple]) -> tuple[dict, list[tuple[list, dict, dict]]]:
        """One forward pass over all blocks of all jobs (text, cuts, entry states, does the last cut cross pieces).

        Gives the pass and for each job (blocks, trail, matrix).  A block maps its entry states to
        (offset of the row's text, {exit state: (score, position in the row)}, row); the matrix maps the
        job's entry states to {exit state: score}; the trail says which state a best path came from."""
        rows, strings, first, limit = [], [], [], []
        for j, (text, cuts, entry, crossing) in enumerate(jobs):
            for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                stop = min(len(text), b + self.longest) if crossing or k < len(cuts) - 2 else b
                for state in entry if k == 0 else self.covers(text, a):
                    off = a if state is None else state[0] + self.length(state[1])
                    rows.append((j, k, state, off, b))
                    strings.append(text[off : max(off, stop)])
                    first.append(START if state is None else state[1])
                    limit.append(b - off)
        f = self._forward(pa.array(strings, pa.string()), np.array(first, dtype=np.int64), np.array(limit, dtype=np.int64))
        where = np.argsort(f["order"])
        out: list[tuple] = [([{} for _ in cuts[1:]], {}, {}) for _, cuts, _, _ in jobs]
        best, last, sizes, node0 = f["best"], f["last"], f["size"], f["node0"]
        for r, (j, k, state, off, b) in enumerate(rows):
            w = where[r]
            if state is not None and off >= b:  # the entry piece covers the whole block
                exits = {state: (0.0, 0)}
            else:
                lo, hi = int(node0[w]) + b - off, int(node0[w]) + int(sizes[w]) + 1
                exits = {(off + q - self.length(t), t): (v, q)
                         for q, v, t in zip(range(b - off, b - off + hi - lo), best[lo:hi].tolist(), last[lo:hi].tolist()) if v > NEG}
            out[j][0][k][state] = (off, exits, w)
        for (blocks, trail, matrix), (_, _, entry, _) in zip(out, jobs):
            for e in entry:
                now, back = {e: 0.0}, []
                for block in blocks:
                    then: dict = {}
                    for state, score in now.items():
                        for x, (gain, _) in block.get(state, (0, {}, 0))[1].items():
                            if score + gain > then.get(x, (NEG, None))[0]:
                                then[x] = (score + gain, state)
                    back.append({s: p for s, (_, p) in then.items()})
                    now = {s: v for s, (v, _) in then.items()}
                matrix[e], trail[e] = now, back
        return f, out

    def ending_at(self, exits: dict, place: int) -> dict:
        return {s: v for s, v in exits.items() if s is not None and s[0] + self.length(s[1]) == place}

    def walk(self, f: dict, how: tuple, entry, exit_state, start: int) -> tuple[np.ndarray, np.ndarray]:
        """Pieces on the path from ``entry`` to ``exit_state``; each block is backtraced on its own.
        Returns (positions, ids) of the pieces that start at ``start`` or later."""
        by, trail, _ = how
        states = [exit_state]
        for back in reversed(trail[entry]):
            states.append(back[states[-1]])
        states.reverse()
        rows, pos, off = [], [], []
        for block, a, b in zip(by, states, states[1:]):
            o, exits, w = block[a]
            rows.append(w)
            pos.append(exits[b][1])
            off.append(o)
        back_of = {w: o for w, o in zip(rows, off)}
        row, at, ids = self._backtrace(f, np.array(rows), np.array(pos))
        where = at + np.array([back_of[r] for r in row.tolist()], dtype=np.int64) if len(row) else at
        chars = f["chars"][f["begin"][row] + at] if len(row) else np.zeros(0, dtype="<u4")
        by_place = np.argsort(where, kind="stable")
        where, ids, chars = where[by_place], ids[by_place], chars[by_place]
        own = where >= start
        return chars[own], ids[own]

    def scan(self, text: str) -> np.ndarray:
        """Ids of one long string without inner cuts, by the scan over blocks of ``BLOCK`` characters."""
        cuts = [*range(0, len(text), BLOCK), len(text)]
        f, (how,) = self.transfer([(text, cuts, [None], False)])
        final = self.ending_at(how[2][None], len(text))
        chars, ids = self.walk(f, how, None, max(final, key=lambda s: (final[s], s)), 0)
        return self.spell(ids, chars)[0]

    # ---- texts -----------------------------------------------------------------------

    def cut(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """Atoms of normalised texts: (offsets, flat atoms)."""
        texts = texts.cast(pa.large_string())
        offs = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offs[0] : offs[-1]] if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
        offs = offs - offs[0]
        start = np.zeros(len(raw) + 1, dtype=bool)
        start[offs] = True
        if len(raw):
            if self.space_opens:
                b = SPACE.encode()
                sp = np.flatnonzero(raw[:-2] == b[0]) if len(raw) > 2 else np.zeros(0, np.int64)
                sp = sp[(raw[sp + 1] == b[1]) & (raw[sp + 2] == b[2])]
                opens = np.ones(len(sp), dtype=bool)
                opens[1:] = sp[1:] != sp[:-1] + 3
                start[sp[opens]] = True
            table = np.zeros(256, dtype=bool)
            table[self.alone] = True
            lone = np.flatnonzero(table[raw])
            start[lone] = True
            start[lone + 1] = True
        edges = np.flatnonzero(start)
        edges = edges if len(edges) and edges[-1] == len(raw) else np.r_[edges, len(raw)]
        flat = pa.Array.from_buffers(pa.string(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(raw)])
        return np.searchsorted(edges, offs), flat

    def _remembered(self, atoms: pa.Array) -> np.ndarray:
        """Places of the atoms in the cache, solving those it lacks."""
        if len(self.cache) > CACHE_ATOMS:
            self.cache, self.cache_offs, self.cache_ids = {}, np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.int64)
        strings = atoms.to_pylist()
        known = self.cache
        at = np.fromiter((known.get(x, -1) for x in strings), dtype=np.int64, count=len(strings))
        new = np.flatnonzero(at < 0)
        if len(new):
            offs, ids = self.solve(atoms.take(pa.array(new)))
            at[new] = np.arange(len(known), len(known) + len(new))
            known.update(zip((strings[i] for i in new.tolist()), at[new].tolist()))
            self.cache_offs = np.r_[self.cache_offs, offs[1:] + self.cache_offs[-1]]
            self.cache_ids = np.r_[self.cache_ids, ids]
        return at

    def encode_clean(self, texts: pa.Array) -> pa.Array:
        """Ids of normalised texts that start and end at places no piece crosses."""
        offs, atoms = self.cut(texts)
        d = atoms.dictionary_encode()
        codes = d.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        codes, o, ids = self._remembered(d.dictionary)[codes], self.cache_offs, self.cache_ids
        width = o[codes + 1] - o[codes]
        ends = np.r_[0, np.cumsum(width)]
        take = np.repeat(o[codes] - ends[:-1], width) + np.arange(ends[-1])
        return pa.ListArray.from_arrays(pa.array(ends[offs].astype(np.int32)), pa.array(ids[take].astype(np.int32)))

    def normalise(self, texts: pa.Array) -> pa.Array:
        shown = pc.replace_substring(texts, " ", SPACE)
        return pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(self.prefix, shown, "")) if self.prefix else shown

    def length(self, i: int) -> int:
        return int(self.length_of[i])

    def clean(self, text: str, lo: int, hi: int, last: bool) -> int | None:
        """First (or last) place in [lo, hi] that no piece crosses, by the rule of ``cut``."""
        for p in range(hi, lo - 1, -1) if last else range(lo, hi + 1):
            if 0 < p < len(text):
                x, y = text[p - 1], text[p]
                if (y == SPACE and x != SPACE and self.space_opens) or any(ord(c) < 128 and ord(c) in self.alone_set for c in (x, y)):
                    return p
        return None

    def chunk_cuts(self, text: str, a: int, b: int) -> tuple[list[int], int | None, int | None, list[int]]:
        """A chunk [a, b] as head blocks up to its first clean place and tail blocks from its last one."""
        p = self.clean(text, a, b - 1, last=False)
        if p is None:
            return [*range(a, b, BLOCK), b], None, None, []
        q = self.clean(text, p, b - 1, last=True)
        return [*range(a, p, BLOCK), p], p, q, [*range(q, b, BLOCK), b]

    def _jobs(self, text: str, a: int, b: int, entry: list, closing: bool) -> tuple[list, tuple | None]:
        """The jobs of one chunk: its head from every entry state, and its tail; (jobs, clean places)."""
        head, p, q, tail = self.chunk_cuts(text, a, b)
        if p is None:
            return [(text, head, entry, not closing)], None
        return [(text, head, entry, False), (text, tail, [None], not closing)], (p, q)

    def chunk_matrices(self, chunks: list[tuple]) -> list[list[tuple]]:
        """For each chunk (text, a, b, opening, closing) the rows (entry start, entry piece, exit start,
        exit piece, score), starts relative to the cut.

        The stretch between the clean places adds the same to every path and is left out.
        The start of the text is the state (0, START), its end the state (0, START)."""
        jobs, parts = [], []
        for text, a, b, opening, closing in chunks:
            entry = [None] if opening else self.covers(text, a)
            own, places = self._jobs(text, a, b, entry, closing)
            parts.append((entry, places, len(jobs)))
            jobs += own
        done = self.transfer(jobs)[1]
        out = []
        for (entry, places, at), (text, a, b, _, closing) in zip(parts, chunks):
            m = done[at][2]
            if places is not None:
                p = places[0]
                h = {e: 0.0 if p == a and (e is None or e[0] + self.length(e[1]) == a)
                     else max(self.ending_at(m[e], p).values(), default=NEG) for e in entry}
                m = {e: {x: h[e] + v for x, v in done[at + 1][2][None].items()} for e in entry if h[e] > NEG}
            rows = []
            for e, exits in m.items():
                if closing:
                    ends = self.ending_at(exits, b).values()
                    exits = {None: max(ends)} if ends else {}
                for x, v in exits.items():
                    rows.append((*((0, START) if e is None else (e[0] - a, e[1])), *((0, START) if x is None else (x[0] - b, x[1])), v))
            out.append(rows)
        return out

    def chunk_ids(self, chunks: list[tuple]) -> list[np.ndarray]:
        """For each chunk (text, a, b, entry state, exit state) the ids of the pieces that start in [a, b)."""
        jobs, parts = [], []
        for text, a, b, entry, leave in chunks:
            e = None if entry[1] == START else (entry[0] + a, entry[1])
            x = None if leave[1] == START else (leave[0] + b, leave[1])
            own, places = self._jobs(text, a, b, [e], x is None)
            parts.append((e, x, places, len(jobs)))
            jobs += own
        f, done = self.transfer(jobs)
        middles = self.encode_clean(pa.array([text[p[0] : p[1]] if p else "" for (text, *_), (_, _, p, _) in zip(chunks, parts)], pa.string()))
        moffs, mids = middles.offsets.to_numpy(), middles.values.to_numpy()
        out = []
        for i, ((e, x, places, at), (text, a, b, _, _)) in enumerate(zip(parts, chunks)):
            ids = []

            def trace(job, enter, leave, place, start):
                if jobs[job][1][0] == jobs[job][1][-1]:
                    return
                if leave is None:  # the best path that ends exactly at the place
                    ends = self.ending_at(done[job][2][enter], place)
                    leave = max(ends, key=lambda s: (ends[s], s))
                chars, found = self.walk(f, done[job], enter, leave, start)
                ids.append(self.spell(found, chars)[0])

            if places is None:
                trace(at, e, x, b, a)
            else:
                trace(at, e, None, places[0], a)
                ids.append(mids[moffs[i] : moffs[i + 1]])
                trace(at + 1, None, x, b, places[1])
            out.append(np.concatenate(ids))
        return out


@functools.lru_cache(maxsize=4)
def _model(raw: bytes) -> Model:
    return Model(raw)


def encode(docs: DataFrame, model_path: str = MODEL, text_col: str = "text", out_col: str = "ids",
           chunk_chars: int = 32768) -> DataFrame:
    """``docs`` plus ``out_col`` array<int>: the ids of the text under the model file.

    ``model_path`` is read on the driver (model files have a fixed size) and sent to the tasks."""
    spark = docs.sparkSession
    with open(model_path, "rb") as f:
        raw = spark.sparkContext.broadcast(f.read())
    rows = docs.select(packed(docs, text_col), F.col(f"`{text_col}`").cast("string").alias("text"))
    size = F.length("text")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE):
            m = _model(raw.value)
            col = b.column("text")
            ids = m.encode_clean(m.normalise(pc.fill_null(col, "")))
            ids = pc.if_else(pc.is_null(col), pa.scalar(None, ids.type), ids) if col.null_count else ids
            yield pa.RecordBatch.from_arrays([*b.columns, ids], names=["row", "text", "ids"])

    short = rows.where(size.isNull() | (size <= chunk_chars))
    short = short.mapInArrow(whole, short.withColumn("ids", F.lit(None).cast("array<int>")).schema)

    # Giant texts: numbered once in a written table, then chunk by chunk.
    giants = keep(rows.where(size > chunk_chars).withColumn("uid", F.monotonically_increasing_id()), "giant-texts")

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(raw.value)
        names = ["uid", "chunk", "chunks", "lead", "size", "window"]
        for b in batches:
            for uid, text in zip(b["uid"].to_pylist(), m.normalise(b["text"]).to_pylist()):
                cuts = [*range(0, len(text), chunk_chars), len(text)]
                lead = [min(a, m.longest) for a in cuts[:-1]]
                yield pa.RecordBatch.from_arrays([
                    pa.array([uid] * len(lead), pa.int64()), pa.array(range(len(lead)), pa.int64()), pa.array([len(lead)] * len(lead), pa.int64()),
                    pa.array(lead, pa.int64()), pa.array([b_ - a for a, b_ in zip(cuts, cuts[1:])], pa.int64()),
                    pa.array([text[a - l : b_ + m.longest] for a, b_, l in zip(cuts, cuts[1:], lead)], pa.string())], names=names)

    chunks = giants.select("uid", "text").mapInArrow(
        chunk, "uid long, chunk long, chunks long, lead long, size long, window string")
    chunks = keep(chunks.repartition("uid", "chunk"), "giant-chunks")  # one chunk is one unit of work

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(raw.value)
        for b in slices(batches, "window", SLICE):
            got = b.to_pylist()
            found = m.chunk_matrices([(r["window"], r["lead"], r["lead"] + r["size"], r["chunk"] == 0, r["chunk"] == r["chunks"] - 1)
                                      for r in got])
            rows = [(r["uid"], r["chunk"], *x) for r, xs in zip(got, found) for x in xs]
            cols = list(zip(*rows)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if i == 6 else pa.int64()) for i, c in enumerate(cols)],
                                             names=["uid", "chunk", "es", "ep", "xs", "xp", "score"])

    matrix = chunks.mapInArrow(matrices, "uid long, chunk long, es long, ep long, xs long, xp long, score double")

    def combine(table: pa.Table) -> pa.Table:
        """One document: its matrices, combined in order, give every chunk its entry and exit state."""
        by: dict[int, list] = {}
        for r in table.to_pylist():
            by.setdefault(r["chunk"], []).append(r)
        now, back = {(0, START): 0.0}, []
        for k in sorted(by):
            then: dict = {}
            for r in by[k]:
                score = now.get((r["es"], r["ep"]), NEG) + r["score"]
                if score > then.get((r["xs"], r["xp"]), (NEG, None))[0]:
                    then[r["xs"], r["xp"]] = (score, (r["es"], r["ep"]))
            back.append({s: p for s, (_, p) in then.items()})
            now = {s: v for s, (v, _) in then.items()}
        state, rows = max(now, key=lambda s: (now[s], s)), []
        for k in reversed(range(len(back))):
            rows.append((table["uid"][0].as_py(), k, *back[k][state], *state))
            state = back[k][state]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["uid", "chunk", "es", "ep", "xs", "xp"])

    # A document has at most 2^31 / chunk_chars chunks of a few dozen states each.
    states = matrix.groupBy("uid").applyInArrow(combine, "uid long, chunk long, es long, ep long, xs long, xp long")

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(raw.value)
        for b in slices(batches, "window", SLICE):
            ids = m.chunk_ids([(r["window"], r["lead"], r["lead"] + r["size"], (r["es"], r["ep"]), (r["xs"], r["xp"])) for r in b.to_pylist()])
            yield pa.RecordBatch.from_arrays([b["uid"], b["chunk"], pa.array(ids, pa.list_(pa.int32()))], names=["uid", "chunk", "part"])

    parts = chunks.join(keep(states, "giant-states"), ["uid", "chunk"]).mapInArrow(trace, "uid long, chunk long, part array<int>")
    joined = parts.groupBy("uid").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "part"))), lambda x: x["part"])).alias("ids"))
    long = giants.join(joined, "uid").select("row", "text", "ids")
    return short.unionByName(long).select(*unpacked(docs, text_col, "text", (out_col,)), F.col("ids").alias(out_col))


def decode(df: DataFrame, model_path: str = MODEL, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` plus ``out_col``: the text of the ids.  Null ids give null; ids outside the model fail;
    byte pieces that form no UTF-8 become U+FFFD."""
    spark = df.sparkSession
    with open(model_path, "rb") as f:
        raw = spark.sparkContext.broadcast(f.read())
    rows = df.select(packed(df, ids_col), F.col(f"`{ids_col}`").cast("array<int>").alias("ids"))
    schema = rows.withColumn("decoded", F.lit(None).cast("string")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(raw.value)
        for b in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
            col = b.column("ids")
            ids = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            if len(ids) and not 0 <= ids.min() <= ids.max() < m.size:
                raise ValueError("an id is outside the model")
            offs = np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False))]
            firsts = offs[:-1][np.diff(offs) > 0]
            ids[firsts] += m.size
            data = pc.binary_join(pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), m.surface.take(pa.array(ids))), b"")
            try:
                text = data.cast(pa.string())
            except pa.ArrowInvalid:
                text = pa.array([x.decode("utf-8", "replace") if x is not None else None for x in data.to_pylist()], pa.string())
            text = pc.if_else(pc.is_null(col), pa.scalar(None, pa.string()), text)
            yield pa.RecordBatch.from_arrays([*b.columns, text], names=["row", "ids", "decoded"])

    out = rows.mapInArrow(run, schema)
    return out.select(*unpacked(df, ids_col, "ids", (out_col,)), F.col("decoded").alias(out_col))
