"""Byte-level BPE with a segment tree of pair ranks.

Pretokens are found for a whole chunk of texts at once from character classes, each different pretoken is merged
once, and ids are gathered back.  The merges of a pretoken use a segment tree over its byte positions: each leaf
holds ``rank << 20 | position`` of the pair that starts there, the root is the leftmost minimum, and a merge makes
three point updates (the pair itself, the pair at its right that vanishes, the pair at its left).  Short pretokens
share one array of trees, level by level; a long one has its own.
"""

from __future__ import annotations

import base64
import json
import re
from functools import lru_cache

import numpy as np

from sectorlake.llm.textcore import U64, Spans, mix

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
_INF = np.int64(1 << 62)
_TREE_LIMIT = 64  # pairs; longer pretokens get a tree of their own
_CACHE_LIMIT = 500_000  # pretokens that a worker remembers


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(1)
def _classes() -> np.ndarray:
    """The class of each code point, by the properties that the splitting pattern names."""
    import regex

    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            a, b = ord(m[0][0]), ord(m[0][-1])
            if b - a == len(m[0]) - 1:
                table[a : b + 1] = kind
            else:
                table[[ord(c) for c in m[0]]] = kind
    return table


def pretokens(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the matches of public_tokenizers.PATTERN in texts given as code points; they cover every text."""
    n = len(points)
    kind = _classes()[points]
    new = np.empty(n, bool)
    first = np.zeros(n, bool)
    first[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    new[:1] = True
    new[1:] = kind[1:] != kind[:-1]
    new |= first
    run = np.flatnonzero(new)
    run_end = np.append(run[1:], n)
    last = np.append(first[run[1:]], True)  # the run ends its text
    mask = new.copy()
    space = kind[run] == SPACE
    inner = space & ~last
    tail = run_end[inner] - 1  # the last white space before something else
    joins = points[tail] == 32
    mask[tail] = True
    mask[run_end[inner][joins]] = False
    # contractions: an apostrophe alone that starts a match, before letters
    quote = np.flatnonzero((points == 39) & mask)
    quote = quote[(quote + 1 < n)]
    if len(quote):
        follows = (kind[quote + 1] == LETTER) & ~first[quote + 1]
        quote = quote[follows]
        second = points[quote + 1]
        pad = np.append(points, np.zeros(3, points.dtype))
        edge = np.append(first, np.ones(3, bool))
        third = np.where(edge[quote + 2], 0, pad[quote + 2])
        one = np.isin(second, [ord(c) for c in "stmd"])
        two = np.zeros(len(quote), bool)
        for a, b in ("re", "ve", "ll"):
            two |= (second == ord(a)) & (third == ord(b))
        for which, length in ((one, 2), (two & ~one, 3)):
            at = quote[which]
            mask[at + 1] = False
            end = at + length
            end = end[end < n]
            mask[end] = True
    return np.flatnonzero(mask)


class MergeTable:
    """Pair of ids -> (rank, id) in an open-addressed table for arrays of pairs, and a dict for single pairs."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, made: np.ndarray):
        key = left.astype(np.int64) << 20 | right.astype(np.int64)
        self.bits = max(10, int(len(key) * 3).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.rank = np.full(1 << self.bits, -1, np.int64)
        self.made = np.zeros(1 << self.bits, np.int64)
        todo, at = np.arange(len(key)), self._slot(key)
        while len(todo):
            free = self.keys[at] == -1
            take, where = np.unique(at[free], return_index=True)
            chosen = np.flatnonzero(free)[where]
            self.keys[take], self.rank[take], self.made[take] = key[todo[chosen]], rank[todo[chosen]], made[todo[chosen]]
            rest = np.ones(len(todo), bool)
            rest[chosen] = False
            todo, at = todo[rest], (at[rest] + 1) & ((1 << self.bits) - 1)
        self.one = dict(zip(key.tolist(), zip(rank.tolist(), made.tolist(), strict=True), strict=True))

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (mix(key.view(U64)) >> U64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """rank (-1: no merge) and id of each pair."""
        key = left << 20 | right
        at = self._slot(key)
        found = self.keys[at]
        open_ = np.flatnonzero((found != key) & (found != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[open_]]
            open_ = open_[(found != key[open_]) & (found != -1)]
        hit = self.keys[at] == key
        return np.where(hit, self.rank[at], -1), self.made[at]


class Bpe:
    """Merges of byte sequences; ``whole`` maps a pretoken that is a vocabulary entry straight to its id."""

    def __init__(self, table: MergeTable, byte_ids: np.ndarray, token_bytes: list[bytes], whole: dict[bytes, int] | None):
        self.table, self.byte_ids, self.whole = table, byte_ids, whole
        lengths = np.array([len(b) for b in token_bytes], np.int64)
        self.token_start = np.concatenate([[0], np.cumsum(lengths)])
        self.token_flat = np.frombuffer(b"".join(token_bytes), np.uint8)
        self.cache: dict[bytes, bytes] = {}

    @classmethod
    def from_ranks(cls, path: str) -> "Bpe":
        """A ``.tiktoken`` file: any neighbours whose joined bytes are an entry merge, lowest rank first."""
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        pairs = [(ranks[t[:i]], ranks[t[i:]], r, r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        tokens = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            tokens[r] = t
        return cls(MergeTable(*np.array(pairs, np.int64).T), np.array([ranks[bytes([b])] for b in range(256)]), tokens, ranks)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, as little-endian unsigned 32-bit integers."""
        out: list[bytes | None] = [None] * len(pieces)
        if self.whole is not None:
            out = [r if r is None else r.to_bytes(4, "little") for r in map(self.whole.get, pieces)]
        groups: dict[int, list[int]] = {}
        for i, (p, n, done) in enumerate(zip(pieces, map(len, pieces), out, strict=True)):
            if done is not None:
                continue
            if n < 2:
                out[i] = self.byte_ids[np.frombuffer(p, np.uint8)].astype("<u4").tobytes()
            elif n - 1 > _TREE_LIMIT:
                out[i] = self._long(p).astype("<u4").tobytes()
            else:
                groups.setdefault((n - 2).bit_length(), []).append(i)
        for level, members in groups.items():
            for lo in range(0, len(members), 1 << 14):
                some = members[lo : lo + (1 << 14)]
                ids, count = self._trees([pieces[i] for i in some], level)
                raw, end = ids.astype("<u4").tobytes(), (4 * np.cumsum(count)).tolist()
                for i, a, z in zip(some, [0, *end], end, strict=False):
                    out[i] = raw[a:z]
        return out

    def _trees(self, pieces: list[bytes], level: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces end to end, and their numbers."""
        size, n = 1 << level, len(pieces)
        lengths = np.array([len(p) for p in pieces])
        width = size + 1
        flat = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8)
        symbol = self.byte_ids[flat].astype(np.int64).reshape(n, width)
        at = np.arange(width)
        after = np.broadcast_to(at + 1, (n, width)).copy()  # the next live position; at lengths: none
        before = np.broadcast_to(at - 1, (n, width)).copy()
        live = at < lengths[:, None]
        tree = np.full((n, 2 * size), _INF, np.int64)
        made = np.zeros((n, width), np.int64)
        rank, new = self.table.find(symbol[:, :-1].ravel(), symbol[:, 1:].ravel())
        pair = (rank.reshape(n, size) >= 0) & live[:, 1:]
        tree[:, size:] = np.where(pair, rank.reshape(n, size) << 20 | at[:-1], _INF)
        made[:, :-1] = new.reshape(n, size)
        for k in range(level - 1, -1, -1):
            lo = 1 << k
            tree[:, lo : 2 * lo] = np.minimum(tree[:, 2 * lo : 4 * lo : 2], tree[:, 2 * lo + 1 : 4 * lo : 2])
        row = np.flatnonzero(tree[:, 1] < _INF)
        while len(row):
            pos = tree[row, 1] & 0xFFFFF
            right = after[row, pos]
            nxt = after[row, right]
            prev = before[row, pos]
            symbol[row, pos] = made[row, pos]
            live[row, right] = False
            after[row, pos] = nxt
            has_next = nxt < lengths[row]
            before[row[has_next], nxt[has_next]] = pos[has_next]
            has_prev = prev >= 0
            inside = right < size  # the last position starts no pair and has no leaf
            tree[row[inside], right[inside] + size] = _INF
            self._leaf(tree, made, symbol, row, pos, np.where(has_next, nxt, -1), size)
            self._leaf(tree, made, symbol, row[has_prev], prev[has_prev], pos[has_prev], size)
            # the three leaves' ancestors, level by level
            rows = np.concatenate([row[inside], row[pos < size], row[has_prev]])
            node = np.concatenate([right[inside], pos[pos < size], prev[has_prev]]) + size
            for _ in range(level):
                node >>= 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            row = row[tree[row, 1] < _INF]
        return symbol[live], live.sum(1)

    def _leaf(self, tree, made, symbol, row, left, right, size):
        """Set the leaf of the pair that starts at ``left``; right -1: there is none."""
        some = right >= 0
        r, p = row[some], left[some]
        rank, new = self.table.find(symbol[r, p], symbol[r, right[some]])
        made[r, p] = new
        tree[r, p + size] = np.where(rank >= 0, rank << 20 | p, _INF)
        r, p = row[~some], left[~some]
        inside = p < size
        tree[r[inside], p[inside] + size] = _INF

    def _long(self, piece: bytes) -> np.ndarray:
        """One tree in plain lists: a logarithmic number of steps a merge, however long the piece."""
        one, n = self.table.one, len(piece)
        symbol = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        size = 1 << (n - 2).bit_length()
        inf = int(_INF)
        tree, made = [inf] * (2 * size), [0] * n
        for i in range(n - 1):
            if m := one.get(symbol[i] << 20 | symbol[i + 1]):
                tree[size + i], made[i] = m[0] << 32 | i, m[1]
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        live = bytearray(b"\1") * n

        def put(i: int, value: int) -> None:
            node = i + size
            tree[node] = value
            while node > 1:
                node >>= 1
                low = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == low:
                    return
                tree[node] = low

        def pair(i: int, j: int) -> None:
            m = one.get(symbol[i] << 20 | symbol[j]) if j < n else None
            made[i] = m[1] if m else 0
            put(i, m[0] << 32 | i if m else inf)

        while tree[1] < inf:
            i = tree[1] & 0xFFFFFFFF
            j = after[i]
            symbol[i], live[j] = made[i], 0
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            if j < n - 1:
                put(j, inf)
            pair(i, after[i])
            if before[i] >= 0:
                pair(before[i], i)
        return np.array([s for s, a in zip(symbol, live, strict=True) if a], np.uint32)

    def lookup(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words end to end, and their numbers."""
        cache = self.cache
        missing = [w for w in words if w not in cache]
        if missing:
            if len(cache) + len(missing) > _CACHE_LIMIT:  # what this chunk uses stays
                self.cache = cache = {w: got for w in words if (got := cache.get(w)) is not None}
            cache.update(zip(missing, self.merge(missing), strict=True))
        got = [cache[w] for w in words]
        return np.frombuffer(b"".join(got), np.uint32), np.array([len(g) >> 2 for g in got], np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts of a chunk end to end, and the offset of each text."""
        raw = data.tobytes()
        points = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        if not len(points):
            return np.empty(0, np.uint32), np.zeros(len(offsets), np.int64)
        lead = np.flatnonzero((data & 0xC0) != 0x80)  # the byte of each code point
        starts = lead[pretokens(points, np.searchsorted(lead, offsets))]
        ends = np.append(starts[1:], len(data))
        where, back = Spans(data).groups(starts, ends)
        flat, count = self.lookup([raw[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)])
        begin = np.cumsum(count) - count
        n = count[back]
        total = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(begin[back] - total[:-1], n) + np.arange(total[-1])]
        return ids, total[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray) -> bytes:
        start = self.token_start[ids]
        n = self.token_start[ids.astype(np.int64) + 1] - start
        total = np.concatenate([[0], np.cumsum(n)])
        return self.token_flat[np.repeat(start - total[:-1], n) + np.arange(total[-1])].tobytes()


@lru_cache(4)
def from_ranks(path: str) -> Bpe:
    return Bpe.from_ranks(path)


class JsonBpe(Bpe):
    """The same from a ``tokenizers`` file: only listed pairs merge, and strings of added tokens are cut out of a text before
    the pattern applies."""

    added: dict[str, int]

    @classmethod
    def from_json(cls, path: str) -> "JsonBpe":
        spec = json.load(open(path, encoding="utf-8"))
        shown = {c: b for b, c in enumerate(_shown_bytes())}
        vocab = {bytes(shown[c] for c in t): i for t, i in spec["model"]["vocab"].items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        raw = lambda t: bytes(shown[c] for c in t)
        rows = [(vocab[raw(a)], vocab[raw(b)], k, vocab[raw(a) + raw(b)]) for k, (a, b) in enumerate(pairs)]
        tokens = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            tokens[i] = t
        out = cls(MergeTable(*np.array(rows, np.int64).T), np.array([vocab[bytes([b])] for b in range(256)]), tokens, None)
        out.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        if not any(a.encode() in raw for a in self.added):
            return super().encode(data, offsets)
        cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        out: list[np.ndarray] = []
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            parts = []
            for part in cut.split(raw[a:b].decode()):
                if part in self.added:
                    parts.append(np.array([self.added[part]], np.uint32))
                elif part:
                    own = np.frombuffer(part.encode(), np.uint8)
                    parts.append(super().encode(own, np.array([0, len(own)]))[0])
            out.append(np.concatenate(parts) if parts else np.empty(0, np.uint32))
        return np.concatenate(out), np.concatenate([[0], np.cumsum([len(i) for i in out])])


def _shown_bytes() -> list[str]:
    """The character that stands for each byte in the file: itself if it is printable Latin-1, else the next one from 256 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(rest)) for b in range(256)]


@lru_cache(4)
def from_json(path: str) -> JsonBpe:
    return JsonBpe.from_json(path)
