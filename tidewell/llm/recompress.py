"""Substring dedup by recompression of word sequences.

Each text is a sequence of word symbols. Maximal runs of equal symbols become one, then pairs of neighbours do, one drawn from a left and one
from a right half of the alphabet, round after round. Equal word sequences get equal interior symbols in all documents; only their
ends depend on what surrounds them, and every symbol carries the stretch of words that decides it.

1. Reveal. Symbols get provisional names, hashes of what they stand for, and the engine asks globally which high-level symbols occur in different
   texts. A window of `window` words that contains the deciding stretch of a symbol of one text only cannot be repeated and is
   ruled out; of the windows that remain, the same is asked of each as a whole. Hash collisions can only leave a window in, never rule one out.
2. Name. For the stretches that remain, Spark rounds name words, then runs and pairs, globally: each block sends the different
   definitions that it has (the bytes of words, pairs of names) to the partitions that own them, and these give out numbers. Equal numbers mean equal words: definitions
   are compared as they are, not by hash. Between rounds a block keeps the numbers only; its symbols follow from its text and from them.
3. Verify. Every window picks the highest symbol that it decides as its anchor and meets the other windows with that anchor. The anchor's name
   verifies the words under it; the words to its left and right are compared one by one, by their numbers. A symbol that more than
   blocks.HOT_BLOCKS blocks have is no anchor, and windows without an anchor are dealt out by all their words, so a common phrase in many contexts spreads over all partitions.

No repeat is lost: a repeated window decides the same symbols wherever it lies. Exact copies of a smaller document are recognised as a whole by
128 bits of BLAKE2, and what copies share among themselves counts once.

Ids are numbers, or text that reads as one; other text as an id is an error of the cast. Null, empty and blank texts have no words. Rows of equal id do not remove each other's words. A null id counts as
greater than all ids. A long text is a block by itself. Columns besides id and text are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks as B
from .common import mix64, table, words8

WINDOW = 13
RAW_PER_PARTITION = 64 << 20
#: Rounds of pairs in which provisional names are given, and in which global ones are.
ROUNDS, NAMED_ROUNDS = 4, 2

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_LETTER = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Words:
    """The words of a block: a hash, the text and the bytes of each, and the words of each text. Different words may have one hash."""

    def __init__(self, block: B.Block, only: np.ndarray | None = None):
        """only: the places of the texts to read; the others count as empty."""
        hashes, owners, begins, sizes = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        texts = np.arange(len(block.ids)) if only is None else only
        total, at = np.cumsum(block.lengths[texts]), 0
        while at < len(texts):  # a few hundred kilobytes at a time, whole texts
            to = max(at + 1, int(np.searchsorted(total, total[at] - block.lengths[texts[at]] + (1 << 19), side="right")))
            own = texts[at:to]
            joined = b"\n".join(block.text(i) for i in own.tolist()) + b"\n"
            data = np.frombuffer(joined, dtype=np.uint8)
            word = ~_SPACE[data]
            edge = np.flatnonzero(word[1:] != word[:-1]) + 1
            if word[0]:
                edge = np.r_[0, edge]
            starts, ends = edge[::2], edge[1::2]
            sums = np.zeros(len(data) + 1, dtype=np.uint64)
            np.cumsum(_LETTER[data] * _powers(_ODD, len(data)), out=sums[1:])
            h = (sums[ends] - sums[starts]) * _powers(_INVERSE, len(data))[starts]
            hashes.append(mix64(h ^ (ends - starts).astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB)))
            bounds = np.cumsum(block.lengths[own] + 1)
            text = np.searchsorted(bounds, starts, side="right")
            owners.append(own[text])
            begins.append(starts - np.r_[0, bounds][text] + block.starts[own[text]])
            sizes.append(ends - starts)
            at = to
        self.hash, self.owner, self.begin, self.size = (np.concatenate(x) for x in (hashes, owners, begins, sizes))
        self.first = np.searchsorted(self.owner, np.arange(len(block.ids) + 1))

    def windows(self, size: int) -> np.ndarray:
        """The start of every window of words that lies in one text."""
        n = len(self.hash) - size + 1
        return np.flatnonzero(self.owner[:n] == self.owner[size - 1 :]) if n > 0 else np.zeros(0, dtype=np.int64)

    def window_hashes(self, start: np.ndarray, size: int) -> np.ndarray:
        total = np.zeros(max(0, len(self.hash) - size + 1), dtype=np.uint64)
        for k in range(size):
            total = total * _ODD + self.hash[k : k + len(total)]
        return mix64(total[start])


_FAR = 1 << 40


def _runs(x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the maximal runs of equal symbols of one owner."""
    start = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (x[1:] != x[:-1])]) if len(x) else np.zeros(0, dtype=np.int64)
    return start, np.r_[start[1:], len(x)].astype(np.int64)


def _pairs(right: np.ndarray, own: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which symbols become one with the next, and the words [lo, hi) that decide each symbol after that (of a pair: at its first).

    right: the half of the alphabet that each symbol is in. A left symbol that stays single depends on what follows, a right one on what precedes;
    at the ends of a text or stretch that lies beyond it.
    """
    same = own[1:] == own[:-1]
    pair = np.zeros(len(right), dtype=bool)
    pair[:-1] = same & ~right[:-1] & right[1:]
    after, before = np.full(len(right), _FAR), np.full(len(right), -_FAR)
    after[:-1][same], before[1:][same] = hi[1:][same], lo[:-1][same]
    nxt = np.minimum(np.arange(len(right)) + 1, len(right) - 1)
    new_lo = np.where(pair, np.minimum(lo, lo[nxt]), np.where(right, np.minimum(lo, before), lo))
    new_hi = np.where(pair, np.maximum(hi, hi[nxt]), np.where(right, hi, np.maximum(hi, after)))
    return pair, new_lo, new_hi


def _half(x: np.ndarray, r: int) -> np.ndarray:
    return (mix64(x ^ np.uint64(r * 0x51ED270B)) >> np.uint64(13)) & np.uint64(1) == 1


def _stay(pair: np.ndarray) -> np.ndarray:
    """All but the second symbols of pairs."""
    return ~np.r_[False, pair[:-1]] if len(pair) else pair


def symbols(words: Words, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(provisional name, owner, lo, hi): the symbols after the last round, and the words [lo, hi) that decide each; these may reach beyond its text."""
    start, end = _runs(words.hash, words.owner)
    length = end - start
    x, own = words.hash[start], words.owner[start]
    x = np.where(length > 1, mix64(x + length.astype(np.uint64) * _ODD), x)
    lo, hi = start - 1, end + 1  # a run ends where its neighbours differ
    for r in range(1, rounds + 1):
        if not len(x):
            break
        pair, lo, hi = _pairs(_half(x, r), own, lo, hi)
        x = np.where(pair, mix64(x * _ODD + mix64(np.r_[x[1:], x[:1]] + np.uint64(r))), x)
        stays = _stay(pair)
        x, own, lo, hi = x[stays], own[stays], lo[stays], hi[stays]
    return x, own, lo, hi


def _names(words: Words, window: int, n_parts: int) -> tuple[B.Names, np.ndarray, np.ndarray]:
    """The symbols that some window of their text contains with all that decides them."""
    x, own, lo, hi = symbols(words)
    inside = (hi - lo <= window) & (lo >= words.first[own]) & (hi <= words.first[own + 1])
    x, own, lo, hi = x[inside], own[inside], lo[inside], hi[inside]
    return B.Names(own, mix64(x ^ np.uint64(0x1D8E4E27C47D124F)), n_parts), lo, hi


def _candidates(words: Words, window: int, n_parts: int, answers: dict[int, bytes]) -> np.ndarray:
    """The start of each window that may be repeated."""
    names, lo, hi = _names(words, window, n_parts)
    shared, _ = names.verdicts(answers)
    dead = np.zeros(len(words.hash) + 1, dtype=np.int64)
    np.add.at(dead, np.maximum(hi[~shared] - window, 0), 1)
    np.add.at(dead, lo[~shared] + 1, -1)
    start = words.windows(window)
    return start[np.cumsum(dead)[start] == 0]


# ---- global names --------------------------------------------------------------------------------------------------


def _number(k: np.ndarray, part: int, n_parts: int, level: int) -> np.ndarray:
    """The name of the k-th definition of a partition: different for different definitions, partitions and levels."""
    return ((k.astype(np.uint64) * np.uint64(n_parts) + np.uint64(part)) * np.uint64(NAMED_ROUNDS + 1) + np.uint64(level)) + np.uint64(1)


def _split(part: np.ndarray) -> dict[int, np.ndarray]:
    """The places of each partition."""
    order = np.argsort(part, kind="stable")
    parts, first = np.unique(part[order], return_index=True)
    return dict(zip(parts.tolist(), np.split(order, first[1:]), strict=True)) if len(part) else {}


def _owner(h: np.ndarray, n_parts: int) -> np.ndarray:
    return (mix64(h ^ np.uint64(0x589965CC75374CC3)) % np.uint64(n_parts)).astype(np.int64)


def _reply_words(n_parts: int, hot: int):
    """Numbers for words, which come as their bytes."""

    def reply(part: int, payloads: list[bytes]) -> list[bytes]:
        asked = [B.load(p) for p in payloads]
        askers: dict[bytes, int] = {}
        for words in asked:
            for w in words:
                askers[w] = askers.get(w, 0) + 1
        number = dict(zip(sorted(askers), _number(np.arange(len(askers)), part, n_parts, 0).tolist(), strict=True))
        return [B.dump((np.array([number[w] for w in words], dtype=np.uint64), np.array([askers[w] > hot for w in words], dtype=bool))) for words in asked]

    return reply


def _reply_pairs(n_parts: int, level: int, hot_blocks: int):
    """Numbers for pairs of codes, each of a symbol and how often it is repeated; the second is zero for a run by itself."""

    def reply(part: int, payloads: list[bytes]) -> list[bytes]:
        asked = [B.load(p) for p in payloads]
        every = np.concatenate(asked)
        order = np.lexsort((every[:, 1], every[:, 0]))
        x = every[order]
        new = np.r_[True, (x[1:] != x[:-1]).any(axis=1)]
        k = np.empty(len(x), dtype=np.int64)
        k[order] = np.cumsum(new) - 1
        hot = np.bincount(k) > hot_blocks  # a block asks once
        sizes = np.cumsum([len(a) for a in asked])[:-1]
        return [B.dump((n, h)) for n, h in zip(np.split(_number(k, part, n_parts, level), sizes), np.split(hot[k], sizes), strict=True)]

    return reply


class _Live:
    """The stretches of words of a block that may be repeated: their symbols so far, and the anchor of each of their windows.

    Words count from 0 on over all stretches. Symbols: x (name), own (stretch), a and b (the words it stands for), lo and hi (the words that
    decide it). Anchors: first word, size and name, for each word that starts a window; name zero where there is none.
    """

    def __init__(self, start: np.ndarray, owner: np.ndarray, ids: np.ndarray, window: int):
        """start: the words where windows begin. owner: the text of each of these. ids: of the texts."""
        at = np.flatnonzero(np.r_[True, (start[1:] != start[:-1] + 1) | (owner[1:] != owner[:-1])][: len(start)])
        first, count = start[at], np.diff(np.r_[at, len(start)])
        self.window, self.first, self.count, self.ids = window, first, count, ids[owner[at]]
        size = count + window - 1
        self.offset = np.cumsum(size) - size
        n = int(size.sum())
        self.own = np.repeat(np.arange(len(first)), size)
        self.place = np.arange(n) - self.offset[self.own] + first[self.own] if n else np.zeros(0, dtype=np.int64)
        self.is_start = np.arange(n) - self.offset[self.own] < count[self.own]
        self.a = self.lo = np.arange(n)
        self.b = self.hi = np.arange(n) + 1
        self.words = self.x = np.zeros(n, dtype=np.uint64)
        self.anchor, self.anchor_size, self.anchor_name = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.uint64)

    def name(self, at: np.ndarray, names: np.ndarray, hot: np.ndarray) -> None:
        """Gives the symbols at some places their names. Windows that decide one that is not hot take it as anchor: the least by hash, the first of equal ones."""
        self.x = self.x.copy()
        self.x[at] = names
        inside = ~hot & (self.hi[at] - self.lo[at] <= self.window) & (self.lo[at] >= self.offset[self.own[at]]) & (self.hi[at] <= (self.offset + self.count + self.window - 1)[self.own[at]])
        at = at[inside]
        if not len(at):
            return
        key = mix64(self.x[at])
        least, leftmost = np.full(len(self.words), np.uint64(0xFFFFFFFFFFFFFFFF)), np.full(len(self.words), _FAR)
        lo, hi = self.lo[at], self.hi[at]
        first = np.maximum(hi - self.window, self.offset[self.own[at]])
        for k in range(self.window):
            ok = lo - k >= first
            np.minimum.at(least, lo[ok] - k, key[ok])
        for k in range(self.window):
            ok = lo - k >= first
            ok[ok] = least[lo[ok] - k] == key[ok]
            np.minimum.at(leftmost, lo[ok] - k, at[ok])
        got = np.flatnonzero(self.is_start & (leftmost < _FAR))
        symbol = leftmost[got]
        self.anchor[got], self.anchor_size[got], self.anchor_name[got] = self.a[symbol], self.b[symbol] - self.a[symbol], self.x[symbol]

    def name_words(self, of: np.ndarray, names: np.ndarray, hot: np.ndarray) -> None:
        self.name(np.arange(len(of)), names[of], hot[of])
        self.words = self.x

    def pair(self, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Makes the symbols of this level, of runs of words and pairs at the first and pairs afterwards: (definitions, symbols to name, definition of each)."""
        none = np.zeros(0, dtype=np.int64)
        if not len(self.x):
            return np.zeros((0, 2), dtype=np.uint64), none, none
        bits = np.uint64(self.window.bit_length() + 1)
        length = np.ones(len(self.x), dtype=np.int64)
        if level == 1:
            start, end = _runs(self.x, self.own)
            length = np.minimum(end - start, 2 * self.window)  # no window decides a longer run
            self.a, self.b, self.lo, self.hi = self.a[start], self.b[end - 1], start - 1, end + 1
            self.x, self.own = self.x[start], self.own[start]
            change = self.own[1:] != self.own[:-1]
            self.lo, self.hi = np.where(np.r_[True, change], -_FAR, self.lo), np.where(np.r_[change, True], _FAR, self.hi)
        code = (self.x << bits) + length.astype(np.uint64)
        pair, lo, hi = _pairs(_half(code, level), self.own, self.lo, self.hi)
        nxt, b = np.r_[code[1:], code[:1]], np.where(pair, np.r_[self.b[1:], self.b[:1]], self.b)
        stays = _stay(pair)
        self.x, self.own, self.a, self.b, self.lo, self.hi = (v[stays] for v in (self.x, self.own, self.a, b, lo, hi))
        define, pair, code, nxt = (pair | (length > 1))[stays], pair[stays], code[stays], nxt[stays]
        first = np.flatnonzero(define)
        wanted = np.stack([code[first], np.where(pair[first], nxt[first], np.uint64(0))], axis=1)
        order = np.lexsort((wanted[:, 1], wanted[:, 0]))
        x = wanted[order]
        new = np.r_[True, (x[1:] != x[:-1]).any(axis=1)][: len(x)]
        of = np.empty(len(x), dtype=np.int64)
        of[order] = np.cumsum(new) - 1
        return x[new], first, of


def distinct_words(block: B.Block, words: Words, place: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(the different words at some places, a hash of each, which one is at each place). Words of one hash are compared byte by byte."""
    h, begin, size = words.hash[place], words.begin[place], words.size[place]
    each, one, of = np.unique(h, return_index=True, return_inverse=True)
    data, w = block.data, words8(np.frombuffer(block.data, dtype=np.uint8))
    same = size == size[one][of]
    live, at = np.flatnonzero(same), 0
    while len(live):
        left = size[live] - at
        mask = np.where(left >= 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (8 * np.minimum(left, 7)).astype(np.uint64)) - np.uint64(1))
        differ = ((w[begin[live] + at] ^ w[begin[one][of[live]] + at]) & mask) != 0
        same[live[differ]] = False
        at += 8
        live = live[~differ & (left > 8)]
    if same.all():
        return [data[i : i + n] for i, n in zip(begin[one].tolist(), size[one].tolist(), strict=True)], each, of
    known: dict[tuple[int, bytes], int] = {}
    of = np.array([known.setdefault((x, data[i : i + n]), len(known)) for x, i, n in zip(h.tolist(), begin.tolist(), size.tolist(), strict=True)], dtype=np.int64)
    return [w for _, w in known], np.array([x for x, _ in known], dtype=np.uint64), of


def _collect(places: dict[int, np.ndarray], answers: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(names, whether they are hot) of definitions, from the answers of their owners."""
    n = sum(map(len, places.values()))
    names, hot = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=bool)
    for part, at in places.items():
        names[at], hot[at] = B.load(answers[part])
    return names, hot


def _replay(block: B.Block, state: dict, answers: dict[int, bytes] | None, n_parts: int) -> tuple[_Live, list, dict[int, np.ndarray]]:
    """The live stretches with all names known so far, those of answers among them; and the definitions to ask next, with their owners.

    state: texts (places of those with live windows), windows (bits, one for each word of these texts), window, and tables (names and hot bits, for each level).
    Appends to the tables. After the last level there is nothing to ask.
    """
    words = Words(block, state["texts"])
    start = np.flatnonzero(np.unpackbits(state["windows"], count=len(words.hash)))
    live = _Live(start, words.owner[start], block.ids, state["window"])
    asked, h, of = distinct_words(block, words, live.place)
    places = _split(_owner(h, n_parts))
    tables = state["tables"]
    for level in range(NAMED_ROUNDS + 1):
        if level == len(tables):
            if answers is None:
                return live, asked, places
            tables.append(_collect(places, answers))
            answers = None
        if level == 0:
            live.name_words(of, *tables[0])
        else:
            live.name(first, *(t[of] for t in tables[level]))
        if level < NAMED_ROUNDS:
            asked, first, of = live.pair(level + 1)
            places = _split(_owner(mix64(asked[:, 0]) + asked[:, 1], n_parts))
    return live, [], {}


# ---- verification --------------------------------------------------------------------------------------------------


class _Segments:
    """The different runs of windows of a block with one anchor, each with the least id that has it, for the partition that owns the anchor."""

    def __init__(self, live: _Live, n_parts: int):
        start = np.flatnonzero(live.is_start)
        own = np.searchsorted(live.offset, start, side="right") - 1
        name, anchor = live.anchor_name[start], live.anchor[start]
        new = np.r_[True, (start[1:] != start[:-1] + 1) | (own[1:] != own[:-1]) | (name[1:] != name[:-1]) | (anchor[1:] != anchor[:-1]) | (name[1:] == 0)][: len(start)]
        at = np.flatnonzero(new)
        self.first, self.count, self.ids = start[at], np.diff(np.r_[at, len(start)]), live.ids[own[at]]
        self.place = live.place[self.first] if len(at) else np.zeros(0, dtype=np.int64)  # word of the live texts
        known: dict[tuple, int] = {}
        self.of, least, self.items = np.empty(len(at), dtype=np.int64), [], []
        words = live.words.tobytes()
        h = []
        for r, (f, c, a, size, n, i) in enumerate(zip(self.first.tolist(), self.count.tolist(), anchor[at].tolist(), live.anchor_size[self.first].tolist(), name[at].tolist(), self.ids.tolist(), strict=True)):
            a = a if n else f
            item = (n, a - f, size if n else 0, c, words[8 * f : 8 * a] + words[8 * (a + (size if n else 0)) : 8 * (f + c + live.window - 1)])
            k = known.setdefault(item, len(known))
            if k == len(least):
                least.append(i)
                self.items.append(item)
                h.append(n)
            elif i < least[k]:
                least[k] = i
            self.of[r] = k
        self.least = np.array(least, dtype=np.int64)
        h = np.array(h, dtype=np.uint64)
        for k in np.flatnonzero(h == 0).tolist():  # no anchor: all words decide
            h[k] = np.bitwise_xor.reduce(mix64(np.frombuffer(self.items[k][4], dtype=np.uint64) * _powers(_ODD, live.window)))
        self.places = _split(_owner(h, n_parts))

    def payloads(self) -> Iterator[tuple[int, bytes]]:
        for part, at in self.places.items():
            mine = [self.items[k] for k in at.tolist()]
            head = np.array([(n, d, s, c) for n, d, s, c, _ in mine], dtype=np.uint64)
            yield part, B.dump((head, self.least[at], b"".join(w for *_, w in mine)))

    def gone(self, answers: dict[int, bytes]) -> np.ndarray:
        """The first words of the windows that a smaller document has too."""
        size = np.zeros(len(self.least), dtype=np.int64)
        size[self.of] = self.count
        base = np.cumsum(size) - size
        later = np.zeros(int(size.sum()), dtype=bool)
        for part, at in self.places.items():
            n = size[at]
            place = np.repeat(base[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            later[place] = np.unpackbits(np.frombuffer(answers[part], dtype=np.uint8), count=int(n.sum()))
        n = self.count
        i = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return (np.repeat(self.place, n) + i)[later[np.repeat(base[self.of], n) + i] | np.repeat(self.ids > self.least[self.of], n)]


def _rows(head: np.ndarray, words: np.ndarray, window: int) -> np.ndarray:
    """A row for each window: anchor, its place in the window, and the words outside it (zero inside)."""
    name, offset, size, count = head[:, 0], *head[:, 1:].astype(np.int64).T
    lengths = count + window - 1 - size
    base = np.cumsum(lengths) - lengths
    of = np.repeat(np.arange(len(head)), count)
    i = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    out = np.zeros((len(of), window + 2), dtype=np.uint64)
    out[:, 0], out[:, 1] = name[of], (offset[of] - i).astype(np.uint64)
    for t in range(window):
        at = i + t
        left, right = at < offset[of], at >= (offset + size)[of]
        place = base[of] + at - np.where(right, size[of], 0)
        seen = left | right
        out[seen, 2 + t] = words[place[seen]]
    return out


def least_of_equal(rows: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each row: the least id among the rows equal to it. Rows are sorted by a hash and compared as they are."""
    h = mix64(rows[:, 0])
    for t in range(1, rows.shape[1]):
        h = mix64(h * _ODD + rows[:, t])
    order = np.argsort(h, kind="stable")

    def starts(order: np.ndarray) -> np.ndarray:
        x = rows[order]
        return np.r_[True, (x[1:] != x[:-1]).any(axis=1)]

    new = starts(order)
    if (new[1:] & (h[order][1:] == h[order][:-1])).any():  # different rows with one hash: sort by the rows themselves
        order = np.lexsort(rows.T)
        new = starts(order)
    at = np.flatnonzero(new)
    out = np.empty(len(rows), dtype=np.int64)
    out[order] = np.repeat(np.minimum.reduceat(ids[order], at), np.diff(np.r_[at, len(rows)]))
    return out


def _reply_windows(window: int):
    """For each window of each segment: whether a smaller id has it."""

    def reply(part: int, payloads: list[bytes]) -> list[bytes]:
        asked = [B.load(p) for p in payloads]
        rows = np.concatenate([_rows(head, np.frombuffer(words, dtype=np.uint64), window) for head, _, words in asked])
        ids = np.concatenate([np.repeat(least, head[:, 3].astype(np.int64)) for head, least, _ in asked])
        later = least_of_equal(rows, ids) < ids
        sizes = np.cumsum([int(head[:, 3].sum()) for head, *_ in asked])[:-1]
        return [np.packbits(x).tobytes() for x in np.split(later, sizes)]

    return reply


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())])


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the remaining words, joined by spaces), one row for each row of docs."""
    packed = B.pack(docs, doc_id, text)
    n_parts, hot = B.partitions(packed, RAW_PER_PARTITION), B.HOT_BLOCKS

    def read(block: B.Block, copy: np.ndarray) -> Words:
        return Words(block, np.flatnonzero(np.unpackbits(copy, count=len(block.ids)) == 0))

    def whole(words: Words, start: np.ndarray) -> B.Names:
        return B.Names(words.owner[start], words.window_hashes(start, window), n_parts)

    def reveal(block: B.Block, answers: dict[int, bytes]) -> pa.Table:
        copy = np.packbits(B.read_copies(block, answers, n_parts))
        return B.questions_table(block.block, copy, _names(read(block, copy), window, n_parts)[0].questions())

    def begin(block: B.Block, answers: dict[int, bytes]) -> pa.Table:
        copy = B.kept(answers)
        words = read(block, copy)
        start = _candidates(words, window, n_parts, answers)
        live = np.zeros(len(words.hash), dtype=bool)
        live[start] = True
        return B.questions_table(block.block, (copy, np.packbits(live)), whole(words, start).questions())

    def prune(block: B.Block, answers: dict[int, bytes]) -> pa.Table:
        copy, bits = B.kept(answers)
        words = read(block, copy)
        start = np.flatnonzero(np.unpackbits(bits, count=len(words.hash)))
        start = start[whole(words, start).verdicts(answers)[0]]
        live = np.zeros(len(words.hash), dtype=bool)
        live[start] = True
        texts = np.unique(words.owner[start])
        inside = np.zeros(len(block.ids), dtype=bool)
        inside[texts] = True
        state = {"copy": copy, "texts": texts, "windows": np.packbits(live[inside[words.owner]]), "window": window, "tables": []}
        _, asked, places = _replay(block, state, None, n_parts)
        return B.questions_table(block.block, state, [(part, B.dump([asked[k] for k in at.tolist()])) for part, at in places.items()])

    def name(block: B.Block, answers: dict[int, bytes]) -> pa.Table:
        state = B.kept(answers)
        live, asked, places = _replay(block, state, answers, n_parts)
        if len(state["tables"]) <= NAMED_ROUNDS:
            return B.questions_table(block.block, state, [(part, B.dump(asked[at])) for part, at in places.items()])
        segments = _Segments(live, n_parts)
        found = list(segments.payloads())
        segments.items = []
        return B.questions_table(block.block, (state["copy"], state["texts"], segments), found)

    def finish(block: B.Block, answers: dict[int, bytes]) -> pa.Table:
        bits, texts, segments = B.kept(answers)
        copy = np.unpackbits(bits, count=len(block.ids)).astype(bool)
        gone = segments.gone(answers)
        split = [block.text(i).split() for i in range(len(block.ids))]
        n_words = np.array([len(w) for w in split], dtype=np.int64)
        first = np.zeros(len(block.ids), dtype=np.int64)  # of the words of the live texts
        first[texts] = np.cumsum(n_words[texts]) - n_words[texts]
        cover = np.zeros(int(n_words[texts].sum()) + 1, dtype=np.int64)
        np.add.at(cover, gone, 1)
        np.add.at(cover, gone + window, -1)
        removed = np.cumsum(cover[:-1]) > 0
        live = np.zeros(len(block.ids), dtype=bool)
        live[texts] = True
        counts, kept = np.zeros(len(block.ids), dtype=np.int64), []
        for i, w in enumerate(split):
            if copy[i] and len(w) >= window:
                counts[i], w = len(w), []
            elif live[i]:
                g = removed[first[i] : first[i] + len(w)]
                counts[i] = np.count_nonzero(g)
                w = [x for x, gone in zip(w, g.tolist(), strict=True) if not gone] if counts[i] else w
            kept.append(b" ".join(w))
        return pa.table([pa.array(block.ids, mask=block.ids == B.NO_ID), pa.array(n_words), pa.array(counts), pa.array(kept, pa.binary())], schema=_OUT)

    def proceed(answers: DataFrame, step) -> DataFrame:
        return B.proceed(packed, answers, step, B.QUESTION, B.QUESTION_TYPES)

    answers = B.answer(proceed(B.copies(packed, n_parts), reveal), B.reply_names(hot), n_parts)
    answers = B.answer(proceed(answers, begin), B.reply_names(hot), n_parts)
    answers = B.answer(proceed(answers, prune), _reply_words(n_parts, hot), n_parts)
    for level in range(1, NAMED_ROUNDS + 1):
        answers = B.answer(proceed(answers, name), _reply_pairs(n_parts, level, hot), n_parts)
    answers = B.answer(proceed(answers, name), _reply_windows(window), n_parts)
    out = B.proceed(packed, answers, finish, "doc_id long, n_words long, n_removed long, kept binary", _OUT)
    return out.withColumn("kept", F.col("kept").cast("string"))


def op6_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i, ws FROM d WHERE len(ws) >= 13),
h AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY array_to_string(ws[i:i + 12], ' ')) AS least FROM g),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM h WHERE least < doc_id),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS j FROM d),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS kept, count(*) AS n FROM w ANTI JOIN c USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
