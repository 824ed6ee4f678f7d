"""The byte-level BPE pre-tokeniser, for many texts at once, and a table of what each pre-token gives.

The pattern is ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``. Its matches are runs of
one class (letters, numbers, blanks, others), but for three things that can all be told from neighbours: a run takes one
space before it along; a run of blanks before it ends one short; and an apostrophe that starts a run of
others and is followed by one of the endings starts a pre-token that ends with the ending.
So boundaries are set by comparing arrays, without walking the text.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable

import numpy as np

from millrace.llm.textkit import span_hashes

_BLANK, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3
#: What the pattern takes for a blank.
_BLANKS = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_ONE = [ord(c) for c in "stmd"]
_TWO = [(ord(a), ord(b)) for a, b in ("re", "ve", "ll")]
_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The class of each code point, made once a process."""
    if not _classes:
        table = np.full(sys.maxunicode + 1, _OTHER, dtype=np.uint8)
        for c in range(sys.maxunicode + 1):
            kind = unicodedata.category(chr(c))[0]
            if kind == "L":
                table[c] = _LETTER
            elif kind == "N":
                table[c] = _NUMBER
        table[_BLANKS] = _BLANK
        _classes.append(table)
    return _classes[0]


def boundaries(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of texts that lie end to end as code points; offsets bound the texts."""
    n = len(points)
    if not n:
        return np.zeros(0, dtype=np.int64)
    kind = classes()[points]
    first = np.zeros(n + 1, dtype=bool)  # where a text starts; the end of the last as well
    first[offsets] = True
    change = first[:n].copy()
    change[1:] |= kind[1:] != kind[:-1]
    start = change.copy()
    run = np.flatnonzero(change & (kind != _BLANK) & ~first[:n])
    run = run[kind[run - 1] == _BLANK]
    spaced = points[run - 1] == 32
    start[run - 1] = True  # the last blank before a run stands apart from the blanks before it,
    start[run[spaced]] = False  # and a space goes with the run
    mark = np.flatnonzero(change & (points == 39))
    mark = mark[mark + 1 < n]
    mark = mark[start[mark] & ~first[mark + 1]]
    if len(mark):
        one = np.isin(points[mark + 1], _ONE)
        two = np.zeros(len(mark), dtype=bool)
        after = np.minimum(mark + 2, n - 1)
        inside = (mark + 2 < n) & ~first[np.minimum(mark + 2, n)]
        for a, b in _TWO:
            two |= inside & (points[mark + 1] == a) & (points[after] == b)
        for found, size in ((mark[one], 2), (mark[two], 3)):
            start[found + 1] = False
            later = found + size
            start[later[later < n]] = True
    return np.flatnonzero(start)


class PretokenTable:
    """For each distinct pre-token its list of ids (or one number): open addressing by 64-bit hash, then the texts are compared.

    `make` gives the lists of new pre-tokens. The table is emptied before it would hold over `most` pre-tokens, or `most_points` code
    points of them (ids are no more than bytes, so both bound them), but for what one call needs. A pre-token whose
    hash stands for another text is kept by its text, so what is found is always that of the pre-token itself.
    """

    def __init__(self, make: Callable[[list[str]], list[np.ndarray]], most: int = 1_000_000, most_points: int = 16_000_000) -> None:
        self.make, self.most, self.most_points = make, most, most_points
        self.clear()

    def clear(self) -> None:
        self.bits = 16
        self.keys = np.zeros(1 << self.bits, dtype=np.uint64)
        self.slot = np.full(1 << self.bits, -1, dtype=np.int32)
        self.count = 0
        self.start = np.zeros(1 << 14, dtype=np.int64)
        self.size = np.zeros(1 << 14, dtype=np.int32)
        self.ids = np.zeros(1 << 16, dtype=np.uint32)
        self.used = 0
        self.text_start = np.zeros(1 << 14, dtype=np.int64)
        self.text_size = np.zeros(1 << 14, dtype=np.int32)
        self.points = np.zeros(1 << 16, dtype=np.uint32)
        self.points_used = 0
        self.clashes: dict[str, int] = {}

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each pre-token in the table, -1 if it isn't there."""
        mask = np.uint64((1 << self.bits) - 1)
        at = (hashes & mask).astype(np.int64)
        found = np.full(len(hashes), -1, dtype=np.int32)
        left = np.arange(len(hashes))
        while len(left):
            place = at[left]
            number = self.slot[place]
            same = (self.keys[place] == hashes[left]) & (number >= 0)
            found[left[same]] = number[same]
            left = left[~same & (number >= 0)]
            at[left] = (at[left] + 1) & int(mask)
        return found

    def _insert(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        mask = (1 << self.bits) - 1
        at = (hashes & np.uint64(mask)).astype(np.int64)
        left = np.arange(len(hashes))
        while len(left):
            free = left[self.slot[at[left]] < 0]
            self.slot[at[free]] = numbers[free]  # of several for one place, one gets it
            won = free[self.slot[at[free]] == numbers[free]]
            self.keys[at[won]] = hashes[won]
            at[won] = -1
            left = left[at[left] >= 0]
            at[left] = (at[left] + 1) & mask

    def numbers(self, points: np.ndarray, text: str, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The number of each pre-token text[start:end], after making what is new; `points` are the code points of `text`."""
        found = self.find(hashes)
        new = np.flatnonzero(found < 0)
        if len(new):
            fresh, where = np.unique(hashes[new], return_index=True)
            points_made = int((ends[new[where]] - starts[new[where]]).sum())
            if self.count and (self.count + len(fresh) > self.most or self.points_used + points_made > self.most_points):
                self.clear()
                return self.numbers(points, text, starts, ends, hashes)
            texts = [text[s:e] for s, e in zip(starts[new[where]].tolist(), ends[new[where]].tolist())]
            self._add(texts)
            self._enter(fresh, np.arange(self.count - len(fresh), self.count, dtype=np.int32))
            found[new] = self.find(hashes[new])
        wrong = np.flatnonzero(~self._same(found, points, starts, ends))
        if len(wrong):
            texts = [text[s:e] for s, e in zip(starts[wrong].tolist(), ends[wrong].tolist())]
            unknown = [t for t in dict.fromkeys(texts) if t not in self.clashes]
            if unknown:
                self._add(unknown)
                self.clashes.update(zip(unknown, range(self.count - len(unknown), self.count)))
            found[wrong] = [self.clashes[t] for t in texts]
        return found

    def _same(self, numbers: np.ndarray, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether each pre-token has the text that its number stands for."""
        size = ends - starts
        same = self.text_size[numbers] == size
        size = np.where(same, size, 0)
        upto = np.cumsum(size)
        step = np.arange(int(upto[-1]) if len(upto) else 0)
        before = upto - size
        differs = self.points[step + np.repeat(self.text_start[numbers] - before, size)] != points[step + np.repeat(starts - before, size)]
        if differs.any():
            same[np.searchsorted(upto, np.flatnonzero(differs), side="right")] = False
        return same

    @staticmethod
    def _room(array: np.ndarray, size: int) -> np.ndarray:
        while len(array) < size:
            array = np.concatenate((array, np.zeros_like(array)))
        return array

    def _add(self, texts: list[str]) -> None:
        """Number new pre-tokens from `count` on."""
        lists = self.make(texts)
        for flat, sizes, start, size, store, used in (
            (np.concatenate(lists), [len(x) for x in lists], "start", "size", "ids", "used"),
            (np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), [len(t) for t in texts], "text_start", "text_size", "points", "points_used"),
        ):
            own, at = slice(self.count, self.count + len(texts)), getattr(self, used)
            for name in (start, size):
                setattr(self, name, self._room(getattr(self, name), own.stop))
            setattr(self, store, self._room(getattr(self, store), at + len(flat)))
            getattr(self, start)[own] = at + np.cumsum(sizes) - sizes
            getattr(self, size)[own] = sizes
            getattr(self, store)[at : at + len(flat)] = flat
            setattr(self, used, at + len(flat))
        self.count += len(texts)

    def _enter(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        """Let the hashes stand for the numbers."""
        if self.count * 2 > len(self.slot):
            old = self.slot >= 0
            hashes, numbers = np.concatenate((self.keys[old], hashes)), np.concatenate((self.slot[old], numbers))
            while self.count * 2 > 1 << self.bits:
                self.bits += 1
            self.keys = np.zeros(1 << self.bits, dtype=np.uint64)
            self.slot = np.full(1 << self.bits, -1, dtype=np.int32)
        self._insert(hashes, numbers)

    def lists(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pre-tokens end to end, and the bounds of each."""
        size = self.size[numbers].astype(np.int64)
        ends = np.concatenate(([0], np.cumsum(size)))
        place = np.repeat(self.start[numbers] - ends[:-1], size) + np.arange(int(ends[-1]))
        return self.ids[place], ends


#: Code points of texts that are handled at once; a longer single text is handled alone.
SLICE_POINTS = 1 << 19


def split_texts(texts: list[str | None], special: list[str]):
    """Slices of texts as (first row, rows, code points, offsets of segments, row of each segment, special number or -1, text).

    A special string is a segment of its own and bounds the pre-tokens around it.
    """
    row = 0
    while row < len(texts):
        parts: list[str] = []
        owner: list[int] = []
        marks: list[int] = []
        size, at = 0, row
        while at < len(texts) and (at == row or size + len(texts[at] or "") <= SLICE_POINTS):
            text = texts[at] or ""
            size += len(text)
            pieces = [(text, -1)]
            for k, mark in enumerate(special):
                if mark in text:
                    split: list[tuple[str, int]] = []
                    for piece, was in pieces:
                        if was >= 0:
                            split.append((piece, was))
                            continue
                        for i, rest in enumerate(piece.split(mark)):
                            split += [(mark, k)] * bool(i) + [(rest, -1)]
                    pieces = split
            for piece, mark in pieces:
                if piece:
                    parts.append(piece)
                    owner.append(at - row)
                    marks.append(mark)
            at += 1
        text = "".join(parts)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
        yield row, at - row, points, offsets, np.array(owner, dtype=np.int64), np.array(marks, dtype=np.int64), text
        row = at


def pretokens(points: np.ndarray, offsets: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes, segment of each) of the pre-tokens; a special segment is one pre-token."""
    starts = boundaries(points, offsets)
    segment = np.searchsorted(offsets, starts, side="right") - 1
    if (marks >= 0).any():
        keep = (marks[segment] < 0) | (starts == offsets[segment])
        starts, segment = starts[keep], segment[keep]
    ends = np.append(starts[1:], len(points))
    return starts, ends, span_hashes(points, starts, ends), segment
