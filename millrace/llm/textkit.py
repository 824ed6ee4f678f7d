"""Vectorised text handling for Arrow batches: words, their hashes and shingles, on whole texts.

Everything works on the UTF-8 bytes of a batch of texts laid end to end. A word is a run of bytes
outside [\\x20\\x09-\\x0D]; A-Z are lower-cased. Hashes have 64 bits and are mixed from two polynomials, one modulo
2^64 and one modulo the prime 2^31 - 1: words built so that the first gives them one value, as those that follow
the Thue-Morse sequence are, differ in the second. What must be exact compares the texts themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are handled at once (under 2^20, so the tables of powers have 16 MB); a longer single text is handled alone.
SLICE_BYTES = (1 << 20) - 1024

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)  # odd, so invertible modulo 2^64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes that part words when only letters and digits make words; those of longer characters count as letters.
NON_WORD = np.ones(256, dtype=bool)
NON_WORD[128:] = NON_WORD[48:58] = NON_WORD[65:91] = NON_WORD[97:123] = False


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_PRIME = (1 << 31) - 1
_SMALL_BASE = 1_193_810_247
_powers: dict[int, tuple[np.ndarray, ...]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, ...]:
    """base^i and base^-i for i up to n at least, modulo 2^64 and modulo the prime."""
    size = 1 << max(16, int(n).bit_length())
    size = max([size, *_powers])  # a longer table that is there serves as well
    if size not in _powers:
        up, down = np.full(size, _BASE, dtype=_U), np.full(size, _U(pow(int(_BASE), -1, 1 << 64)), dtype=_U)
        up[0] = down[0] = 1
        tables = [np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)]
        for base in (_SMALL_BASE, pow(_SMALL_BASE, -1, _PRIME)):
            powers, have = np.ones(size, dtype=_U), 1
            while have < size:  # each step doubles what is there
                powers[have : 2 * have] = powers[:have] * _U(pow(base, have, _PRIME)) % _U(_PRIME)
                have *= 2
            tables.append(powers.astype(np.uint32))
        if size > 1 << 23:  # made for one very long text; not worth keeping
            return tuple(tables)
        _powers.clear()
        _powers[size] = tuple(tables)
    return _powers[size]


class SpanHasher:
    """64-bit hashes of values[start:end] for any spans: polynomials by prefix sums, then mixed.

    The second sums are of residues below 2^32, so they are exact up to 2^32 values.
    """

    def __init__(self, values: np.ndarray) -> None:
        n = len(values)
        up, self.down, small_up, self.small_down = _power_tables(n + 1)
        self.sums, self.small = np.zeros(n + 1, dtype=_U), np.zeros(n + 1, dtype=_U)
        terms = values.astype(_U)
        terms += _U(1)
        np.cumsum(terms * up[:n], dtype=_U, out=self.sums[1:])
        terms *= small_up[:n]
        terms = (terms & _U(_PRIME)) + (terms >> _U(31))  # 2^31 is 1 modulo the prime
        np.cumsum(terms, dtype=_U, out=self.small[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        wide = (self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93)
        small = (self.small[ends] - self.small[starts]) % _U(_PRIME) * self.small_down[starts] % _U(_PRIME)
        return mix(wide ^ (small * _U(0xA24BAED4963EE407)))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return SpanHasher(values)(starts, ends)


def text_slices(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Slices of a string column as (first row, bytes, offsets of its rows); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] + SLICE_BYTES, side="right")) - 1)
        stop = min(stop, n)
        yield row, raw[ends[row] : ends[stop]], ends[row : stop + 1] - ends[row]
        row = stop


def word_spans(raw: np.ndarray, offsets: np.ndarray, apart: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of the texts in a slice: (starts, ends, bounds), bounds being the first word of each text."""
    inside = ~apart[raw]
    starts_here = inside.copy()
    starts_here[1:] &= ~inside[:-1]
    first = offsets[:-1]
    first = first[first < len(raw)]
    starts_here[first] = inside[first]  # a text does not go on from the one before
    ends_here = inside.copy()
    ends_here[:-1] &= ~inside[1:]
    last = offsets[1:] - 1
    last = last[last >= 0]
    ends_here[last] = inside[last]
    starts, ends = np.flatnonzero(starts_here), np.flatnonzero(ends_here) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def words(raw: np.ndarray, offsets: np.ndarray, apart: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the texts in a slice, A-Z lower-cased: (hashes, starts, ends, bounds)."""
    starts, ends, bounds = word_spans(raw, offsets, apart)
    return span_hashes(_LOWER[raw], starts, ends), starts, ends, bounds


def exact_numbers(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, hasher: SpanHasher, owner: np.ndarray | None = None) -> np.ndarray:
    """A number for each span raw[start:end], equal for spans of equal bytes (and equal owner) and no others.

    Spans are grouped by the hash that `hasher`, made for `raw`, gives; each is then compared with the first of its group, byte by byte.
    """
    keys = hasher(starts, ends)
    if owner is not None:
        keys = mix(keys ^ mix(owner.astype(_U) + _BASE))
    _, first, numbers = np.unique(keys, return_index=True, return_inverse=True)
    sizes, model = ends - starts, first[numbers]
    same = sizes == sizes[model]
    if owner is not None:
        same &= owner == owner[model]
    if same.all():
        other = np.flatnonzero(model != np.arange(len(model)))
        width = sizes[other]
        inner = np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width, width)
        if (raw[inner + np.repeat(starts[other], width)] == raw[inner + np.repeat(starts[model[other]], width)]).all():
            return numbers
    held: dict[tuple, int] = {}  # two spans share a hash
    owners = [0] * len(starts) if owner is None else owner.tolist()
    return np.array([held.setdefault((o, raw[s:e].tobytes()), len(held)) for o, s, e in zip(owners, starts.tolist(), ends.tolist())], dtype=np.int64)


def shingles(hashes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word shingles of each text, sorted, end to end, and the bounds of the texts in them.

    A text with fewer than `size` words has its whole sequence as one shingle; one without words has none.
    """
    n = len(hashes)
    counts = np.diff(bounds)
    rolled = np.zeros(max(0, n - size + 1), dtype=_U)
    for k in range(size):
        rolled = rolled * _BASE + hashes[k : n - size + 1 + k] if len(rolled) else rolled
    rolled = mix(rolled)
    out, ends = [], np.zeros(len(counts) + 1, dtype=np.int64)
    for i, c in enumerate(counts.tolist()):
        at = int(bounds[i])
        if c >= size:
            own = np.sort(rolled[at : at + c - size + 1])
            if len(own) > 1:
                own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif c:
            h = _U(c)
            with np.errstate(over="ignore"):
                for w in hashes[at : at + c]:
                    h = h * _BASE + w
            own = mix(np.array([h], dtype=_U))
        else:
            own = rolled[:0]
        out.append(own)
        ends[i + 1] = ends[i] + len(own)
    return (np.concatenate(out) if out else rolled[:0]), ends
