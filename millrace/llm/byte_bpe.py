"""A byte-level BPE vocabulary from a tokenizer.json file, and its merges by rank-synchronous array steps."""

from __future__ import annotations

import json

import numpy as np


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: printable Latin-1 for itself, the rest from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, more = [""] * 256, 256
    for b in range(256):
        if b in own:
            letters[b] = chr(b)
        else:
            letters[b] = chr(more)
            more += 1
    return letters


class ByteBpe:
    """Merges, ids and special strings of a byte-level BPE without normaliser."""

    def __init__(self, source: bytes) -> None:
        file = json.loads(source)
        model, before = file["model"], file["pre_tokenizer"] or {}
        plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        if model["type"] != "BPE" or file["normalizer"] or not plain or model.get("ignore_merges"):
            raise ValueError("only byte-level BPE without normaliser and prefix space is supported")
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.width = max([*vocab.values(), *self.special.values()]) + 1
        self.first = np.array([vocab[c] for c in byte_letters()], dtype=np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in merges], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        byte = {c: b for b, c in enumerate(byte_letters())}
        tokens = [np.array([byte[c] for c in a + b], dtype=np.int64) for a, b in merges]
        self.twos = np.unique(np.array([t[0] << 8 | t[1] for t in tokens if len(t) == 2], dtype=np.int64))
        longer = [t for t in tokens if len(t) > 2]
        threes = np.concatenate([t[:-2] << 16 | t[1:-1] << 8 | t[2:] for t in longer]) if longer else np.zeros(0, np.int64)
        self.threes = np.unique(threes)

    def pieces(self, raw: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Where a piece begins among the bytes of sequences: at the first byte of each, and where no token can reach across.

        A token across two neighbouring bytes is these two, or has them and one more on either side; where no token has any of
        the three, none is ever made across, whatever is merged on either side.
        """
        begins = np.ones(len(raw), dtype=bool)
        if len(raw) < 2:
            return begins
        wide = raw.astype(np.int64)
        two = wide[:-1] << 8 | wide[1:]
        three = np.append(two[:-1] << 8 | wide[2:], -1) if len(raw) > 2 else np.full(1, -1)
        crossed = _among(two, self.twos)
        in_three = _among(three, self.threes)
        crossed |= in_three  # the pair and the byte after it
        crossed[1:] |= in_three[:-1]  # the byte before it and the pair
        begins[1:] = ~crossed | (owner[1:] != owner[:-1])
        return begins

    def _rank(self, symbols: np.ndarray, piece: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The place among the merges of the pairs that begin at `at`, -1 for none."""
        after = np.minimum(at + 1, len(symbols) - 1)
        pair = symbols[at] * self.width + symbols[after]
        place = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where((self.keys[place] == pair) & (piece[at] == piece[after]) & (after > at), place, -1)

    def merge(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of pre-tokens. All pieces advance together: in each round every piece applies its lowest-ranked pair wherever it occurs.

        Long pre-tokens have many pieces, so they take few rounds, and a round looks up only the pairs that the one before has made.
        """
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        sizes = np.array([len(r) for r in raw], dtype=np.int64)
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        symbols = self.first[data]
        piece = np.cumsum(self.pieces(data, np.repeat(np.arange(len(raw)), sizes)))
        place = np.arange(len(symbols))  # the first byte of each symbol
        merge = self._rank(symbols, piece, place) if len(symbols) else place
        whole, none = np.full(len(symbols), -1, dtype=np.int64), np.int64(1 << 60)
        while len(symbols):
            rank = np.where(merge >= 0, self.ranks[merge], none)
            first = np.flatnonzero(np.diff(piece, prepend=-1))
            counts = np.diff(np.append(first, len(piece)))
            lowest = np.repeat(np.minimum.reduceat(rank, first), counts)
            done = lowest == none
            whole[place[done]] = symbols[done]
            hit = np.flatnonzero((rank == lowest) & ~done)
            # of overlapping occurrences every second one counts, from the left
            begins = np.flatnonzero(np.diff(hit, prepend=-2) != 1)
            turn = np.arange(len(hit)) - np.repeat(begins, np.diff(np.append(begins, len(hit))))
            hit = hit[turn % 2 == 0]
            symbols[hit] = self.made[merge[hit]]
            keep = ~done
            keep[hit + 1] = False
            new = (np.cumsum(keep) - 1)[hit]
            symbols, piece, place, merge = symbols[keep], piece[keep], place[keep], merge[keep]
            changed = np.concatenate((new, new[new > 0] - 1))
            if len(changed):
                merge[changed] = self._rank(symbols, piece, changed)
        ends = np.cumsum(sizes)
        left = np.flatnonzero(whole >= 0)
        return np.split(whole[left], np.searchsorted(left, ends[:-1])) if len(raw) else []


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each value is one of `known`, which are sorted."""
    if not len(known):
        return np.zeros(len(values), dtype=bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values
