"""SentencePiece encoding and decoding by streaming Viterbi.

A lattice of pieces is walked left to right. Only boundaries within the longest piece of the current one
can still be extended, so a window of that length is kept; whenever all backpointer paths that start in it
meet in one boundary, the ids up to there are committed and forgotten.

Unigram models take the path of the highest score. A BPE model has no such sum: its scores order merges.
A segmentation is the one that merging gives exactly when each two neighbouring pieces are what merging
makes of their joined text, so for BPE models a step is allowed only between such compatible pieces; exactly one
path survives to each boundary, and it is the BPE result. Taking BPE scores as path sums would give other ids.

Where no piece has a blank mark after another character, paths always meet before a word's blank mark. Such
stretches are encoded once and remembered in two generations of bounded size. The new ones of a batch are
walked together: all lattices advance by one character a step, each in a ring of WINDOW longest pieces that is emptied
wherever its paths have met. A very long one is walked by itself, with the same window. So no lattice is ever held
whole. Characters without a piece become byte pieces (or the unknown piece).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.hashmap import HashMap64
from millrace.llm.shared import fresh, small
from millrace.storage import ship

BLANK = "▁"
#: Stretches remembered in a generation, characters of the longest, and pairs of pieces whose compatibility is remembered.
REMEMBERED, LONGEST_REMEMBERED, PAIRS = 120_000, 48, 500_000
#: Boundaries that a lattice holds, in longest pieces, unless its paths have not met by then; characters of a stretch that is walked alone.
WINDOW, ALONE = 4, 1024
_NORMAL, _UNKNOWN, _USER, _BYTE = 1, 2, 4, 6
_UNIGRAM, _BPE = 1, 2
#: What an unknown character costs below the lowest score of a unigram model.
_UNKNOWN_COST = 10.0


class Codec:
    """A SentencePiece model of the unigram or BPE kind with identity normalisation."""

    def __init__(self, path: str | None = None, proto: bytes | None = None) -> None:
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        if proto is None:
            with open(path, "rb") as f:
                proto = f.read()
        model.ParseFromString(proto)
        kind, spec = model.trainer_spec.model_type, model.normalizer_spec
        if kind not in (_UNIGRAM, _BPE) or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only unigram and BPE models with identity normalisation are supported")
        if any(p.type == _USER for p in model.pieces):
            raise ValueError("models with user-defined symbols are not supported")
        self.bpe, self.prefix = kind == _BPE, spec.add_dummy_prefix
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == _NORMAL}
        self.scores = [np.float32(p.score) for p in model.pieces]  # sums in single precision decide ties as in the library
        self.bytes_of = [b"" if p.type not in (_NORMAL, _BYTE, _UNKNOWN) else bytes([int(p.piece[3:5], 16)]) if p.type == _BYTE else p.piece.replace(BLANK, " ").encode() for p in model.pieces]
        byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == _BYTE}
        self.unknown = next((i for i, p in enumerate(model.pieces) if p.type == _UNKNOWN), 0)
        self.bytes_of[self.unknown] = b" \xe2\x81\x87 "
        self.byte_ids = byte_ids if model.trainer_spec.byte_fallback and len(byte_ids) == 256 else None
        #: every ending of a piece, with the piece's id or -1: what may still grow to the left
        self.endings: dict[str, int] = {p[k:]: -1 for p in self.ids for k in range(len(p))} | self.ids
        self.longest = max((len(p) for p in self.ids), default=1)
        self.lowest = min((self.scores[i] for i in self.ids.values()), default=np.float32(0)) - np.float32(_UNKNOWN_COST)
        if self.bpe and any(c not in self.ids for p in self.ids for c in p):
            raise ValueError("a piece has a character that is no piece")
        parts = not any(BLANK in p.lstrip(BLANK) for p in self.ids)
        alone = "" if "\n" in self.ids or not parts else "\n"
        self.stretches = re.compile(f"{alone}|{BLANK}*[^{BLANK}{alone}]+|{BLANK}+" if alone else f"{BLANK}*[^{BLANK}]+|{BLANK}+") if parts else None
        self.pairs: dict[int, bool] = {}  # for one lattice
        self.pair_map = HashMap64()  # for many
        # the pieces as a trie: the state after each beginning of a piece, by state before and character, and the piece that ends there
        states = {b: k for k, b in enumerate({p[:k]: 0 for p in self.ids for k in range(len(p) + 1)} | {"": 0})}
        self.root, self.piece_at = states[""], np.full(len(states), -1, dtype=np.int64)
        self.trie = HashMap64(18)
        steps = [(states[b[:-1]] << 21 | ord(b[-1]), k) for b, k in states.items() if b]
        if steps:
            keys, to = zip(*steps)
            self.trie.insert(np.array(keys, dtype=np.uint64), np.array(to, dtype=np.int32))
        for piece, i in self.ids.items():
            self.piece_at[states[piece]] = i
        self.window = 0  # boundaries of the widest lattice so far
        self.pieces = [p.piece for p in model.pieces]
        self.young, self.old = _Generation(self), {}

    # encoding

    def _merge(self, text: str) -> list[str]:
        """What merging makes of a short text: the best-scored neighbours first, leftmost of equals."""
        symbols = list(text)
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                joined = self.ids.get(symbols[i] + symbols[i + 1])
                if joined is not None and (best is None or self.scores[joined] > best):
                    best, at = self.scores[joined], i
            if best is None:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def _compatible(self, left: int, right: int) -> bool:
        """Whether merging leaves the pieces side by side; left is -1 at the start of a text or after an unknown."""
        own = [self.pieces[k] for k in (left, right) if k >= 0]
        known = self._merge("".join(own)) == own
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        self.pairs[left << 32 | right] = known
        return known

    def viterbi(self, text: str) -> list[int]:
        """Ids of a stretch; holds a few times the longest piece of lattice, however long the text."""
        out: list[int] = []
        base = 0  # the boundary up to which ids are committed; lists below start there
        piece, back, score = [-1], [0], [np.float32(0)]
        longest, scores, bpe = self.longest, self.scores, self.bpe
        ending, pair = self.endings.get, self.pairs.get
        for end in range(1, len(text) + 1):
            best_score, best, best_size = None, -1, 1
            fits = []
            for start in range(end - 1, base - 1, -1):
                found = ending(text[start:end])
                if found is None:
                    break
                if found >= 0:
                    fits.append((start, found))
            if bpe:
                for start, found in reversed(fits):
                    left = piece[start - base]
                    fit = pair(left << 32 | found)
                    if fit or fit is None and self._compatible(left, found):
                        best, best_size = found, end - start
                        break
            else:
                for start, found in reversed(fits):  # of equal scores the longest last piece wins
                    total = score[start - base] + scores[found]
                    if best_score is None or total > best_score:
                        best_score, best, best_size = total, found, end - start
                if not fits or fits[0][0] != end - 1:
                    total = score[-1] + self.lowest
                    if best_score is None or total > best_score:
                        best_score, best, best_size = total, -1, 1
                score.append(best_score)
            piece.append(best)
            back.append(best_size)
            self.window = max(self.window, len(piece))
            if end - base >= (WINDOW - 1) * longest and end % longest == 0:
                meet = self._meeting(back, end - base)
                if meet:
                    out = self._path(text, base, piece, back, meet, out)
                    base += meet
                    del piece[:meet], back[:meet], score[:meet]
        return self._path(text, base, piece, back, len(text) - base, out)

    def viterbi_many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of many stretches under a BPE model, as `viterbi` gives them; all lattices advance together."""
        if not texts:
            return []
        sizes = np.array([len(t) for t in texts])
        order = np.argsort(-sizes, kind="stable")
        sizes = sizes[order]
        points = np.frombuffer("".join([texts[k] for k in order.tolist()]).encode("utf-32-le"), dtype=np.uint32)
        first = np.cumsum(sizes) - sizes
        ring = WINDOW * self.longest
        piece, back = np.full((len(sizes), ring), -1, dtype=np.int64), np.ones((len(sizes), ring), dtype=np.int64)
        base = np.zeros(len(sizes), dtype=np.int64)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # lattice, boundary and piece of what is committed
        lane, begin, state = (np.zeros(0, dtype=np.int64) for _ in range(3))  # beginnings of pieces that may still grow

        def commit(lanes: np.ndarray, upto: np.ndarray) -> None:
            at, going = upto.copy(), np.arange(len(lanes))
            while len(going := going[at[going] > base[lanes[going]]]):
                own, here = lanes[going], at[going]
                done.append((own, here, piece[own, here % ring]))
                at[going] = here - back[own, here % ring]
            base[lanes] = upto

        for end in range(1, int(sizes[0]) + 1):
            live = int(np.searchsorted(-sizes, -end, side="right"))  # lattices that go on to this boundary
            still = lane < live
            lane = np.concatenate((lane[still], np.arange(live)))
            begin = np.concatenate((begin[still], np.full(live, end - 1)))
            state = np.concatenate((state[still], np.full(live, self.root)))
            state = self.trie.find(state.astype(np.uint64) << np.uint64(21) | points[first[lane] + end - 1]).astype(np.int64)
            grown = state >= 0
            lane, begin, state = lane[grown], begin[grown], state[grown]
            right = self.piece_at[state]
            ends_here = np.flatnonzero(right >= 0)
            own, start, right = lane[ends_here], begin[ends_here], right[ends_here]
            fit = self._compatible_many(np.where(start > 0, piece[own, start % ring], -1), right)  # of one boundary's at most one fits
            piece[:live, end % ring], back[:live, end % ring] = -1, 1
            piece[own[fit], end % ring], back[own[fit], end % ring] = right[fit], end - start[fit]
            over = np.flatnonzero(sizes[:live] == end)
            if len(over):
                commit(over, np.full(len(over), end))
            if end % self.longest == 0:
                wide = np.flatnonzero((end - base[:live] >= (WINDOW - 1) * self.longest) & (sizes[:live] > end))
                if len(wide):
                    met = self._meetings(back, wide, base[wide], end, ring)
                    commit(wide[met > base[wide]], met[met > base[wide]])
                    if (end - base[wide]).max() > ring - self.longest - 1:  # paths that won't meet yet: the ring has to grow
                        at = np.arange(max(0, end - ring + 1), end + 1)
                        wider = [np.full((len(sizes), 2 * ring), v, dtype=np.int64) for v in (-1, 1)]
                        for new, old in zip(wider, (piece, back)):
                            new[:, at % (2 * ring)] = old[:, at % ring]
                        (piece, back), ring = wider, 2 * ring
            self.window = max(self.window, ring)
        whose, place, ids = (np.concatenate(x) for x in zip(*done))
        by = np.lexsort((place, whose))
        whose, place, ids = whose[by], place[by], ids[by].astype(np.int32)
        bounds = np.searchsorted(whose, np.arange(len(sizes) + 1))
        out: list[np.ndarray] = [ids[:0]] * len(texts)
        plain = np.add.reduceat(np.append(ids < 0, False).astype(np.int64), bounds[:-1]) == 0
        for k, own in enumerate(order.tolist()):
            s, e = bounds[k], bounds[k + 1]
            if plain[k]:
                out[own] = ids[s:e]
            else:
                letters = [chr(p) for p in points[first[k] + place[s:e] - 1].tolist()]
                out[own] = np.array(self._spelled(ids[s:e].tolist(), letters), dtype=np.int32)
        return out

    def _meetings(self, back: np.ndarray, lanes: np.ndarray, base: np.ndarray, end: int, ring: int) -> np.ndarray:
        """For each lattice the boundary in which all paths that can still go on from `end` meet."""
        span = end - int(base.min())
        low = end - span  # boundaries from here to `end`, those before a lattice's base left out
        open_ = np.zeros((len(lanes), span + 1), dtype=bool)
        open_[:, max(0, span - self.longest + 1) :] = True
        every = np.arange(len(lanes))
        for top in range(span, 0, -1):
            # the last open boundary steps back unless it is the only one
            hit = every[open_[:, top] & (open_.sum(axis=1) > 1)]
            if len(hit):
                open_[hit, top] = False
                open_[hit, np.maximum(top - back[lanes[hit], (low + top) % ring], 0)] = True
        return np.maximum(low + open_.argmax(axis=1), base)

    def _compatible_many(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = ((left + 1) << 32 | right).astype(np.uint64)
        known = self.pair_map.find(keys)
        new = np.flatnonzero(known < 0)
        if len(new):
            fresh, where = np.unique(keys[new], return_index=True)
            made = np.array([self._compatible(int(left[i]), int(right[i])) for i in new[where].tolist()], dtype=np.int32)
            if self.pair_map.count + len(fresh) > PAIRS:
                self.pair_map = HashMap64()
            self.pair_map.insert(fresh, made)
            known[new] = made[np.searchsorted(fresh, keys[new])]
        return known > 0

    def _spelled(self, ids: list[int], letters: list[str], before: list[int] | None = None) -> list[int]:
        """Ids with each unknown (-1), whose letter is given, as byte pieces or as the unknown piece, put after those before."""
        out = before if before is not None else []
        for i, letter in zip(ids, letters):
            if i >= 0:
                out.append(i)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in letter.encode("utf-8", "surrogatepass")]
            elif not (out and out[-1] == self.unknown):  # neighbouring unknowns are one
                out.append(self.unknown)
        return out

    def _meeting(self, back: list[int], last: int) -> int:
        """The boundary in which all paths from the window meet; 0 if that is not yet past the committed one."""
        open_ends = set(range(max(0, last - self.longest + 1), last + 1))
        while len(open_ends) > 1:
            top = max(open_ends)
            open_ends.remove(top)
            open_ends.add(top - back[top])
        return open_ends.pop()

    def _path(self, text: str, base: int, piece: list[int], back: list[int], at: int, out: list[int]) -> list[int]:
        ids, letters = [], []
        while at > 0:
            ids.append(piece[at])
            letters.append(text[base + at - 1])
            at -= back[at]
        return self._spelled(ids[::-1], letters[::-1], out)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text, int32."""
        if not text:
            return np.zeros(0, dtype=np.int32)
        marked = (BLANK if self.prefix else "") + text.replace(" ", BLANK)
        if self.stretches is None:
            return np.array(self.viterbi(marked), dtype=np.int32)
        return np.frombuffer(b"".join(map(self.young.__getitem__, self.stretches.findall(marked))), dtype=np.int32)

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of many whole texts; what is new among their stretches is walked together."""
        if self.stretches is None or not self.bpe:
            return [self.encode(t or "") for t in texts]
        put, cut, young = BLANK if self.prefix else "", self.stretches.findall, self.young
        split = [cut(put + t.replace(" ", BLANK)) if t else [] for t in texts]
        new = {p for parts in split for p in parts if p not in young and len(p) <= ALONE}
        again = {p: self.old[p] for p in new if p in self.old}
        fresh = [p for p in new if p not in again]
        again.update(zip(fresh, [x.tobytes() for x in self.viterbi_many(fresh)]))
        long = {p: again.pop(p) for p in fresh if len(p) > LONGEST_REMEMBERED}  # not worth remembering
        if len(young) + len(again) > REMEMBERED:
            self.old = dict(young)
            young.clear()
        young.update(again)
        find = (lambda p: long[p] if p in long else young[p]) if long else young.__getitem__
        return [np.frombuffer(b"".join(map(find, parts)), dtype=np.int32) for parts in split]

    # decoding

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces end to end, byte pieces as bytes, without the blank that encoding put first."""
        of = self.bytes_of
        raw = b"".join([of[i] for i in ids.tolist()])
        if self.prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", errors="replace")


class _Generation(dict):
    """Ids of stretches as int32 bytes; when full, it becomes the old generation and starts anew."""

    def __init__(self, codec: Codec) -> None:
        self.codec = codec

    def __missing__(self, stretch: str) -> bytes:
        codec = self.codec
        found = codec.old.get(stretch)  # pieced together before the generations changed
        if found is None:
            found = np.array(codec.viterbi(stretch), dtype=np.int32).tobytes()
        if len(stretch) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                codec.old = dict(self)
                self.clear()
            self[stretch] = found
        return found


_codecs: dict[tuple[str, int], Codec] = {}


def codec_of(proto: bytes) -> Codec:
    """The codec of a model, kept with what it remembers for the life of a worker."""
    key = (str(len(proto)), zlib.crc32(proto))
    if key not in _codecs:
        _codecs[key] = Codec(proto=proto)
    return _codecs[key]


def encode_pieces(docs: DataFrame, model_path: str, text_col: str = "text", with_text: bool = False) -> DataFrame:
    """`docs` with `piece_ids` (array<int>), and with `with_text` also `decoded`, decoded from those ids.

    A null or empty text has no ids. The model file is read on the driver and sent along. Where `docs` has such names,
    ours get a leading underscore. Rows repeat as they are; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(model_path, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())
    ids_name, text_name = fresh(docs, "piece_ids", "decoded")
    names, at = docs.columns, docs.columns.index(text_col)
    extra = [F.array().cast("array<int>").alias(ids_name), *([F.lit("").alias(text_name)] if with_text else [])]
    schema = docs.select(*names, *extra).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model.value)
        for batch in small(batches):
            for start in range(0, len(batch), 128):
                part = batch.slice(start, 128)
                found = codec.encode_all(part.column(at).to_pylist())
                ends = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*found, np.zeros(0, np.int32)])))
                more = [pa.array([codec.decode(x) for x in found], pa.string())] if with_text else []
                yield pa.RecordBatch.from_arrays([*part.columns, lists, *more], names=[*names, ids_name, *([text_name] if with_text else [])])

    return docs.mapInArrow(run, schema)


def decode_pieces(docs: DataFrame, model_path: str, ids_col: str = "piece_ids") -> DataFrame:
    """`docs` with `decoded` (a leading underscore if there is such a column), the text of the ids column; null ids give an empty text.

    Rows repeat as they are; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(model_path, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())
    (name,) = fresh(docs, "decoded")
    names, at = docs.columns, docs.columns.index(ids_col)
    schema = docs.select(*names, F.lit("").alias(name)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model.value)
        for batch in small(batches):
            texts = [codec.decode(np.array(x or [], dtype=np.int32)) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, name])

    return docs.mapInArrow(run, schema)


def encoding_digest(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_pieces, ids_crc32 (of the ids as little-endian 32-bit integers), and whether decoding gives the text back.

    A null text counts as empty and has no ids; a null id stays null. Repeated rows have a row each, texts of any length are taken whole,
    other columns play no part whatever their names, and an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(model_path, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model.value)
        for batch in small(batches):
            n, crc, same = [], [], []
            texts = batch.column(1).to_pylist()
            for text, ids in zip(texts, codec.encode_all(texts)):
                n.append(len(ids))
                crc.append(zlib.crc32(ids.astype("<i4").tobytes()))
                same.append(codec.decode(ids) == (text or ""))
            found = [pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *found], names=["id", "n", "crc", "same"])

    found = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")
    ).mapInArrow(run, "id long, n long, crc long, same boolean")
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_pieces"), F.col("crc").alias("ids_crc32"), F.col("same").alias("round_trip"))
