"""SentencePiece encoding by sampling from the piece lattice, and lossless decoding.

The lattice of a text has an arc for every piece of the vocabulary that matches somewhere. Weights of
all paths up to each place are summed from the left (forward filtering); then a segmentation is drawn
from the right, arc by arc in proportion to the path weight it closes (backward sampling). The random
number of a place is a hash of the seed, the row's key and the place, so a row's segmentation is the
same in every run, batch and partition.

A unigram model's scores are log-probabilities. A BPE model's are merge ranks; a piece then weighs by
Zipf's law, 1 / (rank + 1). Either is raised to the power `alpha`: 0 draws all segmentations alike,
larger values prefer frequent pieces.

Words: no piece goes on past a blank that follows another character, so the lattice falls apart
there; equal words of a batch share one forward pass, and a text of any length is worked off in
windows. Words of more than LONG characters, which may fill many windows, keep the forward sums alone and
look their arcs up window by window, once on the way there and once on the way back. Characters without a piece become byte pieces. Blanks are written as U+2581, and a U+2581 of
the text itself always goes by bytes, so decoding gives back every text exactly.

Defined results: a null text stays null (its pieces are null, it counts as lossless); an empty text
has no pieces; rows of equal key and text get equal pieces; a null key is a key of its own; an empty
table gives no rows; other columns pass unread.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .fingerprints import mixed

#: The vocabulary that queries use, a parameter of every function.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = 0x2581
#: Stands for a U+2581 of the text; no piece has it.
LITERAL = 0x110000
#: Code points worked on at once.
WINDOW = 1 << 18
#: Words up to this length are filtered together, longer ones one by one.
SHORT = 48
#: Words beyond this length are sampled by themselves, in windows.
LONG = 4096
_R = np.uint64(0x9E3779B97F4A7C15)
_R_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_TABLE = 18


class Model:
    """A vocabulary ready for lookups by hash."""

    def __init__(self, path: str, alpha: float = 1.0):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = p.vocab_size()
        pieces = [p.id_to_piece(i) for i in range(self.size)]
        self.bytes = np.full(256, -1, dtype=np.int64)
        for i, x in enumerate(pieces):
            if p.is_byte(i):
                self.bytes[int(x[3:5], 16)] = i
        if (self.bytes < 0).any():
            raise ValueError("the vocabulary has no byte pieces: characters without a piece would be lost")
        plain = [i for i in range(self.size) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))]
        blank = chr(BLANK)
        if any(blank in pieces[i].lstrip(blank) for i in plain):
            raise ValueError("pieces that go on past a blank are not supported")
        scores = np.array([p.get_score(i) for i in range(self.size)])
        ranked = scores[plain].min() < -1e6 or np.all(scores[plain] == np.round(scores[plain]))
        least = -np.log(self.size + 1.0) if ranked else scores[plain].min() - 10
        log_w = np.where(scores > -1e6, -np.log1p(np.maximum(-scores, 0)), least) if ranked else scores
        #: By piece, then by number of UTF-8 bytes of a character that has no piece.
        self.log_w = alpha * np.concatenate([log_w, least * np.arange(5)])
        self.longest = max(len(pieces[i]) for i in plain)
        self.plain = np.array(plain)
        self.raw = [bytes([int(x[3:5], 16)]) if p.is_byte(i) else b"" if p.is_control(i) or p.is_unknown(i) else x.replace(blank, " ").encode() for i, x in enumerate(pieces)]
        by_length: dict[int, list[int]] = {}
        for i in plain:
            by_length.setdefault(len(pieces[i]), []).append(i)
        #: For each length, by a hash's first bits: 1 where a piece may be, and 2 where the start of a longer one may be.
        self.maybe = {n: np.zeros(1 << _TABLE, dtype=np.uint8) for n in range(1, self.longest + 1)}
        self.keys, self.ids = {}, {}
        for n, ids in by_length.items():
            points = np.array([[ord(c) for c in pieces[i]] for i in ids], dtype=np.uint64)
            hashes = mixed(np.cumsum(mixed(points + np.uint64(1)) * np.cumprod(np.full(n, _R), dtype=np.uint64), axis=1, dtype=np.uint64))
            keys = hashes[:, -1]
            order = np.argsort(keys)
            self.keys[n], self.ids[n] = keys[order], np.array(ids)[order]
            for k in range(1, n + 1):
                self.maybe[k][hashes[:, k - 1] >> np.uint64(64 - _TABLE)] |= 1 if k == n else 2


@lru_cache(maxsize=4)
def model(path: str = MODEL, alpha: float = 1.0) -> Model:
    return Model(path, alpha)


def lattice_points(text: str) -> np.ndarray:
    """Code points with the leading blank, and blanks and U+2581 in their lattice form."""
    x = np.frombuffer((" " + text).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    x[x == BLANK] = LITERAL
    x[x == 32] = BLANK
    return x


def word_starts(x: np.ndarray) -> np.ndarray:
    """Places where the lattice falls apart, 0 among them."""
    at = (x == BLANK).copy()
    at[1:] &= x[:-1] != BLANK
    at[0] = True
    return np.flatnonzero(at)


def row_seed(key: object, seed: int = 0) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(f"{seed}:{key}".encode(), digest_size=8).digest(), "little"))


def uniform(seeds: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (mixed(mixed(seeds + places.astype(np.uint64) * _R)) >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def _arc_table(m: Model, x: np.ndarray, source: np.ndarray, left: np.ndarray) -> np.ndarray:
    """[n - 1, i]: the piece of n code points that starts at x[source[i]], whose word has left[i] more, or -1."""
    values = mixed(x.astype(np.uint64) + np.uint64(1))
    power = np.cumprod(np.full(len(x), _R), dtype=np.uint64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * power, dtype=np.uint64)))
    back = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(len(x), _R_INV), dtype=np.uint64)))
    arcs = np.full((m.longest, len(source)), -1, dtype=np.int32)
    open_ = np.arange(len(source))  # places from where a piece may go on
    for n in range(1, m.longest + 1):
        open_ = open_[left[open_] >= n]
        s = source[open_]
        keys = mixed((sums[s + n] - sums[s]) * back[s])
        kind = m.maybe[n][keys >> np.uint64(64 - _TABLE)]
        hit = np.flatnonzero(kind & 1)
        at, keys = open_[hit], keys[hit]
        open_ = open_[kind >= 2]
        if len(at):
            found = np.minimum(np.searchsorted(m.keys[n], keys), len(m.keys[n]) - 1)
            same = m.keys[n][found] == keys
            arcs[n - 1, at[same]] = m.ids[n][found[same]]
    # characters without a piece: by their number of bytes
    bare = np.flatnonzero((left >= 1) & (arcs[0] < 0))
    points = np.where(x[source[bare]] == LITERAL, BLANK, x[source[bare]])
    arcs[0, bare] = m.size + 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
    return arcs


class _Forward:
    """Forward sums of one word, place by place: what is pushed on is kept for the next `longest` places."""

    def __init__(self, m: Model):
        self.m, self.ahead, self.off = m, [1.0] + [0.0] * m.longest, 0.0

    def add(self, arcs: np.ndarray) -> list[float]:
        """The logarithms of the sums at the places where these arcs start."""
        at, n = np.nonzero(arcs.T >= 0)
        weights = np.exp(self.m.log_w)[arcs[n, at]].tolist()
        n, ends = (n + 1).tolist(), np.searchsorted(at, np.arange(arcs.shape[1]), side="right").tolist()
        out, ahead, first = [], self.ahead, 0
        for last in ends:
            here = ahead.pop(0)
            if not 1e-100 < here < 1e100:
                self.off += math.log(here)
                ahead = [x / here for x in ahead]
                here = 1.0
            out.append(math.log(here) + self.off)
            ahead.append(0.0)
            for k in range(first, last):
                ahead[n[k] - 1] += here * weights[k]
            first = last
        self.ahead = ahead
        return out

    def end(self) -> float:
        return math.log(self.ahead[0]) + self.off


def _sample_long(m: Model, x: np.ndarray, seed: np.uint64, first: int) -> np.ndarray:
    """_sample for one word, whose first code point is the text's code point `first`."""
    length = len(x)
    sums, forward = np.empty(length + 1), _Forward(m)

    def arcs_of(lo: int, hi: int) -> np.ndarray:
        return _arc_table(m, x[lo : hi + m.longest], np.arange(hi - lo), length - np.arange(lo, hi))

    for lo in range(0, length, WINDOW):
        hi = min(lo + WINDOW, length)
        sums[lo:hi] = forward.add(arcs_of(lo, hi))
    sums[length] = forward.end()
    out, at = np.full(length, -1, dtype=np.int32), length
    while at > 0:
        # arcs that end in (lo, hi], of which none starts before lo - longest
        hi, lo = at, max(at - WINDOW, 0)
        begin = max(lo - m.longest, 0)
        arcs = arcs_of(begin, hi)
        u = uniform(np.full(hi - begin, seed), np.arange(first + begin, first + hi)).tolist()
        log_p = np.where(arcs >= 0, m.log_w[arcs] + sums[begin:hi], -np.inf).T.tolist()
        whole, arcs = sums[begin : hi + 1].tolist(), arcs.T.tolist()
        while at > lo:
            j, spent, picked, chosen = at - begin, 0.0, -1, 0
            for n in range(1, min(m.longest, at) + 1):
                piece = arcs[j - n][n - 1]
                if piece >= 0:
                    spent += math.exp(log_p[j - n][n - 1] - whole[j])
                    picked, chosen = piece, n  # the last arc stands where rounding leaves a rest
                    if u[j - 1] < spent:
                        break
            at -= chosen
            out[at] = picked
    return out


class _Words:
    """The distinct words of a window, their arcs and forward sums."""

    def __init__(self, m: Model, x: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        values = mixed(x.astype(np.uint64) + np.uint64(1))
        power = np.cumprod(np.full(len(x), _R), dtype=np.uint64)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * power, dtype=np.uint64)))
        back = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(len(x), _R_INV), dtype=np.uint64)))
        keys = mixed((sums[ends] - sums[starts]) * back[starts]) + (ends - starts).astype(np.uint64)
        _, first, self.of = np.unique(keys, return_index=True, return_inverse=True)
        self.length = (ends - starts)[first]
        # words in order of length lie one after another, each with one more place for its end
        order = np.argsort(self.length, kind="stable")
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        self.of = rank[self.of]
        self.length, first = self.length[order], first[order]
        self.base = np.concatenate(([0], np.cumsum(self.length + 1)))[:-1]
        total = int((self.length + 1).sum())
        inside = np.arange(total) - np.repeat(self.base, self.length + 1)
        source = np.repeat(starts[first], self.length + 1) + inside
        left = np.repeat(self.length, self.length + 1) - inside  # code points from here to the word's end
        #: arcs[n - 1][p]: the piece of n code points that starts at p, or -1
        self.arcs = _arc_table(m, x, np.minimum(source, len(x) - 1), left)
        self.sums = np.full(total, -np.inf)
        self._filter(m)

    def _filter(self, m: Model) -> None:
        """self.sums: the logarithm of the weight of all paths from a word's start to each place."""
        weights, scale = np.exp(m.log_w), 16.0  # a factor for each code point, the same on every path
        short = int(np.searchsorted(self.length, SHORT, side="right"))
        total = int(self.base[short - 1] + self.length[short - 1] + 1) if short else 0
        paths = np.zeros(total)
        paths[self.base[:short]] = 1.0
        for j in range(1, int(self.length[short - 1]) + 1 if short else 0):
            rows = self.base[np.searchsorted(self.length, j) : short] + j  # words of j code points or more
            here = np.zeros(len(rows))
            for n in range(1, min(m.longest, j) + 1):
                arc = self.arcs[n - 1, rows - n]
                on = np.flatnonzero(arc >= 0)
                if len(on):
                    here[on] += paths[rows[on] - n] * (weights[arc[on]] * scale**n)
            paths[rows] = here
        inside = np.arange(total) - np.repeat(self.base[:short], self.length[:short] + 1)
        self.sums[:total] = np.log(paths) - np.log(scale) * inside
        for base, length in zip(self.base[self.length > SHORT], self.length[self.length > SHORT], strict=True):
            forward = _Forward(m)
            self.sums[base : base + length] = forward.add(self.arcs[:, base : base + length])
            self.sums[base + length] = forward.end()


def _sample(m: Model, x: np.ndarray, seeds: np.ndarray, places: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each code point of x the piece that starts there, or -1; a piece of m.size or above stands
    for a character's bytes. seeds and places go with code points, starts are those of words."""
    out = np.full(len(x), -1, dtype=np.int32)
    ends = np.append(starts[1:], len(x))
    words = _Words(m, x, starts, ends)
    base, begin, at = words.base[words.of], starts, ends - starts
    while len(at):
        end = begin + at - 1
        u = uniform(seeds[end], places[end])
        spent, chosen, piece = np.zeros(len(at)), np.zeros(len(at), dtype=np.int64), np.full(len(at), -1, dtype=np.int32)
        todo = np.arange(len(at))
        for n in range(1, m.longest + 1):
            todo = todo[at[todo] >= n]
            if not len(todo):
                break
            place = base[todo] + at[todo]
            arc = words.arcs[n - 1, place - n]
            on = np.flatnonzero(arc >= 0)
            if not len(on):
                continue
            who, place, arc = todo[on], place[on], arc[on]
            spent[who] += np.exp(words.sums[place - n] + m.log_w[arc] - words.sums[place])
            chosen[who], piece[who] = n, arc  # the last arc stands where rounding leaves a rest
            settled = u[who] < spent[who]
            if settled.any():
                keep = np.ones(len(todo), dtype=bool)
                keep[on[settled]] = False
                todo = todo[keep]
        at = at - chosen
        out[begin + at] = piece
        more = at > 0
        base, begin, at = base[more], begin[more], at[more]
    return out


def encode(texts: list[str | None], keys: list, m: Model, seed: int = 0) -> list[np.ndarray | None]:
    """Sampled piece ids of each text."""
    parts: list[list[np.ndarray]] = [[] for _ in texts]
    held: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def flush() -> None:
        if not held:
            return
        x = np.concatenate([h[1] for h in held])
        offsets = np.cumsum([0, *[len(h[1]) for h in held]])
        got = _sample(m, x, np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held]), np.concatenate([h[4] + o for h, o in zip(held, offsets, strict=False)]))
        for (i, points, *_), o in zip(held, offsets, strict=False):
            own = got[o : o + len(points)]
            at = np.flatnonzero(own >= 0)
            ids = own[at]
            if (ids >= m.size).any():
                ids = _with_bytes(ids, points[at], m)
            parts[i].append(ids)
        held.clear()

    size = 0
    for i, (text, key) in enumerate(zip(texts, keys, strict=True)):
        if not text:
            continue
        x, s = lattice_points(text), row_seed(key, seed)
        starts = word_starts(x)
        long = np.flatnonzero(np.diff(starts, append=len(x)) > LONG)
        bounds = {int(starts[k]): int(starts[k + 1]) if k + 1 < len(starts) else len(x) for k in long}
        begins = sorted(bounds)
        lo = 0
        while lo < len(x):
            if lo in bounds:
                hi = bounds[lo]
                own = _sample_long(m, x[lo:hi], s, lo)
                at = np.flatnonzero(own >= 0)
                flush()
                size = 0
                parts[i].append(_with_bytes(own[at], x[lo:hi][at], m))
                lo = hi
                continue
            k = bisect_left(begins, lo)
            hi = begins[k] if k < len(begins) else len(x)
            if hi - lo > WINDOW:  # at the last word start inside the window, or the first beyond
                k = np.searchsorted(starts, lo + WINDOW, side="right") - 1
                hi = int(starts[k]) if starts[k] > lo else min(hi, int(starts[k + 1])) if k + 1 < len(starts) else hi
            own = starts[(starts >= lo) & (starts < hi)] - lo
            held.append((i, x[lo:hi], np.full(hi - lo, s), np.arange(lo, hi), own))
            size, lo = size + hi - lo, hi
            if size >= WINDOW:
                flush()
                size = 0
    flush()
    return [None if t is None else np.concatenate(p).astype(np.int32) if p else np.empty(0, np.int32) for t, p in zip(texts, parts, strict=True)]


def _with_bytes(ids: np.ndarray, points: np.ndarray, m: Model) -> np.ndarray:
    """ids, where those that stand for a character's bytes become byte pieces."""
    lone = ids >= m.size
    chars = points[lone]
    raw = np.where(chars == LITERAL, BLANK, chars).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    length = np.where(lone, ids - m.size, 1)
    out = np.repeat(ids, length)
    out[np.repeat(lone, length)] = m.bytes[np.frombuffer(raw, dtype=np.uint8)]
    return out


def decode(ids: list[int] | np.ndarray | None, m: Model) -> str | None:
    """The text of any segmentation of it."""
    if ids is None:
        return None
    raw = m.raw
    return b"".join([raw[i] for i in (ids.tolist() if isinstance(ids, np.ndarray) else ids)])[1:].decode("utf-8", "surrogatepass")


ENCODED = "n_pieces long, pieces array<int>, pieces_sha256 string, lossless boolean"


def encoded(docs: DataFrame, path: str = MODEL, alpha: float = 1.0, seed: int = 0) -> DataFrame:
    """doc_id, the sampled pieces, their number and digest, and whether they decode to the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path, alpha)
        for whole in batches:
            for batch in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
                texts = batch.column("text").to_pylist()
                ids = encode(texts, batch.column("doc_id").to_pylist(), m, seed)
                same = [decode(x, m) == t for x, t in zip(ids, texts, strict=True)]
                flat = np.concatenate([x for x in ids if x is not None] or [np.empty(0, np.int32)])
                offsets = pa.array([*[None if x is None else o for x, o in zip(ids, np.cumsum([0, *[0 if x is None else len(x) for x in ids]]).tolist(), strict=False)], len(flat)], pa.int32())
                columns = [
                    batch.column("doc_id"), pa.array([None if x is None else len(x) for x in ids], pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32())),
                    pa.array([None if x is None else hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in ids]), pa.array(same),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_pieces", "pieces", "pieces_sha256", "lossless"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {ENCODED}")


def decoded(rows: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id and text of rows of doc_id and pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([decode(x, m) for x in batch.column("pieces").to_pylist()], pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", F.col("pieces")).mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def op5_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))
