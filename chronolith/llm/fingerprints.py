"""Document fingerprints: threshold-scaled sketches of character shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash range. Which hashes are kept
doesn't depend on the document, so sketches of parts merge by union, and the share of one sketch that
another has estimates containment even between a short and a very long text. A text none of whose
hashes lies below the threshold keeps its smallest one; a union drops such hashes where it has others
or a smaller one, so merging stays what the sketch of both texts' shingles would be.

Hashes have 64 bits; those kept lie below 2^64 / SCALE. A fingerprint is the kept hashes in ascending
order, 8 hexadecimal digits each (the 32 bits below the leading zero bits of the scale); a smallest hash
that stands in for them is written as "~" and the 8 digits of its first 32 bits.

Defined results: a null text counts as empty and has the empty fingerprint, which is like itself alone;
a text shorter than a shingle is one shingle; equal texts have equal fingerprints. Rows are ordered by
id, nulls first, equal ids by a hash of the text, then by text; the last row's next is the first row. A
table of one row has itself as next; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Code points in a shingle, and the fraction 1 / SCALE of hashes that is kept (a power of 2).
SHINGLE, SCALE = 6, 16
#: Characters of a range of documents, which one task works through.
RANGE_CHARS = 64 << 20
_BITS = SCALE.bit_length() - 1
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def shingle_hashes(points: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """One hash for each place of a shingle; a shorter text has one."""
    if not len(points):
        return np.empty(0, dtype=np.uint64)
    x = points.astype(np.uint64)
    size = min(size, len(x))
    h = np.full(len(x) - size + 1, size, dtype=np.uint64)
    for i in range(size):
        h = h * _PRIME + x[i : len(x) - size + 1 + i]
    return mixed(h)


_LIMIT = np.uint64(1 << (64 - _BITS))


def kept(hashes: np.ndarray) -> np.ndarray:
    """The hashes of a sketch, sorted: those below the threshold, or else the smallest."""
    below = np.unique(hashes[hashes < _LIMIT])
    return below if len(below) or not len(hashes) else hashes.min(keepdims=True)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two documents' shingles."""
    return kept(np.concatenate((a, b)))


def fingerprint(sketch: np.ndarray) -> str:
    if len(sketch) and sketch[0] >= _LIMIT:
        return f"~{int(sketch[0]) >> 32:08x}"
    return (sketch >> np.uint64(32 - _BITS)).astype(">u4").tobytes().hex()


def parsed(text: str) -> np.ndarray:
    """The sketch of a fingerprint, to the 32 bits that it holds."""
    if text.startswith("~"):
        return np.array([int(text[1:], 16) << 32], dtype=np.uint64)
    return np.frombuffer(bytes.fromhex(text), dtype=">u4").astype(np.uint64) << np.uint64(32 - _BITS)


def shared(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of both documents' shingles that both have."""
    both = shared(a, b)
    every = len(a) + len(b) - both
    return both / every if every else 1.0


def containment(part: np.ndarray, whole: np.ndarray) -> float:
    """Estimated share of the part's shingles that the whole has; an empty part is contained."""
    return shared(part, whole) / len(part) if len(part) else 1.0


def sketch_of(text: str) -> np.ndarray:
    return kept(shingle_hashes(code_points(text)))


def edited(text: str, following: str) -> str:
    """The text whose last half is replaced by as many code points from the start of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _above(cuts: list[int], key: Column) -> Column:
    """How many of the sorted cuts are not above the key, by halving steps."""
    at = F.array(*[F.lit(c) for c in cuts])
    steps = [1 << i for i in reversed(range(len(cuts).bit_length()))]
    beyond = lambda lo, s: (lo + s <= len(cuts)) & F.coalesce(F.get(at, lo + s - 1) <= key, F.lit(False))
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda lo, s: F.when(beyond(lo, s), lo + s).otherwise(lo)) if cuts else F.lit(0)


def with_next(docs: DataFrame, range_chars: int = RANGE_CHARS) -> DataFrame:
    """doc_id and text dealt by ranges of doc_id and sorted by __range, __copy, doc_id, text hash and text.

    At the end of every range stands a copy (__copy) of the first rows of the next one, at the end of
    the last range of the first one. The number of ranges follows from the table's characters; an id
    (or null) that fills several ranges is split among them by text hash. The driver gets the ranges'
    bounds and first rows. Texts move once.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("__h", F.xxhash64("text"))
    size = rows.agg(F.sum(F.length("text")).alias("n"), F.count(F.lit(1)).alias("rows"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    n = max(-(-(size["n"] or 0) // range_chars), int(spark.conf.get("spark.sql.shuffle.partitions")), 2)
    found = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], max(10_000, 10 * n))).first()[0] or []
    # a bound that comes k times over is the id of a group that takes up k ranges or so
    times: dict[int, int] = {}
    for x in found:
        times[x] = times.get(x, 0) + 1
    cuts = sorted({x + i for x, k in times.items() for i in ((0, 1) if k > 1 else (0,))})
    wide = {x: k for x, k in times.items() if k > 1}
    parts = -(-size["nulls"] * n // max(size["rows"], 1))
    names: dict[tuple[int, int], int] = {}  # (-1, part) for nulls, (place among the cuts, part) for ids, in order
    for place in range(-1, len(cuts) + 1):
        k = max(parts, 1) if place < 0 else wide.get(cuts[place - 1], 1) if place else 1
        for part in range(k):
            names[place, part] = len(names)
    firsts = [names[place, 0] for place in range(-1, len(cuts) + 1)] + [len(names)]
    offset = F.get(F.array(*[F.lit(x) for x in firsts]), F.col("__place") + 1)
    count = F.get(F.array(*[F.lit(b - a) for a, b in zip(firsts, firsts[1:], strict=False)]), F.col("__place") + 1)
    part = F.floor((F.shiftrightunsigned(F.col("__h").bitwiseXOR(F.lit(-(1 << 63))), 33)) * count / F.lit(1 << 31)).cast("int")
    rows = rows.withColumn("__place", F.when(F.col("doc_id").isNull(), -1).otherwise(_above(cuts, F.col("doc_id"))))
    rows = rows.withColumn("__range", offset + part).drop("__place")
    heads = rows.groupBy("__range").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "__h")).alias("first")).collect()
    order = sorted((h["__range"], h["first"]["doc_id"], h["first"]["__h"]) for h in heads)
    before = [(order[i - 1][0], key, h) for i, (_, key, h) in enumerate(order)]
    to = spark.createDataFrame(before or [(0, None, 0)], "__to int, __key long, __first long")
    # a row for each range; what has no range before it gets no copy
    rows = rows.join(F.broadcast(to), F.col("doc_id").eqNullSafe(F.col("__key")) & (F.col("__h") == F.col("__first")), "left")
    own, copy = F.struct(F.col("__range").alias("r"), F.lit(False).alias("c")), F.struct(F.col("__to").alias("r"), F.lit(True).alias("c"))
    rows = rows.withColumn("__at", F.explode(F.filter(F.array(own, copy), lambda x: x["r"].isNotNull())))
    rows = rows.select("doc_id", "text", "__h", F.col("__at.r").alias("__range"), F.col("__at.c").alias("__copy"))
    rows = rows.repartitionById(len(names), "__range")
    return rows.sortWithinPartitions("__range", "__copy", F.col("doc_id").asc_nulls_first(), "__h", "text")


def fingerprints(docs: DataFrame, range_chars: int = RANGE_CHARS) -> DataFrame:
    """Every document's fingerprint, its edited text's, their likenesses and containments: contained_*
    is the share of the document's own sketch that the edited text's, or the next document's, has."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "contained_edited", "contained_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # id, text and sketch of the row whose next is awaited
        for batch in batches:
            out: list[tuple] = []
            for key, text, copy in zip(*(batch.column(c) for c in ("doc_id", "text", "__copy")), strict=True):
                key, text, copy = key.as_py(), text.as_py(), copy.as_py()
                if last is None and copy:
                    continue  # only the first copy is the next row of a range
                sketch = sketch_of(text)
                if last is not None:
                    own_id, own_text, own = last
                    changed = edited(own_text, text)
                    other = sketch_of(changed)
                    sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((own_id, len(own_text), sha, fingerprint(own), fingerprint(other), likeness(own, other), likeness(own, sketch), containment(own, other), containment(own, sketch)))
                last = None if copy else (key, text, sketch)
            yield pa.RecordBatch.from_pydict({n: [r[i] for r in out] for i, n in enumerate(names)}, schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *[(n, pa.string()) for n in names[2:5]], *[(n, pa.float64()) for n in names[5:]]])
    kinds = "doc_id long, n_chars long, " + ", ".join([f"{n} string" for n in names[2:5]] + [f"{n} double" for n in names[5:]])
    return with_next(docs.select(F.col("doc_id").cast("long"), "text"), range_chars).mapInArrow(run, kinds)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
