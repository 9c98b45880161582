"""Near-duplicates: MinHash bands propose pairs, odd sketches sift them, full shingle sets confirm.

1. Each text becomes a set of word-shingle hashes; texts with equal sets form one class. Of a class
   the MinHash samples are taken: in groups of rows they give band keys, and all of them are folded
   into an odd sketch, a bitmap in which sample i flips the bit hash(i, sample). Two sketches differ in
   few bits if many samples agree, and the count of differing bits estimates a high similarity well.
2. Classes that share a band key are candidates. First only stars are tested: every class against two
   pivots of each bucket, so the work grows with the bucket, not with its square.
3. Buckets whose members then still belong to different components are completed: members of
   different components, in blocks, are compared by sketch, and what passes is confirmed on the full
   sets. Pairs inside a component are never looked at, as they can't change it.
4. Components of all confirmed links name the groups.

Nothing is capped. A link is missed only if two sets at the threshold share no band (the number of
bands keeps that under MISS) or if their sketch errs beyond MISS.

Defined results: a null text, or one without words, has no shingles and is linked with nothing; a
text of fewer words than a shingle is one shingle; rows are told apart by their text, so rows of equal
or null id are handled like others, and a component's id is the smallest id in it, null if it has
none; an empty table gives no rows; other columns pass unread.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import ARROW_BYTES, BATCH_BYTES, BROADCAST_KEYS, dropped, table, written
from .components import connected_components
from .fingerprints import mixed

#: MinHash samples of a class, bits of its odd sketch, and the chance of missing a link.
SAMPLES, BITS, MISS = 256, 1024, 1e-6
#: Classes in a block of a bucket, and shingles: what is held at once follows from both.
BLOCK, BLOCK_SHINGLES = 512, 2_000_000
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_LONGS = BITS // 64


@dataclass(frozen=True)
class Plan:
    """How sets are compared: words of a shingle, percent of similarity, bands and rows, and the most
    bits in which sketches of a link differ."""

    words: int
    percent: int
    bands: int
    rows: int
    most_bits: int


def plan(words: int, percent: int) -> Plan:
    """The most selective bands of at most 128 samples that miss fewer links than MISS."""
    t = percent / 100
    rows, bands = max(((r, math.ceil(math.log(MISS) / math.log1p(-(t**r)))) for r in range(1, 33) if t < 1 and r * math.log(MISS) / math.log1p(-(t**r)) <= 128), default=(1, 128))
    # differing samples: a binomial quantile; then the mean and deviation of odd bits from twice as many flips
    p, d, chance, below = 1 - t, 0, (t**SAMPLES if t < 1 else 1.0), 0.0
    while below + chance < 1 - MISS and d < SAMPLES:
        below, d = below + chance, d + 1
        chance *= (SAMPLES - d + 1) / d * p / t
    flips = 2 * d
    share = (1 - (1 - 2 / BITS) ** flips) / 2
    return Plan(words, percent, bands, rows, math.ceil(BITS * share + 5 * math.sqrt(BITS * share * (1 - share))))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles, A-Z lower-cased."""
    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII case and white space only
    if not ws:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, ws), np.uint64, len(ws))
    size = min(words, len(ws))
    s = np.full(len(ws) - size + 1, size, dtype=np.uint64)
    for i in range(size):
        s = mixed(s * _PRIME + h[i : len(ws) - size + 1 + i])
    return np.unique(s)


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(6)
    return rng.integers(1, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)


_A, _B = _coefficients()


def minhashes(s: np.ndarray) -> np.ndarray:
    """The least of each sample's hash over the set."""
    out = np.full(SAMPLES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(s), 256):
        x = s[i : i + 256, None] * _A
        x += _B
        np.minimum(out, x.min(axis=0), out=out)
    return out


def band_keys(samples: np.ndarray, p: Plan) -> np.ndarray:
    m = samples[: p.bands * p.rows].reshape(p.bands, p.rows)
    key = np.arange(1, p.bands + 1, dtype=np.uint64)
    for i in range(p.rows):
        key = mixed(key * _PRIME + m[:, i])
    return key.view(np.int64)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Bit b is set if an odd number of samples fall on it, as BITS / 64 longs."""
    at = mixed(samples + np.arange(SAMPLES, dtype=np.uint64) * _PRIME) % np.uint64(BITS)
    odd = (np.bincount(at.astype(np.int64), minlength=BITS) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def estimate(differing_bits: int) -> float:
    """The similarity of two sets whose sketches differ in so many bits."""
    return 1 + BITS / (4 * SAMPLES) * math.log(max(1 - 2 * differing_bits / BITS, 1e-9))


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of about BATCH_BYTES for what runs inside, unless the session sets their bytes itself."""
    if spark.conf.get(ARROW_BYTES, None) is not None:
        yield
        return
    spark.conf.set(ARROW_BYTES, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.unset(ARROW_BYTES)


def _longs(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else np.empty(0, np.int64), pa.int64()))


def signatures(docs: DataFrame, p: Plan) -> DataFrame:
    """doc_id, text hash, n_shingles, digest of the set, band keys and odd sketch of each row; the last three null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ids, bands, sketches = [], [], [], []
            for text in batch.column("text").to_pylist():
                s = shingle_set(text, p.words)
                n.append(len(s))
                samples = minhashes(s)
                ids.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                bands.append(band_keys(samples, p) if len(s) else np.empty(0, np.int64))
                sketches.append(odd_sketch(samples) if len(s) else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), _longs(bands), _longs(sketches)], names)

    names = ["doc_id", "text_hash", "n_shingles", "set_id", "bands", "sketch"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, set_id binary, bands array<long>, sketch array<long>")


def _differing(a: str, b: str) -> Column:
    return sum((F.bit_count(F.get(F.col(a), i).bitwiseXOR(F.get(F.col(b), i))) for i in range(_LONGS)), F.lit(0))


def _set_rows(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """node and its whole shingle set as bytes, for the rows named in wanted (doc_id, text_hash, node).

    Texts are recomputed rather than shuffled as long as what is wanted is small enough to broadcast.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = pa.array([shingle_set(t, words).tobytes() for t in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("node"), sets], ["node", "items"])

    if wanted.count() <= BROADCAST_KEYS:
        wanted = F.broadcast(wanted)
    rows = docs.select(F.col("doc_id").cast("long").alias("__id"), "text", F.xxhash64("text").alias("__hash"))
    same = (F.col("__hash") == F.col("text_hash")) & F.col("__id").eqNullSafe(F.col("doc_id"))
    return rows.join(wanted, same).select("node", "text").mapInArrow(run, "node long, items binary")


def _blocks(classes: Column, shingles: Column) -> Column:
    return F.greatest(F.ceil(classes / BLOCK), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")


def confirmed(docs: DataFrame, reps: DataFrame, proposals: DataFrame, p: Plan, trash: list[DataFrame]) -> DataFrame:
    """The links (a, b) among proposals, tested on full sets.

    proposals have gid, node, others and passing. Where others is null, the task of group gid holds
    node's set; else node is tested against others, which are held. The set of a passing node comes with
    its row and goes with it; any other node is held too. Callers bound what a group holds. What is
    written and must stay until the links are is added to trash.
    """
    proposals = written(proposals, "proposals")
    wanted = written(reps.select("node", "doc_id", "text_hash").join(proposals.filter("others is null or passing").select("node").distinct(), "node", "left_semi"), "wanted")
    trash += [proposals, wanted]
    sets = _set_rows(docs, wanted, p.words)
    shipped = proposals.filter("others is null or passing").select("gid", F.col("node").alias("__node"), "others").join(sets, F.col("node") == F.col("__node"))
    asked = proposals.filter("others is not null and not passing").select("gid", "node", F.lit(None).cast("binary").alias("items"), "others")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gid, held = None, {}
        for batch in batches:
            out: list[tuple[int, int]] = []
            for g, node, items, others in zip(batch.column("gid").to_pylist(), batch.column("node").to_pylist(), batch.column("items"), batch.column("others"), strict=True):
                if g != gid:
                    gid, held = g, {}
                own = np.frombuffer(items.as_buffer(), dtype=np.uint64) if items.is_valid else held[node]
                if not others.is_valid:
                    held[node] = own.copy()
                    continue
                for other in others.as_py():
                    x, y = own, held[other]
                    both = len(x) + len(y)
                    shared = both - len(np.unique(np.concatenate((x, y)))) if 100 * min(len(x), len(y)) >= p.percent * max(len(x), len(y)) else 0
                    if 100 * shared >= p.percent * (both - shared):
                        out.append((min(node, other), max(node, other)))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])

    rows = shipped.select("gid", "node", "items", "others").unionByName(asked).repartition("gid").sortWithinPartitions("gid", F.col("others").isNotNull())
    return rows.mapInArrow(run, "a long, b long")


def _stars(reps: DataFrame, members: DataFrame, p: Plan, trash: list[DataFrame]) -> DataFrame:
    """Proposals of every member with its bucket's two pivots, as far as the sketches allow them. A
    group holds one pivot; members pass by it."""
    ends = F.explode(F.array_distinct(F.array("pivot_a", "pivot_b"))).alias("p")
    pairs = members.select("node", ends).filter("node <> p").select(F.least("node", "p").alias("p"), F.greatest("node", "p").alias("x")).distinct()
    sketch = reps.select(F.col("node").alias("__n"), "sketch", "n_shingles")
    pairs = pairs.join(sketch.select("__n", F.col("sketch").alias("__s")), F.col("p") == F.col("__n")).drop("__n")
    pairs = pairs.join(sketch.withColumnRenamed("sketch", "__t"), F.col("x") == F.col("__n")).filter(_differing("__s", "__t") <= p.most_bits).select("p", "x", "n_shingles")
    pairs = written(pairs, "stars")
    trash.append(pairs)
    # a pivot's group is cut into parts, for several tasks to share
    parts = pairs.groupBy("p").agg(_blocks(F.count(F.lit(1)), F.sum("n_shingles")).alias("parts")).filter("parts > 1").select(F.bitwise_not("p").alias("__p"), "parts")
    pairs = pairs.join(parts, F.bitwise_not("p") == F.col("__p"), "left").withColumn("gid", F.xxhash64("p", F.pmod(F.xxhash64("x"), F.coalesce("parts", F.lit(1)))))
    nothing = F.lit(None).cast("array<long>")
    held = pairs.select("gid", F.col("p").alias("node"), nothing.alias("others"), F.lit(False).alias("passing")).distinct()
    return held.unionByName(pairs.select("gid", F.col("x").alias("node"), F.array("p").alias("others"), F.lit(True).alias("passing")))


def _completions(reps: DataFrame, members: DataFrame, found: DataFrame, p: Plan) -> DataFrame:
    """Proposals among members of a bucket that belong to different components."""
    of = found.select(F.col("node").alias("__n"), "component")
    rows = members.filter("n > 2").join(of, F.col("node") == F.col("__n"), "left").withColumn("component", F.coalesce("component", "node")).drop("__n")
    shares = rows.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
    most = F.max(F.struct("n", "component", "s"))
    shares = shares.groupBy("bucket").agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("all"), F.sum("s").alias("shingles"), most.alias("most")).filter("parts > 1")
    shares = shares.select(F.bitwise_not("bucket").alias("__b"), _blocks(F.col("all") - F.col("most.n"), F.col("shingles") - F.col("most.s")).alias("rest_blocks"), _blocks(F.col("most.n"), F.col("most.s")).alias("main_blocks"), F.col("most.component").alias("main"))
    rows = rows.join(shares, F.bitwise_not("bucket") == F.col("__b")).drop("__b", "n")
    is_main = F.col("component") == F.col("main")
    block = F.pmod(F.xxhash64("node", F.lit(1)), F.when(is_main, F.col("main_blocks")).otherwise(F.col("rest_blocks"))).cast("int")
    # groups are pairs of blocks: rest with main, and rest with rest

    def group(kind: int, i: Column, j: Column, side: Column) -> Column:
        return F.struct(F.xxhash64("bucket", F.lit(kind), i.cast("int"), j.cast("int")).alias("gid"), side.cast("int").alias("side"))

    k = F.col("__k")
    with_main = F.transform(F.sequence(F.lit(0), F.col("main_blocks") - 1), lambda j: group(0, k, j, F.lit(0)))
    with_rest = F.transform(F.sequence(F.lit(0), F.col("rest_blocks") - 1), lambda j: group(1, F.least(k, j), F.greatest(k, j), F.when(k == j, 2).when(k < j, 0).otherwise(1)))
    for_main = F.transform(F.sequence(F.lit(0), F.col("rest_blocks") - 1), lambda i: group(0, i, k, F.lit(1)))
    rows = rows.withColumn("__k", block).withColumn("__g", F.explode(F.when(is_main, for_main).otherwise(F.concat(with_main, with_rest))))
    rows = rows.select("bucket", "node", "component", "pivot_a", "pivot_b", "__g.gid", "__g.side")
    traits = reps.select(F.col("node").alias("__n"), "bands", "sketch")
    rows = rows.join(traits, F.col("node") == F.col("__n")).drop("__n").repartition("gid").sortWithinPartitions("gid")

    names = ("gid", "bucket", "node", "component", "pivot_a", "pivot_b", "side")

    def compare(group: dict[str, np.ndarray]) -> Iterator[tuple[int, int, list[int] | None]]:
        node, side, part, bands = group["node"], group["side"], group["component"], group["bands"]
        sketch = group["sketch"].view(np.uint64)  # of signed numbers bitwise_count takes the absolute value
        gid, band = int(group["gid"][0]), int(np.argmax(bands[0] == group["bucket"][0]))
        pivots = np.isin(node, (group["pivot_a"][0], group["pivot_b"][0]))  # tested as stars
        second, needed = np.flatnonzero(side > 0), set()
        for i in np.flatnonzero(side != 1):
            if pivots[i]:
                continue
            js = second[second > i] if side[i] == 2 else second
            js = js[(part[js] != part[i]) & ~pivots[js]]
            js = js[np.bitwise_count(sketch[js] ^ sketch[i]).sum(axis=1, dtype=np.int64) <= p.most_bits] if len(js) else js
            # the pair belongs to the first band that both share
            js = js[~(bands[js, :band] == bands[i, :band]).any(axis=1)] if len(js) else js
            if len(js):
                needed.update((i, *js.tolist()))
                yield gid, int(node[i]), node[js].tolist()
        for i in sorted(needed):
            yield gid, int(node[i]), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.list_(pa.int64())), pa.array([False] * len(out), pa.bool_())], ["gid", "node", "others", "passing"])

        held: list[dict[str, np.ndarray]] = []  # pieces of the group at hand

        def finish() -> list[tuple]:
            whole = {c: np.concatenate([h[c] for h in held]) for c in held[0]}
            held.clear()
            return list(compare(whole))

        for batch in batches:
            out: list[tuple] = []
            rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
            rows |= {c: batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for c in ("sketch", "bands")}
            edges = [0, *(np.flatnonzero(np.diff(rows["gid"])) + 1).tolist(), batch.num_rows] if batch.num_rows else []
            for lo, hi in zip(edges, edges[1:], strict=False):
                if held and held[0]["gid"][0] != rows["gid"][lo]:
                    out += finish()
                held.append({c: v[lo:hi] for c, v in rows.items()})
            yield packed(out)
        if held:
            yield packed(finish())

    return rows.mapInArrow(run, "gid long, node long, others array<long>, passing boolean")


def linked(docs: DataFrame, words: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """The rows' signatures (doc_id, text_hash, n_shingles, set_id), and set_id with its component's
    first row: component_id and, as stays, that row's text hash. Null ids come last."""
    with _small_batches(docs.sparkSession):  # all Arrow functions run before what is returned is read
        return _linked(docs, plan(words, percent))


def _linked(docs: DataFrame, p: Plan) -> tuple[DataFrame, DataFrame]:
    sigs = written(signatures(docs, p), "signatures")
    reps = sigs.filter("set_id is not null").groupBy("set_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("r"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("n_shingles"))
    reps = written(reps.select(F.monotonically_increasing_id().alias("node"), "set_id", "r", "r.doc_id", "r.text_hash", "bands", "sketch", "n_shingles"), "classes")
    keys = reps.select("node", F.col("n_shingles").cast("int").alias("n_shingles"), F.explode("bands").alias("bucket"))
    buckets = keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("pivot_a"), F.min_by("node", F.xxhash64("node", "bucket")).alias("pivot_b")).filter("n > 1")
    members = written(keys.join(buckets.withColumn("__b", F.bitwise_not("bucket")).drop("bucket"), F.bitwise_not("bucket") == F.col("__b")).drop("__b"), "members")
    trash = [reps, members]
    links = written(confirmed(docs, reps, _stars(reps, members, p, trash), p, trash), "links")
    found = written(connected_components(links), "components")
    trash += [links, found]
    more = confirmed(docs, reps, _completions(reps, members, found, p), p, trash)
    # components are joined on: later links connect them
    at = found.select(F.col("node").alias("__n"), "component")
    more = more.join(at, F.col("a") == F.col("__n"), "left").select(F.coalesce("component", "a").alias("a"), "b")
    more = more.join(at, F.col("b") == F.col("__n"), "left").select("a", F.coalesce("component", "b").alias("b"))
    joined = connected_components(more)
    first = reps.select("set_id", "node", "r").join(at, F.col("node") == F.col("__n"), "left").select("set_id", "r", F.coalesce("component", "node").alias("node"))
    last = joined.select(F.col("node").alias("__n"), "component")
    classes = first.join(last, F.col("node") == F.col("__n"), "left").select("set_id", "r", F.coalesce("component", "node").alias("component"))
    classes = written(classes, "class-components")
    for df in trash:
        dropped(df)
    ids = classes.groupBy("component").agg(F.min("r").alias("r"))
    ids = ids.select(F.bitwise_not("component").alias("__c"), F.col("r.doc_id").alias("component_id"), F.col("r.text_hash").alias("stays"))
    classes = classes.join(ids, F.bitwise_not("component") == F.col("__c")).select("set_id", "component_id", "stays")
    return sigs.select("doc_id", "text_hash", "n_shingles", "set_id"), classes


def _grouped(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id and stays, whether it is its group's first row, for each row of docs."""
    sigs, classes = linked(docs, words, percent)
    rows = sigs.join(classes.select(F.col("set_id").alias("__set"), "component_id", F.col("stays").alias("__hash")), F.col("set_id") == F.col("__set"), "left")
    alone = F.col("set_id").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))
    first = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_hash") == F.col("__hash"))
    return rows.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), F.when(alone, True).otherwise(first).alias("stays"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id and kept for each row of docs."""
    return _grouped(docs, words, percent).select("doc_id", "text_hash", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def without_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs, same columns, with one row of each group of near-duplicates: that of its smallest id, then text hash."""
    rows = written(_grouped(docs, words, percent), "near-duplicates")
    gone = rows.filter("not stays").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    again = rows.filter("stays and n_shingles > 0").groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if gone.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        gone = F.broadcast(gone)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash"))
    left = docs.join(gone, same, "left_anti")
    if again.isEmpty():
        return left
    # rows that share id and text: one of them stays
    twice = again.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    one = left.join(twice, same).drop("__id", "__hash").dropDuplicates(["doc_id", "text"])
    return left.join(twice, same, "left_anti").unionByName(one)


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), words=3, percent=85).drop("text_hash")
