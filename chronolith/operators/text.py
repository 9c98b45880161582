"""Text operators that are expressions or need one row's text alone."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter, defaultdict, deque
from collections.abc import Callable, Iterable, Iterator
from difflib import SequenceMatcher
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import written

WORD = r"[A-Za-z][A-Za-z\-]{2,}"


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), 0)


def first_spellings(ws: Column) -> Column:
    """Words without those seen before in any case, as first spelled."""
    return F.aggregate(
        ws,
        F.struct(F.array().cast("array<string>").alias("seen"), F.array().cast("array<string>").alias("out")),
        lambda s, w: F.when(F.array_contains(s["seen"], F.lower(w)), s).otherwise(F.struct(F.array_append(s["seen"], F.lower(w)).alias("seen"), F.array_append(s["out"], w).alias("out"))),
        lambda s: s["out"],
    )


def salient_terms(text: Column, stop: Iterable[str], limit: int = 14) -> Column:
    """The first `limit` distinct words that are no stop words, as first spelled. A text's words are found once:
    what a lambda's body names is computed for each element, what it takes as an argument is not."""
    stop = [F.lit(w) for w in stop]
    kept = F.filter(words(text), lambda w: ~F.lower(w).isin(*stop))
    pairs = F.transform(F.array(kept), lambda k: F.struct(k.alias("as"), F.transform(k, F.lower).alias("low")))
    first = lambda p: F.transform(F.slice(F.array_distinct(p["low"]), 1, limit), lambda w: F.get(p["as"], (F.array_position(p["low"], w) - 1).cast("int")))
    return F.get(F.transform(pairs, first), 0)


def token_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+", -1), lambda x: x != ""))


# Abbreviations that do not end a sentence.
ABBREVIATED = ("e.g.", "i.e.", "U.S.C.", "U.S.", "No.", "Sec.", "sec.", "et seq.", "Inc.", "Dr.", "Mr.", "Ms.", "vs.", "cf.", "Pub.", "Stat.")


def sentence_bounds(text: str) -> list[tuple[int, int]]:
    """(start, end) of each sentence: they end at . ! or ? before blanks and a capital, bracket or end, save after abbreviations."""
    import re

    out, start = [], 0
    for m in re.finditer(r"[.!?](?=\s+[A-Z(\[]|\s*$)", text):
        if text[: m.end()].endswith(ABBREVIATED):
            continue
        if text[start : m.end()].strip():
            lead = len(text[start : m.end()]) - len(text[start : m.end()].lstrip())
            out.append((start + lead, m.end()))
        start = m.end()
    if text[start:].strip():
        lead = len(text[start:]) - len(text[start:].lstrip())
        out.append((start + lead, len(text.rstrip())))
    return out


def packed(text: str, most: int = 200, overlap: int = 1) -> list[tuple[int, int]]:
    """Spans of whole sentences of at most `most` tokens, each repeating the last `overlap` sentences of the one before.

    A sentence that is too long by itself is cut at semicolons.
    """
    parts: list[tuple[int, int]] = []
    for a, b in sentence_bounds(text):
        if len(text[a:b].split()) <= most:
            parts.append((a, b))
            continue
        at = a
        for piece in text[a:b].split(";"):
            if piece.strip():
                parts.append((at, min(at + len(piece) + 1, b)))
            at += len(piece) + 1
    spans, i = [], 0
    while i < len(parts):
        j, n = i, 0
        while j < len(parts) and (j == i or n + len(text[slice(*parts[j])].split()) <= most):
            n += len(text[slice(*parts[j])].split())
            j += 1
        spans.append((parts[i][0], parts[j - 1][1]))
        if j == len(parts):
            break
        i = max(i + 1, j - overlap)
    return spans


SPANS = "array<struct<start:int,end:int>>"


def _spans(of):
    def column(text: Column) -> Column:
        @F.pandas_udf(SPANS)
        def run(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: [{"start": a, "end": b} for a, b in of(t or "")])

        return run(text)

    return column


sentence_spans = _spans(sentence_bounds)
packed_spans = _spans(packed)


def designator_path(anchor: Column) -> Column:
    """a-1-i as [a, a-1, a-1-i]."""
    levels = F.split(anchor, "-", -1)
    return F.when(F.coalesce(anchor, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(levels)), lambda n: F.array_join(F.slice(levels, F.lit(1), n), "-")))


def chapeaux(paragraphs: DataFrame) -> DataFrame:
    """paragraphs (section, pos, anchor, text) with the flush text ending in a colon that governs each."""
    flush = F.coalesce(F.col("anchor"), F.lit("")) == ""
    governs = F.when(flush, F.when(F.col("text").rlike(r":\s*$"), F.col("text")).otherwise(F.lit("")))
    before = Window.partitionBy("section").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return paragraphs.withColumn("chapeau", F.nullif(F.last(governs, ignorenulls=True).over(before), F.lit("")))


def merged_anchors(units: DataFrame) -> DataFrame:
    """units (doc, pos, anchor) with repeated anchors told apart by .2, .3 and so on."""
    n = F.row_number().over(Window.partitionBy("doc", "anchor").orderBy("pos"))
    return units.withColumn("__n", n).withColumn("anchor", F.when(F.col("__n") > 1, F.concat("anchor", F.lit("."), F.col("__n").cast("string"))).otherwise(F.col("anchor"))).drop("__n")


def budgeted(rows: DataFrame, by: str, order: str, size: Column, budget: int) -> DataFrame:
    """Rows of each group up to the first that would overflow the budget."""
    upto = F.sum(size).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("__upto", upto).filter(F.col("__upto") <= budget).drop("__upto")


def loose(text: Column) -> Column:
    """Case, punctuation and white space folded."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


#: Up to so many words a side the standard matcher is as fast; so it is up to MANY where words hardly repeat.
FEW_WORDS, MANY = 24, 1000


class _Grams:
    """Equal numbers for equal runs of k words of two texts, for any k: ranks of runs of 1, 2, 4, ... words, and for
    other k the ranks of its first and last such run."""

    def __init__(self, a: list[str], b: list[str]):
        known: dict[str, int] = {}
        every = np.array([known.setdefault(w, len(known) + 2) for w in a] + [0] + [known.setdefault(w, len(known) + 2) for w in b] + [1], dtype=np.int64)
        self.n, self.at_b, self.ranks = len(every) + 1, len(a) + 1, [every]

    def of(self, k: int, lo: int, hi: int, in_b: bool) -> np.ndarray:
        """Numbers of the runs of k words inside of [lo, hi)."""
        p = k.bit_length() - 1
        while len(self.ranks) <= p:
            last, step = self.ranks[-1], 1 << (len(self.ranks) - 1)
            self.ranks.append(np.unique(last[:-step] * self.n + last[step:], return_inverse=True)[1].astype(np.int64) if len(last) > step else last[:0])
        lo, hi, r = lo + in_b * self.at_b, hi + in_b * self.at_b, self.ranks[p]
        return r[lo : hi - k + 1] * self.n + r[lo + k - (1 << p) : hi - (1 << p) + 1]


def matching_blocks(a: list[str], b: list[str]) -> list[tuple[int, int, int]]:
    """(place in a, place in b, length) of the blocks that difflib's SequenceMatcher (autojunk off) finds, adjacent ones apart.

    It looks for the longest block, first in a and then in b, and again left and right of it, with time that grows with
    the cube of a word's repetitions. Here a range's greatest length comes from a search by halves, all its blocks of that
    length from one pass, as what is right of a block has none longer and what is left of it only shorter ones.
    """
    if a == b[: len(a)] or b == a[: len(b)]:
        return [(0, 0, min(len(a), len(b)))] if a and b else []
    if max(len(a), len(b)) <= MANY:
        of_b = Counter(b)
        if sum(of_b[w] for w in a) <= 2 * (len(a) + len(b)):
            return [m for m in map(tuple, SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()) if m[2]]
    grams, out, open_ranges = None, [], [(0, len(a), 0, len(b), min(len(a), len(b)))]
    while open_ranges:
        alo, ahi, blo, bhi, most = open_ranges.pop()
        most = min(most, ahi - alo, bhi - blo)
        if most < 1:
            continue
        if max(ahi - alo, bhi - blo) <= FEW_WORDS:
            found = SequenceMatcher(None, a[alo:ahi], b[blo:bhi], autojunk=False).get_matching_blocks()
            out += [(alo + i, blo + j, n) for i, j, n in found if n]
            continue
        grams = grams or _Grams(a, b)
        shared = lambda k: np.isin(grams.of(k, alo, ahi, False), grams.of(k, blo, bhi, True))  # noqa: B023, E731
        if not (places := shared(1)).any():
            continue
        k, above = 1, 2
        while above <= most and (more := shared(above)).any():
            k, above, places = above, 2 * above, more
        above = min(above, most + 1)
        while above - k > 1:
            if (more := shared((k + above) // 2)).any():
                k, places = (k + above) // 2, more
            else:
                above = (k + above) // 2
        in_a, in_b, where = grams.of(k, alo, ahi, False), grams.of(k, blo, bhi, True), defaultdict(list)
        for j in np.flatnonzero(np.isin(in_b, in_a[places])).tolist():
            where[int(in_b[j])].append(blo + j)
        i0, j0 = alo, blo
        for i in np.flatnonzero(places).tolist():
            if alo + i < i0:
                continue
            js = where[int(in_a[i])]
            if (at := bisect_left(js, j0)) < len(js):
                out.append((alo + i, js[at], k))
                open_ranges.append((i0, alo + i, j0, js[at], k - 1))
                i0, j0 = alo + i + k, js[at] + k
        open_ranges.append((i0, ahi, j0, bhi, k - 1))
    return sorted(out)


def token_ops(before: str, after: str) -> list[tuple[str, str, str]]:
    """Word-level operations that turn one text into the other."""
    a, b = before.split(), after.split()
    out, i, j, same = [], 0, 0, [0, 0]

    def close() -> None:
        if same[1] > same[0]:
            out.append(("equal", " ".join(a[same[0] : same[1]]), " ".join(a[same[0] : same[1]])))

    for x, y, n in [*matching_blocks(a, b), (len(a), len(b), 0)]:
        if i < x or j < y:
            close()
            out.append(("replace" if i < x and j < y else "delete" if i < x else "insert", " ".join(a[i:x]), " ".join(b[j:y])))
            same = [x, x]
        i, j = x + n, y + n
        same[1] = i
    close()
    return out


def compared(before: Column, after: Column) -> Column:
    """similarity, tokens changed and word operations between two texts; null where either is."""

    @F.pandas_udf("struct<similarity:double,changed:int,ops:array<struct<op:string,before:string,after:string>>>")
    def run(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
        out = []
        for x, y in zip(xs, ys, strict=True):
            if x is None or y is None:
                out.append((None, None, None))
                continue
            ops = token_ops(x, y)
            out.append((*_measured(x, y), [{"op": o, "before": a, "after": b} for o, a, b in ops]))
        return pd.DataFrame(out, columns=["similarity", "changed", "ops"])

    return run(before, after)


def _measured(x: str, y: str) -> tuple[float, int]:
    """Similarity of two texts, and tokens that change."""
    a, b = x.split(), y.split()
    same, changed, i, j = 0, 0, 0, 0
    for p, q, n in [*matching_blocks(a, b), (len(a), len(b), 0)]:
        same, changed, i, j = same + n, changed + max(p - i, q - j), p + n, q + n
    return 2 * same / (len(a) + len(b)) if a or b else 1.0, changed


def measured(before: Column, after: Column) -> Column:
    """compared() without the operations, which hold both texts."""

    @F.pandas_udf("struct<similarity:double,changed:int>")
    def run(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if x is None or y is None else _measured(x, y) for x, y in zip(xs, ys, strict=True)], columns=["similarity", "changed"])

    return run(before, after)


def change_class(before: Column, after: Column, diff: Column) -> Column:
    """unchanged, editorial, substantive or wholesale, of two texts and their comparison."""
    return (
        F.when(before.eqNullSafe(after), "unchanged")
        .when((loose(before) == loose(after)) | (diff["changed"] < 3), "editorial")
        .when(diff["similarity"] < 0.5, "wholesale")
        .otherwise("substantive")
    )


#: Words whose hashes a worker keeps.
MOST_HASHES = 1 << 17
_ODD = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        self[word] = out = int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big")
        return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _keys(alike: float) -> Callable[[str], tuple[bytes, int, np.ndarray]]:
    """Of a text: a digest of its tokens, their number, and hashes of its q-grams, the n-th of a kind told from the others.

    Two texts of T tokens that are alike share M >= alike * T / 2 of them in at most T - 2 * M + 1 blocks, so
    at least M - (q - 1) * (T - 2 * M + 1) q-grams. Where that is not positive, texts above 0.8 are equal.
    """
    q, known = 2 if alike > 0.8 else 1, _Hashes()

    def run(text: str) -> tuple[bytes, int, np.ndarray]:
        tokens = text.split()
        h = np.fromiter((known[t] for t in tokens), np.uint64, len(tokens))
        if len(known) > MOST_HASHES:
            known.clear()
        gram = np.sort(_mixed(h[:-1] * _ODD + h[1:]) if q == 2 else h)
        at = np.arange(len(gram), dtype=np.uint64)
        first = np.ones(len(gram), bool)
        first[1:] = gram[1:] != gram[:-1]
        out = _mixed(gram + (at - np.maximum.accumulate(np.where(first, at, np.uint64(0)))) * _ODD)
        return blake2b(" ".join(tokens).encode("utf-8", "surrogatepass"), digest_size=16).digest(), len(tokens), out.view(np.int64)

    return run


def least_shared(n: int, alike: float) -> int:
    """The fewest q-grams that a text of n tokens shares with one that is alike and not equal."""
    q = 2 if alike > 0.8 else 1
    total = 2 * n / (2 - alike)  # with the shortest text that can be alike
    matched = alike * total / 2
    return max(1, math.ceil(matched - (q - 1) * (total - 2 * matched + 1) - 1e-6))


def is_alike(x: str, y: str, alike: float) -> bool:
    a, b = x.split(), y.split()
    m = SequenceMatcher(None, a, b, autojunk=False) if len(a) + len(b) <= 2 * FEW_WORDS else None
    if m:
        return m.real_quick_ratio() >= alike and m.quick_ratio() >= alike and m.ratio() >= alike
    total = len(a) + len(b)  # the same bounds, without an index of b
    if 2.0 * min(len(a), len(b)) / total < alike or 2.0 * (Counter(a) & Counter(b)).total() / total < alike:
        return False
    return 2.0 * sum(n for _, _, n in matching_blocks(a, b)) / total >= alike


def greedy_pairs(gone: list[tuple[str, bytes]], new: list[tuple[str, bytes]], links: dict[bytes, list[bytes]]) -> list[tuple[str, str]]:
    """Each gone section in order with the first free new one whose class is linked to its own."""
    free: dict[bytes, deque[str]] = defaultdict(deque)
    for section, c in sorted(new):
        free[c].append(section)
    out = []
    for section, c in sorted(gone):
        first = min((x for x in links.get(c, ()) if free[x]), key=lambda x: free[x][0], default=None)
        if first is not None:
            out.append((section, free[first].popleft()))
    return out


def _renumbered(gone: DataFrame, new: DataFrame, alike: float) -> DataFrame:
    """section and other of the renumberings between gone and new (section, t).

    Texts of equal tokens form one class. Pairs of classes are proposed by an exact prefix filter, from
    the rarest q-grams, and confirmed on whole texts; each component of confirmed pairs is matched greedily.
    """
    keys = _keys(alike)

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [keys(t) for t in b.column("t").to_pylist()]
            least = [max(len(f[2]) - least_shared(f[1], alike) + 1, 0) for f in found]
            columns = [pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.int64()), pa.array(least, pa.int64()), pa.array([f[2] for f in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column("section"), b.column("side"), b.column("t"), *columns], ["section", "side", "t", "c", "n", "prefix", "grams"])

    sides = gone.select("section", F.lit(0).alias("side"), "t").unionByName(new.select("section", F.lit(1).alias("side"), "t")).filter("section is not null and t is not null")
    rows = written(sides.mapInArrow(classed, "section string, side int, t string, c binary, n long, prefix long, grams array<long>"), "sections")
    classes = rows.groupBy("side", "c").agg(F.first("n").alias("n"), F.first("prefix").alias("p"), F.size(F.first("grams")).alias("of"), F.first("grams").alias("grams"))
    classes = written(classes.withColumn("k", F.monotonically_increasing_id()), "classes")
    grams = classes.select("side", "k", F.explode("grams").alias("g"))
    # a gram on one side only proposes nothing, but takes a place in the prefix: these stand before all others
    count = grams.groupBy("g").agg(F.count(F.lit(1)).alias("df"), F.min("side").alias("a"), F.max("side").alias("b")).filter("a <> b").select("g", "df")
    ranked = grams.select("k", "g").join(count, "g").groupBy("k").agg(F.sort_array(F.collect_list(F.struct("df", "g"))).alias("o"))
    prefix = classes.drop("grams").join(ranked, "k").select("side", "c", "n", F.explode(F.expr("slice(o, 1, int(greatest(p - (of - size(o)), 0)))")).alias("e"))
    prefix = written(prefix.select("side", "c", "n", "e.g"), "prefixes")
    left = prefix.filter("side = 0").select("g", F.col("c").alias("x"), F.col("n").alias("nx"))
    right = prefix.filter("side = 1").select("g", F.col("c").alias("y"), F.col("n").alias("ny"))
    size = 2 * F.least("nx", "ny") >= (alike - 1e-9) * (F.col("nx") + F.col("ny"))
    pairs = left.join(right, "g").filter(size & (F.col("x") != F.col("y"))).select("x", "y").distinct()
    texts = rows.groupBy("side", "c").agg(F.first("t").alias("t"))
    pairs = pairs.join(texts.filter("side = 0").select(F.col("c").alias("x"), F.col("t").alias("tx")), "x").join(texts.filter("side = 1").select(F.col("c").alias("y"), F.col("t").alias("ty")), "y")
    confirm = F.udf(lambda x, y: is_alike(x, y, alike), "boolean")
    equal = classes.groupBy("c").agg(F.countDistinct("side").alias("k")).filter("k = 2").select(F.col("c").alias("x"), F.col("c").alias("y"))
    links = written(pairs.filter(confirm("tx", "ty")).select("x", "y").unionByName(equal), "links")

    # the component of a class: the least class that it reaches
    top = links.select(F.col("x").alias("c")).union(links.select("y")).distinct().withColumn("top", F.col("c"))
    both = links.select(F.col("x").alias("c"), F.col("y").alias("d")).union(links.select("y", "x"))
    state = None
    while True:
        near = both.join(top.withColumnRenamed("c", "d"), "d").groupBy("c").agg(F.min("top").alias("m"))
        top = written(top.join(near, "c").select("c", F.least("top", "m").alias("top")), "tops")
        now = tuple(top.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("c", "top"))).first())
        if now == state:
            break
        state = now

    def match(frame: pd.DataFrame) -> pd.DataFrame:
        at = {k: list(zip(f["a"], f["b"], strict=True)) for k, f in frame.groupby("kind")}
        to = defaultdict(list)
        for x, y in at.get(2, []):
            to[bytes(x)].append(bytes(y))
        sections = [[(s.decode("utf-8", "surrogatepass"), bytes(c)) for s, c in at.get(k, [])] for k in (0, 1)]
        return pd.DataFrame(greedy_pairs(*sections, to), columns=["section", "other"])

    members = rows.join(top, "c").select("top", F.col("side").alias("kind"), F.encode("section", "UTF-8").alias("a"), F.col("c").alias("b"))
    members = written(members, "members")
    edges = links.join(top.withColumnRenamed("c", "x"), "x").select("top", F.lit(2).alias("kind"), F.col("x").alias("a"), F.col("y").alias("b"))
    # one section on either side of a component: linked, as a component hangs together
    sizes = members.groupBy("top").agg(F.count_if(F.col("kind") == 0).alias("n0"), F.count_if(F.col("kind") == 1).alias("n1"), *[F.max(F.when(F.col("kind") == k, F.col("a"))).alias(f"s{k}") for k in (0, 1)])
    sizes = written(sizes, "components")
    single = sizes.filter("n0 = 1 and n1 = 1").select(*[F.decode(f"s{k}", "UTF-8").alias(name) for k, name in ((0, "section"), (1, "other"))])
    rest = members.unionByName(edges).join(sizes.filter("n0 > 1 or n1 > 1").select("top"), "top", "left_semi")
    tasks = int(gone.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # their number stands: rows are few, work is not
    return written(rest.repartition(tasks, "top").groupBy("top").applyInPandas(match, "section string, other string").unionByName(single), "renumberings")


def snapshot_diff(before: DataFrame, after: DataFrame, alike: float = 0.9) -> DataFrame:
    """section, other and kind of change between two snapshots (section, text, raw).

    Sections on one side only are compared with each other: in order of section, each that is gone is
    renumbered to the first free new one whose text is at least so much alike.
    """
    a = before.select("section", F.col("text").alias("a"), F.col("raw").alias("ra"))
    b = after.select("section", F.col("text").alias("b"), F.col("raw").alias("rb"))
    both = a.join(b, "section").withColumn("d", measured(F.col("a"), F.col("b")))
    kind = F.when((F.col("a") == F.col("b")) & (F.col("ra") != F.col("rb")), "apparatus").otherwise(change_class(F.col("a"), F.col("b"), F.col("d")))
    kept = both.select("section", F.lit(None).cast("string").alias("other"), kind.alias("kind"))
    gone, new = a.join(b, "section", "left_anti"), b.join(a, "section", "left_anti")
    best = _renumbered(gone.select("section", F.col("a").alias("t")), new.select("section", F.col("b").alias("t")), alike)
    renumbered = best.select("section", "other", F.lit("renumbered").alias("kind"))
    removed = gone.join(best, "section", "left_anti").select("section", F.lit(None).cast("string").alias("other"), F.lit("removed").alias("kind"))
    added = new.join(best.select(F.col("other").alias("section")), "section", "left_anti").select("section", F.lit(None).cast("string").alias("other"), F.lit("added").alias("kind"))
    return kept.unionByName(renumbered).unionByName(removed).unionByName(added)
