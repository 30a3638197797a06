"""N-gram Jaccard join by vertical partitioning.

A document is the set of hashes of its k-word shingles; documents of equal sets form a class and go on as one.
All n-grams have one global order: rare ones first, by hash, then those that many documents have, by frequency.
Pivots cut this order into fragments: equal ranges of the rare part, and ranges of the frequent part. A class has a
segment in each fragment. A pair that links has its first common n-gram in the prefixes of both, so candidates are
born in the fragments of the prefixes; each fragment counts by itself what a candidate's two segments have in common,
and the sum of the partial counts over the fragments decides.

What is in one class only can be in no overlap. Rows (n-gram, class, size, place in the order) of the prefixes are
therefore shuffled once, and a fragment drops those of a single class before anything else is made of them. Frequent
n-grams are dealt by class as well there, so that one that a third of all documents have is spread.

Components need no pair within what is already one component. So each n-gram's classes are first paired with the one
that has it nearest to its begin, then with one drawn by hash; only classes of an n-gram that are in different
components after that are paired with each other, those that size and places let link. No pair that could join
components is left out.

Null texts, empty texts and texts without words have an empty set and link with nothing. Repeated rows have equal
sets and the same component. Very long texts are taken whole; their sets are cut into fragments as others are.
Classes and rows have keys of their own, so rows without an id and rows of one id and different texts link like any
others; a component has the smallest id that isn't null, or null if it has none. Ties in the order are broken by hash.
Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taskloom.llm import kernel
from taskloom.llm.common import chunks, cut, discard, prepare, store, texts

#: N-grams that so many documents have are frequent. Like the next three this only sets the order and so the work.
COMMON = 16
#: N-grams with a hash in the lowest 1 / 2**COUNTED of the range, where most prefixes lie, are counted for all documents.
COUNTED = 2
#: So near, in n-grams of the text, to one that was found frequent, others are counted too.
NEAR = 24
#: Of the frequent n-grams, so many (the most frequent) are moved to the end of the order at most: 12 MB.
MOST_COMMON = 1 << 20
#: Fragments of the rare and of the frequent part of the order; powers of 2.
RARE_FRAGMENTS, FREQUENT_FRAGMENTS = 8, 4
#: Tasks that the rows of a frequent n-gram are dealt to.
SPREAD = 64
#: Keys up to this number are broadcast (16 bytes each at most, 24 with a class); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def prefix_size(n: int, num: int, den: int) -> int:
    """So many n-grams of n, that a set which shares none of them is below the similarity num / den."""
    return n - -(-num * n // den) + 1


def _sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each text its row, its distinct n-gram hashes in order, and all of them as in the text."""
    data, offsets = texts(column)
    for lo, hi in chunks(offsets):
        part = kernel.LOWER[data[offsets[lo] : offsets[hi]]]
        words = kernel.Words(part, offsets[lo : hi + 1] - offsets[lo], ~kernel.SPACE)
        grams, at = kernel.shingles(words, words.hashes(part), k)
        for i in range(lo, hi):
            own = grams[at[i - lo] : at[i - lo + 1]]
            yield i, _distinct(own), own


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    new = x[1:] != x[:-1]
    return x if new.all() else x[np.append(True, new)]


#: Values that a batch to the JVM has at most, unless one text has more.
_OUT = 1 << 18


def _flat(k: int, make: Callable, names: list[str]) -> Callable:
    """A mapInArrow function of (text) rows; make(set, n-grams as in the text) gives columns of rows, arrays or numbers."""

    def batch_of(made: list[tuple]) -> pa.RecordBatch:
        sizes = [len(m[0]) for m in made]
        columns = [np.concatenate(c) if isinstance(c[0], np.ndarray) else np.repeat(np.array(c), sizes) for c in zip(*made, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, size = [], 0
        for batch in batches:
            for _, values, own in _sets(batch.column(0), k):
                got = make(values, own)
                if got is not None and len(got[0]):
                    made.append(got)
                    size += len(got[0])
                    if size > _OUT:
                        yield batch_of(made)
                        made, size = [], 0
        if made:
            yield batch_of(made)

    return run


class Table:
    """A set of n-grams. Most others are told apart by their first BITS bits alone."""

    BITS = 22

    def __init__(self, values: np.ndarray) -> None:
        self.values = values  # sorted
        self.bits: np.ndarray | None = None

    def __getstate__(self) -> np.ndarray:
        return self.values

    def __setstate__(self, values: np.ndarray) -> None:
        self.__init__(values)

    def places(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of x are in the set, and where there."""
        if not len(self.values):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        shift = np.uint64(64 - self.BITS)
        if self.bits is None:
            self.bits = np.zeros(1 << self.BITS, bool)
            self.bits[self.values >> shift] = True
        maybe = np.flatnonzero(self.bits[x >> shift])
        at = np.minimum(np.searchsorted(self.values, x[maybe]), len(self.values) - 1)
        hit = self.values[at] == x[maybe]
        return maybe[hit], at[hit]


def _most_common(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of stored counts (t, m) in order of t, and the place of each in the order of (m, t).

    All, or those over the count at which MOST_COMMON are left: a histogram of the counts gives that count, so only
    the n-grams that are used come to the driver.
    """
    room, least = MOST_COMMON, None
    for r in counts.groupBy("m").agg(F.count("*").alias("n")).orderBy(F.desc("m")).toLocalIterator():
        room -= r.n
        if room < 0:
            break
        least = r.m
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    found = counts.where(F.col("m") >= least).toPandas()
    t, m = found["t"].to_numpy(np.int64).view(np.uint64), found["m"].to_numpy()
    by = np.argsort(t)
    t, m = t[by], m[by]
    rank = np.empty(len(t), np.int32)
    rank[np.lexsort((t, m))] = np.arange(len(t), dtype=np.int32)
    return t, rank


class Order:
    """The global order of the n-grams: rare ones by hash, then the frequent ones by frequency."""

    def __init__(self, frequent: np.ndarray, rank: np.ndarray) -> None:
        self.frequent, self.rank = Table(frequent), rank

    def sort(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A set (sorted by hash) in the global order, and each one's place among the frequent ones, or -1."""
        late, at = self.frequent.places(s)
        ranks = np.full(len(s), -1, np.int32)
        if not len(late):
            return s, ranks
        by = np.argsort(self.rank[at])
        ranks[len(s) - len(late) :] = self.rank[at[by]]
        return np.concatenate([np.delete(s, late), s[late[by]]]), ranks

    def fragments(self, s: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The fragment of each n-gram of an ordered set."""
        rare = s >> np.uint64(64 - (RARE_FRAGMENTS.bit_length() - 1))
        late = RARE_FRAGMENTS + rank.astype(np.int64) * FREQUENT_FRAGMENTS // max(1, len(self.rank))
        return np.where(rank < 0, rare.astype(np.int64), late)


def connected(edges: DataFrame) -> DataFrame:
    """(u, v) of undirected edges: (node, comp) of each node that isn't the smallest of its component, stored.

    Alternating large and small stars; each round is written to the checkpoint folder and the one before deleted.
    """
    e = store(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(lower)
        last, e = e, store(small.distinct())
        discard(last)
        now = tuple(e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first())
        if now == seen:
            out = e.withColumnsRenamed({"u": "node", "v": "comp"})
            out._stored_at = e._stored_at
            return out
        seen = now


def _possible(n: str, i: str, m: str, j: str, num: int, den: int) -> Column:
    """Whether sets of n and m n-grams can link whose first common n-gram is at their places i and j in the order.

    What comes before isn't common. At a later common n-gram the bound is lower, so a pair that can link
    passes at its first one, and one that can't passes at none.
    """
    most = F.least(F.col(n) - F.col(i), F.col(m) - F.col(j))
    return most * den >= (F.col(n) + F.col(m) - most) * num


def only(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key is in ids (distinct): by broadcast if there are few enough, else by a shuffle."""
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, key, "left_semi")


def row_key(id_col: str, text_col: str) -> Column:
    """A hash of a row's id and text, for rows without an id too."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))


def _digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _class_key(s: np.ndarray, renamed: dict[bytes, int]) -> int:
    """The key of a set's class: half of its digest, but for the few classes that share that half with another."""
    digest = _digest(s)
    return renamed.get(digest) if digest in renamed else int.from_bytes(digest[:8], "little", signed=True)


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """Components of the documents whose shingle sets have den * intersection >= num * union.

    Returns a row for each input row: the id, n_shingles, component_id (the smallest id of the component).
    """
    return linked(docs, id_col, text_col, k, num, den).select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def firsts(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of stored rows of :func:`linked`, the keys r of the first row of each component, and those of them that repeated rows share.

    The first is the one with the smallest id, rows without an id last, then by key. A row without n-grams is a
    component.
    """
    first = F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "r", "m"))
    rows = found.groupBy("r", "doc", "comp").agg(F.count("*").alias("m"))
    one = rows.where("comp is not null").groupBy("comp").agg(first.alias("h")).select("h.r", "h.m").union(rows.where("comp is null").select("r", "m"))
    keys = cut(one.groupBy("r").agg(F.sum("m").alias("m")))
    return keys.select("r"), keys.where("m > 1").select("r")


def _order(docs: DataFrame, k: int) -> Order:
    """The global order, from counts of the documents (text) that have an n-gram."""
    context = docs.sparkSession.sparkContext
    below = np.uint64((1 << (64 - COUNTED)) - 1)

    def low(s: np.ndarray, text: np.ndarray) -> tuple:
        return (s[: int(np.searchsorted(s, below, "right"))],)

    counts = lambda rows: store(rows.groupBy("t").agg(F.count("*").alias("m")).where(F.col("m") >= COMMON))
    some = counts(docs.mapInArrow(_flat(k, low, ["t"]), "t long"))
    first, _ = _most_common(some)
    discard(some)
    if not len(first):
        return Order(first, np.zeros(0, np.int32))
    share = context.broadcast(Table(first))

    def near(s: np.ndarray, text: np.ndarray) -> tuple | None:
        at, _ = share.value.places(text)
        if not len(at):
            return None
        close = np.zeros(len(text) + 1, np.int64)
        np.add.at(close, np.maximum(at - NEAR, 0), 1)
        np.add.at(close, np.minimum(at + NEAR + 1, len(text)), -1)
        return (_distinct(text[np.cumsum(close[:-1]) > 0]),)

    every = counts(docs.mapInArrow(_flat(k, near, ["t"]), "t long"))
    order = Order(*_most_common(every))
    discard(every)
    share.unpersist()
    return order


def _classes(sketches: DataFrame) -> tuple[DataFrame, dict[bytes, int]]:
    """(digest, c, doc, r) of the classes, stored, and the keys of those whose half digest another class has.

    Of 10**10 classes some three share half a digest, so what comes to the driver is as good as nothing.
    """
    classes = sketches.where("n > 0").groupBy("digest").agg(F.min("c").alias("c"), F.min("doc").alias("doc"), F.min("r").alias("r"))
    classes = store(classes)
    twice = classes.groupBy("c").agg(F.count("*").alias("m"), F.min("digest").alias("keeps")).where("m > 1")
    others = classes.join(twice, "c").where("digest <> keeps").select("digest").limit(1 << 16).collect()
    if not others:
        return classes, {}
    if len(others) == 1 << 16:
        raise ValueError("half digests collide: the hash is broken")
    seed = 1
    while True:
        renamed = {bytes(r.digest): np.uint64(xxhash.xxh3_64_intdigest(r.digest, seed)).view(np.int64).item() for r in others}
        new = list(renamed.values())
        if len(set(new)) == len(new) and classes.where(F.col("c").isin(new)).isEmpty():
            break
        seed += 1
    mapping = classes.sparkSession.createDataFrame([(bytearray(d), c) for d, c in renamed.items()], "digest binary, c2 long")
    fixed = store(classes.join(F.broadcast(mapping), "digest", "left").select("digest", F.coalesce("c2", "c").alias("c"), "doc", "r"))
    discard(classes)
    return fixed, renamed


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """A stored row for each input row: r (its :func:`row_key`), doc (the id), n, comp (a key of the component, null without n-grams), component_id."""
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(row_key(id_col, text_col).alias("r"), F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    only_text = docs.select("text")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(_digest(s), len(s)) for _, s, _ in _sets(batch.column(2), k)]
            keys = [int.from_bytes(d[:8], "little", signed=True) for d, _ in made]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([d for d, _ in made], pa.binary()), pa.array(keys, pa.int64()), pa.array([n for _, n in made], pa.int64())], ["r", "doc", "digest", "c", "n"])

    sketches = store(docs.mapInArrow(sketch, "r long, doc long, digest binary, c long, n long"))
    classes, renamed = _classes(sketches)
    order = spark.sparkContext.broadcast(_order(only_text, k))

    def prefix(s: np.ndarray, text: np.ndarray) -> tuple | None:
        if not len(s):
            return None
        n = prefix_size(len(s), num, den)
        t, rank = order.value.sort(s)
        return t[:n], _class_key(s, renamed), len(s), np.arange(n, dtype=np.int32), rank[:n] >= 0

    rows = only_text.mapInArrow(_flat(k, prefix, ["t", "c", "n", "i", "late"]), "t long, c long, n long, i int, late boolean")
    rows = rows.withColumn("part", F.when(F.col("late"), F.pmod(F.col("c"), F.lit(SPREAD)).cast("int")).otherwise(-1))
    here = Window.partitionBy("t", "part").orderBy("c")
    whole = here.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.select("t", "c", "n", "i", "late", (F.first("c").over(whole) != F.last("c").over(whole)).alias("shared"), F.lag("c").over(here).alias("before"))
    rows = store(rows.where((F.col("shared") | F.col("late")) & (F.col("before").isNull() | (F.col("before") != F.col("c")))).select("t", "c", "n", "i"))

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, wanted = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            c, f, parts = [], [], []
            for row, s, _ in _sets(batch.column(2), k):
                if _digest(s) != wanted[row]:  # another row of the same key
                    continue
                t, rank = order.value.sort(s)
                of = order.value.fragments(t, rank)
                cuts = np.flatnonzero(np.diff(of)) + 1
                parts += np.split(t.view(np.int64), cuts)
                f += of[np.append(0, cuts)].tolist()
                c += [keys[row]] * (len(cuts) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(f, pa.int32()), pa.array(parts, pa.list_(pa.int64()))], ["c", "f", "seg"])

    count = RARE_FRAGMENTS + FREQUENT_FRAGMENTS

    def verified(pairs: DataFrame) -> DataFrame:
        """Of stored (a, b, na, nb), the pairs that link: partial overlaps by fragment, summed for each pair."""
        ids = store(pairs.select(F.col("a").alias("c")).union(pairs.select("b")).distinct())
        own = store(classes.select("c", "r", "digest").join(ids, "c", "left_semi"))
        found = docs.select("r", "text").join(F.broadcast(own) if own.count() <= BROADCAST_IDS else own, "r").select("c", "digest", "text")
        parts = found.mapInArrow(segments, "c long, f int, seg array<long>")
        left, right = parts.select(F.col("c").alias("a"), "f", F.col("seg").alias("x")), parts.select(F.col("c").alias("b"), "f", F.col("seg").alias("y"))
        asked = pairs.withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
        partial = asked.join(right, ["b", "f"]).join(left, ["a", "f"]).select("a", "b", "na", "nb", "f", F.size(F.array_intersect("x", "y")).alias("o"))
        # repeated rows give a partial count more than once
        total = partial.groupBy("a", "b", "na", "nb").agg(*[F.max(F.when(F.col("f") == f, F.col("o"))).alias(f"o{f}") for f in range(count)])
        total = total.withColumn("o", sum((F.coalesce(f"o{f}", F.lit(0)) for f in range(count)), F.lit(0)))
        out = store(total.where(F.col("o") * den >= (F.col("na") + F.col("nb") - F.col("o")) * num).select(F.col("a").alias("u"), F.col("b").alias("v")))
        discard(ids, own)
        return out

    def pair(c: str, n: str, d: str, m: str) -> list[Column]:
        """The pair in order of its keys, with sizes."""
        return [F.least(c, d).alias("a"), F.greatest(c, d).alias("b"), F.when(F.col(c) < F.col(d), F.col(n)).otherwise(F.col(m)).alias("na"), F.when(F.col(c) < F.col(d), F.col(m)).otherwise(F.col(n)).alias("nb")]

    comp, tried = None, []
    for step in ("begin", "hash", "all"):
        if comp is None:
            now = rows.withColumn("comp", F.col("c"))
        else:
            now = rows.join(comp.withColumnRenamed("node", "c"), "c", "left").withColumn("comp", F.coalesce("comp", "c"))
        by = F.col("i") / F.col("n") if step == "begin" else F.xxhash64("c", "t").cast("double")
        # only n-grams of several components can join any
        head = now.groupBy("t").agg(F.min(F.struct(by.alias("o"), F.col("c").alias("c0"), F.col("n").alias("n0"), F.col("i").alias("i0"), F.col("comp").alias("comp0"))).alias("h"), F.min("comp").alias("x"), F.max("comp").alias("y"), F.min("n").alias("least")).where("x < y").select("t", "h.c0", "h.n0", "h.i0", "h.comp0", "least")
        # the most that a class can have in common from its place on, with a partner of the best size that there is
        most = F.col("n") - F.col("i")
        met = store(now.join(head, "t").where(most * den >= (F.greatest(F.col("least"), most) + F.col("i")) * num).drop("least"))
        discard(rows)
        rows = met.select("t", "c", "n", "i")
        rows._stored_at = met._stored_at
        apart = met.where("comp <> comp0")
        if step == "all":
            other = met.select("t", F.col("c").alias("d"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("comp").alias("comp2"), (F.col("comp") != F.col("comp0")).alias("out"))
            pairs = apart.select("t", "c", "n", "i", "comp").join(other, "t").where((F.col("comp") != F.col("comp2")) & (~F.col("out") | (F.col("c") < F.col("d"))) & _possible("n", "i", "m", "j", num, den)).select(pair("c", "n", "d", "m"))
        else:
            pairs = apart.where(_possible("n", "i", "n0", "i0", num, den)).select(pair("c", "n", "c0", "n0"))
        pairs = pairs.distinct()
        for t in tried:
            pairs = pairs.join(t.select("a", "b"), ["a", "b"], "left_anti")
        pairs = store(pairs)
        tried.append(pairs)
        found = verified(pairs)
        if comp is None or not found.isEmpty():
            last, comp = comp, connected(found if comp is None else comp.select(F.col("node").alias("u"), F.col("comp").alias("v")).union(found))
            discard(last)
        discard(found)
    discard(rows, *tried)

    of = classes.join(comp, classes["c"] == comp["node"], "left").select("digest", "doc", F.coalesce("comp", classes["c"]).alias("comp"))
    names = of.groupBy("comp").agg(F.min("doc").alias("component_id"))
    out = sketches.select("r", "doc", "digest", "n").join(of.drop("doc").join(names, "comp"), "digest", "left")
    out = store(out.select("r", "doc", "n", "comp", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc")).alias("component_id")))
    discard(sketches, classes, comp)
    return out
