"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words are lower-cased runs of [0-9a-z] and of what isn't ASCII. Of each WINDOW words in a row of a text there
are SPAN grams of GRAM words, and the one with the least hash is the fingerprint. Equal windows have equal
fingerprints at equal places, so every shared span of WINDOW words has one in common: the guarantee of
winnowing. Fingerprints of the documents are joined with those of the benchmark's distinct windows; each hit is
then extended to the whole window, word by word, and only full windows count.

An item with fewer words than a window is one window of all its words. Its fingerprint is its first word.

A fingerprint's row has its place and the few words around it, not the text, so the work is linear in a text's length;
most fingerprints that the benchmark hasn't are told by a set of bits before they become rows, and the others end in
the join, which is before any shuffle.

The benchmark's windows are broadcast, in blocks of at most BLOCK rows, and the documents are read once for
each block, so a benchmark of any size is compared in full. One block holds about 20,000 items of 50 words.

Nulls and texts without words have no words, hit nothing and aren't hit. A document that is in the table more
than once has one row; documents of one id and different texts have a row each. Ties between equal hashes in a
window are all kept. Very long texts are taken whole. Extra columns are ignored. An empty benchmark hits nothing, an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskloom.llm.common import cut, prepare

WINDOW = 8
GRAM = 5
SPAN = WINDOW - GRAM + 1
#: Rows of benchmark windows in a broadcast at most, of about 60 bytes each.
BLOCK = 1_000_000
#: Bits of fingerprints in the set that is asked before a row is made; a larger set would only save more rows.
BITS = 18
#: ASCII that isn't part of a word.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    ascii_ = F.octet_length(text) == F.char_length(text)
    low = F.when(ascii_, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.coalesce(F.array_remove(F.split(low, BETWEEN), ""), F.array().cast("array<string>"))


def _grams(h: Column) -> Column:
    """Hash of each GRAM values in a row."""
    return F.transform(F.sequence(F.lit(1), F.size(h) - (GRAM - 1)), lambda i: F.xxhash64(*[F.get(h, i + (k - 1)) for k in range(GRAM)]))


def _bits(table: DataFrame) -> Column:
    """The last BITS bits of all fingerprints of a table as a set: an array of longs of 64 bits each, 32 KB in all."""
    cell = F.col("fp").bitwiseAND((1 << BITS) - 1)
    words = table.groupBy(F.shiftright(cell, 6).alias("k")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), cell.bitwiseAND(63).cast("int"))).alias("w"))
    found = {r.k: r.w for r in words.collect()}
    return F.split(F.lit(",".join(str(found.get(k, 0)) for k in range(1 << (BITS - 6)))), ",").cast("array<bigint>")


def _maybe(bits: Column, fp: Column) -> Column:
    """Whether a fingerprint may be one of the table's: most others end here, before a row is made of them."""
    cell = fp.bitwiseAND((1 << BITS) - 1)
    word = F.get(bits, F.shiftright(cell, 6).cast("int"))
    return F.call_function("shiftright", word, cell.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1


def _fingerprints(h: Column, g: Column, also: Callable[[Column], Column]) -> Column:
    """Places of the grams that are the least of a window and meet ``also``; none for fewer words than a window."""
    size = F.size(g)
    near = range(1, SPAN)

    def least(i: Column) -> Column:
        """Whether the gram at i is the least of some window: of SPAN grams in a row with i among them."""
        own = F.get(g, i)
        before = [F.coalesce(F.get(g, i - k) >= own, F.lit(False)) for k in near]
        after = [F.coalesce(F.get(g, i + k) >= own, F.lit(False)) for k in near]
        left = reduce(lambda rest, ok: F.when(ok, rest + 1).otherwise(0), reversed(before), F.lit(0))
        right = reduce(lambda rest, ok: F.when(ok, rest + 1).otherwise(0), reversed(after), F.lit(0))
        return left + right >= SPAN - 1

    places = F.filter(F.sequence(F.lit(0), size - 1), lambda i: also(i) & least(i))
    return F.when(size >= SPAN, places).otherwise(F.array().cast("array<int>"))


def _made(rows: DataFrame, name: str) -> DataFrame:
    """The rows with the column made here and nowhere else.

    The optimizer would put its expression into each lambda that reads it and so evaluate it for each element; a
    generator of one element is in its way.
    """
    rest = [c for c in rows.columns if c != name]
    return rows.select(*rest, F.explode(F.array(name)).alias(name))


def windows(bench: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (win, words as hashes, n) and (win, item) of the windows' items."""
    items = bench.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col).cast("string")).alias("w")).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(WINDOW))
    each = items.select("item", n.alias("n"), "w").select("item", "n", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1), lambda i: F.slice("w", i, F.col("n")))).alias("w"))
    each = each.select("item", "n", F.transform("w", lambda x: F.xxhash64(x)).alias("h")).distinct()
    each = each.withColumn("win", F.xxhash64("h"))
    return each.select("win", "h", "n").distinct(), each.select("win", "item").distinct()


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_items: int = 2, with_hash: bool = False) -> DataFrame:
    """A row for each document: the id, n_words, n_hit, n_items, items_sha256, contaminated.

    With ``with_hash`` also text_hash, xxhash64 of the text, which with the id tells documents of one id or none apart.
    ``n_hit``: words inside any occurrence of a window of an item; ``n_items``: items with such a window.
    """
    prepare(docs.sparkSession)
    wins, of = windows(bench, item_col, item_text_col)
    wins, of = cut(wins), cut(of)
    full = wins.where(F.col("n") == WINDOW)
    grams = F.transform(F.sequence(F.lit(0), F.lit(SPAN - 1)), lambda o: F.xxhash64(*[F.get("h", o + k) for k in range(GRAM)]))
    prints = full.select("win", "n", F.posexplode(grams).alias("o", "fp"), F.array_min(grams).alias("least")).where("fp = least").drop("least")
    short = wins.where(F.col("n") < WINDOW).select("win", "n", F.lit(0).alias("o"), F.get("h", F.lit(0)).alias("fp"))
    prints, short = cut(prints), cut(short)

    text = F.col(text_col).cast("string")
    base = _made(docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("x"), F.transform(words(text), lambda w: F.xxhash64(w)).alias("h")), "h")
    base = _made(base.withColumn("g", F.when(F.size("h") >= GRAM, _grams(F.col("h"))).otherwise(F.array().cast("array<bigint>"))), "g")
    around = SPAN - 1
    none = F.array(F.struct(F.lit(-1).alias("p"), F.lit(0).cast("bigint").alias("fp"), F.array().cast("array<bigint>").alias("c")))

    def hits(places: Callable[[Column], Column], fp: Callable[[Column], Column], table: DataFrame) -> DataFrame:
        """Starts of the windows in the documents, and a row (start null) for each document as well.

        A fingerprint at p has in c the words from p - around on, null where the text has none."""
        bits = _bits(table)
        at = F.transform(places(bits), lambda i: place(i, fp(i)))
        # the number of words is made before the rows are, or each of them would have the whole text beside it
        seeds = base.select("id", "x", F.size("h").alias("words"), F.concat(none, at).alias("at")).select("id", "x", "words", F.explode("at").alias("e")).select("id", "x", "words", "e.*")
        # not createDataFrame: its rows pass through Python workers of another kind, which stay on the executors
        every = docs.sparkSession.range(0, 1, 1, 1).selectExpr("cast(null as long) win", "0 n", "0 o", "0L fp")
        same = seeds.join(F.broadcast(table.unionByName(every).withColumnRenamed("fp", "fp2")), F.col("fp") == F.col("fp2"))
        begin = F.col("p") - F.col("o")
        window = F.slice("c", around - F.col("o") + 1, F.greatest(F.col("n"), F.lit(0)))
        inside = (begin >= 0) & (begin + F.col("n") <= F.col("words"))
        extended = F.when(F.col("p") >= 0, inside & F.col("win").isNotNull() & F.coalesce(F.xxhash64(window) == F.col("win"), F.lit(False))).otherwise(F.col("win").isNull())
        return same.where(extended).select("id", "x", "words", F.when(F.col("win").isNotNull(), begin).alias("s"), "n", "win")

    def place(i: Column, fp: Column) -> Column:
        # not a slice: that would copy the whole array for each place
        return F.struct(i.alias("p"), fp.alias("fp"), F.array(*[F.get("h", i + k) for k in range(-around, WINDOW)]).alias("c"))

    def full_places(bits: Column) -> Column:
        return _fingerprints(F.col("h"), F.col("g"), lambda i: _maybe(bits, F.get("g", i)))

    def short_places(bits: Column) -> Column:
        every = F.when(F.size("h") > 0, F.sequence(F.lit(0), F.size("h") - 1)).otherwise(F.array().cast("array<int>"))
        return F.filter(every, lambda i: _maybe(bits, F.get("h", i)))

    found = []
    for rows, places, fp in ((prints, full_places, lambda i: F.get("g", i)), (short, short_places, lambda i: F.get("h", i))):
        count = rows.count()
        if count == 0 and (rows is short):
            continue
        blocks = -(-count // BLOCK) or 1
        for b in range(blocks):
            table = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("win"), F.lit(blocks)) == b)
            found.append(hits(places, fp, table))
    found = reduce(DataFrame.unionAll, found)
    spans = found.groupBy("id", "x").agg(F.max("words").alias("n_words"), F.sort_array(F.collect_set(F.when(F.col("s").isNotNull(), F.struct("s", (F.col("s") + F.col("n")).alias("e"))))).alias("r"), F.collect_set("win").alias("wins"))
    # each span adds what is past the furthest end so far
    covered = F.aggregate("r", F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("sum")), lambda acc, r: F.struct(F.greatest(acc["end"], r["e"]).alias("end"), (acc["sum"] + F.greatest(r["e"] - F.greatest(r["s"], acc["end"]), F.lit(0))).alias("sum")), lambda acc: acc["sum"])
    spans = cut(spans.select("id", "x", F.col("n_words").cast("long").alias("n_words"), covered.alias("n_hit"), "wins"))
    hit = spans.where(F.size("wins") > 0).select("id", "x", F.explode("wins").alias("win"))
    # windows that very many documents have are no hot key of a shuffle where the benchmark's windows fit a broadcast
    by_item = hit.join(F.broadcast(of) if of.count() <= BLOCK else of, "win").select("id", "x", "item").distinct().groupBy("id", "x").agg(F.sort_array(F.collect_list("item")).alias("items"))
    out = spans.drop("wins").join(by_item.withColumnsRenamed({"id": "id1", "x": "x1"}), F.col("id").eqNullSafe(F.col("id1")) & F.col("x").eqNullSafe(F.col("x1")), "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(F.col("id").alias(id_col), "n_words", "n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.size(items) >= min_items).alias("contaminated"), *[F.col("x").alias("text_hash")] * with_hash)
