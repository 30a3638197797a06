"""Suffix-array dedup: removes each byte that a string of ``length`` bytes covers which starts elsewhere too.

No suffix array of a whole corpus fits a task, so the strings are dealt first. Each string (window) of
``length`` bytes belongs to the least hash of the ``GRAM``-byte grams inside it. Equal windows have equal least
grams, and neighbours in a text mostly share theirs, so a text becomes a row for each run of windows with the
same least gram (a segment). Least grams with one segment hold nothing repeated, and those whose segments are
all the same string hold nothing else. Of the others, each distinct segment goes once to the task that has all
segments of the gram; there the Burrows-Wheeler transform of their bytes is expanded breadth first, from short
common prefixes to longer ones, up to ``length``, which gives the windows that start more than once.

Segments are the same string if two hashes of different kinds agree, 126 bits together; the windows of different ones
are compared by the transform. Grams of very many segments (a passage that a third of all texts share) are at most some
thousands; they are broadcast to their segments, so none of them is one task's key.

A gram with more than ``GROUP`` distinct segments (a passage that very many texts share, next to what is
different in each) isn't gathered in a task: its windows are counted by 128-bit hash, one row for each window.

Null and empty texts, and texts shorter than ``length``, lose nothing. Repeated rows are copies of each other,
so both lose what is long enough; so do different texts of one id. Nulls in the id column are kept as they are. Very
long texts are taken whole. Where grams have equal hashes both are the least. Extra columns are ignored. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskloom.llm import kernel
from taskloom.llm.bwt import repeated
from taskloom.llm.common import chunks, discard, prepare, ragged, store, texts

LENGTH = 200
GRAM = 40
#: Distinct segments of a gram that are gathered in one task at most; each has fewer than 2 * LENGTH bytes.
GROUP = 20_000
#: Rows of a gram, or one in so many rows of all, from which on it is broadcast.
HOT, HOT_SHARE = 10_000, 10_000
#: Bytes that one transform is made of, if no single gram has more.
BATCH_BYTES = 1 << 19


def _least(x: np.ndarray, width: int, at_most: bool = True) -> np.ndarray:
    """Least (or greatest) of each ``width`` values in a row, at the place of the first of them."""
    step = np.minimum if at_most else np.maximum
    out, have = x, 1
    while have * 2 <= width:
        out = step(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = step(out[: len(out) - (width - have)], out[width - have :])
    return out


def segments(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end: text, start in it, number of windows, least gram, two hashes of the bytes, loops.

    ``loops``: a window may be in the segment twice.
    """
    width = length - GRAM + 1
    size = np.diff(offsets)
    long = np.flatnonzero(size >= length)
    if not len(long):
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(np.uint64), none.view(np.uint64), none.view(np.uint64), none.astype(bool)
    power, inverse = kernel.powers(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(kernel.BYTE_KEY[data] * power[: len(data)], out=sums[1:])
    grams = kernel.mix((sums[GRAM:] - sums[:-GRAM]) * inverse[: len(data) + 1 - GRAM])
    least = _least(grams, width)
    windows = size[long] - length + 1
    at = ragged(offsets[long], windows)
    own = np.repeat(long, windows)
    value = least[at]
    new = np.empty(len(at), bool)
    new[0] = True
    new[1:] = (value[1:] != value[:-1]) | (own[1:] != own[:-1])
    begin = np.flatnonzero(new)
    run = np.diff(np.append(begin, len(at)))
    pieces = -(-run // width)
    if (pieces > 1).any():  # only texts that repeat themselves have longer runs
        part = ragged(np.zeros(len(begin), np.int64), pieces)
        begin = np.repeat(begin, pieces) + part * width
        run = np.minimum(np.repeat(run, pieces) - part * width, width)
    start, doc, gram = at[begin], own[begin], value[begin]
    end = start + run - 1 + length
    content = kernel.mix(((sums[end] - sums[start]) * inverse[start]) ^ (run.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    second = kernel.Hashes(data).of(start, end)
    # grams that are the least of a window, at more than one place close by
    covering = np.zeros(len(data) + width, np.uint64)
    covering[at + width - 1] = value
    covering = _least(covering, width, False)
    places = np.flatnonzero(grams == covering[: len(grams)])
    by = places[np.lexsort((places, grams[places]))]
    twice = (grams[by[1:]] == grams[by[:-1]]) & (by[1:] - by[:-1] < 2 * length)
    loops = np.isin(gram, grams[by[1:][twice]])
    return doc, start - offsets[doc], run, gram, content, second, loops


_SEGMENTS = "h long, ch long, cg long, id long, x long, s int, n int, f boolean"


def _segment_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts(batch.column(2))
            for lo, hi in chunks(offsets):
                doc, s, n, h, ch, cg, f = segments(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], length)
                if len(doc):
                    rows = pa.array(doc + lo)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ch.view(np.int64)), pa.array(cg.view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(s.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(f)], ["h", "ch", "cg", "id", "x", "s", "n", "f"])

    return run


def _runs(flags: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and length of runs of true flags that don't cross from one value of ``of`` to the next."""
    begin = flags.copy()
    begin[1:] &= ~flags[:-1] | (of[1:] != of[:-1])
    end = flags.copy()
    end[:-1] &= ~flags[1:] | (of[1:] != of[:-1])
    a, b = np.flatnonzero(begin), np.flatnonzero(end)
    return a, b - a + 1


def _expand(length: int):
    """(h, ch, cg, content) rows in order of h to (h, ch, cg, o, c): c windows from the o-th on start more than once."""

    def flush(h: list, ch: list, cg: list, parts: list) -> pa.RecordBatch:
        data, offsets = texts(pa.chunked_array(parts, pa.large_binary()))
        windows = np.diff(offsets) - length + 1
        starts = ragged(offsets[:-1], windows)
        own = np.repeat(np.arange(len(windows)), windows)
        begin, count = _runs(repeated(data, starts, length), own)
        row = own[begin]
        first = np.cumsum(windows) - windows
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(h)[row]), pa.array(np.concatenate(ch)[row]), pa.array(np.concatenate(cg)[row]), pa.array((begin - first[row]).astype(np.int32)), pa.array(count.astype(np.int32))], ["h", "ch", "cg", "o", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, ch, cg, parts, size = [], [], [], [], 0
        for batch in batches:
            keys, content = batch.column(0).to_numpy(), batch.column(3).cast(pa.large_binary())
            bounds = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            if h and len(keys) and h[-1][-1] == keys[0]:
                bounds = bounds[1:]
            at = 0
            for b in [*bounds.tolist(), len(keys)]:
                if b > at:
                    h.append(keys[at:b])
                    ch.append(batch.column(1).to_numpy()[at:b])
                    cg.append(batch.column(2).to_numpy()[at:b])
                    parts.append(content.slice(at, b - at))
                    size += (b - at) * 2 * length
                if size >= BATCH_BYTES and b < len(keys):
                    yield flush(h, ch, cg, parts)
                    h, ch, cg, parts, size = [], [], [], [], 0
                at = b
        if h:
            yield flush(h, ch, cg, parts)

    return run


def _cut_out(length: int, carry: int, with_kept: bool):
    """(id, text, s, n, ...) to the number of bytes, of those that go and of spans, the digest of the bytes that stay, and these; the rest is passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts(batch.column(1))
            size, removed, spans, kept = [], [], [], []
            for i in range(len(offsets) - 1):
                own = data[offsets[i] : offsets[i + 1]]
                s = batch.column(2)[i]
                if s.is_valid and len(s):
                    s = np.asarray(s.values)
                    change = np.zeros(len(own) + 1, np.int32)
                    np.add.at(change, s, 1)
                    np.add.at(change, s + np.asarray(batch.column(3)[i].values) - 1 + length, -1)
                    gone = np.cumsum(change[:-1]) > 0
                    spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                    stays = own[~gone].tobytes()
                else:
                    spans.append(0)
                    stays = own.tobytes()
                size.append(len(own))
                removed.append(len(own) - len(stays))
                kept.append(stays)
            columns = [batch.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())]
            names = ["id0", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_kept:
                columns += [pa.array(kept, pa.binary()), pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string())]
                names += ["kept", "kept_text"]
            yield pa.RecordBatch.from_arrays([*columns, *(batch.column(4 + k) for k in range(carry))], [*names, *(f"c{k}" for k in range(carry))])

    return run


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, carry: tuple[str, ...] = (), with_kept: bool = True) -> DataFrame:
    """A row for each input row: the id, n_bytes, n_removed, n_spans, kept_sha256, with ``with_kept`` kept (binary: the bytes that stay) and kept_text (without code points that are cut through), and the columns ``carry``.

    The id is taken as a long.
    """
    prepare(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    more = [f"c{k}" for k in range(len(carry))]
    docs = docs.select(F.col(id_col).cast("long").alias("id0"), text.alias("text"), *(F.col(c).alias(n) for c, n in zip(carry, more, strict=True)))
    docs = docs.select("id0", F.coalesce("id0", F.lit(-1)).alias("id"), F.xxhash64("id0", "text").alias("x"), "text", *more)
    same = ["h", "ch", "cg"]  # the key of a string
    parts = store(docs.select("id", "x", "text").mapInArrow(_segment_rows(length), _SEGMENTS))
    grams = parts.groupBy("h").agg(F.count("*").alias("m"), *(f(c).alias(f"{c}{n}") for c in ("ch", "cg") for n, f in ((0, F.min), (1, F.max))), F.max("f").alias("f"))
    grams = store(grams.where("m > 1 or f").select("h", "m", F.expr("f or ch0 <> ch1 or cg0 <> cg1").alias("mixed")))
    limit = max(HOT, parts.count() // HOT_SHARE)  # so there are HOT_SHARE hot ones at most
    hot, rest = F.broadcast(grams.where(F.col("m") >= limit).drop("m")), grams.where(F.col("m") < limit).drop("m")
    rows = parts.drop("f")
    found = store(rows.join(hot, "h").unionByName(rows.join(hot, "h", "left_anti").join(rest, "h")))
    discard(parts, grams)

    mixed = found.where("mixed")
    distinct = mixed.groupBy(*same).agg(F.count("*").alias("m"), F.min(F.struct("id", "x", "s", "n")).alias("r")).select(*same, "m", "r.*")
    groups = distinct.groupBy("h").agg(F.count("*").alias("g"))
    strings = distinct.join(groups, "h").join(docs.select("id", "x", "text"), ["id", "x"]).select(*same, "m", "g", "n", F.substring(F.col("text").cast("binary"), F.col("s") + 1, F.col("n") + F.lit(length - 1)).alias("content"))
    strings = store(strings)
    small = strings.where(F.col("g") <= GROUP).select(*same, "content").dropDuplicates(same).repartition("h").sortWithinPartitions("h")
    runs = small.mapInArrow(_expand(length), "h long, ch long, cg long, o int, c int")
    big = strings.where(F.col("g") > GROUP)
    one = big.select(*same, F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("o"), "content").select(*same, "o", F.substring("content", F.col("o") + 1, F.lit(length)).alias("w"))
    one = one.select(*same, "o", F.xxhash64("w").alias("w1"), F.xxhash64(F.lit(7), "w").alias("w2"))
    often = one.groupBy("h", "w1", "w2").agg(F.count("*").alias("k")).where("k > 1").select("h", "w1", "w2")
    runs = runs.unionByName(one.join(often, ["h", "w1", "w2"]).select(*same, "o", F.lit(1).alias("c")))
    whole = strings.where("m > 1").select(*same, F.lit(0).alias("o"), F.col("n").alias("c"))
    runs = runs.unionByName(whole).distinct()

    spans = found.where("not mixed").select("id", "x", "s", "n").union(mixed.join(runs, same).select("id", "x", (F.col("s") + F.col("o")).alias("s"), F.col("c").alias("n")))
    spans = store(spans.groupBy("id", "x").agg(F.collect_list(F.struct("s", "n")).alias("r")).select("id", "x", F.col("r.s").alias("s"), F.col("r.n").alias("n")))
    discard(found, strings)
    kinds = "".join(f", {n} {docs.schema[n].dataType.simpleString()}" for n in more)
    out = docs.join(spans, ["id", "x"], "left").select("id0", "text", "s", "n", *more)
    out = out.mapInArrow(_cut_out(length, len(more), with_kept), "id0 long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, kept_text string" * with_kept + kinds)
    return out.withColumnsRenamed({"id0": id_col} | dict(zip(more, carry, strict=True)))
