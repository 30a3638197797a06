"""Quality rules: base statistics of every document and a short-circuit cascade of rules.

The base statistics are made for all documents. Documents that don't fail the base test go through the cascade.
Each rule's cost and rejections are measured on a seeded sample of about SAMPLE_ROWS rows of all partitions, whole
texts, on the executors; the rules are put in order of rejections per second, and each rule sees only what the rules
before it have kept. What a rule needs besides the base statistics it makes itself, for these rows alone. A document
is kept if no rule rejects it, so the order changes the time but never the result.

Lines and windows of words are grouped by hash, and those of equal hash are then compared byte by byte.

Null and empty texts have no words and fail the base test. Repeated rows have a row each; of rules of equal rejections
per second the one given first goes first. Texts are taken whole, very long ones in a pass of their own. Extra columns
are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskloom.llm import kernel
from taskloom.llm.common import chunks, prepare, ragged, texts

REPEAT_WORDS = 8
#: Rows that the sample has on average, and its seed.
SAMPLE_ROWS, SEED = 400, 17
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_LETTERS = np.zeros(256, bool)
_LETTERS[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True
_LETTERS[0xC0:] = True  # the first byte of a longer code point
_FIRST = np.ones(256, bool)  # the first byte of any code point
_FIRST[0x80:0xC0] = False


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set in each text."""
    return np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[offsets])


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` bytes from a on are those from b on."""
    differ = np.concatenate(([0], np.cumsum(data[ragged(a, size)] != data[ragged(b, size)])))
    ends = np.cumsum(size)
    return differ[ends] == differ[ends - size]


def _groups(values: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose hash a later place of the same text has too, and the next such place of each."""
    key = kernel.mix(values ^ kernel.mix(of.astype(np.uint64) + np.uint64(1)))
    by = np.argsort(key, kind="stable")
    equal = key[by[1:]] == key[by[:-1]]
    return by[:-1][equal], by[1:][equal]


class Chunk:
    """Texts laid end to end with what the rules need of them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data, self.offsets = data, offsets
        self.words = kernel.Words(data, offsets, ~kernel.SPACE)
        self.hash = self.words.hashes(data)
        self.of = np.repeat(np.arange(len(offsets) - 1), self.words.count)
        self.n_words = self.words.count.astype(np.int64)
        self.word_chars = _per_text(self.words.mask & _FIRST[data], offsets)
        self.n_symbols = _per_text(_SYMBOLS[data], offsets)
        self._lines()
        self._repeats()
        self.base_failed = (self.n_words < 20) | (100 * self.n_repeat_words > 30 * self.n_words)

    def _lines(self) -> None:
        data, offsets = self.data, self.offsets
        at = np.flatnonzero(data == 10)
        begin = np.sort(np.concatenate([offsets[:-1], at + 1]), kind="stable")
        end = np.sort(np.concatenate([offsets[1:], at]), kind="stable")
        of = np.repeat(np.arange(len(offsets) - 1), 1 + np.diff(np.searchsorted(at, offsets)))
        filled = np.searchsorted(self.words.start, end) > np.searchsorted(self.words.start, begin)
        begin, end, of = begin[filled], end[filled], of[filled]
        self.n_lines = np.bincount(of, minlength=len(offsets) - 1)
        again = np.zeros(len(of), bool)
        if len(of) > len(np.unique(of)):
            one, two = _groups(kernel.Hashes(data).of(begin, end), of)
            right = (of[one] == of[two]) & (end[one] - begin[one] == end[two] - begin[two])
            right[right] = _same_bytes(data, begin[one[right]], begin[two[right]], (end - begin)[one[right]])
            again[two] = True
            for d in np.unique(of[np.concatenate([one[~right], two[~right]])]).tolist():  # unequal lines of one hash
                seen: set[bytes] = set()
                for i in np.flatnonzero(of == d).tolist():
                    line = data[begin[i] : end[i]].tobytes()
                    again[i] = line in seen
                    seen.add(line)
        self.n_dup_lines = np.bincount(of[again], minlength=len(offsets) - 1)

    def _repeats(self) -> None:
        k, n = REPEAT_WORDS, len(self.of)
        covered = np.zeros(n + 1, np.int64)
        if n >= k:
            at = np.flatnonzero(self.of[: n - k + 1] == self.of[k - 1 :])
            one, two = _groups(kernel.grams(self.hash, k)[at], self.of[at])
            twice = np.zeros(len(at), bool)
            twice[one] = twice[two] = True
            a, b = at[one], at[two]
            right = self.of[a] == self.of[b]
            size = self.words.end - self.words.start
            for i in range(k):
                right &= size[a + i] == size[b + i]
            for i in range(k):
                own = np.flatnonzero(right)
                right[own] = _same_bytes(self.data, self.words.start[a[own] + i], self.words.start[b[own] + i], size[a[own] + i])
            for d in np.unique(self.of[np.concatenate([a[~right], b[~right]])]).tolist():  # unequal windows of one hash
                first, last = int(self.words.first[d]), int(self.words.first[d + 1])
                words = [self.data[self.words.start[i] : self.words.end[i]].tobytes() for i in range(first, last)]
                windows = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
                count = Counter(windows)
                twice[np.searchsorted(at, first) : np.searchsorted(at, first) + len(windows)] = [count[w] > 1 for w in windows]
            covered[at[twice]] += 1
            covered[at[twice] + k] -= 1
        self.n_repeat_words = _per_text(np.cumsum(covered[:-1]) > 0, self.words.first)


@dataclass(frozen=True)
class Rule:
    """``reject(chunk, rows)``: which of the rows it rejects."""

    name: str
    reject: Callable[[Chunk, np.ndarray], np.ndarray]


def _symbols(c: Chunk, rows: np.ndarray) -> np.ndarray:
    return 10 * c.n_symbols[rows] > c.n_words[rows]


def _word_length(c: Chunk, rows: np.ndarray) -> np.ndarray:
    return (c.word_chars[rows] < 2 * c.n_words[rows]) | (c.word_chars[rows] > 20 * c.n_words[rows])


def _dup_lines(c: Chunk, rows: np.ndarray) -> np.ndarray:
    return 10 * c.n_dup_lines[rows] > 6 * c.n_lines[rows]


def _letters(c: Chunk, rows: np.ndarray) -> np.ndarray:
    """Under half of the characters of words are letters (ASCII letters and all code points past ASCII)."""
    sizes = c.offsets[rows + 1] - c.offsets[rows]
    letters = _per_text(_LETTERS[c.data[ragged(c.offsets[rows], sizes)]], np.append(0, np.cumsum(sizes)))
    return 2 * letters < c.word_chars[rows]


def _kinds(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many different values each run of ``sizes`` values has."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    by = np.lexsort((values, of))
    new = np.append(True, (values[by[1:]] != values[by[:-1]]) | (of[by[1:]] != of[by[:-1]]))[: len(by)]
    return np.bincount(of[by[new]], minlength=len(sizes))


def _variety(c: Chunk, rows: np.ndarray) -> np.ndarray:
    """Over 50 words, and under one of 20 words is new."""
    sizes = c.n_words[rows]
    return (sizes > 50) & (20 * _kinds(c.hash[ragged(c.words.first[rows], sizes)], sizes) < sizes)


def _triples(c: Chunk, rows: np.ndarray) -> np.ndarray:
    """Over 50 words, and under one of three runs of three words is new."""
    sizes = np.maximum(c.n_words[rows] - 2, 0)
    grams = kernel.grams(c.hash, 3)
    return (sizes > 48) & (3 * _kinds(grams[ragged(c.words.first[rows], sizes)], sizes) < sizes)


RULES = (Rule("symbols", _symbols), Rule("word_length", _word_length), Rule("dup_lines", _dup_lines), Rule("letters", _letters), Rule("variety", _variety), Rule("triples", _triples))


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, Chunk]]:
    data, offsets = texts(batch.column(1))
    for lo, hi in chunks(offsets):
        yield lo, hi, Chunk(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])


def plan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """The rules in the order in which they should run, with seconds a document and share rejected on the sample.

    A seeded sample of all partitions, of ``sample_rows`` rows on average, is measured where it is; only sums come to
    the driver. Ties keep the order given.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.lit(0).alias("id"), F.col(text_col).cast("string").alias("text"))
    sample = rows.sample(False, min(1.0, sample_rows / max(1, docs.count())), SEED)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost, seen, rejected = [0.0] * len(rules), 0, [0] * len(rules)
        for batch in batches:
            for _, _, chunk in _chunks(batch):
                own = np.flatnonzero(~chunk.base_failed)
                seen += len(own)
                for k, rule in enumerate(rules):
                    began = time.perf_counter()
                    rejected[k] += int(rule.reject(chunk, own).sum())
                    cost[k] += time.perf_counter() - began
        yield pa.RecordBatch.from_arrays([pa.array(range(len(rules)), pa.int32()), pa.array([seen] * len(rules)), pa.array(cost, pa.float64()), pa.array(rejected)], ["k", "seen", "cost", "rejected"])

    sums = sample.mapInArrow(measure, "k int, seen long, cost double, rejected long").groupBy("k").agg(F.sum("seen").alias("seen"), F.sum("cost").alias("cost"), F.sum("rejected").alias("rejected"))
    found = {r.k: r for r in sums.collect()}  # a row for each rule
    known = [(rule, found[k].cost / max(1, found[k].seen), found[k].rejected / max(1, found[k].seen)) if k in found else (rule, 0.0, 0.0) for k, rule in enumerate(rules)]
    return sorted(known, key=lambda x: -(x[2] + 1e-6) / max(x[1], 1e-12))


def _verdict(c: Chunk, order: list[Rule]) -> np.ndarray:
    """Which texts no rule rejects; each rule sees what the rules before it have kept."""
    kept = ~c.base_failed
    for rule in order:
        rows = np.flatnonzero(kept)
        if not len(rows):
            break
        kept[rows[rule.reject(c, rows)]] = False
    return kept


_NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """A row for each input row: the id, the base statistics, base_failed and kept; then the columns ``carry``."""
    order = [r for r, _, _ in plan(docs, rules, text_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, c in _chunks(batch):
                kept = _verdict(c, order)
                columns = [batch.column(0).slice(lo, hi - lo), *(pa.array(getattr(c, n).astype(np.int64)) for n in _NAMES), pa.array(c.base_failed), pa.array(kept)]
                columns += [batch.column(2 + k).slice(lo, hi - lo) for k in range(len(carry))]
                yield pa.RecordBatch.from_arrays(columns, ["id", *_NAMES, "base_failed", "kept", *(f"c{k}" for k in range(len(carry)))])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *(F.col(n).alias(f"c{k}") for k, n in enumerate(carry)))
    kinds = [f.dataType.simpleString() for f in rows.schema]
    schema = f"id {kinds[0]}, {', '.join(f'{n} long' for n in _NAMES)}, base_failed boolean, kept boolean" + "".join(f", c{k} {t}" for k, t in enumerate(kinds[2:]))
    return rows.mapInArrow(run, schema).withColumnsRenamed({"id": id_col} | {f"c{k}": n for k, n in enumerate(carry)})


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The rows that the rules keep, with all their columns."""
    order = [r for r, _, _ in plan(docs, rules, text_col)]
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            two = pa.RecordBatch.from_arrays([batch.column(at), batch.column(at)], ["id", "text"])
            kept = [_verdict(c, order) for _, _, c in _chunks(two)]
            yield batch.filter(pa.array(np.concatenate([*kept, np.zeros(0, bool)])))

    return docs.mapInArrow(run, docs.schema)
