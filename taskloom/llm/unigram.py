"""Token counts of a unigram tokenizer without its tokens.

An Aho-Corasick automaton gives every piece of the vocabulary that ends at a place of the text; dynamic
programming over the places carries the best score and the number of pieces that reach it, and nothing to trace
back. Ties go to the piece that starts first, as in the tokenizer; a character with no piece of its own costs
the least score less 10 and counts as its UTF-8 bytes (byte fallback). Scores are added in double precision.

No piece has a white-space mark after another character, so the best path of a text is that of its words, and a
worker counts each distinct word once. The automaton runs over all new words of a batch end to end; the places of all
of them advance together, one character a step. Words of more than LONG characters are counted one by one, in time
linear in their length.

The vocabulary is any table of pieces and scores; :func:`vocabulary` takes that of a SentencePiece model. The installed
models are BPE, whose scores are ranks and no log-probabilities; the method doesn't ask which.

Null and empty texts have no tokens. Texts are taken whole, however long. Repeated rows have a row each. Extra columns
are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskloom.llm.common import prepare

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Words that a Python worker remembers; beyond it starts anew.
CACHE_WORDS = 500_000
#: Characters of a word that is counted together with others at most; under 256.
LONG = 64
#: Characters of text, or one text, whose words are looked up together.
PART_CHARS = 1 << 19

Pieces = list[tuple[str, float]]


def vocabulary(model_path: str) -> Pieces:
    """Pieces and scores of a SentencePiece model, but for control, byte and unused ones."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]


class Counter:
    def __init__(self, pieces: Pieces) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for i, (piece, _) in enumerate(pieces):
            if re.search(f"[^{MARK}]{MARK}", piece):
                raise ValueError("the vocabulary has pieces of several words")
            self.automaton.add_word(piece, i)
        self.automaton.make_automaton()
        self.size = np.array([len(p) for p, _ in pieces], np.int64)
        self.score = np.array([s for _, s in pieces], np.float64)
        self.single = {p for p, _ in pieces if len(p) == 1}
        used = {c for p, _ in pieces for c in p}
        self.between = next(chr(c) for c in range(0x110000) if chr(c) not in used)  # no piece goes across it
        self.unknown = float(self.score.min()) - UNKNOWN_PENALTY
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.counts, self.scores = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.float64)

    def word(self, text: str) -> tuple[int, float]:
        """Pieces and score of the best path; the text starts with a mark and has none after other characters."""
        n = len(text)
        ending: list[list[int]] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(text):
            ending[end].append(match)
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        for e in range(n):
            best, pieces = None, 0
            for size, s in sorted(((int(self.size[m]), float(self.score[m])) for m in ending[e]), reverse=True):  # the first start first
                s += score[e + 1 - size]
                if best is None or s > best:
                    best, pieces = s, count[e + 1 - size] + 1
            if text[e] not in self.single:
                s = score[e] + self.unknown
                if best is None or s > best:
                    best, pieces = s, count[e] + len(text[e].encode("utf-8", "surrogatepass"))
            score[e + 1], count[e + 1] = best, pieces
        return count[n], score[n]

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`word`, of many words, none of which is over LONG characters."""
        sizes = np.array([len(t) for t in texts], np.int64)
        joined = self.between.join(texts)
        begin = np.cumsum(sizes + 1) - (sizes + 1)
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        found = np.fromiter(chain.from_iterable(self.automaton.iter(joined)), np.int64).reshape(-1, 2)
        of = np.repeat(np.arange(len(texts)), sizes + 1)[: len(cp)]
        place = (np.arange(len(cp)) - begin[of]).astype(np.uint8)  # in its word; that of the separator is its length
        # matches by the distance of their end from the begin of the word; those of one end stay together
        distance = place[found[:, 0]]
        by = np.argsort(distance, kind="stable")
        end, piece = found[by, 0], found[by, 1]
        length, value = self.size[piece], self.score[piece]
        last = int(sizes.max(initial=0))
        steps = np.concatenate(([0], np.cumsum(np.bincount(distance, minlength=last + 1)[:last])))
        alone = place < sizes[of]
        alone[end[length == 1]] = False
        alone = np.flatnonzero(alone)  # characters with no piece of their own
        alone = alone[np.argsort(place[alone], kind="stable")]
        alone_steps = np.searchsorted(place[alone], np.arange(last + 1))
        size_of = 1 + (cp[alone] > 0x7F).astype(np.int64) + (cp[alone] > 0x7FF) + (cp[alone] > 0xFFFF)
        # of each place, the best path of its word up to the character before it
        best, pieces = np.full(len(cp) + 1, -np.inf), np.zeros(len(cp) + 1, np.int64)
        best[begin], pieces[begin] = 0.0, 0
        for k in range(len(steps) - 1):
            lo, hi = steps[k], steps[k + 1]
            if lo < hi:
                e = end[lo:hi]
                start = e + 1 - length[lo:hi]
                s = best[start] + value[lo:hi]
                first = np.flatnonzero(np.append(True, e[1:] != e[:-1]))
                most = np.maximum.reduceat(s, first)
                # of equal ones that which starts first
                begins = np.minimum.reduceat(np.where(s == np.repeat(most, np.diff(np.append(first, len(s)))), start, len(cp)), first)
                best[e[first] + 1], pieces[e[first] + 1] = most, pieces[begins] + 1
            lo, hi = alone_steps[k], alone_steps[k + 1]
            if lo < hi:
                e = alone[lo:hi]
                s = best[e] + self.unknown
                better = s > best[e + 1]
                e, s = e[better], s[better]
                best[e + 1], pieces[e + 1] = s, pieces[e] + size_of[lo:hi][better]
        return pieces[begin + sizes], best[begin + sizes]

    def codes(self, words: list[str]) -> np.ndarray:
        """Where each word (without its first mark) is in the table of known words."""
        get = self.known.get
        out = [get(w, -1) for w in words]
        new = list({words[i] for i, c in enumerate(out) if c < 0}) if -1 in out else []
        if new:
            k = len(self.known)
            if k + len(new) > len(self.counts):
                self.counts, self.scores = np.resize(self.counts, 2 * (k + len(new))), np.resize(self.scores, 2 * (k + len(new)))
            short = [w for w in new if len(w) < LONG]
            long = [w for w in new if len(w) >= LONG]
            if short:
                self.counts[k : k + len(short)], self.scores[k : k + len(short)] = self.words([MARK + w for w in short])
            for i, w in enumerate(long):
                self.counts[k + len(short) + i], self.scores[k + len(short) + i] = self.word(MARK + w)
            self.known.update(zip(short + long, range(k, k + len(new)), strict=True))
            out = [get(words[i]) if c < 0 else c for i, c in enumerate(out)]
        return np.array(out, np.int64)

    def count(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces and score of each text."""
        if len(self.known) > CACHE_WORDS:
            self.forget()
        words: list[str] = []
        number = []
        for t in texts:
            own = t.replace(" ", MARK).split(MARK) if t else []
            if "" in own:
                own = [w[1:] for w in re.findall(f"{MARK}+[^{MARK}]*", MARK + MARK.join(own))]
            words += own
            number.append(len(own))
        codes, ends = self.codes(words), np.concatenate(([0], np.cumsum(number, dtype=np.int64)))
        total = np.concatenate(([0], np.cumsum(self.counts[codes])))
        of = np.repeat(np.arange(len(texts)), number)
        return total[ends[1:]] - total[ends[:-1]], np.bincount(of, self.scores[codes], len(texts))


_counters: dict[int, Counter] = {}


def counter(pieces: Pieces) -> Counter:
    key = hash(tuple(pieces))
    if key not in _counters:
        _counters.clear()
        _counters[key] = Counter(pieces)
    return _counters[key]


def counts(docs: DataFrame, pieces: Pieces, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each input row: the id, n_tokens (no start or end token) and score, that of the best path."""
    prepare(docs.sparkSession)
    table = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(table.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            lo, size = 0, 0
            for hi in range(1, len(texts) + 1):
                size += len(texts[hi - 1] or "")
                if size > PART_CHARS or hi == len(texts):
                    n, score = own.count(texts[lo:hi])
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(score, pa.float64())], ["id", "n_tokens", "score"])
                    lo, size = hi, 0

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long, score double").withColumnRenamed("id", id_col)
