"""Encoding and decoding with a SentencePiece BPE model: vectorised merge rounds in numpy.

The text is cut before each white-space mark that follows something else, as no piece of the model has a mark after
another character, and between two characters that no piece has next to each other; merges never cross these cuts.
Distinct words of a batch are encoded together: flat arrays of symbols, the least rank of a pair in each part's
segment, the leftmost such pair of every part merged at once, and the arrays compacted, until no part has a pair.
Where no pair with the merged piece can have a lower rank, the other places of the same pair in the part are merged in
the same round; the order in which the library merges gives the same.

Parts of more than LONG symbols have their rounds by themselves: the places of each rank are kept in lists, so a round
touches the places of the least rank and their neighbours only and a part of n symbols takes about n log n steps. All
places of the rank are merged at once up to the first whose new neighbours have a rank that goes before the rest.
What isn't in the vocabulary falls back to bytes.

Models must be BPE with byte fallback, the identity normaliser, a dummy prefix and kept white space, and have
no user-defined or unused pieces; others are refused.

A Python worker outlives its task, beside the tasks of other stages. So the words that a task remembers go when it ends,
and what the worker has free goes back to the system.

Null is an empty text. Texts of any length are encoded whole. Repeated rows have a row each. Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskloom.llm.common import give_back, prepare, ragged

MARK = "▁"
#: Words that a task remembers (some 35 MB), and their symbols; beyond it starts anew.
CACHE_WORDS, CACHE_IDS = 200_000, 2_000_000
#: Characters of text that are encoded together. Arrays of the rounds and of the digests take some 80 bytes of each.
PART_CHARS = 1 << 17
#: Symbols of a part whose rounds run over the whole array at most.
LONG = 256
_INF = np.iinfo(np.int64).max


class Model:
    """Tables of a model. Symbols are piece ids; a character that is no piece has the id size + code point."""

    def __init__(self, proto: bytes) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = self.size = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) for i in range(n)]
        self.is_byte = np.array([sp.is_byte(i) for i in range(n)])
        normal = [i for i in range(n) if not special[i] and not self.is_byte[i]]
        self.end = sp.eos_id()
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        if self.is_byte.sum() != 256 or any(sp.is_unused(i) for i in normal) or sp.encode(" Å ") != sp.encode(" Å ", enable_sampling=False):
            raise ValueError("a BPE model with byte fallback is needed")
        if sp.decode(sp.encode("  a　ﬁ  b ")) != "  a　ﬁ  b " or any(re.search(f"[^{MARK}]{MARK}", pieces[i]) for i in normal):
            raise ValueError("the model changes white space or characters, or has pieces of several words")
        ids = {pieces[i]: i for i in normal}
        self.char_ids = {p: i for p, i in ids.items() if len(p) == 1}
        symbol = lambda s: ids.get(s, n + ord(s) if len(s) == 1 else None)
        ranks = np.unique([-sp.get_score(i) for i in normal], return_inverse=True)[1]
        rank = dict(zip(normal, ranks.tolist(), strict=True))
        pairs = {}
        for i in normal:
            p = pieces[i]
            for k in range(1, len(p)):
                a, b = symbol(p[:k]), symbol(p[k:])
                if a is not None and b is not None:
                    pairs[(a, b)] = i
        self.width = n + 0x110000
        key = np.array([a * self.width + b for a, b in pairs], np.int64)
        by = np.argsort(key)
        self.keys = np.append(key[by], _INF)
        self.merged = np.append(np.array(list(pairs.values()))[by], 0)
        self.pair_rank = np.append(np.array([rank[i] for i in pairs.values()])[by], _INF)
        alone = {i for (a, b), z in pairs.items() for i in (a, b) if rank[z] <= rank.get(i, -1)}
        self.safe = np.array([i not in alone for i in range(n)])
        self.inside = np.array(sorted({ord(a) * 0x110000 + ord(b) for i in normal for a, b in zip(pieces[i], pieces[i][1:])}) + [_INF], np.int64)  # noqa: B905
        cps = np.array(sorted(ord(c) for c in self.char_ids), np.int64)
        self.cps, self.cp_ids = np.append(cps, _INF), np.append([self.char_ids[chr(c)] for c in cps], 0)
        plain = [b"" if sp.is_control(i) else " \u2047 ".encode() if sp.is_unknown(i) else bytes([int(p[3:5], 16)]) if self.is_byte[i] else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.plain, self.plain_at, self.plain_size = _flat(plain)
        self.digits, self.digits_at, self.digits_size = _flat([b"%d " % i for i in range(n)])
        self.marked = np.array([not special[i] and p.startswith(MARK) for i, p in enumerate(pieces)])
        self.special = np.array([sp.is_control(i) for i in range(n)])
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.at, self.used = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), 0

    def pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of neighbouring symbols; the rank is infinite if they don't merge."""
        key = a * self.width + b
        i = np.searchsorted(self.keys, key)
        hit = self.keys[i] == key
        return np.where(hit, self.pair_rank[i], _INF), self.merged[i]

    def merge_long(self, sym: np.ndarray) -> np.ndarray:
        """The symbols of one part when nothing merges any more."""
        n = len(sym)
        sym = np.append(sym, -1)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        rank, piece = np.full(n + 1, _INF), np.zeros(n + 1, np.int64)
        rank[: n - 1], piece[: n - 1] = self.pair(sym[: n - 1], sym[1:n])
        places: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def add(at: np.ndarray) -> None:
            own = rank[at]
            by = np.argsort(own, kind="stable")
            at, own = at[by], own[by]
            cuts = np.flatnonzero(own[1:] != own[:-1]) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)], strict=True):
                if lo < hi and own[lo] < _INF:
                    r = int(own[lo])
                    if r not in places:
                        places[r] = []
                        heapq.heappush(ranks, r)
                    places[r].append(at[lo:hi])

        add(np.arange(n - 1))
        while ranks:
            r = heapq.heappop(ranks)
            at = np.concatenate(places.pop(r))
            at = np.unique(at[rank[at] == r])
            if not len(at):
                continue
            # of places that share a symbol the leftmost goes first
            index = np.arange(len(at))
            begin = np.append(True, at[1:] != after[at[:-1]])
            p = at[(index - np.maximum.accumulate(np.where(begin, index, 0))) % 2 == 0]
            q, z = after[p], piece[p]
            left, right = before[p], after[q]
            # the neighbours when it is a place's turn: the one before is merged by then, the one after isn't
            ls = np.where(left >= 0, sym[left], -1)
            beside = np.append(False, left[1:] == q[:-1])
            ls[beside] = z[:-1][beside[1:]]
            first = (self.pair(np.maximum(ls, 0), z)[0] <= r) & (ls >= 0)
            first |= (right < n) & (self.pair(z, np.maximum(sym[right], 0))[0] <= r)
            if first.any():
                stop = int(np.argmax(first))
                rest = at[at > p[stop]]
                p, q, z, right = p[: stop + 1], q[: stop + 1], z[: stop + 1], right[: stop + 1]
            else:
                rest = at[:0]
            sym[p], sym[q], rank[q] = z, -1, _INF
            after[p] = right
            before[right] = p
            touched = np.concatenate([before[p], p])
            touched = touched[touched >= 0]
            last = after[touched] >= n
            rank[touched[last]] = _INF
            touched = touched[~last]
            rank[touched], piece[touched] = self.pair(sym[touched], sym[after[touched]])
            add(np.concatenate([touched, rest]))
        return sym[:n][sym[:n] >= 0]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and each word's number of ids."""
        count = np.array([len(w) for w in words], np.int64)
        cp = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        i = np.searchsorted(self.cps, cp)
        sym = np.where(self.cps[i] == cp, self.cp_ids[i], self.size + cp)
        word = np.repeat(np.arange(len(words)), count)
        pairs = cp[:-1] * 0x110000 + cp[1:]
        new = np.ones(len(cp), bool)
        new[1:] = (word[1:] != word[:-1]) | (self.inside[np.searchsorted(self.inside, pairs)] != pairs)
        part = np.cumsum(new) - 1
        of = word[new]  # the word of each part
        done_sym, done_part = [], []
        sizes = np.bincount(part, minlength=len(of))
        for d in np.flatnonzero(sizes > LONG).tolist():
            lo = int(np.searchsorted(part, d))
            done_sym.append(self.merge_long(sym[lo : lo + int(sizes[d])]))
            done_part.append(np.full(len(done_sym[-1]), d))
        if done_sym:
            short = sizes[part] <= LONG
            sym, part = sym[short], part[short]
        rank, piece = np.full(len(sym), _INF), np.zeros(len(sym), np.int64)
        inner = np.flatnonzero(part[1:] == part[:-1])
        rank[inner], piece[inner] = self.pair(sym[inner], sym[inner + 1])
        while len(sym):
            begin = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            least = np.minimum.reduceat(rank, begin)
            sizes = np.diff(np.append(begin, len(sym)))
            over = np.repeat(least == _INF, sizes)
            if over.any():
                done_sym.append(sym[over])
                done_part.append(part[over])
                keep = ~over
                sym, part, rank, piece = sym[keep], part[keep], rank[keep], piece[keep]
                sizes, least = sizes[least != _INF], least[least != _INF]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(least, sizes))
            own = part[at]
            first = np.append(True, own[1:] != own[:-1])
            # a b a b: all leftmost places that don't overlap; of others only the first of the part
            run = first | np.append(True, at[1:] != at[:-1] + 1)
            offset = np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            same = piece[at] == piece[at[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]]
            mixed = np.zeros(len(of), bool)
            mixed[own[~same]] = True
            at = at[first | (self.safe[piece[at]] & (offset % 2 == 0) & ~mixed[own])]
            sym[at] = piece[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            at = place[at]
            sym, part, rank, piece = sym[keep], part[keep], rank[keep], piece[keep]
            for left in (at, at[at > 0] - 1):
                both = (left + 1 < len(sym)) & (part[np.minimum(left + 1, len(sym) - 1)] == part[left])
                rank[left[~both]] = _INF
                left = left[both]
                rank[left], piece[left] = self.pair(sym[left], sym[left + 1])
        sym, part = np.concatenate(done_sym or [sym]), np.concatenate(done_part or [part])
        by = np.argsort(part, kind="stable")
        sym, word = sym[by], of[part[by]]
        lost = np.flatnonzero(sym >= self.size)
        if len(lost):
            raw = [chr(c - self.size).encode("utf-8", "surrogatepass") for c in sym[lost].tolist()]
            times = np.ones(len(sym), np.int64)
            times[lost] = [len(r) for r in raw]
            where = ragged(np.cumsum(times)[lost] - times[lost], times[lost])
            sym, word = np.repeat(sym, times), np.repeat(word, times)
            sym[where] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        return sym, np.bincount(word, minlength=len(words))

    def codes(self, words: list[str]) -> np.ndarray:
        """Where each word (without its first mark) is in the table of known words."""
        get = self.known.get
        out = [get(w, -1) for w in words]
        new = list({words[i] for i, c in enumerate(out) if c < 0}) if -1 in out else []
        if new:
            ids, count = self.encode_words([MARK + w for w in new])
            k = len(self.known)
            if self.used + len(ids) > len(self.ids):
                self.ids = np.resize(self.ids, 2 * (self.used + len(ids)))
            if k + len(new) + 1 > len(self.at):
                self.at = np.resize(self.at, 2 * (k + len(new) + 1))
            self.ids[self.used : self.used + len(ids)] = ids
            self.at[k + 1 : k + len(new) + 1] = self.used + np.cumsum(count)
            self.used += len(ids)
            self.known.update(zip(new, range(k, k + len(new)), strict=True))
            out = [get(words[i]) if c < 0 else c for i, c in enumerate(out)]
        return np.array(out, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, each with the end id, and their numbers."""
        if len(self.known) > CACHE_WORDS or self.used > CACHE_IDS:
            self.forget()
        words: list[str] = []
        number = []
        for t in texts:
            own = t.replace(" ", MARK).split(MARK) if t else []
            if "" in own:
                own = [w[1:] for w in re.findall(f"{MARK}+[^{MARK}]*", MARK + MARK.join(own))]
            words += own
            number.append(len(own))
        codes = self.codes(words)
        sizes = self.at[codes + 1] - self.at[codes]
        ids = self.ids[ragged(self.at[codes], sizes)]
        ends = np.concatenate(([0], np.cumsum(sizes)))[np.cumsum(number, dtype=np.int64)]
        return np.insert(ids, ends, self.end), np.diff(np.concatenate(([0], ends))) + 1

    def decode(self, ids: np.ndarray, count: np.ndarray) -> list[str]:
        """The texts of the ids of ``count[0]`` places, of the next ``count[1]``, and so on."""
        size = self.plain_size[ids]
        data = self.plain[ragged(self.plain_at[ids], size)].tobytes()
        ends = np.concatenate(([0], np.cumsum(size)))
        out, at = [], 0
        for n in count.tolist():
            own, a, b = ids[at : at + n], ends[at], ends[at + n]
            first = own[~self.special[own]][:1] if n and self.special[own[0]] else own[:1]
            if len(first) and self.marked[first[0]]:
                a += 1
            try:
                out.append(data[a:b].decode())
            except UnicodeDecodeError:
                out.append(_lenient(data[a:b]))
            at += n
        return out

    def digests(self, ids: np.ndarray, count: np.ndarray) -> list[str]:
        """SHA-256 of the decimal ids with one space between."""
        size = self.digits_size[ids]
        data = memoryview(self.digits[ragged(self.digits_at[ids], size)].tobytes())
        ends = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(count)))]
        return [hashlib.sha256(data[a : max(a, b - 1)]).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _flat(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.array([len(p) for p in parts], np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(size) - size, size


def _lenient(data: bytes) -> str:
    """UTF-8 with a replacement character for each byte that is in no valid sequence."""
    out = []
    while data:
        try:
            out.append(data.decode())
            break
        except UnicodeDecodeError as e:
            out.append(data[: e.start].decode() + "�")
            data = data[e.start + 1 :]
    return "".join(out)


_models: dict[bytes, Model] = {}


def _model(proto: bytes) -> Model:
    key = hashlib.sha256(proto).digest()
    if key not in _models:
        _models.clear()
        _models[key] = Model(proto)
    return _models[key]


def parts(texts: list[str]) -> Iterator[tuple[int, int]]:
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size > PART_CHARS:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, with_decoded: bool = True) -> DataFrame:
    """A row for each input row: the id, n_tokens, ids_sha256, decoded_sha256, and decoded (the text of the ids) unless it isn't asked for.

    With ``with_ids`` also ids. The model file is read by the driver and sent to the executors (under 1 MB).
    """
    prepare(docs.sparkSession)
    with open(model_path, "rb") as f:
        proto = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(proto.value)
        try:
            yield from encoded(model, batches)
        finally:
            model.forget()
            give_back()

    def encoded(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column(1).to_pylist()
            for lo, hi in parts(whole):
                ids, count = model.encode(whole[lo:hi])
                decoded = model.decode(ids, count)
                columns = {"id": batch.column(0).slice(lo, hi - lo), "n_tokens": pa.array(count), "ids_sha256": pa.array(model.digests(ids, count))}
                columns["decoded_sha256"] = pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded])
                if with_decoded:
                    columns["decoded"] = pa.array(decoded, pa.string())
                if with_ids:
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_pydict(columns)

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", decoded string" * with_decoded + ", ids array<int>" * with_ids
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The id and text of each row's ids. Null ids are an empty text."""
    prepare(tokens.sparkSession)
    with open(model_path, "rb") as f:
        proto = tokens.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(proto.value)
        for batch in batches:
            rows = [np.array(x or [], np.int32) for x in batch.column(1).to_pylist()]
            out = model.decode(np.concatenate([*rows, np.zeros(0, np.int32)]), np.array([len(r) for r in rows]))
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "text": pa.array(out, pa.string())})

    rows = tokens.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)
