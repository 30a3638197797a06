"""Operators on documents against brute force, on odd and repeated rows and on empty tables."""

import hashlib
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from taskloom.llm import bwt, decontam, jaccard, kernel, quality, sharding, sufdedup

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets(rows, k=4):
    out = {}
    for r in rows:
        w = WORDS.findall((r.text or "").translate(LOW))
        out[r.doc_id] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    return out


def groups(found, num, den):
    parent = {i: i for i in found}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in found:
        for b in found:
            if a < b and found[a] and den * len(found[a] & found[b]) >= num * len(found[a] | found[b]):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {i: top(i) for i in found}


@pytest.mark.parametrize(("k", "num", "den"), [(4, 85, 100), (5, 80, 100), (1, 50, 100)])
def test_components(small, k, num, den):
    found = sets(small.collect(), k)
    expected = groups(found, num, den)
    got = jaccard.components(small, k=k, num=num, den=den).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(found[i]), expected[i]) for i in found}


def test_components_with_common_grams(small, monkeypatch):
    monkeypatch.setattr(jaccard, "COMMON", 2)
    found = sets(small.collect())
    expected = groups(found, 85, 100)
    assert {r.doc_id: r.component_id for r in jaccard.components(small).collect()} == expected


def test_components_of_many_near_copies(spark):
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(w if (j * 7 + i * 13) % 190 else f"u{i}" for j, w in enumerate(words))) for i in range(150)] + [(1000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.components(df).collect()} == groups(sets(df.collect()), 85, 100)


def test_components_of_exact_copies_with_a_phrase(spark):
    """Near copies without a common phrase of texts that have it and many exact copies: the order is one for all."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    phrase = min((" ".join(word() for _ in range(4)) for _ in range(300)), key=lambda p: next(jaccard._sets(pa.array([p]), 4))[1][0])
    texts = [" ".join([word(), word(), phrase, word(), word()]) for _ in range(20)]
    for _ in range(8):
        head, tail = (" ".join(word() for _ in range(60)) for _ in range(2))
        texts += [f"{head} {phrase} {tail}"] * 17 + [f"{head} {tail}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in jaccard.components(df).collect()} == groups(sets(df.collect()), 85, 100)


def test_components_without_an_id_and_of_one_id(spark):
    text = lambda k, end="": " ".join(f"w{k}x{i}" for i in range(80)) + end
    rows = [(None, text(1)), (None, text(1, " end")), (None, text(2)), (5, text(2, " end")), (None, text(3)), (7, text(4)), (7, text(5)), (8, text(4, " end")), (6, text(5, " end")), (7, text(5)), (None, "")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    ids = [None, None, 5, 5, None, 7, 6, 7, 6, 6, None]
    assert got == sorted(((i, len(s), c) for (i, _), s, c in zip(rows, [sets([Row(doc_id=0, text=t)])[0] for _, t in rows], ids, strict=True)), key=str)


def test_connected(spark):
    edges = [(i, i + 1) for i in range(30)] + [(50, 40), (41, 50), (7, 7)]
    got = {r.node: r.comp for r in jaccard.connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 31)} | {50: 40, 41: 40}


@pytest.mark.parametrize(("n", "letters", "length"), [(300, 2, 5), (2000, 3, 7), (500, 1, 9), (3000, 4, 20), (12, 2, 3)])
def test_repeated_strings(n, letters, length):
    rng = np.random.default_rng(n)
    for k in range(8):
        text = rng.integers(0, letters, n).astype(np.uint8)
        if k % 2:
            text[n // 2 : n // 2 + n // 4] = text[: n // 4]
        starts = np.flatnonzero(rng.random(n - length + 1) < 0.8)
        data = text.tobytes()
        count = Counter(data[i : i + length] for i in starts)
        assert bwt.repeated(text, starts, length).tolist() == [count[data[i : i + length]] > 1 for i in starts]


def dedup_brute(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        gone = gone[:-1] if len(t) else gone[:0]
        spans = int((gone & ~np.append(False, gone[:-1])).sum()) if len(t) else 0
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("group", "hot"), [(20_000, 10_000), (1, 10_000), (20_000, 3)])
def test_dedup(small, monkeypatch, group, hot):
    monkeypatch.setattr(sufdedup, "GROUP", group)
    monkeypatch.setattr(sufdedup, "HOT", hot)
    rows = small.orderBy("doc_id").collect()
    expected = dedup_brute([(r.text or "").encode() for r in rows], 200)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sufdedup.dedup(small).collect()}
    assert got == {r.doc_id: e for r, e in zip(rows, expected, strict=True)}


def test_dedup_of_repeated_rows(spark):
    text = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(260))
    df = spark.createDataFrame([(1, text), (1, text), (None, text[:220]), (2, "z" * 250)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_removed, r.n_spans) for r in sufdedup.dedup(df).collect())
    assert got == [(0, 220, 1), (1, 260, 1), (1, 260, 1), (2, 250, 1)]


def quality_brute(text):
    t = text or ""
    w = WORDS.findall(t)
    count = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if count[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_quality(small, spark):
    texts = {r.doc_id: r.text for r in small.collect()}
    got = quality.quality(small, carry=("id",)).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got} == {i: quality_brute(t) for i, t in texts.items()}
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) for r in got)
    assert not any(r.kept for r in got if r.base_failed)
    assert sorted(r.doc_id for r in got if r.kept) == sorted(r.doc_id for r in quality.keep(small).collect())
    order = [rule.name for rule, _, _ in quality.plan(small)]
    assert sorted(order) == sorted(rule.name for rule in quality.RULES)


def stats(texts):
    column = pa.array(texts, pa.string())
    found = [c for _, _, c in quality._chunks(pa.RecordBatch.from_arrays([column, column], ["id", "text"]))]
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return [tuple(int(getattr(c, n)[i]) for n in names) for c in found for i in range(len(c.n_words))]


def thue_morse(k):
    out = "a"
    for _ in range(k):
        out += out.translate(str.maketrans("ab", "ba"))
    return out, out.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("k", [8, 10, 11, 12])
def test_lines_and_words_that_collide_in_a_ring(k):
    a, b = thue_morse(k)
    texts = [f"{a}\n{b}", f"{a}\n{b}\n{a}", " ".join([a, *"cdefghi", b, *"cdefghi"]), " ".join([a, *"cdefghi"] * 2)]
    assert stats(texts) == [quality_brute(t) for t in texts]
    assert len({tuple(s) for _, s, _ in jaccard._sets(pa.array([a, b]), 4)}) == 2


def test_equal_hashes_are_compared(small, monkeypatch):
    texts = [r.text for r in small.collect() if len(r.text or "") < 3000] + ["a b\nc d\na b\n\nc e", "a\nb\na\na\nc"]
    expected = [quality_brute(t) for t in texts]
    assert stats(texts) == expected
    monkeypatch.setattr(kernel.Hashes, "of", lambda self, start, end: np.zeros(len(start), np.uint64))
    grams = kernel.grams
    monkeypatch.setattr(kernel, "grams", lambda h, k: np.zeros_like(grams(h, k)))
    assert stats(texts) == expected


def test_order_of_the_cascade(spark):
    """Rules go by rejections per second, and each sees only what those before it have kept."""
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(25 + i % 4))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)

    def slow(rule):
        def reject(c, own):
            time.sleep(0.003 * len(own))
            return rule(c, own)

        return reject

    even, most, none = (lambda c, r: c.n_words[r] % 2 == 0), (lambda c, r: c.n_words[r] != 27), (lambda c, r: np.zeros(len(r), bool))
    rules = (quality.Rule("none", none), quality.Rule("slow_most", slow(most)), quality.Rule("even", even))
    found = quality.plan(docs, rules)
    assert [r.name for r, _, _ in found] == ["even", "slow_most", "none"]
    assert {r.name: round(x, 2) for r, _, x in found} == {"even": 0.5, "slow_most": 0.75, "none": 0.0}
    seen = {}

    def watched(rule):
        def reject(c, own):
            seen.setdefault(rule.name, []).append(len(own))
            return rule.reject(c, own)

        return quality.Rule(rule.name, reject)

    column = pa.array([t for _, t in rows])
    for _, _, c in quality._chunks(pa.RecordBatch.from_arrays([column, column], ["id", "text"])):
        assert int(quality._verdict(c, [watched(r) for r, _, _ in found]).sum()) == 20
    assert {n: sum(v) for n, v in seen.items()} == {"even": 80, "slow_most": 40, "none": 20}
    assert {r.doc_id for r in quality.quality(docs, rules).where("kept").collect()} == {i for i in range(80) if i % 4 == 2}
    assert [r.name for r, _, _ in quality.plan(docs.limit(0), rules)] == ["none", "slow_most", "even"]


def test_rules_reject_by_themselves(spark):
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(0, good), (1, good.replace(" ", " # ")), (2, " ".join("abcdefghijklmnopqrstuvwxyz" + str(i) for i in range(40))), (3, " ".join(str(1000 + i) for i in range(40))), (4, "\n".join(f"line number {i % 3} of it" for i in range(8)))]
    got = {r.doc_id: r.kept for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: True, 1: False, 2: False, 3: False, 4: False}


def contamination_brute(rows, items):
    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    words = lambda t: pattern.findall((t or "").translate(LOW))
    wins = defaultdict(set)
    for r in items:
        w = words(r.text)
        n = min(8, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            wins[tuple(w[i : i + n])].add(str(r.item_id))
    sizes = {len(k) for k in wins}
    out = {}
    for r in rows:
        w, hit, found = words(r.text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in wins:
                    hit |= set(range(i, i + n))
                    found |= wins[tuple(w[i : i + n])]
        out[r.doc_id] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2)
    return out


@pytest.mark.parametrize("block", [250_000, 40])
def test_decontamination(small, spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK", block)
    rows = small.collect()
    by = {r.doc_id: r.text for r in rows}
    some = by[40].split(" ")
    items = [(1, by[16]), (2, " ".join(some[5:16])), (3, " ".join(some[2:5])), (4, None), (5, ""), (10, by[16]), (6, "A b"), (7, "É é"), (8, "ab")]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.contamination(small, bench).collect()}
    assert got == contamination_brute(rows, bench.collect())
    assert sum(g[1] > 0 for g in got.values()) >= 5


def test_decontamination_starts_no_python_workers(spark, monkeypatch):
    item = " ".join(f"word{i}" for i in range(9))
    docs = spark.createDataFrame([(1, f"a {item} b"), (2, None)], "doc_id long, text string").localCheckpoint()
    bench = spark.createDataFrame([(1, item), (2, "b")], "item_id long, text string").localCheckpoint()
    # rows from Python go through Python workers, which stay on the executors
    monkeypatch.setattr(type(spark), "createDataFrame", None)
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontam.contamination(docs, bench).collect()}
    assert got == {1: (11, 10, 2, True), 2: (0, 0, 0, False)}


def test_decontamination_of_a_long_text(spark):
    """A document of a million words takes about as long as the same words in short documents."""
    rng = random.Random(4)
    words = [f"w{rng.randrange(5000)}" for _ in range(1_000_000)]
    bench = spark.createDataFrame([(1, " ".join(words[999_900:999_940])), (2, " ".join(words[10:18])), (3, "w1 w2 w3")], "item_id long, text string")
    taken = []
    for texts in ([" ".join(words[i : i + 1000]) for i in range(0, len(words), 1000)], [" ".join(words)]):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
        began = time.time()
        rows = decontam.contamination(docs, bench).collect()
        taken.append(time.time() - began)
        assert sum(r.n_hit for r in rows) >= 48
        assert sum(r.n_words for r in rows) == 1_000_000
    assert taken[1] < 3 * taken[0] + 10


def test_shards(small, spark, tmp_path):
    rows = small.union(small.where("doc_id < 20")).union(small.where("doc_id = 3"))
    got = sharding.assign(rows, 3000).collect()
    assert len(got) == rows.count()
    size, number = Counter(), Counter()
    for r in got:
        size[r.shard] += r.n_bytes
        number[r.shard] += 1
        assert len(r.shard) == r.depth
    assert all(size[s] <= 3000 or number[s] == 1 for s in size)
    names = sorted(size)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:], strict=False) if a != b)
    # a bucket was split only if it was over the limit
    for s in names:
        if s:
            above = [x for x in names if x.startswith(s[:-1])]
            assert sum(size[x] for x in above) > 3000
    more = rows.union(spark.createDataFrame([(None, "a b", "en", "x", "y")] * 2 + [(None, None, None, None, None), (1, "one", "", "", ""), (1, "two", "", "", "")], rows.schema))
    sharding.write(more, str(tmp_path / "out"), 3000)
    back = spark.read.option("basePath", str(tmp_path / "out")).parquet(str(tmp_path / "out")).selectExpr("*", "octet_length(coalesce(text, '')) n")
    assert sorted(back.select(more.columns).collect(), key=str) == sorted(more.collect(), key=str)
    shards = {r["shard"]: (r["b"], r["k"]) for r in back.groupBy("shard").agg(F.sum("n").alias("b"), F.count("*").alias("k")).collect()}
    assert all(b <= 3000 or k == 1 for b, k in shards.values())
    by = Counter(r.shard for r in sharding.assign(more, 3000).collect())
    assert {f"b{s}": k for s, k in by.items()} == {s: k for s, (_, k) in shards.items()}


def test_one_hot_row_is_spread(spark):
    df = spark.range(400).select(F.lit(7).cast("long").alias("doc_id"), F.lit("abcd" * 25).alias("text"))
    got = sharding.assign(df, 1000).groupBy("shard").agg(F.sum("n_bytes").alias("b")).collect()
    assert len(got) > 40
    assert max(r.b for r in got) <= 1000


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, id string")
    bench = spark.createDataFrame([], "item_id long, text string")
    for out in (jaccard.components(empty), sufdedup.dedup(empty), quality.quality(empty), quality.keep(empty), decontam.contamination(empty, bench), sharding.assign(empty, 100)):
        assert out.count() == 0
    one = spark.createDataFrame([(1, "a b c d e f g h i")], "doc_id long, text string")
    assert decontam.contamination(one, bench).first().n_hit == 0
