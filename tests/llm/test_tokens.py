"""Tokenizers, pages, urls and conversations against the libraries and brute force."""

import hashlib
import random
import re
import time
import tracemalloc
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from taskloom.llm import chat, html, spbpe, unigram, urlrules
from taskloom.llm.queries import tokenizer_path

PATH = tokenizer_path()
BITS = ["a", "b", "th", "e", " ", "  ", "▁", "é", "日", "\n", "\t", "\x00", "ing", "☃", "🙂", "o", "and", "▁▁", "In"]


def random_texts(n, size, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randrange(size))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_bpe_equals_the_library(library):
    model = spbpe.Model(open(PATH, "rb").read())
    rng = random.Random(1)
    pieces = [library.id_to_piece(i).replace("▁", " ") for i in range(300, 32000)]
    texts = random_texts(800, 60, 4) + ["".join(rng.choice(pieces) for _ in range(30)) for _ in range(400)] + ["a" * 3000, "ab" * 2000, " " * 500, ""]
    ids, count = model.encode(texts)
    ends = np.concatenate(([0], np.cumsum(count)))
    for i, t in enumerate(texts):
        assert ids[ends[i] : ends[i + 1]].tolist() == library.encode(t, add_eos=True)
    assert model.decode(ids, count) == [library.decode(library.encode(t, add_eos=True)) for t in texts]
    odd = [[rng.randrange(32000) if rng.random() < 0.5 else rng.randrange(259) for _ in range(rng.randrange(12))] for _ in range(600)]
    assert model.decode(np.array(sum(odd, []), np.int32), np.array([len(x) for x in odd])) == [library.decode(x) for x in odd]


@pytest.mark.parametrize("long", [2, 5, 256])
def test_long_words_equal_the_library(library, monkeypatch, long):
    monkeypatch.setattr(spbpe, "LONG", long)
    model = spbpe.Model(open(PATH, "rb").read())
    rng = random.Random(long)
    pieces = [library.id_to_piece(i).replace("▁", "") for i in range(300, 32000)]
    some = [[rng.choice(pieces[: rng.choice([20, 200, 5000])]) for _ in range(rng.randrange(100, 300))] for _ in range(150)]
    texts = ["".join(s) for s in some] + random_texts(300, 60, long) + ["a" * 3001, "aab" * 700, "the" * 500 + "ing" * 500, "日本語" * 500, "x" + "é" * 999]
    ids, count = model.encode(texts)
    ends = np.concatenate(([0], np.cumsum(count)))
    for i, t in enumerate(texts):
        assert ids[ends[i] : ends[i + 1]].tolist() == library.encode(t, add_eos=True)


def test_a_word_of_a_megabyte(library):
    rng = random.Random(2)
    model = spbpe.Model(open(PATH, "rb").read())
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"
    for text in ("".join(rng.choice(letters) for _ in range(1_000_000)), "".join(rng.choice("etaoinsr") for _ in range(1_000_000))):
        began = time.time()
        ids, _ = model.encode([text])
        assert time.time() - began < 60
        assert ids.tolist() == library.encode(text, add_eos=True)


def test_encode_and_decode_tables(small, spark, library, monkeypatch):
    out = spbpe.encode(small, PATH, with_ids=True)
    texts = {r.doc_id: r.text or "" for r in small.collect()}
    rows = out.collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_eos=True)
        assert (r.n_tokens, r.ids) == (len(ids), ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert {r.doc_id: r.text for r in spbpe.decode(out, PATH).collect()} == {i: library.decode(library.encode(t)) for i, t in texts.items()}
    assert spbpe.encode(small.limit(0), PATH).count() == 0
    assert spbpe.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), PATH).first().text == ""


def test_unigram_counts(small):
    from tokenizers import Tokenizer, models

    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    n = sp.get_piece_size()
    own = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)) for i in range(n)]
    low = min(sp.get_score(i) for i in range(n) if own[i])
    library = Tokenizer(models.Unigram([(sp.id_to_piece(i), sp.get_score(i) if own[i] else low) for i in range(n)], unk_id=0, byte_fallback=True))
    counter = unigram.Counter(unigram.vocabulary(PATH))
    expected = lambda t: len(library.encode("▁" + t.replace(" ", "▁")).ids) if t else 0
    some = random_texts(800, 40, 6) + ["x" * 200, "th" * 90 + " é" * 80, "日" * 100]
    assert counter.count(some)[0].tolist() == [expected(t) for t in some]
    texts = {r.doc_id: r.text for r in small.collect()}
    assert {r.doc_id: r.n_tokens for r in unigram.counts(small, unigram.vocabulary(PATH)).collect()} == {i: expected(t) for i, t in texts.items()}
    assert unigram.counts(small.limit(0), unigram.vocabulary(PATH)).count() == 0


@pytest.mark.parametrize("long", [0, 8, 64])
def test_unigram_ties(monkeypatch, long):
    """Scores that tie nearly everywhere: counts and scores are those of the tokenizer, short words and long ones alike."""
    from tokenizers import Tokenizer, models

    monkeypatch.setattr(unigram, "LONG", long)
    rng = random.Random(long)
    for _ in range(6):
        names = {"▁", *"abc"} | {"".join(rng.choice("abc") for _ in range(rng.randrange(2, 5))) for _ in range(12)} | {"▁" + "".join(rng.choice("abc") for _ in range(rng.randrange(1, 3))) for _ in range(4)}
        pieces = [(p, -float(len(p) if rng.random() < 0.8 else rng.randrange(1, 4))) for p in sorted(names)]
        library = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces], unk_id=0, byte_fallback=False))
        texts = [" ".join("".join(rng.choice("abc") for _ in range(rng.randrange(0, 14))) for _ in range(rng.randrange(1, 6))) for _ in range(150)]
        got = unigram.Counter(pieces).count(texts)
        for i, t in enumerate(texts):
            tokens = library.encode("▁" + t.replace(" ", "▁")).tokens if t else []
            assert (got[0][i], got[1][i]) == (len(tokens), sum(dict(pieces)[x] for x in tokens))


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body class="page">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies.</div>
<main><article><h1>Head &amp; line</h1><p>One   short.</p><p>The cat and the dog of the house
are in the garden with a ball that was for them.<br>Next</p><p>caf&eacute; &#9731; a &lt; b</p>
<aside>See also</aside><p><a href="/x">All of this paragraph is one long link to some other page, again and again</a></p><p>Last.</p></article></main>
<section id="comments"><p>I think that the text is good and that it is of the kind I like to read in the morning.</p></section>
<form><p>Your name</p></form><footer>&copy; me</footer></body></html>"""


def test_main_text():
    assert html.main_text(PAGE) == "Head & line\nOne short.\nThe cat and the dog of the house are in the garden with a ball that was for them. Next\ncafé ☃ a < b\nAll of this paragraph is one long link to some other page, again and again\nLast."
    body = "The cat and the dog of the house are in the garden with a ball that was for them. "
    assert html.main_text(f"<p>Head</p><div><p>{body}</p><p>Short</p><p>{body}</p></div><p>{'xyzzy ' * 30}</p><p>End</p>") == f"Head\n{body}\nShort\n{body}".replace(" \n", "\n").strip()
    for broken in (None, "", "plain", "<", "<p", "<!--", "<script>x", "</p></div>", "<a><b><i>", "&", "<div class='a>", "<p>a<", "<article><p>cut &am"):
        html.main_text(broken)
    assert html.main_text("<article><p>cut &am") == "cut &am"


@pytest.mark.parametrize("tag", ['<svg-icon name="x"></svg-icon>', '<svg class="i"/>', "<svg />", "<svg/>", "<template-x>", "<style-guide></style-guide>", '<SVG title="a > b"/>', "<svg><text>no</text></svg>", "<script-x/>"])
def test_text_after_custom_and_empty_elements(tag):
    assert html.main_text(f"<article><p>one</p>{tag}<p>two</p></article>") == "one\ntwo"


@pytest.mark.parametrize(
    "paragraphs",
    [
        ["Вчера вечером в городском саду открылась выставка старинных часов, на которую пришли сотни жителей.", "Коротко.", "Каждый экспонат сопровождается рассказом мастера, который много лет собирал эту коллекцию."],
        ["昨天晚上，城市花园里举办了一场古董钟表展览，吸引了数百名市民前来参观。", "每件展品都附有收藏家的介绍。"],
        ["Wczoraj otwarto wystawę.", "Przyszło wielu gości!"],
        ["We met.", "It rained all day."],
    ],
)
def test_main_text_of_pages_without_an_article(paragraphs):
    nav = "<nav><a href='/'>Home</a></nav><div><a href='/a'>Вчера вечером в городском саду открылась выставка старинных часов и картин.</a></div>"
    page = f"<body>{nav}{''.join(f'<div>{p}</div>' for p in paragraphs)}<footer>© 2020.</footer></body>"
    assert html.main_text(page) == "\n".join(paragraphs)


RUSSIAN = "Вчера вечером в городском саду открылась выставка старинных часов, на которую пришли сотни жителей."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<article><p>{RUSSIAN}</p><p><a href='/x'>Ещё об этом</a></p><p>Конец.</p></article>", f"{RUSSIAN}\nЕщё об этом\nКонец."),
        (f"<div><p>{RUSSIAN}</p></div><p>The cat and the dog of the house are in the garden with a ball that was for them.</p>", f"{RUSSIAN}\nThe cat and the dog of the house are in the garden with a ball that was for them."),
        ('<div class="site has-sidebar"><article><p>one</p><p>two</p></article></div>', "one\ntwo"),
        ('<article><div class="post no-ads"><p>one</p></div><div class="ad-slot"><p>buy</p></div></article>', "one"),
        ('<div class="layout sidebar"><main><p>one</p><ul><li><a href="/">menu</a></li></ul><ul><li>entry</li></ul></main></div>', "one\nentry"),
        ('<article><p>one</p></article><section id="comments"><article><p>I liked it, and it is the one of all that I have.</p></article></section>', "one"),
        ('<section class="comments"><article><p>I liked it.</p></article></section>', ""),
        ('<div class="sidebar"><p>The cat and the dog of the house are in the garden with a ball that was for them.</p></div>', ""),
    ],
)
def test_places_and_languages(page, text):
    assert html.main_text(page) == text


def test_long_broken_pages():
    began = time.time()
    for page in ("<div>" * 50_000 + "</span>" * 50_000, "<p>a</b></i>" * 50_000, '<a ">' * 50_001, "<ul><li>" * 30_000 + "x"):
        html.main_text(page)
    assert time.time() - began < 20


class Article(HTMLParser):
    """The text of an article's blocks, another way."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.inside, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        self.edge(tag)

    def handle_endtag(self, tag):
        self.edge(tag)
        self.inside &= tag != "article"

    def edge(self, tag):
        if tag in ("p", "h1", "article"):
            self.blocks.append("")
        elif tag == "br":
            self.blocks[-1] += " "

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data

    def handle_entityref(self, name):
        self.handle_data(f"&{name};")

    def text(self, page):
        # a cut-off reference has no semicolon: it is decoded as the library does without the parser's help
        self.feed(re.sub("&(?!\\w+;)", "&amp;", page))
        return "\n".join(t for t in (" ".join(unescape(unescape(b) if "&amp;" in b else b).split()) for b in self.blocks) if t)


def test_all_small_pages_against_a_parser(spark):
    rows = html.extract(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    assert len(rows) == len(pages) > 0
    for r in rows:
        assert (r.text, r.n_chars) == (Article().text(pages[r.page_id]), len(r.text))


def test_pages_keep_their_rows(spark):
    df = spark.createDataFrame([(1, None, None, 5), (1, "u", PAGE, 6), (1, "u", PAGE, 6)], "page_id long, url string, html string, text int")
    got = html.extract(df).collect()
    assert sorted(r.n_chars for r in got) == [0, len(html.main_text(PAGE)), len(html.main_text(PAGE))]
    assert html.extract(df.limit(0)).count() == 0


def url_brute(url, rules, default):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:end])
    path = rest[end:]
    path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    fits = [(len(h) + len(p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, default))
    return host, path, best[2], best[3]


def test_url_rules(spark, monkeypatch):
    rng = random.Random(9)
    label = ["a", "b", "net", "org", "example", "COM", "é"]
    urls = [None, "", "no scheme", "http://", "https://net", "http://net/", "http://x.net?q=/en/", "a://b://net/c", "http://example.net./en/", "http://u@example.net:80/en/", "http://\x01/"]
    urls += [f"http{rng.choice(['', 's'])}://{'.'.join(rng.choice(label) for _ in range(rng.randrange(1, 5)))}{rng.choice(['', '/', '/en', '/en/1?x#y', '/fr/', '/de/../', '#z', '?q'])}" for _ in range(400)]
    rules = urlrules.RULES + [("block", "b.net", "/en"), ("allow", "a.b.net", "/"), ("block", "com", "/de/"), ("allow", "example.com", "/")]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({"host": F.lit(1), "rule": F.lit(2)})
    expected = {i: url_brute(u, rules, "allow") for i, u in enumerate(urls)}
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlrules.judge(df, rules).collect()} == expected
    monkeypatch.setattr(urlrules, "RULES_AT_ONCE", 3)
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlrules.judge(df, rules).collect()} == expected
    assert urlrules.judge(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="path"):
        urlrules.judge(df, [("block", "net", "en")])


def test_bpe_memory_of_a_worker(spark):
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("abcdefghij") for _ in range(9)) for _ in range(200)) for _ in range(1500)]
    model = spbpe.Model(open(PATH, "rb").read())
    tracemalloc.start()
    try:
        for lo, hi in spbpe.parts(texts):
            ids, count = model.encode(texts[lo:hi])
            model.decode(ids, count)
            model.digests(ids, count)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 70e6

    # what a worker still has of a task that has ended
    docs = spark.createDataFrame(list(enumerate(texts[:40])), "doc_id long, text string").repartition(4)
    assert spbpe.encode(docs, PATH).agg(F.sum("n_tokens")).first()[0] > 8000

    def left(batches):
        import time

        from taskloom.llm import spbpe

        for batch in batches:
            time.sleep(0.5)  # so that all workers take part
            yield pa.RecordBatch.from_pydict({"models": [len(spbpe._models)], "words": [sum(len(m.known) for m in spbpe._models.values())]})

    rows = spark.range(0, 16, 1, 16).mapInArrow(left, "models long, words long").collect()
    assert any(r.models for r in rows) and not any(r.words for r in rows)


def test_preferences(spark):
    rows = [
        (0, 0, "system", "be kind"), (0, 1, "user", "hi"), (0, 2, "assistant", "yes"), (0, 2, "assistant", "yes"), (0, 3, "user", "ok"),
        (1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "no é"),
        (2, 0, "user", None), (2, 1, "assistant", "a"), (4, 0, "user", "x"), (5, 0, "user", "x"),
    ] + [(k, t, "user", f"t{t}" if k == 6 or t != 700 else "other") for k in (6, 7) for t in range(1000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("pair_id", F.lit("x"))
    whole = {r.pair_id: r for r in chat.preferences(df, F.expr("conv_id div 2"), F.col("conv_id") % 2 == 0).collect()}
    got = {(r.pair_id, r.block): r for r in chat.preferences(df, F.expr("conv_id div 2"), F.col("conv_id") % 2 == 0, block=256).collect()}
    assert sorted(whole) == [0, 1, 2, 3]
    for pair in range(3):
        assert whole[pair].asDict() == {k: v for k, v in got[(pair, 0)].asDict().items() if k != "block"}
    for part in ("prompt", "chosen", "rejected"):
        assert whole[3][part] == "".join(got[(3, k)][part] for k in range(4))
    one = got[(0, 0)]
    assert one.prompt == "<|system|>\nbe kind<|end|>\n<|user|>\nhi<|end|>\n"
    assert one.chosen == "<|assistant|>\nyes<|end|>\n<|user|>\nok<|end|>\n"
    assert one.rejected == "<|assistant|>\nno é<|end|>\n"
    assert (one.prompt_turns, one.differ) == (2, True)
    a, b = map(int, one.chosen_spans.split("-"))
    assert one.chosen[a:b] == "yes<|end|>\n"
    a, b = map(int, one.rejected_spans.split("-"))
    assert one.rejected[a:b] == "no é<|end|>\n"
    assert (got[(1, 0)].prompt, got[(1, 0)].rejected, got[(1, 0)].differ) == ("", "", True)
    assert got[(1, 0)].chosen == "<|user|>\n<|end|>\n<|assistant|>\na<|end|>\n"
    assert (got[(2, 0)].chosen, got[(2, 0)].differ, got[(2, 0)].prompt_turns) == ("", False, 1)
    long = [got[(3, k)] for k in range(4)]
    assert sum(r.prompt.count("<|end|>") for r in long) == 700 == long[0].prompt_turns
    assert [sum(getattr(r, c).count("<|end|>") for r in long) for c in ("chosen", "rejected")] == [300, 300]
    assert chat.preferences(df.limit(0), F.expr("conv_id div 2"), F.lit(True)).count() == 0
