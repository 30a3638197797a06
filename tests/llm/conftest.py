import random

import pytest

#: Nulls, empty and blank texts, repeated rows, ties, no letters, other scripts.
ODD = [None, "", " ", "\n\n", "a", "A b", "é É", "日本 語", "x " * 40, "\x00\x01", "🙂🙂", "▁ ▁▁x", "- - -", "a\tb\x0bc", "☃" * 300]


@pytest.fixture(scope="session")
def small(spark):
    """Documents with nulls, copies, near copies, a shared passage, a long text, and columns of clashing names."""
    rng = random.Random(11)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base, passage = text(120), text(60)
    texts = list(ODD) + [base] * 4
    for _ in range(12):
        words = base.split(" ")
        for _ in range(rng.randrange(1, 4)):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        texts.append(" ".join(words))
    texts += [text(40) + " " + passage + " " + text(rng.randrange(30, 60)) for _ in range(6)]
    texts += [text(rng.randrange(1, 80)) for _ in range(15)] + [text(20000), "ab" * 1500, "\n".join([text(6)] * 5)]
    rows = [(i, t, "en", t, "t") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, c string, h string, id string").repartition(3)
