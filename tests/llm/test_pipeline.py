"""The stages on a small table against brute force of each decision."""

import re

from pyspark.sql import functions as F

import corpus_pipeline
from taskloom.llm import queries
from taskloom.llm.common import store


def test_stages(spark, tmp_path):
    filler = lambda k, n: " ".join(f"word{k}x{i}" for i in range(n))
    item, passage = filler("item", 30), filler("pass", 70)
    texts = {1: filler(1, 80), 2: filler(1, 80), 3: filler(1, 79) + " end", 4: filler(4, 60) + " " + item, 5: filler(5, 50) + " " + passage + " " + filler(6, 50), 7: filler(7, 50) + " " + passage + " " + filler(8, 50), 9: filler(9, 90), 10: "spam # " * 60, 11: None, 12: filler(12, 40)}
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = store(stage(spark, docs, str(tmp_path)))
        assert docs.columns == corpus_pipeline.COLUMNS
        kept.append({r.doc_id: r for r in docs.collect()})
    assert set(kept[0]) == {1, 2, 3, 4, 5, 7, 9, 12}
    assert set(kept[1]) == {1, 4, 5, 7, 9, 12}
    assert kept[2][9].text == texts[9]
    assert not re.search("wordpassx[2-6]", kept[2][5].text + kept[2][7].text)
    assert all(r.n_chars == len(r.text) for r in kept[2].values())
    assert set(kept[3]) == {1, 5, 7, 9, 12}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == {1, 5, 7, 9, 12}
    assert all(r.n_tokens == len(r.ids) for r in got)


def test_rows_without_an_id_and_of_one_id(spark, tmp_path):
    filler = lambda k, n, end="": " ".join(f"word{k}x{i}" for i in range(n)) + end
    item = filler("item", 30)
    clean, bad = filler(6, 90), filler(7, 60) + " " + item
    rows = [(None, filler(1, 80)), (None, filler(1, 80)), (None, filler(2, 80)), (3, filler(2, 80, " end")), (4, filler(4, 80)), (4, filler(5, 80)), (4, filler(5, 80)), (6, clean), (6, bad), (None, filler(8, 60) + " " + item), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    listed = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    kept = store(corpus_pipeline.ngram_jaccard_join(spark, docs, str(tmp_path)))
    assert listed(kept) == sorted([rows[i] for i in (0, 3, 4, 5, 7, 8, 9, 10)], key=str)
    left = corpus_pipeline.benchmark_decontamination(spark, kept, str(tmp_path))
    assert listed(left) == sorted([rows[i] for i in (0, 3, 4, 5, 7, 10)], key=str)


def test_empty_tables_and_nulls(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    long = " ".join(f"longish{i}" for i in range(30_000))
    rows = [(None, None, None, None, None), (1, None, None, "s", 0), (2, "", None, None, 0), (2, "", None, None, 0), (3, long, None, None, None), (None, long + " x", "en", None, 9)]
    for docs in (spark.createDataFrame([], schema), spark.createDataFrame(rows, schema)):
        for name, stage in corpus_pipeline.STAGES:
            out = store(stage(spark, docs.withColumn("r", F.lit(1)).withColumn("kept", F.lit("x")), str(tmp_path)))
            if name != "sentencepiece_encoding":
                assert out.columns == corpus_pipeline.COLUMNS
            if docs.isEmpty():
                assert out.isEmpty()
            elif name == "quality_rules":
                assert {r.doc_id for r in out.collect()} == {3, None}
                assert out.count() == 2
            elif name == "ngram_jaccard_join":
                assert sorted((str(r.doc_id), str(r.text)[:4]) for r in out.collect()) == [("1", "None"), ("2", ""), ("3", "long"), ("None", "None")]
            elif name == "sentencepiece_encoding":
                assert sorted(r.n_tokens for r in out.collect())[:4] == [1, 1, 1, 1]
            else:
                assert out.count() == len(rows)


def test_each_operator_has_its_query():
    names = sorted(queries.queries(), key=lambda n: int(n[2:].split("_")[0]))
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(names)
