"""A training corpus from the documents table, in five stages.

Each stage takes all rows that the one before has kept. The first four return the columns of ``documents``; the
last returns the tokens. A stage's decisions take effect: rejected, duplicate and contaminated documents go, and
repeated passages are cut out of the texts. A document is a distinct id and text: rows without an id are documents
like any others, and so are the texts of one id, each by itself. Columns beyond those of ``documents`` are ignored,
nulls in lang, source and n_chars are kept, texts are taken whole however long they are, and an empty table gives an
empty result at each stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskloom.llm import decontam, jaccard, quality, spbpe, sufdedup
from taskloom.llm.common import cut, discard, store, table
from taskloom.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go: null, empty and short texts among them. Repeated rows are judged alike."""
    return quality.keep(docs.select(COLUMNS))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8 or more) one row stays.

    It is that of the smallest doc_id; rows without an id come last, and texts of one id, or of none, are in the order
    of their hash. Texts without words stay. Of rows with the same doc_id (or none) and the same text one stays, the
    least by its other columns. Similarities of just 0.8 link.
    """
    linked = jaccard.linked(docs, k=5, num=80, den=100)
    keys, repeated = jaccard.firsts(linked)
    discard(linked)
    kept = jaccard.only(docs.select(*COLUMNS, jaccard.row_key("doc_id", "text").alias("r")), keys, "r")
    if repeated.isEmpty():
        return kept.select(COLUMNS)
    rest = [c for c in COLUMNS if c not in ("doc_id", "text")]
    small = repeated.count() <= jaccard.BROADCAST_IDS
    once = kept.join(F.broadcast(repeated) if small else repeated, "r", "left_anti").select(COLUMNS)
    least = jaccard.only(kept, repeated, "r").groupBy("doc_id", "text").agg(F.min(F.struct(rest)).alias("rest"))
    return once.unionByName(least.select("doc_id", "text", "rest.*"))


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings of 200 bytes that start more than once are cut out; of a code point that is cut through nothing stays.

    A null text becomes an empty one, and a text of which all is repeated too: the row stays. Of repeated rows each
    loses what it shares with the others.
    """
    out = sufdedup.dedup(docs, carry=("lang", "source"))
    return out.withColumn("n_chars", F.char_length("kept_text").cast("long")).withColumnRenamed("kept_text", "text").select(COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of benchmark items go, each by its id (or none) and text; so do repeated rows of them.

    Null and empty texts have no window and stay. An empty benchmark removes nothing.
    """
    found = decontam.contamination(docs, table(spark, sf_dir, "benchmark"), min_items=1, with_hash=True)
    gone = cut(found.where("contaminated").select(F.col("doc_id").alias("id"), "text_hash").distinct())
    small = gone.count() <= jaccard.BROADCAST_IDS
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("text_hash"))
    return docs.select(COLUMNS).join(F.broadcast(gone) if small else gone, same, "left_anti")


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the decoded text, and the ids. A null or empty text has the end id alone."""
    return spbpe.encode(docs, tokenizer_path(), with_ids=True, with_decoded=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece_encoding", sentencepiece_encoding),
]

#: SQL can't express the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, store(stage(spark, docs, sf_dir))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
