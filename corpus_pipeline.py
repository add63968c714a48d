"""A corpus pipeline over documents: clean, rate, drop near copies, mix and pack.

Each stage takes (spark, docs, sf_dir) and returns rows; all but the last keep the columns of
documents. Texts are matched back by id and hash, so documents that share an id stay apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm import queries as q
from chronoloom.llm.classifier import classify_lyrics
from chronoloom.llm.mixing import mix_genres
from chronoloom.llm.near_copies import near_copies
from chronoloom.llm.quality import judge_lyrics
from chronoloom.llm.store import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
KEY = "struct(doc_id, xxhash64(text) AS text_hash)"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, judged where they are.

    A null text fails the base rules; repeated rows share a fate; a text of any length is judged whole; an empty table
    stays empty; only the columns of documents are read and returned.
    """
    return judge_lyrics(_with_document(docs), carried="document").filter("kept").select("document.*")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts good, scored where they are.

    A null text scores as empty; repeated rows share a fate; texts of any length are scored whole; an empty table stays
    empty; only the columns of documents are read and returned.
    """
    scored = classify_lyrics(_with_document(docs), q.ratings(spark, sf_dir), carried="document")
    return scored.filter("predicted = 1").select("document.*")


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id (of equal ids the lowest text hash) of each group of near copies, once.

    Null texts are empty and form a group with other empty ones; a null id is smaller than any; of rows with one id and
    text the smallest by lang, source and n_chars stays; an empty table stays empty.
    """
    groups = near_copies(q.as_tracks(docs, F.expr(KEY)))
    first = groups.select(F.col("component_id").alias("track_id")).distinct()
    return _once(docs).join(first, "track_id", "left_semi").select("document.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Rows with one id and text take their copies together, as the smallest of them; null texts have no words and are not
    taken; a null source is a source and a null id an id; a very long document is taken whole or not; an empty table stays empty.
    """
    mixed = mix_genres(q.as_tracks(docs, F.expr(KEY)), q.WEIGHTS, whole=True).filter("taken > 0")
    copies = mixed.groupBy("track_id").agg(F.sum(F.expr("taken div size")).cast("int").alias("copies"))
    taken = _once(docs).join(copies, "track_id")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select("document.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in packed sequences.

    A null text is one piece with the closing id; each repeated row is packed on its own; long documents are cut at the
    ends of sequences; an empty table gives no pieces.
    """
    return q.packed(q.as_tracks(docs))


def _with_document(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").alias("track_id"),
        F.col("text").alias("lyrics_text"),
        F.col("lang").alias("language"),
        F.struct(*COLUMNS).alias("document"),
    )


def _once(docs: DataFrame) -> DataFrame:
    """track_id, document: of the rows that are the same document the smallest; repeats are dropped before they are shuffled."""
    whole = docs.select(F.expr(KEY).alias("track_id"), F.struct("doc_id", "lang", "source", "n_chars", "text").alias("document"))
    once = whole.groupBy("track_id").agg(F.min("document").alias("document"))
    return once.select("track_id", F.struct(*(F.col("document")[c].alias(c) for c in COLUMNS)).alias("document"))


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("simhash near-dedup", simhash_near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

# Hashes of shuffles, tokenizers and trained models have no SQL form; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
