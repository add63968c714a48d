"""Queries of the operators over the given tables: columns in, operator, columns out."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .classifier import classify_lyrics
from .crosswalk import align_lyric_tokens
from .fingerprints import fingerprint_lyrics
from .lexical import search_lyrics
from .mixing import mix_genres
from .near_copies import near_copies
from .packing import pack_lyrics
from .private_data import KINDS, find_private_data
from .quality import judge_lyrics
from .scoring import score_lyrics
from .shards import shard_tracks
from .tokens import count_lyric_tokens
from .url_rules import judge_cover_urls

URL_RULES = [
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
]
BLOCKED_GLOBS = ["*casino*/**", "*free-bets*/**", "*cheap-pills*/**", "*adult-*/**"]
WEIGHTS = [1, 2, 3]


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as tracks."""
    return as_tracks(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def as_tracks(documents: DataFrame, track_id="doc_id") -> DataFrame:
    return documents.select(
        (F.col(track_id) if isinstance(track_id, str) else track_id).alias("track_id"),
        F.col("text").alias("lyrics_text"),
        F.col("lang").alias("language"),
        F.col("source").alias("genre"),
    )


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return labels.select(F.col("doc_id").alias("track_id"), "quality")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_lyric_tokens(tracks(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumnRenamed("track_id", "doc_id")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    projects = pages.select(F.col("page_id").alias("project_id"), F.col("url").alias("cover_url"))
    judged = judge_cover_urls(projects, URL_RULES, BLOCKED_GLOBS)
    return judged.withColumnRenamed("project_id", "page_id")


OP2_SQL = r"""
WITH parts AS (
    SELECT page_id,
        translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
    FROM pages
), ruled AS (
    SELECT *, CASE
        WHEN suffix(concat('.', host), '.example.net') AND prefix(path, '/en/') THEN 'example.net/en/'
        WHEN suffix(concat('.', host), '.example.com') AND prefix(path, '/de/') THEN 'example.com/de/'
        WHEN suffix(concat('.', host), '.org') AND prefix(path, '/fr/') THEN 'org/fr/'
        WHEN suffix(concat('.', host), '.net') AND prefix(path, '/') THEN 'net/'
    END AS rule
    FROM parts
), globbed AS (
    SELECT *, CASE WHEN rule IS NOT NULL OR path = '' THEN NULL
        WHEN contains(host, 'casino') THEN '*casino*/**'
        WHEN contains(host, 'free-bets') THEN '*free-bets*/**'
        WHEN contains(host, 'cheap-pills') THEN '*cheap-pills*/**'
        WHEN contains(host, 'adult-') THEN '*adult-*/**' END AS "glob"
    FROM ruled
)
SELECT page_id, host, path, rule,
    CASE WHEN rule IN ('net/', 'example.com/de/') OR "glob" IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, "glob"
FROM globbed
"""


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_tracks(tracks(spark, sf_dir), 8).withColumnRenamed("track_id", "doc_id")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_genres(tracks(spark, sf_dir), WEIGHTS)
    return mixed.select(F.col("track_id").alias("doc_id"), "size", "source_size", "target", "taken")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_lyrics(tracks(spark, sf_dir)).withColumnRenamed("track_id", "doc_id")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(tracks(spark, sf_dir))


def packed(lyrics: DataFrame) -> DataFrame:
    pieces = pack_lyrics(lyrics, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select(
        F.col("track_id").alias("doc_id"),
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_lyrics(tracks(spark, sf_dir)).withColumnRenamed("track_id", "doc_id")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_lyrics(tracks(spark, sf_dir)).withColumnRenamed("track_id", "doc_id")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = classify_lyrics(tracks(spark, sf_dir), ratings(spark, sf_dir))
    return scored.withColumnRenamed("track_id", "doc_id")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(tracks(spark, sf_dir)).withColumnRenamed("track_id", "doc_id")


def op11_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_private_data(tracks(spark, sf_dir))

    def joined(spans: str):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        F.col("track_id").alias("doc_id"),
        *map(count, KINDS),
        F.sha2(joined("base"), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
    )


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    lines = items.select(F.col("item_id").alias("line_id"), F.col("text").alias("line_text"))
    ranked = search_lyrics(tracks(spark, sf_dir), lines)
    return ranked.withColumnsRenamed({"line_id": "item_id", "track_id": "doc_id"})


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return align_lyric_tokens(tracks(spark, sf_dir), first, second).withColumnRenamed("track_id", "doc_id")


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_url_filters,
        op3_sharding,
        op4_mixing,
        op5_lm_scoring,
        op6_packing,
        op7_fingerprints,
        op8_quality_rules,
        op9_quality_classifier,
        op10_simhash_near_dedup,
        op11_private_data,
        op12_lexical_search,
        op13_token_alignment,
    )
}
ORACLES = {"op2_url_filters": OP2_SQL}
