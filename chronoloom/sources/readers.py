"""Sources: analysis snapshots, truth documents, PCM folders, legacy hits."""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Callable, Iterator, Sequence
from dataclasses import astuple, dataclass, fields

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HIT = (
    "struct<id:string, sample:bigint, acousticSample:bigint, chartSample:bigint, detectedSample:bigint, "
    "refinedSample:bigint, snappedSample:bigint, snapErrorMs:double, band:string, confidence:double, "
    "salience:double, source:string, detectorVotes:array<string>, primaryStem:string, "
    "stemEvidence:map<string,double>, manuallyEdited:boolean, locked:boolean>"
)
CANDIDATE = (
    "struct<id:string, acousticSample:bigint, chartSample:bigint, snapErrorMs:double, lane:string, "
    "status:string, confidence:double, hitPointId:string>"
)
SEGMENT = (
    "struct<id:string, startSample:bigint, bpm:double, timeSignatureNumerator:int, "
    "timeSignatureDenominator:int, beatOffsetSample:bigint, confidence:double, manuallyEdited:boolean>"
)
ARRAYS = f"hitPoints:array<{HIT}>, candidateEvents:array<{CANDIDATE}>, tempoMap:array<{SEGMENT}>"
SNAPSHOT = (
    f"trackId string, slug string, {ARRAYS.replace(':array', ' array')}, "
    f"track struct<id:string, {ARRAYS}>, analysis struct<{ARRAYS}>"
)


def read_analysis(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """hits, candidates and tempo of analysis snapshots (one JSON document per file).

    Each array may sit at the root, under ``track`` or under ``analysis``; the
    first present place wins.  The track is named by the document or by the file.
    """
    raw = spark.read.schema(SNAPSHOT).option("multiLine", True).json(path)
    name = F.regexp_replace(
        F.regexp_extract("_metadata.file_name", "^(.*?)(?:\\.analysis)?\\.json$", 1), "%20", " "
    )
    docs = raw.select(F.coalesce("trackId", "slug", F.col("track.id"), name).alias("track_id"), "*")

    def rows(array: str) -> DataFrame:
        found = F.coalesce(F.col(array), F.col(f"track.{array}"), F.col(f"analysis.{array}"))
        return docs.select("track_id", F.posexplode(found).alias("idx", "r")).select("track_id", "idx", "r.*")

    return {"hits": rows("hitPoints"), "candidates": rows("candidateEvents"), "tempo": rows("tempoMap")}


def evaluation_positions(hits: DataFrame) -> DataFrame:
    """Heard and suggested position of a prediction, with their fallbacks."""
    return hits.withColumns(
        {
            "acoustic": F.coalesce("acousticSample", "refinedSample", "sample"),
            "chart": F.coalesce("chartSample", "snappedSample", "sample"),
        }
    )


TRUTH = (
    "slug string, title string, sampleRate int, channels int, sampleCount bigint, durationSec double, "
    "bpm double, timeSignatureNumerator int, timeSignatureDenominator int, beatOffsetSample bigint, seed int, "
    "onsets array<struct<sample:bigint, timeSec:double, band:string, strength:double, layers:array<string>>>"
)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """One row per true onset; ``idx`` is its place in the document."""
    docs = spark.read.schema(TRUTH).option("multiLine", True).json(path)
    facts = [c for c in docs.columns if c != "onsets"]
    return docs.select(*facts, F.posexplode("onsets").alias("idx", "o")).select(
        *facts, F.col("idx").cast("bigint").alias("idx"), "o.*"
    ).withColumn("strength", F.coalesce("strength", F.lit(1.0)))


def missing_predictions(truth: DataFrame, predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tracks with truth but without any prediction."""
    return truth.select(*keys).distinct().join(predictions.select(*keys).distinct(), list(keys), "left_anti")


# --------------------------------------------------------------------------
# PCM


@dataclass(frozen=True)
class WavLayout:
    """What the header of a PCM WAV says: sample format, and where its frames lie."""

    code: int
    bits: int
    channels: int
    rate: int
    offset: int
    frames: int

    @property
    def frame_bytes(self) -> int:
        return self.channels * self.bits // 8


def wav_layout(read: Callable[[int, int], bytes], length: int) -> WavLayout:
    """Layout of a file of ``length`` bytes; ``read(start, size)`` is asked for chunk headers only."""
    start = read(0, 12)
    if len(start) < 12 or start[:4] != b"RIFF" or start[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, layout, data = 12, None, None
    while at + 8 <= length:
        head = read(at, 8)
        tag, size = head[:4], struct.unpack_from("<I", head, 4)[0]
        if tag == b"fmt ":
            layout = struct.unpack_from("<HHIIHH", read(at + 8, 16))
        elif tag == b"data":
            if at + 8 + size > length:
                raise ValueError("header announces more samples than the file holds")
            data = (at + 8, size)
        at += 8 + size + size % 2
    if layout is None or data is None:
        raise ValueError("fmt or data chunk is missing")
    code, channels, rate, _, _, bits = layout
    if code == 0xFFFE:  # extensible: 24 bits are always integers here
        code = 3 if bits == 64 else 1
    if (code, bits) not in ((3, 32), (3, 64), (1, 8), (1, 16), (1, 24), (1, 32)):
        raise ValueError(f"unsupported sample format {code}/{bits}")
    if channels < 1 or rate < 1 or data[1] % (channels * bits // 8):
        raise ValueError("sample data does not fit the channel count")
    return WavLayout(code, bits, channels, rate, data[0], data[1] // (channels * bits // 8))


def wav_samples(data: bytes, layout: WavLayout) -> np.ndarray:
    """Frames x channels samples in [-1, 1] of whole frames."""
    bits = layout.bits
    if layout.code == 3:
        values = np.frombuffer(data, "<f4" if bits == 32 else "<f8").astype(np.float32)
    elif bits == 24:
        raw = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
        joined = raw[:, 0] | raw[:, 1] << 8 | raw[:, 2] << 16
        values = ((joined ^ 0x800000) - 0x800000).astype(np.float32) / 8388608.0
    elif bits == 8:
        values = (np.frombuffer(data, np.uint8).astype(np.float32) - 128.0) / 128.0
    else:
        values = np.frombuffer(data, f"<i{bits // 8}").astype(np.float32) / float(2 ** (bits - 1))
    return values.reshape(-1, layout.channels)


def parse_wav(content: bytes) -> tuple[int, int, np.ndarray]:
    """Rate, channels and frames x channels samples in [-1, 1] of a PCM WAV."""
    layout = wav_layout(lambda start, size: content[start : start + size], len(content))
    data = memoryview(content)[layout.offset : layout.offset + layout.frames * layout.frame_bytes]
    return layout.rate, layout.channels, wav_samples(data, layout)


def store_of(path: str) -> tuple[FileSystem, str]:
    """The store of a path as Spark writes it, and the place in it."""
    local = re.fullmatch("(?:file:)?/+(.*)", path)
    if local:
        return LocalFileSystem(), "/" + local[1]
    return FileSystem.from_uri(path) if ":" in path else (LocalFileSystem(), path)


def opened(path: str) -> pa.NativeFile:
    """A file of any store that Arrow reaches, for reading ranges."""
    store, place = store_of(path)
    return store.open_input_file(place)


def reachable(path: str) -> bool:
    """Whether ranges of the files below ``path`` can be read; else Spark alone reads them, each as a whole."""
    try:
        store_of(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


def wav_files(spark: SparkSession, path: str, *columns: str, deep: bool = False) -> DataFrame:
    """Spark's listing of WAV files; contents are only read if asked for."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", deep)
    return found.load(path).select(*columns)


PCM_SCHEMA = (
    "track_id string, rate int, channels int, sample_count bigint, chunk_idx bigint, start_sample bigint, "
    "samples array<float>, error string"
)
PCM_COLUMNS = [c.strip().split()[0] for c in PCM_SCHEMA.split(",")]
LAYOUT_SCHEMA = "path string, code int, bits int, channels int, rate int, offset bigint, frames bigint, error string"


def _layouts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Headers of files, which are not read beyond them."""
    for pdf in batches:
        rows = []
        for path in pdf["path"]:
            try:
                with opened(path) as file:
                    found = wav_layout(lambda start, size: file.read_at(size, start), file.size())
                rows.append((path, *astuple(found), None))
            except (ValueError, struct.error, OSError) as problem:
                rows.append((path, *[None] * 6, str(problem)))
        columns = [c.split()[0] for c in LAYOUT_SCHEMA.split(", ")]
        yield pd.DataFrame(rows, columns=columns).astype({c: "Int64" for c in columns[1:-1]})


def read_pcm(spark: SparkSession, path: str, chunk: int = 1 << 18, chunks_per_part: int = 64) -> DataFrame:
    """Mono chunks of a folder of PCM WAV files, ranges of files in parallel.

    Mono is the channel mean.  A file that cannot be read gives one row with
    ``error`` and no samples; it does not fail the job.  Headers are read first and cut the frames of a
    file into ranges of ``chunks_per_part`` chunks; each range is a row of its own that any task may read, a chunk at a
    time.  In stores that only Spark reaches a file is read whole.
    """
    if not reachable(path):
        return _read_whole(spark, path, chunk)
    heads = wav_files(spark, path, "path").mapInPandas(_layouts, LAYOUT_SCHEMA)
    step = chunk * chunks_per_part
    parts = heads.withColumn(
        "begin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.coalesce("frames", F.lit(0)), F.lit(1)) - 1, F.lit(step)))
    )

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                track = row.path.rsplit("/", 1)[-1].removesuffix(".wav")
                if row.error is not None:
                    yield pd.DataFrame([(track, *[None] * 6, row.error)], columns=PCM_COLUMNS)
                    continue
                layout = WavLayout(*(int(getattr(row, f.name)) for f in fields(WavLayout)))
                begin = int(row.begin)
                with opened(row.path) as file:
                    for start in range(begin, min(begin + step, max(1, layout.frames)), chunk):
                        n = min(chunk, layout.frames - start)
                        data = file.read_at(n * layout.frame_bytes, layout.offset + start * layout.frame_bytes)
                        mono = wav_samples(data, layout).mean(axis=1, dtype=np.float32)
                        facts = (track, layout.rate, layout.channels, layout.frames, start // chunk, start, mono, None)
                        yield pd.DataFrame([facts], columns=PCM_COLUMNS)

    # a given number of partitions: the rows are few and small, what they stand for is not
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return parts.repartition(n, "path", "begin").mapInPandas(decode, PCM_SCHEMA)


def _read_whole(spark: SparkSession, path: str, chunk: int) -> DataFrame:
    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                track = name.rsplit("/", 1)[-1].removesuffix(".wav")
                try:
                    rate, channels, frames = parse_wav(bytes(content))
                except (ValueError, struct.error) as problem:
                    yield pd.DataFrame([(track, *[None] * 6, str(problem))], columns=PCM_COLUMNS)
                    continue
                mono = frames.mean(axis=1, dtype=np.float32)
                for i, start in enumerate(range(0, max(1, len(mono)), chunk)):
                    part = mono[start : start + chunk]
                    yield pd.DataFrame([(track, rate, channels, len(mono), i, start, part, None)], columns=PCM_COLUMNS)

    return wav_files(spark, path, "path", "content").mapInPandas(decode, PCM_SCHEMA)


def samples_of(chunks: DataFrame) -> DataFrame:
    """One row per sample of PCM chunks."""
    return chunks.select("track_id", "start_sample", F.posexplode("samples").alias("_i", "value")).select(
        "track_id", (F.col("start_sample") + F.col("_i")).alias("pos"), F.col("value").cast("double").alias("value")
    )


WAV_FACTS = "rate int, channels int, sample_count bigint, sha256 string, error string"
HASHED_AT_ONCE = 1 << 23


def _wav_facts(read: Callable[[int, int], bytes], length: int) -> tuple:
    digest = hashlib.sha256()
    for start in range(0, length, HASHED_AT_ONCE):
        digest.update(read(start, min(HASHED_AT_ONCE, length - start)))
    try:
        layout = wav_layout(read, length)
        return layout.rate, layout.channels, layout.frames, digest.hexdigest(), None
    except (ValueError, struct.error) as problem:
        return None, None, None, digest.hexdigest(), str(problem)


def asset_inventory(spark: SparkSession, path: str, tracks: DataFrame, reference: str = "reference") -> DataFrame:
    """Size, hash and timeline of every asset, and whether it fits its track.

    Assets lie at .../<track_id>/<role>.wav.  Rate and sample count must equal the
    track's; the channel count only for the reference asset.  A file is hashed piece by piece; its header
    alone is parsed.  In stores that only Spark reaches a file is read whole.
    """
    ranged = reachable(path)
    files = wav_files(spark, path, "path", "length", *([] if ranged else ["content"]), deep=True)

    def facts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                if ranged:
                    with opened(row.path) as file:
                        found = _wav_facts(lambda start, size: file.read_at(size, start), file.size())
                else:
                    content = bytes(row.content)
                    found = _wav_facts(lambda start, size: content[start : start + size], len(content))
                rows.append((row.path, row.length, *found))
            columns = ["path", "bytes", *(c.split()[0] for c in WAV_FACTS.split(", "))]
            kinds = {c: "Int64" for c in ("rate", "channels", "sample_count")}
            yield pd.DataFrame(rows, columns=columns).astype(kinds)

    if ranged:  # the listing is small rows: spread what they stand for
        files = files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    assets = files.mapInPandas(facts, f"path string, bytes bigint, {WAV_FACTS}").select(
        F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("track_id"), F.regexp_extract("path", "([^/]+)\\.wav$", 1).alias("role"),
        "bytes", "sha256", "rate", "channels", "sample_count", "error",
    )
    expected = tracks.select(
        "track_id", F.col("rate").alias("_rate"), F.col("sample_count").alias("_count"), F.col("channels").alias("_channels")
    )
    fits = (
        F.col("rate").eqNullSafe(F.col("_rate")) & F.col("sample_count").eqNullSafe(F.col("_count"))
        & ((F.col("role") != reference) | F.col("channels").eqNullSafe(F.col("_channels")))
    )
    return assets.join(expected, "track_id", "left").withColumn("fits", fits).drop("_rate", "_count", "_channels")


def backfill_hits(df: DataFrame) -> DataFrame:
    """Fill positions that older rows lack: acoustic, chart, stem and evidence.

    A touched row was placed by hand, so its own sample is what was heard.
    """
    for name, ddl in (("acoustic", "bigint"), ("chart", "bigint"), ("primary_stem", "string"), ("evidence", "map<string,double>")):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(ddl))
    touched = F.coalesce(F.col("edited"), F.lit(False)) | F.coalesce(F.col("locked"), F.lit(False))
    empty = F.create_map().cast("map<string,double>")
    return df.withColumns(
        {
            "acoustic": F.coalesce("acoustic", F.when(touched, F.col("sample")).otherwise(F.col("refined"))),
            "chart": F.coalesce("chart", "snapped"),
            "primary_stem": F.coalesce("primary_stem", F.lit("mix")),
            "evidence": F.coalesce(F.col("evidence"), empty),
        }
    )
