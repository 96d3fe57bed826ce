"""Chroma fingerprints of audio columns, and the alignment of recordings by them."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terracite.session import cut, pick

RATE, FRAME, HOP = 2000, 512, 128
#: Samples of one rendered note, and the lowest pitch, an A in Hz.
NOTE, LOWEST = 256, 220.0
#: Frames whose integers make one key of the index, by offset, and the bits of them that say which area is the larger.
KEY, SIGNS = (0, 8), 0xAAAAAAAA
#: Samples by which a query is shifted against the grid of frames, so that one shift nearly stands on it.
SHIFTS = tuple(range(0, HOP, HOP // 4))
#: Frames that the widest filter covers.
WIDEST = 8
PRINTS = "id long, shift int, frames int, print binary"


#: Recordings that go to Python at a time; ten thousand, as by default, would be hundreds of MB.
BATCH = 64


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH) -> Iterator[None]:
    """Holds Arrow batches to so many rows while wide columns are computed."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


# Recordings


def render(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """An audio column from a vector column: each value is a note, its pitch class by the value's normal rank.

    Returns id, audio (16-bit little-endian samples at RATE Hz). A null vector gives null audio; null values are rests.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        time = np.arange(NOTE) / RATE
        tones = np.sin(2 * np.pi * LOWEST * 2 ** (np.arange(12) / 12)[:, None] * time) * np.hanning(NOTE) * 12000
        tones = np.vstack([tones, np.zeros(NOTE)]).astype("<i2")
        edges = np.array([-1.383, -0.967, -0.674, -0.431, -0.21, 0.0, 0.21, 0.431, 0.674, 0.967, 1.383])  # twelfths of a normal law
        for frame in frames:
            audio = []
            for vector in frame["v"]:
                if vector is None:
                    audio.append(None)
                    continue
                v = np.array(vector, dtype=np.float64)
                scaled = v / max(float(np.sqrt(np.nanmean(v * v))) if np.isfinite(v).any() else 1.0, 1e-12)
                audio.append(tones[np.where(np.isfinite(v), np.searchsorted(edges, scaled), 12)].tobytes())
            yield pd.DataFrame({"id": frame["id"].astype("Int64"), "audio": audio})

    named = pick(table, id_col, vector_col).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    return named.mapInPandas(run, "id long, audio binary")


# Fingerprints


def filters() -> list[tuple[int, int, int, int]]:
    """Sixteen filters (shape, lowest pitch class, pitch classes, frames), by rule: all shapes at growing sizes."""
    return [(k % 4, (5 * k) % 9, 4 if k % 3 else 2, (2, 4, WIDEST)[k % 3]) for k in range(16)]


def chroma(samples: np.ndarray) -> np.ndarray:
    """Energy of the twelve pitch classes in each frame, scaled to length 1 (a silent frame is all zero)."""
    if len(samples) < FRAME:
        samples = np.pad(samples, (0, FRAME - len(samples)))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    out, hz = [], np.fft.rfftfreq(FRAME, 1 / RATE)
    heard = (hz >= 100) & (hz <= 950)
    pitch = np.round(12 * np.log2(hz[heard] / LOWEST)).astype(int) % 12
    into = np.eye(12)[pitch]
    for at in range(0, len(frames), 4096):
        power = np.abs(np.fft.rfft(frames[at : at + 4096] * np.hanning(FRAME), axis=1)[:, heard]) ** 2
        out.append(power @ into)
    energy = np.vstack(out)
    norm = np.linalg.norm(energy, axis=1, keepdims=True)
    return np.where(norm > 1, energy / np.maximum(norm, 1e-12), 0.0)


def packed(image: np.ndarray) -> np.ndarray:
    """One 32-bit integer for each frame: two bits, in Gray code, from each filter's log ratio of two areas.

    Areas are read off the integral image of the chroma, four values each, whatever their size.
    """
    total = np.pad(image, ((0, WIDEST - 1), (0, 0)), mode="edge").cumsum(0).cumsum(1)
    total = np.pad(total, ((1, 0), (1, 0)))
    at = np.arange(len(image))

    def area(row: int, rows: int, low: int, high: int) -> np.ndarray:
        a, b = at + row, at + row + rows
        return total[b, high] - total[a, high] - total[b, low] + total[a, low]

    out = np.zeros(len(image), dtype=np.uint32)
    for shape, low, high, width in filters():
        high += low
        half, middle = width // 2, (low + high) // 2
        if shape == 0:  # against all pitch classes
            x, y = area(0, width, low, high), area(0, width, 0, 12) / 3
        elif shape == 1:  # low and high
            x, y = area(0, width, low, middle), area(0, width, middle, high)
        elif shape == 2:  # before and after
            x, y = area(0, half, low, high), area(half, half, low, high)
        else:  # crosswise
            x = area(0, half, low, middle) + area(half, half, middle, high)
            y = area(0, half, middle, high) + area(half, half, low, middle)
        level = np.searchsorted((-0.25, 0.0, 0.25), np.log((x + 0.1) / (y + 0.1)))
        out = out << np.uint32(2) | (level ^ level >> 1).astype(np.uint32)
    return out


def fingerprints(recordings: DataFrame, shifts: tuple[int, ...] = (0,)) -> DataFrame:
    """id, shift, number of frames and packed fingerprint of each recording (id, audio) from each shift on; null or
    empty audio has no frame."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, raw in zip(frame["id"], frame["audio"], strict=True):
                samples = np.frombuffer(raw or b"", dtype="<i2").astype(np.float64)
                for shift in shifts:
                    heard = packed(chroma(samples[shift:])).astype("<u4").tobytes() if len(samples) > shift else b""
                    rows.append((name, shift, len(heard) // 4, heard))
            yield pd.DataFrame(rows, columns=["id", "shift", "frames", "print"]).astype({"id": "Int64"})

    return pick(recordings, "id", "audio").selectExpr("cast(id as long) id", "audio").mapInPandas(run, PRINTS)


# Alignment


def keys(prints: DataFrame) -> DataFrame:
    """name, at (frame), key: the signs of KEY's frames as one number; a run of equal frames, as in silence, gives none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            names, places, found = [], [], []
            for name, raw in zip(frame["name"], frame["print"], strict=True):
                p = np.frombuffer(raw, dtype="<u4") & np.uint32(SIGNS)
                n = max(0, len(p) - KEY[-1])
                first, last = p[:n].astype(np.uint64), p[KEY[-1] :].astype(np.uint64)
                at = np.flatnonzero(first != last)
                names.append(np.full(len(at), name))
                places.append(at.astype(np.int32))
                found.append((first << np.uint64(32) | last)[at].view(np.int64))
            if names:
                yield pd.DataFrame({"name": np.concatenate(names), "at": np.concatenate(places), "key": np.concatenate(found)})

    return prints.select("name", "print").mapInPandas(run, "name long, at int, key long")


def excerpts(recordings: DataFrame, every: int = 20, start: int = 13 * NOTE + 37, length: int = 36 * NOTE, noise: float = 600.0) -> DataFrame:
    """Queries: of each recording whose id is divisible by ``every``, the samples from ``start`` on, with noise added
    that depends on the id alone. Null audio and null ids give none; what is shorter than ``start`` is taken whole."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            heard = []
            for name, raw in zip(frame["id"], frame["audio"], strict=True):
                x = np.frombuffer(raw, dtype="<i2").astype(np.float64)
                x = x[start : start + length] if len(x) > start else x
                x = x + np.random.default_rng(abs(int(name))).normal(0, noise, len(x))
                heard.append(np.clip(x, -32768, 32767).astype("<i2").tobytes())
            yield pd.DataFrame({"id": frame["id"], "audio": heard})

    asked = pick(recordings, "id", "audio").where((F.col("id") % every == 0) & F.col("audio").isNotNull())
    return asked.mapInPandas(run, "id long, audio binary")


def align(recordings: DataFrame, queries: DataFrame, most_error: float = 0.25, least_overlap: int = 24) -> DataFrame:
    """Where the sound of each query stands in the recordings.

    recordings, queries: id, audio. Recordings with equal fingerprints are one class and are searched once. A query
    is fingerprinted at several shifts; its frames meet those of all classes on equal keys; hits are counted by offset, and a pair's best offset, the one
    of most hits, is held to the share of differing bits over the frames that overlap there. Links need
    ``least_overlap`` frames and at most ``most_error`` differing bits.

    Null or empty audio: no frames, class null, no links. A recording's query is the query of the same id (of several,
    the one of smallest fingerprint). Repeated rows stay. Empty table: no rows. Other columns are ignored.

    Returns one row for each recording: id, frames, class_id (smallest id of its class), links (classes that its query
    is heard in; null without a query), best_class, best_offset (frames of that class before the query begins),
    best_error.
    """
    with small_batches(recordings.sparkSession):
        prints = cut(fingerprints(recordings).withColumn("name", F.when(F.col("frames") > 0, F.xxhash64("print"))))
        heard = cut(fingerprints(queries, SHIFTS).where("frames > 0"))
    classes = cut(prints.where("name is not null").groupBy("name").agg(F.min("id").alias("class_id"), F.first("print").alias("print")))
    asked = cut(heard.groupBy("id", "shift").agg(F.min("print").alias("print")).withColumn("name", F.xxhash64("id", "shift")))
    ours = keys(asked).select(F.col("name").alias("probe"), F.col("at").alias("q_at"), "key")
    hits = ours.join(keys(classes), "key").groupBy("probe", "name", (F.col("at") - F.col("q_at")).alias("offset")).agg(F.count(F.lit(1)).alias("hits"))
    probes = asked.select(F.col("name").alias("probe"), F.col("id").alias("q"), F.col("print").alias("heard"))
    top = F.max(F.struct("hits", (-F.abs("offset")).alias("near"), "offset", "probe")).alias("top")
    best = hits.join(probes.drop("heard"), "probe").groupBy("q", "name").agg(top).select("name", "top.offset", "top.probe")
    pairs = best.join(classes, "name").join(probes, "probe")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for q, name, offset, whole, heard in zip(frame["q"], frame["class_id"], frame["offset"], frame["print"], frame["heard"], strict=True):
                a, b = np.frombuffer(whole, dtype="<u4")[max(0, offset) :], np.frombuffer(heard, dtype="<u4")[max(0, -offset) :]
                n = min(len(a), len(b))
                if n >= least_overlap:
                    rows.append((q, name, offset, float(np.bitwise_count(a[:n] ^ b[:n]).sum()) / (32 * n)))
            yield pd.DataFrame(rows, columns=["q", "name", "offset", "error"]).astype({"q": "int64", "name": "Int64", "offset": "int32", "error": "float64"})

    errors = pairs.select("q", "class_id", "offset", "print", "heard").mapInPandas(run, "q long, name long, offset int, error double")
    linked = errors.where(F.col("error") <= most_error).groupBy("q").agg(F.count(F.lit(1)).alias("links"), F.min(F.struct("error", "name", "offset")).alias("best"))
    answers = asked.where("shift = 0").join(linked.withColumnRenamed("q", "id"), "id", "left").select("id", F.coalesce("links", F.lit(0)).alias("links"), "best")
    named = prints.join(classes.select("name", "class_id"), "name", "left").join(answers, "id", "left")
    return named.select(
        "id", "frames", "class_id", "links", F.col("best.name").alias("best_class"), F.col("best.offset").alias("best_offset"), F.round("best.error", 6).alias("best_error")
    )
