"""Files of audio and features: discovery, durations, decoding and batched inference with injected functions.

Spark reads the files; what turns bytes into numbers is passed in and runs on the executors. WAV needs nothing."""

from __future__ import annotations

import io
import time
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What stands for a text that a model could not give.
NO_RESULT = "NO_PHONEME"


def discover(spark: SparkSession, root: str, kinds: tuple[str, ...] = ("wav", "mp3", "flac"), containing: str | None = None, limit: int | None = None) -> DataFrame:
    """(path, modificationTime, length) of files below root by type and part of the path; contents are not read. limit
    takes the first by path."""
    d = spark.read.format("binaryFile").options(recursiveFileLookup="true", pathGlobFilter=f"*.{{{','.join(kinds)}}}").load(root).select("path", "modificationTime", "length")
    d = d.where(F.col("path").contains(containing)) if containing else d
    return d.orderBy("path").limit(limit) if limit is not None else d


def existing(df: DataFrame, path: str, files: DataFrame) -> DataFrame:
    """The rows whose path is among the files of discover (with or without a file: prefix)."""
    have = files.select(F.regexp_replace("path", "^file:/*", "/").alias("_p")).distinct()
    return df.join(have, F.col(path) == F.col("_p"), "left_semi")


def wav_seconds(content: bytes) -> float | None:
    """Seconds of a WAV by its header; None if it has none."""
    try:
        with wave.open(io.BytesIO(content)) as w:
            return w.getnframes() / w.getframerate() if w.getframerate() else None
    except (wave.Error, EOFError):
        return None


def decode_wav(content: bytes) -> tuple[np.ndarray, int]:
    """Mono samples in -1 .. 1 and the rate of a 16-bit WAV."""
    with wave.open(io.BytesIO(content)) as w:
        x = np.frombuffer(w.readframes(w.getnframes()), dtype="<i2").astype(np.float32) / 32768
        return x.reshape(-1, w.getnchannels()).mean(axis=1) if w.getnchannels() > 1 else x, w.getframerate()


def durations(spark: SparkSession, root: str, probe: Callable[[bytes], float | None] = wav_seconds, kinds: tuple[str, ...] = ("wav",)) -> DataFrame:
    """(path, seconds) of audio files; seconds is NULL where the probe fails."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"path": f["path"], "seconds": [probe(bytes(c)) for c in f["content"]]})

    d = spark.read.format("binaryFile").options(recursiveFileLookup="true", pathGlobFilter=f"*.{{{','.join(kinds)}}}").load(root)
    return d.select("path", "content").mapInPandas(run, "path string, seconds double")


def refresh(cache: DataFrame, current: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A derived table brought up to date: its rows whose key still exists, and computed ones for new keys."""
    keys = current.select(key).distinct()
    return cache.join(keys, key, "left_semi").unionByName(compute(current.join(cache.select(key).distinct(), key, "left_anti")))


def valid_audio(samples: np.ndarray, least: int = 1600, silence: float = 1e-4) -> bool:
    """Long enough, finite, not silent."""
    return len(samples) >= least and bool(np.isfinite(samples).all()) and float(np.abs(samples).max()) > silence


def log_mel(samples: np.ndarray, rate: int = 16_000, fft: int = 2048, hop: int = 512, mels: int = 128, frames: int = 400) -> np.ndarray:
    """A mel spectrogram in dB of fixed shape (mels, frames), padded with zeros or cut."""
    x = np.pad(samples.astype(np.float64), fft // 2, mode="reflect" if len(samples) > fft // 2 else "constant")
    n = 1 + max(0, len(x) - fft) // hop
    at = np.arange(fft)[None, :] + hop * np.arange(n)[:, None]
    x = np.pad(x, (0, max(0, at.max() + 1 - len(x))))
    power = np.abs(np.fft.rfft(x[at] * np.hanning(fft + 1)[:-1], axis=1)) ** 2
    hz = lambda m: 700 * (10 ** (m / 2595) - 1)
    edges = hz(np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), mels + 2))
    bins = np.fft.rfftfreq(fft, 1 / rate)
    up = (bins[None, :] - edges[:-2, None]) / np.maximum(edges[1:-1] - edges[:-2], 1e-9)[:, None]
    down = (edges[2:, None] - bins[None, :]) / np.maximum(edges[2:] - edges[1:-1], 1e-9)[:, None]
    bank = np.maximum(0, np.minimum(up, down)) * (2 / (edges[2:] - edges[:-2]))[:, None]
    db = 10 * np.log10(np.maximum(bank @ power.T, 1e-10))
    db = np.maximum(db - db.max(), -80.0)
    out = np.zeros((mels, frames), dtype=np.float32)
    out[:, : min(frames, db.shape[1])] = db[:, :frames]
    return out


def mel_features(spark: SparkSession, root: str, decode: Callable[[bytes], tuple[np.ndarray, int]] = decode_wav) -> DataFrame:
    """(path, mel): flattened log_mel of every audio file that can be decoded and is valid."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            paths, mels = [], []
            for p, c in zip(f["path"], f["content"]):
                try:
                    x, rate = decode(bytes(c))
                except Exception:  # noqa: BLE001  a broken file is left out, as documented
                    continue
                if valid_audio(x):
                    paths.append(p)
                    mels.append(log_mel(x, rate).ravel().tolist())
            if paths:
                yield pd.DataFrame({"path": paths, "mel": mels})

    d = spark.read.format("binaryFile").options(recursiveFileLookup="true", pathGlobFilter="*.wav").load(root)
    return d.select("path", "content").mapInPandas(run, "path string, mel array<float>")


def read_npy(spark: SparkSession, root: str, pattern: str = "*.npy") -> DataFrame:
    """(path, row, vector): the rows of feature files, each flattened."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for p, c in zip(f["path"], f["content"]):
                a = np.load(io.BytesIO(bytes(c)), allow_pickle=False)
                a = a.reshape(len(a), -1).astype(np.float64) if a.ndim > 1 else a.reshape(-1, 1).astype(np.float64)
                for at in range(0, len(a), 1000):
                    yield pd.DataFrame({"path": p, "row": np.arange(at, min(at + 1000, len(a))), "vector": a[at : at + 1000].tolist()})

    d = spark.read.format("binaryFile").options(recursiveFileLookup="true", pathGlobFilter=pattern).load(root)
    return d.select("path", "content").mapInPandas(run, "path string, row long, vector array<double>")


def infer(df: DataFrame, key: str, value: str, load: Callable[[], Callable[[list], list]], batch: int = 32, sentinel: str | None = NO_RESULT) -> DataFrame:
    """(key, result, reason, seconds): a model's text for each value, in batches. load runs once in each task and returns the
    model. A batch that fails is halved down to single items; an item that fails, or has no result, gets the sentinel and
    the reason."""
    kind = df.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()

        def solve(items: list) -> list[tuple]:
            t = time.perf_counter()
            try:
                got = model(items)
                each = (time.perf_counter() - t) / max(len(items), 1)
                return [(g if g else sentinel, None if g else "empty", each) for g in got]
            except Exception as e:  # noqa: BLE001  the reason is part of the result
                if len(items) == 1:
                    return [(sentinel, f"{type(e).__name__}: {e}"[:200], time.perf_counter() - t)]
                half = len(items) // 2
                return solve(items[:half]) + solve(items[half:])

        for f in frames:
            rows = []
            values = f[value].tolist()
            for at in range(0, len(values), batch):
                rows += solve(values[at : at + batch])
            if not rows:
                continue
            r, why, s = zip(*rows)
            yield pd.DataFrame({key: f[key], "result": list(r), "reason": list(why), "seconds": list(s)})

    return df.select(key, value).mapInPandas(run, f"`{key}` {kind}, result string, reason string, seconds double")
