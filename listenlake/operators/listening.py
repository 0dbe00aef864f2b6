"""Audio through models: PCM to log-mel patches, embedding, tags; and the index build over feature payloads."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATE, FRAME, HOP, BANDS, PATCH = 16_000, 512, 256, 96, 128


def samples(raw: bytes, channels: int) -> np.ndarray:
    """16-bit PCM as floats in [-1, 1), one column per channel; a partial frame at the end is dropped."""
    whole = len(raw) // (2 * channels) * 2 * channels
    return np.frombuffer(raw[:whole], "<i2").astype(np.float32).reshape(-1, channels) / 32768


#: Zero crossings on each side of the resampling filter, the share of the lower Nyquist rate that it passes, and its Kaiser window.
CROSSINGS, PASS, KAISER = 48, 0.95, 10.0


def filter_taps(phase: int, up: int, down: int) -> np.ndarray:
    """The taps of a windowed sinc for outputs that lie ``phase`` / ``up`` after an input; they add up to one."""
    cut = PASS * min(1.0, up / down)
    half = int(np.ceil(CROSSINGS / cut))
    x = np.arange(-half + 1, half + 1) - phase / up
    window = np.i0(KAISER * np.sqrt(np.maximum(0.0, 1 - (x * cut / CROSSINGS) ** 2)))
    taps = np.sinc(cut * x) * window
    return taps / taps.sum()


def resampled(mono: np.ndarray, rate: int, to: int = RATE) -> np.ndarray:
    """Another rate, by a polyphase filter bank: one set of taps for each place that outputs have between two inputs."""
    if rate == to or not len(mono):
        return mono
    common = int(np.gcd(rate, to))
    up, down = to // common, rate // common
    n = -(-len(mono) * up // down)
    out = np.zeros(n, np.float32)
    half = len(filter_taps(0, up, down)) // 2
    padded = np.pad(mono.astype(np.float64), half)
    for k in range(min(up, n)):
        at, phase = k * down // up, k * down % up
        windows = np.lib.stride_tricks.sliding_window_view(padded[at + 1 :], 2 * half)[::down]
        own = out[k::up]
        own[:] = windows[: len(own)] @ filter_taps(phase, up, down)
    return out


def mel_bank() -> np.ndarray:
    """Triangular filters, evenly spaced in mel (Slaney's scale), of unit area."""
    def mel(f: np.ndarray) -> np.ndarray:
        return np.where(f < 1000, f * 3 / 200, 15 + np.log(np.maximum(f, 1000) / 1000) * 27 / np.log(6.4))

    grid = np.linspace(0, RATE / 2, 4096)
    points = np.interp(np.linspace(0, float(mel(np.array(RATE / 2))), BANDS + 2), mel(grid), grid)
    f = np.fft.rfftfreq(FRAME, 1 / RATE)
    up = (f - points[:-2, None]) / (points[1:-1] - points[:-2])[:, None]
    down = (points[2:, None] - f) / (points[2:] - points[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (points[2:] - points[:-2]))[:, None]


def patches(pcm: np.ndarray, rate: int) -> np.ndarray:
    """Log-mel patches of 128 frames; a short clip is padded, a tail is trimmed."""
    mono = resampled(pcm.mean(1) if pcm.ndim == 2 else pcm, rate)
    padded = np.pad(mono, FRAME // 2)
    frames = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP] if len(padded) >= FRAME else np.zeros((1, FRAME))
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(FRAME) / FRAME)
    log_mel = np.log10(1 + 10_000 * (np.abs(np.fft.rfft(frames * window)) @ mel_bank().T)).astype(np.float32)
    if len(log_mel) < PATCH:
        log_mel = np.pad(log_mel, ((0, PATCH - len(log_mel)), (0, 0)))
    n = len(log_mel) // PATCH
    return log_mel[: n * PATCH].reshape(n, PATCH, BANDS)


def onnx_model(path: str, output: str) -> Callable[[np.ndarray], np.ndarray]:
    """A function that runs a model file; one session per worker."""
    held = {}

    def run(x: np.ndarray) -> np.ndarray:
        if path not in held:
            import onnxruntime

            held[path] = onnxruntime.InferenceSession(path)
        return np.asarray(held[path].run([output], {held[path].get_inputs()[0].name: x})[0])

    return run


def infer(clips: DataFrame, embed: Callable[[np.ndarray], np.ndarray], tag: Callable[[np.ndarray], np.ndarray], labels: list[str]) -> DataFrame:
    """track_id, embedding, tags of clips (track_id, pcm, rate, channels): patch embeddings are averaged, then scored."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for track, pcm, rate, channels in f[["track_id", "pcm", "rate", "channels"]].itertuples(index=False):
                vector = embed(patches(samples(bytes(pcm), channels), rate)).mean(0)
                score = tag(vector[None].astype(np.float32)).reshape(-1)
                names = labels or [f"label_{i}" for i in range(len(score))]
                out.append((track, vector.astype(float).tolist(), dict(zip(names, score.astype(float).tolist(), strict=False))))
            yield pd.DataFrame(out, columns=["track_id", "embedding", "tags"])

    return clips.mapInPandas(run, "track_id string, embedding array<double>, tags map<string,double>")


def number(document: Column, path: str) -> Column:
    """A JSON number at ``path``; anything else is null."""
    text = F.get_json_object(document, path)
    return F.when(text.rlike(r"^-?\d"), text.try_cast("double"))


# Where the scalars lie in the high-level and low-level documents.
HIGH = {"danceable": "$.highlevel.danceability.all.danceable", "happy": "$.highlevel.mood_happy.all.happy", "acoustic": "$.highlevel.mood_acoustic.all.acoustic", "instrumental": "$.highlevel.voice_instrumental.all.instrumental", "aggressive": "$.highlevel.mood_aggressive.all.aggressive", "relaxed": "$.highlevel.mood_relaxed.all.relaxed"}
LOW = {"bpm": "$.rhythm.bpm", "average_loudness": "$.lowlevel.average_loudness"}


def raw_scalars(high: DataFrame, low: DataFrame) -> DataFrame:
    """mbid and the scalars of its documents (mbid, document); low-level ones count for ids with a high-level document only, and a row without any value is a miss (``hit`` false)."""
    own = low.join(high.select("mbid"), "mbid", "left_semi").withColumnRenamed("document", "low_document")
    wide = high.join(own, "mbid", "left")
    picked = wide.select("mbid", *(number(F.col("document"), p).alias(n) for n, p in HIGH.items()), *(number(F.col("low_document"), p).alias(n) for n, p in LOW.items()))
    return picked.withColumn("hit", F.coalesce(*HIGH, *LOW).isNotNull())


def build_report(wanted: DataFrame, cache: DataFrame, scalars: DataFrame) -> DataFrame:
    """One row: ids asked for, already cached (misses too), fetched now, and hits and misses among those."""
    ids = wanted.select("mbid").distinct()
    known, got = cache.select("mbid", F.lit(1).alias("c")), scalars.select("mbid", "hit")
    wide = ids.join(known, "mbid", "left").join(got, "mbid", "left")
    new = F.col("c").isNull()
    hit = F.coalesce("hit", F.lit(False))
    return wide.agg(F.count("*").alias("asked"), F.count_if(~new).alias("cached"), F.count_if(new).alias("fetched"), F.count_if(new & hit).alias("hits"), F.count_if(new & ~hit).alias("misses"))
