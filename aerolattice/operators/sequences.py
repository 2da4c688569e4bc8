"""Operators that need a whole sequence at once: one task holds one sequence, which is as long as its flight."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chained_poses(df: DataFrame) -> DataFrame:
    """(seq, ord, x, y, z, rotation) of camera-to-world poses from relative ones (rel array of 9, tx, ty, tz, ok).

    Each step adds the turned, reversed shift and then the reversed turn; where ``ok`` is false the pose holds.
    """

    def fold(key: tuple, frames: pd.DataFrame) -> pd.DataFrame:
        rotation, centre, rows = np.eye(3), np.zeros(3), []
        for f in frames.sort_values("ord").itertuples(index=False):
            if f.ok:
                turn = np.asarray(f.rel, float).reshape(3, 3)
                centre = centre - rotation @ turn.T @ np.array([f.tx, f.ty, f.tz])
                rotation = rotation @ turn.T
            rows.append((key[0], f.ord, *centre, rotation.reshape(-1).tolist()))
        return pd.DataFrame(rows, columns=["seq", "ord", "x", "y", "z", "rotation"])

    return df.groupBy("seq").applyInPandas(fold, "seq long, ord long, x double, y double, z double, rotation array<double>")


def natural_spline(t: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Values at ``at`` of the cubic spline through (t, y) whose second derivative is 0 at both ends."""
    n = len(t)
    if n < 3:
        return np.interp(at, t, y)
    h = np.diff(t)
    slope = np.diff(y) / h
    ahead, left = [0.0] * n, [0.0] * n  # elimination of a system of three diagonals, forth and back
    for k, (low, high, turn) in enumerate(zip(h[:-1].tolist(), h[1:].tolist(), (6 * np.diff(slope)).tolist(), strict=True), 1):
        pivot = 2 * (low + high) - low * ahead[k - 1]
        ahead[k], left[k] = high / pivot, (turn - low * left[k - 1]) / pivot
    m = np.zeros(n)
    for k in range(n - 2, 0, -1):
        m[k] = left[k] - ahead[k] * m[k + 1]
    k = np.clip(np.searchsorted(t, at, side="right") - 1, 0, n - 2)
    a, b = t[k + 1] - at, at - t[k]
    return (m[k] * a**3 + m[k + 1] * b**3) / (6 * h[k]) + (y[k] / h[k] - m[k] * h[k] / 6) * a + (y[k + 1] / h[k] - m[k + 1] * h[k] / 6) * b


def resampled(df: DataFrame, channels: list[str], target: float, rate: float = 30.0, position: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """``df`` (seq, ord, channels) with more frames where its top speed is beyond ``target`` metres a second.

    The number of frames grows by the ratio of the speeds, rounded up, and each channel follows the natural
    spline through the old frames. Slower sequences stay as they are.
    """

    def stretch(key: tuple, frames: pd.DataFrame) -> pd.DataFrame:
        frames = frames.sort_values("ord")
        values = frames[channels].to_numpy(float)
        steps = np.linalg.norm(np.diff(frames[list(position)].to_numpy(float), axis=0), axis=1)
        top = steps.max() * rate if len(steps) else 0.0
        n = int(np.ceil(len(frames) * top / target)) if top > target else len(frames)
        if n > len(frames):
            old, new = np.linspace(0, 1, len(frames)), np.linspace(0, 1, n)
            values = np.stack([natural_spline(old, values[:, k], new) for k in range(len(channels))], axis=1)
        out = pd.DataFrame(values, columns=channels)
        out.insert(0, "ord", np.arange(len(out)))
        out.insert(0, "seq", key[0])
        return out

    return df.select("seq", "ord", *channels).groupBy("seq").applyInPandas(stretch, "seq long, ord long, " + ", ".join(f"{c} double" for c in channels))


def smooth_noise(n: int, scale: float, width: float, rng: np.random.RandomState) -> np.ndarray:
    """Normal noise under a Gaussian of ``width`` frames, brought to the standard deviation ``scale``."""
    raw = rng.normal(size=n)
    reach = int(4 * width + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / width) ** 2)
    out = np.convolve(np.pad(raw, reach, mode="symmetric" if n >= reach else "edge"), kernel / kernel.sum(), mode="valid")[:n]
    return out * (scale / out.std()) if n > 1 and out.std() > 0 else out * 0


def perturbed(df: DataFrame, channels: dict[str, float], seed: int = 42, slow: float = 15.0, fast: float = 3.0, fast_weight: float = 0.3) -> DataFrame:
    """``df`` (seq, ord, channels) with correlated noise of the given deviation on each channel.

    Noise has a slow and a fast band. Seeds follow from ``seed``, the sequence and the channel's place, so a
    rerun after a lost executor gives the same.
    """
    names = list(channels)

    def disturb(key: tuple, frames: pd.DataFrame) -> pd.DataFrame:
        frames = frames.sort_values("ord").reset_index(drop=True)
        for k, (name, scale) in enumerate(channels.items()):
            rng = np.random.RandomState((seed * 1_000_003 + int(key[0]) * 101 + k) % (1 << 32))
            both = (1 - fast_weight) * smooth_noise(len(frames), 1.0, slow, rng) + fast_weight * smooth_noise(len(frames), 1.0, fast, rng)
            frames[name] = frames[name] + (both * scale / both.std() if both.std() > 0 else 0.0)
        return frames

    return df.select("seq", "ord", *names).groupBy("seq").applyInPandas(disturb, "seq long, ord long, " + ", ".join(f"{c} double" for c in names))


#: A sudden jitter over four frames, as shares of its strength.
JITTER = (0.6, -0.35, 0.15, -0.05)


def jittered(df: DataFrame, channel: str, strength: float, share: float = 0.2, seed: int = 42) -> DataFrame:
    """``df`` (seq, ord, channel) with one damped spike in about ``share`` of the sequences.

    Whether and where follows from a hash of the sequence, so no state is drawn in order.
    """
    chosen = F.pmod(F.xxhash64(F.lit(seed), "seq"), F.lit(10_000)) < share * 10_000
    n = df.groupBy("seq").agg(F.count("*").alias("_n")).where(chosen)
    start = F.pmod(F.xxhash64(F.lit(seed + 1), "seq"), F.greatest(F.col("_n") - len(JITTER), F.lit(1)))
    spikes = n.select("seq", start.alias("_start")).select("seq", F.posexplode(F.array(*[F.lit(strength * s) for s in JITTER])).alias("_k", "_add"), "_start")
    spikes = spikes.select("seq", (F.col("_start") + F.col("_k")).alias("ord"), "_add")
    return df.join(spikes, ["seq", "ord"], "left").withColumn(channel, F.col(channel) + F.coalesce("_add", F.lit(0.0))).drop("_add")


def gusts(df: DataFrame, channel: str, strength: float, frames: int = 120, share: float = 0.4, seed: int = 42) -> DataFrame:
    """``df`` (seq, ord, channel) with a gust in about ``share`` of the blocks of ``frames`` frames, swelling and fading as a Hann window."""
    block = F.floor(F.col("ord") / frames)
    blows = F.pmod(F.xxhash64(F.lit(seed), "seq", block), F.lit(10_000)) < share * 10_000
    sign = F.when(F.pmod(F.xxhash64(F.lit(seed + 1), "seq", block), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    envelope = 0.5 - 0.5 * F.cos(2 * np.pi * F.pmod(F.col("ord"), F.lit(frames)) / frames)
    return df.withColumn(channel, F.col(channel) + F.when(blows, sign * strength * envelope).otherwise(0.0))


#: Order of the low-pass filter, frames from which on there is noise, and the largest cut-off as a share of half the frame rate.
ORDER, LEAST_FRAMES, MOST_CUTOFF = 5, 13, 0.95
#: Parts of the noise of each channel at level 1: amplitude (metres or degrees) and cut-off in Hz.
NOISE = {"x": ((0.14, 0.3), (0.06, 2.0)), "y": ((0.14, 0.3), (0.06, 2.0)), "z": ((0.07, 0.2), (0.03, 2.0)), "roll": ((0.3, 1.5),), "pitch": ((0.3, 1.5),), "yaw": ((0.2, 0.5),)}
#: Degrees of latitude and longitude of a metre, about.
LATITUDE, LONGITUDE = 1 / 111320, 1 / 65000


def butterworth(cutoff: float, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of the digital low-pass filter, of what comes in and of what goes out; ``cutoff`` is a share of half the frame rate."""
    poles = 4 * np.tan(np.pi * cutoff / 2) * np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    out = np.real(np.poly((4 + poles) / (4 - poles)))
    into = np.poly(-np.ones(order))
    return into * out.sum() / into.sum(), out


def filtered_both_ways(x: np.ndarray, cutoffs: list[float]) -> np.ndarray:
    """Columns of ``x`` through their low-pass filters forth and back, so that nothing is shifted in time.

    Ends are continued by their mirror image through the last value, over 18 frames or as many as there are; the filters begin
    in the state that the first value would have left them in for ever. All columns go on together, frame by frame.
    """
    reach = min(3 * (ORDER + 1), len(x) - 1)
    into, out = (np.array(c) for c in zip(*map(butterworth, cutoffs), strict=True))
    steady = np.stack([np.linalg.solve(np.eye(ORDER) - np.column_stack([-a[1:], np.eye(ORDER)[:, :-1]]), b[1:] - a[1:] * b[0]) for b, a in zip(into, out, strict=True)], axis=1)
    long = np.concatenate([2 * x[0] - x[reach:0:-1], x, 2 * x[-1] - x[-2 : -reach - 2 : -1]])
    for _ in range(2):
        state, now = np.vstack([steady * long[0], np.zeros(long.shape[1])]), np.empty_like(long)
        for k, value in enumerate(long):
            now[k] = into[:, 0] * value + state[0]
            state[:-1] = state[1:] + into[:, 1:].T * value - out[:, 1:].T * now[k]
        long = now[::-1]
    return long[reach : reach + len(x)]


def correlated_noise(n: int, rate: float, parts: list[tuple[float, float]], rng: np.random.RandomState) -> np.ndarray:
    """A column for each of ``parts`` (amplitude, cut-off in Hz): normal noise below the cut-off, of that standard deviation; zeros under LEAST_FRAMES."""
    if n < LEAST_FRAMES:
        return np.zeros((n, len(parts)))
    smooth = filtered_both_ways(rng.normal(size=(n, len(parts))), [min(cutoff / (rate / 2), MOST_CUTOFF) for _, cutoff in parts])
    deviation = smooth.std(axis=0)
    return np.where(deviation > 1e-10, smooth / np.maximum(deviation, 1e-300), smooth) * np.where(deviation > 1e-10, [a for a, _ in parts], 1.0)


def with_noise(df: DataFrame, level: float, rate: float = 30.0, seed: int = 42) -> DataFrame:
    """``df`` (seq, ord, x, y, z, roll, pitch, yaw, and latitude, longitude, altitude if it has them) as a drone's sensors shake and drift.

    Each channel gets its parts of NOISE times ``level``; places on the globe move by as many metres as x, y and z. Sequences of fewer than
    LEAST_FRAMES, and all of them at level 0 or less, stay as they are. Noise follows from ``seed`` and the sequence, so a rerun gives the same.
    """
    globe = {name: (of, by) for name, of, by in (("latitude", "x", LATITUDE), ("longitude", "y", LONGITUDE), ("altitude", "z", 1.0)) if name in df.columns}
    names = [*NOISE, *globe]
    parts = [(level * a, cutoff) for bands in NOISE.values() for a, cutoff in bands]

    def shake(key: tuple, frames: pd.DataFrame) -> pd.DataFrame:
        frames = frames.sort_values("ord").reset_index(drop=True)
        if level <= 0 or len(frames) < LEAST_FRAMES:
            return frames
        noise, at, added = correlated_noise(len(frames), rate, parts, np.random.RandomState((seed * 1_000_003 + int(key[0]) * 101) % (1 << 32))), 0, {}
        for name, bands in NOISE.items():
            added[name] = noise[:, at : at + len(bands)].sum(axis=1)
            at += len(bands)
            frames[name] = frames[name] + added[name]
        for name, (of, by) in globe.items():
            frames[name] = frames[name] + added[of] * by
        return frames

    kinds = dict(df.dtypes)
    own = df.select("seq", "ord", *(F.col(c).cast("double").alias(c) for c in names))
    return own.groupBy("seq").applyInPandas(shake, f"seq {kinds['seq']}, ord {kinds['ord']}, " + ", ".join(f"{c} double" for c in names))
