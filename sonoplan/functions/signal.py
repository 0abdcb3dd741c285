"""Signal arithmetic: chunk plans and resampling as Column expressions, spectra in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Band edges in Hz; the last band reaches the Nyquist frequency.
BANDS = ((0.0, 50.0), (50.0, 300.0), (300.0, 1000.0), (1000.0, 5000.0), (5000.0, 15000.0), (15000.0, None))
#: Names of a band's statistics and of the whole spectrum's.
BAND_STATS = ("mean", "std", "skew", "kurtosis", "RMS", "crest")
WHOLE_STATS = ("dominant frequency (×Nyquist)", "spectral centroid (×Nyquist)", "spectral entropy (×bins)", "Hurst exponent")
FEATURES = len(BANDS) * len(BAND_STATS) + len(WHOLE_STATS)
CLIP, LOG_FLOOR = 10.0, 1e-12


def feature_names() -> list[str]:
    span = lambda lo, hi: f"{lo:g} Hz+" if hi is None else f"{lo:g}–{hi:g} Hz"
    return [f"{span(*b)} {s}" for b in BANDS for s in BAND_STATS] + list(WHOLE_STATS)


# --- plans of chunks and windows ---------------------------------------------------------


def _samples(seconds: float, rate: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(F.lit(float(seconds)) * rate, 0).cast("bigint"))


def chunk_plan(n: Column | str, rate: Column | str, seconds: float = 20.0, overlap_percent: float = 50.0) -> Column:
    """array<struct<idx, start, stop, start_sec, end_sec>> of a signal of ``n`` samples.

    Overlap is held to 0..95 %. A last chunk under a quarter of the length is merged into the
    one before it; a short signal is one chunk, an empty one none.
    """
    if seconds <= 0:
        raise ValueError("chunk length must be positive")
    n, rate = (F.col(x) if isinstance(x, str) else x for x in (n, rate))
    size, tail = _samples(seconds, rate), _samples(seconds * 0.25, rate)
    hop = _samples(seconds * (1 - min(max(float(overlap_percent), 0.0), 95.0) / 100), rate)
    # The first chunk that reaches the end is the last one.
    last = F.greatest(F.lit(0), F.ceil((n - size) / hop)).cast("bigint")
    merge = (last > 0) & (n - last * hop < tail)
    count = F.when(merge, last - 1).otherwise(last)
    one = lambda i: F.struct(i.cast("int").alias("idx"), (i * hop).alias("start"), F.when(i == count, n).otherwise(F.least(i * hop + size, n)).alias("stop"))
    plan = F.transform(F.sequence(F.lit(0).cast("bigint"), count), one)
    plan = F.transform(plan, lambda c: F.struct(c["idx"].alias("idx"), c["start"].alias("start"), c["stop"].alias("stop"), (c["start"] / rate).alias("start_sec"), (c["stop"] / rate).alias("end_sec")))
    return F.when(n > 0, plan).otherwise(F.array().cast("array<struct<idx:int,start:bigint,stop:bigint,start_sec:double,end_sec:double>>"))


def resampled_size(n: Column | str, rate: int, target: int) -> Column:
    if rate <= 0 or target <= 0:
        raise ValueError("rates must be positive")
    n = F.col(n) if isinstance(n, str) else n
    return F.when(n > 0, F.greatest(F.lit(1), F.bround(n * F.lit(float(target)) / rate, 0).cast("bigint"))).otherwise(0)


def resample(x: Column | str, rate: int, target: int) -> Column:
    """Linear interpolation of an array of samples with both ends in place."""
    x = (F.col(x) if isinstance(x, str) else x).cast("array<double>")
    if rate == target:
        return x
    n, m = F.size(x), resampled_size(F.size(x), rate, target)
    step = F.when(m > 1, (n - 1) / (m - 1)).otherwise(0.0)

    def at(k: Column) -> Column:
        p = F.least(k * step, (n - 1).cast("double"))
        i = F.least(F.floor(p), F.greatest(n - 2, F.lit(0))).cast("int")
        a, b = F.get(x, i), F.coalesce(F.get(x, i + 1), F.get(x, i))
        return a + (b - a) * (p - i)

    return F.when(m > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), m - 1), at)).otherwise(F.array().cast("array<double>"))


def window_starts(n: Column | str, size: int, overlap: int) -> Column:
    """Starts of full windows that reach the end: a short rest moves the last one, a long one adds one."""
    n = F.col(n) if isinstance(n, str) else n
    step = max(size - overlap, 1)
    k = F.floor((n - size) / step)
    last, tail = k * step, n - size
    plain = F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"), F.lit(step).cast("bigint"))
    moved = F.concat(F.slice(plain, F.lit(1), (F.size(plain) - 1).cast("int")), F.array(tail.cast("bigint")))
    added = F.concat(plain, F.array(tail.cast("bigint")))
    out = F.when(tail <= last, plain).when(tail - last >= size // 4, added).otherwise(moved)
    return F.when(n <= size, F.array(F.lit(0).cast("bigint"))).otherwise(out)


def plain_windows(n: Column | str, size: int) -> Column:
    """(start, stop) of consecutive windows, the rest last; one under two samples is dropped."""
    n = F.col(n) if isinstance(n, str) else n
    starts = F.sequence(F.lit(0).cast("bigint"), F.greatest(n - 1, F.lit(0)).cast("bigint"), F.lit(max(2, size)).cast("bigint"))
    w = F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s + max(2, size), n.cast("bigint")).alias("stop")))
    return F.when(n <= max(2, size), F.slice(w, 1, 1)).otherwise(F.filter(w, lambda x: x["stop"] - x["start"] >= 2))


def moment_stats(x: Column | str) -> Column:
    """struct(mean, std, skew, kurtosis) of an array: population moments, excess kurtosis; flat is 0."""
    x = (F.col(x) if isinstance(x, str) else x).cast("array<double>")
    n = F.size(x)
    mean = F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / n
    central = lambda k: F.aggregate(x, F.lit(0.0), lambda s, v: s + F.pow(v - mean, F.lit(float(k)))) / n
    var = central(2)
    flat = ~(var > 0)
    return F.struct(mean.alias("mean"), F.sqrt(var).alias("std"), F.when(flat, 0.0).otherwise(central(3) / F.pow(var, F.lit(1.5))).alias("skew"), F.when(flat, 0.0).otherwise(central(4) / (var * var) - 3).alias("kurtosis"))


# --- numpy -------------------------------------------------------------------------------


def amplitudes(x: np.ndarray) -> np.ndarray:
    """One-sided amplitudes under a symmetric Hann window; the mean is not doubled."""
    n = len(x)
    a = np.abs(np.fft.rfft(x * np.hanning(n))) / n
    a[1:] *= 2
    return a


#: The smallest window and the number of window sizes of the rescaled-range fit.
HURST_LEAST, HURST_SIZES = 8, 6


def rescaled_range(x: np.ndarray, size: int) -> float:
    """Mean of R / S over the whole windows of ``size`` samples that aren't flat; nan without any.

    R is the span of the summed deviations from the window's mean, S the deviation.
    """
    n = len(x) // size
    sums = np.concatenate([[0.0], np.cumsum(x[: n * size])])
    edges = sums[::size]
    slope = np.diff(edges) / size
    inside = sums[1:].reshape(n, size) - edges[:-1, None] - slope[:, None] * np.arange(1, size + 1)
    spread = np.array([w.std() for w in np.split(x[: n * size], n)])
    live = spread > 0
    return float(np.mean((inside.max(1) - inside.min(1))[live] / spread[live])) if live.any() else np.nan


def hurst(x: np.ndarray) -> float:
    """Hurst exponent, 0 to 1: how log(R / S) grows with log(window size); 0.5 where it can't be told."""
    x = np.asarray(x, np.float64)
    if len(x) < HURST_LEAST or np.ptp(x) == 0:
        return 0.5
    ladder = np.unique(np.rint(np.geomspace(HURST_LEAST, max(HURST_LEAST, len(x) // 2), HURST_SIZES)).astype(int))
    points = np.log([(m, rescaled_range(x, m)) for m in ladder if 2 * m <= len(x)] or [(1.0, np.nan)])
    points = points[np.isfinite(points).all(1)]
    if len(points) < 2:
        return 0.5
    dx, dy = (points - points.mean(0)).T
    return float(min(max(dx @ dy / (dx @ dx), 0.0), 1.0))


def _band_table(a: np.ndarray, f: np.ndarray, loud: float) -> np.ndarray:
    """(bands, statistics): all bands at once, as sums over the band number of each frequency."""
    band = np.searchsorted([lo for lo, _ in BANDS], f, side="right") - 1
    total = lambda w: np.bincount(band, w, len(BANDS))
    n = np.bincount(band, minlength=len(BANDS))
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = total(a) / n
        d = a - mean[band]
        var, third, fourth = (total(d**k) / n for k in (2, 3, 4))
        rms = np.sqrt(total(a * a) / n)
        top = np.zeros(len(BANDS))
        np.maximum.at(top, band, a)
        table = np.stack([mean / loud, np.sqrt(var) / loud, third / var**1.5, fourth / var**2 - 3, rms / loud, top / rms], 1)
    return np.where(np.isfinite(table), table, 0.0)


def window_features(x: np.ndarray, rate: int) -> np.ndarray:
    """The FEATURES statistics of one window; silence is all zeros.

    The entropy is that of the squared power shares, as stored vectors of this kind have it.
    """
    x = np.asarray(x, np.float64)
    a = amplitudes(x) if len(x) >= 2 and rate > 0 else np.zeros(1)
    if not (a > 0).any():
        return np.zeros(FEATURES)
    f = np.fft.rfftfreq(len(x), 1 / rate)
    share = (a / a.max()) ** 4
    share = share[share > 0] / share.sum()
    bits = -(share @ np.log2(share)) / np.log2(max(2, len(a)))
    whole = [f[a.argmax()] * 2 / rate, np.average(f, weights=a) * 2 / rate, bits, hurst(np.log10(a + LOG_FLOOR))]
    out = np.concatenate([_band_table(a, f, float(np.linalg.norm(x) / np.sqrt(len(x)))).ravel(), whole])
    return np.where(np.isfinite(out), out, 0.0)


def chunk_features(x: np.ndarray, rate: int, window_sec: float = 1.0) -> np.ndarray:
    """Raw statistics of a chunk: the mean over its windows."""
    x = np.asarray(x, np.float64).reshape(-1)
    if not len(x) or rate <= 0:
        return np.zeros(FEATURES)
    size = max(2, int(round(window_sec * rate)))
    parts = [x] if len(x) <= size else [x[s : s + size] for s in range(0, len(x), size) if len(x) - s >= 2]
    return np.mean([window_features(p, rate) for p in parts], axis=0)


def feature_vector(x: np.ndarray, rate: int, window_sec: float = 1.0) -> np.ndarray:
    """chunk_features held to +-CLIP and scaled to unit length."""
    v = np.clip(chunk_features(x, rate, window_sec), -CLIP, CLIP)
    n = np.linalg.norm(v)
    return (v / n if n > 0 else v).astype(np.float32)
