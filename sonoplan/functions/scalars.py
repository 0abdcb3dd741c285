"""Scalar functions: formats, names and small statistics, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def format_duration(seconds: Column | str) -> Column:
    """mm:ss, from an hour on h:mm:ss; halves round to even; null is ``?``."""
    s = F.greatest(F.bround(_c(seconds), 0).cast("bigint"), F.lit(0))
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return F.when(_c(seconds).isNull(), "?").when(h > 0, F.format_string("%d:%02d:%02d", h, m, s % 60)).otherwise(F.format_string("%02d:%02d", m, s % 60))


def format_size(n: Column | str) -> Column:
    """Bytes in the largest unit of 1024s up to TB, one decimal; null is ``?``."""
    n = _c(n).cast("double")
    out = F.when(n.isNull(), "?").when(n < 1024, F.format_string("%d B", n.cast("bigint")))
    for k, unit in enumerate(("KB", "MB", "GB"), 1):
        out = out.when(n < 1024.0 ** (k + 1), F.format_string(f"%.1f {unit}", n / 1024.0**k))
    return out.otherwise(F.format_string("%.1f TB", n / 1024.0**4))


def suffix(path: Column | str) -> Column:
    """Lower-cased extension with its dot, or empty."""
    return F.lower(F.regexp_extract(_c(path), r"[^/](\.[^./]+)$", 1))


def basename(path: Column | str) -> Column:
    return F.regexp_extract(_c(path), r"([^/]*)/*$", 1)


def truncate(text: Column | str, limit: int = 120) -> Column:
    """At most ``limit`` characters, the last one an ellipsis where it was longer."""
    t = _c(text)
    return F.when(F.length(t) > limit, F.concat(F.rtrim(F.substring(t, 1, limit - 1)), F.lit("…"))).otherwise(t)


def notes(message: Column | str) -> Column:
    """Notes of a status message, split at semicolons, blanks dropped."""
    return F.filter(F.transform(F.split(F.coalesce(_c(message), F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")


def warnings(status: Column | str, message: Column | str) -> Column:
    """What a banner shows: the message of an error, else the notes on failed or unavailable models."""
    error = F.array(F.coalesce(_c(message), F.lit("Analysis failed")))
    return F.when(_c(status) == "error", error).otherwise(F.filter(notes(message), lambda n: F.contains(n, F.lit("failed:")) | F.contains(n, F.lit("unavailable"))))


def log_score(score: Column | str) -> Column:
    s = _c(score)
    return F.when(s <= 0, "— (score 0)").otherwise(F.format_string("%.2f", F.log10(s)))


def slug(name: Column | str) -> Column:
    """File-name form of a playlist name."""
    out = F.regexp_replace(F.regexp_replace(F.trim(_c(name)), r"(?U)[^\w-]+", "_"), "^_+|_+$", "")
    return F.when(out == "", "playlist").otherwise(out)


def search_label(algorithm: Column | str, dataset: Column | str, noise: Column | str) -> Column:
    """``algorithm:dataset``, and the noise methods where there are any."""
    n = _c(noise)
    return F.concat(_c(algorithm), F.lit(":"), _c(dataset), F.when(F.size(n) > 0, F.concat(F.lit("+"), F.array_join(n, "+"))).otherwise(""))


def reduction_name(method: Column | str, k: Column | str, source: Column | str) -> Column:
    m = _c(method)
    label = F.when(m == "pca", "PCA").when(m == "umap", "UMAP").when(m == "tsne", "t-SNE").otherwise(m)
    return F.format_string("%s-%d of %s", label, _c(k), F.coalesce(_c(source), F.lit("model")))


def geometric_mean(x: Column | str) -> Column:
    """Aggregate: geometric mean; 0 where a value is 0 or less, or there is none."""
    x = _c(x)
    return F.when(F.min(x) > 0, F.exp(F.avg(F.ln(x)))).otherwise(0.0)


def entropy_bits(x: Column | str) -> Column:
    """Aggregate-free Shannon entropy of the squares of an array, in bits; 0 without power."""
    p = F.transform(_c(x), lambda v: v * v)
    total = F.aggregate(p, F.lit(0.0), lambda s, v: s + v)
    terms = F.transform(p, lambda v: F.when(v > 0, -(v / total) * F.log2(v / total)).otherwise(0.0))
    return F.when(total > 0, F.aggregate(terms, F.lit(0.0), lambda s, v: s + v)).otherwise(0.0)


def padded_range(lo: Column | str, hi: Column | str) -> tuple[Column, Column]:
    """Axis limits: 5 % of room on each side; half a unit around a single value."""
    lo, hi = _c(lo), _c(hi)
    pad = F.when(lo == hi, 0.5).when(hi - lo < 1e-12, F.greatest(F.abs(lo) * 0.05, F.lit(1e-6))).otherwise((hi - lo) * 0.05)
    return F.coalesce(lo - pad, F.lit(0.0)), F.coalesce(hi + pad, F.lit(1.0))


def tag_model(name: Column | str) -> Column:
    """The part after ``ollama:`` of a text dataset's name, else null."""
    return F.when(_c(name).startswith("ollama:"), F.substring(_c(name), 8, 1 << 20))
