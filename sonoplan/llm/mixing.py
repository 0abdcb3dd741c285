"""Mixing sources to target weights.

Words (or any token size) are summed per source; a capped proportional split gives
every source its target; the repetition rate of a source is target / size. A document
is emitted floor(rate) times plus one more time with probability equal to the
fraction, decided by a hash of its id, text, source and a seed, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, n_words, text_key

#: More sources than this are joined by a shuffle instead of a broadcast.
BROADCAST_SOURCES = 20_000


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3) -> DataFrame:
    """One row per source: source, source_size, weight, target.

    Sources are taken in code point order (null last) and get the weights in turn.
    The targets share the total of all sizes by weight; none exceeds ``max_repeat``
    times its source, and the excess is reshared by weight. That fixed point is a
    water level: sorted by cap / weight, a source is capped exactly when the level of
    the sources not before it reaches its cap, so prefix sums give it without a loop.
    The windows run over one row per source, after aggregation.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int")).cast("long")
    per = per.withColumn("weight", w).withColumn("cap", F.col("source_size") * max_repeat)
    rank = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, every = rank.rowsBetween(W.unboundedPreceding, -1), W.partitionBy(F.lit(0))
    per = per.select(
        "source", "source_size", "weight", "cap",
        F.sum("source_size").over(every).alias("total"), F.sum("weight").over(every).alias("all_weight"),
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("cap_before"),
        F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("weight_before"),
    )
    level = (F.col("total") - F.col("cap_before")) / (F.col("all_weight") - F.col("weight_before"))
    per = per.withColumn("capped", F.col("cap") <= level * F.col("weight"))
    held = lambda c: F.sum(F.when(F.col("capped"), F.col(c)).otherwise(0)).over(every)
    per = per.withColumn("cap_held", held("cap")).withColumn("weight_held", held("weight"))
    left = (F.col("total") - F.col("cap_held")) / (F.col("all_weight") - F.col("weight_held"))
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(left * F.col("weight"))
    return per.select("source", "source_size", "weight", target.alias("target"))


def row_key(id_col: Column, text: Column, source: Column) -> Column:
    """Key of 128 bits (binary) of a row's id, text and source, null or not: rows that share it are taken
    at the same rate, so it doesn't matter which of them is which."""
    own = F.concat(F.lower(F.hex(text_key(id_col, text))), F.when(source.isNull(), "-").otherwise("+"), F.coalesce(source, F.lit("")))
    return F.unhex(F.md5(own.cast("binary")))


def uniform(key: Column, number: Column, seed: int) -> Column:
    """Number in [0, 1) from 52 bits of the hash of a row's key (binary) and its number among equal rows."""
    text = F.concat(F.lit(f"mix{seed}:"), F.lower(F.hex(key)), F.lit(":"), number.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def numbered_copies(rows: DataFrame, key: str, name: str) -> DataFrame:
    """``rows`` with ``name``: 1 for a row whose key occurs once, else its number among those that share it.

    Only rows that repeat are written and numbered, each partition's by themselves and after those of
    the partitions before, so that a key of any number of rows stays spread.
    """
    many = cut(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col(key).alias("_many")))
    if many.isEmpty():
        return rows.withColumn(name, F.lit(1).cast("bigint"))
    again = F.col(key) == F.col("_many")
    dealt = cut(rows.join(many, again).drop("_many").withColumn("_part", F.spark_partition_id()))
    own = W.partitionBy(key, "_part").orderBy(key)
    before = W.partitionBy("_k").orderBy("_p").rowsBetween(W.unboundedPreceding, -1)  # a row per partition and key
    starts = dealt.groupBy(F.col(key).alias("_k"), F.col("_part").alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.select("_k", "_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    again_rows = dealt.withColumn("_own", F.row_number().over(own)).join(starts, (F.col(key) == F.col("_k")) & (F.col("_part") == F.col("_p")))
    again_rows = again_rows.select(*rows.columns, (F.col("_start") + F.col("_own")).cast("bigint").alias(name))
    return rows.join(many, again, "left_anti").withColumn(name, F.lit(1).cast("bigint")).unionByName(again_rows)


def mix_plan(docs: DataFrame, seed: int = 17, size: Column | None = None, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3) -> DataFrame:
    """``docs`` with size, source_size, target, rate and copies added (prefixed ``mix_``).

    Null text: size 0. A source without words has target 0 and no copies. Null sources
    form one source. Every row has a draw of its own: by its id (null ones too), text and source, and,
    where rows are equal in all, by a number among these. Empty table: empty result. Columns of ``docs``
    that are called mix_... give way.
    """
    docs = docs.drop(*[c for c in docs.columns if c.startswith("mix_")])
    sized = docs.withColumn("mix_size", n_words(F.col("text")) if size is None else size)
    sized = sized.withColumn("mix_key", row_key(F.col("doc_id"), F.col("text"), F.col("source")))
    targets = cut(source_targets(sized.select("source", F.col("mix_size").alias("size")), weights, max_repeat))
    targets = targets.select(F.col("source").alias("mix_source"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"))
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    rate = F.when(F.col("mix_source_size") > 0, F.col("mix_target") / F.col("mix_source_size")).otherwise(0.0)
    drawn = numbered_copies(sized, "mix_key", "mix_number")
    out = drawn.join(targets, F.col("source").eqNullSafe(F.col("mix_source"))).drop("mix_source").withColumn("mix_rate", rate)
    whole = F.floor("mix_rate")
    extra = (uniform(F.col("mix_key"), F.col("mix_number"), seed) < F.col("mix_rate") - whole).cast("long")
    return out.withColumn("mix_copies", F.least(whole + extra, F.lit(max_repeat).cast("long"))).drop("mix_key", "mix_number")


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as the mix takes it, with mix_copy 1, 2, ..."""
    planned = mix_plan(docs, **options)
    taken = planned.where("mix_copies > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_copies"))))
    return taken.select(*[c for c in docs.columns if not c.startswith("mix_")], "mix_copy")


def op2_mix(spark, sf_dir):
    """doc_id, size, source_size, target and words taken, for every document.

    Nulls, empty and very long texts, repeated rows, ties, empty tables: as in mix_plan.
    """
    from .common import table

    p = mix_plan(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return p.select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"), (F.col("mix_copies") * F.col("mix_size")).alias("taken"),
    )


OP2_SQL = r"""
WITH d AS (SELECT doc_id, source, md5(md5(coalesce(doc_id::VARCHAR, '') || CASE WHEN text IS NULL THEN '-' ELSE '+' END || coalesce(text, '')) || CASE WHEN source IS NULL THEN '-' ELSE '+' END || coalesce(source, '')) AS key, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY encode(source) ASC NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
q AS (SELECT *, source_size * 3 AS cap, (sum(source_size) OVER ())::BIGINT AS total, (sum(weight) OVER ())::BIGINT AS all_weight,
  coalesce(sum(source_size * 3) OVER r, 0)::BIGINT AS cap_before, coalesce(sum(weight) OVER r, 0)::BIGINT AS weight_before
  FROM p WINDOW r AS (ORDER BY source_size * 3 / weight ASC, encode(source) ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, cap <= ((total - cap_before) / (all_weight - weight_before)) * weight AS capped FROM q),
h AS (SELECT *, (sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ())::BIGINT AS cap_held, (sum(CASE WHEN capped THEN weight ELSE 0 END) OVER ())::BIGINT AS weight_held FROM c),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE ((total - cap_held) / (all_weight - weight_held)) * weight END AS target FROM h),
j AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
  ('0x' || substr(md5('mix17:' || d.key || ':' || row_number() OVER (PARTITION BY d.key)), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (least(floor(rate)::BIGINT + (u < rate - floor(rate))::BIGINT, 3) * size)::BIGINT AS taken FROM j
"""
