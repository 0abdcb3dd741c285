"""Line dedup by a log-template tree, in DataFrame functions only.

A line goes down a tree of fixed depth: number of tokens, then its leading tokens. Tokens
that hold a digit are variable and read as ``<*>``. Below that leaf a template keeps the
tokens at most positions and leaves a run of positions variable: the tokens after the
leading ones are cut into three bands, and each template of the line has one band open.
Two lines of a leaf that differ within one band thus share a template, as similar as two
thirds of their tokens; no pair of lines is ever compared. Lines of fewer than
``general_from`` tokens, or with under two thirds of their tokens constant, have the one
template without an open band; lines of which less than half is constant are data (rows of
a table, say) and have none, nor have lines under ``min_tokens`` tokens.

Besides, every line but a blank one is the leaf of its own tokens, digits and all.

A template that occurs in ``min_docs`` documents or more is boilerplate, and so is a line that
occurs as it is in ``min_same`` documents: it stays in the document of least doc_id and goes
from all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

LEADING = 2
BANDS = 3
VARIABLE = r"(?<!\S)[^\s0-9]*+[0-9]\S*"


def text_lines(text: Column) -> Column:
    """Lines with white space as single blanks: array<string>."""
    return F.split(F.regexp_replace(text, r"[ \t\x0B\f\r]{2,}|[\t\x0B\f\r]", " "), "\n", -1)


def line_tokens(line: Column) -> Column:
    """Tokens of a line, variable ones as ``<*>``."""
    # The costlier expression is for lines with a digit alone.
    masked = F.when(line.rlike("[0-9]"), F.regexp_replace(line, VARIABLE, "<*>")).otherwise(line)
    return F.split(F.trim(masked), " ", -1)


def _template(t: Column, band: int) -> Column:
    n = F.size(t)
    at = lambda k: (F.lit(LEADING) + F.floor((n - LEADING) * k / BANDS)).cast("int")
    low, high = at(band), at(band + 1)
    return F.xxhash64(F.lit(band), n, F.slice(t, F.lit(1), low), F.slice(t, high + 1, n))


def leaf_id(line: Column) -> Column:
    """Id of a line as it is (odd); 63 bits of a hash: at 10^13 lines some in a million may fall together."""
    return F.xxhash64(F.lit(-2), line).bitwiseOR(F.lit(1).cast("bigint"))


def line_templates(text: Column, min_tokens: int, general_from: int) -> Column:
    """array<struct<id, leaf>> of a text, sorted: the leaf and the templates (even ids) of every
    different line; blank lines have none."""
    none = F.array().cast("array<bigint>")
    even = lambda h: h.bitwiseAND(F.lit(-2).cast("bigint"))
    constant = lambda t: F.size(F.filter(t, lambda x: x != "<*>"))
    general = lambda t: (
        F.when((F.size(t) < min_tokens) | (constant(t) * 2 < F.size(t)), none)
        .when((F.size(t) < general_from) | (constant(t) * 3 < F.size(t) * 2), F.array(even(F.xxhash64(F.lit(-1), F.size(t), t))))
        .otherwise(F.array(*[even(_template(t, band)) for band in range(BANDS)]))
    )
    # Each part is computed once and then referred to, so no lambda holds an expression twice.
    lines = F.array_remove(F.array_distinct(F.transform(text_lines(text), lambda line: F.trim(line))), "")
    parsed = F.transform(lines, lambda line: F.struct(leaf_id(line).alias("leaf"), line_tokens(line).alias("t")))
    pairs = lambda x: F.transform(F.concat(F.array(x["leaf"]), general(x["t"])), lambda i: F.struct(i.alias("id"), x["leaf"].alias("leaf")))
    return F.sort_array(F.flatten(F.transform(parsed, pairs)))


def dedup_lines(docs: DataFrame, min_docs: int = 3, min_same: int = 2, min_tokens: int = 3, general_from: int = 9) -> DataFrame:
    """``docs`` with text replaced by its kept lines, plus ld_lines and ld_dropped (line counts).

    Null text stays null with 0 lines; an empty text is one empty line, which stays, as all blank
    lines do. Each row counts as a document, but rows that share a doc_id drop nothing from one
    another. A null doc_id comes after all others. Very long texts are parsed whole. Empty table:
    empty result. Columns besides doc_id and text pass through, but for those called ld_..., which
    give way.
    """
    docs = docs.drop(*[c for c in docs.columns if c.startswith("ld_")])
    # A row is known by its id and 64 bits of its text.
    rows = docs.withColumn("ld_key", F.xxhash64("text"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col("ld_key").alias("key"))
    found = rows.select(order.alias("row"), line_templates(F.col("text"), min_tokens, general_from).alias("e"))
    # A document counts once for a template, at the first of the lines that share it.
    new = lambda x, i: F.struct(x["id"].alias("id"), x["leaf"].alias("leaf"), F.when((i > 0) & (F.get(F.col("e"), i - 1)["id"] == x["id"]), 0).otherwise(1).alias("new"))
    # Read twice below; written once, as parsing the lines is the costly part.
    seen = cut(found.select("row", F.explode(F.transform("e", new)).alias("x")).select("row", "x.id", "x.leaf", "x.new"))
    many = seen.groupBy("id").agg(F.sum("new").alias("n"), F.min("row").alias("keeper"))
    many = many.where(F.col("n") >= F.when(F.col("id").bitwiseAND(F.lit(1).cast("bigint")) == 1, min_same).otherwise(min_docs))
    gone = seen.join(many.select("id", "keeper"), "id").where(~F.col("row")["id"].eqNullSafe(F.col("keeper")["id"]))
    gone = gone.groupBy(F.col("row")["key"].alias("ld_key"), F.col("row")["id"].alias("ld_id")).agg(F.collect_set("leaf").alias("ld_gone"))
    rows = rows.withColumnRenamed("ld_key", "ld_row")
    both = rows.join(gone, (F.col("ld_row") == F.col("ld_key")) & F.col("doc_id").eqNullSafe(F.col("ld_id")), "left")
    lines = F.split("text", "\n", -1)
    dropped = F.transform(text_lines(F.col("text")), lambda line: F.array_contains("ld_gone", leaf_id(F.trim(line))))
    both = both.withColumn("ld_flags", F.when(F.col("ld_gone").isNotNull(), dropped))
    kept = F.transform(F.filter(F.arrays_zip(lines.alias("line"), F.col("ld_flags").alias("flag")), lambda z: ~z["flag"]), lambda z: z["line"])
    none = F.col("ld_flags").isNull()
    return both.select(
        *[F.when(none, F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text") if c == "text" else F.col(c) for c in docs.columns],
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("ld_lines"),
        F.when(none, 0).otherwise(F.size(F.filter("ld_flags", lambda x: x))).cast("long").alias("ld_dropped"),
    )


def op8_line_dedup(spark, sf_dir):
    """doc_id, n_lines, n_dropped and the hash of the kept text, for every document.

    Nulls, empty and very long texts, repeated rows, empty tables: as in dedup_lines.
    """
    from .common import table

    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("ld_lines").alias("n_lines"), F.col("ld_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, text, row_number() OVER () AS k FROM documents),
l AS (SELECT k, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d WHERE text IS NOT NULL),
w AS (SELECT *, string_split(trim(regexp_replace(line, '[ \t\x0B\f\r]+', ' ', 'g')), ' ') AS raw FROM l),
m AS (SELECT *, list_transform(raw, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS t FROM w WHERE raw <> ['']),
b AS (SELECT *, len(t) AS n, len(list_filter(t, lambda x: x <> '<*>')) AS c FROM m WHERE len(t) >= 3 AND len(list_filter(t, lambda x: x <> '<*>')) * 2 >= len(t)),
g AS (SELECT k, doc_id, pos, -1 AS band, n, t AS a, []::VARCHAR[] AS z FROM b WHERE n < 9 OR c * 3 < n * 2
 UNION ALL SELECT k, doc_id, pos, band, n, t[1:2 + (n - 2) * band // 3], t[2 + (n - 2) * (band + 1) // 3 + 1:] FROM b, (VALUES (0), (1), (2)) v(band) WHERE n >= 9 AND c * 3 >= n * 2
 UNION ALL SELECT k, doc_id, pos, -2, len(raw), raw, []::VARCHAR[] FROM m),
s AS (SELECT DISTINCT k, doc_id, band, n, a, z FROM g),
r AS (SELECT band, n, a, z, min(doc_id) AS keeper FROM s GROUP BY band, n, a, z HAVING count(*) >= CASE WHEN band = -2 THEN 2 ELSE 3 END),
gone AS (SELECT DISTINCT g.k, g.pos FROM g JOIN r ON g.band = r.band AND g.n = r.n AND g.a = r.a AND g.z = r.z WHERE g.doc_id IS DISTINCT FROM r.keeper),
o AS (SELECT l.k, count(*) AS n_lines, count(gone.pos) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY l.pos) FILTER (gone.pos IS NULL), '') AS kept FROM l LEFT JOIN gone ON l.k = gone.k AND l.pos = gone.pos GROUP BY l.k)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN o USING (k)
"""
