"""Fill-in-middle: a text cut in three, rearranged for training, and put together again.

Everything is one expression per row: ``regexp_extract_all`` gives the units (lines), 8-digit
groups of a ``sha2`` give the cuts, ``slice`` and ``array_join`` the arrangement. A row is judged
alone, so nothing is shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: Marks of prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Lines with their ends; what a possessive run has taken never has to be given back.
UNIT = r"[^\n]*+\n|[^\n]+"


def _checked(sentinels: tuple[str, str, str]) -> None:
    """Marks must be told apart wherever they stand: none may end as one begins."""
    for a in sentinels:
        for b in sentinels:
            if not a or any(a.endswith(b[:k]) for k in range(1, len(b) + (a != b))):
                raise ValueError(f"sentinels {a!r} and {b!r} can't be told apart")


def hash_number(id_col: Column, seed: int, k: int) -> Column:
    """The k-th 8-digit group (from 0) of the hash of ``seed:id``, as a number; a null id is empty text."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("bigint")


def fill_in_middle(docs: DataFrame, rate: int = 100, spm: int = 50, seed: int = 7, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """``docs`` with fim_units, fim_form, fim_prefix_chars, fim_middle_chars and fim_output.

    ``rate`` of 100 texts are rearranged, ``spm`` of 100 of these with the suffix first. A null text is
    an empty one; an empty text, one without luck or one that holds a sentinel stays as it is (``plain``,
    with null sizes). A null id is hashed as empty text; rows that share an id share the draw, and get
    cuts by their own number of lines. A text without line ends is one unit, of any length. Columns of
    ``docs`` that are called fim_... give way. Empty table: empty result.
    """
    _checked(sentinels)
    p, s, m = map(F.lit, sentinels)
    docs = docs.drop(*[c for c in docs.columns if c.startswith("fim_")])
    draw = lambda k: hash_number(F.col("doc_id"), seed, k)
    text = F.coalesce("text", F.lit(""))
    out = docs.withColumn("fim_lines", F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)))
    n = F.size("fim_lines").cast("bigint")
    held = F.contains(text, p) | F.contains(text, s) | F.contains(text, m)
    form = F.when((text == "") | held | (draw(2) % 100 >= rate), "plain").when(draw(3) % 100 < spm, "spm").otherwise("psm")
    out = out.withColumns({"fim_units": n, "fim_form": form, "fim_a": draw(0) % (n + 1), "fim_b": draw(1) % (n + 1)})
    low, high = F.least("fim_a", "fim_b").cast("int"), F.greatest("fim_a", "fim_b").cast("int")
    piece = lambda start, size: F.array_join(F.slice("fim_lines", start, size), "")
    out = out.withColumns({"fim_pre": piece(F.lit(1), low), "fim_mid": piece(low + 1, high - low), "fim_suf": piece(high + 1, F.size("fim_lines") - high)})
    plain = F.col("fim_form") == "plain"
    arranged = F.when(plain, text).when(F.col("fim_form") == "psm", F.concat(p, "fim_pre", s, "fim_suf", m, "fim_mid")).otherwise(F.concat(s, "fim_suf", p, "fim_pre", m, "fim_mid"))
    chars = lambda c: F.when(~plain, F.length(c)).cast("bigint")
    return out.select(*docs.columns, "fim_units", "fim_form", chars("fim_pre").alias("fim_prefix_chars"), chars("fim_mid").alias("fim_middle_chars"), arranged.alias("fim_output"))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an arrangement was made of, by its sentinels alone (null: null)."""
    _checked(sentinels)
    cut = F.split(output, "|".join(re.escape(x) for x in sentinels), -1)
    at = lambda k: F.get(cut, F.lit(k))
    return F.when(form == "plain", output).when(form == "psm", F.concat(at(1), at(3), at(2))).otherwise(F.concat(at(2), at(3), at(1)))


def op13_fill_in_middle(spark, sf_dir):
    """doc_id, n, form, prefix_chars, middle_chars, and the hashes of the arrangement and of the text
    restored from it, for every document.

    Nulls, empty and very long texts, repeated rows, clashing columns, empty tables: as in fill_in_middle.
    """
    out = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", F.col("fim_units").alias("n"), F.col("fim_form").alias("form"), F.col("fim_prefix_chars").alias("prefix_chars"), F.col("fim_middle_chars").alias("middle_chars"),
        F.sha2("fim_output", 256).alias("output_sha256"), F.sha2(restored(F.col("fim_output"), F.col("fim_form")), 256).alias("restored_sha256"),
    )


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u FROM documents),
c AS (SELECT *, len(u) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 100 THEN 'plain'
       WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, array_to_string(u[1:least(a, b)], '') AS pre, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS mid, array_to_string(u[greatest(a, b) + 1:], '') AS suf FROM c)
SELECT doc_id, n::BIGINT AS n, form, (CASE WHEN form <> 'plain' THEN length(pre) END)::BIGINT AS prefix_chars, (CASE WHEN form <> 'plain' THEN length(mid) END)::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""
