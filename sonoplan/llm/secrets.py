"""Secret scans by a trigram inverted index, in DataFrame functions only.

Every rule is a regular expression. A Boolean query over trigrams that any match must
contain is derived from its syntax tree; the postings of the needed trigrams are built
over all texts, intersected per row, and a rule's expression runs only on the rows that the
index leaves for it. Rules without mandatory trigrams scan every text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import product
from re import _constants as sre
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import text_key


@dataclass(frozen=True)
class Rule:
    """``least`` characters of group ``group`` make a match valid; other matches are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False
    #: An expression with the same matches that costs less where many starts fail.
    quick: str = ""

    @property
    def run(self) -> str:
        return self.quick or self.pattern


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_KEYWORDS = "|".join(_either(w) for w in ("password", "passwd", "secret", "token")) + "|" + _either("api") + "_?" + _either("key")
_Q = "[\"']?"
_J = "[A-Za-z0-9_-]"
RULES = (
    Rule("assign", rf"({_KEYWORDS}){_Q}\x20*[:=]\x20*{_Q}([A-Za-z0-9+/_.=-]+)", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, True),
    # A run of 32 or more is the same as a maximal run of that length: what is shorter fails anyway.
    Rule("hex", r"[0-9a-f]{32,}", 0, 32, True),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    # A match ends with a run of these signs, so within a run only the first start counts: starts shortly
    # after another of the same run are passed over, and no run is read again from its middle.
    Rule("jwt", rf"eyJ{_J}{{8,}}\.eyJ{_J}{{8,}}\.{_J}{{8,}}", quick=rf"eyJ(?<!eyJ{_J}{{0,2000}}?eyJ){_J}{{8,}}+\.eyJ{_J}{{8,}}+\.{_J}{{8,}}+"),
)

# --- Boolean trigram queries -------------------------------------------------------------

#: ("all",) matches everything; ("gram", t); ("and", ...); ("or", ...)
ALL = ("all",)
_MOST_STRINGS = 64


def _and(parts):
    parts = list(dict.fromkeys(p for p in parts if p != ALL))
    return ALL if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def _or(parts):
    parts = list(dict.fromkeys(parts))
    return ALL if not parts or ALL in parts else parts[0] if len(parts) == 1 else ("or", *parts)


def _of_strings(strings) -> tuple:
    """What a text must hold if it holds one of the strings."""
    return _or([_and([("gram", s[i : i + 3]) for i in range(len(s) - 2)]) for s in sorted(strings)])


def _parse(items) -> tuple[set[str] | None, tuple]:
    """(the exact set of lower-cased strings if small, else None; the query)."""
    run: set[str] = {""}
    done, whole = [], True
    for op, arg in items:
        exact, query = _one(op, arg)
        if exact is not None and len(run) * len(exact) <= _MOST_STRINGS:
            run = {a + b for a, b in product(run, exact)}
            continue
        whole = False
        done.append(_of_strings(run))
        done.append(query)
        run = exact if exact is not None else {""}
    return (run, _of_strings(run)) if whole else (None, _and([*done, _of_strings(run)]))


def _one(op, arg) -> tuple[set[str] | None, tuple]:
    if op is sre.LITERAL:
        return {chr(arg).lower()}, ALL
    if op is sre.IN:
        chars: set[str] = set()
        for kind, x in arg:
            if kind is sre.LITERAL:
                chars.add(chr(x).lower())
            elif kind is sre.RANGE and x[1] - x[0] < 4:
                chars |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None, ALL
        return (chars, ALL) if len(chars) <= 5 else (None, ALL)
    if op is sre.SUBPATTERN:
        return _parse(arg[-1])
    if op is sre.BRANCH:
        parts = [_parse(x) for x in arg[1]]
        if all(e is not None for e, _ in parts) and sum(len(e) for e, _ in parts) <= _MOST_STRINGS:
            return set().union(*(e for e, _ in parts)), ALL
        return None, _or([q if e is None else _of_strings(e) for e, q in parts])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, inner = arg
        exact, query = _parse(inner)
        if low == 0:
            return (exact | {""}, ALL) if high == 1 and exact is not None else (None, ALL)
        if exact is not None and len(exact) == 1 and low == high:
            return {next(iter(exact)) * low}, ALL
        return None, query if exact is None else _of_strings(exact)
    return None, ALL


def trigram_query(pattern: str) -> tuple:
    """Boolean query over lower-cased trigrams that every text with a match satisfies."""
    exact, query = _parse(_parser.parse(pattern))
    return query if exact is None else _of_strings(exact)


def grams_of(query: tuple) -> set[str]:
    if query[0] == "gram":
        return {query[1]}
    return set().union(*(grams_of(q) for q in query[1:])) if query[0] in ("and", "or") else set()


def _holds(query: tuple, grams: Column) -> Column:
    if query[0] == "gram":
        return F.array_contains(grams, query[1])
    return reduce(lambda a, b: a & b if query[0] == "and" else a | b, [_holds(q, grams) for q in query[1:]])


# --- the operator ------------------------------------------------------------------------


def postings(docs: DataFrame, grams: set[str]) -> DataFrame:
    """Inverted index (gram, key) of the needed trigrams over lower-cased texts, one row per pair."""
    low = docs.select("key", F.lower("text").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in sorted(grams)]))
    return low.select("key", F.explode(held).alias("gram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, fits): the rules whose trigram query the postings of a row satisfy; rows without any are left out."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    grams = set().union(*(grams_of(q) for q in queries.values()))
    held = postings(docs, grams).groupBy("key").agg(F.collect_set("gram").alias("grams"))
    fits = F.array_compact(F.array(*[F.when(_holds(q, F.col("grams")), F.lit(k)) for k, q in queries.items() if q != ALL], F.lit(None).cast("string")))
    return held.select("key", fits.alias("fits")).where(F.size("fits") > 0)


def _matches(rule: Rule) -> Column:
    """Matches of a rule in ``text``: (gap before, found, part) lengths; a last gap without a match ends them."""
    pattern = F.lit(rule.run)
    found = F.regexp_extract_all("text", pattern, F.lit(0))
    part = found if rule.group == 0 else F.regexp_extract_all("text", pattern, F.lit(rule.group))
    zipped = F.arrays_zip(F.split("text", rule.run, -1).alias("gap"), found.alias("found"), part.alias("part"))
    lengths = lambda z: F.struct(F.length(z["gap"]).alias("gap"), F.length(z["found"]).alias("found"), F.length(z["part"]).alias("part"))
    return F.transform(zipped, lengths)


def find_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Spans (key, n, kind, start, end) in code points, end exclusive, over whole texts.

    ``docs`` has key and text (no nulls in text). Equal keys mean equal texts and give their
    spans once. Matches of one rule don't overlap (leftmost first).
    """
    return _scan(docs.withColumn("doc_id", F.lit(None).cast("bigint")), rules).select("key", F.inline("spans")).select("key", "n", "kind", "start", "end")


def _scan(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """One row per key of ``docs`` (key, doc_id, text): key, doc_id, copies and spans.

    The texts are dealt by key once; the candidates of the index, the verification and the sums
    of lengths that give the offsets follow in that partitioning. A rule's expression runs only
    where the index lets it, or everywhere if the rule has no mandatory trigram.
    """
    rows = docs.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    indexed = [r.kind for r in rules if trigram_query(r.pattern) != ALL]
    if indexed:
        rows = rows.join(candidates(docs, rules).hint("shuffle_hash"), "key", "left")
    none = F.array().cast("array<struct<gap:int,found:int,part:int>>")
    may = lambda r: F.array_contains("fits", r.kind) if r.kind in indexed else F.col("text").rlike(r.run)
    hits = [F.when(may(r), _matches(r)).otherwise(none) for r in rules]
    tagged = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(r.kind).alias("kind"), F.lit(r.least).alias("least"), h.alias("z")) for n, (r, h) in enumerate(zip(rules, hits))])
    each = rows.select("key", "doc_id", "copies", F.explode_outer(F.filter(tagged, lambda t: F.size(t["z"]) > 1)).alias("t"))
    each = each.select("key", "doc_id", "copies", "t.n", "t.kind", "t.least", F.posexplode_outer("t.z").alias("pos", "z"))
    so_far = W.partitionBy("key", "n").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    each = each.withColumn("end", F.sum(F.col("z.gap") + F.coalesce("z.found", F.lit(0))).over(so_far))
    span = F.struct((F.col("end") - F.col("z.found")).alias("start"), "n", "end", "kind")
    good = F.when(F.col("z.found").isNotNull() & (F.col("z.part") >= F.col("least")), span)
    return each.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("copies").alias("copies"), F.sort_array(F.collect_list(good)).alias("spans"))


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with its secrets: an array of (start, n, end, kind).

    Null text counts as empty and has none. Rows that repeat get the same answer each; they are
    scanned once. Other columns are not read, so clashing names can't arise. Empty table: empty
    result. Very long texts are scanned whole.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("key", text_key(F.col("doc_id"), F.col("text")))
    found = _scan(rows, rules)
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).select("doc_id", "spans")


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op9_secrets(spark, sf_dir):
    """doc_id, counts of the base kinds, the hash of the base spans and all spans, for every document.

    Nulls, empty and very long texts, repeated rows, empty tables: as in scan_secrets.
    """
    from .common import table

    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [r.kind for r in RULES if r.base]
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    kept = F.filter("spans", lambda s: s["kind"].isin(*base))
    return found.select("doc_id", *map(count, base), F.sha2(_listed(kept), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def _sql_spans(rule: Rule, n: int) -> str:
    p = rule.pattern.replace("'", "''")
    return f"""SELECT k, {n} AS n, '{rule.kind}' AS kind, e - length(found) AS s, e FROM (
  SELECT k, found, part, (sum(length(gap) + coalesce(length(found), 0)) OVER (PARTITION BY k ORDER BY pos))::BIGINT AS e FROM (
  SELECT k, unnest(string_split_regex(text, '{p}')) AS gap, unnest(regexp_extract_all(text, '{p}')) AS found,
   unnest(regexp_extract_all(text, '{p}', {rule.group})) AS part, generate_subscripts(string_split_regex(text, '{p}'), 1) AS pos
  FROM d WHERE regexp_matches(text, '{p}'))) WHERE found IS NOT NULL AND length(part) >= {rule.least}"""


OP9_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS k FROM documents),
s AS ({" UNION ALL ".join(_sql_spans(r, n) for n, r in enumerate(RULES))}),
g AS (SELECT k, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
 string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, n, e) AS spans,
 string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, n, e) FILTER (kind IN ('assign', 'access', 'hex')) AS base FROM s GROUP BY k)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
 sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (k)
"""
