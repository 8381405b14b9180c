r"""Secret scans with multipart credential linking, in DataFrame functions only.

Base findings, leftmost and without overlaps per kind: ``assign`` (a key word, ``:`` or ``=``, a value of 8 characters or more),
``access`` (AKIA and capitals or digits, 16 characters or more) and ``hex`` (32 or more of 0-9a-f). Weak candidates say nothing
by themselves: ``user`` (a named account, an identifier), ``opaque`` (24 or more of a base64 alphabet with capitals, small
letters and digits, a secret) and ``url`` (an endpoint). A text is parted into scopes at blank lines. A weak candidate is
reported where a complementary part (an identifier or endpoint for a secret, a secret for the others) begins or ends within
REACH code points of it, both in one scope and without overlap. Weak candidates that overlap a base finding are part of it.

Places come from splitting a text at its matches: the lengths of gaps and matches, summed in order. Each text is read once;
from then on only lengths are moved. Parts meet by an interval join on bins of REACH code points: every weak candidate looks from
its two ends, every part covers the bins within reach of its ends, so a part meets the few that are near and a text full of
parts costs no pairs of all of them. Rows are told apart by a number given once and stored, so repeated texts meet under no
common key.

Places are code points, ends exclusive. Null and empty texts have no findings (counts 0, ``spans`` empty, the digest of the
empty string). Repeated rows and rows without a doc_id are rows of their own. Empty tables give no rows. Only the named columns
are read, so other columns may have any name. Very long texts are scanned whole by regular expressions without recursion.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxmart.session import cut_lineage

from .catalog import query, table

REACH = 200


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEY = "|".join(map(_any_case, ("password", "passwd", "secret", "token", "api_?key")))
_ACCOUNT = "|".join(map(_any_case, ("username", "user", "login", "account", "client_?id", "access_?key_?id")))
_SET = r"""["']?\x20*[:=]\x20*["']?"""

# Kind, pattern, role (I identifier, S secret, E endpoint). The order is that of spans that start together.
KINDS = [
    ("assign", rf"({_KEY}){_SET}([A-Za-z0-9+/_.=-]+)", "S"),
    ("access", "AKIA[A-Z0-9]+", "I"),
    ("hex", "[0-9a-f]{32,}", "S"),  # what is shorter than 32 is dropped and cannot hold a longer one
    ("user", rf"({_ACCOUNT}){_SET}[A-Za-z0-9._@+-]{{3,}}", "I"),
    ("opaque", "[A-Za-z0-9+/_-]{24,}", "S"),
    ("url", r"[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\x00-\x20\"'<>]+", "E"),
]
BASE = 3  # kinds that are reported wherever they are
_BLANK_LINE = r"\n[\x20\x09\r]*\n[\x20\x09\r\n]*"


def _holds(kind: str, hit: Column) -> Column:
    """Whether a match passes its kind's check."""
    if kind == "assign":
        return F.length(F.regexp_extract(hit, KINDS[0][1], 2)) >= 8
    if kind == "access":
        return F.length(hit) >= 16
    if kind == "opaque":
        return hit.rlike("[A-Z]") & hit.rlike("[a-z]") & hit.rlike("[0-9]")
    return F.lit(True)


def _places(text: Column, pattern: str, kind: str) -> Column:
    """Gap before, length and check of each match in order; null where nothing matches."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    found = F.zip_with(gaps, hits, lambda g, h: F.struct(F.length(g).alias("gap"), F.length(h).alias("size"), _holds(kind, h).alias("holds")))
    return F.when(text.rlike(pattern), F.slice(found, 1, F.size(hits)))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, doc_id, one array of matches per kind, scopes), stored. Scopes are looked at where a text has weak candidates."""
    t = F.coalesce(F.col("text_"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("doc_id"), F.col(text).alias("text_"))
    found = rows.select("row", "doc_id", "text_", *[_places(t, p, kind).alias(kind) for kind, p, _ in KINDS])
    weak = reduce(Column.__or__, [F.col(kind).isNotNull() for kind, _, _ in KINDS[BASE:]])
    return cut_lineage(found.withColumn("scope", F.when(weak, _places(t, _BLANK_LINE, "scope"))).drop("text_"), "credentials")


def spans(found: DataFrame) -> DataFrame:
    """(row, kind, at, start, end) of all matches that pass their check, ``at`` being the number of the kind; scope ends are
    of the kind after the last."""
    names = [*(k for k, _, _ in KINDS), "scope"]
    each = F.filter(F.array(*[F.struct(F.lit(i).alias("at"), F.col(k).alias("found")) for i, k in enumerate(names)]),
                    lambda x: x["found"].isNotNull())
    rows = found.select("row", F.explode(each).alias("k")).select("row", "k.at", F.posexplode("k.found").alias("i", "m"))
    upto = Window.partitionBy("row", "at").orderBy("i")
    return rows.withColumn("end", F.sum(F.col("m.gap") + F.col("m.size")).over(upto)).filter("m.holds") \
        .select("row", "at", (F.col("end") - F.col("m.size")).alias("start"), "end")


def _roles(at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(r) for _, _, r in KINDS]), at + 1)


def linked(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """The weak candidates among ``parts`` that a complementary part supports: row, at, start, end."""
    last = len(KINDS)
    weak_rows = parts.filter(F.col("at").between(BASE, last - 1)).select("row").distinct()
    # One pass in order of place: the number of scopes that ended before, and base findings that reach over or begin within.
    order = Window.partitionBy("row").orderBy("start", "at")
    base_end, base_start = F.when(F.col("at") < BASE, F.col("end")), F.when(F.col("at") < BASE, F.col("start"))
    placed = parts.join(weak_rows, "row", "left_semi").select(
        "row", "at", "start", "end", F.count(F.when(F.col("at") == last, 1)).over(order).alias("scope"),
        F.max(base_end).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("over"),
        F.first(base_start, ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("next"))
    apart = (F.coalesce("over", F.lit(0)) <= F.col("start")) & (F.col("next").isNull() | (F.col("next") >= F.col("end")))
    part = placed.filter((F.col("at") < BASE) | ((F.col("at") < last) & apart)).withColumn("role", _roles(F.col("at")))
    weak = part.filter(F.col("at") >= BASE)
    # From its start a candidate looks back at parts that end before it, from its end ahead at parts that begin after it.
    looks = weak.select("row", "scope", "at", "start", "end", "role", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("start").alias("point")), F.struct(F.lit(1).alias("side"), F.col("end").alias("point")))).alias("p")) \
        .select("row", "scope", "at", "start", "end", "role", "p.side", "p.point", F.expr(f"p.point div {reach}").alias("bin"))
    covers = part.select("row", "scope", F.col("role").alias("other"), F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("end").alias("lo"), (F.col("end") + reach).alias("hi")),
        F.struct(F.lit(1).alias("side"), (F.col("start") - reach).alias("lo"), F.col("start").alias("hi")))).alias("p")) \
        .select("row", "scope", "other", "p.side", "p.lo", "p.hi",
                F.explode(F.sequence(F.expr(f"greatest(p.lo, 0) div {reach}"), F.expr(f"p.hi div {reach}"))).alias("bin")).distinct()
    near = F.col("l.point").between(F.col("c.lo"), F.col("c.hi")) & ((F.col("l.role") == "S") != (F.col("c.other") == "S"))
    same = reduce(Column.__and__, [F.col(f"l.{c}") == F.col(f"c.{c}") for c in ("row", "scope", "side", "bin")])
    return looks.alias("l").join(covers.alias("c"), same & near, "left_semi").select("row", "at", "start", "end").distinct()


def findings(docs: DataFrame, key: str = "doc_id", text: str = "text", reach: int = REACH) -> DataFrame:
    """One row per document: doc_id, findings array<struct<start, at, end, kind>> in order of place, then of kind."""
    found = scan(docs, key, text)
    parts = cut_lineage(spans(found), "credential-parts")
    told = parts.filter(F.col("at") < BASE).unionByName(linked(parts, reach))
    kind = F.element_at(F.array(*[F.lit(k) for k, _, _ in KINDS]), F.col("at") + 1)
    each = told.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "at", "end", kind.alias("kind")))).alias("findings"))
    empty = F.array().cast("array<struct<start: bigint, at: int, end: bigint, kind: string>>")
    return found.select("row", "doc_id").join(each, "row", "left").select("doc_id", F.coalesce("findings", empty).alias("findings"))


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents),
  k AS (SELECT * FROM (VALUES {kinds}) AS kinds(o, kind, pattern, role)),
  h AS (SELECT id, o, pattern, string_split_regex(t, pattern) AS gaps, regexp_extract_all(t, pattern) AS hits
        FROM d JOIN k ON regexp_matches(t, pattern)),
  m AS (SELECT id, o, pattern, unnest(hits) AS hit, unnest(gaps[1:len(hits)]) AS gap, generate_subscripts(hits, 1) AS i FROM h),
  p AS (SELECT id, o, pattern, hit, sum(length(gap) + length(hit)) OVER (PARTITION BY id, o ORDER BY i) AS e FROM m),
  s AS (SELECT id, o, e - length(hit) AS s, e FROM p WHERE CASE o
          WHEN 0 THEN length(regexp_extract(hit, pattern, 2)) >= 8 WHEN 1 THEN length(hit) >= 16
          WHEN 4 THEN regexp_matches(hit, '[A-Z]') AND regexp_matches(hit, '[a-z]') AND regexp_matches(hit, '[0-9]') ELSE true END),
  c AS (SELECT s.*, k.kind, k.role, (SELECT count(*) FROM s AS b WHERE b.id = s.id AND b.o = 6 AND b.s <= s.s) AS scope
        FROM s JOIN k USING (o) WHERE s.o < 3 OR (s.o < 6 AND NOT EXISTS (
          SELECT 1 FROM s AS b WHERE b.id = s.id AND b.o < 3 AND b.s < s.e AND s.s < b.e))),
  f AS (SELECT * FROM c WHERE o < 3 OR EXISTS (
          SELECT 1 FROM c AS b WHERE b.id = c.id AND b.scope = c.scope AND (b.role = 'S') <> (c.role = 'S')
            AND (c.s - b.e BETWEEN 0 AND {reach} OR b.s - c.e BETWEEN 0 AND {reach}))),
  g AS (SELECT id, count(*) FILTER (o = 0) AS n_assign, count(*) FILTER (o = 1) AS n_access, count(*) FILTER (o = 2) AS n_hex,
          string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) FILTER (o < 3) AS base,
          string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) AS spans FROM f GROUP BY id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (id)
""".format(reach=REACH, kinds=", ".join("({}, '{}', '{}', '{}')".format(i, k, p.replace("'", "''"), r) for i, (k, p, r) in
                                        enumerate([*KINDS, ("scope", _BLANK_LINE, "")])))


@query("op12_credentials", ORACLE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_ = findings(table(spark, sf_dir, "documents"))
    said = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("findings", lambda s: s["at"] < BASE)
    n = [F.expr(f"cast(size(filter(findings, s -> s.at = {i})) as long)").alias(f"n_{KINDS[i][0]}") for i in range(BASE)]
    return all_.select("doc_id", *n, F.sha2(said(base), 256).alias("base_sha256"), said(F.col("findings")).alias("spans"))
