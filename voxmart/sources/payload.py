"""Reading landed JSON whose field names drift: one parse per payload, then typed lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmart.functions import dates, numbers
from voxmart.functions.text import strip_edges
from voxmart.schemas import SCHEMAS

POST_COLUMNS = SCHEMAS["raw_posts"].fieldNames()
CONTRACT = {f.name: f.dataType for f in SCHEMAS["raw_posts"].fields}


class Doc:
    """A parsed JSON document; every lookup takes several paths and returns the first that has a value."""

    def __init__(self, variant: Column):
        self.v = variant

    def text(self, *paths: str, default: str | None = None) -> Column:
        """First non-blank value. The array form names every lookup once in the plan."""
        values = F.array(*[strip_edges(F.try_variant_get(self.v, p, "string")) for p in paths])
        found = F.get(F.filter(values, lambda x: x != ""), 0)
        return found if default is None else F.coalesce(found, F.lit(default))

    def count(self, *paths: str) -> Column:
        """A metric: NULL where nobody measured it."""
        found = [numbers.measured(F.try_variant_get(self.v, p, "string")) for p in paths]
        return F.coalesce(*found) if len(found) > 1 else found[0]

    def flag(self, path: str) -> Column:
        return F.coalesce(F.try_variant_get(self.v, path, "boolean"), F.lit(False))

    def items(self, *paths: str) -> Column:
        found = [F.try_variant_get(self.v, p, "array<variant>") for p in paths]
        return F.coalesce(*found) if len(found) > 1 else found[0]

    def at(self, path: str) -> Doc:
        return Doc(F.try_variant_get(self.v, path, "variant"))


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a generator, so that the optimizer does not copy a costly expression
    into every place that uses it."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def parsed(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Add ``_doc``, parsed once per row; a payload that is no JSON gives NULL and with it no rows."""
    return once(payloads, _doc=F.try_parse_json(column))


def each(payloads: DataFrame, *containers: str, column: str = "payload") -> DataFrame:
    """One row per list element, whichever of the container paths holds the list."""
    rows = parsed(payloads, column)
    return rows.select("*", F.posexplode(Doc(F.col("_doc")).items(*containers)).alias("_pos", "_item"))


def posts(rows: DataFrame, source: str | Column, date: Column | None = None, created_at: Column | None = None,
          keep: tuple[str, ...] = (), **columns: Column) -> DataFrame:
    """Project onto the raw_posts contract plus ``raw_created_at``.

    A date no format can read becomes NULL; the raw string stays beside it, so such rows can
    be counted instead of vanishing.
    """
    out = dict(columns)
    out["source"] = F.lit(source) if isinstance(source, str) else source
    if date is not None:
        rows, raw = once(rows, _raw_at=date), F.col("_raw_at")
    else:
        raw = F.lit(None).cast("string")
    out["created_at"] = created_at if created_at is not None else dates.parse_datetime(raw)
    picked = [out.get(c, F.lit(None)).cast(CONTRACT[c]).alias(c) for c in POST_COLUMNS]
    return rows.select(*picked, raw.alias("raw_created_at"), *keep)


def joined(separator: str, *parts: Column) -> Column:
    """Non-empty parts joined; blanks and stray separators at both ends removed."""
    text = F.concat_ws(separator, *[F.nullif(p, F.lit("")) for p in parts])
    return F.regexp_replace(F.regexp_replace(text, r"^[\s.]+", ""), r"[\s.]+$", "")
