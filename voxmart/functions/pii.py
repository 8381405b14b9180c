"""Masking of personal data, JVM-side.

A row's text is cut at its digit runs, each run is masked by its own length and checksum,
and the pieces are joined again, so several numbers per text need no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of personal data, in the order they are masked.
EMAIL = r"(?U)\b[\w.%+-]+@[\w.-]+\.[A-Za-z]{2,}\b"
TAX_ID = r"(?U)\b[A-Z]{5}[0-9]{4}[A-Z]\b"
ONE_TIME_CODE = r"(?iU)\b(otp|cvv|pin|code)\b[^\d]{0,10}(\d{3,6})\b"
DIGIT_RUN = r"(?U)\b\d(?:[ \-]?\d){8,21}\b"
CANDIDATE = r"(?U)[@\d]"  # no text without one of these can hold personal data

_NONE = "cast(array() as array<string>)"


def _run_kind(digits: Column) -> Column:
    n = F.length(digits)
    return (F.when(n.between(13, 19) & F.call_function("luhn_check", digits), "card")
            .when(n == 12, "aadhaar_or_account").when(n == 10, "phone").otherwise("account"))


def _mask_run(run: Column) -> Column:
    digits = F.regexp_replace(run, r"(?U)\D", "")
    n = F.length(digits)
    tail = F.substring(digits, -4, 4)
    kind = _run_kind(digits)
    return (F.when(kind == "card", F.concat(F.lit("XXXX-XXXX-XXXX-"), tail))
            .when(kind == "aadhaar_or_account", F.concat(F.lit("XXXX-XXXX-"), tail))
            .when(kind == "phone", F.concat(F.lit("XXXXXXXX"), F.substring(digits, -2, 2)))
            .otherwise(F.concat(F.repeat(F.lit("X"), n - 4), tail)))


def mask_pii(df: DataFrame, text: str, masked: str = "text_masked", types: str = "pii_type_list") -> DataFrame:
    """Add the masked text and the distinct kinds found, in first-seen order.

    Masking is idempotent. The stages are separate projections so each pattern runs once.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    suspect = raw.rlike(CANDIDATE)
    staged = df.withColumn("_p1", F.when(suspect, F.regexp_replace(raw, EMAIL, "[EMAIL]")))
    staged = staged.withColumn("_p2", F.regexp_replace("_p1", TAX_ID, "[PAN]"))
    staged = staged.withColumns({
        "_codes": F.transform(F.regexp_extract_all("_p2", F.lit(ONE_TIME_CODE), F.lit(1)), F.lower),
        "_p3": F.regexp_replace("_p2", ONE_TIME_CODE, "$1 [REDACTED]")})
    staged = staged.withColumns({
        "_gaps": F.split("_p3", DIGIT_RUN, -1),
        "_runs": F.regexp_extract_all("_p3", F.lit(f"({DIGIT_RUN})"), F.lit(1))})
    joined = F.array_join(
        F.zip_with("_gaps", F.concat(F.transform("_runs", _mask_run), F.array(F.lit(""))),
                   lambda gap, run: F.concat(gap, run)), "")
    found = F.array_distinct(F.concat(
        F.when(F.col("_p1") != raw, F.array(F.lit("email"))).otherwise(F.expr(_NONE)),
        F.when(F.col("_p2") != F.col("_p1"), F.array(F.lit("pan"))).otherwise(F.expr(_NONE)),
        F.col("_codes"),
        F.transform("_runs", lambda r: _run_kind(F.regexp_replace(r, r"(?U)\D", "")))))
    return (staged
            .withColumns({masked: F.when(F.col("_p3").isNull(), raw).otherwise(joined),
                          types: F.when(F.col("_p3").isNull(), F.expr(_NONE)).otherwise(found)})
            .drop("_p1", "_p2", "_p3", "_codes", "_gaps", "_runs"))


def masked_fields(df: DataFrame, text: str = "text") -> DataFrame:
    """The three silver columns: masked text, kinds as a comma list, presence flag."""
    return (mask_pii(df, text)
            .withColumn("pii_types", F.array_join("pii_type_list", ","))
            .withColumn("pii_present", F.when(F.size("pii_type_list") > 0, 1).otherwise(0))
            .drop("pii_type_list"))
