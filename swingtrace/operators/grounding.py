"""Grounding: every number printed in a text must match recorded evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What is taken out of a text before its numerals are read, and what a numeral is.
TRACE_ID = r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
ISO_DATE = r"\d{4}-\d{2}-\d{2}"
EVIDENCE_REF = r"\[e\d+\]"
QUOTED_NAME = r"'[^'\n]*'"
NUMERAL = r"-?\$?\d[\d,]*\.?\d*"
MONTH = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*"
SPAN = r"(?:\s*(?:-|–|—|to)\s*\d{1,2})?"
PROSE_DATES = (
    (rf"(?i)\d{{1,2}}{SPAN}\s+{MONTH}", " <date> "),
    (rf"(?i){MONTH}\s+\d{{1,2}}{SPAN}", " <date> "),
    (r"(?i)\b\d{1,2}(?:st|nd|rd|th)\b", " <date> "),
    (r"\b20\d{2}\b", " <year> "),
)


def strip_prose_dates(text: Column) -> Column:
    """Day-and-month, ordinals and bare years out; other numbers stay."""
    for pattern, replacement in PROSE_DATES:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def strip_references(text: Column) -> Column:
    """Ids, ISO dates, evidence references and quoted names are not claims."""
    for pattern in (TRACE_ID, ISO_DATE, EVIDENCE_REF, QUOTED_NAME):
        text = F.regexp_replace(text, pattern, " ")
    return text


def numerals(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``key, numeral, value, tolerance, n``: distinct printed numbers per text, with their count.

    Counting repeats here means a text that prints one number a million times moves as one row.
    The tolerance is half a unit of the last printed decimal. 0 and 1 are never checked.
    """
    found = F.regexp_extract_all(strip_references(F.col(text)), F.lit(NUMERAL), F.lit(0))
    rows = texts.select(key, F.explode(found).alias("numeral"))
    rows = rows.groupBy(key, "numeral").agg(F.count(F.lit(1)).alias("n"))
    value = F.regexp_replace("numeral", r"[$,]", "").try_cast("double")
    decimals = F.length(F.regexp_extract("numeral", r"\.(\d*)$", 1))
    rows = rows.withColumns(
        {"value": value, "tolerance": F.lit(0.5) * F.pow(F.lit(10.0), -decimals)}
    )
    return rows.filter(F.col("value").isNotNull() & ~F.col("value").isin(0.0, 1.0))


def candidate_values(evidence: DataFrame, key: str) -> DataFrame:
    """Everything an evidence row may be printed as: v, |v|, as a percentage, or its share."""
    v = F.col("value")
    forms = F.array(v, F.abs(v), v * 100.0, F.abs(v * 100.0), F.col("share_pct"))
    rows = evidence.filter(v.isNotNull()).select(key, F.explode(forms).alias("actual"))
    return rows.filter("actual IS NOT NULL").distinct()


def check_grounding(
    texts: DataFrame, evidence: DataFrame, key: str, text: str = "text"
) -> DataFrame:
    """Each distinct numeral of each text with ``grounded``.

    ``evidence`` carries the same key. Numbers meet evidence in an equi-join on (key, whole number):
    a tolerance of at most a half touches at most two whole numbers, so nothing is compared with
    the evidence of other numbers and one text's evidence is spread over many join keys.
    """
    printed = numerals(texts, key, text)
    slack = F.col("tolerance") + F.lit(1e-12)
    low = F.floor(F.col("value") - slack)
    high = F.floor(F.col("value") + slack)
    probes = printed.withColumn("bucket", F.explode(F.array_distinct(F.array(low, high))))
    pool = candidate_values(evidence, key).withColumn("bucket", F.floor("actual"))
    near = F.abs(F.col("p.value") - F.col("e.actual")) <= F.col("p.tolerance") + F.lit(1e-12)
    same = (F.col(f"p.{key}") == F.col(f"e.{key}")) & (F.col("p.bucket") == F.col("e.bucket"))
    hits = (
        probes.alias("p")
        .join(pool.alias("e"), same & near, "left_semi")
        .select(key, "numeral")
        .distinct()
        .withColumn("grounded", F.lit(True))
    )
    out = printed.join(hits, [key, "numeral"], "left")
    return out.withColumn("grounded", F.coalesce("grounded", F.lit(False)))


def grounding_summary(checked: DataFrame, key: str) -> DataFrame:
    """Per text: numerals checked, grounded and not, counting repeats."""
    n, ok = F.col("n"), F.col("grounded")
    return checked.groupBy(key).agg(
        F.sum("n").alias("total"),
        F.sum(F.when(ok, n).otherwise(0)).alias("grounded"),
        F.sum(F.when(ok, 0).otherwise(n)).alias("ungrounded"),
    ).withColumn("ok", F.col("ungrounded") == 0)
