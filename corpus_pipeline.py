"""The corpus pipeline: quality rules, near duplicates, decontamination, personal data, mixing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. Stages but the last
return the columns of documents; the last returns the chosen documents with their leaf, tokens and copies.
Null and empty texts fail the quality rules; every later stage has the defined results of its operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from swingtrace.llm import contamination, mixing, nearcopies, private, quality
from swingtrace.llm.common import discard, stored, table


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a base rule or the divergence rule rejects go."""
    return quality.keep(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies stays."""
    return nearcopies.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which one word in twenty or more lies in a benchmark passage go."""
    return contamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the text."""
    return private.mask(docs, length="n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents chosen by the budget of their domain, language and source, with their number of copies."""
    mixed = mixing.mix(docs)
    own = [mixed[f"row.`{c}`"].alias(c) for c in docs.columns if c not in ("domain", "n_tokens", "copies")]
    return mixed.select(*own, "domain", "n_tokens", "copies")


STAGES = [
    ("quality", drop_low_quality),
    ("near_copies", drop_near_copies),
    ("contamination", drop_contaminated),
    ("private", mask_private),
    ("mixing", mix_sources),
]

#: The span classifier's training has no SQL form; tests/llm checks run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written to the shared folder, read again and deleted once the next is there."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)  # a stage's input; the tables themselves are not stored() and stay
    return docs
