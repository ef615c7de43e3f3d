"""Helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swingtrace.sources.store import new_path

#: White space of the word definition: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = r"\x20\x09-\x0D"
WORD = rf"[^{SPACES}]+"
PART_BITS = 1 << 15  # of one value of bitmap_construct_agg
MOST_BITS = 1 << 27


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Runs of characters other than white space, in order; none for null.

    Single-character replace, split and remove: several times faster than one regular expression.
    """
    plain = F.coalesce(text, F.lit(""))
    for c in "\t\n\x0b\x0c\r":
        plain = F.replace(plain, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(plain, " ", -1), "")


def count_of(text: Column, characters: str) -> Column:
    """How often any of some ASCII characters occurs."""
    gone = [F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit(""))) for c in characters]
    return sum(gone[1:], gone[0]).cast("long")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir)."""
    return new_path(spark, name)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: cuts lineage, survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that stored() wrote and nothing reads any more; other frames are left alone."""
    for df in tables:
        if at := getattr(df, "stored_at", None):
            spark = df.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _bit_of(columns: list[Column], bits: int) -> tuple[Column, Column]:
    """The part of a bitmap and the place in it that stand for the columns' values; never null."""
    at = F.xxhash64(F.lit("bit"), *columns).bitwiseAND(F.lit(bits - 1).cast("long"))
    return F.shiftright(at, 15), at.bitwiseAND(F.lit(PART_BITS - 1).cast("long"))


def bitmap(keys: DataFrame) -> tuple[DataFrame, int]:
    """(part_, bits_), a bit set for each row of the stored table `keys`, and its number of bits: 16 to 32 a row, MOST_BITS (16 MB) at most."""
    bits = min(MOST_BITS, max(PART_BITS, 1 << (16 * keys.count()).bit_length()))
    part, place = _bit_of([keys[c] for c in keys.columns], bits)
    placed = keys.select(part.alias("part_"), place.alias("place")).repartition("part_")
    return placed.groupBy("part_").agg(F.bitmap_construct_agg("place").alias("bits_")), bits


def narrowed(rows: DataFrame, by: list[Column], bitmap_of: tuple[DataFrame, int], out: bool = False) -> DataFrame:
    """The rows whose `by` may be among the keys of bitmap(): all that are, and few others; `out`: the rest, none of which is.

    What a join would drop anyway is dropped before it moves. With more keys than the bitmap is made for, more others stay.
    """
    table, bits = bitmap_of
    part, place = _bit_of(by, bits)
    byte = F.ascii(F.decode(F.substring(F.col("bits_"), F.shiftright(place, 3).cast("int") + 1, F.lit(1)), "ISO-8859-1"))
    is_set = F.getbit(byte, place.bitwiseAND(F.lit(7).cast("long")).cast("int")) == 1
    return rows.join(F.broadcast(table), (part == F.col("part_")) & is_set, "left_anti" if out else "left_semi")


def first_texts(texts: DataFrame, n: int) -> DataFrame:
    """The n distinct values of the only column with the smallest hashes, in their order; copies of a value count once."""
    keyed = texts.toDF("value").select(F.xxhash64("value").alias("hash"), "value")
    last = keyed.select("hash").distinct().orderBy("hash").limit(n).agg(F.max("hash")).first()[0]
    found = keyed.filter(F.col("hash") <= F.lit(last).cast("long")).groupBy("hash").agg(F.min("value").alias("value"))
    return found.orderBy("hash").limit(n).select(F.col("value").alias(texts.columns[0]))
