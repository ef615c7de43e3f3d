import hashlib
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import types as T

TABLES = ("documents", "benchmark", "pages", "labels")


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, tied ids, and columns whose names operators use themselves."""
    text = " ".join(f"word{i}" for i in range(40))
    rows = [
        (1, text, "en", "src1"), (2, text, "en", "src1"), (2, text, "en", "src1"), (2, "another short text", None, None),
        (None, text, "xx", "src2"), (3, None, "de", "src1"), (4, "", "fr", None), (5, "   \n\t ", "es", "src3"),
        (6, "lone", "en", "src1"), (7, "aéb " * 30000, "fr", "src1"), (8, "x" * 50000, "en", ""),
    ]
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType())]
    clash = ("row", "key", "words", "n_words", "kept", "label", "n", "base", "spans", "copies", "domain", "n_tokens", "masked")
    fields += [T.StructField(c, T.IntegerType()) for c in clash]
    return spark.createDataFrame([(*r, *range(len(clash))) for r in rows], T.StructType(fields))


def same(spark_df, expected, keys):
    """Row by row, with columns by name."""
    a = spark_df.toPandas()
    assert sorted(a.columns) == sorted(expected.columns)
    a, b = (d[sorted(d.columns)].sort_values(keys).reset_index(drop=True) for d in (a, expected))
    assert len(a) == len(b)
    for c in a.columns:
        differ = ~((a[c] == b[c]) | (a[c].isna() & b[c].isna()))
        assert not differ.any(), (c, a[differ].head(), b[differ].head())


def cut_by_hand(texts: list[bytes], length: int) -> list[tuple]:
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for t in texts:
        mark = np.zeros(len(t) + 1, np.int64)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                mark[i] += 1
                mark[i + length] -= 1
        gone = np.cumsum(mark)[: len(t)] > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out
