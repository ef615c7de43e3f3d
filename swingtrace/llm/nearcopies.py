"""Near duplicates: SetSketch registers in bands, joint likelihood estimate, exact verification.

1. Each text becomes its set of k-word shingles, a 128-bit key of that set and 256 registers.
2. Rows with the same set are one class; only classes go on, so exact copies cost one row each.
3. Registers are cut into 51 bands of five; classes with an equal band share a bucket. At a similarity of 0.75 independent
   registers would all differ in all bands with a probability of 0.763^51 = 1e-6. Registers of a small set depend on each other, so
   classes of at most SMALL shingles have further buckets, which are exact: the rarest of their shingles, as many as any set that
   reaches the similarity must share one of.
4. linking.link() compares each class with some leaders of its buckets a round, then all pairs across components that share
   one of the rarest shingles of the classes still in buckets of several components.
5. Candidates are pruned by set sizes (exact) and by the likelihood estimate, with six standard errors of room; the rest are verified on the
   full sets, which are read from the texts once.
6. Components are found by star contractions. Nothing is collected but counts.

Defined results: null or wordless texts have no shingles and stay alone with their own id; rows with the same id and text form one
class, and each is `kept` (deduplicate() leaves one of them); rows with a null id take part, and their class is named by the least id
that is not null; empty tables give empty results; other columns play no part. Very long texts: a task holds the sets of a batch
of 2 MB of text or of one longer text, at about 60 bytes a word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swingtrace.llm.common import SPACES, bitmap, discard, narrowed, stored, table
from swingtrace.llm.hashing import batches, set_key, shingle_sets
from swingtrace.llm.linking import BATCH_BYTES, class_sets, each_shingle, fits, link, rarest, share, shared_buckets, with_components
from swingtrace.llm.setsketch import REGISTERS, similarity, sketches

BAND = 5
SMALL = 43  # a set of 32 shingles can reach 0.75 with one of 42
MARGIN = 0.17  # six standard errors of the estimate at 256 registers


def prints(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", k: int = 5) -> DataFrame:
    """(doc_id, text_hash, n_shingles, key, registers, few) for every row; few: the shingles of sets of at most SMALL."""

    def run(iterator):
        for batch, texts in batches(iterator, BATCH_BYTES):
            sets = shingle_sets(texts, k)
            regs = sketches(sets)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([set_key(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([r.tobytes() if len(s) else None for s, r in zip(sets, regs, strict=True)], pa.binary()),
                    pa.array([s.view(np.int64) if 0 < len(s) <= SMALL else None for s in sets], pa.list_(pa.int64())),
                ],
                names=["doc_id", "text_hash", "n_shingles", "key", "registers", "few"],
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    told = f"doc_id {kind}, text_hash long, n_shingles long, key binary, registers binary, few array<long>"
    return rows.mapInArrow(run, told)


def bands(sets: DataFrame) -> DataFrame:
    """(bucket, key, n, pos): a row for each band of a class's registers."""
    each = F.transform(
        F.sequence(F.lit(0), F.lit(REGISTERS // BAND - 1)),
        lambda i: F.xxhash64(i, F.substring("registers", i * (2 * BAND) + 1, F.lit(2 * BAND))),
    )
    return sets.select(F.explode(each).alias("bucket"), "key", F.col("n_shingles").alias("n"), F.lit(0).cast("long").alias("pos"))


def _verified(pairs: DataFrame, sets: DataFrame, pct: int) -> DataFrame:
    """The pairs whose sketches do not speak against the similarity and whose full sets reach it."""
    least = pct / 100 - MARGIN

    def run(iterator):
        for batch in iterator:
            good = np.zeros(batch.num_rows, bool)
            na, nb = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("na", "nb"))
            for at in range(0, batch.num_rows, 2000):
                part, rows = batch.slice(at, 2000), slice(at, at + 2000)
                ra, rb = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("ra", "rb"))
                good[rows] = similarity(ra, rb, na[rows], nb[rows]) >= least
            likely = batch.filter(pa.array(good))
            sure = [
                share(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), pct)
                for x, y in zip(likely.column("sa").to_pylist(), likely.column("sb").to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([likely.column("a"), likely.column("b")], names=["a", "b"]).filter(pa.array(sure, pa.bool_()))

    side = lambda c: sets.select(
        F.col("key").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("registers").alias(f"r{c}"), F.col("shingles").alias(f"s{c}")
    )
    keys = stored(pairs.select(F.col("a").alias("key")).unionAll(pairs.select("b")).distinct(), "paired")
    sets = narrowed(sets, [F.col("key")], bitmap(keys))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "b", "na", "nb", "ra", "rb", "sa", "sb").mapInArrow(run, "a binary, b binary")


def near_copies(
    docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", k: int = 5, pct: int = 75, rounds: int = 3
) -> DataFrame:
    """Per row of docs: doc_id, text_hash, n_shingles, component_id, kept."""
    wide = stored(prints(docs, text=text, doc_id=doc_id, k=k), "prints")
    found = stored(wide.select("doc_id", "text_hash", "n_shingles", "key"), "found")
    sets = stored(
        wide.filter("n_shingles > 0")
        .groupBy("key")
        .agg(
            F.min("text_hash").alias("text_hash"), F.max("n_shingles").alias("n_shingles"),
            F.first("registers").alias("registers"), F.first("few").alias("few"),
        ),
        "sets",
    )
    discard(wide)
    small = sets.filter("few IS NOT NULL").select("key", F.col("n_shingles").alias("n"), F.explode("few").alias("shingle"))
    rare = rarest(small, pct)
    mates = shared_buckets(bands(sets).unionAll(rare), fits(pct))
    discard(rare)
    keys = stored(mates.select("key").distinct(), "mated-keys")
    mated = narrowed(sets, [F.col("key")], bitmap(keys)).join(keys, "key")
    mated = stored(mated.select("key", "text_hash", "n_shingles", "registers"), "mated")
    discard(sets, keys)
    full = stored(mated.drop("text_hash").join(class_sets(docs, mated.select("key", "text_hash"), text, k), "key"), "full")
    discard(mated)
    by_key = full.select("key", F.col("n_shingles").alias("n"), "shingles")
    narrow = lambda left: rarest(each_shingle(narrowed(by_key, [F.col("key")], bitmap(left)).join(left, "key")), pct)
    labels = link(mates, lambda pairs: _verified(pairs, full, pct), fits(pct), rounds, narrow)
    out = with_components(found, labels)
    discard(full)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicate(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """docs with one row of each component: that with the least id. Of rows that repeat an id and its text one stays;
    rows of one id with different texts are different documents. Rows with a null id stay if no row with an id is linked.
    """
    verdict = stored(near_copies(docs, text=text, doc_id=doc_id, **options), "verdict")
    pair = lambda df, *names: df.select(*(F.col(c).alias(f"{c}_") for c in names))
    dropped = stored(pair(verdict.filter("not kept"), "doc_id", "text_hash").distinct(), "dropped")
    repeated = verdict.filter("kept").groupBy("doc_id", "text_hash").count().filter("count > 1")
    repeated = stored(pair(repeated, "doc_id", "text_hash"), "repeated")

    discard(verdict)
    named = stored(dropped.unionAll(repeated), "named")
    row_of = [docs[doc_id], F.xxhash64(docs[text])]
    asked = narrowed(docs, row_of, bitmap(named))

    def of(other: DataFrame):
        return docs[doc_id].eqNullSafe(other["doc_id_"]) & (F.xxhash64(docs[text]) == other["text_hash_"])

    kept = asked.join(dropped, of(dropped), "left_anti")
    once = kept.join(repeated, of(repeated), "left_anti")
    again = kept.join(repeated, of(repeated), "left_semi")
    return narrowed(docs, row_of, bitmap(named), out=True).unionAll(once).unionAll(again.dropDuplicates([doc_id, text]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents")).drop("text_hash")


def sql(source: str = "documents", k: int = 5, pct: int = 75) -> str:
    """DuckDB SQL of near_copies(): all pairs that share a shingle, counted in full."""
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^{SPACES}]+') AS ws FROM {source}),
s AS (SELECT DISTINCT doc_id, sh FROM (
  SELECT doc_id, list_slice(ws, i, i + {k - 1}) AS sh FROM w, LATERAL (SELECT unnest(range(1, len(ws) - {k - 2})) AS i) WHERE len(ws) >= {k}
  UNION ALL SELECT doc_id, ws FROM w WHERE len(ws) BETWEEN 1 AND {k - 1})),
n AS (SELECT w.doc_id, count(s.sh) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY 1),
hashed AS (SELECT doc_id, md5_number(array_to_string(sh, chr(1))) AS h FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM hashed a JOIN hashed b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {pct} * (x.n + y.n - c)),
r AS (SELECT doc_id AS d, doc_id AS m FROM n UNION SELECT l.b, r.m FROM r JOIN l ON l.a = r.d AND r.m < l.b)
SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, min(r.m)) AS component_id, n.doc_id = least(n.doc_id, min(r.m)) AS kept
FROM n JOIN r ON r.d = n.doc_id GROUP BY 1, 2"""
