"""Similarity join of shingle sets: prefix filters under several global token orders, intersected before verification.

Under any order of all tokens, two sets with a similarity of pct share a token in their prefixes (the first n - ceil(pct * n)
+ 1 tokens), and the sets' sizes, the places of the first shared token and the number of shared ones bound what follows.
A pair has to pass under every order:

1. One pass over the texts gives each row its set's size and key and counts all tokens and words of all rows in a table of
   `counters` + `words` hashed cells. Its size is fixed, so it can be sent to every task; results do not depend on it, for any
   order will do.
2. A token's level is its expected number by the frequencies of its words, or what its cell holds above the average of all cells if that is more: unlikely
   tokens come first, while phrases of common words and tokens of often copied texts come last. The three orders: by level; by powers of two of
   it, ties by a hash; by powers of four, by another hash. A second pass keeps each class's three prefixes.
3. The first order's prefix tokens are the buckets of linking.link(), which compares classes with leaders and then all
   pairs across components.
4. In each round the pairs to compare meet in their other prefixes first. Only the sets of pairs that pass there are read
   from the texts, stored for that round and deleted; a set is some ten times its prefix, and most pairs end at the prefixes.

Defined results: null or wordless texts have an empty set and stay alone under their own id; fewer words than a shingle make one
shingle; rows with the same id and text are one class; rows with a null id take part, and a component is named by the least id that is
not null (null if there is none); empty tables give empty results; other columns play no part. Very long texts: a task holds the
sets of a batch of 2 MB of text or of one longer text, at about 40 bytes a word.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swingtrace.llm.common import SPACES, bitmap, discard, narrowed, stored, table
from swingtrace.llm.hashing import batches, mix, salt, set_key, shingle_places
from swingtrace.llm.linking import BATCH_BYTES, class_sets, fits, link, share, shared_buckets, with_components

COUNTERS = 1 << 22
WORDS = 1 << 20
CELLS = 1 << 14  # counters a row when counts are added up
STEPS = 256  # levels for each power of two
LONG = 64  # tokens kept of the second order if its prefix has fewer: these tell short sets apart


def prefix_length(n: int, pct: int) -> int:
    return n - -(-pct * n // 100) + 1 if n else 0


def _counted(docs: DataFrame, text: str, doc_id: str, k: int, counters: int, words: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, key) of every row, and rows (block, counts) with the counts of each task: tokens, then words."""

    def add(counts, hashes, n):
        cells, often = np.unique((hashes & np.uint64(n - 1)).astype(np.int64), return_counts=True)
        counts[cells] += often.astype(np.uint32)

    def run(iterator):
        names = ["doc_id", "text_hash", "n_shingles", "key", "block", "counts"]
        counts, kind = np.zeros(counters + words, np.uint32), None
        for batch, texts in batches(iterator, BATCH_BYTES):
            hashes, sets, _ = shingle_places(texts, k)
            kind = batch.schema.field(0).type
            add(counts[counters:], hashes, words)
            add(counts[:counters], np.concatenate(sets), counters)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([set_key(s) if len(s) else None for s in sets], pa.binary()),
                 pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())],
                names=names,
            )
        blocks = [b for b in range(len(counts) // CELLS) if counts[b * CELLS : (b + 1) * CELLS].any()]
        for at in range(0, len(blocks), 64):
            some = blocks[at : at + 64]
            packed = [zlib.compress(counts[b * CELLS : (b + 1) * CELLS].tobytes(), 1) for b in some]
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(some), kind), pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.binary()),
                 pa.array(some, pa.int32()), pa.array(packed, pa.binary())],
                names=names,
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    return rows.mapInArrow(run, f"doc_id {kind}, text_hash long, n_shingles long, key binary, block int, counts binary")


def _levels(counted: DataFrame, counters: int, words: int) -> tuple[np.ndarray, float]:
    """A 16-bit level for each cell, STEPS times a binary logarithm: of what a token's cell holds above the average and
    its spread, and of a word's count. Beside it, the logarithm of the number of tokens.
    """
    total = counted.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    usual = total / counters + 3 * (total / counters) ** 0.5

    def run(pieces: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, block = 0, None
        for piece in pieces:
            for b, packed in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                block, n = b, n + np.frombuffer(zlib.decompress(packed), np.uint32).astype(np.float64)
        if block * CELLS < counters:
            n = np.maximum(0, n - usual)
        level = np.minimum(65535, STEPS * np.log2(1.0 + n)).astype(np.uint16)
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["block", "level"])

    rows = counted.filter("block IS NOT NULL").select("block", "counts").groupBy("block").applyInArrow(run, "block int, level binary")
    out = np.zeros(counters + words, np.uint16)
    for r in rows.toLocalIterator():  # a fixed number of rows, whatever the input
        out[r["block"] * CELLS : (r["block"] + 1) * CELLS] = np.frombuffer(r["level"], np.uint16)
    return out, float(np.log2(max(1, total)))


def token_levels(tokens: np.ndarray, places: np.ndarray, hashes: np.ndarray, levels: np.ndarray, scale: float, k: int, counters: int) -> np.ndarray:
    """The level of each token, from its cell and from the k words where it first stands."""
    words = len(levels) - counters
    seen = levels[(tokens & np.uint64(counters - 1)).astype(np.int64)].astype(np.float64)
    likely = np.full(len(tokens), -(k - 1) * scale)
    for j in range(k):
        at = np.minimum(places + j, len(hashes) - 1)
        likely += levels[counters + (hashes[at] & np.uint64(words - 1)).astype(np.int64)] / STEPS
    return np.maximum(seen, np.minimum(65535, STEPS * np.logaddexp2(0.0, likely))).astype(np.uint16)


def orders(tokens: np.ndarray, level: np.ndarray) -> list[np.ndarray]:
    """Keys of the tokens by which they stand in each global order, distinct tokens at distinct places but for a chance of 2^-48."""
    step = level.astype(np.uint64)
    room, bits = np.uint64(48), np.uint64(16)
    return [
        (step << room) | (tokens >> bits),
        ((step >> np.uint64(8)) << room) | (mix(tokens + salt(101)) >> bits),
        ((step >> np.uint64(9)) << room) | (mix(tokens + salt(202)) >> bits),
    ]


def _prefixes(docs: DataFrame, levels: np.ndarray, scale: float, text: str, k: int, pct: int, counters: int) -> DataFrame:
    """(key, n, p0, p1, p2) of every class with a shingle: its prefix under each order, 8 bytes a token in p0, 4 in the others; LONG tokens or more in p1."""
    sent = docs.sparkSession.sparkContext.broadcast(levels)  # 2 bytes a counter

    def run(iterator):
        level = sent.value
        for batch, texts in batches(iterator, BATCH_BYTES):
            rows = []
            hashes, sets, places = shingle_places(texts, k)
            for s, at in zip(sets, places, strict=True):
                if not len(s):
                    continue
                own_levels = token_levels(s, at, hashes, level, scale, k, counters)
                p, row = prefix_length(len(s), pct), [set_key(s), len(s)]
                for o, place in enumerate(orders(s, own_levels)):
                    most = max(p, LONG) if o == 1 else p
                    at = np.argpartition(place, most - 1)[:most] if most < len(s) else np.arange(len(s))
                    own = s[at[np.argsort(place[at])]]
                    row.append((own if o == 0 else own.astype(np.uint32)).tobytes())
                rows.append(row)
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["key", "n", "p0", "p1", "p2"])

    rows = docs.select(F.col(text).alias("text")).mapInArrow(run, "key binary, n long, p0 binary, p1 binary, p2 binary")
    return rows.groupBy("key").agg(*(F.first(c).alias(c) for c in ("n", "p0", "p1", "p2")))


def _buckets(prefixes: DataFrame) -> DataFrame:
    """(bucket, key, n, pos): a row for each token of the first order's prefix."""

    def run(iterator):
        for batch in iterator:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                tokens = [np.frombuffer(b, np.int64) for b in part.column(2).to_pylist()]
                sizes = np.array([len(t) for t in tokens], np.int64)
                of = pa.array(np.repeat(np.arange(len(tokens)), sizes))
                pos = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(tokens)), part.column(0).take(of), part.column(1).take(of), pa.array(pos, pa.int64())],
                    names=["bucket", "key", "n", "pos"],
                )

    return prefixes.select("key", "n", "p0").mapInArrow(run, "bucket long, key binary, n long, pos long")


def passes(a: np.ndarray, b: np.ndarray, na: int, nb: int, pct: int) -> bool:
    """The filter of one order: where two prefixes first share a token, enough can follow, and enough of their tokens are shared.

    Longer prefixes than prefix_length() rule out more. The prefix that ends first under the order lies within the other's range: what it does not share there, its set does not share at all.
    """
    both = np.sort(np.concatenate([a, b]))
    shared = int(np.count_nonzero(both[1:] == both[:-1]))  # or more, where a prefix holds a value twice
    if not shared or (100 + pct) * (shared + max(na - len(a), nb - len(b))) < pct * (na + nb):
        return False
    _, i, j = np.intersect1d(a, b, return_indices=True)
    if not len(i):
        return False
    first = i.argmin()
    return (100 + pct) * min(na - int(i[first]), nb - int(j[first])) >= pct * (na + nb)


def _likely(pairs: DataFrame, prefixes: DataFrame, pct: int) -> DataFrame:
    """The pairs (a stored table) that pass under the other orders too; `prefixes` (key, n, p1, p2) is narrowed to their classes before it moves."""

    def run(iterator):
        for batch in iterator:
            c = {n: batch.column(n).to_pylist() for n in batch.schema.names}
            good = []
            for k in range(batch.num_rows):
                na, nb = c["na"][k], c["nb"][k]
                good.append(
                    all(passes(np.frombuffer(c[f"{p}a"][k], np.uint32), np.frombuffer(c[f"{p}b"][k], np.uint32), na, nb, pct) for p in ("p1", "p2"))
                )
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    def side(e: str) -> DataFrame:
        own = narrowed(prefixes, [F.col("key")], bitmap(pairs.select(F.col(e).alias("key")).distinct()))
        return own.select(F.col("key").alias(e), *(F.col(x).alias(f"{x}{e}") for x in ("n", "p1", "p2")))

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a binary, b binary")


def _verified(pairs: DataFrame, sets: DataFrame, pct: int) -> DataFrame:
    """The pairs whose full sets reach the similarity."""

    def run(iterator):
        for batch in iterator:
            both = zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True)
            good = [share(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), pct) for x, y in both]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    side = lambda e: sets.select(F.col("key").alias(e), F.col("shingles").alias(f"s{e}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a binary, b binary")


def similar(
    docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", k: int = 3, pct: int = 90, counters: int = COUNTERS, words: int = WORDS, rounds: int = 3
) -> DataFrame:
    """Per row of docs: doc_id, text_hash, n_shingles, component_id. `counters` and `words` are powers of two, CELLS at least."""
    counted = stored(_counted(docs, text, doc_id, k, counters, words), "counted")
    levels, scale = _levels(counted, counters, words)
    found = stored(counted.filter("block IS NULL").select("doc_id", "text_hash", "n_shingles", "key"), "found")
    discard(counted)
    prefixes = stored(_prefixes(docs, levels, scale, text, k, pct, counters), "prefixes")
    mates = shared_buckets(_buckets(prefixes), fits(pct))
    reps = found.groupBy("key").agg(F.min("text_hash").alias("text_hash"))
    mated = stored(mates.select("key").distinct().join(reps, "key"), "mated")
    others = stored(narrowed(prefixes.select("key", "n", "p1", "p2"), [F.col("key")], bitmap(mated.select("key"))), "others")
    discard(prefixes)
    held: list[DataFrame] = []  # what the round's links are read from

    def verify(pairs: DataFrame) -> DataFrame:
        discard(*held)
        likely = stored(_likely(pairs, others, pct), "likely")
        held[:] = [likely]
        if likely.isEmpty():
            return likely
        keys = likely.select(F.col("a").alias("key")).unionAll(likely.select("b")).distinct()
        needed = stored(keys.join(mated, "key"), "needed")
        sets = stored(class_sets(docs, needed, text, k), "sets")
        discard(needed)
        held.append(sets)
        return _verified(likely, sets, pct)

    labels = link(mates, verify, fits(pct), rounds)
    discard(*held, mated, others)
    return with_components(found, labels)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents")).drop("text_hash")


def sql(source: str = "documents", k: int = 3, pct: int = 90) -> str:
    """DuckDB SQL of query(): all pairs that share a shingle among those whose sizes fit, counted in full."""
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^{SPACES}]+') AS ws FROM {source}),
s AS (SELECT DISTINCT doc_id, sh FROM (
  SELECT doc_id, list_slice(ws, i, i + {k - 1}) AS sh FROM w, LATERAL (SELECT unnest(range(1, len(ws) - {k - 2})) AS i) WHERE len(ws) >= {k}
  UNION ALL SELECT doc_id, ws FROM w WHERE len(ws) BETWEEN 1 AND {k - 1})),
n AS (SELECT w.doc_id, count(s.sh) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY 1),
hashed AS (SELECT s.doc_id, n.n, md5_number(array_to_string(sh, chr(1))) AS h FROM s JOIN n USING (doc_id)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM hashed a JOIN hashed b ON a.h = b.h AND a.doc_id <> b.doc_id
  AND 100 * least(a.n, b.n) >= {pct} * greatest(a.n, b.n) GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {pct} * (x.n + y.n - c)),
r AS (SELECT doc_id AS d, doc_id AS m FROM n UNION SELECT l.b, r.m FROM r JOIN l ON l.a = r.d AND r.m < l.b)
SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, min(r.m)) AS component_id
FROM n JOIN r ON r.d = n.doc_id GROUP BY 1, 2"""
