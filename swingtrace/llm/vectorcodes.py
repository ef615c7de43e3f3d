"""Vector code compression: product codes whose codebooks are trained by Lloyd rounds over cover trees.

1. Components become integers, floor(scale * x); a vector is cut into equal consecutive parts.
2. Each task packs its vectors into blocks and builds one cover tree a part and block: a node holds a centre, the
   largest distance from it, and the sum and number of the vectors below it, which lie side by side. Trees are stored
   once in the shared folder.
3. A Lloyd round walks all trees with the codebook of that round. A node whose second nearest entry is farther than
   its nearest by more than twice the node's radius belongs to the nearest as a whole, by the triangle inequality, and
   gives its sums; only ambiguous nodes descend, down to exact integer comparisons in the leaves. Sums are added by
   Spark; the driver gets one row per part and entry.
4. The last walk gives every vector its code and its exact error.

Defined results: rows whose vector is null, empty, or has null or non-finite components are dropped; so are rows whose vector
is of another length than the first kept row by id (ties: by vector; null ids last), for no codebook fits them. A length that does
not divide into the parts is an error. Fewer rows than entries make fewer entries. Repeated rows are kept one by one; rows with a null
id have codes and errors like others; equal labels share a sum, nulls together; a table without kept rows gives an
empty result; other columns play no part. Components must be under 2^16 in size, so that squares stay exact in 64 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swingtrace.llm.common import stored, table

BLOCK = 4096
LEAF = 12
ROOM = 1e-6  # distances are floating point: a node is given away only if it is clear by more than this share


def cover_tree(points: np.ndarray) -> tuple[np.ndarray, ...]:
    """(order, centres, radii, sums, starts, ends, first child, children) of a cover tree, nodes level by level.

    The children of a node are centres that cover its points within half its radius, each point going to the first centre
    that covers it.
    """
    order = np.arange(len(points))
    level = [(0, len(points))]
    nodes: list[tuple] = []
    while level:
        below: list[tuple] = []
        for start, end in level:
            own = points[order[start:end]]
            total = own.sum(axis=0)
            centre = total // len(own)
            far = np.sqrt(((own - centre) ** 2).sum(axis=1))
            radius = float(far.max())
            first = kids = 0
            if len(own) > LEAF and radius > 0:
                rest, groups = np.arange(len(own)), []
                while len(rest):
                    gap = np.sqrt(((own[rest] - own[rest[0]]) ** 2).sum(axis=1))
                    near = gap <= radius / 2
                    groups.append(rest[near])
                    rest = rest[~near]
                order[start:end] = order[start:end][np.concatenate(groups)]
                sizes = np.cumsum([0, *map(len, groups)])
                first, kids = len(below), len(groups)
                below += [(start + int(a), start + int(b)) for a, b in zip(sizes[:-1], sizes[1:], strict=True)]
            nodes.append((centre, radius, total, start, end, first, kids))
        offset = len(nodes)
        at = len(nodes) - len(level)
        for k in range(at, len(nodes)):
            if nodes[k][6]:
                nodes[k] = (*nodes[k][:5], nodes[k][5] + offset, nodes[k][6])
        level = below
    columns = list(zip(*nodes, strict=True))
    return (
        order.astype(np.int64), np.array(columns[0], np.int64), np.array(columns[1], np.float64), np.array(columns[2], np.int64),
        *(np.array(c, np.int64) for c in columns[3:]),
    )


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all rows of b, in integers."""
    return ((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2)


def walk(tree: tuple[np.ndarray, ...], points: np.ndarray, book: np.ndarray):
    """Yields (entry, start, end, sum) of whole nodes, then (entry, position, None, vector) of points compared one by one.

    Arrays throughout; positions are places in the tree's order, in which `points` stand.
    """
    _, centres, radii, sums, starts, ends, first, kids = tree
    front = np.zeros(1, np.int64)
    while len(front):
        gaps = np.sqrt(squared(centres[front], book).astype(np.float64))
        best = gaps.argmin(axis=1)
        nearest = gaps[np.arange(len(front)), best]
        gaps[np.arange(len(front)), best] = np.inf
        reach = 2 * radii[front]
        clear = gaps.min(axis=1) - nearest > reach + ROOM * (1 + reach + nearest)
        whole = front[clear]
        yield best[clear], starts[whole], ends[whole], sums[whole]
        rest = front[~clear]
        leaves = rest[kids[rest] == 0]
        if len(leaves):
            size = ends[leaves] - starts[leaves]
            at = np.repeat(starts[leaves] - np.cumsum(size) + size, size) + np.arange(size.sum())
            for k in range(0, len(at), 65536):
                some = at[k : k + 65536]
                yield squared(points[some], book).argmin(axis=1), some, None, points[some]
        inner = rest[kids[rest] > 0]
        front = np.repeat(first[inner] - np.cumsum(kids[inner]) + kids[inner], kids[inner]) + np.arange(kids[inner].sum())


_KINDS = (np.int64, np.int64, np.float64, np.int64, np.int64, np.int64, np.int64, np.int64)


def _unpack(row: dict, width: int):
    """Per part: the tree and its points in the tree's order."""
    for packed, points in zip(row["trees"], row["points"], strict=True):
        tree = [np.frombuffer(b, kind) for b, kind in zip(packed, _KINDS, strict=True)]
        tree[1], tree[3] = tree[1].reshape(-1, width), tree[3].reshape(-1, width)
        yield tuple(tree), np.frombuffer(points, np.int64).reshape(-1, width)


def _kept(vectors: DataFrame, vector: str, vec_id: str, label: str) -> DataFrame:
    """(vec_id, label, v) with v an array of double, of usable rows only."""
    v = F.col("v")
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(v.isNotNull() & (F.size(v) > 0) & ~bad)


def _trees(kept: DataFrame, width: int, parts: int, scale: int, block: int) -> DataFrame:
    """One row per block of a task's rows: ids, labels, and per part the packed tree and its points."""
    fields = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    dim = width * parts

    def one_list(pieces):
        return pa.ListArray.from_arrays([0, sum(map(len, pieces))], pa.concat_arrays(pieces))

    def packed(ids, labels, values):
        ints = np.floor(scale * np.concatenate(values).reshape(-1, dim)).astype(np.int64)
        trees, points = [], []
        for k in range(parts):
            own = ints[:, k * width : (k + 1) * width]
            tree = cover_tree(own)
            trees.append([a.tobytes() for a in tree])
            points.append(own[tree[0]].tobytes())
        return pa.RecordBatch.from_arrays(
            [one_list(ids), one_list(labels),
             pa.array([trees], pa.list_(pa.list_(pa.binary()))), pa.array([points], pa.list_(pa.binary()))],
            names=["ids", "labels", "trees", "points"],
        )

    def run(iterator):
        ids, labels, values, n = [], [], [], 0
        for batch in iterator:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                ids.append(part.column(0))
                labels.append(part.column(1))
                values.append(part.column(2).flatten().to_numpy(zero_copy_only=False))
                n += part.num_rows
                if n >= block:
                    yield packed(ids, labels, values)
                    ids, labels, values, n = [], [], [], 0
        if n:
            yield packed(ids, labels, values)

    told = f"ids array<{fields['vec_id']}>, labels array<{fields['label']}>, trees array<array<binary>>, points array<binary>"
    return kept.mapInArrow(run, told)


def _summed(trees: DataFrame, books: list[np.ndarray], width: int) -> DataFrame:
    """(part, entry, sums, n): what each entry is given by all trees."""

    def run(iterator):
        for batch in iterator:
            for row in batch.to_pylist():
                out = []
                for part, (tree, points) in enumerate(_unpack(row, width)):
                    sums, n = np.zeros((len(books[part]), width), np.int64), np.zeros(len(books[part]), np.int64)
                    for entry, start, end, total in walk(tree, points, books[part]):
                        np.add.at(sums, entry, total)
                        np.add.at(n, entry, 1 if end is None else end - start)
                    out += [(part, e, sums[e].tolist(), int(n[e])) for e in np.flatnonzero(n).tolist()]
                c = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c[0], pa.int32()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.list_(pa.int64())), pa.array(c[3], pa.int64())],
                    names=["part", "entry", "sums", "n"],
                )

    found = trees.select("trees", "points").mapInArrow(run, "part int, entry int, sums array<long>, n long")
    total = [F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(width)]
    return found.groupBy("part", "entry").agg(*total, F.sum("n").alias("n"))


def _coded(trees: DataFrame, books: list[np.ndarray], width: int) -> DataFrame:
    """(vec_id, label, code, error) of every kept row."""

    def run(iterator):
        for batch in iterator:
            for at in range(batch.num_rows):
                one = batch.slice(at, 1)
                ids, labels = one.column(0).flatten(), one.column(1).flatten()
                codes, error = np.zeros((len(ids), len(books)), np.uint8), np.zeros(len(ids), np.int64)
                row = {"trees": one.column(2).to_pylist()[0], "points": one.column(3).to_pylist()[0]}
                for part, (tree, points) in enumerate(_unpack(row, width)):
                    own = np.zeros(len(ids), np.uint8)
                    for entry, start, end, _ in walk(tree, points, books[part]):
                        if end is None:
                            own[start] = entry
                        else:
                            for e, s, t in zip(entry.tolist(), start.tolist(), end.tolist(), strict=True):
                                own[s:t] = e
                    order = tree[0]
                    codes[order, part] = own
                    error[order] += ((points - books[part][own]) ** 2).sum(axis=1)
                code = [c.tobytes().hex() for c in codes]
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(code, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    kinds = {f.name: f.dataType.elementType.simpleString() for f in trees.schema.fields if f.name in ("ids", "labels")}
    return trees.mapInArrow(run, f"vec_id {kinds['ids']}, label {kinds['labels']}, code string, error long")


def compress(
    vectors: DataFrame,
    *,
    vector: str = "embedding",
    vec_id: str = "vec_id",
    label: str = "label",
    parts: int = 8,
    entries: int = 16,
    rounds: int = 6,
    scale: int = 4096,
    block: int = BLOCK,
) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error) of every usable row, and the codebook of each part.

    At most 256 entries a part: a code has two hex digits each.
    """
    kept = _kept(vectors, vector, vec_id, label)
    kind = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    by_id = [F.col("vec_id").asc_nulls_last(), F.col("v")]
    first = kept.orderBy(*by_id).limit(1).collect()
    if not first:
        nothing = f"vec_id {kind['vec_id']}, label {kind['label']}, code string, error long"
        return vectors.sparkSession.createDataFrame([], nothing), []
    dim = len(first[0]["v"])
    if dim % parts:
        raise ValueError(f"vectors of length {dim} do not divide into {parts} parts")
    width = dim // parts
    kept = kept.filter(F.size("v") == dim)
    seeds = kept.orderBy(*by_id).limit(entries).select("v").collect()
    start = np.floor(scale * np.array([r["v"] for r in seeds])).astype(np.int64)
    books = [start[:, k * width : (k + 1) * width].copy() for k in range(parts)]
    trees = stored(_trees(kept, width, parts, scale, block), "trees")
    for _ in range(rounds):
        for row in _summed(trees, books, width).collect():  # one row per part and entry
            books[row["part"]][row["entry"]] = [row[f"s{k}"] // row["n"] for k in range(width)]
    return _coded(trees, books, width), books


def told(books: list[np.ndarray]) -> str:
    """Hash of all components of all entries by part, entry and position."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    coded = stored(coded, "codes")
    by_label = stored(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"), "label-errors")
    both = coded.join(by_label, coded["label"].eqNullSafe(by_label["of"]))
    return both.select("vec_id", "code", "error", "label_error", F.lit(told(books)).alias("codebooks_sha256"))


def sql(source: str = "embeddings", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """DuckDB SQL of query(): every part compared with every entry in every round."""
    floor_div = "(CASE WHEN s >= 0 THEN s // n ELSE -((-s + n - 1) // n) END)"
    steps = []
    gap = "list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    for r in range(rounds + 1):
        steps.append(
            f"g{r} AS MATERIALIZED (SELECT p.row, p.part, arg_min(b.entry, {gap}::BIGINT * 1000 + b.entry) AS entry, "
            f"min({gap})::BIGINT AS gap FROM p JOIN b{r} b USING (part) GROUP BY 1, 2)"
        )
        if r < rounds:
            steps.append(
                f"b{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(any_value(m.x), any_value(b{r}.x)) AS x FROM b{r} LEFT JOIN ("
                f"SELECT part, entry, list({floor_div} ORDER BY pos) AS x FROM (SELECT part, entry, pos, sum(x[pos])::BIGINT AS s, "
                f"count(*)::BIGINT AS n FROM p JOIN g{r} USING (row, part), LATERAL (SELECT unnest(range(1, len(x) + 1)) AS pos) "
                f"GROUP BY 1, 2, 3) GROUP BY 1, 2) m USING (part, entry) GROUP BY 1, 2)"
            )
    last = f"b{rounds}"
    return f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label,
    list_transform(embedding, lambda v: floor({scale} * v::DOUBLE)::BIGINT) AS v FROM {source}
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
p AS MATERIALIZED (SELECT row, part, list_slice(v, part * len(v) // {parts} + 1, (part + 1) * len(v) // {parts}) AS x
    FROM k, LATERAL (SELECT unnest(range({parts})) AS part)),
b0 AS MATERIALIZED (SELECT part, row - 1 AS entry, x FROM p WHERE row <= {entries}),
{", ".join(steps)},
c AS (SELECT row, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(gap)::BIGINT AS error FROM g{rounds} GROUP BY 1),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS h FROM {last})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT h FROM h) AS codebooks_sha256
FROM c JOIN k USING (row)"""
