"""Links between classes that share buckets, and the components they make.

Both similarity operators put every class (a distinct set) into buckets such that two linked classes share one. Comparing all
pairs of a bucket is quadratic in a group of near copies, though nearly all of them end in one component. So:

1. In a leader round a class is compared with a fixed number of others: of the leaders of its buckets outside its own component, those which it
   meets most often. In the first round the class with most shared buckets leads (the text the others were derived from), later a random
   one of the bucket's largest component, and only rows outside that component look for leaders.
2. Buckets whose classes all lie in one component are left out from then on.
3. After the rounds every pair across components that shares a bucket is compared, no matter how many there are: the rows outside
   a bucket's largest component against the rows of the bucket. For this pass the buckets may be exchanged for narrower ones that are exact as
   well: the rarest shingles of the classes left (rarest()). A group's outliers share few of those. No pair is given up.

Hot buckets are aggregated before they move and split by the skew join; each round's tables are written to the shared
folder and deleted once the next round's are there.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swingtrace.llm.common import bitmap, discard, narrowed, stored
from swingtrace.llm.components import components
from swingtrace.llm.hashing import batches, set_key, shingle_sets

BATCH_BYTES = 1 << 21
LISTED = 64  # rows of a bucket up to which its pairs are tried at once
LEADERS = 8  # tried by a class in each round but the first

#: Decides pairs: takes (a, b), returns those that are linked.
Verify = Callable[[DataFrame], DataFrame]

#: Whether two rows of a bucket can be linked, from their (n, pos): sizes of the sets and places in the bucket's order.
Fits = Callable[[Column, Column, Column, Column], Column]


def shared_buckets(rows: DataFrame, fits: Fits) -> DataFrame:
    """rows (bucket, key, n, pos) that may have a partner in their bucket.

    In buckets of up to LISTED rows each row is held against the others by sizes and places; larger ones are kept as they are.
    """
    several = stored(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1"), "several")
    shared = narrowed(rows, [F.col("bucket")], bitmap(several.select("bucket"))).join(several, "bucket")
    listed = shared.filter(F.col("rows") <= LISTED).groupBy("bucket").agg(F.collect_list(F.struct("key", "n", "pos")).alias("all"))
    partner = lambda x: F.exists("all", lambda y: (x["key"] != y["key"]) & fits(x["n"], x["pos"], y["n"], y["pos"]))
    paired = listed.select("bucket", F.explode(F.filter("all", partner)).alias("x")).select("bucket", "x.key", "x.n", "x.pos")
    large = shared.filter(F.col("rows") > LISTED).select("bucket", "key", "n", "pos")
    mates = stored(paired.unionByName(large), "mates")
    discard(several)
    return mates


def _merged(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """nodes (key, degree, label) with the labels of components joined by links (a, b)."""
    label_of = lambda c: nodes.select(F.col("key").alias(c), F.col("label").alias(f"l{c}"))
    edges = links.join(label_of("a"), "a").join(label_of("b"), "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    joined = components(edges).select(F.col("node").alias("label"), F.col("label").alias("new"))
    out = nodes.join(joined, "label", "left").select("key", "degree", F.coalesce("new", "label").alias("label"))
    return stored(out, "nodes")


def _leader_pairs(placed: DataFrame, turn: int, fits: Fits) -> DataFrame:
    """(a, b): each class with the leaders outside its component that it meets in most of its buckets.

    A bucket has one leader a round, so a class meets no more than it has buckets. The same classes lead wherever they are, so
    a leader met in many buckets shares much with the class. After the first round the bucket's largest component leads
    and only rows outside it look for a leader.
    """
    if turn == 0:
        inside, outside, first = placed, placed, -F.col("degree")
    else:
        inside, outside = placed.filter("label = main"), placed.filter("label != main")
        first = F.xxhash64("key", F.lit(turn))
    rank = F.struct(first.alias("first"), "key")
    leads = inside.groupBy("bucket").agg(F.min(F.struct(rank.alias("rank"), "label", "n", "pos")).alias("lead"))
    other = (F.col("label") != F.col("lead.label")) & fits(F.col("n"), F.col("pos"), F.col("lead.n"), F.col("lead.pos"))
    own = outside.join(leads, "bucket").filter(other).select("key", F.col("lead.rank.key").alias("leader"))
    often = own.groupBy("key", "leader").agg(F.count(F.lit(1)).alias("often"))
    best = often.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("often", "leader")), asc=False).alias("best"))
    tried = F.slice("best", 1, LEADERS if turn else 1)
    return best.select(F.col("key").alias("a"), F.explode(tried).alias("best")).select("a", F.col("best.leader").alias("b"))


def _open_rows(placed: DataFrame) -> DataFrame:
    """Rows of buckets that still hold several components, with the label of the component that has most rows there."""
    per_label = placed.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("rows"))
    of_bucket = per_label.groupBy("bucket").agg(F.count(F.lit(1)).alias("labels"), F.max(F.struct("rows", "label")).alias("most"))
    several = of_bucket.filter("labels > 1").select("bucket", F.col("most.label").alias("main"))
    return placed.join(several, "bucket")


def _pairs_across(opened: DataFrame, fits: Fits) -> DataFrame:
    """(a, b): every pair of classes of different components that shares a bucket and fits."""
    few = opened.filter(F.col("label") != F.col("main")).select(
        "bucket", F.col("key").alias("a"), F.col("label").alias("la"), F.col("n").alias("na"), F.col("pos").alias("pa")
    )
    rows = opened.select("bucket", F.col("key").alias("b"), F.col("label").alias("lb"), F.col("n").alias("nb"), F.col("pos").alias("pb"), "main")
    once = (F.col("lb") == F.col("main")) | (F.col("a") < F.col("b"))
    both = few.join(rows, "bucket").filter((F.col("la") != F.col("lb")) & once & fits(F.col("na"), F.col("pa"), F.col("nb"), F.col("pb")))
    return both.select("a", "b").distinct()


def each_shingle(sets: DataFrame) -> DataFrame:
    """(key, n, shingle): a row for each shingle of sets (key, n, shingles)."""

    def run(iterator):
        for batch in iterator:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                shingles = [np.frombuffer(b, np.int64) for b in part.column(2).to_pylist()]
                of = pa.array(np.repeat(np.arange(len(shingles)), [len(x) for x in shingles]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(of), part.column(1).take(of), pa.array(np.concatenate(shingles))], names=["key", "n", "shingle"]
                )

    return sets.select("key", "n", "shingles").mapInArrow(run, "key binary, n long, shingle long")


def rarest(rows: DataFrame, pct: int) -> DataFrame:
    """(bucket, key, n, pos): of rows (key, n, shingle) the rarest of each class, of which two linked classes share one.

    The places are those under one order of all shingles, rare ones first. A class has n rows; its shingles of one class
    alone come first, so they are counted and do not move.
    """
    often = stored(rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("often")).filter("often > 1"), "often")
    shared = narrowed(rows, [F.col("shingle")], bitmap(often.select("shingle"))).join(often, "shingle")
    ordered = shared.groupBy("key", "n").agg(F.sort_array(F.collect_list(F.struct("often", "shingle"))).alias("s"))
    alone = (F.col("n") - F.size("s")).cast("int")  # these come first in the order
    length = (F.col("n") - F.ceil(F.col("n") * pct / 100) + 1).cast("int")
    rare = F.slice("s", F.lit(1), F.greatest(F.lit(0), length - alone))
    placed = ordered.select("key", "n", alone.alias("alone"), F.posexplode(rare).alias("pos", "s"))
    placed = placed.select(
        F.xxhash64(F.lit("rare"), "s.shingle").alias("bucket"), "key", "n", (F.col("alone") + F.col("pos")).cast("long").alias("pos")
    )
    out = stored(placed, "rare")
    discard(often)
    return out


def link(mates: DataFrame, verify: Verify, fits: Fits, rounds: int, narrow: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(key, label) of all classes in `mates` (bucket, key, n, pos): equal labels are linked, directly or through others.

    Before all pairs across components are compared, `narrow` may give the classes left (key; a stored table) narrower buckets.
    `mates` is a stored table; it is deleted here.
    """
    nodes = stored(mates.groupBy("key").agg(F.count(F.lit(1)).alias("degree")).withColumn("label", F.col("key")), "nodes")
    rows = mates
    for turn in range(rounds + 1):
        placed = stored(rows.select("bucket", "key", "n", "pos").join(nodes, "key"), "placed")
        discard(rows)
        if turn:
            rows = stored(_open_rows(placed), "open")
            discard(placed)
            if rows.isEmpty():
                break
        else:
            rows = placed  # every bucket holds several classes, and each class is a component of its own
        if turn == rounds and narrow:
            left = stored(rows.select("key").distinct(), "left")
            narrower = narrow(left)
            placed = stored(narrower.join(nodes, "key"), "narrow")
            discard(rows, left, narrower)
            rows = stored(_open_rows(placed), "open")
            discard(placed)
        pairs = _pairs_across(rows, fits) if turn == rounds else _leader_pairs(rows, turn, fits)
        pairs = stored(pairs, "pairs")
        links = stored(verify(pairs), "links")
        before, nodes = nodes, _merged(nodes, links)
        discard(before, links, pairs)
    discard(rows)
    return nodes.select("key", "label")


def fits(pct: int) -> Fits:
    """Sizes and places that allow a similarity of pct: what follows a shared element, and no more, can be shared too."""

    def of(na: Column, pa: Column, nb: Column, pb: Column) -> Column:
        return (100 + pct) * F.least(na - pa, nb - pb) >= pct * (na + nb)

    return of


def class_sets(docs: DataFrame, needed: DataFrame, text: str, k: int) -> DataFrame:
    """(key, shingles) of classes `needed` (key, text_hash): each set read from one text with that hash.

    Copies of a text and most texts that are not needed are dropped before they move, and a set is made where its text arrives.
    `needed` is a stored table.
    """

    def run(iterator):
        for batch, texts in batches(iterator, BATCH_BYTES):
            rows = []
            for s, wanted in zip(shingle_sets(texts, k), batch.column(0).to_pylist(), strict=True):
                if set_key(s) == wanted:
                    rows.append((wanted, s.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())],
                names=["key", "shingles"],
            )

    hashed = docs.select(F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    hashed = narrowed(hashed, [F.col("text_hash")], bitmap(needed.select("text_hash")))
    texts = hashed.groupBy("text_hash").agg(F.first("text").alias("text"))
    return texts.join(needed, "text_hash").select("key", "text").mapInArrow(run, "key binary, shingles binary")


def share(a: np.ndarray, b: np.ndarray, pct: int) -> bool:
    """Whether two sets of distinct values reach the similarity."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= pct * (len(a) + len(b) - both)


def with_components(found: DataFrame, labels: DataFrame) -> DataFrame:
    """found (doc_id, text_hash, n_shingles, key) with component_id: the least id that is not null among all linked rows."""
    classes = found.filter("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    classes = classes.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    named = classes.groupBy("label").agg(F.min("least").alias("component_id"), F.sum("copies").alias("members")).filter("members > 1")
    groups = stored(classes.join(named, "label").select("key", "component_id"), "groups")
    rows = found.select("doc_id", "text_hash", "n_shingles", "key").join(groups, "key", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("component_id", "doc_id"))
    return rows.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"))
