"""Similarity join, periodic runs, vector codes; and what stands for the queries that have no SQL."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from swingtrace.llm import nearcopies, periodic, prefixjoin, vectorcodes
from swingtrace.llm.queries import ORACLE, QUERIES

from .conftest import same
from .test_documents import components_by_hand, empty

#: The test that stands for each query without SQL.
WITHOUT_SQL = {
    "op1_page_text": "test_pages", "op2_repeats": "test_documents", "op3_private": "test_documents", "op6_archives": "test_pages",
    "op7_cross_entropy": "test_documents", "op10_secrets": "test_documents", "op12_periodic_runs": "test_links_runs_codes",
}


def test_every_query_has_sql_or_a_test():
    assert set(QUERIES) - set(ORACLE) == set(WITHOUT_SQL)


# similarity join -----------------------------------------------------------------------------------


def test_similar_matches_sql(spark, sf, duck):
    same(prefixjoin.query(spark, sf), duck.execute(prefixjoin.sql()).df(), ["doc_id"])


def test_similar_odd_rows(odd):
    rows = odd.select("doc_id", "text").collect()
    want = sorted(map(tuple, components_by_hand([tuple(r) for r in rows], 90, 3)), key=str)
    got = prefixjoin.similar(odd).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert prefixjoin.similar(empty(odd)).count() == 0


def variants(n, length, seed, most=8):
    """Texts derived from a few others by changed words, so that similarities lie on both sides of the thresholds."""
    g = np.random.default_rng(seed)
    bases = [[f"b{k}w{i}" for i in range(length)] for k in range(3)]
    out = []
    for i in range(n):
        words = list(bases[i % 3])
        for at in g.integers(0, length, int(g.integers(0, most))):
            words[at] = f"x{g.integers(0, 40)}"
        out.append((i, " ".join(words)))
    return out


@pytest.mark.parametrize("length", [5, 9, 60])
@pytest.mark.parametrize("cells", [None, 1 << 14])
def test_similar_groups_by_hand(spark, length, cells):
    """With 2^14 cells most tokens share theirs: orders change, results do not."""
    rows = variants(150, length, length)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    sizes = {} if cells is None else {"counters": cells, "words": cells}
    got = sorted(map(tuple, prefixjoin.similar(d, **sizes).select("doc_id", "n_shingles", "component_id").collect()))
    assert got == sorted(components_by_hand(rows, 90, 3))


def test_near_copies_of_small_sets_and_outliers_by_hand(spark):
    rows = variants(120, 9, 1, 3) + [(i + 1000, t.replace("b", "c")) for i, t in variants(120, 60, 2, 6)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for rounds in (1, 3):
        got = nearcopies.near_copies(d, rounds=rounds).select("doc_id", "n_shingles", "component_id")
        assert sorted(map(tuple, got.collect())) == sorted(components_by_hand(rows))


def test_rows_without_an_id_do_not_meet_each_other(spark):
    d = spark.range(400).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "concat_ws(' ', transform(sequence(0, 30), i -> concat('w', id, 'x', i))) AS text")
    got = nearcopies.near_copies(d)
    assert got.count() == 400 and got.filter("component_id IS NOT NULL").count() == 0
    assert nearcopies.deduplicate(d).count() == 400


def test_prefixes_hold_a_shared_token_under_every_order():
    g = np.random.default_rng(2)
    for _ in range(300):
        n = int(g.integers(2, 80))
        a = g.integers(0, 2**60, n).astype(np.uint64)
        b = np.concatenate([a[: n - n // 15], g.integers(0, 2**60, n // 15).astype(np.uint64)])
        level = lambda s: (s % np.uint64(3000)).astype(np.uint16)
        similar = 100 * len(np.intersect1d(a, b)) >= 90 * len(np.union1d(a, b))
        for x, y in zip(prefixjoin.orders(a, level(a)), prefixjoin.orders(b, level(b)), strict=True):
            p, q = (s[np.argsort(o)][: prefixjoin.prefix_length(len(s), 90)] for s, o in ((a, x), (b, y)))
            assert not similar or prefixjoin.passes(p, q, len(a), len(b), 90)


def test_longer_prefixes_rule_out_no_similar_pair():
    """Sets of one group with 0 to 12 other tokens each: every pair that is similar passes, whatever the prefixes' length."""
    g = np.random.default_rng(6)
    left = 0
    for _ in range(600):
        n, d = int(g.integers(2, 120)), g.integers(0, 12, 2)
        base = g.integers(0, 2**32, n).astype(np.uint64)
        a, b = (np.unique(np.concatenate([base[g.permutation(n)[: max(1, n - x)]], g.integers(0, 2**32, int(x)).astype(np.uint64)])) for x in d)
        similar = 100 * len(np.intersect1d(a, b)) >= 90 * len(np.union1d(a, b))
        for most in (1, 16, prefixjoin.LONG, 200):
            p, q = (s[: max(prefixjoin.prefix_length(len(s), 90), most)].astype(np.uint32) for s in (a, b))
            passed = prefixjoin.passes(p, q, len(a), len(b), 90)
            assert passed or not similar
            left += most == 200 and passed != similar
    assert left == 0  # whole sets decide


def test_pairs_with_too_few_shared_prefix_tokens_are_ruled_out():
    """The first token is shared, and then no more of the prefixes: no set of 100 can have 95 in common with the other."""
    a, b = np.arange(1, 12, dtype=np.uint32), np.arange(101, 112, dtype=np.uint32)
    assert not prefixjoin.passes(a, b, 100, 100, 90)
    b[0] = a[0]
    assert not prefixjoin.passes(a, b, 100, 100, 90)
    b[:5] = a[:5]
    assert not prefixjoin.passes(a, b, 100, 100, 90)
    b[5] = a[5]  # 6 and the 89 that follow
    assert prefixjoin.passes(a, b, 100, 100, 90)


def test_full_sets_are_read_only_of_pairs_that_pass_every_order(spark, monkeypatch):
    """Pairs of texts that share a few words in a row meet in a bucket, but no set of theirs is read; near copies are."""
    rows, g = [], np.random.default_rng(4)
    for i in range(200):
        rare = [f"c{i // 2}x{j}" for j in range(5)]
        rows.append((i, " ".join(rare + [f"w{j}" for j in g.integers(0, 12, 100)])))
    rows += [(1000 + i, t + " more") for i, t in rows[:20]]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    read, buckets, was, met = [], [], prefixjoin.class_sets, prefixjoin.shared_buckets

    def class_sets(docs, needed, *options):
        read.append({bytes(r.key) for r in needed.select("key").collect()})
        return was(docs, needed, *options)

    def shared_buckets(*options):
        mates = met(*options)
        buckets.append(mates.select("key").distinct().count())
        return mates

    monkeypatch.setattr(prefixjoin, "class_sets", class_sets)
    monkeypatch.setattr(prefixjoin, "shared_buckets", shared_buckets)
    got = sorted(map(tuple, prefixjoin.similar(d).select("doc_id", "n_shingles", "component_id").collect()))
    assert got == sorted(components_by_hand(rows, 90, 3))
    assert buckets[0] > 150 and len(set().union(*read)) <= 60


def test_stored_tables_of_a_round_do_not_stay(spark, monkeypatch):
    """After the rounds no set and no prefix is left on the disk, and counts not after the orders are made of them."""
    live, was, gone = {}, prefixjoin.stored, prefixjoin.discard

    def stored(df, name):
        out = was(df, name)
        live[out.stored_at] = name
        if name == "prefixes":
            assert "counted" not in live.values()
        return out

    def discard(*tables):
        for df in tables:
            live.pop(getattr(df, "stored_at", None), None)
        gone(*tables)

    monkeypatch.setattr(prefixjoin, "stored", stored)
    monkeypatch.setattr(prefixjoin, "discard", discard)
    rows = variants(90, 60, 3)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = prefixjoin.similar(d).select("doc_id", "n_shingles", "component_id")
    assert set(live.values()) == {"found"}
    assert sorted(map(tuple, got.collect())) == sorted(components_by_hand(rows, 90, 3))


# periodic runs -------------------------------------------------------------------------------------


def runs_by_hand(w):
    out = set()
    for q in range(1, len(w) // 2 + 1):
        i = q
        while i < len(w):
            s = i
            while i < len(w) and w[i] == w[i - q]:
                i += 1
            part = w[s - q : i]
            if len(part) >= max(12, 2 * q) and not any(all(part[x] == part[x - d] for x in range(d, len(part))) for d in range(1, q)):
                out.add((s - q, len(part), q))
            i = max(i, s + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("block", [1, 7, 1 << 20])
def test_runs_by_hand(block):
    g = np.random.default_rng(5)
    for k in range(400):
        n = int(g.integers(0, 90))
        w = g.integers(0, int(g.integers(1, 4)), n)
        if k % 3 == 0:
            w = np.tile(g.integers(0, 3, int(g.integers(1, 12))), 9)[: n + 1]
            w[int(g.integers(0, len(w)))] = 7
        if k % 3 == 1:
            w = np.concatenate([np.tile(g.integers(0, 2, int(g.integers(1, 7))), int(g.integers(1, 9))) for _ in range(4)] * int(g.integers(1, 3)))
        assert periodic.runs(np.asarray(w, np.int64), block) == runs_by_hand(w.tolist()), w


def test_one_word_a_million_times_and_a_long_period():
    assert periodic.runs(np.zeros(1_000_000, np.int64)) == [(0, 1_000_000, 1)]
    assert periodic.runs(np.tile(np.arange(30_000), 7)) == [(0, 210_000, 30_000)]


def test_periodic_query_by_hand(spark, sf):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in periodic.query(spark, sf).collect()}
    assert set(got) == set(docs)
    for doc_id, text in docs.items():
        words = text.encode().split()
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        if n > 700:
            continue  # the walk by hand takes a second a text from there on
        found = runs_by_hand(words)
        drop = {i for s, m, q in found for i in range(s + q, s + m)}
        best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
        r = got[doc_id]
        assert (r.n_runs, r.start, r.length, r.period) == (len(found), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if found else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in drop)).hexdigest()


def test_periodic_odd_rows(odd):
    got = {(r.doc_id, r.n_runs, r.start, r.length, r.period) for r in periodic.periodic_runs(odd).collect()}
    assert (7, 1, 0, 30000, 1) in got and (3, 0, None, None, None) in got and (None, 0, None, None, None) in got
    assert periodic.periodic_runs(odd, tails=True).count() == odd.count() and periodic.periodic_runs(empty(odd), tails=True).count() == 0
    left = periodic.collapsed_texts(odd)
    assert left.columns == odd.columns and left.filter("doc_id = 7").first().text == "aéb" and left.filter("doc_id = 3").first().text is None


# vector codes --------------------------------------------------------------------------------------


def codes_by_sql(rows, kind="FLOAT"):
    con = duckdb.connect()
    con.execute(f"CREATE TABLE embeddings (vec_id BIGINT, embedding {kind}[], label INTEGER)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", rows)
    return sorted(con.execute(vectorcodes.sql()).fetchall())


def test_codes_match_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    same(vectorcodes.query(spark, sf), con.execute(vectorcodes.sql()).df(), ["vec_id"])


def test_codes_of_odd_vectors(spark, tmp_path):
    g = np.random.default_rng(4)
    rows = [(int(i), [float(np.float32(x)) for x in v], int(i % 3) if i % 4 else None) for i, v in enumerate(g.normal(0, 1, (300, 16)))]
    rows += [(1000 + i, [0.5] * 16, 1) for i in range(200)] + [(2000 + i, [float(x) for x in np.round(g.normal(0, 1, 16))], 2) for i in range(60)]
    want = codes_by_sql(rows)
    bad = [(5000, None, 1), (5001, [None] * 16, 1), (5002, [float("nan")] * 16, 1), (5003, [float("inf")] + [0.0] * 15, 1), (5004, [1.0] * 8, 1), (5005, [], 1)]
    d = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<double>, label int").repartition(3)
    for block in (7, 64, 4096):
        coded, books = vectorcodes.compress(d, block=block)
        got = sorted((r.vec_id, r.code, r.error) for r in coded.collect())
        assert got == [(w[0], w[1], w[2]) for w in want] and vectorcodes.told(books) == want[0][4]
    nothing = vectorcodes.compress(d.filter("false"))
    assert nothing[0].count() == 0 and nothing[1] == []
    few = vectorcodes.compress(d.filter("vec_id < 3").withColumn("code", F.lit(1)).withColumn("error", F.lit(1)))
    assert few[0].count() == 3 and len(few[1][0]) == 3 and few[0].agg(F.sum("error")).first()[0] == 0
    with pytest.raises(ValueError):
        vectorcodes.compress(d.filter("vec_id < 3"), parts=5)


def test_cover_trees_hold_every_point_once():
    points = np.random.default_rng(1).integers(-50, 50, (700, 4))
    tree = vectorcodes.cover_tree(points)
    order, centres, radii, sums, starts, ends, first, kids = tree
    assert sorted(order) == list(range(700)) and (sums[0] == points.sum(axis=0)).all()
    for k in range(len(radii)):
        own = points[order[starts[k] : ends[k]]]
        assert np.sqrt(((own - centres[k]) ** 2).sum(axis=1)).max() <= radii[k] + 1e-9 and (own.sum(axis=0) == sums[k]).all()
        if kids[k]:
            below = slice(first[k], first[k] + kids[k])
            assert starts[below][0] == starts[k] and ends[below][-1] == ends[k] and (starts[below][1:] == ends[below][:-1]).all()
