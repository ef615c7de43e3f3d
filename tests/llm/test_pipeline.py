import os
import random
import re

import corpus_pipeline
from swingtrace.llm import contamination, linking, mixing, nearcopies, private, quality
from swingtrace.llm.common import bitmap, narrowed, stored
from swingtrace.sources.store import shared_dir

from .test_documents import base_private


def masked_by_hand(text):
    out, at = [], 0
    for kind, start, stop in sorted(base_private(text), key=lambda s: (s[1], s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, stop)
    return "".join([*out, text[at:]])


def test_pipeline_stage_by_stage(spark, sf, duck):
    """Each stage against its SQL or a walk by hand, on what the stage before kept."""
    d = duck.execute("SELECT * FROM documents").df()
    con = duck.cursor()

    def step(sql, keep):
        con.register("d", d)
        return con.execute(f"SELECT d.* FROM d JOIN ({sql}) v USING (doc_id) WHERE {keep}").df()

    d = step(quality.sql(source="d"), "v.kept")
    d = step(nearcopies.sql(source="d"), "v.kept")
    d = step(contamination.sql(source="d"), "NOT v.contaminated")
    wider = re.compile(r"[\[({]at[\])}]|[0-9]{3}-[0-9]{2}-[0-9]{4}")
    assert not any(wider.search(t) for t in d.text)  # the walk by hand knows base kinds only
    d["text"] = [masked_by_hand(t) for t in d.text]
    d["n_chars"] = [len(t) for t in d.text]
    con.register("d", d)
    expected = con.execute(f"SELECT d.*, v.domain, v.n_tokens, v.copies FROM d JOIN ({mixing.sql(source='d')}) v USING (doc_id) ORDER BY doc_id").df()
    got = corpus_pipeline.run(spark, sf).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert list(got.columns) == list(expected.columns) and len(got) == len(expected)
    for c in got.columns:
        assert (got[c] == expected[c]).all(), c


def test_stages_keep_columns_and_take_odd_rows(spark, sf, odd):
    docs = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == odd.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() <= docs.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.filter("false"), sf).count() == 0


def shared_bytes(spark):
    top = shared_dir(spark).removeprefix("file:")
    return sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(top) for f in names if f.endswith(".parquet"))


def random_texts(n, n_words=150):
    rng = random.Random(5)
    return [" ".join(f"{rng.getrandbits(40):x}" for _ in range(n_words)) for _ in range(n)]


def test_stages_leave_no_copy_of_the_texts(spark, tmp_path):
    texts = random_texts(600)
    mine = " ".join(["mail a.b@example.com or call +49 170 1234567"] * 3)
    rows = [(i, f"{t} {mine}", "en", "src1", len(t)) for i, t in enumerate(texts)]
    docs = stored(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int"), "given")
    for stage, most in ((quality.keep, 300 * len(rows)), (private.mask, 0), (nearcopies.deduplicate, 150 * len(rows))):
        before = shared_bytes(spark)
        stage(docs).write.parquet(str(tmp_path / stage.__module__))
        assert shared_bytes(spark) - before <= most, stage


def test_run_deletes_what_a_later_stage_has_read(spark, sf):
    before = shared_bytes(spark)
    out = corpus_pipeline.run(spark, sf)
    given = os.path.getsize(f"{sf}/documents.parquet")
    assert out.count() > 0 and shared_bytes(spark) - before < 2 * given


def test_bitmap_loses_no_key(spark):
    keys = stored(spark.range(0, 300_000, 3).selectExpr("if(id = 0, null, id) AS k", "cast(id AS string) AS s"), "keys")
    rows = spark.range(-50, 300_000).selectExpr("if(id = 0, null, id) AS k", "cast(id AS string) AS s")
    by = [rows["k"], rows["s"]]
    near, rest = narrowed(rows, by, bitmap(keys)), narrowed(rows, by, bitmap(keys), out=True)
    of = {r.s for r in near.collect()}
    assert {r.s for r in keys.collect()} <= of and len(of) < 120_000
    assert sorted([*of, *(r.s for r in rest.collect())]) == sorted(r.s for r in rows.collect())
    none = stored(keys.filter("false"), "none")
    assert narrowed(rows, by, bitmap(none)).isEmpty()


def test_rarest_places_count_lone_shingles(spark):
    rng = random.Random(3)
    sets = {bytes([k]): rng.sample(range(60), rng.randint(1, 20)) + list(range(1000 * (k + 1), 1000 * (k + 1) + rng.randint(0, 6))) for k in range(40)}
    often = {}
    for s in sets.values():
        for x in s:
            often[x] = often.get(x, 0) + 1
    expected = set()
    for key, s in sets.items():
        length = len(s) - -(-len(s) * 75 // 100) + 1
        expected |= {(key, len(s), pos, n) for pos, (n, _) in enumerate(sorted((often[x], x) for x in s)[:length]) if n > 1}
    rows = spark.createDataFrame([(k, len(s), x) for k, s in sets.items() for x in s], "key binary, n long, shingle long")
    got = linking.rarest(rows, 75)
    size = {r.bucket: r["count"] for r in got.groupBy("bucket").count().collect()}
    assert {(bytes(r.key), r.n, r.pos) for r in got.collect()} == {e[:3] for e in expected} and max(size.values()) <= max(often.values())
