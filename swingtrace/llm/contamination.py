"""Benchmark decontamination by Wu-Manber search.

Texts and benchmark items are normalized to lower-case words between single spaces; every window of
13 item words (or the whole of a shorter item) is a pattern with a space at both ends, so that a match is
a run of whole words. Patterns of similar least length form one searcher: a shift table over hashed byte
blocks skips positions that no pattern can end at, a hash of the block at the end of the considered
prefix selects the few patterns left, and direct comparison of bytes confirms them. The positions of a
batch of texts move together as numpy arrays: each lane is a stretch of the batch, so the number of
steps is the length of a stretch over the mean shift.

The benchmark is sent to the executors in blocks of at most `block` patterns, one pass over the
documents for each block, so what is broadcast has a fixed bound whatever the benchmark's size; hits of
the blocks are united per document.

Defined results: null texts and texts without words have no words and are not contaminated; items
without words never occur; repeated items with one id count once; repeated document rows are judged
row by row; a null item id counts as an item named by the empty string; an empty benchmark leaves
all counts zero; other columns play no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swingtrace.llm.common import table
from swingtrace.llm.hashing import GOLDEN, batches, mix

WINDOW = 13
BLOCK_PATTERNS = 200_000
BATCH_BYTES = 4 << 20
LANE = 4096
NON_WORD = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
#: Bytes outside words become spaces, A-Z become a-z.
NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def normalized(raw: bytes) -> list[bytes]:
    return raw.translate(NORMAL).split()


class Searcher:
    """Wu-Manber over patterns of at least m bytes, with blocks of `width` bytes."""

    def __init__(self, patterns: list[bytes], m: int, width: int):
        self.m, self.width = m, width
        self.bits = min(22, max(10, int(np.ceil(np.log2(max(2, len(patterns) * (m - width + 1))))) + 3))
        buf = np.frombuffer(b"".join(p[:m] for p in patterns), np.uint8).reshape(len(patterns), m)
        self.shift = np.full(1 << self.bits, m - width + 1, np.int32)
        for end in range(width, m + 1):  # the last block may end here
            blocks = self._hash([buf[:, end - width + j] for j in range(width)])
            np.minimum.at(self.shift, blocks, m - end)
        last = self._hash([buf[:, m - width + j] for j in range(width)])
        first = mix(self._full([buf[:, j] for j in range(m)]))
        order = np.lexsort((first, last))
        self.patterns = [patterns[i] for i in order]
        self.ids = order
        self.first = first[order]
        self.last = last[order]
        self.bucket_from = np.searchsorted(self.last, np.arange((1 << self.bits) + 1))

    @staticmethod
    def _full(columns: list[np.ndarray]) -> np.ndarray:
        h = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            h = (h ^ c) * GOLDEN
        return h

    def _hash(self, columns: list[np.ndarray]) -> np.ndarray:
        return (self._full(columns) >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, buf: np.ndarray, raw: bytes) -> list[tuple[int, int]]:
        """(start, pattern) of every occurrence in buf."""
        m, out, n = self.m, [], len(buf)
        if n < m:
            return out
        starts = np.arange(0, n - m + 1, LANE)
        at, stop = starts + m, np.minimum(starts + LANE, n - m + 1) + m  # `at` is the end of the considered window
        while len(at):
            h = self._hash([buf[at - self.width + j] for j in range(self.width)])
            s = self.shift[h]
            hit = np.flatnonzero(s == 0)
            if len(hit):
                self._confirm(buf, raw, at[hit] - m, h[hit], out)
            at = at + np.maximum(s, 1)
            going = at < stop
            at, stop = at[going], stop[going]
        return out

    def _confirm(self, buf: np.ndarray, raw: bytes, starts: np.ndarray, h: np.ndarray, out: list) -> None:
        prefix = mix(self._full([buf[starts + j] for j in range(self.m)]))
        for start, block, own in zip(starts.tolist(), h.tolist(), prefix, strict=True):
            a, b = self.bucket_from[block], self.bucket_from[block + 1]
            lo = a + np.searchsorted(self.first[a:b], own, side="left")
            while lo < b and self.first[lo] == own:
                p = self.patterns[lo]
                if raw.startswith(p, start):
                    out.append((start, int(self.ids[lo])))
                lo += 1


class Patterns:
    """The distinct windows of some items, with the items that have each."""

    def __init__(self, windows: dict[bytes, set[str]]):
        self.listed = sorted(windows)
        self.words = [p.count(b" ") - 1 for p in self.listed]
        self.items = [sorted(windows[p]) for p in self.listed]
        groups: dict[int, list[int]] = {}
        for i, p in enumerate(self.listed):
            least = next(x for x in (48, 32, 24, 16, 10, 6, 3) if len(p) >= x)
            groups.setdefault(least, []).append(i)
        self.searchers = []
        for least, members in groups.items():
            m = min(len(self.listed[i]) for i in members)
            self.searchers.append((Searcher([self.listed[i] for i in members], m, min(8, max(2, m // 3))), members))

    def occurrences(self, raw: bytes):
        buf = np.frombuffer(raw, np.uint8)
        for searcher, members in self.searchers:
            for start, i in searcher.search(buf, raw):
                yield start, members[i]


def windows_of(item: bytes, size: int = WINDOW) -> list[bytes]:
    ws = normalized(item)
    if not ws:
        return []
    return [b" " + b" ".join(ws[i : i + size]) + b" " for i in range(max(1, len(ws) - size + 1))]


def _blocks(benchmark: DataFrame, text: str, item_id: str, block: int):
    """Pattern blocks, read from the benchmark item by item: the driver holds one block at a time."""
    windows: dict[bytes, set[str]] = {}
    rows = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.col(text).alias("t"))
    for r in rows.toLocalIterator():
        if r.t is None:
            continue
        for w in windows_of(r.t.encode("utf-8", "surrogatepass")):
            windows.setdefault(w, set()).add(r.i)
            if len(windows) >= block:
                yield Patterns(windows)
                windows = {}
    if windows:
        yield Patterns(windows)


def scanned(texts: list[bytes], patterns: Patterns) -> list[tuple[int, list[int], set[str]]]:
    """Per text: its words, the positions of hit words, the items found."""
    split = [normalized(t) for t in texts]
    joined = [b" " + b" ".join(ws) + b" " if ws else b"" for ws in split]
    starts = np.cumsum([0, *(len(j) + 1 for j in joined)])
    raw = b"\n".join([*joined, b""])
    found: dict[int, list[tuple[int, int]]] = {}
    for start, p in patterns.occurrences(raw):
        found.setdefault(int(np.searchsorted(starts, start, side="right")) - 1, []).append((start, p))
    out = []
    for i, ws in enumerate(split):
        hits, items = [], set()
        if i in found:
            spaces = np.flatnonzero(np.frombuffer(joined[i], np.uint8) == 32)
            covered = np.zeros(len(ws) + 1, np.int64)
            for start, p in found[i]:
                first = int(np.searchsorted(spaces, start - starts[i]))
                covered[first] += 1
                covered[first + patterns.words[p]] -= 1
                items.update(patterns.items[p])
            hits = np.flatnonzero(np.cumsum(covered[:-1]) > 0).tolist()
        out.append((len(ws), hits, items))
    return out


def find(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", doc_id: str = "doc_id",
    item_text: str = "text", item_id: str = "item_id", block: int = BLOCK_PATTERNS,
) -> DataFrame:
    """Per row of docs: doc_id, n_words, hits (positions of hit words), items (ids found, as strings, sorted)."""
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, hits array<int>, items array<string>"
    packed = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def scan(sent, rows):
        def run(iterator):
            for batch, texts in batches(iterator, BATCH_BYTES):
                done = scanned(texts, sent.value)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([n for n, _, _ in done], pa.int64()),
                        pa.array([h for _, h, _ in done], pa.list_(pa.int32())),
                        pa.array([sorted(x) for _, _, x in done], pa.list_(pa.string())),
                    ],
                    names=["doc_id", "n_words", "hits", "items"],
                )

        return rows.mapInArrow(run, schema)

    blocks = list(map(spark.sparkContext.broadcast, _blocks(benchmark, item_text, item_id, block)))
    if not blocks:
        blocks = [spark.sparkContext.broadcast(Patterns({}))]
    if len(blocks) == 1:
        return scan(blocks[0], packed)
    from swingtrace.llm.common import stored

    rows = stored(packed.withColumn("row", F.struct(F.monotonically_increasing_id().alias("n"), "doc_id")), "scanned-rows")
    rows = rows.select(F.col("row").alias("doc_id"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, hits array<int>, items array<string>"
    parts = scan(blocks[0], rows)
    for b in blocks[1:]:
        parts = parts.unionAll(scan(b, rows))
    joined = parts.groupBy("doc_id").agg(
        F.max("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits"), F.flatten(F.collect_list("items")).alias("items")
    )
    return joined.select(
        "doc_id.doc_id", "n_words", F.array_sort(F.array_distinct("hits")).alias("hits"), F.array_sort(F.array_distinct("items")).alias("items")
    )


def judged(found: DataFrame, share: int = 20) -> DataFrame:
    """find()'s rows with n_hit, n_items, items_sha256 and contaminated (one word in `share` or more is hit)."""
    n_hit = F.size("hits").cast("long")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", doc_id: str = "doc_id", share: int = 20) -> DataFrame:
    """docs without contaminated rows (rows that share a contaminated row's id are judged by their own text)."""
    own = [F.col(f"`{c}`") for c in docs.columns]
    row = docs.select(F.struct(F.struct(*own).alias("row")).alias("doc_id"), F.col(text).alias("text"))
    found = find(row, benchmark)
    n_hit = F.size("hits")
    bad = (n_hit > 0) & (share * n_hit >= F.col("n_words"))
    return found.filter(~bad).select("doc_id.row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def sql(source: str = "documents", size: int = WINDOW, share: int = 20) -> str:
    """DuckDB SQL of the query: windows of both sides joined as strings."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({lower}, '[^{NON_WORD}]+') AS ws FROM {source}),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all({lower}, '[^{NON_WORD}]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(ws), {size}) AS n, array_to_string(list_slice(ws, i, i + least(len(ws), {size}) - 1), ' ') AS x
  FROM b, LATERAL (SELECT unnest(range(1, greatest(2, len(ws) - {size - 2}))) AS i) WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS x FROM d, sizes,
  LATERAL (SELECT unnest(range(1, len(ws) - n + 2)) AS i) WHERE len(ws) >= n),
o AS (SELECT DISTINCT doc_id, i, dw.n, item FROM dw JOIN bw ON bw.n = dw.n AND bw.x = dw.x),
h AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM o, LATERAL (SELECT unnest(range(0, o.n)) AS k) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM o) GROUP BY 1)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND {share} * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""
