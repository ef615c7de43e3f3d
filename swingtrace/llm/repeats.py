"""Removal of repeated passages: every byte under a 200-byte string that starts anywhere else too.

Which suffixes have to meet is decided by seeds: of the 169 hashes of 32 bytes inside a 200-byte window
the least names the window, so equal windows have the same seed. Neighbouring windows with one seed
form a stretch of text (85 windows on average), and only stretches whose seed occurs twice or more go on.

1. Stretches with equal bytes are one class; all windows of a class with two or more members repeat.
2. The distinct stretches of a seed are laid out in shards of bounded size. Each shard builds a suffix array
   (Larsson-Sadakane refinement) with common prefixes (Kasai); windows sharing 200 bytes with a neighbour
   repeat.
3. A seed with more distinct stretches than `split` is spread over several shards. Their distinct windows are
   merged by ranges of window hash: each shard's sorted run is looked up in the others by binary search.
4. Repeated windows go back to their documents, where runs of covered bytes are cut out.

No step gathers a seed, a class or a document group in one task; hot seeds are split in 3, hot classes are
joined with skew splitting. Texts and seeds of equal 64-bit hashes count as equal (a seed and its bytes: 128 bits).

Defined results: a null or empty text has no bytes and nothing removed; repeated rows are copies of each
other like any two documents; null ids stand for themselves; empty tables give empty results; other
columns play no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swingtrace.llm.common import stored, table
from swingtrace.llm.hashing import GOLDEN, batches, mix
from swingtrace.llm.suffixes import common_prefixes, suffix_array

LENGTH = 200
SEED = 32
BATCH_BYTES = 1 << 19
SHARD_BYTES = 1 << 20
SPLIT = 4000
VALUES = mix((np.arange(256, dtype=np.uint64) + np.uint64(7)) * GOLDEN)
FACTORS = [np.uint64(int(mix(np.array([j], np.uint64))[0]) | 1) for j in range(11, 17)]
BASE = 0x5851F42D4C957F2D
INVERSE = pow(BASE, -1, 2**64)
PLACE_BITS = 20
LOW = np.uint64((1 << PLACE_BITS) - 1)


def _powers(x: int, n: int) -> np.ndarray:
    out = np.full(max(1, n), np.uint64(x), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def substring_hashes(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of many substrings from one running polynomial."""
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(VALUES[buf] * _powers(BASE, len(buf)), out=sums[1:])
    inverse = _powers(INVERSE, len(buf) + 1)
    return mix((sums[starts + lengths] - sums[starts]) * inverse[starts] + lengths.astype(np.uint64) * GOLDEN)


def stretches(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(text number, first window, windows, seed, hash) of every stretch of windows with one seed."""
    owners = [i for i, t in enumerate(texts) if len(t) >= length]
    none = np.zeros(0, np.int64)
    if not owners:
        return none, none, none, none, none
    buf = np.frombuffer(b"".join(texts[i] for i in owners), np.uint8)
    sizes = np.array([len(texts[i]) for i in owners])
    begins = np.cumsum(sizes) - sizes
    within = np.arange(len(buf)) - np.repeat(begins, sizes)
    h = VALUES[buf]
    for j in range(5):  # hashes of 2, 4, 8, 16 and 32 bytes
        step = 1 << j
        h = h[:-step] * FACTORS[j] + h[step:]
    full = mix(h)
    h = (full & ~LOW) | (within[: len(full)].astype(np.uint64) & LOW)  # of equal seeds the first in the text
    span = length - SEED + 1
    least, width = h, 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: len(h) - span + 1], least[span - width :][: len(h) - span + 1])
    valid = np.flatnonzero(within[: len(least)] + length <= np.repeat(sizes, sizes)[: len(least)])
    m = least[valid]
    new = np.ones(len(valid), bool)
    new[1:] = (m[1:] != m[:-1]) | (np.diff(valid) != 1)
    start = within[valid]
    new |= start >> PLACE_BITS != (start + span - 1) >> PLACE_BITS  # places start anew here: every window for itself
    first = valid[new]
    count = np.diff(np.append(np.flatnonzero(new), len(valid)))
    number = np.searchsorted(begins, first, side="right") - 1
    place = first + (((m[new] & LOW).astype(np.int64) - start[new]) & int(LOW))
    seed = full[place].view(np.int64)
    own = substring_hashes(buf, first, count + length - 1).view(np.int64)
    return np.array(owners)[number], first - begins[number], count, seed, own


def row_key(doc_id, raw: bytes) -> int:
    head = b"-" if doc_id is None else str(doc_id).encode()
    return int.from_bytes(hashlib.blake2b(head + b"\0" + raw, digest_size=8).digest(), "little", signed=True)


def _keyed(batch, texts: list[bytes]) -> list[int]:
    return [row_key(d, t) for d, t in zip(batch.column(0).to_pylist(), texts, strict=True)]


def found_stretches(docs: DataFrame, length: int) -> DataFrame:
    def run(iterator):
        for batch, texts in batches(iterator, BATCH_BYTES):
            keys = np.array(_keyed(batch, texts), np.int64)
            number, first, count, seed, own = stretches(texts, length)
            yield pa.RecordBatch.from_arrays(
                [pa.array(seed), pa.array(own), pa.array(keys[number]), pa.array(first, pa.int32()), pa.array(count, pa.int32())],
                names=["seed", "own", "key", "first", "windows"],
            )

    return docs.mapInArrow(run, "seed long, own long, key long, first int, windows int")


def packed_texts(docs: DataFrame) -> DataFrame:
    """(key, doc_id, packed): texts compressed before they are shuffled."""

    def run(iterator):
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch, texts in batches(iterator, 4 * BATCH_BYTES):
            yield pa.RecordBatch.from_arrays(
                [pa.array(_keyed(batch, texts), pa.int64()), batch.column(0), pa.array([squeeze.compress(t) for t in texts], pa.binary())],
                names=["key", "doc_id", "packed"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"key long, doc_id {kind}, packed binary")


def _unpack(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed)


def shard_windows(lengths: np.ndarray, copies: np.ndarray, text: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of stretches laid end to end: (stretch and offset of every window as a text place, its class, whether it repeats here)."""
    buf = np.frombuffer(text, np.uint8)
    order, ranks = suffix_array(buf, length + 56)
    shared = common_prefixes(buf, order, ranks, length)
    begins = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(lengths)), lengths)
    valid = np.arange(len(buf)) - begins[owner] <= lengths[owner] - length
    klass = np.cumsum(shared < length)
    keep = valid[order]
    places, klass = order[keep], klass[keep]
    weight = np.bincount(klass, copies[owner[places]])
    return places, klass, weight[klass] > 1


def _runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of consecutive numbers in a sorted array: first and one past last."""
    if not len(starts):
        return starts, starts
    cut = np.flatnonzero(np.diff(starts) != 1)
    return starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)] + 1


def _arrays(kinds: list[tuple[str, object]], columns: list) -> pa.Table:
    return pa.table({name: pa.array(c, kind) for (name, kind), c in zip(kinds, columns, strict=True)})


OUT = [("key", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("seed", pa.int64()), ("print", pa.int64()), ("shard", pa.int64())]


def _shard(length: int):
    """Repeated windows of a shard as ranges, and, of split seeds, one window of each class as a print."""

    def run(group: pa.Table) -> pa.Table:
        g = group.sort_by([("seed", "ascending"), ("own", "ascending")])
        col = {n: g.column(n).to_numpy() for n in ("key", "first", "copies", "seed", "shard", "parts")}
        texts = g.column("text").to_pylist()
        lengths = np.array([len(t) for t in texts])
        raw = b"".join(texts)
        places, klass, again = shard_windows(lengths, col["copies"], raw, length)
        begins = np.cumsum(lengths) - lengths
        owner = np.searchsorted(begins, places, side="right") - 1
        alone = col["copies"][owner] == 1  # windows of other stretches are known to repeat
        hit = np.sort(places[again & alone])
        a, b = _runs(hit)
        # a run of text places may cross from one stretch into the next
        parts = [(s, e) for x, y in zip(a.tolist(), b.tolist(), strict=True) for s, e in _within(begins, x, y)]
        who = np.searchsorted(begins, np.array([p[0] for p in parts], np.int64), side="right") - 1
        start = np.array([p[0] for p in parts], np.int64) - begins[who] + col["first"][who]
        stop = np.array([p[1] for p in parts], np.int64) - begins[who] + col["first"][who]
        zero = np.zeros(len(parts), np.int64)
        rows = [col["key"][who], start, stop, zero, zero, zero - 1]
        split = col["parts"][owner] > 1
        if split.any():
            at, kl = places[split], klass[split]
            _, one = np.unique(kl, return_index=True)  # one window a class, a single one only if the class is
            at, multiple = at[one], again[split][one]
            who = np.searchsorted(begins, at, side="right") - 1
            prints = substring_hashes(np.frombuffer(raw, np.uint8), at, np.full(len(at), length)).view(np.int64)
            begin = at - begins[who] + col["first"][who]
            settled = multiple | (col["copies"][who] > 1)
            more = [np.where(settled, 0, col["key"][who]), begin, np.where(settled, begin, begin + 1), col["seed"][who], prints, col["shard"][who]]
            rows = [np.concatenate(p) for p in zip(rows, more, strict=True)]
        return _arrays(OUT, rows)

    return run


def _within(begins: np.ndarray, start: int, stop: int):
    """[start, stop) cut at stretch borders."""
    i = int(np.searchsorted(begins, start, side="right"))
    while i < len(begins) and begins[i] < stop:
        yield start, int(begins[i])
        start = int(begins[i])
        i += 1
    yield start, stop


def _merged(group: pa.Table) -> pa.Table:
    """Windows single in their own shard that another shard has too: each run is looked up in all the others."""
    col = {n: group.column(n).to_numpy() for n, _ in OUT}
    order = np.lexsort((col["print"], col["shard"]))
    col = {n: v[order] for n, v in col.items()}
    every = np.sort(col["print"])
    hit = np.zeros(len(order), bool)
    cuts = np.flatnonzero(np.diff(col["shard"])) + 1
    for run in np.split(np.arange(len(order)), cuts):  # each run is sorted and has no print twice
        own = col["print"][run]
        hit[run] = np.searchsorted(every, own, side="right") - np.searchsorted(every, own, side="left") > 1
    hit &= col["stop"] > col["start"]
    return _arrays(OUT, [col[n][hit] for n, _ in OUT])


def repeated_ranges(docs: DataFrame, length: int, split: int, shard_bytes: int) -> DataFrame:
    """(key, start, stop): ranges of windows of a row that start elsewhere too."""
    every = stored(found_stretches(docs, length), "stretches")
    seeds = every.groupBy("seed").agg(F.count("*").alias("n")).filter("n > 1").select("seed")
    again = stored(every.join(stored(seeds, "seeds"), "seed"), "again")
    classes = stored(
        again.groupBy("seed", "own").agg(F.count("*").alias("copies"), F.min(F.struct("key", "first", "windows")).alias("one")), "classes"
    )
    whole = again.join(classes.filter("copies > 1").select("seed", "own"), ["seed", "own"])
    ranges = whole.select("key", F.col("first").alias("start"), (F.col("first") + F.col("windows")).alias("stop"))
    # seeds with several classes, one of them single: only there is something to find
    mixed = classes.groupBy("seed").agg(F.count("*").alias("kinds"), F.min("copies").alias("least")).filter("kinds > 1 AND least = 1")
    asked = classes.join(stored(mixed.select("seed", "kinds"), "mixed"), "seed").select(
        "seed", "own", "copies", F.col("one.key").alias("key"), F.col("one.first").alias("first"),
        (F.col("one.windows") + length - 1).alias("bytes"), F.ceil(F.col("kinds") / split).cast("long").alias("parts"),
    )
    asked = stored(asked, "asked")
    total = asked.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_bytes))

    def cut(iterator):
        for batch in iterator:
            wanted, packed = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for rows, z in zip(wanted, packed, strict=True):
                raw = _unpack(z)
                out = [{**r, "text": raw[r["first"] : r["first"] + r["bytes"]], "key": k} for r, k in ((r, r.pop("key")) for r in rows)]
                yield pa.RecordBatch.from_pylist(
                    out,
                    schema=pa.schema([("seed", pa.int64()), ("own", pa.int64()), ("copies", pa.int64()), ("first", pa.int32()),
                                      ("bytes", pa.int32()), ("parts", pa.int64()), ("key", pa.int64()), ("text", pa.binary())]),
                )

    wanted = asked.groupBy("key").agg(F.collect_list(F.struct("seed", "own", "copies", "first", "bytes", "parts", "key")).alias("rows"))
    texts = packed_texts(docs).select("key", "packed").join(wanted, "key").select("key", "rows", "packed").dropDuplicates(["key"])
    pieces = texts.select("rows", "packed").mapInArrow(
        cut, "seed long, own long, copies long, first int, bytes int, parts long, key long, text binary"
    )
    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("own"), "parts")).otherwise(0)
    placed = pieces.withColumn("shard", F.pmod(F.xxhash64("seed", part), F.lit(shards)).cast("long"))
    schema = "key long, start int, stop int, seed long, print long, shard long"
    done = stored(placed.repartition(shards, "shard").groupBy("shard").applyInArrow(_shard(length), schema), "shards")
    prints = done.filter("shard >= 0")
    bits = max(0, (prints.count() * 48 // shard_bytes)).bit_length()
    merged = prints.withColumn("range", F.shiftrightunsigned(F.xxhash64("print"), 64 - bits) if bits else F.lit(0).cast("long"))
    merged = merged.groupBy("range").applyInArrow(lambda t: _merged(t.drop_columns(["range"])), schema)
    plain = ["key", "start", "stop"]
    return ranges.unionAll(done.filter("shard < 0").select(*plain)).unionAll(merged.select(*plain))


def cut_repeats(
    docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, split: int = SPLIT,
    shard_bytes: int = SHARD_BYTES, texts: bool = True,
) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with texts the bytes kept."""
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    ranges = repeated_ranges(narrow, length, split, shard_bytes)
    by_row = ranges.groupBy("key").agg(F.collect_set(F.struct("start", "stop")).alias("ranges"))
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(iterator):
        for batch in iterator:
            out = []
            for ident, z, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = _unpack(z)
                kept, removed, spans, at = [], 0, 0, 0
                for start, stop in sorted((r["start"], r["stop"] - 1 + length) for r in found or []):
                    if start > at or not spans:
                        kept.append(raw[at:start])
                        spans += 1
                        removed += stop - start
                        at = stop
                    elif stop > at:
                        removed += stop - at
                        at = stop
                rest = b"".join([*kept, raw[at:]])
                out.append((ident, len(raw), removed, spans, hashlib.sha256(rest).hexdigest(), rest if texts else None))
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            types = [batch.schema.types[0], pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

    joined = packed_texts(narrow).join(by_row, "key", "left").select("doc_id", "packed", "ranges")
    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_repeats(table(spark, sf_dir, "documents"), texts=False).drop("kept")
