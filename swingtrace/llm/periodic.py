"""Periodic runs of words: online sparse diagonal DP.

A word and an earlier occurrence of it lie on the diagonal of their lag. Consecutive matches on a diagonal of lag q
make a stretch of period q; the DP keeps the active diagonals with their match lengths, and a diagonal that ends with
enough matches emits its stretch at once.

- No run has fewer than GRAM matches on its diagonal (length >= max(12, 2q)), so the occurrences looked up are those of
  GRAM words at a time. In plain prose hardly any window of six words comes back, which keeps the diagonals sparse.
- Where the nearest earlier occurrence stays at one lag p for more than p words, the text has period p there, and
  diagonals at multiples of p inside it cannot hold a run of their own; they are not walked. One word repeated n times
  costs n steps, not n * n.
- Positions are taken in blocks of at most `block` matches, with the active diagonals carried from block to block.
- A stretch of period q is a run of its own if no proper divisor of q is a period of it: with at least 2q words, its
  smallest period divides q.

Each text is handled by itself inside a task; nothing is shuffled.

Defined results: a null text has no words; without a run start, length, period and exponent are null and both hashes are
those of no runs and of the whole word sequence; a null id leaves its text as it is, as h is not defined; rows that repeat an id or a text are
judged one by one; empty tables give empty results; other columns play no part. Very long texts: memory is about 150
bytes a word of the longest text in a task, beside `block` matches.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swingtrace.llm.common import table
from swingtrace.llm.hashing import batches, mix, salt

SHORTEST = 12
GRAM = 6  # max(q, SHORTEST - q) is at least 6 for every q
BLOCK = 1 << 20
BATCH_BYTES = 1 << 20


def _grams(ids: np.ndarray) -> np.ndarray:
    n = len(ids) - GRAM + 1
    out = np.zeros(max(0, n), np.uint64)
    with np.errstate(over="ignore"):
        mixed = mix(ids.astype(np.uint64) + np.uint64(1))
        for j in range(GRAM):
            out += mix(mixed[j : j + max(0, n)] + salt(j + 1))
    return out


def _matches(grams: np.ndarray):
    """(occurrences, first of each position's list, how many earlier ones to walk, nearest lag or 0) by position."""
    n = len(grams)
    order = np.argsort(grams, kind="stable")
    ordered = grams[order]
    opens = np.empty(n, bool)
    opens[0] = True
    np.not_equal(ordered[1:], ordered[:-1], out=opens[1:])
    first_of = np.maximum.accumulate(np.where(opens, np.arange(n), 0))
    first, rank, lag = np.empty(n, np.int64), np.empty(n, np.int64), np.zeros(n, np.int64)
    first[order] = first_of
    rank[order] = np.arange(n) - first_of
    again = np.flatnonzero(~opens)
    lag[order[again]] = order[again] - order[again - 1]
    same = np.zeros(n, bool)
    same[1:] = lag[1:] == lag[:-1]
    region = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
    has = np.flatnonzero(lag)
    p = lag[has]
    base = has - ((has - region[has]) // p + 1) * p  # the last occurrence before the region repeats itself
    walk = np.zeros(n, np.int64)
    walk[has] = rank[base] + 1
    return order, first, walk, lag


def _smallest(ids: np.ndarray, start: int, length: int, q: int) -> bool:
    """Whether no proper divisor of q is a period of the stretch."""
    part, rest, r = ids[start : start + length], q, 2
    while rest > 1:
        if r * r > rest:
            r = rest
        if rest % r == 0:
            d = q // r
            if np.array_equal(part[d:], part[:-d]):
                return False
            while rest % r == 0:
                rest //= r
        r += 1
    return True


def runs(ids: np.ndarray, block: int = BLOCK) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence of word numbers, by start, then period."""
    n = len(ids)
    if n < SHORTEST:
        return []
    grams = _grams(ids)
    g = len(grams)
    order, first, walk, lag = _matches(grams)
    total = np.cumsum(walk)
    found: list[tuple[int, int, int]] = []
    active_lag, active_from = np.zeros(0, np.int64), np.zeros(0, np.int64)  # diagonals that reach the last position

    def emit(lags, starts, ends):
        """Diagonals matching at grams starts..ends, which are words starts..ends + GRAM - 1."""
        long = ends - starts + GRAM >= np.maximum(lags, SHORTEST - lags)
        for q, s, e in zip(lags[long].tolist(), starts[long].tolist(), ends[long].tolist(), strict=True):
            start, length = s - q, e + GRAM - s + q
            if _smallest(ids, start, length, q):
                found.append((start, length, q))

    at = 0
    while at < g:
        done = total[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(total, done + block, side="right")))
        where = np.arange(at, stop)
        n_walk = walk[at:stop]
        i = np.repeat(where, n_walk)
        nth = np.arange(len(i)) - np.repeat(np.cumsum(n_walk) - n_walk, n_walk)
        last = nth == np.repeat(n_walk, n_walk) - 1  # the nearest occurrence stands for the last one walked
        j = np.where(last, i - lag[i], order[first[i] + nth])
        key = np.sort((i - j) * (g + 1) + i)
        if len(key):
            cut = np.flatnonzero(np.diff(key) != 1) + 1
            s, e = key[np.append(0, cut)], key[np.append(cut, len(key)) - 1]
            lags, starts, ends = s // (g + 1), s % (g + 1), e % (g + 1)
        else:
            lags = starts = ends = np.zeros(0, np.int64)
        if len(active_lag):
            fresh = np.flatnonzero(starts == at)  # lags ascend, one segment a lag starts at the block's first position
            there = np.searchsorted(lags[fresh], active_lag)
            there = np.minimum(there, max(0, len(fresh) - 1))
            goes_on = lags[fresh][there] == active_lag if len(fresh) else np.zeros(len(active_lag), bool)
            starts[fresh[there[goes_on]]] = active_from[goes_on]
            ended = ~goes_on
            emit(active_lag[ended], active_from[ended], np.full(ended.sum(), at - 1))
        open_ = ends == stop - 1
        emit(lags[~open_], starts[~open_], ends[~open_])
        active_lag, active_from = lags[open_], starts[open_]
        at = stop
    emit(active_lag, active_from, np.full(len(active_lag), g - 1))
    return sorted(found, key=lambda r: (r[0], r[2]))


def repeating_tail(doc_id: int | None, n: int) -> np.ndarray:
    """Which original word stands at each position: documents of one hash class in ten have a periodic tail."""
    at = np.arange(n)
    if doc_id is None or not n:
        return at
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return at
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.where(at < a, at, a + (at - a) % p)


def collapse(words: list[bytes], ids: np.ndarray, found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run repeats: each run keeps its first period."""
    mark = np.zeros(len(ids) + 1, np.int64)
    for start, length, q in found:
        mark[start + q] += 1
        mark[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(mark)[:-1] == 0)
    return [words[k] for k in kept.tolist()]


def _row(doc_id, text: bytes, tails: bool, block: int) -> tuple:
    words = text.split()  # ASCII white space, as in the definition of a word
    if tails:
        tail = repeating_tail(doc_id, len(words))
        if len(words) and tail[-1] != len(words) - 1:
            words = [words[k] for k in tail.tolist()]
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    found = runs(ids, block)
    best = max(found, key=lambda r: (r[1], -r[0], -r[2])) if found else (None, None, None)
    told = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    kept = collapse(words, ids, found) if found else words
    return (
        len(found), *best, 1000 * best[1] // best[2] if found else None,
        hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest(),
    )


def periodic_runs(
    docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", tails: bool = False, block: int = BLOCK
) -> DataFrame:
    """Per row of docs: doc_id, n_runs, the longest run's start, length, period and exponent_milli, and both digests.

    `tails` first gives the texts of one id class in ten a periodic tail (`repeating_tail`).
    """
    numbers = ("n_runs", "start", "length", "period", "exponent_milli")
    texts = ("runs_sha256", "collapsed_sha256")

    def run(iterator):
        for batch, raw in batches(iterator, BATCH_BYTES):
            rows = [_row(d, t, tails, block) for d, t in zip(batch.column(0).to_pylist(), raw, strict=True)]
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(columns[k], pa.int64()) for k in range(5)),
                 *(pa.array(columns[k], pa.string()) for k in (5, 6))],
                names=["doc_id", *numbers, *texts],
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    told = ", ".join([f"doc_id {kind}", *(f"{c} long" for c in numbers), *(f"{c} string" for c in texts)])
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, told)


def collapsed_texts(docs: DataFrame, *, text: str = "text", block: int = BLOCK) -> DataFrame:
    """docs with every run cut to its first period, words joined by one space; texts without a run stay as they are."""
    rows = docs.withColumn(text, F.col(text).cast("string"))
    place = rows.columns.index(text)

    def run(iterator):
        for batch, raw in batches(iterator, BATCH_BYTES, text):
            out = []
            for value, t in zip(batch.column(place).to_pylist(), raw, strict=True):
                words = t.split()
                number: dict[bytes, int] = {}
                ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
                found = runs(ids, block)
                out.append(b" ".join(collapse(words, ids, found)).decode("utf-8", "surrogatepass") if found else value)
            yield batch.set_column(place, batch.schema.field(place), pa.array(out, pa.string()))

    return rows.mapInArrow(run, rows.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), tails=True)
