"""Language-model scores: cross-entropy difference between a target and a background model.

Both models are interpolated bigram models over one vocabulary, counted over all documents (background) and over
all target documents. The vocabulary is every word of the documents (`vocabulary` limits it to the most frequent)
plus one entry for the rest; words and pairs are counted one by one under 64-bit hashes, so the counts grow with the corpus.

Texts are read once and written as blocks of some million words, each with its own word list. Marks reach the blocks
by a join of ids. A block sends each of its words and pairs once, with its counts, to the part of the key
range it falls in and gets the sums over all blocks back. So a frequent pair is as many rows as there are blocks,
no table of counts passes through the driver, and a task holds one block or one part.

A document's score is its mean loss per token under the target model less that under the background
model; low is like the target. A document's own counts are taken out of both models before it is scored,
so that being part of the target does not make a document look like it.

Defined results: null or wordless texts have no tokens and null losses; a null id is never target, a repeated
id is target in every row; repeated rows are scored one by one (each still counted in the models as the other's
copy); without any target document the target model is uniform; an empty table gives no rows;
other columns play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swingtrace.llm.common import stored, table
from swingtrace.llm.hashing import batches, mix, salt, word_hashes

BATCH_BYTES = 2 << 20
BLOCK_WORDS = 3 << 19  # a block is closed at so many words; a longer text is a block of its own
SCORED_WORDS = 1 << 18  # documents of a block are scored so many words at a time
PART_KEYS = 1_500_000  # rows of one part of the key range, about
REST = np.uint64(0)  # stands for the words outside a limited vocabulary
WORDS, PAIRS, MARKS, SUMS = range(4)
ANSWER = "b long, kind int, p long, n binary, t binary, size long, total long, target long"


@dataclass(frozen=True)
class Options:
    vocabulary: int | None = None  # all words
    buckets: int | None = None  # parts of the key range; by the number of keys where not given
    pair_weight: float = 0.6
    smoothing: float = 0.1


@dataclass(frozen=True)
class Models:
    """Blocks of the counted documents and places of the target documents in them."""

    docs: DataFrame
    blocks: DataFrame
    targets: object
    marks: DataFrame
    listed: np.ndarray | None
    options: Options


def pack(values: np.ndarray) -> bytes:
    """Compressed by byte planes, so that small and ascending numbers take little."""
    if not len(values):
        return b""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return planes.nbytes.to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes, kind) -> np.ndarray:
    if not data:
        return np.zeros(0, kind)
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def encoded(docs: DataFrame, text: str, doc_id: str, side: int) -> DataFrame:
    """Blocks: number, ids of the documents in order, words of each, sorted hashes of all words, places in these."""

    def run(iterator):
        first, made = (side << 62) | (TaskContext.get().partitionId() << 24), 0
        ids, lengths, hashes = [], [], []

        def block():
            words, places = np.unique(np.concatenate(hashes), return_inverse=True)
            docs = pa.concat_arrays(ids)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([first + made], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs),
                    pa.array([pack(np.concatenate(lengths).astype(np.int64))], pa.binary()), pa.array([pack_sorted(words)], pa.binary()),
                    pa.array([pack(places.astype(np.uint32))], pa.binary()), pa.array([len(places)], pa.int64()),
                ],
                names=["b", "doc_ids", "lengths", "words", "places", "size"],
            )

        for batch, texts in batches(iterator, BATCH_BYTES, "text"):
            found, per_text = word_hashes(texts)
            ids.append(batch.column(1)), lengths.append(per_text), hashes.append(found)
            if sum(map(len, hashes)) >= BLOCK_WORDS:
                yield block()
                made, ids, lengths, hashes = made + 1, [], [], []
        if ids:
            yield block()

    kind = docs.schema[doc_id].dataType.simpleString()
    docs = docs.select(F.col(text).alias("text"), F.col(doc_id).alias("doc_id"))
    return docs.mapInArrow(run, f"b long, doc_ids array<{kind}>, lengths binary, words binary, places binary, size long")


def marked(blocks: DataFrame, targets) -> DataFrame:
    """Per block the places of its target documents; only ids are joined. targets: ids, or a frame with them as its first column."""
    spark, kind = blocks.sparkSession, blocks.schema["doc_ids"].dataType.elementType
    if not isinstance(targets, DataFrame):
        targets = spark.createDataFrame([(i,) for i in targets if i is not None], f"doc_id {kind.simpleString()}")
    good = targets.select(F.col(targets.columns[0]).alias("doc_id")).dropna().distinct()
    rows = blocks.select("b", F.posexplode("doc_ids").alias("place", "doc_id")).dropna()
    return stored(rows.join(good, "doc_id", "left_semi").groupBy("b").agg(F.collect_list("place").alias("places")), "marks")


class Block:
    """One block with its words, the pairs in it, and which document each word is of."""

    def __init__(self, row: dict, listed: np.ndarray | None):
        self.lengths, self.words, self.at = unpack(row["lengths"], np.int64), unpack_sorted(row["words"]), unpack(row["places"], np.uint32).view(np.int32)
        if listed is not None:
            self.words, moved = np.unique(np.where(np.isin(self.words, listed), self.words, REST), return_inverse=True)
            self.at = moved.astype(np.int32)[self.at]
        self.owner = np.repeat(np.arange(len(self.lengths), dtype=np.int32), self.lengths)
        self.second = np.flatnonzero(self.owner[1:] == self.owner[:-1]) + 1  # words that have one before them
        n = max(1, len(self.words))
        codes, pair_at = np.unique(self.at[self.second - 1].astype(np.int64) * n + self.at[self.second], return_inverse=True)
        pair_at = pair_at.astype(np.int32)
        keys = mix(mix(self.words[codes // n] + salt(3)) ^ (self.words[codes % n] + salt(5))) if len(codes) else np.zeros(0, np.uint64)
        self.pairs, moved = np.unique(keys, return_inverse=True)
        self.pair_at = moved.astype(np.int32)[pair_at]

    def keys(self):
        """Kind, sorted keys, place of each occurrence among them, document of each occurrence."""
        return (WORDS, self.words, self.at, self.owner), (PAIRS, self.pairs, self.pair_at, self.owner[self.second])


def parts_of(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Parts of the key range that sorted keys fall in, and where each begins and ends among them."""
    part = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    cuts = np.flatnonzero(np.diff(part)) + 1
    bounds = np.concatenate([[0], cuts, [len(keys)]]) if len(keys) else np.zeros(1, np.int64)
    return part[bounds[:-1]].astype(np.int64), bounds


def sent(blocks: DataFrame, marks: DataFrame, listed, parts: int, counts: bool, asks: bool) -> DataFrame:
    """Per block, kind and part: the keys and how often they occur in all and in target documents."""
    listed = blocks.sparkSession.sparkContext.broadcast(listed)
    schema = pa.schema([("b", pa.int64()), ("kind", pa.int32()), ("p", pa.int64()), ("asks", pa.bool_()), ("k", pa.binary()), ("n", pa.binary()), ("t", pa.binary())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for row in left.to_pylist():
            block = Block(row, listed.value)
            target = np.zeros(len(block.lengths), bool)
            for r in right.to_pylist():
                target[r["places"]] = True
            for kind, keys, at, owner in block.keys():
                n = np.bincount(at, minlength=len(keys)) if counts else np.zeros(len(keys), np.int64)
                t = np.bincount(at[target[owner]], minlength=len(keys)) if counts else n
                numbers, bounds = parts_of(keys, parts)
                for p, i, j in zip(numbers.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    rows.append((row["b"], kind, p, asks, pack_sorted(keys[i:j]), pack(n[i:j]), pack(t[i:j])))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return blocks.groupBy("b").cogroup(marks.groupBy("b")).applyInArrow(run, "b long, kind int, p long, asks boolean, k binary, n binary, t binary")


def summed(rows: pa.Table) -> pa.Table:
    """Of one kind and part: for each block that asks the sums of its keys, and one row of totals."""
    kind, p = rows["kind"][0].as_py(), rows["p"][0].as_py()
    keys = [unpack_sorted(x.as_py()) for x in rows["k"]]
    all_keys, at = np.unique(np.concatenate(keys), return_inverse=True)
    sums = []
    for name in ("n", "t"):
        total = np.zeros(len(all_keys), np.int64)
        np.add.at(total, at, np.concatenate([unpack(x.as_py(), np.int64) for x in rows[name]]))
        sums.append(total)
    n, t = sums
    out, start = [(-1, SUMS + kind, p, None, None, int(((n > 0) & (all_keys != REST)).sum()), int(n.sum()), int(t.sum()))], 0
    for b, asks, own in zip(rows["b"].to_pylist(), rows["asks"].to_pylist(), keys, strict=True):
        if asks:
            mine = at[start : start + len(own)]
            out.append((b, kind, p, pack(n[mine]), pack(t[mine]), None, None, None))
        start += len(own)
    types = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), types, strict=True)], names=["b", "kind", "p", "n", "t", "size", "total", "target"])


def most_frequent(blocks: DataFrame, size: int) -> np.ndarray:
    """Sorted hashes of the most frequent words, whose number the caller bounds."""

    def run(rows: pa.Table) -> pa.Table:
        block = Block(rows.to_pylist()[0], None)
        return pa.table({"k": block.words.view(np.int64), "n": np.bincount(block.at, minlength=len(block.words))})

    found = blocks.groupBy("b").applyInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    return np.sort(np.array([r.k for r in found.orderBy(F.desc("n"), "k").limit(size).collect()], np.int64).view(np.uint64))


def train(docs: DataFrame, targets, options: Options = Options(), *, text: str = "text", doc_id: str = "doc_id") -> Models:
    """Both models from docs; targets are the ids of the target documents, as a set or a frame."""
    blocks = stored(encoded(docs, text, doc_id, 0), "blocks")
    listed = None if options.vocabulary is None else most_frequent(blocks, options.vocabulary)
    return Models(docs, blocks, targets, marked(blocks, targets), listed, options)


def score(docs: DataFrame, models: Models, targets, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row of docs: doc_id, n_tokens, losses and their difference, target less background."""
    o, own = models.options, docs is models.docs
    blocks = models.blocks if own else stored(encoded(docs, text, doc_id, 1), "blocks")
    marks = models.marks if own and targets is models.targets else marked(blocks, targets)
    keys = sum(x.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] for x in ([blocks] if own else [models.blocks, blocks]))
    parts = o.buckets or max(8, -(-keys // PART_KEYS))
    asked = sent(models.blocks, models.marks, models.listed, parts, True, own)
    if not own:
        asked = asked.unionAll(sent(blocks, marks, models.listed, parts, False, True))
    answers = stored(asked.groupBy("kind", "p").applyInArrow(summed, ANSWER), "sums")
    totals = answers.filter(f"kind = {SUMS + WORDS}").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("size", "total", "target"))).first()
    vocabulary, totals = totals[0] + 1, totals[1:]
    listed = docs.sparkSession.sparkContext.broadcast(models.listed)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, (row,) = left["doc_ids"].combine_chunks().flatten(), left.drop_columns(["doc_ids"]).to_pylist()
        block, found, target = Block(row, listed.value), {WORDS: [], PAIRS: []}, np.zeros(len(ids), bool)
        for r in right.to_pylist():
            if r["kind"] == MARKS:
                target[r["places"]] = True
            else:
                found[r["kind"]].append((r["p"], r["n"], r["t"]))
        sums = [[np.concatenate([np.zeros(0, np.int64), *(unpack(x[c], np.int64) for x in sorted(found[k]))]) for c in (1, 2)] for k in (WORDS, PAIRS)]
        n_tokens, has = block.lengths, block.lengths > 0
        back, ahead = losses(block, sums, totals, vocabulary, target, o)
        return pa.Table.from_arrays(
            [ids, pa.array(n_tokens), *(pa.array(x, pa.float64(), mask=~has) for x in (back, ahead, ahead - back))],
            names=["doc_id", "n_tokens", "background_loss", "target_loss", "difference"],
        )

    place = marks.select("b", F.lit(MARKS).alias("kind"), F.lit(0).cast("long").alias("p"), F.lit(None).cast("binary").alias("n"), F.lit(None).cast("binary").alias("t"), "places")
    given = answers.filter("b >= 0").select("b", "kind", "p", "n", "t", F.lit(None).cast("array<int>").alias("places"))
    return blocks.groupBy("b").cogroup(given.unionAll(place).groupBy("b")).applyInArrow(
        run, f"doc_id {kind}, n_tokens long, background_loss double, target_loss double, difference double"
    )


def losses(block: Block, sums: list, totals, vocabulary: int, target: np.ndarray, o: Options) -> tuple[np.ndarray, np.ndarray]:
    """Mean loss per token of each document under background and target, the document's own counts taken out."""
    ends, out, i = np.cumsum(block.lengths), np.zeros((2, len(block.lengths))), 0
    while i < len(ends):
        start = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, start + SCORED_WORDS, side="right")))
        x, y = np.searchsorted(block.second, (start, ends[j - 1]))
        at, owner, lengths = block.at[start : ends[j - 1]], block.owner[start : ends[j - 1]] - np.int64(i), block.lengths[i:j]
        second, pair_at = block.second[x:y] - start, block.pair_at[x:y]
        _, word, own = np.unique(owner * max(1, len(block.words)) + at, return_inverse=True, return_counts=True)
        _, pair, own_pairs = np.unique(owner[second] * max(1, len(block.pairs)) + pair_at, return_inverse=True, return_counts=True)
        starts = np.bincount(word[second - 1], minlength=len(own))
        for row in (0, 1):
            mine = np.ones(j - i) if row == 0 else target[i:j].astype(float)
            single, pairs = sums[0][row], sums[1][row]
            count = np.maximum(0, single[at] - mine[owner] * own[word])
            p = (count + o.smoothing) / (np.maximum(0.0, totals[row] - mine * lengths) + o.smoothing * vocabulary)[owner]
            m = mine[owner[second]]
            both = np.maximum(0, pairs[pair_at] - m * own_pairs[pair])
            before = np.maximum(0, single[at[second - 1]] - m * starts[word[second - 1]])
            share = o.pair_weight * before / (before + 1.0)
            p[second] = share * np.minimum(1.0, both / np.maximum(before, 1.0)) + (1 - share) * p[second]
            out[row, i:j] = np.bincount(owner, -np.log(p), minlength=j - i) / np.maximum(1, lengths)
        i = j
    return out[0], out[1]


def target_ids(labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Ids of all documents labelled good and not toxic."""
    return labels.filter("quality = 1 AND coalesce(toxic, 0) = 0").select(doc_id).dropna().distinct()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, targets = table(spark, sf_dir, "documents"), target_ids(table(spark, sf_dir, "labels"))
    return score(docs, train(docs, targets), targets)
