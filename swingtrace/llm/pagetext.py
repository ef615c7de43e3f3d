"""Main text of web pages by a recurrent block labeller.

A page becomes its sequence of leaf text blocks, each with the path of open elements (tags, classes, ids).
A block's vector is its path and its words, both hashed, and a few counts. A bidirectional LSTM in numpy reads
the whole sequence in both directions and labels each block article or not, so a block is judged by all others.

The network is trained on at most `train_pages` pages. Their weak labels come from element and class names
(navigation, header, footer, aside, form, advert, comment... against article, main, content); copies of
the pages with other containers, dropped names and inserted boilerplate of every kind teach it to use what
surrounds a block. Labels come from the network alone.

Defined results: a null or empty html, and a page without an article block, give an empty text; rows are
judged one by one, so repeated rows and null ids keep their row; an empty table gives an empty
result; other columns play no part. White space inside a block (also from <br>) becomes one space.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swingtrace.llm.common import first_texts, table
from swingtrace.llm.recurrent import BiLstm

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|svg|textarea|iframe)\b.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>",
    re.S | re.I,
)
NAMES = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Elements without end tag; elements inside a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup "
    "time tt u var wbr".split()
)
#: Names that mark what is not the article, and names that mark the article.
AWAY = frozenset(
    "nav navigation navbar menu header masthead footer aside sidebar form ad ads advert advertisement sponsor sponsored banner promo cookie "
    "cookies consent notice alert popup modal comment comments reply respondform share social related breadcrumb breadcrumbs "
    "newsletter subscribe login search pagination pager copyright widget head title button select".split()
)
HERE = frozenset("article main content post entry story articlebody".split())
PARTS = re.compile(r"[a-z]+")
PATH, WORDS, COUNTS = 256, 32, 6
INPUTS = PATH + WORDS + COUNTS


@dataclass(frozen=True)
class Options:
    train_pages: int = 300
    variants: int = 900  # of all pages together
    hidden: int = 16
    epochs: int = 6
    seed: int = 11


def _names(tag: str, rest: str) -> tuple[str, ...]:
    out = [tag]
    if rest and "=" in rest:
        for m in NAMES.finditer(rest):
            out += PARTS.findall((m[1] or m[2] or m[3] or "").lower())
    return tuple(out)


def blocks(page: str) -> list[tuple[tuple[str, ...], str, int]]:
    """(distinct names of all open elements, text, characters inside links) of every leaf block with text, in page order.

    Names and tags of open elements are counted, so a deeply nested page costs no more per block than it has distinct names.
    """
    out, stack, pieces = [], [("html",)], []
    named, tags = Counter(["html"]), Counter(["html"])
    link = 0
    linked = 0

    def flush() -> None:
        nonlocal pieces, linked
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            if text:
                out.append((tuple(named), text, linked))
            pieces, linked = [], 0

    def add(piece: str) -> None:
        nonlocal linked
        if piece:
            pieces.append(piece)
            if link:
                linked += len(piece)

    def close() -> str:
        names = stack.pop()
        tags[names[0]] -= 1
        for n in names:
            named[n] -= 1
            if not named[n]:
                del named[n]
        return names[0]

    at = 0
    for m in TAG.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        tag = m["name"]
        if tag is None:
            if m["raw"]:
                pieces.append(" ")
            continue
        tag = tag.lower()
        if tag == "a":
            link = 0 if m["end"] else 1
        if tag in INLINE:
            if tag == "br":
                pieces.append(" ")
            continue
        flush()
        if m["end"]:
            while tags[tag] > (tag == "html"):
                if close() == tag:
                    break
        elif tag not in VOID and not m["rest"].endswith("/"):
            if stack[-1][0] == "p" or (tag in ("li", "tr", "td", "th", "dt", "dd", "option") and stack[-1][0] == tag):
                close()
            names = _names(tag, m["rest"])
            stack.append(names)
            tags[tag] += 1
            named.update(names)
    add(page[at:])
    flush()
    return out


class _Hashed(dict):
    """name -> bucket, forgotten when too many have been seen."""

    def __init__(self, size: int, most: int = 300_000):
        super().__init__()
        self.size, self.most = size, most

    def __missing__(self, name: str) -> int:
        if len(self) > self.most:
            self.clear()
        self[name] = bucket = zlib.crc32(name.encode("utf-8", "surrogatepass")) % self.size
        return bucket


def vectors(page: list[tuple[tuple[str, ...], str, int]], names: _Hashed, words: _Hashed) -> np.ndarray:
    """One row per block: hashed path, hashed words, counts."""
    n = len(page)
    x = np.zeros((n, INPUTS), np.float32)
    listed = [text.split(" ") for _, text, _ in page]
    owner = np.repeat(np.arange(n), [len(w) for w in listed])
    buckets = np.fromiter((words[w] for ws in listed for w in ws), np.int64, len(owner))
    counts = np.bincount(owner * WORDS + buckets, minlength=n * WORDS).reshape(n, WORDS)
    x[:, PATH : PATH + WORDS] = np.sqrt(counts / np.maximum(1, counts.sum(axis=1, keepdims=True)))
    for i, (path, text, linked) in enumerate(page):
        x[i, [names[p] for p in path]] = 1
        size = len(text)
        x[i, PATH + WORDS :] = (
            min(1.5, np.log1p(size) / 6), min(1.0, linked / max(1, size)), min(1.0, text.count(".") / max(1, size) * 40),
            float(size < 40), i / n, 1.0 / n,
        )
    return x


def weak_label(path: tuple[str, ...]) -> int:
    """1 article, 0 not, -1 unknown; only for training."""
    if not AWAY.isdisjoint(path):
        return 0
    return 1 if not HERE.isdisjoint(path) else -1


def variant(page: list, rng: random.Random) -> list:
    """The page in another dress: the article's container renamed, names dropped, boilerplate put in anywhere."""
    here = rng.choice([("article",), ("main",), ("div", "content"), ("div", "post", "content"), ("section", "story"), ("div", "entry"), ("div", "article", "body")])
    out, bare = [], rng.random() < 0.3
    if rng.random() < 0.3:  # a short page
        start = rng.randrange(max(1, len(page)))
        page = page[start : start + rng.randint(1, 5)]
    for path, text, linked in page:
        path = tuple(n for n in path if n != "body") if bare else path
        changed = tuple(n for p in path for n in (here if p in HERE else (p,)))
        out.append((changed, text, linked, weak_label(path)))
    vocabulary = " ".join(t for _, t, _ in page).split() or ["text"]
    kinds = sorted(AWAY - {"head", "title"})
    for _ in range(rng.randint(1, 5)):
        kind = rng.choice(kinds)
        tag = kind if kind in ("nav", "header", "footer", "aside", "form") else rng.choice(["div", "section", "aside", "ul"])
        inside = rng.random() < 0.5
        path = ("html", *(() if bare else ("body",)), *(here if inside else ()), tag, kind, rng.choice(["p", "li", "div", "span"]))
        at = rng.randint(0, len(out)) if inside else rng.choice([0, len(out)])
        for _ in range(rng.randint(1, 4)):
            text = " ".join(rng.choices(vocabulary, k=rng.randint(1, 40)))
            out.insert(at, (path, text, rng.choice([0, len(text)]), 0))
    return out


def train(pages: DataFrame, html: str = "html", options: Options = Options()) -> BiLstm:
    """A network fitted to a bounded, repeatable choice of distinct pages and their variants."""
    h = F.col(html)
    chosen = first_texts(pages.select(h.alias("h")).filter(h.isNotNull()), options.train_pages)
    names, words, rng = _Hashed(PATH), _Hashed(WORDS), random.Random(options.seed)
    sequences = []
    parsed = [page for page in (blocks(r.h) for r in chosen.toLocalIterator()) if page]
    for page in parsed:
        plain = [(*b, weak_label(b[0])) for b in page]
        for dressed in (plain, *(variant(page, rng) for _ in range(-(-options.variants // len(parsed))))):
            y = np.array([max(0, b[3]) for b in dressed], np.float32)
            weight = np.array([float(b[3] >= 0) for b in dressed], np.float32)
            x = vectors([b[:3] for b in dressed], names, words)
            for i in range(0, len(x), 100):  # long pages in stretches
                sequences.append((x[i : i + 100], y[i : i + 100], weight[i : i + 100]))
    net = BiLstm(INPUTS, options.hidden, options.seed)
    if sequences:
        net.fit(sequences, options.epochs, options.seed)
    return net


def texts(pages: list[str], net: BiLstm) -> list[list[str]]:
    """The article's blocks of each page."""
    names, words = _Hashed(PATH), _Hashed(WORDS)
    parsed = [blocks(p) for p in pages]
    scores = net.predict([vectors(p, names, words) for p in parsed])
    return [[b[1] for b, s in zip(p, score, strict=True) if s >= 0.5] for p, score in zip(parsed, scores, strict=True)]


def extract(
    pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", options: Options = Options()
) -> DataFrame:
    """Per row: page_id, url, text, n_chars, n_blocks (blocks of the article)."""
    sent = pages.sparkSession.sparkContext.broadcast(train(pages, html, options))  # a few thousand numbers

    def run(iterator):
        for batch in iterator:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                found = texts([h or "" for h in part.column(2).to_pylist()], sent.value)
                joined = ["\n\n".join(b) for b in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(1), pa.array(joined, pa.string()), pa.array([len(t) for t in joined], pa.int64()),
                        pa.array([len(b) for b in found], pa.int64()),
                    ],
                    names=["page_id", "url", "text", "n_chars", "n_blocks"],
                )

    kind, place = (pages.schema[c].dataType.simpleString() for c in (page_id, url))
    narrow = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    return narrow.mapInArrow(run, f"page_id {kind}, url {place}, text string, n_chars long, n_blocks long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
