"""Quality rules: divergence of a document's character classes and common words from its language's.

Base rules count words, symbols, repeated lines and repeated 8-word windows. The divergence rule
compares two histograms of a document, over character classes and over the common words of its
language, to the same histograms summed over all documents of that language, by the Jensen-Shannon
distance (square root of the divergence in bits, 0 to 1). Short documents are guarded: a histogram of
few characters or words is noise, so it takes no part in the verdict.

Everything is built-in column functions. The references are one row per language group of
COMMON_WORDS (five rows), so they travel as literals.

Defined results: a null or empty text has no words and fails the base rule; a null or unknown
language belongs to the group "other", which has a character reference but no common words; rows are
judged one by one, so repeated rows and ids keep their own row; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swingtrace.llm.common import bitmap, count_of, narrowed, stored, table, words

#: Common words by language.
COMMON_WORDS = {
    "de": ["auf", "das", "dem", "den", "der", "des", "die", "ein", "eine", "für", "im", "in", "ist", "mit", "nicht",
           "sich", "und", "von", "zu"],
    "en": ["a", "and", "are", "as", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the",
           "this", "to", "was", "with"],
    "es": ["con", "de", "del", "el", "en", "es", "la", "las", "los", "no", "para", "por", "que", "se", "su", "un",
           "una", "y"],
    "fr": ["au", "avec", "dans", "de", "des", "du", "elle", "en", "est", "et", "la", "le", "les", "par", "pas",
           "pour", "que", "qui", "sur", "un", "une"],
}
OTHER = "other"
CLASSES = ("upper", "punct", "symbol", "space", "wide", "rest")
SYMBOLS, PUNCTUATION = "#*$%&|<>", ".,;:!?"
WINDOW = 8


@dataclass(frozen=True)
class Rules:
    min_words: int = 20
    max_repeat_pct: int = 30
    guard_chars: int = 200
    guard_words: int = 150
    max_class_distance: float = 0.22
    max_word_distance: float = 0.25


def language_group(lang: Column) -> Column:
    return F.when(lang.isin(*COMMON_WORDS), lang).otherwise(F.lit(OTHER))


def _pairs(a: Column, n: Column, step: int, fn) -> Column:
    """fn over each element and the one `step` later; n is the length of the result."""
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(1 + step), n), fn)


def _common(group: str) -> Column:
    """Counts of the group's common words, then of all other words."""
    each = [F.size("words") - F.size(F.array_remove("words", w)) for w in COMMON_WORDS[group]]
    return F.array(*each)


def features(docs: DataFrame, *, text: str = "text", lang: str = "lang", rows: bool = True) -> DataFrame:
    """One row per document: every count that the rules need, in one pass over the text.

    `row` holds docs' own columns (all of them, or without rows all but the text).
    """
    none = F.array().cast("array<bigint>")
    d = docs.select(
        F.struct(*(docs[f"`{c}`"] for c in docs.columns if rows or c != text)).alias("row"),
        F.coalesce(docs[text], F.lit("")).alias("text"),
        language_group(docs[lang]).alias("lang_group"),
        words(docs[text]).alias("words"),
    )
    d = d.select(
        "*",
        F.size("words").alias("n"),
        F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    # hashes of windows of 2 and 4 words, each from two of half the length; 8 only where a window of 4 repeats
    d = d.withColumn("h2", F.when(F.col("n") >= WINDOW, _pairs(F.col("words"), F.col("n") - 1, 1, lambda a, b: F.xxhash64(a, b))))
    d = d.withColumn("h4", F.when(F.col("n") >= WINDOW, _pairs(F.col("h2"), F.col("n") - 3, 2, lambda a, b: F.xxhash64(a, b))))
    again = F.size(F.array_distinct("h4")) < F.size("h4")
    d = d.withColumn(
        "h8", F.when(again, _pairs(F.col("h4"), F.col("n") - 7, 4, lambda a, b: F.xxhash64(a, b))).otherwise(none)
    )
    placed = F.sort_array(F.transform("h8", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    d = d.withColumn("placed", F.when(F.size(F.array_distinct("h8")) < F.size("h8"), placed))
    twice = lambda a, b: F.when(a.x == b.x, F.array(a.i, b.i)).otherwise(F.array().cast("array<int>"))
    hits = F.array_sort(F.array_distinct(F.flatten(_pairs(F.col("placed"), F.size("placed") - 1, 1, twice))))
    d = d.withColumn("hits", F.when(F.col("placed").isNotNull(), hits))
    gaps = _pairs(F.col("hits"), F.size("hits") - 1, 1, lambda a, b: F.least(F.lit(WINDOW), b - a).cast("long"))
    repeat = F.when(
        F.size("hits") > 0, F.aggregate(gaps, F.lit(WINDOW).cast("long"), lambda a, b: a + b)
    ).otherwise(F.lit(0))
    counted = F.array().cast("array<int>")
    for g in COMMON_WORDS:
        counted = F.when(F.col("lang_group") == g, _common(g)).otherwise(counted)
    d = d.select(
        "row", "lang_group",
        F.col("n").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        count_of(F.col("text"), SYMBOLS).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat.cast("long").alias("n_repeat_words"),
        F.length("text").cast("long").alias("n_chars"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("upper"),
        count_of(F.col("text"), PUNCTUATION).alias("punct"),
        (F.octet_length("text") - F.length("text")).cast("long").alias("wide"),
        counted.alias("listed"),
    )
    rest = F.col("word_chars") - F.col("upper") - F.col("punct") - F.col("n_symbols") - F.col("wide")
    return d.select(
        "*",
        F.array(
            F.col("upper"), F.col("punct"), F.col("n_symbols"), F.col("n_chars") - F.col("word_chars"), F.col("wide"),
            F.greatest(F.lit(0).cast("long"), rest),
        ).alias("classes"),
    )


def references(found: DataFrame, rules: Rules = Rules()) -> dict:
    """group -> (class shares, common word shares), summed over the features of all documents of min_words or more."""
    base = found.filter(F.col("n_words") >= rules.min_words)
    width = max(map(len, COMMON_WORDS.values()))
    sums = base.groupBy("lang_group").agg(
        F.sum("n_words").alias("n_words"),
        F.array(*(F.sum(F.col("classes")[i]) for i in range(len(CLASSES)))).alias("classes"),
        F.array(*(F.sum(F.try_element_at("listed", F.lit(i + 1))) for i in range(width))).alias("listed"),
    )
    out = {}
    for r in sums.collect():  # one row per group of COMMON_WORDS, and "other"
        listed = r.listed[: len(COMMON_WORDS.get(r.lang_group, []))]
        words_of = [n / r.n_words for n in [*listed, r.n_words - sum(listed)]] if listed else None
        out[r.lang_group] = ([n / max(1, sum(r.classes)) for n in r.classes], words_of)
    return out


def distance(counts: Column, total: Column, shares: Column) -> Column:
    """Jensen-Shannon distance of histogram `counts` (summing to total) from `shares`; null where either is missing."""

    def term(n: Column, q: Column) -> Column:
        p = n / total
        m = (p + q) / 2
        return F.when(n > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)

    both = F.aggregate(F.zip_with(counts, shares, term), F.lit(0.0), lambda a, x: a + x)
    return F.when((total > 0) & shares.isNotNull(), F.sqrt(F.greatest(F.lit(0.0), both / 2)))


def verdicts(found: DataFrame, refs: dict, rules: Rules = Rules()) -> DataFrame:
    """The features with both distances, base_failed and kept."""
    by_class, by_word = F.lit(None).cast("array<double>"), F.lit(None).cast("array<double>")
    for g, (of_classes, of_words) in sorted(refs.items()):
        here = F.col("lang_group") == g
        by_class = F.when(here, F.array(*map(F.lit, of_classes))).otherwise(by_class)
        if of_words:
            by_word = F.when(here, F.array(*map(F.lit, of_words))).otherwise(by_word)
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    listed = F.transform("listed", lambda x: x.cast("long"))
    d = found.withColumns({"class_shares": by_class, "word_shares": by_word, "n_classed": total("classes"), "all_words":
        F.when(F.size("listed") > 0, F.concat(listed, F.array(F.col("n_words") - total(listed))))})
    near = {
        "class_distance": F.when(
            F.col("n_chars") >= rules.guard_chars, distance(F.col("classes"), F.col("n_classed"), F.col("class_shares"))
        ),
        "word_distance": F.when(
            F.col("n_words") >= rules.guard_words, distance(F.col("all_words"), F.col("n_words"), F.col("word_shares"))
        ),
    }
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_pct * F.col("n_words"))
    far = (F.coalesce("class_distance", F.lit(0.0)) > rules.max_class_distance) | (
        F.coalesce("word_distance", F.lit(0.0)) > rules.max_word_distance
    )
    return d.withColumns(near).withColumns({"base_failed": failed, "kept": ~failed & ~far})


def judge(docs: DataFrame, *, text: str = "text", lang: str = "lang", rules: Rules = Rules(), rows: bool = True) -> DataFrame:
    """Features and verdict of every row of docs, against references taken from docs itself."""
    found = stored(features(docs, text=text, lang=lang, rows=rows), "quality-features")
    return verdicts(found, references(found, rules), rules)


def keep(docs: DataFrame, *, text: str = "text", lang: str = "lang", rules: Rules = Rules()) -> DataFrame:
    """The rows of docs that every rule keeps, with docs' own columns.

    A verdict depends on text and language group alone. Features are stored without texts, and only rows that may be rejected
    meet the rejected ones, by equal 64-bit hashes of texts.
    """
    keyed = docs.select(F.xxhash64(docs[text]).alias("text_hash"), docs[text].alias("text"), docs[lang].alias("lang"))
    gone = judge(keyed, rules=rules, rows=False).filter("not kept")
    gone = stored(gone.select(F.col("row.text_hash").alias("text_hash_"), F.col("lang_group").alias("lang_group_")).distinct(), "rejected")
    by, bits = [F.xxhash64(docs[text]), language_group(docs[lang])], bitmap(gone)
    asked = narrowed(docs, by, bits).join(gone, (by[0] == gone["text_hash_"]) & (by[1] == gone["lang_group_"]), "left_anti")
    return narrowed(docs, by, bits, out=True).unionAll(asked)


def _sql_words(listed: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in listed)


def sql(rules: Rules = Rules(), source: str = "documents") -> str:
    """DuckDB SQL of judge()'s digest columns."""
    group = f"CASE WHEN lang IN ({_sql_words(list(COMMON_WORDS))}) THEN lang ELSE '{OTHER}' END"
    listed = ", ".join(f"('{g}', '{w}')" for g, ws in COMMON_WORDS.items() for w in ws)
    spaces, eight = r"[^\x20\x09-\x0D]", WINDOW
    return rf"""
WITH raw AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, {group} AS g FROM {source}),
w AS (SELECT *, regexp_extract_all(t, '{spaces}+') AS ws FROM raw),
m AS (SELECT rid, doc_id, g, t, ws, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS upper,
  length(regexp_replace(t, '[^.,;:!?]', '', 'g')) AS punct,
  strlen(t) - length(t) AS wide, length(t) AS n_chars FROM w),
c AS (SELECT *, n_symbols AS symbol, n_chars - word_chars AS space,
  greatest(0, word_chars - upper - punct - n_symbols - wide) AS rest FROM m),
listed(g, w) AS (VALUES {listed}),
hist AS (
  SELECT rid, g, 'c' AS kind, k.k AS bin, k.n AS n, n_words FROM c, LATERAL (SELECT unnest([
    {", ".join(f"{{'k': '{x}', 'n': {x}}}" for x in CLASSES)}]) AS k)
  UNION ALL
  SELECT c.rid, c.g, 'w', l.w, len(list_filter(c.ws, lambda x: x = l.w)), n_words FROM c JOIN listed l USING (g)
  UNION ALL
  SELECT rid, g, 'w', '(rest)', n_words - len(list_filter(ws, lambda x: list_contains(k, x))), n_words
  FROM c JOIN (SELECT g, list(w) AS k FROM listed GROUP BY 1) USING (g)),
ref AS (SELECT g, kind, bin, sum(n) / sum(sum(n)) OVER (PARTITION BY g, kind) AS q FROM hist WHERE n_words >= {rules.min_words} GROUP BY g, kind, bin),
shares AS (SELECT rid, g, kind, bin, n, n / sum(n) OVER (PARTITION BY rid, kind) AS p FROM hist),
js AS (SELECT rid, kind, sqrt(greatest(0, sum(
    CASE WHEN n > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2)) AS d
  FROM shares JOIN ref USING (g, kind, bin) GROUP BY rid, kind),
win AS (SELECT rid, i, list_slice(ws, i, i + {eight - 1}) AS x FROM m, LATERAL (SELECT unnest(range(1, n_words - {eight - 2})) AS i) WHERE n_words >= {eight}),
again AS (SELECT rid, x FROM win GROUP BY rid, x HAVING count(*) > 1),
rep AS (SELECT rid, count(DISTINCT i + o) AS n FROM win JOIN again USING (rid, x), LATERAL (SELECT unnest(range(0, {eight})) AS o) GROUP BY rid),
dup AS (SELECT rid, count(*) - count(DISTINCT l) AS n FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM raw)
  WHERE regexp_matches(l, '{spaces}') GROUP BY rid),
v AS (SELECT c.*, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
  coalesce(CASE WHEN n_chars >= {rules.guard_chars} THEN jc.d END, 0) AS dc, coalesce(CASE WHEN n_words >= {rules.guard_words} THEN jw.d END, 0) AS dw
  FROM c LEFT JOIN rep USING (rid) LEFT JOIN dup USING (rid)
  LEFT JOIN js jc ON jc.rid = c.rid AND jc.kind = 'c' LEFT JOIN js jw ON jw.rid = c.rid AND jw.kind = 'w'),
f AS (SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_pct} * n_words AS base_failed FROM v)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND dc <= {rules.max_class_distance} AND dw <= {rules.max_word_distance} AS kept FROM f"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), rows=False).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
