"""Personal data by weak supervision, in column functions only.

Base patterns find e-mail addresses, IPs, payment cards and international phone numbers; a wider
set of patterns proposes more (obfuscated addresses, national phone numbers, social security numbers,
IBANs). Every proposal gets votes (yes, no, none) from five labelers: format, gazetteer, context,
isolation and shape. Expectation-maximisation over the counts of vote patterns estimates how reliable each
labeler is and how likely each pattern is personal data; these posteriors train a logistic span
classifier, whose weights become column expressions. Base spans always stay; proposals are added where
the classifier says so and they overlap no base span.

The vote patterns are a small closed set (six kinds, three votes of five labelers, eight shapes), so what the
driver gathers has a fixed bound. Texts are read once; candidates travel in the row, so nothing is
joined or shuffled.

Defined results: a null or empty text has no spans; rows are judged one by one, so repeated rows and
null ids keep their row; empty tables give empty results; other columns play no part. The work grows with a text's
length and the power 4/3 of its matches, and memory with its length, so one text of a million numbers takes seconds.
Overlapping spans of several kinds are all reported; `mask` writes the kind of the one that starts first.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swingtrace.llm.common import stored, table

#: Base patterns. Possessive and look-behind forms of the plain patterns: same matches, no backtracking.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDER = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}\x20?[\[({]at[\])}]\x20?[a-z0-9-]{1,63}"
    r"(?:\x20?(?:[\[({]dot[\])}]|\.)\x20?[a-z0-9-]{1,63}){1,4}",
    "phone": r"(?<![0-9+().-])(?<![0-9][\x20./-])(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[\x20./-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![\x20.-]?[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,4})?(?![A-Za-z0-9])",
}
KINDS = ("email", "ip", "card", "phone", "ssn", "iban")
#: Top-level domains, calling codes and IBAN countries of the gazetteer.
DOMAINS = ["at", "be", "biz", "ca", "ch", "co", "com", "de", "edu", "es", "eu", "fr", "gov", "info", "io", "it", "mx",
           "net", "nl", "org", "uk", "us"]
CALLING = ["1", "31", "32", "33", "34", "39", "41", "43", "44", "49", "52"]
COUNTRIES = ["AT", "BE", "CH", "DE", "ES", "FR", "GB", "IT", "LU", "NL", "PT"]
#: Words before a span that speak for or against personal data.
CUES = r"(?i)\b(?:e-?mail|mail|correo|courriel|contact|kontakt|contacto|tel|phone|call|fax|mobile|telefon|teléfono|" \
    r"téléphone|card|visa|karte|carte|tarjeta|ssn|social|iban|konto|account|ip|host|address|adresse)\b"  # fmt: skip
AGAINST = r"(?i)\b(?:version|isbn|issn|page|section|figure|table|release|build|invoice|order|serial)\b[^A-Za-z]*$"
LABELERS = ("format", "gazetteer", "context", "isolation", "shape")
SPAN = "array<struct<kind:string,start:int,stop:int,m:string>>"
#: After every place in a text.
LATE = 2**31 - 1
#: Code points in a piece of a text; what is read around a span comes from its pieces, not from the start of the text.
PIECE = 1024


def _let(value: Column, use) -> Column:
    """use(value) with the value computed once, however often and however deep in lambdas it is read."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(values: Column, op, zero: int) -> Column:
    """For each of some integers, `op` over all before it, `zero` for the first; `op` is a sum, maximum or minimum.

    What an aggregate carries is copied at each step, so it runs within blocks of about the cube root of the number of
    values, then over the blocks' totals: copies grow with the power 4/3 of the number, not with its square.
    """
    start = F.struct(F.lit(zero).alias("at"), F.array().cast("array<int>").alias("out"))

    def plain(some: Column) -> Column:
        return F.aggregate(
            some, start, lambda s, x: F.struct(op(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
        )

    def blocks(all_: Column) -> Column:
        width = F.greatest(F.lit(8), F.cbrt(F.size(all_)).cast("int"))
        starts = F.when(F.size(all_) > 0, F.sequence(F.lit(1), F.size(all_), width)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: plain(F.slice(all_, i, width)))

    def whole(parts: Column) -> Column:
        before = plain(F.transform(parts, lambda b: b["at"]))["out"]
        return F.flatten(F.zip_with(parts, before, lambda b, o: F.transform(b["out"], lambda x: op(o, x))))

    return _let(_let(values, blocks), whole)


def _largest(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _spans(kind: str, found: Column, gaps: Column) -> Column:
    """Spans from a pattern's matches and the gaps between them."""
    steps = F.zip_with(
        found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.struct(F.length(g).alias("g"), F.length(m).alias("n"), m.alias("m"))
    )

    def placed(x: Column, at: Column) -> Column:
        start = at + x["g"]
        return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + x["n"]).alias("stop"), x["m"].alias("m"))

    def counted(all_: Column) -> Column:
        return F.zip_with(all_, _running(F.transform(all_, lambda x: x["g"] + x["n"]), lambda a, b: a + b, 0), placed)

    return F.when(F.size(found) > 0, _let(steps, counted)).otherwise(F.array()).cast(SPAN)


def _cut(pieces: Column, start: Column, stop: Column) -> Column:
    """The text from start to stop out of its pieces, touching only the pieces it lies in."""
    first = F.floor(start / PIECE).cast("int")
    n = F.floor(F.greatest(stop - 1, start) / PIECE).cast("int") - first + 1
    return F.substr(F.array_join(F.slice(pieces, first + 1, n), ""), start - first * PIECE + 1, F.greatest(stop - start, F.lit(0)))


def _apart(spans: Column, base: Column) -> Column:
    """The spans that overlap none of `base`: in order of start, none of those before ends later than it starts
    and the next of those behind starts no earlier than it ends."""
    fields = ("start", "stop", "b", "kind", "m")
    tagged = lambda a, b: F.transform(
        a, lambda x: F.struct(*((F.lit(b) if f == "b" else x[f]).alias(f) for f in fields)))

    def kept(both: Column) -> Column:
        end = F.transform(both, lambda x: F.when(x["b"] == 0, x["stop"]).otherwise(0))
        start = F.transform(F.reverse(both), lambda x: F.when(x["b"] == 0, x["start"]).otherwise(LATE))
        near = F.zip_with(
            _running(end, _largest, 0), F.reverse(_running(start, lambda a, b: F.least(a, b), LATE)),
            lambda far, next_: F.struct(far.alias("far"), next_.alias("next")),
        )
        return F.filter(
            F.zip_with(both, near, lambda x, n: F.when((x["b"] == 1) & (x["start"] >= n["far"]) & (x["stop"] <= n["next"]), x)),
            lambda x: x.isNotNull(),
        )

    free = _let(F.array_sort(F.concat(tagged(base, 0), tagged(spans, 1))), kept)
    bare = F.transform(free, lambda x: F.struct(*(x[f].alias(f) for f in ("kind", "start", "stop", "m"))))
    return F.when((F.size(spans) == 0) | (F.size(base) == 0), spans).otherwise(bare)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _valid(kind: str, m: Column) -> Column:
    """Whether a base match counts."""
    if kind == "ip":
        return F.forall(F.split(m, "[.]"), lambda x: x.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))
    if kind == "card":
        return F.length(_digits(m)).between(13, 19) & F.call_function("luhn_check", _digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _gates(text: Column) -> dict[str, Column]:
    """Cheap tests that a text can match at all."""
    number = text.rlike("[0-9]")
    return {
        "email": F.contains(text, F.lit("@")), "ip": number, "card": number, "phone": F.contains(text, F.lit("+")),
        "wide_email": text.rlike(r"(?i)[\[({]at[\])}]"), "wide_phone": number, "wide_ssn": number, "wide_iban": number,
    }


def _vote(yes: Column, no: Column) -> Column:
    """1 for yes, 0 for no, -1 for none."""
    return F.when(yes, 1).when(no, 0).otherwise(-1)


def _judged(span: Column, pieces: Column, base: Column) -> Column:
    """The span with the votes of all labelers and its shape."""
    kind, m = span["kind"], span["m"]
    before = _cut(pieces, F.greatest(F.lit(0), span["start"] - 40), span["start"])
    left = F.right(before, F.lit(1))
    right = _cut(pieces, span["stop"], span["stop"] + 1)
    digits = _digits(m)
    last = F.lower(F.regexp_extract(m, r"([A-Za-z]+)[^A-Za-z]*$", 1))
    gazetteer = (
        F.when(kind == "email", _vote(last.isin(*DOMAINS), ~last.isin(*DOMAINS)))
        .when((kind == "phone") & m.startswith("+"), _vote(m.rlike(rf"^\+(?:{'|'.join(CALLING)})"), F.lit(False)))
        .when(kind == "iban", _vote(F.substr(m, F.lit(1), F.lit(2)).isin(*COUNTRIES), ~F.substr(m, F.lit(1), F.lit(2)).isin(*COUNTRIES)))
        .otherwise(-1)
    )
    shape = (
        F.when(kind == "card", _vote(m.rlike(r"^(?:[0-9]{15,16}|[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4})$"), F.length(digits) < 13))
        .when(kind == "phone", _vote(F.length(digits).between(10, 13), F.length(digits) < 9))
        .when(kind == "ssn", _vote(~m.rlike("^(?:000|666|9)|-00-|-0000$"), m.rlike("^(?:000|666|9)|-00-|-0000$")))
        .when(kind == "ip", _vote(~m.rlike(r"^(?:0|255)\."), m.rlike(r"^0+\.0+\.")))
        .when(kind == "iban", _vote(F.length(F.regexp_replace(m, " ", "")).between(15, 32), F.length(m) < 15))
        .otherwise(_vote(F.length(m) >= 8, F.length(m) < 6))
    )
    return F.struct(
        kind.alias("kind"), span["start"].alias("start"), span["stop"].alias("stop"),
        F.when(base, 1).when(kind.isin("ip", "card"), 0).otherwise(-1).alias("format"),
        gazetteer.alias("gazetteer"),
        _vote(before.rlike(CUES), before.rlike(AGAINST)).alias("context"),
        _vote(F.lit(False), left.rlike("[A-Za-z0-9_]") | right.rlike("[A-Za-z0-9_]")).alias("isolation"),
        shape.alias("shape"),
        F.least(F.lit(3), F.floor(F.length(m) / 8).cast("int")).alias("size"),
        m.rlike(r"[\x20().-]").cast("int").alias("spaced"),
    )


def candidates(docs: DataFrame, *, text: str = "text", rows: bool = True) -> DataFrame:
    """Per row: `row` (docs' columns, without rows all but the text), `base` (valid spans) and `judged` (all proposals with votes)."""
    d = docs.select(
        F.struct(*(docs[f"`{c}`"] for c in docs.columns if rows or c != text)).alias("row"), F.coalesce(docs[text], F.lit("")).alias("text")
    )
    gates = _gates(F.col("text"))
    patterns = {**BASE, **{f"wide_{k}": p for k, p in WIDER.items()}}
    none = F.array().cast("array<string>")
    found = {f"m_{k}": F.when(gates[k], F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(none) for k, p in patterns.items()}
    d = d.withColumns(found)
    d = d.withColumns({f"g_{k}": F.when(F.size(f"m_{k}") > 0, F.split("text", p, -1)).otherwise(none) for k, p in patterns.items()})
    d = d.withColumns({f"s_{k}": _spans(k.removeprefix("wide_"), F.col(f"m_{k}"), F.col(f"g_{k}")) for k in patterns})
    d = d.withColumns({f"v_{k}": _only(k, F.col(f"s_{k}"), True) for k in BASE})
    d = d.withColumn("base", F.concat(*(F.col(f"v_{k}") for k in BASE)))
    failed = F.concat(*(_only(k, F.col(f"s_{k}"), False) for k in ("ip", "card")))
    failed = F.filter(failed, lambda x: F.length(x["m"]) >= 7)
    d = d.withColumn("wider", F.concat(*(F.col(f"s_wide_{k}") for k in WIDER)))
    pieces = F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))
    d = d.select("row", "base", F.concat(failed, _apart(F.col("wider"), F.col("base"))).alias("other"), pieces.alias("pieces"))
    t = F.col("pieces")
    return d.select(
        "row",
        F.transform("base", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"))).alias("base"),
        F.concat(
            F.transform("base", lambda x: _judged(x, t, F.lit(True))), F.transform("other", lambda x: _judged(x, t, F.lit(False)))
        ).alias("judged"),
    )


def _only(kind: str, spans: Column, valid: bool) -> Column:
    return F.filter(spans, lambda x: _valid(kind, x["m"]) == F.lit(valid))


def estimate(patterns: list[tuple], rounds: int = 50) -> tuple[np.ndarray, dict]:
    """EM over (kind, votes..., size, spaced, count): each pattern's posterior, and each labeler's reliabilities.

    Votes are independent given the truth; each labeler has one distribution over yes, no and none for
    personal data and one for the rest, each kind its own prior.
    """
    n = len(LABELERS)
    kinds = np.array([KINDS.index(p[0]) for p in patterns])
    votes = np.array([[v + 1 for v in p[1 : 1 + n]] for p in patterns])  # none 0, no 1, yes 2
    count = np.array([p[-1] for p in patterns], float)
    yes, no = (votes == 2).sum(axis=1), (votes == 1).sum(axis=1)
    post = np.clip((1.0 + 2 * yes) / (2.0 + 2 * yes + 2 * no), 0.05, 0.95)
    table_of = np.zeros((2, n, 3))
    for _ in range(rounds):
        weight = np.stack([count * (1 - post), count * post])
        prior = (np.bincount(kinds, weight[1], len(KINDS)) + 1) / (np.bincount(kinds, count, len(KINDS)) + 2)
        for y in (0, 1):
            for j in range(n):
                seen = np.bincount(votes[:, j], weight[y], 3) + [1.0, 1.0 + (y == 0), 1.0 + (y == 1)]
                table_of[y, j] = seen / seen.sum()
        like = np.stack([np.log(table_of[y, np.arange(n), votes]).sum(axis=1) for y in (0, 1)])
        odds = np.log(prior / (1 - prior))[kinds] + like[1] - like[0]
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return post, {name: table_of[:, j].round(4).tolist() for j, name in enumerate(LABELERS)}


def _encoded(p: tuple) -> list[float]:
    n = len(LABELERS)
    votes = p[1 : 1 + n]
    return [
        1.0, *(float(p[0] == k) for k in KINDS), *(float(v == 1) for v in votes), *(float(v == 0) for v in votes),
        *(float(p[1 + n] == s) for s in range(4)), float(p[2 + n]),
    ]


def train(patterns: list[tuple], steps: int = 400, rate: float = 0.5, decay: float = 1e-3) -> list[float]:
    """Weights of a logistic classifier fitted to the posteriors, patterns weighted by the root of their counts."""
    if not patterns:
        return []
    post, _ = estimate(patterns)
    x = np.array([_encoded(p) for p in patterns])
    weight = np.sqrt(np.array([p[-1] for p in patterns], float))
    weight /= weight.sum()
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        got = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= rate * (x.T @ (weight * (got - post)) + decay * w)
    return w.tolist()


def _score(x: Column, w: list[float]) -> Column:
    n, k = len(LABELERS), len(KINDS)
    total = F.lit(w[0])
    for i, kind in enumerate(KINDS):
        total = total + F.when(x["kind"] == kind, w[1 + i]).otherwise(0.0)
    for j, name in enumerate(LABELERS):
        total = total + F.when(x[name] == 1, w[1 + k + j]).when(x[name] == 0, w[1 + k + n + j]).otherwise(0.0)
    for s in range(4):
        total = total + F.when(x["size"] == s, w[1 + k + 2 * n + s]).otherwise(0.0)
    return total + x["spaced"] * w[-1]


def spans(docs: DataFrame, *, text: str = "text", rows: bool = True) -> DataFrame:
    """Per row: row, base and spans (base and accepted proposals, by kind then start).

    Without the texts the candidates are stored. With them they are found twice instead, so that no copy of the texts is stored.
    """
    found = candidates(docs, text=text, rows=rows)
    if not rows:
        found = stored(found, "private-candidates")
    fields = ("kind", *LABELERS, "size", "spaced")
    counted = found.select(F.explode("judged").alias("x")).groupBy(*(F.col(f"x.{f}").alias(f) for f in fields)).count()
    w = train(sorted(tuple(r) for r in counted.collect()))  # at most 6 * 3^5 * 8 rows
    plain = lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"))
    more = F.filter("judged", lambda x: (x["format"] == -1) & (_score(x, w) > 0)) if w else F.filter("judged", lambda x: F.lit(False))
    ranked = lambda a: F.transform(
        F.array_sort(F.transform(a, lambda x: F.struct(
            F.array_position(F.array(*map(F.lit, KINDS)), x["kind"]).alias("o"), x["start"].alias("start"), x["stop"].alias("stop"), x["kind"].alias("kind")
        ))), plain)
    return found.select("row", ranked(F.col("base")).alias("base"), ranked(F.concat("base", F.transform(more, plain))).alias("spans"))


def listed(spans_of: Column) -> Column:
    return F.array_join(F.transform(spans_of, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def mask(docs: DataFrame, *, text: str = "text", length: str | None = None) -> DataFrame:
    """docs with every span of personal data replaced by its kind in brackets; `length` names a column to set to the new length."""
    found = spans(docs, text=text)
    found = found.select(
        "row", "spans", F.regexp_extract_all(F.col(f"row.`{text}`"), F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0)).alias("pieces")
    )
    t = F.col(f"row.`{text}`")
    by_start = F.array_sort(F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["kind"].alias("kind"))))
    marks = _let(by_start, lambda all_: F.zip_with(
        all_, _running(F.transform(all_, lambda x: x["stop"]), _largest, 0),
        lambda x, at: F.struct(at.alias("at"), x["start"].alias("start"), x["kind"].alias("kind")),
    ))
    marks = F.filter(marks, lambda x: x["start"] >= x["at"])  # others overlap what is masked already
    parts = F.transform(marks, lambda x: F.concat(_cut(F.col("pieces"), x["at"], x["start"]), F.lit("["), x["kind"], F.lit("]")))
    end = F.array_max(F.transform("spans", lambda x: x["stop"]))
    rest = F.substr(t, end + 1, F.length(t))
    masked = F.when(F.size("spans") > 0, F.concat(F.array_join(parts, ""), rest)).otherwise(t)
    out = found.select("row", masked.alias("masked"))
    value = {text: F.col("masked"), **({length: F.length("masked")} if length in docs.columns else {})}
    return out.select(*((value[c].cast(docs.schema[c].dataType) if c in value else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans(table(spark, sf_dir, "documents"), rows=False)
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "row.doc_id", *(count(k) for k in BASE), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )
