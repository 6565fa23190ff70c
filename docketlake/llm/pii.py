"""Personal data by weak supervision (operator 4).

Four kinds are found by fixed patterns: e-mail and IP addresses, card and phone numbers.  Further
spans come from weak labelers.  Candidates are long tokens with a digit; regular expressions, a
gazetteer of credential words and the text around a candidate each vote or abstain.  The corpus is
summed up to counts of vote and feature patterns (a table of bounded size, whatever the input),
from which expectation-maximisation estimates how reliable each labeler is.  Its posteriors train
the final span classifier, a logistic regression over the features of a span.

DataFrame functions only; positions follow from the lengths of the pieces between matches.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bind
from .common import texts

# The base patterns, in the order of their kinds.  Possessive loops and the condition
# that a match starts where a run of its characters starts (or the last match ended) leave the
# matches as they are and keep long runs linear.
KINDS = ["email", "ip", "card", "phone"]
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Texts without a match of the gate have no valid span of the kind.
GATES = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
ADDED_KIND = "secret"
CANDIDATE = r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{12,}+"
GAZETTEER = ["token", "password", "passwd", "pwd", "secret", "apikey", "api_key", "access_key", "auth", "bearer", "credential", "passport", "iban", "ssn"]
#: Characters before a candidate that context labelers see.
CONTEXT = 24
#: Elements that one plain running sum handles.
_BLOCK = 256

_SPAN = "struct<start:int,rank:int,end:int,kind:string>"
_FOUND = "array<struct<start:int,end:int,value:string,before:string,after:string>>"


def _plain_runs(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    start = F.array().cast("array<int>")
    return F.aggregate(values, start, lambda acc, x: F.concat(acc, F.array(step(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)), x))))


def running(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Fold of each element and all before it, from zero; block by block, so that long arrays aren't copied for each element."""
    def joined(parts: Column) -> Column:
        tops = F.concat(F.array(F.lit(0)), _plain_runs(F.transform(parts, lambda p: F.try_element_at(p, F.lit(-1))), step))
        return bind(tops, lambda t: F.flatten(F.transform(parts, lambda p, i: F.transform(p, lambda x: step(F.get(t, i), x)))))

    def blocks(v: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(v), F.lit(_BLOCK)), lambda s: s < F.size(v))
        return F.transform(starts, lambda s: _plain_runs(F.slice(v, s + 1, _BLOCK), step))

    return bind(values, lambda v: bind(blocks(v), joined))


def running_sums(values: Column) -> Column:
    """Sums up to and including each element."""
    return running(values, lambda a, b: a + b)


def located(text: Column, pattern: str, gate: Column) -> Column:
    """Leftmost matches that don't overlap, with positions in code points (end exclusive) and the text around them."""
    def build(p: Column) -> Column:
        gaps, found = p["gaps"], p["found"]
        ends = running_sums(F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.length(g) + F.length(m)))
        return bind(ends, lambda e: F.transform(found, lambda m, i: F.struct(
            (F.get(e, i) - F.length(m)).alias("start"), F.get(e, i).alias("end"), m.alias("value"),
            F.right(F.get(gaps, i), F.lit(CONTEXT)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(1)).alias("after"))))

    both = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    return F.when(gate, bind(both, build).cast(_FOUND)).otherwise(F.array().cast(_FOUND))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def passes_luhn(digits: Column) -> Column:
    def weight(s: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return s + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), weight) % 10 == 0


VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.forall(F.split(v, r"\."), lambda x: F.length(F.ltrim(x, F.lit("0"))) <= 3) & F.forall(F.split(v, r"\."), lambda x: F.right(x, F.lit(4)).cast("int") <= 255),
    "card": lambda v: bind(_digits(v), lambda d: F.when(F.length(d).between(14, 19), passes_luhn(d)).otherwise(False)),
    "phone": lambda v: F.length(_digits(v)).between(10, 15),
}


def base_spans(text: Column, kind: str) -> Column:
    found = located(text, PATTERNS[kind], text.rlike(GATES[kind]))
    valid = F.filter(found, lambda s: VALID[kind](s["value"]))
    return F.transform(valid, lambda s: F.struct(s["start"], F.lit(KINDS.index(kind)).alias("rank"), s["end"], F.lit(kind).alias("kind"))).cast(f"array<{_SPAN}>")


def candidates(text: Column) -> Column:
    return located(text, CANDIDATE, text.rlike("[0-9]"))


_ASSIGNED = r"[=:]\s*[\"']?$"


def votes(value: Column, before: Column) -> dict[str, tuple[Column, int]]:
    """Per labeler: whether it votes, and for what (1: personal or secret, 0: not)."""
    return {
        "regex_access_key": (value.rlike(r"^[A-Z]{4}(?=[0-9A-Z]*[0-9])[0-9A-Z]{16}$"), 1),
        "regex_hex": (value.rlike(r"^(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{16,}$"), 1),
        "regex_number": (value.rlike(r"^[0-9+/_-]+$"), 0),
        "gazetteer": (F.lower(before).rlike("|".join(GAZETTEER)), 1),
        "context_assigned": (before.rlike(_ASSIGNED), 1),
        "context_prose": (before.rlike(r"[\p{L},.]\s$") & ~value.rlike("^[0-9A-Z]+$"), 0),
        "shape_word": (value.rlike(r"\p{L}{9,}") & ~value.rlike("^[0-9a-f]+$") & ~value.rlike("^[0-9A-Z]+$"), 0),
    }


def features(value: Column, before: Column, after: Column) -> dict[str, tuple[Column, int]]:
    """Per feature of the classifier: its value, and how many values it has."""
    n, share = F.length(value), F.length(_digits(value)) / F.length(value)
    return {
        "shape": (F.when(value.rlike("^[0-9]+$"), 0).when(value.rlike("^[0-9a-f]+$"), 1).when(value.rlike("^[0-9A-Z]+$"), 2).when(value.rlike("^[0-9a-z]+$"), 3).otherwise(4), 5),
        "size": (F.when(n < 16, 0).when(n < 20, 1).when(n < 32, 2).otherwise(3), 4),
        "digits": (F.when(share < 0.1, 0).when(share < 0.25, 1).when(share < 0.5, 2).when(share < 0.75, 3).otherwise(4), 5),
        "before": (F.when(before.rlike(_ASSIGNED), 2).when(before.rlike(r"[\p{L},.]\s$"), 1).otherwise(0), 3),
        "after": (F.when(after.rlike("[\"']"), 1).otherwise(0), 2),
    }


@dataclass
class SpanModel:
    """Reliability of each labeler (how often it votes on either class) and the classifier's weights."""

    reliability: dict[str, tuple[float, float]]
    bias: float
    weights: dict[str, list[float]]

    def accepts(self, c: Column) -> Column:
        logit = F.lit(self.bias)
        for name, (value, _) in features(c["value"], c["before"], c["after"]).items():
            logit = logit + F.get(F.array(*map(F.lit, self.weights[name])), value)
        return logit >= 0


def estimate(rows: list[tuple[tuple[int, ...], tuple[int, ...], int]], labelers: list[tuple[str, int]], rounds: int = 60) -> tuple[list[float], dict[str, tuple[float, float]]]:
    """Posterior of each (votes, features, count) row, and per labeler the share of other and of personal spans it votes on."""
    means = [1 if v else -1 for _, v in labelers]
    post = [{1: 0.9, 0: 0.3, -1: 0.1}[(s > 0) - (s < 0)] for s in (sum(m for m, f in zip(means, r[0], strict=True) if f) for r in rows)]
    rates: list[tuple[float, float]] = []
    for _ in range(rounds):
        mass = sum(p * r[2] for p, r in zip(post, rows, strict=True))
        rest = sum(r[2] for r in rows) - mass
        prior = (mass + 1) / (mass + rest + 2)
        rates = []
        for j in range(len(labelers)):
            on = sum(p * r[2] for p, r in zip(post, rows, strict=True) if r[0][j])
            off = sum((1 - p) * r[2] for p, r in zip(post, rows, strict=True) if r[0][j])
            rates.append(((off + 0.5) / (rest + 1), (on + 0.5) / (mass + 1)))
        for i, r in enumerate(rows):
            odds = math.log(prior / (1 - prior))
            for (q0, q1), fired in zip(rates, r[0], strict=True):
                odds += math.log(q1 / q0) if fired else math.log((1 - q1) / (1 - q0))
            post[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return post, {name: rate for (name, _), rate in zip(labelers, rates, strict=True)}


def train(rows: list[tuple[tuple[int, ...], tuple[int, ...], int]], post: list[float], sizes: list[int], rounds: int = 300) -> tuple[float, list[list[float]]]:
    """Logistic regression on the posteriors: gradient steps over the counted feature patterns."""
    pattern: dict[tuple[int, ...], list[float]] = {}
    for (_, feats, n), p in zip(rows, post, strict=True):
        cell = pattern.setdefault(feats, [0.0, 0.0])
        cell[0] += n
        cell[1] += n * p
    total, bias, weights = sum(c[0] for c in pattern.values()), 0.0, [[0.0] * s for s in sizes]
    for _ in range(rounds):
        slope, slopes = 0.0, [[1e-3 * w for w in ws] for ws in weights]
        for feats, (n, hits) in pattern.items():
            z = bias + sum(ws[v] for ws, v in zip(weights, feats, strict=True))
            d = (n / (1 + math.exp(-max(-30.0, min(30.0, z)))) - hits) / total
            slope += d
            for g, v in zip(slopes, feats, strict=True):
                g[v] += d
        bias -= 2.0 * slope
        weights = [[w - 2.0 * g for w, g in zip(ws, gs, strict=True)] for ws, gs in zip(weights, slopes, strict=True)]
    return bias, weights


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> SpanModel | None:
    """Votes on all candidates of the corpus, counted by pattern; None when there is no candidate."""
    found = texts(docs, id_col, text_col).select(F.explode(candidates(F.col("text"))).alias("c")).select("c.*")
    voted, seen = votes(F.col("value"), F.col("before")), features(F.col("value"), F.col("before"), F.col("after"))
    counted = found.groupBy(*[v.alias(f"v_{k}") for k, (v, _) in voted.items()], *[v.alias(f"f_{k}") for k, (v, _) in seen.items()]).count().collect()
    if not counted:
        return None
    rows = sorted((tuple(int(r[f"v_{k}"]) for k in voted), tuple(r[f"f_{k}"] for k in seen), r["count"]) for r in counted)
    post, reliability = estimate(rows, [(k, v) for k, (_, v) in voted.items()])
    bias, weights = train(rows, post, [n for _, n in seen.values()])
    return SpanModel(reliability, bias, dict(zip(seen, weights, strict=True)))


def _with_spans(docs: DataFrame, text: Column, model: SpanModel | None) -> DataFrame:
    """Add _base and _spans: arrays of (start, rank, end, kind) in order of start, then kind."""
    per_kind = docs.select("*", *[base_spans(text, k).alias(f"_{k}") for k in KINDS])
    based = per_kind.withColumn("_base", F.array_sort(F.concat(*[f"_{k}" for k in KINDS])))
    if model is None:
        return based.withColumn("_spans", F.col("_base"))
    added = F.filter(candidates(text), lambda c: model.accepts(c) & ~F.exists("_base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    added = F.transform(added, lambda c: F.struct(c["start"], F.lit(len(KINDS)).alias("rank"), c["end"], F.lit(ADDED_KIND).alias("kind"))).cast(f"array<{_SPAN}>")
    return based.withColumn("_spans", F.array_sort(F.concat("_base", added)))


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    ``spans`` lists ``kind:start:end`` of the base kinds and of what the classifier adds (kind
    ``secret``; never over a base span).  A null or empty text has none.  Repeated rows get equal
    rows, rows without an id are read like others.  In a corpus without candidates nothing is
    added.  An empty table gives an empty result; other columns are ignored.
    """
    model = fit(docs, id_col, text_col)
    found = _with_spans(texts(docs, id_col, text_col), F.col("text"), model)
    return found.select("doc_id", *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS],
                        F.sha2(_joined("_base"), 256).alias("base_sha256"), _joined("_spans").alias("spans"))


def _joined_spans(found: DataFrame) -> DataFrame:
    """Add _joined: spans that overlap become one, which has the kind of the first.

    A span opens a new one where it starts at or after the largest end before it.
    """
    ends = running(F.transform("_spans", lambda s: s["end"]), F.greatest)
    opens = lambda s, i: (i == 0) | (F.get("_ends", i - 1) <= s["start"])
    first = F.filter(F.transform("_spans", lambda s, i: F.when(opens(s, i), i)), lambda i: i.isNotNull())

    def one(h: Column, j: Column) -> Column:
        last = F.coalesce(F.get("_first", j + 1), F.size("_spans")) - 1
        return F.struct(F.get("_spans", h)["start"].alias("start"), F.get("_ends", last).alias("end"), F.get("_spans", h)["kind"].alias("kind"))

    return found.withColumn("_ends", ends).withColumn("_first", first).withColumn("_joined", F.transform("_first", one))


def _rebuilt(text: Column) -> Column:
    """The text with each span of _joined replaced by its kind.

    A substring is found by counting characters from the beginning.  So the text is cut into
    about as many parts as a part has spans, and the spans are looked up in their part.
    """
    size = F.ceil(F.sqrt(F.size("_joined"))).cast("int")
    end = lambda i: F.coalesce(F.get("_joined", i - 1)["end"], F.lit(0))

    def part(k: Column) -> Column:
        base, spans = end(k * size), F.slice("_joined", k * size + 1, size)
        return F.struct(base.alias("base"), spans.alias("spans"), F.substring(text, base + 1, end(F.least((k + 1) * size, F.size("_joined"))) - base).alias("text"))

    def replaced(p: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            done = F.coalesce(F.get(p["spans"], i - 1)["end"], p["base"])
            return F.concat(F.substring(p["text"], done - p["base"] + 1, s["start"] - done), F.lit("<"), s["kind"], F.lit(">"))

        return F.array_join(F.transform(p["spans"], piece), "")

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("_joined") - 1) / size).cast("int")), part)
    return F.concat(F.array_join(F.transform(parts, replaced), ""), F.substring(text, end(F.size("_joined")) + 1, F.length(text)))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with each span replaced by its kind in angle brackets; overlapping spans become one."""
    model, text = fit(docs, id_col, text_col), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = docs.select(F.struct(*docs.columns).alias("_row"), text.alias("_text"))
    found = _joined_spans(_with_spans(own, F.col("_text"), model))
    new = F.when(F.size("_joined") > 0, _rebuilt(F.col("_text"))).otherwise(F.col("_row")[text_col])
    return found.select(*[(new if c == text_col else F.col("_row")[c]).alias(c) for c in docs.columns])
