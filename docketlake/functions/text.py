"""Column helpers for text, numbers and JSON.  All of them stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


#: White space as Python knows it, for character classes; Java's own ``\\s`` is ASCII only.
BLANKS = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A word: a run of anything else.  Ranges without a blank come first and a plain blank ends a word at once, because Java asks every
#: member of a class such as the one above for each character.
WORD = f"(?:[!-~\\xa1-\\u167f\\u3001-\\ud7ff]+|(?! )[^{BLANKS}])++"
_BLANK_CHARS = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(value: Column, fn) -> Column:
    """Evaluate ``value`` once and use it several times inside ``fn``.

    Inside lambdas Spark does not share common subexpressions; a one-element array does.
    """
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def strip(c: str | Column) -> Column:
    """Remove whitespace of any kind on both ends (plain ``trim`` removes blanks only)."""
    return F.trim(col(c), F.lit(_BLANK_CHARS))


def lead(c: str | Column) -> Column:
    """The text without whitespace at its beginning."""
    return F.ltrim(col(c), F.lit(_BLANK_CHARS))


def prefix_sums(values: Column) -> Column:
    """For each element of an int array the sum of those before it.

    In blocks of about the square root of their number, so that a long array takes neither a
    shuffle nor time with the square of its length.
    """
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    floor = lambda i, n: F.floor(i / n).cast("int")

    def summed(b: Column) -> Column:
        v, n = b["v"], b["n"]
        blocks = F.transform(F.sequence(F.lit(0), floor(F.size(v) - 1, n)), lambda k: total(F.slice(v, k * n + 1, n)))
        before = bind(blocks, lambda s: F.transform(s, lambda _, k: total(F.slice(s, F.lit(1), k))))
        return bind(before, lambda s: F.transform(v, lambda _, i: F.get(s, floor(i, n)) + total(F.slice(v, i - i % n + 1, i % n))))

    def blocked(v: Column) -> Column:
        size = F.greatest(F.ceil(F.sqrt(F.size(v))).cast("int"), F.lit(1))
        return F.when(F.size(v) > 0, bind(F.struct(v.alias("v"), size.alias("n")), summed)).otherwise(F.array().cast("array<int>"))

    return bind(values, blocked)


def squeeze(c: str | Column) -> Column:
    """Lower case, runs of whitespace become one blank, no blank on the ends."""
    return F.trim(F.regexp_replace(F.lower(col(c)), f"[{BLANKS}]+", " "))


def words(c: str | Column) -> Column:
    """Array of the whitespace separated words."""
    return F.regexp_extract_all(col(c), F.lit(WORD), F.lit(0))


def word_count(c: str | Column) -> Column:
    return F.regexp_count(col(c), F.lit(WORD)).cast("int")


def token_estimate(word_total: str | Column, factor: float = 1.33) -> Column:
    """Estimated model tokens of a text with that many words, at least one."""
    return F.greatest((col(word_total) * F.lit(factor)).cast("int"), F.lit(1))


def sentences(c: str | Column) -> Column:
    """Non-empty trimmed sentences; a sentence ends at whitespace after ``. ! ?``."""
    parts = F.split(col(c), f"(?<=[.!?])[{BLANKS}]+")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def contains_any(c: str | Column, needles: list[str] | tuple[str, ...]) -> Column:
    """True when any of the literal needles occurs in the text."""
    c = col(c)
    return reduce(lambda a, b: a | b, [c.contains(n) for n in needles])


def first_match(c: str | Column, table: list[tuple[str, list[str]]], otherwise: str) -> Column:
    """Label of the first row of ``table`` one of whose needles occurs in the text."""
    out = None
    for label, needles in table:
        cond = contains_any(c, needles)
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise(otherwise)


def first_regex(c: str | Column, table: list[tuple[str, str]], otherwise: str) -> Column:
    """Label of the first row of ``table`` whose pattern is found in the text."""
    out = None
    for label, pattern in table:
        cond = col(c).rlike(pattern)
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise(otherwise)


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def or_default(c: str | Column, default) -> Column:
    """The value unless it is null or the empty string."""
    return F.coalesce(F.nullif(col(c), F.lit("")), F.lit(default))


def ellipsis(c: str | Column, n: int) -> Column:
    """The first n characters, with dots when something was cut off."""
    c = col(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def title_case(c: str | Column) -> Column:
    return F.initcap(F.replace(col(c), F.lit("_"), F.lit(" ")))


def matches(c: str | Column, pattern: str, group: int = 1) -> Column:
    """Array of all values of one capture group."""
    return F.regexp_extract_all(col(c), F.lit(pattern), F.lit(group))


def dot(a: str | Column, b: str | Column) -> Column:
    """Dot product of two numeric arrays, in double."""
    prods = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0).cast("double"), lambda s, x: s + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: str | Column) -> Column:
    """The vector divided by its length; a zero vector becomes null."""
    n = norm(a)
    return F.when(n > 0, F.transform(col(a), lambda x: x.cast("double") / n))


def rounded(c: str | Column, digits: int = 0) -> Column:
    """Round half away from zero, after dropping the noise of the summation order.

    A distributed sum may differ in its last bits from run to run; without the first step a
    mean that ends in a five could fall on either side.
    """
    c = col(c)
    return F.round(F.round(c, 10), digits) if digits < 10 else F.round(c, digits)
