"""Column helpers shared by all operators: Unicode-aware patterns, trimming, slugs, hashes, vector similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Java patterns: Unix line ends and Unicode classes; the second also ignores case beyond ASCII.
EXACT, ANYCASE = "(?dU)", "(?diuU)"


#: Fixed value: what Unicode calls white space, which \s is under EXACT.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def bound(value: Column, f) -> Column:
    """f of value, which is evaluated once however often f names it: value is what an aggregate of nothing begins with. Nothing is copied, unlike by transform."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda a, _: a, f)


def contains_any(c: Column, words: tuple[str, ...] | list[str]) -> Column:
    """Whether c holds one of the words as a substring."""
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def slug(c: Column | str) -> Column:
    """Lower case, runs of other characters than letters and digits as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(strip(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def content_hash(c: Column | str, trimmed: bool = True) -> Column:
    """SHA-256 of the text, by default without white space at the ends."""
    return F.sha2(strip(c) if trimmed else F.col(c) if isinstance(c, str) else c, 256)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two arrays over their common length; 0 where a norm is 0."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    n = F.least(F.size(a), F.size(b))
    dot = F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm(a) * norm(b) == 0, 0.0).otherwise(dot / (norm(a) * norm(b)))


def optional_equal(df: DataFrame, **wanted: object) -> DataFrame:
    """Rows equal to every given value; a value of None asks for nothing."""
    for name, value in wanted.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def parity_any(df: DataFrame, **wanted: object) -> DataFrame:
    """Rows equal to any of the values, where None matches every row (the surprising rule, kept for comparison)."""
    keep = F.lit(False)
    for name, value in wanted.items():
        keep = keep | (F.lit(True) if value is None else F.col(name) == value)
    return df.where(keep)
