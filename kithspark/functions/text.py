"""Folding, tokenising and fuzzy ratios of strings, as Columns."""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@cache
def _accent_table() -> tuple[str, str]:
    """Every character below U+2000 whose compatibility decomposition is one base character and marks, and that base."""
    pairs = []
    for c in map(chr, range(0xA0, 0x2000)):
        bare = "".join(x for x in unicodedata.normalize("NFKD", c) if unicodedata.category(x) != "Mn")
        if len(bare) == 1 and bare != c:
            pairs.append((c, bare))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


@F.pandas_udf(T.StringType())
def nfkd(s: pd.Series) -> pd.Series:
    """Unicode NFKD of each string, in Arrow batches."""
    return s.str.normalize("NFKD")


def fold(text: Column, exact: bool = False) -> Column:
    """Lower case without accents.

    The default stays in the JVM: one translate over precomposed characters, then marks go. It equals NFKD folding but
    for characters that decompose to several letters (ligatures, fractions); exact=True runs NFKD in Arrow batches.
    """
    bare = nfkd(text) if exact else F.translate(text, *_accent_table())
    return F.lower(F.regexp_replace(bare, r"\p{Mn}", ""))


def all_matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match; null where nothing matches."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def digest(text: Column) -> Column:
    """60 bits of the MD5 of a text as a number: the same on every engine."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")


def bucket(value: Column, seed: int, k: int) -> Column:
    """One of k classes, by an MD5 of value and seed: the same on every engine. Null is in class 0."""
    digits = F.substring(F.md5(F.concat(value.cast("string"), F.lit(f"/{seed}")).cast("binary")), 1, 8)
    return F.coalesce(F.pmod(F.conv(digits, 16, 10).cast("bigint"), F.lit(k)), F.lit(0)).cast("int")


def sorted_key(tokens: Column) -> Column:
    return F.array_join(F.sort_array(tokens), " ")


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of bits a character of b."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        m = row & places.get(c, 0)
        row = (row + m | row - m) & full
    return len(a) - row.bit_count()


def indel(a: str | None, b: str | None) -> float | None:
    if a is None or b is None:
        return None
    return 200.0 * _lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_set(a: str | None, b: str | None) -> float | None:
    if a is None or b is None:
        return None
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_a, only_b = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and (not only_a or not only_b):
        return 100.0
    with_a, with_b = (f"{both} {s}".strip() for s in (only_a, only_b))
    best = indel(with_a, with_b)
    return max(best, indel(both, with_a), indel(both, with_b)) if both else best


def _of_distinct(f, a: pd.Series, b: pd.Series) -> pd.Series:
    """f of each pair of strings; a batch's equal pairs are worked out once."""
    pairs = pd.MultiIndex.from_arrays([a.astype(object), b.astype(object)])
    codes, different = pairs.factorize()
    values = pd.Series([f(None if pd.isna(x) else x, None if pd.isna(y) else y) for x, y in different], dtype="float64")
    return pd.Series(values.to_numpy()[codes], dtype="float64")


@F.pandas_udf(T.DoubleType())
def _indel(a: pd.Series, b: pd.Series) -> pd.Series:
    return _of_distinct(indel, a, b)


@F.pandas_udf(T.DoubleType())
def _token_set(a: pd.Series, b: pd.Series) -> pd.Series:
    return _of_distinct(token_set, a, b)


def indel_ratio(a: Column, b: Column) -> Column:
    """200 * longest common subsequence / total length; 100 for equal strings, which Python doesn't see."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    equal = a == b
    return F.when(equal, 100.0).otherwise(_indel(F.when(~equal, a), F.when(~equal, b)))


def token_set_ratio(a: Column, b: Column) -> Column:
    """The best indel ratio among shared tokens, and shared with either side's own; 0 where a side is empty. Equal strings
    with a token are 100, which Python doesn't see."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    equal = a == b
    return F.when(equal, F.when(a.rlike(r"\S"), 100.0).otherwise(0.0)).otherwise(_token_set(F.when(~equal, a), F.when(~equal, b)))


def char_grams(text: Column, k: int, longest: int) -> Column:
    """Full-length k-grams of the first `longest` characters."""
    cut = F.substring(text, 1, longest)
    n = F.length(cut) - (k - 1)
    return F.when(n >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(cut, i, F.lit(k))))).otherwise(F.array().cast("array<string>"))
