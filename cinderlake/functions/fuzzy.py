"""Fuzzy ratios on 0 to 100, in Arrow batches.

``ratio`` is the indel similarity 100 * 2 * LCS / (m + n), rounded half to even; ``token_sort_ratio`` compares the
sorted words of alphanumerics; ``partial_ratio`` is the best ratio of the shorter text with any part of the
longer one of its length, parts cut off at the edges included. Two empty texts have 0.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = re.compile(r"[\W_]+")


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence by bit vectors."""
    where: dict = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    return (full & ~row).bit_count()


def ratio(a: str, b: str) -> int:
    return round(200 * lcs(a, b) / (len(a) + len(b))) if a and b else 0


def sorted_words(s: str) -> str:
    return " ".join(sorted(_SPLIT.sub(" ", s.lower()).split()))


def token_sort_ratio(a: str, b: str) -> int:
    return ratio(sorted_words(a), sorted_words(b))


def partial_ratio(a: str, b: str) -> int:
    short, long = sorted((a, b), key=len)
    if not short:
        return 0
    m, n = len(short), len(long)
    parts = {long[max(0, i) : min(n, i + m)] for i in range(1 - m, n)}
    return max(ratio(short, p) for p in parts)


def match_label(name: str, domain: str | None, keywords: list, v_name: str | None, v_domain: str | None, threshold: int) -> str | None:
    """What a watch entry and a victim match by, stated for one pair: domain, else name, else the first keyword."""
    v_name, v_domain = (v_name or "").lower().strip(), (v_domain or "").lower().strip()
    named = len(name) >= 3 and len(v_name) >= 3
    scores = [("domain", ratio(domain, v_domain))] if domain and min(len(domain), len(v_domain)) >= 3 else []
    scores += [("name", token_sort_ratio(name, v_name))] * named + [("keyword", partial_ratio(k, v_name)) for k in keywords if named and len(k) >= 3]
    return next((f"fuzzy_{kind}:{s}" for kind, s in scores if s >= threshold), None)


def text_column(kind: str, text: Column) -> Column:
    """``tidy`` (lower case, no blanks around) or ``sorted_words`` of a column; null stays null."""
    function = {"tidy": lambda t: t.lower().strip(), "sorted_words": sorted_words}[kind]

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(function, na_action="ignore")

    return F.pandas_udf(run, "string")(text)


def ratio_column(kind: str, a: Column, b: Column) -> Column:
    """``ratio``, ``token_sort_ratio`` or ``partial_ratio`` of two columns; null if one is null."""
    function = {"ratio": ratio, "token_sort_ratio": token_sort_ratio, "partial_ratio": partial_ratio}[kind]

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else function(p, q) for p, q in zip(x, y)], dtype="Int32")

    return F.pandas_udf(run, "int")(a, b)
