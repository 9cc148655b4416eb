"""Functions that Spark lacks, on Arrow batches."""

from __future__ import annotations

import difflib
import functools
import math
import re
import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType

from colloquy.functions.lexicons import ZERO_WIDTH


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else unicodedata.normalize("NFKC", t))


def normalize_text(c: Column) -> Column:
    """NFKC, without zero-width characters, lower case. Texts of ASCII alone never reach Python."""
    wide = F.when(c.rlike(r"[^\x00-\x7F]"), _nfkc(F.when(c.rlike(r"[^\x00-\x7F]"), c))).otherwise(c)
    return F.lower(F.regexp_replace(wide, ZERO_WIDTH, ""))


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching blocks' share of both texts (difflib)."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def similar(a: Column, b: Column, threshold: float) -> Column:
    """`sequence_ratio` of at least the threshold; pairs whose lengths rule it out never reach Python."""
    x, y = F.length(a), F.length(b)
    possible = 2 * F.least(x, y) >= threshold * (x + y)
    return F.coalesce(possible & (sequence_ratio(F.when(possible, a), F.when(possible, b)) >= threshold), F.lit(False))


def _grams(t: str) -> set[str]:
    return {t[i : i + n] for n in (2, 3) for i in range(len(t) - n + 1)}


def _dice(a: set, b: set) -> float:
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


class Alias:
    """An alias, and an index of where its 2- and 3-grams can stand in a text."""

    def __init__(self, alias: str):
        self.alias, self.grams, self.letters = alias, _grams(alias), Counter(alias)
        self.hit = {n: re.compile("(?=" + "|".join(map(re.escape, sorted(g for g in self.grams if len(g) == n))) + ")", re.S) for n in (2, 3)}

    def score_of(self, window: str) -> float:
        """Mix of letters, n-grams and matching blocks."""
        both = sum((self.letters & Counter(window)).values())
        f1 = 2 * both / (len(self.alias) + len(window))
        return 0.5 * f1 + 0.3 * _dice(self.grams, _grams(window)) + 0.2 * difflib.SequenceMatcher(None, self.alias, window).ratio()

    def bounds(self, text: str) -> list[tuple[float, int, int]]:
        """(bound, start, size) of windows whose score may be above zero, none of them above its bound.

        Matching blocks are letters that both have, so their share is at most that of the letters. A window has at most as many of the alias's grams as start
        in it and end in it; both counts of all windows of a size are differences of running sums.
        """
        n = len(text)
        starts = {size: [m.start() for m in hit.finditer(text)] for size, hit in self.hit.items()}
        if not starts[2]:
            return []
        sums = {size: np.cumsum(np.bincount(np.array(at, np.int64) + 1, minlength=n + 1)) for size, at in starts.items()}
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        counts = {c: np.concatenate(([0], np.cumsum(codes == ord(c)))) for c in self.letters}
        out = []
        for size in sorted({min(size, n) for size in range(max(1, len(self.alias) - 3), len(self.alias) + 4)}):
            lo = np.arange(n - size + 1)
            grams = sum(sums[k][np.maximum(lo + size - k + 1, lo)] - sums[k][lo] for k in (2, 3))
            near = np.flatnonzero(5 * grams >= len(self.grams))  # fewer grams than that can't make up for the rest
            if not len(near):
                continue
            letters = sum(np.minimum(c[near + size] - c[near], self.letters[x]) for x, c in counts.items())
            share = np.minimum(grams[near], len(self.grams))
            bound = 0.7 * 2 * letters / (len(self.alias) + size) + 0.3 * 2 * share / (len(self.grams) + share)
            out += [(b, at, size) for b, at in zip(bound.tolist(), near.tolist())]
        return out

    def score(self, text: str, least: float) -> float:
        if self.alias in text:
            return 1.0
        best = 0.0
        for bound, at, size in sorted((x for x in self.bounds(text) if x[0] >= least - 1e-9), reverse=True):
            if bound < best - 1e-9:
                break
            best = max(best, self.score_of(text[at : at + size]))
        return best if best >= least else 0.0


_alias = functools.lru_cache(4096)(Alias)
#: Below this score a window counts for nothing; the bounds above rest on it.
ALIAS_LEAST = 0.80


def alias_score(alias: str, text: str) -> float:
    """1 if the text contains the alias; else the best window's mix of letters, n-grams and matching blocks; 0 below 0.8.

    Windows are as long as the alias, give or take three letters. An index of n-grams bounds the score of each, and they are scored from the
    highest bound down, as long as one can still be better.
    """
    return _alias(alias).score(text, ALIAS_LEAST) if len(alias) >= 3 and text else 0.0


@F.pandas_udf(DoubleType())
def alias_match_score(alias: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([0.0 if a is None or t is None else alias_score(a, t) for a, t in zip(alias, text)])


def quote_found(quote: str | None, source: str | None, least: float = 0.82) -> bool:
    """Is the quote in the source, blanks and case aside, with that share of equal characters in some window?

    If at most k characters differ, one of k + 1 pieces of the quote stands in its place unchanged, so only windows around such pieces are compared;
    once around each place, however many pieces point to it.
    """
    q, s = ("".join((x or "").lower().split()) for x in (quote, source))
    if not q or not s:
        return False
    if q in s:
        return True
    need = math.ceil(least * len(q) - 1e-9)
    if len(s) < len(q):
        return sum(a == b for a, b in zip(q, s)) >= need
    wrong = len(q) - need
    cuts = [len(q) * i // (wrong + 1) for i in range(wrong + 2)]
    own, other = (np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in (q, s))
    tried: set[int] = set()
    for lo, hi in zip(cuts, cuts[1:]):
        at = s.find(q[lo:hi], lo, len(s) - len(q) + hi)
        while at >= 0:
            if (start := at - lo) not in tried:
                tried.add(start)
                if int((other[start : start + len(q)] == own).sum()) >= need:
                    return True
            at = s.find(q[lo:hi], at + 1, len(s) - len(q) + hi)
    return False


@F.pandas_udf(BooleanType())
def fuzzy_quote_found(quote: pd.Series, source: pd.Series) -> pd.Series:
    return pd.Series([quote_found(q, s) for q, s in zip(quote, source)])


def register(spark) -> None:
    """The functions under their names for SQL."""
    for name, fn in (("sequence_ratio", sequence_ratio), ("alias_match_score", alias_match_score), ("fuzzy_quote_found", fuzzy_quote_found)):
        spark.udf.register(name, fn)
