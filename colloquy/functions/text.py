"""Text functions as Spark expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy.functions import lexicons as X


def any_of(c: Column, words: list[str]) -> Column:
    """Does the text contain one of the words?"""
    return reduce(or_, (c.contains(w) for w in words), F.lit(False))


def matches_any(c: Column, patterns: list[str]) -> Column:
    return reduce(or_, (c.rlike(p) for p in patterns), F.lit(False))


def first_of(c: Column, words: list[str]) -> Column:
    """The first listed word that the text contains; null if none."""
    return F.coalesce(*(F.when(c.contains(w), F.lit(w)) for w in words))


def negation_status(c: Column, terms: list[str] = (), prefix=X.NEGATION_PREFIX, suffix=X.NEGATION_SUFFIX, double=X.DOUBLE_NEGATION, contrast=X.CONTRAST) -> Column:
    """clear, negated or ambiguous: given terms negate, double negation and negation with a contrast word are ambiguous."""
    ends = reduce(or_, (c.endswith(s) for s in suffix), F.lit(False))
    return (
        F.when(any_of(c, list(terms)), "negated").when(any_of(c, double), "ambiguous")
        .when(any_of(c, prefix), F.when(any_of(c, contrast), "ambiguous").otherwise("negated")).when(ends, "negated").otherwise("clear")
    )


def unnegated_keyword(text: Column, keyword: Column, tokens=X.NEGATION_TOKENS, reach: int = X.NEGATION_REACH, breaks: str = X.NEGATION_BREAKS) -> Column:
    """Is some occurrence of the keyword preceded by an even number of negation tokens (within `reach` characters of its sentence)?"""
    places = F.filter(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(text, i, F.length(keyword)) == keyword)

    def even(i: Column) -> Column:
        before = F.element_at(F.split(F.substring(text, F.greatest(i - reach, F.lit(1)), F.least(i - 1, F.lit(reach))), f"[{breaks}]"), -1)
        longest_first = "|".join(sorted(tokens, key=len, reverse=True))
        return F.regexp_count(before, F.lit(longest_first)) % 2 == 0

    return F.when((F.length(keyword) > 0) & text.contains(keyword), F.exists(places, even)).otherwise(False)


def char_ngrams(c: Column, sizes: tuple[int, ...] = (2, 3)) -> Column:
    """Distinct character n-grams."""
    one = lambda n: F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*(one(n) for n in sizes)))


def dice(a: Column, b: Column) -> Column:
    """Twice the common n-grams over all; 0 for two empty texts."""
    x, y = char_ngrams(a), char_ngrams(b)
    total = F.size(x) + F.size(y)
    return F.when(total == 0, 0.0).otherwise(2.0 * F.size(F.array_intersect(x, y)) / total)


def extract_keywords(c: Column) -> Column:
    """Numbers (with %), runs of Chinese characters (up to 4 whole, longer ones as pairs), Latin words of 2 or more; each once, by kind."""
    numbers = F.regexp_extract_all(c, F.lit(r"(\d+(?:\.\d+)?%?)"), F.lit(1))
    runs = F.regexp_extract_all(c, F.lit("([一-鿿]{2,})"), F.lit(1))
    pairs = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) <= 4, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2))))))
    words = F.transform(F.regexp_extract_all(c, F.lit("([A-Za-z]{2,})"), F.lit(1)), lambda x: F.lower(x))
    return F.array_distinct(F.concat(numbers, pairs, words))


def template_elements(c: Column) -> Column:
    """Parts of a template between punctuation, of 2 characters or more."""
    return F.filter(F.transform(F.split(c, r"[，。！？、；：,.!?;:\n]+"), lambda x: F.trim(x)), lambda x: F.length(x) >= 2)


def parse_bool(c: Column) -> Column:
    return F.lower(F.trim(c)).isin("true", "yes", "1", "是", "y")


def internal_info_leaks(c: Column, patterns: dict[str, str] = X.INTERNAL_LEAKS) -> Column:
    """Names of the patterns that the text matches."""
    return F.array_compact(F.array(*(F.when(c.rlike(p), name) for name, p in patterns.items())))


def detection_form(c: Column) -> Column:
    """Lower case without zero-width characters and blanks."""
    return F.lower(F.regexp_replace(c, f"{X.ZERO_WIDTH}|\\s", ""))


def canary_injection(c: Column, payloads: list[str] = X.CANARIES) -> Column:
    form = detection_form(c)
    return F.array_compact(F.array(*(F.when(form.contains("".join(p.lower().split())), p) for p in payloads)))


def coercive_closure(c: Column, phrases: list[str] = X.COERCION) -> Column:
    return any_of(detection_form(c), phrases)


def keyword_flooding(c: Column, keywords: list[str]) -> Column:
    """long (over 80), many (3 keywords or more), stuffed (3 or more in under 120 characters)."""
    n = reduce(lambda a, w: a + F.when(c.contains(w), 1).otherwise(0), keywords, F.lit(0))
    return F.struct((F.length(c) > 80).alias("long"), (n >= 3).alias("many"), ((n >= 3) & (F.length(c) < 120)).alias("stuffed"))


def negated_claim(c: Column, keywords: list[str], **lists) -> Column:
    return any_of(c, keywords) & (negation_status(c, **lists) == "negated")


def strip_template_leaks(c: Column) -> Column:
    """The text without table rows, checklist lines and summary headings."""
    c = F.regexp_replace(c, r"(?m)^\s*\|.*\|\s*$", "")
    c = F.regexp_replace(c, r"(?m)^\s*[-*]?\s*[✅☑✓\[].*$", "")
    return F.trim(F.regexp_replace(c, r"\n{2,}", "\n"))


def mask_forbidden(c: Column, words: list[str], fallback: str = "***") -> Column:
    masked = reduce(lambda a, w: F.replace(a, F.lit(w), F.lit("***")), words, c)
    return F.when(F.length(F.trim(masked)) == 0, fallback).otherwise(masked)


def is_call_ending(c: Column, signals=X.END_SIGNALS, phrases=X.END_PHRASES, farewells=X.FAREWELLS, later=X.LATER) -> Column:
    """An explicit signal, a closing phrase, or a farewell at the end that doesn't say see you later."""
    bye = reduce(or_, (F.trim(c).endswith(f) for f in farewells), F.lit(False))
    return any_of(c, [*signals, *phrases]) | (bye & ~any_of(c, [w + farewells[0] for w in later]))


def negative_emotion(c: Column, keywords=X.ANGER, false_positives=X.NOT_ANGER, in_context=X.ANGER_IN_CONTEXT) -> Column:
    """A keyword that is no part of a harmless word in the text, or one with the context it needs."""
    hit = reduce(or_, (c.contains(k) & ~any_of(c, [w for w in false_positives if k in w or set(k) & set(w)]) for k in keywords), F.lit(False))
    return hit | reduce(or_, (c.contains(k) & any_of(F.replace(c, F.lit(k), F.lit("")), ctx) for k, ctx in in_context.items()), F.lit(False))


def infer_archetype(p: str) -> Column:
    """Archetype of a persona struct, by the first rule that holds."""
    f = lambda n: F.col(f"{p}.{n}")
    return (
        F.when(f("busy_level") >= 8, "busy").when(f("emotional") >= 8, "angry").when(f("trust_level") <= 3, "suspicious").when(f("comprehension") <= 3, "confused")
        .when(f("cooperativeness") <= 3, "refusing").when(f("cooperativeness") >= 8, "cooperative").otherwise("neutral")
    )


def identity_confirmed(text: Column, name: Column, order_id: Column, roles: list[str]) -> Column:
    """1.0 where the name is said (or a role, if there is no name), 0.8 for the order id, else 0."""
    return F.when(name.isNull() & any_of(text, roles), 1.0).when(text.contains(name), 1.0).when(text.contains(order_id), 0.8).otherwise(0.0)


def extract_json(c: Column) -> Column:
    """The text from the first brace to the last one, if it is JSON; otherwise an empty object."""
    found = F.regexp_extract(c, r"(?s)(\{.*\}|\[.*\])", 1)
    return F.when(F.try_parse_json(found).isNotNull() & (found != ""), found).otherwise("{}")


def config_hash(*columns: str) -> Column:
    """First 16 hex digits of the SHA-256 of key-sorted JSON."""
    return F.substring(F.sha2(F.to_json(F.struct(*sorted(columns))), 256), 1, 16)
