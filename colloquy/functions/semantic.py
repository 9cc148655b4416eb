"""Utterance predicates by meaning: aliases, weighted concepts and keywords, with a look at negation."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy.functions.fuzzy import alias_match_score
from colloquy.functions.text import any_of, negation_status

#: Share of its weight that a missing required concept keeps, coverage that accepts, and least score of an alias.
MISSING_REQUIRED, ACCEPT, ALIAS = 0.35, 0.86, 0.72


@dataclass(frozen=True)
class Concept:
    aliases: list[str]
    weight: float = 1.0
    required: bool = True
    least: float = ALIAS


@dataclass(frozen=True)
class SemanticPredicate:
    positive: list[str] = field(default_factory=list)
    negative: list[str] = field(default_factory=list)
    concepts: list[Concept] = field(default_factory=list)
    keywords: list[str] = field(default_factory=list)
    ratio: float = 0.4
    accept: float = ACCEPT
    negation_terms: list[str] = field(default_factory=list)


def concept_coverage(c: Column, concepts: list[Concept]) -> Column:
    """Weighted share of the concepts of which the text has an alias that scores enough; required ones that are missing keep a part of
    their weight. Python sees a text only for aliases that it doesn't simply contain."""
    def found(concept: Concept) -> Column:
        plain = any_of(c, [a.lower() for a in concept.aliases])
        best = F.greatest(F.lit(0.0), *(alias_match_score(F.when(plain, F.lit(None)).otherwise(F.lit(a.lower())), c) for a in concept.aliases))
        return plain | (best >= concept.least)

    parts = [F.when(found(k), k.weight).otherwise(k.weight * MISSING_REQUIRED if k.required else 0.0) for k in concepts]
    return reduce(Column.__add__, parts, F.lit(0.0)) / sum(k.weight for k in concepts)


def semantic_match(content: Column, p: SemanticPredicate, **lists) -> Column:
    """Does the text meet the predicate? A negative alias rejects; a positive alias, enough of the concepts or enough keywords accept,
    if nothing is negated. A negated text with concepts is rejected whatever its keywords. `lists`: those of `negation_status`."""
    c = F.lower(content)
    status = negation_status(c, [t.lower() for t in p.negation_terms], **lists)
    clear = status == "clear"
    hits = reduce(Column.__add__, (c.contains(k.lower()).cast("int") for k in p.keywords), F.lit(0))
    by_words = (hits >= max(1, p.ratio * len(p.keywords))) & clear if p.keywords else F.lit(False)
    by_concepts = (concept_coverage(c, p.concepts) >= p.accept) & clear if p.concepts else F.lit(False)
    ok = ~any_of(c, [n.lower() for n in p.negative]) & ((any_of(c, [a.lower() for a in p.positive]) & clear) | by_concepts | by_words)
    return F.coalesce(ok, F.lit(False))
