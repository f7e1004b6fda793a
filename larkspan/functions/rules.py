"""Small rules over text and numbers: stems, roles, units, claims, transitions, scores. Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# States of verification, in the order in which they follow one another.
STATES = ("DOCUMENT_SOURCE_RECORDED", "PDF_TEXT_EXTRACTED", "EXTRACTION_QUALITY_CHECKED", "PASSAGE_MATCHES_STORED_DOCUMENT", "CLAUSE_IDENTIFIER_VERIFIED", "ENGINEERING_APPLICABILITY_REVIEWED", "HUMAN_EXPERT_ADJUDICATED")
# How far a source is to be trusted.
PROVENANCE = {"UNKNOWN": 0, "INFERRED": 1, "CURATED": 2, "VERIFIED": 3, "OFFICIAL": 4}


def stem(w: Column) -> Column:
    """Plural and -ing endings off: ies to y, es, ing and s away, if enough is left."""
    n = F.length(w)
    return (
        F.when(w.endswith("ies") & (n > 4), F.concat(F.substr(w, F.lit(1), n - 3), F.lit("y")))
        .when(w.endswith("es") & (n > 4), F.substr(w, F.lit(1), n - 2))
        .when(w.endswith("ing") & (n > 5), F.substr(w, F.lit(1), n - 3))
        .when(w.endswith("s") & ~w.endswith("ss") & (n > 3), F.substr(w, F.lit(1), n - 1))
        .otherwise(w)
    )


def sigmoid(x: Column) -> Column:
    return F.when(x > 20, 1.0).when(x < -20, 0.0).otherwise(1 / (1 + F.exp(-x)))


def squash(score: Column) -> Column:
    """abs / (abs + 5), within 0 and 1, three digits."""
    return F.round(F.least(F.greatest(F.abs(score) / (F.abs(score) + 5), F.lit(0.0)), F.lit(1.0)), 3)


def reranked(hybrid: Column, rerank: Column, w: float = 0.25) -> Column:
    """The blend of both scores; an authoritative hybrid score stays."""
    return F.when(hybrid >= 0.98, hybrid).otherwise(F.round((1 - w) * hybrid + w * F.coalesce(rerank, F.lit(0.5)), 4))


def grounded(claim: Column, source: Column, least: float = 0.25) -> tuple[Column, Column]:
    """Share of the claim's words that the source has, and whether it is enough. Both are arrays of distinct words."""
    n = F.size(claim)
    share = F.when(n > 0, F.size(F.array_intersect(claim, source)) / n).otherwise(0.0)
    return F.round(share, 4), share >= least


def may_follow(now: Column, target: Column) -> Column:
    """A state may only be followed by the next one."""
    order = F.create_map(*[F.lit(x) for i, s in enumerate(STATES) for x in (s, i)])
    return F.coalesce(order[target] == order[now] + 1, F.lit(False))


def provenance_rank(source: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in PROVENANCE.items() for x in kv])[F.upper(F.trim(source))], F.lit(0))


def version_role(status: Column) -> Column:
    return F.when(status == "ACTIVE", "CURRENT").when(status == "SUPERSEDED", "HISTORICAL").when(status == "WITHDRAWN", "WITHDRAWN").otherwise("UNVERIFIED")


def summary(text: Column, n: int = 220) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def specification(text: Column) -> Column:
    """Ratings in a text: number and unit, in order, each once."""
    found = F.regexp_extract_all(text, F.lit(r"([0-9]+(?:\.[0-9]+)? ?(?:kVA|kV|kW|MW|mm|bar|A|V|W))\b"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.replace(x, F.lit(" "), F.lit(""))))


def sub_queries(text: Column, least: int = 8) -> Column:
    """Parts between commas, semicolons, 'and', 'including' and 'with' that are long enough."""
    parts = F.split(F.regexp_replace(F.lower(text), r"\s(and|including|incl|with)\s", ","), "[,;]")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: F.length(x) > least)


def bad_scheme(url: Column) -> Column:
    return F.lower(F.trim(url)).rlike("^(javascript|data|vbscript|file):")


def support(requirement: Column, passage: Column) -> Column:
    """How a passage bears on a requirement: contradicts, supports, supports in part, or not at all. Arrays of distinct words."""
    shared = F.size(F.array_intersect(requirement, passage))
    negated = F.array_contains(passage, "not") != F.array_contains(requirement, "not")
    share = F.when(F.size(requirement) > 0, shared / F.size(requirement)).otherwise(0.0)
    return F.when(negated & (share >= 0.3), "CONTRADICTED").when(share >= 0.6, "FULLY_SUPPORTED").when(share >= 0.3, "PARTIALLY_SUPPORTED").otherwise("UNSUPPORTED")
