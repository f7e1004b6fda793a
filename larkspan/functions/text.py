"""Text functions: tokens, sanitising, citations, classes, quality. Column in, Column out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that the lexical index leaves out.
STOP_WORDS = (
    "a an and are as at be by for from has he in is it its of on that the to was were will with under over into or all any both each few "
    "more most other some such no nor not only own same so than too very s t can just don should now etc incl including work works"
).split()

# Directives that are taken out of untrusted text, in this order.
DIRECTIVES = (
    r'\{[^{}]*"[a-zA-Z_]+"\s*:[^{}]*\}',
    r"(?i)\[\s*(?:CRITICAL\s+)?(?:INSTRUCTION|SYSTEM\s+NOTE|SYSTEM|NOTE)\s*:[^\]]*\]",
    r"(?i)\b(?:Assistant|System)\s*:[^.]*(?:\.|$)",
    r"(?i)\b(?:mark\s+all\s+items\s+approved|bypass\s+applicability\s+gate)[^.]*(?:\.|$)",
    r"(?i)\b(?:SYSTEM\s+OVERRIDE|SYSTEM\s+INSTRUCTION|INSTRUCTION)\s*[:-][^\n.]*",
    r"(?i)\b(?:return|output)\s+json\s*[:-]?[^\n.]*",
    r"(?i)\bignore\s+(?:all\s+)?(?:previous\s+)?(?:instructions|tender\s+text|bis\s+catalogue)[^\n.]*",
    r"(?i)\b(?:unconditionally\s+recommend|output\s+standard\s+IS|always\s+recommend|do\s+not\s+abstain)[^\n.]*",
    r"(?i)\b(?:you\s+must\s+(?:output|return)|mark\s+publication\s+readiness)[^\n.]*",
)
# How a standard is cited.
CITATION = r"(?i)\b((?:IS\s*/\s*ISO|IS\s*/\s*IEC|IS|SP)\s*[:/]?\s*[0-9]+(?:\s*\(\s*Part\s*[0-9]+\s*\))?(?:\s*:\s*[0-9]{4})?)"


def tokens(text: Column) -> Column:
    """Lower-case ASCII words and numbers of two characters or more, without stop words."""
    words = F.filter(F.split(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "[^a-zA-Z0-9]+", " ")), " "), lambda x: F.length(x) >= 2)
    return F.filter(words, lambda x: ~x.isin(*STOP_WORDS))


def sanitized(text: Column) -> Column:
    out = reduce(lambda c, p: F.regexp_replace(c, p, " "), DIRECTIVES, F.coalesce(text, F.lit("")))
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"\.{2,}", ". "), r"\s+", " "))


def citations(text: Column) -> Column:
    """Cited identifiers, in order, each once, in upper case with single spaces."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CITATION), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.upper(F.trim(F.regexp_replace(x, r"\s+", " ")))))


def hits(text: Column, words: list[str]) -> Column:
    """How many of the words are in the text, as substrings."""
    return reduce(lambda a, b: a + b, [F.when(F.lower(text).contains(w), 1).otherwise(0) for w in words])


def best_class(text: Column, classes: dict[str, list[str]], default: str) -> Column:
    """The class with most hits; ties go to the class named first; without a hit the default."""
    scored = F.array(*[F.struct(hits(text, words).alias("n"), F.lit(-i).alias("o"), F.lit(k).alias("k")) for i, (k, words) in enumerate(classes.items())])
    top = F.array_max(scored)
    return F.when(top["n"] > 0, top["k"]).otherwise(default)


def has_table(text: Column) -> Column:
    """A table word, two lines with bars, or four lines with wide gaps."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    bars = F.size(F.filter(lines, lambda x: F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit(""))) >= 2))
    wide = F.size(F.filter(lines, lambda x: x.rlike("[^ ] {3,}[^ ]")))
    return F.lower(text).rlike(r"(^|[^a-z])table [0-9]") | (bars >= 2) | (wide >= 4)


def quality(text: Column) -> Column:
    """OCR_REQUIRED if there is nearly no text, QUALITY_FAILED if much of it is marks, EXTRACTED otherwise."""
    n = F.length(F.trim(F.coalesce(text, F.lit(""))))
    marks = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^#$%&*\x{FFFD}]", ""))
    return F.when(n < 50, "OCR_REQUIRED").when(marks / n > 0.05, "QUALITY_FAILED").otherwise("EXTRACTED")


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
