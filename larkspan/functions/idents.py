"""Identifiers of catalogue entries: cleaning, parsing, comparing, lifecycle status. Column in, Column out.

The patterns use no look-around and only ASCII classes, so that other SQL engines read them alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The prefixes that occur in identifiers, longest first.
PREFIXES = (
    r"IS\s*/\s*ISO\s*/\s*IEC\s*/\s*IEEE",
    r"IS\s*/\s*ISO\s*/\s*IEC\s*/\s*(?:TR|TS|PAS|GUIDE)",
    r"IS\s*/\s*ISO\s*/\s*IEC",
    r"IS\s*/\s*ISO\s*/\s*(?:TR|TS|PAS|TTA|IEEE|GUIDE)",
    r"IS\s*/\s*IEC\s*/\s*(?:TR|TS|PAS|IEEE|IEE|GUIDE)",
    r"IS\s*/\s*ISO",
    r"IS\s*/\s*IEC",
    r"IS\s*/\s*CISPR",
    r"IS\s*/\s*QC",
    r"IS\s*/\s*EN",
    r"IS\s+B\b",
    r"ISO\s*/\s*SAE",
    r"ISO\s*/\s*IEC",
    r"IEC\b",
    r"ISO\b",
    r"SP\b",
    r"IS\b",
)
PREFIX = "(?i)^(" + "|".join(PREFIXES) + ")"
BARE = r"^([0-9]+)(?:\s+([0-9]+))?\s*[:-]\s*(19[0-9][0-9]|20[0-9][0-9])"
# The grammar of years, parts, sections and amendments.
YEAR = r"(?::\s*(19[0-9][0-9]|20[0-9][0-9])\b|[-_\s](19[0-9][0-9]|20[0-9][0-9])\s*$)"
PART_SECTION = r"(?i)\(\s*(?:Part|Pt\.?)\s*([0-9]+)\s*(?:/|\s+)\s*(?:Sec\.?|Section)\s*([0-9]+)\s*\)"
PART = r"(?i)(?:\(\s*(?:Part|Pt\.?)\s*([0-9]+)\s*\)|\b(?:Part|Pt\.?)\s*[-/]?\s*([0-9]+)\b)"
SECTION = r"(?i)(?:\(\s*(?:Sec\.?|Section)\s*([0-9]+)\s*\)|\b(?:Sec\.?|Section)\s*[-/]?\s*([0-9]+)\b)"
AMENDMENT = r"(?i)\b(?:Amd\.?|Amendment)\s*[-/]?\s*([0-9]+)\b"
DASHED = r"^([0-9]+)\s*-\s*([0-9]+)(?:\s*-\s*([0-9]+))?$"


def clean_html(raw: Column) -> Column:
    """The first segment before a line break, without tags, trimmed."""
    return F.trim(F.regexp_replace(F.split(F.coalesce(raw, F.lit("")), r"(?i)<br\s*/?>")[0], "<[^>]+>", ""))


def _number(text: Column, pattern: str, *groups: int) -> Column:
    found = [F.nullif(F.regexp_extract(text, pattern, g), F.lit("")) for g in groups]
    return F.coalesce(*found).cast("int") if len(found) > 1 else found[0].cast("int")


def let(value: Column, body) -> Column:
    """body(value), with value computed once: a bound variable is not copied into the expressions that use it."""
    return F.transform(F.array(value), body)[0]


def parse(raw: Column) -> Column:
    """prefix, base, part, section, year, amendment, canonical_id, canonical, base_standard and valid of an identifier."""
    text = clean_html(raw)
    text = F.when(text.startswith("ÍS") | text.startswith("Ís"), F.concat(F.lit("IS"), F.substr(text, F.lit(3)))).otherwise(text)

    def heads(c: Column) -> Column:
        first, second = F.regexp_extract(c, BARE, 1), F.regexp_extract(c, BARE, 2)
        bare = F.when((second != "") & (second != first), "").otherwise(first)
        return let(F.struct(bare.alias("bare"), F.nullif(F.regexp_extract(c, BARE, 3), F.lit("")).cast("int").alias("year"), F.regexp_extract(c, PREFIX, 1).alias("found")), lambda h: prefix(c, h))

    def prefix(c: Column, h: Column) -> Column:
        name = F.regexp_replace(F.regexp_replace(F.upper(h["found"]), r"\s*/\s*", "/"), r"\s+", " ")
        name = F.when(h["found"] == "", F.when(c.rlike("^[0-9]"), "IS").otherwise("UNKNOWN")).when(name == "IS/IEC/IEE", "IS/IEC/IEEE").otherwise(name)
        return let(F.struct(name.alias("prefix"), F.trim(F.substr(c, F.length(h["found"]) + 1)).alias("r")), lambda x: amendment(h, x))

    def amendment(h: Column, x: Column) -> Column:
        bad = (x["prefix"] == "UNKNOWN") | (h["found"] != "") & (x["r"].rlike(r"^[-/]\s*[0-9]") | x["r"].rlike(r"(?i)^\s*\(\s*(?:Part|Pt|Sec)"))
        n = _number(x["r"], AMENDMENT, 1)
        return let(F.struct(bad.alias("bad"), n.alias("n"), F.when(n.isNull(), x["r"]).otherwise(F.trim(F.regexp_replace(x["r"], AMENDMENT, ""))).alias("r")), lambda m: year(h, x, m))

    def year(h: Column, x: Column, m: Column) -> Column:
        n = _number(m["r"], YEAR, 1, 2)
        return let(F.struct(n.alias("n"), F.when(n.isNull(), m["r"]).otherwise(F.trim(F.regexp_replace(m["r"], "(?s)" + YEAR + ".*$", ""))).alias("r")), lambda y: part(h, x, m, y))

    def part(h: Column, x: Column, m: Column, y: Column) -> Column:
        both, alone = _number(y["r"], PART_SECTION, 1), _number(y["r"], PART, 1, 2)
        rest = F.when(both.isNotNull(), F.regexp_replace(y["r"], PART_SECTION, "")).when(alone.isNotNull(), F.regexp_replace(y["r"], PART, "")).otherwise(y["r"])
        return let(F.struct(F.coalesce(both, alone).alias("part"), _number(y["r"], PART_SECTION, 2).alias("section"), both.isNotNull().alias("both"), rest.alias("r")), lambda p: section(h, x, m, y, p))

    def section(h: Column, x: Column, m: Column, y: Column, p: Column) -> Column:
        alone = F.when(~p["both"], _number(p["r"], SECTION, 1, 2))
        return let(F.struct(F.coalesce(p["section"], alone).alias("section"), F.trim(F.when(alone.isNull(), p["r"]).otherwise(F.regexp_replace(p["r"], SECTION, ""))).alias("r")), lambda s: base(h, x, m, y, p, s))

    def base(h: Column, x: Column, m: Column, y: Column, p: Column, s: Column) -> Column:
        dashed = p["part"].isNull() & s["r"].rlike(DASHED)
        plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(s["r"], r"^[\s:-]+|[\s:-]+$", ""), r"\s*-\s*", "-"), r"\s+", " ")
        bare = h["bare"] != ""
        none = F.lit(None).cast("int")
        number = F.when(bare, h["bare"]).when(dashed, F.regexp_extract(s["r"], DASHED, 1)).otherwise(plain)
        parts = F.struct(
            F.when(bare, "IS").otherwise(x["prefix"]).alias("prefix"),
            number.alias("base"),
            F.when(bare, none).when(dashed, _number(s["r"], DASHED, 2)).otherwise(p["part"]).alias("part"),
            F.when(bare, none).when(dashed & s["section"].isNull(), _number(s["r"], DASHED, 3)).otherwise(s["section"]).alias("section"),
            F.when(bare, h["year"]).otherwise(y["n"]).alias("year"),
            F.when(bare, none).otherwise(m["n"]).alias("amendment"),
            (bare | ~m["bad"] & number.rlike("[0-9]")).alias("valid"),
            bare.alias("bare"),
        )
        return let(parts, written)

    return let(text, heads)


def written(i: Column) -> Column:
    """The struct of an identifier's parts with its three written forms."""
    some = lambda before, c, after="": F.coalesce(F.concat(F.lit(before), i[c].cast("string"), F.lit(after)), F.lit(""))
    number = F.concat(i["prefix"], F.lit(" "), i["base"], some(" (Part ", "part", ")"), some(" (Sec ", "section", ")"), some(" Amd ", "amendment"))
    slug = F.concat_ws("-", F.translate(i["prefix"], "/ ", "--"), F.replace(i["base"], F.lit(" "), F.lit("-")), F.concat(F.lit("Part-"), i["part"].cast("string")), F.concat(F.lit("Sec-"), i["section"].cast("string")), F.concat(F.lit("Amd-"), i["amendment"].cast("string")), i["year"].cast("string"))
    ok = lambda c, other=None: F.when(i["valid"], c).otherwise(F.lit(other))
    return F.struct(
        i["prefix"].alias("prefix"),
        ok(i["base"], "").alias("base"),
        ok(i["part"]).alias("part"),
        ok(i["section"]).alias("section"),
        i["year"].alias("year"),
        ok(i["amendment"]).alias("amendment"),
        ok(slug, "UNKNOWN").alias("canonical_id"),
        ok(F.concat(number, F.when(i["bare"], some(":", "year")).otherwise(some(" : ", "year"))), "UNKNOWN").alias("canonical"),
        ok(number, "UNKNOWN").alias("base_standard"),
        i["valid"].alias("valid"),
    )


def parsed(df: DataFrame, raw: str, out: str = "ident") -> DataFrame:
    """df with the parsed identifier as a struct column."""
    return df.withColumn(out, parse(F.col(raw)))


def equivalent(a: Column, b: Column, ignore_year: bool = False) -> Column:
    """Two parsed identifiers name the same entry; a missing year matches any."""
    same = a["prefix"].eqNullSafe(b["prefix"]) & a["base"].eqNullSafe(b["base"]) & a["part"].eqNullSafe(b["part"]) & a["section"].eqNullSafe(b["section"])
    return same if ignore_year else same & F.coalesce(a["year"] == b["year"], F.lit(True))


def lifecycle(withdrawn: Column, status_text: Column, title: Column) -> Column:
    """Status, with withdrawn before superseded before active before unknown."""
    s, t = F.upper(F.trim(F.coalesce(status_text, F.lit("")))), F.upper(F.coalesce(title, F.lit("")))
    return (
        F.when((F.upper(F.trim(F.coalesce(withdrawn, F.lit("")))) == "W") | s.contains("WITHDRAWN"), "WITHDRAWN")
        .when(s.contains("SUPERSED") | t.contains("SUPERSED"), "SUPERSEDED")
        .when(s.contains("ACTIVE") | s.contains("CONCURRENT RUNNING"), "ACTIVE")
        .otherwise("UNKNOWN")
    )


def is_active(status: Column) -> Column:
    """True, false, or null where it isn't known."""
    return F.when(status == "ACTIVE", True).when(status.isin("WITHDRAWN", "SUPERSEDED"), False)


def department(committee: Column) -> Column:
    return F.upper(F.nullif(F.regexp_extract(F.trim(committee), "^([A-Za-z]+)", 1), F.lit("")))


def iso_equivalence(raw: Column) -> Column:
    """The second segment of the raw field, unless it only says identical or indigenous."""
    second = F.trim(F.regexp_replace(F.get(F.split(raw, r"(?i)<br\s*/?>"), F.lit(1)), "<[^>]+>", ""))
    return F.when((second != "") & ~F.lower(second).startswith("identical") & ~F.lower(second).startswith("indigenous"), second)


def slugify(text: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(text), r"[^a-zA-Z0-9_.]", "_"), "_+", "_"), "^_+|_+$", "")
    return F.when(slug == "", "unknown").otherwise(slug)


def canonical_hash(text: Column) -> Column:
    return F.sha2(F.regexp_replace(F.trim(text), r"\s+", " "), 256)


def first_number(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"\b([0-9]{3,5})\b", 1), F.lit(""))


def csv_guarded(text: Column) -> Column:
    """A cell that a spreadsheet would take for a formula gets a quote before it."""
    return F.when(F.substring(text, 1, 1).isin("=", "+", "-", "@", "\t", "\r"), F.concat(F.lit("'"), text)).otherwise(text)
