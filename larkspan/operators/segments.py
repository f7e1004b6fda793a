"""Texts as lines, clauses and items; pages as passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspan.functions import idents as I

# What a clause heading looks like.
CLAUSE = r"^(?:(?:Clause|Section)\s+)?([0-9]+(?:\.[0-9]+)*)\s+[A-Z0-9]"
NAMED = r"(?i)^(Foreword|Scope|References|Annexure\s+[A-Z0-9]+|Appendix\s+[A-Z0-9]+|Table\s+[0-9]+(?:\.[0-9]+)?)\b"
# Lines that carry no requirement.
BOILERPLATE = r"(?i)(^page [0-9]+|^licensed under|all rights reserved|^signature|^date\s*:|^tender no|^note\s*:)"


def lines(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, line, t): the trimmed lines of each text, from 0."""
    return docs.select(F.col(doc).alias("doc"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line", "t")).withColumn("t", F.trim("t"))


def headings(rows: DataFrame) -> DataFrame:
    """rows with the heading that a line is, or null: a clause number or a named section."""
    number, named = F.nullif(F.regexp_extract("t", CLAUSE, 1), F.lit("")), F.nullif(F.regexp_extract("t", NAMED, 1), F.lit(""))
    return rows.withColumn("heading", F.coalesce(number, named))


def clauses(rows: DataFrame) -> DataFrame:
    """(doc, seq, clause, passage_id, text, hash): lines under the heading that is current, joined in order.

    The window runs within a document only."""
    w = Window.partitionBy("doc").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("seq", F.sum(F.when(F.col("heading").isNotNull(), 1).otherwise(0)).over(w))
    joined = placed.where("t <> ''").groupBy("doc", "seq").agg(F.min("heading").alias("clause"), F.sort_array(F.collect_list(F.struct("line", "t"))).alias("ls"))
    text = F.array_join(F.transform("ls", lambda x: x["t"]), "\n")
    out = joined.select("doc", "seq", F.coalesce("clause", F.lit("preamble")).alias("clause"), text.alias("text"))
    return out.select("doc", "seq", "clause", F.concat(F.col("doc").cast("string"), F.lit("_c"), I.slugify(F.col("clause")), F.lit("_"), F.col("seq").cast("string")).alias("passage_id"), "text", I.canonical_hash(F.col("text")).alias("hash"))


def requirement_lines(rows: DataFrame, keep: str, least: int = 25) -> DataFrame:
    """(doc, line, t): lines that are long enough, match keep, are no boilerplate and weren't said before in the document."""
    good = rows.where((F.length("t") >= least) & ~F.col("t").rlike(BOILERPLATE) & F.col("t").rlike(keep))
    return good.groupBy("doc", "t").agg(F.min("line").alias("line")).select("doc", "line", "t")


def context(rows: DataFrame, pattern: str) -> DataFrame:
    """(doc, line, around): lines that match pattern, with the line before and after."""
    w = Window.partitionBy("doc").orderBy("line")
    near = rows.withColumn("around", F.concat_ws(" / ", F.lag("t").over(w), "t", F.lead("t").over(w)))
    return near.where(F.col("t").rlike(pattern)).select("doc", "line", "around")


def next_line_fields(rows: DataFrame, field: str) -> DataFrame:
    """(doc, line, value): where a line is just the field's name, the next line's text."""
    w = Window.partitionBy("doc").orderBy("line")
    return rows.withColumn("value", F.lead("t").over(w)).where(F.lower("t") == field.lower()).select("doc", "line", "value")


def items(rows: DataFrame, least: int = 15) -> DataFrame:
    """(doc, item, text): numbered or bulleted items, each to the next mark or empty line."""
    mark = F.col("t").rlike(r"^(?:[0-9]+[.)]|[-*•])\s")
    w = Window.partitionBy("doc").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("item", F.sum(F.when(mark | (F.col("t") == ""), 1).otherwise(0)).over(w)).where("t <> ''")
    joined = placed.groupBy("doc", "item").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "t"))), lambda x: x["t"]), " ").alias("text"))
    return joined.where(F.length("text") > least)
