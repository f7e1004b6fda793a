"""Relationship graphs as edge tables: neighbours, bounded walks, hubs, supersession, dependencies, gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Relationship types, and names that mean the same.
ALIASES = {"SUPERSEDED_BY": "SUPERSEDES", "REPLACES": "SUPERSEDES", "REPLACED_BY": "SUPERSEDES", "REFERS_TO": "REFERENCES", "CITES": "REFERENCES"}
REVERSED = ("SUPERSEDED_BY", "REPLACED_BY")


def canonical_edges(edges: DataFrame) -> DataFrame:
    """(src, dst, type): one name for each type, and one direction: a passive relationship is turned round."""
    names = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    kind = F.upper(F.trim("type"))
    turned = kind.isin(*REVERSED)
    return edges.select(F.when(turned, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(turned, F.col("src")).otherwise(F.col("dst")).alias("dst"), F.coalesce(names[kind], kind).alias("type"))


def neighbours(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, other, type, direction): edges of the given nodes (node), both ways, each once."""
    out = nodes.join(edges, F.col("node") == F.col("src")).select("node", F.col("dst").alias("other"), "type", F.lit("OUT").alias("direction"))
    back = nodes.join(edges, F.col("node") == F.col("dst")).select("node", F.col("src").alias("other"), "type", F.lit("IN").alias("direction"))
    return out.unionByName(back).distinct()


def walked(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, other, depth): what outgoing edges reach in one or two steps, with the least depth."""
    step = edges.select("src", "dst").distinct()
    one = nodes.join(step, F.col("node") == F.col("src")).select("node", F.col("dst").alias("other"))
    two = one.join(step, F.col("other") == F.col("src")).select("node", F.col("dst").alias("other"))
    both = one.withColumn("depth", F.lit(1)).unionByName(two.withColumn("depth", F.lit(2)))
    return both.where("node <> other").groupBy("node", "other").agg(F.min("depth").alias("depth"))


def hubs(edges: DataFrame, k: int) -> DataFrame:
    """(node, degree): the k nodes with most edges."""
    ends = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node")))
    return ends.groupBy("node").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "node").limit(k)


def successors(edges: DataFrame, cited: DataFrame) -> DataFrame:
    """cited (key, ...) with the entry that supersedes it, the smallest if there are several, or null."""
    newer = edges.where("type = 'SUPERSEDES'").groupBy(F.col("dst").alias("key")).agg(F.min("src").alias("successor"))
    return cited.join(newer, "key", "left")


def dependency_gaps(cited: DataFrame, needs: DataFrame) -> DataFrame:
    """(basket, item, needed, gap): what the items of each basket need, and whether the basket lacks it."""
    wanted = cited.join(needs, "item").select("basket", "item", "needed").distinct()
    have = cited.select("basket", F.col("item").alias("needed"), F.lit(True).alias("_has")).distinct()
    return wanted.join(have, ["basket", "needed"], "left").select("basket", "item", "needed", F.col("_has").isNull().alias("gap"))


def coverage(gaps: DataFrame, cited: DataFrame) -> DataFrame:
    """(basket, n_items, n_needed, n_gaps, coverage): covered share of items and needs, in percent."""
    n = cited.groupBy("basket").agg(F.count_distinct("item").alias("n_items"))
    g = gaps.groupBy("basket").agg(F.count_distinct("needed").alias("n_needed"), F.count_distinct(F.when(F.col("gap"), F.col("needed"))).alias("n_gaps"))
    out = n.join(g, "basket", "left").na.fill(0, ["n_needed", "n_gaps"])
    return out.withColumn("coverage", F.round(100 * (F.col("n_items") + F.col("n_needed") - F.col("n_gaps")) / (F.col("n_items") + F.col("n_needed")), 1))


def essential_pairs(cited: DataFrame, pairs: DataFrame) -> DataFrame:
    """(basket, have, lack): baskets that hold one item of an essential pair (have, lack) without the other."""
    held = cited.select("basket", F.col("item").alias("have")).distinct().join(pairs, "have")
    return held.join(cited.select("basket", F.col("item").alias("lack")).distinct(), ["basket", "lack"], "left_anti").select("basket", "have", "lack")


def conflicts(rows: DataFrame) -> DataFrame:
    """rows (tender, pos, tag, unit, value, floor): pairs of one tender and tag whose ratings contradict each other.

    Value in base units; a floor is contradicted by less than 95 % of it, two targets by more than 5 % between them."""
    scale = F.create_map(*[F.lit(x) for kv in {"W": 1.0, "kW": 1e3, "MW": 1e6, "V": 1.0, "kV": 1e3, "A": 1.0, "mA": 1e-3}.items() for x in kv])
    dim = F.when(F.col("unit").isin("W", "kW", "MW"), "power").when(F.col("unit").isin("V", "kV"), "voltage").otherwise("current")
    base = rows.select("tender", "pos", "tag", dim.alias("dim"), (F.col("value") * scale[F.col("unit")]).alias("v"), "floor")
    a, b = base.alias("a"), base.alias("b")
    pairs = a.join(b, (F.col("a.tender") == F.col("b.tender")) & (F.col("a.tag") == F.col("b.tag")) & (F.col("a.dim") == F.col("b.dim")) & (F.col("a.pos") < F.col("b.pos")))
    av, bv, af, bf = F.col("a.v"), F.col("b.v"), F.col("a.floor"), F.col("b.floor")
    contra = F.when(af & bf, False).when(af, bv < av * 0.95).when(bf, av < bv * 0.95).otherwise(F.abs(av - bv) / F.greatest(av, bv) > 0.05)
    return pairs.where(contra).select(F.col("a.tender").alias("tender"), F.col("a.tag").alias("tag"), F.col("a.dim").alias("dim"), F.col("a.pos").alias("pos_a"), F.col("b.pos").alias("pos_b"))


def first_by_priority(matches: DataFrame, key: list[str], priority: str, tie: str) -> DataFrame:
    """The match of each key with the lowest priority number."""
    w = Window.partitionBy(*key).orderBy(priority, tie)
    return matches.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
