"""Evaluation of decisions: retrieval metrics, selective risk, intervals, splits and leaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, digits: int = 4) -> Column:
    """100 a / b, rounded; 0 where b is 0."""
    return F.round(F.when(b == 0, 0.0).otherwise(100.0 * a / b), digits)


def retrieval_metrics(cases: DataFrame, by: list[str]) -> DataFrame:
    """cases (expected, rank or null): hits at 1 and 3 and mean reciprocal rank over answerable cases."""
    ans = F.col("expected") == "RECOMMEND"
    n = F.count_if(ans)
    rr = F.when(ans & (F.col("rank") <= 5), 1.0 / F.col("rank")).otherwise(0.0)
    return cases.groupBy(*by).agg(F.count("*").alias("cases"), n.alias("answerable"), ratio(F.count_if(ans & (F.col("rank") == 1)), n).alias("top1"), ratio(F.count_if(ans & (F.col("rank") <= 3)), n).alias("top3"), F.round(F.when(n == 0, 0.0).otherwise(F.sum(rr) / n), 6).alias("mrr"))


def selective_risk(cases: DataFrame, by: list[str]) -> DataFrame:
    """cases (decision, expected, hit): coverage of the cases, and the share of wrong among the covered; false recommendations."""
    covered = F.col("decision").isin("RECOMMEND", "REVIEW")
    negative = F.col("expected") == "ABSTAIN"
    return cases.groupBy(*by).agg(
        F.count("*").alias("cases"),
        F.count_if(covered).alias("covered"),
        ratio(F.count_if(covered), F.count("*")).alias("coverage"),
        ratio(F.count_if(covered & ~F.col("hit")), F.count_if(covered)).alias("risk"),
        ratio(F.count_if(negative & covered), F.count_if(negative)).alias("false_recommendations"),
        ratio(F.count_if(negative & ~covered), F.count_if(negative)).alias("abstention_recall"),
    )


def wilson(k: Column, n: Column, z: float = 1.95996) -> tuple[Column, Column]:
    """Bounds of the share k / n in percent, one digit; null where n is 0."""
    p = k / n
    d = 1 + z * z / n
    mid = (p + z * z / (2 * n)) / d
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    ok = lambda c: F.when(n > 0, F.round(c, 1))
    return ok(F.greatest(F.lit(0.0), 100 * (mid - half))), ok(F.least(F.lit(100.0), 100 * (mid + half)))


def confusion(cases: DataFrame, expected: str, predicted: str) -> DataFrame:
    """(expected, predicted, n, recall, precision) of each pair that occurs."""
    n = cases.groupBy(F.col(expected).alias("expected"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    return n.withColumn("recall", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("expected")), 6)).withColumn("precision", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("predicted")), 6))


def group_split(groups: DataFrame, group: str, seed: int, train: float = 0.6, val: float = 0.2) -> DataFrame:
    """(group, part): whole groups to train, val and test, in the order of a seeded hash. Groups are ordered within the 4096 beginnings
    of the hash; what is summed in one place and broadcast are the sizes of those."""
    hashed = F.coalesce(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("grp")), 256), F.lit(""))
    g = groups.select(F.col(group).alias("grp")).distinct().withColumn("hash", hashed).withColumn("head", F.substring("hash", 1, 3))
    sizes = g.groupBy("head").agg(F.count("*").alias("size"))
    sizes = sizes.select("head", (F.sum("size").over(Window.orderBy("head")) - F.col("size")).alias("before"), F.sum("size").over(Window.partitionBy(F.lit(0))).alias("n"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("head").orderBy("hash"))
    n = F.col("n")
    g = g.join(F.broadcast(sizes), "head")
    share = place / n
    return g.select("grp", F.when(share <= train, "train").when(share <= train + val, "val").otherwise("test").alias("part"))


def leaks(rows: DataFrame, key: str, text: Column, part: str) -> DataFrame:
    """(value, parts, n): texts that occur in several parts of a split."""
    return rows.groupBy(text.alias("value")).agg(F.count_distinct(part).alias("parts"), F.count("*").alias("n"), F.min(key).alias("first_key")).where("parts > 1")


def probe_metrics(probes: DataFrame) -> DataFrame:
    """probes (category, passed): failures by category with numerator, denominator and whether 95 % pass."""
    out = probes.groupBy("category").agg(F.count_if("passed").alias("numerator"), F.count("*").alias("denominator"))
    return out.withColumn("rate", ratio(F.col("numerator"), F.col("denominator"))).withColumn("met", F.col("rate") >= 95)
