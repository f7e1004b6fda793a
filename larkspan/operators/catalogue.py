"""The catalogue: quarantine, dedupe, distributions, snapshots and their differences, editions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_errors(df: DataFrame, rules: dict[str, Column], out: str = "errors") -> DataFrame:
    """df with the names of the rules that a row breaks; a rule that is null counts as broken."""
    return df.withColumn(out, F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])))


def split_valid(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that break no rule, and the quarantined others with their errors."""
    marked = with_errors(df, rules)
    return marked.where(F.size("errors") == 0).drop("errors"), marked.where(F.size("errors") > 0)


def deduped(df: DataFrame, key: str, order: list[str], seed: str, keep: list[str]) -> DataFrame:
    """A row for each key: the first seen (by order) of the kept columns, occurrences, distinct seeds in ascending order."""
    first = F.min_by(F.struct(*keep), F.struct(*order))
    out = df.groupBy(key).agg(first.alias("f"), F.count("*").alias("occurrences"), F.sort_array(F.collect_set(seed)).alias("seeds"), F.min(F.struct(*order)).alias("o"))
    return out.select(key, *[F.col(f"f.{c}").alias(c) for c in keep], "occurrences", "seeds")


def distribution(df: DataFrame, column: str) -> DataFrame:
    """(value, n, share): share in percent of all rows."""
    n = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 4))


def snapshot_diff(previous: DataFrame, current: DataFrame, key: str, tracked: list[str], status: str) -> DataFrame:
    """(key, change_type, changed_fields, previous_values, new_values) of every key; null equals the empty string.

    One full outer join on the key; each side needs its key once."""
    text = lambda s, c: F.coalesce(F.col(f"{s}.{c}").cast("string"), F.lit(""))
    p, q = previous.withColumn("_here", F.lit(1)).alias("p"), current.withColumn("_here", F.lit(1)).alias("q")
    both = p.join(q, F.col(f"p.{key}") == F.col(f"q.{key}"), "full_outer")
    fields = F.array_compact(F.array(*[F.when(text("p", c) != text("q", c), F.lit(c)) for c in tracked]))
    kind = (
        F.when(F.col("p._here").isNull(), "NEW")
        .when(F.col("q._here").isNull(), "MISSING_FROM_SOURCE")
        .when(F.size(fields) == 0, "UNCHANGED")
        .when((text("p", status) != text("q", status)) & (text("q", status) == "WITHDRAWN"), "WITHDRAWN")
        .when((text("p", status) != text("q", status)) & (text("q", status) == "SUPERSEDED"), "SUPERSEDED")
        .when(text("p", status) != text("q", status), "STATUS_CHANGED")
        .otherwise("UPDATED")
    )
    values = lambda s: F.map_filter(F.map_from_arrays(F.array(*[F.lit(c) for c in tracked]), F.array(*[text(s, c) for c in tracked])), lambda k, v: F.array_contains(fields, k))
    changed = F.when(F.col("p._here").isNull(), F.array(F.lit("ALL"))).when(F.col("q._here").isNull(), F.array(F.lit("presence"))).otherwise(fields)
    fresh, gone = F.col("p._here").isNull(), F.col("q._here").isNull()
    every = F.map_from_arrays(F.array(*[F.lit(c) for c in tracked]), F.array(*[text("q", c) for c in tracked]))
    old = F.when(fresh, None).when(gone, F.create_map(F.lit("presence"), F.lit("PRESENT"), F.lit("status"), text("p", status))).otherwise(values("p"))
    new = F.when(fresh, every).when(gone, F.create_map(F.lit("presence"), F.lit("MISSING_FROM_SOURCE"))).otherwise(values("q"))
    return both.select(F.coalesce(F.col(f"p.{key}"), F.col(f"q.{key}")).alias(key), kind.alias("change_type"), changed.alias("changed_fields"), old.alias("previous_values"), new.alias("new_values"))


def manifest(changes: DataFrame) -> DataFrame:
    """One row: how many entries are new, changed, unchanged and gone."""
    is_ = lambda *t: F.sum(F.when(F.col("change_type").isin(*t), 1).otherwise(0))
    return changes.agg(is_("NEW").alias("n_new"), is_("UPDATED", "STATUS_CHANGED", "WITHDRAWN", "SUPERSEDED").alias("n_updated"), is_("UNCHANGED").alias("n_unchanged"), is_("MISSING_FROM_SOURCE").alias("n_removed"), F.count("*").alias("n_all"))


def best_edition(df: DataFrame, group: list[str], status: str, year: str, key: str) -> DataFrame:
    """The row of each group with the best status (active, superseded, other, withdrawn), then the latest year, and the number of editions."""
    rank = F.when(F.col(status) == "ACTIVE", 0).when(F.col(status) == "SUPERSEDED", 1).when(F.col(status) == "WITHDRAWN", 3).otherwise(2)
    w = Window.partitionBy(*group)
    return df.withColumn("editions", F.count("*").over(w)).withColumn("_n", F.row_number().over(w.orderBy(rank, F.desc(year), F.desc(key)))).where("_n = 1").drop("_n")


def upserted(old: DataFrame, new: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """old with new's rows: columns that new leaves null keep their old value, keys that are new are added."""
    o, n = old.alias("o"), new.alias("n")
    on = reduce(lambda a, b: a & b, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in key])
    return o.join(n, on, "full_outer").select(*[F.coalesce(F.col(f"n.{k}"), F.col(f"o.{k}")).alias(k) for k in [*key, *columns]])


def duplicates(df: DataFrame, value: Column, key: str) -> DataFrame:
    """(value, n, first_key) of values that occur more than once."""
    return df.groupBy(value.alias("value")).agg(F.count("*").alias("n"), F.min(key).alias("first_key")).where("n > 1")


def per_group_limit(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def latest_snapshot(names: DataFrame, name: str) -> DataFrame:
    return names.agg(F.max(name).alias(name))
