"""Mixing sources to target weights by hierarchical budgeting, in DataFrame and SQL functions only.

The tree is domain - language - source. A budget of tokens goes down it level by level: children share their parent's
budget by weight, none gets more than it can supply (its tokens times the epochs allowed), and what a child can't use goes
to its siblings by weight. A node's supply is the sum of its leaves', so a shortage leaves a node, for its ancestors' other
branches, only after all siblings are used up. Shares are whole tokens by exact integer arithmetic; the odd tokens go to the
largest remainders.

A leaf reads its documents in seeded epochs: in each, documents are ordered by a hash of seed, epoch and doc_id. It takes
whole epochs while its budget lasts and then a prefix of the next; the document at the end is cut to the tokens left. The
prefix is found without ordering a leaf: tokens are summed by the first digits of the hash, the sums say in which bucket
the prefix ends, and only that bucket (1/4096 of the leaf) is ordered.

Defined results: a null text counts as empty and has no tokens; null domain, language or source is the value '' of its
level; rows that repeat a doc_id are taken in the order of their text's hash; a null doc_id hashes as ''; documents without
tokens are taken in every whole epoch and within the prefix; a weight missing from the tables is 1, and one of 0 or less
gets nothing; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspan.llm._common import blank, cut, table

SEED, EPOCHS, SHARE, DIGITS = "larkspan-1", 3, 0.8, 3
LEVELS = ("domain", "lang", "source")
WHOLE = "decimal(38,0)"
#: production weights, by level and value; whole numbers
WEIGHTS = {"domain": {"d0": 4, "d1": 2, "d2": 2, "d3": 2}, "lang": {"en": 6, "fr": 2, "de": 2, "es": 1}, "source": {}}


def domain_of(source: Column) -> Column:
    """Sources belong to four domains, by the number at the end of their name; others to d3."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1)
    return F.when(number == "", F.lit("d3")).otherwise(F.concat(F.lit("d"), F.pmod(number.cast("int"), F.lit(4)).cast("string")))


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def shared(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """nodes (..., w, cap, budget of the parent) with got: each child's share of its parent's budget, by weight and within
    cap. In the order of cap / w the first children are used up while the rest, at equal terms, still could take more."""
    dec = lambda c: F.col(c).cast(WHOLE)
    order = Window.partitionBy(*parent).orderBy(F.col("cap").cast("double") / F.col("w").cast("double"), F.col("cap"), *[F.col(c) for c in LEVELS if c in nodes.columns])
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*parent)
    nodes = nodes.withColumn("cap", F.when(F.col("w") > 0, F.col("cap")).otherwise(F.lit(0).cast("long"))).withColumn("w", F.greatest(F.col("w"), F.lit(0)).cast("long"))
    ahead = nodes.where("w > 0").withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("w_from", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    # used up: cap <= (budget - caps before) * w / (weights from here)
    ahead = ahead.withColumn("left", F.greatest(F.col("budget") - F.col("cap_before"), F.lit(0)).cast("long"))
    ahead = ahead.withColumn("full", dec("cap") * dec("w_from") <= dec("left") * dec("w"))
    # children before the first that isn't used up are; the same test holds for none after it
    ahead = ahead.withColumn("open", F.max(F.when(~F.col("full"), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ahead = ahead.withColumn("rest", F.col("budget") - F.sum(F.when(F.col("open") == 0, F.col("cap")).otherwise(0)).over(every)).withColumn("w_open", F.sum(F.when(F.col("open") == 1, F.col("w")).otherwise(0)).over(every))
    ahead = ahead.withColumn("whole", F.when(F.col("open") == 1, F.expr(f"cast((cast(rest as {WHOLE}) * w) div w_open as bigint)")).otherwise(F.col("cap")))
    ahead = ahead.withColumn("odd", F.when(F.col("open") == 1, F.expr(f"cast((cast(rest as {WHOLE}) * w) % w_open as bigint)")).otherwise(F.lit(-1)))
    ahead = ahead.withColumn("spare", F.col("rest") - F.sum(F.when(F.col("open") == 1, F.col("whole")).otherwise(0)).over(every))
    nth = F.row_number().over(Window.partitionBy(*parent).orderBy(F.desc("odd"), *[F.col(c) for c in LEVELS if c in nodes.columns]))
    ahead = ahead.withColumn("got", F.col("whole") + F.when((F.col("open") == 1) & (nth <= F.col("spare")), 1).otherwise(0))
    return ahead


def weighted(df: DataFrame, level: str, weights: dict) -> Column:
    pairs = [F.lit(x) for k, v in weights.get(level, {}).items() for x in (k, int(v))]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.col(level)), F.lit(1)) if pairs else F.lit(1)


def budgets(leaves: DataFrame, total: Column | int, weights: dict, epochs: int = EPOCHS) -> DataFrame:
    """(domain, lang, source, tokens, budget) of the leaves (domain, lang, source, tokens)."""
    leaf = leaves.withColumn("cap", F.col("tokens") * epochs)
    d = leaf.groupBy("domain").agg(F.sum("cap").alias("cap"))
    every = Window.partitionBy(F.lit(0))
    total = F.lit(total) if isinstance(total, int) else total
    d = d.withColumn("budget", F.least(total.cast("long"), F.sum("cap").over(every))).withColumn("w", weighted(d, "domain", weights)).withColumn("all", F.lit(0))
    d = shared(d, ["all"]).select("domain", F.col("got").alias("budget"))
    g = leaf.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).join(d, "domain")
    g = shared(g.withColumn("budget", F.least("budget", F.sum("cap").over(Window.partitionBy("domain")))).withColumn("w", weighted(g, "lang", weights)), ["domain"]).select("domain", "lang", F.col("got").alias("budget"))
    s = leaf.join(g, ["domain", "lang"])
    s = shared(s.withColumn("budget", F.least("budget", F.sum("cap").over(Window.partitionBy("domain", "lang")))).withColumn("w", weighted(s, "source", weights)), ["domain", "lang"])
    return s.select(*LEVELS, "tokens", F.col("got").alias("budget"))


def mix(docs: DataFrame, weights: dict = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", domain=domain_of, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, domain, lang, source, epoch, n_tokens, taken[, kept columns]): a row for each time a document is taken, with
    the tokens taken of it. The budget is `share` of all tokens. keep: columns of docs that go along."""
    at = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(domain(F.col(source)), F.lit("")).alias("domain"),
        at(lang).alias("lang"),
        at(source).alias("source"),
        token_count(blank(text)).alias("n_tokens"),
        F.md5(blank(text)).alias("tie"),
        *([F.struct(*[F.col(c) for c in keep]).alias("row")] if keep else []),
    )
    slim = cut(rows.select("doc_id", *LEVELS, "n_tokens", "tie"))
    taking = rows if keep else slim  # with columns to keep, documents are read again: only sums were written
    leaves = slim.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    total = leaves.select(F.sum("tokens").alias("n")).first().n or 0
    plan = budgets(leaves, int(total) * int(round(share * 1000)) // 1000, weights, epochs)
    plan = plan.withColumn("whole", F.expr("case when tokens > 0 then budget div tokens else 0 end")).withColumn("part", F.expr("case when tokens > 0 then budget % tokens else 0 end"))
    plan = cut(plan.select(*LEVELS, F.col("whole").cast("int").alias("whole"), "part"))
    taken = ("doc_id", *LEVELS, "n_tokens", "tie", *(["row"] if keep else []))
    mark = F.md5(F.concat_ws(":", F.lit(seed), F.col("whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    into = lambda df: df.withColumn("mark", mark).withColumn("bucket", F.substring("mark", 1, DIGITS))
    sums = into(slim.join(plan.where("part > 0"), list(LEVELS))).groupBy(*LEVELS, "part", "bucket").agg(F.sum("n_tokens").alias("n"))
    run = F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("bucket"))
    edges = sums.withColumn("begin", run - F.col("n")).where("begin < part").select(*LEVELS, "bucket", "begin", (F.col("part") - F.col("begin") >= F.col("n")).alias("inside"))
    # of each leaf: all buckets before the last are inside, the last may be cut
    last = edges.groupBy(*LEVELS).agg(F.max(F.struct("bucket", "begin", "inside")).alias("last")).select(*LEVELS, "last.*").withColumnRenamed("bucket", "edge")
    # written, a row for each leaf: its size is known when documents with their texts meet it, and so they needn't be shuffled
    limits = cut(plan.join(last, list(LEVELS), "left"))
    placed = into(taking.join(limits, list(LEVELS)))
    within = F.coalesce(F.expr("part > 0 and (bucket < edge or bucket = edge and inside)"), F.lit(False)).cast("int")
    entire = placed.withColumn("times", F.col("whole") + within).where("times > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("times") - 1))).select(*taken, "epoch", F.col("n_tokens").alias("taken"))
    order = Window.partitionBy(*LEVELS).orderBy("mark", "tie")
    cutting = placed.where("part > 0 and bucket = edge and not inside").withColumn("run", F.col("begin") + F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_tokens"))
    cutting = cutting.where("run < part").select(*taken, F.col("whole").alias("epoch"), F.least(F.col("n_tokens"), F.col("part") - F.col("run")).alias("taken"))
    out = entire.unionByName(cutting)
    return out if keep else out.drop("tie")


def mixed_documents(docs: DataFrame, text: str = "text", **settings) -> DataFrame:
    """docs as taken: rows of several epochs repeat, and a document cut at the end of a prefix holds the words taken."""
    out = mix(docs, text=text, keep=docs.columns, **settings)
    cut_text = F.expr(f"regexp_extract(row.`{text}`, concat(r'^(?:[\\x20\\x09-\\x0D]*+[^\\x20\\x09-\\x0D]++){{', cast(taken as string), r'}}+'), 0)")
    text_of = F.when(F.col("taken") < F.col("n_tokens"), cut_text).otherwise(F.col(f"row.`{text}`"))
    return out.select(*[text_of.alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", *LEVELS, F.col("epoch").cast("long").alias("epoch"), "n_tokens", F.col("taken").cast("long").alias("taken"))


def _level_sql(name: str, parent: str, keys: str, nodes: str) -> str:
    """CTEs that share each parent's budget among nodes (keys, cap, w, budget); the last is name."""
    order = f"partition by {parent} order by cap::double / w, cap, {keys}"
    return f"""
{name}_n as ({nodes}),
{name}_a as (select *, coalesce(sum(cap) over ({order} rows between unbounded preceding and 1 preceding), 0) cap_before,
  sum(w) over (partition by {parent}) - coalesce(sum(w) over ({order} rows between unbounded preceding and 1 preceding), 0) w_from from {name}_n where w > 0),
{name}_f as (select *, cap * w_from <= greatest(budget - cap_before, 0) * w as used_up from {name}_a),
{name}_o as (select *, max(case when used_up then 0 else 1 end) over ({order} rows between unbounded preceding and current row) as is_open from {name}_f),
{name}_r as (select *, budget - sum(case when is_open = 0 then cap else 0 end) over (partition by {parent}) rest, sum(case when is_open = 1 then w else 0 end) over (partition by {parent}) w_open from {name}_o),
{name}_w as (select *, case when is_open = 1 then rest * w // w_open else cap end whole, case when is_open = 1 then rest * w % w_open else -1 end odd from {name}_r),
{name}_s as (select *, rest - sum(case when is_open = 1 then whole else 0 end) over (partition by {parent}) spare, row_number() over (partition by {parent} order by odd desc, {keys}) nth from {name}_w),
{name} as (select {keys}, (whole + case when is_open = 1 and nth <= spare then 1 else 0 end) budget from {name}_s)"""


def _weight_sql(level: str) -> str:
    cases = " ".join(f"when '{k}' then {int(v)}" for k, v in WEIGHTS[level].items())
    return f"case {level} {cases} else 1 end" if cases else "1"


OP1_SQL = (
    rf"""
with d as (select doc_id, coalesce(text, '') t, regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) num, coalesce(lang, '') lang, coalesce(source, '') source from documents),
docs as (select doc_id, md5(t) tie, case when num = '' then 'd3' else 'd' || (num::int % 4) end as domain, lang, source, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) n_tokens from d),
leaf as (select domain, lang, source, sum(n_tokens) tokens, sum(n_tokens) * {EPOCHS} cap from docs group by all),
goal as (select sum(tokens) * {int(round(SHARE * 1000))} // 1000 total, sum(cap) cap from leaf),"""
    + _level_sql("dom", "1", "domain", f"select domain, sum(leaf.cap) cap, {_weight_sql('domain')} w, least(any_value(total), any_value(goal.cap)) budget from leaf, goal group by domain")
    + ","
    + _level_sql("lng", "domain", "domain, lang", f"select domain, lang, sum(cap) cap, {_weight_sql('lang')} w, any_value(budget) budget from leaf join dom using (domain) group by domain, lang")
    + ","
    + _level_sql("src", "domain, lang", "domain, lang, source", f"select domain, lang, source, cap, {_weight_sql('source')} w, budget from leaf join lng using (domain, lang)")
    + f""",
plan as (select domain, lang, source, budget // tokens as epochs, budget % tokens part from src join leaf using (domain, lang, source) where tokens > 0),
placed as (select docs.*, epochs, part from docs join plan using (domain, lang, source)),
marked as (select *, md5('{SEED}:' || epochs || ':' || coalesce(doc_id::varchar, '')) mark from placed where part > 0),
run as (select *, sum(n_tokens) over (partition by domain, lang, source order by mark, tie rows unbounded preceding) - n_tokens at from marked)
select doc_id, domain, lang, source, epoch, n_tokens, n_tokens taken from (select *, unnest(range(epochs::bigint)) epoch from placed)
union all select doc_id, domain, lang, source, epochs::bigint, n_tokens, least(n_tokens, part - at)::bigint from run where at < part
"""
).replace(" at from marked", ' as "at" from marked').replace("part - at)", 'part - "at")').replace("where at <", 'where "at" <')
