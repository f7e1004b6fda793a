"""Decisions and their roll-ups: gates, tiers, audits, review queues, readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def critic(scores: DataFrame) -> DataFrame:
    """scores (…, lexical, semantic, rule, evidence, lifecycle) with the composite, its confidence and the decision."""
    c = 0.30 * F.col("lexical") + 0.30 * F.col("semantic") + 0.20 * F.col("rule") + 0.10 * F.col("evidence") + 0.10 * F.col("lifecycle")
    out = scores.withColumn("composite", F.round(c, 4))
    decision = F.when(F.col("lifecycle") == 0, "REVIEW").when(F.col("composite") >= 0.70, "RECOMMEND").when(F.col("composite") >= 0.45, "REVIEW").otherwise("ABSTAIN")
    return out.withColumn("decision", decision).withColumn("risk", F.when(F.col("lifecycle") == 0, "CRITICAL").when(F.col("evidence") < 0.25, "HIGH").when(F.col("decision") == "REVIEW", "MEDIUM").otherwise("LOW"))


def gated(candidates: DataFrame, rules: DataFrame) -> DataFrame:
    """candidates (query, doc, domain_q, domain_d, score) with the first conflict rule (n, domain_q, domain_d, reason) that
    applies, or none, and the decision. The rule table is small and joined on both domains."""
    first = rules.groupBy("domain_q", "domain_d").agg(F.min(F.struct("n", "reason")).alias("r"))
    out = candidates.join(first, ["domain_q", "domain_d"], "left")
    decision = F.when(F.col("r").isNotNull(), "NOT_APPLICABLE").when(F.col("domain_q") == F.col("domain_d"), F.when(F.col("score") >= 0.3, "APPLICABLE").otherwise("UNCERTAIN")).otherwise("UNCERTAIN")
    return out.select("query", "doc", "score", F.coalesce("r.reason", F.lit("")).alias("reason"), decision.alias("decision"))


def ambiguity(ranked: DataFrame, ratio: float = 0.70, delta: float = 0.20) -> DataFrame:
    """ranked (query, rank, doc, score): the state of each query. Competitors have a score of at least ratio times the best's
    and at most delta below it."""
    best = ranked.groupBy("query").agg(F.max("score").alias("best"), F.sort_array(F.collect_list(F.struct(F.col("score"), F.col("doc")))).alias("all"))
    rivals = F.size(F.filter("all", lambda x: (x["score"] >= ratio * F.col("best")) & (F.col("best") - x["score"] <= delta)))
    state = F.when(F.col("best") < 0.2, "INSUFFICIENT_INFORMATION").when(rivals > 1, "COMPETING").otherwise("CLEAR")
    return best.select("query", F.col("best"), rivals.cast("long").alias("rivals"), state.alias("state"))


def tender_audit(rows: DataFrame) -> DataFrame:
    """rows (tender, requirement, risk, decision, evidence, value): counts and sums of each tender, in one aggregation."""
    count = lambda c: F.count_if(c)
    r, d, e = F.col("risk"), F.col("decision"), F.col("evidence")
    return rows.groupBy("tender").agg(
        F.count("*").alias("n"),
        count(d == "RECOMMEND").alias("n_recommended"),
        count(d == "REVIEW").alias("n_review"),
        count(d == "ABSTAIN").alias("n_abstained"),
        count(r == "CRITICAL").alias("n_critical"),
        count(r == "HIGH").alias("n_high"),
        count(e == "NONE").alias("n_no_evidence"),
        count(e == "WEAK").alias("n_weak_evidence"),
        F.round(F.sum("value"), 2).alias("value"),
    )


def readiness(audits: DataFrame) -> DataFrame:
    """audits with the publication state: too little evidence, review required, or ready."""
    little = (F.col("n_no_evidence") > 0) & (F.col("n_no_evidence") >= F.col("n") / 2) | (F.col("n_abstained") == F.col("n"))
    flags = (F.col("n_critical") > 0) | (F.col("n_high") > 0) | (F.col("n_review") > 0) | (F.col("n_abstained") > 0)
    return audits.withColumn("readiness", F.when(little, "INSUFFICIENT_EVIDENCE").when(flags, "REVIEW_REQUIRED").otherwise("READY_FOR_REVIEW"))


def package_rollup(rows: DataFrame) -> DataFrame:
    """rows (package, domain, standard): counts and sorted distinct values of each package."""
    return rows.groupBy("package").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("domain")), ",").alias("domains"), F.count_distinct("standard").alias("standards"))


def review_order(priority: Column, evidence: Column) -> tuple[Column, Column]:
    """Sort keys of the review queue: priority, then how weak the evidence is."""
    p = F.create_map(*[F.lit(x) for kv in {"CRITICAL": 0, "HIGH": 1, "MEDIUM": 2, "LOW": 3}.items() for x in kv])
    e = F.create_map(*[F.lit(x) for kv in {"NONE": 0, "WEAK": 1, "MODERATE": 2, "STRONG": 3}.items() for x in kv])
    return F.coalesce(p[priority], F.lit(9)), F.coalesce(e[evidence], F.lit(9))


def review_progress(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """items (tender, n), decisions (tender, item, decision, at): progress by the latest decision on each item."""
    last = decisions.groupBy("tender", "item").agg(F.max_by("decision", F.struct("at", "decision")).alias("decision"))
    per = last.groupBy("tender").agg(*[F.count_if(F.col("decision") == d).alias(n) for d, n in (("ACCEPT", "accepted"), ("EDIT", "edited"), ("DISMISS", "dismissed"))])
    out = items.join(per, "tender", "left").na.fill(0)
    done = F.col("accepted") + F.col("edited") + F.col("dismissed")
    pending = F.greatest(F.col("n") - done, F.lit(0))
    return out.select("tender", "n", "accepted", "edited", "dismissed", pending.alias("pending"), F.when(pending == 0, "REVIEW_COMPLETE").when(done > 0, "IN_PROGRESS").otherwise("REVIEW_REQUIRED").alias("status"))


def regulatory_status(items: DataFrame, orders: DataFrame, as_of: str) -> DataFrame:
    """items (item, keys array by priority), orders (key, order_id, effective): the first order that a key finds, and whether
    it is in force on the date."""
    asked = items.select("item", F.posexplode("keys").alias("prio", "key"))
    found = asked.join(orders, "key").groupBy("item").agg(F.min(F.struct("prio", "order_id", "effective")).alias("m"))
    out = items.select("item").join(found, "item", "left")
    when = F.to_date(F.lit(as_of))
    status = F.when(F.col("m").isNull(), "NOT_COVERED").when(F.col("m.effective").isNull(), "UNKNOWN").when(when < F.col("m.effective"), "UPCOMING").otherwise("CURRENT")
    return out.select("item", F.col("m.order_id").alias("order_id"), F.col("m.prio").cast("long").alias("prio"), status.alias("status"))
