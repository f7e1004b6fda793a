"""Graph, decision, audit, evaluation and event plans over the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.functions import idents as I
from larkspan.operators import audit as A
from larkspan.operators import evaluation as E
from larkspan.operators import graph as G
from larkspan.plans.common import Query, table
from larkspan.streaming import events as S


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relationships of entries: parts of lineitem to others, under active and passive names."""
    return table(spark, sf_dir, "lineitem").selectExpr("l_partkey % 400 src", "(l_partkey * 7 + l_suppkey) % 400 dst", "case l_linenumber when 1 then 'superseded_by' when 2 then 'SUPERSEDES' when 3 then ' cites ' when 4 then 'REFERENCES' else 'RELATED' end type").where("src <> dst").distinct()


EDGES = """e0 as (select distinct l_partkey % 400 src, (l_partkey * 7 + l_suppkey) % 400 dst, case l_linenumber when 1 then 'SUPERSEDED_BY' when 2 then 'SUPERSEDES' when 3 then 'CITES' when 4 then 'REFERENCES' else 'RELATED' end t from lineitem where l_partkey % 400 <> (l_partkey * 7 + l_suppkey) % 400),
e as (select case when t = 'SUPERSEDED_BY' then dst else src end src, case when t = 'SUPERSEDED_BY' then src else dst end dst, case t when 'SUPERSEDED_BY' then 'SUPERSEDES' when 'CITES' then 'REFERENCES' else t end as type from e0)"""


def some_nodes(spark: SparkSession) -> DataFrame:
    return spark.range(0, 400, 20).toDF("node")


def neighbours_1hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF-06, JN-01, STR-14, D16: neighbours of twenty entries, both ways."""
    return G.neighbours(G.canonical_edges(edges(spark, sf_dir)), some_nodes(spark))


def traverse_2hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF-03: what references reach in two steps."""
    e = G.canonical_edges(edges(spark, sf_dir)).where("type = 'REFERENCES'")
    return G.walked(e, some_nodes(spark)).withColumn("depth", F.col("depth").cast("long"))


def hub_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-31: the entries with most relationships."""
    return G.hubs(G.canonical_edges(edges(spark, sf_dir)), 15)


def supersede_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GAT-01, JN-04: cited entries and what supersedes them."""
    cited = spark.range(0, 400, 3).toDF("key")
    return G.successors(G.canonical_edges(edges(spark, sf_dir)), cited)


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey basket", "l_partkey % 40 item")


def needs(spark: SparkSession) -> DataFrame:
    return spark.range(0, 40, 2).selectExpr("id item", "explode(array((id + 1) % 40, (id * 3) % 40)) needed").where("item <> needed")


NEEDS = "needs as (select distinct item, needed from (select r item, unnest([(r + 1) % 40, (r * 3) % 40]) needed from range(0, 40, 2) t(r)) where item <> needed), cited as (select l_orderkey basket, l_partkey % 40 item from lineitem)"


def dependency_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GAT-20, JN-12, FLT-22: needs of basket items that the basket lacks."""
    return G.dependency_gaps(baskets(spark, sf_dir), needs(spark)).groupBy("item", "needed").agg(F.count("*").alias("n"), F.count_if("gap").alias("gaps"))


def coverage_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-14: covered share of each basket."""
    b = baskets(spark, sf_dir)
    return G.coverage(G.dependency_gaps(b, needs(spark)), b)


def essential_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GAT-22, JN-11: baskets with one of a pair."""
    pairs = spark.createDataFrame([(1, 2), (5, 9), (10, 30)], "have bigint, lack bigint")
    return G.essential_pairs(baskets(spark, sf_dir), pairs)


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey tender", "l_linenumber pos", "l_returnflag tag", "case l_linenumber % 3 when 0 then 'kW' when 1 then 'W' else 'kV' end unit", "case l_linenumber % 3 when 1 then l_quantity * 1000 else l_quantity end value", "l_linestatus = 'F' and l_linenumber % 2 = 0 floor").groupBy("tender", "pos").agg(F.min("tag").alias("tag"), F.min("unit").alias("unit"), F.min("value").alias("value"), F.bool_or("floor").alias("floor"))


def pairwise_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GAT-19, JN-13, NUM-09, NUM-10: contradicting ratings within a tender."""
    return G.conflicts(ratings(spark, sf_dir)).selectExpr("tender", "tag", "dim", "cast(pos_a as bigint) pos_a", "cast(pos_b as bigint) pos_b")


def conflict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-29: conflicts by kind."""
    return G.conflicts(ratings(spark, sf_dir)).groupBy("tag", "dim").agg(F.count("*").alias("n"), F.count_distinct("tender").alias("tenders"))


def requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as requirements of tenders."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_custkey tender", "o_orderkey requirement", "case substring(o_orderpriority, 1, 1) when '1' then 'CRITICAL' when '2' then 'HIGH' when '3' then 'MEDIUM' else 'LOW' end risk",
        "case o_orderstatus when 'O' then 'RECOMMEND' when 'F' then 'REVIEW' else 'ABSTAIN' end decision", "case o_orderkey % 4 when 0 then 'NONE' when 1 then 'WEAK' when 2 then 'MODERATE' else 'STRONG' end evidence", "o_totalprice value", "o_orderdate",
    )


REQUIREMENTS = "r as (select o_custkey tender, o_orderkey requirement, case substring(o_orderpriority, 1, 1) when '1' then 'CRITICAL' when '2' then 'HIGH' when '3' then 'MEDIUM' else 'LOW' end risk, case o_orderstatus when 'O' then 'RECOMMEND' when 'F' then 'REVIEW' else 'ABSTAIN' end decision, case o_orderkey % 4 when 0 then 'NONE' when 1 then 'WEAK' when 2 then 'MODERATE' else 'STRONG' end evidence, o_totalprice as value, o_orderdate from orders)"
AUDIT = "a as (select tender, count(*) n, count(*) filter (decision = 'RECOMMEND') n_recommended, count(*) filter (decision = 'REVIEW') n_review, count(*) filter (decision = 'ABSTAIN') n_abstained, count(*) filter (risk = 'CRITICAL') n_critical, count(*) filter (risk = 'HIGH') n_high, count(*) filter (evidence = 'NONE') n_no_evidence, count(*) filter (evidence = 'WEAK') n_weak_evidence, round(sum(value), 2) as value from r group by tender)"


def tender_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-10, AGG-12, AGG-13: counters of each tender."""
    return A.tender_audit(requirements(spark, sf_dir))


def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GAT-18: publication state of each tender."""
    return A.readiness(A.tender_audit(requirements(spark, sf_dir))).select("tender", "n", "readiness")


def package_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-11, ARR-01: packages of tenders."""
    return A.package_rollup(requirements(spark, sf_dir).selectExpr("tender % 50 package", "evidence domain", "requirement % 97 standard"))


def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP-07: the hundred items to review first."""
    q = requirements(spark, sf_dir).where("decision <> 'RECOMMEND'")
    p, e = A.review_order(F.col("risk"), F.col("evidence"))
    return q.orderBy(p, e, "requirement").limit(100).select("tender", "requirement", "risk", "evidence")


def review_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-30, JN-15: progress of reviews by the latest decisions."""
    items = requirements(spark, sf_dir).where("decision <> 'RECOMMEND'").groupBy("tender").agg(F.count("*").alias("n"))
    d = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).where("o_orderstatus <> 'O' and o_custkey % 3 <> 0")
    d = d.selectExpr("o_custkey tender", "o_orderkey item", "case l_returnflag when 'A' then 'ACCEPT' when 'N' then 'EDIT' else 'DISMISS' end decision", "l_shipdate at")
    return A.review_progress(items, d)


def regulatory_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GAT-28, JN-05, JN-17, DAT-02, SRC-17: the order in force for each customer, by key, then nation, then segment."""
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey item", "array(concat('C', c_custkey), concat('N', c_nationkey), c_mktsegment) keys")
    o = table(spark, sf_dir, "orders").selectExpr("case o_orderkey % 3 when 0 then concat('C', o_custkey) when 1 then concat('N', o_custkey % 10) else 'MACHINERY' end key", "o_orderkey order_id", "case when o_orderkey % 7 = 0 then null else to_date(o_orderdate) end effective")
    return A.regulatory_status(c, o.groupBy("key").agg(F.min(F.struct("order_id", "effective")).alias("o")).select("key", "o.order_id", "o.effective"), "1998-06-01")


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluated cases: labelled documents, what was expected of them and what a hash decided."""
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    return d.selectExpr("doc_id", "source", "lang", "case when toxic = 1 then 'ABSTAIN' when quality = 1 then 'RECOMMEND' else 'REVIEW' end expected", "case doc_id % 5 when 0 then 'ABSTAIN' when 1 then 'REVIEW' else 'RECOMMEND' end decision", "case when doc_id % 6 < 5 then doc_id % 6 + 1 end rank", "doc_id % 4 <> 0 hit")


CASES = "c as (select doc_id, source, lang, case when toxic = 1 then 'ABSTAIN' when quality = 1 then 'RECOMMEND' else 'REVIEW' end expected, case doc_id % 5 when 0 then 'ABSTAIN' when 1 then 'REVIEW' else 'RECOMMEND' end decision, case when doc_id % 6 < 5 then doc_id % 6 + 1 end as rank, doc_id % 4 <> 0 hit from labels join documents using (doc_id))"


def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-15, AGG-33, AGG-35, GAT-27: hits and mean reciprocal rank by language."""
    return E.retrieval_metrics(cases(spark, sf_dir), ["lang"])


def sector_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-19: the same by source."""
    return E.retrieval_metrics(cases(spark, sf_dir), ["source"])


def selective_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-16, AGG-17, NUM-15: coverage and risk by language."""
    return E.selective_risk(cases(spark, sf_dir), ["lang"])


def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-20, AGG-22: expected against decided."""
    return E.confusion(cases(spark, sf_dir), "expected", "decision")


def wilson_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-23, AGG-24: intervals of the hit rate by source."""
    n = cases(spark, sf_dir).groupBy("source").agg(F.count_if("hit").alias("k"), F.count("*").alias("n"))
    lo, hi = E.wilson(F.col("k"), F.col("n"))
    return n.select("source", "k", "n", lo.alias("lower"), hi.alias("upper"))


def adversarial_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-25, AGG-26, GAT-25: pass rates of probes by category."""
    return E.probe_metrics(cases(spark, sf_dir).selectExpr("lang category", "decision = expected or hit passed"))


def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQ-01, SET-05: sources dealt to train, val and test."""
    return E.group_split(table(spark, sf_dir, "documents"), "source", 42)


def leak_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQ-02, DQ-04: texts that are in several parts of the split."""
    d = table(spark, sf_dir, "documents").join(group_split(spark, sf_dir), F.col("source") == F.col("grp"))
    return E.leaks(d, "doc_id", I.canonical_hash(F.col("text")), "part")


def critic_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GAT-06, GAT-07, GAT-13, GAT-14, NUM-12: composite, decision and risk of candidates."""
    s = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_size / 50.0d lexical", "(p_partkey % 100) / 100.0d semantic", "(p_partkey % 7) / 7.0d rule", "(p_partkey % 5) / 5.0d evidence", "case when p_partkey % 9 = 0 then 0.0d else 1.0d end lifecycle")
    return A.critic(s).select("p_partkey", "composite", "decision", "risk")


def applicability_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GAT-02, GAT-03, STR-26, NUM-11: candidates of every nation against conflict rules."""
    c = table(spark, sf_dir, "customer").selectExpr("c_nationkey query", "c_custkey doc", "case c_nationkey % 3 when 0 then 'BUILDING' when 1 then 'MACHINERY' else 'FURNITURE' end domain_q", "c_mktsegment domain_d", "c_acctbal / 10000.0d score")
    rules = spark.createDataFrame([(1, "BUILDING", "FURNITURE", "MATERIAL_MISMATCH"), (2, "MACHINERY", "BUILDING", "SCOPE_MISMATCH"), (3, "BUILDING", "FURNITURE", "LATER_RULE")], "n int, domain_q string, domain_d string, reason string")
    return A.gated(c, rules).groupBy("query", "reason", "decision").agg(F.count("*").alias("n"))


def ambiguity_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GAT-04, GAT-05, D4: states by the number of competing candidates."""
    r = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("query"), F.col("l_partkey").alias("doc")).agg(F.max(F.round(F.col("l_quantity") / 50, 4)).alias("score"))
    return A.ambiguity(r)


def events_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by user and type, each second once (the batch form of the streaming operator)."""
    e = table(spark, sf_dir, "events").withColumn("second", F.date_trunc("second", F.col("ts").cast("timestamp")))
    return S.deduped(e, ["user_id", "event_type", "second"]).groupBy("event_type").agg(F.count("*").alias("n"))


def events_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each hour."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return S.tumbling(e, "1 hour", ["event_type"], "value").select(F.unix_timestamp("start").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


def events_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users with pauses of less than half an hour."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return S.sessions(e, "30 minutes", "user_id").groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (neighbours_1hop, traverse_2hop, hub_degree, supersede_resolve, dependency_gaps, coverage_pct, essential_pairs, pairwise_conflicts, conflict_counts, tender_audit, readiness, package_rollup, review_queue, review_progress, regulatory_status, retrieval_metrics, sector_strata, selective_risk, confusion, wilson_ci, adversarial_metrics, group_split, leak_audit, critic_score, applicability_gate, ambiguity_state, events_dedupe, events_tumbling, events_session)}

RATINGS = "t as (select l_orderkey tender, l_linenumber pos, min(l_returnflag) tag, min(case l_linenumber % 3 when 0 then 'kW' when 1 then 'W' else 'kV' end) unit, min(case l_linenumber % 3 when 1 then l_quantity * 1000 else l_quantity end) v, bool_or(l_linestatus = 'F' and l_linenumber % 2 = 0) f from lineitem group by all), b as (select tender, pos, tag, case when unit = 'kV' then 'voltage' else 'power' end dim, case unit when 'W' then v else v * 1000 end v, f from t), x as (select a.tender, a.tag, a.dim, a.pos::bigint pos_a, b.pos::bigint pos_b from b a join b b on a.tender = b.tender and a.tag = b.tag and a.dim = b.dim and a.pos < b.pos where case when a.f and b.f then false when a.f then b.v < a.v * 0.95::double when b.f then a.v < b.v * 0.95::double else abs(a.v - b.v) / greatest(a.v, b.v) > 0.05::double end)"
METRICS = "select {0}, count(*) cases, count(*) filter (expected = 'RECOMMEND') answerable, round(coalesce(100.0::double * count(*) filter (expected = 'RECOMMEND' and rank = 1) / nullif(count(*) filter (expected = 'RECOMMEND'), 0), 0), 4) top1, round(coalesce(100.0::double * count(*) filter (expected = 'RECOMMEND' and rank <= 3) / nullif(count(*) filter (expected = 'RECOMMEND'), 0), 0), 4) top3, round(coalesce(sum(case when expected = 'RECOMMEND' and rank <= 5 then 1.0::double / rank else 0 end) / nullif(count(*) filter (expected = 'RECOMMEND'), 0), 0), 6) mrr from c group by {0}"
SPLIT = "g as (select distinct source grp from documents), s as (select grp, row_number() over (order by sha256('42:' || grp)) / count(*) over ()::double share from g), p as (select grp, case when share <= 0.6::double then 'train' when share <= 0.8::double then 'val' else 'test' end part from s)"

SQL: dict[str, str] = {
    "neighbours_1hop": f"with {EDGES}, n as (select r node from range(0, 400, 20) t(r)) select node, dst other, type, 'OUT' direction from n join e on node = src union select node, src, type, 'IN' from n join e on node = dst",
    "traverse_2hop": f"with {EDGES}, s as (select distinct src, dst from e where type = 'REFERENCES'), n as (select r node from range(0, 400, 20) t(r)), o as (select node, dst other, 1 d from n join s on node = src), w as (select * from o union all select node, dst, 2 from o join s on other = src) select node, other, min(d)::bigint depth from w where node <> other group by all",
    "hub_degree": f"with {EDGES} select node, count(*) degree from (select src node from e union all select dst from e) group by node order by degree desc, node limit 15",
    "supersede_resolve": f"with {EDGES} select r as key, min(src) successor from range(0, 400, 3) t(r) left join e on dst = r and type = 'SUPERSEDES' group by r",
    "dependency_gaps": f"with {NEEDS}, w as (select distinct basket, item, needed from cited join needs using (item)), h as (select distinct basket, item needed, true has from cited) select item, needed, count(*) n, count(*) filter (has is null) gaps from w left join h using (basket, needed) group by item, needed",
    "coverage_pct": f"with {NEEDS}, w as (select distinct basket, item, needed from cited join needs using (item)), h as (select distinct basket, item needed, true has from cited), g as (select basket, count(distinct needed) n_needed, count(distinct case when has is null then needed end) n_gaps from w left join h using (basket, needed) group by basket), n as (select basket, count(distinct item) n_items from cited group by basket) select basket, n_items, coalesce(n_needed, 0) n_needed, coalesce(n_gaps, 0) n_gaps, round(100.0::double * (n_items + coalesce(n_needed, 0) - coalesce(n_gaps, 0)) / (n_items + coalesce(n_needed, 0)), 1) coverage from n left join g using (basket)",
    "essential_pairs": f"with {NEEDS}, pr(have, lack) as (values (1::bigint, 2::bigint), (5, 9), (10, 30)), d as (select distinct basket, item from cited) select d.basket, have, lack from d join pr on item = have where not exists (select 1 from d x where x.basket = d.basket and x.item = lack)",
    "pairwise_conflicts": f"with {RATINGS} select * from x",
    "conflict_counts": f"with {RATINGS} select tag, dim, count(*) n, count(distinct tender) tenders from x group by all",
    "tender_audit": f"with {REQUIREMENTS}, {AUDIT} select * from a",
    "readiness": f"with {REQUIREMENTS}, {AUDIT} select tender, n, case when n_no_evidence > 0 and n_no_evidence >= n / 2 or n_abstained = n then 'INSUFFICIENT_EVIDENCE' when n_critical + n_high + n_review + n_abstained > 0 then 'REVIEW_REQUIRED' else 'READY_FOR_REVIEW' end readiness from a",
    "package_rollup": f"with {REQUIREMENTS} select tender % 50 package, count(*) n, string_agg(distinct evidence, ',' order by evidence) domains, count(distinct requirement % 97) standards from r group by 1",
    "review_queue": f"with {REQUIREMENTS} select tender, requirement, risk, evidence from r where decision <> 'RECOMMEND' order by case risk when 'CRITICAL' then 0 when 'HIGH' then 1 when 'MEDIUM' then 2 else 3 end, case evidence when 'NONE' then 0 when 'WEAK' then 1 when 'MODERATE' then 2 else 3 end, requirement limit 100",
    "review_progress": f'''with {REQUIREMENTS}, i as (select tender, count(*) n from r where decision <> 'RECOMMEND' group by tender), d as (select o_custkey tender, o_orderkey item, case l_returnflag when 'A' then 'ACCEPT' when 'N' then 'EDIT' else 'DISMISS' end decision, l_shipdate "at" from lineitem join orders on l_orderkey = o_orderkey where o_orderstatus <> 'O' and o_custkey % 3 <> 0), l as (select tender, item, arg_max(decision, row("at", decision)) decision from d group by all), p as (select tender, count(*) filter (decision = 'ACCEPT') accepted, count(*) filter (decision = 'EDIT') edited, count(*) filter (decision = 'DISMISS') dismissed from l group by tender), j as (select tender, n, coalesce(accepted, 0) accepted, coalesce(edited, 0) edited, coalesce(dismissed, 0) dismissed from i left join p using (tender)) select *, greatest(n - accepted - edited - dismissed, 0) pending, case when n <= accepted + edited + dismissed then 'REVIEW_COMPLETE' when accepted + edited + dismissed > 0 then 'IN_PROGRESS' else 'REVIEW_REQUIRED' end status from j''',
    "regulatory_status": "with o as (select case o_orderkey % 3 when 0 then 'C' || o_custkey when 1 then 'N' || (o_custkey % 10) else 'MACHINERY' end as key, o_orderkey order_id, case when o_orderkey % 7 = 0 then null else o_orderdate::date end effective from orders), k as (select key, min(order_id) order_id, arg_min_null(effective, order_id) effective from o group by key), c as (select c_custkey item, unnest(['C' || c_custkey, 'N' || c_nationkey, c_mktsegment]) as key, generate_subscripts(['C' || c_custkey, 'N' || c_nationkey, c_mktsegment], 1) - 1 prio from customer), m as (select item, prio, order_id, effective from c join k using (key) qualify row_number() over (partition by item order by prio) = 1) select c_custkey item, order_id, prio, case when order_id is null then 'NOT_COVERED' when effective is null then 'UNKNOWN' when date '1998-06-01' < effective then 'UPCOMING' else 'CURRENT' end status from customer left join m on item = c_custkey",
    "retrieval_metrics": f"with {CASES} " + METRICS.format("lang"),
    "sector_strata": f"with {CASES} " + METRICS.format("source"),
    "selective_risk": f"with {CASES}, v as (select *, decision in ('RECOMMEND', 'REVIEW') cov, expected = 'ABSTAIN' neg from c) select lang, count(*) cases, count(*) filter (cov) covered, round(100.0::double * count(*) filter (cov) / count(*), 4) coverage, round(coalesce(100.0::double * count(*) filter (cov and not hit) / nullif(count(*) filter (cov), 0), 0), 4) risk, round(coalesce(100.0::double * count(*) filter (neg and cov) / nullif(count(*) filter (neg), 0), 0), 4) false_recommendations, round(coalesce(100.0::double * count(*) filter (neg and not cov) / nullif(count(*) filter (neg), 0), 0), 4) abstention_recall from v group by lang",
    "confusion": f"with {CASES} select expected, decision predicted, count(*) n, round(count(*)::double / sum(count(*)) over (partition by expected), 6) recall, round(count(*)::double / sum(count(*)) over (partition by decision), 6) as precision from c group by expected, decision",
    "wilson_ci": f"with {CASES}, n as (select source, count(*) filter (hit) k, count(*) n from c group by source), w as (select *, k / n::double p, 1.95996::double z from n), v as (select *, (p + z * z / (2 * n)) / (1 + z * z / n) m, z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n) h from w) select source, k, n, round(greatest(0, 100 * (m - h)), 1) lower, round(least(100, 100 * (m + h)), 1) upper from v",
    "adversarial_metrics": f"with {CASES} select lang category, count(*) filter (decision = expected or hit) numerator, count(*) denominator, round(100.0::double * count(*) filter (decision = expected or hit) / count(*), 4) rate, round(100.0::double * count(*) filter (decision = expected or hit) / count(*), 4) >= 95 met from c group by lang",
    "group_split": f"with {SPLIT} select * from p",
    "leak_audit": rf"with {SPLIT} select sha256(regexp_replace(trim(text), '\s+', ' ', 'g')) as value, count(distinct part) parts, count(*) n, min(doc_id) first_key from documents join p on source = grp group by 1 having count(distinct part) > 1",
    "critic_score": "with s as (select p_partkey, p_size / 50.0::double a, (p_partkey % 100) / 100.0::double b, (p_partkey % 7) / 7.0::double c, (p_partkey % 5) / 5.0::double d, case when p_partkey % 9 = 0 then 0.0::double else 1.0::double end e from part), t as (select *, round(0.30::double * a + 0.30::double * b + 0.20::double * c + 0.10::double * d + 0.10::double * e, 4) composite from s), u as (select *, case when e = 0 then 'REVIEW' when composite >= 0.70::double then 'RECOMMEND' when composite >= 0.45::double then 'REVIEW' else 'ABSTAIN' end decision from t) select p_partkey, composite, decision, case when e = 0 then 'CRITICAL' when d < 0.25::double then 'HIGH' when decision = 'REVIEW' then 'MEDIUM' else 'LOW' end risk from u",
    "applicability_gate": "with c as (select c_nationkey query, case c_nationkey % 3 when 0 then 'BUILDING' when 1 then 'MACHINERY' else 'FURNITURE' end q, c_mktsegment d, c_acctbal / 10000.0::double score from customer), r as (select *, case when q = 'BUILDING' and d = 'FURNITURE' then 'MATERIAL_MISMATCH' when q = 'MACHINERY' and d = 'BUILDING' then 'SCOPE_MISMATCH' else '' end reason from c) select query, reason, case when reason <> '' then 'NOT_APPLICABLE' when q = d and score >= 0.3::double then 'APPLICABLE' else 'UNCERTAIN' end decision, count(*) n from r group by all",
    "ambiguity_state": "with r as (select l_orderkey query, l_partkey doc, max(round(l_quantity / 50, 4)) score from lineitem group by all), b as (select *, max(score) over (partition by query) best from r) select query, max(best) best, count(*) filter (score >= 0.70::double * best and best - score <= 0.20::double) rivals, case when max(best) < 0.2::double then 'INSUFFICIENT_INFORMATION' when count(*) filter (score >= 0.70::double * best and best - score <= 0.20::double) > 1 then 'COMPETING' else 'CLEAR' end state from b group by query",
    "events_dedupe": "select event_type, count(*) n from (select distinct user_id, event_type, date_trunc('second', ts) s from events) group by event_type",
    "events_tumbling": "select epoch(time_bucket(interval '1 hour', ts))::bigint as start, event_type, count(*) n, round(sum(value), 2) total from events group by all",
    "events_session": "with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '30 minutes' then 0 else 1 end fresh from events), s as (select user_id, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) s from g), n as (select user_id, s, count(*) n from s group by all) select user_id, count(*) sessions, max(n) longest from n group by user_id",
}
