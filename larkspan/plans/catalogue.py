"""Catalogue plans. Identifiers are made from the keys of part in twelve written forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.functions import idents as I
from larkspan.functions import text as T
from larkspan.operators import catalogue as C
from larkspan.plans.common import Query, table

#: twelve written forms of an identifier of key k, part p and year y
FORMS = (
    ("'IS ' || k || ':' || y", "IS", "k", None, None),
    ("'IS ' || k || ' (Part ' || p || ') : ' || y", "IS", "k", "p", None),
    ("'IS/ISO ' || k || ':' || y", "IS/ISO", "k", None, None),
    ("'is / iec ' || k || '-' || p || ':' || y", "IS/IEC", "k", "p", None),
    ("'IS ' || k || ' (Part ' || p || '/Sec 2) : ' || y", "IS", "k", "p", "2"),
    ("'SP ' || k || ':' || y", "SP", "k", None, None),
    ("k || ' ' || k || ':' || y", "IS", "k", None, None),
    ("'<b>IS ' || k || '</b>:' || y || '<br>ISO 1<br>(Active)'", "IS", "k", None, None),
    ("'IS/ISO/TR ' || k || ':' || y", "IS/ISO/TR", "k", None, None),
    ("'IS/IEC :' || y", None, None, None, None),
    ("'IS (Part 1/Sec 1):' || y", None, None, None, None),
    ("'Quite another text ' || k", None, None, None, None),
)
RAW = "case m " + " ".join(f"when {i} then {form}" for i, (form, *_) in enumerate(FORMS)) + " end"


def raw_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = table(spark, sf_dir, "part").selectExpr("p_partkey", "cast(p_partkey + 100 as string) k", "cast(1950 + p_size as string) y", "cast(p_size % 4 + 1 as string) p", "p_partkey % 12 m")
    return k.select("p_partkey", F.expr(RAW).alias("raw"))


def ident_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-01, STR-02, STR-03, FLT-06: parts of each identifier."""
    d = I.parsed(raw_identifiers(spark, sf_dir), "raw").where("ident.valid")
    return d.select("p_partkey", "ident.prefix", "ident.base", F.col("ident.part").cast("long").alias("part"), F.col("ident.section").cast("long").alias("section"), F.col("ident.year").cast("long").alias("year"), "ident.canonical_id", "ident.base_standard")


def ident_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-02, DQ-06: identifiers without a number, by what was found."""
    d = I.parsed(raw_identifiers(spark, sf_dir), "raw")
    return d.where("not ident.valid").groupBy("ident.prefix", "ident.canonical_id").agg(F.count("*").alias("n"))


def ident_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-04, STR-05, FLT-04: the same identifier written in two ways, with and without year."""
    k = table(spark, sf_dir, "part").selectExpr("p_partkey", "concat('IS ', p_partkey + 100, ':', 1950 + p_size) a", "case p_partkey % 3 when 0 then concat('is  ', p_partkey + 100) when 1 then concat('IS ', p_partkey + 100, ' : ', 1951 + p_size) else concat('IS ', p_partkey + 101) end b")
    d = I.parsed(I.parsed(k, "a", "x"), "b", "y")
    return d.select("p_partkey", I.equivalent(F.col("x"), F.col("y")).alias("same"), I.equivalent(F.col("x"), F.col("y"), True).alias("same_any_year"))


def raw_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as raw observations of catalogue entries."""
    return table(spark, sf_dir, "lineitem").selectExpr("case when l_partkey % 50 = 7 then '' else concat('IS ', l_partkey + 100, ':', 1990 + l_partkey % 30) end raw", "cast(l_suppkey % 10 as bigint) seed", "l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")


def rules() -> dict[str, Column]:
    return {"no_identifier": F.col("raw").rlike("[0-9]"), "no_quantity": F.col("l_quantity") > 1}


def catalogue_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-06, WIN-05, D11: one entry for each identifier, the first seen, with occurrences and seeds."""
    good, _ = C.split_valid(raw_observations(spark, sf_dir), rules())
    out = C.deduped(good, "raw", ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"], "seed", ["l_orderkey", "l_returnflag"])
    return out.select("raw", "l_orderkey", "l_returnflag", "occurrences", F.array_join(F.transform("seeds", lambda x: x.cast("string")), ",").alias("seeds"))


def catalogue_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-06, FLT-07, SNK-03: quarantined rows by their errors."""
    _, bad = C.split_valid(raw_observations(spark, sf_dir), rules())
    return bad.groupBy(F.array_join("errors", ",").alias("errors")).agg(F.count("*").alias("n"))


def catalogue_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-07, AGG-02: shares by seed."""
    return C.distribution(raw_observations(spark, sf_dir), "seed")


TRACKED = ["p_name", "p_brand", "status", "p_size"]
EDITS = ("case when p_partkey % 11 = 0 then concat(p_name, ' rev') else p_name end p_name", "case when p_partkey % 13 = 0 then null else p_brand end p_brand", "case when p_partkey % 17 = 0 then 'WITHDRAWN' when p_partkey % 19 = 0 then 'SUPERSEDED' when p_partkey % 23 = 0 then 'UNKNOWN' else 'ACTIVE' end status", "p_size")


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, sf_dir, "part")
    old = part.where("p_partkey % 29 <> 0").selectExpr("p_partkey", "p_name", "p_brand", "'ACTIVE' status", "p_size")
    return old, part.where("p_partkey % 31 <> 0").selectExpr("p_partkey", *EDITS)


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.snapshot_diff(*snapshots(spark, sf_dir), "p_partkey", TRACKED, "status")


def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GAT-26, JN-10, SET-01, MAP-01: what changed of each entry."""
    d = changes(spark, sf_dir).where("change_type <> 'UNCHANGED'")
    return d.select("p_partkey", "change_type", F.array_join("changed_fields", ",").alias("changed_fields"), F.coalesce(F.col("new_values")["status"], F.lit("-")).alias("new_status"))


def snapshot_field_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-08: changes by field."""
    return changes(spark, sf_dir).select(F.explode("changed_fields").alias("field")).groupBy("field").agg(F.count("*").alias("n"))


def snapshot_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-09, SNK-07: counts of one comparison."""
    return C.manifest(changes(spark, sf_dir))


def latest_edition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET-17, RET-18, WIN-03: the best edition of each group of orders."""
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_custkey", "case o_orderstatus when 'O' then 'ACTIVE' when 'F' then 'WITHDRAWN' else 'SUPERSEDED' end status", "cast(year(o_orderdate) as bigint) year")
    return C.best_edition(o, ["o_custkey"], "status", "year", "o_orderkey")


def catalogue_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-01, SNK-02: customers updated by a partial table with new keys."""
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    new = old.where("c_custkey % 5 = 0").selectExpr("c_custkey + case when c_custkey % 10 = 0 then 0 else 1000000 end c_custkey", "case when c_custkey % 20 = 0 then null else 'NEW' end c_mktsegment", "c_nationkey + 1 c_nationkey")
    return C.upserted(old, new, ["c_custkey"], ["c_mktsegment", "c_nationkey"]).selectExpr("cast(c_custkey as bigint) c_custkey", "c_mktsegment", "cast(c_nationkey as bigint) c_nationkey")


def content_hash_dupes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-38, DQ-03, AGG-03: texts that occur under several ids, by the hash of their words."""
    return C.duplicates(table(spark, sf_dir, "documents"), I.canonical_hash(F.col("text")), "doc_id")


def seed_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-02, TOP-12: the three largest suppliers of each nation."""
    s = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal")
    return C.per_group_limit(s, ["s_nationkey"], [F.desc("s_acctbal"), F.col("s_suppkey")], 3)


def lifecycle_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-08 to STR-11: status, activity and department of rows with raw fields."""
    d = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "case when o_orderkey % 6 = 0 then 'W' end w", "case o_orderkey % 4 when 0 then ' (Active) ' when 1 then 'Superseded by another' when 2 then 'concurrent running' end s", "concat(o_orderpriority, case when o_orderkey % 9 = 0 then ' superseded' else '' end) t", "case when o_orderkey % 3 = 0 then concat('ced ', o_orderkey % 60) when o_orderkey % 3 = 1 then '12' end tc")
    d = d.withColumn("status", I.lifecycle(F.col("w"), F.col("s"), F.col("t"))).withColumn("active", I.is_active(F.col("status"))).withColumn("department", I.department(F.col("tc")))
    return d.groupBy("status", "active", "department").agg(F.count("*").alias("n"))


def csv_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-10: cells that a spreadsheet would run are quoted."""
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey", "concat(case c_custkey % 5 when 0 then '=' when 1 then '+' when 2 then '-' when 3 then '@' else '' end, c_name) cell")
    return c.select("c_custkey", I.csv_guarded(F.col("cell")).alias("cell"))


def doc_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-40, STR-41: quality classes and tables of documents."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.quality(F.col("text")).alias("quality"), T.has_table(F.col("text")).alias("has_table"))


PARSE_SQL = f"""
with k as (select p_partkey, (p_partkey + 100)::varchar k, (1950 + p_size)::varchar y, (p_size % 4 + 1)::varchar p, p_partkey % 12 m from part),
r as (select *, {RAW} as raw from k),
f as (select *, case when m in (1, 3, 4) then p::bigint end pt, case when m = 4 then 2::bigint end sc,
      case m when 2 then 'IS/ISO' when 3 then 'IS/IEC' when 5 then 'SP' when 8 then 'IS/ISO/TR' when 9 then 'IS/IEC' when 11 then 'UNKNOWN' else 'IS' end prefix from r)
"""
OBSERVED = "o as (select case when l_partkey % 50 = 7 then '' else 'IS ' || (l_partkey + 100) || ':' || (1990 + l_partkey % 30) end raw, (l_suppkey % 10)::bigint seed, * from lineitem)"
DIFF_SQL = """
with p as (select p_partkey, p_name, p_brand, 'ACTIVE' status, p_size from part where p_partkey % 29 <> 0),
q as (select p_partkey, case when p_partkey % 11 = 0 then p_name || ' rev' else p_name end p_name, case when p_partkey % 13 = 0 then null else p_brand end p_brand,
      case when p_partkey % 17 = 0 then 'WITHDRAWN' when p_partkey % 19 = 0 then 'SUPERSEDED' when p_partkey % 23 = 0 then 'UNKNOWN' else 'ACTIVE' end status, p_size from part where p_partkey % 31 <> 0),
b as (select coalesce(p.p_partkey, q.p_partkey) p_partkey, p.p_partkey is null as fresh, q.p_partkey is null as gone, q.status qs,
      list_filter([case when coalesce(p.p_name, '') <> coalesce(q.p_name, '') then 'p_name' end, case when coalesce(p.p_brand, '') <> coalesce(q.p_brand, '') then 'p_brand' end,
      case when p.status <> q.status then 'status' end, case when p.p_size <> q.p_size then 'p_size' end], lambda x: x is not null) f
      from p full join q on p.p_partkey = q.p_partkey),
c as (select p_partkey, case when fresh then 'NEW' when gone then 'MISSING_FROM_SOURCE' when len(f) = 0 then 'UNCHANGED' when list_contains(f, 'status') and qs in ('WITHDRAWN', 'SUPERSEDED') then qs
      when list_contains(f, 'status') then 'STATUS_CHANGED' else 'UPDATED' end change_type, case when fresh then ['ALL'] when gone then ['presence'] else f end f,
      case when fresh or list_contains(f, 'status') and not gone then coalesce(qs, '-') else '-' end new_status from b)
"""

QUERIES: dict[str, Query] = {f.__name__: f for f in (ident_parse, ident_invalid, ident_equivalence, catalogue_dedupe, catalogue_quarantine, catalogue_distributions, snapshot_diff, snapshot_field_counts, snapshot_manifest, latest_edition, catalogue_upsert, content_hash_dupes, seed_limited, lifecycle_status, csv_guard, doc_quality)}

SQL: dict[str, str] = {
    "ident_parse": PARSE_SQL + "select p_partkey, prefix, k base, pt part, sc section, y::bigint as year, concat_ws('-', replace(prefix, '/', '-'), k, 'Part-' || pt, 'Sec-' || sc, y) canonical_id, prefix || ' ' || k || coalesce(' (Part ' || pt || ')', '') || coalesce(' (Sec ' || sc || ')', '') base_standard from f where m < 9",
    "ident_invalid": PARSE_SQL + "select prefix, 'UNKNOWN' canonical_id, count(*) n from f where m >= 9 group by all",
    "ident_equivalence": "select p_partkey, p_partkey % 3 = 0 as same, p_partkey % 3 < 2 as same_any_year from part",
    "catalogue_dedupe": f"with {OBSERVED}, g as (select * from o where raw <> '' and l_quantity > 1) select raw, arg_min(l_orderkey, row(l_orderkey, l_linenumber, l_quantity, l_returnflag)) l_orderkey, arg_min(l_returnflag, row(l_orderkey, l_linenumber, l_quantity, l_returnflag)) l_returnflag, count(*) occurrences, string_agg(distinct seed::varchar, ',' order by seed::varchar) seeds from g group by raw",
    "catalogue_quarantine": f"with {OBSERVED} select concat_ws(',', case when raw = '' then 'no_identifier' end, case when not l_quantity > 1 then 'no_quantity' end) errors, count(*) n from o where raw = '' or not l_quantity > 1 group by all",
    "catalogue_distributions": f"with {OBSERVED} select seed::varchar as value, count(*) n, round(100 * count(*) / sum(count(*)) over (), 4) share from o group by seed",
    "snapshot_diff": DIFF_SQL + "select p_partkey, change_type, array_to_string(f, ',') changed_fields, new_status from c where change_type <> 'UNCHANGED'",
    "snapshot_field_counts": DIFF_SQL + "select field, count(*) n from (select unnest(f) field from c) group by field",
    "snapshot_manifest": DIFF_SQL + "select count(*) filter (change_type = 'NEW') n_new, count(*) filter (change_type in ('UPDATED', 'STATUS_CHANGED', 'WITHDRAWN', 'SUPERSEDED')) n_updated, count(*) filter (change_type = 'UNCHANGED') n_unchanged, count(*) filter (change_type = 'MISSING_FROM_SOURCE') n_removed, count(*) n_all from c",
    "latest_edition": "with o as (select o_orderkey, o_custkey, case o_orderstatus when 'O' then 'ACTIVE' when 'F' then 'WITHDRAWN' else 'SUPERSEDED' end status, year(o_orderdate) as year from orders) select *, count(*) over (partition by o_custkey) editions from o qualify row_number() over (partition by o_custkey order by case status when 'ACTIVE' then 0 when 'SUPERSEDED' then 1 when 'WITHDRAWN' then 3 else 2 end, year desc, o_orderkey desc) = 1",
    "catalogue_upsert": "with n as (select (c_custkey + case when c_custkey % 10 = 0 then 0 else 1000000 end) c_custkey, case when c_custkey % 20 = 0 then null else 'NEW' end c_mktsegment, c_nationkey + 1 c_nationkey from customer where c_custkey % 5 = 0) select coalesce(n.c_custkey, o.c_custkey)::bigint c_custkey, coalesce(n.c_mktsegment, o.c_mktsegment) c_mktsegment, coalesce(n.c_nationkey, o.c_nationkey)::bigint c_nationkey from customer o full join n on o.c_custkey = n.c_custkey",
    "content_hash_dupes": r"select sha256(regexp_replace(trim(text), '\s+', ' ', 'g')) as value, count(*) n, min(doc_id) first_key from documents group by 1 having count(*) > 1",
    "seed_limited": "select s_nationkey, s_suppkey, s_acctbal from supplier qualify row_number() over (partition by s_nationkey order by s_acctbal desc, s_suppkey) <= 3",
    "lifecycle_status": "with d as (select o_orderkey k, o_orderkey % 6 = 0 w, o_orderkey % 4 s, o_orderkey % 9 = 0 t, case when o_orderkey % 3 = 0 then 'CED' end department from orders), e as (select *, case when w then 'WITHDRAWN' when s = 1 or t then 'SUPERSEDED' when s in (0, 2) then 'ACTIVE' else 'UNKNOWN' end status from d) select status, case when status = 'ACTIVE' then true when status in ('WITHDRAWN', 'SUPERSEDED') then false end active, department, count(*) n from e group by all",
    "csv_guard": "select c_custkey, case when c_custkey % 5 < 4 then '''' || ['=', '+', '-', '@'][(c_custkey % 5 + 1)::int] || c_name else c_name end cell from customer",
    "doc_quality": r"""with d as (select doc_id, coalesce(text, '') t from documents), n as (select *, length(trim(t)) n, length(regexp_replace(t, '[^#$%&*\x{FFFD}]', '', 'g')) m, string_split(t, chr(10)) l from d)
        select doc_id, case when n < 50 then 'OCR_REQUIRED' when m / n > 0.05 then 'QUALITY_FAILED' else 'EXTRACTED' end quality,
        regexp_matches(lower(t), '(^|[^a-z])table [0-9]') or len(list_filter(l, lambda x: length(x) - length(replace(x, '|', '')) >= 2)) >= 2 or len(list_filter(l, lambda x: regexp_matches(x, '[^ ] {3,}[^ ]'))) >= 4 has_table from n""",
}
