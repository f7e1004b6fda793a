"""Lookups, validation, projections and rule plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspan.functions import rules as U
from larkspan.functions import text as T
from larkspan.operators import catalogue as C
from larkspan.operators import retrieval as R
from larkspan.plans.common import Query, table
from larkspan.plans.retrieval import TOKENS


def lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-01 to FLT-03, FLT-05: parts by key, by brand without case, by prefix and by a word in the name."""
    p = table(spark, sf_dir, "part")
    hit = (F.col("p_partkey") == 17) | (F.upper(F.trim("p_brand")) == "BRAND#7") & F.col("p_name").contains("ring") | F.col("p_type").startswith("PRO") & (F.col("p_size") > 48)
    return p.where(hit).select("p_partkey", "p_name", "p_brand", "p_type")


def record_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-07 to FLT-10, FLT-20, FLT-24: errors of pages and orders as records."""
    p = table(spark, sf_dir, "pages").selectExpr("page_id", "case when page_id % 9 = 0 then concat('javascript:', url) when page_id % 9 = 1 then '' else url end url", "case when page_id % 5 = 0 then 1890 else 1990 + page_id % 30 end year")
    d = C.with_errors(p, {"url_scheme": ~U.bad_scheme(F.col("url")), "url_missing": F.length("url") > 0, "year_range": F.col("year").between(1900, 2026)})
    return d.groupBy(F.array_join("errors", ",").alias("errors")).agg(F.count("*").alias("n"))


def result_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-01, PRJ-05, STR-13: documents as results: summary, role, candidate text."""
    d = table(spark, sf_dir, "documents").selectExpr("doc_id", "text", "lang", "case doc_id % 4 when 0 then 'ACTIVE' when 1 then 'SUPERSEDED' when 2 then 'WITHDRAWN' end status", "case doc_id % 3 when 0 then 'verified' when 1 then ' Curated' else 'x' end prov")
    return d.select("doc_id", F.sha2(U.summary(F.col("text")), 256).alias("summary"), U.version_role(F.col("status")).alias("role"), U.provenance_rank(F.col("prov")).cast("long").alias("rank"), F.concat_ws(" | ", F.concat(F.lit("Language: "), "lang"), F.concat(F.lit("Status: "), "status")).alias("candidate"))


def json_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSN-01, SRC-16: values of the JSON column of events, by type."""
    e = table(spark, sf_dir, "events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return e.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.max("k").alias("most"))


def digits_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-03, STR-16: customers and parts that end in the same number, by key instead of a pattern."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.regexp_extract("c_name", "([0-9]{3})$", 1).cast("long").alias("digits"))
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 1000).alias("digits"))
    return c.join(p, "digits").where("c_custkey <> p_partkey").select("c_custkey", "p_partkey")


def keyword_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-06, JN-07: parts with a product keyword in their name, by token."""
    words = spark.createDataFrame([("ring", "R1"), ("widget", "R2"), ("red", "R3")], "word string, order_id string")
    t = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.split(F.lower("p_name"), " ")).alias("word"))
    return t.join(F.broadcast(words), "word").groupBy("p_partkey").agg(F.array_join(F.sort_array(F.collect_set("order_id")), ",").alias("orders"))


def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-14, JN-11, DQ-06: labelled documents against the corpus, both ways."""
    a, b = table(spark, sf_dir, "labels").select("doc_id"), table(spark, sf_dir, "documents").where("doc_id % 3 <> 0").select("doc_id")
    both = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), "doc_id", "full_outer")
    return both.groupBy(F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "unlabelled").otherwise("both").alias("side")).agg(F.count("*").alias("n"))


def outcome_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-18, AGG-32: three decisions on each case, and where they agree."""
    c = table(spark, sf_dir, "labels").selectExpr("doc_id", "quality = 1 a", "doc_id % 2 = 0 b", "doc_id % 3 = 0 c")
    return c.groupBy("a", "b", "c").agg(F.count("*").alias("n"), F.count_if(F.expr("a = b and b = c")).alias("agreed"))


def set_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-21, SET-02, SET-06: micro precision and recall of predicted against true sets."""
    s = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("truth"), F.collect_set(F.when(F.col("l_linenumber") % 2 == 0, F.col("l_partkey")).otherwise(F.col("l_suppkey"))).alias("found"))
    r = s.agg(F.sum(F.size(F.array_intersect("truth", "found"))).alias("tp"), F.sum(F.size("truth")).alias("truth"), F.sum(F.size("found")).alias("found"))
    return r.select("tp", F.round(F.col("tp") / F.col("found"), 6).alias("precision"), F.round(F.col("tp") / F.col("truth"), 6).alias("recall"))


def corpus_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-01, AGG-04, AGG-27, AGG-34: counts of the corpus by language."""
    d = table(spark, sf_dir, "documents")
    return d.groupBy("lang").agg(F.count("*").alias("docs"), F.count_distinct("source").alias("sources"), F.count_distinct("text").alias("texts"), F.count_if(F.length("text") < 200).alias("short"), F.sum("n_chars").alias("chars"), F.round(F.avg("n_chars"), 4).alias("mean_chars"))


def stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-24, STR-25, AGG-05: document frequency of stems."""
    w = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.transform(T.tokens(F.col("text")), lambda x: U.stem(x)))).alias("stem"))
    return w.groupBy("stem").agg(F.count("*").alias("df")).where("df > 1")


def specifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-29, STR-33: ratings and sub-queries of composed requirements."""
    p = table(spark, sf_dir, "part").selectExpr("p_partkey", "concat('Supply ', p_name, ' rated ', p_size, ' kV and ', p_size * 2, 'kW, with ', p_size, ' kV bushing; oil') t")
    return p.select("p_partkey", F.array_join(U.specification(F.col("t")), ",").alias("ratings"), F.array_join(U.sub_queries(F.col("t")), "|").alias("parts"))


def claim_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GAT-08, GAT-07, RET-16, NUM-14: how many of an item's words its document has (item i, document i)."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.array_distinct(T.tokens(F.col("text"))).alias("claim"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.array_distinct(T.tokens(F.col("text"))).alias("source"))
    share, ok = U.grounded(F.col("claim"), F.col("source"))
    return b.join(d, "id").select("id", share.alias("share"), ok.alias("grounded"))


def support_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GAT-10, GAT-09, RET-15: support of documents by the next document of their source; doc_id is a key."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    block = (F.col("doc_id") / 65536).cast("long")  # ids of one source are ordered within blocks, then the blocks
    ids = d.select("doc_id", "source", block.alias("block"))
    blocks = ids.groupBy("source", "block").agg(F.min("doc_id").alias("least")).withColumn("after", F.lead("least").over(Window.partitionBy("source").orderBy("block")))
    within = ids.withColumn("next", F.lead("doc_id").over(Window.partitionBy("source", "block").orderBy("doc_id")))
    nexts = within.alias("x").join(blocks.alias("b"), F.expr("x.source <=> b.source and x.block = b.block")).select("doc_id", F.coalesce("next", "after").alias("next")).where("next is not null")
    words = d.select("doc_id", F.array_distinct(T.tokens(F.col("text"))).alias("w"))
    d = nexts.join(words, "doc_id").select(F.col("next").alias("doc_id"), F.col("w").alias("mine")).join(words, "doc_id").select(F.col("mine").alias("w"), F.col("w").alias("next"))
    return d.groupBy(U.support(F.col("w"), F.col("next")).alias("state")).agg(F.count("*").alias("n"))


def verification_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GAT-12: which of all changes of state are allowed."""
    n = len(U.STATES)
    names = F.array(*[F.lit(s) for s in U.STATES])
    pairs = spark.range(n * n).select(F.get(names, (F.col("id") / n).cast("int")).alias("now"), F.get(names, (F.col("id") % n).cast("int")).alias("target"))
    return pairs.where(U.may_follow(F.col("now"), F.col("target")))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NUM-03, NUM-05, NUM-07, RET-10: squashed, logistic and blended scores."""
    p = table(spark, sf_dir, "part").selectExpr("p_partkey", "(p_partkey % 200 - 100) / 4.0d x", "p_size / 50.0d h", "case when p_partkey % 3 = 0 then p_partkey % 10 / 10.0d end r")
    return p.select("p_partkey", U.squash(F.col("x")).alias("squashed"), F.round(U.sigmoid(F.col("x")), 6).alias("logistic"), U.reranked(F.col("h"), F.col("r")).alias("blended"))


def fts_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET-04, NUM-02, TOP-05, FLT-18, D1: weighted columns of parts: name 3, brand 1, type 2; three words."""
    p = table(spark, sf_dir, "part")
    long = None
    for c, w in (("p_name", 3.0), ("p_brand", 1.0), ("p_type", 2.0)):
        one = R.positions(p, "p_partkey", c).select("doc", "term", F.lit(w).alias("w"))
        long = one if long is None else long.unionByName(one)
    n = p.count()
    size = long.groupBy("doc").agg(F.count("*").alias("len"))
    mean = size.agg(F.avg("len").alias("avg_len"))
    tf = long.where(F.col("term").isin("ring", "promo", "red")).groupBy("doc", "term").agg(F.sum("w").alias("tf"))
    df = tf.groupBy("term").agg(F.greatest(F.log((n - F.count("*") + 0.5) / (F.count("*") + 0.5)), F.lit(1e-6)).alias("idf"))
    s = tf.join(df, "term").join(size, "doc").join(F.broadcast(mean)).withColumn("s", F.expr("idf * tf * 2.2d / (tf + 1.2d * (0.25d + 0.75d * len / avg_len))"))
    out = s.groupBy("doc").agg(F.round(F.sum("s"), 6).alias("score")).withColumn("squashed", U.squash(F.col("score"))).where("squashed >= 0.2")
    return out.orderBy(F.desc("score"), "doc").limit(40)


def component_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET-08: each item's words in two components; the best discounted score of a document."""
    b = table(spark, sf_dir, "benchmark").select("item_id", T.tokens(F.col("text")).alias("w"))
    parts = b.select("item_id", F.posexplode(F.array(F.slice("w", 1, 5), F.slice("w", 6, 5))).alias("part", "w")).select((F.col("item_id") * 2 + F.col("part")).alias("query"), F.array_join("w", " ").alias("t"))
    s = R.bm25(table(spark, sf_dir, "documents"), parts, "doc_id", "text", "query", "t")
    best = s.groupBy((F.floor(F.col("query") / 2)).alias("query"), "doc").agg(F.max(F.col("score") * 0.9).alias("score"))
    return R.ranked(best, 3).select("query", F.col("rank").cast("long").alias("rank"), "doc", "score")


QUERIES: dict[str, Query] = {f.__name__: f for f in (lookup, record_validation, result_projection, json_columns, digits_join, keyword_join, reconcile, outcome_comparison, set_metrics, corpus_inventory, stems, specifications, claim_grounding, support_states, verification_states, scored, fts_weighted, component_bm25)}

SQL: dict[str, str] = {
    "lookup": "select p_partkey, p_name, p_brand, p_type from part where p_partkey = 17 or upper(trim(p_brand)) = 'BRAND#7' and contains(p_name, 'ring') or starts_with(p_type, 'PRO') and p_size > 48",
    "record_validation": "with p as (select page_id % 9 = 0 as s, page_id % 9 = 1 as m, page_id % 5 = 0 as y from pages) select concat_ws(',', case when s then 'url_scheme' end, case when m then 'url_missing' end, case when y then 'year_range' end) errors, count(*) n from p group by all",
    "result_projection": "select doc_id, sha256(case when length(text) > 220 then substring(text, 1, 220) || '...' else text end) summary, case doc_id % 4 when 0 then 'CURRENT' when 1 then 'HISTORICAL' when 2 then 'WITHDRAWN' else 'UNVERIFIED' end as role, case doc_id % 3 when 0 then 3 when 1 then 2 else 0 end::bigint as rank, 'Language: ' || lang || case doc_id % 4 when 0 then ' | Status: ACTIVE' when 1 then ' | Status: SUPERSEDED' when 2 then ' | Status: WITHDRAWN' else '' end candidate from documents",
    "json_columns": "with e as (select event_type, json_extract_string(props, '$.k')::bigint k from events) select event_type, count(k) n, sum(k)::bigint total, max(k) most from e group by event_type",
    "digits_join": "select c_custkey, p_partkey from customer join part on regexp_extract(c_name, '([0-9]{3})$', 1)::bigint = p_partkey % 1000 where c_custkey <> p_partkey",
    "keyword_join": "with w(word, o) as (values ('ring', 'R1'), ('widget', 'R2'), ('red', 'R3')), t as (select distinct p_partkey, unnest(string_split(lower(p_name), ' ')) word from part) select p_partkey, string_agg(o, ',' order by o) orders from t join w using (word) group by p_partkey",
    "reconcile": "with b as (select doc_id from documents where doc_id % 3 <> 0), f as (select l.doc_id a, b.doc_id b from labels l full join b on l.doc_id = b.doc_id) select case when b is null then 'missing' when a is null then 'unlabelled' else 'both' end side, count(*) n from f group by 1",
    "outcome_comparison": "with c as (select quality = 1 a, doc_id % 2 = 0 b, doc_id % 3 = 0 c from labels) select a, b, c, count(*) n, count(*) filter (a = b and b = c) agreed from c group by all",
    "set_metrics": "with s as (select l_orderkey, list(distinct l_partkey) t, list(distinct case when l_linenumber % 2 = 0 then l_partkey else l_suppkey end) f from lineitem group by 1), r as (select sum(len(list_intersect(t, f)))::bigint tp, sum(len(t)) t, sum(len(f)) f from s) select tp, round(tp / f, 6) as precision, round(tp / t, 6) recall from r",
    "corpus_inventory": "select lang, count(*) docs, count(distinct source) sources, count(distinct text) texts, count(*) filter (length(text) < 200) short, sum(n_chars)::bigint chars, round(avg(n_chars), 4) mean_chars from documents group by lang",
    "stems": f"with w as (select doc_id, list_distinct(list_transform({TOKENS.format('text')}, lambda x: case when ends_with(x, 'ies') and length(x) > 4 then substring(x, 1, length(x) - 3) || 'y' when ends_with(x, 'es') and length(x) > 4 then substring(x, 1, length(x) - 2) when ends_with(x, 'ing') and length(x) > 5 then substring(x, 1, length(x) - 3) when ends_with(x, 's') and not ends_with(x, 'ss') and length(x) > 3 then substring(x, 1, length(x) - 1) else x end)) w from documents) select stem, count(*) df from (select unnest(w) stem from w) group by stem having count(*) > 1",
    "specifications": "select p_partkey, p_size || 'kV,' || (p_size * 2) || 'kW' ratings, concat_ws('|', 'supply ' || lower(p_name) || ' rated ' || p_size || ' kv', case when length(p_size || ' kv bushing') > 8 then p_size || ' kv bushing' end) parts from part",
    "claim_grounding": f"with b as (select item_id id, list_distinct({TOKENS.format('text')}) c from benchmark), d as (select doc_id id, list_distinct({TOKENS.format('text')}) s from documents), j as (select id, case when len(c) > 0 then len(list_intersect(c, s)) / len(c) else 0 end x from b join d using (id)) select id, round(x, 4) share, x >= 0.25::double grounded from j",
    "support_states": f"with d as (select doc_id, source, list_distinct({TOKENS.format('text')}) w from documents), n as (select w, lead(w) over (partition by source order by doc_id) x from d), s as (select case when len(w) > 0 then len(list_intersect(w, x)) / len(w) else 0 end r, list_contains(w, 'not') <> list_contains(x, 'not') g from n where x is not null) select case when g and r >= 0.3::double then 'CONTRADICTED' when r >= 0.6::double then 'FULLY_SUPPORTED' when r >= 0.3::double then 'PARTIALLY_SUPPORTED' else 'UNSUPPORTED' end state, count(*) n from s group by 1",
    "verification_states": "with s as (select unnest([" + ", ".join(f"'{s}'" for s in U.STATES) + "]) n, generate_subscripts([" + ", ".join(f"'{s}'" for s in U.STATES) + "], 1) i) select a.n as now, b.n as target from s a join s b on b.i = a.i + 1",
    "scored": "with p as (select p_partkey, (p_partkey % 200 - 100) / 4.0::double x, p_size / 50.0::double h, case when p_partkey % 3 = 0 then p_partkey % 10 / 10.0::double end r from part) select p_partkey, round(least(greatest(abs(x) / (abs(x) + 5), 0), 1), 3) squashed, round(case when x > 20 then 1 when x < -20 then 0 else 1 / (1 + exp(-x)) end, 6) logistic, case when h >= 0.98::double then h else round(0.75::double * h + 0.25::double * coalesce(r, 0.5::double), 4) end blended from p",
    "fts_weighted": "with l as (select p_partkey doc, unnest(regexp_split_to_array(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), ' ')) term, 3.0::double w from part union all select p_partkey, unnest(regexp_split_to_array(trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g')), ' ')), 1.0::double from part union all select p_partkey, unnest(regexp_split_to_array(trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')), ' ')), 2.0::double from part), z as (select doc, count(*) len from l group by doc), a as (select avg(len) avg_len from z), tf as (select doc, term, sum(w) tf from l where term in ('ring', 'promo', 'red') group by all), df as (select term, greatest(ln(((select count(*) from part) - count(*) + 0.5::double) / (count(*) + 0.5::double)), 1e-6) idf from tf group by term), s as (select doc, round(sum(idf * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * len / avg_len))), 6) score from tf join df using (term) join z using (doc), a group by doc) select doc, score, round(abs(score) / (abs(score) + 5), 3) squashed from s where round(abs(score) / (abs(score) + 5), 3) >= 0.2::double order by score desc, doc limit 40",
    "component_bm25": f"with w as (select doc_id doc, {TOKENS.format('text')} w from documents), p as (select doc, len(w) len, unnest(w) term from w), tf as (select doc, len, term, count(*) tf from p group by all), df as (select term, count(*) df from tf group by all), st as (select count(*) docs, avg(len(w)) avg_len from w), b as (select item_id, {TOKENS.format('text')} w from benchmark), q as (select item_id, 0 part, unnest(w[1:5]) term from b union all select item_id, 1, unnest(w[6:10]) from b), qt as (select item_id, part, term, count(*) qtf from q group by all), sc as (select item_id, part, doc, sum(qtf * ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * len / avg_len))) s from qt join tf using (term) join df using (term), st group by all), m as (select item_id query, doc, round(max(s * 0.9::double), 6) score from sc group by all) select query, row_number() over (partition by query order by score desc, doc)::bigint as rank, doc, score from m qualify rank <= 3",
}
