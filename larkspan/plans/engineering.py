"""Plans over the engineering rules: scope, domains, traits, entities, roles, cohorts, choices, provenance, reports.

The requirements are the whole texts of documents, each with a phrase that the rules know behind it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspan.functions import engineering as E
from larkspan.operators import segments as S
from larkspan.plans.common import Query, table
from larkspan.plans.texts import LINES, value_quote

PHRASES = (
    "Statutory audit and bank guarantee for the works.",
    "Gate valve of cast iron for drinking water supply, 16 bar, tested as per IS 14846.",
    "Supply of mesh chairs and a credenza; catering for the guest house.",
    "11 kV XLPE cables, laying underground in trench, with distribution transformers.",
    "Submersible pump in a tubewell with 3 phase motor and starter panel, Clause 4.2.",
    "TMT bars Fe 500D and ordinary Portland cement (OPC) for structural steel trusses, Table 3.",
    "Sprinkler and fire hydrant with thermal insulation of mineral wool at 120 degrees C.",
    "Payment terms, earnest money deposit and force majeure; see Section 12.",
    "Payment terms for pumps; non submersible surface coupled, end suction.",
    "Wall tiles and vitrified tiles as directed by the engineer.",
    "Sulphuric acid effluent in HDPE pipe, sewerage pipeline, non-pressure, SP 30 and IS 1239 (Part 1).",
    "Haccp hygiene for a canteen; food safety. See the Foreword.",
    "Crane rails, quay crane and hoist; steam line of mild steel, forklift traffic.",
    "asdf qwerty",
    "Aircraft fuselage, avionics; overhead conductor, 415 V, low voltage, degreaser.",
    "Software subscription, cloud hosted erp.",
)
N = len(PHRASES)


def requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, t, f): each document's text with a phrase behind, and the same folded."""
    phrase = F.element_at(F.array(*map(F.lit, PHRASES)), (F.col("doc_id") % N + 1).cast("int"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(" "), phrase).alias("t"))
    return d.withColumn("f", E.folded(F.col("t")))


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, t, f): the phrases alone, one for each document."""
    phrase = F.element_at(F.array(*map(F.lit, PHRASES)), (F.col("doc_id") % N + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", phrase.alias("t")).withColumn("f", E.folded(F.col("t")))


def scope_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-13: by which of nine rules a requirement is out of scope."""
    return phrases(spark, sf_dir).select("doc_id", E.scope_rule(F.col("f")).cast("long").alias("rule"))


def clause_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-14, FLT-23: administrative clauses, and wording that leaves the choice to someone without citing a standard."""
    f = F.col("f")
    cites = F.size(E.standard_tokens(F.col("t"))) > 0
    return requirements(spark, sf_dir).select("doc_id", E.is_administrative(f).alias("administrative"), (f.rlike(E.DISCRETION) & ~cites).alias("discretionary"))


def domain_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-26: domains of the requirements, in their fixed order."""
    return requirements(spark, sf_dir).select("doc_id", F.array_join(E.domains(F.col("f")), ",").alias("domains"))


def application_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-27: eleven traits of each requirement."""
    return requirements(spark, sf_dir).select("doc_id", *[c.alias(k) for k, c in E.profile(F.col("f")).items()])


def entity_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-30, STR-31: entities of each requirement in order of place, and the confidence of the decomposition."""
    found = requirements(spark, sf_dir).select("doc_id", E.entities(F.col("f")).alias("x"))
    return found.select("doc_id", F.array_join(F.transform("x", lambda e: F.concat(e["kind"], F.lit(":"), e["text"])), ",").alias("entities"), E.confidence(F.transform("x", lambda e: e["kind"])).alias("confidence"))


def attribute_ladders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-28: material, pump, valve, phase and cement grade of the phrases."""
    f = F.col("f")
    return phrases(spark, sf_dir).select("doc_id", E.ladder(f, E.MATERIALS).alias("material"), *[E.ladder(f, s).alias(k) for k, s in E.ATTRIBUTES.items()])


TITLES = (
    ("IS 7098", "specification for cables"),
    ("IS 1255", "code of practice for installation and maintenance of power cables"),
    ("IS 302", "safety of household and similar electrical appliances"),
    ("IS 2491", "food hygiene, general principles, code of practice"),
    ("IS 9999", "methods of test for pumps"),
    ("IS 8888", "fire safety of buildings"),
    ("IS 7777", "glossary of terms"),
    ("IS 6666", "guidelines for storage"),
    ("SP 30", "national electrical code"),
    ("IS 5555", "brass fittings"),
)


def titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = (F.col("p_partkey") % len(TITLES) + 1).cast("int")
    pick = lambda j: F.element_at(F.array(*[F.lit(x[j]) for x in TITLES]), at)
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", pick(0).alias("number"), pick(1).alias("title"))


def standard_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-15: parts as standards, by role."""
    return titled(spark, sf_dir).groupBy(E.standard_role(F.col("number"), F.col("title")).alias("role")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))


def role_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-11, TOP-10: candidates (twenty to a query), those within 0.20 of the best by role, the rest by score."""
    c = titled(spark, sf_dir).select(F.expr("cast(floor(p_partkey / 20) as bigint)").alias("query"), F.col("p_partkey").alias("doc"), E.standard_role(F.col("number"), F.col("title")).alias("role"), (F.col("p_size") / 50.0).alias("score"))
    best = F.max("score").over(Window.partitionBy("query"))
    tier = F.when(F.round(best - F.col("score"), 9) > 0.20, 3).when(F.col("role") == "PRIMARY_PRODUCT", 0).when(F.col("role").isin("INSTALLATION_CODE", "FACILITY_PREMISE"), 1).otherwise(2)
    rank = F.row_number().over(Window.partitionBy("query").orderBy("tier", F.desc("score"), "doc"))
    return c.withColumn("tier", tier.cast("long")).withColumn("rank", rank.cast("long")).where("rank <= 5").select("query", "rank", "doc", "tier")


def acronym_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET-07: words of the phrases with what their acronyms stand for."""
    words = F.filter(F.split(F.lower("t"), r"[\s,\-/:]+"), lambda w: F.length(w) > 2)
    return phrases(spark, sf_dir).select("doc_id", F.array_join(E.expanded(words), " ").alias("words"))


def clause_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-39, STR-46, STR-48: clause, standards and sector that a requirement names."""
    kind = F.element_at(F.array(*map(F.lit, ["Civil", "Electrical", "mech. works", "Hotel", "Wood & Paper"])), (F.col("doc_id") % 5 + 1).cast("int"))
    return requirements(spark, sf_dir).select("doc_id", E.clause_hint(F.col("t")).alias("clause"), F.array_join(E.standard_tokens(F.col("t")), ",").alias("standards"), E.sector(kind).alias("sector"))


def dependency_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GAT-21: role and status of a dependency, and whether the requirement calls for it."""
    names = F.array(*[F.lit(d[0]) for d in E.DEPENDENCIES], F.lit("UNHEARD_OF"))
    d = requirements(spark, sf_dir).withColumn("kind", F.element_at(names, (F.col("doc_id") % (len(E.DEPENDENCIES) + 1) + 1).cast("int")))
    role, status, applies = E.dependency(F.col("kind"), F.col("f"))
    return d.select("doc_id", role.alias("role"), status.alias("status"), applies.alias("applies"))


def calibration_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as cases, and five negative controls appended."""
    c = table(spark, sf_dir, "labels").selectExpr(
        "concat('R-', doc_id) id", "case when toxic = 1 then 'REJECT_INELIGIBLE' when doc_id % 11 = 0 then 'ABSTAIN_UNDER_SPECIFIED' when doc_id % 7 = 0 then 'REVIEW' else 'RECOMMEND' end expected",
        "case doc_id % 4 when 0 then '' when 1 then 'IS 1; IS 2' when 2 then 'IS 732 : 2019' else 'IS 1' end standard", "case when doc_id % 13 = 0 then 'DISTRACTOR_PROBE' else '' end kind",
        "case when doc_id % 6 = 5 then 'Two competing editions' else '' end reasoning", "'t' title", "doc_id % 3 = 0 verified", "quality = 1 recommended",
    )
    return c.unionByName(spark.range(1, 6).selectExpr("concat('NEG-00', id) id", "'X' expected", "'IS 1' standard", "'' kind", "'' reasoning", "'t' title", "true verified", "false recommended"))


def cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GAT-23, SET-07: cases and negative controls by cohort."""
    c = calibration_cases(spark, sf_dir)
    return c.groupBy(E.cohort({k: F.col(k) for k in ("id", "expected", "standard", "kind", "reasoning", "title")}).alias("cohort")).agg(F.count("*").alias("n"), F.count_if("verified").alias("verified"))


def safety_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GAT-24, DQ-05: no false recommendation, no selective risk, five adjudicated vague cases. Sums don't depend on order."""
    c = calibration_cases(spark, sf_dir)
    counts = c.agg(F.count_if(F.expr("expected = 'REJECT_INELIGIBLE' and recommended")).alias("false_recommendations"), F.count_if(F.expr("expected = 'REVIEW' and recommended")).alias("risky"), F.count_if(F.expr("expected = 'ABSTAIN_UNDER_SPECIFIED' and verified")).alias("adjudicated"))
    return counts.withColumn("ready", F.expr("false_recommendations = 0 and risky = 0 and adjudicated >= 5"))


def evidence_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP-09, AGG-18: the evidence of an order by state, a conflict first, and the mean overlap of what was chosen."""
    e = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_quantity / 50.0d overlap", "case when l_quantity < 3 then 'CONFLICTING' when l_quantity < 15 then 'FULLY_SUPPORTED' when l_quantity < 25 then 'PARTIALLY_SUPPORTED' when l_quantity < 40 then 'UNSUPPORTED' else 'UNVERIFIED_COVERAGE' end state")
    order = F.array_position(F.array(*map(F.lit, ["CONFLICTING", "FULLY_SUPPORTED", "PARTIALLY_SUPPORTED", "UNSUPPORTED", "UNVERIFIED_COVERAGE"])), F.col("state"))
    chosen = e.groupBy("l_orderkey").agg(F.min(F.struct(order.alias("o"), "l_linenumber", "state", "overlap")).alias("x"))
    return chosen.groupBy("x.state").agg(F.count("*").alias("n"), F.round(F.avg("x.overlap"), 6).alias("mean_overlap"))


def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP-11: customers' names without leading zeros, by the number in them."""
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("File"), F.col("c_custkey").cast("string"), F.lit(".pdf")).alias("name"))
    return c.orderBy(F.lower(F.regexp_extract("name", "^([^0-9]*)", 1)), F.regexp_extract("name", "([0-9]+)", 1).cast("long"), "name").limit(30)


def provenance_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-16: the first line of its document that holds a requirement (its code points 21 to 60, white space made plain)."""
    plain = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    d = table(spark, sf_dir, "documents")
    asked = d.select(F.col("doc_id").alias("doc"), plain(F.substring("text", 21, 40)).alias("req")).where("length(req) > 10")
    hits = S.lines(d, "doc_id", "text").join(asked, "doc").where(F.instr(plain(F.col("t")), F.col("req")) > 0)
    found = hits.groupBy("doc").agg(F.min("line").cast("long").alias("line"))
    return asked.join(found, "doc", "left").select(F.col("doc").alias("doc_id"), "line", F.when(F.col("line").isNull(), "UNRESOLVED_TEXT_MISMATCH").otherwise("VERIFIED_DEFENSIBLE").alias("status"))


def tender_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-20: a file's tender by its name in the metadata, else by the number in it, else unknown."""
    files = table(spark, sf_dir, "customer").selectExpr("c_custkey", "case c_custkey % 3 when 0 then concat('in/f', c_custkey, '.pdf') when 1 then concat('tender_', c_custkey, '.pdf') else concat('x', c_custkey, '.doc') end path")
    known = table(spark, sf_dir, "nation").selectExpr("concat('f', n_nationkey * 3, '.pdf') base", "concat('T-', n_name) tender")
    f = files.withColumn("base", F.regexp_extract("path", "([^/]*)$", 1))
    number = F.regexp_extract("base", r"([0-9]+)\.pdf$", 1)
    return f.join(known, "base", "left").select("c_custkey", F.coalesce("tender", F.when(number != "", F.concat(F.lit("T"), F.lpad(number, 3, "0")).cast("string")), F.lit("T_UNKNOWN")).alias("tender"))


def compat_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-02, PRJ-03: parts as rows of eighteen columns, many of them without a source."""
    none = lambda t, *names: [f"cast(null as {t}) {n}" for n in names]
    return table(spark, sf_dir, "part").selectExpr(
        "concat('IS-', p_partkey) standard_id", "concat('IS ', p_partkey) standard_number", "1950 + p_size year", "p_name full_title", "case when p_size > 40 then 'WITHDRAWN' else 'ACTIVE' end status", *none("int", "reaffirmed_year"), "p_size % 4 amendments_count", "p_brand technical_committee",
        *none("string", "ics", "udc", "scope"), "p_type notes", "'catalogue' source", *none("string", "source_url", "retrieved_at"), "concat('IS ', p_partkey) original_identifier", "'VERIFIED' verification_status", "concat('seed: ', p_size % 10) evidence",
    )


def status_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-12, STR-06: a status that slipped into the column of equivalents, and keys in one spelling."""
    p = table(spark, sf_dir, "part").selectExpr("p_partkey", "case p_partkey % 3 when 0 then 'UNKNOWN' else 'ACTIVE' end status", "case p_partkey % 5 when 0 then '(Active)' when 1 then '(Active,Concurrent Running )' when 2 then '(Withdrawn)' when 3 then 'ISO 9001' end iso", "concat(' is/iso', p_partkey, ' :  ', 1990 + p_size) raw")
    repaired = F.expr("status = 'UNKNOWN' and iso in ('(Active)', '(Active,Concurrent Running )', '(Concurrent Running )')")
    key = F.upper(F.trim(F.regexp_replace(F.regexp_replace("raw", r"(?i)(IS(?:/ISO)?)\s*([0-9]+)", "$1 $2"), r"\s+", " ")))
    return p.select("p_partkey", F.when(repaired, "ACTIVE").otherwise(F.col("status")).alias("status"), F.coalesce(repaired, F.lit(False)).alias("recovered"), F.when(~F.coalesce(F.col("iso").rlike(r"^\((?:Active|Withdrawn|Concurrent)"), F.lit(False)), F.col("iso")).alias("iso"), key.alias("key"))


def cells_exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-07: rows of CSV text, the cell of several values exploded at ';'."""
    rows = table(spark, sf_dir, "part").selectExpr("concat(p_partkey, ',\"', p_name, '\",', p_size, ';', p_size + 1, '; ', p_brand) line")
    parsed = rows.select(F.from_csv("line", "k bigint, name string, cells string").alias("r")).select("r.*")
    return parsed.select("k", "name", F.explode(F.split("cells", r"\s*;\s*")).alias("cell"))


def nested_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-04, SRC-05, SRC-08, SRC-18: lines of JSON with nested references, of allowed sources, exploded."""
    rows = table(spark, sf_dir, "part").selectExpr("concat('{\"id\":', p_partkey, ',\"source\":\"', case p_partkey % 3 when 0 then 'BIS' when 1 then 'CURATED' else 'BLOG' end, '\",\"refs\":[{\"n\":\"IS ', p_size, '\",\"kind\":\"cites\"},{\"n\":\"SP ', p_size % 7, '\"}]}') line")
    r = rows.select(F.from_json("line", "id bigint, source string, refs array<struct<n:string,kind:string>>").alias("r")).select("r.*").where("source in ('BIS', 'CURATED')")
    return r.select("id", F.explode("refs").alias("x")).select("id", "x.n", F.coalesce("x.kind", F.lit("references")).alias("kind"))


HEADER = r"^(?:package|lot|part|schedule|section)\s*([0-9a-z_-]+)\s*[:-]\s*(.+)$"


def package_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-08, STR-34: lines under the package header that precedes them; every fifth line is made a header."""
    marked = F.when(F.col("line") % 5 == 0, F.concat(F.lit("Lot "), (F.col("line") / 5 + 1).cast("int").cast("string"), F.lit(": works"))).otherwise(F.col("t"))
    ls = S.lines(table(spark, sf_dir, "documents"), "doc_id", "text").withColumn("t", marked)
    code = F.regexp_extract(F.lower("t"), HEADER, 1)
    w = Window.partitionBy("doc").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = ls.withColumn("code", F.when(code != "", code)).withColumn("seq", F.count("code").over(w)).where("seq > 0")
    out = spans.groupBy(F.col("doc").alias("doc_id"), F.col("seq")).agg(F.max("code").alias("code"), F.sum(F.when(F.col("code").isNull() & (F.col("t") != ""), 1).otherwise(0)).alias("lines"))
    return out.select("doc_id", "seq", F.concat(F.lit("PKG-"), F.when(F.col("code").rlike("^[0-9]$"), F.concat(F.lit("0"), "code")).otherwise(F.upper("code"))).alias("package"), "lines")


def field_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-09, SRC-14: where a line is just a field's name, the next line; every sixth line is made one."""
    ls = S.lines(table(spark, sf_dir, "documents"), "doc_id", "text").withColumn("t", F.when(F.col("line") % 6 == 2, "Title of Work").otherwise(F.col("t")))
    return S.next_line_fields(ls, "title of work").selectExpr("doc doc_id", "cast(line as bigint) line", "sha2(value, 256) value")


def guarded_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-15, FLT-19, SET-03: candidates without agricultural titles for industrial queries, their shared words, and gaps."""
    c = table(spark, sf_dir, "part").selectExpr("p_partkey doc", "cast(p_partkey % 50 as bigint) query", "concat(lower(p_name), case when p_partkey % 4 = 0 then ' agricultural' else '' end) title", "concat(lower(p_type), ' ', lower(p_name)) wanted", "p_partkey % 50 % 2 = 0 industrial")
    kept = c.where("not (industrial and title like '%agricultur%')").withColumn("shared", F.size(F.array_intersect(F.split("title", " "), F.split("wanted", " "))))
    every = c.select("query").distinct()
    best = kept.where("shared > 2").groupBy("query").agg(F.count("*").alias("n"), F.min("doc").alias("first"))
    return every.join(best, "query", "left").select("query", F.coalesce("n", F.lit(0)).alias("n"), "first", F.col("n").isNull().alias("potential_gap"))


def relation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five related entries of each part, explained, with a warning for those that are withdrawn (parts of the graph reports)."""
    e = table(spark, sf_dir, "lineitem").selectExpr("l_partkey src", "l_suppkey dst", "case l_linenumber % 3 when 0 then 'REFERENCES' when 1 then 'SUPERSEDES' else 'TEST_METHOD' end type", "l_orderkey", "l_linenumber").groupBy("src", "dst", "type").agg(F.min(F.struct("l_orderkey", "l_linenumber")).alias("seen"))
    s = table(spark, sf_dir, "supplier").selectExpr("s_suppkey dst", "s_name name", "s_acctbal < 0 withdrawn")
    j = e.join(s, "dst")
    rank = F.row_number().over(Window.partitionBy("src").orderBy("type", "dst"))
    text = F.concat(F.lit("Relationship: "), F.col("src").cast("string"), F.lit(" "), "type", F.lit(" "), "name", F.lit(". Evidence: order "), F.col("seen.l_orderkey").cast("string"))
    return j.withColumn("rank", rank.cast("long")).where("rank <= 5").select("src", "rank", text.alias("explained"), F.when(F.col("withdrawn"), F.concat(F.lit("LIFECYCLE_WARNING: "), "name")).alias("warning"))


def text_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-09: a report in Markdown for each language, a line for each source."""
    d = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    line = F.concat(F.lit("| "), "source", F.lit(" | "), F.col("n").cast("string"), F.lit(" | "), F.col("chars").cast("string"), F.lit(" |"))
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("source", line.alias("l")))), lambda x: x["l"]), "\n")
    return d.groupBy("lang").agg(F.concat(F.lit("# "), F.first("lang"), F.lit("\n| source | documents | characters |\n|---|---|---|\n"), lines).alias("report"))


def strict_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSN-02: answers of a model: fence off, both lists must be there, standards struck out of the values; null otherwise."""
    texts = ('{"equipment": ["pump", " IS 1239 valve "], "work_type": "repair"}', '```json\n{"equipment": [], "work_type": ["supply"]}\n```', '{"equipment": ["x"]}', "no json", '{"equipment": 5, "work_type": []}')
    t = F.element_at(F.array(*map(F.lit, texts)), (F.col("doc_id") % len(texts) + 1).cast("int"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.regexp_replace(F.trim(t), r"^```(?:json)?\s*", ""), r"\s*```$", "").alias("j"))

    def values(key: str):
        raw = F.get_json_object("j", f"$.{key}")
        items = F.when(raw.startswith("["), F.from_json(raw, "array<string>")).when(F.col("j").rlike(f'"{key}"\\s*:\\s*"'), F.array(raw))
        clean = F.transform(items, lambda x: F.trim(F.regexp_replace(x, r"(?i)\b(?:IS|SP)\s*[0-9]+", "")))
        return F.filter(clean, lambda x: x != "")

    both = {k: values(k) for k in ("equipment", "work_type")}
    ok = both["equipment"].isNotNull() & both["work_type"].isNotNull()
    return d.select("doc_id", *[F.when(ok, F.array_join(v, ",")).alias(k) for k, v in both.items()])


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        scope_check, clause_kinds, domain_detect, application_profile, entity_list, attribute_ladders, standard_roles, role_order, acronym_expansion, clause_names, dependency_context, cohorts, safety_gates,
        evidence_choice, natural_order, provenance_match, tender_lookup, compat_projection, status_repair, cells_exploded, nested_records, package_spans, field_values, guarded_candidates, relation_report, text_report, strict_json,
    )
}


def listed(values) -> str:
    return "[" + ", ".join(value_quote(v) for v in values) + "]"


def hit(pattern: str, f: str = "f") -> str:
    return f"regexp_matches({f}, {value_quote(pattern)})"


def ladder_sql(steps, f: str = "f") -> str:
    return "case " + " ".join(f"when {hit(m, f)}" + (f" and not {hit(x, f)}" if x else "") + f" then {value_quote(v)}" for v, m, x in steps) + " end"


def fold_sql(t: str) -> str:
    return f"regexp_replace(lower({t}), {value_quote(E.FOREIGN)}, '_', 'g')"


PHRASE = f"({listed(PHRASES)})[doc_id % {N} + 1]"
REQ = f"a0 as (select doc_id, coalesce(text, '') || ' ' || {PHRASE} t from documents), a as (select doc_id, t, {fold_sql('t')} f from a0)"
ONLY = f"a as (select doc_id, {PHRASE} t, {fold_sql(PHRASE)} f from documents)"
TOKEN = r"\b((?:IS/ISO|IS/IEC|IS|SP)\s*/?\s*[0-9]+(?:\s*(?:Part|Sec)\s*[0-9]+)*(?:\s*\(Part\s*[0-9]+\))?)"
TOKENS_SQL = f"list_transform(regexp_extract_all(t, {value_quote('(?i)' + TOKEN)}, 1), lambda x: replace(upper(regexp_replace(trim(x), '\\s+', ' ', 'g')), ' / ', '/'))"
ENTITY_LISTS = ", ".join(f"{{'p': {i}, 'k': {value_quote(k)}, 'm': regexp_extract_all(f, {value_quote(p)}, 1)}}" for i, (k, p) in enumerate(E.ENTITIES))
TITLE_SQL = f"select p_partkey, p_size, ({listed(x[0] for x in TITLES)})[p_partkey % {len(TITLES)} + 1] number, ({listed(x[1] for x in TITLES)})[p_partkey % {len(TITLES)} + 1] title from part"
ROLE_SQL = (
    f"case when {hit(E.PRODUCT_NUMBERS, 'number')} and not {hit(E.CODE_NUMBERS, 'number')} then 'PRIMARY_PRODUCT' when {hit('food grinding machines|kitchen machines|electric food mixer|portable electric tools|hand-held electric tools|similar electrical appliances|household.*(?:safety|appliances)|(?:safety|appliances).*household', 'title')} then 'APPLIANCE_TOOL' "
    f"when {hit(E.FACILITIES, 'title')} and (contains(title, 'code of practice') or contains(title, 'haccp') or {hit(E.CODE_NUMBERS, 'number')}) then 'FACILITY_PREMISE' "
    f"when contains(title, 'code of practice') or {hit(E.CODE_NUMBERS, 'number')} or contains(title, 'haccp') or contains(title, 'guidelines') or {hit('installation and maintenance|installation of|laying of', 'title')} then 'INSTALLATION_CODE' else coalesce({ladder_sql(E.TITLE_ROLES, 'title')}, 'PRIMARY_PRODUCT') end"
)
CALIBRATION = """c as (select 'R-' || doc_id id, case when toxic = 1 then 'REJECT_INELIGIBLE' when doc_id % 11 = 0 then 'ABSTAIN_UNDER_SPECIFIED' when doc_id % 7 = 0 then 'REVIEW' else 'RECOMMEND' end expected,
case doc_id % 4 when 0 then '' when 1 then 'IS 1; IS 2' when 2 then 'IS 732 : 2019' else 'IS 1' end standard, doc_id % 13 = 0 probe, doc_id % 6 = 5 competing, doc_id % 3 = 0 verified, quality = 1 recommended from labels
union all select 'NEG-00' || i, 'X', 'IS 1', false, false, true, false from range(1, 6) t(i))"""
WORDS = "list_filter(regexp_split_to_array(lower(t), '[\\s,\\-/:]+'), lambda w: length(w) > 2)"
ACRONYM_CASES = "case w " + " ".join(f"when '{k}' then {listed(v)}" for k, v in E.ACRONYMS.items()) + " end"
DEP = f"({listed([*[d[0] for d in E.DEPENDENCIES], 'UNHEARD_OF'])})[doc_id % {len(E.DEPENDENCIES) + 1} + 1]"
dep_case = lambda j, other: "case kind " + " ".join(f"when '{d[0]}' then '{d[j]}'" for d in E.DEPENDENCIES) + f" else '{other}' end"

SQL: dict[str, str] = {
    "scope_check": f"with {ONLY}, w as (select *, regexp_extract_all(f, '\\b[a-z]{{3,}}\\b') w from a) select doc_id, (case when trim(f) = '' then 0 " + " ".join(f"when {hit(p)} then {i}" for i, p in enumerate(E.OUT_OF_SCOPE, 1)) + f" when list_has_any(w, {listed(E.CORE)}) then null when len(list_filter(w, lambda x: not list_contains({listed(E.GENERIC)}, x))) < 2 and not {hit(chr(92) + 'bis' + chr(92) + 's*[0-9]+')} then 9 end)::bigint as rule from w",
    "clause_kinds": f"with {REQ} select doc_id, {hit(E.ADMINISTRATIVE)} and not {hit(E.PRODUCTS)} administrative, {hit(E.DISCRETION)} and len({TOKENS_SQL}) = 0 discretionary from a",
    "domain_detect": f"with {REQ} select doc_id, concat_ws(',', " + ", ".join(f"case when {hit(E.domain_pattern(k))} then '{d}' end" for d, k in E.DOMAINS.items()) + ") domains from a",
    "application_profile": f"with {REQ}, n as (select *, nullif(regexp_extract(f, {value_quote(E.PRESSURE)}, 1), '')::double bar, nullif(regexp_extract(f, {value_quote(E.TEMPERATURE)}, 1), '')::double deg from a) select doc_id, " + ", ".join((f"coalesce({ladder_sql(s)}, case when bar > 1 then 'pressurized' end)" if k == "pressure_rating_mode" else ladder_sql(s)) + f" {k}" for k, s in E.TRAITS.items()) + ", deg operating_temperature_c from n",
    "entity_list": f"with {REQ}, m as (select doc_id, f, unnest([{ENTITY_LISTS}]) e from a), o as (select doc_id, f, e.p p, e.k k, unnest(e.m) x, generate_subscripts(e.m, 1) i from m), d as (select doc_id, f, k, x, min(p * 1000000 + i) o from o group by all), n as (select * from d where not exists (select 1 from d b where b.doc_id = d.doc_id and b.o < d.o and contains(b.x, d.x))), z as (select * from n where not exists (select 1 from n b where b.doc_id = n.doc_id and b.x <> n.x and contains(b.x, n.x) and b.k = n.k)), g as (select doc_id, string_agg(k || ':' || x, ',' order by instr(f, x), o) entities, bool_or(k in ('material', 'product', 'equipment', 'electrical', 'control')) core, bool_or(k = 'application') app from z group by doc_id) select doc_id, coalesce(entities, '') entities, (case when core and app then 1.0 when core then 0.9 when entities is not null then 0.7 else 0.3 end)::double confidence from a left join g using (doc_id)",
    "attribute_ladders": f"with {ONLY} select doc_id, {ladder_sql(E.MATERIALS)} material, " + ", ".join(f"{ladder_sql(s)} {k}" for k, s in E.ATTRIBUTES.items()) + " from a",
    "standard_roles": f"with t as ({TITLE_SQL}) select {ROLE_SQL} as role, count(*) n, min(p_partkey) as first from t group by 1",
    "role_order": f"with t as ({TITLE_SQL}), c as (select p_partkey // 20 query, p_partkey doc, {ROLE_SQL} as role, p_size / 50.0::double score from t), b as (select *, case when round(max(score) over (partition by query) - score, 9) > 0.20::double then 3 when role = 'PRIMARY_PRODUCT' then 0 when role in ('INSTALLATION_CODE', 'FACILITY_PREMISE') then 1 else 2 end::bigint tier from c) select query, row_number() over (partition by query order by tier, score desc, doc)::bigint as rank, doc, tier from b qualify rank <= 5",
    "acronym_expansion": f"with {ONLY}, w as (select doc_id, {WORDS} w from a) select doc_id, array_to_string(list_concat(w, flatten(list_filter(list_transform(w, lambda w: {ACRONYM_CASES}), lambda x: x is not null))), ' ') words from w",
    "clause_names": f"with {REQ} select doc_id, coalesce(nullif(regexp_extract(t, '(?i)\\b(?:Clause|Section|Cl\\.)\\s*([0-9]+(?:\\.[0-9]+)*)\\b', 1), ''), 'Table ' || nullif(regexp_extract(t, '(?i)\\bTable\\s+([0-9]+(?:\\.[0-9]+)*)\\b', 1), ''), case lower(regexp_extract(t, '(?i)\\b(Foreword|Scope)\\b', 1)) when 'foreword' then 'Foreword' when 'scope' then 'Scope' end) clause, array_to_string({TOKENS_SQL}, ',') standards, 'PROVISIONAL:' || (['CIVIL_WORKS', 'ELECTRICAL', 'MECHANICAL', 'CATERING', 'WOOD___PAPER'])[doc_id % 5 + 1] sector from a",
    "dependency_context": f"with {REQ}, k as (select *, {DEP} kind from a) select doc_id, {dep_case(1, 'other')} as role, {dep_case(2, 'RELATED_FOR_REVIEW')} status, case " + " ".join(f"when kind = '{d[0]}' and {hit(d[3]) if d[3] else 'true'} then 'APPLICABLE'" for d in E.DEPENDENCIES if d[3] is not None) + " else 'REVIEW_REQUIRED' end applies from k",
    "cohorts": f"with {CALIBRATION} select case when probe or contains(id, 'NEG-002') then 'RETRIEVAL_DISTRACTOR_PROBE' when expected = 'REJECT_INELIGIBLE' or regexp_matches(id, 'NEG-00[145]') then 'OPEN_SET_INELIGIBLE' when expected = 'ABSTAIN_UNDER_SPECIFIED' or contains(id, 'NEG-003') or standard = '' and expected <> 'RECOMMEND' then 'UNDER_SPECIFIED' when competing then 'AMBIGUOUS_COMPETING' when contains(standard, ';') then 'ANSWERABLE_IN_DOMAIN_COMPOUND' when standard = 'IS 732 : 2019' then 'LIFECYCLE_EDITION_SENSITIVE' else 'ANSWERABLE_IN_DOMAIN_SINGLE' end cohort, count(*) n, count(*) filter (verified) verified from c group by 1",
    "safety_gates": f"with {CALIBRATION}, s as (select count(*) filter (expected = 'REJECT_INELIGIBLE' and recommended) false_recommendations, count(*) filter (expected = 'REVIEW' and recommended) risky, count(*) filter (expected = 'ABSTAIN_UNDER_SPECIFIED' and verified) adjudicated from c) select *, false_recommendations = 0 and risky = 0 and adjudicated >= 5 ready from s",
    "evidence_choice": "with e as (select l_orderkey, l_linenumber, l_quantity / 50.0::double overlap, case when l_quantity < 3 then 0 when l_quantity < 15 then 1 when l_quantity < 25 then 2 when l_quantity < 40 then 3 else 4 end o from lineitem), f as (select * from e qualify row_number() over (partition by l_orderkey order by o, l_linenumber, overlap) = 1) select (['CONFLICTING', 'FULLY_SUPPORTED', 'PARTIALLY_SUPPORTED', 'UNSUPPORTED', 'UNVERIFIED_COVERAGE'])[o + 1] state, count(*) n, round(avg(overlap), 6) mean_overlap from f group by 1",
    "natural_order": "select 'File' || c_custkey || '.pdf' as name from customer order by c_custkey limit 30",
    "provenance_match": f"with {LINES}, q as (select doc_id, lower(trim(regexp_replace(substring(text, 21, 40), '\\s+', ' ', 'g'))) req from documents), r as (select * from q where length(req) > 10), h as (select doc_id, min(line) line from l join r using (doc_id) where contains(lower(trim(regexp_replace(t, '\\s+', ' ', 'g'))), req) group by doc_id) select doc_id, line, case when line is null then 'UNRESOLVED_TEXT_MISMATCH' else 'VERIFIED_DEFENSIBLE' end status from r left join h using (doc_id)",
    "tender_lookup": "with f as (select c_custkey, case c_custkey % 3 when 0 then 'f' || c_custkey || '.pdf' when 1 then 'tender_' || c_custkey || '.pdf' else 'x' || c_custkey || '.doc' end base from customer), k as (select 'f' || (n_nationkey * 3) || '.pdf' base, 'T-' || n_name tender from nation) select c_custkey, coalesce(tender, case when c_custkey % 3 < 2 then 'T' || case when length(c_custkey::varchar) < 3 then lpad(c_custkey::varchar, 3, '0') else substring(c_custkey::varchar, 1, 3) end end, 'T_UNKNOWN') tender from f left join k using (base)",
    "compat_projection": "select 'IS-' || p_partkey standard_id, 'IS ' || p_partkey standard_number, 1950 + p_size as year, p_name full_title, case when p_size > 40 then 'WITHDRAWN' else 'ACTIVE' end status, null::int reaffirmed_year, p_size % 4 amendments_count, p_brand technical_committee, null::varchar ics, null::varchar udc, null::varchar scope, p_type notes, 'catalogue' source, null::varchar source_url, null::varchar retrieved_at, 'IS ' || p_partkey original_identifier, 'VERIFIED' verification_status, 'seed: ' || (p_size % 10) evidence from part",
    "status_repair": "with p as (select p_partkey, p_partkey % 3 = 0 unk, p_partkey % 5 m, 'IS/ISO ' || p_partkey || ' : ' || (1990 + p_size) as key from part) select p_partkey, case when unk and m >= 2 then 'UNKNOWN' else 'ACTIVE' end status, unk and m < 2 recovered, case when m = 3 then 'ISO 9001' end iso, key from p",
    "cells_exploded": "select p_partkey k, p_name as name, unnest([p_size::varchar, (p_size + 1)::varchar, p_brand]) cell from part",
    "nested_records": "select p_partkey id, unnest(['IS ' || p_size, 'SP ' || (p_size % 7)]) n, unnest(['cites', 'references']) kind from part where p_partkey % 3 < 2",
    "package_spans": f"with {LINES}, m as (select doc_id, line, case when line % 5 = 0 then 'Lot ' || (line // 5 + 1) || ': works' else t end t from l), c as (select *, nullif(regexp_extract(lower(t), {value_quote(HEADER)}, 1), '') code from m), s as (select *, count(code) over (partition by doc_id order by line rows unbounded preceding) seq from c), g as (select doc_id, seq, max(code) code, count(*) filter (code is null and t <> '') lines from s where seq > 0 group by all) select doc_id, seq, 'PKG-' || case when regexp_matches(code, '^[0-9]$') then '0' || code else upper(code) end package, lines from g",
    "field_values": f"with {LINES}, m as (select doc_id, line, case when line % 6 = 2 then 'Title of Work' else t end t from l), n as (select *, lead(t) over (partition by doc_id order by line) value from m) select doc_id, line, sha256(value) as value from n where lower(t) = 'title of work'",
    "guarded_candidates": "with c as (select p_partkey doc, p_partkey % 50 query, lower(p_name) || case when p_partkey % 4 = 0 then ' agricultural' else '' end title, lower(p_type) || ' ' || lower(p_name) wanted, p_partkey % 50 % 2 = 0 industrial from part), k as (select *, len(list_intersect(string_split(title, ' '), string_split(wanted, ' '))) shared from c where not (industrial and contains(title, 'agricultur'))), b as (select query, count(*) n, min(doc) as first from k where shared > 2 group by query) select query, coalesce(n, 0) n, first, n is null potential_gap from (select distinct query from c) left join b using (query)",
    "relation_report": "with e as (select l_partkey src, l_suppkey dst, case l_linenumber % 3 when 0 then 'REFERENCES' when 1 then 'SUPERSEDES' else 'TEST_METHOD' end as type, min(l_orderkey) o from lineitem group by all), r as (select src, row_number() over (partition by src order by type, dst)::bigint as rank, 'Relationship: ' || src || ' ' || type || ' ' || s_name || '. Evidence: order ' || o explained, case when s_acctbal < 0 then 'LIFECYCLE_WARNING: ' || s_name end warning from e join supplier on dst = s_suppkey) select * from r where rank <= 5",
    "text_report": "with g as (select lang, source, count(*) n, sum(n_chars)::bigint chars from documents group by all) select lang, '# ' || lang || chr(10) || '| source | documents | characters |' || chr(10) || '|---|---|---|' || chr(10) || string_agg('| ' || source || ' | ' || n || ' | ' || chars || ' |', chr(10) order by source) report from g group by lang",
    "strict_json": "select doc_id, case doc_id % 5 when 0 then 'pump,valve' when 1 then '' end equipment, case doc_id % 5 when 0 then 'repair' when 1 then 'supply' end work_type from documents",
}
