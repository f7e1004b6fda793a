"""Personal data by weak supervision, in DataFrame and SQL functions only.

Base spans come from fixed patterns (email, ip, card, phone) and always stay. Further candidates are spans that the fixed
patterns miss: masked email addresses, numbers of card length that fail the check digit, phone numbers without a plus sign
and mixed strings that look like keys. Six labelers (regex validity, gazetteers of words before a span, issuer prefixes,
shape, boundaries) vote +1, 0 or -1 on every span. Expectation-maximisation over the counts of vote patterns (at most
3**6 rows, whatever the input) estimates each labeler's reliability in each class. The posteriors are the soft labels on
which the final span classifier, naive Bayes over FEATURES, is trained; a candidate above KEEP becomes a span.

Positions: the matches of a pattern and the text between them (split by the same pattern) give every start by a running
sum. Running sums and maxima go through arrays in chunks, and texts are read in pieces of PIECE code points, so that the
time of a text is linear in its length and its number of matches. Patterns equal to the stated ones are written so that they can't backtrack: a run of digits or name characters is
entered only at its begin or where the last match ended, and quantifiers are possessive where that changes nothing.

Only two rows of sums come to the driver, whose values enter the plan as literals.

Defined results: null and empty texts have no spans; overlapping candidates give way to base spans, then to earlier and
longer ones; spans that overlap are masked as one, by the kind of the first; repeated rows each give a row; extra columns are ignored; without any span the model keeps nothing more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm._common import blank, cut, table

KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
MORE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:\x20?[\[(]dot[\])]\x20?[A-Za-z0-9-]++|\.[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])(?=[0-9]*+[A-Za-z])[A-Za-z0-9]{12,64}+(?![A-Za-z0-9])",
}
CLUES = r"(?i)(mail|e-mail|phone|tel|fon|call|mobile|fax|card|karte|carte|tarjeta|visa|ip|host|address|password|passwort|passwd|pwd|token|secret|key|api|login|user)\W{0,4}$"
AGAINST = r"(?i)(version|page|chapter|volume|section|article|figure|table|isbn|issn|doi|license|licence|sha|commit|build|rev)\W{0,4}$"
KEEP, ROUNDS, LABELERS = 0.5, 25, 6
CHUNK, PIECE, FAR = 256, 1024, 2**31 - 1
SPAN = "array<struct<s:int,e:int,m:string>>"
#: features of the final classifier, over a span x
FEATURES = ("x.kind = 'email'", "x.kind = 'ip'", "x.kind = 'card'", "x.kind = 'phone'", "x.kind = 'secret'", "x.votes[1] = 1", "x.votes[2] = -1", "x.votes[3] = 1", "x.votes[4] = 1", "x.votes[4] = -1", "x.votes[5] = 1", "x.e - x.s >= 16", "x.e - x.s >= 32")


def bound(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, start: int, op) -> Column:
    """For each element (int) what op makes of start and all elements before it. op is associative, start neutral. Lists
    grow by appending only within a chunk, and within the list of chunks."""

    def scan(x: Column, begin: Column) -> Column:
        none = F.struct(begin.alias("now"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(x, none, lambda a, v: F.struct(op(a["now"], v).alias("now"), F.array_append(a["out"], a["now"]).alias("out")), lambda a: a["out"])

    def chunked(v: Column) -> Column:
        last = F.greatest(F.floor((F.size(v) - 1) / CHUNK), F.lit(0)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda j: F.slice(v, j * CHUNK + 1, CHUNK))

    begin = F.lit(start).cast("int")
    totals = lambda chunks: F.transform(chunks, lambda c: F.aggregate(c, begin, lambda a, v: op(a, v)))
    return bound(values, lambda v: bound(chunked(v), lambda chunks: F.flatten(F.zip_with(chunks, scan(totals(chunks), begin), scan))))


def located(t: Column, pattern: str, gate: Column) -> Column:
    """Starts, ends (exclusive, in code points) and texts of the leftmost matches, where gate holds."""
    pairs = F.arrays_zip(F.split(t, pattern, -1).alias("gap"), F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("m"))

    def spans(z: Column) -> Column:
        begin = running(F.transform(z, lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["m"]), F.lit(0))), 0, lambda a, x: a + x)
        found = F.zip_with(z, begin, lambda x, at: F.struct((at + F.length(x["gap"])).alias("s"), (at + F.length(x["gap"]) + F.length(x["m"])).alias("e"), x["m"].alias("m")))
        return F.filter(found, lambda x: x["m"].isNotNull())

    return F.when(gate, bound(pairs, spans)).otherwise(F.array().cast(SPAN))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    d = digits(m)
    n = F.length(d)

    def add(total: Column, i: Column) -> Column:
        x = F.substring(d, n - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, 2 * x - F.when(x > 4, 9).otherwise(0)).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(m, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.when(F.length(part(p)).between(1, 3), part(p).cast("int")).otherwise(0) <= 255))
    if kind == "card":
        return F.length(digits(m)).between(12, 19) & luhn(m)
    if kind == "phone":
        return F.length(digits(m)).between(9, 15)
    return F.lit(True)


def base_spans(t: Column) -> dict[str, Column]:
    """The valid base spans of each kind, in order."""
    has_digit = t.rlike("[0-9]")
    gates = {"email": F.instr(t, "@") > 0, "ip": has_digit & t.rlike(r"[0-9]\.[0-9]"), "card": has_digit & t.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), "phone": F.instr(t, "+") > 0}

    def right(kind: str):
        return lambda x: valid(kind, x["m"])

    return {k: F.filter(located(t, BASE[k], gates[k]), right(k)) for k in KINDS}


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_text: bool = False) -> DataFrame:
    """(doc_id, spans[, t]): spans are struct(kind, s, e, base, votes), base spans and candidates, by start and kind."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), blank(text).alias("t"), *([F.struct("*").alias("row")] if keep_text else []))
    t = F.col("t")
    has_digit = t.rlike("[0-9]")
    more = {
        "email": located(t, MORE["email"], t.rlike(r"[\[(]at[\])]")),
        "phone": located(t, MORE["phone"], has_digit & t.rlike(r"[0-9]{3}[\x20.-][0-9]{4}")),
        "secret": located(t, MORE["secret"], has_digit & t.rlike(r"[0-9A-Za-z]{12}")),
        "card": F.filter(located(t, BASE["card"], has_digit & t.rlike(r"[0-9](?:[\x20-]?[0-9]){11}")), lambda x: F.length(digits(x["m"])).between(12, 19) & ~luhn(x["m"])),
    }
    rows = rows.select("*", *[c.alias(f"b_{k}") for k, c in base_spans(t).items()], *[c.alias(f"m_{k}") for k, c in more.items()])
    tag = lambda c, k, base: F.transform(F.col(c), lambda x: F.struct(F.lit(k).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), F.lit(base).alias("base")))
    rows = rows.withColumn("b", F.flatten(F.array(*[tag(f"b_{k}", k, True) for k in KINDS]))).withColumn("c", F.flatten(F.array(*[tag(f"m_{k}", k, False) for k in ("email", "phone", "secret", "card")])))
    # candidates give way to base spans and to other candidates that begin earlier or are longer
    marked = F.array_sort(F.transform(F.concat("b", "c"), lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("back"), x["kind"].alias("kind"), x["base"].alias("base"), x["m"].alias("m"), x["e"].alias("e"))))

    def free(x: Column) -> Column:
        base_end = running(F.transform(x, lambda y: F.when(y["base"], y["e"]).otherwise(0)), 0, F.greatest)
        other_end = running(F.transform(x, lambda y: F.when(y["base"], F.lit(0)).otherwise(y["e"])), 0, F.greatest)
        next_base = F.reverse(running(F.reverse(F.transform(x, lambda y: F.when(y["base"], y["s"]).otherwise(F.lit(FAR)))), FAR, F.least))
        beside = F.arrays_zip(x.alias("x"), base_end.alias("base_end"), other_end.alias("other_end"), next_base.alias("next_base"))
        kept = F.filter(beside, lambda y: y["x"]["base"] | ((y["base_end"] <= y["x"]["s"]) & (y["other_end"] <= y["x"]["s"]) & (y["next_base"] >= y["x"]["e"])))
        return F.transform(kept, lambda y: y["x"])

    rank = "case x.kind when 'email' then 0 when 'ip' then 1 when 'card' then 2 when 'phone' then 3 else 4 end"
    rows = rows.withColumn("all", bound(marked, free))
    ordered = f"array_sort(transform(all, x -> struct(x.s as s, {rank} as r, x.e as e, x.kind as kind, x.m as m, x.base as base)))"
    rows = rows.withColumn("spans", F.expr(f"transform(array({in_pieces('case when size(all) = 0 then \'\' else t end')}), parts -> transform({ordered}, x -> struct(x.kind, x.s, x.e, x.base, {votes('x')} as votes)))[0]"))
    return rows.select("doc_id", "spans", *(["t", "row"] if keep_text else []))


def in_pieces(t: str) -> str:
    """SQL: the text t as an array of pieces of PIECE code points."""
    return f"regexp_extract_all({t}, r'(?s).{{1,{PIECE}}}', 0)"


def part(i: str) -> str:
    return f"coalesce(get(parts, cast({i} as int)), '')"


def some_of(start: str, n: str) -> str:
    """SQL: at most n (less than PIECE) code points from start on, of the text whose pieces are parts."""
    return f"substring(concat({part(f'({start}) div {PIECE}')}, {part(f'({start}) div {PIECE} + 1')}), ({start}) % {PIECE} + 1, {n})"


def between(a: str, b: str) -> str:
    """SQL: the text from a to b (exclusive), of which parts are the pieces; reads no piece outside."""
    i, j = f"cast({a} div {PIECE} as int)", f"cast(({b} - 1) div {PIECE} as int)"
    many = f"concat(substring({part(i)}, {a} % {PIECE} + 1), array_join(slice(parts, {i} + 2, {j} - {i} - 1), ''), substring({part(j)}, 1, ({b} - 1) % {PIECE} + 1))"
    return f"(case when {b} <= {a} then '' when {i} = {j} then substring({part(i)}, {a} % {PIECE} + 1, {b} - {a}) else {many} end)"


def votes(x: str) -> str:
    """The six votes on a span, as SQL."""
    before = some_of(f"greatest({x}.s - 24, 0)", f"least({x}.s, 24)")
    after = some_of(f"{x}.e", "1")
    sides = f"concat(case when {x}.s = 0 then ' ' else {some_of(f'greatest({x}.s - 1, 0)', '1')} end, case when {after} = '' then ' ' else {after} end)"
    plain = f"regexp_replace({x}.m, '[^0-9A-Za-z]', '')"
    return (
        "array("
        f"case when {x}.base then 1 when {x}.kind = 'card' then -1 else 0 end, "
        f"case when {before} rlike r'{CLUES}' then 1 else 0 end, "
        f"case when {before} rlike r'{AGAINST}' then -1 else 0 end, "
        f"case {x}.kind when 'card' then (case when {plain} rlike '^(4|5[1-5]|2[2-7]|3[47]|6011|65)' then 1 else -1 end) when 'secret' then (case when {plain} rlike '^(AKIA|ASIA|sk|ghp|xox|AIza)' then 1 else 0 end) when 'email' then (case when {x}.m rlike '(?i)(example|mail|com|org|net|edu)' then 1 else 0 end) else 0 end, "
        f"case when {plain} rlike r'(.)\\1{{5,}}' or {plain} rlike '012345|123456|abcdef' then -1 when {x}.kind = 'secret' and {plain} rlike '^([0-9a-f]+|[0-9A-Z]+)$' then 1 when {x}.kind = 'secret' and {plain} rlike '^[A-Za-z]+[0-9]{{1,4}}$' then -1 else 0 end, "
        f"case when {sides} rlike r'^[^0-9A-Za-z_]{{2}}$' then 1 else -1 end)"
    )


def likelihood(v: str, state: str, cls: int) -> str:
    start = f"{state}.pi" if cls else f"1 - {state}.pi"
    return f"aggregate(sequence(0, {LABELERS - 1}), {start}, (z, l) -> z * {state}.th[l * 6 + {0 if cls else 3} + {v}[l] + 1])"


def fit(found: DataFrame) -> tuple[dict, list[float]]:
    """Reliabilities by EM over vote patterns, and the weights of the span classifier: first the intercept, then for each
    feature the log-odds of its presence and of its absence."""
    spans = found.select(F.explode("spans").alias("x"))
    patterns = spans.groupBy(F.col("x.votes").alias("v")).agg(F.count("*").cast("double").alias("n"))
    one = patterns.agg(F.sort_array(F.collect_list(F.struct("v", "n"))).alias("pats"))
    post = f"transform(pats, p -> struct(p.v as v, p.n as n, {likelihood('p.v', 'st', 1)} as a, {likelihood('p.v', 'st', 0)} as b))"
    share = f"transform({post}, p -> struct(p.v as v, p.n * p.a / (p.a + p.b) as yes, p.n * p.b / (p.a + p.b) as no))"
    total = lambda what, cond="true": f"aggregate(w, cast(0 as double), (s, p) -> s + case when {cond} then {what} else 0d end)"
    th = (
        f"transform(sequence(0, {6 * LABELERS - 1}), i -> case when i % 6 < 3 then ({total('p.yes', 'p.v[cast(i div 6 as int)] = i % 3 - 1')} + 1d) / ({total('p.yes')} + 3d) "
        f"else ({total('p.no', 'p.v[cast(i div 6 as int)] = i % 3 - 1')} + 1d) / ({total('p.no')} + 3d) end)"
    )
    update = f"transform(array({share}), w -> struct(({total('p.yes')} + 1d) / ({total('p.yes')} + {total('p.no')} + 2d) as pi, {th} as th))[0]"
    start = f"struct(0.5d as pi, flatten(transform(sequence(1, {LABELERS}), l -> array(0.1d, 0.3d, 0.6d, 0.6d, 0.3d, 0.1d))) as th)"
    state = one.select(F.expr(f"aggregate(sequence(1, {ROUNDS}), {start}, (st, k) -> {update})").alias("st")).first()["st"]
    model = {"pi": state["pi"], "th": list(state["th"])}
    known = spans.withColumn("st", literal(model)).withColumn("a", F.expr(likelihood("x.votes", "st", 1))).withColumn("b", F.expr(likelihood("x.votes", "st", 0))).withColumn("q", F.expr("a / (a + b)"))
    sums = [F.sum("q").alias("yes"), F.sum(1 - F.col("q")).alias("no")]
    for i, f in enumerate(FEATURES):
        sums += [F.sum(F.expr(f"case when {f} then q else 0d end")).alias(f"y{i}"), F.sum(F.expr(f"case when {f} then 1 - q else 0d end")).alias(f"n{i}")]
    r = known.agg(*sums).first()
    import math

    yes, no = r["yes"] or 0.0, r["no"] or 0.0
    weights = [math.log((yes + 1) / (no + 1))]
    for i in range(len(FEATURES)):
        y, n = r[f"y{i}"] or 0.0, r[f"n{i}"] or 0.0
        weights += [math.log((y + 1) / (yes + 2)) - math.log((n + 1) / (no + 2)), math.log((yes - y + 1) / (yes + 2)) - math.log((no - n + 1) / (no + 2))]
    return model, weights


def literal(model: dict) -> Column:
    return F.struct(F.lit(model["pi"]).alias("pi"), F.array(*[F.lit(x) for x in model["th"]]).alias("th"))


def kept(weights: list[float], keep: float = KEEP) -> Column:
    """The base spans and the candidates that the classifier accepts, from column spans."""
    import math

    terms = " + ".join(f"case when {f} then {weights[1 + 2 * i]!r}d else {weights[2 + 2 * i]!r}d end" for i, f in enumerate(FEATURES))
    return F.expr(f"filter(spans, x -> x.base or {weights[0]!r}d + {terms} >= {math.log(keep / (1 - keep))!r}d)")


def joined(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, x -> concat(x.kind, ':', x.s, ':', x.e)), ',')")


def find_private(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans): the base spans and those that the method adds, each struct(kind, s, e, base, votes)."""
    found = cut(candidates(docs, doc_id, text))
    _, weights = fit(found)
    return found.select("doc_id", kept(weights).alias("spans"))


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with each span of text replaced by its kind in brackets. A null text stays null."""
    _, weights = fit(cut(candidates(docs, doc_id, text)))
    found = candidates(docs, doc_id, text, keep_text=True).withColumn("spans", kept(weights))
    found = found.withColumn("ends", running(F.transform("spans", lambda x: x["e"]), 0, F.greatest)).withColumn("last", F.array_max(F.transform("spans", lambda x: x["e"])))
    masks = f"array_join(zip_with(spans, ends, (x, p) -> case when x.s >= p then concat({between('p', 'x.s')}, '[', upper(x.kind), ']') else '' end), '')"
    rest = f"concat(substring({part(f'last div {PIECE}')}, last % {PIECE} + 1), array_join(slice(parts, cast(last div {PIECE} as int) + 2, size(parts)), ''))"
    masked = F.expr(f"transform(array({in_pieces('t')}), parts -> concat({masks}, {rest}))[0]")
    new = F.when(F.col(f"row.`{text}`").isNull(), F.lit(None).cast("string")).otherwise(F.when(F.size("spans") == 0, F.col("t")).otherwise(masked))
    return found.select(*[new.alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op5_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_private(table(spark, sf_dir, "documents")).withColumn("fixed", F.expr("filter(spans, x -> x.base)"))
    counts = [F.expr(f"cast(size(filter(fixed, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(joined("fixed"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def brute_force(text: str | None) -> list[tuple[str, int, int]]:
    """The base spans by the patterns as stated (small inputs only)."""
    import re

    def card(m: str) -> bool:
        d = [int(c) for c in m if c in "0123456789"]
        return 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(reversed(d))) % 10 == 0

    stated = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", card),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= sum(c.isdigit() for c in m) <= 15),
    }
    out = [(m.start(), i, k, m.end()) for i, (k, (p, ok)) in enumerate(stated.items()) for m in re.finditer(p, text or "") if ok(m.group())]
    return [(k, s, e) for s, _, k, e in sorted(out)]
