"""Functions and operators against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from larkspan.functions import idents as I
from larkspan.functions import text as T
from larkspan.operators import catalogue as C
from larkspan.operators import evaluation as E
from larkspan.operators import graph as G
from larkspan.streaming import events as S

# own identifiers, one for each shape that the grammar knows
GOLDEN = [
    ("IS 40321:1994", "IS", "40321", None, None, 1994, "IS-40321-1994"),
    ("IS 77 (Part 3):2001", "IS", "77", 3, None, 2001, "IS-77-Part-3-2001"),
    ("IS 905 (Part 12/Sec 4):1979", "IS", "905", 12, 4, 1979, "IS-905-Part-12-Sec-4-1979"),
    ("IS/ISO 31000:2019", "IS/ISO", "31000", None, None, 2019, "IS-ISO-31000-2019"),
    ("IS/IEC/TS 62257-7:2011", "IS/IEC/TS", "62257", 7, None, 2011, "IS-IEC-TS-62257-Part-7-2011"),
    ("IS/CISPR 32-2-5:2018", "IS/CISPR", "32", 2, 5, 2018, "IS-CISPR-32-Part-2-Sec-5-2018"),
    ("IS/QC 004410:1991", "IS/QC", "004410", None, None, 1991, "IS-QC-004410-1991"),
    ("SP 51:1998", "SP", "51", None, None, 1998, "SP-51-1998"),
    ("20417 20417:2022", "IS", "20417", None, None, 2022, "IS-20417-2022"),
]
INVALID = ["IS/QC :1999", "IS/CISPR -3:2004", "IS (Part 9):1968", "", None, "nothing here"]


def test_identifiers(spark):
    df = I.parsed(spark.createDataFrame([(x[0],) for x in GOLDEN], "raw string"), "raw")
    got = {r.raw: r.ident for r in df.collect()}
    for raw, prefix, base, part, section, year, cid in GOLDEN:
        i = got[raw]
        assert (i.prefix, i.base, i.part, i.section, i.year, i.canonical_id, i.valid) == (prefix, base, part, section, year, cid, True), raw


def test_invalid_identifiers(spark):
    df = I.parsed(spark.createDataFrame([(x,) for x in INVALID], "raw string"), "raw")
    assert [(r.raw, r.ident.canonical_id) for r in df.collect() if r.ident.valid or r.ident.canonical_id != "UNKNOWN"] == []


def test_tokens_and_sanitising(spark):
    one = spark.range(1)
    t = one.select(T.tokens(F.lit("The Pump-set, of 11 kV and X")).alias("t"), T.sanitized(F.lit('a {"x": 1} b.. [NOTE: c] d')).alias("s"), T.tokens(F.lit(None).cast("string")).alias("n")).first()
    assert t.t == ["pump", "set", "11", "kv"] and t.s == "a b. d" and t.n == []


def test_wilson(spark):
    rows = spark.createDataFrame([(10, 20), (17, 19), (0, 0)], "k bigint, n bigint")
    lo, hi = E.wilson(F.col("k"), F.col("n"))
    assert [tuple(r) for r in rows.select(lo, hi).collect()] == [(29.9, 70.1), (68.6, 97.1), (None, None)]


def test_metrics(spark):
    cases = spark.createDataFrame([("RECOMMEND", 1), ("RECOMMEND", 2), ("RECOMMEND", 3), ("RECOMMEND", None)], "expected string, rank int").withColumn("g", F.lit(1))
    r = E.retrieval_metrics(cases, ["g"]).first()
    assert (r.top1, r.top3, round(r.mrr, 3)) == (25.0, 75.0, 0.458)


def test_snapshot_diff(spark):
    old = spark.createDataFrame([(1, "a", "ACTIVE"), (2, "b", "ACTIVE"), (3, "", "ACTIVE"), (4, "d", "ACTIVE")], "id int, title string, status string")
    new = spark.createDataFrame([(1, "a2", "ACTIVE"), (2, "b", "WITHDRAWN"), (3, None, "ACTIVE"), (5, "e", "ACTIVE")], "id int, title string, status string")
    got = {r.id: (r.change_type, r.changed_fields) for r in C.snapshot_diff(old, new, "id", ["title", "status"], "status").collect()}
    assert got == {1: ("UPDATED", ["title"]), 2: ("WITHDRAWN", ["status"]), 3: ("UNCHANGED", []), 4: ("MISSING_FROM_SOURCE", ["presence"]), 5: ("NEW", ["ALL"])}


def test_passive_edges_are_turned(spark):
    e = spark.createDataFrame([("old", "new", "superseded_by"), ("new", "old", "SUPERSEDES")], "src string, dst string, type string")
    assert {tuple(r) for r in G.canonical_edges(e).collect()} == {("new", "old", "SUPERSEDES")}


def test_csv_guard(spark):
    rows = spark.createDataFrame([("=1",), ("a",), (None,), ("",)], "c string")
    assert [r[0] for r in rows.select(I.csv_guarded(F.col("c"))).collect()] == ["'=1", "a", None, ""]


def test_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    events = spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id,0) ts, id % 2 user_id, cast(id as double) value from range(180)")
    events.repartition(3).write.parquet(src)
    stream = S.read(spark, src, events.schema)
    q = S.tumbling(stream, "1 hour", ["user_id"], "value").writeStream.outputMode("complete").format("memory").queryName("hours").trigger(availableNow=True).start()
    q.awaitTermination(90)
    want = {tuple(r) for r in S.tumbling(events, "1 hour", ["user_id"], "value").collect()}
    assert {tuple(r) for r in spark.table("hours").collect()} == want


@pytest.mark.parametrize("name", ["bm25_topk"])
def test_entry(spark, name):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
