"""The training-data operators against brute force, and on nulls, empty and repeated rows, clashing names, empty tables."""

import hashlib
import math
import random
import struct
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from larkspan.llm import fingerprints, htmltext, mixing, neardup, packing, privacy, queries, substrings, suffixtree, topk, toxicity

SF = "/root/testdata/sf0.001"
ODD = "doc_id bigint, text string, lang string, source string, n_chars bigint, k int, t string, row int, bucket string, epoch int, domain string, spans int, word string, c int"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and clashing names."""
    long = " ".join(f"w{i % 997}" for i in range(30_000))
    base = [(1, "a b c d e f " * 12), (2, "a b c d e f " * 12), (2, "a b c d e f " * 12), (3, ""), (4, None), (None, "x y"), (5, long), (6, "one"), (7, " \t\n"), (None, None)]
    return spark.createDataFrame([(i, t, None if i == 6 else "en", None if i == 3 else "src1", None, 9, "z", 1, "b", 2, "q", 3, "w", 4) for i, t in base], ODD)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


def test_fingerprints(spark, texts, odd, empty):
    got = {r.doc_id: r for r in fingerprints.op2_fingerprints(spark, SF).collect()}
    ids = sorted(texts, reverse=True)
    for at, i in enumerate(ids):
        t, n = texts[i], texts[ids[(at + 1) % len(ids)]]
        new = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    same = {}
    for i, t in texts.items():
        assert same.setdefault(t, got[i].fingerprint) == got[i].fingerprint
    assert sum(r.near_edited for r in got.values()) > 5 * sum(r.near_next for r in got.values())
    few = fingerprints.IMatch([f"w{i}" for i in range(40)])
    say = lambda n, more: few.fingerprint(" ".join([f"w{i}" for i in range(n)] + [f"x{i}" for i in range(more)]))
    steps = [few.likeness(say(n, 40), say(n + 1, 40)) for n in range(4, 14)]
    assert max(steps) - min(steps) < 0.5 and few.likeness(say(0, 3), say(0, 4)) == 0 and few.likeness(say(0, 3), say(0, 3)) == 1
    out = fingerprints.near_report(odd).collect()
    assert len(out) == odd.count() and {r.n_chars for r in out if r.doc_id == 4} == {0}
    assert fingerprints.near_report(empty).count() == 0


def test_topk(spark):
    duck = duckdb.connect()
    duck.sql(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    want = sorted(duck.sql(topk.OP3_SQL).fetchall())
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.op3_topk(spark, SF).collect()) == want
    v = spark.createDataFrame([(0, [1.0, 0.5]), (1, [0.5, None]), (2, None), (3, [float("nan"), 1.0]), (4, [1.0, 0.5]), (5, []), (6, [-1.0, 3.0]), (None, [1.0, 1.0]), (4, [1.0, 0.5])], "vec_id bigint, embedding array<float>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(v, lambda i: i == 0, 5, block=2).collect())
    assert got == [(0, 1, 4, 256 * 256 + 128 * 128), (0, 2, 4, 256 * 256 + 128 * 128), (0, 3, 6, -256 * 256 + 128 * 768), (0, 4, 5, 0)]
    assert topk.top_k(v.where("false"), lambda i: i == 0).count() == 0
    extra = v.selectExpr("vec_id", "embedding", "1 g", "'x' score", "2 query_id", "3 ids")
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(extra, lambda i: i == 0, 5, block=2).collect()) == got


def test_topk_of_large_components(spark):
    """Components beyond any integer type rank by their exact products; scores are held within a long."""
    v = spark.createDataFrame([(0, [600000.0]), (1, [600000.0]), (2, [0.5]), (3, [-700000.0])], "vec_id bigint, embedding array<float>")
    want = [(0, 1, 1, (600000 * 256) ** 2), (0, 2, 2, 600000 * 256 * 128), (0, 3, 3, -600000 * 700000 * 256**2)]
    assert sorted(tuple(r) for r in topk.top_k(v, lambda i: i == 0, block=2).collect()) == want
    rows = [(0, [1e30, 1.0]), (1, [1e30, 0.0]), (2, [2e30, 0.0]), (3, [-3e30, 5.0]), (4, [-1e30, 5.0]), (5, [0.0, 3.0]), (6, [1e300]), (7, [1e-300, 3.0])]
    wide = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(wide, lambda i: i == 0, 10, block=3).orderBy("rank").collect()]
    assert [x[2] for x in got] == [6, 2, 1, 5, 7, 4, 3] and [x[3] for x in got] == [topk.MOST] * 3 + [256 * 256 * 3] * 2 + [topk.LEAST] * 2


def test_topk_carries_the_best_over_blocks(spark):
    """Groups of several blocks, several query blocks and many ties."""
    r = random.Random(11)
    rows = [(i, [float(r.randint(-2, 2)) for _ in range(r.choice([0, 3, 20, 20, 20]))]) for i in range(400)]
    v = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in topk.top_k(v, lambda i: i % 7 == 0, 4, query_block=9, block=16).collect())
    dot = lambda a, b: sum(int(x) * int(y) for x, y in zip(a, b)) * 256**2
    want = []
    for i, a in rows:
        if i % 7 == 0:
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(sorted((-dot(a, b), j) for j, b in rows if j != i)[:4])]
    assert got == sorted(want)


def test_topk_sends_no_copies_to_the_driver(spark):
    """Copies of the queries are many times larger than Spark takes them for: no broadcast of them, whatever its limit."""
    rows = spark.range(3000).selectExpr("id vec_id", "transform(sequence(0, 7), i -> cast((id * 7 + i * i) % 5 as float)) embedding")
    out = topk.top_k(rows, lambda i: i % 3 == 0, block=128)
    assert out.count() == 5000
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_topk_bounds_the_copies_of_queries():
    cases = [(n, max(1, n // share), slots, cores) for n in (10_000, 600_000, 24_000_000, 120_000_000) for share in (1, 50, 10**6) for slots in (12, 600, 3000) for cores in (4, 6, 200)]
    for n, q, slots, cores in cases:
        g, blocks = topk.group_count(n, q, topk.BLOCK, slots, cores), -(-n // topk.BLOCK)
        assert 1 <= g <= blocks and blocks <= topk.GROUP_BLOCKS * g
        assert g * q <= n or g <= max(1, 2 * cores, -(-blocks // topk.GROUP_BLOCKS))
    assert topk.group_count(0, 0, topk.BLOCK, 12, 6) == 1


def test_substrings(spark, texts, odd, empty):
    out = substrings.op7_substrings(spark, SF).collect()
    want = substrings.brute_force(list(texts.items()))
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in out} == want
    r = random.Random(3)
    rows = [(i, " ".join(r.choice("ab") for _ in range(r.randint(0, 60)))) for i in range(60)]
    small = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {x.doc_id: (x.n_words, x.n_removed, hashlib.sha256(x.kept.encode()).hexdigest()) for x in substrings.dedup_substrings(small, size=8, gram=3).collect()}
    assert got == substrings.brute_force(rows, 8)
    found = {(x.doc_id, x.n_removed) for x in substrings.dedup_substrings(odd).collect()}
    assert (2, 72) in found and (1, 0) in found and (4, 0) in found
    assert substrings.dedup_substrings(empty).count() == 0


def test_substrings_crowded_keys(spark):
    keys = [7] * 6000 + [8] * 3 + list(range(100, 4100))  # of these only 7 is crowded
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "x bigint, i bigint")
    facts = rows.groupBy("x").agg(F.count("*").alias("m"), F.min("i").alias("lo")).where("x < 3000")
    joined = substrings.with_facts(rows, facts, ["x"], len(keys))
    assert joined.columns == ["x", "i", "lo"]
    want = sorted((k, i, keys.index(k)) for i, k in enumerate(keys) if k < 3000)
    assert sorted(map(tuple, joined.collect())) == want
    assert substrings.with_facts(rows.limit(0), facts.limit(0), ["x"], 0).count() == 0


def test_neardup(spark, texts, odd, empty):
    out = neardup.op9_neardup(spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out} == neardup.brute_force(list(texts.items()))
    r = random.Random(5)
    rows = []
    for family in range(6):
        base = [f"f{family}w{r.randint(0, 400)}" for _ in range(60)]
        for _ in range(14):
            w = list(base)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(60)] = f"e{r.random()}"
            rows.append((len(rows), " ".join(w)))
    small = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in neardup.near_duplicates(small).collect()}
    assert got == neardup.brute_force(rows)
    found = {(x.doc_id, x.component_id, x.kept) for x in neardup.near_duplicates(odd).collect()}
    assert {(2, 1, False), (1, 1, True), (3, 3, True), (4, 4, True), (None, None, True)} <= found
    assert sorted(neardup.one_of_each(odd).columns) == sorted(odd.columns)
    assert neardup.near_duplicates(empty).count() == 0


def test_neardup_broadcasts_nothing(spark, monkeypatch):
    """Small tables of a round aren't sent to the driver: it would hold each until the stage ends."""
    plans, cut = [], neardup.cut

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(neardup, "cut", seen)
    rows = [(i, " ".join(f"w{(i // 3) * 50 + j}" for j in range(40)) + f" e{i}") for i in range(30)]
    out = neardup.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string"))
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert sorted(r.doc_id for r in out.collect()) == list(range(0, 30, 3))
    assert sum("SortMergeJoin" in x for x in plans) > 5 and not any("Broadcast" in x for x in plans)


def test_superminhash_estimates():
    import numpy as np

    r = np.random.default_rng(1)
    a, b = r.integers(0, 2**63, 300).astype(np.uint64), r.integers(0, 2**63, 100).astype(np.uint64)
    x, y = np.unique(a), np.unique(np.concatenate([a[:250], b]))
    s = neardup.signatures([x, y, x[:1], np.zeros(0, np.uint64)])
    assert abs((s[0] == s[1]).mean() - 250 / 400) < 0.1 and (s[2] != neardup.EMPTY).all() and (s[3] == neardup.EMPTY).all()
    assert (neardup.signatures([x])[0] == s[0]).all()


def test_packing(spark, texts, odd, empty):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    out = packing.op6_packing(spark, SF).collect()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    total = 0
    for i, text in texts.items():
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        total += len(ids)
        at = 0
        for n, r in enumerate(sorted(by[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (n, at) and r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[at : at + r.length])) and (n == 0 or r.length == 2048)
            at += r.length
        assert at == len(ids)
    check_sequences(out)
    assert len({r.sequence_id for r in out}) <= math.ceil(total / 2048) * 1.02 + 1
    packed = packing.pack(packing.pieces(odd))
    assert packed.groupBy().agg(F.sum(F.size("ids")) - F.sum("length")).first()[0] == 0
    check_sequences(packed.collect())
    assert packing.pack(packing.pieces(empty)).count() == 0


def check_sequences(rows):
    seq = {}
    for r in rows:
        seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_ids_equal_the_tokenizer():
    from public_tokenizers import path
    from tokenizers import Tokenizer

    t, ids = Tokenizer.from_file(path("byte_bpe_50k.json")), packing.Ids(packing.tokenizer_path())
    for s in ["", " ", "  a  b\n\n c   d", " \n ", "a<|endoftext|>b <|endoftext|>", "it's 3'll\tx", "\x1c\x1d a", "日本 語 \U0001f600.", "foo.\nBar, baz.\n\nq"]:
        want = t.encode(s, add_special_tokens=False).ids
        assert ids.of(s) == struct.pack(f"<{len(want)}I", *want), s


def test_ids_of_many_lines():
    """Runs with any number of single line breaks, of words or without, at both ends."""
    import sys

    ids = packing.Ids(packing.tokenizer_path())
    n = 3 * sys.getrecursionlimit()
    for t in ("\n".join(f"w{i}," for i in range(n)), "\n".join("\u4e2d\u6587" for _ in range(n)), "a b\nc\nd.\n", "\nb\nc", "x\ny", "a\n", "a " + "\n".join("qr" * n) + "\n", "a\tb\nc d\re\nf"):
        assert ids.of(t) == ids.packed(t)


def test_ids_of_long_runs():
    from public_tokenizers import path
    from tokenizers import Tokenizer

    t, ids = Tokenizer.from_file(path("byte_bpe_50k.json")), packing.Ids(packing.tokenizer_path())
    for s in ("\n" * 1_000_000, "a" * 1_000_000, "x" + " " * 20_000 + "y", " \t" * 3000, "\u3000" * 600):
        want = t.encode(s, add_special_tokens=False).ids
        assert ids.of(s) == struct.pack(f"<{len(want)}I", *want)
    broken = packing.Ids(packing.tokenizer_path())

    class PanicException(BaseException):
        pass

    def encode(text):
        raise PanicException

    broken.encode = encode
    assert broken.of("one  two") == ids.of("one  two")


def test_packing_of_crowded_lengths(spark):
    """A length with many pieces is ranked in many buckets; full pieces have sequences of their own."""
    r = random.Random(8)
    lengths = [2048] * 90 + [700] * 500 + [r.randint(1, 2048) for _ in range(300)]
    rows = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(lengths)], "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")
    out = packing.pack(rows, bucket=40).collect()
    assert sorted((x.doc_id, x.length) for x in out) == list(enumerate(lengths))
    check_sequences(out)
    room: list[int] = []  # plain best fit, longest first
    for n in sorted(lengths, reverse=True):
        fit = min((x for x in room if x >= n), default=None)
        if fit is None:
            room.append(2048 - n)
        else:
            room[room.index(fit)] = fit - n
    assert len({x.sequence_id for x in out}) <= len(room)


def test_privacy(spark, texts, odd, empty):
    hard = [
        (1000, "a@b.c_d@e.f x.y@z@q.r 1.2.3.4.5 1.2.3.256 001.002.003.004 +12 (3) 456-7890 +1-2 4111 1111 1111 1111 4111-1111-1111-1112"),
        (1001, "é😀 mail me@host.org, ip 10.0.0.1. card 5500000000000004 +49 30 1234567 9" * 3),
        (1002, "1 " * 5000 + "12345678901234567890 +1 22"),
        (1003, ""),
    ]
    rows = list(texts.items()) + hard
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for r in privacy.find_private(df).collect():
        want = privacy.brute_force(dict(rows)[r.doc_id])
        assert [(x.kind, x.s, x.e) for x in r.spans if x.base] == want, r.doc_id
    new = {r.doc_id: r.text for r in privacy.redact(df).collect()}
    assert "me@host.org" not in new[1001] and "[EMAIL]" in new[1001] and new[1003] == ""
    assert privacy.redact(odd).columns == odd.columns and {r.text for r in privacy.redact(odd).collect() if r.doc_id == 4} == {None}
    assert privacy.find_private(odd).count() == odd.count() and privacy.find_private(empty).count() == 0


def plain_candidates(text):
    """Kind, start, end and whether it is a base span, of what privacy.candidates should give."""
    import re

    def valid_card(m):
        d = [int(c) for c in re.sub("[^0-9]", "", m)]
        return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(reversed(d))) % 10 == 0

    base = privacy.brute_force(text)
    more = [(m.start(), m.end(), k) for k, p in privacy.MORE.items() for m in re.finditer(p, text, re.A)]
    more += [(m.start(), m.end(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(re.sub("[^0-9]", "", m.group())) <= 19 and not valid_card(m.group())]
    over = lambda a, b, c, d: a < d and c < b
    free = [(s, e, k) for s, e, k in more if not any(over(s, e, x, y) for _, x, y in base) and not any(over(s, e, x, y) and (x, -y, z) < (s, -e, k) for x, y, z in more)]
    return sorted([(k, s, e, True) for k, s, e in base] + [(k, s, e, False) for s, e, k in free], key=str)


def test_privacy_candidates_and_model(spark, texts):
    """Candidates, their order and the final classifier by plain loops."""
    import numpy as np

    r = random.Random(6)
    bits = ["a@b.co", "me [at] host [dot] org", "(555) 123-4567", "555-123-4567", "Zx81kq92mmPq7", "4111 1111 1111 1112", "4111 1111 1111 1111", "10.0.0.4", "+49 30 1234567", "key:", "page", "xx", "\U0001f600", "sk12ab34cd56ef78"]
    more = [(2000 + i, " ".join(r.choice(bits) for _ in range(r.choice([3, 8, 300])))) for i in range(40)]
    rows = dict([*texts.items(), *more])
    df = spark.createDataFrame(list(rows.items()), "doc_id bigint, text string")
    found = privacy.candidates(df).collect()
    for x in found:
        assert sorted(((y.kind, y.s, y.e, y.base) for y in x.spans), key=str) == plain_candidates(rows[x.doc_id]), x.doc_id
    spans = [(tuple(v + 1 for v in y.votes), y) for x in found for y in x.spans]
    v = np.array([x for x, _ in spans])
    pi, th = 0.5, np.array([[[0.1, 0.3, 0.6], [0.6, 0.3, 0.1]]] * privacy.LABELERS)  # labeler, class no and yes... by vote
    th = th[:, ::-1] if th[0, 0, 2] < th[0, 1, 2] else th
    for _ in range(privacy.ROUNDS):
        like = lambda c: np.prod([th[l, c, v[:, l]] for l in range(privacy.LABELERS)], axis=0)  # noqa: E731, B023
        yes, no = pi * like(0), (1 - pi) * like(1)
        q = yes / (yes + no)
        pi = (q.sum() + 1) / (len(q) + 2)
        th = np.array([[[(w[v[:, l] == k].sum() + 1) / (w.sum() + 3) for k in range(3)] for w in (q, 1 - q)] for l in range(privacy.LABELERS)])
    model, _ = privacy.fit(privacy.candidates(df))
    assert abs(model["pi"] - pi) < 1e-9


def test_privacy_masks_the_union_of_spans(spark):
    df = spark.createDataFrame([(1, "host 10.0.0.4 111 1111 1111 1111 bye"), (2, "\U0001f600" * 3000 + " a@b.co " + "\u00e9" * 3000)], "doc_id bigint, text string")
    got = {x.doc_id: x.text for x in privacy.redact(df).collect()}
    assert got == {1: "host [IP] bye", 2: "\U0001f600" * 3000 + " [EMAIL] " + "\u00e9" * 3000}


def test_privacy_of_many_matches(spark):
    """Time is linear in the matches of a text: 50,000 take seconds, once the plan is made."""
    import time

    n = 25_000
    df = spark.createDataFrame([(1, " ".join(f"key aZ3x9Qw7Lm2Kp4{i} me@h{i}.org" for i in range(n)))], "doc_id bigint, text string")
    begin = time.time()
    got = privacy.find_private(df).first().spans
    assert sum(x.base for x in got) == n and time.time() - begin < 90


def test_suffixtree(spark, texts, odd, empty):
    out = suffixtree.op8_suffixtree(spark, SF).collect()
    want = suffixtree.brute_force(list(texts.items()))
    for r in out:
        held, n, known, total, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total) and abs(r.base_score - base) < 1e-6 * abs(base)
    test = [r for r in out if r.held_out]
    assert sum(r.score for r in test) > sum(r.base_score for r in test)
    assert suffixtree.lm_scores(odd).count() == odd.count() and suffixtree.lm_scores(empty).count() == 0


def test_suffixtree_keys():
    r = np.random.default_rng(3)
    for n, wide in ((0, 9), (1, 9), (4, 9), (3000, 4000), (50_000, 2**40)):
        keys = np.unique(r.integers(0, wide, n))
        r.shuffle(keys)
        wanted = np.concatenate([keys, r.integers(0, wide, 2000)])
        place, hit = suffixtree.Keys(keys).find(wanted)
        where = {x: i for i, x in enumerate(keys.tolist())}
        assert hit.tolist() == [x in where for x in wanted.tolist()]
        assert place[hit].tolist() == [where[x] for x in wanted[hit].tolist()]
        assert place.dtype == np.int64 and (place * 2**40 >= 0).all()  # states are multiplied by the number of symbols


def test_suffixtree_is_a_distribution(spark, texts):
    """In every state the shares of all known words, the unknown word and the end add to one."""
    rows = spark.createDataFrame([(None, False, t) for t in texts.values()], "doc_id bigint, held boolean, t string")
    counts = suffixtree.word_counts(rows)
    tree, flat = suffixtree.start_tree(counts, head=1e-4, support=16)
    suffixtree.grow(tree, flat, suffixtree.encode(rows, tree))
    assert len(tree.levels) > 1
    every = np.arange(tree.n)
    for k in range(len(tree.levels) + 1):
        for state in range(len(tree.levels[k - 1].keys) if k else 1):
            p = tree.share(k, np.full(tree.n, state), every)
            assert (p >= 0).all() and abs(p.sum() - 1) < 1e-9
    shares = Counter()
    chosen = {w for i, w in enumerate(tree.words) if tree.symbol[i] < tree.s or w == b""}
    for w, c in [(bytes(r.word), r.c) for r in counts.collect()]:
        if w not in chosen:
            x = suffixtree.class_of(w)
            shares[x] += (1 - tree.unknown[x]) * c / tree.class_n[x]
    assert all(abs(v + tree.unknown[x] - 1) < 1e-9 for x, v in shares.items())


def tree_by_plain_loops(train, ask, least, divergence, mu):
    """log10 P of the texts `ask` (words only of the training texts), with contexts as tuples, and the retained contexts."""
    split = [t.split() for t in train]
    c = Counter(w for t in split for w in t)
    total, ends = sum(c.values()) + len(split), len(split)
    of = {w: w if n >= least else (suffixtree.class_of(w.encode()),) for w, n in c.items()}
    big, once = Counter(), Counter()
    for w, n in c.items():
        if n < least:
            big[of[w]] += n
            once[of[w]] += n == 1
    flat = {**{w: n for w, n in c.items() if n >= least}, **{(x,): big[(x,)] for x in range(256)}, "END": ends}
    root = {x: (n + 0.5) / (total + 0.5 * len(flat)) for x, n in flat.items()}
    seen = [["START", *[of[w] for w in t], "END"] for t in split]
    after = {}
    for line in seen:
        for i in range(1, len(line)):
            for j in range(i):
                after.setdefault(tuple(line[j:i]), Counter())[line[i]] += 1
    kept = {}

    def p(s, x):
        if not s:
            return root[x]
        n, big = kept[s]
        return (big.get(x, 0) + (n - sum(big.values()) + mu) * p(s[1:], x)) / (n + mu)

    level = [s for s, f in after.items() if len(s) == 1 and sum(f.values()) >= least]
    while level:
        stays = []
        for s in level:
            n = sum(after[s].values())
            kept[s] = (n, {x: f for x, f in after[s].items() if f >= least})
            both = [(p(s, x), p(s[1:], x)) for x in root]
            if sum(a * math.log(a / b) for a, b in both) >= divergence:
                stays.append(s)
            else:
                del kept[s]
        level = [s for s, f in after.items() if s[1:] in stays and sum(f.values()) >= least]
    out = []
    for t in ask:
        line, score = ["START", *[of[w] for w in t.split()], "END"], 0.0
        for i in range(1, len(line)):
            k = next(k for k in range(i + 1) if k == i or line[i - k - 1 : i] and tuple(line[i - k - 1 : i]) not in kept)
            score += math.log10(p(tuple(line[i - k : i]), line[i]))
        for w in t.split():
            if of[w] != w:
                n = big[of[w]]
                score += math.log10((1 - (once[of[w]] + 0.5) / (n + 1)) * c[w] / n)
        out.append(score)
    return out, kept


def test_suffixtree_by_plain_loops(spark):
    """Retention, counts and scores against plain loops, with contexts of more than two symbols and no class unknown."""
    rng = random.Random(8)
    phrase = "one two three four five six".split()
    train = []
    for _ in range(160):
        words = []
        for _ in range(rng.randrange(12)):
            x = rng.random()
            words += ["one", "two", "three", rng.choice("uv")] + (["same"] if x < 0.1 else ["other", "end"]) if x < 0.2 else phrase[: rng.randrange(7)] if x < 0.7 else [rng.choice("abcd") + rng.choice("xyz")]
        train.append(" ".join(words))
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(train)], "doc_id bigint, text string")
    total = sum(len(t.split()) + 1 for t in train)
    got = suffixtree.lm_scores(rows, is_held_out=lambda i: i < 0, support=math.sqrt(total) / 6, divergence=0.02, mu=3.0).collect()
    want, kept = tree_by_plain_loops(train, train, 6, 0.02, 3.0)
    assert max(map(len, kept)) > 2
    assert all(abs(r.score - want[r.doc_id]) < 1e-9 * max(1, abs(r.score)) for r in got)


def test_suffixtree_grows_with_the_corpus(spark):
    """More text, more symbols and contexts: the support is a falling share of the corpus."""
    found = []
    for sf in ("sf0.001", "sf0.01"):
        rows = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", F.lit(False).alias("held"), F.coalesce("text", F.lit("")).alias("t"))
        tree, flat = suffixtree.start_tree(suffixtree.word_counts(rows))
        suffixtree.grow(tree, flat, suffixtree.encode(rows, tree))
        found.append((tree.total, tree.s, sum(len(x.keys) for x in tree.levels)))
    (n0, s0, c0), (n1, s1, c1) = found
    assert n1 > n0 and s1 > 1.5 * s0 and c1 > 1.25 * c0


def test_toxicity(spark, odd, empty):
    sf = "/root/testdata/sf0.1"
    out = {r.doc_id: r for r in toxicity.op10_toxicity(spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    test = [(out[i].predicted, y) for i, y in labels.items() if out[i].held_out]
    caught, said = sum(p and y for p, y in test), sum(p for p, _ in test)
    assert caught >= 0.85 * sum(y for _, y in test) and caught >= 0.95 * said
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in out.items())
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id bigint, toxic int")
    model = toxicity.train(odd, none, lambda i: i.isNotNull())
    assert toxicity.score(odd, model).count() == odd.count() and toxicity.score(empty, model).count() == 0
    assert toxicity.accepted(odd, model).columns == odd.columns


def test_toxicity_score_by_plain_loops(spark):
    """Scores from segments found by trying all, with no cap on a passage's evidence."""
    rows = [(i, "plain words here " * 5 + ("vile slur vile " * (1 + i % 40) if i % 3 == 0 else "and more of them"), int(i % 3 == 0)) for i in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels, lambda i: i.isNotNull())

    def maximal(s, at=0):
        best = max(((sum(s[a:b]), a - b, -a) for a in range(len(s)) for b in range(a + 1, len(s) + 1)), default=(0, 0, 0))
        if best[0] <= 1e-12:
            return []
        a = -best[2]
        b = a - best[1]
        return [*maximal(s[:a]), best[0], *maximal(s[b:])]

    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    evidences = []
    for i, t, _ in rows:
        s = [model.score(w) for w in t.split()]
        if len(s) > 60:
            continue
        evidence = sum(model.rate * v - math.log(len(s)) for v in maximal(s) if len(s) * math.exp(-model.rate * v) < model.level)
        evidences.append(evidence)
        assert abs(got[i] - 1 / (1 + math.exp(-(model.curve[0] + model.curve[1] * math.log1p(evidence))))) < 1e-9
    assert model.evidence([(0, 9, 1000.0, 0.0)], 10) > 50 and max(evidences) > 0
    odd = toxicity.train(docs, labels, lambda i: i.isNotNull(), prefix=2)
    assert odd.prefix == 2 and " sl" in odd.logodds and odd.score("slit") == odd.logodds[" sl"] > 0 > odd.score("plain")


def test_toxicity_learns_from_all_terms(spark):
    """The model is that of all counts; a word seen only without the label doesn't take its beginning's score."""
    rows = [(i, f"slurry{i} waste", 1) for i in range(60)] + [(100 + i, "slurp soup" if i < 3 else "plain words", 0) for i in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels, lambda i: i.isNotNull())
    counts = toxicity.term_counts(toxicity.training_rows(docs, labels, lambda i: i.isNotNull())).collect()
    assert model.logodds == toxicity.Scorer.fit([tuple(r) for r in counts]).logodds
    assert model.logodds[" slur"] > 0 and model.score("slurp") < 0 < model.score("slurs")


def test_segments():
    import numpy as np

    def slow(s):
        best, out = None, []
        n = len(s)
        if not n:
            return []
        v, a, b = max(((sum(s[a:b]), -a, -(b - a)) for a in range(n) for b in range(a + 1, n + 1)), default=(0, 0, 0))
        if v <= 0:
            return []
        a = -a
        b = a - b if b > 0 else a + (-b)
        return [*slow(s[:a]), (v,), *slow(s[b:])]

    r = random.Random(2)
    for _ in range(300):
        s = [r.choice([-3, -2, -1, 1, 2, 4]) + r.random() / 1000 for _ in range(r.randint(0, 12))]
        got = [round(v, 6) for *_, v in toxicity.segments(np.array(s, float))]
        assert got == [round(x[0], 6) for x in slow(s)]


def test_html():
    chain = htmltext.trained(200, steps=120)
    r = random.Random(77)
    right = total = 0
    for _ in range(60):
        blocks = htmltext.labelled_blocks(htmltext.labelled_page(r))
        right += sum(a == y for a, (_, y) in zip(chain.decode([x for x, _ in blocks]), blocks))
        total += len(blocks)
    assert right / total > 0.95
    page = "<html><body><nav><a href=/>Home</a></nav><div class=ad>Buy this now.</div><article><h1>A &amp; B</h1><p>One\n two&nbsp;three.<script>if (1 < 2) '</p>'</script><p><b>Four<br><p>Five six.</article><footer>&copy; x</footer>"
    assert htmltext.main_text(chain, page) == "A & B\nOne two three.\nFour\nFive six."
    assert htmltext.main_text(chain, None) == htmltext.main_text(chain, "") == htmltext.main_text(chain, "<!-- x") == ""


def test_html_scanner_is_linear():
    import time

    chain = htmltext.trained()
    begin = time.time()
    for page in ("<a " * 300_000, "<!" * 300_000, "<a \">\" " * 100_000, "<a \"" + "<p>x" * 50_000, "<div>" * 100_000 + "x", "<div>" * 50_000 + "</p>" * 50_000, "<script>" * 50_000, "<!--" * 100_000):
        htmltext.main_text(chain, page)
    assert time.time() - begin < 40
    page = "<nav><a href=/>Home</a></nav><article>{}<h1>Numbers</h1><p>One two three four.</p><p>Five, six and seven.</p></article><footer>&copy; x</footer>"
    assert htmltext.main_text(chain, page.format("<div>" * 600)) == htmltext.main_text(chain, page.format("<div>")) == "Numbers\nOne two three four.\nFive, six and seven."


def test_html_by_hand():
    """Hand-made pages, of no generated layout."""
    chain = htmltext.trained()
    pages = [
        ("<html><body><nav><ul><li><a href=/>Home</a></li></ul></nav><article><p>Short note today.</p></article><footer><p>&copy; x</p></footer></body></html>", "Short note today."),
        ("<body><header><a href=/>Site</a></header><main><h1>Energy</h1><p>Energy is <math><mi>E</mi>=<mi>mc</mi></math> known to all, says <object>who</object>.</p></main><footer>Imprint</footer>", "Energy\nEnergy is E=mc known to all, says who."),
        ("<div id=nav><a href=a>A</a> <a href=b>B</a></div><div class='post-content'><h2>Why bees matter</h2><p>Bees carry pollen from one flower to the next.</p><ul><li>Clover</li><li>Apple</li></ul></div><div class=sidebar><p>Popular posts</p></div><div id=footer>&copy; 2020 Bee Club</div>", "Why bees matter\nBees carry pollen from one flower to the next.\nClover\nApple"),
        ("<article><h1>Rain</h1><p>It rained &#99999999999; all &#0000065; day.</p></article><section class=comments><div class=comment><b>Ann</b><p>So wet here too.</p></div></section>", "Rain\nIt rained \ufffd all A day."),
        ("<div class='cookie-notice'><p>We use cookies.</p><button>OK</button></div><article><p>The bridge opened on Monday after two years of work.</p><aside class=ad><p>Buy bolts.</p></aside><p>Traffic was light.</p></article>", "The bridge opened on Monday after two years of work.\nTraffic was light."),
    ]
    for page, text in pages:
        assert htmltext.main_text(chain, page) == text


def test_html_tables_of_odd_kinds(spark):
    chain = htmltext.trained(100, steps=60)
    long = "<article>" + "<p>Some words of a long page.</p>" * 20_000 + "</article>"
    pages = spark.createDataFrame([(1, "u", long, 7, "t"), (1, "u", long, 7, "t"), (2, None, None, None, None)], "page_id bigint, url string, html string, n_chars int, text string")
    out = htmltext.extract(pages, chain).collect()
    assert sorted(r.n_chars for r in out) == [0, 20_000 * 27 - 1, 20_000 * 27 - 1] and out[0].asDict().keys() == {"page_id", "url", "text", "n_chars"}
    assert htmltext.extract(pages.where("false"), chain).count() == 0


def test_html_viterbi_is_the_best_labelling():
    import itertools

    import numpy as np

    chain = htmltext.Chain()
    r = random.Random(4)
    chain.weights = {f"f{i}": r.uniform(-2, 2) for i in range(8)}
    chain.start, chain.turn = np.array([0.3, -0.2]), np.array([[0.5, -1.0], [-0.4, 0.9]])
    for _ in range(50):
        blocks = [[f"f{r.randrange(8)}" for _ in range(3)] for _ in range(r.randint(1, 6))]

        def value(y):
            return chain.start[y[0]] + sum(chain.turn[a, b] for a, b in zip(y, y[1:])) + sum(chain.weights[f] for x, l in zip(blocks, y) if l for f in x)

        best = max(itertools.product([0, 1], repeat=len(blocks)), key=value)
        assert abs(value(best) - value(chain.decode(blocks))) < 1e-9


def test_html_pages(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "u", ""), (2, "u", "<article><h1>a</h1><p>b c.</p></article>"), (None, None, "<p>")], "page_id bigint, url string, html string")
    out = htmltext.extract(pages, htmltext.trained(200, steps=120)).collect()
    assert len(out) == 4 and sum(r.n_chars for r in out) == 6


def fill(budget, children):
    """Water-filling by whole tokens, as the operator defines it. children: key -> (weight, cap)."""
    got, live, left = {k: 0 for k in children}, {k: wc for k, wc in children.items() if wc[0] > 0}, budget
    while live:
        w = sum(x for x, _ in live.values())
        full = [k for k, (x, c) in live.items() if c * w <= left * x]
        if not full:
            break
        k = min(full, key=lambda k: (live[k][1] / live[k][0], live[k][1], k))
        got[k] = live.pop(k)[1]
        left -= got[k]
    if live:
        w = sum(x for x, _ in live.values())
        for k, (x, _) in live.items():
            got[k] = left * x // w
        odd = sorted(live, key=lambda k: (-(left * live[k][0] % w), k))
        for k in odd[: left - sum(got[k] for k in live)]:
            got[k] += 1
    return got


def brute_mix(rows, weights, share, epochs, seed):
    words = lambda t: len((t or "").encode().split())
    leaf = {}
    for i, t, lang, source in rows:
        digits = "".join(c for c in (source or "") if c.isdigit())
        d = f"d{int(digits) % 4}" if digits else "d3"
        leaf.setdefault((d, lang or "", source or ""), []).append((i, t, words(t)))
    tokens = {k: sum(n for *_, n in v) for k, v in leaf.items()}
    w = lambda level, k: weights[level].get(k, 1)
    caps = lambda keep: sum(epochs * n for k, n in tokens.items() if keep(k))
    total = sum(tokens.values()) * int(round(share * 1000)) // 1000
    out = []
    ds = {k[0] for k in leaf}
    for d, bd in fill(total, {d: (w("domain", d), caps(lambda k: k[0] == d)) for d in ds}).items():
        ls = {k[1] for k in leaf if k[0] == d}
        for g, bg in fill(bd, {g: (w("lang", g), caps(lambda k: k[:2] == (d, g))) for g in ls}).items():
            ss = [k for k in leaf if k[:2] == (d, g)]
            for s, bs in fill(bg, {k[2]: (w("source", k[2]), epochs * tokens[k]) for k in ss}).items():
                key = (d, g, s)
                if not tokens[key]:
                    continue
                whole, part = divmod(bs, tokens[key])
                out += [(i, d, g, s, e, n, n) for e in range(whole) for i, _, n in leaf[key]]
                order = sorted((hashlib.md5(f"{seed}:{whole}:{'' if i is None else i}".encode()).hexdigest(), hashlib.md5((t or "").encode()).hexdigest(), i, n) for i, t, n in leaf[key])
                at = 0
                for mark, _, i, n in order:
                    if at >= part:
                        break
                    out.append((i, d, g, s, whole, n, min(n, part - at)))
                    at += n
    return sorted(out, key=str)


@pytest.mark.parametrize("share,epochs", [(0.8, 3), (0.3, 1), (1.9, 2), (5.0, 2)])
def test_mixing(spark, share, epochs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    weights = {"domain": {"d0": 5, "d1": 1}, "lang": {"en": 1, "fr": 7}, "source": {"src3": 9, "src4": 0}}
    got = mixing.mix(docs, weights, share, epochs).select("doc_id", "domain", "lang", "source", "epoch", "n_tokens", "taken").collect()
    assert sorted([tuple(r) for r in got], key=str) == brute_mix(rows, weights, share, epochs, mixing.SEED)


def test_mixing_moves_no_texts_to_their_limits(spark):
    """Texts meet a row for each leaf, which is known to be small, and not the sums of all buckets: no join shuffles them."""
    docs = spark.range(6000).selectExpr("id doc_id", "repeat(concat('w', id % 97, ' '), 1 + cast(id % 7 as int)) text", "'en' lang", "concat('src', id % 3) source").repartition(1)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "8k")
    try:
        out = mixing.mixed_documents(docs)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
        assert out.selectExpr("sum(regexp_count(text, '[a-z0-9]+'))").first()[0] == int(docs.selectExpr("sum(1 + doc_id % 7)").first()[0]) * 800 // 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_mixing_odd(spark, odd, empty):
    assert mixing.mix(odd, share=1.0).count() > 0 and mixing.mix(empty).count() == 0
    assert mixing.mixed_documents(odd).columns == odd.columns


def test_pipeline(spark, odd):
    docs = corpus_pipeline.table(spark, SF, "documents")
    n = [docs.count()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = corpus_pipeline.cut(stage(spark, docs, SF))
        n.append(docs.count())
        if i < 4:
            assert docs.columns == before.columns
        if name == "toxicity":
            model = toxicity.train(before, corpus_pipeline.table(spark, SF, "labels"), lambda i: ~toxicity.held_out(i))
            known = model.table()
            want = {r.doc_id for r in before.collect() if model.probability(model.evidence(*model.passages(r.text, known))) < toxicity.THRESHOLD}
            assert {r.doc_id for r in docs.collect()} == want
        if name == "near-duplicates":
            kept = neardup.brute_force([(r.doc_id, r.text) for r in before.collect()])
            assert {r.doc_id for r in docs.collect()} == {i for i, (_, _, k) in kept.items() if k}
        if name == "personal data":
            was = {r.doc_id: r.text for r in before.collect()}
            for r in docs.collect():
                assert r.n_chars == len(r.text) and not privacy.brute_force(r.text) or "[" in was[r.doc_id]
    check_sequences(docs.collect())
    steps = odd.drop("row")
    for _, stage in corpus_pipeline.STAGES[:4]:
        steps = corpus_pipeline.cut(stage(spark, steps, SF))
    assert steps.columns == odd.drop("row").columns
    check_sequences(corpus_pipeline.pack(spark, steps, SF).collect())


def test_all_are_registered():
    found = queries.queries()
    assert [n for n in range(1, 11) if not any(k.startswith(f"op{n}_") for k in found)] == [] and "pipeline" in found
