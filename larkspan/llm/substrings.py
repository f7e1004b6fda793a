"""Substring dedup: repeated windows of words, found by Rabin-Karp hashes and merged into maximal removal intervals.

A window is `size` consecutive words of a document; a word goes if some window that covers it also starts in a document
with a smaller doc_id. The polynomial hash (modulo 2**64) of every window and of every run of GRAM words is taken from
prefix sums. Hashing all windows to one place would move several times the corpus, so windows travel in blocks:

1. The anchor of a window is the smallest mixed hash among its GRAM-word runs: equal windows have equal anchors. A block is
   a maximal run of consecutive windows with one anchor; the hash of the words it spans is its content. Spark counts the
   anchors; one that occurs in a single document cannot belong to a repeated window.
2. For blocks with a repeated anchor, the smallest doc_id of each content is found. In every other document with that
   content all its windows are repeated.
3. The first document of a content needs its windows one by one if its anchor has other contents too. Only these windows are
   hashed to one place, and the smallest doc_id of each window decides.
4. Intervals go back to their document, where they merge; what is left is joined again.

Every window of every document is so compared with all others. Counts are combined before they are shuffled, and a hot
anchor, content or window is never gathered in one task: aggregates are minima and counts, and in a join the keys that more than
one row in CROWDED has, of which there are at most CROWDED, go to their rows by broadcast.

Defined results: a null text has no words; a document shorter than a window keeps all; a null doc_id counts as larger
than all others; rows that share a doc_id do not remove each other's words; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm._common import blank, cut, table

SIZE, GRAM, CROWDED = 50, 12, 1000
BASE = 0x9E3779B97F4A7C15 | 1
LAST = 2**63 - 1


class Hashes(dict):
    """64-bit hashes of words, kept for words seen again."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


class Roller:
    """Rabin-Karp hashes modulo 2**64 of runs of words of one document at a time."""

    def __init__(self) -> None:
        self.known = Hashes()
        self.power = self.inverse = np.ones(1, np.uint64)

    def load(self, words: list[bytes]) -> None:
        n = len(words)
        if len(self.power) <= n:
            m = 2 * n + 64
            self.power = powers(BASE, m)
            self.inverse = powers(pow(BASE, -1, 2**64), m)
        h = np.fromiter(map(self.known.__getitem__, words), np.uint64, n)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(h * self.power[:n], out=self.prefix[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.inverse[start] + (end - start).astype(np.uint64))

    def runs(self, size: int) -> np.ndarray:
        n = len(self.prefix) - 1
        return mix((self.prefix[size:] - self.prefix[: n + 1 - size]) * self.inverse[: n + 1 - size] + np.uint64(size))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, in time linear in len(x)."""
    n = len(x) - w + 1
    y = np.full(-(-len(x) // w) * w, np.iinfo(x.dtype).max, x.dtype)
    y[: len(x)] = x
    y = y.reshape(-1, w)
    before = np.minimum.accumulate(y, axis=1).ravel()
    after = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[w - 1 : w - 1 + n])


def words_of(text: str) -> list[bytes]:
    return text.encode().split()  # splits at \x20 and \x09-\x0D only


def blocks(docs: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """(anchor, content, k, v, start, n): the blocks of windows of each row (k, v, t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = Roller()
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], [], [], []]
            for k, v, t in zip(*[c.to_pylist() for c in batch.columns]):
                words = words_of(t)
                if len(words) < size:
                    continue
                roller.load(words)
                anchors = sliding_min(roller.runs(gram), size - gram + 1)
                starts = np.concatenate([[0], np.flatnonzero(anchors[1:] != anchors[:-1]) + 1])
                ends = np.append(starts[1:], len(anchors))
                for x, y in zip(out, (anchors[starts], roller.spans(starts, ends - 1 + size), np.full(len(starts), k, np.int64), np.full(len(starts), v, np.int64), starts, ends - starts)):
                    x.append(y)
            if out[0]:
                a = [np.concatenate(x) for x in out]
                yield pa.RecordBatch.from_arrays([*[pa.array(x.view(np.int64)) for x in a[:4]], *[pa.array(x.astype(np.int32)) for x in a[4:]]], ["anchor", "content", "k", "v", "start", "n"])

    return docs.mapInArrow(run, "anchor bigint, content bigint, k bigint, v bigint, start int, n int")


def windows(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(window, k, v, start): hashes of the windows named by the rows (k, v, t, spans)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = Roller()
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], []]
            for k, v, t, spans in zip(*[c.to_pylist() for c in batch.columns]):
                roller.load(words_of(t))
                for s in spans:
                    starts = np.arange(s["start"], s["start"] + s["n"])
                    for x, y in zip(out, (roller.spans(starts, starts + size), np.full(len(starts), k, np.int64), np.full(len(starts), v, np.int64), starts)):
                        x.append(y)
            if out[0]:
                a = [np.concatenate(x) for x in out]
                yield pa.RecordBatch.from_arrays([*[pa.array(x.view(np.int64)) for x in a[:3]], pa.array(a[3].astype(np.int32))], ["window", "k", "v", "start"])

    return docs.mapInArrow(run, "window bigint, k bigint, v bigint, start int")


def with_facts(rows: DataFrame, facts: DataFrame, on: list[str], total: int) -> DataFrame:
    """The inner join of rows, at most `total`, and facts: one row for each key `on`, with m, the number of rows that have the key.
    Keys that more than one row in CROWDED has are at most CROWDED, and so are broadcast; the others are shuffled."""
    crowded = F.col("m") > total / CROWDED
    few = facts.where(crowded).drop("m")
    rest = rows.join(F.broadcast(few.select(*on)), on, "left_anti")
    return rows.join(F.broadcast(few), on).unionByName(rest.join(facts.where(~crowded).drop("m"), on))


def removal_intervals(docs: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """(k, v, spans): for rows (k, v, t) the repeated windows as array of struct(start, n), n windows from start."""
    found = cut(blocks(docs, size, gram))
    total, m = found.count(), F.count("*").alias("m")
    anchors = found.groupBy("anchor").agg(m, F.min("k").alias("lo"), F.max("k").alias("hi"), F.min("content").alias("c0"), F.max("content").alias("c1")).where("lo < hi")
    repeated = cut(anchors.select("anchor", "m", "lo", (F.col("c0") == F.col("c1")).alias("single")))
    shared = cut(with_facts(found, repeated, ["anchor"], total))
    span = F.struct("start", "n").alias("span")
    whole = shared.where("single and k > lo").select("k", "v", span)
    mixed = shared.where("not single")
    first = cut(mixed.groupBy("anchor", "content").agg(m, F.min("k").alias("first")))
    placed = cut(with_facts(mixed, first, ["anchor", "content"], total))
    rest = placed.where("k > first").select("k", "v", span)
    open_ = placed.where("k = first").groupBy("k", "v").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    each = cut(windows(docs.join(open_, ["k", "v"]).select("k", "v", "t", "spans"), size))
    least = cut(each.groupBy("window").agg(m, F.min("k").alias("least"), F.max("k").alias("most")).where("least < most").select("window", "m", "least"))
    single = with_facts(each, least, ["window"], each.count()).where("k > least").select("k", "v", F.struct("start", F.lit(1).alias("n")).alias("span"))
    return whole.unionByName(rest).unionByName(single).groupBy("k", "v").agg(F.collect_set("span").alias("spans"))


def dedup_substrings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept is the rest of the text, its words joined by one space."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("k"), blank(text).alias("t")).withColumn("v", F.xxhash64("t"))
    spans = removal_intervals(rows.select("k", "v", "t"), size, gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, kept = [], [], []
            for t, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = words_of(t)
                total.append(len(words))
                if spans:
                    edge = np.zeros(len(words) + 1, np.int32)
                    for s in spans:
                        edge[s["start"]] += 1
                        edge[s["start"] + s["n"] - 1 + size] -= 1
                    stay = np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()
                    words = [words[i] for i in stay]
                gone.append(total[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return rows.join(spans, ["k", "v"], "left").select("doc_id", "t", "spans").mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept string")


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP7_SQL = r"""
with d as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
s as (select doc_id, w, unnest(range(1, len(w) - 48)) i from d where len(w) >= 50),
win as (select doc_id, i, array_to_string(w[i:i + 49], ' ') k from s),
least as (select k, min(doc_id) first from win group by k),
bad as (select doc_id, i from win join least using (k) where first < doc_id),
gone as (select distinct doc_id, unnest(range(i, i + 50)) p from bad),
words as (select doc_id, unnest(w) word, generate_subscripts(w, 1) p from d),
rest as (select doc_id, string_agg(word, ' ' order by p) kept, count(*) n from words anti join gone using (doc_id, p) group by doc_id)
select doc_id, len(w) n_words, len(w) - coalesce(n, 0) n_removed, sha256(coalesce(kept, '')) kept_sha256 from d left join rest using (doc_id)
"""


def brute_force(rows: list[tuple[int, str]], size: int = SIZE) -> dict[int, tuple[int, int, str]]:
    """What dedup_substrings finds, by a table of all windows (small inputs only)."""
    least: dict[tuple, int] = {}
    split = {i: words_of(t or "") for i, t in rows}
    for i, w in split.items():
        for a in range(len(w) - size + 1):
            key = tuple(w[a : a + size])
            least[key] = min(i, least.get(key, i))
    out = {}
    for i, w in split.items():
        gone: set[int] = set()
        for a in range(len(w) - size + 1):
            if least[tuple(w[a : a + size])] < i:
                gone.update(range(a, a + size))
        out[i] = (len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest())
    return out
