"""Near-duplicate groups: SuperMinHash signatures, banding, verification on full sets, connected components.

A document's set is that of its distinct five-word shingles (with fewer words the whole sequence is the one shingle), held
as 64-bit hashes. In SuperMinHash every element has a random permutation of the M registers and offers level + fraction to
the register that its permutation names at each level. Levels are worked through for a batch of documents at a time, and
a document stops as soon as all its registers are filled, since higher levels can't lower them.

BANDS bands of ROWS registers make candidates; at a similarity of 0.75 a link shares no band with probability 5e-6.
Documents with equal sets become one class first. Within a bucket no list of all pairs is made: members are compared with
a few centres of their bucket, and classes that verified links join become one component. After two such rounds only pairs
of a bucket that still lie in different components are compared, inside the join, by the sizes of their sets, by bit maps
(an exact bound) and by four bits of each of the M registers; those whose likeness may reach the limit (five standard
errors, or one link in three million) are verified. So a large group of copies costs a few comparisons a member, unlike texts that share a passage
leave no rows. A link may be lost with the chances named above: by sharing no band, or by the registers.

Links and components stay distributed; each round is written to the shared folder.

Defined results: null and empty texts have the empty set and are linked with nothing. Rows that share a doc_id count as
one document with several sets. A row with a null doc_id is a component of its own, with a null component_id, and kept.
Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm._common import blank, cut, table

WORDS, PERCENT, M, BANDS, ROWS, SEED, MAP_BITS = 5, 75, 256, 32, 4, 29, 1024
EMPTY = np.iinfo(np.uint64).max
STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of texts as sorted arrays of 64-bit hashes."""

    KEPT = 400_000

    def __init__(self, words: int = WORDS):
        self.words = words
        outer = self

        class Known(dict):
            def __missing__(self, word: bytes) -> int:
                if len(self) > outer.KEPT:
                    self.clear()
                self[word] = h = xxhash.xxh3_64_intdigest(word)
                return h

        self.known = Known()

    def set_of(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()  # bytes: only A-Z change, only \x20 and \x09-\x0D split
        if not words:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        n = min(self.words, len(h))
        s = np.full(len(h) - n + 1, n, np.uint64)
        for j in range(n):
            s = s * STEP + h[j : len(h) - n + 1 + j]
        return np.unique(mix(s))


def signatures(sets: list[np.ndarray], m: int = M, seed: int = SEED) -> np.ndarray:
    """SuperMinHash registers, a row for each set: level << 32 | fraction. Empty sets keep EMPTY."""
    out = np.full((len(sets), m), EMPTY, np.uint64)
    flat = out.reshape(-1)
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    x = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    x = mix(x + np.uint64(seed * int(STEP) % 2**64))
    perm = None
    for level in range(m):
        if not len(x):
            break
        r = mix(x + np.uint64((level + 1) * int(STEP) % 2**64))
        k = (level + (((r >> np.uint64(32)) * np.uint64(m - level)) >> np.uint64(32)).astype(np.int64)).astype(np.int64)
        value = (np.uint64(level) << np.uint64(32)) | (r & np.uint64(0xFFFFFFFF))
        if level == 0:
            place, first = k, k
        else:
            rows = np.arange(len(x))
            place = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[:, level]
        np.minimum.at(flat, doc * m + place, value)
        full = (out != EMPTY).all(1)
        live = ~full[doc]
        if level == 0:
            x, doc, first = x[live], doc[live], first[live]
            perm = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(x), 1))
            perm[np.arange(len(x)), first] = 0  # the first exchange
        elif live.sum() < 0.7 * len(x):
            x, doc, perm = x[live], doc[live], perm[live]
    return out


def band_hashes(registers: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    parts = registers[:, : bands * rows].reshape(len(registers), bands, rows)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for j in range(rows):
        h = mix(h * STEP + parts[:, :, j])
    return h


def bit_planes(registers: np.ndarray) -> np.ndarray:
    """Four bits of each register: the first bits of all registers in 64-bit integers, then the second bits and so on."""
    four = (mix(registers) & np.uint64(15)).astype(np.uint8)
    return np.concatenate([np.packbits((four >> np.uint8(p)) & np.uint8(1), axis=1).view(np.uint64) for p in range(4)], axis=1)


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """A map of MAP_BITS bits of each set, a bit for each hash value that an element has, in 64-bit integers."""
    out = np.zeros((len(sets), MAP_BITS), bool)
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    x = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    out[doc, (mix(x ^ STEP) % np.uint64(MAP_BITS)).astype(np.int64)] = True
    return np.packbits(out, axis=1).view(np.uint64)


def alike(a: str, b: str, m: int = M, percent: int = PERCENT) -> str:
    """SQL: the sizes a.n, b.n, the bits a.bits, b.bits and the maps a.map, b.map allow a similarity of percent.

    Two sets of that similarity differ in at most (100 - percent) / (100 + percent) of the sum of their sizes, and each bit
    in which their maps differ stands for an element that only one has: no link is lost by this. Of m registers a share
    of j + (1 - j) / 16 has equal bits at similarity j; this is the sharper test for large sets."""
    j = percent / 100
    p = j + (1 - j) / 16
    most = m - (m * p - 5 * (m * p * (1 - p)) ** 0.5)
    w = m // 64
    unequal = " + ".join("bit_count(" + " | ".join(f"({a}.bits[{p * w + i}] ^ {b}.bits[{p * w + i}])" for p in range(4)) + ")" for i in range(w))
    differ = " + ".join(f"bit_count({a}.map[{i}] ^ {b}.map[{i}])" for i in range(MAP_BITS // 64))
    return f"(100 * least({a}.n, {b}.n) >= {percent} * greatest({a}.n, {b}.n) and {100 + percent} * ({differ}) <= {100 - percent} * ({a}.n + {b}.n) and {unequal} <= {int(most)})"


def signed(docs: DataFrame, m: int = M, bands: int = BANDS, words: int = WORDS) -> DataFrame:
    """(k, n, h1, h2, bands, bits, map) for rows (k, t): size and hash of the set, band hashes, register bits and bit map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            at = 0
            while at < len(texts):
                sets: list[np.ndarray] = []
                begin, size = at, 0
                while at < len(texts) and size < 250_000:  # elements at a time: bounds the permutations
                    sets.append(shingler.set_of(texts[at].as_py()))
                    size += len(sets[-1])
                    at += 1
                registers = signatures(sets, m)
                h, bits, maps = band_hashes(registers, bands), bit_planes(registers), bitmaps(sets)
                n = [len(s) for s in sets]
                h1 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)
                h2 = np.array([mix(s + STEP).sum(dtype=np.uint64) for s in sets], np.uint64)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1).view(np.int64))) for x in (h, bits, maps)]
                yield pa.RecordBatch.from_arrays([keys.slice(begin, at - begin), pa.array(n, pa.int32()), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), *lists], ["k", "n", "h1", "h2", "bands", "bits", "map"])

    return docs.mapInArrow(run, "k bigint, n int, h1 bigint, h2 bigint, bands array<bigint>, bits array<bigint>, map array<bigint>")


def sets_of(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(k, s) for rows (k, t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [shingler.set_of(t).view(np.int64) for t in part.column(1).to_pylist()]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *[len(s) for s in sets]]).astype(np.int32)), pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["k", "s"])

    return docs.mapInArrow(run, "k bigint, s array<bigint>")


def meet(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """left and right in a merge join. Adaptive execution would broadcast each small table of each round: in the driver that takes a
    thread and some MB, whatever the table's size, until the stage ends."""
    return left.join(right.hint("merge"), on, how)


def components(links: DataFrame) -> DataFrame:
    """(k, c): the smallest member of the connected component of each node of links (a, b). Labels spread to neighbours and
    then jump to the label's label, so that the number of rounds grows with the logarithm of a component's width."""
    both = cut(links.select(F.col("a").alias("x"), F.col("b").alias("y")).union(links.select("b", "a")).distinct())
    if both.isEmpty():
        return both.select(F.col("x").alias("k"), F.col("y").alias("c"))
    labels = cut(both.groupBy(F.col("x").alias("k")).agg(F.least(F.min("y"), F.first("x")).alias("c")))
    while True:
        near = meet(both, labels, both.y == labels.k).groupBy("x").agg(F.min("c").alias("m"))
        lower = meet(labels, near, labels.k == near.x).select("k", F.col("c").alias("was"), F.least("c", "m").alias("c"))
        lower = cut(lower)
        up = lower.select(F.col("k").alias("p"), F.col("c").alias("pc"))
        labels = cut(meet(lower, up, lower.c == up.p).select("k", "was", F.least("c", "pc").alias("c")))
        if labels.where("c <> was").isEmpty():
            return labels.select("k", "c")
        labels = labels.select("k", "c")


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full sets (k, s) are similar enough."""
    left = sets.select(F.col("k").alias("a"), F.col("s").alias("sa"))
    right = sets.select(F.col("k").alias("b"), F.col("s").alias("sb"))
    small, large = F.least(F.size("sa"), F.size("sb")), F.greatest(F.size("sa"), F.size("sb"))
    joined = meet(meet(pairs, left, "a"), right, "b").where(100 * small >= percent * large)
    joined = joined.withColumn("i", F.size(F.array_intersect("sa", "sb")))
    return joined.where(100 * F.col("i") >= percent * (F.size("sa") + F.size("sb") - F.col("i")))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, m: int = M, bands: int = BANDS, words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs."""
    rows = docs.select(F.col(doc_id).cast("long").alias("k"), blank(text).alias("t"))
    known = cut(signed(rows, m, bands, words))
    filled = known.where("k is not null and n > 0")
    classes = cut(filled.groupBy("h1", "h2", "n").agg(F.min("k").alias("rep"), F.first("bands").alias("bands"), F.first("bits").alias("bits"), F.first("map").alias("map")))
    banded = classes.select(F.col("rep").alias("k"), F.explode("bands").alias("band"))
    crowded = banded.groupBy("band").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).where("lo < hi").select("band")
    members = cut(meet(banded, crowded, "band"))
    involved = members.select("k").distinct()
    all_bands = classes.select(F.col("rep").alias("k"), "bands")
    shapes = cut(meet(classes, involved, classes.rep == involved.k, "left_semi").select(F.col("rep").alias("k"), F.struct("n", "bits", "map").alias("shape")))
    sets = cut(sets_of(meet(rows, involved, "k", "left_semi"), words).dropDuplicates())
    comp = shapes.select("k", F.col("k").alias("c"))
    for turn in range(3):
        placed = meet(meet(members, shapes, "k"), comp, "k") if turn else meet(members, shapes, "k").withColumn("c", F.col("k"))
        me = F.struct("k", "c", "shape")
        by = lambda i: F.struct((F.xxhash64("k", F.lit(i)) if i else F.col("k")).alias("by"), me.alias("x"))
        per_band = placed.groupBy("band").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), *[F.min(by(i)).alias(f"o{i}") for i in ((0,), (1, 2), ())[turn]]).where("c0 < c1")
        if turn < 2:
            centres = per_band.select("band", F.explode(F.array(*[F.col(f"o{i}.x") for i in ((0,), (1, 2))[turn]])).alias("o"))
            near = meet(placed, centres, "band").where(f"c <> o.c and {alike('shape', 'o.shape', m, percent)}")
            pairs = near.select(F.least("k", "o.k").alias("a"), F.greatest("k", "o.k").alias("b"), F.least("c", "o.c").alias("ca"), F.greatest("c", "o.c").alias("cb"))
        else:  # all that is left, by components
            left = cut(meet(meet(placed, per_band.select("band"), "band", "left_semi"), all_bands, "k").select("band", "k", "c", "shape", "bands"))
            x, y = left.alias("x"), left.alias("y")
            # a pair counts in the least band that it shares
            near = meet(x, y, F.expr(f"x.band = y.band and x.c <> y.c and x.k < y.k and {alike('x.shape', 'y.shape', m, percent)} and x.band = array_min(array_intersect(x.bands, y.bands))"))
            pairs = near.selectExpr("x.k a", "y.k b", "least(x.c, y.c) ca", "greatest(x.c, y.c) cb")
        found = verified(pairs.dropDuplicates(["a", "b"]), sets, percent).select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        own = components(cut(found))  # of components that new links join
        comp = cut(meet(comp, own.select(F.col("k").alias("c"), F.col("c").alias("lower")), "c", "left").select("k", F.coalesce("lower", "c").alias("c")))
    linked = comp.where("c <> k")
    of_class = meet(classes, linked, classes.rep == linked.k, "left").select("h1", "h2", "n", F.coalesce("c", "rep").alias("c"))
    out = meet(known.select("k", "n", "h1", "h2"), of_class, ["h1", "h2", "n"], "left")
    # rows that share a doc_id are one document: all get the smallest component
    component = F.when(F.col("k").isNotNull(), F.coalesce("c", "k"))
    return out.select(F.col("k").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The rows of docs, all columns, without those of documents that a smaller doc_id stands for."""
    found = near_duplicates(docs, doc_id, text, **settings)
    gone = found.where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept")).where("not kept").select(F.col("doc_id").alias("_gone"))
    return meet(docs, gone, docs[doc_id].cast("long") == gone["_gone"], "left_anti")


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
with recursive d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
p as (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) i from d where len(w) > 0),
s as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') k from p),
n as (select doc_id, count(*) n from s group by doc_id),
shared as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.k = b.k and a.doc_id < b.doc_id group by all),
link as (select a, b from shared join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
ends as (select a, b from link union all select b, a from link),
reach as (select doc_id, doc_id other from d union select reach.doc_id, ends.b from reach join ends on ends.a = reach.other),
comp as (select doc_id, min(other) component_id from reach group by doc_id)
select doc_id, coalesce(n, 0) n_shingles, component_id, doc_id = component_id kept from comp left join n using (doc_id)
"""


def brute_force(rows: list[tuple[int, str]], percent: int = PERCENT, words: int = WORDS) -> dict[int, tuple[int, int, bool]]:
    """What near_duplicates finds, by comparing all pairs (small inputs only)."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[a : a + words]) for a in range(max(1, len(w) - words + 1))} if w else set()
    parent = {i: i for i in sets}

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    holders: dict[tuple, list[int]] = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    shared: dict[tuple[int, int], int] = {}
    for ids in holders.values():
        for x in range(len(ids)):
            for y in range(x):
                shared[ids[y], ids[x]] = shared.get((ids[y], ids[x]), 0) + 1
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}
