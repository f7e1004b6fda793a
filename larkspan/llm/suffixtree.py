"""Language-model scores by a probabilistic suffix tree over words, with contexts of any length.

Tokens are words, lower-cased A-Z, and one end for each text. With N training tokens, the support is sqrt(N) / SUPPORT (2 at
least): it is a smaller and smaller share of a growing corpus. The alphabet of the tree: words that occur as often as the
support, the start and the end, and for all rarer words a class for each last letter.

The tree grows level by level, one pass over the training texts a level, until no context is left. A context of k + 1 symbols
is a candidate if its last k symbols are a retained context and it occurs as often as the support. It is retained if its
next-symbol distribution diverges from that of its suffix by DIVERGENCE nats or more. A state keeps the counts of the
successors that it has as often as the support, and smooths towards its suffix: P(x | s) = (c(s, x) + r(s) P(x | suffix)) /
(n(s) + MU), where r(s) is MU and the count of all other successors, so that shares add to one. The root adds half a count to
each symbol. A token is scored in the state of its longest retained context; within a class a known word has its share of the
class, and all unknown words together the share of words that occur once (as in the base score, unknown words count as one).

Counts of all words of all training texts are made in Spark, and each score looks up its rare words there by a join. What
reaches the driver and goes to executors is bounded: at most 1 / HEAD words with their counts (or SUPPORT * sqrt(N), if that is
more), at most SUPPORT * sqrt(N) symbols, and of each level at most SUPPORT * sqrt(N) candidates and as many successors; smaller counts never leave Spark.

Defined results: a null text counts as empty, with one token, the end. Without training texts N and V are 0, and the base
formula holds. A null doc_id is not held out. Repeated rows each give a row; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm._common import blank, cut, table

HEAD, SUPPORT, DIVERGENCE, MU, FLUSH = 2e-7, 64.0, 0.01, 50.0, 300_000
CLASSES = 256
END = b""  # no word is empty


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # bytes: only A-Z change, only \x20 and \x09-\x0D split


def class_of(word: bytes) -> int:
    kernel = word.rstrip(b".,") or word
    return kernel[-1] if kernel else 0


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, c) over rows (t): all words, and the end as the empty word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(found.keys()), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "c"])
            found.clear()
            return out

        for batch in batches:
            for t in batch.column(0):
                found.update(words_of(t.as_py()))
                if len(found) > FLUSH:
                    yield flush()
            found[END] += batch.num_rows
        yield flush()

    return rows.select("t").mapInArrow(count, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def class_sums(counts: DataFrame, symbols: set[bytes]) -> dict[int, tuple[int, int]]:
    """By class of the words outside the alphabet: tokens, and words that occur once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, once = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for batch in batches:
            for w, c in zip(*[x.to_pylist() for x in batch.columns]):
                if w not in symbols:
                    total[class_of(w)] += c
                    once[class_of(w)] += c == 1
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen]), pa.array(once[seen])], ["x", "n", "n1"])

    got = counts.select("word", "c").mapInArrow(run, "x int, n bigint, n1 bigint").groupBy("x").agg(F.sum("n").alias("n"), F.sum("n1").alias("n1")).collect()
    return {r.x: (r.n, r.n1) for r in got}


class Keys:
    """Distinct numbers, found by hashing: tables of places, each for the keys that found their slot taken in the one before.
    A slot holds twice the place of its key, plus one if other keys wanted it too. Only the keys travel; executors make the tables."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.tables = np.asarray(keys, np.int64), None

    def __reduce__(self) -> tuple:
        return Keys, (self.keys,)

    @staticmethod
    def slots(x: np.ndarray, number: int, bits: int) -> np.ndarray:
        factor = np.uint64(0x9E3779B97F4A7C15 * (2 * number + 1) % 2**64)
        return ((x.view(np.uint64) * factor) >> np.uint64(64 - bits)).view(np.int64)

    def build(self) -> list[tuple[int, np.ndarray]]:
        tables: list[tuple[int, np.ndarray]] = []
        left = np.arange(len(self.keys))
        while len(left):  # each table places one key at least
            bits = (2 * len(left)).bit_length()
            at = self.slots(self.keys[left], len(tables), bits)
            t = np.zeros(1 << bits, np.int64)
            t[at] = left
            out = t[at] != left
            t *= 2
            t[at[out]] |= 1
            tables.append((bits, t.astype(np.int32) if len(self.keys) < 2**30 else t))
            left = left[out]
        return tables

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of wanted among the keys, and whether they are there."""
        place, hit = np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        if self.tables is None:
            self.tables = self.build()
        x, left = wanted, None
        for number, (bits, table) in enumerate(self.tables):
            slot = table[self.slots(x, number, bits)]
            at = (slot >> 1).astype(np.int64)
            same = self.keys[at] == x  # an empty slot names the first key, which is never the one that hashes there
            more = np.flatnonzero((slot & 1).astype(bool) & ~same)
            if left is None:
                place, hit, left = at, same, more
            else:
                place[left], hit[left], left = at, same, left[more]
            if not len(left):
                break
            x = wanted[left]
        return place, hit


class Level:
    """Contexts of one length, by state: key (state of the suffix * symbols + first symbol; sorted), count, successors."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, pairs: np.ndarray, c: np.ndarray, symbols: int, mu: float):
        self.states, self.n = Keys(keys), n.astype(np.float64)
        self.nexts, self.c = Keys(pairs), c.astype(np.float64)  # pairs: state * symbols + next symbol, sorted
        self.rest = self.n + mu - np.bincount(pairs // symbols, self.c, len(keys))
        self.whole = self.n + mu

    @property
    def keys(self) -> np.ndarray:
        return self.states.keys

    def smooth(self, state: np.ndarray, pair: np.ndarray, lower: np.ndarray) -> np.ndarray:
        at, hit = self.nexts.find(pair)
        c = np.zeros(len(pair))
        c[hit] = self.c[at[hit]]
        return (c + self.rest[state] * lower) / self.whole[state]


class Tree:
    """The model: head words with counts, the alphabet, and the retained contexts. Plain values and arrays only."""

    def __init__(self, words: list[bytes], counts: np.ndarray, total: int, distinct: int, support: float = math.inf):
        self.total, self.distinct, self.words, self.support = total, distinct, words, support
        self.counts = counts.astype(np.float64)
        chosen = [i for i, w in enumerate(words) if w != END and counts[i] >= support]
        self.s = len(chosen)
        self.end, self.start, self.n = self.s + CLASSES, self.s + CLASSES + 1, self.s + CLASSES + 2
        ranks = {i: r for r, i in enumerate(chosen)}
        self.symbol = np.array([self.end if w == END else ranks.get(i, self.s + class_of(w)) for i, w in enumerate(words)] + [self.s + x for x in range(CLASSES)], np.uint32)
        self.inner = np.zeros(len(words))  # log10 of a head word's share of its class
        self.unknown = np.zeros(CLASSES)
        self.class_n = np.zeros(CLASSES)
        self.root = np.full(self.n, 1 / self.n)
        self.levels: list[Level] = []
        self.couples = Keys(np.zeros(0, np.int64))  # all two symbols in a row, as often as the support

    def index(self) -> dict:
        """By word: its number among the head words, or the number of head words plus its class."""
        n = len(self.words)

        class Known(dict):
            kept = n + 200_000

            def __missing__(self, word: bytes) -> int:
                x = n + class_of(word)
                if len(self) < self.kept:
                    self[word] = x
                return x

        return Known(zip(self.words, range(n)))

    def line(self, texts: list[np.ndarray]) -> np.ndarray:
        """The symbols of some texts in a row: an end, and for each text its start, its words, its end."""
        start, end = np.array([self.start], np.int64), np.array([self.end], np.int64)
        return np.concatenate([end, *[x for t in texts for x in (start, t, end)]], dtype=np.int64)

    def tokens(self, line: np.ndarray) -> np.ndarray:
        """Places of the tokens, the ends of texts among them."""
        return np.flatnonzero(line[1:] != self.start) + 1

    def walk(self, line: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """By level: places of tokens whose context of that length is retained, with its state. No key has an end in it, so that
        contexts never cross the start of a text."""
        at, state = self.tokens(line), np.zeros(0, np.int64)
        for k, level in enumerate(self.levels, 1):
            before = line[at - k]
            state, hit = level.states.find(before if k == 1 else state * self.n + before)
            at, state = at[hit], state[hit]
            yield at, state

    def shares(self, line: np.ndarray) -> np.ndarray:
        """P of the token at each place in its longest retained context; 1 at starts."""
        p = self.root[line]
        for (at, state), level in zip(self.walk(line), self.levels):
            p[at] = level.smooth(state, state * self.n + line[at], p[at])
        p[line == self.start] = 1
        p[0] = 1
        return p

    def share(self, k: int, state: np.ndarray, x: np.ndarray) -> np.ndarray:
        """P(x | state) for states of level k."""
        if k == 0:
            return self.root[x]
        level = self.levels[k - 1]
        return level.smooth(state, state * self.n + x, self.share(k - 1, level.keys[state] // self.n, x))


def chunks(texts: Iterable[bytes], size: int = 200_000) -> Iterator[list[np.ndarray]]:
    """Texts of symbols in groups of about `size` symbols."""
    held: list[np.ndarray] = []
    total = 0
    for t in texts:
        held.append(np.frombuffer(t, np.uint32))
        total += len(held[-1])
        if total > size:
            yield held
            held, total = [], 0
    if held:
        yield held


def encode(rows: DataFrame, tree: Tree) -> DataFrame:
    """Rows (doc_id, held, t) as symbols: (rid, doc_id, held, n_tokens, n_head, base, inner, rare, s); base and inner are sums over head
    words, rare the other words with their counts, s the symbols of the words."""
    sent = rows.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = sent.value
        index = tree.index()
        head = len(tree.words)
        end = index[END] if END in index else head
        base = np.concatenate([np.log10(tree.counts + 0.5), np.zeros(CLASSES)])
        inner = np.concatenate([tree.inner, np.zeros(CLASSES)])
        for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            out: list[tuple] = []
            rare: list[dict] = []
            for t in batch.column(3):
                words = words_of(t.as_py())
                k = np.empty(len(words) + 1, np.int64)
                k[:-1] = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
                k[-1] = end
                is_rare = k >= head
                tail = Counter([words[i] for i in np.flatnonzero(is_rare[:-1]).tolist()])
                if is_rare[-1]:
                    tail[END] += 1
                out.append((len(k), int(len(k) - is_rare.sum()), float(base[k].sum()), float(inner[k[:-1]].sum()), tree.symbol[k[:-1]].tobytes()))
                rare.append(tail)
            lists = pa.MapArray.from_arrays(pa.array(np.cumsum([0, *[len(x) for x in rare]]).astype(np.int32)), pa.array([w for x in rare for w in x], pa.binary()), pa.array([n for x in rare for n in x.values()], pa.int32()))
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(3)], pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.float64()), lists, pa.array(cols[4], pa.binary())], ["rid", "doc_id", "held", "n_tokens", "n_head", "base", "inner", "rare", "s"])

    numbered = rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "held", "t")
    return cut(numbered.mapInArrow(run, "rid bigint, doc_id bigint, held boolean, n_tokens bigint, n_head bigint, base double, inner double, rare map<binary,int>, s binary"))


def tallies(training: DataFrame, tree: Tree, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For candidates one symbol longer than the tree's contexts, over rows (s): (candidate * symbols + next symbol, count), and
    the same for the symbol before a candidate of two symbols or more. Counts below the support stay in Spark, and what can't reach
    it isn't counted: a string occurs no oftener than the string without its first symbol, or than its first two."""
    sent = training.sparkSession.sparkContext.broadcast((tree.levels, tree.n, tree.start, tree.end, tree.couples, Keys(keys)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, n, start, end, couples, keys = sent.value
        tree = Tree.__new__(Tree)
        tree.levels, tree.n, tree.start, tree.end = levels, n, start, end
        k = len(levels) + 1
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            key, c = np.unique(np.concatenate(held) if held else np.zeros(0, np.int64), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(c.astype(np.int64))], ["key", "c"])

        for batch in batches:
            for texts in chunks(x.as_py() for x in batch.column(0)):
                line = tree.line(texts)
                at, shorter = tree.tokens(line), None
                for at, shorter in tree.walk(line):
                    pass
                before = line[at - k]
                state, hit = keys.find(before if k == 1 else shorter * n + before)
                at, state = at[hit], state[hit]
                if k == 1:
                    held.append((state * n + line[at]) * 2)
                else:
                    often = levels[-1].nexts.find(shorter[hit] * n + line[at])[1]
                    held.append((state[often] * n + line[at[often]]) * 2)
                    more = line[at - k - 1]
                    inside = (more != end) & couples.find(more * n + line[at - k])[1]
                    held.append((state[inside] * n + more[inside]) * 2 + 1)
                size += sum(map(len, held[-2:]))
                if size > 2_000_000:
                    yield flush()
                    size = 0
        yield flush()

    counted = training.select("s").mapInArrow(run, "key bigint, c bigint").groupBy("key").agg(F.sum("c").alias("c")).where(F.col("c") >= tree.support)
    got = counted.toArrow()  # at most SUPPORT * sqrt(N) rows of each kind
    sent.unpersist()
    key, c = got.column(0).to_numpy(), got.column(1).to_numpy()
    order = np.argsort(key)
    key, c = key[order], c[order]
    after = key % 2 == 0
    return key[after] // 2, c[after], key[~after] // 2, c[~after]


def start_tree(counts: DataFrame, head: float = HEAD, support: float = SUPPORT) -> tuple[Tree, np.ndarray]:
    """The alphabet and the root, given the word counts of the training texts, and the counts of the symbols."""
    r = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    total, distinct = int(r.n or 0), int(r.v)
    if not total:
        return Tree([], np.zeros(0), 0, 0), np.zeros(CLASSES + 2)
    least = max(2.0, math.sqrt(total) / support)
    top = counts.where(F.col("c") >= min(least, max(2, head * total))).toArrow()  # at most 1 / head, or support * sqrt(N), words
    words, n = top.column("word").to_pylist(), top.column("c").to_numpy()
    order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
    tree = Tree([bytes(words[i]) for i in order], n[order], total, distinct, least)
    is_symbol = (tree.symbol[: len(tree.words)] < tree.s) | (tree.symbol[: len(tree.words)] == tree.end)
    flat = np.zeros(tree.n)
    flat[tree.symbol[: len(tree.words)][is_symbol]] = tree.counts[is_symbol]
    sums = class_sums(counts, {w for w, x in zip(tree.words, is_symbol) if x} | {END})
    for x in range(CLASSES):
        n, n1 = sums.get(x, (0, 0))
        flat[tree.s + x], tree.class_n[x] = n, n
        tree.unknown[x] = (n1 + 0.5) / (n + 1) if n else 1.0
    for i in np.flatnonzero(~is_symbol).tolist():
        x = int(tree.symbol[i]) - tree.s
        tree.inner[i] = math.log10((1 - tree.unknown[x]) * tree.counts[i] / tree.class_n[x])
    if END not in tree.words:  # an end is rarer than a head word: it still has a symbol
        flat[tree.end] = counts.where(F.col("word") == F.lit(END)).first().c
    live = np.arange(tree.n) != tree.start
    tree.root = np.where(live, (flat + 0.5) / (flat.sum() + 0.5 * live.sum()), 0)
    return tree, flat


def grow(tree: Tree, flat: np.ndarray, training: DataFrame, divergence: float = DIVERGENCE, mu: float = MU) -> Tree:
    """Add levels of retained contexts, counted over the training rows (s), until none is left."""
    occurs = flat.copy()
    occurs[tree.start], occurs[tree.end] = flat[tree.end], 0  # a start for each end; no context has an end in it
    keys = np.flatnonzero(occurs >= tree.support)
    n = occurs[keys]
    while len(keys):
        k = len(tree.levels) + 1
        pairs, c, longer, longer_c = tallies(training, tree, keys)
        level = Level(keys, n, pairs, c, tree.n, mu)
        state, x = pairs // tree.n, pairs % tree.n
        q = tree.share(k - 1, keys[state] // tree.n, x)
        p = (level.c + level.rest[state] * q) / level.whole[state]
        left = level.rest / level.whole
        found = np.bincount(state, p * np.log(p / q), len(keys)) + left * np.log(left) * (1 - np.bincount(state, q, len(keys)))
        kept = found >= divergence
        number = np.cumsum(kept) - 1
        if k == 1:  # of two symbols y x, x is the context and y the symbol before it
            tree.couples = Keys(keys[state] * tree.n + x)
            at, hit = Keys(keys).find(x)
            longer, longer_c = at[hit] * tree.n + keys[state[hit]], c[hit]
            order = np.argsort(longer)
            longer, longer_c = longer[order], longer_c[order]
        if not kept.any():
            break
        stays, grows = kept[state], kept[longer // tree.n]
        tree.levels.append(Level(keys[kept], n[kept], number[state[stays]] * tree.n + x[stays], c[stays], tree.n, mu))
        keys, n = number[longer[grows] // tree.n] * tree.n + longer[grows] % tree.n, longer_c[grows]
    return tree


def score(coded: DataFrame, tree: Tree, counts: DataFrame) -> DataFrame:
    """(doc_id, held, n_tokens, n_known, base_score, score) for the rows of encode()."""
    sent = coded.sparkSession.sparkContext.broadcast((tree.levels, tree.n, tree.start, tree.end, tree.root))
    empty = tree.total == 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree.__new__(Tree)
        tree.levels, tree.n, tree.start, tree.end, tree.root = sent.value
        for batch in batches:
            total = [np.zeros(0)]
            for texts in chunks(x.as_py() for x in batch.column(6)):
                line = tree.line(texts)
                total.append(np.add.reduceat(np.log10(tree.shares(line)), np.flatnonzero(line == tree.start)))
            whole = np.concatenate(total) + batch.column(5).to_numpy()
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(5)], batch.column(7), pa.array(whole)], ["rid", "doc_id", "held", "n_tokens", "n_head", "base", "total"])

    scored = coded.select("rid", "doc_id", "held", "n_tokens", "n_head", "inner", "s", "base").mapInArrow(run, "rid bigint, doc_id bigint, held boolean, n_tokens bigint, n_head bigint, base double, total double")
    looked = coded.select("rid", F.explode("rare").alias("word", "n")).join(counts, "word", "left")
    # classes are known to the driver: their logs are constants
    last_byte = F.expr("ascii(substring(case when length(rtrim('.,', decode(word, 'ISO-8859-1'))) = 0 then decode(word, 'ISO-8859-1') else rtrim('.,', decode(word, 'ISO-8859-1')) end, -1, 1))")
    share = F.array(*[F.lit(float(math.log10((1 - u) / n)) if n and u < 1 else 0.0) for u, n in zip(tree.unknown, tree.class_n)])
    none = F.array(*[F.lit(float(math.log10(u)) if u > 0 else 0.0) for u in tree.unknown])
    at = last_byte.cast("int") + 1
    is_end = F.length("word") == 0
    part = F.when(is_end | F.lit(empty), 0.0).when(F.col("c").isNull(), F.element_at(none, at)).otherwise(F.element_at(share, at) + F.log10(F.col("c").cast("double")))
    sums = looked.groupBy("rid").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("known"),
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("more_base"),
        F.sum(F.col("n") * part).alias("more"),
    )
    per = math.log10(tree.total + 0.5 * (tree.distinct + 1))
    out = scored.join(sums, "rid", "left")
    base_score = F.col("base") + F.coalesce("more_base", F.lit(0.0)) - F.col("n_tokens") * F.lit(per)
    total = F.lit(0.0) + base_score if empty else F.col("total") + F.coalesce("more", F.lit(0.0))
    return out.select("doc_id", "held", "n_tokens", (F.col("n_head") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"), base_score.alias("base_score"), total.alias("score"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 1, F.lit(False))


def lm_scores(docs: DataFrame, is_held_out=held_out, doc_id: str = "doc_id", text: str = "text", head: float = HEAD, support: float = SUPPORT, divergence: float = DIVERGENCE, mu: float = MU) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row, learnt from rows not held out."""
    i = F.col(doc_id).cast("long")
    rows = docs.select(i.alias("doc_id"), is_held_out(i).alias("held"), blank(text).alias("t"))
    counts = cut(word_counts(rows.where("not held")))
    tree, flat = start_tree(counts, head, support)
    coded = encode(rows, tree)
    grow(tree, flat, coded.where("not held"), divergence, mu)
    out = score(coded, tree, counts)
    return out.select("doc_id", F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(tree.total).cast("long").alias("train_tokens"), "base_score", "score")


def op8_suffixtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def brute_force(rows: list[tuple[int, str]]) -> dict[int, tuple[bool, int, int, int, float]]:
    """held_out, n_tokens, n_known, train_tokens and base_score as stated (small inputs only)."""
    import zlib

    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    c: Counter = Counter()
    for i, t in rows:
        if not held[i]:
            c.update([*words_of(t), END])
    n, v = sum(c.values()), len(c)
    out = {}
    for i, t in rows:
        tokens = [*words_of(t), END]
        out[i] = (held[i], len(tokens), sum(c[w] > 0 for w in tokens), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens))
    return out
