"""Toxicity by maximum-scoring segments of token log-odds.

Model, fitted on at most SAMPLE labelled rows (those with the smallest hash of doc_id):
- Of each word and of each word beginning (its first PREFIX letters) the documents with and without the label that hold it
  are counted. The log-odds of a word have a Dirichlet prior whose mean is the share of its beginning, and the beginning's
  prior mean is the share of all; words that were not seen take their beginning's. Log-odds count only if they are
  Z standard errors from zero, so that chance words don't.
- A token's score is its log-odds, less a drift where they aren't positive, so that a text without toxic words drifts down.
  The drift is the log-odds of a token without positive log-odds of its own: ln((1 - p0) / (1 - p1)), where p1 and p0 are the shares of
  tokens with positive log-odds in texts with and without the label, and DRIFT at least. Words of weak evidence so add up
  where they are denser than in other texts.

All maximal segments of positive score are found in one linear scan. For their significance, the extreme-value law of
maximal segments holds: with lambda the positive root of E[exp(lambda * score)] = 1 over tokens of unlabelled kind, a segment of
score S in n tokens has the expectation E = K * n * exp(-lambda * S); K is taken as 1, since a constant factor of all
expectations only moves the curve that is fitted below. Segments with E below LEVEL are the passages. A document's
evidence is the sum of its passages' -ln E, and a logistic curve, fitted on the same sample, makes it a probability.

Defined results: null and empty texts score as texts without passages; labels that are null are not used, and of several
labels of a document the highest counts; without labelled rows all scores are the base rate 0; repeated rows each give a
row; held_out of a null doc_id is false; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm._common import blank, cut, table

SAMPLE, PREFIX, PRIOR, Z, DRIFT, LEVEL, THRESHOLD, FLUSH = 20_000, 4, 4.0, 3.0, 0.01, 0.1, 0.3, 200_000
TERM = re.compile(r"\w+")
PASSAGES = "array<struct<start:int,end:int,score:double,expect:double>>"


def training_rows(docs: DataFrame, labels: DataFrame, use, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """(t, y): the sampled labelled texts. At most `sample` pairs of id and label are broadcast; texts aren't shuffled."""
    chosen = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & use(F.col(doc_id))).groupBy(F.col(doc_id).cast("long").alias("k")).agg(F.max(label).cast("int").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("k"), "k").limit(sample)
    return docs.select(F.col(doc_id).cast("long").alias("k"), blank(text).alias("t")).join(F.broadcast(chosen), "k").select("t", "y")


def term_counts(rows: DataFrame, prefix: int = PREFIX) -> DataFrame:
    """(term, y, n): documents that hold each word, or word beginning (marked by a leading space), by label."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.int32()), pa.array(list(found.values()), pa.int64())], ["term", "y", "n"])
            found.clear()
            return out

        for batch in batches:
            for t, y in zip(*[c.to_pylist() for c in batch.columns]):
                words = set(TERM.findall(t.lower()))
                found.update([(w, y) for w in words])
                found.update([(p, y) for p in {" " + w[:prefix] for w in words}])
                found[("", y)] += 1
                if len(found) > FLUSH:
                    yield flush()
        yield flush()

    return rows.mapInArrow(count, "term string, y int, n bigint").groupBy("term", "y").agg(F.sum("n").alias("n"))


class Scorer:
    """Token scores, segments and documents' probabilities. Plain values only, so that it travels to executors."""

    def __init__(self, logodds: dict[str, float], prefix: int = PREFIX, drift: float = DRIFT, level: float = LEVEL):
        """prefix is that of the counts that the log-odds were made of."""
        self.logodds, self.prefix, self.drift, self.level = logodds, prefix, drift, level
        self.rate, self.curve = 1.0, (-60.0, 0.0)

    @classmethod
    def fit(cls, counts: list[tuple[str, int, int]], prior: float = PRIOR, z: float = Z, prefix: int = PREFIX) -> Scorer:
        """counts: rows of term_counts with that prefix."""
        by: dict[str, list[int]] = {}
        for term, y, n in counts:
            by.setdefault(term, [0, 0])[1 if y else 0] += n
        n0, n1 = by.pop("", [0, 0])
        if not n0 or not n1:
            return cls({}, prefix)
        share, base = n1 / (n0 + n1), math.log(n1 / n0)

        def odds(y0: int, y1: int, mean: float) -> tuple[float, float]:
            a, b = y1 + prior * mean, y0 + prior * (1 - mean)
            d = math.log(a / b) - base
            return d, abs(d) / math.sqrt(1 / a + 1 / b)

        out: dict[str, float] = {}
        means: dict[str, float] = {}
        for term, (y0, y1) in by.items():
            if term[0] == " ":
                d, sure = odds(y0, y1, share)
                if sure >= z:
                    out[term] = d
                    means[term] = (y1 + prior * share) / (y0 + y1 + prior)
        for term, (y0, y1) in by.items():
            if term[0] != " ":
                head = " " + term[:prefix]
                d, sure = odds(y0, y1, means.get(head, share))
                if sure >= z:
                    out[term] = d
                elif head in out and y0 > y1:
                    out[term] = 0.0  # seen without the label more often: its beginning says nothing
        return cls(out, prefix)

    def score(self, word: str) -> float:
        d = self.logodds.get(word)
        if d is None:
            d = self.logodds.get(" " + word[: self.prefix], 0.0)
        return d if d > 0 else d - self.drift

    def table(self) -> dict:
        outer = self

        class Known(dict):
            def __missing__(self, word: str) -> float:
                if len(self) > 400_000:
                    self.clear()
                self[word] = s = outer.score(word)
                return s

        return Known()

    def passages(self, text: str | None, known: dict) -> tuple[list[tuple[int, int, float, float]], int]:
        """(first token, end, score, expectation) of the significant segments, and the number of tokens."""
        words = TERM.findall((text or "").lower())
        n = len(words)
        s = np.fromiter(map(known.__getitem__, words), np.float64, n)
        if not n or s.max() <= 0:
            return [], n
        return [(a, b, v, e) for a, b, v in segments(s) if (e := n * math.exp(-self.rate * v)) < self.level], n

    def evidence(self, found: list[tuple[int, int, float, float]], n: int) -> float:
        """The sum of -ln E over the passages of a text of n tokens."""
        return sum(self.rate * v - math.log(n) for _, _, v, _ in found)

    def probability(self, evidence: float) -> float:
        a, b = self.curve
        x = a + b * math.log1p(evidence)
        return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def segments(s: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in time linear in len(s) (the list of candidates is a stack)."""
    total = np.concatenate([[0.0], np.cumsum(s)])
    out: list[tuple[int, int, float, float]] = []  # start, end, total before, total after
    for i in np.flatnonzero(s > 0).tolist():
        start, end, left, right = i, i + 1, float(total[i]), float(total[i + 1])
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= left:
                j -= 1
            if j < 0 or out[j][3] >= right:
                break
            start, left = out[j][0], out[j][2]
            del out[j:]
        out.append((start, end, left, right))
    return [(a, b, y - x) for a, b, x, y in out]


def root(scores: np.ndarray, weights: np.ndarray) -> float:
    """The positive lambda with E[exp(lambda * score)] = 1."""
    p = weights / weights.sum()
    if scores.max() <= 0 or p @ scores >= 0:
        return 1.0
    lo, hi = 0.0, 1.0
    while p @ np.exp(np.minimum(hi * scores, 600)) < 1:
        lo, hi = hi, 2 * hi
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if p @ np.exp(np.minimum(mid * scores, 600)) < 1 else (lo, mid)
    return hi


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, float]:
    """Intercept and slope by Newton steps, the slope held back by ridge."""
    w = np.zeros(2)
    m = np.column_stack([np.ones(len(x)), x])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(m @ w, -30, 30)))
        h = (m * (p * (1 - p))[:, None]).T @ m + np.diag([1e-3, ridge])
        step = np.linalg.solve(h, m.T @ (y - p) - np.array([1e-3, ridge]) * w)
        w = w + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(w[1])


def decisive(wide: DataFrame, prior: float = PRIOR, z: float = Z, prefix: int = PREFIX) -> list[tuple[str, int, int]]:
    """Counts that give the model that those of all terms give. wide: (term, y1, y0). A term that no text with the label holds
    is left out only if it fails the Z test and has no beginning in the model, from which it would take its score."""
    total = wide.where("term = ''").first()
    if not total or not total.y0 or not total.y1:
        return []
    share, base = total.y1 / (total.y0 + total.y1), math.log(total.y1 / total.y0)
    a, b = F.col("y1") + prior * share, F.col("y0") + prior * (1 - share)
    passes = F.abs(F.log(a / b) - base) / F.sqrt(1 / a + 1 / b) >= z * (1 - 1e-9)  # fit() tests again
    counts = lambda df: [x for r in df.select("term", "y0", "y1").collect() for x in ((r.term, 1, r.y1), (r.term, 0, r.y0))]
    out = counts(wide.where((F.col("term") == "") | (F.col("y1") > 0) | passes))
    heads = [(k[1:],) for k in Scorer.fit(out, prior, z, prefix).logodds if k[0] == " "]
    if not heads:
        return out
    known = F.broadcast(wide.sparkSession.createDataFrame(heads, "head string"))
    clean = wide.where((F.col("y1") == 0) & ~passes & ~F.col("term").startswith(" ")).withColumn("head", F.substring("term", 1, prefix))
    return out + counts(clean.join(known, "head", "left_semi"))


def train(docs: DataFrame, labels: DataFrame, use, prefix: int = PREFIX, **names) -> Scorer:
    """A fitted scorer. What comes to the driver is bounded by the sample: terms that pass the Z test, histograms, evidence."""
    rows = cut(training_rows(docs, labels, use, **names))
    counts = term_counts(rows, prefix)
    wide = counts.groupBy("term").agg(F.sum(F.when(F.col("y") > 0, F.col("n")).otherwise(0)).alias("y1"), F.sum(F.when(F.col("y") > 0, 0).otherwise(F.col("n"))).alias("y0"))
    model = Scorer.fit(decisive(cut(wide), prefix=prefix), prefix=prefix)
    if not model.logodds:
        return model
    model.drift = 0.0  # plain log-odds are tallied
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, found = sent.value.table(), Counter()
        for batch in batches:
            for t, y in zip(*[c.to_pylist() for c in batch.columns]):
                found.update([(int(y > 0), round(known[w], 1)) for w in TERM.findall(t.lower())])
        columns = list(zip(*found)) or [()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.float64()), pa.array(list(found.values()), pa.int64())], ["y", "s", "n"])

    seen = rows.mapInArrow(tally, "y int, s double, n bigint").groupBy("y", "s").agg(F.sum("n").alias("n")).collect()
    tokens = lambda y, least: sum(r.n for r in seen if r.y == y and r.s > least)
    p1, p0 = ((tokens(y, 0) + 1) / (tokens(y, -math.inf) + 2) for y in (1, 0))
    model.drift = max(DRIFT, math.log((1 - p0) / (1 - p1)))
    null = [r for r in seen if r.y == 0]
    if null:
        s, n = np.array([r.s if r.s > 0 else r.s - model.drift for r in null]), np.array([float(r.n) for r in null])
        # one toxic word more than was seen: no score is held impossible
        model.rate = root(np.append(s, max(model.logodds.values())), np.append(n, 1.0))
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value.table()
        for batch in batches:
            e = [sent.value.evidence(*sent.value.passages(t, known)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(e, pa.float64()), batch.column(1)], ["e", "y"])

    fitted = rows.mapInArrow(weigh, "e double, y int").collect()
    model.curve = logistic(np.log1p([r.e for r in fitted]), np.array([float(r.y > 0) for r in fitted]))
    return model


def score(docs: DataFrame, model: Scorer, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, passages): probability and significant passages, in word numbers."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        known = model.table()
        for batch in batches:
            scored = [model.passages(t, known) for t in batch.column(1).to_pylist()]
            found = [x for x, _ in scored]
            lists = pa.array([[{"start": a, "end": b, "score": v, "expect": e} for a, b, v, e in x] for x in found], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expect", pa.float64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.probability(model.evidence(*x)) for x in scored], pa.float64()), lists], ["doc_id", "score", "passages"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), blank(text).alias("t")).mapInArrow(run, f"doc_id bigint, score double, passages {PASSAGES}")


def accepted(docs: DataFrame, model: Scorer, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, that score below threshold."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        known = model.table()
        for batch in batches:
            stay = [model.probability(model.evidence(*model.passages(t, known))) < threshold for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(stay, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id):
    return F.crc32(doc_id.cast("string")) % 4 == 2


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), lambda i: ~held_out(i))
    out = score(docs, model)
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
