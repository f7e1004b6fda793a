"""Document fingerprints by I-Match with randomised lexicons.

Terms are lower-cased runs of word characters. A term is in the lexicon if the share of documents that hold it lies
within [lo, hi], a band of inverse document frequency. The distinct lexicon terms of a text are sorted, and one hash is
taken of the whole list and of its part in each of several random subsets of the lexicon: 4 subsets at each of the rates
1/2, 1/4 ... 1/256. Dense subsets tell short texts apart, sparse ones still agree on long texts after small edits, so
the share of equal hashes grows with likeness. One more hash is taken of all distinct terms, so that texts of which the
lexicon knows nothing are told apart too. The rule is the same for every text, however few of its terms are in the lexicon.

Size bound of what is broadcast: the document frequencies of all terms sum to the number of distinct terms of all
documents, so at most (mean distinct terms of a document) / lo terms can be in the band, however large the corpus is.

Defined results: a null text counts as empty; a text without terms has the all-zero fingerprint; equal texts always have equal fingerprints. Repeated rows each give a row.
Rows are ordered by doc_id descending, then by text; a null doc_id comes last. Extra input columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm._common import blank, slots, table

LO, HI, LEVELS, PER_LEVEL, FLUSH = 0.001, 0.10, 8, 4, 300_000
TERM = re.compile(r"\w+")


def document_frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, df): in how many documents each term occurs. Partial counts are made where the texts are read."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(found.keys()), pa.string()), pa.array(list(found.values()), pa.int64())], ["term", "df"])
            found.clear()
            return out

        for batch in batches:
            for t in batch.column(0):
                found.update(set(TERM.findall(t.as_py().lower())))
                if len(found) > FLUSH:
                    yield flush()
        yield flush()

    return docs.select(blank(text).alias("t")).mapInArrow(count, "term string, df bigint").groupBy("term").agg(F.sum("df").alias("df"))


def lexicon(docs: DataFrame, text: str = "text", lo: float = LO, hi: float = HI) -> list[str]:
    """Terms within the band, sorted: at most (mean distinct terms) / lo of them."""
    n = docs.count()
    band = document_frequencies(docs, text).where(F.col("df").between(max(2, math.ceil(lo * n)), max(2, math.floor(hi * n))))
    return sorted(r.term for r in band.select("term").collect())


class IMatch:
    """Fingerprints texts with a given lexicon."""

    def __init__(self, terms: list[str], seed: int = 17, levels: int = LEVELS, per_level: int = PER_LEVEL):
        self.seed, self.levels, self.per_level = seed, levels, per_level
        self.slots = {t: self.member(t) for t in terms}
        self.n = 1 + levels * per_level

    def member(self, term: str) -> list[int]:
        """Which subsets of the lexicon hold the term; 0 is the whole lexicon."""
        out = [0]
        for j in range(self.per_level):
            bits = xxhash.xxh64_intdigest(term, self.seed + j)
            for level in range(self.levels):
                # one slice of hash bits for each level keeps the subsets independent of one another
                if not (bits >> (level * (level + 1) // 2)) & ((1 << (level + 1)) - 1):
                    out.append(1 + level * self.per_level + j)
        return out

    def fingerprint(self, text: str | None) -> str:
        seen = set(TERM.findall((text or "").lower()))
        lists: list[list[str]] = [[] for _ in range(self.n)]
        for t in sorted(seen & self.slots.keys()):
            for s in self.slots[t]:
                lists[s].append(t)
        lists.append(sorted(seen))
        return "".join([f"{xxhash.xxh32_intdigest(' '.join(x)) or 1:08x}" if x else "00000000" for x in lists])

    @staticmethod
    def likeness(a: str, b: str) -> float:
        """Share of equal hashes among the subsets in which either text has terms."""
        if a == b:
            return 1.0
        same = used = 0
        for i in range(0, len(a), 8):
            x, y = a[i : i + 8], b[i : i + 8]
            if x != "00000000" or y != "00000000":
                used += 1
                same += x == y
        return same / used if used else 1.0


def fingerprint(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lo: float = LO, hi: float = HI) -> DataFrame:
    """(doc_id, fingerprint) of each row of docs."""
    spark = docs.sparkSession
    terms = spark.sparkContext.broadcast(lexicon(docs, text, lo, hi))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = IMatch(terms.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.fingerprint(t) for t in batch.column(1).to_pylist()], pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), blank(text).alias("t")).mapInArrow(run, "doc_id bigint, fingerprint string")


def in_order(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(b, guard, doc_id, t): rows dealt to ranges b of doc_id and sorted, so that the next row (descending doc_id, after
    the last the first) follows in the same partition. The first rows of a range are also sent to the range before it as
    guards; nothing else is copied. Only range bounds come to the driver."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))).alias("k"), blank(text).alias("t"))
    n = 2 * slots(spark)
    cuts = sorted({int(x) for x in rows.select(F.col("k").cast("double").alias("k")).approxQuantile("k", [i / n for i in range(1, n)], 1 / (8 * n))})
    b = F.lit(len(cuts)) - (F.expr(f"array_size(filter(array({','.join(f'{c}L' if c > -(2**63) else 'cast(-9223372036854775808 as bigint)' for c in cuts)}), c -> c < k))") if cuts else F.lit(0))
    rows = rows.withColumn("b", b.cast("int"))
    firsts = sorted((r.b, r.k) for r in rows.groupBy("b").agg(F.max("k").alias("k")).collect())
    guard = F.lit(None).cast("int")
    for i, (_, k) in enumerate(firsts):
        guard = F.when(F.col("k") == k, F.lit(firsts[i - 1][0])).otherwise(guard) if len(firsts) <= 64 else guard
    if len(firsts) > 64:
        guard = F.element_at(F.create_map(*[F.lit(x) for i, (_, k) in enumerate(firsts) for x in (k, firsts[i - 1][0])]), F.col("k"))
    copies = F.array_compact(F.array(F.struct(F.col("b").alias("b"), F.lit(0).alias("guard")), F.when(guard.isNotNull(), F.struct(guard.alias("b"), F.lit(1).alias("guard")))))
    dealt = rows.withColumn("to", F.explode(copies)).select("to.b", "to.guard", "doc_id", "k", "t")
    return dealt.repartition(n, "b").sortWithinPartitions("b", "guard", F.desc("k"), "t").select("b", "guard", "doc_id", "t")


def edited(text: str, following: str) -> str:
    """The last half of text replaced by as many of the first code points of following."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def near_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lo: float = LO, hi: float = HI) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness; see the module's text for defined results."""
    spark = docs.sparkSession
    terms = spark.sparkContext.broadcast(lexicon(docs, text, lo, hi))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = IMatch(terms.value)
        out: list[tuple] = []
        held = None  # (range, doc_id, text, fingerprint) that waits for the next row

        def close(t: str, f: str) -> None:
            new = edited(held[2], t)
            e = model.fingerprint(new)
            out.append((held[1], len(held[2]), hashlib.sha256(new.encode()).hexdigest(), held[3], e, model.likeness(held[3], e), model.likeness(held[3], f)))

        def flush() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out) if out else [()] * 7, kinds)], names)
            out.clear()
            return done

        for batch in batches:
            for b, guard, i, t in zip(*[c.to_pylist() for c in batch.columns]):
                if guard and (held is None or held[0] != b):
                    continue  # further guards of a range
                f = model.fingerprint(t)
                if held is not None and held[0] == b:
                    close(t, f)
                held = None if guard else (b, i, t, f)
            yield flush()

    return in_order(docs, doc_id, text).mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, ["bigint", "bigint", *["string"] * 3, "double", "double"])))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_report(table(spark, sf_dir, "documents"))
