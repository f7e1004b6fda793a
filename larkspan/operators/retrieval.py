"""Lexical, dense and hybrid retrieval over ordinary DataFrames.

Every ranking has a total order. Query sides are joined on terms, never compared with all documents; only documents that
share a term with a query take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.functions import text as T

GROUPS = 64


def term_frequencies(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, term, tf, len): the postings, with each document's length."""
    words = docs.select(F.col(doc).alias("doc"), T.tokens(F.col(text)).alias("w")).select("doc", F.size("w").alias("len"), F.explode("w").alias("term"))
    return words.groupBy("doc", "len", "term").agg(F.count("*").alias("tf"))


def corpus_statistics(docs: DataFrame, text: str) -> DataFrame:
    """One row: number of documents that have terms, and their mean length."""
    n = F.size(T.tokens(F.col(text)))
    return docs.select(n.alias("n")).agg(F.count("*").alias("docs"), F.avg("n").alias("avg_len"))


def bm25(docs: DataFrame, queries: DataFrame, doc: str, text: str, query: str, query_text: str, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query, doc, score): Okapi scores. A word that a query repeats counts each time."""
    asked = queries.select(F.col(query).alias("query"), F.explode(T.tokens(F.col(query_text))).alias("term")).groupBy("query", "term").agg(F.count("*").alias("qtf"))
    vocabulary = asked.select("term").distinct()
    words = docs.select(F.col(doc).alias("doc"), T.tokens(F.col(text)).alias("w")).select("doc", F.size("w").alias("len"), F.explode("w").alias("term"))
    # terms that no query has are dropped before anything is counted
    postings = words.join(vocabulary, "term", "left_semi").groupBy("doc", "len", "term").agg(F.count("*").alias("tf"))
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    stats = corpus_statistics(docs, text)
    idf = df.join(F.broadcast(stats)).select("term", F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), "avg_len")
    weighted = asked.join(idf, "term")
    norm = F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len"))
    return postings.join(weighted, "term").groupBy("query", "doc").agg(F.sum(F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / norm).alias("score"))


def ranked(scores: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """The k best of each query with rank and the score over the best: (query, rank, doc, score, normalized)."""
    w = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    out = scores.withColumn("score", F.round("score", digits)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return out.withColumn("normalized", F.round(F.col("score") / F.max("score").over(Window.partitionBy("query")), digits))


def cosine_top_k(vectors: DataFrame, queries: DataFrame, key: str, embedding: str, k: int, floor: float = 0.05) -> DataFrame:
    """(query, rank, doc, score): cosine similarity, clipped to [0, 1], above floor. Queries are a stated, small set."""
    unit = lambda c: F.transform(F.col(c), lambda x: x.cast("double"))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    docs = vectors.select(F.col(key).alias("doc"), unit(embedding).alias("v")).withColumn("nv", norm(F.col("v")))
    asked = queries.select(F.col(key).alias("query"), unit(embedding).alias("q")).withColumn("nq", norm(F.col("q")))
    dot = F.aggregate(F.zip_with("v", "q", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    score = F.when((F.col("nv") > 0) & (F.col("nq") > 0), F.least(F.greatest(dot / (F.col("nv") * F.col("nq")), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    docs = docs.withColumn("g", F.pmod(F.xxhash64("doc"), F.lit(GROUPS)))
    asked = asked.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(GROUPS - 1))))
    pairs = docs.join(asked, "g").where("doc <> query").select("query", "doc", F.round(score, 4).alias("score"))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    return pairs.withColumn("rank", F.row_number().over(w)).where((F.col("rank") <= k) & (F.col("score") > floor))


def fused(long: DataFrame, weights: dict[str, float]) -> DataFrame:
    """long: rows (query, doc, a score for each name in weights, 0 where it has none). Each candidate as one row: the weighted
    mean of its best scores, boosted where two retrievers agree."""
    wide = long.groupBy("query", "doc").agg(*[F.max(n).alias(n) for n in weights])
    agreeing = sum((F.when(F.col(n) > 0, 1).otherwise(0) for n in weights), F.lit(0))
    base = sum((F.col(n) * w for n, w in weights.items()), F.lit(0.0)) / sum(weights.values())
    boosted = F.when(agreeing >= 2, F.least(F.lit(0.98), base * 1.15)).otherwise(base)
    return wide.withColumn("score", F.round(F.least(F.lit(0.98), boosted), 3))


def margins(ranked_rows: DataFrame) -> DataFrame:
    """(query, doc, score, margin): the best of each query and its lead over the second; without a second, its score."""
    w = Window.partitionBy("query").orderBy("rank")
    return ranked_rows.withColumn("next", F.lead("score").over(w)).where("rank = 1").select("query", "doc", "score", F.round(F.col("score") - F.coalesce("next", F.lit(0.0)), 6).alias("margin"))


def case_ranked(df: DataFrame, key: str, title: str, words: str, limit: int) -> DataFrame:
    """Rows whose title or key match, prefix before word before part, at most limit."""
    t = F.lower(F.col(title))
    place = F.when(t.startswith(words), 1).when(F.concat(F.lit(" "), t, F.lit(" ")).contains(f" {words} "), 2).when(t.contains(words), 3)
    return df.withColumn("place", place).where("place is not null").orderBy("place", title, key).limit(limit)


def clause_search(passages: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """passages (doc, w), queries (query, q) with distinct words: Jaccard similarity of those that share a word."""
    a = queries.select("query", F.size("q").alias("nq"), F.explode("q").alias("term"))
    b = passages.select("doc", F.size("w").alias("nw"), F.explode("w").alias("term"))
    shared = b.join(a, "term").groupBy("query", "doc", "nq", "nw").agg(F.count("*").alias("n"))
    scored = shared.withColumn("score", F.round(F.col("n") / (F.col("nq") + F.col("nw") - F.col("n")), 6))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", "rank", "doc", "score")


def positions(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, pos, term): every word with its position."""
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^a-z0-9]+", " ")), " ")
    return docs.select(F.col(doc).alias("doc"), F.posexplode(words).alias("pos", "term")).where("term <> ''")


def phrase_matches(postings: DataFrame, phrase: list[str]) -> DataFrame:
    """(doc, hits): how often the words of the phrase stand one after another."""
    at = postings.where(F.col("term").isin(*phrase))
    found = None
    for i, word in enumerate(phrase):
        one = at.where(F.col("term") == word).select("doc", (F.col("pos") - i).alias("start"))
        found = one if found is None else found.join(one, ["doc", "start"])
    return found.groupBy("doc").agg(F.count("*").alias("hits"))


def prefix_matches(postings: DataFrame, prefix: str) -> DataFrame:
    """(doc, hits, terms): words that begin with prefix."""
    return postings.where(F.col("term").startswith(prefix)).groupBy("doc").agg(F.count("*").alias("hits"), F.count_distinct("term").alias("terms"))


def incremental(new: DataFrame, old: DataFrame, key: str, content: Column) -> tuple[DataFrame, DataFrame]:
    """Rows of new to compute again (content hash not in old) and rows of old that still hold; old has (key, hash)."""
    hashed = new.withColumn("hash", F.substring(F.sha2(content, 256), 1, 16))
    return hashed.join(old.select(key, "hash"), [key, "hash"], "left_anti"), old.join(hashed.select(key, "hash"), [key, "hash"], "left_semi")
