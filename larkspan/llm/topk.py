"""Exact top-k search by columnar branch and bound.

Candidates are dealt to groups and packed in blocks of vertical layout: one row of the block for each dimension. For a
query, partial scores grow by a block of dimensions at a time, dimensions of large query mass first. After each block a
candidate survives only if its partial score plus the bound on what remains (the product of the remaining Euclidean masses
of query and candidate) reaches the k-th best score known so far; survivors are compacted before the next block. The k best
of a query are carried from block to block of a group, so that later blocks start with a bound. All scores are exact.

Queries come in blocks of at most QUERY_BLOCK rows, of which a copy goes to each group of candidates: candidates themselves
aren't copied. See group_count for the number of groups. Copies and candidates meet in a sort-merge join, by a hint: Spark
takes the exploded copies for hardly larger than the blocks they are copied from, and would send them all to the driver for
a broadcast. A task keeps k results for each query of the block it works on, and its results are merged by query.

Defined results: a vector takes no part if it is null or holds a null or non-finite component. Components may be of any
size: where products might pass a long, blocks are scored in unbounded integers and without bounds. Such scores rank by
their exact value; the column holds the end of the long's range that they lie beyond. Shorter vectors count as padded with
zeros; an empty vector scores 0. A row with a null vec_id takes no part. Rows that share the query's vec_id are the query's
own. Of query rows that repeat a vec_id the first by components is asked. An empty table gives no rows. Extra columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspan.llm._common import cut, slots, table

QUERY_BLOCK, BLOCK, DIMS, GROUP_BLOCKS = 2048, 4096, 8, 64
LEAST, MOST = -(2**63), 2**63 - 1


def taking_part(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v) of the rows that take part, v as it is."""
    x = F.col(embedding)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return vectors.where(F.col(vec_id).isNotNull() & x.isNotNull() & ~F.coalesce(bad, F.lit(False))).select(F.col(vec_id).cast("long").alias("vec_id"), x.cast("array<double>").alias("v"))


def matrix_of(lists: pa.ListArray) -> np.ndarray:
    """Rows of lists as rows of a matrix, padded with zeros."""
    lengths = np.asarray(lists.value_lengths(), np.int64)
    out = np.zeros((len(lengths), int(lengths.max(initial=0))))
    out[np.arange(out.shape[1]) < lengths[:, None]] = np.asarray(lists.flatten())
    return out


def stored(x: np.ndarray) -> bytes:
    """In four bytes a component where that loses nothing; the reader knows by the number of bytes."""
    with np.errstate(over="ignore"):
        short = x.astype("<f4")
    return (short if (short == x).all() else np.ascontiguousarray(x, "<f8")).tobytes()


def loaded(data: bytes, rows: int, columns: int) -> np.ndarray:
    return np.frombuffer(data, "<f4" if len(data) == 4 * rows * columns else "<f8").reshape(rows, columns).astype(np.float64)


def packed(rows: DataFrame, size: int, parts: int) -> DataFrame:
    """(g, dims, ids, data): blocks of at most size rows in vertical layout, g the group. Rows are dealt evenly."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        g = TaskContext.get().partitionId()
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                block = matrix_of(part.column(1))
                yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([block.shape[1]], pa.int32()), pa.array([np.asarray(part.column(0), dtype=np.int64).tobytes()], pa.binary()), pa.array([stored(np.ascontiguousarray(block.T))], pa.binary())], ["g", "dims", "ids", "data"])

    return rows.repartition(parts).mapInArrow(pack, "g int, dims int, ids binary, data binary")


def group_count(candidates: int, queries: int, block: int, slots: int, cores: int) -> int:
    """Groups of candidates: at least two a core, and as many more, up to two a shuffle partition, as leave the copies of the
    queries no larger than the candidates. A group has at most GROUP_BLOCKS blocks, which the join holds in memory."""
    blocks = -(-candidates // block)
    wanted = min(2 * slots, max(2 * cores, candidates // max(1, queries)))
    return max(1, min(blocks, max(wanted, -(-blocks // GROUP_BLOCKS))))


def whole(x: float, scale: int) -> int:
    return int(x) * scale if abs(x) >= 2**53 else math.floor(scale * x)


def scan_block(q: np.ndarray, own: int, ids: np.ndarray, block: np.ndarray, rest: np.ndarray, best: list[tuple[int, int]], k: int) -> list[tuple[int, int]]:
    """The k best of best and of the block's candidates for the query q, as (-score, vec_id) in order.
    block: dimensions by candidates; rest: root of the remaining mass before each block of dimensions, by candidates."""
    keep = np.flatnonzero(ids != own)
    score = np.zeros(len(keep), np.int64)
    tail = np.sqrt(np.append(np.cumsum((q.astype(np.float64) ** 2)[::-1])[::-1], 0.0))
    for step, d in enumerate(range(0, len(q), DIMS)):
        if not len(keep):
            break
        x = block[d : d + DIMS]
        score = score + q[d : d + DIMS] @ (x if len(keep) == x.shape[1] else x[:, keep])
        after = min(d + DIMS, len(q))
        bound = tail[after] * rest[step + 1][keep]
        bound += 1e-6 * bound + 1e-6  # rounding of the masses
        floor = -best[-1][0] if len(best) == k else None
        if len(keep) > k:  # k candidates have at least this much
            sure = np.partition(score - bound, len(keep) - k)[len(keep) - k]
            floor = sure if floor is None else max(floor, sure)
        if floor is not None:
            live = score + bound >= floor
            if not live.all():
                keep, score = keep[live], score[live]
    if len(keep) > 4 * k:  # ties of the k-th score stay
        live = score >= np.partition(score, len(keep) - k)[len(keep) - k]
        keep, score = keep[live], score[live]
    return sorted([*best, *zip((-score.astype(np.int64)).tolist(), ids[keep].tolist())])[:k]


def scan_large(q: list[int], own: int, ids: list[int], rows: list[list[int]], best: list[tuple[int, int]], k: int) -> list[tuple[int, int]]:
    """What scan_block gives, in unbounded integers. rows: candidates by dimensions."""
    return sorted([*best, *((-sum(a * b for a, b in zip(q, r)), i) for i, r in zip(ids, rows) if i != own)])[:k]


def rank_key(score: int) -> str | None:
    """Sorts scores beyond a long among themselves, as text; null for others."""
    if LEAST <= score <= MOST:
        return None
    digits = str(abs(score))
    if score > 0:
        return f"{len(digits):09d}{digits}"
    return f"{999_999_999 - len(digits):09d}" + "".join(str(9 - int(x)) for x in digits)


def search_blocks(qi: bytes, qd: int, qv: bytes, ci: bytes, cd: int, cv: bytes, best: list[list[tuple[int, int]]], k: int, scale: int) -> list[list[tuple[int, int]]]:
    """best, for each query of the block, after a block of candidates."""
    asked, ids = np.frombuffer(qi, np.int64), np.frombuffer(ci, np.int64)
    dims = max(qd, cd)
    raw_q, raw_c = np.zeros((len(asked), dims)), np.zeros((dims, len(ids)))
    raw_q[:, :qd], raw_c[:cd] = loaded(qv, len(asked), qd), loaded(cv, cd, len(ids))
    with np.errstate(over="ignore"):
        matrix, data = np.floor(scale * raw_q), np.floor(scale * raw_c)
        largest = float(np.abs(matrix).max(initial=0)) * float(np.abs(data).max(initial=0)) * max(1, dims)
    if not largest < 2**62:
        columns = [[whole(x, scale) for x in c] for c in raw_c.T.tolist()]
        return [scan_large([whole(x, scale) for x in row], own, ids.tolist(), columns, b, k) for row, own, b in zip(raw_q.tolist(), asked.tolist(), best)]
    order = np.argsort(-(matrix**2).sum(0), kind="stable")
    matrix, data = matrix[:, order], data[order]
    mass = (data**2)[::-1].cumsum(0)[::-1] if dims else np.zeros((0, len(ids)))
    rest = [np.sqrt(mass[d]) if d < dims else np.zeros(len(ids)) for d in range(0, dims + DIMS, DIMS)]
    if largest >= 2**53:  # below that, products in floating point are exact, and faster
        matrix, data = matrix.astype(np.int64), data.astype(np.int64)
    return [scan_block(row, own, ids, data, rest, b, k) for row, own, b in zip(matrix, asked.tolist(), best)]


def top_k(vectors: DataFrame, is_query, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 256, query_block: int = QUERY_BLOCK, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row for which is_query(vec_id column) holds, the k best other rows."""
    spark = vectors.sparkSession
    rows = taking_part(vectors, vec_id, embedding)
    chosen = rows.where(is_query(F.col("vec_id"))).groupBy("vec_id").agg(F.min("v").alias("v"))

    def pack_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, query_block):
                part = batch.slice(at, query_block)
                m = matrix_of(part.column(1))
                yield pa.RecordBatch.from_arrays([pa.array([m.shape[1]], pa.int32()), pa.array([np.asarray(part.column(0), dtype=np.int64).tobytes()], pa.binary()), pa.array([stored(m)], pa.binary())], ["q_dims", "q_ids", "q_data"])

    asked = cut(chosen.mapInArrow(pack_queries, "q_dims int, q_ids binary, q_data binary"))
    queries = asked.agg(F.sum(F.length("q_ids") / 8)).first()[0] or 0
    groups = group_count(rows.count(), int(queries), block, slots(spark), spark.sparkContext.defaultParallelism)
    blocks = cut(packed(rows, block, groups))
    copies = asked.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best = None, []

        def done() -> pa.RecordBatch:
            ids = np.frombuffer(now[1], np.int64).tolist() if now else []
            out = [(own, min(max(-s, LEAST), MOST), rank_key(-s), i) for own, b in zip(ids, best) for s, i in b]
            columns = list(zip(*out)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.int64())], ["query_id", "score", "beyond", "vec_id"])

        for batch in batches:
            cols = dict(zip(batch.schema.names, [x.to_pylist() for x in batch.columns]))
            for g, qd, qi, qv, cd, ci, cv in zip(*[cols[n] for n in ("g", "q_dims", "q_ids", "q_data", "dims", "ids", "data")]):
                if now != (g, qi):  # the join gives the blocks of a group one after the other; any order is right
                    if now:
                        yield done()
                    now, best = (g, qi), [[] for _ in range(len(qi) // 8)]
                best = search_blocks(qi, qd, qv, ci, cd, cv, best, k, scale)
        yield done()

    found = copies.hint("merge").join(blocks, "g").select("g", "q_dims", "q_ids", "q_data", "dims", "ids", "data").mapInArrow(search, "query_id bigint, score bigint, beyond string, vec_id bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), lambda v: v % 50 == 0)


OP3_SQL = """
with e as (select vec_id, [floor(256 * x::double)::bigint for x in embedding] v from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::bigint score
      from e q join e c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score
from s qualify rank <= 5
"""
