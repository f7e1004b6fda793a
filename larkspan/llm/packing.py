"""Best-fit packing planned on the histogram of lengths.

1. Each text is tokenised once; a document longer than a sequence is cut into pieces of full length, of which the first
   may be shorter.
2. The histogram of piece lengths has at most `size` rows, whatever the input, and comes to the driver. Best fit
   decreasing runs over its counts: all open sequences with the same contents are one group, so a step places many
   pieces at once, and the plan has a few rows for each length.
3. A piece takes the planned slot with its rank among pieces of its length. Ranks are given within (length, bucket of a
   hash), and the counts of the buckets say where each bucket's ranks begin. A length has a bucket for each BUCKET pieces, so
   that no length, however common, is ranked in one task. A piece of full length has a sequence to itself and needs no rank.

Ids are those of `tokenizers`. The encoder that reads the same vocabulary as ranks is faster and is used where it can be; it
breaks down on long runs of white space, so that texts with a run of LONG_SPACE characters go to `tokenizers`, and so does
any text on which it fails.

Defined results: a null text counts as empty; an empty text is the one id that ends every document; repeated rows are
packed each; a null doc_id is kept; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspan.llm._common import blank, cut, table

SIZE, BUCKET = 2048, 50_000
LONG_SPACE = re.compile(r"\s{500}")
END = struct.pack("<I", 0)
MEETING = re.compile(r"\s\s")


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Runs(dict):
    """By run of characters without space: the ids of what goes before and that run. New runs are taken apart at a line
    break and before a last comma or full stop, as the tokenizer does, so that most parts are known already."""

    KEPT, LONG = 400_000, 1000

    def __init__(self, packed, before: str):
        self.packed, self.before = packed, before

    def __missing__(self, run: str) -> bytes:
        if len(self) >= self.KEPT:
            self.clear()
        head, line, rest = run.partition("\n")
        if line and head and rest:
            # one after the other: a run can have any number of lines
            lines = rest[:-1].split(line)
            lines[-1] += rest[-1]
            ids = self[head] + b"".join(self.kin[line] + self.kin[x] for x in lines)
            if len(run) > self.LONG:  # its lines are kept, itself hardly comes again
                return ids
        elif run[-1:] in (".", ",") and run[:-1].isalpha():
            ids = self[run[:-1]] + self.kin[run[-1]]
        else:
            ids = self.packed(self.before + run)
        self[run] = ids
        return ids


class Ids:
    """Token ids of texts, as little-endian unsigned 32-bit integers in one bytes object.

    The ids are those of byte_bpe_50k.json; its vocabulary is read as ranks (path), since most of the work is then saved:
    where no two white-space characters meet, a space always opens a token of its own or of the run after it, so the runs
    between spaces can be looked up one by one. Other texts go through the encoder whole."""

    END_OF_TEXT, END_OF_TEXT_ID = "<|endoftext|>", 50256

    def __init__(self, path: str, exact: str | None = None):
        import public_tokenizers
        import tiktoken

        self.exact, self.tokenizer = exact or tokenizer_path("byte_bpe_50k.json"), None

        with open(path, "rb") as f:
            ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.first, self.after = Runs(self.packed, ""), Runs(self.packed, " ")
        self.first.kin = self.after.kin = self.first

    def packed(self, text: str) -> bytes:
        ids = None if LONG_SPACE.search(text) else self.tried(text)
        if ids is None:
            if self.tokenizer is None:
                from tokenizers import Tokenizer

                self.tokenizer = Tokenizer.from_file(self.exact)
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def tried(self, text: str) -> list[int] | None:
        """The ids, or None where the encoder breaks down: its panics aren't Exceptions."""
        try:
            return self.encode(text)
        except BaseException as e:
            if isinstance(e, Exception) or type(e).__name__ == "PanicException":
                return None
            raise

    def of(self, text: str) -> bytes:
        if self.END_OF_TEXT in text:
            return struct.pack("<I", self.END_OF_TEXT_ID).join(self.of(x) for x in text.split(self.END_OF_TEXT))
        if MEETING.search(text):
            return self.packed(text)
        first, *runs = text.split(" ")
        return self.first[first] + b"".join(map(self.after.__getitem__, runs))


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, path: str | None = None, exact: str | None = None, with_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): the pieces of each document. path, exact: the vocabulary as ranks
    and as a file of `tokenizers`."""
    path, exact = path or tokenizer_path(), exact or tokenizer_path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Ids(path, exact)
        for batch in batches:
            out: list[tuple] = []
            kept: list[np.ndarray] = []
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = tokens.of(t) + END
                n = len(ids) // 4
                edges = [0, *range(n % size or size, n + 1, size)]
                for p, (s, e) in enumerate(zip(edges, edges[1:])):
                    out.append((key, p, s, e - s, zlib.crc32(ids[4 * s : 4 * e])))
                    if with_ids:
                        kept.append(np.frombuffer(ids[4 * s : 4 * e], "<u4"))
            columns = list(zip(*out)) or [()] * 5
            arrays = [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), *[pa.array(c, pa.int64()) for c in columns[2:]]]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    kinds = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), blank(text).alias("t")).mapInArrow(run, kinds)


def plan(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit decreasing over counts. Rows (length, first rank, pieces, first sequence, pieces per sequence, offset): the
    pieces of that length with ranks from first rank on go, so many to a sequence, to sequences in order."""
    rows = []
    groups: dict[int, list[list[int]]] = {}  # by room left: [first sequence, sequences]
    free = 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        room = length
        while left:
            while room < size and not groups.get(room):
                room += 1
            if room >= size:  # nothing open has room
                per = size // length
                full, part = divmod(left, per)
                for seqs, each in ((full, per), (1 if part else 0, part)):
                    if seqs:
                        rows.append((length, rank, seqs * each, free, each, 0))
                        groups.setdefault(size - each * length, []).append([free, seqs])
                        rank, free = rank + seqs * each, free + seqs
                left = 0
                continue
            first, seqs = groups[room].pop()
            per = room // length
            full, part = divmod(min(left, per * seqs), per)
            at = first
            for n, each in ((full, per), (1 if part else 0, part)):
                if n:
                    rows.append((length, rank, n * each, at, each, size - room))
                    groups.setdefault(room - each * length, []).append([at, n])
                    rank, left, at = rank + n * each, left - n * each, at + n
            if at < first + seqs:
                groups[room].append([at, first + seqs - at])
    return rows


def pack(found: DataFrame, size: int = SIZE, bucket: int = BUCKET) -> DataFrame:
    """found (pieces with a length of at most size) with sequence_id and offset."""
    spark = found.sparkSession
    kept = cut(found)
    # each in a sequence of its own; negative numbers are no planned sequence's
    full = kept.where(F.col("length") == size).select(*found.columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    short = kept.where(F.col("length") < size)
    histogram = {r.length: r["count"] for r in short.groupBy("length").count().collect()}  # less than size rows
    rows = [(n, max(1, -(-c // bucket))) for n, c in histogram.items()]
    lengths = spark.createDataFrame(rows or [(0, 1)], "length bigint, buckets bigint")
    keyed = short.join(F.broadcast(lengths), "length").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("buckets"))).drop("buckets")
    counts = keyed.groupBy("length", "bucket").count()  # less than size rows, and one for each `bucket` pieces
    begin = counts.withColumn("begin", F.sum("count").over(Window.partitionBy("length").orderBy("bucket")) - F.col("count")).select("length", "bucket", "begin")
    slots = spark.createDataFrame(plan(histogram, size) or [(0, 0, 0, 0, 1, 0)], "length bigint, lo bigint, n bigint, seq bigint, per bigint, at bigint")
    slots = slots.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("lo", "n", "seq", "per", "at"))).alias("slots"))
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start")
    ranked = keyed.withColumn("local", F.row_number().over(order) - 1).join(begin, ["length", "bucket"]).withColumn("rank", F.col("begin") + F.col("local"))
    placed = ranked.join(F.broadcast(slots), "length").withColumn("slot", F.expr("filter(slots, s -> s.lo <= rank and rank < s.lo + s.n)[0]"))
    nth = F.col("rank") - F.col("slot.lo")
    placed = placed.withColumn("sequence_id", F.col("slot.seq") + F.floor(nth / F.col("slot.per"))).withColumn("offset", F.col("slot.at") + (nth % F.col("slot.per")) * F.col("length"))
    return placed.select(*found.columns, F.col("sequence_id").cast("long"), F.col("offset").cast("long")).unionByName(full)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents"), with_ids=False))
