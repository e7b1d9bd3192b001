"""Exact dedup with an extendible-hash index on shared files."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, n_partitions

_PREFIX = 20


class Directory:
    """Leading bits of a key -> bucket. A bucket that is overfull splits; the directory doubles when its depth is reached."""

    def __init__(self) -> None:
        self.depth, self.slots, self.local = 0, [0], {0: 0}

    def split(self, bucket: int) -> tuple[int, int]:
        if self.local[bucket] == self.depth:
            self.slots = [b for b in self.slots for _ in range(2)]
            self.depth += 1
        self.local[bucket] += 1
        new = len(self.local)
        self.local[new] = self.local[bucket]
        own = [i for i, b in enumerate(self.slots) if b == bucket]
        for i in own[len(own) // 2 :]:
            self.slots[i] = new
        return bucket, new

    @classmethod
    def fitted(cls, rows: dict[int, int], bits: int, most: int) -> Directory:
        """rows: how many rows have a prefix of so many bits. Splits buckets of over `most` rows until the bits are used up."""
        import numpy as np

        out = cls()
        counts = np.zeros(1 << bits, dtype=np.int64)
        for k, n in rows.items():
            counts[k] = n
        before = np.concatenate([[0], np.cumsum(counts)])
        todo = [(0, 0, 1 << bits)]
        while todo:
            bucket, lo, hi = todo.pop()
            if before[hi] - before[lo] > most and hi - lo > 1:
                left, right = out.split(bucket)
                mid = (lo + hi) // 2
                todo += [(left, lo, mid), (right, mid, hi)]
        return out


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row. Equal texts are a group; the largest id stays.

    1. Spark counts the rows of each 64-bit key. The driver gets a histogram of key prefixes (at most 2^20 rows, and no more
       than four for each bucket) and splits buckets, doubling the directory, until each has at most `bucket_rows` rows. The
       default keeps the directory under about 131,072 buckets at any size. A key with more rows than that is not split: it
       gets a chain of pages, dealt by a hash of the id, so a text with a third of all rows is spread over many tasks.
    2. Buckets, in key order, and pages are given to owner tasks with about equal rows. An owner sorts its key range, follows
       the chain of texts below each key and compares bytes. Its part of the index goes to the shared folder as Parquet:
       a row for each document, with the text at the head of its group.
    3. Only the heads of paged keys, one for each page, are compared with each other.
    Null text counts as empty. Null ids are below all others. Of repeated rows with the same id exactly one is kept. An empty
    table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    scratch, owners = Scratch(spark, "exact_dedup"), n_partitions(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    keys = scratch.write(rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")), "keys")

    total = keys.agg(F.sum("n")).first()[0] or 0
    most = bucket_rows or max(1000, total // 65_536)
    bits = min(_PREFIX, max(1, (4 * total // most).bit_length()))
    short = keys.where(F.col("n") <= most).groupBy(F.shiftrightunsigned("h", 64 - bits).alias("prefix")).agg(F.sum("n").alias("n")).collect()
    directory = Directory.fitted({r["prefix"]: r["n"] for r in short}, bits, most)
    paged = [(r["h"], -(-r["n"] // most)) for r in keys.where(F.col("n") > most).orderBy("h").collect()]

    load, slot_of = [0] * (1 << directory.depth), 64 - directory.depth
    for r in short:
        load[r["prefix"] >> (bits - directory.depth)] += r["n"]
    of_bucket: dict[int, int] = {}
    for slot, b in enumerate(directory.slots):
        of_bucket[b] = of_bucket.get(b, 0) + load[slot]
    owner, done, all_rows = {}, 0, max(1, sum(of_bucket.values()))
    for b in dict.fromkeys(directory.slots):  # in key order
        owner[b] = min(owners - 1, (done + of_bucket[b] // 2) * owners // all_rows)
        done += of_bucket[b]
    slots = spark.createDataFrame([(s, b, owner[b]) for s, b in enumerate(directory.slots)], "slot long, bucket int, owner int")
    first, chains = 0, []
    for h, pages in paged:
        chains.append((h, pages, first % owners))
        first += pages
    chained = spark.createDataFrame(chains, "h long, pages int, first int")

    page = F.pmod(F.xxhash64("doc_id"), F.col("pages"))
    dealt = (
        rows.withColumn("slot", F.shiftrightunsigned("h", slot_of) if directory.depth else F.lit(0).cast("long"))
        .join(F.broadcast(slots), "slot", "left")
        .join(F.broadcast(chained), "h", "left")
        .withColumn("page", F.coalesce(page, F.lit(0)).cast("int"))
        .withColumn("owner", F.when(F.col("pages").isNull(), F.col("owner")).otherwise(F.pmod(F.col("first") + F.col("page"), F.lit(owners))).cast("int"))
        .withColumn("paged", F.col("pages").isNotNull())
        .repartitionById(owners, F.coalesce(F.col("owner"), F.lit(0)))
        .sortWithinPartitions("bucket", "h", "page")
        .select("doc_id", F.col("text").cast("binary").alias("text"), "h", "page", "paged")
    )

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stream():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        out: list = []
        for (h, page), run in groupby(stream(), lambda r: (r[2], r[3])):
            chain: dict[bytes, list] = {}  # a dict compares the bytes of keys with the same hash
            paged = False
            for doc, text, _, _, paged in run:
                chain.setdefault(text, []).append(doc)
            for k, (text, ids) in enumerate(chain.items()):
                ids.sort(key=lambda x: (x is not None, x), reverse=True)
                sha = hashlib.sha256(text).hexdigest()
                out += [(d, h, page, k, paged, ids[0], len(ids), i == 0, sha, text if i == 0 else None) for i, d in enumerate(ids)]
            if len(out) > 2000:
                yield batch_of(out)
                out = []
        yield batch_of(out)

    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    fields = [("doc_id", id_type), ("h", pa.int64()), ("page", pa.int32()), ("chain", pa.int32()), ("paged", pa.bool_()), ("keep_id", id_type), ("group_size", pa.int64()), ("kept", pa.bool_()), ("text_sha256", pa.string()), ("head", pa.binary())]

    def batch_of(out: list) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) if out else [[] for _ in fields]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])

    index = scratch.write(dealt.mapInArrow(own, f"doc_id {kind}, h long, page int, chain int, paged boolean, keep_id {kind}, group_size long, kept boolean, text_sha256 string, head binary"), "index")
    result = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    plain = index.where(~F.col("paged")).select(result)
    heads = index.where("paged and kept").select("h", "page", "chain", F.col("head"), "keep_id", "group_size")
    whole = heads.groupBy("h", "head").agg(F.max("keep_id").alias("best"), F.sum("group_size").alias("size"), F.max(F.struct("keep_id", -F.col("page"))).alias("_w")).select("h", "head", "best", "size", (-F.col("_w")[f"col2"]).alias("winner"))
    merged = heads.join(whole, ["h", "head"]).select("h", "page", "chain", "best", "size", (F.col("winner") == F.col("page")).alias("wins"))
    pages = index.where("paged").join(merged, ["h", "page", "chain"])
    return plain.unionByName(pages.select("doc_id", F.col("best").alias("keep_id"), F.col("size").alias("group_size"), (F.col("kept") & F.col("wins")).alias("kept"), "text_sha256"))
