"""SimHash near duplicates: fingerprints of word shingles, pigeonhole blocks, and a check of the Hamming distance."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_one, slices
from .near_dedup import components

BITS = 64
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
#: Row b: the bits of byte b, the highest first.
_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def word_blocks(text: bytes, size: int) -> Iterator[list[bytes]]:
    """The words of a text, those of some `size` bytes at a time."""
    at = 0
    while at < len(text):
        end = len(text) if at + size >= len(text) else m.start() if (m := _BLANK.search(text, at + size)) else len(text)
        yield text[at:end].lower().split()
        at = end


def set_bits(words: list[bytes], width: int) -> np.ndarray:
    """In how many hashes of the words' shingles each bit is set, the highest first."""
    joined = b" ".join(words)
    n = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(n + 1) - 1
    cuts = map(slice, (ends - n)[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, cuts), repeat(42)), np.uint64, len(words) - width + 1)
    each = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    return np.concatenate([np.bincount(each[:, k], minlength=256) @ _OF_BYTE for k in range(8)])


def fingerprint(text: bytes | None, width: int = 4, block: int = 1 << 22) -> int:
    """A bit is 1 if it is set in over half the hashes (XXH64, seed 42) of the shingles of `width` words, repeats included. A-Z
    are lowered, blanks are [\\x20\\x09-\\x0D]. Fewer words are one shingle; without words the fingerprint is 0. A block of the
    text is cut into words at a time."""
    ones, n, held = np.zeros(BITS, np.int64), 0, []
    for words in word_blocks(text or b"", block):
        held += words
        if len(held) >= width:
            ones += set_bits(held, width)
            n += len(held) - width + 1
            held = held[len(held) - width + 1 :]
    if not n and held:
        ones, n = set_bits(held, len(held)), 1
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big") if n else 0


def fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """doc_id and print, the fingerprint as a signed 64-bit number, for every row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.view(np.int64))], names=["doc_id", "print"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(sign, f"doc_id {kind}, print long")


def split_masks(mask: int, parts: int) -> list[int]:
    """The bits that mask leaves free, cut into `parts` blocks, each added to mask."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    return [mask | sum(1 << b for b in free[len(free) * i // parts : len(free) * (i + 1) // parts]) for i in range(parts)]


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> BITS - 1 else x


def spanning_links(prints: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links (a, b) of prints at most `distance` bits apart that join every two of them which such links join. Each print that
    is reached is compared with those not reached yet only, and gives one link."""
    close = np.zeros(len(prints), bool)
    for k in range(0, len(prints), 256):
        near = np.bitwise_count(prints[k : k + 256, None] ^ prints[None, :]) <= distance
        close[k : k + 256] = near.sum(axis=1) > 1
    left, out = prints[close], []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            near = np.bitwise_count(front[:256, None] ^ left[None, :]) <= distance
            hit = near.any(axis=0)
            if hit.any():
                out.append((front[:256][near[:, hit].argmax(axis=0)], left[hit]))
            front, left = np.concatenate([front[256:], left[hit]]), left[~hit]
    return out


def bucket_links(buckets: DataFrame, distance: int) -> DataFrame:
    """(a, b) of the links in arrays `prints`, as spanning_links gives them."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lists = batch.column(0)
            values, ends = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.cumsum([0, *lists.value_lengths().to_pylist()])
            found = [x for i, j in zip(ends[:-1], ends[1:], strict=True) for x in spanning_links(values[i:j], distance)]
            a, b = (np.concatenate([np.empty(0, np.uint64), *x]).view(np.int64) for x in (zip(*found, strict=True) if found else ([], [])))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return buckets.select("prints").mapInArrow(compare, "a long, b long")


def links(prints: DataFrame, scratch: Scratch, distance: int = 4, most: int = 2048, depth: int = 4) -> DataFrame:
    """(a, b): links between distinct prints (column print) that join all prints which lie at most `distance` bits apart.

    The bits are cut into distance + 1 blocks, so two such prints agree in all bits of one block at least (pigeonhole): a
    bucket is the prints with the same bits in a block. A bucket of more than `most` prints is cut by blocks of its other bits
    again, for which the same holds, up to `depth` times; one that is still larger has its prints dealt to tiles by a hash and
    every two tiles compared. So a task compares a bounded number of prints, no pair within the distance is left out, and of
    a crowded bucket only links that join prints anew leave the task.
    """
    spark, masks, found = prints.sparkSession, [0], []
    rows = prints.select(F.lit(0).cast("long").alias("mask"), F.col("print"))
    for level in range(depth):
        into = spark.createDataFrame([(signed(m), [signed(x) for x in split_masks(m, distance + 1)]) for m in masks], "mask long, into array<long>")
        masks = sorted({x for m in masks for x in split_masks(m, distance + 1)})
        cut = (rows.join(F.broadcast(into), "mask") if level else rows.withColumn("into", F.array(*[F.lit(signed(m)) for m in masks]))).select(F.explode("into").alias("mask"), "print").withColumn("bucket", F.col("print").bitwiseAND(F.col("mask")))
        cut = scratch.write(cut.distinct() if level else cut, f"cut{level}")
        sizes = scratch.write(cut.groupBy("mask", "bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), f"sizes{level}")
        small = cut.join(sizes.where(F.col("n") <= most), ["mask", "bucket"]).groupBy("mask", "bucket").agg(F.collect_list("print").alias("prints"))
        found.append(scratch.write(bucket_links(small, distance), f"links{level}"))
        large = sizes.where(F.col("n") > most)
        if large.limit(1).count() == 0:
            break
        rows = join_one(cut, large, ["mask", "bucket"], "n")
    else:
        tiles = F.ceil(F.col("n") / most)
        own = rows.withColumn("own", F.pmod(F.xxhash64("print"), tiles)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), tiles - 1)))
        pairs = own.groupBy("mask", "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(F.collect_list("print").alias("prints"))
        found.append(scratch.write(bucket_links(pairs, distance), "links_of_tiles"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def hex_of(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


def simhash_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 4, distance: int = 4, most: int = 2048) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row. Documents whose fingerprints differ in at most `distance`
    bits are linked; component_id is the smallest doc_id that links reach, the row's own included.

    A text is read once, for its fingerprint. Equal fingerprints are one node, so copies cost nothing after that; nodes meet in
    blocks (see links) and their components are labelled by joins. Where one fingerprint or one component has more than a
    thousandth of the rows its row is broadcast (there are fewer than a thousand such), so no join has a hot key.
    Null texts count as empty: fingerprint 0, which is linked like any other. Null ids are above all others: a component of
    null ids only has a null component_id. Repeated rows each get a row. An empty table gives no rows. Other columns aren't read.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.write(fingerprints(docs, id_col, text_col, width), "prints")
    nodes = scratch.write(rows.groupBy("print").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "nodes")
    labels = components(links(nodes.select("print"), scratch, distance, most), scratch)
    named = scratch.write(nodes.join(labels.withColumnRenamed("node", "print"), "print", "left").withColumn("label", F.coalesce("label", "print")), "named")
    classes = scratch.write(named.groupBy("label").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members")), "classes")
    of_print = scratch.write(join_one(named.select("print", "n", "label"), classes, ["label"], "members").select("print", "n", "component_id"), "of_print")
    return join_one(rows, of_print, ["print"], "n").select("doc_id", hex_of(F.col("print")).alias("fingerprint"), "component_id")
