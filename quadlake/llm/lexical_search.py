"""Ranked lexical search: a block-compressed inverted index in shards, searched by Block-Max MaxScore."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: A term: ASCII letters and digits and all that isn't ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
#: The same on UTF-8 bytes: A-Z lowered, and blanks for what is in no term.
_TO_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
BLOCK = 128
_WIDTHS = (np.dtype("u1"), np.dtype("<u2"), np.dtype("<u4"))


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0))


def term_blocks(text: bytes, size: int) -> Iterator[list[bytes]]:
    """The terms of a text, those of some `size` bytes at a time."""
    at = 0
    while at < len(text):
        end = len(text) if at + size >= len(text) else m.start() if (m := _GAP.search(text, at + size)) else len(text)
        yield text[at:end].translate(_TO_TERMS).split()
        at = end


def narrow(values: np.ndarray, starts: np.ndarray, n: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The values of each list as bytes, all of a list in the narrowest unsigned type that holds them; and 0, 1, 2 for the type."""
    most = np.maximum.reduceat(values, starts)
    kind = (most > 0xFF).astype(np.int8) + (most > 0xFFFF)
    ends = np.cumsum(n << kind)
    out = np.empty(ends[-1], np.uint8)
    of, inside = np.repeat(kind, n), np.arange(len(values)) - np.repeat(starts, n)
    to = np.repeat(ends - (n << kind), n) + (inside << of)
    for k, dtype in enumerate(_WIDTHS):
        own = of == k
        raw = values[own].astype(dtype).view(np.uint8).reshape(-1, dtype.itemsize)
        for b in range(dtype.itemsize):
            out[to[own] + b] = raw[:, b]
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(out)]), kind


@dataclass
class Shard:
    """Documents of one task that are indexed together, and how their posting lists are made."""

    words: defaultdict = field(default_factory=lambda: defaultdict(count().__next__))
    ids: list = field(default_factory=list)  # document numbers are in owners, term numbers in chunks
    chunks: list = field(default_factory=list)
    lengths: list = field(default_factory=list)
    size: int = 0

    def add(self, doc_id: pa.Scalar, text: bytes, block: int) -> None:
        n = 0
        for words in term_blocks(text, block):
            if words:
                self.chunks.append((len(self.ids), np.fromiter(map(self.words.__getitem__, words), np.int32, len(words))))
                n += len(words)
        if n:
            self.ids.append(doc_id)
            self.lengths.append(n)
            self.size += n

    def rows(self, shard: int, docs: int, terms: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        """A row for each document, one with the length norms of all, and a posting list for each term. Documents are numbered by
        id, so that among equal scores the lower number is the lower id."""
        ids = pa.array([i.as_py() for i in self.ids], kind)
        order = pc.sort_indices(ids, null_placement="at_end").to_numpy()
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        norms = 10 + 90 * np.array(self.lengths, np.int64)[order] * docs // terms
        yield batch_of(kind="doc", shard=shard, rows=len(order), doc_id=ids.take(pa.array(order)), number=pa.array(np.arange(len(order), dtype=np.int32)))
        yield batch_of(kind="list", shard=shard, rows=1, id_type=kind, term=[b""], n=[len(order)], tfs=[norms.tobytes()])
        owner = np.repeat(number[[i for i, _ in self.chunks]], [len(c) for _, c in self.chunks])
        posting, tf = np.unique(np.concatenate([c for _, c in self.chunks]).astype(np.int64) * len(order) + owner, return_counts=True)
        term, doc = np.divmod(posting, len(order))
        starts = np.flatnonzero(np.diff(term, prepend=-1))
        n = np.diff(starts, append=len(term))
        inside = np.arange(len(term)) - np.repeat(starts, n)
        gaps = np.where(inside == 0, doc, np.diff(doc, prepend=0))
        heads = np.flatnonzero(inside % BLOCK == 0)
        blocks = -(-n // BLOCK)
        offsets = pa.array(np.concatenate([[0], np.cumsum(blocks)]).astype(np.int32))
        tops = np.maximum.reduceat(impact(tf, norms[doc]), heads)
        lasts = doc[np.append(heads[1:], len(doc)) - 1].astype(np.int32)
        (docs_raw, docs_kind), (tfs_raw, tfs_kind) = narrow(gaps, starts, n), narrow(tf, starts, n)
        names = pa.array(list(self.words), pa.binary())
        whole = batch_of(kind="list", shard=shard, rows=len(n), id_type=kind, term=names, n=pa.array(n), docs=docs_raw, docs_kind=pa.array(docs_kind), tfs=tfs_raw, tfs_kind=pa.array(tfs_kind), lasts=pa.ListArray.from_arrays(offsets, pa.array(lasts)), tops=pa.ListArray.from_arrays(offsets, pa.array(tops)))
        for k in range(0, len(n), 20_000):
            yield whole.slice(k, 20_000)


def impact(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """What a term's weight is multiplied with: thousand millionths of saturation, in 64-bit integers."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * norm)


_COLUMNS = {"term": pa.binary(), "n": pa.int64(), "docs": pa.binary(), "docs_kind": pa.int8(), "tfs": pa.binary(), "tfs_kind": pa.int8(), "lasts": pa.list_(pa.int32()), "tops": pa.list_(pa.int64()), "number": pa.int32()}
_SCHEMA = "kind string, shard long, term binary, n long, docs binary, docs_kind byte, tfs binary, tfs_kind byte, lasts array<int>, tops array<long>, number int"


def batch_of(kind: str, shard: int, rows: int, doc_id=None, id_type=None, **given) -> pa.RecordBatch:
    """Rows of the index table; columns that aren't given are null."""
    columns = {"kind": pa.array([kind] * rows), "shard": pa.array(np.full(rows, shard, np.int64))}
    for name, t in _COLUMNS.items():
        own = given.get(name)
        columns[name] = pa.nulls(rows, t) if own is None else pa.array(own, t) if isinstance(own, list) else own
    columns["doc_id"] = doc_id if doc_id is not None else pa.nulls(rows, id_type)
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


@dataclass
class Index:
    """lists: (shard, term, n, docs, tfs, lasts, tops), with a row of term b'' for a shard's length norms. docs: (shard, number,
    doc_id). n_docs documents have n_terms terms in all."""

    lists: DataFrame
    docs: DataFrame
    n_docs: int
    n_terms: int


def build_index(docs: DataFrame, scratch: Scratch, *, id_col: str = "doc_id", text_col: str = "text", shard_terms: int = 4_000_000, shard_docs: int = 65_536, block: int = 1 << 22) -> Index:
    """Indexes every row of docs that has a term. Two reads of the texts: the first counts documents and terms, which the length
    norms need; the second makes posting lists inside the tasks that read them, so no posting is shuffled. A task starts a new
    shard after `shard_terms` terms or `shard_docs` documents, which bounds its memory; the number of shards follows the data.
    A list has its documents' gaps and counts in the narrowest of three integer types, and for every 128 postings the last
    document and the highest impact (see impact)."""
    n = F.coalesce(F.regexp_count(F.col(text_col), F.lit(TERM)), F.lit(0)).cast("long")
    got = docs.select(n.alias("n")).agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    n_docs, n_terms = got["docs"], got["terms"]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, own, kind = TaskContext.get().partitionId() << 24, Shard(), None
        for batch in batches:
            kind = batch.column(0).type
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                if text.is_valid:
                    own.add(doc_id, text.as_py(), block)
                if own.size >= shard_terms or len(own.ids) >= shard_docs:
                    yield from own.rows(number, n_docs, n_terms, kind)
                    number, own = number + 1, Shard()
        if own.size:
            yield from own.rows(number, n_docs, n_terms, kind)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(index, f"{_SCHEMA}, doc_id {dict(docs.dtypes)[id_col]}")
    table = scratch.write(rows, "index", ("kind",))
    return Index(table.where("kind = 'list'").drop("kind", "doc_id", "number"), table.where("kind = 'doc'").select("shard", "number", "doc_id"), n_docs, n_terms)


class Postings:
    """A posting list that is decompressed block by block."""

    def __init__(self, n: int, docs: bytes, docs_kind: int, tfs: bytes, tfs_kind: int, lasts: np.ndarray, tops: np.ndarray, norms: np.ndarray):
        self.n, self.lasts, self.tops, self.norms, self.top = n, lasts, tops, norms, int(tops.max())
        self.gaps, self.tfs = np.frombuffer(docs, _WIDTHS[docs_kind]), np.frombuffer(tfs, _WIDTHS[tfs_kind])

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        """All documents and their impacts."""
        docs = np.cumsum(self.gaps, dtype=np.int64)
        return docs, impact(self.tfs.astype(np.int64), self.norms[docs])

    def some(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of some blocks, ascending."""
        at = blocks[:, None] * BLOCK + np.arange(BLOCK)
        inside = at < self.n
        gaps = np.where(inside, self.gaps[np.minimum(at, self.n - 1)], 0).astype(np.int64)
        before = np.where(blocks > 0, self.lasts[blocks - 1], 0)
        docs = (before[:, None] + np.cumsum(gaps, axis=1))[inside]
        return docs, impact(self.tfs[at[inside]].astype(np.int64), self.norms[docs])


def best(lists: list[tuple[Postings, int]], k: int, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents and scores of the k best of a shard, best first, lower numbers first among equals. score: zeros, one a document.

    Lists are taken by their bounds (weight times highest impact), the greatest first. While a document that is in none of the
    lists so far could still be among the best, a list is essential and read whole. The others add to candidates only: one
    whose score cannot reach the k-th best with its block's maximum and the bounds of what follows goes before the block is
    decompressed. A candidate that could equal the k-th best stays.
    """
    lists = sorted((x for x in lists if x[1] > 0), key=lambda x: -x[0].top * x[1])
    bounds = np.array([p.top * w for p, w in lists], np.int64)
    rest = np.append(np.cumsum(bounds[::-1])[::-1], 0)
    need, at = 0, 0
    found = np.empty(0, np.int64)
    while at < len(lists) and rest[at] >= need:
        docs, own = lists[at][0].whole()
        score[docs] += own * lists[at][1]
        at += 1
        found = np.flatnonzero(score)
        if len(found) >= k:
            need = max(need, int(np.partition(score[found], len(found) - k)[len(found) - k]))
    total = score[found]
    score[found] = 0
    for j in range(at, len(lists)):
        postings, w = lists[j]
        alive = total + rest[j] >= need
        found, total = found[alive], total[alive]
        block = np.searchsorted(postings.lasts, found)
        there = block < len(postings.lasts)
        limit = np.where(there, postings.tops[np.minimum(block, len(postings.lasts) - 1)] * w, 0)
        alive = total + limit + rest[j + 1] >= need
        found, total, block, there = found[alive], total[alive], block[alive], there[alive]
        if there.any():
            docs, own = postings.some(np.unique(block[there]))
            pos = np.minimum(np.searchsorted(docs, found), len(docs) - 1)
            hit = docs[pos] == found
            total[hit] += own[pos[hit]] * w
            if len(found) >= k:
                need = max(need, int(np.partition(total, len(total) - k)[len(total) - k]))
    order = np.lexsort((found, -total))[:k]
    order = order[total[order] > 0]
    return found[order], total[order]


def search(index: Index, queries: DataFrame, scratch: Scratch, *, k: int = 10, query_col: str = "item_id", text_col: str = "text", query_block: int = 512) -> DataFrame:
    """query, rank, doc_id, score: the k best documents of each row of queries with a score above 0, equal scores by doc_id.

    Queries are dealt to blocks of about `query_block`; a task searches one shard for one block of queries, so neither the
    index nor the queries are in one place. Lists meet the queries' terms in a join. Shards send their k best of a query;
    Spark merges them with a limit for each query before and after the shuffle.
    """
    spark = queries.sparkSession
    asked = scratch.write(queries.select(F.col(query_col).alias("query"), F.array_distinct(terms_of(F.col(text_col))).cast("array<binary>").alias("terms")).withColumn("row", F.monotonically_increasing_id()), "queries")
    blocks = max(1, -(-asked.count() // query_block))
    use = asked.select("row", F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block"), F.explode("terms").alias("term"))
    use = scratch.write(use.groupBy("term", "block").agg(F.sort_array(F.collect_list("row")).alias("asking")), "terms")
    used = index.lists.join(use.select("term").distinct(), "term", "left_semi")
    weight = F.floor(F.log(F.lit(2.0 * index.n_docs + 2) / (2 * F.sum("n") + 1)) * 1000.0).cast("long")
    weights = used.groupBy("term").agg(weight.alias("weight"))
    lists = index.lists.join(use.join(weights, "term"), "term")
    norms = index.lists.where(F.col("term") == F.lit(b"")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.lit(None).cast("array<long>").alias("asking"), F.lit(None).cast("long").alias("weight"))

    def find(table: pa.Table) -> pa.Table:
        at = {name: table.column(name).combine_chunks() for name in table.column_names}
        own = np.flatnonzero([t.as_py() == b"" for t in at["term"]])[0]
        norms = np.frombuffer(at["tfs"][own].as_py(), np.int64)
        asked: dict[int, list] = defaultdict(list)
        for i in range(table.num_rows):
            if i != own:
                get = {c: at[c][i].as_py() for c in ("n", "docs", "docs_kind", "tfs", "tfs_kind")}
                postings = Postings(**get, lasts=at["lasts"][i].values.to_numpy(), tops=at["tops"][i].values.to_numpy(), norms=norms)
                for row in at["asking"][i].values.to_pylist():
                    asked[row].append((postings, at["weight"][i].as_py()))
        score, out = np.zeros(len(norms), np.int64), []
        for row, lists in asked.items():
            docs, scores = best(lists, k, score)
            out.append((np.full(len(docs), row, np.int64), docs.astype(np.int32), scores))
        rows, docs, scores = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int64))
        return pa.table({"shard": pa.array(np.full(len(rows), table.column("shard")[0].as_py() if len(rows) else 0, np.int64)), "row": pa.array(rows), "number": pa.array(docs), "score": pa.array(scores)})

    columns = ["shard", "block", "term", "n", "docs", "docs_kind", "tfs", "tfs_kind", "lasts", "tops", "asking", "weight"]
    tasks = lists.select(columns).unionByName(norms.select(columns)).groupBy("shard", "block")
    heaps = scratch.write(tasks.applyInArrow(find, "shard long, row long, number int, score long"), "heaps")
    named = heaps.join(index.docs, ["shard", "number"]).select("row", "doc_id", "score")
    ranked = named.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))).where(F.col("rank") <= k)
    return ranked.join(asked.select("row", "query"), "row").select("query", "rank", "doc_id", "score")


def lexical_search(docs: DataFrame, queries: DataFrame, *, k: int = 10, id_col: str = "doc_id", text_col: str = "text", query_col: str = "item_id", query_text_col: str = "text", shard_terms: int = 4_000_000, query_block: int = 512) -> DataFrame:
    """query, rank, doc_id, score of the k best rows of docs for each row of queries: build_index, then search.

    Null and empty texts have no terms: such documents are in no result and don't count, such queries get no rows. Null ids
    come after others among equal scores; repeated rows are documents and queries of their own. Empty tables give no rows.
    Other columns aren't read.
    """
    scratch = Scratch(docs.sparkSession, "lexical_search")
    index = build_index(docs, scratch, id_col=id_col, text_col=text_col, shard_terms=shard_terms)
    return search(index, queries, scratch, k=k, query_col=query_col, text_col=query_text_col, query_block=query_block)
