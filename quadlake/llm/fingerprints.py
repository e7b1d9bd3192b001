"""Document fingerprints: invertible Bloom lookup tables of paragraph digests."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import digest, held, n_partitions

CELLS = 24
_SHIFTS = np.array([0, 21, 42], np.uint64)
_CHECK = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xD6E8FEB86659FD93)
_LOW = np.iinfo(np.int64).min
_RANGES, _LONG = 16_384, 64


class Words(dict):
    """word -> 64-bit hash, for at most `bound` words."""

    bound = 400_000

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 7)
        if len(self) < self.bound and len(word) <= 64:
            self[word] = h
        return h


def parted(word: str) -> list[str]:
    """A run without blanks of more than _LONG characters as parts of 16 on average, cut after characters chosen by a hash of the
    four that end there, so that scripts without blanks and tables with tabs have words too."""
    codes = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    h = codes[3:] * _ODD + codes[2:-1] * _CHECK + codes[1:-2] * (_ODD ^ _CHECK) + codes[:-3]
    ends = np.flatnonzero(((h ^ (h >> np.uint64(32))) * _CHECK) >> np.uint64(60) == 0) + 4
    return [word[a:b] for a, b in zip([0, *ends.tolist()], [*ends.tolist(), len(word)], strict=True) if a < b]


def paragraphs(text: str) -> np.ndarray:
    """64-bit digests of a text's paragraphs, distinct: the k-th copy of a paragraph has a digest of its own.

    A paragraph is a line, or a part of a line: after one word in four, chosen by its hash, a new one begins, so texts
    without line ends have paragraphs too and an edit changes only those that it touches.
    """
    if not text:
        return np.empty(0, np.uint64)
    known = held("fingerprints", Words)
    if len(known) >= Words.bound:
        known.clear()
    words = text.replace("\n", " \n ").split(" ")
    if len(max(words, key=len)) > _LONG:
        words = [x for w in words for x in (parted(w) if len(w) > _LONG else [w])]
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    ends = (h & np.uint64(3)) == 0
    ends |= h == np.uint64(known["\n"])
    ends[-1] = True
    starts = np.flatnonzero(np.concatenate([[True], ends[:-1]]))
    at = np.arange(len(h)) - np.repeat(starts, np.diff(np.append(starts, len(h))))
    keys = np.add.reduceat((h ^ (h >> np.uint64(29))) * (_ODD * (2 * at + 1).astype(np.uint64)), starts)
    keys ^= keys >> np.uint64(31)
    keys *= _CHECK
    keys ^= keys >> np.uint64(29)
    order = np.argsort(keys, kind="stable")
    own = keys[order]
    first = np.concatenate([[True], own[1:] != own[:-1]])
    if not first.all():
        nth = np.arange(len(own)) - np.maximum.accumulate(np.where(first, np.arange(len(own)), 0))
        own = own + nth.astype(np.uint64) * _ODD
        own ^= np.where(nth > 0, own >> np.uint64(31), np.uint64(0))
        own = np.unique(own)
    return own


class Sketch:
    """An invertible Bloom lookup table: a key is in one cell of each third. A cell has the number, the xor of keys, and the xor
    of their checks."""

    def __init__(self, keys: np.ndarray, cells: int):
        self.third, self.n = cells // 3, len(keys)
        idx = self.cells(keys)
        self.count = np.bincount(idx, minlength=cells)
        self.keys, self.checks = np.zeros(cells, np.uint64), np.zeros(cells, np.uint64)
        each = np.repeat(keys, 3)
        np.bitwise_xor.at(self.keys, idx, each)
        np.bitwise_xor.at(self.checks, idx, self.check(each))

    def cells(self, keys: np.ndarray) -> np.ndarray:
        return (((keys[:, None] >> _SHIFTS) & np.uint64(0x1FFFFF)) % np.uint64(self.third) + np.arange(3, dtype=np.uint64) * np.uint64(self.third)).astype(np.int64).ravel()

    @staticmethod
    def check(keys: np.ndarray) -> np.ndarray:
        return (keys * _CHECK) >> np.uint64(48)

    def encode(self) -> str:
        """Number of keys, then number (16 bits), keys and check (16 bits) of each cell."""
        parts = (np.array([self.n], "<u4"), self.count.astype("<i2"), self.keys.astype("<u8"), self.checks.astype("<u2"))
        return base64.b64encode(b"".join(p.tobytes() for p in parts)).decode()

    def minus(self, other: Sketch) -> tuple[np.ndarray, np.ndarray] | None:
        """The keys only here and the keys only there, peeled from the difference of the cells; None if it can't be peeled."""
        count, keys, checks = self.count - other.count, self.keys ^ other.keys, self.checks ^ other.checks
        mine, theirs = [], []
        for _ in range(len(count) + 1):
            pure = np.flatnonzero((np.abs(count) == 1) & (self.check(keys) == checks))
            if not len(pure):
                break
            found, at = np.unique(keys[pure], return_index=True)
            signs = count[pure][at]
            mine.append(found[signs > 0])
            theirs.append(found[signs < 0])
            idx, each = self.cells(found), np.repeat(found, 3)
            count = count - np.bincount(idx, weights=np.repeat(signs, 3), minlength=len(count)).astype(np.int64)
            np.bitwise_xor.at(keys, idx, each)
            np.bitwise_xor.at(checks, idx, self.check(each))
        if count.any() or keys.any() or checks.any():
            return None
        empty = [np.empty(0, np.uint64)]
        return np.concatenate(mine or empty), np.concatenate(theirs or empty)


def difference(a: np.ndarray, b: np.ndarray, first: tuple[Sketch, Sketch] | None = None) -> int:
    """How many paragraphs differ. Starts with the fingerprints. If they can't be peeled, both are sketched again with one and
    a half cells for each paragraph, enough for texts with nothing in common, and then with twice as many each time."""
    cells, pair = CELLS, first or (Sketch(a, CELLS), Sketch(b, CELLS))
    while True:
        if abs(len(a) - len(b)) <= cells and (got := pair[0].minus(pair[1])) is not None:
            return len(got[0]) + len(got[1])
        if cells > 64 * (len(a) + len(b) + 16):  # two keys with the same three cells and checks: never seen, but it must end
            return len(np.setxor1d(a, b))
        cells = max(2 * cells, 3 * (CELLS + (len(a) + len(b)) // 2)) if cells == CELLS else 2 * cells
        pair = Sketch(a, cells), Sketch(b, cells)


def likeness(a: np.ndarray, b: np.ndarray, first: tuple[Sketch, Sketch] | None = None) -> float:
    """Paragraphs that both have over paragraphs that either has; 1 if neither has any."""
    total = len(a) + len(b)
    if not total:
        return 1.0
    d = difference(a, b, first)
    return (total - d) / (total + d)


def successive(docs: DataFrame, id_col: str, text_col: str, range_rows: int) -> DataFrame:
    """Rows (range, tail, doc_id, text), one range to a task, by descending id; a range ends with tails, copies of the row that
    follows its last, the first row of all after the last range. Only bounds and largest ids of ranges (at most _RANGES) reach
    the driver, and only these are broadcast; a range is sorted on disk and streamed, so it may have any size."""
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(int(_LOW)))
    rows = docs.select(F.col(id_col).alias("doc_id"), key.alias("key"), F.col(text_col).alias("text"))
    parts = min(_RANGES, max(n_partitions(docs.sparkSession), rows.count() // range_rows))
    cuts = rows.agg(F.percentile_approx("key", [i / parts for i in range(1, parts)] or [0.5], 50 * parts)).first()[0] or []
    bounds = np.array(sorted(set(cuts)), np.int64)

    @F.pandas_udf("int")
    def range_of(key: pd.Series) -> pd.Series:
        return pd.Series((len(bounds) - np.searchsorted(bounds, key.to_numpy(), side="left")).astype(np.int32))

    firsts = sorted((r["r"], r["k"]) for r in rows.select("key").withColumn("r", range_of("key")).groupBy("r").agg(F.max("key").alias("k")).collect())
    keyed = rows.withColumn("range", range_of("key")).withColumn("tail", F.lit(False))
    before = docs.sparkSession.createDataFrame([(k, firsts[i - 1][0]) for i, (_, k) in enumerate(firsts)], "head long, range int")
    heads = rows.join(F.broadcast(before), F.col("key") == F.col("head")).drop("head").withColumn("tail", F.lit(True))
    return keyed.unionByName(heads).repartitionById(len(bounds) + 1, "range").sortWithinPartitions("range", "tail", F.desc("key"), digest(F.col("text"))[0], digest(F.col("text"))[1])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", range_rows: int = 20_000) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and n_paragraphs for every row.

    The fingerprint of a text is a sketch with 24 cells of its paragraphs' digests. The edited text has the last third (down)
    of its code points replaced by the first as many, or all, of the next document in descending order of the (numeric) id;
    the first follows the last. Likeness is computed by subtracting sketches and peeling; a pair with too many differences
    is sketched again with more cells. Null text is empty; an empty text is like itself (1). Null ids are below all others;
    rows with the same id follow each other by the text's hash. An empty table gives no rows. Other columns aren't read.

    The text is shuffled once, into ranges of ids of about `range_rows` rows with one row more each, so that a task has every
    row's successor; it streams through them.
    """
    sorted_rows = successive(docs, id_col, text_col, range_rows).select("range", "tail", "doc_id", "text")

    def one(doc, text: str, follower: str, own: np.ndarray, next_own: np.ndarray) -> tuple:
        n = len(text)
        k = n // 3
        edited = text[: n - k] + follower[:k]
        e = paragraphs(edited) if k else own
        a, b, c = Sketch(own, CELLS), Sketch(e, CELLS), Sketch(next_own, CELLS)
        sha = hashlib.sha256(edited.encode()).hexdigest()
        return doc, n, sha, a.encode(), b.encode(), likeness(own, e, (a, b)), likeness(own, next_own, (a, c)), len(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            out: list = []
            for rng, tail, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = text or ""
                if last is None and tail:
                    continue
                own = paragraphs(text)
                if last is not None:
                    assert last[0] == rng
                    out.append(one(last[1], last[2], text, last[3], own))
                last = None if tail else (rng, doc, text, own)
            cols = list(zip(*out, strict=True)) if out else [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    kind = dict(docs.dtypes)[id_col]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_paragraphs"]
    types = [{"bigint": pa.int64(), "int": pa.int32()}[kind], pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
    return sorted_rows.mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_paragraphs long")
