"""Near-duplicate classes by DartMinHash signatures, banded joins and an exact check."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, digest, held, slices

_MIX1, _MIX2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


class Words(dict):
    """word -> 64-bit hash, for at most `bound` words."""

    bound = 400_000

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 11)
        if len(self) < self.bound and len(word) <= 64:
            self[word] = h
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of a text's distinct word n-grams, and how often each stands there. A shorter text is one n-gram."""
    words = (text or "").split()
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    known = held("near_dedup", Words)
    if len(known) >= Words.bound:
        known.clear()
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(width, len(h))):
        out = mixed(out * _GOLD + h[i : i + n] + np.uint64(i + 1))
    return np.unique(out, return_counts=True)


def dart_minhash(keys: np.ndarray, weights: np.ndarray, coordinates: int) -> np.ndarray:
    """The weighted MinHash of a set: equal coordinates of two sets have the expected share sum(min) / sum(max) of weights.

    An element with weight w is w unit regions. Darts hit a region at the times of a Poisson process of rate 1 that its hash
    fixes, and each hits a hashed coordinate. All darts up to a time are thrown, about k ln k + 2 k in all however large the
    set is; a coordinate keeps its earliest. If one got none, the time is doubled.
    """
    layers = np.arange(int(weights.sum()), dtype=np.uint64) - np.repeat(np.cumsum(weights) - weights, weights).astype(np.uint64)
    regions = mixed(np.repeat(keys, weights) + layers * _MIX1)
    limit = coordinates * (np.log(coordinates) + 2) / len(regions)
    while True:
        best, name = np.full(coordinates, np.inf), np.zeros(coordinates, np.uint64)
        own, time, thrown = regions, np.zeros(len(regions)), 0
        ats, times, names = [], [], []
        while len(own):
            width = 1 if limit < 0.5 and not thrown else max(2, int(limit * 1.5) + 2)
            darts = mixed(own[:, None] + np.arange(thrown + 1, thrown + width + 1, dtype=np.uint64) * _GOLD)
            at = time[:, None] + np.cumsum(-np.log(((darts >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53), axis=1)
            hit = at < limit
            names.append(mixed(darts[hit]))
            times.append(at[hit])
            more = hit[:, -1]
            own, time, thrown = own[more], at[more, -1], thrown + width
        names, times = np.concatenate(names), np.concatenate(times)
        ats = (names % np.uint64(coordinates)).astype(np.int64)
        np.minimum.at(best, ats, times)
        if np.isfinite(best).all():
            first = times == best[ats]
            name[ats[first]] = names[first]
            return name
        limit *= 2


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """A hash for each band of coordinates, other for other bands."""
    rows = signature.reshape(bands, -1)
    out = np.arange(1, bands + 1, dtype=np.uint64) * _GOLD
    for i in range(rows.shape[1]):
        out = mixed(out * _MIX2 + rows[:, i])
    return out


def signed(docs: DataFrame, id_col: str, text_col: str, width: int, bands: int, rows: int, weighted: bool) -> DataFrame:
    """doc_id, h1, h2, bands and set (sorted distinct 32-bit shingle hashes) for every row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys, sets = [], []
            for text in batch.column(3).to_pylist():
                own, counts = shingles(text, width)
                keys.append(band_keys(dart_minhash(own, counts if weighted else np.ones_like(counts), bands * rows), bands).view(np.int64) if len(own) else None)
                sets.append(np.unique((own >> np.uint64(32)).astype("<u4")).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(keys, pa.list_(pa.int64())), pa.array(sets, pa.binary())], names=["doc_id", "h1", "h2", "bands", "set"])

    kind = dict(docs.dtypes)[id_col]
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), *digest(text), text.alias("text")).mapInArrow(sign, f"doc_id {kind}, h1 long, h2 long, bands array<long>, set binary")


def candidate_pairs(nodes: DataFrame, scratch: Scratch, small: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b), a < b, that share a band, and (key, node, n) of the buckets of more than `small`. Buckets of up to `small`
    give all their pairs; in larger ones each member is paired with two leaders: the member that shares most buckets with others
    (the text that the others are copies of) and one chosen by a hash. That is only a first round: `merged` does the rest."""
    rows = nodes.select("node", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = scratch.write(rows.join(shared, "key"), "members")
    degree = members.groupBy("node").agg(F.sum("n").alias("degree"))
    few = members.where(F.col("n") <= small).select("key", "node")
    pairs = few.join(few.withColumnRenamed("node", "other"), "key").where("node < other").select(F.col("node").alias("a"), F.col("other").alias("b"))
    many = members.where(F.col("n") > small).join(degree, "node")
    leaders = many.groupBy("key").agg(F.max_by("node", F.struct("degree", -F.col("node"))).alias("l1"), F.min_by("node", F.xxhash64("node", "key")).alias("l2"))
    led = many.select("key", "node").join(leaders, "key").select("node", F.explode(F.array("l1", "l2")).alias("leader")).where("node <> leader")
    led = led.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b"))
    return scratch.write(pairs.unionByName(led).distinct(), "pairs"), members.where(F.col("n") > small)


def checked(pairs: DataFrame, sets: DataFrame, scratch: Scratch, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The pairs whose sets have at least the similarity, by the sets themselves, and the sets of all nodes in pairs."""
    used = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = scratch.write(sets.join(used.hint("merge"), "node", "left_semi"), "sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b").select("a", "b", "sa", "sb")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), "<u4"), np.frombuffer(y.as_buffer(), "<u4")
                if min(len(x), len(y)) < similarity * max(len(x), len(y)):
                    good.append(False)
                    continue
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                good.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return scratch.write(both.mapInArrow(check, "a long, b long"), "links"), sets


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label), label the smallest node of its component, for all nodes with links.

    Each round a node takes the smallest label around it, then its label's label; rounds go on until nothing changes. Every
    step is an aggregation or an equi-join, written to the shared folder.
    """
    edges = scratch.write(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = scratch.write(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels0")
    k = 0
    while True:
        around = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        near = labels.join(around, "node").select("node", "label", F.least("label", "near").alias("near"))
        up = labels.select(F.col("node").alias("near"), F.col("label").alias("up"))
        new = scratch.write(near.join(up, "near").select("node", F.least("near", "up").alias("label"), (F.least("near", "up") != F.col("label")).alias("moved")), f"labels{k + 1}")
        moved = new.where("moved").limit(1).count()
        scratch.drop(f"labels{k}")
        labels, k = new.select("node", "label"), k + 1
        if not moved:
            return labels


def spans(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... n[0] of them, then those of start[1] and so on."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


def overlaps(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """How many values each set of xs shares with each of ys. Values in many of the sets are counted by a matrix product, the
    others by listing the pairs that share them."""
    out = np.zeros(len(xs) * len(ys), np.int64)
    sides = []
    for sets in (xs, ys):
        values, owners = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(values, kind="stable")
        sides.append((values[order], owners[order]))
    (vx, rx), (vy, ry) = sides
    values, sx, nx = np.unique(vx, return_index=True, return_counts=True)
    sy = np.searchsorted(vy, values)
    ny = np.searchsorted(vy, values, "right") - sy
    often = nx * ny * 64 >= len(out)
    common, rare = np.flatnonzero(often & (ny > 0)), np.flatnonzero(~often & (ny > 0))
    for k in range(0, len(common), 2048):
        own = common[k : k + 2048]
        a, b = np.zeros((len(xs), len(own)), np.float32), np.zeros((len(ys), len(own)), np.float32)
        a[rx[spans(sx[own], nx[own])], np.repeat(np.arange(len(own)), nx[own])] = 1
        b[ry[spans(sy[own], ny[own])], np.repeat(np.arange(len(own)), ny[own])] = 1
        out += (a @ b.T).astype(np.int64).ravel()
    turn = np.cumsum(nx[rare] * ny[rare]) // 1_000_000
    for own in np.split(rare, np.flatnonzero(np.diff(turn)) + 1) if len(rare) else []:
        x, n = rx[spans(sx[own], nx[own])], np.repeat(ny[own], nx[own])
        out += np.bincount(np.repeat(x, n) * len(ys) + ry[spans(np.repeat(sy[own], nx[own]), n)], minlength=len(out))
    return out.reshape(len(xs), len(ys))


def merging_links(xs: tuple[np.ndarray, list[np.ndarray]], ys: tuple[np.ndarray, list[np.ndarray]] | None, similarity: float) -> list[tuple[int, int]]:
    """Compares each set of xs with each of ys (None: with the others of xs) that has another label. Gives (label, label) of
    links, without those that join what earlier ones have joined."""
    top: dict = {}

    def find(x: int) -> int:
        while (up := top.setdefault(x, x)) != x:
            top[x] = x = top[up]
        return x

    def chunks(labels: np.ndarray, sets: list[np.ndarray], rows: int) -> list[tuple]:
        n = np.array([len(s) for s in sets], np.int64)
        order = np.argsort(n, kind="stable")
        return [(labels[at], [sets[i] for i in at], n[at]) for at in (order[k : k + rows] for k in range(0, len(order), rows))]

    out = []
    for la, a, na in chunks(*xs, 128):
        for lb, b, nb in chunks(*(ys or xs), 512):
            if na[-1] < similarity * nb[0] - 1e-9 or nb[-1] < similarity * na[0] - 1e-9 or (la[0] == lb[0] and (la == la[0]).all() and (lb == lb[0]).all()):
                continue
            both = overlaps(a, b)
            good = (both >= similarity * (na[:, None] + nb[None, :] - both) - 1e-9) & (la[:, None] != lb[None, :])
            i, j = np.nonzero(good)
            for x, y in np.unique(np.stack([la[i], lb[j]], axis=1), axis=0).tolist():
                if (p := find(x)) != (q := find(y)):
                    top[max(p, q)] = min(p, q)
                    out.append((x, y))
    return out


def merged(members: DataFrame, labels: DataFrame, sets: DataFrame, scratch: Scratch, similarity: float, block_bytes: int = 4 << 20, block_rows: int = 2048) -> DataFrame:
    """(node, label) after all pairs of a bucket's members that have different labels have been compared. members: (key, node).

    A bucket's members are dealt to blocks by a hash, those of its largest class (main) to other blocks than the rest; a task
    compares two blocks of one bucket, and blocks of main aren't compared with each other. Blocks are bounded, so a large
    bucket is spread over many tasks. Only links that merge classes leave a task.
    """
    own = members.select("key", "node").join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    classes = own.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    split = classes.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.max_by("label", F.struct("n", "label")).alias("main")).where("k > 1").select("key", "main")
    sizes = sets.select("node", F.length("set").alias("bytes"))
    left = scratch.write(own.join(split, "key").select("key", "node", "label", (F.col("label") == F.col("main")).alias("main")).join(sizes, "node"), "left")
    if left.limit(1).count() == 0:
        return labels

    def blocks(main: bool) -> Column:
        mine = F.when(F.col("main") == main, F.col("bytes"))
        return F.ceil(F.greatest(F.sum(mine) / block_bytes, F.count(mine) / block_rows))

    counts = left.groupBy("key").agg(blocks(False).alias("q"), blocks(True).alias("p"))
    dealt = left.join(counts, "key").withColumn("own", F.when(F.col("main"), F.col("q") + F.pmod(F.xxhash64("node"), "p")).otherwise(F.pmod(F.xxhash64("node"), "q")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("main"), F.col("q") - 1).otherwise(F.col("q") + F.col("p") - 1))))
    tasks = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "label", "node").join(sets, "node").drop("node")

    def compare(table: pa.Table) -> pa.Table:
        at, labels = table.column("own").to_numpy(), table.column("label").to_numpy()
        sets = [np.frombuffer(x.as_buffer(), "<u4") for x in table.column("set")]
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        x, y = (((rows := np.flatnonzero(at == k)), (labels[rows], [sets[r] for r in rows]))[1] for k in (i, j))
        out = merging_links(x, y if i != j else None, similarity)
        return pa.table({"a": pa.array([min(o) for o in out], pa.int64()), "b": pa.array([max(o) for o in out], pa.int64())})

    found = scratch.write(tasks.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long").distinct(), "merging")
    if found.limit(1).count() == 0:
        return labels
    up = components(found, Scratch(scratch.spark, "near_dedup_merged")).select(F.col("node").alias("low"), F.col("label").alias("up"))
    moved = labels.join(up, F.col("label") == F.col("low"), "left").select("node", F.coalesce("up", "label").alias("label"))
    alone = up.select(F.col("low").alias("node"), F.col("up").alias("label")).join(labels, "node", "left_anti")
    return scratch.write(moved.unionByName(alone), "merged")


def near_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, bands: int = 24, rows: int = 5, small: int = 8, weighted: bool = False) -> DataFrame:
    """doc_id, class_id, class_size, kept, h1, h2 for every row. A class is a connected component of texts whose sets of
    `width`-word shingles have a Jaccard similarity of at least `similarity`; class_id is its smallest id, whose row is kept.

    Equal texts are one node, so copies cost nothing after the signatures. A text is read once: its signature's bands and its
    shingle set (32 bits each) are written; the band join reads only bands, the check only the sets of candidates. All pairs
    that share a band are compared, but for those that other links have put into one class already. With 24
    bands of 5 a pair at 0.8 shares no band once in 14,000. `weighted` counts repeated shingles in the signatures.
    Null counts as empty; texts without words are like their equals only; texts under `width` words are one shingle. Null
    ids are above all others. Of repeated rows one is kept. An empty table gives no rows. Other columns aren't read.
    """
    scratch = Scratch(docs.sparkSession, "near_dedup")
    raw = scratch.write(signed(docs, id_col, text_col, width, bands, rows, weighted).withColumn("row", F.monotonically_increasing_id()), "signed")
    ids = raw.select("row", "doc_id", "h1", "h2")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    texts = scratch.write(ids.groupBy("h1", "h2").agg(F.min("row").alias("node"), first.alias("first"), F.count(F.lit(1)).alias("n")), "texts")
    nodes = scratch.write(raw.select(F.col("row").alias("node"), "bands").where("bands is not null").join(texts.select("node").hint("merge"), "node", "left_semi"), "nodes")
    pairs, members = candidate_pairs(nodes, scratch, small)
    links, sets = checked(pairs, raw.select(F.col("row").alias("node"), "set"), scratch, similarity)
    labels = merged(members, components(links, scratch), sets, scratch, similarity)
    named = scratch.write(texts.join(labels, "node", "left").select("h1", "h2", F.coalesce("label", "node").alias("label"), "first", "n"), "named")
    classes = named.groupBy("label").agg(F.min("first").alias("best"), F.sum("n").alias("class_size"))
    of_text = named.join(classes, "label").select(F.col("h1").alias("_1"), F.col("h2").alias("_2"), "best", "class_size")
    out = ids.join(scratch.write(of_text, "of_text").hint("merge"), (F.col("h1") == F.col("_1")) & (F.col("h2") == F.col("_2")))
    return out.select("doc_id", F.col("best.doc_id").alias("class_id"), "class_size", (F.col("best.row") == F.col("row")).alias("kept"), "h1", "h2")
