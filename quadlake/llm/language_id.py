"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import content_key, held

UNKNOWN = "und"
_MARKS = ".,!?;:*$%&#|()"

#: Words of more characters aren't cached; those of more than _BLOCK are counted by numpy, a block at a time.
_LONG, _BLOCK = 64, 4096


def subwords(word: str, buckets: int) -> list[int]:
    """Buckets of a lower-case word's letters: the word and its 2- and 3-grams with its ends marked."""
    letters = "".join(filter(str.isalpha, word))
    if not letters:
        return []
    marked = f"<{letters}>"
    grams = [marked, *(marked[i : i + n] for n in (2, 3) for i in range(len(marked) - n + 1))]
    return [zlib.crc32(g.encode("utf-8", "surrogatepass")) % buckets for g in grams]


def subword_counts(word: str, buckets: int, block: int = 1 << 20) -> np.ndarray:
    """How often `subwords` of a word has each bucket, for words of any length: a block of it is held at a time."""
    out = np.zeros(buckets, np.int64)
    tail, crc, some = "<", zlib.crc32(b"<"), False
    for i in range(0, len(word), block):
        piece = "".join(filter(str.isalpha, word[i : i + block]))
        some = some or bool(piece)
        if i + block >= len(word):
            piece += ">"
        crc = zlib.crc32(piece.encode("utf-8"), crc)
        codes = np.frombuffer((tail + piece).encode("utf-32-le"), "<u4").astype(np.int64)
        for n in (2, 3):
            own = codes[max(0, len(tail) - n + 1) :]  # grams that end in this piece
            if len(own) < n:
                continue
            grams = own[: len(own) - n + 1]
            for k in range(1, n):
                grams = grams << 21 | own[k : len(own) - n + 1 + k]
            distinct, counts = np.unique(grams, return_counts=True)
            ids = [zlib.crc32("".join(chr(g >> 21 * k & 0x1FFFFF) for k in range(n - 1, -1, -1)).encode("utf-8")) % buckets for g in distinct.tolist()]
            np.add.at(out, ids, counts)
        tail = (tail + piece)[-2:]
    if not some:
        return np.zeros(buckets, np.int64)
    out[crc % buckets] += 1
    return out


def bag_of(text: str | None, buckets: int) -> np.ndarray:
    """The buckets of all subwords of a text, ascending, and how often each is there, a row for both. At most `buckets` columns."""
    counts = np.zeros(buckets, np.int64)
    for word, n in Counter((text or "").lower().split()).items():
        if len(word) <= _BLOCK:
            np.add.at(counts, np.array(subwords(word, buckets), np.int64), n)
        else:
            counts += n * subword_counts(word, buckets)
    some = np.flatnonzero(counts)
    return np.stack([some, counts[some]]).astype("<u4")


@dataclass
class Model:
    """table: a subword's logits, that is its embedding times the softmax weights; bias; temperature; least score accepted."""

    labels: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def scores(self, sums: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Probabilities from summed logits and numbers of subwords."""
        z = (sums / np.maximum(n, 1)[:, None] + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def train(bags: list[np.ndarray], y: np.ndarray, labels: list[str], buckets: int, dim: int = 16, epochs: int = 12, rate: float = 0.6, drawn: int = 256, seed: int = 5) -> Model:
    """Stochastic gradient descent in numpy. bags: see bag_of. A step draws `drawn` subwords of each of 32 texts."""
    ends = [b[1].cumsum(dtype=np.int64) for b in bags]
    rng = np.random.default_rng(seed)
    e = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    w, b = np.zeros((dim, len(labels)), np.float32), np.zeros(len(labels), np.float32)
    steps = max(1, epochs * len(bags) // 32)
    order = np.empty(0, np.int64)
    for step in range(steps):
        if len(order) < 32:
            order = np.concatenate([order, rng.permutation(len(bags))])
        own, order = order[:32], order[32:]
        ids = np.stack([bags[i][0][np.searchsorted(ends[i], rng.integers(ends[i][-1], size=drawn), side="right")] for i in own])
        h = e[ids].mean(axis=1)
        z = h @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(own)), y[own]] -= 1
        lr = rate * (1 - step / steps)
        back = (p @ w.T) * (lr / drawn * 4)
        w -= lr * h.T @ p / 4
        b -= lr * p.mean(axis=0)
        np.subtract.at(e, ids.ravel(), np.repeat(back, drawn, axis=0))
    return Model(labels, (e @ w).astype(np.float32), b)


def calibrate(model: Model, bags: list[np.ndarray], y: np.ndarray, precision: float) -> None:
    """On texts that weren't trained on: the temperature with the least log loss, then the least score from which accepted
    texts are right in `precision` of the cases, and at least halfway from chance to the lowest scores (0.1 %) of right ones."""
    if not bags:
        return
    sums = np.stack([n @ model.table[x].astype(np.float64) for x, n in bags])
    n = np.array([b[1].sum() for b in bags])
    losses = []
    for t in np.geomspace(0.05, 20, 60):
        model.temperature = t
        losses.append((-np.log(np.maximum(model.scores(sums, n)[np.arange(len(y)), y], 1e-12)).mean(), t))
    model.temperature = min(losses)[1]
    p = model.scores(sums, n)
    best, right = p.max(axis=1), p.argmax(axis=1) == y
    order = np.argsort(-best)
    good = np.cumsum(right[order]) >= precision * np.arange(1, len(y) + 1)
    cut = best[order][np.flatnonzero(good).max()] if good.any() else 1.0
    all_good = good[-1]
    chance = 1 / len(model.labels)
    floor = (chance + np.quantile(best[right], 0.001)) / 2 if right.any() else chance
    model.threshold = float(floor if all_good else max(floor, cut))


def sample_bags(docs: DataFrame, id_col: str, text_col: str, lang_col: str, rows: int, buckets: int, seed: int) -> tuple[list[np.ndarray], list[str]]:
    """Bags (see bag_of) and languages of about `rows` labelled rows, as many of each language, chosen by a hash of the id. A bag has
    at most `buckets` pairs, however long its text is, so what the driver gets is bounded."""
    counts = {r["l"]: r["n"] for r in docs.groupBy(F.col(lang_col).alias("l")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return [], []
    each = rows / len(counts)
    rate = F.lit(0.0)
    for lang, n in sorted(counts.items()):
        rate = F.when(F.col(lang_col) == lang, min(1.0, each / n)).otherwise(rate)
    at = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1_000_003))
    chosen = docs.where(at < rate * 1_000_003).select(at.alias("at"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [bag_of(t, buckets).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["at", "lang", "bag"])

    got = chosen.mapInArrow(gather, "at long, lang string, bag binary").where(F.length("bag") > 0).collect()
    got.sort(key=lambda r: (r["at"], r["lang"], r["bag"]))
    return [np.frombuffer(r["bag"], "<u4").reshape(2, -1) for r in got], [r["lang"] for r in got]


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = 1500, buckets: int = 32_768, precision: float = 0.99, seed: int = 5) -> Model:
    """Trains on about `rows` of the labelled rows of docs, a fifth of them kept for calibration. The bound is `rows`: what the
    driver gets is their hashed subwords. Rows without language or letters aren't used."""
    bags, langs = sample_bags(docs.where(F.col(lang_col).isNotNull()), id_col, text_col, lang_col, rows, buckets, seed)
    labels = sorted(set(langs))
    if not labels:
        return Model([UNKNOWN], np.zeros((buckets, 1), np.float32), np.zeros(1, np.float32))
    y = np.array([labels.index(x) for x in langs])
    kept = np.arange(len(y)) % 5 == 4
    model = train([b for b, k in zip(bags, kept, strict=True) if not k], y[~kept], labels, buckets, seed=seed)
    calibrate(model, [b for b, k in zip(bags, kept, strict=True) if k], y[kept], precision)
    return model


class Words(dict):
    """word -> row of summed logits and number of subwords. Keeps at most `bound` words. What isn't kept (long words, and others
    when it is full) is added to `extra` and has the last row, of zeros."""

    def __init__(self, model: Model, bound: int):
        super().__init__()
        self.model, self.bound, self.used = model, bound, 0
        self.rows = np.zeros((bound + 1, len(model.labels) + 1), np.float64)
        self.extra = np.zeros(self.rows.shape[1])

    def __missing__(self, word: str) -> int:
        bare = word.strip(_MARKS)
        if bare != word and bare:
            k = self[bare]
            if k < self.bound and len(self) < self.bound and len(word) <= _LONG:
                self[word] = k
            return k
        buckets = len(self.model.table)
        if len(word) > _BLOCK:
            counts = subword_counts(word, buckets)
            self.extra[:-1] += counts @ self.model.table.astype(np.float64)
            self.extra[-1] += counts.sum()
            return self.bound
        ids = subwords(word, buckets)
        sums = self.model.table[ids].sum(axis=0) if ids else 0
        if len(word) > _LONG or len(self) >= self.bound:
            self.extra[:-1] += sums
            self.extra[-1] += len(ids)
            return self.bound
        k = self[word] = self.used
        self.used += 1
        self.rows[k, :-1], self.rows[k, -1] = sums, len(ids)
        return k

    def sums(self, text: str) -> np.ndarray:
        total = np.zeros(self.rows.shape[1])
        self.extra[:] = 0
        words = text.lower().split()
        for i in range(0, len(words), 50_000):
            block = words[i : i + 50_000]
            if len(self) + len(block) > self.bound:
                self.clear()
                self.used = 0
            total += self.rows[np.fromiter(map(self.__getitem__, block), np.int64, len(block))].sum(axis=0)
        return total + self.extra


def language_id(docs: DataFrame, model: Model, *, text_col: str = "text", cache_size: int = 400_000) -> Column:
    """A column (lang_pred string, score double, rejected boolean) for the whole text of each row of docs.

    One map, no shuffle. The model is broadcast: buckets times languages numbers, which don't grow with the data. Null texts
    and texts without letters are `und` with score 0 and rejected, as are scores under the model's threshold (then lang_pred
    is still the best guess).
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key = ("language_id", content_key(model.labels, model.table.tobytes(), model.bias.tobytes(), model.temperature), cache_size)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        words = held(key, lambda: Words(model, cache_size))
        for texts in batches:
            sums = np.array([words.sums(t) if t else np.zeros(words.rows.shape[1]) for t in texts]).reshape(-1, words.rows.shape[1])
            n = sums[:, -1]
            p = model.scores(sums[:, :-1], n)
            best = p.max(axis=1) if len(p) else np.zeros(0)
            some = n > 0
            yield pd.DataFrame({
                "lang_pred": np.where(some, np.array(model.labels, dtype=object)[p.argmax(axis=1)], UNKNOWN),
                "score": np.where(some, best, 0.0),
                "rejected": ~some | (best < model.threshold),
            })

    return predict(F.col(text_col))
