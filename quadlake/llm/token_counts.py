"""Token counts of whole texts by a broadcast table of frequent pieces, with worker caches behind it."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import compress, repeat
from operator import is_, sub

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import content_key, held, slices

#: Three blanks, or two at the end, are where a cut before a blank could change what the pre-tokenizer sees.
_UNSAFE = re.compile(r"\s\s\s|\s\s\Z")
_UNIT = re.compile(r"\s*\S+|\s+")
_LONG = 64
_MARKS = ".,!?;:&$*%#"
_workers: dict = {}


def units(text: str) -> list[str]:
    """Cuts a text where a byte-level pre-tokenizer always cuts, so that the counts of the units add up to the text's.

    A unit is a word with the blank before it. Runs of three or more blanks, or two at the end, stay with what follows.
    """
    if _UNSAFE.search(text):
        return _UNIT.findall(text)
    first, *rest = text.split(" ")
    out = first.split("\n")
    out[1:] = ["\n" + x for x in out[1:]]
    for piece in rest:
        if "\n" in piece:
            a, *b = piece.split("\n")
            out.append(" " + a)
            out += ["\n" + x for x in b]
        else:
            out.append(" " + piece)
    return out


class Parts(dict):
    """A word's last character -> whether the library starts a new pre-token between it and a mark. It does after ASCII letters.
    Others are normalised first, and may then end in a combining mark, which stays with the mark that follows."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer = tokenizer

    def __missing__(self, last: str) -> bool:
        if last.isascii():
            known = last.isalpha()
        else:
            library = self.tokenizer
            normal = library.normalizer.normalize_str(last) if library.normalizer else last
            cuts = library.pre_tokenizer.pre_tokenize_str(normal + "?") if library.pre_tokenizer else []
            known = last.isalpha() and any(end == len(normal) for _, (_, end) in cuts)
        self[last] = known
        return known


class Pieces(dict):
    """piece -> what the tokenizer makes of it, in a worker. Starts from a table; other pieces are encoded once and kept.

    Two generations bound the memory: when the young one has `bound` pieces it becomes the old one, and pieces that are met
    again come back from there. Missing pieces are encoded together, with a special token between them, as the library
    treats what is left and right of one by itself.
    """

    def __init__(self, tokenizer, table: dict, bound: int):
        super().__init__(table)
        self.tokenizer, self.table, self.bound, self.old, self.parts = tokenizer, table, bound, {}, Parts(tokenizer)
        self.specials = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        self.between, self.mark = next(iter(self.specials.items()))

    def cut(self, ids, starts: list[int], ends: list[int]) -> list:
        """What is kept of the pieces ids[start:end], ids a numpy array."""
        raise NotImplementedError

    def plus(self, a, b):
        return a + b

    def base(self, piece: str) -> str:
        """A piece with the same ids."""
        return piece


    def encoded(self, pieces: list[str]) -> list:
        import numpy as np

        out = []
        for i in range(0, len(pieces), 20_000):
            block = pieces[i : i + 20_000]
            ids = np.array(self.tokenizer.encode_batch_fast([self.between.join(block)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.append(np.flatnonzero(ids == self.mark), len(ids))
            starts = np.concatenate([[0], ends[:-1] + 1])
            out += self.cut(ids, starts.tolist(), ends.tolist())
        return out

    def room(self, n: int) -> None:
        """The young generation becomes the old one where n more pieces would be too many."""
        if len(self) + n > self.bound + len(self.table):
            self.old = dict(self)
            self.clear()
            self.update(self.table)

    def learn(self, missing: list[str]) -> None:
        """Marks at the end of a word are pieces of their own for the tokenizer, so the word is looked up without them."""
        self.room(len(missing))
        old, parts, unknown = self.old, [], set()
        add, base_of, parts_at = unknown.add, self.base, self.parts
        for piece in missing:
            if (v := old.get(piece)) is not None:
                self[piece] = v
                continue
            base = base_of(piece)
            word = base.rstrip(_MARKS)
            if len(word) == len(base) or not word or not parts_at[word[-1]]:
                if base not in self:
                    add(base)
                if base != piece:
                    parts.append((piece, base, ""))
                continue
            tail = base[len(word) :]
            if word not in self:
                add(word)
            if tail not in self:
                add(tail)
            parts.append((piece, word, tail))
        fresh = []
        for x in unknown:
            if (v := old.get(x)) is not None:
                self[x] = v
            else:
                fresh.append(x)
        self.update(zip(fresh, self.encoded(fresh), strict=True))
        for piece, word, tail in parts:
            self[piece] = self.plus(self[word], self[tail]) if tail else self[word]

    def found(self, texts: list[str], split) -> Iterator[list]:
        """The values of each text's pieces, in order. A piece is looked up once; what is missing is encoded for some texts
        together. Long pieces aren't kept."""
        some, size = [], 0
        for k, text in enumerate(texts):
            some.append(split(text))
            size += len(text)
            if size > 500_000 or k == len(texts) - 1:
                yield from self.filled(some)
                some, size = [], 0

    def filled(self, some: list[list[str]]) -> list[list]:
        values = [list(map(self.get, pieces)) for pieces in some]
        gaps = [(p, v) for p, v in zip(some, values, strict=True) if None in v]
        missing = set()
        for p, v in gaps:
            missing.update(compress(p, map(is_, v, repeat(None))))
        extra = {}
        if long := [p for p in missing if len(p) > _LONG]:
            missing.difference_update(long)
            extra = dict(zip(long, self.encoded(long), strict=True))
        short = list(missing)
        for i in range(0, len(short), self.bound // 4):
            block = short[i : i + self.bound // 4]
            self.learn(block)
            extra.update((p, self[p]) for p in block)
        for p, v in gaps:
            v[:] = map(extra.get, p, v)
        return values


class Counted(Pieces):
    """unit -> number of tokens."""

    def cut(self, ids, starts: list[int], ends: list[int]) -> list[int]:
        return list(map(sub, ends, starts))

    def counts(self, texts: list[str]) -> list[int]:
        plain = [not any(s in t for s in self.specials) for t in texts]
        found = self.found([t for t, p in zip(texts, plain, strict=True) if p], units)
        return [sum(next(found)) if p else len(self.tokenizer.encode(t, add_special_tokens=False).ids) for t, p in zip(texts, plain, strict=True)]


def load(spec: str):
    """The tokenizer of a .json file's content. Each worker parses it once."""
    from tokenizers import Tokenizer

    if spec not in _workers:
        _workers.clear()
        _workers[spec] = Tokenizer.from_str(spec)
    return _workers[spec]


class Frequent(Counter):
    """Counts of units. When there are more than `bound` after a text, those that are 1/bound of all seen so far or less go, so
    fewer than `bound` stay. A count is then too low by what went; a unit that is much oftener all along never goes, one
    that comes in clusters may go several times. The table decides speed only, never a token count."""

    def __init__(self, bound: int):
        super().__init__()
        self.bound, self.seen = bound, 0

    def add(self, found: list[str]) -> None:
        self.update(found)
        self.seen += len(found)
        if len(self) > self.bound:
            least = self.seen // self.bound
            for unit in [u for u, n in self.items() if n <= least]:
                del self[unit]


def frequent_units(docs: DataFrame, text_col: str, spec: str, size: int) -> tuple[list[str], list[int]]:
    """The `size` most frequent units of all rows, and their numbers of tokens. A task sends those that are 1/size of its own
    units or more, so what is shuffled has at most `size` rows a task. Ties go by the unit."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Frequent(8 * size)
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                if text:
                    seen.add(units(text))
        own = [(u, n) for u, n in seen.items() if n * size >= seen.seen and len(u) <= _LONG]
        yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in own], pa.string()), pa.array([n for _, n in own], pa.int64())], names=["unit", "n"])

    found = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))
    counted = Counted(load(spec), {}, size)
    names = [r["unit"] for r in found.orderBy(F.desc("n"), "unit").limit(size).collect()]
    names = [u for u in names if not any(s in u for s in counted.specials)]
    return names, counted.encoded(names) if names else []


def token_counts(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, table_size: int = 65_536, cache_size: int = 600_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row, counted over the whole text, as the tokenizer file's library does.

    Two maps over the rows. The first finds the `table_size` most frequent units of all rows (see frequent_units), which are
    broadcast with their numbers of tokens and the tokenizer. The second adds up; a unit outside the table is encoded by the
    library and kept in the worker, at most `cache_size` of them. No rows and no units of a text are shuffled. tokenizer_path
    is a byte-level BPE file of the library `tokenizers`; its special strings inside texts are taken as the library does by
    default. Very long texts are cut into units as a whole, in one worker.
    Null and empty texts have 0 bytes and 0 tokens; a null id stays null; repeated rows each get a row; an empty table gives
    none; other columns are not read.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    names, lengths = frequent_units(docs, text_col, spec, table_size)
    shared = docs.sparkSession.sparkContext.broadcast((spec, names, lengths))
    key = ("token_counts", content_key(spec, names, lengths), cache_size)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spec, names, lengths = shared.value
        tokenizer = load(spec)
        counted = held(key, lambda: Counted(tokenizer, dict(zip(names, lengths, strict=True)), cache_size))
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            n = counted.counts([t or "" for t in texts])
            size = [len(t.encode()) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
