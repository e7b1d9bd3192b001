"""Packing documents into fixed-length sequences by shortest-pack-first over the length histogram."""

from __future__ import annotations

import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress, repeat
from operator import is_
from string import ascii_letters

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, Scratch, held, slices
from .token_counts import _LONG, Pieces, load

#: Words of these letters stand for themselves in any normal form and in lower case, and are one piece for the pre-tokenizer.
_SIMPLE = re.compile("[a-zß-öø-ÿ]+")
#: Characters whose pieces are looked up together, and bytes of ids that a batch has before it goes out.
_BLOCK, _OUT = 500_000, 8_000_000
#: Rows of prefix sums (three numbers each) that a broadcast may have: some 5 MB.
_BROADCAST_ROWS = 200_000


@dataclass
class Slots:
    """Pieces number `rank` to `rank` + n - 1 of an original length, from id `start` on for `length` ids, go to the sequences
    from `sequence` on, one to each, at `offset`."""

    of: int
    rank: int
    n: int
    start: int
    length: int
    sequence: int = -1
    offset: int = -1


def pack(histogram: dict[int, int], size: int) -> list[Slots]:
    """Shortest-pack-first: lengths from the longest on; each goes to the pack with the most room that takes it whole.

    Packs with the same pattern of lengths are one entry with a count, and equal lengths are placed in bulk, so the work
    follows the number of lengths and patterns, not that of documents. A new pack is opened where no pack takes the piece,
    until there are as many packs as the ids need at least; from then on the piece is cut: one part fills the pack with the
    most room and the other is placed when its length comes up. So all packs but one are full.
    """
    least = -(-sum(k * n for k, n in histogram.items()) // size)
    todo: dict[int, list[Slots]] = defaultdict(list)
    for k, n in histogram.items():
        todo[k].append(Slots(k, 0, n, 0, k))
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> (first sequence, count)
    opened, out = 0, []
    for length in range(size, 0, -1):
        queue = todo.pop(length, [])
        while queue:
            piece = queue.pop()
            widest = max(room, default=0)
            if widest < length and opened < least:
                n = min(piece.n, least - opened)
                room[size].append((opened, n))
                opened += n
                widest = size
            first, count = room[widest].pop()
            n, part = min(piece.n, count), min(length, widest)
            out.append(Slots(piece.of, piece.rank, n, piece.start, part, first, size - widest))
            if n < count:
                room[widest].append((first + n, count - n))
            if not room[widest]:
                del room[widest]
            if widest > part:
                room[widest - part].append((first, n))
            if n < piece.n:
                queue.append(Slots(piece.of, piece.rank + n, piece.n - n, piece.start, length))
            if part < length:
                todo[length - part].append(Slots(piece.of, piece.rank, n, piece.start + part, length - part))
    return out


def _kinds(letters: str, marks: str) -> bytes:
    """Bits by byte: two neighbours without a common bit are always in different pre-tokens. 1 letters, 2 marks, 4 blanks; other
    bytes share a bit with letters and with marks, so nothing is cut beside them but at blanks."""
    kinds = bytearray([3] * 256)
    for bit, members in ((1, letters), (2, marks), (4, BLANKS)):
        for c in members.encode("latin-1"):
            kinds[c] = bit
    return bytes(kinds)


#: The apostrophe isn't among the marks: with some letters after it, it is a pre-token.
_ASCII_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_LOWER = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
#: Where a byte is a character, and where only ASCII bytes are.
_KINDS = {"latin-1": _kinds(_LOWER, _ASCII_MARKS + "¡¿«»"), "utf-8": _kinds(ascii_letters, _ASCII_MARKS)}


def cut_words(texts: list[bytes], codec: str) -> tuple[pa.BinaryArray, np.ndarray]:
    """The texts' pieces without the blanks between them, all texts' after each other, and where each text's end. Cuts are at
    blanks and between letters and marks, where the tokenizer cuts too."""
    raw = b"\n".join(texts) + b"\n"
    kind = np.frombuffer(raw.translate(_KINDS[codec]), np.uint8)
    starts = np.concatenate([[0], np.flatnonzero((kind[1:] & kind[:-1]) == 0) + 1])
    solid = kind[starts] != 4
    ends = np.searchsorted(starts[solid], np.cumsum([len(t) + 1 for t in texts]))
    offsets = np.concatenate([[0], np.cumsum(np.diff(np.append(starts, len(raw)))[solid])]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(raw.translate(None, BLANKS.encode()))]), ends


class Encoded(Pieces):
    """piece of a text -> its ids as little-endian 32-bit bytes."""

    def __init__(self, tokenizer, table: dict, bound: int):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        super().__init__(tokenizer, table, bound)
        seen = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: seen.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100)}
        self.words = Tokenizer(tokenizer.model)
        self.words.normalizer, self.words.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        suffix = getattr(tokenizer.model, "end_of_word_suffix", None)
        self.last = np.zeros(tokenizer.get_vocab_size(), bool)
        if suffix:
            self.last[[i for token, i in tokenizer.get_vocab().items() if token.endswith(suffix)]] = True

    def simple(self, words: list[str]) -> list[bytes]:
        """Simple words need neither normalizer nor pre-tokenizer: the library's model gets them as they stand, some together.
        A word ends with its only token that has the model's suffix; without one the words go one by one."""
        words = [w if w.isascii() else w.translate(self.letters) for w in words]
        out: list[bytes] = []
        for i in range(0, len(words), 500):
            block = words[i : i + 500]
            ids = np.array(self.words.encode_batch_fast([" ".join(block)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(block):
                out += self.cut(ids, [0, *ends[:-1].tolist()], ends.tolist())
            else:
                out += [array("I", [t.id for t in self.tokenizer.model.tokenize(w)]).tobytes() for w in block]
        return out

    def encoded(self, pieces: list[str]) -> list[bytes]:
        plain = [p for p in pieces if _SIMPLE.fullmatch(p)]
        out = dict(zip(plain, self.simple(plain), strict=True))
        others = [p for p in pieces if p not in out]
        out.update(zip(others, super().encoded(others), strict=True))
        return [out[p] for p in pieces]

    def cut(self, ids, starts: list[int], ends: list[int]) -> list[bytes]:
        raw = ids.tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip(starts, ends, strict=True)]

    def base(self, piece: str) -> str:
        """Special tokens are sought before letters are lowered, so nothing that could become one is lowered here."""
        return piece.lower() if piece.isascii() and "<|" not in piece else piece

    def values_of(self, names: list[str]) -> list[bytes]:
        """The values of different pieces. Simple words have nothing to strip; those that are missing come from the old generation
        or from the model, and at most a quarter of a generation is added together."""
        values = list(map(self.get, names))
        simple, others = [], []
        for i in compress(range(len(names)), map(is_, values, repeat(None))):
            (simple if _SIMPLE.fullmatch(names[i]) and len(names[i]) <= _LONG else others).append(i)
        for k in range(0, len(simple), self.bound // 4):
            at = simple[k : k + self.bound // 4]
            words = [names[i] for i in at]
            known = list(map(self.old.get, words))
            fresh = iter(self.simple(list(compress(words, map(is_, known, repeat(None))))))
            known = [next(fresh) if v is None else v for v in known]
            self.room(len(words))
            self.update(zip(words, known, strict=True))
            for i, v in zip(at, known, strict=True):
                values[i] = v
        for i, v in zip(others, self.filled([[names[i] for i in others]])[0], strict=True):
            values[i] = v
        return values

    def joined(self, texts: list[bytes], codec: str) -> list[bytes]:
        """Each text's ids. Of the texts' pieces each is looked up once."""
        words, ends = cut_words(texts, codec)
        found = words.dictionary_encode()
        names = [w.decode(codec) for w in found.dictionary.to_numpy(zero_copy_only=False).tolist()]
        ids = pa.array(self.values_of(names), pa.large_binary()).take(found.indices)
        at = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1)[np.append(0, ends)].tolist()
        raw = memoryview(ids.buffers()[2] or b"")
        return [bytes(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        """Texts of characters below 256 are lowered as a whole: no normal form changes them, and each character has one lower
        form. Not where that could make a special token. Other letters may compose with what follows, and stay."""
        some, size = [], 0
        for k, text in enumerate(texts):
            some.append(text)
            size += len(text)
            if size > _BLOCK or k == len(texts) - 1:
                yield from self.block(some)
                some, size = [], 0

    def block(self, texts: list[str]) -> list[bytes]:
        out: list = [None] * len(texts)
        dealt: dict[str, tuple[list[int], list[bytes]]] = {"latin-1": ([], []), "utf-8": ([], [])}
        for i, t in enumerate(texts):
            if any(s in t for s in self.specials):
                out[i] = np.asarray(self.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()
                continue
            try:
                codec, raw = "latin-1", (t if "<|" in t else t.lower()).encode("latin-1")
            except UnicodeEncodeError:
                codec, raw = "utf-8", t.encode()
            dealt[codec][0].append(i)
            dealt[codec][1].append(raw)
        for codec, (at, raws) in dealt.items():
            if at:
                for i, ids in zip(at, self.joined(raws, codec), strict=True):
                    out[i] = ids
        return out


def pieces(docs: DataFrame, spec: str, size: int, end_id: int, id_col: str, text_col: str, cache_size: int = 400_000) -> DataFrame:
    """Full pieces and a rest of every document, with ids; task and own number the pieces of a length within a task."""
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spec = shared.value
        encoded = held(("packing", spec, cache_size), lambda: Encoded(load(spec), {"": b""}, cache_size))
        task, own = TaskContext.get().partitionId(), Counter()
        end = end_id.to_bytes(4, "little")

        def table(doc_ids: pa.Array, rows: list) -> pa.RecordBatch:
            at, start, n, total, number, ids = zip(*rows, strict=True) if rows else [()] * 6
            return pa.RecordBatch.from_arrays([doc_ids.take(pa.array(at, pa.int64())), pa.array(start, pa.int64()), pa.array(n, pa.int32()), pa.array(total, pa.int64()), pa.array([task] * len(rows), pa.int32()), pa.array(number, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "start", "length", "doc_tokens", "task", "own", "ids"])

        for batch in slices(batches):
            rows: list = []
            held_back = 0
            for i, ids in enumerate(encoded.ids([t or "" for t in batch.column(1).to_pylist()])):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, size):
                    n = min(size, total - start)
                    rows.append((i, start, n, total, own[n], ids[4 * start : 4 * (start + n)]))
                    own[n] += 1
                held_back += len(ids)
                if held_back > _OUT:
                    yield table(batch.column(0), rows)
                    rows, held_back = [], 0
            yield table(batch.column(0), rows)

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, f"doc_id {kind}, start long, length int, doc_tokens long, task int, own long, ids binary")


def pack_documents(docs: DataFrame, tokenizer_path: str, *, size: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, doc_tokens, sequence_id, offset and ids (little-endian 32-bit) for every piece.

    A document is the ids of its whole text, then end_id. It is cut into full sequences and a rest, and a rest is cut again
    only where the packs would otherwise be more than the ids need (see pack). tokenizer_path is a file of the library
    `tokenizers` whose normalizer lowers letters and whose pre-tokenizer drops blanks and parts letters from marks. Null and empty texts are one id. Null ids stay null; repeated rows are
    packed as often as they stand there. An empty table gives no rows. Other columns are not read.

    Texts are encoded in one map, each of a block's different pieces once, through a bounded cache, and written with a number among the pieces of the
    same length in the same task. The driver sees the histogram of lengths only (at most `size` rows) and the slots made from
    it. A piece's rank among all of its length is its number plus a prefix sum over tasks; ranks and lengths find the slots.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    scratch = Scratch(spark, "packing")
    cut = scratch.write(pieces(docs, spec, size, end_id, id_col, text_col), "pieces")
    tasks = scratch.write(cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "tasks")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = tasks.select("length", "task", before.alias("shift"))
    few = tasks.count() <= _BROADCAST_ROWS
    histogram = {r["length"]: r["n"] for r in tasks.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.createDataFrame([(s.of, s.rank, s.rank + s.n, s.start, s.length, s.sequence, s.offset) for s in pack(histogram, size)], "length int, lo long, hi long, sub long, part int, first long, offset long")
    at = cut.join(F.broadcast(shifts) if few else shifts, ["length", "task"]).withColumn("rank", F.col("shift") + F.col("own")).alias("p")
    s = F.broadcast(slots).alias("s")
    out = at.join(s, (F.col("p.length") == F.col("s.length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    part = F.substring(F.col("ids"), (F.col("sub") * 4 + 1).cast("int"), F.col("part") * 4)
    return out.select("doc_id", (F.col("start") + F.col("sub")).alias("start"), F.col("part").cast("long").alias("length"), "doc_tokens", (F.col("first") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset", part.alias("ids"))
