"""How a language's sources differ in their words: exact vectors by CountVectorizer, sums of groups, and sparse pair sums."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import IllegalArgumentException
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .common import slices as parts_of

#: A term is ASCII letters and all that isn't ASCII. On UTF-8 bytes: A-Z are lowered, what is in no term becomes a blank.
_TO_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
_ALL = 2**31 - 1


def cut_terms(rows: DataFrame) -> DataFrame:
    """lang, source, code and terms of the rows that have a code; other rows without terms. rows: lang, source, code, text (UTF-8)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches):
            words, ends = [], [0]
            for code, text in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
                if code >= 0:
                    words += text.as_py().translate(_TO_TERMS).split()
                ends.append(len(words))
            terms = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(words, pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], terms], names=["lang", "source", "code", "terms"])

    return rows.select("lang", "source", "code", "text").mapInArrow(cut, "lang string, source string, code int, terms array<string>")


def vocabulary_sizes(tokens: DataFrame, least: int, share: int = 64) -> dict[int, float]:
    """About how many terms of each code at least `least` rows have: those among the terms that a hash picks, one in `share`, are
    counted. At two million terms the standard error is 0.6 %."""
    picked = F.array_distinct(F.filter("terms", lambda t: F.pmod(F.xxhash64(F.lit(1), t), F.lit(share)) == 0))
    found = tokens.select("code", F.explode(picked).alias("term")).groupBy("code", "term").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return {r["code"]: float(share * r["n"]) for r in found.groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect()}


def in_slice(terms: Column, part: int, slices: int) -> Column:
    return F.filter(terms, lambda t: F.pmod(F.xxhash64(t), F.lit(slices)) == part)


def probability(n: str, total: str, kept: str) -> Column:
    """1 + floor(10^9 (n + 5) / (total + 5 kept)) in exact integers; 0 where no term is kept."""
    p = F.expr(f"""1 + CASE WHEN {n} < 9000000000 THEN 1000000000L * ({n} + 5) div nullif({total} + 5 * {kept}, 0)
      ELSE cast(1000000000 as decimal(10, 0)) * cast({n} + 5 as decimal(20, 0)) div cast({total} + 5 * {kept} as decimal(20, 0)) END""")
    return F.coalesce(p, F.lit(0)).cast("long")


def summed(vectors: DataFrame) -> DataFrame:
    """(source, at, n): sums of the sparse vectors of each source. A batch is summed in numpy before Spark sums the batches."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources, own = np.unique(batch.column(0).to_numpy(zero_copy_only=False).astype(object), return_inverse=True)
            index, value = batch.column(1), batch.column(2)
            at, n = index.flatten().to_numpy(), value.flatten().to_numpy()
            if not len(at):
                continue
            owner = np.repeat(own, index.value_lengths().to_numpy())
            width = int(at.max()) + 1
            key, inverse = np.unique(owner.astype(np.int64) * width + at, return_inverse=True)
            total = np.bincount(inverse, weights=n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(sources[key // width], pa.string()), pa.array((key % width).astype(np.int64)), pa.array(total)], names=["source", "at", "n"])

    return vectors.mapInArrow(add, "source string, at long, n long").groupBy("source", "at").agg(F.sum("n").alias("n"))


@dataclass
class Terms:
    """counts: (lang, source, slot, term, n), n > 0 occurrences of a kept term, slot its number in the language; groups: (lang, source, total) of all groups, total their
    occurrences of kept terms; langs: (lang, number, kept), number from 0."""

    counts: DataFrame
    groups: DataFrame
    langs: DataFrame


def kept_terms(docs: DataFrame, scratch: Scratch, text_col: str, lang_col: str, source_col: str, least: int, slice_terms: int) -> Terms:
    """Counts of the terms that at least `least` documents of a language have, by a CountVectorizer for each language, without a
    limit on its vocabulary.

    A CountVectorizer's vocabulary is on the driver and broadcast, so it must be bounded: where a language keeps more than
    `slice_terms` terms (see vocabulary_sizes; a tenth is added), its terms are dealt to slices by a hash and each slice has its
    CountVectorizer. Languages are looped over by the driver, those with fewer than `least` documents left out, as they keep
    nothing.
    """
    spark = docs.sparkSession
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for n, c in (("text", text_col), ("lang", lang_col), ("source", source_col))])
    sizes = {r["lang"]: r["n"] for r in read.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    many = sorted(lang for lang, n in sizes.items() if n >= least)
    codes = spark.createDataFrame(list(enumerate(many)), "code int, lang string")
    # an empty lang can't be the name of a folder of the table, so folders are numbers
    rows = read.join(F.broadcast(codes), "lang", "left").select("lang", "source", F.coalesce("code", F.lit(-1)).alias("code"), F.col("text").cast("binary").alias("text"))
    tokens = scratch.write(cut_terms(rows), "tokens", ("code",))
    expected = vocabulary_sizes(tokens.where("code >= 0"), least)
    counts, kept = None, dict.fromkeys(sizes, 0)
    for code, lang in enumerate(many):
        slices = max(1, int(-(-1.1 * expected.get(code, 0) // slice_terms)))
        for part in range(slices):
            own = tokens.where(F.col("code") == code).select("source", "terms")
            if slices > 1:
                own = own.withColumn("terms", in_slice(F.col("terms"), part, slices))
            try:
                model = CountVectorizer(inputCol="terms", outputCol="vector", minDF=float(least), vocabSize=_ALL).fit(own)
            except IllegalArgumentException as e:
                if "vocabulary size" in str(e):  # no term is in enough documents
                    continue
                raise
            name = f"{code}-{part}"
            model.save(scratch.path(f"model-{name}"))
            vocabulary = spark.read.parquet(scratch.path(f"model-{name}/data")).select(F.posexplode("vocabulary").alias("at", "term"))
            kept[lang] += vocabulary.count()
            vectors = model.transform(own).select("source", F.unwrap_udt("vector").alias("v")).select("source", "v.indices", "v.values")
            sums = summed(vectors).join(vocabulary, "at").select(F.lit(lang).alias("lang"), "source", (F.col("at") + ((code << 20 | part) << 31)).alias("slot"), "term", "n")
            sums = scratch.write(sums, f"counts-{name}")
            counts = sums if counts is None else counts.unionByName(sums)
    if counts is None:
        counts = spark.createDataFrame([], "lang string, source string, slot long, term string, n long")
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = tokens.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"))
    langs = spark.createDataFrame([(lang, k, kept[lang]) for k, lang in enumerate(sorted(sizes))], "lang string, number int, kept long")
    return Terms(counts, scratch.write(groups, "groups"), langs)


def pair_excess(source: np.ndarray, term: np.ndarray, p: np.ndarray, zero: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For sources `rows` (down) and all sources (across): the sum over the given terms of |p - q| less the |p - q| of two sources
    without the term. Entries (source, term, p) are what sources have; zero is a source's p for a term it hasn't. Only entries are
    visited: all of a source's against the entries of the others, and its own where the other has none."""
    out = np.zeros((len(rows), len(zero)), np.int64)
    dense, has = np.zeros(int(term.max(initial=-1)) + 1, np.int64), np.zeros(int(term.max(initial=-1)) + 1, bool)
    order = np.argsort(source, kind="stable")
    cuts = np.searchsorted(source[order], np.arange(len(zero) + 1))
    for k, g in enumerate(rows):
        own = order[cuts[g] : cuts[g + 1]]
        t, q = term[own], np.sort(p[own])
        dense[:], has[t] = zero[g], True
        dense[t] = p[own]
        there = np.abs(p - dense[term])  # where the other source has the term
        out[k] = np.bincount(source, there, len(zero)).astype(np.int64)
        both = has[term]
        # where it hasn't: |own p - its zero|, for all own terms by sorted sums, less those that it has
        sums, at = np.concatenate([[0], np.cumsum(q)]), np.searchsorted(q, zero)
        out[k] += zero * at - sums[at] + (sums[-1] - sums[at]) - zero * (len(q) - at)
        out[k] -= np.bincount(source[both], np.abs(dense[term[both]] - zero[source[both]]), len(zero)).astype(np.int64)
        union = np.bincount(source, minlength=len(zero)) + len(t) - np.bincount(source[both], minlength=len(zero))
        out[k] -= union * np.abs(zero - zero[g])
        has[t] = False
    return out


def pair_sums(found: Terms, block_rows: int, tile: int) -> DataFrame:
    """(lang, source, item, value) of every two sources of a language, both ways. Terms are dealt to blocks of about `block_rows`
    entries, in which every source has a row besides for what it is without a term; a task takes a block and `tile` sources against
    all. What leaves a task is one number a pair."""
    nnz = found.counts.groupBy("lang").agg(F.count(F.lit(1)).alias("nnz"))
    sources = found.groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
    plan = found.langs.join(sources, "lang").join(nnz, "lang", "left").select("lang", "number", "kept", F.greatest(F.lit(1), F.ceil(F.coalesce("nnz", F.lit(0)) / block_rows)).alias("blocks"), F.ceil(F.col("sources") / tile).alias("tiles"))
    zero = F.lit(0).cast("long")
    groups = found.groups.join(plan, "lang").withColumn("zero", probability("0", "total", "kept"))
    entries = found.counts.join(groups, ["lang", "source"]).select("lang", "source", "number", F.pmod(F.xxhash64("slot"), "blocks").alias("block"), "slot", probability("n", "total", "kept").alias("p"), zero.alias("kept"), "tiles", F.lit(False).alias("marks"))
    marks = groups.select("lang", "source", "number", F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("block"), zero.alias("slot"), F.col("zero").alias("p"), "kept", "tiles", F.lit(True).alias("marks"))
    tasks = entries.unionByName(marks).withColumn("tile", F.explode(F.sequence(zero, F.col("tiles") - 1))).drop("tiles")

    def compare(table: pa.Table) -> pa.Table:
        at = {c: table.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("source", "slot", "p", "kept", "marks")}
        marks = at["marks"].astype(bool)
        names, first = np.unique(at["source"][marks].astype(object), return_index=True)
        zero = at["p"][marks][first].astype(np.int64)
        source = np.searchsorted(names, at["source"][~marks].astype(object))
        _, term = np.unique(at["slot"][~marks], return_inverse=True)
        number = table.column("tile")[0].as_py()
        rows = np.arange(number * tile, min(len(names), (number + 1) * tile))
        out = pair_excess(source, term, at["p"][~marks].astype(np.int64), zero, rows)
        if table.column("block")[0].as_py() == 0:
            out += int(at["kept"].max()) * np.abs(zero[rows][:, None] - zero[None, :])
        g, h = np.nonzero(rows[:, None] != np.arange(len(names))[None, :])
        return pa.table({"lang": pa.array([table.column("lang")[0].as_py()] * len(g), pa.string()), "source": pa.array(names[rows[g]], pa.string()), "item": pa.array(names[h], pa.string()), "value": pa.array(out[g, h])})

    return tasks.groupBy("number", "block", "tile").applyInArrow(compare, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def term_excess(found: Terms) -> DataFrame:
    """(lang, source, item, value): the terms that a source has oftener than its language, by how much."""
    both = found.counts.withColumn("all", F.sum("n").over(Window.partitionBy("slot")))
    lang = found.groups.groupBy("lang").agg(F.sum("total").alias("lang_total")).join(found.langs, "lang")
    rows = both.join(found.groups, ["lang", "source"]).join(lang, "lang")
    value = probability("n", "total", "kept") - probability("all", "lang_total", "kept")
    return rows.select("lang", "source", F.col("term").alias("item"), value.alias("value")).where("value > 0")


def source_audit(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = 30, top: int = 50, slice_terms: int = 2_000_000, block_rows: int = 200_000, tile: int = 256) -> DataFrame:
    """lang, source, part, item, value, rank: for every group (lang, source) its distance from each other source of the language
    (part `pair`, all ranks) and the `top` terms that it has oftener than its language (part `term`).

    A group's probability of a kept term is smoothed, in thousand millionths (see probability); a pair's value is the sum of
    |p - q| over the language's kept terms, a term's is p - q. Ranks go by value, the greatest first, then by item.
    Null text, lang and source count as empty strings. A group without kept terms has pairs; a language without kept terms has
    pairs of value 0. Repeated rows are documents. An empty table gives no rows. Other columns aren't read. A language may have
    any number of terms and documents; the result itself has the square of its number of sources.
    """
    found = kept_terms(docs, Scratch(docs.sparkSession, "source_audit"), text_col, lang_col, source_col, least, slice_terms)
    own = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_sums(found, block_rows, tile).withColumn("rank", F.row_number().over(own)).withColumn("part", F.lit("pair"))
    terms = term_excess(found).withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= top).withColumn("part", F.lit("term"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(columns).unionByName(terms.select(columns))
