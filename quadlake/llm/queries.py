"""The queries opN_<name> over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .exact_dedup import exact_dedup
from .fingerprints import fingerprints
from .language_id import fit, language_id
from .lexical_search import lexical_search
from .line_dedup import line_dedup
from .mixing import by_length, mix
from .near_dedup import near_dedup
from .packing import pack_documents
from .sharding import shard
from .simhash import simhash_dedup
from .source_audit import source_audit
from .suffix_dedup import repeated_strings
from .token_counts import token_counts


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def held_out(doc_id) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    found = docs.select("doc_id", "text").withColumn("found", language_id(docs, model))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "found.lang_pred", "found.score", "found.rejected")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


OP3_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(documents(spark, sf_dir), least=10)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


_LINE_KEY = "translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP4_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
     l AS (SELECT r, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
     k AS (SELECT *, {_LINE_KEY} AS key FROM l),
     f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY r, doc_id
"""

def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), size=2048, end_id=1)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir), weights=(5, 2, 1), share=1.5, most=2.0, priority=by_length(F.col("text"))).drop("copies")


OP6_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                  (CAST(CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u
           FROM documents),
     s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
     w AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap,
                  1.5::DOUBLE * sum(source_size) OVER () AS total FROM s),
     f AS (SELECT *, row_number() OVER o AS k, (total - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                     / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
           FROM w WINDOW o AS (ORDER BY cap / w, source NULLS LAST)),
     v AS (SELECT arg_min(level, k) AS level FROM f WHERE level * w <= cap),
     t AS (SELECT source, source_size, coalesce(least(cap, v.level * w), cap) AS target FROM f, v),
     p AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target / source_size) AS BIGINT) END AS whole FROM t),
     r AS (SELECT d.doc_id, d.size, p.source_size, p.target, p.whole, target - whole * source_size AS rest,
                  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.u / (1 - d.u) / length(bin(d.size)), d.doc_id NULLS LAST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
           FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       CAST((whole + CASE WHEN rest > 0 AND 2 * before + size <= 2 * rest THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM r
"""


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dedup(documents(spark, sf_dir), width=5, similarity=0.8)
    return out.select("doc_id", "class_id", "class_size", "kept")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(documents(spark, sf_dir), shards=40)
    return out.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_strings(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=10)
    return found.select(F.col("query").alias("item_id"), "rank", "doc_id", "score")


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ts FROM documents),
     s AS (SELECT CAST(count(*) FILTER (WHERE len(ts) > 0) AS BIGINT) AS nd, CAST(sum(len(ts)) AS BIGINT) AS nt FROM d),
     q AS (SELECT b, item_id, unnest(list_distinct(ts)) AS term FROM (SELECT row_number() OVER () AS b, item_id, {_TERMS} AS ts FROM benchmark)),
     p AS (SELECT r, doc_id, len(ts) AS n, unnest(ts) AS term FROM d),
     f AS (SELECT r, doc_id, n, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM q) GROUP BY r, doc_id, n, term),
     w AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, s GROUP BY term, nd),
     c AS (SELECT b, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nd) // nt)))) AS BIGINT) AS score
           FROM q JOIN f USING (term) JOIN w USING (term), s GROUP BY b, item_id, r, doc_id),
     k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY b ORDER BY score DESC, doc_id NULLS LAST) AS INT) AS rank, doc_id, score FROM c WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
"""


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit(documents(spark, sf_dir), least=30, top=50)


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
     t AS (SELECT r, lang, source, unnest(ts) AS term FROM d),
     k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
     c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
     v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
     s AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
     g AS (SELECT d.lang, d.source, coalesce(s.total, 0) AS total, coalesce(v.v, 0) AS v
           FROM (SELECT DISTINCT lang, source FROM d) d LEFT JOIN s USING (lang, source) LEFT JOIN v USING (lang)),
     p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, CAST(1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (g.total + 5 * g.v) AS BIGINT) AS p
           FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
     l AS (SELECT lang, term, CAST(1 + (1000000000 * (sum(n) + 5)) // (sum(sum(n)) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)) AS BIGINT) AS q FROM c GROUP BY lang, term),
     f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY a.lang, a.source, b.source),
     x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
           FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
           UNION ALL SELECT lang, source, 'term', term, p - q FROM p JOIN l USING (lang, term) WHERE n > 0 AND p > q),
     y AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM x)
SELECT lang, source, part, item, value, rank FROM y WHERE part = 'pair' OR rank <= 50
"""


def op13_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(documents(spark, sf_dir), width=4, distance=4)


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_language_id": op2_language_id,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_line_dedup": op4_line_dedup,
    "op5_packing": op5_packing,
    "op6_mixing": op6_mixing,
    "op7_near_dedup": op7_near_dedup,
    "op8_fingerprints": op8_fingerprints,
    "op9_sharding": op9_sharding,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_lexical_search": op11_lexical_search,
    "op12_source_audit": op12_source_audit,
    "op13_simhash_dedup": op13_simhash_dedup,
}
ORACLE_SQL = {"op3_exact_dedup": OP3_SQL, "op4_line_dedup": OP4_SQL, "op6_mixing": OP6_SQL, "op11_lexical_search": OP11_SQL, "op12_source_audit": OP12_SQL}
