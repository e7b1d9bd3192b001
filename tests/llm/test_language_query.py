"""op2_language_id over a whole table: predictions recomputed the slow way, and what it may learn from."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadlake.llm import queries
from quadlake.llm.language_id import fit

SF = "/root/testdata/sf0.001"


def grams(text):
    for word in (text or "").lower().split():
        letters = "".join(c for c in word if c.isalpha())
        if letters:
            marked = f"<{letters}>"
            yield marked
            for n in (2, 3):
                for i in range(len(marked) - n + 1):
                    yield marked[i : i + n]


def slow(model, text):
    ids = [zlib.crc32(g.encode()) % len(model.table) for g in grams(text)]
    if not ids:
        return "und", 0.0, True
    z = (sum(model.table[i].astype(float) for i in ids) / len(ids) + model.bias) / model.temperature
    p = np.exp(z - z.max())
    p /= p.sum()
    return model.labels[int(p.argmax())], float(p.max()), bool(p.max() < model.threshold)


def test_predictions_equal_brute_force(spark):
    docs = queries.documents(spark, SF)
    rows = docs.select("doc_id", "text").collect()
    learnt = docs.where(F.expr("crc32(cast(doc_id as string)) % 4 <> 2"))
    model = fit(learnt)
    got = {r.doc_id: r for r in queries.op2_language_id(spark, SF).collect()}
    assert len(got) == len(rows)
    for r in rows:
        lang, score, rejected = slow(model, r.text)
        g = got[r.doc_id]
        assert g.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert (g.lang_pred, g.rejected) == (lang, rejected) and g.score == pytest.approx(score, abs=1e-5)


def test_nothing_is_learnt_from_held_out_rows(spark, tmp_path):
    docs = queries.documents(spark, SF)
    held = F.expr("crc32(cast(doc_id as string)) % 4 = 2")
    docs.withColumn("lang", F.when(held, "zz").otherwise(F.col("lang"))).withColumn("source", F.lit("other")).repartition(1).write.parquet(f"{tmp_path}/documents.parquet")
    key = lambda r: (r.doc_id, r.lang_pred, round(r.score, 6))
    assert sorted(map(key, queries.op2_language_id(spark, str(tmp_path)).collect())) == sorted(map(key, queries.op2_language_id(spark, SF).collect()))


def test_rejection_is_at_the_calibrated_score(spark):
    got = queries.op2_language_id(spark, SF).where("lang_pred <> 'und'").collect()
    kept, gone = [r.score for r in got if not r.rejected], [r.score for r in got if r.rejected]
    assert kept and (not gone or max(gone) <= min(kept))
