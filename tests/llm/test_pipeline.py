"""The pipeline's stages, each against a brute-force version on its own input."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

import corpus_pipeline  # noqa: E402

FORMS = {"aa": ["taka", "ruko", "pami", "lota", "neri"], "bb": ["schen", "burg", "licht", "wegs", "tal"], "cc": ["eau", "oix", "ieux", "ette", "age"]}


def sets_of(x):
    w = (x or "").split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_stages(spark, tmp_path):
    rng = random.Random(6)
    rows = []
    for i in range(90):
        lang = list(FORMS)[i % 3]
        t = " ".join("".join(rng.choices(FORMS[lang], k=3)) for _ in range(rng.randrange(10, 120)))
        rows.append((i, t + ("\nShared line here" if i % 4 == 0 else "") + "\nend", lang, f"s{i % 5}"))
    rows += [(90, rows[3][1], "aa", "s0"), (91, rows[5][1] + " x", "cc", "s1"), (92, None, "aa", None), (93, "123 !!", "bb", "s2"), (94, "", "cc", "s3")]
    docs = spark.createDataFrame([(d, t, lang, s, len(t or "")) for d, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    at, outs = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, str(tmp_path))
        assert k == 4 or out.columns == corpus_pipeline.COLUMNS
        out.write.parquet(f"{tmp_path}/{k}")
        at = spark.read.parquet(f"{tmp_path}/{k}")
        outs.append(at.collect())
    languages, lines, near, mixed, pieces = outs

    assert {r.doc_id for r in languages} == set(range(92)) and len(languages) == 92
    found = defaultdict(set)
    for r in languages:
        for x in r.text.split("\n"):
            found[x.strip().lower()].add(r.doc_id)
    want = {r.doc_id: "\n".join(x for x in r.text.split("\n") if len(found[x.strip().lower()]) < 10) for r in languages}
    assert {r.doc_id: r.text for r in lines} == want and all(r.n_chars == len(r.text) for r in lines)

    sets = {r.doc_id: sets_of(r.text) for r in lines}
    label = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and (want[a] == want[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                low, high = sorted((label[a], label[b]))
                label = {d: low if x == high else x for d, x in label.items()}
    assert sorted(r.doc_id for r in near) == sorted(set(label.values()))

    size = defaultdict(int)
    for r in near:
        size[r.source] += len(r.text.split())
    taken, times = defaultdict(int), Counter(r.doc_id for r in mixed)
    for r in mixed:
        taken[r.source] += len(r.text.split())
    assert max(times.values()) <= 2 and all(taken[s] <= 2 * size[s] for s in size)
    assert abs(sum(taken.values()) - 1.5 * sum(size.values())) <= 60 * len(size)

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {r.doc_id: [*t.encode(r.text, add_special_tokens=False).ids, 1] for r in mixed}
    assert Counter(x for d, n in times.items() for x in ids[d] * n) == Counter(np.concatenate([np.frombuffer(bytes(r.ids), "<u4") for r in pieces]).tolist())
    assert all(len(bytes(r.ids)) == 4 * r.length for r in pieces)
