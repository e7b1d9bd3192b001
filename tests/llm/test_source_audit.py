"""Source divergence against brute force, with vocabularies in slices, small blocks and tiles."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quadlake.llm import source_audit as module
from quadlake.llm.source_audit import pair_excess, source_audit, vocabulary_sizes


def slow(rows, least, top):
    """rows: (text, lang, source)."""
    rows = [(Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))), lang or "", s or "") for t, lang, s in rows]
    out = []
    for lang in {r[1] for r in rows}:
        df = Counter(t for c, own, _ in rows if own == lang for t in c)
        kept = [t for t, n in df.items() if n >= least]
        groups = defaultdict(Counter)
        for c, own, s in rows:
            if own == lang:
                groups[s] += Counter({t: c[t] for t in kept if t in c})
        p = {s: {t: 1 + 10**9 * (g[t] + 5) // (g.total() + 5 * len(kept)) for t in kept} for s, g in groups.items()}
        whole = sum(groups.values(), Counter())
        q = {t: 1 + 10**9 * (whole[t] + 5) // (whole.total() + 5 * len(kept)) for t in kept}
        for s in groups:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in groups if o != s)
            terms = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if groups[s][t] and p[s][t] > q[t])[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item, -v, k + 1) for k, (v, _, item) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("limits", [{}, {"slice_terms": 20, "block_rows": 40, "tile": 2}])
def test_equals_brute_force(make, texts, limits, monkeypatch):
    if limits:
        monkeypatch.setattr(module, "vocabulary_sizes", lambda tokens, least: dict.fromkeys(range(9), 60.0))  # four slices
    rng = random.Random(6)
    rows = [(t, rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "é", "B", None])) for t in texts]
    for _ in range(400):
        lang, source = rng.choice(["en", "en", "de", "und"]), rng.choice("abcdef")
        rows.append((" ".join(f"T{chr(97 + min(25, int(rng.expovariate(0.2 + ord(source) % 3 / 10))))}, " for _ in range(rng.randrange(30))), lang, source))
    rows += [("alone in its language", "zz", "a"), (None, "zz", "b"), ("", "en", "only empty"), (None, "de", None), ("Ünï ünï", "en", "a")]
    docs = make([(i, *r) for i, r in enumerate(rows)])
    got = sorted(tuple(r) for r in source_audit(docs, least=8, top=5, **limits).collect())
    assert got == slow(rows, 8, 5)


def test_vocabulary_sizes(spark):
    rng = random.Random(2)
    rows = [(k % 2, [f"t{int(rng.expovariate(0.02 + k % 2 / 50))}" for _ in range(40)]) for k in range(300)]
    tokens = spark.createDataFrame(rows, "code int, terms array<string>")
    want = {c: sum(n >= 10 for n in Counter(t for own, ts in rows if own == c for t in set(ts)).values()) for c in (0, 1)}
    assert vocabulary_sizes(tokens, 10, share=1) == want
    assert all(abs(vocabulary_sizes(tokens, 10, share=4).get(c, 0) - want[c]) < 0.6 * want[c] for c in (0, 1))


def test_no_kept_terms_and_no_rows(make):
    docs = make([(1, "a b", "en", "s"), (2, "c", "en", "t"), (3, "c", "fr", "t"), (4, None, None, None)])
    assert sorted(tuple(r) for r in source_audit(docs, least=2).collect()) == [("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)]
    assert source_audit(make([])).count() == 0


def test_pair_excess_is_that_of_dense_vectors():
    rng = np.random.default_rng(0)
    for _ in range(20):
        n, width = int(rng.integers(1, 7)), int(rng.integers(1, 30))
        zero, dense = rng.integers(1, 50, n), rng.integers(1, 100, (n, width))
        absent = rng.random((n, width)) < 0.5
        p = np.where(absent, zero[:, None], dense)
        source, term = np.nonzero(~absent)
        want = np.abs(p[:, None, :] - p[None, :, :]).sum(axis=2) - width * np.abs(zero[:, None] - zero[None, :])
        assert np.array_equal(pair_excess(source, term, p[source, term], zero, np.arange(n)), want)
