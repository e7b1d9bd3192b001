"""Lexical search against brute force; the pruned search of one shard against a plain sum."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from quadlake.llm.lexical_search import Postings, best, impact, lexical_search, narrow, term_blocks

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def slow(docs, queries, k):
    """docs, queries: (id, text). Lists of (query, rank, doc_id, score)."""
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for q, text in queries:
        scored = []
        for i, c in counted:
            m = 100 - 90 + 90 * c.total() * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                scored.append((-s, math.inf if i is None else i, i))
        scored.sort(key=lambda x: x[:2])
        out += [(q, r + 1, i, -s) for r, (s, _, i) in enumerate(scored[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("shard_terms", "query_block"), [(4_000_000, 512), (300, 2)])
def test_equals_brute_force(make, spark, texts, shard_terms, query_block):
    rng = random.Random(8)
    common = [" ".join(f"c{min(9, int(rng.expovariate(0.5)))}" for _ in range(rng.randrange(3, 30))) for _ in range(150)]
    docs = [*enumerate([*texts, *common, *common[:5]]), (None, common[0]), (None, common[0]), (7, common[1])]
    queries = [(0, "c0 C1 c2 c9"), (1, "W5 w17 w300 c3 c3"), (2, None), (3, ""), (4, "nowhere"), (5, common[0]), (6, "Ünïcode é" + "é" * 69), (7, texts[20]), (7, texts[20]), (None, "c8 c9")]
    made = make([(i, t, "en", "s") for i, t in docs])
    asked = spark.createDataFrame([(q, t, 1, "x") for q, t in queries], "item_id long, text string, rank int, doc_id string")
    got = sorted(((r["query"], r["rank"], r.doc_id, r.score) for r in lexical_search(made, asked, k=6, shard_terms=shard_terms, query_block=query_block).collect()), key=repr)
    assert got == slow(docs, queries, 6)


def test_no_rows(make, spark):
    asked = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical_search(make([]), asked).count() == 0
    assert lexical_search(make([None, "", "  ..."]), asked).count() == 0
    assert lexical_search(make(["a b"]), asked.limit(0)).count() == 0


def postings(docs, tfs, norms):
    n = np.array([len(docs)])
    (d, dk), (t, tk) = narrow(np.diff(docs, prepend=0), np.array([0]), n), narrow(tfs, np.array([0]), n)
    heads = np.arange(0, len(docs), 128)
    return Postings(len(docs), d[0].as_py(), int(dk[0]), t[0].as_py(), int(tk[0]), docs[np.append(heads[1:], len(docs)) - 1], np.maximum.reduceat(impact(tfs, norms[docs]), heads), norms)


def test_pruned_search_of_a_shard(monkeypatch):
    """Ties at the edge stay, and blocks are left compressed where their maximum is too low."""
    rng = np.random.default_rng(2)
    size = 70_000
    norms = rng.integers(10, 400, size)
    score, read = np.zeros(size, np.int64), []
    monkeypatch.setattr(Postings, "some", lambda self, blocks, own=Postings.some: read.append(len(blocks)) or own(self, blocks))
    skipped = 0
    for _ in range(40):
        lists = []
        for share in rng.choice([0.0001, 0.001, 0.02, 0.5], size=int(rng.integers(1, 6))):
            docs = np.flatnonzero(rng.random(size) < share)
            docs = docs if len(docs) else np.array([3])
            tfs = rng.geometric(0.5, len(docs)) if rng.random() < 0.7 else np.full(len(docs), 300)
            lists.append((postings(docs, tfs, norms), int(2000 * -np.log10(share) + rng.integers(9))))
        want = np.zeros(size, np.int64)
        for p, w in lists:
            docs, own = p.whole()
            assert all(np.array_equal(x, y) for x, y in zip(p.some(np.arange(len(p.lasts))), (docs, own), strict=True))
            want[docs] += w * own
        read.clear()
        docs, scores = best(lists, 10, score)
        order = np.lexsort((np.arange(size), -want))[:10]
        order = order[want[order] > 0]
        assert docs.tolist() == order.tolist() and scores.tolist() == want[order].tolist()
        assert not score.any()
        skipped += sum(len(p.lasts) for p, _ in lists) - sum(read)
    assert skipped > 0


def test_terms_of_blocks(texts):
    for t in texts:
        for size in (3, 1 << 22):
            assert [w.decode() for b in term_blocks((t or "").encode(), size) for w in b] == terms(t)
