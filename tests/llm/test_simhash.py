"""SimHash components against brute force, and the ways of crowded buckets."""

import random
import re

import numpy as np
import pytest
import xxhash

from quadlake.llm.common import Scratch
from quadlake.llm.near_dedup import components
from quadlake.llm.queries import op13_simhash_dedup
from quadlake.llm.simhash import fingerprint, links, simhash_dedup, spanning_links, split_masks


def slow_print(text, width=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(prints, distance):
    label = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= distance and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_components_equal_brute_force(make, texts):
    rng = random.Random(3)
    long = [t for t in texts if t and len(t) > 300]
    texts = [*texts, *(re.sub(r"\S+", lambda m: "new" if rng.random() < 0.03 else m[0], t) for t in long for _ in range(4)), "One two", "one\ttwo ", "ÀB c d", "àb c d", "\x1c x \x85 y"]
    got = simhash_dedup(make(texts)).collect()
    prints = [slow_print(t) for t in texts]
    label = slow_components(prints, 4)
    assert len(got) == len(texts) and len(set(label)) < len(set(prints))
    for r in got:
        assert r.fingerprint == f"{prints[r.doc_id]:016x}", texts[r.doc_id]
        assert r.component_id == label[r.doc_id]


def test_null_ids_repeats_and_no_rows(make):
    rows = [(None, "a b c d", "en", "s"), (7, "A b c d", "en", "s"), (7, "A b c d", "en", "s"), (None, "quite other words are here now", "en", "s"), (9, None, None, None), (3, " \n", "en", "s")]
    got = sorted((r.doc_id or 0, r.fingerprint == "0" * 16, r.component_id or 0) for r in simhash_dedup(make(rows)).collect())
    assert got == [(0, False, 0), (0, False, 7), (3, True, 3), (7, False, 7), (7, False, 7), (9, True, 3)]
    assert simhash_dedup(make([])).count() == 0


def test_blocks_of_a_text_make_no_difference(texts):
    for t in texts:
        data = (t or "").encode()
        assert fingerprint(data, block=7) == fingerprint(data) == slow_print(t)


@pytest.mark.parametrize(("most", "depth"), [(2048, 4), (20, 4), (20, 1), (3, 2)])
def test_crowded_buckets(spark, most, depth):
    """A crowd of prints around one, chains with steps of 4 bits, and others, whatever the size of a bucket."""
    rng = random.Random(5)
    base = rng.getrandbits(64)
    prints = {base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(7))) for _ in range(400)}
    step = rng.getrandbits(64)
    for _ in range(30):
        step ^= sum(1 << b for b in rng.sample(range(64), 4))
        prints.add(step)
    prints |= {rng.getrandbits(64) for _ in range(200)} | {0, 1, 2**63, 2**64 - 1}
    prints = sorted(prints)
    as_long = {int(np.array([p], np.uint64).view(np.int64)[0]): k for k, p in enumerate(prints)}
    scratch = Scratch(spark, "test_simhash")
    df = spark.createDataFrame([(p,) for p in as_long], "print long")
    found = links(df, scratch, 4, most, depth)
    assert all(bin(prints[as_long[r.a]] ^ prints[as_long[r.b]]).count("1") <= 4 for r in found.collect())
    label = slow_components(prints, 4)
    got = {as_long[r.node]: as_long[r.label] for r in components(found, scratch).collect()}
    same = {}
    for k in range(len(prints)):
        assert same.setdefault(label[k], got.get(k, k)) == got.get(k, k)
    assert len(set(label)) == len({got.get(k, k) for k in range(len(prints))})


def test_spanning_links_are_few():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, dtype=np.uint64)
    crowd = np.unique(base ^ (np.uint64(1) << rng.integers(0, 64, 3000, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 3000, dtype=np.uint64)))
    out = spanning_links(crowd, 4)
    assert sum(len(a) for a, _ in out) == len(crowd) - 1
    assert split_masks(0, 5)[0] == 2**12 - 1 and np.bitwise_or.reduce(np.array(split_masks(0, 5), np.uint64)) == np.uint64(2**64 - 1)


def test_query_over_whole_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = sorted(docs)
    prints = [slow_print(docs[i]) for i in ids]
    label = slow_components(prints, 4)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op13_simhash_dedup(spark, sf).collect()}
    assert got == {i: (f"{p:016x}", ids[k]) for i, p, k in zip(ids, prints, label, strict=True)}
