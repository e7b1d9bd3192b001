"""Each operator against a brute-force version, on texts with nulls, copies, long texts and odd blanks, and on no rows."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from quadlake.llm.exact_dedup import Directory, exact_dedup  # noqa: E402
from quadlake.llm.fingerprints import Sketch, fingerprints, paragraphs  # noqa: E402
from quadlake.llm.language_id import Model, fit, language_id  # noqa: E402
from quadlake.llm.line_dedup import line_dedup  # noqa: E402
from quadlake.llm.mixing import by_length, mix, uniform  # noqa: E402
from quadlake.llm.near_dedup import dart_minhash, near_dedup  # noqa: E402
from quadlake.llm.packing import Encoded, pack, pack_documents  # noqa: E402
from quadlake.llm.sharding import shard  # noqa: E402
from quadlake.llm.suffix_dedup import repeated_strings  # noqa: E402
from quadlake.llm.token_counts import Frequent, frequent_units, token_counts, units  # noqa: E402

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def test_token_counts(make, texts):
    t = Tokenizer.from_file(BYTE)
    got = {r.doc_id: r for r in token_counts(make(texts), BYTE, limit=100, table_size=50).collect()}
    for i, x in enumerate(texts):
        n = len(t.encode(x or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((x or "").encode()), n, n > 100), x[:80]
    assert token_counts(make([]), BYTE).count() == 0


def test_frequent_units_of_all_rows(make):
    rng = np.random.default_rng(2)
    words = [f"w{min(999, int(x))}" for x in rng.zipf(1.3, 30_000)]
    texts = [" ".join(words[i : i + 50]) for i in range(0, len(words), 50)] + [None, ""]
    with open(BYTE, encoding="utf-8") as f:
        spec = f.read()
    names, lengths = frequent_units(make(texts).repartition(4), "text", spec, 40)
    n = Counter(u for t in texts if t for u in units(t))
    t = Tokenizer.from_file(BYTE)
    assert lengths == [len(t.encode(u, add_special_tokens=False).ids) for u in names]
    assert {u for u, k in n.items() if k * 25 >= n.total()} <= set(names) <= {u for u, k in n.items() if k * 80 >= n.total()}
    assert frequent_units(make([]), "text", spec, 40) == ([], [])
    held = Frequent(100)
    for i in range(0, len(words), 50):
        held.add(words[i : i + 50])
        assert len(held) <= 100
    assert all(0 <= k - held[u] <= len(words) // 100 * 2 for u, k in Counter(words).items() if k > len(words) // 20)


def test_units_are_cut_where_the_pre_tokenizer_cuts(texts):
    t = Tokenizer.from_file(BYTE)
    rng = np.random.default_rng(1)
    for x in [x for x in texts if x][:20] + ["".join(rng.choice(list(" \n\ta.1é'"), 12)) for _ in range(3000)]:
        assert "".join(units(x)) == x
        assert sum(len(t.encode(u, add_special_tokens=False).ids) for u in units(x)) == len(t.encode(x, add_special_tokens=False).ids) or "<|" in x, repr(x)


def test_language_id(make):
    rng = np.random.default_rng(0)
    forms = {"aa": ["taka", "ruko", "pami", "lota"], "bb": ["schen", "burg", "licht", "wegs"], "cc": ["eau", "oix", "ieux", "ette"]}
    rows = []
    for i in range(300):
        lang = list(forms)[i % 3]
        rows.append((i, " ".join("".join(rng.choice(forms[lang], 2)) for _ in range(int(rng.integers(8, 60)))), lang if i % 5 else None, "s"))
    rows += [(300, None, "aa", "s"), (301, "12 34 !!", "bb", "s"), (302, "", "cc", "s"), (None, rows[0][1], "aa", "s")]
    docs = make(rows)
    model = fit(docs.where("doc_id < 200"), rows=150)
    got = docs.withColumn("f", language_id(docs, model)).select("doc_id", "lang", "f.*").collect()
    right = [r.lang_pred == list(forms)[r.doc_id % 3] for r in got if r.doc_id is not None and 200 <= r.doc_id < 300]
    assert np.mean(right) > 0.98
    assert all(0 <= r.score <= 1 for r in got)
    assert [(r.lang_pred, r.rejected) for r in got if r.doc_id in (300, 301, 302)] == [("und", True)] * 3
    assert sum(r.rejected for r in got if r.doc_id is None or r.doc_id < 300) == 0
    empty = make([])
    assert empty.withColumn("f", language_id(empty, fit(empty))).count() == 0


@pytest.mark.parametrize("length", [1500, 5000])
def test_language_of_unbroken_runs(make, length):
    """A text without blanks is judged by all its letters, not by the first ones."""
    rng = np.random.default_rng(1)
    forms = {"aa": ["taka", "ruko", "pami", "lota"], "bb": ["schen", "burg", "licht", "wegs"]}
    rows = [(i, " ".join("".join(rng.choice(forms[lang], 2)) for _ in range(30)), lang, "s") for i in range(200) for lang in [list(forms)[i % 2]]]
    model = fit(make(rows), rows=200)

    def run(lang, n):
        return "".join(rng.choice(forms[lang], n))[:n]

    tests = [(0, run("aa", 70) + run("bb", length), "bb", "s"), (1, run("bb", 70) + run("aa", length), "aa", "s"), (2, "1-".join(run("bb", length)), "bb", "s"), (3, "1" * 2 * length, None, "s")]
    docs = make(tests)
    got = docs.withColumn("f", language_id(docs, model)).select("doc_id", "f.lang_pred").collect()
    assert {r.doc_id: r.lang_pred for r in got} == {0: "bb", 1: "aa", 2: "bb", 3: "und"}


def test_subwords_of_long_runs_are_all_counted():
    from quadlake.llm.language_id import Model, Words, bag_of, subword_counts, subwords

    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 63, 64, 65, 200, 9000):
        word = "".join(rng.choice(list("abcñé中文字𐐨1-."), n))
        want = np.bincount(np.array(subwords(word, 32_768), np.int64), minlength=32_768)
        for block in (1, 2, 3, 50, 1 << 20):
            assert (subword_counts(word, 32_768, block) == want).all()
        ids, n = bag_of(word, 32_768)
        assert (np.bincount(ids, n, 32_768) == want).all() and (np.diff(ids.astype(int)) > 0).all()
        letters = sum(map(str.isalpha, word))
        assert want.sum() == (2 * letters + 2 if letters else 0)
        model = Model(["a", "b"], rng.normal(size=(32_768, 2)).astype(np.float32), np.zeros(2, np.float32))
        words = Words(model, 100_000)
        text = f"ab {word} cd {word}"
        everything = [s for w in text.split() for s in subwords(w.strip(".") or w, 32_768)]
        assert words.sums(text) == pytest.approx([*model.table[everything].sum(axis=0, dtype=np.float64), len(everything)], rel=1e-4, abs=1e-2)
        assert words.sums(text) == pytest.approx(words.sums(text)) and all(len(w) <= 64 for w in words)


@pytest.mark.parametrize("bucket_rows", [None, 3])
def test_exact_dedup(make, texts, bucket_rows):
    rows = [(i, x, "en", "s") for i, x in enumerate(texts)] + [(100 + i, "hot", "en", "s") for i in range(30)] + [(None, "hot", "en", "s"), (None, "n", "en", "s"), (500, "twice", "en", "s"), (500, "twice", "en", "s")]
    got = exact_dedup(make(rows), bucket_rows=bucket_rows).collect()
    groups = defaultdict(list)
    for d, x, *_ in rows:
        groups[x or ""].append(d)
    want = Counter()
    for x, ids in groups.items():
        best = max((i for i in ids if i is not None), default=None)
        for k, d in enumerate(sorted(ids, key=lambda i: (i is not None, i or 0), reverse=True)):
            want[d, best, len(ids), k == 0, sha(x)] += 1
    assert Counter(tuple(r) for r in got) == want
    assert exact_dedup(make([])).count() == 0


def test_directory_doubles():
    d = Directory.fitted({k: 10 for k in range(16)}, 4, 20)
    assert d.depth == 3 and len(d.slots) == 8 and len(set(d.slots)) == 8
    d = Directory.fitted({0: 50, 9: 1}, 4, 20)
    assert d.depth == 4 and len(d.slots) == 16 and len(set(d.slots)) == 5


def line_key(x):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))


def test_line_dedup(make, texts):
    texts = [*texts, *["keep\nÉCOLE Ä\n tail%d" % (i % 2) for i in range(6)], *["x\n école Ä\nécole ä"] * 3]
    found = defaultdict(set)
    for i, x in enumerate(texts):
        for line in (x or "").split("\n"):
            found[line_key(line)].add(i)
    out = {r.doc_id: r for r in line_dedup(make(texts), least=4, batches=3).collect()}
    for i, x in enumerate(texts):
        lines = (x or "").split("\n")
        stay = [a for a in lines if not line_key(a) or len(found[line_key(a)]) < 4]
        assert (out[i].n_lines, out[i].n_dropped, out[i].kept_text) == (len(lines), len(lines) - len(stay), "\n".join(stay))
    assert sum(r.n_dropped for r in out.values()) > 10
    assert line_dedup(make([])).count() == 0


def test_packing(make, texts):
    t = Tokenizer.from_file(WORD)
    size = 64
    texts = [*texts, "a <|EndOfText|> b", "x <|StartOfText|> y", "<|endoftext|> <|ENDOFTEXT|>!!$ ß Ÿ é × don't&&&'S", "<|startof <|STARTOFTEXT|><|startoftext|>"]
    got = pack_documents(make(texts), WORD, size=size).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    total = 0
    for i, x in enumerate(texts):
        want = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        own = sorted(by_doc[i], key=lambda r: r.start)
        assert b"".join(r.ids for r in own) == want
        assert all(r.doc_tokens == len(want) // 4 and r.length == len(r.ids) // 4 for r in own)
        total += len(want) // 4
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    assert len(by_seq) == -(-total // size)
    assert pack_documents(make([]), WORD).count() == 0
    again = pack_documents(make([(None, "one two", "en", "s"), (None, None, "en", "s"), (3, "x y z", "en", "s"), (3, "x y z", "en", "s")]), WORD).collect()
    assert Counter(r.doc_id for r in again) == {None: 2, 3: 2} and sorted(r.offset for r in again)[0] == 0 and len({r.sequence_id for r in again}) == 1


def test_packing_looks_up_each_word_once():
    """Case and marks make no new words, beyond ASCII too; each word is looked up once for all texts."""
    library = Tokenizer.from_file(WORD)
    encoded = Encoded(library, {"": b""}, 100_000)
    asked = []
    encoded.values_of = lambda names, own=encoded.values_of: asked.extend(names) or own(names)
    texts = ["Été, «ÉTÉ» (été)! straße:", "STRASSE été\tÉté?! Straße,straße\n\n", "", "été"] * 5
    assert list(encoded.ids(texts)) == [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert len(asked) == len(set(asked)) and {w for w in asked if w.isalpha()} == {"été", "straße", "strasse"}
    assert {w for w in encoded if any(c.isalpha() for c in w)} == {"été", "straße", "strasse"}


def test_packing_cuts_where_the_library_cuts(monkeypatch):
    """Mixed alphabets, combining marks, odd blanks, apostrophes and specials; small generations and blocks change nothing."""
    library = Tokenizer.from_file(WORD)
    rng = random.Random(8)
    latin = [chr(c) for c in range(256)]
    odd = [*"aeJgKcn.,!'<|>=-", "\u0301", "\u0338", "\u030c", "\u0345", "ſ", "İ", "ς", "Σ", "ﬁ", "क़", "だ", "\u3000", "\u2028", "\u00a0", "\x85", "\x1c", "😀", "Ⅷ", "²", " ", "\n", "'s", "'LL", "<|startoftext|>", "<|ENDOFTEXT|>", "<|"]
    texts = ["".join(rng.choices(latin if k % 2 else odd, k=rng.randrange(60))) for k in range(3000)]
    texts += ["".join(rng.choices("abcß é.,'7\n", k=40)) for _ in range(2000)] + ["é" * 300, "x" * 9000, "\r\x0b\x0c", "ab" * 40 + ","]
    want = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert list(Encoded(library, {"": b""}, 100_000).ids(texts)) == want
    monkeypatch.setattr("quadlake.llm.packing._BLOCK", 500)
    small = Encoded(library, {"": b""}, 400)
    assert list(small.ids(texts)) == want and len(small) <= 500
    small.last[:] = False
    assert list(small.ids(texts[-600:])) == want[-600:]


def test_pack_bulk():
    h = {7: 1000, 5: 400, 3: 100, 10: 5}
    slots = pack(h, 10)
    used = Counter()
    for s in slots:
        for k in range(s.n):
            used[s.sequence + k] += s.length
    assert max(used.values()) <= 10 and len(used) == -(-sum(k * n for k, n in h.items()) // 10)
    for length, n in h.items():
        ids = Counter()
        for s in slots:
            if s.of == length:
                for k in range(s.rank, s.rank + s.n):
                    ids.update((k, s.start + j) for j in range(s.length))
        assert len(ids) == length * n and max(ids.values()) == 1


def test_mixing(make):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 40))), "en", [None, "a", "b", "c", "d"][min(4, int(rng.integers(0, 9)))]) for i in range(2000)]
    rows += [(5000, None, "en", "a"), (None, "one two", "en", "a"), (5001, "t w", "en", "a"), (5001, "t w", "en", "a")]
    docs = make(rows)
    got = mix(docs).collect()
    assert sorted(map(str, got)) == sorted(map(str, mix(docs.repartition(7)).collect()))
    size = defaultdict(int)
    for _, x, _, s in rows:
        size[s] += len((x or "").split())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight, target, left = {s: [5, 2, 1][k % 3] for k, s in enumerate(order)}, {}, 1.5 * sum(size.values())
    free = set(order)
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 2 * size[s]]
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        for s in over:
            target[s] = 2.0 * size[s]
            left -= target[s]
            free.discard(s)
    taken = defaultdict(int)
    by = {size[s]: s for s in order}
    for r in got:
        s = by[r.source_size]
        assert r.target == pytest.approx(target[s]) and r.taken == r.copies * r.size <= 2 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 20 for s in order)
    assert mix(make([])).count() == 0
    assert mix(make([(1, None, "en", None)])).collect()[0].taken == 0


def test_sharding(make, texts):
    rows = [(i, f"{x} {i // 3}", "en", "s") for i in range(20) for x in texts[13:40]] + [(None, None, "en", "s"), (1, "", "en", "s"), (None, None, "en", "s")]
    got = shard(make(rows), shards=10).collect()
    assert len(got) == len(rows)
    size, slots, of = defaultdict(int), defaultdict(list), {}
    for r in got:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
        assert of.setdefault((r.text_crc32, r.size), r.shard) == r.shard
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert sorted(size) == list(range(10)) and max(size.values()) < 1.1 * min(size.values())
    want = Counter((d, len((x or "").encode()) + 16, zlib.crc32((x or "").encode())) for d, x, *_ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    assert shard(make([])).count() == 0


def test_sharding_of_one_text_many_times(make):
    """Repeated rows of one null id: one shard, and no part of its numbering has them all."""
    rows = [(None, "same text", "en", "s")] * 600 + [(i, f"text {i}", "en", "s") for i in range(50)]
    got = shard(make(rows), shards=4).collect()
    same = [r for r in got if r.doc_id is None]
    assert len({r.shard for r in same}) == 1
    for k in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))


def test_sketches_peel():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 2**63, 500).astype(np.uint64))
    a, b = keys[5:], keys[:-4]
    mine, theirs = Sketch(a, 24).minus(Sketch(b, 24))
    assert set(mine) == set(keys[-4:]) and set(theirs) == set(keys[:5])
    assert Sketch(keys, 24).minus(Sketch(keys[:100], 24)) is None


def test_fingerprints(make, texts):
    rows = [(3 * i % 101, x, "en", "s") for i, x in enumerate(texts)]
    got = {r.doc_id: r for r in fingerprints(make(rows), range_rows=7).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    prints = {}
    for k, (d, x, *_) in enumerate(order):
        x, follower = x or "", order[(k + 1) % len(order)][1] or ""
        n = len(x)
        edited = x[: n - n // 3] + follower[: n // 3]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (n, sha(edited))
        a, e, f = (set(paragraphs(t).tolist()) for t in (x, edited, follower))
        assert r.near_edited == pytest.approx(len(a & e) / len(a | e) if a | e else 1)
        assert r.near_next == pytest.approx(len(a & f) / len(a | f) if a | f else 1)
        assert prints.setdefault(x, r.fingerprint) == r.fingerprint
        assert (edited == x) == (r.edited_fingerprint == r.fingerprint)
    assert len(set(prints.values())) == len(prints)
    assert fingerprints(make([])).count() == 0
    assert fingerprints(make([(None, "a b c", "en", "s"), (None, None, "en", "s")])).count() == 2


def sets_of(x):
    w = (x or "").split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_near_dedup(make, texts):
    import random

    rng = random.Random(8)
    base = [f"v{rng.randrange(9000)}" for _ in range(150)]
    texts = list(texts)
    for i in range(25):  # a star: copies are near the first, less so each other
        w = list(base)
        for _ in range(3 if i else 0):
            w[rng.randrange(150)] = f"new{i}"
        texts.append(" ".join(w))
    rows = [(i, x, "en", "s") for i, x in enumerate(texts)] + [(7, texts[7], "en", "s"), (None, texts[20], "en", "s")]
    got = near_dedup(make(rows)).collect()
    sets = [sets_of(x) for _, x, *_ in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = (rows[i][1] or "") == (rows[j][1] or "")
            if same or (sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    members = defaultdict(list)
    for i, r in enumerate(rows):
        members[find(i)].append(r[0])
    want = Counter((d, min(x for x in ids if x is not None), len(ids)) for ids in members.values() for d in ids)
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in got) == want
    assert sum(r.kept for r in got) == len(members) and all(r.doc_id == r.class_id for r in got if r.kept)
    assert near_dedup(make([])).count() == 0


def copies_without_original(n, length, changed, seed):
    import random

    rng = random.Random(seed)
    base = [f"v{rng.randrange(9000)}" for _ in range(length)]
    out = []
    for i in range(n):
        w = list(base)
        for k in rng.sample(range(length), changed):
            w[k] = f"new{i}x{k}"
        out.append(" ".join(w))
    return out


def classes_by_force(texts):
    sets, parent = [sets_of(x) for x in texts], list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in range(len(texts))}


def test_near_dedup_of_copies_whose_original_is_absent(make):
    """Most pairs of a bucket sit just under or over the similarity, so leaders alone leave many classes."""
    texts = copies_without_original(300, 300, 4, 3) + copies_without_original(200, 200, 3, 5)
    got = {r.doc_id: r.class_id for r in near_dedup(make(texts)).collect()}
    assert got == classes_by_force(texts)


@pytest.mark.parametrize("rows", [2048, 7])
def test_merged_compares_all_blocks(spark, rows):
    """A bucket with one large class, several small ones and texts alone, dealt to one or many blocks."""
    from quadlake.llm.common import Scratch
    from quadlake.llm.near_dedup import merged

    rng = np.random.default_rng(4)
    base = np.arange(100)
    sets = {i: np.unique(np.concatenate([rng.permutation(base)[: 100 - i % 40], 1000 * (i + 1) + np.arange(i % 9)])).astype("<u4") for i in range(90)}
    label = {i: 0 if i < 40 else 40 if i < 50 else i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    labels = spark.createDataFrame([(i, label[i]) for i in range(50)], "node long, label long")
    members = spark.createDataFrame([(7, i) for i in sets], "key long, node long")
    table = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in sets.items()], "node long, set binary")
    got = {r.node: r.label for r in merged(members, labels, table, Scratch(spark, "test"), 0.8, block_rows=rows).collect()}
    for i in sets:
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                label[max(find(i), find(j))] = min(find(i), find(j))
    assert {i: got.get(i, i) for i in sets} == {i: find(i) for i in sets} and 1 < len(set(map(find, sets))) < 40


def test_dart_minhash_estimates_weighted_jaccard():
    keys = np.arange(1, 61, dtype=np.uint64) * np.uint64(7919)
    a, b = np.arange(60) % 4 + 1, (np.arange(60) % 3) + 1
    same = dart_minhash(keys, a, 4000) == dart_minhash(keys, b, 4000)
    assert same.mean() == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.03)
    short, long = keys[:3], keys
    same = dart_minhash(short, np.ones(3, int), 4000) == dart_minhash(long, np.ones(60, int), 4000)
    assert same.mean() == pytest.approx(0.05, abs=0.012)


def removed_by_force(rows):
    data = [(d if d is not None else 1 << 62, (x or "").encode()) for d, x in rows]
    first: dict = {}
    for d, b in data:
        for i in range(len(b) - 49):
            s = b[i : i + 50]
            first[s] = min(first.get(s, 1 << 63), d)
    out = []
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        out.append((len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    return out


@pytest.mark.parametrize("block", [1 << 20, 997])
def test_repeated_strings(make, texts, block, monkeypatch):
    from quadlake.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "_BLOCK", block)
    rows = [(i * 37 % 101, (x or "")[:9000] if x else x) for i, x in enumerate(texts)]
    rows += [(200 + i, ("pre%d " % i) + "q" * (48 + i) + " post %d" % (i % 2)) for i in range(6)] + [(None, rows[20][1]), (None, rows[20][1]), (201, rows[21][1]), (201, rows[21][1])]
    got = repeated_strings(make([(d, x, "en", "s") for d, x in rows])).collect()
    want = Counter((d, *w) for (d, _), w in zip(rows, removed_by_force(rows), strict=True))
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, sha(bytes(r.kept))) for r in got) == want
    assert repeated_strings(make([])).count() == 0


def test_line_dedup_with_clashing_columns(spark):
    rows = [(None if i % 3 == 0 else 7, "same\nown %d" % i if i else None, i, "t", "h") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id long, __t1 string, h1 string")
    got = line_dedup(docs, least=10)
    assert got.columns == ["doc_id", "text", "_id", "__t1", "h1", "n_lines", "n_dropped", "kept_text"]
    assert {r["_id"]: (r.n_dropped, r.kept_text) for r in got.collect()} == {i: (1, "own %d" % i) if i else (0, "") for i in range(12)}


def test_language_sums_do_not_depend_on_the_cache():
    from quadlake.llm.language_id import Model, Words

    rng = np.random.default_rng(7)
    model = Model(["a", "b"], rng.normal(size=(32_768, 2)).astype(np.float32), np.zeros(2, np.float32))
    texts = [" ".join("".join(rng.choice(list("abcde中文é"), 6)) + "." for _ in range(40)) for _ in range(30)]
    small, large = Words(model, 50), Words(model, 100_000)
    for t in texts * 2:
        assert small.sums(t) == pytest.approx(large.sums(t), rel=1e-6, abs=1e-3)
        assert len(small) <= 50


def test_mix_carries_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "s"), (1, "a b c d", "t"), (None, None, None), (None, "x y", "s")], "doc_id long, text string, source string")
    got = mix(docs, carry=("doc_id", "text", "source")).collect()
    assert Counter((r.row.doc_id, r.row.text, r.row.source) for r in got) == Counter(map(tuple, docs.collect()))
    assert all(r.size == len((r.row.text or "").split()) and r.doc_id == r.row.doc_id for r in got)


def test_mix_cuts_hot_ids(spark):
    """Sources of one id or of one row over and over meet their targets in any size of cells, and reruns agree."""
    rows = [(None, "w " * (k % 17), "a") for k in range(300)] + [(7, "x y z", "b")] * 200 + [(k, "v " * (k % 31), None) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    runs = [mix(d, priority=by_length(F.col("text")), few=few).collect() for d, few in ((docs, 100_000), (docs.repartition(5), 3))]
    assert sorted(map(str, runs[0])) == sorted(map(str, runs[1])) and len(runs[0]) == len(rows)
    taken = defaultdict(int)
    for r in runs[1]:
        taken[r.source_size, r.target] += r.taken
    assert len(taken) == 3 and all(abs(n - target) <= 15 for (_, target), n in taken.items())


def test_mix_by_random_odds_over_inclusion_odds(spark):
    """Without whole copies, the documents with the least random odds over their priority are taken, so high ones come oftener."""
    docs = spark.createDataFrame([(k, "a b", "s", 1.0 + 9 * (k % 2)) for k in range(4000)], "doc_id long, text string, source string, p double")
    got = {r.doc_id: r.copies for r in mix(docs, share=0.5, priority=F.col("p")).collect()}
    u = {r.doc_id: r.u for r in docs.select("doc_id", uniform(F.col("doc_id"), 17).alias("u")).collect()}
    order = sorted(u, key=lambda k: u[k] / (1 - u[k]) / (1 + 9 * (k % 2)))
    assert {k for k, n in got.items() if n} == set(order[:2000]) and max(got.values()) == 1
    assert 3 < sum(got[k] for k in got if k % 2) / sum(got[k] for k in got if not k % 2) < 10


def test_repeated_strings_with_hot_ids_and_a_long_text(spark):
    """Null and repeated ids, string ids, a text of a megabyte, and texts of one byte over and over."""
    rng = np.random.default_rng(11)
    long = "".join(rng.choice(list("abcdefghij "), 1_000_000))
    rows = [(None, long[k * 1000 : k * 1000 + 300]) for k in range(40)] + [(5, long[500_000:500_200]), (5, long[500_100:500_400]), (9, long), (3, "z" * 500), (8, "z" * 70 + "y" * 60), (7, "z" * 49)]
    for kind in ("long", "string"):
        own = [(d if kind == "long" or d is None else f"{d:03d}", x) for d, x in rows]
        got = repeated_strings(spark.createDataFrame(own, f"doc_id {kind}, text string")).collect()
        want = Counter((o[0], *w) for o, w in zip(own, removed_by_force(rows), strict=True))
        assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, sha(bytes(r.kept))) for r in got) == want


def test_texts_without_blanks_have_paragraphs(make):
    rng = np.random.default_rng(5)
    texts = ["".join(map(chr, rng.integers(0x4E00, 0x9000, 3000))) for _ in range(3)] + ["\t".join(map(str, rng.integers(0, 99, 900)))]
    got = fingerprints(make(texts)).collect()
    assert all(r.n_paragraphs > 20 and r.near_edited > 0.3 and r.near_next < 0.2 for r in got)


def test_two_tokenizer_files_in_one_session(make, texts, tmp_path):
    """Workers are used again: what they keep of one file must not answer for another."""
    docs, other = make(texts), tmp_path / "letters.json"
    with open(BYTE, encoding="utf-8") as f:
        spec = json.load(f)
    spec["model"]["merges"] = spec["model"]["merges"][:20]
    other.write_text(json.dumps(spec))
    want = {f: sorted(len(Tokenizer.from_file(f).encode(t or "", add_special_tokens=False).ids) for t in texts) for f in (BYTE, str(other))}
    assert want[BYTE] != want[str(other)]
    for _ in range(3):
        for f in want:
            assert sorted(r["n_tokens"] for r in token_counts(docs, f).collect()) == want[f]


def test_two_language_models_in_one_session(make):
    one, two = (Model(["a", "b"], np.full((64, 2), x, np.float32), np.array([x, -x], np.float32) * 0) for x in (1.0, 2.0))
    one.table[:, 0] += 5
    two.table[:, 1] += 5
    docs = make(["some words here", "and others"])
    for _ in range(3):
        for model, best in ((one, "a"), (two, "b")):
            assert [r["p"]["lang_pred"] for r in docs.select(language_id(docs, model).alias("p")).collect()] == [best, best]


def test_every_letter_before_every_mark():
    """A letter whose normal form ends in a combining mark is not parted from the mark that follows."""
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    encoded = Encoded(library, {"": b""}, 100_000)
    letters = [chr(c) for c in range(1, 0x20000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()]
    wrong = []
    for i in range(0, len(letters), 50):
        text = " ".join(f"a{c}{m}" for c in letters[i : i + 50] for m in ".,!?;:&$*%#")
        if next(encoded.ids([text])) != np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes():
            wrong.append(letters[i])
    assert not wrong
