import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens long, label string, shard int, page int, h long"


@pytest.fixture(scope="session")
def make(spark):
    """Texts (or (doc_id, text, lang, source)) to a documents table with extra columns whose names the operators use too."""

    def table(rows):
        full = []
        for i, r in enumerate(rows):
            doc, text, lang, source = r if isinstance(r, tuple) else (i, r, "en", "s")
            full.append((doc, text, lang, source, len(text or ""), -1, "x", -2, -3, -4))
        return spark.createDataFrame(full, SCHEMA)

    return table


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Nulls, empty and long texts, copies, near copies, shared lines and passages, and odd blanks."""
    rng = random.Random(4)
    passage = words(rng, 40)
    out = [None, "", " ", "\n", "a", "é" * 70, "x" * 400, "ab" * 300, "  two  blanks\n\n\nand\tmore  ", "<|endoftext|> inside<|endoftext|>\n\n", "Ünïcode ¡text! 12345 don't\x1cstop ", None, ""]
    for i in range(40):
        t = words(rng, rng.randrange(3, 200), 60 if i % 7 == 0 else 4000)
        if i % 3 == 0:
            t = t[: len(t) // 2] + " " + passage + " " + t[len(t) // 2 :]
        if i % 4 == 0:
            t = t.replace(" ", "\n", 3) + "\nShared Line \n" + words(rng, 5)
        out.append(t)
    out += [out[20], out[20], out[21] + " tail", out[22].replace("w1", "W1")]
    out.append(words(rng, 30_000, 5000))
    return out
