"""Repeats against a dictionary of all strings."""

import random
from collections import Counter

from spanloom.llm import repeats


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(x[i : i + length] for x in raw for i in range(len(x) - length + 1))
    out = []
    for x in raw:
        gone = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((len(x), sum(gone), spans, bytes(b for b, g in zip(x, gone) if not g)))
    return out


def check(spark, texts, length, gram):
    docs = spark.createDataFrame([(i if i % 5 else None, t, "x", i) for i, t in enumerate(texts)], "doc_id long, text string, k1 string, row int")
    got = repeats.remove_repeats(docs, length, gram).collect()
    want = brute(texts, length)
    assert sorted((r["row"]["row"], r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in got) == sorted((i, *w) for i, w in enumerate(want))


def test_random_passages(spark):
    rnd = random.Random(7)
    words = ["".join(rnd.choice("abcdeé ") for _ in range(rnd.randint(2, 9))) for _ in range(300)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passages = [text(30) for _ in range(6)]
    texts = [None, "", "short", "a" * 700, "ab" * 400, "ab" * 300 + "c"]
    for _ in range(120):
        parts = [text(rnd.randint(0, 40)) for _ in range(3)]
        if rnd.random() < 0.5:
            p = rnd.choice(passages)
            cut = rnd.randint(0, len(p) // 2)
            parts.insert(1, p[cut : cut + rnd.randint(40, 200)])
        texts.append(" ".join(parts))
    texts += [t[: len(t) // 2] + "#" + t[len(t) // 2 + 1 :] for t in texts[10:40]] + texts[50:60] + texts[50:55]
    check(spark, texts, 100, 41)
    check(spark, texts, 200, 41)


def test_empty_and_no_repeats(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.remove_repeats(docs).collect() == []
    check(spark, ["x" * 199, "y" * 50, None], 200, 41)
