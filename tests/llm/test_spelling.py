"""Variants against edits tried one by one."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from spanloom.llm import spelling


def brute_words(rows, noise=97):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= 3}


def brute(n):
    alphabet = [chr(c) for c in spelling.LETTERS]

    def around(w):
        out = {w[:i] + w[i + 1 :] for i in range(len(w))}
        out |= {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in alphabet}
        out |= {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in alphabet}
        return [x for x in out - {w} if x in n]

    near = {w: around(w) for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n[w], len(near[w]), form[w], form[w] and n[form[w]], root))
    return sorted(out)


def words_like(rnd, count, letters="abcé", sizes=(5, 9)):
    return {"".join(rnd.choice(letters) for _ in range(rnd.randint(*sizes))): rnd.randint(3, 60) for _ in range(count)}


def got(spark, n):
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    return sorted(tuple(r) for r in spelling.variants(df).select("word", "n", "n_near", "form", "form_n", "root").collect())


@pytest.mark.parametrize("tile", [spelling.TILE, 7])
def test_variants_are_those_of_all_edits(spark, monkeypatch, tile):
    monkeypatch.setattr(spelling, "TILE", tile)
    n = words_like(random.Random(3), 900) | words_like(random.Random(4), 300, "xyzÿ÷", (5, 6))
    n |= {"chain": 400, "chains": 200, "chainss": 100, "chaainss": 50, "chaainsss": 25, "z" * 5000: 9, "z" * 5001: 30}
    assert got(spark, n) == brute(n)


def test_small_pieces_of_a_block(monkeypatch):
    rnd = np.random.default_rng(5)
    short, long = (np.unique(rnd.integers(97, 100, (150, w), dtype=np.uint8), axis=0) for w in (5, 6))
    pairs = lambda: sorted((*p, kind) for i, j, kind in spelling.near_pairs(short, long) for p in zip(i.tolist(), j.tolist(), strict=True))
    whole = pairs()
    monkeypatch.setattr(spelling, "CELLS", 64)
    assert whole == pairs()
    gone = lambda w: {w[:i] + w[i + 1 :] for i in range(6)}
    a, b = [bytes(x) for x in short], [bytes(x) for x in long]
    want = [(i, j, True) for i, x in enumerate(a) for j, y in enumerate(b) if x in gone(y)]
    want += [(i, j, False) for i, x in enumerate(b) for j, y in enumerate(b) if i < j and sum(p != q for p, q in zip(x, y, strict=True)) == 1]
    assert whole == sorted(want)


def test_vocabulary(spark):
    rnd = random.Random(6)
    words = ["Maison", "maisons", "ÉCOLE", "école", "straße", "abc", "naïveté", "ALPHA", "don't", "x" * 300]
    rows = [(i if i % 7 else None, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 60)))) for i in range(300)]
    rows += [(1, None), (None, None), (2, ""), (3, "1234 ...")] + rows[:20]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    for noise in (97, 2):
        assert {r["word"]: r["n"] for r in spelling.vocabulary(docs, noise=noise).collect()} == brute_words(rows, noise)


def test_no_words_and_no_circles(spark):
    assert got(spark, {"lonely": 5}) == [("lonely", 5, 0, None, None, "lonely")]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(spelling.vocabulary(empty)).collect() == []
    with pytest.raises(ValueError):
        spelling.variants(empty, ratio=1)
