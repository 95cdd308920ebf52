"""Later passages against a dictionary of all windows."""

import random
import re

import pytest

from spanloom.llm import covers

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, span):
    words = [(covers.NO_ID if i is None else i, _WORD.findall(t or "")) for i, t in rows]
    least = {}
    for i, w in words:
        for a in range(len(w) - span + 1):
            key = tuple(w[a : a + span])
            least[key] = min(least.get(key, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for a in range(len(w) - span + 1):
            if least[tuple(w[a : a + span])] < i:
                gone[a : a + span] = [True] * span
        spans, a = [], 0
        while a < len(w):
            if gone[a]:
                b = a
                while b < len(w) and gone[b]:
                    b += 1
                spans.append((a, b))
                a = b
            else:
                a += 1
        out.append((len(w), sum(gone), spans, " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def check(spark, rows, span=13):
    docs = spark.createDataFrame([(i, t, n, "x") for n, (i, t) in enumerate(rows)], "doc_id long, text string, k int, doc string")
    got = covers.remove_later(docs, span).collect()
    got = sorted((r["row"]["k"], r["n_words"], r["n_removed"], [tuple(s) for s in r["spans"]], r["kept"]) for r in got)
    assert got == [(n, *w) for n, w in enumerate(brute(rows, span))]


def test_every_distance_modulo_a_period_is_covered():
    for period, cover in covers.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


@pytest.mark.parametrize("span", [13, 7, 30])
def test_random_passages(spark, span):
    rnd = random.Random(span)
    words = ["".join(rnd.choice("abcé") for _ in range(rnd.randint(1, 3))) for _ in range(400)]
    text = lambda n: [rnd.choice(words) for _ in range(n)]
    passages = [text(40) for _ in range(8)]
    rows = [(7, None), (None, ""), (3, " \t\n "), (4, "one two"), (5, "a " * 60), (6, "a " * 60), (9, "a b " * 30)]
    for i in range(150):
        parts = [text(rnd.randint(0, 25)) for _ in range(4)]
        for at in (1, 3):
            if rnd.random() < 0.6:
                p = rnd.choice(passages)
                a = rnd.randint(0, 20)
                parts.insert(at, p[a : a + rnd.randint(5, 20)])
        joined = rnd.choice([" ", "\n", " \t "]).join(w for p in parts for w in p)
        rows.append((rnd.choice([i, i, i, 10, None]), joined))
    rows += [(500, rows[20][1]), (501, rows[20][1]), (501, rows[20][1]), (20, rows[30][1])]
    rnd.shuffle(rows)
    check(spark, rows, span)


def test_one_passage_in_most_documents_and_a_full_bit_table(spark, monkeypatch):
    rnd = random.Random(1)
    passage = " ".join(f"w{i}" for i in range(30))
    rows = [(i, f"{rnd.random()} {passage} {'x ' * (i % 9)}{rnd.random()}") for i in range(800)]
    check(spark, rows)
    monkeypatch.setattr(covers, "TABLE_BITS", 10)
    check(spark, rows[:200] + [(1000 + i, " ".join(str(rnd.random()) for _ in range(50))) for i in range(40)])


def test_very_long_text(spark):
    rnd = random.Random(2)
    long = " ".join(str(rnd.randint(0, 10**6)) for _ in range(400_000))
    cut = long[100_000:101_000].split(" ", 1)[1].rsplit(" ", 1)[0]
    check(spark, [(1, cut), (2, long), (3, "end")])


def test_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, wins int")
    assert covers.remove_later(empty).collect() == []
