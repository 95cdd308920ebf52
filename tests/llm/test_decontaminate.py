"""Winnowing against all windows."""

import random
import re

from spanloom.llm import decontaminate


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, span=10):
    windows = {}
    for id_, text in items:
        w = words(text)
        t = min(span, len(w))
        for i in range(len(w) - t + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + t]), set()).add(id_)
    lengths = {len(x) for x in windows}
    out = []
    for id_, text in docs:
        w, hit, found = words(text), set(), set()
        for t in lengths:
            for i in range(len(w) - t + 1):
                if (ids := windows.get(tuple(w[i : i + t]))) is not None:
                    hit |= set(range(i, i + t))
                    found |= ids
        out.append((id_, len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return out


def run(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as t", "'x' as n_words", "null as hits")
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "2 as window")
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], list(r["items"])) for r in decontaminate.contamination(d, i).collect()), key=key), key


def test_against_all_windows(spark):
    rnd = random.Random(3)
    vocabulary = ["a", "b", "Ära", "C3", "déjà", "xyz", "the"] + [f"w{i}" for i in range(60)]
    text = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [(i, text(rnd.choice([3, 5, 6, 8, 9, 10, 11, 12, 30, 60]))) for i in range(40)]
    items += [(40, items[3][1]), (3, items[4][1]), (41, ["a"] * 30), (42, items[9][1][:2] * 8)]
    docs = [(1, None), (2, ""), (3, "..!"), (None, "a"), (4, "a " * 50)]
    for i in range(150):
        parts = text(rnd.randint(0, 60))
        for _ in range(rnd.randint(0, 3)):
            w = rnd.choice(items)[1]
            a = rnd.randrange(len(w))
            at = rnd.randint(0, len(parts))
            parts[at:at] = w[a : a + rnd.randint(1, 40)]
        docs.append((100 + i, rnd.choice([" ", ", ", "\n"]).join(parts).title()))
    docs += docs[20:25]
    items = [(i, rnd.choice([" ", "-"]).join(w)) for i, w in items] + [(None, "w1 w2 w3"), (77, None), (78, "?!")]
    got, key = run(spark, docs, items)
    assert got == sorted(brute(docs, items), key=key)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b c")])[0] == []
    assert run(spark, [(1, "a b c")], [])[0] == [(1, 3, 0, [])]
