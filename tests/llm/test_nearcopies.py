"""Near copies against all pairs of bags."""

import random
import re
from collections import Counter

import numpy as np

from spanloom.llm import nearcopies


def bag(text, width=5):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return Counter(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else Counter()


def similarity(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def brute(texts, least=0.8):
    bags = [bag(t) for t in texts]
    up = list(range(len(texts)))
    find = lambda i: i if up[i] == i else find(up[i])
    for i in range(len(texts)):
        for j in range(i):
            if bags[i] and similarity(bags[i], bags[j]) >= least:
                up[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def test_classes_are_those_of_all_pairs(spark):
    rnd = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    texts = [None, "", "... !", "one two", "One, two.", "12", "a b a b a b a b a b a b", "a b a b a b a b a b a b a b"]
    for _ in range(25):
        base = text(rnd.choice([6, 20, 80, 300]))
        for _ in range(rnd.randint(1, 6)):
            copy = list(base)
            for _ in range(rnd.randint(0, max(1, len(copy) // 25))):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            texts.append(" ".join(copy))
    base = text(60)
    for i in range(150):  # one large group; some are only linked by way of others
        copy = list(base)
        for _ in range(i % 4):
            copy[rnd.randrange(60)] = "x"
        texts.append(" ".join(copy))
    repeated = ["again " * 300, "again " * 290, "again " * 100]
    texts += repeated
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, n int, band int")
    got = {r["doc_id"]: r for r in nearcopies.near_copies(docs).collect()}
    want = brute(texts)
    assert [got[i]["class_id"] for i in range(len(texts))] == want
    assert all(got[i]["stays"] == (want[i] == i) and got[i]["n_class"] == want.count(want[i]) for i in got)


def test_one_template_near_the_bound(spark, monkeypatch):
    """Many texts of one template, most at 0.75 to 0.85 of each other; edits repeat."""
    rnd = random.Random(3)
    base = [f"w{i}" for i in range(80)]
    texts = [" ".join(base)]
    for _ in range(900):
        copy = list(base)
        for _ in range(rnd.choice([1, 2, 2, 3, 3, 4])):
            copy[rnd.choice([rnd.randrange(80), 7, 40, 41, 63])] = rnd.choice(["x", "y", f"z{rnd.randrange(9999)}"])
        texts.append(" ".join(copy))
    for i in range(300):  # a second template, only distantly the first
        copy = base[:50] + [f"v{j}" for j in range(30)]
        for _ in range(i % 5):
            copy[rnd.randrange(80)] = f"u{rnd.randrange(40)}"
        texts.append(" ".join(copy))
    compared, true_links = [], nearcopies._links

    def counted(pairs, bags, least):
        compared.append(pairs.count())
        return true_links(pairs, bags, least)

    monkeypatch.setattr(nearcopies, "_links", counted)
    monkeypatch.setattr(nearcopies, "SMALL", 8)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in nearcopies.near_copies(docs).collect()}
    want = brute(texts)
    print("pairs compared", compared, "of", len(texts) * (len(texts) - 1) // 2, "classes", len(set(want)))
    assert [got[i] for i in range(len(texts))] == want
    assert sum(compared) < 30 * len(texts)


def test_bags_of_inner_groups_are_not_unfolded_again(spark, monkeypatch):
    rnd = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(400):
        copy = list(base)
        for _ in range(rnd.choice([2, 3, 3])):
            copy[rnd.choice([7, 20, 33, 46, rnd.randrange(60)])] = rnd.choice(["x", "y", f"z{rnd.randrange(9999)}"])
        texts.append(" ".join(copy))
    unfolded, inner, first, within = [], [], nearcopies._differences, nearcopies._inner_differences

    def counted(groups, bags, least):
        unfolded.append(1)
        return first(groups, bags, least)

    def checked(groups, diffs, least):
        got = within(groups, diffs, least)
        inner.append((groups.collect(), diffs.collect(), got.collect()))
        return got

    monkeypatch.setattr(nearcopies, "_differences", counted)
    monkeypatch.setattr(nearcopies, "_inner_differences", checked)
    monkeypatch.setattr(nearcopies, "SMALL", 4)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in nearcopies.near_copies(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)
    assert len(unfolded) == 1 and inner
    for groups, before, after in inner:
        old = {(r["g"], r["node"]): r for r in before}
        up = {(r["g"], r["node"]): r["p"] for r in groups}
        assert len(after) == len(up)
        centre = {}
        for r in after:
            was = old[up[r["g"], r["node"]], r["node"]]
            # Either centre less what a bag lacks, and what it has besides, is the bag.
            assert r["m"] - len(r["d"]) + len(r["o"]) == was["m"] - len(was["d"]) + len(was["o"])
            moved = (set(r["d"]) | set(r["o"])) ^ (set(was["d"]) | set(was["o"]))
            assert centre.setdefault(r["g"], moved) == moved


def test_signatures_estimate_the_similarity():
    rnd = random.Random(5)
    texts = []
    for _ in range(40):
        a = [rnd.choice("abcdefgh") for _ in range(200)]
        b = a[: rnd.randint(50, 200)] + [rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 60))]
        texts += [" ".join(a), " ".join(b)]
    raw = [t.encode() for t in texts]
    at = np.cumsum([0] + [len(x) for x in raw])
    text, h, weight = nearcopies.shingles(np.frombuffer(b"".join(raw), np.uint8), at, 2)
    signs = nearcopies.signatures(text, h, weight, len(texts))
    errors = [(signs[i] == signs[i + 1]).mean() - similarity(bag(texts[i], 2), bag(texts[i + 1], 2)) for i in range(0, len(texts), 2)]
    assert abs(np.mean(errors)) < 0.02 and max(map(abs, errors)) < 0.2


def test_empty_table_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert nearcopies.near_copies(spark.createDataFrame([], schema)).collect() == []
    same = "the same words in the same order"
    got = nearcopies.near_copies(spark.createDataFrame([(1, same), (1, same), (None, same), (None, None), (None, None)], schema)).collect()
    assert sorted((r["class_id"], r["n_class"], r["stays"]) for r in got if r["class_id"]) == [(1, 3, False), (1, 3, True), (1, 3, True)]
