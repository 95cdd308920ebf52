"""Counts against a plain search over all cuts."""

import math
import random

import public_tokenizers
import regex

from spanloom.llm import tokencount
from spanloom.llm.bpe import read_ranks

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def brute(text, scores):
    total, n = 0.0, 0
    for word in regex.findall(public_tokenizers.PATTERN, text):
        raw = word.encode()
        best = [(0.0, 0)] + [None] * len(raw)
        for end in range(1, len(raw) + 1):
            ways = [(best[b][0] + scores[raw[b:end]], -best[b][1] - 1) for b in range(end) if raw[b:end] in scores]
            top = max(ways)
            best[end] = (top[0], -top[1])
        total, n = total + best[-1][0], n + best[-1][1]
    return n, total


def test_against_all_cuts(spark):
    rnd = random.Random(6)
    words = ["the", "théâtre", "12345", "don't", "x" * 40, "tionerth", "ung", "  ", "\n", "日本語", "...!?"]
    texts = [None, "", " ", "a\n\n b"] + [" ".join(rnd.choice(words) + rnd.choice(["", "s", "en", ","]) for _ in range(rnd.randint(1, 40))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, "x", 1.5) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string, score double")
    got = {r["row"]["doc_id"]: (r["n_tokens"], r["score"]) for r in tokencount.token_counts(docs, PATH, public_tokenizers.PATTERN).collect()}
    scores = tokencount.Counter(read_ranks(PATH), public_tokenizers.PATTERN).scores
    assert abs(sum(map(math.exp, scores.values())) - 1) < 1e-9
    for i, t in enumerate(texts):
        n, total = brute(t or "", scores)
        assert got[i][0] == n and abs(got[i][1] - total) < 1e-6
    assert tokencount.token_counts(docs.limit(0), PATH, public_tokenizers.PATTERN).collect() == []
