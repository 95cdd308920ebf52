"""Token counts under a unigram vocabulary, with a trie of pre-tokens.

Each task puts the distinct pre-tokens of a run of documents into a trie, byte by byte,
by walking them in sorted order, where neighbours share their prefixes. A trie node has
the forward score of its prefix: the best sum of token scores over all ways to cut it
into tokens, with the number of tokens of that way. A node is computed once however
many pre-tokens begin with it; where a pre-token ends, its count is stored. Documents
add up the counts of their pre-tokens.

Scores are log-probabilities by Zipf's law over the ranks of a byte-level vocabulary,
in which every byte is a token, so each text can be cut. Of equally good cuts the one
with fewer tokens counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.bpe import _runs, grouped, read_ranks
from spanloom.llm.rows import others

CACHE_WORDS = 600_000
#: Added to ranks, so that the first tokens do not outweigh all.
OFFSET = 10.0


class Counter:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        total = np.log(np.sum(1 / (np.arange(len(ranks)) + OFFSET)))
        self.scores = {t: float(-np.log(r + OFFSET) - total) for t, r in ranks.items()}
        self.longest = max(map(len, ranks))
        self.split = regex.compile(pattern).findall
        self.edge = regex.compile(r"^\s|\s$|^$").search
        #: Terminal counts and scores of known pieces; ``old`` has the generation before.
        self.known: dict[str, tuple[int, float]] = {}
        self.old: dict[str, tuple[int, float]] = {}

    def terminals(self, words: list[bytes]) -> dict[bytes, tuple[int, float]]:
        """(tokens, score) of each word, over the trie of all of them."""
        out: dict[bytes, tuple[int, float]] = {}
        best, count = [0.0], [0]
        last = b""
        scores, longest = self.scores.get, self.longest
        for word in sorted(set(words)):
            shared = 0
            for a, b in zip(word, last):
                if a != b:
                    break
                shared += 1
            del best[shared + 1 :], count[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                top, n = -1e300, 0
                for begin in range(max(0, end - longest), end):
                    s = scores(word[begin:end])
                    if s is not None:
                        s += best[begin]
                        if s > top or (s == top and count[begin] < n - 1):
                            top, n = s, count[begin] + 1
                best.append(top)
                count.append(n)
            out[word] = (count[-1], best[-1])
            last = word
        return out

    def learn(self, texts: list[str]) -> list[list[str]]:
        """The pieces of each text, all of them known. No pre-token reaches over a single
        space between two other characters, so texts fall apart at these."""
        if len(self.known) > CACHE_WORDS // 2:
            self.old, self.known = self.known, {}
        pieces = []
        for x in texts:
            part = x.split(" ")
            part[1:] = [" " + p for p in part[1:]]
            pieces.append(part)
        # Known pieces too: that ' ' is known says nothing of a text with three in a row.
        odd = {x for x in set().union(*pieces) if not (x[-1:].isalnum() and x[1:2].isalnum()) and self.edge(x.removeprefix(" "))}
        if odd:
            pieces = [p if odd.isdisjoint(p) else grouped(p, odd) for p in pieces]
        fresh = self._fresh(pieces)
        cut = {x: [p.encode("utf-8", "surrogatepass") for p in self.split(x)] for x in fresh}
        done = self.terminals([p for part in cut.values() for p in part])
        for x, part in cut.items():
            self.known[x] = done[part[0]] if len(part) == 1 else (sum(done[p][0] for p in part), sum(done[p][1] for p in part))
        return pieces

    def _fresh(self, pieces: list[list[str]]) -> set[str]:
        fresh = set().union(*pieces).difference(self.known)
        for x in fresh & self.old.keys():
            self.known[x] = self.old[x]
        return fresh - self.old.keys()

    def count(self, texts: list[str]) -> list[tuple[int, float]]:
        out = []
        for part in self.learn(texts):
            n, score = 0, 0.0
            for a, b in map(self.known.__getitem__, part):
                n += a
                score += b
            out.append((n, score))
        return out


@lru_cache(2)
def _counter(path: str, pattern: str) -> Counter:
    return Counter(read_ranks(path), pattern)


def token_counts(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """All other columns of ``docs`` in ``row``, with ``n_tokens`` and ``score`` (the
    summed log-probability of the best cut).

    ``path`` is a rank file on every executor. Null and empty texts have no tokens and
    score 0. Repeated rows stay.
    """
    given = docs.select(others(docs, text_col), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            got: list[tuple[int, float]] = []
            for first, end in _runs(texts):
                got += _counter(path, pattern).count(texts[first:end])
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.float64())], names=["row", "n_tokens", "score"]
            )

    schema = T.StructType([given.schema["row"], T.StructField("n_tokens", T.LongType()), T.StructField("score", T.DoubleType())])
    return given.mapInArrow(work, schema)
