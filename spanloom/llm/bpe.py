"""Byte-level BPE encoding and decoding with recursive DuckDB queries in each task.

A task collects the distinct pre-tokens of a run of documents and hands them to
DuckDB as token-position rows, one per byte. A recursive query joins neighbours with
the merge table and contracts the leftmost pair of minimum rank in each word until no
pair of any word is in the table. Decoding joins the ids with the vocabulary and puts
the bytes together in the order of the ids. Documents are then made of their words:
words are numbers, and ids and bytes of all known words two arrays.

Memory is bounded by the run of documents and by ``CACHE_WORDS`` known words, which
only save work and are forgotten when the task ends. DuckDB gets words in slices of
bounded size, however many are new. Long words go through the same query with all non-overlapping
occurrences of the minimum pair contracted at once, and a bounded number of rounds for
each query, so that a text without spaces needs neither as many rounds as it has bytes
nor all the rounds in memory. Contracting several occurrences of one pair at once is
the same as one after the other, since each token of these vocabularies is what its
own bytes merge into (tested).

Words longer than ``PART`` are coded in parts that overlap. Under the same condition
tokens in a row are the code of their bytes if each two neighbours are the code of
theirs, so two parts are put together where both have a token end and the two tokens
there stay apart. Where there is no such place, the next part is coded again from a
token end before, the further back the more often that fails; only then can a query
get more than a slice, and DuckDB may spill to the worker's temp folder.
"""

from __future__ import annotations

import base64
import os
import tempfile
from array import array
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.rows import as_bytes, others

RUN_BYTES = 4 << 20
CACHE_WORDS = 300_000
LONG_WORD = 64
ROUNDS = 48
#: Bytes of short words, and of long ones (whose rounds are all in memory), for a query.
SLICE, LONG_SLICE = 256 << 10, 64 << 10
#: Longer words are cut into parts of so many bytes, each with the first of the next one.
PART, OVERLAP = 256, 64
#: Pieces whose ids are put together at once.
STEP = 1 << 15

#: Each round contracts the leftmost pair of minimum rank of every word: the smallest
#: (rank, place) in one number. A word without a pair in the table is done.
SHORT = """
WITH RECURSIVE t(g, w, tok, live) AS (
  SELECT g, w, tok, true FROM start
  UNION ALL (
    WITH pairs AS MATERIALIZED (
      SELECT g, w, s.tok, before, m.merged
      FROM (SELECT g, w, tok, lag(g) OVER (ORDER BY g) AS before,
                   CASE WHEN lead(w) OVER (ORDER BY g) = w THEN lead(tok) OVER (ORDER BY g) END AS after
            FROM t WHERE live) s
      LEFT JOIN merges m ON m.l = s.tok AND m.r = s.after),
    hit AS (
      SELECT w, least & 4294967295 AS at, CAST(least >> 32 AS INT) AS merged
      FROM (SELECT w, min((CAST(merged AS BIGINT) << 32) + g) AS least FROM pairs WHERE merged IS NOT NULL GROUP BY w))
    SELECT p.g, p.w, CASE WHEN p.g = h.at THEN h.merged ELSE p.tok END, h.w IS NOT NULL
    FROM pairs p LEFT JOIN hit h ON h.w = p.w
    WHERE p.before IS NULL OR h.at IS DISTINCT FROM p.before))
SELECT g, w, tok, live FROM t WHERE NOT live ORDER BY g"""

#: The same for long words: contracts every second pair of each run of equal pairs,
#: and stops after some rounds, so that not all rounds are in memory at once.
LONG = f"""
WITH RECURSIVE t(step, g, w, tok, live) AS (
  SELECT 0, g, w, tok, true FROM start
  UNION ALL (
    WITH pairs AS MATERIALIZED (
      SELECT step, g, w, s.tok, m.merged
      FROM (SELECT step, g, w, tok, CASE WHEN lead(w) OVER (ORDER BY g) = w THEN lead(tok) OVER (ORDER BY g) END AS after
            FROM t WHERE live AND step < {ROUNDS}) s
      LEFT JOIN merges m ON m.l = s.tok AND m.r = s.after),
    best AS (SELECT w, min(merged) AS best FROM pairs GROUP BY w),
    numbered AS (
      SELECT step, g, w, tok, best, coalesce(merged = best, false) AS hit, row_number() OVER (ORDER BY g) AS n
      FROM pairs JOIN best USING (w)),
    taken AS (
      SELECT *, hit AND (n - coalesce(max(CASE WHEN NOT hit THEN n END) OVER (ORDER BY n ROWS UNBOUNDED PRECEDING), 0)) % 2 = 1 AS take
      FROM numbered),
    eaten AS (SELECT *, lag(take, 1, false) OVER (ORDER BY n) AS gone FROM taken)
    SELECT step + 1, g, w, CASE WHEN take THEN best ELSE tok END, best IS NOT NULL
    FROM eaten WHERE NOT gone))
SELECT g, w, tok, live FROM t WHERE NOT live OR step = {ROUNDS} ORDER BY g"""

#: The bytes of each id, in order.
DECODE = "SELECT raw FROM ids JOIN vocabulary USING (tok) ORDER BY g"


class Runs:
    """Lists of numbers, end to end."""

    def __init__(self, lists: Sequence[np.ndarray] = (), kind: type = np.int32):
        self.flat = np.concatenate(lists) if len(lists) else np.zeros(0, kind)
        self.at = np.cumsum([0, *map(len, lists)])

    def take(self, which: np.ndarray) -> Runs:
        """The lists of these numbers."""
        size = self.at[which + 1] - self.at[which]
        out, parts = Runs(kind=self.flat.dtype), []
        for a in range(0, len(which), STEP):
            n = size[a : a + STEP]
            end = n.cumsum()
            parts.append(self.flat[np.repeat(self.at[which[a : a + STEP]] - end + n, n) + np.arange(end[-1])])
        if parts:
            out.flat, out.at = np.concatenate(parts), np.append(0, size.cumsum())
        return out

    def together(self, at: np.ndarray) -> Runs:
        """Those from each of these numbers up to the next as one list."""
        self.at = self.at[at]
        return self

    def add(self, more: Runs) -> None:
        self.at = np.append(self.at, more.at[1:] + len(self.flat))
        self.flat = np.append(self.flat, more.flat)

    def bytes(self) -> list[bytes]:
        return [self.flat[a:b].tobytes() for a, b in zip(self.at, self.at[1:])]


class Known:
    """Pieces by number, with their ids and decoded bytes."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.ids, self.raw = Runs(), Runs(kind=np.uint8)
        #: Pieces with white space at an edge, and the empty one.
        self.odd: set[str] = set()

    def add(self, pieces: list[str], ids: Runs, raw: Runs) -> None:
        self.number.update(zip(pieces, range(len(self.number), len(self.number) + len(pieces)), strict=True))
        self.ids.add(ids)
        self.raw.add(raw)


class Coder:
    """One task's DuckDB with the merge table and the vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.edge = regex.compile(r"^\s|\s$|^$").search
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": os.path.join(tempfile.gettempdir(), f"bpe-{os.getpid()}")})
        pairs = [
            (a, b, rank)
            for token, rank in ranks.items()
            for i in range(1, len(token))
            if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None
        ]
        l, r, merged = (pa.array(x, pa.int32()) for x in zip(*pairs, strict=True))
        self._table("merges", l=l, r=r, merged=merged)
        self._table("vocabulary", tok=pa.array(ranks.values(), pa.int32()), raw=pa.array(ranks, pa.binary()))
        self.token = {rank: token for token, rank in ranks.items()}
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        self.size[list(self.token)] = [len(t) for t in self.token.values()]
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        #: Known pieces; ``old`` are those of the generation before.
        self.forget()

    def forget(self) -> None:
        """Know no pieces, which only saves work."""
        self.known, self.old = Known(), Known()

    def _table(self, name: str, **columns) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def merge(self, words: list[bytes], query: str) -> tuple[np.ndarray, np.ndarray]:
        """(w, tok): the tokens of each word, by number of the word, in order."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        w = np.repeat(np.arange(len(words), dtype=np.int32), length)
        tok = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        g = np.arange(len(w), dtype=np.int32)
        done: list[tuple[np.ndarray, ...]] = []
        while len(w):
            self._table("start", g=g, w=w, tok=tok)
            got = self.db.execute(query).fetchnumpy()
            live = np.asarray(got["live"], bool)
            done.append((np.asarray(got["g"])[~live], np.asarray(got["w"])[~live], np.asarray(got["tok"])[~live]))
            g, w, tok = (np.asarray(got[k])[live] for k in ("g", "w", "tok"))
        if not done:
            return np.zeros(0, np.int32), np.zeros(0, np.int32)
        g, w, tok = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(g, kind="stable")
        return w[order].astype(np.int32), tok[order].astype(np.int32)

    def merged(self, words: list[bytes], query: str) -> list[np.ndarray]:
        """The tokens of each word, in slices."""
        out = []
        for first, end in _runs(words, SLICE if query == SHORT else LONG_SLICE):
            w, tok = self.merge(words[first:end], query)
            ends = np.bincount(w, minlength=end - first).cumsum().tolist()
            out += [tok[a:b] for a, b in zip([0, *ends], ends)]
        return out

    def encode(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each of these distinct pre-tokens."""
        raw = [x.encode("utf-8", "surrogatepass") for x in words]
        out = [np.array([r], np.int32) if (r := self.ranks.get(x)) is not None else None for x in raw]
        for query, rest in (
            (SHORT, [i for i, x in enumerate(raw) if out[i] is None and len(x) <= LONG_WORD]),
            (LONG, [i for i, x in enumerate(raw) if out[i] is None and LONG_WORD < len(x) <= PART]),
        ):
            for i, tok in zip(rest, self.merged([raw[i] for i in rest], query), strict=True):
                out[i] = tok
        for i, x in enumerate(raw):
            if out[i] is None:
                out[i] = self.in_parts(x)
        return out

    def in_parts(self, word: bytes) -> np.ndarray:
        """The ids of a word of any length."""
        parts = self.merged([word[a : a + PART + OVERLAP] for a in range(0, len(word), PART)], LONG)
        ends = [a + self.size[x].cumsum() for a, x in zip(range(0, len(word), PART), parts, strict=True)]
        apart: dict[tuple[int, int], bool] = {}

        def places(end: Sequence[int], tok: Sequence[int], i: int) -> list[tuple[int, tuple[int, int]]]:
            """Where both the tokens so far and part ``i`` have an end, the middle first,
            with the tokens there."""
            before = bisect_right(end, i * PART)
            both, a, b = np.intersect1d(np.asarray(end[before:]), ends[i][:-1], True, return_indices=True)
            found = [(int(p), (int(tok[before + x]), int(parts[i][y + 1]))) for p, x, y in zip(both, a, b, strict=True)]
            return sorted(found, key=lambda x: abs(x[0] - i * PART - OVERLAP // 2))

        def learn(pairs: Sequence[tuple[int, int]]) -> None:
            """Which pairs of tokens stay apart."""
            pairs = [x for x in dict.fromkeys(pairs) if x not in apart]
            for x, got in zip(pairs, self.merged([self.token[a] + self.token[b] for a, b in pairs], SHORT), strict=True):
                apart[x] = got.tolist() == list(x)

        def stays(pair: tuple[int, int]) -> bool:
            learn([pair])
            return apart[pair]

        learn([pair for i in range(1, len(parts)) for _, pair in places(ends[i - 1], parts[i - 1], i)[:4]])
        tok, end = array("i", parts[0].tolist()), array("q", ends[0].tolist())
        for i in range(1, len(parts)):
            if end[-1] == len(word):
                break
            more = parts[i]
            at = next((p for p, pair in places(end, tok, i) if stays(pair)), None)
            back = 2 * OVERLAP
            while at is None:
                n = bisect_right(end, end[-1] - back)
                begin = end[n - 1] if n else 0
                (more,) = self.merged([word[begin : (i + 1) * PART + OVERLAP]], LONG)
                if not n or stays((tok[n - 1], int(more[0]))):
                    at = begin
                back *= 2
            n = bisect_right(end, at)
            del tok[n:], end[n:]
            more_end = min(len(word), (i + 1) * PART + OVERLAP) - self.size[more][::-1].cumsum()[::-1] + self.size[more]
            new = more_end > at
            tok.extend(more[new].tolist())
            end.extend(more_end[new].tolist())
        return np.array(tok, np.int32)

    def decode(self, ids: Runs) -> Runs:
        """The bytes of each list of ids."""
        raw, size = [np.zeros(0, np.uint8)], [[0]]
        for a in range(0, len(ids.flat), SLICE):
            tok = ids.flat[a : a + SLICE]
            self._table("ids", g=np.arange(len(tok), dtype=np.int32), tok=tok)
            data, at = as_bytes(self.db.sql(DECODE).to_arrow_table().column("raw"))
            raw.append(data)
            size.append(np.diff(at))
        out = Runs()
        out.flat, out.at = np.concatenate(raw), np.concatenate(size).cumsum()
        return out.together(ids.at)

    def learn(self, fresh: list[str]) -> None:
        """Make these pieces known; those of the generation before are taken over."""
        old = self.old.number
        again = [x for x in fresh if x in old]
        if again:
            which = np.array([old[x] for x in again])
            self.known.add(again, self.old.ids.take(which), self.old.raw.take(which))
        fresh = [x for x in fresh if x not in old]
        if fresh:
            parts = [self.split(x) for x in fresh]
            tokens: dict[str, int] = {}
            which = np.array([tokens.setdefault(p, len(tokens)) for part in parts for p in part], np.int64)
            at = np.cumsum([0, *map(len, parts)])
            ids = Runs(self.encode(list(tokens)))
            self.known.add(fresh, *(x.take(which).together(at) for x in (ids, self.decode(ids))))

    def coded(self, texts: pa.Array) -> tuple[Runs, Runs]:
        """Ids and decoded bytes of each text.

        Texts are cut into parts that the pattern never matches across. A single space
        between two other characters always begins a match, and no match reaches over it,
        so a text without other white space at the ends of its parts falls apart at its
        spaces. Parts with white space at an edge, and empty ones, are one part with those
        before and after.
        """
        if len(self.known.number) > CACHE_WORDS // 2:
            self.old, self.known = self.known, Known()
        known = self.known.number
        words = pc.split_pattern(texts, " ")
        begin = words.offsets.to_numpy().astype(np.int64)
        coded = words.flatten().dictionary_encode()
        word = coded.dictionary.to_pylist()
        # Twice the word's number, and one more if a space is before it.
        code = 2 * coded.indices.to_numpy().astype(np.int64) + 1
        code[begin[:-1]] -= 1
        seen = np.zeros(2 * len(word), bool)
        seen[code] = True
        seen = np.flatnonzero(seen)
        piece = {c: " " + word[c >> 1] if c & 1 else word[c >> 1] for c in seen.tolist()}
        # Known pieces too: that ' ' is known says nothing of a text with three in a row.
        # Each is looked at when it first comes in a generation.
        odd, edge = self.known.odd, self.edge
        odd.update(x for x in piece.values() if x not in known and not (x[-1:].isalnum() and x[1:2].isalnum()) and edge(x.removeprefix(" ")))
        first = np.ones(len(code), bool)
        if odd:
            bad = np.zeros(2 * len(word), bool)
            bad[seen] = [x in odd for x in piece.values()]
            bad = bad[code]
            first[1:] = ~(bad[1:] | bad[:-1])
            first[begin[:-1]] = True
        at = np.flatnonzero(first)
        size = np.diff(at, append=len(code))
        several = np.flatnonzero(size > 1)
        joined = ["".join([piece[c] for c in code[a : a + n].tolist()]) for a, n in zip(at[several].tolist(), size[several].tolist(), strict=True)]
        alone = np.zeros(2 * len(word), bool)
        alone[code[at[size == 1]]] = True
        alone = np.flatnonzero(alone)
        single = [piece[c] for c in alone.tolist()]
        self.learn([x for x in dict.fromkeys([*single, *joined]) if x not in known])
        number = np.zeros(2 * len(word), np.int64)
        number[alone] = [known[x] for x in single]
        which = number[code[at]]
        which[several] = [known[x] for x in joined]
        ends = np.searchsorted(at, begin)
        return self.known.ids.take(which).together(ends), self.known.raw.take(which).together(ends)

    def code(self, texts: list[str]) -> tuple[list[bytes], list[bytes]]:
        """Ids as 32-bit numbers, and decoded bytes, of each text."""
        ids, raw = self.coded(pa.array(texts, pa.string()))
        return ids.bytes(), raw.bytes()


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(2)
def _coder(path: str, pattern: str) -> Coder:
    return Coder(read_ranks(path), pattern)


def grouped(parts: list[str], odd: set[str]) -> list[str]:
    """Parts of a text, where those with white space at an edge, and empty ones, are one
    part with those before and after."""
    out, held, last = [], [], False
    for x in parts:
        bad = x in odd
        if held and not bad and not last:
            out.append("".join(held))
            held = []
        held.append(x)
        last = bad
    return [*out, "".join(held)]


def _runs(texts: Sequence, most: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    return _sized([len(x) for x in texts], most)


def _sized(sizes: Sequence[int], most: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    first, size = 0, 0
    for i, x in enumerate(sizes):
        if size and size + x > most:
            yield first, i
            first, size = i, 0
        size += x
    if first < len(sizes):
        yield first, len(sizes)


def encode_decode(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """All other columns of ``docs`` in ``row``, with ``ids`` (array<int>) and ``decoded`` (binary).

    ``path`` is a rank file that every executor has (the tokenizers are installed, not
    shipped). A null or empty text has no ids and decodes to nothing. Repeated rows
    stay repeated. Columns of any name are fine, as they are packed. The special
    tokens of a vocabulary are ordinary text.
    """
    given = docs.select(others(docs, text_col), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for batch in batches:
            coder = coder or _coder(path, pattern)
            texts = batch.column("text")
            for first, end in _sized(pc.binary_length(texts).to_pylist()):
                ids, decoded = coder.coded(texts.slice(first, end - first))
                starts = [pa.array(x.at, pa.int32()) for x in (ids, decoded)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row").slice(first, end - first),
                        pa.ListArray.from_arrays(starts[0], pa.array(ids.flat)),
                        pa.Array.from_buffers(pa.binary(), end - first, [None, starts[1].buffers()[1], pa.py_buffer(decoded.flat)]),
                    ],
                    names=["row", "ids", "decoded"],
                )
        # The process stays for tasks of other stages, which need its memory.
        if coder:
            coder.forget()

    schema = T.StructType([
        given.schema["row"],
        T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("decoded", T.BinaryType()),
    ])
    return given.mapInArrow(work, schema)
