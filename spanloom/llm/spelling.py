"""Groups of words that differ by one letter, found by products of letter counts.

Two words one insertion, deletion or replacement apart have letter counts at a squared
distance of one or two, and lengths that differ by one at most. So words are put into
blocks of adjacent lengths; within a block one matrix product of the letter counts (a
Gram matrix) gives all squared distances, |a|^2 + |b|^2 - 2ab, and only pairs at most
two apart have their letters compared.

A block of one length would hold a large part of the vocabulary, so blocks are cut
finer by the same counts: letters fall into ``GROUPS`` groups, and a block is a vector
of group counts. A word stands in the block of its own counts, as the shorter word of
an insertion, and in each block that one letter less leads to. Near words meet in
exactly one block where they stand with different roles, and words of equal group
counts are compared in the first of theirs only. Blocks beyond ``TILE`` words are dealt
into tiles, and each pair of tiles is a piece of work of its own, so no task holds more
than two tiles.

No pair leaves a task: a block gives for each word how many words are near, and the most
frequent of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.rows import as_bytes, stored

#: Latin letters, ASCII capitals left out: they are lower-cased.
LETTERS = [*range(0x61, 0x7B), *range(0xC0, 0x100)]
RUN = r"[A-Za-zÀ-ÿ]"

#: Groups of letters whose counts name a block.
GROUPS = 10

#: Words and letters of one tile at most (a single longer word is a tile of its own).
TILE = 4096
TILE_LETTERS = 1 << 24

#: Cells of a matrix, and of letters compared, that a task holds at once.
CELLS = 1 << 22

_UPPER = "".join(map(chr, range(0x41, 0x5B)))


def vocabulary(
    docs: DataFrame, least_letters: int = 5, least_count: int = 3, noise: int | None = 97,
    text_col: str = "text", id_col: str = "doc_id",
) -> DataFrame:
    """(word, n): runs of Latin letters, ASCII lower-cased, with their counts.

    With ``noise``, a run loses one letter where the crc32 of ``<id>:<run>`` is divisible
    by it, at that crc32 modulo the length; a null id is an empty text there.
    """
    id_ = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    # A maximal run shorter than the least length cannot become a word.
    runs = F.regexp_extract_all(F.col(f"`{text_col}`").cast("string"), F.lit(f"({RUN}{{{least_letters},}})"), F.lit(1))
    run = F.translate("run", _UPPER, _UPPER.lower())
    words = docs.select(id_.alias("id"), F.explode(runs).alias("run")).select("id", run.alias("run"))
    if noise:
        h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
        at = (F.col("h") % F.length("run")).cast("int")
        # Not counted with: position 0 would be read as 1.
        cut = F.concat(F.when(at > 0, F.substring("run", F.lit(1), at)).otherwise(""), F.substring("run", at + 2, F.length("run")))
        words = words.withColumn("h", h).withColumn("run", F.when(F.col("h") % noise == 0, cut).otherwise(F.col("run")))
        words = words.filter(F.length("run") >= least_letters)
    return words.groupBy(F.col("run").alias("word")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def _blocks(words: DataFrame) -> DataFrame:
    """(key, gone, once, code, n): a word in each of its blocks. ``gone`` is the group of
    the letter it has more than the block (-1: none), ``once`` the first such block."""
    counts = []
    for g in range(GROUPS):
        letters = "".join(chr(c) for c in LETTERS if c % GROUPS == g)
        counts.append(F.length("word") - F.length(F.translate("word", letters, "")))
    per_word = words.select("n", F.encode("word", "ISO-8859-1").alias("code"), F.array(*counts).alias("c"))

    def key(less: int) -> Column:
        return F.concat_ws(" ", *[(F.col("c")[g] - (1 if g == less else 0)).cast("string") for g in range(GROUPS)])

    before = lambda g: sum((F.col("c")[i] for i in range(g)), F.lit(0))
    places = [F.struct(key(-1).alias("key"), F.lit(-1).alias("gone"), F.lit(False).alias("once"))] + [
        F.when(F.col("c")[g] > 0, F.struct(key(g).alias("key"), F.lit(g).alias("gone"), (before(g) == 0).alias("once"))) for g in range(GROUPS)
    ]
    return per_word.select("n", "code", F.explode(F.array_compact(F.array(*places))).alias("p")).select("p.*", "code", "n")


def _tiled(rows: DataFrame) -> DataFrame:
    """Rows with ``tile``, once for each pair of tiles (p, q) it is compared in."""
    size = rows.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.sum(F.length("code").cast("long")).alias("letters"))
    tiles = F.greatest(F.ceil(F.col("m") / TILE), F.least(F.ceil(F.col("letters") / TILE_LETTERS), F.col("m"))).cast("int")
    large = size.select("key", tiles.alias("tiles")).filter("tiles > 1")
    each = rows.join(large, "key", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    each = each.withColumn("tile", F.pmod(F.xxhash64("code"), F.col("tiles")).cast("int"))
    each = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return each.select("key", F.least("tile", "other").alias("p"), F.greatest("tile", "other").alias("q"), "tile", "gone", "once", "code", "n")


def counts_of(code: np.ndarray) -> np.ndarray:
    """Letter counts, one row for each row of letters, of the letters that occur."""
    used, letter = np.unique(code, return_inverse=True)
    cells = np.arange(len(code))[:, None] * len(used) + letter.reshape(code.shape)
    return np.bincount(cells.ravel(), minlength=len(code) * len(used)).reshape(len(code), -1).astype(np.float64)


def near_pairs(short: np.ndarray, long: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Pairs (i, j, inserted) of rows one letter apart: i of ``short`` and j of ``long``
    (one letter more) if inserted, else i < j of ``long``. One byte is a letter."""
    m, width = len(short), long.shape[1]
    both = counts_of(np.concatenate([np.pad(short, ((0, 0), (0, 1))), long]))
    # The padding is a letter of its own, 0, and sorts first.
    both = both[:, 1:] if m else both
    square = (both * both).sum(1)
    strip = max(1, CELLS // max(1, len(long)))
    for first in range(0, m + len(long), strip):
        rows = both[first : first + strip]
        apart = square[first : first + strip, None] + square[None, m:] - 2.0 * (rows @ both[m:].T)
        i, j = np.nonzero(apart <= 2.0)
        i += first
        for inserted in (True, False):
            mine = i < m if inserted else (i >= m) & (i - m < j)
            a, b = i[mine] - (0 if inserted else m), j[mine]
            for k in range(0, len(a), max(1, CELLS // width)):
                x, y = a[k : k + max(1, CELLS // width)], b[k : k + max(1, CELLS // width)]
                if inserted:
                    head = np.logical_and.accumulate(short[x] == long[y, :-1], axis=1).sum(1)
                    tail = np.logical_and.accumulate((short[x] == long[y, 1:])[:, ::-1], axis=1).sum(1)
                    ok = head + tail >= width - 1
                else:
                    ok = (long[x] != long[y]).sum(1) == 1
                yield x[ok], y[ok], inserted


def _near_in(codes: list[bytes], gone, once, tile, n, p: int, q: int):
    """(rows, near words, most frequent of them) of one pair of tiles; the rows are
    sorted by length."""
    size = len(codes)
    m = int((gone < 0).sum())
    if m == size:
        return None
    letters = np.frombuffer(b"".join(codes), np.uint8)
    width = len(codes[-1])
    cut = m * (width - 1)
    short, long = letters[:cut].reshape(m, width - 1), letters[cut:].reshape(size - m, width)
    pairs = []
    for i, j, inserted in near_pairs(short, long):
        i, j = (i if inserted else i + m), j + m
        ok = np.ones(len(i), bool) if p == q else tile[i] != tile[j]
        if not inserted:
            ok &= (gone[i] != gone[j]) | once[i]
        pairs.append(np.stack([i[ok], j[ok]]))
    both = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), np.int64)
    if not both.shape[1]:
        return None
    mine, other = np.concatenate([both[0], both[1]]), np.concatenate([both[1], both[0]])
    rows, where, near = np.unique(mine, return_inverse=True, return_counts=True)
    # The most frequent first, then the smaller word.
    order = sorted(rows.tolist(), key=lambda r: (-n[r], codes[r]))
    rank = np.zeros(size, np.int64)
    rank[order] = np.arange(len(order))
    best = np.full(len(rows), size, np.int64)
    np.minimum.at(best, where, rank[other])
    return rows, near, np.array(order)[best]


_NEAR = "code binary, n long, near long, best_n long, best binary"


def _compared(rows: DataFrame) -> DataFrame:
    """For each word and block with near words: their number and the best of them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(parts: list[pa.RecordBatch]) -> pa.RecordBatch | None:
            table = pa.Table.from_batches(parts).combine_chunks()
            if table.num_rows < 2:
                return None
            data, at = as_bytes(table.column("code"))
            raw = data.tobytes()
            codes = [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            gone, once, tile, n = (table.column(c).to_numpy() for c in ("gone", "once", "tile", "n"))
            found = _near_in(codes, gone, once.astype(bool), tile, n, table.column("p")[0].as_py(), table.column("q")[0].as_py())
            if found is None:
                return None
            rows_, near, best = found
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([codes[r] for r in rows_], pa.binary()), pa.array(n[rows_]), pa.array(near.astype(np.int64)),
                    pa.array(n[best]), pa.array([codes[b] for b in best], pa.binary()),
                ],
                names=["code", "n", "near", "best_n", "best"],
            )

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            names = list(zip(*(batch.column(c).to_pylist() for c in ("key", "p", "q")), strict=True))
            begin = 0
            for i, name in enumerate(names):
                if name != last:
                    held.append(batch.slice(begin, i - begin))
                    if (out := done(held)) is not None:
                        yield out
                    held, begin, last = [], i, name
            held.append(batch.slice(begin))
        if held and (out := done(held)) is not None:
            yield out

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "key", "p", "q").sortWithinPartitions("key", "p", "q", F.length("code"))
    return dealt.mapInArrow(work, _NEAR)


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the forms of a word lead to at last. Paths are halved each
    round, and counts double along them, so rounds are few."""
    at = stored(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not at.filter("moved").isEmpty():
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = stored(at.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
    return at.select("word", "root")


def variants(words: DataFrame, ratio: float = 2) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of each row of ``words`` (word, n).

    Near words differ by exactly one inserted, deleted or replaced letter. The form of a
    word is the near word of largest n (ties: smallest in code-point order), if that n is
    at least ``ratio`` times its own, which must be above one; else null. The root is where forms lead to at last,
    the word itself if it has none. Words are distinct, of Latin letters without ASCII
    capitals, and of any length; no words give no rows.
    """
    if ratio <= 1:
        raise ValueError("the ratio must be above one, or forms could go round in circles")
    words = stored(words.select("word", F.col("n").cast("long").alias("n")), "words")
    near = _compared(_tiled(_blocks(words))).groupBy("code", "n").agg(
        F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("code"))).alias("best")
    )
    letters = lambda c: F.decode(c, "ISO-8859-1")
    has_form = -F.col("best.n") >= F.lit(ratio) * F.col("n")
    near = stored(
        near.select(
            letters("code").alias("word"), "n_near",
            F.when(has_form, letters("best.code")).alias("form"), F.when(has_form, -F.col("best.n")).alias("form_n"),
        ),
        "near",
    )
    roots = _roots(near.filter("form IS NOT NULL").select("word", "form"))
    found = words.join(near.join(roots, "word", "left"), "word", "left")
    return found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))
