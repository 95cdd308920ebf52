"""Near copies by BagMinHash: signatures whose entries agree with the weighted Jaccard
similarity of two texts' bags of five-word shingles, bands over them, and exact counts.

A shingle's weight is how often it occurs. The weight line is cut into [0, 1), [1, 2),
[2, 4), [4, 8) ...; on each cell lives a Poisson process whose points fall out of the
shingle's hash: arrival time, place in the cell, and one of ``ENTRIES`` signature
entries. A text sees the points below its weight, cell by cell (the hierarchy), and an
entry is the first arrival. Since a text's total weight says how early its entries
fill, most shingles are dismissed by their first arrival alone.

Texts with equal bags are one class from the start. Classes that share a band are
compared with a leader of the band first. Bands that this leaves in several components
go on; classes whose shared shingles cannot bring them to the similarity leave them, and
what hangs together by bands is a group.

A group is written as differences to its centre, the shingles that more than half of its
bags have. With D the centre's shingles that a bag lacks, O those that it has besides, c =
|D| + t |O| and s the number of differences that two bags share, their similarity is t or
more exactly if (1 + t) s >= c + c' - (1 - t) |centre|. So bags that share no difference
are linked only by way of the bag with the least c, and all others meet under a shared
difference: under the rarest, only as many as the bound forces, and only where it can be
met. Who meets under a frequent difference is a group again, of at most half the size,
with a centre of its own. No link is left out, no group is gathered in one place and its
pairs are not listed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.hashing import Substrings, mixed, words
from spanloom.llm.rows import KEY, SMALL_STEP, as_bytes, lists, packed, steps, stored
from spanloom.operators.components import connected_components

BANDS, BAND_ROWS = 24, 4
ENTRIES = BANDS * BAND_ROWS
#: Classes that meet are paired as they are up to this many; larger groups get a centre.
SMALL = 256
#: How often classes that cannot meet anyone any more are left out before the rest meets.
PASSES = 3
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(data: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, weight) of the distinct shingles of each text; a text of fewer words
    has one of all its words."""
    _, _, text, hash_ = words(data, at)
    n = np.bincount(text, minlength=len(at) - 1)
    first = np.cumsum(n) - n
    count = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    of = np.repeat(np.arange(len(n)), count)
    start = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + first[of]
    h = Substrings(hash_).of(start, start + np.minimum(width, n)[of])
    for a, b in zip(np.cumsum(count) - count, np.cumsum(count), strict=True):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    at_ = np.flatnonzero(new)
    return of[at_], h[at_], np.diff(np.append(at_, len(h)))


def signatures(text: np.ndarray, h: np.ndarray, weight: np.ndarray, n_texts: int) -> np.ndarray:
    """First arrival of each entry (texts x entries), as the bits of its time."""
    total = np.bincount(text, weight, n_texts)
    cells = 1 + np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64)
    element = np.repeat(np.arange(len(h)), cells)
    cell = np.arange(len(element)) - np.repeat(np.cumsum(cells) - cells, cells)
    low = np.where(cell > 0, 2.0 ** np.maximum(cell - 1, 0), 0.0)
    rate = np.maximum(low, 1.0)
    with np.errstate(over="ignore"):
        seed = mixed(h[element] + cell.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    first = np.full(n_texts * ENTRIES, np.inf)
    # A text's entries are all filled by then, nearly always; else it is done again.
    limit = np.where(total > 0, ENTRIES * (np.log(ENTRIES) + 2) / np.maximum(total, 1), 0.0)
    todo = np.flatnonzero(total > 0)
    while len(todo):
        open_ = np.zeros(n_texts, bool)
        open_[todo] = True
        live = np.flatnonzero(open_[text[element]]) if len(todo) < n_texts else np.arange(len(element))
        time, k = np.zeros(len(live)), 0
        while len(live):
            k += 1
            with np.errstate(over="ignore"):
                z = mixed(seed[live] + np.uint64(k) * _STEP)
            u = ((z >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
            until, per = limit[text[element[live]]], rate[live]
            soon = np.flatnonzero(u >= np.exp(-(until - time) * per))
            live, z = live[soon], z[soon]
            time = time[soon] - np.log(u[soon]) / per[soon]
            z = mixed(z ^ np.uint64(0x5851F42D4C957F2D))
            place = low[live] + rate[live] * (z >> np.uint64(32)).astype(np.float64) * 2.0**-32
            seen = place < weight[element[live]]
            entry = ((z & np.uint64(0xFFFFFFFF)) * np.uint64(ENTRIES) >> np.uint64(32)).astype(np.int64)
            np.minimum.at(first, (text[element[live]] * ENTRIES + entry)[seen], time[seen])
        unfilled = np.isinf(first.reshape(n_texts, ENTRIES)).any(axis=1)
        todo = todo[unfilled[todo]]
        limit[todo] *= 2
    return first.reshape(n_texts, ENTRIES).view(np.uint64)


def _summaries(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, k1, k2, s1, s2, n, bands): a bag's two hashes, size and band hashes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = as_bytes(batch.column("text"))
            for row, end, part, starts in steps(data, at, SMALL_STEP):
                text, h, weight = shingles(part, starts, width)
                m = end - row
                s1, s2, n = np.zeros(m, np.uint64), np.zeros(m, np.uint64), np.bincount(text, weight, m).astype(np.int64)
                if len(text):
                    begin = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
                    with np.errstate(over="ignore"):
                        s1[text[begin]] = np.add.reduceat(mixed(h) * weight.astype(np.uint64), begin)
                        s2[text[begin]] = np.add.reduceat(mixed(h ^ _STEP) * weight.astype(np.uint64), begin)
                signs = signatures(text, h, weight, m).reshape(m, BANDS, BAND_ROWS)
                with np.errstate(over="ignore"):
                    band = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _STEP, (m, BANDS))
                    for i in range(BAND_ROWS):
                        band = mixed(band ^ signs[:, :, i]) + _STEP
                full = n > 0
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(row, m),
                        batch.column("k1").slice(row, m),
                        batch.column("k2").slice(row, m),
                        pa.array(s1.view(np.int64)),
                        pa.array(s2.view(np.int64)),
                        pa.array(n),
                        lists(band[full].ravel().view(np.int64), np.append(0, np.cumsum(full * BANDS)), pa.int64()),
                    ],
                    names=["doc_id", "k1", "k2", "s1", "s2", "n", "bands"],
                )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(work, f"doc_id {id_type}, k1 long, k2 long, s1 long, s2 long, n long, bands array<long>")


def _bags(docs: DataFrame, width: int) -> DataFrame:
    """(k1, k2, bag): every shingle once for each time that it occurs, told apart."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = as_bytes(batch.column("text"))
            for row, end, part, starts in steps(data, at, SMALL_STEP):
                text, h, weight = shingles(part, starts, width)
                time = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
                with np.errstate(over="ignore"):
                    bag = mixed(np.repeat(h, weight) + time.astype(np.uint64) * _STEP)
                n = np.bincount(text, weight, end - row).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(k).slice(row, end - row) for k in KEY] + [lists(bag.view(np.int64), np.append(0, np.cumsum(n)), pa.int64())],
                    names=[*KEY, "bag"],
                )

    return docs.select(*KEY, "text").mapInArrow(work, "k1 long, k2 long, bag array<long>")


def _links(pairs: DataFrame, bags: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of bags that are similar enough."""
    side = lambda name: bags.select(F.struct(*KEY).alias(name), F.col("bag").alias(f"{name}_bag"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    common = F.size(F.array_intersect("a_bag", "b_bag"))
    return both.select("a", "b", common.alias("common"), (F.size("a_bag") + F.size("b_bag")).alias("all")).filter(
        F.col("common") >= F.lit(least) * (F.col("all") - F.col("common")) - F.lit(1e-9)
    ).select("a", "b")


def _heads(rows: DataFrame) -> DataFrame:
    """(band, a, a_n, a_label, a_order): the first class of each band."""
    heads = rows.groupBy("band").agg(F.min(F.struct("order", "node", "n", "label")).alias("h")).select("band", "h.*")
    return heads.select("band", F.col("node").alias("a"), *[F.col(c).alias(f"a_{c}") for c in ("n", "label", "order")])


def _apart(rows: DataFrame) -> DataFrame:
    """The rows of bands that have several components."""
    apart = rows.groupBy("band").agg((F.min("label") != F.max("label")).alias("apart")).filter("apart")
    return rows.join(apart.select("band"), "band")


def _within_reach(rows: DataFrame, bags: DataFrame, least: float) -> DataFrame:
    """Rows of classes that could be similar enough to some class of their band.

    Two bags have at most as much in common as the smaller number of shingles that
    either shares with anything; the smallest bag of a band bounds the sizes.
    """
    nodes = rows.select("node").distinct()
    each = bags.select(F.struct(*KEY).alias("node"), "bag").join(nodes, "node").select("node", F.explode("bag").alias("shingle"))
    common = each.groupBy("shingle").agg(F.count("*").alias("classes")).filter("classes > 1")
    shared = each.join(common, "shingle").groupBy("node").agg(F.count("*").alias("shared"))
    smallest = rows.groupBy("band").agg(F.min("n").alias("smallest"))
    reach = rows.join(smallest, "band").join(shared, "node").filter(
        F.col("shared") >= F.lit(least) * (F.col("n") + F.greatest("shared", "smallest") - F.col("shared")) - F.lit(1e-9)
    )
    return reach.select("band", "node", "n", "label")


def _groups(rows: DataFrame) -> DataFrame:
    """(g, node, n): the classes of bands that hang together, each once."""
    heads = rows.groupBy("band").agg(F.min("node").alias("dst"))
    star = rows.join(heads, "band").select(F.col("node").alias("src"), "dst").distinct()
    together = connected_components(star)
    return rows.select("node", "n").distinct().join(together, "node").select(F.xxhash64("label").alias("g"), "node", "n")


def _as_differences(both: DataFrame, least: float) -> DataFrame:
    """(g, node, n, m, d, o, c, need) of rows with a centre's size ``m``, what a bag lacks of
    it (``d``) and has besides (``o``)."""
    c = F.size("d") + F.lit(least) * F.size("o")
    return both.select("g", "node", "n", "m", "d", "o", c.alias("c"), (c - F.lit(1 - least) * F.col("m")).alias("need"))


def _differences(groups: DataFrame, bags: DataFrame, least: float) -> DataFrame:
    """The differences of each class to the centre of its group.

    A centre has at most twice as many shingles as the group's mean bag.
    """
    with_bag = groups.join(bags.select(F.struct(*KEY).alias("node"), "bag"), "node")
    size = groups.groupBy("g").agg(F.count("*").alias("size"))
    often = with_bag.select("g", F.explode("bag").alias("e")).groupBy("g", "e").agg(F.count("*").alias("k"))
    centre = often.join(size, "g").filter("2 * k > size").groupBy("g").agg(F.collect_list("e").alias("centre"))
    both = with_bag.join(centre, "g", "left").withColumn("centre", F.coalesce("centre", _none()))
    both = both.select("g", "node", "n", F.size("centre").alias("m"), F.array_except("centre", "bag").alias("d"), F.array_except("bag", "centre").alias("o"))
    return _as_differences(both, least)


def _inner_differences(groups: DataFrame, diffs: DataFrame, least: float) -> DataFrame:
    """The same for groups within a group ``p``, out of the differences to its centre alone:
    the new centre is the old one but for the differences that more than half of the
    classes have, so bags are not unfolded again."""
    given = groups.join(diffs.select(F.col("g").alias("p"), "node", "m", "d", "o"), ["p", "node"])
    size = groups.groupBy("g").agg(F.count("*").alias("size"))
    signed = lambda c, lacks: F.transform(c, lambda e: F.struct(e.alias("e"), F.lit(lacks).alias("lacks")))
    each = given.select("g", F.explode(F.concat(signed("d", True), signed("o", False))).alias("x")).select("g", "x.e", "x.lacks")
    often = each.groupBy("g", "e").agg(F.count("*").alias("k"), F.first("lacks").alias("lacks")).join(size, "g").filter("2 * k > size")
    side = lambda lacks: F.collect_list(F.when(lacks, F.col("e")))
    moved = often.groupBy("g").agg(side(F.col("lacks")).alias("out"), side(~F.col("lacks")).alias("in"))
    both = given.join(moved, "g", "left").withColumns({c: F.coalesce(c, _none()) for c in ("out", "in")})
    both = both.select(
        "g", "node", "n", (F.col("m") - F.size("out") + F.size("in")).alias("m"),
        F.concat(F.array_except("d", "out"), F.array_except("in", "o")).alias("d"),
        F.concat(F.array_except("o", "in"), F.array_except("out", "d")).alias("o"),
    )
    return _as_differences(both, least)


def _none() -> Column:
    return F.array().cast("array<bigint>")


def _by_centre(diffs: DataFrame) -> DataFrame:
    """(a, b): links that need no shared difference, to the class nearest to the centre."""
    nearest = diffs.groupBy("g").agg(F.min(F.struct("c", "node")).alias("a"))
    linked = diffs.join(nearest, "g").filter((F.col("a.node") != F.col("node")) & (F.col("a.c") + F.col("need") <= F.lit(1e-9)))
    return linked.select(F.col("a.node").alias("a"), F.col("node").alias("b")).distinct()


def _meetings(diffs: DataFrame, label: DataFrame, least: float) -> DataFrame:
    """(g, p, node, n, label, need, slack): under which differences, as new groups within
    ``p``, classes have to meet so that each pair that is similar enough, shares a difference
    and is not together yet meets once or more.

    A pair shares ``need`` differences of either, at least, and either's ``need`` is at
    most the other's ``slack``. It also shares (c + the other's ``need``) / (1 + t), and the
    other's is at least the least that any difference is met with.
    """
    named = diffs.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    each = named.select("g", "node", "n", "label", "c", "need", F.explode(F.concat("d", "o")).alias("e"))
    apart = (F.min("label") != F.max("label")).alias("apart")
    often = each.groupBy("g", "e").agg(F.count("*").alias("f"), apart).filter("f > 1 AND apart").select("g", "e")
    own, near = Window.partitionBy("g", "node"), F.lit(1e-9)
    able = each.join(often, ["g", "e"])
    for _ in range(PASSES):
        # What leaves makes less of the differences that others share.
        able = stored(able.withColumn("slack", F.lit(1 + least) * F.count("*").over(own) - F.col("c")), "shared")
        met = able.groupBy("g", "e").agg(F.max("slack").alias("best"), F.min("need").alias("lowest"), F.count("*").alias("f"), apart)
        met = met.filter("f > 1 AND apart").drop("apart")
        able = able.drop("f", "lowest").join(met, ["g", "e"]).drop("apart")
        able = able.filter((F.col("best") >= F.col("need") - near) & (F.col("slack") >= F.col("lowest") - near)).drop("best")
    both = (F.col("c") + F.min("lowest").over(own)) / F.lit(1 + least)
    able = able.withColumn("least_shared", F.greatest(F.lit(1), F.ceil(F.col("need") - near), F.ceil(both - near)))
    able = able.withColumn("place", F.row_number().over(own.orderBy("f", "e"))).withColumn("all", F.count("*").over(own))
    able = able.filter(F.col("place") <= F.col("all") - F.col("least_shared") + 1)
    return able.select(F.xxhash64("g", "e").alias("g"), F.col("g").alias("p"), "node", "n", "label", "need", "slack")


def _pairs(met: DataFrame, least: float) -> DataFrame:
    """(a, b): pairs of small groups that may be similar enough and are not together yet."""
    other = met.select("g", *[F.col(c).alias(f"a_{c}") for c in ("node", "n", "label", "need", "slack")])
    near = F.lit(1e-9)
    pairs = met.join(other, "g").filter((F.col("a_node") < F.col("node")) & (F.col("a_label") != F.col("label")))
    pairs = pairs.filter((F.col("a_slack") >= F.col("need") - near) & (F.col("slack") >= F.col("a_need") - near))
    pairs = pairs.filter(F.least("n", "a_n") >= F.lit(least) * F.greatest("n", "a_n") - near)
    return pairs.select(F.col("a_node").alias("a"), F.col("node").alias("b")).distinct()


def _components(links: list[DataFrame]) -> DataFrame:
    edges = reduce(DataFrame.unionByName, links)
    return stored(connected_components(edges.select(F.col("a").alias("src"), F.col("b").alias("dst"))), "components")


def _within_groups(groups: DataFrame, bags: DataFrame, least: float, links: list[DataFrame]) -> DataFrame:
    """The components of ``links`` and of all that links the classes of groups."""
    label, diffs = None, None
    while not groups.isEmpty():
        diffs = stored(_differences(groups, bags, least) if diffs is None else _inner_differences(groups, diffs, least), "differences")
        label = _components([*links, stored(_by_centre(diffs), "links")])
        links = [label.select(F.col("node").alias("a"), F.col("label").alias("b"))]
        met = stored(_meetings(diffs, label, least), "met")
        apart = met.groupBy("g").agg(F.count("*").alias("size"), (F.min("label") != F.max("label")).alias("apart")).filter("apart")
        met = met.join(apart.drop("apart"), "g")
        found = stored(_links(_pairs(met.filter(F.col("size") <= SMALL), least), bags, least), "links")
        if not found.isEmpty():
            label, links = None, [*links, found]
        groups = stored(met.filter(F.col("size") > SMALL).select("g", "p", "node", "n"), "groups")
    return _components(links) if label is None else label


def near_copies(docs: DataFrame, least: float = 0.8, width: int = 5, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, its key ``k1, k2``, the key of its class
    ``c1, c2``, ``class_id`` (the least id in it), ``n_class`` (rows in it) and ``stays``
    (the row with the least id; of repeated rows all).

    Texts whose bags of ``width``-word shingles have a weighted Jaccard similarity of
    ``least`` or more are linked; classes are what links connect. Words are runs of
    letters and digits, ASCII lower-cased. A text of fewer words has one shingle. A text
    without words (or null) is never a near copy: it is a class with its repeated rows
    alone. Null ids are not least unless all are null.
    """
    given = packed(docs, text_col, id_col, keep=False)
    summaries = stored(_summaries(given, width), "bags")
    whole = summaries.filter("n > 0")
    classes = stored(
        whole.groupBy("s1", "s2").agg(F.min(F.struct(*KEY)).alias("node"), F.first("n").alias("n"), F.first("bands").alias("bands")),
        "classes",
    )
    rows = classes.select("node", "n", F.explode("bands").alias("band"))
    shared = rows.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1")
    rows = stored(rows.join(shared, "band").drop("size"), "bands")
    wanted = rows.select(F.col("node.k1").alias("k1"), F.col("node.k2").alias("k2")).distinct()
    texts = given.select(*KEY, "text").join(wanted, KEY)
    # Repeated rows have one bag.
    bags = stored(_bags(texts, width).groupBy(*KEY).agg(F.first("bag").alias("bag")), "shingles")

    # One leader for each band, the same order everywhere.
    rows = rows.select("band", "node", "n", F.col("node").alias("label"), F.xxhash64("node").alias("order"))
    heads = _heads(rows)
    pairs = (
        rows.join(heads, "band")
        .filter((F.col("label") != F.col("a_label")) & (F.struct("a_order", "a") < F.struct("order", "node")))
        .filter(F.least("n", "a_n") >= F.lit(least) * F.greatest("n", "a_n") - F.lit(1e-9))
        .select("a", F.col("node").alias("b"))
        .distinct()
    )
    links = [stored(_links(pairs, bags, least), "links")]
    # A leader's name is label enough to see who is together; one each.
    label = links[0].groupBy(F.col("b").alias("node")).agg(F.min("a").alias("label"))
    # Leaders have met all others of their band. A band in one component is done.
    met = heads.select("band", F.col("a").alias("node"))
    rest = rows.drop("label").join(met, ["band", "node"], "left_anti").join(label, "node", "left")
    rows = stored(_apart(rest.withColumn("label", F.coalesce("label", "node"))), "rest")
    rows = stored(_apart(_within_reach(rows, bags, least)), "reach")
    label = _within_groups(stored(_groups(rows), "groups"), bags, least, links)

    of_class = classes.select("s1", "s2", "node").join(label, "node", "left").select("s1", "s2", F.coalesce("label", "node").alias("class"))
    own = F.struct(*KEY)
    placed = whole.select("doc_id", *KEY, "s1", "s2").join(of_class, ["s1", "s2"]).select("doc_id", *KEY, "class")
    placed = placed.unionByName(summaries.filter("n = 0").select("doc_id", *KEY, own.alias("class")))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *KEY)
    ends = placed.groupBy("class").agg(F.min(first).alias("head"), F.count("*").alias("n_class"))
    return placed.join(ends, "class").select(
        "doc_id", *KEY, F.col("class.k1").alias("c1"), F.col("class.k2").alias("c2"),
        F.col("head.doc_id").alias("class_id"), "n_class", (F.col("head") == first).alias("stays"),
    )
