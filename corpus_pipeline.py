"""A corpus from raw documents: language ID, near-copy removal, repeat removal, benchmark
decontamination, and coding into byte-level BPE ids.

Each stage takes (spark, docs, sf_dir) and works on all that the one before has kept.
``run`` writes each stage's rows to the shared folder and reads them again. Columns
that a stage does not know pass through all stages but the last.

A stage that needs intermediate tables writes down what they lead to, keys or byte spans
but no texts, and drops those tables then, and no others. Its rows read what it wrote,
which stays until the caller empties the folder; ``run`` drops it, and the rows of the
stage before, once it has written the rows of a stage.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import bpe, decontaminate, langid, nearcopies, repeats
from spanloom.llm.queries import BPE_FILE, table
from spanloom.llm.rows import KEY, drop, noted, packed, prepared, stored
from spanloom.session import prepare

#: A language is believed from this probability on.
LEAST_SCORE = 0.5


def _stage(work: Callable) -> Callable:
    @wraps(work)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return work(prepared(spark), docs, sf_dir)

    return run


def _settled(spark: SparkSession, name: str, work: Callable[[], DataFrame]) -> DataFrame:
    """What ``work`` returns, written down; the tables that led to it go."""
    with noted() as own:
        rows = work()
    rows = stored(rows, name)
    drop(spark, own)
    return rows


def _as_documents(rows: DataFrame, docs: DataFrame, **changed) -> DataFrame:
    """The columns of ``docs`` out of ``row`` and ``text``, with some changed."""
    changed.setdefault("text", F.col("text"))
    return rows.select(*[changed[c].cast(docs.schema[c].dataType).alias(c) if c in changed else F.col(f"row.`{c}`") for c in docs.columns])


@_stage
def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; ``lang`` becomes the one predicted.

    Documents without letters (or null) go, and those whose best language has a
    probability below ``LEAST_SCORE``. Where nothing has a label, all with letters stay.
    """
    lettered = docs.filter(F.col("text").rlike(r"\p{L}"))
    model = langid.train(lettered)
    if not model.languages:
        return lettered
    given = lettered.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    found = langid.identify(given, model).filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return _as_documents(found, docs, text=F.col("row.text"), lang=F.col("lang_pred"))


@_stage
def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: that with the least id. Of rows that are
    the same in id and text one stays."""
    stay = _settled(spark, "stay", lambda: nearcopies.near_copies(docs).filter("stays").select(*KEY).distinct())
    one = packed(docs).join(stay, KEY).groupBy(*KEY).agg(F.first("row").alias("row"), F.first("text").alias("text"))
    return _as_documents(one, docs)


@_stage
def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 200 bytes that occur again. A character of which only
    some bytes were removed becomes a replacement character; documents of which nothing
    is left go."""
    cut = repeats.remove_repeats(docs).select("row", F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))
    return _as_documents(cut.filter("text <> ''"), docs, n_chars=F.length("text"))


@_stage
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of ten words of a benchmark item."""
    items = table(spark, sf_dir, "benchmark")
    hit = _settled(spark, "hit", lambda: decontaminate.contamination(docs, items).filter("n_hit > 0").select(*KEY).distinct())
    return _as_documents(packed(docs).join(hit, KEY, "left_anti"), docs)


@_stage
def coded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and the text that the ids decode to."""
    rows = bpe.encode_decode(docs, public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN)
    return rows.select(
        "row.doc_id", "row.lang", "row.source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").cast("string").alias("text")
    )


STAGES = [
    ("language", identified),
    ("near_copies", without_copies),
    ("repeats", without_repeats),
    ("benchmark", decontaminated),
    ("tokens", coded),
]

#: Learned models, similarity classes and byte spans are not expressible in SQL; the
#: pipeline is tested against brute-force versions of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of ``sf_dir``."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    with noted() as tables:
        for name, stage in STAGES[:-1]:
            docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
            drop(spark, tables[:-1])
            del tables[:-1]
    return STAGES[-1][1](spark, docs, sf_dir)
