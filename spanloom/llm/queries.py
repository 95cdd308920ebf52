"""The registered queries of this folder: each applies one operator, with its
production parameters, to its whole table and derives the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import (
    bpe, centroids, covers, decontaminate, extract, langid, nearcopies, neighbours, quality, repeats, spelling, tokencount, toxicity, twins,
)
from spanloom.llm.rows import crc_rest, prepared

BPE_FILE = "byte_bpe_multi_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_ngram_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    rest = crc_rest("doc_id", 3)
    model = langid.train(docs.filter(rest != 1))
    given = docs.select("doc_id", F.coalesce(rest == 1, F.lit(False)).alias("held_out"), "text")
    return langid.identify(given, model).select("doc_id", "held_out", "lang_pred", "score")


def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document inside windows of ten words of benchmark items."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), span=10)
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op3_toxic_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How toxic each document is, learned from labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(crc_rest("doc_id", 4) != 2)
    by_id = docs.select(F.col("doc_id").alias("id"), "text", "lang")
    model = toxicity.train(by_id, labels.select(F.col("doc_id").alias("id"), "toxic"))
    given = docs.select("doc_id", F.coalesce(crc_rest("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "text")
    return toxicity.score(given, model).select(
        "doc_id", "held_out", "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    )


def op4_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each text when strings of 200 bytes that occur again are removed."""
    cut = repeats.remove_repeats(table(spark, sf_dir, "documents"), length=200)
    return cut.select(
        "row.doc_id", "n_bytes", "n_removed",
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op5_trie_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tokens the best cut of each document has."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = tokencount.token_counts(docs, public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN)
    return counted.select("row.doc_id", "n_tokens", "score")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text."""
    import public_tokenizers

    coded = bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN)
    return coded.select(
        "row.doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of each page."""
    found = extract.main_text(table(spark, sf_dir, "pages"))
    return found.select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found for each vector whose id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0), k=20)


def op9_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How good each document is, learned from labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(crc_rest("doc_id", 4) == 2, F.lit(False))
    labels = table(spark, sf_dir, "labels").filter(~held)
    model = quality.train(docs, labels)
    given = docs.select("doc_id", held.alias("held_out"), "text", "lang", "source")
    return quality.score(given, model).select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near copies of each document, named after its least id."""
    found = nearcopies.near_copies(table(spark, sf_dir, "documents"), least=0.8, width=5)
    return found.select("doc_id", "class_id", "n_class", "stays")


def op11_gram_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents, with the more frequent word each is a variant of."""
    words = spelling.vocabulary(table(spark, sf_dir, "documents"), least_letters=5, least_count=3, noise=97)
    return spelling.variants(words, ratio=2).select("word", "form", "root", "n", "n_near", "form_n")


def op12_pca_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of each vector after three rounds from sixteen centroids."""
    found = centroids.cluster(table(spark, sf_dir, "embeddings"), k=16, rounds=3, dims=64, scale=64)
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ",").cast("binary"), 256)
    return found.select("row.vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def op13_cover_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each text when passages of an earlier document are removed."""
    cut = covers.remove_later(table(spark, sf_dir, "documents"), span=13)
    return cut.select("row.doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_bayes": op1_ngram_bayes,
    "op2_winnowing": op2_winnowing,
    "op3_toxic_conv": op3_toxic_conv,
    "op4_suffix_repeats": op4_suffix_repeats,
    "op5_trie_counts": op5_trie_counts,
    "op6_bpe": op6_bpe,
    "op7_style_tree": op7_style_tree,
    "op8_cross_polytope": op8_cross_polytope,
    "op9_co_training": op9_co_training,
    "op10_bagminhash": op10_bagminhash,
    "op11_gram_variants": op11_gram_variants,
    "op12_pca_centroids": op12_pca_centroids,
    "op13_cover_passages": op13_cover_passages,
}

#: DuckDB text of the queries that SQL can express on whole tables.
ORACLES: dict[str, str] = twins.ORACLES
