"""The pipeline against brute-force versions of its stages."""

import os

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline as cp
from spanloom.llm import bpe
from spanloom.llm.rows import stored
from .test_decontaminate import brute as contaminated
from .test_nearcopies import brute as classes
from .test_repeats import brute as cut

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row string"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), f"r{i}") for i, t in enumerate(texts)], COLUMNS)


def sentence(seed, n):
    words = "the of and thion erly stand would never again river mountain bright colour plain letter number question".split()
    return " ".join(words[(seed * 7919 + i * i * 31 + i * seed) % len(words)] + str((seed * 31 + i * 17) % 97) for i in range(n))


def test_stages_one_by_one(spark, tmp_path):
    passage, leak = sentence(1, 60), sentence(2, 30)
    texts = [None, "", "12 34", "!!", sentence(10, 40), sentence(11, 80)]
    texts += [sentence(11, 80) + " end", sentence(12, 50) + "\n" + passage + "\n" + sentence(13, 20), sentence(14, 90) + " " + passage]
    texts += [sentence(15, 30) + " " + " ".join(leak.split()[5:20]) + " " + sentence(16, 30), sentence(17, 5)]
    docs = docs_of(spark, texts)
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    as_rows = lambda df: {r["doc_id"]: r for r in df.collect()}

    one = cp.identified(spark, docs, str(tmp_path))
    assert sorted(as_rows(one)) == list(range(4, len(texts))) and one.columns == docs.columns
    two = cp.without_copies(spark, one, str(tmp_path))
    left = [t for t in texts[4:]]
    want = [i + 4 for i, c in enumerate(classes(left)) if c == i]
    got = as_rows(two)
    assert sorted(got) == want and all(got[i]["text"] == texts[i] and got[i]["row"] == f"r{i}" for i in want)
    three = as_rows(cp.without_repeats(spark, two, str(tmp_path)))
    for i, (_, _, _, kept) in zip(want, cut([texts[i] for i in want], 200)):
        assert three[i]["text"] == kept.decode() and three[i]["n_chars"] == len(kept.decode())
    assert len(three[8]["text"]) < len(texts[8])
    four = as_rows(cp.decontaminated(spark, spark.createDataFrame(list(three.values()), COLUMNS), str(tmp_path)))
    hits = {d: n for d, _, n, _ in contaminated([(i, r["text"]) for i, r in three.items()], [(1, leak)])}
    assert sorted(four) == sorted(i for i in three if not hits[i]) and 9 not in four
    five = as_rows(cp.coded(spark, spark.createDataFrame(list(four.values()), COLUMNS), str(tmp_path)))
    twin = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path(cp.BPE_FILE)), special_tokens={})
    assert all(list(five[i]["ids"]) == twin.encode_ordinary(four[i]["text"]) and five[i]["text"] == four[i]["text"] for i in four)


def test_a_stage_keeps_its_hands_off_the_rows_of_another(spark, tmp_path):
    texts = [sentence(i, 60) + " " + sentence(100, 60) for i in range(6)]
    docs_of(spark, texts).write.parquet(str(tmp_path / "docs"))
    given = lambda: spark.read.parquet(str(tmp_path / "docs"))
    first = cp.without_repeats(spark, given(), str(tmp_path))
    copies = cp.without_copies(spark, given(), str(tmp_path))
    cp.identified(spark, given(), str(tmp_path)).count()
    assert first.count() == 6 and copies.count() == 6


@pytest.mark.parametrize("stage", [cp.without_copies, cp.without_repeats, cp.decontaminated])
def test_no_texts_are_left_behind(spark, tmp_path, stage):
    leak = sentence(2, 30)
    texts = [sentence(i, 60) + " " + sentence(100, 60) for i in range(5)] + [sentence(1, 60)] * 2 + [leak]
    docs_of(spark, texts).write.parquet(str(tmp_path / "docs"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    shared = spark.conf.get("spark.checkpoint.dir")
    tables = lambda: {d for d in os.listdir(shared) if os.path.exists(f"{shared}/{d}/_SUCCESS")}
    had = tables()
    rows = stage(spark, spark.read.parquet(str(tmp_path / "docs")), str(tmp_path))
    (left,) = tables() - had
    kinds = dict(spark.read.parquet(f"{shared}/{left}").dtypes)
    assert {kinds.pop("k1"), kinds.pop("k2")} == {"bigint"} and kinds in ({}, {"runs": "array<struct<first:bigint,last:bigint>>"})
    want = {"without_copies": 7, "without_repeats": sum(1 for *_, kept in cut(texts, 200) if kept)}
    want["decontaminated"] = sum(1 for _, _, n, _ in contaminated(list(enumerate(texts)), [(1, leak)]) if not n)
    assert rows.count() == want[stage.__name__]


def test_shuffle_files_of_a_stored_table_go(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    shuffled = lambda: {f for d in folders for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_") and f.endswith(".data")}
    sums = lambda: spark.range(1000).groupBy((cp.F.col("id") % 7).alias("k")).count()
    had = shuffled()
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    own = spark.conf.get(setting, None)
    assert stored(sums(), "sums").count() == 7
    made = shuffled() - had
    assert len(sums().collect()) == 7
    # Only the count's own shuffle is left, and the caller's setting is as it was.
    assert len(made) <= 1 and shuffled() - had - made and spark.conf.get(setting, None) == own


def test_empty_and_unlabelled(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = docs_of(spark, ["some words", None, "x 1"]).withColumn("lang", cp.F.lit(None).cast("string"))
    for given in (docs.limit(0), docs):
        for _, stage in cp.STAGES[:-1]:
            given = stage(spark, given, str(tmp_path))
            assert given.columns == docs.columns
        assert cp.coded(spark, given, str(tmp_path)).count() == given.count()


def test_whole_run(spark):
    got = cp.run(spark, "/root/testdata/sf0.001").toPandas()
    assert 100 < len(got) <= 200 and got.doc_id.is_unique and (got.n_tokens == got.ids.map(len)).all()
