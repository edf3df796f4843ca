import time

import public_tokenizers
from pyspark.sql import functions as F

from tickpulse.llm import components, word_bpe
from tickpulse.llm.scratch import written


def shuffle_files(spark):
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}


def test_a_write_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    df = spark.range(10_000).groupBy((F.col("id") % 97).alias("k")).agg(F.sum("id").alias("n"))
    setting = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    table = written(df, "sums")
    for _ in range(50):  # they are deleted in the background
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting
    assert sorted(table.collect()) == sorted(df.collect())


def test_components_delete_what_they_are_done_with(spark, monkeypatch):
    made = []
    monkeypatch.setattr(components, "written", lambda df, name: made.append((name, written(df, name))) or made[-1][1])
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long")
    assert {r.label for r in components.connected_components(edges).collect()} == {0}
    at = [(name, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t._written_at)) for name, t in made]
    there = [name for name, path in at if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)]
    assert there == ["small-star"] and len(at) > 3


def test_the_driver_loads_no_tokenizer(spark):
    word_bpe._ENCODERS.clear()
    docs = spark.createDataFrame([(1, "a few words, a few more")], "doc_id long, text string")
    word_bpe.compile_lexicon(docs, public_tokenizers.path("word_bpe_49k.json"))
    assert not word_bpe._ENCODERS
