"""Repeated rows in the operators."""

import random
from collections import Counter

from pyspark.sql import functions as F
from test_operators import documents, words

from lettings.llm import mixing, quality


def test_the_mix_holds_repeated_rows_as_often_as_planned(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES", 2)
    rng = random.Random(71)
    rows = [(i, words(rng, 12), "ab"[i % 2]) for i in range(30)] + [(99, "x y z " * 5, "c")] * 3 + [(None, "null id " * 4, "c")] * 2 + [(99, "x y z " * 5, "a"), (98, None, "c"), (98, "", None)]
    docs = documents(spark, rows)
    plan = Counter()
    for r in mixing.mix(docs).collect():
        plan[r["doc_id"], r["source"]] += r["copies"]
    got = Counter((r["doc_id"], r["source"]) for r in mixing.mixed_documents(docs).collect())
    assert got == +plan and 0 < got[99, "c"] <= 9


def test_repeated_rows_with_other_columns_are_one_document(spark):
    docs = documents(spark, [(1, "one text of some words", "a")] * 4 + [(2, "another text of some words", "b")]).withColumn("size", F.monotonically_increasing_id().cast("int"))
    plan = mixing.mix(docs).agg(F.sum("copies")).first()[0]
    assert mixing.mixed_documents(docs).count() == plan


def test_learning_rows_are_bounded_where_ids_repeat(spark):
    rows = [(i % 5, f"text {i}", "s") for i in range(3000)] + [(i, f"text {i}", "s") for i in range(10, 60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    got = quality.labelled(documents(spark, rows), labels, 20).collect()
    assert len(got) <= 20 and len({r["doc_id"] for r in got}) == len(got)
    again = quality.labelled(documents(spark, rows).repartition(5), labels, 20).collect()
    assert sorted(got) == sorted(again)
