import os

import pytest
from pyspark.sql import functions as F

from checks.queries import QUERIES
from utterlake.operators import classify, dedup, features, joins, respond, retrieve, split
from utterlake.session import materialize, scratch_root, scratch_scope

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_lookup_equals_a_plain_join(spark, how):
    facts = spark.range(2000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    table = spark.createDataFrame([("hot", 1), ("1", 2), ("4", 3), ("none", 4)], "k string, v int")
    sizes = facts.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    hot = joins.hot_keys(sizes, ["k"], "n", limit=2)
    got = joins.salted_lookup(facts, table, ["k"], hot, ["id"], how)
    want = facts.join(table, "k", how)
    assert sorted(map(str, got.select("id", "k", "v").collect())) == sorted(map(str, want.select("id", "k", "v").collect()))


def test_hybrid_lookup_equals_a_plain_join_and_moves_no_hot_row(spark):
    facts = materialize(spark.range(2000).select(F.col("id"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("k")), "facts")
    facts = facts.unionByName(spark.createDataFrame([(5000, None)], "id bigint, k string"))
    table = materialize(spark.createDataFrame([("hot", 1, 1333), ("3", 2, 1), ("6", 3, 1), ("none", 4, 0)], "k string, v int, n int"), "values")
    hot = joins.hot_values(table, ["k"], "n", limit=1)
    assert [r["k"] for r in hot.collect()] == ["hot"]
    got = joins.hybrid_lookup(facts, table, ["k"], hot)
    want = facts.join(table, "k")
    assert sorted(map(str, got.select("id", "k", "v").collect())) == sorted(map(str, want.select("id", "k", "v").collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        heavy = plan_of(joins.hybrid_lookup(facts, table, ["k"], hot)).split("SortMergeJoin")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert "BroadcastHashJoin" in heavy and "hashpartitioning" not in heavy


def test_a_hot_key_is_spread(spark):
    facts = spark.range(3200).select("id", F.lit("hot").alias("k"))
    table = spark.createDataFrame([("hot", 1)], "k string, v int")
    hot = joins.hot_keys(spark.createDataFrame([("hot", 9)], "k string, n int"), ["k"], "n")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = joins.salted_lookup(facts, table, ["k"], hot, ["id"])
        sizes = joined.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(r["count"] for r in sizes) == 3200
    assert max(r["count"] for r in sizes) < 2200


def test_rule_tables_are_broadcast_only_while_small(spark, monkeypatch):
    rows = [(str(n), n) for n in range(20)]
    assert "ResolvedHint" in joins.small_table(spark, rows, "k string, v int")._jdf.queryExecution().analyzed().toString()
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 10)
    assert "ResolvedHint" not in joins.small_table(spark, rows, "k string, v int")._jdf.queryExecution().analyzed().toString()


def test_scratch_is_the_named_checkpoint_folder(spark):
    root = scratch_root(spark)
    assert root == spark.sparkContext.getConf().get("spark.checkpoint.dir")
    df = materialize(spark.range(5).withColumn("x", F.lit("a")), "t")
    assert df.inputFiles()[0].replace("file:///", "/").startswith(root) and df.count() == 5


def test_no_nested_loop_or_cross_join_in_the_main_plans(spark):
    rows = [("pay", 1, "pay my bill", "r"), ("card", 2, "lost my card", "s")]
    known = spark.createDataFrame(rows, "intent string, ex_id bigint, text string, response string")
    index = retrieve.build_index(known)
    model = classify.fit_naive_bayes(known.withColumnRenamed("ex_id", "row_id"))
    asked = spark.createDataFrame([(1, "pay", "pay a bill")], "qid bigint, intent string, text string")
    plans = [
        plan_of(retrieve.similarity_top1(asked, index)),
        plan_of(model.predict(asked, "qid")),
        plan_of(dedup.dedup_first(known.withColumnRenamed("ex_id", "position"))),
        plan_of(features.Tfidf(index.vocab, "intent").vectors(features.char_bags(asked, "qid", carry=["intent"]), "qid")),
        plan_of(respond.keyword_route(asked.withColumnRenamed("intent", "predicted_intent"), [{"intent": "a", "patterns": ["b"], "priority": 1}])),
    ]
    for plan in plans:
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert "Exchange" not in plans[-1]


def test_columns_and_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).select(
        F.col("id").alias("position"), F.lit("t").alias("text"), F.lit("i").alias("intent"), F.lit("u").alias("unused")
    ).write.parquet(path)
    df = spark.read.parquet(path).where("intent = 'i'")
    plan = plan_of(df.groupBy("intent").count())
    assert "unused" not in plan and "EqualTo(intent,i)" in plan
    dedup_plan = plan_of(dedup.dedup_first(df).select("position", "text"))
    assert "unused" not in dedup_plan


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["clean_text", "normalize_intent", "focus_filter", "length_filter"])
def test_row_by_row_queries_move_nothing(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_a_scope_deletes_its_scratch(spark, tmp_path):
    with scratch_scope(spark) as folder:
        kept = materialize(spark.range(3), "x")
        assert kept.count() == 3 and os.path.isdir(folder.removeprefix("file:"))
        kept.write.parquet(str(tmp_path / "out"))
    assert not os.path.exists(folder.removeprefix("file:"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_splits_move_no_wide_rows(spark):
    rows = spark.range(500).select(F.col("id").alias("row_id"), (F.col("id") % 7).cast("string").alias("intent"), F.lit("wide").alias("text"))
    plan = split.stratified_split(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
