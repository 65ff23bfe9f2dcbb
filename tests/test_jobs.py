"""Table jobs, files, streams, guards."""

import pytest
from pyspark.sql import functions as F

from curvemill import constants as K
from curvemill.operators import catalogue as cat
from curvemill.operators import classify
from curvemill.operators import evaluate as ev
from curvemill.operators.apply import curve_apply_safe
from curvemill.plans.q_jobs import ATTEMPT
from curvemill.session import scratch_path
from curvemill.sources import readers, writers
from curvemill.streaming import incremental as inc


def test_no_shards_give_no_rows(spark):
    assert readers.read_shards(spark, scratch_path(spark, "none"), ATTEMPT).count() == 0


def test_corrupt_shard_is_skipped(spark):
    path = scratch_path(spark, "shards")
    spark.createDataFrame([("a", 0, 1, 1, None)], ATTEMPT).write.parquet(f"{path}/good")
    spark.createDataFrame([("not parquet",)], "value string").write.text(f"{path}/bad")
    assert readers.read_shards(spark, path, ATTEMPT).count() == 1


def test_merge_prefers_success(spark):
    df = spark.createDataFrame([("a", 0, 1, 5, "boom"), ("a", 0, 2, 9, None), ("b", 0, 1, 1, "x"), ("b", 0, 1, 0, "y")], ATTEMPT)
    got = {r["target"]: r["seed"] for r in cat.merge_prefer_success(df, ["target"], ["seed"]).collect()}
    assert got == {"a": 9, "b": 0}


def test_splits_are_disjoint_and_exact(spark):
    df = spark.range(1000).select("id", (F.col("id") % 37).cast("string").alias("target"), F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("label"))
    g = cat.group_split(df, 0.3)
    a, b = (g.where(F.col("split") == s) for s in ("train", "test"))
    cat.assert_disjoint(a, b)
    assert b.select("target").distinct().count() == 12 and a.count() + b.count() == 1000
    s = cat.stratified_split(df, "id", "label", {"train": 0.6, "cal": 0.2, "test": 0.2}).groupBy("label", "split").count().collect()
    assert sum(r["count"] for r in s) == 1000 and {r["count"] for r in s if r["label"] == "x"} == {201, 67, 66}


def test_leak_is_refused(spark):
    a = spark.createDataFrame([("s1",), ("s2",)], "target string")
    with pytest.raises(ValueError, match="1 targets"):
        cat.assert_disjoint(a, spark.createDataFrame([("s2",), ("s3",)], "target string"))
    with pytest.raises(ValueError, match="need a target column"):
        cat.assert_disjoint(a.withColumnRenamed("target", "name"), a)


def test_schema_guard():
    classify.check_schema(K.FEATURE_NAMES)
    with pytest.raises(ValueError):
        classify.check_schema(K.FEATURE_NAMES[:-1])


def test_report_rules(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "y_true int, y_pred int")
    r = {x["c"]: x for x in ev.classification_report(df, 3).collect()}
    assert r[2]["support"] == 0 and r[2]["f1"] == 0.0
    assert r[0]["accuracy"] == pytest.approx(2 / 3) and r[0]["macro_f1"] == pytest.approx(2 / 3)


def test_confidence_of_one_is_in_no_bin(spark):
    df = spark.createDataFrame([(1.0, True)] * 9 + [(0.95, True)] * 5, "confidence double, correct boolean")
    assert [(round(r["centre"], 2), r["n"]) for r in ev.reliability_table(df).collect()] == [(0.95, 5)]


def test_errors_become_rows_and_long_curves_come_in_batches(spark):
    df = spark.createDataFrame([("ok", float(i), 1.0) for i in range(5)] + [("bad", float(i), -1.0) for i in range(5)], "target string, t double, flux double")
    n = 1_200_000
    # dealt out of order
    big = spark.range(n, numPartitions=4).select(F.lit("big").alias("target"), ((F.col("id") * 7919) % n).cast("double").alias("t"), F.lit(1.0).alias("flux"))

    def fn(target, batches):
        rows, parts, last, ordered = 0, 0, float("-inf"), True
        for b in batches:
            if b["flux"].iloc[0] < 0:
                raise RuntimeError("x" * 500)
            ordered &= bool(b["t"].is_monotonic_increasing and b["t"].iloc[0] >= last)
            rows, parts, last = rows + len(b), parts + 1, b["t"].iloc[-1]
        return {"n": rows, "parts": parts, "ordered": ordered}

    got = {r["target"]: r for r in curve_apply_safe(df.unionByName(big), fn, "n long, parts long, ordered boolean").collect()}
    assert got["ok"]["n"] == 5 and got["ok"]["error"] is None
    assert len(got["bad"]["error"]) == 200
    assert got["big"]["n"] == n and got["big"]["parts"] > 1 and got["big"]["ordered"]


def test_incremental_rows_are_right_for_targets_in_several_batches(spark):
    src, out, ckpt = (scratch_path(spark, n) for n in ("in", "rows", "ck"))
    lc = spark.createDataFrame([(f"T{i % 3}", float(i), float(i * i % 97), 0.1, 0) for i in range(90)], readers.CURVE_SCHEMA)
    writers.append_shard(lc.repartition(6), src)
    count = lambda b: b.groupBy("target").agg(F.count("t").alias("n"), F.sum("flux").alias("s"))
    inc.incremental(spark, src, readers.CURVE_SCHEMA, count, out, ckpt, max_files=1).awaitTermination()
    got = {r["target"]: (r["n"], r["s"]) for r in inc.latest(spark, out).collect()}
    assert got == {r["target"]: (r["n"], r["s"]) for r in count(lc).collect()}


def test_incremental_batch_reads_only_its_buckets(spark, monkeypatch):
    """Twelve batches: the files of a batch do not grow with their number, and rows stay right through merged folders."""
    from curvemill.streaming import buckets
    src, out, ckpt = (scratch_path(spark, n) for n in ("in", "rows", "ck"))
    monkeypatch.setattr(buckets, "FOLDERS", 3)
    seen = []
    count = lambda b: (seen.append(len(b.inputFiles())), b.groupBy("target").agg(F.count("t").alias("n"), F.sum("flux").alias("s")))[1]
    rows = []
    for n in range(12):
        rows += [(f"T{i % 3 if n else i}", n + i / 10, float(i * n % 7), 0.1, 0) for i in range(40)]
        writers.append_shard(spark.createDataFrame(rows[-40:], readers.CURVE_SCHEMA).coalesce(1), src)
        inc.incremental(spark, src, readers.CURVE_SCHEMA, count, out, ckpt, buckets=16).awaitTermination()
    got = {r["target"]: (r["n"], r["s"]) for r in inc.latest(spark, out).collect()}
    want = {r["target"]: (r["n"], r["s"]) for r in count(spark.createDataFrame(rows, readers.CURVE_SCHEMA)).collect()}
    assert got == want and len(got) == 40
    # the first batch touches all buckets, the others those of three targets, with at most four folders in each beside the batch's own
    assert seen[0] >= 10 and max(seen[1:12]) <= 3 * 6
    store = buckets.BucketStore(spark, f"{out}/samples", readers.CURVE_SCHEMA, 16)
    assert len(store.folders()) < 16 + 3 * 12 and store.read(store.live()).count() == len(rows)


def test_settled_stream_does_not_read_its_store(spark):
    src, out, ckpt = (scratch_path(spark, n) for n in ("in", "out", "ck"))
    for seed, error in ((5, "Timeout"), (3, "Timeout"), (4, None), (1, None)):
        writers.append_shard(spark.createDataFrame([("a", 0, 1, seed, error), ("b", None, None, seed, "no detection (SDE 3)" if seed == 3 else "Timeout")], ATTEMPT), src)
        q = inc.settled_store(spark, src, ATTEMPT, out, ckpt)
        q.awaitTermination()
        assert out not in str(q.lastProgress["sources"]) and len(q.lastProgress["sources"]) == 1
    got = {r["target"]: (r["seed"], r["error"]) for r in inc.merge_settled(spark.read.parquet(out)).collect()}
    assert got == {"a": (4, None), "b": (3, "no detection (SDE 3)")}


def test_second_run_adds_nothing(spark):
    src, out, ckpt = (scratch_path(spark, n) for n in ("in", "out", "ck"))
    writers.append_shard(spark.createDataFrame([("a", 0, 1, 1, None), ("b", 0, 1, 1, "Timeout")], ATTEMPT), src)
    for _ in range(2):
        inc.settled_store(spark, src, ATTEMPT, out, ckpt).awaitTermination()
    assert spark.read.parquet(out).count() == 2
    writers.append_shard(spark.createDataFrame([("a", 0, 2, 2, None), ("b", 0, 2, 2, None)], ATTEMPT), src)
    inc.settled_store(spark, src, ATTEMPT, out, ckpt).awaitTermination()
    got = {r["target"]: r["seed"] for r in inc.merge_settled(spark.read.parquet(out)).collect()}
    assert got == {"a": 1, "b": 2}


@pytest.mark.parametrize("name", ["best_of_detrenders_corrected", "two_pass_refine", "catalogue_end_to_end"])
def test_queries_without_sql_search_the_default_grid(spark, monkeypatch, name):
    """No number of periods, threshold, number of frequencies or size of the forest is set below the operators' own."""
    import __spark_entry__ as entry
    from curvemill import constants as K
    from curvemill.operators import search
    from curvemill.plans import catalogue_run, q_jobs

    class Searched(Exception):
        pass

    seen, run_catalogue = {}, q_jobs.run_catalogue

    def large(*args, **options):
        seen["grid"] = options.get("n_periods"), {*options} & {"factor", "durations", "min_period", "max_period"}
        raise Searched

    def trials(lc, methods, cen, n_periods, threshold, minimum, best_trials=catalogue_run.best_trials):
        seen["threshold"] = threshold
        return best_trials(lc, methods, cen, n_periods, threshold, minimum)

    monkeypatch.setattr(search, "box_search_large", large)
    monkeypatch.setattr(catalogue_run, "best_trials", trials)
    monkeypatch.setattr(q_jobs.cl, "train", lambda *args, **options: seen.update(train=options))
    monkeypatch.setattr(q_jobs, "run_catalogue", lambda *args, **options: seen.update(options=options) or run_catalogue(*args, **options))
    with pytest.raises(Searched):
        entry.queries()[name](spark, "/root/testdata/sf0.001")
    assert seen["grid"] == (None, set()) and seen.get("threshold", K.SDE_THRESHOLD) == K.SDE_THRESHOLD
    assert not seen.get("train") and not seen.get("options")


def test_compare_schemas(spark):
    """Missing, extra and moved names of saved models against a table's columns."""
    table = spark.createDataFrame([(1, 0.0, 0.0, 0.0)], "vec_id int, a double, b double, c double")
    models = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a", "b"]), (3, ["b", "a", "c"]), (4, ["a", "b", "c", "z"]), (5, [])], "model int, features array<string>")
    got = {r["model"]: (r["features"], r["missing"], r["extra"], r["accepted"]) for r in classify.compare_schemas(models, table, ["a", "b", "c", "z"]).collect()}
    assert got == {1: (3, [], [], True), 2: (2, ["c"], [], False), 3: (3, [], [], False), 4: (4, [], ["z"], False), 5: (0, ["a", "b", "c"], [], False)}


def test_two_stage_draw_takes_bins_alike(spark):
    rows = [(f"s{i}", "bright" if i < 5 else "faint") for i in range(500)] + [("x", None)]
    m = spark.createDataFrame(rows, "target string, brightness_bin string")
    got = cat.two_stage_draw(m, 2000, seed=3).toPandas()
    n = got["brightness_bin"].value_counts()
    assert len(got) == 2000 and got["draw"].nunique() == 2000 and abs(n["bright"] - 1000) < 120 and "x" not in set(got["target"])
    assert set(got.loc[got["brightness_bin"] == "bright", "target"]) == {f"s{i}" for i in range(5)}
    alike = cat.two_stage_draw(m.where("target = 'x'"), 7)
    assert [r["target"] for r in alike.collect()] == ["x"] * 7
    assert cat.two_stage_draw(m.where("false"), 7).count() == 0


def test_replaced_table_is_swapped_at_once(spark):
    path = scratch_path(spark, "table")
    writers.replace_table(spark.createDataFrame([(1,)], "a int"), path)
    old = readers.read_table(spark, path)
    broken = spark.createDataFrame([(2,)], "a int").select(F.when(F.col("a") == 2, F.raise_error(F.lit("killed")).cast("int")).alias("a"))
    with pytest.raises(Exception, match="killed"):
        writers.replace_table(broken, path)
    assert [r["a"] for r in readers.read_table(spark, path).collect()] == [1]
    writers.replace_table(readers.read_table(spark, path).select((F.col("a") + 10).alias("a")), path)
    assert [r["a"] for r in old.collect()] == [1] and [r["a"] for r in readers.read_table(spark, path).collect()] == [11]
    for n in range(4):
        writers.replace_table(spark.createDataFrame([(n,)], "a int"), path)
    assert [r["a"] for r in readers.read_table(spark, path).collect()] == [3]


def test_skipped_shards_are_counted(spark, tmp_path):
    assert readers.shard_files(spark, str(tmp_path / "none"), ATTEMPT).count() == 0
    path = str(tmp_path / "shards")
    writers.append_shard(spark.createDataFrame([("a", 0, 1, 1, None)] * 3, ATTEMPT).coalesce(1), path)
    writers.append_shard(spark.createDataFrame([], ATTEMPT).coalesce(1), path)
    whole = next(p for p in (tmp_path / "shards").glob("*.parquet"))
    (tmp_path / "shards" / "cut.parquet").write_bytes(whole.read_bytes()[:-9])
    (tmp_path / "shards" / "tiny.parquet").write_bytes(b"PAR1")
    got = sorted((r["n_rows"], r["broken"]) for r in readers.shard_files(spark, path, ATTEMPT).collect())
    assert got == [(0, False), (0, True), (0, True), (3, False)]


def test_unreadable_shards_are_not_read_whole(spark, tmp_path):
    """A shard cut short may be of any size; its ends tell that it is broken."""
    path = str(tmp_path / "shards")
    spark.range(3).selectExpr("'a' AS target", "id AS label_idx", "1 AS shard", "id AS seed", "'' AS error").coalesce(1).write.parquet(path)
    (tmp_path / "shards" / "cut.parquet").write_bytes(b"PAR1" + b"x" * 50_000)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 10_000)
    try:
        got = sorted((r["n_rows"], r["broken"]) for r in readers.shard_files(spark, path, ATTEMPT).where("path like '%.parquet'").collect())
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert got == [(0, True), (3, False)]


def _without_broadcast(spark, make):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        return make()._jdf.queryExecution().executedPlan().toString(), make()._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_recovery_bias_shuffles_no_rows_by_parameter(spark):
    from curvemill.operators import evaluate
    from curvemill.plans.views import view
    plan, _ = _without_broadcast(spark, lambda: evaluate.recovery_bias(view(spark, "/root/testdata/sf0.001", "recovery"), ["depth", "period"]))
    assert plan.count("SortMergeJoin") <= 1  # of two tables of one row a parameter


def test_class_except_joins_distinct_labels(spark):
    import __spark_entry__ as entry
    _, plan = _without_broadcast(spark, lambda: entry.queries()["class_except"](spark, "/root/testdata/sf0.001"))
    below = plan[plan.index("LeftAnti"):]
    assert below.count("Aggregate [label") == 2


def test_settled_attempts_are_kept_by_sparks_own_aggregate(spark):
    """No Python call for each target: its cost was most of a run with a million targets."""
    src, out, ckpt = (scratch_path(spark, n) for n in ("in", "out", "ck"))
    writers.append_shard(spark.createDataFrame([("a", 0, 1, 1, None)], ATTEMPT), src)
    q = inc.settled_store(spark, src, ATTEMPT, out, ckpt)
    q.awaitTermination()
    assert [o["operatorName"] for o in q.lastProgress["stateOperators"]] == ["stateStoreSave"]
