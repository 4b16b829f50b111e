"""Models are checked by properties; fitted values are not compared with another library."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from caregauge.operators import artefacts
from caregauge.operators import readmission_model as forest
from caregauge.operators import risk_model as risk
from caregauge.operators import segmentation as seg
from caregauge.operators.learning import (
    auc_table,
    balanced_weight,
    dictionary,
    label_counts,
    mean_auc,
    roc_auc,
    stratified_folds,
    with_codes,
)
from caregauge.plans.given import RANGES, TREES, forest_rows
from caregauge.session import layout, stage, staging


@pytest.fixture(scope="module")
def stays(spark):
    """1500 admissions whose readmission depends on severity and stay."""
    rng = random.Random(3)
    rate = {"Mild": 0.02, "Moderate": 0.1, "Severe": 0.4, "Critical": 0.7}
    rows = []
    for i in range(1500):
        severity = rng.choice(list(rate))
        stay = rng.randint(1, 20)
        again = int(rng.random() < rate[severity] * (0.7 + stay / 40))
        bill = round(stay * 1000 * rng.uniform(0.7, 1.4), 2)
        rows.append(
            (f"A{i}", f"P{i % 400}", f"D{i % 3 + 1}", rng.choice(["Cardio", "General"]), rng.choice("xyz"),
             severity, rng.choice(["ICU", "General"]), "Urgent", rng.choice(["Alpha", "Beta"]), stay, bill,
             round(bill / 2, 2), round(bill - round(bill / 2, 2), 2), again, "Recovered")
        )
    df = spark.createDataFrame(
        rows,
        "admission_id string, patient_id string, doctor_id string, department_name string, diagnosis string,"
        " severity string, bed_type string, admission_type string, insurance_provider string,"
        " length_of_stay int, total_bill double, insurance_covered double, patient_paid double,"
        " readmitted_30days int, outcome string",
    )
    return stage(df.withColumn("admission_date", F.expr("date_add(date'2021-01-01', length_of_stay * 7)")))


@pytest.fixture(scope="module")
def people(spark):
    rows = [(f"P{i}", None if i == 0 else 20 + i % 60, None if i == 1 else "Male") for i in range(400)]
    return spark.createDataFrame(rows, "patient_id string, age int, gender string")


def test_codes_are_alphabetical_with_missing_last(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",)], "x string")
    assert {r.x: r.code for r in with_codes(df, {"x": "code"}).collect()} == {"a": 0, "b": 1, "c": 2, None: 3}


def test_codes_of_large_vocabularies_are_joined_by_shuffle(spark):
    """A million distinct texts; none reaches the driver, and the codes are the alphabetical positions."""
    df = stage(spark.range(1_000_000).selectExpr("concat('t', id) AS x", "'one' AS y", "id"))
    coded = with_codes(df, {"x": "xc", "y": "yc"})
    plan = coded._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    row = coded.agg(F.min("xc"), F.max("xc"), F.count_distinct("xc"), F.max("yc"), F.count("*")).first()
    assert tuple(row) == (0, 999_999, 1_000_000, 0, 1_000_000)
    order = sorted(f"t{i}" for i in range(1_000_000))
    for r in coded.where("id % 99991 = 0").collect():
        assert order[r.xc] == r.x


def test_dictionary_keeps_columns_apart_and_leaves_out_nulls(spark):
    df = spark.createDataFrame([("b", "b"), ("a", None), (None, "c"), ("b", "c")], "x string, y string")
    found = {(r.column, r.value, r.code) for r in dictionary(df, ["x", "y"]).collect()}
    assert found == {("x", "a", 0), ("x", "b", 1), ("y", "b", 0), ("y", "c", 1)}
    empty = with_codes(df.where("false"), {"x": "xc"})
    assert empty.columns == ["x", "y", "xc"] and empty.count() == 0


def test_folds_keep_rows_without_a_key_and_repeated_ones(spark):
    rows = [(None, 0, "p"), (None, 0, "q"), (None, 1, "p"), ("k", 0, "p"), ("k", 0, "p"), ("m", None, "p")]
    df = spark.createDataFrame(rows, "key string, y int, rest string")
    found = stratified_folds(df.repartition(3), "key", "y", 2, "s")
    assert sorted(map(repr, (tuple(r)[:3] for r in found.collect()))) == sorted(map(repr, rows))
    again = stratified_folds(df.repartition(5), "key", "y", 2, "s")
    assert sorted(map(repr, found.collect())) == sorted(map(repr, again.collect()))


def test_folds_read_their_input_once_and_sort_it_once(spark, tmp_path, monkeypatch):
    from caregauge.operators import ranking

    spark.range(1000).selectExpr("id", "cast(id % 3 = 0 as int) AS y").write.parquet(str(tmp_path / "t"))
    sorted_plans = []
    real = ranking.stage

    def watched(df):
        sorted_plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df)

    monkeypatch.setattr(ranking, "stage", watched)
    dealt = stratified_folds(spark.read.parquet(str(tmp_path / "t")), "id", "y", 5, "s")
    (plan,) = sorted_plans
    assert plan.count("FileScan") == 1 and plan.count("rangepartitioning") == 1 and "Join" not in plan
    last = dealt._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in last and str(tmp_path) not in last


def test_folds_are_stratified_and_do_not_depend_on_partitions(spark):
    df = spark.range(5003).withColumn("y", (F.col("id") % 7 == 0).cast("int"))
    once = stratified_folds(df.repartition(3), "id", "y", 5, "s").select("id", "y", "fold")
    again = stratified_folds(df.repartition(11), "id", "y", 5, "s").select("id", "y", "fold")
    assert sorted(once.collect()) == sorted(again.collect())
    for label in (0, 1):
        sizes = [r["count"] for r in once.where(F.col("y") == label).groupBy("fold").count().collect()]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_folds_keep_rows_without_a_label(spark):
    df = spark.createDataFrame([(i, None if i < 4 else 1) for i in range(9)], "id int, y int")
    assert stratified_folds(df, "id", "y", 2, "s").count() == 9


def test_undefined_auc_is_none(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.5)], "y int, s double")
    assert roc_auc(df, "y", "s") is None
    assert roc_auc(df.where("s > 1"), "y", "s") is None


def test_auc_table_equals_pairs_and_the_library(spark):
    rng = random.Random(9)
    rows = [(rng.randint(0, 1), rng.choice([0.1, 0.2, 0.25, rng.random()])) for _ in range(400)]
    df = spark.createDataFrame([*rows, (1, None), (None, 0.3)], "y int, s double").repartition(7)
    ones, zeros = [s for y, s in rows if y], [s for y, s in rows if not y]
    won = sum((a > b) + (a == b) / 2 for a in ones for b in zeros)
    row = auc_table(df, "y", "s").first()
    assert row.auc == pytest.approx(won / len(ones) / len(zeros), abs=1e-12)
    assert (row.positives, row.negatives) == (len(ones), len(zeros))
    assert mean_auc([df, df], "y", "s") == pytest.approx(row.auc) and mean_auc([df, df.where("y = 1")], "y", "s") is None
    assert tuple(auc_table(df.where("false"), "y", "s").first()) == (0, 0, None)


def test_class_weights_balance(spark):
    df = spark.createDataFrame([(1,), (0,), (0,), (0,)], "y int")
    sums = df.withColumn("w", balanced_weight(label_counts(df, "y"), "y")).groupBy("y").agg(F.sum("w").alias("s")).collect()
    assert {r.y: r.s for r in sums} == {0: pytest.approx(2), 1: pytest.approx(2)}


def test_auc_counts_ties_as_half(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1)], "y int, s double")
    assert roc_auc(df, "y", "s") == pytest.approx(0.875)


def test_features_drop_missing_age_but_keep_missing_gender(stays, people):
    features = forest.readmission_features(stays, people)
    ids = {r.admission_id for r in features.select("admission_id").collect()}
    assert len(ids) == 1500 - 4 and "A0" not in ids and "A1" in ids
    codes = {r.gender_code for r in features.select("gender_code").distinct().collect()}
    assert codes == {0, 1}


def test_split_is_stratified_and_complete(stays, people):
    split = forest.train_test_split_stratified(forest.readmission_features(stays, people))
    rows = split.groupBy("readmitted_30days").agg(
        F.count_if(F.col("part") == "test").alias("held_out"), F.count("part").alias("n")
    ).collect()
    assert sum(r.n for r in rows) == 1496
    assert all(abs(r.held_out - r.n / 5) <= 1 for r in rows)


def test_forest_does_not_depend_on_how_rows_are_laid_out(stays, people):
    features = forest.readmission_features(stays, people)
    parts = [
        forest.predict(forest.fit_forest(features.repartition(n), trees=5), features)
        .select("admission_id", "probability")
        .collect()
        for n in (1, 7)
    ]
    assert sorted(parts[0]) == sorted(parts[1])


def test_layout_follows_from_the_rows_alone():
    assert [layout(n) for n in (0, 1, 15_000, 8_000_000, 8_000_001)] == [16, 16, 16, 16, 17]
    assert layout(10**11) == 200_000 and layout(100, 10, 1) == 10


def test_walk_over_exported_nodes_equals_the_model_and_sql(stays, people):
    features = forest.readmission_features(stays, people)
    train, test = forest._parts(features)
    model = forest.fit_forest(train, trees=12, depth=6)
    nodes = stage(forest.forest_nodes(model))
    assert nodes.count() == sum(t.numNodes for t in model.trees)
    expected = {r.admission_id: (r.prediction, r.probability) for r in forest.predict(model, test).collect()}
    walked = forest.walk(test, nodes)
    found = {r.admission_id: (r.prediction, r.probability) for r in walked.collect()}
    assert found.keys() == expected.keys() and len(found) > 200
    for key, (prediction, probability) in expected.items():
        assert found[key][0] == prediction and found[key][1] == pytest.approx(probability, abs=1e-12)
    # The same from the nodes in SQL, by recursion, with the four cells.
    node_frame, test_frame = nodes.toPandas(), test.toPandas()  # noqa: F841
    inputs = ", ".join(f"{f}::DOUBLE" for f in forest.FEATURES)
    sql = f"""
        WITH RECURSIVE walk AS (
          SELECT admission_id, readmitted_30days, [{inputs}] AS x, tree, 0 AS node
          FROM test_frame, (SELECT DISTINCT tree FROM node_frame)
          UNION ALL
          SELECT admission_id, readmitted_30days, x, walk.tree,
                 CASE WHEN x[feature + 1] <= threshold THEN "left" ELSE "right" END
          FROM walk JOIN node_frame n ON n.tree = walk.tree AND n.node = walk.node AND feature >= 0
        )
        SELECT admission_id, any_value(readmitted_30days) AS y, avg(share) AS p
        FROM walk JOIN node_frame n ON n.tree = walk.tree AND n.node = walk.node AND feature < 0
        GROUP BY admission_id
    """
    rows = duckdb.sql(sql).fetchall()
    assert {k: pytest.approx(p, abs=1e-12) for k, _, p in rows} == {k: p for k, (_, p) in expected.items()}
    cells = {(a, b): 0 for a in (0, 1) for b in (0, 1)}
    for _, y, p in rows:
        cells[y, int(p > 0.5)] += 1
    assert {(r.actual, r.predicted): r.admissions for r in forest.confusion_matrix(walked).collect()} == cells
    # The held-out area of the stored scores, from pairs in SQL.
    scores = forest.predict(model, test).toPandas()  # noqa: F841
    (area,) = duckdb.sql("""
        SELECT avg(CASE WHEN a.probability > b.probability THEN 1 WHEN a.probability = b.probability THEN 0.5 ELSE 0 END)
        FROM scores a, scores b WHERE a.readmitted_30days = 1 AND b.readmitted_30days = 0""").fetchall()[0]
    assert roc_auc(forest.predict(model, test), forest.LABEL, "probability") == pytest.approx(area, abs=1e-12)


def test_walk_of_a_given_forest(spark):
    nodes = spark.createDataFrame(forest_rows(), forest.NODES)
    rng = random.Random(2)
    rows = [(f"A{i}", 0, *(float(rng.randint(lo, hi)) for lo, hi in RANGES)) for i in range(50)]
    schema = "admission_id string, readmitted_30days int, " + ", ".join(f"{f} double" for f in forest.FEATURES)
    by_node = {(r[0], r[1]): r for r in forest_rows()}
    for r in forest.walk(spark.createDataFrame(rows, schema), nodes).collect():
        shares = []
        for tree in range(TREES):
            node = by_node[tree, 0]
            while node[2] >= 0:
                node = by_node[tree, node[4] if r[forest.FEATURES[node[2]]] <= node[3] else node[5]]
            shares.append(node[6])
        assert r.probability == sum(shares) / TREES and r.prediction == int(sum(shares) / TREES > 0.5)


def test_one_forest_fit_serves_all_reports(spark, stays, people, monkeypatch):
    fits = []
    real = forest.fit_forest
    monkeypatch.setattr(forest, "fit_forest", lambda *a, **k: fits.append(1) or real(*a, **k))
    with staging(spark):
        features = forest.readmission_features(stays, people)
        reports = [
            forest.readmission_model(features, trees=8),
            forest.walked_model(features, trees=8),
            forest.confusion_matrix(forest.readmission_model(features, trees=8)),
            forest.confusion_matrix(forest.walked_model(features, trees=8)),
            forest.feature_importance(features, trees=8),
            # Another frame of the same rows.
            forest.feature_importance(forest.readmission_features(stays.repartition(3), people), trees=8),
        ]
        found = [sorted(map(repr, r.collect())) for r in reports]
        assert len(fits) == 1 and found[2] == found[3] and found[4] == found[5]
        area = forest.model_auc(features, folds=2, trees=8).first()
        assert len(fits) == 3 and forest.model_auc(features, folds=2, trees=8).first() == area and len(fits) == 3
        forest.feature_importance(features.where("month > 2"), trees=8)
        forest.feature_importance(features, trees=9)
        assert len(fits) == 5
    with staging(spark):  # what was kept went with its block
        forest.feature_importance(forest.readmission_features(stays, people), trees=8).collect()
        assert len(fits) == 6


def test_settings_stand_beside_a_kept_model(spark, stays, people, tmp_path, monkeypatch):
    monkeypatch.setattr(artefacts, "scratch_folder", lambda spark: str(tmp_path))
    features = forest.readmission_features(stays, people)
    model = forest.kept_forest(features, trees=2)
    (folder,) = (tmp_path / "models").iterdir()
    settings = artefacts.read_settings(spark, str(folder / "settings"))
    assert settings == {"trees": 2, "depth": 7, "key": "admission_id", "seed": 42, "rows": 1496, "partitions": 16}
    assert forest.node_table(spark, str(folder / "model")).count() == sum(t.numNodes for t in model.trees)


def test_one_risk_fit_serves_all_reports(spark, stays, people, doctors, monkeypatch):
    fits = []
    real = risk.fit_risk_model
    monkeypatch.setattr(risk, "fit_risk_model", lambda *a, **k: fits.append(1) or real(*a, **k))
    with staging(spark):
        frame = risk.risk_frame(stays, people, doctors)
        first = risk.expected_probability(frame, folds=2).select("admission_id", "expected_prob").collect()
        again = risk.expected_probability(frame, folds=2).select("admission_id", "expected_prob").collect()
        assert sorted(first) == sorted(again) and len(fits) == 1
        for r in risk.risk_model_optimality(frame, folds=2).collect():
            assert r.gradient < risk.GRADIENT and r.off_block < 1e-9 and r.monotone and r.blocks > 1
        assert len(fits) == 1


def test_optimality_sees_a_fit_that_stopped_early(spark, stays, people, doctors):
    frame = risk.risk_frame(stays, people, doctors)
    assert all(r.gradient > risk.GRADIENT for r in risk.risk_model_optimality(frame, folds=2, max_iter=1).collect())


def test_forest_finds_the_drivers(stays, people):
    features = forest.readmission_features(stays, people)
    row = forest.model_auc(features, folds=2, trees=20).first()
    assert row.auc > 0.75 and row.cv_auc > 0.75 and row.admissions == 1496
    importance = forest.feature_importance(features, trees=20).collect()
    assert importance[0].feature == "severity_code" and importance[0].important
    assert sum(r.importance for r in importance) == pytest.approx(1)
    predictions = stage(forest.readmission_model(features, trees=20))
    matrix = forest.confusion_matrix(predictions).collect()
    assert [(r.actual, r.predicted) for r in matrix] == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert sum(r.admissions for r in matrix) == predictions.count()


def test_confusion_matrix_keeps_empty_cells(spark):
    df = spark.createDataFrame([(0, 0), (1, 0)], "readmitted_30days int, prediction int")
    assert [r.admissions for r in forest.confusion_matrix(df).collect()] == [1, 0, 1, 0]


def test_risk_frame_fills_age_with_the_admission_median(stays, people, doctors):
    frame = risk.risk_frame(stays, people, doctors)
    assert frame.count() == 1500
    ages = stays.join(people, "patient_id").agg(F.median("age")).first()[0]
    assert {r.age for r in frame.where("patient_id = 'P0'").select("age").collect()} == {ages}
    assert {r.gender for r in frame.where("patient_id = 'P1'").collect()} == {"Unknown"}


def test_expected_probability_is_calibrated_and_ranks(stays, people, doctors):
    frame = risk.risk_frame(stays, people, doctors)
    scored = stage(risk.expected_probability(frame, folds=3))
    row = scored.agg(
        F.avg("expected_prob").alias("p"), F.avg("readmitted_30days").alias("y"),
        F.min("expected_prob").alias("low"), F.max("expected_prob").alias("high"),
    ).first()
    assert row.p == pytest.approx(row.y, abs=0.02)
    assert 0 <= row.low and row.high <= 1
    assert roc_auc(scored, "readmitted_30days", "expected_prob") > 0.6
    assert scored.count() == 1500 and "expected_prob" in scored.columns
    area = risk.risk_model_cv_auc(frame, folds=2, max_iter=50).first().cv_auc
    assert 0.5 < area <= 1


def pooled(points):
    """Pool adjacent violators over (score, mean, weight), in plain Python."""
    blocks = []
    for score, mean, weight in sorted(points):
        blocks.append([mean, weight, [score]])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            m, w, scores = blocks.pop()
            b = blocks[-1]
            b[0], b[1], b[2] = (b[0] * b[1] + m * w) / (b[1] + w), b[1] + w, b[2] + scores
    return {score: mean for mean, _, scores in blocks for score in scores}


def test_calibration_is_isotonic_on_exact_scores(stays, people, doctors):
    frame = risk.risk_frame(stays, people, doctors)
    regression, calibration = risk.fit_risk_model(frame, folds=2).pairs[0]
    dealt = stratified_folds(frame, "admission_id", risk.LABEL, 2, "calibration", "_inner")
    held_out = risk._features(dealt.where("_inner = 0"))
    scored = regression.transform(held_out).withColumn("margin", risk._margin("rawPrediction"))
    points = scored.groupBy("margin").agg(F.avg(risk.LABEL).alias("y"), F.count("*").alias("n")).collect()
    expected = pooled([(r.margin, r.y, r.n) for r in points])
    assert len(expected) > 500
    for r in calibration.setFeaturesCol("margin").transform(scored.select("margin")).collect():
        assert r.prediction == pytest.approx(expected[r.margin], abs=1e-9)


def test_segments_separate_clear_groups(spark):
    rng = random.Random(5)
    centres = [(100.0, 1, 2.0, 0, 20), (900.0, 2, 3.0, 0, 30), (300.0, 9, 2.0, 4, 50), (400.0, 3, 15.0, 1, 70)]
    rows = []
    for i in range(400):
        spend, visits, stay, again, age = centres[i % 4]
        rows.append((i, i % 4, round(spend + rng.random(), 2), visits, stay + rng.random() / 10, again, age))
    df = spark.createDataFrame(
        rows, "patient_id int, truth int, total_spend double, visits int, avg_los double, readmissions int, age int"
    )
    segments = stage(seg.segment_patients(df, restarts=3))
    assert segments.select("truth", "segment").distinct().count() == 4
    labelled = seg.segment_labels(segments)
    names = {r.truth: r.segment_label for r in labelled.select("truth", "segment_label").distinct().collect()}
    assert names == {0: "Low Engagement", 1: "High Value", 2: "Frequent", 3: "Complex Care"}
    assert [r.patients for r in seg.segment_summary(labelled).collect()] == [100] * 4
    profile = seg.segment_profile_minmax(labelled).collect()
    for column in seg.PROFILE:
        values = [r[column] for r in profile]
        assert min(values) == 0 and max(values) == pytest.approx(1)


def test_centres_equal_the_library_and_assign_the_nearest(spark):
    rng = random.Random(6)
    rows = [(i, rng.gauss(i % 4 * 50, 9), rng.randint(1, 9), rng.gauss(5, 2), rng.randint(0, 3), rng.randint(20, 80)) for i in range(300)]
    df = stage(spark.createDataFrame(rows, "patient_id int, total_spend double, visits int, avg_los double, readmissions int, age int"))
    made = seg.fit_segments(df, k=4, restarts=2)
    table = made.table(spark)
    assert seg.Segments.from_table(table) == made and table.count() == 4
    scale = {c: (df.agg(F.avg(c), F.stddev_samp(c)).first()) for c in seg.FEATURES}
    for r in made.assign(df).collect():
        at = [(r[c] - scale[c][0]) / scale[c][1] for c in seg.FEATURES]
        away = [sum((a - b) ** 2 for a, b in zip(at, c, strict=True)) for c in made.centres]
        assert r.distance == pytest.approx(min(away)) and away[r.segment] == pytest.approx(min(away))
    # No single step of the algorithm finds anything better: every centre is the mean of its points.
    again = seg.segments_of(made.assign(df), "segment")
    for a, b in zip(again.centres, made.centres, strict=True):
        assert a == pytest.approx(b, abs=1e-3)


def test_equal_distances_go_to_the_first_centre(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0)], "patient_id int, a double, b double")
    made = seg.Segments([0.0, 2.0], [1.0, 0.0], [[2.0, 0.0], [0.0, 0.0], [1.5, 0.0]], ("a", "b"))
    (row,) = made.assign(df).collect()
    assert (row.segment, row.distance) == (2, 0.25)
    made.centres.pop()
    assert made.assign(df).first().segment == 0


def test_one_clustering_serves_all_reports(spark, monkeypatch):
    fits = []
    real = seg.fit_segments
    monkeypatch.setattr(seg, "fit_segments", lambda *a, **k: fits.append(1) or real(*a, **k))
    df = spark.range(60).selectExpr("id patient_id", "double(id % 7) total_spend", "id % 3 visits", "double(id % 5) avg_los", "id % 2 readmissions", "id % 50 age")
    with staging(spark):
        found = [sorted(map(repr, seg.segment_patients(df, restarts=1).collect())) for _ in range(3)]
        assert len(fits) == 1 and found[0] == found[1] == found[2]


def test_later_label_rules_win(spark):
    rows = [(0, 900.0, 9, 9.0), (1, 1.0, 1, 1.0), (2, 500.0, 5, 5.0)]
    df = spark.createDataFrame(rows, "segment int, total_spend double, visits int, avg_los double")
    labels = {r.segment: r.segment_label for r in seg.segment_labels(df).collect()}
    assert labels == {0: "Complex Care", 1: "Low Engagement", 2: "Segment 2"}
    one = df.where("segment = 0")
    assert seg.segment_labels(one).first().segment_label == "Low Engagement"
