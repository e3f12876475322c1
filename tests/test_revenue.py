import math

import pytest
from star_frames import make_star, rows
from pyspark.ml.feature import VectorIndexer
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from ridestats.functions.features import FEATURES
from ridestats.operators import ensembles
from ridestats.plans import anomalies, artifacts, marts, revenue, scenarios
from ridestats.sources import order_star

SF = "/root/testdata/sf0.001"
RIDE = (
    "station_id string, hour int, day_name string, is_weekend boolean, month int, temperature_2m double, "
    "apparent_temperature double, relative_humidity_2m double, bike_type_id int, duracion_minutos double, minutos_incluidos int"
)


def test_features_of_one_ride(spark):
    rides = spark.createDataFrame(
        [("b", 18, "Tuesday", False, 5, 15.0, 17.5, 70.0, 1, 46.0, 30), ("new", 5, "Friday", True, 5, None, 1.0, 71.0, 2, 45.0, 0)], RIDE
    )
    codes = spark.createDataFrame([("a", 0), ("b", 1)], "station_id string, station_id_encoded int")
    got = {r["station_id"]: r for r in revenue.features(rides, codes, keep=("station_id",)).collect()}
    b, new = got["b"], got["new"]
    assert list(b.asDict())[1:] == FEATURES
    assert (b["station_id_encoded"], new["station_id_encoded"]) == (1.0, 0.0)
    assert b["hour_sin"] == pytest.approx(-1.0) and b["hour_cos"] == pytest.approx(0.0, abs=1e-12)
    assert (b["is_rush_hour"], b["is_night"], new["is_rush_hour"], new["is_night"]) == (1, 0, 0, 1)
    assert (b["temp_comfort"], b["humidity_high"], new["temp_comfort"], new["humidity_high"]) == (1, 0, 0, 1)
    assert (b["temp_apparent_diff"], new["temp_apparent_diff"]) == (2.5, 0.0)
    assert (b["duracion_larga"], new["duracion_larga"]) == (1, 0)
    assert b["duracion_normalizada"] == pytest.approx(46 / 30) and new["duracion_normalizada"] == 0.0
    assert [b[f] for f in FEATURES if f.startswith("day_")] == [0, 0, 0, 0, 1, 0]
    assert sum(new[f] for f in FEATURES if f.startswith("day_")) == 0


@pytest.fixture(scope="module")
def models(spark):
    return revenue.train(marts.training_set(order_star(spark, SF)))


def test_models_fit_the_tariff(models):
    got = {r["model"]: r for r in models.metrics.collect()}
    assert set(got) == {"RandomForest", "GradientBoosting"}
    assert all(r["r2"] > 0.9 and r["mae"] <= r["rmse"] for r in got.values())
    assert models.best == max(got, key=lambda m: (got[m]["r2"], m == "GradientBoosting"))


def test_forest_wins_only_when_strictly_better(spark):
    def pick(forest, boosting):
        return revenue.choose(spark.createDataFrame([("RandomForest", forest), ("GradientBoosting", boosting)], "model string, r2 double"))

    assert pick(0.9, 0.8) == "RandomForest"
    assert pick(0.9, 0.9) == pick(0.8, 0.9) == pick(None, 0.1) == "GradientBoosting"


def test_scores_are_floored_and_compared_with_the_tariff(spark, models):
    requests = spark.createDataFrame(
        [("NATION_1", 8, False, 5, 20.0, 60.0, 1, 90), ("nowhere", 8, False, 5, 20.0, 60.0, 1, 10)],
        "station_id string, hour int, is_weekend boolean, month int, temperature double, humidity double, bike_type int, duration int",
    )
    got = {r["station_id"]: r for r in revenue.score(requests, models).collect()}
    long, short = got["NATION_1"], got["nowhere"]
    assert long["theoretical_revenue"] == pytest.approx(23.4) and short["theoretical_revenue"] == 0.0
    assert long["prediction"] > 10 and 0 <= short["prediction"] < 3
    assert long["model_difference"] == pytest.approx(long["prediction"] - 23.4)
    assert long["day_name"] == "Monday"


def test_predictions_from_the_node_tables_equal_those_of_the_models(spark, models):
    rides = marts.training_set(order_star(spark, SF))
    matrix = revenue.assembled(revenue.features(rides, models.codes))
    for model in (models.forest, models.boosting):
        nodes = ensembles.node_table(spark, model, "test")
        assert nodes.count() == sum(t.numNodes for t in model.trees) and ensembles.depth(nodes) == max(t.depth for t in model.trees)
        scored = ensembles.predict(model.transform(matrix), nodes, ensembles.depth(nodes))
        worst, n = scored.agg(F.max(F.abs(F.col(model.getPredictionCol()) - F.col("walked"))), F.count_if(F.col("walked").isNotNull())).first()
        assert worst < 1e-9 and n == rides.count() > 1000


def test_a_single_leaf_and_refused_categories(spark):
    data = spark.createDataFrame([(Vectors.dense([float(i % 3), float(i)]), 1.5) for i in range(30)], ["features", "label"])
    constant = ensembles.node_table(spark, RandomForestRegressor(numTrees=3).fit(data), "constant")
    assert ensembles.depth(constant) == 0
    assert {r["walked"] for r in ensembles.predict(data, constant, 0).collect()} == {1.5}
    rows_ = spark.createDataFrame([(Vectors.dense([float(i % 3), 0.5 * i]), float(i % 3 == 1)) for i in range(60)], ["raw", "label"])
    indexed = VectorIndexer(inputCol="raw", outputCol="features", maxCategories=4).fit(rows_).transform(rows_)
    with pytest.raises(ValueError, match="categorical"):
        ensembles.node_table(spark, RandomForestRegressor(numTrees=2, seed=1).fit(indexed), "categories")


def test_a_new_station_does_not_change_other_rows(spark, models):
    one = [("NATION_3", 8, False, 5, 20.0, 60.0, 1, 60, "Sunday")]
    schema = "station_id string, hour int, is_weekend boolean, month int, temperature double, humidity double, bike_type int, duration int, day_name string"
    alone = revenue.score(spark.createDataFrame(one, schema), models).first()["prediction"]
    mixed = revenue.score(spark.createDataFrame([*one, ("nowhere", *one[0][1:])], schema), models)
    assert mixed.where("station_id = 'NATION_3'").first()["prediction"] == alone


def test_importance_is_ascending_top_15(models):
    got = [r["importance"] for r in revenue.feature_importance(models).collect()]
    assert len(got) == 15 and got == sorted(got) and got[-1] > 0.1


def test_models_survive_saving(spark, models, tmp_path):
    artifacts.save_revenue(models, f"{tmp_path}/r")
    loaded = artifacts.load_revenue(spark, f"{tmp_path}/r")
    assert loaded.best == models.best
    requests = revenue.requests_from(marts.training_set(order_star(spark, SF))).limit(200)
    a, b = [
        sorted((r["station_id"], r["hour"], r["duration"], r["prediction"]) for r in revenue.score(requests.orderBy(*requests.columns), m).collect())
        for m in (models, loaded)
    ]
    assert a == b


def test_anomaly_model_survives_saving(spark, tmp_path):
    profile = marts.station_hour_profile(order_star(spark, SF))
    model = anomalies.fit(profile, trees=10)
    artifacts.save_anomalies(model, f"{tmp_path}/a")
    loaded = artifacts.load_anomalies(spark, f"{tmp_path}/a")
    a, b = [sorted(map(tuple, anomalies.score(profile, m).collect())) for m in (model, loaded)]
    assert a == b and loaded.flagged.count() == model.flagged.count()


def test_saving_what_was_loaded_keeps_it(spark, models, tmp_path):
    model = anomalies.fit(marts.station_hour_profile(order_star(spark, SF)), trees=5)
    assert artifacts.load(spark, f"{tmp_path}/m") == artifacts.Saved(None, None)
    artifacts.save(f"{tmp_path}/m", revenue=models)
    alone = artifacts.load(spark, f"{tmp_path}/m")
    assert alone.anomalies is None and alone.revenue.best == models.best
    artifacts.save(f"{tmp_path}/m", alone.revenue, model)
    again = artifacts.load(spark, f"{tmp_path}/m")
    artifacts.save(f"{tmp_path}/m", again.revenue, again.anomalies)
    last = artifacts.load(spark, f"{tmp_path}/m")
    assert rows(last.revenue.codes, "*") == rows(models.codes, "*") and last.anomalies.flagged.count() == model.flagged.count()


def test_a_save_that_breaks_off_leaves_the_last_one(spark, models, tmp_path, monkeypatch):
    artifacts.save(f"{tmp_path}/m", revenue=models)

    def broken(*_):
        raise OSError("disk full")

    monkeypatch.setattr(artifacts, "_publish", broken)
    with pytest.raises(OSError):
        artifacts.save(f"{tmp_path}/m", revenue=models)
    assert artifacts.load(spark, f"{tmp_path}/m").revenue.best == models.best


def test_fits_do_not_depend_on_the_layout(spark, tmp_path):
    rides = marts.training_set(order_star(spark, SF))
    found = []
    for parts in (3, 8, 17):
        rides.repartition(parts).write.parquet(f"{tmp_path}/{parts}")
        fitted = revenue.train(spark.read.parquet(f"{tmp_path}/{parts}"), trees=4, rounds=3)
        found.append(sorted((r["model"], round(r["rmse"], 9), round(r["r2"], 9)) for r in fitted.metrics.collect()))
    assert found[0] == found[1] == found[2]


def test_train_on_a_sample(spark):
    small = revenue.train(marts.training_set(order_star(spark, SF)), max_rows=400, trees=3, rounds=3)
    assert small.metrics.count() == 2


# Scenarios


def test_grid_size_and_held_values(spark):
    bases = spark.createDataFrame([("a", 7, 1), ("b", 7, 1)], "station_id string, month int, bike_type int")
    assert scenarios.grid(bases).count() == 2 * 24 * 7 * 7
    many = spark.range(2000).selectExpr("concat('s', id) as station_id", "7 as month", "1 as bike_type").coalesce(1)
    tasks = scenarios.grid(many).groupBy(F.spark_partition_id()).count().count()
    assert tasks == int(spark.conf.get("spark.sql.shuffle.partitions"))
    top = scenarios.grid_top(revenue.tariff_score(scenarios.grid(many)))
    assert top._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    held = scenarios.grid(bases, False, False, False).select("hour", "temperature", "duration", "humidity", "is_weekend").distinct().collect()
    assert [tuple(r) for r in held] == [(17, 20.0, 35.0, 60.0, False)]


def test_grid_top_and_stats(spark):
    bases = spark.createDataFrame([("a", 7, 1)], "station_id string, month int, bike_type int")
    scored = revenue.tariff_score(scenarios.grid(bases))
    top = scenarios.grid_top(scored).orderBy("place").collect()
    assert [(r["hour"], r["temperature"], r["duration"]) for r in top[:2]] == [(0, 5.0, 80.0), (0, 10.0, 80.0)] and len(top) == 10
    row = scenarios.grid_stats(scored).first()
    assert row["max_prediction"] == pytest.approx(19.5) and row["total_scenarios"] == 1176
    assert row["profitable_scenarios"] == 24 * 7 * 5


def test_lost_trips_follow_the_estimates(star):
    events = marts.shortage_events(star)
    trips = scenarios.lost_trips(events).collect()
    assert sorted((r["station_id"], r["trip_no"]) for r in trips) == [("a", i) for i in range(1, 7)] + [("z", 1)]
    assert all(10 <= r["duration"] <= 120 and r["bike_type"] in (1, 2) for r in trips)
    assert scenarios.lost_trips(events, max_trips=2).count() == 3
    assert scenarios.lost_trips(events, max_events=1).select("station_id").distinct().count() <= 1


def test_lost_trips_do_not_depend_on_partitioning(spark):
    events = marts.shortage_events(order_star(spark, SF))
    a, b = [sorted(map(tuple, scenarios.lost_trips(e).collect())) for e in (events.repartition(3), events.repartition(11))]
    assert a == b and len(a) == 4124
    durations = [r[-1] for r in a]
    assert abs(sum(durations) / len(durations) - 51) < 5


def test_loss_totals_and_scaling(spark, star):
    events = marts.shortage_events(star)
    scored = scenarios.lost_trips(events).withColumn("prediction", F.lit(2.0))
    row = scenarios.counterfactual_loss(events, scored).first()
    assert (row["total_loss"], row["lost_trips"], row["loss_per_trip"]) == (14.0, 7.0, 2.0)
    assert (row["affected_stations"], row["events_analyzed"], row["sample_size"], row["scaling_factor"]) == (3, 3, 3, 1.0)
    double = lambda requests: requests.withColumn("prediction", F.lit(2.0))
    some = scenarios.counterfactual(events, double, max_trips=1).first()
    assert (some["simulated_trips"], some["scaling_factor"], some["total_loss"], some["sample_size"]) == (2, 1.0, 4.0, 3)
    one = scenarios.counterfactual(events, double, max_events=1).first()
    assert (one["scaling_factor"], one["sample_size"], one["lost_trips"]) == (3.0, 1, 3.0 * one["simulated_trips"])


def test_no_shortage_no_loss(spark):
    calm = make_star(spark, balance=[("a", 1, -1.0, "EXCESO", True)])
    events = marts.shortage_events(calm)
    row = scenarios.counterfactual_loss(events, revenue.tariff_score(scenarios.lost_trips(events))).first()
    assert (row["total_loss"], row["lost_trips"], row["loss_per_trip"], row["events_analyzed"]) == (0.0, 0.0, 0.0, 0)


def test_loss_is_shared_by_lost_trips(spark, star):
    loss = spark.createDataFrame([(70.0,)], "total_loss double")
    got = [(r["station_id"], r["ingresos_perdidos"]) for r in scenarios.loss_by_station(marts.shortage_events(star), loss).collect()]
    assert got == [("a", pytest.approx(60.0)), ("z", pytest.approx(10.0)), ("c", 0.0)]
    assert not math.isnan(got[0][1])


def test_shortage_top_breaks_ties_by_key(star):
    got = [r["station_id"] for r in scenarios.shortage_top(marts.shortage_events(star), 2).collect()]
    assert got == ["a", "z"]
