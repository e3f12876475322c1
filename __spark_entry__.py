"""

Every query runs over the whole of the given tables, seen as the ride star (see
``ridestats.sources.order_star``). Doubles are rounded on both sides of the SQL
check, since engines add in different orders.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable
from dataclasses import replace

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession, Window, functions as F  # noqa: E402

import oracle  # noqa: E402
from ridestats.functions.pricing import theoretical_revenue  # noqa: E402
from ridestats.operators import ensembles  # noqa: E402
from ridestats.operators.regression import regression_metrics as metrics_of  # noqa: E402
from ridestats.operators.sampling import seeded_sample, stratified_split  # noqa: E402
from ridestats.plans import (  # noqa: E402
    anomalies, artifacts, browse, cube, explore, marts, reports, revenue, scenarios,
)
from ridestats.sources import order_star, process_dir, register_star, stage, validate_dims  # noqa: E402

try:  # the text operators and their pipeline can be left out as a whole
    from ridestats.llm import queries as text_queries  # noqa: E402
except ModuleNotFoundError as missing:
    if missing.name not in ("ridestats.llm", "corpus_pipeline"):
        raise
    text_queries = None

Query = Callable[[SparkSession, str], DataFrame]

# Arguments that the registered queries and their SQL share.
FILTERS = explore.Filters(
    station_filter=r"nation_[12]\d$", member_type_filter="CAS|mem", min_revenue=1.0, max_revenue=25.0
)
FILTER_MONTH = 7
WALK, WALK_PAGE, WALK_FILE = ("start_station_id", "end_station_id", "hour"), 5_000, 50_000
GRID_MONTH, GRID_BIKE = 7, 1
SAMPLE_ROWS = 20_000


def entry(spark: SparkSession) -> DataFrame:
    """Revenue by hour of the smallest data set."""
    return queries()["revenue_by_hour"](spark, "/root/testdata/sf0.001")


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(
        *[
            (F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c)
            for c, t in df.dtypes
        ]
    )


# What several queries look at is prepared once per session and folder: the star,
# the saved mart of the reports, staged analysis tables, fitted models. The queries
# ``trip_mart``, ``training_set``, ``station_hour_profile`` and ``shortage_events``
# always compute their table.
_prepared: dict[tuple[str, str, str], object] = {}


def _once(kind: str, spark: SparkSession, folder: str, build: Callable[[], object]):
    key = (kind, spark.sparkContext.applicationId, folder)
    if key not in _prepared:
        _prepared[key] = build()
    return _prepared[key]


def _place(spark: SparkSession, folder: str, what: str) -> str:
    source = folder.strip("/").replace("/", "-")
    return f"{process_dir(spark)}/{what}-{spark.sparkContext.applicationId}-{source}"


def _star(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return _once("star", spark, folder, lambda: order_star(spark, folder))


def _mart(spark: SparkSession, folder: str) -> DataFrame:
    return _once(
        "mart", spark, folder,
        lambda: marts.saved_mart(_star(spark, folder), _place(spark, folder, "mart"), refresh=True),
    )


def _rides(spark: SparkSession, folder: str) -> DataFrame:
    return _once("rides", spark, folder, lambda: stage(marts.training_set(_star(spark, folder)), "rides"))


def _profile(spark: SparkSession, folder: str, member: str = marts.CASUAL) -> DataFrame:
    return _once(
        f"profile-{member}", spark, folder,
        lambda: stage(marts.station_hour_profile(_star(spark, folder), member=member), "profile"),
    )


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return _once("events", spark, folder, lambda: stage(marts.shortage_events(_star(spark, folder)), "events"))


def _revenue_models(spark: SparkSession, folder: str) -> revenue.RevenueModels:
    return _once("revenue", spark, folder, lambda: revenue.train(_rides(spark, folder), staged=True))


def _anomaly_model(spark: SparkSession, folder: str) -> anomalies.AnomalyModel:
    return _once("anomalies", spark, folder, lambda: anomalies.fit(_profile(spark, folder), staged=True))


def _flagged(spark: SparkSession, folder: str) -> DataFrame:
    return _anomaly_model(spark, folder).flagged


# Sources and marts -----------------------------------------------------------


def dimension_check(spark, folder):
    return validate_dims(_star(spark, folder))


def sql_over_star(spark, folder):
    """Free SQL over the star, as a user would type it."""
    register_star(_star(spark, folder), {"trips": "ride_trips", "dim_time": "ride_time", "weather": "ride_weather"})
    return _rounded(
        spark.sql(
            """
            select t.day_name, t.is_weekend, count(*) as trips, avg(w.temperature_2m) as avg_temperature,
                   sum(case when r.duracion_minutos > 60 then 1 else 0 end) as long_trips
            from ride_trips r join ride_time t on r.start_time_id = t.time_id
                 join ride_weather w on r.start_time_id = w.time_id
            group by t.day_name, t.is_weekend
            """
        )
    )


def trip_mart(spark, folder):
    return _rounded(marts.trip_mart(_star(spark, folder)))


def excess_revenue(spark, folder):
    return _rounded(marts.trip_revenue(_star(spark, folder)))


def training_set(spark, folder):
    return _rounded(marts.training_set(_star(spark, folder)))


def station_hour_profile(spark, folder):
    profile = marts.station_hour_profile(_star(spark, folder))
    return _rounded(profile.orderBy("station_id", "hour"), 8)


def station_stats(spark, folder):
    return _rounded(marts.station_stats(_star(spark, folder)))


def shortage_events(spark, folder):
    return _rounded(marts.shortage_events(_star(spark, folder)))


# Reports ---------------------------------------------------------------------


def kpis(spark, folder):
    return _rounded(reports.kpis(_mart(spark, folder)))


def _cube(spark, folder) -> DataFrame:
    return _once("cube", spark, folder, lambda: cube.kpi_cube(_mart(spark, folder)))


def kpis_by_month(spark, folder):
    """The headline figures of rush hours by month, united from the cells of the cube."""
    rush = F.col("hour").between(7, 9) | F.col("hour").between(16, 18)
    return _rounded(cube.kpis(_cube(spark, folder), rush, by=("month",)))


def dataset_stats(spark, folder):
    return reports.dataset_stats(_mart(spark, folder))


def _revenue_by(dimension: str) -> Query:
    return lambda spark, folder: _rounded(reports.revenue_by(_mart(spark, folder), dimension))


def station_balance(spark, folder):
    return reports.station_balance(_mart(spark, folder))


def station_balance_top(spark, folder):
    return reports.station_balance_top(station_balance(spark, folder))


def station_balance_extremes(spark, folder):
    return reports.station_balance_extremes(station_balance(spark, folder))


def weather_impact(spark, folder):
    return _rounded(reports.weather_impact(_mart(spark, folder)))


def weather_chart(spark, folder):
    return reports.weather_chart(reports.weather_impact(_mart(spark, folder)))


def user_distribution(spark, folder):
    return reports.user_distribution(_mart(spark, folder))


# Explorer --------------------------------------------------------------------


def explore_filtered(spark, folder):
    return _rounded(explore.filtered(_mart(spark, folder), FILTERS))


def explore_page(spark, folder):
    return explore.page(
        _mart(spark, folder), FILTERS, page=3, limit=25, sort_by="INGRESO_MIN_EXCEDENTE", sort_order="desc"
    )


def _copy(spark, folder) -> browse.SortedCopy:
    return _once(
        "copy", spark, folder,
        lambda: browse.sorted_copy(_mart(spark, folder), _place(spark, folder, "copy"), WALK, WALK_FILE, refresh=True),
    )


def explore_page_after(spark, folder):
    """The third page of 25 of a walk."""
    copy, at = _copy(spark, folder), 0
    for _ in range(2):
        at = browse.page_after(copy, at, FILTERS, 25).next
    return _rounded(browse.page_after(copy, at, FILTERS, 25).rows)


def explore_page_of_values(spark, folder):
    """The same page without a sorted copy: behind the values of the last row shown."""
    mart, after = _mart(spark, folder), None
    for _ in range(2):
        page = explore.page_after(mart, after, FILTERS, 25, WALK)
        after = explore.cursor_of(page, after, WALK)
    return _rounded(explore.page_after(mart, after, FILTERS, 25, WALK))


def explore_walk(spark, folder):
    """All pages of a walk together."""
    return _rounded(browse.walk(_copy(spark, folder), FILTERS, WALK_PAGE).drop("page", "position"))


def explore_walk_pages(spark, folder):
    """What each page of the walk holds."""
    pages = browse.walk(_copy(spark, folder), FILTERS, WALK_PAGE).groupBy("page").agg(
        F.count(F.lit(1)).alias("n"), F.min("position").alias("first_position"), F.min("start_station_id").alias("first_station"),
        F.max("start_station_id").alias("last_station"), F.sum("ingreso_min_excedente").alias("total_revenue"),
    )
    return _rounded(pages, 4)


def mart_refresh(spark, folder):
    """Months of a mart that is refreshed twice: their rows, and whether the second time wrote them again."""
    star, path = _star(spark, folder), _place(spark, folder, "refreshed")
    marts.refreshed_mart(star, path)
    mart, again = marts.refreshed_mart(star, path)
    return mart.groupBy("month").agg(F.count(F.lit(1)).alias("n")).withColumn("written_again", F.col("month").isin(again))


def explore_month(spark, folder):
    return _rounded(explore.filtered(_mart(spark, folder), replace(FILTERS, month_filter=FILTER_MONTH)))


def explore_summary(spark, folder):
    return explore.summary(_mart(spark, folder), FILTERS, 25)


def explore_member_distribution(spark, folder):
    return explore.member_distribution(_mart(spark, folder), FILTERS)


def column_profile(spark, folder):
    profile = explore.column_profile(_mart(spark, folder))
    return profile.withColumn("sample_values", F.concat_ws(",", "sample_values"))


# Revenue models --------------------------------------------------------------


def seeded_sample_rows(spark, folder):
    return _rounded(seeded_sample(_rides(spark, folder), SAMPLE_ROWS, revenue.trip_key()))


def train_test_split(spark, folder):
    split = stratified_split(_rides(spark, folder), F.col(revenue.TARGET) > 0, revenue.trip_key())
    return _rounded(
        split.select("station_id", "time_id", "bike_type_id", "duracion_minutos", revenue.TARGET, "is_test")
    )


def station_codes(spark, folder):
    return revenue.station_codes(_rides(spark, folder))


def feature_matrix(spark, folder):
    rides = _rides(spark, folder)
    codes = revenue.station_codes(rides)
    return _rounded(revenue.features(rides, codes, keep=("station_id", "time_id", revenue.TARGET)))


def theoretical(spark, folder):
    rides = _mart(spark, folder).select("start_station_id", "duracion_minutos", "ingreso_min_excedente")
    tariff = theoretical_revenue(F.col("duracion_minutos"))
    return _rounded(
        rides.withColumn("theoretical_revenue", tariff).withColumn(
            "model_difference", F.col("ingreso_min_excedente") - F.col("theoretical_revenue")
        )
    )


def regression_metrics(spark, folder):
    scored = _mart(spark, folder).withColumn("prediction", theoretical_revenue(F.col("duracion_minutos")))
    return _rounded(metrics_of(scored, "ingreso_min_excedente", "prediction", by=("member_casual",)))


def prediction_histogram(spark, folder):
    scored = _mart(spark, folder).select(theoretical_revenue(F.col("duracion_minutos")).alias("prediction"))
    return _rounded(reports.value_histogram(scored, "prediction"))


# Tree ensembles differ from engine to engine: what SQL can state of them is shown as
# flags next to the rows, keys and tariff values that it can compute.


def revenue_model_metrics(spark, folder):
    models = _revenue_models(spark, folder)
    split = stratified_split(_rides(spark, folder), F.col(revenue.TARGET) > 0, revenue.trip_key())
    held_out = split.where("is_test")
    best = F.max("r2").over(Window.partitionBy())  # two rows
    return _rounded(
        models.metrics.select(
            "model",
            ((F.col("r2") >= 0.9) & (F.col("r2") <= 1)).alias("fits"),
            ((F.col("rmse") >= F.col("mae")) & (F.col("mae") >= 0)).alias("consistent"),
            ((F.col("model") != models.best) | (F.col("r2") == best)).alias("choice_agrees"),
            held_out.select(F.count(F.lit(1))).scalar().alias("held_out_rows"),
            held_out.select(F.avg(revenue.TARGET)).scalar().alias("label_mean"),
        )
    )


def model_metrics(spark, folder):
    """RMSE, MAE and R2 of both ensembles on the held-out rows, from predictions that walk their node tables."""
    scored = _walked(spark, folder).where("is_test")
    per_model = metrics_of(scored, revenue.TARGET, "prediction", by=("model",))
    models = _revenue_models(spark, folder)
    return _rounded(per_model.withColumn("chosen", F.col("model") == models.best))


def model_predictions(spark, folder):
    """By ensemble, month and hold-out flag what the node tables predict, next to what was earned."""
    return _rounded(_walked(spark, folder).groupBy("model", "month", "is_test").agg(
        F.count(F.lit(1)).alias("n"), F.avg("prediction").alias("avg_prediction"), F.min("prediction").alias("min_prediction"),
        F.max("prediction").alias("max_prediction"), F.avg(revenue.TARGET).alias("avg_revenue"),
    ))


def model_nodes(spark, folder):
    """Size and shape of both ensembles' trees."""
    parts = [
        nodes.groupBy("tree").agg(
            F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("feature") == ensembles.LEAF).alias("leaves"), F.first("weight").alias("weight"),
        ).withColumn("model", F.lit(name)) for name, (nodes, _) in _node_tables(spark, folder).items()
    ]
    return _rounded(parts[0].unionByName(parts[1]))


def _node_tables(spark, folder) -> dict[str, tuple[DataFrame, int]]:
    def build():
        models = _revenue_models(spark, folder)
        tables = {
            name: ensembles.node_table(spark, model, name)
            for name, model in ((revenue.FOREST, models.forest), (revenue.BOOSTING, models.boosting))
        }
        return {name: (nodes, ensembles.depth(nodes)) for name, nodes in tables.items()}

    return _once("nodes", spark, folder, build)


def _walked(spark, folder) -> DataFrame:
    """Predictions of both ensembles for all rides, computed from their node tables."""

    def build():
        rides = stratified_split(_rides(spark, folder), F.col(revenue.TARGET) > 0, revenue.trip_key())
        matrix = revenue.features(rides, _revenue_models(spark, folder).codes, keep=(revenue.TARGET, "is_test"))
        rows = revenue.assembled(matrix).select("month", "is_test", revenue.TARGET, "features")
        parts = [
            ensembles.predict(rows, nodes, levels, column="prediction").withColumn("model", F.lit(name)).drop("features")
            for name, (nodes, levels) in _node_tables(spark, folder).items()
        ]
        return stage(parts[0].unionByName(parts[1]), "walked")

    return _once("walked", spark, folder, build)


def feature_importance_top(spark, folder):
    """The 15 most important features of the chosen ensemble."""
    return _rounded(revenue.feature_importance(_revenue_models(spark, folder)))


def scores_by_station(spark, folder):
    """What the chosen ensemble predicts by station, next to the tariff."""
    scored = revenue.score(revenue.requests_from(_rides(spark, folder)), _revenue_models(spark, folder))
    return _rounded(scored.groupBy("station_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("prediction").alias("avg_prediction"), F.avg("theoretical_revenue").alias("avg_tariff"),
        F.avg("model_difference").alias("avg_difference"),
    ))


def scenario_model_values(spark, folder):
    """The ten best scenarios of each station with their predictions."""
    return _rounded(scenarios.grid_top(_model_grid(spark, folder)))


def counterfactual_model_values(spark, folder):
    """The loss that the chosen ensemble predicts for the lost trips."""
    return _rounded(_model_loss(spark, folder), 4)


def prediction_model_bars(spark, folder):
    """The histogram of the chosen ensemble's predictions."""
    scored = revenue.score(revenue.requests_from(_rides(spark, folder)), _revenue_models(spark, folder))
    return _rounded(reports.value_histogram(scored, "prediction"))


def feature_importance(spark, folder):
    models = _revenue_models(spark, folder)
    every = revenue.feature_importance(models, len(revenue.FEATURES))
    return every.agg(
        F.count(F.lit(1)).alias("features"),
        (F.abs(F.sum("importance") - 1) < 1e-6).alias("sums_to_one"),
        F.every(F.col("importance").between(0, 1)).alias("in_range"),
        F.max_by("feature", "importance").startswith("duracion").alias("duration_leads"),
    )


def score_requests(spark, folder):
    requests = revenue.requests_from(_rides(spark, folder))
    scored = revenue.score(requests, _revenue_models(spark, folder))
    gap = F.col("prediction") - F.col("theoretical_revenue")
    return _rounded(
        scored.select(
            *requests.columns, "theoretical_revenue",
            F.coalesce(F.col("prediction") >= 0, F.lit(False)).alias("floored"),
            F.coalesce(F.abs(gap - F.col("model_difference")) < 1e-9, F.lit(False)).alias("gap_agrees"),
        )
    )


def model_roundtrip(spark, folder):
    """Each row scored by the fitted and by the saved and loaded models: equal or not."""
    where, models, judge = _place(spark, folder, "models"), _revenue_models(spark, folder), _anomaly_model(spark, folder)
    artifacts.save(where, models, judge)
    loaded = artifacts.load(spark, where)
    artifacts.save(where, loaded.revenue, loaded.anomalies)  # back to where it came from
    loaded = artifacts.load(spark, where)
    fresh = revenue.score(revenue.requests_from(_rides(spark, folder)), models).withColumnRenamed("prediction", "fresh")
    rides = revenue.score(fresh, loaded.revenue).withColumnRenamed("prediction", "score")
    judged = anomalies.score(_profile(spark, folder), judge).withColumnRenamed("anomaly_score", "fresh")
    hours = anomalies.score(judged, loaded.anomalies).withColumnRenamed("anomaly_score", "score")

    def compared(kind, rows):
        same = (F.abs(F.col("fresh") - F.col("score")) < 1e-12).alias("same")
        return rows.select(F.lit(kind).alias("kind"), "station_id", F.col("hour").cast("int").alias("hour"), same)

    return compared("revenue", rides).unionByName(compared("anomaly", hours))


def prediction_model_histogram(spark, folder):
    scored = revenue.score(revenue.requests_from(_rides(spark, folder)), _revenue_models(spark, folder))
    bars = reports.value_histogram(scored, "prediction")
    return bars.agg(
        F.sum("frequency").alias("rows"),
        ((F.min("bin") == 0) & (F.max("bin") == 49)).alias("spans_all_bins"),
        (F.abs(F.first("mean_value") - scored.select(F.avg("prediction")).scalar()) < 1e-6).alias("mean_agrees"),
    )


# Anomalies -------------------------------------------------------------------


def anomaly_features(spark, folder):
    return _rounded(anomalies.clean_features(_profile(spark, folder)), 8)


def anomaly_scaled(spark, folder):
    scaler, cleaned = anomalies.fit_scaler(_profile(spark, folder))
    return _rounded(anomalies.scale(cleaned, scaler).select("station_id", *anomalies.KEY[1:], *anomalies.SCALED))


def iforest_scores(spark, folder):
    return _rounded(_flagged(spark, folder).select("row_key", "score_iso", "anomalia_iso"), _SCORE_DIGITS)


def lof_scores(spark, folder):
    return _rounded(_flagged(spark, folder).select("row_key", "lof", "anomalia_lof"), 9)


def anomaly_consensus(spark, folder):
    return _judged(anomalies.consensus(_flagged(spark, folder)))


def anomaly_stats(spark, folder):
    return _rounded(anomalies.stats(_flagged(spark, folder)))


def anomaly_top(spark, folder):
    return _judged(anomalies.top(_flagged(spark, folder)))


def anomalies_by_hour(spark, folder):
    return anomalies.by_hour(_flagged(spark, folder))


def anomaly_scatter(spark, folder):
    return _rounded(anomalies.scatter(_flagged(spark, folder)))


def score_station_hours(spark, folder):
    scored = anomalies.score(_profile(spark, folder, "member"), _anomaly_model(spark, folder))
    return _rounded(scored.select("station_id", "hour", "is_weekend", "month", "anomaly_score", "is_anomaly"), _SCORE_DIGITS)


def kpis_with_anomalies(spark, folder):
    loss = _loss(spark, folder).select("total_loss")
    return _rounded(
        anomalies.kpis_with_anomalies(reports.kpis(_mart(spark, folder)), _flagged(spark, folder), loss), 4
    )


# Forest scores have 9 digits and their cut a few more: 12 leave nothing to round.
_SCORE_DIGITS = 12


def _judged(rows: DataFrame) -> DataFrame:
    return rows.select(
        "station_id", "hour", "is_weekend", "month", "viajes_count",
        F.round("ingreso_promedio", 8).alias("ingreso_promedio"),
        F.round("score_iso", _SCORE_DIGITS).alias("score_iso"), "anomalia_iso", "anomalia_lof",
    )


# Scenarios -------------------------------------------------------------------


def _grid(spark, folder) -> DataFrame:
    stations = _mart(spark, folder).select(F.col("start_station_id").alias("station_id")).distinct()
    return scenarios.grid(
        stations.withColumn("month", F.lit(GRID_MONTH)).withColumn("bike_type", F.lit(GRID_BIKE))
    )


def scenario_grid(spark, folder):
    return _rounded(revenue.tariff_score(_grid(spark, folder)))


def scenario_top(spark, folder):
    return _rounded(scenarios.grid_top(revenue.tariff_score(_grid(spark, folder))))


def scenario_stats(spark, folder):
    return _rounded(scenarios.grid_stats(revenue.tariff_score(_grid(spark, folder))))


def _model_grid(spark, folder) -> DataFrame:
    return revenue.score(_grid(spark, folder), _revenue_models(spark, folder))


def scenario_model_top(spark, folder):
    top = scenarios.grid_top(_model_grid(spark, folder))
    before = F.lag("prediction").over(Window.partitionBy(*scenarios.BASE).orderBy("place"))
    return top.select(
        *scenarios.BASE, "place", F.coalesce(before >= F.col("prediction"), F.lit(True)).alias("descends"),
        (F.col("prediction") >= 0).alias("floored"),
    )


def scenario_model_stats(spark, folder):
    stats = scenarios.grid_stats(_model_grid(spark, folder))
    return stats.select(
        *scenarios.BASE, "total_scenarios",
        (F.col("max_prediction") >= F.col("avg_prediction")).alias("consistent"),
        F.col("profitable_scenarios").between(1, F.col("total_scenarios")).alias("some_profit"),
    )


def shortage_top(spark, folder):
    return _rounded(scenarios.shortage_top(_events(spark, folder)))


def counterfactual_trips(spark, folder):
    return _rounded(revenue.tariff_score(scenarios.lost_trips(_events(spark, folder))), 9)


def _loss(spark, folder) -> DataFrame:
    events = _events(spark, folder)
    return scenarios.counterfactual_loss(events, revenue.tariff_score(scenarios.lost_trips(events)))


def counterfactual_loss(spark, folder):
    return _rounded(_loss(spark, folder), 4)


def _model_loss(spark, folder) -> DataFrame:
    models = _revenue_models(spark, folder)
    return scenarios.counterfactual(_events(spark, folder), lambda requests: revenue.score(requests, models))


def counterfactual_model_loss(spark, folder):
    loss = _model_loss(spark, folder)
    gap = F.abs(F.col("loss_per_trip") * F.col("lost_trips") - F.col("total_loss"))
    return loss.select(
        "lost_trips", "affected_stations", "events_analyzed", "sample_size", "scaling_factor", "simulated_trips",
        ((F.col("total_loss") > 0) & (gap <= 1e-9 * F.col("total_loss"))).alias("adds_up"),
    )


def loss_by_station_model(spark, folder):
    """The model's loss by station, as shares of the whole."""
    total = _model_loss(spark, folder).select("total_loss")
    by_station = scenarios.loss_by_station(_events(spark, folder), total)
    return _rounded(
        by_station.select("station_id", "viajes_perdidos", (F.col("ingresos_perdidos") / total.scalar()).alias("share"))
    )


def kpis_with_model_loss(spark, folder):
    loss = _model_loss(spark, folder).select("total_loss")
    row = anomalies.kpis_with_anomalies(reports.kpis(_mart(spark, folder)), _flagged(spark, folder), loss)
    return _rounded(row.withColumn("perdidas_estimadas", F.col("perdidas_estimadas") > 0), 4)


def loss_by_station(spark, folder):
    return _rounded(
        scenarios.loss_by_station(_events(spark, folder), _loss(spark, folder).select("total_loss")), 4
    )


def queries() -> dict[str, Query]:
    return {
        "dimension_check": dimension_check,
        "sql_over_star": sql_over_star,
        "trip_mart": trip_mart,
        "excess_revenue": excess_revenue,
        "training_set": training_set,
        "station_hour_profile": station_hour_profile,
        "station_stats": station_stats,
        "shortage_events": shortage_events,
        "kpis": kpis,
        "kpis_by_month": kpis_by_month,
        "dataset_stats": dataset_stats,
        "revenue_by_hour": _revenue_by("hour"),
        "revenue_by_member": _revenue_by("member_casual"),
        "revenue_by_month": _revenue_by("month"),
        "revenue_by_day": _revenue_by("day_name"),
        "station_balance": station_balance,
        "station_balance_top": station_balance_top,
        "station_balance_extremes": station_balance_extremes,
        "weather_impact": weather_impact,
        "weather_chart": weather_chart,
        "user_distribution": user_distribution,
        "explore_filtered": explore_filtered,
        "explore_page": explore_page,
        "explore_page_after": explore_page_after,
        "explore_page_of_values": explore_page_of_values,
        "explore_walk": explore_walk,
        "explore_walk_pages": explore_walk_pages,
        "mart_refresh": mart_refresh,
        "explore_month": explore_month,
        "explore_summary": explore_summary,
        "explore_member_distribution": explore_member_distribution,
        "column_profile": column_profile,
        "seeded_sample": seeded_sample_rows,
        "train_test_split": train_test_split,
        "station_codes": station_codes,
        "feature_matrix": feature_matrix,
        "theoretical_revenue": theoretical,
        "regression_metrics": regression_metrics,
        "prediction_histogram": prediction_histogram,
        "anomaly_features": anomaly_features,
        "anomaly_scaled": anomaly_scaled,
        "iforest_scores": iforest_scores,
        "lof_scores": lof_scores,
        "anomaly_consensus": anomaly_consensus,
        "anomaly_stats": anomaly_stats,
        "anomaly_top": anomaly_top,
        "anomalies_by_hour": anomalies_by_hour,
        "anomaly_scatter": anomaly_scatter,
        "score_station_hours": score_station_hours,
        "kpis_with_anomalies": kpis_with_anomalies,
        "scenario_grid": scenario_grid,
        "scenario_top": scenario_top,
        "scenario_stats": scenario_stats,
        "shortage_top": shortage_top,
        "counterfactual_trips": counterfactual_trips,
        "counterfactual_loss": counterfactual_loss,
        "loss_by_station": loss_by_station,
        "revenue_model_metrics": revenue_model_metrics,
        "model_metrics": model_metrics,
        "model_predictions": model_predictions,
        "model_nodes": model_nodes,
        "feature_importance": feature_importance,
        "feature_importance_top": feature_importance_top,
        "scores_by_station": scores_by_station,
        "scenario_model_values": scenario_model_values,
        "counterfactual_model_values": counterfactual_model_values,
        "prediction_model_bars": prediction_model_bars,
        "score_requests": score_requests,
        "model_roundtrip": model_roundtrip,
        "scenario_model_top": scenario_model_top,
        "scenario_model_stats": scenario_model_stats,
        "prediction_model_histogram": prediction_model_histogram,
        "counterfactual_model_loss": counterfactual_model_loss,
        "loss_by_station_model": loss_by_station_model,
        "kpis_with_model_loss": kpis_with_model_loss,
        **(text_queries.queries() if text_queries else {}),
    }


def oracle_sql() -> dict[str, str]:
    """SQL for every query that SQL can express."""
    return {**oracle.statements(), **(text_queries.oracle_sql() if text_queries else {})}
