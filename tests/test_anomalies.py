import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridestats.operators import iforest, neighbors
from ridestats.operators.iforest import average_path, fit_forest, forest_score
from ridestats.operators.lof import local_outlier_factor, neighbor_count
from ridestats.operators.neighbors import nearest_neighbors
from ridestats.plans import anomalies

FEATURES = ["f0", "f1", "f2"]


def points(n, seed=3, copies=0):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(size=(n // 2, 3)), rng.normal(8, 0.1, size=(n - n // 2, 3))]).round(6)
    x = np.concatenate([x, np.repeat(x[:1], copies, axis=0)])
    return [f"p{i:05d}" for i in range(len(x))], x


def frame(spark, names, x):
    data = [(k, *map(float, row)) for k, row in zip(names, x)]
    return spark.createDataFrame(data, "key string, " + ", ".join(f"{f} double" for f in FEATURES))


def distances(a, b):
    total = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        total += (a[:, j][:, None] - b[:, j][None, :]) ** 2
    return np.sqrt(total)


def brute_neighbors(names, weights, x, k):
    d, out = distances(x, x), {}
    for i, name in enumerate(names):
        ranked = sorted((d[i, j], names[j], weights[j] - (i == j)) for j in range(len(names)) if weights[j] - (i == j) > 0)
        left, chosen = k, []
        for dist, other, w in ranked:
            if left <= 0:
                break
            chosen.append((other, dist, min(w, left)))
            left -= w
        out[name] = chosen
    return out


@pytest.mark.parametrize("region_points,leaf_points,fanout", [(4096, 32, 16), (40, 8, 16), (25, 4, 2), (7, 100, 3)])
def test_neighbors_match_brute_force(spark, monkeypatch, region_points, leaf_points, fanout):
    monkeypatch.setattr(neighbors, "PIVOTS", 1 if fanout == 2 else 20)
    names, x = points(300)
    x[100:140, 0], x[100:140, 1:] = 0.5, np.arange(40)[:, None]  # equal in one dimension, and ties between distances
    weights = [1 + (i % 5 == 0) * 2 for i in range(len(names))]
    df = spark.createDataFrame(
        [(n, w, list(map(float, row))) for n, w, row in zip(names, weights, x)], "pid string, w bigint, x array<double>"
    )
    got: dict[str, list] = {}
    for r in nearest_neighbors(df, 6, region_points, leaf_points, fanout).collect():
        got.setdefault(r["pid"], []).append((r["nbr"], r["dist"], r["w"]))
    want = brute_neighbors(names, weights, x, 6)
    assert {p: sorted(v) for p, v in got.items()} == {p: sorted(v) for p, v in want.items()}


def test_trees_of_uneven_points_end(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "LEVELS", 3)
    monkeypatch.setattr(neighbors, "PIVOTS", 1)
    x = np.concatenate([2.0 ** -np.arange(60.0), np.linspace(0, 1e-9, 40), [5.0] * 3])
    df = spark.createDataFrame([(f"p{i:03d}", 3 if v == 5.0 else 1, [float(v), 1.0]) for i, v in enumerate(dict.fromkeys(x))], "pid string, w bigint, x array<double>")
    values = [(r["pid"], r["w"], r["x"]) for r in df.collect()]
    want = brute_neighbors([v[0] for v in values], [v[1] for v in values], np.array([v[2] for v in values]), 3)
    got: dict[str, list] = {}
    for r in nearest_neighbors(df, 3, 5, 2, 4).collect():
        got.setdefault(r["pid"], []).append((r["nbr"], r["dist"], r["w"]))
    assert {p: sorted(v) for p, v in got.items()} == {p: sorted(v) for p, v in want.items()}


def test_leaves_that_cannot_matter_are_not_compared(monkeypatch):
    rng, seen, among = np.random.default_rng(1), [], neighbors._among
    x = rng.normal(size=(4096, 3))
    pivots = x[:150]
    cells = neighbors._squares(x, pivots)[0].argmin(axis=1)
    order, ends = neighbors.leaves_of(x, cells, 20)
    starts = np.concatenate([[0], ends[:-1]])
    assert (np.diff(ends, prepend=0) <= 20).all() and ends[-1] == 4096 and sorted(order) == list(range(4096))
    x, home, names, w = x[order], pivots[cells[order]], np.arange(4096), np.ones(4096, int)
    leaves = ends, x[starts] + 0.01, home[starts]
    want = np.sort(distances(x, x), axis=1)[:, 1:6]
    row, col, dist = neighbors.nearest_of(x, home, np.full(4096, np.inf), names, x, names, w, *leaves, 5)
    assert len(row) == 5 * 4096 and np.array_equal(dist.reshape(-1, 5), want)
    monkeypatch.setattr(neighbors, "_among", lambda *a: seen.append(len(a[1]) * (a[4].stop - a[4].start)) or among(*a))
    again = neighbors.nearest_of(x, home, 1.2 * want[:, -1], names, x, names, w, *leaves, 5)
    assert all(np.array_equal(a, b) for a, b in zip(again, (row, col, dist)))
    assert sum(seen) < 0.1 * 4096**2


def brute_lof(x, k):
    """Row by row, over all rows; assumes no ties that matter."""
    d = distances(x, x)
    np.fill_diagonal(d, np.inf)
    order = np.argsort(d, axis=1, kind="stable")[:, :k]
    near = np.take_along_axis(d, order, axis=1)
    kd = near[:, -1]
    lrd = 1 / (np.maximum(kd[order], near).mean(axis=1) + 1e-10)
    return lrd[order].mean(axis=1) / lrd


@pytest.mark.parametrize("copies", [0, 150])
def test_lof_matches_brute_force_with_copies(spark, copies):
    names, x = points(300, copies=copies)
    got = local_outlier_factor(frame(spark, names, x), "key", FEATURES, region_points=50, leaf_points=8)
    lof = {r["key"]: r["lof"] for r in got.collect()}
    want = brute_lof(x, neighbor_count(len(x)))
    assert len(lof) == len(names)
    for i, n in enumerate(names):
        assert lof[n] == pytest.approx(want[i], rel=1e-6, abs=1e-6)
    flags = {r["key"]: r["anomalia_lof"] for r in got.collect()}
    cut = np.quantile(-np.round(want, 9), 0.1)
    assert abs(sum(v == -1 for v in flags.values()) - (-want < cut).sum()) <= 1


@pytest.mark.parametrize("n", [0, 1, 2, 9])
def test_tiny_sets_do_not_fail(spark, n):
    assert neighbor_count(n) == 1
    names, x = points(10)
    got = local_outlier_factor(frame(spark, names[:n], x[:n]), "key", FEATURES)
    assert got.count() == n
    if n == 1:
        assert got.first()["anomalia_lof"] == 1


def test_equal_rows_are_no_outliers(spark):
    got = local_outlier_factor(frame(spark, [f"k{i}" for i in range(40)], np.ones((40, 3))), "key", FEATURES)
    assert {(r["lof"], r["anomalia_lof"]) for r in got.collect()} == {(1.0, 1)}


def walk(nodes, x):
    """Path length of one row in one tree, node by node."""
    at = 1
    while nodes[at]["feature"] >= 0:
        at = 2 * at + (x[nodes[at]["feature"]] > nodes[at]["threshold"])
    return nodes[at]["path"]


def test_forest_scores_are_walks_through_the_trees(spark):
    names, x = points(400)
    df = frame(spark, names, x)
    forest = fit_forest(df, "key", FEATURES, trees=12, max_samples=100)
    trees: dict[int, dict] = {}
    for r in forest.nodes.collect():
        trees.setdefault(r["tree"], {})[r["node"]] = r
    assert len(trees) == 12
    scored = {r["key"]: r["s"] for r in df.withColumn("s", forest_score(forest)).collect()}
    for i in range(0, len(names), 13):
        depth = np.mean([walk(t, x[i]) for t in trees.values()])
        assert scored[names[i]] == pytest.approx(-(2 ** (-depth / average_path(100))), abs=1e-9)
    # Every split separates rows, and leaves within the depth limit cover the sample.
    assert all(math.floor(math.log2(n)) <= iforest.depth_limit(100) for t in trees.values() for n in t)


def test_forest_does_not_depend_on_partitioning(spark):
    names, x = points(500)
    df = frame(spark, names, x)
    a, b = [
        sorted(map(tuple, fit_forest(d, "key", FEATURES, trees=5, max_samples=64).nodes.collect()))
        for d in (df.repartition(2), df.repartition(13))
    ]
    assert a == b
    assert a != sorted(map(tuple, fit_forest(df, "key", FEATURES, trees=5, max_samples=64, seed=1).nodes.collect()))


def test_average_path():
    assert (average_path(0), average_path(1), average_path(2)) == (0.0, 0.0, 1.0)
    assert average_path(256) == pytest.approx(10.2445, abs=1e-3)


PROFILE = (
    "station_id string, hour int, is_weekend boolean, month int, viajes_count bigint, ingreso_promedio double, "
    "ingreso_total double, duracion_promedio double, temperatura_promedio double, variabilidad_ingresos double, "
    "ingreso_maximo double, viajes_con_excedente bigint"
)


def profile(spark, n=400):
    rng = np.random.default_rng(0)
    data = [
        (f"s{i % 20}", int(i // 20 % 24), bool(i % 2), 1 + i % 12, int(rng.integers(5, 60)),
         float(rng.gamma(3, 2) + (40 if i % 100 == 0 else 0)), 1.0, float(rng.normal(35, 5)), float(rng.normal(12, 8)),
         float(rng.gamma(2, 1)), 9.0, int(rng.integers(0, 5)))
        for i in range(n)
    ]
    return spark.createDataFrame(data, PROFILE)


def test_missing_and_infinite_features_get_the_median(spark):
    base = ("s", 1, True, 1, 10, 1.0, 1.0, 30.0, 5.0, 1.0, 1.0, 1)

    def row(**changes):
        names = [c.split()[0] for c in PROFILE.split(", ")]
        return tuple({**dict(zip(names, base)), **changes}[n] for n in names)

    df = spark.createDataFrame(
        [row(ingreso_promedio=1.0), row(ingreso_promedio=2.0), row(ingreso_promedio=float("inf")),
         row(ingreso_promedio=float("nan")), row(ingreso_promedio=None), row(is_weekend=None)], PROFILE
    )
    got = [r["ingreso_promedio"] for r in anomalies.clean_features(df).collect()]
    assert sorted(got) == [1.0, 1.0, 1.0, 1.0, 2.0] and len(got) == 5


def test_scaler_uses_population_spread_and_constant_features_become_zero(spark):
    scaler, cleaned = anomalies.fit_scaler(profile(spark).withColumn("month", F.lit(6)))
    scaled = anomalies.scale(cleaned, scaler)
    row = scaled.agg(
        F.avg("z_hour"), F.stddev_pop("z_hour"), F.min("z_month"), F.max("z_month")
    ).first()
    assert row[0] == pytest.approx(0, abs=1e-8) and row[1] == pytest.approx(1, abs=1e-8)
    assert row[2:] == (0.0, 0.0)


@pytest.fixture(scope="module")
def fitted(spark):
    return anomalies.fit(profile(spark))


def test_fit_flags_a_tenth_and_consensus_is_in_both(fitted):
    row = anomalies.stats(fitted.flagged).first()
    assert row["total_records"] == 400
    assert row["num_anomalias_iso"] == pytest.approx(40, abs=2)
    assert row["num_anomalias_lof"] == pytest.approx(40, abs=2)
    both = anomalies.consensus(fitted.flagged)
    assert both.count() == row["num_anomalies"] <= min(row["num_anomalias_iso"], row["num_anomalias_lof"])
    assert row["anomaly_rate"] == pytest.approx(row["num_anomalies"] / 4)


def test_reports_of_the_flagged_rows(fitted):
    flagged = fitted.flagged
    hours = [tuple(r) for r in anomalies.by_hour(flagged).orderBy("hour").collect()]
    assert [h for h, _ in hours] == list(range(24))
    assert sum(n for _, n in hours) == anomalies.consensus(flagged).count()
    top = [r["ingreso_promedio"] for r in anomalies.top(flagged, 5).collect()]
    assert top == sorted(top, reverse=True)
    kinds = {r["type"]: r["count"] for r in anomalies.scatter(flagged, 50).groupBy("type").count().collect()}
    assert kinds["normal"] == 50 and kinds["anomaly"] == anomalies.consensus(flagged).count()


def test_no_consensus_still_has_24_hours(fitted):
    none = fitted.flagged.withColumn("anomalia_iso", F.lit(1))
    assert [r["anomalies"] for r in anomalies.by_hour(none).collect()] == [0] * 24


def test_scores_of_fit_rows_agree_with_their_flags(spark, fitted):
    scored = anomalies.score(profile(spark), fitted).select("station_id", "hour", "is_weekend", "month", "is_anomaly", "anomaly_score")
    joined = scored.join(fitted.flagged, ["station_id", "hour", "is_weekend", "month"])
    assert joined.where((F.col("is_anomaly") != (F.col("anomalia_iso") == -1)) | (F.col("anomaly_score") != F.col("score_iso"))).count() == 0


def test_repeated_station_hours_are_refused(spark):
    with pytest.raises(ValueError, match="one row"):
        anomalies.fit(profile(spark, 40).union(profile(spark, 40)))


def test_fit_on_a_sample(spark):
    model = anomalies.fit(profile(spark), max_rows=100, trees=5)
    assert model.flagged.count() == 100
