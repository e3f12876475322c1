from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from ridestats.sources import discard_staged, load_star, scratch_dir, stage, star as star_module, unstage
from ridestats.sources.star import DIM_KEYS, STAR


def test_facts_are_read_in_parts_and_dimensions_whole(spark, monkeypatch):
    read = {}

    class Reader:
        def __init__(self):
            self.found = {}

        def format(self, fmt):
            assert fmt == "jdbc"
            return self

        def options(self, **options):
            self.found = options
            return self

        def load(self):
            table = self.found["dbtable"]
            read[table] = self.found
            return spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in STAR[table].items()))

    class Session:
        read = property(lambda self: Reader())

    monkeypatch.setattr(star_module, "stage", lambda df, label: df)
    parts = {"partitionColumn": "start_time_id", "lowerBound": "0", "upperBound": "9", "numPartitions": "4"}
    load_star(Session(), fmt="jdbc", options={"url": "jdbc:x"}, table_options={"trips": parts})
    assert read["trips"] == {"url": "jdbc:x", "dbtable": "trips", **parts}
    assert all(read[d] == {"url": "jdbc:x", "dbtable": d} for d in DIM_KEYS)


@pytest.mark.parametrize("hot", [0, 500, 5000])
def test_key_ranges_cut_skewed_keys_evenly(spark, hot):
    keys = [(k * k, 1 + k % 5) for k in range(1, 400)] + [(100, hot)] * (hot > 0) + [(None, 7)]
    counts = {}
    for k, n in keys:
        counts[k] = counts.get(k, 0) + n
    df = spark.createDataFrame(list(counts.items()), "k long, n long")
    conditions = star_module.key_ranges(df, "k", 10)
    met = df.select("k", "n", F.array(*[F.coalesce(F.expr(c), F.lit(False)).cast("int") for c in conditions]).alias("m")).collect()
    assert all(sum(r["m"]) == 1 for r in met)  # every key, NULL too, in one part
    sizes = [sum(r["n"] for r in met if r["m"][i]) for i in range(len(conditions))]
    share = sum(counts.values()) / 10
    for i, size in enumerate(sizes):
        alone = [r for r in met if r["m"][i]]
        assert size <= 1.1 * share + 12 or len(alone) == 1
    assert 4 <= len(conditions) <= 26


def test_key_ranges_of_few_or_no_keys(spark):
    def of(rows, parts=4):
        return star_module.key_ranges(spark.createDataFrame(rows, "k long, n long"), "k", parts)

    assert of([]) == of([(None, 3)]) == of([(5, 1)], 1) == ["k is not null or k is null"]
    assert of([(1, 1), (2, 1)], 2) == ["k < 2", "k >= 2 or k is null"]
    with pytest.raises(ValueError):
        of([], 0)


def test_a_table_over_jdbc_is_read_by_ranges_of_its_key(spark, monkeypatch):
    asked = {}

    class Reader:
        def format(self, fmt):
            return self

        def options(self, **options):
            self.found = options
            return self

        def load(self):
            table = self.found["dbtable"]
            if table.startswith("(select"):
                asked["keys"] = table
                return spark.createDataFrame([(i, 2) for i in range(100)], "k long, n long")
            return spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in STAR[table].items()))

        def jdbc(self, url, table, predicates, properties):
            asked[table] = (url, predicates, properties)
            return spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in STAR[table].items()))

    class Session:
        read = property(lambda self: Reader())

    monkeypatch.setattr(star_module, "stage", lambda df, label: df)
    load_star(Session(), fmt="jdbc", options={"url": "jdbc:x", "driver": "d"}, parts={"trips": ("start_time_id", 5)})
    url, predicates, properties = asked["trips"]
    assert (url, properties) == ("jdbc:x", {"driver": "d"}) and len(predicates) == 5 and "group by start_time_id" in asked["keys"]


def test_staged_tables_can_be_discarded(spark):
    staged = stage(spark.range(3), "three")
    assert staged.count() == 3
    folder = scratch_dir(spark).removeprefix("file:") + "/ridestats"
    before = sum(len(f) for _, _, f in os.walk(folder))
    assert before > 0
    discard_staged(spark)
    assert not any(f for _, _, f in os.walk(folder))


def test_one_staged_table_can_be_deleted_and_tables_come_in_folders(spark):
    gone, kept = stage(spark.range(3), "gone"), stage(spark.range(4).selectExpr("id", "id % 2 as part"), "kept", "part")
    path = kept.staged_at.removeprefix("file:")
    assert {d for d in os.listdir(path) if "=" in d} == {"part=0", "part=1"}
    assert sorted(map(tuple, kept.where("part = 1").collect())) == [(1, 1), (3, 1)]
    unstage(gone)
    assert not os.path.exists(gone.staged_at.removeprefix("file:")) and kept.count() == 4


def test_shuffles_of_a_staged_table_are_given_up(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    staged = stage(spark.range(1000).selectExpr("id % 7 as k").groupBy("k").count(), "sums")
    assert spark.conf.get(key) == before and staged.count() == 7
    with pytest.raises(Exception):
        stage(spark.range(3).selectExpr("raise_error('no')"), "fails")
    assert spark.conf.get(key) == before


@pytest.mark.parametrize("master,works", [("local", True), ("local[8]", True), ("local-cluster[2,1,1024]", False), ("yarn", False)])
def test_only_a_session_in_one_process_goes_without_a_shared_folder(master, works):
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": master, "spark.sql.warehouse.dir": "file:/w"}.get(key, default)

    class Session:
        conf = Conf()

    if works:
        assert scratch_dir(Session()) == "file:/w/ridestats-scratch"
    else:
        with pytest.raises(RuntimeError):
            scratch_dir(Session())
