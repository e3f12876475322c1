from __future__ import annotations

import duckdb

from ridestats.llm import licenses, queries

ROWS = {
    1: "Licensed under the Apache License, Version 2.0.",
    2: "text before. LICENSED   under-the APACHE license; version 2.0 and after, Apache License",
    3: "Licensed under the very same Apache License, Version 2.0",
    4: "licensed under the apache version", 5: None, 6: "", 7: " .,- ",
    8: "Licensed under CC BY-NC 4.0.", 9: "mIT LiCENSE", 10: "mit licens\u00e9 mit  license", 11: "wor\u212a All rights reserved!",
    12: "This program is free software: you can modify it and redistribute it under the terms of the GNU General Public License as published by the"
        " Free Software Foundation",
    13: "gnu general public license " * 4000,
}


def test_places_labels_and_spans(spark):
    rows = [(i, t, 1) for i, t in ROWS.items()] + [(None, "cc by", 1), (1, ROWS[1], 1)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, label int")).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert (by[1].n_words, by[1].n_base, by[1].first_word, by[1].last_word, by[1].base_labels, by[1].labels, by[1].score) == (8, 1, 3, 3, "apache", "apache", 1.0)
    assert [(s.first_word, s.end_word, s.label, s.score) for s in by[1].spans] == [(0, 8, "apache", 1.0)]
    assert (by[2].n_base, by[2].first_word, by[2].last_word) == (2, 5, 12) and by[2].spans[0].first_word == 2
    assert by[3].base_labels == "apache" and [s.label for s in by[3].spans] == ["apache"] and by[3].spans[0].end_word == 10
    assert (by[4].labels, by[4].score, by[4].first_word) == ("", 0.0, None)
    for i in (5, 6, 7):
        assert (by[i].n_words, by[i].n_base, by[i].labels, by[i].score, by[i].spans) == (0, 0, "", 0.0, [])
    assert (by[8].base_labels, by[8].labels) == ("cc-by", "cc-by,cc-by-nc")
    assert by[9].base_labels == "mit" and (by[10].n_base, by[10].first_word) == (1, 2)
    assert (by[11].n_words, by[11].labels) == (4, "all-rights-reserved")
    assert by[12].labels == "gpl"
    assert (by[13].n_words, by[13].n_base, by[13].last_word) == (16000, 4000, 15996)
    assert by[None].labels == "cc-by"
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_no_python_on_the_main_path(spark):
    plan = licenses.scan(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))


def test_names_decide_against_more_general_licenses(spark, tmp_path):
    gpl = "{} is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation."
    texts = {
        gpl.format("This library", "Lesser "): "lgpl", gpl.format("This program", "Lesser "): "lgpl", gpl.format("This library", "Library "): "lgpl",
        gpl.format("This program", "Affero "): "agpl", gpl.format("This program", ""): "gpl",
        "It is licensed under the GNU General Public License": "gpl", "Licensed under the GNU General Public License, Version 2.0": "gpl",
        "licensed under the GNU Lesser General Public License": "lgpl",
        gpl.format("This program", "") + " Parts are under the GNU Lesser General Public License.": "gpl,lgpl",
        "Licensed under the Mozilla Public License, Version 2.0": "mpl", "Licensed under the BSD 3-Clause License": "bsd",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": "cc-by-sa",
        "Creative Commons Attribution-ShareAlike 4.0 International": "cc-by-sa", "Creative Commons Attribution 4.0": "cc-by",
        "Creative Commons Attribution-NonCommercial-ShareAlike 4.0": "cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0": "cc-by,cc-by-nc-sa",
        "the general public likes a license, the lesser evil": "", "released under the MIT flag by its authors": "",
        "Released under the MIT License by its authors": "mit", "Licensed under the Acme License, Version 2.0": "",
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {list(texts)[r.doc_id]: r.labels for r in licenses.scan(docs).collect()} == texts
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    want = con.sql(queries.oracle_sql()["op7_license_scan"]).select(*names).fetchall()
    assert sorted(map(tuple, queries.op7_license_scan(spark, str(tmp_path)).select(*names).collect())) == sorted(want)
