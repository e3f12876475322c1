"""License notices by diagonal voting.

Every run of ``k`` words of a text is hashed; runs that are also runs of a template are
joined to their positions there. A run at word p that stands at q in the template votes
for the diagonal p - q. Diagonals of one template that lie next to each other (a word more
or less here and there) are merged, and the span they cover is verified: the words must
be equal, not only the hashes, and cover enough of the template: all of a short one, where a
missing word may be the license's name. Where verified spans share words, the narrower
license stands: one more word, as in "Lesser", is within the gap. Two spans of one place and
label count once in the labels; spans that tie are both kept, ordered by place, end, label.

All of it is DataFrame code. Hashes that no template has are dropped where they arise, so
what is shuffled are the votes and one short row per document. Templates are a parameter
of bounded size. Votes of a document stay together; they are bounded by its text.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z in lower case. Null
and blank texts have none. Rows are judged one by one: null and repeated ids are kept.
Only the two named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

K = 3
# Phrases that always count, as words: label and the words that stand consecutively.
PHRASES = (
    ("gpl", ("gnu", "general", "public", "license")), ("apache", ("apache", "license")),
    ("cc-by", ("cc", "by")), ("mit", ("mit", "license")),
)
# Notices as they are commonly written (fixed values).
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the"
     " License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
     " documentation files, to deal in the Software without restriction"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public"
     " License as published by the Free Software Foundation"),
    ("gpl", "GNU General Public License"),
    # Names tell these apart: but for one word their headers are the GPL's.
    ("lgpl", "GNU Lesser General Public License"),
    ("lgpl", "GNU Library General Public License"),
    ("agpl", "GNU Affero General Public License"),
    ("mpl", "Mozilla Public License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
     " following conditions are met"),
    ("bsd", "BSD 2-Clause"), ("bsd", "BSD 3-Clause"), ("bsd", "2-Clause BSD"), ("bsd", "3-Clause BSD"), ("bsd", "the BSD License"),
    ("bsd", "New BSD License"), ("bsd", "Modified BSD License"), ("bsd", "Simplified BSD License"), ("bsd", "BSD style license"),
    ("isc", "the ISC License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "CC BY-NC"), ("cc-by-nc", "Creative Commons Attribution-NonCommercial"), ("cc-by-nc", "Creative Commons Attribution-Non-Commercial"),
    ("cc-by-sa", "CC BY-SA"), ("cc-by-sa", "Creative Commons Attribution-ShareAlike"), ("cc-by-sa", "Attribution-Share Alike"),
    ("cc-by-nd", "CC BY-ND"), ("cc-by-nd", "Creative Commons Attribution-NoDerivatives"), ("cc-by-nd", "Creative Commons Attribution-NoDerivs"),
    ("cc-by-nc-sa", "CC BY-NC-SA"), ("cc-by-nc-sa", "Attribution-NonCommercial-ShareAlike"), ("cc-by-nc-sa", "Attribution-NonCommercial-Share Alike"),
    ("cc-by-nc-nd", "CC BY-NC-ND"), ("cc-by-nc-nd", "Attribution-NonCommercial-NoDerivatives"), ("cc-by-nc-nd", "Attribution-NonCommercial-NoDerivs"),
    ("cc-by", "Creative Commons Attribution"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("all-rights-reserved", "All rights reserved"),
)
# Labels whose span gives way to a span of these that it shares words with. Apache's
# short notice is that of others but for the name.
NARROWER: dict[str, tuple[str, ...]] = {
    "apache": ("mpl", "bsd", "gpl", "lgpl", "agpl"), "gpl": ("lgpl", "agpl"), "cc-by": ("cc-by-nc", "cc-by-sa", "cc-by-nd", "cc-by-nc-sa", "cc-by-nc-nd"),
    "cc-by-nc": ("cc-by-nc-sa", "cc-by-nc-nd"), "cc-by-sa": ("cc-by-nc-sa",), "cc-by-nd": ("cc-by-nc-nd",),
}
GAP = 2  # words by which neighbouring diagonals may differ
SHARE = 0.8  # part of a template's words that a span must cover
SHORT = 10  # templates with fewer words must be covered in full
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str) -> list[str]:
    return re.findall(_WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text))


def _words(text: Column) -> Column:
    # lower() also maps the Kelvin sign to k; it is the only such letter outside ASCII.
    return F.regexp_extract_all(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\ufffd"))), F.lit(_WORD), F.lit(0))


def template_runs(templates: Sequence[tuple[str, str]], k: int) -> list[tuple[int, str, int, int, str]]:
    """(template, label, words, position, run) of every run of k words."""
    out = []
    for number, (label, text) in enumerate(templates):
        words = words_of(text)
        if len(words) < k:
            raise ValueError(f"a template needs {k} words: {text}")
        out += [(number, label, len(words), q, " ".join(words[q : q + k])) for q in range(len(words) - k + 1)]
    return out


def _run_hash(words: Sequence[Column]) -> Column:
    return F.xxhash64(*words)


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, Sequence[str]]] = PHRASES,
         k: int = K, share: float = SHARE, gap: int = GAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    ``spans`` (label, first_word, end_word, score) are verified places of templates, in
    order. score: the best covered share of a template, 1 where a phrase stands.
    """
    spark = docs.sparkSession
    runs = template_runs(templates, k)
    known = spark.createDataFrame(runs, "template int, label string, size int, q int, run string").withColumn(
        "gram", _run_hash([F.split("run", " ")[j] for j in range(k)])).coalesce(1)
    hashes = sorted({r[0] for r in known.select("gram").collect()})  # as many as the templates have runs

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), _words(F.col(text_col).cast("string")).alias("words"))
    words = F.col("words")

    def phrase_at(w: Column, i: Column) -> Column:
        found = F.lit(None).cast("string")
        for label, parts in phrases:
            stands = w == F.lit(parts[0])
            for j, part in enumerate(parts[1:], 1):
                stands = stands & (F.get(words, i + F.lit(j)) == F.lit(part))
            found = F.when(stands, F.lit(label)).otherwise(found)
        return F.when(found.isNotNull(), F.struct(i.alias("at"), found.alias("label")))

    def run_at(w: Column, i: Column) -> Column:
        gram = _run_hash([w, *(F.get(words, i + F.lit(j)) for j in range(1, k))])
        return F.when(gram.isin(hashes), F.struct(i.alias("p"), gram.alias("gram")))

    based = rows.select(
        "row", "doc_id", "words", F.size("words").cast("long").alias("n_words"),
        F.filter(F.transform("words", phrase_at), F.isnotnull).alias("base"),
        F.filter(F.transform("words", run_at), F.isnotnull).alias("hits"))
    facts = based.select(
        F.struct("row", "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base.at").cast("long").alias("first_word"),
                 F.array_max("base.at").cast("long").alias("last_word"), F.array_distinct("base.label").alias("base_labels")).alias("doc"),
        F.explode_outer(F.transform("hits", lambda h: F.struct(h["p"].alias("p"), h["gram"].alias("gram"), F.array_join(F.slice(words, h["p"] + 1, k), " ").alias("run")))).alias("hit"))
    votes = facts.select("doc", F.col("hit.p").alias("p"), F.col("hit.gram").alias("gram"), F.col("hit.run").alias("run")).join(
        known, ["gram", "run"], "left").select("doc", F.col("doc.row").alias("row"), "template", "label", "size", "p", "q", (F.col("p") - F.col("q")).alias("diagonal"))
    # Everything of a document is in one place from here on.
    votes = votes.repartition("row")
    diagonals = votes.groupBy("row", "doc", "template", "label", "size", "diagonal").agg(
        F.min("p").alias("first"), F.max("p").alias("last"), F.collect_set("q").alias("qs"))
    # Occurrences far apart are far apart in their diagonals, unless the texts repeat each other.
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    new = (F.col("diagonal") - F.lag("diagonal").over(order) > gap).cast("int")
    merged = diagonals.select("*", F.coalesce(new, F.lit(0)).alias("new")).select("*", F.sum("new").over(order).alias("band")).groupBy(
        "row", "doc", "template", "label", "size", "band").agg(
        F.min("first").alias("first"), (F.max("last") + k).alias("end"), F.array_distinct(F.flatten(F.collect_list("qs"))).alias("qs"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("qs", lambda q: F.sequence(q, q + k - 1)))))
    score = covered / F.col("size")
    enough = (score >= F.when(F.col("size") < SHORT, 1.0).otherwise(share)).alias("enough")
    judged = merged.select("row", "doc", "label", "first", "end", score.alias("score"), enough)
    by_place = Window.partitionBy("row").orderBy("first")
    so_far, from_here = by_place.rangeBetween(Window.unboundedPreceding, 0), by_place.rangeBetween(0, Window.unboundedFollowing)
    gives_way = F.lit(False)
    for label, narrower in NARROWER.items():
        found = F.col("label").isin(*narrower) & F.col("enough")
        shared = (F.max(F.when(found, F.col("end"))).over(so_far) > F.col("first")) | (F.min(F.when(found, F.col("first"))).over(from_here) < F.col("end"))
        gives_way = gives_way | ((F.col("label") == label) & F.coalesce(shared, F.lit(False)))
    judged = judged.select("*", gives_way.alias("gives_way"))
    span = F.when(F.col("enough") & ~F.col("gives_way"), F.struct(F.col("first").alias("first_word"), F.col("end").alias("end_word"), "label", "score"))
    per_doc = judged.select("row", "doc", span.alias("span")).groupBy("row", "doc").agg(F.sort_array(F.collect_list("span")).alias("spans"))
    best = F.coalesce(F.array_max("spans.score"), F.lit(0.0))
    return per_doc.select(
        "doc.doc_id", "doc.n_words", "doc.n_base", "doc.first_word", "doc.last_word", F.array_join(F.array_sort("doc.base_labels"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("doc.base_labels", F.array_distinct("spans.label"))), ",").alias("labels"),
        F.when(F.col("doc.n_base") > 0, F.lit(1.0)).otherwise(best).alias("score"), "spans")
