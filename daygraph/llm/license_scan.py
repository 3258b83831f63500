"""License scan by diagonal voting, on built-in functions only.

All rolling word 3-grams of every text are joined to the positions of the same
3-grams in a fixed table of templates (a few hundred rows: a bounded broadcast).
A hit at word ``d`` of the text and ``t`` of the template votes for the diagonal
``d - t``. Base phrases are templates too: a place of the phrase is a diagonal on
which all its 3-grams vote. For the longer notices, diagonals that differ by at
most ``MAX_SHIFT`` (words put in or left out) are merged, and the merged span is
verified: it must cover ``MIN_COVER`` of the template's 3-grams within
``MAX_STRETCH`` times its length. Of verified spans that overlap, as those of sibling
licenses do, only the best covered counts (all of them if equal). Grams are compared as text, not as hashes, so a
vote is a verified word match.

Hits are partially aggregated per document before the shuffle; rows of a document
are its templates times diagonals, and nothing is gathered by gram or template.

Defined results: null is an empty text (no words); a text under three words has no
hits; repeated rows give repeated results; ties between labels do not matter, all
labels are listed; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daygraph.llm import words as W

K = 3
MAX_SHIFT = 2
#: Share of a notice's grams, and stretch of its length, for a verified span.
MIN_COVER, MAX_STRETCH = 0.6, 1.5

#: Phrases and labels of the base scan.
BASE_PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
#: Openings of public license notices, as words.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("all-rights-reserved", "no part of this publication may be reproduced distributed or transmitted in any form or by any means"),
]


def templates() -> list[tuple[int, str, bool, int, int, str]]:
    """Rows (template, label, base, number of grams, position, gram); one per gram."""
    rows = []
    for number, (base, label, text) in enumerate([(True, *x) for x in BASE_PHRASES] + [(False, *x) for x in NOTICES]):
        parts = text.split()
        grams = [" ".join(parts[i : i + K]) for i in range(len(parts) - K + 1)]
        rows += [(number, label, base, len(grams), i, gram) for i, gram in enumerate(grams)]
    return rows


#: Words that a verified span has at most.
REACH = int(MAX_STRETCH * max(len(text.split()) for _, text in NOTICES))


def license_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, ``n_words, n_base, first_word, last_word, base_labels, labels, score``."""
    spark = docs.sparkSession
    table = F.broadcast(spark.createDataFrame(
        templates(), "template int, label string, base boolean, grams int, t int, gram string"))
    # The words follow an empty element, so the first gram of every text meets no template; it stands for the document.
    tokens = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(W.text_of(text)).alias("content"), W.marked_words(W.text_of(text)).alias("words"))
    shifted = [F.slice("words", k + 1, F.size("words")).alias(f"w{k}") for k in range(K)]
    grams = tokens.select("doc_id", "content", (F.size("words") - 1).cast("long").alias("n_words"), F.arrays_zip(*shifted).alias("g"))
    # Outer, so that no filter on the array is inferred, which would split every text again.
    hits = grams.select("doc_id", "content", "n_words", F.posexplode_outer("g").alias("p", "g")).select(
        "doc_id", "content", "n_words", (F.col("p") - 1).alias("d"), F.concat_ws(" ", *[F.col(f"g.w{k}") for k in range(K)]).alias("gram")).join(
        table, "gram", "left").where(F.col("template").isNotNull() | (F.col("d") == -1)).fillna({"template": -1, "grams": 0, "t": -1, "base": False, "label": ""})
    key = ["doc_id", "content", "n_words"]
    # Rows that are equal in every respect share a key; the marks count them and they part again at the end.
    votes = hits.groupBy(*key, "template", "label", "base", "grams", (F.col("d") - F.col("t")).alias("diagonal")).agg(
        F.count(F.lit(1)).alias("n"), F.collect_set("t").alias("t"), F.max(F.col("d")).alias("last"))
    order = Window.partitionBy(*key, "template").orderBy("diagonal")
    breaks = (F.col("diagonal") - F.lag("diagonal").over(order) > MAX_SHIFT).cast("int")
    merged = votes.withColumn("group", F.sum(F.coalesce(breaks, F.lit(0))).over(order)).groupBy(
        *key, "template", "label", "base", "grams", "group").agg(
        F.max("n").alias("n"), F.array_distinct(F.flatten(F.collect_list("t"))).alias("t"),
        F.min("diagonal").alias("low"), F.max("last").alias("last"),
        F.collect_list(F.when(F.size("t") == F.col("grams"), F.col("diagonal"))).alias("full"))
    cover = F.when(F.col("grams") > 0, F.size("t") / F.col("grams"))
    first = F.col("low") + F.array_min("t")
    verified = ~F.col("base") & (F.col("grams") > 0) & (cover >= MIN_COVER) & (
        F.col("last") - first + K <= MAX_STRETCH * (F.col("grams") + K - 1))
    found = F.col("base") & (F.size("full") > 0)
    span = F.struct(F.col("start").alias("a"), (F.col("last") + K).alias("b"), F.col("cover").alias("c"))
    near = Window.partitionBy(*key).orderBy("start").rangeBetween(-REACH, REACH)
    merged = merged.withColumns({"start": first.cast("long"), "cover": cover, "verified": verified}).withColumn(
        "near", F.collect_set(F.when(F.col("verified"), span)).over(near))
    verified = F.col("verified") & ~F.exists("near", lambda o: (o.a < F.col("last") + K) & (o.b > F.col("start")) & (o.c > F.col("cover")))
    out = merged.groupBy(*key).agg(
        F.max(F.when(F.col("template") == -1, F.col("n"))).alias("copies"),
        F.sum(F.when(found, F.size("full")).otherwise(0)).alias("n_base"),
        F.min(F.when(found, F.array_min("full"))).cast("long").alias("first_word"),
        F.max(F.when(found, F.array_max("full"))).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(found, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set(F.when(found | verified, F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(F.when(found, F.lit(1.0)).when(verified, cover)), F.lit(0.0)).alias("score"))
    return out.select("*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op9_license_scan(spark, sf_dir: str) -> DataFrame:
    """License phrases and notices in every text of ``documents``."""
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op9_license_scan": op9_license_scan}

_ROWS = ",\n".join(f"({n}, '{label}', {str(base).lower()}, {grams}, {t}, '{gram}')" for n, label, base, grams, t, gram in templates() )
ORACLE = {"op9_license_scan": f"""
WITH tpl(template, label, base, grams, t, gram) AS (VALUES {_ROWS}),
d AS (SELECT row_number() OVER () AS rid, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), '{W.UPPER}', '{W.LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
g AS (SELECT rid, i AS d, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] AS gram FROM (SELECT rid, w, unnest(range(0, len(w) - 2)) AS i FROM d)),
v AS (SELECT rid, template, label, base, grams, d - t AS diagonal, list(DISTINCT t) AS t, max(d) AS last FROM g JOIN tpl USING (gram) GROUP BY ALL),
b AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY rid, template ORDER BY diagonal) > {MAX_SHIFT} THEN 1 ELSE 0 END AS brk FROM v),
s AS (SELECT *, sum(brk) OVER (PARTITION BY rid, template ORDER BY diagonal) AS grp FROM b),
m AS (SELECT rid, template, label, base, grams, list_distinct(flatten(list(t))) AS t, min(diagonal) AS low, max(last) AS last,
             list(diagonal) FILTER (len(t) = grams) AS places FROM s GROUP BY rid, template, label, base, grams, grp),
x AS (SELECT *, base AND coalesce(len(places), 0) > 0 AS found, len(t) / grams AS cover,
             NOT base AND len(t) / grams >= {MIN_COVER} AND last - (low + list_min(t)) + {K} <= {MAX_STRETCH} * (grams + {K - 1}) AS verified FROM m),
y AS (SELECT *, low + list_min(t) AS a, last + {K} AS z FROM x),
o AS (SELECT rid, a AS oa, z AS oz, max(cover) AS oc FROM y WHERE verified GROUP BY ALL),
p AS (SELECT *, verified AND NOT EXISTS (SELECT 1 FROM o WHERE o.rid = y.rid AND oa < z AND oz > a AND oc > cover) AS best FROM y),
r AS (SELECT rid, coalesce(sum(len(places)) FILTER (found), 0) AS n_base, min(list_min(places)) FILTER (found) AS first_word,
             max(list_max(places)) FILTER (found) AS last_word, list_sort(list(DISTINCT label) FILTER (found)) AS bl,
             list_sort(list(DISTINCT label) FILTER (found OR best)) AS al,
             max(CASE WHEN found THEN 1.0::DOUBLE WHEN best THEN cover END) AS score FROM p GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(array_to_string(bl, ','), '') AS base_labels, coalesce(array_to_string(al, ','), '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN r USING (rid)
"""}
