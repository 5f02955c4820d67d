"""License scan by diagonal voting.

Every rolling word k-gram of a document that a license template has is a vote for the diagonal (place in the document
less place in the template). Votes are counted per document, template and diagonal; diagonals a few words apart, as
left by inserted or dropped words, are merged; a merged span counts if enough of the template's k-grams voted and they
lie close together. Named phrases are templates of two-word grams that have to match in full.

Defined cases: a null text is empty; a text without words has no places, null bounds and score 0; repeated rows have a
row each; equal diagonals of two templates of one label count once as a label, each as a place.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import texts
from .grams import hits, template_grams

# --- fixed values ------------------------------------------------------------
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
NOTICES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction including without limitation the "
            "rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
            "public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that "
            "the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
            "granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# -----------------------------------------------------------------------------
PHRASE_K = 2
NOTICE_K = 3
NEAR = 3
SHARE = 0.6
DENSITY = 0.5


def words(text: str = "text") -> Column:
    """Words of a text with A-Z in lower case; letters beyond ASCII stay as they are."""
    return F.regexp_extract_all(F.translate(F.col(text), ascii_uppercase, ascii_lowercase), F.lit(WORD), F.lit(0))


def template_table(spark: SparkSession, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    rows = [(p.split(), label, PHRASE_K) for p, label in phrases] + [(t.split(), label, NOTICE_K) for label, t in notices]
    values = ", ".join(f"({n}L, split('{' '.join(w)}', ' '), '{label}', {k}, {len(w) - k + 1})" for n, (w, label, k) in enumerate(rows))
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(template, words, label, k, grams)")


def scan(docs: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """One row a document: words, base places and their bounds, labels and score."""
    spark = docs.sparkSession
    templates = template_table(spark) if templates is None else templates
    grams = template_grams(templates.where(F.col("k") == PHRASE_K), 0, PHRASE_K).unionByName(
        template_grams(templates.where(F.col("k") == NOTICE_K), 0, NOTICE_K)
    )
    rows = texts(docs).select("doc_id", words().alias("words"))
    found = hits(rows, grams, [("words", 0, PHRASE_K), ("words", 0, NOTICE_K)])
    diagonals = (
        found.groupBy("uid", "doc_id", "n_words", "template", (F.col("pos") - F.col("at")).alias("diagonal"))
        .agg(F.collect_set("at").alias("ats"), F.min("pos").alias("low"), F.max("pos").alias("high"))
    )
    named = F.broadcast(templates.select("template", "label", F.col("k").alias("gram"), "grams"))
    placed = diagonals.join(named, "template", "left")
    in_order = Window.partitionBy("uid", "template").orderBy("diagonal")
    notice = F.col("gram") == NOTICE_K
    step = F.when(notice & (F.col("diagonal") - F.lag("diagonal").over(in_order) <= NEAR), 0).otherwise(1)
    spans = (
        placed.withColumn("step", step).withColumn("span", F.sum("step").over(in_order))
        .groupBy("uid", "doc_id", "n_words", "template", "label", "gram", "grams", "span")
        # a place of the template that several near diagonals have is one vote
        .agg(F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("votes"), F.min("low").alias("low"), F.max("high").alias("high"))
    )
    share = F.least(F.col("votes") / F.col("grams"), F.lit(1.0))
    density = F.col("votes") / (F.col("high") - F.col("low") + 1)
    base = (F.col("gram") == PHRASE_K) & (F.col("votes") == F.col("grams"))
    method = notice & (share >= SHARE) & (density >= DENSITY)
    judged = spans.withColumns({"base": base, "method": method, "share": share})
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return (
        judged.groupBy("uid", "doc_id").agg(
            F.max("n_words").alias("n_words"), F.count_if("base").alias("n_base"),
            F.min(F.when(F.col("base"), F.col("low"))).cast("long").alias("first_word"),
            F.max(F.when(F.col("base"), F.col("low"))).cast("long").alias("last_word"),
            joined(F.when(F.col("base"), F.col("label"))).alias("base_labels"),
            joined(F.when(F.col("base") | F.col("method"), F.col("label"))).alias("labels"),
            F.coalesce(F.max(F.when(F.col("base") | F.col("method"), F.col("share"))), F.lit(0.0)).alias("score"),
        ).drop("uid")
    )
