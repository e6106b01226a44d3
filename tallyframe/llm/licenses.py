"""License scans by diagonal voting.

Every rolling word k-gram of every text is hashed and joined with the k-grams of the templates. A match at word p of a
text and word t of a template votes for the diagonal p - t. Diagonals close to each other, as words put in or left out
make them, are merged; a span is verified by its k-grams, word for word, and by the share of the template it covers.
A diagonal on which every k-gram of a template votes is a place where the template stands unchanged.

Only DataFrame operations. Templates are a fixed, small table and are broadcast. A scan is one pass over the texts;
after it only matches are shuffled.

Defined cases: null and empty texts have no words, no labels and score 0; repeated rows and null ids are documents of
their own; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import KEY, keyed, written
from tallyframe.llm.grams import BETWEEN, bare, exploded

# The phrases looked for and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Well-known sentences of licences, in the words of their public texts.
TEMPLATES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "licensed under the apache license version 2 0 you may not use this file except in compliance with the license": "apache-2",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "licensed under the gnu general public license version 3": "gpl",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc",
}
GRAM = 3
COVERED = 0.6  # share of a template's k-grams that a verified span needs
SLACK = 3  # how far apart diagonals of one span may lie


def template_grams(spark: SparkSession, phrases: dict[str, str], templates: dict[str, str], size: int) -> DataFrame:
    """``template, label, base, n_grams, t, gram``; templates of fewer words than a k-gram are refused."""
    rows = []
    for base, group in ((True, phrases), (False, templates)):
        for text, label in group.items():
            parts = text.split()
            if len(parts) < size:
                raise ValueError(f"a template needs {size} words: {text}")
            grams = [" ".join(parts[i : i + size]) for i in range(len(parts) - size + 1)]
            number = len(rows)
            rows += [(number, label, base, len(grams), i, g) for i, g in enumerate(grams)]
    return spark.createDataFrame(rows, "template int, label string, base boolean, n_grams int, t int, gram string")


def scan(
    docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, size: int = GRAM
) -> tuple[DataFrame, DataFrame]:
    """(``__key, n_words`` of all keyed documents; their verified spans).

    Spans: ``__key, template, label, base, start, end, covered``; the words from start to end (exclusive).
    """
    table = template_grams(docs.sparkSession, phrases, templates, size).withColumn("hash", F.xxhash64("gram"))
    word = F.col("words")
    hashed = F.transform(
        word,
        lambda x, i: F.struct(
            F.concat_ws(" ", x, *[F.get(word, i + j) for j in range(1, size)]).alias("gram"),
        ),
    )
    rows = exploded(bare(docs), F.transform(hashed, lambda g: F.struct(g["gram"].alias("gram"), F.xxhash64(g["gram"]).alias("hash"))))
    rows = rows.select(KEY, "n_words", "place", F.col("value.gram").alias("words"), F.col("value.hash").alias("hash"))
    joined = rows.join(F.broadcast(table), "hash", "left")  # a fixed table, bounded by the templates
    joined = joined.filter((F.col("place") < 0) | (F.col("words") == F.col("gram")))
    votes = written(joined.select(KEY, "n_words", "place", "template", "label", "base", "n_grams", "t"))
    counted = votes.filter("place < 0").select(KEY, "n_words")

    of = [KEY, "template", "label", "base", "n_grams"]
    diagonals = votes.filter("place >= 0").groupBy(*of, (F.col("place") - F.col("t")).alias("diagonal"))
    diagonals = diagonals.agg(F.min("place").alias("low"), F.max("place").alias("high"), F.collect_set("t").alias("ts"))
    exact = diagonals.filter(F.col("base") & (F.size("ts") == F.col("n_grams")))
    exact = exact.select(KEY, "template", "label", "base", F.col("diagonal").alias("start"), (F.col("diagonal") + F.col("n_grams") + size - 1).alias("end"), F.lit(1.0).alias("covered"))
    # neighbours: diagonals by their first place, close in place and in offset to the one before
    before = Window.partitionBy(KEY, "template").orderBy("low", "diagonal")
    apart = (F.col("low") > F.lag("high").over(before) + size + SLACK) | (F.abs(F.col("diagonal") - F.lag("diagonal").over(before)) > SLACK)
    runs = diagonals.withColumn("run", F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(before.rowsBetween(Window.unboundedPreceding, 0)))
    merged = runs.groupBy(*of, "run").agg(
        F.min("low").alias("start"), (F.max("high") + size).alias("end"), F.array_distinct(F.flatten(F.collect_list("ts"))).alias("ts")
    )
    covered = F.size("ts") / F.col("n_grams")
    near = merged.withColumn("covered", covered).filter((F.col("covered") >= COVERED) & ~F.col("base"))
    return counted, exact.unionByName(near.select(KEY, "template", "label", "base", "start", "end", "covered"))


def labels(docs: DataFrame, **how) -> DataFrame:
    """``__key, n_words, n_base, first_word, last_word, base_labels, labels, score`` of keyed documents."""
    counted, spans = scan(docs, **how)
    base = F.when(F.col("base"), F.col("start"))
    joined = lambda column: F.concat_ws(",", F.sort_array(F.collect_set(column)))
    found = spans.groupBy(KEY).agg(
        F.count(base).alias("n_base"),
        F.min(base).cast("long").alias("first_word"),
        F.max(base).cast("long").alias("last_word"),
        joined(F.when(F.col("base"), F.col("label"))).alias("base_labels"),
        joined("label").alias("labels"),
        F.max("covered").alias("score"),
    )
    whole = counted.join(found, KEY, "left")
    return whole.fillna({"n_base": 0, "base_labels": "", "labels": "", "score": 0.0})


def op6_license_diagonals(spark: SparkSession, folder: str) -> DataFrame:
    docs = keyed(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"))
    return docs.select(KEY, "doc_id").join(labels(docs), KEY).drop(KEY)
