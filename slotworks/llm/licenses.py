"""Licence scan: units of text against licence templates by Dice over word bigrams, in DataFrame functions only.

A unit is a line of a document, or its whole text. Text and templates are normalised alike: A-Z in
lower case, everything else but a-z and 0-9 a space. Dice is 2 * shared / (unit + template) over
distinct word bigrams. At a threshold t only units of t / (2 - t) to (2 - t) / t times a
template's bigrams can reach it, so each template has a size range, and a unit is compared with
those templates only whose range it lies in and with which it shares a bigram.

Edge cases: null and empty texts, and units of one word, match nothing; repeated lines count each
by `n_units`; equal scores are all reported; null keys are reported under a null key; texts of any
length are read whole; an empty table gives an empty result. Other columns are not read.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Identifiers and notices of public licences.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
]
PERCENT = 85


def words(text: Column | str) -> Column:
    """Normalised words."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, "[^0-9a-z]+"), lambda w: w != "")


def bigrams(words_: str) -> Column:
    """Distinct pairs of neighbouring words."""
    n = F.greatest(F.size(words_) - 1, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(words_, 1, n), F.slice(words_, 2, n), lambda a, b: F.concat(a, F.lit(" "), b)))


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that later expressions read instead of computing it again."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def template_bigrams(spark: SparkSession, templates: list[tuple[str, str]], percent: int) -> DataFrame:
    """(template, license, size, low, high, bigram): low and high are the unit sizes that can reach the threshold."""
    rows = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "template int, license string, text string")
    own = rows.withColumn("_w", words("text")).withColumn("_b", bigrams("_w")).withColumn("size", F.size("_b"))
    # 2 * min(u, t) / (u + t) >= p / 100 bounds u on both sides
    low, high = F.ceil(F.lit(percent) * F.col("size") / (200 - percent)), F.floor(F.lit(200 - percent) * F.col("size") / percent)
    return own.select("template", "license", "size", low.cast("int").alias("low"), high.cast("int").alias("high"), F.explode("_b").alias("bigram"))


def scan(df: DataFrame, templates: list[tuple[str, str]] | None = None, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, license, n_units, best_dice): a row per row key and licence with a unit of `percent` or more."""
    spark = df.sparkSession
    # a list in the program: its few thousand bigrams at most are broadcast
    known = template_bigrams(spark, templates or TEMPLATES, percent)
    sizes = known.agg(F.min("low").alias("low"), F.max("high").alias("high"), F.array_sort(F.collect_set("bigram")).alias("all")).first()
    if sizes["all"] is None or not sizes["all"]:
        raise ValueError("no template has a bigram")
    lines = F.split(text, "\n")
    units = F.when(F.size(lines) > 1, F.concat(lines, F.array(text))).otherwise(lines)
    opened = df.filter(F.col(text).isNotNull()).select(F.col(key).alias("_key"), F.posexplode(units).alias("_u", "_t"))
    worded = computed_once(opened, "_w", words("_t")).filter(F.size("_w") > F.lit(sizes["low"]))
    near = (computed_once(worded, "_b", bigrams("_w")).filter(F.size("_b").between(sizes["low"], sizes["high"]))
            .filter(F.arrays_overlap("_b", F.array(*[F.lit(b) for b in sizes["all"]]))))
    met = (near.select("_key", "_u", "_t", F.size("_b").alias("_n"), F.explode("_b").alias("bigram")).join(F.broadcast(known), "bigram")
           .filter(F.col("_n").between(F.col("low"), F.col("high"))))
    dice = (met.groupBy("_key", "_u", F.xxhash64("_t").alias("_h"), "_n", "template", "license", "size").agg(F.count(F.lit(1)).alias("shared"))
            .filter(200 * F.col("shared") >= percent * (F.col("_n") + F.col("size"))))
    scored = dice.groupBy("_key", "_u", "_h", "license").agg(F.max(2 * F.col("shared") / (F.col("_n") + F.col("size"))).alias("d"))
    return scored.groupBy("_key", "license").agg(F.count(F.lit(1)).alias("n_units"), F.round(F.max("d"), 6).alias("best_dice")).withColumnRenamed("_key", key)
