"""License scans: MinHash bands over overlapping text windows, then exact shingle containment.

A template of m words has m - 4 five-word shingles. For every number w of shingles that some template has, texts are read
in overlapping windows of w shingles that begin every ``stride`` = max(1, w // 8) shingles. A window's signature has
``BANDS`` minimum hashes, each a band of its own; a window and a template of its size class meet in an equi-join on a
band. Two sets of similarity j collide with probability 1 - (1 - j)^BANDS: at 0.8 all but 3 in a million do, at 0.6, which
allows for the window's offset against the text, all but 7 in 10,000. Then the share of the template's shingles in the
window and a stride around it is counted exactly, and at least ``contained`` is reported.

A window without any template shingle cannot collide, so windows are formed only around positions whose shingle occurs in
a template; these are found in one generated loop over the texts' word hashes. Only the windows' places leave it; the few texts
that have any are read again. Template tables are broadcast when they have at most ``SMALL`` rows and joined by shuffle beyond it.
Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.plans.storage import materialize

SIZE = 5
BANDS = 8
SMALL = 1_000_000
FEW = 200_000  # windows that may be broadcast to the texts that have them

#: fixed values: notices and headers of common licenses
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in "
        "the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
        "Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def template_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *t) for i, t in enumerate(TEMPLATES)], "template_id int, license string, text string")


def _hashes(text: Column) -> Column:
    """Hashes of the lower-case words; marks and white space part words."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _shingle(at: Column) -> Column:
    return F.xxhash64(*[F.get("h", at + o) for o in range(SIZE)])


def _shingles(begin: Column, end: Column) -> Column:
    """Shingle hashes at begin to end, both inside; none if end lies before begin."""
    return F.when(end >= begin, F.transform(F.sequence(begin, end), _shingle)).otherwise(F.array().cast("array<bigint>"))


def _bands(shingles: Column) -> Column:
    return F.array(*[F.xxhash64(F.lit(b), F.array_min(_salted(shingles, b))) for b in range(BANDS)])


def _salted(shingles: Column, band: int) -> Column:
    return F.transform(shingles, lambda x: F.xxhash64(F.lit(band), x))


def license_scan(docs: DataFrame, templates: DataFrame, contained: float = 0.8) -> DataFrame:
    """doc_id, license, containment (the best of the license's templates) and word (where its window begins) of every find.

    ``docs`` needs doc_id and text, ``templates`` template_id, license and text; other columns are not read. Rows with a
    null id, null or empty texts and templates of fewer than five words give nothing. Rows that share an id are read as
    several texts of one document. An empty table gives no rows.
    """

    def bounded(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= SMALL else df

    known = templates.where("template_id is not null").select("template_id", "license", _hashes(F.col("text")).alias("h")).where(F.size("h") >= SIZE)
    known = known.select("template_id", "license", F.array_distinct(_shingles(F.lit(0), F.size("h") - SIZE)).alias("own"), (F.size("h") - SIZE + 1).alias("w"))
    classes = known.select(F.explode("own").alias("shingle"), "w").distinct()
    texts = docs.where("doc_id is not null").select("doc_id", _hashes(F.col("text")).alias("h"))
    at = texts.select("doc_id", "h", F.explode(F.sequence(F.lit(0), F.greatest(F.size("h") - SIZE, F.lit(0)))).alias("at"))
    # narrow rows only: generating, probing and making distinct stay in one generated loop that copies no word arrays
    hits = at.select("doc_id", "at", _shingle(F.col("at")).alias("shingle")).join(bounded(classes), "shingle")
    stride = F.greatest(F.floor(F.col("w") / 8), F.lit(1)).cast("int")
    hits = hits.select("doc_id", "at", "w", stride.alias("stride"))
    first = F.greatest(F.ceil((F.col("at") - F.col("w") + 1) / F.col("stride")), F.lit(0)).cast("int")
    steps = F.sequence(first, F.greatest(first, F.floor(F.col("at") / F.col("stride")).cast("int")))
    windows = hits.select("doc_id", "w", "stride", F.explode(steps).alias("step")).select("doc_id", "w", "stride", (F.col("step") * F.col("stride")).alias("begin"))
    windows = materialize(windows.distinct())
    held = windows.groupBy("doc_id").agg(F.collect_list(F.struct("w", "stride", "begin")).alias("windows"))
    held = F.broadcast(held) if windows.count() <= FEW else held
    again = docs.where("doc_id is not null").select("doc_id", "text").join(held, "doc_id").select("doc_id", "windows", _hashes(F.col("text")).alias("h"))
    last = F.size("h") - SIZE  # of the text's shingles

    def read(x):
        end = x["begin"] + x["w"] - 1
        near, around = _shingles(x["begin"], F.least(end, last)), _shingles(F.greatest(x["begin"] - x["stride"], F.lit(0)), F.least(end + x["stride"], last))
        return F.struct(x["w"].alias("w"), x["begin"].alias("begin"), near.alias("near"), around.alias("around"))

    windows = again.select("doc_id", F.explode(F.transform("windows", read)).alias("x")).select("doc_id", "x.*").where(F.size("near") > 0)
    banded = windows.select("doc_id", "w", "begin", "around", F.explode(_bands(F.col("near"))).alias("band"))
    template_bands = known.select("template_id", "license", "own", "w", F.explode(_bands(F.col("own"))).alias("band"))
    met = banded.join(bounded(template_bands), ["band", "w"])
    share = F.size(F.array_intersect("own", "around")) / F.size("own")
    found = met.select("doc_id", "license", share.alias("containment"), F.col("begin").alias("word")).where(F.col("containment") >= contained)
    # the best share and its first window in one number, for hash aggregation carries no arrays through a sort
    place = F.floor(F.col("containment") * 1_000_000_000) * (1 << 32) + ((1 << 32) - 1 - F.col("word"))
    best = found.groupBy("doc_id", "license").agg(F.max("containment").alias("containment"), F.max(place).alias("place"))
    return best.select("doc_id", "license", "containment", ((1 << 32) - 1 - F.col("place") % (1 << 32)).cast("int").alias("word"))
