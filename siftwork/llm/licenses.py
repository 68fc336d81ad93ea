"""License scan: MinHash bands over text windows retrieve templates; DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, fixed, text_of

# Openings, notices and whole texts of public licenses, as they stand in files.
_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT "
    "NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
    "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_BSD_2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
    "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
    "disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
    "disclaimer in the documentation and/or other materials provided with the distribution. ")
_BSD_3 = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
    "this software without specific prior written permission. ")
TEMPLATES = {
    "MIT": ["Released under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
            "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
            "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
            "this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "
            "\"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
            "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS "
            "BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
            "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
                   "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.",
                     "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met", _BSD_2 + _DISCLAIMER, _BSD_2 + _BSD_3 + _DISCLAIMER],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS "
            "IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
            "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL "
            "DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
            "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}
SHINGLE = 5
#: Shingles of a window, and from one window's start to the next. A piece of a template has at most
#: WINDOW - STEP + 1 shingles, so that wherever it stands some window holds all of it.
WINDOW, STEP = 12, 6
PIECE = WINDOW - STEP + 1
#: The chance that no band of a window with a whole piece agrees, at most.
MISS = 1e-4


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def with_shingles(df: DataFrame) -> DataFrame:
    """``df`` and ``sh``, a hash of each run of SHINGLE words of ``ws``, in order."""
    df = fixed(df, "__wh", F.transform("ws", lambda w: F.xxhash64(w)))
    run = F.transform(F.sequence(F.lit(0), F.size("__wh") - SHINGLE), lambda i: F.xxhash64(*[F.get("__wh", i + k) for k in range(SHINGLE)]))
    return fixed(df, "sh", F.when(F.size("__wh") >= SHINGLE, run).otherwise(F.array().cast("array<bigint>"))).drop("__wh")


def pieces(spark: SparkSession, templates=None) -> DataFrame:
    """(license, notice, piece, ws, sh): the templates cut into pieces of at most PIECE shingles, the last one full."""
    rows = [(name, n, t) for name, texts in (templates or TEMPLATES).items() for n, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "license string, notice int, text string").withColumn("ws", words(F.col("text")))
    d = d.where(F.size("ws") >= SHINGLE).withColumn("n", F.size("ws") - SHINGLE + 1)
    first = F.transform(F.sequence(F.lit(0), F.ceil(F.col("n") / PIECE).cast("int") - 1),
                        lambda i: F.greatest(F.lit(0), F.least(i * PIECE, F.col("n") - PIECE)))
    d = d.select("license", "notice", "ws", F.posexplode(first).alias("piece", "at"))
    d = d.withColumn("ws", F.slice("ws", F.col("at") + 1, PIECE + SHINGLE - 1))
    return with_shingles(d).select("license", "notice", "piece", "ws", "sh")


def bands() -> int:
    """Bands of one row each: a window of WINDOW shingles with a whole piece of one shingle has Jaccard 1 / WINDOW, the
    least there is, and misses all bands with a chance of at most MISS."""
    return math.ceil(math.log(MISS) / math.log(1 - 1 / WINDOW))


def signature(sh: Column) -> Column:
    """The lowest shingle under each band's permutation: the shingles' hashes, hashed on with the band's number."""
    return F.transform(F.sequence(F.lit(0), F.lit(bands() - 1)), lambda k: F.array_min(F.transform(sh, lambda x: F.xxhash64(x, k))))


def license_scan(docs: DataFrame, containment: float = 0.8, templates=None) -> DataFrame:
    """One row per document: doc_id, n_windows (windows that hold a piece of a found notice), licenses (names by code
    point, joined by commas), containment (of the best notice, 0 if none).

    Words are lower-case runs of letters and digits, shingles five of them. A window is 12 shingles, one begins at
    every sixth. MinHash signatures of the windows retrieve the templates' pieces band by band through an equi-join; the
    bands are so many that a window with a whole piece is missed with a chance of 1e-4 at most. Then the retrieved
    notice's shingles, as words and not as hashes, are looked up in the text's windows: a notice is found if windows that
    begin within twice its number of shingles hold ``containment`` of its distinct shingles together. Pieces only
    retrieve. Only windows that hold some shingle of a template at all are looked at; others contain nothing.

    Whole texts are scanned in one pass and never move; windows that remain are few. Null and empty texts and texts of
    fewer than five words have no window. Repeated rows with one doc_id give one result, in which different texts are
    each scanned on their own; null ids count as one document. No rows give none; other columns are ignored.
    """
    spark = docs.sparkSession
    known = pieces(spark, templates)
    all_shingles = sorted({x for r in known.select("sh").collect() for x in r["sh"]})  # of the templates
    any_of = F.array(*[F.lit(x) for x in all_shingles])
    d = with_shingles(fixed(docs.select("doc_id", text_of(docs).alias("t")), "ws", words(F.col("t"))).drop("t"))
    hit = d.where(F.arrays_overlap("sh", any_of))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("sh") - WINDOW + STEP - 1), F.lit(STEP))
    hit = fixed(hit, "key", F.md5(F.array_join("ws", " ")))  # of the text: rows of one id may have several
    w = hit.select("doc_id", "key", "ws", "sh", F.explode(starts).alias("at"))
    w = fixed(w, "wsh", F.slice("sh", F.col("at") + 1, WINDOW))
    w = w.select("doc_id", "key", "at", F.slice("ws", F.col("at") + 1, WINDOW + SHINGLE - 1).alias("ws"), F.col("wsh").alias("sh"))
    w = cut(w.where(F.arrays_overlap("sh", any_of)))
    texts = w.select("doc_id", "key").distinct()
    w = w.drop("doc_id").dropDuplicates(["key", "at"])
    t = known.select("license", "notice", F.posexplode(signature(F.col("sh"))).alias("band", "low"))
    met = w.select("key", F.posexplode(signature(F.col("sh"))).alias("band", "low"))
    met = met.join(F.broadcast(t), ["band", "low"]).select("key", "license", "notice").distinct()  # the templates: fixed values

    def runs(c):
        return F.transform(F.sequence(F.lit(1), F.size(c) - SHINGLE + 1), lambda i: F.array_join(F.slice(c, i, SHINGLE), " "))

    whole = known.select("license", "notice", F.array_distinct(runs(F.col("ws"))).alias("own")).groupBy("license", "notice").agg(
        F.collect_list("own").alias("pieces"))
    whole = whole.withColumn("n", F.size(F.array_distinct(F.flatten("pieces"))))
    near = w.select("key", "at", "ws").join(met, "key").join(F.broadcast(whole), ["license", "notice"])
    near = fixed(near, "has", F.array_intersect(F.array_distinct(F.flatten("pieces")), runs(F.col("ws")))).where(F.size("has") > 0)
    # the windows that begin within twice the notice's number of shingles
    place = F.floor(F.col("at") * 1000 / F.col("n"))
    passage = Window.partitionBy("key", "license", "notice").orderBy(place).rangeBetween(0, 2000)
    near = near.withColumn("share", F.size(F.array_distinct(F.flatten(F.collect_list("has").over(passage)))) / F.col("n"))
    stands = F.exists("pieces", lambda p: F.size(F.array_intersect(p, F.col("has"))) >= F.size(p) * containment)
    found = near.groupBy("key", "license", "notice").agg(
        F.max("share").alias("share"), F.collect_set(F.when(stands, F.col("at"))).alias("at")).where(F.col("share") >= containment)
    found = found.join(texts, "key")
    found = found.groupBy("doc_id").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("at")))).cast("long").alias("n_windows"),
        F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"), F.max("share").alias("containment"))
    rows = docs.select("doc_id").distinct().alias("d").join(found.alias("f"), F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")), "left")
    return rows.select("d.doc_id", F.coalesce("n_windows", F.lit(0)).cast("long").alias("n_windows"),
                       F.coalesce("licenses", F.lit("")).alias("licenses"), F.coalesce("containment", F.lit(0.0)).alias("containment"))
