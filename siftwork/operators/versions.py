"""Version history as an append-only table: append, list, compare, trend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.numbering import numbered

VERSION_SCHEMA = ("session_id string, version_id bigint, label string, text string, score double, grade string, "
                  "dims map<string,double>, ts bigint, entry string")
NOT_FOUND = "One or both versions not found"


def version_entries(rows: DataFrame, order_col: str = "ts", session_col: str = "session_id", label_col: str = "label",
                    text_col: str = "text", score_col: str | None = None, grade_col: str | None = None,
                    dims_col: str | None = None) -> DataFrame:
    """What is to be saved: blank labels and texts rejected; defaults: session 'default', score 0, grade 'N/A', empty
    dimensions. ``entry`` names a save (session, time, label, text), so saving it again can be told."""
    label, text = T.py_strip(label_col), T.py_strip(text_col)
    session = F.coalesce(F.col(session_col).cast("string"), F.lit("default"))
    score = F.coalesce(F.col(score_col).cast("double"), F.lit(0.0)) if score_col else F.lit(0.0)
    grade = F.coalesce(F.col(grade_col), F.lit("N/A")) if grade_col else F.lit("N/A")
    dims = (F.coalesce(F.col(dims_col), F.create_map().cast("map<string,double>")) if dims_col
            else F.create_map().cast("map<string,double>"))
    kept = rows.select(session.alias("session_id"), F.col(order_col).alias("ts"), label.alias("label"), text.alias("text"),
                       score.alias("score"), grade.alias("grade"), dims.alias("dims")).where("label != '' and text != ''")
    time = F.coalesce(F.col("ts").cast("string"), F.lit(""))
    return kept.withColumn("entry", F.sha2(F.concat_ws("\u0001", "session_id", time, "label", "text"), 256))


def version_append(rows: DataFrame, order_col: str = "ts", session_col: str = "session_id", label_col: str = "label",
                   text_col: str = "text", score_col: str | None = None, grade_col: str | None = None,
                   dims_col: str | None = None, existing: DataFrame | None = None) -> DataFrame:
    """The versions that saving ``rows`` adds to the table ``existing`` (none: an empty one), with consecutive ids.

    Entries that the table holds already are left out, so a repeated append adds nothing; equal entries are one save.
    A session's new ids follow its greatest one in the order of the time, then the entry; they are counted over ranges
    of that order, so one session may hold a third of all rows."""
    new = version_entries(rows, order_col, session_col, label_col, text_col, score_col, grade_col, dims_col).dropDuplicates(["entry"])
    if existing is not None:
        new = new.join(existing.select("entry"), "entry", "left_anti")
    new = numbered(new, ["session_id"], [F.col("ts"), F.col("entry")], "_place")
    last = F.lit(0)
    if existing is not None:
        heads = existing.groupBy("session_id").agg(F.max("version_id").alias("_last"))
        new = new.join(heads, "session_id", "left")
        last = F.coalesce("_last", F.lit(0))
    return new.select("session_id", (last + F.col("_place")).cast("long").alias("version_id"), "label", "text", "score", "grade", "dims", "ts", "entry")


def version_list(versions: DataFrame, session_id: str | None = None) -> DataFrame:
    v = versions if session_id is None else versions.where(F.col("session_id") == session_id)
    return v.orderBy("session_id", "version_id")


def version_compare(versions: DataFrame, requests: DataFrame) -> DataFrame:
    """For each request (session_id, id_a, id_b): one row per dimension in the union of both
    versions' keys (missing = 0) with delta b - a rounded to 1, plus the score delta; an error row
    when either id is missing."""
    va = versions.select("session_id", F.col("version_id").alias("id_a"), F.col("score").alias("score_a"),
                         F.col("dims").alias("dims_a"))
    vb = versions.select("session_id", F.col("version_id").alias("id_b"), F.col("score").alias("score_b"),
                         F.col("dims").alias("dims_b"))
    r = requests.join(va, ["session_id", "id_a"], "left").join(vb, ["session_id", "id_b"], "left")
    found = F.col("score_a").isNotNull() & F.col("score_b").isNotNull()
    ok = r.where(found)
    ea = ok.select("session_id", "id_a", "id_b", F.explode("dims_a").alias("dimension", "version_a"))
    eb = ok.select("session_id", "id_a", "id_b", F.explode("dims_b").alias("dimension", "version_b"))
    keys = ["session_id", "id_a", "id_b", "dimension"]
    both = ea.join(eb, keys, "full_outer").na.fill(0.0, ["version_a", "version_b"])
    scores = ok.select("session_id", "id_a", "id_b", F.round(F.col("score_b") - F.col("score_a"), 1).alias("score_delta"))
    rows = both.join(scores, ["session_id", "id_a", "id_b"]).select(
        *keys, "version_a", "version_b", F.round(F.col("version_b") - F.col("version_a"), 1).alias("delta"),
        "score_delta", F.lit(None).cast("string").alias("error"))
    errors = r.where(~found).select(
        "session_id", "id_a", "id_b", F.lit(None).cast("string").alias("dimension"),
        F.lit(None).cast("double").alias("version_a"), F.lit(None).cast("double").alias("version_b"),
        F.lit(None).cast("double").alias("delta"), F.lit(None).cast("double").alias("score_delta"),
        F.lit(NOT_FOUND).alias("error"))
    return rows.unionByName(errors)


#: Versions of a session whose running best is made together.
STRETCH = 10_000


def version_trend(versions: DataFrame) -> DataFrame:
    """Change from the previous version and best score so far, per session.

    Ids are consecutive, so the previous version is found by an equi-join; the running best is made within stretches of
    ids and raised by the best of the stretches before, so a session of any size lies in many tasks."""
    v = versions.select("session_id", "version_id", "score", F.floor(F.col("version_id") / STRETCH).alias("_part"))
    last = versions.select("session_id", (F.col("version_id") + 1).alias("version_id"), F.col("score").alias("_last"))
    before = Window.partitionBy("session_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = v.groupBy("session_id", "_part").agg(F.max("score").alias("_best"))
    parts = parts.select("session_id", "_part", F.max("_best").over(before).alias("_before"))
    own = Window.partitionBy("session_id", "_part").orderBy("version_id").rowsBetween(Window.unboundedPreceding, 0)
    j = v.withColumn("_own", F.max("score").over(own)).join(parts, ["session_id", "_part"]).join(last, ["session_id", "version_id"], "left")
    return j.select("session_id", "version_id", "score", F.round(F.col("score") - F.col("_last"), 1).alias("change"),
                    F.greatest("_own", "_before").alias("best_so_far"))
