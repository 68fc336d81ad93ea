"""Streaming jobs: debounced live hints and incremental scoring with version append.

The same functions run on batch DataFrames and on streams: sessions of edits with a hint, and scores of arriving
submissions against static documents and targets, appended as versions.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from ..functions.numbering import numbered
from ..operators import match as M
from ..operators import screen as SCR

#: A batch job cuts a user's time into stretches of so many gaps, whose runs are made apart.
STRETCH = 48


def first_phrase(text: Column, phrases: list[str]) -> Column:
    """First phrase of the list (in order) that occurs in the lower-cased text, else NULL."""
    low = F.lower(text)
    out = F.lit(None).cast("string")
    for p in reversed(phrases):
        out = F.when(low.contains(p), F.lit(p)).otherwise(out)
    return out


# ------------------------------------------------------------------ debounced hints
def batch_sessions(edits: DataFrame, gap: str, user_col: str, ts_col: str, text_col: str, order: Column) -> DataFrame:
    """(user, session_start, session_end, n_events, last_text) of a batch.

    A user's edits are first merged to runs within stretches of time, so that one very active user is split over tasks;
    then the runs, of which a stretch has ``STRETCH`` at most, are merged over the stretches' borders."""
    wait = F.expr(f"INTERVAL {gap}")
    width = F.unix_micros(F.timestamp_seconds(F.lit(0)) + wait) * STRETCH
    e = edits.where(F.col(ts_col).isNotNull()).select(F.col(user_col).alias("_u"), F.col(ts_col).alias("_ts"), order.alias("_o"),
                                                     F.col(text_col).alias("_text"))
    e = e.withColumn("_cut", F.floor(F.unix_micros(F.col("_ts").cast("timestamp")) / width))

    def merged(d, by, start, last):
        w = Window.partitionBy(*by).orderBy(start)
        fresh = F.coalesce((F.col(start) >= F.lag(last).over(w) + wait).cast("int"), F.lit(1))
        return d.withColumn("_new", fresh).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))

    runs = merged(e, ["_u", "_cut"], "_ts", "_ts").groupBy("_u", "_cut", "_run").agg(
        F.min("_ts").alias("_start"), F.max("_ts").alias("_last"), F.count(F.lit(1)).alias("_n"), F.max(F.struct("_o", "_text")).alias("_best"))
    return merged(runs, ["_u"], "_start", "_last").groupBy("_u", "_run").agg(
        F.min("_start").alias("session_start"), (F.max("_last") + wait).alias("session_end"), F.sum("_n").alias("n_events"),
        F.max("_best")["_text"].alias("last_text")).select(F.col("_u").alias(user_col), "session_start", "session_end", "n_events", "last_text")


def debounced_lint(edits: DataFrame, gap: str, phrases: list[str] = L.LIVE_HINT_PHRASES, user_col: str = "user_id",
                   ts_col: str = "ts", text_col: str = "text", id_col: str | None = None,
                   watermark: str | None = None) -> DataFrame:
    """Latest text per user and quiet period (a session closes after ``gap`` without input) and the hint for its first
    weak phrase.

    On a stream the sessions are kept as state until the watermark passes their end, then appended once; a row that
    comes late but before that joins or bridges sessions, one that comes later is dropped. ``watermark`` is required
    there. Edits without a time are ignored; of equal times the greater id counts as later, without ids the greater
    text. Null users are one user."""
    order = F.struct(F.col(ts_col), F.col(id_col)) if id_col else F.struct(F.col(ts_col), F.col(text_col))
    if edits.isStreaming:
        if not watermark:
            raise ValueError("a stream of edits needs a watermark, or its sessions never close")
        found = edits.withWatermark(ts_col, watermark).groupBy(F.col(user_col), F.session_window(F.col(ts_col), gap).alias("session")).agg(
            F.count(F.lit(1)).alias("n_events"), F.max_by(F.col(text_col), order).alias("last_text"))
        found = found.select(user_col, F.col("session.start").alias("session_start"), F.col("session.end").alias("session_end"), "n_events", "last_text")
    else:
        found = batch_sessions(edits, gap, user_col, ts_col, text_col, order)
    hint = first_phrase(F.col("last_text"), phrases)
    return found.select(
        user_col, "session_start", "session_end", "n_events", "last_text", hint.alias("phrase"),
        F.when(hint.isNotNull(), F.replace(F.lit(L.LIVE_HINT_MESSAGE), F.lit("{phrase}"), hint)).alias("hint"))


def lint_stream(edits: DataFrame, base: str, gap: str, watermark: str, **kw) -> DataFrame:
    """Run the stream over what is there (``availableNow``) and return all sessions closed so far. ``base`` holds the
    table and the state, so the next call goes on where this one stopped."""
    out = debounced_lint(edits, gap, watermark=watermark, **kw)
    q = (out.writeStream.format("parquet").option("path", f"{base}/sessions").option("checkpointLocation", f"{base}/_checkpoint")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return edits.sparkSession.read.schema(out.schema).parquet(f"{base}/sessions")


# ------------------------------------------------------------------ scoring of submissions
VERSION_ROW = ("session_id string, version_id bigint, event_id bigint, ts timestamp, doc_id bigint, target_id bigint, ats_score int, "
               "verdict string, density_percent double, n_parse_issues int")


def score_submissions(submissions: DataFrame, docs: DataFrame, targets: DataFrame, pairs: DataFrame, text_col: str = "text") -> DataFrame:
    """Each submission (session_id, event_id, ts, doc_id) with the screening of its document against each of the
    document's assigned targets. A document is screened once, however often it is submitted; a submission of an unknown
    document has no row."""
    wanted = submissions.select("doc_id").distinct()
    d = docs.select("doc_id", text_col).join(wanted, "doc_id", "left_semi")
    dens = M.assigned_density(d, targets, pairs.join(wanted, "doc_id", "left_semi"), text_col).select(
        "doc_id", "target_id", "density_percent", "top_missing_list")
    scored = SCR.screen(d, text_col, dens).select("doc_id", "target_id", "ats_score", "verdict", "density_percent", F.size("parse_issues").alias("n_parse_issues"))
    return submissions.select("session_id", "event_id", "ts", "doc_id").join(scored, "doc_id")


def with_version_ids(scored: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """Consecutive ids per session by time, event and target, after the session's last one in ``heads``."""
    v = numbered(scored, ["session_id"], [F.col("ts"), F.col("event_id"), F.col("target_id")], "_place")
    last = F.lit(0)
    if heads is not None:
        v = v.join(heads.groupBy("session_id").agg(F.max("version_id").alias("_last")), "session_id", "left")
        last = F.coalesce("_last", F.lit(0))
    return v.select("session_id", (last + F.col("_place")).cast("long").alias("version_id"), "event_id", "ts", "doc_id", "target_id", "ats_score",
                    "verdict", "density_percent", "n_parse_issues")


def read_versions(spark: SparkSession, table: str) -> DataFrame:
    """All versions written so far, none before the first batch."""
    try:
        return spark.read.schema(VERSION_ROW + ", batch_id bigint").parquet(table)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], VERSION_ROW + ", batch_id bigint")


def append_batch(batch: DataFrame, batch_id: int, table: str, docs: DataFrame, targets: DataFrame, pairs: DataFrame, text_col: str = "text") -> None:
    """Score one micro-batch and write its versions as the table's partition ``batch_id``.

    Ids go on from what the batches before it have written, so a late submission gets the next id and renumbers
    nothing; a replayed batch finds the same heads and overwrites its own partition with the same rows."""
    spark = batch.sparkSession
    before = read_versions(spark, table).where(F.col("batch_id") < batch_id).select("session_id", "version_id")
    out = with_version_ids(score_submissions(batch, docs, targets, pairs, text_col), before).withColumn("batch_id", F.lit(batch_id).cast("long"))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(table)


def stream_score(submissions: DataFrame, base: str, docs: DataFrame, targets: DataFrame, pairs: DataFrame, watermark: str,
                 text_col: str = "text") -> DataFrame:
    """Score a stream of submissions against static documents and targets and return the versions written so far.

    A repeated delivery of an event is dropped while the watermark has not passed it; a row later than the watermark is
    dropped too, so the state of event ids stays bounded. Runs over what is there (``availableNow``); ``base`` holds
    the table and the state."""
    spark = submissions.sparkSession
    table = f"{base}/versions"
    stream = submissions.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["session_id", "event_id"])

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            append_batch(batch, batch_id, table, docs, targets, pairs, text_col)
        finally:
            batch.unpersist()

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/_checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return read_versions(spark, table)
