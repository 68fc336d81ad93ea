"""Sources, cleaning and admission of documents and targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dims
from ..functions import lexicons as L
from ..functions import text as T

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver tables; Catalyst prunes columns and pushes filters into the scan."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: An input of fewer splits than cores is dealt to all cores, if its splits are at most so many.
FEW_SPLITS = 64


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as there are cores, if it is a small table of fewer splits (one row group, say): its
    per-row work would else run in a few tasks. A table with enough splits, or a large one, is left as it is."""
    cores, splits = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    return df.repartition(cores) if splits < min(cores, FEW_SPLITS) else df


#: One valid UTF-8 sequence, with every byte written as the character of the same number.
UTF8_SEQUENCE = ("[\\x00-\\x7F]|[\\xC2-\\xDF][\\x80-\\xBF]|\\xE0[\\xA0-\\xBF][\\x80-\\xBF]|[\\xE1-\\xEC\\xEE\\xEF][\\x80-\\xBF]{2}"
                 "|\\xED[\\x80-\\x9F][\\x80-\\xBF]|\\xF0[\\x90-\\xBF][\\x80-\\xBF]{2}|[\\xF1-\\xF3][\\x80-\\xBF]{3}|\\xF4[\\x80-\\x8F][\\x80-\\xBF]{2}")
#: Endings whose bytes are text; other allowed endings need a decoder of their own.
TEXT_EXTENSIONS = ("txt",)


def decode_utf8(content: Column) -> Column:
    """The text of UTF-8 bytes; bytes that belong to no valid sequence are dropped, a real U+FFFD stays.

    Valid content, the common case, is decoded as it is; the pattern runs on the rest alone, a sequence at a time."""
    as_chars = F.decode(content, "ISO-8859-1")
    valid = F.encode(F.regexp_replace(as_chars, f"({UTF8_SEQUENCE})|[\\x80-\\xFF]", "$1"), "ISO-8859-1")
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(valid.cast("string"))


def read_files(spark: SparkSession, path: str, extensions=tuple(L.ALLOWED_EXTENSIONS),
               max_bytes: int = L.MAX_UPLOAD_BYTES) -> DataFrame:
    """A directory of files as (path, doc_id, n_bytes, reason, text), one row for every file, also a refused one
    (but for files of zero bytes, which Spark's file source doesn't list).

    reason is "ok", "type" (ending after the last dot, in any case, not allowed, or none), "too_large" (over
    ``max_bytes``) or "no_decoder" (allowed, but not a text file: its bytes aren't taken for text). text is null unless
    ok. The listing's length decides, so the bytes of files that are too large are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    ext = F.lower(F.regexp_extract(F.col("path"), r"\.([^./]*)$", 1))
    reason = (F.when(~ext.isin(*extensions), "type").when(F.col("length") > max_bytes, "too_large")
              .when(~ext.isin(*TEXT_EXTENSIONS), "no_decoder").otherwise("ok"))
    cols = ["path", F.xxhash64("path").alias("doc_id"), F.col("length").alias("n_bytes"), reason.alias("reason")]
    ok = files.where((F.col("length") <= max_bytes) & (reason == "ok")).select(*cols, decode_utf8(F.col("content")).alias("text"))
    return ok.unionByName(files.where(reason != "ok").select(*cols, F.lit(None).cast("string").alias("text")))


def read_corpus(spark: SparkSession, path: str, extensions=tuple(L.ALLOWED_EXTENSIONS),
                max_bytes: int = L.MAX_UPLOAD_BYTES) -> DataFrame:
    """The text files of a directory that are accepted, as (path, doc_id, text, n_bytes); ``read_files`` also has the
    others, with the reason."""
    return read_files(spark, path, extensions, max_bytes).where("reason = 'ok'").select("path", "doc_id", "text", "n_bytes")


def clean_text(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Per document: cleaned text plus what cleaning changed (row-local, no shuffle)."""
    clean = T.clean_text(text_col)
    return docs.select(
        "doc_id",
        "source",
        clean.alias("clean_text"),
        T.replaced_chars(text_col).alias("replaced_chars"),
        (clean != F.coalesce(F.col(text_col), F.lit(""))).alias("changed"),
    )


def admission_reason(text_col: str = "text") -> Column:
    n = F.length(T.py_strip(F.coalesce(F.col(text_col), F.lit(""))))
    return (F.when(n == 0, F.lit("empty"))
            .when(n < L.MIN_DOCUMENT_CHARS, F.lit("too_short"))
            .otherwise(F.lit("ok")))


def admit_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Documents that pass the length gate (stripped length >= 50)."""
    return docs.where(admission_reason(text_col) == "ok")


def admission_counts(docs: DataFrame, text_col: str = "text", by: str = "source") -> DataFrame:
    return docs.groupBy(by, admission_reason(text_col).alias("reason")).agg(F.count(F.lit(1)).alias("n_docs"))


def resolve_targets(choices: DataFrame, targets: DataFrame, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The assignment of documents to targets, and the texts of all targets that it names.

    ``choices`` has doc_id, target_id (a given text of ``targets``, or null) and role (a picked role name, or null). A
    choice means the target's trimmed text if there is one that isn't blank, else the role, whose name is then the whole
    target text, else no target. First result: (doc_id, target_id, target_kind), each pair once; a document's choices
    that come to nothing are one row with a null target_id and the kind "none", so every document of ``choices`` stays.
    Roles of the known list have the ids -1, -2, ... in its order, any other role a negative id of its text's hash.
    Second result: (target_id, text, target_kind) of the texts and the roles that are chosen.

    One equi-join of ids with the targets; texts don't move with the choices.
    """
    texts = targets.select("target_id", T.py_strip("text").alias("text")).where("text != '' and target_id is not null")
    known = dims.roles(spark).select(F.col("role").alias("_name"), (-F.col("role_id") - 1).cast("long").alias("_role_id"))
    c = choices.select("doc_id", F.col("target_id").cast("long").alias("target_id"), F.nullif(T.py_strip("role"), F.lit("")).alias("_role"))
    c = c.join(texts.select("target_id", F.lit(True).alias("_given")), "target_id", "left").join(known, F.col("_role") == F.col("_name"), "left")
    other = -F.pmod(F.xxhash64("_role"), F.lit(1 << 62)) - len(L.ROLE_NAMES) - 1
    role_id = F.coalesce("_role_id", F.when(F.col("_role").isNotNull(), other))
    given = F.coalesce("_given", F.lit(False))
    kind = F.when(given, "text").when(role_id.isNotNull(), "role").otherwise("none")
    c = c.select("doc_id", F.when(given, F.col("target_id")).otherwise(role_id).alias("target_id"), kind.alias("target_kind"), "_role")
    roles = c.where("target_kind = 'role'").select("target_id", F.col("_role").alias("text"), "target_kind").distinct()
    return (c.select("doc_id", "target_id", "target_kind").distinct(),
            texts.select("target_id", "text", F.lit("text").alias("target_kind")).unionByName(roles))


def every_pair(pairs: DataFrame, docs: DataFrame, texts: DataFrame) -> DataFrame:
    """Every document with every target text, once, and from the assignment ``pairs`` what else was chosen for a
    document (a role, or nothing). Only ids are crossed."""
    given = texts.where("target_kind = 'text'").select("target_id").distinct()
    every = docs.select("doc_id").distinct().crossJoin(given).select("doc_id", "target_id", F.lit("text").alias("target_kind"))
    return every.unionByName(pairs.where("target_kind != 'text'"))


REPO_PAYLOAD_SCHEMA = ("name string, full_name string, description string, language string, html_url string, "
                       "stargazers_count bigint, forks_count bigint, topics array<string>")


def repo_payload_scan(payloads: DataFrame, json_col: str = "payload", schema: str = REPO_PAYLOAD_SCHEMA) -> DataFrame:
    """Parse JSON repository payloads with an explicit schema; missing string -> '', count -> 0."""
    p = F.from_json(F.col(json_col), schema)
    out = payloads.withColumn("_p", p)
    cols = []
    for field in schema.split(","):
        name, typ = field.strip().split(" ", 1)
        c = F.col(f"_p.{name}")
        if typ == "string":
            c = F.coalesce(c, F.lit(""))
        elif typ == "bigint":
            c = F.coalesce(c, F.lit(0).cast("bigint"))
        elif typ.startswith("array"):
            c = F.coalesce(c, F.array().cast(typ))
        cols.append(c.alias(name))
    return out.select(*[c for c in payloads.columns if c != json_col], *cols)
