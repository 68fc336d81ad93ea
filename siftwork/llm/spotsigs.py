"""Document fingerprints by SpotSigs: chains of content words behind common words."""

from __future__ import annotations

import hashlib

import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, text_of

# The common words that anchor a chain, for English, German, French and Spanish.
ANCHORS = frozenset("""
the of and to in a is that it for was on be with as by this at are from an or
der die das und den von zu mit sich des auf für ist im nicht dem ein eine als
de la le et les en un du une que est pour qui dans au sur par pas avec
el y los se del las por con no una para su es al lo
""".split())
EDGES = ".,;:!?\"'()[]{}<>|&*#«»„“”¿¡-_/\\"


def signatures(text: str, chain: int = 2) -> list[str]:
    """The sorted distinct signatures, 8 hex digits each: a common word and the next ``chain`` content words.
    A text without any has one signature of all its words (none at all: of the empty text)."""
    out, ahead = set(), [""] * chain
    strip, anchors, digest = str.strip, ANCHORS, xxhash.xxh32_hexdigest
    words = text.lower().split()
    for w in reversed(words):
        w = strip(w, EDGES)
        if w in anchors:
            if ahead[-1]:
                out.add((w, *ahead))
        elif w:
            ahead = [w, *ahead[:-1]]
    if not out:
        return [digest(" ".join(words).encode("utf-8", "replace"))]
    return sorted({digest("\x00".join(s).encode("utf-8", "replace")) for s in out})


def likeness(a: list[str], b: list[str]) -> float:
    """Jaccard similarity of two signature lists."""
    x, y = set(a), set(b)
    both = len(x & y)
    return both / (len(x) + len(y) - both)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint): the signatures joined by spaces, one pass, no shuffle. Null counts as empty; repeated
    rows give repeated results; other columns are ignored."""
    def run(batches):
        for b in batches:
            fps = [" ".join(signatures(x.as_buffer().to_pybytes().decode("utf-8", "replace"))) for x in b.column("t").cast(pa.binary())]
            yield pa.record_batch([b.column("doc_id"), pa.array(fps, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), text_of(docs).alias("t")).mapInArrow(run, "doc_id long, fingerprint string")


def near_pairs(docs: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Near duplicates: (members, pairs). members: doc_id, class_id, the smallest doc_id of equal fingerprint; pairs:
    a, b (class ids, a < b) and likeness >= threshold.

    Classes are partitioned by set length: only lengths within the threshold's ratio can match. A set's rarest
    signatures, len - ceil(threshold * len) + 1 of them, meet by an equi-join with the sets of the same and of the
    neighbouring length partitions, which no match can avoid; Jaccard is checked on the whole sets. Common signatures
    are never among the rarest of a set unless it has no others, and skewed keys of the join are split.
    """
    import math

    own = cut(fingerprints(docs))
    classes = own.groupBy("fingerprint").agg(F.min("doc_id").alias("class_id"))
    members = own.join(classes, "fingerprint").select("doc_id", "class_id")
    sets = classes.select("class_id", F.split("fingerprint", " ").alias("sigs")).withColumn("n", F.size("sigs"))
    # lengths of one partition lie within the ratio, so matches lie in the same or in the next partition
    sets = sets.withColumn("part", F.floor(F.log("n") / F.lit(-math.log(threshold)))) if threshold < 1 else sets.withColumn("part", F.col("n"))
    sets = cut(sets)
    rows = sets.select("class_id", "n", "part", F.explode("sigs").alias("sig"))
    often = rows.groupBy("sig").agg(F.count(F.lit(1)).alias("df"))
    rows = rows.join(often, "sig")
    rank = F.row_number().over(Window.partitionBy("class_id").orderBy("df", "sig"))
    rows = rows.withColumn("rank", rank).where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1)
    left = rows.select(F.col("sig"), F.explode(F.array("part", F.col("part") + 1)).alias("part"), F.col("class_id").alias("a"), F.col("n").alias("na"))
    right = rows.select("sig", "part", F.col("class_id").alias("b"), F.col("n").alias("nb"))
    fits = (F.col("a") != F.col("b")) & (F.least("na", "nb") >= F.greatest("na", "nb") * threshold - 1e-9)
    found = left.join(right, ["sig", "part"]).where(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    found = found.join(sets.select(F.col("class_id").alias("a"), F.col("sigs").alias("sa")), "a")
    found = found.join(sets.select(F.col("class_id").alias("b"), F.col("sigs").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    pairs = found.withColumn("likeness", both / (F.size("sa") + F.size("sb") - both))
    return members, pairs.where(F.col("likeness") >= threshold).select("a", "b", "likeness")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document's text in descending doc_id, after the last one the first document's. near_edited and near_next are the
    likenesses of the fingerprint to the edited text's and to the next document's.

    Texts move once: rows are dealt out by ranges of doc_id, whose bounds are quantiles, and every range also gets
    the first row of the range that follows. A task then reads its rows in order and holds two texts.

    Null text is empty; null ids come last, equal ids in the order of their texts' digests. A single document follows
    itself. No rows give none; other columns are ignored.
    """
    spark = docs.sparkSession
    schema = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")
    d = docs.select(F.col("doc_id").cast("long"), text_of(docs).alias("t"))
    want = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = d.agg(F.percentile_approx("doc_id", [i / want for i in range(1, want)], 20 * want)).first()[0] or []
    splits = [float("-inf"), *sorted({0.0, *map(float, cuts)}), float("inf")]
    ids = d.withColumn("key", F.coalesce(F.col("doc_id").cast("double"), F.lit(float("nan"))))
    part = Bucketizer(splits=splits, inputCol="key", outputCol="part", handleInvalid="keep")
    # parts count downwards, null ids (the extra bucket) last
    extra = len(splits) - 1
    d = part.transform(ids).withColumn("part", F.when(F.col("part") == extra, extra + 1).otherwise(extra - F.col("part")).cast("int")).drop("key")
    tie = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(1)
    # the first row of each part, a part at a time: the greatest id, then the smallest digest of the text
    top = d.groupBy("part").agg(F.max("doc_id").alias("top"))
    held = [r["part"] for r in top.select("part").orderBy("part").collect()]  # as many as parts
    if not held:
        return spark.createDataFrame([], schema)
    follows = dict(zip(held, [*held[1:], held[0]]))
    before = spark.createDataFrame([(b, a) for a, b in follows.items()], "part int, goes_to int")
    tops = F.broadcast(top.join(before, "part").withColumnRenamed("part", "p"))  # one row of numbers a part
    heads = d.join(tops, (d["part"] == tops["p"]) & d["doc_id"].eqNullSafe(tops["top"]))
    heads = heads.withColumn("n", F.row_number().over(Window.partitionBy("part").orderBy(F.md5("t")))).where("n = 1")
    rows = d.select("part", F.lit(0).alias("head"), tie.alias("has_id"), "doc_id", F.md5("t").alias("tie"), "t")
    rows = rows.union(heads.select("goes_to", F.lit(1), F.lit(0), "doc_id", F.lit(""), "t"))
    order = ["part", "head", F.desc("has_id"), F.desc("doc_id"), "tie"]

    def run(batches):
        prev = None
        names = [f.strip().split(" ")[0] for f in schema.split(",")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        for big in batches:
            for at in range(0, big.num_rows, 500):
                b, out = big.slice(at, 500), []
                rows = zip(b.column("part").to_pylist(), b.column("head").to_pylist(), b.column("doc_id").to_pylist(), b.column("t").cast(pa.binary()))
                for part, head, doc_id, x in rows:
                    text = x.as_buffer().to_pybytes().decode("utf-8", "replace")
                    now = (doc_id, text, signatures(text))
                    if prev is not None:
                        n = len(prev[1])
                        edited = prev[1][:n - n // 2] + text[:n // 2]
                        sigs = signatures(edited)
                        out.append((prev[0], n, hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(), " ".join(prev[2]), " ".join(sigs),
                                    likeness(prev[2], sigs), likeness(prev[2], now[2])))
                    prev = None if head else now
                yield pa.record_batch([pa.array(list(c), k) for c, k in zip(list(zip(*out)) or [[]] * 7, kinds)], names=names)

    return rows.repartition("part").sortWithinPartitions(*order).mapInArrow(run, schema)
