"""Mixing sources to target weights by a low-discrepancy source schedule; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, packed, text_of, unpacked

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of one window when offsets are summed up, on average.
ROWS = 20_000
#: Parts of the line of cumulative weights by which points find their source.
BINS = 1 << 14
#: Sources up to this number are broadcast (a few numbers each); more are joined by a shuffle.
FEW_SOURCES = 20_000


def sizes(docs: DataFrame, seed: int = 7) -> DataFrame:
    """(doc_id, source, size, place): size in words, place the document's shuffled place as a hex string."""
    place = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(str(seed))))
    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"),
                       F.regexp_count(text_of(docs), F.lit(WORD)).cast("long").alias("size"), place.alias("place"))


def source_targets(sized: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per source: source, sid (0.. by code point, null last), source_size, target.

    Weights repeat over the sources in order; targets share ``share`` of all sizes by weight and stop at ``most`` times
    the source's size, the excess reshared by weight. That is target = min(cap, weight * level), and the level
    comes from running sums over the sources in the order in which they reach their cap. Rows here are sources.
    """
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    s = s.withColumn("sid", F.row_number().over(by_name) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    reach = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
    s = s.withColumn("full", F.coalesce(F.sum("cap").over(reach.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("left", F.sum("weight").over(reach.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("level", (F.col("total") - F.col("full")) / F.col("left"))
    first = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("sid"), F.col("level").alias("level")))
    s = s.withColumn("level", F.min(first).over(everything)["level"])
    return s.select("source", "sid", "source_size", "n_docs", F.least("cap", F.coalesce(F.col("weight") * F.col("level"), F.col("cap"))).alias("target"))


def schedule(targets: DataFrame, block_words: int = 1024) -> DataFrame:
    """The mix in order: (slot, sid, rank): slot by slot the source that gives its next block, rank counted per source.

    Slot n has the n-th van der Corput point (its binary digits reversed), which falls into one source's part of the
    cumulative targets, so every stretch of slots holds the sources in proportion. Ranks are counted in chunks of
    slots whose counts per source are summed up first, so no task ranks a whole source. A source stops at
    ceil(target / block_words) blocks; the few blocks that the points leave out at the end close the schedule.
    """
    spark = targets.sparkSession
    t = targets.select("sid", "target", F.ceil(F.floor("target") / block_words).alias("blocks"))
    total = t.agg(F.sum("blocks").alias("n"), F.sum("target").alias("all")).first()
    n, words = int(total["n"] or 0), float(total["all"] or 0)
    line = Window.orderBy("sid")
    part = t.withColumn("high", F.sum("target").over(line) / F.lit(words or 1.0))
    part = part.withColumn("low", F.coalesce(F.lag("high").over(line), F.lit(0.0)))
    digits = max(1, n.bit_length())
    slots = spark.range(n).withColumnRenamed("id", "slot")
    back = F.conv(F.reverse(F.lpad(F.bin("slot"), digits, "0")), 2, 10).cast("long")
    slots = slots.select("slot", (back / F.lit(float(1 << digits))).alias("point"), F.floor(F.col("slot") / ROWS).alias("chunk"))
    # each source is listed in the bins of the line that it touches, so points meet it by an equi-join on the bin
    touched = F.sequence(F.floor(F.col("low") * BINS), F.floor(F.col("high") * BINS))
    listed = part.where("high > low").select("sid", "low", "high", F.explode(touched).alias("bin"))
    slots = slots.withColumn("bin", F.floor(F.col("point") * BINS)).join(listed, "bin").where("low <= point and point < high")
    slots = slots.select("slot", "sid", "chunk")
    inside = Window.partitionBy("sid", "chunk").orderBy("slot")
    counts = slots.groupBy("sid", "chunk").agg(F.count(F.lit(1)).alias("c"))
    before = counts.select("sid", "chunk", (F.sum("c").over(Window.partitionBy("sid").orderBy("chunk")) - F.col("c")).alias("before"))
    ranked = slots.join(before, ["sid", "chunk"]).withColumn("rank", F.col("before") + F.row_number().over(inside) - 1)
    ranked = ranked.join(part.select("sid", "blocks"), "sid").where("rank < blocks").select("slot", "sid", "rank")
    had = counts.groupBy("sid").agg(F.sum("c").alias("had"))
    rest = part.join(had, "sid", "left").withColumn("had", F.coalesce("had", F.lit(0))).where("had < blocks")
    rest = rest.withColumn("rank", F.explode(F.sequence(F.col("had"), F.col("blocks") - 1)))
    return ranked.union(rest.select((F.lit(n) + F.col("rank")).alias("slot"), "sid", "rank"))


def offsets(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """``sized`` with its source's columns and ``off``, the words that precede it in its source's shuffled order.

    The order is cut by ranges of the place into windows of about ROWS rows, whose sums are added up first, so a source
    that holds a third of all rows is still summed in many tasks.
    """
    counted = targets.agg(F.count(F.lit(1)), F.sum("n_docs")).first()
    side = F.broadcast(targets) if counted[0] <= FEW_SOURCES else targets
    d = sized.alias("d").join(side.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
    d = d.select("doc_id", "d.source", "size", "place", "sid", "source_size", "target")
    ranges = min(1 << 24, 1 + (counted[1] or 0) // ROWS)
    start = F.conv(F.substring("place", 1, 6), 16, 10).cast("long")
    d = d.withColumn("range", F.floor(start * ranges / (1 << 24)))
    sums = d.groupBy("sid", "range").agg(F.sum("size").alias("s"))
    before = sums.select("sid", "range", (F.sum("s").over(Window.partitionBy("sid").orderBy("range")) - F.col("s")).alias("before"))
    run = Window.partitionBy("sid", "range").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    return d.join(before, ["sid", "range"]).withColumn("off", F.col("before") + F.sum("size").over(run) - F.col("size")).drop("before", "range")


def mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: int = 2, block_words: int = 1024, seed: int = 7) -> DataFrame:
    """One row per document: doc_id, size, source_size, target (its source's), taken (words that the mix takes).

    Each source's documents are shuffled by a hash and laid end to end, ``most`` times over, and the line is cut
    into blocks of block_words words. Each slot of the schedule takes its source's next block, the last one cut
    to what is left of the target; a document's taken words are the overlaps of its places with the taken blocks. So a source gives its target rounded
    down and no document more than ``most`` times its size. Only (id, numbers) rows move, never texts; reruns agree.

    Null text has size 0, and a document of size 0 is never taken. A null source is a source of its own, a null
    doc_id an ordinary document. Repeated rows are documents of their own. No rows give no rows; other columns
    are ignored.
    """
    sized = cut(sizes(docs, seed))
    targets = cut(source_targets(sized, weights, share, most))
    placed = cut(offsets(sized, targets))
    slots = schedule(targets, block_words)
    passes = placed.where("size > 0").withColumn("pass", F.explode(F.array(*[F.lit(i) for i in range(most)])))
    passes = passes.withColumn("a", F.col("pass") * F.col("source_size") + F.col("off")).withColumn("b", F.col("a") + F.col("size"))
    passes = passes.withColumn("end", F.least("b", F.floor("target"))).where("a < end")
    pieces = passes.withColumn("rank", F.explode(F.sequence(F.floor(F.col("a") / block_words), F.floor((F.col("end") - 1) / block_words))))
    used = pieces.join(slots, ["sid", "rank"])
    words = F.least("end", (F.col("rank") + 1) * block_words) - F.greatest("a", F.col("rank") * block_words)
    taken = used.groupBy("sid", "off").agg(F.sum(words).alias("words"))
    out = placed.withColumn("at", F.when(F.col("size") > 0, F.col("off"))).join(taken.withColumnRenamed("off", "at"), ["sid", "at"], "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("words", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them: taken / size, rounded, with all their columns, whatever their
    names. A document cut at its source's target counts as taken if half of it is. Rows that agree in id and size share
    the average of what the mix takes of them."""
    def key(c):
        return F.coalesce(c.cast("string"), F.lit("null"))

    m = mix(docs, **options).where("size > 0").groupBy(key(F.col("doc_id")).alias("key"), "size")
    m = m.agg(F.round(F.avg(F.col("taken") / F.col("size"))).cast("int").alias("times")).where("times > 0")
    rows = packed(docs, key=key(docs["doc_id"]), size=F.regexp_count(text_of(docs), F.lit(WORD)).cast("long")).join(m, ["key", "size"])
    return unpacked(rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))))


#: op7 as SQL. The shuffled order is that of md5, so offsets and overlaps can be written as windows.
MIX_SQL = """
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as size,
         md5(coalesce(cast(doc_id as varchar), '') || ':7') as place
  from documents),
src as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source is null, source) - 1 as sid
  from sized group by source),
w as (
  select *, [5.0::double, 2.0::double, 1.0::double][(sid % 3 + 1)::int] as weight, source_size * 2.0::double as cap,
         (select sum(source_size) from src) * 1.5::double as total from src),
lev as (
  select *, (total - coalesce(sum(cap) over (order by cap / weight, sid rows between unbounded preceding and 1 preceding), 0.0::double))
            / sum(weight) over (order by cap / weight, sid rows between current row and unbounded following) as level from w),
tgt as (
  select source, source_size,
         least(cap, weight * (select level from lev where level * weight <= cap order by cap / weight, sid limit 1)) as target from lev),
placed as (
  select d.doc_id, d.size, t.source_size, t.target,
         sum(d.size) over (partition by d.source order by place, doc_id, size rows between unbounded preceding and current row) - d.size as off
  from sized d join tgt t on d.source is not distinct from t.source)
select doc_id, size::bigint as size, source_size, target,
       (greatest(0, least(off + size, floor(target)) - off)
        + greatest(0, least(source_size + off + size, floor(target)) - (source_size + off)))::bigint as taken
from placed
"""
