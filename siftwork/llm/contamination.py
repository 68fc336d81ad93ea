"""Benchmark decontamination by a distributed positional inverted index; DataFrame functions only."""

from __future__ import annotations

import string
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .common import cut, fixed, text_of

#: What separates words once A-Z are lower-cased: all of ASCII but digits and letters.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a block of a document's text, which is what a candidate is compared with.
BLOCK = 256
#: A table up to so many rows and characters is broadcast; a larger one is joined by a shuffle.
FEW_ROWS, FEW_CHARS = 1_000_000, 64 << 20
#: Stands for the length of a document among its postings; no word holds a space.
LENGTH = " "


def words_of(text):
    """Lower-cased (A-Z only) words."""
    plain = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(plain, SEPARATOR), "")


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, text): the keys are 128 bits of the id and the text, so rows that agree in both share results."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    return d.select("doc_id", F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(12), "text", "doc_id").alias("k2"), "text")


def sized(df: DataFrame, chars: str | None = None) -> DataFrame:
    """``df``, materialised, marked for broadcast if its rows and the characters of a column are few."""
    df = cut(df)
    n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(chars)), F.lit(0)) if chars else F.lit(0)).first()
    return F.broadcast(df) if n <= FEW_ROWS and size <= FEW_CHARS else df


def windows_of(items: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """(wid, phrase, len) of the distinct windows, and (wid, item_id); fewer words than a window are one window."""
    w = fixed(items.select(F.col("item_id").cast("long").alias("item_id"), text_of(items).alias("text")), "w", words_of(F.col("text")))
    w = w.where(F.size("w") > 0).select("item_id", "w")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    w = w.select("item_id", "w", F.explode(starts).alias("i")).select("item_id", F.slice("w", F.col("i"), F.lit(window)).alias("part"))
    w = w.select("item_id", F.array_join("part", " ").alias("phrase"), F.size("part").alias("len")).distinct()
    wins = cut(w.select("phrase", "len").distinct().withColumn("wid", F.monotonically_increasing_id()))
    return wins, w.join(wins.select("wid", "phrase"), "phrase").select("wid", "item_id")


def tokens(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, n, pos, and the columns of ``vocabulary``) for each word of a text that is in it; positions
    count from 1, and position 0 holds LENGTH. Words meet the vocabulary where they are read if that is broadcast."""
    d = fixed(keyed(docs), "w", words_of(F.col("text"))).drop("text")
    d = d.select("doc_id", "k1", "k2", F.size("w").alias("n"), F.posexplode(F.concat(F.array(F.lit(LENGTH)), "w")).alias("pos", "word"))
    return d.join(vocabulary, "word")


def rarest(docs: DataFrame, wins: DataFrame, anchors: int) -> DataFrame:
    """(wid, phrase, len, w1, o1, w2, o2, ...): each window's rarest words by their number in ``docs`` (ties: the word)
    with their first offset; windows with a word that no document has are left out. Missing words are null."""
    terms = wins.select("wid", F.posexplode(F.split("phrase", " ")).alias("off", "word"))
    terms = cut(terms.groupBy("wid", "word").agg(F.min("off").alias("off")))
    counts = tokens(docs, sized(terms.select("word").distinct(), "word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("wid").orderBy("n", "word")
    ranked = terms.join(counts, "word", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("rank", F.row_number().over(order))
    ranked = ranked.where(F.col("rank") <= anchors)
    cols = [f(F.when(F.col("rank") == r, F.col(c))).alias(f"{a}{r}") for r in range(1, anchors + 1) for a, c, f in (("w", "word", F.max), ("o", "off", F.max))]
    return ranked.groupBy("wid").agg(F.min("n").alias("least"), *cols).where("least > 0").drop("least").join(wins, "wid")


def postings(spark: SparkSession, docs: DataFrame, rare: DataFrame, anchors: int) -> tuple[DataFrame, DataFrame]:
    """The index, a table in the shared folder: (aid, k1, k2, pos, n, doc_id) of the words that windows are looked up
    by, and the length of every document at aid -1. Second: ``rare`` with the numbers aid of its words."""
    words = rare.select(F.explode(F.array(*[f"w{r}" for r in range(1, anchors + 1)])).alias("word")).where("word is not null").distinct()
    words = words.withColumn("aid", F.monotonically_increasing_id())
    words = sized(words.union(spark.createDataFrame([(LENGTH, -1)], "word string, aid long")), "word")
    for r in range(1, anchors + 1):
        rare = rare.join(words.select(F.col("word").alias(f"w{r}"), F.col("aid").alias(f"a{r}")), f"w{r}", "left").drop(f"w{r}")
    path = f"{checkpoint_dir(spark)}/postings-{uuid.uuid4().hex}"
    length = F.when(F.col("aid") == -1, F.col("doc_id"))
    tokens(docs, words).select("aid", "k1", "k2", "pos", "n", length.alias("doc_id")).write.parquet(path)
    return spark.read.parquet(path), sized(rare, "phrase")


def near(left: DataFrame, index: DataFrame, a: str, reach: int, out: str) -> DataFrame:
    """``left`` with every posting ``out`` of the word ``a`` that is within ``reach`` of position p1 of the same text:
    an equi-join on stretches of ``reach`` positions, each row looking into its own and its neighbours."""
    at = F.floor(F.col("p1") / reach).cast("int")
    left = left.withColumn("stretch", F.explode(F.array(at - 1, at, at + 1)))
    right = index.select(F.col("aid").alias(a), "k1", "k2", F.col("pos").alias(out), F.floor(F.col("pos") / reach).cast("int").alias("stretch"))
    return left.join(right, [a, "k1", "k2", "stretch"]).where(F.abs(F.col(out) - F.col("p1")) <= reach).drop("stretch")


def find_matches(docs: DataFrame, items: DataFrame, window: int = 10, anchors: int = 3, reach: int = 20):
    """Three tables: (k1, k2, start, len, wid) of the exact occurrences of windows of ``items`` in ``docs``; (k1, k2,
    wid) of proximity matches; (wid, item_id). And the index of the postings.

    A window's candidates are the postings of its rarest word, from which its start follows; they are intersected with
    those of its second rarest word, and what agrees at the right distance is compared with the words of the text
    itself. A window is near in a text if its ``anchors`` rarest words all stand within ``reach`` words of its rarest.
    """
    spark = docs.sparkSession
    wins, owners = windows_of(items, window)
    index, rare = postings(spark, docs, cut(rarest(docs, wins, anchors)), anchors)
    seen = index.select(F.col("aid").alias("a1"), "k1", "k2", F.col("pos").alias("p1"), "n").join(rare, "a1")
    alone = seen.where("a2 is null").withColumn("p2", F.col("p1"))
    two = near(seen.where("a2 is not null"), index.join(rare.select(F.col("a2").alias("aid")).distinct(), "aid", "left_semi"), "a2", max(reach, window), "p2")
    pairs = cut(two.select(*alone.columns).union(alone).distinct())

    start = (F.col("p1") - F.col("o1")).alias("start")
    phrases = pairs.where(F.coalesce(F.col("p2") - F.col("p1") == F.col("o2") - F.col("o1"), F.lit(True)))
    phrases = phrases.select("k1", "k2", start, "len", "phrase", "wid", "n").where("start >= 1 and start + len - 1 <= n")
    phrases = phrases.withColumn("block", F.floor((F.col("start") - 1) / BLOCK).cast("int")).drop("n").distinct()
    texts = keyed(docs).join(sized(phrases.select("k1", "k2").distinct()), ["k1", "k2"], "left_semi")
    texts = fixed(texts, "w", words_of(F.col("text"))).select("k1", "k2", "w")
    blocks = F.sequence(F.lit(0), F.floor((F.size("w") - 1) / BLOCK).cast("int"))
    texts = texts.where(F.size("w") > 0).select("k1", "k2", "w", F.explode(blocks).alias("block"))
    texts = texts.select("k1", "k2", "block", F.slice("w", F.col("block") * BLOCK + 1, F.lit(BLOCK + window)).alias("part"))
    part = F.slice("part", F.col("start") - F.col("block") * BLOCK, F.col("len"))
    exact = phrases.join(texts, ["k1", "k2", "block"]).where(F.array_join(part, " ") == F.col("phrase"))
    exact = cut(exact.select("k1", "k2", "start", "len", "wid").distinct())

    close = pairs.where(F.col("a2").isNull() | (F.abs(F.col("p2") - F.col("p1")) <= reach))
    for r in range(3, anchors + 1):
        rows, ends = close.where(F.col(f"a{r}").isNotNull()), close.where(F.col(f"a{r}").isNull())
        held = index.join(rare.select(F.col(f"a{r}").alias("aid")).distinct(), "aid", "left_semi")
        found = near(rows.select(*[c for c in close.columns if c != "p2"]).distinct(), held, f"a{r}", reach, "p2")
        close = found.select(*close.columns).union(ends).distinct()
    return exact, cut(close.select("k1", "k2", "wid").distinct()), owners, index


def covered(exact: DataFrame) -> DataFrame:
    """(k1, k2, n_hit): words inside any occurrence, each counted once."""
    spans = exact.groupBy("k1", "k2", "start").agg((F.col("start") + F.max("len")).alias("end"))
    before = Window.partitionBy("k1", "k2").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("done", F.coalesce(F.max("end").over(before), F.lit(0)))
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest("start", "done"))
    return spans.groupBy("k1", "k2").agg(F.sum(fresh).alias("n_hit"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, anchors: int = 3, reach: int = 20) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit (words inside an occurrence of a window of an item), n_items (items
    with occurring windows), items (their ids, sorted as strings), contaminated (n_hit > 0), n_near (items with a
    window whose rarest words stand near each other, exact ones included).

    A window is ``window`` consecutive words of an item; an item of fewer words is one window. Null and empty texts
    have no words, so they are clean and an item without a word has no window. Rows that repeat an id and a text each
    get the same result; rows that share only the id are judged each by its own text. Items that repeat an id count
    once; an item without an id hits words but is not counted or listed. No documents give no rows; no items leave all
    clean. Other columns are ignored.
    """
    exact, close, owners, index = find_matches(docs, items, window, anchors, reach)
    key = ["k1", "k2"]
    owners = sized(owners.where("item_id is not null").distinct())
    named = exact.select(*key, "wid").distinct().join(owners, "wid").select(*key, F.col("item_id").cast("string").alias("item")).distinct()
    named = named.groupBy(*key).agg(F.array_sort(F.collect_list("item")).alias("items"))
    nearby = close.join(owners, "wid").select(*key, "item_id").distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("n_near"))
    out = index.where("aid = -1").select("doc_id", *key, F.col("n").cast("long").alias("n_words"))
    out = out.join(covered(exact), key, "left").join(named, key, "left").join(nearby, key, "left")
    hit, near_items = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("n_near", F.lit(0)).cast("long")
    held = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", hit.alias("n_hit"), F.size(held).cast("long").alias("n_items"), held.alias("items"),
                      (hit > 0).alias("contaminated"), near_items.alias("n_near"))


def decontaminated_by_document(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """``decontaminate`` with a digest of the items instead of their list."""
    d = decontaminate(docs, items, window)
    return d.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", "n_near")


def contamination_sql(window: int = 10, anchors: int = 3, reach: int = 20) -> str:
    """The same in plain SQL: all runs of words of the documents against all windows."""
    def words(table, idc):
        low = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
        return f"select {idc}, list_filter(regexp_split_to_array({low}, '{SEPARATOR}'), lambda x: x <> '') as w from {table}"

    return f"""with d as materialized (select row_number() over () as r, * from ({words('documents', 'doc_id')})),
b as materialized ({words('benchmark', 'item_id')}),
win as materialized (select distinct item_id, array_to_string(list_slice(w, i, i + {window} - 1), ' ') as phrase, least(len(w), {window}) as n
  from (select item_id, w, unnest(range(1, greatest(len(w) - {window} + 1, 1) + 1)) as i from b where len(w) > 0)),
tok as materialized (select r, unnest(w) as word, generate_subscripts(w, 1) as pos from d),
occ as materialized (select r, i, n, item_id from (select r, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') as phrase
  from (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from win) where len(w) >= n)) join win using (phrase, n)),
hits as (select r, count(*) as n_hit from (select distinct r, unnest(range(i, i + n)) as p from (select distinct r, i, n from occ)) group by r),
its as (select r, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct r, item_id::varchar as item from occ where item_id is not null) group by r),
terms as materialized (select distinct phrase, unnest(string_split(phrase, ' ')) as word from (select distinct phrase from win)),
cnt as (select word, count(t.pos) as n from (select distinct word from terms) left join tok t using (word) group by word),
rk as materialized (select phrase, word, n, row_number() over (partition by phrase order by n, word) as k from terms join cnt using (word) qualify k <= {anchors}),
need as (select phrase, max(k) as k from rk group by phrase having min(n) > 0),
one as materialized (select phrase, r, pos from rk join need using (phrase) join tok using (word) where rk.k = 1),
prox as (select distinct phrase, r from (select o.phrase, o.r, o.pos, count(distinct rk.k) as got from one o join rk using (phrase)
  join tok t on t.word = rk.word and t.r = o.r and abs(t.pos - o.pos) <= {reach} group by all) p join need using (phrase) where got = need.k),
nr as (select r, count(distinct item_id) as n_near from prox join win using (phrase) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256,
coalesce(n_hit, 0) > 0 as contaminated, coalesce(n_near, 0) as n_near
from d left join hits using (r) left join its using (r) left join nr using (r)"""
