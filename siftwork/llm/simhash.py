"""SimHash near-dedup with pigeonring filtering."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import re
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, cut, forget_worker_caches, packed, text_of, unpacked

_SPACES = re.compile(rb"[\x20\x09-\x0D]+")
#: Rows of one candidate bucket that a task compares at once; larger buckets are dealt out as pairs of such blocks.
BLOCK = 2048


def squeeze(text: bytes) -> bytes:
    """Words joined by one space; long texts without a list of their words."""
    if len(text) < 1 << 23:
        return b" ".join(text.split())
    return _SPACES.sub(b" ", text).strip(b" ")


def shingle_bits(text: bytes, n: int, seed: int = 42, step: int = 1 << 14) -> int:
    """The 64-bit SimHash of a text's n-word shingles, repeats included (bytes.lower() touches A-Z only)."""
    buf = squeeze(text.lower())
    if not buf:
        return 0
    gaps = np.flatnonzero(np.frombuffer(buf, np.uint8) == 32)
    starts, ends = np.append(0, gaps + 1), np.append(gaps, len(buf))
    m = max(1, len(starts) - n + 1)
    starts, ends = starts[:m], ends[-m:]
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, m, step):
        hs = np.array([digest(buf[s:e], seed) for s, e in zip(starts[i:i + step].tolist(), ends[i:i + step].tolist())],
                      np.uint64)
        ones += np.unpackbits(hs.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > m, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle_words: int = 4, **others) -> DataFrame:
    """(doc_id, fp, and the long columns ``others``): one pass over the texts, no shuffle; fp is the 64 bits as a signed
    long."""
    names = ["doc_id", "fp", *others]

    def run(batches):
        forget_worker_caches()
        for b in batches:
            fps = np.array([shingle_bits(t.as_buffer().to_pybytes(), shingle_words)
                            for t in b.column("t").cast(pa.binary())], np.uint64)
            yield pa.record_batch([b.column("doc_id"), pa.array(fps.view(np.int64)), *[b.column(c) for c in names[2:]]], names=names)

    d = docs.select(F.col("doc_id").cast("long"), *[c.alias(n) for n, c in others.items()], text_of(docs).alias("t"))
    return d.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def row_keys(docs: DataFrame) -> tuple:
    i, t = docs["doc_id"].cast("long"), text_of(docs)
    return F.xxhash64(i, t), F.xxhash64(F.lit(2), t, i)


def ring(bits: int, max_distance: int) -> list[tuple[int, int, list[int]]]:
    """Slots of the ring: (mask of the key, masks of the longer chains).

    64 bits are cut into m = max_distance + 1 segments on a ring. If two fingerprints differ in at most max_distance
    bits, then from some segment on every chain of l consecutive segments differs in at most
    l * max_distance / m, that is l - 1, bits. So one segment agrees and the next differs in at most one bit:
    the key is both segments with one bit of the second left out, once for each such bit.
    """
    m = max_distance + 1
    edge = [bits * i // m for i in range(m + 1)]
    seg = [sum(1 << k for k in range(edge[i], edge[i + 1])) for i in range(m)]
    out = []
    for i in range(m):
        chain = [sum(seg[(i + k) % m] for k in range(l)) for l in range(1, m + 1)]
        if m == 1:
            out.append((seg[0], []))
            continue
        j = (i + 1) % m
        out += [(chain[1] & ~(1 << k), chain[2:]) for k in range(edge[j], edge[j + 1])]
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_links(fps: DataFrame, max_distance: int) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints within max_distance bits, directly or through others.

    ``fps`` has distinct values ``fp``. Candidates share a ring key; a key that only one fingerprint has is dropped
    by a count per key, and a bucket of more than BLOCK rows is dealt out as pairs of blocks, so a task holds two
    blocks at most whatever the bucket's size. Inside, the chains of three and more segments prune before the full
    distance, and one spanning edge per row leaves the task, never all pairs.
    """
    slots = ring(64, max_distance)
    masks = F.array(*[F.lit(_signed(k)).cast("long") for k, _ in slots])
    fps = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")  # each row becomes many
    keys = fps.select("fp", F.posexplode(masks).alias("slot", "mask"))
    keys = keys.select("slot", F.col("fp").bitwiseAND(F.col("mask")).alias("bits"), "fp")
    shared = keys.groupBy("slot", "bits").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # Spark sizes the keys as if each fingerprint had one, so either side might be broadcast: both are sent by the shuffle
    rows = keys.hint("merge").join(shared.hint("merge"), ["slot", "bits"])
    rows = rows.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("slot", "bits", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp")
    by = ["slot", "bits", "lo", "hi"]
    longer = max_distance + 1 - 2
    chains = np.array([c[:longer] for _, c in slots], np.uint64).reshape(len(slots), -1)
    budgets = list(range(2, 2 + chains.shape[1]))

    def linked(x, slot):
        ok = np.ones(len(x), bool)
        for k, budget in enumerate(budgets):
            ok[ok] = np.bitwise_count(x[ok] & (chains[slot[ok], k] if np.ndim(slot) else chains[slot, k])) <= budget
        ok[ok] = np.bitwise_count(x[ok]) <= max_distance
        return ok

    def small(fp, slot, group, sizes):
        """Buckets of a few rows, all at once: row i against row i + d of the same bucket."""
        found = []
        for d in range(1, int(sizes.max())):
            i = np.flatnonzero(group[:-d] == group[d:])
            i = i[linked(fp[i] ^ fp[i + d], slot[i])]
            found.append(np.stack([fp[i], fp[i + d]]))
        return np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.uint64)

    def large(fp, slot):
        """One bucket: labels merged row by row; an edge to its label for each row."""
        label = np.arange(len(fp))
        for i in range(len(fp) - 1):
            j = np.flatnonzero(np.bitwise_count(fp[i] ^ fp[i + 1:]) <= max_distance) + i + 1
            j = j[linked(fp[i] ^ fp[j], np.full(len(j), slot))]
            seen = np.unique(label[np.append(j, i)])
            if len(seen) > 1:
                label[np.isin(label, seen)] = seen[0]
        k = np.flatnonzero(label != np.arange(len(fp)))
        return np.stack([fp[k], fp[label[k]]])

    def edges(t):
        fp = t.column("fp").to_numpy().view(np.uint64)
        slot = t.column("slot").to_numpy()
        cols = [t.column(c).to_numpy() for c in by]
        new = np.ones(len(fp), bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
        first = np.flatnonzero(new)
        sizes = np.diff(np.append(first, len(fp)))
        group = np.repeat(np.arange(len(first)), sizes)
        few = np.repeat(sizes <= 16, sizes)
        parts = [small(fp[few], slot[few], group[few], sizes[sizes <= 16])] if few.any() else []
        parts += [large(fp[a:a + n], slot[a]) for a, n in zip(first[sizes > 16], sizes[sizes > 16])]
        both = np.unique(np.sort(np.concatenate(parts, axis=1), axis=0), axis=1).view(np.int64)
        return pa.record_batch([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

    def run(batches):
        forget_worker_caches()
        held = None
        for b in batches:
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            t = t.combine_chunks()
            last = [t.column(c)[-1].as_py() for c in by]
            same = np.all([t.column(c).to_numpy() == v for c, v in zip(by, last)], axis=0)
            at = int(np.argmax(same))  # where the last, perhaps unfinished bucket begins
            if at:
                yield edges(t.slice(0, at))
            held = t.slice(at)
        if held is not None and held.num_rows:
            yield edges(held)

    return rows.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "a long, b long").distinct()


def with_components(rows: DataFrame, max_distance: int) -> DataFrame:
    """(fp, component, component_id): for each fingerprint of ``rows`` its component, named by a fingerprint, and the
    smallest doc_id in it."""
    own = rows.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    found = components(near_links(own.select("fp"), max_distance)).select(F.col("node").alias("fp"), "component")
    own = own.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = own.groupBy("component").agg(F.min("least_id").alias("component_id"))
    return own.join(least, "component").select("fp", "component", "component_id")


def simhash_dedup(docs: DataFrame, shingle_words: int = 4, max_distance: int = 4) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Fingerprints are made in one pass without a shuffle; equal ones collapse before anything is compared, so a group
    of copies costs one fingerprint. Links between distinct fingerprints come from near_links, and their connected
    components from distributed star steps.

    Null and empty texts and texts without a word have fingerprint zero and link like any other. Fewer words than a
    shingle: the whole sequence is the one shingle. Repeated rows give repeated result rows; a null doc_id gets its
    component's id, which ignores nulls. No rows give no rows; other columns are ignored.
    """
    rows = cut(fingerprints(docs, shingle_words))
    by_fp = with_components(rows, max_distance)
    return rows.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_near(docs: DataFrame, shingle_words: int = 4, max_distance: int = 4) -> DataFrame:
    """One row of ``docs`` for each component, with all its columns, whatever their names.

    The row with the smallest doc_id stays (a null id is the greatest); of rows that share it in a component, or that
    all lack an id, the one whose text hashes lowest. Rows are known by 128 bits of id and text, so a document that
    shares its id with one of another component stays or goes with its own; of equal rows any one stays.
    """
    k1, k2 = row_keys(docs)
    rows = cut(fingerprints(docs, shingle_words, k1=k1, k2=k2))
    by_fp = with_components(rows, max_distance).select("fp", "component")
    placed = rows.join(by_fp, "fp").groupBy("component", "doc_id", "k1", "k2").agg(F.count(F.lit(1)).alias("n"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("i"), F.col("k1").alias("k1"), F.col("k2").alias("k2"), F.col("n").alias("n"))
    kept = cut(placed.groupBy("component").agg(F.min(order).alias("best")).select("best.k1", "best.k2", "best.n"))
    found = packed(docs, k1=k1, k2=k2).join(kept.select("k1", "k2"), ["k1", "k2"], "left_semi")
    if not kept.where("n > 1").isEmpty():
        first = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("k1"))
        found = found.withColumn("place", first).where("place = 1")
    return unpacked(found)
