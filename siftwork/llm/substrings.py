"""Substring dedup by repeated-phrase automata."""

from __future__ import annotations

import hashlib
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of, worker_cache

#: Words of an anchor; a window's anchor is the one of its anchors-long word runs that hashes lowest.
ANCHOR = 5
#: Bytes of a text that are hashed at once; longer texts are taken in overlapping blocks.
BLOCK = 1 << 20
#: Contexts that a task remembers to have sent.
REMEMBER = 500_000
#: What step 2 yields: contexts to confirm, or the places of all contexts.
SENT = pa.schema([("h", pa.int64()), ("key", pa.binary()), ("id", pa.int64()), ("left", pa.int32()), ("context", pa.binary())])
PLACES = pa.schema([("id", pa.int64()), ("r", pa.int64()), ("pos", pa.int32()), ("key", pa.binary())])
#: White space to spaces.
SPACES = bytes(32 if x in b"\t\n\v\f\r" else x for x in range(256))
_mix = np.random.default_rng(20).integers(0, 1 << 64, 256, np.uint64)
BASE = 0x9E3779B97F4A7C15


def squeeze(text: bytes) -> bytes:
    """Words joined by one space."""
    text = text.translate(SPACES).strip(b" ")
    return b" ".join(text.split()) if b"  " in text else text


def word_places(buf: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a squeezed text."""
    if not buf:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gaps = np.flatnonzero(np.frombuffer(buf, np.uint8) == 32)
    return np.append(0, gaps + 1), np.append(gaps, len(buf))


def powers() -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse modulo 2**64 to the 0, 1, 2, ..."""
    kept = worker_cache("powers")
    if not kept:
        for name, x in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            p = np.full(2 * BLOCK, x, np.uint64)
            p[0] = 1
            kept[name] = np.cumprod(p)
    return kept["up"], kept["down"]


def run_hashes(buf: bytes, starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """A hash of the bytes of each run of n words, the same wherever the run stands."""
    m = len(starts) - n + 1
    if m < 1:
        return np.zeros(0, np.uint64)
    up, down = powers()
    out, i = np.empty(m, np.uint64), 0
    raw = np.frombuffer(buf, np.uint8)
    while i < m:
        a = starts[i]
        k = max(i + 1, min(m, int(np.searchsorted(ends, a + BLOCK, side="right")) - n + 1))
        piece = raw[a:ends[k + n - 2]]
        if len(piece) > len(up):  # a run longer than a block: words of enormous length
            out[i] = xxhash.xxh64_intdigest(piece.tobytes())
            i += 1
            continue
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix[piece] * down[:len(piece)])])
        s, e = starts[i:k] - a, ends[i + n - 1:k + n - 1] - a
        out[i:k] = (sums[e] - sums[s]) * up[s]
        i = k
    out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def lowest_places(a: np.ndarray, w: int) -> np.ndarray:
    """For every run of ``w`` values the place of its lowest one, the first of equal ones."""
    n, k, at = len(a) - w + 1, 1, np.arange(len(a))
    while 2 * k <= w:
        at = np.where(a[k:] < a[:-k], at[k:], at[:-k])
        a = np.minimum(a[:-k], a[k:])
        k *= 2
    return np.where(a[w - k:w - k + n] < a[:n], at[w - k:w - k + n], at[:n])


def anchors(buf: bytes, starts: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(positions, hashes, first and last window) of the anchors: every window of ``window`` words belongs to its own
    lowest run of ANCHOR words (the first of equal ones), so equal windows, wherever they stand, belong to equal anchors
    at the same place. The windows of an anchor are consecutive."""
    if len(starts) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    g = run_hashes(buf, starts, ends, ANCHOR)
    own = lowest_places(g, window - ANCHOR + 1)
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    return own[first], g[own[first]], first, np.append(first[1:], len(own)) - 1


def repeated_inside(buf: bytes, starts: np.ndarray, ends: np.ndarray, window: int) -> np.ndarray:
    """Starts of the windows whose words also start earlier in the same document."""
    runs = run_hashes(buf, starts, ends, window)
    order = np.argsort(runs, kind="stable")
    same = runs[order][1:] == runs[order][:-1]
    out, first = [], {}
    for s in np.unique(np.concatenate([order[1:][same], order[:-1][same]])).tolist():
        key = buf[starts[s]:ends[s + window - 1]]
        if key in first:
            out.append(s)
        first.setdefault(key, s)
    return np.array(out, np.int64)


def earlier_windows(group: list[tuple[int, int, bytes]], window: int) -> list[int]:
    """For the distinct contexts (first doc_id, words left of the anchor, text) of one anchor: which of the windows
    around the anchor also occur in a context of a smaller doc_id, as bits, bit i for the window that begins i words
    before the anchor.

    Windows that several contexts share are the recurring passages; an Aho-Corasick automaton of them is compiled
    and every context is streamed through it, which locates all their occurrences in the texts themselves.
    """
    if len(group) < 2:
        return [0] * len(group)
    spans, shared = [], {}
    for doc, left, text in group:
        ends = list(accumulate([len(w) + 1 for w in text.split(b" ")]))  # one behind each word's end
        starts = [0, *ends]
        own = {}
        for s in range(0, min(left, len(ends) - window) + 1):
            if s + window >= left + ANCHOR:
                own[starts[s], ends[s + window - 1] - 1] = left - s
        spans.append(own)
        for a, b in own:
            t = text[a:b]
            n, d = shared.get(t, (0, doc))
            shared[t] = (n + 1, min(d, doc))
    machine = ahocorasick.Automaton()
    for t, (n, d) in shared.items():
        if n > 1:
            machine.add_word(t.decode("latin-1"), (len(t), d))
    if not len(machine):
        return [0] * len(group)
    machine.make_automaton()
    out = []
    for (doc, _, text), own in zip(group, spans):
        bits = 0
        for end, (n, d) in machine.iter(text.decode("latin-1")):
            i = own.get((end + 1 - n, end + 1))
            if i is not None and d < doc:
                bits |= 1 << i
        out.append(bits)
    return out


def substring_dedup(docs: DataFrame, window: int = 20, full: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 (and ``kept``, the text left, if ``full``).

    A word is removed if a window of ``window`` consecutive words covers it whose words also start earlier: in a
    smaller doc_id, or in the same document before. Windows are judged on the input.

    1. Each document names its anchors (winnowing: one of about eight words begins one); only the anchors' hashes move,
       once, and a hash that two rows hold is a candidate. No window can recur elsewhere without its anchor recurring.
    2. Around each candidate anchor, the context holds every window that belongs to it, so each window of a text is in one
       context. A task sends the text of a context once, with the smallest doc_id it has seen it in, so a group of copies becomes one row a task; of all
       occurrences only the context's 128-bit digest moves. In a document later than a context's first one all its
       windows start earlier.
    3. The distinct contexts of an anchor are confirmed against each other by sharded automata (see earlier_windows),
       a shard being a partition by anchor. So every document's recurring parts are streamed, and no others need be.
    4. The verdicts go back to the occurrences by an equi-join on the digest and are gathered per document, together
       with repetitions inside it, and the words are removed.

    Texts are shuffled as compressed words, by one exchange for the second and the fourth step. A row's key is its id and
    a 64-bit hash of id and text, so rows of one id, or without one, keep their places apart; rows are dealt by the hash
    only, where a collision adds candidates and changes no result, as marks are told apart by the id.
    Null text has no words. Rows with an equal doc_id are judged as if none of them came earlier than another; null
    ids count as later than any other, and as equal to each other. Texts with fewer words than a window stay whole.
    No rows give none; other columns are ignored.
    """
    later = (1 << 63) - 1
    d = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(later)).alias("id"), text_of(docs).alias("t"))
    d = d.select("id", F.xxhash64("id", "t").alias("r"), "t")
    reach = window - ANCHOR

    def name_anchors(batches):
        for big in batches:
            for at in range(0, big.num_rows, 500):
                b, rs, hs = big.slice(at, 500), [], []
                for r, t in zip(b.column("r").to_pylist(), b.column("t").cast(pa.binary())):
                    buf = squeeze(t.as_buffer().to_pybytes())
                    h = np.unique(anchors(buf, *word_places(buf), window)[1])
                    rs.append(np.full(len(h), r, np.int64))
                    hs.append(h.view(np.int64))
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in (rs, hs)], names=["r", "h"])

    named = d.mapInArrow(name_anchors, "r long, h long").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("h")))
    listed = named.where("n > 1").groupBy("r").agg(F.collect_set("h").alias("hs"))  # by the text's length

    def pack(batches):
        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            yield pa.record_batch([b.column("id"), b.column("r"), pa.array([z.compress(squeeze(t.as_buffer().to_pybytes())) for t in b.column("t").cast(pa.binary())],
                                                            pa.binary())], names=["id", "r", "z"])

    # the joins on r share one exchange only if both see the same filter
    packed = d.mapInArrow(pack, "id long, r long, z binary").where("r is not null")

    def show(batches, texts):
        """Contexts with their texts that this task has not sent of an earlier document, or else the places of all."""
        unpack, seen = zstandard.ZstdDecompressor().decompress, {}
        schema = SENT if texts else PLACES
        for big in batches:
            for at in range(0, big.num_rows, 200):
                b, out = big.slice(at, 200), []
                for i, r, t, hs in zip(*[b.column(c).to_pylist() for c in ("id", "r")], b.column("z"), b.column("hs")):
                    buf = unpack(t.as_buffer())
                    starts, ends = word_places(buf)
                    pos, h, begin, last = anchors(buf, starts, ends, window)
                    ok = np.isin(h.view(np.int64), hs.values.to_numpy())
                    pos, h, begin, last = pos[ok], h[ok].view(np.int64), begin[ok], last[ok]
                    spans = zip(pos.tolist(), h.tolist(), (pos - begin).tolist(), starts[begin].tolist(), ends[last + window - 1].tolist())
                    for p, a, l, s, e in spans:
                        context = buf[s:e]
                        key = xxhash.xxh3_128_digest(b"%d %d " % (a, l) + context)
                        if not texts:
                            out.append((i, r, p, key))
                            continue
                        first = seen.get(key)
                        if first is None or first > i:
                            if len(seen) > REMEMBER:
                                seen.clear()
                            seen[key] = i
                            out.append((a, key, i, l, context))
                cols = list(zip(*out)) or [[]] * len(schema)
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, schema.types)], schema=schema)

    found = packed.join(listed, "r").select("id", "r", "z", "hs")
    sent = found.mapInArrow(lambda batches: show(batches, True), "h long, key binary, id long, left int, context binary")
    places = found.mapInArrow(lambda batches: show(batches, False), "id long, r long, pos int, key binary")

    def confirm(batches):
        anchor, group, last = None, [], None
        kinds = (pa.binary(), pa.int64(), pa.int32(), pa.int32())

        def whole(left, text):  # the bits of all windows of a context
            n = text.count(b" ") + 2 - window
            return ((1 << n) - 1) << (left + 1 - n)

        def verdicts(group):
            own = [whole(left, text) for _, left, text, _ in group]
            return list(zip([g[3] for g in group], [g[0] for g in group], earlier_windows([g[:3] for g in group], window), own))

        def table(out):
            return pa.record_batch([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names=["key", "first", "bits", "own"])

        for big in batches:
            for at in range(0, big.num_rows, 2000):
                b, out = big.slice(at, 2000), []
                for a, key, *row in zip(*[b.column(c).to_pylist() for c in ("h", "key", "id", "left", "context")]):
                    if key == last:
                        continue  # what another task has sent of a later document
                    if a != anchor:
                        out += verdicts(group)
                        anchor, group = a, []
                    last = key
                    group.append((*row, key))
                yield table(out)
        yield table(verdicts(group))

    judged = sent.repartition("h").sortWithinPartitions("h", "key", "id").mapInArrow(confirm, "key binary, first long, bits int, own int")
    marks = places.join(judged, "key")
    # every window of the context, or those whose words a context of a smaller doc_id holds too
    marks = marks.withColumn("bits", F.when(F.col("id") > F.col("first"), F.col("own")).otherwise(F.col("bits"))).where("bits != 0")
    mark = F.shiftleft(F.col("pos").cast("long"), 32) + F.col("bits")
    marks = marks.groupBy("r").agg(F.collect_set(F.struct("id", mark.alias("mark"))).alias("marks"))  # by the text's length
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if full else "")

    def remove(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for big in batches:
            for at in range(0, big.num_rows, 200):
                b, out = big.slice(at, 200), []
                for i, t, marked in zip(b.column("id").to_pylist(), b.column("z"), b.column("marks")):
                    buf = unpack(t.as_buffer())
                    starts, ends = word_places(buf)
                    n = len(starts)
                    gone = [repeated_inside(buf, starts, ends, window)]
                    if marked.is_valid:
                        ids, mark = (marked.values.field(k).to_numpy() for k in range(2))
                        pos, bits = mark[ids == i] >> 32, mark[ids == i] & 0xFFFFFFFF
                        gone += [pos[bits >> k & 1 == 1] - k for k in range(reach + 1)]
                    gone = np.concatenate(gone)
                    edge = np.bincount(gone, minlength=n + 1) - np.bincount(gone + window, minlength=n + 1)[:n + 1]
                    stays = np.cumsum(edge)[:n] == 0
                    removed, kept = n - int(stays.sum()), buf
                    if removed:
                        turn = np.flatnonzero(np.diff(np.concatenate([[False], stays, [False]]))).reshape(-1, 2)
                        kept = b" ".join([buf[starts[x]:ends[y - 1]] for x, y in turn.tolist()])
                    row = (None if i == later else i, n, removed, hashlib.sha256(kept).hexdigest())
                    out.append((*row, kept.decode("utf-8", "replace")) if full else row)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                cols = list(zip(*out)) or [[]] * (4 + full)
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=[f.strip().split(" ")[0] for f in schema.split(",")])

    return packed.join(marks, "r", "left").mapInArrow(remove, schema)
