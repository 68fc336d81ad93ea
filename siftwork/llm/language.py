"""Language ID by cross-parsing against suffix automata of labelled text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import packed, text_of, worker_cache

#: Characters parsed in one go; a longer text is parsed block by block, all blocks count.
PIECE = 2048
#: Characters of a group of texts parsed side by side.
GROUP = 1_500_000
UNKNOWN = "und"


def letters_only(text: str) -> str:
    """Lower-case letters, everything else as one space."""
    return " ".join("".join([c if c.isalpha() else " " for c in text.lower()]).split())


def suffix_automaton(codes, width: int) -> np.ndarray:
    """Transitions (states x width, -1 for none) of the automaton that accepts all substrings of ``codes``."""
    goto, link, length, last = [{}], [-1], [0], 0
    for c in codes:
        cur = len(goto)
        goto.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in goto[p]:
            goto[p][c] = cur
            p = link[p]
        if p >= 0:
            q = goto[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(goto)
                goto.append(dict(goto[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and goto[p].get(c) == q:
                    goto[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    table = np.full((len(goto), width), -1, np.int32)
    for s, edges in enumerate(goto):
        for c, t in edges.items():
            table[s, c] = t
    return table


class Model:
    """Automata by language over one alphabet: 0 space, 1.. the letters of the labelled texts, last any other letter."""

    def __init__(self, texts: dict[str, str]):
        texts = {k: v for k, v in ((k, letters_only(v)) for k, v in texts.items()) if v}
        self.langs = sorted(texts)
        alphabet = sorted(set("".join(texts.values())) - {" "})
        self.width = len(alphabet) + 2
        #: code point -> class; letters are found by their upper bound table once per worker
        self.classes = np.zeros(0x110000, np.int32)
        self.classes[[cp for cp in range(0x110000) if chr(cp).isalpha()]] = self.width - 1
        code = {c: i + 1 for i, c in enumerate(alphabet)} | {" ": 0}
        for c, i in code.items():
            self.classes[ord(c)] = i
        self.tables = [suffix_automaton([code[c] for c in texts[k]], self.width) for k in self.langs]
        self.scale = [np.log2(len(texts[k]) + 1) for k in self.langs]

    def phrases(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Phrases of each piece for each language (pieces x languages): each phrase is the longest match with the
        labelled text, or one character if there is none. All pieces step at the same time, longest first."""
        order = np.argsort(starts - ends, kind="stable")
        starts, size = starts[order], (ends - starts)[order]
        active = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), side="right") if len(size) else []
        out = np.zeros((len(order), len(self.langs)), np.int64)
        for k, table in enumerate(self.tables):
            flat, root, width = table.ravel(), table[0], self.width
            lone = root < 0  # no text of this language has the character
            enter = np.where(lone, 0, root)
            state, count = np.zeros(len(order), np.int32), np.zeros(len(order), np.int32)
            for t, n in enumerate(active):
                c = codes[starts[:n] + t]
                s = state[:n]
                nxt = flat[s * width + c]
                miss = np.flatnonzero(nxt < 0)
                if len(miss):
                    cm = c[miss]
                    count[miss] += (s[miss] != 0).astype(np.int32) + lone[cm]
                    nxt[miss] = enter[cm]
                state[:n] = nxt
            out[order, k] = count + (state != 0)
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        raw = [np.frombuffer(t.lower().encode("utf-32-le", "replace"), np.uint32) for t in texts]
        each = []
        for r in raw:
            c = self.classes[r]
            space = c == 0
            keep = ~space
            keep[1:] |= ~space[:-1]  # one space of a run
            c = c[keep]
            each.append(c if c.any() else c[:0])
        size = np.array([len(c) for c in each], np.int64)
        codes = np.concatenate(each) if each else np.zeros(0, np.int32)
        base = np.cumsum(size) - size
        own = [np.arange(a, a + n, PIECE) for a, n in zip(base, size)]
        doc = np.repeat(np.arange(len(each)), [len(o) for o in own])
        starts = np.concatenate(own).astype(np.int64) if own else np.zeros(0, np.int64)
        ends = np.minimum(starts + PIECE, (base + size)[doc]) if len(doc) else starts
        total = np.zeros((len(each), len(self.langs)))
        if self.langs and len(doc):
            np.add.at(total, doc, self.phrases(codes, starts, ends))
        total *= np.array(self.scale)
        names, scores = [], []
        for n, row in zip(size, total):
            if not n or not self.langs:
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            best = int(np.argmin(row))
            second = float(np.partition(row, 1)[1]) if len(row) > 1 else 0.0
            names.append(self.langs[best])
            scores.append((second - float(row[best])) / second if len(row) > 1 and second else 1.0)
        return names, scores


def held_out(doc_id: Column) -> Column:
    """One fold of five by the id's CRC-32; a null id is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, per_lang: int, chars: int) -> dict[str, str]:
    """The bounded sample: ``per_lang`` labelled documents of each language outside the held-out fold, those with the
    smallest hashes of their ids, ``chars`` characters of each. Collected: languages * per_lang * chars at most."""
    d = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    d = d.select(F.col("lang").cast("string"), F.xxhash64(F.col("doc_id").cast("string")).alias("h"),
                 F.substring("text", 1, chars).alias("t"))
    d = d.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "t"))).where(F.col("n") <= per_lang)
    out: dict[str, str] = {}
    for r in d.orderBy("lang", "n").collect():
        out[r["lang"]] = out.get(r["lang"], "") + " " + r["t"]
    return out


def identify(docs: DataFrame, model_from: DataFrame | None = None, per_lang: int = 64, chars: int = 800) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    A suffix automaton is built per language from a bounded sample of labelled rows (see labelled_sample; the bound
    is the parameters). Each whole text is parsed into longest matches with each language's text, and the
    language with the fewest phrases wins, each weighted by the bits that name a place in that language's text.
    Ties go to the first name. score: by what part the best stays below the second, 1 if there is one language.
    Map-only but for the sample; texts never move.

    ``und`` with score 0 if the text is null, empty or has no letter, or if no labelled rows exist. lang, source and
    doc_id are no inputs of a prediction. Repeated rows give repeated results; no rows give none; other columns
    are ignored, null labels are not learned from.
    """
    texts = labelled_sample(docs if model_from is None else model_from, per_lang, chars)
    d = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), text_of(docs).alias("t"))
    return predicted(d, texts, lambda b: b.column("t")).select("doc_id", "held_out", "lang_pred", "score")


def predicted(rows: DataFrame, texts: dict[str, str], text_in) -> DataFrame:
    """``rows`` with lang_pred and score; ``text_in`` finds the texts in an Arrow batch of them. Map-only."""
    name = hash(tuple(sorted(texts.items())))

    def run(batches):
        kept = worker_cache("language")
        if name not in kept:
            kept.clear()
            kept[name] = Model(texts)
        model = kept[name]
        for b in batches:
            names, scores, group, held = [], [], [], 0

            def flush():
                got = model.predict(group)
                names.extend(got[0])
                scores.extend(got[1])
                group.clear()

            for x in text_in(b).cast(pa.binary()):
                group.append(x.as_buffer().to_pybytes().decode("utf-8", "replace") if x.is_valid else "")
                held += len(group[-1])
                if held > GROUP:
                    flush()
                    held = 0
            flush()
            yield pa.record_batch([*b.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                  names=[*b.schema.names, "lang_pred", "score"])

    schema = T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, schema)


def keep_identified(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that have a language, with the predicted one in ``lang``; a text without a letter is rejected.

    Without any labelled row nothing can be learned: then the rows with a letter stay as they are. Each row is judged by
    its own text, whatever its id; columns may have any names."""
    texts = labelled_sample(docs, **{"per_lang": 64, "chars": 800} | options)
    if not texts:
        return docs.where(F.coalesce(docs["text"].cast("string").rlike(r"\p{L}"), F.lit(False)))
    r = predicted(packed(docs), texts, lambda b: b.column("row").field("text")).where(F.col("lang_pred") != UNKNOWN)
    kind = docs.schema["lang"].dataType
    return r.select(*[F.col("lang_pred").cast(kind).alias(c) if c == "lang" else F.col("row")[c].alias(c) for c in docs.columns])
