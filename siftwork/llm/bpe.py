"""BPE encoding and decoding by prefix-sharing trie traversal."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of, worker_cache

DEFAULT_VOCABULARY = "word_bpe_49k.json"
#: Encoded words that a worker remembers before it starts anew.
REMEMBER = 600_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_VOCABULARY)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        out[b] = chr(b) if b in plain else chr(extra)
        extra += b not in plain
    return out


class Vocabulary:
    """What a vocabulary file of the tokenizers library says: word pattern, merges, end-of-word mark, special tokens."""

    def __init__(self, definition: str):
        d = json.loads(definition)
        model = d["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError("only byte-level BPE with merges is read")
        self.ids = model["vocab"]
        self.mark = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in d["added_tokens"]}
        self.names = {i: t for t, i in [*self.ids.items(), *self.special.items()]}
        kinds = [n["type"] for n in (d["normalizer"] or {}).get("normalizers", [])]
        self.nfc, self.lower = "NFC" in kinds, "Lowercase" in kinds
        split = next(p for p in d["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"]).findall
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split if self.special else lambda t: [t]
        #: merge of two token ids -> (rank, id); rank and halves of a token, rank -1 for single symbols
        self.merge, self.rank, self.left, self.right = {}, dict.fromkeys(self.ids.values(), -1), {}, {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, z = self.ids[a], self.ids[b], self.ids[a + b]
            self.merge[x, y] = r
            self.rank[z], self.left[z], self.right[z] = r, x, y
        self.longest = max(map(len, self.ids))
        self.bytes = dict(enumerate(byte_alphabet()))

    def side_by_side(self, a: int, b: int) -> bool:
        """Whether tokens a, b may stand next to each other: at no time while the two grow would a merge join them.

        The two derivations are undone from the end, always the merge that came last. Between two undone merges the
        tokens at the border are fixed, and a border merge of a smaller rank than the next growth would have won;
        at equal rank the leftmost merge wins.
        """
        merge, rank = self.merge, self.rank
        bound = len(merge)
        while True:
            joined = merge.get((a, b))
            if joined is not None and joined < bound:
                return False
            if rank[a] > rank[b]:
                bound = rank[a]
                a = self.right[a]
            elif rank[b] >= 0:
                bound = rank[b] + 1
                b = self.left[b]
            else:
                return True

    def whole(self, t: int) -> bool:
        """Whether the token's own text is encoded as this token."""
        return self.rank[t] < 0 or (self.side_by_side(self.left[t], self.right[t]) is False and self.whole(self.left[t])
                                    and self.whole(self.right[t]))

    def last_token(self, prefix: str, last: list, end: str = "") -> int:
        """The last token of the encoding of ``prefix`` + ``end``, from the last tokens of all shorter prefixes.

        A BPE encoding without its last token is the encoding of the shorter prefix, so the last token is the one
        vocabulary entry that ends here and may stand next to the last token of what it leaves.
        """
        ids, n = self.ids, len(prefix)
        for s in range(max(0, n - self.longest), n):
            t = ids.get(prefix[s:] + end)
            if t is not None and (self.side_by_side(last[s], t) if s else self.whole(t)):
                return t
        raise ValueError(f"no token ends {prefix!r}")

    def encode_words(self, words) -> dict:
        """Encodings of distinct words: a trie of their symbols is walked depth first, and the last token of every
        prefix is found once, whatever the number of words that share it. word -> (n, ids, tokens), joined by spaces.
        """
        bs, mark, size = self.bytes, self.mark, {}
        trie: dict = {}
        for w in words:
            sym = "".join([bs[x] for x in w.encode("utf-8", "replace")])
            node = trie
            for c in sym if not mark else sym[:-1]:
                node = node.setdefault(c, {})
            node.setdefault("", []).append((w, sym))
        out = {}
        stack = [(trie, "")]
        last: list = [None]  # last[d]: last token of the current path's prefix of d symbols
        while stack:
            node, path = stack.pop()
            if path:
                del last[len(path):]
                last.append(self.last_token(path, last))
            for c, child in node.items():
                if c:
                    stack.append((child, path + c))
                    continue
                for w, sym in child:
                    d = len(sym)
                    t = self.last_token(sym, last, mark) if mark else last[d]
                    ids = []
                    while True:
                        ids.append(t)
                        if t not in size:
                            size[t] = len(self.names[t]) - (len(mark) if mark and self.names[t].endswith(mark) else 0)
                        d -= size[t]
                        if not d:
                            break
                        t = last[d]
                    ids.reverse()
                    out[w] = (len(ids), " ".join(map(str, ids)), " ".join([self.names[i] for i in ids]))
        return out

    def pieces(self, text: str) -> list[str]:
        """The words of a text in order; special tokens stand as themselves."""
        out = []
        for i, part in enumerate(self.cut(text)):
            if i % 2:
                out.append(part)
            elif part:
                if self.nfc and not unicodedata.is_normalized("NFC", part):
                    part = unicodedata.normalize("NFC", part)
                if self.lower:  # letter by letter: no rule for a sigma at the end of a word
                    part = part.replace("Σ", "σ").lower()
                out += self.words(part)
        return out


def encode_decode(docs: DataFrame, vocabulary: str | None = None, full: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (array), decoded, ids_sha256, decoded_sha256.

    Map-only: each task splits its texts into words, and each distinct word is encoded once per worker through a
    trie of the batch's new words; nothing is shuffled and nothing grows with the corpus (a worker remembers
    REMEMBER words and then starts anew). ``vocabulary`` is the path of a tokenizers file on the driver; its contents
    travel with the tasks. Decoding joins the tokens' own strings by spaces, as a file without a decoder asks.
    ``full`` adds the ids and the decoded text, which are large.

    Null and empty texts have no tokens (digests of the empty string); special tokens written in a text are encoded as
    such. Repeated rows give repeated results; no rows give none; other columns are ignored.
    """
    path = vocabulary or default_vocabulary()
    with open(path, encoding="utf-8") as f:
        definition = docs.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file: its size is fixed
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>, decoded string" if full else ""

    def run(batches):
        kept = worker_cache("bpe")
        if path not in kept:
            kept[path] = (Vocabulary(definition.value), {})
        vocab, known = kept[path]
        special = {t: (1, str(i), t) for t, i in vocab.special.items()}
        for big in batches:
            for at in range(0, big.num_rows, 256):
                b = big.slice(at, 256)
                texts = [vocab.pieces(x.as_buffer().to_pybytes().decode("utf-8", "replace"))
                         for x in b.column("t").cast(pa.binary())]
                new = set().union(*texts).difference(known)
                if new:
                    if len(known) > REMEMBER:
                        known.clear()
                        new = set().union(*texts)
                    known.update(vocab.encode_words(new.difference(special)))
                    known.update(special)
                n, ids_sha, dec_sha, ids, dec = [], [], [], [], []
                for words in texts:
                    got = [known[w] for w in words]
                    i, d = " ".join([g[1] for g in got]), " ".join([g[2] for g in got])
                    n.append(sum([g[0] for g in got]))
                    ids_sha.append(hashlib.sha256(i.encode()).hexdigest())
                    dec_sha.append(hashlib.sha256(d.encode()).hexdigest())
                    if full:
                        ids.append([int(x) for x in i.split()])
                        dec.append(d)
                cols = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(dec_sha)]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if full:
                    cols, names = [*cols, pa.array(ids, pa.list_(pa.int32())), pa.array(dec)], [*names, "ids", "decoded"]
                yield pa.record_batch(cols, names=names)

    return docs.select(F.col("doc_id").cast("long"), text_of(docs).alias("t")).mapInArrow(run, schema)
