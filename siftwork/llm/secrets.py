"""Secret scan: fixed patterns plus a token-efficiency test."""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of, worker_cache

DEFAULT_RANKS = "byte_bpe_50k.tiktoken"
# The three base kinds, in the order that breaks ties of the start.
KINDS = ("assign", "access", "hex", "token")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # whole runs, so the length can be asked for at once
#: What the token test looks at: unbroken runs of the characters of keys and of base64.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: What it looks at next, in a run that is no secret as a whole: the parts of a path, then of a name.
PARTS = (re.compile(r"[^/=]{16,}"), re.compile(r"[^-_+]{16,}"))
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
DIGEST = re.compile(r"[0-9a-f]+|[0-9A-F]+")
DIGEST_LENGTHS = {32, 40, 56, 64, 96, 128}


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_RANKS)


def word_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def digest_or_identifier(run: str) -> bool:
    """Known random-looking strings that are no secrets: digests of the usual lengths, UUIDs, plain numbers, and
    identifiers, that is numbers, words of at most five letters and CamelCase between - _ / + =. Tokens are no measure of
    such short words; longer ones are left to it."""
    if UUID.fullmatch(run) or len(run) in DIGEST_LENGTHS and DIGEST.fullmatch(run):
        return True
    parts = [p for p in re.split(r"[-_/+=]+", run) if p]
    return all(p.isdigit() or re.fullmatch(r"[A-Za-z]?[a-z]{0,4}\d{0,4}|([A-Z][a-z]+)+\d{0,4}|[A-Z]{1,5}\d{0,4}", p) for p in parts)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def between(run: re.Match, taken: list[tuple[int, int]]) -> list[tuple[int, str]]:
    """(start, text) of what the taken spans leave of a run."""
    out, at = [], run.start()
    for s, e in [*taken, (run.end(), run.end())]:
        if s >= at:
            out.append((at, run.string[at:min(s, run.end())]))
        at = max(at, e)
    return [(s, x) for s, x in out if len(x) >= 16]


def token_spans(x: str, at: int, random_looking, parts=PARTS):
    """(start, end) of the longest parts of ``x``, which begins at ``at``, that look random."""
    if not re.search("[A-Za-z]", x) or digest_or_identifier(x):
        return
    if random_looking(x):
        yield at, at + len(x)
    elif parts:
        for m in parts[0].finditer(x):
            yield from token_spans(m.group(), at + m.start(), random_looking, parts[1:])


def find_secrets(docs: DataFrame, ranks: str | None = None, max_chars_per_token: float = 2.0) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, n_token, base_sha256, spans, found.

    Base kinds by fixed patterns. Token kind: 16 or more key characters that hold a letter, are no digest, UUID or
    identifier, and of which the vocabulary's tokens cover at most ``max_chars_per_token`` characters on average: text
    that a vocabulary was made for needs few tokens, random strings need many. The test is made on each unbroken run of
    such characters, as far as no base span covers it (base64 holds / + =); if a run passes as text, on its parts between
    / and =, and of those that pass on the parts between - _ and +. So words around a key do not hide it. ``ranks`` is
    the path of a tiktoken file on the driver; its contents travel with the tasks.

    Spans are kind:start:end in code points, end exclusive, by start and then kind; ``found`` has them as an array.
    Map-only, no state across documents. Null and empty texts have no spans (empty strings, the digest of the empty
    string); repeated rows give repeated results; no rows give none; other columns are ignored.
    """
    path = ranks or default_ranks()
    with open(path, "rb") as f:
        table = docs.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file: its size is fixed
    pattern = word_pattern()

    def run(batches):
        import tiktoken

        kept = worker_cache("tiktoken")
        if path not in kept:
            own = {base64.b64decode(a): int(b) for a, b in map(bytes.split, table.value.splitlines())}
            kept[path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=own, special_tokens={})
        encode = kept[path].encode_ordinary

        def random_looking(x):
            return len(x) <= max_chars_per_token * len(encode(x))

        def more(text, base):
            taken = sorted((s, e) for s, _, e in base)
            for m in RUN.finditer(text):
                near = [(s, e) for s, e in taken if s < m.end() and m.start() < e]
                for at, x in between(m, near):
                    for s, e in token_spans(x, at, random_looking):
                        yield s, 3, e

        for b in batches:
            rows = []
            for x in b.column("t").cast(pa.binary()):
                text = x.as_buffer().to_pybytes().decode("utf-8", "replace")
                base = sorted(base_spans(text))
                spans = sorted([*base, *more(text, base)])
                said = [[f"{KINDS[k]}:{s}:{e}" for s, k, e in y] for y in (base, spans)]
                count = [sum(k == i for _, k, _ in spans) for i in range(4)]
                rows.append((*count, hashlib.sha256(",".join(said[0]).encode()).hexdigest(), ",".join(said[1]), said[1]))
            cols = list(zip(*rows)) if rows else [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.list_(pa.string())]
            yield pa.record_batch([b.column("doc_id"), *[pa.array(list(c), k) for c, k in zip(cols, kinds)]],
                                  names=["doc_id", "n_assign", "n_access", "n_hex", "n_token", "base_sha256", "spans", "found"])

    return docs.select(F.col("doc_id").cast("long"), text_of(docs).alias("t")).mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, n_token long, base_sha256 string, spans string, "
             "found array<string>")
