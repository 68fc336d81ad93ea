"""Many plain phrases looked for in each text, where the text is read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T


def phrases_found(docs: DataFrame, text_col: str, phrases: list[str], out: str, tokens: str | None = None) -> DataFrame:
    """The other columns of ``docs`` and in ``out`` the ``phrases`` (lower case, not empty, so few that a task can hold
    them) that are substrings of the row's lower text; with a pattern ``tokens``, those that are runs of its tokens.

    A task builds one automaton of the phrases and streams its texts through it. No text leaves its task."""
    keys = [c for c in docs.columns if c != text_col]
    phrases = sorted(set(phrases))

    def search(batches):
        import re

        import ahocorasick
        import pyarrow as pa

        machine = ahocorasick.Automaton()
        # substrings are those of the bytes, as Spark compares them; tokens are cut from the characters
        for x in phrases:
            machine.add_word(f" {x} " if tokens else x.encode().decode("latin-1"), x)
        if phrases:
            machine.make_automaton()
        cut = re.compile(tokens).findall if tokens else None
        for big in batches:
            for at in range(0, big.num_rows, 500):
                b, found = big.slice(at, 500), []
                for t in b.column("_lt"):
                    t = t.as_buffer().to_pybytes()
                    t = f" {' '.join(cut(t.decode('utf-8', 'replace')))} " if tokens else t.decode("latin-1")
                    found.append(list({x for _, x in machine.iter(t)}) if phrases else [])
                yield pa.record_batch([*[b.column(k) for k in keys], pa.array(found, pa.list_(pa.string()))], names=[*keys, out])

    d = docs.select(*keys, F.lower(T.col(text_col)).cast("binary").alias("_lt"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.drop("_lt").schema)
    return d.mapInArrow(search, f"{schema}, `{out}` array<string>")


def words_found(docs: DataFrame, text_col: str, words: list[str], out: str) -> DataFrame:
    """The other columns of ``docs`` and in ``out`` as bytes, bit by bit from the lowest, which of the ``words`` (lower
    case, distinct, no white space, so few that a task can hold them) are substrings of the row's lower text.

    Such a word lies inside one token, so a task streams a text's distinct tokens through one automaton of the words."""
    keys = [c for c in docs.columns if c != text_col]

    def search(batches):
        import ahocorasick
        import numpy as np
        import pyarrow as pa

        machine = ahocorasick.Automaton()
        for k, x in enumerate(words):
            machine.add_word(x.encode().decode("latin-1"), k)
        if words:
            machine.make_automaton()
        for big in batches:
            for at in range(0, big.num_rows, 500):
                b = big.slice(at, 500)
                held = np.zeros((b.num_rows, max(1, len(words))), np.uint8)
                for i, t in enumerate(b.column("_lt")):
                    t = b" ".join(set(t.as_buffer().to_pybytes().split())).decode("latin-1")
                    held[i, list({k for _, k in machine.iter(t)} if words else ())] = 1
                bits = np.packbits(held, axis=1, bitorder="little")
                yield pa.record_batch([*[b.column(k) for k in keys], pa.array([x.tobytes() for x in bits], pa.binary())], names=[*keys, out])

    d = docs.select(*keys, F.lower(T.col(text_col)).cast("binary").alias("_lt"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.drop("_lt").schema)
    return d.mapInArrow(search, f"{schema}, `{out}` binary")
