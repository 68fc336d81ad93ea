"""Small dimension tables built from the fixed lexicons.

Each has a fixed, known row count (at most a few hundred rows), so joining
to them with ``F.broadcast`` is safe at any corpus size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lexicons as L

# Largest number of rows any dimension here may have; checked on creation so a
# broadcast never grows with the data.
MAX_DIM_ROWS = 1000


def _dim(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    if len(rows) > MAX_DIM_ROWS:
        raise ValueError(f"dimension of {len(rows)} rows exceeds the broadcast bound {MAX_DIM_ROWS}")
    return F.broadcast(spark.createDataFrame(rows, schema))


def lexicon(spark: SparkSession) -> DataFrame:
    """term, norm (token normal form), canonical, category, n_tokens."""
    return _dim(spark, L.lexicon_rows(), "term string, norm string, canonical string, category string, n_tokens int")


def gazetteer(spark: SparkSession) -> DataFrame:
    return _dim(spark, [(g, i) for i, g in enumerate(L.GAZETTEER)], "name string, ord int")


def domains(spark: SparkSession) -> DataFrame:
    """domain, ord, keyword."""
    rows = [(d, i, k) for i, (d, kws) in enumerate(L.DOMAINS) for k in kws]
    return _dim(spark, rows, "domain string, ord int, keyword string")


def roadmaps(spark: SparkSession) -> DataFrame:
    rows = [(k, i, res, tl, pr) for i, (k, res, tl, pr) in enumerate(L.LEARNING_ROADMAP)]
    return _dim(spark, rows, "key string, ord int, resources array<string>, timeline string, projects array<string>")


def density_stopwords(spark: SparkSession) -> DataFrame:
    return _dim(spark, [(w,) for w in L.DENSITY_STOPWORDS], "word string")


def language_skills(spark: SparkSession) -> DataFrame:
    rows = [(lang, i, rel) for i, (lang, rels) in enumerate(L.LANGUAGE_SKILLS) for rel in rels]
    return _dim(spark, rows, "language string, ord int, related string")


def roles(spark: SparkSession) -> DataFrame:
    return _dim(spark, [(i, r) for i, r in enumerate(L.ROLE_NAMES)], "role_id int, role string")
