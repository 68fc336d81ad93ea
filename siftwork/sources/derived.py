"""Derived test corpora CAND, TARG and REPOS, built from the star-schema tables.

The given ``documents`` hold invented prose that never hits the lexicons, so
the lexicon, screening and repository operators are exercised on text that
Spark derives deterministically from ``customer``/``orders``/``lineitem``/``part``
(the same SQL runs in the oracle).  Their size grows with the scale factor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import lexicons as L
from .corpus import load


def lex_list() -> list[str]:
    terms = L.TECH_SKILLS + L.TOOLS + L.SOFT_SKILLS
    return sorted(terms)


def verb_list() -> list[str]:
    return sorted(L.ACTION_VERBS) + [w for w, _ in L.VERB_UPGRADES]


def lang_list() -> list[str]:
    return [lang for lang, _ in L.LANGUAGE_SKILLS]


def topic_list() -> list[str]:
    return [t for t, _ in L.TOPIC_SKILLS]


def _arr(values: list[str]):
    return F.array(*[F.lit(v) for v in values])


def _pick(values: list[str], idx0):
    """values[idx0] for a 0-based Column index (1-based element_at)."""
    return F.element_at(_arr(values), (idx0 + 1).cast("int"))


def _s(c):
    return c.cast("string")


def cand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CAND(doc_id, text): one candidate document per customer."""
    lex, verb = lex_list(), verb_list()
    li = load(spark, sf_dir, "lineitem").join(
        load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    line = F.concat(
        F.lit("- "), _pick(verb, (F.col("l_partkey") * 5 + F.col("l_linenumber")) % len(verb)),
        F.lit(" "), _pick(lex, (F.col("l_partkey") * 7 + F.col("l_suppkey") * 3) % len(lex)),
        F.lit(" service"),
        F.when(F.col("l_linenumber") % 2 == 0,
               F.concat(F.lit(" by "), _s(F.col("l_quantity").cast("int")), F.lit("%"))).otherwise(F.lit("")),
    )
    keyed = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate",
                     line.alias("line"))
    bullets = li.groupBy("o_custkey").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(keyed)), lambda x: x["line"]), "\n").alias("bullets"))
    c = F.col("c_custkey")
    nl = F.lit("\n")
    text = F.concat(
        F.lit("Candidate "), _s(c),
        F.when(c % 5 != 0, F.concat(nl, F.lit("Email: c"), _s(c), F.lit("@mail.example | Phone: +1 555 010 "),
                                    _s(1000 + c % 9000))).otherwise(F.lit("")),
        F.when(c % 3 == 0, F.concat(nl, F.lit("linkedin.com/in/c"), _s(c))).otherwise(F.lit("")),
        F.when(c % 4 != 0, F.concat(nl, nl, F.lit("SUMMARY"), nl, F.lit("Results-driven "),
                                    F.lower("c_mktsegment"), F.lit(" engineer since "), _s(1990 + c % 34),
                                    F.lit("."))).otherwise(F.lit("")),
        F.when(c % 11 != 0, F.concat(nl, nl, F.lit("EXPERIENCE"))).otherwise(F.lit("")),
        F.coalesce(F.concat(nl, F.col("bullets")), F.lit("")),
        F.when(c % 7 != 0, F.concat(nl, nl, F.lit("EDUCATION"), nl, F.lit("Bachelor, "),
                                    _s(1985 + c % 30))).otherwise(F.lit("")),
        F.when(c % 6 != 0, F.concat(nl, nl, F.lit("SKILLS"), nl, _pick(lex, c % len(lex)), F.lit(", "),
                                    _pick(lex, (c * 13) % len(lex)))).otherwise(F.lit("")),
        F.when(c % 9 == 0, F.concat(nl, F.lit("A "), _pick(L.WEAK_SKILLS, c % len(L.WEAK_SKILLS)), F.lit(" person")))
        .otherwise(F.lit("")),
    )
    cust = load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return (cust.join(bullets, F.col("c_custkey") == F.col("o_custkey"), "left")
            .select(c.alias("doc_id"), text.alias("text")))


def targ(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TARG(target_id, text): one target per brand, from all its parts."""
    lex = lex_list()
    part = load(spark, sf_dir, "part")
    line = F.concat(F.lit("- Strong "), _pick(lex, (F.col("p_partkey") * 7) % len(lex)), F.lit(" required"))
    agg = part.groupBy("p_brand").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("line")))),
                                 lambda x: x["line"]), "\n").alias("lines"))
    return agg.select(F.substring("p_brand", 7, 1 << 20).cast("bigint").alias("target_id"),
                      F.concat(F.lit("Opening "), F.col("p_brand"), F.lit("\n"), F.col("lines")).alias("text"))


def repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REPOS(owner, name, description, language, stars, forks, topics, pos): one row per lineitem."""
    langs, topics = lang_list(), topic_list()
    li = load(spark, sf_dir, "lineitem")
    part = load(spark, sf_dir, "part").select("p_partkey", "p_name")
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
                                                "l_shipdate")
    return li.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_suppkey").alias("owner"),
        F.concat(F.lit("proj-"), _s(F.col("l_orderkey")), F.lit("_"), _s(F.col("l_linenumber"))).alias("name"),
        F.concat(F.col("p_name"), F.lit(" with "),
                 _pick(topics, (F.col("l_orderkey") * 3 + F.col("l_linenumber")) % len(topics))).alias("description"),
        _pick(langs, F.col("l_partkey") % len(langs)).alias("language"),
        F.col("l_quantity").cast("bigint").alias("stars"),
        (F.col("l_orderkey") % 7).alias("forks"),
        F.array(_pick(topics, F.col("l_partkey") % len(topics)),
                F.concat(F.lit("topic"), _s(F.col("l_orderkey") % 5))).alias("topics"),
        F.row_number().over(w).alias("pos"),
    )


#: (factor, offset) of a document's choices: choice number (factor * doc_id + offset) modulo the number of targets,
#: the roles and EMPTY_CHOICES, of which the last mean no target.
CHOICES = [(3, 1), (5, 2)]
EMPTY_CHOICES = 3


def choices(docs: DataFrame, n_targets: int, id_of) -> DataFrame:
    """CHOICES(doc_id, target_id, role): two choices of a target text, a bare role or nothing for each document.

    Choice r < ``n_targets`` is the text ``id_of(r)`` (with a role beside it that must not count), the next ones are the
    roles alone, the last ones nothing."""
    roles = _arr(L.ROLE_NAMES)
    n_roles = len(L.ROLE_NAMES)
    parts = []
    for factor, offset in CHOICES:
        r = F.pmod(F.col("doc_id") * factor + offset, F.lit(n_targets + n_roles + EMPTY_CHOICES))
        parts.append(F.struct(r.alias("r")))
    d = docs.select("doc_id", F.explode(F.array(*parts)).alias("c")).select("doc_id", F.col("c.r").alias("r"))
    role = F.when(F.col("r") < n_targets + n_roles, F.element_at(roles, (F.pmod(F.col("r") - n_targets, F.lit(n_roles)) + 1).cast("int")))
    return d.select("doc_id", F.when(F.col("r") < n_targets, id_of(F.col("r"))).cast("long").alias("target_id"), role.alias("role"))


def brand_id(r):
    """The r-th brand number: 11 to 15, 21 to 25, and so on."""
    return (F.floor(r / 5) + 1) * 10 + r % 5 + 1


N_BRANDS = 25
