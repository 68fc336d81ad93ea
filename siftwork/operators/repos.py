"""Repository profile: URL parsing, owner rollups, tech stack and generated lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dims
from ..functions import lexicons as L
from ..functions import text as T

REPO_URL = r"github\.com/([^/]+)/([^/]+)"
OWNER_URL = r"github\.com/([^/]+)$"


def parse_repo_url(url: Column) -> list[Column]:
    """kind (repo|profile|invalid), owner, repo: strip, drop trailing '/', two-part pattern first."""
    u = F.regexp_replace(T.py_strip(url), "/+$", "")
    two = u.rlike(REPO_URL)
    one = u.rlike(OWNER_URL)
    kind = F.when(two, "repo").when(one, "profile").otherwise("invalid")
    owner = F.when(two, F.regexp_extract(u, REPO_URL, 1)).when(one, F.regexp_extract(u, OWNER_URL, 1))
    repo = F.when(two, F.regexp_extract(u, REPO_URL, 2))
    return [kind.alias("kind"), owner.alias("owner"), repo.alias("repo")]


def repo_url_rollup(urls: DataFrame, url_col: str = "url") -> DataFrame:
    p = urls.select(*parse_repo_url(F.col(url_col)))
    return p.groupBy("kind", "owner").agg(F.count(F.lit(1)).alias("n_urls"), F.countDistinct("repo").alias("n_repos"))


def owner_languages_topk(repos: DataFrame, k: int = 6) -> DataFrame:
    """Per owner: repositories per language, best k; ties by first appearance."""
    per = repos.where(F.col("language").isNotNull() & (F.col("language") != "")) \
        .groupBy("owner", "language").agg(F.count(F.lit(1)).alias("n_repos"), F.min("pos").alias("first_pos"))
    w = Window.partitionBy("owner").orderBy(F.col("n_repos").desc(), F.col("first_pos").asc())
    return per.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def owner_star_rollup(repos: DataFrame) -> DataFrame:
    """Total stars, repositories and distinct topics per owner (all partial aggregates)."""
    stars = repos.groupBy("owner").agg(F.sum("stars").alias("total_stars"), F.count(F.lit(1)).alias("n_repos"))
    topics = repos.select("owner", F.explode("topics").alias("topic")).groupBy("owner") \
        .agg(F.countDistinct("topic").alias("n_topics"))
    return stars.join(topics, "owner", "left").na.fill(0, ["n_topics"])


def owner_top_repos(repos: DataFrame, k: int = 5) -> DataFrame:
    w = Window.partitionBy("owner").orderBy(F.col("stars").desc(), F.col("pos").asc())
    return repos.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _with_row_techs(repos: DataFrame) -> DataFrame:
    """``repos`` with ``_techs``, the technologies that a row names itself: its language, the skills of its topics (exact,
    lower) and of the topics that stand in its lower description. No row is multiplied by the few fixed topics. Each
    step is made once, and what is costly stands outside of lambdas, which are not compiled."""
    d = T.once(repos, "_desc", F.lower(F.coalesce("description", F.lit(""))))
    d = T.once(d, "_topics", F.transform("topics", F.lower))
    skills = [F.when(F.col("_desc").contains(t) | F.array_contains("_topics", t), F.lit(skill)) for t, skill in L.TOPIC_SKILLS]
    distinct = F.array_except(F.array("language", *skills), F.array(F.lit(None).cast("string")))
    return T.once(d, "_techs", F.sort_array(distinct)).drop("_desc", "_topics")


def tech_stack(repos: DataFrame, spark: SparkSession, of_rows: bool = False) -> DataFrame:
    """Per repository: language U mapped topics (exact) U mapped keywords found as a substring of
    the lower description; sorted distinct. Repositories without any are left out.

    With ``of_rows``: every row of ``repos`` with the ``tech_stack`` of its repository beside it, in one shuffle on
    (owner, name); a row without owner or name has none, as it would find none by a join."""
    if not of_rows:
        techs = _with_row_techs(repos).where(F.size("_techs") > 0)
        return techs.groupBy("owner", "name").agg(_union(F.collect_set("_techs")).alias("tech_stack"))
    unkeyed = F.col("owner").isNull() | F.col("name").isNull()
    rows = _with_row_techs(repos)
    # rows without a key are dealt by what they hold, not all to one task
    rows = rows.withColumn("_apart", F.when(unkeyed, F.xxhash64("owner", "name", "description", "stars", "forks")))
    w = Window.partitionBy("owner", "name", "_apart")
    rows = T.once(rows.withColumn("_sets", F.collect_set("_techs").over(w)), "_sets", F.col("_sets"))
    stack = F.when(unkeyed, F.array().cast("array<string>")).when(F.size("_sets") == 1, F.get("_sets", F.lit(0))).otherwise(_union(F.col("_sets")))
    return rows.withColumn("tech_stack", stack).drop("_techs", "_apart", "_sets")


def _union(techs: Column) -> Column:
    return F.sort_array(F.array_distinct(F.flatten(techs)))


def expand_skills(stacks: DataFrame, spark: SparkSession) -> DataFrame:
    """Each technology plus the related skills of every language whose lower name occurs in it."""
    ls = dims.language_skills(spark)
    techs = stacks.select("owner", "name", F.explode("tech_stack").alias("tech"))
    rel = techs.join(F.broadcast(ls), F.lower("tech").contains(F.lower("language"))).select(
        "owner", "name", F.col("related").alias("skill"))
    u = techs.select("owner", "name", F.col("tech").alias("skill")).unionByName(rel).distinct()
    return u.groupBy("owner", "name").agg(F.array_sort(F.collect_list("skill")).alias("skills"))


def _title_name(name: Column) -> Column:
    return T.python_title(F.translate(name, "-_", "  "))


def repo_lines(repos: DataFrame, stacks: DataFrame | None = None) -> DataFrame:
    """Up to three generated lines per repository from templates and conditions; without ``stacks``, ``repos`` holds
    ``tech_stack`` itself."""
    t = L.REPO_LINE_TEMPLATES
    j = repos if stacks is None else repos.join(stacks, ["owner", "name"], "left")
    j = T.once(j, "_stack", F.coalesce(F.col("tech_stack"), F.array().cast("array<string>")))
    j = T.once(j, "_name", _title_name(F.col("name")))
    name, stack = F.col("_name"), F.col("_stack")
    tech = F.when(F.size(stack) > 0, F.array_join(F.slice(stack, 1, 4), ", ")).otherwise(F.lit(t["no_tech"]))
    desc = F.coalesce(F.col("description"), F.lit(""))
    metrics = F.concat_ws(" and ",
        F.when(F.col("stars") > 0, F.concat(F.col("stars").cast("string"), F.lit(" GitHub stars"))),
        F.when(F.col("forks") > 0, F.concat(F.col("forks").cast("string"), F.lit(" forks"))))
    lines = F.array(
        F.when(desc != "", T.filled(t["described"], name=name, description=F.regexp_replace(desc, r"\.+$", ""), tech=tech))
        .otherwise(T.filled(t["bare"], name=name, tech=tech)),
        F.when((F.col("stars") > 0) | (F.col("forks") > 0), T.filled(t["open"], name=name, metrics=metrics)),
        F.when(F.size(stack) >= 3, T.filled(t["depth"], name=name, tech3=F.array_join(F.slice(stack, 1, 3), ", "))))
    # the texts outside of the filter, whose inside is not compiled
    j = T.once(j, "_lines", lines)
    return j.select("owner", "name", F.slice(F.filter("_lines", lambda x: x.isNotNull()), 1, 3).alias("lines"))


def owner_lines(repos: DataFrame) -> DataFrame:
    """Up to three generated lines per owner: number of repositories and the four commonest languages, stars if there are
    any, and the most starred repository if it is described (its name with "-" as space, title-cased).

    Made of the owner's aggregates, each pre-aggregated or pre-cut before its shuffle; all joined on the owner."""
    t = L.REPO_LINE_TEMPLATES
    langs = owner_languages_topk(repos, 4).groupBy("owner").agg(F.array_sort(F.collect_list(F.struct("rank", "language"))).alias("_l"))
    top = owner_top_repos(repos, 1).select("owner", F.col("name").alias("_top"), F.coalesce("description", F.lit("")).alias("_desc"))
    totals = repos.groupBy("owner").agg(F.count(F.lit(1)).alias("_n"), F.coalesce(F.sum("stars"), F.lit(0)).alias("_stars"))
    j = totals.join(langs, "owner", "left").join(top, "owner", "left")
    names = F.coalesce(F.array_join(F.transform("_l", lambda x: x["language"]), ", "), F.lit(t["profile_no_lang"]))
    title = T.python_title(F.translate(F.col("_top"), "-", " "))
    lines = F.filter(F.array(
        T.filled(t["profile"], n=F.col("_n"), langs=names),
        F.when(F.col("_stars") > 0, T.filled(t["stars"], stars=F.col("_stars"))),
        F.when(F.col("_desc") != "", T.filled(t["featured"], name=title, description=F.regexp_replace("_desc", r"\.+$", ""))),
    ), lambda x: x.isNotNull())
    return j.select("owner", lines.alias("lines"))
