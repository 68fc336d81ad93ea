"""Registered queries: name -> (Spark builder, oracle SQL).

Each builder takes (spark, sf_dir) and returns a DataFrame over the given
tables (or corpora Spark derives from them).  Each SQL string computes the same
result in DuckDB over the pre-registered views.  Output columns are scalars
(arrays joined with ',' or '|') so that both sides hash the same way.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from ..operators import match as M
from ..sources import corpus as C
from ..session import checkpoint_dir, materialise
from ..sources import derived as D
from ..functions import dims
from ..operators import extract as X
from ..operators import score as SC
from ..operators import screen as SCR
from ..operators import rewrite as RW
from ..operators import advise as AD
from ..streaming import stream as ST
from ..operators import keywords as KW
from ..operators import repos as RE
from ..operators import sketches as SK
from ..operators import vectors as VX
from ..operators import versions as VE
from . import features as FE
from . import sqlfeatures as SF
from . import report as RP
from . import sqltext as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _normalize(df: DataFrame) -> DataFrame:
    """Widen integer columns to bigint and float to double, so both engines report one schema."""
    from pyspark.sql import types as TY
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (TY.IntegerType, TY.ShortType, TY.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, TY.FloatType):
            c = c.cast("double")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def register(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return _normalize(fn(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _docs(spark, sf):
    return C.spread(C.load(spark, sf, "documents"))


def _clean_docs(spark, sf):
    return _docs(spark, sf).select("doc_id", "source", "lang", T.clean_text("text").alias("text"))


def _clean_bench(spark, sf):
    return C.load(spark, sf, "benchmark").select(F.col("item_id").alias("target_id"),
                                                  T.clean_text("text").alias("text"))


# ---------------------------------------------------------------- 2.1 sources
@register("clean_text", f"""
select doc_id, source, length(ct) as clean_chars, {S.replaced('text')} as replaced_chars,
       (ct <> coalesce(text, '')) as changed, md5(ct) as clean_md5
from (select *, {S.clean('text')} as ct from documents)
""")
def q_clean_text(spark, sf):
    c = C.clean_text(_docs(spark, sf))
    return c.select("doc_id", "source", F.length("clean_text").alias("clean_chars"), "replaced_chars", "changed",
                    F.md5("clean_text").alias("clean_md5"))


@register("admit_documents", f"""
select source, case when n = 0 then 'empty' when n < {L.MIN_DOCUMENT_CHARS} then 'too_short' else 'ok' end as reason,
       count(*) as n_docs
from (select source, length({S.strip("coalesce(text, '')")}) as n from documents) group by all
""")
def q_admit(spark, sf):
    return C.admission_counts(_docs(spark, sf))


# ---------------------------------------------------------------- assignments of documents to targets
_PAIRS, _TEXTS = S.assign_sql("documents", "btarg", "(select count(*) from benchmark)", "r")
DOC_PAIRS = f"""btarg as (select item_id as target_id, {S.clean('text')} as text from benchmark),
assign as materialized ({_PAIRS}), etarg as ({_TEXTS})"""
_PAIRS, _TEXTS = S.assign_sql("(select c_custkey as doc_id from customer)", "targ", str(D.N_BRANDS), "(r // 5 + 1) * 10 + r % 5 + 1")
CAND_PAIRS = f"assign as materialized ({_PAIRS}), etarg as materialized ({_TEXTS})"


def _every_sql(pairs: str, docs: str, targets: str) -> str:
    """``pairs`` (CTEs with an assignment), its relation widened to every document with every target text."""
    given = f"select distinct target_id from {targets} where {S.strip("coalesce(text, '')")} <> '' and target_id is not null"
    more = f"select d.doc_id, t.target_id, 'text' as target_kind from {docs} d, ({given}) t"
    return pairs.replace("assign as materialized (", f"assign as materialized ({more} union ", 1)


EVERY_DOC_PAIR = _every_sql(DOC_PAIRS, "documents", "btarg")
EVERY_CAND_PAIR = _every_sql(CAND_PAIRS, "(select c_custkey as doc_id from customer)", "targ")


def _doc_pairs(spark, sf):
    """Assignment of the documents to the benchmark texts, roles or nothing, and the target texts."""
    bench = _clean_bench(spark, sf)
    return C.resolve_targets(D.choices(_docs(spark, sf), bench.count(), lambda r: r), bench, spark)


def _cand_pairs(spark, sf):
    """The same of the candidates to the brands' targets."""
    ids = C.load(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"))
    pairs, texts = C.resolve_targets(D.choices(ids, D.N_BRANDS, D.brand_id), _targ(spark, sf), spark)
    return pairs, materialise(texts)


def _every_doc_pair(spark, sf):
    """Every document with every benchmark text, and the roles or nothing that were chosen for it; the target texts."""
    pairs, texts = _doc_pairs(spark, sf)
    return C.every_pair(pairs, _docs(spark, sf), texts), texts


def _every_cand_pair(spark, sf):
    """The same of the candidates and the brands' targets."""
    pairs, texts = _cand_pairs(spark, sf)
    ids = C.load(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"))
    return C.every_pair(pairs, ids, texts), texts


@register("resolve_targets", f"""with {DOC_PAIRS}
select a.doc_id, a.target_id, a.target_kind, md5(e.text) as effective_md5, length(e.text) as effective_chars
from assign a left join etarg e using (target_id)""")
def q_resolve_targets(spark, sf):
    pairs, texts = _doc_pairs(spark, sf)
    j = pairs.join(texts.select("target_id", "text"), "target_id", "left")
    return j.select("doc_id", "target_id", "target_kind", F.md5("text").alias("effective_md5"), F.length("text").alias("effective_chars"))


# ---------------------------------------------------------------- 2.3 matching
_DENSITY_SQL = f"""
with tw as (
  select distinct item_id as target_id, w as word
  from (select item_id, unnest(regexp_extract_all(lower({S.clean('text')}), {S.q(M.TARGET_WORD)})) as w from benchmark)
  where w not in (select unnest({S.lst(L.DENSITY_STOPWORDS)}))
),
d as (select doc_id, lower({S.clean('text')}) as lt from documents),
hits as (select d.doc_id, tw.target_id, tw.word from d join tw on contains(d.lt, tw.word)),
tot as (select target_id, count(*) as total_words, list_sort(list(word)) as words from tw group by target_id),
pairs as (select doc_id, target_id, count(*) as matched_count, list(word) as matched from hits group by all)
select p.doc_id, p.target_id, p.matched_count, t.total_words,
       round(p.matched_count / greatest(t.total_words, 1) * 100, 1) as density_percent,
       array_to_string(list_filter(t.words, lambda x: not list_contains(p.matched, x)), ',') as top_missing
from pairs p join tot t using (target_id)
"""


def _assigned_density_sql(text: str) -> str:
    """Density of every assigned pair; ``text`` is SQL of the document's text."""
    return f"""(with w as (select target_id, list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), {S.q(M.TARGET_WORD)}),
    lambda x: not list_contains({S.lst(L.DENSITY_STOPWORDS)}, x)))) as words from etarg),
  j as (select a.doc_id, a.target_id, w.words, list_filter(w.words, lambda x: not contains(lower({text}), x)) as missing
    from assign a left join w using (target_id) left join documents d on d.doc_id = a.doc_id)
  select doc_id, target_id, coalesce(len(words) - len(missing), 0) as matched_count, coalesce(len(words), 0) as total_words,
    round((len(words) - len(missing)) / greatest(len(words), 1) * 100, 1) as density_percent,
    coalesce(array_to_string(missing, ','), '') as top_missing, coalesce(missing, []) as top_missing_list from j)"""


@register("keyword_density", f"""with {EVERY_DOC_PAIR} select * exclude (top_missing_list) from {_assigned_density_sql(S.clean('d.text'))}""")
def q_density(spark, sf):
    pairs, texts = _doc_pairs(spark, sf)
    return M.every_density(_clean_docs(spark, sf), texts, pairs)


@register("density_top5", f"""
select target_id, rank, doc_id, density_percent from (
  select *, row_number() over (partition by target_id order by density_percent desc, doc_id) as rank
  from ({_DENSITY_SQL})) where rank <= 5
""")
def q_density_top5(spark, sf):
    d = M.keyword_density(_clean_docs(spark, sf), _clean_bench(spark, sf), spark)
    return M.top_k_per_target(d, "density_percent", 5).select("target_id", "rank", "doc_id", "density_percent")



def _cand(spark, sf):
    return D.cand(spark, sf)


def _cand_once(spark, sf):
    """The candidates, made once, for queries that read them in several branches."""
    return materialise(D.cand(spark, sf))


def _targ(spark, sf):
    return D.targ(spark, sf)


CAND = f"cand as ({S.cand_sql()})"
TARG = f"targ as ({S.targ_sql()})"
CLEAN_DOCS = f"cdocs as (select doc_id, source, lang, {S.clean('text')} as text from documents)"
LEX_MATCH = f"""lexm as (select distinct doc_id, category, canonical from cand,
  {S.lexicon_values()} where contains(' ' || {S.norm('cand.text')} || ' ', ' ' || lex.norm || ' '))"""


# ---------------------------------------------------------------- 2.2 text -> tables
@register("explode_lines", f"""
with {CLEAN_DOCS}, l as (select doc_id, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) as pos,
                            unnest(string_split(text, chr(10))) as raw from cdocs)
select doc_id, pos, {S.strip('raw')} as line from l
""")
def q_explode_lines(spark, sf):
    return X.explode_lines(_clean_docs(spark, sf))


@register("extract_bullets", f"""
with {CAND}, b as (select doc_id, {SF.bullets('text')} as bl from cand)
select doc_id, unnest(generate_series(1, len(bl))) as bullet_no, unnest(bl) as bullet from b
""")
def q_extract_bullets(spark, sf):
    return X.extract_bullets(_cand(spark, sf))


@register("bullet_line_count", f"""
with {CAND} select doc_id, {SF.bullet_count('text', X.SCREEN_BULLET)} as screen_bullets,
  {SF.bullet_count('text', X.FEEDBACK_BULLET)} as feedback_bullets from cand
""")
def q_bullet_line_count(spark, sf):
    t = F.col("text")
    return _cand(spark, sf).select("doc_id", X.bullet_line_count(t, X.SCREEN_BULLET).alias("screen_bullets"),
                                   X.bullet_line_count(t, X.FEEDBACK_BULLET).alias("feedback_bullets"))


@register("extract_sentences", f"""
with {CLEAN_DOCS}, s as (select doc_id, {SF.sentences('text')} as sl from cdocs)
select doc_id, unnest(generate_series(1, len(sl))) as sent_no, unnest(sl) as sentence from s
""")
def q_extract_sentences(spark, sf):
    return X.extract_sentences(_clean_docs(spark, sf))


@register("lexicon_match", f"with {CAND}, {LEX_MATCH} select * from lexm")
def q_lexicon_match(spark, sf):
    return X.lexicon_match(_cand(spark, sf), spark)


@register("term_frequency_by_category", f"""
with {CAND}, {LEX_MATCH} select category, canonical, count(distinct doc_id) as n_docs from lexm group by all
""")
def q_term_freq(spark, sf):
    return X.term_frequency_by_category(X.lexicon_match(_cand(spark, sf), spark))


def _case_norm_sql(x):
    t = f"regexp_replace({x}, '([^A-Za-z0-9 \\t\\n\\r\\f\\x0B])', ' \\1 ', 'g')"
    t = f"regexp_replace({t}, '\\n', ' ' || chr(10) || ' ', 'g')"
    t = f"regexp_replace({t}, '[ \\t\\r\\f\\x0B]+', ' ', 'g')"
    return f"regexp_replace({t}, '^ +| +$', '', 'g')"


@register("gazetteer_entities", f"""
with {CAND}, g as (select name, ord, {_case_norm_sql('name')} as gnorm
                   from {S.values([(n, i) for i, n in enumerate(L.GAZETTEER)], "gz(name, ord)")} where length(name) > 2),
h as (select doc_id, name, ord, strpos(' ' || {_case_norm_sql('text')} || ' ', ' ' || gnorm || ' ') as p from cand, g)
select doc_id, string_agg(name, '|' order by p, ord) as entities from h where p > 0 group by doc_id
""")
def q_gazetteer(spark, sf):
    return X.gazetteer_entities(_cand(spark, sf), spark)


@register("section_presence", f"with {CAND} select doc_id, {SF.section_cols('text')} from cand")
def q_section_presence(spark, sf):
    return X.section_presence(_cand(spark, sf))


@register("section_coverage", f"""
with {CAND}, p as (select doc_id, {SF.section_cols('text')} from cand),
u as (unpivot p on {", ".join("has_" + k for k, _ in L.SECTION_PATTERNS)} into name section value present)
select replace(section, 'has_', '') as section, count(*) as n_docs, sum(present::int)::bigint as n_present,
       round(avg(present::int), 6) as share from u group by all
""")
def q_section_coverage(spark, sf):
    return X.section_coverage(X.section_presence(_cand(spark, sf)))


@register("verb_usage", f"""
with {CAND}, v as ({SF.verb_usage('cand')})
select doc_id, array_to_string(strong_verbs, '|') as strong_verbs, array_to_string(weak_verbs, '|') as weak_verbs,
       n_strong, n_weak from v
""")
def q_verb_usage(spark, sf):
    v = X.verb_usage(_cand(spark, sf), spark)
    return v.select("doc_id", F.array_join("strong_verbs", "|").alias("strong_verbs"),
                    F.array_join("weak_verbs", "|").alias("weak_verbs"), "n_strong", "n_weak")


@register("readability", f"with {CLEAN_DOCS} select doc_id, {SF.readability_cols('text')} from cdocs")
def q_readability(spark, sf):
    return X.readability(_clean_docs(spark, sf))


@register("readability_by_group", f"""
with {CLEAN_DOCS}, r as (select doc_id, lang, source, {SF.readability_cols('text')} from cdocs)
select lang, source, count(*) as n_docs, round(avg(flesch_kincaid_score), 6) as avg_fk,
  quantile_cont(flesch_kincaid_score, 0.5) as median_fk, round(avg(avg_words_per_sentence), 6) as avg_wps,
  min(flesch_kincaid_score) as min_fk, max(flesch_kincaid_score) as max_fk
from r group by rollup(lang, source)
""")
def q_readability_by_group(spark, sf):
    d = _clean_docs(spark, sf)
    r = d.select("doc_id", "lang", "source", *X.readability_columns(F.col("text")))
    return X.readability_by_group(r, "lang", "source")


@register("readability_by_group_merged")
def q_readability_merged(spark, sf):
    """The same groups from the mergeable parts of each source and language, without reading a document twice."""
    d = _clean_docs(spark, sf)
    parts = SK.readability_parts(d.select("doc_id", "lang", "source", *X.readability_columns(F.col("text"))), "lang", "source")
    return SK.merged_readability(parts, "lang", "source").select("lang", "source", "n_docs", F.round("avg_fk", 6).alias("avg_fk"), "median_fk", "min_fk", "max_fk")


@register("quantification_count", f"with {CLEAN_DOCS} select doc_id, {S.rcount('text', r'\b\d+\b')} as quant_count from cdocs")
def q_quant(spark, sf):
    return X.quantification_count(_clean_docs(spark, sf))


@register("contact_signals", f"with {CLEAN_DOCS} select doc_id, {SF.contact_cols('text')} from cdocs")
def q_contact(spark, sf):
    return X.contact_signals(_clean_docs(spark, sf))


IGNORE_SQL = S.lst(sorted(set(KW.rake_ignore())))


def _rake_occ_sql(src, idc="doc_id", name="occ"):
    toks = f"regexp_extract_all(lower(text), {S.q(KW.WORDPUNCT)})"
    marked = f"list_transform({toks}, lambda x: case when list_contains({IGNORE_SQL}, x) then chr(1) else x end)"
    phrases = f"list_filter(regexp_split_to_array(array_to_string({marked}, ' '), '( ?' || chr(1) || ' ?)+'), lambda p: p <> '')"
    return f"""{name} as (select {idc}, unnest(generate_series(0, len(ph) - 1)) as ph_idx, unnest(ph) as phrase
                from (select {idc}, {phrases} as ph from {src}))"""


def _noise_sql(p):
    verbs = S.lst([v.lower() for v in L.WEAK_VERBS + L.ACTION_VERBS])
    stop = S.lst(L.english_stopwords())
    return f"""(length({p}) < 2 or regexp_matches({p}, {S.q(KW._alternation(L.BLACKLIST))})
  or regexp_matches({p}, {S.q(KW._alternation(L.MONTH_ABBREVIATIONS))}) or regexp_matches({p}, '\\b(19|20)\\d{{2}}\\b')
  or regexp_matches({p}, '^[0-9]+$') or len(regexp_extract_all({p}, '[0-9]')) > length({p}) * 0.4
  or list_contains({verbs}, {p}) or len(list_filter(string_split({p}, ' '), lambda t: not list_contains({stop}, t))) = 0)"""


def _cands_sql(idc="doc_id", occ="occ", name="cands"):
    return f"""{name} as (select {idc}, candidate, count(*) as n from (select {idc}, {S.strip('phrase')} as candidate from {occ})
  where length(candidate) > 2 and length(candidate) < 30 and not {_noise_sql('candidate')} group by all)"""


CANDS_SQL = _cands_sql()


def _title_sql(x):
    return f"array_to_string(list_transform(regexp_extract_all({x}, '[A-Za-z]+|[^A-Za-z]+'), lambda p: upper(p[1]) || lower(p[2:])), '')"


def _repeated_sql(src, idc, lex, name):
    """CTEs ending in ``name``: the repeated phrases of ``src`` that ``lex`` doesn't hold."""
    return f"""{_rake_occ_sql(src, idc, name + '_occ')}, {_cands_sql(idc, name + '_occ', name + '_cands')},
{name} as (select {idc}, candidate, canonical from (select {idc}, candidate, coalesce(m.v, {_title_sql('candidate')}) as canonical from {name}_cands
    left join {S.values(list(L.NORMALIZATION.items()), "m(k, v)")} on m.k = candidate where n > 1) nm
  where not exists (select 1 from {lex} l where l.{idc} = nm.{idc} and lower(l.canonical) = lower(nm.canonical))
    and candidate not in (select unnest({S.lst(L.WEAK_SKILLS)})))"""


# the terms of either side: lexicon matches and repeated phrases
DTERM = f"""{_repeated_sql('cand', 'doc_id', 'lexm', 'drep')},
dterm as materialized (select doc_id, category, canonical from lexm union select doc_id, 'technical', canonical from drep)"""
TTERM = f"""{_repeated_sql('etarg', 'target_id', 'tlexm', 'trep')},
tterm as materialized (select target_id, category, canonical from tlexm union select target_id, 'technical', canonical from trep)"""


DOMAIN_SQL = f"""
dom as (
  with kw as (select * from {S.values([(d, i, k) for i, (d, ks) in enumerate(L.DOMAINS) for k in ks], "kw(domain, ord, keyword)")}),
  tech as (select doc_id, lower(canonical) as skill from dterm where category = 'technical'),
  w as (select doc_id, skill, domain, ord, max(case when skill = keyword then 1.0 else 0.5 end) as w
        from tech join kw on skill = keyword or (length(keyword) > 3 and contains(skill, keyword)) group by all),
  pd as (select doc_id, domain, ord, sum(w) as score from w group by all),
  best as (select doc_id, arg_min(domain, (-score, ord)) as domain, max(score) as domain_score from pd group by doc_id)
  select cand.doc_id, coalesce(domain, {S.q(L.DEFAULT_DOMAIN)}) as domain, coalesce(domain_score, 0.0) as domain_score
  from cand left join best using (doc_id))"""


@register("domain_inference", f"with {CAND}, {LEX_MATCH}, {DTERM}, {DOMAIN_SQL} select * from dom")
def q_domain(spark, sf):
    c = _cand_once(spark, sf)
    return X.domain_inference(RP.all_terms(c, spark), spark, c)



# ---------------------------------------------------------------- 2.3 document x target
TLEX_MATCH = f"""tlexm as (select distinct target_id, category, canonical from etarg,
  {S.lexicon_values()} where contains(' ' || {S.norm('etarg.text')} || ' ', ' ' || lex.norm || ' '))"""

COVERAGE_SQL = f"""
{DTERM}, {TTERM},
cov as (
  with k as (select target_id, list_sort(list(distinct canonical)) as k from tterm group by target_id),
  d as (select doc_id, list(distinct canonical) as d, list_sort(coalesce(list(distinct canonical) filter (where category = 'technical'), [])) as tech
    from dterm group by doc_id),
  sub as (select doc_id, list(canonical) as s from cand join (select distinct canonical from tterm) c
    on contains(lower(cand.text), lower(c.canonical)) group by doc_id),
  j as (select a.doc_id, a.target_id, k.k, coalesce(d.d, []) as d, coalesce(sub.s, []) as s, coalesce(d.tech, []) as tech
    from assign a left join k using (target_id) left join d using (doc_id) left join sub using (doc_id)),
  m as (select doc_id, target_id, k, tech, list_filter(k, lambda x: list_contains(d, x)) as e,
      list_filter(k, lambda x: not list_contains(d, x) and list_contains(s, x)) as b,
      list_filter(k, lambda x: not list_contains(d, x) and not list_contains(s, x)) as x from j)
  select doc_id, target_id, len(k) as total_keywords, len(e) + len(b) as matched_count, len(x) as missing_count,
    round(len(e) / len(k), 3) as coverage_ratio,
    case when k is null then {L.NO_TARGET_COVERAGE} else least(1.0, len(e) / len(k) + len(b) * (0.5 / len(k))) end as keyword_coverage,
    case when k is not null then list_sort(list_concat(e, b)) when target_id is null then tech else [] end as matched,
    coalesce(x, []) as missing from m)"""


def _coverage(spark, sf, c=None, terms=None):
    """Coverage of the candidates' pairs; ``c`` and ``terms`` are the candidates and their terms, if they are made already."""
    c = _cand_once(spark, sf) if c is None else c
    pairs, texts = _cand_pairs(spark, sf)
    tterms = materialise(RP.target_terms(texts, spark))  # read twice
    return M.keyword_coverage(RP.all_terms(c, spark) if terms is None else terms, tterms, c, pairs)


@register("keyword_coverage", f"""
with {CAND}, {TARG}, {CAND_PAIRS}, {LEX_MATCH}, {TLEX_MATCH}, {COVERAGE_SQL}
select doc_id, target_id, total_keywords, matched_count, missing_count, coverage_ratio,
  round(keyword_coverage, 6) as keyword_coverage, array_to_string(matched, '|') as matched,
  array_to_string(missing, '|') as missing from cov
""")
def q_coverage(spark, sf):
    k = _coverage(spark, sf)
    return k.select("doc_id", "target_id", "total_keywords", "matched_count", "missing_count", "coverage_ratio",
                    F.round("keyword_coverage", 6).alias("keyword_coverage"),
                    F.array_join("matched", "|").alias("matched"), F.array_join("missing", "|").alias("missing"))


STOP_SQL = S.lst(L.english_stopwords())


def _tfidf_terms_sql(name, src, idc, textexpr):
    toks = f"list_filter(regexp_extract_all(lower({textexpr}), {S.q(M.TFIDF_TOKEN)}), lambda x: not list_contains({STOP_SQL}, x))"
    return f"""{name} as (
  with tk as (select {idc} as id, {toks} as t from {src}),
  g as (select id, unnest(flatten([t,
          list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]),
          list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])])) as term from tk)
  select id, term, count(*) as c from g group by all)"""


def _tfidf_sql(dterms, tterms):
    return f"""tfidf as (
  with nd as (select id as doc_id, sum(c * c) as n from {dterms} group by id),
  nt as (select id as target_id, sum(c * c) as n from {tterms} group by id),
  sh as (select a.doc_id, a.target_id, sum(d.c * t.c) as dot, sum(d.c * d.c) as sd, sum(t.c * t.c) as st
    from assign a join {dterms} d on d.id = a.doc_id join {tterms} t on t.id = a.target_id and t.term = d.term group by all)
  select a.doc_id, a.target_id, case when a.target_id is not null then coalesce(round(dot::double
    / sqrt(sd + (nd.n - sd) * pow({M.IDF_ONE_SIDE!r}::double, 2)) / sqrt(st + (nt.n - st) * pow({M.IDF_ONE_SIDE!r}::double, 2)), 6), 0.0) end
    as tfidf_similarity
  from assign a left join sh using (doc_id, target_id) left join nd using (doc_id) left join nt using (target_id))"""


@register("tfidf_pair_similarity", f"""
with {EVERY_DOC_PAIR}, {_tfidf_terms_sql('dterms', 'documents', 'doc_id', S.clean('text'))},
{_tfidf_terms_sql('tterms', 'etarg', 'target_id', 'text')},
{_tfidf_sql('dterms', 'tterms')}
select * from tfidf
""")
def q_tfidf(spark, sf):
    pairs, texts = _every_doc_pair(spark, sf)
    d = M.tfidf_terms(_clean_docs(spark, sf), "doc_id", spark)
    return M.tfidf_pair_similarity(d, M.tfidf_terms(texts, "target_id", spark), pairs, every=True)


EMB_SQL = """
emb as (select a.doc_id, a.target_id, case when a.target_id is not null then coalesce(
    list_cosine_similarity(x.embedding::double[], y.embedding::double[]), 0.0) end as semantic_similarity
  from assign a left join embeddings x on x.vec_id = a.doc_id left join embeddings y on y.vec_id = a.target_id)"""


@register("embedding_similarity", f"with {EVERY_DOC_PAIR}, {EMB_SQL} select doc_id, target_id, round(semantic_similarity, 6) as semantic_similarity from emb")
def q_embedding(spark, sf):
    pairs, texts = _every_doc_pair(spark, sf)
    e = M.embedding_similarity(pairs.select("doc_id", "target_id"), C.load(spark, sf, "embeddings"), targets=texts)
    return e.select("doc_id", "target_id", F.round("semantic_similarity", 6).alias("semantic_similarity"))


QUERY_STEP = 20


@register("embedding_topk", f"""
with v as (select vec_id, embedding::double[] as e from embeddings),
s as (select q.vec_id as query_id, v.vec_id, round(list_cosine_similarity(q.e, v.e), 6) as similarity
  from v q join v on q.vec_id <> v.vec_id where q.vec_id % {QUERY_STEP} = 0)
select query_id, rank, vec_id, similarity from (
  select *, row_number() over (partition by query_id order by similarity desc, vec_id) as rank from s) where rank <= 5
""")
def q_embedding_topk(spark, sf):
    """The 5 nearest of all vectors for every vector whose id is divisible by 20, through the index, exactly."""
    v = C.load(spark, sf, "embeddings")
    return VX.nearest(VX.build_index(v), v.where(F.col("vec_id") % QUERY_STEP == 0), k=5)


@register("blended_similarity", f"""
with {EVERY_DOC_PAIR}, {EMB_SQL}, {_tfidf_terms_sql('dterms', 'documents', 'doc_id', S.clean('text'))},
{_tfidf_terms_sql('tterms', 'etarg', 'target_id', 'text')}, {_tfidf_sql('dterms', 'tterms')}
select e.doc_id, e.target_id, case when e.target_id is null then {L.NO_TARGET_SIMILARITY}
  else round(0.7 * round(e.semantic_similarity, 6) + 0.3 * t.tfidf_similarity, 7) end as blended_similarity
from emb e join tfidf t on t.doc_id = e.doc_id and t.target_id is not distinct from e.target_id
""")
def q_blended(spark, sf):
    pairs, texts = _every_doc_pair(spark, sf)
    d = M.tfidf_terms(_clean_docs(spark, sf), "doc_id", spark)
    t = M.tfidf_pair_similarity(d, M.tfidf_terms(texts, "target_id", spark), pairs, every=True)
    e = M.embedding_similarity(t, C.load(spark, sf, "embeddings"), targets=texts)
    return e.select("doc_id", "target_id", M.blended_similarity(
        F.col("semantic_similarity"), F.col("tfidf_similarity"), F.col("target_id").isNotNull()).alias("blended_similarity"))


def _gap_sql_skills(src, idc):
    fams = ", ".join(f"regexp_extract_all(lower(text), {S.q(p)}, 1)" for p in L.SKILL_FAMILY_PATTERNS)
    return f"select {idc} as id, list_sort(list_distinct(list_transform(flatten([{fams}]), lambda x: lower(x)))) as skills from {src}"


GAP_SQL = f"""
gap as (
  with ds as ({_gap_sql_skills('cand', 'doc_id')}), ts as ({_gap_sql_skills('etarg', 'target_id')}),
  p as (select a.doc_id, a.target_id, coalesce(ts.skills, []) as required, coalesce(ds.skills, []) as own
    from assign a left join ds on ds.id = a.doc_id left join ts on ts.id = a.target_id)
  select doc_id, target_id, required, list_filter(required, lambda x: list_contains(own, x)) as present,
    list_filter(required, lambda x: not list_contains(own, x)) as missing,
    list_filter(own, lambda x: not list_contains(required, x)) as extra from p)"""


def _gaps(spark, sf, pairs_of=_cand_pairs):
    c = _cand(spark, sf)
    pairs, texts = pairs_of(spark, sf)
    return M.skill_gap(M.gap_skills(c, "doc_id"), M.gap_skills(texts, "target_id"), pairs), texts


@register("skill_gap", f"""
with {CAND}, {TARG}, {EVERY_CAND_PAIR}, {GAP_SQL}
select doc_id, target_id, array_to_string(required, ',') as required, array_to_string(present, ',') as present,
  array_to_string(missing, ',') as missing, array_to_string(extra, ',') as extra,
  round(len(present) / greatest(len(required), 1) * 100, 1) as match_percent from gap
""")
def q_skill_gap(spark, sf):
    g, _ = _gaps(spark, sf, _every_cand_pair)
    return g.select("doc_id", "target_id", *[F.array_join(c, ",").alias(c) for c in ("required", "present", "missing", "extra")],
                    "match_percent")


@register("gap_roadmap", f"""
with {CAND}, {TARG}, {CAND_PAIRS}, {GAP_SQL},
rm as (select * from {S.values([(k, i, tl) for i, (k, _, tl, _) in enumerate(L.LEARNING_ROADMAP)], "rm(key, ord, timeline)")}),
m as (select distinct unnest(missing) as skill from gap),
h as (select skill, arg_min(key, ord) as key, arg_min(timeline, ord) as timeline from m left join rm
      on contains(key, skill) or contains(skill, key) group by skill)
select skill, coalesce(key, {S.q(L.DEFAULT_ROADMAP[0])}) as roadmap, coalesce(timeline, {S.q(L.DEFAULT_ROADMAP[2])}) as timeline from h
""")
def q_gap_roadmap(spark, sf):
    m = _gaps(spark, sf)[0].select(F.explode("missing").alias("skill")).distinct()
    return M.gap_roadmap(m, spark).select("skill", "roadmap", "timeline")


@register("priority_skills", f"""
with {CAND}, {TARG}, {EVERY_CAND_PAIR}, {GAP_SQL},
mn as (select target_id, skill, len(regexp_extract_all(lower(text), {S.q(chr(92) + 'b' + chr(92) + 'Q')} || skill || {S.q(chr(92) + 'E' + chr(92) + 'b')})) as mentions
       from (select target_id, text, unnest(required) as skill from (select distinct target_id, required from gap) join etarg using (target_id))),
x as (select doc_id, target_id, unnest(missing) as skill from gap),
best as (select doc_id, target_id, array_to_string(list(skill order by mentions desc, skill)[1:5], ',') as s from x join mn using (target_id, skill) group by all)
select g.doc_id, g.target_id, coalesce(best.s, '') as priority_skills from gap g left join best using (doc_id, target_id)
""")
def q_priority(spark, sf):
    g, texts = _gaps(spark, sf, _every_cand_pair)
    p = M.priority_skills(g, M.skill_mentions(texts))
    return p.select("doc_id", "target_id", F.array_join("priority_skills", ",").alias("priority_skills"))


@register("skill_demand", f"""
with {CAND}, {TARG}, ds as ({_gap_sql_skills('cand', 'doc_id')}), ts as ({_gap_sql_skills('targ', 'target_id')}),
t as (select skill, count(*) as n_targets from (select unnest(skills) as skill from ts) group by all),
d as (select skill, count(*) as n_docs from (select unnest(skills) as skill from ds) group by all)
select coalesce(t.skill, d.skill) as skill, coalesce(n_targets, 0) as n_targets, coalesce(n_docs, 0) as n_docs,
  round(coalesce(n_targets, 0) / greatest(coalesce(n_docs, 0), 1), 6) as gap_ratio
from t full outer join d using (skill)
""")
def q_skill_demand(spark, sf):
    return M.skill_demand(M.gap_skills(_cand(spark, sf), "doc_id"), M.gap_skills(_targ(spark, sf), "target_id"))



# ---------------------------------------------------------------- 2.4 scoring
DDIM = f"ddim as ({SF.doc_dims('cand')})"


@register("section_score", f"""
with {CAND}, {DDIM} select doc_id, round(section_completeness, 9) as section_score,
  round(section_completeness * 100, 1) as section_completeness from ddim
""")
def q_section_score(spark, sf):
    d = RP.doc_dimensions(_cand(spark, sf), spark)
    return d.select("doc_id", F.round("section_completeness", 9).alias("section_score"),
                    F.round(F.col("section_completeness") * 100, 1).alias("section_completeness"))


@register("content_strength", f"""
with {CAND}, {DDIM} select doc_id, n_strong, n_weak, quant_count, word_count,
  round(content_strength, 9) as content_strength, round(content_strength * 100, 1) as content_strength_pct from ddim
""")
def q_content_strength(spark, sf):
    d = RP.doc_dimensions(_cand(spark, sf), spark)
    return d.select("doc_id", "n_strong", "n_weak", "quant_count", "word_count",
                    F.round("content_strength", 9).alias("content_strength"),
                    F.round(F.col("content_strength") * 100, 1).alias("content_strength_pct"))


@register("readability_score", f"""
with {CAND}, {DDIM} select doc_id, flesch_kincaid_score, avg_words_per_sentence,
  round(readability_score, 9) as readability_score from ddim
""")
def q_readability_score(spark, sf):
    d = RP.doc_dimensions(_cand(spark, sf), spark)
    return d.select("doc_id", "flesch_kincaid_score", "avg_words_per_sentence",
                    F.round("readability_score", 9).alias("readability_score"))


SCORED_SQL = f"""
{CAND}, {TARG}, {CAND_PAIRS}, {LEX_MATCH}, {TLEX_MATCH}, {COVERAGE_SQL}, {DDIM},
{_tfidf_terms_sql('dgram', 'cand', 'doc_id', 'text')}, {_tfidf_terms_sql('tgram', 'etarg', 'target_id', 'text')},
{_tfidf_sql('dgram', 'tgram')}, {EMB_SQL},
scored as (
  with p as (select c.*, t.tfidf_similarity, e.semantic_similarity
    from cov c join tfidf t on t.doc_id = c.doc_id and t.target_id is not distinct from c.target_id
    join emb e on e.doc_id = c.doc_id and e.target_id is not distinct from c.target_id),
  j as (select p.*, case when p.target_id is null then {L.NO_TARGET_SIMILARITY}::double
           else round(0.7::double * round(semantic_similarity, 6) + 0.3::double * round(tfidf_similarity, 6), 7) end
           as blended_similarity, d.* exclude (doc_id) from p join ddim d using (doc_id))
  select *, {SF.composite('blended_similarity', 'keyword_coverage', 'section_completeness', 'content_strength', 'readability_score')}
    as final_score from j)"""


def _scored(spark, sf, pairs_of=_cand_pairs, every=False):
    pairs, texts = pairs_of(spark, sf)
    return RP.score_pairs(_cand_once(spark, sf), texts, spark, pairs, C.load(spark, sf, "embeddings"), every=every)


@register("composite_score", f"""
with {SCORED_SQL}
select doc_id, target_id, final_score, {SF.grade('final_score')} as grade,
  round(blended_similarity * 100, 1) as semantic_similarity, round(keyword_coverage * 100, 1) as keyword_coverage,
  round(section_completeness * 100, 1) as section_completeness, round(content_strength * 100, 1) as content_strength,
  round(readability_score * 100, 1) as readability from scored
""")
def q_composite(spark, sf):
    s = _scored(spark, sf)
    m = F.col("dimension_scores")
    return s.select("doc_id", "target_id", "final_score", "grade",
                    *[F.element_at(m, k).alias(k) for k, _, _ in L.DIMENSIONS])


@register("rank_documents", f"""
with {SCORED_SQL.replace(CAND_PAIRS, EVERY_CAND_PAIR)}
select * from (select target_id, doc_id, final_score,
  row_number() over (partition by target_id order by final_score desc, doc_id) as rank,
  round(percent_rank() over (partition by target_id order by final_score desc, doc_id), 6) as pct_rank from scored)
where rank <= 10
""")
def q_rank(spark, sf):
    r = SC.rank_documents(materialise(_scored(spark, sf, _every_cand_pair, every=True).select("target_id", "doc_id", "final_score")), 10)
    return r.select("target_id", "doc_id", "final_score", "rank", "pct_rank")


@register("rank_all", f"""
with {SCORED_SQL}
select target_id, doc_id, final_score, row_number() over (partition by target_id order by final_score desc, doc_id) as rank,
  round(percent_rank() over (partition by target_id order by final_score desc, doc_id), 6) as pct_rank from scored
""")
def q_rank_all(spark, sf):
    r = SC.rank_all(materialise(_scored(spark, sf).select("target_id", "doc_id", "final_score")))
    return r.select("target_id", "doc_id", "final_score", "rank", "pct_rank")


@register("grade_histogram", f"""
with {SCORED_SQL}, g as (select target_id, {SF.grade('final_score')} as grade from scored)
select target_id, count(*) filter (where grade = 'Excellent') as "Excellent", count(*) filter (where grade = 'Good') as "Good",
  count(*) filter (where grade = 'Average') as "Average", count(*) filter (where grade = 'Below Average') as "Below Average",
  count(*) filter (where grade = 'Poor') as "Poor" from g group by target_id
""")
def q_grade_hist(spark, sf):
    return SC.grade_histogram(_scored(spark, sf).select("target_id", "grade"))



# ---------------------------------------------------------------- 2.5 screening
SCREEN_DOCS = f"""sf as ({SF.screen_features('documents')}), sl as ({SF.screen_lists('sf')})"""


def _screened_docs(spark, sf, density=None):
    return SCR.screen(_docs(spark, sf), "text", density)


@register("top_third_scan", f"""
with {SCREEN_DOCS} select doc_id, len(scan_issues) = 0 as scan_passed, array_to_string(scan_issues, '|') as issues,
  array_to_string(scan_strengths, '|') as strengths from sl
""")
def q_scan(spark, sf):
    s = _screened_docs(spark, sf)
    return s.select("doc_id", "scan_passed", F.array_join("scan_issues", "|").alias("issues"),
                    F.array_join("scan_strengths", "|").alias("strengths"))


@register("parse_issues", f"""
with {SCREEN_DOCS}, pf as ({SF.screen_features("(select page_id as doc_id, html as text from pages)")}),
pl as ({SF.screen_lists('pf')})
select 'document' as kind, doc_id as id, len(parse_issues) as n_issues, array_to_string(parse_issues, '|') as issues from sl
union all
select 'page' as kind, doc_id as id, len(parse_issues) as n_issues, array_to_string(parse_issues, '|') as issues from pl
""")
def q_parse_issues(spark, sf):
    d = _screened_docs(spark, sf).select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "parse_issues")
    pages = C.load(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    p = SCR.screen(pages, "text").select(F.lit("page").alias("kind"), F.col("doc_id").alias("id"), "parse_issues")
    u = d.unionByName(p)
    return u.select("kind", "id", F.size("parse_issues").alias("n_issues"),
                    F.array_join("parse_issues", "|").alias("issues"))


@register("weak_sections", f"""
with {SCREEN_DOCS} select doc_id, len(weak) as n_weak,
  array_to_string(list_transform(weak, lambda w: w.severity || ':' || w.section), '|') as weak_sections from sl
""")
def q_weak_sections(spark, sf):
    s = _screened_docs(spark, sf)
    return s.select("doc_id", F.size("weak_sections").alias("n_weak"), F.array_join(
        F.transform("weak_sections", lambda w: F.concat(w["severity"], F.lit(":"), w["section"])), "|").alias("weak_sections"))


SCREEN_PAIRS = f"""{DOC_PAIRS}, dm as (select * from {_assigned_density_sql("coalesce(d.text, '')")}),
sp as (select d.target_id, d.density_percent, d.top_missing_list, sl.* from dm d join sl using (doc_id)),
vv as (select *, {SF.verdict_cols()} from sp)"""
SCREEN_EVERY_PAIR = SCREEN_PAIRS.replace(DOC_PAIRS, EVERY_DOC_PAIR)


def _screen_pairs(spark, sf):
    """Rules and density of one and the same text, the document as it is."""
    pairs, texts = _doc_pairs(spark, sf)
    dens = M.assigned_density(_docs(spark, sf), texts, pairs).select("doc_id", "target_id", "density_percent", "top_missing_list")
    return _screened_docs(spark, sf, dens)


def _screen_every_pair(spark, sf, missing=None):
    """The same of every document with every target text, and of what was chosen besides."""
    pairs, texts = _doc_pairs(spark, sf)
    return _screened_docs(spark, sf, lambda base: M.every_density(_docs(spark, sf), texts, pairs, beside=base, missing=missing))


@register("screening_verdict", f"""
with {SCREEN_DOCS}, {SCREEN_EVERY_PAIR}
select doc_id, target_id, ats_score, verdict, array_to_string(reasoning, '|') as reasoning from vv
""")
def q_verdict(spark, sf):
    s = _screen_every_pair(spark, sf)
    return s.select("doc_id", "target_id", "ats_score", "verdict", F.array_join("reasoning", "|").alias("reasoning"))


@register("screening_recommendations", f"""
with {SCREEN_DOCS}, {SCREEN_EVERY_PAIR}, rr as (select doc_id, target_id, {SF.recommendation_col()} from vv)
select doc_id, target_id, len(recommendations) as n_recs,
  array_to_string(list_transform(recommendations, lambda r: r.priority || ':' || r.action), '|') as recommendations from rr
""")
def q_recs(spark, sf):
    s = _screen_every_pair(spark, sf, missing=", ")
    return s.select("doc_id", "target_id", F.size("recommendations").alias("n_recs"), F.array_join(
        F.transform("recommendations", lambda r: F.concat(r["priority"], F.lit(":"), r["action"])), "|").alias("recommendations"))


@register("verdict_rollup", f"""
with {SCREEN_DOCS}, {SCREEN_EVERY_PAIR}
select target_id, verdict, count(*) as n_docs, sum(len(parse_issues))::bigint as n_parse_issues,
  sum(len(scan_issues))::bigint as n_scan_issues, sum(len(weak))::bigint as n_weak_sections from vv group by cube(target_id, verdict)
""")
def q_rollup(spark, sf):
    return SCR.verdict_rollup(_screen_every_pair(spark, sf), "target_id", "verdict")



@register("verdict_rollup_merged", f"""
with {SCREEN_DOCS}, {SCREEN_PAIRS}
select target_id, verdict, count(*) as n_pairs, sum(len(parse_issues))::bigint as n_parse_issues,
  sum(len(scan_issues))::bigint as n_scan_issues, sum(len(weak))::bigint as n_weak_sections from vv group by cube(target_id, verdict)
""")
def q_rollup_merged(spark, sf):
    """The cube from stored parts of two halves of the pairs, merged without the pairs."""
    s = _screen_pairs(spark, sf)
    s = materialise(s.select("doc_id", "target_id", "verdict", "parse_issues", "scan_issues", "weak_sections"))
    halves = [materialise(SK.verdict_parts(s.where(F.pmod("doc_id", F.lit(2)) == i), "target_id", "verdict")) for i in (0, 1)]
    return SK.merged_verdicts(halves[0].unionByName(halves[1]), "target_id", "verdict").drop("docs_estimate")


# ---------------------------------------------------------------- 2.6 rewriting
BULLETS = f"""bt as (select doc_id, bullet_no, bullet from (
  select doc_id, unnest(generate_series(1, len(bl))) as bullet_no, unnest(bl) as bullet
  from (select doc_id, {SF.bullets('text')} as bl from cand)))"""


def _bullets(spark, sf):
    return RW.bullet_table(_cand(spark, sf))


@register("bullet_rewrite", f"with {CAND}, {BULLETS} select doc_id, bullet_no, bullet, {SF.rewrite(S.strip('bullet'))} as improved from bt")
def q_bullet_rewrite(spark, sf):
    return _bullets(spark, sf).select("doc_id", "bullet_no", "bullet", "improved")


@register("bullet_flags", f"""with {CAND}, {BULLETS} select doc_id, bullet_no, regexp_matches(bullet, '\\d') as has_quantification,
  {SF.strong_verb('bullet')} as has_strong_verb from bt""")
def q_bullet_flags(spark, sf):
    return _bullets(spark, sf).select("doc_id", "bullet_no", "has_quantification", "has_strong_verb")


@register("bullet_issues", f"""with {CAND}, {BULLETS}, i as (select doc_id, bullet_no, {SF.issues('bullet')} as issues from bt)
select doc_id, bullet_no, len(issues) as n_issues, array_to_string(issues, '|') as issues from i""")
def q_bullet_issues(spark, sf):
    b = _bullets(spark, sf)
    return b.select("doc_id", "bullet_no", F.size("issues").alias("n_issues"), F.array_join("issues", "|").alias("issues"))


@register("bullet_suggestions", f"""with {CAND}, {BULLETS}
select doc_id, bullet_no, array_to_string({SF.suggestions('bullet')}, '|') as suggestions from bt""")
def q_bullet_suggestions(spark, sf):
    b = _bullets(spark, sf)
    return b.select("doc_id", "bullet_no", F.array_join("suggestions", "|").alias("suggestions"))


@register("issue_histogram", f"""with {CAND}, {BULLETS}
select issue, count(*) as n from (select unnest({SF.issues('bullet')}) as issue from bt) group by all""")
def q_issue_hist(spark, sf):
    return RW.issue_histogram(_bullets(spark, sf))


@register("project_strength", f"""with {CAND}, p as (select doc_id, {SF.project_strength(SF.bullets('text'))} from cand)
select doc_id, project_score, total_bullets, quantified_bullets, strong_verb_bullets, project_message,
  array_to_string(project_tips, '|') as project_tips from p""")
def q_project_strength(spark, sf):
    c = _cand(spark, sf).select("doc_id", X.bullets_array(F.col("text")).alias("bl"))
    p = c.select("doc_id", *RW.project_strength(F.col("bl")))
    return p.withColumn("project_tips", F.array_join("project_tips", "|"))


@register("rewrite_document", f"""with {CAND}, r as (select doc_id, {SF.rewrite_document('text')} as rewritten from cand)
select doc_id, length(rewritten) as n_chars, md5(rewritten) as rewritten_md5 from r""")
def q_rewrite_document(spark, sf):
    r = _cand(spark, sf).select("doc_id", RW.rewrite_document(F.col("text")).alias("rewritten"))
    return r.select("doc_id", F.length("rewritten").alias("n_chars"), F.md5("rewritten").alias("rewritten_md5"))


@register("apply_replacements", f"""with {CAND}, p as (select doc_id, text, list_transform({SF.bullets('text')},
  lambda b: {{'o': b, 'i': {SF.rewrite(S.strip('b'))}}}) as pairs from cand),
r as (select doc_id, list_reduce(list_prepend({{'o': text, 'i': ''}}, pairs), lambda a, x:
  {{'o': case when x.o <> '' and x.i <> '' then replace(a.o, x.o, x.i) else a.o end, 'i': ''}}).o as improved from p)
select doc_id, md5(improved) as improved_md5, length(improved) as n_chars from r""")
def q_apply_replacements(spark, sf):
    """Fold each document's analysed (original, improved) bullet pairs over its text; local to the row."""
    pairs = F.transform(X.bullets_array(F.col("text")), lambda b: F.struct(b.alias("original"), RW.rewrite_line(T.py_strip(b)).alias("improved")))
    c = T.once(_cand(spark, sf), "pairs", pairs)
    out = RW.apply_replacements(F.col("text"), F.col("pairs"))
    return c.select("doc_id", F.md5(out).alias("improved_md5"), F.length(out).alias("n_chars"))


HTML_DATE = "2024-01-01"


def _escape_sql(x):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = f"replace({x}, {S.q(a)}, {S.q(b)})"
    return x


_MARKED = "regexp_matches({}, '^[-*•‣◦]')"


@register("render_html_lines", f"""with {CAND},
p as (select doc_id, unnest(generate_series(1, len(string_split(text, chr(10) || chr(10))))) as no, unnest(string_split(text, chr(10) || chr(10))) as para from cand),
l as (select doc_id, no, list_filter(list_transform(string_split(para, chr(10)), lambda x: {S.strip('x')}), lambda x: x <> '') as ls from p),
h as (select doc_id, no, array_to_string(list_transform(ls, lambda x, i: case when {_MARKED.format('x')} then
    case when i > 1 and {_MARKED.format('ls[i - 1]')} then '' else '<ul>' || chr(10) end
    || '<li>' || {_escape_sql("regexp_replace(x, '^[-*•‣◦][ \t\n\r\f\x0B]*', '')")} || '</li>' || chr(10)
    || case when i < len(ls) and {_MARKED.format('ls[i + 1]')} then '' else '</ul>' || chr(10) end
  else '<p>' || {_escape_sql('x')} || '</p>' || chr(10) end), '') as part from l),
r as (select doc_id, '<h1>Optimized document</h1>' || chr(10) || string_agg(part, '' order by no)
  || '<div class="watermark">Optimized on {HTML_DATE}</div>' || chr(10) as html from h group by doc_id)
select doc_id, length(html) as n_chars, md5(html) as html_md5 from r""")
def q_render_html(spark, sf):
    r = _cand(spark, sf).select("doc_id", RW.render_html_lines(F.col("text"), HTML_DATE).alias("html"))
    return r.select("doc_id", F.length("html").alias("n_chars"), F.md5("html").alias("html_md5"))



# ---------------------------------------------------------------- 2.7 feedback
ADV_SQL = f"""adv as (
  with t as (select doc_id, count(*) as n_tech, list_sort(list(canonical)) as tech from dterm where category = 'technical' group by all),
  wk as (select doc_id, list_sort(list(distinct weak)) as weak_skills from (select doc_id, {_title_sql('candidate')} as weak from drep_cands,
      (select unnest({S.lst(L.WEAK_SKILLS)}) as term) where contains(candidate, term)) group by all),
  base as (select d.*, coalesce(t.n_tech, 0) as n_tech, coalesce(t.tech, []) as tech_skills, coalesce(wk.weak_skills, []) as weak_skills
    from ddim d left join t using (doc_id) left join wk using (doc_id))
  select *, {SF.missing_sections()} as missing_sections, {SF.content_items()} as content_feedback,
    {SF.structure_items()} as structure_feedback, {SF.readability_tips()} as readability_tips,
    {SF.readability_fixes()} as readability_fixes, {SF.project_strength('bullets')} from base)"""


def _adv(spark, sf, c=None, terms=None):
    """Advice on every candidate; ``c`` and ``terms`` as for ``_coverage``."""
    c = _cand_once(spark, sf) if c is None else c
    d = FE.with_skills(RP.doc_dimensions(c, spark), RP.all_terms(c, spark) if terms is None else terms)
    d = FE.with_project_strength(d)
    return d.select(
        "*",
        AD.missing_section_advice().alias("missing_sections"),
        AD.content_advice(F.col("quant_count"), F.col("word_count"), F.size("tech_skills"), F.col("has_email"),
                          F.col("has_phone")).alias("content_feedback"),
        AD.structure_advice(F.col("n_dates"), F.col("has_linkedin"), F.col("has_github"), F.col("software_role"),
                            F.col("feedback_bullets")).alias("structure_feedback"),
        AD.readability_tips(F.col("avg_words_per_sentence"), F.col("flesch_kincaid_score")).alias("readability_tips"),
        AD.readability_fixes(F.col("avg_words_per_sentence"), F.col("flesch_kincaid_score")).alias("readability_fixes"),
    )


@register("missing_section_advice", f"""with {CAND}, {LEX_MATCH}, {DTERM}, {DDIM}, {ADV_SQL}
select doc_id, len(missing_sections) as n_missing,
  array_to_string(list_transform(missing_sections, lambda x: x.priority || ':' || x.section), '|') as advice from adv""")
def q_missing_sections(spark, sf):
    a = _adv(spark, sf)
    return a.select("doc_id", F.size("missing_sections").alias("n_missing"), F.array_join(F.transform(
        "missing_sections", lambda x: F.concat(x["priority"], F.lit(":"), x["section"])), "|").alias("advice"))


@register("verb_upgrade_advice", f"""with {CAND}, {LEX_MATCH}, {DTERM}, {DDIM}, {ADV_SQL}
select doc_id, n_strong as action_verb_count, array_to_string(strong_verbs, '|') as action_verbs_found,
  {SF.verb_strength('n_strong')} as verb_strength,
  array_to_string(list_transform({SF.verb_upgrades('weak_verbs', 'weak_skills')}, lambda u: u.weak || '=' || u.suggestions), '|') as upgrades, array_to_string(weak_skills, '|') as weak_skills,
  case when n_strong >= 8 then {S.q(L.VERB_TIPS['strong'])} else {S.q(L.VERB_TIPS['other'])} end as tip from adv""")
def q_verb_advice(spark, sf):
    a = _adv(spark, sf)
    up = AD.verb_upgrade_advice(F.col("weak_verbs"), F.col("weak_skills"))
    return a.select("doc_id", F.col("n_strong").alias("action_verb_count"),
                    F.array_join("strong_verbs", "|").alias("action_verbs_found"),
                    AD.verb_strength(F.col("n_strong")).alias("verb_strength"),
                    F.array_join(F.transform(up, lambda u: F.concat(u["weak"], F.lit("="), u["suggestions"])), "|")
                    .alias("upgrades"), F.array_join("weak_skills", "|").alias("weak_skills"), AD.verb_tip(F.col("n_strong")).alias("tip"))


@register("content_advice", f"""with {CAND}, {LEX_MATCH}, {DTERM}, {DDIM}, {ADV_SQL}
select doc_id, array_to_string(list_transform(content_feedback, lambda x: x.type || ':' || x.priority || ':' || x.message), '|')
  as content_feedback from adv""")
def q_content_advice(spark, sf):
    a = _adv(spark, sf)
    return a.select("doc_id", F.array_join(F.transform("content_feedback", lambda x: F.concat_ws(
        ":", x["type"], x["priority"], x["message"])), "|").alias("content_feedback"))


@register("readability_advice", f"""with {CAND}, {LEX_MATCH}, {DTERM}, {DDIM}, {ADV_SQL}
select doc_id, array_to_string(readability_tips, '|') as tips, array_to_string(list_transform(readability_fixes, lambda f: f.issue || '=' || f.before || '>' || f.after), '|') as fixes from adv""")
def q_readability_advice(spark, sf):
    a = _adv(spark, sf)
    return a.select("doc_id", F.array_join("readability_tips", "|").alias("tips"),
                    F.array_join(F.transform("readability_fixes", lambda f: F.concat(
                        f["issue"], F.lit("="), f["before"], F.lit(">"), f["after"])), "|").alias("fixes"))


@register("structure_advice", f"""with {CAND}, {LEX_MATCH}, {DTERM}, {DDIM}, {ADV_SQL}
select doc_id, array_to_string(list_transform(structure_feedback, lambda x: x.type || ':' || x.message), '|') as structure
from adv""")
def q_structure_advice(spark, sf):
    a = _adv(spark, sf)
    return a.select("doc_id", F.array_join(F.transform("structure_feedback", lambda x: F.concat_ws(
        ":", x["type"], x["message"])), "|").alias("structure"))


@register("profile_summaries", f"""with {CAND}, {LEX_MATCH}, {DTERM}, {DOMAIN_SQL}, {DDIM}, {ADV_SQL},
t as (select a.doc_id, dom.domain, a.tech_skills from adv a join dom using (doc_id))
select doc_id, unnest(generate_series(1, {len(L.PROFILE_TEMPLATES)})) as template_no,
  unnest([{", ".join("replace(replace(" + S.q(t) + ", '{domain}', domain), '{skills}', " + SF.skills_phrase('tech_skills') + ")" for t in L.PROFILE_TEMPLATES)}])
  as summary from t""")
def q_profile_summaries(spark, sf):
    c = _cand_once(spark, sf)
    terms = materialise(RP.all_terms(c, spark))  # read twice
    dom = X.domain_inference(terms, spark, c)
    d = FE.with_skills(c.select("doc_id"), terms).join(dom, "doc_id")
    return d.select("doc_id", F.posexplode(AD.profile_summaries(F.col("domain"), F.col("tech_skills")))
                    .alias("template_no", "summary")).withColumn("template_no", F.col("template_no") + 1)


PAIR_ADV_SQL = f"""padv as (
  with k as (select doc_id, target_id, missing, round(keyword_coverage * 100, 1) as kw_score from cov)
  select k.doc_id, k.target_id, k.kw_score, k.missing, {SF.keyword_suggestions('k.missing')} as kw_suggestions,
    {SF.keyword_examples('k.missing')} as kw_examples, a.* exclude (doc_id) from k join adv a using (doc_id)),
tops as (select *, {SF.top_suggestions('kw_suggestions')} as top_suggestions from padv)"""


def _pair_adv(spark, sf):
    c = _cand_once(spark, sf)
    terms = materialise(RP.all_terms(c, spark))  # one corpus and its terms for both sides
    a = _adv(spark, sf, c, terms)
    cov = _coverage(spark, sf, c, terms).select("doc_id", "target_id", "missing",
                                      F.round(F.col("keyword_coverage") * 100, 1).alias("kw_score"))
    p = cov.join(a, "doc_id")
    p = p.withColumn("kw_suggestions", AD.keyword_suggestions(F.col("missing")))
    p = p.withColumn("kw_examples", AD.keyword_examples(F.col("missing")))
    return p.withColumn("top_suggestions", AD.top_suggestions(
        F.col("missing_sections"), F.col("content_feedback"), F.col("kw_suggestions"), F.col("n_strong"),
        F.col("structure_feedback")))


@register("keyword_advice", f"""with {CAND}, {TARG}, {CAND_PAIRS}, {LEX_MATCH}, {TLEX_MATCH}, {COVERAGE_SQL}, {DDIM}, {ADV_SQL}, {PAIR_ADV_SQL}
select doc_id, target_id, kw_score, array_to_string(missing, '|') as missing_keywords,
  array_to_string(kw_suggestions, '|') as suggestions,
  array_to_string(list_transform(kw_examples, lambda e: e.keyword || '=' || e.example), '|') as examples,
  case when target_id is null then null when kw_score >= 70 then {S.q(L.KEYWORD_MESSAGES['good'])} else {S.q(L.KEYWORD_MESSAGES['more'])} end as tip,
  case when target_id is null then {S.q(L.KEYWORD_MESSAGES['no_target'])} end as note from padv""")
def q_keyword_advice(spark, sf):
    p = _pair_adv(spark, sf)
    return p.select("doc_id", "target_id", "kw_score", F.array_join("missing", "|").alias("missing_keywords"),
                    F.array_join("kw_suggestions", "|").alias("suggestions"),
                    F.array_join(F.transform("kw_examples", lambda e: F.concat(e["keyword"], F.lit("="), e["example"])), "|")
                    .alias("examples"), F.when(F.col("target_id").isNotNull(), AD.keyword_tip(F.col("kw_score"))).alias("tip"),
                    F.when(F.col("target_id").isNull(), F.lit(L.KEYWORD_MESSAGES["no_target"])).alias("note"))


@register("top_suggestions", f"""with {CAND}, {TARG}, {CAND_PAIRS}, {LEX_MATCH}, {TLEX_MATCH}, {COVERAGE_SQL}, {DDIM}, {ADV_SQL}, {PAIR_ADV_SQL}
select doc_id, target_id, len(top_suggestions) as n_suggestions, array_to_string(top_suggestions, '|') as top_suggestions from tops""")
def q_top_suggestions(spark, sf):
    p = _pair_adv(spark, sf)
    return p.select("doc_id", "target_id", F.size("top_suggestions").alias("n_suggestions"),
                    F.array_join("top_suggestions", "|").alias("top_suggestions"))


@register("quick_tips", f"""with {CAND}, {TARG}, {CAND_PAIRS}, {LEX_MATCH}, {TLEX_MATCH}, {COVERAGE_SQL}, {DDIM}, {ADV_SQL}, {PAIR_ADV_SQL},
qt as (select doc_id, target_id, {SF.distinct_in_order(
    "list_concat(list_concat(case when len(readability_fixes) > 0 then ['Fix <strong>' || readability_fixes[1].issue || '</strong> for better ATS parsing.'] else [] end, "
    "case when project_score < 70 then [" + S.q(L.QUICK_TIP_MESSAGES['project']) + "] else [] end), top_suggestions[1:3])")}[1:4] as tips from tops)
select doc_id, target_id, array_to_string(tips, '|') as quick_tips from qt""")
def q_quick_tips(spark, sf):
    p = _pair_adv(spark, sf)
    return p.select("doc_id", "target_id", F.array_join(AD.quick_tips(
        F.col("readability_fixes"), F.col("project_score"), F.col("top_suggestions")), "|").alias("quick_tips"))


@register("suggestion_frequency", f"""with {CAND}, {TARG}, {CAND_PAIRS}, {LEX_MATCH}, {TLEX_MATCH}, {COVERAGE_SQL}, {DDIM}, {ADV_SQL}, {PAIR_ADV_SQL}
select suggestion, count(distinct doc_id) as n_docs, count(*) as n_pairs from (select doc_id, unnest(top_suggestions) as suggestion from tops) group by all""")
def q_suggestion_frequency(spark, sf):
    return AD.suggestion_frequency(_pair_adv(spark, sf))


@register("overall_summary", f"""with {SCORED_SQL},
d as (select doc_id, target_id, final_score, {SF.grade('final_score')} as grade,
  [round(blended_similarity * 100, 1) + 0.0, round(keyword_coverage * 100, 1), round(section_completeness * 100, 1),
   round(content_strength * 100, 1), round(readability_score * 100, 1)] as v from scored),
e as (select *, list_position(v, list_max(v)) as bi, list_position(v, list_min(v)) as wi from d)
select doc_id, target_id, 'Your resume scored ' || final_score::varchar || '/100 (' || grade || '). Your strongest area is '
  || {S.lst([lab for _, _, lab in L.DIMENSIONS])}[bi] || ' (' || v[bi]::varchar || '/100), while '
  || {S.lst([lab for _, _, lab in L.DIMENSIONS])}[wi] || ' (' || v[wi]::varchar || '/100) needs the most improvement.' as summary
from e""")
def q_overall_summary(spark, sf):
    s = _scored(spark, sf)
    dims = [F.element_at("dimension_scores", k) for k, _, _ in L.DIMENSIONS]
    return s.select("doc_id", "target_id", AD.overall_summary(F.col("final_score"), F.col("grade"), dims).alias("summary"))



# ---------------------------------------------------------------- 2.8 versions
def _saves(spark, sf):
    conv = C.load(spark, sf, "conversations")
    clean = T.clean_text("text")
    r = conv.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("ts"), F.col("role").alias("label"),
                    "text", *X.readability_columns(clean), T.quant_count(clean).alias("q"))
    dims_ = F.map_from_entries(F.filter(F.array(
        F.struct(F.lit("readability").alias("k"), F.col("flesch_kincaid_score").alias("v")),
        F.when(F.col("q") > 0, F.struct(F.lit("quantification").alias("k"), F.col("q").cast("double").alias("v")))),
        lambda x: x.isNotNull()))
    return r.withColumn("dims", dims_)


def _append(rows, existing=None):
    return VE.version_append(rows, "ts", "session_id", "label", "text", "flesch_kincaid_score", "readability_grade", "dims", existing)


def _versions(spark, sf):
    return _append(_saves(spark, sf))


VERSIONS_SQL = f"""
v0 as (select conv_id::varchar as session_id, turn as ts, {S.strip("coalesce(role, '')")} as label,
        {S.strip("coalesce(text, '')")} as vtext, {SF.readability_cols(S.clean('text'))},
        {S.rcount(S.clean('text'), r'\b\d+\b')} as q from conversations),
ver as (select session_id, row_number() over (partition by session_id order by ts) as version_id, label, vtext,
        flesch_kincaid_score as score, readability_grade as grade, q from v0 where label <> '' and vtext <> ''),
vdims as (select session_id, version_id, 'readability' as dimension, score as value from ver
          union all select session_id, version_id, 'quantification', q::double from ver where q > 0)"""


_APPENDED_SQL = f"""with {VERSIONS_SQL}
select session_id, version_id, label, md5(vtext) as text_md5, score, grade,
  (select count(*) from vdims d where d.session_id = ver.session_id and d.version_id = ver.version_id) as n_dims from ver"""


def _appended(v):
    return v.select("session_id", "version_id", "label", F.md5("text").alias("text_md5"), "score", "grade", F.size("dims").alias("n_dims"))


@register("version_append", _APPENDED_SQL)
def q_version_append(spark, sf):
    return _appended(_versions(spark, sf))


FIRST_TURNS = 3


@register("version_append_again", _APPENDED_SQL)
def q_version_append_again(spark, sf):
    """Two appends, the second of which repeats what the first has saved: the ids of one."""
    rows = _saves(spark, sf)
    first = materialise(_append(rows.where(F.col("ts") < FIRST_TURNS)))
    return _appended(first.unionByName(_append(rows, first)))


@register("version_list", f"with {VERSIONS_SQL} select session_id, version_id, label, score, grade from ver")
def q_version_list(spark, sf):
    return VE.version_list(_versions(spark, sf)).select("session_id", "version_id", "label", "score", "grade")


@register("version_compare", f"""with {VERSIONS_SQL},
req as (select distinct session_id, 1 as id_a, 2 as id_b from ver union all select distinct session_id, 2, 3 from ver),
r as (select req.*, a.score as score_a, b.score as score_b from req
      left join ver a on a.session_id = req.session_id and a.version_id = req.id_a
      left join ver b on b.session_id = req.session_id and b.version_id = req.id_b),
ok as (select * from r where score_a is not null and score_b is not null),
da as (select ok.session_id, id_a, id_b, dimension, value as version_a from ok join vdims d
       on d.session_id = ok.session_id and d.version_id = ok.id_a),
db as (select ok.session_id, id_a, id_b, dimension, value as version_b from ok join vdims d
       on d.session_id = ok.session_id and d.version_id = ok.id_b),
both_ as (select coalesce(da.session_id, db.session_id) as session_id, coalesce(da.id_a, db.id_a) as id_a,
          coalesce(da.id_b, db.id_b) as id_b, coalesce(da.dimension, db.dimension) as dimension,
          coalesce(version_a, 0.0) as version_a, coalesce(version_b, 0.0) as version_b
          from da full outer join db using (session_id, id_a, id_b, dimension))
select b.session_id, b.id_a::bigint as id_a, b.id_b::bigint as id_b, dimension, version_a, version_b,
  round(version_b - version_a, 1) as delta, round(score_b - score_a, 1) as score_delta, null::varchar as error
from both_ b join ok using (session_id, id_a, id_b)
union all
select session_id, id_a::bigint, id_b::bigint, null, null, null, null, null, {S.q(VE.NOT_FOUND)} from r
where score_a is null or score_b is null""")
def q_version_compare(spark, sf):
    v = _versions(spark, sf)
    sessions = v.select("session_id").distinct()
    req = sessions.select("session_id", F.lit(1).alias("id_a"), F.lit(2).alias("id_b")).unionByName(
        sessions.select("session_id", F.lit(2).alias("id_a"), F.lit(3).alias("id_b")))
    return VE.version_compare(v, req)


@register("version_trend", f"""with {VERSIONS_SQL}
select session_id, version_id, score, round(score - lag(score) over w, 1) as change,
  max(score) over (w rows between unbounded preceding and current row) as best_so_far
from ver window w as (partition by session_id order by version_id)""")
def q_version_trend(spark, sf):
    return VE.version_trend(_versions(spark, sf))


# ---------------------------------------------------------------- 2.9 repositories
REPOS = f"repos as ({S.repos_sql()})"


def _repos(spark, sf):
    return D.repos(spark, sf)


@register("repo_url_rollup", f"""with {REPOS},
urls as (select case pos % 3 when 0 then 'https://github.com/u' || owner || '/' || name || '/'
                             when 1 then '  github.com/u' || owner || '//' else 'https://gitlab.com/u' || owner || '/' || name end as url
         from repos union all select url from pages),
u as (select regexp_replace({S.strip('url')}, '/+$', '') as u from urls),
p as (select case when regexp_matches(u, {S.q(RE.REPO_URL)}) then 'repo' when regexp_matches(u, {S.q(RE.OWNER_URL)}) then 'profile'
                  else 'invalid' end as kind,
             case when regexp_matches(u, {S.q(RE.REPO_URL)}) then regexp_extract(u, {S.q(RE.REPO_URL)}, 1)
                  when regexp_matches(u, {S.q(RE.OWNER_URL)}) then regexp_extract(u, {S.q(RE.OWNER_URL)}, 1) end as owner,
             case when regexp_matches(u, {S.q(RE.REPO_URL)}) then regexp_extract(u, {S.q(RE.REPO_URL)}, 2) end as repo from u)
select kind, owner, count(*) as n_urls, count(distinct repo) as n_repos from p group by all""")
def q_repo_urls(spark, sf):
    r = _repos(spark, sf)
    url = (F.when(F.col("pos") % 3 == 0, F.concat(F.lit("https://github.com/u"), F.col("owner").cast("string"), F.lit("/"),
                                                  F.col("name"), F.lit("/")))
           .when(F.col("pos") % 3 == 1, F.concat(F.lit("  github.com/u"), F.col("owner").cast("string"), F.lit("//")))
           .otherwise(F.concat(F.lit("https://gitlab.com/u"), F.col("owner").cast("string"), F.lit("/"), F.col("name"))))
    urls = r.select(url.alias("url")).unionByName(C.load(spark, sf, "pages").select("url"))
    return RE.repo_url_rollup(urls)


@register("owner_languages_topk", f"""with {REPOS},
per as (select owner, language, count(*) as n_repos, min(pos) as first_pos from repos
        where language is not null and language <> '' group by all)
select * from (select *, row_number() over (partition by owner order by n_repos desc, first_pos) as rank from per) where rank <= 6""")
def q_owner_langs(spark, sf):
    return RE.owner_languages_topk(_repos(spark, sf))


@register("owner_star_rollup", f"""with {REPOS},
s as (select owner, sum(stars)::bigint as total_stars, count(*) as n_repos from repos group by all),
t as (select owner, count(distinct topic) as n_topics from (select owner, unnest(topics) as topic from repos) group by all)
select s.*, coalesce(n_topics, 0) as n_topics from s left join t using (owner)""")
def q_owner_stars(spark, sf):
    return RE.owner_star_rollup(_repos(spark, sf))


@register("owner_top_repos", f"""with {REPOS}
select owner, name, stars, pos, rank from (select *, row_number() over (partition by owner order by stars desc, pos) as rank
from repos) where rank <= 5""")
def q_owner_top(spark, sf):
    return RE.owner_top_repos(_repos(spark, sf)).select("owner", "name", "stars", "pos", "rank")


TOPIC_VALUES = S.values([(k, v) for k, v in L.TOPIC_SKILLS], "ts(topic, skill)")
STACK_SQL = f"""stack as (
  with u as (select owner, name, language as tech from repos where language is not null
             union select r.owner, r.name, ts.skill from (select owner, name, unnest(topics) as t from repos) r
                  join {TOPIC_VALUES} on lower(r.t) = ts.topic
             union select r.owner, r.name, ts.skill from repos r join {TOPIC_VALUES} on contains(lower(coalesce(r.description, '')), ts.topic))
  select owner, name, list_sort(list(tech)) as tech_stack from u group by all)"""


@register("tech_stack", f"with {REPOS}, {STACK_SQL} select owner, name, array_to_string(tech_stack, '|') as tech_stack from stack")
def q_tech_stack(spark, sf):
    s = RE.tech_stack(_repos(spark, sf), spark)
    return s.select("owner", "name", F.array_join("tech_stack", "|").alias("tech_stack"))


@register("expand_skills", f"""with {REPOS}, {STACK_SQL},
t as (select owner, name, unnest(tech_stack) as tech from stack),
u as (select owner, name, tech as skill from t union
      select t.owner, t.name, ls.related from t join {S.values([(lang, rel) for lang, rels in L.LANGUAGE_SKILLS for rel in rels], "ls(language, related)")}
      on contains(lower(t.tech), lower(ls.language)))
select owner, name, array_to_string(list_sort(list(skill)), '|') as skills from u group by all""")
def q_expand_skills(spark, sf):
    e = RE.expand_skills(RE.tech_stack(_repos(spark, sf), spark), spark)
    return e.select("owner", "name", F.array_join("skills", "|").alias("skills"))


@register("repo_lines", f"""with {REPOS}, {STACK_SQL},
j as (select r.*, coalesce(s.tech_stack, []) as st, {_title_sql("translate(r.name, '-_', '  ')")} as tname
      from repos r left join stack s using (owner, name)),
l as (select owner, name, list_filter([
   case when coalesce(description, '') <> '' then 'Developed ' || tname || ' — ' || regexp_replace(description, '[.]+$', '')
        || ' using ' || case when len(st) > 0 then array_to_string(st[1:4], ', ') else 'multiple technologies' end || '.'
        else 'Built ' || tname || ' using ' || case when len(st) > 0 then array_to_string(st[1:4], ', ') else 'multiple technologies' end
        || ', demonstrating proficiency in full-stack development.' end,
   case when stars > 0 or forks > 0 then 'Open-sourced ' || tname || ', achieving ' || array_to_string(list_filter([
        case when stars > 0 then stars || ' GitHub stars' end, case when forks > 0 then forks || ' forks' end], lambda x: x is not null), ' and ')
        || ' from the developer community.' end,
   case when len(st) >= 3 then 'Implemented ' || tname || ' leveraging ' || array_to_string(st[1:3], ', ')
        || ' with focus on performance and maintainability.' end], lambda x: x is not null)[1:3] as lines from j)
select owner, name, len(lines) as n_lines, array_to_string(lines, '|') as lines from l""")
def q_repo_lines(spark, sf):
    lines = RE.repo_lines(RE.tech_stack(_repos(spark, sf), spark, of_rows=True))
    return lines.select("owner", "name", F.size("lines").alias("n_lines"), F.array_join("lines", "|").alias("lines"))



_TITLE_TOP = _title_sql("replace(b.name, '-', ' ')")


@register("owner_lines", f"""with {REPOS},
lg as (select owner, language, count(*) as n, min(pos) as p from repos where coalesce(language, '') <> '' group by all),
lt as (select owner, string_agg(language, ', ' order by n desc, p) as langs from (select *, row_number() over (partition by owner order by n desc, p) as k from lg)
  where k <= 4 group by owner),
tot as (select owner, count(*) as n, coalesce(sum(stars), 0)::bigint as stars from repos group by owner),
best as (select * from (select owner, name, coalesce(description, '') as d, row_number() over (partition by owner order by stars desc, pos) as k from repos) where k = 1),
o as (select tot.owner, list_filter([
  'Maintained an active GitHub profile with ' || tot.n || ' public repositories across ' || coalesce(langs, 'multiple languages') || '.',
  case when tot.stars > 0 then 'Open-source contributions recognized with ' || tot.stars || '+ total GitHub stars across projects.' end,
  case when b.d <> '' then 'Featured project: ' || {_TITLE_TOP} || ' — ' || regexp_replace(b.d, '[.]+$', '') || '.' end], lambda x: x is not null) as lines
  from tot left join lt using (owner) left join best b using (owner))
select owner, len(lines) as n_lines, array_to_string(lines, '|') as lines from o""")
def q_owner_lines(spark, sf):
    lines = RE.owner_lines(_repos(spark, sf))
    return lines.select("owner", F.size("lines").alias("n_lines"), F.array_join("lines", "|").alias("lines"))



# ---------------------------------------------------------------- 2.2 keyword phrases
RAKE_SQL = f"""{_rake_occ_sql('cdocs')},
wocc as (select doc_id, ph_idx, phrase, unnest(generate_series(0, len(string_split(phrase, ' ')) - 1)) as w_idx,
         unnest(string_split(phrase, ' ')) as word, len(string_split(phrase, ' ')) as plen from occ),
st as (select doc_id, word, count(*) as freq, sum(plen) as degree from wocc group by all),
sc as (select doc_id, ph_idx, phrase, list_reduce(list(degree / freq order by w_idx), lambda a, b: a + b) as score
       from wocc join st using (doc_id, word) group by all)"""


@register("rake_keywords", f"""with {CLEAN_DOCS}, {RAKE_SQL}
select doc_id, rank, phrase, round(score::varchar::decimal(38, 18), 2)::double as score from (
  select *, row_number() over (partition by doc_id order by score desc, phrase desc) as rank from sc) where rank <= 20""")
def q_rake(spark, sf):
    return KW.rake_keywords(_clean_docs(spark, sf))


@register("noise_filter", f"""with {CLEAN_DOCS}, {_rake_occ_sql('cdocs')}
select doc_id, phrase, {_noise_sql('phrase')} as is_noise from (select distinct doc_id, phrase from occ)""")
def q_noise(spark, sf):
    occ = KW.with_phrases(_clean_docs(spark, sf).select("doc_id", "text"))
    occ = occ.select("doc_id", F.explode(F.array_distinct("_phrases")).alias("phrase"))
    return occ.select("doc_id", "phrase", KW.is_noise(F.col("phrase")).alias("is_noise"))


@register("repeated_phrases", f"""with {CAND}, {LEX_MATCH}, {_repeated_sql('cand', 'doc_id', 'lexm', 'rep')} select * from rep""")
def q_repeated(spark, sf):
    c = _cand_once(spark, sf)
    return KW.repeated_phrases(c, X.lexicon_match(c, spark), spark)


@register("weak_terms", f"""with {CAND}, {_rake_occ_sql('cand')}, {CANDS_SQL}
select distinct doc_id, {_title_sql('candidate')} as weak from cands, (select unnest({S.lst(L.WEAK_SKILLS)}) as term)
where contains(candidate, term)""")
def q_weak_terms(spark, sf):
    return KW.weak_terms(_cand(spark, sf), spark)



# ---------------------------------------------------------------- 2.1 sources (targets, payloads)
@register("event_props_scan", """
select event_id, coalesce(try_cast(json_extract(props, '$.k') as bigint), 0) as k,
  coalesce(json_extract_string(props, '$.name'), '') as name from events""")
def q_props_scan(spark, sf):
    e = C.load(spark, sf, "events").select("event_id", "props")
    return C.repo_payload_scan(e, "props", "k bigint, name string")


@register("repo_payload_scan", f"""with {REPOS}
select owner, pos, name, 'u' || owner || '/' || name as full_name, case when forks % 3 = 0 then '' else description end as description, language,
  case when pos % 2 = 0 then '' else 'https://github.com/u' || owner || '/' || name end as html_url,
  case when pos % 5 = 0 then 0 else stars end as stargazers_count, forks as forks_count,
  case when pos % 7 = 0 then '' else array_to_string(topics, '|') end as topics from repos""")
def q_payload_scan(spark, sf):
    """JSON payloads of the repositories, with some fields absent or null, read back through the payload schema."""
    r = _repos(spark, sf)
    full = F.concat(F.lit("u"), F.col("owner"), F.lit("/"), F.col("name"))
    fields = F.struct("name", full.alias("full_name"), F.when(F.col("forks") % 3 != 0, F.col("description")).alias("description"), "language",
                      F.when(F.col("pos") % 2 != 0, F.concat(F.lit("https://github.com/"), full)).alias("html_url"),
                      F.when(F.col("pos") % 5 != 0, F.col("stars")).alias("stargazers_count"), F.col("forks").alias("forks_count"),
                      F.when(F.col("pos") % 7 != 0, F.col("topics")).alias("topics"))
    payload = F.when(F.col("pos") % 3 == 0, F.to_json(fields, {"ignoreNullFields": "false"})).otherwise(F.to_json(fields))
    p = C.repo_payload_scan(r.select("owner", "pos", payload.alias("payload")))
    return p.withColumn("topics", F.array_join("topics", "|"))


# ---------------------------------------------------------------- 2.10 streaming
LINT_PHRASES = ["error", "purchase", "click", "signup", "view"]
LINT_GAP_MIN = 30


@register("debounced_lint", f"""
with e as (select user_id, ts, event_id, event_type as text,
             coalesce(ts >= lag(ts) over (partition by user_id order by ts, event_id) + interval {LINT_GAP_MIN} minute, true) as new_s
           from events),
s as (select *, sum(new_s::int) over (partition by user_id order by ts, event_id rows unbounded preceding) as sid from e),
g as (select user_id, sid, min(ts) as session_start, max(ts) + interval {LINT_GAP_MIN} minute as session_end, count(*) as n_events,
        arg_max(text, (ts, event_id)) as last_text from s group by all)
select user_id, session_start, session_end, n_events, last_text,
  {" ".join("case when contains(lower(last_text), " + S.q(p) + ") then " + S.q(p) + " else" for p in LINT_PHRASES)} null {"end " * len(LINT_PHRASES)} as phrase,
  replace({S.q(L.LIVE_HINT_MESSAGE)}, '{{phrase}}', {" ".join("case when contains(lower(last_text), " + S.q(p) + ") then " + S.q(p) + " else" for p in LINT_PHRASES)} null {"end " * len(LINT_PHRASES)}) as hint
from g""")
def q_debounced_lint(spark, sf):
    return ST.debounced_lint(_edits(C.load(spark, sf, "events")), f"{LINT_GAP_MIN} minutes", LINT_PHRASES, id_col="event_id")


def _edits(events):
    return events.select("user_id", "ts", "event_id", F.col("event_type").alias("text"))


def _stream_home(spark, name):
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _events_stream(spark, sf):
    schema = C.load(spark, sf, "events").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return e.withColumn("ts", F.col("ts").cast("timestamp"))  # event time needs a zone; results go back without one


LINT_DELAY_MIN = 10


@register("debounced_lint_stream", f"""select * from ({ORACLE['debounced_lint']})
where session_end <= (select date_trunc('milliseconds', max(ts)) from events) - interval {LINT_DELAY_MIN} minute""")
def q_debounced_lint_stream(spark, sf):
    """The events as a stream of edits: the sessions that the watermark has closed."""
    closed = ST.lint_stream(_edits(_events_stream(spark, sf)), _stream_home(spark, "lint"), f"{LINT_GAP_MIN} minutes",
                            f"{LINT_DELAY_MIN} minutes", phrases=LINT_PHRASES, id_col="event_id")
    return closed.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


@register("stream_score", f"""
with {SCREEN_DOCS}, {SCREEN_PAIRS},
sub as (select user_id::varchar as session_id, event_id, ts, event_id % (select count(*) from documents) as doc_id from events)
select session_id, row_number() over (partition by session_id order by ts, event_id, target_id nulls first) as version_id, event_id, doc_id, target_id,
  ats_score, verdict, density_percent, len(parse_issues) as n_parse_issues from sub join vv using (doc_id)""")
def q_stream_score(spark, sf):
    """Every event as a submission of a document by its user, streamed through the scorer."""
    docs = _docs(spark, sf)
    pairs, texts = _doc_pairs(spark, sf)
    n = docs.count()
    sub = _events_stream(spark, sf).select(F.col("user_id").cast("string").alias("session_id"), "event_id", "ts", (F.col("event_id") % n).alias("doc_id"))
    v = ST.stream_score(sub, _stream_home(spark, "stream_score"), docs, texts, pairs, "1 hour")
    return v.select("session_id", "version_id", "event_id", "doc_id", "target_id", "ats_score", "verdict", "density_percent", "n_parse_issues")



# ---------------------------------------------------------------- 2.1 flagship
@register("analysis_report")
def q_analysis_report(spark, sf):
    """One nested analysis row per assigned (candidate, target) pair, serialised as JSON."""
    r = flagship(spark, sf)
    return r.select("doc_id", "target_id", "final_score", "grade",
                    F.to_json(F.struct(*[c for c in r.columns if c not in ("doc_id", "target_id")])).alias("report"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested analysis report (composite score, coverage, readability, verbs, feedback)."""
    pairs, texts = _cand_pairs(spark, sf_dir)
    return RP.analysis_report(_cand_once(spark, sf_dir), texts, spark, pairs, C.load(spark, sf_dir, "embeddings"))
