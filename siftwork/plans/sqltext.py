"""SQL (DuckDB dialect) twins of the Column helpers and derived corpora.

These strings are the oracle side of the correctness gate: the same semantics
written as plain SQL over the registered parquet views.  Values from the fixed
lexicons are rendered as SQL literals from the one Python source.
"""

from __future__ import annotations

from ..functions import lexicons as L
from ..sources import derived as D

WS = r"[ \t\n\r\f\x0B]"
WS_RUN = r"[ \t\n\r\f\x0B]+"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def lst(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def values(rows, cols: str) -> str:
    """(VALUES ...) AS t(cols) from Python tuples of str/int/float."""
    def lit(v):
        if isinstance(v, str):
            return q(v)
        if isinstance(v, (list, tuple)):
            return lst(v)
        return repr(v)
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS {cols}"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS_RUN}|{WS_RUN}$', '', 'g')"


def clean(x: str) -> str:
    t = f"regexp_replace(coalesce({x}, ''), '\\r\\n|\\r', chr(10), 'g')"
    t = f"regexp_replace({t}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    t = f"regexp_replace({t}, '[ \\t]{{2,}}', ' ', 'g')"
    t = f"regexp_replace({t}, '[^\\x20-\\x7E\\n]', ' ', 'g')"
    return f"regexp_replace({t}, '^[ \\n]+|[ \\n]+$', '', 'g')"


def replaced(x: str) -> str:
    t = f"regexp_replace({x}, '\\r\\n|\\r', chr(10), 'g')"
    t = f"regexp_replace({t}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    t = f"regexp_replace({t}, '[ \\t]{{2,}}', ' ', 'g')"
    return f"len(regexp_extract_all({t}, '[^\\x20-\\x7E\\n]'))"


def rcount(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {q(pattern)}))"


def word_count(x: str) -> str:
    return rcount(f"coalesce({x}, '')", r"[^ \t\n\r\f\x0B]+")


def norm(x: str) -> str:
    t = f"lower({x})"
    t = f"regexp_replace({t}, '([^a-z0-9 \\t\\n\\r\\f\\x0B])', ' \\1 ', 'g')"
    t = f"regexp_replace({t}, '\\n', ' ' || chr(10) || ' ', 'g')"
    t = f"regexp_replace({t}, '[ \\t\\r\\f\\x0B]+', ' ', 'g')"
    return f"regexp_replace({t}, '^ +| +$', '', 'g')"


def cand_sql() -> str:
    lex, verb = D.lex_list(), D.verb_list()
    return f"""
select c_custkey as doc_id,
  'Candidate ' || c_custkey
  || case when c_custkey % 5 <> 0 then chr(10) || 'Email: c' || c_custkey
       || '@mail.example | Phone: +1 555 010 ' || (1000 + c_custkey % 9000) else '' end
  || case when c_custkey % 3 = 0 then chr(10) || 'linkedin.com/in/c' || c_custkey else '' end
  || case when c_custkey % 4 <> 0 then chr(10) || chr(10) || 'SUMMARY' || chr(10) || 'Results-driven '
       || lower(c_mktsegment) || ' engineer since ' || (1990 + c_custkey % 34) || '.' else '' end
  || case when c_custkey % 11 <> 0 then chr(10) || chr(10) || 'EXPERIENCE' else '' end
  || coalesce(chr(10) || bullets, '')
  || case when c_custkey % 7 <> 0 then chr(10) || chr(10) || 'EDUCATION' || chr(10) || 'Bachelor, '
       || (1985 + c_custkey % 30) else '' end
  || case when c_custkey % 6 <> 0 then chr(10) || chr(10) || 'SKILLS' || chr(10)
       || {lst(lex)}[1 + c_custkey % {len(lex)}] || ', ' || {lst(lex)}[1 + (c_custkey*13) % {len(lex)}] else '' end
  || case when c_custkey % 9 = 0 then chr(10) || 'A ' || {lst(L.WEAK_SKILLS)}[1 + c_custkey % {len(L.WEAK_SKILLS)}] || ' person' else '' end as text
from customer left join (
  select o_custkey, string_agg(
    '- ' || {lst(verb)}[1 + (l_partkey*5 + l_linenumber) % {len(verb)}] || ' '
         || {lst(lex)}[1 + (l_partkey*7 + l_suppkey*3) % {len(lex)}] || ' service'
         || case when l_linenumber % 2 = 0
                 then ' by ' || cast(cast(l_quantity as int) as varchar) || '%' else '' end,
    chr(10) order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) as bullets
  from lineitem join orders on l_orderkey = o_orderkey group by o_custkey) b on c_custkey = o_custkey
"""


def targ_sql() -> str:
    lex = D.lex_list()
    return f"""
select cast(substr(p_brand, 7) as bigint) as target_id,
  'Opening ' || p_brand || chr(10)
  || string_agg('- Strong ' || {lst(lex)}[1 + (p_partkey*7) % {len(lex)}] || ' required', chr(10) order by p_partkey) as text
from part group by p_brand
"""


def repos_sql() -> str:
    langs, topics = D.lang_list(), D.topic_list()
    return f"""
select l_suppkey as owner,
  'proj-' || l_orderkey || '_' || l_linenumber as name,
  p_name || ' with ' || {lst(topics)}[1 + (l_orderkey*3 + l_linenumber) % {len(topics)}] as description,
  {lst(langs)}[1 + l_partkey % {len(langs)}] as language,
  cast(l_quantity as bigint) as stars,
  l_orderkey % 7 as forks,
  [{lst(topics)}[1 + l_partkey % {len(topics)}], 'topic' || (l_orderkey % 5)] as topics,
  row_number() over (partition by l_suppkey
    order by l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate) as pos
from lineitem join part on l_partkey = p_partkey
"""


def lexicon_values() -> str:
    return values([r[:4] for r in L.lexicon_rows()], "lex(term, norm, canonical, category)")


def assign_sql(docs: str, targets: str, n: str, id_of: str) -> tuple[str, str]:
    """CTE bodies (assignment, texts): ``docs`` has doc_id, ``targets`` target_id and text; ``id_of`` is SQL of r."""
    roles, k = L.ROLE_NAMES, len(L.ROLE_NAMES)
    picks = " union all ".join(f"select doc_id, (doc_id * {f} + {o}) % ({n} + {k + D.EMPTY_CHOICES}) as r from {docs}" for f, o in D.CHOICES)
    pairs = f"""select distinct doc_id, case when t.target_id is not null then t.target_id when r < {n} + {k} then -1 - ((r - {n}) % {k} + {k}) % {k} end as target_id,
  case when t.target_id is not null then 'text' when r < {n} + {k} then 'role' else 'none' end as target_kind
from ({picks}) c left join (select target_id from {targets} where {strip("coalesce(text, '')")} <> '') t on r < {n} and t.target_id = {id_of}"""
    texts = f"""select target_id, {strip('text')} as text, 'text' as target_kind from {targets} where {strip("coalesce(text, '')")} <> ''
union all select id, role, 'role' from {values([(-1 - i, r) for i, r in enumerate(roles)], "r(id, role)")}"""
    return pairs, texts
