"""SQL twin of ``plans/features.py`` (DuckDB dialect) for the oracle queries."""

from __future__ import annotations

from ..functions import lexicons as L
from ..operators import extract as X
from .sqltext import WS_RUN, q, rcount, strip, values, word_count

MARK = "[-*•‣◦]"
SPLIT = X.SENTENCE_SPLIT


def bullets(t: str, limit: int | None = None) -> str:
    lines = f"list_transform(string_split({t}, chr(10)), lambda x: {strip('x')})"
    marked = f"list_filter({lines}, lambda x: regexp_matches(x, {q('^' + MARK + WS_RUN)}))"
    body = strip(f"regexp_replace(x, {q('^' + MARK + WS_RUN)}, '')")
    bodies = f"list_transform({marked}, lambda x: {body})"
    kept = f"list_filter({bodies}, lambda x: length(x) > 15)"
    return f"{kept}[1:{limit}]" if limit else kept


def sentences(t: str, limit: int | None = None) -> str:
    parts = f"list_transform(regexp_split_to_array({t}, {q(SPLIT)}), lambda x: {strip('x')})"
    kept = f"list_filter({parts}, lambda x: length(x) > 20)"
    return f"{kept}[1:{limit}]" if limit else kept


def section_cols(t: str, patterns=L.SECTION_PATTERNS, prefix: str = "has_") -> str:
    return ", ".join(f"regexp_matches(lower({t}), {q(p)}) as {prefix}{k}" for k, p in patterns)


def bullet_count(t: str, marker: str) -> str:
    return rcount(t, f"(?m)^[ \\t\\n\\r\\f\\x0B]*{marker}")


def readability_cols(t: str) -> str:
    norm = f"regexp_replace({t}, {q(MARK + '[ \\t\\n\\r\\f\\x0B]*')}, chr(10), 'g')"
    n_sent = f"len(list_filter(regexp_split_to_array({norm}, {q(SPLIT)}), lambda s: length({strip('s')}) > 5))"
    words = f"regexp_extract_all(lower({norm}), '[a-z0-9]+')"
    syl = (f"(len(regexp_extract_all(lower({norm}), '[aeiouy]+')) + "
           f"len(list_filter({words}, lambda w: not regexp_matches(w, '[aeiouy]'))))")
    s = f"greatest({n_sent}, 1)"
    w = f"greatest(len({words}), 1)"
    avg = f"({w} / {s})"
    fk_raw = f"greatest(0.0, least(100.0, 206.835::double - 1.015::double * {avg} - 84.6::double * ({syl} / {w})))"
    return f"""{w} as word_count, {s} as sentence_count, round({avg}, 1) as avg_words_per_sentence,
  round({fk_raw}, 1) as flesch_kincaid_score,
  case when {fk_raw} >= 70 then 'Easy' when {fk_raw} >= 50 then 'Standard' when {fk_raw} >= 30 then 'Difficult'
       else 'Very Difficult' end as readability_grade"""


def contact_cols(t: str) -> str:
    low = f"lower({t})"
    sw = " or ".join(f"contains({low}, {q(w)})" for w in L.SOFTWARE_ROLE_WORDS)
    return f"""regexp_matches({t}, {q(X.EMAIL)}) as has_email, regexp_matches({t}, {q(X.PHONE)}) as has_phone,
  {rcount(t, X.DATE)} as n_dates, contains({low}, 'linkedin') as has_linkedin,
  contains({low}, 'github') as has_github, ({sw}) as software_role"""


def features(src: str, t: str = "text") -> str:
    """SELECT of the per-document feature row over relation ``src`` with columns doc_id and ``t``."""
    return f"""select doc_id, {section_cols(t)}, {readability_cols(t)},
  {rcount(t, r'\b\d+\b')} as quant_count, {contact_cols(t)},
  {bullet_count(t, MARK)} as feedback_bullets, {bullets(t)} as bullets
from {src}"""


def verbs_values() -> str:
    rows = [(v, "strong", i) for i, v in enumerate(L.ACTION_VERBS)] + [(v, "weak", i) for i, v in enumerate(L.WEAK_VERBS)]
    return values(rows, "vb(verb, kind, ord)")


def verb_usage(src: str, t: str = "text") -> str:
    """doc_id, strong_verbs, weak_verbs (lists in order of first use), n_strong, n_weak."""
    return f"""
with toks as (select doc_id, unnest(regexp_extract_all(lower({t}), '[a-z]+')) as verb,
                     unnest(generate_series(0, len(regexp_extract_all(lower({t}), '[a-z]+')) - 1)) as pos from {src}),
hits as (select doc_id, kind, verb, min(pos) as first from toks join {verbs_values()} using (verb) group by all),
per as (select doc_id,
   coalesce(list(verb order by first) filter (where kind = 'strong'), []) as strong_verbs,
   coalesce(list(verb order by first) filter (where kind = 'weak'), []) as weak_verbs
 from hits group by doc_id)
select s.doc_id, coalesce(strong_verbs, []) as strong_verbs, coalesce(weak_verbs, []) as weak_verbs,
       coalesce(len(strong_verbs), 0) as n_strong, coalesce(len(weak_verbs), 0) as n_weak
from {src} s left join per on s.doc_id = per.doc_id"""


def sec_score(p: str = "") -> str:
    req = " + ".join(f"{p}has_{s}::int" for s in L.REQUIRED_SECTIONS)
    bon = " + ".join(f"{p}has_{s}::int" for s in L.BONUS_SECTIONS)
    return f"(0.8::double * (({req}) / 3) + 0.2::double * (({bon}) / 4))"


def length_score(w: str) -> str:
    return (f"(case when {w} < 150 then 0.3::double when {w} < 300 then 0.6::double when {w} <= 900 then 1.0::double "
            f"when {w} <= 1200 then 0.8::double else 0.6::double end)")


def content_strength(n_strong: str, n_weak: str, quant: str, words: str) -> str:
    v = (f"0.35::double * least(1.0::double, {n_strong} / 10.0::double) + 0.25::double * least(1.0::double, {quant} / 10.0::double)"
         f" + 0.25::double * {length_score(words)} - least(0.3::double, {n_weak} * 0.05::double)")
    return f"greatest(0.0::double, least(1.0::double, {v}))"


def readability_score(fk: str, avg: str) -> str:
    a = (f"(case when {fk} >= 50 and {fk} <= 70 then 1.0::double when ({fk} >= 30 and {fk} < 50) or ({fk} > 70 and {fk} <= 80) "
         f"then 0.75::double else 0.5::double end)")
    b = (f"(case when {avg} >= 10 and {avg} <= 20 then 1.0::double when ({avg} >= 8 and {avg} < 10) or ({avg} > 20 and {avg} <= 25) "
         f"then 0.75::double else 0.5::double end)")
    return f"(0.6::double * {a} + 0.4::double * {b})"


def doc_dims(src: str) -> str:
    """CTE body: features + verbs + section/content/readability scores for relation ``src``."""
    return f"""
  with f as ({features(src)}), v as ({verb_usage(src)}),
  fv as (select f.*, coalesce(v.strong_verbs, []) as strong_verbs, coalesce(v.weak_verbs, []) as weak_verbs,
           coalesce(v.n_strong, 0) as n_strong, coalesce(v.n_weak, 0) as n_weak from f left join v using (doc_id))
  select *, {sec_score()} as section_completeness,
    {content_strength('n_strong', 'n_weak', 'quant_count', 'word_count')} as content_strength,
    {readability_score('flesch_kincaid_score', 'avg_words_per_sentence')} as readability_score
  from fv"""


def composite(sem: str, kw: str, sec: str, cs: str, rd: str) -> str:
    w = {k: v for k, v, _ in L.DIMENSIONS}
    tot = (f"({sem} * {w['semantic_similarity']}::double + {kw} * {w['keyword_coverage']}::double + "
           f"{sec} * {w['section_completeness']}::double + {cs} * {w['content_strength']}::double + "
           f"{rd} * {w['readability']}::double) * 100")
    return f"round(greatest(0.0::double, least(100.0::double, {tot})), 1)"


def grade(x: str) -> str:
    return (f"(case when {x} >= 85 then 'Excellent' when {x} >= 70 then 'Good' when {x} >= 55 then 'Average' "
            f"when {x} >= 40 then 'Below Average' else 'Poor' end)")


# ---------------------------------------------------------------- screening
from ..operators import screen as _SC  # noqa: E402


def screen_features(src: str, t: str = "text") -> str:
    t = f"coalesce({t}, '')"
    third = f"substring({t}, 1, length({t}) // 3)"
    first_line = f"regexp_extract({third}, '^[ \\t\\n\\r\\f\\x0B]*([^\\n]*)', 1)"
    parse = ", ".join(f"regexp_matches({t}, {q(p)}) as parse_{k}" for k, p, _ in L.PARSE_RULES if p is not None)
    secs = ", ".join(f"regexp_matches(lower({t}), {q(p)}) as sec_{k}" for k, p in L.SCREEN_SECTION_PATTERNS)
    return f"""select doc_id, {word_count(t)} as ws_words,
  regexp_matches({third}, {q(_SC.SCAN_CONTACT)}) as scan_contact,
  (length({strip(first_line)}) > 0 and {word_count(first_line)} <= 5) as scan_title,
  regexp_matches({third}, {q(_SC.SCAN_SUMMARY)}) as scan_summary,
  {bullet_count(t, X.SCREEN_BULLET)} as screen_bullets, {rcount(t, r'\b\d+\b')} as quant_count,
  regexp_matches({t}, {q(X.YEAR)}) as has_year, {parse}, {secs}
from {src}"""


def _arr(items) -> str:
    return "list_filter([" + ", ".join(f"case when {c} then {v} end" for c, v in items) + "], lambda x: x is not null)"


def screen_lists(src: str) -> str:
    """Adds scan_issues, scan_strengths, parse_issues, weak (list of struct) to ``src`` rows."""
    m = L.SCAN_MESSAGES
    issues = _arr([("not scan_contact", q(m["contact_bad"])), ("not scan_title", q(m["title_bad"])),
                   ("not scan_summary", q(m["summary_bad"])), ("ws_words < 200", q(m["sparse"])),
                   ("ws_words > 1200", q(m["long"]))])
    strengths = _arr([("scan_contact", q(m["contact_ok"])), ("scan_title", q(m["title_ok"])),
                      ("scan_summary", q(m["summary_ok"])),
                      ("ws_words >= 200 and ws_words <= 1200",
                       "'Resume length (' || ws_words || ' words) is within acceptable range.'")])
    msgs = {k: msg for k, _, msg in L.PARSE_RULES}
    parse = _arr([(f"parse_{k}", q(msgs[k])) for k, p, _ in L.PARSE_RULES if p is not None]
                 + [("not has_year", q(msgs["no_dates"])), ("screen_bullets < 3", q(msgs["few_bullets"]))])
    conds = {"no_contact": "not sec_contact", "no_experience": "not sec_experience",
             "few_exp_bullets": "sec_experience and screen_bullets < 4", "no_skills": "not sec_skills",
             "no_education": "not sec_education", "no_summary": "not sec_summary", "few_numbers": "quant_count < 3"}
    weak = _arr([(conds[k], f"{{'section': {q(sec)}, 'reason': {q(reason)}, 'severity': {q(sev)}}}")
                 for k, sec, reason, sev in L.WEAK_SECTION_RULES])
    return f"select *, {issues} as scan_issues, {strengths} as scan_strengths, {parse} as parse_issues, {weak} as weak from {src}"


def verdict_cols(density: str = "density_percent") -> str:
    """ats_score, verdict, reasoning over a relation with screen lists and a density column."""
    m = L.VERDICT_MESSAGES
    crit = ["experience", "skills", "education", "contact"]
    missing = _arr([(f"not sec_{s}", q(s)) for s in crit])
    d = f"coalesce({density}::double, {L.NO_TARGET_DENSITY}::double)"
    ncw = "len(list_filter(weak, lambda w: w.severity = 'critical'))"
    raw = (f"(100 - len({missing}) * 20 - len(parse_issues) * 8 - len(scan_issues) * 5 - "
           f"(case when {d} < 30 then 15 when {d} < 50 then 5 else 0 end) - {ncw} * 10)")
    score = f"greatest(0, least(100, {raw}))"
    reasons = _arr([(f"len({missing}) > 0", f"'Missing critical sections: ' || array_to_string({missing}, ', ') || '.'"),
                    ("len(parse_issues) > 0", "len(parse_issues) || ' ATS parsing issue(s) detected.'"),
                    ("len(scan_issues) > 0", q(m["scan"])),
                    (f"{d} < 30", f"'Low keyword match (' || printf('%.1f', {d}) || '%) with job description.'")])
    tail = (f"(case when {score} >= 70 then (case when len({reasons}) = 0 then [{q(m['pass_default'])}] else [] end) "
            f"when {score} >= 45 then [{q(m['conditional'])}] else [{q(m['fail'])}] end)")
    verdict = f"(case when {score} >= 70 then 'PASS' when {score} >= 45 then 'CONDITIONAL' else 'FAIL' end)"
    return f"{score} as ats_score, {verdict} as verdict, list_concat({reasons}, {tail}) as reasoning"


def recommendation_col(missing: str = "top_missing_list") -> str:
    parse = "list_transform(parse_issues, lambda x: {'priority': 'high', 'action': x})"
    crit = ("list_transform(list_filter(weak, lambda w: w.severity = 'critical'), "
            "lambda w: {'priority': 'critical', 'action': w.reason})")
    miss = f"coalesce({missing}, [])"
    kw = (f"(case when len({miss}) > 0 then [{{'priority': 'medium', 'action': "
          f"'Add these missing keywords from the job description: ' || array_to_string({miss}, ', ') || '.'}}] else [] end)")
    high = ("list_transform(list_filter(weak, lambda w: w.severity = 'high'), "
            "lambda w: {'priority': 'high', 'action': w.reason})")
    return f"list_concat({parse}, {crit}, {kw}, {high}) as recommendations"


# ---------------------------------------------------------------- rewriting
from ..operators import rewrite as _RW  # noqa: E402

STARTERS_SQL = "[" + ", ".join(q(s) for s in _RW.STARTERS_LOWER) + "]"


def first_word(b: str) -> str:
    return f"regexp_replace(lower(regexp_extract({b}, '^[ \\t\\n\\r\\f\\x0B]*([^ \\t\\n\\r\\f\\x0B]+)', 1)), '[.,;]+$', '')"


def strong_verb(b: str) -> str:
    return f"list_contains({STARTERS_SQL}, {first_word(b)})"


def rewrite(b: str) -> str:
    m = f"regexp_extract({b}, {q(_RW.WEAK_PREFIX)}, 1)"
    seen, whens = set(), []
    for w, st in L.VERB_UPGRADES:
        if w not in seen:
            seen.add(w)
            whens.append(f"when {q(w)} then {q(st[:1].upper() + st[1:].lower())}")
    cap = f"(case lower({m}) {' '.join(whens)} end)"
    swapped = f"(case when {m} <> '' then {cap} || substring({b}, length({m}) + 1) else {b} end)"
    upper_first = f"(upper(substring({swapped}, 1, 1)) || substring({swapped}, 2))"
    trimmed = f"regexp_replace({upper_first}, '\\.+\\z', '')"
    return f"(case when regexp_matches({trimmed}, '\\d') then {trimmed} else {trimmed} || {q(L.QUANT_HINT_SUFFIX)} end)"


def issues(b: str) -> str:
    m = L.BULLET_ISSUE_MESSAGES
    weak = f"regexp_extract(lower({b}), {q(_RW.WEAK_PREFIX)}, 1)"
    n = word_count(b)
    return _arr([(f"{weak} <> ''", f"'Starts with weak verb ''' || {weak} || ''' — replace with a strong action verb.'"),
                 (f"not regexp_matches({b}, '\\d')", q(m["no_metric"])),
                 (f"{n} < 6", q(m["too_short"])), (f"{n} > 30", q(m["too_long"])),
                 (f"regexp_matches(lower({b}), '\\b(was|were|been|being)\\b')", q(m["passive"]))])


def suggestions(b: str) -> str:
    m = L.BULLET_SUGGESTION_MESSAGES
    verb_msg = m["verb"].format(starters=", ".join(L.STRONG_STARTERS[:6]))
    return _arr([(f"not regexp_matches({b}, '\\d')", q(m["metric"])), (f"not {strong_verb(b)}", q(verb_msg)),
                 (f"{word_count(b)} < 8", q(m["expand"])), ("true", q(m["tech"]))])


def project_strength(bl: str) -> str:
    m = L.PROJECT_MESSAGES
    n = f"len({bl})"
    qn = f"len(list_filter({bl}, lambda x: regexp_matches(x, '\\d')))"
    sn = f"len(list_filter({bl}, lambda x: {strong_verb('x')}))"
    score = f"(case when {n} = 0 then 0 else least(100, floor(({qn} / {n}) * 60 + ({sn} / {n}) * 40)::bigint) end)"
    tips = (f"(case when {n} = 0 then [{q(m['none_tip'])}] else list_filter([case when {score} < 50 then {q(m['low'])} "
            f"when {score} < 80 then {q(m['mid'])} else {q(m['high'])} end, case when {qn} < {n} * 0.5 then {q(m['metric'])} end], "
            f"lambda x: x is not null) end)")
    msg = (f"(case when {n} = 0 then {q(m['none'])} else 'Project Strength Score: ' || {score} || '/100 based on ' || {n} "
           f"|| ' bullet points.' end)")
    return (f"{score} as project_score, {n} as total_bullets, {qn} as quantified_bullets, {sn} as strong_verb_bullets, "
            f"{msg} as project_message, {tips} as project_tips")


def rewrite_document(t: str) -> str:
    body = f"case when {word_count('line')} > 3 and regexp_matches({strip('line')}, '^{MARK}') then {rewrite(strip('line'))} else line end"
    return f"array_to_string(list_transform(string_split({t}, chr(10)), lambda line: {body}), chr(10))"


# ---------------------------------------------------------------- feedback
def distinct_in_order(lst: str) -> str:
    return f"list_filter({lst}, lambda x, i: list_position({lst}, x) = i)"


def missing_sections() -> str:
    advice = dict(L.SECTION_ADVICE)
    items = []
    for s, _ in L.SECTION_PATTERNS:
        pr = "high" if s in L.HIGH_PRIORITY_SECTIONS else "medium"
        items.append((f"not has_{s}", f"{{'section': {q(s)}, 'priority': {q(pr)}, 'suggestion': {q(advice[s])}}}"))
    return _arr(items)


def verb_strength(n: str) -> str:
    return f"(case when {n} >= 8 then 'strong' when {n} >= 4 then 'moderate' else 'weak' end)"


def verb_upgrades(weak_verbs: str, weak_skills: str) -> str:
    cases = " ".join(f"when {q(w)} then {q(sg)}" for w, sg in L.WEAK_TO_STRONG)
    m = f"(case v {cases} end)"
    skill = " ".join(f"when {q(w)} then {q(sg)}" for w, sg in L.WEAK_SKILL_ADVICE)
    verbs = f"list_transform(list_filter({weak_verbs}, lambda v: {m} is not null), lambda v: {{'weak': v, 'suggestions': {m}}})"
    skills = (f"list_transform({weak_skills}, lambda w: {{'weak': 'Skill: ' || chr(39) || w || chr(39), "
              f"'suggestions': case w {skill} else {q(L.WEAK_SKILL_DEFAULT_ADVICE)} end}})")
    return f"list_concat({verbs}, {skills})"


def content_items() -> str:
    m = L.CONTENT_MESSAGES

    def item(t, p, msg):
        return f"{{'type': {q(t)}, 'priority': {q(p)}, 'message': {msg}}}"
    return _arr([
        ("quant_count < 3", item("quantification", "high", q(m["quant_high"]))),
        ("quant_count >= 3 and quant_count < 6", item("quantification", "medium",
         "'You have ' || quant_count || ' quantified points. Aim for at least 6-8 metrics to strengthen impact.'")),
        ("word_count < 200", item("length", "high",
         "'Resume is too short (' || word_count || ' words). Expand your experience and skills sections to 400-700 words.'")),
        ("word_count > 1000", item("length", "medium",
         "'Resume is quite long (' || word_count || ' words). Consider trimming to 600-800 words for better ATS parsing.'")),
        ("n_tech < 10", item("skills", "medium", q(m["skills"]))),
        ("not has_email", item("contact", "high", q(m["email"]))),
        ("not has_phone", item("contact", "medium", q(m["phone"]))),
    ])


def readability_tips() -> str:
    m = L.READABILITY_MESSAGES
    tips = _arr([("avg_words_per_sentence > 25", q(m["long"])), ("avg_words_per_sentence < 6", q(m["short"])),
                 ("flesch_kincaid_score < 30", q(m["complex"])), ("flesch_kincaid_score > 80", q(m["simple"]))])
    return f"(case when len({tips}) = 0 then [{q(m['good'])}] else {tips} end)"


def readability_fixes() -> str:
    m = L.READABILITY_MESSAGES
    fix = lambda k: f"{{'issue': {q(m[k + '_issue'])}, 'before': {q(m[k + '_before'])}, 'after': {q(m[k + '_after'])}}}"
    return _arr([("avg_words_per_sentence > 25", fix("long_fix")), ("flesch_kincaid_score < 30", fix("complex_fix"))])


def structure_items() -> str:
    m = L.STRUCTURE_MESSAGES

    def item(t, k):
        return f"{{'type': {q(t)}, 'message': {q(m[k])}}}"
    return _arr([("n_dates < 2", item("dates", "dates")), ("not has_linkedin", item("links", "linkedin")),
                 ("not has_github and software_role", item("links", "github")),
                 ("feedback_bullets < 5", item("formatting", "bullets"))])


def keyword_suggestions(missing: str) -> str:
    return (f"list_transform({missing}, lambda kw_: 'Consider adding ''' || kw_ || "
            f"''' — it appears in the job description but not your resume.')")


def keyword_examples(missing: str) -> str:
    tpls = "[" + ", ".join(q(t) for t in L.KEYWORD_TEMPLATES) + "]"
    return (f"list_transform({missing}, lambda kw_, i: {{'keyword': kw_, 'example': "
            f"replace({tpls}[((i - 1) % {len(L.KEYWORD_TEMPLATES)}) + 1], '{{kw}}', kw_)}})")


def top_suggestions(kw_suggestions: str) -> str:
    parts = (f"list_concat(list_concat(list_concat(list_concat("
             f"list_transform(list_filter(missing_sections, lambda x: x.priority = 'high'), lambda x: x.suggestion), "
             f"list_transform(list_filter(content_feedback, lambda x: x.priority = 'high'), lambda x: x.message)), "
             f"coalesce({kw_suggestions}, [])[1:1]), "
             f"case when n_strong = 0 then [{q(L.VERB_TIPS['other'])}] else [] end), "
             f"list_transform(structure_feedback, lambda x: x.message))")
    return distinct_in_order(parts)


def skills_phrase(skills: str) -> str:
    top = f"(case when len({skills}) > 0 then {skills} else {'[' + ', '.join(q(x) for x in L.PROFILE_DEFAULT_SKILLS) + ']'} end)[1:3]"
    return (f"(case when len({top}) > 1 then array_to_string({top}[1:len({top}) - 1], ', ') || ' and ' || {top}[len({top})] "
            f"else {top}[1] end)")
