"""Line rewriting: bullet rewrite, flags, issues, suggestions, project strength,
whole-document rewrite, replacement fold and HTML rendering.

All row-local: per-bullet and per-document arrays are transformed with
higher-order functions inside one projection.
"""

from __future__ import annotations

import html as _html

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from . import extract as X

WEAK_PREFIX = r"(?i)^(" + "|".join(w for w, _ in L.VERB_UPGRADES) + r")\b"
STARTERS_LOWER = [s.lower() for s in L.STRONG_STARTERS]


def _upgrade_map() -> Column:
    """lower weak prefix -> capitalised strong form (first entry wins for duplicates)."""
    seen, keys, vals = set(), [], []
    for w, s in L.VERB_UPGRADES:
        if w not in seen:
            seen.add(w)
            keys.append(F.lit(w))
            vals.append(F.lit(s[:1].upper() + s[1:].lower()))
    return F.map_from_arrays(F.array(*keys), F.array(*vals))


def rewrite_line(b: Column) -> Column:
    """Weak prefix -> strong verb; first char upper; trailing dots dropped; hint if no digit."""
    def swapped(b):
        return T.let(F.regexp_extract(b, WEAK_PREFIX, 1), lambda m: F.when(
            m != "", F.concat(F.element_at(_upgrade_map(), F.lower(m)), F.substring(b, F.length(m) + 1, 1 << 30))).otherwise(b))

    def trimmed(s):
        return F.regexp_replace(F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 1 << 30)), r"\.+\z", "")

    def hinted(t):
        return F.when(t.rlike(r"\d"), t).otherwise(F.concat(t, F.lit(L.QUANT_HINT_SUFFIX)))
    return T.let(T.let(T.let(b, swapped), trimmed), hinted)


def has_quantification(b: Column) -> Column:
    return b.rlike(r"\d")


def has_strong_verb(b: Column) -> Column:
    return T.first_word_lower(b).isin(*STARTERS_LOWER)


def bullet_issues(b: Column) -> Column:
    m = L.BULLET_ISSUE_MESSAGES
    low = F.lower(b)
    weak = F.regexp_extract(low, WEAK_PREFIX, 1)
    n = T.word_count(b)
    vals = [
        F.when(weak != "", F.concat(F.lit("Starts with weak verb '"), weak,
                                    F.lit("' — replace with a strong action verb."))),
        F.when(~has_quantification(b), F.lit(m["no_metric"])),
        F.when(n < 6, F.lit(m["too_short"])),
        F.when(n > 30, F.lit(m["too_long"])),
        F.when(low.rlike(r"\b(was|were|been|being)\b"), F.lit(m["passive"])),
    ]
    return F.filter(F.array(*vals), lambda x: x.isNotNull())


def bullet_suggestions(b: Column) -> Column:
    m = L.BULLET_SUGGESTION_MESSAGES
    verb_msg = m["verb"].format(starters=", ".join(L.STRONG_STARTERS[:6]))
    vals = [
        F.when(~has_quantification(b), F.lit(m["metric"])),
        F.when(~has_strong_verb(b), F.lit(verb_msg)),
        F.when(T.word_count(b) < 8, F.lit(m["expand"])),
        F.lit(m["tech"]),
    ]
    return F.filter(F.array(*vals), lambda x: x.isNotNull())


def analyse_bullets(bullets: DataFrame, col: str = "bullet") -> DataFrame:
    """Per bullet row: improved text, issues, suggestions and the two flags."""
    b = T.py_strip(col)
    return bullets.select(
        "*",
        rewrite_line(b).alias("improved"),
        bullet_issues(b).alias("issues"),
        bullet_suggestions(b).alias("suggestions"),
        has_quantification(b).alias("has_quantification"),
        has_strong_verb(b).alias("has_strong_verb"),
    )


def issue_histogram(analysed: DataFrame) -> DataFrame:
    return analysed.select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


def project_strength(bullets: Column) -> list[Column]:
    """From the array of analysed bullets of a document (all of them): score, counts, message, tips."""
    bullets = F.coalesce(bullets, F.array().cast("array<string>"))
    n = F.size(bullets)
    q = F.size(F.filter(bullets, lambda x: has_quantification(x)))
    s = F.size(F.filter(bullets, lambda x: has_strong_verb(x)))
    raw = (q / n) * 60 + (s / n) * 40
    score = F.when(n == 0, F.lit(0)).otherwise(F.least(F.lit(100), F.floor(raw).cast("int")))
    m = L.PROJECT_MESSAGES
    tips = F.when(n == 0, F.array(F.lit(m["none_tip"]))).otherwise(F.filter(F.array(
        F.when(score < 50, F.lit(m["low"])).when(score < 80, F.lit(m["mid"])).otherwise(F.lit(m["high"])),
        F.when(q < n * 0.5, F.lit(m["metric"]))), lambda x: x.isNotNull()))
    message = F.when(n == 0, F.lit(m["none"])).otherwise(T.filled(m["summary"], score=score, total=n))
    return [score.alias("project_score"), n.alias("total_bullets"), q.alias("quantified_bullets"),
            s.alias("strong_verb_bullets"), message.alias("project_message"), tips.alias("project_tips")]


def rewrite_document(text: Column) -> Column:
    """Rewrite lines of more than 3 words that start with a marker (the marker stays on, so the
    verb map does not fire); all other lines unchanged; rejoin in order."""
    def one(line):
        s = T.py_strip(line)
        return F.when((T.word_count(line) > 3) & s.rlike("^[-*•‣◦]"), rewrite_line(s)).otherwise(line)
    return F.array_join(F.transform(F.split(T.col(text), "\n"), one), "\n")


def apply_replacements(text: Column, pairs: Column) -> Column:
    """Fold (original, improved) pairs over the text in order; every occurrence replaced."""
    return F.aggregate(pairs, T.col(text), lambda t, p: F.when(
        (F.coalesce(p["original"], F.lit("")) != "") & (F.coalesce(p["improved"], F.lit("")) != "")
        & t.contains(p["original"]), F.replace(t, p["original"], p["improved"])).otherwise(t))


def _escape(c: Column) -> Column:
    c = F.replace(c, F.lit("&"), F.lit("&amp;"))
    c = F.replace(c, F.lit("<"), F.lit("&lt;"))
    c = F.replace(c, F.lit(">"), F.lit("&gt;"))
    return F.replace(c, F.lit('"'), F.lit("&quot;"))


def render_html_lines(text: Column, date_str: str, heading: str = "Optimized document",
                      footer: str = "Optimized on {date}") -> Column:
    """Paragraphs on blank lines; runs of bullet lines become one <ul>, others <p>; escaped;
    heading, footer and footer date are parameters (a rerun gives the same output)."""
    is_b = "^[-*•‣◦]"

    def stripped(p):
        return F.filter(F.transform(F.split(p, "\n"), lambda x: T.py_strip(x)), lambda x: x != "")

    def para(lines):
        def render(x, i):
            prev_b = F.when(i > 0, F.element_at(lines, i).rlike(is_b)).otherwise(F.lit(False))
            next_b = F.when(i + 1 < F.size(lines), F.element_at(lines, i + 2).rlike(is_b)).otherwise(F.lit(False))
            bullet = x.rlike(is_b)
            body = _escape(F.regexp_replace(x, f"{is_b}[ \\t\\n\\r\\f\\x0B]*", ""))
            return F.when(bullet, F.concat(F.when(~prev_b, F.lit("<ul>\n")).otherwise(F.lit("")),
                                           F.lit("<li>"), body, F.lit("</li>\n"),
                                           F.when(~next_b, F.lit("</ul>\n")).otherwise(F.lit("")))) \
                .otherwise(F.concat(F.lit("<p>"), _escape(x), F.lit("</p>\n")))
        return F.array_join(F.transform(lines, render), "")

    # the lines of a paragraph are a lambda's variable: as an expression they would be made anew for each of its lines
    paragraphs = F.transform(F.split(T.col(text), "\n\n"), stripped)
    body = F.array_join(F.transform(paragraphs, para), "")
    foot = f'<div class="watermark">{_html.escape(footer.format(date=date_str))}</div>\n'
    return F.concat(F.lit(f"<h1>{_html.escape(heading)}</h1>\n"), body, F.lit(foot))


def bullet_table(docs: DataFrame, text_col: str = "text", limit: int | None = None) -> DataFrame:
    """(doc_id, bullet_no, bullet, improved, issues, suggestions, flags) for all bullets, or the first ``limit``."""
    return analyse_bullets(X.extract_bullets(docs, text_col, limit))
