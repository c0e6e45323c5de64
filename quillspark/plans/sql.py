"""Pieces of DuckDB's SQL for the oracles. RE2 has no lookaround: guards are matched around a group, on a text whose
blanks are doubled so that neighbouring atoms don't share one."""

from __future__ import annotations

from quillspark.functions import patterns as P
from quillspark.sources.decoration import BLOCKS_SQL


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def with_blocks(sql: str, *more: str) -> str:
    """more: further common table expressions."""
    return "WITH " + ", ".join([BLOCKS_SQL, *more]) + " " + sql


def every(text: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({text}, {q(pattern)}, {group})"


def guarded(text: str, before: str, core: str, after: str) -> str:
    return f"list_transform({every(f'replace({text}, {q(" ")}, {q("  ")})', f'(?:^|{before})({core}){after}', 1)}, lambda v: replace(v, '  ', ' '))"


def quantity(text: str) -> str:
    return guarded(text, "[^A-Za-z0-9_.]", P.NUMBER + "[ \\t  ]*" + P.UNIT, "(?:$|[^A-Za-z0-9])")


def numeric(text: str) -> str:
    core = P.NUMERIC.removeprefix("(?<![A-Za-z])").removesuffix("(?![A-Za-z])")
    apart = f"regexp_replace({text}, '([-(),:;@#])', '\\1\\1', 'g')"  # as blanks are: no separator serves two numbers
    return guarded(apart, "[^A-Za-z]", core, "(?:\\b|$|[^A-Za-z])")


def citation(text: str) -> str:
    return every(text, P.CITATION)


def figure(text: str) -> str:
    core = P.FIGURE.removeprefix("(?iu)\\b").removesuffix("(?![A-Za-z0-9])")
    return guarded(text, "[^A-Za-z0-9_À-ɏ]", f"(?i:{core})", "(?:$|[^A-Za-z0-9])")


def figure_localised(text: str) -> str:
    return every(text, P.FIGURE_LOCALISED.replace("(?iu)", "(?i)"))


def subscript_variable(text: str) -> str:
    return guarded(text, "[^A-Za-z0-9_À-ɏ]", P.SUBSCRIPT_VARIABLE.removeprefix("\\b").removesuffix("\\b"), "(?:$|[^A-Za-z0-9_])")


def dates(text: str) -> str:
    a, b = (x.removeprefix("(?iu)").removeprefix("\\b").removesuffix("\\b") for x in P.DATE.split("|\\b"))
    return guarded(text, "[^A-Za-z0-9_À-ɏ]", f"(?i:{a}|{b})", "(?:$|[^A-Za-z0-9_])")


def prose(text: str) -> str:
    return f"regexp_replace({text}, '</?(?:sub|sup)>', '', 'g')"


def squeezed(text: str) -> str:
    return f"regexp_replace({text}, '\\s+', '', 'g')"


def stripped(text: str) -> str:
    return f"regexp_replace({text}, '^\\s+|\\s+$', '', 'g')"


def merged(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '</sup>\\s*<sup>', '', 'g'), '</sub>\\s*<sub>', '', 'g')"


def folded(text: str) -> str:
    return f"translate({prose(text)}, '⁰¹²³⁴⁵⁶⁷⁸⁹₀₁₂₃₄₅₆₇₈₉', '01234567890123456789')"


def symbols(text: str) -> str:
    return every(folded(text), P.SYMBOL)


def first_seen(items: str) -> str:
    return f"list_filter({items}, lambda x, i: list_position({items}, x) = i)"


def tokens(text: str) -> str:
    parts = [quantity(text), numeric(text), citation(text), figure(text), subscript_variable(text), every(text, P.SYMBOL)]
    return f"list_filter(list_transform(flatten([{', '.join(parts)}]), lambda v: {stripped('v')}), lambda v: v <> '')"


def figure_key(ref: str) -> str:
    t = f"regexp_replace(translate(lower({stripped(ref)}), '（）', '()'), '\\s+', '', 'g')"
    for pattern, to in (("^(fig\\.?|figure|图)", "fig"), ("^(table|表)", "table"), ("^(eq\\.?|equation|式)", "eq")):
        t = f"regexp_replace({t}, {q(pattern)}, '{to}')"
    return t


def joined(items: str) -> str:
    return f"coalesce(array_to_string({items}, '|'), '')"


def formula(text: str) -> str:
    """A boolean over a column; as looks_like_formula()."""
    t = stripped(prose(text))
    long_words = f"len(list_filter({every(t, '[A-Za-z]{4,}')}, lambda w: lower(w) NOT IN ({', '.join(map(q, P.MATH_WORDS))})))"
    short = f"length({squeezed(t)}) <= 96"
    m = lambda p: f"regexp_matches({t}, {q(p)})"
    return (
        f"CASE WHEN length({t}) = 0 OR length({t}) > 400 THEN false WHEN {m(P.CAPTION.replace('(?iu)', '(?i)'))} THEN false WHEN {m('^\\(\\d+[a-z]?\\)$')} THEN true "
        f"WHEN {m('^' + P.LEFT_SIDE + '\\s*(?:=|≜|:=|≈|∝)')} THEN true WHEN {short} AND {m('[=≈]')} AND {long_words} <= 2 THEN true "
        f"WHEN {short} AND {m('∝')} AND NOT {m('[=≈]')} AND {long_words} = 0 THEN true "
        f"WHEN {m(P.FORMULA_HINT)} THEN length(regexp_replace({t}, '\\PL', '', 'g')) / greatest(length({t}), 1) < 0.55 ELSE false END"
    )


def missing_figures(source: str, target: str) -> str:
    keys = f"list_transform({figure_localised(target)}, lambda f: {figure_key('f')})"
    compact = f"translate(regexp_replace(lower({target}), '\\s+', '', 'g'), '（）', '()')"
    word = f"(contains({target}, '图') OR contains({target}, '表') OR contains({target}, '式') OR regexp_matches({compact}, 'fig|table|eq'))"
    number = f"regexp_replace({figure_key('r')}, '^(fig|table|eq)', '')"
    return f"list_filter({figure(source)}, lambda r: NOT (list_contains({keys}, {figure_key('r')}) OR ({number} <> '' AND contains({compact}, {number}) AND {word})))"


def missing_tokens(source: str, target: str) -> str:
    """Over columns; the token lists src and tgt have to be in scope as lists of the row."""
    lost = f"list_filter(src, lambda t: NOT list_contains(src_figs, t) AND NOT list_contains(tgt, t) AND NOT list_contains(list_transform(tgt, lambda z: lower(z)), lower(t)) AND NOT contains({squeezed(target)}, {squeezed('t')}))"
    return f"list_concat({lost}, {missing_figures(source, target)})"


def symbol_diff(a: str, b: str) -> str:
    """What lists of symbols a and b differ in, in words."""
    n = lambda xs: f"len(list_filter({xs}, lambda z: z = s))"
    every = f"list_sort(list_distinct(list_concat({a}, {b})))"
    more = f"list_filter({every}, lambda s: {n(b)} > {n(a)} AND NOT contains('{P.EXTRA_SYMBOLS}', s))"
    less = f"list_filter({every}, lambda s: {n(b)} < {n(a)})"
    named = lambda xs, x, y: f"array_to_string(list_transform({xs}, lambda s: CASE WHEN {n(x)} - {n(y)} > 1 THEN s || '×' || ({n(x)} - {n(y)}) ELSE s END), '、')"
    return f"concat_ws('；', CASE WHEN len({less}) > 0 THEN '缺失 ' || {named(less, a, b)} END, CASE WHEN len({more}) > 0 THEN '多余 ' || {named(more, b, a)} END)"
