"""Text functions, each as a Spark column and as SQL text for the oracle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R
from .dialect import Rx, any_of, any_sql, quoted, spaces, steps, steps_sql, trim, trim_sql

TOKEN_CUT = {e: f"[{spaces(e)}\\p{{P}}]+" for e in ("java", "re2")}
#: for Java two wide ranges are tested first, which most characters fail
WORD_CUT = {"java": f"[\\t-\\r \\u00a0\\u1680-\\ufeff&&[{spaces('java')}]]+", "re2": f"[{spaces('re2')}]+"}


def squash(text: str) -> str:
    return " ".join(text.split())


# --- tokens


def tokens(c: Column) -> Column:
    """Lower-case tokens of three letters or more, in order, repeats kept."""
    return F.filter(F.split(F.lower(c), TOKEN_CUT["java"]), lambda x: F.length(x) >= 3)


def tokens_sql(e: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({e}), {quoted(TOKEN_CUT['re2'])}), lambda x: length(x) >= 3)"


def content_tokens(c: Column) -> Column:
    stop = F.array(*[F.lit(w) for w in R.STOP_WORDS])
    return F.filter(tokens(c), lambda x: ~F.array_contains(stop, x))


def content_tokens_sql(e: str) -> str:
    stop = ", ".join(map(quoted, R.STOP_WORDS))
    return f"list_filter({tokens_sql(e)}, lambda x: NOT list_contains([{stop}], x))"


def word_count(c: Column) -> Column:
    """Pieces between white space, empty ones at the ends included."""
    return F.size(F.split(c, WORD_CUT["java"]))


def word_count_sql(e: str) -> str:
    return f"len(regexp_split_to_array({e}, {quoted(WORD_CUT['re2'])}))"


def filled_words(c: Column) -> Column:
    return F.size(F.filter(F.split(c, WORD_CUT["java"]), lambda x: x != ""))


def filled_words_sql(e: str) -> str:
    return f"len(list_filter(regexp_split_to_array({e}, {quoted(WORD_CUT['re2'])}), lambda x: x <> ''))"


# --- scores of one message


def graded(c: Column, strong: tuple[Rx, ...], moderate: tuple[Rx, ...]) -> Column:
    return F.when(any_of(strong, c), 1.0).when(any_of(moderate, c), 0.5).otherwise(0.0)


def graded_sql(e: str, strong: tuple[Rx, ...], moderate: tuple[Rx, ...]) -> str:
    return f"CASE WHEN {any_sql(strong, e)} THEN 1.0::DOUBLE WHEN {any_sql(moderate, e)} THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END"


def transition(c: Column) -> Column:
    return graded(trim(F.substring(c, 1, 200)), R.TRANSITION_STRONG, R.TRANSITION_MODERATE)


def transition_sql(e: str) -> str:
    return graded_sql(trim_sql(f"substr({e}, 1, 200)"), R.TRANSITION_STRONG, R.TRANSITION_MODERATE)


def reintroduction(c: Column) -> Column:
    return graded(trim(c), R.REINTRO_STRONG, R.REINTRO_MODERATE)


def reintroduction_sql(e: str) -> str:
    return graded_sql(trim_sql(e), R.REINTRO_STRONG, R.REINTRO_MODERATE)


def self_contained(answer: Column, question: Column) -> Column:
    """A long structured answer followed by a short question."""
    structured = (R.HEADING_MARK.count(answer) >= 2) | (R.LIST_MARK.count(answer) >= 3)
    return F.when((word_count(answer) >= 150) & structured & (word_count(question) <= 100), 1.0).otherwise(0.0)


def self_contained_sql(answer: str, question: str) -> str:
    structured = f"({R.HEADING_MARK.count_sql(answer)} >= 2 OR {R.LIST_MARK.count_sql(answer)} >= 3)"
    return f"CASE WHEN {word_count_sql(answer)} >= 150 AND {structured} AND {word_count_sql(question)} <= 100 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"


# --- cleaning


def strip_markdown(c: Column) -> Column:
    return steps(R.STRIP_MARKDOWN, c)


def clean_inline(c: Column) -> Column:
    return steps(R.CLEAN_INLINE, c)


def strip_artifacts(c: Column) -> Column:
    return trim(R.LEADING_MARKS.replace(steps(R.TYPOGRAPHY, c)))


def strip_artifacts_sql(e: str) -> str:
    return trim_sql(R.LEADING_MARKS.replace_sql(steps_sql(R.TYPOGRAPHY, e)))


def clean_heading(c: Column) -> Column:
    return strip_artifacts(trim(R.HEADING_NUMBER.replace(steps((R.BOLD, R.ITALIC, R.CODE, R.LINK), c))))


def clean_heading_sql(e: str) -> str:
    return strip_artifacts_sql(trim_sql(R.HEADING_NUMBER.replace_sql(steps_sql((R.BOLD, R.ITALIC, R.CODE, R.LINK), e))))


SENTENCE = Rx(r"^[^.!?]*[.!?]")


def first_line(c: Column) -> Column:
    return F.substring_index(c, "\n", 1)


def first_sentence(c: Column) -> Column:
    line = first_line(c)
    found = trim(F.regexp_replace(SENTENCE.find(line), r"[.!?]\z", ""))
    return F.when(SENTENCE.test(line) & (F.length(found) >= 15), found).otherwise(trim(F.substring(line, 1, 120)))


def first_sentence_sql(e: str) -> str:
    line = f"split_part({e}, chr(10), 1)"
    found = trim_sql(f"regexp_replace({SENTENCE.find_sql(line)}, '[.!?]\\z', '')")
    return f"CASE WHEN {SENTENCE.test_sql(line)} AND length({found}) >= 15 THEN {found} ELSE {trim_sql(f'substr({line}, 1, 120)')} END"


def last_space(c: Column) -> Column:
    """Place of the last blank counted from 0, -1 without one."""
    return F.when(F.instr(c, " ") > 0, F.length(c) - F.instr(F.reverse(c), " ")).otherwise(-1)


def last_space_sql(e: str) -> str:
    return f"CASE WHEN contains({e}, ' ') THEN length({e}) - strpos(reverse({e}), ' ') ELSE -1 END"


_PHRASE = Rx(r"^(.+)[,;:](?:\s|$)")
_CONJUNCTION = Rx(r"^(.+)\s+(?:and|or|but)\s+", "i")
_OPEN, _CLOSE, _OPEN2, _CLOSE2 = Rx(r"\("), Rx(r"\)"), Rx(r"\["), Rx(r"\]")
_CUT_OPEN, _CUT_OPEN2 = Rx(r"\s*\([^)]*$"), Rx(r"\s*\[[^\]]*$")
_CUT_CLOSE, _CUT_CLOSE2 = Rx(r"^[^(]*\)\s*"), Rx(r"^[^\[]*\]\s*")
_BRACKETS = ((_OPEN, _CLOSE, _CUT_OPEN), (_OPEN2, _CLOSE2, _CUT_OPEN2), (_CLOSE, _OPEN, _CUT_CLOSE), (_CLOSE2, _OPEN2, _CUT_CLOSE2))


def balanced(c: Column) -> Column:
    """Without the fragment after an open bracket or before a closed one that has no partner."""
    for more, less, cut in _BRACKETS:
        c = F.when(more.count(c) > less.count(c), trim(cut.replace(c))).otherwise(c)
    return c


def _let_sql(e: str, body) -> str:
    """Evaluates ``e`` once and hands its name to ``body``."""
    return f"list_transform([{e}], lambda v: {body('v')})[1]"


def balanced_sql(e: str) -> str:
    for more, less, cut in _BRACKETS:
        e = _let_sql(e, lambda v, m=more, n=less, k=cut: f"CASE WHEN {m.count_sql(v)} > {n.count_sql(v)} THEN {trim_sql(k.replace_sql(v))} ELSE {v} END")
    return e


def truncate_word(c: Column, most: int) -> Column:
    """At a phrase end, else at a conjunction, else at a blank, if these lie far enough on."""
    head = F.substring(c, 1, most)
    phrase, before = _PHRASE.find(head, 1), _CONJUNCTION.find(head, 1)
    cut = F.when(F.length(phrase) > most * 0.4, trim(phrase)).when(F.length(before) > most * 0.4, trim(before))
    cut = cut.when(last_space(head) > most * 0.5, F.substring(head, F.lit(1), last_space(head))).otherwise(head)
    return F.when(F.length(c) <= most, c).otherwise(F.element_at(F.transform(F.array(cut), balanced), 1))


def truncate_word_sql(e: str, most: int) -> str:
    head = f"substr({e}, 1, {most})"
    phrase, before, space = _PHRASE.find_sql(head, 1), _CONJUNCTION.find_sql(head, 1), last_space_sql(head)
    cut = f"CASE WHEN length({phrase}) > {most} * 0.4 THEN {trim_sql(phrase)} WHEN length({before}) > {most} * 0.4 THEN {trim_sql(before)} WHEN {space} > {most} * 0.5 THEN substr({head}, 1, {space}) ELSE {head} END"
    return f"CASE WHEN length({e}) <= {most} THEN {e} ELSE {balanced_sql(cut)} END"


_CASED = Rx(r"^([a-zA-Z'-]+)([^a-zA-Z'-]*)$")
_CAPS = Rx(r"^[A-Z]{2,}$")


def title_case(c: Column) -> Column:
    minor = F.array(*[F.lit(w) for w in R.MINOR_WORDS])

    def word(w: Column, i: Column) -> Column:
        core, rest = _CASED.find(w, 1), _CASED.find(w, 2)
        low = F.lower(core)
        raised = F.concat(F.upper(F.substring(low, 1, 1)), F.substring(low, F.lit(2), F.length(low)), rest)
        kept = ~_CASED.test(w) | _CAPS.test(core)
        return F.when(kept, w).when((i == 0) | ~F.array_contains(minor, low), raised).otherwise(F.concat(low, rest))

    return F.array_join(F.transform(F.split(c, WORD_CUT["java"]), word), " ")


def title_case_sql(e: str) -> str:
    minor = ", ".join(map(quoted, R.MINOR_WORDS))
    core, rest = _CASED.find_sql("w", 1), _CASED.find_sql("w", 2)
    raised = f"upper(substr(lower({core}), 1, 1)) || substr(lower({core}), 2) || {rest}"
    return f"array_to_string(list_transform(regexp_split_to_array({e}, {quoted(WORD_CUT['re2'])}), lambda w, i: CASE WHEN NOT {_CASED.test_sql('w')} OR {_CAPS.test_sql(core)} THEN w WHEN i = 1 OR NOT list_contains([{minor}], lower({core})) THEN {raised} ELSE lower({core}) || {rest} END), ' ')"


def slug(c: Column) -> Column:
    """Lower-case tag part, null below two letters."""
    out = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+\\z", "")
    return F.when(F.length(out) >= 2, out)


def slug_sql(e: str) -> str:
    out = f"regexp_replace(regexp_replace(lower({e}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
    return f"CASE WHEN length({out}) >= 2 THEN {out} END"


_NOT_NORMAL = Rx(r"[^a-z0-9\s]")
_SQUEEZE = Rx(r"\s+", to=" ")


def normal_form(c: Column) -> Column:
    return trim(_SQUEEZE.replace(_NOT_NORMAL.replace(F.lower(c))))


def normal_form_sql(e: str) -> str:
    return trim_sql(_SQUEEZE.replace_sql(_NOT_NORMAL.replace_sql(f"lower({e})")))


def truncate_item(c: Column, most: int = R.ITEM_MOST) -> Column:
    head = F.substring(c, 1, most)
    at = last_space(F.substring(c, 1, most + 1))
    return (
        F.when(F.length(c) <= most, c)
        .when(SENTENCE.test(head), trim(SENTENCE.find(head)))
        .when(at > most * 0.5, F.concat(F.substring(c, F.lit(1), at), F.lit("...")))
        .otherwise(F.concat(head, F.lit("...")))
    )


def truncate_item_sql(e: str, most: int = R.ITEM_MOST) -> str:
    head, at = f"substr({e}, 1, {most})", last_space_sql(f"substr({e}, 1, {most + 1})")
    return f"CASE WHEN length({e}) <= {most} THEN {e} WHEN {SENTENCE.test_sql(head)} THEN {trim_sql(SENTENCE.find_sql(head))} WHEN {at} > {most} * 0.5 THEN substr({e}, 1, {at}) || '...' ELSE {head} || '...' END"


_STOP = Rx(r"([.!?])\s+", to="$1\u0002")


def sentences(c: Column) -> Column:
    """Sentences of a text without fenced code; dots of abbreviations do not end one."""
    parts = F.split(_STOP.replace(R.ABBREVIATION_DOT.replace(R.FENCED.replace(c))), "\u0002")
    return F.filter(F.transform(parts, lambda p: trim(F.regexp_replace(p, "\u0001", "."))), lambda p: p != "")


def sentences_sql(e: str) -> str:
    dotted = Rx(R.ABBREVIATION_DOT.source, "i", to="$1\u0001$2")
    parts = f"string_split({_STOP.replace_sql(dotted.replace_sql(R.FENCED.replace_sql(e)))}, {quoted(chr(2))})"
    return f"list_filter(list_transform({parts}, lambda p: {trim_sql(f'replace(p, {quoted(chr(1))}, {quoted(chr(46))})')}), lambda p: p <> '')"


def is_question(c: Column) -> Column:
    return any_of((R.QUESTION_END, R.QUESTION_WORD, R.REQUEST), c)


def is_fragment(c: Column) -> Column:
    return R.ACKNOWLEDGED.test(c) | (F.length(c) < 20)


def is_takeaway(c: Column) -> Column:
    long_words = F.size(F.filter(F.split(c, WORD_CUT["java"]), lambda w: F.length(w) >= 4))
    return (F.length(c) >= 15) & any_of(R.TAKEAWAYS, F.substring(c, 1, 60)) & (long_words >= 3)


def is_takeaway_sql(e: str) -> str:
    long_words = f"len(list_filter(regexp_split_to_array({e}, {quoted(WORD_CUT['re2'])}), lambda w: length(w) >= 4))"
    return f"(length({e}) >= 15 AND {any_sql(R.TAKEAWAYS, f'substr({e}, 1, 60)')} AND {long_words} >= 3)"


def meaningful_lines(c: Column) -> Column:
    lines = F.transform(F.split(trim(c), "\n"), trim)
    return F.filter(lines, lambda x: (F.length(x) >= 15) & ~any_of(R.NO_PROSE, x))


def meaningful_lines_sql(e: str) -> str:
    return f"list_filter(list_transform(string_split({trim_sql(e)}, chr(10)), lambda x: {trim_sql('x')}), lambda x: length(x) >= 15 AND NOT {any_sql(R.NO_PROSE, 'x')})"


def paragraphs(c: Column) -> Column:
    return F.filter(F.split(c, "\n\n+"), lambda p: trim(p) != "")


def paragraphs_sql(e: str) -> str:
    return f"list_filter(regexp_split_to_array({e}, '\\n\\n+'), lambda p: {trim_sql('p')} <> '')"


# --- files, front matter, dates


def sanitize_filename(c: Column) -> Column:
    out = F.regexp_replace(trim(steps(R.FILENAME_TYPOGRAPHY + R.FILENAME_MARKS, c)), "^\\.+|\\.+\\z", "")
    out = F.when(F.length(out) > R.FILENAME_MOST, trim(F.substring(out, 1, R.FILENAME_MOST))).otherwise(out)
    return F.coalesce(F.nullif(out, F.lit("")), F.lit("Untitled"))


def sanitize_filename_sql(e: str) -> str:
    out = f"regexp_replace({trim_sql(steps_sql(R.FILENAME_TYPOGRAPHY + R.FILENAME_MARKS, e))}, '^\\.+|\\.+$', '', 'g')"
    return f"coalesce(nullif(CASE WHEN length({out}) > {R.FILENAME_MOST} THEN {trim_sql(f'substr({out}, 1, {R.FILENAME_MOST})')} ELSE {out} END, ''), 'Untitled')"


def escape_yaml(c: Column) -> Column:
    line = trim(F.regexp_replace(c, "\n+", " "))
    return F.when(R.YAML_SPECIAL.test(line), F.concat(F.lit('"'), F.replace(line, F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(line)


def escape_yaml_sql(e: str) -> str:
    line = trim_sql(f"regexp_replace({e}, '\\n+', ' ', 'g')")
    return f"""CASE WHEN {R.YAML_SPECIAL.test_sql(line)} THEN '"' || replace({line}, '"', '\\"') || '"' ELSE {line} END"""


def prefix_lines(c: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.replace(c, F.lit("\n"), F.lit("\n" + prefix)))


def prefix_lines_sql(e: str, prefix: str) -> str:
    return f"({quoted(prefix)} || replace({e}, chr(10), chr(10) || {quoted(prefix)}))"


def render_template(template: Column, values: dict[str, Column]) -> Column:
    """``{{name}}`` by value; unknown names stay.  Values are not searched again: the template is
    cut at its names first."""
    known = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])
    parts = F.split(F.regexp_replace(template, r"\{\{(\w+)\}\}", "\u0001$1\u0002"), "\u0001")

    def part(p: Column) -> Column:
        name = F.substring_index(p, "\u0002", 1)
        rest = F.substring(p, F.length(name) + 2, F.length(p))
        return F.when(F.instr(p, "\u0002") == 0, p).otherwise(F.concat(F.coalesce(F.element_at(known, name), F.concat(F.lit("{{"), name, F.lit("}}"))), rest))

    return F.array_join(F.transform(parts, part), "")


# --- links


def links(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(R.URL.java), 0)


def clean_url(c: Column) -> Column:
    """Without trailing punctuation, tracking parameters and a bare final slash."""
    u = R.URL_END.replace(c)
    body, mark = F.substring_index(u, "#", 1), F.regexp_extract(u, "#[\\s\\S]*", 0)
    path, query = F.substring_index(body, "?", 1), F.regexp_extract(body, "\\?([\\s\\S]*)", 1)
    tracked = F.array(*[F.lit(t) for t in R.TRACKING])
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.array_contains(tracked, F.substring_index(p, "=", 1))), "&")
    out = F.concat(path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""), mark)
    return F.regexp_replace(out, "^(https?://[^/?#]+)/\\z", "$1")


def clean_url_sql(e: str) -> str:
    u = R.URL_END.replace_sql(e)
    body, mark = f"split_part({u}, '#', 1)", f"regexp_extract({u}, '#(?s:.*)', 0)"
    path, query = f"split_part({body}, '?', 1)", f"regexp_extract({body}, '\\?((?s:.*))', 1)"
    kept = f"array_to_string(list_filter(string_split({query}, '&'), lambda p: p <> '' AND NOT list_contains([{', '.join(map(quoted, R.TRACKING))}], split_part(p, '=', 1))), '&')"
    return f"regexp_replace({path} || CASE WHEN {kept} <> '' THEN '?' || {kept} ELSE '' END || {mark}, '^(https?://[^/?#]+)/$', '\\1')"


def url_link(c: Column) -> Column:
    return F.concat(F.lit("["), F.regexp_replace(F.lower(F.regexp_extract(c, "^https?://([^/?#:]+)", 1)), "^www\\.", ""), F.lit("]("), c, F.lit(")"))


def url_link_sql(e: str) -> str:
    return f"('[' || regexp_replace(lower(regexp_extract({e}, '^https?://([^/?#:]+)', 1)), '^www\\.', '') || '](' || {e} || ')')"
