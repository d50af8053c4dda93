"""Queries of text functions: every one over inline texts and all conversation texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..functions.dialect import any_of, any_sql, steps, steps_sql, trim, trim_sql
from .fixtures import TEXTS_SQL, joined, joined_sql, texts
from .base import read, register


def scalar(name: str, column: Callable[[Column], Column], sql: Callable[[str], str]) -> None:
    register(name, lambda spark, sf: texts(spark, sf).select("id", column(F.col("t")).alias("value")), f"SELECT id, {sql('t')} AS value FROM {TEXTS_SQL}")


scalar("tokenize", lambda c: joined(T.tokens(c)), lambda e: joined_sql(T.tokens_sql(e)))
scalar("stopword_filter", lambda c: joined(T.content_tokens(c)), lambda e: joined_sql(T.content_tokens_sql(e)))
scalar("transition_phrases", T.transition, T.transition_sql)
scalar("reintroduction", T.reintroduction, T.reintroduction_sql)
scalar("strip_markdown", T.strip_markdown, lambda e: steps_sql(R.STRIP_MARKDOWN, e))
scalar("clean_inline", T.clean_inline, lambda e: steps_sql(R.CLEAN_INLINE, e))
scalar("strip_artifacts", T.strip_artifacts, T.strip_artifacts_sql)
scalar("clean_heading", T.clean_heading, T.clean_heading_sql)
scalar("first_sentence", T.first_sentence, T.first_sentence_sql)
scalar("truncate_word", lambda c: T.truncate_word(T.first_line(c), 40), lambda e: T.truncate_word_sql(f"split_part({e}, chr(10), 1)", 40))
scalar("bracket_cleanup", T.balanced, T.balanced_sql)
scalar("title_case", T.title_case, T.title_case_sql)
scalar("abbreviations", lambda c: steps(R.ABBREVIATED, c), lambda e: steps_sql(R.ABBREVIATED, e))
scalar("slug", T.slug, T.slug_sql)
scalar("normal_form", T.normal_form, T.normal_form_sql)
scalar("truncate_item", T.truncate_item, T.truncate_item_sql)
scalar("sentences", lambda c: joined(T.sentences(c)), lambda e: joined_sql(T.sentences_sql(e)))
scalar("links", lambda c: joined(F.array_distinct(F.transform(T.links(c), T.clean_url))), lambda e: joined_sql(f"list_transform(list_filter(list_zip(list_transform(regexp_extract_all({e}, '{R.URL.re2}'), lambda u: {T.clean_url_sql('u')}), range(1, 1 + len(regexp_extract_all({e}, '{R.URL.re2}')))), lambda z: list_position(list_transform(regexp_extract_all({e}, '{R.URL.re2}'), lambda u: {T.clean_url_sql('u')}), z[1]) = z[2]), lambda z: z[1])"))
scalar("escape_yaml", T.escape_yaml, T.escape_yaml_sql)
scalar("sanitize_filename", T.sanitize_filename, T.sanitize_filename_sql)
scalar("prefix_lines", lambda c: T.prefix_lines(c, "> "), lambda e: T.prefix_lines_sql(e, "> "))
scalar("preview_text", lambda c: F.when(F.length(c) > 100, F.concat(F.substring(c, 1, 100), F.lit("..."))).otherwise(c), lambda e: f"CASE WHEN length({e}) > 100 THEN substr({e}, 1, 100) || '...' ELSE {e} END")
scalar("is_question", T.is_question, lambda e: any_sql((R.QUESTION_END, R.QUESTION_WORD, R.REQUEST), e))
scalar("is_fragment", T.is_fragment, lambda e: f"({R.ACKNOWLEDGED.test_sql(e)} OR length({e}) < 20)")
scalar("assistant_prompt", lambda c: any_of(R.PROMPTS, c), lambda e: any_sql(R.PROMPTS, e))
scalar("takeaway_filter", T.is_takeaway, T.is_takeaway_sql)
scalar("pronoun_gate", R.PRONOUNS.test, R.PRONOUNS.test_sql)
scalar("meaningful_lines", lambda c: joined(T.meaningful_lines(c)), lambda e: joined_sql(T.meaningful_lines_sql(e)))
scalar("user_like", lambda c: ~any_of(R.NOT_USER, trim(c)), lambda e: f"NOT {any_sql(R.NOT_USER, trim_sql(e))}")
scalar("paragraphs", lambda c: joined(T.paragraphs(c)), lambda e: joined_sql(T.paragraphs_sql(e)))
scalar("strip_frontmatter", R.FRONT_MATTER.replace, lambda e: R.FRONT_MATTER.replace_sql(e))
scalar("word_counts", lambda c: T.word_count(c) * 1000 + T.filled_words(c), lambda e: f"{T.word_count_sql(e)} * 1000 + {T.filled_words_sql(e)}")
scalar("greeting_strip", lambda c: trim(R.GREETING.replace(c)), lambda e: trim_sql(R.GREETING.replace_sql(e)))
scalar("contextual_refs", R.CONTEXTUAL.replace, R.CONTEXTUAL.replace_sql)


def _front_title(c: Column) -> Column:
    found = R.FRONT_TITLE.find(R.FRONT_MATTER_BODY.find(c, 1), 1)
    return F.when(R.FRONT_TITLE.test(R.FRONT_MATTER_BODY.find(c, 1)), F.regexp_replace(trim(found), "^[\"']|[\"']\\z", ""))


def _front_title_sql(e: str) -> str:
    body = R.FRONT_MATTER_BODY.find_sql(e, 1)
    return f"""CASE WHEN {R.FRONT_TITLE.test_sql(body)} THEN regexp_replace({trim_sql(R.FRONT_TITLE.find_sql(body, 1))}, '^["'']|["'']$', '', 'g') END"""


scalar("frontmatter_title", _front_title, _front_title_sql)


def _markdown_speaker(c: Column) -> Column:
    out = F.when(R.MARKDOWN_SPEAKERS[0][0].test(c), 1)
    for i, (p, _) in enumerate(R.MARKDOWN_SPEAKERS[1:], 2):
        out = out.when(p.test(c), i)
    return out.otherwise(0)


scalar("speaker_pattern", _markdown_speaker, lambda e: "CASE " + " ".join(f"WHEN {p.test_sql(e)} THEN {i}" for i, (p, _) in enumerate(R.MARKDOWN_SPEAKERS, 1)) + " ELSE 0 END")


def _comparison(c: Column) -> Column:
    def sides(x: Column) -> Column:
        line = x["line"]
        return F.coalesce(*[F.when(x["low"].contains(p.holds[0]) & p.test(line), F.concat_ws(" vs ", trim(p.find(line, 1)), trim(p.find(line, 2)))) for p in R.COMPARISONS])

    # as elements of arrays the line and its lower case are made once, and not again for every use
    line = F.array(T.first_line(T.strip_markdown(trim(c))))
    return F.get(F.transform(F.transform(line, lambda x: F.struct(x.alias("line"), F.lower(x).alias("low"))), sides), 0)


def _comparison_sql(e: str) -> str:
    line = f"split_part({steps_sql(R.STRIP_MARKDOWN, trim_sql(e))}, chr(10), 1)"
    return "coalesce(" + ", ".join(f"CASE WHEN {p.test_sql(line)} THEN {trim_sql(p.find_sql(line, 1))} || ' vs ' || {trim_sql(p.find_sql(line, 2))} END" for p in R.COMPARISONS) + ")"


scalar("comparison_sides", _comparison, _comparison_sql)

scalar("tag_prefix", lambda c: F.when(F.instr(c, "/") > 1, F.substring_index(c, "/", 1)).otherwise(c), lambda e: f"CASE WHEN strpos({e}, '/') > 1 THEN split_part({e}, '/', 1) ELSE {e} END")
scalar("user_like_short", lambda c: (F.length(trim(c)) <= R.USER_PARAGRAPH_MOST) & ~any_of(R.NOT_USER_SHORT, trim(c)), lambda e: f"(length({trim_sql(e)}) <= {R.USER_PARAGRAPH_MOST} AND NOT {any_sql(R.NOT_USER_SHORT, trim_sql(e))})")
scalar("summary_url_strip", lambda c: steps(R.SUMMARY_URLS, c), lambda e: steps_sql(R.SUMMARY_URLS, e))
register(
    "date_labels",
    lambda spark, sf: read(spark, sf, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.date_format("ts", "yyyy-MM-dd HH:mm").alias("label")),
    "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m-%d %H:%M') AS label FROM events",
)
register(
    "epoch_timestamps",
    lambda spark, sf: read(spark, sf, "events").select("event_id", F.date_format(F.timestamp_millis(F.floor(F.nullif(F.col("value"), F.lit(0.0)) * 1e6).cast("long")), "yyyy-MM-dd HH:mm:ss").alias("at")),
    "SELECT event_id, strftime(make_timestamp((floor(nullif(value, 0) * 1e6)::BIGINT) * 1000), '%Y-%m-%d %H:%M:%S') AS at FROM events",
)
TEMPLATE = "{{date}} - {{topic}} ({{segment}}/{{segment_total}}) {{other}}"
register(
    "render_template",
    lambda spark, sf: texts(spark, sf).select("id", T.render_template(F.lit(TEMPLATE), {"date": F.lit("2024-01-05"), "topic": F.col("t"), "segment": F.col("id").cast("string")}).alias("value")),
    f"SELECT id, '2024-01-05 - ' || t || ' (' || id::VARCHAR || '/' || '{{{{segment_total}}}}) {{{{other}}}}' AS value FROM {TEXTS_SQL}",
)

register(
    "clean_urls",
    lambda spark, sf: read(spark, sf, "pages").select("page_id", T.clean_url(F.col("url")).alias("clean"), T.url_link(T.clean_url(F.col("url"))).alias("link")),
    f"SELECT page_id, {T.clean_url_sql('url')} AS clean, {T.url_link_sql(T.clean_url_sql('url'))} AS link FROM pages",
)
