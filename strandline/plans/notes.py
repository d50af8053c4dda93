"""Queries of rendering: front matter, messages, links, index and whole notes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import text as T
from ..functions.dialect import quoted
from ..operators import render
from ..sources import sink
from ..sources.parse import parsed_messages
from ..sources.shared import cut, cut_alone, scratch
from ..operators.paths import resolved
from .documents import _docs, segment_summary
from .fixtures import MESSAGES_SQL, TEXTS_SQL, inline, inline_sql, messages, texts
from .base import register
from .parsing import _inputs
from .relations import ALL_MESSAGES_SQL, ASSIGNED_SQL, all_messages, assigned

STYLES = ("callouts", "blockquotes", "bold", "plain")


def _message_sql(style: str, threshold: int = 40) -> str:
    label = "CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END"
    lines = "replace(text, chr(10), chr(10) || '> ')"
    return {
        "callouts": f"'> [!' || lower({label}) || ']' || CASE WHEN {T.word_count_sql('text')} > {threshold} THEN '-' ELSE '' END || ' ' || {label} || chr(10) || '> ' || {lines}",
        "blockquotes": f"'**' || {label} || ':**' || chr(10) || '> ' || {lines}",
        "bold": f"'**' || {label} || ':** ' || text",
        "plain": "text",
    }[style]


for _style in STYLES:
    register(
        f"format_messages_{_style}" if _style != "callouts" else "format_messages",
        lambda spark, sf, s=_style: render.message_text(all_messages(spark, sf), ["conv_id"], s, 40),
        f"""SELECT conv_id, string_agg({_message_sql(_style)}, chr(10) || chr(10) ORDER BY "index") AS body FROM {ALL_MESSAGES_SQL} WHERE role NOT IN ('system', 'tool') GROUP BY conv_id""",
    )
register(
    "transcript",
    lambda spark, sf: messages(spark, sf).groupBy("conv_id").agg(render.ordered("index", F.concat(F.col("role"), F.lit(": "), F.col("text")), "\n").alias("transcript")),
    f"""SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY "index") AS transcript FROM {MESSAGES_SQL} GROUP BY conv_id""",
)

BLOCKS = [(1, 1, "text", "hello", None, None, None, None), (1, 2, "code", "x = 1\ny", "python", None, None, None), (1, 3, "thinking", "hm", None, None, None, None), (2, 1, "artifact", "a\nb", "js", "App", None, None), (2, 2, "artifact", "plain", "", "Doc", None, None), (3, 1, "image", None, None, None, "alt", "http://x/y.png"), (3, 2, "image", None, None, None, "none", None), (3, 3, "tool_use", "t", None, None, None, None), (3, 4, "code", "z", "", None, None, None)]
_BLOCK_SCHEMA = "id bigint, ord int, type string, content string, language string, title string, alt_text string, url string"
_ONE_BLOCK = """CASE type WHEN 'text' THEN content WHEN 'code' THEN '```' || coalesce(language, '') || chr(10) || content || chr(10) || '```'
    WHEN 'artifact' THEN '> [!note] Artifact: ' || title || chr(10) || '> ' || replace(CASE WHEN coalesce(language, '') <> '' THEN '```' || language || chr(10) || content || chr(10) || '```' ELSE content END, chr(10), chr(10) || '> ')
    WHEN 'image' THEN CASE WHEN coalesce(url, '') <> '' THEN '![' || alt_text || '](' || url || ')' ELSE '[Image: ' || alt_text || ']' END END"""


def _blocks(spark) -> DataFrame:
    rows = inline(spark, BLOCKS, _BLOCK_SCHEMA)
    fields = F.struct("type", "content", "language", "title", "alt_text", "url")
    return rows.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", fields.alias("b")))), lambda x: x["b"]).alias("blocks"))


register(
    "render_blocks",
    lambda spark, sf: _blocks(spark).select("id", render.render_blocks(F.col("blocks"), "callouts").alias("text")),
    f"SELECT id::BIGINT AS id, string_agg({_ONE_BLOCK}, chr(10) || chr(10) ORDER BY ord) AS text FROM {inline_sql(BLOCKS, 'id, ord, type, content, language, title, alt_text, url')} GROUP BY id",
)
register(
    "frontmatter",
    lambda spark, sf: texts(spark, sf).select("id", render.frontmatter([("id", F.col("id")), ("title", T.escape_yaml(F.col("t"))), ("half", F.when(F.col("id") % 2 == 0, F.col("id")))], "status: new\nnot a line\nkind : x").alias("fm")),
    f"SELECT id, '---' || chr(10) || 'id: ' || id || chr(10) || 'title: ' || {T.escape_yaml_sql('t')} || CASE WHEN id % 2 = 0 THEN chr(10) || 'half: ' || id ELSE '' END || chr(10) || 'status: new' || chr(10) || 'kind : x' || chr(10) || '---' AS fm FROM {TEXTS_SQL}",
)


def _named(spark, sf: str) -> DataFrame:
    """Segments named by their first words."""
    first = assigned(spark, sf).groupBy("conv_id", "seg_no").agg(F.min_by("text", "index").alias("text"), F.count("*").alias("n_messages"))
    return first.withColumn("title", F.substring("text", 1, 40)).withColumn("name", T.sanitize_filename(F.col("title")))


_NAMED_SQL = f"""{ASSIGNED_SQL}, nm AS (SELECT conv_id, seg_no, substr(arg_min(text, "index"), 1, 40) AS title, count(*) AS n_messages FROM am GROUP BY ALL), named AS (SELECT *, {T.sanitize_filename_sql('title')} AS name FROM nm)"""
register(
    "nav_links",
    lambda spark, sf: render.nav_links(_named(spark, sf)).select("conv_id", "seg_no", render.footer(F.col("prev_name"), F.lit("Index"), F.col("next_name")).alias("footer")),
    f"""{_NAMED_SQL} SELECT conv_id, seg_no, '---' || chr(10) || '> [!info] Navigation' || chr(10) || '> ' || concat_ws(' | ', 'Previous: [[' || lag(name) OVER w || ']]', '[[Index|Back to Index]]', 'Next: [[' || lead(name) OVER w || ']]') AS footer FROM named WINDOW w AS (PARTITION BY conv_id ORDER BY seg_no)""",
)
register(
    "index_note",
    lambda spark, sf: _named(spark, sf).withColumn("tags", F.array(F.lit("ai-chat"), F.lit("x"))).withColumn("summary", F.concat(F.lit("About "), F.col("title"))).groupBy("conv_id").agg(*render.index_body(F.first("conv_id").cast("string"), "chat", F.lit("2024-01-05"))),
    f"""{_NAMED_SQL} SELECT conv_id, '# ' || conv_id || chr(10) || chr(10) || '> [!info] Import Summary' || chr(10) || '> **Source:** chat | **Date:** 2024-01-05 | **Topics:** ' || count(*) || ' | **Messages:** ' || sum(n_messages)::BIGINT || chr(10) || chr(10) || '## Topics' || chr(10) || chr(10)
        || '| # | Topic | Messages | Tags |' || chr(10) || '|---|-------|----------|------|' || chr(10) || string_agg('| ' || seg_no || ' | [[' || name || ']] | ' || n_messages || ' | `ai-chat`, `x` |', chr(10) ORDER BY seg_no) || chr(10) || chr(10) || '## Segment Summaries' || chr(10) || chr(10)
        || string_agg('### ' || seg_no || '. [[' || name || '|' || title || ']]' || chr(10) || 'About ' || title, chr(10) || chr(10) ORDER BY seg_no) AS body FROM named GROUP BY conv_id""",
)
_SUMMARIES = [(1, "S", "a¦b", "q1¦q2", "", "t", ""), (2, "No summary available.", "", "", "x", "", "[h](u)")]
_S_COLUMNS = "id, summary, tags, questions, topics, takeaways, links"


def _list(name: str):
    return F.filter(F.split(name, "¦"), lambda x: x != "")


def _list_sql(name: str, kind: str, title: str, numbered: bool = False) -> str:
    items = f"list_filter(string_split({name}, '¦'), lambda x: x <> '')"
    one = f"list_transform({items}, lambda x, i: '> ' || i || '. ' || x)" if numbered else f"list_transform({items}, lambda x: '> - ' || x)"
    return f"CASE WHEN {name} <> '' THEN {quoted(f'> [!{kind}] {title}')} || chr(10) || array_to_string({one}, chr(10)) END"


register(
    "summary_block",
    lambda spark, sf: inline(spark, _SUMMARIES, "id bigint, summary string, tags string, questions string, topics string, takeaways string, links string").select("id", render.summary_block(F.col("summary"), *map(_list, ("tags", "questions", "topics", "takeaways", "links"))).alias("block")),
    f"""SELECT id::BIGINT AS id, concat_ws(chr(10) || chr(10), '> [!abstract] Summary' || chr(10) || '> ' || summary || CASE WHEN tags <> '' THEN chr(10) || '> **Tags:** `' || replace(tags, '¦', '` `') || '`' ELSE '' END,
        {_list_sql('questions', 'question', 'Questions Asked', True)}, {_list_sql('topics', 'list', 'Topics Covered')}, {_list_sql('takeaways', 'tip', 'Key Takeaways')}, {_list_sql('links', 'link', 'References')}) AS block FROM {inline_sql(_SUMMARIES, _S_COLUMNS)}""",
)
register(
    "key_info_block",
    lambda spark, sf: inline(spark, _SUMMARIES, "id bigint, summary string, tags string, questions string, topics string, takeaways string, links string").select("id", render.key_info_block(F.col("summary"), *map(_list, ("tags", "questions", "links"))).alias("block")),
    f"""SELECT id::BIGINT AS id, concat_ws(chr(10) || chr(10), '> [!abstract] Summary' || chr(10) || '> ' || summary || CASE WHEN tags <> '' THEN chr(10) || '> **Tags:** `' || replace(tags, '¦', '` `') || '`' ELSE '' END,
        {_list_sql('questions', 'note', 'Key Points')}, {_list_sql('links', 'link', 'References')}) AS block FROM {inline_sql(_SUMMARIES, _S_COLUMNS)}""",
)


def conversations(msgs: DataFrame) -> DataFrame:
    return msgs.groupBy("conv_id").agg(F.lit("chat").alias("source"), F.lit("chat").alias("content_type")).withColumn("title", F.concat(F.lit("Conversation "), F.col("conv_id").cast("string")))


def notes(spark, sf: str) -> DataFrame:
    """The whole pipeline: segments, titles, summaries, rendered notes and index, paths made distinct."""
    msgs = all_messages(spark, sf)
    settings = Settings(granularity="fine", keep_full_transcript=True, naming_template="{{topic}}")
    made = render.notes(msgs, conversations(msgs), settings, segment_summary)
    ordered = made.withColumn("ord", F.col("conv_id") * 1_000_000 + F.coalesce(F.col("seg_no").cast("long"), F.when(F.col("is_index"), 999_999).otherwise(999_998)))
    paths = resolved(ordered.select("ord", "path"), inline(spark, [("AI Chats/x.md",)], "path string"))
    return ordered.join(paths, "ord").select("conv_id", "seg_no", "is_index", F.col("final").alias("path"), "content")


def _written(spark, sf: str) -> DataFrame:
    at = scratch(spark, "notes")
    sink.write_table(notes(spark, sf), at)
    return spark.read.parquet(at).groupBy("is_index").agg(F.count("*").alias("n"), F.countDistinct("path").alias("paths"), F.sum(F.length("content")).alias("chars"))


def imported(inputs: DataFrame, settings: Settings) -> DataFrame:
    """Raw inputs (input_id, content, override) to notes: parsed, segmented (documents by their own
    weights), rendered with time labels, paths made distinct.  Of inputs with one conversation id the
    first is imported."""

    def firsts() -> DataFrame:
        parsed = cut(parsed_messages(inputs, whole_blocks=False).select("input_id", "conv_no", "conv_id", "title", "source", "content_type", "created_at", "index", "role", "text", "ts", "blocks"))
        first = parsed.groupBy("conv_id").agg(F.min(F.struct("input_id", "conv_no")).alias("of"), F.max((F.col("index") >= 1) & (F.col("role") == "user")).alias("scored"))
        found = parsed.join(first, "conv_id").filter(F.struct("input_id", "conv_no") == F.col("of"))
        stamp = F.timestamp_micros((F.col("ts") * 1_000_000).cast("long")).alias("ts")
        return found.select("conv_id", "of", "title", "source", "content_type", "created_at", "index", "role", "text", stamp, "blocks", T.word_count(F.col("text")).alias("n_words"), "scored")

    msgs = cut_alone(firsts)
    convs = cut(msgs.groupBy("conv_id").agg(*[F.first(c).alias(c) for c in ("of", "title", "source", "content_type", "created_at")]))
    made = cut_alone(lambda: render.notes(msgs, convs, settings, segment_summary))
    # paths are made distinct beside the contents, which move once
    key = ["conv_id", "seg", "is_index"]
    keyed = made.select("conv_id", F.coalesce("seg_no", F.lit(1 << 30)).alias("seg"), "is_index", "path").join(convs.select("conv_id", "of"), "conv_id")
    keyed = cut(keyed.withColumn("ord", F.struct("of", "seg", "is_index")))
    paths = keyed.join(resolved(keyed.select("ord", "path"), made.select("path").limit(0)), "ord").select(*key, "final")
    return made.withColumn("seg", F.coalesce("seg_no", F.lit(1 << 30))).join(paths, key).select("conv_id", "seg_no", "is_index", F.col("final").alias("path"), "content")


def import_notes(spark, sf: str) -> DataFrame:
    """The import as one query: the inline exports, pastes and files, and every document as a Markdown file."""
    files = _docs(spark, sf).select((F.col("id") + 1_000).alias("input_id"), F.col("t").alias("content"), F.lit(None).cast("string").alias("override"))
    settings = Settings(granularity="fine", show_timestamps=True, keep_full_transcript=True, naming_template="{{date}} {{topic}}")
    return imported(_inputs(spark).unionByName(files), settings)


register("notes", notes)
register("import_notes", import_notes)
register("write_notes", _written)
