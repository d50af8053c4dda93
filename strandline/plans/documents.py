"""Queries over documents, messages and existing notes."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import rules as R
from ..functions import text as T
from ..functions.dialect import trim, trim_sql
from ..operators.paths import resolved
from .fixtures import MESSAGES_SQL, TEXTS_SQL, inline, inline_sql, joined, joined_sql, messages, texts
from .base import read, register
from .relations import ALL_MESSAGES_SQL, ASSIGNED_SQL, all_messages, assigned

# --- document sections and paragraph groups

DOCS = [
    (-1, "Preamble words\n# One\nalpha beta gamma delta epsilon zeta eta theta iota kappa\n## Two\nshort\n### Three\none two three four five six seven eight nine ten eleven"),
    (-2, "\n\n".join(f"paragraph {i} has some words in it to count" for i in range(8))),
    (-3, "---\ntitle: X\n---\n\n# Only\nbody of the single section that is long enough to be kept here"),
    (-4, "a\n\nb\n\nc\n\nd"),
    (-5, "no headings at all"),
]
_DOCS_SQL = f"(SELECT id::BIGINT AS id, t FROM {inline_sql(DOCS, 'id, t')} UNION ALL SELECT doc_id, text FROM documents)"


def _docs(spark, sf: str) -> DataFrame:
    return inline(spark, DOCS, "id bigint, t string").unionAll(read(spark, sf, "documents").select("doc_id", "text"))


def sections(docs: DataFrame, least: int = 10) -> DataFrame:
    """id, index, content of the heading sections of ``least`` words or more.

    A mark is put before every heading line and the text split there: no shuffle."""
    body = R.FRONT_MATTER.replace(F.col("t"))
    cut = F.split(F.regexp_replace(body, "(?md)^(#{1,6}[ \\t])", "\u0001$1"), "\u0001")
    kept = F.filter(F.transform(F.filter(cut, lambda p: p != ""), trim), lambda p: T.filled_words(p) >= least)
    out = docs.select("id", F.when(body.rlike("(?md)^#{1,6}[ \\t]"), kept).otherwise(F.array().cast("array<string>")).alias("parts"))
    return out.select("id", F.posexplode("parts").alias("index", "content"))


register(
    "doc_sections",
    lambda spark, sf: sections(_docs(spark, sf)),
    f"""WITH l AS (SELECT id, unnest(string_split({R.FRONT_MATTER.replace_sql('t')}, chr(10))) AS line, generate_subscripts(string_split({R.FRONT_MATTER.replace_sql('t')}, chr(10)), 1) AS n FROM {_DOCS_SQL}),
        s AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^#{{1,6}}[ \\t]') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY n) AS sec, max(regexp_matches(line, '^#{{1,6}}[ \\t]')) OVER (PARTITION BY id) AS any_head FROM l),
        g AS (SELECT id, sec, {trim_sql("string_agg(line, chr(10) ORDER BY n)")} AS content FROM s WHERE any_head GROUP BY id, sec)
        SELECT id, (row_number() OVER (PARTITION BY id ORDER BY sec) - 1)::INT AS "index", content FROM g WHERE {T.filled_words_sql('content')} >= 10""",
)


def paragraph_groups(docs: DataFrame, size: int = 3, least: int = 10) -> DataFrame:
    """id, index, content: groups of ``size`` paragraphs of documents with four or more."""
    found = F.filter(F.transform(F.split(R.FRONT_MATTER.replace(F.col("t")), "\n{2,}"), trim), lambda p: p != "")
    docs = docs.select("id", found.alias("p")).filter(F.size("p") >= 4)
    starts = F.sequence(F.lit(0), F.floor((F.size("p") - 1) / size).cast("int"))
    groups = F.filter(F.transform(starts, lambda k: F.array_join(F.slice("p", k * size + 1, F.lit(size)), "\n\n")), lambda g: T.filled_words(g) >= least)
    return docs.select("id", F.posexplode(groups).alias("index", "content"))


register(
    "doc_paragraph_groups",
    lambda spark, sf: paragraph_groups(_docs(spark, sf)),
    f"""WITH p AS (SELECT id, list_filter(list_transform(regexp_split_to_array({R.FRONT_MATTER.replace_sql('t')}, '\\n{{2,}}'), lambda x: {trim_sql('x')}), lambda x: x <> '') AS p FROM {_DOCS_SQL}),
        e AS (SELECT id, unnest(p) AS x, generate_subscripts(p, 1) - 1 AS n FROM p WHERE len(p) >= 4),
        g AS (SELECT id, n // 3 AS k, string_agg(x, chr(10) || chr(10) ORDER BY n) AS content FROM e GROUP BY 1, 2)
        SELECT id, (row_number() OVER (PARTITION BY id ORDER BY k) - 1)::INT AS "index", content FROM g WHERE {T.filled_words_sql('content')} >= 10""",
)

# --- messages

register("role_filter", lambda spark, sf: messages(spark, sf).filter(F.col("role").isin("user", "assistant")).select("conv_id", "index"), f"""SELECT conv_id, "index" FROM {MESSAGES_SQL} WHERE role IN ('user', 'assistant')""")
_GAPPY = [(-1, 0, "user", "  "), (-1, 1, "assistant", "one"), (-1, 2, "system", "skip"), (-1, 3, "user", "\n"), (-1, 4, "user", "two")]


def reindexed(msgs: DataFrame) -> DataFrame:
    """User and assistant messages with text, numbered again from 0."""
    kept = msgs.filter(F.col("role").isin("user", "assistant") & (trim(F.col("text")) != ""))
    return kept.withColumn("new_index", F.row_number().over(Window.partitionBy("conv_id").orderBy("index")) - 1)


register(
    "reindex_messages",
    lambda spark, sf: reindexed(inline(spark, _GAPPY, "conv_id bigint, index int, role string, text string").unionByName(messages(spark, sf))).select("conv_id", "index", "new_index"),
    f"""SELECT conv_id, "index", (row_number() OVER (PARTITION BY conv_id ORDER BY "index") - 1)::INT AS new_index FROM (SELECT conv_id::BIGINT AS conv_id, "index"::INT AS "index", role, text FROM {inline_sql(_GAPPY, 'conv_id, "index", role, text')} UNION ALL SELECT * FROM {MESSAGES_SQL})
        WHERE role IN ('user', 'assistant') AND {trim_sql('text')} <> ''""",
)
register(
    "conversation_title",
    lambda spark, sf: all_messages(spark, sf).groupBy("conv_id").agg(F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("index"))).alias("t")).select("conv_id", F.coalesce(F.when(F.length("t") > 50, F.concat(F.substring("t", 1, 50), F.lit("..."))).otherwise(F.col("t")), F.lit("Untitled Chat")).alias("title")),
    f"""SELECT conv_id, coalesce(CASE WHEN length(t) > 50 THEN substr(t, 1, 50) || '...' ELSE t END, 'Untitled Chat') AS title FROM (SELECT conv_id, arg_min(text, "index") FILTER (role = 'user') AS t FROM {ALL_MESSAGES_SQL} GROUP BY conv_id)""",
)
register(
    "message_counts",
    lambda spark, sf: messages(spark, sf).groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"), F.count_if(F.col("role") == "user").alias("n_user")),
    f"SELECT conv_id, count(*) AS n, sum(length(text))::BIGINT AS n_chars, count(*) FILTER (role = 'user') AS n_user FROM {MESSAGES_SQL} GROUP BY conv_id",
)
register(
    "first_turns",
    lambda spark, sf: _first_turns(all_messages(spark, sf)),
    f"""SELECT conv_id, arg_min(text, "index") FILTER (role = 'user') AS first_user, arg_min(text, "index") FILTER (role = 'assistant') AS first_assistant FROM {ALL_MESSAGES_SQL} GROUP BY conv_id""",
)


def _first_turns(msgs: DataFrame, *keys: str) -> DataFrame:
    of = lambda role: F.min_by(F.when(F.col("role") == role, F.col("text")), F.when(F.col("role") == role, F.col("index")))
    return msgs.groupBy(*(keys or ("conv_id",))).agg(of("user").alias("first_user"), of("assistant").alias("first_assistant"))


# --- keywords, headings, tags, summaries of segments


@F.pandas_udf(StringType())
def _frequent(terms: pd.Series, k: pd.Series) -> pd.Series:
    """The most frequent of each list of terms, ties by first occurrence; null without terms."""
    return pd.Series([" ".join(t for t, _ in Counter(x).most_common(n)) or None for x, n in zip(terms, k)])


def keywords(rows: DataFrame, keys: list[str], order: str | None = "index", k: int = 3) -> DataFrame:
    """The ``k`` most frequent content terms of each group; ties by first occurrence.

    The terms of a group meet in one row; without an ``order`` every row is a group and nothing is shuffled."""
    terms = T.content_tokens(F.col("text"))
    if order is None:
        groups = rows.select(*keys, terms.alias("terms"))
    else:
        gathered = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, terms.alias("t")))).alias("all"))
        groups = gathered.select(*keys, F.flatten(F.transform("all", lambda x: x["t"])).alias("terms"))
    return groups.select(*keys, _frequent("terms", F.lit(k)).alias("words")).filter("words is not null").select(*keys, T.title_case(F.col("words")).alias("title"))


register(
    "keywords_top3",
    lambda spark, sf: keywords(assigned(spark, sf), ["conv_id", "seg_no"]),
    f"""{ASSIGNED_SQL}, w AS (SELECT conv_id, seg_no, "index", unnest({T.content_tokens_sql('text')}) AS term, generate_subscripts({T.content_tokens_sql('text')}, 1) AS pos FROM am),
        n AS (SELECT conv_id, seg_no, term, count(*) AS n, min("index" * 100000 + pos) AS first FROM w GROUP BY ALL),
        k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, seg_no ORDER BY n DESC, first) AS r FROM n QUALIFY r <= 3)
        SELECT conv_id, seg_no, {T.title_case_sql('words')} AS title FROM (SELECT conv_id, seg_no, string_agg(term, ' ' ORDER BY r) AS words FROM k GROUP BY ALL)""",
)
register(
    "document_keywords",
    lambda spark, sf: keywords(read(spark, sf, "documents").select("doc_id", "text"), ["doc_id"], None),
    f"""WITH w AS (SELECT doc_id, unnest({T.content_tokens_sql('text')}) AS term, generate_subscripts({T.content_tokens_sql('text')}, 1) AS pos FROM documents),
        n AS (SELECT doc_id, term, count(*) AS n, min(pos) AS first FROM w GROUP BY ALL),
        k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS r FROM n QUALIFY r <= 3)
        SELECT doc_id, {T.title_case_sql('words')} AS title FROM (SELECT doc_id, string_agg(term, ' ' ORDER BY r) AS words FROM k GROUP BY ALL)""",
)
HEADED = [(-1, 0, "assistant", "## Alpha Topic\ntext\n### Beta\n**Gamma Ray**\n## Alpha topic"), (-1, 1, "assistant", "#### Beta\n#### Beta"), (-2, 0, "assistant", "### 1. First thing\n## Step 2: Second\n"), (-3, 0, "user", "## Not mine")]
_HEADING = r"^(#{2,4})[ \t]+([^\n]+)$"


def best_heading(rows: DataFrame) -> DataFrame:
    """The heading of each conversation with the largest 10 * count + 6 - level; first wins."""
    lines = rows.filter("role = 'assistant'").select("conv_id", "index", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    bold = F.regexp_extract(trim(F.col("line")), r"^\*\*([^*]{3,60})\*\*\z", 1)
    level = F.when(F.col("line").rlike(r"^#{2,4}[ \t]+\S"), F.length(F.regexp_extract("line", "^(#{2,4})[ \t]", 1))).when(bold != "", 3)
    words = T.clean_heading(F.when(F.col("line").rlike(r"^#{2,4}[ \t]"), trim(F.regexp_replace("line", "^#{2,4}[ \t]+", ""))).otherwise(trim(bold)))
    found = lines.withColumn("level", level).filter("level is not null").withColumn("heading", words).filter(F.length("heading") >= 3)
    counts = found.groupBy("conv_id", F.lower("heading").alias("key")).agg(F.count("*").alias("n"), F.min("level").alias("level"), F.min(F.struct("index", "pos")).alias("first"), F.min_by("heading", F.struct("index", "pos")).alias("heading"))
    best = counts.withColumn("score", F.col("n") * 10 + 6 - F.col("level"))
    return best.withColumn("k", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("score").desc(), "first"))).filter("k = 1").select("conv_id", "heading", "score")


_LEVEL_SQL = r"""CASE WHEN regexp_matches(line, '^#{2,4}[ \t]+\S') THEN length(regexp_extract(line, '^(#{2,4})[ \t]', 1)) WHEN regexp_matches(trim(line), '^\*\*([^*]{3,60})\*\*$') THEN 3 END"""
_RAW_SQL = r"""CASE WHEN regexp_matches(line, '^#{2,4}[ \t]') THEN regexp_replace(line, '^#{2,4}[ \t]+', '') ELSE regexp_extract(trim(line), '^\*\*([^*]{3,60})\*\*$', 1) END"""
register(
    "best_heading",
    lambda spark, sf: best_heading(inline(spark, HEADED, "conv_id bigint, index int, role string, text string")),
    f"""WITH l AS (SELECT conv_id, "index", unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM {inline_sql(HEADED, 'conv_id, "index", role, text')} WHERE role = 'assistant'),
        h AS (SELECT *, {_LEVEL_SQL} AS level, {T.clean_heading_sql(f'trim({_RAW_SQL})')} AS heading FROM l),
        c AS (SELECT conv_id, lower(heading) AS key, count(*) AS n, min(level) AS level, min("index" * 1000 + pos) AS first, arg_min(heading, "index" * 1000 + pos) AS heading FROM h WHERE level IS NOT NULL AND length(heading) >= 3 GROUP BY ALL)
        SELECT conv_id::BIGINT AS conv_id, heading, n * 10 + 6 - level AS score FROM c QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n * 10 + 6 - level DESC, first) = 1""",
)
TAGGED = [
    (-1, 0, "user", "python and Python for a sql job on postgres"), (-1, 1, "assistant", "use python"), (-1, 2, "user", "ok"), (-1, 3, "assistant", "fine"),
    (-2, 0, "user", "python python"), (-2, 1, "assistant", "hotel flight trip"), (-2, 2, "user", "vacation"),
    (-3, 0, "user", "rent a condo"), (-3, 1, "assistant", "mortgage and lease; javascript Java java TypeScript javascript c++x"),
    (-4, 0, "user", "nothing here"),
]


def domain_tags(rows: DataFrame, keys: list[str], prefix: str = "ai-chat") -> DataFrame:
    """Tags whose pattern matches often enough in the joined text; short groups need half as many again."""
    whole = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", "text"))), lambda x: x["text"]), " ").alias("all"))
    base = prefix.rstrip("/")
    hits = [F.when(p.count(F.col("all")) >= F.when(F.col("n") <= 3, F.lit(-(-3 * least // 2))).otherwise(least), F.lit(f"{base}/{tag}")) for tag, least, p in R.DOMAIN_TAGS]
    found = F.slice(F.array_distinct(F.array_compact(F.array(*hits))), 1, R.MOST_TAGS)
    return whole.select(*keys, F.when(F.size(found) == 0, F.array(F.lit(base))).otherwise(found).alias("tags"))


_TAG_HITS = ", ".join(f"CASE WHEN {p.count_sql('alltext')} >= CASE WHEN n <= 3 THEN {-(-3 * least // 2)} ELSE {least} END THEN 'ai-chat/{tag}' END" for tag, least, p in R.DOMAIN_TAGS)
register(
    "domain_tags",
    lambda spark, sf: domain_tags(inline(spark, TAGGED, "conv_id bigint, index int, role string, text string").unionByName(messages(spark, sf)), ["conv_id"]).select("conv_id", joined(F.col("tags")).alias("tags")),
    f"""WITH m AS (SELECT conv_id::BIGINT AS conv_id, "index"::INT AS "index", role, text FROM {inline_sql(TAGGED, 'conv_id, "index", role, text')} UNION ALL SELECT * FROM {MESSAGES_SQL}),
        a AS (SELECT conv_id, count(*) AS n, string_agg(text, ' ' ORDER BY "index") AS alltext FROM m GROUP BY conv_id),
        t AS (SELECT conv_id, list_filter([{_TAG_HITS}], lambda x: x IS NOT NULL) AS l FROM a),
        u AS (SELECT conv_id, list_filter(l, lambda x, i: list_position(l, x) = i)[1:5] AS tags FROM t)
        SELECT conv_id, CASE WHEN len(tags) = 0 THEN 'ai-chat' ELSE {joined_sql('tags')} END AS tags FROM u""",
)


def segment_summary(first_user, first_assistant):
    """First line of the first question, and the first useful sentence of the first answer."""
    question = trim(F.substring(T.first_line(first_user), 1, 100))
    bare = first_assistant
    for p in R.SUMMARY_URLS:
        bare = p.replace(bare)
    lines = F.transform(F.split(trim(bare), "\n"), lambda x: trim(R.SUMMARY_MARKS.replace(x)))
    line = F.coalesce(F.get(F.filter(lines, lambda x: (F.length(x) >= 10) & ~x.rlike(r"^#{1,6}\s*\z") & ~x.rlike(r"^-{3,}\z")), 0), F.lit(""))
    answer = F.when(T.SENTENCE.test(line), trim(T.SENTENCE.find(line))).otherwise(trim(F.substring(line, 1, 100)))
    out = F.concat_ws(" -- ", question, F.when(F.length(answer) > 5, answer))
    return F.when(out == "", F.lit("No summary available.")).otherwise(out)


def _summary_sql(u: str, a: str) -> str:
    bare = a
    for p in R.SUMMARY_URLS:
        bare = p.replace_sql(bare)
    lines = f"list_transform(string_split({trim_sql(bare)}, chr(10)), lambda x: {trim_sql(R.SUMMARY_MARKS.replace_sql('x'))})"
    line = f"coalesce(list_filter({lines}, lambda x: length(x) >= 10 AND NOT regexp_matches(x, '^#{{1,6}}\\s*$') AND NOT regexp_matches(x, '^-{{3,}}$'))[1], '')"
    return f"""SELECT *, CASE WHEN {T.SENTENCE.test_sql('line')} THEN {trim_sql(T.SENTENCE.find_sql('line'))} ELSE {trim_sql('substr(line, 1, 100)')} END AS answer FROM (SELECT *, {trim_sql(f"substr(split_part({u}, chr(10), 1), 1, 100)")} AS question, {line} AS line FROM ft)"""


register(
    "segment_summary",
    lambda spark, sf: _first_turns(assigned(spark, sf), "conv_id", "seg_no").select("conv_id", "seg_no", segment_summary(F.col("first_user"), F.col("first_assistant")).alias("summary")),
    f"""{ASSIGNED_SQL}, ft AS (SELECT conv_id, seg_no, arg_min(text, "index") FILTER (role = 'user') AS first_user, arg_min(text, "index") FILTER (role = 'assistant') AS first_assistant FROM am GROUP BY ALL)
        SELECT conv_id, seg_no, coalesce(nullif(concat_ws(' -- ', question, CASE WHEN length(answer) > 5 THEN answer END), ''), 'No summary available.') AS summary FROM ({_summary_sql('first_user', 'first_assistant')})""",
)


def key_points(rows: DataFrame) -> DataFrame:
    """Up to six list items of a text, else its headings."""
    lines = F.split("t", "\n")
    item = lambda x: trim(F.coalesce(F.nullif(F.regexp_extract(x, r"^[ \t]{0,4}[-*+][ \t]+([^\n]+)", 1), F.lit("")), F.regexp_extract(x, r"^[ \t]{0,4}\d+\.[ \t]+([^\n]+)", 1)))
    items = F.filter(F.transform(lines, item), lambda x: (F.length(x) >= 10) & ~x.rlike(r"^[-_=*~`#]+\z"))
    clean = lambda x, rules: F.element_at(F.transform(F.array(x), lambda y: _all(rules, y)), 1)
    items = F.filter(F.transform(items, lambda x: clean(x, (R.BOLD, R.ITALIC, R.CODE, R.LINK))), lambda x: F.length(x) >= 10)
    heads = F.filter(F.transform(lines, lambda x: trim(F.regexp_extract(x, r"^#{2,4}[ \t]+([^\n]+)", 1))), lambda x: F.length(x) >= 5)
    heads = F.filter(F.transform(heads, lambda x: clean(x, (R.BOLD, R.CODE))), lambda x: F.length(x) >= 5)
    cap = lambda a: F.slice(F.array_distinct(a), 1, R.MOST_POINTS)
    return rows.select("id", F.when(F.size(items) > 0, cap(items)).otherwise(cap(heads)).alias("points"))


def _all(rules, c):
    for r in rules:
        c = r.replace(c)
    return c


def _all_sql(rules, e: str) -> str:
    for r in rules:
        e = r.replace_sql(e)
    return e


_ITEMS = f"""list_filter(list_transform(list_filter(list_transform(string_split(t, chr(10)), lambda x: {trim_sql("coalesce(nullif(regexp_extract(x, '^[ \\t]{0,4}[-*+][ \\t]+([^\\n]+)', 1), ''), regexp_extract(x, '^[ \\t]{0,4}\\d+\\.[ \\t]+([^\\n]+)', 1))")}), lambda x: length(x) >= 10 AND NOT regexp_matches(x, '^[-_=*~`#]+$')), lambda x: {_all_sql((R.BOLD, R.ITALIC, R.CODE, R.LINK), 'x')}), lambda x: length(x) >= 10)"""
_HEADS = f"""list_filter(list_transform(list_filter(list_transform(string_split(t, chr(10)), lambda x: {trim_sql("regexp_extract(x, '^#{2,4}[ \\t]+([^\\n]+)', 1)")}), lambda x: length(x) >= 5), lambda x: {_all_sql((R.BOLD, R.CODE), 'x')}), lambda x: length(x) >= 5)"""
register(
    "key_points",
    lambda spark, sf: key_points(texts(spark, sf)).select("id", joined(F.col("points")).alias("points")),
    f"""WITH p AS (SELECT id, CASE WHEN len({_ITEMS}) > 0 THEN {_ITEMS} ELSE {_HEADS} END AS l FROM {TEXTS_SQL})
        SELECT id, {joined_sql('list_filter(l, lambda x, i: list_position(l, x) = i)[1:6]')} AS points FROM p""",
)

# --- catalogue of existing notes

NOTES = [("a/one.md", 1), ("a/one copy.md", 1), ("b/Two.md", 2), ("B/three.md", 30), ("c/none.md", None)]


def existing(convs: DataFrame, notes: DataFrame) -> DataFrame:
    """Conversations that have a note, with the first of its paths."""
    first = notes.filter("conversation_id is not null").groupBy("conversation_id").agg(F.min("path").alias("path"))
    return convs.join(first, convs.conv_id == first.conversation_id).select("conv_id", "path")


def dedup_import(convs: DataFrame, notes: DataFrame, on_duplicate: str = "skip") -> DataFrame:
    """Conversations to import: new ones only, or all of them."""
    if on_duplicate == "import_new":
        return convs
    return convs.join(notes, convs.conv_id == notes.conversation_id, "left_anti")


def _convs(spark, sf: str) -> DataFrame:
    return read(spark, sf, "conversations").select("conv_id").distinct()


_NOTES_SCHEMA, _NOTES_SQL = "path string, conversation_id bigint", inline_sql(NOTES, "path, conversation_id")
register("existing_conversations", lambda spark, sf: existing(_convs(spark, sf), inline(spark, NOTES, _NOTES_SCHEMA)), f"SELECT conv_id, min(path) AS path FROM conversations JOIN {_NOTES_SQL} n ON conv_id = conversation_id GROUP BY conv_id")
register("dedup_import", lambda spark, sf: dedup_import(_convs(spark, sf), inline(spark, NOTES, _NOTES_SCHEMA)), f"SELECT DISTINCT conv_id FROM conversations WHERE conv_id NOT IN (SELECT conversation_id FROM {_NOTES_SQL} WHERE conversation_id IS NOT NULL)")
register("dedup_import_all", lambda spark, sf: dedup_import(_convs(spark, sf), inline(spark, NOTES, _NOTES_SCHEMA), "import_new"), "SELECT DISTINCT conv_id FROM conversations")
register(
    "folder_suggest",
    lambda spark, sf: inline(spark, NOTES, _NOTES_SCHEMA).select(F.substring_index("path", "/", 1).alias("folder")).distinct().filter(F.contains(F.lower("folder"), F.lit("b"))),
    f"SELECT DISTINCT split_part(path, '/', 1) AS folder FROM {_NOTES_SQL} WHERE contains(lower(split_part(path, '/', 1)), 'b')",
)
_PATHS = [(1, "x.md"), (2, "x.md"), (3, "x.md"), (4, "y.md"), (5, "z (2).md"), (6, "z.md"), (7, "z.md")]
_TAKEN = [("y.md",), ("x (2).md",)]
register(
    "resolve_collisions",
    lambda spark, sf: resolved(inline(spark, _PATHS, "ord bigint, path string"), inline(spark, _TAKEN, "path string")),
    f"""WITH RECURSIVE p AS (SELECT ord::BIGINT AS ord, path, row_number() OVER (ORDER BY ord) AS k FROM {inline_sql(_PATHS, 'ord, path')}),
        f AS (SELECT 0::BIGINT AS k, (SELECT list(path) FROM {inline_sql(_TAKEN, 'path')}) AS used, NULL::BIGINT AS ord, NULL::VARCHAR AS final
              UNION ALL SELECT p.k, list_append(f.used, x.name), p.ord, x.name FROM f JOIN p ON p.k = f.k + 1, LATERAL (SELECT list_filter(list_prepend(p.path, list_transform(range(2, 20), lambda n: regexp_replace(p.path, '\\.md$', '') || ' (' || n || ').md')), lambda c: NOT list_contains(f.used, c))[1] AS name) x)
        SELECT ord, final FROM f WHERE k > 0""",
)
