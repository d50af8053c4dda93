"""Queries of format detection and parsers."""

from __future__ import annotations

import json
import os
import tempfile
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..functions.dialect import any_sql, steps_sql, trim_sql
from ..operators import titles, tree
from ..sources import parse, scan
from .documents import _DOCS_SQL, _docs
from .fixtures import MESSAGES_SQL, TEXTS_SQL, inline, inline_sql, joined_sql, messages, texts
from .base import ORACLES, register

TREE = [{"id": "c1", "title": "Tree", "current_node": "d", "create_time": 1700000000.5, "mapping": {
    "a": {"id": "a", "parent": None, "message": None},
    "b": {"id": "b", "parent": "a", "message": {"author": {"role": "user"}, "create_time": 1700000000.5, "content": {"content_type": "text", "parts": ["Hello there"]}}},
    "x": {"id": "x", "parent": "a", "message": {"author": {"role": "user"}, "content": {"parts": ["other branch"]}}},
    "c": {"id": "c", "parent": "b", "message": {"author": {"role": "assistant"}, "create_time": 1700000060, "metadata": {"model_slug": "m-1"}, "content": {"content_type": "code", "parts": ["print(1)"]}}},
    "d": {"id": "d", "parent": "c", "message": {"author": {"role": "user"}, "content": {"parts": [{"asset_pointer": "p"}, "see image"]}}},
}}, {"id": "c2", "mapping": {"1": {"id": "1", "message": {"author": {"role": "user"}, "content": {"text": "only text"}}}, "2": {"id": "2", "message": {"author": {"role": "system"}, "content": {"parts": ["s"]}}}}}]
FLAT = {"uuid": "f1", "name": "Flat", "created_at": "2024-02-29T23:30:00Z", "updated_at": "2024-03-01T01:00:00+01:00", "chat_messages": [
    {"sender": "human", "text": "Question one?", "created_at": "2024-02-29T23:30:00.250Z", "attachments": [{"file_name": "a.txt", "file_type": "text/plain", "file_size": 3}, {}]},
    {"sender": "assistant", "content": [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "Answer"}, {"type": "tool_use"}]},
    {"sender": "system", "text": "x"}, {"sender": "human", "text": " "},
]}
INPUTS = [
    (1, json.dumps(TREE), None),
    (2, json.dumps(FLAT), None),
    (3, "You said:\nhow are you\nChatGPT said:\nThought for 5s\nfine\n```\nYou said:\n```\nYou said:\nbye\nChatGPT said:\nbye", None),
    (4, "Human: hi\nthere\nAssistant: hello\nHuman:\nbye", None),
    (5, "first question\nJan 5\nAnswer one.\n\n- list\n\nnext question\nFeb 6\nAnswer two", None),
    (6, "ask this\nThought for 12s\nAnswer here\n\n**bold** part\n\nand what now?\nThought for 3s\nlast", None),
    (7, "## User\nq1\n## Assistant\na1", None),
    (8, "# A\none two three four five six seven eight nine ten\n# B\none two three four five six seven eight nine ten", None),
    (9, "\n\n".join(f"para {i} with several words in it" for i in range(7)), None),
    (10, "short note", None),
    (11, "{not json", None),
    (12, "short note", "claude"),
    (13, "# A\none two three four five six seven eight nine ten\n# B\none two three four five six seven eight nine ten", "chatgpt"),
    (14, "**User:** hi\n**Assistant:** hello you", None),
    (15, '{"a": 1}', None),
]
_SCHEMA = "input_id bigint, content string, override string"


def _inputs(spark, *only: int) -> DataFrame:
    return inline(spark, [r for r in INPUTS if not only or r[0] in only], _SCHEMA)


_NAMES = {"chatgpt_json": "chatgpt", "claude_json": "claude"}
_FENCE_SQL = r"'(?m)^```[^\n]*\n(?s:.*?)^```\s*$|^~~~[^\n]*\n(?s:.*?)^~~~\s*$'"
_LINES = f"string_split({trim_sql('t')}, chr(10))"
_ANY = lambda p: f"len(list_filter({_LINES}, lambda x: {p.test_sql(trim_sql('x'))})) > 0"
_JSON_SQL = f"try_cast({trim_sql('t')} AS JSON)"
_HAS = lambda name, kind: f"json_type({_JSON_SQL}, CASE WHEN json_type({_JSON_SQL}) = 'ARRAY' THEN '$[0].{name}' ELSE '$.{name}' END) = '{kind}'"
_T = trim_sql("t")
_DETECT_SQL = " ".join(
    [
        f"WITH i AS (SELECT input_id::BIGINT AS id, content AS t FROM {inline_sql([r[:2] for r in INPUTS], 'input_id, content')} UNION ALL SELECT * FROM {TEXTS_SQL})",
        f"SELECT id, CASE WHEN left({_T}, 1) IN ('{{', '[') THEN CASE WHEN {_HAS('mapping', 'OBJECT')} THEN 'chatgpt_json' WHEN {_HAS('chat_messages', 'ARRAY')} THEN 'claude_json' ELSE 'markdown' END",
        f"WHEN {_ANY(R.USER_LABEL_A)} AND {_ANY(R.REPLY_LABEL_A)} THEN 'chatgpt_paste' WHEN {_ANY(R.USER_LABEL_B)} AND {_ANY(R.REPLY_LABEL_B)} THEN 'claude_paste'",
        f"WHEN NOT {R.LABEL_B.test_sql(_T)} AND len(list_filter(string_split(regexp_replace({_T}, {_FENCE_SQL}, '', 'g'), chr(10)), lambda x: {R.DATE_STAMP.test_sql(trim_sql('x'))})) >= 2 THEN 'claude_web'",
        f"WHEN {R.THOUGHT.test_sql(_T)} THEN 'chatgpt_thought' ELSE 'markdown' END AS format FROM i",
    ]
)
register(
    "detect_format",
    lambda spark, sf: _inputs(spark).select(F.col("input_id").alias("id"), F.col("content").alias("t")).unionAll(texts(spark, sf)).select("id", parse.detect_format(F.col("t")).alias("format")),
    _DETECT_SQL,
)
#: expected rows: what each inline input parses to, written out by hand
_LONG = "one two three four five six seven eight nine ten"
_NO_SPEAKER = "No speaker pattern detected. Treating entire input as a single message."
#: input, conversation, its id (a digest without one), title, source, content type, method, created, updated, warnings
_CONVERSATIONS = [
    (1, 0, "c1", "Tree", "chatgpt", "chat", "file-json", 1700000000.5, None, ""),
    (1, 1, "c2", "only text", "chatgpt", "chat", "file-json", None, None, "No current_node found; walking all nodes"),
    (2, 0, "f1", "Flat", "claude", "chat", "file-json", 1709249400.0, 1709251200.0, "Empty user message at index 2 was skipped"),
    (3, 0, None, "how are you", "chatgpt", "chat", "paste", None, None, ""),
    (4, 0, None, "hi\nthere", "claude", "chat", "paste", None, None, ""),
    (5, 0, None, "first question", "claude", "chat", "paste", None, None, ""),
    (6, 0, None, "ask this", "chatgpt", "chat", "paste", None, None, ""),
    (7, 0, None, "q1", "markdown", "chat", "paste", None, None, ""),
    (8, 0, None, "# A\none two three four five six seven eight nine t...", "markdown", "document", "paste", None, None, ""),
    (9, 0, None, "para 0 with several words in it\n\npara 1 with sever...", "markdown", "document", "paste", None, None, ""),
    (10, 0, None, "short note", "markdown", "chat", "paste", None, None, _NO_SPEAKER),
    (11, 0, None, "{not json", "markdown", "chat", "paste", None, None, _NO_SPEAKER),
    (12, 0, None, "short note", "claude", "chat", "paste", None, None, _NO_SPEAKER),
    (13, 0, None, "# A\none two three four five six seven eight nine t...", "chatgpt", "chat", "paste", None, None, ""),
    (14, 0, None, "hi", "markdown", "chat", "paste", None, None, ""),
    (15, 0, None, '{"a": 1}', "markdown", "chat", "paste", None, None, _NO_SPEAKER),
]
#: input, conversation, index, role, text, time, blocks (one text block without them), metadata
_TURNS = [
    (1, 0, 0, "user", "Hello there", 1700000000.5, None, "{}"),
    (1, 0, 1, "assistant", "print(1)", 1700000060.0, '[{"type": "code", "content": "print(1)", "language": ""}]', '{"model": "m-1"}'),
    (1, 0, 2, "user", "see image", None, '[{"type": "image", "alt_text": "Image"}, {"type": "text", "content": "see image"}]', "{}"),
    (1, 1, 0, "user", "only text", None, None, "{}"),
    (2, 0, 0, "user", "Question one?", 1709249400.25, None, '{"attachments": [{"name": "a.txt", "mimeType": "text/plain", "size": 3}, {"name": "attachment", "mimeType": null, "size": null}]}'),
    (2, 0, 1, "assistant", "Answer", None, '[{"type": "thinking", "content": "hm"}, {"type": "text", "content": "Answer"}]', "{}"),
    (3, 0, 0, "user", "how are you", None, None, "{}"),
    (3, 0, 1, "assistant", "fine\n```\nYou said:\n```", None, '[{"type": "text", "content": "fine"}, {"type": "code", "language": "", "content": "You said:"}]', "{}"),
    (3, 0, 2, "user", "bye", None, None, "{}"),
    (3, 0, 3, "assistant", "bye", None, None, "{}"),
    (4, 0, 0, "user", "hi\nthere", None, None, "{}"),
    (4, 0, 1, "assistant", "hello", None, None, "{}"),
    (4, 0, 2, "user", "bye", None, None, "{}"),
    (5, 0, 0, "user", "first question", None, None, "{}"),
    (5, 0, 1, "assistant", "Answer one.\n\n- list", None, None, "{}"),
    (5, 0, 2, "user", "next question", None, None, "{}"),
    (5, 0, 3, "assistant", "Answer two", None, None, "{}"),
    (6, 0, 0, "user", "ask this", None, None, "{}"),
    (6, 0, 1, "assistant", "Answer here\n\n**bold** part", None, None, "{}"),
    (6, 0, 2, "user", "and what now?", None, None, "{}"),
    (6, 0, 3, "assistant", "last", None, None, "{}"),
    (7, 0, 0, "user", "q1", None, None, "{}"),
    (7, 0, 1, "assistant", "a1", None, None, "{}"),
    (8, 0, 0, "user", f"# A\n{_LONG}", None, None, "{}"),
    (8, 0, 1, "user", f"# B\n{_LONG}", None, None, "{}"),
    (9, 0, 0, "user", "para 0 with several words in it\n\npara 1 with several words in it\n\npara 2 with several words in it", None, None, "{}"),
    (9, 0, 1, "user", "para 3 with several words in it\n\npara 4 with several words in it\n\npara 5 with several words in it", None, None, "{}"),
    (10, 0, 0, "user", "short note", None, None, "{}"),
    (11, 0, 0, "user", "{not json", None, None, "{}"),
    (12, 0, 0, "user", "short note", None, None, "{}"),
    (13, 0, 0, "user", f"# A\n{_LONG}", None, None, "{}"),
    (13, 0, 1, "user", f"# B\n{_LONG}", None, None, "{}"),
    (14, 0, 0, "user", "hi", None, None, "{}"),
    (14, 0, 1, "assistant", "hello you", None, None, "{}"),
    (15, 0, 0, "user", '{"a": 1}', None, None, "{}"),
]


def _parsed_sql(*only: int) -> str:
    pick = lambda rows: [r for r in rows if not only or r[0] in only]
    return f"""SELECT c.input_id::BIGINT AS input_id, c.conv_no, coalesce(c.conv_id, substr(sha256(c.conv_no || '|' || i.content), 1, 16)) AS conv_id, title, source, content_type, input_method, created_at::DOUBLE AS created_at, updated_at::DOUBLE AS updated_at,
        t."index", role, text, ts::DOUBLE AS ts, coalesce(blocks, '[{{"type": "text", "content": ' || to_json(text) || '}}]') AS blocks, metadata, warnings
        FROM {inline_sql(pick(_CONVERSATIONS), 'input_id, conv_no, conv_id, title, source, content_type, input_method, created_at, updated_at, warnings')} c
        JOIN {inline_sql(pick(_TURNS), 'input_id, conv_no, "index", role, text, ts, blocks, metadata')} t ON c.input_id = t.input_id AND c.conv_no = t.conv_no
        JOIN {inline_sql([r[:2] for r in pick(INPUTS)], 'input_id, content')} i ON c.input_id = i.input_id"""


for _name, _only in {"parse_inputs": (), "parse_chatgpt_json": (1,), "parse_claude_json": (2,), "parse_chatgpt_paste": (3,), "parse_claude_paste": (4,), "parse_claude_web": (5,), "parse_chatgpt_unlabeled": (6,), "parse_markdown": (7, 8, 9, 10, 14), "source_override": (12, 13)}.items():
    register(_name, lambda spark, sf, o=_only: parse.parsed_messages(_inputs(spark, *o)), _parsed_sql(*_only))
register(
    "parse_documents",
    lambda spark, sf: parse.parsed_messages(_docs(spark, sf).select(F.col("id").alias("input_id"), F.col("t").alias("content"), F.lit(None).cast("string").alias("override"))).select("input_id", "index", "content_type", F.md5("text").alias("digest")),
    # sections if two are long enough, else groups of paragraphs if two are, else one message
    f"""WITH a AS ({ORACLES['doc_sections']}), b AS ({ORACLES['doc_paragraph_groups']}),
        na AS (SELECT id FROM a GROUP BY id HAVING count(*) >= 2), nb AS (SELECT id FROM b WHERE id NOT IN (SELECT id FROM na) GROUP BY id HAVING count(*) >= 2),
        x AS (SELECT id, "index", 'document' AS content_type, content FROM a WHERE id IN (SELECT id FROM na) UNION ALL SELECT id, "index", 'document', content FROM b WHERE id IN (SELECT id FROM nb)
              UNION ALL SELECT id, 0, 'chat', {trim_sql('t')} FROM {_DOCS_SQL} WHERE id NOT IN (SELECT id FROM na UNION ALL SELECT id FROM nb) AND coalesce({trim_sql('t')}, '') <> '')
        SELECT id AS input_id, "index", content_type, md5(content) AS digest FROM x""",
)
_TREE_JSON = json.dumps(TREE).replace("'", "''")
register(
    "list_conversations",
    lambda spark, sf: _listed(_inputs(spark, 1)),
    f"SELECT coalesce(c->>'id', '') AS id, coalesce(nullif(c->>'title', ''), 'Untitled') AS title, len(json_keys(c->'mapping')) AS n_nodes FROM (SELECT unnest(json_extract('{_TREE_JSON}'::JSON, '$[*]')) AS c)",
)


def _listed(inputs: DataFrame) -> DataFrame:
    """id, title and node count of each conversation of a tree export, by JSON functions alone."""
    kind = "array<struct<id:string,title:string,mapping:map<string,string>>>"
    rows = inputs.select(F.explode(F.from_json("content", kind)).alias("c"))
    return rows.select(F.coalesce("c.id", F.lit("")).alias("id"), F.coalesce(F.nullif("c.title", F.lit("")), F.lit("Untitled")).alias("title"), F.coalesce(F.size(F.map_keys("c.mapping")), F.lit(0)).alias("n_nodes"))


register(
    "mask_code",
    lambda spark, sf: texts(spark, sf).select("id", parse.masked(F.col("t")).alias("value")),
    f"SELECT id, regexp_replace(t, {_FENCE_SQL}, '__CODE__', 'g') AS value FROM {TEXTS_SQL}",
)
register(
    "content_blocks",
    lambda spark, sf: parse.parsed_messages(
        inline(spark, [(1, "before\n```python\n  x = 1\n```\nafter\n~~~\ny\n~~~", None)], _SCHEMA).unionByName(texts(spark, sf).select(F.col("id").alias("input_id"), F.col("t").alias("content"), F.lit(None).cast("string").alias("override")))
    ).select("index", "blocks"),
)

# --- tree walk: pointer doubling against a recursive query
NODES = [("t1", "a", None), ("t1", "b", "a"), ("t1", "c", "b"), ("t1", "x", "a"), *[("t2", str(i), str(i - 1) if i else None) for i in range(150)], ("t3", "p", "q"), ("t3", "q", None)]
LEAVES = [("t1", "c"), ("t2", "149"), ("t3", "p")]
register(
    "tree_walk",
    lambda spark, sf: tree.walk(inline(spark, NODES, "conv_id string, node_id string, parent_id string"), inline(spark, LEAVES, "conv_id string, node_id string")),
    f"""WITH RECURSIVE n AS {inline_sql(NODES, 'conv_id, node_id, parent_id')}, w AS (SELECT conv_id, node_id, 0 AS depth FROM {inline_sql(LEAVES, 'conv_id, node_id')}
        UNION ALL SELECT w.conv_id, n.parent_id, depth + 1 FROM w JOIN n ON w.conv_id = n.conv_id AND w.node_id = n.node_id WHERE n.parent_id IS NOT NULL) SELECT * FROM w""",
)
# --- last run of user-like paragraphs: a window against the fold of the parser
_PARAS = [(i, j, p) for i, ps in enumerate([["# head", "one", "two"], ["plain", "also plain"], ["x", "- item"], ["**b**", "q?"]]) for j, p in enumerate(ps)]
register(
    "trailing_run",
    lambda spark, sf: _trailing(inline(spark, _PARAS, "id bigint, pos int, p string")),
    f"SELECT id::BIGINT AS id, coalesce(max(pos) FILTER ({any_sql(R.NOT_USER, 'p')}) + 1, 0) AS user_start FROM {inline_sql(_PARAS, 'id, pos, p')} GROUP BY id",
)


def _trailing(rows: DataFrame) -> DataFrame:
    from ..functions.dialect import any_of

    return rows.groupBy("id").agg(F.coalesce(F.max(F.when(any_of(R.NOT_USER, F.col("p")), F.col("pos"))) + 1, F.lit(0)).alias("user_start"))


# --- files


def _scan_text(spark, sf: str) -> DataFrame:
    from ..sources.shared import scratch

    at = scratch(spark, "text")
    inline(spark, [(t,) for _, t, _ in INPUTS[2:5]], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\u0001").text(at)
    return scan.text_files(spark, at).select(F.explode(F.filter(F.split("content", "\u0001"), lambda x: x != "")).alias("content")).select("content", F.length("content").alias("n"))


def _zipped() -> bytes:
    with tempfile.TemporaryDirectory() as d:
        path = os.path.join(d, "x.zip")
        with zipfile.ZipFile(path, "w") as z:
            z.writestr("user.json", "{}")
            z.writestr("export/conversations.json", INPUTS[1][1])
        with open(path, "rb") as f:
            return f.read()


register("scan_text", _scan_text, f"SELECT content, length(content)::INT AS n FROM {inline_sql([(t,) for _, t, _ in INPUTS[2:5]], 'content')}")
register(
    "scan_zip",
    lambda spark, sf: scan.zip_files(inline(spark, [("x.zip", _zipped())], "path string, content binary")),
    f"SELECT * FROM {inline_sql([('x.zip', 'export/conversations.json', INPUTS[1][1])], 'path, entry, content')}",
)

# --- titles and lists of conversations
_TALKS = [
    (-1, 0, "user", "Postgres vs MySQL for analytics?"), (-1, 1, "assistant", "Sure, both work."),
    (-2, 0, "user", "Can you explain how vector indexes work? thanks"), (-2, 1, "assistant", "## Inverted file indexes explained\nI recommend HNSW for most cases, overall it works well.\n\n**The main point is recall**"),
    (-3, 0, "user", "i like Antigua, Barbados and New York City"), (-3, 1, "assistant", "Here's a short overview of places. Ask me."),
    (-4, 0, "user", "ok"), (-5, 0, "assistant", "Nothing was asked here at all today"),
]


def _described(spark, sf: str, *names: str) -> DataFrame:
    rows = inline(spark, _TALKS, "conv_id bigint, index int, role string, text string").unionByName(messages(spark, sf))
    return titles.described(rows, ["conv_id"], names)


def _settled_sql(name: str, source: str, rules: tuple, cut: bool) -> str:
    """CTE ``name`` (t, s, k, still): the rules applied to each t in turn until none of them changes s.

    With ``cut`` a rule that takes something away also takes marks and blanks left in front."""
    n = len(rules)
    one = "CASE k % {n} {ways} END".format(n=n, ways=" ".join(f"WHEN {i} THEN {r.replace_sql('s')}" for i, r in enumerate(rules)))
    after = f"CASE WHEN c = s THEN s ELSE {R.LEADING_PUNCTUATION.replace_sql(trim_sql('c'))} END" if cut else trim_sql("c")
    return f"""{name} AS (SELECT t, t AS s, 0 AS k, 0 AS still FROM (SELECT DISTINCT t FROM {source}) UNION ALL
        SELECT t, n, k + 1, CASE WHEN n = s THEN still + 1 ELSE 0 END FROM (SELECT *, {after} AS n FROM (SELECT *, {one} AS c FROM {name} WHERE still < {n})))"""


def _listed_sql(column: str, candidates: str, most: int, spare: str = "NULL") -> str:
    """Folds ordered candidates (conv_id, r from 1, item) of the CTEs into items whose normal forms do not
    contain each other; ``spare`` is taken where there are none."""
    return f"""{candidates},
        fold AS (SELECT DISTINCT conv_id, 0::BIGINT AS r, []::VARCHAR[] AS items, []::VARCHAR[] AS forms FROM msgs UNION ALL
            SELECT conv_id, r, CASE WHEN ok THEN list_append(items, item) ELSE items END, CASE WHEN ok THEN list_append(forms, form) ELSE forms END FROM (
                SELECT f.conv_id, c.r, f.items, f.forms, c.item, c.form, len(f.items) < {most} AND len(list_filter(f.forms, lambda x: contains(x, c.form) OR contains(c.form, x))) = 0 AS ok
                FROM fold f JOIN (SELECT *, {T.normal_form_sql('item')} AS form FROM cand) c ON f.conv_id = c.conv_id AND c.r = f.r + 1)),
        done AS (SELECT conv_id, arg_max(items, r) AS items FROM fold GROUP BY conv_id)
        SELECT done.conv_id, coalesce({joined_sql("CASE WHEN len(items) > 0 THEN items WHEN spare.item IS NOT NULL THEN [spare.item] ELSE [] END")}, '') AS {column}
        FROM done LEFT JOIN ({spare if spare != "NULL" else "SELECT NULL::BIGINT AS conv_id, NULL::VARCHAR AS item"}) spare ON done.conv_id = spare.conv_id"""


_INLINE_TALKS = inline_sql(_TALKS, 'conv_id, "index", role, text')
_MSGS_SQL = f"""msgs AS (SELECT conv_id::BIGINT AS conv_id, "index", role, text FROM {_INLINE_TALKS} UNION ALL SELECT conv_id, "index", role, text FROM {MESSAGES_SQL})"""
_ASK = any_sql((R.QUESTION_END, R.QUESTION_WORD, R.REQUEST), "clean")
_QUESTIONS_SQL = _listed_sql(
    "questions",
    f"""WITH RECURSIVE {_MSGS_SQL},
        u AS (SELECT conv_id, "index", {T.first_sentence_sql('x')} AS t FROM (SELECT conv_id, "index", {steps_sql(R.STRIP_MARKDOWN, trim_sql('text'))} AS x FROM msgs WHERE role = 'user') WHERE x <> ''),
        {_settled_sql('st', 'u', tuple(R.FILLERS), True)},
        a AS (SELECT u.conv_id, u."index", u.t, s, {trim_sql(steps_sql(R.CLEAN_INLINE, 'u.t'))} AS whole FROM u JOIN st ON u.t = st.t AND st.still = {len(R.FILLERS)}),
        b AS (SELECT conv_id, "index", {trim_sql(R.LEADING_PUNCTUATION.replace_sql(T.strip_artifacts_sql("(CASE WHEN length(s) < 20 AND length(whole) >= 20 THEN whole ELSE s END)")))} AS asked FROM a),
        c AS (SELECT *, {steps_sql(R.CLEAN_INLINE, 'asked')} AS clean FROM b),
        cand AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY "index") AS r, {T.truncate_item_sql('clean')} AS item FROM c WHERE length(asked) >= 5 AND length(clean) >= 5 AND {_ASK})""",
    R.MOST_QUESTIONS,
)
_SENTENCE_OR = lambda e, most: f"CASE WHEN {T.SENTENCE.test_sql(e)} THEN {trim_sql(T.SENTENCE.find_sql(e))} ELSE {trim_sql(f'substr({e}, 1, {most})')} END"
_TAKEN = trim_sql(steps_sql(R.CLEAN_INLINE, "x"))
for _rule in (titles._BULLET, titles._NUMBER, titles._ONE_BLANK):
    _TAKEN = _rule.replace_sql(_TAKEN)
_TAKEAWAYS_SQL = _listed_sql(
    "takeaways",
    f"""WITH RECURSIVE {_MSGS_SQL},
        w AS (SELECT conv_id, "index", text FROM msgs WHERE role = 'assistant'),
        s AS (SELECT conv_id, "index", unnest({T.sentences_sql('text')}) AS x, generate_subscripts({T.sentences_sql('text')}, 1) AS pos FROM w),
        k AS (SELECT conv_id, "index", pos, {T.strip_artifacts_sql(_TAKEN)} AS clean FROM s WHERE {T.is_takeaway_sql('x')} AND NOT {any_sql(R.PROMPTS, 'x')} AND NOT {R.ACKNOWLEDGED.test_sql('x')}),
        bd AS (SELECT conv_id, "index", unnest(bs) AS raw, generate_subscripts(bs, 1) AS pos FROM (SELECT conv_id, "index", regexp_extract_all(text, '\\*\\*([^*]{{15,}})\\*\\*', 1) AS bs FROM w)),
        b AS (SELECT conv_id, "index", pos, {trim_sql('raw')} AS x FROM bd),
        al AS (SELECT conv_id, 0 AS phase, "index", pos, {T.truncate_item_sql('clean')} AS item FROM k WHERE length(clean) >= 15
               UNION ALL SELECT conv_id, 1, "index", pos, {T.truncate_item_sql('x')} FROM b WHERE length(x) >= 15 AND {any_sql(R.TAKEAWAYS, 'x')} AND NOT {any_sql(R.PROMPTS, 'x')}),
        cand AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY phase, "index", pos) AS r, item FROM al)""",
    R.MOST_TAKEAWAYS,
    f"""SELECT conv_id, {T.truncate_item_sql('clean')} AS item FROM (SELECT conv_id, {steps_sql(R.CLEAN_INLINE, _SENTENCE_OR('ending', 200))} AS clean FROM (
            SELECT conv_id, CASE WHEN len(ps) > 1 THEN {trim_sql('ps[-1]')} ELSE '' END AS ending FROM (SELECT conv_id, {T.paragraphs_sql('arg_max(text, "index")')} AS ps FROM w GROUP BY conv_id))
            WHERE length(ending) >= 20 AND NOT starts_with(ending, '```') AND NOT {any_sql((R.NO_PROSE[1], R.NO_PROSE[2]), 'ending')}) WHERE length(clean) >= 15 AND NOT {any_sql(R.PROMPTS, 'clean')}""",
)
_HEADED = trim_sql(R.HEADING_NUMBER.replace_sql(T.strip_artifacts_sql(steps_sql(R.CLEAN_INLINE, trim_sql(R.TITLE_HEADING.find_sql("line", 2))))))
_TOPICS_SQL = _listed_sql(
    "topics",
    f"""WITH RECURSIVE {_MSGS_SQL},
        w AS (SELECT conv_id, "index", text FROM msgs WHERE role = 'assistant'),
        ln AS (SELECT conv_id, "index", unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM w),
        hd AS (SELECT conv_id, "index", pos, {_HEADED} AS words FROM ln WHERE {R.TITLE_HEADING.test_sql('line')}),
        h AS (SELECT conv_id, "index", pos, {T.truncate_item_sql('words')} AS item FROM hd WHERE length(words) >= 20),
        op AS (SELECT conv_id, "index", {trim_sql(R.GREETING.replace_sql('first'))} AS opening FROM (SELECT conv_id, "index", ({T.meaningful_lines_sql('text')})[1] AS first FROM w) WHERE first IS NOT NULL),
        st AS (SELECT conv_id, "index", {T.strip_artifacts_sql(steps_sql(R.CLEAN_INLINE, _SENTENCE_OR('opening', 150)))} AS x FROM op WHERE length(opening) >= 10),
        g AS (SELECT conv_id, "index", x, {T.last_space_sql('substr(x, 1, 81)')} AS sp FROM st WHERE NOT {R.TOPIC_PRONOUNS.test_sql('x')} AND length(x) >= 20 AND NOT {R.ACKNOWLEDGED.test_sql('x')}),
        al AS (SELECT conv_id, "index", pos, item FROM h UNION ALL SELECT conv_id, "index", 0, CASE WHEN length(x) <= 80 THEN x WHEN sp > 40 THEN substr(x, 1, sp) ELSE substr(x, 1, 80) END FROM g WHERE conv_id NOT IN (SELECT conv_id FROM h)),
        cand AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY "index", pos) AS r, item FROM al)""",
    R.MOST_TOPICS,
)
_ORACLES = {"questions": _QUESTIONS_SQL, "takeaways": _TAKEAWAYS_SQL, "topics": _TOPICS_SQL}


def _one_string(df: DataFrame, name: str) -> DataFrame:
    """Lists as one string, so that rows compare in any engine."""
    return df.withColumn(name, F.array_join(name, "¦")) if df.schema[name].dataType.typeName() == "array" else df


for _name, _columns in {"titles": ["title"], "entities": ["entities"], "tags": ["tags"], "questions": ["questions"], "topics": ["topics"], "takeaways": ["takeaways"]}.items():
    register(_name, lambda spark, sf, c=_columns: _one_string(_described(spark, sf, *c), c[0]), _ORACLES.get(_name))
_FILLED = ["Can you please help me find the best hotels", "ok so let's break down the budget", "what about the visa?", "tell me about it if you want to", "plain text"]


def _mapped(spark, f, rows: list, sf: str | None = None) -> DataFrame:
    """``f`` of the inline rows and, with ``sf``, of all texts."""
    import pandas as pd

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"t": b["t"], "value": [None if x is None else str(f(x)) for x in b["t"]]})

    found = inline(spark, [(x,) for x in rows], "t string")
    return (found if sf is None else found.unionAll(texts(spark, sf).select("t"))).mapInPandas(run, "t string, value string")


_FILLED_SQL = f"(SELECT t FROM {inline_sql([(x,) for x in _FILLED], 't')} UNION ALL SELECT t FROM {TEXTS_SQL})"
_OPENINGS = (*R.FILLERS, *R.ACTIONS)
_KERNELS = (*_OPENINGS, R.CONTEXTUAL, R.NUMBERED_ITEM, R.EACH_ONE, R.LEADING_PUNCTUATION)
register(
    "strip_filler",
    lambda spark, sf: _mapped(spark, titles.strip_filler, _FILLED, sf),
    f"WITH RECURSIVE src AS {_FILLED_SQL}, {_settled_sql('st', 'src', _OPENINGS, True)} SELECT src.t, s AS value FROM src JOIN st ON src.t = st.t AND still = {len(_OPENINGS)}",
)
_KERNEL = trim_sql(R.ARTICLE.replace_sql("s"))
register(
    "topic_kernel",
    lambda spark, sf: _mapped(spark, titles.topic_kernel, _FILLED, sf),
    f"""WITH RECURSIVE src AS {_FILLED_SQL}, fs AS (SELECT t AS full, {T.first_sentence_sql('t')} AS t FROM src), {_settled_sql('st', 'fs', _KERNELS, False)},
        kn AS (SELECT fs.full, {_KERNEL} AS kernel FROM fs JOIN st ON fs.t = st.t AND still = {len(_KERNELS)}) SELECT "full" AS t, {T.truncate_word_sql('kernel', 40)} AS value FROM kn""",
)
#: pairs and whether they count as one: close long names do, short ones and other stems do not
_PAIRS = [("carriibbean|caribbean", "True"), ("barbados|barbado", "True"), ("cat|dog", "False"), ("planning|plans", "False"), ("antigua|antiqua", "False")]
register("fuzzy_match", lambda spark, sf: _mapped(spark, lambda x: titles.fuzzy_match(*x.split("|")), [a for a, _ in _PAIRS]), f"SELECT * FROM {inline_sql(_PAIRS, 't, value')}")
