"""Notes in Markdown: front matter, messages, summaries, navigation and index.

All of it is column expressions over segments and their messages; ordered text is built from
sorted arrays of structs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import rules as R
from ..functions import text as T
from ..functions.dialect import trim
from ..sources.shared import cut
from . import segments as S
from . import titles

NL = "\n"


def lit(s: str) -> Column:
    return F.lit(s)


def ordered(key: str, value: Column, separator: str) -> Column:
    """Values of a group joined in order of a column."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), value.alias("v")))), lambda x: x["v"]), separator)


# --- content blocks (array of structs: type, content, language, title, alt_text, url)

BLOCK = "struct<type:string,content:string,language:string,title:string,alt_text:string,url:string>"


def render_blocks(blocks: Column, style: str) -> Column:
    def one(b: Column) -> Column:
        fence = F.concat(lit("```"), F.coalesce(b["language"], lit("")), lit(NL), b["content"], lit("\n```"))
        quoted = F.concat(lit("> [!note] Artifact: "), b["title"], lit("\n> "), F.replace(F.when(F.coalesce(b["language"], lit("")) != "", fence).otherwise(b["content"]), lit(NL), lit("\n> ")))
        artifact = quoted if style == "callouts" else F.concat(lit("**Artifact: "), b["title"], lit("**\n"), b["content"])
        image = F.when(F.coalesce(b["url"], lit("")) != "", F.concat(lit("!["), b["alt_text"], lit("]("), b["url"], lit(")"))).otherwise(F.concat(lit("[Image: "), b["alt_text"], lit("]")))
        return F.when(b["type"] == "text", b["content"]).when(b["type"] == "code", fence).when(b["type"] == "artifact", artifact).when(b["type"] == "image", image)

    return F.array_join(F.filter(F.transform(blocks, one), lambda x: x.isNotNull()), "\n\n")


def utc_date(seconds: Column) -> Column:
    """The day of epoch seconds, whatever the time zone of the session."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int")).cast("string")


def utc_minute(seconds: Column) -> Column:
    """``yyyy-MM-dd HH:mm`` of epoch seconds."""
    minute = F.pmod(F.floor(seconds / 60), F.lit(1440))
    two = lambda c: F.lpad(c.cast("int").cast("string"), 2, "0")
    return F.concat(utc_date(seconds), lit(" "), two(F.floor(minute / 60)), lit(":"), two(F.pmod(minute, F.lit(60))))


def seconds(stamp: Column) -> Column:
    return F.unix_micros(stamp) / F.lit(1_000_000.0)


def render_message(role: Column, content: Column, style: str, n_words: Column, stamp: Column | None = None, thinking: Column | None = None, threshold: int = 800) -> Column:
    label = F.when(role == "user", "User").otherwise("Assistant")
    at = F.coalesce(F.concat(lit(" ("), utc_minute(seconds(stamp)), lit(")")), lit("")) if stamp is not None else lit("")
    if style == "callouts":
        head = F.concat(lit("> [!"), F.lower(label), lit("]"), F.when(n_words > threshold, "-").otherwise(""), lit(" "), label, at, lit(NL), T.prefix_lines(content, "> "))
        if thinking is None:
            return head
        thoughts = F.transform(thinking, lambda t: F.concat(lit("> [!thinking]- Thinking\n"), T.prefix_lines(t, "> ")))
        return F.array_join(F.concat(thoughts, F.array(head)), "\n\n")
    if style == "blockquotes":
        return F.concat(lit("**"), label, lit(":**"), at, lit(NL), T.prefix_lines(content, "> "))
    if style == "bold":
        return F.concat(lit("**"), label, lit(":**"), at, lit(" "), content)
    return content if stamp is None else F.when(at == "", content).otherwise(F.concat(content, lit("\n\n<small>"), trim(at), lit("</small>")))


def shown_message(get, columns: list[str], style: str, threshold: int = 800, stamps: bool = False) -> Column:
    """A message rendered in one style; ``get`` gives its columns by name.  Where it has ``blocks``
    (JSON) these are shown, with thoughts before the message, and the text otherwise."""
    content, thinking = get("text"), None
    if "blocks" in columns:
        blocks = F.from_json(get("blocks"), f"array<{BLOCK}>")
        content = F.when(F.size(blocks) > 0, render_blocks(blocks, style)).otherwise(content)
        thinking = F.transform(F.filter(F.coalesce(blocks, F.array().cast(f"array<{BLOCK}>")), lambda b: b["type"] == "thinking"), lambda b: b["content"])
    n_words = get("n_words") if "n_words" in columns else T.word_count(get("text"))
    return render_message(get("role"), content, style, n_words, get("ts") if stamps and "ts" in columns else None, thinking, threshold)


def message_text(messages: DataFrame, keys: list[str], style: str, threshold: int = 800, stamps: bool = False) -> DataFrame:
    """keys, body: the user and assistant messages of each group in one of the four styles; those of
    documents (by ``content_type``) are plain."""
    shown = messages.filter(~F.col("role").isin("system", "tool"))
    one = shown_message(F.col, messages.columns, style, threshold, stamps)
    if "content_type" in messages.columns:
        one = F.when(F.col("content_type") == "document", shown_message(F.col, messages.columns, "plain", threshold, stamps)).otherwise(one)
    return shown.groupBy(*keys).agg(ordered("index", one, "\n\n").alias("body"))


# --- front matter


def frontmatter(fields: list[tuple[str, Column]], custom: str = "") -> Column:
    """Lines ``name: value`` between rules; fields whose value is null are left out."""
    lines = [F.when(v.isNotNull(), F.concat(lit(f"{k}: "), v.cast("string"))) for k, v in fields]
    own = [lit(x) for x in (y.strip() for y in custom.strip().split("\n")) if x and R.YAML_LINE.test_py(x)]
    return F.concat_ws(NL, lit("---"), *lines, *own, lit("---"))


def link(name: Column) -> Column:
    return F.concat(lit('"[['), name, lit(']]"'))


# --- navigation


def nav_links(notes: DataFrame) -> DataFrame:
    """Adds prev_name and next_name of each note within its conversation."""
    w = Window.partitionBy("conv_id").orderBy("seg_no")
    return notes.withColumn("prev_name", F.lag("name").over(w)).withColumn("next_name", F.lead("name").over(w))


def footer(prev: Column, parent: Column, next_: Column) -> Column:
    parts = F.concat_ws(" | ", F.concat(lit("Previous: [["), prev, lit("]]")), F.concat(lit("[["), parent, lit("|Back to Index]]")), F.concat(lit("Next: [["), next_, lit("]]")))
    return F.concat(lit("---\n> [!info] Navigation\n> "), parts)


# --- summary block


def _listing(kind: str, name: str, items: Column, numbered: bool = False) -> Column:
    lines = F.transform(items, (lambda x, i: F.concat(lit("> "), (i + 1).cast("string"), lit(". "), x)) if numbered else (lambda x: F.concat(lit("> - "), x)))
    return F.when(F.size(items) > 0, F.concat(lit(f"> [!{kind}] {name}\n"), F.array_join(lines, NL)))


def summary_block(summary: Column, tags: Column, questions: Column, topics: Column, takeaways: Column, links: Column) -> Column:
    ticked = F.array_join(F.transform(tags, lambda t: F.concat(lit("`"), t, lit("`"))), " ")
    head = F.concat(lit("> [!abstract] Summary\n> "), summary, F.when(F.size(tags) > 0, F.concat(lit("\n> **Tags:** "), ticked)).otherwise(""))
    return F.concat_ws(
        "\n\n",
        head,
        _listing("question", "Questions Asked", questions, True),
        _listing("list", "Topics Covered", topics),
        _listing("tip", "Key Takeaways", takeaways),
        _listing("link", "References", links),
    )


def key_info_block(summary: Column, tags: Column, points: Column, links: Column) -> Column:
    ticked = F.array_join(F.transform(tags, lambda t: F.concat(lit("`"), t, lit("`"))), " ")
    head = F.concat(lit("> [!abstract] Summary\n> "), summary, F.when(F.size(tags) > 0, F.concat(lit("\n> **Tags:** "), ticked)).otherwise(""))
    return F.concat_ws("\n\n", head, _listing("note", "Key Points", points), _listing("link", "References", links))


# --- index


def index_body(conv_title: Column, source: str, date: Column) -> list[Column]:
    """Aggregates over the segments (seg_no, name, title, summary, tags, n_messages) of a conversation."""
    ticked = F.array_join(F.transform("tags", lambda t: F.concat(lit("`"), t, lit("`"))), ", ")
    row = F.concat(lit("| "), F.col("seg_no").cast("string"), lit(" | [["), F.col("name"), lit("]] | "), F.col("n_messages").cast("string"), lit(" | "), ticked, lit(" |"))
    part = F.concat(lit("### "), F.col("seg_no").cast("string"), lit(". [["), F.col("name"), lit("|"), F.col("title"), lit("]]\n"), F.col("summary"))
    head = F.concat(lit("# "), conv_title, lit(f"\n\n> [!info] Import Summary\n> **Source:** {source} | **Date:** "), date, lit(" | **Topics:** "), F.count("*").cast("string"), lit(" | **Messages:** "), F.sum("n_messages").cast("string"))
    table = F.concat(lit("| # | Topic | Messages | Tags |\n|---|-------|----------|------|\n"), ordered("seg_no", row, NL))
    return [F.concat_ws(NL, head, lit(""), lit("## Topics"), lit(""), table, lit(""), lit("## Segment Summaries"), lit(""), ordered("seg_no", part, "\n\n")).alias("body")]


# --- whole notes


def described_segments(messages: DataFrame, settings: Settings) -> DataFrame:
    """Everything a note shows of its segment, from one gathering of the segment's messages."""
    rows = S.assigned(messages, S.segments(messages, settings.granularity), lambda both: titles.spread(both, "conv_id"))
    extra = [c for c in ("ts", "blocks", "n_words") if c in messages.columns]
    is_doc = F.coalesce(F.max(F.col("content_type") == "document"), F.lit(False)) if "content_type" in messages.columns else F.lit(False)
    groups = rows.groupBy("conv_id", "seg_no").agg(F.array_sort(F.collect_list(F.struct("index", "role", "text", *extra))).alias("all"), is_doc.alias("doc"))
    first = lambda role: F.get(F.filter("all", lambda m: m["role"] == role), 0)["text"]
    urls = F.array_distinct(F.transform(F.flatten(F.transform("all", lambda m: T.links(m["text"]))), T.clean_url))
    shown = F.filter("all", lambda m: ~m["role"].isin("system", "tool"))
    body = lambda style: F.array_join(F.transform(shown, lambda m: shown_message(m.__getitem__, extra, style, settings.collapse_threshold, settings.show_timestamps)), "\n\n")
    text = F.when(F.col("doc"), body("plain")).otherwise(body(settings.speaker_style)) if "content_type" in messages.columns else body(settings.speaker_style)
    plain = F.transform("all", lambda m: F.struct(m["index"].alias("index"), m["role"].alias("role"), m["text"].alias("text")))
    groups = groups.select("conv_id", "seg_no", plain.alias("messages"), F.size("all").cast("long").alias("n_messages"), first("user").alias("first_user"), first("assistant").alias("first_assistant"), F.transform(urls, T.url_link).alias("links"), text.alias("body"))
    return titles.described_groups(groups, (*titles.LISTS, "weights"))


def notes(messages: DataFrame, conversations: DataFrame, settings: Settings, summary) -> DataFrame:
    """path, filename, content, conv_id, seg_no, is_index for (conv_id, title, source, content_type).

    Messages may have ``ts`` (for gaps and time labels), ``blocks``, ``content_type`` (document: its own
    weights, plain style) and ``n_words`` (their number, counted once for all uses); conversations may have ``created_at`` (epoch seconds), their date.  Every note
    links both its neighbours in front matter and footer."""
    segs = described_segments(messages, settings)
    segs = cut(segs.withColumn("summary", summary(F.col("first_user"), F.col("first_assistant"))))
    date = F.coalesce(utc_date(F.col("created_at")), lit(settings.date)) if "created_at" in conversations.columns else lit(settings.date)
    c = conversations.select("conv_id", F.col("title").alias("conv_title"), "source", (F.col("content_type") == "document").alias("is_doc"), date.alias("conv_date"))
    date = F.col("conv_date")
    names = titles.entities_of_parts(segs, "conv_id", "seg_no").select("conv_id", F.array_join(F.slice("entities", 1, 3), " ").alias("about"))
    c = c.join(names, "conv_id").withColumn("index_topic", F.when(F.col("about") == "", "Index").otherwise(F.concat(F.col("about"), lit(" Index"))))
    total = segs.groupBy("conv_id").agg(F.count("*").alias("total"))
    base = {"date": date, "conversation_title": F.col("conv_title"), "source": F.col("source"), "segment_total": F.col("total").cast("string")}
    template = lit(settings.naming_template)
    name = lambda extra: T.sanitize_filename(T.render_template(template, {**base, **extra}))
    head = cut(c.join(total, "conv_id").withColumn("index_name", name({"topic": F.col("index_topic")})))
    folder = F.concat(lit(settings.target_folder + "/"), T.sanitize_filename(F.col("conv_title"))) if settings.folder_structure == "nested" else lit(settings.target_folder)
    rows = nav_links(segs.join(head, "conv_id").withColumn("name", name({"topic": F.col("title"), "segment": F.col("seg_no").cast("string")})))
    front = lambda css, own, tags, n, links: frontmatter(
        [("cssclasses", F.concat(lit("["), css, lit("]"))), ("source", F.col("source")), ("conversation_id", T.escape_yaml(F.col("conv_id").cast("string"))), ("conversation_title", T.escape_yaml(F.col("conv_title"))), *own, ("date", date), ("date_imported", lit(settings.imported)), ("tags", F.concat(lit("["), F.array_join(tags, ", "), lit("]"))), ("message_count", n), *links],
        settings.custom_frontmatter,
    )
    kind = lambda a, b: F.when(F.col("is_doc"), a).otherwise(b)
    fm = front(kind("document-segment", "chat-segment"), [("segment", F.col("seg_no")), ("segment_total", F.col("total")), ("topic", T.escape_yaml(F.col("title")))], F.concat(F.array(lit(settings.tag_prefix)), F.col("tags")), F.col("n_messages"), [("prev", link(F.col("prev_name"))), ("next", link(F.col("next_name"))), ("parent", link(F.col("index_name")))])
    info = F.concat(lit("# "), F.col("title"), lit("\n\n> [!info] "), kind("Section", "Segment"), lit(" "), F.col("seg_no").cast("string"), lit(" of "), F.col("total").cast("string"), lit(" from [["), F.col("index_name"), lit("]]\n> **Source:** "), F.col("source"), lit(" | **Date:** "), date, lit(" | **"), kind("Sections", "Messages"), lit(":** "), F.col("n_messages").cast("string"))
    block = summary_block(F.col("summary"), F.col("tags"), F.col("questions"), F.col("topics"), F.col("takeaways"), F.col("links"))
    content = F.concat_ws(NL, fm, lit(""), info, lit(""), block, lit(""), lit("---"), lit(""), F.coalesce(F.col("body"), lit("")), lit(""), footer(F.col("prev_name"), F.col("index_name"), F.col("next_name")))
    out = rows.select("conv_id", F.col("seg_no").cast("int").alias("seg_no"), F.concat(folder, lit("/"), F.col("name"), lit(".md")).alias("path"), F.col("name").alias("filename"), content.alias("content"), F.lit(False).alias("is_index"))
    count = messages.groupBy("conv_id").agg(F.count("*").alias("count"))
    if settings.keep_full_transcript:
        t = message_text(messages, ["conv_id"], settings.speaker_style, settings.collapse_threshold, settings.show_timestamps).join(head, "conv_id").join(count, "conv_id").withColumn("name", name({"topic": lit("Full Transcript")}))
        tf = front(kind("document-transcript", "chat-transcript"), [], F.array(lit(settings.tag_prefix)), F.col("count"), [("parent", link(F.col("index_name")))])
        text = F.concat_ws(NL, tf, lit(""), F.concat(lit("# "), F.col("conv_title"), lit(" - Full Transcript")), lit(""), F.concat(lit("> [!info] Full transcript from [["), F.col("index_name"), lit("]]\n> **Source:** "), F.col("source"), lit(" | **Date:** "), date, lit(" | **Messages:** "), F.col("count").cast("string")), lit(""), lit("---"), lit(""), F.col("body"))
        out = out.unionByName(t.select("conv_id", F.lit(None).cast("int").alias("seg_no"), F.concat(folder, lit("/"), F.col("name"), lit(".md")).alias("path"), F.col("name").alias("filename"), text.alias("content"), F.lit(False).alias("is_index")))
    grouped = rows.groupBy("conv_id", "conv_title", "source", "is_doc", "index_name", "conv_date").agg(*index_body(F.col("conv_title"), "", date)).join(count, "conv_id")
    grouped = grouped.withColumn("body", F.replace(F.col("body"), lit("> **Source:**  |"), F.concat(lit("> **Source:** "), F.col("source"), lit(" |"))))
    xf = front(lit("chat-index"), [], F.array(lit(settings.tag_prefix)), F.col("count"), [])
    tail = F.concat(lit("\n\n## Full Transcript\n\n[["), name({"topic": lit("Full Transcript")}), lit("]]")) if settings.keep_full_transcript else lit("")
    grouped = grouped.join(total, "conv_id")
    index = grouped.select("conv_id", F.lit(None).cast("int").alias("seg_no"), F.concat(folder, lit("/"), F.col("index_name"), lit(".md")).alias("path"), F.col("index_name").alias("filename"), F.concat(xf, lit("\n\n"), F.col("body"), tail).alias("content"), F.lit(True).alias("is_index"))
    return out.unionByName(index)
