"""Parsers of raw inputs into conversations and messages.

Every parser turns one text into turns (role, text).  Inputs are independent of each other, so they
are mapped over Arrow batches, one row an input; format detection is a column expression.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.dialect import Rx, any_py, trim, trim_py

Turn = tuple[str, str]


# --- format detection, as a column


def masked(c: Column) -> Column:
    """Text whose fenced code is taken out."""
    return F.regexp_replace(c, R.FENCE.java, "__CODE__")


def _any_line(c: Column, p: Rx) -> Column:
    return F.exists(F.split(c, "\n"), lambda x: p.test(trim(x)))


def detect_format(c: Column) -> Column:
    """chatgpt_json, claude_json, chatgpt_paste, claude_paste, claude_web, chatgpt_thought or markdown."""
    t = trim(c)
    v = F.try_parse_json(t)
    kind = F.schema_of_variant(v)
    probe = lambda path: F.try_variant_get(v, path, "variant")
    array = kind.startswith("ARRAY")
    has = lambda name, is_: F.coalesce(F.schema_of_variant(F.when(array, probe(f"$[0].{name}")).otherwise(probe(f"$.{name}"))).startswith(is_), F.lit(False))
    dates = F.size(F.filter(F.split(masked(t), "\n"), lambda x: R.DATE_STAMP.test(trim(x)))) >= 2
    json_kind = F.when(has("mapping", "OBJECT"), "chatgpt_json").when(has("chat_messages", "ARRAY"), "claude_json").otherwise("markdown")
    return (
        F.when(t.rlike(r"^[\{\[]"), F.coalesce(json_kind, F.lit("markdown")))
        .when(_any_line(t, R.USER_LABEL_A) & _any_line(t, R.REPLY_LABEL_A), "chatgpt_paste")
        .when(_any_line(t, R.USER_LABEL_B) & _any_line(t, R.REPLY_LABEL_B), "claude_paste")
        .when(~R.LABEL_B.test(t) & dates, "claude_web")
        .when(R.THOUGHT.test(t), "chatgpt_thought")
        .otherwise("markdown")
    )


# --- code


def mask(text: str) -> tuple[str, list[str]]:
    """Fenced code replaced by numbered marks, and the code."""
    blocks: list[str] = []

    def keep(m) -> str:
        blocks.append(m[0])
        return f"__CODE_BLOCK_{len(blocks) - 1}__"

    return R.FENCE.python.sub(keep, text), blocks


def unmask(text: str, blocks: list[str]) -> str:
    for i, b in enumerate(blocks):
        text = text.replace(f"__CODE_BLOCK_{i}__", b, 1)
    return text


def content_blocks(text: str) -> list[dict]:
    """Text and code blocks in order."""
    out, at = [], 0
    for m in R.BLOCK_FENCE.python.finditer(text):
        if before := trim_py(text[at : m.start()]):
            out.append({"type": "text", "content": before})
        out.append({"type": "code", "language": m[2], "content": Rx(r"\s+$").replace_py(m[3])})
        at = m.end()
    if at == 0 and not out:
        return [{"type": "text", "content": text}]
    if rest := trim_py(text[at:]):
        out.append({"type": "text", "content": rest})
    return out


# --- pasted chats


@dataclass
class Parsed:
    turns: list[Turn] = field(default_factory=list)
    source: str = "markdown"
    content_type: str = "chat"
    method: str = "paste"
    conv_id: str | None = None
    title: str | None = None
    created_at: float | None = None
    updated_at: float | None = None
    blocks: list[list[dict]] | None = None
    stamps: dict[int, float | None] = field(default_factory=dict)  # epoch seconds of turns that have a time
    meta: dict[int, dict] = field(default_factory=dict)  # model or attachments of turns
    warnings: list[str] = field(default_factory=list)

    def add(self, role: str, text: str, blocks: list[dict], stamp: float | None, meta: dict) -> None:
        self.stamps[len(self.turns)], self.meta[len(self.turns)] = stamp, meta
        self.turns.append((role, text))
        self.blocks.append(blocks)


def _filled(turns: list[Turn], code: list[str], out: Parsed) -> Parsed:
    """Keeps turns with text, their code put back."""
    for role, text in turns:
        if content := unmask(trim_py(text), code):
            out.turns.append((role, content))
        else:
            out.warnings.append(f"Empty {role} message at position {len(out.turns)} was skipped")
    return out


def _labelled(text: str, label: Callable[[str], tuple[str, str] | None], skip: Callable[[str, str], bool] | None = None) -> tuple[list[Turn], list[str]]:
    """Turns that begin at the lines for which ``label`` gives (role, rest of the line)."""
    body, code = mask(text)
    found: list[tuple[str, list[str]]] = []
    for line in body.split("\n"):
        if hit := label(line):
            found.append((hit[0], [hit[1]] if trim_py(hit[1]) else []))
        elif found and not (skip and not found[-1][1] and skip(found[-1][0], line)):
            found[-1][1].append(line)
    return [(role, "\n".join(lines)) for role, lines in found], code


def paste_a(text: str) -> Parsed:
    def label(line: str):
        line = trim_py(line)
        if R.USER_LABEL_A.test_py(line):
            return "user", ""
        return ("assistant", "") if R.REPLY_LABEL_A.test_py(line) else None

    turns, code = _labelled(text, label, lambda role, line: role == "assistant" and R.THOUGHT_LINE.test_py(trim_py(line)))
    turns = [(r, trim_py(R.THOUGHT_HEAD.replace_py(trim_py(t))) if r == "assistant" else t) for r, t in turns]
    return _filled(turns, code, Parsed(source="chatgpt"))


def paste_b(text: str) -> Parsed:
    def label(line: str):
        if m := R.LABEL_B_LINE.python.search(line):
            return ("user" if m[1].lower() == "human" else "assistant"), line[m.end() :]
        return None

    turns, code = _labelled(text, label)
    return _filled(turns, code, Parsed(source="claude"))


def _sectioned(text: str, mark: Callable[[str], bool], user_like: Callable[[str], bool], name: str, out: Parsed) -> Parsed:
    """Sections between marks hold an answer and, at their end, the next question: the longest run
    of final paragraphs that a user could have written, unless it is the whole section."""
    body, code = mask(text)
    lines = body.split("\n")
    marks = [i for i, x in enumerate(lines) if mark(x)]
    turns: list[Turn] = []
    if marks and (head := trim_py("\n".join(lines[: marks[0]]))):
        turns.append(("user", head))
    for i, end in zip(marks, [*marks[1:], len(lines)]):
        section = trim_py("\n".join(lines[i + 1 : end]))
        if not section:
            out.warnings.append(f"Empty section after {name} at line {i + 1} was skipped")
            continue
        parts = [p for p in Rx(r"\n\n+").python.split(section) if trim_py(p)]
        cut = len(parts)
        while cut and end != len(lines) and user_like(trim_py(parts[cut - 1])):
            cut -= 1
        if cut == 0 or end == len(lines):
            turns.append(("assistant", section))
        else:
            turns += [("assistant", "\n\n".join(parts[:cut]))] + [("user", "\n\n".join(parts[cut:]))] * (cut < len(parts))
    return _filled(turns, code, out)


def paste_thought(text: str) -> Parsed:
    return _sectioned(text, lambda x: R.THOUGHT_LINE.test_py(trim_py(x)), lambda p: not any_py(R.NOT_USER, p), '"Thought for"', Parsed(source="chatgpt"))


def paste_web(text: str) -> Parsed:
    return _sectioned(text, lambda x: R.DATE_STAMP.test_py(trim_py(x)), lambda p: len(p) <= R.USER_PARAGRAPH_MOST and not any_py(R.NOT_USER_SHORT, p), "date stamp", Parsed(source="claude"))


def can_a(text: str) -> bool:
    lines = [trim_py(x) for x in text.split("\n")]
    return (any(map(R.USER_LABEL_A.test_py, lines)) and any(map(R.REPLY_LABEL_A.test_py, lines))) or R.THOUGHT.test_py(text)


def can_b(text: str) -> bool:
    lines = [trim_py(x) for x in text.split("\n")]
    return any(map(R.USER_LABEL_B.test_py, lines)) and any(map(R.REPLY_LABEL_B.test_py, lines))


def can_web(text: str) -> bool:
    return not R.LABEL_B.test_py(text) and sum(R.DATE_STAMP.test_py(trim_py(x)) for x in mask(text)[0].split("\n")) >= 2


def _either_a(text: str) -> Parsed:
    lines = [trim_py(x) for x in text.split("\n")]
    return paste_a(text) if any(map(R.USER_LABEL_A.test_py, lines)) and any(map(R.REPLY_LABEL_A.test_py, lines)) else paste_thought(text)


# --- Markdown: speakers, else sections, else paragraph groups, else one message


def _words(text: str) -> int:
    return sum(1 for w in Rx(r"\s+").python.split(text) if w)


def front_title(text: str) -> str | None:
    body = R.FRONT_MATTER_BODY.python.match(text)
    found = R.FRONT_TITLE.python.search(body[1]) if body else None
    return Rx(r"^[\"']|[\"']$").replace_py(trim_py(found[1])) if found else None


def markdown(text: str) -> Parsed:
    body, code = mask(text)
    out = Parsed(title=front_title(text))
    for pattern, user in R.MARKDOWN_SPEAKERS:
        if pattern.test_py(body):

            def label(line: str, p=pattern, u=user):
                m = p.python.match(line)
                return (("user" if m[1].lower() == u else "assistant"), line[m.end() :]) if m else None

            turns, code = _labelled(text, label)
            return _filled(turns, code, out)
    body = R.FRONT_MATTER.replace_py(body)
    heads = [i for i, x in enumerate(body.split("\n")) if R.SECTION.test_py(x)]
    for kind in ("sections", "groups"):
        if kind == "sections":
            lines = body.split("\n")
            edges = sorted({0, *heads, len(lines)})
            parts = ["\n".join(lines[a:b]) for a, b in zip(edges, edges[1:])] if heads else []
        else:
            paras = [p for p in map(trim_py, Rx(r"\n{2,}").python.split(body)) if p]
            parts = ["\n\n".join(paras[i : i + 3]) for i in range(0, len(paras), 3)] if len(paras) >= 4 else []
        kept = [t for t in (unmask(trim_py(p), code) for p in parts) if _words(t) >= 10]
        if len(kept) >= 2:
            out.turns, out.content_type = [("user", t) for t in kept], "document"
            return out
    out.warnings.append("No speaker pattern detected. Treating entire input as a single message.")
    out.turns = [("user", trim_py(text))]
    return out


# --- JSON exports


def branch(mapping: dict, leaf: str | None) -> tuple[list[dict], bool]:
    """Nodes from the root to ``leaf`` (a cycle ends the walk); all nodes with a message without one."""
    if not leaf or leaf not in mapping:
        digits = sorted((k for k in mapping if k.isdigit() and str(int(k)) == k), key=int)
        order = digits + [k for k in mapping if k not in set(digits)]
        return [mapping[k] for k in order if mapping[k].get("message")], False
    path, seen = [], set()
    while leaf and leaf in mapping and leaf not in seen:
        seen.add(leaf)
        path.append(mapping[leaf])
        leaf = mapping[leaf].get("parent")
    return path[::-1], True


def _tree_blocks(message: dict) -> list[dict]:
    content = message.get("content") or {}
    parts = content.get("parts")
    if parts is None:
        return [{"type": "text", "content": content["text"]}] if content.get("text") else []
    kind = "code" if content.get("content_type") == "code" else "text"
    out = []
    for p in parts:
        if isinstance(p, str):
            out.append({"type": kind, "content": p, **({"language": ""} if kind == "code" else {})})
        elif isinstance(p, dict):
            if p.get("content_type") == "image_asset_pointer" or p.get("asset_pointer"):
                out.append({"type": "image", "alt_text": (((p.get("metadata") or {}).get("dalle") or {}).get("prompt")) or "Image"})
            else:
                out.append({"type": "text", "content": json.dumps(p, separators=(",", ":"), ensure_ascii=False)})
    return out


def _seconds(stamp) -> float | None:
    """Epoch seconds of a number or an ISO date; dates without a zone and what cannot be read count as UTC
    and as none."""
    if isinstance(stamp, (int, float)) and not isinstance(stamp, bool):
        return float(stamp) or None
    if not isinstance(stamp, str):
        return None
    try:
        at = datetime.fromisoformat(stamp)
    except ValueError:
        return None
    return (at if at.tzinfo else at.replace(tzinfo=timezone.utc)).timestamp()


def tree_export(conv: dict) -> Parsed:
    out = Parsed(source="chatgpt", method="file-json", conv_id=conv.get("id"), title=conv.get("title") or None, created_at=_seconds(conv.get("create_time")), updated_at=_seconds(conv.get("update_time")), blocks=[])
    nodes, found = branch(conv.get("mapping") or {}, conv.get("current_node"))
    if not found:
        out.warnings.append("No current_node found; walking all nodes")
    for node in nodes:
        message = node.get("message") or {}
        role = (message.get("author") or {}).get("role")
        if role in ("user", "assistant"):
            blocks = _tree_blocks(message)
            text = "\n".join(b["content"] for b in blocks if b["type"] in ("text", "code"))
            if trim_py(text):
                model = (message.get("metadata") or {}).get("model_slug")
                out.add(role, text, blocks, _seconds(message.get("create_time")), {"model": model} if model else {})
            else:
                out.warnings.append(f"Empty {role} message at node {node.get('id')} was skipped")
    return out


def _attachments(message: dict) -> dict:
    found = message.get("attachments")
    if not isinstance(found, list):
        return {}
    return {"attachments": [{"name": a.get("file_name") or a.get("name") or "attachment", "mimeType": a.get("file_type"), "size": a.get("file_size")} for a in found if isinstance(a, dict)]}


def flat_export(conv: dict) -> Parsed:
    out = Parsed(source="claude", method="file-json", conv_id=conv.get("uuid") or conv.get("id") or None, title=conv.get("name") or conv.get("title") or "Untitled Chat", created_at=_seconds(conv.get("created_at")), updated_at=_seconds(conv.get("updated_at")), blocks=[])
    for message in conv.get("chat_messages") or []:
        role = {"human": "user", "assistant": "assistant"}.get(message.get("sender"))
        if role is None:
            continue
        content = message.get("content") if isinstance(message.get("content"), list) else []
        blocks = [{"type": b["type"], "content": b.get("text" if b["type"] == "text" else "thinking") or ""} for b in content if b.get("type") in ("text", "thinking")]
        if not blocks and message.get("text"):
            blocks = [{"type": "text", "content": message["text"]}]
        text = message.get("text") or "\n".join(b["content"] for b in blocks if b["type"] == "text")
        if trim_py(text):
            out.add(role, text, blocks, _seconds(message.get("created_at")), _attachments(message))
        else:
            out.warnings.append(f"Empty {role} message at index {len(out.turns)} was skipped")
    return out


def list_conversations(text: str) -> list[tuple[str, str, int]]:
    data = json.loads(text)
    return [(c.get("id") or "", c.get("title") or "Untitled", len(c.get("mapping") or {})) for c in (data if isinstance(data, list) else [data])]


# --- dispatch


def _json(text: str) -> list[Parsed] | None:
    if not text[:1] in "{[" or not text:
        return None
    try:
        data = json.loads(text)
    except ValueError:
        return None
    convs = data if isinstance(data, list) else [data]
    if convs and isinstance(convs[0], dict):
        if isinstance(convs[0].get("mapping"), dict) and convs[0]["mapping"]:
            return [tree_export(c) for c in convs]
        if isinstance(convs[0].get("chat_messages"), list):
            return [flat_export(c) for c in convs]
    return None


PASTES = ((can_a, _either_a), (can_b, paste_b), (can_web, paste_web))


def parse(text: str, override: str | None = None) -> list[Parsed]:
    """All conversations of one input.  JSON exports ignore the override."""
    if not trim_py(text):
        raise ValueError("No content to analyze")
    if (found := _json(trim_py(text))) is not None:
        return found
    if override:
        tried = {"chatgpt": PASTES[:1], "claude": PASTES[1:]}.get(override, ())
        for can, run in tried:
            if can(text):
                return [run(text)]
        out = markdown(text)
        if override in ("chatgpt", "claude"):
            out.source, out.content_type = override, "chat"
        return [out]
    return [next((run for can, run in PASTES if can(text)), markdown)(text)]


MESSAGES = "input_id bigint, conv_no int, conv_id string, title string, source string, content_type string, input_method string, created_at double, updated_at double, index int, role string, text string, ts double, blocks string, metadata string, warnings string"


def _title(parsed: Parsed) -> str:
    if parsed.title:
        return parsed.title
    first = next((t for r, t in parsed.turns if r == "user"), None)
    return "Untitled Chat" if first is None else first[:50] + "..." * (len(first) > 50)


def parsed_messages(inputs: DataFrame, whole_blocks: bool = True) -> DataFrame:
    """One row a message of every conversation of (input_id, content, override).

    Without ``whole_blocks`` the blocks are null where one block holds just the text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.rpartition(" ")[0] for x in MESSAGES.split(", ")]
        for b in batches:
            rows = []
            for key, content, override in zip(b["input_id"], b["content"], b["override"]):
                if content is None or not trim_py(content):
                    continue
                for no, p in enumerate(parse(content, override)):
                    conv = p.conv_id or hashlib.sha256(f"{no}|{content}".encode()).hexdigest()[:16]
                    for i, (role, text) in enumerate(p.turns):
                        blocks = p.blocks[i] if p.blocks is not None else content_blocks(text)
                        ts, meta = p.stamps.get(i), p.meta.get(i, {})
                        shown = None if not whole_blocks and blocks == [{"type": "text", "content": text}] else json.dumps(blocks, ensure_ascii=False)
                        rows.append((key, no, conv, _title(p), p.source, p.content_type, p.method, p.created_at, p.updated_at, i, role, text, ts, shown, json.dumps(meta, ensure_ascii=False), "; ".join(p.warnings)))
            yield pd.DataFrame(rows, columns=names)

    return inputs.select("input_id", "content", "override").mapInPandas(run, MESSAGES)
