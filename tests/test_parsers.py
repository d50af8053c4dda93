from __future__ import annotations

import io
import json
import zipfile

import pytest
from strandline.config import Settings
from strandline.operators import titles as X
from strandline.plans.parsing import FLAT, INPUTS, TREE
from strandline.sources import parse as P
from strandline.sources import scan, sink


def turns(text, override=None):
    return [p.turns for p in P.parse(text, override)][0]


def test_labels_in_code_are_no_turns():
    assert turns(INPUTS[2][1]) == [("user", "how are you"), ("assistant", "fine\n```\nYou said:\n```"), ("user", "bye"), ("assistant", "bye")]


def test_style_b_keeps_the_rest_of_the_line():
    assert turns("Human: hi\nthere\nAssistant: hello\nHuman:\nbye") == [("user", "hi\nthere"), ("assistant", "hello"), ("user", "bye")]


def test_sections_end_with_the_next_question():
    assert turns(INPUTS[4][1]) == [("user", "first question"), ("assistant", "Answer one.\n\n- list"), ("user", "next question"), ("assistant", "Answer two")]
    assert turns(INPUTS[5][1]) == [("user", "ask this"), ("assistant", "Answer here\n\n**bold** part"), ("user", "and what now?"), ("assistant", "last")]


def test_section_that_is_all_question_like_is_an_answer():
    assert turns("q\nJan 5\nplain\n\nmore\nFeb 6\nend") == [("user", "q"), ("assistant", "plain\n\nmore"), ("assistant", "end")]


def test_markdown_documents():
    (p,) = P.parse(INPUTS[7][1])
    assert p.content_type == "document" and len(p.turns) == 2
    (p,) = P.parse(INPUTS[8][1])
    assert p.content_type == "document" and len(p.turns) == 2  # the last group is short of ten words
    (p,) = P.parse("short note")
    assert p.content_type == "chat" and p.turns == [("user", "short note")] and p.warnings
    assert P._title(P.parse('---\ntitle: "T"\n---\nx')[0]) == "T"
    assert P._title(P.Parsed(turns=[("user", "x" * 60)])) == "x" * 50 + "..."
    assert P._title(P.Parsed(turns=[("assistant", "x")])) == "Untitled Chat"


def test_override():
    assert P.parse("short note", "claude")[0].source == "claude"
    assert P.parse(INPUTS[7][1], "chatgpt")[0].content_type == "chat"
    assert P.parse(json.dumps(FLAT), "chatgpt")[0].source == "claude"  # exports ignore it
    with pytest.raises(ValueError, match="No content"):
        P.parse("  \n")


def test_tree_export():
    one, two = P.parse(json.dumps(TREE))
    assert one.turns == [("user", "Hello there"), ("assistant", "print(1)"), ("user", "see image")]
    assert one.blocks[2][0] == {"type": "image", "alt_text": "Image"}
    assert two.turns == [("user", "only text")] and two.warnings == ["No current_node found; walking all nodes"]
    assert P.list_conversations(json.dumps(TREE)) == [("c1", "Tree", 5), ("c2", "Untitled", 2)]
    loop = {"a": {"parent": "b"}, "b": {"parent": "a"}}
    assert len(P.branch(loop, "a")[0]) == 2


def test_flat_export():
    (p,) = P.parse(json.dumps(FLAT))
    assert p.turns == [("user", "Question one?"), ("assistant", "Answer")] and p.title == "Flat" and len(p.warnings) == 1
    assert [b["type"] for b in p.blocks[1]] == ["thinking", "text"]


def test_content_blocks():
    assert P.content_blocks("plain") == [{"type": "text", "content": "plain"}]
    got = P.content_blocks("a\n```py\nx\n```\nb")
    assert [b["type"] for b in got] == ["text", "code", "text"] and got[1]["language"] == "py"


def test_zip_entry():
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("a.json", "1")
        z.writestr("x/conversations.json", "2")
    assert scan.unzip(data.getvalue()) == ("x/conversations.json", "2")
    assert scan.chosen_entry(["b.txt", "a.json"]) == "a.json"
    with pytest.raises(ValueError):
        scan.chosen_entry(["b.txt"])


def test_titles_and_lists():
    assert X.title([("user", "Postgres vs MySQL for analytics?")]) == "Postgres vs Mysql for Analytics"
    assert X.title([]) == "Untitled Topic"
    assert X.entities([("user", "i like Antigua, Barbados and New York City")]) == ["Antigua", "Barbados", "York"]
    assert X.questions([("user", "Can you explain how vector indexes work? thanks")]) == ["explain how vector indexes work"]
    four = [("user", "python"), ("assistant", "python"), ("user", "x"), ("assistant", "y")]
    assert X.tags(four) == ["ai-chat/coding", "ai-chat/coding/python"] and X.tags(four[:3]) == ["ai-chat"]
    assert X.topics([("assistant", "## Short\n## A heading long enough to be kept")]) == ["A heading long enough to be kept"]
    assert X.takeaways([("assistant", "I recommend the blue option because it lasts. Unrelated words follow here.")]) == ["I recommend the blue option because it lasts."]
    assert X.fuzzy_match("carriibbean", "caribbean") and not X.fuzzy_match("cat", "dog")
    assert X.topic_kernel("Can you please tell me about the best beaches?") == "best beaches"


def test_distinct_items_by_containment():
    d = X.Distinct(3)
    for item in ("How to cook rice", "how to cook", "Something else", "???", "Third one", "Fourth"):
        d.add(item)
    assert d.items == ["How to cook rice", "Something else", "Third one"]


def test_settings():
    s = Settings.loads('{"speaker_style": "bold", "unknown": 1}')
    assert s.speaker_style == "bold" and Settings.loads(s.dumps()) == s and Settings.loads(None) == Settings()
    with pytest.raises(ValueError):
        Settings(speaker_style="x")


def test_files_are_written(spark, tmp_path):
    df = spark.createDataFrame([("a/b.md", "x\ny"), ("c.md", "z")], "path string, content string")
    assert sorted((r.path, r["size"]) for r in sink.write_files(df, str(tmp_path)).collect()) == [("a/b.md", 3), ("c.md", 1)]
    assert (tmp_path / "a/b.md").read_text() == "x\ny"
    assert sorted(r.content for r in scan.text_files(spark, f"file://{tmp_path}/a").collect()) == ["x\ny"]


def test_notes_of_a_conversation(spark):
    from strandline.operators import render
    from strandline.plans.documents import segment_summary
    from strandline.plans.notes import conversations

    rows = [(1, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(["What is HNSW?", "HNSW is a graph index. See https://www.example.com/?utm_source=a&x=1).", "thanks", "welcome"])]
    msgs = spark.createDataFrame(rows, "conv_id bigint, index int, role string, text string")
    settings = Settings(keep_full_transcript=True, custom_frontmatter="status: new")
    got = {("index" if r.is_index else r.seg_no): r for r in render.notes(msgs, conversations(msgs), settings, segment_summary).collect()}
    note = got[1].content
    assert note.startswith("---\ncssclasses: [chat-segment]\nsource: chat\nconversation_id: 1\n") and "\nstatus: new\n---\n" in note
    assert "> - [example.com](https://www.example.com/?x=1)" in note and "> [!user] User\n> What is HNSW?" in note
    assert "Back to Index]]" in note and got["index"].content.count("| 1 | [[") == 1 and "## Full Transcript" in got["index"].content
    assert got[None].filename == "Full Transcript" and "Conversation 1 - Full Transcript" in got[None].content


def test_session_stream(spark, tmp_path):
    from strandline.streaming.sessions import event_stream, sessions

    at = f"file://{tmp_path}/events"
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:20:00"), (1, "2024-01-01 02:00:00"), (2, "2024-01-01 00:00:00"), (2, "2024-01-03 00:00:00")]
    df = spark.createDataFrame(rows, "user_id bigint, t string").selectExpr("user_id", "to_timestamp(t) ts")
    df.write.parquet(at)
    q = sessions(event_stream(spark, at, df.schema)).writeStream.format("memory").queryName("s").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.user_id, r.n_events) for r in spark.table("s").collect()) == [(1, 1), (1, 2), (2, 1)]  # the last session is still open
