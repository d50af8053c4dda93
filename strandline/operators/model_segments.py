"""Optional segmentation by a language model, with the scored segmentation as fallback.

A conversation is cut into overlapping chunks, each prompt is answered by ``generate`` (injected,
so tests need no network), the replies are parsed and checked, and a conversation with any failure
is segmented by scores instead.
"""

from __future__ import annotations

import json
import re
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..sources.shared import cut
from . import segments as S


class ModelClient:
    """A local model server over HTTP."""

    def __init__(self, endpoint: str, model: str, timeout: float = 120.0):
        self.endpoint, self.model, self.timeout = endpoint.rstrip("/"), model, timeout

    def _call(self, path: str, body: dict | None = None, timeout: float | None = None) -> dict:
        data = None if body is None else json.dumps(body).encode()
        request = urllib.request.Request(self.endpoint + path, data, {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=timeout or self.timeout) as r:
            return json.loads(r.read())

    def healthy(self) -> bool:
        try:
            self._call("/api/tags", timeout=5)
        except OSError:
            return False
        return True

    def models(self) -> list[str]:
        return [m["name"] for m in self._call("/api/tags").get("models", [])]

    def __call__(self, prompt: str) -> str:
        return self._call("/api/generate", {"model": self.model, "prompt": prompt, "stream": False})["response"]


def prompt(messages: list[tuple[int, str, str]], granularity: str) -> str:
    lines = [f"[{i}] {role}: {text[:200]}".replace("\n", " ") for i, role, text in messages]
    head = R.PROMPT_HEAD.replace("{granularity}", granularity).replace("{hint}", R.GRANULARITY_HINTS[granularity])
    return head + "\n".join(lines) + R.PROMPT_TAIL


def reply(text: str) -> list[dict]:
    """Segments of a reply; raises when it holds no array."""
    found = re.search(r"\[[\s\S]*\]", text)
    if not found:
        raise ValueError("no JSON array in the reply")
    return [{"start": int(x["startIndex"]), "end": int(x["endIndex"]), "title": (x.get("title") or "Untitled")[:50], "summary": x.get("summary") or "", "confidence": x.get("confidence", 0.5)} for x in json.loads(found[0])]


def checked(parts: list[dict], n: int) -> list[dict]:
    """First segment of each start in order; the whole answer fails on any bad index."""
    first: dict[int, dict] = {}
    for p in parts:
        if 0 <= p["start"] < n and 0 <= p["end"] < n:
            first.setdefault(p["start"], p)
    out = [first[k] for k in sorted(first)]
    if not out or any(p["start"] > p["end"] for p in out):
        raise ValueError("the reply has no valid segments")
    return out


def segmented(messages: DataFrame, generate: Callable[[str], str], granularity: str = "medium", target: int = 12_000) -> DataFrame:
    """conv_id, seg_no, start_index, end_index, confidence, title, summary, method."""
    rows = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("index", "role", "text"))).alias("m"))
    walks = S.chunks(messages, target).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("chunk_no", "start_index", "end_index"))).alias("walk"))
    schema = "conv_id bigint, seg_no int, start_index int, end_index int, confidence double, title string, summary string, method string"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for conv, m, walk in zip(b["conv_id"], b["m"], b["walk"]):
                try:
                    parts = []
                    for w in walk:
                        part = [(x["index"], x["role"], x["text"]) for x in m[w["start_index"] : w["end_index"] + 1]]
                        parts += reply(generate(prompt(part, granularity)))
                    out += [(conv, i + 1, p["start"], p["end"], float(p["confidence"]), p["title"], p["summary"], "model") for i, p in enumerate(checked(parts, len(m)))]
                except Exception:  # any failure of the model hands the conversation to the scores
                    out.append((conv, None, None, None, None, None, None, "failed"))
            yield pd.DataFrame(out, columns=names).astype({"seg_no": "Int32", "start_index": "Int32", "end_index": "Int32"})

    answered = cut(rows.join(walks, "conv_id").mapInPandas(run, schema))  # the model is asked once
    failed = answered.filter("method = 'failed'").select("conv_id")
    scored = S.segments(messages.join(failed, "conv_id", "left_semi"), granularity).select("conv_id", "seg_no", "start_index", "end_index", "confidence", F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("summary"), F.lit("heuristic").alias("method"))
    return answered.filter("method = 'model'").unionByName(scored)
