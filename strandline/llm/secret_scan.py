"""Secret scans: fixed patterns and character Markov models.

Three base kinds are found by pattern (assigned values, access keys, long hexadecimal runs).
Beyond them, every run of 12 or more letters of the base-64 alphabet (the length from which the
bounds are calibrated) is scored by two order-2 character models, one of random strings and one
of ordinary identifiers; a run whose log-likelihood ratio passes both a total and a rate becomes
a span of kind ``random``.

The models are trained from labelled samples: random strings (base hits of the sample and
generated ones) against identifiers (words of the sample outside base hits, alone and joined
as identifiers are).  Runs of fewer than 20 letters have models of their own, whose identifiers
also hold generated numbers, dates, paths and rules: what is that short is mostly of these.  The sample is bounded: about ``sample_rows`` documents chosen by a
digest, ``sample_chars`` letters of each.  Scanning itself reads every whole text.

Null and empty texts have no spans; positions count code points, ends are exclusive.  Very long texts
are scanned whole, one at a time.  Spans that begin at one place (ties) stand in the order of the
kinds; overlapping spans are redacted as one.  Repeated rows and equal texts get equal results; an empty
table gives an empty result, its models come from generated strings alone.  Other columns may have any
names: ``cleaned`` keeps them all, ``scanned`` reads none.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_list, tidy

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
SHORTEST, LONG = 12, 20  # letters of a run that is scored, and from which it is more than a number
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}" % SHORTEST)
KINDS = ("assign", "access", "hex", "random")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_CODE = np.full(128, len(ALPHABET), dtype=np.int64)
_CODE[np.frombuffer(ALPHABET.encode(), dtype=np.uint8)] = np.arange(len(ALPHABET))
SIZE = len(ALPHABET) + 1  # the last code stands for anything else and for the start

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Hits of the three patterns in order of start, then kind."""
    out: list[Span] = []
    if any(k in (low := text.lower()) for k in ("pass", "secret", "token", "api")):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if long_word(text, 24):
        out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def long_word(text: str, n: int) -> bool:
    return max(map(len, text.split()), default=0) >= n


def codes(s: str) -> np.ndarray:
    x = np.frombuffer(s.encode("ascii", "replace"), dtype=np.uint8)
    return np.concatenate([[SIZE - 1, SIZE - 1], _CODE[np.minimum(x, 127)]])


@dataclass(frozen=True)
class Models:
    """Per-letter log ratio of the two models, and the two bounds a secret passes.

    Runs of fewer than ``LONG`` letters are left to ``brief``, if there is one."""

    ratio: np.ndarray
    total: float
    rate: float
    brief: Models | None = None

    def score(self, s: str) -> tuple[float, float]:
        c = codes(s)
        r = float(self.ratio[c[:-2], c[1:-1], c[2:]].sum())
        return r, r / max(1, len(s))

    def secret(self, s: str) -> bool:
        if self.brief is not None and len(s) < LONG:
            return self.brief.secret(s)
        total, rate = self.score(s)
        return total >= self.total and rate >= self.rate


def _model(sample: list[str], backing: float = 8.0) -> np.ndarray:
    """log P(letter | two before), each order smoothed with the one below."""
    n = np.zeros((SIZE, SIZE, SIZE))
    for s in sample:
        c = codes(s)
        np.add.at(n, (c[:-2], c[1:-1], c[2:]), 1)
    one = n.sum((0, 1)) + 0.5
    one /= one.sum()
    two = n.sum(0) + backing * one
    two /= two.sum(-1, keepdims=True)
    three = n + backing * two
    return np.log(three / three.sum(-1, keepdims=True))


def _trained(random_strings: list[str], identifiers: list[str], false_rate: float) -> Models:
    ratio = _model(random_strings) - _model(identifiers)
    first = Models(ratio, 0.0, 0.0)
    long = [first.score(s) for s in identifiers if len(s) >= SHORTEST] or [(0.0, 0.0)]
    rate = max(0.35, float(np.quantile([r for _, r in long], 1 - false_rate)) + 0.1)
    total = max(12.0, float(np.quantile([t for t, _ in long], 1 - false_rate)))
    return Models(ratio, total, rate)


def train(random_strings: list[str], identifiers: list[str], false_rate: float = 1e-4) -> Models:
    """Both models, and bounds that at most ``false_rate`` of the identifiers pass; then the
    same for short runs, with numbers among the identifiers."""
    names = [s for s in identifiers if s.isalpha()] or ["name"]
    brief = _trained(random_strings, identifiers + numbers(random.Random(11), names), false_rate)
    return replace(_trained(random_strings, identifiers, false_rate), brief=brief)


def numbers(rng: random.Random, names: list[str], made: int = 4_000) -> list[str]:
    """Clean runs that hold digits or marks: numbers, cards, telephones, times, paths, rules."""

    def digits(n: int) -> str:
        return "".join(rng.choices("0123456789", k=n))

    def time() -> str:
        return f"{rng.randint(1970, 2039)}{(d := rng.choice(('-', '/', '_', '')))}{rng.randint(1, 12):02}{d}{rng.randint(1, 28):02}{rng.choice(('T', '_', '-', '/'))}{digits(rng.choice((2, 4, 6)))}"

    kinds = (
        lambda: digits(rng.randint(12, 24)),
        lambda: rng.choice("-/_").join(digits(rng.choice((2, 3, 4))) for _ in range(rng.randint(3, 6))),
        lambda: f"+{digits(rng.randint(1, 3))}{rng.choice(('-', '/', ''))}{digits(3)}{rng.choice(('-', '/', ''))}{digits(rng.randint(6, 8))}",
        time,
        lambda: "/" * rng.randint(1, 2) + "/".join(rng.choice((rng.choice(names), digits(rng.randint(1, 6)))) for _ in range(rng.randint(2, 6))),
        lambda: rng.choice(names) + rng.choice("-_=/") + digits(rng.randint(2, 10)),
        lambda: rng.choice("=-_/+") * rng.randint(12, 80),
    )
    return [kinds[i % len(kinds)]() for i in range(made)]


def labelled(texts: list[str], seed: int = 7, made: int = 4_000) -> tuple[list[str], list[str]]:
    """(random strings, identifiers) from a sample of texts."""
    rng = random.Random(seed)
    hits, plain = [], set()
    for t in texts:
        at = 0
        for kind, a, b in base_spans(t):
            hits.append(re.split(r"[:=]\s*[\"']?", t[a:b])[-1] if kind == "assign" else t[a:b])
            if a >= at:
                plain.update(re.findall(r"[A-Za-z]{2,}", t[at:a]))
            at = max(at, b)
        plain.update(re.findall(r"[A-Za-z]{2,}", t[at:]))
    pools = ("0123456789abcdef", ALPHABET[:62], ALPHABET[:64], ALPHABET[:36], ALPHABET[26:62])
    hits += ["".join(rng.choices(pools[i % len(pools)], k=rng.randint(16, 64))) for i in range(made)]
    names = sorted(plain) or ["alpha", "value", "index", "count", "name", "list", "file", "path"]
    joins = ("", "_", "-", "/")
    for i in range(made):
        parts = rng.choices(names, k=rng.randint(2, 5))
        names_ = joins[i % 4].join(p.capitalize() if i % 4 == 0 else p for p in parts)
        plain.add(names_ + str(rng.randint(0, 2030)) * (i % 5 == 0))
    return hits, sorted(plain)


def learned(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 400, sample_chars: int = 4_000) -> Models:
    """Models trained on the bounded sample."""
    rows = df.filter(df[text_col].isNotNull()).select(df[id_col].alias("id"), df[text_col].alias("t"))
    n = rows.count()
    # a digest of id and text decides, so the same table gives the same sample
    chance = F.pmod(F.xxhash64(F.lit("secret"), "id", "t"), F.lit(1 << 30)) / float(1 << 30)
    top = rows.filter(chance < sample_rows / max(1, n)).select(F.substring("t", 1, sample_chars).alias("t")).limit(4 * sample_rows)
    return train(*labelled(sorted(r.t for r in top.collect())))


def scan(text: str, models: Models | None) -> list[Span]:
    """All spans: the base ones, and the random-looking runs outside of them; of a run that
    touches base spans, the parts that none covers are scored."""
    base = base_spans(text)
    if models is None or not long_word(text, SHORTEST):
        return base
    more = []
    for m in RUN.finditer(text):
        for a, b in uncovered(*m.span(), base):
            if b - a >= SHORTEST and models.secret(text[a:b]):
                more.append(("random", a, b))
    return sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0])))


def uncovered(a: int, b: int, spans: list[Span]) -> list[tuple[int, int]]:
    """What of a to b lies in none of the spans, which are in order of start."""
    out = []
    for _, x, y in spans:
        if x >= b:
            break
        if x > a:
            out.append((a, x))
        a = max(a, y)
    return out + [(a, b)] * (a < b)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """The text with the union of its spans replaced."""
    out, at = [], 0
    for _, a, b in spans:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def scanned(df: DataFrame, models: Models | None, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 8 << 20) -> DataFrame:
    """Counts and spans of each row; one narrow pass."""
    kind = df.schema[id_col].dataType.simpleString()
    names = [id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", batch_bytes):
                rows = []
                for t in text_list(b.column("text")):
                    spans = scan(t, models)
                    base = [s for s in spans if s[0] != "random"]
                    n = [sum(s[0] == k for s in spans) for k in KINDS]
                    rows.append((*n[:3], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), n[3]))
                kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
                yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(c, type=k) for c, k in zip(zip(*rows), kinds))], names=names)
        tidy()

    return df.select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(run, f"`{id_col}` {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_random bigint")


def cleaned(df: DataFrame, models: Models | None, text_col: str = "text", mark: str = "[SECRET]", batch_bytes: int = 4 << 20) -> DataFrame:
    """``df`` with the secrets of ``text_col`` replaced; all rows and columns stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            at = whole.schema.get_field_index(text_col)
            for b in slices(whole, text_col, batch_bytes):
                texts = [t if t is None else redacted(t, scan(t, models), mark) for t in b.column(at).to_pylist()]
                yield b.set_column(at, b.schema.field(at), pa.array(texts, type=b.schema.field(at).type))
        tidy()

    return df.mapInArrow(run, df.schema)
