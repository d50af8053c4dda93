"""Titles, entities, questions, topics and takeaways of a run of messages.

These need fixpoints and look-ahead over words that columns cannot express well, so they are
plain functions on one segment's messages, mapped over Arrow batches (one row a segment).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import groupby

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import rules as R
from ..functions.dialect import Rx, any_py, steps_py, trim_py

Messages = list[tuple[str, str]]  # (role, text) in order

_WHITE = Rx(r"\s+").python
_SENTENCE = Rx(r"^[^.!?]*[.!?]")
_EDGE_DASHES = Rx(r"^-+|-+$")
_NOT_TAG = Rx(r"[^a-z0-9]+", to="-")
_NO_WORD_START = Rx(r"^[^a-zA-Z0-9]")
_ONE_BLANK = Rx(r"\s+", to=" ")
_NOT_NORMAL = Rx(r"[^a-z0-9\s]")
_STOP = Rx(r"([.!?])\s+", to="$1\x02")
_BULLET = Rx(r"^[-*+]\s+")
_NUMBER = Rx(r"^\d+\.\s+")
_LONG_BOLD = Rx(r"\*\*([^*]{15,})\*\*")
_PARAGRAPH = Rx(r"\n\n+")
_WORDY = Rx(r"^([a-zA-Z'-]+)([^a-zA-Z'-]*)$").python


def of_role(messages: Messages, role: str) -> list[str]:
    return [t for r, t in messages if r == role]


@lru_cache(maxsize=2)
def stripped(text: str) -> str:
    """Without markup; the lists of one group ask for the same texts."""
    return steps_py(R.STRIP_MARKDOWN, text)


def first_sentence(text: str) -> str:
    line = text.split("\n", 1)[0]
    found = _SENTENCE.python.search(line)
    if found and len(short := trim_py(found[0][:-1])) >= 15:
        return short
    return trim_py(line[:120])


def strip_artifacts(text: str) -> str:
    return trim_py(R.LEADING_MARKS.replace_py(steps_py(R.TYPOGRAPHY, text)))


def clean_heading(text: str) -> str:
    return strip_artifacts(trim_py(R.HEADING_NUMBER.replace_py(steps_py((R.BOLD, R.ITALIC, R.CODE, R.LINK), text))))


def title_case(text: str) -> str:
    def one(i: int, word: str) -> str:
        m = _WORDY.match(word)
        if not m or (len(m[1]) > 1 and m[1].isalpha() and m[1].isupper()):
            return word
        low = m[1].lower()
        return (low if i and low in R.MINOR_WORDS else low[:1].upper() + low[1:]) + m[2]

    return " ".join(one(i, w) for i, w in enumerate(_WHITE.split(text)))


_AT_PHRASE, _AT_CONJUNCTION = Rx(r"^(.+)[,;:](?:\s|$)").python, Rx(r"^(.+)\s+(?:and|or|but)\s+", "i").python
_UNPAIRED = (("(", ")", Rx(r"\s*\([^)]*$")), ("[", "]", Rx(r"\s*\[[^\]]*$")), (")", "(", Rx(r"^[^(]*\)\s*")), ("]", "[", Rx(r"^[^\[]*\]\s*")))


def truncate(text: str, most: int = R.TITLE_MOST) -> str:
    if len(text) <= most:
        return text
    head = text[:most]
    for pattern in (_AT_PHRASE, _AT_CONJUNCTION):
        if (m := pattern.search(head)) and len(m[1]) > most * 0.4:
            head = trim_py(m[1])
            break
    else:
        if (space := head.rfind(" ")) > most * 0.5:
            head = head[:space]
    for more, less, cut in _UNPAIRED:
        if head.count(more) > head.count(less):
            head = trim_py(cut.replace_py(head))
    return head


def settled(text: str, once: Callable[[str], str]) -> str:
    """Applies ``once`` until nothing changes."""
    while (new := once(text)) != text:
        text = new
    return text


def _cut_openings(text: str, rules: Iterable[Rx]) -> str:
    for r in rules:
        if (cut := r.replace_py(text)) != text:
            text = R.LEADING_PUNCTUATION.replace_py(trim_py(cut))
    return text


def strip_filler(text: str) -> str:
    return settled(text, lambda s: _cut_openings(s, R.FILLERS + R.ACTIONS))


def topic_kernel(text: str) -> str:
    """What a request is about, in 40 letters at most."""

    def once(s: str) -> str:
        for r in (*R.FILLERS, *R.ACTIONS, R.CONTEXTUAL, R.NUMBERED_ITEM, R.EACH_ONE, R.LEADING_PUNCTUATION):
            s = trim_py(r.replace_py(s))
        return s

    return truncate(trim_py(R.ARTICLE.replace_py(settled(first_sentence(text), once))), 40)


def fuzzy_match(a: str, b: str) -> bool:
    """Whether two lower-case words are spellings of one."""
    short, long_ = sorted((a, b), key=len)
    if len(long_) - len(short) > len(long_) * 0.3:
        return False
    if [k for k, _ in groupby(a)] == [k for k, _ in groupby(b)]:
        return True
    if short[:5] != long_[: min(5, len(short))]:
        return False
    return (Counter(short) & Counter(long_)).total() >= len(short) * 0.75


_LETTERS, _CAPS, _BREAK = Rx(r"[^a-zA-Z'-]"), Rx(r"^[A-Z]{2,}$").python, Rx(r"[.!?\n]+").python
_QUOTES = (R.TYPOGRAPHY[0], R.TYPOGRAPHY[1])


def _names(sentence: str) -> Iterator[str]:
    """Acronyms and runs of capitalised words after the first word; commas end a run."""
    words = sentence.split() if sentence.isprintable() else _WHITE.split(trim_py(sentence))  # printable: no blank but spaces
    words = words[1:] if len(words) > 1 else words
    run: list[str] = []
    for raw in words:
        if raw.islower():  # no name, whatever its letters
            if run:
                yield " ".join(run)
                run = []
            continue
        word = raw if raw.isascii() and raw.isalpha() else _LETTERS.replace_py(raw)
        name = len(word) >= 2 and word[0].isupper() and word not in R.NOT_ENTITIES
        if run and not name:
            yield " ".join(run)
            run = []
        if not run and len(word) >= 2 and _CAPS.match(word):
            yield word
        elif name:
            run.append(word)
            if "," in raw or ";" in raw:
                yield " ".join(run)
                run = []
    if run:
        yield " ".join(run)


@lru_cache(maxsize=1)  # the lists of one group need it several times
def _weights(messages: tuple[tuple[str, str], ...]) -> Counter[str]:
    weight: Counter[str] = Counter()
    for role, text in messages:
        text = steps_py(_QUOTES, steps_py(R.ABBREVIATED, stripped(text)))
        for sentence in _BREAK.split(text):
            if not sentence.islower() and trim_py(sentence):
                for name in _names(sentence):
                    if _CAPS.match(name) or name.lower() not in R.STOP_SET:
                        weight[name] += 3 if role == "user" else 1
    return weight


def weights(messages: Messages) -> list[tuple[str, int]]:
    """Names and their weights in order of first occurrence; a user's words count three times."""
    return list(_weights(tuple(messages)).items())


def entities(messages: Messages, most: int = 5) -> list[str]:
    """Names by weight."""
    return [name for name, _ in _weights(tuple(messages)).most_common(most)]  # ties by first occurrence


def entity_tag(messages: Messages) -> str | None:
    for name in entities(messages, 1):
        tag = _EDGE_DASHES.replace_py(_NOT_TAG.replace_py(name.lower()))
        return tag if len(tag) >= 2 else None
    return None


def tags(messages: Messages, prefix: str = "ai-chat") -> list[str]:
    base, text = prefix.rstrip("/"), " ".join(t for _, t in messages)
    low = text.lower()
    found: dict[str, None] = {}
    for tag, least, pattern in R.DOMAIN_TAGS:
        need = -(-3 * least // 2) if len(messages) <= 3 else least
        if len(found) < R.MOST_TAGS and sum(map(low.count, pattern.holds)) >= need and sum(1 for _ in pattern.python.finditer(text)) >= need:
            found[f"{base}/{tag}"] = None
    found = found or {base: None}
    if len(found) < R.MOST_TAGS and (own := entity_tag(messages)):
        found[f"{base}/{own}"] = None
    return list(found)


# --- titles: the first strategy that gives one


def _with_kernel(title: str, messages: Messages) -> str:
    """A short title is preceded by what the user asked about, unless one holds the other."""
    users = of_role(messages, "user")
    if users and len(title) < 25:
        kernel = topic_kernel(users[0])
        a, b = kernel.lower(), title.lower()
        if len(kernel) > 2 and a not in b and b not in a:
            return f"{kernel} {title}"
    return title


def by_heading(messages: Messages) -> str | None:
    seen: dict[str, list] = {}
    for text in of_role(messages, "assistant"):
        for line in text.split("\n"):
            if m := R.TITLE_HEADING.python.match(line):
                level, words = len(m[1]), clean_heading(trim_py(m[2]))
            elif m := R.BOLD_LINE.python.match(trim_py(line)):
                level, words = 3, clean_heading(trim_py(m[1]))
            else:
                continue
            if len(words) >= 3:
                entry = seen.setdefault(words.lower(), [words, 0, level])
                entry[1] += 1
                entry[2] = min(entry[2], level)
    if not seen:
        return None
    best = max(seen.values(), key=lambda e: 10 * e[1] + 6 - e[2])
    return truncate(title_case(_with_kernel(best[0], messages)))


def comparison_side(text: str) -> str:
    side = trim_py(R.SIDE_END.replace_py(trim_py(R.SIDE_START.replace_py(strip_artifacts(trim_py(text))))))
    if len(side) > 35:
        side = trim_py(R.SIDE_PHRASE.replace_py(side))
    return truncate(side, 45)


def by_comparison(messages: Messages) -> str | None:
    users = of_role(messages, "user")
    if not users:
        return None
    line = strip_filler(stripped(trim_py(users[0])).split("\n", 1)[0])
    low = line.lower()
    for pattern in R.COMPARISONS:
        if pattern.holds[0] in low and (m := pattern.python.search(line)):
            a, b = comparison_side(m[1]), comparison_side(m[2])
            if a and b:
                return truncate(title_case(f"{a} vs {b}"))
    return None


_MARKS = Rx(r"^[,;:\s]+|[,;:\s]+$")
_WIDE = Rx(r"\s{2,}", to=" ")


def _kernel_beside(names: list[str], kernel: str) -> str:
    """The kernel without the names and what their removal leaves dangling."""
    lower = [n.lower() for n in names]

    def named(word: str) -> bool:
        w = R.SIDE_END.replace_py(word).lower()
        return w in lower or (len(w) >= 4 and any(fuzzy_match(w, n) for n in lower))

    k = trim_py(_MARKS.replace_py(" ".join(w for w in _WHITE.split(kernel) if not named(w))))
    for r in (R.GENERIC_NOUN, _WIDE, R.VERB_LEFT):
        k = trim_py(r.replace_py(k))
    k = settled(k, lambda s: trim_py(R.TAIL_LEFT.replace_py(s)))
    for r in (R.HEAD_LEFT, _MARKS):
        k = trim_py(r.replace_py(k))
    k = strip_artifacts(k)
    for open_, close in ("()", "[]"):
        if open_ in k and close not in k:
            k = trim_py(k[: k.index(open_)])
    return "" if R.PRONOUNS.test_py(k) or len(k) <= 3 else k


def by_entities(messages: Messages) -> str | None:
    names = entities(messages)
    if not names:
        return None
    users = of_role(messages, "user")
    kernel = topic_kernel(users[0]) if users else ""
    kernel = title_case(_kernel_beside(names, kernel)) if kernel else ""
    return truncate(" ".join(filter(None, (", ".join(names[:3]), kernel))))


def prose_lines(text: str) -> list[str]:
    return [x for x in map(trim_py, trim_py(text).split("\n")) if len(x) >= 15 and not any_py(R.NO_PROSE, x)]


def by_opening(messages: Messages) -> str | None:
    answers = of_role(messages, "assistant")
    lines = prose_lines(answers[0]) if answers else []
    opening = trim_py(R.GREETING.replace_py(lines[0])) if lines else ""
    if len(opening) < 10:
        return None
    found = _SENTENCE.python.search(opening)
    sentence = trim_py(found[0][:-1]) if found else trim_py(opening[:120])
    for r in R.OPENING_PROSE:
        sentence = trim_py(r.replace_py(sentence))
    sentence = strip_artifacts(sentence)
    if not 8 <= len(sentence) <= 50 or R.PRONOUNS.test_py(sentence) or _NO_WORD_START.test_py(sentence):
        return None
    return truncate(title_case(_with_kernel(sentence, messages)))


def by_sentence(messages: Messages) -> str | None:
    users = of_role(messages, "user")
    if not users:
        return None
    s = first_sentence(trim_py(users[0]))
    for rules in (R.FILLERS, R.ACTIONS):
        s = settled(s, lambda x, r=rules: _cut_openings(x, r))
    s = strip_artifacts(trim_py(R.CONTEXTUAL.replace_py(s)))
    return truncate(title_case(s)) if s else None


_TOKEN_CUT = regex.compile(r"[\s\uFEFF\p{P}]+")


def tokens(text: str) -> list[str]:
    return [t for t in _TOKEN_CUT.split(text.lower()) if len(t) >= 3]


def by_keywords(messages: Messages) -> str:
    terms = Counter(t for t in tokens(" ".join(t for _, t in messages)) if t not in R.STOP_SET)
    return title_case(" ".join(t for t, _ in terms.most_common(3))) if terms else "Untitled Topic"


STRATEGIES = (by_heading, by_comparison, by_entities, by_opening, by_sentence, by_keywords)


def title(messages: Messages) -> str:
    return next(t for t in (s(messages) for s in STRATEGIES) if t is not None)


# --- lists of a summary


def normal(text: str) -> str:
    return trim_py(_ONE_BLANK.replace_py(_NOT_NORMAL.replace_py(text.lower())))


def shortened(text: str, most: int = R.ITEM_MOST) -> str:
    if len(text) <= most:
        return text
    if m := _SENTENCE.python.search(text[:most]):
        return trim_py(m[0])
    space = text.rfind(" ", 0, most + 1)
    return text[: space if space > most * 0.5 else most] + "..."


class Distinct:
    """Items in order, none whose normal form contains or lies within an earlier one's."""

    def __init__(self, most: int):
        self.most, self.items, self.forms = most, [], []

    def add(self, item: str) -> None:
        form = normal(item)
        if not self.full and not any(form in f or f in form for f in self.forms):
            self.items.append(item)
            self.forms.append(form)

    @property
    def full(self) -> bool:
        return len(self.items) >= self.most


def questions(messages: Messages) -> list[str]:
    out = Distinct(R.MOST_QUESTIONS)
    for text in of_role(messages, "user"):
        if not (text := stripped(trim_py(text))):
            continue
        raw = first_sentence(text)
        asked = settled(raw, lambda s: _cut_openings(s, R.FILLERS))
        if len(asked) < 20 and len(whole := trim_py(steps_py(R.CLEAN_INLINE, raw))) >= 20:
            asked = whole
        asked = trim_py(R.LEADING_PUNCTUATION.replace_py(strip_artifacts(asked)))
        clean = steps_py(R.CLEAN_INLINE, asked)
        if min(len(asked), len(clean)) >= 5 and any_py((R.QUESTION_END, R.QUESTION_WORD, R.REQUEST), clean):
            out.add(shortened(clean))
    return out.items


def _fragment(text: str) -> bool:
    return len(text) < 20 or R.ACKNOWLEDGED.test_py(text)


def topics(messages: Messages) -> list[str]:
    out, answers = Distinct(R.MOST_TOPICS), of_role(messages, "assistant")
    for text in answers:
        for line in text.split("\n"):
            if m := R.TITLE_HEADING.python.match(line):
                words = trim_py(R.HEADING_NUMBER.replace_py(strip_artifacts(steps_py(R.CLEAN_INLINE, trim_py(m[2])))))
                if len(words) >= 20:  # shorter ones are fragments whatever they say
                    out.add(shortened(words))
    if out.items:
        return out.items
    for text in answers:
        lines = prose_lines(text)
        opening = trim_py(R.GREETING.replace_py(lines[0])) if lines else ""
        if len(opening) < 10:
            continue
        m = _SENTENCE.python.search(opening)
        sentence = strip_artifacts(steps_py(R.CLEAN_INLINE, trim_py(m[0]) if m else trim_py(opening[:150])))
        if R.TOPIC_PRONOUNS.test_py(sentence) or _fragment(sentence):
            continue
        if len(sentence) > 80:
            space = sentence.rfind(" ", 0, 81)
            sentence = sentence[: space if space > 40 else 80]
        out.add(sentence)
    return out.items


def sentences(text: str) -> list[str]:
    text = R.ABBREVIATION_DOT.replace_py(R.FENCED.replace_py(text))
    parts = _STOP.replace_py(text).split("\x02")
    return [s for s in (trim_py(p.replace("\x01", ".")) for p in parts) if s]


def takeaways(messages: Messages) -> list[str]:
    out, answers = Distinct(R.MOST_TAKEAWAYS), of_role(messages, "assistant")
    for text in answers:
        for s in sentences(text):
            wordy = sum(len(w) >= 4 for w in _WHITE.split(s)) >= 3
            if len(s) >= 15 and any_py(R.TAKEAWAYS, s[:60]) and wordy and not any_py(R.PROMPTS, s) and not R.ACKNOWLEDGED.test_py(s):
                clean = trim_py(steps_py(R.CLEAN_INLINE, s))
                for r in (_BULLET, _NUMBER, _ONE_BLANK):
                    clean = r.replace_py(clean)
                if len(clean := strip_artifacts(clean)) >= 15:
                    out.add(shortened(clean))
    for text in answers:
        for m in _LONG_BOLD.python.finditer(text):
            bold = trim_py(m[1])
            if len(bold) >= 15 and any_py(R.TAKEAWAYS, bold) and not any_py(R.PROMPTS, bold):
                out.add(shortened(bold))
    if not out.items and answers:
        last = [p for p in _PARAGRAPH.python.split(answers[-1]) if trim_py(p)]
        end = trim_py(last[-1]) if len(last) > 1 else ""
        if len(end) >= 20 and not end.startswith("```") and not any_py((R.NO_PROSE[1], R.NO_PROSE[2]), end):
            m = _SENTENCE.python.search(end)
            clean = steps_py(R.CLEAN_INLINE, trim_py(m[0]) if m else trim_py(end[:200]))
            if len(clean) >= 15 and not any_py(R.PROMPTS, clean):
                out.add(shortened(clean))
    return out.items


# --- over DataFrames


LISTS = {"title": ("string", title), "entities": ("array<string>", entities), "tags": ("array<string>", tags), "questions": ("array<string>", questions), "topics": ("array<string>", topics), "takeaways": ("array<string>", takeaways)}
COLUMNS = {**LISTS, "weights": ("array<struct<name:string,weight:int>>", weights)}


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Deals rows by a key to as many tasks as the session is set to use; without a fixed number few
    bytes would be gathered in one task, but what follows costs time and not bytes."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), key)


def described_groups(groups: DataFrame, names: tuple[str, ...] = tuple(LISTS)) -> DataFrame:
    """Rows with an array ``messages`` of (index, role, text): the array gives way to what is named.

    Only roles and texts go to Python; the other columns stay in the JVM."""

    def run(roles: pd.Series, texts: pd.Series) -> pd.DataFrame:
        made = []
        for r, t in zip(roles, texts):
            m = [(role, text or "") for role, text in zip(r, t)]
            made.append([COLUMNS[name][1](m) for name in names])
        return pd.DataFrame({name: pd.Series([x[i] for x in made], dtype=object) for i, name in enumerate(names)})

    made = F.pandas_udf(run, ", ".join(f"{k} {COLUMNS[k][0]}" for k in names))
    parts = [F.col("messages")[k] for k in ("role", "text")]
    kept = [c for c in groups.columns if c != "messages"]
    return groups.select(*kept, made(*parts).alias("__made")).select(*kept, *[F.col("__made")[k].alias(k) for k in names])


@F.pandas_udf(ArrayType(StringType()))
def _heaviest(found: pd.Series, most: pd.Series) -> pd.Series:
    """The first names by weight of the ``weights`` of runs of messages, one run behind the other."""

    def one(found, most: int) -> list[str]:
        weight: Counter[str] = Counter()
        for x in found:
            weight[x["name"]] += x["weight"]
        return [name for name, _ in weight.most_common(most)]

    return pd.Series([one(*x) for x in zip(found, most)])


def entities_of_parts(parts: DataFrame, key: str, order: str, most: int = 5) -> DataFrame:
    """key, entities: what ``entities`` gives for all messages of a key, from the ``weights`` of its parts."""
    sorted_ = F.array_sort(F.collect_list(F.struct(order, "weights")))
    return parts.groupBy(key).agg(sorted_.alias("p")).select(key, _heaviest(F.flatten(F.transform("p", lambda x: x["weights"])), F.lit(most)).alias("entities"))


def described(rows: DataFrame, keys: list[str], names: tuple[str, ...] = tuple(LISTS)) -> DataFrame:
    """What is named (all of LISTS by default) of each group of (index, role, text)."""
    return described_groups(spread(rows, keys[0]).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("index", "role", "text"))).alias("messages")), names)
