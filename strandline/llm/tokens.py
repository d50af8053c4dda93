"""Exact token counts and ids by a compiled finite-state tokenizer.

A byte-pair vocabulary with word ends is compiled from its merges into two deterministic
transducers; no tokenizer library runs on the main path.

* :class:`Cutter` reads classes of letters and marks where pre-tokens begin.  Its few states make a
  chunk of text a map from entry states to exit states; the maps of the chunks of every batch, short
  texts and long ones alike, compose by a parallel prefix scan (:func:`scan`), and with its
  entry state known each chunk is read once more for its output.
* :class:`Speller` reads the bytes of one pre-token, the last one marked as such.  A transition
  carries the number of tokens that it adds to the prefix read so far (a merge takes some
  back, so it may be negative), and a state knows the last token of that prefix.  Two tokens stand
  side by side in an encoding only if no earlier merge crosses their border, so a state need only hold the
  place in a trie of the tokens and the last tokens at the places where a longer token may
  still begin.  States are determinised on demand and kept up to a bound.

The cutter leaves every pre-token to start from the first state, so the sums of the speller's counts
over the pre-tokens of a text are the last step of the scan.  Pre-tokens that are equal letter
by letter take the same path and are walked once a batch.

Null and empty texts have 0 tokens; an empty table gives none.  Very long texts and very long
pre-tokens are read whole, in time proportional to their length; a long text goes by stretches that
end at white space.  Rows are independent: ties, repeated
rows and extra columns of any name do not matter.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator
from functools import cached_property, lru_cache

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import U64, mix64, slices, text_list, tidy

#: fixed values: white space as the vocabulary's pattern has it (the C0 separators are none)
BLANK = "\t\n\x0b\x0c\r \x85\xa0                　"
#: fixed values: the shape of the pattern of pre-tokens behind its literals
RUNS = [r"[\p{L}]+", r"[\p{N}]", r"[^\s\p{L}\p{N}]+"]
END = "</w>"
FINAL = 256  # added to the last byte of a pre-token


def scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix compositions of maps: entry (state, i) of the result is the state in which
    ``state`` leaves chunk i when it enters chunk 0.  Parallel: log2 rounds over all chunks."""
    out, step = maps.copy(), 1
    while step < out.shape[1]:
        out[:, step:] = np.take_along_axis(out[:, step:], out[:, :-step].astype(np.intp), axis=0)
        step *= 2
    return out


class Cutter:
    """Transducer over letter classes that marks the first letters of pre-tokens.

    Pre-tokens are the literals of the pattern (an apostrophe and letters), runs of letters, single
    numbers and runs of anything else but white space.  A failed literal is known one letter late,
    so a transition may also mark the letter before."""

    BLANK, NUMBER, OTHER, LETTER = range(4)
    HERE, BACK = 1, 2  # what a transition marks
    SHIFT = 4  # a class takes so many bits

    def __init__(self, literals: list[str], chunk: int = 256):
        heads = sorted({w[:i] for w in literals for i in range(1, len(w))})
        quotes = {w[0] for w in literals}
        if any(a != b and b.startswith(a) for a in literals for b in literals) or any(len(h) > 2 for h in heads) or not all(w[1:].isalpha() and not w[0].isalnum() for w in literals):
            raise ValueError("only literals of a sign and one or two letters are compiled")
        self.chunk, self.signs = chunk, sorted({c for w in literals for c in w})
        self.states = ["", "letters", "others", *heads]
        kinds = [self.BLANK, self.NUMBER, self.OTHER, self.LETTER] + [self.OTHER if c in quotes else self.LETTER for c in self.signs]
        if len(self.states) * (1 << self.SHIFT) > 256 or len(kinds) > 1 << self.SHIFT:
            raise ValueError("too many literals")

        def step(state: str, c: int) -> tuple[str, int]:
            kind, sign = kinds[c], self.signs[c - 4] if c > 3 else ""
            if state in heads:
                if state + sign in literals and sign:
                    return "", 0
                if state + sign in heads and sign:
                    return state + sign, 0
                # the literal fails: its sign stands alone, its letters begin a run
                after, marks = step("letters" if len(state) > 1 else "others", c)
                return after, marks | (self.BACK if len(state) > 1 else 0)
            if kind == self.BLANK:
                return "", 0
            if (state, kind) in (("letters", self.LETTER), ("others", self.OTHER)):
                return state, 0
            if sign in quotes:
                return sign, self.HERE
            return {self.NUMBER: "", self.OTHER: "others", self.LETTER: "letters"}[kind], self.HERE

        self.next = np.zeros(256, dtype=np.uint8)  # by state << SHIFT | class; the next state is shifted as well
        self.out = np.zeros(256, dtype=np.uint8)
        for i, state in enumerate(self.states):
            for c in range(len(kinds)):
                after, marks = step(state, c)
                self.next[i << self.SHIFT | c] = self.states.index(after) << self.SHIFT
                self.out[i << self.SHIFT | c] = marks

    def maps(self, x: np.ndarray, ahead: int = 8) -> np.ndarray:
        """Exit state for every entry state (state x chunk) of chunks given as columns of ``x``.

        Nearly all chunks forget their entry state within ``ahead`` letters and go on as one."""
        s = np.repeat((np.arange(len(self.states), dtype=np.uint8) << self.SHIFT)[:, None], x.shape[1], axis=1)
        for c in x[:ahead]:
            s = self.next[s + c]
        open_ = np.flatnonzero((s != s[0]).any(0))
        one, some = s[0], s[:, open_]
        for c in x[ahead:]:
            one = self.next[one + c]
        if len(open_):
            for c in x[ahead:][:, open_]:
                some = self.next[some + c]
        out = np.repeat(one[None], len(self.states), axis=0)
        out[:, open_] = some
        return out >> self.SHIFT

    def starts(self, classes: np.ndarray) -> np.ndarray:
        """Whether a pre-token begins at each letter."""
        n = len(classes)
        size = min(self.chunk, max(16, n))
        padded = np.zeros(-(-max(n + 1, 1) // size) * size, dtype=np.uint8)  # blanks at the end
        padded[:n] = classes
        x = np.ascontiguousarray(padded.reshape(-1, size).T)
        left = scan(self.maps(x))[0]
        s = np.concatenate([[0], left[:-1]]).astype(np.uint8) << self.SHIFT
        marks = np.empty_like(x)
        for k, c in enumerate(x):
            at = s + c
            marks[k] = self.out[at]
            s = self.next[at]
        flat = marks.T.reshape(-1)
        return ((flat[:-1] & self.HERE) | (flat[1:] >> 1))[:n].astype(bool)


class Table:
    """Transitions by (state, symbol) as an open hash table in two arrays."""

    def __init__(self, bits: int = 16):
        self.bits, self.held = bits, 0
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.values = np.zeros(1 << bits, dtype=np.int32)

    def slot(self, key: np.ndarray) -> np.ndarray:
        return (mix64(key.view(U64)) >> U64(64 - self.bits)).astype(np.int64)

    def get(self, key: np.ndarray) -> np.ndarray:
        """The next state, or -1 where there is none yet."""
        at = self.slot(key)
        got = self.keys[at]
        out = np.where(got == key, self.values[at], -1)
        rest = np.flatnonzero((got != key) & (got >= 0))
        while len(rest):
            at[rest] = (at[rest] + 1) & (len(self.keys) - 1)
            got = self.keys[at[rest]]
            hit = got == key[rest]
            out[rest[hit]] = self.values[at[rest[hit]]]
            rest = rest[~hit & (got >= 0)]
        return out

    def put(self, key: np.ndarray, value: np.ndarray) -> None:
        """Adds distinct keys that are not there yet."""
        if 2 * (self.held + len(key)) > len(self.keys):
            old = self.keys >= 0
            key, value = np.concatenate([self.keys[old], key]), np.concatenate([self.values[old], value])
            self.__init__((4 * len(key)).bit_length())
        self.held += len(key)
        at = self.slot(key)
        rest = np.arange(len(key))
        while len(rest):
            free = rest[self.keys[at[rest]] < 0]
            self.keys[at[free]] = key[free]
            won = self.keys[at[rest]] == key[rest]
            self.values[at[rest[won]]] = value[rest[won]]
            rest = rest[~won]
            at[rest] = (at[rest] + 1) & (len(self.keys) - 1)


class Speller:
    """Transducer over the bytes of a pre-token, compiled from merges in order of rank."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], max_states: int = 200_000):
        byte_of = {c: b for b, c in _byte_letters().items()}
        inner = lambda w: [byte_of[c] for c in w]

        def symbols(token: str) -> list[int]:
            if not token.endswith(END):
                return inner(token)
            bytes_ = inner(token.removesuffix(END))
            return [*bytes_[:-1], bytes_[-1] + FINAL]

        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}  # token: left, right, rank
        for r, (a, b) in enumerate(merges):
            left, right, token = vocab[a], vocab[b], vocab[a + b]
            if token in self.parts or any(self.parts[t][2] >= r for t in (left, right) if t in self.parts):
                raise ValueError("only merges that make each token once, from earlier ones, are compiled")
            self.rank[left, right] = r
            self.parts[token] = left, right, r
        # a trie of the tokens with failure links; nodes by number, 0 the root
        self.child: dict[int, int] = {}
        self.depth, self.token, self.fail = [0], [-1], [0]
        self.inside = [False]  # whether a node has children
        above, symbol = [0], [0]
        self.length = np.zeros(max(vocab.values()) + 1, dtype=np.int64)
        for word, number in vocab.items():
            at, path = 0, symbols(word)
            if len(path) > 1 and number not in self.parts:
                continue  # no merge makes it
            for c in path:
                key = at << 9 | c
                if key not in self.child:
                    self.child[key] = len(self.depth)
                    self.inside[at] = True
                    self.depth.append(self.depth[at] + 1)
                    self.token.append(-1)
                    self.fail.append(0)
                    self.inside.append(False)
                    above.append(at)
                    symbol.append(c)
                at = self.child[key]
            self.token[at] = number
            self.length[number] = len(path)
        for node in sorted(range(1, len(self.depth)), key=self.depth.__getitem__):
            if above[node]:
                self.fail[node] = self._goto(self.fail[above[node]], symbol[node])
        self.fits: dict[tuple[int, int], bool] = {}
        self.spines: dict[int, list[tuple[int, int]]] = {}
        self.max_states = max_states
        self.forget()

    def _goto(self, node: int, c: int) -> int:
        while True:
            if (to := self.child.get(node << 9 | c)) is not None:
                return to
            if not node:
                return 0
            node = self.fail[node]

    def forget(self) -> None:
        """Drops all states but the first."""
        self.go, self.table = {}, Table()  # transitions met in walks of single pre-tokens, and of many
        #: per state: trie node, last token and tokens since at each place where a longer token may begin
        self.what: list[tuple[int, tuple[tuple[int, int, int], ...]]] = [(0, ((0, -1, 0),))]
        self.number: dict[tuple, int] = {}
        self.last: list[int] = [-1]
        self.adds: list[int] = [0]
        self.fits.clear()
        tidy()

    def spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens at one edge of a token from its single byte up, each with the rank that makes it."""
        known = self.spines.get(token << 1 | side)
        if known is None:
            out, at = [], token
            while at in self.parts:
                out.append((at, self.parts[at][2]))
                at = self.parts[at][side]
            known = self.spines[token << 1 | side] = [(at, -1), *reversed(out)]
        return known

    def fit(self, a: int, b: int) -> bool:
        """Whether tokens a, b stand side by side: at no time would a merge across their border come
        before the next one within a or b (of equal ranks the left one comes first)."""
        known = self.fits.get((a, b))
        if known is not None:
            return known
        left, right = self.spine(a, 1), self.spine(b, 0)
        never = len(self.rank)
        i = j = 0
        while True:
            across = self.rank.get((left[i][0], right[j][0]), never)
            own = left[i + 1][1] if i + 1 < len(left) else never
            other = right[j + 1][1] if j + 1 < len(right) else never
            if across < own and across <= other:
                ok = across == never
                break
            if own == other == never:
                ok = True
                break
            if own <= other:
                i += 1
            else:
                j += 1
        if len(self.fits) > 4 * self.max_states:
            self.fits.clear()
        self.fits[a, b] = ok
        return ok

    def step(self, state: int, c: int) -> int:
        """Determinises the transition of a state by a symbol."""
        node, places = self.what[state]
        to = self._goto(node, c)
        before = {back: (token, since) for back, token, since in places}
        end, token = to, -1
        while end:
            if (t := self.token[end]) >= 0:
                last, since = before[self.depth[end] - 1]
                if last < 0 or self.fit(last, t):
                    token = t
                    break
            end = self.fail[end]
        if token < 0:
            raise ValueError("a byte without a token")
        adds = 1 - since
        if c >= FINAL:
            key = (-1, token, adds)
            new = None
        else:
            held = []
            end = to
            while True:
                if self.inside[end]:
                    back = self.depth[end]
                    held.append((0, token, 0) if back == 0 else (back, before[back - 1][0], before[back - 1][1] + adds))
                if not end:
                    break
                end = self.fail[end]
            new = (to, tuple(held))
            key = (new, adds)
        found = self.number.get(key)
        if found is None:
            found = self.number[key] = len(self.what)
            self.what.append(new)
            self.last.append(token)
            self.adds.append(adds)
        return found

    def _alone(self, word: bytes, state: int) -> list[int]:
        """The states after each of the last bytes of one pre-token."""
        get, out = self.go.get, []
        for c in [*word[:-1], word[-1] + FINAL]:
            key = state << 9 | c
            state = get(key)
            if state is None:
                state = self.go[key] = self.step(key >> 9, c)
            out.append(state)
        return out

    def walk(self, raw: np.ndarray, size: np.ndarray, few: int = 8) -> np.ndarray:
        """The state after each byte of pre-tokens that lie side by side, all walked at once."""
        if len(self.what) > self.max_states:
            self.forget()
        order = np.argsort(-size, kind="stable")
        length = size[order]
        begin = (np.cumsum(size) - size)[order]
        states = np.zeros(len(raw), dtype=np.int32)
        s = np.zeros(len(size), dtype=np.int64)
        p = 0
        while True:
            n = int(np.searchsorted(-length, -p))
            if n <= few:
                break
            at = begin[:n] + p
            symbol = raw[at].astype(np.int64)
            symbol[length[:n] == p + 1] += FINAL
            key = s[:n] << 9 | symbol
            to = self.table.get(key)
            if len(miss := np.flatnonzero(to < 0)):
                new, where = np.unique(key[miss], return_inverse=True)
                made = np.array([self.step(k >> 9, k & 511) for k in new.tolist()], dtype=np.int32)
                self.table.put(new, made)
                to[miss] = made[where]
            states[at] = to
            s = to.astype(np.int64)
            p += 1
        for k in range(n):
            b, e = int(begin[k]), int(begin[k] + length[k])
            states[b + p : e] = self._alone(raw[b + p : e].tobytes(), int(s[k]))
        return states

    def spell(self, raw: np.ndarray, size: np.ndarray, with_ids: bool, step: int = 1 << 18, few: int = 8) -> tuple[np.ndarray, np.ndarray]:
        """Token counts of pre-tokens that lie side by side and, if wanted, their ids."""
        counts, ids = [], []
        edge = np.concatenate([[0], np.cumsum(size)])
        i = 0
        while i < len(size):
            j = max(i + 1, int(np.searchsorted(edge, edge[i] + step, "right")) - 1)
            part = size[i:j]
            states = self.walk(raw[edge[i] : edge[j]], part, few)
            begin = np.cumsum(part) - part
            n = np.add.reduceat(np.array(self.adds, dtype=np.int64)[states], begin)
            counts.append(n)
            if with_ids:
                # from the last byte back, token by token
                last = np.array(self.last, dtype=np.int64)
                out = np.zeros(int(n.sum()), dtype="<u4")
                at, to = begin + part, np.cumsum(n) - 1
                open_ = np.arange(len(part))
                while len(open_) > few:
                    token = last[states[at[open_] - 1]]
                    out[to[open_]] = token
                    at[open_] -= self.length[token]
                    to[open_] -= 1
                    open_ = open_[at[open_] > begin[open_]]
                for k in open_.tolist():
                    own, x, y, b = states[begin[k] : at[k]].tolist(), int(at[k] - begin[k]), int(to[k]), self.last
                    while x > 0:
                        out[y] = b[own[x - 1]]
                        x -= int(self.length[out[y]])
                        y -= 1
                ids.append(out)
            i = j
        return np.concatenate(counts or [np.zeros(0, dtype=np.int64)]), np.concatenate(ids or [np.zeros(0, dtype="<u4")])


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 letters
    for themselves, the others in order from U+0100 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class Transducer:
    """Compiled from a ``tokenizers`` JSON file whose normaliser is NFC, white space to one
    blank and lower case, and whose pre-tokenizer keeps the matches of one pattern."""

    UNKNOWN = 255  # code points that Python's tables do not know

    def __init__(self, path: str, max_states: int = 200_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = spec["pre_tokenizer"]["pretokenizers"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        ways = steps[0]["pattern"]["Regex"].split("|")
        if kinds != ["NFC", "Replace", "Lowercase"] or steps[0]["behavior"] != "Removed" or not steps[0]["invert"] or ways[-3:] != RUNS or spec["model"]["end_of_word_suffix"] != END:
            raise ValueError("only word-end vocabularies with NFC, blank and lower-case normalisation are compiled")
        self.path = path
        self.cutter = Cutter(ways[:-3])
        self.speller = Speller(spec["model"]["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]], max_states)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.marks = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.classes = _classes(self.cutter)
        self.blank = re.compile(f"[{BLANK}]")
        self.by_library = 0  # texts that the library took

    @cached_property
    def whole(self):
        """The library, for the rare texts with code points newer than Python's tables, which it may
        class or spell in another way."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def forget(self) -> None:
        """Gives memory back at the end of a task; the states stay, up to their bound."""
        tidy()

    def normal(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        # lower() of a whole string treats a final capital sigma by its context; the library goes letter by letter
        return text.lower() if "Σ" not in text else "".join(map(str.lower, text))

    def parts(self, text: str) -> list[str | int]:
        """Stretches between special strings, normalised, and the ids of those strings."""
        if self.marks is None or "<|" not in text or not self.marks.search(text):
            return [self.normal(text)]
        out: list[str | int] = []
        at = 0
        for m in self.marks.finditer(text):
            out += [self.normal(text[at : m.start()]), self.special[m[0]]]
            at = m.end()
        return [*out, self.normal(text[at:])]

    def stretches(self, text: str, most: int = 1 << 20) -> Iterator[str | int]:
        """The parts of a text, long ones cut where white space stands."""
        for part in self.parts(text):
            at = 0
            while not isinstance(part, int) and len(part) - at > most:
                to = max(part.rfind(c, at, at + most) for c in " \n\t")
                if to <= at:
                    found = self.blank.search(part, at + most)
                    to = found.start() if found else len(part)
                yield part[at:to]
                at = to
            yield part[at:] if at else part

    def read(self, stretches: list[str], with_ids: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens before each stretch and after the last, their ids if wanted, and which stretches
        hold code points that Python's tables do not know."""
        joined = "\n".join([*stretches, ""])
        code = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
        found = self.classes[code]
        size = np.fromiter((len(s) + 1 for s in stretches), dtype=np.int64, count=len(stretches))
        begin = np.concatenate([[0], np.cumsum(size)])
        odd = np.zeros(len(stretches), dtype=bool)
        unknown = np.flatnonzero(found == self.UNKNOWN)
        if len(unknown):
            odd[np.unique(np.searchsorted(begin, unknown, "right") - 1)] = True
            found[unknown] = Cutter.OTHER
        start = self.cutter.starts(found)
        # every letter that is no blank lies in a pre-token: they stand side by side once blanks are gone
        solid = np.flatnonzero(found != Cutter.BLANK)
        letters, first = code[solid], np.flatnonzero(start[solid])
        words_before = np.searchsorted(solid[first], begin)
        if not len(first):
            return np.zeros(len(begin), dtype=np.int64), np.zeros(0, dtype="<u4"), odd
        length = np.diff(np.append(first, len(letters)))
        which, example = _distinct(letters, first, length)
        n = length[example]
        chosen = letters[np.repeat(first[example] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        wide = 1 + (chosen >= 0x80) + (chosen >= 0x800) + (chosen >= 0x10000)
        raw = np.frombuffer(chosen.tobytes().decode("utf-32-le").encode(), dtype=np.uint8)
        count, ids = self.speller.spell(raw, np.add.reduceat(wide, np.cumsum(n) - n), with_ids)
        each = count[which]
        total = np.concatenate([[0], np.cumsum(each)])
        if with_ids:
            ids = ids[np.repeat((np.cumsum(count) - count)[which] - total[:-1], each) + np.arange(int(total[-1]))]
        return total[words_before], ids, odd

    def _read_all(self, texts: list[str], with_ids: bool, most: int = 1 << 20) -> Iterator[tuple[int, int | np.ndarray, bool]]:
        """(text number, count or ids, whether the text goes to the library) of the parts of texts."""
        group: list[tuple[int, str | int]] = []
        held = 0

        def flush() -> Iterator[tuple[int, int | np.ndarray, bool]]:
            at, ids, odd = self.read([p for _, p in group if not isinstance(p, int)], with_ids)
            at, odd, k = at.tolist(), odd.tolist(), 0
            for i, p in group:
                if isinstance(p, int):
                    yield i, np.array([p], dtype="<u4") if with_ids else 1, False
                else:
                    yield i, ids[at[k] : at[k + 1]] if with_ids else at[k + 1] - at[k], odd[k]
                    k += 1
            group.clear()

        for i, text in enumerate(texts):
            for p in self.stretches(text):
                group.append((i, p))
                held += 1 if isinstance(p, int) else len(p)
                if held >= most:
                    yield from flush()
                    held = 0
        if group:
            yield from flush()

    def counts(self, texts: list[str]) -> list[int]:
        """Token counts of texts."""
        out, strange = [0] * len(texts), set()
        for i, n, odd in self._read_all(texts, False):
            out[i] += n
            if odd:
                strange.add(i)
        for i in strange:
            out[i] = len(self.whole.encode(texts[i], add_special_tokens=False).ids)
        self.by_library += len(strange)
        return out

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of texts as little-endian unsigned 32-bit arrays."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        strange = set()
        for i, ids, odd in self._read_all(texts, True):
            out[i].append(ids)
            if odd:
                strange.add(i)
        for i in strange:
            out[i] = [np.array(self.whole.encode(texts[i], add_special_tokens=False).ids, dtype="<u4")]
        self.by_library += len(strange)
        return [x[0] if len(x) == 1 else np.concatenate(x) for x in out]


def _distinct(letters: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pre-tokens side by side the number of the distinct one that each is, and an example of each.

    They are grouped by a hash and compared with their example letter by letter; should two
    different ones share a hash, each that differs becomes an example of its own."""
    power = np.full(int(length.max()), 0x9E3779B97F4A7C15, dtype=U64)
    power[0] = 1
    with np.errstate(over="ignore"):
        power = np.cumprod(power, dtype=U64)
        h = np.add.reduceat(mix64(letters) * power[np.arange(len(letters)) - np.repeat(first, length)], first)
    _, example, which = np.unique(h ^ (length.astype(U64) << U64(40)), return_index=True, return_inverse=True)
    other = example[which]
    same = length == length[other]
    at = np.flatnonzero(same)
    n = length[at]
    gap = np.cumsum(n) - n
    span = np.arange(int(n.sum()))
    unlike = letters[np.repeat(first[at] - gap, n) + span] != letters[np.repeat(first[other[at]] - gap, n) + span]
    if unlike.any():
        same[at[np.logical_or.reduceat(unlike, gap)]] = False
    if not same.all():
        alone = np.flatnonzero(~same)
        which[alone] = len(example) + np.arange(len(alone))
        example = np.concatenate([example, alone])
    return which, example


def _classes(cutter: Cutter) -> np.ndarray:
    """The class of every code point."""
    out = np.full(0x110000, Cutter.OTHER, dtype=np.uint8)
    kinds = {"L": Cutter.LETTER, "N": Cutter.NUMBER}
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))
        if kind == "Cn":
            out[c] = Transducer.UNKNOWN
        elif (k := kinds.get(kind[0])) is not None:
            out[c] = k
    out[[ord(c) for c in BLANK]] = Cutter.BLANK
    for i, c in enumerate(cutter.signs):
        out[ord(c)] = 4 + i
    return out


@lru_cache(maxsize=4)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def token_counts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, batch_bytes: int = 4 << 20) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit of each row; one narrow pass without a shuffle."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for whole in batches:
            for b in slices(whole, "text", batch_bytes):
                n = np.asarray(machine.counts(text_list(b.column("text"))), dtype=np.int64)
                size = pc.binary_length(b.column("text")).fill_null(0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("id"), size, pa.array(n), pa.array(n > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])
        machine.forget()

    narrow = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    return narrow.mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
