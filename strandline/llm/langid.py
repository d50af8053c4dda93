"""Language identification by interpolated Kneser-Ney character models.

One order-``order`` model a language is estimated from the words of labelled documents; the
history of a letter ends at the start of its word.  Each is made in a task of its own.  Together they
lie in sorted arrays of 64-bit gram hashes; a gram holds only the languages that know it, so the
arrays grow with what was learned and not with grams times languages.  A text is scored by binary search for all
languages at once and gets the one with the lowest cross-entropy per letter.

Every fifth sampled document of a language is kept out of its model and calibrates, per language:

* ``usual``: the median entropy of such documents under their own model;
* ``excess``: what 95 of 100 kept-out documents of the other languages have beyond that, so mixed
  documents stay (with one language alone, half of what random letters have);
* ``bound``: how far, scaled by the square root of the length, a document of the language lies from the
  usual in a share ``false_rejections`` of all cases, by the exponential tail fitted to the kept-out documents;
* ``sharpness``: the factor of the softmax of the entropies, the best of a grid for their labels.

A document is rejected when its entropy lies beyond both ``excess`` and ``bound``; ``score`` is the
share of its language in the softmax.  A language with fewer than five sampled documents has no
bound and rejects nothing.

Training takes a bounded sample: about ``sample_rows`` documents of every language by a digest, repeated texts once,
the first ``sample_chars`` letters of each, and no more than ``sample_letters`` letters in all, shared
evenly; should the models exceed ``most_bytes`` they are made again from half of the letters.  Every label
is learned.  Prediction reads every whole text, however long, and uses nothing but the text.  Texts that are null, empty
or without letters are ``und`` with score 0 and are rejected; if no language was learned all are
``und``, and those with letters are accepted; ties go to the language that sorts first.  Equal
texts get equal results.  An empty table gives an empty result; other columns may have any names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, mix64, slices, text_list, tidy

WORD = re.compile(r"[^\W\d_]+")
HELD = 5  # every so manieth sampled document calibrates
MOST_SHIPPED = 256 << 20


def lettered(words: list[str]) -> bool:
    """Whether a letter is among them: raised digits and the like also pass for word characters."""
    return any(map(str.isalpha, words)) or any(c.isalpha() for w in words for c in w)


def stream(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the words with an edge mark on both sides, the place of each in its word,
    and where each word begins."""
    text = "".join(f" {w} " for w in words)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(U64)
    size = np.fromiter((len(w) + 2 for w in words), dtype=np.int64, count=len(words))
    start = np.cumsum(size) - size
    return c, np.arange(len(c)) - np.repeat(start, size), start


def hashes(c: np.ndarray, order: int) -> list[np.ndarray]:
    """For k = 1 .. order the hash of the k letters that end at each place."""
    out, base = [], U64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        h = np.zeros(len(c), dtype=U64)
        power = U64(1)
        for k in range(1, order + 1):
            back = np.zeros(len(c), dtype=U64)
            back[k - 1 :] = c[: max(0, len(c) - k + 1)] + U64(1)
            h = h + back * power
            power = power * base
            out.append(mix64(h + U64(k) * U64(0xD1B54A32D192ED03)))
    return out


@dataclass
class Postings:
    """Values by gram hash and language: gram i has the entries ``edge[i]`` to ``edge[i + 1]``."""

    keys: np.ndarray
    edge: np.ndarray
    lang: np.ndarray
    value: np.ndarray

    @property
    def nbytes(self) -> int:
        return self.keys.nbytes + self.edge.nbytes + self.lang.nbytes + self.value.nbytes

    @staticmethod
    def of(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> Postings:
        """From (language, sorted hashes, values) of each language."""
        key = np.concatenate([k for _, k, _ in parts] or [np.zeros(0, dtype=U64)])
        lang = np.repeat(np.array([i for i, _, _ in parts], dtype=np.int32), [len(k) for _, k, _ in parts])
        value = np.concatenate([v for *_, v in parts] or [np.zeros(0)]).astype(np.float32)
        order = np.argsort(key, kind="stable")
        keys, first = np.unique(key[order], return_index=True)
        return Postings(keys, np.append(first, len(key)).astype(np.int64), lang[order], value[order])

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index into h, language, value) of all entries of the hashes."""
        if not len(self.keys):
            return np.zeros(0, dtype=np.int64), self.lang, self.value
        i = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        at = np.flatnonzero(self.keys[i] == h)
        i = i[at]
        n = self.edge[i + 1] - self.edge[i]
        entry = np.repeat(self.edge[i] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.repeat(at, n), self.lang[entry], self.value[entry]


@dataclass
class Model:
    langs: list[str]
    order: int
    letters: int
    grams: list[Postings]  # per order: discounted probabilities
    contexts: list[Postings]  # per order: back-off weights
    usual: np.ndarray | None = None
    excess: np.ndarray | None = None
    bound: np.ndarray | None = None
    sharpness: float = 30.0

    @property
    def nbytes(self) -> int:
        return sum(p.nbytes for p in [*self.grams, *self.contexts])

    def words(self, words: list[str]) -> np.ndarray:
        """Log-likelihood of each word under each language."""
        c, place, start = stream(words)
        h = hashes(c, self.order)
        p = np.full((len(c), len(self.langs)), 1.0 / self.letters)
        for k in range(1, self.order + 1):
            at = np.flatnonzero(place >= max(1, k - 1))
            i, lang, weight = self.contexts[k - 1].find(h[k - 2][at - 1] if k > 1 else np.zeros(len(at), dtype=U64))
            p[at[i], lang] *= weight
            i, lang, value = self.grams[k - 1].find(h[k - 1][at])
            p[at[i], lang] += value
        p = np.log(p)
        p[place == 0] = 0
        return np.add.reduceat(p, start, axis=0)


Fit = list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def fit(counts: dict[str, int], order: int) -> Fit:
    """One language: per order gram hashes and discounted probabilities, history hashes and back-off weights."""
    out: Fit = []
    words = sorted(counts)
    c, place, start = stream(words)
    size = np.diff(np.append(start, len(c)))
    weight = np.repeat(np.array([counts[w] for w in words], dtype=np.float64), size)
    h = hashes(c, order)
    for k in range(order, 0, -1):
        at = np.flatnonzero(place >= max(1, k - 1))
        ctx = h[k - 2][at - 1] if k > 1 else np.zeros(len(at), dtype=U64)
        keys, first, inverse = np.unique(h[k - 1][at], return_index=True, return_inverse=True)
        if k == order:
            n = np.bincount(inverse, weights=weight[at], minlength=len(keys))
        else:  # distinct letters to the left; a gram at the start of a word has none and keeps its count
            longer = np.flatnonzero(place >= k)
            _, one = np.unique(h[k][longer], return_index=True)
            to = np.searchsorted(keys, h[k - 1][longer[one]])
            n = np.bincount(to, minlength=len(keys)).astype(np.float64)
            if k > 1:
                head = place[at] == k - 1
                n += np.bincount(inverse[head], weights=weight[at][head], minlength=len(keys))
        n1, n2 = (n == 1).sum(), (n == 2).sum()
        d = min(0.9, max(0.1, n1 / max(1, n1 + 2 * n2)))
        above, where = np.unique(ctx[first], return_inverse=True)
        total = np.bincount(where, weights=n)
        # what the discounts take from the grams of a history goes to the shorter one
        out.append((keys, np.maximum(n - d, 0) / total[where], above, np.bincount(where, weights=np.minimum(n, d)) / total))
    return out[::-1]


def assembled(fits: dict[str, Fit], letters: int, order: int) -> Model:
    langs = sorted(fits)
    pick = lambda k, a: Postings.of([(i, fits[lang][k][a], fits[lang][k][a + 1]) for i, lang in enumerate(langs)])
    return Model(langs, order, letters, [pick(k, 0) for k in range(order)], [pick(k, 2) for k in range(order)])


def estimate(counts: dict[str, dict[str, int]], order: int = 5) -> Model:
    """Interpolated Kneser-Ney models from word counts a language."""
    letters = len({c for n in counts.values() for w in n for c in w}) + 2
    return assembled({lang: fit(n, order) for lang, n in counts.items() if n}, letters, order)


class Scorer:
    """Scores texts with a bounded memory of words already scored."""

    def __init__(self, model: Model, most: int = 200_000):
        # rows hold a value a language: fewer words are kept, and scored at once, beyond 200 languages
        self.model, self.most = model, min(most, max(5_000, 200 * most // max(1, len(model.langs))))
        self.step = min(5_000, max(100, 1_000_000 // max(1, len(model.langs))))
        self.rows: dict[str, int] = {}
        self.values = np.zeros((0, len(model.langs)))
        self.filled = 0

    def totals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihoods (text x language) and letters with word ends of each text."""
        found = [w if lettered(w) else [] for w in (WORD.findall(t.lower()) for t in texts)]
        new = set().union(*found) - self.rows.keys() if found else set()
        if self.filled + len(new) > self.most:
            self.rows.clear()
            self.filled = 0
            new = set().union(*found)
        fresh = sorted(new)
        if self.filled + len(fresh) > len(self.values):
            grown = np.zeros((max(self.filled + len(fresh), min(self.most, 2 * len(self.values))), len(self.model.langs)), dtype=np.float32)
            grown[: self.filled] = self.values[: self.filled]
            self.values = grown
        for i in range(0, len(fresh), self.step):
            part = fresh[i : i + self.step]
            self.values[self.filled : self.filled + len(part)] = self.model.words(part)
            self.rows.update(zip(part, range(self.filled, self.filled + len(part))))
            self.filled += len(part)
        n = np.array([sum(map(len, w)) + len(w) for w in found], dtype=np.float64)
        out = np.zeros((len(texts), len(self.model.langs)))
        get = self.rows.__getitem__
        for i, w in enumerate(found):
            if w:
                out[i] = self.values[np.fromiter(map(get, w), dtype=np.int64, count=len(w))].sum(0, dtype=np.float64)
        return out, n

    def predict(self, texts: list[str]) -> list[tuple[str, float, float, bool]]:
        """(language, score, cross-entropy a letter, accepted) of each text."""
        if not self.model.langs:
            return [("und", 0.0, 0.0, lettered(WORD.findall(t.lower()))) for t in texts]
        total, n = self.totals(texts)
        each = total / np.maximum(n, 1)[:, None]
        best = each.argmax(1)
        top = each[np.arange(len(texts)), best]
        score = 1 / np.exp(self.model.sharpness * (each - top[:, None])).sum(1)
        ok = n > 0
        if self.model.usual is not None:
            off = -top - self.model.usual[best]
            ok &= ~((off > self.model.excess[best]) & (off * np.sqrt(n) > self.model.bound[best]))
        return [(self.model.langs[b], float(s), float(-t), bool(a)) if m else ("und", 0.0, 0.0, False) for b, s, t, a, m in zip(best, score, top, ok, n)]


def calibrated(model: Model, held: list[tuple[str, str]], false_rejections: float = 1e-6, least: int = 20) -> Model:
    """Sets what decides on rejection and the scores, from documents (language, text) that the
    models have not seen; those with fewer than ``least`` letters are left out."""
    count = len(model.langs)
    total, n = Scorer(model).totals([t for _, t in held]) if held else (np.zeros((0, count)), np.zeros(0))
    long = n >= least
    each, n = -total[long] / n[long][:, None], n[long]
    label = np.array([model.langs.index(lang) for lang, _ in held], dtype=np.int64)[long]
    model.usual, model.excess, model.bound = np.zeros(count), np.zeros(count), np.full(count, np.inf)
    for k in range(count):
        mine = label == k
        if not mine.any():
            continue
        model.usual[k] = np.median(each[mine, k])
        off = np.abs((each[mine, k] - model.usual[k]) * np.sqrt(n[mine]))
        model.bound[k] = np.log(1 / false_rejections) * off.mean() if mine.sum() > 1 else np.inf
        if (~mine).any():
            model.excess[k] = max(0.0, np.quantile(each[~mine, k], 0.05) - model.usual[k])
        else:
            model.excess[k] = max(0.0, (np.log(model.letters) - model.usual[k]) / 2)
    if len(label):
        gap = each.min(1, keepdims=True) - each
        fits = {x: (x * gap[np.arange(len(label)), label] - np.log(np.exp(x * gap).sum(1))).mean() for x in (1.0, 2.0, 5.0, 10.0, 20.0, 30.0, 50.0, 100.0)}
        model.sharpness = max(fits, key=lambda x: (fits[x], -x))
    return model


def held_out(id_col):
    """Documents kept from training: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def trained(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = 300, sample_chars: int = 8_000, sample_letters: int = 20_000_000, order: int = 5, most_bytes: int = MOST_SHIPPED) -> Model:
    """Models from a bounded sample of the labelled documents that are not held out."""
    rows = df.filter(df[lang_col].isNotNull() & df[text_col].isNotNull() & ~held_out(df[id_col]))
    sizes = rows.groupBy(rows[lang_col].alias("k")).agg(F.count("*").alias("n")).collect()
    if not sizes:
        return estimate({}, order)
    each = sample_letters // len(sizes)
    most_rows = min(sample_rows, max(10, each // 500))
    chars = min(sample_chars, max(20, each // most_rows))
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r.k, most_rows / r.n)])
    # the same rows for the same table: a digest of id and text decides
    chance = F.pmod(F.xxhash64(F.lit("lang"), rows[id_col], rows[text_col]), F.lit(1 << 30)) / float(1 << 30)
    picked = rows.filter(chance < F.element_at(share, rows[lang_col])).select(rows[lang_col].alias("lang"), F.substring(rows[text_col], 1, chars).alias("t")).distinct()

    def learn(table: pa.Table) -> pa.Table:
        """One language: a row an order, the letters, and the texts kept out."""
        lang, texts = table.column("lang")[0].as_py(), sorted(table.column("t").to_pylist())
        held = texts[HELD - 1 :: HELD]
        counts = Counter(w for i, t in enumerate(texts) if i % HELD != HELD - 1 for w in WORD.findall(t.lower()))
        out = []
        if counts:
            for k, arrays in enumerate(fit(counts, order)):
                out.append((lang, k, *(a.astype(kind).tobytes() for a, kind in zip(arrays, (U64, np.float32) * 2)), None))
            out.append((lang, -1, None, None, None, None, "".join(sorted({c for w in counts for c in w}))))
            out += [(lang, -2, None, None, None, None, t) for t in held]
        tidy()
        return pa.Table.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*out) if out else [[]] * 7, [pa.string(), pa.int32()] + [pa.binary()] * 4 + [pa.string()])], names=["lang", "k", "a", "b", "c", "d", "t"])

    found = picked.groupBy("lang").applyInArrow(learn, "lang string, k int, a binary, b binary, c binary, d binary, t string").collect()
    fits: dict[str, Fit] = {}
    for r in sorted((r for r in found if r.k >= 0), key=lambda r: (r.lang, r.k)):
        fits.setdefault(r.lang, []).append(tuple(np.frombuffer(x, dtype=kind) for x, kind in zip((r.a, r.b, r.c, r.d), (U64, np.float32) * 2)))
    model = assembled(fits, len(set().union(*(r.t for r in found if r.k == -1))) + 2, order)
    if model.nbytes > most_bytes and sample_letters > 1_000:
        return trained(df, id_col, text_col, lang_col, sample_rows, sample_chars, sample_letters // 2, order, most_bytes)
    return calibrated(model, sorted((r.lang, r.t) for r in found if r.k == -2))


def identified(df: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = (), batch_bytes: int = 2 << 20) -> DataFrame:
    """``keep`` columns with lang_pred, score, entropy and accepted; one narrow pass."""
    rows = df.select(*[df[c] for c in keep if c != text_col], df[text_col].alias("__text"))
    kept = [c for c in keep if c != text_col]
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept), *(["`%s` string" % text_col] if text_col in keep else []), "lang_pred string, score double, entropy double, accepted boolean"])

    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by ``most_bytes`` of ``trained``

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
        for whole in batches:
            for b in slices(whole, "__text", batch_bytes):
                found = scorer.predict(text_list(b.column("__text")))
                columns = [b.column(c) for c in kept] + [b.column("__text")] * (text_col in keep)
                names = kept + [text_col] * (text_col in keep) + ["lang_pred", "score", "entropy", "accepted"]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(c, type=k) for c, k in zip(zip(*found), kinds))], names=names)
        del scorer
        tidy()

    return rows.mapInArrow(run, schema)


def accepted_only(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose text is accepted; all columns stay as they are."""

    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by ``most_bytes`` of ``trained``

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for whole in batches:
            for b in slices(whole, text_col, 2 << 20):
                yield b.filter(pa.array([ok for *_, ok in scorer.predict(text_list(b.column(text_col)))], type=pa.bool_()))
        del scorer
        tidy()

    return df.mapInArrow(run, df.schema)
