from __future__ import annotations

import random
import unicodedata
import zlib

import numpy as np
import pytest
import regex
from strandline.llm import packing, tokens
from strandline.llm.queries import vocabulary

from .conftest import edge_rows, words

TEXTS = ["", " ", "it's we're !!'s don'T 'S ", "ΑΣ ΣΑΣ İ K ſ ǅ", "<|endoftext|> a <|startoftext|>b", "a<|EndOfText|>", "x\x1cy\x85z", "é é ﬁ １２ ² ½", "🙂🙂 c++ a_b __", "₝¬ unassigned ͸ here", "日本語 한국어", "ß ẞ"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


def mixed_texts(n: int) -> list[str]:
    rng = random.Random(3)
    wide = [chr(c) for c in [*range(0x20, 0x250), *range(0x300, 0x460), *range(0x1E00, 0x2100), *range(0xAC00, 0xAC20), 0x1F600]]
    known = [c for c in wide if unicodedata.category(c) != "Cn"]
    pools = [wide, known, known, "abcdexyz'rsl !1", "abcdefghijklmnopqrstuvwxyz ", "ate", "the and ing 's 're \n"]
    return TEXTS + ["".join(rng.choices(pools[i % len(pools)], k=rng.randint(1, 80))) for i in range(n)]


def test_counts_and_ids_are_the_library_s(library):
    machine = tokens.Transducer(vocabulary())
    texts = mixed_texts(10_000)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert machine.counts(texts) == [len(w) for w in want]
    assert [list(x) for x in machine.ids(texts)] == want
    # the states are dropped again and again
    small = tokens.Transducer(vocabulary(), max_states=200)
    for i in range(0, 600, 50):
        assert small.counts(texts[i : i + 50]) == [len(w) for w in want[i : i + 50]]


def test_no_library_runs_but_for_unknown_code_points(monkeypatch, library):
    machine = tokens.Transducer(vocabulary())
    texts = ["plain words it's", "日本語 été", words(3, 500)]
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    monkeypatch.setattr(tokens.Transducer, "whole", property(lambda self: pytest.fail("the library was called")))
    assert machine.counts(texts) == want and machine.by_library == 0


def test_cutter_is_the_pattern():
    cutter = tokens.Cutter(["'s", "'t", "'re", "'ve", "'m", "'ll", "'d"], chunk=16)
    pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ a-z0-9]+")
    kind = {c: 3 for c in "ab"} | {c: 4 + i for i, c in enumerate(cutter.signs)} | {"1": 1, "!": 2, " ": 0}
    rng = random.Random(1)
    for n in [0, 1, 2, 15, 16, 17, *(rng.randint(1, 300) for _ in range(400))]:
        text = "".join(rng.choices("ab1! '''srvletmd", k=n))
        found = cutter.starts(np.array([kind[c] for c in text], dtype=np.uint8))
        assert np.flatnonzero(found).tolist() == [m.start() for m in pattern.finditer(text)]


def test_chunk_maps_compose_by_a_scan():
    cutter = tokens.Cutter(["'s", "'re"])
    x = np.random.default_rng(2).integers(0, 8, (5, 37)).astype(np.uint8)
    maps = cutter.maps(x, ahead=2)
    left = tokens.scan(maps)
    for state in range(len(cutter.states)):
        s = state << cutter.SHIFT
        for i in range(x.shape[1]):
            alone = [k << cutter.SHIFT for k in range(len(cutter.states))]
            for c in x[:, i]:
                s = int(cutter.next[s + c])
                alone = [int(cutter.next[k + c]) for k in alone]
            assert left[state, i] == s >> cutter.SHIFT and maps[:, i].tolist() == [k >> cutter.SHIFT for k in alone]


def test_transitions_add_up(library):
    machine = tokens.Transducer(vocabulary()).speller
    for word in ("theatre", "internationalization", "zzzzzzzz", "aaaaaaaaa", "x"):
        raw = np.frombuffer(word.encode(), dtype=np.uint8)
        states = machine.walk(raw, np.array([len(raw)]))
        together = machine.walk(np.tile(raw, 20), np.full(20, len(raw)))
        assert states.tolist() == together[: len(raw)].tolist()
        assert sum(machine.adds[s] for s in states) == len(library.encode(word, add_special_tokens=False).ids)


def test_equal_hashes_of_different_words(monkeypatch):
    monkeypatch.setattr(tokens, "mix64", lambda x: np.zeros(len(x), dtype=np.uint64))
    letters = np.frombuffer("abxyabxyq".encode("utf-32-le"), dtype="<u4")
    first, length = np.array([0, 2, 4, 6, 8]), np.array([2, 2, 2, 2, 1])
    which, example = tokens._distinct(letters, first, length)
    spelled = [letters[first[e] : first[e] + length[e]].tolist() for e in example[which]]
    assert spelled == [letters[a : a + n].tolist() for a, n in zip(first, length)]


def test_very_long_texts(library):
    machine = tokens.Transducer(vocabulary())
    texts = [words(1, 700_000), "q" * 300_000, "ab" * 600_000 + " c", "été " * 300_000]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert machine.counts(texts) == [len(w) for w in want]
    assert [x.tolist() for x in machine.ids(texts)] == want


def test_counts_of_edge_rows(edges, nothing, library):
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.token_counts(edges, vocabulary()).collect())
    want = []
    for k, t, *_ in edge_rows():
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((k or 0, len((t or "").encode()), n, n > 2048))
    assert got == sorted(want)
    assert tokens.token_counts(nothing, vocabulary()).count() == 0


def test_pack_properties():
    rng = random.Random(5)
    for _ in range(200):
        lengths = [rng.choice([1, 5, 100, 2048, 3000, 700, rng.randint(1, 5000)]) for _ in range(rng.randint(0, 50))]
        pieces, windows = packing.pack(lengths), {}
        for i, n in enumerate(lengths):
            mine = sorted((s, m) for j, s, m, _, _ in pieces if j == i)
            assert mine[0][0] == 0 and sum(m for _, m in mine) == n and all(a + m == b for (a, m), (b, _) in zip(mine, mine[1:]))
        for _, _, n, w, o in pieces:
            windows.setdefault(w, []).append((o, n))
        for parts in windows.values():
            parts.sort()
            total = sum(n for _, n in parts)
            assert parts[0][0] == 0 and all(o + n == p for (o, n), (p, _) in zip(parts, parts[1:]))
            assert total <= 2048 and total & (total - 1) == 0
        assert sorted(windows) == list(range(len(windows)))
    assert packing.pack([]) == []


def test_packed_edge_rows(edges, nothing, library):
    rows = packing.pack_documents(edges, vocabulary(), hold_tokens=5_000).collect()
    seen = {}
    for r in rows:
        seen.setdefault(r.doc_id, []).append(r)
    total = 0
    for k, t, *_ in edge_rows():
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        total += len(ids)
        if k != 17:  # two rows share this id
            mine = sorted(seen[k], key=lambda r: r.start)
            assert [r.start for r in mine] == list(np.cumsum([0, *(r.length for r in mine)])[:-1]) and sum(r.length for r in mine) == len(ids)
            assert all(r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in mine)
    assert sum(r.length for r in rows) == total and sum(r.doc_id == 17 for r in rows) >= 2
    filled = {}
    for r in rows:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in filled.values():
        parts.sort()
        assert [o for o, _ in parts] == list(np.cumsum([0, *(n for _, n in parts)])[:-1])
    assert packing.pack_documents(nothing, vocabulary()).count() == 0


def windows_of(pieces) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for _, _, n, w, _ in pieces:
        out.setdefault(w, []).append(n)
    return out


def test_tiers_are_packed_at_their_own_size():
    rng = random.Random(9)
    lengths = [rng.randint(20, 300) for _ in range(5_000)]
    found = windows_of(packing.pack(lengths))
    made = [sum(parts) for parts in found.values()]
    # the longest pieces need 512, nothing is stretched to the longest window; several tiers get windows
    assert max(made) == 512 and {512, 256, 128, 64} <= set(made)
    short = [w for w, parts in found.items() if 2 * max(parts) <= sum(parts)]
    assert all(w >= len(found) - 10 for w in short)  # but the tail, a window holds a piece of its own tier
    assert any(len(parts) >= 3 for parts in found.values())  # and shorter tiers fill what is open
    assert windows_of(packing.pack([1000, 20, 4])) == {0: [1000, 20, 4]}
    assert windows_of(packing.pack([2048 + 300, 100, 100, 12])) == {0: [2048], 1: [300, 100, 100, 12]}
    assert sorted(map(sum, windows_of(packing.pack([64] * 3 + [30, 2])).values())) == [32, 64, 64, 64]
    assert sorted(map(sum, windows_of(packing.pack([1] * 40_000)).values())) == [1] * 40_000


def test_tiers_and_step_groups_of_rows(spark):
    docs = spark.createDataFrame([(i, words(i, 1 + 37 * i % 400)) for i in range(400)] + [(400, words(7, 9_000))], "doc_id bigint, text string").coalesce(1)
    rows = packing.pack_documents(docs, vocabulary()).collect()
    tier, group, filled = {}, {}, {}
    for r in rows:
        tier[r.sequence_id], group[r.sequence_id] = r.tier, r.step_group
        filled[r.sequence_id] = filled.get(r.sequence_id, 0) + r.length
    assert tier == filled and len(set(tier.values())) >= 4  # the tier is the size of the window
    tokens_, tiers = {}, {}
    for s, g in group.items():
        tokens_[g] = tokens_.get(g, 0) + filled[s]
        tiers.setdefault(g, set()).add(tier[s])
    last = max(tokens_)
    assert len(tokens_) > 3 and all(n == 8 * 2048 for g, n in tokens_.items() if g != last) and tokens_[last] <= 8 * 2048
    order = sorted(tiers)
    assert all(min(tiers[a]) >= max(tiers[b]) for a, b in zip(order, order[1:]))  # from the longest tier down
