import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pluvion.llm.packing import packed, plan, token_counts


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 63), st.integers(1, 40), max_size=20))
def test_plan_places_every_rank_once_without_overlap(histogram):
    rows = plan(list(histogram.items()), 64)
    slots, ranks = defaultdict(list), Counter()
    for length, a, b, first, per, offset in rows:
        for r in range(a, b):
            ranks[length, r] += 1
            slots[first + (r - a) // per].append((offset + (r - a) % per * length, length))
    assert ranks == Counter((n, r) for n, c in histogram.items() for r in range(c))
    for s in slots.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(n * c for n, c in histogram.items())
    assert len(slots) <= 2 * -(-total // 64) + 1


@pytest.mark.parametrize("part_rows", [50_000, 70])
def test_documents_take_the_slots(rows, monkeypatch, part_rows):
    """Lengths ranked in one part each, and in many."""
    from pluvion.llm import packing

    monkeypatch.setattr(packing, "PART_ROWS", part_rows)
    rng = random.Random(4)
    sizes = [(i, rng.choice([5, 5, 5, 9, 30, 64, 65, 200, 0])) for i in range(3000)] + [(None, 7), (1, 5), (1, 5)]
    out = packed(rows(sizes, "id long, n_tokens int"), {"s": 64, "l": 100}, "id").collect()
    for kind, cap in (("s", 64), ("l", 100)):
        mine = [r for r in out if r["bin_kind"] == kind]
        assert sum(r["n_tokens"] for r in mine) == sum(n for _, n in sizes)
        assert all((r["container"] is None) == (r["n_tokens"] == 0) for r in mine)
        uncut = Counter(n for _, n in sizes if n <= cap)
        assert uncut == Counter(r["n_tokens"] for r in mine if r["piece"] == 0 and r["n_tokens"] < cap or r["n_tokens"] == cap and not any(n > cap and i == r["id"] for i, n in sizes))
        slots = defaultdict(list)
        for r in mine:
            if r["container"]:
                slots[r["container"]].append((r["offset"], r["n_tokens"]))
        for s in slots.values():
            at = 0
            for offset, n in sorted(s):
                assert offset == at
                at += n
            assert at <= cap


def test_tokens_of_dirt(rows):
    texts = [(1, ""), (2, None), (3, "<|endoftext|>"), (4, "hello world"), (5, "a" * 100_000), (5, "hello world")]
    got = sorted((r["id"], r["n_tokens"]) for r in token_counts(rows([(i, t, "x") for i, t in texts], "id long, text string, n_tokens string"), "id", "text").collect())
    assert got[:2] == [(1, 0), (2, 0)] and got[2][1] > 1 and got[3] == (4, 2) and got[5][1] > 1000


def test_empty(rows):
    assert packed(rows([], "id long, n_tokens int"), {"s": 64}, "id").count() == 0


def test_full_pieces_of_equal_keys_have_containers_of_their_own(rows):
    sizes = [("1", 64), ("1", 64), ("1", 130), (None, 64), (None, 64), (None, 128), ("?", 64), ("1.0", 64), ("1.0", 64), ("1", 0), ("1", 0)]
    out = packed(rows(sizes, "id string, n_tokens int"), {"s": 64}, "id").collect()
    full = Counter(r["container"] for r in out if r["n_tokens"] == 64)
    assert sum(full.values()) == 11 and set(full.values()) == {1}
    assert sum(r["n_tokens"] for r in out) == sum(n for _, n in sizes)
