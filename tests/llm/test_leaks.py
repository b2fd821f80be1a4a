import itertools
import random

import numpy as np

from pluvion.llm.leaks import WINDOW, Patterns, best_score, has_passage, leaks, own_weights, own_words
from pluvion.llm.texts import words

VOCAB = [a + b for a, b in itertools.product("bcdfghjklm", ["aro", "eni", "ulo", "osti", "ima", "andu"])]
HEAD = "Consider the following situation in a small code base."


def passage(rng, n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def test_search_equals_brute_force():
    rng = random.Random(1)
    items = [(i, passage(rng, 40).split(), np.ones(40)) for i in range(12)]
    p = Patterns(items)
    text = [w for i in range(60) for w in (passage(rng, 30).split() + items[i % 12][1][i % 30 : i % 30 + 9])]
    ids = np.array([p.vocabulary.get(w, 0) for w in text])
    ends, pattern = p.search(ids)
    known = {tuple(w): n for n, w in enumerate(p.words.tolist())}
    want = {(e, known[tuple(ids[e - 3 : e + 1])]) for e in range(3, len(ids)) if tuple(ids[e - 3 : e + 1]) in known}
    assert set(zip(ends.tolist(), pattern.tolist())) == want and len(want) > 300
    # the tables keep their size, however many words there are
    many = Patterns([(i, [f"w{i}x{j}" for j in range(60)], np.ones(60)) for i in range(1500)])
    assert len(many.shift) == len(p.shift) and len(many.keys) == 1500 * (60 - WINDOW + 1)


def test_alignment():
    a, one = np.arange(1, 31), np.ones(30)
    assert best_score(a, a, one) == 30
    assert best_score(np.delete(a, 15), a, one) == 29 - 1
    b = a.copy()
    b[15] = 99
    assert best_score(b, a, one) == 29 - 2
    assert has_passage(b, a, one) and has_passage(np.delete(a, 15), a, one) and has_passage(np.insert(a, 9, 77), a, one)
    assert not has_passage(a[:11], a, one) and not has_passage(a, a, np.zeros(30))


def test_words_of_a_form_weigh_nothing():
    rng = random.Random(4)
    form = lambda: f"suppose {rng.choice(VOCAB)} workers {rng.choice(VOCAB)} the {rng.choice(VOCAB)} at once which of them can still be {rng.choice(VOCAB)}".split()
    w = own_weights([form() for _ in range(40)])
    assert all((x[[0, 2, 4, 6, 7, 8, 9, 10, 11, 12, 13]] == 0).all() and (x[[1, 3, 5, 14]] > 0.6).all() for x in w)
    alike = passage(rng, 60)
    assert all((x > 0.99).all() for x in own_weights([f"{alike} {passage(rng, 5)}".split() for _ in range(5)]))


def test_found_altered_and_not_found(rows):
    rng = random.Random(2)
    items = [(i, f"{HEAD}\n\n{passage(rng, 60)}") for i in range(8)] + [(8, passage(rng, 60)), (9, None), (10, ""), (11, "two words")]
    own = dict(own_words(items))
    assert len(own[0]) == 60
    part = lambda i, a, b: " ".join(own[i][a:b])
    altered = own[3][10:40]
    altered[8], altered[20] = "other", "words"
    docs = [
        (1, f"fix: {passage(rng, 30)} {part(0, 5, 25)} {passage(rng, 30)}"),
        (2, f"{passage(rng, 10)}\n+ {part(1, 0, 20).upper().replace(' ', chr(10) + '+ ')}"),
        (3, " ".join(altered)),
        (4, f"{passage(rng, 20)} {part(2, 0, 7)} {passage(rng, 20)}"),
        (5, HEAD + " " + passage(rng, 40)),
        (6, None), (7, ""), (8, passage(rng, 20_000) + " " + items[8][1]),
        (1, f"{part(0, 5, 25)}"),
        (9, "{" + f'"message": "a\\n{part(4, 0, 10)}\\n{part(4, 10, 30)}", "diff": ""' + "}"),
        (10, part(5, 3, 33).replace("a", "а").replace(" ", " ", 4)),
    ]
    got = sorted((r["doc_id"], r["item_id"]) for r in leaks(rows([(i, t, 5) for i, t in docs], "doc_id long, text string, item_id int"), items, "doc_id", "text").distinct().collect())
    assert got == [(1, 0), (2, 1), (3, 3), (8, 8), (9, 4), (10, 5)]


def test_without_items_or_documents(rows):
    docs = rows([(1, "a b c")], "doc_id long, text string")
    assert leaks(docs, [], "doc_id", "text").count() == 0
    assert leaks(docs.limit(0), [(1, "x y z " * 20)], "doc_id", "text").count() == 0


def test_words():
    assert words("<p>Bee­hive s​its</p>") == ["beehive", "sits"] and words(None) == []


def test_dozen_to_twenty_words_exact_and_altered(rows):
    rng = random.Random(5)
    items = [(i, passage(rng, 60)) for i in range(30)] + [(40, passage(rng, 14))]
    own = dict(own_words(items))
    docs, want = [(900, f"{passage(rng, 30)} {' '.join(own[1][20:31])} {passage(rng, 30)}"), (901, f"{passage(rng, 9)} {' '.join(own[40])}")], [(901, 40)]
    for n in range(12, 21):
        for i, change in enumerate(("exact", "altered", "lost", "added")):
            part = own[n][15 : 15 + n]
            if change == "altered":
                part[n // 2] = "other"
            if change == "lost":
                del part[n // 2]
            if change == "added":
                part.insert(n // 2, "more")
            docs.append((n * 10 + i, f"{passage(rng, 30)} {' '.join(part)} {passage(rng, 30)}"))
            want.append((n * 10 + i, n))
    got = sorted((r["doc_id"], r["item_id"]) for r in leaks(rows(docs, "doc_id long, text string"), items, "doc_id", "text").collect())
    assert got == sorted(want)


def test_items_that_share_all_they_have(rows, monkeypatch):
    """The same item under five suites, five near-duplicates, an item made of parts of others, and a form that many have; the same in one pass and in many."""
    from pluvion.llm import leaks as module

    rng = random.Random(6)
    copied, body, parts, form = f"{passage(rng, 20)}\n\n{passage(rng, 40)}", passage(rng, 60), [passage(rng, 15) for _ in range(2)], passage(rng, 14)
    items = [(i, copied) for i in range(5)] + [(5, " ".join(parts))] + [(6 + i, f"{passage(rng, 30)} {' '.join(parts)} {passage(rng, 30)}") for i in range(4)]
    items += [(20 + i, f"{passage(rng, 30)} {form} {passage(rng, 30)}") for i in range(12)] + [(40 + i, f"{passage(rng, 8)} {body}") for i in range(5)]
    docs = [(1, f"{passage(rng, 30)} {copied}"), (3, f"{passage(rng, 30)} {form} {passage(rng, 30)}"), (4, f"{passage(rng, 9)} {' '.join(body.split()[20:34])}")]
    found = []
    for most in (4_000_000, 100):
        monkeypatch.setattr(module, "PASS_WORDS", most)
        found.append(sorted((r["doc_id"], r["item_id"]) for r in leaks(rows(docs, "doc_id long, text string"), items, "doc_id", "text").collect()))
    assert found[0] == [(1, i) for i in range(5)] + [(4, 40 + i) for i in range(5)] and found[1] == found[0]
    assert all(len(ws) == 60 for i, ws in own_words(items) if i < 5)


def test_ten_thousand_items(rows):
    rng = random.Random(7)
    items = [(i, passage(rng, 40)) for i in range(10_000)]
    own = dict(own_words(items[:20]))
    docs = [(i, f"{passage(rng, 20)} {' '.join(own[i][9 : 21 + i])} {passage(rng, 20)}") for i in range(16)]
    got = {(r["doc_id"], r["item_id"]) for r in leaks(rows(docs, "doc_id long, text string"), items, "doc_id", "text").collect()}
    assert got == {(i, i) for i in range(16)}
