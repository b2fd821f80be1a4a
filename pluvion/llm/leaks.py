"""Passages of evaluation items in the corpus (problem 8).

Wu and Manber's multi-pattern search over words: the patterns are the windows of ``WINDOW`` words of an item that hold words of its own. A hashed table
of fixed size over pairs of words says how far the search may jump from a pair that ends nowhere in a pattern; where it may not jump, the bucket of
patterns with that hash is looked up and compared word by word. A confirmed occurrence is a seed; around the seeds of an item in a document a local
alignment of the words decides.

How much a word of an item is its own follows from all items: the chance of the word given its neighbours, as counted in the other items, is near one for
the words of a sentence form and small for the words that fill it. Items that share most of their running dozens of words are one group, so that
near-duplicates do not make each other's content common. In the alignment a word counts ``FORM`` plus the rest of one by its weight.
"""

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvion.llm.texts import words
from pluvion.sources.tables import table

#: Words of a pattern and of a block of the shift table, and cells of that table.
WINDOW, BLOCK, CELLS = 4, 2, 1 << 20
#: The dozen: words that a passage spans at least.
DOZEN = 12
#: Score of a matched word that belongs to a form alone; of an altered one (and its weight's share); of an added or lost one.
FORM, ALTERED, ALTERED_OWN, GAP = 0.2, -0.5, -1.5, -1.0
#: Score of a passage; weight of its own words; weights under the last count as none.
LEAST, OWN, FAINT = 4.25, 2.5, 0.25
#: Own weight of a window that is a pattern, and of all windows of an item near each other that call for an alignment. Both lie well under what a passage has.
PATTERN_OWN, NEAR_OWN = 1.25, 1.5
#: Words between seeds of one passage, and words looked at beyond the outermost seeds.
NEAR, BEYOND = 40, 16
#: Words of items searched for in one pass over the corpus; more take further passes. Size of the whole item table, in characters, beyond which it is refused.
PASS_WORDS, MOST_TEXT = 1_000_000, 1 << 27
#: Words of a lane of the search.
LANE = 1024
#: Neighbours that a word is predicted from, by their distance.
NEIGHBOURS = [(-1,), (1,), (-2,), (2,), (-3,), (3,), (-2, -1), (1, 2), (-1, 1)]


def own_words(items: list[tuple[int, str | None]]) -> list[tuple[int, list[str]]]:
    """The words of each item without an opening that it shares with others. Items of equal words count once."""
    distinct = {" ".join(words(t)): t for _, t in items}
    heads = Counter(" ".join(words((t or "").split("\n\n", 1)[0])) for t in distinct.values())
    out = []
    for i, t in items:
        head, _, rest = (t or "").partition("\n\n")
        out.append((i, words(rest if heads[" ".join(words(head))] > 1 and rest.strip() else t)))
    return out


class Flat:
    """Some texts as one run of word numbers: ids, the text of each place, and where each text begins and ends."""

    def __init__(self, texts: list[list[str]]) -> None:
        numbers: dict[str, int] = {}
        self.sizes = np.array([len(ws) for ws in texts], dtype=np.int64)
        self.end = np.cumsum(self.sizes)
        self.begin = self.end - self.sizes
        self.ids = np.fromiter((numbers.setdefault(w, len(numbers) + 1) for ws in texts for w in ws), dtype=np.uint64, count=int(self.sizes.sum()))
        self.text = np.repeat(np.arange(len(texts)), self.sizes)


def mixed(h: np.ndarray, x: np.ndarray | int) -> np.ndarray:
    """A 64-bit hash of a hash and one more number."""
    h = (h ^ (np.asarray(x, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(31))


def times(h: np.ndarray) -> np.ndarray:
    """For each number, how often it occurs."""
    _, inverse, n = np.unique(h, return_inverse=True, return_counts=True)
    return n[inverse]


def groups_of(flat: Flat) -> np.ndarray:
    """A group number for each text: texts with half of their running dozens in common are near-duplicates. Each dozen points to the first text that holds it.

    A text of fewer words is one dozen. Dozens are compared by 64-bit hashes.
    """
    texts = len(flat.sizes)
    width = np.minimum(flat.sizes, DOZEN)
    start = np.flatnonzero(np.arange(len(flat.ids)) + width[flat.text] <= flat.end[flat.text])
    h = np.zeros(len(start), dtype=np.uint64)
    for j in range(DOZEN):
        inside = j < width[flat.text[start]]
        h[inside] = mixed(h[inside], flat.ids[start[inside] + j])
    pairs = np.unique(np.stack([h, flat.text[start].astype(np.uint64)]), axis=1)
    h, holder = pairs[0], pairs[1].astype(np.int64)
    number = np.bincount(holder, minlength=texts)
    fresh = np.append(True, h[1:] != h[:-1]) if len(h) else np.zeros(0, bool)
    first = holder[np.maximum.accumulate(np.where(fresh, np.arange(len(h)), 0))] if len(h) else holder
    later = first != holder
    both, shared = np.unique(np.stack([holder[later], first[later]]), axis=1, return_counts=True)
    group = list(range(texts))

    def root(n: int) -> int:
        while group[n] != n:
            group[n] = group[group[n]]
            n = group[n]
        return n

    for n, m in both[:, 2 * shared >= np.maximum(number[both[0]], number[both[1]])].T.tolist():
        group[root(n)] = root(m)
    return np.array([root(n) for n in range(texts)], dtype=np.int64)


def own_weights(texts: list[list[str]]) -> list[np.ndarray]:
    """For each word of each text, 1 less its greatest chance given some neighbours, as the texts of other groups have it. Neighbours that others lack say nothing.

    Neighbours are compared by 64-bit hashes; a few arrays of one number a word are all that is held.
    """
    flat = Flat(texts)
    group = groups_of(flat)[flat.text].astype(np.uint64)
    chance = np.zeros(len(flat.ids))
    places = np.arange(len(flat.ids))
    for offsets in NEIGHBOURS:
        at = places[(places + min(offsets) >= flat.begin[flat.text]) & (places + max(offsets) < flat.end[flat.text])]
        near = np.zeros(len(at), dtype=np.uint64)
        for o in offsets:
            near = mixed(near, flat.ids[at + o])
        word = mixed(near, flat.ids[at])
        others = times(near) - times(mixed(near, group[at]))
        with_word = times(word) - times(mixed(word, group[at]))
        chance[at] = np.maximum(chance[at], with_word / (others + 2))
    weights = np.where(1 - chance < FAINT, 0.0, 1 - chance)
    return np.split(weights, flat.end[:-1]) if texts else []


class Patterns:
    """Tables of the search for some items: (names, words, weights of the words)."""

    def __init__(self, items: list[tuple]) -> None:
        self.vocabulary: dict[str, int] = {}
        self.items = []
        places = defaultdict(list)
        for n, (name, ws, weights) in enumerate(items):
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in ws], dtype=np.int64)
            self.items.append((name, ids, np.asarray(weights, float)))
            # an item without a window of its own is held by all of its windows
            own = np.convolve(weights, np.ones(WINDOW), "valid") if len(ids) >= WINDOW else np.empty(0)
            for p in np.flatnonzero(own >= PATTERN_OWN) if (own >= PATTERN_OWN).any() else range(len(own)):
                places[tuple(ids[p : p + WINDOW].tolist())].append((n, int(p)))
        self.words = np.array(sorted(places), dtype=np.int64).reshape(-1, WINDOW)
        # equal hashes of different windows would hide one of them, so another multiplier is taken until there are none
        for self.multiplier in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5):
            hashes = self.hashed([self.words[:, j] for j in range(WINDOW)])
            if len(np.unique(hashes)) == len(hashes):
                break
        order = np.argsort(hashes)
        self.keys, self.words = hashes[order], self.words[order]
        self.places = [places[tuple(w)] for w in self.words.tolist()]
        self.shift = np.full(CELLS, WINDOW - BLOCK + 1, dtype=np.int8)
        for end in range(BLOCK - 1, WINDOW):
            np.minimum.at(self.shift, self.cell(self.words[:, end - 1], self.words[:, end]), WINDOW - 1 - end)

    def hashed(self, columns: list[np.ndarray]) -> np.ndarray:
        h = np.zeros(len(columns[0]), dtype=np.uint64)
        for c in columns:
            h = (h ^ c.astype(np.uint64)) * np.uint64(self.multiplier)
            h ^= h >> np.uint64(29)
        return h

    @staticmethod
    def cell(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The cell of a pair of words. Pairs that share one jump as short as the shorter needs."""
        return ((a * 2654435761 + b * 40503) >> 7) & (CELLS - 1)

    def search(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ends of the occurrences in a run of word numbers, in order, and the patterns that stand there. All lanes jump side by side."""
        if len(ids) < WINDOW or not len(self.keys):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.arange(WINDOW - 1, len(ids), LANE)
        stop = np.minimum(at + LANE, len(ids))
        found = []
        while len(at):
            jump = self.shift[self.cell(ids[at - 1], ids[at])]
            found.append(at[jump == 0])
            at = at + np.maximum(jump, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        ends = np.sort(np.concatenate(found))
        columns = [ids[ends - WINDOW + 1 + j] for j in range(WINDOW)]
        bucket = np.minimum(np.searchsorted(self.keys, self.hashed(columns)), len(self.keys) - 1)
        same = (self.words[bucket] == np.stack(columns, axis=1)).all(axis=1)
        return ends[same], bucket[same]


def best_score(doc: np.ndarray, item: np.ndarray, weights: np.ndarray) -> float:
    """Score of the best local alignment of two runs of words."""
    row, best = np.zeros(len(item) + 1), 0.0
    ramp = -GAP * np.arange(len(item) + 1)
    matched, altered = FORM + (1 - FORM) * weights, ALTERED + ALTERED_OWN * weights
    for w in doc:
        new = np.maximum(row + GAP, 0.0)
        new[1:] = np.maximum(new[1:], row[:-1] + np.where(item == w, matched, altered))
        row = np.maximum.accumulate(new + ramp) - ramp
        best = max(best, row.max())
    return float(best)


def has_passage(doc: np.ndarray, item: np.ndarray, weights: np.ndarray) -> bool:
    """Whether some alignment has the score, spans a dozen words of the item and holds enough of its own. Stretches are told apart by their last word."""
    n = len(item)
    score, first, own = np.zeros(n + 1), np.arange(n + 1), np.zeros(n + 1)
    matched, altered = FORM + (1 - FORM) * weights, ALTERED + ALTERED_OWN * weights
    for w in doc:
        same = item == w
        down, step = score + GAP, score[:-1] + np.where(same, matched, altered)
        new, start, sum_ = np.maximum(down, 0.0), np.where(down > 0, first, np.arange(n + 1)), np.where(down > 0, own, 0.0)
        better = step > new[1:]
        new[1:], start[1:] = np.where(better, step, new[1:]), np.where(better, first[:-1], start[1:])
        sum_[1:] = np.where(better, own[:-1] + np.where(same, weights, 0.0), sum_[1:])
        lost = np.flatnonzero(new[:-1] + GAP > new[1:])
        while len(lost):  # words of the item that the document lacks
            new[lost + 1], start[lost + 1], sum_[lost + 1] = new[lost] + GAP, start[lost], sum_[lost]
            lost = np.flatnonzero(new[:-1] + GAP > new[1:])
        score, first, own = new, start, sum_
        if ((score[1:] >= LEAST) & same & (np.arange(1, n + 1) - first[1:] >= DOZEN) & (own[1:] >= OWN)).any():
            return True
    return False


def exact_dozen(doc: np.ndarray, item: np.ndarray, weights: np.ndarray, seeds: list[tuple[int, int]]) -> bool:
    """Whether an unbroken exact run with a seed in it is a dozen words long and holds enough of the item's own."""
    reach = {}
    for d, i in seeds:
        if d < reach.get(d - i, 0):
            continue
        a = b = 0
        while a < min(d, i) and doc[d - a - 1] == item[i - a - 1]:
            a += 1
        while d + b < len(doc) and i + b < len(item) and doc[d + b] == item[i + b]:
            b += 1
        reach[d - i] = d + b
        if a + b >= DOZEN and weights[i - a : i + b].sum() >= OWN:
            return True
    return False


def leaked(doc: np.ndarray, item: np.ndarray, weights: np.ndarray, seeds: list[tuple[int, int]]) -> bool:
    """Whether a passage of the item stands in the document. ``seeds``: (place in the document, place in the item), by the former."""
    near: list[list[tuple[int, int]]] = []
    for s in seeds:
        if near and s[0] - near[-1][-1][0] <= NEAR:
            near[-1].append(s)
        else:
            near.append([s])
    for g in near:
        covered = np.unique([i + j for _, i in g for j in range(WINDOW)])
        if weights[covered].sum() < NEAR_OWN:
            continue
        if exact_dozen(doc, item, weights, g):
            return True
        lo, hi = max(0, g[0][0] - BEYOND), g[-1][0] + WINDOW + BEYOND
        a, b = max(0, int(covered[0]) - BEYOND), int(covered[-1]) + 1 + BEYOND
        part = doc[lo:hi], item[a:b], weights[a:b]
        if best_score(*part) >= LEAST and has_passage(*part):
            return True
    return False


def passes(items: list[tuple[int, str | None]]) -> list[list[tuple]]:
    """Items of equal own words together, as (names, words, weights), in parts of ``PASS_WORDS`` words. Weights come from all items, whatever part they fall into."""
    same = defaultdict(list)
    for i, ws in own_words(items):
        same[tuple(ws)].append(i)
    texts = [list(ws) for ws in same]
    out, held = [[]], 0
    for ids, ws, weights in zip(same.values(), texts, own_weights(texts)):
        if held and held + len(ws) > PASS_WORDS:
            out.append([])
            held = 0
        out[-1].append((ids, ws, weights))
        held += len(ws)
    return out


def leaks(docs: DataFrame, items: list[tuple[int, str | None]], key: str, text: str) -> DataFrame:
    """key, item_id: one row per document and item with a passage of the item's own content.

    A passage spans a dozen words of the item at least: an unbroken exact run, or a run with altered, added or lost words whose score and own words suffice.
    Whole texts are searched, in one pass unless the items hold over ``PASS_WORDS`` words. The result for an item depends on other items only by what they
    say about its words. NULL and empty texts hold nothing; rows with equal keys and passages give one row each; an item of fewer than a dozen words
    cannot leak. Where an altered word is one that fills a sentence form, twelve words of that form alone look like another item's and are no passage.
    """
    schema = f"{key} {dict(docs.dtypes)[key]}, item_id int"
    found = []
    for part in passes(items):
        shared = docs.sparkSession.sparkContext.broadcast(Patterns(part))

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            patterns = shared.value
            number = patterns.vocabulary.get
            for b in batches:
                ids, starts = [], [0]
                for t in b[text]:
                    ids += [number(w, 0) for w in words(t)]
                    ids.append(0)  # a word of no pattern between documents
                    starts.append(len(ids))
                ids, starts = np.array(ids, dtype=np.int64), np.array(starts)
                ends, pattern = patterns.search(ids)
                seeds = defaultdict(list)
                for doc, end, p in zip(np.searchsorted(starts, ends, "right") - 1, ends, pattern):
                    for item, place in patterns.places[p]:
                        seeds[doc, item].append((int(end) - WINDOW + 1 - int(starts[doc]), place))
                rows = [
                    (b[key].iloc[doc], i)
                    for (doc, item), s in seeds.items()
                    if leaked(ids[starts[doc] : starts[doc + 1] - 1], patterns.items[item][1], patterns.items[item][2], s)
                    for i in patterns.items[item][0]
                ]
                yield pd.DataFrame(rows, columns=[key, "item_id"]).astype({"item_id": "int32"})

        found.append(docs.select(key, text).mapInPandas(search, schema))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def item_texts(spark: SparkSession, sf_dir: str) -> list[tuple[int, str | None]]:
    """The stated query set. Its size is asked first: a table that no driver should read is refused."""
    items = table(spark, sf_dir, "eval_item").where(F.col("item_id").isNotNull())
    size = items.agg(F.sum(F.length("item_text"))).first()[0] or 0
    if size > MOST_TEXT:
        raise ValueError(f"eval_item holds {size} characters, over the {MOST_TEXT} that a query set may have")
    return [(r["item_id"], r["item_text"]) for r in items.select("item_id", "item_text").orderBy("item_id").toLocalIterator()]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), item_texts(spark, sf_dir), "doc_id", "text").distinct()


def p8_leaked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per item the number of documents that leak it."""
    return p8_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n_docs"))


SQL: dict[str, str] = {}
QUERIES = {"p8_found": p8_found, "p8_leaked_items": p8_leaked_items}
