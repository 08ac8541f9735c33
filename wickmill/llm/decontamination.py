"""Benchmark decontamination: a BM25 index of test items, searched by every passage with block-max WAND.

Tokens are runs of word characters in lower case. A text is cut into passages of three item lengths that overlap by two, so
any item's run of words lies whole in some passage. Each passage is a query against the index. Weights are BM25
weights divided by the item's score for its own words, so a score is the share of an item's weight that a passage
covers and one threshold serves all items. Every item at or above ``RETRIEVE`` is retrieved, without a cap, and then verified:
at least ``QUESTION`` of the question's tokens occur in the passage in their order (longest common subsequence), and ``ANSWER`` of the
answer's distinct tokens. A changed, added or lost word costs one token of the share, wherever it stands.

The question is the item without its answer; the answer is its last line, or the last sentence of a one-line
item, or the last quarter of an item of one sentence.

Pruning is exact and goes by pivots: an item's commonest terms, as long as they weigh less than half the threshold together, have no
posting lists; only the rarer terms do. A passage whose terms cannot make up the other half in these lists is skipped. Else the lists are added up, and
items that cannot reach the threshold with all their common terms fall; then blocks of items whose largest weights over the
passage's terms cannot; what is left is summed in full.

The index is built for ``SHARD_ITEMS`` items at a time, so what is sent to the tasks is bounded. Document frequencies and the mean length are those of
all items, counted on Spark when there is more than one shard. Rows pass from shard to shard in one scan and collect their items on the way.

Defined cases: null or empty text has no passage and is clean; items without tokens are left out; items with equal ids are
each searched; a null item id is searched and reported as null; an empty benchmark finds nothing. Repeated rows and rows of equal
or null id are judged each for itself. Ties do not matter, as all items at or above the threshold count. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickmill.llm.common import map_rows, stored

K1, B = 1.2, 0.75
RETRIEVE = 0.6
QUESTION = 0.8
ANSWER = 0.5
BLOCK = 16
SHARD_ITEMS = 20_000

_TOKENS = re.compile(r"\w+")


def tokens_of(text: str | None) -> list[str]:
    return _TOKENS.findall(text.lower()) if text else []


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    parts = [p for p in text.split("\n") if _TOKENS.search(p)]
    if len(parts) < 2:
        parts = [p for p in re.split(r"(?<=[.?!])\s+", text) if _TOKENS.search(p)]
    if len(parts) >= 2:
        answer = tokens_of(parts[-1])
        return tokens_of(text)[: -len(answer)], answer
    tokens = tokens_of(text)
    cut = len(tokens) - max(1, len(tokens) // 4)
    return tokens[:cut] or tokens, tokens[cut:]


def in_order(wanted: list[str], tokens: list[str]) -> int:
    """Length of the longest common subsequence, a bit per wanted token."""
    places: dict[str, int] = defaultdict(int)
    for k, token in enumerate(wanted):
        places[token] |= 1 << k
    rows = 0
    for token in tokens:
        here = places.get(token)
        if here:
            either = rows | here
            rows = either & ~(either - (rows << 1 | 1))
    return rows.bit_count()


def overlaps(passage: list[str], question: list[str], answer: list[str]) -> bool:
    """Whether the passage holds enough of the question's tokens in their order and of the answer's tokens."""
    if in_order(question, passage) < QUESTION * len(question):
        return False
    told = set(answer)
    return len(told & set(passage)) >= ANSWER * len(told)


class Frequencies:
    """Items, their mean length, and the number of items that hold a term."""

    def __init__(self, items: int, mean: float, of: dict[str, int]):
        self.items, self.mean, self.of = items, mean, of

    def idf(self, term: str) -> float:
        n = self.of[term]
        return math.log(1 + (self.items - n + 0.5) / (n + 0.5))


class ItemIndex:
    """Inverted index: pivot lists per term, terms with weights per item, terms with their largest weight per block of items."""

    def __init__(self, items: Iterable[tuple[int | None, str]], frequencies: Frequencies | None = None):
        kept = [(i, t, tokens_of(t)) for i, t in items if tokens_of(t)]
        self.ids = [i for i, _, _ in kept]
        self.parts = [question_and_answer(t) for _, t, _ in kept]
        self.longest = max((len(w) for _, _, w in kept), default=1)
        counts = [Counter(w) for _, _, w in kept]
        if frequencies is None:
            mean = sum(map(len, (w for _, _, w in kept))) / max(1, len(kept))
            frequencies = Frequencies(len(kept), mean, Counter(t for c in counts for t in c))
        # Terms from the rarest to the commonest.
        ordered = sorted({t for c in counts for t in c}, key=lambda t: (frequencies.of[t], t))
        self.terms = {t: n for n, t in enumerate(ordered)}
        postings: list[list[tuple[int, float]]] = [[] for _ in ordered]
        # The last entry stands for tokens that no item has.
        self.most = np.zeros(len(ordered) + 1)
        self.rest = np.zeros(len(kept))
        self.item_terms: list[np.ndarray] = []
        self.item_weights: list[np.ndarray] = []
        for k, c in enumerate(counts):
            norm = K1 * (1 - B + B * sum(c.values()) / frequencies.mean)
            places = np.array(sorted(self.terms[t] for t in c), np.int64)
            found = (c[ordered[n]] for n in places)
            weights = np.array([frequencies.idf(ordered[n]) * f * (K1 + 1) / (f + norm) for n, f in zip(places, found)])
            weights /= weights.sum()
            self.item_terms.append(places)
            self.item_weights.append(weights)
            # The commonest terms that weigh less than half the threshold together.
            common = np.cumsum(weights[::-1])[::-1] < RETRIEVE / 2
            self.rest[k] = weights[common].sum()
            np.maximum.at(self.most, places[~common], weights[~common])
            for n, w in zip(places[~common].tolist(), weights[~common].tolist()):
                postings[n].append((k, w))
        self.start = np.cumsum([0, *map(len, postings), 0])
        self.item = np.array([k for p in postings for k, _ in p], np.int64)
        self.weight = np.array([w for p in postings for _, w in p])
        self.block_terms, self.block_most = [], []
        for first in range(0, len(kept), BLOCK):
            largest = np.zeros(len(ordered))
            for places, weights in zip(self.item_terms[first : first + BLOCK], self.item_weights[first : first + BLOCK]):
                np.maximum.at(largest, places, weights)
            self.block_terms.append(np.flatnonzero(largest))
            self.block_most.append(largest[self.block_terms[-1]])

    def above(self, terms: np.ndarray, threshold: float = RETRIEVE) -> list[tuple[int, float]]:
        """All items whose score for these distinct terms reaches the threshold, with their scores."""
        limit = threshold - 1e-9
        all_, terms = terms, terms[self.most[terms] > 0]
        n = self.start[terms + 1] - self.start[terms]
        at = np.repeat(self.start[terms] - np.cumsum(n) + n, n) + np.arange(n.sum())
        bound = np.bincount(self.item[at], self.weight[at], len(self.ids)) + self.rest
        candidates = np.flatnonzero(bound >= limit)
        if not len(candidates):
            return []
        here = np.zeros(len(self.most), bool)
        here[all_] = True
        found, block, alive = [], -1, False
        for k in candidates.tolist():
            if k // BLOCK != block:
                block = k // BLOCK
                alive = self.block_most[block][here[self.block_terms[block]]].sum() >= limit
            if alive:
                score = float(self.item_weights[k][here[self.item_terms[k]]].sum())
                if score >= limit:
                    found.append((k, score))
        return found

    def search(self, text: str | None) -> tuple[int, dict[int, float]]:
        """Number of passages, and verified items with their best score."""
        tokens = tokens_of(text)
        if not tokens:
            return 0, {}
        width, step = 3 * self.longest, self.longest
        starts = np.arange(0, max(1, len(tokens) - width + step), step)
        known, none = self.terms.get, len(self.terms)
        terms = np.fromiter((known(t, none) for t in tokens), np.int64, len(tokens))
        ends = np.minimum(starts + width, len(tokens))
        reach = np.concatenate(([0.0], np.cumsum(self.most[terms])))
        open_ = reach[ends] - reach[starts] + self.rest.max() >= RETRIEVE - 1e-9
        found: dict[int, float] = {}
        for s, e in zip(starts[open_].tolist(), ends[open_].tolist()):
            distinct = np.unique(terms[s:e])
            if distinct[-1] == none:
                distinct = distinct[:-1]
            for item, score in self.above(distinct):
                if score > found.get(item, 0.0) and overlaps(tokens[s:e], *self.parts[item]):
                    found[item] = score
        return len(starts), found


def _frequencies(benchmark: DataFrame, shard: list[tuple], counted: DataFrame, sums: tuple[int, float]) -> Frequencies:
    """Frequencies of the terms of a shard among all items."""
    terms = {t for _, text in shard for t in tokens_of(text)}
    wanted = benchmark.sparkSession.createDataFrame([(t,) for t in sorted(terms)], "term string")
    of = {row["term"]: row["items"] for row in counted.join(wanted, "term", "left_semi").toLocalIterator()}
    return Frequencies(*sums, of)


def _counted(benchmark: DataFrame) -> tuple[DataFrame, tuple[int, float]]:
    """Items per term over the whole benchmark, and the number and mean length of its items."""

    def task(rows: Iterator[tuple]) -> Iterator[tuple]:
        for (text,) in rows:
            tokens = tokens_of(text)
            if tokens:
                yield None, len(tokens)
            for term in set(tokens):
                yield term, 1

    rows = stored(map_rows(benchmark, ["text"], "term string, n long", task), "item-terms")
    whole = rows.where("term is null").agg(F.count("*"), F.avg("n")).first()
    counted = rows.where("term is not null").groupBy("term").agg(F.sum("n").alias("items"))
    return stored(counted, "item-frequencies"), (whole[0], whole[1] or 1.0)


def _indexes(benchmark: DataFrame) -> Iterator[ItemIndex]:
    """One index per ``SHARD_ITEMS`` items, at least one."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").orderBy("item_id", "text")
    if rows.limit(SHARD_ITEMS + 1).count() <= SHARD_ITEMS:
        yield ItemIndex(map(tuple, rows.collect()))
        return
    counted, sums = _counted(benchmark)
    held: list[tuple] = []

    def index() -> ItemIndex:
        return ItemIndex(held, _frequencies(benchmark, held, counted, sums))

    for row in rows.toLocalIterator():
        held.append(tuple(row))
        if len(held) == SHARD_ITEMS:
            yield index()
            held = []
    if held:
        yield index()


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_passages, item_ids (verified items, in order), score (best of them), contaminated; a row per document."""
    kind = dict(docs.dtypes)["doc_id"]
    held = f"doc_id {kind}, text string, n_passages long, item_ids array<long>, score double"
    rows = docs.select(
        "doc_id", "text", F.lit(0).cast("long").alias("n_passages"), F.array().cast("array<long>").alias("item_ids"), F.lit(0.0).alias("score")
    )
    indexes = list(_indexes(benchmark))
    for k, index in enumerate(indexes):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        last = k == len(indexes) - 1

        def task(rows: Iterator[tuple], shared=shared, last=last) -> Iterator[tuple]:
            index = shared.value
            for doc_id, text, n, ids, score in rows:
                here, found = index.search(text) if index.ids else (0, {})
                ids = [*ids, *(index.ids[k] for k in found)]
                if last:
                    ids.sort(key=lambda x: (x is None, x or 0))
                # The text travels on to the next shard only.
                yield doc_id, None if last else text, max(n, here), ids, max(score, *found.values(), 0.0)

        rows = map_rows(rows, ["doc_id", "text", "n_passages", "item_ids", "score"], held, task)
    return rows.drop("text").withColumn("contaminated", F.size("item_ids") > 0)


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no test item, all columns unchanged. Each row is judged where it lies."""
    names, kept = docs.columns, docs
    for index in _indexes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            import pyarrow as pa

            index = shared.value
            for batch in batches:
                texts = batch.column(names.index("text"))
                clean = [not (index.ids and index.search(texts[k].as_py())[1]) for k in range(batch.num_rows)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        kept = kept.mapInArrow(run, docs.schema)
    return kept
