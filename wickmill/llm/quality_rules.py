"""Quality rules: hashed n-gram log-likelihood ratio between trusted texts and the raw corpus.

Tokens are runs of word characters and runs of punctuation, in lower case. Unigrams and bigrams of them are
hashed into ``BUCKETS``; two multinomials over the buckets are counted, one over all texts, one over trusted texts.
A document's score is the mean of ``log p_trusted - log p_raw`` over its grams, so its length plays no part. A document is
rejected when it fails the base rules or its score is below ``THRESHOLD``; there is no chance in either.

- Null text counts as empty: all counts 0, base rules failed.
- A text without tokens, or a corpus without trusted texts, has score 0.
- A repeated row gets the same answer each time. Ids in ``labels`` that repeat are trusted if all their marks are 1; null
  ids and null marks trust nothing.
- Extra columns of either table are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickmill.llm.common import TokenHashes, map_rows, mix64

BUCKETS = 16_384
# Mean log ratio, in nats per gram, below which a document is rejected.
THRESHOLD = -0.3
# The trusted side is fitted on at most so many labelled documents, those with the smallest hash of their id.
MOST_TRUSTED = 50_000

_TOKENS = re.compile(r"\w+|[^\w\s]+")
_SYMBOLS = [bytes([c]) for c in b"#*$%&|<>"]


def gram_buckets(text: str, hashes: TokenHashes, buckets: int = BUCKETS) -> np.ndarray:
    """Bucket of every unigram and bigram of the text."""
    tokens = _TOKENS.findall(text.lower())
    if not tokens:
        return np.empty(0, np.int64)
    one = hashes.of(tokens)
    with np.errstate(over="ignore"):
        two = one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:]
    return (mix64(np.concatenate((one, two))) % np.uint64(buckets)).astype(np.int64)


def _same(pairs: np.ndarray, step: int) -> np.ndarray:
    """Numbers for joined neighbours: equal numbers exactly where both parts are equal."""
    joined = pairs[:-step] * (int(pairs.max()) + 1) + pairs[step:]
    return np.unique(joined, return_inverse=True)[1].astype(np.int64)


def repeated_words(words: list[bytes], width: int = 8) -> int:
    """Words inside windows of ``width`` words that occur twice or more in the text. ``width`` is a power of two."""
    if len(words) < width + 1:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    step = 1
    while step < width:
        ids = _same(ids, step)
        step *= 2
    twice = (np.bincount(ids)[ids] > 1).astype(np.int64)
    if not twice.any():
        return 0
    edges = np.zeros(len(words) + 1, np.int64)
    edges[: len(twice)] += twice
    edges[width : width + len(twice)] -= twice
    return int((np.cumsum(edges[:-1]) > 0).sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    white = sum(map(raw.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return (
        len(words),
        len(text) - white,
        sum(map(raw.count, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def trusted_ids(labels: DataFrame, most: int = MOST_TRUSTED) -> DataFrame:
    """Ids whose every mark is quality 1: at most ``most``, a sample that does not depend on row order."""
    good = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.min(F.coalesce(F.col("quality"), F.lit(0))).alias("quality")
    )
    return good.where("quality = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id")


def gram_counts(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Gram counts per bucket over all documents and over the trusted ones."""
    # At most MOST_TRUSTED ids of eight bytes: a bounded broadcast, so no text is shuffled.
    marked = docs.select("doc_id", "text").join(
        F.broadcast(trusted_ids(labels).withColumn("trusted", F.lit(True))), "doc_id", "left"
    )

    def task(rows: Iterator[tuple]) -> Iterator[tuple]:
        hashes, sums = TokenHashes(), np.zeros((2, buckets), np.int64)
        for text, trusted in rows:
            counts = np.bincount(gram_buckets(text, hashes, buckets), minlength=buckets)
            sums[0] += counts
            if trusted:
                sums[1] += counts
        for k in np.flatnonzero(sums[0]).tolist():
            yield k, int(sums[0, k]), int(sums[1, k])

    parts = map_rows(marked.where(F.col("text").isNotNull()), ["text", "trusted"], "bucket int, raw long, good long", task)
    counts = np.zeros((2, buckets))
    for row in parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).toLocalIterator():
        counts[:, row["bucket"]] = row["raw"], row["good"]
    return counts[0], counts[1]


def log_ratios(raw: np.ndarray, good: np.ndarray) -> np.ndarray:
    """log p_trusted - log p_raw per bucket; the trusted side is smoothed towards the raw one."""
    if not good.sum():
        return np.zeros(len(raw))
    p_raw = (raw + 1) / (raw.sum() + len(raw))
    p_good = (good + len(raw) * p_raw) / (good.sum() + len(raw))
    return np.log(p_good) - np.log(p_raw)


def score_documents(docs: DataFrame, ratios: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """Base counts, score and verdict of every document."""

    def task(rows: Iterator[tuple]) -> Iterator[tuple]:
        hashes = TokenHashes()
        for doc_id, text in rows:
            text = text or ""
            words, chars, symbols, dup_lines, repeats = base_counts(text)
            found = gram_buckets(text, hashes, len(ratios))
            score = float(ratios[found].mean()) if len(found) else 0.0
            failed = words < 20 or 100 * repeats > 30 * words
            yield doc_id, words, chars, symbols, dup_lines, repeats, failed, not failed and score >= threshold, score

    schema = (
        f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
        "n_repeat_words long, base_failed boolean, kept boolean, score double"
    )
    return map_rows(docs, ["doc_id", "text"], schema, task)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Count both multinomials over ``docs``, then judge every document of it."""
    return score_documents(docs, log_ratios(*gram_counts(docs, labels)))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns unchanged.

    The verdict is computed inside the row, so no text is shuffled and repeated ids cannot mix.
    """
    ratios = log_ratios(*gram_counts(docs, labels))
    names = docs.columns
    spark_schema = docs.schema

    def run(batches):
        import pyarrow as pa

        hashes = TokenHashes()
        for batch in batches:
            texts = batch.column(names.index("text"))
            keep = []
            for k in range(batch.num_rows):
                text = texts[k].as_py() or ""
                words, _, _, _, repeats = base_counts(text)
                good = words >= 20 and 100 * repeats <= 30 * words
                if good:
                    found = gram_buckets(text, hashes, len(ratios))
                    good = not len(found) or float(ratios[found].mean()) >= THRESHOLD
                keep.append(good)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, spark_schema)
