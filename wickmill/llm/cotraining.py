"""Quality classifier by co-training.

Two views of a document: its *content* (hashed tokens, logarithmic counts) and its *page metadata* (source, language, size and layout:
numbers of characters and lines, line and word lengths, shares of capitals, digits, marks and repeated lines). Each view
has a logistic classifier. In each of ``ROUNDS`` rounds the two are fitted, each marks the pool rows that it is surest
of, and those marks are added to the training rows of the other. At the end each view is calibrated on labelled
rows kept aside (Platt scaling), and the mean of both calibrated log odds scores every document.

Fitting uses a bounded sample, as its parameters say: ``MOST_LABELLED`` labelled documents, of which every fifth calibrates, and a pool
of ``MOST_POOL`` others, both those with the smallest hash of their id. Scoring covers all documents and whole texts.

Defined cases: null text counts as empty; null source, language or size are values of their own. Labels with a null id or mark
are left out; an id with several marks takes the least. Without labels of both classes every score is 0.5 and every document
is kept. Repeated rows get equal scores. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickmill.llm.common import TokenHashes, map_rows, mix64

CONTENT, META = 1024, 96
ROUNDS = 4
# Rows that a view hands over in a round, per class and at most.
GROWTH = 400
SURE = 0.9
MOST_LABELLED, MOST_POOL = 4_000, 4_000
KEEP = 0.25

_TOKENS = re.compile(r"\w+|[^\w\s]+")
_DENSE = 12


def content_view(text: str, hashes: TokenHashes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values: logarithmic counts of hashed tokens, scaled to length 1."""
    tokens = _TOKENS.findall(text.lower())
    if not tokens:
        return np.empty(0, np.int64), np.empty(0, np.float32)
    buckets, counts = np.unique((mix64(hashes.of(tokens)) % np.uint64(CONTENT)).astype(np.int64), return_counts=True)
    values = np.log1p(counts)
    return buckets, (values / np.linalg.norm(values)).astype(np.float32)


def meta_view(text: str, source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    """Layout numbers first, then one place for the hashed source and one for the hashed language."""
    x = np.zeros(META, np.float32)
    n = max(1, len(text))
    lines = [line for line in text.split("\n") if line.strip()]
    words = text.split()
    letters = sum(map(str.isalpha, text))
    upper = sum(map(str.isupper, text))
    digits = sum(map(str.isdigit, text))
    blanks = sum(map(str.isspace, text))
    x[:_DENSE] = (
        math.log1p(n_chars if n_chars is not None and n_chars >= 0 else n) / 10,
        math.log1p(len(lines)) / 5,
        math.log1p(sum(map(len, lines)) / max(1, len(lines))) / 7,
        math.log1p(sum(map(len, words)) / max(1, len(words))) / 3,
        upper / max(1, letters),
        digits / n,
        (n - letters - digits - blanks) / n,
        blanks / n,
        1 - len(set(lines)) / max(1, len(lines)),
        len(set(words)) / max(1, len(words)),
        float(not words),
        1.0,
    )
    free = META - _DENSE
    for k, value in enumerate((source, lang)):
        x[_DENSE + zlib.crc32(f"{k}:{value}".encode()) % free] += 0.2
    return x


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 8, ridge: float = 1e-3) -> np.ndarray:
    """Logistic regression by conjugate-gradient Newton steps; the last coefficient is the intercept."""
    n, d = x.shape
    x = np.ascontiguousarray(x, np.float32)
    turn = np.ascontiguousarray(x.T)
    times = lambda v: (x @ v.astype(np.float32)).astype(np.float64)
    back = lambda v: (turn @ v.astype(np.float32)).astype(np.float64)
    w = np.zeros(d + 1)
    total = weight.sum()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(times(w[:-1]) + w[-1], -30, 30)))
        error = weight * (p - y) / total
        gradient = np.append(back(error), error.sum()) + ridge * np.append(w[:-1], 0)
        if np.abs(gradient).max() < 1e-5:
            break
        curve = weight * np.maximum(p * (1 - p), 1e-4) / total

        def hessian(v: np.ndarray) -> np.ndarray:
            inner = curve * (times(v[:-1]) + v[-1])
            return np.append(back(inner) + ridge * v[:-1], inner.sum() + 1e-9 * v[-1])

        step, rest = np.zeros(d + 1), -gradient
        way, size = rest.copy(), rest @ rest
        for _ in range(12):
            turned = hessian(way)
            length = size / max(way @ turned, 1e-12)
            step += length * way
            rest = rest - length * turned
            new = rest @ rest
            if new < 1e-6 * (gradient @ gradient):
                break
            way, size = rest + new / size * way, new
        w = w + step * min(1.0, 5 / (np.abs(step).max() or 1.0))
    return w


def margin(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def co_train(content: np.ndarray, meta: np.ndarray, y: np.ndarray, rounds: int = ROUNDS) -> dict | None:
    """``y`` is 1, 0, or -1 for the pool. Returns weights and calibrations of both views, or None without both classes."""
    views = (content, meta)
    labelled = np.flatnonzero(y >= 0)
    aside, own = labelled[::5], np.setdiff1d(labelled, labelled[::5])
    if len(set(y[own].tolist())) < 2 or len(set(y[aside].tolist())) < 2:
        return None
    pool = np.flatnonzero(y < 0)
    marks = [np.where(y >= 0, y, -1).astype(float) for _ in views]
    for m in marks:
        m[aside] = -1
    weights = [None, None]
    for round_ in range(rounds + 1):
        for v, x in enumerate(views):
            rows = np.flatnonzero(marks[v] >= 0)
            share = marks[v][rows].mean()
            balance = np.where(marks[v][rows] == 1, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6))
            weights[v] = fit(x[rows], marks[v][rows], balance)
        if round_ == rounds:
            break
        for v, x in enumerate(views):
            other = marks[1 - v]
            open_ = pool[other[pool] < 0]
            p = 1 / (1 + np.exp(-margin(x[open_], weights[v])))
            for mark, sure in ((1, p), (0, 1 - p)):
                best = np.argsort(-sure, kind="stable")[:GROWTH]
                other[open_[best[sure[best] >= SURE]]] = mark
    scales = []
    for v, x in enumerate(views):
        m = margin(x[aside], weights[v])[:, None]
        # Platt's targets keep the scale finite where the rows kept aside are separated.
        good, bad = (y[aside] == 1).sum(), (y[aside] == 0).sum()
        soft = np.where(y[aside] == 1, (good + 1) / (good + 2), 1 / (bad + 2))
        scales.append(fit(m / 10, soft, np.ones(len(aside)), ridge=1e-4))
    return {"weights": weights, "scales": scales}


def calibrated(m: np.ndarray | float, scale: np.ndarray):
    return np.clip(m / 10 * scale[0] + scale[1], -20, 20)


def sample(docs: DataFrame, labels: DataFrame, labelled: int = MOST_LABELLED, pool: int = MOST_POOL) -> DataFrame:
    """doc_id, quality (null in the pool): at most ``labelled`` plus ``pool`` ids."""
    marks = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    known = marks.orderBy(*order).limit(labelled)
    # The pool draws from all ids; those that are labelled drop out of it.
    others = docs.where("doc_id IS NOT NULL").select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(2 * pool).distinct()
    rest = others.join(F.broadcast(known), "doc_id", "left_anti").orderBy(*order).limit(pool)
    return known.unionByName(rest.select("doc_id", F.lit(None).cast("int").alias("quality")))


def train(docs: DataFrame, labels: DataFrame) -> dict | None:
    """Fit on the bounded sample. The sample's features, and nothing else, reach the driver."""

    def task(rows: Iterator[tuple]) -> Iterator[tuple]:
        hashes = TokenHashes()
        for doc_id, quality, text, source, lang, n_chars in rows:
            text = text or ""
            buckets, values = content_view(text, hashes)
            yield doc_id, -1 if quality is None else quality, buckets.tolist(), values.tolist(), meta_view(text, source, lang, n_chars).tolist()

    # Bounded by the two limits of the sample.
    chosen = docs.join(F.broadcast(sample(docs, labels)), "doc_id")
    columns = ["doc_id", "quality", "text", "source", "lang", "n_chars"]
    kind = dict(docs.dtypes)["doc_id"]
    rows = map_rows(chosen, columns, f"doc_id {kind}, y int, buckets array<int>, vals array<float>, meta array<float>", task).toPandas()
    if not len(rows):
        return None
    rows = rows.drop_duplicates("doc_id").sort_values("doc_id", ignore_index=True)
    content = np.zeros((len(rows), CONTENT), np.float32)
    for k, (b, v) in enumerate(zip(rows["buckets"], rows["vals"])):
        content[k, b] = v
    return co_train(content, np.stack(rows["meta"].to_numpy()).astype(np.float32), rows["y"].to_numpy())


def score_documents(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, content_score, meta_score, score (0 to 1) and kept for every document."""

    def task(rows: Iterator[tuple]) -> Iterator[tuple]:
        hashes = TokenHashes()
        logistic = lambda m: float(1 / (1 + np.exp(-m)))
        for doc_id, text, source, lang, n_chars in rows:
            if model is None:
                yield doc_id, 0.5, 0.5, 0.5, True
                continue
            text = text or ""
            (w_content, w_meta), (s_content, s_meta) = model["weights"], model["scales"]
            buckets, values = content_view(text, hashes)
            one = calibrated(w_content[buckets] @ values + w_content[-1], s_content)
            two = calibrated(w_meta[:-1] @ meta_view(text, source, lang, n_chars) + w_meta[-1], s_meta)
            score = logistic((one + two) / 2)
            yield doc_id, logistic(one), logistic(two), score, score >= KEEP

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, content_score double, meta_score double, score double, kept boolean"
    return map_rows(docs, ["doc_id", "text", "source", "lang", "n_chars"], schema, task)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_documents(docs, train(docs, labels))
