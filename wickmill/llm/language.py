"""Language identification by hyperdimensional letter n-gram profiles.

Every letter owns a random vector of +1 and -1, made from its code point. A three-letter gram is bound from
the vectors of its letters, each rotated by its place: ``r2(a) * r1(b) * c``. A text bundles (sums) the vectors of
its grams; a language prototype bundles the texts of that language. A text takes the language whose
prototype has the largest cosine with it.

Texts are read whole and in lower case; runs of anything but letters become one blank.

- Null text, or a text without a letter: ``und`` with score 0. So is every text when nothing could be learned.
- Equal cosines: the language that comes first by code point.
- Repeated rows and repeated ids get equal answers row by row; a null id is never held out.
- Extra columns are ignored, so clashing names do no harm.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickmill.llm.common import map_rows, mix64

DIMENSIONS = 1024
# Grams whose vectors a task keeps at hand; others are bound anew each time.
KEPT_GRAMS = 20_000
# Grams bound in one step, which bounds the memory of a text with very many different ones.
STEP_GRAMS = 4_096

_BLANK = 32
_FOLDED: np.ndarray | None = None


def _folded() -> np.ndarray:
    """Code point to lower-case letter, or blank."""
    global _FOLDED
    if _FOLDED is None:
        table = np.full(sys.maxunicode + 1, _BLANK, np.uint32)
        for point in range(sys.maxunicode + 1):
            c = chr(point)
            if unicodedata.category(c)[0] == "L":
                low = c.lower()
                table[point] = ord(low) if len(low) == 1 else point
        _FOLDED = table
    return _FOLDED


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams (three 21-bit code points packed into 64 bits) and how often each occurs."""
    points = _folded()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    padded = np.concatenate(([_BLANK], points, [_BLANK])).astype(np.uint64)
    blank = padded == _BLANK
    padded = padded[np.concatenate(([True], ~(blank[1:] & blank[:-1])))]
    if len(padded) < 3:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    grams = (padded[:-2] << np.uint64(42)) | (padded[1:-1] << np.uint64(21)) | padded[2:]
    return np.unique(grams, return_counts=True)


def letter_vectors(points: np.ndarray, dimensions: int) -> np.ndarray:
    """One row of +1 and -1 for each code point, always the same for the same code point."""
    words = (dimensions + 63) // 64
    seeds = points.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15 >> 8) + np.arange(1, words + 1, dtype=np.uint64)[None, :] * np.uint64(0xD1B54A32D192ED03)
    bits = np.unpackbits(mix64(mix64(seeds)).view(np.uint8), axis=1)[:, :dimensions]
    return (bits.astype(np.int8) << 1) - 1


def bind(grams: np.ndarray, dimensions: int) -> np.ndarray:
    """Vectors of grams: the product of their letters' vectors, rotated by two, one and no places."""
    mask = np.uint64((1 << 21) - 1)
    places = np.stack([grams >> np.uint64(42), (grams >> np.uint64(21)) & mask, grams & mask])
    points, at = np.unique(places, return_inverse=True)
    at = at.reshape(places.shape)
    letters = letter_vectors(points, dimensions)
    return np.roll(letters, 2, axis=1)[at[0]] * np.roll(letters, 1, axis=1)[at[1]] * letters[at[2]]


class Bundler:
    """Sums gram vectors; the vectors met first stay at hand, up to a bound."""

    def __init__(self, dimensions: int, keep: int = KEPT_GRAMS):
        self.dimensions = dimensions
        self.keys = np.empty(0, np.uint64)
        self.rows = np.empty(0, np.int64)
        self.held = np.empty((keep, dimensions), np.int8)
        self.used = 0

    def _sum(self, vectors: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return counts.astype(np.float32) @ vectors.astype(np.float32)

    def bundle(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        total = np.zeros(self.dimensions, np.float64)
        for start in range(0, len(grams), STEP_GRAMS):
            g, n = grams[start : start + STEP_GRAMS], counts[start : start + STEP_GRAMS]
            at = np.searchsorted(self.keys, g)
            known = at < len(self.keys)
            known[known] = self.keys[at[known]] == g[known]
            if known.any():
                total += self._sum(self.held[self.rows[at[known]]], n[known])
            if not known.all():
                new, n = g[~known], n[~known]
                vectors = bind(new, self.dimensions)
                total += self._sum(vectors, n)
                room = min(len(new), len(self.held) - self.used)
                if room:
                    self.held[self.used : self.used + room] = vectors[:room]
                    keys = np.concatenate((self.keys, new[:room]))
                    rows = np.concatenate((self.rows, np.arange(self.used, self.used + room)))
                    order = np.argsort(keys)
                    self.keys, self.rows, self.used = keys[order], rows[order], self.used + room
        return total


def learn_prototypes(labelled: DataFrame, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Prototype of every non-null ``lang`` in ``labelled(text, lang)``.

    Each task bundles its own texts; the partial sums, whole numbers, are added by (language, place). What reaches
    the driver is one vector per language, whatever the number of texts.
    """

    def task(rows: Iterator[tuple]) -> Iterator[tuple]:
        bundler, sums = Bundler(dimensions), {}
        for text, lang in rows:
            grams, counts = gram_counts(text)
            if len(grams):
                if lang not in sums:
                    sums[lang] = np.zeros(dimensions)
                sums[lang] += bundler.bundle(grams, counts)
        for lang, total in sums.items():
            for place, value in enumerate(total.tolist()):
                yield lang, place, int(value)

    some = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    parts = map_rows(some, ["text", "lang"], "lang string, place int, value long", task)
    found: dict[str, np.ndarray] = {}
    for row in parts.groupBy("lang", "place").agg(F.sum("value").alias("value")).toLocalIterator():
        found.setdefault(row["lang"], np.zeros(dimensions))[row["place"]] = row["value"]
    return dict(sorted(found.items()))


def predict_language(docs: DataFrame, prototypes: dict[str, np.ndarray], keys: list[str]) -> DataFrame:
    """``keys`` of ``docs`` with ``lang_pred`` and ``score`` (the best cosine, 0 where it is negative)."""
    names = list(prototypes)
    dimensions = len(next(iter(prototypes.values()))) if prototypes else DIMENSIONS
    unit = np.zeros((len(names), dimensions))
    for k, name in enumerate(names):
        unit[k] = prototypes[name] / (np.linalg.norm(prototypes[name]) or 1.0)
    kinds = dict(docs.select(*keys).dtypes)

    def task(rows: Iterator[tuple]) -> Iterator[tuple]:
        bundler = Bundler(dimensions)
        for *key, text in rows:
            grams, counts = gram_counts(text) if text is not None and names else ((), ())
            if not len(grams):
                yield *key, "und", 0.0
                continue
            vector = bundler.bundle(grams, counts)
            cosines = unit @ vector / (np.linalg.norm(vector) or 1.0)
            best = int(np.argmax(cosines))
            yield *key, names[best], float(min(1.0, max(0.0, cosines[best])))

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", lang_pred string, score double"
    return map_rows(docs, [*keys, "text"], schema, task)


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the id, as text, leaves remainder 1 by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the documents that are not held out, then predict every document."""
    marked = docs.select("doc_id", "text", "lang", held_out().alias("held_out"))
    prototypes = learn_prototypes(marked.where(~F.col("held_out")))
    return predict_language(marked, prototypes, ["doc_id", "held_out"])
