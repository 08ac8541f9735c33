"""Near duplicates by b-bit MinHash.

A document's set holds its five-word shingles (words as in the contract, A-Z in lower case). ``PERMUTATIONS`` minima are
taken; keys of a few minima each (``banding``) make candidates, and the low ``BITS`` bits of every minimum are packed into bit
planes. Candidates pass when the match share of the planes, corrected for chance collisions, leaves room for the threshold.
Passing pairs are confirmed on the full shingle sets.

Scale: equal sets are folded into one class before anything is compared. In a bucket every class is first
paired with one leader only, so a bucket of n classes gives n pairs. Pairs within a bucket are
looked at only between classes that are still in different components, and only those whose planes agree leave the
join, after their full sets have been compared there. Nothing about all documents is gathered anywhere; components are found by repeated joins.

Defined cases: null, empty or blank text has an empty set, links with nothing and is its own component. Rows with equal
ids are one document of the graph. A row without an id takes the component of its set, or null, and is kept
only where that is null. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wickmill.llm.common import map_rows, mix64, small, stored

WIDTH = 5
PERMUTATIONS, MOST_ROWS, BITS = 224, 7, 4
PLANE_WORDS = (PERMUTATIONS + 63) // 64
# Links need 100 * shared >= percent * united. op3 has a threshold of its own; the pipeline's stage takes STAGE_PERCENT.
PERCENT, STAGE_PERCENT = 85, 80
# Share of pairs at the threshold that may have no band in common.
MISSED = 2e-5

_CONSTANTS = mix64(np.arange(1, 2 * PERMUTATIONS + 17, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_TIMES = _CONSTANTS[:PERMUTATIONS] | np.uint64(1)
_PLUS = _CONSTANTS[PERMUTATIONS : 2 * PERMUTATIONS]
_FOLD = _CONSTANTS[2 * PERMUTATIONS :][:WIDTH] | np.uint64(1)
_JOIN = _CONSTANTS[2 * PERMUTATIONS + WIDTH :][:MOST_ROWS] | np.uint64(1)


def banding(percent: int) -> tuple[int, int]:
    """Bands and rows: the longest keys by which at most ``MISSED`` of the pairs at the threshold do not meet."""
    for rows in range(MOST_ROWS, 0, -1):
        bands = PERMUTATIONS // rows
        if (1 - (percent / 100) ** rows) ** bands <= MISSED:
            return bands, rows
    raise ValueError(f"no banding of {PERMUTATIONS} minima serves {percent} percent")


def least_estimate(percent: int) -> float:
    """Least corrected estimate that is confirmed: more than four standard deviations of the minima under the threshold."""
    chance = 2.0**-BITS
    match = percent / 100 * (1 - chance) + chance
    return math.floor(percent - 440 * math.sqrt(match * (1 - match) / PERMUTATIONS) / (1 - chance)) / 100


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_set(text: str | None, width: int = WIDTH) -> set[tuple]:
    """The exact set: distinct runs of ``width`` words, or the whole text when it has fewer."""
    words = words_of(text)
    if len(words) <= width:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(width))))


def shingle_hashes(text: str | None) -> np.ndarray:
    """Distinct 64-bit hashes of the set's members."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    known: dict[bytes, int] = {}
    for w in set(words):
        known[w] = xxhash.xxh3_64_intdigest(w)
    ids = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(WIDTH, len(words))
    n = len(words) - width + 1
    with np.errstate(over="ignore"):
        total = np.full(n, width, np.uint64)
        for k in range(width):
            total = mix64(total + ids[k : k + n]) * _FOLD[k]
    return np.unique(total)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least of every permuted hash, 32 bits each."""
    least = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for start in range(0, len(hashes), 512):
            permuted = hashes[start : start + 512, None] * _TIMES
            permuted += _PLUS
            np.minimum(least, permuted.min(axis=0), out=least)
    return least >> np.uint64(32)


def band_keys(least: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    bands, rows = banding(percent)
    with np.errstate(over="ignore"):
        joined = (mix64(least[: bands * rows]).reshape(bands, rows) * _JOIN[:rows]).sum(axis=1, dtype=np.uint64)
        return mix64(joined + np.arange(bands, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)).view(np.int64)


def planes(least: np.ndarray) -> np.ndarray:
    """Low bits of the minima: for each of ``BITS`` planes, one bit per permutation packed into words."""
    padded = np.zeros(PLANE_WORDS * 64, np.uint64)
    padded[:PERMUTATIONS] = least
    bits = np.stack([(padded >> np.uint64(b)) & np.uint64(1) for b in range(BITS)]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view(np.int64).reshape(-1)


def estimate(a: Column, b: Column) -> Column:
    """Similarity from two packed signatures: matches counted by bits, less what chance gives."""
    differing = F.lit(0)
    for word in range(PLANE_WORDS):
        odd = None
        for plane in range(BITS):
            k = plane * PLANE_WORDS + word
            one = a[k].bitwiseXOR(b[k])
            odd = one if odd is None else odd.bitwiseOR(one)
        differing = differing + F.bit_count(odd)
    chance = 2.0**-BITS
    return (1 - differing / F.lit(float(PERMUTATIONS)) - chance) / (1 - chance)


def sketch(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, the set's 128-bit digest, band keys and planes of every document."""

    def task(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in rows:
            hashes = shingle_hashes(text)
            if not len(hashes):
                yield doc_id, 0, None, None, None, None
                continue
            least = minima(hashes)
            with np.errstate(over="ignore"):
                d1 = int(hashes.sum(dtype=np.uint64).view(np.int64))
                d2 = int(mix64(hashes + np.uint64(len(hashes))).sum(dtype=np.uint64).view(np.int64))
            yield doc_id, len(hashes), d1, d2, band_keys(least, percent).tolist(), planes(least).tolist()

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_shingles long, d1 long, d2 long, bands array<long>, planes array<long>"
    return map_rows(docs, ["doc_id", "text"], schema, task)


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """rep, hashes (of the full set) of the documents whose ids are in ``wanted(rep)``."""

    def task(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in rows:
            yield doc_id, shingle_hashes(text).view(np.int64).tolist()

    chosen = docs.join(small(wanted.withColumnRenamed("rep", "doc_id")), "doc_id", "left_semi")
    return map_rows(chosen, ["doc_id", "text"], "rep long, hashes array<long>", task).dropDuplicates(["rep"])


def confirm(docs: DataFrame, pairs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) whose full shingle sets are similar enough. Only texts of paired documents move."""
    wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "pair-ids")
    texts = stored(docs.select("doc_id", "text").join(small(wanted), "doc_id", "left_semi"), "pair-texts")
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))

    def task(rows: Iterator[tuple]) -> Iterator[tuple]:
        held: OrderedDict = OrderedDict()

        def members(key: int, text: str) -> set:
            found = held.pop((key, text), None)
            if found is None:
                found = shingle_set(text)
            held[(key, text)] = found
            if len(held) > 8:
                held.popitem(last=False)
            return found

        for a, b, text_a, text_b in rows:
            one, two = members(a, text_a), members(b, text_b)
            shared = len(one & two)
            if 100 * shared >= percent * (len(one) + len(two) - shared):
                yield a, b

    joined = pairs.select("a", "b").join(left, "a").join(right, "b")
    return map_rows(joined, ["a", "b", "text_a", "text_b"], "a long, b long", task).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of ``edges(a, b)``.

    Alternates two star steps until the edges stop changing; each step groups with map-side minima and joins.
    """
    spark = edges.sparkSession

    def state(df: DataFrame) -> tuple:
        row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        return row["n"], row["s"]

    now = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    seen = state(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        now = stored(small.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct(), "edges")
        was, seen = seen, state(now)
        if was == seen:
            break
    pairs = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return pairs.unionByName(roots) if seen[0] else spark.createDataFrame([], "node long, component long")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``; sets link from ``percent`` of similarity on."""
    enough = least_estimate(percent)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = stored(sketch(docs, percent), "sketches")
    classes = stored(
        sketches.where("n_shingles > 0")
        .groupBy("d1", "d2")
        .agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("planes").alias("planes")),
        "classes",
    )
    live = classes.where("rep IS NOT NULL")
    signatures = live.select("rep", "planes")

    # Buckets that hold more than one class. Each is led by the class that meets most others over all its buckets: in a
    # group of variants that is their common origin, which is nearer to each of them than they are to each other.
    keyed = live.select("rep", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = stored(keyed.join(shared, "key"), "members")
    weights = met.groupBy("rep").agg(F.sum("n").alias("weight"))
    weighed = met.join(weights, "rep")
    leaders = weighed.groupBy("key").agg(F.max(F.struct("weight", (-F.col("rep")).alias("rep"))).alias("top"))
    members = stored(met.join(leaders.select("key", (-F.col("top.rep")).alias("leader")), "key").select("key", "rep", "leader"), "led")

    def similar(pairs: DataFrame) -> DataFrame:
        return (
            pairs.join(signatures.select(F.col("rep").alias("a"), F.col("planes").alias("pa")), "a")
            .join(signatures.select(F.col("rep").alias("b"), F.col("planes").alias("pb")), "b")
            .where(estimate(F.col("pa"), F.col("pb")) >= enough)
            .select("a", "b")
            .distinct()
        )

    stars = members.where("rep <> leader").select(F.col("rep").alias("a"), F.col("leader").alias("b")).distinct()
    first = stored(similar(stars), "pairs")
    links = stored(confirm(docs, first, percent), "links")
    found = stored(components(links), "components")

    # What a star misses: classes of one bucket that are in different components still.
    placed = members.join(found, members["rep"] == found["node"], "left").select(
        "key", "rep", F.coalesce("component", "rep").alias("component")
    )
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    open_ = stored(placed.join(mixed.select("key"), "key").join(signatures, "rep"), "open")
    wanted = stored(open_.select("rep").distinct(), "open-ids")
    sets = stored(shingle_sets(docs, wanted), "open-sets")
    laid = open_.join(sets, "rep")

    def side(name: str) -> DataFrame:
        return laid.select("key", *(F.col(c).alias(f"{c}_{name}") for c in ("rep", "component", "planes", "hashes")))

    # Pairs are tried on their full sets inside the join, so the many that fail in a group of variants are never written.
    shared_size = F.size(F.array_intersect("hashes_a", "hashes_b"))
    united = F.size("hashes_a") + F.size("hashes_b") - shared_size
    cross = side("a").alias("l").join(
        side("b").alias("r"),
        (F.col("l.key") == F.col("r.key"))
        & (F.col("component_a") > F.col("component_b"))
        & (estimate(F.col("planes_a"), F.col("planes_b")) >= enough)
        & (100 * shared_size >= percent * united),
    )
    second = stored(cross.select(F.greatest("rep_a", "rep_b").alias("a"), F.least("rep_a", "rep_b").alias("b")).distinct(), "pairs")
    if not second.isEmpty():
        more = stored(confirm(docs, second, percent), "links")
        found = stored(components(links.unionByName(more)), "components")

    of_class = (
        classes.select("d1", "d2", "rep")
        .join(found, F.col("rep") == F.col("node"), "left")
        .select("d1", "d2", F.coalesce("component", "rep").alias("of_set"))
    )
    return sketches.select("doc_id", "n_shingles", "d1", "d2").join(of_class, ["d1", "d2"], "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("of_set", "doc_id").alias("component_id"),
        F.col("doc_id").eqNullSafe(F.coalesce("of_set", "doc_id")).alias("kept"),
    )


def keep_one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of every group of near duplicates: that of the smallest id. Rows with no words all stay.

    Rows without an id stay. Of rows that repeat an id, one stays.
    """
    kept = near_duplicates(docs, percent).where("kept AND doc_id IS NOT NULL").select("doc_id")
    stay = docs.where("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return stay.unionByName(docs.where("doc_id IS NULL")).select(*docs.columns)


SQL = rf"""
    WITH RECURSIVE worded AS (
      SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[^\x20\x09-\x0D]+'), []) AS w
      FROM documents
    ), shingled AS (
      SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= {WIDTH} THEN [array_to_string(w, ' ')]
             ELSE list_distinct([array_to_string(w[i:i + {WIDTH} - 1], ' ') FOR i IN range(1, len(w) - {WIDTH} + 2)]) END AS s
      FROM worded
    ), members AS (
      SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM shingled
    ), links AS (
      SELECT x.doc_id AS a, y.doc_id AS b
      FROM members x JOIN members y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id
      GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= {PERCENT} * (x.n + y.n - count(*))
    ), reached(a, b) AS (
      SELECT doc_id, doc_id FROM shingled
      UNION
      SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b
    ), least AS (
      SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a
    )
    SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, l.component_id, s.doc_id = l.component_id AS kept
    FROM shingled s JOIN least l USING (doc_id)
"""
