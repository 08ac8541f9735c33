"""Mixing sources to target weights.

Words are added up per source. Sources in order of code point, null last, weigh 1, 2, 3, 1, 2, 3, ... and share the total
size by weight. No target exceeds ``MOST`` times its source's size; what lies above is shared again by
weight among the others until none is above. A source's rate is its target divided by its size. A document
is taken floor(rate) times, plus once more where a number drawn from a hash of its id lies below the rest of the rate. Of
``SEEDS`` seeds of that hash, each source takes the one whose draws come nearest to its target.

The sharing is solved in closed form: with sources ordered by cap per weight, those in front are capped and the others
get their weight times one common level.

Defined cases: null text and text without words have size 0 and add nothing to any target; an empty source has target 0
and is taken floor(0) times. Null is a source of its own. Repeated rows and rows of equal id draw the same number, a null id
draws that of an empty text. Extra columns travel along in ``mixed_rows`` and are ignored in ``mix``.

Only (source, size) sums are shuffled: one row per source and task. The table of sources joins by broadcast
when it has at most ``BROADCAST_SOURCES`` rows, and by a shuffled join beyond that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickmill.llm.common import n_words, small, stored

MOST = 3
WEIGHTS = (1, 2, 3)
BROADCAST_SOURCES = 50_000
# Hash seeds tried; each source uses the one that comes nearest to its target.
SEEDS = 16


def draws(doc_id: Column) -> Column:
    """``SEEDS`` numbers in [0, 1) from md5 digests of the id's text: the same on every run."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    digests = [F.md5(F.concat(text, F.lit(f":{k}")).cast("binary")) for k in range(SEEDS // 4)]
    parts = (F.substring(d, 8 * p + 1, 8) for d in digests for p in range(4))
    return F.array(*(F.conv(part, 16, 10).cast("double") / F.lit(float(2**32)) for part in parts))


def targets(sized: DataFrame) -> DataFrame:
    """source, source_size, target: one row per source of ``sized(source, size)``."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # The table of sources is small; its order needs one place.
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    weighed = sums.withColumn("place", F.row_number().over(by_name)).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("place") - 1) % len(WEIGHTS) + 1).cast("int")).cast("long")
    ).withColumn("cap", F.col("source_size") * MOST)
    by_cap = Window.partitionBy(F.lit(0)).orderBy((F.col("cap") / F.col("weight")).asc(), F.col("place"))
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    all_ = Window.partitionBy(F.lit(0))
    levelled = weighed.withColumn(
        "level",
        (F.sum("source_size").over(all_) - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double")
        / F.sum("weight").over(after).cast("double"),
    ).withColumn("capped", F.col("cap").cast("double") <= F.col("level") * F.col("weight"))
    # The first source that is not capped sets the level of all behind it.
    level = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), "place", "level"))).over(all_)["level"]
    return levelled.withColumn("common", level).select(
        "source",
        "source_size",
        F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("common") * F.col("weight")).alias("target"),
    )


def shares_of(sized: DataFrame) -> DataFrame:
    """_source, source_size, target, seed: a row per source of ``sized(doc_id, source, size)``, a written table.

    The seed is the one of ``SEEDS`` whose draws take the number of words nearest to the target.
    """
    shares = stored(targets(sized).withColumnRenamed("source", "_source"), "targets")
    u = draws(F.col("doc_id"))
    joined = sized.join(small(shares, BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("_source")))
    once = joined.select("_source", "size", F.floor(_rate()).alias("whole"), (_rate() - F.floor(_rate())).alias("part"), u.alias("u"))
    sums = once.groupBy("_source").agg(
        *(F.sum(F.col("size") * (F.col("whole") + (F.col("u")[k] < F.col("part")).cast("int"))).alias(f"t{k}") for k in range(SEEDS))
    )
    apart = F.array(*(F.abs(F.col(f"t{k}") - F.col("target")) for k in range(SEEDS)))
    best = sums.withColumnRenamed("_source", "_same").join(shares, F.col("_same").eqNullSafe(F.col("_source")))
    return stored(best.select("_source", "source_size", "target", F.array_position(apart, F.array_min(apart)).cast("int").alias("seed")), "shares")


def _rate() -> Column:
    return F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))


def with_copies(rows: DataFrame, shares: DataFrame) -> DataFrame:
    """``rows`` (with doc_id and source) with source_size, target and n_copies."""
    joined = rows.join(small(shares, BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("_source")), "left")
    drawn = F.element_at(draws(F.col("doc_id")), F.col("seed"))
    extra = (drawn < _rate() - F.floor(_rate())).cast("int")
    return joined.withColumn("n_copies", (F.floor(_rate()) + extra).cast("long")).drop("_source", "seed")


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size of every document, written: texts are read once."""
    return stored(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken (size times copies) of every document."""
    sized = sizes(docs)
    return with_copies(sized, shares_of(sized)).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("n_copies")).alias("taken")
    )


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, numbered from 1 in ``copy_no``."""
    slim = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "source")
    counted = with_copies(slim, shares_of(sizes(docs))).where("n_copies > 0").select("_row", "n_copies")
    return counted.select("_row.*", F.explode(F.sequence(F.lit(1), F.col("n_copies").cast("int"))).alias("copy_no"))


SQL = r"""
    WITH sized AS (
      SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
      FROM documents
    ), sums AS (
      SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
    ), weighed AS (
      SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place,
             CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS weight, source_size * 3 AS cap
      FROM sums
    ), levelled AS (
      SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (
                  ORDER BY CAST(cap AS DOUBLE) / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
                / CAST(sum(weight) OVER (
                  ORDER BY CAST(cap AS DOUBLE) / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
      FROM weighed
    ), marked AS (
      SELECT *, cap <= level * weight AS capped FROM levelled
    ), shares AS (
      SELECT source, source_size,
             CASE WHEN capped THEN CAST(cap AS DOUBLE)
                  ELSE (SELECT arg_min(level, (CAST(cap AS DOUBLE) / weight, place)) FROM marked WHERE NOT capped) * weight END AS target
      FROM marked
    ), rated AS (
      SELECT d.doc_id, d.size, d.source, s.source_size, s.target,
             CASE WHEN s.source_size > 0 THEN s.target / s.source_size ELSE 0.0 END AS rate, k.k
      FROM sized d JOIN shares s ON d.source IS NOT DISTINCT FROM s.source CROSS JOIN (SELECT unnest(range(16)) AS k) k
    ), drawn AS (
      SELECT *, CAST(size * (floor(rate) + CASE WHEN CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || (k // 4)),
                                                                      CAST(8 * (k % 4) + 1 AS INTEGER), 8)) AS BIGINT) / 4294967296.0
                                                     < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
      FROM rated
    ), summed AS (
      SELECT source, k, abs(sum(taken) - any_value(target)) AS apart FROM drawn GROUP BY source, k
    ), chosen AS (
      SELECT source, arg_min(k, (apart, k)) AS k FROM summed GROUP BY source
    )
    SELECT doc_id, size, source_size, target, taken
    FROM drawn d JOIN chosen c ON d.source IS NOT DISTINCT FROM c.source AND d.k = c.k
"""
