"""Line dedup: a segment-partition edit join over all lines of the corpus.

Lines are the ``\\n``-split parts of a text that have a word or at least ``MIN_BYTES`` bytes. Equal
lines form a class, whose place is its first (doc_id, line number). Two classes of lines of ``MIN_BYTES`` or more are linked when their lines are
at most ``EDITS`` edits (insert, delete, replace one byte of UTF-8) apart; in shorter lines so many edits may change the words, so
they are dropped for equality only. With ``short_links=True`` shorter lines are linked too, so every pair is counted; such links tell and do not
drop. With ``short_copies=False`` shorter lines are never touched. A line is kept when it stands at its class's place and no class that
is linked and, like its own, of ``MIN_BYTES`` or more has an earlier place.

The join: every line is cut into ``EDITS + 1`` segments of even length, one of which survives any ``EDITS`` edits whole. Segments are
indexed under (line length, segment number, bytes). Each line probes, for its own length and each shorter one within reach, the
few substrings at which a segment can still stand. Pairs whose counts of some characters are too far apart are left inside the
join. Candidates are verified with a banded bit-parallel edit distance: for each
number of errors one word holds the band's diagonals, and a step is a few shifts and bit operations.

Everything is DataFrame functions. Equal lines are folded by a map-side sum before the join, so a line that
fills a third of the corpus is one class. Index and probes carry only hashes and numbers; texts are fetched for candidate lines alone.
Index keys are 48-bit hashes, which can only add candidates, and verification removes them.

Defined cases: null and empty text has no lines; a document keeps its lines without a word; equal places are equal rows (repeated rows of a
document are all kept or all dropped alike). Rows without an id stand behind all others: their lines are
dropped where some row with an id has them and kept elsewhere. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wickmill.llm.common import WORD, small, stored

EDITS = 2
MIN_BYTES = 48
# Characters whose counts, by 8, are kept of every line: an edit changes two of them by one at most. The first ``QUICK`` of them travel
# with every key, all of them with the lines that are verified.
COUNTED = "etaoinshrdlu123456789"
QUICK = 8


def lines_of(docs: DataFrame, min_bytes: int = MIN_BYTES, short_copies: bool = True) -> DataFrame:
    """doc_id, line_no (from 1), line: every line that is long enough, or every line that is so or has a word."""
    taken = F.octet_length("line") >= min_bytes
    if short_copies:
        taken = taken | F.col("line").rlike(WORD)
    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
        .where(taken)
        .select("doc_id", (F.col("line_no") + 1).alias("line_no"), "line")
    )


def place(doc_id: Column, line_no: Column) -> Column:
    """One number that orders lines by document, then by line."""
    return (doc_id.cast("decimal(20,0)") * F.lit(2**32).cast("decimal(10,0)") + line_no.cast("decimal(10,0)")).cast("decimal(38,0)")


def _segment(length: Column, number: int, parts: int) -> tuple[Column, Column]:
    """Start (from 1) and length of a segment; the last ones take the bytes left over."""
    base = F.floor(length / parts).cast("int")
    longer_from = F.lit(parts) - length % parts
    start = base * number + F.greatest(F.lit(number) - longer_from, F.lit(0)) + 1
    return start.cast("int"), (base + (F.lit(number) >= longer_from).cast("int")).cast("int")


def _key(length: Column, number: int, part: Column) -> Column:
    # 48 bits are told apart well enough, and fewer bytes travel.
    return F.shiftrightunsigned(F.xxhash64(length, F.lit(number), part), 16)


def index_keys(line: Column, n: Column, edits: int = EDITS) -> list[Column]:
    keys = []
    for number in range(edits + 1):
        start, width = _segment(n, number, edits + 1)
        keys.append(_key(n, number, F.substring(line, start, width)))
    return keys


def probe_keys(line: Column, n: Column, edits: int = EDITS, own: bool = True) -> list[Column]:
    """Keys of all substrings at which a segment of a line of length n, n - 1, ... n - edits can stand; ``own`` includes the line's own segments."""
    keys = []
    for less in range(edits + 1):
        length = n - less
        for number in range(edits + 1):
            start, width = _segment(length, number, edits + 1)
            left, right = number, edits - number
            for shift in range(max(-left, less - right), min(left, less + right) + 1):
                if own or less or shift:
                    keys.append(_key(length, number, F.substring(line, start + shift, width)))
    return keys


def count_signature(line: Column, letters: str = COUNTED) -> Column:
    """Three bits for the count of each of the letters."""
    packed = F.lit(0).cast("long")
    for k, c in enumerate(letters):
        n = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c)))
        packed = packed.bitwiseOR(F.shiftleft((n % 8).cast("long"), 3 * k))
    return packed


def counts_apart(a: Column, b: Column, letters: int = len(COUNTED)) -> Column:
    """At most the sum of differences of the counts: never above twice the number of edits between the lines."""
    total = F.lit(0)
    for k in range(letters):
        apart = F.abs(F.shiftright(a, 3 * k).bitwiseAND(F.lit(7)) - F.shiftright(b, 3 * k).bitwiseAND(F.lit(7)))
        total = total + F.least(apart, 8 - apart)
    return total


def within(a: Column, b: Column, n_a: Column, n_b: Column, edits: int = EDITS) -> Column:
    """Whether two byte strings are at most ``edits`` edits apart: banded, bit-parallel.

    Bit d + edits of word e says that the first i bytes of ``a`` and i + d of ``b`` are within e edits. Needs
    abs(n_a - n_b) <= edits and n_a >= 1.
    """
    band = 2 * edits + 1
    full = (1 << band) - 1
    matches = F.transform(
        F.sequence(F.lit(1), n_a),
        lambda i: sum(
            (
                F.when((i + d >= 1) & (F.substring(a, i, F.lit(1)) == F.substring(b, i + d, F.lit(1))) & (i + d <= n_b), F.lit(1 << (d + edits))).otherwise(F.lit(0))
                for d in range(-edits + 1, edits + 1)
            ),
            F.when((i - edits >= 1) & (F.substring(a, i, F.lit(1)) == F.substring(b, i - edits, F.lit(1))), F.lit(1)).otherwise(F.lit(0)),
        ),
    )

    def step(words: Column, match: Column) -> Column:
        new: list[Column] = []
        for e in range(edits + 1):
            value = words[f"r{e}"].bitwiseAND(match)
            if e:
                old = words[f"r{e - 1}"]
                value = (
                    value.bitwiseOR(old)
                    .bitwiseOR(F.shiftright(old, 1))
                    .bitwiseOR(F.shiftleft(new[e - 1], 1))
                    .bitwiseAND(F.lit(full))
                )
            new.append(value)
        return F.struct(*(v.alias(f"r{e}") for e, v in enumerate(new)))

    first = F.struct(*(F.lit(sum(1 << (d + edits) for d in range(e + 1))).alias(f"r{e}") for e in range(edits + 1)))
    last = F.aggregate(matches, first, step)[f"r{edits}"]
    return F.call_function("shiftright", last, n_b - n_a + edits).bitwiseAND(F.lit(1)) == 1


def line_classes(lines: DataFrame) -> DataFrame:
    """id, line (bytes), n, first (place), copies, counts: a row per different line."""
    return (
        lines.groupBy("line")
        .agg(F.min(place(F.col("doc_id"), F.col("line_no"))).alias("first"), F.count("*").alias("copies"))
        .select(
            F.monotonically_increasing_id().alias("id"),
            F.col("line").cast("binary").alias("line"),
            F.octet_length("line").alias("n"),
            "first",
            "copies",
            count_signature(F.col("line"), COUNTED[:QUICK]).cast("int").alias("counts"),
        )
    )


def _indexed(classes: DataFrame, edits: int, *columns: str) -> DataFrame:
    keys = F.explode(F.array(*index_keys(F.col("line"), F.col("n"), edits))).alias("key")
    return classes.select(*(F.col(c).alias(f"of_{c}") for c in ("id", "counts", *columns)), keys)


def _probing(classes: DataFrame, edits: int, *columns: str, own: bool = True) -> DataFrame:
    keys = F.explode(F.array(*probe_keys(F.col("line"), F.col("n"), edits, own))).alias("key")
    return classes.select("id", "counts", *columns, keys)


def similar_lines(classes: DataFrame, edits: int = EDITS) -> DataFrame:
    """a, b, first_a, first_b, shorter (bytes): every pair of different lines at most ``edits`` apart, once. ``classes`` is a written table.

    The big join only tells which lines have a candidate, a row per probe at most. A line's own segments are index and probe at once:
    they are sent once and meet each other there. Lines that have a candidate are
    joined again with their texts, and verified inside that join, so pairs that fail are never written. Lines may be of any length from one
    byte on: of shorter ones than ``edits + 1`` some segments are empty, and meet all lines of their length.
    """

    def near(letters: int) -> Column:
        return (F.col("of_id") != F.col("id")) & (counts_apart(F.col("of_counts"), F.col("counts"), letters) <= 2 * edits)

    def meets(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
        found = left.alias("l").join(right.alias("r"), (F.col("l.key") == F.col("r.key")) & near(QUICK), "left_semi")
        return found.select(F.col(name).alias("id"))

    index = _indexed(classes, edits)
    # The same rows under the names of a probe; both sides read one exchange.
    own = index.select(F.col("of_id").alias("id"), F.col("of_counts").alias("counts"), "key")
    probes = _probing(classes, edits, own=False)
    met = meets(own, index.hint("shuffle_hash"), "id").unionByName(meets(probes, index.hint("shuffle_hash"), "id"))
    probing = stored(met.distinct(), "line-ids")
    askers = stored(classes.join(small(probing), "id", "left_semi"), "asking-lines")
    asked = stored(meets(index, small(stored(_probing(askers, edits), "asking-keys")), "of_id").distinct(), "line-ids")
    ids = stored(probing.unionByName(asked).distinct(), "line-ids")
    full = classes.join(small(ids), "id", "left_semi").withColumn("counts", count_signature(F.col("line").cast("string")))
    few = stored(full, "near-lines")

    index, probes = _indexed(few, edits, "line", "n", "first").alias("l"), _probing(few, edits, "line", "n", "first").alias("r")
    same = within(F.col("of_line"), F.col("line"), F.col("of_n"), F.col("n"), edits)
    close = near(len(COUNTED)) & (F.abs(F.col("of_n") - F.col("n")) <= edits) & same
    pairs = index.join(probes, (F.col("l.key") == F.col("r.key")) & close)
    up = F.col("of_id") > F.col("id")
    return pairs.select(
        F.greatest("of_id", "id").alias("a"),
        F.least("of_id", "id").alias("b"),
        F.when(up, F.col("of_first")).otherwise(F.col("first")).alias("first_a"),
        F.when(up, F.col("first")).otherwise(F.col("of_first")).alias("first_b"),
        F.least("of_n", "n").alias("shorter"),
    ).distinct()


def _digests(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(7), line).alias("h2")]


def judge_lines(
    docs: DataFrame, edits: int = EDITS, min_bytes: int = MIN_BYTES, short_copies: bool = True, short_links: bool = False
) -> DataFrame:
    """doc_id, line_no, class_doc, class_line, copies, n_links, kept: a row per line that ``lines_of`` takes."""
    lines = lines_of(docs, min_bytes, short_copies)
    classes = stored(line_classes(lines), "line-classes", compression="zstd")
    linkable = classes if short_links else classes.where(F.col("n") >= min_bytes)
    links = stored(similar_lines(linkable, edits), "line-links")
    # A link of a shorter line is counted, but drops nothing.
    drops = F.col("shorter") >= min_bytes
    both = links.select(F.col("a").alias("id"), F.when(drops, F.col("first_b")).alias("other")).unionByName(
        links.select(F.col("b").alias("id"), F.when(drops, F.col("first_a")).alias("other"))
    )
    linked = stored(both.groupBy("id").agg(F.count("*").alias("n_links"), F.min("other").alias("other")), "linked-lines")
    told = stored(
        classes.join(small(linked), "id", "left")
        .where("copies > 1 OR n_links > 0")
        .select(*_digests(F.col("line")), "first", "copies", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "other"),
        "told-lines",
    )
    here = place(F.col("doc_id"), F.col("line_no"))
    rows = lines.select("doc_id", "line_no", here.alias("here"), *_digests(F.col("line").cast("binary")))
    found = rows.join(small(told), ["h1", "h2"], "left").withColumn("first", F.coalesce("first", "here"))
    big = F.lit(2**32).cast("decimal(10,0)")
    return found.select(
        "doc_id",
        "line_no",
        F.floor(F.col("first") / big).cast("long").alias("class_doc"),
        (F.col("first") - F.floor(F.col("first") / big) * big).cast("int").alias("class_line"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("copies"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        (F.coalesce(F.col("here") == F.col("first"), F.col("first").isNull()) & F.coalesce(F.col("other") > F.col("first"), F.lit(True))).alias("kept"),
    )


def drop_lines(docs: DataFrame, edits: int = EDITS, min_bytes: int = MIN_BYTES, short_copies: bool = True) -> DataFrame:
    """``docs`` without the lines that are not kept, ``n_chars`` counted anew where it is a column.

    A document that had lines to drop and has no word left goes; all others stay.
    """
    dropped = judge_lines(docs, edits, min_bytes, short_copies).where("NOT kept AND doc_id IS NOT NULL")
    gone = dropped.groupBy("doc_id").agg(F.collect_set("line_no").alias("gone"))
    gone = gone.select(F.col("doc_id").alias("_doc"), "gone")
    left = docs.join(gone, F.col("doc_id").cast("long") == F.col("_doc"), "left")
    text = F.when(
        F.col("gone").isNotNull(),
        F.array_join(F.filter(F.split("text", "\n", -1), lambda line, k: ~F.array_contains(F.col("gone"), k + 1)), "\n"),
    ).otherwise(F.col("text"))
    left = left.withColumn("text", text).where(F.col("gone").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        left = left.withColumn("n_chars", F.when(F.col("gone").isNotNull(), F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return left.select(*docs.columns)


SQL = f"""
    WITH lines AS (
      SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line_no, unnest(string_split(text, chr(10))) AS line
      FROM documents
    ), long_lines AS (
      SELECT doc_id, line_no, line, CAST(doc_id AS HUGEINT) * 4294967296 + line_no AS here
      FROM lines WHERE strlen(line) >= {MIN_BYTES} OR regexp_matches(line, '[^\\x20\\x09-\\x0D]')
    ), classes AS (
      SELECT line, strlen(line) AS n, min(here) AS first, count(*) AS copies FROM long_lines GROUP BY line
    ), links AS (
      SELECT x.line, CASE WHEN x.n >= {MIN_BYTES} AND y.n >= {MIN_BYTES} THEN y.first END AS other
      FROM classes x JOIN classes y ON abs(x.n - y.n) <= {EDITS} AND x.first <> y.first AND levenshtein(x.line, y.line) <= {EDITS}
    ), linked AS (
      SELECT line, count(*) AS n_links, min(other) AS other FROM links GROUP BY line
    )
    SELECT l.doc_id, CAST(l.line_no AS INTEGER) AS line_no, CAST(c.first // 4294967296 AS BIGINT) AS class_doc,
           CAST(c.first % 4294967296 AS INTEGER) AS class_line, c.copies, coalesce(k.n_links, 0) AS n_links,
           l.here = c.first AND coalesce(k.other > c.first, true) AS kept
    FROM long_lines l JOIN classes c USING (line) LEFT JOIN linked k USING (line)
"""
