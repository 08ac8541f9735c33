"""Merkle manifest of a dataset, with a witness for every row, by incremental appends.

A row's leaf is the digest of its fields, each written with its length. Per language, leaves stand in order of doc_id and every
``ARITY`` neighbours are hashed into a parent until one node, the subroot, is left; the subroots, in order of language, are
hashed likewise into the root. A witness names the siblings on the way from a leaf to the root: one pair (before, after) of
joined digests a level. Folding a leaf with its witness gives the root again, and no other leaf does.

Leaves are appended in order to a tree of open subtrees (:class:`OpenTree`). A leaf's witness is attached to the open subtree
that holds it, and grows whenever that subtree gets its last sibling. Spark deals leaves into aligned blocks of
``ARITY ** LIFT``, one append stream each. The root of a block is a further append to the tree of blocks above, and so on;
then witnesses come down: what a block's root collected above is attached to all that its own stream collected. No task holds
more than one block, whatever the size of a language; texts are hashed where they are read and are never shuffled.

Defined cases: null fields are written ``-``; null is a language of its own and comes first; null ids come first. Rows of
equal id stand in order of their leaves, so repeated rows are neighbours with leaves of their own. A language with one row has
its leaf as subroot, a table with one language has its subroot as root. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickmill.llm.common import map_rows, small, stored

ARITY = 8
# Levels that one append stream climbs: a block holds at most ARITY ** LIFT nodes.
LIFT = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

WITNESS = "array<struct<before: string, after: string>>"
NODE = "key string, pos long, n long, digest string, doc_id long, tag string"


def levels_of(n: int) -> int:
    """Levels above ``n`` nodes until one node is left."""
    levels = 0
    while n > 1:
        n = -(-n // ARITY)
        levels += 1
    return levels


class OpenTree:
    """An append stream: the subtrees that wait for siblings, from the lowest level up.

    ``witness`` lists given to :meth:`append` are extended in place as the subtrees above them are completed.
    """

    def __init__(self, levels: int):
        self.runs: list[list[tuple[str, list[list]]]] = [[] for _ in range(levels)]
        self.root: str | None = None

    def append(self, digest: str, witness: list | None = None) -> None:
        self._add(0, digest, [] if witness is None else [witness])

    def _add(self, level: int, digest: str, below: list[list]) -> None:
        if level == len(self.runs):
            self.root = digest
            return
        self.runs[level].append((digest, below))
        if len(self.runs[level]) == ARITY:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.runs[level] = self.runs[level], []
        digests = [digest for digest, _ in run]
        below = []
        for k, (_, witnesses) in enumerate(run):
            step = ("".join(digests[:k]), "".join(digests[k + 1 :]))
            for witness in witnesses:
                witness.append(step)
            below += witnesses
        self._add(level + 1, hashlib.sha256("".join(digests).encode()).hexdigest(), below)

    def finish(self) -> str | None:
        """Close the last, shorter runs level by level; the root of the stream."""
        for level in range(len(self.runs)):
            if self.runs[level]:
                self._complete(level)
        return self.root


# -- leaves --------------------------------------------------------------------------------------------------------


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(**replaced: Column) -> Column:
    """Digest of a row's fields; ``replaced`` gives other values for some of them."""
    return F.sha2(F.concat(*(_field(replaced.get(name, F.col(name))) for name in FIELDS)), 256)


def lowered(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _lang_key() -> Column:
    """A text that is never null and sorts as the language does, null first."""
    return F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))


def _lang_of(key: Column) -> Column:
    return F.when(key != "", key.substr(F.lit(2), F.length(key)))


# -- up ------------------------------------------------------------------------------------------------------------


def placed(items: DataFrame, order: list[str]) -> DataFrame:
    """Nodes (``NODE``) of a written table of items: ``pos`` in ``order`` among the ``n`` of their key.

    Rows are dealt by ranges of the order, so one hot key spreads over many tasks; a row's place is its place in its task plus the
    rows of the key in tasks before. That needs one short row per task and key.
    """
    in_order = items.repartitionByRange("key", *order).sortWithinPartitions("key", *order)
    rows = stored(
        in_order.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")), "places"
    )
    runs = rows.groupBy("key", "part").agg(F.count(F.lit(1)).alias("rows"), F.min("row").alias("first"))
    whole = Window.partitionBy("key")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = stored(
        runs.select(
            "key",
            "part",
            (F.col("first") - F.coalesce(F.sum("rows").over(before), F.lit(0))).alias("shift"),
            F.sum("rows").over(whole).alias("n"),
        ),
        "shifts",
    )
    joined = rows.join(small(shifts), ["key", "part"])
    return joined.select("key", (F.col("row") - F.col("shift")).alias("pos"), "n", "digest", "doc_id", "tag")


def _blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / ARITY**LIFT).cast("long"))


def _streams(rows: DataFrame) -> DataFrame:
    """Every block of a key in one task, in order."""
    return rows.repartition("key", "block").sortWithinPartitions("key", "block", "pos")


def lifted(nodes: DataFrame) -> DataFrame:
    """One node per block: the root of its append stream, with its place among the blocks of the key."""

    def task(rows: Iterator[tuple]) -> Iterator[tuple]:
        at = tree = above = None
        for key, block, n, digest in rows:
            if at != (key, block):
                if tree:
                    yield (*at, above, tree.finish(), None, None)
                at, tree, above = (key, block), OpenTree(min(LIFT, levels_of(n))), -(-n // ARITY**LIFT)
            tree.append(digest)
        if tree:
            yield (*at, above, tree.finish(), None, None)

    return map_rows(_streams(_blocks(nodes)), ["key", "block", "n", "digest"], NODE, task)


def climb(nodes: DataFrame) -> list[DataFrame]:
    """The nodes, their block roots, the block roots of those and so on, until every key has one node."""
    levels = [nodes]
    while (levels[-1].agg(F.max("n")).first()[0] or 0) > 1:
        levels.append(stored(lifted(levels[-1]), "block-roots"))
    return levels


# -- down ----------------------------------------------------------------------------------------------------------

_BELOW = f"{NODE}, subroot string, witness {WITNESS}"


def witnessed(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """Nodes with their witnesses: what their stream collects and then what ``above`` (key, pos, subroot, witness) has for the block."""
    heads = above.select(
        "key", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), "subroot", F.col("witness").alias("upper")
    )
    rows = _streams(_blocks(nodes).unionByName(heads, allowMissingColumns=True))

    def task(rows: Iterator[tuple]) -> Iterator[tuple]:
        held: list[tuple] = []
        tree = subroot = upper = None

        def out() -> Iterator[tuple]:
            tree.finish()
            for row, witness in held:
                yield (*row, subroot, witness + upper)

        for key, pos, n, digest, doc_id, tag, head, steps in rows:
            if pos < 0:
                # The head of a block comes before its nodes.
                if held:
                    yield from out()
                held, tree, subroot = [], None, head
                upper = [(step["before"], step["after"]) for step in steps]
                continue
            tree = tree or OpenTree(min(LIFT, levels_of(n)))
            witness: list[tuple[str, str]] = []
            held.append(((key, pos, n, digest, doc_id, tag), witness))
            tree.append(digest, witness)
        if held:
            yield from out()

    return map_rows(rows, ["key", "pos", "n", "digest", "doc_id", "tag", "subroot", "upper"], _BELOW, task)


def descend(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """Witnesses of the lowest of ``levels``, given those of the highest."""
    for k, nodes in enumerate(reversed(levels[:-1])):
        below = witnessed(nodes, above)
        above = below if k == len(levels) - 2 else stored(below, "witnesses")
    return above


def manifest(docs: DataFrame, claimed: Column | None = None) -> DataFrame:
    """doc_id, lang, leaf, claimed, subroot, root, witness of every row.

    ``claimed`` is a digest over columns of ``docs`` that travels along, by default the leaf.
    """
    leaf = leaf_of()
    leaves = stored(
        docs.select(_lang_key().alias("key"), "doc_id", leaf.alias("digest"), (leaf if claimed is None else claimed).alias("tag")),
        "leaves",
    )
    levels = climb(placed(leaves, ["doc_id", "digest"]))
    # The subroots are the leaves of the tree above: one key, in order of language.
    subroots = levels[-1].select(F.lit("").alias("key"), F.lit(None).cast("long").alias("doc_id"), "digest", F.col("key").alias("tag"))
    tops = climb(stored(placed(stored(subroots, "subroots"), ["tag"]), "languages"))
    top = tops[-1].withColumn("subroot", F.col("digest")).withColumn("witness", F.array().cast(WITNESS))
    root = top.select("digest").first()
    languages = descend(tops, top)
    above = stored(
        languages.select(F.col("tag").alias("key"), F.lit(0).cast("long").alias("pos"), F.col("digest").alias("subroot"), "witness"), "upper"
    )
    if len(levels) == 1:
        # Every language has one row, which is its subroot.
        rows = levels[0].join(above.drop("pos"), "key")
    else:
        rows = descend(levels, above)
    return rows.select(
        "doc_id",
        _lang_of(F.col("key")).alias("lang"),
        F.col("digest").alias("leaf"),
        F.col("tag").alias("claimed"),
        "subroot",
        F.lit(root[0] if root else None).cast("string").alias("root"),
        "witness",
    )


# -- checks --------------------------------------------------------------------------------------------------------


def proof_digest(witness: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(witness, lambda step: F.concat(step["before"], step["after"])), ""), 256)


def folded(leaf: Column, witness: Column) -> Column:
    """The root that a leaf and a witness lead to."""
    return F.aggregate(witness, leaf, lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]), 256))


def audit(docs: DataFrame) -> DataFrame:
    """The manifest in digests, and which rows still verify after their text was put into lower case where 3 divides the id's CRC-32."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    rows = manifest(docs, F.when(hit, leaf_of(text=lowered(F.col("text")))).otherwise(leaf_of()))
    checked = rows.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        proof_digest(F.col("witness")).alias("proof_sha256"),
        folded(F.col("claimed"), F.col("witness")).alias("folded_root"),
    )
    return checked.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql(levels: int = 8, language_levels: int = 3) -> str:
    """The audit in SQL, for up to ARITY ** levels rows a language and ARITY ** language_levels languages."""

    def field(value: str) -> str:
        return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"

    def leaf(**replaced: str) -> str:
        return "sha256(" + " || ".join(field(replaced.get(name, name)) for name in FIELDS) + ")"

    low = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    # CRC-32 bit by bit: each byte is followed by eight steps, written -1.
    crc = """xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
               lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
               lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END))"""
    parts = [
        f"""leaves AS (
      SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
             CASE WHEN coalesce({crc} % 3 = 0, false) THEN lower_leaf ELSE leaf END AS claimed
      FROM (SELECT doc_id, coalesce('=' || lang, '') AS key, {leaf()} AS leaf, {leaf(text=low)} AS lower_leaf FROM documents))""",
        "t0 AS (SELECT key, pos, leaf AS digest, count(*) OVER (PARTITION BY key) AS n FROM leaves)",
    ]

    def climb(table: str, levels: int) -> None:
        for k in range(levels):
            parts.append(f"""{table}{k + 1} AS (
      SELECT key, up AS pos, CASE WHEN max(n) = 1 THEN max(digest) ELSE sha256(string_agg(digest, '' ORDER BY pos)) END AS digest,
             (max(n) + {ARITY - 1}) // {ARITY} AS n
      FROM (SELECT *, pos // {ARITY} AS up FROM {table}{k}) GROUP BY key, up)""")
            run = f"OVER (PARTITION BY key, pos // {ARITY} ORDER BY pos ROWS BETWEEN"
            parts.append(f"""{table}s{k} AS (
      SELECT key, pos, n > 1 AS climbs, coalesce(string_agg(digest, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
             coalesce(string_agg(digest, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
      FROM {table}{k})""")

    climb("t", levels)
    parts.append(
        f"m0 AS (SELECT '' AS key, row_number() OVER (ORDER BY key) - 1 AS pos, digest, count(*) OVER () AS n, key AS lang_key FROM t{levels})"
    )
    climb("m", language_levels)
    parts.append("w0 AS (SELECT doc_id, leaf, key AS lang_key, key, pos, '' AS proof, claimed AS node FROM leaves)")
    step = f"""SELECT w.* REPLACE (w.pos // {ARITY} AS pos, CASE WHEN climbs THEN proof || before || after ELSE proof END AS proof,
                   CASE WHEN climbs THEN sha256(before || node || after) ELSE node END AS node)"""
    for k in range(levels):
        parts.append(f"w{k + 1} AS ({step} FROM w{k} w JOIN ts{k} s ON w.key = s.key AND w.pos = s.pos)")
    parts.append(
        f"v0 AS (SELECT w.* REPLACE (m.pos AS pos, '' AS key), m.digest AS subroot FROM w{levels} w JOIN m0 m ON w.lang_key = m.lang_key)"
    )
    for k in range(language_levels):
        parts.append(f"v{k + 1} AS ({step} FROM v{k} w JOIN ms{k} s ON w.key = s.key AND w.pos = s.pos)")
    return (
        "WITH " + ",\n    ".join(parts) + f"""
    SELECT doc_id, leaf, subroot, (SELECT max(digest) FROM m{language_levels}) AS root, sha256(proof) AS proof_sha256,
           node AS folded_root, node = (SELECT max(digest) FROM m{language_levels}) AS verified
    FROM v{language_levels}"""
    )


SQL = _sql()
