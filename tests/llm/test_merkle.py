"""Manifest, witnesses and verification against a plain tree."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import SCHEMA, frame, odd
from wickmill.llm import merkle


def H(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(value) -> str:
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row, text) -> str:
    return H("".join(map(field, (row.doc_id, row.source, row.lang, row.n_chars, text))))


def low(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def tree(leaves):
    """Root and, per leaf, the siblings (before, after) of every level."""
    paths, own, nodes = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(nodes) > 1:
        for i, k in enumerate(own):
            run = nodes[k // 8 * 8 : k // 8 * 8 + 8]
            paths[i].append(("".join(run[: k % 8]), "".join(run[k % 8 + 1 :])))
            own[i] = k // 8
        nodes = [H("".join(nodes[k : k + 8])) for k in range(0, len(nodes), 8)]
    return nodes[0], paths


def brute(rows):
    langs = {}
    for row in rows:
        langs.setdefault(row.lang, []).append(row)
    for group in langs.values():
        group.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    subs = [tree([leaf(r, r.text) for r in langs[name]]) for name in names]
    root, tops = tree([sub for sub, _ in subs]) if subs else (None, [])
    found = []
    for name, (sub, paths), top in zip(names, subs, tops):
        for row, path in zip(langs[name], paths):
            own = leaf(row, row.text)
            hit = row.doc_id is not None and zlib.crc32(str(row.doc_id).encode()) % 3 == 0
            node = leaf(row, low(row.text)) if hit else own
            for before, after in path + top:
                node = H(before + node + after)
            proof = H("".join(before + after for before, after in path + top))
            found.append((row.doc_id, own, sub, root, proof, node, node == root))
    return found


def check(docs):
    got = merkle.audit(docs).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(docs.collect()), key=str)
    return got


@pytest.mark.parametrize("lift", [1, 2, 4])
def test_against_a_plain_tree(spark, monkeypatch, lift):
    # With a low lift a language takes several rounds of block roots.
    monkeypatch.setattr(merkle, "LIFT", lift)
    rng = random.Random(lift)
    sizes = {"en": 150 if lift == 1 else 700, "dé": 65, "a": 64, None: 9, "fr": 8, "b": 1}
    langs = [lang for lang, n in sizes.items() for _ in range(n)]
    rng.shuffle(langs)
    got = check(frame(spark, [f"Text {k} é" if k % 5 else None for k in range(len(langs))], langs).repartition(7))
    assert {r.verified for r in got} == {True, False}


def test_odd_and_empty_tables(spark):
    check(odd(spark))
    check(odd(spark).limit(0))
    one = spark.createDataFrame([(1, "A", "en", None, 1, 0.0, True, 1, "")], SCHEMA)
    assert check(one)[0].proof_sha256 == H("")
    many = spark.createDataFrame([(k, "A", f"l{k}", None, 1, 0.0, True, 1, "") for k in range(70)], SCHEMA)
    check(many)


def test_a_witness_tells_any_other_leaf(spark):
    docs = frame(spark, [f"t{k}" for k in range(30)], ["en"] * 30)
    rows = merkle.manifest(docs, F.sha2(F.concat("text", F.lit("!")), 256))
    good = rows.select((merkle.folded(F.col("leaf"), F.col("witness")) == F.col("root")).alias("same"))
    bad = rows.select((merkle.folded(F.col("claimed"), F.col("witness")) == F.col("root")).alias("same"))
    assert {r.same for r in good.collect()} == {True} and {r.same for r in bad.collect()} == {False}


def test_an_open_tree_extends_witnesses_as_siblings_arrive():
    stream, first = merkle.OpenTree(2), []
    stream.append("0", first)
    for k in range(1, 8):
        assert first == []
        stream.append(str(k))
    assert first == [("", "1234567")]
    stream.append("8")
    assert len(first) == 1
    root = stream.finish()
    assert first[1] == ("", H("8")) and root == H(H("01234567") + H("8"))
