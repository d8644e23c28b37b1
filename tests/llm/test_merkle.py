"""The manifest against a plain tree, level by level."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from depotlens.llm import merkle

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_leaf(doc_id, text, lang, source, n_chars):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def siblings(levels, number):
    """[(place, others)] from the leaf up"""
    found = []
    for level in levels[:-1]:
        first = number // 16 * 16
        found.append((number - first, [x for i, x in enumerate(level[first : first + 16], first) if i != number]))
        number //= 16
    return found


def brute(rows):
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees, out = {}, []
    for source in sources:
        own = sorted((r for r in rows if r[3] == source), key=lambda r: (r[0] is not None, r[0] or 0, brute_leaf(*r)))
        trees[source] = own, levels_of([brute_leaf(*r) for r in own])
    top = levels_of([trees[s][1][-1][0] for s in sources])
    for at, source in enumerate(sources):
        own, levels = trees[source]
        for number, row in enumerate(own):
            path = siblings(levels, number) + siblings(top, at)
            claimed = row
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[1] is not None:
                claimed = (row[0], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in row[1]), *row[2:])
            node = brute_leaf(*claimed)
            for place, others in path:
                node = sha("".join([*others[:place], node, *others[place:]]))
            proof = sha("".join(x for _, others in path for x in others))
            position = sum(number // 16**m for m in range(12))
            out.append((row[0], levels[0][number], levels[-1][0], top[-1][0], proof, node, node == top[-1][0], position))
    return out


def made(count, sources, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(count):
        source = rng.choice(["hot", "hot", None, "", *[f"s{j}é" for j in range(sources)]])
        rows.append((i * 3, rng.choice(["Text", "lower", "", "É only", f"Long {'x' * rng.randint(0, 50)}"]), rng.choice(["en", None]), source, rng.choice([None, i])))
    return rows + [(None, "no id", None, "hot", 3), (None, None, None, None, None), (6, "again", "en", "hot", 1), (6, "Again", "en", "hot", 1), (6, "Again", "en", "hot", 1), (5, None, "en", "alone", 0)]


@pytest.mark.parametrize(("count", "sources", "height"), [(700, 20, 3), (700, 3, 1), (900, 300, 1), (0, 0, 3), (600, 0, 2)])
def test_like_a_plain_tree(spark, count, sources, height):
    rows = made(count, sources)
    frame = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("x").alias(c) for c in ("tree", "number", "total", "digest", "segment", "path", "_part")])
    got = [tuple(r) for r in merkle.verified_manifest(frame.repartition(5), height).collect()]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    assert not all(r[6] for r in got) or count == 0


@pytest.mark.parametrize("n", [1, 15, 16, 17, 255, 256, 257, 300, 4096, 4097])
def test_closed_positions_are_those_of_an_appended_log(n):
    leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
    height = merkle.heights(n, 99, True)
    log = merkle.append_log(leaves, height)
    levels = levels_of([d.hex() for d in leaves])
    assert len(levels) == height + 1 and len(log) == sum(map(len, levels))
    for level, nodes in enumerate(levels):
        for number, node in enumerate(nodes):
            assert log[merkle.position(n, height, level, number)].hex() == node


def test_paths_lead_to_the_root(spark):
    rows = made(400, 5, 7)
    manifest = merkle.manifest(spark.createDataFrame(rows, SCHEMA), height=1)
    for r in merkle.proofs(manifest, with_path=True).collect():
        path = [{"place": p.place, "others": bytes(p.others)} for p in r.path]
        assert merkle.fold(bytes(r.digest), path) == manifest.root == bytes(r.folded)
        if path:
            assert merkle.fold(hashlib.sha256(b"other").digest(), path) != manifest.root


def test_empty_table(spark):
    assert merkle.verified_manifest(spark.createDataFrame([], SCHEMA)).collect() == []
