"""Collocations against plain counting."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from depotlens.llm import phrases

SCHEMA = "doc_id bigint, text string, lang string, source string"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows, threshold=10, top=2000, absorbed=50):
    counts, totals = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered(text)):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for length in (1, 2, 3):
                for i in range(len(words) - length + 1):
                    counts[lang, tuple(words[i : i + length])] += 1
    found = {}
    for (lang, words), a in counts.items():
        if len(words) == 1 or a < threshold:
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = counts[lang, words[:k]], counts[lang, words[k:]]
            cuts.append((1_000_000 * a * a // (left * right), k, left, right))
        found[lang, words] = (a, *min(cuts))
    gone = {
        (lang, words[i : i + 2]) for (lang, words), (a, *_) in found.items() if len(words) == 3
        for i in (0, 1) if 100 * a >= absorbed * counts[lang, words[i : i + 2]]
    }
    out = []
    for lang in totals:
        own = [(-s, -a, " ".join(w).encode(), left, right) for (x, w), (a, s, _, left, right) in found.items() if x == lang and (x, w) not in gone]
        for rank, (s, a, phrase, left, right) in enumerate(sorted(own)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -s))
    return sorted(out)


def made(seed, count):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" if i % 7 else f"Wé{i}" for i in range(40)]
    rows = []
    for i in range(count):
        words = [vocabulary[min(int(rng.expovariate(0.15)), 39)] for _ in range(rng.randint(0, 120))]
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", " "]) for w in words)
        rows.append((i, text, rng.choice(["en", "en", "de", None, "und"]), "s"))
    rows += [(1000, None, "en", None), (1001, "", "en", ""), (None, "W1 w2 W3 " * 30, None, None), (7, "new york city. " * 12, "en", "x"), (7, "new york city. " * 12, "en", "x")]
    rows += [(2000 + i, f"only here in france {i}", "fr", "y") for i in range(14)]
    return rows


@pytest.mark.parametrize(("shards", "block", "top"), [(2, 1 << 20, 2000), (3, 64, 2000), (1, 1 << 20, 9), (5, 1 << 20, 2000)])
def test_like_plain_counting(spark, shards, block, top):
    rows = made(shards, 150)
    frame = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("x").alias(c) for c in ("phrase", "n", "shard", "rank", "code")])
    got = phrases.collocations(frame.repartition(4), shards=shards, block_tokens=block, top=top)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, top=top)


def test_tiny_bit_maps_only_cost_time(spark):
    """With a handful of bits nearly every phrase starts early; counts stay right."""
    rows = made(11, 150)
    got = phrases.collocations(spark.createDataFrame(rows, SCHEMA), shards=3, bits=phrases.PIECE_BITS)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


def test_phrases_across_chunks_of_a_long_text(spark, monkeypatch):
    text = ("ab cd ef " * 5 + ". ") * 40 + "x" * 200 + " ab cd" * 12
    monkeypatch.setattr(phrases, "CHUNK_BYTES", 64)
    assert [w for part in phrases.tokens(text.encode()) for w in part] == text.replace(".", " . ").encode().split()
    rows = [(1, text, "en", "s")]
    got = phrases.collocations(spark.createDataFrame(rows, SCHEMA), block_tokens=50)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


def test_nothing_to_count(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert phrases.collocations(empty).collect() == []
    assert phrases.collocations(spark.createDataFrame([(1, None, None, None), (None, " ", "en", "")], SCHEMA)).collect() == []


def test_score_beyond_64_bits(spark):
    cases = [(3_000_000_019, 3_000_000_021, 9_000_000_003), (10**15, 10**15, 10**15 + 7), (10, 10, 10), (999_999_999_999, 10**12, 10**12)]
    frame = spark.createDataFrame(cases, "a bigint, l bigint, r bigint")
    got = [r[0] for r in frame.select(phrases.score(F.col("a"), F.col("l"), F.col("r"))).collect()]
    assert got == [1_000_000 * a * a // (left * right) for a, left, right in cases]
