"""Search by postings, distinct counts by bit maps."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from depotlens.functions.columns import contains_folded, like_ascii
from depotlens.plans import distinct, search_index
from depotlens.sources import files

NAMES = ["Thùng carton", "THÙNG nhựa", "Máy quét", "ΟΔΟΣ Αθηνών", "οδος", "İstanbul", "100% wool", "a_b", "ab", "", None, "Kệ thép KỆ", "carTON box", "xxx", "Straße"]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Rows written by id, and their postings."""
    folder = tmp_path_factory.mktemp("search")
    rng = random.Random(6)
    data = [(i, rng.choice(NAMES), rng.choice(NAMES)) for i in range(3000)]
    rows = spark.createDataFrame(data, "id bigint, name string, sku string")
    files.write_by_id(rows, str(folder / "rows"), partitions=4)
    search_index.build(rows, ["name", "sku"], str(folder / "postings"))
    return spark.read.parquet(str(folder / "rows")), search_index.read(spark, str(folder / "postings"))


KEYWORDS = ["CARTON", "thùng", "Thùng", "ΟΔΟΣ", "οδοσ", "istan", "İstan", "0% w", "ton%box", "a_b", "ab", "", "Kệ", "KỆ T", "nothing at all", "xxxx", "aße"]


@pytest.mark.parametrize("keyword", KEYWORDS)
@pytest.mark.parametrize("predicate", [like_ascii, contains_folded])
def test_same_rows_as_without_the_index(stored, keyword, predicate):
    rows, postings = stored
    held = predicate("name", keyword) | predicate("sku", keyword)
    want = sorted(r.id for r in rows.filter(held).collect())
    for listed in (search_index.LISTED, 5):
        found = search_index.candidates(rows, postings, keyword, listed=listed)
        assert sorted(r.id for r in found.filter(held).collect()) == want


def test_only_candidates_are_read(spark, tmp_path):
    """The ids reach the scan, and the postings are pruned by run."""
    rows = spark.range(0, 20_000).select("id", F.concat(F.lit("item "), F.col("id")).alias("name"))
    files.write_by_id(rows, str(tmp_path / "rows"), partitions=4)
    search_index.build(rows, ["name"], str(tmp_path / "postings"))
    stored, postings = spark.read.parquet(str(tmp_path / "rows")), search_index.read(spark, str(tmp_path / "postings"))
    found = search_index.candidates(stored, postings, "M 1234")
    assert sorted(r.id for r in found.collect()) == [1234, *range(12340, 12350)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(id, [" in plan and "12345" in plan
    look_up = postings.filter(F.col("gram").isin(search_index.runs_of("M 1234")))
    assert "PushedFilters: [In(gram, [" in look_up._jdf.queryExecution().executedPlan().toString()
    assert "".join(search_index.runs_of("M 1234")) == "".join(sorted(["m 1", " 12", "123", "234"]))


def test_distinct_counts_of_days_months_and_all(spark):
    rng = random.Random(9)
    data = [(rng.choice([None, rng.randint(0, 50), rng.randint(0, 200_000), 2**40 + rng.randint(0, 9)]), f"2024-0{rng.randint(1, 3)}-1{rng.randint(0, 3)}") for _ in range(4000)]
    data += [(7, "2024-03-10")] * 3000 + [(None, "2024-09-09")]
    rows = spark.createDataFrame(data, "productId bigint, day string").repartition(5)
    days = distinct.bit_maps(rows, "productId", {"day": F.col("day")})
    months = distinct.merged(days, {"month": F.substring("day", 1, 7)})

    def want(cut):
        seen = {}
        for product, day in data:
            if product is not None:
                seen.setdefault(day[:cut], set()).add(product)
        return {k: len(v) for k, v in seen.items()}

    assert {r.day: r.n for r in distinct.counts(days, ["day"], "n").collect()} == want(10)
    assert {r.month: r.n for r in distinct.counts(months, ["month"], "n").collect()} == want(7)
    assert distinct.counts(distinct.merged(days, {}), [], "n").first().n == len({p for p, _ in data if p is not None})


def test_keys_that_are_no_numbers(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 1), ("a", 1), (None, 1), ("ü", 2)], "code string, day int")
    ids = distinct.numbered(rows, "code")
    state = distinct.bit_maps(rows.join(ids, "code", "left"), "number", {"day": F.col("day")})
    assert {r.day: r.n for r in distinct.counts(state, ["day"], "n").collect()} == {1: 2, 2: 1}


def test_postings_are_dealt_by_rows_not_by_one_scan(spark, tmp_path, monkeypatch):
    """Runs of a table read by one task are taken in shares that grow in number with its rows, each run and id once."""
    monkeypatch.setattr(search_index, "ROWS_A_TASK", 2)
    rows = spark.createDataFrame([(i % 9, f"name {i}") for i in range(10)], "id bigint, name string").coalesce(1)
    search_index.build(rows, ["name"], str(tmp_path / "postings"))
    written = search_index.read(spark, str(tmp_path / "postings"))
    want = {(text[j : j + 3], i % 9) for i, text in ((i, f"name {i}") for i in range(10)) for j in range(len(text) - 2)}
    assert {(r["gram"], r["id"]) for r in written.collect()} == want
    assert written.count() == len(want)
    assert len(list((tmp_path / "postings").glob("*.parquet"))) == 5
