"""The stages of the pipeline, followed by brute force on one small table."""

from __future__ import annotations

import base64
import hashlib
import os
import re

import corpus_pipeline as pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage returned, written and read again."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    results = [docs]
    for name, stage in pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name.replace(" ", "-"))
        stage(spark, results[-1], SF_DIR).write.parquet(path)
        results.append(spark.read.parquet(path))
    return results


def ids(frame):
    return sorted(r.doc_id for r in frame.select("doc_id").collect())


def test_columns_stay(stages):
    for frame in stages[1:5]:
        assert frame.dtypes == stages[0].dtypes


def test_clean_documents_stay(stages):
    lettered = {r.doc_id for r in stages[0].collect() if r.text and re.search(r"[^\W\d_]", r.text)}
    assert set(ids(stages[1])) == lettered


def test_text_without_a_language_goes(spark, stages):
    """The network rejects noise, keeps all clean texts, and takes nothing away where it has learned nothing."""
    random = np.random.default_rng(23)
    noise = [
        "x\n" + "\n".join(",".join(map(str, random.integers(0, 10**6, 8))) for _ in range(60)),
        base64.encodebytes(random.bytes(2000)).decode(),
        random.bytes(1500).hex(),
        "".join(map(chr, random.integers(33, 127, 2500))),
    ]
    rows = spark.createDataFrame([(10**9 + i, t, None, "n", len(t)) for i, t in enumerate(noise)], stages[0].schema)
    both = stages[0].unionByName(rows)
    assert ids(pipeline.identify_language(spark, both, SF_DIR)) == ids(stages[1])
    unlabelled = both.withColumn("lang", F.lit(None).cast("string"))
    lettered = sorted(r.doc_id for r in both.collect() if r.text and re.search(r"[^\W\d_]", r.text))
    assert ids(pipeline.identify_language(spark, unlabelled, SF_DIR)) == lettered


def test_exact_copies_go(stages):
    last = {}
    for r in stages[1].collect():
        key = re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")
        last[key] = max(last.get(key, -1), r.doc_id)
    assert ids(stages[2]) == sorted(last.values())


def test_near_copies_go(stages):
    from test_text_operators import brute_classes

    classes = brute_classes([(r.doc_id, r.text) for r in stages[2].collect()])
    assert ids(stages[3]) == sorted(set(classes.values()))


def test_secrets_go_and_the_rest_stays(stages):
    from test_text_operators import brute_secrets

    before = {r.doc_id: r for r in stages[3].collect()}
    after = {r.doc_id: r for r in stages[4].collect()}
    assert before.keys() == after.keys()
    for doc_id, r in after.items():
        assert brute_secrets(r.text) == ""
        if not brute_secrets(before[doc_id].text):
            assert r == before[doc_id]


def test_all_that_is_left_is_packed(stages):
    assert sorted({r.doc_id for r in stages[5].collect()}) == ids(stages[4])


def test_run_is_the_stages(spark, stages):
    def digest(frame):
        return sorted(hashlib.sha256(repr((r.doc_id, r.start, r.length, r.ids_crc32)).encode()).hexdigest() for r in frame.collect())

    assert digest(pipeline.run(spark, SF_DIR)) == digest(stages[5])


CLASHING = ("_digest", "_spans", "_kept_id", "_kept", "_turn", "__digest", "spans")


@pytest.mark.parametrize("name", [name for name, _ in pipeline.STAGES])
def test_odd_rows_and_clashing_columns(docs, name):
    """NULLs, empty and long texts, ties, repeated rows; then no rows at all."""
    frame = docs.select(*[c for c in docs.columns if c not in CLASHING], *[F.lit(c).alias(c) for c in CLASHING])
    stage = dict(pipeline.STAGES)[name]
    found = stage(docs.sparkSession, frame, SF_DIR)
    rows, empty = found.collect(), stage(docs.sparkSession, frame.limit(0), SF_DIR)
    assert empty.columns == found.columns and empty.collect() == []
    if name == "packing":
        assert {r.doc_id for r in rows} == {r.doc_id for r in docs.select("doc_id").collect()}
        return
    assert found.columns == frame.columns
    left = [r.doc_id for r in rows]
    given = [r.doc_id for r in frame.select("doc_id").collect()]
    if name == "secret scans":
        assert sorted(left, key=str) == sorted(given, key=str)
        (key,) = [r for r in rows if r.doc_id is None]
        assert key.text == "no id here, [SECRET]" and key.n_chars == len(key.text)
    elif name == "exact dedup":
        assert sorted(left, key=str) == sorted({*given} - {2, 5, 12}, key=str)
    elif name == "MinHash near-dedup":
        assert {5, 6, 7, None} <= set(left) and left.count(9) == 2 and len({2, 3, 4, 13} & set(left)) == 1
    else:
        assert {5, 6, 7} & set(left) == set() and left.count(9) == 2


def test_one_of_rows_that_share_id_and_text(spark):
    """The same one, in whatever order rows come."""
    rows = [(1, "Some text", "en", "a", 9), (1, "some text", "de", "b", 9), (1, "SOME text", None, "c", 9), (2, "other", "en", "a", 5)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    found = [sorted(map(str, pipeline.drop_exact_copies(spark, spark.createDataFrame(x, schema).repartition(n), "").collect())) for x, n in ((rows, 1), (rows[::-1], 4))]
    assert found[0] == found[1] and len(found[0]) == 2
