"""A training-data pipeline over ``documents``.

Each stage is one of the text operators, applied to all that its predecessor kept; its result is
written as Parquet and read again for the next. All stages but the last return the columns
of ``documents``, and further ones, whatever their names. Every stage gives an empty table for an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from depotlens.llm import exact_dedup, language_id, near_dedup, packing, secrets
from depotlens.plans.durable import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _unused(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose ``doc_id`` is in ``ids`` (unique, one column); NULL equals NULL."""
    kept = _unused(docs, "_kept_id")
    side = ids.select(F.col("doc_id").alias(kept))
    return docs.join(side, F.col("doc_id").eqNullSafe(F.col(kept)), "left_semi")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language: NULL texts, those without a letter, and those the reject class takes.

    That class is learned from text without a language, and its limit from labelled rows: a low score alone rejects
    nothing, since clean texts that are short or mix words of two languages have one too. Where nothing could be learned, texts
    with a letter stay. Rows that share an id (NULL is one too) stay if one of them is accepted; repeated rows stay repeated.
    """
    model = language_id.fit_with_reject(docs)
    if not model.languages:
        accepted = docs.filter(F.col("text").rlike(r"\p{L}"))
    else:
        accepted = language_id.predict(docs, model).filter(F.col("lang_pred") != language_id.UNKNOWN)
    return _only(docs, accepted.select("doc_id").distinct())


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id stays (a NULL id is the smallest; NULL counts as the empty text).

    Rows that share id and text are one document: of those that differ in other columns, the one with the smallest hash of
    the whole row stays, whatever the order of rows.
    """
    digest, kept_id, kept_digest, turn = (_unused(docs, name) for name in ("_digest", "_kept_id", "_kept", "_turn"))
    kept = exact_dedup.deduplicate(docs).filter("kept").select("doc_id", F.unhex("text_sha256").alias("digest"))
    side = kept.distinct().select(F.col("doc_id").alias(kept_id), F.col("digest").alias(kept_digest))
    own = docs.withColumn(digest, F.unhex(F.sha2(exact_dedup.normalised(F.coalesce("text", F.lit(""))), 256)))
    met = own.join(side, F.col("doc_id").eqNullSafe(F.col(kept_id)) & (F.col(digest) == F.col(kept_digest)), "left_semi")
    first = Window.partitionBy("doc_id", digest).orderBy(F.xxhash64(*docs.columns))
    return met.withColumn(turn, F.row_number().over(first)).filter(F.col(turn) == 1).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, that of the smallest id.

    Rows without words (NULL or empty texts) are alike to none and stay, as do rows with a NULL id. Rows that share the id
    that stays all stay.
    """
    return _only(docs, near_dedup.near_classes(docs).filter("kept").select("doc_id").distinct())


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark, and ``n_chars`` is that of the new text; rows without any stay as they are.

    Every row is kept: NULL and empty texts have no secrets, equal texts are changed alike.
    """
    digest, spans = _unused(docs, "_digest"), _unused(docs, "_spans")
    found = secrets.scan(docs).filter(F.size("spans") > 0).dropDuplicates(["digest"])
    places = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop")))
    side = materialize(found.select(F.col("digest").alias(digest), places.alias(spans)), "secret-spans")
    own = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    held = F.col(digest).isNotNull()
    text = F.when(held, secrets.redact(F.col("text"), F.col(spans))).otherwise(F.col("text"))
    length = F.when(held, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    met = docs.join(side, own == F.col(digest), "left")
    return met.withColumn("text", text).withColumn("n_chars", length).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens.

    A NULL or empty text has one token, its end. Rows that share an id, or are repeated, are packed each.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("secret scans", redact_secrets),
    ("packing", pack_sequences),
]

#: A trained model, hashed signatures and a tokenizer are beyond SQL; a test follows the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs, name.replace(" ", "-").lower())
    return docs
