"""The text operators as queries over the table ``documents``, with DuckDB SQL where it can tell the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depotlens.llm import (
    exact_dedup, fingerprints, language_id, licenses, merkle, near_dedup, packing, phrases, pii, secrets, sentencepiece_codec,
    simhash, substring_dedup,
)

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.remove_repeated(documents(spark, folder), with_text=False).drop("kept_text", "intervals")


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(documents(spark, folder), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False).drop("ids")


def op3_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    spans = F.col("spans")
    base = secrets.of_base(spans)

    def count(kind: str):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return secrets.scan(documents(spark, folder)).select(
        "doc_id",
        *[count(rule.kind) for rule in secrets.BASE_RULES],
        F.sha2(secrets.joined(base), 256).alias("base_sha256"),
        secrets.joined(spans).alias("spans"),
    )


def op4_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    found = pii.find(docs, pii.fit(docs))
    base = F.filter("spans", lambda s: s["base"])

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")

    def count(kind: str):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op5_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    return sentencepiece_codec.encode_and_decode(documents(spark, folder), path, with_values=False).drop("ids", "decoded")


def op6_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Every source is a repository; ids give two levels of directories, each tenth file is a licence file.

    A document without an id stands in the root of its repository, under the digest of its text.
    """
    return licences_of(documents(spark, folder))


def licences_of(docs: DataFrame) -> DataFrame:
    hundred = F.floor(F.col("doc_id") / 1000).cast("string")
    ten = F.floor(F.pmod("doc_id", F.lit(1000)) / 50).cast("string")
    is_file = F.coalesce(F.col("doc_id") % 10 == 0, F.lit(False))
    own = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))
    name = F.concat(F.when(is_file, "LICENSE.").otherwise("page."), own)
    files = docs.select(F.concat_ws("/", "source", hundred, ten, name).alias("path"), "text", is_file.alias("is_licence_file"), "doc_id")
    return licenses.licences(files, keep=("doc_id",))


def op7_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_classes(documents(spark, folder))


def op8_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.deduplicate(documents(spark, folder))


def op9_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprint_edits(documents(spark, folder))


def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    predicted = language_id.predict(docs, language_id.fit(docs))
    return predicted.withColumn("held_out", language_id.held_out())


def op11_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(documents(spark, folder))


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.verified_manifest(documents(spark, folder)).drop("position")


def op13_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_copies(documents(spark, folder))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


def queries() -> dict[str, Query]:
    named = (
        op1_substring_dedup, op2_packing, op3_secret_scan, op4_pii, op5_sentencepiece, op6_license_scan,
        op7_near_dedup, op8_exact_dedup, op9_fingerprints, op10_language_id, op11_phrases, op12_merkle_manifest, op13_simhash, pipeline,
    )
    return {f.__name__: f for f in named}


OP1_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), starts AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS words
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words WHERE len(w) >= 13)
), first AS (
  SELECT words, min(doc_id) AS first_id FROM starts GROUP BY words HAVING min(doc_id) < max(doc_id)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM starts JOIN first USING (words) WHERE doc_id > first_id
), cut AS (
  SELECT doc_id, list(i) AS out FROM gone GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(out), 0)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(list_filter(w, lambda x, i: out IS NULL OR NOT list_contains(out, i)), ' '), '')) AS kept_sha256
FROM words LEFT JOIN cut USING (doc_id)
"""

OP8_SQL = """
WITH normal AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents
), groups AS (
  SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM normal GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM normal JOIN groups USING (text_sha256)
"""


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), words AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), totals AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang
), grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(list_slice(w, i, i + k - 1), ' '))) AS phrase
  FROM words, (VALUES (1), (2), (3)) lengths(k) WHERE len(w) >= k
), counts AS (
  SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL
), candidates AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE k > 1 AND f >= 10
), cuts AS (
  SELECT c.*, cut, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates) c
  JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(list_slice(w, 1, cut), ' ')
  JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(list_slice(w, cut + 1, c.k), ' ')
), scored AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), inside AS (
  SELECT lang, unnest([array_to_string(list_slice(w, 1, 2), ' '), array_to_string(list_slice(w, 2, 3), ' ')]) AS phrase, a AS longer
  FROM candidates WHERE k = 3
), kept AS (
  SELECT * FROM scored s WHERE NOT EXISTS (
    SELECT 1 FROM inside i WHERE s.k = 2 AND i.lang = s.lang AND i.phrase = s.phrase AND 100 * i.longer >= 50 * s.a)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


def _leaf_sql(text: str) -> str:
    columns = ("doc_id", "source", "lang", "n_chars", text)
    parts = [f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')" for c in columns]
    return f"sha256({' || '.join(parts)})"


#: CRC-32 (reflected, polynomial 0xEDB88320) of the decimal digits of the id: each byte is mixed in, then eight bits are shifted out.
_CRC32_SQL = """
xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
  lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END), 4294967295)
"""


def _tree_sql(name: str, leaves: str) -> str:
    """Levels of the trees over ``leaves`` (tree, i, h, n)."""
    return f"""
{name} AS (
  SELECT 0::BIGINT AS level, tree, i, h, n FROM ({leaves})
  UNION ALL
  SELECT level + 1, tree, i // 16, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 15) // 16) FROM {name} WHERE n > 1 GROUP BY level, tree, i // 16
)"""


def _fold_sql(name: str, tree: str, start: str) -> str:
    """Level by level, the node that ``start`` (id, tree, i, h) leads to, and the siblings met."""
    return f"""
{name} AS (
  SELECT 0::BIGINT AS level, id, tree, i, h, '' AS met FROM ({start})
  UNION ALL
  SELECT f.level + 1, f.id, f.tree, f.i // 16, sha256(string_agg(CASE WHEN t.i = f.i THEN f.h ELSE t.h END, '' ORDER BY t.i)),
    any_value(f.met) || coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (WHERE t.i <> f.i), '')
  FROM {name} f JOIN {tree} t ON t.tree IS NOT DISTINCT FROM f.tree AND t.level = f.level AND t.n > 1 AND t.i // 16 = f.i // 16
  GROUP BY f.level, f.id, f.tree, f.i
), {name}_end AS (
  SELECT * FROM {name} QUALIFY row_number() OVER (PARTITION BY id ORDER BY level DESC) = 1
)"""


OP12_SQL = f"""
WITH RECURSIVE rows AS (
  SELECT *, CASE WHEN {_CRC32_SQL} % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS said
  FROM documents
), leaves AS (
  SELECT doc_id, source, {_leaf_sql("text")} AS leaf, {_leaf_sql("said")} AS claimed FROM rows
), placed AS (
  SELECT *, row_number() OVER () AS id, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
    count(*) OVER (PARTITION BY source) AS n FROM leaves
), {_tree_sql("trees", "SELECT source AS tree, i, leaf AS h, n FROM placed")},
subroots AS (
  SELECT tree AS source, h AS subroot, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM trees WHERE n = 1
), {_tree_sql("top", "SELECT 0 AS tree, i, subroot AS h, n FROM subroots")},
{_fold_sql("inner_path", "trees", "SELECT id, source AS tree, i, claimed AS h FROM placed")},
{_fold_sql("outer_path", "top", "SELECT e.id, 0 AS tree, s.i, e.h FROM inner_path_end e JOIN subroots s ON s.source IS NOT DISTINCT FROM e.tree")}
SELECT doc_id, leaf, subroot, t.h AS root, sha256(a.met || b.met) AS proof_sha256, b.h AS folded_root, b.h = t.h AS verified
FROM placed p JOIN subroots s ON s.source IS NOT DISTINCT FROM p.source
JOIN inner_path_end a ON a.id = p.id JOIN outer_path_end b ON b.id = p.id JOIN top t ON t.n = 1
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": OP1_SQL, "op8_exact_dedup": OP8_SQL, "op11_phrases": OP11_SQL, "op12_merkle_manifest": OP12_SQL,
    }
