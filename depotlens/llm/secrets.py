"""Secrets in every version of every document, through an incremental ledger of blobs.

A version (path and text) is content-addressed by its SHA-256. The ledger holds, per blob,
the rules already run on it and the spans they found. Only blobs for which some rule version
is missing are read and scanned, and only by the missing rules; the findings are appended and
joined back to all paths that carry the blob. Built from DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depotlens.llm.workers import text_or_empty
from depotlens.plans.durable import new_path


@dataclass(frozen=True)
class Rule:
    """``pattern`` matches leftmost without overlap; a match counts if ``value`` of it is ``at_least`` characters long."""

    kind: str
    pattern: str
    at_least: int
    group: int = 0
    version: int = 1
    #: A text without any of these (in lower case) cannot match.
    hints: tuple[str, ...] = ()

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The base rules, then the rules added to them.
BASE_RULES = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        8,
        group=2,
        hints=("passw", "secret", "token", "key"),
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 16, hints=("akia",)),
    Rule("hex", r"[0-9a-f]{32,}", 32),
)
# A key runs to its END line. If that is missing (another BEGIN or the end of the text comes first), it takes the
# headers and base64 lines that follow, broken by line ends, real or escaped; possessive, so that Java needs no deep stack.
PEM_BREAK = r"(?:\s|\\[nrt]|[>#*|\"'+,])"
PEM_CLOSED = r"(?:(?!-----BEGIN )[\s\S])*?-----END \1PRIVATE KEY-----"
PEM_OPEN = (
    rf"(?:{PEM_BREAK}*+(?:Proc-Type|DEK-Info|Comment)[^\n\\]*+)*+"
    rf"(?:{PEM_BREAK}*+[A-Za-z0-9+/]{{20,}}+={{0,2}}+)*+"
    r"(?:(?<=[A-Za-z0-9+/]{20})(?:\r?\n|(?:\\r)?\\n)[\x20\t]*+[A-Za-z0-9+/]++={0,2}+(?=\s*(?:\n|\\[nr]|[\"']|$)))?+"
)
ADDED_RULES = (
    Rule("pem", rf"-----BEGIN ([A-Z ]*)PRIVATE KEY-----(?:{PEM_CLOSED}|{PEM_OPEN})", 1, version=2, hints=("private key",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 1, hints=("eyj",)),
)
RULES = BASE_RULES + ADDED_RULES

LEDGER = "digest binary, rules array<string>, spans array<struct<start:bigint,rank:int,kind:string,stop:bigint>>"
SPANS = "array<struct<start:bigint,rank:int,kind:string,stop:bigint>>"


#: Matches or spans that are folded together.
RUN = 128


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def _runs(items: Column) -> Column:
    """An array cut into runs of ``RUN``.

    A fold that builds an array copies it in each step, and one that cuts a text walks through it. Folding short runs, and
    one value of each run, keeps the work of long texts in proportion to them.
    """
    starts = F.when(F.size(items) > 0, F.sequence(F.lit(1), F.size(items), F.lit(RUN)))
    return F.transform(F.coalesce(starts, F.array().cast("array<int>")), lambda at: F.slice(items, at, RUN))


def _before(runs: Column, step: Callable[[Column, Column], Column]) -> Column:
    """For each run, the fold of all items before it, from 0 on."""
    state = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("all"))

    def next_run(acc: Column, run: Column) -> Column:
        return F.struct(F.aggregate(run, acc["at"], step).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all"))

    return F.aggregate(runs, state, next_run, lambda acc: acc["all"])


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of a rule in code points, end exclusive.

    Between n matches lie n + 1 pieces; running sums of their lengths give the places.
    """
    pattern = F.lit(rule.pattern)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    pieces = F.split(text, rule.pattern, -1)

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["piece"])
        stop = start + F.length(pair["match"])
        value = F.regexp_extract(pair["match"], rule.pattern, rule.group) if rule.group else pair["match"]
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), stop.alias("stop"))
        found = F.when(F.length(value) >= rule.at_least, F.concat(acc["found"], F.array(span))).otherwise(acc["found"])
        return F.struct(stop.alias("at"), found.alias("found"))

    def of_run(run: Column, before: Column) -> Column:
        state = F.struct(before.alias("at"), F.array().cast(SPANS).alias("found"))
        return F.aggregate(run, state, step, lambda acc: acc["found"])

    def of_runs(runs: Column) -> Column:
        passed = _before(runs, lambda at, pair: at + F.length(pair["piece"]) + F.length(pair["match"]))
        return F.flatten(F.zip_with(runs, passed, of_run))

    both = F.struct(pieces.alias("pieces"), matches.alias("matches"))
    pairs = _once(both, lambda b: F.arrays_zip(F.slice(b["pieces"], F.lit(1), F.size(b["matches"])).alias("piece"), b["matches"].alias("match")))
    found = _once(pairs, lambda p: _once(_runs(p), of_runs))
    return F.when(text.rlike(rule.pattern), found).otherwise(F.array().cast(SPANS))


def _scan(blobs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``digest``, ``text`` and ``done`` (rules already run) to new ledger rows."""
    text, folded = F.col("text"), F.col("_folded")
    empty = F.array().cast(SPANS)
    found = []
    for rank, rule in enumerate(rules):
        due = ~F.array_contains("done", rule.key)
        for_hint = F.lit(not rule.hints)
        for hint in rule.hints:
            for_hint = for_hint | F.contains(folded, F.lit(hint))
        found.append(F.when(due & for_hint, _spans(text, rule, rank)).otherwise(empty))
    keys = F.array(*[F.lit(r.key) for r in rules])
    return blobs.withColumn("_folded", F.lower("text")).select(
        "digest",
        F.array_except(keys, F.col("done")).alias("rules"),
        F.concat(*found).alias("spans"),
    )


def _without_repeats(spans: Column) -> Column:
    """Sorted spans, each once."""
    return F.filter(spans, lambda s, i: ~s.eqNullSafe(F.get(spans, i - 1)))


class BlobLedger:
    """Parquet files of (digest, rules, spans) in ``path``, only ever appended to."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        spark.createDataFrame([], LEDGER).write.mode("append").parquet(path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(LEDGER).parquet(self.path)

    def by_blob(self, rules: Sequence[Rule] = ()) -> DataFrame:
        """One row per blob, with the spans of ``rules``; there are as many parts as passes that met new rules."""
        # A pass tells which version of a rule its spans are of.
        wanted = [F.when(F.array_contains("rules", r.key), F.lit(r.kind)) for r in rules]
        kinds = F.array_compact(F.array(*wanted)) if wanted else F.array().cast("array<string>")
        spans = F.filter("spans", lambda s: F.array_contains(kinds, s["kind"]))
        return self.read().groupBy("digest").agg(
            F.flatten(F.collect_list("rules")).alias("done"),
            _once(F.sort_array(F.flatten(F.collect_list(spans))), _without_repeats).alias("spans"),
        )


def scan(docs: DataFrame, ledger: BlobLedger | None = None, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``doc_id`` (as path), ``digest`` and sorted ``spans`` of every row of ``docs``.

    Spans are (start, rank, kind, stop): code points, end exclusive, by start, then in the
    order of ``rules``. A NULL text is empty and has none. Repeated rows are one blob and all get
    its spans; NULL ids are paths like any other. Other columns are ignored; an empty table gives an empty
    result. Without ``ledger`` a new one is made in the shared folder. A rule of which the
    ledger has another version is run again under its new key; findings of rules and versions not asked for are left out.
    """
    spark = docs.sparkSession
    ledger = ledger or BlobLedger(spark, new_path(spark, "blob-ledger"))
    versions = docs.select(
        F.col("doc_id").alias("path"), text_or_empty().alias("text")
    ).withColumn("digest", F.unhex(F.sha2("text", 256)))
    known = ledger.by_blob().select(F.col("digest").alias("_seen"), "done")
    # One carrier stands for all paths of a blob, so that every blob is scanned once.
    carriers = versions.groupBy("digest").agg(F.min("path").alias("carrier"))
    keys = F.array(*[F.lit(r.key) for r in rules])
    done = F.coalesce("done", F.array().cast("array<string>"))
    unseen = (
        carriers.join(known, F.col("digest") == F.col("_seen"), "left")
        .select(F.col("digest").alias("_digest"), "carrier", done.alias("done"))
        .filter(F.size(F.array_except(keys, F.col("done"))) > 0)
    )
    blobs = versions.join(unseen, (F.col("digest") == F.col("_digest")) & F.col("path").eqNullSafe(F.col("carrier")))
    # Rows repeated as a whole share the carrier's id.
    _scan(blobs, rules).dropDuplicates(["digest"]).write.mode("append").parquet(ledger.path)
    found = ledger.by_blob(rules).select(F.col("digest").alias("_digest"), "spans")
    # Both sides are exchanged by digest, so that Spark can split the paths of a hot blob.
    return versions.select(F.col("path").alias("doc_id"), "digest").join(
        found, F.col("digest") == F.col("_digest")
    ).drop("_digest")


def joined(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def of_base(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["rank"] < len(BASE_RULES))


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span replaced by ``mark``; overlapping spans are one. ``spans`` are sorted by start.

    Each run of spans meets only the part of the text that it stands in.
    """

    def of_run(run: Column, before: Column) -> Column:
        state = F.struct(before.alias("at"), F.lit("").alias("text"))

        def of_part(part: Column) -> Column:
            def step(acc: Column, s: Column) -> Column:
                kept = F.substring(part, acc["at"] - before + 1, s["start"] - acc["at"])
                between = F.when(s["start"] >= acc["at"], F.concat(kept, F.lit(mark)))
                return F.struct(
                    F.greatest(acc["at"], s["stop"]).alias("at"),
                    F.concat(acc["text"], F.coalesce(between, F.lit(""))).alias("text"),
                )

            return F.aggregate(run, state, step, lambda acc: acc["text"])

        # A span that begins before the run's text lies in one that was met before.
        return _once(F.substring(text, before + 1, F.greatest(F.element_at(run, -1)["start"] - before, F.lit(0))), of_part)

    def of_runs(runs: Column) -> Column:
        return F.array_join(F.zip_with(runs, _before(runs, lambda at, s: F.greatest(at, s["stop"])), of_run), "")

    end = F.coalesce(F.array_max(F.transform(spans, lambda s: s["stop"])), F.lit(0).cast("bigint"))
    rest = F.length(text).cast("bigint")
    return F.concat(_once(_runs(spans), of_runs), F.substring(text, end + 1, rest))
