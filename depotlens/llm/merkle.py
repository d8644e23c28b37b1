"""A Merkle manifest of a table, written as a postorder append log.

Leaves of a tree are numbered in their order, ``ARITY`` neighbours have one parent. An aligned builder takes the
leaves of one segment (``ARITY ** HEIGHT`` of them, starting at a multiple of that) and appends nodes in
the order in which they are complete: a leaf, then every ancestor that this leaf completes. The nodes of a segment are
therefore one run of the log. The tops of the segments are the leaves of the next round, until a tree has one segment.

Nobody keeps an index of the log. The position of a node follows from the sizes of the subtrees before
it: when leaf e (counted from 1) arrives, e - 1 leaves, (e - 1) // 16 nodes of the first level, (e - 1) // 256
of the second and so on are there; the last, incomplete nodes of a tree come at its end. Proofs read siblings at
such positions, segment by segment from the top of the tree down: the path of a segment's top is handed to the segment, which puts
the path within it in front.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depotlens.llm.exact_dedup import normalised
from depotlens.llm.workers import reachable
from depotlens.plans.durable import materialize

ARITY = 16
#: Levels of a segment: 16 ** 3 = 4096 leaves.
HEIGHT = 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
SEGMENT = ARITY**HEIGHT
DIGEST = 32
PATH = "array<struct<place:int,others:binary>>"


def _field(column: str, value: Column | None = None) -> Column:
    text = (F.col(column) if value is None else value).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column | None = None) -> Column:
    """SHA-256 of the row's columns, each led by its size in bytes, ``-`` for NULL; ``text`` instead of the row's."""
    fields = [_field(c, text if c == "text" else None) for c in COLUMNS]
    return F.unhex(F.sha2(F.concat(*fields), 256))


def parent(digests: list[bytes]) -> bytes:
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def heights(leaves: int, height: int, single: bool) -> int:
    """Levels above the leaves of a segment: up to its one top, or ``height`` if other segments stand beside it."""
    if not single:
        return height
    level = 0
    while leaves > 1:
        leaves, level = -(-leaves // ARITY), level + 1
    return level


def position(leaves: int, levels: int, level: int, number: int) -> int:
    """Place in the log of node ``number`` of ``level`` in a tree of ``leaves`` leaves and ``levels`` levels above them."""
    end = (number + 1) * ARITY**level
    if end <= leaves:
        return sum((end - 1) // ARITY**m for m in range(levels + 1)) + level
    complete = sum(leaves // ARITY**m for m in range(levels + 1))
    return complete + sum(1 for m in range(level) if leaves % ARITY**m)


def append_log(leaves: list[bytes], levels: int) -> list[bytes]:
    """Nodes in completion order. Open nodes are runs of children, one for each level."""
    log: list[bytes] = []
    runs: list[list[bytes]] = [[] for _ in range(levels + 1)]

    def add(node: bytes, level: int) -> None:
        log.append(node)
        runs[level].append(node)
        if level < levels and len(runs[level]) == ARITY:
            full, runs[level] = runs[level], []
            add(parent(full), level + 1)

    for node in leaves:
        add(node, 0)
    for level in range(levels):
        if runs[level]:
            rest, runs[level] = runs[level], []
            add(parent(rest), level + 1)
    return log


def _builder(height: int):
    def build(key: tuple, table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("number").to_numpy(), kind="stable")
        digests = table.column("digest").take(pa.array(order)).to_pylist()
        single = table.column("total")[0].as_py() <= ARITY**height
        levels = heights(len(digests), height, single)
        log = append_log(digests, levels)
        return pa.table(
            {
                "tree": table.column("tree").slice(0, 1), "segment": table.column("segment").slice(0, 1), "leaves": pa.array([len(digests)], pa.int32()),
                "levels": pa.array([levels], pa.int32()), "log": pa.array([b"".join(log)], pa.binary()), "top": pa.array([log[-1]], pa.binary()),
                "total": table.column("total").slice(0, 1),
            }
        )

    return build


SEGMENTS = "tree bigint, segment bigint, leaves int, levels int, log binary, top binary, total bigint"


def build(leaves: DataFrame, height: int = HEIGHT) -> list[DataFrame]:
    """Rounds of segments of all trees; ``leaves`` has ``tree``, ``number`` (from 0, gapless), ``digest`` and ``total`` of its tree.

    One round for each ``height`` levels of the tallest tree.
    """
    size = ARITY**height
    rounds: list[DataFrame] = []
    while True:
        dealt = leaves.select("tree", F.floor(F.col("number") / size).alias("segment"), "number", "digest", "total")
        rounds.append(materialize(dealt.groupBy("tree", "segment").applyInArrow(_builder(height), SEGMENTS), "merkle-log"))
        leaves = rounds[-1].filter(F.col("total") > size).select(
            "tree", F.col("segment").alias("number"), F.col("top").alias("digest"), F.ceil(F.col("total") / size).alias("total")
        )
        if leaves.isEmpty():
            return rounds


def roots(rounds: list[DataFrame], height: int = HEIGHT) -> DataFrame:
    """``tree`` and its ``root``."""
    found = [r.filter(F.col("total") <= ARITY**height).select("tree", F.col("top").alias("root")) for r in rounds]
    out = found[0]
    for frame in found[1:]:
        out = out.unionByName(frame)
    return out


def _path(log: bytes, leaves: int, levels: int, number: int) -> list[dict]:
    """From a leaf of a segment to its top: the place in each run and the run's other nodes, left to right."""
    path = []
    for level in range(levels):
        first = number // ARITY * ARITY
        nodes = -(-leaves // ARITY**level)
        run = range(first, min(first + ARITY, nodes))
        at = (position(leaves, levels, level, i) * DIGEST for i in run if i != number)
        path.append({"place": number - first, "others": b"".join(log[a : a + DIGEST] for a in at)})
        number //= ARITY
    return path


class _Paths:
    """Paths of the leaves of one segment; those of neighbours share what lies above their parent."""

    def __init__(self, segment: dict, above: list[dict]) -> None:
        self.log, self.leaves, self.levels, self.above = segment["log"], segment["leaves"], segment["levels"], above
        self.known: dict[int, list[dict]] = {}

    def of(self, number: int) -> list[dict]:
        if not self.levels:
            return self.above
        group = number // ARITY
        if group not in self.known:
            self.known = {group: _path(self.log, self.leaves, self.levels, number)[1:] + self.above}
        first = group * ARITY
        run = range(first, min(first + ARITY, self.leaves))
        at = (position(self.leaves, self.levels, 0, i) * DIGEST for i in run if i != number)
        return [{"place": number - first, "others": b"".join(self.log[a : a + DIGEST] for a in at)}, *self.known[group]]


def fold(digest: bytes, path: list[dict]) -> bytes:
    """The root that a leaf and its path lead to."""
    own = digest.hex()
    for step in path:
        others, at = step["others"].hex(), step["place"] * 2 * DIGEST
        own = hashlib.sha256((others[:at] + own + others[at:]).encode()).hexdigest()
    return bytes.fromhex(own)


def _descend(height: int):
    def descend(key: tuple, segments: pa.Table, above: pa.Table) -> pa.Table:
        segment = segments.to_pylist()[0]
        own = _Paths(segment, above.column("path")[0].as_py())
        numbers = range(segment["leaves"])
        kind = pa.list_(pa.struct([("place", pa.int32()), ("others", pa.binary())]))
        return pa.table(
            {
                "tree": pa.array([segment["tree"]] * len(numbers), pa.int64()),
                "number": pa.array([segment["segment"] * ARITY**height + i for i in numbers], pa.int64()),
                "path": pa.array([own.of(i) for i in numbers], kind),
            }
        )

    return descend


def _below(segments: DataFrame, above: DataFrame, height: int) -> DataFrame:
    """Paths of all leaves of ``segments`` from the paths of their tops (``tree``, ``segment``, ``path``)."""
    both = segments.groupBy("tree", "segment").cogroup(above.groupBy("tree", "segment"))
    return both.applyInArrow(_descend(height), f"tree bigint, number bigint, path {PATH}")


def paths_of_tops(rounds: list[DataFrame], above: DataFrame, height: int = HEIGHT) -> DataFrame:
    """(``tree``, ``segment``, ``path``) for the segments of the first round; ``above`` (``tree``, ``path``) goes on from the roots of the trees."""
    beyond = above.select(F.col("tree").alias("_tree"), "path")
    found = None
    for segments in reversed(rounds):
        whole = segments.filter(F.col("total") <= ARITY**height).select("tree", "segment")
        tops = whole.join(beyond, F.col("tree") == F.col("_tree")).select("tree", "segment", "path")
        found = materialize(tops if found is None else tops.unionByName(found), "merkle-paths")
        if segments is not rounds[0]:
            found = _below(segments, found, height).withColumnRenamed("number", "segment")
    return found


def paths(rounds: list[DataFrame], above: DataFrame, height: int = HEIGHT) -> DataFrame:
    """(``tree``, ``number``, ``path``) for all leaves."""
    return _below(rounds[0], paths_of_tops(rounds, above, height), height)


def numbered(rows: DataFrame, tree: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``number``, the place in ``order`` among the rows of its tree, from 0, and ``total``.

    Ranges over tree and order cut the table into tasks, each task numbers its own rows, and only counts by task and tree
    meet to tell where a task begins: a tree with a third of all rows is spread over many. Trees may be NULL.
    """
    placed = rows.repartitionByRange(*tree, *order).withColumn("_part", F.spark_partition_id())
    placed = materialize(placed, "merkle-leaves")
    own = F.row_number().over(Window.partitionBy("_part", *tree).orderBy(*order)) - 1
    counts = placed.groupBy("_part", *tree).agg(F.count("*").alias("_rows"))
    all_of = Window.partitionBy(*tree)
    before = F.coalesce(F.sum("_rows").over(all_of.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(
        F.col("_part").alias("_at"), *[F.col(c).alias(f"_tree_{c}") for c in tree], before.alias("_before"), F.sum("_rows").over(all_of).alias("total")
    )
    met = F.col("_part") == F.col("_at")
    for column in tree:
        met &= F.col(column).eqNullSafe(F.col(f"_tree_{column}"))
    joined = placed.withColumn("_own", own).join(starts, met)
    return joined.select(*rows.columns, (F.col("_before") + F.col("_own")).cast("bigint").alias("number"), F.col("total").cast("bigint").alias("total"))


@dataclass
class Manifest:
    """The logs of all sources and of the tree over them."""

    #: ``doc_id``, ``source``, ``digest``, ``claimed``, ``tree``, ``number``, ``total``: a row for each row of the table.
    leaves: DataFrame
    #: ``source``, ``tree``, ``subroot``.
    sources: DataFrame
    rounds: list[DataFrame]
    top_rounds: list[DataFrame]
    #: Of the whole table; None if it is empty.
    root: bytes | None
    height: int


def manifest(docs: DataFrame, claimed: Column | None = None, height: int = HEIGHT) -> Manifest:
    """Logs of a table with the columns ``doc_id``, ``source``, ``lang``, ``n_chars`` and ``text``; others are ignored.

    Each row is a leaf. A tree for each ``source`` (NULL is one too), by ``doc_id`` (NULL first; ties by digest, so
    that rows repeated as a whole are interchangeable); a tree over the sources by name, NULL first. ``claimed`` is the digest that a row is said to
    have, its own by default. Each row's text is read once, and only digests are shuffled.
    """
    reachable(docs.sparkSession)
    own = leaf()
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), own.alias("digest"),
        (own if claimed is None else claimed).alias("claimed"),
    )
    rows = materialize(rows, "merkle-rows")
    names = numbered(rows.select("source").distinct(), [], ["source"])
    names = materialize(names.select(F.col("source").alias("_source"), F.col("number").alias("tree"), F.col("total").alias("_sources")), "merkle-sources")
    placed = numbered(rows, ["source"], ["doc_id", "digest"])
    leaves = placed.join(names.select("_source", "tree"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    leaves = materialize(leaves, "merkle-numbered")
    rounds = build(leaves, height)
    subroots = roots(rounds, height).select(F.col("tree").alias("_tree"), F.col("root").alias("subroot"))
    sources = names.join(subroots, F.col("tree") == F.col("_tree")).select(F.col("_source").alias("source"), "tree", "subroot", "_sources")
    sources = materialize(sources, "merkle-subroots")
    over = sources.select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("number"), F.col("subroot").alias("digest"), F.col("_sources").alias("total"))
    top_rounds = build(over, height)
    root = roots(top_rounds, height).first()
    return Manifest(leaves, sources.drop("_sources"), rounds, top_rounds, bytes(root["root"]) if root else None, height)


PROOFS = "doc_id bigint, source string, tree bigint, number bigint, digest binary, subroot binary, proof_sha256 string, folded binary, path " + PATH


def _prover(height: int, with_path: bool):
    kind = pa.list_(pa.struct([("place", pa.int32()), ("others", pa.binary())]))

    def prove(key: tuple, leaves: pa.Table, segments: pa.Table) -> pa.Table:
        segment = segments.to_pylist()[0]
        leaves = leaves.sort_by("number")
        own = _Paths(segment, segment["path"])
        first = segment["segment"] * ARITY**height
        found = [own.of(n - first) for n in leaves.column("number").to_pylist()]
        proof = [hashlib.sha256(b"".join(step["others"] for step in path).hex().encode()).hexdigest() for path in found]
        folded = [fold(c, path) for c, path in zip(leaves.column("claimed").to_pylist(), found)]
        return pa.table(
            {
                **{c: leaves.column(c) for c in ("doc_id", "source", "tree", "number", "digest")},
                "subroot": pa.array([segment["subroot"]] * len(found), pa.binary()),
                "proof_sha256": pa.array(proof, pa.string()),
                "folded": pa.array(folded, pa.binary()),
                "path": pa.array(found if with_path else [None] * len(found), kind),
            }
        )

    return prove


def log_position(number: Column) -> Column:
    """Place of a leaf in the log of its tree."""
    levels = range(0, 64, ARITY.bit_length() - 1)
    return sum((F.shiftright(number, n) for n in levels[1:]), number)


def proofs(made: Manifest, with_path: bool = False) -> DataFrame:
    """A row for each leaf: ``doc_id``, ``source``, ``tree``, ``number``, ``digest``, ``subroot``, ``proof_sha256`` (of the siblings,
    as hex text), ``folded`` (the root that ``claimed`` and the siblings lead to) and ``path`` (only ``with_path``)."""
    spark = made.leaves.sparkSession
    nothing_above = spark.createDataFrame([(0, [])], f"tree bigint, path {PATH}")
    of_sources = paths(made.top_rounds, nothing_above, made.height).select(F.col("number").alias("tree"), "path")
    tops = paths_of_tops(made.rounds, materialize(of_sources, "merkle-paths"), made.height)
    tops = tops.select(F.col("tree").alias("_tree"), F.col("segment").alias("_segment"), "path")
    named = made.sources.select(F.col("tree").alias("_tree"), "subroot")
    segments = (
        made.rounds[0]
        .join(tops, (F.col("tree") == F.col("_tree")) & (F.col("segment") == F.col("_segment"))).drop("_tree", "_segment")
        .join(named, F.col("tree") == F.col("_tree")).drop("_tree")
    )
    at = F.floor(F.col("number") / ARITY**made.height).alias("segment")
    dealt = made.leaves.select("*", at)
    both = dealt.groupBy("tree", "segment").cogroup(segments.groupBy("tree", "segment"))
    return both.applyInArrow(_prover(made.height, with_path), PROOFS)


def tampered() -> Column:
    """The text with A-Z in lower case where 5 divides the CRC-32 of the id in decimals, else the text."""
    number = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return F.when(number % 5 == 0, normalised(F.col("text"))).otherwise(F.col("text"))


def verified_manifest(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """``doc_id``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root`` and ``verified`` of every row of ``docs``; also ``position``, the leaf's place in its source's log.

    The manifest is that of the rows as they are. Every row is then proved against it; where 5 divides the CRC-32 of
    its id, with A-Z of its text in lower case, which fails unless there are none. A NULL id or text is not changed.
    An empty table gives no rows.
    """
    made = manifest(docs, leaf(tampered()), height)

    def hexed(name: str) -> Column:
        return F.lower(F.hex(name))

    root = F.lit(made.root.hex() if made.root else None).cast("string")
    return proofs(made).select(
        "doc_id", hexed("digest").alias("leaf"), hexed("subroot").alias("subroot"), root.alias("root"), "proof_sha256",
        hexed("folded").alias("folded_root"), (hexed("folded") == root).alias("verified"), log_position(F.col("number")).alias("position"),
    )
