"""Near-duplicate classes by DartMinHash signatures and banding.

The elements of a text are its distinct shingles of five words, each of weight 1, since links are
verified on sets: a text and the same text doubled are alike. Each element owns a board of hashed darts: points of a Poisson process of unit rate over (weight,
rank), the same for every text. A text keeps the darts inside its elements' weights and below a
rank that lets it expect about k ln k + 2 k darts; every dart hits one of k coordinates, and the
lowest rank per coordinate is the signature. Coordinates left empty get a higher rank. Two
signatures agree in a coordinate with the probability of the Jaccard similarity of the sets (of the weights, if they differ).

Texts whose signatures agree in a band share a bucket. First one pivot of each bucket meets all
its members, every pair is verified on the shingles themselves, and the classes of these links are
formed: n copies cost n pairs and not n * n / 2, and most buckets are of one class then. The
members of any other bucket are dealt to blocks of bounded size; a task compares two blocks by a product
of their shingle matrices and tells only links that join classes. So no pair of a bucket is emitted
as a row, and every link between two classes that banding can see is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotlens.llm.substring_dedup import MULTIPLIER, U64, _mixed, hash_words, split_words, window_hashes
from depotlens.llm.workers import reachable
from depotlens.plans.durable import materialize
from depotlens.plans.lookups import lookup_skewed

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 24
ROWS = 6
COORDINATES = BANDS * ROWS
#: The first rank cell is 2**-LEVELS wide; the following double, up to 4.
LEVELS = 3
#: Rank cells are at most 4 wide, so more darts in one are hardly ever drawn.
MAX_DARTS_IN_CELL = 24
#: Sizes of a block of a bucket; two blocks and a matrix of their shared shingles fit in a task.
BLOCK_MEMBERS = 512
BLOCK_SHINGLES = 400_000
COLUMNS = 4096
#: Text that a task turns into shingles at a time.
SLICE_BYTES = 1 << 20

_poisson = {}


def _counts(uniform: np.ndarray, area: float) -> np.ndarray:
    """Poisson numbers of mean ``area`` from uniform ones."""
    if area not in _poisson:
        terms = [np.exp(-area)]
        for i in range(1, MAX_DARTS_IN_CELL + 1):
            terms.append(terms[-1] * area / i)
        _poisson[area] = np.cumsum(terms)
    return np.searchsorted(_poisson[area], uniform, side="right")


def _hash(a: np.ndarray, salt: int) -> np.ndarray:
    return _mixed((a + U64(salt * 0x632BE59BD9B4E019 & (1 << 64) - 1)) * U64(MULTIPLIER) ^ (a >> U64(31)))


def _uniform(h: np.ndarray) -> np.ndarray:
    return (h >> U64(11)).astype(np.float64) * 2.0**-53


def shingles(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the shingles and their weights, 1 however often they occur.

    Words are runs without white space, A-Z in lower case. A text of one to four words is
    one shingle, a text without words has none.
    """
    words = split_words(text.lower() if text else None)
    if 0 < len(words) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], U64), np.ones(1)
    found = np.unique(window_hashes(hash_words(words), SHINGLE))
    return found, np.ones(len(found))


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], k: int = COORDINATES) -> np.ndarray:
    """(sets, k): one dart (as a hash) per coordinate, for sets of positive total weight."""
    sizes = np.array([len(e) for e, _ in sets])
    elements = np.concatenate([e for e, _ in sets])
    weights = np.concatenate([w for _, w in sets])
    totals = np.add.reduceat(weights, np.cumsum(sizes) - sizes)
    # An element of weight x is its unit cells 0, 1, ... of the weight axis, the last one in part.
    units = np.ceil(weights).astype(np.int64)
    of = np.repeat(np.arange(len(elements)), units)
    cell = np.arange(len(of)) - (np.cumsum(units) - units)[of]
    base = _hash(elements[of] + cell.astype(U64) * U64(0xD6E8FEB86659FD93), 1)
    room = np.minimum(1.0, weights[of] - cell)
    owner = np.repeat(np.arange(len(sets)), sizes)[of]
    best_rank = np.full(len(sets) * k, np.inf)
    best_dart = np.zeros(len(sets) * k, U64)
    done = np.zeros(len(sets))
    bound = (k * np.log(k) + 2 * k) / totals
    todo = np.arange(len(owner))
    while len(todo):
        low, width, number = 0.0, 2.0**-LEVELS, 0
        alive = todo
        while len(alive):
            seeds = _hash(base[alive], 20 + number)
            chance = _uniform(seeds)
            hit = np.flatnonzero(chance >= np.exp(-width))
            counts = _counts(chance[hit], width)
            which = np.repeat(hit, counts)
            nth = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
            darts = _hash(seeds[which] + nth.astype(U64), 3)
            rank = low + width * _uniform(_hash(darts, 5))
            inside = alive[which]
            own = owner[inside]
            ok = (rank < bound[own]) & (rank >= done[own]) & (_uniform(_hash(darts, 7)) < room[inside])
            darts, rank, own = darts[ok], rank[ok], own[ok]
            place = own * k + (_hash(darts, 11) % U64(k)).astype(np.int64)
            np.minimum.at(best_rank, place, rank)
            first = rank == best_rank[place]
            best_dart[place[first]] = darts[first]
            low += width
            width = min(4.0, low)
            number += 1
            alive = alive[bound[owner[alive]] > low]
        empty = ~np.isfinite(best_rank.reshape(-1, k)).all(1)
        done, bound = bound, np.where(empty, bound * 2, 0)
        todo = todo[empty[owner[todo]]]
    return best_dart.reshape(-1, k)


def band_hashes(sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    darts = signatures(sets).reshape(-1, BANDS, ROWS)
    mixed = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U64), darts.shape[:2])
    for row in range(ROWS):
        mixed = _hash(mixed * U64(0x9FB21C651E98DF25) + darts[:, :, row], 13)
    return mixed.view(np.int64)


def _slices(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most ``SLICE_BYTES`` of text, so that long texts are held few at a time; one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    begin = held = 0
    for i, size in enumerate(sizes.tolist()):
        if i > begin and (i - begin == most or held + size > SLICE_BYTES):
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += size
    if batch.num_rows:
        yield batch.slice(begin)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows to id, digest of the set of shingles and bands."""
    for batch in batches:
        for part in _slices(batch, 256):
            found = [shingles(t) for t in part.column("text").cast(pa.binary()).to_pylist()]
            digest = [xxhash.xxh3_128_digest(e.tobytes()) if len(e) else None for e, _ in found]
            bands: list[np.ndarray | None] = [None] * len(found)
            at = [i for i, (e, _) in enumerate(found) if len(e)]
            for i, row in zip(at, band_hashes([found[i] for i in at]) if at else ()):
                bands[i] = row
            yield pa.record_batch(
                {
                    "doc_id": part.column("doc_id"),
                    "digest": pa.array(digest, pa.binary()),
                    "bands": pa.array(bands, pa.list_(pa.int64())),
                }
            )


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _slices(batch, 1024):
            found = [shingles(t)[0] for t in part.column("text").cast(pa.binary()).to_pylist()]
            yield pa.record_batch(
                {
                    "node": part.column("node"),
                    "shingles": pa.array([f.tobytes() for f in found], pa.binary()),
                    "n": pa.array([len(f) for f in found], pa.int32()),
                }
            )


def _verify(threshold: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("sa"), batch.column("sb")):
                # Views of the batch: pairs of long texts are not copied.
                x, y = np.frombuffer(a.as_buffer(), U64), np.frombuffer(b.as_buffer(), U64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= threshold * (len(x) + len(y) - both) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return verify


def components(links: DataFrame) -> DataFrame:
    """(node, label) for links (a, b): the smallest node of each connected component.

    Labels fall to the smallest label around, then to the label of that label, so a chain of
    n links takes about log n rounds. Every round is written, and only counts reach the driver.
    """
    both = materialize(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))), "links")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label")), "labels")
    while True:
        around = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(around, F.col("node") == F.col("a")).select(
            "node", F.col("label").alias("was"), F.least("label", "near").alias("next")
        )
        jump = labels.select(F.col("node").alias("_at"), F.col("label").alias("_to"))
        stepped = lower.join(jump, F.col("next") == F.col("_at"), "left").select(
            "node", "was", F.least("next", F.coalesce("_to", "next")).alias("label")
        )
        new = materialize(stepped, "labels")
        if new.filter("label <> was").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")


def _links(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of at least the threshold; sizes that rule it out are dropped before."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"), F.col("n").alias("na"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"), F.col("n").alias("nb"))
    sized = pairs.join(left.select("a", "na"), "a").join(right.select("b", "nb"), "b")
    possible = F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(threshold) - F.lit(1e-9)
    full = sized.filter(possible).select("a", "b").join(left.drop("na"), "a").join(right.drop("nb"), "b")
    return full.select("a", "b", "sa", "sb").mapInArrow(_verify(threshold), "a bigint, b bigint")


def near_classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id``, ``class_id`` and ``kept`` for every row of ``docs`` (``doc_id`` bigint, ``text``).

    Two texts are linked if the Jaccard similarity of their sets of five-word shingles is at
    least ``similarity``; classes are the connected components, named by their smallest id,
    whose row is the one ``kept``. Rows with a NULL id keep ``class_id`` NULL and stay, as
    nothing can refer to them. A text without words (NULL or empty) is a class of its own; texts of one
    to four words are alike only if equal up to the case of A-Z. Rows that share an id
    are in one class. Other columns are ignored; an empty table gives an empty result.
    """
    reachable(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    signed = materialize(texts.mapInArrow(_sign, "doc_id bigint, digest binary, bands array<bigint>"), "signatures")
    known = signed.filter(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    # Texts of equal shingles are one node, however many there are.
    members = known.groupBy("digest").agg(F.min("doc_id").alias("node"))
    nodes = known.select("doc_id", "digest", "bands").join(
        members.withColumnRenamed("digest", "_digest"), (F.col("digest") == F.col("_digest")) & (F.col("doc_id") == F.col("node"))
    )
    placed = nodes.select("node", F.posexplode("bands").alias("band", "value"))
    bucket = F.xxhash64("band", "value")
    placed = placed.select("node", bucket.alias("bucket")).distinct()
    crowded = placed.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    buckets = materialize(placed.join(crowded.select(F.col("bucket").alias("_b")), F.col("bucket") == F.col("_b")).drop("_b"), "buckets")
    sides = buckets.select("node").distinct()
    chosen = texts.join(sides, F.col("doc_id") == F.col("node")).select("node", "text").dropDuplicates(["node"])
    sets = materialize(chosen.mapInArrow(_shingle_sets, "node bigint, shingles binary, n int"), "shingles")
    labels = _settle(buckets, sets, similarity)
    # Classes of digests first, one row each; then one look-up for all rows, copies of one text in place.
    named = members.join(labels.select(F.col("node").alias("_node"), "label"), F.col("node") == F.col("_node"), "left")
    classes = named.select(F.col("digest").alias("id"), F.coalesce("label", "node").alias("class_id"))
    met = lookup_skewed(signed.select("doc_id", "digest"), classes, "digest", class_id="class_id")
    classed = met.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"))
    return classed.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def _within_blocks(threshold: float):
    """Links between members of two blocks of a bucket (or within one), a spanning set of them."""

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        one, two = key[1].as_py(), key[2].as_py()
        nodes = table.column("node").to_numpy()
        labels = table.column("label").to_numpy()
        block = table.column("block").to_numpy()
        sets = [np.frombuffer(x, U64) for x in table.column("shingles").to_pylist()]
        sizes = np.array([len(x) for x in sets], np.float32)
        shared, column = np.unique(np.concatenate(sets), return_inverse=True)
        often = np.bincount(column) > 1
        number = np.cumsum(often) - 1
        row = np.repeat(np.arange(len(sets)), sizes.astype(np.int64))
        row, column = row[often[column]], number[column[often[column]]]
        both = np.zeros((len(sets), len(sets)), np.float32)
        for begin in range(0, int(often.sum()), COLUMNS):
            part = (column >= begin) & (column < begin + COLUMNS)
            matrix = np.zeros((len(sets), COLUMNS), np.float32)
            matrix[row[part], column[part] - begin] = 1
            both += matrix @ matrix.T
        alike = both >= threshold * (sizes[:, None] + sizes[None] - both) - 1e-4
        alike &= labels[:, None] != labels[None]
        if one != two:
            alike &= block[:, None] != block[None]
        top = dict(zip(labels.tolist(), labels.tolist()))

        def root(x: int) -> int:
            while top[x] != x:
                top[x] = top[top[x]]
                x = top[x]
            return x

        found = []
        for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(alike)))):
            x, y = root(labels[i].item()), root(labels[j].item())
            if x != y:
                top[max(x, y)] = min(x, y)
                found.append((nodes[i], nodes[j]))
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return compare


def _settle(buckets: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(node, label): components of all links between nodes that share a bucket."""
    pivots = buckets.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("node"), "node")).alias("pivot"))
    pivots = pivots.select(F.col("bucket").alias("_bucket"), F.col("pivot.node").alias("pivot"))
    met = buckets.join(pivots, F.col("bucket") == F.col("_bucket")).filter("node <> pivot")
    pairs = met.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    stars = materialize(_links(pairs, sets, similarity), "stars")
    labels = components(stars)
    named = labels.select(F.col("node").alias("_node"), "label")
    labelled = buckets.join(named, F.col("node") == F.col("_node"), "left").select("bucket", "node", F.coalesce("label", "node").alias("label"))
    sized = labelled.join(sets.select(F.col("node").alias("_node"), "n"), F.col("node") == F.col("_node")).drop("_node")
    state = sized.groupBy("bucket").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("members"), F.sum("n").alias("total")
    )
    # A bucket of one class has nothing left to find.
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK_MEMBERS), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    mixed = materialize(state.filter("low <> high").select(F.col("bucket").alias("_bucket"), blocks.alias("blocks")), "mixed")
    if mixed.isEmpty():
        return labels
    block = F.pmod(F.xxhash64("node", F.lit(9)), F.col("blocks")).cast("int")
    dealt = labelled.join(mixed, F.col("bucket") == F.col("_bucket")).withColumn("block", block)
    # Each block meets every block of its bucket once, itself included.
    copies = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "bucket", "node", "label", "block", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two")
    )
    full = copies.join(sets.select(F.col("node").alias("_node"), "shingles"), F.col("node") == F.col("_node")).drop("_node")
    crossing = full.groupBy("bucket", "one", "two").applyInArrow(_within_blocks(similarity), "a bigint, b bigint")
    # What the classes so far hold together need not be looked at again.
    left, right = (labels.select(F.col("node").alias(f"_{x}"), F.col("label").alias(f"l{x}")) for x in "ab")
    between = (
        materialize(crossing, "crossing")
        .join(left, F.col("a") == F.col("_a"), "left")
        .join(right, F.col("b") == F.col("_b"), "left")
        .select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
        .filter("a <> b")
        .distinct()
    )
    merged = components(between)
    outer = merged.select(F.col("node").alias("_old"), F.col("label").alias("_new"))
    nodes = labels.union(
        merged.join(labels.select(F.col("node").alias("_known")), F.col("node") == F.col("_known"), "left_anti").select("node", F.col("node"))
    )
    return nodes.join(outer, F.col("label") == F.col("_old"), "left").select("node", F.coalesce("_new", "label").alias("label"))
