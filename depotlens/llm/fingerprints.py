"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A paragraph (line) is a 64-bit digest that falls in one cell of each of three segments; a cell
holds how many digests it has and the XOR of the digests and of their check hashes. Subtracting
two sketches cancels what the versions share. Peeling then recovers the rest: a cell with one
digest (its check hash fits) gives that digest away, which is taken out of its other cells, and
so on. If cells remain, larger sketches are compared: the digests left are dealt by hash to
groups with a sketch each, as many as they need, with other places for each retry; the few that are left after the
last one are compared as they are. Built from DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depotlens.llm.workers import text_or_empty
from depotlens.plans.durable import materialize

SEGMENTS = 3
PER_SEGMENT = 11
CELLS = SEGMENTS * PER_SEGMENT
#: Digests that a group of a retry holds on average, of both versions together.
PER_GROUP = 10
RETRIES = 3
PEEL_ROUNDS = 8


def paragraph_digests(text: Column) -> Column:
    """Distinct digests of the lines."""
    return F.array_distinct(F.transform(F.split(text, "\n"), lambda line: F.xxhash64(line)))


def _item(k: Column, attempt: int = 0) -> Column:
    """A digest, its check hash and its place in each segment, another one for each attempt."""
    place = F.xxhash64(k, F.lit(2 + attempt))
    places = [
        F.pmod(F.shiftright(place, 20 * s).bitwiseAND(F.lit(0xFFFFF).cast("bigint")), F.lit(PER_SEGMENT)).cast("int").alias(f"p{s}")
        for s in range(SEGMENTS)
    ]
    return F.struct(k.alias("k"), F.xxhash64(k, F.lit(1)).alias("c"), *places)


def _items(digests: Column, attempt: int = 0) -> Column:
    return F.transform(digests, lambda k: _item(k, attempt))


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def _moved(cell: Column, item: Column, n: Column) -> Column:
    return F.struct(
        (cell["n"] + n).alias("n"), cell["k"].bitwiseXOR(item["k"]).alias("k"), cell["c"].bitwiseXOR(item["c"]).alias("c")
    )


def _sketch(items: Column) -> Column:
    zero = F.lit(0).cast("bigint")
    start = F.struct(F.lit(0).alias("n"), zero.alias("k"), zero.alias("c"))
    places = F.array(*[F.lit(i) for i in range(PER_SEGMENT)])

    def segment(items: Column, s: int) -> Column:
        def cell(at: Column) -> Column:
            hits = F.filter(items, lambda x: x[f"p{s}"] == at)
            return F.aggregate(hits, start, lambda acc, x: _moved(acc, x, F.lit(1)))

        return F.transform(places, cell)

    return _bind(items, lambda bound: F.concat(*[segment(bound, s) for s in range(SEGMENTS)]))


def _minus(a: Column, b: Column) -> Column:
    return F.zip_with(
        a,
        b,
        lambda x, y: F.struct(
            (x["n"] - y["n"]).alias("n"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["c"].bitwiseXOR(y["c"]).alias("c")
        ),
    )


def _peel(cells: Column, attempt: int = 0) -> Column:
    """struct(cells left, plus, minus): how many digests only the first, only the second has."""
    start = F.struct(cells.alias("cells"), F.lit(0).alias("plus"), F.lit(0).alias("minus"))

    def step(state: Column, _: Column) -> Column:
        pure = F.filter(state["cells"], lambda c: (F.abs(c["n"]) == 1) & (F.xxhash64(c["k"], F.lit(1)) == c["c"]))
        digests = F.array_distinct(F.transform(pure, lambda c: F.struct(c["n"].alias("n"), c["k"].alias("k"))))
        found = F.transform(digests, lambda d: F.struct(d["n"].alias("n"), _item(d["k"], attempt).alias("i")))

        def remove(found: Column) -> Column:
            def segment(s: int) -> Column:
                def without(cell: Column, at: Column) -> Column:
                    hits = F.filter(found, lambda x: x["i"][f"p{s}"] == at)
                    return F.aggregate(hits, cell, lambda acc, x: _moved(acc, x["i"], -x["n"]))

                return F.transform(F.slice(state["cells"], s * PER_SEGMENT + 1, PER_SEGMENT), without)

            plus = F.size(F.filter(found, lambda x: x["n"] == 1))
            cleaned = F.struct(
                F.concat(*[segment(s) for s in range(SEGMENTS)]).alias("cells"),
                (state["plus"] + plus).alias("plus"),
                (state["minus"] + F.size(found) - plus).alias("minus"),
            )
            return F.when(F.size(found) > 0, cleaned).otherwise(state)

        return _bind(found, remove)

    return F.aggregate(F.array(*[F.lit(i) for i in range(PEEL_ROUNDS)]), start, step)


def _is_open(peeled: Column) -> Column:
    return F.exists(peeled["cells"], lambda c: (c["n"] != 0) | (c["k"] != 0) | (c["c"] != 0))


def _result(plus: Column, minus: Column, rest_a: Column, rest_b: Column) -> Column:
    return F.struct(plus.alias("plus"), minus.alias("minus"), rest_a.alias("rest_a"), rest_b.alias("rest_b"))


def _settled(peeled: Column, a: Column, b: Column) -> Column:
    """What peeling told; the digests themselves are left over if it got stuck."""
    zero, none = F.lit(0), F.array().cast("array<bigint>")
    return F.when(_is_open(peeled), _result(zero, zero, a, b)).otherwise(_result(peeled["plus"], peeled["minus"], none, none))


def _retry(state: Column, attempt: int) -> Column:
    """Compare what is left over in groups with a sketch each.

    Digests are dealt to about as many neighbourhoods of groups as a neighbourhood has groups, then to the groups, so a
    digest is looked at some 2 * sqrt(groups) times.
    """
    total = (F.size(state["rest_a"]) + F.size(state["rest_b"])).cast("bigint")
    groups = F.greatest(F.lit(1 + attempt).cast("bigint"), F.ceil(total / F.lit(PER_GROUP)))

    def in_groups(bound: Column) -> Column:
        groups, wide = bound["groups"], bound["wide"]

        def group_of(k: Column) -> Column:
            return F.pmod(F.xxhash64(k, F.lit(100 + attempt)), groups)

        def where(pair: Column, met: Callable[[Column], Column]) -> Column:
            return F.struct(*[F.filter(pair[side], met).alias(side) for side in "ab"])

        def compared(pair: Column) -> Column:
            cells = _minus(_sketch(_items(pair["a"], attempt)), _sketch(_items(pair["b"], attempt)))
            return _bind(_peel(cells, attempt), lambda peeled: _settled(peeled, pair["a"], pair["b"]))

        def neighbourhood(o: Column) -> Column:
            own = F.sequence(o * wide, F.least((o + 1) * wide, groups) - 1)
            near = where(bound, lambda k: F.floor(group_of(k) / wide) == o)
            return _bind(near, lambda pair: F.transform(own, lambda g: _bind(where(pair, lambda k: group_of(k) == g), compared)))

        return F.flatten(F.transform(F.sequence(F.lit(0).cast("bigint"), F.ceil(groups / wide) - 1), neighbourhood))

    wide = F.ceil(F.sqrt(groups))
    dealt = F.struct(groups.alias("groups"), wide.alias("wide"), state["rest_a"].alias("a"), state["rest_b"].alias("b"))

    def summed(parts: Column) -> Column:
        def told(name: str) -> Column:
            return F.aggregate(parts, state[name], lambda acc, x: acc + x[name])

        def left(name: str) -> Column:
            return F.flatten(F.transform(parts, lambda x: x[name]))

        return _result(told("plus"), told("minus"), left("rest_a"), left("rest_b"))

    return _bind(_bind(dealt, in_groups), summed)


def with_difference(df: DataFrame, a: str, b: str, sketch_a: str, sketch_b: str, name: str) -> DataFrame:
    """Add ``name``: struct(plus, minus, rest_a, rest_b), how the digests of ``a`` and ``b`` differ.

    The stored sketches are tried first, then larger ones: groups of digests with a sketch
    each and other places, as many as are left over. What no attempt could tell is compared exactly, so ``rest`` is empty.
    """
    first = _bind(_peel(_minus(F.col(sketch_a), F.col(sketch_b))), lambda peeled: _settled(peeled, F.col(a), F.col(b)))
    df = df.withColumn(name, first)
    for attempt in range(1, RETRIES + 1):
        left = F.size(F.col(name)["rest_a"]) + F.size(F.col(name)["rest_b"]) > 0
        df = df.withColumn(name, F.when(left, _retry(F.col(name), attempt)).otherwise(F.col(name)))
    state, none = F.col(name), F.array().cast("array<bigint>")
    only_a = F.size(F.array_except(state["rest_a"], state["rest_b"]))
    only_b = F.size(F.array_except(state["rest_b"], state["rest_a"]))
    left = F.size(state["rest_a"]) + F.size(state["rest_b"]) > 0
    exact = _result(state["plus"] + only_a, state["minus"] + only_b, none, none)
    return df.withColumn(name, F.when(left, exact).otherwise(state))


def likeness(size_a: Column, size_b: Column, difference: Column) -> Column:
    """Jaccard similarity of the sets of digests, from their sizes and what differs."""
    only_a = difference["plus"] + F.size(difference["rest_a"])
    only_b = difference["minus"] + F.size(difference["rest_b"])
    shared = F.greatest(F.lit(0), F.least(size_a - only_a, size_b - only_b))
    return F.when(size_a + size_b == 0, 1.0).otherwise(shared / (size_a + size_b - shared))


def as_text(sketch: Column) -> Column:
    """Cells as hexadecimal numbers, ``n:k:c``, comma-joined."""
    return F.array_join(F.transform(sketch, lambda c: F.concat_ws(":", c["n"], F.hex(c["k"]), F.hex(c["c"]))), ",")


def sketch_of(digests: Column) -> Column:
    return _sketch(_items(digests))


def next_documents(docs: DataFrame) -> DataFrame:
    """For every distinct (doc_id, text): the length, the one before it and that one's length.

    Order is by id, NULL first, then by a hash of the text; the last precedes the first.
    Only ids, hashes and lengths are moved. Ranges of ids are numbered in one written table, so the order
    is one window per range, and neighbouring ranges meet through their last rows.
    """
    keys = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.xxhash64(text_or_empty(), F.lit(5)).alias("hash"),
        F.length(text_or_empty()).cast("bigint").alias("n_chars"),
    )
    ranged = keys.groupBy("doc_id", "hash").agg(F.max("n_chars").alias("n_chars"))
    ranged = materialize(ranged.repartitionByRange("doc_id", "hash").withColumn("range", F.spark_partition_id()), "document-order")
    within = Window.partitionBy("range").orderBy(F.col("doc_id").asc_nulls_first(), "hash")
    own = F.struct("doc_id", "hash", "n_chars")
    lagged = ranged.withColumn("before", F.lag(own).over(within))
    order = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "hash", "n_chars")
    lasts = ranged.groupBy("range").agg(F.max(order).alias("last"))
    # One row per range: as many as the shuffle has partitions.
    ranges = Window.partitionBy(F.lit(0)).orderBy("range")
    whole = ranges.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lasts = lasts.select(
        F.col("range").alias("_range"), F.coalesce(F.lag("last").over(ranges), F.last("last").over(whole)).alias("_last")
    )
    last = F.struct(F.col("_last.doc_id").alias("doc_id"), F.col("_last.hash").alias("hash"), F.col("_last.n_chars").alias("n_chars"))
    joined = lagged.join(lasts, F.col("range") == F.col("_range"))
    return joined.select("doc_id", "hash", "n_chars", F.coalesce("before", last).alias("before"))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited version, with likenesses.

    The edited text of a document has its last floor(n_chars / 4) code points replaced by the
    first as many (or all) of the next document's, in ascending order of ``doc_id``; the first follows
    the last. Returns per row of ``docs``: ``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``,
    ``edited_fingerprint``, ``near_edited``, ``near_next`` and ``edited_open``, ``next_open``: paragraphs that
    are still open at the end, always 0.

    A NULL text is empty: one empty paragraph. NULL ids come first; rows that share an id are ordered by a
    hash of the text; repeated rows are one document and get equal results. A lone document
    is its own next. Other columns are ignored; an empty table gives an empty result.
    """
    order = materialize(next_documents(docs), "next-documents")
    texts = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.xxhash64(text_or_empty(), F.lit(5)).alias("hash"),
        text_or_empty().alias("text"),
    )
    side = order.select(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash"), "n_chars", "before")
    placed = texts.join(side, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash"))).drop("_id", "_hash")
    heads = placed.select(
        F.col("before.doc_id").alias("_id"),
        F.col("before.hash").alias("_hash"),
        F.left("text", F.floor(F.col("before.n_chars") / 4).cast("int")).alias("head"),
        paragraph_digests(F.col("text")).alias("next_digests"),
    ).dropDuplicates(["_id", "_hash"])
    met = placed.join(heads, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    edited = met.select(
        "doc_id",
        "n_chars",
        "next_digests",
        paragraph_digests(F.col("text")).alias("digests"),
        F.concat(F.left("text", F.col("n_chars").cast("int") - cut), F.col("head")).alias("edited"),
    )
    digested = edited.select(
        "doc_id",
        "n_chars",
        "digests",
        "next_digests",
        F.sha2("edited", 256).alias("edited_sha256"),
        paragraph_digests(F.col("edited")).alias("edited_digests"),
    )
    sketched = materialize(
        digested.withColumns({f"{x}_sketch": sketch_of(F.col(f"{x}digests")) for x in ("", "edited_", "next_")}), "sketches"
    )
    compared = with_difference(sketched, "digests", "edited_digests", "_sketch", "edited__sketch", "to_edited")
    compared = with_difference(compared, "digests", "next_digests", "_sketch", "next__sketch", "to_next")
    return compared.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("_sketch")).alias("fingerprint"),
        as_text(F.col("edited__sketch")).alias("edited_fingerprint"),
        likeness(F.size("digests"), F.size("edited_digests"), F.col("to_edited")).alias("near_edited"),
        likeness(F.size("digests"), F.size("next_digests"), F.col("to_next")).alias("near_next"),
        F.size(F.concat(F.col("to_edited")["rest_a"], F.col("to_edited")["rest_b"])).alias("edited_open"),
        F.size(F.concat(F.col("to_next")["rest_a"], F.col("to_next")["rest_b"])).alias("next_open"),
    )
