"""Collocations by dynamic itemset counting.

Texts are encoded once: blocks of word numbers with the block's own word list, dealt to shards.
Shards are then scanned in a cycle, all lengths side by side. Words are counted from the first
shard on. A pair of words is counted from the shard on before which both words had reached the
threshold, three words from the one before which both pairs had; each until it has been
counted in every shard once. Counters are keyed by 64-bit codes, and two bit maps tell a task which codes
have reached the threshold. Bit maps have a fixed size and bits are only ever set, so a phrase is
counted in exactly the shards from its start on for one cycle, even if a foreign code has set its
bit: then it starts earlier, and that is all. Hence no phrase of at least ``threshold`` occurrences
is missed, whatever the size of the maps; larger ones only keep more rare phrases out.

A last scan of the blocks attaches the words to the frequent codes and counts them by their
text, so the counts returned are those of the phrases themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depotlens.llm.substring_dedup import MULTIPLIER, U64, _mixed
from depotlens.llm.workers import reachable, size_of, text_or_empty
from depotlens.plans.durable import materialize, new_path

SHARDS = 2
THRESHOLD = 10
TOP = 2000
#: A longer phrase with this share of a phrase's occurrences replaces it (in per cent).
ABSORBED = 50
#: Word numbers of a block fit in 21 bits, three of them in one 64-bit number.
BLOCK_TOKENS = 1 << 20
WORD_BITS = 21
CHUNK_BYTES = 1 << 20
#: A bit map takes a bit for each four bytes of text, within these bounds (16 MB at most).
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 27
#: Bit maps reach the driver in pieces of so many bits.
PIECE_BITS = 1 << 16
RANKING_PARTS = 256
UNKNOWN = "und"
BREAK = b"."

BLOCKS = "lang string, n bigint, carried int, words binary, size int, ids binary, shard int"


def _table() -> bytes:
    """A-Z to a-z, ends of pieces to ``.`` and tab to space."""
    table = bytearray(range(256))
    for upper in range(ord("A"), ord("Z") + 1):
        table[upper] = upper + 32
    for end in b",;:!?\n\x0b\x0c\r":
        table[end] = BREAK[0]
    table[ord("\t")] = ord(" ")
    return bytes(table)


TABLE = _table()


def tokens(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text in order, ``.`` between pieces; in lists of bounded size."""
    begin = 0
    while begin < len(text):
        end = begin + CHUNK_BYTES
        part = text[begin:end].translate(TABLE)
        if end < len(text):
            # Up to the last place where no word is cut; a longer word is taken whole.
            cut = max(part.rfind(b" "), part.rfind(BREAK)) + 1
            while not cut and end < len(text):
                end += end - begin
                part = text[begin:end].translate(TABLE)
                cut = max(part.rfind(b" "), part.rfind(BREAK)) + 1
            if end < len(text):
                part = part[:cut]
        begin += len(part)
        yield part.replace(BREAK, b" . ").split()


class _Numbers(dict):
    """Word to number, in order of appearance; 0 is the end of a piece."""

    def __init__(self, words: list[bytes] = ()) -> None:
        super().__init__()
        self[BREAK]
        for word in words:
            self[word]

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _packed(ids: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T[:3])
    return pa.Codec("zstd", compression_level=1).compress(planes.tobytes(), asbytes=True)


def _unpacked(data: bytes, size: int) -> np.ndarray:
    planes = np.frombuffer(pa.Codec("zstd").decompress(data, 3 * size, asbytes=True), np.uint8).reshape(3, size)
    return planes[0].astype(np.int64) | planes[1].astype(np.int64) << 8 | planes[2].astype(np.int64) << 16


class _Writer:
    """Blocks of one language and shard."""

    def __init__(self, lang: str, shard: int, block_tokens: int) -> None:
        self.lang, self.shard, self.most = lang, shard, block_tokens
        self.begin([])

    def begin(self, carried: list[bytes]) -> None:
        self.numbers = _Numbers()
        self.carried = len(carried)
        self.parts = [np.fromiter(map(self.numbers.__getitem__, carried), np.int64, len(carried))]
        self.size = self.carried

    def add(self, words: list[bytes]) -> Iterator[tuple]:
        while words:
            part, words = words[: self.most], words[self.most :]
            self.parts.append(np.fromiter(map(self.numbers.__getitem__, part), np.int64, len(part)))
            self.size += len(part)
            if self.size >= self.most:
                # Phrases that run on into the next block need the two words before.
                yield self.row()
                names = list(self.numbers)
                self.begin([names[i] for i in np.concatenate(self.parts)[-2:]])

    def row(self) -> tuple:
        ids = np.concatenate(self.parts)
        n = int(np.count_nonzero(ids[self.carried :]))
        return self.lang, n, self.carried, b" ".join(self.numbers), len(ids), _packed(ids), self.shard


def _encoder(block_tokens: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("lang", pa.string()), ("n", pa.int64()), ("carried", pa.int32()), ("words", pa.binary()), ("size", pa.int32()),
             ("ids", pa.binary()), ("shard", pa.int32())]
        )

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        writers: dict[tuple, _Writer] = {}
        for batch in batches:
            columns = [batch.column("lang"), batch.column("shard"), batch.column("text").cast(pa.binary())]
            for lang, shard, text in zip(*(c for c in columns)):
                key = lang.as_py(), shard.as_py()
                if key not in writers:
                    writers[key] = _Writer(*key, block_tokens)
                for words in tokens(text.as_py()):
                    for row in writers[key].add(words):
                        yield made([row])
                yield from map(made, ([row] for row in writers[key].add([BREAK])))
            if sum(w.size for w in writers.values()) > 4 * block_tokens:
                yield made([w.row() for w in writers.values()])
                writers = {}
        if writers:
            yield made([w.row() for w in writers.values()])

    return encode


def encode(docs: DataFrame, shards: int = SHARDS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks of word numbers in shared storage, a folder for each shard."""
    spark = docs.sparkSession
    texts = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"),
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("int").alias("shard"),
        text_or_empty().alias("text"),
    )
    path = new_path(spark, "phrase-shards")
    texts.mapInArrow(_encoder(block_tokens), BLOCKS).write.partitionBy("shard").parquet(path)
    return spark.read.schema(BLOCKS).parquet(path)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mixed(a * U64(MULTIPLIER) + (b ^ (b >> U64(32))) * U64(0xC2B2AE3D27D4EB4F))


def _is_set(bits: np.ndarray | None, codes: np.ndarray) -> np.ndarray:
    if bits is None:
        return np.zeros(len(codes), bool)
    at = codes & U64(8 * len(bits) - 1)
    return (bits[at >> U64(3)] >> (at & U64(7)).astype(np.uint8)) & 1 > 0


class _Block:
    """Word numbers of a block, the codes of its words and of neighbours that are counted."""

    def __init__(self, row: dict) -> None:
        self.names = row["words"].split(b" ")
        seed = xxhash.xxh64_intdigest(row["lang"].encode())
        self.codes = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in self.names), U64, len(self.names))
        self.ids = _unpacked(row["ids"], row["size"])
        self.carried = row["carried"]

    def words_in(self, bits: np.ndarray | None) -> np.ndarray:
        found = _is_set(bits, self.codes)
        found[0] = False
        return found

    def pairs_in(self, words: np.ndarray) -> np.ndarray:
        """Places whose word and next word are both set."""
        on = words[self.ids]
        return on[:-1] & on[1:]

    def pair_codes(self, places: np.ndarray) -> np.ndarray:
        return _pair(self.codes[self.ids[places]], self.codes[self.ids[places + 1]])


def _spread(places: np.ndarray, values: np.ndarray, size: int, kind: type) -> np.ndarray:
    out = np.zeros(size, kind)
    out[places] = values
    return out


def _phrases(block: _Block, words: tuple, pairs: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places and codes of the pairs and triples that have started, but not a cycle ago.

    ``words`` and ``pairs`` are bit maps as of now and as of a cycle ago.
    """
    now, old = (block.pairs_in(block.words_in(bits)) for bits in words)
    places = np.flatnonzero(now)
    codes = block.pair_codes(places)
    own = ~old[places] & (places + 1 >= block.carried)
    size = len(now) + 1
    code_at = _spread(places, codes, size, U64)
    reached, before = (_spread(places, _is_set(bits, codes), size, bool) for bits in pairs)
    before[:-1] &= old
    start = reached[:-1] & reached[1:] & ~(before[:-1] & before[1:])
    triples = np.flatnonzero(start)
    triples = triples[triples + 2 >= block.carried]
    of_three = _pair(code_at[triples] ^ U64(0x2545F4914F6CDD1D), block.codes[block.ids[triples + 2]])
    return places[own], codes[own], triples, of_three


def _counter(shared: Broadcast, with_words: bool):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                block = _Block(batch.slice(row, 1).to_pylist()[0])
                _, codes, _, of_three = _phrases(block, words, pairs)
                found = [np.unique(codes, return_counts=True), np.unique(of_three, return_counts=True)]
                if with_words:
                    often = np.bincount(block.ids[block.carried :], minlength=len(block.codes))
                    often[0] = 0
                    found.append((block.codes[often > 0], often[often > 0]))
                lengths = np.repeat(np.array([2, 3, 1][: len(found)], np.int8), [len(c) for c, _ in found])
                yield pa.record_batch(
                    {
                        "length": pa.array(lengths),
                        "code": pa.array(np.concatenate([c for c, _ in found]).view(np.int64)),
                        "n": pa.array(np.concatenate([n for _, n in found]).astype(np.int64)),
                    }
                )

    return count


def _pieces(key: tuple, table: pa.Table) -> pa.Table:
    bits = np.zeros(PIECE_BITS, np.uint8)
    bits[table.column("bit").to_numpy()] = 1
    packed = np.packbits(bits, bitorder="little").tobytes()
    return pa.table({"length": [key[0]], "piece": [key[1]], "bits": pa.array([packed], pa.binary())})


def _bit_maps(reached: DataFrame, size: int, lengths: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Length to bit map of the codes (``length``, ``code``); ``size`` bits each, whatever the number of codes."""
    at = F.col("code").bitwiseAND(F.lit(size - 1))
    piece = F.shiftright(at, PIECE_BITS.bit_length() - 1).cast("int").alias("piece")
    bit = at.bitwiseAND(F.lit(PIECE_BITS - 1)).cast("int").alias("bit")
    drawn = reached.filter(F.col("length").isin(*lengths)).select("length", piece, bit).groupBy("length", "piece")
    maps = {length: np.zeros(size // 8, np.uint8) for length in lengths}
    width = PIECE_BITS // 8
    for row in drawn.applyInArrow(_pieces, "length tinyint, piece int, bits binary").toArrow().to_pylist():
        maps[row["length"]][row["piece"] * width : (row["piece"] + 1) * width] = np.frombuffer(row["bits"], np.uint8)
    return maps


def frequent_codes(blocks: DataFrame, shards: int, threshold: int, bits: int) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """(``length``, ``code``, ``n`` of all phrases counted at least ``threshold`` times; their bit maps)."""
    spark = blocks.sparkSession
    state: DataFrame | None = None
    empty = {length: np.zeros(bits // 8, np.uint8) for length in (1, 2)}
    #: As of each of the last shards, the newest last.
    maps = [empty] * (shards + 1)
    turn = 0
    while turn < shards or any(not np.array_equal(maps[-1][length], maps[0][length]) for length in (1, 2)):
        shared = spark.sparkContext.broadcast(tuple((maps[-1][length], maps[0][length]) for length in (1, 2)))
        counted = blocks.filter(F.col("shard") == turn % shards).mapInArrow(
            _counter(shared, turn < shards), "length tinyint, code bigint, n bigint"
        )
        counted = counted.withColumn("first", F.lit(turn))
        known = counted if state is None else state.unionByName(counted)
        summed = known.groupBy("length", "code").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
        # What was first counted a cycle ago or earlier has been counted everywhere.
        over = F.col("first") <= turn - shards + 1
        state = materialize(summed.filter((F.col("n") >= threshold) | ~over), "phrase-counts")
        shared.destroy()
        maps = [*maps[1:], _bit_maps(state.filter(F.col("n") >= threshold), bits, (1, 2))]
        turn += 1
    frequent = state.filter(F.col("n") >= threshold).select("length", "code", "n")
    return frequent, maps[-1] | _bit_maps(frequent, bits, (3,))


def _namer(shared: Broadcast):
    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = shared.value
        mask = (1 << WORD_BITS) - 1
        for batch in batches:
            for row in range(batch.num_rows):
                values = batch.slice(row, 1).to_pylist()[0]
                block = _Block(values)
                ids, names = block.ids, pa.array(block.names, pa.binary())
                known = block.words_in(maps[1])
                often = np.bincount(ids[block.carried :], minlength=len(known)) * known
                single = np.flatnonzero(often)
                pairs, codes, triples, of_three = _phrases(block, (maps[1], None), (maps[2], None))
                pairs = pairs[_is_set(maps[2], codes)]
                triples = triples[_is_set(maps[3], of_three)]
                two, n_two = np.unique(ids[pairs] << WORD_BITS | ids[pairs + 1], return_counts=True)
                three = (ids[triples] << WORD_BITS | ids[triples + 1]) << WORD_BITS | ids[triples + 2]
                three, n_three = np.unique(three, return_counts=True)

                def text(*numbers: np.ndarray) -> pa.Array:
                    columns = [names.take(pa.array(x)) for x in numbers]
                    return columns[0] if len(columns) == 1 else pc.binary_join_element_wise(*columns, b" ")

                found = [
                    (1, text(single), often[single]),
                    (2, text(two >> WORD_BITS, two & mask), n_two),
                    (3, text(three >> 2 * WORD_BITS, three >> WORD_BITS & mask, three & mask), n_three),
                ]
                lengths = np.repeat(np.array([length for length, _, _ in found], np.int8), [len(n) for _, _, n in found])
                yield pa.record_batch(
                    {
                        "lang": pa.array([values["lang"]] * len(lengths), pa.string()),
                        "length": pa.array(lengths),
                        "phrase": pa.concat_arrays([p for _, p, _ in found]).cast(pa.string()),
                        "n": pa.array(np.concatenate([n for _, _, n in found]).astype(np.int64)),
                    }
                )

    return name


def frequent_phrases(docs: DataFrame, threshold: int = THRESHOLD, shards: int = SHARDS, bits: int | None = None, block_tokens: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame]:
    """(``lang``, ``length``, ``phrase``, ``f`` of all phrases of one to three words that occur at least ``threshold`` times; ``lang``, ``n`` words)."""
    spark = docs.sparkSession
    reachable(spark)
    if bits is None:
        bits = min(MOST_BITS, max(LEAST_BITS, 1 << (size_of(docs) // 4).bit_length()))
    blocks = encode(docs, shards, block_tokens)
    _, maps = frequent_codes(blocks, shards, threshold, bits)
    shared = spark.sparkContext.broadcast(maps)
    named = blocks.mapInArrow(_namer(shared), "lang string, length tinyint, phrase string, n bigint")
    counted = named.groupBy("lang", "length", "phrase").agg(F.sum("n").alias("f")).filter(F.col("f") >= threshold)
    found = materialize(counted, "phrases")
    shared.destroy()
    totals = blocks.groupBy("lang").agg(F.sum("n").alias("n"))
    return found, totals


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), exact for counts up to 10**15."""
    a, left, right = (x.cast("decimal(19,0)") for x in (a, left, right))
    million = F.lit(Decimal(1_000_000)).cast("decimal(7,0)")
    return F.call_function("div", million * a * a, left * right).cast("bigint")


def _ranked(phrases: DataFrame, top: int) -> DataFrame:
    """The first rows of each language; the best of each part of it first, so that no task sorts a whole one."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = phrases.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(RANKING_PARTS)))
    for window in (Window.partitionBy("lang", "_part"), Window.partitionBy("lang")):
        salted = salted.withColumn("rank", F.row_number().over(window.orderBy(*order)).cast("bigint")).filter(F.col("rank") <= top)
    return salted.drop("_part")


def collocations(
    docs: DataFrame,
    threshold: int = THRESHOLD,
    top: int = TOP,
    absorbed: int = ABSORBED,
    shards: int = SHARDS,
    bits: int | None = None,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """The ``top`` phrases of two and three words of each ``lang``, by score.

    ``docs`` has ``doc_id``, ``text`` and ``lang``; other columns are ignored. A-Z are lower-cased, pieces end at
    ``.,;:!?`` and line ends, words at spaces and tabs; phrases lie within a piece. A phrase that occurs ``a >= threshold`` times is cut after
    its first k words into parts of ``l`` and ``r`` occurrences; the cut of the lowest
    floor(1000000 * a * a / (l * r)) counts (ties: the smallest k). A phrase goes if one that is a word longer and holds it has
    at least ``absorbed`` per cent of its occurrences. Returns ``lang``, ``rank`` (from 1; by score and ``a`` descending, then
    ``phrase`` by bytes), ``phrase``, ``a``, ``l``, ``r``, ``n`` (all words of the language) and ``score``.

    A NULL or empty text has no words; a NULL ``lang`` is ``und``. Rows repeated as a whole count as often
    as they are there, ids are only used to deal shards. A language without phrases, or an empty table, gives no rows.
    """
    found, totals = frequent_phrases(docs, threshold, shards, bits, block_tokens)
    words = F.split("phrase", " ")

    def joined(first: int, length: int) -> Column:
        return F.array_join(F.slice(words, first, length), " ")

    def part(frame: DataFrame, name: str, length: int) -> DataFrame:
        side = found.filter(F.col("length") == length).select(
            F.col("lang").alias("_lang"), F.col("phrase").alias("_phrase"), F.col("f").alias(f"f_{name}")
        )
        return frame.join(side, (F.col("lang") == F.col("_lang")) & (F.col(name) == F.col("_phrase"))).drop("_lang", "_phrase")

    two = found.filter("length = 2").select("lang", "phrase", F.col("f").alias("a"), joined(1, 1).alias("one"), joined(2, 1).alias("two"))
    two = part(part(two, "one", 1), "two", 1)
    two = two.select("lang", "phrase", "a", F.col("f_one").alias("l"), F.col("f_two").alias("r"), score(F.col("a"), F.col("f_one"), F.col("f_two")).alias("score"))
    three = found.filter("length = 3").select(
        "lang", "phrase", F.col("f").alias("a"),
        joined(1, 1).alias("head"), joined(2, 2).alias("rest"), joined(1, 2).alias("front"), joined(3, 1).alias("tail"),
    )
    for name, length in (("head", 1), ("rest", 2), ("front", 2), ("tail", 1)):
        three = part(three, name, length)
    three = materialize(three, "triples")
    cuts = [
        F.struct(score(F.col("a"), F.col(f"f_{x}"), F.col(f"f_{y}")).alias("score"), F.lit(k).alias("k"), F.col(f"f_{x}").alias("l"), F.col(f"f_{y}").alias("r"))
        for k, x, y in ((1, "head", "rest"), (2, "front", "tail"))
    ]
    cut = three.withColumn("cut", F.least(*cuts)).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    # The two pairs inside each triple, with the most that any triple has of them.
    inside = three.select(F.col("lang").alias("_lang"), F.explode(F.array("front", "rest")).alias("_phrase"), F.col("a").alias("_longer"))
    inside = inside.groupBy("_lang", "_phrase").agg(F.max("_longer").alias("_longer"))
    met = (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_phrase"))
    gone = 100 * F.coalesce("_longer", F.lit(0)) >= absorbed * F.col("a")
    alone = two.join(inside, met, "left").filter(~gone).drop("_lang", "_phrase", "_longer")
    ranked = _ranked(alone.unionByName(cut), top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
