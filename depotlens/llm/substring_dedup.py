"""Removal of passages that an earlier document has already.

Rabin-Karp hashes of every window of ``width`` words are counted in Spark. Documents are dealt
into batches of bounded size. Each batch sends every distinct window hash once, with the
smallest id that has it, to the hash range it falls in; a range answers to each batch which of
its hashes start in a smaller document elsewhere. So a passage that all documents share costs one entry
per batch and not one per document, and answers hold repeated windows only. Every batch then
marks its words: overlapping windows merge into maximal intervals, found with running sums.

Two different windows meet in one 64-bit hash with a chance of about n * n / 2**65 for n
windows: below one word in a corpus of a thousand million words.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotlens.llm.workers import reachable, size_of

BATCH_BYTES = 8 << 20
#: Windows that one hash range holds on average; a range is what one task sorts at a time.
WINDOWS_PER_RANGE = 2 << 20
BYTES_PER_WORD = 5
MULTIPLIER = 0x9E3779B97F4A7C15
INVERSE = pow(MULTIPLIER, -1, 1 << 64)
NO_ID = np.iinfo(np.int64).max
U64 = np.uint64

OUTPUT = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string, intervals array<struct<first:int,last:int>>"


def split_words(text: bytes | None) -> list[bytes]:
    """Runs of anything but space, tab, line feed, vertical tab, form feed and return."""
    return text.split() if text else []


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), U64, len(words))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U64(33))
    h *= U64(0xFF51AFD7ED558CCD)
    return h ^ (h >> U64(29))


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64"""
    factors = np.full(n, base, U64)
    factors[0] = 1
    return np.cumprod(factors, dtype=U64)


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash of every window of ``width`` neighbours, in constant time each.

    With S the running sums of word * M**-i, the window at i is (S[i + width] - S[i]) * M**i,
    all modulo 2**64.
    """
    n = len(words)
    if n < width:
        return np.empty(0, U64)
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(words * _powers(INVERSE, n), dtype=U64)])
    return _mixed((sums[width:] - sums[:-width]) * _powers(MULTIPLIER, n - width + 1))


class _Batch:
    """The words and windows of a batch of documents."""

    def __init__(self, table: pa.Table, width: int) -> None:
        ids = table.column("doc_id").combine_chunks()
        self.ids = ids.to_pylist()
        rank = ids.fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
        texts = table.column("text").cast(pa.binary()).to_pylist()
        self.words = [split_words(t) for t in texts]
        counts = np.array([len(w) for w in self.words], np.int64)
        self.ends = np.cumsum(counts)
        flat = np.concatenate([hash_words(w) for w in self.words]) if len(counts) else np.empty(0, U64)
        hashes = window_hashes(flat, width)
        owner = np.repeat(np.arange(len(counts)), counts)
        # A window belongs to a document if its first and last words do.
        self.starts = np.flatnonzero(owner[: len(hashes)] == owner[width - 1 :]) if len(hashes) else np.empty(0, np.int64)
        self.hashes = hashes[self.starts]
        self.rank = rank[owner[self.starts]] if len(self.starts) else np.empty(0, np.int64)
        order = np.argsort(self.hashes)
        ordered = self.hashes[order]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(order) else order
        self.distinct = ordered[first]
        self.smallest = np.minimum.reduceat(self.rank[order], first) if len(order) else self.rank
        self.group = np.empty(len(order), np.int64)
        if len(order):
            marks = np.zeros(len(order), np.int64)
            marks[first] = 1
            self.group[order] = np.cumsum(marks) - 1

    def covered(self, elsewhere: np.ndarray, width: int) -> np.ndarray:
        """Which words lie in a window that also starts in a smaller document."""
        known = np.isin(self.distinct, elsewhere, assume_unique=True)
        repeated = self.starts[known[self.group] | (self.rank > self.smallest[self.group])]
        steps = np.zeros((int(self.ends[-1]) if len(self.ends) else 0) + 1, np.int32)
        np.add.at(steps, repeated, 1)
        np.add.at(steps, repeated + width, -1)
        return np.cumsum(steps[:-1]) > 0


def _planes(values: np.ndarray) -> bytes:
    """Bytes of equal weight side by side: leading zeros of small numbers then vanish."""
    raw = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes()
    return pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def _unplaned(data: bytes, n: int, kind: type) -> np.ndarray:
    raw = pa.Codec("zstd").decompress(data, n * 8, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(kind).ravel()


def _pack_sorted(hashes: np.ndarray) -> bytes:
    return _planes(np.diff(hashes, prepend=U64(0)))


def _unpack_sorted(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(_unplaned(data, n, U64), dtype=U64)


def _range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """floor(hash * ranges / 2**64), from the halves of the hash, for fewer than 2**31 ranges."""
    high, low = hashes >> U64(32), hashes & U64(0xFFFFFFFF)
    return (high * U64(ranges) + (low * U64(ranges) >> U64(32)) >> U64(32)).astype(np.int64)


def _sender(width: int, ranges: int):
    def send(key: tuple, table: pa.Table) -> pa.Table:
        batch = _Batch(table, width)
        # Only ranges that hashes of the batch fall in are visited, however many there are.
        number, first = np.unique(_range_of(batch.distinct, ranges), return_index=True)
        cuts = [*first.tolist(), len(batch.distinct)]
        found = list(zip(number.tolist(), cuts, cuts[1:]))
        return pa.table(
            {
                "hash_range": pa.array([i for i, _, _ in found], pa.int32()),
                "batch": pa.array([key[0].as_py()] * len(found), pa.int64()),
                "n": pa.array([b - a for _, a, b in found], pa.int32()),
                "hashes": pa.array([_pack_sorted(batch.distinct[a:b]) for _, a, b in found], pa.binary()),
                "ids": pa.array([_planes(batch.smallest[a:b]) for _, a, b in found], pa.binary()),
            }
        )

    return send


def _answer(key: tuple, table: pa.Table) -> pa.Table:
    sizes = table.column("n").to_pylist()
    batches = table.column("batch").to_pylist()
    hashes = np.concatenate([_unpack_sorted(d.as_py(), n) for d, n in zip(table.column("hashes"), sizes)])
    ids = np.concatenate([_unplaned(d.as_py(), n, np.int64) for d, n in zip(table.column("ids"), sizes)])
    sender = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(hashes)
    ordered = hashes[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    smallest = np.repeat(np.minimum.reduceat(ids[order], first), np.diff(first, append=len(order)))
    told = order[ids[order] > smallest]
    told = told[np.argsort(sender[told], kind="stable")]
    cuts = np.searchsorted(sender[told], np.arange(len(sizes) + 1))
    found = [(s, a, b) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
    return pa.table(
        {
            "batch": pa.array([batches[s] for s, _, _ in found], pa.int64()),
            "n": pa.array([int(b - a) for _, a, b in found], pa.int32()),
            "hashes": pa.array([_pack_sorted(np.sort(hashes[told[a:b]])) for _, a, b in found], pa.binary()),
        }
    )


def _marker(width: int, with_text: bool):
    def mark(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        batch = _Batch(table, width)
        elsewhere = [_unpack_sorted(d.as_py(), n.as_py()) for d, n in zip(answers.column("hashes"), answers.column("n"))]
        covered = batch.covered(np.concatenate(elsewhere) if elsewhere else np.empty(0, U64), width)
        out: dict[str, list] = {name: [] for name in ("n_words", "n_removed", "kept_sha256", "kept_text", "intervals")}
        begin = 0
        for words, end in zip(batch.words, batch.ends.tolist()):
            gone = covered[begin:end]
            removed = int(gone.sum())
            kept = b" ".join(compress(words, (~gone).tolist()) if removed else words)
            edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)) if removed else ()
            out["n_words"].append(len(words))
            out["n_removed"].append(removed)
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["kept_text"].append(kept.decode("utf-8", "replace") if with_text else None)
            out["intervals"].append([{"first": int(a), "last": int(b) - 1} for a, b in zip(edges[::2], edges[1::2])])
            begin = end
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))
        columns = {n: pa.array(v, k) for (n, v), k in zip(out.items(), kinds)}
        return pa.table({"doc_id": pa.array(batch.ids, pa.int64()), **columns})

    return mark


def remove_repeated(
    docs: DataFrame, width: int = 13, batch_bytes: int = BATCH_BYTES, windows_per_range: int = WINDOWS_PER_RANGE, with_text: bool = True
) -> DataFrame:
    """Words of every text without those that repeat a smaller document.

    ``docs`` has ``doc_id`` (bigint) and ``text``; other columns are ignored. A word goes if a
    window of ``width`` consecutive words of its document covers it and the same words also
    start in a document with a smaller id. Returns per row: ``doc_id``, ``n_words``,
    ``n_removed``, ``kept_sha256``, ``kept_text`` (kept words joined by one space; NULL unless
    ``with_text``) and ``intervals``, the maximal runs of removed words (first and last word, from 0).

    A NULL or empty text, or one shorter than a window, has nothing to remove. Rows that share
    an id do not remove each other's words. A NULL id counts as larger than all others. An
    empty table gives an empty result.
    """
    reachable(docs.sparkSession)
    size = size_of(docs)
    batches = max(1, -(-size // batch_bytes))
    ranges = max(1, -(-size // (BYTES_PER_WORD * windows_per_range)))
    # A batch is any set of rows, so rows that share an id need not meet.
    dealt = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        "text",
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)).cast("bigint").alias("batch"),
    ).repartition(batches, "batch")
    sent = dealt.groupBy("batch").applyInArrow(
        _sender(width, ranges), "hash_range int, batch bigint, n int, hashes binary, ids binary"
    )
    answers = sent.repartition(ranges, "hash_range").groupBy("hash_range").applyInArrow(_answer, "batch bigint, n int, hashes binary")
    return (
        dealt.groupBy("batch")
        .cogroup(answers.repartition(batches, "batch").groupBy("batch"))
        .applyInArrow(_marker(width, with_text), OUTPUT)
    )
