"""Packing of documents into sequences of limited length, in order.

Documents are range-partitioned by id. A task tokenizes its documents and joins them into runs
of about ``run_tokens``; each run is cut by dynamic programming. Nodes are the places where a cut is cheap (ends
of documents), dearer (ends of sentences) or dearest (every ``grid`` tokens, so that a long
sentence cannot force padding). With f(j) the cost of the tokens up to node j,

    f(i) = penalty(i) + min over j with 0 < i - j <= limit of f(j) + limit - (i - j)

is a minimum of f(j) + j over a sliding window, kept in a monotone queue: each node enters and
leaves it once. A sequence whose length is a power of two needs no padding, which adds one
transition for each power from 256 on.

Words are tokenized once: byte-level BPE never joins over a white-space boundary, so the ids
of a text whose words are separated by single spaces or line feeds are those of its words,
kept in a bounded cache. Any other text is given to the tokenizer whole. A batch of texts is split
into words by Arrow; only its distinct words are looked up in Python, and numpy gathers their ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotlens.llm.workers import reachable

LIMIT = 2048
END_ID = 1
SENTENCE_PENALTY = 8
GRID_PENALTY = 48
GRID = 128
#: Shorter sequences are not worth being saved from padding.
SMALLEST_POWER = 256
RUN_TOKENS = 1 << 19
CACHE_WORDS = 1_400_000
ENDINGS = ".,;:!?|)"
SENTENCE_ENDS = (".", "!", "?", "\n")

OUTPUT = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "sequence_id bigint, offset bigint, ids array<int>"
)


class Encoder:
    """Ids of a text as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = special
        self.spaced: dict[str, bytes] = {}
        self.lined: dict[str, bytes] = {}
        newline = self.whole("\n")
        self.newline_bytes = len(newline)
        # Texts that str.split() would not give back by single spaces and line feeds go to the tokenizer whole.
        other = "".join(f"\\x{{{ord(c):x}}}" for c in map(chr, range(0x110000)) if c.isspace() and c not in " \n")
        self.not_by_words = f"^[ \n]|[ \n]$|[ \n][ \n]|[{other}]"
        vocabulary = self.tokenizer.get_vocab()
        size = max(vocabulary.values()) + 1
        self.ends_sentence = np.zeros(size, bool)
        for token, i in vocabulary.items():
            if token.replace("Ċ", "\n").endswith(SENTENCE_ENDS):
                self.ends_sentence[i] = True
        # Byte-level tokens show one character for each byte; then a token's bytes are its length.
        from tokenizers.pre_tokenizers import ByteLevel

        alphabet = set(ByteLevel.alphabet())
        special_ids = {self.tokenizer.token_to_id(t) for t in special}
        self.token_bytes = None
        if all(set(token) <= alphabet for token, i in vocabulary.items() if i not in special_ids):
            self.token_bytes = np.zeros(size, np.int64)
            for token, i in vocabulary.items():
                self.token_bytes[i] = len(token)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, cache: dict[str, bytes], lead: str, words: set[str]) -> None:
        if len(cache) + len(words) > CACHE_WORDS:
            cache.clear()
        # A letter and the punctuation after it never share a token (the apostrophe may).
        cores: dict[str, tuple[str, str]] = {}
        for word in words:
            if word[-1] in ENDINGS:
                core = word.rstrip(ENDINGS)
                if core and core[-1].isalpha():
                    cores[word] = (core, word[len(core) :])
        tails = {tail for _, tail in cores.values()}
        wanted = [w for w in words if w not in cores]
        wanted += [c for c in {c for c, _ in cores.values()} if c not in cache and c not in words]
        for i in range(0, len(wanted), 256):
            self._learn_block(cache, lead, wanted[i : i + 256])
        ends = {tail: self.whole(tail) for tail in tails}
        for word, (core, tail) in cores.items():
            if core not in cache:
                self._learn_block(cache, lead, [core])
            cache[word] = cache[core] + ends[tail]

    def _learn_block(self, cache: dict[str, bytes], lead: str, words: list[str]) -> None:
        found = self.tokenizer.encode(lead + lead.join(words), add_special_tokens=False)
        ids = np.array(found.ids, "<u4")
        if self.token_bytes is not None and len(lead.encode()) == 1:
            # Starts in bytes: each word begins at its lead, the first token of the word.
            sizes = self.token_bytes[ids]
            starts = np.cumsum(sizes) - sizes
            lengths = np.fromiter(map(len, map(str.encode, words)), np.int64, len(words)) + 1
        else:
            starts = np.fromiter((a for a, _ in found.offsets), np.int64, len(found.offsets))
            lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        cuts = np.searchsorted(starts, np.cumsum(lengths) - lengths).tolist() + [len(ids)]
        for word, a, b in zip(words, cuts, cuts[1:]):
            cache[word] = ids[a:b].tobytes()

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        split: list[list[list[str]] | None] = []
        first: set[str] = set()
        rest: set[str] = set()
        for text in texts:
            lines = None
            if text and not any(s in text for s in self.special):
                lines = [line.split() for line in text.split("\n")]
                if "\n".join(map(" ".join, lines)) != text or not all(lines):
                    lines = None
            split.append(lines)
            if lines:
                first.update(line[0] for line in lines)
                for line in lines:
                    rest.update(line[1:])
        for cache, lead, words in ((self.lined, "\n", first), (self.spaced, " ", rest)):
            new = words - cache.keys()
            if len(cache) + len(new) > CACHE_WORDS:
                cache.clear()
                new = words
            self._learn(cache, lead, new)
        out = []
        for text, lines in zip(texts, split):
            if not text:
                out.append(b"")
            elif lines is None:
                out.append(self.whole(text))
            else:
                get, head = self.spaced.__getitem__, self.lined.__getitem__
                parts = chain.from_iterable(chain((head(line[0]),), map(get, line[1:])) for line in lines)
                out.append(b"".join(parts)[self.newline_bytes :])
        return out


    def encode_batch(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text, as ``encode_all`` gives them, with the per-word work done on distinct words."""
        n = len(texts)
        by_words = pc.fill_null(pc.and_(pc.greater(pc.utf8_length(texts), 0), pc.invert(pc.match_substring_regex(texts, self.not_by_words))), False)
        for token in self.special:
            by_words = pc.and_(by_words, pc.invert(pc.fill_null(pc.match_substring(texts, token), False)))
        mask = by_words.to_numpy(zero_copy_only=False)
        chosen = np.flatnonzero(mask)
        out: list[np.ndarray] = [np.zeros(0, "<u4")] * n
        if len(chosen) < n:
            for i in np.flatnonzero(~mask).tolist():
                text = texts[i].as_py()
                if text:
                    out[i] = np.frombuffer(self.whole(text), "<u4")
        if not len(chosen):
            return out
        fast = texts.take(pa.array(chosen))
        # Lines, then words; the first word of a line follows a line feed, any other one a space.
        lines = pc.split_pattern(fast, "\n")
        split = pc.split_pattern(lines.flatten(), " ")
        words = split.flatten()
        starts = split.offsets.to_numpy()
        starts = starts - starts[0]
        bounds = starts[lines.offsets.to_numpy() - lines.offsets.to_numpy()[0]]
        lined = np.zeros(len(words), bool)
        lined[starts[:-1]] = True
        codes = np.empty(len(words), np.int64)
        chunks, sizes, base = [], [], 0
        for cache, lead, mask in ((self.lined, "\n", lined), (self.spaced, " ", ~lined)):
            part = words.filter(pa.array(mask))
            distinct = pc.unique(part)
            codes[mask] = pc.index_in(part, value_set=distinct).to_numpy() + base
            known = distinct.to_pylist()
            found = list(map(cache.get, known))
            new = {w for w, b in zip(known, found) if b is None}
            if new:
                if len(cache) + len(new) > CACHE_WORDS:
                    cache.clear()
                    new = set(known)
                self._learn(cache, lead, new)
                found = list(map(cache.__getitem__, known))
            chunks += found
            sizes += map(len, found)
            base += len(known)
        flat = np.frombuffer(b"".join(chunks), "<u4")
        size = np.array(sizes, np.int64) >> 2
        begin = np.cumsum(size) - size
        lengths = size[codes]
        ends = np.cumsum(lengths)
        ids = flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin[codes] - (ends - lengths), lengths)]
        at = np.concatenate(([0], ends))[bounds].tolist()
        skip = self.newline_bytes >> 2
        for i, a, b in zip(chosen.tolist(), at, at[1:]):
            out[i] = ids[a + skip : b]
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def choose_cuts(nodes: list[int], penalties: list[int], limit: int = LIMIT) -> list[int]:
    """The cheapest ends of sequences: some of ``nodes`` (ascending, the last one included).

    ``nodes`` are token counts after which a cut is possible, with its penalty; neighbours
    are at most ``limit`` apart, counted from 0.
    """
    powers = [1 << k for k in range(limit.bit_length()) if SMALLEST_POWER <= 1 << k < limit]
    place = [0, *nodes]
    n = len(place)
    at = np.full(place[-1] + 1, -1, np.int64)
    at[place] = np.arange(n)
    # For each node, the node exactly a power before it (-1: none), in order of the powers.
    ahead = np.array(place[1:], np.int64)
    earlier = [np.where(ahead >= power, at[np.maximum(ahead - power, 0)], -1).tolist() for power in powers]
    cost = [0] * n
    back = [0] * n
    # A monotone queue of nodes with rising f(j) + j, in slots head..top.
    q_node, q_place, q_key = [0] * n, [0] * n, [0] * n
    head = top = 0
    for i, p, penalty, js in zip(range(1, n), nodes, penalties, zip(*earlier) if earlier else ((),) * (n - 1)):
        low = p - limit
        while q_place[head] < low:
            head += 1
        best, source = q_key[head] + limit - p, q_node[head]
        if best:
            for j in js:
                if j >= 0 and cost[j] < best:
                    best, source = cost[j], j
        best += penalty
        cost[i], back[i] = best, source
        key = best + p
        while top >= head and q_key[top] >= key:
            top -= 1
        top += 1
        q_node[top], q_place[top], q_key[top] = i, p, key
    cuts = []
    i = len(place) - 1
    while i:
        cuts.append(place[i])
        i = back[i]
    return cuts[::-1]


def _pack_run(ids: list[tuple[int | None, np.ndarray]], ends_sentence: np.ndarray, limit: int) -> Iterator[tuple]:
    """Pieces of a run: (doc_id, start, ids, doc_tokens, sequence from 0, offset)."""
    flat = np.concatenate([x for _, x in ids])
    total = len(flat)
    penalty = np.full(total + 1, -1, np.int32)
    penalty[GRID::GRID] = GRID_PENALTY
    inside = flat < len(ends_sentence)
    penalty[1:][inside & ends_sentence[np.where(inside, flat, 0)]] = SENTENCE_PENALTY
    doc_ends = np.cumsum([len(x) for _, x in ids])
    penalty[doc_ends] = 0
    nodes = np.flatnonzero(penalty[1:] >= 0) + 1
    cuts = choose_cuts(nodes.tolist(), penalty[nodes].tolist(), limit)
    begin, k, cut_at = 0, 0, 0
    for (doc_id, own), end in zip(ids, doc_ends.tolist()):
        position = begin
        while position < end:
            while cuts[k] <= position:
                cut_at, k = cuts[k], k + 1
            stop = min(end, cuts[k])
            yield doc_id, position - begin, own[position - begin : stop - begin], len(own), k, position - cut_at
            position = stop
        begin = end


def _packer(path: str, limit: int, run_tokens: int, with_ids: bool):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        first_sequence = TaskContext.get().partitionId() << 36
        held: list[tuple[int | None, np.ndarray]] = []
        tokens = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, tokens, first_sequence
            pieces = list(_pack_run(held, coder.ends_sentence, limit))
            batch = pa.record_batch(
                {
                    "doc_id": pa.array([p[0] for p in pieces], pa.int64()),
                    "start": pa.array([p[1] for p in pieces], pa.int64()),
                    "length": pa.array([len(p[2]) for p in pieces], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(p[2]) for p in pieces], pa.int64()),
                    "doc_tokens": pa.array([p[3] for p in pieces], pa.int64()),
                    "sequence_id": pa.array([first_sequence + p[4] for p in pieces], pa.int64()),
                    "offset": pa.array([p[5] for p in pieces], pa.int64()),
                    "ids": pa.array([p[2].astype(np.int32) if with_ids else None for p in pieces], pa.list_(pa.int32())),
                }
            )
            first_sequence += pieces[-1][4] + 1
            held, tokens = [], 0
            return batch

        end = np.array([END_ID], "<u4")
        for batch in batches:
            for begin in range(0, batch.num_rows, 2048):
                part = batch.slice(begin, 2048)
                for doc_id, data in zip(part.column("doc_id").to_pylist(), coder.encode_batch(part.column("text"))):
                    held.append((doc_id, np.concatenate((data, end))))
                    tokens += len(held[-1][1])
                    if tokens >= run_tokens:
                        yield flush()
        if held:
            yield flush()

    return pack


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    limit: int = LIMIT,
    run_tokens: int = RUN_TOKENS,
    with_ids: bool = True,
) -> DataFrame:
    """Pieces of all documents in sequences of at most ``limit`` tokens, in order of ``doc_id``.

    ``docs`` has ``doc_id`` (bigint) and ``text``; other columns are ignored. A document is
    its ids and the end id 1. Returns one row per piece: ``doc_id``, ``start`` (ids of the
    document before it), ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset`` (in the
    sequence, gapless from 0) and ``ids`` (NULL unless ``with_ids``). Sequence ids are unique and
    rise with ``doc_id``, with gaps. A sequence of a power of two needs no padding, others are meant to be padded to ``limit``.

    A NULL or empty text is the end id alone. Rows that share an id are packed one after the
    other, NULL ids first. An empty table gives an empty result.
    """
    reachable(docs.sparkSession)
    # Documents stream through a task run by run, so the size of a partition is the session's choice.
    ordered = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return ordered.mapInArrow(_packer(tokenizer_path, limit, run_tokens, with_ids), OUTPUT)
