"""SentencePiece encoding by suffix-array matching, and decoding.

The distinct new words of a batch are joined into one text and indexed by a suffix array. All
pieces of the vocabulary are binary-searched in it at once, character by character; the range
of a piece lists its occurrences, each an edge from its start to its end. Edges are sorted by end and
relaxed from left to right, those that end at the same place of their words for all words at once.

The vocabulary is a byte-pair one, so the path wanted is the one its merges lead to. That
path has an exact local rule: the encoding of a prefix ends with piece t iff t fits after the
last piece of the encoding before it, which holds iff merging the two pieces' text gives just these two. Hence
each position keeps one last piece, and relaxing an edge asks whether it fits (answers are remembered).
A character that is no piece is an edge of its bytes.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotlens.llm.workers import reachable

SPACE = "▁"
BATCH_ROWS = 4096
CACHE_WORDS = 600_000
CACHE_FITS = 2_000_000
#: Characters of new words that are indexed at a time, about; it bounds memory.
LEARNED_CHARACTERS = 1 << 20
#: Longer words are relaxed one by one.
LONG_WORD = 200
#: A word is spaces and what follows them; no piece reaches into the next word.
WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")

OUTPUT = "doc_id bigint, ids array<int>, n_ids bigint, ids_crc32 bigint, decoded string, decoded_sha256 string, round_trip boolean"


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Starts of suffixes ordered by their first ``depth`` codes (at least), by prefix doubling."""
    n = len(codes)
    rank = codes.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    width = 1
    while width < min(depth, n):
        shifted = np.zeros(n, np.int64)
        shifted[: n - width] = rank[width:] + 1
        key = rank * (n + 0x110002) + shifted
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
        width *= 2
    return order


class _Fits(dict):
    """Answers for pairs of piece numbers, worked out when first asked for."""

    def __init__(self, codec: Codec) -> None:
        super().__init__()
        self.codec = codec

    def __missing__(self, pair: int) -> bool:
        left, right = map(self.codec.text_of_number, divmod(pair, self.codec.stride))
        self[pair] = known = self.codec.merged(left + right) == [left, right]
        return known


class Codec:
    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        self.pieces = [self.model.id_to_piece(i) for i in range(size)]
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.model.is_byte(i)}
        plain = [
            i for i in range(size) if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i))
        ]
        self.ids = {self.pieces[i]: i for i in plain}
        self.score = {self.pieces[i]: self.model.get_score(i) for i in plain}
        self.depth = max(map(len, self.ids))
        ordered = sorted(self.ids, key=lambda p: (len(p), p))
        self.lengths = np.array([len(p) for p in ordered])
        self.matrix = np.zeros((len(ordered), self.depth), np.int64)
        for row, piece in enumerate(ordered):
            self.matrix[row, : len(piece)] = [ord(c) for c in piece]
        self.ordered = ordered
        self.text_of = [p.replace(SPACE, " ").encode() for p in self.pieces]
        for value, i in self.bytes.items():
            self.text_of[i] = bytes([value])
        self.words: dict[str, bytes] = {}
        #: Pieces of two or more characters that the merges build from their characters at all.
        self.built = np.array([len(p) > 1 and self.merged(p) == [p] for p in ordered])
        #: Number of a piece is its row, that of a character that is no piece comes after all rows.
        self.id_of = np.array([self.ids[p] for p in ordered], np.int64)
        self.stride = len(ordered) + 0x110000
        single = [(ord(p), row) for row, p in enumerate(ordered) if len(p) == 1]
        self.single_codes, self.single_rows = (np.array(x, np.int64) for x in zip(*sorted(single)))
        self.fits = _Fits(self)

    def merged(self, text: str) -> list[str]:
        """The merges themselves: the best-scored neighbours first, the leftmost of equals."""
        parts = list(text)
        score = self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                value = score.get(parts[i] + parts[i + 1])
                if value is not None and (best is None or value > best):
                    best, at = value, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def text_of_number(self, number: int) -> str:
        return self.ordered[number] if number < len(self.ordered) else chr(number - len(self.ordered))

    def fitting(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging the text of two pieces gives just these two."""
        if len(self.fits) > CACHE_FITS:
            self.fits.clear()
        pairs, at = np.unique(left * self.stride + right, return_inverse=True)
        return np.fromiter(map(self.fits.__getitem__, pairs.tolist()), bool, len(pairs))[at]

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, piece number) of every occurrence of a piece of two or more characters, by end."""
        order = suffix_array(codes, self.depth)
        n = len(codes)
        padded = np.concatenate([codes, np.full(self.depth, -1)])
        rows = np.arange(len(self.ordered))
        low, high = np.zeros(len(rows), np.int64), np.full(len(rows), n, np.int64)
        for d in range(self.depth):
            active = np.flatnonzero((self.lengths > d) & (low < high))
            wanted = self.matrix[active, d]
            for bound, past in ((low, 0), (high, 1)):
                a, b = low[active].copy(), high[active].copy()
                if past:
                    a = first
                while True:
                    open_ = a < b
                    if not open_.any():
                        break
                    middle = (a + b) // 2
                    code = padded[order[np.minimum(middle, n - 1)] + d]
                    right = open_ & (code < wanted + past)
                    a = np.where(right, middle + 1, a)
                    b = np.where(open_ & ~right, middle, b)
                if not past:
                    first = a
                else:
                    low[active], high[active] = first, a
        counts = np.where(self.built, high - low, 0)
        piece = np.repeat(rows, counts)
        nth = np.arange(len(piece)) - np.repeat(np.cumsum(counts) - counts, counts)
        start = order[low[piece] + nth]
        end = start + self.lengths[piece]
        by_end = np.lexsort((start, end))
        return start[by_end], piece[by_end]

    def _last_pieces(self, codes: np.ndarray, begins: np.ndarray, sizes: np.ndarray, start: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Number of the last piece of the encoding of every prefix of every word, at the prefix's last character."""
        at = np.minimum(np.searchsorted(self.single_codes, codes), len(self.single_codes) - 1)
        last = np.where(self.single_codes[at] == codes, self.single_rows[at], len(self.ordered) + codes)
        word = np.searchsorted(begins, start, side="right") - 1
        end = start + self.lengths[piece]
        short = sizes[word] <= LONG_WORD
        place = (end - begins[word])[short]
        order = np.lexsort((start[short], word[short], place))
        word, place, start, piece, end = word[short][order], place[order], start[short][order], piece[short][order], end[short][order]
        cuts = np.flatnonzero(np.diff(place, prepend=-1, append=-1))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            # The longest piece first; the next one only where it does not fit.
            new = np.diff(word[a:b], prepend=-1) != 0
            group = np.cumsum(new) - 1
            first = np.flatnonzero(new)
            turn = first.copy()
            stop = np.append(first[1:], b - a)
            while len(turn):
                edge = a + turn
                s = start[edge]
                fits = s == begins[word[edge]]
                inner = np.flatnonzero(~fits)
                if len(inner):
                    fits[inner] = self.fitting(last[s[inner] - 1], piece[edge[inner]])
                last[end[edge[fits]] - 1] = piece[edge[fits]]
                turn = turn[~fits] + 1
                turn = turn[turn < stop[group[turn - 1]]]
        return last

    def _relax_alone(self, begin: int, size: int, start: list[int], piece: list[int], last: np.ndarray) -> None:
        """The same for one long word; its edges by end, then start."""
        settled = -1
        for s, number in zip(start, piece):
            end = s + int(self.lengths[number])
            if end != settled and (s == begin or self.fits[int(last[s - 1]) * self.stride + number]):
                last[end - 1] = number
                settled = end

    def _learn(self, words: list[str]) -> None:
        text = "\0".join(words)
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
        sizes = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(sizes + 1) - 1
        begins = ends - sizes
        start, piece = self.edges(codes)
        last = self._last_pieces(codes, begins, sizes, start, piece)
        word = np.searchsorted(begins, start, side="right") - 1
        for long in np.flatnonzero(sizes > LONG_WORD).tolist():
            own = word == long
            self._relax_alone(int(begins[long]), int(sizes[long]), start[own].tolist(), piece[own].tolist(), last)
        # Back from the end of each word.
        length = np.append(self.lengths, 1)[np.minimum(last, len(self.ordered))]
        on = np.zeros(len(codes), bool)
        at, low = ends.copy(), begins
        while len(at):
            on[at - 1] = True
            at = at - length[at - 1]
            left = at > low
            at, low = at[left], low[left]
        chosen = np.flatnonzero(on)
        numbers = last[chosen]
        unknown = numbers >= len(self.ordered)
        ids = np.where(unknown, 0, self.id_of[np.minimum(numbers, len(self.ordered) - 1)])
        counts = np.ones(len(ids), np.int64)
        spelled = {}
        for number in np.unique(numbers[unknown]).tolist():
            spelled[number] = [self.bytes[b] for b in self.text_of_number(number).encode("utf-8", "surrogatepass")]
        if spelled:
            counts[unknown] = [len(spelled[x]) for x in numbers[unknown].tolist()]
            flat = np.repeat(ids, counts)
            flat[np.repeat(unknown, counts)] = [i for x in numbers[unknown].tolist() for i in spelled[x]]
        else:
            flat = ids
        before = np.concatenate([[0], np.cumsum(counts)])
        bounds = before[np.searchsorted(chosen, np.append(begins, len(codes)))] * 4
        data = flat.astype("<u4").tobytes()
        bounds = bounds.tolist()
        self.words.update(zip(words, map(data.__getitem__, map(slice, bounds[:-1], bounds[1:]))))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian 32-bit numbers."""
        # The model's own normalisation: signs for spaces, one more in front.
        split = [WORD.findall(SPACE + text.replace(" ", SPACE)) if text else [] for text in texts]
        everything = set().union(*split)
        new = everything - self.words.keys()
        if len(self.words) + len(new) > CACHE_WORDS:
            self.words.clear()
            new = everything
        words = sorted(new)
        parts = np.cumsum([len(w) + 1 for w in words]) // LEARNED_CHARACTERS
        for part in np.unique(parts).tolist():
            low, high = np.searchsorted(parts, (part, part + 1))
            self._learn(words[low:high])
        get = self.words.__getitem__
        return [b"".join(map(get, words)) for words in split]

    def decode(self, ids: bytes) -> str:
        """Pieces and bytes joined, without the space in front."""
        numbers = np.frombuffer(ids, "<u4").tolist()
        text = b"".join(map(self.text_of.__getitem__, numbers)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _coder(path: str, with_values: bool):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = codec(path)
        for batch in batches:
            for begin in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(begin, BATCH_ROWS)
                texts = [t or "" for t in part.column("text").to_pylist()]
                ids = model.encode_all(texts)
                decoded = [model.decode(x) for x in ids]
                yield pa.record_batch(
                    {
                        "doc_id": part.column("doc_id"),
                        "ids": pa.array([np.frombuffer(x, "<i4") if with_values else None for x in ids], pa.list_(pa.int32())),
                        "n_ids": pa.array([len(x) // 4 for x in ids], pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                        "decoded": pa.array(decoded if with_values else [None] * len(ids), pa.string()),
                        "decoded_sha256": pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded], pa.string()),
                        "round_trip": pa.array([a == b for a, b in zip(texts, decoded)], pa.bool_()),
                    }
                )

    return code


def encode_and_decode(docs: DataFrame, model_path: str, with_values: bool = True) -> DataFrame:
    """Ids of every whole text, and the text decoded from them again.

    Returns per row: ``doc_id``, ``ids``, ``n_ids``, ``ids_crc32`` (of little-endian 32-bit ids), ``decoded``,
    ``decoded_sha256`` and ``round_trip`` (the decoded text is the text). ``ids`` and
    ``decoded`` are NULL unless ``with_values``. A NULL text is empty and has no ids. A text with the sign the
    model writes for a space decodes with a space in its place, so it does not come back.
    Repeated rows get equal rows, NULL ids stay NULL, other columns are ignored, an empty table
    gives an empty result.
    """
    reachable(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_coder(model_path, with_values), OUTPUT)
