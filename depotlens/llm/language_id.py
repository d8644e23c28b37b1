"""Language identification with a byte convolutional network.

Filters of several widths slide over the bytes of a window of fixed length; the maximum of each
filter over the window feeds a softmax. The network is trained in numpy on windows of a bounded
sample of labelled texts. For prediction the filters are turned into tables over pairs of
bytes, all windows of a text are classified in blocks, and their probabilities are averaged by the bytes they hold.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depotlens.llm.workers import reachable

WINDOW = 256
#: The tables of the classifier are laid out for these widths.
WIDTHS = (2, 3, 4)
FILTERS = 8
EMBEDDING = 8
SAMPLE_PER_LANGUAGE = 300
WINDOWS_PER_TEXT = 8
EPOCHS = 12
BLOCK = 128
#: Places of the widest filter in a window; narrower filters use the same ones.
POSITIONS = WINDOW - max(WIDTHS) + 1
UNKNOWN = "und"
#: Shorter texts are not judged by the reject class, and fewer labelled texts than this do not calibrate it.
LEAST_BYTES = 64
LEAST_CALIBRATION = 20

OUTPUT = "doc_id bigint, lang_pred string, score double"


@dataclass
class Model:
    languages: list[str]
    embedding: np.ndarray  # (256, EMBEDDING)
    filters: dict[int, np.ndarray]  # width: (width, EMBEDDING, FILTERS)
    bias: np.ndarray  # of all filters
    weights: np.ndarray  # (filters, languages)
    offset: np.ndarray
    #: A text whose probability of the reject class (``und``, if learned) is above this has no language.
    limit: float = 1.0


def _views(x: np.ndarray, width: int) -> np.ndarray:
    """(n, POSITIONS, width * channels) views of neighbours."""
    n, _, channels = x.shape
    shape = (n, POSITIONS, width * channels)
    return np.lib.stride_tricks.as_strided(x, shape, (x.strides[0], x.strides[1], x.strides[2]))


def windows_of(data: bytes, length: int = WINDOW) -> np.ndarray:
    """All bytes in rows of ``length``, the last one filled up with zeros."""
    rows = max(1, -(-len(data) // length))
    return np.frombuffer(data.ljust(rows * length, b"\0"), np.uint8).reshape(rows, length)


def train(texts: list[str], labels: list[str], seed: int = 7) -> Model:
    """Fit by Adam on the cross-entropy of single windows."""
    random = np.random.default_rng(seed)
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((256, EMBEDDING), np.float32), {}, np.zeros(0), np.zeros((0, 0)), np.zeros(0))
    of = {name: i for i, name in enumerate(languages)}
    inputs, targets = [], []
    for text, label in zip(texts, labels):
        rows = windows_of(text.encode())
        chosen = random.permutation(len(rows))[:WINDOWS_PER_TEXT]
        for row in rows[chosen]:
            # Short texts are to be recognised too, so some windows are cut short.
            short = row.copy()
            if random.random() < 0.3:
                short[random.integers(12, WINDOW) :] = 0
            inputs.append(short)
            targets.append(of[label])
    x, y = np.array(inputs), np.array(targets)
    scale = 0.3
    p: dict[str, np.ndarray] = {"e": random.normal(0, scale, (256, EMBEDDING))}
    for w in WIDTHS:
        p[f"f{w}"] = random.normal(0, (2 / (w * EMBEDDING)) ** 0.5, (w * EMBEDDING, FILTERS))
    total = FILTERS * len(WIDTHS)
    p |= {"b": np.zeros(total), "w": random.normal(0, 0.1, (total, len(languages))), "o": np.zeros(len(languages))}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    step = 0
    for _ in range(EPOCHS):
        for chunk in np.array_split(random.permutation(len(x)), max(1, len(x) // 64)):
            xb, yb = x[chunk], y[chunk]
            n = len(chunk)
            emb = p["e"][xb]
            tops, places, seen = [], [], []
            for w in WIDTHS:
                views = _views(emb, w)
                response = views @ p[f"f{w}"]
                at = response.argmax(1)
                places.append(at)
                seen.append(views[np.arange(n)[:, None], at])  # (n, FILTERS, w * EMBEDDING)
                tops.append(np.take_along_axis(response, at[:, None, :], 1)[:, 0])
            h = np.concatenate(tops, 1) + p["b"]
            active = h > 0
            relu = h * active
            z = relu @ p["w"] + p["o"]
            z = np.exp(z - z.max(1, keepdims=True))
            z /= z.sum(1, keepdims=True)
            z[np.arange(n), yb] -= 1
            z /= n
            dh = (z @ p["w"].T) * active
            grad = {"w": relu.T @ z, "o": z.sum(0), "b": dh.sum(0), "e": np.zeros_like(p["e"])}
            for i, w in enumerate(WIDTHS):
                d = dh[:, i * FILTERS : (i + 1) * FILTERS]
                grad[f"f{w}"] = np.einsum("nf,nfc->cf", d, seen[i])
                into = (d[:, :, None] * p[f"f{w}"].T[None]).reshape(n, FILTERS, w, EMBEDDING)
                for k in range(w):
                    np.add.at(grad["e"], xb[np.arange(n)[:, None], places[i] + k], into[:, :, k])
            step += 1
            for k, g in grad.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                p[k] = p[k] - 0.004 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                p[k] = p[k].astype(np.float32)
    filters = {w: p[f"f{w}"].reshape(w, EMBEDDING, FILTERS) for w in WIDTHS}
    return Model(languages, p["e"], filters, p["b"], p["w"], p["o"])


class Classifier:
    """A model with its filters as two tables over pairs of bytes.

    The first holds what the bytes 0 and 1 below each filter add, the second the bytes 2
    and 3, so that a position costs two look-ups for all filters together.
    """

    def __init__(self, model: Model) -> None:
        self.model = model
        at_zero, at_two = [], []
        for w, f in sorted(model.filters.items()):
            single = np.einsum("be,kef->kbf", model.embedding, f).astype(np.float32)
            at_zero.append((single[0][:, None] + single[1][None]).reshape(65536, -1))
            if w == 3:
                at_two.append(np.repeat(single[2], 256, 0))
            elif w == 4:
                at_two.append((single[2][:, None] + single[3][None]).reshape(65536, -1))
        if at_zero:
            self.zero, self.two = (np.ascontiguousarray(np.concatenate(x, 1)) for x in (at_zero, at_two))
            self.buffers = [np.empty((BLOCK, POSITIONS, t.shape[1]), np.float32) for t in (self.zero, self.two)]

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        """For at most ``BLOCK`` windows."""
        pairs = rows[:, :-1].astype(np.intp) * 256 + rows[:, 1:]
        response, late = (b[: len(rows)] for b in self.buffers)
        np.take(self.zero, pairs[:, :POSITIONS], axis=0, out=response, mode="clip")
        np.take(self.two, pairs[:, 2 : 2 + POSITIONS], axis=0, out=late, mode="clip")
        response[:, :, FILTERS:] += late
        h = np.maximum(response.max(1) + self.model.bias, 0)
        z = h @ self.model.weights + self.model.offset
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def classify(self, texts: list[bytes]) -> np.ndarray:
        """(texts, languages): mean probabilities over all windows, weighted by their bytes."""
        rows = [windows_of(t) for t in texts]
        counts = np.array([len(r) for r in rows])
        flat = np.concatenate(rows)
        owner = np.repeat(np.arange(len(texts)), counts)
        weight = np.minimum(WINDOW, np.array([len(t) for t in texts])[owner] - WINDOW * (np.arange(len(flat)) - (np.cumsum(counts) - counts)[owner]))
        result = np.zeros((len(texts), len(self.model.languages)))
        for a in range(0, len(flat), BLOCK):
            found = self.probabilities(flat[a : a + BLOCK]) * weight[a : a + BLOCK, None]
            np.add.at(result, owner[a : a + BLOCK], found)
        return result / result.sum(1, keepdims=True)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def draw(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> tuple[list[str], list[str]]:
    """Texts and labels: about ``per_language`` different whole texts for every value of ``lang``, the documented bound.

    Rows with NULL ``lang`` or text and held-out rows are never learned from. The sample is
    drawn by a hash of the text, so it depends neither on the order of rows nor on how many copies a text has. Training
    takes ``WINDOWS_PER_TEXT`` windows of each text, drawn at random; prediction reads all windows.
    """
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out())
    hashes = usable.select("lang", F.xxhash64("text", F.lit(11)).alias("hash")).distinct()
    # One row for each label, and the model has a class for each.
    share = F.least(F.lit(1.0), F.lit(1.5 * per_language) / F.count("*"))
    shares = hashes.groupBy(F.col("lang").alias("_lang")).agg(share.alias("_share"))
    place = F.xxhash64("text", F.lit(11)).bitwiseAND(F.lit((1 << 30) - 1).cast("bigint"))
    placed = usable.select("lang", "text", place.alias("_place")).join(F.broadcast(shares), F.col("lang") == F.col("_lang"))
    drawn = placed.filter(F.col("_place") < F.col("_share") * F.lit(float(1 << 30)))
    rows = drawn.select("_place", "lang", "text").dropDuplicates(["lang", "text"]).collect()
    texts, labels, taken = [], [], Counter()
    for row in sorted(rows, key=lambda r: (r["lang"], r["_place"], r["text"])):
        if taken[row["lang"]] < per_language:
            taken[row["lang"]] += 1
            texts.append(row["text"])
            labels.append(row["lang"])
    return texts, labels


def fit(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Train on the texts that ``draw`` takes."""
    return train(*draw(docs, per_language))


def without_language(texts: list[str], seed: int = 11) -> list[str]:
    """Texts about as long, without a language: base64, hexadecimal, tables of numbers, line noise, ids, shuffled letters."""
    random = np.random.default_rng(seed)
    found = []
    for i, text in enumerate(texts):
        size = int(min(max(len(text), WINDOW), WINDOW * WINDOWS_PER_TEXT))
        kind = i % 6
        if kind == 0:
            made = base64.encodebytes(random.bytes(size)).decode()
        elif kind == 1:
            made = random.bytes(size).hex()
        elif kind == 2:
            mark = str(random.choice(["\t", ",", ";", " ", " | "]))
            rows = (mark.join(f"{x:.{random.integers(0, 5)}f}" for x in random.normal(0, 10 ** random.integers(1, 6), 6)) for _ in range(size // 24 + 1))
            made = str(random.choice(list("xyzABCk"))) + mark + "\n".join(rows)
        elif kind == 3:
            made = "".join(map(chr, random.integers(32, 127, size)))
        elif kind == 4:
            letters = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
            made = " ".join("".join(random.choice(letters, random.integers(4, 16))) for _ in range(size // 10 + 1))
        else:
            made = "".join(random.permutation(list(text)))
        found.append(made[:size])
    return found


def fit_with_reject(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Like ``fit`` with one class more, ``und``: a text that has no language.

    Its limit is calibrated on a quarter of the labelled texts, which are not learned from then: as they are, cut
    short, mixed in pairs and in capitals, none of them is rejected, and half of what is left to certainty is kept
    as a margin. A short text tells too little of what it is, so texts under ``LEAST_BYTES`` bytes are never rejected, and neither
    is any text if fewer than ``LEAST_CALIBRATION`` labelled ones are there to calibrate with.
    """
    texts, labels = draw(docs, per_language)
    kept = [i for i in range(len(texts)) if i % 4 != 3]
    tried = [texts[i].encode() for i in range(len(texts)) if i % 4 == 3]
    if len(tried) < LEAST_CALIBRATION:
        return train(texts, labels)
    noise = without_language([texts[i] for i in kept])[: max(6, len(kept) // len(set(labels)))]
    model = train([texts[i] for i in kept] + noise, [labels[i] for i in kept] + [UNKNOWN] * len(noise))
    classifier, at = Classifier(model), model.languages.index(UNKNOWN)
    mixed = [a[:400] + b"\n" + b[:400] for a, b in zip(tried, tried[len(tried) // 2 :])]
    forms = tried + [t[:n] for t in tried for n in (LEAST_BYTES, 2 * LEAST_BYTES, WINDOW)] + mixed + [t.upper() for t in tried]
    forms = [t for t in forms if len(t) >= LEAST_BYTES]
    highest = max((float(classifier.classify([t])[0, at]) for t in forms), default=1.0)
    model.limit = (1.0 + highest) / 2
    return model


def _predictor(model: Model):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(model)
        names = model.languages
        for batch in batches:
            for begin in range(0, batch.num_rows, 1024):
                part = batch.slice(begin, 1024)
                lettered = part.column("lettered").to_pylist()
                texts = part.column("text").cast(pa.binary()).to_pylist()
                at = [i for i, ok in enumerate(lettered) if ok and names]
                lang: list[str] = [UNKNOWN] * part.num_rows
                score = [0.0] * part.num_rows
                if at:
                    p = classifier.classify([texts[i] for i in at])
                    if UNKNOWN in names:
                        none = names.index(UNKNOWN)
                        judged = np.array([len(texts[i]) >= LEAST_BYTES for i in at])
                        p[:, none] = np.where(judged & (p[:, none] > model.limit), p[:, none], -1.0)
                        p[p[:, none] > 0] *= np.arange(len(names)) == none
                    for i, best, value in zip(at, p.argmax(1), p.max(1)):
                        lang[i], score[i] = names[best], min(1.0, float(value))
                yield pa.record_batch(
                    {"doc_id": part.column("doc_id"), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64())}
                )

    return predict


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` (0 to 1) from the whole text of every row.

    Only ``text`` decides. A NULL text or one without a letter is ``und`` with score 0, and so
    is every text if the model was trained on nothing. A model with a reject class gives ``und`` with the
    probability of that class, over all windows, if it is above the model's limit. Repeated rows get equal rows, NULL
    ids stay NULL, other columns are ignored; an empty table gives an empty result.
    """
    reachable(docs.sparkSession)
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", lettered.alias("lettered"))
    return rows.mapInArrow(_predictor(model), OUTPUT)
