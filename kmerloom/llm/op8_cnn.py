"""A byte-level convolutional network in numpy as a quality classifier.

Filters of four bytes slide over the whole document. A chunk is 256 places, chunks overlap by half; each filter's largest
response in a chunk is kept, a document is described by the mean and the largest of these over its chunks, and a dense
layer turns this into one probability.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.llm.common import labelled_sample, pieces_of, table, text_batches, tidied, utf8

WIDTH, FILTERS, HALF = 4, 16, 128
#: The fit takes about so many labelled rows, and none of more bytes than that. Scores cover all rows and whole texts.
FIT_ROWS, FIT_BYTES = 2500, 16_384


class Network:
    def __init__(self, seed: int = 5) -> None:
        draw = np.random.default_rng(seed)
        self.taps = draw.normal(0, 0.25, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.dense = draw.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.shift = np.float32(1.0)

    def ready(self) -> None:
        """Tables of the response to two bytes at once."""
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(-1, FILTERS)
        self.pairs = pair(self.taps[0] + self.bias, self.taps[1]), pair(self.taps[2], self.taps[3])

    @staticmethod
    def halves(n_bytes: np.ndarray) -> np.ndarray:
        """Half chunks of texts and the bytes before them: two at least, so that there is a chunk."""
        return np.maximum(2, -(-(n_bytes + WIDTH - 1) // HALF))

    def lay(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts' bytes, each text in half chunks of its own, padded with zero bytes.

        WIDTH - 1 zero bytes stand before each text, so that no filter reaches from one text's end into the next.
        """
        size = np.diff(at)
        halves = self.halves(size)
        begin = (np.cumsum(halves) - halves) * HALF + WIDTH - 1
        laid = np.zeros(int(halves.sum()) * HALF + WIDTH - 1, np.uint8)
        for b, n, a in zip(begin.tolist(), size.tolist(), at.tolist()):
            laid[b : b + n] = data[a : a + n]
        return laid, halves

    def responses(self, laid: np.ndarray) -> np.ndarray:
        """Of each half chunk and filter the largest response."""
        n = (len(laid) - WIDTH + 1) // HALF
        out = np.empty((n, FILTERS), np.float32)
        step = 512
        for i in range(0, n, step):
            a, z = i * HALF, min(n, i + step) * HALF
            two = laid[a : z + 2].astype(np.int32) * 256 + laid[a + 1 : z + 3]
            r = np.take(self.pairs[0], two[:-2], axis=0)
            r += np.take(self.pairs[1], two[2:], axis=0)
            out[i : i + step] = r.reshape(-1, HALF, FILTERS).max(1)
        return out

    @staticmethod
    def chunks(best: np.ndarray, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which half of each overlapping chunk has the largest response, the response, and each text's first chunk."""
        ends = np.cumsum(halves)
        last = np.zeros(len(best), bool)
        last[ends - 1] = True
        left = np.flatnonzero(~last)
        which = np.where(best[left + 1] > best[left], (left + 1)[:, None], left[:, None])
        return which, np.take_along_axis(best, which, 0), ends - halves - np.arange(len(halves))

    def describe(self, value: np.ndarray, first: np.ndarray, many: np.ndarray) -> np.ndarray:
        active = np.maximum(value, 0)
        return np.concatenate([np.add.reduceat(active, first, axis=0) / many[:, None], np.maximum.reduceat(active, first, axis=0)], axis=1)

    def score(self, texts: pa.Array) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        laid, halves = self.lay(*utf8(texts))
        _, value, first = self.chunks(self.responses(laid), halves)
        x = self.describe(value, first, halves - 1)
        return 1 / (1 + np.exp(-np.clip((x @ self.dense + self.shift).astype(np.float64), -50, 50)))

    def fit(self, texts: list[str], labels: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.02, seed: int = 3) -> Network:
        """Adam on the log loss. The gradient of a maximum goes to the place that it came from."""
        draw = np.random.default_rng(seed)
        names = ("taps", "bias", "dense", "shift")
        mean = {k: np.zeros_like(getattr(self, k)) for k in names}
        power = {k: np.zeros_like(getattr(self, k)) for k in names}
        t = 0
        for epoch in range(epochs):
            order = draw.permutation(len(texts))
            for s in range(0, len(order), batch):
                rows = order[s : s + batch]
                self.ready()
                laid, halves = self.lay(*utf8(pa.array([texts[i] for i in rows], pa.large_string())))
                best = self.responses(laid)
                which, value, first = self.chunks(best, halves)
                many, n = halves - 1, len(rows)
                x = self.describe(value, first, many)
                p = 1 / (1 + np.exp(-np.clip(x @ self.dense + self.shift, -30, 30)))
                d = ((p - labels[rows]) / n).astype(np.float32)
                grad = {"dense": x.T @ d + 1e-4 * self.dense, "shift": d.sum()}
                of = np.repeat(np.arange(n), many)
                top = x[:, FILTERS:]
                g = (d / many)[of, None] * self.dense[None, :FILTERS] + (value >= top[of]) * d[of, None] * self.dense[None, FILTERS:]
                g = g * (value > 0)
                # the place of the largest response within the half chunk, for the half chunks that count
                place = self.places(laid, np.unique(which), best)
                where = place[which, np.arange(FILTERS)[None, :]]
                taps = np.zeros_like(self.taps)
                columns = np.broadcast_to(np.arange(FILTERS), where.shape)
                for o in range(WIDTH):
                    taps[o] = np.bincount((laid[where + o].astype(np.int64) * FILTERS + columns).ravel(), weights=g.ravel(), minlength=256 * FILTERS).reshape(256, FILTERS)
                grad |= {"taps": taps, "bias": g.sum(0)}
                t += 1
                for k in names:
                    mean[k] = 0.9 * mean[k] + 0.1 * grad[k]
                    power[k] = 0.99 * power[k] + 0.01 * grad[k] ** 2
                    step = rate * (1 - epoch / epochs) * (mean[k] / (1 - 0.9**t)) / (np.sqrt(power[k] / (1 - 0.99**t)) + 1e-8)
                    setattr(self, k, (getattr(self, k) - step).astype(np.float32))
        self.ready()
        return self

    def places(self, laid: np.ndarray, used: np.ndarray, best: np.ndarray) -> np.ndarray:
        out = np.zeros((len(best), FILTERS), np.int64)
        two = laid[:-1].astype(np.int32) * 256 + laid[1:]
        for i in range(0, len(used), 512):
            u = used[i : i + 512]
            at = (u[:, None] * HALF + np.arange(HALF)[None, :]).ravel()
            r = np.take(self.pairs[0], two[at], axis=0) + np.take(self.pairs[1], two[at + 2], axis=0)
            out[u] = r.reshape(-1, HALF, FILTERS).argmax(1) + (u * HALF)[:, None]
        return out


def fold(doc_id) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Network | None:
    """A network fitted to about `rows` labelled documents outside fold 0, drawn by hash; None without two classes."""
    sample = labelled_sample(docs, labels.filter(fold("doc_id") != 0), "quality", rows, FIT_BYTES)
    y = sample["quality"].to_numpy(np.float32) if len(sample) else np.zeros(0, np.float32)
    if len(set(y.tolist())) < 2:
        return None
    return Network().fit(sample["text"].tolist(), y)


def scores(model: Network | None, texts: pa.Array) -> np.ndarray:
    return np.full(len(texts), 0.5) if model is None else model.score(texts)


def classify(docs: DataFrame, labels: DataFrame, least: float = 0.3, rows: int = FIT_ROWS) -> DataFrame:
    """Probability of label 1 for each row of docs(doc_id, text): (doc_id, held_out, score, predicted).

    labels(doc_id, quality) are learned only where crc32 of the id's text is no multiple of five. A null or empty text
    gets the score of zero bytes. A row without doc_id is never learned from and not held out. Repeated rows score alike.
    Without labels of both kinds every score is 0.5. An empty table gives no rows. Only the two named columns are read.
    """
    model = train(docs, labels, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces_of(batches):
            s = scores(model, b.column(1))
            held = [x is not None and zlib.crc32(str(x).encode()) % 5 == 0 for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held, pa.bool_()), pa.array(s, pa.float64()), pa.array((s >= least).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return text_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidied(run), "doc_id long, held_out boolean, score double, predicted int")


def keep_classified(docs: DataFrame, labels: DataFrame, least: float = 0.3, rows: int = FIT_ROWS) -> DataFrame:
    """The rows of docs that score `least` or more, unchanged.

    Nulls, blank texts, repeated rows and empty tables are as in `classify`: a null or empty text is scored as zero bytes.
    All columns are carried, whatever their names.
    """
    model = train(docs, labels, rows)
    column = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces_of(batches):
            yield b.filter(pa.array(scores(model, b.column(column)) >= least))

    return text_batches(docs).mapInArrow(tidied(run), docs.schema)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
