"""Language identification by a convolutional network over bytes.

Filters of several widths slide over one-hot bytes, each filter keeps its maximum over a window of
fixed length, and a softmax layer reads those maxima.  Training is plain numpy on the driver, on
a bounded sample of labelled rows (``SAMPLE_ROWS`` per label, whatever the size of the table, with up
to ``SAMPLE_WINDOWS`` windows each).  Prediction covers every window of every text; a text's score is
the mean of its windows' probabilities.

A filter's response is a sum of one table entry per byte, so pairs of bytes are added up once per
model and a response costs one or two table rows instead of products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmill.llm.words import slices

WIDTHS = (2, 3, 4)
FILTERS = 16
WINDOW = 192
SAMPLE_ROWS = 400
SAMPLE_WINDOWS = 4
UNKNOWN = "und"
STEPS = 600
SLICE = 1 << 19  # bytes of text whose windows are laid out at a time
_BATCH = 512


class ByteNet:
    """Multi-width byte filters, maximum over the window, softmax over labels."""

    def __init__(self, labels: list[str], widths=WIDTHS, filters: int = FILTERS, window: int = WINDOW, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels, self.widths, self.filters, self.window = labels, widths, filters, window
        self.taps = [rng.normal(0, 0.3, (w, 256, filters)).astype(np.float32) for w in widths]
        total = filters * len(widths)
        self.weight = rng.normal(0, 0.1, (total, len(labels))).astype(np.float32)
        self.bias = np.zeros(len(labels), np.float32)

    def state(self) -> dict:
        """What a trained net consists of, as plain values: those can be broadcast."""
        names = ("labels", "widths", "filters", "window", "taps", "weight", "bias")
        return {n: getattr(self, n) for n in names}

    @classmethod
    def of(cls, state: dict) -> ByteNet:
        net = cls.__new__(cls)
        net.__dict__.update(state)
        net.prepare()
        return net

    def prepare(self) -> None:
        """Tables over byte pairs, made once per trained model."""
        self.pairs = []
        for taps in self.taps:
            tables = [(taps[i][:, None, :] + taps[i + 1][None, :, :]).reshape(-1, self.filters) for i in range(0, len(taps) - 1, 2)]
            self.pairs.append((tables, taps[-1] if len(taps) % 2 else None))

    def _responses(self, rows: np.ndarray) -> list[np.ndarray]:
        codes = rows[:, :-1].astype(np.int32) * 256 + rows[:, 1:]
        out = []
        for width, (tables, last) in zip(self.widths, self.pairs, strict=True):
            n = rows.shape[1] - width + 1
            total = tables[0][codes[:, :n]]
            for i, table in enumerate(tables[1:], 1):
                total += table[codes[:, 2 * i : 2 * i + n]]
            if last is not None:
                total += last[rows[:, width - 1 : width - 1 + n]]
            out.append(total)
        return out

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        """(windows, labels) for rows of ``window`` bytes."""
        parts = []
        for lo in range(0, len(rows), _BATCH):
            peaks = np.concatenate([r.max(axis=1) for r in self._responses(rows[lo : lo + _BATCH])], axis=1)
            parts.append(_softmax(np.maximum(peaks, 0) @ self.weight + self.bias))
        return np.concatenate(parts) if parts else np.zeros((0, len(self.labels)), np.float32)

    def train(self, rows: np.ndarray, target: np.ndarray, epochs: int = 8, rate: float = 0.02, batch: int = 64, seed: int = 3) -> None:
        """Adam on the cross entropy; the gradient reaches a filter through its maximum only.

        Small samples are gone through more often, for ``STEPS`` steps at least.
        """
        epochs = max(epochs, -(-STEPS * batch // max(1, len(rows))))
        rng = np.random.default_rng(seed)
        params = [*self.taps, self.weight, self.bias]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for lo in range(0, len(rows), batch):
                pick = order[lo : lo + batch]
                x, y = rows[pick], target[pick]
                self.prepare()
                responses = self._responses(x)
                spots = [r.argmax(axis=1) for r in responses]
                peaks = np.concatenate([r.max(axis=1) for r in responses], axis=1)
                hidden = np.maximum(peaks, 0)
                error = _softmax(hidden @ self.weight + self.bias)
                error[np.arange(len(y)), y] -= 1
                error /= len(y)
                back = (error @ self.weight.T) * (peaks > 0)
                grads = []
                for k, width in enumerate(self.widths):
                    grad = np.zeros_like(self.taps[k])
                    part = back[:, k * self.filters : (k + 1) * self.filters]
                    for i in range(width):
                        seen = np.take_along_axis(x, spots[k] + i, axis=1)
                        np.add.at(grad[i], (seen, np.arange(self.filters)[None, :]), part)
                    grads.append(grad)
                grads += [hidden.T @ error, error.sum(axis=0)]
                step += 1
                for p, g, a, b in zip(params, grads, first, second, strict=True):
                    a *= 0.9
                    a += 0.1 * g
                    b *= 0.999
                    b += 0.001 * g * g
                    p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
        self.prepare()


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def windows_of(data: np.ndarray, bounds: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of ``window`` bytes, windows per text): texts are cut one window after the other, the
    last one ends with the text; shorter texts are filled with zeros."""
    size = np.diff(bounds)
    count = -(-size // window)
    text = np.repeat(np.arange(len(size)), count)
    inner = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    start = np.minimum(inner * window, np.maximum(size[text] - window, 0))
    at = start[:, None] + np.arange(window)
    ok = at < size[text][:, None]
    padded = np.concatenate([data, np.zeros(1, np.uint8)])
    return np.where(ok, padded[np.where(ok, at + bounds[text][:, None], len(data))], 0).astype(np.uint8), count


def learns(id_col: str = "doc_id") -> Column:
    """Rows to learn from: three quarters of the ids (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 != 2


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang",
        sample_rows: int = SAMPLE_ROWS, sample_windows: int = SAMPLE_WINDOWS) -> ByteNet | None:
    """A net from the texts of ``learns`` rows with a label; None if there is no such row.

    The sample of each label is its ``sample_rows`` rows with the smallest hash of the text.
    """
    labelled = docs.where(learns(id_col) & F.col(label_col).isNotNull() & (F.length(text_col) > 0))
    rows = labelled.select(F.col(label_col).alias("label"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    wanted = rows.select("label", "h").distinct()
    wanted = wanted.withColumn("nth", F.row_number().over(Window.partitionBy("label").orderBy("h"))).where(F.col("nth") <= sample_rows)
    # Only the sampled windows of a text travel.
    piece = F.expr(f"transform(sequence(0, {sample_windows - 1}), i -> substring(text, 1 + cast(i * greatest(length(text) - {WINDOW}, 0) / {max(1, sample_windows - 1)} as int), {WINDOW}))")
    sample = rows.join(F.broadcast(wanted.select("label", "h")), ["label", "h"]).dropDuplicates(["label", "h"])
    found = sample.select("label", "h", F.explode(F.array_distinct(piece)).alias("piece")).orderBy("label", "h", "piece").toPandas()
    if not len(found):
        return None
    labels = sorted(found["label"].unique())
    raw = [p.encode()[:WINDOW] for p in found["piece"]]
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    rows, count = windows_of(np.frombuffer(b"".join(raw), np.uint8), bounds, WINDOW)
    net = ByteNet(labels)
    net.train(rows, np.repeat(found["label"].map({x: i for i, x in enumerate(labels)}).to_numpy(), count))
    return net


def predict(docs: DataFrame, net: ByteNet | None, text_col: str = "text", name: str = "language") -> DataFrame:
    """``docs`` with a struct ``name`` of (lang_pred, score); a column of that name is replaced.

    lang_pred is ``und`` with score 0 if the text is null or has no letter, or if nothing could be learned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net.state() if net else None)

    # Arrow columns as they come: a pandas column would hold each batch three times over.
    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def judge(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = ByteNet.of(shared.value) if shared.value else None
        for column in texts:
            names, scores = [], []
            batch = pa.RecordBatch.from_arrays([column], ["text"])
            for part in slices(batch, "text", SLICE):
                values = part.column("text").to_pylist()
                probs = _text_probabilities(model, values) if model else None
                for r, text in enumerate(values):
                    if model is None or text is None or not any(map(str.isalpha, text)):
                        names.append(UNKNOWN)
                        scores.append(0.0)
                    else:
                        best = int(probs[r].argmax())
                        names.append(model.labels[best])
                        scores.append(min(1.0, float(probs[r][best])))
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return docs.withColumn(name, judge(F.col(text_col)))


def _text_probabilities(net: ByteNet, texts: list[str | None]) -> np.ndarray:
    raw = [(t or "").encode() for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    rows, count = windows_of(np.frombuffer(b"".join(raw), np.uint8), bounds, net.window)
    probs = net.probabilities(rows)
    out = np.full((len(texts), len(net.labels)), 0.0)
    some = np.flatnonzero(count)
    if len(some):
        first = (np.cumsum(count) - count)[some]
        out[some] = np.add.reduceat(probs, first, axis=0) / count[some][:, None]
    return out
