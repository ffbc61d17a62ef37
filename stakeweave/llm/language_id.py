"""Language identification by a small convolutional network over UTF-8 bytes.

The network embeds bytes, applies filters of several widths, takes each filter's largest
response over a window of fixed length, and ends in a softmax over the learned labels.
It is trained in numpy on the driver, from at most ``per_label`` windows of each label
(a documented bound); the sample is chosen by a hash of the id and does not depend on
partitioning.  A whole text is predicted: all its windows are scored in batches and their log
probabilities are averaged.

At prediction time embedding and filters are folded into tables of responses to pairs of
bytes, so a filter costs a few table rows a byte.

Defined results: a null text or one without a letter is ``und`` with score 0; a null id
is never learned from and counts as not held out; rows with a null label are predicted
but not learned from; without any labelled row every prediction is ``und``; repeated
rows each give a row; of equal probabilities the label that is first by code point wins; an empty table gives an empty result; a long text is
scored window by window (a worker holds about 25 bytes for each of the text); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stakeweave.llm.kernels import released, text_buffer

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 12
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_BLOCK = 512  # windows scored at once


def held_out(id_col: Column, folds: int = 5) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(False))


class ByteConvNet:
    """Parameters of the network and its training by Adam on cross entropy."""

    def __init__(self, labels: list[str], seed: int = 5):
        draw = np.random.default_rng(seed)
        self.labels = labels
        self.p = {"e": draw.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32)}
        for w in WIDTHS:
            self.p[f"w{w}"] = draw.normal(0, (w * EMBEDDING) ** -0.5, (w, EMBEDDING, FILTERS)).astype(np.float32)
            self.p[f"b{w}"] = np.zeros(FILTERS, np.float32)
        self.p["d"] = draw.normal(0, 0.2, (len(WIDTHS) * FILTERS, len(labels))).astype(np.float32)
        self.p["c"] = np.zeros(len(labels), np.float32)

    def _forward(self, x: np.ndarray):
        e = self.p["e"][x]
        peaks, places = [], []
        for w in WIDTHS:
            n = x.shape[1] - w + 1
            response = sum(e[:, j : j + n] @ self.p[f"w{w}"][j] for j in range(w))
            at = response.argmax(1)
            peaks.append(np.take_along_axis(response, at[:, None], 1)[:, 0] + self.p[f"b{w}"])
            places.append(at)
        pooled = np.concatenate(peaks, 1)
        active = np.maximum(pooled, 0)
        z = active @ self.p["d"] + self.p["c"]
        z -= z.max(1, keepdims=True)
        q = np.exp(z)
        return e, places, pooled, active, q / q.sum(1, keepdims=True)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.01, seed: int = 6) -> None:
        draw = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, steps = 0, epochs * -(-len(x) // batch)
        for _ in range(epochs):
            order = draw.permutation(len(x))
            for lo in range(0, len(x), batch):
                rows = order[lo : lo + batch]
                grad = self._gradient(x[rows], y[rows])
                step += 1
                pace = rate * 0.5 * (1 + np.cos(np.pi * step / (steps + 1)))
                for k, g in grad.items():
                    m[k] += 0.1 * (g - m[k])
                    s[k] += 0.01 * (g * g - s[k])
                    self.p[k] -= pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-6)

    def _gradient(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        e, places, pooled, active, q = self._forward(x)
        dz = q.copy()
        dz[np.arange(len(y)), y] -= 1
        dz /= len(y)
        grad = {"d": active.T @ dz, "c": dz.sum(0)}
        back = (dz @ self.p["d"].T) * (pooled > 0)
        de = np.zeros_like(self.p["e"])
        row = np.arange(len(x))[:, None]
        for i, w in enumerate(WIDTHS):
            g = back[:, i * FILTERS : (i + 1) * FILTERS]
            grad[f"b{w}"] = g.sum(0)
            dw = np.zeros_like(self.p[f"w{w}"])
            for j in range(w):
                at = places[i] + j
                seen = e[row, at]  # batch, filter, embedding
                dw[j] = np.einsum("bf,bfe->ef", g, seen)
                np.add.at(de, x[row, at].ravel(), (g[:, :, None] * self.p[f"w{w}"][j].T[None]).reshape(-1, EMBEDDING))
            grad[f"w{w}"] = dw
        grad["e"] = de
        return grad

    def tables(self) -> dict[int, list[np.ndarray]]:
        """For each width, responses to bytes 2j and 2j + 1 of a place (or to a last single byte)."""
        out = {}
        for w in WIDTHS:
            single = [self.p["e"] @ self.p[f"w{w}"][j] for j in range(w)]
            out[w] = [
                (single[j][:, None] + single[j + 1][None]).reshape(65536, FILTERS) if j + 1 < w else single[j] for j in range(0, w, 2)
            ]
        return out


def window_log_probabilities(net: ByteConvNet, tables: dict[int, list[np.ndarray]], windows: np.ndarray) -> np.ndarray:
    """Log probabilities of each label for each row of ``windows`` (uint8, ``WINDOW`` wide)."""
    out = np.empty((len(windows), len(net.labels)), np.float32)
    for lo in range(0, len(windows), _BLOCK // 16):
        x = windows[lo : lo + _BLOCK // 16].astype(np.int32)
        pairs = x[:, :-1] * 256 + x[:, 1:]
        peaks = []
        for w in WIDTHS:
            n = x.shape[1] - w + 1
            response = None
            for k, table in enumerate(tables[w]):
                part = table.take((pairs if len(table) == 65536 else x)[:, 2 * k : 2 * k + n], axis=0)
                response = part if response is None else np.add(response, part, out=response)
            peaks.append(response.max(1) + net.p[f"b{w}"])
        z = np.maximum(np.concatenate(peaks, 1), 0) @ net.p["d"] + net.p["c"]
        z -= z.max(1, keepdims=True)
        out[lo : lo + len(x)] = z - np.log(np.exp(z).sum(1, keepdims=True))
    return out


def _windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all texts, a last one padded with spaces, and the text of each."""
    size = np.diff(offsets)
    count = -(-size // WINDOW)
    owner = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[:-1][owner] + nth * WINDOW
    at = start[:, None] + np.arange(WINDOW)
    inside = at < offsets[1:][owner][:, None]
    return np.where(inside, data[np.minimum(at, max(len(data) - 1, 0))], 32).astype(np.uint8), owner


def predict(net: ByteConvNet, tables: dict, column: pa.Array) -> tuple[list[str], list[float]]:
    data, offsets = text_buffer(column)
    n = len(offsets) - 1
    total = np.zeros((n, len(net.labels)))
    first = 0
    while first < n:  # a few texts at a time, so that windows stay a bounded copy of their bytes
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + (1 << 20), "right")) - 1)
        windows, owner = _windows(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        np.add.at(total, first + owner, window_log_probabilities(net, tables, windows))
        first = last
    count = np.maximum(-(-np.diff(offsets) // WINDOW), 1)[:, None]
    z = total / count
    z = np.exp(z - z.max(1, keepdims=True))
    z /= z.sum(1, keepdims=True)
    marks = np.concatenate([[0], np.cumsum(_LETTER[data])])
    ascii_letter = marks[offsets[1:]] > marks[offsets[:-1]]
    best = z.argmax(1)
    labels, scores = [], []
    for i in range(n):
        letter = ascii_letter[i] or any(map(str.isalpha, bytes(data[offsets[i] : offsets[i + 1]]).decode("utf-8", "replace")))
        labels.append(net.labels[best[i]] if letter else "und")
        scores.append(float(min(1.0, z[i, best[i]])) if letter else 0.0)
    return labels, scores


def train(docs: DataFrame, per_label: int = 1200, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ByteConvNet | None:
    """A network learned from about ``per_label`` windows of each label, outside the held-out fold."""
    known = docs.where(
        F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) != 0)
    ).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("label"))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each label
    if not counts:
        return None
    wide = 1 << 30
    take = F.coalesce(*[F.when(F.col("label") == k, F.lit(min(wide, wide * per_label // n))) for k, n in counts.items()])
    # By id and text, so that one id on very many rows is drawn as often as any other; equal rows count once.
    draw = F.pmod(F.xxhash64("id", "text", F.lit(9)), F.lit(wide))
    place = F.pmod(F.xxhash64("id", "text", F.lit(10)), F.greatest(F.length("text") - WINDOW, F.lit(1)).cast("long")).cast("int") + 1
    sample = known.where(draw < take).select("id", "label", F.substring(F.col("text"), place, F.lit(WINDOW)).alias("text")).distinct()
    rows = sorted((r["label"], r["id"], r["text"]) for r in sample.collect())  # ``per_label`` windows a label
    if not rows:
        return None
    labels = sorted(counts)
    x = np.full((len(rows), WINDOW), 32, np.uint8)
    for i, (_, _, text) in enumerate(rows):
        raw = np.frombuffer(text.encode()[:WINDOW], np.uint8)
        x[i, : len(raw)] = raw
    net = ByteConvNet(labels)
    net.fit(x, np.array([labels.index(r[0]) for r in rows]))
    return net


def identify_language(
    docs: DataFrame, per_label: int = 1200, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """``id, held_out, lang_pred, score`` of every row of ``docs``."""
    net = train(docs, per_label, id_col, text_col, lang_col)
    # A few tens of kilobytes for the parameters, whatever the input.
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        tables = net.tables() if net else {}
        for batch in batches:
            labels, scores = predict(net, tables, batch.column(1)) if net else (["und"] * batch.num_rows, [0.0] * batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(labels, pa.string()), pa.array(scores)], names=["id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = rows.mapInArrow(released(run), f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double")
    return found.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "lang_pred", "score")
