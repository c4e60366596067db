"""Language of texts by a byte convolutional network trained in numpy.

The project's records are in one language, so the interface is general:
``text_id`` and ``text``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.session import ship
from barloom.functions.windows import first_n
from barloom.llm.common import byte_view, slices

#: Bytes of a window, filter widths, filters of each width, and values of a byte's embedding.
WINDOW, WIDTHS, FILTERS, DEPTH = 256, (2, 3, 4), 16, 6

#: Bound of the labelled sample, over all languages; of each sampled text this many windows over its whole length are learnt.
SAMPLE_ROWS, SAMPLE_WINDOWS = 6000, 4

UNKNOWN = "und"


@dataclass
class Network:
    """Embedding, filters (all widths side by side, padded to the widest), softmax layer."""

    labels: list[str]
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def fresh(cls, labels: list[str], seed: int = 0) -> Network:
        rng = np.random.default_rng(seed)
        n = FILTERS * len(WIDTHS)
        embed = rng.normal(0, 0.5, (256, DEPTH)).astype(np.float32)
        embed[0] = 0
        return cls(
            labels, embed, (rng.normal(0, 0.25, (max(WIDTHS) * DEPTH, n)) * _reach()).astype(np.float32),
            np.zeros(n, np.float32), rng.normal(0, 0.1, (n, len(labels))).astype(np.float32),
            np.zeros(len(labels), np.float32),
        )

    def columns(self, windows: np.ndarray) -> np.ndarray:
        """All runs of the widest filter, as rows; windows end in zero bytes."""
        e = self.embed[windows].reshape(len(windows), -1)
        step, run = DEPTH, max(WIDTHS) * DEPTH
        views = np.lib.stride_tricks.sliding_window_view(e, run, axis=1)[:, ::step]
        return np.ascontiguousarray(views)

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cols = self.columns(windows)
        n, places, run = cols.shape
        conv = (cols.reshape(-1, run) @ self.filters).reshape(n, places, -1)
        return cols, conv, np.maximum(conv.max(axis=1) + self.bias, 0)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        parts = []
        for at in range(0, len(windows), 64):  # stays in the processor's cache
            z = self.pooled(windows[at : at + 64])[2] @ self.out + self.out_bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            parts.append(z / z.sum(axis=1, keepdims=True))
        return np.concatenate(parts) if parts else np.zeros((0, len(self.labels)), np.float32)


def _reach() -> np.ndarray:
    """Which rows of the filter matrix each filter may use: its own width."""
    rows = np.arange(max(WIDTHS) * DEPTH)[:, None] // DEPTH
    return (rows < np.repeat(WIDTHS, FILTERS)[None, :]).astype(np.float32)


def windows_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fixed-length windows over whole texts: windows, the text of each, bytes in each."""
    lengths = np.diff(offsets)
    counts = np.maximum(-(-lengths // WINDOW), 1)
    owner = np.repeat(np.arange(len(lengths)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = offsets[:-1][owner] + nth * WINDOW
    size = np.clip(offsets[1:][owner] - begin, 0, WINDOW)
    at = begin[:, None] + np.arange(WINDOW)
    inside = np.arange(WINDOW) < size[:, None]
    out = np.zeros((len(owner), WINDOW), np.uint8)
    out[inside] = data[at[inside]]
    return out, owner, size


def gradients(net: Network, x: np.ndarray, target: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Gradients of the weighted mean cross entropy of windows ``x``, in the order of the network's arrays.

    The embedding of the zero byte, which fills short windows, stays zero.
    """
    n, run = len(x), max(WIDTHS)
    cols, conv, pool = net.pooled(x)
    z = pool @ net.out + net.out_bias
    z = np.exp(z - z.max(axis=1, keepdims=True))
    z /= z.sum(axis=1, keepdims=True)
    z[np.arange(n), target] -= 1
    z *= (weight / n)[:, None]
    d_pool = (z @ net.out.T) * (pool > 0)
    best = conv.argmax(axis=1)
    hit = cols[np.arange(n)[:, None], best]  # text, filter, run
    d_filters = np.einsum("nfr,nf->rf", hit, d_pool) * _reach()
    d_hit = d_pool[:, :, None] * net.filters.T[None]
    d_embed = np.zeros_like(net.embed)
    for j in range(run):
        byte = x[np.arange(n)[:, None], best + j]
        np.add.at(d_embed, byte.ravel(), d_hit[:, :, j * DEPTH : (j + 1) * DEPTH].reshape(-1, DEPTH))
    d_embed[0] = 0
    return [d_embed, d_filters, d_pool.sum(axis=0), pool.T @ z, z.sum(axis=0)]


def fit(texts: list[list[bytes]], langs: list[str], epochs: int = 8, seed: int = 0) -> Network | None:
    """Train on windows of labelled texts, each given as pieces; every language has the same total weight."""
    labels = sorted(set(langs))
    if not labels:
        return None
    net = Network.fresh(labels, seed)
    if len(labels) == 1:
        return net
    rng = np.random.default_rng(seed)
    target = np.searchsorted(labels, langs)
    weight = (len(target) / (len(labels) * np.bincount(target)))[target].astype(np.float32)
    params = [net.embed, net.filters, net.bias, net.out, net.out_bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    t = 0
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 0.0005
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), 64):
            pick = order[lo : lo + 64]
            x = np.zeros((len(pick), WINDOW), np.uint8)
            for k, i in enumerate(pick):
                text = texts[i][int(rng.integers(len(texts[i])))]
                # windows of any length, so that short texts are learnt as well
                size = WINDOW if rng.random() < 0.5 else int(rng.integers(4, WINDOW + 1))
                begin = int(rng.integers(0, max(1, len(text) - size + 1)))
                piece = np.frombuffer(text[begin : begin + size], np.uint8)
                x[k, : len(piece)] = piece
            t += 1
            for p, g, m, v in zip(params, gradients(net, x, target[pick], weight[pick]), first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return net


def _pieces(text: str) -> Column:
    """``SAMPLE_WINDOWS`` windows, one at a hashed place in each equal stretch of the whole text."""
    room = F.greatest(F.length(text) - WINDOW + 1, F.lit(1))

    def place(i: Column) -> Column:
        lo, hi = F.floor(room * i / SAMPLE_WINDOWS), F.floor(room * (i + 1) / SAMPLE_WINDOWS)
        return (lo + F.pmod(F.xxhash64(F.col(text), i), F.greatest(hi - lo, F.lit(1))) + 1).cast("int")

    stretches = F.sequence(F.lit(0), F.lit(SAMPLE_WINDOWS - 1))
    return F.array_distinct(F.transform(stretches, lambda i: F.substr(F.col(text), place(i), F.lit(WINDOW))))


def train(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Network | None:
    """Fit on a sample of at most ``sample_rows`` distinct texts of ``(text_id, text, lang)``.

    Each language gives the same number, or all it has: those whose hash of text
    and language is smallest.  The sample does not depend on ids, so rows that
    share one, have none or repeat a text cannot crowd a language out.  Null
    texts and languages are left out; empty texts teach nothing.  None without
    any row.
    """
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL AND text <> ''").select("lang", "text")
    languages = rows.groupBy("lang").count().count()
    if not languages:
        return None
    quota = max(1, sample_rows // languages)
    drawn = rows.withColumn("draw", F.xxhash64("text", "lang"))
    # tasks pass on their smallest draws only: numbers, no texts
    chosen = first_n(drawn.groupBy("lang", "draw").agg(F.count(F.lit(1)).alias("n")), quota, ["lang"], "draw")
    # at most sample_rows rows
    wanted = F.broadcast(chosen.select("lang", "draw"))
    sample = (
        drawn.join(wanted, ["lang", "draw"])
        .groupBy("lang", "draw").agg(F.min(_pieces("text")).alias("pieces"))
        .orderBy("lang", "draw").collect()
    )
    return fit([[p.encode() for p in r["pieces"]] for r in sample], [r["lang"] for r in sample])


def identify(texts: DataFrame, network: Network | None) -> DataFrame:
    """``text_id, lang, score`` of texts ``(text_id, text)``.

    The windows of the whole text are classified in batches and their
    probabilities averaged by length; the score is the mean for the language
    chosen.  A null text, a text without letters, and any text when no network
    could be trained give ``und`` with score 0.  Repeated rows give equal
    results; an empty table an empty one; other columns are ignored.
    """
    shared = ship(texts.sparkSession).sparkContext.broadcast(network)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        letter = np.zeros(256, bool)
        letter[65:91] = letter[97:123] = True
        for batch in batches:
            data, offsets = byte_view(batch.column("text"))
            for lo, hi in slices(offsets):
                part = offsets[lo : hi + 1]
                langs, scores = [UNKNOWN] * (hi - lo), np.zeros(hi - lo)
                if net is not None:
                    windows, owner, size = windows_of(data, part)
                    share = net.probabilities(windows) * size[:, None]
                    begin = np.searchsorted(owner, np.arange(hi - lo))
                    mean = np.add.reduceat(share, begin, axis=0) / np.maximum(np.diff(part), 1)[:, None]
                    best = mean.argmax(axis=1)
                    for k in range(hi - lo):
                        raw = data[part[k] : part[k + 1]]
                        if letter[raw].any() or any(map(str.isalpha, raw.tobytes().decode("utf-8", "replace"))):
                            langs[k] = net.labels[best[k]]
                            scores[k] = min(1.0, float(mean[k, best[k]]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("text_id").slice(lo, hi - lo), pa.array(langs), pa.array(scores)],
                    ["text_id", "lang", "score"],
                )

    return texts.select("text_id", "text").mapInArrow(apply, "text_id bigint, lang string, score double")
