"""A byte-level convolutional network for document quality, in numpy.

A filter is a table of weights per offset and byte value, so its response at a place is a sum of looked-up rows. Places
``STRIDE`` bytes apart are convolved, rectified and max-pooled over chunks that overlap by half and cover the whole
document. The mean and the maximum of the pooled chunks feed one logistic unit. Training happens on the driver on a
bounded sample of labelled rows; scoring runs in tasks, one batch of documents at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcast.llm.common import held_out, map_keyed, whole

WIDTH, STRIDE, FILTERS = 8, 4, 16
#: Places per half chunk; a chunk is two neighbouring halves, 512 bytes
HALF = 64
#: Half chunks convolved at once
BLOCK = 256
#: Most labelled rows a fit takes, drawn by hash of the id
SAMPLE = 3_000


@dataclass(frozen=True)
class Network:
    tables: np.ndarray  # WIDTH x 256 x FILTERS
    bias: np.ndarray
    weights: np.ndarray  # mean part, then maximum part
    offset: float


def places(text: str) -> np.ndarray:
    """Windows of WIDTH bytes, STRIDE apart, zero-padded to whole half chunks (at least two)."""
    data = text.encode("utf-8", "surrogatepass")
    n = max(2, -(-len(data) // (STRIDE * HALF))) * HALF
    padded = np.zeros(n * STRIDE + WIDTH, np.uint8)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.as_strided(padded, (n, WIDTH), (STRIDE, 1))


def respond(net: Network, windows: np.ndarray) -> np.ndarray:
    out = net.tables[0].take(windows[:, 0], axis=0)
    for j in range(1, WIDTH):
        out += net.tables[j].take(windows[:, j], axis=0)
    return out


def pooled(net: Network, text: str) -> np.ndarray:
    """Chunks x FILTERS: rectified maxima of every overlapping chunk."""
    windows = places(text)
    halves = np.empty((len(windows) // HALF, len(net.bias)), np.float32)
    for at in range(0, len(halves), BLOCK):
        part = windows[at * HALF : (at + BLOCK) * HALF]
        halves[at : at + BLOCK] = respond(net, part).reshape(-1, HALF, len(net.bias)).max(axis=1)
    return np.maximum(np.maximum(halves[1:], halves[:-1]) + net.bias, 0)


def score(net: Network, text: str) -> float:
    chunks = pooled(net, text)
    z = np.concatenate([chunks.mean(axis=0), chunks.max(axis=0)]) @ net.weights + net.offset
    return float(1 / (1 + np.exp(-z)))


def train(texts: list[str], labels: list[int], epochs: int = 12, rate: float = 0.01, seed: int = 7, steps: int = 1000) -> Network:
    """Fit by Adam on documents in random order, in groups of 32: ``epochs`` times each, and ``steps`` groups at least. Without both labels the score is their share."""
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, np.float64)
    share = float(y.mean()) if len(y) else 0.5
    tables = rng.normal(0, 0.1, (WIDTH, 256, FILTERS)).astype(np.float32)
    if len(y) == 0 or share in (0.0, 1.0):
        edge = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
        return Network(tables, np.zeros(FILTERS, np.float32), np.zeros(2 * FILTERS), edge)
    parts = {"tables": tables, "bias": np.zeros(FILTERS, np.float32), "weights": rng.normal(0, 0.1, 2 * FILTERS), "offset": np.array(0.0)}
    first = {k: np.zeros_like(v) for k, v in parts.items()}
    second = {k: np.zeros_like(v) for k, v in parts.items()}
    weight = np.where(y == 1, 1.0, np.sqrt(share / (1 - share)))  # the rarer label counts for more
    epochs = max(epochs, -(-steps // -(-len(texts) // 32)))
    step, rows = 0, np.arange(WIDTH)[None, :, None]
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), 32):
            grad = {k: np.zeros_like(v) for k, v in parts.items()}
            group = order[at : at + 32]
            for i in group:
                net = Network(parts["tables"], parts["bias"], parts["weights"], float(parts["offset"]))
                windows = places(texts[i])
                raw = respond(net, windows).reshape(-1, HALF, FILTERS)
                arg = raw.argmax(axis=1)
                top = np.take_along_axis(raw, arg[:, None], axis=1)[:, 0]
                place = arg + np.arange(len(arg))[:, None] * HALF
                right = top[1:] > top[:-1]
                pre, where = np.where(right, top[1:], top[:-1]), np.where(right, place[1:], place[:-1])
                chunks = np.maximum(pre + net.bias, 0)
                best = chunks.argmax(axis=0)
                feats = np.concatenate([chunks.mean(axis=0), chunks.max(axis=0)])
                err = weight[i] * (1 / (1 + np.exp(-(feats @ net.weights + net.offset))) - y[i])
                grad["weights"] += err * feats
                grad["offset"] += err
                back = np.broadcast_to(err * net.weights[:FILTERS] / len(chunks), chunks.shape).copy()
                back[best, np.arange(FILTERS)] += err * net.weights[FILTERS:]
                back *= chunks > 0
                grad["bias"] += back.sum(axis=0)
                byte = windows[where]  # chunks x FILTERS x WIDTH
                np.add.at(grad["tables"], (rows, byte.transpose(0, 2, 1), np.arange(FILTERS)[None, None, :]), back[:, None, :].astype(np.float32))
            step += 1
            pace = rate * (1 - epoch / epochs)
            for k in parts:
                g = grad[k] / len(group) + 1e-4 * parts[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                move = pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                parts[k] = (parts[k] - move).astype(parts[k].dtype)
    return Network(parts["tables"], parts["bias"], parts["weights"], float(parts["offset"]))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Network:
    """Train on at most ``sample`` labelled rows outside the held-out fold; only these come to the driver.

    Rows without a label, or with a label other than 0 and 1, teach nothing. The sample is the least hashes of the ids,
    so it does not depend on row order; a document with several labels may be drawn with each of them. Rows that repeat
    a drawn id are drawn with it as long as the sample has room.
    """
    marked = labels.filter(F.col(label).isin(0, 1) & ~held_out(key)).select(F.col(key).alias("id"), F.col(label).cast("int").alias("y"))
    drawn = marked.orderBy(F.xxhash64("id"), "id", "y").limit(sample)
    texts = docs.select(F.col(key).alias("id"), whole(text).alias("t"))
    # The sample is bounded by its parameter, so it may be sent to every task that reads documents.
    rows = texts.join(F.broadcast(drawn), "id").orderBy(F.xxhash64("id"), "id", "y", "t").limit(sample)
    found = sorted((r["id"], r["y"], r["t"]) for r in rows.collect())
    return train([t for _, _, t in found], [y for _, y, _ in found])


def scores(docs: DataFrame, net: Network, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score (0 to 1, higher: label 1 likelier) of every row; a missing text scores as an empty one.

    Only the text is looked at. Repeated rows score alike; an empty table gives an empty result.
    """

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"score": np.array([score(net, t) for t in batch["t"]], np.float64)})

    rows = docs.select(F.col(key).alias("id"), whole(text).alias("t"))
    return map_keyed(rows, run, "score double").select(F.col("id").alias(key), "score")


def keep_good(docs: DataFrame, net: Network, least: float, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more; all columns kept, every row judged by itself.

    A missing text scores as an empty one, repeated rows fare alike, keys are not looked at, and an empty table stays empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            yield batch.filter(pa.array([score(net, t or "") >= least for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
