"""Language identification by a byte convolutional network, trained here in numpy.

A window of ``WINDOW`` bytes is embedded byte by byte; filters of several widths
slide over it, the largest response of each filter feeds a softmax over the
languages. Every text is cut into consecutive windows, all of them are read in
batches, and the log-probabilities are averaged over the windows with weights by
length. Since a convolution of an embedding is a sum of one table row per byte,
the filters of all widths run as one matrix product over unfolded embeddings.

Training (``fit``) learns from at most ``MAX_ROWS`` labelled rows per label, taken
in order of a digest of key and text (a bound, not a share), and at most ``WINDOWS_A_ROW`` windows of each,
spread over the whole text; these bounds keep the sample small enough for the
driver, whatever the corpus. Only text and label are used. Rows without label or
letters are skipped.

Prediction (``predict``): ``und`` with score 0 for a text that is null or has no
letter, else the language of highest average log-probability and its normalised
probability. Texts are read whole. Repeated rows get equal results, ties go to
the language first in alphabetical order, an empty table gives an empty table.
Columns pass unchanged, the added ones replace columns of the same name. Without
any labelled row ``fit`` raises ``ValueError``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .arrow import output_schema, replace_column, slices, text_bytes
from .ordered import free_names

WINDOW = 256
WIDTHS = (2, 3, 4, 5)
FILTERS = 8
EMBEDDING = 8
MAX_ROWS = 1_200
WINDOWS_A_ROW = 3
EPOCHS = 6
BATCH = 64
RATE = 0.01
SEED = 11
BATCH_WINDOWS = 64
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    labels: tuple[str, ...]
    embedding: np.ndarray  # 257 x EMBEDDING; the last row pads and is zero
    filters: np.ndarray  # (longest width * EMBEDDING) x filters, zero beyond a filter's width
    bias: np.ndarray
    weights: np.ndarray
    offset: np.ndarray


def windows(data: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Consecutive windows of the bytes, padded with 256, and their lengths.

    A last piece shorter than half a window joins nothing: it is a window of its own.
    """
    n = -(-len(data) // size)
    padded = np.full(n * size, 256, np.int16)
    padded[:len(data)] = data
    lengths = np.full(n, size)
    if n:
        lengths[-1] = len(data) - (n - 1) * size
    return padded.reshape(n, size), lengths


def unfold(embedded: np.ndarray, width: int) -> np.ndarray:
    """(windows, positions, width * EMBEDDING) view of overlapping neighbours."""
    n, size, depth = embedded.shape
    s = embedded.strides
    return np.lib.stride_tricks.as_strided(embedded, (n, size - width + 1, width * depth), (s[0], s[1], s[2]), writeable=False)


def responses(model: Model, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Responses of all filters at all places, and the unfolded embeddings (for training)."""
    longest = max(WIDTHS)
    embedded = model.embedding[np.pad(block, ((0, 0), (0, longest - 1)), constant_values=256)]
    unfolded = unfold(np.ascontiguousarray(embedded), longest).reshape(-1, longest * model.embedding.shape[1])
    return (unfolded @ model.filters).reshape(len(block), -1, model.filters.shape[1]), unfolded


def log_probabilities(model: Model, block: np.ndarray) -> np.ndarray:
    pooled = np.maximum(responses(model, block)[0].max(1) + model.bias, 0)
    scores = pooled @ model.weights + model.offset
    scores = scores - scores.max(1, keepdims=True)
    return scores - np.log(np.exp(scores).sum(1, keepdims=True))


def train(texts: list[bytes], targets: list[str], epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Fit the network to windows and their labels by Adam on the cross entropy."""
    labels = tuple(sorted(set(targets)))
    if not labels:
        raise ValueError("no labelled window to learn from")
    draw = np.random.Generator(np.random.PCG64(seed))
    block = np.full((len(texts), WINDOW), 256, np.int16)
    for row, text in zip(block, texts):
        row[:len(text)] = np.frombuffer(text[:WINDOW], np.uint8)
    target = np.array([labels.index(t) for t in targets])
    longest, count = max(WIDTHS), FILTERS * len(WIDTHS)
    mask = np.zeros((longest * EMBEDDING, count), np.float32)
    for i, width in enumerate(WIDTHS):
        mask[:width * EMBEDDING, i * FILTERS:(i + 1) * FILTERS] = 1
    value = {
        "embedding": draw.normal(0, 0.5, (257, EMBEDDING)).astype(np.float32),
        "filters": (draw.normal(0, 0.3, mask.shape) * mask).astype(np.float32),
        "bias": np.zeros(count, np.float32),
        "weights": draw.normal(0, 0.3, (count, len(labels))).astype(np.float32),
        "offset": np.zeros(len(labels), np.float32),
    }
    value["embedding"][256] = 0
    first = {k: np.zeros_like(v) for k, v in value.items()}
    second = {k: np.zeros_like(v) for k, v in value.items()}
    step = 0
    share = np.bincount(target, minlength=len(labels)) / len(target)
    for _ in range(epochs):
        order = draw.permutation(len(block))
        for at in range(0, len(order), BATCH):
            pick = order[at:at + BATCH]
            model = Model(labels, **value)
            found, unfolded = responses(model, block[pick])
            place = found.argmax(1)
            top = np.take_along_axis(found, place[:, None], 1)[:, 0] + value["bias"]
            pooled = np.maximum(top, 0)
            scores = pooled @ value["weights"] + value["offset"]
            scores = np.exp(scores - scores.max(1, keepdims=True))
            slope = scores / scores.sum(1, keepdims=True)
            slope[np.arange(len(pick)), target[pick]] -= 1
            slope *= (1 / (len(labels) * share[target[pick]]))[:, None] / len(pick)  # labels count alike
            grad = {"weights": pooled.T @ slope, "offset": slope.sum(0)}
            back = (slope @ value["weights"].T) * (top > 0)
            grad["bias"] = back.sum(0)
            positions = found.shape[1]
            rows = (np.arange(len(pick))[:, None] * positions + place).ravel()  # unfolded row of each maximum
            used = unfolded[rows].reshape(len(pick), count, -1)
            grad["filters"] = np.einsum("bf,bfk->kf", back, used) * mask
            into = (back[:, :, None] * value["filters"].T[None]).reshape(len(pick), count, longest, EMBEDDING)
            padded = np.pad(block[pick], ((0, 0), (0, longest - 1)), constant_values=256)
            spots = place[:, :, None] + np.arange(longest)
            byte = padded[np.arange(len(pick))[:, None, None], spots]
            grad["embedding"] = np.zeros_like(value["embedding"])
            np.add.at(grad["embedding"], byte.ravel(), into.reshape(-1, EMBEDDING))
            grad["embedding"][256] = 0
            step += 1
            for name, g in grad.items():
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g * g
                rate = RATE * np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step)
                value[name] = (value[name] - rate * first[name] / (np.sqrt(second[name]) + 1e-8)).astype(np.float32)
    return Model(labels, **value)


def sample(docs: DataFrame, text: str, label: str, key: str, max_rows: int, windows_a_row: int) -> DataFrame:
    """(label, windows) of at most ``max_rows`` rows a label, windows spread evenly over each whole text."""
    usable = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull())
    counts = usable.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).select(F.col(label).alias("_label"), "_n")
    digest = F.xxhash64(F.col(key).cast("string"), text)
    share = F.pmod(digest, F.lit(1 << 30)) / F.lit(float(1 << 30))
    data = F.encode(text, "UTF-8")
    last = F.greatest(F.octet_length(text) - WINDOW, F.lit(0))
    starts = F.array_distinct(F.array(*[F.floor(last * i / max(windows_a_row - 1, 1)).cast("int") for i in range(windows_a_row)]))
    # Twice the rows wanted are cut to windows, so that what is ordered is small whatever the texts.
    few = usable.join(F.broadcast(counts), F.col(label) == F.col("_label")).where(
        (share * F.col("_n") < 2.0 * max_rows) & F.col(text).rlike(r"\p{L}")).select(
        F.col(label).alias("label"), digest.alias("digest"),
        F.transform(starts, lambda s: F.substr(data, s + 1, F.lit(WINDOW))).alias("windows"))
    order = Window.partitionBy("label").orderBy("digest", F.col("windows")[0])
    return few.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= max_rows).select("label", "windows")


def fit(docs: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", max_rows: int = MAX_ROWS,
        windows_a_row: int = WINDOWS_A_ROW, epochs: int = EPOCHS) -> Model:
    """Train on a bounded sample of labelled rows (see the module text)."""
    docs = docs.select(*dict.fromkeys((text, label, key)))
    rows = sorted(((r["label"], bytes(w)) for r in sample(docs, text, label, key, max_rows, windows_a_row).collect()
                   for w in r["windows"]), key=lambda r: (r[0], r[1]))
    if not rows:  # nothing is known: a model without languages
        none = np.zeros((0, 0), np.float32)
        return Model((), none, none, none, none, none)
    return train([w for _, w in rows], [name for name, _ in rows], epochs)


def classify(model: Model, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(rows, labels): log-probabilities averaged over the windows of each row, by length."""
    total = np.zeros((len(ends) - 1, len(model.labels)))
    weight = np.zeros(len(ends) - 1)
    held: list[tuple[int, np.ndarray, np.ndarray]] = []
    count = 0

    def flush() -> None:
        nonlocal held, count
        if held:
            blocks = np.concatenate([h[1] for h in held])
            owner = np.repeat([h[0] for h in held], [len(h[1]) for h in held])
            found = log_probabilities(model, blocks)
            lengths = np.concatenate([h[2] for h in held])
            np.add.at(total, owner, found * lengths[:, None])
            np.add.at(weight, owner, lengths)
        held, count = [], 0

    step = BATCH_WINDOWS * WINDOW
    for row in range(len(ends) - 1):
        for at in range(int(ends[row]), int(ends[row + 1]), step):  # a long text fills several batches
            block, lengths = windows(data[at:min(at + step, int(ends[row + 1]))])
            held.append((row, block, lengths))
            count += len(block)
            if count >= BATCH_WINDOWS:
                flush()
    flush()
    return total / np.maximum(weight, 1)[:, None]


def predict(docs: DataFrame, model: Model, text: str = "text", label: str = "lang_pred", score: str = "score") -> DataFrame:
    """Add the predicted language of each whole text and its probability; a model without languages knows none."""
    kept = [c for c in docs.columns if c not in (label, score)]
    if not model.labels:
        return docs.select(*kept, F.lit(UNKNOWN).alias(label), F.lit(0.0).alias(score))
    (has_letter,) = free_names([*kept, label, score], "letter")
    rows = docs.select(*kept, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias(has_letter))
    schema = output_schema(docs.select(*kept), {label: T.StringType(), score: T.DoubleType()})

    def run(batches: Iterator[pa.RecordBatch]):
        for whole in batches:
            for low, high in slices(whole.column(text), 1 << 20):
                batch = whole.slice(low, high - low)
                found = classify(model, *text_bytes(batch.column(text)))
                chance = np.exp(found - found.max(1, keepdims=True))
                chance /= chance.sum(1, keepdims=True)
                letter = np.array(batch.column(has_letter).to_pylist(), bool)
                names = [model.labels[i] if ok else UNKNOWN for i, ok in zip(found.argmax(1), letter)]
                best = np.where(letter, chance.max(1), 0.0)
                yield replace_column(batch.drop_columns([has_letter]), {
                    label: pa.array(names, pa.string()), score: pa.array(best, pa.float64())})

    return rows.mapInArrow(run, schema)


def held_out(key: Column) -> Column:
    """Whether the CRC-32 of the key as text leaves remainder 1 by 3."""
    return F.coalesce(F.crc32(F.encode(key.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))
