"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it.  Bytes
are embedded, learned filters run over each chunk, their rectified responses are
max-pooled over the chunk, and the mean and the maximum over all chunks go
through one hidden layer into one probability.

The network is trained on the driver, from a bounded sample of the labelled
rows: ``Settings.sample_docs`` documents, chosen by a hash of their ids, each with
all its chunks.  A score sees the text alone.

Defined results: a null text is the empty text, which is one chunk of padding
and is scored like any other; labels that are null, or whose document is
missing, are not learned from; if a document has several labels each counts;
without labels of both classes every score is the share of class 1 (1/2 if
there are none); other columns are ignored.

Scale: scoring is a map over the documents, without a shuffle; memory follows
``Settings.block`` chunks and one text.  Training holds the sampled texts, and
works on ``Settings.block`` chunks at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import small_batches, trimmed


@dataclass(frozen=True)
class Settings:
    chunk: int = 256
    step: int = 192
    width: int = 8
    stride: int = 2
    embed: int = 8
    filters: int = 32
    hidden: int = 16
    block: int = 256
    sample_docs: int = 2500
    epochs: int = 8
    batch: int = 32
    rate: float = 0.005
    seed: int = 17


def chunks_of(text: str | None, s: Settings) -> np.ndarray:
    """The chunks of a text as rows of byte codes; 256 is padding."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if len(data) < s.chunk:
        row = np.full((1, s.chunk), 256, np.int16)
        row[0, : len(data)] = data
        return row
    starts = np.append(np.arange(0, len(data) - s.chunk, s.step), len(data) - s.chunk)
    return np.lib.stride_tricks.sliding_window_view(data, s.chunk)[starts].astype(np.int16)


@dataclass
class Network:
    settings: Settings
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    #: The score of every text where there was nothing to learn.
    constant: float | None = None

    def begin(self) -> None:
        s, rng = self.settings, np.random.default_rng(self.settings.seed)
        make = lambda *shape, by: (rng.standard_normal(shape) / np.sqrt(by)).astype(np.float32)
        self.weights = {
            "embed": make(257, s.embed, by=1),
            "conv": make(s.width * s.embed, s.filters, by=s.width * s.embed),
            "conv_b": np.zeros(s.filters, np.float32),
            "hid": make(2 * s.filters, s.hidden, by=2 * s.filters),
            "hid_b": np.zeros(s.hidden, np.float32),
            "out": make(s.hidden, by=s.hidden),
            "out_b": np.zeros((), np.float32),
        }

    def windows(self, chunks: np.ndarray) -> np.ndarray:
        s = self.settings
        embedded = self.weights["embed"][chunks]
        view = np.lib.stride_tricks.sliding_window_view(embedded, s.width, axis=1)[:, :: s.stride]
        return view.transpose(0, 1, 3, 2).reshape(len(chunks), -1, s.width * s.embed)

    def pooled(self, chunks: np.ndarray) -> np.ndarray:
        """Per chunk, the largest rectified response of each filter."""
        w = self.weights
        out = np.empty((len(chunks), self.settings.filters), np.float32)
        for i in range(0, len(chunks), self.settings.block):
            out[i : i + self.settings.block] = (self.windows(chunks[i : i + self.settings.block]) @ w["conv"]).max(axis=1)
        return np.maximum(out + w["conv_b"], 0)

    def head(self, features: np.ndarray) -> np.ndarray:
        w = self.weights
        hidden = np.maximum(features @ w["hid"] + w["hid_b"], 0)
        return 1 / (1 + np.exp(-np.clip(hidden @ w["out"] + w["out_b"], -30, 30)))

    def score(self, text: str | None) -> float:
        """The probability of class 1, from all chunks of the text."""
        if self.constant is not None:
            return self.constant
        chunks = chunks_of(text, self.settings)
        total, top = 0.0, 0.0
        for i in range(0, len(chunks), self.settings.block):
            part = self.pooled(chunks[i : i + self.settings.block])
            total, top = total + part.sum(axis=0), np.maximum(top, part.max(axis=0))
        return float(self.head(np.concatenate([total / len(chunks), top]))) if len(chunks) else 0.0

    def fit(self, examples: list[tuple[str | None, int]]) -> Network:
        """Adam on the log loss of texts and labels, both classes weighing alike."""
        s = self.settings
        labels = np.array([y for _, y in examples], np.float32)
        if len(set(labels.tolist())) < 2:
            self.constant = float(labels.mean()) if len(labels) else 0.5
            return self
        self.begin()
        weight = 0.5 / np.where(labels == 1, labels.mean(), 1 - labels.mean())
        rng = np.random.default_rng(s.seed + 1)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        turn, turns = 0, s.epochs * -(-len(examples) // s.batch)
        for _ in range(s.epochs):
            order = rng.permutation(len(examples))
            for at in range(0, len(order), s.batch):
                picked = order[at : at + s.batch]
                grads = self._gradients([chunks_of(examples[i][0], s) for i in picked], labels[picked], weight[picked])
                turn += 1
                rate = s.rate * (1 - (turn - 1) / turns)
                for k, g in grads.items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    step = first[k] / (1 - 0.9**turn) / (np.sqrt(second[k] / (1 - 0.99**turn)) + 1e-7)
                    self.weights[k] = (self.weights[k] - rate * step).astype(np.float32)
        return self

    def _gradients(self, docs: list[np.ndarray], labels: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        s, w = self.settings, self.weights
        chunks = np.concatenate(docs)
        sizes = np.array([len(d) for d in docs])
        bounds = np.append(0, np.cumsum(sizes))
        parts = [slice(i, i + s.block) for i in range(0, len(chunks), s.block)]
        where = np.empty((len(chunks), s.filters), np.int32)
        raw = np.empty((len(chunks), s.filters), w["conv"].dtype)
        for part in parts:
            responses = self.windows(chunks[part]) @ w["conv"]
            where[part] = responses.argmax(axis=1)
            raw[part] = np.take_along_axis(responses, where[part][:, None], axis=1)[:, 0]
        raw += w["conv_b"]
        pooled = np.maximum(raw, 0)
        mean = np.add.reduceat(pooled, bounds[:-1]) / sizes[:, None]
        top_at = np.stack([a + pooled[a:b].argmax(axis=0) for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
        top = np.take_along_axis(pooled, top_at, axis=0)
        features = np.concatenate([mean, top], axis=1)
        hidden = np.maximum(features @ w["hid"] + w["hid_b"], 0)
        score = 1 / (1 + np.exp(-np.clip(hidden @ w["out"] + w["out_b"], -30, 30)))

        d_out = (score - labels) * weight / len(docs)
        d_hidden = np.outer(d_out, w["out"]) * (hidden > 0)
        d_features = d_hidden @ w["hid"].T
        d_pooled = np.repeat(d_features[:, : s.filters] / sizes[:, None], sizes, axis=0)
        np.add.at(d_pooled, (top_at, np.arange(s.filters)), d_features[:, s.filters :])
        d_pooled *= raw > 0
        d_embed, d_conv = np.zeros((257, s.embed)), np.zeros(w["conv"].shape)
        for part in parts:
            codes = np.take_along_axis(
                chunks[part][:, None], (where[part] * s.stride)[:, :, None] + np.arange(s.width), axis=2
            )  # of the window that each filter took
            taken = w["embed"][codes].reshape(len(codes), s.filters, -1)
            d_conv += np.einsum("cf,cfd->df", d_pooled[part], taken)
            flat = (d_pooled[part][:, :, None] * w["conv"].T).reshape(-1, s.embed)
            for e in range(s.embed):
                d_embed[:, e] += np.bincount(codes.ravel(), flat[:, e], minlength=257)
        return {
            "embed": d_embed,
            "conv": d_conv,
            "conv_b": d_pooled.sum(axis=0),
            "hid": features.T @ d_hidden,
            "hid_b": d_hidden.sum(axis=0),
            "out": hidden.T @ d_out,
            "out_b": d_out.sum(),
        }


def train(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    settings: Settings = Settings(),
) -> Network:
    """A network fitted to at most ``settings.sample_docs`` of the labelled rows."""
    small_batches(docs.sparkSession)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")
    )
    draw = F.xxhash64(F.col("doc_id"), F.lit(settings.seed))
    total = known.count()
    if total > 2 * settings.sample_docs:  # as a share of all 64-bit numbers, with some to spare
        bound = -(1 << 63) + int(1.5 * settings.sample_docs / total * (1 << 64))
        known = known.where(draw < bound)
    some = known.orderBy(draw, "doc_id", "label").limit(settings.sample_docs)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    got = rows.join(F.broadcast(some), "doc_id").select(F.col("doc_id").cast("string"), "label", "text").collect()
    got.sort(key=lambda r: (r["doc_id"], r["label"], r["text"] or ""))
    return Network(settings).fit([(r["text"], r["label"]) for r in got])


def score(docs: DataFrame, network: Network, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with all its columns and ``quality_score``, the probability of class 1."""
    small_batches(docs.sparkSession)
    names = [c for c in docs.columns if c != "quality_score"]
    rows = docs.select(*[F.col(f"`{c}`") for c in names])
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [network.score(t) for t in batch.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.float64())], [*names, "quality_score"]
            )

    return rows.mapInArrow(trimmed(run), f"{types}, quality_score double")
