"""Language identification: multinomial logistic regression on TF-IDF hashed
character n-grams, trained with FTRL-proximal and an elastic-net penalty,
then calibrated by a temperature."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import doc_texts, materialise

BINS = 1 << 14         # hashed n-grams; bounds the model and what the driver receives
PER_LANGUAGE = 400     # labelled rows of a language the classifier is fitted on
UNKNOWN = "und"
_BLOCK = 1 << 20       # characters hashed at once
_BLANK = np.uint64(32)


def _counts(text: str) -> np.ndarray:
    """Counts of hashed 1- to 3-grams of the lower-cased text; everything
    that is not a letter counts as one blank."""
    out = np.zeros(BINS, dtype=np.int64)
    tail = np.empty(0, dtype=np.uint64)  # the last two of the block before, so no n-gram is lost
    for k in range(0, len(text), _BLOCK):
        points = np.frombuffer(text[k:k + _BLOCK].lower().encode("utf-32-le"), dtype="<u4").astype(np.uint64)
        solid = (points >= 128) | ((points >= 97) & (points <= 122))
        points = np.where(solid, points, _BLANK)
        keep = np.ones(len(points), dtype=bool)
        keep[1:] = solid[1:] | solid[:-1]
        keep[0] = solid[0] or not len(tail) or tail[-1] != _BLANK
        points = points[keep]
        for n in (1, 2, 3):
            run = np.concatenate([tail[max(len(tail) - n + 1, 0):], points]) if n > 1 else points
            if len(run) < n:
                continue
            grams = run[:len(run) - n + 1]
            for i in range(1, n):
                grams = grams * np.uint64(0x9E3779B1) + run[i:len(run) - n + 1 + i]
            at = ((grams + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(50)
            out += np.bincount(at.astype(np.int64), minlength=BINS)
        tail = np.concatenate([tail, points])[-2:]
    return out


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray          # BINS
    weights: np.ndarray      # BINS x languages, sparse in content
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _weigh(counts, self.idf)

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.languages or not _has_letter(text):
            return UNKNOWN, 0.0
        at, x = self.vector(_counts(text))
        p = _softmax((x @ self.weights[at] + self.bias) / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def _weigh(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bins, weights): sub-linear TF times IDF, unit length."""
    at = np.flatnonzero(counts)
    x = (1 + np.log(counts[at])) * idf[at]
    norm = np.sqrt(x @ x)
    return at, x / norm if norm > 0 else x


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, n_classes: int, alpha: float = 0.5,
             beta: float = 1.0, l1: float = 0.02, l2: float = 0.5, epochs: int = 4, seed: int = 7):
    """(weights, bias) by FTRL-proximal: each coordinate keeps its sum of
    adjusted gradients z and of squared gradients n; the weight follows from
    both in closed form, exactly zero while |z| <= l1."""
    z, n = np.zeros((BINS + 1, n_classes)), np.zeros((BINS + 1, n_classes))

    def weights(at):
        grown = z[at]
        return np.where(np.abs(grown) <= l1, 0.0,
                        -(grown - np.sign(grown) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            at, x = np.append(at, BINS), np.append(x, 1.0)
            w = weights(at)
            p = _softmax(x @ w)
            p[labels[i]] -= 1.0
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(BINS + 1))
    return w[:-1], w[-1]


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        p = _softmax(logits / np.exp(log_t))
        return -float(np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12)).mean())

    a, b, r = -3.0, 3.0, (5 ** 0.5 - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def held_out(doc_id: Column) -> Column:
    """Is a document kept for evaluation: CRC-32 of its id modulo 4 is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _document_frequencies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BINS, dtype=np.int64)
    n = 0
    for b in batches:
        for t in b.column("text").to_pylist():
            total += _counts(t) > 0
            n += 1
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))],
                                     names=["bin", "n"])


def _vectors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        counts = [_counts(t) for t in b.column("text").to_pylist()]
        at = [np.flatnonzero(c) for c in counts]
        yield pa.RecordBatch.from_arrays(
            [b.column("lang"), b.column("r"), pa.array([a.astype(np.int32) for a in at], pa.list_(pa.int32())),
             pa.array([c[a].astype(np.int32) for c, a in zip(counts, at)], pa.list_(pa.int32()))],
            names=["lang", "r", "bins", "counts"])


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          per_language: int = PER_LANGUAGE) -> Model:
    """Fit on (id, text, lang). Document frequencies come from all rows with a
    language; the weights from at most ``per_language`` rows of each, chosen by
    a hash of the id, of which every fifth is kept for the temperature.

    Edge cases: rows without a language or with an empty text teach nothing but
    frequencies; repeated rows are chosen once; a null id counts as 0; without
    labelled rows the model knows no language."""
    rows = labelled.select(F.col(id_col).cast("bigint").alias("doc_id"),
                           F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                           F.col(lang_col).cast("string").alias("lang")).where("lang is not null")
    df = {r.bin: r.n for r in rows.select("text").mapInArrow(_document_frequencies, "bin bigint, n bigint")
          .groupBy("bin").agg(F.sum("n").alias("n")).collect()}  # at most BINS + 1 rows
    n_docs = df.pop(-1, 0)
    idf = np.full(BINS, np.log((1 + n_docs) / 1) + 1)
    for k, v in df.items():
        idf[k] = np.log((1 + n_docs) / (1 + v)) + 1
    # ids, not texts, are ranked; then the texts of the few chosen rows are joined
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "key")
    keyed = rows.where("text <> ''").select("lang", F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "text",
                                           F.md5("text").alias("key"))
    chosen = materialise(keyed.select("lang", "doc_id", "key").distinct().withColumn("r", F.row_number().over(by_hash))
                         .where(F.col("r") <= per_language), "training-ids")
    sample = keyed.join(chosen, ["lang", "doc_id", "key"]).dropDuplicates(["lang", "r"]) \
        .select("lang", "r", "text").mapInArrow(_vectors, "lang string, r int, bins array<int>, counts array<int>") \
        .orderBy("lang", "r").toPandas()
    languages = sorted(set(sample["lang"]))
    vectors, labels = [], sample["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(dtype=np.int64)
    for bins, counts in zip(sample["bins"], sample["counts"]):
        dense = np.zeros(BINS, dtype=np.int64)
        dense[np.asarray(bins, dtype=np.int64)] = counts
        vectors.append(_weigh(dense, idf))
    check = (sample["r"] % 5 == 0).to_numpy(dtype=bool)
    fit = np.flatnonzero(~check)
    weights, bias = fit_ftrl([vectors[i] for i in fit], labels[fit], max(len(languages), 1))
    kept = np.flatnonzero(check)
    logits = np.array([vectors[i][1] @ weights[vectors[i][0]] + bias for i in kept]).reshape(len(kept), max(len(languages), 1))
    return Model(languages, idf, weights, bias, fit_temperature(logits, labels[kept]))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row from its text alone; the score
    is the calibrated probability of the predicted language.

    Edge cases: ``und`` with score 0 for a null text, a text without letters,
    and for every text if there was nothing to learn from; repeated rows stay
    repeated; an empty table gives an empty result; other columns are not read."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [model.predict(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([g[0] for g in got], pa.string()),
                 pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return doc_texts(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             per_language: int = PER_LANGUAGE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): trained on the documents that are
    not held out, applied to all; a null doc_id is neither held out nor learnt from."""
    learn = docs.where(F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    model = train(learn, id_col, text_col, lang_col, per_language)
    return predict(docs, model, id_col, text_col) \
        .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
