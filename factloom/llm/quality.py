"""Document quality by co-training two views.

The text view sees words and the text's shape, the metadata view source, language and length columns. Each is a logistic
regression in numpy, calibrated (Platt) on labelled rows kept out of its fit. In every round both views score the whole
unlabelled table in Spark, and each hands the rows that it is surest of, none below ``CONFIDENT``, to the other view's
training set, ``EXCHANGE`` of either label at most. A logistic combination of the calibrated views then scores all documents. Only
the labelled sample (``MAX_ROWS``) and the rows handed over are on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import arrays
from factloom.llm.common import batched, crc_fold, cut

BUCKETS = 256
META = 512
SHAPE = 24
MAX_ROWS = 2500
ROUNDS = 3
EXCHANGE = 60  # rows of either label that a view hands over in a round at most
CONFIDENT = 0.9  # calibrated probability that a handed label needs


@dataclass(frozen=True)
class Logit:
    """A linear view with its standardisation and calibration."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    intercept: float
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights + self.intercept

    def calibrated(self, x: np.ndarray) -> np.ndarray:
        return self.slope * self.raw(x) + self.shift


@dataclass(frozen=True)
class Model:
    text: Logit
    meta: Logit
    combine: tuple[float, float, float]


def text_view(col: pa.Array) -> np.ndarray:
    """(rows, SHAPE + BUCKETS): the text's shape and log word counts by hash bucket, over whole texts."""
    data, offsets = arrays.text_buffers(col)
    out = np.zeros((len(offsets) - 1, SHAPE + BUCKETS), np.float32)
    upper, digit, space, other = (np.zeros(256, bool) for _ in range(4))
    upper[65:91], digit[48:58], space[:] = True, True, arrays.SPACE
    other[33:127] = True
    other &= ~arrays.WORD
    for i, j in arrays.chunks(offsets):
        piece, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        h, bounds = arrays.words(piece, at)
        n, size, count = j - i, np.maximum(np.diff(at), 1), np.maximum(np.diff(bounds), 1)
        row = np.repeat(np.arange(n), np.diff(bounds))
        cells = np.bincount(row * BUCKETS + (h % np.uint64(BUCKETS)).astype(np.int64), minlength=n * BUCKETS).reshape(n, BUCKETS)
        out[i:j, SHAPE:] = np.sqrt(cells / count[:, None])
        for k, kind in enumerate((upper, digit, space, other, arrays.WORD)):
            sums = np.concatenate([[0], np.cumsum(kind[piece])])
            out[i:j, k] = (sums[at[1:]] - sums[at[:-1]]) / size
        breaks = np.concatenate([[0], np.cumsum(piece == 10)])
        out[i:j, 5] = (breaks[at[1:]] - breaks[at[:-1]]) / size
        out[i:j, 6] = np.log1p(np.diff(at))
        out[i:j, 7] = np.log1p(np.diff(bounds))
        out[i:j, 8] = size / count
        order = np.lexsort((h, row))
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
        out[i:j, 9] = np.bincount(row[order], weights=fresh, minlength=n) / count
        again = np.zeros(len(h))
        again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
        out[i:j, 10] = np.bincount(row, weights=again, minlength=n) / count
        bars = np.concatenate([[0], np.cumsum(piece == 124)])
        out[i:j, 11] = (bars[at[1:]] - bars[at[:-1]]) / size
        out[i:j, 12:24] = np.sqrt(out[i:j, :12])
    return out


def meta_view(source: pa.Array, lang: pa.Array, n_chars: pa.Array) -> np.ndarray:
    """(rows, META): hashed source, language, their pair and a length class; nulls are a value of their own."""
    n = len(source)
    out = np.zeros((n, META), np.float32)
    chars = np.array([np.nan if x is None else float(x) for x in n_chars.to_pylist()])
    size = ["null" if np.isnan(x) else str(int(2 * np.log2(max(x, 0) + 1))) for x in chars]
    fields = [[f"{tag}={x}" for x in col] for tag, col in (("s", source.to_pylist()), ("l", lang.to_pylist()), ("c", size))]
    fields.append([f"{a}&{b}" for a, b in zip(fields[0], fields[1], strict=True)])
    for listed in fields:
        raw = [x.encode() for x in listed]
        at = np.cumsum([0, *map(len, raw)])
        data = np.frombuffer(b"".join(raw), np.uint8)
        if n:
            out[np.arange(n), (arrays.span_hashes(data, at[:-1], at[1:]) % np.uint64(META)).astype(np.int64)] = 1
    return out


def fit_logit(x: np.ndarray, y: np.ndarray, steps: int = 150, penalty: float = 1e-3) -> Logit:
    """Balanced, ridge-penalised logistic regression by full-batch Adam; one label only gives a constant."""
    width = x.shape[1]
    if len(y) == 0 or y.min() == y.max():
        return Logit(np.zeros(width), np.ones(width), np.zeros(width), 0.0 if len(y) == 0 else 3.0 * (2 * y[0] - 1))
    mean, scale = x.mean(0), x.std(0) + 0.02
    z = ((x - mean) / scale).astype(np.float32)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    w, b = np.zeros(width, np.float32), 0.0
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(z @ w + b, -30, 30)))
        d = (p - y) * weight / len(y)
        g = np.append(z.T @ d + penalty * w, d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.03 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1].astype(np.float32), b - step[-1]
    return Logit(mean, scale, w.astype(np.float64), float(b))


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the calibration; identity with one label only."""
    if len(y) < 10 or y.min() == y.max():
        return 1.0, 0.0
    m = fit_logit(z[:, None], y, 300, 1e-2)
    return float(m.weights[0] / m.scale[0]), float(m.intercept - m.weights[0] * m.mean[0] / m.scale[0] + np.log(y.mean() / (1 - y.mean())))


def fitted(x: np.ndarray, y: np.ndarray, kept_x: np.ndarray, kept_y: np.ndarray) -> Logit:
    """A view with its calibration on the rows kept out."""
    m = fit_logit(x, y)
    slope, shift = platt(m.raw(kept_x), kept_y)
    return Logit(m.mean, m.scale, m.weights, m.intercept, max(slope, 0.0), shift)


def combined(views: list[Logit], kept: list[np.ndarray], kept_y: np.ndarray, prior: float) -> Model:
    """The logistic combination of the calibrated views on the rows kept out, at the labels' rate."""
    z = np.stack([m.calibrated(x) for m, x in zip(views, kept, strict=True)], 1) if len(kept_y) else np.zeros((0, 2))
    both = fit_logit(z, kept_y, 300, 1e-2)
    w = both.weights / both.scale
    shift = np.log(max(prior, 1e-3) / max(1 - prior, 1e-3))
    return Model(views[0], views[1], (float(w[0]), float(w[1]), float(both.intercept - (w * both.mean).sum() + shift)))


COLUMNS = ["_text", "_source", "_lang", "_chars"]


def _columns(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str, chars_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), F.col(source_col).cast("string").alias("_source"), F.col(lang_col).cast("string").alias("_lang"), F.col(chars_col).cast("double").alias("_chars")
    )


def _features(rows: DataFrame, key: str) -> pd.DataFrame:
    """Both views of (key, *COLUMNS) rows, made in tasks; the rows must be bounded. Sorted, so that their order is fixed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            views = text_view(b.column("_text")), meta_view(b.column("_source"), b.column("_lang"), b.column("_chars"))
            yield pa.RecordBatch.from_arrays([b.column("key"), *[pa.array([r.tobytes() for r in x], pa.binary()) for x in views]], ["key", "t", "m"])

    pdf = rows.select(F.col(key).cast("string").alias("key"), *COLUMNS).mapInArrow(run, "key string, t binary, m binary").toArrow().to_pandas()
    return pdf.sort_values(["key", "t", "m"]).drop_duplicates("key") if len(pdf) else pdf


def _arrays(pdf: pd.DataFrame) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(pdf[c]), np.float32).reshape(len(pdf), n) for c, n in (("t", SHAPE + BUCKETS), ("m", META))]


def confident(pool: DataFrame, labelled: DataFrame, views: list[Logit], taken: list[str], exchange: int = EXCHANGE) -> DataFrame:
    """(key, view, label): the rows of the whole pool that each view hands over.

    ``pool`` (key, *COLUMNS), ``labelled`` (key). Of either label these are the ``exchange`` rows with the highest calibrated
    probability, if it is ``CONFIDENT`` at least; probabilities are compared in steps of 1e-4, ties by the key. A view that
    learned nothing hands over nothing. Rows with a labelled or ``taken`` key are left out. Texts are not shuffled.
    """
    spark = pool.sparkSession
    shared = spark.sparkContext.broadcast(views)
    edge = float(np.log(CONFIDENT / (1 - CONFIDENT)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                x = text_view(part.column("_text")), meta_view(part.column("_source"), part.column("_lang"), part.column("_chars"))
                z = [v.calibrated(a) if v.weights.any() else np.zeros(len(a)) for v, a in zip(shared.value, x, strict=True)]
                keep = np.flatnonzero((np.abs(z[0]) >= edge) | (np.abs(z[1]) >= edge))
                yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(keep)), *[pa.array(np.round(a[keep], 4)) for a in z]], ["key", "z0", "z1"])

    scored = pool.mapInArrow(run, "key string, z0 double, z1 double").groupBy("key").agg(F.min("z0").alias("z0"), F.min("z1").alias("z1"))
    if taken:
        scored = scored.join(F.broadcast(spark.createDataFrame([(k,) for k in taken], "key string")), "key", "left_anti")
    scored = cut(scored.join(labelled.select("key"), "key", "left_anti"))
    parts = []
    for view in (0, 1):
        for label in (0, 1):
            z = F.col(f"z{view}") if label else -F.col(f"z{view}")
            top = scored.filter(z >= edge).orderBy(z.desc(), "key").limit(exchange)
            parts.append(top.select("key", F.lit(view).alias("view"), F.lit(label).alias("label")))
    return reduce(DataFrame.unionAll, parts)


def fit(
    docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, rounds: int = ROUNDS, exchange: int = EXCHANGE, id_col: str = "doc_id",
    text_col: str = "text", source_col: str = "source", lang_col: str = "lang", chars_col: str = "n_chars",
) -> Model:
    """Co-train on at most ``max_rows`` labelled rows (half of each label as far as there are such, outside fold 2 of 4, picked
    by hash of the id) and on what the views hand over from all unlabelled rows outside that fold.

    Repeated labels of an id: the highest counts. Rows with a null id are scored, never learned from; of rows that repeat an id
    one is learned from, always the same. With one label only, or none, the score is constant.
    """
    batched(docs.sparkSession)
    marked = labels.filter(F.col("quality").isNotNull() & F.col(id_col).isNotNull() & (crc_fold(id_col, 4) != 2))
    marked = marked.groupBy(F.col(id_col).alias("_lid")).agg(F.max("quality").cast("int").alias("_y"))
    half = [marked.filter(f"_y = {y}").orderBy(F.xxhash64("_lid"), "_lid").limit(max_rows // 2) for y in (0, 1)]
    sample = F.broadcast(half[0].unionAll(half[1]))
    columns = _columns(docs, id_col, text_col, source_col, lang_col, chars_col)
    joined = columns.join(sample, F.col("_id") == F.col("_lid"))
    pdf = _features(joined, "_id")
    truth = dict(sample.select(F.col("_lid").cast("string"), "_y").collect())
    y = np.array([truth[k] for k in pdf["key"]], np.float64)
    mixed = np.random.default_rng(4).permutation(len(pdf))
    y, views_x = y[mixed], [x[mixed] for x in _arrays(pdf)]
    keep = np.arange(len(y)) % 4 == 3
    kept, kept_y = [x[keep] for x in views_x], y[keep]
    sets = [(x[~keep], y[~keep]) for x in views_x]
    pool = columns.filter(F.col("_id").isNotNull() & (crc_fold("_id", 4) != 2)).select(F.col("_id").cast("string").alias("key"), *COLUMNS)
    labelled = labels.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("key")).distinct()
    taken: list[str] = []
    models = [fitted(x, t, kx, kept_y) for (x, t), kx in zip(sets, kept, strict=True)]
    for _ in range(rounds):
        given = confident(pool, labelled, models, taken, exchange).collect()
        if not given:
            break
        names = sorted({r.key for r in given})
        wanted = F.broadcast(docs.sparkSession.createDataFrame([(k,) for k in names], "key string"))
        found = _features(pool.join(wanted, "key"), "key").reset_index(drop=True)
        at, x = {k: i for i, k in enumerate(found["key"])}, _arrays(found)
        for view in (0, 1):
            rows = [(at[r.key], r.label) for r in sorted(given) if r.view != view]
            if rows:
                index, label = np.array(rows).T
                sets[view] = np.concatenate([sets[view][0], x[view][index]]), np.concatenate([sets[view][1], label.astype(float)])
        taken += names
        models = [fitted(a, t, kx, kept_y) for (a, t), kx in zip(sets, kept, strict=True)]
    return combined(models, kept, kept_y, float(y.mean()) if len(y) else 0.5)


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", chars_col: str = "n_chars") -> DataFrame:
    """id, text_score, meta_score, score and predicted (score >= 0.5) of every document row.

    Null texts are empty; null metadata is a value of its own; null or repeated ids give a row each; other columns are not
    read; an empty table gives an empty result.
    """
    batched(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = shared.value
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                t = m.text.calibrated(text_view(part.column("_text")))
                e = m.meta.calibrated(meta_view(part.column("_source"), part.column("_lang"), part.column("_chars")))
                s = sigmoid(m.combine[0] * t + m.combine[1] * e + m.combine[2])
                yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(sigmoid(t)), pa.array(sigmoid(e)), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [id_col, "text_score", "meta_score", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return _columns(docs, id_col, text_col, source_col, lang_col, chars_col).mapInArrow(run, f"`{id_col}` {kind}, text_score double, meta_score double, score double, predicted int")
