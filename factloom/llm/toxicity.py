"""Toxicity: a convolutional text classifier over hashed words, trained in numpy.

A word's embedding is the sum of three hashed rows, of the word and of its first 4 and 6 bytes (stems); filters of several widths slide over the text, their maxima over all positions feed a
logistic layer. A filter is linear before its maximum, so scoring needs one table of filter responses for each bucket and
offset: a position's response is a sum of ``width`` table rows, and whole texts of any length are scored in pieces.

The training sample is bounded by ``MAX_TRAIN_ROWS``. Thresholds are calibrated for each language, which is told from the
text's own function words (never from a column), on all labelled rows outside the held-out fold and the fit, as a histogram
of scores weighted to the labels' true rate; each language's threshold is moved to a score of 0.3.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import arrays
from factloom.llm.common import batched, crc_fold

BUCKETS = 1 << 15  # of each of the three kinds of rows
PREFIXES = (4, 6)
KINDS = 1 + len(PREFIXES)
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
MAX_TRAIN_ROWS = 4000
EPOCHS = 4
MIN_STEPS = 200
BATCH = 32
THRESHOLD = 0.3
BIN, BINS = 1 / 64, 1 << 13  # width and number of the bins of the histogram of logits
#: Fixed function words by language, for guessing a text's language.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for with as on be by this are from".split(),
    "fr": "le la les des et un une du en qui que pour par dans est au".split(),
    "de": "der die das und von den ist mit ein eine nicht auch auf zu im".split(),
    "es": "el los las y que un una por con para del es se al como".split(),
}


@dataclass(frozen=True)
class Model:
    """Filter tables of shape (rows, filters) for each width and offset, output weights and language thresholds."""

    tables: tuple[tuple[np.ndarray, ...], ...]
    bias: np.ndarray
    weights: np.ndarray
    intercept: float
    thresholds: np.ndarray  # for each language, and last for none


def _language_codes() -> tuple[np.ndarray, np.ndarray]:
    """Sorted word hashes and the language of each."""
    pairs = []
    for k, listed in enumerate(FUNCTION_WORDS.values()):
        for w in listed:
            raw = np.frombuffer(w.encode(), np.uint8)
            pairs.append((int(arrays.span_hashes(raw, np.array([0]), np.array([len(raw)]))[0]), k))
    pairs.sort()
    return np.array([p[0] for p in pairs], np.uint64), np.array([p[1] for p in pairs])


LANG_HASHES, LANG_OF = _language_codes()


def languages(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The language with most function words in each row; len(FUNCTION_WORDS) where there are none."""
    n, k = len(bounds) - 1, len(FUNCTION_WORDS)
    at = np.minimum(np.searchsorted(LANG_HASHES, hashes), len(LANG_HASHES) - 1)
    hit = np.flatnonzero(LANG_HASHES[at] == hashes)
    row = np.searchsorted(bounds, hit, "right") - 1
    counts = np.bincount(row * k + LANG_OF[at[hit]], minlength=n * k).reshape(n, k)
    return np.where(counts.any(1), counts.argmax(1), k)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, KINDS) embedding rows, the words' hashes, and each row's first word (n + 1 bounds)."""
    data = arrays.LOWER[data]
    starts, ends = arrays.spans(data, offsets, arrays.WORD)
    sums = arrays.prefix_sums(data)
    hashes = arrays.stretch_hashes(sums, starts, ends)
    ids = np.empty((len(starts), KINDS), np.int32)
    ids[:, 0] = hashes % np.uint64(BUCKETS)
    for k, n in enumerate(PREFIXES, 1):
        ids[:, k] = arrays.stretch_hashes(sums, starts, np.minimum(starts + n, ends)) % np.uint64(BUCKETS)
        ids[:, k] += k * BUCKETS
    return ids, hashes, np.searchsorted(starts, offsets)


def responses(table: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Filter responses of words: the sum over their rows."""
    out = table[ids[:, 0]]
    for k in range(1, ids.shape[1]):
        out += table[ids[:, k]]
    return out


def pooled(ids: np.ndarray, bounds: np.ndarray, tables, bias: np.ndarray, positions: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(rows, all filters) maxima of relu(response), and with ``positions`` that of each maximum (-1: none above 0).

    A text shorter than a filter is padded with an all-zero word, an empty one has zero responses.
    """
    n = len(bounds) - 1
    out, where, col = np.zeros((n, len(bias)), np.float32), np.full((n, len(bias)), -1), 0
    size = np.diff(bounds)
    for per_offset in tables:
        width, f = len(per_offset), per_offset[0].shape[1]
        response = responses(per_offset[0], ids)
        for j in range(1, width):
            response[:-j] += responses(per_offset[j], ids[j:])
            edge = (bounds[1:, None] - 1 - np.arange(j)[None, :]).ravel()  # positions whose j-th next word is in another row
            edge = edge[(edge >= np.repeat(bounds[:-1], j))]
            inner = edge[edge + j < len(ids)]
            response[inner] -= responses(per_offset[j], ids[inner + j])
        rows = np.flatnonzero(size)
        if len(rows):
            best = np.maximum.reduceat(response, bounds[:-1][rows], axis=0) + bias[col : col + f]
            out[rows, col : col + f] = np.maximum(best, 0)
            for r, b in zip(rows, best, strict=True) if positions else ():
                piece = response[bounds[r] : bounds[r + 1]]
                where[r, col : col + f] = np.where(b > 0, piece.argmax(0) + bounds[r], -1)
        col += f
    return out, where


def train(docs: list[np.ndarray], labels: np.ndarray, langs: np.ndarray, seed: int = 3) -> Model:
    """Fit by Adam on cross-entropy; thresholds maximise F1 on every fifth row, which is kept out of the fit."""
    rng = np.random.default_rng(seed)
    k = len(FUNCTION_WORDS)  # the number of languages
    hold = kept_out(len(docs))
    fit = np.flatnonzero(~hold)
    n_filters = FILTERS * len(WIDTHS)
    emb = rng.normal(0, 0.1, (KINDS * BUCKETS, DIM)).astype(np.float32)
    conv = [rng.normal(0, 0.2, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    bias = np.full(n_filters, -0.1, np.float32)
    weights = rng.normal(0, 0.1, n_filters).astype(np.float32)
    # The first dimension starts as the words' association with the label, and one filter of each width looks at it.
    emb[:, 0] = association([docs[r] for r in fit], labels[fit]) / 8
    for i, c in enumerate(conv):
        c[0, 0, 0] = 1.0
        bias[i * FILTERS], weights[i * FILTERS] = -0.5, 1.0
    rate = float(labels[fit].mean()) if len(fit) else 0.0
    if not 0 < rate < 1:
        tables = tuple(tuple(np.zeros((KINDS * BUCKETS, FILTERS), np.float32) for _ in range(w)) for w in WIDTHS)
        return Model(tables, bias * 0, weights * 0, 3.0 if rate == 1 else -3.0, np.full(k + 1, 0.0))
    intercept = np.array([np.log(rate / (1 - rate))], np.float32)
    params = [emb, *conv, bias, weights, intercept]
    m1, m2, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0

    def tables_of() -> list[list[np.ndarray]]:
        return [[emb @ c[j] for j in range(len(c))] for c in conv]

    def logits(rows: np.ndarray, tables) -> np.ndarray:
        out = []
        for i in range(0, len(rows), 64):
            part = [docs[r] for r in rows[i : i + 64]]
            bounds = np.cumsum([0, *map(len, part)])
            out.append(pooled(np.concatenate([*part, np.zeros((0, KINDS), np.int64)]).astype(np.int64), bounds, tables, bias)[0] @ weights + intercept[0])
        return np.concatenate([*out, np.zeros(0)])

    epochs = max(EPOCHS, min(20, -(-MIN_STEPS * BATCH // len(fit))))
    for epoch in range(epochs):
        order = rng.permutation(fit)
        for i in range(0, len(order), BATCH):
            batch = order[i : i + BATCH]
            part = [docs[r] for r in batch]
            bounds = np.cumsum([0, *map(len, part)])
            ids = np.concatenate([*part, np.zeros((0, KINDS), np.int64)]).astype(np.int64)
            if not len(ids):
                continue
            seen, local = np.unique(ids, return_inverse=True)
            local = local.reshape(ids.shape)
            sub = emb[seen]
            tables = [[sub @ c[j] for j in range(len(c))] for c in conv]
            hidden, where = pooled(local, bounds, tables, bias, positions=True)
            z = hidden @ weights + intercept[0]
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[batch]) / len(batch)
            grad = [np.zeros_like(sub), *[np.zeros_like(c) for c in conv], np.zeros_like(bias), hidden.T @ d, np.array([d.sum()], np.float32)]
            back, col = d[:, None] * weights[None, :], 0
            for c, g in zip(conv, grad[1:], strict=False):
                at, up = where[:, col : col + FILTERS], back[:, col : col + FILTERS]
                row, f = np.nonzero(at >= 0)
                for j in range(len(c)):
                    pos = at[row, f] + j
                    ok = pos < bounds[row + 1]
                    word, ff, u = local[pos[ok]], f[ok], up[row[ok], f[ok]]
                    for kind in range(KINDS):
                        np.add.at(grad[0], word[:, kind], u[:, None] * c[j][:, ff].T)
                        np.add.at(g[j].T, ff, u[:, None] * sub[word[:, kind]])
                np.add.at(grad[-3], col + f, up[row, f])
                col += FILTERS
            step += 1
            lr = 0.01 / (1 + epoch)
            for p, g, a, b in zip(params, grad, m1, m2, strict=True):
                where_ = seen if p is emb else slice(None)
                a[where_] = 0.9 * a[where_] + 0.1 * g
                b[where_] = 0.99 * b[where_] + 0.01 * g * g
                p[where_] -= lr * (a[where_] / (1 - 0.9**step)) / (np.sqrt(b[where_] / (1 - 0.99**step)) + 1e-6)
    tables = tables_of()
    rows = np.flatnonzero(hold) if hold.any() and 0 < labels[hold].sum() < hold.sum() else np.arange(len(docs))
    z, y, lang = logits(rows, tables), labels[rows], langs[rows]
    overall = best_threshold(z, y)
    thresholds = np.array([best_threshold(z[lang == c], y[lang == c], overall) for c in range(k + 1)])
    return Model(tuple(tuple(t) for t in tables), bias, weights, float(intercept[0]), thresholds)


def kept_out(n: int) -> np.ndarray:
    """The rows of the training sample that are not fitted."""
    return np.arange(n) % 5 == 4


def association(docs: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """By bucket: standardised surplus of toxic documents that hold it."""
    n, n1 = len(docs), float(labels.sum())
    held, toxic = np.zeros(KINDS * BUCKETS), np.zeros(KINDS * BUCKETS)
    for ids, y in zip(docs, labels, strict=True):
        seen = np.unique(ids)
        held[seen] += 1
        toxic[seen] += y
    rate = held / max(n, 1)
    return ((toxic - n1 * rate) / np.sqrt(n1 * rate * (1 - rate) + 0.5)).astype(np.float32)


def best_threshold(z: np.ndarray, y: np.ndarray, default: float = 0.0) -> float:
    """The middle of the best F1 gap; ``default`` with fewer than 20 rows or 5 of either label."""
    if len(z) < 20 or min(y.sum(), len(y) - y.sum()) < 5:
        return default
    order = np.argsort(-z, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(z) + 1) + y.sum())
    i = int(f1.argmax())
    below = z[order[i + 1]] if i + 1 < len(z) else z[order[i]] - 1
    return float((z[order[i]] + below) / 2)


def binned_threshold(clean: np.ndarray, toxic: np.ndarray, rate: tuple[float, float], default: float) -> float:
    """The middle of the best F1 gap of two histograms of logits, whose rows weigh ``rate`` (clean, toxic).

    ``default`` with fewer than 20 rows or 5 of either label.
    """
    if clean.sum() + toxic.sum() < 20 or min(clean.sum(), toxic.sum()) < 5:
        return default
    held = np.flatnonzero(clean + toxic)[::-1]
    hits, false = np.cumsum(toxic[held]) * rate[1], np.cumsum(clean[held]) * rate[0]
    i = int((2 * hits / (hits + false + hits[-1])).argmax())
    low = held[i] - BINS // 2
    below = held[i + 1] - BINS // 2 + 1 if i + 1 < len(held) else low - 1
    return float((low + below) / 2 * BIN)


def calibrate(docs: DataFrame, marked: DataFrame, model: Model, used: list[str], id_col: str, text_col: str) -> Model:
    """``model`` with thresholds from all rows of ``docs`` that ``marked`` (_lid, _toxic) labels, but for the ids ``used``.

    Documents are scored before the join, so that no text is shuffled. The rows weigh as much as makes up the label's share
    among all labelled rows of the language, the fitted ones too.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z, lang = logits_of(shared.value, b.column("_text"))
            at = np.clip(np.floor(z / BIN) + BINS // 2, 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("_did"), pa.array(lang.astype(np.int32)), pa.array(at)], ["_did", "lang", "bin"])

    source = docs.select(F.col(id_col).alias("_did"), F.col(text_col).alias("_text")).filter(F.col("_did").isNotNull() & (crc_fold("_did", 4) != 2))
    scored = source.mapInArrow(run, f"_did {docs.schema[id_col].dataType.simpleString()}, lang int, bin int")
    fitted = F.broadcast(spark.createDataFrame([(x,) for x in used], "_used string").distinct())
    flagged = marked.join(fitted, F.col("_lid").cast("string") == F.col("_used"), "left")
    joined = scored.join(flagged, F.col("_did") == F.col("_lid"))
    found = joined.groupBy("lang", "bin", (F.col("_toxic") > 0).cast("int").alias("toxic"), F.col("_used").isNotNull().alias("used")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    lang, at, toxic, used_, n = (found[c].to_numpy() for c in ("lang", "bin", "toxic", "used", "n"))
    k = len(FUNCTION_WORDS) + 1
    total = np.bincount(lang * 2 + toxic, weights=n, minlength=2 * k).reshape(k, 2)
    free = ~used_.astype(bool)
    counts = np.bincount(((lang * 2 + toxic) * BINS + at)[free], weights=n[free], minlength=2 * k * BINS).reshape(k, 2, BINS)

    def best(whole: np.ndarray, bins: np.ndarray, default: float) -> float:
        rate = whole / np.maximum(bins.sum(1), 1)
        return binned_threshold(bins[0], bins[1], (rate[0], rate[1]), default)

    overall = best(total.sum(0), counts.sum(0), float("nan"))
    fallback = model.thresholds if np.isnan(overall) else np.full(k, overall)
    return replace(model, thresholds=np.array([best(total[c], counts[c], float(fallback[c])) for c in range(k)]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_TRAIN_ROWS) -> Model:
    """Train on a bounded sample of labelled rows outside fold 2 of 4: half toxic and half clean as far as there are such.
    The thresholds are calibrated on all labelled rows outside that fold that are not fitted.

    Conflicting or repeated labels of one id: the highest counts. Rows without a label or text row are not used.
    """
    batched(docs.sparkSession)
    marked = labels.filter(F.col("toxic").isNotNull() & F.col(id_col).isNotNull() & (crc_fold(id_col, 4) != 2))
    marked = marked.groupBy(F.col(id_col).alias("_lid")).agg(F.max("toxic").cast("int").alias("_toxic"))
    order = F.xxhash64("_lid")
    sample = marked.filter("_toxic = 1").orderBy(order, "_lid").limit(max_rows // 2).unionAll(marked.filter("_toxic = 0").orderBy(order, "_lid").limit(max_rows // 2))
    texts = docs.select(F.col(id_col).alias("_did"), F.col(text_col).alias("_text")).join(F.broadcast(sample), F.col("_did") == F.col("_lid")).select("_did", "_toxic", "_text")

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = arrays.text_buffers(b.column("_text"))
            found, h, bounds = features(data, offsets)
            lang = languages(h, bounds)
            blobs = [found[bounds[i] : bounds[i + 1]].tobytes() for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column("_did").cast(pa.string()), b.column("_toxic"), pa.array(blobs, pa.binary()), pa.array(lang.astype(np.int32))], ["id", "toxic", "ids", "lang"])

    rows = texts.mapInArrow(ids, "id string, toxic int, ids binary, lang int").toArrow().to_pandas()
    rows = rows.sort_values(["id", "ids"]).drop_duplicates("id").sample(frac=1.0, random_state=5) if len(rows) else rows
    model = train([np.frombuffer(x, np.int32).reshape(-1, KINDS) for x in rows["ids"]], rows["toxic"].to_numpy(np.float32), rows["lang"].to_numpy(np.int64))
    if not model.weights.any():
        return model  # one label only
    return calibrate(docs, marked, model, rows["id"][~kept_out(len(rows))].tolist(), id_col, text_col)


def logits_of(model: Model, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The logits and the languages of a text column."""
    data, offsets = arrays.text_buffers(col)
    out, lang = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1, np.int64)
    for i, j in arrays.chunks(offsets):
        ids, h, bounds = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        hidden, _ = pooled(ids, bounds, model.tables, model.bias)
        out[i:j] = hidden.astype(np.float64) @ model.weights.astype(np.float64) + model.intercept
        lang[i:j] = languages(h, bounds)
    return out, lang


def score_batch(model: Model, col: pa.Array) -> np.ndarray:
    """Calibrated scores of a text column: 0.3 is each language's threshold."""
    z, lang = logits_of(model, col)
    return 1 / (1 + np.exp(-np.clip(z - model.thresholds[lang] + np.log(THRESHOLD / (1 - THRESHOLD)), -40, 40)))


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score and predicted of every document, from its whole text.

    Null and empty texts get the score of an all-zero text. Ids may be null or repeated: every row gets a row. Other
    columns are not read. An empty table gives an empty result.
    """
    batched(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = score_batch(shared.value, b.column("_text"))
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("held_out"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], [id_col, "held_out", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("_id"), (crc_fold(id_col, 4) == 2).alias("held_out"), F.col(text_col).alias("_text"))
    return source.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents whose predicted label is not toxic, with their own columns, in one pass and without a shuffle."""
    batched(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = score_batch(shared.value, b.column(text_col)) < THRESHOLD
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
