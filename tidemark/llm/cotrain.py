"""Quality classifier by co-training (operator 1).

Two views of a document are kept apart: its text (hashed word shapes and marks) and its page metadata (language, source, length).
A logistic model is fitted to each view on labelled documents. Over `ROUNDS` rounds each model labels all unlabelled documents, and
those it is sure of - calibrated, beyond `SURE` - become training rows of the *other* model, however many they are. In the end both views are
calibrated on labelled documents held out from training, their log-odds are combined by a third small model, and every document of
the table is scored.

Labelled documents are a bounded sample: `LABELLED` at most, those with the smallest digests of their ids, so the same ones whatever
the partitioning. Unlabelled documents all take part: their features are written once, every Newton step is a pass over them in which
each task derives their pseudo-labels from the models of the rounds before and adds up gradient and Hessian, and the driver gets
`PARTS` sums, however large the table is. Scoring is one pass over all whole texts without a shuffle.

Rows: a null text has no features and is scored by its metadata; null metadata is a value of its own. Repeated rows get equal scores;
of several labels of one document the lowest holds, labels without document and null labels are left out. With fewer than two
classes among the labels every document gets the share of good labels (1.0 without any). An empty table gives no rows. Extra columns
pass through; those named like outputs are replaced.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.shared import written
from tidemark.llm.tokens import slices

LABELLED, ROUNDS, SURE, KEEP_FROM, PARTS, NEWTON = 6_000, 3, 0.97, 0.5, 8, 12
WIDTH, META_WIDTH = 512, 128
#: Letters and digits by kind: a word becomes its shape ("Word," -> "Aa,"), runs are written once.
_SHAPE = bytes(97 if 97 <= i <= 122 or i >= 128 else 65 if 65 <= i <= 90 else 48 if 48 <= i <= 57 else i for i in range(256))
_RUNS = re.compile(rb"(.)\1+", re.S)
_SLOTS: dict[bytes, int] = {}


def text_view(text: str | None) -> np.ndarray:
    """Square roots of the shares of hashed word shapes, and a few whole-text shares."""
    out = np.zeros(WIDTH, np.float32)
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    if not words:
        return out
    shapes = Counter(_RUNS.sub(rb"\1", raw.translate(_SHAPE)).split())
    n = len(words)
    for shape, times in shapes.items():
        slot = _SLOTS.get(shape)
        if slot is None:
            slot = zlib.crc32(shape[:64]) % (WIDTH - 8)
            if len(_SLOTS) < 200_000:
                _SLOTS[shape] = slot
        out[slot] += times
    out = np.sqrt(out / n)
    out[-8:-2] = np.log1p(n) / 10, len(set(words)) / n, len(raw) / n / 10, len(shapes) / n, raw.count(b"\n") / n, min(1.0, n / 50)
    return out


def meta_view(lang, source, n_chars) -> np.ndarray:
    out = np.zeros(META_WIDTH, np.float32)
    for i, value in enumerate((f"lang={lang}", f"source={source}", f"both={lang}/{source}", f"size={-1 if n_chars is None else int(np.log2(max(n_chars, 0) + 1) * 2)}")):
        out[(zlib.crc32(value.encode()) + i) % META_WIDTH] += 1
    return out


class Logistic:
    """Weights by Newton-preconditioned gradient steps on a bounded matrix; ridge penalty."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 2.0, steps: int = 12):
        z = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
        self.w = np.zeros(z.shape[1])
        ridge = np.full(z.shape[1], penalty)
        ridge[-1] = 1e-3
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            hess = (z * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ z + np.diag(ridge)
            step = np.linalg.solve(hess, z.T @ (weight * (y - p)) - ridge * self.w)
            self.w += step
            if np.abs(step).max() < 1e-6:
                break

    def logit(self, x: np.ndarray) -> np.ndarray:
        return x @ self.w[:-1] + self.w[-1]


def calibration(logits: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset (Platt) of held-out logits."""
    m = Logistic(np.clip(logits, -20, 20)[:, None], y, np.ones(len(y)), penalty=0.05)
    return float(m.w[0]), float(m.w[1])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def pseudo_labels(history: list, views: list[np.ndarray]) -> list[np.ndarray]:
    """Per view the labels given by the other one in the rounds of `history`; NaN without. A document is labelled once."""
    free, given = np.ones(len(views[0]), bool), [np.full(len(x), np.nan) for x in views]
    for models in history:
        for v, (w, slope, offset) in enumerate(models):
            p = sigmoid(slope * (views[v] @ w[:-1] + w[-1]) + offset)
            for label, sure in ((1.0, p), (0.0, 1 - p)):
                take = free & (sure >= SURE)
                given[1 - v][take] = label
                free &= ~take
    return given


def newton_sums(x: np.ndarray, y: np.ndarray, w: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the log-likelihood of some rows."""
    z = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
    scaled = z * (weight * np.maximum(p * (1 - p), 1e-4)).astype(z.dtype)[:, None]
    return z.T.astype(np.float64) @ (weight * (y - p)), (scaled.T @ z).astype(np.float64)


def unpacked(column: pa.Array) -> list[np.ndarray]:
    x = np.frombuffer(b"".join(column.to_pylist()), np.float16).reshape(-1, WIDTH + META_WIDTH).astype(np.float32)
    return [x[:, :WIDTH], x[:, WIDTH:]]


def pool_sums(pool: DataFrame, history: list, weights: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Per view gradient, Hessian and number of all pseudo-labelled rows of `pool`. One row per core is shuffled, PARTS reach the driver."""
    sizes = [len(w) for w in weights]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [[np.zeros(n), np.zeros((n, n)), np.zeros(1)] for n in sizes]
        for b in batches:
            views = unpacked(b.column("x"))
            for v, label in enumerate(pseudo_labels(history, views)):
                rows = ~np.isnan(label)
                if rows.any():
                    for t, part in zip(total[v], (*newton_sums(views[v][rows], label[rows], weights[v], 0.5), rows.sum())):
                        t += part
        yield pa.RecordBatch.from_pydict({"sums": pa.array([b"".join(t.tobytes() for view in total for t in view)], pa.binary())})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for raw in b.column("sums").to_pylist():
                total = np.frombuffer(raw) + (0 if total is None else total)
        if total is not None:
            yield pa.RecordBatch.from_pydict({"sums": pa.array([total.tobytes()], pa.binary())})

    cores = pool.sparkSession.sparkContext.defaultParallelism
    parts = pool.select("x").coalesce(cores).mapInArrow(add, "sums binary").repartition(PARTS).mapInArrow(merge, "sums binary").collect()
    flat = sum((np.frombuffer(bytes(r["sums"])) for r in parts), np.zeros(sum(n + n * n + 1 for n in sizes)))
    out, at = [], 0
    for n in sizes:
        out.append((flat[at : at + n], flat[at + n : at + n + n * n].reshape(n, n), int(flat[at + n + n * n])))
        at += n + n * n + 1
    return out


def refit(views: list[np.ndarray], y: np.ndarray, pool: DataFrame, history: list) -> tuple[list[np.ndarray], int]:
    """Weights of both views on labelled rows and all pseudo-labelled ones, from the weights of the last round; number of pseudo-labels."""
    weights = [w.copy() for w, _, _ in history[-1]]
    for _ in range(NEWTON):
        far = 0.0
        sums = pool_sums(pool, history, weights)
        for v, (gradient, hessian, _) in enumerate(sums):
            ridge = np.full(len(weights[v]), 2.0)
            ridge[-1] = 1e-3
            own = newton_sums(views[v].astype(np.float64), y, weights[v], 1.0)
            step = np.linalg.solve(own[1] + hessian + np.diag(ridge), own[0] + gradient - ridge * weights[v])
            weights[v] = weights[v] + step
            far = max(far, float(np.abs(step).max()))
        if far < 1e-2:
            break
    return weights, sum(n for *_, n in sums)


def cotrain(views: list[np.ndarray], y: np.ndarray, pool: DataFrame) -> tuple[list[tuple[np.ndarray, float, float]], np.ndarray]:
    """Per view (weights, slope, offset), and the weights that combine the calibrated log-odds. Every third labelled row is held out."""
    held = np.arange(len(y)) % 3 == 0
    if len(np.unique(y[held])) < 2 or len(np.unique(y[~held])) < 2:
        held = np.zeros(len(y), bool)
    fit, test = ~held, held if held.any() else ~held
    scaled = lambda weights: [(w, *calibration(x[test] @ w[:-1] + w[-1], y[test])) for w, x in zip(weights, views)]
    history, known = [scaled([Logistic(x[fit], y[fit], np.ones(fit.sum())).w for x in views])], 0
    for _ in range(ROUNDS):
        weights, given = refit([x[fit] for x in views], y[fit], pool, history)
        if given == known:  # nothing was added
            break
        known = given
        history.append(scaled(weights))
    models = history[-1]
    odds = np.column_stack([np.clip(a * (x[test] @ w[:-1] + w[-1]) + b, -20, 20) for (w, a, b), x in zip(models, views)])
    return models, Logistic(odds, y[test], np.ones(len(odds)), penalty=0.05).w


def fit(docs: DataFrame, labels: DataFrame) -> tuple | float:
    """The model from a bounded sample of labelled and all unlabelled documents; a number where the labels have fewer than two classes."""
    known = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    draw = F.xxhash64("doc_id")
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    ids = docs.select("doc_id").filter("doc_id is not null").distinct()
    labelled = ids.join(known, "doc_id").orderBy(draw, "doc_id").limit(LABELLED)
    chosen = {r["doc_id"]: r["quality"] for r in labelled.collect()}  # LABELLED numbers at most
    y = np.array([float(chosen[d] > 0) for d in sorted(chosen)])
    if len(np.unique(y)) < 2:
        return float(y.mean()) if len(y) else 1.0
    wanted = docs.sparkSession.createDataFrame([(i,) for i in chosen], "doc_id long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2_000_000):
            rows = [(d, text_view(t).astype(np.float16).tobytes() + meta_view(*m).astype(np.float16).tobytes()) for d, t, *m in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "lang", "source", "n_chars")))]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "x": pa.array([r[1] for r in rows], pa.binary())})

    features = written(docs.select("doc_id", "text", "lang", "source", "n_chars").mapInArrow(run, "doc_id long, x binary"), "cotraining-features")
    made = features.join(wanted.hint("broadcast"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("x").alias("x")).collect()
    made = sorted((r["doc_id"], bytes(r["x"])) for r in made)
    x = np.array([np.frombuffer(b, np.float16) for _, b in made], np.float32).reshape(-1, WIDTH + META_WIDTH)
    pool = written(features.join(known.select("doc_id"), "doc_id", "left_anti").select("x"), "cotraining-pool")
    return cotrain([x[:, :WIDTH], x[:, WIDTH:]], y, pool)


def score(docs: DataFrame, model: tuple | float, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all by default), text_score, meta_score, score and kept."""
    out = ("text_score", "meta_score", "score", "kept")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in out]
    schema = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(c, T.DoubleType()) for c in out[:3]), T.StructField("kept", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2_000_000):
            n = b.num_rows
            if isinstance(model, float):
                scores = [np.full(n, model)] * 3
            else:
                views, mix = model
                xs = [np.array([text_view(t) for t in b.column("text").to_pylist()]), np.array([meta_view(*m) for m in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "n_chars")))])]
                odds = [np.clip(a * (x @ w[:-1] + w[-1]) + c, -20, 20) for x, (w, a, c) in zip(xs, views)]
                scores = [*(sigmoid(o) for o in odds), sigmoid(np.column_stack(odds) @ mix[:-1] + mix[-1])]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array(s) for s in scores), pa.array(scores[2] >= KEEP_FROM)], [*keep, *out])

    return docs.select(*dict.fromkeys([*keep, "text", "lang", "source", "n_chars"])).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None) -> DataFrame:
    return score(docs, fit(docs, labels), keep)
