"""Quality classifier by co-training of a text-content view and a page-metadata view.

The content view sees hashed byte trigrams of the lower-cased text. The metadata view sees language, source, length
and layout (lines, words, shares of capitals, digits and symbols, repetition). Each view is a logistic regression. They
start from labelled rows; in every round each view scores all other documents, in tasks, and hands those it is most
sure of, with its label, to the other view. Afterwards each view is calibrated on labelled rows it has not seen, the
calibrated log odds are added, and the sum is calibrated once more. All documents are then scored in place, without a
shuffle.

A fit runs in one task a view, on at most ``max_labelled`` labelled documents (those whose ids come first by hash) and on
``handed`` documents a round from the other view (the most confident of all, at least ``sure``, in the proportion of the
labelled ones). Everything else covers all rows. The driver holds two weight vectors and the handed documents' keys.

Defined cases: a null or blank text has score 0, is rejected and teaches nothing; null language or source is a value of
its own; a document labelled twice with different values teaches nothing; null labels are no labels; a label of a
repeated id goes with one of its texts, the first by hash; rows without id teach nothing; without labels of both kinds
nothing can be learned, every non-blank document gets score 1 and is kept; repeated rows are scored each, and handed over
once; very long texts are read whole; an empty table gives an empty result. Only the named columns are read, whatever
others there are, and ``keep_columns`` returns those as they came.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotegrid.llm.common import gram_counts, stage

MAX_LABELLED, ROUNDS, HANDED, SURE = 4000, 2, 300, 0.95
BUCKETS = 1024
HASHED = 64
FEW_WORDS = 5
LAYOUT = 12


# ---------------------------------------------------------------- the two views
def content_view(text: str) -> np.ndarray:
    """Log frequencies of byte trigrams, scaled to length one."""
    counts = gram_counts(text.lower().encode("utf-8", "surrogatepass"), (3,), BUCKETS)
    x = np.log1p(counts).astype(np.float32)
    return x / max(float(np.sqrt(x @ x)), 1e-9)


_CLASS = np.zeros(256, dtype=np.uint8)  # 1 capital, 2 digit, 3 symbol, 4 white space, 0 other
for _b in range(128):
    _CLASS[_b] = 1 if chr(_b).isupper() else 2 if chr(_b).isdigit() else 4 if chr(_b).isspace() else 0 if chr(_b).isalpha() else 3


def metadata_view(text: str, lang: str | None, source: str | None) -> np.ndarray:
    raw = text.encode("utf-8", "surrogatepass")
    kinds = np.bincount(_CLASS[np.frombuffer(raw, dtype=np.uint8)], minlength=5) / max(len(raw), 1)
    words, lines = text.split(), text.splitlines() or [""]
    n = max(len(words), 1)
    out = np.zeros(LAYOUT + 2 * HASHED, dtype=np.float32)
    out[:LAYOUT] = [
        np.log1p(len(text)) / 10,
        np.log1p(len(lines)) / 5,
        np.log1p(len(text) / len(lines)) / 10,
        sum(map(len, words)) / n / 10,
        kinds[1] * 4,
        kinds[2] * 4,
        kinds[3] * 4,
        kinds[4],
        len(set(lines)) / len(lines),
        len(set(words)) / n,
        sum(map(str.isupper, words)) / n,
        (len(words) - sum(map(str.isalnum, [w[-1] for w in words]))) / n,
    ]
    out[LAYOUT + zlib.crc32(f"lang={lang}".encode()) % HASHED] = 0.5
    out[LAYOUT + HASHED + zlib.crc32(f"source={source}".encode()) % HASHED] = 0.5
    return out


# ---------------------------------------------------------------- learning
def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 400) -> np.ndarray:
    """Weights and, last, the intercept; both classes weigh the same; accelerated gradient."""
    x = np.hstack((x, np.ones((len(x), 1), dtype=x.dtype))).astype(np.float32)
    # products in single precision: mixed ones would copy the whole matrix each time
    times = lambda v: (x @ v.astype(np.float32)).astype(np.float64)
    times_transposed = lambda u: (u.astype(np.float32) @ x).astype(np.float64)
    share = max(min(float(y.mean()), 1 - 1e-6), 1e-6)
    weight = np.where(y > 0.5, 0.5 / share, 0.5 / (1 - share)) / len(y)
    penalty = np.full(x.shape[1], ridge / len(y))
    penalty[-1] = 0
    v = np.ones(x.shape[1])
    for _ in range(20):
        v = times_transposed(weight * times(v))
        v /= np.linalg.norm(v)
    step = 1 / (0.25 * float(np.linalg.norm(times_transposed(weight * times(v)))) + float(penalty.max()) + 1e-9)
    w = np.zeros(x.shape[1])
    z, t = w, 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(times(z), -40, 40)))
        new = z - step * (times_transposed(weight * (p - y)) + penalty * z)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    return w


def _raw(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return (x @ w[:-1].astype(np.float32)).astype(np.float64) + float(w[-1])


def _calibrate(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic curve through scores (Newton, targets drawn in from 0 and 1)."""
    good, bad = float((y > 0.5).sum()), float((y <= 0.5).sum())
    target = np.where(y > 0.5, (good + 1) / (good + 2), 1 / (bad + 2))
    x = np.column_stack((score, np.ones(len(score))))
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        move = np.linalg.solve(h, x.T @ (p - target) + 1e-3 * (w - [1.0, 0.0]))
        w = w - np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-9:
            break
    return float(max(w[0], 1e-3)), float(w[1])


@dataclass
class QualityModel:
    content: np.ndarray | None
    metadata: np.ndarray | None
    curves: tuple[tuple[float, float], ...] = ()
    prior: float = 0.0  # log odds of good quality among the labelled rows

    def score(self, text: str | None, lang: str | None, source: str | None) -> tuple[float, float, float]:
        """Calibrated probabilities of good quality: content, metadata, both."""
        if text is None or not text.strip():
            return 0.0, 0.0, 0.0
        if self.content is None:
            return 1.0, 1.0, 1.0
        (a, b), (c, d), (e, f) = self.curves
        one = a * float(_raw(self.content, content_view(text))) + b
        two = c * float(_raw(self.metadata, metadata_view(text, lang, source))) + d
        # a few words are little evidence: their log odds are drawn towards the prior's
        n = len(text.split())
        both = (n * (e * (one + two) + f) + FEW_WORDS * self.prior) / (n + FEW_WORDS)
        return tuple(float(1 / (1 + np.exp(-np.clip(v, -40, 40)))) for v in (one, two, both))


# ---------------------------------------------------------------- fits, in tasks
WIDTHS = (BUCKETS, LAYOUT + 2 * HASHED)
TAUGHT = "view int, key string, label double, hold boolean, handed boolean, x binary"
FITTED = "view int, weights binary, slope double, shift double, held binary, held_labels binary"


def _taught(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each view of a text that has a label, or only for the view it is handed to."""
    for batch in batches:
        rows = []
        for key, label, hold, taker, text, lang, source in zip(
            *(batch[c] for c in ("key", "label", "hold", "taker", "text", "lang", "source"))
        ):
            for view in (0, 1):
                if taker in (view, -1):
                    x = content_view(text) if view == 0 else metadata_view(text, lang, source)
                    rows.append((view, key, label, hold, taker >= 0, x.tobytes()))
        yield pd.DataFrame(rows, columns=["view", "key", "label", "hold", "handed", "x"])


def fit_view(view: int, x: np.ndarray, label: np.ndarray, hold: np.ndarray, handed: np.ndarray) -> tuple:
    """(weights, (slope, shift), raw scores of the rows kept for calibration, their labels); rows in a fixed order."""
    learn, held = ~hold & ~handed, hold & ~handed
    if len(np.unique(label[learn])) < 2 or len(np.unique(label[held])) < 2:
        learn = held = ~handed
    fitted = learn | handed
    w = logistic(x[fitted], label[fitted])
    raw = _raw(w, x[held])
    return w, _calibrate(raw, label[held]), raw, label[held]


def _fit(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["handed", "key", "label"], kind="stable")
    view = int(rows["view"].iloc[0])
    x = np.frombuffer(b"".join(rows["x"]), dtype=np.float32).reshape(len(rows), WIDTHS[view])
    w, (slope, shift), raw, labels = fit_view(
        view, x, rows["label"].to_numpy(float), rows["hold"].to_numpy(bool), rows["handed"].to_numpy(bool)
    )
    return pd.DataFrame(
        [(view, w.tobytes(), slope, shift, raw.tobytes(), labels.tobytes())],
        columns=["view", "weights", "slope", "shift", "held", "held_labels"],
    )


@dataclass
class Fitted:
    """Both views after a round: weights, calibration, and raw scores and labels of the rows kept for it."""

    weights: list[np.ndarray]
    curves: list[tuple[float, float]]
    held: list[np.ndarray]
    labels: np.ndarray


def _fits(taught: DataFrame) -> Fitted:
    got = sorted(taught.groupBy("view").applyInPandas(_fit, FITTED).collect(), key=lambda r: r["view"])
    return Fitted(
        [np.frombuffer(r["weights"]) for r in got],
        [(r["slope"], r["shift"]) for r in got],
        [np.frombuffer(r["held"]) for r in got],
        np.frombuffer(got[0]["held_labels"]),
    )


def combined(fitted: Fitted, share_good: float) -> QualityModel:
    """Calibrated views and a curve through their sum."""
    odds = [a * raw + b for (a, b), raw in zip(fitted.curves, fitted.held)]
    curves = [*fitted.curves, _calibrate(odds[0] + odds[1], fitted.labels)]
    prior = float(np.log(share_good / (1 - share_good)))
    return QualityModel(*(w.astype(np.float32) for w in fitted.weights), tuple(curves), prior)


Quota = dict[tuple[int, int], int]  # (taker, label) -> how many


CONFIDENT = pa.schema([("taker", pa.int32()), ("label", pa.int32()), ("strength", pa.float64()), ("key", pa.string())])
SLICE = 256  # rows of a batch that are Python objects at a time


def _rows(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            yield from zip(*(part.column(c).to_pylist() for c in columns))


def _confident(fitted: Fitted, taken: Sequence[frozenset[str]], quota: Quota, sure: float):
    """The most confident rows of a task for each taker and label; equal rows once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], dict[str, float]] = {k: {} for k in quota}

        def first(found: dict[str, float], n: int) -> dict[str, float]:
            return dict(sorted(found.items(), key=lambda kv: (-kv[1], kv[0]))[:n])

        for key, text, lang, source in _rows(batches, "key", "text", "lang", "source"):
            if not text.strip():
                continue
            for view in (0, 1):
                taker = 1 - view
                if key in taken[taker]:
                    continue
                x = content_view(text) if view == 0 else metadata_view(text, lang, source)
                chance = chance_of(fitted, view, x)
                for label, strength in ((1, chance), (0, 1 - chance)):
                    if strength >= sure:
                        found = best[taker, label]
                        found[key] = strength
                        if len(found) > 4 * quota[taker, label]:
                            best[taker, label] = first(found, quota[taker, label])
        rows = [(t, y, s, k) for (t, y), found in best.items() for k, s in first(found, quota[t, y]).items()]
        yield pa.RecordBatch.from_pylist([dict(zip(CONFIDENT.names, r)) for r in rows], schema=CONFIDENT)

    return run


def chance_of(fitted: Fitted, view: int, x: np.ndarray) -> float:
    """Calibrated probability of good quality by one view, in nine digits."""
    slope, shift = fitted.curves[view]
    odds = slope * float(_raw(fitted.weights[view], x)) + shift
    return round(float(1 / (1 + np.exp(-np.clip(odds, -40, 40)))), 9)


def learn_quality(
    docs: DataFrame,
    labels: DataFrame,
    max_labelled: int = MAX_LABELLED,
    rounds: int = ROUNDS,
    handed: int = HANDED,
    sure: float = SURE,
) -> QualityModel:
    """Model from labels (doc_id, quality 0 or 1) and all documents."""
    spark = docs.sparkSession
    texts = docs.select(
        F.col("doc_id").cast("string").alias("id"),
        F.concat_ws(":", F.col("doc_id").cast("string"), F.md5(F.col("text").cast("string"))).alias("key"),
        *(F.col(c).cast("string").alias(c) for c in ("text", "lang", "source")),
    ).where(F.col("id").isNotNull() & F.col("text").rlike(r"\S"))
    labelled = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy(F.col("doc_id").cast("string").alias("id"))
        .agg(F.min("quality").alias("q"), F.max("quality").alias("q2"))
        .where("q = q2")
        .select("id", (F.col("q") > 0.5).cast("double").alias("label"))
        .join(texts.select("id"), "id", "left_semi")
    )
    chosen = stage(labelled.orderBy(F.xxhash64("id"), "id").limit(max_labelled), "labelled")
    counts = {r["label"]: r["count"] for r in chosen.groupBy("label").count().collect()}
    if len(counts) < 2:
        return QualityModel(None, None)
    # at most ``max_labelled`` rows, so they may be broadcast; of a repeated id, one text
    one = (
        texts.join(F.broadcast(chosen), "id")
        .groupBy("id", "label")
        .agg(F.min_by(F.struct("key", "text", "lang", "source"), "key").alias("row"))
        .select(
            F.col("row.key").alias("key"), "label", (F.crc32(F.col("id").cast("binary")) % 5 == 0).alias("hold"),
            F.lit(-1).alias("taker"), "row.text", "row.lang", "row.source",
        )
    )
    taught = stage(one.mapInPandas(_taught, TAUGHT), "taught")
    pool = texts.join(F.broadcast(chosen.select("id")), "id", "left_anti").select("key", "text", "lang", "source")
    share = counts[1.0] / (counts[0.0] + counts[1.0])
    quota: Quota = {(t, y): max(1, int(handed * (share if y else 1 - share))) for t in (0, 1) for y in (0, 1)}
    taken: list[frozenset[str]] = [frozenset(), frozenset()]
    fitted = _fits(taught)
    for _ in range(rounds):
        found = stage(pool.mapInArrow(_confident(fitted, taken, quota, sure), "taker int, label int, strength double, key string"), "confident")
        found = found.dropDuplicates(["taker", "label", "key"])
        top = [
            r
            for (t, y), n in quota.items()
            for r in found.where((F.col("taker") == t) & (F.col("label") == y)).orderBy(F.desc("strength"), "key").limit(n).collect()
        ]
        if not top:
            break
        taken = [taken[t] | {r["key"] for r in top if r["taker"] == t} for t in (0, 1)]
        # at most 2 x ``handed`` rows
        given = spark.createDataFrame([(r["key"], r["taker"], float(r["label"])) for r in top], "key string, taker int, label double")
        picked = (
            pool.join(F.broadcast(given), "key")
            .groupBy("key", "taker", "label")
            .agg(F.first(F.struct("text", "lang", "source")).alias("row"))
            .select("key", "label", F.lit(False).alias("hold"), "taker", "row.text", "row.lang", "row.source")
        )
        taught = taught.unionByName(stage(picked.mapInPandas(_taught, TAUGHT), "handed"))
        fitted = _fits(taught)
    good, bad = counts[1.0], counts[0.0]
    return combined(fitted, (good + 1) / (good + bad + 2))


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = 0.5, keep_columns: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, content_score, metadata_score, score, kept.

    ``keep_columns`` returns the documents' own columns instead, for the kept rows only.
    """
    if keep_columns:

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([model.score(*row)[2] >= threshold for row in _rows(iter([batch]), "text", "lang", "source")], pa.bool_()))

        return docs.mapInArrow(keep, docs.schema)

    rows = docs.select("doc_id", "text", "lang", "source")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [model.score(t, a, b) for t, a, b in zip(batch["text"], batch["lang"], batch["source"])]
            out = batch[["doc_id"]].copy()
            for k, name in enumerate(("content_score", "metadata_score", "score")):
                out[name] = [f[k] for f in found]
            out["kept"] = out["score"] >= threshold
            yield out

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInPandas(
        run, f"doc_id {kind}, content_score double, metadata_score double, score double, kept boolean"
    )
