"""Language identification with error-correcting output codes.

Every language has a codeword of bits. A binary n-gram classifier (multinomial log odds over hashed byte n-grams of
the lower-cased letters) predicts each bit; the counts of all of them come from one pass over all training texts,
summed per (language, bucket). Decoding is loss-weighted: the codeword with the smallest logistic loss over the bits'
margins wins, each bit weighted by how well its two sides separate. A prediction whose runner-up is close is flagged
as ambiguous.

The model holds (bits x buckets) weights and (languages x bits) codewords. Counts by (language, bucket) are a table, and
what is solved from them is solved bucket by bucket in tasks; languages are counted, and ``max_languages`` is checked,
before the driver gets their names. Prediction reads texts in place: no shuffle.

Defined cases: a null text or one without a letter is ``und`` with score 0, not ambiguous; rows with null language or
without letters teach nothing; with no training rows everything is ``und``; with one language every text with letters
gets it; ties go to the first language in sorted order; repeated rows are predicted each; only the named columns are
read, and a prediction sees nothing but the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotegrid.llm.common import gram_counts, shuffle_width, sorted_groups, stage

BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
UNKNOWN = "und"
MAX_LANGUAGES = 20_000
_LETTERS = bytes(b if chr(b).isalpha() or b >= 128 else 32 for b in range(256))


def letter_bytes(text: str | None) -> bytes | None:
    """Lower-cased letters, everything else in ASCII as single spaces; None for a text without letters."""
    if not text or not any(map(str.isalpha, text)):
        return None
    raw = text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS)
    return b" " + b" ".join(raw.split()) + b" "


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n x bits matrix of -1 and 1: the exhaustive code up to five languages, else the best of some random codes."""
    if n <= 1:
        return np.ones((n, 1), dtype=np.int8)
    if n <= 5:
        columns = range(1, 2 ** (n - 1))
        return np.array([[1 if i == 0 or not c >> (i - 1) & 1 else -1 for c in columns] for i in range(n)], np.int8)
    bits = int(np.ceil(10 * np.log2(n)))
    draw, best, best_distance = np.random.default_rng(seed), None, -1
    for _ in range(200):
        code = draw.choice(np.array([-1, 1], dtype=np.int8), (n, bits))
        both_sides = (code == 1).any(axis=0) & (code == -1).any(axis=0)
        apart = (bits - code.astype(int) @ code.T.astype(int)) // 2
        distance = int((apart + bits * np.eye(n, dtype=int)).min()) if both_sides.all() else -1
        if distance > best_distance:
            best, best_distance = code, distance
    return best


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits, log odds of a bit's 1
    reliability: np.ndarray  # bits, sums to 1
    scale: float

    def losses(self, counts: np.ndarray) -> np.ndarray:
        margin = self.scale * (counts @ self.weights) / max(counts.sum(), 1)
        agree = self.code * margin
        return (np.logaddexp(0, -agree) * self.reliability).sum(axis=1)

    def predict(self, text: str | None, ambiguous_below: float) -> tuple[str, float, bool]:
        raw = letter_bytes(text) if self.languages else None
        if raw is None:
            return UNKNOWN, 0.0, False
        loss = self.losses(gram_counts(raw, ORDERS, len(self.weights)))
        share = np.exp(-len(self.reliability) * (loss - loss.min()))
        share /= share.sum()
        order = np.argsort(-share, kind="stable")
        gap = share[order[0]] - (share[order[1]] if len(order) > 1 else 0.0)
        return self.languages[order[0]], float(share[order[0]]), bool(gap < ambiguous_below)


HELD = 64  # languages whose counts a task holds at a time


def _count_language_grams(buckets: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[str, np.ndarray] = {}

        def handed(lang: str) -> pd.DataFrame:
            counts = totals.pop(lang)
            at = np.flatnonzero(counts)
            return pd.DataFrame({"lang": lang, "bucket": at.astype(np.int32), "n": counts[at]})

        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                raw = letter_bytes(text)
                if raw is not None:
                    if lang not in totals and len(totals) >= HELD:
                        yield handed(next(iter(totals)))
                    totals[lang] = totals.get(lang, 0) + gram_counts(raw, ORDERS, buckets)
        for lang in list(totals):
            yield handed(lang)

    return run


def _sides(share: pd.Series, code: np.ndarray, base: np.ndarray):
    """For every bucket the mean share of the languages with a 1 and with a -1 in each bit.

    ``share`` is what one occurrence adds to a language's share, ``base`` the sums of the shares of buckets that do not occur.
    """
    number = {lang: i for i, lang in enumerate(share.index)}
    each = share.to_numpy()
    ones = (code == 1).sum(axis=0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (bucket,), rows in sorted_groups(batches, ["bucket"]):
            at = np.array([number[lang] for lang in rows["lang"]])
            added = rows["n"].to_numpy(float) * each[at]
            one = base[0] + added @ (code[at] == 1)
            zero = base[1] + added @ (code[at] == -1)
            yield pd.DataFrame([(bucket, (one / ones).tobytes(), (zero / (len(code) - ones)).tobytes())], columns=["bucket", "one", "zero"])

    return run


def _margins(share: pd.Series, weights: np.ndarray):
    """What the occurring buckets add to the mean log odds of each language and bit."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (lang,), rows in sorted_groups(batches, ["lang"]):
            added = rows["n"].to_numpy(float) * share[lang]
            yield pd.DataFrame([(lang, (added @ weights[rows["bucket"].to_numpy()]).tobytes())], columns=["lang", "margin"])

    return run


def learn(
    examples: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    buckets: int = BUCKETS,
    max_languages: int = MAX_LANGUAGES,
    smoothing: float = 0.5,
) -> LanguageModel:
    """Model from all rows of ``examples`` that have a language and a letter.

    Languages are counted before anything about them reaches the driver; more than ``max_languages`` raise a ValueError, since
    a model holds a codeword for each. Counts by (language, bucket) stay in Spark; weights are solved bucket by bucket.
    """
    spark = examples.sparkSession
    width = shuffle_width(spark)
    rows = examples.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    grams = stage(
        rows.where("lang is not null and text is not null")
        .mapInPandas(_count_language_grams(buckets), "lang string, bucket int, n bigint")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n")),
        "grams",
    )
    found = stage(grams.groupBy("lang").agg(F.sum("n").alias("n")), "languages")
    n = found.count()
    if n > max_languages:
        raise ValueError(f"{n} languages; max_languages is {max_languages}")
    totals = found.toPandas().sort_values("lang", key=lambda c: c.map(str)).set_index("lang")["n"]
    languages = list(totals.index)
    code = codewords(n)
    if n < 2:
        return LanguageModel(languages, code, np.zeros((buckets, code.shape[1])), np.ones(code.shape[1]), 1.0)
    # every language counts the same, however many rows it has; smoothing is shared out over the buckets
    share = 1 / (totals + smoothing * buckets)
    unseen = smoothing * share.to_numpy()
    base = np.stack((unseen @ (code == 1), unseen @ (code == -1)))
    ones = (code == 1).sum(axis=0)
    one, zero = np.tile(base[0] / ones, (buckets, 1)), np.tile(base[1] / (n - ones), (buckets, 1))
    by_bucket = grams.repartition(width, "bucket").sortWithinPartitions("bucket", "lang")
    # at most ``buckets`` rows of two numbers for each bit
    for r in by_bucket.mapInPandas(_sides(share, code, base), "bucket int, one binary, zero binary").toLocalIterator():
        one[r["bucket"]], zero[r["bucket"]] = np.frombuffer(r["one"]), np.frombuffer(r["zero"])
    weights = np.log(one / zero)
    apart = ((one - zero) * weights).sum(axis=0)
    # margins are mean log odds; the scale brings a bit's typical margin to about 4
    by_lang = grams.repartition(width, "lang").sortWithinPartitions("lang", "bucket")
    total = 0.0
    for r in by_lang.mapInPandas(_margins(share, weights), "lang string, margin binary").toLocalIterator():
        total += float(np.abs(np.frombuffer(r["margin"]) + smoothing * share[r["lang"]] * weights.sum(axis=0)).sum())
    scale = 4.0 / max(total / (n * code.shape[1]), 1e-9)
    return LanguageModel(languages, code, weights.astype(np.float32), apart / apart.sum(), scale)


def identify(
    docs: DataFrame,
    model: LanguageModel,
    id_col: str = "doc_id",
    text_col: str = "text",
    ambiguous_below: float = 0.2,
    keep: list[str] | None = None,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, the columns in ``keep``, lang_pred, score (0 to 1), ambiguous."""
    keep = keep or []
    rows = docs.select(F.col(id_col).alias("doc_id"), *keep, F.col(text_col).cast("string").alias("text"))
    head = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[:-1])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [model.predict(t, ambiguous_below) for t in batch["text"]]
            out = batch.drop(columns="text")
            for k, name in enumerate(("lang_pred", "score", "ambiguous")):
                out[name] = [f[k] for f in found]
            yield out

    return rows.mapInPandas(run, f"{head}, lang_pred string, score double, ambiguous boolean")
