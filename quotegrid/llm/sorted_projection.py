"""Near-duplicate vectors by sorted projection passes.

Equal vectors of a label are one class, known by its smallest id. In each pass the classes of every label are ordered
lexicographically by the concatenated signs of random projections of their differences from the label's mean; neighbours
in windows are compared by cosine, also across the borders of partitions, and verified pairs of all passes are joined to
components. An exact count follows inside the components: all links of their classes are counted, in pairs of blocks.
So a link is lost only where no chain of verified neighbours joins its ends.

How many passes and how wide windows a label needs follows from its number of classes and from its spread around its mean:
two vectors at the threshold agree in each bit with a known chance, so the chance that they share a run of a given
number of bits is known, and :func:`plan` takes the cheapest pair that misses such a pair with a chance below 1 - ``target``,
up to ``MOST_PASSES`` passes and windows of ``WIDEST``. In labels so dense that typical pairs are links, chains join all.

The passes move each class through one range-partitioned sort a pass, so a hot label is spread over tasks. A partition
hands on at most a spanning forest of the pairs it verified, and a window of vectors at either end. Counting deals a
component into blocks of ``block`` classes. Products are in single precision there; whatever lies within their error of
``least`` is decided in double precision.

Defined cases: vectors that are null, zero, hold null or non-finite components, have no label or no id are linked with
nothing; vectors of different lengths are never compared; rows that repeat an id count once, as the vector with the
smallest label and components; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotegrid.llm.common import UnionFind, components, shuffle_width, sorted_groups, stage

BITS, BLOCK = 48, 2048
FEWEST_PASSES, MOST_PASSES = 8, 96
WINDOW, WIDEST = 40, 512
TARGET = 0.99


def plan(n: int, spread: float, least: float, target: float = TARGET) -> tuple[int, int]:
    """(passes, window) for a label of ``n`` classes whose unit vectors have the mean squared distance ``spread`` from their mean."""
    if n <= WINDOW:
        return 1, max(n, 1)
    near = 1 - (1 - least) / max(spread, 1e-12)  # cosine of the differences of a pair at the threshold
    if near <= 0:
        return FEWEST_PASSES, WINDOW
    agree = 1 - math.acos(min(near, 1.0)) / math.pi
    best = None
    for bits in range(1, BITS):
        window = max(WINDOW, math.ceil(1.5 * n / 2**bits))
        passes = math.ceil(math.log(1 - target) / math.log1p(-min(agree**bits, 1 - 1e-9)))
        if window <= WIDEST and passes <= MOST_PASSES and (best is None or passes * window < best[0] * best[1]):
            best = passes, window
        if window == WINDOW:
            break
    passes, window = best or (MOST_PASSES, WIDEST)
    return max(passes, FEWEST_PASSES), window


def usable(vectors: DataFrame, id_col: str, vector_col: str, *more: str) -> DataFrame:
    """vec_id, vec (array<double>) and the columns in ``more`` of the vectors that take part."""
    vec = F.col(vector_col).cast("array<double>")
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), vec.alias("vec"), *more).where(
        F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0) & finite.eqNullSafe(True)
        & F.exists("vec", lambda x: x != 0)
    )


def unit(rows) -> np.ndarray:
    """Vectors of length one, safe for very large and very small components."""
    x = np.array(rows.tolist(), dtype=np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _label_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Number and sum of the unit vectors of each label and length in a batch."""
    for batch in batches:
        out = []
        for (label, width), part in batch.groupby(["label", "width"], sort=False):
            out.append((label, width, len(part), unit(part["vec"]).sum(axis=0).tobytes()))
        yield pd.DataFrame(out, columns=["label", "width", "n", "total"])


def _label_plans(least: float, target: float):
    """Mean, passes and window of each label and length."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (label, width), rows in sorted_groups(batches, ["label", "width"]):
            n = int(rows["n"].sum())
            mean = np.sum([np.frombuffer(t) for t in rows["total"]], axis=0) / n
            passes, window = plan(n, 1 - float(mean @ mean), least, target)
            yield pd.DataFrame([(label, width, mean.tolist(), passes, window)], columns=["label", "width", "mean", "passes", "window"])

    return run


def _keys(bits: int, seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        place = 1 << np.arange(bits - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            for (width, passes), part in batch.groupby(["width", "passes"], sort=False):
                x = unit(part["vec"]) - np.array(part["mean"].tolist())
                rest = part.drop(columns=["mean", "passes"])
                for p in range(passes):
                    if (width, p) not in planes:
                        planes[width, p] = np.random.default_rng([seed, width, p]).standard_normal((width, bits))
                    yield rest.assign(turn=p, key=(x @ planes[width, p] >= 0) @ place)

    return run


def _runs(columns: list[np.ndarray]) -> np.ndarray:
    change = np.zeros(len(columns[0]), dtype=bool)
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.cumsum(change)


def _link_windows(ids: np.ndarray, x: np.ndarray, run: np.ndarray, window: np.ndarray, least: float, forest: UnionFind) -> list:
    """Spanning links among rows of the same run, at most their window apart, with cosine of at least ``least``."""
    links = []
    for gap in range(1, min(int(window.max(initial=0)), len(ids) - 1) + 1):
        near = np.flatnonzero((run[gap:] == run[:-gap]) & (ids[gap:] != ids[:-gap]) & (window[:-gap] >= gap))
        if not len(near):
            continue
        near = near[np.einsum("ij,ij->i", x[near], x[near + gap]) >= least]
        links += [(int(ids[i]), int(ids[i + gap])) for i in near.tolist() if forest.union(i, i + gap)]
    return links


def _padded(vecs) -> np.ndarray:
    """Unit vectors; shorter ones are filled with zeros, their runs never mix with others."""
    width = max(map(len, vecs))
    if all(len(v) == width for v in vecs):
        return unit(vecs)
    out = np.zeros((len(vecs), width))
    for i, v in enumerate(vecs):
        out[i, : len(v)] = unit(pd.Series([v]))[0]
    return out


OUT = (
    "a bigint, b bigint, border int, part int, label bigint, width int, turn int, key bigint, window int, vec_id bigint, "
    "vec array<double>"
)
COLUMNS = ["a", "b", "border", "part", "label", "width", "turn", "key", "window", "vec_id", "vec"]
REACH = 3  # partitions ahead that a window may reach into where they are short


def _same_run(rows: pd.DataFrame) -> np.ndarray:
    return _runs([rows[c].to_numpy() for c in ("turn", "label", "width")])


def _windows(least: float):
    """Links inside a sorted partition, and its first and last rows for the borders to its neighbours."""

    def border(frame: pd.DataFrame, number: int, part: int) -> pd.DataFrame:
        return frame.assign(a=None, b=None, border=number, part=part)[COLUMNS]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId()
        tail: pd.DataFrame | None = None
        head: list[pd.DataFrame] = []
        held = 0
        for batch in batches:
            if not len(batch):
                continue
            if held < WIDEST:
                head.append(batch.head(WIDEST - held))
                held += len(head[-1])
            rows = batch if tail is None else pd.concat((tail, batch), ignore_index=True)
            ids = rows["vec_id"].to_numpy()
            links = _link_windows(ids, _padded(rows["vec"]), _same_run(rows), rows["window"].to_numpy(), least, UnionFind(len(ids)))
            if links:
                yield pd.DataFrame(links, columns=["a", "b"]).astype(object).assign(**dict.fromkeys(COLUMNS[2:]))
            tail = rows.tail(int(rows["window"].max()))
        if tail is not None:
            first = pd.concat(head, ignore_index=True)
            for back in range(1, REACH + 1):
                # only what a window from an earlier partition may reach
                yield border(first.head(int(first["window"].max())), number - back, number)
            yield border(tail, number, number)

    return run


def _borders(least: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, rows in sorted_groups(batches, ["border"]):
            if rows["part"].nunique() < 2:
                continue
            ids = rows["vec_id"].to_numpy()
            links = _link_windows(ids, _padded(rows["vec"]), _same_run(rows), rows["window"].to_numpy(), least, UnionFind(len(ids)))
            if links:
                yield pd.DataFrame(links, columns=["a", "b"])

    return run


def _count_links(least: float):
    """Links of every class in a pair of blocks of a component: the members of the classes it is linked with."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, rows in sorted_groups(batches, ["component", "i", "j"]):
            side, ids, members = rows["side"].to_numpy(), rows["vec_id"].to_numpy(), rows["members"].to_numpy(dtype=np.int64)
            x = unit(rows["vec"])
            rough, slack = x.astype(np.float32), (x.shape[1] + 8) * 2.0**-23
            total = np.zeros(len(ids), dtype=np.int64)
            inside = bool(rows["i"].iloc[0] == rows["j"].iloc[0])
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == (0 if inside else 1))
            others = rough[right].T
            step = max(16, (1 << 20) // max(len(right), 1))
            for lo in range(0, len(left), step):
                score = rough[left[lo : lo + step]] @ others
                at, to = np.nonzero(score >= least - slack)
                unsure = np.flatnonzero(score[at, to] < least + slack)
                at, to = left[lo + at], right[to]
                keep = at != to
                for k in range(0, len(unsure), 4096):
                    some = unsure[k : k + 4096]
                    keep[some] &= np.einsum("ij,ij->i", x[at[some]], x[to[some]]) >= least
                at, to = at[keep], to[keep]
                total += np.bincount(at, weights=members[to], minlength=len(ids)).astype(np.int64)
                if not inside:
                    total += np.bincount(to, weights=members[at], minlength=len(ids)).astype(np.int64)
            some = np.flatnonzero(total)
            yield pd.DataFrame({"vec_id": ids[some], "n": total[some]})

    return run


def near_vectors(
    vectors: DataFrame,
    least: float = 0.98,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    target: float = TARGET,
    bits: int = BITS,
    block: int = BLOCK,
    seed: int = 11,
) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    width = shuffle_width(spark)
    rows = vectors.select(
        F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vec"), F.col(label_col).cast("bigint").alias("label")
    )
    able = usable(rows, "vec_id", "vec", "label").where("label is not null")
    # one vector for each id
    able = able.groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("v")).select("vec_id", "v.label", "v.vec")
    able = stage(able.withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit("second"), "vec")}), "vectors")
    # equal vectors of a label: a class that goes by its smallest id, with the vector of that id
    same = ["label", "h1", "h2"]
    classes = stage(
        able.groupBy(*same).agg(F.min(F.struct("vec_id", "vec")).alias("v"), F.count("*").alias("members"))
        .select(*same, "v.vec_id", "v.vec", "members", F.size("v.vec").alias("width")),
        "classes",
    )
    heads = classes.select("vec_id", "label", "width", "vec", "members")
    plans = stage(
        heads.select("label", "width", "vec").mapInPandas(_label_sums, "label bigint, width int, n bigint, total binary")
        .repartition(width, "label", "width")
        .sortWithinPartitions("label", "width")
        .mapInPandas(_label_plans(least, target), "label bigint, width int, mean array<double>, passes int, window int"),
        "plans",
    )
    planned = heads.drop("members").join(plans, ["label", "width"]).select("vec_id", "label", "width", "vec", "mean", "passes", "window")
    keyed = planned.mapInPandas(
        _keys(bits, seed), "vec_id bigint, label bigint, width int, vec array<double>, window int, turn int, key bigint"
    )
    order = ["turn", "label", "width", "key", "vec_id"]
    sorted_rows = stage(keyed, "keys").repartitionByRange(width, *order).sortWithinPartitions(*order)
    linked = stage(sorted_rows.mapInPandas(_windows(least), OUT), "windows")
    across = (
        linked.where("border is not null")
        .repartition(width, "border")
        .sortWithinPartitions("border", "part", *order)
        .mapInPandas(_borders(least), "a bigint, b bigint")
    )
    found = stage(components(linked.where("a is not null").select("a", "b").unionByName(across)), "components")
    sizes = stage(found.groupBy("component").agg(F.count("*").alias("n")), "sizes")
    dealt = (
        found.join(sizes, "component")
        .withColumnRenamed("id", "vec_id")
        .join(heads, "vec_id")
        .withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
            F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "vec_id", "members", "vec",
        )
    )
    counted = (
        dealt.repartition(width, "component", "i", "j")
        .sortWithinPartitions("component", "i", "j")
        .mapInPandas(_count_links(least), "vec_id bigint, n bigint")
        .groupBy(F.col("vec_id").alias("id"))
        .agg(F.sum("n").alias("n"))
    )
    # each class' links, then each vector's: the other members of its own class are linked with it, too
    linked_classes = found.join(stage(counted, "counted"), "id", "left").withColumnRenamed("id", "class_id")
    answer = classes.select(*same, F.col("vec_id").alias("class_id"), "members").join(linked_classes, "class_id", "left").select(
        *same,
        (F.coalesce("n", F.lit(0)) + F.col("members") - 1).alias("n_links"),
        F.coalesce("component", "class_id").alias("component"),
    )
    answer = stage(able.select(F.col("vec_id").alias("__id"), *same).join(answer, same).select("__id", "component", "n_links"), "answers")
    # a row whose own vector or label cannot take part has no links, even if its id is repeated by one that can
    fit = rows.select("vec_id", usable_flag().alias("__able"))
    return (
        fit.join(answer, (F.col("vec_id") == F.col("__id")) & F.col("__able"), "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
            F.coalesce("component", F.col("vec_id").cast("bigint")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )


def usable_flag() -> Column:
    vec = F.col("vec").cast("array<double>")
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vec, lambda x: x != 0) & F.col("label").isNotNull(), F.lit(False))
