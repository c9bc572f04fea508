"""Histogram gradient boosting of many models at once, by group of rows.

Features are cut into at most ``bins`` classes at quantiles of the group's training rows. A level of a tree needs one scan: tasks sum
gradients and curvatures by (model, node, feature, class), the sums meet by (model, node), and only the chosen splits
come to the driver. Gradients are whole multiples of 2^-20, so sums are exact and a model does not depend on partitions.
Models of few rows, as counted, are grown by the same code inside one task each, all in one job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tremorlake.functions.exprs import portable_draw
from tremorlake.operators.checkpoints import written

#: Rows of a model up to which one task grows it; of more, all tasks do, scan by scan.
LOCAL_ROWS = 1_000_000
#: Rows that are kept as one packed row, and rounds after which their scores are written anew.
PACK_ROWS = 100_000
KEPT_ROUNDS = 20
#: Rows of a group that are scored together.
SCORE_ROWS = 200_000
#: Most parts that small models are dealt to.
MOST_PARTS = 4096
SCALE = float(1 << 20)
PRIME = 2147483647


@dataclass(frozen=True)
class Boosting:
    """Rounds, depth and rate of the trees; shares of rows and features drawn for each; the least curvature of a child, the
    ridge on leaves, feature classes, and what stands for a missing value: ``zero`` or ``median`` of the training rows."""

    rounds: int = 200
    depth: int = 4
    rate: float = 0.05
    subsample: float = 0.8
    colsample: float = 0.8
    least_weight: float = 5.0
    ridge: float = 1.0
    bins: int = 32
    seed: int = 42
    impute: str = "zero"


def drawn(u: np.ndarray, r: int) -> np.ndarray:
    """The draw in [0, 1) of rows with 32-bit draws ``u`` in round ``r``: a multiplier of its own for each round."""
    return (u % PRIME) * ((r + 1) * 48271 % PRIME) % PRIME / PRIME


def features_drawn(allowed: np.ndarray, r: int, share: float) -> np.ndarray:
    """The features of a round: of those allowed, the share with the least draws."""
    out = np.zeros_like(allowed)
    draw = (np.arange(1, allowed.shape[-1] + 1) * 40692 % PRIME) * ((r + 1) * 69621 % PRIME) % PRIME
    for i, row in enumerate(allowed):
        at = np.flatnonzero(row)
        out[i, at[np.argsort(draw[at], kind="stable")][: max(1, int(share * len(at) + 0.5))]] = True
    return out


class Tree:
    """One tree of each of ``m`` models, nodes numbered as in a heap; a node without a feature is a leaf."""

    def __init__(self, m: int, depth: int):
        self.feature = np.full((m, 2 ** (depth + 1) - 1), -1, np.int16)
        self.cut = np.zeros_like(self.feature)
        self.value = np.zeros(self.feature.shape)

    def step(self, model: np.ndarray, node: np.ndarray, b: np.ndarray) -> np.ndarray:
        f = self.feature[model, node]
        right = b[np.arange(len(b)), np.maximum(f, 0)] > self.cut[model, node]
        return np.where(f < 0, node, 2 * node + 1 + right)

    def leaf_values(self, model: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
        node = np.zeros(len(b), np.int64)
        for _ in range(depth):
            node = self.step(model, node, b)
        return self.value[model, node]


class Rows:
    """Training rows: feature classes, label, model, draw, weight of positives and the score so far."""

    def __init__(self, b, y, model, u, weight, score, p: Boosting):
        self.b, self.y, self.model, self.u, self.weight, self.score, self.p = b, y, model, u, weight, score, p

    def begin(self, r: int) -> None:
        chance = 1 / (1 + np.exp(-self.score))
        w = np.where(self.y == 1, self.weight, 1.0) * (drawn(self.u, r) < self.p.subsample)
        self.g, self.h = np.floor(w * (chance - self.y) * SCALE + 0.5), np.floor(w * (chance * (1 - chance)) * SCALE + 0.5)
        self.node = np.zeros(len(self.y), np.int64)

    def sums(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Slots (model, node of the level) with rows, and their sums by feature, class and kind."""
        first = 2**level - 1
        live = self.node >= first
        slots, slot = np.unique(self.model[live] * 2**level + self.node[live] - first, return_inverse=True)
        n, bins, width = len(slots), self.p.bins, self.b.shape[1]
        key = (slot[:, None] * (width * bins) + np.arange(width) * bins + self.b[live]).ravel()
        out = [np.bincount(key, np.repeat(x[live], width), n * width * bins).reshape(n, width, bins) for x in (self.g, self.h)]
        return slots, np.stack(out, axis=3)

    def go_on(self, tree: Tree) -> None:
        self.node = tree.step(self.model, self.node, self.b)

    def end(self, tree: Tree) -> None:
        self.score = self.score + tree.value[self.model, self.node]


def chosen(sums: np.ndarray, allowed: np.ndarray, p: Boosting) -> np.ndarray:
    """For each slot its best split: feature (-1 for none), class, gain, and gradient and curvature of all and of the left side."""
    left = np.cumsum(sums, axis=2) / SCALE
    whole = left[:, :1, -1:, :]
    gl, hl = left[:, :, :-1, 0], left[:, :, :-1, 1]
    g, h = whole[..., 0], whole[..., 1]
    gr, hr = g - gl, h - hl
    gain = gl * gl / (hl + p.ridge) + gr * gr / (hr + p.ridge) - g * g / (h + p.ridge)
    gain = np.where((hl >= p.least_weight) & (hr >= p.least_weight) & allowed[:, :, None], gain, -1.0).reshape(len(sums), -1)
    best = np.argmax(gain, axis=1)
    rows = np.arange(len(sums))
    f, c = np.divmod(best, sums.shape[2] - 1)
    top = gain[rows, best]
    return np.c_[np.where(top > 0, f, -1), c, top, g[:, 0, 0], h[:, 0, 0], gl[rows, f, c], hl[rows, f, c]]


def grow(m: int, allowed: np.ndarray, p: Boosting, scan: Callable, ended: Callable) -> tuple[list[Tree], np.ndarray]:
    """Trees of ``m`` models, and each model's gains by feature. ``scan(r, tree, level, features)`` gives the level's slots and
    what ``chosen`` says of them; ``ended(r, tree)`` takes a grown tree."""
    trees, gains = [], np.zeros(allowed.shape)
    leaf = lambda g, h: -g / (h + p.ridge) * p.rate
    for r in range(p.rounds):
        tree = Tree(m, p.depth)
        features = features_drawn(allowed, r, p.colsample)
        for level in range(p.depth):
            slots, best = scan(r, tree, level, features)
            model, node = np.divmod(slots, 2**level)
            node = node + 2**level - 1
            if level == 0:
                tree.value[model, 0] = leaf(best[:, 3], best[:, 4])
            split = best[:, 0] >= 0
            if not split.any():
                break
            model, node, (f, c, gain, g, h, gl, hl) = model[split], node[split], best[split].T
            tree.feature[model, node], tree.cut[model, node] = f, c
            tree.value[model, 2 * node + 1], tree.value[model, 2 * node + 2] = leaf(gl, hl), leaf(g - gl, h - hl)
            np.add.at(gains, (model, f.astype(int)), gain)
        trees.append(tree)
        ended(r, tree)
    return trees, gains


def grow_here(rows: Rows, m: int, allowed: np.ndarray, p: Boosting) -> tuple[list[Tree], np.ndarray]:
    """Trees of models whose rows are all here."""

    def scan(r, tree, level, features):
        rows.begin(r) if level == 0 else rows.go_on(tree)
        slots, sums = rows.sums(level)
        return slots, chosen(sums, features[slots // 2**level], p)

    def ended(r, tree):
        rows.node = np.zeros(len(rows.y), np.int64)
        for _ in range(p.depth):
            rows.go_on(tree)
        rows.end(tree)

    return grow(m, allowed, p, scan, ended)


def _to_bytes(trees: list[Tree], model: int) -> bytes:
    return b"".join(t.feature[model].tobytes() + t.cut[model].tobytes() + t.value[model].tobytes() for t in trees)


def _of_bytes(raw: bytes, depth: int) -> Iterator[Tree]:
    n = 2 ** (depth + 1) - 1
    for at in range(0, len(raw), n * 12):
        t = Tree(1, depth)
        t.feature[0], t.cut[0] = np.frombuffer(raw, np.int16, n, at), np.frombuffer(raw, np.int16, n, at + 2 * n)
        t.value[0] = np.frombuffer(raw, np.float64, n, at + 4 * n)
        yield t


def _classes(features: list[str]):
    """The class of each feature: how many of its edges are below the value, or below what stands for a missing one."""
    below = lambda x: lambda e: e < x
    return F.array(*(F.size(F.filter(F.col("_edges")[i], below(F.coalesce(F.col(c), F.col("_fill")[i])))) for i, c in enumerate(features)))


def _stats(rows: DataFrame, by: list[str], features: list[str], p: Boosting) -> DataFrame:
    """(by, _n, _pos, _edges, _fill) of each group's training rows."""
    at = F.array(*(F.lit(k / p.bins) for k in range(1, p.bins)))
    x = [F.col(c) if p.impute == "median" else F.coalesce(F.col(c), F.lit(0.0)) for c in features]
    none = F.array_repeat(F.lit(0.0), p.bins - 1)  # of a feature without values
    edges = F.array(*(F.coalesce(F.percentile_approx(v, at, 10000), none) for v in x))
    fill = F.array(*((F.coalesce(F.percentile_approx(v, F.lit(0.5), 10000), F.lit(0.0)) if p.impute == "median" else F.lit(0.0)) for v in x))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col("_y").cast("long")).alias("_pos"), edges.alias("_edges"), fill.alias("_fill"))


def _same(a: DataFrame, b: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Join on ``by``, nulls being one value."""
    b = b.select(*(F.col(c).alias(f"_k_{c}") if c in by else F.col(c) for c in b.columns))
    return a.join(b, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by], how).drop(*(f"_k_{c}" for c in by))


MODEL = "_trees binary, _gains array<double>"


def fit_boosted(train: DataFrame, by: list[str], features: list[str], label: str, ident: str, params: Boosting | None = None, sets: dict[str, list[str]] | None = None, set_col: str = "set", least_positives: int = 1, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """One boosted model for each group ``by`` of ``train``: (by, rows, positives, gains by feature as ``importance``, and what
    ``score`` needs). Positives weigh as much as negatives.

    With ``sets``, the column ``set_col`` of ``by`` names a feature set, and a model sees the features of its set only. Rows without
    a label are left out, as are groups of fewer than ``least_positives`` positives or without a negative; nulls in ``by`` are one
    group. ``ident`` tells rows apart for the draws of rows; equal ones are drawn together. An empty table gives no models."""
    p = params or Boosting()
    x = train.filter(F.col(label).isNotNull()).select(*by, F.col(label).cast("int").alias("_y"), portable_draw(p.seed, ident).alias("_u"), *(F.col(c).cast("double").alias(c) for c in features))
    stats = written(_stats(x, by, features, p).filter((F.col("_pos") >= least_positives) & (F.col("_pos") < F.col("_n"))))
    rows = _same(x, stats, by).select(*by, "_y", "_u", _classes(features).alias("_b"), "_n", ((F.col("_n") - F.col("_pos")) / F.col("_pos")).alias("_w"))
    order = {s: [c in own for c in features] for s, own in (sets or {}).items()}
    mask = F.array(*(F.lit(True) for _ in features))
    for s, flags in order.items():
        mask = F.when(F.col(set_col) == s, F.array(*map(F.lit, flags))).otherwise(mask)
    rows = rows.withColumn("_mask", mask)
    kinds = {c: rows.schema[c].dataType.simpleString() for c in by}
    key = ", ".join(f"`{c}` {k}" for c, k in kinds.items())
    # as many parts as models, which small rows would not get by themselves
    here = rows.filter(F.col("_n") <= local_rows).repartition(max(1, min(stats.count(), MOST_PARTS)), *by)
    models = here.groupBy(*by).applyInArrow(_local(by, kinds, p), f"{key}, {MODEL}")
    large = stats.filter(F.col("_n") > local_rows).select(*by)
    if not large.isEmpty():
        models = models.unionByName(_grown_by_scans(rows.filter(F.col("_n") > local_rows), large, by, kinds, p))
    imp = F.map_from_arrays(F.array(*map(F.lit, features)), F.col("_gains"))
    return _same(written(models), stats, by).select(*by, F.col("_n").alias("n_rows"), F.col("_pos").alias("positives"), imp.alias("importance"), "_edges", "_fill", "_trees", F.lit(p.depth).alias("_depth"))


def _arrays(t: pa.Table | pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    col = lambda n: t.column(n).combine_chunks() if isinstance(t.column(n), pa.ChunkedArray) else t.column(n)
    flat = col("_b").flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.uint8).reshape(-1, width), col("_y").to_numpy(zero_copy_only=False), col("_u").to_numpy(zero_copy_only=False), col("_w").to_numpy(zero_copy_only=False)


def _local(by: list[str], kinds: dict, p: Boosting):
    schema = to_arrow_schema(T.StructType.fromDDL(", ".join(f"`{c}` {k}" for c, k in kinds.items()) + f", {MODEL}"))

    def fit(t: pa.Table) -> pa.Table:
        mask = np.array([t.column("_mask")[0].as_py()])
        b, y, u, w = _arrays(t, mask.shape[1])
        trees, gains = grow_here(Rows(b, y, np.zeros(len(y), np.int64), u, w, np.zeros(len(y)), p), 1, mask, p)
        return pa.Table.from_pydict({c: [t.column(c)[0].as_py()] for c in by} | {"_trees": [_to_bytes(trees, 0)], "_gains": [gains[0].tolist()]}, schema=schema)

    return fit


def _grown_by_scans(rows: DataFrame, large: DataFrame, by: list[str], kinds: dict, p: Boosting) -> DataFrame:
    """Models of the groups in ``large``, all at once, one scan of all rows for each level of a tree."""
    spark = rows.sparkSession
    groups = sorted(large.collect(), key=str)  # groups of over a million rows each
    key = ", ".join(f"`{c}` {k}" for c, k in kinds.items())
    ids = spark.createDataFrame([(*g, i) for i, g in enumerate(groups)], f"{key}, _m int")
    width = len(rows.select("_mask").first()[0])
    masks = {r._m: r._mask for r in _same(rows, ids, by).groupBy("_m").agg(F.any_value("_mask").alias("_mask")).collect()}
    allowed = np.array([masks[i] for i in range(len(groups))])
    packed = "n int, b binary, y binary, m binary, u binary, w binary, s binary"
    arrow = to_arrow_schema(T.StructType.fromDDL(packed))

    def pack(batches):
        held, n = [], 0

        def sent():
            b, y, u, w, m = (np.concatenate([h[i] for h in held]) for i in range(5))
            return pa.RecordBatch.from_pylist([{"n": len(y), "b": b.tobytes(), "y": y.astype(np.uint8).tobytes(), "m": m.astype(np.int32).tobytes(), "u": u.astype(np.int64).tobytes(), "w": w.tobytes(), "s": np.zeros(len(y)).tobytes()}], schema=arrow)

        for batch in batches:
            if batch.num_rows:
                held.append((*_arrays(batch, width), batch.column("_m").to_numpy(zero_copy_only=False)))
                n += batch.num_rows
            if n >= PACK_ROWS:
                yield sent()
                held, n = [], 0
        if held:
            yield sent()

    data = written(_same(rows, ids, by).select("_b", "_y", "_u", "_w", "_m").mapInArrow(pack, packed))

    def unpacked(batches, since: list[Tree]) -> Iterator[tuple[dict, Rows]]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                part = Rows(np.frombuffer(r["b"], np.uint8).reshape(-1, width), np.frombuffer(r["y"], np.uint8), np.frombuffer(r["m"], np.int32).astype(np.int64), np.frombuffer(r["u"], np.int64), np.frombuffer(r["w"]), np.frombuffer(r["s"]), p)
                for t in since:
                    part.score = part.score + t.leaf_values(part.model, part.b, p.depth)
                yield r, part

    since: list[Tree] = []
    found = "slot int, best binary"

    def scan(r, tree, level, features):
        done = list(since)

        def part_sums(batches):
            total: dict[int, np.ndarray] = {}
            for _, part in unpacked(batches, done):
                part.begin(r)
                for _ in range(level):
                    part.go_on(tree)
                for slot, s in zip(*part.sums(level), strict=True):
                    total[int(slot)] = total[int(slot)] + s if int(slot) in total else s
            yield pa.RecordBatch.from_pydict({"slot": pa.array(list(total), pa.int32()), "best": pa.array([s.tobytes() for s in total.values()], pa.binary())})

        def splits(batches):
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for slot, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    s = np.frombuffer(raw).reshape(width, p.bins, 2)
                    total[slot] = total[slot] + s if slot in total else s
            slots = np.array(sorted(total), np.int64)
            best = chosen(np.array([total[s] for s in slots]).reshape(-1, width, p.bins, 2), features[slots // 2**level], p)
            yield pa.RecordBatch.from_pydict({"slot": pa.array(slots.astype(np.int32)), "best": pa.array([x.tobytes() for x in best], pa.binary())})

        got = data.mapInArrow(part_sums, found).repartition("slot").mapInArrow(splits, found).collect()  # one row a node
        got.sort(key=lambda x: x.slot)
        return np.array([x.slot for x in got], np.int64), np.array([np.frombuffer(x.best) for x in got]).reshape(-1, 7)

    def ended(r, tree):
        nonlocal data
        since.append(tree)
        if len(since) >= KEPT_ROUNDS:
            done = list(since)

            def scored(batches):
                for row, part in unpacked(batches, done):
                    yield pa.RecordBatch.from_pylist([row | {"s": part.score.tobytes()}], schema=arrow)

            data = written(data.mapInArrow(scored, packed))
            since.clear()

    trees, gains = grow(len(groups), allowed, p, scan, ended)
    return spark.createDataFrame([(*g, _to_bytes(trees, i), gains[i].tolist()) for i, g in enumerate(groups)], f"{key}, {MODEL}")


def score(rows: DataFrame, models: DataFrame, by: list[str], features: list[str], ids: list[str], label: str | None = None) -> DataFrame:
    """Chances of rows by their group's model: (by, ids, y if ``label``, p). Rows of groups without a model are left out. A group's
    rows are dealt to parts of bounded size, each of which meets a copy of the model."""
    keep = [F.col(c) for c in ids] + ([F.col(label).cast("int").alias("y")] if label else [])
    x = rows.select(*by, *keep, *(F.col(c).cast("double").alias(c) for c in features))
    n = x.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"))
    parts = F.ceil(F.col("_rows") / SCORE_ROWS).cast("int")
    m = _same(models.select(*by, "_edges", "_fill", "_trees", "_depth"), n, by).withColumn("_parts", parts)
    names = [*ids, *(["y"] if label else [])]
    x = _same(x, m.select(*by, "_edges", "_fill", "_parts"), by)
    x = x.select(*by, *names, _classes(features).alias("_b"), F.pmod(F.xxhash64(*ids), F.col("_parts")).cast("int").alias("_part"))
    m = m.select(*by, "_trees", "_depth", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    x, m = x.toDF(*x.columns), m.toDF(*m.columns)  # columns of their own, as rows may come from the models
    out = x.select(*by, *names).withColumn("p", F.lit(0.0)).schema
    arrow, width = to_arrow_schema(out), len(features)
    # nulls of a group's key are one value, as cogroup takes them
    key = [*by, "_part"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return arrow.empty_table()
        b = left.column("_b").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.uint8).reshape(-1, width)
        depth, total, zero = right.column("_depth")[0].as_py(), np.zeros(len(b)), np.zeros(len(b), np.int64)
        for t in _of_bytes(right.column("_trees")[0].as_py(), depth):
            total = total + t.leaf_values(zero, b, depth)
        return left.select([*by, *names]).append_column("p", pa.array(1 / (1 + np.exp(-total)))).cast(arrow)

    return x.groupBy(*key).cogroup(m.groupBy(*key)).applyInArrow(run, out)


def importances(models: DataFrame, by: list[str]) -> DataFrame:
    """(by, feature, gain, share of the model's gains)."""
    t = models.select(*by, F.explode("importance").alias("feature", "gain"), F.aggregate(F.map_values("importance"), F.lit(0.0), lambda a, x: a + x).alias("_all"))
    return t.select(*by, "feature", "gain", F.coalesce(F.try_divide(F.col("gain"), F.col("_all")), F.lit(0.0)).alias("share"))


def shuffled(rows: DataFrame, features: list[str], ident: str, seed: int = 42) -> DataFrame:
    """``rows`` once as they are, with a null ``permuted``, and once for each feature, named by it, whose values are dealt anew: the
    row of rank k by one portable draw gets the value of the row of rank k by another, so a deal is the same everywhere.
    ``ident`` tells rows apart."""
    from tremorlake.operators.statistics import ranked

    to, of = (ranked(rows.select(F.col(ident).alias(name), portable_draw(seed, F.lit(name), ident).alias("_v")), "_v", name).drop("_v") for name in ("_to", "_from"))
    deal = to.join(of, "rank").drop("rank")
    given = rows.select(F.col(ident).alias("_from"), *(F.col(c).alias(f"_n_{c}") for c in features))
    both = rows.join(deal.join(given, "_from"), F.col(ident) == F.col("_to"))
    t = both.withColumn("permuted", F.explode(F.array(F.lit(None).cast("string"), *map(F.lit, features))))
    return t.select(*(F.when(F.col("permuted") == c, F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) if c in features else F.col(c) for c in rows.columns), "permuted")
