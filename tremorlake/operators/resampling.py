"""Bootstrap intervals and isotonic fits from summaries that merge in the order of the scores."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tremorlake.functions.exprs import portable_draw
from tremorlake.operators.checkpoints import written
from tremorlake.operators.statistics import edges_of, running_counts, score_table, with_slice

#: Distinct scores of which a task draws all replicates at once.
DRAWN = 512
#: Parts whose blocks meet in one task of a merge.
FAN_IN = 16
GAMMA, MIX_1, MIX_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of whole numbers, as ``mixed_sql``."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) * np.uint64(GAMMA)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX_1)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX_2)
        return z ^ (z >> np.uint64(31))


def mixed_sql(x: str) -> str:
    """SQL of ``mixed`` by 128-bit numbers."""
    times = lambda z, k: f"(({z})::UHUGEINT * {k}::UHUGEINT % 18446744073709551616::UHUGEINT)"
    folded = lambda z, k: f"xor({z}, {z} >> {k})"
    return folded(times(folded(times(folded(times(x, GAMMA), 30), MIX_1), 27), MIX_2), 31)


class Poisson:
    """Counts of mean ``k`` by inverting the distribution, for any whole ``k``: its terms from 12 deviations below the mean to as many
    above come from their ratios, so no mean is too large and none has another law."""

    def __init__(self):
        self.tables: dict[int, tuple[int, np.ndarray]] = {}

    def table(self, k: int) -> tuple[int, np.ndarray]:
        if k not in self.tables:
            low, high = span_of(k)
            # ratios of neighbouring terms, k / j; what lies beyond the span is under 1e-30
            logs = np.r_[0.0, -np.cumsum(np.log1p((np.arange(low + 1, high + 1) - k) / k))]
            terms = np.exp(logs - logs.max())
            self.tables[k] = low, np.cumsum(terms) / terms.sum()
        return self.tables[k]

    def counts(self, k: int, u: np.ndarray) -> np.ndarray:
        if not k:
            return np.zeros(u.shape)
        low, below = self.table(k)
        return (low + np.minimum(np.searchsorted(below, u), len(below) - 1)).astype(float)


def span_of(k: int) -> tuple[int, int]:
    reach = 12 * math.sqrt(k) + 24
    return max(0, math.floor(k - reach)), math.ceil(k + reach)


def bootstrap_auroc(df: DataFrame, y: str, p: str, iters: int, seed: int, least: int = 100) -> DataFrame:
    """AUROC of bootstrap replicates and their 2.5 and 97.5 percentiles: one row (ci_low, ci_high, replicates).

    A row counts Poisson(1) times in a replicate, the usual form of resampling that needs no count of the whole; so the rows of one
    score and class count Poisson(k) times, drawn once for each replicate, exactly for any k. Scores are not cut. A part of the sorted
    scores gives for each replicate its positives, negatives and the pairs that are in order; such summaries
    merge in the order of the parts, so nothing grows with rows times replicates. One-class replicates are skipped; with fewer than
    ``least`` left the bounds are null. Rows of a null score or label are left out."""
    t = running_counts(score_table(df.filter(F.col(y).isNotNull() & F.col(p).isNotNull()), y, p, []), [])
    t = t.select("n_below", "pos", (F.col("n") - F.col("pos")).alias("neg")).repartitionByRange("n_below").sortWithinPartitions("n_below")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        law, it = Poisson(), np.arange(iters, dtype=np.uint64)
        pos, neg, won = (np.zeros(iters) for _ in range(3))
        some = False
        for b in batches:
            for at in range(0, b.num_rows, DRAWN):
                below, kp, kn = (c.to_numpy() for c in b.slice(at, DRAWN).columns)
                some = True
                drawn = []
                for side, k in enumerate((kp, kn)):
                    key = mixed((below * 2 + side + (seed << 40)).astype(np.uint64))
                    with np.errstate(over="ignore"):
                        u = ((mixed(key[:, None] + it[None, :]) >> np.uint64(11)).astype(float) + 0.5) / 2.0**53
                    drawn.append(np.array([law.counts(int(n), row) for n, row in zip(k, u, strict=True)]))
                dp, dn = drawn
                before = np.cumsum(dn, axis=0) - dn
                won += (dp * (before + dn / 2)).sum(axis=0) + dp.sum(axis=0) * neg
                pos += dp.sum(axis=0)
                neg += dn.sum(axis=0)
        if some:
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict({"iter": pa.array(range(iters), pa.int32()), "part": pa.array([part] * iters, pa.int32()), "pos": pos, "neg": neg, "won": won})

    parts = t.mapInArrow(run, "iter int, part int, pos double, neg double, won double")
    # a row a part and replicate
    before = F.coalesce(F.sum("neg").over(W.partitionBy("iter").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    a = parts.withColumn("before", before).groupBy("iter").agg(F.sum(F.col("won") + F.col("pos") * F.col("before")).alias("u"), F.sum("pos").alias("k"), F.sum("neg").alias("m"))
    a = a.filter("k > 0 AND m > 0").select((F.col("u") / (F.col("k") * F.col("m"))).alias("auroc"))
    q = F.percentile("auroc", F.array(F.lit(0.025), F.lit(0.975)))
    enough = F.col("replicates") >= least
    return a.agg(q.alias("q"), F.count(F.lit(1)).alias("replicates")).select(F.when(enough, F.col("q")[0]).alias("ci_low"), F.when(enough, F.col("q")[1]).alias("ci_high"), "replicates")


BLOCK = "fold int, part int, lo double, hi double, total double, n double"


def _pooled(rows: DataFrame, own_part: bool) -> DataFrame:
    """Pools adjacent violators of sorted blocks within each fold of a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        stack: list[list] = []
        fold = part = None

        def sent():
            lo, hi, total, n = zip(*stack, strict=True)
            m = len(stack)
            return pa.RecordBatch.from_pydict({"fold": pa.array([fold] * m, pa.int32()), "part": pa.array([part] * m, pa.int32()), "lo": pa.array(lo), "hi": pa.array(hi), "total": pa.array(total), "n": pa.array(n)})

        for b in batches:
            for f, q, *block in zip(*(c.to_pylist() for c in b.columns), strict=True):
                q = TaskContext.get().partitionId() if own_part else q
                if stack and (f, q) != (fold, part):
                    yield sent()
                    stack = []
                fold, part = f, q
                stack.append(block)
                # means are compared as products, so equal ones are equal
                while len(stack) > 1 and stack[-2][2] * stack[-1][3] >= stack[-1][2] * stack[-2][3]:
                    _, hi, total, n = stack.pop()
                    stack[-1] = [stack[-1][0], hi, stack[-1][2] + total, stack[-1][3] + n]
        if stack:
            yield sent()

    return rows.mapInArrow(run, BLOCK)


def isotonic_blocks(t: DataFrame) -> DataFrame:
    """Blocks (fold, lo, hi, value) of equal value of the rising fit to (fold, score, total, n): ranges of the sorted scores are pooled by
    themselves, then the blocks of neighbouring ranges together, so a task holds blocks and not scores."""
    rows = t.select("fold", F.lit(0).alias("part"), F.col("score").alias("lo"), F.col("score").alias("hi"), "total", "n")
    blocks = written(_pooled(rows.repartitionByRange("fold", "lo").sortWithinPartitions("fold", "lo"), True))
    while (blocks.agg(F.max("part")).first()[0] or 0) > 0:
        fewer = blocks.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int"))
        blocks = written(_pooled(fewer.repartition("fold", "part").sortWithinPartitions("fold", "part", "lo"), False))
    return blocks.select("fold", "lo", "hi", (F.col("total") / F.col("n")).alias("value"))


def isotonic_values(blocks: DataFrame, scores: DataFrame) -> DataFrame:
    """(fold, score, value) of (fold, score): the block's value, between blocks a straight line, and beyond them the outer values.

    Blocks are dealt to slices of about equally many by a sketch of their lower ends; a score meets the blocks of its slice and
    the last one before it. The blocks of a fold are ordered in one task; of noisy scores there are about as many as the cube root of
    the scores."""
    edges = written(edges_of(blocks, "lo"))
    after = W.partitionBy("fold").orderBy("lo")
    b = with_slice(blocks, "lo", edges).withColumnRenamed("_slice", "_own")
    b = b.withColumns({"next_lo": F.lead("lo").over(after), "next_value": F.lead("value").over(after), "first": F.lag("lo").over(after).isNull()})
    # a slice's blocks are met by its scores and those of later slices up to the next block; the first also by all before it
    slices = b.groupBy("fold", "_own").agg(F.count(F.lit(1)).alias("k"))
    by = W.partitionBy("fold").orderBy("_own")
    slices = slices.withColumns({"_from": F.when(F.lag("_own").over(by).isNull(), 0).otherwise(F.col("_own")), "_to": F.coalesce(F.lead("_own").over(by), F.lit(1023))})
    reach = slices.select("fold", "_own", F.explode(F.sequence("_from", "_to")).alias("_slice"))
    x = with_slice(scores, "score", edges).join(b.join(reach, ["fold", "_own"]), ["fold", "_slice"])
    here = ((F.col("score") >= F.col("lo")) | F.col("first")) & (F.col("next_lo").isNull() | (F.col("score") < F.col("next_lo")))
    share = (F.col("score") - F.col("hi")) / (F.col("next_lo") - F.col("hi"))
    value = F.when((F.col("score") <= F.col("hi")) | F.col("next_lo").isNull(), F.col("value")).otherwise(F.col("value") + (F.col("next_value") - F.col("value")) * share)
    return x.filter(here).select("fold", "score", value.alias("value"))


def isotonic_calibrate(train: DataFrame, test: DataFrame, y: str, p: str, ident: str, folds: int = 3, seed: int = 42) -> DataFrame:
    """``test`` with ``calibrated``: the mean of rising fits on all but one fold of the training rows each; folds are portable draws.
    Nothing is collected; a null score, or no training row, gives null."""
    rows = train.filter(F.col(y).isNotNull() & F.col(p).isNotNull()).select(F.col(y).cast("double").alias("y"), F.col(p).cast("double").alias("score"), (portable_draw(seed, ident) % folds).alias("_k"))
    rows = rows.groupBy("_k", "score").agg(F.sum("y").alias("total"), F.count(F.lit(1)).cast("double").alias("n"))
    each = F.filter(F.array(*(F.lit(k) for k in range(folds))), lambda k: k != F.col("_k"))
    t = rows.withColumn("fold", F.explode(each)).groupBy("fold", "score").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    asked = test.filter(F.col(p).isNotNull()).select(F.col(p).cast("double").alias("score")).distinct().withColumn("fold", F.explode(F.array(*(F.lit(k) for k in range(folds)))))
    got = isotonic_values(isotonic_blocks(t), asked).groupBy(F.col("score").alias("_score")).agg((F.sum("value") / folds).alias("calibrated"))
    return test.join(got, F.col(p).cast("double") == F.col("_score"), "left").drop("_score")
