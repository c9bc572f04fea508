"""Quality classifier by Bradley-Terry ranking: scores from preference pairs, cut at a quantile."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorlake.llm.common import arrow_map, small_batches, split_words, written
from tremorlake.operators.statistics import ranked

#: Preference pairs that a model of measures in memory draws for each document; ``fit`` takes all pairs.
PAIRS_EACH = 24
MAX_PAIRS = 200_000
RIDGE = 1e-3
ROUNDS = 40
CUT = 0.3

FEATURES = ("log_words", "word_length", "upper", "digit", "symbol", "exclaim", "pipe", "no_letters", "same_as_last", "top_word", "distinct", "dup_lines", "line_words", "punctuation", "non_ascii", "one_char", "entropy")
_UPPER, _LOWER = (bytes(b for b in range(256) if b not in range(a, a + 26)) for a in (65, 97))
_DIGITS = bytes(b for b in range(256) if b not in range(48, 58))


def features(text: str | None) -> list[float]:
    """Measures of one text; all zero without words."""
    text = text or ""
    words = split_words(text)
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    raw = text.encode("utf-8", "surrogatepass")
    upper, lower, digit = (len(raw.translate(None, t)) for t in (_UPPER, _LOWER, _DIGITS))
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
    times = np.bincount(ids)
    p = times / n
    lines = [x for x in text.split("\n") if x.strip()]
    chars = len(text)
    return [
        np.log1p(n),
        np.log1p(sum(map(len, words)) / n),
        upper / max(1, upper + lower),
        np.log1p(20 * digit / chars),
        np.log1p(20 * sum(map(text.count, "#*$%&<>")) / chars),
        np.log1p(5 * text.count("!") / n),
        np.log1p(5 * text.count("|") / n),
        sum(not any(map(str.isalpha, w)) for w in number) / len(number),
        float((ids[1:] == ids[:-1]).mean()) if n > 1 else 0.0,
        float(times.max() / n) if n > 9 else 0.0,
        len(times) / n**0.75,
        (len(lines) - len(set(lines))) / max(1, len(lines)),
        np.log1p(n / max(1, len(lines))),
        np.log1p(5 * sum(map(text.count, ".,;:?")) / n),
        (len(raw) - chars) / chars,
        sum(len(w) == 1 for w in number) / len(number),
        float(-(p * np.log2(p)).sum()) / max(1.0, np.log2(n)),
    ]


def _spread(x: np.ndarray) -> np.ndarray:
    """Measures and their squares, so that a score may fall on both sides of a good value."""
    return np.c_[x, x * x]


class Ranker:
    """A Bradley-Terry model: utility is linear in the standardised measures, and the chance that one
    document is preferred to another is the logistic of the difference of their utilities. This one is made from measures
    in memory and drawn pairs, that of ``fit`` from a table of measures and all pairs of a good and a bad document."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 42):
        self.flat = len(x) == 0 or y.min() == y.max()
        if self.flat:
            self.prior = float(y.mean()) if len(y) else 0.5
            return
        self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
        z = self._map(x)
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        r = np.random.default_rng(seed)
        n = min(MAX_PAIRS, PAIRS_EACH * max(len(good), len(bad)))
        diff = z[r.choice(good, n)] - z[r.choice(bad, n)]
        w = np.zeros(z.shape[1])
        for _ in range(ROUNDS):  # Newton steps on the logistic loss of the differences
            q = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))
            step = np.linalg.solve((diff * (q * (1 - q))[:, None]).T @ diff / n + RIDGE * np.eye(len(w)), diff.T @ q / n - RIDGE * w)
            w = w + step
            if np.abs(step).max() < 1e-6:
                break
        self.weights = w
        u = np.sort(z @ w)
        # the threshold is the quantile at which the share of rejected documents is that of bad labels
        k = int(round((y == 0).mean() * len(u)))
        self.threshold = float((u[max(0, k - 1)] + u[min(len(u) - 1, k)]) / 2)

    @classmethod
    def of(cls, state: dict) -> Ranker:
        """A ranker from the plain values that a broadcast carries."""
        out = cls.__new__(cls)
        out.__dict__.update(state)
        return out

    def _map(self, x: np.ndarray) -> np.ndarray:
        return _spread(np.clip((x - self.mean) / self.scale, -4, 4))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Chances in (0, 1) that rise with utility; the threshold's utility has the score ``CUT``."""
        if self.flat:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self._map(x) @ self.weights - self.threshold + np.log(CUT / (1 - CUT)), -30, 30)))


def held_out(id_col) -> F.Column:
    """Whether the CRC-32 of the id, as text, leaves 0 by 5: such rows are never learned from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


#: Nodes of a cell of utilities of width 1, at which a sum over its documents is held; the logistic's poles are pi away, so a sum of
#: pairs over the nodes is that over the documents to about 12.6^-12, less than the rounding of ``WHOLE``.
NODES = 12
_NODES = 0.5 * np.cos((np.arange(NODES) + 0.5) * np.pi / NODES)
_WEIGHTS = (-1.0) ** np.arange(NODES) * np.sin((np.arange(NODES) + 0.5) * np.pi / NODES)
#: Sums are of whole numbers of this part of one, so they do not depend on the order of rows.
WHOLE = 2.0**-32


def _shares(v: np.ndarray) -> np.ndarray:
    """How each place within a cell (-0.5 to 0.5) is dealt to the nodes: values of the Lagrange polynomials, a row a place."""
    gap = v[:, None] - _NODES
    on = gap == 0
    part = _WEIGHTS / np.where(on, 1.0, gap)
    part = np.where(on.any(axis=1)[:, None], on, part)
    return part / part.sum(axis=1)[:, None]


def _utilities(batch: pa.RecordBatch, model: Ranker, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    z = model._map(np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in FEATURES]))
    return z, (z * w).sum(axis=1)


def _cell_sums(batches: Iterator[pa.RecordBatch], state: dict, w: np.ndarray) -> Iterator[pa.RecordBatch]:
    """By label and cell of utility, the sums of one and the measures at each node, and of the products of two measures."""
    model, sums = Ranker.of(state), {}
    upper = np.triu_indices(len(w))
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            batch = whole.slice(at, 1000)
            z, u = _utilities(batch, model, w)
            cell, y = np.floor(u).astype(np.int64), batch.column("y").to_numpy()
            one = np.c_[np.ones(len(z)), z]
            rows = np.c_[(_shares(u - cell - 0.5)[:, :, None] * one[:, None, :]).reshape(len(z), -1), z[:, upper[0]] * z[:, upper[1]]]
            rows = np.rint(rows / WHOLE).astype(np.int64)
            order = np.lexsort((cell, y))
            first = np.flatnonzero(np.r_[True, (np.diff(cell[order]) != 0) | (np.diff(y[order]) != 0)])
            for i, part in zip(order[first], np.add.reduceat(rows[order], first), strict=True):
                key = int(y[i]), int(cell[i])
                sums[key] = sums[key] + part if key in sums else part
    yield pa.RecordBatch.from_pydict({"y": [k[0] for k in sums], "cell": [k[1] for k in sums], "sums": [v.tobytes() for v in sums.values()]}, schema=pa.schema([("y", pa.int32()), ("cell", pa.int64()), ("sums", pa.binary())]))


def _round(train: DataFrame, state: dict, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, slope and about the curvature at ``w`` of the mean logistic loss over all pairs of a good and a bad document. One pass adds up
    cells, of which the driver gets a row a cell, label and task."""
    size, low = len(w), 2**20
    got: dict = {}
    for r in train.mapInArrow(partial(_cell_sums, state=state, w=w), "y int, cell long, sums binary").toLocalIterator():
        v = np.frombuffer(r.sums, np.int64)
        v = np.stack([v // low, v % low])  # so that sums of many tasks fit
        got[r.y, r.cell] = got[r.y, r.cell] + v if (r.y, r.cell) in got else v
    side = {}
    for label in (1, 0):
        cells = sorted(c for y, c in got if y == label)
        sums = np.array([got[label, c][0].astype(float) * low + got[label, c][1] for c in cells]) * WHOLE
        at = sums[:, : NODES * (size + 1)].reshape(-1, size + 1)
        side[label] = (np.array(cells)[:, None] + 0.5 + _NODES).ravel(), at[:, 0], at[:, 1:], sums[:, NODES * (size + 1) :]
    (s1, n1, z1, q1), (s0, n0, z0, q0) = side[1], side[0]
    loss, pull1, pull0, bend1, bend0, cross = 0.0, np.zeros(len(s1)), np.zeros(len(s0)), np.zeros(len(s1)), np.zeros(len(s0)), np.zeros((size, size))
    for i in range(0, len(s1), 256):
        p = slice(i, i + 256)
        d = s1[p, None] - s0
        q = 1 / (1 + np.exp(np.clip(d, -700, 700)))  # the chance of the wrong order
        bend = q * (1 - q)
        loss += float(n1[p] @ np.logaddexp(0, -d) @ n0)
        pull1[p], bend1[p] = q @ n0, bend @ n0
        pull0, bend0 = pull0 + n1[p] @ q, bend0 + n1[p] @ bend
        cross += z1[p].T @ (bend @ z0)
    pairs = n1.sum() * n0.sum()
    slope = (z1.T @ pull1 - z0.T @ pull0) / pairs
    upper = np.triu_indices(size)
    curve = np.zeros((size, size))
    for n, bend, q in ((n1, bend1, q1), (n0, bend0, q0)):  # within a cell the bend is its mean
        n, bend = n.reshape(-1, NODES), bend.reshape(-1, NODES)
        curve[upper] += ((n * bend).sum(axis=1) / n.sum(axis=1)) @ q
    curve = curve + np.triu(curve, 1).T - cross - cross.T
    return loss / pairs + RIDGE / 2 * float(w @ w), slope - RIDGE * w, curve / pairs + RIDGE * np.eye(size)


def measured(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A table of the measures of every text (id, ``FEATURES``), in the shared folder."""
    kind = df.select(id_col).schema[0].dataType.simpleString()
    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    with small_batches(df.sparkSession):
        return written(arrow_map(rows, f"id {kind}, " + ", ".join(f"{c} double" for c in FEATURES), lambda: lambda id, text: {"id": id} | dict(zip(FEATURES, zip(*map(features, text), strict=True), strict=True))))


def fit_measured(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Ranker:
    """A ranker from the measures of all labelled, not held-out documents and all pairs of a good and a bad one; see ``fit``."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("id")).agg((F.avg(label_col) > 0.5).cast("int").alias("y"))
    # decimal sums do not depend on their order
    exact = lambda c: F.sum(c.cast("decimal(24,12)"))
    train = written(rows.join(known, "id").groupBy("id", "y").agg(*((exact(F.col(c)) / F.count(F.lit(1))).cast("double").alias(c) for c in FEATURES)).drop("id"))
    sums = train.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("good"), *(exact(F.col(c)).alias(c) for c in FEATURES)).first()
    if sums.good in (0, sums.n):
        return Ranker.of({"flat": True, "prior": sums.good / sums.n if sums.n else 0.5})
    mean = np.array([float(sums[c]) / sums.n for c in FEATURES])
    off = train.agg(*(exact(F.pow(F.col(c) - float(m), 2)).alias(c) for c, m in zip(FEATURES, mean, strict=True))).first()
    state = {"flat": False, "mean": mean, "scale": np.maximum(np.sqrt([float(off[c]) / sums.n for c in FEATURES]), 1e-6)}
    w = np.zeros(2 * len(FEATURES))
    loss, slope, curve = _round(train, state, w)
    for _ in range(ROUNDS):  # Newton steps on the logistic loss of all pairs
        step = np.linalg.solve(curve, slope)
        if np.abs(step).max() < 1e-6:
            break
        for share in (1, 1 / 2, 1 / 4, 1 / 8):
            now = _round(train, state, w + share * step)
            if now[0] <= loss + 1e-9:
                break
        w, (loss, slope, curve) = w + share * step, now
    # the threshold is the quantile at which the share of rejected documents is that of bad labels
    k = sums.n - sums.good
    u = train.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"u": _utilities(b, Ranker.of(state), w)[1]}) for b in batches), "u double")
    u = u.withColumn("at", F.monotonically_increasing_id())  # equal utilities, of equal texts, need not meet in one task
    around = [r.u for r in ranked(u, "u", "at").filter(F.col("rank").isin(k, k + 1)).collect()]
    return Ranker.of(state | {"weights": w, "threshold": sum(around) / len(around)})


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Ranker:
    """A ranker from all labelled, not held-out documents and all pairs of a good and a bad one of them.

    Of several labels of one id the mean decides, over 0.5 is good; of several documents of one id the measures' means count.
    Null labels and ids are left out, as are labels without a document. Without both labels the ranker gives one
    score to all. A step is one pass over the measures; the pairs are summed by cells of utility, so they cost nothing by their number."""
    return fit_measured(measured(df, id_col, text_col), labels, id_col, label_col)


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row for each row of ``df``: its id, ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 if the score is at
    least 0.3).

    The score comes from the text alone; null and empty texts are scored as texts of no words, which
    rank below all that have some measures of good text. Repeated rows give repeated rows, an empty
    table none; a null id is not held out. Only the named columns are read, and each text is measured once.
    """
    rows = measured(df, id_col, text_col)
    model = df.sparkSession.sparkContext.broadcast(vars(fit_measured(rows, labels, id_col, label_col)))
    kind = rows.schema["id"].dataType.simpleString()

    def make():
        ranker = Ranker.of(model.value)

        def f(id, held, **measures):
            s = ranker.score(np.column_stack([measures[c] for c in FEATURES]))
            return {id_col: id, "held_out": held, "score": s, "predicted": (s >= CUT).astype(np.int32)}

        return f

    return arrow_map(rows.select("id", held_out(F.col("id")).alias("held"), *FEATURES), f"`{id_col}` {kind}, held_out boolean, score double, predicted int", make)
