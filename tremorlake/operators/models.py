"""Expanding-window model validation with boosted trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorlake.operators import boosting


def fold_rows(df: DataFrame, label: str, day: str, folds: list[tuple[str, str]]) -> DataFrame:
    """``df`` once for each fold that has the row, with ``fold`` and ``role``: a fold (cut, until) trains on days up to ``cut`` and tests on
    those after it up to ``until``. Rows without a label are left out."""
    spans = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(cut).cast("date").alias("cut"), F.lit(until).cast("date").alias("until")) for k, (cut, until) in enumerate(folds, 1)))
    x = df.filter(F.col(label).isNotNull()).withColumn("_f", F.explode(F.filter(spans, lambda f: F.col(day) <= f["until"])))
    return x.withColumns({"fold": F.col("_f.k"), "role": F.when(F.col(day) <= F.col("_f.cut"), "train").otherwise("test")}).drop("_f")


def fold_table(x: DataFrame, label: str, by: list[str], least_positives: int = 3) -> DataFrame:
    """(by, fold, n_train, n_test, pos_train, pos_test, status) of ``fold_rows``: a fold is skipped for too few training positives or
    a test of one class."""
    of = lambda role: F.col("role") == role
    y = F.col(label).cast("long")
    t = x.groupBy(*by, "fold").agg(F.count_if(of("train")).alias("n_train"), F.count_if(of("test")).alias("n_test"), *(F.coalesce(F.sum(F.when(of(r), y)), F.lit(0)).alias(f"pos_{r}") for r in ("train", "test")))
    one = (F.col("pos_test") == 0) | (F.col("pos_test") == F.col("n_test"))
    return t.withColumn("status", F.when(F.col("pos_train") < least_positives, "SKIP_INSUFFICIENT_TRAIN").when(one, "SKIP_NO_TEST_POSITIVES").otherwise("OK"))


def walk_forward(df: DataFrame, by: list[str], features: list[str], label: str, day: str, ident: str, folds: list[tuple[str, str]], params: boosting.Boosting | None = None, least_positives: int = 3, local_rows: int = boosting.LOCAL_ROWS) -> tuple[DataFrame, DataFrame]:
    """Scores (by, fold, ident, y, p) of the test rows of each group's folds, and the models (by, fold, importance): one boosted model a
    group and fold, all fitted together. Folds that ``fold_table`` skips have none."""
    x = fold_rows(df.select(*by, day, ident, F.col(label).cast("int").alias("_label"), *features), "_label", day, folds)
    key = [*by, "fold"]
    okay = fold_table(x, "_label", by, least_positives).filter("status = 'OK'").select(*key)
    x = boosting._same(x, okay, key)
    models = boosting.fit_boosted(x.filter("role = 'train'"), key, features, "_label", ident, params, local_rows=local_rows)
    return boosting.score(x.filter("role = 'test'"), models, key, features, [ident], "_label"), models


def ablation(train: DataFrame, test: DataFrame, sets: dict[str, list[str]], label: str, ident: str, params: boosting.Boosting | None = None, by: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Test scores (by, set, ident, y, p) of one model for each feature set, and the models. All are fitted together: rows are
    taken once for each set, and a model sees the features of its set."""
    features = list(dict.fromkeys(c for own in sets.values() for c in own))
    key = [*(by or []), "set"]
    each = lambda df: df.withColumn("set", F.explode(F.array(*map(F.lit, sets))))
    models = boosting.fit_boosted(each(train), key, features, label, ident, params, sets=sets)
    return boosting.score(each(test), models, key, features, [ident], label), models


def permutation_importance(test: DataFrame, models: DataFrame, by: list[str], features: list[str], label: str, ident: str, seed: int = 42) -> DataFrame:
    """(by, feature, auroc, drop): how much a model's AUROC falls when a feature's values are dealt anew among the test rows. One
    pass scores the rows as they are and once for each feature; a model without a feature has a drop of 0 for it."""
    from tremorlake.operators.statistics import binary_metrics

    names = [c for c in by if c not in test.columns]
    x = boosting.shuffled(test, features, ident, seed)
    if names:  # each model of a group scores all its rows
        x = x.join(models.select(*by).distinct(), [c for c in by if c in test.columns]) if len(names) < len(by) else x.crossJoin(F.broadcast(models.select(*by)))  # one row a model
    scores = boosting.score(x, models, by, features, [ident, "permuted"], label)
    m = binary_metrics(scores, "y", "p", [*by, "permuted"]).select(*by, "permuted", "auroc")
    base = m.filter("permuted IS NULL").select(*by, F.col("auroc").alias("auroc"))
    got = m.filter("permuted IS NOT NULL").select(*by, F.col("permuted").alias("feature"), F.col("auroc").alias("_a"))
    return boosting._same(got, base, by).withColumn("drop", F.col("auroc") - F.col("_a")).drop("_a")
