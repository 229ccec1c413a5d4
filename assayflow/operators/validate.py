"""Cross-validation from fold moments, component scans, permutation tests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import dot, ratio
from . import foldwise, gram
from .preprocess import ROW_STEPS, Preprocessor
from .ranks import ranked

PARSIMONY = 0.10
#: Scatter corrections with the degree of the polynomial that goes with the reference.
SCATTER = {"msc": 0, "emsc": 2}


def folds(df: DataFrame, scheme: str, y: str = "y", groups: str = "grp", k: int = 5) -> DataFrame:
    """df with fold: the group itself (logo), or levels of y dealt in turn to k folds (kfold). Levels are never split."""
    if scheme == "logo":
        return df.withColumn("fold", F.col(groups))
    levels = df.select(F.col(y).alias("__level")).filter("__level is not null").distinct()
    n = levels.count()
    levels = ranked(levels, "__level", name="fold").withColumn("fold", F.pmod("fold", F.lit(max(1, min(k, n)))))
    return df.join(levels, F.col(y) == F.col("__level")).drop("__level")


def predictions(df: DataFrame, components: int, method: str = "pls", spectrum: str = "spectrum", y: str = "y", fold: str = "fold", chain: str = "none") -> DataFrame:
    """Held-out predictions: df's rows by number of components (a), predicted by models of the other folds.

    One pass gives every fold's moments; a fold's training moments are the total less its own. Row-wise steps of
    `chain` come first; centring and scaling are part of the models, so nothing of a fold reaches its own model. One
    msc or emsc may follow the row-wise steps; it is fitted to each fold's training rows (foldwise.py).
    """
    steps = [s for s in chain.split("+") if s != "none"]
    scatter = [s for s in steps if s in SCATTER]
    if [s for s in steps if s not in (*ROW_STEPS, *SCATTER, "center", "autoscale")] or len(scatter) > 1 or scatter and not _scatter_in_place(steps, steps.index(scatter[0])):
        raise ValueError("valid inside validation are row-wise steps, then one of msc and emsc, then centring and scaling")
    rows = Preprocessor("+".join(s for s in steps if s in ROW_STEPS) or "none").fit(df, spectrum).transform(df, spectrum)
    if scatter:
        return foldwise.predictions(rows, components, method, SCATTER[scatter[0]], spectrum, y, fold)
    parts = gram.moments(rows, spectrum, y, fold)
    every = gram.total(parts)
    cap = min(components, int(min(every.n - m.n for m in parts.values())) - 1)
    models = []
    for name, own in parts.items():
        m = (gram.pls if method == "pls" else gram.pcr)(every.without(own), cap)
        models += [(name, a + 1, m.coef[a].tolist(), float(m.intercept[a])) for a in range(len(m.coef))]
    table = df.sparkSession.createDataFrame(models, "f string, a int, coef array<double>, base double")
    joined = rows.join(F.broadcast(table), F.col(fold).cast("string") == F.col("f"))
    return joined.withColumn("predicted", dot(F.col(spectrum), F.col("coef")) + F.col("base")).drop("f", "coef", "base")


def _scatter_in_place(steps: list[str], at: int) -> bool:
    return set(steps[:at]) <= set(ROW_STEPS) and set(steps[at + 1 :]) <= {"center", "autoscale"}


def leave_one_out(df: DataFrame, components: int, sample: str = "sample", spectrum: str = "spectrum", y: str = "y") -> DataFrame:
    """Each row predicted by the PLS model of all others, whose moments are the total less the row: sample, y, predicted."""
    rows = df.filter(F.col(spectrum).isNotNull() & F.col(y).isNotNull())
    every = rows.sparkSession.sparkContext.broadcast(gram.moments(rows, spectrum, y)[None])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row in gram._batch(b):
                model = gram.pls(every.value.without_row(row), components)
                out.append(float(model.coef[-1] @ row[:-1] + model.intercept[-1]))
            yield pa.RecordBatch.from_arrays([b.column("sample"), b.column("y"), pa.array(out)], names=["sample", "y", "predicted"])

    slim = rows.select(F.col(sample).alias("sample"), F.col(spectrum).cast("array<double>").alias("spectrum"), F.col(y).cast("double").alias("y"))
    return slim.mapInArrow(run, f"sample {df.schema[sample].dataType.simpleString()}, y double, predicted double")


def cv_stats(predicted: DataFrame, by: list[str], y: str = "y") -> DataFrame:
    """n, rmsecv, r2cv and bias of predictions; undefined ones are null and left out."""
    e = F.col("predicted") - F.col(y)
    out = predicted.filter("predicted is not null").groupBy(*by).agg(F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmsecv"), F.avg(e).alias("bias"), F.sum(e * e).alias("__ss"), F.var_pop(y).alias("__v"))
    return out.withColumn("r2cv", 1 - ratio(F.col("__ss"), F.col("n") * F.col("__v"))).drop("__ss", "__v")


def cross_validate(df: DataFrame, components: int, scheme: str = "auto", groups: str | None = None, method: str = "pls", y: str = "y", sample: str = "sample", k: int = 5) -> DataFrame:
    """One row of cv_stats with scheme, question (what it answers), severity and code.

    With groups the scheme is logo whatever is asked; else auto and loo leave out one sample, kfold deals levels of y.
    Leaving out one sample of a repeated level only asks for levels that were seen, which is a warning.
    """
    if groups is None and scheme not in ("auto", "loo", "kfold"):
        raise ValueError(f"unknown scheme {scheme!r}")
    named = "logo" if groups else "kfold" if scheme == "kfold" else "loo"
    question = {"logo": "a new group", "kfold": "new levels", "loo": "a new sample of the levels seen"}[named]
    if named == "loo":
        found = leave_one_out(df, components, sample, y=y)
        again = df.filter(F.col(y).isNotNull()).agg(F.count("*") > F.count_distinct(y)).first()[0]
    else:
        rows = folds(df, named, y, groups or "grp", k)
        found, again = predictions(rows, components, method, y=y).filter(F.col("a") == components), False
    out = cv_stats(found, [], y)
    return out.select(F.lit(named).alias("scheme"), F.lit(question).alias("question"), "*", F.lit("WARN" if again else "INFO").alias("severity"), F.lit("levels_repeat" if again else "ok").alias("code"))


def component_scan(df: DataFrame, components: int = 10, chains: tuple[str, ...] = ("none", "snv"), method: str = "pls", fold: str = "fold") -> DataFrame:
    """pre, a, rmsecv, ...: one curve per preprocessing chain, all numbers of components from one model per fold."""
    out = None
    for chain in chains:
        one = cv_stats(predictions(df, components, method, fold=fold, chain=chain), ["a"]).withColumn("pre", F.lit(chain))
        out = one if out is None else out.unionByName(one)
    return out


def choose_components(scan: DataFrame, tolerance: float = PARSIMONY) -> DataFrame:
    """The fewest components within tolerance of the best error, ties by error. scan is one row per model."""
    best = F.min("rmsecv").over(Window.partitionBy(F.lit(0)))
    near = scan.withColumn("__best", best).filter(F.col("rmsecv") <= F.col("__best") * (1 + tolerance)).drop("__best")
    return near.orderBy("a", "rmsecv", "pre").limit(1)


def permutation_test(spark: SparkSession, df: DataFrame, components: int, n_perm: int = 199, seed: int = 0, sample: str = "sample", groups: str | None = None) -> DataFrame:
    """One row: the cross-validated error against those of permuted responses, and p = (as good or better + 1) / (n + 1).

    With groups, level means move between groups instead of single values. Each permutation permutes its own copy of
    (sample, y), so the table of responses is n_perm times the samples, carried as one array per sample beside its
    spectrum; moments of the spectra are shared, since only x'y changes with y. Responses are permuted by hashed order, the same for any partitioning.
    """
    keyed = df.filter(F.col("spectrum").isNotNull() & F.col("y").isNotNull()).select(F.col(sample).alias("s"), (F.col(groups) if groups else F.col(sample)).alias("g"), "spectrum", "y", "fold")
    level = keyed.groupBy("g").agg(F.avg("y").alias("level"))
    # places by one hash and by one for each permutation, ranked in slices, so that no task holds a permutation
    own = ranked(level.withColumn("h", F.xxhash64("g", F.lit(seed))), "h", name="k", ties="g").select("k", "g")
    drawn = level.withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(n_perm)))).withColumn("h", F.xxhash64("g", "perm", F.lit(seed)))
    other = ranked(drawn, "h", ["perm"], "k", "g").select("perm", "k", "level")
    response = own.join(other, "k").select("perm", "g", F.col("level").alias("yp")).unionByName(level.select(F.lit(0).alias("perm"), "g", F.col("level").alias("yp")))
    parts = gram.moments(keyed, fold="fold")
    shared = spark.sparkContext.broadcast({k: (m.n, m.shift[:-1], m.sums[:-1], m.products[:-1, :-1]) for k, m in parts.items()})

    # x'y and y'y of each permutation and fold: one matrix product for each batch, whose sums alone are shuffled
    c = parts[next(iter(parts))].shift[:-1]
    each = response.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("perm", "yp"))), lambda v: v["yp"]).alias("ys"))  # n_perm + 1 numbers
    rows = keyed.join(each, "g").select(F.col("fold").cast("string").alias("fold"), F.col("spectrum").cast("array<double>").alias("spectrum"), "ys")

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            x, ys = (b.column(k).flatten().to_numpy().reshape(b.num_rows, -1) for k in ("spectrum", "ys"))
            names = np.array(b.column("fold").to_pylist(), object)
            for name in set(names.tolist()):
                at = names == name
                own = np.vstack([ys[at].sum(0), (ys[at] ** 2).sum(0), x[at].T @ ys[at]])  # sy, syy and a row of x'y per channel
                sums[name] = sums[name] + own if name in sums else own
        for name, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(s)), pa.array(np.arange(len(s), dtype=np.int32)), pa.array(list(s), pa.list_(pa.float64()))], names=["fold", "row", "v"])

    summed = rows.mapInArrow(products, "fold string, row int, v array<double>").select("fold", "row", F.posexplode("v").alias("perm", "v")).groupBy("fold", "row", "perm").agg(F.sum("v").alias("v"))
    head = summed.filter("row < 2").groupBy("fold", "perm").agg(F.max(F.when(F.col("row") == 0, F.col("v"))).alias("sy"), F.max(F.when(F.col("row") == 1, F.col("v"))).alias("syy"))
    cells = summed.filter("row >= 2").select("fold", "perm", (F.col("row") - 2).alias("pos"), F.col("v").alias("sxy")).join(head, ["fold", "perm"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        made = {}
        for name, g in pdf.groupby("fold"):
            g = g.sort_values("pos")
            n, shift, sx, sxx = shared.value[name]
            sy, syy = g["sy"].iloc[0], g["syy"].iloc[0]
            sxy = g["sxy"].to_numpy() - c * sy
            prod = np.zeros((len(c) + 1, len(c) + 1))
            prod[:-1, :-1], prod[:-1, -1], prod[-1, :-1], prod[-1, -1] = sxx, sxy, sxy, syy
            made[name] = gram.Moments(n, np.append(shift, 0.0), np.append(sx, sy), prod)
        every = gram.total(made)
        press = 0.0
        for m in made.values():
            model = gram.pls(every.without(m), components)
            b = model.coef[-1]
            base = model.intercept[-1] + b @ m.shift[:-1]
            # sum of (y - base - b (x - shift))^2 over the fold, from its moments
            press += m.products[-1, -1] - 2 * base * m.sums[-1] - 2 * b @ m.products[:-1, -1] + m.n * base**2 + 2 * base * (b @ m.sums[:-1]) + b @ m.products[:-1, :-1] @ b
        return pd.DataFrame({"perm": pdf["perm"].iloc[:1], "rmsecv": [np.sqrt(max(press, 0.0) / every.n)]})

    errors = cells.groupBy("perm").applyInPandas(run, "perm int, rmsecv double")
    real = F.max(F.when(F.col("perm") == 0, F.col("rmsecv")))
    one = errors.agg(real.alias("rmsecv"), F.collect_list(F.when(F.col("perm") > 0, F.col("rmsecv"))).alias("null"))  # n_perm numbers
    good = F.size(F.filter("null", lambda v: v <= F.col("rmsecv")))
    return one.select("rmsecv", F.size("null").alias("n_perm"), good.alias("as_good"), ((good + 1) / (F.size("null") + 1)).alias("p"))
