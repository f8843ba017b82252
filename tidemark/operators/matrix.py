"""Matrices in long form (``row, col, value``): normalizations, arithmetic, filters, sets, clustering."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.stats import average_rank, bounded, running

#: Pairs of columns that a clustering may have, and cells of a matrix for linear algebra: they lie in one worker.
MOST_PAIRS = 5_000_000
MOST_CELLS = 20_000_000


def _by(axis: str) -> str:
    if axis not in ("row", "col"):
        raise ValueError("axis is 'row' or 'col'")
    return axis


def _with(m: DataFrame, axis: str, *aggs: Column) -> DataFrame:
    """The matrix joined with aggregates per row or column: partial sums shuffle, not the cells of one column into one window."""
    return m.join(m.groupBy(_by(axis)).agg(*aggs), axis)


def median_center(m: DataFrame, axis: str = "col") -> DataFrame:
    return _with(m, axis, F.percentile("value", 0.5).alias("c")).select("row", "col", (F.col("value") - F.col("c")).alias("value"))


def mean_normalize(m: DataFrame, axis: str = "col") -> DataFrame:
    """Values divided by their row's or column's mean."""
    return _with(m, axis, F.avg("value").alias("c")).select("row", "col", F.try_divide("value", "c").alias("value"))


def density_normalize(m: DataFrame, axis: str = "col") -> DataFrame:
    """Values divided by their row's or column's sum."""
    return _with(m, axis, F.sum("value").alias("c")).select("row", "col", F.try_divide("value", "c").alias("value"))


def z_normalize(m: DataFrame, axis: str = "col", log: bool = False) -> DataFrame:
    """Deviations from the mean in sample standard deviations; with ``log`` of the log2 values."""
    if log:
        m = log2(m)
    return _with(m, axis, F.avg("value").alias("c"), F.stddev_samp("value").alias("d")).select("row", "col", F.try_divide(F.col("value") - F.col("c"), F.col("d")).alias("value"))


def quantile_normalize(m: DataFrame) -> DataFrame:
    """Every column gets the same values: the mean over columns of the k-th smallest takes k's place, ties in the order of rows."""
    # places within a column in two levels: equal values are counted, and only their own rows are ordered by name
    counts = running(m.groupBy("col", "value").agg(F.count("*").alias("n")), "value", ["col"], {"upto": "n"})
    tie = F.row_number().over(Window.partitionBy("col", "value").orderBy("row"))
    ranked = m.withColumn("tie", tie).join(counts, ["col", "value"]).select("row", "col", "value", (F.col("upto") - F.col("n") + F.col("tie")).alias("k"))
    means = ranked.groupBy("k").agg(F.avg("value").alias("q"))
    return ranked.join(means, "k").select("row", "col", F.col("q").alias("value"))


def log2(m: DataFrame) -> DataFrame:
    return m.select("row", "col", F.log2("value").alias("value"))


def floor_at(m: DataFrame, least: float) -> DataFrame:
    return m.select("row", "col", F.greatest("value", F.lit(least)).alias("value"))


def scale_columns(m: DataFrame, constants: DataFrame) -> DataFrame:
    """``constants``: ``col, factor``."""
    return m.join(constants, "col").select("row", "col", (F.col("value") * F.col("factor")).alias("value"))


def combine(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """Elementwise ``plus``, ``minus`` or ``times`` over the cells that both have."""
    op = {"plus": lambda x, y: x + y, "minus": lambda x, y: x - y, "times": lambda x, y: x * y}[how]
    return a.join(b.withColumnRenamed("value", "other"), ["row", "col"]).select("row", "col", op(F.col("value"), F.col("other")).alias("value"))


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """Matrix product; missing cells are zero."""
    r = b.select(F.col("row").alias("k"), F.col("col").alias("c"), F.col("value").alias("w"))
    return a.join(r, F.col("col") == F.col("k")).groupBy("row", F.col("c").alias("col")).agg(F.sum(F.col("value") * F.col("w")).alias("value"))


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("col").alias("row"), F.col("row").alias("col"), "value")


def normalization_factors(m: DataFrame) -> DataFrame:
    """``col, factor``: the mean column total over the column's total, so that scaled columns have equal totals."""
    t = m.groupBy("col").agg(F.sum("value").alias("t"))
    return t.crossJoin(F.broadcast(t.agg(F.avg("t").alias("m")))).select("col", F.try_divide("m", "t").alias("factor"))


def keep_varying(m: DataFrame, fold: float) -> DataFrame:
    """Rows whose largest value is at least ``fold`` times the smallest."""
    keep = m.groupBy("row").agg(F.min("value").alias("a"), F.max("value").alias("b")).where(F.col("b") >= F.col("a") * fold).select("row")
    return m.join(keep, "row", "left_semi")


def keep_reaching(m: DataFrame, least: float, columns: int = 1) -> DataFrame:
    """Rows with at least ``columns`` values of ``least`` or more."""
    keep = m.where(F.col("value") >= least).groupBy("row").agg(F.count("*").alias("n")).where(F.col("n") >= columns).select("row")
    return m.join(keep, "row", "left_semi")


def rank_columns(m: DataFrame) -> DataFrame:
    return average_rank(m, "value", ["col"]).select("row", "col", F.col("rank").alias("value"))


def submatrix(m: DataFrame, rows: DataFrame | None = None, columns: list[str] | None = None) -> DataFrame:
    if columns is not None:
        m = m.where(F.col("col").isin(columns))
    return m if rows is None else m.join(rows.select("row").distinct(), "row", "left_semi")


def without_rows(m: DataFrame, rows: DataFrame) -> DataFrame:
    return m.join(rows.select("row").distinct(), "row", "left_anti")


def append(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def collapse_rows(m: DataFrame, names: DataFrame) -> DataFrame:
    """Rows with the same ``description`` (``row, description``) averaged."""
    return m.join(names, "row").groupBy(F.col("description").alias("row"), "col").agg(F.avg("value").alias("value"))


def best_probe(probes: DataFrame, gene: str, p: str) -> DataFrame:
    """For each gene the row with the smallest p, ties to the smallest probe."""
    others = [c for c in probes.columns if c not in (gene, p)]
    best = probes.groupBy(gene).agg(F.min(F.struct(p, *others)).alias("m"))
    return best.select(gene, *[F.col(f"m.{c}").alias(c) for c in [p, *others]])


def column_correlation(m: DataFrame, ranks: bool = False) -> DataFrame:
    """Pearson (with ``ranks``: Spearman) correlation of every two columns over the rows they share: ``a, b, n, r``."""
    v = rank_columns(m) if ranks else m
    b = v.select("row", F.col("col").alias("b"), F.col("value").alias("y"))
    pairs = v.select("row", F.col("col").alias("a"), F.col("value").alias("x")).join(b, "row").where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"), F.corr("x", "y").alias("r"))


def column_distance(m: DataFrame) -> DataFrame:
    """Euclidean distance of every two columns over the rows they share."""
    b = m.select("row", F.col("col").alias("b"), F.col("value").alias("y"))
    pairs = m.select("row", F.col("col").alias("a"), F.col("value").alias("x")).join(b, "row").where("a < b")
    return pairs.groupBy("a", "b").agg(F.sqrt(F.sum((F.col("x") - F.col("y")) * (F.col("x") - F.col("y")))).alias("distance"))


def wide(m: DataFrame, columns: list[str]) -> DataFrame:
    """One row a row name, one column for each of the named columns."""
    return m.groupBy("row").pivot("col", columns).agg(F.first("value"))


def long(table: DataFrame, row: str) -> DataFrame:
    """Long form of a wide table; empty cells are left out."""
    values = [c for c in table.columns if c != row]
    return table.unpivot([F.col(f"`{row}`").alias("row")], [F.col(f"`{c}`").cast("double").alias(c) for c in values], "col", "value").where("value is not null") if values else table.select(F.col(row).alias("row"))


def cluster_columns(distances: DataFrame) -> DataFrame:
    """Average-linkage clustering over ``a, b, distance``: merges ``step, left, right, height, size``. Columns are few: their square matrix is one group."""

    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pdf["a"]) | set(pdf["b"]))
        d = {frozenset((x, y)): float(z) for x, y, z in zip(pdf["a"], pdf["b"], pdf["distance"], strict=True)}
        size, out = dict.fromkeys(names, 1), []
        while len(size) > 1 and d:
            pair = min(d, key=lambda k: (d[k], sorted(k)))
            x, y = sorted(pair)
            new = f"({x},{y})"
            out.append((len(out), x, y, d.pop(pair), size[x] + size[y]))
            for z in [z for z in size if z not in (x, y)]:
                parts = [(size[w], d.pop(frozenset((w, z)))) for w in (x, y) if frozenset((w, z)) in d]
                if parts:
                    d[frozenset((new, z))] = sum(n * v for n, v in parts) / sum(n for n, _ in parts)
            size[new] = size.pop(x) + size.pop(y)
        return pd.DataFrame(out, columns=["step", "left", "right", "height", "size"])

    return bounded(distances, MOST_PAIRS, "pairs of columns").withColumn("__all", F.lit(1)).groupBy("__all").applyInPandas(task, "step long, left string, right string, height double, size long")


def kmeans(vectors: DataFrame, k: int, vector: str, seed: int = 1, iterations: int = 20) -> tuple[DataFrame, float]:
    """Rows with their ``cluster``, and the silhouette of the whole."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    rows = vectors.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))
    model = KMeans(k=k, seed=seed, maxIter=iterations, predictionCol="cluster").fit(rows)
    out = model.transform(rows)
    return out.drop("features"), ClusteringEvaluator(predictionCol="cluster").evaluate(out)


def lloyd(vectors: DataFrame, vector: str, starts: list[list[float]], rounds: int, digits: int = 6) -> DataFrame:
    """Rows with the ``cluster`` of the nearest center after ``rounds`` of Lloyd's algorithm from ``starts``.

    Ties go to the smaller cluster, a center without rows stays, and centers are rounded to ``digits``, so that the order of summing
    doesn't show. The driver holds the centers; sums are taken by (cluster, component), partial ones first.
    """
    centers = [[round(float(x), digits) for x in c] for c in starts]

    def assigned() -> DataFrame:
        far = lambda c: F.round(F.aggregate(F.zip_with(F.col(vector), F.array(*[F.lit(x) for x in c]), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x), 9)
        best = F.array_min(F.array(*[F.struct(far(c).alias("d"), F.lit(k).alias("k")) for k, c in enumerate(centers)]))
        return vectors.withColumn("cluster", best["k"])

    for _ in range(rounds):
        each = assigned().select("cluster", F.posexplode(vector).alias("i", "x"))
        for r in each.groupBy("cluster", "i").agg(F.round(F.avg("x"), digits).alias("x")).collect():
            centers[r["cluster"]][r["i"]] = r["x"]
    return assigned()


def linear_algebra(m: DataFrame, what: str) -> DataFrame:
    """A decomposition of a small matrix in long form, as a long matrix; missing cells are zero.

    ``cholesky`` (an error for a matrix that is not symmetric positive definite), ``inverse``, ``qr_r`` and ``qr_q`` (the diagonal of R is
    not negative), ``lu_l`` and ``lu_u`` (of the rows as they are, with unit diagonal in L; an error where a pivot is 0), ``singular``,
    ``singular_left``, ``singular_right``, ``eigen`` and ``eigen_vectors`` (of a symmetric matrix, largest value first; the largest part
    of each vector is positive). The matrix is one group; more than ``MOST_CELLS`` cells are an error.
    """

    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, cols = sorted(set(pdf["row"])), sorted(set(pdf["col"]))
        a = pdf.pivot_table(index="row", columns="col", values="value", fill_value=0.0).reindex(index=rows, columns=cols, fill_value=0.0).to_numpy(float)
        if what == "cholesky":
            if not np.allclose(a, a.T):
                raise ValueError("the matrix is not symmetric")
            out = np.linalg.cholesky(a)
        elif what == "inverse":
            out, rows, cols = np.linalg.inv(a), cols, rows
        elif what in ("qr_r", "qr_q"):
            q, r = np.linalg.qr(a)
            sign = np.where(np.diag(r) < 0, -1, 1)
            out = r * sign[:, None] if what == "qr_r" else q * sign
            cols = cols if what == "qr_r" else [f"{i:04d}" for i in range(q.shape[1])]
            rows = [f"{i:04d}" for i in range(len(r))] if what == "qr_r" and a.shape[0] != a.shape[1] else rows
        elif what in ("lu_l", "lu_u"):
            low, out = np.eye(len(a)), a.copy()
            for i in range(len(a)):
                if abs(out[i, i]) < 1e-300:
                    raise ValueError("a pivot is 0")
                low[i + 1 :, i] = out[i + 1 :, i] / out[i, i]
                out[i + 1 :] -= np.outer(low[i + 1 :, i], out[i])
            out, cols = (low, rows) if what == "lu_l" else (np.triu(out), cols)
        elif what in ("singular_left", "singular_right", "eigen_vectors"):
            if what == "eigen_vectors":
                if not np.allclose(a, a.T):
                    raise ValueError("the matrix is not symmetric")
                out = np.linalg.eigh(a)[1][:, ::-1]
            else:
                u, _, v = np.linalg.svd(a, full_matrices=False)
                out = u if what == "singular_left" else v.T
            out = out * np.where(np.take_along_axis(out, np.abs(out).argmax(0)[None], 0)[0] < 0, -1, 1)
            rows, cols = (cols if what == "singular_right" else rows), [f"{i:04d}" for i in range(out.shape[1])]
        else:
            values = np.linalg.svd(a, compute_uv=False) if what == "singular" else np.sort(np.linalg.eigvals(a).real)[::-1]
            out, rows, cols = values[:, None], [f"{i:04d}" for i in range(len(values))], ["value"]
        return pd.DataFrame([(r, c, float(out[i, j])) for i, r in enumerate(rows[: len(out)]) for j, c in enumerate(cols)], columns=["row", "col", "value"])

    return bounded(m, MOST_CELLS, "cells").withColumn("__all", F.lit(1)).groupBy("__all").applyInPandas(task, "row string, col string, value double")


def loess(df: DataFrame, keys: list[str], x: str, y: str, span: float = 0.3) -> DataFrame:
    """``keys, x, y, fit``: locally weighted (tricube) linear regression per key; a key's points are one group."""
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([x, y])
        xs, ys = pdf[x].to_numpy(float), pdf[y].to_numpy(float)
        n = len(xs)
        k = max(2, min(n, int(np.ceil(span * n))))
        fit = np.empty(n)
        for i in range(n):
            d = np.abs(xs - xs[i])
            h = np.partition(d, k - 1)[k - 1] or 1.0
            w = np.clip(1 - (d / h) ** 3, 0, None) ** 3
            sw, mx, my = w.sum(), (w @ xs) / w.sum(), (w @ ys) / w.sum()
            sxx = w @ (xs - mx) ** 2
            fit[i] = my + (w @ ((xs - mx) * (ys - my)) / sxx * (xs[i] - mx) if sxx > 1e-12 * sw else 0.0)
        out = pdf[[*keys, x, y]].copy()
        out["fit"] = fit
        return out

    return df.groupBy(*keys).applyInPandas(task, ", ".join(f"`{c}` {fields[c]}" for c in [*keys, x, y]) + ", fit double")


def gene_set_pairs(sets: DataFrame, universe: int) -> DataFrame:
    """``a, b, shared, size_a, size_b, p``: genes two sets share and the hypergeometric p-value of as many."""
    from tidemark.functions.stats import hypergeometric_tail

    s = sets.select("set_name", "gene").distinct()
    sizes = s.groupBy("set_name").agg(F.count("*").alias("n"))
    x, y = s.select(F.col("set_name").alias("a"), "gene"), s.select(F.col("set_name").alias("b"), "gene")
    shared = x.join(y, "gene").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    out = shared.join(sizes.withColumnsRenamed({"set_name": "a", "n": "size_a"}), "a").join(sizes.withColumnsRenamed({"set_name": "b", "n": "size_b"}), "b")
    return out.select("a", "b", "shared", "size_a", "size_b", hypergeometric_tail(F.col("shared"), F.col("size_a"), F.col("size_b"), F.lit(universe)).alias("p"))


def viterbi(observations: DataFrame, keys: list[str], order: str, symbol: str, start: dict[str, float], moves: dict[str, dict[str, float]], emits: dict[str, dict[str, float]]) -> DataFrame:
    """Most likely state path of each key's ordered symbols: ``keys, order, state, log_likelihood`` (of the whole path).

    Probabilities of each state must add up to 1. A key's sequence is one group and lies in a worker, with a step of the states for each
    symbol; many keys are worked on in parallel.
    """
    for name, p in [("start", start), *moves.items(), *emits.items()]:
        if abs(sum(p.values()) - 1) > 1e-8:
            raise ValueError(f"probabilities of {name} don't add up to 1")
    states = sorted(start)
    fields = {f.name: f.dataType.simpleString() for f in observations.schema.fields}
    log = lambda p: float(np.log(p)) if p > 0 else -np.inf

    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        score, back = None, []
        for s in pdf[symbol]:
            e = np.array([log(emits[x].get(s, 0.0)) for x in states])
            if score is None:
                score = np.array([log(start[x]) for x in states]) + e
            else:
                step = score[:, None] + np.array([[log(moves[x].get(z, 0.0)) for z in states] for x in states])
                back.append(step.argmax(0))
                score = step.max(0) + e
        at = int(score.argmax())
        best, path = float(score[at]), [at]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        out = pdf[[*keys, order]].copy()
        out["state"], out["log_likelihood"] = [states[i] for i in reversed(path)], best
        return out

    return observations.groupBy(*keys).applyInPandas(task, ", ".join(f"`{c}` {fields[c]}" for c in [*keys, order]) + ", state string, log_likelihood double")

