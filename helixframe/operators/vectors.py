"""Vectors: normalisation, readouts, batch scoring, projection (VEC-01..05,
JON-05)."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def l2_normalize(vec) -> Column:
    """Scale to unit L2 norm; an all-zero row stays as it is (VEC-01).  The
    norm is bound as a lambda variable, so it is computed once per row and
    not once per element."""
    v = F.transform(_c(vec), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.element_at(F.transform(F.array(norm), lambda n: F.when(
        n > 0, F.transform(v, lambda x: x / n)).otherwise(v)), 1)


def first_position(per_position) -> Column:
    """The vector at the first (marker) position (VEC-02)."""
    return F.element_at(_c(per_position), 1)


def readout(per_position, how: str = "mean") -> Column:
    """Sum or mean over positions of an ``array<array<double>>`` (VEC-03);
    any other name is an error, as in the reference."""
    if how not in ("mean", "sum"):
        raise ValueError(f"unknown readout {how!r}")
    a = _c(per_position)
    dim = F.size(F.element_at(a, 1))
    sums = F.transform(F.sequence(F.lit(0), dim - 1),
                       lambda j: F.aggregate(a, F.lit(0.0), lambda acc, r: acc + F.get(r, j).cast("double")))
    out = sums if how == "sum" else F.transform(sums, lambda s: s / F.size(a))
    return F.when(F.size(a) > 0, out)


def chunk_positions(vec, n_positions: int) -> Column:
    """View a flat vector as ``n_positions`` equal per-position vectors."""
    v = _c(vec)
    width = F.floor(F.size(v) / n_positions).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(n_positions - 1)),
                       lambda i: F.slice(v, i * width + 1, width))


def group_mean(df: DataFrame, vec: str, group_cols: Sequence[str], out: str = "mean") -> DataFrame:
    """Per-group mean vector through Spark ML's ``Summarizer`` (partial
    aggregation of whole vectors; a hot group is no problem)."""
    d = df.select(*group_cols, array_to_vector(F.transform(vec, lambda x: x.cast("double"))).alias("_v"))
    m = d.groupBy(*group_cols).agg(Summarizer.mean(F.col("_v")).alias("_m"))
    return m.select(*group_cols, vector_to_array("_m").alias(out))


def _linear(weights, bias):
    w = np.asarray(weights, dtype=np.float64)

    def model(x):
        if x.shape[1] != len(w):
            raise ValueError(f"rows of {x.shape[1]} values for a model of {len(w)} weights")
        return x @ w + bias
    return model


def linear_loader(weights, bias: float = 0.0):
    """A loader for :func:`score_batches` of a fixed linear model."""
    return functools.partial(_linear, list(weights), bias)


def score_batches(df: DataFrame, loader: Callable[[], Callable[[np.ndarray], np.ndarray]],
                  feature_col: str, keep_cols: Sequence[str], out_cols: Sequence[str],
                  batch_size: int = 1024) -> DataFrame:
    """Score a table with a model in Arrow batches (VEC-04, JON-05).

    ``loader()`` runs once per task and returns ``model(X) -> Y`` with X of
    shape (n, d) and Y of shape (n, len(out_cols)) or (n,).  Ids and labels in
    ``keep_cols`` travel with their rows, so no join is needed afterwards;
    every row is scored (no dropped last batch).
    """
    keep = list(keep_cols)
    schema_in = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    out_schema = ", ".join([f"{c} {schema_in[c]}" for c in keep] + [f"{c} double" for c in out_cols])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = loader()
        for pdf in batches:
            for start in range(0, len(pdf), batch_size):
                part = pdf.iloc[start:start + batch_size]
                if part.empty:
                    continue
                x = np.stack([np.asarray(v, dtype=np.float64) for v in part[feature_col]])
                y = np.asarray(model(x), dtype=np.float64)
                if y.ndim == 1:
                    y = y[:, None]
                res = part[keep].reset_index(drop=True).copy()
                for j, c in enumerate(out_cols):
                    res[c] = y[:, j]
                yield res

    return df.select(*keep, feature_col).mapInPandas(run, out_schema)


def project_2d(df: DataFrame, vec: str, keep_cols: Sequence[str], k: int = 2) -> DataFrame:
    """Project vectors to ``k`` dimensions with PCA (VEC-05; the reference's
    single-machine UMAP is re-aimed to a distributed covariance pass)."""
    d = df.select(*keep_cols, array_to_vector(F.transform(vec, lambda x: x.cast("double"))).alias("_v"))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(d)
    out = model.transform(d).select(*keep_cols, vector_to_array("_p").alias("_pa"))
    return out.select(*keep_cols, *[F.col("_pa")[i].alias(f"pc{i + 1}") for i in range(k)])
