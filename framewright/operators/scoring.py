"""Batch scoring with a user function, and training metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.operators.segments import OrderedParts


def score_batches(df: DataFrame, vec: str, load_fn: Callable[[], Any],
                  predict_fn: Callable[[Any, np.ndarray], np.ndarray], row_id: str,
                  batch: int = 64, out: str = "score",
                  out_type: T.DataType | None = None) -> DataFrame:
    """Run a user function over row batches; row order and count are kept.

    ``load_fn`` runs once per task.  ``predict_fn`` gets the model and a stacked
    array and returns one result per row; a failure names the rows it met.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(out, out_type or T.DoubleType())])
    scalar = not isinstance(schema[out].dataType, T.ArrayType)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load_fn()
        for pdf in batches:
            results: list[Any] = []
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at:at + batch]
                try:
                    got = predict_fn(model, np.stack([np.asarray(v) for v in part[vec]]))
                except Exception as e:
                    ids = part[row_id].tolist()
                    raise RuntimeError(f"scoring failed in rows {ids[0]}..{ids[-1]}: {e}") from e
                if len(got) != len(part):
                    raise RuntimeError(f"scoring returned {len(got)} results for {len(part)} rows")
                results.extend(got.tolist() if scalar else list(got))
            yield pdf.assign(**{out: results})

    return df.mapInPandas(run, schema)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda s, v: s + v)


def cosine_sync_loss(audio: DataFrame, video: DataFrame, key: list[str]) -> DataFrame:
    """Cosine of normalised vectors and its cross entropy against 1 (log floored at -100)."""
    pair = audio.select(*key, F.col("vec").alias("a")).join(video.select(*key, F.col("vec").alias("v")), key)
    a, v = F.col("a"), F.col("v")
    norm = lambda c: F.greatest(F.sqrt(_dot(c, c)), F.lit(1e-12))
    out = pair.withColumn("cosine", _dot(a, v) / (norm(a) * norm(v))).drop("a", "v")
    return out.withColumn("loss", F.when(F.col("cosine") > 0, F.least(-F.log("cosine"), F.lit(100.0))).otherwise(100.0))


def l1_mse_metrics(pred: DataFrame, truth: DataFrame, key: list[str], by: list[str],
                   perceptual: str | None = None, sync: str | None = None) -> DataFrame:
    """L1, MSE and the weighted total ``l1 + 0.01*perceptual + 10*sync``.

    Predictions without a truth of their length take no part in the means and are counted in ``unmatched``.
    """
    pair = pred.join(truth.select(*key, F.col("values").alias("_t")), key, "left")
    fits = F.coalesce(F.size("values") == F.size("_t"), F.lit(False))
    d = F.when(fits, F.zip_with("values", "_t", lambda x, y: x.cast("double") - y.cast("double")))
    fold = lambda f: F.aggregate(F.transform(d, f), F.lit(0.0), lambda s, v: s + v)
    rows = pair.select(
        *by, F.size(d).cast("long").alias("n"), fold(F.abs).alias("l1"), fold(lambda v: v * v).alias("q"),
        F.when(fits, F.col(perceptual) if perceptual else F.lit(0.0)).alias("p"), F.when(fits, F.col(sync) if sync else F.lit(0.0)).alias("s"),
        fits.alias("fits"))
    out = rows.groupBy(*by).agg((F.sum("l1") / F.sum("n")).alias("l1"), (F.sum("q") / F.sum("n")).alias("mse"),
                                F.avg("p").alias("perceptual"), F.avg("s").alias("sync"), F.count_if(~F.col("fits")).alias("unmatched"))
    return out.withColumn("total", F.col("l1") + F.col("perceptual") * 0.01 + F.col("sync") * 10)


def best_so_far(log: DataFrame, run: str, epoch: str, loss: str) -> DataFrame:
    """Epochs whose loss is below every earlier one of the run."""
    seen = OrderedParts(log.select(run, epoch, loss), [run], [epoch]).running(loss, "_best", "min", inclusive=False)
    return seen.filter(F.col("_best").isNull() | (F.col(loss) < F.col("_best"))).drop("_best")
