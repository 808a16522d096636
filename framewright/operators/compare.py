"""Dataset comparison and data quality over tensor tables (tensor_id, values array)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TENSOR = "tensor_id"


def _fold(arr: Column, start: Column, f: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(arr, start, f)


def _sum(arr: Column) -> Column:
    return _fold(arr, F.lit(0.0), lambda a, v: a + v)


def _count(arr: Column, test: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(arr, test)).cast("long")


def _above(limit: float) -> Callable[[Column], Column]:
    return lambda x: x > F.lit(limit)


def _within(lo: float, hi: float) -> Callable[[Column], Column]:
    return lambda x: x.between(lo, hi)


def tensor_stats(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """min, max, mean, population std, non-zero and total counts.

    Arrays are folded in their row; only one partial row per tensor is shuffled.
    """
    v = F.transform("values", lambda x: x.cast("double"))
    folded = df.select(
        *(by or [TENSOR]), F.array_min(v).alias("lo"), F.array_max(v).alias("hi"), _sum(v).alias("s"),
        _sum(F.transform(v, lambda x: x * x)).alias("q"), _count(v, lambda x: x != 0).alias("nz"),
        F.size(v).cast("long").alias("n"))
    out = folded.groupBy(*(by or [TENSOR])).agg(
        F.min("lo").alias("min"), F.max("hi").alias("max"), F.sum("s").alias("s"), F.sum("q").alias("q"),
        F.sum("nz").alias("nonzero_count"), F.sum("n").alias("total_elements"))
    mean = F.col("s") / F.col("total_elements")
    return out.withColumns({"mean": mean, "std": F.sqrt(F.greatest(
        F.col("q") / F.col("total_elements") - mean * mean, F.lit(0.0)))}).drop("s", "q")


def paired(a: DataFrame, b: DataFrame, key: list[str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Two runs side by side with the absolute differences; missing sides stay null.

    ``keep`` names further columns of ``a``.
    """
    on = key or [TENSOR]
    left = a.select(*on, *keep, F.col("values").alias("va"))
    right = b.select(*on, F.col("values").alias("vb"))
    diff = F.zip_with("va", "vb", lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    same = F.size("va") == F.size("vb")
    return left.join(right, on, "full").withColumn("diff", F.when(same, diff)).withColumn(
        "status", F.when(F.col("va").isNull(), "only b").when(F.col("vb").isNull(), "only a")
        .when(same, "paired").otherwise("shape"))


def _sides() -> dict[str, Column]:
    """How many tensors of a group are compared, and how many are not and why."""
    return {name: (F.col("status") == status).cast("long") for name, status in (
        ("paired", "paired"), ("only_a", "only a"), ("only_b", "only b"), ("other_shape", "shape"))}


def tensor_diff(pairs: DataFrame, by: list[str]) -> DataFrame:
    """MAE, max, RMSE, share exact, below 1e-3, below 1e-2, above 1e-2, per ``by`` group.

    Tensors without a partner of the same shape only count in ``only_a``, ``only_b`` and ``other_shape``.
    """
    d = F.col("diff")
    folded = pairs.select(
        *by, *[c.alias(n) for n, c in _sides().items()], F.size(d).cast("long").alias("n"), _sum(d).alias("s"), _sum(F.transform(d, lambda x: x * x)).alias("q"),
        F.array_max(d).alias("m"), _count(d, lambda x: x == 0).alias("c0"), _count(d, lambda x: x < 1e-3).alias("c3"),
        _count(d, lambda x: x < 1e-2).alias("c2"), _count(d, lambda x: x > 1e-2).alias("over"))
    n = F.sum("n")
    pct = lambda c: F.sum(c) * 100.0 / n
    return folded.groupBy(*by).agg(
        n.alias("n"), (F.sum("s") / n).alias("mae"), F.max("m").alias("max_diff"), F.sqrt(F.sum("q") / n).alias("rmse"),
        pct("c0").alias("pct_exact"), pct("c3").alias("pct_lt_1e3"), pct("c2").alias("pct_lt_1e2"), pct("over").alias("pct_gt_1e2"),
        *[F.sum(c).alias(c) for c in _sides()])


def diff_by_frame(pairs: DataFrame, frame_len: int, tol: float = 1e-3) -> DataFrame:
    """Mean and max difference and non-zero counts per sub-frame of a tensor; a tensor without a partner is one row with its status."""
    n = F.ceil(F.size("diff") / F.lit(frame_len)).cast("int")
    cut = lambda c, f: F.slice(c, f * frame_len + 1, F.lit(frame_len))
    frames = F.transform(F.sequence(F.lit(0), n - 1), lambda f: F.struct(
        f.alias("frame"), (_sum(cut("diff", f)) / F.size(cut("diff", f))).alias("mean_diff"),
        F.array_max(cut("diff", f)).alias("max_diff"), _count(cut("va", f), lambda x: x != 0).alias("nonzero_a"),
        _count(cut("vb", f), lambda x: x != 0).alias("nonzero_b")))
    return pairs.select(TENSOR, "status", F.explode_outer(frames).alias("f")).select(
        TENSOR, "status", "f.*", F.coalesce(F.col("f.max_diff") <= F.lit(tol), F.lit(False)).alias("passed"))


def top_diffs(pairs: DataFrame, k: int, shape: tuple[int, int]) -> DataFrame:
    """The k largest differences with their unravelled position, beside the number of tensors that had no partner.

    Each tensor offers its own k largest, then one global top-k keeps k rows per task.
    """
    rows, cols = shape
    ranked = F.slice(F.reverse(F.array_sort(F.transform("diff", lambda d, i: F.struct(
        d.alias("d"), (-i).alias("neg"))))), 1, k)
    alone = pairs.agg(F.count_if(F.col("status") != "paired").alias("unpaired"))
    return (
        pairs.filter("status = 'paired'").select(TENSOR, "va", "vb", F.explode(ranked).alias("t"))
        .select(TENSOR, (-F.col("t.neg")).alias("pos"), F.col("t.d").alias("diff"),
                F.get("va", -F.col("t.neg")).cast("double").alias("a"), F.get("vb", -F.col("t.neg")).cast("double").alias("b"))
        .orderBy(F.desc("diff"), TENSOR, "pos").limit(k).crossJoin(F.broadcast(alone))
        .withColumns({"row": F.floor(F.col("pos") / F.lit(cols)).cast("int"), "col": F.col("pos") % cols})
    )


def error_histogram(pairs: DataFrame, tol: float, by: list[str]) -> DataFrame:
    """Counts above tol, 10·tol, 100·tol, 1000·tol, the mismatch percentage, and the tensors without a partner."""
    levels = {"gt_1": tol, "gt_10": 10 * tol, "gt_100": 100 * tol, "gt_1000": 1000 * tol}
    folded = pairs.select(
        *by, *[c.alias(n) for n, c in _sides().items()], F.size("diff").cast("long").alias("n"),
        *[_count(F.col("diff"), _above(t)).alias(c) for c, t in levels.items()])
    out = folded.groupBy(*by).agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in [*levels, *_sides()]])
    return out.withColumn("mismatch_pct", F.col("gt_1") * 100.0 / F.col("n"))


def tolerance_gate(pairs: DataFrame, stat_tol: float = 0.01, max_tol: float = 0.1, mean_tol: float = 0.01,
                   same_tol: float = 1e-5) -> DataFrame:
    """Pass flags per tensor: shape, statistics, max and mean difference, identity."""
    a, b = [F.transform(c, lambda x: x.cast("double")) for c in ("va", "vb")]
    mean = lambda v: _sum(v) / F.size(v)

    def std(v: Column) -> Column:
        return F.sqrt(F.greatest(_sum(F.transform(v, lambda x: x * x)) / F.size(v) - mean(v) * mean(v), F.lit(0.0)))

    near = lambda f: F.abs(f(a) - f(b)) <= F.lit(stat_tol)
    stats_ok = near(F.array_min) & near(F.array_max) & near(mean) & near(std)
    worst = F.array_max("diff")
    out = pairs.select(
        TENSOR, (F.col("status") == "paired").alias("shape_ok"),
        F.coalesce((F.col("status") == "paired") & stats_ok, F.lit(False)).alias("stats_ok"),
        F.coalesce(worst <= F.lit(max_tol), F.lit(False)).alias("max_ok"),
        F.coalesce(mean(F.col("diff")) <= F.lit(mean_tol), F.lit(False)).alias("mean_ok"),
        F.coalesce(worst <= F.lit(same_tol), F.lit(False)).alias("identical"))
    return out.withColumn("passed", F.expr("shape_ok and stats_ok and max_ok and mean_ok"))


def value_bands(df: DataFrame, by: list[str]) -> DataFrame:
    """Percent of values near 0, near 1 and near -1."""
    v = F.transform("values", lambda x: x.cast("double"))
    bands = {"near_zero": (-0.1, 0.1), "near_one": (0.9, 1.0), "near_minus_one": (-1.0, -0.9)}
    folded = df.select(*by, F.size(v).cast("long").alias("n"), *[
        _count(v, _within(lo, hi)).alias(c) for c, (lo, hi) in bands.items()])
    return folded.groupBy(*by).agg(*[(F.sum(c) * 100.0 / F.sum("n")).alias(c) for c in bands])


def _vector_groups(df: DataFrame, group: str, idx: str) -> DataFrame:
    return df.groupBy(group, "values").agg(F.min(idx).alias("first"), F.count("*").alias("copies"))


def unique_rows(df: DataFrame, group: str, idx: str) -> DataFrame:
    """Rows and distinct vectors per group."""
    return _vector_groups(df, group, idx).groupBy(group).agg(
        F.sum("copies").alias("n_rows"), F.count("*").alias("n_unique"))


def first_matches(df: DataFrame, group: str, idx: str, salts: int = 16) -> DataFrame:
    """Each repeated row with the first equal row of its group.

    One row per copy names the whole set of equal rows without listing every
    pair.  Only vectors that do repeat are joined back, salted against huge sets.
    """
    again = _vector_groups(df, group, idx).filter("copies > 1").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(idx), F.lit(salts)).cast("int"))
    return salted.join(again, [group, "values", "_salt"]).filter(F.col(idx) != F.col("first")).select(
        group, F.col("first").alias("first_idx"), F.col(idx), "copies")


def constant_features(df: DataFrame, by: list[str]) -> DataFrame:
    """Positions with one value over all rows of a group, and positions that vary."""
    pos = df.select(*by, F.posexplode("values").alias("pos", "v"))
    span = pos.groupBy(*by, "pos").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    const = F.col("lo") == F.col("hi")
    return span.groupBy(*by).agg(F.count_if(const).alias("constant"), F.count_if(~const).alias("varying"))


def zero_vectors(df: DataFrame, by: list[str]) -> DataFrame:
    """All-zero vectors and zero values per group."""
    zeros = _count(F.col("values"), lambda x: x == 0)
    return df.groupBy(*by).agg(
        F.count("*").alias("vectors"), F.count_if(F.forall("values", lambda x: x == 0)).alias("all_zero"),
        F.count_if(zeros > 0).alias("with_zero"), F.sum(zeros).alias("zero_values"))


def image_size_match(extracted: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """Extracted against stored region sizes."""
    s = stored.select(*key, F.col("w").alias("stored_w"), F.col("h").alias("stored_h"))
    return extracted.join(s, key, "left").withColumn("match", F.coalesce(
        (F.col("w") == F.col("stored_w")) & (F.col("h") == F.col("stored_h")), F.lit(False)))


def validate_requests(df: DataFrame, max_batch: int = 32, frame_values: int = 6 * 320 * 320,
                      feature_values: int = 8192) -> DataFrame:
    """First failing rule per request; ``success`` and ``error`` columns."""
    s = lambda c: c.cast("string")
    batch, visual, feats = F.col("batch_size"), F.col("visual_bytes"), F.col("feature_bytes")
    want = batch.cast("long") * frame_values * 4
    no_raw = F.coalesce(F.col("raw_audio_bytes"), F.lit(0)) == 0
    error = (
        F.when(F.coalesce(F.col("model_id"), F.lit("")) == "", "no model named")
        .when((batch <= 0) | (batch > max_batch), F.concat(F.lit(f"batch outside 1 to {max_batch}: "), s(batch)))
        .when(visual != want, F.concat(F.lit("frames have "), s(visual), F.lit(" bytes instead of "), s(want)))
        .when(no_raw & (feats > 0) & (feats != feature_values * 4), F.concat(
            F.lit("features have "), s(feats), F.lit(f" bytes instead of {feature_values * 4}")))
        .when(no_raw & (F.coalesce(feats, F.lit(0)) == 0), "neither audio nor features"))
    return df.withColumn("error", error).withColumn("success", F.col("error").isNull())
