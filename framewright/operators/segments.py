"""Bounded segments with a halo, and windows over hot keys.

Sequence operators need neighbouring rows.  A window partitioned by clip would
put a long clip into one task, so a clip is cut into segments of ``span`` rows,
each holding copies of a few rows of its neighbours.  One shuffle on
(key, segment) serves every operator on top, and no group exceeds
``span + before + after`` rows however long its clip is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def halo_segments(
    df: DataFrame,
    value: Column,
    span: int = 64,
    before: int = 0,
    after: int = 0,
    key: str = "clip_id",
    idx: str = "frame_idx",
) -> DataFrame:
    """Group rows of a dense index into (key, seg) with neighbour rows attached.

    Returns ``key, seg, rows`` where ``rows`` is an array of (i, v) in index order.
    Segments made of neighbour copies only are kept, for operators whose output
    may run one step past the last row.
    """
    if max(before, after) > span:
        raise ValueError("a halo may not be longer than the segment")
    i, s = F.col(idx), F.floor(F.col(idx) / F.lit(span)).cast("long")
    offset = F.pmod(i, F.lit(span))
    homes = [s]
    if after:
        homes.append(F.when((offset < after) & (s > 0), s - 1))
    if before:
        homes.append(F.when(offset >= span - before, s + 1))
    return (
        df.select(F.col(key), i.cast("long").alias("i"), value.alias("v"),
                  F.explode(F.array_compact(F.array(*homes))).alias("seg"))
        # Collecting before the shuffle would only buffer rows, so shuffle them first.
        .repartition(F.col(key), F.col("seg"))
        .groupBy(key, "seg")
        .agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("rows"))
    )


def with_bounds(segs: DataFrame, span: int) -> DataFrame:
    """Add the first/last index present, and the core range owned by the segment.

    ``hi + 1`` equals the clip length whenever the clip ends inside the segment
    or its halo; otherwise it is a lower bound past everything the core needs.
    """
    return segs.select(
        "*",
        F.col("rows")[0]["i"].alias("lo"),
        F.element_at("rows", -1)["i"].alias("hi"),
        (F.col("seg") * span).alias("core_lo"),
        ((F.col("seg") + 1) * span - 1).alias("core_hi"),
    )


def spread_join(rows: DataFrame, per_key: DataFrame, last_idx: str, key: str = "clip_id",
                idx: str = "block_idx", width: int = 1024, how: str = "inner") -> DataFrame:
    """Join per-key values to rows of a dense index without gathering a key.

    ``per_key`` carries the last index of its key in ``last_idx``; it is repeated
    once per ``width`` rows, so the shuffle key is (key, idx div width).
    """
    stripe = "_stripe"
    many = per_key.withColumn(
        stripe, F.explode(F.sequence(F.lit(0).cast("long"),
                                     F.floor(F.col(last_idx) / F.lit(width)).cast("long")))
    ).drop(last_idx)
    return (
        rows.withColumn(stripe, F.floor(F.col(idx) / F.lit(width)).cast("long"))
        .join(many, [key, stripe], how)
        .drop(stripe)
    )


def salted_attach(rows: DataFrame, per_key: DataFrame, keys: Sequence[str], salt_from: Sequence[str],
                  salts: int = 32, how: str = "inner") -> DataFrame:
    """Join one value row per key to many rows, each key over ``salts`` tasks.

    ``per_key`` holds a few numbers per key, so its ``salts`` copies stay small
    next to ``rows``; every row finds its key in exactly one copy.
    """
    salt = F.pmod(F.xxhash64(*salt_from), F.lit(salts)).cast("int")
    copies = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", salt).join(copies, [*keys, "_salt"], how).drop("_salt")


def range_edges(df: DataFrame, cols: Sequence[str], parts: int) -> Column:
    """Up to ``parts - 1`` edges that cut the rows, ordered by ``cols``, into parts of about equal size; a sorted array.

    They come from the ``16 * parts`` rows of smallest hash, so their number does not grow with the rows and the same rows
    give the same edges.  The column is a subquery: it runs with the query that uses it.
    """
    sample = df.select(*cols).orderBy(F.xxhash64(*cols), *cols).limit(16 * parts).agg(
        F.sort_array(F.collect_list(F.struct(*cols))).alias("s"))
    at = F.transform(F.sequence(F.lit(1), F.lit(parts)), lambda i: F.floor(i * F.size("s") / parts).cast("int"))
    return sample.select(F.array_distinct(F.transform(
        F.filter(at, lambda i: i < F.size("s")), lambda i: F.get("s", i)))).scalar()


def part_of(edges: Column, row: Column, parts: int) -> Column:
    """How many of the sorted ``edges`` (fewer than ``parts``) are not above ``row``, by bisection."""
    start = F.struct(F.lit(0).alias("lo"), F.size(edges).alias("hi"), edges.alias("e"), row.alias("r"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        below = F.get(s["e"], mid) <= s["r"]
        wide = s["lo"] < s["hi"]
        return F.struct(F.when(wide & below, mid + 1).otherwise(s["lo"]).alias("lo"),
                        F.when(wide & ~below, mid).otherwise(s["hi"]).alias("hi"), s["e"].alias("e"), s["r"].alias("r"))

    steps = F.sequence(F.lit(1), F.lit(max(1, parts.bit_length())))
    return F.aggregate(steps, start, halve, lambda s: s["lo"])


def _not_null(col: str, kind: T.DataType) -> Column:
    """The column with some value of its type in place of null (``to_json`` where the type has no simple one)."""
    if isinstance(kind, T.NumericType):
        return F.coalesce(F.col(col), F.lit(0).cast(kind))
    if isinstance(kind, T.StringType):
        return F.coalesce(F.col(col), F.lit(""))
    if isinstance(kind, T.TimestampType):
        return F.coalesce(F.col(col), F.timestamp_micros(F.lit(0)))
    return F.to_json(F.struct(col))


class OrderedParts:
    """Ordered analytics over keys of any size.

    Range edges, from a bounded sample, give every row the number of its part as a plain expression, so a hot key spreads
    over many parts and building a plan starts no job.  Each function works inside (keys, part) and adds a carry computed
    from one summary row per (keys, part).  ``order`` must end in a unique column.  A null key is a key like any other.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str],
                 parts: int | None = None):
        self.keys, self.order, self.names = list(keys), list(order), df.columns
        parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        cols = [*self.keys, *self.order]
        # Rows and carries meet on columns without nulls, so that the join keeps the partitioning of the windows.
        plain = {}
        for i, k in enumerate(self.keys):
            plain |= {f"_k{i}": _not_null(k, df.schema[k].dataType), f"_n{i}": F.col(k).isNull()}
        self._by = list(plain)
        self.rows = df.withColumn("_edges", range_edges(df, cols, parts)).withColumns(
            {**plain, "_part": part_of(F.col("_edges"), F.struct(*cols), parts)}).drop("_edges")
        self._local = Window.partitionBy(*self._by, "_part").orderBy(*self.order)
        self._parts = Window.partitionBy(*self._by).orderBy("_part")

    def _with_carry(self, local: DataFrame, per_part: Column, carry: Column, name: str, value: Column) -> DataFrame:
        """Rows with ``value``, which may use ``_op_carry``: ``carry`` over the earlier parts' ``per_part`` (named ``_op``)."""
        summary = self.rows.groupBy(*self._by, "_part").agg(per_part.alias("_op")).select(*self._by, "_part", carry.alias("_op_carry"))
        return local.join(summary, [*self._by, "_part"], "left").withColumn(name, value).select(
            *self.names, *[name] * (name not in self.names))

    def row_number(self, name: str = "rn") -> DataFrame:
        """1-based position within the key."""
        before = self._parts.rowsBetween(Window.unboundedPreceding, -1)
        return self._with_carry(self.rows.withColumn(name, F.row_number().over(self._local).cast("long")), F.count(F.lit(1)),
                                F.coalesce(F.sum("_op").over(before), F.lit(0)), name, F.col(name) + F.col("_op_carry"))

    def lag(self, col: str, name: str) -> DataFrame:
        """Value of ``col`` in the previous row of the key."""
        local = self.rows.withColumn(name, F.lag(col).over(self._local)).withColumn("_op_first", F.row_number().over(self._local) == 1)
        return self._with_carry(local, F.max_by(F.col(col), F.struct(*self.order)), F.lag("_op").over(self._parts), name,
                                F.when(F.col("_op_first"), F.col("_op_carry")).otherwise(F.col(name)))

    def running(self, col: str, name: str, kind: str = "sum", inclusive: bool = True) -> DataFrame:
        """Running sum, min, max, or last non-null value of ``col``."""
        agg = {"sum": F.sum, "min": F.min, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}[kind]
        both = {
            "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
            "min": F.least, "max": F.greatest,
            "last": lambda a, b: F.coalesce(b, a),
        }[kind]
        part = F.max_by(F.col(col), F.when(F.col(col).isNotNull(), F.struct(*self.order))) if kind == "last" else agg(col)
        frame = self._local.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        before = self._parts.rowsBetween(Window.unboundedPreceding, -1)
        return self._with_carry(self.rows.withColumn(name, agg(col).over(frame)), part, agg("_op").over(before), name,
                                both(F.col("_op_carry"), F.col(name)))
