"""Boxes, landmarks and detector output."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FRAME = ["model_id", "frame_idx"]


def landmarks_to_rect(landmarks: DataFrame, left: int = 1, top: int = 52, right: int = 31) -> DataFrame:
    """Square crop: x from ``left`` to ``right``, y from ``top``, as high as wide."""
    def at(axis: str, point: int) -> Column:
        return F.max(F.when(F.col("point_idx") == point, F.col(axis)))

    return (
        landmarks.filter(F.col("point_idx").isin(left, top, right)).groupBy(*FRAME)
        .agg(at("x", left).alias("x1"), at("y", top).alias("y1"), at("x", right).alias("x2"))
        .withColumn("y2", F.col("y1") + F.col("x2") - F.col("x1"))
    )


def landmark_bbox(landmarks: DataFrame, target: int = 320) -> DataFrame:
    """Bounding box of all points, its size, and the scale to ``target`` pixels."""
    x, y = F.col("x").cast("int"), F.col("y").cast("int")
    box = landmarks.groupBy(*FRAME).agg(F.min(x).alias("x1"), F.min(y).alias("y1"),
                                        F.max(x).alias("x2"), F.max(y).alias("y2"))
    w = F.col("x2") - F.col("x1")
    return box.withColumns({"w": w, "h": F.col("y2") - F.col("y1"),
                            "ratio": F.when(w > 0, F.lit(float(target)) / w)})


def centered_box(bbox: DataFrame, width: Column, height: Column, size: int = 328) -> DataFrame:
    """``size`` square about the bbox centre, with a flag for lying inside the frame."""
    bx = ((F.col("x1") + F.col("x2")) / 2.0 - size / 2.0).cast("int")
    by = ((F.col("y1") + F.col("y2")) / 2.0 - size / 2.0).cast("int")
    return bbox.withColumns({"bx1": bx, "by1": by, "bx2": bx + size, "by2": by + size}).withColumn(
        "in_frame", (F.col("bx1") >= 0) & (F.col("by1") >= 0)
        & (F.col("bx2") <= width) & (F.col("by2") <= height))


def square_face_box(boxes: DataFrame, scale: float = 1.05) -> DataFrame:
    """Square of ``int(max(w,h)*scale)`` about the integer centre of x1,y1,x2,y2.

    Adds the overflow on each side and the final origin: where any side
    overflows the origin keeps its negative offset, as the picture is padded.
    """
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    out = boxes.withColumns({
        "size": (F.greatest(w, h) * F.lit(scale)).cast("int"),
        "cx": F.floor((F.col("x1") + F.col("x2")) / 2).cast("int"),
        "cy": F.floor((F.col("y1") + F.col("y2")) / 2).cast("int"),
    })
    half = F.floor(F.col("size") / 2).cast("int")
    out = out.withColumns({"sx": F.col("cx") - half, "sy": F.col("cy") - half})
    zero = F.lit(0)
    return out.withColumns({
        "dx": F.greatest(zero, -F.col("sx")), "dy": F.greatest(zero, -F.col("sy")),
        "edx": F.greatest(zero, F.col("sx") + F.col("size") - F.col("width")),
        "edy": F.greatest(zero, F.col("sy") + F.col("size") - F.col("height")),
        "ox": F.col("sx"), "oy": F.col("sy"),
        "ex": F.least(F.col("width"), F.col("sx") + F.col("size")),
        "ey": F.least(F.col("height"), F.col("sy") + F.col("size")),
    }).drop("sx", "sy")


def eye_angle(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Angle of the eye line in degrees."""
    return F.degrees(F.atan2(y2 - y1, x2 - x1))


def denormalize_landmarks(points: DataFrame, mean: DataFrame, boxes: DataFrame) -> DataFrame:
    """Relative offsets plus the mean face, scaled by the box, truncated, moved to its origin.

    ``mean`` has one row per landmark point; Spark broadcasts it if it is small.  Boxes, one row a frame, are the hashed side: points are not
    sorted, and points that are dealt by frame stay where they are.
    """
    rel = points.join(boxes.hint("shuffle_hash"), FRAME).join(mean, "point_idx")
    return rel.select(
        *FRAME, "point_idx",
        (((F.col("dx") + F.col("mx")) * F.col("w")).cast("int") + F.col("ox")).alias("x"),
        (((F.col("dy") + F.col("my")) * F.col("h")).cast("int") + F.col("oy")).alias("y"))


def decode_anchors(preds: DataFrame, side: int = 640, anchors: int = 2,
                   threshold: float = 0.5) -> DataFrame:
    """Detector rows to boxes and keypoints in detector pixels.

    ``preds``: image_id, stride, anchor_idx, score, dist array[4], kps array[2k].
    The anchor grid is arithmetic on ``anchor_idx``, so nothing is joined.
    """
    cell = F.floor(F.col("anchor_idx") / F.lit(anchors)).cast("long")
    per_row = F.floor(F.lit(side) / F.col("stride")).cast("long")
    stride = F.col("stride").cast("double")
    d = lambda i: F.col("dist")[i] * stride
    return (
        preds.filter(F.col("score") >= F.lit(threshold))
        .withColumns({"ax": F.pmod(cell, per_row) * stride, "ay": F.floor(cell / per_row) * stride})
        .withColumns({"x": F.col("ax") - d(0), "y": F.col("ay") - d(1),
                      "w": d(0) + d(2), "h": d(1) + d(3),
                      "points": F.transform("kps", lambda k, i: k * stride + F.when(i % 2 == 0, F.col("ax"))
                                            .otherwise(F.col("ay")))})
        .drop("ax", "ay", "dist", "kps")
    )


def letterbox_params(images: DataFrame, side: int = 640) -> DataFrame:
    """New size and padding of each picture; the wide case adds 1 to the height."""
    w, h = F.col("width"), F.col("height")
    tall = h > w
    new_w = F.when(tall, (F.lit(side) / (h / w)).cast("int")).otherwise(F.lit(side))
    new_h = F.when(h == w, F.lit(side)).when(tall, F.lit(side)).otherwise((F.lit(side) * (h / w)).cast("int") + 1)
    out = images.withColumns({"new_w": new_w, "new_h": new_h})
    return out.withColumns({
        "pad_w": F.when(tall, ((F.lit(side) - F.col("new_w")) * 0.5).cast("int")).otherwise(0),
        "pad_h": F.when(w > h, ((F.lit(side) - F.col("new_h")) * 0.5).cast("int")).otherwise(0),
    })


def unletterbox(boxes: DataFrame) -> DataFrame:
    """Map x,y,w,h from detector pixels to source pixels, given letterbox columns."""
    rw, rh = F.col("width") / F.col("new_w"), F.col("height") / F.col("new_h")
    return boxes.withColumns({
        "x": (F.col("x") - F.col("pad_w")) * rw, "y": (F.col("y") - F.col("pad_h")) * rh,
        "w": F.col("w") * rw, "h": F.col("h") * rh})


def nms(boxes: DataFrame, score_thr: float = 0.5, iou_thr: float = 0.5, image: str = "image_id",
        box: str = "box_id") -> DataFrame:
    """Greedy suppression per image, best score first, ties by box id.

    Rows arrive sorted, and a task streams over them holding only the boxes kept
    in the current image; those overlap little, so memory does not grow with the
    number of detections.  Exact copies of a box are dropped before the sort.
    """
    names = [image, box, "x", "y", "w", "h", "score"]
    ranked = F.struct("score", (-F.col(box)).alias("_neg"))
    best = (
        boxes.filter(F.col("score") >= F.lit(score_thr))
        .groupBy(image, "x", "y", "w", "h")
        .agg(F.max(ranked).alias("_r"))
        .select(image, (-F.col("_r._neg")).alias(box), "x", "y", "w", "h", F.col("_r.score").alias("score"))
    )

    def overlaps(k: np.ndarray, b: np.ndarray) -> np.ndarray:
        """[kept][boxes] flags: intersection over union above the threshold."""
        iw = np.minimum(k[:, None, 0] + k[:, None, 2], b[:, 0] + b[:, 2]) - np.maximum(k[:, None, 0], b[:, 0])
        ih = np.minimum(k[:, None, 1] + k[:, None, 3], b[:, 1] + b[:, 3]) - np.maximum(k[:, None, 1], b[:, 1])
        inter = np.maximum(iw, 0) * np.maximum(ih, 0)
        return inter > iou_thr * (k[:, None, 2] * k[:, None, 3] + b[:, 2] * b[:, 3] - inter)

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, kept = None, np.zeros((0, 4))
        for pdf in batches:
            ids = pdf[image].to_numpy()
            rects = pdf[["x", "y", "w", "h"]].to_numpy(dtype=np.float64)
            take = np.zeros(len(pdf), dtype=bool)
            # Runs of one image, in stretches that bound the overlap matrix.
            edges = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else []
            cuts = sorted({int(e) for e in edges} | set(range(0, len(ids), 256)) | {len(ids)})
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if ids[lo] != current:
                    current, kept = ids[lo], np.zeros((0, 4))
                alive = np.ones(hi - lo, dtype=bool)
                for at in range(0, len(kept), 4096):
                    alive &= ~overlaps(kept[at:at + 4096], rects[lo:hi]).any(axis=0)
                inside = overlaps(rects[lo:hi], rects[lo:hi])
                for i in range(hi - lo):
                    if alive[i]:
                        alive[i + 1:] &= ~inside[i, i + 1:]
                take[lo:hi] = alive
                kept = np.concatenate([kept, rects[lo:hi][alive]])
            yield pdf[take]

    schema = ", ".join(f"`{c}` {best.schema[c].dataType.simpleString()}" for c in names)
    return (
        best.select(*names).repartition(image)
        .sortWithinPartitions(image, F.desc("score"), box).mapInPandas(sweep, schema)
    )


def best_box(boxes: DataFrame, image: str = "image_id", box: str = "box_id") -> DataFrame:
    """Only the first box a suppression would keep."""
    rest = [c for c in boxes.columns if c != image]
    best = F.max_by(F.struct(*rest), F.struct("score", -F.col(box)))
    return boxes.groupBy(image).agg(best.alias("b")).select(image, "b.*")


def normalize_bounds(bounds: Column) -> Column:
    """4, 5 or 6 numbers to x1,y1,x2,y2,width,height; null for any other count."""
    b = lambda i: F.get(bounds, F.lit(i)).cast("int")
    n = F.size(bounds)
    width = F.when(n == 4, b(2) - b(0)).otherwise(b(4))
    height = F.when(n == 6, b(5)).otherwise(b(3) - b(1))
    return F.when(n.isin(4, 5, 6), F.struct(
        b(0).alias("x1"), b(1).alias("y1"), b(2).alias("x2"), b(3).alias("y2"),
        width.alias("width"), height.alias("height")))
