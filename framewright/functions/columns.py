"""Column functions (JVM expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pcm16_to_float(v: Column, scale: float = 32768.0) -> Column:
    """PCM16 to [-1, 1]; ``scale`` is 32768 or 32767."""
    return v.cast("double") / F.lit(scale)


def float_to_pcm16(v: Column) -> Column:
    """[-1, 1] to PCM16: negative times 32768, positive times 32767, truncated."""
    c = clamp(v, -1.0, 1.0)
    return F.when(c < 0, c * 32768).otherwise(c * 32767).cast("int").cast("short")


def clamp(v: Column, lo: float, hi: float) -> Column:
    """Into [lo, hi]; infinities too."""
    return F.least(F.greatest(v, F.lit(lo)), F.lit(hi))


def scale_image(byte: Column) -> Column:
    """0..255 to [-1, 1]."""
    return (byte / F.lit(255.0) - 0.5) * 2.0


def unscale_image(v: Column) -> Column:
    """[-1, 1] to 0..255, truncated."""
    return clamp((v / 2.0 + 0.5) * 255.0, 0.0, 255.0).cast("int")


def _div(a: Column, b: int) -> Column:
    return F.floor(a / F.lit(b)).cast("long")


def frame_to_ms(frame: Column, fps: int = 25) -> Column:
    return _div(frame * 1000, fps)


def frame_to_sample(frame: Column, sr: int = 16000, fps: int = 25) -> Column:
    return _div(frame * sr, fps)


def frame_to_step(frame: Column, rate: int = 80, fps: int = 25) -> Column:
    """First feature step of a video frame."""
    return _div(frame * rate, fps)


def sample_to_step(sample: Column, hop: int = 200) -> Column:
    return _div(sample, hop)


def ms_to_frame(ms: Column, fps: int = 25) -> Column:
    return _div(ms * fps, 1000)


def frame_id_from_path(path: Column) -> Column:
    """Integer stem of a file name, null when it has none."""
    return F.regexp_extract(path, r"([^/]*?)\.[^/]*$", 1).try_cast("long")


def frame_name(frame: Column, ext: str = "png", width: int = 4) -> Column:
    """``frame_%04d.ext``; wider numbers keep all digits."""
    digits = frame.cast("string")
    padded = F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits)
    return F.concat(F.lit("frame_"), padded, F.lit(f".{ext}"))
