"""Bounding-box arithmetic on fractions of a page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("left", "top", "right", "bottom")


def pixel_box(box: dict[str, Column], width: Column, height: Column) -> dict[str, Column]:
    """Whole pixels, cut toward zero."""
    return {
        "x1": (box["left"] * width).cast("int"),
        "y1": (box["top"] * height).cast("int"),
        "x2": (box["right"] * width).cast("int"),
        "y2": (box["bottom"] * height).cast("int"),
    }


def padded_box(px: dict[str, Column], width: Column, height: Column, padding: int = 10) -> dict[str, Column]:
    """Box grown by ``padding`` on each side and kept on the page."""
    return {
        "x1": F.greatest(F.lit(0), px["x1"] - padding),
        "y1": F.greatest(F.lit(0), px["y1"] - padding),
        "x2": F.least(width, px["x2"] + padding),
        "y2": F.least(height, px["y2"] + padding),
    }
