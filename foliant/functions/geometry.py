"""Box arithmetic on columns l, t, r, b with the origin at the bottom left."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Least width and height (both below: dropped), least area, and the picture area that makes a table candidate.
MIN_WIDTH, MIN_HEIGHT, MIN_AREA, TABLE_PICTURE_AREA = 20, 10, 500, 50_000


def col(name: str, side: str = "") -> Column:
    return F.col(f"{side}.{name}" if side else name)


def area(side: str = "") -> Column:
    """Signed area."""
    return (col("r", side) - col("l", side)) * (col("t", side) - col("b", side))


def intersection(a: str, b: str) -> Column:
    """Shared area of two boxes; boxes that only touch share none."""
    w = F.least(col("r", a), col("r", b)) - F.greatest(col("l", a), col("l", b))
    h = F.least(col("t", a), col("t", b)) - F.greatest(col("b", a), col("b", b))
    return F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0.0))


def is_tiny() -> Column:
    w, h = F.col("r") - F.col("l"), F.col("t") - F.col("b")
    return ((w < MIN_WIDTH) & (h < MIN_HEIGHT)) | (w * h < MIN_AREA)


def is_table_picture() -> Column:
    return F.abs(F.col("r") - F.col("l")) * F.abs(F.col("t") - F.col("b")) >= TABLE_PICTURE_AREA


def padded(pad: float = 70.0) -> list[Column]:
    """A crop box grown by `pad`; only its left and bottom are kept inside the page."""
    zero = F.lit(0.0)
    return [F.greatest(zero, F.col("l") - pad).alias("l"), (F.col("t") + pad).alias("t"), (F.col("r") + pad).alias("r"), F.greatest(zero, F.col("b") - pad).alias("b")]


def image_rect(width: Column, height: Column, pad_share: float = 0.05) -> Column:
    """The box as (x0, y0, x1, y1) with the origin at the top left, grown by a share of its size and clamped to the page."""
    px, py = (F.col("r") - F.col("l")) * pad_share, (F.col("t") - F.col("b")) * pad_share
    zero = F.lit(0.0)
    return F.struct(
        F.greatest(zero, F.col("l") - px).alias("x0"), F.greatest(zero, height - F.col("t") - py).alias("y0"),
        F.least(width, F.col("r") + px).alias("x1"), F.least(height, height - F.col("b") + py).alias("y1"),
    )


def expanded(above: Column, below: Column, page_height: Column) -> Column:
    """The box with its top raised and bottom lowered, inside the page."""
    return F.struct(F.col("l"), F.least(page_height, F.col("t") + above).alias("t"), F.col("r"), F.greatest(F.lit(0.0), F.col("b") - below).alias("b"))


def flip_y(height: Column, scale: Column | float = 1.0) -> Column:
    """(left, top, right, bottom) in image pixels."""
    s = F.lit(scale) if isinstance(scale, (int, float)) else scale
    return F.struct((F.col("l") * s).alias("left"), ((height - F.col("t")) * s).alias("top"), (F.col("r") * s).alias("right"), ((height - F.col("b")) * s).alias("bottom"))


def overlaps(a: str, b: str) -> Column:
    """Whether two label rectangles overlap."""
    return ~((col("r", a) < col("l", b)) | (col("l", a) > col("r", b)) | (col("t", a) < col("b", b)) | (col("b", a) > col("t", b)))


def image_scale(size_mb: Column) -> Column:
    """Rendering scale by file size in megabytes; unknown sizes take 2.0."""
    return F.when(size_mb < 30, 2.0).when(size_mb < 100, 1.5).when(size_mb < 200, 1.0).when(size_mb.isNull(), 2.0).otherwise(0.75)
