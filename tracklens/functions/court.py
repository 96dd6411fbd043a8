"""Court geometry as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import spec


def landmark_table(spark: SparkSession) -> DataFrame:
    """(landmark, x, y) of the 33 landmarks."""
    return spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(spec.landmarks())], "landmark int, x double, y double")


def to_pixel(v: Column, scale: float, padding: float) -> Column:
    """Whole pixels, halves to even."""
    return F.bround(v * scale + padding).cast("int")


def rim_distance(x: Column, y: Column) -> Column:
    return F.hypot(x - spec.RIM_X, y - spec.RIM_Y)


def mirrored_x(x: Column, basket: Column) -> Column:
    """x as if the left basket were attacked; anything but left and right is an error."""
    bad = F.raise_error(F.concat(F.lit("attacking basket must be left or right: "), F.coalesce(basket, F.lit("null"))))
    return F.when(basket == "left", x).when(basket == "right", spec.LENGTH - x).otherwise(bad.cast("double"))


def finite(*columns: Column) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    return out


def zone_of(x: Column, y: Column) -> Column:
    """Zone 0 to 21; a point that is not finite is an error."""
    distance = rim_distance(x, y)
    angle = F.greatest(F.lit(-90.0), F.least(F.lit(90.0), F.degrees(F.atan2(y - spec.RIM_Y, x - spec.RIM_X))))
    sector = F.least(F.lit(spec.SECTORS - 1), F.floor((angle + 90.0) / spec.SECTOR_DEGREES).cast("int"))
    ring = F.lit(None).cast("int")
    for k, edge in reversed(list(enumerate(spec.RINGS))):
        ring = F.when(distance < edge, k).otherwise(ring)
    zone = F.when(x >= spec.HALF_X, spec.BACKCOURT).when(ring.isNull(), spec.DEEP).otherwise(ring * spec.SECTORS + sector)
    return F.when(finite(x, y), zone).otherwise(F.raise_error(F.lit("a zone needs finite coordinates")).cast("int"))


def zone_name(zone: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, spec.ZONE_NAMES)), zone + 1)


def occupancy(zone: Column) -> Column:
    """22 counts, an aggregate of a column of zones; nulls are ignored."""
    return F.array(*[F.count_if(zone == k).cast("double") for k in range(spec.ZONES)])


def inside_court(x: Column, y: Column, margin: float = 0.0) -> Column:
    return x.between(-margin, spec.LENGTH + margin) & y.between(-margin, spec.WIDTH + margin)


def bottom_center(box: Column) -> tuple[Column, Column]:
    return (box[0] + box[2]) / 2, box[3]


def box_center(box: Column) -> tuple[Column, Column]:
    return (box[0] + box[2]) / 2, (box[1] + box[3]) / 2


def shrunk_box(box: Column, factor: float = 0.4) -> Column:
    """The box scaled about its centre."""
    (cx, cy), w, h = box_center(box), (box[2] - box[0]) * factor / 2, (box[3] - box[1]) * factor / 2
    return F.array(cx - w, cy - h, cx + w, cy + h)


def clamped_box(box: Column, width: Column | int, height: Column | int) -> Column:
    """Whole pixels within an image."""
    limits = [F.lit(v) if isinstance(v, int) else v for v in (width, height)] * 2
    return F.array(*[F.greatest(F.lit(0), F.least(limits[k], F.bround(box[k]).cast("int"))) for k in range(4)])


def project(h: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """A point through a 3 x 3 matrix stored row by row; null where it has no image."""
    w = h[6] * x + h[7] * y + h[8]
    w = F.when(F.abs(w) > 1e-12, w)
    return (h[0] * x + h[1] * y + h[2]) / w, (h[3] * x + h[4] * y + h[5]) / w


def inverse(h: Column) -> Column:
    """The adjugate, which projects like the inverse."""
    minor = lambda a, b, c, d: h[a] * h[d] - h[b] * h[c]
    return F.array(
        minor(4, 5, 7, 8), -minor(1, 2, 7, 8), minor(1, 2, 4, 5), -minor(3, 5, 6, 8), minor(0, 2, 6, 8), -minor(0, 2, 3, 5), minor(3, 4, 6, 7), -minor(0, 1, 6, 7), minor(0, 1, 3, 4)
    )


def action_half(median_x: Column) -> Column:
    """-1 for the left half, 1 for the right."""
    return F.when(median_x < spec.HALF_X, -1).when(median_x.isNotNull(), 1)


def time_grid(start: Column, end: Column, fps: Column) -> Column:
    """start + k / fps for the frames of an interval."""
    n = F.bround((end - start) * fps).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.round(start + k / fps, 3))).otherwise(F.array().cast("array<double>"))


def sample_indices(source_fps: Column, target_fps: Column, start: Column, end: Column) -> Column:
    """Distinct source frames at the target rate, halves to even; none for senseless arguments."""
    count = F.ceil((end - start) * target_fps - 1e-9).cast("int")
    fine = (source_fps > 0) & (target_fps > 0) & (end > start)
    return F.when(fine, F.array_distinct(F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.bround((start + k / target_fps) * source_fps).cast("int")))).otherwise(F.array().cast("array<int>"))
