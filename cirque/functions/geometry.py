"""Intervals on a circle in exact integers: half-open bounds, doubled centres, ten relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def arc_length(s: Column, e: Column, n: Column) -> Column:
    """Length from s round to e; a whole circle where both fall on one place but are written apart."""
    x = F.pmod(e - s, n)
    return F.when((x == 0) & (s != e), n).otherwise(x)


def arc_center2(s: Column, e: Column, n: Column) -> Column:
    """Twice the centre, not reduced."""
    return s * 2 + arc_length(s, e, n)


def orientation(c2_a: Column, c2_b: Column, n: Column, strand_a: Column) -> Column:
    """1 if b's centre lies on a's 3' side, -1 if on its 5' side, 0 if on neither."""
    m = F.pmod(c2_b - c2_a, n * 2)
    raw = F.when((m == 0) | (m == n), 0).when(m < n, 1).otherwise(-1)
    return F.when(strand_a == "Reverse", -raw).otherwise(raw)


def _relation(la: Column, lb: Column, d2: Column, side: Column, n: Column) -> tuple[Column, Column]:
    """Relation and distance from both lengths, the doubled distance of the centres and the side of b's centre."""
    rel = (
        F.when(d2 >= la + lb, F.when(side > 0, "3N").otherwise("5N"))
        .when(la + lb > n, F.when(la > lb, "CG").otherwise("CR"))
        .when(F.greatest(la, lb) > d2 + F.least(la, lb), F.when(la > lb, "EB").otherwise("CO"))
        .when(side == 0, "PE").when(side > 0, "3O").otherwise("5O")
    )
    known = la.isNotNull() & lb.isNotNull() & d2.isNotNull()
    distance = F.when(d2 >= la + lb, F.floor((d2 - la - lb) / 2)).otherwise(0).cast("long")
    return F.when(known, rel), F.when(known, distance)


def spatial_relation(a: tuple[Column, Column, Column], b: tuple[Column, Column], n: Column, same: Column | None = None) -> Column:
    """struct(rel, distance) of b relative to a; a is (start, end, strand), b is (start, end). ``with_relation`` does the same for a frame in steps."""
    la, lb = arc_length(a[0], a[1], n), arc_length(b[0], b[1], n)
    ca, cb = a[0] * 2 + la, b[0] * 2 + lb
    m = F.pmod(cb - ca, n * 2)
    rel, distance = _relation(la, lb, F.least(m, n * 2 - m), orientation(ca, cb, n, a[2]), n)
    if same is not None:
        rel, distance = F.when(same, rel).otherwise("DR"), F.when(same, distance).otherwise(0)
    return F.struct(rel.alias("rel"), distance.alias("distance"))


def with_sizes(df: DataFrame, prefix: str, s: Column, e: Column, n: Column) -> DataFrame:
    """``df`` with the arc's length and doubled centre as <prefix>l and <prefix>c, computed once for a row."""
    return df.withColumn(f"{prefix}l", arc_length(s, e, n)).withColumn(f"{prefix}c", s * 2 + F.col(f"{prefix}l"))


def with_sized_relation(df: DataFrame, a: str, b: str, strand: Column, n: Column, rel: str = "rel", distance: str = "distance") -> DataFrame:
    """``df`` with the relation and distance of b to a, whose sizes ``with_sizes`` has put under the prefixes ``a`` and ``b``.

    Each step is a projection of plain columns, so that no term is computed twice and all stays in generated code.
    """
    x = df.withColumn("_m", F.pmod(F.col(f"{b}c") - F.col(f"{a}c"), n * 2))
    x = x.withColumn("_side", F.when((F.col("_m") == 0) | (F.col("_m") == n), 0).when((F.col("_m") < n) == (F.coalesce(strand, F.lit("")) != "Reverse"), 1).otherwise(-1)).withColumn("_d2", F.least("_m", n * 2 - F.col("_m")))
    r, d = _relation(F.col(f"{a}l"), F.col(f"{b}l"), F.col("_d2"), F.col("_side"), n)
    return x.withColumns({rel: r, distance: d}).drop("_m", "_side", "_d2")


def with_relation(df: DataFrame, a: tuple[Column, Column, Column], b: tuple[Column, Column], n: Column, rel: str = "rel", distance: str = "distance") -> DataFrame:
    """``df`` with the relation and distance of b (start, end) to a (start, end, strand); null where a place is null."""
    x = with_sizes(with_sizes(df, "_a", a[0], a[1], n), "_b", b[0], b[1], n)
    return with_sized_relation(x, "_a", "_b", a[2], n, rel, distance).drop("_al", "_ac", "_bl", "_bc")


def search_bubble(s: Column, e: Column, n: Column, radius: int) -> Column:
    """struct(start_bound, end_bound) widened on both sides; unchanged where the circle is too short for that."""
    wide = arc_length(s, e, n) + 2 * radius >= n
    return F.struct(F.when(wide, s).otherwise(F.pmod(s - radius, n)).alias("start_bound"), F.when(wide, e).otherwise(e + radius).alias("end_bound"))


def feature_length(s: Column, e: Column, n: Column) -> Column:
    return F.when(e > s, e - s).otherwise(n - F.abs(e - s))


# ---- plane vectors: struct<x, y> ----------------------------------------------------------------


def unit_vector(bound: Column, n: Column) -> Column:
    angle = F.pmod(bound, n) * (2 * 3.141592653589793) / n
    return F.struct(F.cos(angle).alias("x"), F.sin(angle).alias("y"))


def vec_add(a: Column, b: Column) -> Column:
    return F.struct((a["x"] + b["x"]).alias("x"), (a["y"] + b["y"]).alias("y"))


def vec_sub(a: Column, b: Column) -> Column:
    return F.struct((a["x"] - b["x"]).alias("x"), (a["y"] - b["y"]).alias("y"))


def vec_scale(a: Column, k: Column | float) -> Column:
    return F.struct((a["x"] * k).alias("x"), (a["y"] * k).alias("y"))


def vec_norm(a: Column) -> Column:
    return F.hypot(a["x"], a["y"])


def vec_normalize(a: Column) -> Column:
    return vec_scale(a, F.try_divide(F.lit(1.0), vec_norm(a)))


def vec_cross(a: Column, b: Column) -> Column:
    return a["x"] * b["y"] - a["y"] * b["x"]


def vec_angle(a: Column, b: Column) -> Column:
    """Angle between two vectors, stable for nearly parallel ones: 2 atan(|u - v| / |u + v|) of the normalised pair."""
    u, v = vec_normalize(a), vec_normalize(b)
    return F.atan2(vec_norm(vec_sub(u, v)), vec_norm(vec_add(u, v))) * 2
