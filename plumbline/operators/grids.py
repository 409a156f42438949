"""Pixel patches: band metadata, scaling, masks and index statistics, by higher-order functions on one row.

Grids are array<array<double>> with null for masked pixels, the geometry an array<array<boolean>>;
pixels are never exploded, so a patch stays in its row and no shuffle happens.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.contracts import ContractError, require

VALID_SCL = (4, 5, 6, 7)
BANDS = ("red", "nir", "swir16")


def band_metadata(assets: Column, band: str) -> Column:
    """struct(scale, offset, nodata, one) from `raster:bands` (v1) or `bands` (v2) of a JSON text of assets."""
    path = f"$.{band}"
    v1 = F.get_json_object(assets, f"{path}['raster:bands']")
    v2 = F.get_json_object(assets, f"{path}.bands")
    first = F.when(v1.isNotNull(), F.get_json_object(v1, "$[0]")).otherwise(F.get_json_object(v2, "$[0]"))
    get = lambda a, b: F.when(v1.isNotNull(), F.get_json_object(first, f"$.{a}")).otherwise(F.get_json_object(first, f"$['{b}']"))
    return F.struct(
        get("scale", "raster:scale").try_cast("double").alias("scale"), get("offset", "raster:offset").try_cast("double").alias("offset"),
        F.get_json_object(first, "$.nodata").alias("nodata"), (F.json_array_length(F.coalesce(v1, v2)) == 1).alias("one"),
    )


def metadata_rules(meta: Column, band: str) -> list[tuple[str, Column]]:
    scale, offset = meta["scale"], meta["offset"]
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return [(f"{band}: exactly one raster band with scale and offset", ~F.coalesce(meta["one"], F.lit(False))), (f"{band}: scale and offset must be finite, scale positive", ~(finite(scale) & finite(offset) & (scale > 0)))]


def scaled(grid: Column, meta: Column) -> Column:
    """Flat physical values; null where masked, no data, not finite or negative."""
    physical = lambda x: x * meta["scale"] + meta["offset"]
    no_data = lambda x: F.when(F.lower(meta["nodata"]) == "nan", F.isnan(x)).otherwise(F.coalesce(x == meta["nodata"].try_cast("double"), F.lit(False)))
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")) & ~no_data(x) & (physical(x) >= 0)
    return F.transform(F.flatten(grid), lambda x: F.when(ok(x), physical(x)))


def ratio(a: Column, b: Column, clear: Column) -> Column:
    """(a - b) / (a + b) pixel by pixel where clear and the sum is positive; nulls elsewhere."""
    return F.zip_with(F.zip_with(a, b, lambda x, y: F.when(x + y > 0, (x - y) / (x + y))), clear, lambda r, c: F.when(c, r))


def mean_median_count(values: Column) -> tuple[Column, Column, Column]:
    found = F.array_sort(F.filter(values, lambda x: x.isNotNull()))
    n = F.size(found)
    mean = F.when(n > 0, F.aggregate(found, F.lit(0.0), lambda s, x: s + x) / n)
    at = lambda i: F.get(found, i.cast("int"))
    median = F.when(n > 0, (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2)
    return mean, median, n.cast("long")


def observe(patches: DataFrame, *, valid_scl: Sequence[int] = VALID_SCL, check: bool = True) -> DataFrame:
    """One row of index statistics for each patch: red, nir, swir16, scl, geometry_mask (null: all), assets (JSON text); other columns are kept."""
    if not valid_scl or any(type(x) is not int or not 0 <= x <= 11 for x in valid_scl):
        raise ContractError("valid_scl must be scene classes 0 to 11")
    grids = (*BANDS, "scl")
    df = patches.select("*", *(band_metadata(F.col("assets"), b).alias(f"meta_{b}") for b in BANDS)).withColumn("geometry__", F.coalesce("geometry_mask", F.transform("red", lambda r: F.transform(r, lambda x: F.lit(True)))))
    shape = lambda c: F.transform(c, lambda r: F.size(r))
    rules = [
        *(rule for b in BANDS for rule in metadata_rules(F.col(f"meta_{b}"), b)),
        *((f"{c}: grids must have one shape", ~(shape(c) == shape("red"))) for c in (*grids[1:], "geometry__")),
        ("grids must be two-dimensional", F.exists(shape("red"), lambda n: n != F.element_at(shape("red"), 1))),
    ]
    if check:
        require(df, rules)
    clear = F.zip_with(F.flatten("scl"), F.flatten("geometry__"), lambda q, g: F.coalesce(g & q.isin(*map(float, valid_scl)), F.lit(False)))
    df = df.select("*", clear.alias("clear__"), *(scaled(F.col(b), F.col(f"meta_{b}")).alias(f"p_{b}") for b in BANDS))
    df = df.select("*", ratio(F.col("p_nir"), F.col("p_red"), F.col("clear__")).alias("vi"), ratio(F.col("p_nir"), F.col("p_swir16"), F.col("clear__")).alias("mi"))
    a, b = mean_median_count(F.col("vi")), mean_median_count(F.col("mi"))
    total = F.size(F.filter(F.flatten("geometry__"), lambda g: g)).cast("long")
    keep = [c for c in patches.columns if c not in (*grids, "geometry_mask", "assets")]
    return df.select(*keep, a[0].alias("ndvi_mean"), a[1].alias("ndvi_median"), b[0].alias("ndmi_mean"), b[1].alias("ndmi_median"), a[2].alias("valid_pixels"), b[2].alias("ndmi_valid_pixels"), total.alias("geometry_pixels"), (a[2] / F.nullif(total, F.lit(0))).alias("clear_fraction"), (b[2] / F.nullif(total, F.lit(0))).alias("ndmi_clear_fraction"))
