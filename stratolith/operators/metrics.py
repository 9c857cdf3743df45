"""Shape metrics of polygons as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratolith.functions import geometry as g
from stratolith.functions.shapes import measures
from stratolith.storage import unused

METRICS = ("area", "perim", "para", "compact", "compact2", "smooth", "shape", "frac", "circle")


def with_metrics(df: DataFrame, rings: str = "rings", radius: Column | None = None, srs: str | None = None) -> DataFrame:
    """Add the nine shape metrics of a polygon column; the circle comes from the shell unless its ``radius`` is known.

    With ``srs``, the system of the coordinates ("EPSG:4326", a UTM zone's
    code, or a .prj's text), the metrics are those of the polygon in web
    mercator, and the column itself stays as it is. Without one they are in the
    coordinates' own units.
    """
    name = unused(df, "measured")
    found = df.withColumn(name, measures(srs)(F.col(rings)))
    got = lambda c: F.col(f"{name}.{c}")
    return found.withColumns(g.metric_columns(got("area"), got("perim"), got("r") if radius is None else radius)).drop(name)
