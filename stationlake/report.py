"""What leaves Spark for people: version reports, tables for papers, and hand-off to geometry libraries."""

from __future__ import annotations

import importlib
import platform

from pyspark.sql import DataFrame, SparkSession

LIBRARIES = ("pyspark", "pyarrow", "pandas", "numpy", "geopandas", "shapely", "duckdb")
MAX_ROWS = 100  # of a table for a paper


def versions(spark: SparkSession | None = None) -> dict[str, str | None]:
    """Versions of Python, the libraries (None: not there), and of the session with its parallelism."""
    out: dict[str, str | None] = {"python": platform.python_version(), "system": platform.platform()}
    for name in LIBRARIES:
        try:
            out[name] = getattr(importlib.import_module(name), "__version__", "unknown")
        except ImportError:
            out[name] = None
    if spark is not None:
        out |= {"spark": spark.version, "master": spark.sparkContext.master, "parallelism": str(spark.sparkContext.defaultParallelism), "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions")}
    return out


def _cell(x, decimals: int) -> str:
    if x is None or x != x:
        return "-"
    if isinstance(x, bool) or not isinstance(x, (int, float)):
        return str(x)
    return f"{x:,.{decimals}f}" if isinstance(x, float) else f"{x:,}"


def table(profile: DataFrame, *, form: str = "markdown", decimals: int = 2) -> str:
    """A frame of MAX_ROWS rows at most as Markdown, or as LaTeX with booktabs rules."""
    if form not in ("markdown", "latex"):
        raise ValueError(f"unknown form {form!r}")
    rows = profile.limit(MAX_ROWS + 1).collect()
    if len(rows) > MAX_ROWS:
        raise ValueError(f"a table has {MAX_ROWS} rows at most")
    cells = [[_cell(x, decimals) for x in r] for r in rows]
    numbers = [f.dataType.typeName() in ("double", "float", "long", "integer", "short", "byte", "decimal") for f in profile.schema]
    if form == "markdown":
        line = lambda x: "| " + " | ".join(x) + " |"
        return "\n".join([line(profile.columns), line(["---:" if n else "---" for n in numbers]), *map(line, cells)])
    safe = lambda x: "".join({"&": r"\&", "%": r"\%", "_": r"\_", "#": r"\#", "$": r"\$"}.get(c, c) for c in x)
    body = [" & ".join(map(safe, r)) + r" \\" for r in (profile.columns, *cells)]
    return "\n".join([r"\begin{tabular}{" + "".join("r" if n else "l" for n in numbers) + "}", r"\toprule", body[0], r"\midrule", *body[1:], r"\bottomrule", r"\end{tabular}"])


def to_geopandas(df: DataFrame, *, lat: str = "lat", lon: str = "lon", most: int = 1_000_000):
    """Rows with coordinates as a GeoDataFrame in WGS 84, for frames of `most` rows at most; needs geopandas."""
    try:
        import geopandas
    except ImportError as e:
        raise ImportError("to_geopandas needs geopandas") from e
    pdf = df.where(f"`{lat}` is not null and `{lon}` is not null").limit(most + 1).toPandas()
    if len(pdf) > most:
        raise ValueError(f"more than {most} rows")
    return geopandas.GeoDataFrame(pdf, geometry=geopandas.points_from_xy(pdf[lon], pdf[lat]), crs="EPSG:4326")
