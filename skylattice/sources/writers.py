"""Writing catalogues, maps, light curves and region files."""

from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sky import interval_option, timerange
from ..operators.catalogues import annotation_lines, region_line, safe_name, union_by_name

# Units of catalogue columns, and data types of VOTable.
UNITS = {"ra_rad": "rad", "dec_rad": "rad", "ra_deg": "deg", "dec_deg": "deg", "time_start": "s", "time_end": "s", "time_center": "s", "duration": "s", "f_hz": "Hz", "period_s": "s"}
DATATYPES = {"bigint": "long", "int": "int", "double": "double", "float": "float", "boolean": "boolean"}


def catalogue(df: DataFrame, path: str, csv: bool = True, vot: bool = False) -> None:
    """Overwrite a catalogue as Parquet, and as CSV and VOTable beside it."""
    df.write.mode("overwrite").parquet(f"{path}/parquet")
    if csv:
        df.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    if vot:
        votable(df, f"{path}/vot")


def votable(df: DataFrame, path: str) -> None:
    """VOTable documents, one a partition, with units; the reader takes the folder as one table."""
    text = df.select(*(F.col(c).cast("string").alias(c) for c in df.columns))
    fields = "".join(f"<FIELD name={quoteattr(c)} datatype={quoteattr(DATATYPES.get(k, 'char'))}" + ("" if k in DATATYPES else ' arraysize="*"') + (f" unit={quoteattr(UNITS[c])}" if c in UNITS else "") + "/>" for c, k in df.dtypes)

    def lines(batches):
        yield pa.RecordBatch.from_pydict({"value": [f'<?xml version="1.0"?><VOTABLE version="1.3"><RESOURCE><TABLE>{fields}<DATA><TABLEDATA>']})
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            yield pa.RecordBatch.from_pydict({"value": pa.array(["<TR>" + "".join(f"<TD>{escape(v or '')}</TD>" for v in r) + "</TR>" for r in rows], pa.string())})
        yield pa.RecordBatch.from_pydict({"value": ["</TABLEDATA></DATA></TABLE></RESOURCE></VOTABLE>"]})

    text.mapInArrow(lines, "value string").write.mode("overwrite").text(path)


def by_source(df: DataFrame, path: str) -> None:
    """A table for each source, in a folder of its name."""
    df.withColumn("source", safe_name(F.col("srcname"))).write.mode("overwrite").partitionBy("source").option("header", True).csv(path)


def summaries(df: DataFrame, path: str) -> None:
    """A line of text a candidate: name, position, S/N, and what to select its samples by in other tools."""
    lines = F.concat_ws(
        " ", "srcname", "ra_hms", "dec_dms", F.format_string("S/N=%.2f", "snr"), F.format_string("width=%d", F.coalesce(F.col("width_samples"), F.lit(-1))),
        timerange(F.col("time_start"), F.col("time_end")), interval_option(F.col("t0_idx"), F.col("t1_idx_excl")),
    )
    df.select(lines.alias("value")).write.mode("overwrite").text(path)


def consolidate(parts: list[DataFrame], path: str) -> None:
    """Chunk catalogues as one table; each part keeps its level, so observation and chunk rows stay apart."""
    union_by_name(*parts).write.mode("overwrite").partitionBy(*(c for c in ("level",) if c in parts[0].columns)).parquet(path)


def maps(df: DataFrame, path: str) -> None:
    """Pixel maps and cubes of power as float32."""
    cast = [F.col(c).cast("float").alias(c) if k == "double" else F.col(c) for c, k in df.dtypes]
    df.select(*cast).write.mode("overwrite").parquet(path)


def light_curves(df: DataFrame, path: str, text: bool = False) -> None:
    """Light curves by source; as text, a line of time and flux."""
    if text:
        df.select("srcname", F.format_string("%.9f %.9e", "time", "flux").alias("value")).write.mode("overwrite").partitionBy("srcname").text(path)
    else:
        df.write.mode("overwrite").partitionBy("srcname").parquet(path)


# The head lines of region files, and their circles' radius.
DS9_HEAD, KVIS_HEAD = ["# Region file format: DS9 version 4.1", "global color=green width=2", "fk5"], ["# Karma kvis annotation file", "COORD W", "COLOR GREEN"]
MARK_ARCSEC = 28.0


def _headed(lines: DataFrame, head: list[str], path: str) -> None:
    """Text files, each with the head lines first, so that any of them is whole by itself."""

    def run(batches):
        first = True
        for batch in batches:
            if first and head and len(batch):
                yield pa.RecordBatch.from_pydict({"value": head})
                first = False
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["value"])

    lines.mapInArrow(run, "value string").write.mode("overwrite").text(path)


def regions(df: DataFrame, path: str, radius: float = 20.0, head: bool = False) -> None:
    """DS9 lines of (ra, dec, label); with head, files that are whole by themselves."""
    _headed(df.select(region_line(F.col("ra"), F.col("dec"), F.col("label"), radius).alias("value")), DS9_HEAD if head else [], path)


def annotations(df: DataFrame, path: str, radius: float = 20.0, head: bool = False) -> None:
    """kvis lines of (ra, dec, label); with head, files that say that they are in world coordinates."""
    _headed(df.select(F.explode(annotation_lines(F.col("ra"), F.col("dec"), F.col("label"), radius)).alias("value")), KVIS_HEAD if head else [], path)


def to_sentinels(df: DataFrame) -> DataFrame:
    """NULLs as catalogue files hold them: -1 for whole numbers, NaN for others, empty text."""
    fill = {"bigint": -1, "int": -1, "double": float("nan"), "float": float("nan"), "string": ""}
    return df.select(*(F.coalesce(F.col(c), F.lit(fill[k]).cast(k)).alias(c) if k in fill else F.col(c) for c, k in df.dtypes))
