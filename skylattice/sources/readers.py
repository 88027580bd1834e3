"""Reading visibilities and catalogues."""

from xml.etree import ElementTree

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.catalogues import parse_name
from ..operators.imaging import correlation_label, require_columns
from ..operators.timeaxis import time_column

#: Visibility rows, one a correlation (the fixture's layout of a measurement set's main table).
VISIBILITY = "time double, scan int, interval double, u double, v double, w double, chan int, corr int, re double, im double, flag boolean, flag_row boolean, weight double"


def visibilities(spark: SparkSession, path: str, start: float | None = None, end: float | None = None) -> DataFrame:
    """Parquet rows of a time range, both ends included; the range is pushed to the scan.  The time is time_centroid where the table has it."""
    df = spark.read.parquet(path)
    time = time_column(df)
    for ok in ([F.col(time) >= start] if start is not None else []) + ([F.col(time) <= end] if end is not None else []):
        df = df.where(ok)
    if time != "time":
        df = df.drop("time").withColumnRenamed(time, "time")
    if "flag_row" in df.columns:
        df = df.withColumn("flag", F.col("flag") | F.coalesce("flag_row", F.lit(False)))
    return df


def search_rows(vis: DataFrame, spw: DataFrame, pol: DataFrame) -> DataFrame:
    """Rows of the layout VISIBILITY as a search takes them: correlations by label, u, v and w in wavelengths of the row's channel, freq_hz, and `row`.

    spw: (chan, freq_hz) of one spectral window (with a column spw, more than one raises); pol: (corr, code).
    Rows of one time are told apart by their baseline's u, v, w where the table has no row number.  A channel or correlation that the
    dimension lacks raises.
    """
    require_columns(vis, "time", "chan", "corr", "u", "v", "re", "im", "flag", "weight")
    place = [c for c in ("u", "v", "w") if c in vis.columns]
    if "row" not in vis.columns:
        vis = vis.withColumn("row", F.struct("time", *place))
    spw = spw if "spw" in spw.columns else spw.withColumn("spw", F.lit(0))
    labels = pol.select(F.col("corr"), correlation_label(F.col("code")).alias("__label"))
    known = lambda c, what: F.when(F.col(c).isNotNull(), F.col(c)).otherwise(F.raise_error(F.lit(f"a row has no {what}")))
    both = vis.join(one_window(spw), "chan", "left").join(labels, "corr", "left")
    wave = known("wavelength_m", "channel of the spectral window")
    return both.withColumns({c: F.col(c) / wave for c in place} | {"corr": known("__label", "known correlation")}).drop("__label", "wavelength_m")


def one_window(spw: DataFrame) -> DataFrame:
    """Channel frequencies and wavelengths; more than one spectral window raises when run."""
    one = spw.agg(F.assert_true(F.count_distinct("spw") <= 1, F.lit("more than one spectral window")).alias("ok"))
    return spw.join(F.broadcast(one), F.col("ok").isNull()).select("chan", "freq_hz", (F.lit(299792458.0) / F.col("freq_hz")).alias("wavelength_m"))


def phase_centre(fields: DataFrame, name: str | None = None) -> tuple[float, float, str]:
    """(ra, dec, name) of the named field, or of the first."""
    row = (fields.where(F.col("name") == name) if name else fields).limit(1).first()
    if row is None:
        raise ValueError(f"no field {name}")
    return row.ra0_rad, row.dec0_rad, row["name"]


def csv_catalogue(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """Candidate CSVs; unreadable files are skipped, and the file's name is kept."""
    return spark.read.option("header", True).option("ignoreCorruptFiles", True).option("mode", "DROPMALFORMED").schema(schema).csv(paths).withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))


def sexagesimal_degrees(c, hours: bool):
    """Degrees of 'hh:mm:ss' or '+dd mm ss' text; NULL if malformed."""
    parts = F.split(F.regexp_replace(F.trim(c), r"^[+-]", ""), r"[:\s]+")
    num = [F.coalesce(F.get(parts, k).try_cast("double"), F.lit(0.0)) for k in range(3)]
    ok = F.get(parts, 0).try_cast("double").isNotNull() & (F.size(parts) <= 3)
    value = (num[0] + num[1] / 60 + num[2] / 3600) * (15 if hours else 1)
    return F.when(ok, F.when(F.trim(c).startswith("-"), -value).otherwise(value))


def pulsar_catalogue(raw: DataFrame) -> DataFrame:
    """(src_name, ra_deg, dec_deg) of rows with PSRJ (or NAME), RAJ, DECJ as text; blanks, stars and malformed rows are skipped."""
    name = "PSRJ" if "PSRJ" in raw.columns else "NAME"
    ra, dec = F.trim("RAJ"), F.trim("DECJ")
    good = ~ra.isin("", "*", "nan") & ra.rlike("[: ]") & ~dec.isin("", "*", "nan")
    got = raw.where(good).select(F.trim(name).alias("src_name"), sexagesimal_degrees(ra, True).alias("ra_deg"), sexagesimal_degrees(dec, False).alias("dec_deg"))
    return got.where("ra_deg is not null and dec_deg is not null")


def pulsar_csv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The pulsar catalogue from its own file format: columns apart by semicolons, a line of units under the header."""
    return pulsar_catalogue(spark.read.option("header", True).option("sep", ";").csv(paths))


def survey_catalogue(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(src_name, ra_deg, dec_deg) of a survey's VOTable with the fields Name, RA and Dec; rows without a position are skipped."""
    got = votable(spark, paths, "Name string, RA double, Dec double")
    return got.where("RA is not null and Dec is not null").select(F.trim("Name").alias("src_name"), F.col("RA").alias("ra_deg"), F.col("Dec").alias("dec_deg"))


def discover(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(path, file, and what the file's name says) of all files under root whose name fits the pattern; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root).select("path")
    files = files.withColumn("file", F.element_at(F.split("path", "/"), -1))
    return files.select("path", "file", *(c.alias(k) for k, c in parse_name(F.col("file")).items()))


def first_there(spark: SparkSession, paths: list[str], schema: str, kind: str = "parquet") -> DataFrame:
    """The first of these tables that exists, else an empty one: a chunk's own candidates, then those of the whole observation."""
    for path in paths:
        try:
            return spark.read.format(kind).option("header", True).schema(schema).load(path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    return spark.createDataFrame([], schema)


def derived_paths(table: str) -> dict[str, str]:
    """Where a table's candidates go: base name, folder, and the prefixes of chunks (with their start index to be filled in) and of the whole."""
    folder, _, name = table.rstrip("/").rpartition("/")
    base = name.removesuffix(".ms").removesuffix(".parquet")
    out = f"{folder}/candidates" if folder else "candidates"
    return {"base": base, "folder": out, "chunk": f"{out}/{base}_chunk_{{:06d}}", "all": f"{out}/{base}_all"}


def votable(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """Rows of VOTable files by field name, a file a task; fields a file lacks are NULL."""
    kinds = T._parse_datatype_string(schema) if hasattr(T, "_parse_datatype_string") else spark.createDataFrame([], schema).schema
    files = spark.read.format("binaryFile").load(paths).select("content")
    names = kinds.names

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for content in batch.column("content").to_pylist():
                root = ElementTree.fromstring(content)
                local = lambda e: e.tag.rpartition("}")[2]
                fields = [e.get("name") for e in root.iter() if local(e) == "FIELD"]
                rows = [[(td.text or "").strip() or None for td in tr] for tr in root.iter() if local(tr) == "TR"]
                at = {n: fields.index(n) if n in fields else None for n in names}
                yield pa.RecordBatch.from_pydict({n: pa.array([None if at[n] is None else r[at[n]] for r in rows], pa.string()) for n in names})

    text = files.mapInArrow(read, ", ".join(f"`{n}` string" for n in names))
    return text.select(*(F.col(f.name).try_cast(f.dataType).alias(f.name) for f in kinds))


def catalogue_path(spark: SparkSession, name: str, packaged: str) -> str:
    """The path in the session's setting spark.skylattice.catalogue.NAME, if there is such a file, else the packaged one."""
    given = spark.conf.get(f"spark.skylattice.catalogue.{name}", None)
    if given:
        try:
            spark.read.format("binaryFile").load(given)
            return given
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    return packaged
