"""Readers and writers for the jobs' file inputs and outputs.

Everything reads with an explicit schema (no inference pass over the data) and keeps file
metadata through ``_metadata`` rather than listing files on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ashgrid.functions.columns import from_epoch_ms, nan_to_null, try_parse_ntz
from ashgrid.session import small_inputs_to_tasks

__all__ = ["path_exists", "list_files", "RAW_SENSOR_SCHEMA", "read_sensor_files", "read_coded_files", "explode_fire_map", "read_cells",
           "listing_to_fire_dates", "nested_listing_to_fire_dates", "rows_from_header_array", "write_matched_csv", "MATCHED_COLUMNS"]

# The column names of the hourly sensor files.
RAW_SENSOR_SCHEMA = T.StructType([
    T.StructField("State Code", T.IntegerType()), T.StructField("County Code", T.IntegerType()),
    T.StructField("Site Num", T.IntegerType()), T.StructField("Latitude", T.DoubleType()),
    T.StructField("Longitude", T.DoubleType()), T.StructField("Date GMT", T.StringType()),
    T.StructField("Time GMT", T.StringType()), T.StructField("Sample Measurement", T.DoubleType()),
])


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists in the store that the path names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def list_files(spark: SparkSession, root: str, glob: str = "*.tif") -> DataFrame:
    """File listing as a DataFrame (path, length, modificationTime) for A5 / Q1, done by the
    ``binaryFile`` source on the executors; the content column is not read unless selected."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", glob)
                 .option("recursiveFileLookup", "true").load(root)
                 .select("path", "length", "modificationTime"))


def read_sensor_files(spark: SparkSession, paths: Sequence[str] | str, schema: T.StructType = RAW_SENSOR_SCHEMA,
                      extra: Sequence[tuple[Sequence[str] | str, T.StructType]] = ()) -> DataFrame:
    """A1: every CSV under ``paths`` appended into one table (explicit schema, header row).

    Folders whose files carry a different column set are given in ``extra`` with their own
    schema and appended by name; columns missing on one side are null."""
    df = _without_nan(spark.read.schema(schema).option("header", True).csv(paths))
    for p, s in extra:
        df = df.unionByName(_without_nan(spark.read.schema(s).option("header", True).csv(p)), allowMissingColumns=True)
    return df


def _without_nan(df: DataFrame) -> DataFrame:
    """NaN in any floating-point column becomes null (missing values at ingest)."""
    return df.select(*[nan_to_null(F.col(f"`{c}`")).alias(c) if t in ("double", "float") else F.col(f"`{c}`")
                       for c, t in df.dtypes])


def read_coded_files(spark: SparkSession, glob: str, codes: Sequence[str], years: Sequence[int],
                     schema: T.StructType = RAW_SENSOR_SCHEMA,
                     name_pattern: str = r"hourly_(\d+)_(\d{4})") -> DataFrame:
    """A2: files named ``hourly_<code>_<year>``: parameter code and year come from the path
    and are kept as columns; only the wanted codes and years are returned."""
    df = spark.read.schema(schema).option("header", True).csv(glob)
    path = F.col("_metadata.file_path")
    df = df.withColumns({"code": F.regexp_extract(path, name_pattern, 1),
                         "file_year": F.regexp_extract(path, name_pattern, 2).try_cast("int")})
    return _without_nan(df.filter(F.col("code").isin(list(codes)) & F.col("file_year").isin(list(years))))


FIRE_ENTRY = T.StructType([
    T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType()),
    T.StructField("start", T.StringType()), T.StructField("end", T.StringType()),
])
# Keys of a fire map that name settings, not fires.
CONTROL_KEYS = ("output_bucket", "rectangular_size", "year")


def explode_fire_map(df: DataFrame, doc: str = "doc", control_keys: Sequence[str] = CONTROL_KEYS) -> DataFrame:
    """A3: JSON documents ``{name: {latitude, longitude, start, end}, <control keys>...}`` ->
    one row per fire (fire_name, latitude, longitude, start, end, year); control keys dropped."""
    m = F.from_json(F.col(doc), T.MapType(T.StringType(), T.StringType()))
    ex = df.select(m.alias("_m")).select(
        F.col("_m")["year"].try_cast("int").alias("year"), F.explode("_m").alias("fire_name", "_v"))
    ex = ex.filter(~F.col("fire_name").isin(list(control_keys)))
    e = F.from_json(F.col("_v"), FIRE_ENTRY)
    return ex.select("fire_name", e["latitude"].alias("latitude"), e["longitude"].alias("longitude"),
                     try_parse_ntz(e["start"]).alias("start"), try_parse_ntz(e["end"]).alias("end"), "year")


def read_cells(spark: SparkSession, path: str, start, end, variables: Sequence[str],
               keys: Sequence[str] = ("date", "y", "x")) -> DataFrame:
    """A4: grid cells stored as Parquet partitioned by ``date``; only dates in [start, end] and
    the wanted variables are read (partition pruning and column pruning at the scan).
    NaN fill values become null."""
    df = spark.read.parquet(path)
    df = df.filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return df.select(*keys, *[nan_to_null(F.col(v)).alias(v) for v in variables])


def listing_to_fire_dates(df: DataFrame, xml: str = "xml") -> DataFrame:
    """Directory listings as XML records ``<entry><dir>fire_<id></dir><file>yyyy-MM-dd.tif</file></entry>``
    -> per fire the first and last valid image date; names that are not dated .tif files are
    skipped."""
    rec = F.from_xml(F.col(xml), "dir string, file string")   # native XML reader, ~7x faster than xpath
    d, f = rec["dir"], rec["file"]
    dt = F.try_to_date(F.regexp_extract(f, r"^(\d{4}-\d{2}-\d{2})\.tif$", 1), "yyyy-MM-dd")
    rows = df.select(d.alias("fire"), dt.alias("d")).filter(F.col("d").isNotNull())
    return rows.groupBy("fire").agg(F.min("d").alias("first_date"), F.max("d").alias("last_date"))


def nested_listing_to_fire_dates(df: DataFrame, xml: str = "xml") -> DataFrame:
    """A6, nested form: a directory tree as one XML document per row, ``<tree><directory name=".">``
    holding year directories, these ``fire_<id>`` directories, these ``<file name="yyyy-MM-dd.tif"/>``
    -> per fire id the first and last valid image date and the ordered dates.  Other directories
    and files are skipped; a fire listed in several trees is merged."""
    file = "array<struct<_name: string>>"
    fire = f"array<struct<_name: string, file: {file}>>"
    year = f"array<struct<_name: string, directory: {fire}>>"
    tree = F.from_xml(F.col(xml), f"directory array<struct<_name: string, directory: {year}>>")
    base = df.select(F.explode(tree["directory"]).alias("d")).filter(F.col("d._name") == ".")
    years = base.select(F.explode("d.directory").alias("d"))
    fires = years.select(F.explode("d.directory").alias("d")).filter(F.col("d._name").startswith("fire_"))
    files = fires.select(F.regexp_replace("d._name", "^fire_", "").alias("fire_id"), F.explode("d.file").alias("f"))
    day = F.try_to_date(F.regexp_extract("f._name", r"^(\d{4}-\d{2}-\d{2})\.tif$", 1), "yyyy-MM-dd")
    return files.select("fire_id", day.alias("d")).filter(F.col("d").isNotNull()).groupBy("fire_id").agg(
        F.min("d").alias("start_date"), F.max("d").alias("end_date"), F.array_sort(F.collect_set("d")).alias("dates"))


def rows_from_header_array(df: DataFrame, doc: str = "doc", keep: Sequence[str] = (),
                           time_col: str = "time", value_col: str = "pm25", scale: float = 1e9,
                           keep_ragged: bool = False) -> DataFrame:
    """JSON arrays whose first inner array is the header -> one row per data array;
    rows whose time is not numeric are dropped; epoch ms -> timestamp; value scaled.

    A row shorter or longer than the header cannot be matched to its columns: it is dropped too, or,
    with ``keep_ragged``, kept with null time and value and ``reason`` = 'ragged' for quarantine (Q3)."""
    arr = F.from_json(F.col(doc), T.ArrayType(T.ArrayType(T.StringType())))
    x = df.select(*keep, arr.alias("_a")).select(*keep, F.col("_a")[0].alias("_h"),
                                                  F.posexplode("_a").alias("_pos", "_row"))
    fits = F.size("_h") == F.size("_row")
    x = x.filter(F.col("_pos") > 0).select(*keep, "_pos", (~fits).alias("_ragged"),
                                           F.when(fits, F.map_from_arrays("_h", "_row")).alias("_m"))
    t = F.col("_m")[time_col].try_cast("long")
    v = F.col("_m")[value_col].try_cast("double")
    wanted = (t.isNotNull() | F.col("_ragged")) if keep_ragged else t.isNotNull()
    return (x.filter(wanted)
             .select(*keep, (F.col("_pos") - 1).alias("row_idx"), from_epoch_ms(t).alias("time"),
                     (v * scale).alias(value_col),
                     *([F.when(F.col("_ragged"), F.lit("ragged")).alias("reason")] if keep_ragged else [])))


# The header of the matched-pairs file.
MATCHED_COLUMNS = ["fire_name", "sensor_id", "sat_id", "lat", "lon", "time", "sensor_pm25", "sat_pm25"]


def write_matched_csv(df: DataFrame, path: str, columns: Sequence[str] = MATCHED_COLUMNS, compression: str = "none",
                      rows_per_file: int = 0) -> None:
    """Matched pairs as CSV with a header, in a fixed column order.  ``compression`` names a codec of Spark's CSV
    files ("gzip"); pairs repeat their reading, so packed files are many times smaller.  A packed file is read by one
    task: ``rows_per_file`` starts another file after so many pairs (0: one file a task)."""
    w = df.select(*columns).write.mode("overwrite").option("header", True).option("compression", compression)
    with small_inputs_to_tasks(df.sparkSession):
        w.option("maxRecordsPerFile", rows_per_file).csv(path)
