"""CSV, JSON lines and Parquet files and directories.

Types and properties come from all rows, in one pass of aggregation before the read; a declared schema or ``infer_max`` saves it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace import infer
from millrace.sources.options import CsvOptions, JsonOptions, ParquetOptions


def read_parquet(spark: SparkSession, *paths: str, options: ParquetOptions | None = None) -> DataFrame:
    """The schema is the file's own; filters and columns are pushed into the scan."""
    options = options or ParquetOptions()
    reader = spark.read.option("mergeSchema", options.merge_schema)
    return (reader.option("pathGlobFilter", options.glob) if options.glob else reader).parquet(*paths)


def list_files(spark: SparkSession, path: str, ending: str) -> list[str]:
    """The files of a directory with an ending, by name; an error if there is none."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = sorted(s.getPath().toString() for s in system.listStatus(folder) if s.isFile() and s.getPath().getName().lower().endswith(ending))
    if not found:
        raise FileNotFoundError(f"no {ending} file in {path}")
    return found


def _breaks_in_quotes(spark: SparkSession, paths: list[str]) -> bool:
    """Whether some line has an odd number of quotes, so that a record goes on in the next: a pass that stops at the first."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return spark.read.text(paths).filter(quotes % 2 == 1).limit(1).count() > 0


def _csv_texts(spark: SparkSession, options: CsvOptions, paths: list[str], names: list[str] | None = None) -> DataFrame:
    """Files are read in splits unless quoted values hold line breaks: then each file is read as a whole."""
    multiline = _breaks_in_quotes(spark, paths) if options.multiline is None else options.multiline
    reader = spark.read.option("sep", options.delimiter[0]).option("header", options.header).option("quote", '"').option("escape", '"').option("multiLine", multiline).option("mode", "PERMISSIVE").option("enforceSchema", True)
    if names is not None:
        reader = reader.schema(T.StructType([T.StructField(n, T.StringType()) for n in names]))
    df = reader.csv(paths)
    return df if options.header or names is not None else df.toDF(*(f"column_{i + 1}" for i in range(len(df.columns))))


def read_csv(spark: SparkSession, *paths: str, options: CsvOptions | None = None, schema: str | None = None) -> DataFrame:
    """CSV files with types of the inference ladder, or a declared schema. Short rows are filled with null, long ones cut."""
    options = options or CsvOptions()
    if schema is not None:
        wanted = T.StructType.fromDDL(schema)
        texts = _csv_texts(spark, options, list(paths), wanted.names)
        return texts.select(*(infer.typed(f.name, f.dataType.simpleString()) for f in wanted))
    return infer.infer(_csv_texts(spark, options, list(paths)), options.infer_max)


def read_csv_directory(spark: SparkSession, path: str, options: CsvOptions | None = None) -> DataFrame:
    """All .csv files of a directory. Names come from the first by name, and the columns of the others are taken in order; types come from all."""
    options = options or CsvOptions()
    found = list_files(spark, path, ".csv")
    names = _csv_texts(spark, options, found[:1]).columns
    return infer.infer(_csv_texts(spark, options, found, names), options.infer_max)


#: A string is left as it is; a comma before a closing bracket goes.
_TRAILING = r'("(?:[^"\\]++|\\.)*+")|,(?=\s*[}\]])'
_BAD = "__not_read"


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.text(paths).filter(F.trim("value") != "")


def _json_names(lines: DataFrame) -> list[str]:
    """The properties of all lines by name; what comes to the driver is one name a column."""
    whole = F.json_object_keys("value")
    # comments and commas before a closing bracket are read by a map of texts
    loose = F.map_keys(F.from_json(F.regexp_replace("value", _TRAILING, "$1"), "map<string,string>", {"allowComments": "true"}))
    return sorted(r[0] for r in lines.select(F.explode(F.coalesce(whole, loose)).alias("name")).distinct().collect())


def _json_texts(lines: DataFrame, names: list[str]) -> DataFrame:
    """Nested values stay the text they are written in; a line that can't be read is read once more without commas before closing brackets."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, _BAD]])
    options = {"allowComments": "true", "columnNameOfCorruptRecord": _BAD}
    first = lines.select("value", F.from_json("value", schema, options).alias("j"))
    again = F.from_json(F.regexp_replace("value", _TRAILING, "$1"), schema, options)
    return first.select(F.when(F.col(f"j.{_BAD}").isNull(), F.col("j")).otherwise(again).alias("j")).select(*(F.col(f"j.`{n}`") for n in names))


def read_json(spark: SparkSession, *paths: str, options: JsonOptions | None = None, schema: str | None = None) -> DataFrame:
    """JSON lines; columns sorted by name, nested values as text, missing properties null."""
    options = options or JsonOptions()
    lines = _lines(spark, list(paths))
    if schema is not None:
        wanted = T.StructType.fromDDL(schema)
        return _json_texts(lines, wanted.names).select(*(infer.typed(f.name, f.dataType.simpleString()) for f in wanted))
    names = _json_names(lines.limit(options.infer_max) if options.infer_max else lines)
    return infer.infer(_json_texts(lines, names), options.infer_max)


def read_json_directory(spark: SparkSession, path: str, options: JsonOptions | None = None) -> DataFrame:
    """All .json files of a directory: names and types come from all of them."""
    return read_json(spark, *list_files(spark, path, ".json"), options=options)
