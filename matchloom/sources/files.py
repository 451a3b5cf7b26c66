"""Delimited files, score files, output names."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from matchloom.sources.csvlines import logical_lines
from matchloom.sources.scratch import delete

#: Texts that stand for a missing value.
NULLS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def quotes_hold_line_breaks(spark: SparkSession, path: str | list[str]) -> bool:
    """Whether some line has an odd number of quotes: a scan that splits files, and ends with the first such line."""
    odd = (F.length("value") - F.length(F.translate("value", '"', ""))) % 2 == 1
    return not spark.read.text(path).where(odd).isEmpty()


def read_csv(spark: SparkSession, path: str | list[str], schema: StructType | str | None = None, sep: str = ",", header: bool = True, extra_nulls: bool = False, multi_line: bool | None = None) -> DataFrame:
    """Quoted CSV with doubled quotes; short rows are filled with nulls. Without a schema all columns are texts (no pass over
    the data to guess). `extra_nulls` turns the usual spellings of NA into nulls. `multi_line`: whether quoted fields hold line breaks,
    found by a look at the files if None; such files are still split between tasks, after a pass that counts quotes (`csvlines`)."""
    if multi_line is None:
        multi_line = quotes_hold_line_breaks(spark, path)
    if multi_line:
        out = read_csv_lines(spark, path, schema, sep, header)
    else:
        r = spark.read.option("header", header).option("sep", sep).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").option("nullValue", "")
        out = (r.schema(schema) if schema is not None else r).csv(path)
    if extra_nulls:
        out = out.select(*[F.when(~F.col(c).isin(*NULLS), F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in out.dtypes])
    return out


def read_csv_lines(spark: SparkSession, path: str | list[str], schema: StructType | str | None, sep: str, header: bool) -> DataFrame:
    lines = logical_lines(spark, path, header)
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "nullValue": ""}
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    if schema is None:
        first = lines.where("first").select("line").first()
        width = spark.range(1).select(F.lit(first["line"] if first else "").alias("line"))
        names = width.select(F.from_csv("line", ", ".join(f"c{i} string" for i in range((first["line"] if first else "").count(sep) + 1)), options).alias("x")).first()["x"]
        found = [n for n in names if n is not None]
        schema = StructType([StructField(n if header else f"_c{i}", StringType()) for i, n in enumerate(found)])
    rows = lines.where("NOT first") if header else lines
    return rows.where("line <> ''").select(F.from_csv("line", schema.toDDL(), options).alias("x")).select("x.*")


def read_tsv(spark: SparkSession, path: str, schema: StructType | str | None = None, header: bool = True) -> DataFrame:
    """Tab-separated without quoting."""
    r = spark.read.option("header", header).option("sep", "\t").option("quote", "").option("nullValue", "")
    return (r.schema(schema) if schema is not None else r).csv(path)


def read_data_if_needed(x, spark: SparkSession | None = None) -> DataFrame:
    """A frame as it is; a path is read (Parquet by its ending, else CSV); anything else is an error."""
    if isinstance(x, DataFrame):
        return x
    if not isinstance(x, str):
        raise ValueError("an input must be a DataFrame or an existing file")
    spark = spark or SparkSession.getActiveSession()
    return spark.read.parquet(x) if x.rstrip("/").endswith(".parquet") else read_csv(spark, x)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", sep: str = ",") -> None:
    """CSV with a header, empty text for nulls, doubled quotes; no index column."""
    df.write.mode(mode).option("header", True).option("sep", sep).option("nullValue", "").option("emptyValue", "").option("escape", '"').csv(path)


def write_scores(scores: DataFrame, path: str, append: bool = False) -> None:
    """Score table as quoted CSV, so ids with commas stay whole."""
    write_csv(scores, path, "append" if append else "overwrite")


def append_scores(scores: DataFrame, path: str, run: str) -> None:
    """Adds the rows of one run to a score folder. A run has its own folder, which a repeated run writes anew, and counts only once
    its name stands in the list of runs, as the last step: rows of a run that broke off are never read, and none is there twice."""
    if not re.fullmatch(r"[A-Za-z0-9_-]+", run):
        raise ValueError("the name of a run is letters, digits, _ and -")
    spark = scores.sparkSession
    mark = f"{path}/_runs/{run}"
    delete(spark, mark)
    write_csv(scores, f"{path}/run-{run}")
    file = spark._jvm.org.apache.hadoop.fs.Path(mark)
    file.getFileSystem(spark._jsc.hadoopConfiguration()).create(file, True).close()


def listed_runs(spark: SparkSession, path: str) -> list[str]:
    """Names of the runs that ended, in order."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_runs")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in fs.listStatus(folder)) if fs.exists(folder) else []


def read_appended(spark: SparkSession, path: str, schema: str = "reference_id string, paired_id string, score double") -> DataFrame:
    """All rows of the runs that ended."""
    runs = listed_runs(spark, path)
    return read_csv(spark, [f"{path}/run-{r}" for r in runs], schema) if runs else spark.createDataFrame([], schema)


def write_top_words(tops: DataFrame, path: str, n: int = 5, key: str = "grp") -> None:
    """One row for each concept with its words in rank order."""
    write_csv(top_words_table(tops, n, key), path)


def top_words_table(tops: DataFrame, n: int = 5, key: str = "grp") -> DataFrame:
    words = F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"])
    return tops.groupBy(F.col(key).alias("Concept")).agg(F.array_join(words, " ").alias(f"Top {n} words"))


def output_name(prefix: str = "", kind: str = "", corpora: bool = False, embedded: bool = False, key: str = "", suffix: str = "", ending: str = ".csv") -> str:
    """Parts that are not empty, joined: prefix, kind, weighting, embedding, key, suffix."""
    parts = [prefix, kind, "multtfcdf" if corpora else "tfidf", "embed" if embedded else "", key, suffix]
    return "_".join(p for p in parts if p) + ending


def output_names(prefix: Column, kind: Column, corpora: Column, embedded: Column, key: Column, ending: str = ".csv") -> Column:
    """The same name from columns, for one file for each row; null or empty parts are left out."""
    parts = [prefix, kind, F.when(corpora, "multtfcdf").otherwise("tfidf"), F.when(embedded, "embed"), key]
    return F.concat(F.concat_ws("_", *[F.nullif(p.cast("string"), F.lit("")) for p in parts]), F.lit(ending))
