"""Training and labelling tables in Parquet, JSON or CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchlight import constants as C
from patchlight import schemas
from patchlight.session import work_dir

# A cell may hold line ends and quotes; a quote inside a cell is doubled.
CSV = {"header": "true", "multiLine": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false",
       "ignoreTrailingWhiteSpace": "false"}


def read_review_examples(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    return spark.read.format(format).schema(schemas.REVIEW_EXAMPLES).load(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV table in which the usual markers of a missing value become NULL."""
    return na_to_null(spark.read.options(**CSV).schema(schema).csv(path))


def na_to_null(rows: DataFrame) -> DataFrame:
    return rows.select(
        *[
            F.when(~F.col(f.name).isin(C.NA_TOKENS), F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else F.col(f.name)
            for f in rows.schema
        ]
    )


def write_table(rows: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists") -> None:
    options = {**CSV, "quoteAll": "true"} if format == "csv" else {}
    rows.write.mode(mode).format(format).options(**options).save(path)


def materialise(rows: DataFrame, purpose: str, *by: str) -> DataFrame:
    """Write a table that several jobs read to the shared folder, in folders ``by`` columns, and read it back.

    The next jobs start from files, so a lost executor costs none of the work before.
    """
    path = work_dir(rows.sparkSession, purpose)
    writer = rows.write.partitionBy(*by) if by else rows.write
    writer.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def with_row_id(table: DataFrame) -> DataFrame:
    """Add ``row_id``, the place of a row in the files of a Parquet table.

    Rows of a training table need not differ. Their place does, it is the same in every
    run and after every retry, and it costs no shuffle.
    """
    place = F.concat_ws(
        ":", F.col("_metadata.file_path"), F.col("_metadata.row_index").cast("string")
    )
    return table.select("*", place.alias("row_id"))


def write_labelled_run(labelled: DataFrame, path: str, run_id: str) -> None:
    """Add the rows of one run; writing the same run again replaces it."""
    labelled.write.mode("overwrite").parquet(f"{path.rstrip('/')}/run_id={run_id}")


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """The labelled rows of all runs."""
    return spark.read.schema(schemas.LABELLED_DATA).parquet(path)


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    """A written findings table, the input of the roll-ups."""
    return spark.read.schema(schemas.FINDINGS).parquet(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Written predictions, the input of the metrics."""
    return spark.read.schema(schemas.PREDICTIONS).parquet(path)
