"""What several of these operators share."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchspan import session
from watchspan.session import stable_storage as keep

__all__ = ["keep", "shared_folder", "table", "text_of", "words_of", "SPACE"]

#: The white space of the word rule, as a list of characters.
SPACE = " \t\n\x0b\f\r"


def shared_folder(spark: SparkSession) -> str:
    return session.shared_folder(spark).rstrip("/")


def table(spark: SparkSession, sf_dir: str, name: str, columns: Iterable[str]) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def text_of(column: str = "text") -> Column:
    """A null text is an empty one."""
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    """Runs of anything but ASCII white space; an empty text has none."""
    inner = F.btrim(text, F.lit(SPACE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+"))
