"""Pileup sources: 18-column methylation tables, an indexed form of them, and low-coverage positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The types of the raw file's columns, in order.
_RAW = "SLLSLSLLSLDLLLLLLL"
_TYPES = {"S": T.StringType(), "L": T.LongType(), "D": T.DoubleType()}
RAW_SCHEMA = T.StructType([T.StructField(f"column_{i + 1}", _TYPES[t]) for i, t in enumerate(_RAW)])
PILEUP_SCHEMA = T.StructType([
    T.StructField("contig", T.StringType()), T.StructField("position", T.LongType()), T.StructField("mod_type", T.StringType()),
    T.StructField("strand", T.StringType()), T.StructField("fraction_mod", T.DoubleType()), T.StructField("Nvalid_cov", T.LongType()),
])


class EmptyPileup(ValueError):
    pass


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """All 18 columns; both ``NA`` and ``null`` stand for null. Compressed files are read as they are."""
    strings = T.StructType([T.StructField(f.name, T.StringType()) for f in RAW_SCHEMA])
    raw = spark.read.csv(path, sep="\t", schema=strings)
    value = lambda c: F.when(F.col(c).isin("NA", "null"), None).otherwise(F.col(c))
    return raw.select(*(value(f.name).try_cast(f.dataType).alias(f.name) for f in RAW_SCHEMA))


def logical(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("column_1").alias("contig"), F.col("column_2").alias("position"), F.col("column_4").alias("mod_type"),
        F.col("column_6").alias("strand"), (F.col("column_11") / 100).alias("fraction_mod"), F.col("column_10").alias("Nvalid_cov"),
    )


def read_pileup(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """The logical pileup; EmptyPileup if it has no rows and ``check`` is set."""
    out = logical(read_raw(spark, path))
    if check and out.isEmpty():
        raise EmptyPileup(path)
    return out


def index_pileup(pileup: DataFrame, path: str, files_per_task: int = 1) -> None:
    """Write the pileup sorted by contig and position, so that Parquet's statistics skip other contigs.

    Ranges of contigs, not a folder for each: assemblies have millions of them. A large contig spans files.
    """
    pileup.repartitionByRange("contig", "position").sortWithinPartitions("contig", "position").write.mode("overwrite").parquet(path)


def read_contigs(spark: SparkSession, path: str, contigs: list[str] | DataFrame) -> DataFrame:
    """The indexed pileup's rows of some contigs; an empty typed frame if none is there."""
    indexed = spark.read.schema(PILEUP_SCHEMA).parquet(path)
    if isinstance(contigs, list):
        return indexed.where(F.col("contig").isin(contigs)) if contigs else indexed.limit(0)
    return indexed.join(contigs.select("contig").distinct(), "contig", "left_semi")


def pileup_of(spark: SparkSession, path: str, contigs: DataFrame) -> DataFrame:
    """The pileup of some contigs: from an index (a folder that ``index_pileup`` wrote) or from a raw file. EmptyPileup if it has no rows."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker):
        return read_pileup(spark, path)
    out = read_contigs(spark, path, indexed_contigs(spark, path, contigs))
    if out.isEmpty():
        raise EmptyPileup(path)
    return out


def indexed_contigs(spark: SparkSession, path: str, contigs: DataFrame) -> DataFrame:
    """The given contigs that the index has."""
    return contigs.join(spark.read.parquet(path).select("contig").distinct(), "contig", "left_semi")


def low_coverage(raw: DataFrame, contig_mods: DataFrame, least: int = 5, failed: float = 0.3) -> DataFrame:
    """contig_mod and the positions of low coverage whose share of valid reads is still above ``failed``."""
    rows = raw.select("*", F.concat_ws("_", "column_1", "column_4").alias("contig_mod"))
    rows = rows.where((F.col("column_10") <= least) & (F.col("column_10") / (F.col("column_10") + F.col("column_17")) > failed))
    rows = rows.join(contig_mods.select("contig_mod").distinct(), "contig_mod", "left_semi")
    return rows.groupBy("contig_mod", F.col("column_6").alias("strand")).agg(F.array_sort(F.collect_list("column_2")).alias("positions"))
