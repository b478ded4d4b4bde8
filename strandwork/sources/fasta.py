"""FASTA and FASTQ sources, contig-to-bin maps and bin FASTA files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FASTA_SUFFIXES = (".fasta", ".fa", ".fna", ".gz")


def read_fasta(spark: SparkSession, path: str, trim: str | None = None, repeated: str = "append") -> DataFrame:
    """(contig, seq), sequences in upper case. ``trim``: cut names at this string.

    A name that comes again is appended to (``append``) or replaces what was there (``last``).
    Files are split at record starts, so a large one is read by many tasks; gzip is read as it is.
    """
    records = spark.read.text(path, lineSep="\n>").select(F.regexp_replace("value", r"^>|\r", "").alias("r"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    head = F.substring_index("r", "\n", 1)
    body = F.upper(F.regexp_replace(F.substr(F.col("r"), F.length(head) + 2), r"\s", ""))
    name = F.substring_index(head, trim, 1) if trim else head
    rows = records.where(F.trim("r") != "").select(F.trim(name).alias("contig"), body.alias("seq"), "file", "block", "at")
    place = F.struct("file", "block", "at", "seq")
    if repeated == "last":
        return rows.groupBy("contig").agg(F.max(place)["seq"].alias("seq"))
    return rows.groupBy("contig").agg(F.array_join(F.transform(F.array_sort(F.collect_list(place)), lambda x: x["seq"]), "").alias("seq"))


def parse_fastx(text: str) -> Iterator[tuple[str, str, str | None]]:
    """(name up to the first space, sequence, qualities or None) of FASTA and FASTQ records in any mix."""
    lines = iter(text.splitlines())
    line = next(lines, None)
    while line is not None:
        if line[:1] not in (">", "@"):
            line = next(lines, None)
            continue
        name = (line[1:].split(None, 1) or [""])[0]
        parts: list[str] = []
        line = next(lines, None)
        while line is not None and line[:1] not in (">", "@", "+"):
            parts.append(line.strip())
            line = next(lines, None)
        seq = "".join(parts)
        if line is None or line[:1] != "+":
            yield name, seq, None
            continue
        qual = ""
        line = next(lines, None)
        while line is not None and len(qual) < len(seq):
            qual += line.strip()
            line = next(lines, None)
        yield name, seq, qual if len(qual) == len(seq) else None


def read_fastx(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, name, seq, qual): files of one genome each, parsed whole by a task for each file."""
    files = spark.read.text(paths, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))

    def run(batches):
        for b in batches:
            rows = [(f, *r) for t, f in zip(*(c.to_pylist() for c in b.columns)) for r in parse_fastx(t or "")]
            columns = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["file", "name", "seq", "qual"])

    return files.mapInArrow(run, "file string, name string, seq string, qual string")


def checked_assembly(spark: SparkSession, path: str) -> DataFrame:
    """``read_fasta`` for binning: the file must exist and have a FASTA ending."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        raise FileNotFoundError(path)
    if not path.endswith(FASTA_SUFFIXES):
        raise ValueError(f"{path} must end in one of {', '.join(FASTA_SUFFIXES)}")
    return read_fasta(spark, path, trim=" ")


def contig_lengths(assembly: DataFrame) -> DataFrame:
    return assembly.select("contig", F.length("seq").cast("long").alias("length"))


def file_stem(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, r"\.gz$", ""), r"\.[^.]*$", "")


def contig_bins(spark: SparkSession, table: str | None = None, files: list[str] | None = None, directory: str | None = None, extension: str = "fasta") -> DataFrame:
    """(contig, bin) from exactly one of a table, FASTA files or a directory of them; a file's bin is its stem.

    Tables have no header; one with the header contig, bin is tolerated.
    """
    if sum(x is not None for x in (table, files, directory)) != 1:
        raise ValueError("give one of table, files and directory")
    if table is not None:
        rows = spark.read.csv(table, sep="\t", schema="contig string, bin string")
        return rows.where(~((F.col("contig") == "contig") & (F.col("bin") == "bin")))
    paths = files if files is not None else [f"{directory}/*.{extension.lstrip('.')}"]
    return read_fastx(spark, paths).select(F.col("name").alias("contig"), file_stem(F.col("file")).alias("bin"))


def split_sequences(assembly: DataFrame, size: int = 1_000_000, overlap: int = 64) -> DataFrame:
    """(contig, offset, seq): long sequences in overlapping pieces, so that one chromosome isn't one task's work."""
    n = F.greatest(F.ceil((F.length("seq") - overlap) / F.lit(size)).cast("int"), F.lit(1))
    rows = assembly.select("contig", "seq", F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    return rows.select("contig", (F.col("k") * size).alias("offset"), F.substring(F.col("seq"), F.col("k") * size + 1, F.lit(size + overlap)).alias("seq"))


def write_bins(new_bins: DataFrame, assembly: DataFrame, folder: str) -> None:
    """One ``<bin>.fa`` in ``folder`` for each bin, from tasks that hold a bin's contigs sorted; contigs without a sequence are left out."""
    rows = new_bins.select("contig", "bin").join(assembly.select("contig", "seq"), "contig")
    line = F.concat(F.lit(">"), "contig", F.lit("\n"), "seq")
    staged = f"{folder}/_bins"
    spark = rows.sparkSession
    rows.select("bin", "contig", line.alias("value")).repartition("bin").sortWithinPartitions("bin", "contig").select("bin", "value").write.mode("overwrite").partitionBy("bin").text(staged)
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(staged)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for entry in fs.listStatus(root):
        name = entry.getPath().getName()
        if not name.startswith("bin="):
            continue
        part = next(f.getPath() for f in fs.listStatus(entry.getPath()) if f.getPath().getName().startswith("part-"))
        target = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name[4:]}.fa")
        fs.delete(target, False)
        fs.rename(part, target)
    fs.delete(root, True)
