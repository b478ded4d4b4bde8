"""Command line: motif_discovery, detect_contamination, include_contigs, link_motifs, index_pileup, check_installation."""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import datasets
from .functions.motif import Motif
from .operators import binning, discover, linker, pileup
from .sources import fasta, tables
from .sources import pileup as pileups

log = logging.getLogger("strandwork")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandwork", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, bins: bool = True) -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        p.add_argument("--out", required=True)
        p.add_argument("--verbose", action="store_true")
        p.add_argument("--seed", type=int, default=1)
        if bins:
            group = p.add_mutually_exclusive_group(required=True)
            group.add_argument("--contig_bin")
            group.add_argument("--files", nargs="+")
            group.add_argument("--directory")
            p.add_argument("--extension", default="fasta")
        return p

    # Names and defaults of the options are fixed values: users' scripts pass them.
    p = command("motif_discovery")
    p.add_argument("assembly")
    p.add_argument("pileup")
    p.add_argument("--search_frame_size", type=int, default=40)
    p.add_argument("--methylation_threshold_low", type=float, default=0.3)
    p.add_argument("--methylation_threshold_high", type=float, default=0.7)
    p.add_argument("--minimum_kl_divergence", type=float, default=0.05)
    p.add_argument("--min_motif_score", type=float, default=1.5)
    p.add_argument("--threshold_valid_coverage", type=int, default=5)
    p.add_argument("--min_motifs_bin", type=int, default=50)
    p.add_argument("--save_graphs", action="store_true", help="write each search's motif graph")
    p.add_argument("--debug", action="store_true", help="write the background windows and their position matrix")
    for name in ("detect_contamination", "include_contigs"):
        p = command(name)
        p.add_argument("--assembly", required=True)
        p.add_argument("--pileup", required=True)
        p.add_argument("--bin_motifs", required=True)
        p.add_argument("--min_valid_read_coverage", type=int, default=3)
        p.add_argument("--methylation_threshold", type=float, default=24)
        p.add_argument("--methylation_output_type", choices=["median", "weighted_mean"], default="median")
        p.add_argument("--num_consensus", type=int, default=4)
        p.add_argument("--contamination_file")
        p.add_argument("--write_bins", action="store_true")
        p.add_argument("--force", action="store_true")
        if name == "include_contigs":
            p.add_argument("--mean_model_confidence", type=float, default=0.8)
            p.add_argument("--run_detect_contamination", action="store_true")
    p = command("link_motifs")
    for name in ("hmm_hits", "systems", "blast", "families", "bin_motifs"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--identity", type=float, default=80)
    p.add_argument("--qcovs", type=float, default=80)
    p.add_argument("--minimum_motif_methylation", type=float, default=0.5)
    command("index_pileup", bins=False).add_argument("pileup")
    command("check_installation", bins=False)
    return top


def setup(args: argparse.Namespace) -> None:
    """Folder, log level and the arguments' record."""
    out = Path(args.out)
    out.mkdir(parents=True, exist_ok=True)
    logging.basicConfig(level=logging.DEBUG if args.verbose else logging.INFO, format="%(asctime)s %(levelname)s %(message)s")
    (out / "args.json").write_text(json.dumps(vars(args), indent=1))


def _bins(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    return fasta.contig_bins(spark, args.contig_bin, args.files, args.directory, args.extension)


def motif_discovery(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    settings = discover.Settings(
        padding=args.search_frame_size // 2, low=args.methylation_threshold_low, high=args.methylation_threshold_high, min_kl=args.minimum_kl_divergence,
        score=args.min_motif_score, min_occurrences=args.min_motifs_bin,
    )
    assembly = fasta.read_fasta(spark, args.assembly, trim=" ")
    bins = pileup.known_bins(_bins(spark, args), assembly)
    rows = pileup.covered(pileups.pileup_of(spark, args.pileup, bins), args.threshold_valid_coverage)
    rows = pileup.without_neighbours(pileup.often_modified(rows))
    found = discover.discover_motifs(rows, assembly, bins, settings)
    tables.write_motifs(found, f"{args.out}/bin-motifs.tsv")
    if args.save_graphs:
        folder = Path(args.out) / "graphs"
        folder.mkdir(exist_ok=True)
        for g in discover.motif_graphs(rows, assembly, bins, settings).toLocalIterator():  # one genome's graph at a time
            tables.write_graph([n.asDict() for n in g.nodes], [(e.parent, e.child) for e in g.edges], f"{folder}/{g.reference}_{g.mod_type}.gml")
    if args.debug:
        back = discover.background_windows(rows.join(bins.select("contig", "bin"), "contig"), assembly, settings)
        tables.write_tsv(back.select("bin", "mod_type", "window"), f"{args.out}/background_windows.tsv", order=["bin", "mod_type", "window"])
        tables.write_tsv(pileup.position_matrix(back, ["bin", "mod_type"]), f"{args.out}/background_frequencies.tsv", order=["bin", "mod_type", "pos", "base"])
    return found


def index_command(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    pileups.index_pileup(pileups.read_pileup(spark, args.pileup), f"{args.out}/pileup_index")
    return spark.read.parquet(f"{args.out}/pileup_index")


def _methylation(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    motifs = tables.read_tsv(spark, args.bin_motifs).select("motif", "mod_type", "mod_position").distinct().collect()  # a motif table is small

    def make() -> DataFrame:
        read = [(m.motif, str(m.mod_type), Motif.read_iupac(m.motif, int(m.mod_position))) for m in motifs]
        assembly = fasta.read_fasta(spark, args.assembly, trim=" ")
        hits = pileup.motif_hits(assembly, list(dict.fromkeys(x for *_, x in read))).withColumnRenamed("motif", "text")
        names = spark.createDataFrame([(x.text, x.position, name, mod) for name, mod, x in read], "text string, mod_position int, motif string, mod_type string")
        parts = hits.join(names, ["text", "mod_position"]).drop("text")
        raw = pileups.read_raw(spark, args.pileup)
        rows = pileups.logical(raw).withColumn("n_diff", F.lit(0)) if "column_17" not in raw.columns else raw.select(*_logical_with_diff())
        return pileup.contig_methylation(rows, parts, args.methylation_output_type, args.min_valid_read_coverage, "n_diff")

    inputs = {k: getattr(args, k) for k in ("assembly", "pileup", "bin_motifs", "min_valid_read_coverage", "methylation_output_type")}
    path = f"{args.out}/motifs-scored-read-methylation_{args.methylation_output_type}.tsv"
    return pileup.enough_evidence(tables.cached_tsv(spark, path, tables.METHYLATION_SCHEMA, make, inputs, args.force), args.methylation_threshold)


def _logical_with_diff() -> list:
    c = F.col
    return [
        c("column_1").alias("contig"), c("column_2").alias("position"), c("column_4").alias("mod_type"), c("column_6").alias("strand"),
        (c("column_11") / 100).alias("fraction_mod"), c("column_10").alias("Nvalid_cov"), F.coalesce(c("column_17"), F.lit(0)).alias("n_diff"),
    ]


def _contamination(spark: SparkSession, args: argparse.Namespace, methylation: DataFrame, bins: DataFrame, assembly: DataFrame) -> DataFrame:
    if args.contamination_file:
        return tables.read_contamination(spark, args.contamination_file)
    make = lambda: binning.detect_contamination(methylation, bins, fasta.contig_lengths(assembly), args.num_consensus)
    out = tables.cached(spark, f"{args.out}/bin_contamination.parquet", make, force=True)  # read back, not made again
    tables.write_tsv(out, f"{args.out}/bin_contamination.tsv")
    return out


def bin_command(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    assembly, bins, methylation = fasta.checked_assembly(spark, args.assembly), _bins(spark, args), _methylation(spark, args)
    include = None
    if args.command == "detect_contamination" or args.run_detect_contamination or args.contamination_file:
        contamination = _contamination(spark, args, methylation, bins, assembly)
    else:
        contamination = bins.limit(0)
    if args.command == "include_contigs":
        include = binning.include_contigs(methylation, bins, contamination, args.mean_model_confidence)
        tables.write_tsv(include, f"{args.out}/include_contigs.tsv")
    new = binning.new_contig_bins(bins, contamination, include)
    name = "decontaminated_contig_bin.tsv" if args.command == "detect_contamination" else "new_contig_bin.tsv"
    tables.write_tsv(new, f"{args.out}/{name}", order=["bin", "contig"])
    if args.write_bins:
        fasta.write_bins(new, assembly, f"{args.out}/{args.command}_bins")
    return new


def link_command(spark: SparkSession, args: argparse.Namespace) -> tuple[DataFrame, DataFrame]:
    numbered = lambda df, row: df.withColumn(row, F.monotonically_increasing_id())
    hits = linker.methyltransferases(numbered(tables.read_tsv(spark, args.hmm_hits), "row_no"), numbered(tables.read_tsv(spark, args.systems), "row_no"))
    blast = linker.significant_hits(numbered(tables.read_tsv(spark, args.blast), "row_no"), args.identity, args.qcovs)
    families = spark.read.csv(args.families, sep="\t").toDF("gene_id", "acc", "HMM_name", "HMM_acc")
    motifs = numbered(tables.read_tsv(spark, args.bin_motifs), "motif_row")
    genes, linked = linker.link_motifs(hits, blast, linker.gene_mod_types(families), _bins(spark, args), motifs, args.minimum_motif_methylation)
    tables.write_tsv(genes, f"{args.out}/mtase_assignment_table.tsv")
    tables.write_tsv(linked, f"{args.out}/motif_assignment_table.tsv")
    return genes, linked


def check_installation(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Discovery on made-up genomes whose motifs are known."""
    made = datasets.write_smoke_data(f"{args.out}/smoke", seed=args.seed)
    found = motif_discovery(spark, parser().parse_args(["motif_discovery", made["assembly"], made["pileup"], "--contig_bin", made["contig_bin"], "--out", args.out, "--min_motifs_bin", "20"]))
    log.info("found %s", [r.motif for r in found.select("motif").collect()])
    return found


COMMANDS = {"motif_discovery": motif_discovery, "detect_contamination": bin_command, "include_contigs": bin_command, "link_motifs": link_command, "index_pileup": index_command, "check_installation": check_installation}


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    setup(args)
    spark = SparkSession.builder.appName("strandwork").getOrCreate()
    COMMANDS[args.command](spark, args)


if __name__ == "__main__":
    main()
