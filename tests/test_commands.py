"""The commands end to end on made-up files, and the smaller sequence and model functions."""

import json

import pytest
from pyspark.sql import functions as F

from strandwork import cli, datasets
from strandwork.functions import seqfn, stats
from strandwork.functions.motif import Motif
from strandwork.operators import pileup
from strandwork.sources import tables


def run(spark, *argv):
    args = cli.parser().parse_args(list(map(str, argv)))
    cli.setup(args)
    return cli.COMMANDS[args.command](spark, args)


@pytest.fixture(scope="module")
def made(tmp_path_factory):
    return datasets.write_smoke_data(str(tmp_path_factory.mktemp("smoke")))


@pytest.fixture(scope="module")
def found(spark, made, tmp_path_factory):
    """Discovery from the raw file."""
    out = tmp_path_factory.mktemp("found")
    run(spark, "motif_discovery", made["assembly"], made["pileup"], "--contig_bin", made["contig_bin"], "--out", out, "--min_motifs_bin", 20, "--save_graphs", "--debug")
    return out


def rows_of(path):
    head, *rows = path.read_text().splitlines()
    return [dict(zip(head.split("\t"), r.split("\t"))) for r in rows]


def test_discovery(found):
    rows = rows_of(found / "bin-motifs.tsv")
    assert list(rows[0]) == tables.MOTIF_COLUMNS
    assert {(r["reference"], r["motif"], r["mod_position"]) for r in rows} >= {(b, m, str(p)) for b, (m, p) in datasets.MOTIFS.items()}
    assert rows == sorted(rows, key=lambda r: (r["reference"], r["mod_type"], r["motif"]))
    assert (found / "graphs" / "bin1_a.gml").read_text().startswith("graph [")
    assert (found / "background_windows.tsv").exists() and len(rows_of(found / "background_frequencies.tsv")) == 3 * 41 * 4


def test_discovery_from_the_index(spark, made, found, tmp_path):
    run(spark, "index_pileup", made["pileup"], "--out", tmp_path / "i")
    run(spark, "motif_discovery", made["assembly"], tmp_path / "i" / "pileup_index", "--contig_bin", made["contig_bin"], "--out", tmp_path / "o", "--min_motifs_bin", 20)
    assert (tmp_path / "o" / "bin-motifs.tsv").read_text() == (found / "bin-motifs.tsv").read_text()


def test_binning(spark, made, found, tmp_path):
    given = ["--assembly", made["assembly"], "--pileup", made["pileup"], "--bin_motifs", found / "bin-motifs.tsv", "--contig_bin", made["contig_bin"], "--out", tmp_path]
    run(spark, "detect_contamination", *given, "--write_bins")
    first = (tmp_path / "motifs-scored-read-methylation_median.tsv").read_text()
    kept = (tmp_path / "decontaminated_contig_bin.tsv").read_text().splitlines()
    assert kept[0] == "contig\tbin" and (tmp_path / "bin_contamination.tsv").is_file()
    assert {p.name for p in (tmp_path / "detect_contamination_bins").iterdir() if p.suffix == ".fa"} == {f"{r.split(chr(9))[1]}.fa" for r in kept[1:]}
    run(spark, "include_contigs", *given, "--methylation_output_type", "weighted_mean")
    assert (tmp_path / "motifs-scored-read-methylation_weighted_mean.tsv").is_file() and (tmp_path / "motifs-scored-read-methylation_median.tsv").read_text() == first
    proposed = {(r["contig"], r["assigned_bin"]) for r in rows_of(tmp_path / "include_contigs.tsv")}
    assert ("bin3_contig_2", "bin3") in proposed and (tmp_path / "new_contig_bin.tsv").is_file()


def test_cached_tables_follow_their_inputs(spark, tmp_path):
    path, schema = str(tmp_path / "t.tsv"), "a string, b double"
    table = lambda x: lambda: spark.createDataFrame([("r", x)], schema)
    read = lambda x, inputs, **more: tables.cached_tsv(spark, path, schema, table(x), inputs, **more).first().b
    assert [read(1.0, {"k": 1}), read(2.0, {"k": 1}), read(3.0, {"k": 2}), read(4.0, {"k": 2}, force=True)] == [1.0, 1.0, 3.0, 4.0]
    assert json.loads((tmp_path / "t.tsv.inputs.json").read_text()) == {"k": 2}
    tables.write_tsv(spark.createDataFrame([], schema), str(tmp_path / "e.tsv"))
    assert (tmp_path / "e.tsv").read_text() == "a\tb\n"


def test_hits_and_windows_across_pieces(spark):
    seq = datasets.genome(700, 3)
    assembly = spark.createDataFrame([("c", seq), ("short", "GATC"), ("none", ""), ("odd", "GANTCNGATC"), ("null", None)], "contig string, seq string")
    motifs = [Motif.read("GATC", 1), Motif.read("A[CT].G", 0)]
    want = set()
    for name, s in (("c", seq), ("short", "GATC"), ("odd", "GANTCNGATC")):
        for m in motifs:
            for strand, x in (("+", m), ("-", m.reverse_complement())):
                for i in range(len(s) - len(x) + 1):
                    if all(t == 15 or "ACGT".find(b) >= 0 and 1 << "ACGT".find(b) & t for b, t in zip(s[i:], x.sets)):
                        want.add((name, m.text, strand, i + x.position))
    for size in (16, 4096):
        got = pileup.motif_hits(assembly, motifs, size).collect()
        assert {(r.contig, r.motif, r.strand, r.position) for r in got} == want and len(got) == len(want)
    at = spark.createDataFrame([("c", i, s) for i in range(-1, 702) for s in "+-"] + [("none", 0, "+")], "contig string, position long, strand string")
    flip = str.maketrans("ACGT", "TGCA")
    padded = "-" * 5 + seq + "-" * 5
    want = {(i, s): padded[i : i + 11] if s == "+" else padded[i : i + 11].translate(flip)[::-1] for i in range(700) for s in "+-"}
    assert {(r.position, r.strand): r.window for r in pileup.windows_around(at, assembly, 5, 32).collect()} == want
    assert {r.position for r in pileup.windows_at(at, assembly, 5).collect()} == set(range(6, 695))


def test_samples_and_matrices(spark):
    s = spark.createDataFrame([("c", datasets.genome(300, 1)), ("d", datasets.genome(80, 2))], "contig string, seq string")
    full = {r.contig: r.seq for r in s.collect()}
    drawn = pileup.sample_subsequences(s, 20, 5).collect()
    assert len(drawn) == 10 and all(len(r.seq) == 20 and r.seq in full[r.contig] for r in drawn)
    with pytest.raises(Exception, match="no 100 bases in d"):
        pileup.sample_subsequences(s, 100).collect()
    at = pileup.sample_at(s, "AC", 4, 3).collect()
    assert at and len({(r.contig, r.position) for r in at}) == len(at)
    assert all(r.seq == full[r.contig][r.position - 4 : r.position + 6] and r.seq[4:6] == "AC" for r in at)
    w = spark.createDataFrame([("k", "AC"), ("k", "AG")], "k string, window string")
    got = {(r.pos, r.base): r.frequency for r in pileup.position_matrix(w, ["k"], pseudocount=0.5).collect()}
    assert got == {(0, "A"): 1.25, (0, "C"): 0.25, (0, "G"): 0.25, (0, "T"): 0.25, (1, "A"): 0.25, (1, "C"): 0.75, (1, "G"): 0.75, (1, "T"): 0.25}


def test_small_functions(spark):
    df = spark.createDataFrame([("GATC", "b1_c_1", "b1"), ("GANC", "b1_contig_12", None)], "s string, n string, b string")
    got = df.select(
        seqfn.length_order(F.col("s"), F.lit("AA")).alias("o"), seqfn.begins_with(F.col("s"), "GA[TC]").alias("m"), seqfn.fits(F.col("s"), "GA.[CT]").alias("f"),
        seqfn.match_length(F.lit("A[CT]G[AG]T")).alias("l"), seqfn.contig_of(F.col("n"), F.col("b")).alias("c"), seqfn.bin_of(F.col("n")).alias("b"),
    ).collect()
    assert [tuple(r) for r in got] == [(1, True, True, 3, "c_1", None), (1, False, True, 3, "b1_contig_12", "b1")]
    assert df.agg(seqfn.equal_lengths(F.col("s")).alias("e")).first().e and df.limit(0).agg(seqfn.equal_lengths(F.col("s")).alias("e")).first().e
    m = stats.Model().update(90, 10)
    assert m.log_likelihood() == pytest.approx(m.alpha * float(__import__("math").log(m.mean())) + m.beta * float(__import__("math").log(1 - m.mean())))
    assert m.predictive_check(90, 10) == m.predictive_check(90, 10) > m.predictive_check(5, 95)
    parts = spark.createDataFrame([("c", "a", "GATC", 5), ("c", "a", "GATC", 1), ("c", "a", "GATC", 5)], "contig string, mod_type string, motif string, position long")
    assert tables.combine_positions(parts).first().positions == [1, 5]
