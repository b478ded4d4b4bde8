"""Plans and grouped operators on small fixtures."""

import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwork import cli
from strandwork.functions import seqfn
from strandwork.functions.motif import ANY, BASE_MASKS, Motif
from strandwork.operators import binning, cluster, discover, linker, neighbours, pileup, postprocess
from strandwork.sources import fasta, tables
from strandwork.sources import pileup as pileups

FRACTIONS = [0.8, 0.9, 0.1, 0.95, 0.85, 0.2, 0.75, 0.9, 0.05, 0.8]


def pileup_of(spark, rows):
    return spark.createDataFrame(rows, pileups.PILEUP_SCHEMA)


def test_adjacency(spark):
    one = pileup_of(spark, [("c", i, "a", "+", f, 10) for i, f in enumerate(FRACTIONS)])
    for stretch in (1 << 20, 3):
        got = pileup.without_neighbours(one, 0.7, 1, stretch)
        assert sorted(r.position for r in got.collect()) == [1, 2, 3, 5, 7, 8, 9] and got.columns == one.columns
    two = pileup_of(spark, [("c1", i, "am"[i % 2], "+", f, 10) for i, f in enumerate(FRACTIONS[:5])] + [("c2", i, "ma"[i % 2], "-", f, 10) for i, f in enumerate(FRACTIONS[5:])])
    got = pileup.without_neighbours(two, 0.7, 1).collect()
    assert sorted(r.position for r in got if r.contig == "c1") == [1, 2, 3] and sorted(r.position for r in got if r.contig == "c2") == [0, 2, 3, 4]


def test_coverage_and_frequency(spark):
    rows = pileup_of(spark, [("c", i, "a", "+", 0.9 if i < 60 else 0.1, i % 20) for i in range(200)] + [("d", i, "a", "+", 0.9, 9) for i in range(50)])
    assert pileup.covered(rows).where("Nvalid_cov <= 5").count() == 0
    assert {r.contig for r in pileup.often_modified(rows).collect()} == {"c"}


SEQ = "AATTAAATTAAGTAAAT"


@pytest.mark.parametrize("motif,want", [("AATT", [0, 5]), ("AA.T", [0, 4, 5, 9, 13])])
def test_overlapping_positions(spark, motif, want):
    r = spark.createDataFrame([(SEQ,)], "seq string").select(seqfn.positions(F.col("seq"), motif).alias("p"), seqfn.count_overlapping(F.col("seq"), motif).alias("n")).first()
    assert r.p == want and r.n == len(want)


def test_sequence_functions(spark):
    df = spark.createDataFrame([("A[GC].C", 2, "CNNNNGAT"), ("..A..", 2, "GATC"), ("...", 1, "ANNCNNT")], "m string, p int, i string")
    bare, at = seqfn.strip_motif(F.col("m"), F.col("p"))
    rows = df.select(bare.alias("b"), at.alias("a"), seqfn.regex_to_iupac(F.col("m")).alias("x"), seqfn.motif_type(F.col("i")).alias("t"), seqfn.iupac_to_regex(F.lit("RNB")).alias("r"), seqfn.reverse_complement(F.col("m")).alias("rc"), seqfn.trimmed_length(F.col("m")).alias("l")).collect()
    assert [tuple(r) for r in rows] == [
        ("A[GC].C", 2, "ASNC", "bipartite", "[AG].[CGT]", "G.[GC]T", 3),
        ("A", 0, "NNANN", "palindrome", "[AG].[CGT]", "..T..", 1),
        ("...", 1, "NNN", "ambiguous", "[AG].[CGT]", "...", 0),
    ]


@pytest.mark.parametrize("text,n,m,want", [("NNA", 1, 2, True), ("NNA", 2, 1, False), ("NNANN", 2, 2, True), ("NNANN", 3, 1, False), ("NaNNaNNNaNNNN", 4, 1, True), ("NaNNaNNNaNNNN", 3, 2, True), ("NaNNaNNNaNNNN", 3, 3, False), ("NaNNaNNNaNNNN", 2, 3, True), ("NaNNaNNNaNNNN", 2, 4, False)])
def test_runs(spark, text, n, m, want):
    assert spark.range(1).select(seqfn.has_run(F.lit(text), n, m, "N").alias("x")).first().x is want


def test_motif_counts_and_methylation(spark):
    assembly = spark.createDataFrame([("c", "TACGGACGCCACG")], "contig string, seq string")
    hits = pileup.motif_hits(assembly, [Motif.read("ACG", 0)])
    rows = pileup_of(spark, [("c", 1, "a", "+", 0.9, 10), ("c", 5, "a", "+", 0.8, 30), ("c", 10, "a", "+", 0.1, 20), ("c", 3, "a", "+", 0.9, 5)])
    r = pileup.motif_counts(rows, hits, ["contig"]).first()
    assert (r.n_mod, r.n_nomod, r.alpha, r.beta) == (2, 1, 7.0, 6.0)
    m = pileup.contig_methylation(rows, hits.withColumn("mod_type", F.lit("a"))).first()
    assert (m.methylation_value, m.n_motif_obs, m.mean_read_cov) == (0.8, 3, 20.0)
    w = pileup.contig_methylation(rows, hits.withColumn("mod_type", F.lit("a")), "weighted_mean").first()
    assert w.methylation_value == pytest.approx((9 + 24 + 2) / 60)
    with pytest.raises(ValueError):
        pileup.contig_methylation(rows, hits, "mean")


def test_readers(spark, tmp_path):
    raw = ["c\t5\t6\ta\t10\t+\t5\t6\t0,0,0\t12\t75.0\t9\t3\t0\t0\t0\t1\t0", "c\t7\t8\tm\t10\t-\t7\t8\t0,0,0\tNA\tnull\t9\t3\t0\t0\t0\t1\t0"]
    (tmp_path / "p.bed").write_text("\n".join(raw) + "\n")
    p = pileups.read_pileup(spark, str(tmp_path / "p.bed"))
    assert p.schema == pileups.PILEUP_SCHEMA
    assert [tuple(r) for r in p.orderBy("position").collect()] == [("c", 5, "a", "+", 0.75, 12), ("c", 7, "m", "-", None, None)]
    (tmp_path / "none.bed").write_text("")
    with pytest.raises(pileups.EmptyPileup):
        pileups.read_pileup(spark, str(tmp_path / "none.bed"))
    pileups.index_pileup(p, str(tmp_path / "index"))
    assert pileups.read_contigs(spark, str(tmp_path / "index"), ["c"]).count() == 2
    empty = pileups.read_contigs(spark, str(tmp_path / "index"), [])
    assert empty.count() == 0 and empty.schema == pileups.PILEUP_SCHEMA
    low = pileups.low_coverage(pileups.read_raw(spark, str(tmp_path / "p.bed")), spark.createDataFrame([("c_a",)], "contig_mod string"), 12)
    assert low.first().positions == [5]


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">c1 long name\nac\ngt\n>c2\nAAA\n>c1 long name\nTT\n")
    got = {r.contig: r.seq for r in fasta.read_fasta(spark, str(tmp_path / "a.fasta"), trim=" ").collect()}
    assert got == {"c1": "ACGTTT", "c2": "AAA"}
    assert {r.seq for r in fasta.read_fasta(spark, str(tmp_path / "a.fasta"), trim=" ", repeated="last").where("contig = 'c1'").collect()} == {"TT"}
    (tmp_path / "b.fastq").write_text("@c3 x\nACGT\n+\n@III\n")
    bins = fasta.contig_bins(spark, files=[str(tmp_path / "a.fasta"), str(tmp_path / "b.fastq")])
    assert {(r.contig, r.bin) for r in bins.collect()} == {("c1", "a"), ("c2", "a"), ("c3", "b")}
    assert {r.bin for r in fasta.contig_bins(spark, directory=str(tmp_path), extension="fastq").collect()} == {"b"}
    (tmp_path / "t.tsv").write_text("contig\tbin\nc1\tb1\n")
    assert [tuple(r) for r in fasta.contig_bins(spark, table=str(tmp_path / "t.tsv")).collect()] == [("c1", "b1")]
    with pytest.raises(ValueError):
        fasta.contig_bins(spark)
    with pytest.raises(FileNotFoundError):
        fasta.checked_assembly(spark, str(tmp_path / "none.fasta"))
    assembly = spark.createDataFrame([("c1", "ACGT"), ("c2", "A")], "contig string, seq string")
    new = spark.createDataFrame([("c1", "x"), ("c2", "x"), ("c9", "x"), ("c2", "y")], "contig string, bin string")
    fasta.write_bins(new, assembly, str(tmp_path / "bins"))
    assert (tmp_path / "bins" / "x.fa").read_text() == ">c1\nACGT\n>c2\nA\n" and sorted(f.name for f in (tmp_path / "bins").iterdir() if f.suffix == ".fa") == ["x.fa", "y.fa"]
    long = fasta.split_sequences(spark.createDataFrame([("c", "ACGT" * 10)], "contig string, seq string"), 16, 4).orderBy("offset").collect()
    assert [r.offset for r in long] == [0, 16, 32] and long[0].seq == "ACGT" * 5


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([("b", "GATC", 1)], "bin string, motif string, mod_position int")
    assert tables.require(df, {"reference": "string", "mod_position": "long"}).columns == ["reference", "mod_position", "motif"]
    with pytest.raises(ValueError):
        tables.require(df, {"score": "double"})
    tables.write_tsv(df, str(tmp_path / "t"))
    with pytest.raises(ValueError):
        tables.read_contamination(spark, str(tmp_path / "t"))
    calls = []
    for force in (False, False, True):
        tables.cached(spark, str(tmp_path / "c"), lambda: calls.append(1) or df, force)
    assert len(calls) == 2
    tables.write_graph([{"id": "..A.", "score": 1.5, "visited": True, "model": object()}, {"id": "GA", "score": 2}], [("..A.", "GA")], str(tmp_path / "g.gml"))
    assert 'label "A"' in (tmp_path / "g.gml").read_text() and "model" not in (tmp_path / "g.gml").read_text()


def motif_rows(spark, names, positions=None):
    return spark.createDataFrame([("b1", "m", x, (positions or [1] * len(names))[i], 10 + i) for i, x in enumerate(names)], "reference string, mod_type string, motif_iupac string, mod_position int, n_mod int")


@pytest.mark.parametrize("names,rows,paired", [(["AAGGTT", "AACCTT"], 1, 1), (["GATCC", "GATCG"], 2, 0), (["GCGC", "GATC"], 2, 2), (["GCGC", "GCGC"], 4, 4)])
def test_complements(spark, names, rows, paired):
    got = postprocess.join_complements(motif_rows(spark, names)).collect()
    assert len(got) == rows and sum(r.motif_iupac_complement is not None for r in got) == paired


def test_noise_and_sub_motifs(spark):
    df = spark.createDataFrame([("b1", "A....GATC", 0), ("b1", "GATC", 1), ("b2", "A.....GATC", 0)], "reference string, motif string, mod_position int")
    assert {(r.reference, r.motif) for r in postprocess.without_noise(df, ["reference"]).collect()} == {("b1", "GATC"), ("b2", "A.....GATC")}
    sets = spark.createDataFrame([("b", "GATC", 1, 905.0, 15.0), ("b", "GATCC", 1, 405.0, 10.0), ("c", "GA", 1, 105.0, 900.0), ("c", "GATC", 1, 95.0, 6.0)], "reference string, motif string, mod_position int, alpha double, beta double")
    assert {(r.reference, r.motif) for r in postprocess.without_sub_motifs(sets, ["reference"]).collect()} == {("b", "GATC"), ("c", "GATC")}
    assert {r.motif for r in postprocess.without_children(sets, ["reference"]).collect()} == {"GATC", "GA"}


def test_imputation(spark):
    rows = spark.createDataFrame([("c1", 0.9, 10, "m1", "b1"), ("c1", 0.5, 10, "m2", "b1"), ("c2", 0.6, 30, "m1", "b1"), ("c3", 0.1, 5, "m1", "b2"), ("c4", 0.2, 5, "m3", "b2")], "contig string, methylation_value double, n_motif_obs int, motif_mod string, bin string")
    got = {(r.contig, r.motif_mod): r.methylation_value for r in binning.impute_in_bins(rows).collect()}
    assert got == {("c1", "m1"): 0.9, ("c1", "m2"): 0.5, ("c2", "m1"): 0.6, ("c2", "m2"): 0.5, ("c3", "m1"): 0.1, ("c3", "m3"): 0.2, ("c4", "m1"): 0.1, ("c4", "m3"): 0.2}
    free = binning.impute_unbinned(rows.withColumn("bin", F.when(F.col("bin") == "b2", "unbinned").otherwise(F.col("bin")))).collect()
    assert len(free) == 6 and all(0 <= r.methylation_value < 0.15 or (r.contig, r.motif_mod) in (("c3", "m1"), ("c4", "m3")) for r in free)
    with pytest.raises(Exception, match="occur twice"):
        binning.matrix(rows.union(rows)).collect()


def profile(spark):
    """Twelve contigs of three bins with a motif each; contig_3 looks like bin2's."""
    rng = random.Random(1)
    rows = []
    for i in range(1, 13):
        b = (i - 1) // 4 + 1
        own = 2 if i == 3 else b
        rows += [(f"contig_{i}", f"m{k}", "a", 1, (0.9 if k == own else 0.03) + rng.random() * 0.02, 30.0, 50) for k in (1, 2, 3)]
    methylation = spark.createDataFrame(rows, "contig string, motif string, mod_type string, mod_position int, methylation_value double, mean_read_cov double, n_motif_obs int")
    bins = spark.createDataFrame([(f"contig_{i}", f"bin{(i - 1) // 4 + 1}") for i in range(1, 13)], "contig string, bin string")
    lengths = spark.createDataFrame([(f"contig_{i}", 1000 if i == 3 else 50_000) for i in range(1, 13)], "contig string, length long")
    return methylation, bins, lengths


def test_contamination_and_inclusion(spark):
    methylation, bins, lengths = profile(spark)
    found = binning.detect_contamination(methylation, bins, lengths, neighbours=4)
    rows = found.collect()
    assert len(rows) == 4 and {r.contig for r in rows} == {"contig_3"}
    found = spark.createDataFrame(rows, found.schema)  # as the command line does: read back, not made again
    placed = binning.include_contigs(methylation, bins, found, 0.5).collect()
    assert {(r.contig, r.assigned_bin) for r in placed} == {("contig_3", "bin2")} and len(placed) == 3
    new = binning.new_contig_bins(bins, found, spark.createDataFrame(placed))
    assert dict((r.contig, r.bin) for r in new.collect()).get("contig_3") == ("bin2" if placed[0].confidence == "high_confidence" else None)


def test_clusterers():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(c, 0.1, (15, 3)) for c in (0, 3, 6)])
    truth = np.repeat([0, 1, 2], 15)
    same = lambda a, b: len(set(zip(a.tolist(), b.tolist()))) == 3
    assert same(cluster.ward(x, 3), truth) and same(cluster.spectral(x, 3), truth) and same(cluster.gaussian_mixture(x, 3), truth)
    found = cluster.density(x)
    assert all(len(set(truth[found == k])) == 1 for k in set(found) - {-1})
    for f in (cluster.nearest, cluster.discriminant):
        assert (f(x, truth, x)[0] == truth).all()


def test_clusterers_of_many_rows():
    rng = np.random.default_rng(4)
    truth = rng.integers(0, 3, 2500)
    x = rng.normal(size=(2500, 2)) * 0.1 + truth[:, None] * 3
    same = lambda a: len(set(zip(a.tolist(), truth.tolist()))) == 3
    tracemalloc.start()
    assert same(cluster.ward(x, 3)) and same(cluster.spectral(x, 3)) and (cluster.density(x) >= -1).all()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 110e6  # one matrix of distances has 50 MB; several were held
    small = x[:300]
    assert (cluster.spectral(small, 7, dense=0) == cluster.spectral(small, 7)).mean() > 0.9
    steps = np.cumsum(np.ravel([(0.5, 2 + i) for i in range(1500)]))
    assert len(cluster.density(steps[:, None])) == 3000  # pairs that join one after the other: splits 1,500 deep


def test_nearest_in_blocks():
    rng = np.random.default_rng(3)
    train = np.repeat(rng.normal(size=(1000, 4)), 4, axis=0)  # copies: the first ones count
    y = np.tile([0, 1, 1, 2], 1000)
    tracemalloc.start()
    found, share = cluster.nearest(train, y, train[::2])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (found == 1).all() and np.allclose(share, 2 / 3) and peak < 100e6


def test_linker(spark):
    hits = spark.createDataFrame(
        [(0, "c_1", "c", "RM_Type_II__Type_II_MTases", 10.0), (1, "c_1", "c", "RM__Type_I_MTases", 20.0), (2, "c_2", "c", "RM_Type_IIG__Type_IIG", 5.0), (3, "c_3", "c", "RM_Type_II__Type_II_MTases", 5.0), (4, "c_4", "c", "Cas9", 5.0), (5, "c_5", "c", "RM_Type_II__Type_II_MTases", 5.0)],
        "row_no long, hit_id string, replicon string, gene_name string, hit_score double",
    )
    systems = spark.createDataFrame([(0, "s1", "RM", "c_1,c_9"), (1, "s2", "Gabija", "c_3"), (2, "s3", "RM", "c_1")], "row_no long, sys_id string, type string, protein_in_syst string")
    got = {r.hit_id: r for r in linker.methyltransferases(hits, systems).collect()}
    assert set(got) == {"c_1", "c_5"} and got["c_1"].sub_type == "Type_I" and got["c_1"].sys_id == "s1" and got["c_5"].RM_system is False
    genes = spark.createDataFrame(
        [(0, "r", "g0", "ac", "s1", "palindrome", "GATC"), (1, "r", "g1", "ac", "s1", "bipartite", None), (2, "r", "g2", None, None, "non-palindrome", None), (3, "q", "g3", "m", None, "palindrome", None), (4, "q", "g4", "m", None, "palindrome", None)],
        "gene_row long, reference string, gene_id string, mod_type string, sys_id string, motif_type string, motif_guess string",
    )
    motifs = spark.createDataFrame(
        [(0, "r", "GATC", "ac", "palindrome"), (1, "r", "GAAGAC", "ac", "non-palindrome"), (2, "q", "CCWGG", "m", "palindrome"), (3, "z", "GATC", "m", "palindrome")],
        "motif_row long, reference string, motif string, assign_mod_type string, motif_type string",
    )
    out_genes, out_motifs = linker.assign(genes, motifs)
    g = {r.gene_id: (r.linked, r.detected_motif) for r in out_genes.collect()}
    m = {r.motif_row: (r.linked, r.candidate_genes) for r in out_motifs.collect()}
    assert g == {"g0": (True, "GATC"), "g1": (True, "GATC"), "g2": (True, "GAAGAC"), "g3": (False, None), "g4": (False, None)}
    assert m == {0: (True, "g0, g1"), 1: (True, "g2"), 2: (False, "g3, g4"), 3: (False, None)}


def test_placed_match_leads(spark):
    genes = spark.createDataFrame(
        [(0, "r", "g0", "ac", None, "palindrome", "GATC"), (1, "r", "g1", "ac", "s1", "palindrome", "GATC"), (2, "r", "g2", "ac", "s1", "bipartite", None)],
        "gene_row long, reference string, gene_id string, mod_type string, sys_id string, motif_type string, motif_guess string",
    )
    motifs = spark.createDataFrame([(0, "r", "GATC", "ac", "palindrome")], "motif_row long, reference string, motif string, assign_mod_type string, motif_type string")
    assert linker.assign(genes, motifs)[1].first().candidate_genes == "g0, g1"
    assert linker.assign(genes, motifs, placed_lead=True)[1].first().candidate_genes == "g0, g1, g2"


def test_nearest_rows(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 7)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 4)).round(3)
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(60)] + [(99, None)], "id long, v array<double>").repartition(5)
    got = sorted((r.query_id, r["rank"], r.id) for r in neighbours.nearest_rows(df.where("id % 3 = 0"), df, "id", "v", 3).collect())
    want = []
    for i in range(0, 60, 3):
        d = np.sqrt(((x - x[i]) ** 2).sum(1)).round(6)
        want += [(i, k + 1, j) for k, j in enumerate(sorted((j for j in range(60) if j != i), key=lambda j: (d[j], j))[:3])]
    assert got == sorted(want)


def test_discovery_finds_planted_motifs(spark):
    rng = random.Random(7)
    seq = "".join(rng.choice("ACGT") for _ in range(60_000))
    rows = []
    for strand in "+-":
        s = seq if strand == "+" else Motif.read(seq, 0).reverse_complement().text
        sites = {i + 1 for i in range(len(s) - 3) if s.startswith("GATC", i)} | {i + 3 for i in range(len(s) - 6) if s.startswith("CCGA", i) and s[i + 6 : i + 7] == "G"}
        for i, b in enumerate(s):
            if b == "A":
                rows.append(("c1", i if strand == "+" else len(s) - 1 - i, "a", strand, 0.95 if i in sites else 0.02, 30))
    assembly = spark.createDataFrame([("c1", seq)], "contig string, seq string")
    bins = spark.createDataFrame([("c1", "b1")], "contig string, bin string")
    found = {(r.motif, r.mod_position): r for r in discover.discover_motifs(pileup_of(spark, rows), assembly, bins).collect()}
    assert set(found) == {("GATC", 1), ("CCGANNG", 3)}
    assert found["GATC", 1].motif_complement == "GATC" and found["GATC", 1].n_nomod == 0
    with pytest.raises(ValueError):
        discover.Settings(low=0.8, high=0.7)


def test_windows_as_bits(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ACGT-" if i % 3 else "ACGTN") for _ in range(5)) for i in range(1003)]
    codes = np.array([[BASE_MASKS[ord(c)] for c in t] for t in texts])
    for some in (slice(0, 1003), slice(1, 3), slice(4, 6)):
        rows = discover.packed(spark.createDataFrame([("b", "a", t, 1) for t in texts[some]], "bin string, mod_type string, window string, state int"), 2).collect()
        w = discover.Windows(5)
        for r in rows:
            w.add(r.n, bytes(r.bits))
        w.close()
        assert sum(len(r.bits) for r in rows) <= 5 * 4 * (sum(r.n for r in rows) // 8 + len(rows))  # a window was 41 characters and an object
        m, own = Motif.read("G[AC]", 0), codes[some]
        fit = ((own[:, 1] & m.sets[0]) != 0) & ((own[:, 2] & m.sets[1]) != 0)
        chosen = w.fits((ANY, *m.sets, ANY, ANY), w.all)
        assert discover.count(w.all) == len(own) and discover.count(chosen) == fit.sum() and discover.count(w.complete()) == (own != 0).all(1).sum()
        want = [(own[fit] == a).sum(0) / max(fit.sum(), 1) for a in discover._AXES]
        assert np.allclose(w.frequencies(chosen), want)


def test_cli(spark, tmp_path):
    args = cli.parser().parse_args(["motif_discovery", "a.fa", "p.bed", "--contig_bin", "b.tsv", "--out", "o", "--min_motif_score", "2"])
    assert args.min_motif_score == 2 and args.threshold_valid_coverage == 5
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["motif_discovery", "a.fa"])
    args = cli.parser().parse_args(["check_installation", "--out", str(tmp_path / "o")])
    cli.setup(args)
    assert "GATC" in {r.motif for r in cli.check_installation(spark, args).collect()} and (tmp_path / "o" / "args.json").exists()
