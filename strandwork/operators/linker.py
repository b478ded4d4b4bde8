"""Links motifs to methyltransferase genes: hit selection, significance, typing and three rounds of assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.seqfn import reverse_complement

#: Part of an HMM's name to its subtype, in the order of the tests.
SUBTYPES = [
    ("RM__Type_I_MTases", "Type_I"),
    ("RM_Type_II__Type_II_MTases", "Type_II"),
    ("RM_Type_IIG__Type_IIG", "Type_IIG"),
    ("RM_Type_III__Type_III_MTases", "Type_III"),
]
#: The motif types that a subtype's genes make.
MOTIF_TYPES = {"Type_I": "bipartite", "Type_II": "palindrome", "Type_III": "non-palindrome", "Type_IIG": "bipartite, non-palindrome"}
#: Families by their accession without version.
AC_FAMILIES = ["PF01555", "PF02384", "PF12161", "PF05869", "PF02086", "PF07669", "PF13651"]
M_FAMILIES = ["PF00145"]
RM_SYSTEMS = ["RM", "MADS", "BREX"]


def subtype(name: Column) -> Column:
    out = F.lit("undefined")
    for part, value in reversed(SUBTYPES):
        out = F.when(name.contains(part), value).otherwise(out)
    return out


def motif_types_of(sub_type: Column) -> Column:
    out = F.lit("undefined")
    for key, value in MOTIF_TYPES.items():
        out = F.when(sub_type == key, value).otherwise(out)
    return out


def family_mod_type(accession: Column) -> Column:
    family = F.substring_index(accession, ".", 1)
    return F.when(family.isin(AC_FAMILIES), "ac").when(family.isin(M_FAMILIES), "m")


def recoded(mod_type: Column) -> Column:
    return F.when(mod_type.isin("a", "21839"), "ac").otherwise(mod_type)


def best_per_key(df: DataFrame, key: str, score: str, row: str) -> DataFrame:
    """The row of the highest score for each key, the first by ``row`` at a tie, by a combined maximum rather than a sort."""
    best = df.groupBy(key).agg(F.max_by(row, F.struct(F.col(score), -F.col(row))).alias(row))
    return df.join(best, [key, row], "left_semi")


def first_system(hits: DataFrame, systems: DataFrame, kind: list[str] | None = None) -> DataFrame:
    """(hit_id, sys_id): the first system, by row_no, whose comma-separated members have the hit."""
    chosen = systems if kind is None else systems.where(F.col("type").isin(kind))
    members = chosen.select("sys_id", "row_no", F.explode(F.split("protein_in_syst", ",")).alias("hit_id"))
    first = members.groupBy("hit_id").agg(F.min_by("sys_id", "row_no").alias("sys_id"))
    return hits.select("hit_id").distinct().join(first, "hit_id")


def methyltransferases(hmm_hits: DataFrame, systems: DataFrame) -> DataFrame:
    """Best restriction-modification hit of each gene, if it is a methyltransferase: with sub_type, RM_system and sys_id.

    Genes of a system of another kind only are left out; Type IIG genes must be in an RM-like system.
    ``hmm_hits`` and ``systems`` have row_no, their order in the file.
    """
    rm = best_per_key(hmm_hits.where(F.col("gene_name").contains("_Type_")), "hit_id", "hit_score", "row_no")
    genes = rm.where(F.col("gene_name").contains("MTases") | F.col("gene_name").contains("Type_IIG"))
    anywhere = first_system(genes, systems).select("hit_id", F.lit(True).alias("_any"))
    own = first_system(genes, systems, RM_SYSTEMS)
    out = genes.join(anywhere, "hit_id", "left").join(own, "hit_id", "left").withColumn("RM_system", F.col("sys_id").isNotNull())
    out = out.where(F.col("_any").isNull() | F.col("RM_system")).where(~F.col("gene_name").contains("Type_IIG") | F.col("RM_system"))
    return out.drop("_any").withColumn("sub_type", subtype(F.col("gene_name")))


def significant_hits(blast: DataFrame, identity: float = 80, coverage: float = 80) -> DataFrame:
    """The best hit of each query by bitscore among those of enough identity and coverage, with enzyme and motif from the title."""
    title = F.split("salltitles", " {3}")
    name, motif = F.try_element_at(title, F.lit(1)), F.try_element_at(F.split(F.try_element_at(title, F.lit(2)), " {2}"), F.lit(1))
    good = blast.where((F.col("pident") >= identity) & (F.col("qcovs") >= coverage))
    return best_per_key(good, "qseqid", "bitscore", "row_no").withColumn("REbase_id", name).withColumn("motif", motif)


def gene_mod_types(families: DataFrame) -> DataFrame:
    """(gene_id, mod_types, mod_type): the distinct types of a gene's families, sorted and joined; m outweighs ac."""
    types = F.collect_set(family_mod_type(F.col("HMM_acc")))
    out = families.groupBy("gene_id").agg(F.array_join(F.array_sort(types), ", ").alias("mod_types"), F.max(family_mod_type(F.col("HMM_acc"))).alias("mod_type"))
    return out.where("mod_type is not null")


def with_pseudo_entries(genes: DataFrame) -> DataFrame:
    """Genes, and for each without mod_type one entry as ac and one as m, under the same row id."""
    extra = genes.where("mod_type is null").drop("mod_type").withColumn("mod_type", F.explode(F.array(F.lit("ac"), F.lit("m"))))
    return genes.unionByName(extra)


def assign(genes: DataFrame, motifs: DataFrame, placed_lead: bool = False) -> tuple[DataFrame, DataFrame]:
    """(genes with linked and detected_motif, motifs with linked and candidate_genes).

    ``genes``: gene_row, reference, gene_id, mod_type, sys_id, motif_type, motif_guess (pseudo-entries are made
    here). ``motifs``: motif_row, reference, motif, assign_mod_type, motif_type. Round 1 takes a guess that
    equals the motif or its reverse complement, and all genes of the first match's system; with ``placed_lead``
    of the first match that has a system. Round 2 takes motif types that are single on both sides of a
    (reference, mod type). Round 3 does so again and lists all candidates. What a round links is out of the
    next ones.
    """
    entries = with_pseudo_entries(genes)
    on = (F.col("g.reference") == F.col("m.reference")) & (F.col("g.mod_type") == F.col("m.assign_mod_type"))
    forms = motifs.select("*", F.explode(F.array(F.struct(F.lit(0).alias("form"), F.col("motif").alias("as")), F.struct(F.lit(1).alias("form"), reverse_complement(F.col("motif")).alias("as")))).alias("f"))
    forms = forms.select("*", "f.form", "f.as").drop("f")
    g, m = entries.alias("g"), forms.alias("m")
    direct = g.join(m, on & (F.col("g.motif_guess") == F.col("m.as"))).select("g.gene_row", "g.gene_id", "g.sys_id", "g.reference", "g.mod_type", "m.motif_row", "m.form", "m.as")
    place = F.when(F.col("sys_id").isNotNull(), F.col("gene_row")) if placed_lead else F.col("gene_row")  # rows of null order don't count
    lead = direct.groupBy("motif_row", "form", "as", "reference", "mod_type").agg(F.min_by("sys_id", place).alias("sys_id"))
    family = entries.alias("e").join(
        lead.alias("l"), (F.col("e.reference") == F.col("l.reference")) & (F.col("e.mod_type") == F.col("l.mod_type")) & (F.col("e.sys_id") == F.col("l.sys_id"))
    ).select("e.gene_row", "e.gene_id", "l.motif_row", "l.form", "l.as")
    first = direct.select("gene_row", "gene_id", "motif_row", "form", "as").union(family).distinct()
    gene_links = first.groupBy("gene_row").agg(F.max_by("as", F.struct("motif_row", "form")).alias("detected_motif"))
    listed = lambda rows: F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(rows)), lambda x: x["gene_id"])), ", ")
    per_form = first.groupBy("motif_row", "form").agg(listed(F.struct("gene_row", "gene_id")).alias("candidate_genes"))
    motif_links = per_form.groupBy("motif_row").agg(F.max_by("candidate_genes", "form").alias("candidate_genes"))
    for final in (False, True):
        open_entries = entries.join(gene_links, "gene_row", "left_anti")
        open_motifs = motifs.join(motif_links.select("motif_row"), "motif_row", "left_anti")
        new_genes, new_motifs, candidates = _single_types(open_entries, open_motifs)
        gene_links = gene_links.unionByName(new_genes)
        motif_links = motif_links.unionByName(new_motifs)
        if final:
            rest = candidates.join(motif_links, "motif_row", "left_anti")
    out_genes = genes.join(gene_links, "gene_row", "left").withColumn("linked", F.col("detected_motif").isNotNull())
    linked = motif_links.withColumn("linked", F.lit(True)).unionByName(rest.withColumn("linked", F.lit(False)))
    out_motifs = motifs.join(linked, "motif_row", "left").withColumn("linked", F.coalesce("linked", F.lit(False)))
    return out_genes, out_motifs


def _single_types(entries: DataFrame, motifs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(gene links, motif links, all candidates) of motif types that are single among the group's motifs and genes."""
    counted = motifs.withColumn("n_motifs", F.count("*").over(Window.partitionBy("reference", "assign_mod_type", "motif_type")))
    e, m = entries.withColumnRenamed("motif_type", "gene_types").alias("e"), counted.alias("m")
    pairs = e.join(m, (F.col("e.reference") == F.col("m.reference")) & (F.col("e.mod_type") == F.col("m.assign_mod_type")))
    pairs = pairs.select("m.motif_row", "m.motif", "m.motif_type", "m.n_motifs", "e.gene_row", "e.gene_id", "e.sys_id", "e.gene_types")
    fits = pairs.where(F.array_contains(F.split("gene_types", ", "), F.col("motif_type")))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("gene_row", "gene_id"))), lambda x: x["gene_id"]), ", ")
    group = fits.groupBy("motif_row", "motif", "motif_type", "n_motifs").agg(
        listed.alias("candidate_genes"), F.count("*").alias("n"), F.countDistinct("sys_id").alias("systems"), F.count("sys_id").alias("placed")
    )
    one_gene = ((F.col("systems") == 1) & (F.col("placed") == F.col("n"))) | (F.col("n") == 1)
    single = group.where(one_gene & (F.col("n_motifs") == 1))
    exact = (F.col("gene_types") == F.col("motif_type")) | (F.col("motif_type").isin("non-palindrome", "bipartite") & (F.col("gene_types") == "bipartite, non-palindrome"))
    linked = fits.where(exact).join(single.select("motif_row"), "motif_row", "left_semi")
    return (
        linked.groupBy("gene_row").agg(F.max_by("motif", "motif_row").alias("detected_motif")),
        single.select("motif_row", "candidate_genes"),
        group.select("motif_row", "candidate_genes"),
    )


def link_motifs(hmm_genes: DataFrame, hits: DataFrame, families: DataFrame, contig_bins: DataFrame, motifs: DataFrame, least_methylation: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """The two result tables: genes with their predicted and detected motifs, motifs with their candidate genes."""
    guess = hits.select(F.col("qseqid").alias("gene_id"), F.col("REbase_id").alias("REbase_ID"), F.col("motif").alias("motif_guess"))
    genes = hmm_genes.select(F.col("hit_id").alias("gene_id"), F.col("replicon").alias("contig"), "sub_type", "RM_system", "sys_id", F.col("row_no").alias("gene_row"))
    genes = genes.join(guess, "gene_id", "left").join(contig_bins.select("contig", F.col("bin").alias("reference")), "contig")
    genes = genes.join(families.select("gene_id", "mod_type"), "gene_id", "left").withColumn("motif_type", motif_types_of(F.col("sub_type")))
    kept = motifs.where(F.col("n_mod") / (F.col("n_mod") + F.col("n_nomod")) >= least_methylation).withColumn("assign_mod_type", recoded(F.col("mod_type")))
    out_genes, out_motifs = assign(genes, kept)
    out_genes = out_genes.select(
        "reference", "gene_id", "contig", F.col("mod_type").alias("mod_type_pred"), F.col("sub_type").alias("sub_type_pred"), "RM_system",
        F.col("sys_id").alias("DF_system_ID"), F.col("motif_type").alias("motif_type_pred"), "REbase_ID", F.col("motif_guess").alias("motif_pred"), "linked", "detected_motif",
    )
    return out_genes, out_motifs.drop("assign_mod_type", "motif_row")
