"""Contamination and inclusion: imputation, methylation matrices, votes and confidence tiers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.seqfn import motif_mod
from . import cluster


def add_bin(methylation: DataFrame, contig_bins: DataFrame) -> DataFrame:
    """contig, methylation_value, n_motif_obs, motif_mod, bin; contigs of no bin are ``unbinned``."""
    out = methylation.select("contig", "methylation_value", "n_motif_obs", motif_mod(F.col("motif"), F.col("mod_type"), F.col("mod_position")).alias("motif_mod"))
    return out.join(contig_bins.select("contig", "bin"), "contig", "left").withColumn("bin", F.coalesce("bin", F.lit("unbinned")))


def impute_in_bins(rows: DataFrame) -> DataFrame:
    """bin, contig, motif_mod, methylation_value: a contig's missing motifs of its bin get the bin's weighted mean."""
    means = rows.groupBy("bin", "motif_mod").agg((F.sum(F.col("methylation_value") * F.col("n_motif_obs")) / F.sum("n_motif_obs")).alias("mean"))
    grid = rows.select("bin", "contig").distinct().join(means, "bin")
    out = grid.join(rows.select("bin", "contig", "motif_mod", "methylation_value"), ["bin", "contig", "motif_mod"], "left")
    return out.select("bin", "contig", "motif_mod", F.coalesce("methylation_value", "mean").alias("methylation_value"))


def small_noise(*columns: str, high: float = 0.15, seed: int = 1):
    """A value in [0, high) that hangs on the row's keys only."""
    return F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(1 << 20)) / F.lit(float(1 << 20)) * high


def impute_unbinned(rows: DataFrame, motif_mods: DataFrame | None = None, noise=None) -> DataFrame:
    """bin, contig, motif_mod, methylation_value of unbinned contigs for all motifs; missing ones get a low value.

    The grid is contigs by motifs, which is the feature matrix itself.
    """
    free = rows.where(F.col("bin") == "unbinned")
    motifs = (rows if motif_mods is None else motif_mods).select("motif_mod").distinct()
    contigs = free.select("bin", "contig").distinct().join(motifs)
    out = contigs.join(free.select("contig", "motif_mod", "methylation_value"), ["contig", "motif_mod"], "left")
    value = small_noise("contig", "motif_mod") if noise is None else noise
    return out.select("bin", "contig", "motif_mod", F.coalesce("methylation_value", value).alias("methylation_value"))


def matrix(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """contig by motif_mod in order of the names, missing values 0; the job fails if a cell has two rows."""
    names = columns or sorted(r[0] for r in rows.select("motif_mod").distinct().collect())  # one per motif
    twice = F.raise_error(F.lit("a contig and motif occur twice")).cast("double")
    one = F.when(F.count(F.lit(1)) > 1, twice).otherwise(F.first("methylation_value"))
    return rows.groupBy("contig").pivot("motif_mod", names).agg(one).na.fill(0.0)


def several_contigs(rows: DataFrame) -> DataFrame:
    """Without bins of a single contig."""
    single = rows.groupBy("bin").agg(F.countDistinct("contig").alias("n")).where("n = 1")
    return rows.join(single, "bin", "left_anti")


def cluster_labels(wide: DataFrame, n_clusters: int, neighbours: int = 10) -> DataFrame:
    """contig, method, cluster of four clusterings of the matrix's leading components.

    The matrix is one assembly's contigs by its motifs: one grouped-map call on one key.
    """
    names = sorted(c for c in wide.columns if c != "contig")

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("contig")
        x, _, _ = cluster.pca(pdf[names].to_numpy(float))
        k = min(n_clusters, len(x))
        found = {"spectral": cluster.spectral(x, k, neighbours), "agglomerative": cluster.ward(x, k), "density": cluster.density(x), "mixture": cluster.gaussian_mixture(x, k)}
        return pd.concat([pd.DataFrame({"contig": pdf["contig"], "method": m, "cluster": c.astype(np.int64)}) for m, c in found.items()])

    return wide.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(label, "contig string, method string, cluster long")


def consensus(labels: DataFrame, contig_bins: DataFrame, lengths: DataFrame, votes: int = 4, main_share: float = 0.85) -> DataFrame:
    """All label rows of contigs that ``votes`` methods place outside their bin's main cluster.

    The main cluster of a bin has the most bases, and at least ``main_share`` of the bin's; bins without
    one have no say; tied ones all count.
    """
    rows = labels.join(contig_bins.select("contig", "bin"), "contig").join(lengths, "contig")
    bins = rows.dropDuplicates(["bin", "contig"]).groupBy("bin").agg(F.sum("length").alias("bin_length"), F.count("*").alias("n_contigs_bin"))
    parts = rows.groupBy("bin", "method", "cluster").agg(F.sum("length").alias("cluster_length"), F.count("*").alias("n_contigs")).join(bins, "bin")
    parts = parts.withColumn("fraction_contigs", F.col("n_contigs") / F.col("n_contigs_bin")).withColumn("fraction_length", F.col("cluster_length") / F.col("bin_length"))
    first = F.rank().over(Window.partitionBy("bin", "method").orderBy(F.desc("cluster_length")))
    main = parts.withColumn("_r", first).where((F.col("_r") == 1) & (F.col("fraction_length") >= main_share))
    main = main.select("bin", "method", F.col("cluster").alias("bin_cluster"), "bin_length", "n_contigs_bin", "fraction_contigs", "fraction_length")
    judged = rows.select("contig", "bin", "method", "cluster").join(main, ["bin", "method"])
    out_of = judged.groupBy("contig").agg(F.count_if(F.col("cluster") != F.col("bin_cluster")).alias("n")).where(F.col("n") >= votes)
    columns = ["contig", "bin", "method", "cluster", "bin_cluster", "bin_length", "n_contigs_bin", "fraction_contigs", "fraction_length"]
    return judged.join(out_of.select("contig"), "contig", "left_semi").select(*columns)


def detect_contamination(methylation: DataFrame, contig_bins: DataFrame, lengths: DataFrame, votes: int = 4, neighbours: int = 10) -> DataFrame:
    rows = add_bin(methylation, contig_bins).persist()
    rows = several_contigs(impute_in_bins(rows.where("bin <> 'unbinned'")))
    n_bins = rows.select("bin").distinct().count()
    return consensus(cluster_labels(matrix(rows), n_bins, neighbours), contig_bins, lengths, votes)


def classifier_labels(binned: DataFrame, free: DataFrame, trees: int = 100, seed: int = 42) -> DataFrame:
    """contig, method, assigned_bin, prob of three classifiers, fitted on binned contigs' leading components.

    ``binned``: contig, bin, the matrix's columns; ``free``: contig, the same columns. The forest is
    MLlib's; the two others are closed forms over the training matrix.
    """
    names = sorted(c for c in binned.columns if c not in ("contig", "bin"))
    train = binned.orderBy("contig").toPandas()  # one assembly's binned contigs by its motifs
    binned = binned.sparkSession.createDataFrame(train)  # made once: the forest reads it many times
    scores, mean, axes = cluster.pca(train[names].to_numpy(float))
    y = train["bin"].to_numpy(str)

    def judge(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x = (pdf[names].to_numpy(float) - mean) @ axes.T
            for method, (c, p) in {"neighbours": cluster.nearest(scores, y, x), "discriminant": cluster.discriminant(scores, y, x)}.items():
                yield pd.DataFrame({"contig": pdf["contig"], "method": method, "assigned_bin": c.astype(object), "prob": p})

    project = lambda df: df.select("contig", *(["bin"] if "bin" in df.columns else []), array_to_vector(F.array(*(sum(((F.col(f"`{n}`") - float(mean[j])) * float(a[j]) for j, n in enumerate(names)), F.lit(0.0)) for a in axes))).alias("features"))
    index = StringIndexer(inputCol="bin", outputCol="label", stringOrderType="alphabetAsc").fit(binned)
    forest = RandomForestClassifier(numTrees=trees, seed=seed, maxDepth=15).fit(index.transform(project(binned)))
    out = forest.transform(project(free)).withColumn("p", vector_to_array("probability"))
    bins = F.array(*map(F.lit, index.labels))
    forest_rows = out.select("contig", F.lit("forest").alias("method"), F.get(bins, F.col("prediction").cast("int")).alias("assigned_bin"), F.array_max("p").alias("prob"))
    return free.mapInPandas(judge, "contig string, method string, assigned_bin string, prob double").unionByName(forest_rows)


def confidence(assigned: DataFrame, mean_probability: float = 0.8) -> DataFrame:
    """contig, assigned_bin, method, prob, mean_prob, confidence.

    One bin from all methods: high if the mean probability reaches the bound, else medium. Two bins: low,
    the majority's rows. Three: left out.
    """
    contig, own = Window.partitionBy("contig"), Window.partitionBy("contig", "assigned_bin")  # not joins: these would make the rows again
    rows = assigned.withColumns({"bins": F.size(F.collect_set("assigned_bin").over(contig)), "all_mean": F.avg("prob").over(contig)})
    rows = rows.where("contig is not null and assigned_bin is not null").withColumns({"n": F.count("*").over(own), "own_mean": F.avg("prob").over(own)})
    tier = F.when((F.col("bins") == 1) & (F.col("all_mean") >= mean_probability), "high_confidence").when(F.col("bins") == 1, "medium_confidence").when((F.col("bins") == 2) & (F.col("n") == 2), "low_confidence")
    mean = F.when(F.col("bins") == 1, F.col("all_mean")).otherwise(F.col("own_mean"))
    return rows.select("contig", "assigned_bin", "method", "prob", mean.alias("mean_prob"), tier.alias("confidence")).where("confidence is not null")


def include_contigs(methylation: DataFrame, contig_bins: DataFrame, contamination: DataFrame | None = None, mean_probability: float = 0.8) -> DataFrame:
    """Proposed bins of contigs without one, contaminants among them."""
    bins = contig_bins if contamination is None else contig_bins.join(contamination.select("contig").distinct(), "contig", "left_anti")
    rows = add_bin(methylation, bins).persist()  # read many times; contigs by motifs, far fewer than the pileup's rows
    known = impute_in_bins(rows.where("bin <> 'unbinned'"))
    names = sorted(r[0] for r in known.select("motif_mod").distinct().collect())
    train = matrix(known, names).join(bins.select("contig", "bin"), "contig")
    mods = known.select("motif_mod").distinct()
    free = matrix(impute_unbinned(rows.join(mods, "motif_mod", "left_semi"), mods), names)
    return confidence(classifier_labels(train, free), mean_probability).orderBy("contig", "method")


def new_contig_bins(contig_bins: DataFrame, contamination: DataFrame, include: DataFrame | None = None) -> DataFrame:
    """The map without contaminants, with the contigs of high confidence in their new bins, sorted."""
    out = contig_bins.select("contig", "bin").join(contamination.select("contig").distinct(), "contig", "left_anti")
    if include is not None:
        good = include.where(F.col("confidence") == "high_confidence").select("contig", F.col("assigned_bin").alias("bin")).distinct()
        out = out.unionByName(good)
    return out.orderBy("bin", "contig")


def bin_consensus(bin_motifs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """bin by motif_mod, 1 where the bin's mean methylation of the motif reaches ``threshold``, else 0."""
    mods = bin_motifs.select("bin", motif_mod(F.col("motif"), F.col("mod_type"), F.col("mod_position")).alias("motif_mod"), "n_mod", "n_nomod")
    rate = mods.groupBy("bin", "motif_mod").agg((F.sum("n_mod") / F.sum(F.col("n_mod") + F.col("n_nomod"))).alias("rate"))
    grid = rate.select("bin").distinct().join(rate.select("motif_mod").distinct())
    return grid.join(rate, ["bin", "motif_mod"], "left").select("bin", "motif_mod", F.when(F.col("rate") >= threshold, 1).otherwise(0).alias("methylation_binary"))
