"""Motif-set operators: noise, sub-motifs, merging, complements."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.motif import Motif
from ..functions.seqfn import reverse_complement


def isolated_bases(motif: Column, reach: int) -> Column:
    @F.pandas_udf("int")
    def count(s: pd.Series) -> pd.Series:
        return s.map(lambda x: Motif.read(x, 0).isolated(reach))

    return count(motif)


def without_noise(motifs: DataFrame, keys: list[str], reach: int = 3) -> DataFrame:
    """Without motifs that have isolated bases; a group of nothing else stays whole."""
    noisy = motifs.withColumn("_noisy", isolated_bases(F.col("motif"), reach) > 0)
    some_clean = F.bool_or(~F.col("_noisy")).over(Window.partitionBy(*keys))
    return noisy.withColumn("_clean", some_clean).where(~F.col("_noisy") | ~F.col("_clean")).drop("_noisy", "_clean")


def contains(child: Column, parent: Column) -> Column:
    @F.pandas_udf("boolean")
    def test(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([Motif.read(x, 0).contains(Motif.read(y, 0)) for x, y in zip(a, b)], dtype=bool)

    return test(child, parent)


def sub_motif_pairs(motifs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, parent, child) with their positions and models: pairs inside a group's motif set, a few dozen motifs each.

    A child contains its parent at some shift. Equal motifs are no pair.
    """
    fields = ["motif", "mod_position", "alpha", "beta"]
    side = lambda name: motifs.select(*keys, *(F.col(c).alias(f"{name}_{c}") for c in fields))
    pairs = side("parent").join(side("child"), keys).where(F.col("child_motif") != F.col("parent_motif"))
    return pairs.where(contains(F.col("child_motif"), F.col("parent_motif")))


def without_sub_motifs(motifs: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """Of each parent and child one goes: the parent if the child predicts itself better by ``threshold``, else the child. All pairs are judged on the whole set."""
    pairs = sub_motif_pairs(motifs, keys)
    scored = stats.with_predictive_score(pairs, "child_alpha", "child_beta", "parent_alpha", "parent_beta", "_score")
    gone = scored.select(*keys, F.when(F.col("_score") > threshold, F.struct(F.col("parent_motif").alias("m"), F.col("parent_mod_position").alias("p"))).otherwise(F.struct(F.col("child_motif").alias("m"), F.col("child_mod_position").alias("p"))).alias("x"))
    gone = gone.select(*keys, F.col("x.m").alias("motif"), F.col("x.p").alias("mod_position")).distinct()
    return motifs.join(gone, [*keys, "motif", "mod_position"], "left_anti")


def without_children(motifs: DataFrame, keys: list[str]) -> DataFrame:
    """Without motifs that contain another one of their group."""
    gone = sub_motif_pairs(motifs, keys).select(*keys, F.col("child_motif").alias("motif"), F.col("child_mod_position").alias("mod_position")).distinct()
    return motifs.join(gone, [*keys, "motif", "mod_position"], "left_anti")


def join_complements(motifs: DataFrame) -> DataFrame:
    """Each motif with its reverse complement's columns; of two that are each other's one row stays, that of the greater IUPAC string.

    Keys are reference, mod_type and motif_iupac; the position isn't one, so equal palindromes pair with each other.
    """
    keys = ["reference", "mod_type"]
    other = motifs.select(*keys, reverse_complement(F.col("motif_iupac")).alias("motif_iupac"), F.struct(*motifs.columns).alias("c"))
    out = motifs.join(other, [*keys, "motif_iupac"], "left")
    kept = out.where(F.col("c").isNull() | (F.col("motif_iupac") >= F.col("c.motif_iupac")))
    return kept.select(*motifs.columns, *(F.col("c")[c].alias(f"{c}_complement") for c in motifs.columns if c not in keys))
