"""Pileup filters and motif counts: plans of scans, windows, joins and aggregates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import HIGH, LOW, PRIOR
from ..functions.motif import ANY, BASE_MASKS, Motif
from ..functions.seqfn import literal_positions, pieces, reverse_complement


def covered(pileup: DataFrame, least: int = 5) -> DataFrame:
    """Rows with more than ``least`` valid reads."""
    return pileup.where(F.col("Nvalid_cov") > least)


def often_modified(pileup: DataFrame, threshold: float = HIGH, share: float = 1e-4, least: int = 50) -> DataFrame:
    """Rows of the contig and mod_type pairs that have more than ``least`` modified positions and more than ``share`` of them."""
    n_mod = F.count_if(F.col("fraction_mod") > threshold)
    keep = pileup.groupBy("contig", "mod_type").agg(n_mod.alias("n_mod"), F.count("*").alias("n"))
    keep = keep.where((F.col("n_mod") / F.col("n") > share) & (F.col("n_mod") > least))
    return pileup.join(keep.select("contig", "mod_type"), ["contig", "mod_type"], "left_semi")


def without_neighbours(pileup: DataFrame, threshold: float = HIGH, distance: int = 8, stretch: int = 1 << 20) -> DataFrame:
    """Rows below ``threshold``, and those that are highest within ``distance`` on their contig and strand; ties stay.

    A contig is cut into stretches with margins, so that a window never needs a whole chromosome in one task.
    """
    at = F.col("position")
    homes = F.array_distinct(F.transform(F.array(at - distance, at, at + distance), lambda x: F.floor(x / F.lit(stretch))))
    spread = pileup.withColumn("_stretch", F.explode(homes))
    w = Window.partitionBy("contig", "strand", "_stretch").orderBy("position").rangeBetween(-distance, distance)
    kept = spread.withColumn("_highest", F.max("fraction_mod").over(w)).where(F.col("_stretch") == F.floor(at / F.lit(stretch)))
    return kept.where((F.col("fraction_mod") == F.col("_highest")) | (F.col("fraction_mod") < threshold)).drop("_highest", "_stretch")


def with_bins(pileup: DataFrame, contig_bins: DataFrame) -> DataFrame:
    """Inner join on contig. The map's size decides the strategy: Spark broadcasts it only below its own threshold."""
    return pileup.join(contig_bins.select("contig", "bin"), "contig")


def known_bins(contig_bins: DataFrame, assembly: DataFrame) -> DataFrame:
    """Map rows whose contig is in the assembly; ValueError if none is."""
    out = contig_bins.join(assembly.select("contig"), "contig", "left_semi")
    if out.isEmpty():
        raise ValueError("no contig of the bins is in the assembly")
    return out


def split_confident(fraction: Column, high: float = HIGH, low: float = LOW) -> tuple[Column, Column]:
    """(methylated, unmethylated) flags, both bounds inclusive."""
    return fraction >= high, fraction <= low


def motif_hits(assembly: DataFrame, motifs: list[Motif], size: int = 4096) -> DataFrame:
    """(contig, motif, mod_position, strand, position) of the modified base of each occurrence on both strands.

    One pass over pieces of the sequences for all motifs: a base is a bit, and a motif fits where each of its
    fixed places shares a bit with the sequence. A motif of an empty list has no hits.
    """
    forms = [(m.text, m.position, strand, x) for m in motifs for strand, x in (("+", m.stripped()), ("-", m.stripped().reverse_complement()))]
    longest = max((len(x) for *_, x in forms), default=1)
    patterns = [(tuple(x.sets), x.position) for *_, x in forms]

    def run(batches):
        for b in batches:
            lengths = b["text"].str.len().to_numpy()
            starts = np.concatenate(([0], np.cumsum(lengths + longest)))
            codes = BASE_MASKS[np.frombuffer("".join(t + "-" * longest for t in b["text"]).encode("latin-1", "replace"), np.uint8)]
            contigs, begins = b["contig"].to_numpy(), b["piece"].to_numpy(np.int64) * size
            for k, (sets, position) in enumerate(patterns):
                fits = np.ones(max(len(codes) - len(sets) + 1, 0), bool)
                for i, s in enumerate(sets):
                    if s != ANY:
                        fits &= (codes[i : i + len(fits)] & s) != 0
                hits = np.flatnonzero(fits)
                row = np.searchsorted(starts, hits, "right") - 1
                at = hits - starts[row]
                own = (at < size) & (at + len(sets) <= lengths[row])
                row, at = row[own], at[own]
                if len(row):
                    yield pd.DataFrame({"contig": contigs[row], "form": np.int32(k), "position": begins[row] + at + position})

    cut = assembly.select("contig", F.posexplode(pieces(F.col("seq"), size, longest)).alias("piece", "text")).repartition("contig", "piece")
    found = cut.mapInPandas(run, "contig string, form int, position long")
    form = lambda values, kind: F.get(F.array(*(F.lit(x) for x in values)).cast(f"array<{kind}>"), F.col("form"))
    return found.select(
        "contig", form([f[0] for f in forms], "string").alias("motif"), form([f[1] for f in forms], "int").alias("mod_position"),
        form([f[2] for f in forms], "string").alias("strand"), "position",
    )


def motif_counts(pileup: DataFrame, hits: DataFrame, keys: list[str], high: float = HIGH, low: float = LOW) -> DataFrame:
    """n_mod, n_nomod and the model's parameters for each motif and ``keys``, over both strands.

    Hits meet the pileup on contig, strand and position; a very frequent contig spreads by position.
    """
    hit = hits.select("contig", "strand", "position", "motif", "mod_position")
    rows = pileup.join(hit, ["contig", "strand", "position"])
    meth, bare = split_confident(F.col("fraction_mod"), high, low)
    out = rows.groupBy(*keys, "motif", "mod_position").agg(F.count_if(meth).alias("n_mod"), F.count_if(bare).alias("n_nomod"))
    return out.withColumn("alpha", F.col("n_mod") + F.lit(PRIOR[0])).withColumn("beta", F.col("n_nomod") + F.lit(PRIOR[1]))


def methylated_reads(pileup: DataFrame, hits: DataFrame) -> DataFrame:
    """Per contig and motif: reads that say methylated and all valid reads at the motif's positions."""
    rows = pileup.join(hits.select("contig", "strand", "position", "motif"), ["contig", "strand", "position"])
    reads = F.round(F.col("fraction_mod") * F.col("Nvalid_cov")).cast("long")
    return rows.groupBy("contig", "motif").agg(F.sum(reads).alias("methylated"), F.sum("Nvalid_cov").alias("valid"))


def contig_methylation(pileup: DataFrame, hits: DataFrame, output: str = "median", least_coverage: int = 1, diff: str | None = None, least_valid: float = 0.8) -> DataFrame:
    """Per contig and motif: methylation_value (median of positions, or weighted by reads), mean_read_cov, n_motif_obs.

    ``diff``: the column of reads that show another base; positions count if valid reads are ``least_valid`` of both.
    """
    if output not in ("median", "weighted_mean"):
        raise ValueError("output must be median or weighted_mean")
    good = F.col("Nvalid_cov") >= least_coverage
    if diff:
        good &= F.col("Nvalid_cov") / (F.col("Nvalid_cov") + F.col(diff)) >= least_valid
    on = ["contig", "strand", "position"]
    rows = pileup.where(good).join(hits.select(*on, "motif", "mod_position", *(["mod_type"] if "mod_type" in hits.columns else [])), on + (["mod_type"] if "mod_type" in hits.columns else []))
    value = F.median("fraction_mod") if output == "median" else F.sum(F.col("fraction_mod") * F.col("Nvalid_cov")) / F.sum("Nvalid_cov")
    return rows.groupBy("contig", "motif", "mod_type", F.col("mod_position").cast("byte").alias("mod_position")).agg(
        value.alias("methylation_value"), F.avg("Nvalid_cov").alias("mean_read_cov"), F.count("*").cast("int").alias("n_motif_obs")
    )


def enough_evidence(methylation: DataFrame, least: float = 24) -> DataFrame:
    return methylation.where(F.col("n_motif_obs") * F.col("mean_read_cov") >= least)


def enough_occurrences(motifs: DataFrame, least: int = 50) -> DataFrame:
    return motifs.where(F.col("n_mod") + F.col("n_nomod") >= least)


def windows_around(rows: DataFrame, assembly: DataFrame, padding: int, size: int = 1024, keep: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` (contig, position, strand) with window, the bases around the position, length, that of the contig, and the assembly's columns ``keep``.

    Places outside the sequence are dashes; windows of the - strand are reverse-complemented; positions outside
    the sequence are left out. Rows meet pieces of the sequence, so none of them carries all of it.
    """
    margin = F.lit("-" * padding)
    cut = assembly.select("contig", *keep, F.length("seq").alias("length"), F.posexplode(pieces(F.concat(margin, "seq", margin), size, 2 * padding)).alias("_piece", "_text"))
    at = F.col("position")
    near = rows.withColumn("_piece", F.floor(at / F.lit(size)).cast("int")).join(cut, ["contig", "_piece"]).where((at >= 0) & (at < F.col("length")))
    w = F.substring(F.col("_text"), (F.pmod(at, F.lit(size)) + 1).cast("int"), F.lit(2 * padding + 1))
    return near.withColumn("window", F.when(F.col("strand") == "-", reverse_complement(w)).otherwise(w)).drop("_piece", "_text")


def windows_at(rows: DataFrame, assembly: DataFrame, padding: int) -> DataFrame:
    """``rows`` with window where it lies well inside the sequence: more than ``padding`` bases on either side."""
    at = F.col("position")
    return windows_around(rows, assembly, padding).where((at > padding) & (at < F.col("length") - padding)).drop("length")


def sample_per_key(rows: DataFrame, key: str, order: list[str], n: Column | int, seed: int = 42) -> DataFrame:
    """At most ``n`` rows of each key, those with the least hash: the same on every run."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(*order, F.lit(seed)), *order))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def sample_subsequences(sequences: DataFrame, length: int, n: int = 1, seed: int = 42) -> DataFrame:
    """(contig, seq): ``n`` stretches of each sequence at hashed starts, repeats possible; an error on a shorter sequence."""
    rows = sequences.select("contig", "seq", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("draw"))
    start = F.pmod(F.xxhash64("contig", "draw", F.lit(seed)), F.length("seq") - length + 1)
    short = F.raise_error(F.concat(F.lit(f"no {length} bases in "), F.col("contig"))).cast("string")
    return rows.select("contig", F.when(F.length("seq") < length, short).otherwise(F.substring(F.col("seq"), (start + 1).cast("int"), F.lit(length))).alias("seq"))


def sample_at(sequences: DataFrame, sub: str, padding: int, n: int = 1, seed: int = 42) -> DataFrame:
    """(contig, position, seq): up to ``n`` different occurrences of ``sub`` in each sequence with ``padding`` bases on either side.

    Sampling is the feature; occurrences too near an end are left out.
    """
    found = sequences.select("contig", F.length("seq").alias("length"), F.explode(literal_positions(F.col("seq"), sub)).alias("position"))
    inside = found.where((F.col("position") >= padding) & (F.col("position") + len(sub) + padding <= F.col("length"))).drop("length")
    chosen = sample_per_key(inside, "contig", ["position"], n, seed).join(sequences.select("contig", "seq"), "contig")
    return chosen.select("contig", "position", F.substring(F.col("seq"), F.col("position") - padding + 1, F.lit(len(sub) + 2 * padding)).alias("seq"))


def position_matrix(rows: DataFrame, keys: list[str], seq: str = "window", pseudocount: float = 0.0, bases: str = "ACGT") -> DataFrame:
    """(keys, pos, base, frequency) of equally long sequences for every base: (count + pseudocount) / sequences."""
    long = rows.select(*keys, F.posexplode(F.split(seq, "")).alias("pos", "base"))
    per = long.groupBy(*keys, "pos").agg(F.count("*").alias("n"), *(F.count_if(F.col("base") == b).alias(b) for b in bases))
    each = F.explode(F.create_map(*(x for b in bases for x in (F.lit(b), (F.col(b) + pseudocount) / F.col("n")))))
    return per.select(*keys, "pos", each.alias("base", "frequency"))


def position_frequencies(rows: DataFrame, keys: list[str], seq: str = "window") -> DataFrame:
    """(keys, pos, base, frequency): the position matrix of equally long sequences, without pseudocounts."""
    long = rows.select(*keys, F.posexplode(F.split(seq, "")).alias("pos", "base"))
    counted = long.groupBy(*keys, "pos", "base").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys, "pos"))
    return counted.select(*keys, "pos", "base", (F.col("n") / total).alias("frequency"))


def divergence(p: DataFrame, q: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos, kl): divergence of matrix ``p`` from ``q`` at each position; infinite where q lacks a base that p has."""
    own = p.alias("p").join(q.select(*keys, "pos", "base", F.col("frequency").alias("back")), [*keys, "pos", "base"], "left")
    term = F.when(F.col("back").isNull(), F.lit(float("inf"))).otherwise(F.col("frequency") * F.log(F.col("frequency") / F.col("back")))
    return own.groupBy(*keys, "pos").agg(F.sum(term).alias("kl"))
