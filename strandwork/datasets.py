"""Made-up smoke data: small genomes with methylated motifs, as files of the kinds that the commands read."""

from __future__ import annotations

import random
from pathlib import Path

from .functions.motif import Motif

#: Motif and modified position by bin.
MOTIFS = {"bin1": ("GATC", 1), "bin2": ("GACG", 1), "bin3": ("CTCA", 3)}


def genome(length: int, seed: int | str) -> str:
    rng = random.Random(seed)
    return "".join(rng.choices("ACGT", k=length))


def pileup_lines(contig: str, seq: str, motif: str, position: int, seed: int | str = 0):
    """Rows of the 18-column table at every A of both strands: 95 % at the motif's sites, 2 % elsewhere."""
    rng = random.Random(f"{contig}/{seed}")
    for strand in "+-":
        s = seq if strand == "+" else Motif.read(seq, 0).reverse_complement().text
        for i, b in enumerate(s):
            if b == "A":
                at = i if strand == "+" else len(s) - 1 - i
                modified = s.startswith(motif, i - position) if i >= position else False
                coverage = rng.randint(20, 40)
                percent = 95.0 if modified else 2.0
                n = round(coverage * percent / 100)
                yield "\t".join(map(str, (contig, at, at + 1, "a", coverage, strand, at, at + 1, "255,0,0", coverage, percent, n, coverage - n, 0, 0, 0, 0, 0)))


def write_smoke_data(folder: str, contigs: int = 3, length: int = 12_000, seed: int = 1) -> dict[str, str]:
    """assembly.fasta, pileup.bed and contig_bin.tsv of three bins; the last contig of bin3 has no bin. Returns their paths."""
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    paths = {n: str(out / f) for n, f in (("assembly", "assembly.fasta"), ("pileup", "pileup.bed"), ("contig_bin", "contig_bin.tsv"))}
    with open(paths["assembly"], "w") as fasta, open(paths["pileup"], "w") as pileup, open(paths["contig_bin"], "w") as bins:
        for b, (motif, position) in MOTIFS.items():
            for k in range(contigs):
                name = f"{b}_contig_{k}"
                seq = genome(length, f"{seed}/{name}")
                fasta.write(f">{name}\n{seq}\n")
                pileup.writelines(line + "\n" for line in pileup_lines(name, seq, motif, position, seed))
                if (b, k) != ("bin3", contigs - 1):
                    bins.write(f"{name}\t{b}\n")
    return paths
