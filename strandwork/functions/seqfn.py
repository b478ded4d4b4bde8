"""Sequence functions as Column builders; positions of overlapping matches as a vectorised UDF."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import CODE_OF, COMPLEMENT_FROM, COMPLEMENT_TO, IUPAC


def reverse_complement(c: Column) -> Column:
    """Of bases, IUPAC codes and bracketed motifs alike."""
    return F.reverse(F.translate(c, COMPLEMENT_FROM, COMPLEMENT_TO))


def count_overlapping(seq: Column, motif: str) -> Column:
    return F.regexp_count(seq, F.lit(f"(?={motif})"))


def count_plain(seq: Column, sub: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(seq) - F.length(F.replace(seq, F.lit(sub), F.lit("")))) / len(sub)).cast("int")


def gc(seq: Column) -> Column:
    """Share of G and C; null for an empty sequence."""
    return F.length(F.regexp_replace(seq, "[^GC]", "")) / F.nullif(F.length(seq), F.lit(0))


def positions(seq: Column, motif: str) -> Column:
    """All start offsets of the motif, overlapping ones too."""
    pattern = re.compile(f"(?={motif})")

    @F.pandas_udf("array<int>")
    def find(s: pd.Series) -> pd.Series:
        return s.map(lambda x: [] if x is None else [m.start() for m in pattern.finditer(x)])

    return find(seq)


def pieces(seq: Column, size: int, overlap: int) -> Column:
    """The sequence as an array of pieces: the i-th begins at i * size and runs ``overlap`` bases into the next. Linear in its length."""
    return F.regexp_extract_all(seq, F.lit(f"(?=(.{{1,{size + overlap}}})).{{1,{size}}}"), F.lit(1))


def literal_positions(seq: Column, sub: str) -> Column:
    return positions(seq, re.escape(sub))


def iupac_to_regex(c: Column) -> Column:
    for code, bases in IUPAC.items():
        if len(bases) > 1:
            c = F.replace(c, F.lit(code), F.lit("." if code == "N" else f"[{bases}]"))
    return c


def regex_to_iupac(c: Column) -> Column:
    """Bracketed sets in any order become their code; a set without a code becomes nothing."""
    tokens = F.regexp_extract_all(c, F.lit(r"(\[[^\]]*\]|.)"), F.lit(1))
    codes = F.create_map(*(F.lit(x) for kv in [*CODE_OF.items(), (".", "N")] for x in kv))
    bases = lambda t: F.array_join(F.array_sort(F.array_distinct(F.split(F.regexp_replace(t, r"[\[\]]", ""), ""))), "")
    return F.array_join(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(codes, bases(t)), F.lit(""))), "")


def motif_type(iupac: Column) -> Column:
    """ambiguous, bipartite, palindrome or non-palindrome, from the runs of N of an IUPAC motif."""
    return (
        F.when(F.regexp_count(iupac, F.lit("N{2,}")) >= 2, "ambiguous")
        .when(iupac.rlike("N{3,}"), "bipartite")
        .when(iupac == reverse_complement(iupac), "palindrome")
        .otherwise("non-palindrome")
    )


def motif_tokens(motif: Column) -> Column:
    return F.regexp_extract_all(motif, F.lit(r"(\[[^\]]*\]|.)"), F.lit(1))


def motif_length(motif: Column) -> Column:
    return F.size(motif_tokens(motif))


def trimmed_length(motif: Column) -> Column:
    """Tokens that fix a base or a set."""
    return motif_length(motif) - F.size(F.filter(motif_tokens(motif), lambda t: t == "."))


def strip_motif(motif: Column, position: Column) -> tuple[Column, Column]:
    """Without flanking dots, the position moved along; a motif of dots only stays."""
    bare = F.regexp_replace(motif, r"^\.+|\.+$", "")
    lead = F.length(motif) - F.length(F.regexp_replace(motif, r"^\.+", ""))
    all_dots = bare == ""
    return F.when(all_dots, motif).otherwise(bare), F.when(all_dots, position).otherwise(position - lead)


def has_run(c: Column, runs: int, length: int, character: str) -> Column:
    """Whether there are ``runs`` runs of at least ``length`` of the character."""
    return F.regexp_count(c, F.lit(f"{re.escape(character)}{{{length},}}")) >= runs


def length_order(a: Column, b: Column) -> Column:
    """-1, 0 or 1: sequences are ordered by length; joined and repeated ones are ``concat`` and ``repeat``."""
    return F.signum(F.length(a) - F.length(b)).cast("int")


def begins_with(seq: Column, pattern: str) -> Column:
    """Whether the pattern matches at the start; its negation drops matches."""
    return seq.rlike(f"^(?:{pattern})")


def fits(window: Column, motif: str) -> Column:
    """Whether each base of the window is in the motif's set; N, which stands for all bases, fits only wildcards."""
    return window.rlike(f"^(?:{motif})$")


def match_length(pattern: Column) -> Column:
    """Length of the pattern where all from the first opening to the last closing bracket counts as one."""
    return F.length(F.regexp_replace(pattern, r"\[.*\]", "."))


def equal_lengths(c: Column) -> Column:
    """Aggregate: whether all lengths are equal; true of no rows."""
    return F.coalesce(F.min(F.length(c)) == F.max(F.length(c)), F.lit(True))


def contig_of(bin_contig: Column, contig_bin: Column) -> Column:
    """The name without its first ``<bin>_``; unchanged if the bin is null."""
    prefix = F.concat(contig_bin, F.lit("_"))
    at = F.instr(bin_contig, prefix)
    cut = F.concat(F.substr(bin_contig, F.lit(1), at - 1), F.substr(bin_contig, at + F.length(prefix)))
    return F.when(contig_bin.isNull() | (at == 0), bin_contig).otherwise(cut)


def bin_of(bin_contig: Column) -> Column:
    """What stands before ``_contig_<number>``; null if nothing does."""
    return F.nullif(F.regexp_extract(bin_contig, r"(.+)_contig_\d+", 1), F.lit(""))


def motif_mod(motif: Column, mod_type: Column, position: Column) -> Column:
    return F.concat_ws("_", motif, mod_type, position.cast("string"))
