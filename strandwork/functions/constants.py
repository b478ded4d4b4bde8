"""Fixed values of the sequence alphabet and the methylation types."""

#: IUPAC codes and the bases they stand for.
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}
CODE_OF = {bases: code for code, bases in IUPAC.items()}
COMPLEMENT_FROM, COMPLEMENT_TO = "ACGTRYSWKMBDHVN.[]", "TGCAYRSWMKVHDBN.]["
#: Order of the axes of one-hot rows and position matrices.
BASES = "ATGC"
CANONICAL = {"m": "C", "a": "A", "21839": "C"}
PRETTY = {"m": "5mC", "a": "6mA", "21839": "4mC"}
PRIOR = (5.0, 5.0)
HIGH, LOW = 0.7, 0.3
