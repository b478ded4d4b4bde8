"""Rows with nulls, empty and long texts, repeated rows and missing ids."""

LONG = " ".join(f"word{i % 977} other{i % 1013}" for i in range(30_000)) + "."
ODD = [
    (0, None), (1, ""), (2, "   \n "), (3, LONG), (4, "one"), (5, "Ünïcode — ßtraße 漢字 text."), (6, "same text here twice over and over"),
    (7, "same text here twice over and over"), (7, "same text here twice over and over"), (None, "no id at all for this one"), (None, None),
]
