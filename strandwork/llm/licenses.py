"""License scans: one Aho-Corasick pass for notice phrases and identifier tags, a shunting-yard parser for expressions.

Phrases are matched on the row of a text's words (ASCII letters in lower case, digits, other
characters beyond ASCII). Where a tag such as ``SPDX-License-Identifier:`` is found, the expression
after it is parsed with its and, or and with operators, and gives labels and a strictness.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import in_arrow, small_batches

#: The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: The method's own phrases.
OWN = {
    "apache license": "apache", "apache 2 0": "apache", "mit license": "mit", "bsd license": "bsd", "isc license": "isc", "mozilla public license": "mpl",
    "eclipse public license": "epl", "lesser general public license": "lgpl", "affero general public license": "agpl", "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd", "cc by nc sa": "cc-by-nc-sa", "cc by nc nd": "cc-by-nc-nd", "cc0": "cc0",
    "creative commons attribution": "cc-by", "public domain": "public-domain", "proprietary and confidential": "proprietary", "unlicense": "unlicense",
}
TAGS = ("spdx license identifier", "license expression")
_TAG = re.compile(r"(?:spdx-license-identifier|license-expression)\s*:\s*([^\r\n]*)", re.I)
_PART = re.compile(r"\(|\)|[A-Za-z0-9.+:-]+")
#: How strictly a licence family binds, from free use (0) to no use (1); by the longest prefix of an identifier.
STRICTNESS = {
    "cc0": 0.0, "unlicense": 0.0, "public-domain": 0.0, "0bsd": 0.05, "mit": 0.1, "isc": 0.1, "bsd": 0.1, "apache": 0.15, "cc-by": 0.2,
    "mpl": 0.4, "epl": 0.4, "lgpl": 0.5, "cc-by-sa": 0.5, "gpl": 0.7, "agpl": 0.8, "cc-by-nd": 0.8, "cc-by-nc": 0.85, "cc-by-nc-sa": 0.85,
    "cc-by-nc-nd": 0.9, "reserved": 1.0, "proprietary": 1.0,
}
UNKNOWN, EXCEPTION_EASES = 0.6, 0.5
_TABLE = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


@dataclass(frozen=True)
class Value:
    labels: frozenset[str]
    strictness: float


def strictness(identifier: str) -> float:
    fitting = [k for k in STRICTNESS if identifier == k or identifier.startswith((k + "-", k + "+"))]
    return STRICTNESS[max(fitting, key=len)] if fitting else UNKNOWN


_BINDS = {"or": 1, "and": 2, "with": 3}


def evaluate(expression: str) -> Value | None:
    """The value of a licence expression, by a shunting yard; None if it is malformed.

    and: both hold, the stricter binds. or: one may be chosen, the laxer binds. with: an exception
    eases its licence; its name is no label. with binds tightest, then and, then or.
    """
    output: list[Value] = []
    waiting: list[str] = []
    operand_next = True

    def apply() -> bool:
        if len(output) < 2:
            return False
        op, b, a = waiting.pop(), output.pop(), output.pop()
        if op == "with":
            output.append(Value(a.labels, a.strictness * EXCEPTION_EASES))
        else:
            output.append(Value(a.labels | b.labels, (max if op == "and" else min)(a.strictness, b.strictness)))
        return True

    for part in _PART.findall(expression.lower()):
        if part == "(":
            if not operand_next:
                return None
            waiting.append(part)
        elif part == ")":
            if operand_next:
                return None
            while waiting and waiting[-1] != "(":
                if not apply():
                    return None
            if not waiting:
                return None
            waiting.pop()
        elif part in _BINDS:
            if operand_next:
                return None
            while waiting and waiting[-1] != "(" and _BINDS[waiting[-1]] >= _BINDS[part]:
                if not apply():
                    return None
            waiting.append(part)
            operand_next = True
        elif operand_next:
            name = part.rstrip(".:-")
            if not name:
                return None
            output.append(Value(frozenset([name]), strictness(name)))
            operand_next = False
        else:
            break  # prose after the expression
    if operand_next:
        return None
    while waiting:
        if waiting[-1] == "(" or not apply():
            return None
    return output[0] if len(output) == 1 else None


def automaton(phrases: dict[str, tuple[str, str]]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for phrase, value in phrases.items():
        a.add_word(f" {phrase} ", (len(phrase.split()), *value))
    a.make_automaton()
    return a


def scanner(base: dict[str, str] = BASE, own: dict[str, str] = OWN):
    """A function from a text to (n_words, n_base, first_word, last_word, base labels, labels, score)."""
    phrases = {p: ("own", x) for p, x in own.items()} | {t: ("tag", "") for t in TAGS} | {p: ("base", x) for p, x in base.items()}
    found_in = automaton(phrases)

    def scan(text: str | None) -> tuple:
        words = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()
        joined = f" {b' '.join(words).decode('latin-1')} "
        n_base, first, last = 0, None, None
        of_base: set[str] = set()
        labels: dict[str, float] = {}
        tagged = False
        passed, spaces = 0, 0  # the matches' ends never go back, so all spaces are counted once
        for end, (size, kind, label) in found_in.iter(joined):
            if kind == "tag":
                tagged = True
                continue
            labels[label] = max(labels.get(label, 0.0), strictness(label))
            if kind == "base":
                spaces += joined.count(" ", passed, end)
                passed = end
                at = spaces - size
                n_base += 1
                first = at if first is None else min(first, at)
                last = at if last is None else max(last, at)
                of_base.add(label)
        if tagged:
            for m in _TAG.finditer(text):
                if (value := evaluate(m.group(1))) is not None:
                    for label in value.labels:
                        labels[label] = max(labels.get(label, 0.0), value.strictness)
        return len(words), n_base, first, last, ",".join(sorted(of_base)), ",".join(sorted(labels)), max(labels.values(), default=0.0)

    return scan


def scan_licenses(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Words, places and base labels are the base phrases' own; labels adds the method's phrases and the
    identifiers of parsed expressions (in lower case). score is the strictest of all notices and
    expressions of the text, an expression counting by its value: 0 without any, 1 for all rights
    reserved. A malformed
    expression adds nothing. A null text counts as empty: no words, no places (first_word and last_word
    null), empty labels, score 0. Repeated rows stay; further columns are ignored.
    """
    small_batches(documents.sparkSession)

    def make():
        scan = scanner()

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            columns = list(zip(*map(scan, batch.column(1).to_pylist())))
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            return pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(columns or [[]] * 7, types))],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

        return one

    return in_arrow(documents.select("doc_id", "text"), make, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
