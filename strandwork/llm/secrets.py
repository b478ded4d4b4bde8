"""Secret scans over a content-addressed ledger of blobs: each (blob, rule version) is scanned once.

All of it is DataFrame expressions. A text's matches and the gaps between them come from two
regular-expression splits of the same leftmost, non-overlapping search, so running lengths give
the places of all matches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_by_count

RULE_VERSION = 1
#: Matches whose places are summed up in one go; a text's matches go through in such chunks, so that a long list isn't copied for each of them.
CHUNK = 256


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    base: bool
    hint: str  # a cheap search that every text with a match passes
    keep: str = ""  # what a match must also satisfy, as a pattern


#: Kinds, patterns and least lengths of the base secrets, then this method's own.
RULES = [
    Rule(
        "assign",
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        True,
        r"""[dDtTnNyY]["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12}""",
        r"""[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12,}$""",
    ),
    Rule("access", r"AKIA[A-Z0-9]{14,}", True, r"AKIA[A-Z0-9]{14}"),
    Rule("hex", r"[0-9a-f]{16,}", True, r"[0-9a-f]{16}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", False, r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", False, r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", False, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ"),
]
_ENTRY = "array<struct<start:int,rank:int,kind:string,stop:int>>"


def _matches(text: Column, rule: Rule, rank: int) -> Column:
    """Entries (start, rank, kind, stop) of one rule's matches; the search runs only where the hint is found.

    An assignment's value runs to its end of class, so a match fails as a whole or stands as a whole;
    for the two others the least length in the pattern finds the same runs as a check afterwards.
    """
    none = F.from_json(F.lit("[]"), _ENTRY)
    gaps = F.transform(F.split(text, rule.pattern, -1), F.char_length)
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        stop = start + F.char_length(x["hit"])
        one = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), stop.alias("stop")))
        good = x["hit"].rlike(rule.keep) if rule.keep else F.lit(True)
        return F.struct(stop.alias("at"), F.when(good, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    def chunk(acc: Column, pairs: Column) -> Column:
        walked = F.aggregate(pairs, F.struct(acc["at"].alias("at"), none.alias("out")), step)
        return F.transform(F.array(walked), lambda w: F.struct(w["at"].alias("at"), F.concat(acc["out"], F.array(w["out"])).alias("out")))[0]

    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    chunks = F.transform(F.array(pairs), lambda p: F.transform(F.sequence(F.lit(0), F.floor(F.size(p) / CHUNK)), lambda c: F.slice(p, (c * CHUNK + 1).cast("int"), CHUNK)))[0]
    walked = F.aggregate(chunks, F.struct(F.lit(0).alias("at"), F.array(none).alias("out")), chunk, lambda acc: F.flatten(acc["out"]))
    return F.when(text.rlike(rule.hint), walked).otherwise(none)


def scan(text: Column, rules: list[Rule] = RULES) -> Column:
    """All rules' matches in ``text``, by start, then by the rules' order."""
    return F.sort_array(F.concat(*(_matches(text, r, i) for i, r in enumerate(rules))))


def _blob(text: str = "text") -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def scan_blobs(documents: DataFrame, ledger: DataFrame | None = None, rules: list[Rule] = RULES, version: int = RULE_VERSION) -> DataFrame:
    """New ledger rows: blob (sha256 of the text), version, spans, for blobs that ``ledger`` lacks at this version.

    Only the blob's first holder is read again for its text: hashes and ids are what is grouped.
    """
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    hashed = texts.select("doc_id", _blob().alias("blob"))
    unseen = hashed.groupBy("blob").agg(F.min("doc_id").alias("holder"))
    if ledger is not None:
        unseen = unseen.join(ledger.where(F.col("version") == version).select("blob"), "blob", "left_anti")
    # A blob whose holders all lack an id has no holder; its texts are grouped themselves.
    held = texts.where("doc_id is not null").select("doc_id", "text", _blob().alias("blob"))
    held = held.join(
        unseen.where("holder is not null").hint("shuffle_hash"),
        (held.doc_id == F.col("holder")) & (held.blob == unseen.blob), "left_semi",
    ).select("blob", "text")
    lone = texts.where("doc_id is null").select(_blob().alias("blob"), "text").join(unseen.where("holder is null"), "blob", "left_semi")
    return (
        held.union(lone).select("blob", scan(F.col("text"), rules).alias("spans"))
        .groupBy("blob").agg(F.max("spans").alias("spans"))
        .select("blob", F.lit(version).alias("version"), "spans")
    )


def extended(documents: DataFrame, ledger: DataFrame | None = None, rules: list[Rule] = RULES, version: int = RULE_VERSION) -> DataFrame:
    """``ledger`` with the new blobs of ``documents``, as a table; each blob once at each version."""
    new = scan_blobs(documents, ledger, rules, version)
    if ledger is None:
        return cut(new)
    old = ledger.select("blob", "version", "spans").groupBy("blob", "version").agg(F.max("spans").alias("spans"))
    return cut(old.unionByName(new))


def _with_spans(rows: DataFrame, ledger: DataFrame, version: int) -> DataFrame:
    """``rows`` (with their blob) joined with the ledger's spans; a blob that very many rows hold isn't gathered in one task."""
    held = rows.groupBy("blob").agg(F.count("*").alias("held"))
    found = cut(ledger.where((F.col("version") == version) & (F.size("spans") > 0)).select("blob", "spans").join(held, "blob"))
    out = join_by_count(rows, found, "blob", "held")
    return out.withColumn("spans", F.coalesce("spans", F.from_json(F.lit("[]"), _ENTRY)))


def find_secrets(documents: DataFrame, ledger: DataFrame | None = None, rules: list[Rule] = RULES, version: int = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """(a row for each row of ``documents``: row, blob, spans; the ledger with the new blobs).

    row has all the document's columns, whatever their names; blob is its text's sha256; spans are
    (start, rank, kind, stop in code points, stop exclusive). A null text counts as empty and has no
    spans. Rows with the same text share one scan, whatever their ids; repeated and id-less rows stay. A
    ledger that has a blob more than once counts as one that has it once; other versions' rows stay in
    it and decide nothing. Empty tables give empty results.
    """
    full = extended(documents, ledger, rules, version)
    return _with_spans(documents.select(F.struct("*").alias("row"), _blob().alias("blob")), full, version), full


def _digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def secret_digest(documents: DataFrame, ledger: DataFrame | None = None, increments: int = 2) -> DataFrame:
    """Per row: doc_id, counts of the base kinds, base_sha256 and spans, as ``find_secrets`` finds them.

    The documents come in ``increments`` parts, by a hash of their ids; each part's scan passes over the
    blobs that the ledger has from the parts before. The findings are then joined to all rows: the
    texts stay out of that, only ids and hashes move.
    """
    for i in range(increments):
        part = documents.where(F.pmod(F.xxhash64("doc_id"), F.lit(increments)) == i)
        ledger = extended(part, ledger)
    rows = _with_spans(documents.select("doc_id", _blob().alias("blob")), ledger, RULE_VERSION)
    base = F.filter("spans", lambda x: x["rank"] < sum(r.base for r in RULES))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return rows.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(_digest(base), 256).alias("base_sha256"), _digest(F.col("spans")).alias("spans"),
    )


def redact(documents: DataFrame, ledger: DataFrame | None = None, mark: str = "[SECRET]") -> DataFrame:
    """``documents`` with each secret's text replaced by ``mark`` and n_chars counted anew; columns as before.

    Overlapping spans are replaced by one mark. Rows without secrets, and null texts, stay as they are.
    """
    found, _ = find_secrets(documents, ledger)
    found = found.select("row", "spans", F.col("row")["text"].alias("text"))

    def step(acc: Column, x: Column) -> Column:
        fresh = x["start"] >= acc["at"]
        gap = F.substring("text", acc["at"] + 1, x["start"] - acc["at"])
        out = F.when(fresh, F.concat(acc["out"], F.array(gap, F.lit(mark)))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["stop"]).alias("at"), out.alias("out"))

    kept = F.aggregate(
        "spans", F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), step,
        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col("text"), acc["at"] + 1, F.char_length("text"))),
    )
    out = found.select("row", F.when(F.size("spans") > 0, kept).alias("clean"))
    row, clean = F.col("row"), F.col("clean")
    new = {c: row[c] for c in documents.columns} | {"text": F.coalesce(clean, row["text"])}
    if "n_chars" in documents.columns:
        length = F.char_length(clean).cast(documents.schema["n_chars"].dataType)
        new["n_chars"] = F.when(clean.isNotNull(), length).otherwise(row["n_chars"])
    return out.select(*(c.alias(n) for n, c in new.items()))
