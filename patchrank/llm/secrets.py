"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every version of every path is addressed by its content: the blob is the SHA-256 of the text, a null text being empty. The ledger holds
a row for each (blob, rule, version of the rule) that has been scanned, with the gaps before and the sizes of all matches, so an
empty row says "scanned, nothing found". A run scans each unseen pair once, however many paths and versions share the blob, appends
to the ledger, and joins findings back to all paths. Copies combine before the shuffle, so a text that a third of all paths hold
travels once per task.
"""
from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from patchrank.llm.common import keep, packed, unpacked

LEDGER = "blob BINARY, rule STRING, version STRING, gaps ARRAY<INT>, sizes ARRAY<INT>, valid ARRAY<BOOLEAN>"


@dataclass(frozen=True)
class Rule:
    """``pattern`` is searched leftmost and without overlap; a match counts if ``group`` has at least ``least`` characters.

    ``hints``: a text that holds none of these strings has no match.
    """
    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    hints: tuple[str, ...] = ()

    @property
    def version(self) -> str:
        return hashlib.sha256(f"{self.pattern}|{self.group}|{self.least}".encode()).hexdigest()[:16]


RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6, (":", "=")),
    Rule("access", r"AKIA[A-Z0-9]{16,}", hints=("AKIA",)),  # runs: asking for the length in the pattern drops the same matches
    Rule("hex", r"[0-9a-f]{24,}"),
)


def with_blob(versions: DataFrame, text: str = "text") -> DataFrame:
    return versions.withColumn("_blob", F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)))


def _matches(text: Column, rule: Rule) -> Column:
    """(rule, version, gaps, sizes, valid) of one rule over one text."""
    has = text.rlike(rule.pattern)
    if rule.hints:
        hint = F.lit(False)
        for h in rule.hints:
            hint = hint | text.contains(h)
        has = hint & has
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    group = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    parts = F.struct(F.transform(F.split(text, rule.pattern, -1), F.length).alias("gaps"), F.transform(whole, F.length).alias("sizes"),
                     F.transform(group, lambda g: F.length(g) >= rule.least).alias("valid"))
    empty = F.array().cast("array<int>")
    none = F.struct(empty.alias("gaps"), empty.alias("sizes"), F.array().cast("array<boolean>").alias("valid"))
    found = F.when(has, parts).otherwise(none)
    return F.struct(F.lit(rule.kind).alias("rule"), F.lit(rule.version).alias("version"), found.alias("found"))


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules=RULES, text: str = "text") -> DataFrame:
    """New ledger rows: every pair of blob and rule version of ``versions`` that ``ledger`` lacks."""
    blobs = with_blob(versions.select(F.col(text).cast("string")), text).select("_blob", F.coalesce(text, F.lit("")).alias("_text")).dropDuplicates(["_blob"])
    wanted = [f"{r.kind}:{r.version}" for r in rules]
    if ledger is None:
        todo = blobs.withColumn("_todo", F.array(*map(F.lit, wanted)))
    else:
        seen = ledger.groupBy("blob").agg(F.collect_set(F.concat_ws(":", "rule", "version")).alias("_seen"))
        todo = (blobs.join(seen, blobs["_blob"] == seen["blob"], "left")
                .withColumn("_todo", F.array_except(F.array(*map(F.lit, wanted)), F.coalesce("_seen", F.array().cast("array<string>"))))
                .where(F.size("_todo") > 0))
    each = [F.when(F.array_contains("_todo", w), _matches(F.col("_text"), r)) for r, w in zip(rules, wanted)]
    rows = todo.select(F.col("_blob").alias("blob"), F.explode(F.array_compact(F.array(*each))).alias("m"))
    return rows.select("blob", "m.rule", "m.version", "m.found.gaps", "m.found.sizes", "m.found.valid")


def update(versions: DataFrame, ledger: DataFrame | None = None, rules=RULES, text: str = "text") -> DataFrame:
    """The ledger with the unseen pairs of ``versions`` scanned and stored in shared storage."""
    new = keep(scan(versions, ledger, rules, text), "secret-ledger")
    return new if ledger is None else ledger.select(new.columns).union(new)


def findings(ledger: DataFrame, rules=RULES) -> DataFrame:
    """(blob, kind, rank, start, end) of valid matches under the current rule versions, in code points, end exclusive."""
    current = F.lit(False)
    for r in rules:
        current = current | ((F.col("rule") == r.kind) & (F.col("version") == r.version))
    rows = (ledger.where(current & F.exists("valid", lambda v: v))
            .select("blob", "rule", F.posexplode(F.arrays_zip("gaps", "sizes", "valid")).alias("nth", "m")))
    before = W.partitionBy("blob", "rule").orderBy("nth").rowsBetween(W.unboundedPreceding, W.currentRow)
    upto = F.sum(F.col("m.gaps") + F.coalesce("m.sizes", F.lit(0))).over(before)
    rank = F.element_at(F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))]), F.col("rule"))
    placed = rows.select("blob", F.col("rule").alias("kind"), rank.alias("rank"), (upto - F.col("m.sizes")).alias("start"), upto.alias("end"), "m.valid")
    return placed.where("valid").drop("valid").distinct()


def by_path(versions: DataFrame, ledger: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """``versions`` with ``_spans``, an array of (start, rank, end, kind) in order, empty where the blob is clean."""
    found = findings(ledger, rules).groupBy(F.col("blob").alias("_found")).agg(F.sort_array(F.collect_list(F.struct("start", "rank", "end", "kind"))).alias("_spans"))
    named = with_blob(versions, text)
    none = F.array().cast(found.schema["_spans"].dataType)
    return (named.join(found, named["_blob"] == found["_found"], "left").withColumn("_spans", F.coalesce("_spans", none)).drop("_found", "_blob"))


def _of(kind: str):
    return lambda span: span["kind"] == kind


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans per document; the method adds no spans to the base ones."""
    rows = docs.select("doc_id", F.col("text").cast("string"))
    found = by_path(rows, update(rows))
    joined = F.concat_ws(",", F.transform("_spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    count = [F.size(F.filter("_spans", _of(r.kind))).cast("bigint").alias(f"n_{r.kind}") for r in RULES]
    return found.select("doc_id", *count, F.sha2(joined, 256).alias("base_sha256"), joined.alias("spans"))


def redact(docs: DataFrame, mask: str = "[SECRET]", ledger: DataFrame | None = None) -> DataFrame:
    """``docs`` with each run of overlapping spans replaced by ``mask``; other rows and columns as they are.

    ``n_chars`` follows the new text where the column exists.
    """
    rows = packed(docs, F.col("text").cast("string"))
    found = by_path(rows, update(rows, ledger))
    inside = lambda at: F.exists("_spans", lambda p: (p["start"] < at) & (p["end"] > at))
    border = lambda name: F.array_sort(F.array_distinct(F.transform(F.filter("_spans", lambda s: ~inside(s[name])), lambda s: s[name].cast("int"))))
    pieces = F.transform(F.sequence(F.lit(0), F.size("_starts")), lambda k: F.substring(
        F.col("text"), F.element_at(F.concat(F.array(F.lit(0)), F.col("_ends")), k + 1) + 1,
        F.element_at(F.concat(F.col("_starts"), F.array(F.length("text"))), k + 1) - F.element_at(F.concat(F.array(F.lit(0)), F.col("_ends")), k + 1)))
    clean = F.when(F.size("_spans") == 0, F.col("text")).otherwise(F.array_join(pieces, mask))
    out = found.withColumns({"_starts": border("start"), "_ends": border("end")}).withColumn("_clean", clean)
    changed = {"text": F.col("_clean")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.size("_spans") == 0, F.col("row.n_chars")).otherwise(F.length("_clean")).cast(docs.schema["n_chars"].dataType)
    return unpacked(out, docs.columns, **changed)
