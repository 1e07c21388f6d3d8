"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document; the ledger keeps what was measured and one integer
of failure bits. A policy is a versioned mask of the rules that it enforces, so verdicts of any policy,
and the effect of leaving out a rule, come from the ledger by bitwise operations alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.llm.native import let

WINDOW = 5
WHITE = " \t\n\x0b\f\r"

#: Rule -> whether a document fails it, by its measurements. The bit is the rule's place.
RULES = {
    "few_words": lambda: F.col("n_words") < 10,
    "repeated_words": lambda: 100 * F.col("n_repeat_words") > 20 * F.col("n_words"),
    "symbols": lambda: 5 * F.col("n_symbols") > F.col("n_words"),
    "duplicate_lines": lambda: 100 * F.col("n_dup_lines") > 60 * F.col("n_lines"),
    "long_words": lambda: F.col("word_chars") > 100 * F.col("n_words"),
}
#: Versioned policies: the rules that reject a document.
POLICIES = {
    "base-1": ("few_words", "repeated_words"),
    "full-1": ("few_words", "repeated_words", "symbols", "duplicate_lines", "long_words"),
}


def mask(policy: str) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in POLICIES[policy])


def _repeated(windows: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more in the document."""

    def covered(order: Column) -> Column:
        def same(x: Column, other: Column) -> Column:
            return F.coalesce(x["h"] == other["h"], F.lit(False))

        twice = F.filter(order, lambda x, j: same(x, F.get(order, j - 1)) | same(x, F.get(order, j + 1)))
        return let(
            F.sort_array(F.transform(twice, lambda x: x["i"])),
            lambda at: F.aggregate(
                F.transform(at, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(at, j + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x
            ),
        )

    order = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), let(order, covered)).otherwise(0)


def ledgers(docs: DataFrame, id_col: str | None, text_col: str) -> DataFrame:
    """``row`` (the id, or without id_col all columns in a struct), the measurements and ``failed``."""
    row = F.col(id_col) if id_col else F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    rows = docs.select(row.alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # one array or scalar at a time, so that each is computed once
    rows = rows.withColumn("words", F.filter(F.split("text", "[ \\t-\\r]+"), lambda w: w != ""))
    w = F.col("words")
    window = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW))))
    lines = F.filter(F.split("text", "\n"), lambda line: F.btrim(line, F.lit(WHITE)) != "")
    rows = rows.withColumns({"windows": F.when(F.size(w) >= WINDOW, window).otherwise(F.array().cast("array<bigint>")), "lines": lines})
    measures = {
        "n_words": F.size("words"),
        "word_chars": F.length(F.array_join("words", "")),
        "n_symbols": F.length("text") - F.length(F.regexp_replace("text", "[#*$%&|<>]+", "")),
        "n_lines": F.size("lines"),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": _repeated(F.col("windows")),
    }
    return rows.select("row", *(c.cast("long").alias(n) for n, c in measures.items())).withColumn("failed", bits())


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measurements and ``failed`` (bits by the order of RULES) of every row; no shuffle.

    Words are runs of anything but ASCII white space; windows of words are compared by 64-bit hash
    within one document. A null or empty text is measured as zeros and fails few_words; repeated rows
    and ties give a row each; an empty table gives no rows; other columns are ignored.
    """
    return ledgers(docs, id_col, text_col).withColumnRenamed("row", "doc_id")


def bits() -> Column:
    out = F.lit(0)
    for k, fails in enumerate(RULES.values()):
        out = out.bitwiseOR(F.when(fails(), F.lit(1 << k)).otherwise(0))
    return out


def verdict(policy: str, failed: str = "failed") -> Column:
    """Whether a ledger row is kept under a policy."""
    return F.col(failed).bitwiseAND(F.lit(mask(policy))) == 0


def ablations(found: DataFrame, policy: str = "full-1") -> DataFrame:
    """left_out, n_kept: documents kept under a policy with each of its rules left out (null: none left out).

    One aggregation over failure bits (2 ** rules rows at most), then bitwise sums over those.
    """
    names = list(RULES)
    masks = {None: mask(policy)} | {r: mask(policy) & ~(1 << names.index(r)) for r in POLICIES[policy]}
    counts = found.groupBy("failed").count()
    kept = [F.coalesce(F.sum(F.when(F.col("failed").bitwiseAND(F.lit(m)) == 0, F.col("count"))), F.lit(0)) for m in masks.values()]
    each = F.array(*(F.struct(F.lit(r).cast("string").alias("left_out"), k.alias("n_kept")) for r, k in zip(masks, kept, strict=True)))
    return counts.agg(each.alias("each")).select(F.inline("each"))


def quality(docs: DataFrame, policy: str = "full-1") -> DataFrame:
    """The ledger with base_failed and the policy's verdict."""
    found = ledger(docs)
    base = ~verdict("base-1")
    return found.withColumns({"base_failed": base, "kept": ~base & verdict(policy)})


def kept_rows(docs: DataFrame, policy: str = "full-1", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that the base rules and a policy keep."""
    # the mark is not deterministic, which keeps the optimizer from moving the condition, and with it a second
    # evaluation of every rule, below the ledger
    found = ledgers(docs, None, text_col).withColumn("mark", F.monotonically_increasing_id())
    return found.where(verdict("base-1") & verdict(policy) & (F.col("mark") >= 0)).select("row.*")
