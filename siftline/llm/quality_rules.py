"""Quality rules whose cutoffs carry a risk guarantee, in DataFrame functions only.

Every rule measures a share of a text and rejects above a cutoff. For each stratum, the
labelled holdout tells how many good texts a cutoff would reject; a cutoff is safe when the
exact binomial test refutes "it rejects at least ``risk`` of the good texts" at the level
``delta`` divided by all tests made (rules x grid x strata). The tightest safe cutoff is used;
a stratum without one keeps everything by that rule.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline import session
from siftline.llm import common

WINDOW = 8
#: Rules (a share each) and the cutoffs that are tested, fixed before any label is read.
RULES = ["symbols_per_word", "dup_lines_per_line", "repeats_per_word", "upper_per_letter"]
GRID = {
    "symbols_per_word": [0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.5, 0.7, 1.0],
    "dup_lines_per_line": [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8],
    "repeats_per_word": [0.02, 0.05, 0.1, 0.15, 0.2, 0.25],
    "upper_per_letter": [0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8],
}

_WORDS = r"split(t, '[\\x20\\x09-\\x0D]+')"
# A let-binding: the array is the argument of transform, so it is worked out once.
_WINDOWS = (
    "transform(array(words), ws -> if(size(ws) < {w}, CAST(array() AS array<bigint>),"
    " transform(sequence(1, size(ws) - {w} + 1), i -> xxhash64(slice(ws, i, {w})))))[0]"
).format(w=WINDOW)
# Positions of windows found twice: sorted by hash, equal to the one before or behind.
_TWICE = (
    "transform(array(array_sort(transform(windows, (h, i) -> struct(h AS h, i AS i)))), s -> array_sort(transform(filter("
    "transform(s, (x, k) -> struct(x.i AS i, (k > 0 AND s[greatest(k - 1, 0)].h = x.h) OR (k < size(s) - 1 AND s[least(k + 1, size(s) - 1)].h = x.h) AS d)),"
    " x -> x.d), x -> x.i)))[0]"
)
_COVERED = (
    "transform(array({twice}), p -> aggregate(transform(p, (x, k) -> if(k < size(p) - 1, least({w}, p[least(k + 1, size(p) - 1)] - x), {w})),"
    " 0L, (a, x) -> a + x))[0]"
).format(twice=_TWICE, w=WINDOW)


def measures(docs: DataFrame, id_col: str = "doc_id", text: str = "text", stratum: str | None = "lang") -> DataFrame:
    """Staged counts and rule shares per document (``_id``, ``_stratum``, counts, shares).

    Counts as the module's contract has them: words ``[^\\x20\\x09-\\x0D]+``, symbols ``#*$%&|<>``,
    lines equal to an earlier one, words covered by 8-word windows that the text holds twice.
    A null or empty text has no words; all its counts and shares are 0.
    """
    group = F.coalesce(common.named(stratum).cast("string"), F.lit("(none)")) if stratum else F.lit("(all)")
    base = docs.select(common.named(id_col).alias("_id"), group.alias("_stratum"), common.text_of(text).alias("t"))
    cut = base.select("_id", "_stratum", "t", F.expr(f"filter({_WORDS}, w -> w <> '')").alias("words"))
    joined = F.array_join("words", "")
    lines = F.expr(r"filter(split(t, '\n'), l -> l RLIKE '[^\\x20\\x09-\\x0D]')")
    facts = cut.select(
        "_id", "_stratum",
        F.size("words").cast("long").alias("n_words"),
        F.length(joined).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.regexp_replace("t", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("t", "[^A-Z]+", "")).cast("long").alias("_upper"),
        lines.alias("lines"),
        F.expr(_WINDOWS).alias("windows"),
    )
    counted = facts.select(
        "_id", "_stratum", "n_words", "word_chars", "n_symbols", "_upper",
        F.size("lines").cast("long").alias("_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(f"CASE WHEN size(array_distinct(windows)) = size(windows) THEN 0L ELSE {_COVERED} END").alias("n_repeat_words"),
    )
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    return session.stage(
        counted.select(
            "_id", "_stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            share("n_symbols", "n_words").alias("symbols_per_word"),
            share("n_dup_lines", "_lines").alias("dup_lines_per_line"),
            share("n_repeat_words", "n_words").alias("repeats_per_word"),
            share("_upper", "word_chars").alias("upper_per_letter"),
        ),
        "quality-measures",
    )


def _log_choose(n: Column, k: Column) -> Column:
    def log_factorial(x: Column) -> Column:
        y = x + F.lit(8.0)  # Stirling's series after a shift; its error is below 1e-12
        shifted = sum((F.log(x + F.lit(float(i))) for i in range(1, 8)), F.lit(0.0))
        series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12.0 * y) - 1 / (360.0 * y * y * y) + 1 / (1260.0 * F.pow(y, F.lit(5.0)))
        return series - shifted

    return log_factorial(n) - log_factorial(k) - log_factorial(n - k)


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(at most k of n) for a chance of ``p``; 1 where k is at least n p, as no test can pass there.

    Terms fall from k downwards, and are added until they no longer count.
    """
    n, k = n.cast("double"), k.cast("double")
    top = _log_choose(n, k) + k * math.log(p) + (n - k) * math.log1p(-p)
    # Below the mean each term is smaller than the one before it; 60 standard deviations hold all that count.
    steps = F.least(k, 60 * F.sqrt(n) + 60).cast("long")
    ratio = (1 - p) / p
    series = F.aggregate(
        F.when(steps >= 1, F.sequence(F.lit(1).cast("long"), steps)).otherwise(F.expr("CAST(array() AS array<bigint>)")),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total")),
        lambda a, i: F.struct(
            (a["term"] * (k - i + 1) / (n - k + i) * ratio).alias("term"),
            (a["total"] + a["term"] * (k - i + 1) / (n - k + i) * ratio).alias("total"),
        ),
        lambda a: a["total"],
    )
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(top) * series))


def cutoffs(measured: DataFrame, labels: DataFrame, label: str = "quality", risk: float = 0.02, delta: float = 0.05, rules=RULES, grid=GRID, labels_id: str = "doc_id") -> DataFrame:
    """Staged (``_stratum``, ``rule``, ``cutoff``): the tightest safe cutoff; no row where none is safe.

    ``risk`` is the share of good texts that a rule may reject in a stratum, ``delta`` the chance
    that any of all cutoffs breaks it (Bonferroni over every test). Labels that are null, or whose
    document is missing, don't count. Conflicting labels of one document count each.
    """
    good = labels.filter(common.named(label) == 1).select(common.named(labels_id).alias("_id"))
    held = measured.join(good, "_id").select("_stratum", *rules)
    cells = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(float(c)).alias("cutoff"), (F.col(r) > c).cast("long").alias("over")) for r in rules for c in grid[r]])
    # One row per stratum first: the sums of all cells, combined before the shuffle.
    sums = held.groupBy("_stratum").agg(F.count("*").alias("n"), *[F.sum(cells[i]["over"]).alias(f"k{i}") for i in range(sum(len(grid[r]) for r in rules))])
    names = [(r, float(c)) for r in rules for c in grid[r]]
    tested = sums.select("_stratum", "n", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"k{i}").alias("k")) for i, (r, c) in enumerate(names)])).alias("x"))
    strata = F.broadcast(sums.agg(F.count("*").alias("strata")))
    tested = tested.crossJoin(strata).select("_stratum", "x.rule", "x.cutoff", "n", "x.k", "strata")
    safe = tested.withColumn("p", binomial_tail(F.col("n"), F.col("k"), risk)).filter(F.col("p") <= delta / (len(names) * F.col("strata")))
    return session.stage(safe.groupBy("_stratum", "rule").agg(F.min("cutoff").alias("cutoff")), "cutoffs")


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", stratum: str | None = "lang", rules=RULES, **options) -> DataFrame:
    """One row per document: id, counts, ``rejected_by`` (names of the rules that reject), ``passed``.

    A null id gets counts and a verdict as any other. Empty texts pass all rules. Repeated rows are
    judged each. An empty table of labels gives no cutoffs, so all pass.
    """
    measured = measures(docs, id_col, text, stratum)
    found = cutoffs(measured, labels, rules=rules, **options)
    table = found.groupBy("_stratum").pivot("rule", list(rules)).agg(F.min("cutoff"))
    table = session.stage(table.select("_stratum", *[F.col(r).alias(f"_cut_{r}") for r in rules]), "cutoff-table")
    out = common.attach(measured, table, "_stratum", [f"_cut_{r}" for r in rules])
    failed = F.filter(F.array(*[F.when(F.col(r) > F.col(f"_cut_{r}"), F.lit(r)) for r in rules]), lambda x: x.isNotNull())
    return out.select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("rejected_by"), (F.size(failed) == 0).alias("passed"),
    )
