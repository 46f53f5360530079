"""Quality rules as a learned decision list, in DataFrame operations only.

The base counts of a text are computed natively and staged once as narrow
rows. Sequential covering learns from labelled rows: each rule grows one
threshold condition at a time (the one that adds most information by FOIL's
measure on the growing rows) until no condition adds any, is pruned from its
end on the rows held back for that, and then takes the rows it covers out of
the statistics; rules follow until the next one has no margin on the rows held
back. The list becomes one ordered ``CASE`` expression.

Thresholds are cells of a fixed grid, ``CELLS`` of equal width between a power
of two and the next: relative steps below half a percent at every size of a
value, so a rare tail has thresholds of its own. Every step is one grouped
count of (feature, cell) over the labelled rows it covers. Only those counts
reach the driver, and the grid bounds them: some ten thousand cells for values
from 1e-6 to 1e6. They are whole numbers of fixed cells, so reruns and other
partitions learn the same list.

Cases: null and empty texts have no words and fail the base rule; unlabelled
rows, rows of a null doc_id and labels without a document teach nothing; of
repeated labels of a doc_id the least counts; without labels of both kinds the
list is empty and keeps what the base rule keeps; repeated rows are judged
each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.session import stage

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
CELLS = 256
LEAST_COVERED = 5  # growing rows of the kind to find: fewer are no evidence
LEAST_MARGIN = 3  # held-back rows of that kind above those of the other
FEATURES = ("n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share")


def base_counts(text: Column) -> list[Column]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = F.coalesce(text, F.lit(""))
    bare = F.translate(text, SPACES, "")
    words = F.array_remove(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    return [
        F.size(words).cast("long").alias("n_words"), F.length(bare).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        bound(words, repeated_words).cast("long").alias("n_repeat_words"),
    ]


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, as a lambda's variable."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the text."""
    third = F.greatest(F.size(words) - 2, F.lit(0))
    pair = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    windows = F.zip_with(F.slice(pair, 1, third), F.slice(words, 3, third), lambda a, b: F.xxhash64(a, b))
    return bound(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(covered(w)))


def covered(windows: Column) -> Column:
    """Length of the union of the 3-word windows whose hash occurs more than once."""
    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    def places(s: Column) -> Column:
        same = lambda a, b: F.get(s, a)["h"].eqNullSafe(F.get(s, b)["h"])
        twice = F.filter(s, lambda x, j: ((j > 0) & same(j - 1, j)) | same(j + 1, j))
        return F.array_sort(F.transform(twice, lambda x: x["i"]))
    spread = lambda p: F.aggregate(
        p, F.struct(F.lit(0).alias("sum"), F.lit(-3).alias("last")),
        lambda acc, i: F.struct((acc["sum"] + F.least(F.lit(3), i - acc["last"])).alias("sum"), i.alias("last")),
    )["sum"]
    return bound(bound(placed, places), spread)


def features() -> dict[str, Column]:
    c = F.col
    each = F.greatest(c("n_words"), F.lit(1))
    return {
        "n_words": c("n_words").cast("double"), "mean_word": c("word_chars") / each,
        "symbol_share": c("n_symbols") / F.greatest(c("word_chars"), F.lit(1)),
        "dup_line_share": c("n_dup_lines") / each, "repeat_share": c("n_repeat_words") / each,
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) >= self.threshold if self.above else F.col(self.feature) < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold!r}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    def column(self) -> Column:
        out = F.lit(True)
        for condition in self.conditions:
            out = out & condition.column()
        return out

    def __str__(self) -> str:
        return " AND ".join(map(str, self.conditions)) + " -> reject"


def cell(value: Column) -> Column:
    """The greatest threshold of the grid that is not above a value; 0 below the least one.

    Dividing by a power of two is exact, so a row is in a cell or above exactly if its value is at least the threshold.
    """
    near = F.floor(F.log2(value))
    octave = F.when(F.pow(2.0, near) > value, near - 1).when(F.pow(2.0, near + 1) <= value, near + 1).otherwise(near)
    return F.when(value < 2.0**-40, 0.0).otherwise(bound(F.pow(2.0, octave) / CELLS, lambda step: F.floor(value / step) * step))


def cell_counts(rows: DataFrame) -> dict[str, list[tuple[float, float, float]]]:
    """Of each feature its cells in order, (threshold, rows of low, of other quality): one aggregate over the rows."""
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"{f}_cell").alias("cell")) for f in FEATURES])
    counts = rows.select("low", F.inline(cells)).groupBy("feature", "cell").agg(F.sum("low").alias("low"), F.sum(1 - F.col("low")).alias("good"))
    out: dict[str, list[tuple[float, float, float]]] = {f: [] for f in FEATURES}
    for r in counts.collect():
        out[r.feature].append((r.cell, r.low, r.good))
    return {f: sorted(cells) for f, cells in out.items()}


def gain(low: float, good: float, was_low: float, was_good: float) -> float:
    """FOIL's information gain of narrowing (was_low, was_good) to (low, good)."""
    if not low:
        return 0.0
    return low * (math.log2((low + 1) / (low + good + 2)) - math.log2((was_low + 1) / (was_low + was_good + 2)))


def best_condition(counts: dict[str, list[tuple[float, float, float]]], least: float) -> Condition | None:
    """The condition of the greatest gain; of equal ones the first by feature and threshold."""
    best, found = 1e-9, None
    for feature in FEATURES:
        cells = counts[feature]
        low, good = sum(c[1] for c in cells), sum(c[2] for c in cells)
        below_low = below_good = 0
        for before, here in itertools.pairwise(cells):
            below_low, below_good = below_low + before[1], below_good + before[2]
            for above, a, b in ((False, below_low, below_good), (True, low - below_low, good - below_good)):
                value = gain(a, b, low, good) if a >= least else 0.0
                if value > best:
                    best, found = value, Condition(feature, above, here[0])
    return found


def precision_by_length(rows: DataFrame, rule: Rule) -> list[tuple[float, float]]:
    """(low, good) covered by each beginning of the rule, in one aggregate."""
    prefixes = [Rule(rule.conditions[: i + 1]).column() for i in range(len(rule.conditions))]
    sums = [F.sum(F.when(p, v).otherwise(0)) for p in prefixes for v in (F.col("low"), 1 - F.col("low"))]
    found = [x or 0 for x in rows.agg(*sums).first()]
    return list(zip(found[::2], found[1::2], strict=True))


def learn(rows: DataFrame) -> list[Rule]:
    """Ordered rules that reject, from rows with the features and ``low`` (1: low quality).

    Every condition leaves growing rows out and every rule takes some of low quality, so both loops end by themselves.
    """
    cells = [cell(F.col(f)).alias(f"{f}_cell") for f in FEATURES]
    rows = stage(rows.select(*FEATURES, *cells, "low", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("prune")), "labelled")
    low, n = rows.agg(F.sum("low"), F.count("*")).first()
    if not low or low == n:
        return []
    rules, left = [], rows
    while True:
        grown: tuple[Condition, ...] = ()
        growing = left.where(~F.col("prune"))
        while (condition := best_condition(cell_counts(growing), LEAST_COVERED)) is not None:
            grown += (condition,)
            growing = growing.where(condition.column())
        if not grown:
            return rules
        # Keep the shortest beginning with the best smoothed margin on the rows held back.
        held = precision_by_length(left.where("prune"), Rule(grown))
        worth = [(a - b) / (a + b + 1) for a, b in held]
        best = worth.index(max(worth))
        if held[best][0] - held[best][1] < LEAST_MARGIN:
            return rules
        rules.append(Rule(grown[: best + 1]))
        left = left.where(~rules[-1].column())


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that rejects a row, null if none does."""
    out = None
    for i, rule in enumerate(rules):
        out = F.when(rule.column(), i + 1) if out is None else out.when(rule.column(), i + 1)
    return F.lit(None).cast("int") if out is None else out


def judge(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, list[Rule]]:
    """One row per document with its counts, base_failed, rule (the one that rejects it) and kept; and the list."""
    counted = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *base_counts(F.col("text"))), "base-counts").withColumns(features_of())
    base_failed = (F.col("words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("words"))
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg((1 - F.least(F.min("quality"), F.lit(1))).cast("long").alias("low"))
    rules = learn(counted.where(~base_failed).join(known, "doc_id"))
    rule = F.when(~base_failed, verdict(rules))
    rows = counted.withColumn("base_failed", base_failed).withColumn("rule", rule).withColumn("kept", ~base_failed & rule.isNull())
    return rows.select("doc_id", F.col("words").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"), rules


def features_of() -> dict[str, Column]:
    return {"words": F.col("n_words"), **features()}
