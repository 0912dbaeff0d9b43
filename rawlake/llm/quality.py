"""Quality rules: learned decision lists over statistics of texts."""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rawlake.llm.common import SPACE_CLASS, stage, text_of, words_of

SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
# Figures that rules may test, as expressions over those of ``statistics``.
FEATURES = {
    "n_words": "double(n_words)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(n_words, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "line_words": "n_words / greatest(n_lines, 1)",
}


def repeated_words(words: Column) -> Column:
    """Words inside 5-word windows that occur twice or more, each word counted once.

    Texts whose windows have distinct hashes have none; only the others compare whole windows.
    """
    last = F.size(words) - WINDOW
    starts = F.sequence(F.lit(0), last)

    def window(i: Column) -> Column:
        return F.slice(words, i + 1, WINDOW)

    hashes = F.transform(starts, lambda i: F.xxhash64(window(i)))
    places = F.array_sort(F.transform(starts, lambda i: F.struct(window(i).alias("w"), i.alias("i"))))

    def repeated(sorted_places: Column) -> Column:
        def same(a: Column, b: Column) -> Column:
            return F.coalesce(F.get(sorted_places, a)["w"] == F.get(sorted_places, b)["w"], F.lit(False))

        marked = F.filter(sorted_places, lambda s, k: same(k, k - 1) | same(k, k + 1))
        return F.array_sort(F.transform(marked, lambda s: s["i"]))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, s: a + s)

    def bound(value: Column, fn) -> Column:
        """``fn(value)`` with the value computed once."""
        return F.get(F.transform(F.array(value), fn), F.lit(0))

    count = bound(bound(places, repeated), covered)
    some = (last >= 0) & (F.size(F.array_distinct(hashes)) <= last)
    return F.when(some, count).otherwise(0).cast("bigint")


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Each row as ``row``, with counts over its whole text; a null text has none of anything."""
    text = text_of(text_col)
    lines = F.filter(F.split(text, "\n"), lambda line: F.rlike(line, F.lit("[^\\x20\\x09-\\x0D]")))
    split = docs.select(F.struct("*").alias("row"), text.alias("text"), words_of(text).alias("words"), lines.alias("lines"))
    words = F.col("words")
    return split.select(
        "row",
        F.size(words).cast("bigint").alias("n_words"),
        F.length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        repeated_words(words).alias("n_repeat_words"),
        F.size("lines").cast("bigint").alias("n_lines"),
        F.size(F.array_distinct(words)).cast("bigint").alias("n_distinct"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("bigint").alias("n_upper"),
        F.regexp_count("text", F.lit("[!?]")).cast("bigint").alias("n_marks"),
        F.regexp_count("text", F.lit("[0-9]")).cast("bigint").alias("n_digits"),
    )


@dataclass(frozen=True)
class Test:
    """``feature > at`` or ``feature <= at``."""

    feature: str
    above: bool
    at: float

    def column(self, prefix: str = "") -> Column:
        value = F.col(prefix + self.feature)
        return value > self.at if self.above else value <= self.at


Rule = tuple[Test, ...]


def holds(rule: Rule, prefix: str = "") -> Column:
    out = F.lit(True)
    for test in rule:
        out &= test.column(prefix)
    return out


def decision(rules: list[Rule], prefix: str = "") -> Column:
    """The ordered list as one conditional expression: the number of the first rule that holds, or null."""
    out = F.lit(None).cast("int")
    for number, rule in reversed(list(enumerate(rules))):
        out = F.when(holds(rule, prefix), F.lit(number)).otherwise(out)
    return out


def thresholds(rows: DataFrame) -> dict[str, list[float]]:
    """Cut points of every feature: exact quantiles of each class, a fixed number of them."""
    at = [0.005, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 0.95, 0.98, 0.995]
    sums = [F.percentile(F.when(F.col("bad") == b, F.col(f)), at).alias(f"{f}_{b}") for f in FEATURES for b in (0, 1)]
    row = rows.agg(*sums).first()
    return {f: sorted({x for b in (0, 1) for x in row[f"{f}_{b}"] or []}) for f in FEATURES}


Cells = dict[tuple[str, bool, float], tuple[int, int]]


def counted(rows: DataFrame, cuts: dict[str, list[float]]) -> tuple[Cells, Cells]:
    """Bad and good rows behind every possible test, of the rows to grow on and the held-out ones.

    One grouping by feature and step counts all tests of both.
    """

    def step(f: str) -> Column:
        return sum(((F.col(f) > c).cast("int") for c in cuts[f]), F.lit(0))

    cells = F.array(*[F.struct(F.lit(f).alias("f"), step(f).alias("k")) for f in FEATURES])
    each = rows.select("bad", (F.col("part") == 0).alias("held"), F.explode(cells).alias("c"))
    grouped = each.groupBy("held", "c.f", "c.k").agg(F.sum("bad").alias("p"), F.count(F.lit(1)).alias("n"))
    found = {(r["held"], r["f"], r["k"]): (r["p"], r["n"] - r["p"]) for r in grouped.collect()}
    out: tuple[Cells, Cells] = ({}, {})
    for held, table in zip((False, True), out, strict=True):
        if not any(k[0] == held for k in found):
            continue
        for f, points in cuts.items():
            steps = [found.get((held, f, k), (0, 0)) for k in range(len(points) + 1)]
            for k, c in enumerate(points):
                table[f, False, c] = (sum(s[0] for s in steps[: k + 1]), sum(s[1] for s in steps[: k + 1]))
                table[f, True, c] = (sum(s[0] for s in steps[k + 1 :]), sum(s[1] for s in steps[k + 1 :]))
    return out


def gain(cell: tuple[int, int], whole: tuple[int, int]) -> float:
    """Information gained on bad rows when (bad, good) rows shrink from ``whole`` to ``cell``."""
    return cell[0] * (log2(cell[0] / sum(cell)) - log2(whole[0] / sum(whole))) if cell[0] else 0.0


def grow(rows: DataFrame, cuts: dict[str, list[float]], max_tests: int) -> Rule:
    """Add the test with the most information gain until only bad rows are left; held-out rows decide ties."""
    rule: Rule = ()
    while len(rule) < max_tests:
        table, other = counted(rows.where(holds(rule)), cuts)
        if not table:
            break
        other = other or dict.fromkeys(table, (0, 0))
        f, _, c = next(iter(table))
        whole, held = (tuple(x + y for x, y in zip(t[f, False, c], t[f, True, c], strict=True)) for t in (table, other))
        best = max(sorted(table), key=lambda k: (gain(table[k], whole), gain(other[k], held)))
        if not all(whole) or gain(table[best], whole) <= 1e-9:
            break
        rule += (Test(*best),)
    return rule


def prune(rows: DataFrame, rule: Rule) -> tuple[Rule, int, int]:
    """The prefix of the rule that is most worth on held-out rows, and its bad and good rows there."""
    sums = []
    for k in range(1, len(rule) + 1):
        hit = holds(rule[:k])
        sums += [F.count_if(hit & (F.col("bad") == 1)).alias(f"p{k}"), F.count_if(hit & (F.col("bad") == 0)).alias(f"n{k}")]
    row = rows.agg(*sums).first()

    def worth(k: int) -> float:
        p, n = row[f"p{k}"], row[f"n{k}"]
        return (p - n) / (p + n) if p + n else -1.0

    k = max(range(1, len(rule) + 1), key=lambda k: (worth(k), row[f"p{k}"]))
    return rule[:k], row[f"p{k}"], row[f"n{k}"]


def learn(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_rules: int = 8,
    max_tests: int = 3,
    max_labels: int = 20_000,
    least_precision: float = 0.95,
) -> list[Rule]:
    """Sequential covering: rules that single out rows labelled 0, in order.

    Each rule is grown on two thirds of the rows that no earlier rule covers, pruned on the
    last third and kept if at least ``least_precision`` of what it covers there is bad. Only
    the fitting is bounded: about ``max_labels`` labelled ids are used, chosen by a hash of
    the id. Rows without a label or id are left out; without both classes there are no rules.
    """
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__label_id"))
    marked = marked.agg((F.max(label_col) < 1).cast("int").alias("bad"))
    n = marked.count()
    if n > max_labels:
        marked = marked.where(F.pmod(F.xxhash64(F.lit("pick"), "__label_id"), F.lit(1_000_000)) < int(1_000_000 * max_labels / n))
    # about max_labels ids, so the side to broadcast is bounded
    chosen = docs.select(F.col(id_col).alias("__label_id"), F.col(text_col).alias("text")).join(F.broadcast(marked), "__label_id")
    rows = statistics(chosen).select("row.bad", part_of("row.__label_id"), *[F.expr(e).alias(f) for f, e in FEATURES.items()])
    # at most about max_labels rows of a few numbers, which every step below reads
    rows = stage(rows.repartition(2))
    cuts = thresholds(rows)
    rules: list[Rule] = []
    while len(rules) < max_rules:
        left = rows.where(decision(rules).isNull())
        check = left.where(F.col("part") == 0)
        rule = grow(left, cuts, max_tests)
        if not rule:
            break
        rule, p, n = prune(check, rule)
        if p < 3 or p < least_precision * (p + n):
            break
        rules.append(rule)
    return rules


def part_of(ident: str) -> Column:
    """Which third of the labelled rows an id is in."""
    return F.pmod(F.xxhash64(F.lit("part"), ident), F.lit(3)).alias("part")


def judge(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """``base_failed``, the number of the first rule that holds (or null) and ``kept``."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    features = stats.select("row", *BASE, failed.alias("base_failed"), *[F.expr(e).alias(f"f_{f}") for f, e in FEATURES.items()])
    out = features.withColumn("rule", decision(rules, "f_"))
    return out.select("row", *BASE, "base_failed", "rule", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"))


def quality_verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **fit) -> DataFrame:
    """Statistics of every document, with the verdict of the base limits and the learned list.

    Null and empty texts have no words and fail the base limits. Ids may repeat or be null:
    each row gets its own verdict. Columns besides the id and the text are not read.
    """
    rules = learn(docs, labels, id_col, text_col, **fit)
    judged = judge(statistics(docs.select(id_col, text_col), text_col), rules)
    return judged.select(F.col(f"row.{id_col}"), *BASE, "base_failed", "rule", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **fit) -> DataFrame:
    """The documents that pass, with all their columns. No text moves between tasks."""
    rules = learn(docs, labels, id_col, text_col, **fit)
    judged = judge(statistics(docs, text_col), rules).select("row", "kept", F.monotonically_increasing_id().alias("number"))
    # the number keeps the filter above the statistics, which it would otherwise compute again for each use
    return judged.where(F.col("kept") & (F.col("number") >= 0)).select("row.*")
