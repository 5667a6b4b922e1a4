"""Quality rules as a learned decision list, in DataFrame and SQL functions only.

Sequential covering: a rule starts empty and grows by the threshold condition with
the best information gain on two thirds of the labelled rows it still covers; it is
then pruned to the prefix that does best on the other third, and accepted if it is
precise there.  Rows of an accepted rule are set aside and the next rule is grown.
The list comes out as one Spark conditional expression.

Every count is an aggregate over all labelled rows (their number of rows is never
brought to the driver, only counts per feature, threshold and class: at most
``len(FEATURES) * (CUTS + 1) * 4`` rows).  The text statistics are written once to
the shared folder and serve both the learning and the verdicts.

Null texts have no words; they and texts under ``MIN_WORDS`` words fail the base.
Labels that are null, or of documents that are not there, take no part; a document
labelled twice counts twice.  Without labels the list is empty.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapwise.llm.common import Scratch, bind, words_of

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MOST_REPEATED_PERCENT = 50

FEATURES = ("symbol_share", "repeat_share", "dup_line_share", "mean_word", "distinct_share", "words_per_line", "bang_share")
#: Candidate thresholds of a feature: these quantiles of the labelled rows.
QUANTILES = (0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.93, 0.96, 0.98, 0.99)
CUTS = len(QUANTILES)
MOST_RULES, MOST_CONDITIONS = 8, 3
#: A rule is accepted if it is right this often on the pruning rows and covers so many bad ones.
LEAST_PRECISION, LEAST_COVER = 0.9, 3
#: Positions inside a text that fit beside a hash in one long; longer texts skip the hash filter.
POSITION_BITS = 21


def _repeated_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more.

    Windows with equal hashes are the candidates; those are compared as text.  Both steps sort
    numbers or short structs inside the row: no shuffle, and n log n for a long text.
    """
    low = (1 << POSITION_BITS) - 1

    def window(ws: Column, i: Column) -> Column:
        return F.concat_ws(" ", F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2))

    def neighbours(items: Column, key) -> Column:
        """Items of a sorted array whose key is that of the item before or after."""
        return F.filter(items, lambda x, i: (key(x) == key(F.get(items, i - 1))) | (key(x) == key(F.get(items, i + 1))))

    def candidates(ws: Column) -> Column:
        hashes = F.transform(
            F.sequence(F.lit(0), F.size(ws) - 3),
            lambda i: F.shiftleft(F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)), POSITION_BITS).bitwiseOR(i.cast("long")),
        )
        by_hash = bind(F.sort_array(hashes), lambda s: neighbours(s, lambda x: F.shiftrightunsigned(x, POSITION_BITS)))
        positions = F.transform(by_hash, lambda x: x.bitwiseAND(F.lit(low)).cast("int"))
        return F.when(F.size(ws) - 3 > low, F.sequence(F.lit(0), F.size(ws) - 3)).otherwise(positions)

    def exact(ws: Column, found: Column) -> Column:
        windows = F.transform(found, lambda i: F.struct(window(ws, i).alias("w"), i.alias("i")))
        return bind(F.array_sort(windows), lambda s: F.sort_array(F.transform(neighbours(s, lambda x: x["w"]), lambda x: x["i"])))

    def covered(starts: Column) -> Column:
        steps = F.sequence(F.lit(1), F.size(starts) - 1)
        inner = F.aggregate(steps, F.lit(3), lambda n, k: n + F.least(F.lit(3), F.get(starts, k) - F.get(starts, k - 1)))
        return F.when(F.size(starts) == 0, 0).when(F.size(starts) == 1, 3).otherwise(inner)

    def counted(ws: Column) -> Column:
        return bind(candidates(ws), lambda found: F.when(F.size(found) == 0, 0).otherwise(bind(exact(ws, found), covered)))

    return F.when(F.size(words) < 4, 0).otherwise(counted(words)).cast("long")


def statistics(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """The columns of the table but the text, with counts of its words, symbols and lines."""
    plain = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(plain, "\n", -1), lambda line: F.trim(F.translate(line, "\t\x0b\x0c\r", "    ")) != "")

    def of_words(ws: Column) -> Column:
        return F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.aggregate(ws, F.lit(0).cast("long"), lambda n, w: n + F.length(w)).alias("word_chars"),
            F.size(F.array_distinct(ws)).cast("long").alias("n_distinct"),
            _repeated_words(ws).alias("n_repeat_words"),
        )

    def of_lines(ls: Column) -> Column:
        return F.struct(F.size(ls).cast("long").alias("n_lines"), (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"))

    keep = [c for c in docs.columns if c not in (text, "_w", "_l", *COUNTS)]
    counted = docs.select(
        *keep,
        bind(words_of(F.col(text)), of_words).alias("_w"),
        bind(lines, of_lines).alias("_l"),
        (F.length(plain) - F.length(F.translate(plain, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length(plain) - F.length(F.replace(plain, F.lit("!"), F.lit("")))).cast("long").alias("n_bangs"),
    )
    return counted.select(*keep, *(F.col(f"_w.{c}") if c in WORD_COUNTS else F.col(f"_l.{c}") if c in LINE_COUNTS else F.col(c) for c in COUNTS))


WORD_COUNTS = ("n_words", "word_chars", "n_distinct", "n_repeat_words")
LINE_COUNTS = ("n_lines", "n_dup_lines")
COUNTS = (*WORD_COUNTS, *LINE_COUNTS, "n_symbols", "n_bangs")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))


def feature(name: str) -> Column:
    """A feature as a double, from the columns of ``statistics``; 0 where it would divide by 0."""
    top, below = {
        "symbol_share": ("n_symbols", "n_words"),
        "repeat_share": ("n_repeat_words", "n_words"),
        "dup_line_share": ("n_dup_lines", "n_lines"),
        "mean_word": ("word_chars", "n_words"),
        "distinct_share": ("n_distinct", "n_words"),
        "words_per_line": ("n_words", "n_lines"),
        "bang_share": ("n_bangs", "n_words"),
    }[name]
    return F.when(F.col(below) == 0, 0.0).otherwise(F.col(top) / F.col(below)).cast("double")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = feature(self.feature)
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self):
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    bad: int
    good: int

    def column(self) -> Column:
        whole = F.lit(True)
        for condition in self.conditions:
            whole &= condition.column()
        return whole

    def __str__(self):
        return f"IF {' AND '.join(map(str, self.conditions))} THEN reject  ({self.bad} bad, {self.good} good when pruned)"


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules; the first that holds rejects a document, and what no rule meets is kept."""

    rules: tuple[Rule, ...]

    def number(self) -> Column:
        """Number of the first rule that holds, from 1; null if none does."""
        found = F.lit(None).cast("int")
        for i, rule in reversed(list(enumerate(self.rules, 1))):
            found = F.when(rule.column(), i).otherwise(found)
        return found

    def rejected(self) -> Column:
        return self.number().isNotNull()


def _gain(bad: int, good: int, before: tuple[int, int]) -> float:
    """FOIL information gain of a condition."""
    from math import log2

    if not bad or not before[0]:
        return 0.0
    return bad * (log2(bad / (bad + good)) - log2(before[0] / sum(before)))


def learn(stats: DataFrame, labels: DataFrame, scratch: Scratch, *, key: str = "doc_id", label: str = "quality", bad: int = 0) -> DecisionList:
    """Learn from the rows of ``stats`` that have a label and pass the base."""
    marked = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("_key"), (F.col(label) == bad).alias("bad"))
    rows = stats.where(~base_failed()).join(marked, stats[key] == F.col("_key"))
    # A fixed third of the documents prunes; the split depends on the id alone.
    rows = rows.select(F.pmod(F.xxhash64("_key"), F.lit(3)).alias("fold"), "bad", *(feature(f).alias(f) for f in FEATURES))
    rows = scratch.put(rows, "labelled")
    cuts = _cuts(rows)
    if not cuts:
        return DecisionList(())
    # The bin of a value is the number of thresholds below it: value > cuts[j] exactly if bin > j.
    bins = rows.select("bad", (F.col("fold") != 0).alias("grows"), F.array(*(_bin(f, cuts[f]) for f in FEATURES)).alias("bins"))
    bins = scratch.put(bins, "bins")

    rules: list[Rule] = []
    left = F.lit(True)
    while len(rules) < MOST_RULES:
        chosen = _grow(bins.where(left), cuts)
        rule, tests = _prune(bins.where(left), chosen, cuts)
        if rule is None:
            break
        rules.append(rule)
        left &= ~tests
    return DecisionList(tuple(rules))


def _cuts(rows: DataFrame) -> dict[str, list[float]]:
    """Distinct thresholds of each feature, from quantile sketches of bounded size."""
    found = rows.agg(F.count(F.lit(1)).alias("n"), *(F.percentile_approx(f, list(QUANTILES), 10_000).alias(f) for f in FEATURES)).first()
    return {f: sorted(set(found[f])) for f in FEATURES} if found["n"] else {}


def _bin(name: str, cuts: list[float]) -> Column:
    return sum((F.when(F.col(name) > c, 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")


def _test(choice: tuple[int, bool, int]) -> Column:
    at, above, cut = choice
    value = F.get("bins", F.lit(at))
    return value > cut if above else value <= cut


def _tests(choices) -> Column:
    whole = F.lit(True)
    for choice in choices:
        whole &= _test(choice)
    return whole


def _grow(bins: DataFrame, cuts: dict[str, list[float]]) -> list[tuple[int, bool, int]]:
    chosen: list[tuple[int, bool, int]] = []
    while len(chosen) < MOST_CONDITIONS:
        rows = bins.where("grows").where(_tests(chosen)).select("bad", F.posexplode("bins").alias("at", "bin"))
        counts = {(r["at"], r["bin"], r["bad"]): r["n"] for r in rows.groupBy("at", "bin", "bad").agg(F.count(F.lit(1)).alias("n")).collect()}
        best, choice = 0.0, None
        for at, name in enumerate(FEATURES):
            by_bin = [[counts.get((at, b, bad), 0) for bad in (True, False)] for b in range(len(cuts[name]) + 1)]
            total = tuple(sum(x[i] for x in by_bin) for i in (0, 1))
            if not total[1]:
                return chosen  # nothing good is covered any more
            low = [0, 0]
            for cut in range(len(cuts[name])):
                low = [low[0] + by_bin[cut][0], low[1] + by_bin[cut][1]]
                for above, (n_bad, n_good) in ((False, low), (True, [total[0] - low[0], total[1] - low[1]])):
                    gain = _gain(n_bad, n_good, total)
                    if gain > best + 1e-9:
                        best, choice = gain, (at, above, cut)
        if choice is None:
            break
        chosen.append(choice)
    return chosen


def _prune(bins: DataFrame, chosen, cuts: dict[str, list[float]]) -> tuple[Rule | None, Column | None]:
    """The prefix of the conditions with the best (bad - good) / covered on the pruning rows."""
    if not chosen:
        return None, None
    held = bins.where(~F.col("grows"))
    prefixes = [chosen[:n] for n in range(1, len(chosen) + 1)]
    sums = [F.count_if(_tests(p) & (F.col("bad") == is_bad)) for p in prefixes for is_bad in (True, False)]
    found = list(held.agg(*(s.alias(f"c{i}") for i, s in enumerate(sums))).first())
    scored = [((b - g) / (b + g), -n, b, g) for n, (b, g) in enumerate(zip(found[::2], found[1::2], strict=True)) if b + g]
    if not scored:
        return None, None
    _, n, bad, good = max(scored)
    if bad < LEAST_COVER or bad < LEAST_PRECISION * (bad + good):
        return None, None
    kept = prefixes[-n]
    conditions = tuple(Condition(FEATURES[at], above, cuts[FEATURES[at]][cut]) for at, above, cut in kept)
    return Rule(conditions, bad, good), _tests(kept)


def apply_rules(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Statistics, ``base_failed``, the number of the rejecting rule and ``kept`` of every document."""
    scratch = Scratch(docs.sparkSession, "quality")
    names = [c for c in docs.columns if c == key]
    stats = scratch.put(statistics(docs.select(*names, text), text=text), "statistics")
    rules = learn(stats, labels, scratch, key=key)
    failed = base_failed()
    return stats.withColumns({"base_failed": failed, "rule": rules.number(), "kept": ~failed & ~rules.rejected()})
