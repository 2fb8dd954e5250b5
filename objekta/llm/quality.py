r"""Quality rules: base limits, then a decision list learned from labelled documents. DataFrame functions only.

Statistics of a text: words [^\x20\x09-\x0D]+, their code points, symbols [#*$%&|<>], lines with a word that equal an
earlier line, words in 8-word windows that the text has twice or more, and shares made of them. A document fails the
base limits with under 20 words or with over 30 % of its words in repeated windows.

Learning is sequential covering: on a bounded sample of labelled documents (FIT_ROWS at most, in the order of a digest of
the id) a rule grows, one threshold at a time by information gain, until it covers bad documents alone; conditions that
don't help on rows held back are pruned; a rule is kept if MIN_PRECISION of what it covers is bad, in both parts. Covered
rows leave and the next rule is learned. The list becomes an ordered CASE expression: the first rule that holds rejects,
no rule keeps.

Defined cases: null and empty texts have no words and fail; labels that are null or name no document are unused; a
document with two labels counts twice in learning, and so does each document of an id that several have (FIT_ROWS rows in all); without bad labels the list is empty and the base limits decide;
repeated rows are judged alike; an empty table gives no rows; extra columns are ignored (statistics) or kept (filter_quality).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from objekta.llm.common import SPACE, solid, table

WINDOW = 8
#: Labelled documents that learning reads at most.
FIT_ROWS = 4000
MIN_PRECISION = 0.97
MIN_COVERED = 4
MOST_CONDITIONS = 3
MOST_RULES = 12
THRESHOLDS = 48

FEATURES = ("n_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "shout_share", "distinct_share", "line_words")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) >= self.threshold if self.above else F.col(self.feature) < self.threshold

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        return values[self.feature] >= self.threshold if self.above else values[self.feature] < self.threshold

    def __str__(self):
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _windows(w: Column) -> Column:
    """Hashes of the 8-word windows: of words, then of pairs, of fours and of eights."""
    double = lambda h, step: F.zip_with(h, F.slice(h, step + 1, F.size(h)), lambda x, y: F.xxhash64(x, y))
    eights = lambda fours: F.slice(double(fours, 4), 1, F.size(fours) - WINDOW + 1)
    return _let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: _let(double(h, 1), lambda twos: _let(double(twos, 2), eights)))


def statistics(documents: DataFrame, *keep: str) -> DataFrame:
    """The columns keep, then n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the shares."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    has_word = lambda line: line.rlike(r"[^\x20\x09-\x0D]")
    count = lambda kind: F.length(F.regexp_replace("body", f"[^{kind}]+", ""))
    body = F.btrim(text, F.lit(" \t\n\v\f\r"))
    split = F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, SPACE + "+"))
    a = solid(documents, *keep, body.alias("body"), split.alias("w"), F.filter(F.split(text, "\n"), has_word).alias("lines"))
    n = F.size("w")
    b = solid(
        a, *keep, n.cast("long").alias("n_words"), F.when(n > WINDOW, _windows(F.col("w"))).alias("windows"),
        F.aggregate("w", F.lit(0).cast("long"), lambda acc, x: acc + F.length(x)).alias("word_chars"),
        count(r"#*$%&|<>").cast("long").alias("n_symbols"), count("A-Z").alias("upper"), count("!?").alias("shouts"),
        F.size("lines").alias("n_lines"), F.size(F.array_distinct("lines")).alias("n_lines_distinct"), F.size(F.array_distinct("w")).alias("n_distinct"),
    )
    # Places of the windows that occur twice or more: neighbours in the order of their hashes. Few texts have any.
    ordered = F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    rest = [c for c in b.columns if c != "windows"]
    c = solid(b, *rest, ordered.alias("ordered"))
    again = lambda e, k: (F.get("ordered", k - 1)["h"] == e["h"]) | (F.get("ordered", k + 1)["h"] == e["h"])
    starts = F.sort_array(F.transform(F.filter("ordered", lambda e, k: F.coalesce(again(e, k), F.lit(False))), lambda e: e["i"]))
    c = solid(c, *rest, starts.alias("starts"))
    nothing = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    covered = F.aggregate("starts", nothing, lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"), p.alias("last")))["n"]
    d = solid(c, *rest, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), (F.col("n_lines") - F.col("n_lines_distinct")).cast("long").alias("n_dup_lines"))
    share = lambda x, of: F.coalesce(F.try_divide(F.col(x).cast("double"), F.col(of).cast("double")), F.lit(0.0))
    return solid(
        d, *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        share("word_chars", "n_words").alias("word_length"), share("n_symbols", "n_words").alias("symbol_share"), share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"), share("upper", "word_chars").alias("upper_share"), share("shouts", "n_words").alias("shout_share"),
        share("n_distinct", "n_words").alias("distinct_share"), share("n_words", "n_lines").alias("line_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _gain(bad: int, good: int, bad_before: int, good_before: int) -> float:
    """FOIL's information gain of going from one coverage to a smaller one."""
    if not bad:
        return 0.0
    return bad * (np.log2(bad / (bad + good)) - np.log2(bad_before / (bad_before + good_before)))


def _thresholds(x: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Midpoints between neighbouring quantiles of either class: a rare class gets as many as a common one."""
    share = np.linspace(0, 1, THRESHOLDS)
    at = np.unique(np.concatenate([np.quantile(x[bad], share, method="nearest"), np.quantile(x[~bad], share, method="nearest")]))
    return (at[1:] + at[:-1]) / 2


def _grow(values: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    rule: list[Condition] = []
    inside = np.ones(len(bad), dtype=bool)
    while len(rule) < MOST_CONDITIONS and (~bad[inside]).any():
        n_bad, n_good, best, gain = int(bad[inside].sum()), int((~bad[inside]).sum()), None, 1e-9
        for feature in FEATURES:
            for t in _thresholds(values[feature][inside], bad[inside]):
                for above in (True, False):
                    c = Condition(feature, above, float(t))
                    now = inside & c.holds(values)
                    p = int(bad[now].sum())
                    if p >= MIN_COVERED and (g := _gain(p, int(now.sum()) - p, n_bad, n_good)) > gain:
                        best, gain = c, g
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(values)
    return tuple(rule)


def _covered(rule: Rule, values: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, dtype=bool)
    for c in rule:
        out &= c.holds(values)
    return out


def learn(rows: list[dict]) -> list[Rule]:
    """Decision list of bounded labelled rows (the features and bad)."""
    values = {f: np.array([r[f] for r in rows], dtype=float) for f in FEATURES}
    bad = np.array([r["bad"] for r in rows], dtype=bool)
    held = np.arange(len(rows)) % 3 == 2
    rules: list[Rule] = []
    while len(rules) < MOST_RULES and bad[~held].sum() >= MIN_COVERED:
        grow = {f: v[~held] for f, v in values.items()}
        check = {f: v[held] for f, v in values.items()}
        rule = _grow(grow, bad[~held])

        def worth(r: Rule, check=check) -> float:
            c = _covered(r, check, int(held.sum()))
            p = int(bad[held][c].sum())
            return (2 * p - int(c.sum())) / max(1, int(c.sum())) if c.any() else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        covered = _covered(rule, values, len(rows))
        n, p = int(covered.sum()), int(bad[covered].sum())
        own = covered & held
        if not rule or p < MIN_COVERED or p < MIN_PRECISION * n or bad[own].sum() < MIN_PRECISION * own.sum():
            break
        rules.append(rule)
        values = {f: v[~covered] for f, v in values.items()}
        bad, held, rows = bad[~covered], held[~covered], [r for r, c in zip(rows, covered, strict=True) if not c]
    return rules


def verdict(rules: list[Rule]) -> Column:
    """True where no rule rejects: an ordered CASE."""
    out = None
    for rule in rules:
        holds = rule[0].column()
        for c in rule[1:]:
            holds = holds & c.column()
        out = F.when(holds, False) if out is None else out.when(holds, False)
    return F.lit(True) if out is None else out.otherwise(True)


def fit(documents: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> list[Rule]:
    """The decision list for labels with quality 0 (bad) and 1; reads rows labelled documents at most."""
    order = F.xxhash64(F.col("doc_id").cast("long"))
    some = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 0).alias("bad"))
    some = some.orderBy(order, "doc_id", "bad").limit(rows)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # At most rows ids, so the broadcast is bounded by the parameter.
    found = statistics(docs.join(F.broadcast(some), "doc_id"), "doc_id", "bad").where(~base_failed())
    # Documents that share an id would make more rows than labels: the limit holds for these rows, too.
    found = found.orderBy(F.xxhash64("doc_id"), "doc_id", "bad", *FEATURES).limit(rows)
    return learn([r.asDict() for r in found.collect()])


def judge(documents: DataFrame, rules: list[Rule], *keep: str) -> DataFrame:
    """The columns keep, the statistics, base_failed and kept."""
    return statistics(documents, *keep).withColumn("base_failed", base_failed()).withColumn("kept", F.when(F.col("base_failed"), False).otherwise(verdict(rules)))


def filter_quality(documents: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """The documents that are kept, with all their columns."""
    rules = fit(documents, labels, rows)
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")
    judged = judge(documents.select(row, F.col("text")), rules, "row").where("kept")
    return judged.select(*[F.col(f"row.`{c}`").alias(c) for c in documents.columns])


def op2_quality(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    rules = fit(documents, table(spark, sf_dir, "labels"))
    return judge(documents, rules, "doc_id").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
