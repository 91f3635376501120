"""Quality rules as a learned decision list.

Sequential covering: on labelled statistics, grow a conjunction of thresholds by information
gain until it holds no clean text, prune its last conditions on held-out rows, keep it
if it is precise there, take out what it covers, and go on. The list becomes one ordered
Spark conditional expression: the first rule that fires decides, no rule keeps the text.

The list is learned from at most about ``FIT_ROWS`` labelled documents (picked by the hash of
their id; the driver receives one row of numbers for each). Statistics are taken over
whole texts of all documents.

Defined cases: null texts have no words, so the base check fails them; repeated rows each get
their row; without labels the list is empty and the base check alone decides; an empty
table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from smelter.llm.common import written
from smelter.llm.quality_eb import FIT_ROWS, fit_evidence, sampled, strongest, worst_labels
from smelter.llm.textstats import STATISTICS, Base, base_of, split_words, statistics

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: A rule has to be this precise on held-out rows; a list and a rule have so many parts at most.
PRECISION, MAX_RULES, MAX_CONDITIONS = 0.9, 24, 4
#: Thresholds tried for a statistic: quantiles of its values.
CUTS = 48

MEASURED = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
            + ", ".join(f"s_{name} double" for name in STATISTICS))


class Condition(NamedTuple):
    statistic: str
    above: bool
    threshold: float

    def holds(self, values: np.ndarray) -> np.ndarray:
        column = values[:, STATISTICS.index(self.statistic)]
        return column >= self.threshold if self.above else column < self.threshold

    def column(self) -> Column:
        value = F.col(f"s_{self.statistic}")
        return value >= F.lit(self.threshold) if self.above else value < F.lit(self.threshold)


Rule = tuple[Condition, ...]


def covers(rule: Rule, values: np.ndarray) -> np.ndarray:
    return reduce(np.logical_and, (c.holds(values) for c in rule), np.ones(len(values), bool))


def grow(values: np.ndarray, faulty: np.ndarray) -> Rule:
    """Add the condition of most gain (faulty rows kept, weighed by purity won) until pure."""
    rule: Rule = ()
    inside = np.ones(len(values), bool)
    while len(rule) < MAX_CONDITIONS and (~faulty[inside]).any():
        p, n = faulty[inside].sum(), (~faulty[inside]).sum()
        if not p:
            break
        now, best = math.log2(p / (p + n)), (1e-9, None)
        for k, name in enumerate(STATISTICS):
            column = values[inside, k]
            for cut in np.unique(np.quantile(column, np.linspace(0, 1, CUTS + 1)[1:-1])):
                at_least = column >= cut
                for above, hit in ((True, at_least), (False, ~at_least)):
                    t = (hit & faulty[inside]).sum()
                    if t and t < p + n:
                        gain = t * (math.log2(t / hit.sum()) - now)
                        if gain > best[0]:
                            best = (gain, Condition(name, above, float(cut)))
        if best[1] is None:
            break
        rule += (best[1],)
        inside &= best[1].holds(values)
    return rule


def worth(rule: Rule, values: np.ndarray, faulty: np.ndarray) -> float:
    hit = covers(rule, values)
    p, n = (hit & faulty).sum(), (hit & ~faulty).sum()
    return (p - n) / (p + n) if p + n else -1.0


def prune(rule: Rule, values: np.ndarray, faulty: np.ndarray) -> Rule:
    """The beginning of the rule that is worth most on held-out rows; the shorter one of equals."""
    return max((rule[: i + 1] for i in range(len(rule))), key=lambda r: (worth(r, values, faulty), -len(r)))


def learn(values: np.ndarray, faulty: np.ndarray, held: np.ndarray) -> list[Rule]:
    """Rules in order. ``held`` marks the rows kept for pruning."""
    rules: list[Rule] = []
    left = np.ones(len(values), bool)
    while len(rules) < MAX_RULES:
        growing, pruning = left & ~held, left & held
        if faulty[growing].sum() < 3:
            break
        rule = grow(values[growing], faulty[growing])
        if not rule:
            break
        rule = prune(rule, values[pruning], faulty[pruning]) if pruning.any() else rule
        hit = covers(rule, values) & left
        if worth(rule, values[pruning], faulty[pruning]) < 2 * PRECISION - 1 or not (hit & faulty).any():
            break
        rules.append(rule)
        left &= ~hit
    return rules


def rejected(rules: list[Rule]) -> Column:
    """The list as one ordered conditional: the number of the rule that fires, or null."""
    chain = F.lit(None).cast("int")
    for number, rule in reversed(list(enumerate(rules))):
        chain = F.when(reduce(Column.__and__, (c.column() for c in rule)), F.lit(number)).otherwise(chain)
    return chain


def measured(docs: DataFrame, marked: dict[str, float], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Base counts and statistics of every text, one row a document."""
    names = [c.split()[0] for c in MEASURED.split(", ")]

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, float] = {}
        for batch in batches:
            rows = []
            for text in batch["_text"]:
                words = split_words(text)
                base = base_of(text, words)
                rows.append((*base, *statistics(text, words, base, strongest(marked, words, known))))
            out = pd.DataFrame(rows, columns=names[1:])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64"))
            yield out

    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return narrow.mapInPandas(measure, MEASURED)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, doc_id: str = "doc_id", text: str = "text"):
    """Marked words and the rules, learned from a bounded sample of labelled documents."""
    marks = written(worst_labels(labels, doc_id), "worst-labels")
    sample = written(sampled(marks, docs, fit_rows, doc_id, text), "fit-texts")
    marked = fit_evidence(sample).marked
    stats = measured(sample.select(F.col("_id").alias("doc_id"), F.col("_text").alias("text")), marked)
    facts = sample.select(F.col("_id").alias("doc_id"), F.greatest("low", "toxic").alias("faulty"), "fold").distinct()
    rows = stats.join(facts, "doc_id").orderBy("doc_id").collect()
    if not rows:
        return marked, []
    values = np.array([[r[f"s_{name}"] for name in STATISTICS] for r in rows])
    return marked, learn(values, np.array([r["faulty"] == 1 for r in rows]), np.array([r["fold"] == 1 for r in rows]))


def apply_rules(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Base counts, base_failed, rule (the one that fired) and kept for every document."""
    marked, rules = fit(docs, labels, fit_rows, doc_id, text)
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    rows = measured(docs, marked, doc_id, text).withColumn("rule", rejected(rules))
    return rows.select(
        "doc_id", *Base._fields, failed.alias("base_failed"),
        (~failed & F.col("rule").isNull()).alias("kept"), "rule",
    )
