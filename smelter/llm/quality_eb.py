"""Quality classifier by hierarchical empirical Bayes.

Two faults are judged apart and put together at the end: low quality and toxicity. For each,
a posterior by host and by path is counted from all labelled documents: a path with few
labels is drawn to its host, a host with few to the global rate, as strongly as the
spread between groups says (a moment estimate from grouped sums). That posterior is the
prior of every document of the path. The document's own evidence comes as a likelihood
ratio: for toxicity from the strongest marked word (words and word beginnings whose
presence separates the labelled texts, calibrated on held-out labels), for quality from
a logistic regression on text statistics.

The evidence is fitted on at most about ``FIT_ROWS`` labelled documents, picked by the hash
of their id; the posteriors are counted over all labels, and every document is judged.

Defined cases: null or empty texts have no evidence, so their path decides; null source or
lang is a group like any other; a document labelled twice counts once, at its worst label;
repeated documents each get their row; without labels nothing is rejected; an empty table
gives an empty result; other columns play no part.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from smelter.llm.common import lean_batches, small_side, written
from smelter.llm.textstats import STATISTICS, base_of, lexical_features, split_words, statistics

#: Bound of the labelled documents that evidence is fitted on, and of the marked words kept.
FIT_ROWS, MARKED_WORDS = 20_000, 20_000
#: A marked word: in so many faulty texts at least, and so much likelier in them (natural log).
MARKED_DOCS, MARKED_RATIO = 6, 3.0
#: Steps of the statistics that the regression sees.
STEPS = (0.01, 0.03, 0.06, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9)
STEPPED = ("symbols", "pipes", "exclamations", "upper_words", "dup_lines", "repeat_words", "twin_words", "distinct_words")
THRESHOLD = 0.5
#: Words whose evidence a task remembers, and texts that it holds at once.
KNOWN, TEXTS = 100_000, 500


class Evidence(NamedTuple):
    """What a document's text says, as fitted: marked words, their calibration, regression."""

    marked: dict[str, float]
    bins: tuple[float, ...]
    bin_ratio: tuple[float, ...]
    weights: tuple[float, ...]

    def marked_of(self, words: list[str]) -> float:
        return strongest(self.marked, words, {})

    def toxic(self, marked: np.ndarray) -> np.ndarray:
        return np.asarray(self.bin_ratio)[np.digitize(marked, self.bins)]

    def low(self, stats: np.ndarray) -> np.ndarray:
        return design(stats) @ np.asarray(self.weights)


def strongest(marked: dict[str, float], words: list[str], known: dict[str, float]) -> float:
    """The largest value of a marked word in a text; 0 without one. ``known`` keeps words seen."""
    most = 0.0
    for word in words:
        value = known.get(word)
        if value is None:
            value = max((marked.get(f, 0.0) for f in lexical_features(word)), default=0.0)
            if len(known) > KNOWN:
                known.clear()
            known[word] = value
        if value > most:
            most = value
    return most


def design(stats: np.ndarray) -> np.ndarray:
    """Intercept and one column for each step that a statistic reaches."""
    columns = [np.ones(len(stats))]
    for name in STEPPED:
        value = stats[:, STATISTICS.index(name)]
        columns += [(value >= step).astype(float) for step in STEPS]
    return np.column_stack(columns)


def sampled(labels: DataFrame, docs: DataFrame, fit_rows: int, doc_id: str, text: str) -> DataFrame:
    """About ``fit_rows`` labelled texts at most, picked by id; half of them say ``fold`` 0."""
    share = min(1.0, fit_rows / max(labels.count(), 1))
    cut = int(share * 2**32)
    chosen = labels.withColumn("_h", F.pmod(F.xxhash64(F.lit("fit"), "_id"), F.lit(2**32))).filter(F.col("_h") < cut)
    chosen = chosen.select("_id", "low", "toxic", (F.col("_h") % 2).cast("int").alias("fold"))
    texts = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return texts.join(small_side(written(chosen, "fit-labels")), "_id")


def fit_evidence(sample: DataFrame) -> Evidence:
    """Marked words from fold 0, calibration from fold 1, regression from both.

    The driver receives the marked words and one short row of numbers for a sampled document.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, faulty = Counter(), Counter()

        def out():
            keys = list(seen)
            return pd.DataFrame({"feature": keys, "docs": [seen[k] for k in keys], "faulty": [faulty[k] for k in keys]})

        for batch in batches:
            for text, toxic in zip(batch["_text"], batch["toxic"]):
                features = {f for w in set(split_words(text)) for f in lexical_features(w)}
                seen.update(features)
                if toxic:
                    faulty.update(features)
            if len(seen) > 1_000_000:
                yield out()
                seen.clear()
                faulty.clear()
        if seen:
            yield out()

    first = sample.filter("fold = 0").select("_text", "toxic")
    totals = sample.filter("fold = 0").agg(F.count("*"), F.sum("toxic")).first()
    n, bad = totals[0] or 0, int(totals[1] or 0)
    marked: dict[str, float] = {}
    if n and bad:
        ratio = (F.log((F.col("faulty") + 0.5) / F.lit(bad + 1.0))
                 - F.log((F.col("docs") - F.col("faulty") + 0.5) / F.lit(n - bad + 1.0)))
        kept = (
            first.mapInPandas(count, "feature string, docs long, faulty long")
            .groupBy("feature").agg(F.sum("docs").alias("docs"), F.sum("faulty").alias("faulty"))
            .withColumn("ratio", ratio)
            .filter((F.col("faulty") >= MARKED_DOCS) & (F.col("ratio") >= MARKED_RATIO))
            .orderBy(F.desc(F.col("ratio") * F.sqrt("faulty")), "feature").limit(MARKED_WORDS)
        )
        marked = {r["feature"]: r["ratio"] for r in kept.select("feature", "ratio").collect()}

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, float] = {}
        for batch in batches:
            yield pd.DataFrame([
                (int(fold), int(low), int(toxic), list(_stats_of(text, marked, known)))
                for text, low, toxic, fold in zip(batch["_text"], batch["low"], batch["toxic"], batch["fold"])
            ], columns=["fold", "low", "toxic", "stats"])

    rows = sample.mapInPandas(measure, "fold int, low int, toxic int, stats array<double>").collect()
    if not rows:
        return Evidence({}, (), (0.0,), (0.0,) * (1 + len(STEPPED) * len(STEPS)))
    stats = np.array([r["stats"] for r in rows])
    low = np.array([r["low"] for r in rows], float)
    toxic = np.array([r["toxic"] for r in rows], float)
    held = np.array([r["fold"] for r in rows]) == 1
    if not held.any():
        held[:] = True
    bins = (0.01, *(MARKED_RATIO + 0.5 * i for i in range(1, 8)))
    at = np.digitize(stats[held, STATISTICS.index("marked")], bins)
    ratios = []
    for b in range(len(bins) + 1):
        t, c = toxic[held][at == b].sum(), (1 - toxic[held][at == b]).sum()
        ratios.append(math.log((t + 0.5) / (toxic[held].sum() + 1)) - math.log((c + 0.5) / ((1 - toxic[held]).sum() + 1)))
    return Evidence(marked, bins, tuple(ratios), tuple(_regression(design(stats), low)))


def _stats_of(text: str, marked: dict[str, float], known: dict[str, float]) -> tuple[float, ...]:
    words = split_words(text)
    return statistics(text, words, base_of(text, words), strongest(marked, words, known))


def _regression(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps, with the sample's own prior odds taken out."""
    odds = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    w, penalty = np.zeros(x.shape[1]), np.eye(x.shape[1]) * ridge
    penalty[0, 0] = 1e-3
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w + odds, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def worst_labels(labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One row a labelled document: low quality and toxic, 0 or 1."""
    return labels.filter(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(
        F.max((F.coalesce("quality", F.lit(1)) == 0).cast("int")).alias("low"),
        F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("int")).alias("toxic"),
    )


def strength(groups: DataFrame, faulty: str, n: str, mean: float) -> float:
    """How many labels the prior of a group weighs: moment estimate of a beta-binomial."""
    spread = groups.agg(
        F.count("*").alias("k"), F.sum(n).alias("n"), F.sum(F.col(n) * F.col(n)).alias("nn"),
        F.sum(F.col(n) * F.pow(F.col(faulty) / F.col(n) - F.lit(mean), 2)).alias("between"),
    ).first()
    k, total, variance = spread["k"], spread["n"] or 0, mean * (1 - mean)
    if k < 2 or not variance:
        return 1e6
    room = total - spread["nn"] / total
    within = (spread["between"] - (k - 1) * variance) / (variance * max(room - (k - 1), 1e-9))
    return float(np.clip((1 - within) / within if within > 0 else 1e6, 1.0, 1e6))


def path_priors(labelled: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """Posterior rates of both faults by _host and _path, and the global ones.

    ``labelled`` has _host, _path, low and toxic. Counts are summed on the map side, by path
    and then by host, so one host with a third of all rows costs a row a task.
    """
    paths = written(
        labelled.groupBy("_host", "_path").agg(F.count("*").alias("n"), F.sum("low").alias("low"), F.sum("toxic").alias("toxic")),
        "path-counts",
    )
    total = paths.agg(F.sum("n"), F.sum("low"), F.sum("toxic")).first()
    n = total[0] or 0
    means = {fault: ((total[i] or 0) + 0.5) / (n + 1) if n else 0.0 for i, fault in ((1, "low"), (2, "toxic"))}
    hosts = paths.groupBy("_host").agg(*(F.sum(c).alias(f"h_{c}") for c in ("n", "low", "toxic")))
    both = paths.join(hosts.withColumnRenamed("_host", "_h"), F.col("_host").eqNullSafe(F.col("_h")))
    columns = {}
    for fault, mean in means.items():
        to_global = strength(hosts, f"h_{fault}", "h_n", mean)
        to_host = strength(paths, fault, "n", mean)
        host = (F.col(f"h_{fault}") + F.lit(to_global * mean)) / (F.col("h_n") + F.lit(to_global))
        columns[f"p_{fault}"] = (F.col(fault) + F.lit(to_host) * host) / (F.col("n") + F.lit(to_host))
        columns[f"hp_{fault}"] = host
    return both.select("_host", "_path", *(v.alias(k) for k, v in columns.items())), means


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def judge(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang",
          fit_rows: int = FIT_ROWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with p_low, p_toxic and kept; all their own columns stand in ``row``."""
    docs = lean_batches(docs)
    marks = written(worst_labels(labels, doc_id), "worst-labels")
    places = docs.select(F.col(doc_id).alias("_id"), F.col(host).alias("_host"), F.col(path).alias("_path"))
    labelled = places.join(marks, "_id")
    priors, means = path_priors(labelled)
    priors = written(priors, "path-priors")
    evidence = fit_evidence(written(sampled(marks, docs, fit_rows, doc_id, text), "fit-texts"))

    @F.arrow_udf("struct<e_low double, e_toxic double, marked double>")
    def say(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, float] = {}
        for batch in texts:
            # A few texts at a time: what is held beside the batch stays small.
            parts = (batch.slice(at, TEXTS).to_pylist() for at in range(0, len(batch), TEXTS))
            stats = np.array([_stats_of(t, evidence.marked, known) for part in parts for t in part]).reshape(-1, len(STATISTICS))
            marked = stats[:, STATISTICS.index("marked")]
            said = {"e_low": evidence.low(stats), "e_toxic": evidence.toxic(marked), "marked": marked}
            yield pa.StructArray.from_arrays([pa.array(v, pa.float64()) for v in said.values()], list(said))

    judged = docs.select(
        F.struct(*docs.columns).alias("row"), say(F.coalesce(F.col(text), F.lit(""))).alias("_said")
    )
    # A path without labels falls back to its host, a host without labels to the global rate.
    by_path = priors.select(F.col("_host").alias("_h"), F.col("_path").alias("_p"), "p_low", "p_toxic")
    by_host = written(priors.groupBy(F.col("_host").alias("_h2")).agg(F.max("hp_low").alias("hp_low"), F.max("hp_toxic").alias("hp_toxic")), "host-priors")
    placed = judged.join(
        small_side(by_path),
        F.col("row")[host].eqNullSafe(F.col("_h")) & F.col("row")[path].eqNullSafe(F.col("_p")), "left",
    ).join(small_side(by_host), F.col("row")[host].eqNullSafe(F.col("_h2")), "left")
    fault = {}
    for name in ("low", "toxic"):
        prior = F.coalesce(f"p_{name}", f"hp_{name}", F.lit(means[name]))
        fault[name] = 1 / (1 + F.exp(-(_logit(prior) + F.col(f"_said.e_{name}"))))
    kept = (1 - fault["low"]) * (1 - fault["toxic"]) > 1 - THRESHOLD if any(means.values()) else F.lit(True)
    return placed.select("row", fault["low"].alias("p_low"), fault["toxic"].alias("p_toxic"), kept.alias("kept"))
