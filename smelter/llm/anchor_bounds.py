"""Hard negatives of anchors, found by score bounds that run down spanning trees of the anchors.

A score is the inner product of whole-number vectors. For an anchor c below its parent p in the
tree, ``score(c, x)`` differs from ``score(p, x)`` by at most ``|c - p| * |x|``, so bounds pass
from parent to child; only candidates whose bounds meet the window asked for are scored anew,
and their exact scores start narrower bounds for the anchors below.

Anchors are numbered so that neighbours share their strongest direction, and cut into blocks of
``BLOCK``; each block gets a minimum spanning tree in a task of its own. Trees travel to the
tasks in waves of at most ``WAVE_BYTES``, however many anchors there are, and all rows stream by
each wave twice: once for the positives, once for the negatives in the windows that these open.
Tasks send at most ``positives`` or ``negatives`` rows an anchor and window, and none below
the floor that the anchors of the same block, being rows themselves, already set.

Defined results: rows with a null label, a null vector or a null or non-finite component take no
part. Rows that are equal are rows of their own: a copy of an anchor is a positive of it, and
each of two equal anchors returns its rows. A null id is no anchor unless the condition says so,
sorts last among ties and comes back null. A shorter vector counts as ending in zeros. A table
without anchors gives no rows. Components so large that a score can't be told exactly in a
double stop the job with an error. Columns other than the three named ones are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from smelter.llm.common import written
from smelter.operators.numbering import number_rows

#: Anchors of one tree, bytes of vectors in one wave of trees, rows scored at once.
BLOCK, WAVE_BYTES, CHUNK = 512, 32 * 1024 * 1024, 2048

#: Whole numbers up to here are exact in a double.
EXACT = 2**53

#: Stands for a null id while rows are sorted.
NO_ID = 2**63 - 1

_TREE = "block long, place int, parent int, edge double, row long, id long, label long, q array<long>"
_TOP = "anchor long, asked long, score long, id long, row long"
RESULT = (
    "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
)


def whole_vectors(vectors: DataFrame, vector: str, scale: int) -> tuple[Column, Column]:
    """Whether a vector can take part, and its components times ``scale``, rounded down."""
    parts = F.col(vector)
    fit = F.forall(parts, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return parts.isNotNull() & fit, F.transform(parts, lambda c: F.floor(c.cast("double") * scale))


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    *,
    id: str = "vec_id",
    label: str = "label",
    vector: str = "embedding",
    scale: int = 256,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
) -> DataFrame:
    """Per anchor and positive the best rows of other labels within the window.

    Positives are the first rows of the anchor's label by falling score, then id. A negative's
    score lies between ``low`` and ``high`` percent of the positive's.
    """
    spark = vectors.sparkSession
    takes_part, q = whole_vectors(vectors, vector, scale)
    rows = written(
        vectors.filter(F.col(label).isNotNull() & takes_part).select(
            F.monotonically_increasing_id().alias("row"),
            F.coalesce(F.col(id).cast("long"), F.lit(NO_ID)).alias("id"),
            F.col(label).cast("long").alias("label"), q.alias("q"),
            F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
        ),
        "vectors",
    )
    known = rows.agg(F.max(F.size("q")), F.count_if("anchor")).first()
    width, n_anchors = known[0] or 0, known[1]
    if not n_anchors:
        return spark.createDataFrame([], RESULT)
    trees = written(_trees(rows.filter("anchor"), width), "trees")
    blocks_a_wave = max(1, WAVE_BYTES // (8 * max(width, 1) * BLOCK))
    n_waves = math.ceil(math.ceil(n_anchors / BLOCK) / blocks_a_wave)
    candidates = rows.select("row", "id", "label", "q")
    out = []
    for wave in range(n_waves):
        mine_now = trees.filter(F.floor(F.col("block") / blocks_a_wave) == wave)
        forest = _forest(mine_now, width)
        best = _first(_search(candidates, forest, positives, None), positives)
        best = written(best, "positives")
        # At most ``positives`` rows for each anchor of the wave.
        asked = _windows(best, forest)
        found = _first(_search(candidates, forest, negatives, (asked, low, high)), negatives)
        out.append(_paired(mine_now, best, found))
    return reduce(DataFrame.unionByName, out)


def _paired(anchors: DataFrame, best: DataFrame, found: DataFrame) -> DataFrame:
    """Positives and negatives of one anchor and positive score, side by side."""
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    a = anchors.select(F.col("row").alias("anchor"), known("id").alias("anchor_id"))
    p = best.select("anchor", F.col("score").alias("asked"), known("id").alias("positive_id"))
    n = found.select("anchor", "asked", "rank", known("id").alias("negative_id"), F.col("score").alias("negative_score"))
    joined = a.join(p, "anchor").join(n, ["anchor", "asked"])
    return joined.select(
        "anchor_id", "positive_id", "rank", "negative_id", F.col("asked").alias("positive_score"), "negative_score"
    )


def _first(tops: DataFrame, n: int) -> DataFrame:
    """The first rows for each anchor and window, over all tasks."""
    order = Window.partitionBy("anchor", "asked").orderBy(F.desc("score"), "id", "row")
    return tops.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


# Trees


def _trees(anchors: DataFrame, width: int) -> DataFrame:
    """Blocks of anchors with a strongest direction in common, each as a spanning tree."""
    size = F.transform("q", F.abs)
    strongest = F.array_position(size, F.array_max(size))
    keyed = anchors.select(
        "row", "id", "label", "q", (strongest * F.signum(F.get("q", (strongest - 1).cast("int")))).alias("_axis")
    )
    numbered = number_rows(keyed, [F.col("_axis"), F.col("row")], "_number")
    blocks = numbered.withColumn("block", F.floor((F.col("_number") - 1) / BLOCK)).drop("_axis", "_number")

    def grow(block: pd.DataFrame) -> pd.DataFrame:
        order, parent, edge = spanning_tree(matrix(block["q"].tolist(), width))
        block = block.iloc[order]
        return block.assign(place=np.arange(len(block)), parent=parent, edge=edge)[
            ["block", "place", "parent", "edge", "row", "id", "label", "q"]
        ]

    return blocks.groupBy("block").applyInPandas(grow, _TREE)


def spanning_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Points in the order in which they join a minimum spanning tree, with parent and edge.

    The point nearest to the middle is the root; its parent is -1.
    """
    n = len(points)
    square = (points**2).sum(axis=1)
    at = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())
    near, link = np.full(n, np.inf), np.full(n, -1)
    inside = np.zeros(n, dtype=bool)
    order, place = np.empty(n, dtype=int), np.empty(n, dtype=int)
    parent, edge = np.empty(n, dtype=int), np.zeros(n)
    for k in range(n):
        order[k], place[at], inside[at] = at, k, True
        parent[k], edge[k] = (place[link[at]], near[at]) if k else (-1, 0.0)
        distance = np.sqrt(np.maximum(square + square[at] - 2 * (points @ points[at]), 0))
        closer = ~inside & (distance < near)
        near[closer], link[closer] = distance[closer], at
        at = int(np.where(inside, np.inf, near).argmin())
    return order, parent, edge


def matrix(vectors: list, width: int) -> np.ndarray:
    """Vectors as rows, shorter ones filled with zeros."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _forest(trees: DataFrame, width: int) -> list[dict]:
    """The trees of one wave, as arrays. A wave is bounded in bytes."""
    table = trees.toPandas().sort_values(["block", "place"])
    return [
        {
            "row": own["row"].to_numpy(), "label": own["label"].to_numpy(), "parent": own["parent"].to_numpy(),
            "edge": own["edge"].to_numpy(), "points": matrix(own["q"].tolist(), width),
        }
        for _, own in table.groupby("block")
    ]


def _windows(best: DataFrame, forest: list[dict]) -> dict[int, list[int]]:
    """The different positive scores of every anchor of a wave."""
    scores: dict[int, list[int]] = {}
    for row in best.select("anchor", "score").distinct().collect():
        scores.setdefault(row["anchor"], []).append(row["score"])
    return scores


# Search


class Tops:
    """The first ``n`` rows of a window, and the score below which no row can be among them."""

    def __init__(self, n: int, asked: int, least: float, most: float):
        self.n, self.asked, self.floor, self.most = n, asked, least, most
        self.score = self.id = self.row = np.empty(0, dtype=np.int64)

    def bound(self, scores: np.ndarray) -> None:
        """Scores of rows that belong to the window: its last row is no worse than their n-th."""
        inside = scores[(scores >= self.floor) & (scores <= self.most)]
        if len(inside) >= self.n:
            self.floor = np.partition(inside, -self.n)[-self.n]

    def offer(self, score: np.ndarray, id: np.ndarray, row: np.ndarray) -> None:
        inside = (score >= self.floor) & (score <= self.most)
        if not inside.any():
            return
        score = np.concatenate([self.score, score[inside].astype(np.int64)])
        id, row = np.concatenate([self.id, id[inside]]), np.concatenate([self.row, row[inside]])
        first = np.lexsort((row, id, -score))[: self.n]
        self.score, self.id, self.row = score[first], id[first], row[first]
        if len(first) == self.n:
            self.floor = max(self.floor, self.score[-1])


def walk(tree: dict, x: np.ndarray, norms: np.ndarray, want) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Anchors from the root on, each with the rows that had to be scored and their scores.

    ``want(anchor, low, high)`` tells which rows may lie in the window of an anchor, given
    bounds on their scores; None stands for no row.
    """
    points, parent, edge = tree["points"], tree["parent"], tree["edge"]
    low, high = np.empty((2, len(points), len(x)))
    # Bounds are computed in doubles: a little room keeps them true.
    room = 1 + 1e-9 * norms * max(math.sqrt((points**2).sum(axis=1).max(initial=0)), 1)
    for c in range(len(points)):
        if parent[c] < 0:
            low[c] = high[c] = x @ points[c]
        else:
            reach = edge[c] * norms + room
            low[c], high[c] = low[parent[c]] - reach, high[parent[c]] + reach
        wanted = want(c, low[c], high[c])
        if wanted is None:
            continue
        near = np.flatnonzero(wanted)
        if parent[c] < 0:
            scores = low[c, near]
        else:
            scores = x[near] @ points[c]
            low[c, near] = high[c, near] = scores
        yield c, near, scores


def _search(candidates: DataFrame, forest: list[dict], n: int, windows) -> DataFrame:
    """The first rows of each task for every anchor: of its label, or of others in its windows."""
    sent = candidates.sparkSession.sparkContext.broadcast((forest, windows))

    def run(batches):
        forest, windows = sent.value
        tops = [_opened(tree, n, windows) for tree in forest]
        largest = max(np.abs(tree["points"]).max(initial=0) for tree in forest)
        for batch in batches:
            vectors = batch.column("q")
            width = forest[0]["points"].shape[1]
            row, id, label = (batch.column(c).to_numpy() for c in ("row", "id", "label"))
            for at in range(0, batch.num_rows, CHUNK):
                here = slice(at, at + CHUNK)
                x = dense(vectors.slice(at, CHUNK), width)
                if largest * np.abs(x).max(initial=0) * width >= EXACT:
                    raise ArithmeticError("components too large for exact scores")
                norms = np.sqrt((x**2).sum(axis=1))
                for tree, own in zip(forest, tops):
                    _offer(tree, own, x, norms, row[here], id[here], label[here], windows is not None)
        found = [
            (int(tree["row"][c]), top.asked, top)
            for tree, own in zip(forest, tops) for c, opened in enumerate(own) for top in opened if len(top.row)
        ]
        for at in range(0, len(found), 10_000):
            some = found[at : at + 10_000]
            lengths = [len(top.row) for *_, top in some]
            columns = [
                np.repeat([anchor for anchor, *_ in some], lengths), np.repeat([asked for _, asked, _ in some], lengths),
                *(np.concatenate([getattr(top, c) for *_, top in some]) for c in ("score", "id", "row")),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["anchor", "asked", "score", "id", "row"])

    return candidates.mapInArrow(run, _TOP)


def dense(vectors: pa.Array, width: int) -> np.ndarray:
    """A list array as a matrix, shorter lists filled with zeros."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    if len(flat) == len(vectors) * width:
        lengths = np.diff(vectors.offsets.to_numpy())
        if (lengths == width).all():
            return flat.reshape(-1, width).astype(float)
    return matrix(vectors.to_pylist(), width)


def _opened(tree: dict, n: int, windows) -> list[list[Tops]]:
    """Empty windows for every anchor, with the floor that the other anchors of its tree set."""
    scores = tree["points"] @ tree["points"].T
    same = tree["label"][:, None] == tree["label"][None, :]
    out = []
    for c, row in enumerate(tree["row"]):
        if windows is None:
            own = [Tops(n, 0, -np.inf, np.inf)]
            others = same[c].copy()
            others[c] = False
        else:
            asked, low, high = windows
            # Whole numbers: 100 * score lies between low and high times the positive's score.
            own = [Tops(n, p, -(-low * p // 100), high * p // 100) for p in asked.get(int(row), ()) if p >= 0]
            others = ~same[c]
        for top in own:
            top.bound(scores[c][others])
        out.append(own)
    return out


def _offer(tree, opened, x, norms, row, id, label, differs: bool) -> None:
    def want(c, low, high):
        own = opened[c]
        if not own:
            return None
        fits = (label != tree["label"][c]) if differs else (label == tree["label"][c])
        least, most = min(top.floor for top in own), max(top.most for top in own)
        return fits & (high >= least) & (low <= most)

    for c, near, scores in walk(tree, x, norms, want):
        other = row[near] != tree["row"][c]
        if not other.all():
            near, scores = near[other], scores[other]
        for top in opened[c]:
            top.offer(scores, id[near], row[near])
