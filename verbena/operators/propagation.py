"""Label expansion to near points, and label propagation over a nearest-neighbour graph."""

from __future__ import annotations

import logging
import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import NotFitted
from ..functions.vectors import argmax, confidence, entropy, euclidean
from ..plans.materialise import cut
from ..plans.ranking import bucket_rank
from .adapters import Encoder, encode
from .vectors import centroids, normalised, top_k

log = logging.getLogger(__name__)


class LabelExpander:
    """Give a point the label of one of its nearest centroids if most of its dimensions lie within that label's bounds."""

    def __init__(self, threshold: float = 0.5, candidates: int = 3) -> None:
        self.threshold, self.candidates = threshold, candidates
        self.table: DataFrame | None = None

    def fit(self, labelled: DataFrame, id_col: str = "id", vector_col: str = "embedding", label_col: str = "label") -> LabelExpander:
        points = normalised(labelled, id_col, vector_col, (label_col,))
        self.table = cut(centroids(points, label_col, F.col("v")))
        return self

    def transform(self, points: DataFrame, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
        """Rows (id, label); -1 where no candidate accepts. The centroids, a row a label, come to every point as one array, which is ranked in the row."""
        if self.table is None:
            raise NotFitted("call fit first")
        unit = normalised(points, id_col, vector_col)
        every = self.table.agg(F.collect_list(F.struct("label", "centroid", "low", "high")).alias("every"))  # one row
        share = lambda test: F.size(F.filter(test, lambda b: b)) / F.size("v")

        def judged(c: Column) -> Column:
            above, below = share(F.zip_with("v", c["low"], lambda x, y: x >= y)), share(F.zip_with("v", c["high"], lambda x, y: x <= y))
            return F.struct(euclidean(F.col("v"), c["centroid"]).alias("d"), c["label"].alias("label"), ((above > self.threshold) & (below > self.threshold)).alias("ok"))

        near = F.slice(F.array_sort(F.transform("every", judged)), 1, self.candidates)
        accepted = F.get(F.filter(near, lambda c: c["ok"]), F.lit(0))["label"]
        return unit.crossJoin(every).select("id", F.coalesce(accepted.cast("int"), F.lit(-1)).alias("label"))


def knn_graph(vectors: DataFrame, k: int = 20, gamma: float = 3.0) -> DataFrame:
    """Rows (i, j, w): the k nearest others of each unit vector, w = similarity ** gamma."""
    return top_k(vectors, k).select("i", "j", F.pow("sim", F.lit(gamma)).alias("w"))


def symmetrised(edges: DataFrame) -> DataFrame:
    """W + W', without a diagonal."""
    both = edges.select("i", "j", "w").union(edges.select("j", "i", "w")).toDF("i", "j", "w").where("i <> j")
    return both.groupBy("i", "j").agg(F.sum("w").alias("w"))


def degree_normalised(edges: DataFrame) -> DataFrame:
    """w / sqrt(degree_i * degree_j); a degree of 0 counts as 1."""
    degree = edges.groupBy("i").agg(F.sum("w").alias("d"))
    d = lambda name: F.when(F.col(name) == 0, 1.0).otherwise(F.col(name))
    out = edges.join(degree.select("i", F.col("d").alias("di")), "i").join(degree.select(F.col("i").alias("j"), F.col("d").alias("dj")), "j")
    return out.select("i", "j", (F.col("w") / (F.sqrt(d("di")) * F.sqrt(d("dj")))).alias("w"))


def diffuse(nodes: DataFrame, edges: DataFrame, n_classes: int, alpha: float = 0.99, tolerance: float = 1e-6, max_iterations: int = 20) -> DataFrame:
    """Solve (I - alpha W) f = y for each class by conjugate gradients: nodes (id, label), rows (id, z).

    y is 1 / class size on the class's nodes. All classes go in step, a column each; an iteration is one
    join with the edges and one aggregation, then two sums per class on the driver. A class stops when its
    residual is at most ``tolerance`` times its right side.
    """
    classes = range(n_classes)
    sizes = {r["label"]: r["n"] for r in nodes.where("label <> -1").groupBy("label").agg(F.count("*").alias("n")).collect()}
    y = [F.when(F.col("label") == c, 1.0 / sizes[c]).otherwise(0.0) if c in sizes else F.lit(0.0) for c in classes]
    state = cut(nodes.select("id", *[F.lit(0.0).alias(f"x{c}") for c in classes], *[y[c].alias(f"r{c}") for c in classes], *[y[c].alias(f"p{c}") for c in classes]))
    edges = cut(edges.repartition("j"))
    rr = [1.0 / sizes[c] if c in sizes else 0.0 for c in classes]
    limit = [tolerance * tolerance * v for v in rr]
    for _ in range(max_iterations):
        live = [rr[c] > limit[c] for c in classes]
        if not any(live):
            break
        pushed = edges.join(state.select(F.col("id").alias("j"), *[f"p{c}" for c in classes]), "j").groupBy("i").agg(*[F.sum(F.col("w") * F.col(f"p{c}")).alias(f"w{c}") for c in classes])
        joined = state.join(pushed, F.col("id") == F.col("i"), "left")
        step = cut(joined.select("id", *[f"{k}{c}" for k in "xrp" for c in classes], *[(F.col(f"p{c}") - alpha * F.coalesce(F.col(f"w{c}"), F.lit(0.0))).alias(f"q{c}") for c in classes]))
        pq = step.agg(*[F.sum(F.col(f"p{c}") * F.col(f"q{c}")).alias(f"s{c}") for c in classes]).first()
        a = [rr[c] / pq[c] if live[c] and pq[c] else 0.0 for c in classes]
        moved = step.select(
            "id",
            *[(F.col(f"x{c}") + a[c] * F.col(f"p{c}")).alias(f"x{c}") for c in classes],
            *[(F.col(f"r{c}") - a[c] * F.col(f"q{c}")).alias(f"r{c}") for c in classes],
            *[f"p{c}" for c in classes],
        )
        now = list(moved.agg(*[F.sum(F.col(f"r{c}") * F.col(f"r{c}")) for c in classes]).first())
        b = [now[c] / rr[c] if live[c] and rr[c] else 0.0 for c in classes]
        state = cut(moved.select("id", *[f"x{c}" for c in classes], *[f"r{c}" for c in classes], *[(F.col(f"r{c}") + b[c] * F.col(f"p{c}")).alias(f"p{c}") for c in classes]))
        rr = now
    return state.select("id", F.array(*[F.col(f"x{c}") for c in classes]).alias("z"))


def pseudo_labels(scores: DataFrame, gold: DataFrame, n_classes: int) -> DataFrame:
    """Rows (id, label, weight) of (id, z): the likeliest class and 1 - entropy / ln(classes), over the greatest; gold (id, label) keeps its label and weight 1."""
    if n_classes < 2:
        raise ValueError("at least two classes")
    p = scores.select("id", confidence(F.col("z")).alias("p"))
    raw = p.select("id", argmax(F.col("p")).alias("guess"), (1 - entropy(F.col("p")) / math.log(n_classes)).alias("w"))
    top = raw.agg(F.max("w").alias("top"))  # one row
    given = gold.where("label <> -1").select(F.col("id").alias("gid"), F.col("label").alias("given"))
    out = raw.crossJoin(F.broadcast(top)).join(given, F.col("id") == F.col("gid"), "left")
    return out.select("id", F.coalesce("given", "guess").cast("int").alias("label"), F.when(F.col("gid").isNotNull(), 1.0).otherwise(F.col("w") / F.col("top")).alias("weight"))


def class_weights(labelled: DataFrame, n_classes: int, label_col: str = "label") -> DataFrame:
    """Rows (label, weight): (rows / classes) / rows of the class; 0 for an empty class."""
    every = labelled.sparkSession.range(n_classes).select(F.col("id").cast("int").alias("label"))
    counts = labelled.groupBy(F.col(label_col).cast("int").alias("c")).agg(F.count("*").alias("n"))
    total = labelled.agg(F.count("*").alias("total"))  # one row
    out = every.join(counts, F.col("label") == F.col("c"), "left").crossJoin(F.broadcast(total))
    return out.select("label", F.coalesce(F.col("total") / n_classes / F.col("n"), F.lit(0.0)).alias("weight"))


def expansion_steps(gold: int, unlabelled: int, rounds: int, policy: str = "exponential") -> list[int]:
    """How many labels are kept after each round; in the last all are."""
    if policy not in ("linear", "exponential"):
        raise ValueError(f"unknown policy: {policy}")
    factor = (unlabelled / gold) ** (1 / rounds)
    out, index = [], gold
    for _ in range(rounds - 1):
        index = index + int(unlabelled / rounds + 1) if policy == "linear" else int(index * factor)
        out.append(index)
    return [*out, gold + unlabelled]


#: Cuts per round of the search for a weight, and rows near the cut that are then sorted.
CUTS = 1024
NEAR = 100_000


def select_top(labels: DataFrame, index: int, near: int = NEAR) -> DataFrame:
    """All labels but the ``index`` of greatest weight become -1 (ties by id).

    The cut is found by counting the weights between ``CUTS`` marks, and again within the stretch of the cut, until
    that has ``near`` rows at most or one weight only; those are ordered by (weight, id). No sort follows the table's size,
    but for rows of one single weight.
    """
    held = labels.agg(F.min("weight").alias("low"), F.max("weight").alias("high"), F.count("*").alias("n")).first()
    if not held["n"] or index >= held["n"]:
        return labels
    low, high, inside, left = held["low"], held["high"], held["n"], index
    while inside > near and low < high:
        width = (high - low) / CUTS
        if not low < low + width:
            break
        at = F.least(F.floor((F.col("weight") - low) / width), F.lit(CUTS - 1))
        rows = labels.where(F.col("weight").between(low, high)).groupBy(at.alias("at")).agg(F.count("*").alias("n"), F.min("weight").alias("a"), F.max("weight").alias("b")).orderBy(F.desc("at")).collect()
        for r in rows:  # at most CUTS
            if r["n"] >= left:
                break
            left -= r["n"]
        low, high, inside = r["a"], r["b"], r["n"]
    edge = labels.where(F.col("weight").between(low, high)).orderBy(F.desc("weight"), "id").limit(left).agg(F.min("weight").alias("w"), F.max_by("id", F.struct(-F.col("weight"), F.col("id"))).alias("last")).first()
    keep = (F.col("weight") > edge["w"]) | ((F.col("weight") == edge["w"]) & (F.col("id") <= edge["last"])) if left else F.col("weight") > high
    return labels.withColumn("label", F.when(keep, F.col("label")).otherwise(F.lit(-1)))


def select_stratified(labels: DataFrame, gold: DataFrame, index: int) -> DataFrame:
    """Per class, the quota int((index - gold) * the class's share among the others) plus its gold rows, by weight.

    A class is ranked by stretches of the weight, so that a large one is not one task.
    """
    marked = labels.join(gold.where("label <> -1").select(F.col("id").alias("gid")), F.col("id") == F.col("gid"), "left")
    n = marked.groupBy("label").agg(F.count("gid").alias("g"), F.sum(F.when(F.col("gid").isNull(), 1).otherwise(0)).alias("u"))
    sums = n.agg(F.sum("g").alias("all_g"), F.sum("u").alias("all_u"))  # one row
    quota = n.crossJoin(F.broadcast(sums)).select(F.col("label").alias("c"), (F.col("g") + F.floor(F.try_divide((F.lit(index) - F.col("all_g")) * F.col("u"), F.col("all_u")))).alias("quota"))
    ends = labels.agg(F.min("weight").alias("low"), F.max("weight").alias("high")).first()
    width = ((ends["high"] or 0.0) - (ends["low"] or 0.0)) / CUTS or 1.0
    stretch = F.least(F.floor((F.col("weight") - (ends["low"] or 0.0)) / width), F.lit(CUTS - 1))
    ranked = bucket_rank(labels, ["label"], stretch, [F.desc("weight"), F.col("id")], "rank", descending=True)
    out = ranked.join(quota, F.col("label") == F.col("c"), "left")
    return out.select("id", F.when(F.col("rank") <= F.coalesce("quota", F.lit(0)), F.col("label")).otherwise(F.lit(-1)).alias("label"), "weight")


def propagate(points: DataFrame, n_classes: int, k: int = 20, alpha: float = 0.99, max_iterations: int = 20, tolerance: float = 1e-6, gold: DataFrame | None = None) -> DataFrame:
    """Rows (id, label, weight) of unit vectors (id, v, label), -1 unlabelled: graph, diffusion, pseudo-labels."""
    edges = degree_normalised(symmetrised(cut(knn_graph(points, k))))
    z = diffuse(points.select("id", "label"), edges, n_classes, alpha, tolerance, max_iterations)
    return pseudo_labels(z, points.select("id", "label") if gold is None else gold, n_classes)


@dataclass
class Propagator:
    """Rounds of: encode with the model of the moment, propagate, keep the surest labels, train on them, train on the gold ones.

    ``encoder`` and ``train`` are adapters: ``train(rows (id, text, label, weight), class_weights)`` returns a loss.
    """

    n_classes: int
    encoder: Encoder
    train: Callable[[DataFrame, DataFrame], float] | None = None
    k: int = 20
    alpha: float = 0.99
    max_iterations: int = 20
    expansion_policy: str = "exponential"
    dist_policy: str = "top"
    n_times: int = 2
    callbacks: list[Callable[[dict], None]] = field(default_factory=list)

    def fit(self, docs: DataFrame, id_col: str = "id", text_col: str = "text", label_col: str = "label") -> list[dict]:
        """docs has labels, -1 where unlabelled; returns the history of the rounds, and leaves ``labels`` (id, label, weight)."""
        if self.dist_policy not in ("top", "stratified"):
            raise ValueError(f"unknown policy: {self.dist_policy}")
        corpus = cut(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label")))
        gold = corpus.select("id", "label").where("label <> -1")
        n, n_gold = corpus.count(), gold.count()
        steps = expansion_steps(n_gold, n - n_gold, self.n_times, self.expansion_policy)
        current, before, history = corpus.select("id", "label"), None, []
        for i, index in enumerate(steps):
            vectors = normalised(encode(corpus, self.encoder), "id", "embedding")
            found = cut(propagate(cut(vectors.join(current.select("id", "label"), "id")), self.n_classes, self.k, self.alpha, self.max_iterations, gold=gold))
            weights = cut(class_weights(found, self.n_classes))
            if before is None:
                changed = 1 - n_gold / n
            else:
                changed = found.join(before.select("id", F.col("label").alias("old")), "id").agg(F.avg((F.col("label") != F.col("old")).cast("double"))).first()[0]
            before = found
            if i < len(steps) - 1:
                found = cut(select_top(found, index) if self.dist_policy == "top" else select_stratified(found, gold, index))
            m = found.agg(
                F.avg((F.col("label") != -1).cast("double")).alias("ratio_labelled"), F.avg("weight").alias("conf_all"), F.avg(F.when(F.col("label") != -1, F.col("weight"))).alias("conf_labelled")
            ).first()
            row = {"iter": i, **m.asDict(), "pct_change": changed}
            if self.train:
                rows = corpus.drop("label").join(found.where("label <> -1"), "id")
                row["train_all_loss"] = self.train(rows, weights)
                row["train_gold_loss"] = self.train(corpus.where("label <> -1").withColumn("weight", F.lit(1.0)), weights)
            history.append(row)
            log.info("round %s: %s", i, row)
            for call in self.callbacks:
                call(row)
            current = found
        self.labels, self.class_weights = current, weights
        return history


def pct_change(new: DataFrame, old: DataFrame) -> DataFrame:
    """Rows (pct_change): the share of ids whose label is another one."""
    return new.join(old.select("id", F.col("label").alias("old")), "id").agg(F.avg((F.col("label") != F.col("old")).cast("double")).alias("pct_change"))
