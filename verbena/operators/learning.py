"""Datasets, losses, metrics and small neural networks.

Networks are trained data-parallel: in an epoch every partition trains a copy on its own rows in batches,
and the copies are averaged, weighted by rows. Rows never reach the driver, only weights do.
"""

from __future__ import annotations

import io
import json
import logging
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import NotFitted
from ..functions.vectors import pool
from ..sources.io import Registry

log = logging.getLogger(__name__)


# ---- datasets


def class_shares(table: DataFrame, label_col: str = "label") -> DataFrame:
    """Rows (label, share) of the labelled rows: the ``auto`` class weights."""
    counts = table.where(F.col(label_col) != -1).groupBy(F.col(label_col).alias("label")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))  # one row
    return counts.crossJoin(F.broadcast(total)).select("label", (F.col("n") / F.col("total")).alias("share"))


def training_rows(table: DataFrame, label_col: str = "label", weight_col: str | None = None, class_weights: DataFrame | None = None) -> DataFrame:
    """The labelled rows with a column ``item_weight``: the row's weight times its class's (label, weight)."""
    rows = table.where(F.col(label_col) != -1)
    w = F.col(weight_col) if weight_col else F.lit(1.0)
    if class_weights is None:
        return rows.withColumn("item_weight", w)
    named = class_weights.toDF("__l", "__w")  # a row a class
    return rows.join(named, F.col(label_col) == F.col("__l")).withColumn("item_weight", w * F.col("__w")).drop("__l", "__w")


def multilabel_rows(table: DataFrame, labels_col: str, class_weights: list[float]) -> DataFrame:
    """Rows with at least one label of a 0/1 array, with ``item_weight``: the mean weight of its classes."""
    rows = table.where(F.aggregate(labels_col, F.lit(0), lambda a, x: a + x) > 0)
    w = F.array(*[F.lit(float(x)) for x in class_weights])
    own = F.filter(F.transform(labels_col, lambda x, i: F.when(x == 1, F.get(w, i))), lambda x: x.isNotNull())
    return rows.withColumn("item_weight", F.aggregate(own, F.lit(0.0), lambda a, x: a + x) / F.size(own))


def encode_tags(offsets: Column, spans: Column, tag2id: dict[str, int]) -> Column:
    """Tag ids of tokens: offsets ARRAY<STRUCT<start, end>>, spans ARRAY<STRUCT<label, start, end>>.

    The first token in a span is B, the others I; a token whose end is 0 is -100; all others 0. A later span wins.
    """
    table = F.create_map(*[F.lit(x) for pair in tag2id.items() for x in pair])

    def tag(o: Column) -> Column:
        inside = lambda t, s: (t["start"] >= s["start"]) & (t["end"] <= s["end"]) & (t["end"] != 0)

        def of(acc: Column, s: Column) -> Column:
            first = F.array_min(F.transform(F.filter(offsets, lambda t: inside(t, s)), lambda t: t["start"]))
            name = F.when(o["start"] == first, F.concat(F.lit("B"), s["label"])).otherwise(F.concat(F.lit("I"), s["label"]))
            return F.when(inside(o, s), F.element_at(table, name)).otherwise(acc)

        return F.when(o["end"] == 0, F.lit(-100)).otherwise(F.aggregate(spans, F.lit(0), of))

    return F.transform(offsets, tag)


def collate(rows: DataFrame, tokenizer, text_col: str = "text", max_length: int = 500, augmenter=None, key: Column | None = None) -> DataFrame:
    """Augment, then tokenise: ``input_ids``, ``attention_mask`` and character ``offsets`` of each text.

    ``tokenizer(texts, max_length)`` is an adapter that returns (ids, [(start, end)]) for each text; it runs over Arrow batches.
    """
    text = augmenter.augment(F.col(text_col), F.xxhash64(F.col(text_col)) if key is None else key) if augmenter else F.col(text_col)

    @F.pandas_udf("ids array<int>, offsets array<struct<start:int,end:int>>")
    def run(batch: pd.Series) -> pd.DataFrame:
        out = tokenizer(batch.fillna("").tolist(), max_length)
        return pd.DataFrame({"ids": [list(i) for i, _ in out], "offsets": [[{"start": a, "end": b} for a, b in o] for _, o in out]})

    named = rows.withColumn(text_col, text)
    out = named.withColumn("__t", run(F.col(text_col)))
    return out.select(*rows.columns, F.col("__t.ids").alias("input_ids"), F.transform("__t.ids", lambda _: F.lit(1)).alias("attention_mask"), F.col("__t.offsets").alias("offsets"))


def tag_maps(labels: list[str]) -> tuple[dict[str, int], dict[int, str]]:
    """O, then B and I of each label (without a dash): name -> id, and back."""
    names = ["O", *[p + label for label in labels for p in "BI"]]
    return {n: i for i, n in enumerate(names)}, dict(enumerate(names))


# ---- losses (numpy)


def log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=-1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=-1, keepdims=True))


def cross_entropy(logits: np.ndarray, target: np.ndarray, weight: np.ndarray | None = None, ignore: int = -100) -> np.ndarray:
    """Per element; logits (..., C), target (...) of class numbers; ignored ones are 0."""
    t = np.where(target == ignore, 0, target)
    loss = -np.take_along_axis(log_softmax(logits), t[..., None], -1)[..., 0]
    if weight is not None:
        loss = loss * np.asarray(weight)[t]
    return np.where(target == ignore, 0.0, loss)


def multitask_uncertainty(logits, targets, log_vars=(0.0, 0.0), intent_weight=None) -> np.ndarray:
    """exp(-s) * CE + s for the intent and, averaged over tokens, for the entities; a loss a row."""
    a = np.exp(-log_vars[0]) * cross_entropy(logits[0], targets[0], intent_weight) + log_vars[0]
    b = np.exp(-log_vars[1]) * cross_entropy(logits[1], targets[1]) + log_vars[1]
    return a + b.mean(axis=1)


def multitask_sigmoid(logits, targets, log_var: float = 0.0, intent_weight=None) -> np.ndarray:
    """w * CE of the intent + (1 - w) * mean CE of the entities, w = sigmoid(log_var); a loss a row."""
    w = 1 / (1 + np.exp(-log_var))
    return w * cross_entropy(logits[0], targets[0], intent_weight) + (1 - w) * cross_entropy(logits[1], targets[1]).mean(axis=1)


def _reduced(loss: np.ndarray, reduction: str):
    if reduction not in ("mean", "sum", "none"):
        raise ValueError(f"unknown reduction: {reduction}")
    return loss if reduction == "none" else getattr(loss, reduction)()


def label_smoothing_loss(pred: np.ndarray, target: np.ndarray, smoothing: float = 0.0, from_logits: bool = True, reduction: str = "sum", n_classes: int | None = None):
    """Cross-entropy with (1 - smoothing) on the true class and the rest shared by the others; target one-hot or class numbers."""
    y = np.eye(n_classes or pred.shape[1])[target] if target.ndim != pred.ndim else target.astype(float)
    if smoothing > 0:
        bias = smoothing / (y.shape[1] - 1)
        y = (1 - smoothing - bias) * y + bias
    return _reduced(-(y * (log_softmax(pred) if from_logits else np.log(pred))).sum(axis=1), reduction)


def multilabel_smoothing_loss(pred: np.ndarray, target: np.ndarray, smoothing: float = 0.0, from_logits: bool = True, keep_sum: bool = True, reduction: str = "sum", n_classes: int | None = None):
    """Binary cross-entropy a class, averaged over classes, a loss a row before the reduction."""
    y = np.eye(n_classes or pred.shape[1])[target] if target.ndim == 1 else target.astype(float)
    if smoothing > 0:
        on = y.sum(axis=1) if keep_sum else np.ones(len(y))
        bias = on * smoothing / (y.shape[1] - on)
        y = (1 - smoothing - bias)[:, None] * y + bias[:, None]
    if from_logits:
        loss = np.maximum(pred, 0) - pred * y + np.log1p(np.exp(-np.abs(pred)))
    else:
        loss = -(y * np.log(pred) + (1 - y) * np.log(1 - pred))
    return _reduced(loss.mean(axis=1), reduction)


# ---- meters and metrics


@dataclass
class AverageMeter:
    val: float = 0.0
    sum: float = 0.0
    count: int = 0

    def update(self, value: float, n: int = 1) -> None:
        self.val, self.sum, self.count = value, self.sum + value * n, self.count + n

    @property
    def avg(self) -> float:
        return self.sum / self.count if self.count else 0.0


def weighted_mean(losses: DataFrame, value: str, n: str) -> DataFrame:
    """Rows (sum, count, avg) of batch losses."""
    return losses.agg(F.sum(F.col(value) * F.col(n)).alias("sum"), F.sum(n).alias("count"), F.try_divide(F.sum(F.col(value) * F.col(n)), F.sum(n)).alias("avg"))


def classification_metrics(predictions: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """Rows (label, n, precision, recall, f1), and one of label null with the accuracy as precision and recall and the macro F1."""
    rows = predictions.select(F.col(label).alias("l"), F.col(predicted).alias("p"))
    pairs = rows.groupBy("l", "p").agg(F.count("*").alias("n"))
    per = (
        pairs.select(F.explode(F.array(F.struct(F.col("l").alias("c"), F.lit(1).alias("t"), F.lit(0).alias("q")), F.struct(F.col("p").alias("c"), F.lit(0).alias("t"), F.lit(1).alias("q")))).alias("x"), "n", (F.col("l") == F.col("p")).alias("ok"))
        .groupBy(F.col("x.c").alias("label"))
        .agg(F.sum(F.col("n") * F.col("x.t")).alias("n"), F.sum(F.col("n") * F.col("x.q")).alias("guessed"), F.sum(F.when(F.col("ok"), F.col("n") * F.col("x.t")).otherwise(0)).alias("hit"))
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    precision, recall = zero(F.try_divide("hit", "guessed")), zero(F.try_divide("hit", "n"))
    per = per.select("label", "n", precision.alias("precision"), recall.alias("recall"), zero(F.try_divide(2.0 * F.col("hit"), F.col("guessed") + F.col("n"))).alias("f1"))
    ok = rows.agg(F.avg((F.col("l") == F.col("p")).cast("double")).alias("accuracy"), F.count("*").alias("n"))
    macro = per.where("n > 0 or precision > 0").agg(F.avg("f1").alias("f1"))
    total = ok.crossJoin(macro).select(F.lit(None).cast(dict(per.dtypes)["label"]).alias("label"), "n", F.col("accuracy").alias("precision"), F.col("accuracy").alias("recall"), "f1")
    return per.unionByName(total)


#: Models by class name, for saved parameters.
MODELS = Registry()


@dataclass
class EarlyStopping:
    """Stop after ``patience`` epochs that didn't improve by more than max(alpha, pct * best)."""

    patience: int
    mode: str = "min"
    alpha: float = 0.0
    pct: float = 0.0
    best: float | None = None
    stale: int = 0

    def update(self, value: float) -> bool:
        """True if the value is a new best; ``stop`` says when to end."""
        gain = None if self.best is None else (self.best - value if self.mode == "min" else value - self.best)
        if gain is None or gain > max(self.alpha, self.pct * abs(self.best)):
            self.best, self.stale = value, 0
            return True
        self.stale += 1
        return False

    @property
    def stop(self) -> bool:
        return self.stale >= self.patience


# ---- networks (numpy)


class Linear:
    def __init__(self, n_in: int, n_out: int, rng: np.random.Generator) -> None:
        bound = 1 / np.sqrt(n_in)
        self.p = {"w": rng.uniform(-bound, bound, (n_in, n_out)), "b": rng.uniform(-bound, bound, n_out)}

    def forward(self, x, train, rng):
        self.x = x
        return x @ self.p["w"] + self.p["b"]

    def backward(self, g):
        self.g = {"w": self.x.T @ g, "b": g.sum(0)}
        return g @ self.p["w"].T


class ReLU:
    p: dict = {}

    def forward(self, x, train, rng):
        self.on = x > 0
        return x * self.on

    def backward(self, g):
        self.g = {}
        return g * self.on


class Dropout:
    p: dict = {}

    def __init__(self, rate: float = 0.2) -> None:
        self.rate = rate

    def forward(self, x, train, rng):
        self.mask = (rng.random(x.shape) >= self.rate) / (1 - self.rate) if train else 1.0
        return x * self.mask

    def backward(self, g):
        self.g = {}
        return g * self.mask


class _Norm:
    axis = 0

    def __init__(self, n: int) -> None:
        self.p = {"gamma": np.ones(n), "beta": np.zeros(n)}

    def _normalise(self, x, mean, var):
        self.inv = 1 / np.sqrt(var + 1e-5)
        self.hat = (x - mean) * self.inv
        return self.hat * self.p["gamma"] + self.p["beta"]

    def backward(self, g):
        self.g = {"gamma": (g * self.hat).sum(0), "beta": g.sum(0)}
        h = g * self.p["gamma"]
        return self.inv * (h - h.mean(self.axis, keepdims=True) - self.hat * (h * self.hat).mean(self.axis, keepdims=True))


class BatchNorm(_Norm):
    """Running statistics are kept as parameters without a gradient."""

    def __init__(self, n: int) -> None:
        super().__init__(n)
        self.p |= {"mean": np.zeros(n), "var": np.ones(n)}

    def forward(self, x, train, rng):
        if not train or len(x) < 2:
            return self._normalise(x, self.p["mean"], self.p["var"])
        mean, var = x.mean(0), x.var(0)
        self.p["mean"] = 0.9 * self.p["mean"] + 0.1 * mean
        self.p["var"] = 0.9 * self.p["var"] + 0.1 * var * len(x) / (len(x) - 1)
        return self._normalise(x, mean, var)


class LayerNorm(_Norm):
    axis = 1

    def forward(self, x, train, rng):
        return self._normalise(x, x.mean(1, keepdims=True), x.var(1, keepdims=True))


class Network:
    def __init__(self, layers: list) -> None:
        self.layers = layers
        self.m: dict = {}
        self.t = 0

    def forward(self, x, train=False, rng=None, upto: int | None = None):
        for layer in self.layers[:upto]:
            x = layer.forward(x, train, rng)
        return x

    def losses(self, rows: pd.DataFrame, kind: str, train: bool, rng) -> tuple[np.ndarray, np.ndarray]:
        """A loss a row (x, y, w), and the gradient of the outputs."""
        x = np.stack(rows["x"].to_numpy())
        return LOSSES[kind](self.forward(x, train, rng), x if kind == "mse" else rows["y"].to_numpy(), rows["w"].to_numpy())

    def backward(self, g):
        for layer in reversed(self.layers):
            g = layer.backward(g)
        return g

    def step(self, g, lr: float) -> None:
        """Backward, and one Adam step."""
        self.backward(g)
        self.t += 1
        for i, layer in enumerate(self.layers):
            for k, d in layer.g.items():
                m, v = self.m.get((i, k), (0.0, 0.0))
                m, v = 0.9 * m + 0.1 * d, 0.999 * v + 0.001 * d * d
                self.m[i, k] = (m, v)
                layer.p[k] = layer.p[k] - lr * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)

    def weights(self) -> list[np.ndarray]:
        return [layer.p[k] for layer in self.layers for k in sorted(layer.p)]

    def state(self) -> list[np.ndarray]:
        """Weights, the two moments of each (zeros before the first step), and the number of steps."""
        slots = [(i, k) for i, layer in enumerate(self.layers) for k in sorted(layer.p)]
        moments = [np.zeros_like(self.layers[i].p[k]) + self.m.get((i, k), (0.0, 0.0))[j] for j in (0, 1) for i, k in slots]
        return [*self.weights(), *moments, np.array(float(self.t))]

    def load_state(self, state: list[np.ndarray]) -> Network:
        slots = [(i, k) for i, layer in enumerate(self.layers) for k in sorted(layer.p)]
        self.load(state[: len(slots)])
        self.m = {s: (np.array(a), np.array(b)) for s, a, b in zip(slots, state[len(slots) : 2 * len(slots)], state[2 * len(slots) : 3 * len(slots)])}
        self.t = round(float(state[-1]))
        return self

    def load(self, weights: list[np.ndarray]) -> Network:
        it = iter(weights)
        for layer in self.layers:
            for k in sorted(layer.p):
                layer.p[k] = np.array(next(it))
        return self


def _mse(out, x, _):
    d = out - x
    return (d * d).mean(axis=1), 2 * d / d.size


def _softmax_loss(out, y, w):
    loss = cross_entropy(out, y) * w
    p = np.exp(log_softmax(out))
    p[np.arange(len(y)), y] -= 1
    return loss, p * w[:, None] / len(y)


#: States of so many partitions are summed in one task.
FAN = 32


def packed(arrays: list[np.ndarray]) -> bytes:
    buf = io.BytesIO()
    np.savez(buf, *arrays)
    return buf.getvalue()


def unpacked(data: bytes) -> list[np.ndarray]:
    return list(np.load(io.BytesIO(data)).values())


def summed(parts: DataFrame) -> list:
    """Rows (loss, n, state), one a partition -> at most FAN such rows of sums, level by level, so that the driver never holds a state a partition."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loss, n, total = 0.0, 0, None
        for b in batches:
            for row in b.itertuples():
                state = unpacked(row.state)
                loss, n, total = loss + row.loss, n + row.n, state if total is None else [x + y for x, y in zip(total, state)]
        if total is not None:
            yield pd.DataFrame({"loss": [loss], "n": [n], "state": [packed(total)]})

    left = parts.rdd.getNumPartitions()
    while left > FAN:
        left = -(-left // FAN)
        parts = parts.repartition(left).mapInPandas(add, "loss double, n bigint, state binary")
    return parts.collect()


LOSSES = {"mse": _mse, "softmax": _softmax_loss, "joint": None}


class JointNetwork(Network):
    """Intent of a text and tags of its tokens, over an encoder's token states.

    The intent head reads the mean of a text's states, the tag head each state; with ``shared`` it also reads the hidden
    layer of the text's intent. A loss is weighed by exp(-s) and s is added, for both tasks, with trained s.
    """

    def __init__(self, n_in: int, n_classes: int, n_tags: int, hidden: int = 256, dropout: float = 0.2, shared: bool = False, seed: int = 100) -> None:
        rng = np.random.default_rng(seed)
        self.shared, self.hidden = shared, hidden
        self.trunk = Network([Dropout(dropout), Linear(n_in, hidden, rng), LayerNorm(hidden), ReLU()])
        self.intent = Network([Dropout(dropout), Linear(hidden, n_classes, rng)])
        wide = n_in + hidden * shared
        self.tags = Network([Dropout(dropout), Linear(wide, hidden, rng), LayerNorm(hidden), ReLU(), Dropout(dropout), Linear(hidden, n_tags, rng)])
        self.tasks = _Scales()
        super().__init__([*self.trunk.layers, *self.intent.layers, *self.tags.layers, self.tasks])

    def forward(self, states: list[np.ndarray], train=False, rng=None, upto=None):
        """(intent logits a text, tag logits a token, text of each token)."""
        self.of = np.repeat(np.arange(len(states)), [len(s) for s in states])
        flat = np.concatenate(states)
        self.size = np.maximum(np.bincount(self.of, minlength=len(states)), 1)
        pooled = np.zeros((len(states), flat.shape[1]))
        np.add.at(pooled, self.of, flat)
        self.inner = self.trunk.forward(pooled / self.size[:, None], train, rng)
        wide = np.concatenate([flat, self.inner[self.of]], axis=1) if self.shared else flat
        return self.intent.forward(self.inner, train, rng), self.tags.forward(wide, train, rng), self.of

    def losses(self, rows: pd.DataFrame, kind: str, train: bool, rng):
        states = [np.array([np.asarray(v, float) for v in x]) for x in rows["x"]]
        y, w, t = rows["y"].to_numpy(), rows["w"].to_numpy(), np.concatenate([np.asarray(v, int) for v in rows["tags"]])
        intent, tags, of = self.forward(states, train, rng)
        a, gi = _softmax_loss(intent, y, w)
        each = cross_entropy(tags, t)
        b = np.bincount(of, weights=each, minlength=len(states)) / self.size * w
        p = np.exp(log_softmax(tags))
        p[np.arange(len(t)), np.where(t < 0, 0, t)] -= 1
        gt = p * ((t >= 0) * (w / self.size)[of] / len(states))[:, None]
        scale = np.exp(-self.tasks.p["s"])
        self.tasks.g = {"s": 1 - scale * np.array([a.mean(), b.mean()])}
        return scale[0] * a + scale[1] * b + self.tasks.p["s"].sum(), (scale[0] * gi, scale[1] * gt)

    def backward(self, g):
        gi, gt = g
        inner = self.intent.backward(gi)
        wide = self.tags.backward(gt)
        if self.shared:
            np.add.at(inner, self.of, wide[:, -self.hidden :])
        return self.trunk.backward(inner)


class _Scales:
    """The logarithms of the two tasks' variances."""

    def __init__(self) -> None:
        self.p, self.g = {"s": np.zeros(2)}, {}


@dataclass
class Trainer:
    """Epochs of partition-parallel Adam with averaging (of weights and moments), early stopping and the best weights kept."""

    network: Network
    kind: str = "mse"
    batch_size: int = 64
    lr: float = 1e-3
    n_epochs: int = 50
    early_stopping: int = 8
    seed: int = 100
    callbacks: list = field(default_factory=list)
    #: Epoch -> factor of ``lr``; and where to go on after ``load_checkpoint``.
    schedule: Callable[[int], float] | None = None
    first_epoch: int = 0

    def fit(self, rows: DataFrame, features: str, label: str | None = None, weight: str | None = None, validation: DataFrame | None = None, metrics: dict | None = None, tags: str | None = None) -> list[dict]:
        """The history of the epochs. Without ``validation`` the training rows are checked.

        ``metrics`` are named functions of a DataFrame with (y, logits, predicted), each to a number; the first decides the stopping (greater is better).
        """
        cast = "array<array<double>>" if self.kind == "joint" else "array<double>"
        columns = [F.col(features).cast(cast).alias("x"), *([F.col(tags).cast("array<int>").alias("tags")] if tags else []), (F.col(label).cast("int") if label else F.lit(0)).alias("y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w")]
        data = rows.select(*columns).where("x is not null")
        held = data if validation is None else validation.select(*columns).where("x is not null")
        if self.kind not in LOSSES:
            raise ValueError(f"unknown kind: {self.kind}")
        network, batch, kind = self.network, self.batch_size, self.kind
        stopper, best, history = EarlyStopping(self.early_stopping, "max" if metrics else "min"), network.weights(), []

        def epoch(number: int, learn: bool, lr: float):
            seed = self.seed + number

            def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                # each copy draws its own masks and orders, the same again if its task runs again
                rng, total, n = np.random.default_rng([seed, TaskContext.get().partitionId()]), 0.0, 0
                for pdf in batches:
                    order = rng.permutation(len(pdf)) if learn else np.arange(len(pdf))
                    for at in range(0, len(pdf), batch):
                        part = pdf.iloc[order[at : at + batch]]
                        loss, g = network.losses(part, kind, learn, rng)
                        total, n = total + float(loss.sum()), n + len(part)
                        if learn:
                            network.step(g, lr)
                if n:
                    yield pd.DataFrame({"loss": [total], "n": [n], "state": [packed([n * w for w in network.state()] if learn else [])]})

            return run

        for number in range(self.first_epoch, self.n_epochs):
            lr = self.lr * (self.schedule(number) if self.schedule else 1.0)
            # a row a partition, summed by groups of FAN before the driver takes them
            parts = summed(data.mapInPandas(epoch(number, True, lr), "loss double, n bigint, state binary"))
            n = sum(p["n"] for p in parts)
            if not n:
                break
            loaded = [unpacked(p["state"]) for p in parts]
            network.load_state([sum(w[i] for w in loaded) / n for i in range(len(loaded[0]))])
            checked = held.mapInPandas(epoch(number, False, lr), "loss double, n bigint, state binary").agg(F.sum("loss"), F.sum("n")).first()
            row = {"epoch": number, "train": sum(p["loss"] for p in parts) / n, "lr": lr, "val": checked[0] / checked[1]}
            if metrics:
                scored = predict(held, network, "x", "logits").withColumn("predicted", (F.array_position("logits", F.array_max("logits")) - 1).cast("int"))
                row |= {k: f(scored) for k, f in metrics.items()}
            history.append(row)
            log.info("epoch %s: %s", number, row)
            if stopper.update(row[next(iter(metrics))] if metrics else row["val"]):
                best = network.weights()
            for call in self.callbacks:
                call(row)
            if stopper.stop:
                break
        network.load(best)
        return history


def predict(rows: DataFrame, network: Network, features: str, out: str, upto: int | None = None) -> DataFrame:
    """The input with a column of the network's outputs (or of an inner layer's)."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            known = [v is not None for v in b]
            y = iter(network.forward(np.stack([np.asarray(v, float) for v in b if v is not None]), upto=upto) if any(known) else ())
            yield pd.Series([next(y) if k else None for k in known], dtype=object)

    return rows.withColumn(out, run(F.col(features).cast("array<double>")))


def autoencoder_network(n_in: int, layers: list[int], seed: int = 100) -> tuple[Network, int]:
    """Linear, ReLU, batch norm and dropout 0.2 for each layer, and the mirrored decoder; and where the encoder ends."""
    rng = np.random.default_rng(seed)
    sizes, parts = [n_in, *layers], []
    for a, b in zip(sizes[:-1], sizes[1:]):
        parts += [Linear(a, b, rng), ReLU(), BatchNorm(b), Dropout(0.2)]
    end = len(parts)
    back = sizes[::-1]
    for k, (a, b) in enumerate(zip(back[:-1], back[1:])):
        parts.append(Linear(a, b, rng))
        if k < len(back) - 2:
            parts += [ReLU(), BatchNorm(b), Dropout(0.2)]
    return Network(parts), end


def intent_head(n_in: int, n_classes: int, hidden: int = 256, dropout: float = 0.2, seed: int = 100) -> Network:
    """A classifier over encoder vectors: dropout, linear, layer norm, ReLU, dropout, linear."""
    rng = np.random.default_rng(seed)
    return Network([Dropout(dropout), Linear(n_in, hidden, rng), LayerNorm(hidden), ReLU(), Dropout(dropout), Linear(hidden, n_classes, rng)])


class Autoencoder:
    """Dimensionality reduction: trained to reproduce its input, validated on the training data."""

    def __init__(self, layers: list[int], batch_size: int = 64, lr: float = 1e-3, n_epochs: int = 50, early_stopping: int = 8, seed: int = 100) -> None:
        self.layers, self.options = layers, {"batch_size": batch_size, "lr": lr, "n_epochs": n_epochs, "early_stopping": early_stopping, "seed": seed}
        self.network: Network | None = None

    def fit(self, rows: DataFrame, features: str = "embedding") -> Autoencoder:
        n_in = rows.where(F.col(features).isNotNull()).select(F.size(features)).first()[0]
        self.network, self.end = autoencoder_network(n_in, self.layers, self.options["seed"])
        self.history = Trainer(self.network, "mse", **self.options).fit(rows, features)
        return self

    def transform(self, rows: DataFrame, features: str = "embedding", out: str = "reduced") -> DataFrame:
        if self.network is None:
            raise NotFitted("call fit first")
        return predict(rows, self.network, features, out, self.end)

    def fit_transform(self, rows: DataFrame, features: str = "embedding", out: str = "reduced") -> DataFrame:
        return self.fit(rows, features).transform(rows, features, out)


class IntentClassifier:
    """A head over encoder vectors, with class and row weights."""

    def __init__(self, n_classes: int, **options) -> None:
        self.n_classes, self.options = n_classes, options
        self.network: Network | None = None

    def fit(self, rows: DataFrame, features: str = "embedding", label: str = "label", weight: str | None = None) -> IntentClassifier:
        data = training_rows(rows, label, weight)
        n_in = data.select(F.size(features)).first()[0]
        if self.network is None:
            self.network = intent_head(n_in, self.n_classes)
        self.history = Trainer(self.network, "softmax", **self.options).fit(data, features, label, "item_weight")
        return self

    def predict(self, rows: DataFrame, features: str = "embedding") -> DataFrame:
        """The input with ``logits`` and ``predicted``."""
        if self.network is None:
            raise NotFitted("call fit first")
        out = predict(rows, self.network, features, "logits")
        return out.withColumn("predicted", (F.array_position("logits", F.array_max("logits")) - 1).cast("int"))


    def encode(self, rows: DataFrame, states: str = "states", mask: str = "attention_mask", pooled: str | None = None, out: str = "embedding") -> DataFrame:
        """The input with the encoder's pooled output, or, where there is none, the mean of its token states."""
        mean = pool(doubles2(F.col(states)), F.col(mask), "mean")
        return rows.withColumn(out, F.coalesce(F.col(pooled).cast("array<double>"), mean) if pooled else mean)


def doubles2(states: Column) -> Column:
    return states.cast("array<array<double>>")


#: What a training row is made of, by the kind of model: the columns of a batch, features first.
UNPACKED = {
    "autoencoder": {"x": "embedding"},
    "transformers": {"input_ids": "input_ids", "attention_mask": "attention_mask", "y": "label", "w": "item_weight"},
    "multitask": {"input_ids": "input_ids", "attention_mask": "attention_mask", "y": "label", "tags": "tags", "w": "item_weight"},
}


def unpack(rows: DataFrame, kind: str, **columns: str) -> DataFrame:
    """The columns that a trainer of a kind reads, under its names; an autoencoder's target is its input; a missing weight is 1."""
    if kind not in UNPACKED:
        raise ValueError(f"unknown kind: {kind}")
    named = UNPACKED[kind] | columns
    parts = [(F.lit(1.0) if k == "w" and c not in rows.columns else F.col(c)).alias(k) for k, c in named.items()]
    return rows.select(*parts, *([F.col(named["x"]).alias("y")] if kind == "autoencoder" else []))


class IntentClassifierNER:
    """Intents and entity tags together: two heads over token states (``tags`` is an array of tag ids, -100 where a token doesn't count)."""

    shared = False

    def __init__(self, n_intents: int, n_ner: int, hidden: int = 256, dropout: float = 0.2, **options) -> None:
        self.sizes, self.options = (n_intents, n_ner, hidden, dropout), options
        self.network: JointNetwork | None = None

    def fit(self, rows: DataFrame, states: str = "states", label: str = "label", tags: str = "tags", weight: str | None = None) -> IntentClassifierNER:
        """Texts without a token are left out."""
        data = training_rows(rows, label, weight).where(F.size(states) > 0)
        n_in = data.select(F.size(F.col(states)[0])).first()[0]
        if self.network is None:
            self.network = JointNetwork(n_in, *self.sizes, shared=self.shared)
        self.history = Trainer(self.network, "joint", **self.options).fit(data, states, label, "item_weight", tags=tags)
        return self

    def predict(self, rows: DataFrame, states: str = "states") -> DataFrame:
        """The input with ``predicted`` and ``predicted_tags``; null and empty where a text has no token."""
        if self.network is None:
            raise NotFitted("call fit first")
        network = self.network

        @F.pandas_udf("predicted int, predicted_tags array<int>")
        def run(batch: pd.Series) -> pd.DataFrame:
            known = [i for i, x in enumerate(batch) if x is not None and len(x)]
            out = [(None, [])] * len(batch)
            if known:
                intent, tags, of = network.forward([np.array([np.asarray(v, float) for v in batch.iloc[i]]) for i in known])
                best = tags.argmax(axis=1)
                for k, i in enumerate(known):
                    out[i] = (int(intent[k].argmax()), best[of == k].tolist())
            return pd.DataFrame({"predicted": pd.array([o[0] for o in out], "Int32"), "predicted_tags": [o[1] for o in out]})

        out = rows.withColumn("__p", run(F.col(states).cast("array<array<double>>")))
        return out.select(*[F.col(f"`{c}`") for c in rows.columns], "__p.predicted", "__p.predicted_tags")

    encode = IntentClassifier.encode


class IntentClassifierNERShared(IntentClassifierNER):
    """The tag head also reads the hidden layer of the text's intent."""

    shared = True


def save_checkpoint(path: str, network: Network, spark, epoch: int = 0, best: float | None = None, only_model: bool = False, lr: float | None = None) -> None:
    """Weights (and, unless ``only_model``, the optimiser's moments, epoch, best metric and learning rate) as one row of Parquet."""
    meta = {} if only_model else {"epoch": epoch, "best": best, **({} if lr is None else {"lr": lr})}
    data = packed(network.weights() if only_model else network.state())
    spark.createDataFrame([(bytearray(data), json.dumps(meta))], "weights binary, meta string").coalesce(1).write.mode("overwrite").parquet(path)


def load_checkpoint(path: str, network: Network, spark) -> dict:
    """Load the weights and the optimiser's state if it was saved; the result has ``epoch`` (the next one, for ``Trainer.first_epoch``), ``best`` and ``lr`` if they were."""
    row = spark.read.parquet(path).first()
    arrays = unpacked(row["weights"])
    meta = json.loads(row["meta"])
    if len(arrays) == len(network.weights()):
        network.load(arrays)
    else:
        network.load_state(arrays)
    return meta | {"epoch": meta["epoch"] + 1} if "epoch" in meta else meta


MODELS.add(Autoencoder)
MODELS.add(IntentClassifier)
MODELS.add(IntentClassifierNER)
MODELS.add(IntentClassifierNERShared)
