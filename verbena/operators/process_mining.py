"""Process mining over event logs: paths of cases, their frequencies, and transitions between events.

Events of a case are ordered by time and then by tie-break columns. The log is shuffled once, by case; paths
are then counted with map-side combining.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import NotFitted

SEPARATOR = ">"


def paths(log: DataFrame, case: str, order: list[str], event: str) -> DataFrame:
    """Rows (case_id, path): the events of each case in order, as an array."""
    keys = F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in order], F.col(event).alias("__event"))))
    return log.groupBy(F.col(case).alias("case_id")).agg(keys.alias("__all")).select("case_id", F.transform("__all", lambda x: x["__event"]).alias("path"))


def path_frequencies(log: DataFrame, case: str, order: list[str], event: str) -> DataFrame:
    """Rows (path, n, probability); the path is an array."""
    counts = paths(log, case, order, event).groupBy("path").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))  # one row
    return counts.crossJoin(F.broadcast(total)).select("path", "n", (F.col("n") / F.col("total")).alias("probability"))


def transitions(log: DataFrame, case: str, order: list[str], event: str) -> DataFrame:
    """Rows (source, target, n): how often an event follows another one in a case."""
    following = F.lead(event).over(Window.partitionBy(case).orderBy(*order))
    last = F.lead(F.lit(1)).over(Window.partitionBy(case).orderBy(*order))
    pairs = log.select(F.col(event).alias("source"), following.alias("target"), last.alias("more")).where("more = 1")
    return pairs.groupBy("source", "target").agg(F.count("*").alias("n"))


class ProcessMining:
    """Fit on a log, then ask for paths and probabilities."""

    def __init__(self, case: str = "conversationId", time: str = "ts", event: str = "intent", tie_break: list[str] | None = None) -> None:
        self.case, self.event = case, event
        self.order = [time, *(tie_break or [])]
        self.sequence_frequency: DataFrame | None = None
        self.transition_matrix: DataFrame | None = None

    def fit(self, log: DataFrame) -> ProcessMining:
        self.sequence_frequency = path_frequencies(log, self.case, self.order, self.event)
        self.transition_matrix = transitions(log, self.case, self.order, self.event)
        self._events = log.select(F.col(self.event).alias("event")).distinct()
        return self

    def _fitted(self) -> DataFrame:
        if self.sequence_frequency is None:
            raise NotFitted("call fit first")
        return self.sequence_frequency

    def get_probability(self, sequence: list[str], return_probabilities: bool = True) -> float:
        """The share (or number) of cases with exactly this path; 0 for a path that never occurs."""
        table = self._fitted()
        if not sequence:
            raise ValueError("the sequence is empty")
        unknown = set(sequence) - {r["event"] for r in self._events.where(F.col("event").isin(*sequence)).collect()}
        if unknown:
            raise KeyError(f"unknown events: {sorted(unknown)}")
        row = table.where(F.col("path") == F.array(*[F.lit(x) for x in sequence])).first()
        return 0.0 if row is None else (row["probability"] if return_probabilities else float(row["n"]))

    def get_all_paths(self, return_probabilities: bool = True, threshold: float = 0.0, is_above_threshold: bool = True) -> DataFrame:
        """Rows (path, frequency) at or above the threshold, or below it, rarest first."""
        value = F.col("probability") if return_probabilities else F.col("n")
        table = self._fitted().select("path", value.alias("frequency"))
        keep = F.col("frequency") >= threshold if is_above_threshold else F.col("frequency") < threshold
        return table.where(keep).orderBy("frequency", "path")
