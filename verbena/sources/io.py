"""Sources and sinks: in-memory rows, CSV, Parquet, word vectors, configurations, model parameters and logs. No pickles."""

from __future__ import annotations

import json
import logging
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def from_texts(spark: SparkSession, texts: Iterable[str]) -> DataFrame:
    """Rows (doc_id, text), numbered in order."""
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")


def read_csv(spark: SparkSession, path: str, schema: str = "text string", header: bool = True) -> DataFrame:
    """CSV with quoted line breaks; only the columns of the schema that a query needs are parsed."""
    return spark.read.csv(path, schema=schema, header=header, multiLine=True, escape='"')


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{folder}/{name}.parquet"))


def spread(table: DataFrame) -> DataFrame:
    """Spread a scan that would keep less than half of the cores busy (a few small files) over all of them.

    A table of more files than that, as any large one, is left as it is: nothing is shuffled. Column
    pruning and filters pass through to the scan either way.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    parts = table.rdd.getNumPartitions()  # plans the scan, reads nothing
    return table.repartition(cores) if 2 * parts <= cores else table


def write_word_vectors(vectors: DataFrame, path: str) -> None:
    """Rows (word, vector)."""
    vectors.select("word", "vector").write.mode("overwrite").parquet(path)


def read_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("word string, vector array<double>").parquet(path)


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()["value"])


class Registry:
    """Classes by name, so that saved parameters name a class without code in the file."""

    def __init__(self) -> None:
        self._classes: dict[str, type] = {}

    def add(self, cls: type) -> type:
        self._classes[cls.__name__] = cls
        return cls

    def build(self, parameters: dict):
        given = dict(parameters)
        name = given.pop("class_name", None)
        if name not in self._classes:
            raise KeyError(f"class_name is {name!r}; known: {sorted(self._classes)}")
        return self._classes[name](**given)


def append_log(path: str, name: str = "verbena") -> logging.Logger:
    """A logger that appends its messages to a file of the driver."""
    logger = logging.getLogger(name)
    logger.addHandler(logging.FileHandler(path))
    logger.setLevel(logging.INFO)
    return logger


def spans(rows: DataFrame, label: str, start: str, end: str, by: str) -> DataFrame:
    """Entity rows -> rows (id, spans): ARRAY<STRUCT<label, start, end>> in order."""
    item = F.struct(F.col(start).alias("start"), F.col(end).alias("end"), F.col(label).alias("label"))
    return rows.groupBy(F.col(by).alias("id")).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["label"].alias("label"), x["start"].alias("start"), x["end"].alias("end"))).alias("spans"))
