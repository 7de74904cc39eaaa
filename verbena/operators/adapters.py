"""Interfaces to external models, and self-contained defaults. Nothing here pretends that a model ran."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import NoModel


class Encoder(Protocol):
    dimensions: int

    def encode(self, texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        """Batches of texts -> batches of vectors; called once a partition, so a model loads once."""


class Translator(Protocol):
    def translate(self, texts: list[str], target: str) -> list[str]: ...


class HashingEncoder:
    """Words hashed to signed buckets, L2-normalised: deterministic, without a model."""

    def __init__(self, dimensions: int = 64, seed: int = 17) -> None:
        self.dimensions, self.seed = dimensions, seed

    def encode(self, texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from zlib import crc32

        for batch in texts:
            out = []
            for t in batch:
                v = np.zeros(self.dimensions)
                for w in (t or "").lower().split():
                    h = crc32(w.encode(), self.seed)
                    v[h % self.dimensions] += 1 if h >> 31 else -1
                n = np.linalg.norm(v)
                out.append(v / n if n else v)
            yield pd.Series(out)


def device(found: Callable[[], bool] | None = None) -> str:
    """``cuda:0`` where a model can use a GPU (``found``, else the driver's device files), ``cpu`` elsewhere."""
    has = found() if found else any(Path("/dev").glob("nvidia[0-9]*"))
    return "cuda:0" if has else "cpu"


def translation_models(source: str, through: str, folder: str | None = None) -> tuple[str, str]:
    """Where the models there and back are: below a local folder if given, else by their names on a hub."""
    names = f"opus-mt-{source}-{through}", f"opus-mt-{through}-{source}"
    return tuple(str(Path(folder) / n) if folder else f"Helsinki-NLP/{n}" for n in names)


class ModelTranslator:
    """Loads one model for each direction by ``load(path, device)``, an adapter that returns texts -> texts.

    A model for several target languages is told which by a prefix; English needs none. Texts of one word
    or none are translated, with a warning, as models often make them up.
    """

    def __init__(self, load: Callable[[str, str], Callable[[list[str]], list[str]]], source: str = "en", folder: str | None = None) -> None:
        self.load, self.source, self.folder = load, source, folder
        self.models: dict[str, Callable[[list[str]], list[str]]] = {}

    def translate(self, texts: list[str], target: str) -> list[str]:
        if not texts:
            return []
        if any(len((t or "").split()) <= 1 for t in texts):
            warnings.warn("texts of one word are translated badly", stacklevel=2)
        if target not in self.models:
            there, back = translation_models(self.source, self._other(target), self.folder)
            self.models[target] = self.load(back if target == self.source else there, device())
        return self.models[target]([t if target == "en" else f">>{target}<< {t}" for t in texts])

    def _other(self, target: str) -> str:
        if target != self.source:
            self.through = target
        return self.through


class NoTranslator:
    def translate(self, texts: list[str], target: str) -> list[str]:
        raise NoModel(f"no translator to {target!r} is configured")


def encode(docs: DataFrame, encoder: Encoder, text_col: str = "text", out: str = "embedding") -> DataFrame:
    """The input with a column of vectors, by an Arrow UDF in iterator form."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from encoder.encode(batches)

    return docs.withColumn(out, run(F.col(text_col)))
