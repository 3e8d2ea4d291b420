"""Where models plug in: frame enrichers, detectors and text clients.

An enricher is a pandas UDF from image bytes to JSON text; those that aren't
registered leave their part empty. Models are loaded once per Python worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The parts of an enrichment, in order.
ENRICHERS = ("ocr_blocks", "actions", "poses", "camera_motion", "quality")


class Registry:
    def __init__(self):
        self.enrichers: dict[str, Callable[[Column], Column]] = {}

    def register(self, name: str, udf: Callable[[Column], Column]) -> None:
        if name not in ENRICHERS:
            raise ValueError(f"no enrichment named {name}; there are {', '.join(ENRICHERS)}")
        self.enrichers[name] = udf

    def enrich(self, frames: DataFrame, image: str = "content") -> DataFrame:
        """Adds ``enrichment``: a JSON object of what the registered enrichers say, null for the others."""
        parts = []
        for name in ENRICHERS:
            said = self.enrichers[name](F.col(image)) if name in self.enrichers else F.lit(None).cast("string")
            parts.append(F.concat(F.lit(f'"{name}":'), F.coalesce(said, F.lit("null"))))
        return frames.withColumn("enrichment", F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")))


#: Models of this Python worker by name.
_LOADED: dict[str, Callable] = {}


def run_model(frames: DataFrame, name: str, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """Applies a model to batches of frames; ``load`` runs once for a name in each Python worker."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if name not in _LOADED:
            _LOADED[name] = load()
        for pdf in batches:
            yield _LOADED[name](pdf)

    return frames.mapInPandas(run, schema)


def text_of(response: Column) -> Column:
    """The text of a client's answer: an array of parts is joined, a null one is empty."""
    return F.coalesce(F.trim(F.array_join(F.filter(response, lambda p: p.isNotNull()), "")), F.lit(""))


def json_object(text: Column) -> Column:
    """Text that is one JSON object, else null; arrays, numbers and broken text are refused."""
    parsed = F.try_parse_json(text)
    return F.when(F.schema_of_variant(parsed).startswith("OBJECT"), text)
