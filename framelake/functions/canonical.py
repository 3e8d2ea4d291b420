"""JSON in one form: keys sorted, no blanks, ASCII with escapes, numbers in their shortest text.

Spark writes values with the same meaning in other bytes (no escapes, ``1.0E10``);
digests of packets need the bytes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_text(text: str | None) -> str | None:
    """Null for null and for what isn't JSON; of a field that comes twice the last counts."""
    try:
        return None if text is None else json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"))
    except ValueError:
        return None


def canonical_json(text: Column) -> Column:
    """The texts in canonical form, a batch at a time; no built-in writes these bytes."""

    @F.pandas_udf("string")
    def form(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(canonical_text, na_action="ignore")

    return form(text)
