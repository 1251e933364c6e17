"""Detectors written in Python, for matches that no pattern describes.

They receive Arrow batches, not rows. Prefer a pattern detector where one does.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, functions as F

from logsluice.functions.spans import SPANS_TYPE


class PythonDetector(Protocol):
    """What a user supplies: a name and the spans ``(start, end)`` of one text."""

    name: str

    def find(self, text: str) -> Iterator[tuple[int, int]]: ...


class PatternFinder:
    """The smallest such detector."""

    def __init__(self, name: str, pattern: str) -> None:
        self.name, self.pattern = name, pattern

    def find(self, text: str) -> Iterator[tuple[int, int]]:
        for match in re.finditer(self.pattern, text, re.ASCII):
            yield match.span()


def detect_with(detector: PythonDetector, score: float = 1.0, order: int = 0) -> Callable[[Column], Column]:
    """A function from a text column to its array of spans."""
    @F.pandas_udf(SPANS_TYPE)
    def spans(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: [
            {"start": a, "end": b, "ord": order, "type": detector.name, "text": text[a:b], "score": score}
            for a, b in (detector.find(text) if text else ())])

    return spans
