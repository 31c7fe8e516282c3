"""Detectors by name, and recognition as a table function of SQL.

A detector is a function from events (event_id, text, ...) to spans: the event's
columns without the text, and entity, score and match. Registered ones run by
name, several of them side by side over the same events.
"""
from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..dims import fields as fl
from ..dims import recognizers as rz
from ..functions.patterns import scanner
from . import pii

Detector = Callable[[DataFrame], DataFrame]

_DETECTORS: dict[str, Detector] = {}


def register_detector(name: str, detector: Detector, replace: bool = False) -> None:
    """Make a detector known under a name; a taken name has to be replaced on purpose."""
    if not name:
        raise ValueError("a detector needs a name")
    if name in _DETECTORS and not replace:
        raise ValueError(f"detector {name!r} is known already")
    _DETECTORS[name] = detector


def unregister_detector(name: str) -> None:
    _DETECTORS.pop(name, None)


def detectors() -> list[str]:
    return sorted(_DETECTORS)


def detect(events: DataFrame, names: Iterable[str] | None = None, text: str = "text") -> DataFrame:
    """Spans of the named detectors (all by default), with ``detector`` naming the one that found them.

    Names that nobody registered are an error. Without any detector the result
    is empty.
    """
    wanted = detectors() if names is None else list(dict.fromkeys(names))
    unknown = [n for n in wanted if n not in _DETECTORS]
    if unknown:
        raise KeyError(f"unknown detectors: {unknown}")
    keep = [c for c in events.columns if c != text]
    parts = [_DETECTORS[n](events).select(
        *keep, F.lit(n).alias("detector"), "entity", F.col("score").cast("double").alias("score"), "match") for n in wanted]
    if not parts:
        return events.select(*keep, *[F.lit(None).cast(t).alias(c) for c, t in (
            ("detector", "string"), ("entity", "string"), ("score", "double"), ("match", "string"))]).where(F.lit(False))
    return reduce(DataFrame.unionByName, parts)


register_detector("catalogue", lambda events: pii.find_spans(events))
register_detector("general", lambda events: pii.general_spans(events))
register_detector("quick", lambda events: pii.quick_scan(events))


SPAN = "entity string, pattern_no int, score double, match string, start int, `end` int"


class PiiSpans:
    """Spans of one text by the recognizers at or above a threshold; a null or empty text has none."""

    def __init__(self):
        self._tables: dict[float, tuple] = {}

    def eval(self, text: str, threshold: float):
        if not text:
            return
        threshold = fl.SPAN_THRESHOLD if threshold is None else float(threshold)
        if threshold not in self._tables:
            table = [r for r in rz.flat() if r[3] >= threshold]
            self._tables[threshold] = table, scanner(tuple(r[2] for r in table), pii.FLAGS)
        table, scan = self._tables[threshold]
        for k, hit in scan.finditer(text):
            entity, no, _, score = table[k]
            yield entity, no, float(score), hit.group(), hit.start(), hit.end()


def register_functions(spark: SparkSession) -> None:
    """``pii_spans(text, threshold)`` for SQL: ``FROM events e, LATERAL pii_spans(e.text, 0.85) s``."""
    spark.udtf.register("pii_spans", udtf(PiiSpans, returnType=SPAN))
