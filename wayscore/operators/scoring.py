"""Sentiment of a driver's status: a native rule or a loaded text model.

A scorer takes a frame and adds ``sentiment``, ``score`` and ``error``.
``sentiment`` is NULL when no model could be loaded; ``error`` holds the text
of a failure on that record.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayscore import fixed
from wayscore.session import ship_package

# Takes texts and gives a record with ``label`` and ``score`` for each: a list
# of dicts, as text classifiers return them, or a pandas frame.
TextModel = Callable[[list[str]], list[dict] | pd.DataFrame]

SCORE_FIELDS = "sentiment string, score double, error string"
MISSING_INPUT = "missing input"


def rule_sentiment(speed: Column, stuck_count: Column) -> tuple[Column, Column]:
    """Many stops at low speed are negative. A stand-in, not a trained model."""
    leaning = stuck_count * 0.2 - speed * 0.1
    chance = 1 / (1 + F.exp(-leaning))
    label = F.when(stuck_count * 2 >= speed, fixed.NEGATIVE).otherwise(fixed.POSITIVE)
    return label, F.round(F.greatest(chance, 1 - chance), 4)


def score_by_rule(df: DataFrame, speed: str, stuck: str = "stuck_count") -> DataFrame:
    """Add the rule's sentiment; a missing input becomes an error on that row."""
    label, score = rule_sentiment(F.col(speed), F.col(stuck))
    pace = F.col(speed).cast("double")
    known = pace.isNotNull() & ~F.isnan(pace) & F.col(stuck).isNotNull()
    return df.withColumns(
        {
            "sentiment": F.when(known, label),
            "score": F.when(known, score),
            "error": F.when(~known, MISSING_INPUT),
        }
    )


def load_rule_model() -> TextModel:
    """The same rule as a text model: reads speed and stops from the sentence."""
    pattern = r"at (?P<speed>-?[0-9.]+) km/h .*(?:with|stuck) (?P<stops>[0-9]+) "

    def classify(texts: list[str]) -> pd.DataFrame:
        parts = pc.extract_regex(pa.array(texts, pa.string()), pattern)
        if parts.null_count:
            raise ValueError("no speed or stops in text")
        speed, stops = (
            pc.cast(pc.struct_field(parts, name), pa.float64()).to_numpy(zero_copy_only=False)
            for name in ("speed", "stops")
        )
        chance = 1 / (1 + np.exp(speed * 0.1 - stops * 0.2))
        return pd.DataFrame(
            {
                "label": np.where(stops * 2 >= speed, fixed.NEGATIVE, fixed.POSITIVE),
                "score": np.round(np.maximum(chance, 1 - chance), 4),
            }
        )

    return classify


def _scores(model: TextModel, texts: pd.Series) -> pd.DataFrame:
    """Score a batch; one that fails is halved until the failing texts stand alone."""
    try:
        found = pd.DataFrame(model(texts.tolist()))
        found.index = texts.index
        return pd.DataFrame({"sentiment": found["label"], "score": found["score"], "error": None})
    except Exception as failure:
        if len(texts) == 1:
            row = {"sentiment": None, "score": np.nan, "error": str(failure)}
            return pd.DataFrame(row, index=texts.index)
        half = len(texts) // 2
        return pd.concat([_scores(model, texts[:half]), _scores(model, texts[half:])])


def _classify(model: TextModel | str, texts: pd.Series) -> pd.DataFrame:
    """Scores in the order of ``texts``; missing texts never reach the model.

    A text in place of the model says why there is none; it becomes the error.
    """
    known = texts.dropna()
    if isinstance(model, str) or known.empty:
        why = model if isinstance(model, str) else None
        found = pd.DataFrame({"sentiment": None, "score": 0.0, "error": why}, index=known.index)
    else:
        found = _scores(model, known)
    if len(known) < len(texts):
        found = found.reindex(texts.index)
        found.loc[texts.isna(), "error"] = MISSING_INPUT
    return found


# The models of this Python worker; workers live on from task to task.
_loaded: dict[str, TextModel] = {}


def _load(key: str, load_model: Callable[[], TextModel]) -> TextModel | str:
    """The worker's model, loaded at its first task; if that fails, the reason."""
    if key not in _loaded:
        try:
            _loaded[key] = load_model()
        except Exception as failure:
            return f"model not loaded: {failure!r}"
    return _loaded[key]


def _key(load_model: Callable[[], TextModel]) -> str:
    return hashlib.sha256(cloudpickle.dumps(load_model)).hexdigest()


def text_sentiment(load_model: Callable[[], TextModel]):
    """A Pandas UDF over status texts; the model is loaded once per worker."""
    key = _key(load_model)

    @F.pandas_udf(SCORE_FIELDS)
    def sentiment(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = _load(key, load_model)
        for texts in batches:
            yield _classify(model, texts)

    return sentiment


def score_by_text(
    df: DataFrame, text: Column, load_model: Callable[[], TextModel] = load_rule_model
) -> DataFrame:
    """Add the sentiment of ``text`` through a batch model."""
    ship_package(df.sparkSession)
    scored = df.withColumn("scored", text_sentiment(load_model)(text))
    return scored.select(*df.columns, "scored.*")


def score_partitions(
    df: DataFrame,
    text: str,
    record_id: str,
    partitions: int | None = None,
    load_model: Callable[[], TextModel] = load_rule_model,
) -> DataFrame:
    """Score every part of the table as it is stored.

    With ``partitions`` it is first split evenly by the unique record id.
    """
    ship_package(df.sparkSession)
    key = _key(load_model)
    fields = T.StructType([*df.schema.fields, *T._parse_datatype_string(SCORE_FIELDS).fields])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _load(key, load_model)
        for batch in batches:
            yield pd.concat([batch, _classify(model, batch[text])], axis=1)

    split = df.repartition(partitions, record_id) if partitions else df
    return split.mapInPandas(score, fields)
