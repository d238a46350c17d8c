"""Batch inference with a user's function, and providers with fallback.

Python functions come after all filters: Spark does not push a filter through them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH = 8

Loader = Callable[[], Callable[[list], Sequence]]


def infer(rows: DataFrame, column: str, load: Loader, result: str = "result", kind: str = "string", batch: int = BATCH) -> DataFrame:
    """Rows with the model's answer for ``column``.

    ``load`` runs once per task and gives a function from a list of values to as many
    answers; it is called with ``batch`` values at a time.
    """
    out = T.StructType([*rows.schema.fields, T.StructField(result, T._parse_datatype_string(kind))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for frame in frames:
            model = model or load()
            values = frame[column].tolist()
            answers: list = []
            for i in range(0, len(values), batch):
                answers.extend(model(values[i : i + batch]))
            yield frame.assign(**{result: answers})

    return rows.mapInPandas(run, out)


Provider = Callable[[list], Sequence]


def infer_with_fallback(
    rows: DataFrame, column: str, providers: Sequence[tuple[str, Provider]], kind: str = "string", batch: int = BATCH
) -> DataFrame:
    """Rows with value, provider and error: the first provider that answers wins.

    A provider is a function from a list of values to as many answers. An answer that is an
    exception is a failure of that value; a call that raises is one of all its values. What
    failed goes on to the next provider, again ``batch`` values at a time. Blank texts are
    skipped (all three NULL). If all fail, error holds the last failure.
    """
    out = T.StructType(
        [
            *rows.schema.fields,
            T.StructField("value", T._parse_datatype_string(kind)),
            T.StructField("provider", T.StringType()),
            T.StructField("error", T.StringType()),
        ]
    )

    def asked(call: Provider, values: list) -> Sequence:
        try:
            answers = call(values)
        except Exception as err:  # noqa: BLE001 - any failure moves on to the next provider
            return [err] * len(values)
        return answers

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame[column].tolist()
            value, provider, error = [None] * len(texts), [None] * len(texts), [None] * len(texts)
            left = [i for i, x in enumerate(texts) if x is not None and str(x).strip()]
            for name, call in providers:
                failed = []
                for lo in range(0, len(left), batch):
                    some = left[lo : lo + batch]
                    for i, answer in zip(some, asked(call, [texts[i] for i in some]), strict=True):
                        if isinstance(answer, Exception):
                            failed.append(i)
                            error[i] = f"all providers failed, last {name}: {answer}"
                        else:
                            value[i], provider[i], error[i] = answer, name, None
                left = failed
            yield frame.assign(value=value, provider=provider, error=error)

    return rows.mapInPandas(run, out)


def batch_status(
    inputs: DataFrame, column: str, providers: Sequence[tuple[str, Provider]], kind: str = "string"
) -> DataFrame:
    """One status row per input; a failure stays as a row with its error."""
    done = infer_with_fallback(inputs, column, providers, kind)
    failed = F.col("error").isNotNull()
    return done.withColumn("status", F.when(failed, "failed").otherwise("success"))
