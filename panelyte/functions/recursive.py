"""Kernels that are recursive in the order of rows: one grouped Arrow pass per entity for all of them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame


def smoothed(df: DataFrame, columns: dict[str, tuple[str, float, bool]], key: str = "entity", order: str = "date") -> DataFrame:
    """df with exponential means: name -> (source column, span, adjust). adjust=False starts from the first value.

    Nulls keep the mean of before. One entity's rows are one group, in memory of one task; entities are many.
    """
    names = [f"{n} double" for n in columns]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + names)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        for name, (source, span, adjust) in columns.items():
            pdf[name] = pdf[source].astype(float).ewm(span=span, adjust=adjust, ignore_na=True).mean()
        return pdf

    return df.groupBy(key).applyInPandas(run, schema)


def macd(df: DataFrame, source: str, fast: int = 12, slow: int = 26, signal: int = 9, key: str = "entity", order: str = "date") -> DataFrame:
    """df with macd, macd_signal and macd_hist, all means started from the first value."""
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + ["macd double", "macd_signal double", "macd_hist double"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        mean = lambda x, span: x.ewm(span=span, adjust=False, ignore_na=True).mean()
        x = pdf[source].astype(float)
        pdf["macd"] = mean(x, fast) - mean(x, slow)
        pdf["macd_signal"] = mean(pdf["macd"], signal)
        pdf["macd_hist"] = pdf["macd"] - pdf["macd_signal"]
        return pdf

    return df.groupBy(key).applyInPandas(run, schema)


def exponential_pass(df: DataFrame, source: str, spans: dict[str, int], macd: bool, key: str = "entity", order: str = "date") -> DataFrame:
    """df with means (name -> span) started from the first value and, with macd, the three MACD columns: one group of
    rows an entity for all of them."""
    added = [*spans, *(["macd", "macd_signal", "macd_hist"] if macd else [])]
    kept = [f for f in df.schema.fields if f.name not in added]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"{n} double" for n in added])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        mean = lambda x, span: x.ewm(span=span, adjust=False, ignore_na=True).mean()
        x = pdf[source].astype(float)
        for name, span in spans.items():
            pdf[name] = mean(x, span)
        if macd:
            pdf["macd"] = mean(x, 12) - mean(x, 26)
            pdf["macd_signal"] = mean(pdf["macd"], 9)
            pdf["macd_hist"] = pdf["macd"] - pdf["macd_signal"]
        return pdf

    return df.select(*[f.name for f in kept]).groupBy(key).applyInPandas(run, schema)
