"""Model steps as plug-ins: batches in, typed rows out. Nothing here runs unless a caller passes a model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.sources.io import not_done


def embed(df: DataFrame, text: str, model: Callable[[list[str]], list[list[float]]], batch: int = 256, blank: str = " ") -> DataFrame:
    """Adds embedding; the model gets lists of at most ``batch`` texts, blank ones as a placeholder."""
    schema = [*[f"`{n}` {t}" for n, t in df.dtypes], "embedding array<float>"]

    def each(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            texts = [t if isinstance(t, str) and t.strip() else blank for t in pdf[text]]
            yield pdf.assign(embedding=[v for i in range(0, len(texts), batch) for v in model(texts[i : i + batch])])

    return df.mapInPandas(each, ", ".join(schema))


def extract(df: DataFrame, key: str, text: str, model: Callable[[str], dict], schema: str, retries: int = 3) -> DataFrame:
    """key and the fields that the model finds in each text; after ``retries`` failures the task fails and Spark runs it anew."""

    def each(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            rows = []
            for k, t in zip(pdf[key], pdf[text], strict=True):
                for left in reversed(range(retries)):
                    try:
                        rows.append({key: k, **model(t)})
                        break
                    except Exception:
                        if not left:
                            raise
            yield pd.DataFrame(rows)

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInPandas(each, f"{key} {kind}, {schema}")


def embed_pending(rows: DataFrame, index: DataFrame, key: str, text: str, model) -> DataFrame:
    """The index with the rows it lacks embedded and added; rows without key or text are left out."""
    todo = not_done(rows.filter(F.col(key).isNotNull() & (F.coalesce(F.trim(text), F.lit("")) != "")), index, key)
    return index.unionByName(embed(todo, text, model).select(*index.columns))
