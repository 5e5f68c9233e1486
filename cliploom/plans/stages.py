"""Replaceable pipeline stages: named functions from DataFrame to DataFrame with checked columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Stage = Callable[[DataFrame], DataFrame]


def _columns(schema: str | StructType) -> dict[str, str]:
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    return {f.name: f.dataType.simpleString() for f in schema.fields}


@dataclass
class Registry:
    """Stages by name; each may be switched off or replaced."""

    stages: dict[str, tuple[Stage, str, str]] = field(default_factory=dict)
    off: set[str] = field(default_factory=set)

    def add(self, name: str, stage: Stage, takes: str, gives: str) -> None:
        self.stages[name] = (stage, takes, gives)

    def enable(self, name: str, on: bool = True) -> None:
        (self.off.discard if on else self.off.add)(name)

    def apply(self, name: str, df: DataFrame) -> DataFrame:
        """Run one stage; ValueError where columns are missing or of another type. A stage that is off passes df on."""
        if name in self.off:
            return df
        stage, takes, gives = self.stages[name]
        self._check(name, "takes", df, takes)
        out = df.transform(stage)
        self._check(name, "gives", out, gives)
        return out

    def run(self, names: list[str], df: DataFrame) -> DataFrame:
        for name in names:
            df = self.apply(name, df)
        return df

    @staticmethod
    def _check(name: str, side: str, df: DataFrame, schema: str) -> None:
        have = _columns(df.schema)
        if wrong := {c: t for c, t in _columns(schema).items() if have.get(c) != t}:
            raise ValueError(f"stage {name} {side} {wrong}, has {({c: have.get(c) for c in wrong})}")


def per_row_model(call: Callable[[pd.Series], pd.Series], column: str, out: str, kind: str = "string") -> Stage:
    """A stage that calls a model on batches of one column (translation, sentiment, review)."""

    @F.pandas_udf(kind)
    def model(x: pd.Series) -> pd.Series:
        return call(x)

    return lambda df: df.withColumn(out, model(column))


def one_to_many_model(call: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> Stage:
    """A stage that calls a model which returns any number of rows (moments of a transcript)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield call(frame)

    return lambda df: df.mapInPandas(run, schema)


def pieces(sentences: DataFrame, most: int) -> DataFrame:
    """Sentences with `piece`: consecutive sentences of about `most` letters, to fit a model."""
    from ..operators.ordering import parts

    return parts(sentences, ["video_id"], ["sent_idx"], F.length("text"), most).withColumnRenamed("part", "piece").drop("n_parts")
