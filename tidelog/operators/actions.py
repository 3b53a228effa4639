"""User-defined message actions: how the messages of a dataset become values."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import log as L


class MessageAction(ABC):
    """What a dataset's messages mean."""

    @abstractmethod
    def resolve(self, log: DataFrame) -> DataFrame:
        """(key, value) of a log (key, seq, op, ...)."""

    def compact(self, log: DataFrame) -> DataFrame:
        """A shorter log that resolves to the same; by default the log itself."""
        return log


class Bytes(MessageAction):
    """Inserts, deletes, byte and bit upserts."""

    def resolve(self, log: DataFrame) -> DataFrame:
        return L.resolve(log)

    def compact(self, log: DataFrame) -> DataFrame:
        return L.compact(log)


class Aggregated(MessageAction):
    """An aggregate over the messages since a key's last insert or delete, such as a counter or a set."""

    def __init__(self, value: Column):
        self.value = value

    def resolve(self, log: DataFrame) -> DataFrame:
        return L.live_messages(log).groupBy("key").agg(self.value.alias("value"))


class Folded(MessageAction):
    """A Python function (value or None, message as a dict) -> value or None, for meanings that no aggregate has.

    A key's messages are folded in one task, so this is for keys with few messages.
    """

    def __init__(self, apply, value_type: str = "binary"):
        self.apply, self.value_type = apply, value_type

    def resolve(self, log: DataFrame) -> DataFrame:
        import pandas as pd

        apply = self.apply

        def fold(key, rows: pd.DataFrame) -> pd.DataFrame:
            value = None
            for message in rows.sort_values("seq").to_dict("records"):
                value = apply(value, message)
            return pd.DataFrame({"key": [key[0]], "value": [value]})

        return log.groupBy("key").applyInPandas(fold, f"key binary, value {self.value_type}").filter(F.col("value").isNotNull())
