"""What a fitted operator is: a JSON-able config plus a lazy transform."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

Transform = Callable[[DataFrame, dict], DataFrame]
_TRANSFORMS: dict[str, Transform] = {}


def transform_of(operation: str) -> Callable[[Transform], Transform]:
    """Register how a config of ``operation`` is applied."""

    def register(fn: Transform) -> Transform:
        _TRANSFORMS[operation] = fn
        return fn

    return register


@dataclass(frozen=True)
class Fitted:
    """Everything a transform needs is in ``config``, so a stored config replays on new data."""

    config: dict

    def transform(self, df: DataFrame) -> DataFrame:
        return _TRANSFORMS[self.config["operation"]](df, self.config)


def replay(config: dict, df: DataFrame) -> DataFrame:
    """Apply a stored config."""
    if config.get("operation") not in _TRANSFORMS:
        raise ValueError(f"cannot replay operation {config.get('operation')!r}")
    return Fitted(config).transform(df)
