"""Settings of runs, from a JSON file over defaults, and which optional libraries are there."""

from __future__ import annotations

import importlib.util
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

from .errors import InvalidInput, within

#: Libraries that some functions need, and what for.
OPTIONAL = {"tiktoken": "token counts by a rank file", "duckdb": "the tests' oracle"}


@dataclass(frozen=True)
class Settings:
    """model, temperature and max_tokens go into batch requests; batch_size prompts go to a provider at once."""

    model: str = "gpt-4o"
    temperature: float = 0.7
    max_tokens: int = 500
    batch_size: int = 5
    top_k: int = 5
    responses: str = "responses"
    ratings: str = "ratings"
    benchmarks: str = "benchmarks"

    def __post_init__(self) -> None:
        within(self.temperature, 0, 2, "temperature")
        for name in ("max_tokens", "batch_size", "top_k"):
            within(getattr(self, name), 1, 1_000_000, name)


def load(spark: SparkSession, path: str) -> Settings:
    """Settings of a file; keys that aren't settings are an error, a missing file gives the defaults."""
    from .sources.runs import config

    found = config(spark, path)
    unknown = set(found) - {f.name for f in fields(Settings)}
    if unknown:
        raise InvalidInput(f"unknown settings: {', '.join(sorted(unknown))}")
    return Settings(**found)


def missing() -> dict[str, str]:
    """Optional libraries that aren't installed, and what they are for."""
    return {name: use for name, use in OPTIONAL.items() if importlib.util.find_spec(name) is None}
