"""Named transforms, renderers and hooks that a user adds: the engine's extension surface.

A renderer is a function from a DataFrame to a DataFrame (or None to pass); several may be registered for a
name, the first one that answers wins, one that fails is passed over and noted. Transforms run between the
hooks that were registered for before and after.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

Transform = Callable[[DataFrame], DataFrame | None]


@dataclass
class Extensions:
    renderers: dict[str, list[Transform]] = field(default_factory=dict)
    before: list[Callable[[str, DataFrame], None]] = field(default_factory=list)
    after: list[Callable[[str, DataFrame], None]] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)

    def renderer(self, name: str) -> Callable[[Transform], Transform]:
        def add(f: Transform) -> Transform:
            self.renderers.setdefault(name.lower(), []).append(f)
            return f

        return add

    def render(self, name: str, df: DataFrame) -> DataFrame:
        """What the first answering renderer makes of ``df``; ``df`` itself where none answers."""
        for hook in self.before:
            hook(name, df)
        out = df
        for f in self.renderers.get(name.lower(), []):
            try:
                got = f(df)
            except Exception as problem:  # a failing extension must not end the query
                self.notes.append(f"{name}: {getattr(f, '__name__', f)} failed: {problem}")
                continue
            if got is not None:
                out = got
                break
        for hook in self.after:
            hook(name, out)
        return out


def register_helpers(spark: SparkSession) -> list[str]:
    """Makes the document functions callable from SQL texts by name; returns the names."""
    from tessera.functions import documents

    for name, (function, returns) in documents.COLUMNS.items():
        spark.udf.register(name, documents.column(function, returns))
    return sorted(documents.COLUMNS)
