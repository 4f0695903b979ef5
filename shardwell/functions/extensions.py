"""Extensions: atomizers, embedders and stores that others add, and their registration as table functions."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from shardwell.functions import code

KINDS = ("atomizer", "build_backend", "registry", "tool", "ui", "embedder")


class Extension(Protocol):
    def initialize(self) -> None: ...

    def shutdown(self) -> None: ...


@dataclass(frozen=True)
class Manifest:
    id: str
    name: str
    version: str
    kind: str
    entry: Callable[[], Extension] | None = None

    def problems(self) -> list[str]:
        out = [f"{k} is empty" for k in ("id", "name", "version") if not getattr(self, k)]
        return out + ([] if self.kind in KINDS else [f"unknown kind {self.kind}"])


class Loader:
    """Keeps loaded extensions by id."""

    def __init__(self) -> None:
        self.loaded: dict[str, tuple[Manifest, Extension | None]] = {}

    def load(self, manifests: Iterable[Manifest]) -> list[str]:
        """Loads those that are valid; the ids of the others come back."""
        bad = []
        for m in manifests:
            if m.problems():
                bad.append(m.id)
                continue
            made = m.entry() if m.entry else None
            if made:
                made.initialize()
            self.loaded[m.id] = (m, made)
        return bad

    def of_kind(self, kind: str) -> list[Manifest]:
        return [m for m, _ in self.loaded.values() if m.kind == kind]

    def unload(self, id_: str) -> bool:
        m = self.loaded.pop(id_, None)
        if m and m[1]:
            m[1].shutdown()
        return m is not None

    def shutdown(self) -> None:
        for id_ in list(self.loaded):
            self.unload(id_)


def atomizer(language: str):
    """A table function: source text to its atoms."""

    @udtf(returnType="name string, kind string, start int, end int, start_line int, end_line int")
    class Atoms:
        def eval(self, source: str):
            yield from code.atoms(source or "", language)

    return Atoms


def register(spark: SparkSession, languages: Iterable[str] = tuple(code.DEFINITIONS)) -> None:
    """Makes atoms_<language>(source) known to SQL."""
    for language in languages:
        spark.udtf.register(f"atoms_{language}", atomizer(language))
