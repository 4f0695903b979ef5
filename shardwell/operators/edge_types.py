"""Edge types: what they mean for traversal and assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The types by strength, those that views follow by themselves, and orders of assembly and need.
STRONG = ["imports", "type_ref", "implements", "extends"]
WEAK = ["calls", "doc_ref", "tests", "macro_use"]
AUTO_EXPAND = ["imports", "type_ref", "generic_ref"]


def of_type(edges: DataFrame, types: list[str] | None) -> DataFrame:
    """Edges of the types; None: all."""
    return edges if types is None else edges.filter(F.col("edge_type").isin(types))


def strength(c: Column) -> Column:
    return F.when(c.isin(STRONG), "strong").when(c.isin(WEAK), "weak").otherwise("neither")

# Order of assembly and need, by edge type.
ASSEMBLY = {"imports": 1, "type_ref": 2, "implements": 3, "extends": 3, "generic_ref": 4, "calls": 5, "macro_use": 6, "composed_of": 10, "exports": 10, "tests": 20, "doc_ref": 20}
NEED = {"imports": "critical", "type_ref": "high", "calls": "medium", "implements": "high", "extends": "high", "generic_ref": "high", "composed_of": "low", "exports": "low", "macro_use": "medium", "tests": "low", "doc_ref": "low"}


def looked_up(c: Column, values: dict) -> Column:
    out = F.when(F.lit(False), F.lit(next(iter(values.values()))))
    for k, v in values.items():
        out = out.when(c == k, v)
    return out
