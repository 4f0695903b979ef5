"""The optional relational metadata: tables, and their constraints as checks over DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Table:
    ddl: str
    required: tuple[str, ...]
    unique: tuple[tuple[str, ...], ...] = ()
    allowed: dict[str, tuple[str, ...]] = field(default_factory=dict)
    #: column -> (table, column)
    refers: dict[str, tuple[str, str]] = field(default_factory=dict)


# The tables' columns, allowed words and references.
TABLES = {
    "chunks": Table("chunk_id string, chunk_type string, size_bytes long, content_hash string, content_type string, metadata string, created_at timestamp, updated_at timestamp, expires_at timestamp", ("chunk_id", "chunk_type", "size_bytes", "content_hash"), (("chunk_id",),), {"chunk_type": ("source", "ir", "blob", "container")}),
    "signatures": Table("chunk_id string, signer_id string, signature_algorithm string, signature binary, public_key string, signed_at timestamp", ("chunk_id", "signer_id", "signature_algorithm", "signature", "public_key"), (("chunk_id", "signer_id"),), {}, {"chunk_id": ("chunks", "chunk_id")}),
    "build_receipts": Table("chunk_id string, builder_id string, build_environment string, input_chunks string, build_command string, build_duration_ms int, built_at timestamp, signature binary", ("chunk_id", "builder_id", "build_environment", "input_chunks"), (), {}, {"chunk_id": ("chunks", "chunk_id")}),
    "trusted_signers": Table("signer_pattern string, trust_level string, description string, public_key string, added_at timestamp, added_by string", ("signer_pattern", "trust_level"), (("signer_pattern",),), {"trust_level": ("full", "verify", "minimal")}),
    "access_tokens": Table("token_hash string, name string, scopes string, created_at timestamp, expires_at timestamp, last_used_at timestamp, revoked_at timestamp", ("token_hash", "name"), (("token_hash",),)),
    "audit_log": Table("action string, resource_type string, resource_id string, actor_id string, details string, ip_address string, created_at timestamp", ("action", "resource_type")),
}


def violations(data: dict[str, DataFrame]) -> DataFrame:
    """table_name, rule, n: how many rows (keys, for uniqueness) break each rule; rules that hold are left out."""
    found = []
    for name, df in data.items():
        t = TABLES[name]
        count = lambda rows, rule, name=name: rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), F.lit(rule).alias("rule"), "n")
        found += [count(df.filter(F.col(c).isNull()), f"{c} is required") for c in t.required if c in df.columns]
        found += [count(df.filter(~F.col(c).isin(*words)), f"{c} is one of {', '.join(words)}") for c, words in t.allowed.items() if c in df.columns]
        found += [count(df.groupBy(*keys).count().filter("count > 1"), f"{', '.join(keys)} is unique") for keys in t.unique if set(keys) <= set(df.columns)]
        for c, (other, key) in t.refers.items():
            if other in data:
                lost = df.filter(F.col(c).isNotNull()).join(data[other].select(F.col(key).alias(c)).distinct(), c, "left_anti")
                found.append(count(lost, f"{c} refers to {other}"))
    return reduce(DataFrame.unionByName, found).filter("n > 0")
