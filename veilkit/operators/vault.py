"""Placeholders that outlive a job: a vault table per (tenant, user) scope, extended by each run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilkit import fixed
from veilkit.functions.globs import literal
from veilkit.functions.values import canonical_value, hmac_sha256
from veilkit.operators.mask import assign_placeholders

VAULT_COLUMNS = ["entity", "canon", "original", "n", "placeholder"]


def value_mac(key: bytes, entity: str = "entity", value: str = "value") -> str:
    """Keyed hash of a value's canonical form: what the persistent vault stores instead of the form."""
    return hmac_sha256(key, f"concat('value\\n', {entity}, '\\n', {canonical_value(entity, value)})")


def extend(existing: DataFrame, values: DataFrame, scope: Sequence[str], key: bytes | None = None) -> DataFrame:
    """Vault rows to append for values the scope has not seen; numbers continue after the largest one.
    With a key, canonical forms are replaced by their keyed hash on both sides."""
    if key is not None:
        values = values.withColumn("canon", F.expr(value_mac(key)))
    return assign_placeholders(values, scope, known=existing)


def lookup(rows: DataFrame, vault: DataFrame, scope: Sequence[str], key: Sequence[str], text: str = "text") -> DataFrame:
    """(row, placeholder, original or NULL) for every placeholder in the text."""
    used = list(dict.fromkeys([*scope, *key]))
    tokens = F.expr(f"array_distinct(regexp_extract_all(`{text}`, {literal(fixed.PLACEHOLDER_PATTERN)}, 0))")
    return (rows.select(*used, F.explode(tokens).alias("placeholder"))
            .join(vault.select(*scope, "placeholder", "original"), [*scope, "placeholder"], "left"))
