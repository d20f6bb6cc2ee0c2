"""Ordered prefix rules and constant maps, compiled to CASE expressions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilkit import fixed


def first_prefix(column: Column, rules: Iterable[tuple[str, object]], otherwise) -> Column:
    """Value of the first rule whose prefix starts the column; rules keep their order."""
    rules = list(rules)
    if not rules:
        return F.lit(otherwise)
    branches = F.when(column.startswith(rules[0][0]), F.lit(rules[0][1]))
    for prefix, value in rules[1:]:
        branches = branches.when(column.startswith(prefix), F.lit(value))
    return branches.otherwise(F.lit(otherwise))


def mapped(column: Column, table: Mapping[str, object], otherwise=None) -> Column:
    """Small constant lookup; `otherwise` may be a Column (default: the column itself)."""
    result = None
    for key, value in table.items():
        result = (F.when if result is None else result.when)(column == key, F.lit(value))
    fallback = column if otherwise is None else otherwise
    return F.lit(fallback) if result is None else result.otherwise(fallback)


def provider_of(model: Column, providers: Iterable[tuple[str, str]] = ()) -> Column:
    """Configured provider names win over the built-in guess from the model name."""
    return first_prefix(model, [*providers, *fixed.PROVIDERS], fixed.UNKNOWN_PROVIDER)


def country_of(provider: Column, countries: Mapping[str, str] | None = None,
               unknown: str = fixed.UNKNOWN_COUNTRY) -> Column:
    return mapped(provider, {**fixed.PROVIDER_COUNTRY, **(countries or {})}, F.lit(unknown))


def entity_label(entity: Column, dictionary_labels: Mapping[str, str] | None = None) -> Column:
    rest = F.lower(F.translate(F.regexp_replace(entity, "^(SECRET|KURUM)_", ""), "_", " "))
    labels = {**(dictionary_labels or {}), **fixed.ENTITY_LABELS}
    return mapped(entity, labels, F.when(entity.startswith("SECRET_"), F.concat(F.lit("Sır: "), rest))
                  .when(entity.startswith("KURUM_"), F.concat(F.lit("Kurum: "), rest)).otherwise(entity))
