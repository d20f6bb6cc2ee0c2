"""Declared AI systems against observed use: inventory, risk classes and the register of processing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilkit import fixed
from veilkit.functions.globs import glob_regex
from veilkit.functions.lookups import mapped

SYSTEM_FIELDS = ("id", "name", "owner_team", "models", "use_case", "purpose")
MAX_SYSTEMS = 50_000  # above this the declarations are shuffled instead of broadcast


def check_systems(systems: Sequence[Mapping]) -> None:
    known, seen = {u[0] for u in fixed.USE_CASES}, set()
    for s in systems:
        missing = [f for f in SYSTEM_FIELDS if not s.get(f)]
        if missing:
            raise ValueError(f"system {s.get('id')!r}: missing {missing}")
        if s["use_case"] not in known:
            raise ValueError(f"system {s['id']!r}: unknown use case {s['use_case']!r}")
        if s["id"] in seen:
            raise ValueError(f"system {s['id']!r} declared twice")
        seen.add(s["id"])


def use_cases(spark: SparkSession) -> DataFrame:
    """The use-case catalogue with the obligations that follow from each risk class."""
    rows = []
    for key, label, risk, ref, applies_from in fixed.USE_CASES:
        if risk == "prohibited":
            duties = [fixed.OBLIGATION_PROHIBITED.format(ref=ref, applies_from=applies_from)]
        else:
            duties = [fixed.OBLIGATION_LITERACY]
        if risk == "high":
            duties += [*fixed.OBLIGATIONS_HIGH, fixed.OBLIGATION_HIGH_DATE.format(applies_from=applies_from)]
        if key == "chatbot_public":
            duties.append(fixed.OBLIGATION_CHATBOT)
        if key == "public_content_generation":
            duties.append(fixed.OBLIGATION_CONTENT)
        rows.append((key, label, risk, fixed.RISK_CLASS_LABELS[risk], ref, applies_from, duties))
    return spark.createDataFrame(rows, "use_case string, use_case_label string, risk string, risk_label string, "
                                       "legal_ref string, applies_from string, obligations array<string>")


def declared_systems(spark: SparkSession, systems: Sequence[Mapping]) -> DataFrame:
    check_systems(systems)
    rows = []
    for s in systems:
        owners = s["owner_team"] if isinstance(s["owner_team"], (list, tuple)) else [s["owner_team"]]
        rows.append((s["id"], s["name"], list(owners), list(s["models"]), [glob_regex(m) for m in s["models"]],
                     s["use_case"], s["purpose"], list(s.get("data_subjects") or []),
                     bool(s.get("decides_about_people"))))
    out = spark.createDataFrame(rows, "id string, name string, owner_teams array<string>, models array<string>, "
                                      "patterns array<string>, use_case string, purpose string, "
                                      "data_subjects array<string>, decides boolean")
    return F.broadcast(out) if len(rows) <= MAX_SYSTEMS else out


def _matches(usage: DataFrame, systems: DataFrame) -> DataFrame:
    """Usage rows joined to the systems that declare them: equality on team, then the model globs."""
    per_team = systems.select("id", "patterns", F.explode("owner_teams").alias("team"))
    return usage.join(per_team, "team").filter("exists(patterns, p -> model rlike p)").drop("patterns")


def declared(requests: DataFrame, systems: Sequence[Mapping]) -> DataFrame:
    """Adds `declared`: true/false, or NULL when nothing is declared at all (rules on it never match)."""
    if not systems:
        return requests.withColumn("declared", F.lit(None).cast("boolean"))
    return requests.withColumn("declared", F.expr(declared_sql(systems)))


def declared_sql(systems: Sequence[Mapping], teams: str = "array_union(teams, array(team))", model: str = "model") -> str:
    from veilkit.functions.globs import any_glob, literal

    tests = []
    for s in systems:
        owners = s["owner_team"] if isinstance(s["owner_team"], (list, tuple)) else [s["owner_team"]]
        owned = f"arrays_overlap({teams}, array({', '.join(map(literal, owners))}))"
        tests.append(f"({owned} AND {any_glob(model, s['models'])})")
    return "(" + " OR ".join(tests) + ")" if tests else "cast(NULL AS boolean)"


def inventory(usage: DataFrame, systems: Sequence[Mapping], today: str) -> DataFrame:
    """Each declared system with its class, duties, warnings and what was observed of it."""
    spark = usage.sparkSession
    declared_df = declared_systems(spark, systems)
    matched = _matches(usage, declared_df)
    observed = matched.groupBy("id").agg(
        F.sum("requests").alias("requests"), F.sum("users").alias("users"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("entities")))).alias("entities"),
        F.array_sort(F.collect_set("destination")).alias("destinations"),
        F.max("external_with_pii").alias("_external"))
    rows = (declared_df.join(F.broadcast(use_cases(spark)), "use_case").join(observed, "id", "left"))
    warnings = F.filter(F.array(
        F.when((F.col("risk") == "minimal") & F.col("decides"), F.lit(fixed.WARNING_DECIDES)),
        F.when((F.col("risk") != "prohibited") & F.col("requests").isNull(), F.lit(fixed.WARNING_NO_TRAFFIC)),
        F.when(F.col("_external") > 0, F.lit(fixed.WARNING_TRANSFER))), lambda w: w.isNotNull())
    none = F.array().cast("array<string>")
    return rows.select(
        "id", "name", "owner_teams", "models", "purpose", "use_case", "use_case_label", "risk", "risk_label",
        "legal_ref", "applies_from", (F.col("applies_from") <= F.lit(today)).alias("in_force"), "obligations",
        warnings.alias("warnings"), F.coalesce("requests", F.lit(0)).alias("requests"),
        F.coalesce("users", F.lit(0)).alias("users"), F.coalesce("entities", none).alias("entities"),
        F.coalesce("destinations", none).alias("destinations"),
    ).orderBy(mapped(F.col("risk"), fixed.RISK_CLASS_ORDER, F.lit(9)), "name")


def undeclared(usage: DataFrame, systems: Sequence[Mapping]) -> DataFrame:
    """Usage that no declaration covers (left-anti on team and model)."""
    if not systems:
        return usage
    covered = _matches(usage, declared_systems(usage.sparkSession, systems)).select("team", "model").distinct()
    return usage.join(covered, ["team", "model"], "left_anti")


def inventory_counts(inventory_rows: DataFrame, undeclared_rows: DataFrame) -> DataFrame:
    classes = ["prohibited", "high", "limited", "minimal"]
    return (
        inventory_rows.select("risk").unionByName(undeclared_rows.select(F.lit("unclassified").alias("risk")))
        .agg(*[F.count_if(F.col("risk") == c).alias(c) for c in [*classes, "unclassified"]])
    )


def register(rows: DataFrame, systems: Sequence[Mapping], retention: str,
             countries: Mapping[str, str] | None = None) -> DataFrame:
    """Draft register of processing: one row per data category. Purposes and subject groups come from
    the systems of the teams that sent the category."""
    spark = rows.sparkSession
    table = {**fixed.PROVIDER_COUNTRY, **(countries or {})}
    tagged = (
        rows.withColumn("category", mapped(F.col("entity"), fixed.REGISTER_CATEGORIES, F.lit(None).cast("string")))
        .filter("category IS NOT NULL")
        .withColumn("_provider", F.expr("if(destination = 'external', provider, NULL)"))
        .withColumn("_country", F.when(F.col("_provider").isNotNull(),
                                       mapped(F.col("_provider"), table, F.lit(fixed.REGISTER_UNKNOWN_COUNTRY))))
    )
    per_category = tagged.groupBy("category").agg(
        F.array_sort(F.collect_set("entity")).alias("types"), F.sum("requests").alias("requests"),
        F.array_sort(F.collect_set("_provider")).alias("providers"),
        F.array_sort(F.collect_set("_country")).alias("countries"),
        F.max(F.col("destination") == "external").alias("external"))
    related = (
        tagged.select("category", "team").distinct()
        .join(declared_systems(spark, systems).select("purpose", "data_subjects", F.explode("owner_teams").alias("team")),
              "team")
        .groupBy("category").agg(F.array_sort(F.collect_set("purpose")).alias("purposes"),
                                 F.array_sort(F.array_distinct(F.flatten(F.collect_set("data_subjects")))).alias("subjects"))
    )
    legal = F.array(F.lit(fixed.REGISTER_LEGAL))

    def or_legal(name):
        return F.when(F.size(name) > 0, F.col(name)).otherwise(legal).alias(name)

    return per_category.join(related, "category", "left").select(
        "category", "types", or_legal("purposes"), or_legal("subjects"),
        F.when(F.size("providers") > 0, F.array(F.lit(fixed.REGISTER_PROCESSOR)))
        .otherwise(F.array(F.lit(fixed.REGISTER_INTERNAL))).alias("recipients"),
        F.when(F.col("external"), fixed.REGISTER_YES).otherwise(fixed.REGISTER_NO).alias("abroad"),
        "countries", "providers",
        F.when(F.col("external"), fixed.REGISTER_LEGAL + fixed.REGISTER_BASIS).otherwise("-").alias("basis"),
        F.lit(retention).alias("retention"), "requests").orderBy("category")
