"""Notifications: which channels an event goes to, suppression of repeats, message payloads."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilkit import fixed
from veilkit.functions.globs import any_glob, literal
from veilkit.functions.values import in_list
from veilkit.operators.ordered import numbered, range_buckets
from veilkit.operators.policy import effective_action, severity
from veilkit.session import materialize

SOURCE = "CASE api_format WHEN 'browser' THEN 'browser' WHEN 'icap' THEN 'network' ELSE 'gateway' END"
_RULES = "concat(rules, output_rules)"
_CONDITIONS = {"actions", "rules", "entity_in", "teams", "sources"}


def _matches(when: Mapping) -> str:
    unknown = set(when) - _CONDITIONS
    if unknown:
        raise ValueError(f"unknown channel conditions {sorted(unknown)}")
    tests = []
    if "actions" in when:
        tests.append(in_list(effective_action(), when["actions"]))
    if "rules" in when:
        tests.append(f"exists({_RULES}, r -> {any_glob('r', when['rules'])})")
    if "entity_in" in when:
        tests.append(f"exists(concat(entities, output_leaked), e -> {any_glob('e', when['entity_in'])})")
    if "teams" in when:
        tests.append(f"arrays_overlap(array_append(teams, team), array({', '.join(map(literal, when['teams']))}))")
    if "sources" in when:
        tests.append(in_list(SOURCE, when["sources"]))
    return "(" + " AND ".join(tests) + ")" if tests else "true"


def match_channels(events: DataFrame, channels: Sequence[Mapping]) -> DataFrame:
    """One row per (event, matching channel) with the channel's settings and the suppression key."""
    built = ", ".join(
        f"if({_matches(c.get('when') or {'actions': ['block']})}, named_struct('channel', {literal(c['name'])}, 'channel_type', "
        f"{literal(c.get('type', 'webhook'))}, 'cooldown', {int(c.get('cooldown_seconds', 300))}, 'include_user', "
        f"{str(bool(c.get('include_user', True))).lower()}), NULL)" for c in channels)
    matched = f"filter(array({built}), c -> c IS NOT NULL)"
    return (events.select("*", F.explode(F.expr(matched)).alias("_c")).select("*", "_c.*").drop("_c")
            .withColumn("repeat_key", F.expr(f"if(size({_RULES}) > 0, array_join({_RULES}, ','), {effective_action()})")))


# --- cooldown -----------------------------------------------------------------------------------------
# Suppression is sequential: what is sent depends on the last send. Every row points at the row that would be sent
# next if it was: the first one of its key at or after the end of its cooldown. The sent rows are those that the key's
# first row leads to. Doubled again and again, pointers of 1, 2, 4, ... steps find them in as many rounds as the
# longest path has binary digits; all tables are dealt by row number, so one key is as many tasks as its rows fill.

_KEY = ["channel", "team", "repeat_key"]


def _following(rows: DataFrame) -> DataFrame:
    """(row, key, after) of rows (row, key, at, cooldown): the first row of the key at or after at + cooldown. Rows
    and the ends of their cooldowns stand in one order, cut into ranges; only the first row that a key has in a range
    is looked up from other ranges."""
    ends = rows.select("key", (F.col("at") + F.col("cooldown")).alias("t"), F.lit(0).alias("is_row"), "row")
    both = ends.unionByName(rows.select("key", F.col("at").alias("t"), F.lit(1).alias("is_row"), "row"))
    placed = range_buckets(both, ["key", "t", "is_row", "row"], "place")
    own = F.when(F.col("is_row") == 1, F.col("row"))
    here = Window.partitionBy("place", "key").orderBy(F.desc("t"), F.desc("is_row"), F.desc("row")).rowsBetween(Window.unboundedPreceding, 0)
    heads = placed.groupBy("place", "key").agg(F.min(own).alias("head"))  # a row per range and key
    later = Window.partitionBy("key").orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("place", "key", F.min("head").over(later).alias("later"))
    return (placed.withColumn("here", F.min(own).over(here)).filter("is_row = 0").join(heads, ["place", "key"])
            .select("row", "key", F.coalesce("here", "later").alias("after")))


def _sent(rows: DataFrame) -> DataFrame:
    """(row, previous) of the sent rows, `previous` the one sent before them. `rows` has (row, key, at, cooldown)."""
    pointers = materialize(_following(rows))
    steps = materialize(pointers.filter("after IS NOT NULL").select("row", "after"))
    found = materialize(pointers.groupBy("key").agg(F.min("row").alias("row")).select("row", F.lit(None).cast("bigint").alias("previous")))
    first_steps = jumps = steps
    sent, reached = found.select("row"), found.select("row")
    while True:
        reached = materialize(sent.join(jumps, "row").select(F.col("after").alias("row")))
        if reached.isEmpty():
            break
        sent = sent.unionByName(reached)
        onward = jumps.select(F.col("row").alias("after"), F.col("after").alias("farther"))
        jumps = materialize(jumps.join(onward, "after").select("row", F.col("farther").alias("after")))
    led = sent.join(first_steps, "row").select(F.col("after").alias("row"), F.col("row").alias("previous"))
    return found.unionByName(led)


def cooldown(matches: DataFrame) -> DataFrame:
    """Adds sent and suppressed (how many were held back since the key's last message) to channel matches.
    Channels without a cooldown send everything."""
    free = matches.filter("cooldown = 0").withColumn("sent", F.lit(True)).withColumn("suppressed", F.lit(0).cast("bigint"))
    seconds = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(event_time AS timestamp_ntz))") / 1e6
    held = matches.filter("cooldown > 0")
    slim = held.select("event_id", "channel", F.to_json(F.struct(*_KEY)).alias("key"), "cooldown", seconds.alias("at"))
    rows = numbered(slim, ["key", "at", "event_id"], "row")
    sent = _sent(rows.select("row", "key", "at", "cooldown")).withColumn(
        "suppressed", F.coalesce(F.col("row") - F.col("previous") - 1, F.lit(0)).cast("bigint")).select("row", "suppressed", F.lit(True).alias("sent"))
    marked = rows.join(sent, "row", "left").select("event_id", "channel", F.coalesce("sent", F.lit(False)).alias("sent"), F.coalesce("suppressed", F.lit(0)).cast("bigint").alias("suppressed"))
    return held.join(marked, ["event_id", "channel"]).unionByName(free)


# --- payloads -----------------------------------------------------------------------------------------

def _label(column: str, table: Mapping[str, str], otherwise: str) -> str:
    return f"CASE {column}" + "".join(f" WHEN {literal(k)} THEN {literal(v)}" for k, v in table.items()) + f" ELSE {otherwise} END"


def payloads(messages: DataFrame, *, product: str = "veri koruma", console: str = "") -> DataFrame:
    """Adds summary, facts, link and payload (the webhook body as JSON). Channels may leave the user out."""
    action = effective_action()
    leaked = f"(output_action <> '' AND {severity('output_action')} >= {severity('action')} AND size(output_leaked) > 0)"
    title = f"concat({_label(action, fixed.ACTION_TITLES, action)}, if({leaked}, ' (model cevabında sızıntı)', ''))"
    summary = f"if(coalesce(reason, '') <> '', concat({title}, ': ', reason), {title})"

    def fact(label: str, value: str, shown: str = "true") -> str:
        return f"if({shown}, named_struct('title', {label}, 'value', {value}), NULL)"

    def dash(column: str) -> str:
        return f"coalesce(nullif({column}, ''), '–')"

    facts = ", ".join([
        fact("'Ekip'", dash("team")), fact("'Kullanıcı'", dash("`user`"), "include_user"),
        fact(f"if({SOURCE} = 'gateway', 'Model', 'Site')",
             f"concat({dash('model')}, ' (', {_label('destination', fixed.DESTINATION_LABELS, dash('destination'))}, ')')"),
        fact("'Kaynak'", _label(SOURCE, fixed.SOURCE_LABELS, "''")),
        fact("'Kural'", f"array_join({_RULES}, ', ')", f"size({_RULES}) > 0"),
        fact("'Veri türleri'", "array_join(array_sort(array_distinct(entities)), ', ')", "size(entities) > 0"),
        fact("'Cevapta sızan'", "array_join(output_leaked, ', ')", "size(output_leaked) > 0"),
        fact("'Injection skoru'", "format_string('%.2f', injection_score)", "injection_score >= 0.5D"),
    ])
    page = ("CASE api_format WHEN 'policy' THEN '#politika' WHEN 'anomaly' THEN '#risk' "
            "ELSE concat('#olaylar?event=', cast(event_id AS string)) END")
    link = f"concat({literal(console.rstrip('/') + '/xray')}, {page})" if console else "cast(NULL AS string)"
    event = ", ".join(f"'{c}', `{c}`" for c in ("event_id", "event_time", "team", "teams", "model", "destination", "action", "output_action",
                                              "rules", "output_rules", "reason", "entities", "output_leaked", "injection_score", "api_format", "quota"))
    return (
        messages.withColumn("summary", F.expr(summary))
        .withColumn("headline", F.expr(f"trim(concat({_label(action, fixed.ACTION_ICONS, literal(''))}, ' {product} · ', summary))"))
        .withColumn("facts", F.expr(f"filter(array({facts}), f -> f IS NOT NULL)"))
        .withColumn("link", F.expr(link))
        .withColumn("payload", F.expr(
            f"to_json(named_struct('type', 'audit.alert', 'channel', channel, 'summary', summary, 'source', {SOURCE}, 'severity', {action}, "
            f"'suppressed', suppressed, 'console_url', link, 'event', named_struct({event}, 'user', if(include_user, `user`, NULL))))"))
    )
