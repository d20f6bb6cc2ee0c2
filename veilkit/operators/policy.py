"""Ordered policy rules compiled to one projection: no join, no shuffle, whatever the table size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilkit import fixed
from veilkit.functions.arrays import let, pinned
from veilkit.functions.globs import any_glob, literal
from veilkit.functions.lookups import first_prefix
from veilkit.plans.compliance import declared_sql

_CONDITIONS = {"teams", "destination", "entity_in", "injection_score_gte", "model_in", "model_not_in", "declared"}
_MODES = ("enforce", "monitor")
_STRINGS = "cast(array() AS array<string>)"


@dataclass(frozen=True)
class Policy:
    """Driver-side configuration; small by nature (rules, prefixes, prices)."""
    default_action: str = "allow"
    mode: str = "enforce"
    rules: Sequence[Mapping] = ()
    output_rules: Sequence[Mapping] = ()
    routing: Sequence[Mapping] = ()
    destinations: Mapping[str, Sequence[str]] = field(default_factory=dict)
    providers: Sequence[Mapping] = ()
    pricing: Sequence[Mapping] = ()
    quotas: Mapping = field(default_factory=dict)
    systems: Sequence[Mapping] = ()
    channels: Sequence[Mapping] = ()
    anomaly: Mapping = field(default_factory=dict)
    mask_style: str = "placeholder"

    def __post_init__(self):
        check_policy(self)

    @classmethod
    def load(cls, path: str) -> Policy:
        import yaml  # only needed for policies kept as YAML files

        with open(path, encoding="utf-8") as f:
            cfg = yaml.safe_load(f) or {}
        known = {k: v for k, v in cfg.items() if k in cls.__dataclass_fields__ and v}
        known["channels"] = (cfg.get("notify") or {}).get("channels") or []
        known["mask_style"] = (cfg.get("masking") or {}).get("style", "placeholder")
        return cls(**known)


def check_policy(policy: Policy) -> None:
    if policy.default_action not in fixed.SEVERITY or policy.mode not in _MODES:
        raise ValueError("unknown default action or mode")
    if policy.mask_style not in ("placeholder", "synthetic"):
        raise ValueError(f"unknown mask style {policy.mask_style!r}")
    for kind in ("rules", "output_rules", "routing"):
        names = [r.get("name") for r in getattr(policy, kind)]
        if not all(isinstance(n, str) and n for n in names) or len(set(names)) != len(names):
            raise ValueError(f"{kind}: every rule needs its own name")
        for rule in getattr(policy, kind):
            _check_rule(kind, rule, policy.mode)


def _check_rule(kind: str, rule: Mapping, mode: str) -> None:
    name, when = rule["name"], rule.get("when") or {}
    if rule.get("mode", mode) not in _MODES:
        raise ValueError(f"{name}: unknown mode")
    if kind == "routing":
        if not rule.get("to") or "action" in rule:
            raise ValueError(f"{name}: a routing rule has a target and no action")
    elif rule.get("action") not in fixed.SEVERITY:
        raise ValueError(f"{name}: unknown action")
    if set(when) - _CONDITIONS:
        raise ValueError(f"{name}: unknown conditions {sorted(set(when) - _CONDITIONS)}")
    for key in ("teams", "entity_in", "model_in", "model_not_in"):
        if key in when and not (isinstance(when[key], (list, tuple)) and when[key]
                                and all(isinstance(v, str) and v for v in when[key])):
            raise ValueError(f"{name}: {key} must be a list of names")
    if when.get("destination", "external") not in ("external", "internal"):
        raise ValueError(f"{name}: unknown destination")
    score = when.get("injection_score_gte", 0)
    if isinstance(score, bool) or not isinstance(score, (int, float)) or not 0 <= score <= 1:
        raise ValueError(f"{name}: injection_score_gte is a number from 0 to 1")
    if not isinstance(when.get("declared", True), bool):
        raise ValueError(f"{name}: declared is true or false")


@dataclass(frozen=True)
class Context:
    """Where the rules read from: SQL expressions over the request row."""
    team: str = "team"
    teams: str = "teams"
    model: str = "model"
    destination: str = "destination"
    entities: str = "entities"
    score: str = "injection_score"
    declared: str = "cast(NULL AS boolean)"


def rule_sql(when: Mapping, ctx: Context) -> str:
    tests = []
    if "teams" in when:
        wanted = ", ".join(map(literal, when["teams"]))
        tests.append(f"arrays_overlap(array_append(coalesce({ctx.teams}, {_STRINGS}), {ctx.team}), array({wanted}))")
    if "destination" in when:
        tests.append(f"{ctx.destination} = {literal(when['destination'])}")
    if "entity_in" in when:
        tests.append(f"exists({ctx.entities}, e -> {any_glob('e', when['entity_in'])})")
    if "injection_score_gte" in when:
        tests.append(f"{ctx.score} >= {float(when['injection_score_gte'])}D")
    if "model_in" in when:
        tests.append(any_glob(ctx.model, when["model_in"]))
    if "model_not_in" in when:
        tests.append(f"NOT {any_glob(ctx.model, when['model_not_in'])}")
    if "declared" in when:
        tests.append(f"{ctx.declared} <=> {str(when['declared']).lower()}")
    return "(" + " AND ".join(tests) + ")" if tests else "true"


def decision_sql(rules: Sequence[Mapping], mode: str, default_action: str, ctx: Context) -> str:
    """struct<action,mask_entities,rules,reason,monitored_rules,would_action> for one request row."""
    built = []
    for rule in rules:
        when = rule.get("when") or {}
        masks = f"filter({ctx.entities}, e -> {any_glob('e', when['entity_in'])})" \
            if rule["action"] == "mask" and when.get("entity_in") else _STRINGS
        watched = rule.get("mode", mode) == "monitor"
        built.append(f"if({rule_sql(when, ctx)}, named_struct('name', {literal(rule['name'])}, 'severity', "
                     f"{fixed.SEVERITY[rule['action']]}, 'watched', {str(watched).lower()}, 'reason', "
                     f"{literal(rule.get('message', rule['name']))}, 'masks', {masks}), NULL)")
    base = fixed.SEVERITY[default_action]
    names = "array(" + ", ".join(map(literal, fixed.SEVERITY)) + ")"
    if not built:
        return (f"named_struct('action', {literal(default_action)}, 'mask_entities', {_STRINGS}, 'rules', {_STRINGS}, "
                f"'reason', cast(NULL AS string), 'monitored_rules', {_STRINGS}, 'would_action', {literal(default_action)})")
    top = f"greatest({base}, coalesce(array_max(transform(enforced, r -> r.severity)), {base}))"
    would = f"greatest({base}, coalesce(array_max(transform(hit, r -> r.severity)), {base}))"
    body = (f"named_struct('action', {names}[top], "
            "'mask_entities', array_sort(array_distinct(flatten(transform(enforced, r -> r.masks)))), "
            "'rules', transform(enforced, r -> r.name), "
            f"'reason', if(top > {base}, get(filter(enforced, r -> r.severity = top), 0).reason, cast(NULL AS string)), "
            "'monitored_rules', transform(filter(hit, r -> r.watched), r -> r.name), "
            f"'would_action', {names}[{would}])")
    return let("hit", f"filter(array({', '.join(built)}), r -> r IS NOT NULL)",
               let("enforced", "filter(hit, r -> NOT r.watched)", let("top", top, body)))


def destination_of(model: Column, policy: Policy) -> Column:
    """First matching prefix in declared order; an unknown model counts as external."""
    rules = [(p, dest) for dest, prefixes in policy.destinations.items() for p in prefixes]
    return first_prefix(model, rules, "external")


_PROVIDER_KINDS = {"openai": ("chat", "responses", "embeddings"), "azure": ("chat", "responses", "embeddings"),
                   "anthropic": ("messages",)}


def provider_kinds(provider: Mapping) -> Sequence[str]:
    return provider.get("kinds") or _PROVIDER_KINDS[provider.get("type", "openai")]


def provider_names(policy: Policy) -> list[tuple[str, str]]:
    return [(prefix, p["name"]) for p in policy.providers for prefix in p["match"]]


def _prefix_test(model: str, provider: Mapping) -> str:
    return "(" + " OR ".join(f"startswith({model}, {literal(p)})" for p in provider["match"]) + ")"


def resolve_provider(df: DataFrame, policy: Policy) -> DataFrame:
    """Adds provider, provider_error and destination. The first provider whose prefix matches and which
    serves the API kind is used; if only prefixes match, the request cannot go out in that kind. The
    provider's destination comes before the prefix table."""
    matched = "filter(array(" + ", ".join(
        f"if({_prefix_test('model', p)}, named_struct('name', {literal(p['name'])}, 'kinds', "
        f"array({', '.join(map(literal, provider_kinds(p)))}), 'destination', "
        f"{literal(p.get('destination', 'external'))}), NULL)" for p in policy.providers) + "), p -> p IS NOT NULL)"
    if not policy.providers:
        return (df.withColumn("provider", F.lit(None).cast("string")).withColumn("provider_error", F.lit(None).cast("string"))
                .withColumn("destination", destination_of(F.col("model"), policy)))
    kind = "if(api_format = '', 'chat', api_format)"
    served = f"get(filter(_matched, p -> array_contains(p.kinds, {kind})), 0)"
    kinds = "array_join(array_sort(array_distinct(flatten(transform(_matched, p -> p.kinds)))), ', ')"
    return (
        df.withColumn("_matched", F.expr(matched)).withColumn("_served", F.expr(served))
        .withColumn("provider", F.col("_served.name"))
        .withColumn("provider_error", F.expr(f"if(_served IS NULL AND size(_matched) > 0, {kinds}, NULL)"))
        .withColumn("destination", F.coalesce(F.col("_served.destination"), F.expr("get(_matched, 0).destination"),
                                              destination_of(F.col("model"), policy)))
        .drop("_matched", "_served")
    )


def evaluate(df: DataFrame, policy: Policy, *, ctx: Context | None = None, into: str = "decision") -> DataFrame:
    """Input rules. `ctx.declared` defaults to the policy's own inventory (NULL when it is empty)."""
    ctx = ctx or Context(declared=declared_sql(policy.systems))
    return df.withColumn(into, F.expr(pinned(decision_sql(policy.rules, policy.mode, policy.default_action, ctx))))


def evaluate_output(df: DataFrame, policy: Policy, leaked: str = "output_leaked", into: str = "output") -> DataFrame:
    """Output rules see only the leaked entities and no injection score."""
    ctx = Context(entities=leaked, score="0D", declared=declared_sql(policy.systems))
    return df.withColumn(into, F.expr(pinned(decision_sql(policy.output_rules, policy.mode, "allow", ctx))))


def _target_destination(model: str, policy: Policy) -> str:
    for provider in policy.providers:
        if any(model.startswith(p) for p in provider["match"]):
            return provider.get("destination", "external")
    for destination, prefixes in policy.destinations.items():
        if any(model.startswith(p) for p in prefixes):
            return destination
    return "external"


def route(df: DataFrame, policy: Policy, only: str = "true") -> DataFrame:
    """Expects `decision`. The first enforced routing rule whose target differs from the model and is
    internal sends the request there; the rules then run again for the target. Monitored routes that
    come before it are only listed. `only` is a condition for rows that can be routed at all."""
    ctx = Context(declared=declared_sql(policy.systems))
    built = []
    for rule in policy.routing:
        watched = rule.get("mode", policy.mode) == "monitor"
        ok = _target_destination(rule["to"], policy) == "internal"
        built.append(f"if({only} AND model <> {literal(rule['to'])} AND {rule_sql(rule.get('when') or {}, ctx)}, named_struct("
                     f"'name', {literal(rule['name'])}, 'target', {literal(rule['to'])}, 'watched', "
                     f"{str(watched).lower()}, 'usable', {str(ok).lower()}), NULL)")
    if not built:
        return df.withColumn("routed_from", F.lit(None).cast("string"))
    mark = literal(fixed.ROUTE_RULE)
    staged = (
        df.withColumn("_hit", F.expr(f"filter(array({', '.join(built)}), r -> r IS NOT NULL)"))
        .withColumn("_first", F.expr("array_position(transform(_hit, r -> r.watched), false)"))
        .withColumn("_seen", F.expr(f"transform(if(_first = 0, _hit, slice(_hit, 1, cast(_first AS int) - 1)), "
                                    f"r -> concat({mark}, r.name))"))
        .withColumn("_route", F.expr("if(_first > 0, _hit[cast(_first AS int) - 1], NULL)"))
        .withColumn("_goes", F.expr("coalesce(_route.usable, false)"))
        .withColumn("routed_from", F.expr("if(_goes, model, NULL)"))
        .withColumn("model", F.expr("if(_goes, _route.target, model)"))
        .withColumn("destination", F.expr("if(_goes, 'internal', destination)"))
    )
    again = evaluate(staged, policy, into="_again")
    return again.withColumn("decision", F.expr(
        f"named_struct('action', if(_goes, _again.action, decision.action), "
        f"'mask_entities', if(_goes, _again.mask_entities, decision.mask_entities), "
        f"'rules', if(_goes, concat(array(concat({mark}, _route.name)), _again.rules), decision.rules), "
        f"'reason', if(_goes, _again.reason, decision.reason), "
        f"'monitored_rules', concat(decision.monitored_rules, _seen, if(_goes, _again.monitored_rules, {_STRINGS})), "
        f"'would_action', if(_goes, _again.would_action, decision.would_action))")
    ).drop("_hit", "_first", "_seen", "_route", "_goes", "_again")


def estimate_cost(model: Column, prompt: Column, completion: Column, policy: Policy) -> Column:
    """USD by the first matching price prefix (per million tokens); NULL when no price is known."""
    out = None
    for entry in policy.pricing:
        price = F.round((prompt * F.lit(float(entry["input"])) + completion * F.lit(float(entry["output"]))) / 1_000_000, 6)
        test = model.startswith(entry["match"])
        out = F.when(test, price) if out is None else out.when(test, price)
    return F.lit(None).cast("double") if out is None else out.otherwise(F.lit(None).cast("double"))


def severity(column: str) -> str:
    return ("CASE " + column + "".join(f" WHEN {literal(a)} THEN {s}" for a, s in fixed.SEVERITY.items()) + " ELSE 0 END")


def effective_action(action: str = "action", output_action: str = "output_action") -> str:
    """The more severe of the request's and the answer's decision (the first on a tie)."""
    a, o = f"coalesce(nullif({action}, ''), 'allow')", f"coalesce(nullif({output_action}, ''), 'allow')"
    return f"if({severity(o)} > {severity(a)}, {o}, {a})"


def apply_unscannable(df: DataFrame, action: str = "alert") -> DataFrame:
    """Expects `decision`, `destination` and `unscannable` (array of 'name: reason'). An external request
    with an attachment that could not be read is tightened, never loosened."""
    if action == "allow":
        return df
    level = fixed.SEVERITY[action]
    applies = "(size(unscannable) > 0 AND destination = 'external')"
    reasons = "array_join(array_sort(array_distinct(unscannable)), ', ')"
    text = f"concat('Taranamayan ek yurt dışı modele gönderilemez (', {reasons}, ').')" if action == "block" \
        else f"concat('Taranamayan ek (', {reasons}, ')')"
    tighter = f"({applies} AND {severity('decision.action')} < {level})"
    return df.withColumn("decision", F.expr(
        f"named_struct('action', if({tighter}, {literal(action)}, decision.action), "
        f"'mask_entities', decision.mask_entities, "
        f"'rules', if({applies}, array_append(decision.rules, {literal(fixed.UNSCANNABLE_RULE)}), decision.rules), "
        f"'reason', if({tighter}, {text}, decision.reason), 'monitored_rules', decision.monitored_rules, "
        f"'would_action', if({applies} AND {severity('decision.would_action')} < {level}, {literal(action)}, "
        f"decision.would_action))"))


def teams_from_groups(groups: str, prefix: str = "") -> Column:
    """Group paths to team names: leading slashes off, prefix required and cut, order kept."""
    bare = f"transform(`{groups}`, g -> ltrim('/', g))"
    if prefix:
        bare = (f"transform(filter({bare}, g -> startswith(g, {literal(prefix)})), "
                f"g -> substr(g, {len(prefix) + 1}))")
    cleaned = f"array_distinct(filter({bare}, g -> g IS NOT NULL AND g <> ''))"
    return F.expr(f"if(size({cleaned}) > 0, {cleaned}, array('default'))")


def _from_base64(value: str) -> str:
    return f"coalesce(try_to_binary(trim({value}), 'base64'), encode(trim({value}), 'UTF-8'))"


def proxy_user(header: str) -> Column:
    """Short user name from a proxy's authentication header (plain, base64, DOMAIN\\user or LDAP path)."""
    decoded = f"coalesce(try_validate_utf8(cast({_from_base64('`' + header + '`')} AS string)), trim(`{header}`))"
    name = (f"CASE WHEN lower(v) LIKE 'ldap://%' THEN regexp_extract(v, '(?i)(?:cn|uid)=([^,]+)', 1) "
            f"ELSE regexp_replace(v, '(?i)^[a-z]+://', '') END")
    last = f"lower(trim(element_at(split({name}, '[\\\\\\\\/]'), -1)))"
    return F.expr(f"transform(array({decoded}), v -> if({last} rlike '(?U)^[\\\\w.@+-]{{1,200}}$', {last}, NULL))[0]")


def proxy_groups(header: str) -> Column:
    decoded = f"coalesce(try_validate_utf8(cast({_from_base64('`' + header + '`')} AS string)), trim(`{header}`))"
    short = ("trim(element_at(split(regexp_replace(trim(g), '(?i)^[a-z]+://', ''), '[\\\\\\\\/]'), -1))")
    named = f"regexp_extract({short}, '(?i)^(?:cn=)?([^,]+)', 1)"
    return F.expr(f"filter(transform(split({decoded}, '[,;\\n]'), g -> {named}), "
                  "g -> g rlike '(?U)^[\\\\w.@+-]{1,200}$')")


def agent_resolve(df: DataFrame) -> DataFrame:
    """Hook decision and audited action for a coding assistant. Expects decision, client, event, routed,
    entities, injection_score; adds hook_action, audit_action, audit_rules and `audited`."""
    to_model = "event IN (" + ", ".join(map(literal, fixed.AGENT_TO_MODEL_EVENTS)) + ")"
    return (
        df.withColumn("hook_action", F.expr(
            f"CASE decision.action WHEN 'block' THEN 'block' WHEN 'mask' THEN CASE WHEN routed AND {to_model} THEN 'allow' "
            "WHEN event = 'tool_output' THEN 'mask' ELSE 'block' END WHEN 'alert' THEN 'warn' ELSE 'allow' END"))
        .withColumn("audit_action", F.expr(
            "CASE decision.action WHEN 'block' THEN 'block' WHEN 'mask' THEN if(hook_action = 'block', 'block', 'mask') "
            "WHEN 'alert' THEN 'alert' ELSE 'allow' END"))
        .withColumn("audit_rules", F.expr("array_append(decision.rules, concat('ajan:', client, ':', event))"))
        .withColumn("audited", F.expr(
            f"NOT (routed AND {to_model} AND hook_action = 'allow') AND (event = 'prompt' OR hook_action <> 'allow' "
            "OR size(entities) > 0 OR size(decision.monitored_rules) > 0 OR injection_score >= 0.5D)"))
    )


def _site_tests(extra_hosts: Sequence[str]):
    return [*fixed.SITES, *[(h, h, []) for h in extra_hosts]]


def match_site(df: DataFrame, extra_hosts: Sequence[str] = ()) -> DataFrame:
    """Adds site_name and is_prompt for known AI hosts and their subdomains; NULL name for other hosts
    and for methods without a body."""
    method = "upper(method) IN (" + ", ".join(map(literal, fixed.SCANNED_METHODS)) + ")"
    name, prompt = "CASE", "CASE"
    for host, label, paths in _site_tests(extra_hosts):
        test = f" WHEN {method} AND (host = {literal(host)} OR endswith(host, {literal('.' + host)})) THEN "
        name += test + literal(label)
        prompt += test + ("(" + " OR ".join(f"path rlike {literal(p)}" for p in paths) + ")" if paths else "false")
    return (df.withColumn("site_name", F.expr(name + " END"))
            .withColumn("is_prompt", F.expr(f"coalesce({prompt} ELSE false END, false)")))


def network_decision(df: DataFrame, *, block_oversize: bool = True, block_unscannable: bool = False) -> DataFrame:
    """A proxy can only pass or stop: masking becomes blocking. Expects decision, truncated, unscannable,
    entities, injection_score, is_prompt; adds network_action, network_rules and `recorded`."""
    over = "truncated" if block_oversize else "false"
    unread = "unscannable" if block_unscannable else "false"
    stop = "decision.action IN ('block', 'mask')"
    return (
        df.withColumn("network_action", F.expr(
            f"CASE WHEN {stop} OR {over} OR {unread} THEN 'block' WHEN decision.action = 'alert' THEN 'alert' ELSE 'allow' END"))
        .withColumn("network_rules", F.expr(
            f"concat(decision.rules, CASE WHEN {stop} THEN {_STRINGS} WHEN {over} THEN array('ag:boyut-siniri') "
            f"WHEN {unread} THEN array('ag:okunamadi') ELSE {_STRINGS} END, "
            "array('ag:icap', if(network_action = 'block', 'golge-ai:blocked', 'golge-ai:network')))"))
        .withColumn("recorded", F.expr(
            "is_prompt OR network_action <> 'allow' OR size(entities) > 0 OR size(decision.monitored_rules) > 0 "
            "OR injection_score >= 0.5D"))
    )


def _tool_name(column: str) -> str:
    return f"translate(lower({column}), '-.', '__')"


def _normal(pattern: str) -> str:
    return pattern.lower().replace("-", "_").replace(".", "_")


def _broad(names: str, patterns: Sequence[str]) -> str:
    globs = [g for p in map(_normal, patterns) for g in (p, f"*_{p}")]
    return f"exists({names}, n -> {any_glob('n', globs)})"


def tool_access(df: DataFrame, rules: Sequence[Mapping], default: str = "allow") -> DataFrame:
    """Adds denied_by: the rule that denies the tool, 'default-deny', or NULL. Denials match broadly
    (also after a prefix), permissions only the whole original name."""
    names = (f"filter(array({_tool_name('tool')}, {_tool_name('original_tool')}), n -> n IS NOT NULL)")
    exact = f"coalesce({_tool_name('original_tool')}, {_tool_name('tool')})"
    deny, allow = "CASE", []
    for rule in rules:
        teams, users = rule.get("teams") or [], rule.get("users") or []
        applies = ["true"]
        if teams and "*" not in teams:
            applies.append(f"arrays_overlap(teams, array({', '.join(map(literal, teams))}))")
        if users:
            applies.append(any_glob("lower(coalesce(`user`, ''))", [u.lower() for u in users]))
        who = "(" + " AND ".join(applies) + ")"
        if rule.get("deny"):
            deny += f" WHEN {who} AND {_broad(names, rule['deny'])} THEN {literal(rule.get('name') or 'deny')}"
        if rule.get("allow"):
            allow.append(f"({who} AND {any_glob(exact, [_normal(p) for p in rule['allow']])})")
    fallback = "NULL"
    if default == "deny":
        fallback = f"if({' OR '.join(allow) or 'false'}, NULL, 'default-deny')"
    text = fallback if deny == "CASE" else f"{deny} ELSE {fallback} END"
    return df.withColumn("denied_by", F.expr(f"cast({text} AS string)"))


def exfiltration(df: DataFrame, external_tools: Sequence[str], blocked_entities: Sequence[str]) -> DataFrame:
    """Adds exfiltrated: the blocked entities found in the arguments of an external tool."""
    names = f"filter(array({_tool_name('tool')}, {_tool_name('original_tool')}), n -> n IS NOT NULL)"
    hits = f"array_sort(array_distinct(filter(entities, e -> {any_glob('e', blocked_entities)})))"
    return df.withColumn("exfiltrated", F.expr(f"if({_broad(names, external_tools)}, {hits}, {_STRINGS})"))


def unknown_entity_patterns(rules: DataFrame, known: Sequence[str]) -> DataFrame:
    """Rule entity patterns that match no known type (`rules` has kind, name, entity_in)."""
    patterns = rules.select("kind", "name", F.explode("entity_in").alias("pattern"))
    names = f"array({', '.join(map(literal, known))})"
    as_regex = "concat('^', replace(replace(regexp_replace(pattern, '([.+^$(){}|\\\\\\\\])', '\\\\\\\\$1'), '*', '.*'), '?', '.'), '$')"
    return (patterns.filter(~F.col("pattern").startswith(fixed.DICTIONARY_PREFIX))
            .withColumn("_regex", F.expr(as_regex))
            .filter(f"NOT exists({names}, k -> k rlike _regex)").drop("_regex"))
