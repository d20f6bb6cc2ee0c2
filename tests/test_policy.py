import fnmatch
import random
from collections import Counter

import pytest

from veilkit import defaults, fixed
from veilkit.operators import policy as P
from veilkit.plans import compliance as C
from veilkit.plans import impact as IM


def decide(spark, policy, **row):
    base = {"team": "analitik", "teams": ["analitik"], "model": "gpt-4o", "destination": "external", "entities": [], "injection_score": 0.0, "api_format": "chat"}
    df = spark.createDataFrame([{**base, **row}], "team string, teams array<string>, model string, destination string, entities array<string>, injection_score double, api_format string")
    return P.route(P.evaluate(df, policy), policy).first()


def test_most_severe_rule_wins_and_first_reason_stays(spark):
    d = decide(spark, defaults.policy(), team="stajyer", teams=["stajyer"], entities=["TCKN", "SECRET_JWT"], injection_score=0.6).decision
    assert d.action == "block" and d.would_action == "block" and d.reason == "Bu ekip dış modellere kimlik numarası gönderemez."
    assert d.mask_entities == ["SECRET_JWT", "TCKN"]
    assert d.rules == ["prompt-injection-alert", "kvkk-yurtdisi-maskele", "sirlar-her-yerde-maskele", "stajyer-tckn-engel"]


def test_monitored_rules_only_raise_would_action(spark):
    policy = defaults.policy(mode="monitor")
    d = decide(spark, policy, entities=["TCKN"]).decision
    assert (d.action, d.would_action, d.rules, d.reason) == ("allow", "mask", [], None) and d.monitored_rules == ["kvkk-yurtdisi-maskele"]


def test_any_team_of_a_user_matches(spark):
    d = decide(spark, defaults.policy(), team="analitik", teams=["analitik", "stajyer"], entities=["TCKN"]).decision
    assert d.action == "block"


def test_model_lists_and_declared(spark):
    rules = [{"name": "yalniz-ic", "when": {"model_not_in": ["vllm/*"]}, "action": "alert"}, {"name": "beyansiz", "when": {"declared": False}, "action": "block"}]
    assert decide(spark, P.Policy(rules=rules)).decision.rules == ["yalniz-ic"]   # nothing declared: the condition never matches
    assert decide(spark, P.Policy(rules=rules, systems=defaults.SYSTEMS), team="finans", teams=["finans"]).decision.rules == ["yalniz-ic", "beyansiz"]
    assert decide(spark, P.Policy(rules=rules, systems=defaults.SYSTEMS), team="yazilim", teams=["x", "yazilim"]).decision.rules == ["yalniz-ic"]


def test_routing_sends_inside_and_decides_again(spark):
    routing = [{"name": "izle", "when": {"entity_in": ["TCKN"]}, "to": "vllm/a", "mode": "monitor"}, {"name": "ic", "when": {"entity_in": ["TCKN"]}, "to": "vllm/b"}]
    r = decide(spark, defaults.policy(routing=routing), entities=["CREDIT_CARD", "TCKN"])
    assert (r.model, r.destination, r.routed_from) == ("vllm/b", "internal", "gpt-4o")
    assert r.decision.rules == ["yonlendirme:ic", "kart-numarasi-her-yerde-maskele"] and r.decision.mask_entities == ["CREDIT_CARD"]
    assert r.decision.monitored_rules == ["yonlendirme:izle"]
    assert decide(spark, defaults.policy(routing=routing), entities=["TCKN"], model="vllm/b", destination="internal").routed_from is None
    outside = [{"name": "dis", "when": {"entity_in": ["TCKN"]}, "to": "gpt-5"}]
    assert decide(spark, defaults.policy(routing=outside), entities=["TCKN"]).decision.action == "mask"


@pytest.mark.parametrize("changes", [
    {"default_action": "x"}, {"rules": [{"name": "a", "action": "yok"}]}, {"rules": [{"name": "a", "action": "mask"}, {"name": "a", "action": "mask"}]},
    {"rules": [{"name": "a", "action": "mask", "when": {"entities": ["X"]}}]}, {"rules": [{"name": "a", "action": "mask", "when": {"entity_in": "TCKN"}}]},
    {"rules": [{"name": "a", "action": "mask", "when": {"injection_score_gte": "0.5"}}]}, {"routing": [{"name": "a", "action": "mask", "to": "x"}]}, {"mask_style": "x"}])
def test_bad_policies_are_refused(changes):
    with pytest.raises(ValueError):
        P.Policy(**changes)


# --- generated policies, contexts and declarations against the rules written out in plain Python -------
TEAMS = ["lojistik", "kargo", "depo", "saha"]
MODELS = ["m-kucuk", "m-buyuk", "n-1", "n-2", "yerel/a", "yerel/b"]
KINDS = ["IBAN_TR", "PHONE_TR", "PLATE_TR", "SECRET_JWT"]


def random_rules(rnd, n, prefix):
    rules = []
    for i in range(n):
        when = {}
        if rnd.random() < 0.5:
            when["teams"] = rnd.sample(TEAMS, rnd.randint(1, 2))
        if rnd.random() < 0.5:
            when["destination"] = rnd.choice(["external", "internal"])
        if rnd.random() < 0.6:
            when["entity_in"] = rnd.sample(KINDS, rnd.randint(1, 2))
        if rnd.random() < 0.3:
            when["model_not_in"] = [rnd.choice(["m-*", "n-?", "yerel/*"])]
        if rnd.random() < 0.2:
            when["injection_score_gte"] = rnd.choice([0.25, 0.5])
        rules.append({"name": f"{prefix}{i}", "when": when, "action": rnd.choice(["alert", "mask", "block"]), "message": f"neden {prefix}{i}"})
    return rules


def holds(when, c):
    tests = {"teams": lambda v: set(v) & {c["team"], *c["teams"]}, "destination": lambda v: v == c["destination"], "entity_in": lambda v: set(v) & set(c["entities"]),
             "model_not_in": lambda v: not any(fnmatch.fnmatchcase(c["model"], g) for g in v), "injection_score_gte": lambda v: c["injection_score"] >= v}
    return all(tests[k](v) for k, v in when.items())


def plain_decision(rules, c):
    hit = [r for r in rules if holds(r["when"], c)]
    action = max(["allow", *(r["action"] for r in hit)], key=fixed.SEVERITY.get)
    return action, [r["name"] for r in hit], next((r["message"] for r in hit if r["action"] == action), None)


def random_contexts(rnd, n):
    out = []
    for i in range(n):
        model = rnd.choice(MODELS)
        out.append({"team": rnd.choice(TEAMS), "teams": sorted(rnd.sample(TEAMS, rnd.randint(0, 2))), "model": model,
                    "destination": "internal" if model.startswith("yerel/") else "external", "entities": sorted(rnd.sample(KINDS, rnd.randint(0, 3))),
                    "injection_score": rnd.choice([0.0, 0.25, 0.5]), "api_format": "chat", "n": rnd.randint(1, 500), "users": rnd.randint(1, 40), "no": i})
    return out


CONTEXT = ("team string, teams array<string>, model string, destination string, entities array<string>, injection_score double, api_format string, "
           "n bigint, users bigint, no bigint")


@pytest.mark.parametrize("seed", range(4))
def test_decisions_and_impact_equal_plain_rules(spark, seed):
    rnd = random.Random(seed)
    before, added = random_rules(rnd, 5, "eski"), random_rules(rnd, 3, "yeni")
    after = [r for r in before if rnd.random() < 0.7] + added
    rows = random_contexts(rnd, 150)
    plain = [(c, plain_decision(before, c), plain_decision(after, c)) for c in rows]
    seen = IM.outcome(IM.outcome(spark.createDataFrame(rows, CONTEXT), P.Policy(rules=before), "before"), P.Policy(rules=after), "after")
    for r in seen.collect():
        _, old, new = plain[r.no]
        assert (r.before, r.before_decision.rules) == old[:2] and (r.after, r.after_decision.rules) == new[:2]
    changed = [(c, old, new) for c, old, new in plain if old[0] != new[0]]
    assert IM.summary(seen).first().asDict() == {"requests": sum(c["n"] for c in rows), "groups": len(rows), "changed": sum(c["n"] for c, *_ in changed)}
    moves, fired = Counter(), Counter()
    for c, old, new in plain:
        if old[0] != new[0]:
            moves[old[0], new[0]] += c["n"]
        fired.update({("added", r): c["n"] for r in set(new[1]) - set(old[1])} | {("removed", r): c["n"] for r in set(old[1]) - set(new[1])})
    assert {(r.before, r.after): r.requests for r in IM.transitions(seen).collect()} == moves
    assert {(r.change, r.rule): r.requests for r in IM.rule_changes(seen).collect()} == fired
    shown = IM.examples(seen, limit=5).collect()
    assert sorted((r.requests for r in shown), reverse=True) == sorted((c["n"] for c, *_ in changed), reverse=True)[:5]


def random_systems(rnd, n):
    cases = [u[0] for u in fixed.USE_CASES]
    return [{"id": f"s{i}", "name": f"Sistem {i:02}", "owner_team": rnd.sample(TEAMS, rnd.randint(1, 3)) if rnd.random() < 0.5 else rnd.choice(TEAMS),
             "models": rnd.sample(["m-*", "n-1", "n-?", "yerel/*", "yerel/b", "*"], rnd.randint(1, 2)), "use_case": rnd.choice(cases), "purpose": f"amaç {i % 4}",
             "data_subjects": rnd.sample(["Aday", "Müşteri", "Sürücü"], rnd.randint(0, 2)), "decides_about_people": rnd.random() < 0.5} for i in range(n)]


def owners(system):
    return system["owner_team"] if isinstance(system["owner_team"], list) else [system["owner_team"]]


def covers(system, team, model):
    return team in owners(system) and any(fnmatch.fnmatchcase(model, g) for g in system["models"])


@pytest.mark.parametrize("seed", range(3))
def test_inventory_equals_plain_rules(spark, seed):
    rnd = random.Random(seed)
    systems, today = random_systems(rnd, 9), f"202{rnd.randint(4, 8)}-08-01"
    usage = [(t, m, "internal" if m.startswith("yerel/") else "external", rnd.randint(1, 300), rnd.randint(1, 20), sorted(rnd.sample(KINDS, rnd.randint(0, 3))), rnd.choice([0, 0, 7]))
             for t in [*TEAMS, "beyansız"] for m in rnd.sample(MODELS, rnd.randint(1, 4))]
    frame = spark.createDataFrame(usage, "team string, model string, destination string, requests bigint, users bigint, entities array<string>, external_with_pii bigint")
    report, left = C.inventory(frame, systems, today), C.undeclared(frame, systems)
    catalogue = {u[0]: u for u in fixed.USE_CASES}
    rows, risks = {r.id: r for r in report.collect()}, Counter()
    assert len(rows) == len(systems)
    for s in systems:
        mine, got = [u for u in usage if covers(s, u[0], u[1])], rows[s["id"]]
        _, _, risk, _, starts = catalogue[s["use_case"]]
        risks[risk] += 1
        wanted = [w for w, due in ((fixed.WARNING_DECIDES, risk == "minimal" and s["decides_about_people"]), (fixed.WARNING_NO_TRAFFIC, risk != "prohibited" and not mine),
                                   (fixed.WARNING_TRANSFER, any(u[6] for u in mine))) if due]
        assert (got.risk, got.in_force, got.warnings) == (risk, starts <= today, wanted)
        assert (got.requests, got.users) == (sum(u[3] for u in mine), sum(u[4] for u in mine))
        assert (got.entities, got.destinations) == (sorted({e for u in mine for e in u[5]}), sorted({u[2] for u in mine}))
    bare = [u for u in usage if not any(covers(s, u[0], u[1]) for s in systems)]
    assert sorted((r.team, r.model) for r in left.collect()) == sorted((u[0], u[1]) for u in bare)
    risks["unclassified"] = len(bare)
    assert C.inventory_counts(report, left).first().asDict() == {k: risks[k] for k in ("prohibited", "high", "limited", "minimal", "unclassified")}
    order = [(fixed.RISK_CLASS_ORDER[r.risk], r.name) for r in report.collect()]
    assert order == sorted(order)
    told = spark.createDataFrame(random_contexts(rnd, 60), CONTEXT)
    for r in C.declared(told, systems).collect():
        assert r.declared == any(covers(s, t, r.model) for s in systems for t in {r.team, *r.teams})


@pytest.mark.parametrize("seed", range(3))
def test_register_equals_plain_rules(spark, seed):
    rnd = random.Random(seed)
    systems, legal = random_systems(rnd, 5), [fixed.REGISTER_LEGAL]
    entities = [*fixed.REGISTER_CATEGORIES, "KURUM_PROJE"]
    rows = [(rnd.choice(entities), rnd.choice(["external", "internal"]), rnd.choice(MODELS), rnd.choice(TEAMS), rnd.randint(1, 50),
             rnd.choice([*fixed.PROVIDER_COUNTRY, fixed.UNKNOWN_PROVIDER])) for _ in range(12)]
    frame = spark.createDataFrame(rows, "entity string, destination string, model string, team string, requests bigint, provider string")
    by = {}
    for r in rows:
        if r[0] in fixed.REGISTER_CATEGORIES:
            by.setdefault(fixed.REGISTER_CATEGORIES[r[0]], []).append(r)
    got = C.register(frame, systems, "1 yıl").collect()
    assert [r.category for r in got] == sorted(by)
    for r in got:
        mine = by[r.category]
        out, related = [x for x in mine if x[1] == "external"], [s for s in systems if set(owners(s)) & {x[3] for x in mine}]
        assert (r.types, r.requests) == (sorted({x[0] for x in mine}), sum(x[4] for x in mine))
        assert r.providers == sorted({x[5] for x in out}) and r.abroad == (fixed.REGISTER_YES if out else fixed.REGISTER_NO)
        assert r.countries == sorted({fixed.PROVIDER_COUNTRY.get(x[5], fixed.REGISTER_UNKNOWN_COUNTRY) for x in out})
        assert r.purposes == (sorted({s["purpose"] for s in related}) or legal)
        assert r.subjects == (sorted({p for s in related for p in s["data_subjects"]}) or legal)
        assert r.recipients == [fixed.REGISTER_PROCESSOR if out else fixed.REGISTER_INTERNAL] and r.retention == "1 yıl"


def test_bad_declarations_are_refused():
    rnd = random.Random(1)
    for field, bad in [("use_case", "yok"), *((f, "") for f in C.SYSTEM_FIELDS)]:
        systems = random_systems(rnd, 3)
        C.check_systems(systems)
        rnd.choice(systems)[field] = bad
        with pytest.raises(ValueError):
            C.check_systems(systems)
    systems = random_systems(rnd, 4)
    systems[3]["id"] = systems[0]["id"]
    with pytest.raises(ValueError):
        C.check_systems(systems)
