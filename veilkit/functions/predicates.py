"""Shared conditions over audit rows, as Spark SQL fragments (usable in expr, filter and count_if)."""

from __future__ import annotations

from veilkit import fixed

_NOT_PII = "startswith(e, 'SECRET_') OR startswith(e, 'KURUM_')"

HAS_SECRET = "exists(entities, e -> startswith(e, 'SECRET_'))"
UNMASKED_PII = f"exists(entities, e -> NOT ({_NOT_PII}) AND NOT array_contains(masked_entities, e))"
EXTERNAL_UNMASKED_PII = f"(destination = 'external' AND action <> 'block' AND {UNMASKED_PII})"
MONITOR_DIFF = "(would_action <> '' AND would_action <> action)"
WOULD_BLOCK = "(would_action = 'block' AND action <> 'block')"
OUTPUT_LEAK = "(size(output_leaked) > 0)"
QUOTA_HIT = "(quota <> '' AND quota <> 'backend_unavailable')"
INJECTION = "(injection_score >= 0.5D)"
OVERRIDE = f"array_contains(rules, '{fixed.OVERRIDE_RULE}')"
API_FORMAT = "if(api_format = '', 'chat', api_format)"
SHADOW = "api_format IN ('browser', 'icap')"
ROUTED = f"exists(rules, r -> startswith(r, '{fixed.ROUTE_RULE}'))"
RISKY = f"(action = 'block' OR {INJECTION} OR {OUTPUT_LEAK} OR {OVERRIDE} OR {HAS_SECRET} OR {EXTERNAL_UNMASKED_PII})"
KNOWN_USER = "`user` NOT IN (" + ", ".join(f"'{u}'" for u in fixed.ANONYMOUS_USERS) + ")"

EVENT_FLAGS = {
    "external_unmasked_pii": EXTERNAL_UNMASKED_PII,
    "injection": INJECTION,
    "secret": HAS_SECRET,
    "would_block": WOULD_BLOCK,
    "monitor_diff": MONITOR_DIFF,
    "output_leak": OUTPUT_LEAK,
    "quota": QUOTA_HIT,
}


def _kind(entity_test: str) -> str:
    return f"exists(entities, e -> {entity_test})"


def _kind_unmasked(entity_test: str) -> str:
    return f"exists(entities, e -> ({entity_test}) AND NOT array_contains(masked_entities, e))"


_PII, _SECRET, _CORPORATE = f"NOT ({_NOT_PII})", "startswith(e, 'SECRET_')", "startswith(e, 'KURUM_')"
_CROSS_BORDER = f"(destination = 'external' OR {ROUTED})"
_WOULD_PROTECT = "would_action IN ('mask', 'block')"

# risk -> (applies, was protected, a monitored rule would have protected)
RISK_CONDITIONS = {
    "pii_external": (f"{_CROSS_BORDER} AND {_kind(_PII)}",
                     f"action = 'block' OR {ROUTED} OR NOT {_kind_unmasked(_PII)}", _WOULD_PROTECT),
    "secrets": (_kind(_SECRET), f"action = 'block' OR NOT {_kind_unmasked(_SECRET)}", _WOULD_PROTECT),
    "corporate_external": (f"{_CROSS_BORDER} AND {_kind(_CORPORATE)}",
                           f"action = 'block' OR {ROUTED} OR NOT {_kind_unmasked(_CORPORATE)}", _WOULD_PROTECT),
    "injection": (INJECTION, "action = 'block'", "would_action = 'block'"),
    "output_leak": (OUTPUT_LEAK, "output_action IN ('mask', 'block')", "false"),
}


def entity_kind(column: str) -> str:
    return (f"CASE WHEN startswith({column}, 'SECRET_') THEN 'secret' "
            f"WHEN startswith({column}, 'KURUM_') THEN 'corporate' ELSE 'pii' END")
