"""Normal forms of found values, keyed hashes and display labels, as Spark SQL fragments."""

from __future__ import annotations

import hashlib

from veilkit import fixed
from veilkit.functions.globs import literal
from veilkit.functions.normalize import normalized_text

_NUMBER_TYPES = "('TCKN', 'VKN', 'CREDIT_CARD')"


def _only_digits(value: str) -> str:
    return f"regexp_replace({value}, '(?U)\\\\D', '')"


def canonical_value(entity: str, value: str) -> str:
    """The form under which spellings of one number share a placeholder."""
    return (f"CASE WHEN {entity} IN {_NUMBER_TYPES} THEN {_only_digits(value)} "
            f"WHEN {entity} = 'PHONE_TR' THEN right({_only_digits(value)}, 10) "
            f"WHEN {entity} = 'IBAN_TR' THEN upper(regexp_replace({value}, '(?U)\\\\s', '')) ELSE {value} END")


def exempt_value(entity: str, value: str) -> str:
    """The form in which a value is compared with the exemption list."""
    return (f"CASE WHEN {entity} IN {_NUMBER_TYPES} THEN {_only_digits(value)} "
            f"WHEN {entity} = 'PHONE_TR' THEN right({_only_digits(value)}, 10) "
            f"WHEN {entity} = 'IBAN_TR' THEN upper(regexp_replace({value}, '(?U)\\\\s', '')) "
            f"ELSE lower(regexp_replace(trim({value}), '(?U)\\\\s+', ' ')) END")


def subject_value(entity: str, value: str) -> str:
    """The form in which a person's identifier is hashed and searched."""
    v = normalized_text(value)
    return (f"CASE WHEN {entity} IN {_NUMBER_TYPES} THEN {_only_digits(v)} "
            f"WHEN {entity} = 'PHONE_TR' THEN right({_only_digits(v)}, 10) "
            f"WHEN {entity} IN ('IBAN_TR', 'PLATE_TR') THEN "
            f"replace(upper(regexp_replace({v}, '(?U)[\\\\s-]', '')), 'İ', 'I') "
            f"WHEN {entity} = 'EMAIL_ADDRESS' THEN lower(trim({v})) ELSE trim({v}) END")


def alnum(value: str) -> str:
    return f"upper(regexp_replace({value}, '[^0-9A-Za-z]', ''))"


def hmac_sha256(key: bytes, message: str) -> str:
    """HMAC from two nested SHA-256 calls (hex). The derived pads are part of the plan, like the key
    would be: restrict who may read plans of jobs that use it."""
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    inner = bytes(b ^ 0x36 for b in key).hex()
    outer = bytes(b ^ 0x5C for b in key).hex()
    return (f"sha2(concat(unhex('{outer}'), unhex(sha2(concat(unhex('{inner}'), encode({message}, 'UTF-8')), 256))), 256)")


def subject_hash(key: bytes, entity: str, value: str) -> str:
    message = f"concat({entity}, ':', {subject_value(entity, value)})"
    return f"substr({hmac_sha256(key, message)}, 1, {fixed.SUBJECT_HASH_HEX})"


def mask_label(entity: str, value: str) -> str:
    """Last four characters; first letter and domain of an e-mail address."""
    compact = f"regexp_replace({value}, '(?U)\\\\s', '')"
    return (f"CASE WHEN {entity} = 'EMAIL_ADDRESS' AND contains({value}, '@') THEN "
            f"concat(substr({value}, 1, if(instr({value}, '@') > 1, 1, 0)), '***@', substr({value}, instr({value}, '@') + 1)) "
            f"WHEN length({compact}) > 4 THEN concat(repeat('*', length({compact}) - 4), right({compact}, 4)) "
            "ELSE '****' END")


def in_list(value: str, options) -> str:
    options = list(options)
    return f"{value} IN ({', '.join(map(literal, options))})" if options else "false"
