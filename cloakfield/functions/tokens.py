"""Keyed tokens as Catalyst expressions: HMAC-SHA256 composed of built-in functions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64
TOKEN_LENGTH = 16
#: Families that are recognised as tokens, and the labels used without hashing.
FAMILIES = ("IP", "USER", "HOST", "AGENT")
LABELS = {"IP": "[IP_ADDRESS]", "HOST": "[HOSTNAME]", "USER": "[USERNAME]", "AGENT": "[AGENT_ID]", "EMAIL": "[EMAIL]"}
#: A whole token.  ``\z`` and not ``$``, which would accept a trailing newline.
TOKEN_PATTERN = r"^\[(?:IP|USER|HOST|AGENT)_[0-9a-f]{16}\]\z"


def _pads(key: bytes) -> tuple[bytes, bytes]:
    if len(key) > BLOCK:
        key = hashlib.sha256(key).digest()
    key = key.ljust(BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def hmac_hex(message: Column, salt: str | bytes) -> Column:
    """The HMAC-SHA256 of a string column as 64 hex digits.

    The padded key is a literal of the plan; do not publish plans that hold it.
    """
    inner, outer = _pads(salt.encode() if isinstance(salt, str) else salt)
    first = F.sha2(F.concat(F.lit(bytearray(inner)), F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(F.lit(bytearray(outer)), F.unhex(first)), 256)


def is_token(value: Column) -> Column:
    return F.coalesce(value.rlike(TOKEN_PATTERN), F.lit(False))


def token(family: str, value: Column, salt: str | bytes, use_hash: bool = True) -> Column:
    """``[FAMILY_16hex]`` of a value; null and empty stay, and a token stays as it is."""
    text = value.cast("string")
    label = LABELS.get(family, f"[{family}]")
    made = F.concat(F.lit(f"[{family}_"), F.substring(hmac_hex(F.concat(F.lit(f"{family}:"), text), salt), 1, TOKEN_LENGTH), F.lit("]")) if use_hash else F.lit(label)
    return F.when(text.isNull() | (text == "") | is_token(text), text).otherwise(made)


def text_literal(text: str) -> str:
    """A string literal of Spark SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def token_expr(family: str, value: str, salt: str, use_hash: bool = True) -> str:
    """:func:`token` as Spark SQL over a string; ``family`` is SQL too, and a null family has a null token."""
    inner, outer = (p.hex() for p in _pads(salt.encode()))
    label = "CASE " + " ".join(f"WHEN {family} = '{f}' THEN '{x}'" for f, x in LABELS.items()) + f" ELSE concat('[', {family}, ']') END"
    digest = f"sha2(concat(X'{outer}', unhex(sha2(concat(X'{inner}', encode(concat({family}, ':', {value}), 'UTF-8')), 256))), 256)"
    made = f"concat('[', {family}, '_', substring({digest}, 1, {TOKEN_LENGTH}), ']')" if use_hash else label
    return f"CASE WHEN {family} IS NULL THEN NULL WHEN {value} IS NULL OR {value} = '' OR {value} RLIKE {text_literal(TOKEN_PATTERN)} THEN {value} ELSE {made} END"


def token_sql(family: str, value: str, salt: str) -> str:
    """The same token as a DuckDB expression, for oracles."""
    inner, outer = (p.hex() for p in _pads(salt.encode()))
    digest = f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode('{family}:' || {value}))))"
    return f"CASE WHEN {value} IS NULL OR {value} = '' OR regexp_full_match({value}, '\\[(IP|USER|HOST|AGENT)_[0-9a-f]{{16}}\\]') THEN {value} ELSE '[{family}_' || substr({digest}, 1, {TOKEN_LENGTH}) || ']' END"


def weak_salt(salt: str) -> bool:
    return len(salt.strip()) < 32


def token_text(family: str, value: str, salt: str, use_hash: bool = True) -> str:
    """The token of one string, for Arrow functions; equal to :func:`token`."""
    import hmac
    import re

    if not value or re.fullmatch(TOKEN_PATTERN[1:-2], value):
        return value
    if not use_hash:
        return LABELS.get(family, f"[{family}]")
    return f"[{family}_{hmac.new(salt.encode(), f'{family}:{value}'.encode(), 'sha256').hexdigest()[:TOKEN_LENGTH]}]"
