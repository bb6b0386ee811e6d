"""The free-text chain and the deep pass over one text in plain Python, to hold the column functions against."""

import re

from cloakfield.functions.freetext import ALWAYS, COMMON_WORDS, CONTEXT, DEEP_TYPES, USER_BARE, VALUE_TYPES
from cloakfield.functions.tokens import TOKEN_PATTERN, token_text


def mask_line(text, salt, identities=(), users=True, profile="response", use_hash=True):
    """The full chain over one text: value types, known identities, then the formulations."""
    tok = lambda family, value: token_text(family, value, salt, use_hash)
    for family, pattern in VALUE_TYPES:
        text = re.sub(pattern, lambda m, f=family: tok(f, m[0]), text)
    strict = profile == "stream"
    for name in sorted({n for n in identities if n}, key=lambda n: (-len(n), n)):
        if re.fullmatch(TOKEN_PATTERN[1:-2], name) or len(name) < 2 or not strict and name.lower() in COMMON_WORDS:
            continue
        text = re.sub(rf"(?<!\w){re.escape(name)}(?!\w)", lambda m, n=name: tok("USER", n), text, flags=0 if strict else re.I)
    for pattern in ALWAYS + (CONTEXT if users else ()):
        if strict and pattern is USER_BARE:
            continue
        before, name, after = pattern
        text = re.sub(f"(?i){before}(?P<name>{name}){after}", lambda m: _named(m, tok, strict), text)
    return text


def _named(m, tok, whole):
    name = m["name"]
    if re.fullmatch(r"\[?(?:IP|USER|HOST|AGENT|EMAIL)_[0-9a-f]{16}\]?", name):
        return m[0]
    if name.lower() in COMMON_WORDS and re.match(r"\s+\[(?:IP|USER|HOST|AGENT|EMAIL)_", m.string[m.end("name") :]):
        return m[0]  # the name that follows is a token already
    if whole:
        return tok("USER", name)
    start, end = m.span("name")
    return m[0][: start - m.start()] + tok("USER", name) + m[0][end - m.start() :]


def mask_opaque(text, salt, registry, identities=(), use_hash=True):
    """A value of unknown meaning: known values first, then whole and embedded addresses, host names and UUIDs, then names."""
    if text in registry:
        return registry[text]
    for family, pattern in DEEP_TYPES:
        text = re.sub(pattern, lambda m, f=family: token_text(f, m[0], salt, use_hash), text)
    for name in identities:
        if len(name) > 1 and name.lower() not in COMMON_WORDS:
            text = re.sub(rf"(?<!\w){re.escape(name)}(?!\w)", lambda m, n=name: token_text("USER", n, salt, use_hash), text, flags=re.I)
    return text
