"""Masking of personal data inside free text, as Catalyst expressions.

Two profiles: ``response`` replaces only the captured name and keeps its context; ``stream`` replaces the
whole match, has no bare form and no stop list.  Each step of the chain feeds the next; the running text is bound
by a higher-order function, so it is computed once a step and no plan grows with the number of steps.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakfield.functions.tokens import TOKEN_PATTERN, text_literal, token_expr
from cloakfield.functions.values import EMAIL, FQDN, IPV4, IPV6, IPV6_STRICT, UUID, unicode

# fixed values: words that are no evidence of a name on their own.  They are the reference behaviour and a set: their order has no meaning
COMMON_WORDS = frozenset(
    "account admin agent audit count custom data debug default error event file group host id index info level log login manager message name network "
    "policy process result role root rule server service session size status system time total trace type user value warning".split()
)
# fixed values: formulations that name a user, as what stands before the name, the name, and what stands after it; without regard to case
_CHARS = r"\w.@%+=-"
BOUNDARY = r"\b"
USER_NOUN = (r"\b(?:user|username|user[-_ ]?name|account)\b\s*(?:name\s*)?[:=]\s*(?:\"|'|`)?", r"[A-Za-z0-9_.@%+=-]{2,64}", "")
USER_AUTH = (r"\b(?:login|logon|sign[- ]?in|authenticat(?:e|ed|ion))\b\s+(?:as|for|by)\s+(?:\buser\b\s+)?", r"[A-Za-z0-9_.@%+=-]{2,64}", BOUNDARY)
UID_EQ = (r"\buid\s*=\s*", rf"[^\W\d_][{_CHARS}]{{1,63}}", BOUNDARY)
FOR_USER = (r"\b(?:for|by)\s+user\s+", rf"[{_CHARS}]{{2,64}}", BOUNDARY)
SSH_PUBKEY = (r"\bAccepted\s+publickey\s+for\s+", rf"[{_CHARS}]{{2,64}}", BOUNDARY)
UID_PAREN = (r"\b(?:by|as|for)\s+", rf"[{_CHARS}]{{2,64}}", r"\s*\(\s*uid\s*=\s*\d+\s*\)")
USER_BARE = (rf"\buser\s+(?!(?:{'|'.join(sorted(COMMON_WORDS))})\b)", rf"[{_CHARS}]{{2,64}}", BOUNDARY)

ALWAYS = (USER_NOUN, USER_AUTH)
CONTEXT = (UID_EQ, FOR_USER, SSH_PUBKEY, UID_PAREN, USER_BARE)
VALUE_TYPES = (("EMAIL", EMAIL), ("IP", IPV6), ("IP", IPV4))
#: What the deep pass looks for in values of unknown meaning.
DEEP_TYPES = (*VALUE_TYPES, ("HOST", FQDN), ("USER", UUID))
#: Characters without which a pattern cannot match; looking for them is far cheaper.
NEEDS = {EMAIL: "@", IPV4: ".", IPV6: ":", IPV6_STRICT: ":", FQDN: ".", UUID: "-"}
_COMMON = rf"(?i)^(?:{'|'.join(sorted(COMMON_WORDS))})$"
#: A known name stands between these; what is quoted ends with the last.
BEHIND, AHEAD, END = r"(?<!\w)", r"(?!\w)", r"\E"
#: Stands beside a match while a text is cut.
MARK = "\x01"
_FAMILY = "(?:IP|USER|HOST|AGENT|EMAIL)"


class _Chain:
    """Steps over a running text as SQL.  A step is a function of the SQL of a text; each is bound by a variable of its own."""

    def __init__(self, salt: str, use_hash: bool):
        self.salt, self.use_hash, self.n = salt, use_hash, 0

    def bind(self, value: str, body: Callable[[str], str]) -> str:
        """``body`` of a variable that holds ``value``, so that it is computed once and written once."""
        self.n += 1
        name = f"v{self.n}"
        return f"element_at(transform(array({value}), {name} -> {body(name)}), 1)"

    def token(self, family: str, value: str) -> str:
        return token_expr(f"'{family}'", value, self.salt, self.use_hash)

    def joined(self, text: str, pattern: str, replaced: Callable[[str, str], str]) -> str:
        """``text`` with ``replaced(match, what follows it)`` for each match of ``pattern``.

        One scan puts a mark on both sides of each match, so every second part between marks is one.  The mark is a
        control character, or where the text has that, the text's digest between two.
        """
        self.n += 1
        piece, at = f"p{self.n}", f"i{self.n}"

        def parts(mark: str) -> str:
            return f"split(regexp_replace({text}, {text_literal(pattern)}, concat({mark}, '$0', {mark})), {mark}, -1)"

        def join(m: str) -> str:
            made = replaced(piece, f"get({m}, {at} + 1)")
            return f"CASE WHEN size({m}) = 1 THEN {text} ELSE array_join(transform({m}, ({piece}, {at}) -> CASE WHEN {at} % 2 = 1 THEN {made} ELSE {piece} END), '') END"

        mark = text_literal(MARK)
        # not bound by a variable: each level more costs the analyzer a pass
        rare = f"concat({mark}, md5(encode({text}, 'UTF-8')), {mark})"
        return self.bind(f"CASE WHEN contains({text}, {mark}) THEN {parts(rare)} ELSE {parts(mark)} END", join)

    def values(self, family: str, pattern: str) -> Callable[[str], str]:
        def step(text: str) -> str:
            made = self.joined(text, unicode(pattern), lambda m, _: self.token(family, m))
            return f"CASE WHEN contains({text}, '{NEEDS[pattern]}') THEN {made} ELSE {text} END"

        return step

    def names(self, known: str, strict: bool) -> Callable[[str], str]:
        """Known names as whole words, the longest first; without regard to case unless ``strict``."""
        common = "" if strict else f" AND NOT n RLIKE {text_literal(_COMMON)}"
        usable = f"filter(array_distinct({known}), n -> length(n) >= 2 AND NOT n RLIKE {text_literal(TOKEN_PATTERN)}{common})"
        ordered = f"coalesce(array_sort(transform({usable}, n -> named_struct('k', -length(n), 'n', n))), cast(array() AS array<struct<k:int,n:string>>))"
        lead = "(?U)" if strict else "(?U)(?i)"
        quoted = f"concat({text_literal(lead + BEHIND + chr(92) + 'Q')}, replace(y.n, {text_literal(END)}, {text_literal(END + chr(92) + END + chr(92) + 'Q')}), {text_literal(END + AHEAD)})"
        return lambda text: f"aggregate({ordered}, {text}, (done, y) -> regexp_replace(done, {quoted}, {self.token('USER', 'y.n')}))"

    def formulation(self, parts: tuple[str, str, str], whole: bool) -> Callable[[str], str]:
        """Names in one formulation become tokens, or whole matches do."""
        before, name, after = parts
        pattern = f"(?U)(?i)(?:{before})(?:{name})(?:{after})"
        # of one match, cut from its context: what only looks ahead has been met, and the name goes to the end
        split = text_literal(f"(?U)(?i)^({before})({name})({'' if after == BOUNDARY else after})\\z")
        is_token, before_token = text_literal(rf"^\[?{_FAMILY}_[0-9a-f]{{16}}\]?$"), text_literal(rf"(?U)^\s+\[{_FAMILY}_")

        def replaced(match: str, rest: str) -> str:
            cut = f"named_struct('head', regexp_extract({match}, {split}, 1), 'name', regexp_extract({match}, {split}, 2), 'tail', regexp_extract({match}, {split}, 3), 'all', {match}, 'rest', {rest})"

            def put(m: str) -> str:
                made = self.token("USER", f"{m}.name")
                # left as it is: a token, and a common word before a token, where the name that follows is masked already
                kept = f"{m}.name RLIKE {is_token} OR ({m}.name RLIKE {text_literal(_COMMON)} AND concat({m}.tail, {m}.rest) RLIKE {before_token})"
                return f"CASE WHEN {kept} THEN {m}.all ELSE {made if whole else f'concat({m}.head, {made}, {m}.tail)'} END"

            return self.bind(cut, put)

        return lambda text: self.joined(text, pattern, replaced)

    def run(self, text: Column, steps: list[Callable[[str], str]], names: Column | None = None, needs: tuple[str, ...] = ()) -> Column:
        """The steps, one after the other.  As one SQL expression: a chain has thousands of nodes, each of which would be a call to the JVM.

        A text with none of the characters in ``needs``, if these are given, is left as it is.
        """
        sql = "array(x.t)"
        for k, step in enumerate(steps):
            sql = f"transform({sql}, s{k} -> {step(f's{k}')})"
        given, made = F.struct(text.alias("t"), *([names.alias("n")] if names is not None else [])), f"element_at({sql}, 1)"
        if needs:
            made = f"CASE WHEN {' OR '.join(f'contains(x.t, {text_literal(c)})' for c in dict.fromkeys(needs))} THEN {made} ELSE x.t END"
        return F.element_at(F.call_function("transform", F.array(given), F.expr(f"x -> {made}")), 1)


def mask_values(text: Column, salt: str, use_hash: bool = True, strict_ipv6: bool = False) -> Column:
    """Replaces e-mail and IP addresses inside a text.

    The wide IPv6 pattern also takes clock times and misses compressed addresses; ``strict_ipv6`` takes the exact one.
    """
    chain = _Chain(salt, use_hash)
    return chain.run(text, [chain.values(family, IPV6_STRICT if strict_ipv6 and pattern == IPV6 else pattern) for family, pattern in VALUE_TYPES], needs=tuple(NEEDS[p] for _, p in VALUE_TYPES))


def mask_deep(text: Column, salt: str, use_hash: bool = True) -> Column:
    """Replaces addresses, host names and UUIDs inside a value of unknown meaning."""
    chain = _Chain(salt, use_hash)
    return chain.run(text, [chain.values(family, pattern) for family, pattern in DEEP_TYPES], needs=tuple(NEEDS[p] for _, p in DEEP_TYPES))


def mask_text(text: Column, salt: str, identities: Column | None = None, users: bool = True, profile: str = "response", use_hash: bool = True) -> Column:
    """The full chain over a column: value types, each row's own identities, then the formulations."""
    chain, strict = _Chain(salt, use_hash), profile == "stream"
    steps = [chain.values(family, pattern) for family, pattern in VALUE_TYPES]
    if identities is not None:
        steps.append(chain.names("x.n", strict))
    steps += [chain.formulation(f, strict) for f in ALWAYS + (CONTEXT if users else ()) if not (strict and f is USER_BARE)]
    return chain.run(text, steps, identities)


def mask_whole(text: Column, salt: str, use_hash: bool = True) -> Column:
    """A token where the whole stripped text is an address or host name, or is a token already; else null."""
    chain = _Chain(salt, use_hash)
    full = lambda v, p: f"{v} RLIKE {text_literal(f'^(?:{p})$')}"

    def step(t: str) -> str:
        family = lambda v: f"CASE WHEN contains({v}, ' ') OR NOT (contains({v}, '.') OR contains({v}, ':')) THEN NULL WHEN {full(v, EMAIL)} THEN 'EMAIL' WHEN {full(v, IPV4)} OR {full(v, IPV6)} THEN 'IP' WHEN {full(v, FQDN)} AND NOT contains({v}, '://') THEN 'HOST' END"
        made = chain.bind(f"trim({t})", lambda v: chain.bind(family(v), lambda f: token_expr(f, v, salt, use_hash)))
        return f"CASE WHEN {t} RLIKE {text_literal(TOKEN_PATTERN)} THEN {t} ELSE {made} END"

    return chain.run(text, [step])


def residual(text: Column) -> Column:
    """Whether an address is left in a text."""
    found = (text.contains("@") & text.rlike(unicode(EMAIL)), text.contains(".") & text.rlike(unicode(IPV4)), text.contains(":") & text.rlike(unicode(IPV6)))
    out = F.lit(False)
    for f in found:
        out = out | f
    return F.coalesce(out, F.lit(False))
