"""Tenant masking policies and configuration: environment over file over default."""

from __future__ import annotations

import hashlib
import json
import os
import re
from dataclasses import dataclass, field
from fnmatch import fnmatchcase

from cloakfield.functions.tokens import FAMILIES, weak_salt
from cloakfield.sources.catalog import RequestError, check_tenant

#: The family of a field by its exact name or first matching suffix; anything else is a user.
FIELD_FAMILY = {
    ".ip": "IP",
    "user.name": "USER",
    "user.id": "USER",
    "source.user.name": "USER",
    "destination.user.name": "USER",
    "host.hostname": "HOST",
    "host.name": "HOST",
    "agent.name": "HOST",
    "related.hosts": "HOST",
    "agent.id": "AGENT",
    "source.domain": "HOST",
    "destination.domain": "HOST",
    "url.domain": "HOST",
}
#: Fields that a policy may not name: hashes are no identities, and the message belongs to the free-text pass.
REFUSED = ("related.hash",)
FREE_TEXT = ("message",)
DURATION = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}


def family_of(name: str) -> str:
    return FIELD_FAMILY.get(name) or next((f for suffix, f in FIELD_FAMILY.items() if name.endswith(suffix)), "USER")


def seconds(duration: str) -> int:
    """``30d`` and ``43200m`` are the same duration."""
    m = re.fullmatch(r"(\d+)([smhdw])", duration.strip().lower())
    if not m:
        raise RequestError(f"not a duration: {duration!r}")
    return int(m[1]) * DURATION[m[2]]


@dataclass(frozen=True)
class FieldSpec:
    field: str
    family: str
    array: bool = False


@dataclass(frozen=True)
class Policy:
    """Which fields of a tenant are masked, and how."""

    tenant: str
    salt: str
    fields: tuple[FieldSpec, ...] = ()
    free_text: tuple[str, ...] = FREE_TEXT
    mask_free_text_users: bool = True
    use_hash: bool = True

    @classmethod
    def parse(cls, data: dict, env: dict[str, str] | None = None) -> Policy:
        env = os.environ if env is None else env
        tenant = check_tenant(data.get("tenant", ""))
        salt = env.get(data.get("salt_env", ""), "")
        specs = []
        for entry in data.get("fields", []):
            entry = {"field": entry} if isinstance(entry, str) else entry
            name = entry["field"]
            family = entry.get("family") or family_of(name)
            if name in REFUSED or name in FREE_TEXT:
                raise RequestError(f"{name} cannot be a masked field")
            if family not in FAMILIES:
                raise RequestError(f"{name}: no such family: {family}")
            specs.append(FieldSpec(name, family, bool(entry.get("array"))))
        if len({s.field for s in specs}) < len(specs):
            raise RequestError("a field is listed twice")
        extra = [x["field"] if isinstance(x, dict) else x for x in data.get("free_text_fields", [])]
        return cls(tenant, salt, tuple(specs), tuple(dict.fromkeys((*FREE_TEXT, *extra))), bool(data.get("mask_free_text_users", True)), bool(data.get("use_hash", True)))

    @classmethod
    def load(cls, path: str, env: dict[str, str] | None = None) -> Policy:
        with open(path, encoding="utf-8") as f:
            text = f.read()
        if path.endswith((".yaml", ".yml")):
            import yaml

            return cls.parse(yaml.safe_load(text) or {}, env)
        return cls.parse(json.loads(text), env)

    def spec(self, path: str) -> FieldSpec | None:
        """The first configured field that a path is, or ends with."""
        return next((s for s in self.fields if path == s.field or path.endswith("." + s.field)), None)

    def fingerprint(self) -> str:
        """Of everything but the salt."""
        body = {"tenant": self.tenant, "fields": [[s.field, s.family, s.array] for s in self.fields], "free_text": self.free_text, "users": self.mask_free_text_users, "hash": self.use_hash}
        return hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()

    def warnings(self) -> list[str]:
        out = [] if self.fields else ["no field is masked"]
        if self.use_hash and weak_salt(self.salt):
            out.append("the salt has fewer than 32 characters")
        return out


def drift(wanted: Policy, deployed: Policy) -> dict[str, list[str]]:
    """Fields that only one of two policies masks, or masks differently."""
    a, b = ({s.field: s for s in p.fields} for p in (wanted, deployed))
    return {
        "missing": sorted(a.keys() - b.keys()),
        "extra": sorted(b.keys() - a.keys()),
        "changed": sorted(f for f in a.keys() & b.keys() if a[f] != b[f]),
    }


def json_diff(a, b, path: str = "$") -> list[str]:
    """Paths at which two JSON values differ."""
    if isinstance(a, dict) and isinstance(b, dict):
        return [x for k in sorted(a.keys() | b.keys()) for x in json_diff(a.get(k), b.get(k), f"{path}.{k}")]
    if isinstance(a, list) and isinstance(b, list) and len(a) == len(b):
        return [x for i, (p, q) in enumerate(zip(a, b)) for x in json_diff(p, q, f"{path}[{i}]")]
    return [] if a == b else [path]


def merge_fields(existing: list[str], new: list[str]) -> list[str]:
    """Appends new fields in order, each once."""
    return list(dict.fromkeys([*existing, *new]))


def merge_warning(name: str, env: dict[str, str] | None = None) -> str | None:
    """What to say after a merge into the file's setting ``name``: nothing, or that the environment's value hides the file's."""
    env = os.environ if env is None else env
    return f"{name.upper()} is set in the environment, so the merged {name} of the file has no effect" if name.upper() in env else None


def setting(name: str, file: dict, default, env: dict[str, str] | None = None):
    """One setting: the environment wins over the file, the file over the default."""
    env = os.environ if env is None else env
    return env.get(name.upper(), file.get(name, default))


def gate_mode(value) -> str:
    """block, drop or off; booleans mean block and off, anything else is refused."""
    if value is None:
        return "block"
    text = str(value).strip().lower()
    modes = {"block": "block", "true": "block", "on": "block", "1": "block", "drop": "drop", "strip": "drop", "off": "off", "false": "off", "0": "off", "allow": "off"}
    if text not in modes:
        raise RequestError(f"no such gate mode: {value!r}")
    return modes[text]


def overlaps(pattern: str, quarantine: str) -> bool:
    """Whether a table pattern could reach the quarantine table."""
    return any(fnmatchcase(quarantine, p.strip()) for p in pattern.split(","))


@dataclass
class Settings:
    """Limits of the engine."""

    size_cap: int = 100
    schema_cap: int = 200
    total_cap: int = 10_000
    gate: str = "block"
    sample_size: int = 10
    #: Whether answers leave the house, where an open gate is worth a warning.
    external: bool = False
    extra: dict = field(default_factory=dict)
