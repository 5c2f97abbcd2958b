"""Driver-side registries: payload schemas and their evolution, settings and their versions."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from ..model import ConfigError

FORMATS = ("protobuf", "flatbuffers", "json")


@dataclass(frozen=True)
class Schema:
    """<format>:<major>.<minor>:<hash>"""

    format: str
    major: int
    minor: int
    hash: str

    @classmethod
    def parse(cls, text: str) -> Schema:
        try:
            fmt, version, digest = text.split(":")
            major, minor = map(int, version.split("."))
        except ValueError:
            raise ConfigError(f"not a schema: {text!r}") from None
        if fmt not in FORMATS or not digest:
            raise ConfigError(f"not a schema: {text!r}")
        return cls(fmt, major, minor, digest)


class SchemaRegistry:
    """Schemas by key. A key's schema may only go up by minor versions; what does not is blocked until the old one is registered again."""

    def __init__(self) -> None:
        self.known: dict[str, Schema] = {}
        self.blocked: set[str] = set()

    def register(self, key: str, schema: Schema | str) -> Schema:
        new = Schema.parse(schema) if isinstance(schema, str) else schema
        old = self.known.get(key)
        if old is None or new == old:
            self.known[key] = new
            self.blocked.discard(key)
            return new
        reason = (
            "format changed" if new.format != old.format
            else "major version changed" if new.major != old.major
            else "version went down" if new.minor < old.minor
            else "content changed under one version" if new.minor == old.minor
            else ""
        )
        if reason:
            self.blocked.add(key)
            raise ConfigError(f"{key}: {reason}")
        self.known[key] = new
        self.blocked.discard(key)
        return new

    def usable(self, key: str) -> bool:
        return key in self.known and key not in self.blocked


class SchemaCache:
    """The most recently used schemas, loaded when missing."""

    def __init__(self, load: Callable[[str], Schema], size: int = 256) -> None:
        self.load, self.size, self.held = load, size, OrderedDict()
        self.hits = self.misses = 0

    def get(self, key: str) -> Schema:
        if key in self.held:
            self.hits += 1
            self.held.move_to_end(key)
            return self.held[key]
        self.misses += 1
        self.held[key] = self.load(key)
        if len(self.held) > self.size:
            self.held.popitem(last=False)
        return self.held[key]


class Settings:
    """A mapping of versions: each change merges its top-level keys over the last; any version can come back."""

    def __init__(self, base: Mapping[str, object], classes: Mapping[str, str] | None = None) -> None:
        self.versions = [dict(base)]
        self.classes = dict(classes or {})

    @property
    def version(self) -> int:
        return len(self.versions)

    @property
    def current(self) -> dict[str, object]:
        return dict(self.versions[-1])

    def change(self, patch: Mapping[str, object]) -> str:
        """The effect: hot, reconfigure or restart, the strongest of the changed keys'."""
        changed = [k for k, v in patch.items() if self.versions[-1].get(k) != v]
        self.versions.append({**self.versions[-1], **patch})
        order = ["hot", "reconfigure", "restart"]
        return max((self.classes.get(k, "hot") for k in changed), key=order.index, default="hot")

    def rollback(self, version: int) -> dict[str, object]:
        if not 1 <= version <= len(self.versions):
            raise ConfigError(f"no version {version}")
        self.versions.append(dict(self.versions[version - 1]))
        return self.current
