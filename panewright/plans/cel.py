"""The rule language: conditions over metric bindings, compiled to Spark columns.

Conditions are built from the node classes, or parsed from text:

    fast["errors"].value > 2 * max(1, baseline["errors"].value) && fast["errors"].labels["zone"] == payload.zone

A condition is true or false, never unknown: a comparison with a missing value is false, and only
then negated. Comparisons with NaN are false. Nothing here knows a clock, chance or the outside.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import ConfigError

EPSILON = 2.220446049250313e-16
CONTEXT = ("window_start_ns", "window_end_ns", "watermark_ns", "rule_version", "partition_key", "partition_id", "log_index", "event_id", "schema_key")


class CelError(ConfigError):
    pass


# ---------------------------------------------------------------- conditions


@dataclass(frozen=True)
class Always:
    value: bool


@dataclass(frozen=True)
class HasValue:
    metric: str


@dataclass(frozen=True)
class Compare:
    """metric <op> number; op is gt, ge, lt, le or eq."""

    metric: str
    op: str
    number: float


@dataclass(frozen=True)
class LabelEquals:
    metric: str
    label: str
    value: str


@dataclass(frozen=True)
class FlagContains:
    metric: str
    flag: str


@dataclass(frozen=True)
class Not:
    part: object


@dataclass(frozen=True)
class And:
    parts: tuple = ()


@dataclass(frozen=True)
class Or:
    parts: tuple = ()


# ---------------------------------------------------------------- values, only in text


@dataclass(frozen=True)
class Literal:
    value: object


@dataclass(frozen=True)
class Field:
    """field is value, has_value or labels; label is its key. alias names the phase that the metric is of."""

    alias: str
    metric: str
    field: str
    label: str | None = None


@dataclass(frozen=True)
class Payload:
    path: tuple[str, ...]


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Unary:
    op: str
    part: object


#: Helper -> (fewest, most) arguments.
HELPERS = {"max": (1, 99), "min": (1, 99), "coalesce": (1, 99), "clamp": (3, 3), "safe_div": (3, 3), "abs": (1, 1)}

_TOKEN = re.compile(r"\s*(?:(?P<number>\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|(?P<string>\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*')|(?P<name>[A-Za-z_]\w*)|(?P<op>&&|\|\||==|!=|<=|>=|[<>!+\-*/%().,\[\]{}:])|(?P<bad>\S))")
_LEVELS = [("||",), ("&&",), ("==", "!=", "<", "<=", ">", ">="), ("+", "-"), ("*", "/")]


class _Parser:
    def __init__(self, text: str) -> None:
        self.tokens, at = [], 0
        while (m := _TOKEN.match(text, at)) and m.lastgroup:
            if m.lastgroup == "bad":
                raise CelError(f"unexpected {m['bad']!r} at {m.start('bad')}")
            self.tokens.append((m.lastgroup, m[m.lastgroup], m.start(m.lastgroup)))
            at = m.end()
        self.k, self.size = 0, len(text)

    def peek(self) -> tuple[str, str, int]:
        return self.tokens[self.k] if self.k < len(self.tokens) else ("end", "", self.size)

    def take(self, *values: str) -> tuple[str, str, int]:
        t = self.peek()
        if t[0] == "end" or (values and t[1] not in values):
            raise CelError(f"expected {' or '.join(values) or 'more'}, found {t[1] or 'the end'!r} at {t[2]}")
        self.k += 1
        return t

    def whole(self) -> object:
        e = self.level(0)
        if self.peek()[0] != "end":
            raise CelError(f"unexpected {self.peek()[1]!r} at {self.peek()[2]}")
        return e

    def level(self, k: int) -> object:
        if k == len(_LEVELS):
            return self.unary()
        left = self.level(k + 1)
        while self.peek()[0] == "op" and self.peek()[1] in _LEVELS[k]:
            op = self.take()[1]
            left = Binary(op, left, self.level(k + 1))
        return left

    def unary(self) -> object:
        if self.peek()[1] in ("!", "-") and self.peek()[0] == "op":
            op = self.take()[1]
            return Unary(op, self.unary())
        return self.primary()

    def text(self) -> str:
        kind, s, at = self.take()
        if kind != "string":
            raise CelError(f"expected a quoted text at {at}")
        return re.sub(r"\\(.)", r"\1", s[1:-1])

    def primary(self) -> object:
        kind, s, at = self.take()
        if kind == "number":
            return Literal(float(s))
        if kind == "string":
            return Literal(re.sub(r"\\(.)", r"\1", s[1:-1]))
        if s == "(":
            e = self.level(0)
            self.take(")")
            return e
        if kind != "name":
            raise CelError(f"unexpected {s!r} at {at}")
        if s in ("true", "false"):
            return Literal(s == "true")
        if s == "payload" or s == "headers":
            return self.path(s)
        if s == "select" and self.peek()[1] == "(":
            raise CelError(f"select at {at}: bindings resolve by the event's labels here")
        if self.peek()[1] == "(":
            return self.call(s, at)
        if self.peek()[1] == "[":
            return self.field(s)
        if s in CONTEXT:
            return Name(s)
        raise CelError(f"unknown name {s!r} at {at}")

    def path(self, root: str) -> object:
        parts = []
        while self.peek()[1] in (".", "["):
            if self.take()[1] == ".":
                parts.append(self.take()[1])
            else:
                parts.append(self.text())
                self.take("]")
        if root == "headers":
            return Name(parts[0]) if len(parts) == 1 and parts[0] in CONTEXT else Payload(("headers", *parts))
        return Payload(tuple(parts))

    def call(self, name: str, at: int) -> object:
        if name not in HELPERS:
            raise CelError(f"unknown function {name!r} at {at}")
        self.take("(")
        args = []
        while self.peek()[1] != ")":
            args.append(self.level(0))
            if self.peek()[1] != ")":
                self.take(",")
        self.take(")")
        low, high = HELPERS[name]
        if not low <= len(args) <= high:
            raise CelError(f"{name} at {at}: wrong number of arguments")
        return Call(name, tuple(args))

    def field(self, alias: str) -> object:
        self.take("[")
        metric = self.text()
        self.take("]")
        self.take(".")
        _, field, at = self.take()
        if field == "labels":
            self.take("[")
            label = self.text()
            self.take("]")
            return Field(alias, metric, field, label)
        if field not in ("value", "has_value"):
            raise CelError(f"unknown field {field!r} at {at}")
        return Field(alias, metric, field)


def parse(text: str) -> object:
    return _Parser(text).whole()


# ---------------------------------------------------------------- checks


def walk(e: object) -> Iterator[object]:
    yield e
    for part in {Not: lambda: [e.part], Unary: lambda: [e.part], And: lambda: e.parts, Or: lambda: e.parts, Binary: lambda: [e.left, e.right], Call: lambda: e.args}.get(type(e), lambda: [])():
        yield from walk(part)


def check_labels(e: object, allowed: Mapping[str, frozenset[str]]) -> None:
    """Every label that a rule reads must be declared for its metric."""
    for x in walk(e):
        label = x.label if isinstance(x, LabelEquals | Field) else None
        if label is not None and label not in allowed.get(x.metric, frozenset()):
            raise CelError(f"label {label!r} is not declared for {x.metric!r}")


def check_comparable(e: object, groups: Mapping[str, tuple[str, ...]]) -> None:
    """Labels of two metrics may be compared only if both are grouped by the same set."""
    for x in walk(e):
        if isinstance(x, Binary) and isinstance(x.left, Field) and isinstance(x.right, Field) and "labels" in (x.left.field, x.right.field):
            a, b = (frozenset(groups.get(f.metric, ())) for f in (x.left, x.right))
            if a != b:
                raise CelError(f"{x.left.metric!r} and {x.right.metric!r} are grouped by different labels")


# ---------------------------------------------------------------- columns

Resolver = Callable[[str, str], Column]


def in_map(bindings: Column) -> Resolver:
    """Bindings in a map column, by metric name whatever the alias."""
    return lambda _alias, metric: bindings[metric]


def _known(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _both(op: str, a: Column, b: Column) -> Column:
    """A comparison of numbers: false for a missing value or NaN."""
    fine = ~F.isnan(a) & ~F.isnan(b)
    match op:
        case "gt" | ">":
            c = a > b
        case "ge" | ">=":
            c = a >= b
        case "lt" | "<":
            c = a < b
        case "le" | "<=":
            c = a <= b
        case _:  # infinities are not equal to themselves: their difference is no number
            c = F.abs(a - b) < EPSILON
            return _known(fine & c & ~F.isnan(a - b)) if op != "!=" else _known(fine & ~(c & ~F.isnan(a - b)))
    return _known(fine & c)


class Compiler:
    """context: columns by name, for Name; payload: a JSON text column."""

    def __init__(self, resolver: Resolver, payload: Column | None = None, context: Mapping[str, Column] | None = None) -> None:
        self.resolver, self.payload, self.context = resolver, payload, context or {}

    def condition(self, e: object) -> Column:
        match e:
            case Always(value):
                return F.lit(value)
            case HasValue(metric):
                return _known(self.resolver("", metric)["has_value"])
            case Compare(metric, op, number):
                return _both(op, self.number(Field("", metric, "value")), F.lit(float(number)))
            case LabelEquals(metric, label, value):
                return _known(self.resolver("", metric)["labels"][label] == value)
            case FlagContains(metric, flag):
                return _known(F.array_contains(self.resolver("", metric)["flags"], flag))
            case Not(part):
                return ~self.condition(part)
            case And(parts):
                return reduce(lambda a, b: a & b, map(self.condition, parts), F.lit(True))
            case Or(parts):
                return reduce(lambda a, b: a | b, map(self.condition, parts), F.lit(False))
            case Binary("&&", left, right):
                return self.condition(left) & self.condition(right)
            case Binary("||", left, right):
                return self.condition(left) | self.condition(right)
            case Unary("!", part):
                return ~self.condition(part)
            case Literal(bool() as value):
                return F.lit(value)
            case Field(alias, metric, "has_value"):
                return _known(self.resolver(alias, metric)["has_value"])
            case Payload():
                return _known(self.text(e) == "true")
            case Binary(op, left, right) if op in ("==", "!=", "<", "<=", ">", ">="):
                return self.compared(op, left, right)
        raise CelError(f"not a condition: {e}")

    def compared(self, op: str, left: object, right: object) -> Column:
        kinds = {self.kind(left), self.kind(right)} - {"any"}
        if kinds == {"boolean"}:
            a, b = (self.condition(x) if self.kind(x) == "boolean" else self.text(x) == "true" for x in (left, right))
            known = reduce(lambda x, y: x & y, [self.text(x).isNotNull() for x in (left, right) if self.kind(x) == "any"], F.lit(True))
            if op not in ("==", "!="):
                raise CelError("booleans have no order")
            return _known(known & (a == b if op == "==" else a != b))
        if kinds == {"number"}:
            return _both(op, self.number(left), self.number(right))
        if len(kinds) > 1:
            raise CelError(f"cannot compare {' with '.join(sorted(kinds))}")
        a, b = self.text(left), self.text(right)
        return _known({"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op])

    def kind(self, e: object) -> str:
        match e:
            case Literal(value):
                return "boolean" if isinstance(value, bool) else "number" if isinstance(value, float | int) else "text"
            case Field(_, _, field):
                return {"value": "number", "labels": "text", "has_value": "boolean"}[field]
            case Name(name):
                return "number" if name.endswith("_ns") or name in ("rule_version", "log_index") else "text"
            case Payload():
                return "any"
            case Call() | Unary("-", _):
                return "number"
            case Binary(op, _, _):
                return "number" if op in "+-*/" else "boolean"
        return "boolean"

    def number(self, e: object) -> Column:
        """A double, null where anything in it is missing."""
        match e:
            case Literal(value):
                return F.lit(float(value))
            case Field(alias, metric, "value"):
                b = self.resolver(alias, metric)
                return F.when(b["has_value"], b["value"])
            case Payload():
                return self.text(e).try_cast("double")
            case Name(name):
                return self.named(name).cast("double")
            case Unary("-", part):
                return -self.number(part)
            case Binary("/", left, right):
                return F.try_divide(self.number(left), self.number(right))
            case Binary(op, left, right) if op in "+-*":
                a, b = self.number(left), self.number(right)
                return {"+": a + b, "-": a - b, "*": a * b}[op]
            case Call(name, args):
                a = [self.number(x) for x in args]
                missing = reduce(lambda x, y: x | y, [x.isNull() for x in a])
                match name:
                    case "max" | "min":
                        best = a[0] if len(a) == 1 else (F.greatest if name == "max" else F.least)(*a)
                        return F.when(~missing, best)
                    case "coalesce":
                        return F.coalesce(*a)
                    case "clamp":
                        return F.when(~missing, F.least(F.greatest(a[0], a[1]), a[2]))
                    case "safe_div":
                        return F.when((a[1] == 0) | a[1].isNull() | a[0].isNull(), a[2]).otherwise(F.try_divide(a[0], a[1]))
                    case _:
                        return F.abs(a[0])
        raise CelError(f"not a number: {e}")

    def text(self, e: object) -> Column:
        match e:
            case Literal(bool() as value):
                return F.lit("true" if value else "false")
            case Literal(value):
                return F.lit(str(value))
            case Field(alias, metric, "labels", label):
                return self.resolver(alias, metric)["labels"][label]
            case Payload(path):
                if self.payload is None:
                    raise CelError("there is no payload here")
                steps = "".join(f"['{p}']" for p in path)
                return F.get_json_object(self.payload, f"${steps}")
            case Name(name):
                return self.named(name).cast("string")
        if self.kind(e) == "number":
            return self.number(e).cast("string")
        return self.condition(e).cast("string")

    def named(self, name: str) -> Column:
        if name not in self.context:
            raise CelError(f"{name!r} is not known here")
        return self.context[name]

    def value(self, e: object) -> Column:
        """For payloads: the value in its own type; nanoseconds are no doubles."""
        if isinstance(e, Name):
            return self.named(e.name)
        return {"number": self.number, "boolean": self.condition}.get(self.kind(e), self.text)(e)


def payload_json(fields: Mapping[str, object], compiler: Compiler) -> Column:
    """A JSON text of fields whose values are expressions; missing values are left out."""
    if not fields:
        return F.lit("{}")
    return F.to_json(F.struct(*[compiler.value(parse(v) if isinstance(v, str) else v).alias(k) for k, v in fields.items()]))
