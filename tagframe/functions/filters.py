"""Conditions on tags, built in Python: ``tag("siteRef", "geoCity") == "Richmond"``, ``tag("point") & ~tag("equipRef")``, ``fits("ph::Ahu")``.

A path goes along references to a tag at its end. A missing tag makes every comparison false, ``!=`` too; ``~`` applies to a path only. Numbers
with a unit are ``num(72, "°F")``, references ``ref_to("site")``; strings, numbers, booleans, dates, times and times with a zone are
Python's own. ``plans.compile`` turns conditions into column predicates and joins.
"""

from __future__ import annotations

import datetime as dt
import decimal
import json
import math
from dataclasses import dataclass

MARKER, NA, REMOVE, NULL = ({"kind": k} for k in ("marker", "na", "remove", "null"))


class FilterError(ValueError):
    pass


class Node:
    def __and__(self, other: Node) -> And:
        return And(self, _condition(other))

    def __or__(self, other: Node) -> Or:
        return Or(self, _condition(other))

    def __invert__(self) -> Node:
        raise FilterError("only a path can be missing")

    def __bool__(self) -> bool:
        raise FilterError("conditions are joined by & and |")


def _condition(x: object) -> Node:
    if not isinstance(x, Node):
        raise FilterError(f"no condition: {x!r}")
    return x


@dataclass(frozen=True, eq=False)
class Has(Node):
    path: tuple[str, ...]

    def __invert__(self) -> Missing:
        return Missing(self.path)

    def _compare(self, op: str, value: object) -> Compare:
        return Compare(self.path, op, tuple(literal(value).items()))

    def __eq__(self, value: object) -> Compare:  # type: ignore[override]
        return self._compare("==", value)

    def __ne__(self, value: object) -> Compare:  # type: ignore[override]
        return self._compare("!=", value)

    def __lt__(self, value: object) -> Compare:
        return self._compare("<", value)

    def __le__(self, value: object) -> Compare:
        return self._compare("<=", value)

    def __gt__(self, value: object) -> Compare:
        return self._compare(">", value)

    def __ge__(self, value: object) -> Compare:
        return self._compare(">=", value)

    __hash__ = object.__hash__


@dataclass(frozen=True, eq=False)
class Missing(Node):
    path: tuple[str, ...]


@dataclass(frozen=True, eq=False)
class Compare(Node):
    path: tuple[str, ...]
    op: str
    value: tuple  # of (field, value) pairs

    @property
    def literal(self) -> dict:
        return dict(self.value)


@dataclass(frozen=True, eq=False)
class And(Node):
    left: Node
    right: Node


@dataclass(frozen=True, eq=False)
class Or(Node):
    left: Node
    right: Node


@dataclass(frozen=True, eq=False)
class Fits(Node):
    type_name: str


def tag(*path: str) -> Has:
    """A tag at the end of a path of references; by itself: it is there."""
    if not path or not all(isinstance(p, str) and p.isidentifier() for p in path):
        raise FilterError(f"no path: {path!r}")
    return Has(path)


def fits(type_name: str) -> Fits:
    return Fits(type_name)


def num(value: float, unit: str | None = None) -> dict:
    return {"kind": "number", "num": float(value), "unit": unit}


def ref_to(ident: str) -> dict:
    return {"kind": "ref", "str": ident}


def symbol(name: str) -> dict:
    return {"kind": "symbol", "str": name}


def uri(text: str) -> dict:
    return {"kind": "uri", "str": text}


def coord(lat: float, lng: float) -> dict:
    return {"kind": "coord", "lat": float(lat), "lng": float(lng)}


def xstr(type_name: str, text: str) -> dict:
    return {"kind": "xstr", "json": type_name, "str": text}


def list_of(*values: object) -> dict:
    """A list of numbers, strings, booleans, references, symbols and further lists and dicts."""
    return {"kind": "list", "json": f"[{','.join(map(_nested, values))}]"}


def dict_of(*markers: str, **values: object) -> dict:
    """A dict of marker names and of names with values."""
    parts = {m: '{"_kind":"marker"}' for m in markers} | {k: _nested(v) for k, v in values.items()}
    return {"kind": "dict", "json": "{" + ",".join(f"{json.dumps(k)}:{parts[k]}" for k in sorted(parts)) + "}"}


def _nested(value: object) -> str:
    """Canonical text of a value inside another."""
    f = literal(value)
    match f["kind"]:
        case "list" | "dict":
            return f["json"]
        case "bool":
            return "true" if f["b"] else "false"
        case "str":
            return json.dumps(f["str"], ensure_ascii=False)
        case "number" if math.isfinite(f["num"]):
            digits = format(decimal.Decimal(repr(f["num"])), "f")
            digits = digits.rstrip("0").rstrip(".") if "." in digits else digits
            return digits if f["unit"] is None else f'{{"_kind":"number","unit":{json.dumps(f["unit"], ensure_ascii=False)},"val":{digits}}}'
        case "ref" | "symbol" | "uri":
            return f'{{"_kind":"{f["kind"]}","val":{json.dumps(f["str"], ensure_ascii=False)}}}'
    raise FilterError(f"no literal inside another: {value!r}")


def at(stamp: dt.datetime, tz: str = "UTC", ns: int = 0) -> dict:
    """An instant with the name of its zone and the nanoseconds beyond its microseconds."""
    if stamp.tzinfo is None:
        raise FilterError("an instant has a zone")
    return {"kind": "dateTime", "ts": stamp.astimezone(dt.UTC), "ts_ns": ns, "off_s": int(stamp.utcoffset().total_seconds()), "tz": tz}


def literal(value: object) -> dict:
    """The fields of a tag value, from Python's own or one of the helpers above."""
    match value:
        case dict():
            return value
        case bool():
            return {"kind": "bool", "b": value}
        case int() | float():
            return num(value)
        case str():
            return {"kind": "str", "str": value}
        case dt.datetime():
            return at(value)
        case dt.date():
            return {"kind": "date", "d": value}
        case dt.time():
            return {"kind": "time", "t_ns": ((value.hour * 60 + value.minute) * 60 + value.second) * 10**9 + value.microsecond * 1000}
    raise FilterError(f"no literal: {value!r}")


def paths(node: Node) -> list[tuple[str, ...]]:
    if isinstance(node, (And, Or)):
        return paths(node.left) + paths(node.right)
    return [] if isinstance(node, Fits) else [node.path]
