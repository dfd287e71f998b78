"""Specs with slots, and checks of entities against them in columns.

A spec has one base; a slot is ``name, type, maybe, marker`` and bounds. Slots of the base come first, own slots of the same name replace them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagframe.functions import kinds
from tagframe.operators.walks import reachable

KIND_OF = {v: k for k, v in kinds.TYPE_NAMES.items()}


@dataclass
class Slot:
    name: str
    type: str = "Marker"
    maybe: bool = False
    min_val: float | None = None
    max_val: float | None = None
    unit: str | None = None
    unitless: bool = False
    min_size: int | None = None
    max_size: int | None = None
    non_empty: bool = False
    pattern: str | None = None
    via: str | None = None  # a reference tag to walk, ``tag+`` for any number of steps


@dataclass
class Spec:
    name: str
    base: str | None = None
    slots: list[Slot] = field(default_factory=list)


def effective_slots(specs: dict[str, Spec], name: str) -> list[Slot]:
    chain, seen = [], set()
    while name in specs and name not in seen:
        seen.add(name)
        chain.append(specs[name])
        name = specs[name].base or ""
    out: dict[str, Slot] = {}
    for spec in reversed(chain):
        out |= {s.name: s for s in spec.slots}
    return list(out.values())


def _violations(tags: Column, s: Slot) -> list[tuple[str, Column]]:
    v, there = tags[s.name], F.map_contains_key(tags, s.name)
    if s.type == "Marker":
        return [] if s.maybe else [("missing_marker", ~there)]
    out = []
    bare = s.type.rpartition("::")[2]
    if bare in KIND_OF:
        out.append(("wrong_type", there & (v.kind != KIND_OF[bare])))
    number, text = there & (v.kind == "number"), there & (v.kind == "str")
    size = F.octet_length(v.str)
    for bound, test in (
        (s.min_val, lambda b: number & (v.num < b)), (s.max_val, lambda b: number & (v.num > b)), (s.unit, lambda b: number & ~v.unit.eqNullSafe(F.lit(b))),
        (s.min_size, lambda b: text & (size < b)), (s.max_size, lambda b: text & (size > b)),
    ):
        if bound is not None:
            out.append(("constraint", test(bound)))
    if s.unitless:
        out.append(("constraint", number & v.unit.isNotNull()))
    if s.non_empty:
        out.append(("constraint", text & (F.trim(v.str) == "")))
    if s.pattern is not None:
        try:
            re.compile(s.pattern)
            out.append(("constraint", text & ~v.str.rlike(s.pattern)))
        except re.error:
            out.append(("constraint", there))  # a pattern that is none can't be met
    return out


def check(entities: DataFrame, specs: dict[str, Spec], name: str) -> DataFrame:
    """Violations ``id, issue, slot`` of every entity against one spec; query slots by walking references."""
    slots = effective_slots(specs, name)
    tags = F.col("tags")
    local = [F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(kind).alias("issue"), F.lit(s.name).alias("slot"))) for s in slots if not s.via for kind, c in _violations(tags, s)]
    found = entities.select("id", F.explode(F.array_compact(F.array(*local)))).select("id", "col.issue", "col.slot") if local else entities.select("id", F.lit("").alias("issue"), F.lit("").alias("slot")).where("false")
    for s in slots:
        if s.via and not s.maybe:
            found = found.unionByName(entities.select("id").join(reached(entities, s.via.rstrip("+")).select("id"), "id", "left_anti").select("id", F.lit("constraint").alias("issue"), F.lit(s.name).alias("slot")))
    return found.distinct()


def reached(entities: DataFrame, via: str) -> DataFrame:
    """``id, target`` of entities that a reference leads to, one step or, for ``tag+``, any number; cycles end."""
    tag = via.rstrip("+")
    step = entities.select("id", F.when(F.col("tags")[tag].kind == "ref", F.col("tags")[tag].str).alias("target")).where("target is not null").join(entities.select(F.col("id").alias("target")), "target", "left_semi").select("id", "target")
    if not via.endswith("+"):
        return step
    return reachable(step.select(F.col("id").alias("src"), F.col("target").alias("dst"))).select(F.col("src").alias("id"), F.col("dst").alias("target"))
