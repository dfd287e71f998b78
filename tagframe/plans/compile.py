"""Conditions on tags as DataFrame filters: bare column expressions, and one left join for each distinct path prefix.

Two bindings give tags to the compiler. ``Wide`` reads ordinary typed columns, so predicates reach the Parquet
scan; ``where_dynamic`` reads a map of values. Null and false are the same to a filter, and conditions have no general
negation, so predicates stay unwrapped.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagframe.functions import kinds
from tagframe.functions.filters import And, Compare, Fits, Has, Missing, Node, Or, paths


@dataclass
class Tag:
    """A column that is a tag: its kind, the unit of numbers, and for refs where they lead."""

    column: str
    kind: str = "str"
    unit: str | None = None
    target: Wide | None = None
    target_key: str | None = None  # the target's column that ``column`` equals


@dataclass
class Wide:
    """Entities in ordinary columns. ``markers`` hold for every row."""

    df: DataFrame
    tags: dict[str, Tag] = field(default_factory=dict)
    markers: tuple[str, ...] = ()
    id_column: Column | None = None


_FIELD = {"number": "num", "str": "str", "uri": "str", "symbol": "str", "ref": "str", "bool": "b", "date": "d", "time": "t_ns", "dateTime": "ts"}


def _wide_leaf(node, columns, tag: Tag | None, is_marker: bool) -> Column:
    """Predicate of a leaf on a column; ``columns`` turns a name into the joined frame's column."""
    if isinstance(node, Missing):
        return F.lit(False) if is_marker else F.lit(True) if tag is None else columns(tag.column).isNull()
    if isinstance(node, Has):
        return F.lit(True) if is_marker else F.lit(False) if tag is None else columns(tag.column).isNotNull()
    literal, op = node.literal, node.op
    if is_marker or tag is None:
        same = is_marker and literal["kind"] == "marker"
        return F.lit(is_marker and (same if op == "==" else not same if op == "!=" else False))
    c = columns(tag.column)
    if tag.kind == "marker":
        same = literal["kind"] == "marker"
        return c.isNotNull() if (op == "==" and same) or (op == "!=" and not same) else F.lit(False)
    comparable = tag.kind == literal["kind"] and (tag.kind != "number" or tag.unit == literal["unit"])
    if op in ("==", "!="):
        if not comparable:
            return c.isNotNull() if op == "!=" else F.lit(False)
        v = F.lit(literal[_FIELD[tag.kind]])
        if tag.kind == "dateTime" and literal.get("tz") != "UTC":
            return c.isNotNull() if op == "!=" else F.lit(False)
        zero = tag.kind == "number" and literal["num"] == 0
        same = (c == v) & (c.cast("string") == v.cast("string")) if zero else c == v
        return same if op == "==" else ~same if zero else c != v
    if not comparable or tag.kind not in kinds.ORDERED:
        return F.lit(False)
    v = F.lit(literal[_FIELD[tag.kind]])
    out = {"<": c < v, "<=": c <= v, ">": c > v, ">=": c >= v}[op]
    return out & ~F.isnan(c) if tag.kind == "number" and op in (">", ">=") else out


def mandatory(type_name: str, required: dict[str, tuple[str, ...]], strict: bool = False) -> tuple[str, ...]:
    """Tags that an entity of a type must have; an unknown type asks for none, or is an error if ``strict``."""
    name = type_name.rpartition("::")[2]
    found = required.get(name, required.get(name[:1].lower() + name[1:], required.get(name.lower())))
    if found is None and strict:
        raise KeyError(f"unknown type {type_name}")
    return found or ()


def where_wide(w: Wide, node: Node, required: dict[str, tuple[str, ...]] | None = None, strict: bool = False) -> DataFrame:
    """Rows of ``w.df`` that meet a condition, with its columns."""
    if isinstance(node, Missing) and len(node.path) == 2 and node.path[0] in w.tags and w.tags[node.path[0]].target:
        tag = w.tags[node.path[0]]
        there = where_wide(tag.target, Has((node.path[1],))).select(F.col(tag.target_key).alias("_there"))
        return w.df.join(there, F.col(tag.column) == F.col("_there"), "left_anti")
    joined, bound = w.df, {(): (w, "")}
    prefixes = sorted({p[:k] for p in paths(node) for k in range(1, len(p))}, key=lambda p: (len(p), p))
    for p in prefixes:
        here, prefix = bound.get(p[:-1], (None, ""))
        tag = here.tags.get(p[-1]) if here else None
        if tag is None or tag.target is None:
            continue
        mark = "_" + "_".join(p) + "_"
        used = {tag.target_key} | {t.column for t in tag.target.tags.values()}
        right = tag.target.df.select(*[F.col(c).alias(mark + c) for c in sorted(used)])
        joined = joined.join(right, F.col(prefix + tag.column) == F.col(mark + tag.target_key), "left")
        bound[p] = (tag.target, mark)

    def build(n) -> Column:
        if isinstance(n, And):
            return build(n.left) & build(n.right)
        if isinstance(n, Or):
            return build(n.left) | build(n.right)
        if isinstance(n, Fits):
            if required is None:
                return F.lit(False)
            out = F.lit(True)
            for t in mandatory(n.type_name, required, strict):
                out = out & build(Has((t,)))
            return out
        here, prefix = bound.get(n.path[:-1], (None, ""))
        if here is None:
            return F.lit(isinstance(n, Missing))
        name = n.path[-1]
        tag = here.tags.get(name)
        marker = tag is None and name in here.markers
        if marker and prefix:  # a marker of the target holds if the target is there
            key = F.col(prefix + bound_key(n.path[:-1]))
            held = _wide_leaf(n, lambda c: F.col(prefix + c), None, True)
            return key.isNull() if isinstance(n, Missing) else key.isNotNull() & held
        return _wide_leaf(n, lambda c: F.col(prefix + c), tag, marker)

    def bound_key(p: tuple[str, ...]) -> str:
        return bound[p[:-1]][0].tags[p[-1]].target_key

    return joined.where(build(node)).select(*w.df.columns)


def _dynamic_leaf(node, v: Column, there: Column) -> Column:
    if isinstance(node, Missing):
        return F.coalesce(~there, F.lit(True))
    if isinstance(node, Has):
        return there
    other = kinds.literal(node.literal)
    if node.op in ("==", "!="):
        same = kinds.equal(v, other)
        return same if node.op == "==" else there & ~F.coalesce(same, F.lit(False))
    return {"<": lambda: kinds.less(v, other), "<=": lambda: kinds.less(v, other, True), ">": lambda: kinds.less(other, v), ">=": lambda: kinds.less(other, v, True)}[node.op]()


@dataclass
class Branch:
    """Entities of one table: their id, and of each tag that they may have its value (null: absent)."""

    df: DataFrame
    id: Column
    tags: dict[str, Column]

    def select(self, *names: str) -> DataFrame:
        """``id`` and a column a tag, null where it is absent."""
        none = F.lit(None).cast(kinds.KIND)
        return self.df.select(self.id.alias("id"), *[(F.when(self.tags[n].kind.isNotNull(), self.tags[n]) if n in self.tags else none).alias(n) for n in names])


@dataclass
class Branches:
    """Entities of several tables, before any map is built: conditions leave out the tables that can't meet them, and only what meets them gets its map."""

    all: list[Branch]

    def select(self, *names: str) -> DataFrame:
        """``id`` and a column a tag, of the tables that have any of them."""
        some = [b for b in self.all if not names or set(names) & set(b.tags)] or self.all[:1]
        return reduce(DataFrame.unionByName, [b.select(*names) for b in some])

    def frame(self) -> DataFrame:
        """``id, tags``."""
        return reduce(DataFrame.unionByName, [b.df.select(b.id.alias("id"), kinds.tags(**b.tags).alias("tags")) for b in self.all])


def may_meet(node: Node, tags: set[str]) -> bool:
    """Whether an entity with these tags at most can meet a condition."""
    match node:
        case And():
            return may_meet(node.left, tags) and may_meet(node.right, tags)
        case Or():
            return may_meet(node.left, tags) or may_meet(node.right, tags)
        case Has() | Compare():
            return node.path[0] in tags
    return True


def values(entities: DataFrame | Branches, *names: str) -> DataFrame:
    """``id`` and the values of some tags, null where absent; of branches without them no rows need come (``Branches.select``), so only joins by id may rest on it."""
    if isinstance(entities, Branches):
        return entities.select(*names)
    return entities.select("id", *[F.when(F.map_contains_key("tags", F.lit(n)), F.col("tags")[n]).alias(n) for n in names])


def _where_branches(entities: Branches, node: Node, required: dict[str, tuple[str, ...]] | None, strict: bool) -> DataFrame:
    everything, out = paths(node), []
    prefixes = sorted({p[:k] for p in everything for k in range(1, len(p))}, key=lambda p: (len(p), p))
    for b in entities.all:
        if not may_meet(node, set(b.tags)):
            continue
        rows = b.df.select(b.id.alias("id"), *[v.alias("_v_" + t) for t, v in b.tags.items()])
        have = {()}
        none = F.lit(None).cast(kinds.KIND)

        def at(p: tuple[str, ...], own: dict[str, Column] = b.tags) -> Column:
            return F.col("_".join(("_v", *p))) if len(p) > 1 or p[0] in own else none  # noqa: B023

        for p in prefixes:
            if p[:-1] not in have or len(p) == 1 and p[0] not in b.tags:
                continue
            mark, step = "_".join(("_v", *p)), at(p)
            names = sorted({q[len(p)] for q in everything if len(q) > len(p) and q[: len(p)] == p})
            right = entities.select(*names).select(F.col("id").alias(mark + "_id"), *[F.col(n).alias(f"{mark}_{n}") for n in names])
            rows = rows.join(right, F.when(step.kind == "ref", step.str) == F.col(mark + "_id"), "left")
            have.add(p)

        def build(n: Node) -> Column:
            if isinstance(n, And):
                return build(n.left) & build(n.right)
            if isinstance(n, Or):
                return build(n.left) | build(n.right)
            if isinstance(n, Fits):
                test = F.lit(required is not None)
                for t in mandatory(n.type_name, required or {}, strict):
                    test = test & at((t,)).kind.isNotNull()  # noqa: B023
                return test
            if n.path[:-1] not in have:  # noqa: B023
                return F.lit(isinstance(n, Missing))
            v = at(n.path)  # noqa: B023
            return _dynamic_leaf(n, v, v.kind.isNotNull())

        out.append(rows.where(build(node)).select("id", kinds.tags(**{t: F.col("_v_" + t) for t in b.tags}).alias("tags")))
    return reduce(DataFrame.unionByName, out) if out else entities.frame().where("false")


def where_dynamic(df: DataFrame | Branches, node: Node, required: dict[str, tuple[str, ...]] | None = None, strict: bool = False, resolve: bool = True) -> DataFrame:
    """Rows of ``id, tags`` that meet a condition. Without ``resolve`` longer paths lead nowhere."""
    if isinstance(df, Branches):
        return _where_branches(df, node, required, strict)
    everything = paths(node)
    joined, have = df, {()}
    prefixes = sorted({p[:k] for p in everything for k in range(1, len(p))}, key=lambda p: (len(p), p)) if resolve else []

    def tag(p: tuple[str, ...]) -> tuple[Column, Column]:
        """The value at a path's end, and whether the tag is there."""
        if len(p) == 1:
            return F.col("tags")[p[0]], F.map_contains_key("tags", F.lit(p[0]))
        mark = "_" + "_".join(p)
        return F.col(mark), F.col(mark + "_there")

    for p in prefixes:
        mark, step = "_" + "_".join(p), tag(p)[0]
        # of what a reference leads to only the tags that the filter looks at
        names = sorted({q[len(p)] for q in everything if len(q) > len(p) and q[: len(p)] == p})
        right = df.select(F.col("id").alias(mark + "_id"), *[c for n in names for c in (F.col("tags")[n].alias(f"{mark}_{n}"), F.map_contains_key("tags", F.lit(n)).alias(f"{mark}_{n}_there"))])
        joined = joined.join(right, F.when(step.kind == "ref", step.str) == F.col(mark + "_id"), "left")
        have.add(p)

    def build(n) -> Column:
        if isinstance(n, And):
            return build(n.left) & build(n.right)
        if isinstance(n, Or):
            return build(n.left) | build(n.right)
        if isinstance(n, Fits):
            out = F.lit(required is not None)
            for t in mandatory(n.type_name, required or {}, strict):
                out = out & F.map_contains_key("tags", t)
            return out
        if n.path[:-1] not in have:
            return F.lit(isinstance(n, Missing))
        return _dynamic_leaf(n, *tag(n.path))

    return joined.where(build(node)).select(*df.columns)
