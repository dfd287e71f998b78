"""Named actions on entities: Python functions from one entity and arguments to rows, run as table functions joined to the entities they are invoked on.

An action is registered with the columns of its rows; a name registered again is replaced, an unknown one is an error. Tags reach
it as Python values: numbers as floats, strings, ids and symbols as text, markers as True, other kinds by their display text. Entities for which an action gives no
rows have none in the result. A function that raises ends the query.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagframe.functions import kinds

Action = Callable[[str, dict[str, object], dict[str, str]], Iterable[tuple]]


def plain(tags: Column) -> Column:
    """Tags as a map of structs that Python takes apart cheaply: number, text, flag."""
    return F.transform_values(tags, lambda _, v: F.struct(v.kind.alias("kind"), v.num.alias("num"), F.when(v.kind.isin("str", "ref", "symbol", "uri"), v.str).otherwise(kinds.display(v)).alias("text"), v.b.alias("b")))


def _value(v) -> object:
    return v["num"] if v["kind"] == "number" else v["b"] if v["kind"] == "bool" else True if v["kind"] == "marker" else v["text"]


@dataclass
class Actions:
    known: dict[str, tuple[Action, str]] = field(default_factory=dict)

    def register(self, name: str, action: Action, columns: str) -> None:
        self.known[name] = (action, columns)

    def names(self) -> list[str]:
        return sorted(self.known)

    def invoke(self, entities: DataFrame, name: str, args: dict[str, object] | None = None) -> DataFrame:
        """``id`` and the action's columns, for every entity of ``id, tags``."""
        if name not in self.known:
            raise KeyError(f"no action {name}; there are {', '.join(self.names()) or 'none'}")
        action, columns = self.known[name]
        given = {k: str(v) for k, v in (args or {}).items()}

        class Run:
            def eval(self, id: str, tags: dict):  # noqa: A002
                yield from action(id, {k: _value(v) for k, v in (tags or {}).items()}, given)

        function = f"action_{uuid.uuid4().hex}"
        spark = entities.sparkSession
        spark.udtf.register(function, F.udtf(Run, returnType=columns))
        rows = entities.select("id", plain(F.col("tags")).alias("tags"))
        return spark.sql(f"SELECT e.id, r.* FROM {{e}} e, LATERAL {function}(e.id, e.tags) r", e=rows)
