"""Repair of conversation structure: the cheapest edits after which roles run ``(system? (user assistant)+)?``.

Rows of a conversation stand in the order of their turns (nulls first; then role, then the digest of the text). A row is
blank, a duplicate (role and text seen earlier), truncated (its last character that is no blank ends no sentence) or sound.
Blank rows and duplicates go. Every other row is kept, gets the other role, or goes; empty turns of either role may come
anywhere. Costs are ``DELETE``, ``INSERT``, ``REROLE`` and ``CUT`` for a truncated row that stays. Of equally cheap edits
those whose initials (D, I, K, R) are least in ASCII win; that also fixes the edits themselves, since D, K, and the state decide.

The tensor DP: conversations are bucketed by length (powers of two) and stand time-major in numpy arrays,
``costs[turn, conversation, state]``; one step updates all conversations of a bucket from the last turn to the first,
the costs are kept, and edits are traced forward the same way, a turn of all conversations at a time. States: nothing
yet, after a system turn, after a user's, after an assistant's.

Conversations of at most ``longest`` rows and ``largest`` bytes of text are shuffled whole to one task, which reads them sorted, some megabytes at
once. Longer ones are never gathered: their rows are sorted over ranges, a task turns its range into one 4 x 4 matrix of
costs, matrices are chained backwards for the costs at the ends of ranges, end states are chained forwards, and each range is
then traced by itself. Equal rows of one turn count as one row with a number, so a repeated row can't fill a range. Only the digest of a
long conversation's repaired text is made in one task, as SHA-256 asks for, and that reads its rows as a stream.

Defined cases: a null role, text, conversation or turn counts as one space in what is hashed or compared; a null turn comes
first and doesn't count for gaps; a role without a first letter can't be kept. A conversation without rows left has zeros,
an empty audit and the digest of an empty string. Null ids form one conversation. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .space import small_batches, written

DELETE, INSERT, REROLE, CUT = 3, 2, 2, 1
#: Faults; blank rows and duplicates must go.
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
_BLANKS = " \t\n\x0b\x0c\r"
_FAR = 1 << 40
_NONE = 4  # the state that nothing leads to
# the state after a row whose role begins with s, u, a or another letter is kept, and after an inserted or given role
_KEPT = np.array([[1, 2, 4, 4], [4, 2, 4, 4], [4, 4, 3, 4], [4, 2, 4, 4]])
_NEXT = np.array([2, 2, 3, 2])
_END = np.array([0, _FAR, _FAR, 0], np.int64)
_ROLE = np.array(["user", "user", "assistant", "user"])  # what comes after a state
_DEL, _INS, _KEEP, _RE = (ord(c) for c in "DIKR")

RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(" "))


def _kind(conv: Column, turn: Column) -> Column:
    return F.crc32(F.concat(_text(conv), F.lit(":"), _text(turn)).cast("binary")) % 20


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, turn, role, text``, damaged by a hash of conversation and turn: dropped, emptied, without ends of sentences, repeated, given to the user."""
    conv, turn = F.col(conv_col).cast("long"), F.col(turn_col).cast("long")
    role, text = _text(F.col(role_col)), _text(F.col(text_col))
    plain = rows.select(conv.alias("conv_id"), turn.alias("turn"), role.alias("role"), text.alias("text"), _kind(conv, turn).alias("kind")).where("kind != 0")
    new_text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    new_role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return plain.select("conv_id", "turn", new_role.alias("role"), new_text.alias("text"), copies.alias("copy")).drop("copy")


def _described(rows: DataFrame) -> DataFrame:
    """Adds the digest that orders and compares texts, the fault that a row has by itself, and the class of its role."""
    trimmed = F.rtrim(F.col("text"), F.lit(_BLANKS))
    fault = F.when(F.length(trimmed) == 0, BLANK).when(F.right(trimmed, F.lit(1)).isin(".", "!", "?"), SOUND).otherwise(TRUNCATED)
    first = F.left("role", F.lit(1))
    klass = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    return rows.select("conv_id", "turn", "role", "text", F.md5(F.col("text").cast("binary")).alias("digest"), fault.cast("int").alias("fault"), klass.cast("int").alias("klass"))


# ---- the tensor DP: all arrays are [turn, conversation(, state)], padded at the end by class -1


def _actions(after: np.ndarray, klass: np.ndarray, fault: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Costs of deleting, keeping and re-roling one turn's rows in every state, given the costs after it."""
    n = len(klass)
    wide = np.concatenate([after, np.full((n, 1), _FAR)], axis=1)
    cut = (fault == TRUNCATED).astype(np.int64)[:, None]
    forced = ((fault == BLANK) | (fault == DUPLICATE))[:, None]
    keep = np.where(forced, _FAR, cut + wide[np.arange(n)[:, None], _KEPT.T[np.maximum(klass, 0)]])
    again = np.where(forced, _FAR, cut + REROLE + after[:, _NEXT])
    return DELETE + after, np.minimum(keep, _FAR), np.minimum(again, _FAR)


def _with_inserts(costs: np.ndarray) -> np.ndarray:
    once = np.minimum(costs, INSERT + costs[:, _NEXT])
    return np.minimum(once, INSERT + once[:, _NEXT])


def closed(end: np.ndarray) -> np.ndarray:
    """Costs before the end, where turns may still be inserted."""
    return _with_inserts(np.broadcast_to(end, (len(end), 4)))


def costs(klass: np.ndarray, fault: np.ndarray, end: np.ndarray) -> np.ndarray:
    """``[turns + 1, conversations, 4]``: the least cost from before each turn to the end, whose costs are ``end``."""
    out = np.empty((len(klass) + 1, klass.shape[1], 4), np.int64)
    out[-1] = end
    for t in range(len(klass) - 1, -1, -1):
        best = _with_inserts(np.minimum.reduce(_actions(out[t + 1], klass[t], fault[t])))
        out[t] = np.where(klass[t][:, None] < 0, out[t + 1], np.minimum(best, _FAR))
    return out


def trace(klass: np.ndarray, fault: np.ndarray, cost: np.ndarray, state: np.ndarray, last: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edits ``[turns + last, 3, conversations]`` (0: none), the state before each of them, and the state in the end.

    At every place the least letter that is on a cheapest way is taken; at most two turns are inserted before a row.
    """
    turns, n = klass.shape
    edits = np.zeros((turns + last, 3, n), np.uint8)
    states = np.zeros((turns + last, 3, n), np.int8)
    at, state = np.arange(n), state.copy()
    for t in range(turns):
        delete, keep, again = _actions(cost[t + 1], klass[t], fault[t])
        live = klass[t] >= 0
        for i in range(3):
            now = cost[t][at, state]
            to = _NEXT[state]
            choice = np.select([delete[at, state] == now, INSERT + cost[t][at, to] == now, keep[at, state] == now], [_DEL, _INS, _KEEP], _RE)
            edits[t, i], states[t, i] = np.where(live, choice, 0), state
            kept = _KEPT[state, np.maximum(klass[t], 0)]
            state = np.where(~live | (choice == _DEL), state, np.where(choice == _KEEP, kept % _NONE, to))
            live &= choice == _INS
    for i in range(2 if last else 0):
        insert = cost[turns][at, state] > 0
        edits[turns, i], states[turns, i] = np.where(insert, _INS, 0), state
        state = np.where(insert, _NEXT[state], state)
    return edits, states, state


def matrices(klass: np.ndarray, fault: np.ndarray) -> np.ndarray:
    """``[conversations, 4, 4]``: the least cost from a state before the first turn to one after the last, for stretches of a conversation."""
    turns, n = klass.shape
    four = np.repeat(np.arange(n), 4)
    unit = np.where(np.eye(4, dtype=bool), 0, _FAR).astype(np.int64)
    found = costs(klass[:, four], fault[:, four], np.tile(unit, (n, 1)))[0]
    return found.reshape(n, 4, 4).transpose(0, 2, 1)


def _chained(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The matrix product in which costs add and the least counts."""
    return np.minimum((a[..., :, :, None] + b[..., None, :, :]).min(axis=-2), _FAR)


# ---- conversations that fit


def _time_major(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, turns: int, empty: int) -> np.ndarray:
    t = np.arange(turns)[:, None]
    inside = t < sizes[None, :]
    at = np.where(inside, starts[None, :] + t, 0)
    return np.where(inside, values[at], empty)


def _sums(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values.astype(np.int64))])
    return total[starts + sizes] - total[starts]


def repair_batch(conv: np.ndarray, turn: np.ndarray, known: np.ndarray, klass: np.ndarray, fault: np.ndarray, same: np.ndarray, roles: list[str], texts: list[str]) -> dict[str, list]:
    """Whole conversations, sorted: ``same`` numbers equal roles and texts; ``known`` says which turns aren't null."""
    starts = np.flatnonzero(np.diff(conv, prepend=conv[0] - 1))
    sizes = np.diff(np.append(starts, len(conv)))
    owner = np.repeat(np.arange(len(starts)), sizes)
    fault = fault.copy()
    first = np.unique(owner * (int(same.max()) + 1) + same, return_index=True)[1]
    again = np.ones(len(conv), bool)
    again[first] = False
    fault[again & (fault != BLANK)] = DUPLICATE
    out: dict[str, list] = {"start": starts.tolist()}
    for name, code in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", TRUNCATED)):
        out[name] = _sums(fault == code, starts, sizes).tolist()
    inner = owner[1:] == owner[:-1]
    good = _legal(klass[:-1], klass[1:])
    out["illegal"] = np.bincount(owner[1:][inner & ~good], minlength=len(starts)).tolist()
    # sorted by turn with nulls first: a turn is new where it differs from the row before or follows a null
    new = known & np.concatenate([[True], ~inner | (turn[1:] != turn[:-1]) | ~known[:-1]])
    nulls = _sums(~known, starts, sizes)
    last = starts + sizes - 1
    low = np.minimum(starts + nulls, last)
    out["gaps"] = np.where(nulls == sizes, 0, turn[last] - turn[low] + 1 - _sums(new, starts, sizes)).tolist()
    cost, audit, digest = np.zeros(len(starts), np.int64), [""] * len(starts), [""] * len(starts)
    bucket = np.ceil(np.log2(sizes)).astype(int)
    for b in np.unique(bucket):
        which = np.flatnonzero(bucket == b)
        turns = int(sizes[which].max())
        k, f = (_time_major(x, starts[which], sizes[which], turns, e) for x, e in ((klass, -1), (fault, SOUND)))
        found = costs(k, f, closed(np.broadcast_to(_END, (len(which), 4))))
        edits, states, _ = trace(k, f, found, np.zeros(len(which), np.int64))
        cost[which] = found[0, :, 0]
        for j, (c, flat, st) in enumerate(zip(which, edits.transpose(2, 0, 1).reshape(len(which), -1), states.transpose(2, 0, 1).reshape(len(which), -1), strict=True)):
            some = np.flatnonzero(flat)
            letters = flat[some].tobytes().decode("ascii")
            audit[c] = letters
            lines = [line(e, s, roles[starts[c] + p // 3] if p // 3 < sizes[c] else "", texts[starts[c] + p // 3] if p // 3 < sizes[c] else "") for e, s, p in zip(letters, st[some].tolist(), some.tolist(), strict=True) if e != "D"]
            digest[c] = hashlib.sha256("\n".join(lines).encode("utf-8", "surrogatepass")).hexdigest()
    return out | {"cost": cost.tolist(), "audit": audit, "repaired_sha256": digest}


def _legal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a == 0) | (a == 2)) & (b == 1) | (a == 1) & (b == 2)


def line(edit: str, state: int, role: str, text: str) -> str:
    if edit == "I":
        return f"{_ROLE[state]}:"
    return f"{_ROLE[state] if edit == 'R' else role}:{text}"


_EMPTY = {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}


def _small(batches, most: int = 8 << 20, rows: int = 50_000):
    """Sorted rows of whole conversations in, a row each out. ``here`` is false where a conversation only has its name."""
    names = [x.split()[0] for x in RESULT.split(", ")]

    def done(held: pa.Table) -> pa.RecordBatch:
        id_, here = held.column("conv_id").combine_chunks(), held.column("here").combine_chunks()
        out = {n: [] for n in names}
        # a name alone, and one beside rows, come first of their conversation
        full = held.filter(here)
        if full.num_rows:
            get = lambda c, none=0: pc.fill_null(full.column(c).combine_chunks(), none).to_numpy(zero_copy_only=False)
            nulls = full.column("conv_id").combine_chunks().is_null().to_numpy(zero_copy_only=False)
            number = np.cumsum((np.diff(get("conv_id"), prepend=0) != 0) | (np.diff(nulls, prepend=False)))
            both = [pc.dictionary_encode(full.column(c).combine_chunks()) for c in ("role", "text")]
            role, text = (x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in both)
            found = repair_batch(number, get("turn"), full.column("turn").combine_chunks().is_valid().to_numpy(zero_copy_only=False), get("klass", 3), get("fault"), role * (len(both[1].dictionary) + 1) + text, full.column("role").to_pylist(), full.column("text").to_pylist())
            ids = full.column("conv_id").take(pa.array(found.pop("start"))).to_pylist()
            out = {"conv_id": ids} | found
        present = set(out["conv_id"])
        for i in pc.unique(id_.filter(pc.invert(here))).to_pylist():
            if i not in present:
                for n in names:
                    out[n].append(i if n == "conv_id" else _EMPTY[n])
        return pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in zip(names, [pa.int64()] * 7 + [pa.string()] * 2, strict=True)], names)

    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= most or sum(x.num_rows for x in held) >= rows:
            table = pa.Table.from_batches(held)
            ids = table.column("conv_id").combine_chunks()
            differs = pc.fill_null(pc.not_equal(ids[:-1], ids[1:]), False).to_numpy(zero_copy_only=False) | (np.diff(ids.is_null().to_numpy(zero_copy_only=False).astype(np.int8)) != 0)
            cuts = np.flatnonzero(differs)
            if len(cuts):  # the last conversation may go on
                yield done(table.slice(0, int(cuts[-1]) + 1))
                held = table.slice(int(cuts[-1]) + 1).combine_chunks().to_batches()
                size = sum(x.nbytes for x in held)
    if held and sum(x.num_rows for x in held):
        yield done(pa.Table.from_batches(held))


def repair(rows: DataFrame, longest: int = 1024, largest: int = 8 << 20, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row per conversation of ``rows`` (``RESULT``), of the conversations as ``damaged`` leaves them."""
    small_batches(rows.sparkSession)
    conv, turn = F.col(conv_col).cast("long"), F.col(turn_col).cast("long")
    live = _described(damaged(rows, conv_col, turn_col, role_col, text_col)).withColumn("here", F.lit(True))
    # conversations of which a row was dropped may have no other; each is named once
    names = rows.where(_kind(conv, turn) == 0).select(conv.alias("conv_id")).distinct().withColumn("here", F.lit(False))
    every = names.unionByName(live, allowMissingColumns=True)
    sizes = live.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    long = written(sizes.where((F.col("n") > longest) | (F.col("bytes") > largest)).select("conv_id"), "long")
    some = not long.isEmpty()
    if some:
        every = every.join(long.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")), "left_anti")
    dealt = every.repartition("conv_id").sortWithinPartitions("conv_id", "here", "turn", "role", "digest")
    found = dealt.mapInArrow(_small, RESULT)
    return found.unionByName(_repair_long(live.join(long.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")), "left_semi"))) if some else found


# ---- conversations that don't fit

_STRETCH = 256


def _stretches(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a range as columns of ``_STRETCH`` turns, which the DP treats as conversations."""
    starts = np.arange(0, len(group), _STRETCH)
    sizes = np.minimum(_STRETCH, len(group) - starts)
    turns = int(sizes.max())
    return _time_major(group["klass"].to_numpy(np.int64), starts, sizes, turns, -1), _time_major(group["fault"].to_numpy(np.int64), starts, sizes, turns, SOUND)


def _backward(parts: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Costs behind each part, and in the last row before the first one, given those behind the last."""
    out = np.empty((len(parts) + 1, 4), np.int64)
    out[-1] = end
    for i in range(len(parts) - 1, -1, -1):
        out[i] = np.minimum((parts[i] + out[i + 1][None, :]).min(axis=1), _FAR)
    return np.roll(out, -1, axis=0)


def _ends(klass: np.ndarray, fault: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each stretch the costs behind it, and the state in which it ends from each of the four states."""
    behind = _backward(matrices(klass, fault), end)[:-1]
    four = np.repeat(np.arange(klass.shape[1]), 4)
    cost = costs(klass[:, four], fault[:, four], behind[four])
    _, _, ends = trace(klass[:, four], fault[:, four], cost, np.tile(np.arange(4), klass.shape[1]), last=False)
    return behind, ends.reshape(-1, 4)


def _matrix_of_range(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("at")
    parts = matrices(*_stretches(group))
    whole = parts[0]
    for m in parts[1:]:
        whole = _chained(whole, m)
    k = group["klass"].to_numpy()
    illegal = int((~_legal(k[:-1], k[1:])).sum() + (group["n"] - 1).sum())
    return pd.DataFrame({"key": [group["key"].iloc[0]], "part": [group["part"].iloc[0]], "m": [whole.ravel().tolist()], "illegal": [illegal], "first": [int(k[0])], "last": [int(k[-1])]})


def _costs_behind_ranges(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("part").reset_index(drop=True)
    behind = _backward(np.array(group["m"].tolist(), np.int64).reshape(-1, 4, 4), closed(_END[None, :])[0])
    first, last = group["first"].to_numpy(), group["last"].to_numpy()
    seams = np.concatenate([[0], ~_legal(last[:-1], first[1:])]).astype(int)
    final = np.arange(len(group)) == len(group) - 1
    return pd.DataFrame({"key": group["key"], "part": group["part"], "behind": behind[:-1].tolist(), "final": final, "cost": np.where(final, behind[-1][0], 0), "illegal": group["illegal"] + seams})


def _ends_of_range(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("at")
    _, ends = _ends(*_stretches(group), np.array(group["behind"].iloc[0], np.int64))
    state = np.arange(4)
    for e in ends:
        state = e[state]
    return pd.DataFrame({"key": [group["key"].iloc[0]], "part": [group["part"].iloc[0]], "ends": [state.tolist()]})


def _starts_of_ranges(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("part")
    state, starts = 0, []
    for ends in group["ends"]:
        starts.append(state)
        state = ends[state]
    return pd.DataFrame({"key": group["key"], "part": group["part"], "start": starts})


def _edited_range(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("at").reset_index(drop=True)
    klass, fault = _stretches(group)
    behind, ends = _ends(klass, fault, np.array(group["behind"].iloc[0], np.int64))
    state, starts = int(group["start"].iloc[0]), []
    for e in ends:
        starts.append(state)
        state = int(e[state])
    edits, states, _ = trace(klass, fault, costs(klass, fault, behind), np.array(starts), last=False)
    n = len(group)
    # row r stands in stretch r // _STRETCH at turn r % _STRETCH
    edits, states = (x.transpose(2, 0, 1).reshape(-1, 3)[: n if klass.shape[1] == 1 else None] for x in (edits, states))
    audit, lines = [], []
    for r, (role, text, copies) in enumerate(zip(group["role"], group["text"], group["n"], strict=True)):
        some = np.flatnonzero(edits[r])
        letters = edits[r][some].tobytes().decode("ascii")
        new = [line(e, int(s), role, text) for e, s in zip(letters, states[r][some], strict=True) if e != "D"]
        letters += "D" * (int(copies) - 1)
        if r == n - 1 and group["final"].iloc[0]:
            while _END[state]:
                letters, new, state = letters + "I", [*new, line("I", state, "", "")], int(_NEXT[state])
        audit.append(letters)
        lines.append("\n".join(new) if new else None)
    return pd.DataFrame({"key": group["key"], "part": group["part"], "at": group["at"], "audit": audit, "lines": lines})


def _digests(batches):
    """Sorted pieces of conversations in, as a stream; of each conversation its audit and the digest of its text out."""
    now, audit, digest, begun = None, [], None, False

    def done():
        return pa.RecordBatch.from_pydict({"key": [now], "audit": ["".join(audit)], "repaired_sha256": [digest.hexdigest()]})

    for b in batches:
        for key, letters, lines in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if key != now:
                if now is not None:
                    yield done()
                now, audit, digest, begun = key, [], hashlib.sha256(), False
            audit.append(letters)
            if lines is not None:
                digest.update((b"\n" if begun else b"") + lines.encode("utf-8", "surrogatepass"))
                begun = True
    if now is not None:
        yield done()


def _repair_long(live: DataFrame) -> DataFrame:
    keyed = live.withColumn("key", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    rows = written(keyed.groupBy("key", "turn", "role", "digest").agg(F.max("text").alias("text"), F.max("fault").alias("fault"), F.max("klass").alias("klass"), F.count(F.lit(1)).alias("n")), "turns")
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"))
    seen = written(rows.groupBy("key", "role", "digest").agg(F.min(place).alias("first")), "seen")
    fault = F.when((F.col("fault") != BLANK) & ~place.eqNullSafe(F.col("first")), DUPLICATE).otherwise(F.col("fault"))
    order = ["key", "turn", "role", "digest"]
    ranged = rows.join(seen, ["key", "role", "digest"]).withColumn("fault", fault).drop("first").repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(ranged.select("key", "turn", "role", "text", "fault", "klass", "n", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "placed")
    bare = placed.select("key", "part", "at", "fault", "klass", "n")
    ranges = bare.groupBy("key", "part").applyInPandas(_matrix_of_range, "key string, part int, m array<long>, illegal long, first int, last int")
    behind = written(ranges.groupBy("key").applyInPandas(_costs_behind_ranges, "key string, part int, behind array<long>, final boolean, cost long, illegal long"), "behind")
    ends = bare.join(behind.select("key", "part", "behind"), ["key", "part"]).groupBy("key", "part").applyInPandas(_ends_of_range, "key string, part int, ends array<int>")
    starts = written(ends.groupBy("key").applyInPandas(_starts_of_ranges, "key string, part int, start int"), "starts")
    known = behind.join(starts, ["key", "part"]).select("key", "part", "behind", "final", "start")
    edited = placed.join(known, ["key", "part"]).groupBy("key", "part").applyInPandas(_edited_range, "key string, part int, at long, audit string, lines string")
    digests = edited.repartition("key").sortWithinPartitions("key", "part", "at").select("key", "audit", "lines").mapInArrow(_digests, "key string, audit string, repaired_sha256 string")
    sound = ~F.col("fault").isin(BLANK, DUPLICATE)
    counts = placed.groupBy("key").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"), F.sum(F.when(F.col("fault") == BLANK, F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("fault") == DUPLICATE, F.col("n")).when(sound, F.col("n") - 1).otherwise(0)).alias("duplicate"), F.sum((F.col("fault") == TRUNCATED).cast("long")).alias("truncated"), (DELETE * F.sum(F.col("n") - 1)).alias("more"),
    )
    sums = behind.groupBy("key").agg(F.sum("cost").alias("least"), F.sum("illegal").alias("illegal"))
    whole = counts.join(sums, "key").join(digests, "key").withColumn("cost", F.col("least") + F.col("more"))
    return whole.withColumn("conv_id", F.when(F.col("key") != "", F.col("key").cast("long"))).select(*(x.split()[0] for x in RESULT.split(", ")))
