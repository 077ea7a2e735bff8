"""Runs that compare with their first row, over tracks of any length.

Whether a row joins a run depends on the run's first row, its *anchor*, and on the row before: that is a fold, which no
window function says. Rows are sorted by range, so a long track lies in several partitions, and every partition is
folded for itself, with its first row as an anchor of its own. That guess is right but where a track goes on from the
partition before. There, the fold is done again with the anchor carried over, up to the row where both folds begin a run
together: from there on they are the same. If they never do, the partition hands another anchor on, and the next
one is looked at again, until every partition has been folded with what the one before it hands on. An anchor that a
whole partition goes on with is offered to twice as many partitions each time, so a run over very many is found in few
rounds.

Only the track that a partition opens with can come from the one before, so nothing but its rows is folded again, and
only those that come out differently are joined with the rest.

What a partition hands on is two rows; the driver sees those, one pair for each partition. Nothing else is gathered, and
a task holds a batch of rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphflow.operators.staging import small_batches, staged

#: Whether ``now`` goes on with the run of ``anchor``, after the row ``last``: rows as dicts of the columns looked at.
GoesOn = Callable[[dict, dict, dict], bool]


def runs(rows: DataFrame, keys: list[str], order: list[str], mark: str, look: list[str], goes_on: GoesOn, name: str = "run", parts: int | None = None, seen: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` with ``name``: the value of ``mark`` at the first row of each row's run.

    A run is of one track (equal ``keys``, nulls being equal) in ``order``, whose ties go in any order. ``look`` are the
    columns that ``goes_on`` sees, beside keys and mark. ``seen`` are more of them that are made from ``rows`` where they are
    looked at, and neither dealt nor kept. ``parts`` is the number of range partitions, by default the session's. No rows
    give no rows.
    """
    import pyarrow as pa

    small_batches(rows.sparkSession)
    seen = seen or {}
    look, kept = list(dict.fromkeys([*keys, mark, *look, *seen])), rows.columns
    kind = rows.schema[mark].dataType
    added = [T.StructField(name, kind), T.StructField("_part", T.IntegerType()), T.StructField("_at", T.LongType()), T.StructField("_ends", T.BinaryType())]
    schema = T.StructType([*rows.schema.fields, *added])

    def track(r: dict) -> tuple:
        return tuple(r[k] for k in keys)

    def first(batches):
        from pyspark import TaskContext

        part, at, anchor, last, opens, own, size, held = TaskContext.get().partitionId(), 0, None, None, None, None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = []
            for now in _rows(batch, look):
                of = track(now)
                opens = of if opens is None else opens
                if of != own:
                    size = at + len(starts) if size is None and own is not None else size
                    anchor, own = now, of
                elif not goes_on(anchor, last, now):
                    anchor = now
                last = now
                starts.append(anchor[mark])
            if held is not None:
                yield _with(held, pa.nulls(held[0].num_rows, pa.binary()))
            held = batch, starts, part, at
            at += batch.num_rows
        if held is not None:
            ends = pickle.dumps((opens, anchor, last, size))
            yield _with(held, pa.array([None] * (held[0].num_rows - 1) + [ends], pa.binary()))

    def _with(held, ends):
        batch, starts, part, at = held
        n, mark_kind = batch.num_rows, batch.schema.field(mark).type
        more = [pa.array(starts, mark_kind), pa.array([part] * n, pa.int32()), pa.array(range(at, at + n), pa.int64()), ends]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *more], names=[*kept, name, "_part", "_at", "_ends"])

    by = [*keys, *order]
    dealt = rows.repartitionByRange(parts, *by) if parts else rows.repartitionByRange(*by)
    held = staged(dealt.sortWithinPartitions(*by).withColumns(seen).mapInArrow(first, schema), "folded")
    fixed = _stitched(held, keys, mark, look, goes_on, name, kind, seen)
    return (held if fixed is None else fixed).select(*rows.columns, name)


def _stitched(held: DataFrame, keys: list[str], mark: str, look: list[str], goes_on: GoesOn, name: str, kind, seen: dict[str, Column]) -> DataFrame | None:
    """The rows with the runs of tracks that go on from partition to partition put right, or None if there are none."""
    found = sorted((r._part, *pickle.loads(r._ends)) for r in held.where("_ends is not null").select("_part", "_ends").collect())  # one row for each partition
    track = lambda r: tuple(r[k] for k in keys)
    opens, anchors, lasts, sizes = ([f[k] for f in found] for k in (1, 2, 3, 4))  # size: rows of the first track, None if it fills the partition
    goes = [i > 0 and opens[i] == track(lasts[i - 1]) for i in range(len(found))]  # from the partition before
    if not any(goes):
        return None
    handed = list(anchors)  # what each hands on, as far as is known
    used: list[dict | None] = [None] * len(found)  # the anchor that each was last folded again with, by identity
    rounds, answer, reach, changed = [], {}, {}, {}
    within = {f[0]: n for f, n in zip(found, sizes)}
    while dirty := [i for i in range(len(found)) if goes[i] and (used[i] is not handed[i - 1])]:
        offers: dict[int, list[tuple[int, bytes]]] = {}
        offered = {i: handed[i - 1] for i in dirty}
        for i in dirty:
            for j in range(i, min(i + reach.get(i, 1), len(found))):
                if j > i and not (goes[j] and opens[j] == opens[j - 1]):
                    break
                offers.setdefault(found[j][0], []).append((i, pickle.dumps((offered[i], lasts[j - 1]))))
        again = staged(_again(held, offers, within, keys, mark, look, goes_on, kind, seen), "again")
        said = {(r.head, r._part): r for r in again.where("_at < 0").select("head", "_part", "_at", "how", "state").collect()}  # one row for each offer
        for i in dirty:
            if offered[i] is not handed[i - 1]:  # what was offered has been found wrong meanwhile
                continue
            for j in range(i, len(found)):
                r = said.get((i, found[j][0]))
                if r is None:
                    reach[j] = 2 * reach.get(i, 1)
                    break
                used[j], answer[j], changed[found[j][0]] = offered[i], (len(rounds), i), -1 - r._at
                handed[j] = anchors[j] if r.how == "meets" else offered[i] if r.how == "passes" else pickle.loads(r.state)
                if r.how != "passes":
                    break
        rounds.append(again)
    if not any(changed.values()):
        return None
    new = None
    for n, again in enumerate(rounds):
        right = {found[j][0]: i for j, (at, i) in answer.items() if at == n}
        if right:
            own = again.where((F.col("_at") >= 0) & (F.col("head") == _by_part(right))).select("_part", "_at", F.col("run").alias("_new"))
            new = own if new is None else new.unionAll(own)
    touched = _before(changed)
    met = held.where(touched).join(new.hint("merge"), ["_part", "_at"], "left").withColumn(name, F.when(F.col("_new").isNotNull(), F.col("_new")).otherwise(F.col(name))).drop("_new")
    return held.where(~touched).unionByName(met)


def _by_part(values: dict[int, int]) -> Column:
    """What each row's partition has in ``values``, else null."""
    return F.get(F.lit([values.get(p) for p in range(max(values) + 1)]), F.col("_part"))


def _before(bounds: dict[int, int | None]) -> Column:
    """Whether a row is among the first so many of its partition; None means all."""
    most = {part: 1 << 62 if n is None else n for part, n in bounds.items()}
    return (F.col("_at") < max(most.values())) & (F.col("_at") < F.coalesce(_by_part(most), F.lit(0)))


def _rows(batch, columns: list[str]) -> Iterator[dict]:
    """The rows of a batch as dicts. Lists are cut from their values, which come at once: Arrow makes an object of each list."""
    import pyarrow as pa

    def values(a) -> list:
        if pa.types.is_string(a.type) or a.null_count == 0 and (pa.types.is_integer(a.type) or pa.types.is_floating(a.type)):
            return a.to_numpy(zero_copy_only=False).tolist()
        if a.null_count == 0 and pa.types.is_list(a.type):
            own, cuts = values(a.values), a.offsets.to_numpy().tolist()
            return [own[i:j] for i, j in zip(cuts, cuts[1:])]
        return a.to_pylist()

    return (dict(zip(columns, r)) for r in zip(*(values(batch.column(c)) for c in columns)))


def _again(held: DataFrame, offers: dict[int, list[tuple[int, bytes]]], within: dict[int, int | None], keys: list[str], mark: str, look: list[str], goes_on: GoesOn, kind, seen: dict[str, Column]) -> DataFrame:
    """head, _part, _at, run, how, state: the first tracks of the partitions named in ``offers`` folded again from the anchors
    offered, each up to the row where that makes no difference any more. A row at -1 - n says how it ended after n rows:
    the folds meet (or the track ends ``within`` the partition, after so many rows), the anchor passes through all of the
    partition, or another one is open at its end."""
    import pyarrow as pa

    name = held.columns[-4]
    schema = T.StructType([T.StructField("head", T.IntegerType()), T.StructField("_part", T.IntegerType()), T.StructField("_at", T.LongType()), T.StructField("run", kind), T.StructField("how", T.StringType()), T.StructField("state", T.BinaryType())])
    columns = list(dict.fromkeys([*look, name, "_part", "_at"]))

    def run(batches):
        part, going, mark_kind = None, {}, None

        def out(rows):
            cols = list(zip(*rows))
            kinds = (pa.int32(), pa.int32(), pa.int64(), mark_kind, pa.string(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=[f.name for f in schema])

        def closed():  # of a track that ends within the partition nothing is handed on
            ends = within.get(part) is not None
            return [(h, part, -1 - s["n"], None, "meets" if ends else "passes" if s["passes"] else "open", None if ends else pickle.dumps(s["anchor"])) for h, s in going.items()]

        for batch in batches:
            if not batch.num_rows:
                continue
            if not going and part is not None and batch.column("_part")[0].as_py() == batch.column("_part")[-1].as_py() == part:
                continue
            mark_kind, rows = batch.schema.field(mark).type, []
            for now in _rows(batch, columns):
                if now["_part"] != part:
                    rows += closed()
                    part = now["_part"]
                    going = {h: dict(zip(("anchor", "last"), pickle.loads(b)), passes=True, n=0) for h, b in offers[part]}
                for h, s in list(going.items()):
                    if not goes_on(s["anchor"], s["last"], now):
                        s["anchor"], s["passes"] = {k: now[k] for k in look}, False
                        if now[name] == now[mark]:
                            rows.append((h, part, -1 - s["n"], None, "meets", None))
                            del going[h]
                            continue
                    s["last"], s["n"] = now, s["n"] + 1
                    rows.append((h, part, now["_at"], s["anchor"][mark], None, None))
            if rows:
                yield out(rows)
        if going:
            yield out(closed())

    wanted = held.where(F.col("_part").isin(list(offers)) & _before({p: within[p] for p in offers})).withColumns(seen).select(*columns)
    return wanted.repartition("_part").sortWithinPartitions("_part", "_at").mapInArrow(run, schema)
