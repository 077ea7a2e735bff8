import datetime as dt
import random
import zlib

from pyspark.sql import functions as F

from glyphflow.llm import cohorts, queries
from tests.oracle import compare

DAY = dt.timedelta(days=1)
CLICKS = "click_id long, ts timestamp_ntz, client_id long, kind string, value double, note string"


def exact(known, late, clients, width=1):
    """The matrix of both states, each worked out from all of its rows."""
    out, starts = {}, []
    for rows in (known, known + late):
        seen = list({r: None for r in rows if r[1] is not None and r[2] is not None})
        first = {}
        for r in seen:
            if r[3] == "signup":
                first[r[2]] = min(first.get(r[2], r[1]), r[1])
        starts.append((seen, first))
    day = lambda t: (t.date() - dt.date(1970, 1, 1)).days // width
    for state, (seen, first) in enumerate(starts):
        cells = {}
        for r in seen:
            if r[2] in first and r[1] >= first[r[2]]:
                segments = [s for c, s in clients if c == r[2] and s is not None]
                key = (state, min(segments, default=""), day(first[r[2]]), (r[1] - first[r[2]]) // (DAY * width))
                money = cells.setdefault(key, {})
                good = r[4] is not None and r[4] == r[4] and abs(r[4]) < float("inf")
                money[r[2]] = money.get(r[2], 0) + (int(100 * r[4] + 0.5 // 1) if good else 0)
        for key, money in cells.items():
            moved = sum(c in starts[0][1] and c in starts[1][1] and day(starts[0][1][c]) != day(starts[1][1][c]) for c in money)
            out[key] = (len(money), sum(zlib.crc32(str(c).encode()) for c in money), moved, sum(money.values()))
    return out


def got(df):
    rows = df.collect()
    out = {(r.state, r.segment, r.cohort, r.period): (r.users, r.users_crc32, r.moved, r.cents) for r in rows}
    assert len(out) == len(rows)
    return out


def test_query(spark, tiny):
    compare(spark, tiny, queries.op11_retention, queries.OP11_SQL)


def test_random_rows(spark):
    """Nulls, repeats, starts that move within a day, over days and not at all, a client with a third of the rows."""
    rnd = random.Random(4)
    at = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(microseconds=rnd.randrange(20 * 86_400_000_000))
    rows = [(i, rnd.choice([None, *[at()] * 30]), rnd.choice([7, 7, rnd.randrange(30), None]), rnd.choice(["signup", "view", None, "buy"]), rnd.choice([None, float(rnd.randrange(500))]), "x") for i in range(600)]
    rows += [rows[3]] * 5 + [(*rows[4][:4], 9.0, "x"), (*rows[4][:5], "y")]
    start = dt.datetime(2024, 1, 5, 12)
    rows += [(900, start, 50, "signup", 1.0, ""), (901, start + DAY - dt.timedelta(microseconds=1), 50, "view", 2.0, ""), (902, start + DAY, 50, "view", 4.0, ""), (903, start - dt.timedelta(microseconds=1), 50, "view", 8.0, "")]
    rows += [(904, start, 51, "signup", float("nan"), ""), (905, start, 51, "view", float("inf"), ""), (906, dt.datetime(1969, 12, 31, 23), 52, "signup", 1.0, "")]
    late = [r for r in rows if r[0] % 3 == 0]
    known = [r for r in rows if r[0] % 3]
    late += [(907, start - dt.timedelta(hours=1), 50, "signup", 16.0, ""), (908, start + DAY, 50, "signup", 32.0, "")]
    clients = [(i, rnd.choice(["a", "b", None])) for i in range(40)] + [(1, "a"), (1, "c"), (None, "z"), (7, "hot")]
    names = spark.createDataFrame(clients, "client_id long, segment string").selectExpr("*", "1 as cohort", "2 as start")
    frame = lambda r: spark.createDataFrame(r, CLICKS).selectExpr("*", "1 as period", "2 as segment", "3 as start")
    for width in (1, 7):
        first = cohorts.materialise(frame(known), names, width=width)
        assert got(cohorts.matrix(first, cohorts.advance(first, frame(late)))) == exact(known, late, clients, width)


def test_advance_again(spark):
    """Three batches one after the other end where one state of all rows begins; nothing late changes nothing."""
    rnd = random.Random(5)
    rows = [(i, dt.datetime(2024, 3, 31) - dt.timedelta(hours=rnd.randrange(900)), rnd.randrange(12), rnd.choice(["signup", "view"]), 1.5, "") for i in range(400)]
    frame = lambda r: spark.createDataFrame(r, CLICKS)
    clients = spark.createDataFrame([(i, "s") for i in range(12)], "client_id long, segment string")
    state = cohorts.materialise(frame(rows[:100]), clients)
    for a in (100, 200, 300):
        state = cohorts.advance(state, frame(rows[a : a + 100]))
    whole = cohorts.materialise(frame(rows), clients)
    cells = lambda s: sorted(map(tuple, s.cells.select(*cohorts.CELL, "users", "users_crc32", "cents").collect()))
    assert cells(state) == cells(whole) == cells(cohorts.advance(whole, frame([])))


def test_zones_and_empty_tables(spark):
    assert spark.range(1).select(cohorts.micros(F.lit("2024-03-31 02:30:00.000001").cast("timestamp_ntz")).alias("x")).first().x == 1711852200_000001
    none, names = spark.createDataFrame([], CLICKS), spark.createDataFrame([], "client_id long, segment string")
    first = cohorts.materialise(none, names)
    assert cohorts.matrix(first, cohorts.advance(first, none)).collect() == []
    click = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), 5, "signup", 1.0, "")], CLICKS)
    found = cohorts.matrix(first, cohorts.advance(first, click)).collect()
    assert [(r.state, r.segment, r.users, r.moved, r.cents) for r in found] == [(1, "", 1, 0, 100)]


def test_no_client_in_one_task(spark):
    """The sums after the join by client are dealt out anew, so that the join can be split."""
    rows = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), 5, "signup", 1.0, "")], CLICKS)
    first = cohorts.materialise(rows, rows.selectExpr("client_id", "'s' as segment"))
    plan = cohorts._spread(cohorts._met(first.history, first.starts), 1)._jdf.queryExecution().executedPlan().toString()
    join = plan.index("SortMergeJoin")
    assert plan[:join].count("Exchange hashpartitioning") == 1 and "Broadcast" not in plan
