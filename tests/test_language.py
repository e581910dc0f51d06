"""Schemas, fixed-point prices, query values and query text."""

from __future__ import annotations

import dataclasses
import datetime as dt
import math

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from tickloom.errors import InvalidRecordError, ParseError, PriceRangeError, QueryError, RAMUnknownError, SchemaError
from tickloom.functions.codec import PRICE_SCALE, scale_price, unscale_price
from tickloom.operators.policy import FlushPolicy
from tickloom.plans.parser import parse
from tickloom.plans.query import Cond, Field, Op, Query, field_of
from tickloom.schema import BAR, TICK, Column, FixedBytes, Kind, RecordSchema, TimeUnit, kind_of, parse_unit


def tag(text: str):
    return dataclasses.field(metadata={"column": text})


@dataclasses.dataclass
class Quote:
    datetime: np.int64 = tag("datetime,time,primary,unit=us")
    bid: np.float64 = tag("bid,price,index")
    ask: np.float64 = tag("price,index")
    size: np.uint64 = tag("size,index,alias=qty|volume")
    note: str = ""
    _hidden: int = 0


def test_schema_of_a_dataclass():
    s = RecordSchema.of(Quote)
    assert [c.name for c in s.columns] == ["datetime", "bid", "ask", "size"]
    assert s.unit is TimeUnit.US and s.time.name == "datetime" and s.time_index == 0 and len(s) == 4
    assert s.field("QTY").name == s.field("Volume").name == "size"
    assert str(s) == "Quote(datetime:int64, bid:float64/price, ask:float64/price, size:uint64)"
    assert [c.name for c in s.stats_columns] == ["bid", "ask", "size"]
    assert RecordSchema.from_json(s.to_json()) == s
    assert RecordSchema.of(Quote) is s
    with pytest.raises(SchemaError, match="datetime, bid"):
        s.fields("bid", "nope")


@pytest.mark.parametrize(
    "fields",
    [
        {"a": (np.int64, "a")},
        {"a": (np.int64, "a,time"), "b": (np.int64, "b,time")},
        {"a": (np.float64, "a,time")},
        {"a": (np.int64, "a-b,time")},
        {"a": (np.int64, "a,time"), "b": (np.int64, "A")},
        {"a": (np.int64, "a,time,alias=c"), "b": (np.int64, "c")},
        {"a": (np.int64, "a,time"), "b": (np.float32, "b,price")},
        {"a": (np.int64, "a,time"), "b": (np.int64, "b,price")},
        {"a": (np.int64, "a,time,index")},
        {"a": (np.int64, "a,time,what")},
        {"a": (np.int64, "a,time,")},
        {"a": (np.int64, "a,time,alias=")},
        {"a": (np.int64, "a,time"), "b": (str, "b")},
        {"a": (np.int64, "a,time"), "b": (list, "b")},
        {"a": (np.int64, "a,time"), "b": (dt.datetime, "b")},
    ],
)
def test_schema_refuses(fields):
    made = dataclasses.make_dataclass("Bad", [(n, t, dataclasses.field(metadata={"column": tag_})) for n, (t, tag_) in fields.items()])
    for _ in range(2):  # failures are remembered too
        with pytest.raises(SchemaError):
            RecordSchema.of(made)
    with pytest.raises(SchemaError):
        RecordSchema.of(int)


def test_kinds_and_units():
    assert kind_of(np.uint8) == (Kind.UINT8, 1) and kind_of(FixedBytes[6]) == (Kind.BYTES, 6) and kind_of(bool) == (Kind.BOOL, 1)
    assert Kind.INT16.bounds == (-32768, 32767) and Kind.UINT64.bounds == (0, 2**63 - 1)
    assert parse_unit("Millis") is TimeUnit.MS and parse_unit("h") is TimeUnit.UNKNOWN
    assert TimeUnit.US.ticks(dt.timedelta(hours=1)) == 3_600_000_000 and TimeUnit.UNKNOWN.ticks(1) == -1
    assert BAR.record_size == 60 and TICK.record_size == 56
    assert BAR.struct().fieldNames()[:2] == ["datetime", "open"] and BAR.stored_struct().fieldNames()[1] == "open_fp"
    with pytest.raises(SchemaError):
        FixedBytes[0]
    with pytest.raises(SchemaError):
        RecordSchema("X", (Column("", Kind.INT64, 8, time=True),))


def test_prices():
    assert scale_price(0.29) == 29_000_000 and scale_price(0.000000005) == 1 and scale_price(-37.63, True) == -3_763_000_000
    for bad in (math.nan, math.inf, -1.0):
        with pytest.raises(InvalidRecordError):
            scale_price(bad)
    with pytest.raises(PriceRangeError):
        scale_price(1e30)


@given(st.integers(0, 10**8))
def test_price_round_trip(cents):
    value = cents / 100
    assert value * PRICE_SCALE < 2**52
    assert unscale_price(scale_price(value)) == value


def test_builder_equals_text():
    q = Query("binance/spot/BTCUSDT").between(600_000, 54_000_000).where("close", ">", 100.5).where(Field.VOLUME, Op.LTE, 5000)
    q = q.newest_first().take(250).select("volume", "datetime", Field.CLOSE, "close")
    assert parse(q.text()) == q and q.fields == (Field.DATETIME, Field.CLOSE, Field.VOLUME)
    assert q.oldest_first().take(-3).limit == 0


@given(
    st.text(min_size=1, max_size=20),
    st.lists(st.tuples(st.sampled_from(list(Field)), st.sampled_from(list(Op)), st.integers(0, 2**52)), max_size=4),
    st.integers(0, 10**14), st.integers(0, 10**14), st.integers(0, 1000), st.booleans(), st.sets(st.sampled_from(list(Field))),
)
def test_text_round_trip(key, conds, a, b, limit, desc, fields):
    q = Query(key).between(min(a, b), max(a, b)).take(limit).select(*fields)
    for f, op, n in conds:
        q = q.where(f, op, (n % 9 * 10**14) / 1e4 + n % 977 / 100 if f.is_price else n)
    q = q.newest_first() if desc else q
    back = parse(q.text())
    assert back.window() == q.window() and back.fields == q.fields and back.limit == q.limit and back.key == q.key
    assert [c for c in back.conds if c.field is not Field.DATETIME] == [c for c in q.conds if c.field is not Field.DATETIME]


def test_open_windows_survive_text():
    for q in (Query("k").between(5, 0), Query("k").between(0, 5), Query("k").between(9, 3), Query("1 odd:key\\")):
        assert parse(q.text()).window() == q.window() and parse(q.text()).key == q.key


@given(st.decimals(0, 9 * 10**10, places=8), st.sampled_from([f for f in Field if f.is_price]), st.sampled_from(list(Op)))
def test_price_text(value, field, op):
    q = Query("k").where(field, op, value)
    assert q.conds[0].stored == int(value * PRICE_SCALE) and parse(q.text()).conds == q.conds


#: A query with every clause, clause by clause, and for each clause ways to spoil it.
CLAUSES = {
    "select": "SELECT datetime, close",
    "from": 'FROM "some key"',
    "range": "RANGE 10 TO 20",
    "where": "WHERE volume <= 7 AND close > 1.5",
    "order": "ORDER BY datetime ASC",
    "limit": "LIMIT 3",
}
SPOILT = {
    "select": ["SELECT", "SELECT ,close", "SELECT close,", "SELECT close volume", "SELECT *, close", "SELECT colour", "SELECT 3", "PICK close"],
    "from": ["", "FROM", "FROM 'some key'", 'FROM "some key', 'FROM ""', "FROM 7up", 'FROM "a" "b"', "FROM a, b"],
    "range": ["RANGE", "RANGE 10", "RANGE 10 TO", "RANGE TO 20", "RANGE 20 TO 10", "RANGE 1.5 TO 20", "RANGE -1 TO 20", "RANGE 10 20"],
    "where": ["WHERE", "WHERE volume", "WHERE volume <=", "WHERE volume <= 7 AND", "WHERE volume <= 7 OR close > 1.5", "WHERE volume ! 7", "WHERE volume <= -7", "WHERE volume <= 7e2", "WHERE volume <= inf", "WHERE volume <= 7.1.1", 'WHERE volume <= "7"', "WHERE colour = 7", "WHERE 7 >= volume"],
    "order": ["ORDER datetime ASC", "ORDER BY ASC", "ORDER BY datetime", "ORDER BY volume ASC", "ORDER BY datetime UPWARDS", "ORDER BY datetime ASC DESC"],
    "limit": ["LIMIT", "LIMIT many", "LIMIT -3", "LIMIT 3.5", "LIMIT 3 4", "LIMIT 3 ;"],
}


@pytest.mark.parametrize(("clause", "text"), [(c, t) for c, own in SPOILT.items() for t in own])
def test_parser_refuses_a_spoilt_clause(clause, text):
    assert parse(" ".join(CLAUSES.values())).limit == 3
    query = " ".join(text if c == clause else own for c, own in CLAUSES.items())
    with pytest.raises(ParseError) as error:
        parse(query)
    assert 0 <= error.value.pos <= len(query) and f"at {error.value.pos}" in str(error.value)


def test_parser_refuses_clauses_out_of_place():
    for a, b in (("select", "from"), ("where", "limit"), ("order", "limit"), ("range", "where")):
        swapped = CLAUSES | {a: CLAUSES[b], b: CLAUSES[a]}
        with pytest.raises(ParseError):
            parse(" ".join(swapped.values()))
    with pytest.raises(ParseError):
        parse("")


def test_parser_accepts():
    q = parse('select "close", TS from a/b-c.d where TickVolume = 3 and spread <> 4 order by "time" desc limit 7')
    assert q == Query("a/b-c.d", (Field.DATETIME, Field.CLOSE), conds=(Cond(Field.TICK_VOLUME, Op.EQ, 3), Cond(Field.SPREAD, Op.NE, 4)), newest_first_=True, limit=7)
    assert parse("FROM k") == Query("k") and parse(r'FROM "a\"b\\c"').key == 'a"b\\c' and field_of("TIME") is Field.DATETIME


def test_conditions():
    assert Cond.of(Field.VOLUME, Op.GTE, 1.5).stored == 1 and Cond.of(Field.CLOSE, Op.EQ, 0.29).stored == 29_000_000
    for field, value in ((Field.CLOSE, math.nan), (Field.CLOSE, math.inf), (Field.CLOSE, -0.1), (Field.CLOSE, 1e12), (Field.VOLUME, -1), (Field.VOLUME, 2**53), (Field.VOLUME, math.nan)):
        with pytest.raises(QueryError):
            Cond.of(field, Op.GT, value)
    for bad in ("nope", "==="):
        with pytest.raises(QueryError):
            Query("k").where(bad if bad == "nope" else "close", bad, 1)
    q = Query("k").between(10, 90).where("datetime", ">", 20).where("datetime", "<=", 80).where("datetime", "==", 50)
    assert q.window() == (21, 80)


class Clock:
    def __init__(self):
        self.t = 100.0

    def __call__(self):
        return self.t


def test_policy():
    clock = Clock()
    p = FlushPolicy(0.5, now=clock, ram=1000)
    assert p.budget_bytes == 500 and not p.due() and p.interval() == 0
    p.append(100)
    clock.t += 1
    assert p.interval() == 5 and not p.due()
    clock.t += 100
    assert p.interval() == 505 and not p.due()  # the rate is an average since the first append
    p.append(450)
    assert p.due()
    p.flushed()
    assert not p.due() and p.at_risk_bytes == 0
    p.append(500)
    assert p.due()
    p.rebase()
    assert p.at_risk_bytes == 500 and p.interval() == 0
    q = FlushPolicy(-1, 60, now=clock, ram=0)
    q.append(1)
    assert not q.due() and not q.ram_known
    clock.t += 60
    assert q.due()
    fast = FlushPolicy(0.001, now=clock, ram=10_000)
    fast.append(9)
    clock.t += 0.1
    assert fast.interval() == 1.0
    with pytest.raises(RAMUnknownError):
        FlushPolicy(0.5, ram=0)
    assert FlushPolicy().budget_bytes > 0


def test_policy_moments():
    clock = Clock()
    p = FlushPolicy(0.5, 30, now=clock, ram=1000)
    assert p.next_flush() == math.inf
    p.append(0)
    assert p.next_flush() == math.inf
    p.append(100)
    assert p.next_flush() == 130  # no rate yet, so the ceiling alone counts
    clock.t += 2
    assert p.next_flush() == 110  # 50 bytes a second fill 500 in 10 seconds
    p.flushed(40)
    assert p.at_risk_bytes == 60 and p.next_flush() == 110
    p.flushed(60)
    assert p.at_risk_bytes == 0 and not p.due()
    p.append(500)
    assert p.next_flush() == -math.inf and p.due()
