"""Keys, intervals, conditions, pages and hints, without tables."""

import pytest
from hypothesis import given
from hypothesis import strategies as st

from lodekey.functions import keys
from lodekey.functions import partition_ids as ids
from lodekey.functions.bloom import ADDED, FULL, PRESENT, LayeredBloom
from lodekey.functions.sizes import decode_data, encode_data
from lodekey.plans import conditions, intervals
from lodekey.plans.intervals import Condition, Interval, interval_of
from lodekey.plans.pages import Cursor, CursorError, PageBudget, fingerprint

SORT_KEYS = ["a", "ab", "abc", "b", "ba", "c", "d"]


def met(condition):
    i = interval_of(condition)
    return [] if i is None else [k for k in SORT_KEYS if i.holds(k.encode())]


@pytest.mark.parametrize(
    ("condition", "expected"),
    [
        (Condition("eq", "b"), ["b"]),
        (Condition("gt", "b"), ["ba", "c", "d"]),
        (Condition("gte", "b"), ["b", "ba", "c", "d"]),
        (Condition("lt", "b"), ["a", "ab", "abc"]),
        (Condition("lte", "b"), ["a", "ab", "abc", "b"]),
        (Condition("between", "ab", "c"), ["ab", "abc", "b", "ba", "c"]),
        (Condition("between", "z", "a"), []),
        (Condition("begins_with", "a"), ["a", "ab", "abc"]),
        (Condition("begins_with", "b"), ["b", "ba"]),
        (Condition("begins_with", "ab"), ["ab", "abc"]),
        (Condition("begins_with", ""), SORT_KEYS),
        (Condition("begins_with", "zzz"), []),
        (Condition("range", "a", "b", False, True), ["ab", "abc", "b"]),
        (Condition("range", "c"), ["c", "d"]),
        (Condition("range", None, "b"), ["a", "ab", "abc"]),
        (Condition("range", "b", "b"), []),
        (None, SORT_KEYS),
    ],
)
def test_conditions_as_intervals(condition, expected):
    assert met(condition) == expected


def test_absent_sort_key():
    for c, there in ((Condition("lt", "a"), True), (Condition("lte", "a"), True), (None, True), (Condition("begins_with", ""), True), (Condition("gt", "a"), False), (Condition("eq", "a"), False)):
        assert interval_of(c).holds(b"") == there


def test_binary_keys_sort_behind_all_text():
    order = [keys.encode_key(k) for k in ("a", "￿", "\U0001f600", b"\x01\x02", b"\xff")]
    assert order == sorted(order)
    assert interval_of(Condition("gt", "z")).holds(keys.encode_key(b"\x00"))


@pytest.mark.parametrize("bad", ["", b"", "\ud800"])
def test_bad_keys(bad):
    with pytest.raises(ValueError):
        keys.encode_key(bad)


def test_nul_in_public_keys():
    with pytest.raises(ValueError):
        keys.check_key_text("a\0b", 100, "hash key")
    with pytest.raises(ValueError):
        keys.check_key_text("a" * 101, 100, "hash key")


@given(st.binary(min_size=1, max_size=6))
def test_successor(prefix):
    s = keys.successor(prefix)
    if set(prefix) == {255}:
        assert s is None
    else:
        assert s > prefix + b"\xff" * 8
        assert not any(s > prefix + t >= s for t in (b"", b"\x00"))


@given(st.binary(max_size=5), st.binary(min_size=1, max_size=5))
def test_separator(a, b):
    if a == b:
        return
    low, high = sorted((a, b))
    r = keys.shortest_separator(low, high)
    assert low < r <= high
    assert not any(low < high[:n] <= high for n in range(len(r)))


@given(st.binary(min_size=1), st.none() | st.binary(max_size=4), st.none() | st.binary(max_size=4), st.lists(st.integers(0, 255), max_size=5))
def test_partition_ids_come_back(hk, start, end, path):
    for p in (ids.RangePartition(hk, start, end), ids.HashPartition(300, tuple(path))):
        assert ids.unpack(p.pack()) == p
        assert not set(p.name("t")) & set(' "\\')
    assert ids.HashPartition(7, tuple(path)).children(3)[2] == ids.HashPartition(7, (*path, 2))


def test_names():
    assert ids.name_part(b"a b.c%~\xff") == "a%20b%2Ec%25%7E%FF"
    assert ids.RangePartition(b"k").name("t") == "t.r.k.~min.~max"
    assert ids.HashPartition(258, (1, 2)).pack() == bytes([0, 1, 2, 2, 1, 2])
    for bad in (b"", b"\x02abc", b"\x00\x00\x00\x05"):
        with pytest.raises(ValueError):
            ids.unpack(bad)


def test_slices():
    i = Interval(b"c", True, b"m", True)
    assert intervals.intersects(None, b"d", i)
    assert not intervals.intersects(None, b"c", i)
    assert intervals.intersects(b"m", None, i)
    assert not intervals.intersects(b"n", None, i)
    assert intervals.clip(b"d", b"k", i) == Interval(b"d", True, b"k", False)
    assert intervals.clip(None, None, i) == i
    assert intervals.before_cursor(b"a", b"c", b"c", True)
    assert intervals.before_cursor(b"c", None, b"c", False)
    assert intervals.falls_in(b"a", b"c", b"b")
    assert intervals.boundary_cursor(b"a", b"c", True) == (b"c", True)
    assert intervals.boundary_cursor(b"a", b"c", False) == (b"a", False)


def test_write_conditions():
    assert conditions.evaluate([], None) is None
    assert conditions.evaluate([conditions.ITEM_EXISTS], None) == 0
    assert conditions.evaluate([conditions.ITEM_EXISTS, conditions.attribute_equals(2)], 1) == 1
    assert conditions.evaluate([conditions.ITEM_NOT_EXISTS], None) is None
    text = conditions.reason_json("condition_failed", key=b"\x00\xff", index=1)
    assert conditions.parse_reason(text) == {"type": "condition_failed", "key": b"\x00\xff", "index": 1}


@pytest.mark.parametrize("value", [b"\x00\x01\x02\xff", "hello", '{"a":1}', {"a": 1, "nested": {"b": [True, "x", None]}, "list": [1, 2, 3]}, []])
def test_data_comes_back(value):
    assert decode_data(*encode_data(value)) == value


@pytest.mark.parametrize("value", [1, None, True, {"a": float("nan")}])
def test_bad_data(value):
    with pytest.raises(ValueError):
        encode_data(value)


def test_cursors():
    parts = [(b"alice", Interval(), True)]
    c = Cursor(0, True, fingerprint(parts), b"a\xff")
    assert Cursor.decode(c.encode()) == c
    c.check(parts)
    with pytest.raises(CursorError, match="direction"):
        c.check([(b"alice", Interval(), False)])
    with pytest.raises(CursorError, match="fingerprint"):
        c.check([(b"bob", Interval(), True)])
    with pytest.raises(CursorError, match="malformed"):
        Cursor.decode("nonsense")


def test_budget():
    b = PageBudget(items=2, bytes=100)
    b.spend(items=1, bytes=99)
    assert not b.exhausted
    b.spend(bytes=1)
    assert b.exhausted
    assert not PageBudget().exhausted


def test_bloom():
    b = LayeredBloom(64, 0.01, 500_000)
    made = [f"k{i}".encode() for i in range(500)]
    assert {b.add(k) for k in made} <= {ADDED, PRESENT}
    assert all(k in b for k in made)
    assert sum(f"x{i}".encode() in b for i in range(2000)) < 60
    again = LayeredBloom.from_bytes(b.to_bytes())
    assert all(k in again for k in made)
    small = LayeredBloom(4, 0.01, 300)
    assert FULL in {small.add(f"k{i}".encode()) for i in range(2000)}


def test_many_keys_at_once():
    """As one by one: the same bits are asked, none is lost, and what doesn't fit is counted."""
    made = [f"k{i}".encode() for i in range(500)]
    other = [f"x{i}".encode() for i in range(2000)]
    one, many = LayeredBloom(64, 0.01, 500_000), LayeredBloom(64, 0.01, 500_000)
    for k in made:
        one.add(k)
    assert one.hold(made + other).tolist() == [k in one for k in made + other]
    added, refused = many.add_all(made + made)
    assert (added, refused) == (sum(many.counts), 0)
    assert added >= 490
    assert many.hold(made).all()
    assert all(k in many for k in made)
    assert many.hold(other).sum() < 60
    assert many.add_all(made) == (0, 0)
    small = LayeredBloom(4, 0.01, 300)
    added, refused = small.add_all(other)
    assert added == small.most_keys == sum(small.counts)
    assert 0 < refused <= len(other) - added
