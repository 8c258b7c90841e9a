"""Schemas and status orders refuse what they can't merge."""

import pytest

from tributary.schema import BENCH, DIAMOND, GSET, SERIES, STATUS, TOTAL_ORDER, Field, Schema, StatusOrder, same_schema


def test_total_order():
    assert TOTAL_ORDER.bottom == "s0" and TOTAL_ORDER.terminal == ("s3",)
    assert TOTAL_ORDER.masks == {"s0": 15, "s1": 14, "s2": 12, "s3": 8}


def test_diamond():
    assert not DIAMOND.comparable("l", "r") and DIAMOND.table["l", "r"] == "top" and DIAMOND.bottom == "bot"


@pytest.mark.parametrize("join", [lambda a, b: a, lambda a, b: "zz", lambda a, b: "x"])
def test_bad_joins(join):
    with pytest.raises(ValueError):
        StatusOrder.of(["x", "y"], join)


def test_joins_and_pairs_give_one_order():
    diamond = StatusOrder.of(["bot", "l", "r", "top"], lambda a, b: a if a == b or b == "bot" else b if a == "bot" else "top")
    assert diamond == DIAMOND and StatusOrder.of(["a", "b", "c"], max) == StatusOrder.total("abc") == StatusOrder.of_pairs("abc", [("a", "b"), ("b", "c")])
    with pytest.raises(ValueError, match="least"):
        StatusOrder.of_pairs(["a", "b"], [])


def test_not_associative():
    beats = {("r", "s"): "r", ("s", "p"): "s", ("p", "r"): "p"}
    with pytest.raises(ValueError, match="least"):
        StatusOrder.of(["r", "s", "p"], lambda a, b: a if a == b else beats.get((a, b)) or beats[b, a])


@pytest.mark.parametrize(
    "make",
    [
        lambda: Field("", GSET),
        lambda: Field("x", "Counter"),
        lambda: Field("x", GSET, scale=-1),
        lambda: Field("x", STATUS),
        lambda: Field("x", SERIES, dedup_on=("pt",)),
        lambda: Schema("s", ()),
        lambda: Schema("s", (Field("x", GSET), Field("x", GSET))),
    ],
)
def test_invalid(make):
    with pytest.raises(ValueError):
        make()


def test_round_trip_and_fingerprint():
    again = Schema.from_json(BENCH.to_json())
    assert same_schema(BENCH, again) is BENCH
    other = Schema("bench", (Field("x", GSET),))
    with pytest.raises(ValueError):
        same_schema(BENCH, other)


def test_too_many_values():
    with pytest.raises(ValueError):
        StatusOrder.total([f"v{i}" for i in range(64)]).masks
