"""Coercion of arguments."""

from __future__ import annotations

from siftwell.operators import arguments as a


def test_numbers_are_clamped_and_bad_ones_default():
    assert [a.as_int(v, 5, 1, 10) for v in ("7", 99, -3, None, "x", 2.9)] == [7, 10, 1, 5, 5, 2]
    assert [a.as_float(v, 1.5, 0, 9) for v in ("2.5", 99, None, "nan", "x")] == [2.5, 9, 1.5, 1.5, 1.5]


def test_flags_modes_terms_objects():
    assert [a.as_bool(v, True) for v in ("no", "YES", None, 0, "maybe")] == [False, True, True, False, True]
    assert [a.as_mode(v) for v in ("Loose", "other", None)] == ["loose", "all", "all"]
    assert a.as_terms(" a, ,b", ("z",)) == ("a", "b") and a.as_terms([], ("z",)) == ("z",) and a.as_terms(["c "], ()) == ("c",)
    assert a.as_object('{"k": 1}') == {"k": 1} and a.as_object("[1]") == {"result": "[1]"} and a.as_object(None) == {"result": None}
    assert a.as_queries('{"Acme": "q", "Zeta": ["a", 1], "n": 3}') == {"Acme": ["q"], "Zeta": ["a", "1"]} and a.as_queries("") == {}
