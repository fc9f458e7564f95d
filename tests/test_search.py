import math

import pytest

from fleetlife.plans import search

SPACE = {"x": (0.0, 10.0), "n": (1, 9), "kind": ["a", "b", "c"]}
OPTIONS = {"trials": 9, "waves": 3, "eta": 3, "least": 1, "greatest": 9, "seed": 7}


def value(point, budget):
    return -abs(point["x"] - 7) - (point["n"] - 4) ** 2 / 9 + (point["kind"] == "b") + math.log(budget) / 50


def records(spark, log):
    return sorted(search.read_log(spark, log).values(), key=lambda r: r.key)


def test_rungs():
    assert search.rungs(9, 3, 1, 9) == [(9, 1.0), (3, 3.0), (1, 9.0)]
    assert search.rungs(2, 4, 1, 5) == [(2, 1.0), (1, 4.0), (1, 5.0)]
    with pytest.raises(ValueError):
        search.rungs(0, 3, 1, 9)


def test_survivors_take_the_smaller_trial_on_ties_and_nan_last():
    rows = [search.Record(0, 0, k, 1, "{}", x) for k, x in enumerate([float("nan"), 2.0, None, 2.0, 1.0])]
    assert search.survivors(rows, 1) == [1]
    assert search.survivors(rows, 3) == [1, 3, 4]
    assert search.survivors(rows, 5) == [0, 1, 2, 3, 4]


def test_an_interrupted_search_ends_like_one_that_was_not(spark, tmp_path):
    whole, stopped = str(tmp_path / "whole"), str(tmp_path / "stopped")
    best = search.halving_search(spark, SPACE, value, whole, parallel=4, **OPTIONS)
    calls = []

    def breaks(point, budget):
        calls.append(point)
        if len(calls) in (5, 12, 20):
            raise RuntimeError("lost")
        return value(point, budget)

    for _ in range(3):
        with pytest.raises(RuntimeError):
            search.halving_search(spark, SPACE, breaks, stopped, **OPTIONS)
    assert search.halving_search(spark, SPACE, breaks, stopped, shared=True, offset=4, **OPTIONS) == best
    assert records(spark, stopped) == records(spark, whole)
    assert len(calls) == 3 * 13 + 3  # nothing but the broken trials ran twice

    seen = records(spark, whole)
    for wave in range(3):
        for rung, count in ((0, 9), (1, 3), (2, 1)):
            here = [r for r in seen if (r.wave, r.rung) == (wave, rung)]
            assert len(here) == count
            if rung:
                before = sorted((r for r in seen if (r.wave, r.rung) == (wave, rung - 1)), key=lambda r: (-r.value, r.trial))
                assert {r.trial for r in here} == {r.trial for r in before[:count]}
    first, last = ([r.value for r in seen if r.wave == w and r.rung == 0] for w in (0, 2))
    assert sum(last) / 9 > sum(first) / 9  # later waves propose better points
    assert best["value"] == max(r.value for r in seen if r.rung == 2)


def test_a_log_of_another_search_is_refused_and_no_value_is_an_error(spark, tmp_path):
    log = str(tmp_path / "log")
    small = {"trials": 2, "waves": 1, "eta": 2, "least": 1, "greatest": 2}
    with pytest.raises(ValueError, match="no trial"):
        search.halving_search(spark, SPACE, lambda p, b: None, log, seed=1, **small)
    with pytest.raises(ValueError, match="another space"):
        search.halving_search(spark, SPACE, value, log, seed=2, **small)


def test_records_of_two_searches_count_once(spark, tmp_path):
    log = str(tmp_path / "log")
    for _ in range(2):
        search.write_record(spark, log, search.Record(0, 0, 1, 1.0, "{}", 0.5))
    assert records(spark, log) == [search.Record(0, 0, 1, 1.0, "{}", 0.5)]
