"""Adaptive search for hyper-parameters: waves of successive halving that share one stored log of trials."""

from __future__ import annotations

import json
import math
import random
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..functions.staging_area import new_folder
from .evaluate import random_points

RECORD = "wave int, rung int, trial int, budget double, point string, value double"
GOOD_SHARE = 0.25  # of the finished trials, whose points the next wave resembles
CANDIDATES = 24  # drawn near good points for every proposal
EXPLORE = 3  # every third proposal of a later wave is random

Space = Mapping[str, "tuple[float, float] | Sequence[Any]"]


@dataclass(frozen=True)
class Record:
    wave: int
    rung: int
    trial: int
    budget: float
    point: str
    value: float | None

    @property
    def key(self) -> tuple[int, int, int]:
        return self.wave, self.rung, self.trial


def rungs(trials: int, eta: int, least: float, greatest: float) -> list[tuple[int, float]]:
    """(trials, budget) of every rung: each keeps one trial in ``eta``, at least one, and gives it ``eta`` times the budget,
    until the budget is ``greatest``."""
    if trials < 1 or eta < 2 or not 0 < least <= greatest:
        raise ValueError("a search needs a trial, eta of 2 or more and 0 < least <= greatest")
    plan = [(trials, float(least))]
    while plan[-1][1] < greatest:
        count, budget = plan[-1]
        plan.append((max(1, count // eta), min(float(greatest), budget * eta)))
    return plan


def worth(value: float | None) -> float:
    """Null and NaN rank below every number."""
    return -math.inf if value is None or math.isnan(value) else value


def survivors(found: Sequence[Record], count: int) -> list[int]:
    """The ``count`` best trials of a rung, ties to the smaller number, in order of their numbers."""
    best = sorted(found, key=lambda r: (-worth(r.value), r.trial))[:count]
    return sorted(r.trial for r in best)


def read_log(spark: SparkSession, log: str) -> dict[tuple[int, int, int], Record]:
    """Finished trials by (wave, rung, trial); none where the log does not exist yet.

    Two searches that share a log may both have finished a trial: the record whose text is smallest counts for both.
    """
    try:
        rows = spark.read.schema(RECORD).option("recursiveFileLookup", True).json(log).collect()  # one row per trial
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    found: dict[tuple[int, int, int], Record] = {}
    for r in sorted((Record(**row.asDict()) for row in rows), key=repr):
        found.setdefault(r.key, r)
    return found


def write_record(spark: SparkSession, log: str, record: Record) -> None:
    """Every record has a folder of its own, so that searches writing at the same time cannot undo each other's commits."""
    folder = new_folder(spark, "trial").rsplit("/", 1)[1]
    row = (record.wave, record.rung, record.trial, record.budget, record.point, record.value)
    spark.createDataFrame([row], RECORD).coalesce(1).write.option("ignoreNullFields", False).json(f"{log}/{folder}")


def is_range(values: Any) -> bool:
    return isinstance(values, tuple) and len(values) == 2 and all(isinstance(v, (int, float)) for v in values)


def density(values: Any, seen: Sequence[Any], x: Any) -> float:
    """Smoothed density of one hyper-parameter: normal kernels on the seen numbers or counts of the seen choices, beside
    one part of the uniform density."""
    if not is_range(values):
        return (sum(s == x for s in seen) + 1 / len(values)) / (len(seen) + 1)
    low, high = values
    width = (high - low) or 1
    band = width / (1 + len(seen)) ** 0.5 / 2
    kernels = sum(math.exp(-((x - s) / band) ** 2 / 2) / (band * math.sqrt(2 * math.pi)) for s in seen)
    return (kernels + 1 / width) / (len(seen) + 1)


def drawn_near(values: Any, seen: Sequence[Any], rng: random.Random) -> Any:
    """A draw from ``density``, kept inside the range."""
    at = rng.randrange(len(seen) + 1)
    if not is_range(values):
        return seen[at] if at < len(seen) else rng.choice(list(values))
    low, high = values
    whole = isinstance(low, int) and isinstance(high, int)
    if at == len(seen):
        return rng.randint(low, high) if whole else rng.uniform(low, high)
    x = rng.gauss(seen[at], (high - low) / (1 + len(seen)) ** 0.5 / 2)
    return min(max(round(x) if whole else x, low), high)


def proposals(space: Space, past: Sequence[Record], trials: int, wave: int, seed: int) -> list[dict[str, Any]]:
    """Points of a wave. The first is random; later ones maximise the ratio of the density of good points to that of the
    others, and every ``EXPLORE``-th is random. Only earlier, finished waves are looked at, so a wave has the same points
    whichever search proposes them, and after any interruption.

    Trials are ordered by the rung they reached and their value there, as values of different budgets do not compare.
    """
    points = random_points(space, trials, seed * 1_000_003 + wave)
    reached: dict[tuple[int, int], Record] = {}
    for r in sorted(past, key=lambda r: r.key):
        if r.wave < wave:
            reached[r.wave, r.trial] = r
    order = sorted(reached.values(), key=lambda r: (-r.rung, -worth(r.value), r.wave, r.trial))
    if len(order) < 4:
        return points
    cut = max(2, math.ceil(GOOD_SHARE * len(order)))
    good, rest = ([json.loads(r.point) for r in part] for part in (order[:cut], order[cut:]))
    for k in range(trials):
        if k % EXPLORE == EXPLORE - 1:
            continue
        rng = random.Random(f"{seed} {wave} {k}")
        tried = [{n: drawn_near(v, [g[n] for g in good], rng) for n, v in space.items()} for _ in range(CANDIDATES)]
        points[k] = max(tried, key=lambda p: sum(
            math.log(density(v, [g[n] for g in good], p[n])) - math.log(density(v, [b[n] for b in rest], p[n]))
            for n, v in space.items()))
    return points


def halving_search(
    spark: SparkSession, space: Space, evaluate: Callable[[dict[str, Any], float], float | None], log: str, trials: int = 9,
    waves: int = 2, eta: int = 3, least: float = 1, greatest: float = 9, seed: int = 0, parallel: int = 1, shared: bool = False,
    offset: int = 0,
) -> dict[str, Any]:
    """The point with the largest value at the greatest budget, found in ``waves`` of successive halving.

    ``evaluate(point, budget)`` has to be a function of its arguments (a fit on a hashed share of the subjects, or with so
    many rounds). A finished trial is stored at once below ``log``, in the shared folder: a search that was stopped goes on
    behind its last record and ends with the same log. Several searches may work on one log: with ``shared`` each looks there
    before every trial, and starts its rounds at its own ``offset``. ``parallel`` trials of a rung run side by side. Points
    hold numbers, strings and booleans. A null or NaN value ranks last; where no trial ends with a number there is an error.
    """
    plan = rungs(trials, eta, least, greatest)

    def run(known: Record | None, wave: int, rung: int, trial: int, point: dict[str, Any], budget: float) -> None:
        text = json.dumps(point, sort_keys=True)
        if known is None and shared:
            known = read_log(spark, log).get((wave, rung, trial))
        if known is None:
            value = evaluate(point, budget)
            write_record(spark, log, Record(wave, rung, trial, budget, text, None if value is None else float(value)))
        elif (known.point, known.budget) != (text, budget):
            raise ValueError(f"{log} belongs to a search with another space, seed or budget")

    for wave in range(waves):
        points = proposals(space, list(read_log(spark, log).values()), trials, wave, seed)
        alive = list(range(trials))
        for rung, (count, budget) in enumerate(plan):
            before = read_log(spark, log)
            if rung:
                alive = survivors([before[wave, rung - 1, k] for k in alive], count)
            turn = offset % len(alive)
            with ThreadPoolExecutor(max(1, parallel)) as pool:
                for done in [pool.submit(run, before.get((wave, rung, k)), wave, rung, k, points[k], budget)
                             for k in alive[turn:] + alive[:turn]]:
                    done.result()
    ends = [r for r in read_log(spark, log).values() if r.rung == len(plan) - 1 and worth(r.value) > -math.inf]
    if not ends:
        raise ValueError("no trial ended with a value")
    best = min(ends, key=lambda r: (-worth(r.value), r.wave, r.trial))
    return {"value": best.value, "point": json.loads(best.point), "trials": trials * waves}


def search_trace(spark: SparkSession, log: str, trials: int, eta: int, least: float, greatest: float) -> DataFrame:
    """All records of a search, with ``kept``: whether the trial went on to the next rung (in the last: was the wave's best)."""
    plan, found = rungs(trials, eta, least, greatest), read_log(spark, log)
    rows = []
    for wave, rung in sorted({(w, r) for w, r, _ in found}):
        here = [r for r in found.values() if (r.wave, r.rung) == (wave, rung)]
        kept = set(survivors(here, plan[rung + 1][0] if rung + 1 < len(plan) else 1))
        rows += [(r.wave, r.rung, r.trial, r.budget, r.point, r.value, r.trial in kept) for r in here]
    return spark.createDataFrame(rows, RECORD + ", kept boolean")
