"""Samples that need a sequence of decisions: the greedy stratified sample and the backfill loop."""

import random
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .corpus import stratum_allocation

#: Candidates of a verification sample, which people are to read; each decision depends on all before.
MAX_CANDIDATES = 200_000
#: Rounds of the backfill loop.
MAX_ROUNDS = 20


def greedy_stratified_sample(candidates: DataFrame, n: int, seed: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """n of the candidates (key, stratum, repo, components array): near-equal per stratum, preferring new repositories and components.

    Strata are served smallest first; kept keys are taken before all others. The sequence runs on the driver over narrow
    rows, whose number is checked. Null strata are left out; repeated keys count once; equal novelty follows the seeded
    order, so the result is the same on every run.
    """
    own = candidates.where("key is not null and stratum is not null").groupBy("key").agg(F.min("stratum").alias("stratum"), F.min("repo").alias("repo"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("components")))).alias("components"))
    sizes = own.groupBy("stratum").agg(F.count(F.lit(1)).alias("size"))
    wanted = {r.stratum: r.alocado for r in stratum_allocation(sizes, n).collect()}
    rows = own.limit(MAX_CANDIDATES + 1).collect()
    if len(rows) > MAX_CANDIDATES:
        raise ValueError(f"more than {MAX_CANDIDATES} candidates")
    by: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: r.key):
        by.setdefault(r.stratum, []).append(r)
    rng, repos, parts, chosen = random.Random(seed), Counter(), Counter(), []

    def take(r) -> None:
        repos[r.repo] += 1
        parts.update(r.components)
        chosen.append((r.key, r.stratum))

    for stratum in sorted(by, key=lambda s: (len(by[s]), s)):
        pool = by[stratum]
        rng.shuffle(pool)
        first = [r for r in pool if r.key in keep][: wanted[stratum]]
        for r in first:
            take(r)
        rest = [r for r in pool if r.key not in keep]
        for _ in range(wanted[stratum] - len(first)):
            if not rest:
                break
            best = min(range(len(rest)), key=lambda i: (repos[rest[i].repo], sum(parts[c] for c in rest[i].components) / max(1, len(rest[i].components)), i))
            take(rest.pop(best))
    return candidates.sparkSession.createDataFrame(chosen, "key string, stratum string")


def run_until_target(pool: DataFrame, key: str, order: list, target: int, process: Callable[[DataFrame], DataFrame], max_rounds: int = MAX_ROUNDS) -> tuple[list[str], int]:
    """(keys that qualified, rounds): takes the next candidates until `target` of them qualify or none are left.

    Each round asks only for the deficit, in the given order; `process` returns the qualified rows of its input.
    """
    spark = pool.sparkSession
    used: list[str] = []
    good: list[str] = []
    for n in range(max_rounds):
        deficit = target - len(good)
        if deficit <= 0:
            return good, n
        tried = spark.createDataFrame([(k,) for k in used], f"{key} string")
        batch = pool.join(tried, key, "left_anti").orderBy(*order).limit(deficit)
        keys = [r[key] for r in batch.select(key).collect()]
        if not keys:
            return good, n
        used += keys
        good += [r[key] for r in process(pool.where(F.col(key).isin(keys))).select(key).collect()]
    return good, max_rounds
