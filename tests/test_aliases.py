"""Unique aliases against the loop over arrivals."""

import random

from shardwell.operators.aliases import ranked, unique


def loop(arrivals, taken):
    used, out = set(taken), {}
    for t, base in sorted(arrivals):
        name, k = base, 0
        while name in used:
            k += 1
            name = f"{base}-{k}"
        used.add(name)
        out[t] = name
    return out


def check(spark, arrivals, taken):
    rows = spark.createDataFrame(random.Random(0).sample(arrivals, len(arrivals)), "t long, base string").repartition(5)
    got = {x.t: x.alias for x in unique(rows, spark.createDataFrame([(x,) for x in taken], "alias string")).collect()}
    assert got == loop(arrivals, taken)


def test_against_the_loop(spark, seed=1):
    """Many independent roots in one go, each with literal names that look like generated ones."""
    r, arrivals, taken = random.Random(seed), [], set()
    for root in range(120):
        names = [f"r{root}"] * r.randrange(1, 6) + [f"r{root}-{k}" for k in range(1, 7)] + [f"r{root}-{k}-{j}" for k in range(1, 3) for j in range(1, 4)]
        arrivals += r.choices(names, k=r.randrange(2, 25))
        taken |= set(r.sample(names, r.randrange(3)))
    r.shuffle(arrivals)
    check(spark, list(enumerate(arrivals)), taken | {"r1-0", "r2-01", "r3-", "x"})


def test_one_base_holds_most(spark):
    r = random.Random(3)
    names = ["x"] * 900 + [f"x-{k}" for k in range(1, 800, 7)] + ["y", "x-3-1", "é-1", "é"]
    r.shuffle(names)
    check(spark, list(enumerate(names)), {f"x-{k}" for k in range(5, 400, 9)} | {"x", "y"})


def test_ranks_and_empty(spark):
    rows = spark.createDataFrame([("a", k) for k in range(500)] + [("b", 9), ("c", 1), ("c", 0)], "g string, v long").repartition(7)
    assert all(x.rank == (x.v + 1 if x.g == "a" else {("b", 9): 1, ("c", 0): 1, ("c", 1): 2}[x.g, x.v]) for x in ranked(rows, "g", "v").collect())
    none = spark.createDataFrame([], "t long, base string")
    assert unique(none, spark.createDataFrame([], "alias string")).count() == 0
