import random
import zlib

import pytest
from pyspark.sql import functions as F

from loamstone.operators import hierarchy as H


def brute(par):
    out = {}
    for x in par:
        seen, y = [x], x
        while True:
            p = par[y]
            if p is None:
                out[x] = (seen[-1], len(seen) - 1, seen[::-1], None)
                break
            if p not in par:
                out[x] = (y, len(seen) - 1, seen[::-1], "orphan" if y == x else None)
                break
            if p in seen:
                out[x] = (None, None, None, "cycle" if p == x else "below_cycle")
                break
            seen.append(p)
            y = p
    return out


@pytest.fixture(autouse=True)
def partitions_that_split(spark):
    """Without coalescing every group of nodes is a fragment by itself, so that links among fragments are many."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def solve(spark, par, groups=20):
    df = spark.createDataFrame([(k, v, zlib.crc32(k.encode()) % groups) for k, v in par.items()], "id string, parent string, loc long")
    full = {r.id: (r.root, r.depth, r.path, r.finding) for r in H.solve_hierarchy(df).collect()}
    bare = {r.id: (r.root, r.depth, r.path, r.finding) for r in H.solve_hierarchy(df, paths=False).collect()}
    assert bare == {k: (a, b, None, d) for k, (a, b, _, d) in full.items()}
    return full


@pytest.mark.parametrize("one_task", [300_000, 8])
@pytest.mark.parametrize("seed", [1, 2])
def test_random_forests_with_cycles(spark, monkeypatch, one_task, seed):
    monkeypatch.setattr(H, "ONE_TASK", one_task)
    r = random.Random(seed)
    n = 250
    par = {f"n{i}": None if r.random() < 0.06 else "gone" if r.random() < 0.02 else f"n{r.randrange(n) if r.random() < 0.15 else r.randrange(max(0, i - 4), i) if i else 0}" for i in range(n)}
    assert solve(spark, par) == brute(par)


def test_chain_across_fragments_and_self_parent(spark, monkeypatch):
    monkeypatch.setattr(H, "ONE_TASK", 5)
    par = {f"c{i}": f"c{i - 1}" if i else None for i in range(120)} | {"me": "me", "under": "me"} | {f"k{i}": f"k{(i + 1) % 30}" for i in range(30)}
    assert solve(spark, par, 7) == brute(par)


def test_links_to_ends_self_links_and_short_cycles_shrink(spark, monkeypatch):
    monkeypatch.setattr(H, "ONE_TASK", 8)
    sizes = []
    inner = H._solve
    monkeypatch.setattr(H, "_solve", lambda links, *a: (sizes.append(links.where("terminal is null").count()), inner(links, *a))[1])
    par = {"top": None}
    for i in range(40):
        par |= {f"a{i}": "top", f"b{i}": f"a{i}", f"s{i}": f"s{i}", f"u{i}": f"s{i}", f"x{i}": f"y{i}", f"y{i}": f"x{i}", f"z{i}": f"y{i}", f"o{i}": "gone", f"p{i}": f"o{i}"}
    assert solve(spark, par) == brute(par)
    runs = [i for i, n in enumerate(sizes) if i and n > sizes[i - 1]]
    assert sizes[0] > 60 and len(runs) == 1  # within each of the two runs no level is larger than the one before


def test_small_fragments(spark, monkeypatch):
    monkeypatch.setattr(H, "CHUNK", 10)
    par = {f"c{i}": f"c{i // 2}" if i else None for i in range(60)}
    assert solve(spark, par, 2) == brute(par)


def test_parents_from_children_nulls_repeats_and_empty(spark):
    rows = [("a", None, ["b", "c", None]), ("a", None, ["b", "c", None]), ("b", None, None), ("c", "z", []), ("z", None, ["b"]), (None, "a", ["a"]), ("s", None, ["s"])]
    df = spark.createDataFrame(rows, "n string, p string, c array<string>").withColumn("root", F.lit(1)).withColumn("path", F.lit("x"))
    got = {r.id: (r.parent, r.root, r.finding) for r in H.hierarchy(df, "n", "p", "c", F.lit(0)).collect()}
    assert got == {"a": (None, "a", None), "b": ("a", "a", None), "c": ("z", "z", None), "z": (None, "z", None), "s": ("s", None, "cycle")}
    assert H.hierarchy(df.limit(0), "n", "p", "c", F.lit(0)).count() == 0


def test_descendants(spark):
    df = spark.createDataFrame([("a", None, 0), ("b", "a", 1), ("c", "b", 2)], "id string, parent string, loc long")
    assert {tuple(r) for r in H.descendants(H.solve_hierarchy(df)).collect()} == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1)}
