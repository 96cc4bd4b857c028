"""Parent-child rows to full hierarchies, by contraction of fragments.

1. Every link is laid out by a locality key (the file and block of pages an element comes from), and
   each partition contracts its own parent chains with array pointer doubling: every node learns
   its fragment's exit, its distance to it, and whether it sits on or below a cycle inside the fragment.
2. The exits form a quotient forest, which is far smaller. It is solved recursively: up to
   ``ONE_TASK`` links in one task; beyond that every link to a known end becomes an end itself and every link to
   itself a cycle, a hash coin then merges a quarter of the others into their parents, and the rest, which
   is smaller by a quarter at least on average, is solved the same way.
3. Fragment results are expanded by the result of their exit; a link that a cycle was led through is on
   that cycle, and so are the nodes of its target's fragment between the two.

Paths are made only where they are asked for; without them no row grows with the depth.

Defined results: NULL ids are dropped; repeated rows of an id count once (the smallest non-NULL parent
holds); a node that names itself is a cycle of one; a parent that is no node makes its child an orphan,
which then is the root of what hangs below it; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamstone.plans.tables import cut

#: Links the quotient may have to be solved in one task (some 50 bytes each).
ONE_TASK = 300_000
#: Nodes of a fragment: a partition with more is contracted in chunks of this size.
CHUNK = 500_000

_FRAGMENT = "id string, parent string, frag string, hops int, state string, path array<string>"
_LINK = "f string, to string, w int, via array<string>, terminal string"
_SOLVED = "f string, root string, w int, via array<string>, status string"


def effective_parents(df: DataFrame, node: str, parent: str, children: str | None, locality: Column) -> DataFrame:
    """One row (id, parent, loc) per node; a NULL parent is filled from the nodes whose ``children`` list it.

    Where several nodes list the same child, the smallest id holds. One shuffle, combined map-side.
    """
    none = F.lit(None).cast("string")
    rows = df.where(F.col(node).isNotNull()).select(
        F.col(node).alias("id"), F.col(parent).alias("parent"), locality.cast("long").alias("loc"), F.lit(1).alias("here"), none.alias("lister")
    )
    if children:
        listed = df.where(F.col(node).isNotNull() & (F.size(children) > 0)).select(F.explode(children).alias("id"), F.col(node).alias("lister"))
        rows = rows.unionByName(
            listed.where(F.col("id").isNotNull()).select("id", none.alias("parent"), F.lit(None).cast("long").alias("loc"), F.lit(0).alias("here"), "lister")
        )
    found = rows.groupBy("id").agg(F.max("here").alias("here"), F.min("parent").alias("parent"), F.min("lister").alias("lister"), F.min("loc").alias("loc"))
    return found.where("here = 1").select("id", F.coalesce("parent", "lister").alias("parent"), F.coalesce("loc", F.lit(0).cast("long")).alias("loc"))


def _jump(up: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Follows ``up`` (own index at an end) to its end by doubling: end, distance, and which nodes never end."""
    n = len(up)
    end, dist = up.copy(), weight.astype(np.int64)
    for _ in range(max(1, n).bit_length() + 1):
        nxt = end[end]
        if np.array_equal(nxt, end):
            break
        dist = dist + dist[end]
        end = nxt
    stuck = up[end] != end
    return end, dist, stuck


def _contract(pdf: pd.DataFrame, all_paths: bool) -> pd.DataFrame:
    ids, parents = pdf["id"].to_numpy(object), pdf["parent"].to_numpy(object)
    n = len(ids)
    at = pd.Index(ids).get_indexer(pd.Index(parents, dtype=object)) if n else np.zeros(0, int)
    at = np.where(pd.isna(parents), -1, at)
    own = np.arange(n)
    self_loop = at == own
    up = np.where(at < 0, own, at)
    up_for_jump = up.copy()
    # a node naming itself looks like an end to the doubling: it is its own cycle
    end, dist, stuck = _jump(up_for_jump, (up != own).astype(np.int64))
    on_cycle = np.zeros(n, bool)
    if stuck.any():
        on_cycle[end[stuck]] = True  # the image of enough steps, closed below
        frontier = np.unique(end[stuck])
        while len(frontier):
            frontier = np.unique(up[frontier])
            frontier = frontier[~on_cycle[frontier]]
            on_cycle[frontier] = True
    on_cycle |= self_loop
    below = (stuck | self_loop[end]) & ~on_cycle
    ends_out = ~pd.isna(parents[end]) & (at[end] < 0)
    state = np.where(on_cycle, "cycle", np.where(below, "below_cycle", np.where(ends_out, "exit", "root")))
    paths: list[list[str] | None] = [None] * n
    wanted = np.flatnonzero((state == "exit") | (state == "root")) if all_paths else np.zeros(0, int)
    for i in wanted[np.argsort(dist[wanted], kind="stable")]:  # a parent comes before its children
        above = paths[up[i]] if up[i] != i else None
        paths[i] = [*above, ids[i]] if above else [ids[i]]
    return pd.DataFrame({"id": ids, "parent": parents, "frag": ids[end], "hops": dist.astype(np.int32), "state": state, "path": paths})


def _contract_partitions(all_paths: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += len(b)
            if size >= CHUNK:
                yield _contract(pd.concat(held, ignore_index=True), all_paths)
                held, size = [], 0
        if held:
            yield _contract(pd.concat(held, ignore_index=True), all_paths)

    return run


def _solve_in_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Solves a bounded quotient: ``terminal`` rows are known ends, the others links."""
    pdf = pd.concat([*batches, pd.DataFrame(columns=["f", "to", "w", "via", "terminal"])], ignore_index=True)
    pdf = pdf.drop_duplicates("f", ignore_index=True)
    n = len(pdf)
    if not n:
        return
    ids, known = pdf["f"].to_numpy(object), pdf["terminal"].notna().to_numpy()
    at = pd.Index(ids).get_indexer(pd.Index(pdf["to"].to_numpy(object), dtype=object))
    own = np.arange(n)
    up = np.where(known | (at < 0), own, at)
    given = pd.to_numeric(pdf["w"]).fillna(0).to_numpy(np.int64)
    w = np.where(known, 0, given)
    looped = ~known & (at == own)
    end, dist, stuck = _jump(up, np.where(up == own, 0, w))
    cyc = looped.copy()
    frontier = np.unique(end[stuck]) if stuck.any() else np.zeros(0, int)
    while len(frontier):
        frontier = frontier[~cyc[frontier]]
        cyc[frontier] = True
        frontier = np.unique(up[frontier])
        frontier = frontier[~cyc[frontier]]
    terminal = pdf["terminal"].to_numpy(object)
    root, tw, via0 = pdf["to"].to_numpy(object), given, pdf["via"].to_numpy(object)
    vias: list[list[str]] = [list(v) if v is not None else [] for v in via0]
    full: list[list[str] | None] = [None] * n
    for i in np.argsort(dist, kind="stable"):
        if not (stuck[i] or looped[end[i]]):
            full[i] = vias[i] if up[i] == i else [*(full[up[i]] or []), *vias[i]]
    out = []
    for i in range(n):
        if known[i]:
            continue
        if cyc[i]:
            out.append((ids[i], None, 0, vias[i], "cycle"))
        elif stuck[i] or looped[end[i]]:
            out.append((ids[i], None, 0, [], "below_cycle"))
        else:
            e = end[i]
            out.append((ids[i], root[e], int(dist[i] + tw[e]), full[i], terminal[e]))
    yield pd.DataFrame(out, columns=["f", "root", "w", "via", "status"])


def _marked_ancestors(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one fragment: the marked nodes and all above them."""
    ids = pdf["id"].to_numpy(object)
    up = pd.Index(ids).get_indexer(pd.Index(pdf["parent"].to_numpy(object), dtype=object))
    on = np.zeros(len(ids), bool)
    for i in np.flatnonzero(pdf["marked"].to_numpy(bool)).tolist():
        while i >= 0 and not on[i]:
            on[i] = True
            i = int(up[i])
    return pd.DataFrame({"id": ids[on]})


_LOST = ("cycle", "below_cycle")


def _solve(links: DataFrame, level: int = 0, before: int | None = None) -> DataFrame:
    """(f, root, w, via, status) of every open link, one without ``terminal``; the other rows of ``links`` are known ends.

    The status of a link on a cycle is ``cycle``, of one that runs into a cycle ``below_cycle``.
    """
    open_links = links.where("terminal is null")
    n = open_links.count()
    if n <= ONE_TASK:
        needed = links.where("terminal is not null").join(open_links.select(F.col("to").alias("f")).distinct(), "f", "left_semi")
        return open_links.unionByName(needed).coalesce(1).mapInPandas(_solve_in_task, _SOLVED)
    if level > 400 or before is not None and n > before:
        raise RuntimeError(f"the quotient forest does not shrink: {n} links at level {level}")
    none, nothing = F.lit(None).cast("string"), F.array().cast("array<string>")
    looped = open_links.where("f = to").select("f", none.alias("to"), F.lit(0).alias("w"), nothing.alias("via"), F.lit("cycle").alias("terminal"))
    ends = links.where("terminal is not null").unionByName(looped)
    e = ends.select(F.col("f").alias("to"), F.col("to").alias("e_to"), F.col("w").alias("e_w"), F.col("via").alias("e_via"), F.col("terminal").alias("e_terminal"))
    ended, lost = F.col("e_terminal").isNotNull(), F.coalesce(F.col("e_terminal").isin(*_LOST), F.lit(False))
    step = cut(
        open_links.where("f <> to").join(e, "to", "left").select(
            "f",
            F.when(lost, none).when(ended, F.col("e_to")).otherwise(F.col("to")).alias("to"),
            F.when(lost, 0).otherwise(F.col("w") + F.coalesce("e_w", F.lit(0))).cast("int").alias("w"),
            F.when(lost, nothing).when(ended, F.concat("e_via", "via")).otherwise(F.col("via")).alias("via"),
            F.when(lost, F.lit("below_cycle")).otherwise(F.col("e_terminal")).alias("terminal"),
        )
    )
    done = looped.unionByName(step.where("terminal is not null"))
    still = step.where("terminal is null")
    heads = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(level)), F.lit(2)) == 1
    merging = ~heads("f") & heads("to")
    merged = still.where(merging)
    m = merged.select(F.col("f").alias("to"), F.col("to").alias("m_to"), F.col("w").alias("m_w"), F.col("via").alias("m_via"))
    rest = cut(
        still.where(~merging).join(m, "to", "left").select(
            "f",
            F.when(F.col("m_to").isNotNull(), F.col("to")).alias("by"),
            F.coalesce("m_to", "to").alias("to"),
            (F.col("w") + F.coalesce("m_w", F.lit(0))).cast("int").alias("w"),
            F.when(F.col("m_to").isNotNull(), F.concat("m_via", "via")).otherwise(F.col("via")).alias("via"),
            "terminal",
        )
    )
    needed = done.join(rest.select(F.col("to").alias("f")).distinct(), "f", "left_semi")
    below = cut(_solve(cut(rest.drop("by").unionByName(needed)), level + 1, n))
    results = below.unionByName(done.select("f", F.col("to").alias("root"), "w", "via", F.col("terminal").alias("status")))
    # what a cycle's link was led through is on the cycle
    around = rest.where("by is not null").join(below.where("status = 'cycle'").select("f"), "f", "left_semi").select(F.col("by").alias("f")).distinct().withColumn("around", F.lit(True))
    s = results.select(F.col("f").alias("to"), F.col("root").alias("s_root"), F.col("w").alias("s_w"), F.col("via").alias("s_via"), F.col("status").alias("s_status"))
    gone = F.col("s_status").isin(*_LOST)
    back = merged.join(s, "to").join(around, "f", "left").select(
        "f",
        F.col("s_root").alias("root"),
        F.when(gone, 0).otherwise(F.col("w") + F.col("s_w")).cast("int").alias("w"),
        F.when(gone, nothing).otherwise(F.concat("s_via", "via")).alias("via"),
        F.when(F.col("around"), F.lit("cycle")).when(gone, F.lit("below_cycle")).otherwise(F.col("s_status")).alias("status"),
    )
    return results.unionByName(back)


def solve_hierarchy(nodes: DataFrame, paths: bool = True) -> DataFrame:
    """``nodes``: (id, parent, loc), one row an id. Gives id, parent, root, depth, path (root first), finding.

    ``finding`` is cycle, below_cycle, orphan or NULL; a node on or below a cycle has no root, depth or
    path. ``path`` is NULL throughout unless ``paths``.
    """
    nodes = cut(nodes)
    # a locality key with more rows than a fragment holds is spread over several partitions
    hot = nodes.groupBy("loc").count().where(F.col("count") > CHUNK).select("loc", F.ceil(F.col("count") / CHUNK).alias("parts"))
    laid = nodes.join(hot, "loc", "left").withColumn("salt", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("id"), F.col("parts"))).otherwise(F.lit(0)))
    parts = cut(laid.repartition("loc", "salt").select("id", "parent").mapInPandas(_contract_partitions(paths), _FRAGMENT))

    exits = parts.where("state = 'exit' and hops = 0").select(F.col("id").alias("f"), F.col("parent").alias("p"))
    target = parts.select(F.col("id").alias("p"), "frag", "hops", "state")
    nothing = F.array().cast("array<string>")
    links = cut(
        exits.join(target, "p", "left").select(
            "f",
            "p",
            F.when(F.col("state").isNull(), F.col("f")).when(~F.col("state").isin(*_LOST), F.col("frag")).alias("to"),
            F.when(F.col("state").isNull() | F.col("state").isin(*_LOST), 0).otherwise(F.col("hops") + 1).cast("int").alias("w"),
            F.when(F.col("state").isNull() | F.lit(not paths), nothing).otherwise(F.array("p")).alias("via"),
            F.when(F.col("state").isNull(), F.lit("orphan")).when(F.col("state") == "exit", F.lit(None)).when(F.col("state") == "root", F.lit("root")).otherwise(F.lit("below_cycle")).alias("terminal"),
        )
    )
    closed = links.where("terminal is not null").select("f", F.col("to").alias("root"), "w", "via", F.col("terminal").alias("status"))
    solved = cut(closed.unionByName(_solve(links.drop("p"))))

    s = solved.select(F.col("f").alias("frag"), "root", "w", "status")
    # the nodes of a fragment between where a cycle enters it and its exit
    entered = links.join(solved.where("status = 'cycle'").select("f"), "f", "left_semi").select(F.col("p").alias("id")).distinct().withColumn("marked", F.lit(True))
    within = parts.where("state = 'exit'").join(solved.where("status = 'cycle'").select(F.col("f").alias("frag")), "frag", "left_semi")
    through = (
        within.join(entered, "id", "left").select("frag", "id", "parent", F.coalesce("marked", F.lit(False)).alias("marked"))
        .groupBy("frag").applyInPandas(_marked_ancestors, "id string").withColumn("on_cycle", F.lit(True))
    )
    if paths:
        pieces = solved.where(~F.col("status").isin(*_LOST)).select("f", F.posexplode("via").alias("k", "p"))
        prefix = (
            pieces.join(parts.select(F.col("id").alias("p"), "path"), "p")
            .groupBy("f")
            .agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "path"))), lambda x: x["path"])).alias("prefix"))
        )
        s = s.join(prefix.withColumnRenamed("f", "frag"), "frag", "left")
    else:
        s = s.withColumn("prefix", F.lit(None).cast("array<string>"))
    inner = parts.where("state <> 'exit'").select(
        "id", "parent", F.when(F.col("state") == "root", F.col("frag")).alias("root"), F.when(F.col("state") == "root", F.col("hops")).alias("depth"),
        F.when(F.col("state") == "root", F.col("path")).alias("path"), F.when(F.col("state") != "root", F.col("state")).alias("finding"),
    )
    lost = F.col("status").isin(*_LOST)
    outer = (
        parts.where("state = 'exit'").join(s, "frag").join(through, "id", "left")
        .select(
            "id", "parent", F.when(~lost, F.col("root")).alias("root"), F.when(~lost, F.col("hops") + F.col("w")).cast("int").alias("depth"),
            F.when(~lost & F.lit(paths), F.concat(F.coalesce("prefix", nothing), "path")).alias("path"),
            F.when(lost & F.col("on_cycle").isNotNull(), F.lit("cycle")).when(lost, F.lit("below_cycle")).when((F.col("status") == "orphan") & (F.col("root") == F.col("id")), F.lit("orphan")).alias("finding"),
        )
    )
    return inner.unionByName(outer)


def hierarchy(df: DataFrame, node: str, parent: str, children: str | None, locality: Column, paths: bool = True) -> DataFrame:
    return solve_hierarchy(effective_parents(df, node, parent, children, locality), paths)


def descendants(solved: DataFrame) -> DataFrame:
    """(ancestor, id, distance) for every node and each of its ancestors; rows, so that no root's subtree is gathered."""
    n = F.size("path")
    return solved.where("path is not null").select(F.col("id"), n.alias("n"), F.posexplode("path").alias("k", "ancestor")).where("k < n - 1").select("ancestor", "id", (F.col("n") - 1 - F.col("k")).alias("distance"))
