"""Components of all edges of a table, against brute force."""

from __future__ import annotations

import random
from collections import Counter

import duckdb

from prismwell import graph
from prismwell.plans import catalog

SF = "/root/testdata/sf0.01"


def brute_force(edges: set[tuple]) -> set[tuple]:
    near: dict = {}
    for mesh, u, v in edges:
        near.setdefault((mesh, u), set()).add(v)
        near.setdefault((mesh, v), set()).add(u)
    seen, out = set(), set()
    for mesh, start in sorted(near):
        todo, found = [start], set()
        while todo:
            if (x := todo.pop()) not in found:
                found.add(x)
                todo += near[mesh, x]
        if (mesh, start) not in seen:
            out.add((mesh, start, len(found)))
            seen |= {(mesh, x) for x in found}
    return out


def rows(df) -> list[tuple]:
    return sorted((r["mesh"], r["component"], r["size"]) for r in df.collect())


def test_lines_of_any_quantity_are_edges(spark, tmp_path):
    rng = random.Random(4)
    lines = [(rng.choice("AN"), "O", rng.randint(1, 2), rng.randint(1, 60), rng.randint(1, 9), float(rng.randint(1, 50))) for _ in range(90)]
    spark.createDataFrame(lines, "l_returnflag string, l_linestatus string, l_linenumber int, l_suppkey long, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = brute_force({(f"{flag}{status}{number}", s, s + p % 3) for flag, status, number, s, p, _ in lines})
    assert rows(catalog.QUERIES["components_whole"](spark, str(tmp_path))) == sorted(want)


def test_components_of_the_whole_table(spark):
    edges = duckdb.sql(f"SELECT DISTINCT l_returnflag || l_linestatus || l_linenumber, l_suppkey, l_suppkey + l_partkey % 3 FROM '{SF}/lineitem.parquet'").fetchall()
    assert rows(catalog.QUERIES["components_whole"](spark, SF)) == sorted(brute_force(set(edges)))


def test_graphs_that_a_task_can_hold_take_no_rounds(spark):
    """A path of 3000 nodes in each of two graphs: before, every round of hanging nodes on lesser ones was three jobs and more."""
    paths = [(g, i, i + 1) for g in (1, 2) for i in range(3000)]
    random.Random(1).shuffle(paths)
    spark.sparkContext.setJobGroup("paths", "components of paths")
    try:
        got = graph.components(spark.createDataFrame(paths, "graph long, u long, v long").repartition(6)).collect()
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("paths")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(map(tuple, got)) == [(g, i, 0) for g in (1, 2) for i in range(3001)]
    assert len(jobs) <= 12


def test_giants_and_others(spark, monkeypatch):
    monkeypatch.setattr(graph, "CONTRACTED", 50)
    rng = random.Random(7)
    lines = [("giant", rng.randint(1, 300), rng.randint(1, 300)) for _ in range(200)] + [("star", 5, i) for i in range(120)]
    lines += [(f"g{k}", rng.randint(-9, 9), rng.randint(-9, 9)) for k in range(30) for _ in range(rng.randint(1, 12))] + [(None, 1, 2)]
    found = [tuple(r) for r in graph.components(spark.createDataFrame(lines, "graph string, u long, v long").repartition(5)).collect()]
    assert len({(g, node) for g, node, _ in found}) == len(found)
    sizes = Counter((g, c) for g, _, c in found)
    assert sorted((*k, n) for k, n in sizes.items()) == sorted(brute_force({x for x in lines if x[0] and x[1] != x[2]}))
