"""Prompt files with all their fields, row numbers without a sort, even samples, colours, and the log of runs."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismwell import graph
from prismwell.operators import requests, stats
from prismwell.plans.catalog import QUERIES
from prismwell.sources import readers, runs

SF = "/root/testdata/sf0.001"
ROWS = [{"sample_id": "s1", "edit_instruction": "make it red", "tier": 2, "constraints": [{"constraint_id": "c1"}, "plain"]}, "two", {"prompt": "three", "negative_prompt": "blur", "constraints": "none", "original_prompt": "was"}, 4, {"id": "x", "text": "five"}]


@pytest.mark.parametrize("name", ["list.json", "samples.json", "prompts.json", "lines.jsonl"])
def test_prompt_files_keep_their_fields_and_order(spark, tmp_path, name):
    doc = {"list.json": ROWS, "samples.json": {"samples": ROWS}, "prompts.json": {"samples": [], "prompts": ROWS}}.get(name)
    (tmp_path / name).write_text(json.dumps(doc) if doc else "\n\n".join(map(json.dumps, ROWS)))
    got = {r["idx"]: {k: v for k, v in r.asDict().items() if v is not None and k != "idx"} for r in readers.prompt_rows(spark, str(tmp_path / name)).collect()}
    assert json.loads(got[0].pop("constraints")) == ROWS[0]["constraints"]
    assert got == {0: {"sample_id": "s1", "edit_instruction": "make it red", "tier": "2"}, 1: {"prompt": "two"}, 2: {"prompt": "three", "negative_prompt": "blur", "original_prompt": "was"}, 3: {"prompt": "4"}, 4: {"id": "x", "text": "five"}}


def test_a_file_of_edits_gives_its_requests(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps([{"sample_id": "s1", "edit_instruction": "make it red"}, {"instruction": "keep it,  preserve all"}]))
    rows = readers.prompt_rows(spark, str(tmp_path / "e.json")).withColumn("request_id", F.lit(1))
    asked = spark.createDataFrame([(1, "edit", "a scene", 3, "p", "")], "request_id int, route string, user_request string, num_samples int, sample_prefix string, negative_prompt string")
    got = sorted(requests.build_prompts(asked, rows).collect(), key=lambda r: r["idx"])
    assert [r["sample_id"] for r in got] == ["s1", "p_0002", "p_0003"]
    assert [r["original_prompt"] for r in got][:2] == ["make it red", "keep it, preserve all"]
    assert got[0]["prompt"] == "make it red. " + requests.PRESERVATION and got[1]["prompt"] == "keep it, preserve all"


def test_lines_of_text_are_numbered_without_blank_ones(spark, tmp_path):
    lines = [f"prompt {i} " + "x" * (i % 50) if i % 3 else " " for i in range(5000)]
    (tmp_path / "p.txt").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        got = readers.prompt_rows(spark, str(tmp_path / "p.txt")).select("idx", "prompt").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["prompt"] for r in sorted(got, key=lambda r: r["idx"])] == [x.strip() for x in lines if x.strip()]
    assert sorted(r["idx"] for r in got) == list(range(len(got)))


def test_rows_of_several_parquet_files_are_numbered_in_their_order(spark, tmp_path):
    spark.range(1000).withColumn("v", F.col("id") * 2).repartitionByRange(5, "id").sortWithinPartitions("id").write.parquet(str(tmp_path / "t"))
    got = readers.numbered(readers.placed(spark.read.parquet(str(tmp_path / "t"))), "i").collect()
    assert all(r["i"] == r["id"] for r in got) and len(got) == 1000
    assert readers.numbered(readers.placed(spark.read.parquet(str(tmp_path / "t"))).where("false")).count() == 0


@pytest.mark.parametrize(("n", "most"), [(10, 20), (20, 20), (21, 20), (1000, 7), (999, 500), (12_345, 2), (4001, 4000)])
def test_even_samples_equal_those_of_numpy(spark, n, most):
    got = sorted(r["id"] for r in stats.evenly_sampled(spark.range(n), "id", n, most).collect())
    assert got == (list(range(n)) if n <= most else np.linspace(0, n - 1, most, dtype=np.int64).tolist())


def test_statistics_of_distances(spark):
    rng = np.random.default_rng(1)
    xyz = rng.normal(size=(500, 3))
    rows = [(int(i % 3), *map(float, p)) for i, p in enumerate(xyz)] + [(9, float("nan"), 0.0, 0.0), (8, 3.0, 4.0, 0.0)]
    got = {r["m"]: r for r in stats.radial_statistics(spark.createDataFrame(rows, "m int, x double, y double, z double"), "m", ["x", "y", "z"]).collect()}
    assert set(got) == {0, 1, 2, 8}
    for k in range(3):
        v = np.linalg.norm(xyz[k::3], axis=1)
        want = {"n": len(v), "min": v.min(), "p05": np.quantile(v, 0.05), "median": np.median(v), "p95": np.quantile(v, 0.95), "max": v.max(), "mean": v.mean(), "std": v.std(), "coefficient_of_variation": v.std() / v.mean(), "relative_range": np.ptp(v) / v.mean()}
        assert {c: got[k][c] for c in want} == pytest.approx(want)
    assert (got[8]["mean"], got[8]["relative_range"]) == (5.0, 0.0)
    depths = spark.createDataFrame([(1, 1.0), (1, 3.0), (1, -5.0), (1, float("inf")), (1, None), (2, 0.0)], "f int, d double")
    assert [(r["f"], r["n"], r["mean"]) for r in stats.depth_statistics(depths, "f", "d").collect()] == [(1, 2, 2.0)]


def test_each_mask_of_the_reference_colour(spark):
    rng = np.random.default_rng(2)
    images = {}
    for k, (solid, white) in enumerate([(40, 0), (10, 5), (0, 60), (31, 64), (32, 64)]):
        p = rng.uniform(0, 0.9, (64, 4))
        p[:, 3] = np.arange(64) < solid
        p[64 - white :, :3] = 0.96
        images[k] = p
    rows = [(k, *map(float, x)) for k, p in images.items() for x in p]
    got = {r["image"]: r for r in stats.reference_color(spark.createDataFrame(rows, "image int, r double, g double, b double, a double"), "image", ["r", "g", "b"], "a").collect()}
    used = []
    for k, p in images.items():
        masks = [p[:, 3] > 0.2, ~(p[:, :3].min(axis=1) > 0.94), np.ones(64, bool)]
        at = next(i for i, m in enumerate(masks) if m.sum() >= 32 or i == 2)
        used.append(at)
        c = p[masks[at]][:, :3]
        want = c.mean(axis=0) * 0.4 + np.quantile(c, 0.35, axis=0) * 0.6
        assert [got[k][x] for x in "rgb"] == pytest.approx(want, abs=6e-5) and got[k]["pixel_count"] == len(c)
        assert got[k]["colorfulness"] == pytest.approx((max(want) - min(want)) / max(want), abs=1e-3)
    assert set(used) == {0, 1, 2}


def test_the_rows_of_a_key_are_dealt_out_in_slices(spark, monkeypatch, capsys):
    monkeypatch.setattr(graph, "TASK_ROWS", 100)
    monkeypatch.setattr(stats, "SLICE_ROWS", 200)
    rng = np.random.default_rng(7)
    points = {1: rng.uniform(0.1, 0.9, (2500, 3)), 2: rng.uniform(0.1, 0.9, (40, 3)), 3: np.full((300, 3), 0.5)}
    rows = [(k, *map(float, p), 1.0) for k, c in points.items() for p in c]
    colors = stats.reference_color(spark.createDataFrame(rows, "image int, r double, g double, b double, a double"), "image", ["r", "g", "b"], "a")
    colors.explain()
    assert "REPARTITION_BY_NUM" in capsys.readouterr().out
    got = {r["image"]: r for r in colors.collect()}
    assert set(got) == set(points)
    for k, c in points.items():
        assert [got[k][x] for x in "rgb"] == pytest.approx(c.mean(axis=0) * 0.4 + np.quantile(c, 0.35, axis=0) * 0.6, abs=6e-5) and got[k]["pixel_count"] == len(c)
    odd = [(1, float(v)) for v in points[1][:, 0]] + [(1, None), (1, float("nan")), (4, None), (5, 2.0)]
    marks = {(r["k"], r["share"]): r["q"] for r in stats.quantiles(spark.createDataFrame(odd, "k int, v double"), "k", ["v"], [0.05, 0.5, 0.95]).collect()}
    assert marks == pytest.approx({(1, s): np.quantile(points[1][:, 0], s) for s in (0.05, 0.5, 0.95)} | {(5, s): 2.0 for s in (0.05, 0.5, 0.95)})


@pytest.mark.parametrize("name", ["prompt_expansion", "keyword_review", "guidance_block", "request_builder", "mesh_incidence", "reference_color"])
def test_generated_code_compiles(spark, name):
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")


# --- runs ---


def test_the_pointer_stays_on_the_last_success(spark, tmp_path):
    log = runs.RunLog(spark, str(tmp_path / "log"))
    assert log.latest() is None and log.runs().count() == 0
    for run, scene, steps in [("r1", "a", ["running", "complete"]), ("r2", "a", ["incomplete", "failed"]), ("r3", "b", ["complete"]), ("r4", "a", [])]:
        log.create(run, scene)
        for s in steps:
            log.step(run, s)
    assert (log.latest(), log.latest("a"), log.latest("none")) == ("r3", "r1", None)
    assert {(r["run_id"], r["scene_id"], r["status"], r["steps"]) for r in log.runs().collect()} == {("r1", "a", "complete", 3), ("r2", "a", "failed", 3), ("r3", "b", "complete", 2), ("r4", "a", "running", 1)}


def test_steps_that_may_not_follow(spark, tmp_path):
    log = runs.RunLog(spark, str(tmp_path / "log"))
    for bad in ("", ".hidden", "a/b", "../x", None):
        with pytest.raises(ValueError, match="no name"):
            log.create(bad, "s")
    with pytest.raises(KeyError):
        log.step("unknown", "complete")
    log.create("r", "s")
    log.step("r", "complete")
    for status in ("running", "complete", "failed"):
        with pytest.raises(runs.RunConflict):
            log.step("r", status)
    with pytest.raises(runs.RunConflict):
        log.create("r", "s")
    log.create("q", "s")
    log.step("q", "running", "first", seen=0)
    with pytest.raises(runs.RunConflict):  # a writer that has not seen the first step
        log.step("q", "failed", "second", seen=0)
    assert log.state("q")["note"] == "first" and log.latest() == "r"


def test_of_two_runs_with_one_id_one_fails(spark, tmp_path):
    log = runs.RunLog(spark, str(tmp_path / "log"))

    def begin(_) -> bool:
        try:
            log.create("same", "s")
        except runs.RunConflict:
            return False
        return True

    with ThreadPoolExecutor(8) as pool:
        assert sum(pool.map(begin, range(8))) == 1
    for i in range(6):
        log.create(f"r{i}", "s")
    with ThreadPoolExecutor(6) as pool:
        list(pool.map(lambda i: log.step(f"r{i}", "complete"), range(6)))
    assert spark.read.schema(runs.POINTER).json(f"{tmp_path}/log/latest").select("run_id").distinct().count() == 6
