"""Readers, writers and the registry as a stream, on small files."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from prismwell.operators import scheduling
from prismwell.sources import readers, writers
from prismwell.streaming import registry


def values(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_json_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1,\n "b": "x"}')
    (tmp_path / "b.json").write_text('[{"a": 1}, {"a": 2}]')
    (tmp_path / "c.json").write_text("{broken")
    assert values(readers.json_documents(spark, str(tmp_path / "a.json"), "a int, b string"), "a", "b") == [(1, "x")]
    assert readers.json_documents(spark, str(tmp_path), "a int", strict=False).count() == 1
    for bad in ("b.json", "c.json"):
        with pytest.raises(PySparkException):
            readers.json_documents(spark, str(tmp_path / bad), "a int").collect()
    assert values(readers.json_documents(spark, str(tmp_path / "none.json"), "a int", default=[(7,)]), "a") == [(7,)]


def test_prompts_of_all_kinds(spark, tmp_path):
    told = {
        "a.json": {"samples": [{"prompt": "one"}, "two", 3]}, "b.json": ["one", "two"], "c.json": {"prompt": "one"}, "d.json": {"samples": [], "prompts": ["one"]},
    }
    for name, doc in told.items():
        (tmp_path / name).write_text(json.dumps(doc))
    (tmp_path / "e.jsonl").write_text('{"prompt": "one"}\n\n"two"\n')
    (tmp_path / "f.txt").write_text("one\n  \n two \n")
    got = {p.name: [r["prompt"] for r in readers.prompts(spark, str(p)).collect()] for p in tmp_path.iterdir()}
    assert got == {"a.json": ["one", "two", "3"], "b.json": ["one", "two"], "c.json": ["one"], "d.json": ["one"], "e.jsonl": ["one", "two"], "f.txt": ["one", "two"]}


def test_folders_listings_and_splits(spark, tmp_path):
    for k in ("x", "y"):
        (tmp_path / "renders" / k).mkdir(parents=True)
        (tmp_path / "renders" / k / "metadata.json").write_text(json.dumps({"n": len(k)}))
    assert values(readers.object_documents(spark, str(tmp_path / "renders"), "n int"), "obj_id", "n") == [("x", 1), ("y", 1)]
    listing = readers.file_listing(spark, str(tmp_path), ["*.json", "meta*"], digest=True)
    assert listing.count() == 2 and listing.where(F.length("sha256") == 64).count() == 2
    (tmp_path / "pairs").mkdir()
    (tmp_path / "pairs" / "train_pairs.jsonl").write_text('{"id": 1}\n\n{"id": 2}\n')
    assert values(readers.split_pairs(spark, str(tmp_path), "all", "id int"), "id") == [(1,), (2,)]
    with pytest.raises(ValueError):
        readers.split_pairs(spark, str(tmp_path), "dev", "id int")
    np.save(tmp_path / "d1.npy", np.arange(4.0).reshape(2, 2))
    np.save(tmp_path / "d2.npy", np.array([9.0]))
    assert [d for _, _, d in values(readers.depth_values(spark, str(tmp_path)), "file", "i", "depth")] == [0.0, 1.0, 2.0, 3.0, 9.0]


def test_devices_actions_and_seeds(spark, tmp_path):
    lines = spark.createDataFrame([("0, A100, P0, 100, 81920, 5 ",), ("1, A100, 7 MiB, 81920 MiB, 99 %, P8",), ("header, none",)], "value string")
    assert values(readers.device_inventory(lines), "device", "used_mib", "total_mib", "utilization") == [(0, 100, 81920, 5), (1, 7, 81920, 99)]
    (tmp_path / "space.json").write_text(json.dumps({"groups": {"g": {"actions": {"UP": {"target": "t", "delta_type": "add", "delta": 0.5, "bounds": [0, 2]}}}}}))
    assert values(readers.action_space(spark, str(tmp_path / "space.json")), "grp", "action", "target", "delta", "lo", "hi") == [("g", "UP", "t", 0.5, 0.0, 2.0)]
    rows = lambda *r: spark.createDataFrame(list(r), "id string, name string, category string")
    assert values(readers.seed_concepts(rows(("a", " x ", None), ("b", "y", "c"))), "id", "name", "category") == [("a", "x", "unknown"), ("b", "y", "c")]
    for bad in ([("a", "x", None), ("a", "y", None)], [("", "x", None)]):
        with pytest.raises(ValueError):
            readers.seed_concepts(rows(*bad))
    assert values(readers.overlaid(rows(("a", None, "c")), {"name": "n", "size": 3}), "id", "name", "size") == [("a", "n", 3)]
    spec = lambda s: spark.createDataFrame([(s,)], "s string").select(scheduling.expand_spec(F.col("s"), F.lit(8))[0].alias("n"))
    assert spec("0-2,5").first()["n"] == [0, 1, 2, 5]
    with pytest.raises(PySparkException):
        spec("6-2").collect()


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b\nc"), (2, None)], "k int, t string").coalesce(1)
    assert writers.write_csv(df, str(tmp_path / "csv"), ["t", "k"]) and not writers.write_csv(df.limit(0), str(tmp_path / "none"), ["k"])
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["t", "k"] and not (tmp_path / "none").exists()
    writers.write_json_lines(df, str(tmp_path / "jsonl"))
    assert values(spark.read.json(str(tmp_path / "jsonl")), "k", "t") == values(df, "k", "t")
    assert [json.loads(r["value"]) for r in writers.document(df).collect()] == [{"k": 1, "t": "a|b\nc"}, {"k": 2}]
    assert [r["value"] for r in writers.markdown_rows(df).collect()] == ["| 1 | a\\|b c |", "| 2 |  |"]


def test_registry_stream_equals_the_fold(spark, tmp_path):
    """Events in order over several micro-batches give what the fold over the whole table gives."""
    rng = np.random.default_rng(4)
    rows = [(int(a), k, str(e)) for k, (a, e) in enumerate(zip(rng.integers(0, 6, 200), rng.choice(["deprecate", "promote", "fail"], 200), strict=True))]
    schema = "asset_id long, seq long, event string"
    for k in range(4):
        spark.createDataFrame(rows[50 * k : 50 * k + 50], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in" / f"b{k}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).json(str(tmp_path / "in"))
    query = registry.registry(source).writeStream.outputMode("update").format("memory").queryName("registry_states").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    last = {r["asset_id"]: (r["status"], r["attempts"], r["jobs"]) for r in spark.table("registry_states").collect()}
    want = {r["asset_id"]: (r["status"], r["attempts"], r["jobs"]) for r in registry.registry_batch(spark.createDataFrame(rows, schema)).collect()}
    assert last == want


