"""Assets with versions and jobs: the stream against the fold, stale jobs, early and late events, a restart."""

from __future__ import annotations

import os
import random
import time

import pytest

from prismwell.streaming import assets

KINDS = ("deprecate", "claim", "promote", "fail", "restart", "unknown")
#: Jobs start from now on, so that none is stale while a test runs.
START = int(time.time() * 1000)
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    yield spark
    spark.conf.set(key, before)


def write(spark, folder, name: str, rows: list[tuple]) -> None:
    spark.createDataFrame(rows, assets.EVENT).coalesce(1).write.json(str(folder / name))


def stream(spark, folder, checkpoint, table: str, **kw):
    events = spark.readStream.schema(assets.EVENT).option("maxFilesPerTrigger", 1).json(f"{folder}/*")
    keep = lambda df, _: df.write.mode("append").json(f"{checkpoint}-{table}")
    return assets.live_registry(events, **kw).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(checkpoint))


def rows_of(spark, table: str) -> list[dict]:
    return [r.asDict() for r in spark.read.schema(assets.ENTRY).json(table).collect()] if os.path.exists(table) else []


def wait_for(spark, table: str, what, seconds: float = 60) -> list[dict]:
    end = time.time() + seconds
    while time.time() < end:
        got = rows_of(spark, table)
        if any(map(what, got)):
            return got
        time.sleep(0.3)
    raise AssertionError(f"not seen: {got}")


def consume(query, n: int, seconds: float = 120) -> None:
    """Let the stream run until it has read ``n`` rows, then stop it; with timers set it would run on by itself."""
    end = time.time() + seconds
    while sum(p["numInputRows"] for p in query.recentProgress) < n:
        assert time.time() < end and query.exception() is None
        time.sleep(0.2)
    query.stop()


def events_of(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    return [(k, i + 1, rng.choice(KINDS), rng.choice([None, None, 1, 2]), "r", rng.random() < 0.2, START + i * 4_000_000) for k in range(8) for i in range(rng.randint(1, n))]


def test_the_stream_equals_the_fold_whatever_the_order_of_arrival(rocks, tmp_path):
    """Events are dealt to three files without regard to their numbers; some come twice."""
    told = events_of(1, 25)
    mixed = [*told, *told[::7]]
    random.Random(2).shuffle(mixed)
    for i in range(3):
        write(rocks, tmp_path / "in", str(i), mixed[i::3])
    consume(stream(rocks, tmp_path / "in", tmp_path / "c", "asset_order").start(), len(mixed))
    last: dict[int, dict] = {}
    for r in rows_of(rocks, f"{tmp_path}/c-asset_order"):
        if r["seq"] >= last.get(r["asset_id"], {"seq": -1})["seq"]:
            last[r["asset_id"]] = {k: v for k, v in r.items() if k != "note"}
    want = {r["asset_id"]: {k: v for k, v in r.asDict().items() if k != "note"} for r in assets.folded_registry(rocks.createDataFrame(told, assets.EVENT)).collect()}
    assert last == want
    assert any(r["note"].startswith("late:") for r in rows_of(rocks, f"{tmp_path}/c-asset_order"))


def test_a_stale_job_is_queued_again_also_after_a_restart(rocks, tmp_path):
    now = int(time.time() * 1000) - 5000  # half a minute is over while the stream is down, or soon after
    write(rocks, tmp_path / "in", "a", [(1, 1, "deprecate", None, "r", False, now), (1, 2, "claim", None, "r", False, now), (2, 1, "deprecate", None, "r", False, now)])
    consume(stream(rocks, tmp_path / "in", tmp_path / "c", "asset_before", stale=30).start(), 3)
    assert {r["asset_id"]: r["job_status"] for r in rows_of(rocks, f"{tmp_path}/c-asset_before")} == {1: "running", 2: "queued"}
    again = stream(rocks, tmp_path / "in", tmp_path / "c", "asset_after", stale=30).trigger(processingTime="1 second").start()
    try:
        write(rocks, tmp_path / "in", "b", [(3, 1, "deprecate", None, "r", False, now)])
        got = wait_for(rocks, f"{tmp_path}/c-asset_after", lambda r: r["note"] == "stale:1")
        assert [(r["asset_id"], r["job_status"], r["job_attempt"]) for r in got if r["note"] == "stale:1"] == [(1, "queued", 1)]
        write(rocks, tmp_path / "in", "c", [(1, 3, "claim", None, "r", False, now + 10_000_000), (1, 4, "promote", 1, "r", False, now + 10_000_001)])
        got = wait_for(rocks, f"{tmp_path}/c-asset_after", lambda r: r["seq"] == 4)
        done = next(r for r in got if r["seq"] == 4)
        assert (done["status"], done["active_version"], done["versions"], done["job_status"]) == ("active", "attempt_01", "attempt_00:deprecated,attempt_01:active", "completed")
    finally:
        again.stop()


def test_a_gap_is_waited_for_and_given_up(rocks, tmp_path):
    write(rocks, tmp_path / "in", "a", [(1, 1, "deprecate", None, "r", False, 0), (1, 4, "promote", 1, "r", False, 3), (1, 5, "deprecate", None, "r", False, 4)])
    q = stream(rocks, tmp_path / "in", tmp_path / "c", "asset_gap", patience=2).trigger(processingTime="1 second").start()
    try:
        wait_for(rocks, f"{tmp_path}/c-asset_gap", lambda r: r["seq"] == 1 and r["note"] == "waiting:2")
        time.sleep(2)
        write(rocks, tmp_path / "in", "b", [(2, 1, "deprecate", None, "r", False, 0)])
        got = wait_for(rocks, f"{tmp_path}/c-asset_gap", lambda r: r["note"] == "gap")
        assert [(r["seq"], r["status"], r["active_version"]) for r in got if r["note"] == "gap"] == [(5, "deprecated_pending_replacement", "attempt_01")]
        write(rocks, tmp_path / "in", "c", [(1, 2, "claim", None, "r", False, 1)])
        wait_for(rocks, f"{tmp_path}/c-asset_gap", lambda r: r["note"] == "late:2" and r["seq"] == 5)
    finally:
        q.stop()


def entry(spark, *told: tuple, now: int | None = None) -> dict:
    rows = [(1, i + 1, *t, *[None, "r", False, i][len(t) - 1 :]) for i, t in enumerate(told)]
    return assets.folded_registry(spark.createDataFrame(rows, assets.EVENT), now).first().asDict()


def test_versions_and_attempts(spark):
    e = entry(spark, ("deprecate",), ("deprecate",), ("claim",))
    assert (e["status"], e["job_attempt"], e["job_status"], e["attempts_used"]) == ("deprecated_pending_replacement", 1, "running", 0)
    e = entry(spark, ("deprecate",), ("claim",), ("fail",), ("deprecate",), ("promote",), ("deprecate",))
    assert (e["status"], e["attempts_used"], e["versions"]) == ("manual_reprompt_required", 2, "attempt_00:deprecated,attempt_01:replacement_failed,attempt_02:replacement_failed")
    e = entry(spark, ("deprecate",), ("fail", None, "r", True))
    assert e["status"] == "manual_reprompt_required"
    e = entry(spark, ("restart",), ("promote",), ("restart",), ("promote",))
    assert (e["restarts"], e["active_version"]) == (0, "attempt_01")


def test_a_stale_job_in_the_fold(spark):
    told = [("deprecate",), ("claim", None, "r", False, 1000)]
    assert entry(spark, *told, now=1000 + 7_199_999)["job_status"] == "running"
    assert entry(spark, *told, now=1000 + 7_200_000)["job_status"] == "queued"
    assert entry(spark, ("deprecate",), ("claim", None, "r", False, None), now=0)["job_status"] == "queued"


def test_an_empty_table_and_nulls(spark):
    none = spark.createDataFrame([], assets.EVENT)
    assert assets.folded_registry(none).count() == 0
    odd = spark.createDataFrame([(None, 1, "deprecate", None, None, None, None), (1, None, "deprecate", None, None, None, None), (2, 1, None, None, None, None, None)], assets.EVENT)
    assert [(r["asset_id"], r["status"]) for r in assets.folded_registry(odd).collect()] == [(2, "active")]
