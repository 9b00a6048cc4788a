"""Resource planning: device specs, reservations, failure classes, shards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: what makes a device busy
BUSY_MIB, BUSY_UTILIZATION = 60_000, 90


def expand_spec(spec: Column, total: Column) -> tuple[Column, Column]:
    """(included, excluded) device numbers of a list such as ``0-6,!5`` or ``all``."""
    tokens = F.filter(F.transform(F.split(spec, ","), lambda t: F.trim(t)), lambda t: F.length(t) > 0)
    negative = lambda t: t.rlike("^[!^]")

    def numbers(ts: Column) -> Column:
        def one(t: Column) -> Column:
            body = F.regexp_replace(t, "^[!^]", "")
            first = F.split_part(body, F.lit("-"), F.lit(1)).try_cast("int")
            last = F.coalesce(F.nullif(F.split_part(body, F.lit("-"), F.lit(2)), F.lit("")).try_cast("int"), first)
            reversed_ = F.raise_error(F.concat(F.lit("reversed range: "), body)).cast("array<int>")
            return F.when(body == "all", F.sequence(F.lit(0), total - 1)).when(last < first, reversed_).otherwise(F.sequence(first, last))

        return F.array_sort(F.array_distinct(F.flatten(F.transform(ts, one))))

    return numbers(F.filter(tokens, lambda t: ~negative(t))), numbers(F.filter(tokens, negative))


def reservation(index: Column, excluded: Column, reserved: Column, memory: Column, utilization: Column) -> Column:
    """Why a device is not to be used; null if it is free."""
    return (
        F.when(F.array_contains(excluded, index), "excluded")
        .when(F.array_contains(reserved, index), "reserved")
        .when(memory >= BUSY_MIB, "memory_busy")
        .when(utilization >= BUSY_UTILIZATION, "utilization_busy")
    )


def failure_class(log: Column) -> Column:
    """The class of a failed run by what its log says."""
    t = F.lower(log)
    has = lambda s: F.contains(t, F.lit(s))
    memory = has("cuda out of memory") | has("torch.outofmemoryerror")
    collective = has("nccl") & (has("all-gather") | has("all_gather") | has("invalid usage"))
    return (
        F.when(memory & (has("panogen") | has("autoencoder_kl_3d")), "hyworld_pano_oom")
        .when(memory, "cuda_oom")
        .when(has("blender: command not found"), "blender_missing")
        .when(has("worldmirror reconstruction has only 0 aligned frames"), "worldmirror_viewmap_mismatch")
        .when(collective, "nccl_collective_failure")
        .otherwise("unknown")
    )


# fixed values: what to do about each class of failure
ACTIONS = {
    "hyworld_pano_oom": (
        "Do not launch more same-resolution HY-Pano seed shards. Retry one shard after lowering height/width or using a lower-memory decode path, "
        "then fill idle GPUs with Blender, validation, or object insertion shards."
    ),
    "cuda_oom": "Release the GPU lease, lower memory pressure, and retry only after a fresh nvidia-smi check.",
    "blender_missing": "Resolve Blender from production profile or BLENDER_BIN before starting scene gates.",
    "worldmirror_viewmap_mismatch": "Rebuild scene gate with frame prefixes that match the actual pano_bank image names.",
    "nccl_collective_failure": "Do not increase nproc blindly. Use one process per GPU, set torchrun env cleanly, and fall back to the smallest stable shard before scaling.",
    "unknown": "Preserve logs as failure evidence and require manual classification before relaunch.",
}


def recommended_action(failure: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, failure), F.lit(ACTIONS["unknown"]))


def available(index: Column, free: Column, utilization: Column, least_free: Column, most_utilization: Column, excluded: Column, allocated: Column) -> Column:
    """Whether a device can take a job of these needs; ``excluded`` and ``allocated`` are arrays of indices."""
    return ~F.array_contains(excluded, index) & ~F.array_contains(allocated, index) & (free >= least_free) & (utilization <= most_utilization)


def shard_row(spec: Column) -> dict[str, Column]:
    """Fields of a shard's JSON under either of their names; ``error`` names what is wrong with it."""
    get = lambda *keys: F.coalesce(*[F.nullif(F.trim(F.get_json_object(spec, f"$.{k}")), F.lit("")) for k in keys])
    command = F.from_json(F.get_json_object(spec, "$.command"), "array<string>")
    env = F.get_json_object(spec, "$.env")
    error = F.when(F.coalesce(F.size(command), F.lit(0)) <= 0, "command").when(env.isNotNull() & ~F.startswith(F.trim(env), F.lit("{")), "env")
    return {"shard_id": get("id", "shard_id"), "profile": get("profile", "profile_name"), "priority": F.coalesce(get("priority").try_cast("int"), F.lit(100)), "command": command, "error": error}


def shell_quoted(words: Column) -> Column:
    """A command's words as one line that a POSIX shell reads back."""
    plain = lambda w: w.rlike(r"^[A-Za-z0-9_@%+=:,./-]+$")
    quoted = lambda w: F.concat(F.lit("'"), F.replace(w, F.lit("'"), F.lit("'\"'\"'")), F.lit("'"))
    return F.array_join(F.transform(words, lambda w: F.when(plain(w), w).otherwise(quoted(w))), " ")
