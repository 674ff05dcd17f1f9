"""Structures followed from frame to frame as frames arrive.

The state of a repeat is one frame of structures, as runs of rows, and the frames that came before those they follow.
A frame is linked as soon as the one before it is there; one that never comes is given up when the watermark has passed
the frames behind it. State lives in the state store of the query and comes back from its checkpoint.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

#: nodes: structures as JSON, [{"node": .., "shift": .., "runs": [{"j": .., "first": .., "last": ..}, ..]}, ..].
FRAMES = "repeat_id int, frame_id long, time timestamp, nodes string"
#: seen: the last frame that had its turn; frame_id and nodes: the last one with structures; waiting: frames to come.
STATE = "seen long, frame_id long, nodes string, waiting string"
EVENTS = "repeat_id int, frame_from long, frame_to long, node_from long, node_to long, event string, overlap double"


def packed(rows: DataFrame, time: str) -> DataFrame:
    """Runs (repeat_id, frame_id, node, shift, j, first, last, time) as one row a frame, as follow() takes them. time is
    the frame's."""
    nodes = rows.groupBy("repeat_id", "frame_id", "node", "shift").agg(F.max(time).alias("time"), F.collect_list(F.struct("j", "first", "last")).alias("runs"))
    return nodes.groupBy("repeat_id", "frame_id").agg(F.max("time").alias("time"), F.to_json(F.collect_list(F.struct("node", "shift", "runs"))).alias("nodes"))


def links(before: dict, after: dict, threshold: float, columns: int) -> list[tuple[int, int, float]]:
    """Pairs (node, node, overlap) of two frames' structures {node: (shift, [(j, first, last), ..])}."""
    here: dict[int, list[tuple[int, int, int]]] = {}
    size = {}
    for node, (_, runs) in after.items():
        size[node] = sum(last - first + 1 for _, first, last in runs)
        for j, first, last in runs:
            here.setdefault(j, []).append((first, last, node))
    found = []
    for node, (shift, runs) in before.items():
        shared: Counter = Counter()
        total = 0
        for j, first, last in runs:
            first, last = max(first + shift, 1), min(last + shift, columns)
            total += max(0, last - first + 1)
            for a, b, other in here.get(j, ()):
                common = min(last, b) - max(first, a) + 1
                if common > 0:
                    shared[other] += common
        found += [(node, other, n / min(total, size[other])) for other, n in shared.items() if n / min(total, size[other]) >= threshold]
    return sorted(found)


def frame_events(first: int, before: dict, second: int, after: dict, threshold: float, columns: int) -> list[tuple]:
    """Events (frame_from, frame_to, node_from, node_to, event, overlap) between a frame with structures and the next."""
    near = links(before, after, threshold, columns) if second == first + 1 else []
    out, into = Counter(a for a, _, _ in near), Counter(b for _, b, _ in near)
    told = [(first, second, a, b, "continuation" if out[a] == into[b] == 1 else "split" if out[a] > 1 else "merge", overlap) for a, b, overlap in near]
    told += [(first, first + 1, a, None, "death", None) for a in sorted(before) if a not in out]
    return told + [(second - 1, second, None, b, "birth", None) for b in sorted(after) if b not in into]


def structures(nodes: str | None) -> dict:
    """JSON of FRAMES as {node: (shift, runs)}."""
    return {n["node"]: (n.get("shift") or 0, [(r["j"], r["first"], r["last"]) for r in n["runs"]]) for n in json.loads(nodes or "[]")}


def follower(threshold: float, columns: int, first_frame: int | None):
    """What keeps one repeat's frames in order; see follow()."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, frame, nodes, held = state.get if state.exists else (None, None, None, "{}")
        queue = {int(f): tuple(v) for f, v in json.loads(held).items()}
        if not state.hasTimedOut:
            for batch in batches:
                for f, time, own in zip(batch["frame_id"], batch["time"], batch["nodes"]):
                    # what comes after its turn is too late
                    if seen is None or f > seen:
                        queue[int(f)] = (int(pd.Timestamp(time).timestamp() * 1000), own)
        passed = state.getCurrentWatermarkMs()
        given_up = max((f for f, (time, _) in queue.items() if time <= passed), default=None)
        told = []
        for f in sorted(queue):
            if f != (first_frame if seen is None else seen + 1) and (given_up is None or f > given_up):
                break
            after = structures(queue[f][1])
            if after:
                if frame is not None:
                    told += frame_events(frame, structures(nodes), f, after, threshold, columns)
                frame, nodes = f, queue[f][1]
            seen = f
            del queue[f]
        state.update((seen, frame, nodes, json.dumps(queue)))
        if queue:
            state.setTimeoutTimestamp(max(passed + 1, min(time for time, _ in queue.values())))
        table = pd.DataFrame(told, columns=["frame_from", "frame_to", "node_from", "node_to", "event", "overlap"])
        table.insert(0, "repeat_id", key[0])
        yield table.astype({c: "Int64" for c in ("frame_from", "frame_to", "node_from", "node_to")})

    return run


def follow(frames: DataFrame, late: str, columns: int, threshold: float = 0.2, first_frame: int | None = 1) -> DataFrame:
    """Events of a stream of frames (FRAMES), the same as tracking.link_frames gives for all of them at once: repeat_id,
    frame_from, frame_to, node_from, node_to, event, overlap.

    Frames may come in any order and over any number of batches. The events between two frames come out once all frames
    up to the second are there, or once the watermark (late behind the largest time seen) has passed the second; a
    frame that comes after its turn is dropped. Frames without structures may be left out of the stream if they need not
    be told at once. columns: of the view. first_frame: the frame that nothing comes before; None waits for the
    watermark.
    """
    keyed = frames.withWatermark("time", late).groupBy("repeat_id")
    return keyed.applyInPandasWithState(follower(threshold, columns, first_frame), EVENTS, STATE, "append", "EventTimeTimeout")
