"""Stateful operators on streams, keyed by mission.

Each operator is a small step function `(state, rows) -> (state, output rows)`; one processor runs
it with the state in a value state. States are bounded: the waiting pings of one queue, two
altitude locks, the poses of some seconds, or the row numbers of one image. Rows of a micro-batch
are taken in stamp order.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fathomgrid.config import Alignment, Pairing, Seabed, Tracking
from fathomgrid.functions.geodesy import EARTH_RADIUS_M
from fathomgrid.operators.ordered import MISSION
from fathomgrid.operators.sequential import lock_altitude

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
Step = Callable[[dict, pd.DataFrame], tuple[dict, pd.DataFrame]]


def use_rocksdb(spark) -> None:
    """State store these operators need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class KeyedStep(StatefulProcessor):
    """Runs a step function per key, its state kept as JSON; with `idle_ms`, an idle key gets one
    call of `on_idle`."""

    def __init__(self, step: Step, keys: Sequence[str], order: Sequence[str], on_idle: Step | None = None, idle_ms: int = 0):
        self.step, self.keys, self.order = step, list(keys), list(order)
        self.on_idle, self.idle_ms = on_idle, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", T.StructType([T.StructField("json", T.StringType())]))

    def _run(self, step: Step, key, rows: pd.DataFrame) -> pd.DataFrame:
        state = json.loads(self.state.get()[0]) if self.state.exists() else {}
        state, out = step(state, rows)
        self.state.update((json.dumps(state),))
        for name, value in zip(self.keys, key):
            out.insert(0, name, value)
        return out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        table = pd.concat(list(rows), ignore_index=True).sort_values(self.order, kind="stable")
        if self.idle_ms:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield self._run(self.step, key, table)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.on_idle is not None:
            yield self._run(self.on_idle, key, pd.DataFrame())

    def close(self) -> None:
        pass


def _apply(df: DataFrame, step: Step, columns: str, keys: Sequence[str], order: Sequence[str],
           on_idle: Step | None = None, idle_ms: int = 0) -> DataFrame:
    # the processor puts the keys in front, in reverse order of insertion
    schema = T.StructType([T.StructField(k, df.schema[k].dataType) for k in reversed(list(keys))] + list(T.StructType.fromDDL(columns)))
    return df.groupBy(*keys).transformWithStateInPandas(
        KeyedStep(step, keys, order, on_idle, idle_ms), schema, "Append", "ProcessingTime" if idle_ms else "None")


def dedupe(messages: DataFrame, delay: str, event_time: str = "ts",
           keys: Sequence[str] = ("mission_id", "side", "ping_number")) -> DataFrame:
    """At-least-once input to once per ping; rows later than the delay are dropped."""
    return messages.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keys))


def pair_pings(df: DataFrame, params: Pairing = Pairing(), *, keys: Sequence[str] = MISSION) -> DataFrame:
    """Streaming form of `sequential.pair_pings` (side, stamp_ns, seq).

    A waiting ping is given up only when the other side, which comes in order, has passed it by more
    than the tolerance: nothing that the batch form would pair is lost.
    """
    tol = params.tolerance_ns

    def step(state: dict, rows: pd.DataFrame):
        queues = [state.get("port", []), state.get("stbd", [])]
        for side, stamp, seq in zip(rows["side"], rows["stamp_ns"], rows["seq"]):
            queues[side != "port"].append((int(stamp), int(seq)))
        i = j = 0
        port, stbd = queues
        found = []
        while i < len(port) and j < len(stbd):
            gap = port[i][0] - stbd[j][0]
            if abs(gap) <= tol:
                found.append((port[i][1], stbd[j][1], port[i][0], stbd[j][0]))
                i, j = i + 1, j + 1
            elif gap > 0:
                j += 1
            else:
                i += 1
        seen = [max([s for s in (state.get(f"{side}_seen"), *(e[0] for e in q[-1:])) if s is not None], default=None) for side, q in (("port", port), ("stbd", stbd))]
        waiting = [[e for e in q[at:] if other is None or e[0] >= other - tol] for q, at, other in ((port, i, seen[1]), (stbd, j, seen[0]))]
        return {"port": waiting[0], "stbd": waiting[1], "port_seen": seen[0], "stbd_seen": seen[1]}, pd.DataFrame(found, columns=["port_seq", "stbd_seq", "port_ns", "stbd_ns"])

    return _apply(df.select(*keys, "side", "stamp_ns", "seq"), step,
                  "port_seq long, stbd_seq long, port_ns long, stbd_ns long", keys, ("stamp_ns", "seq"))


def snap_poses(pairs: DataFrame, poses: DataFrame, params: Pairing = Pairing(), *, keys: Sequence[str] = MISSION) -> DataFrame:
    """Nearest pose of each pair among the poses of the last seconds that have arrived (earliest
    arrival on ties); pairs without one are dropped."""
    none = F.lit(None)
    both = pairs.select(*keys, F.col("port_ns").alias("stamp_ns"), "port_seq", "stbd_seq", F.lit(1).alias("is_pair"),
                        *[none.cast("double").alias(c) for c in ("x", "y", "yaw")]).unionByName(
        poses.select(*keys, "stamp_ns", none.cast("long").alias("port_seq"), none.cast("long").alias("stbd_seq"),
                     F.lit(0).alias("is_pair"), "x", "y", "yaw"))

    def step(state: dict, rows: pd.DataFrame):
        buffer, out = state.get("poses", []), []
        for ns, p, s, is_pair, *pose in zip(*[rows[c] for c in ("stamp_ns", "port_seq", "stbd_seq", "is_pair", "x", "y", "yaw")]):
            if not is_pair:
                buffer.append([int(ns), *map(float, pose)])
                buffer = [b for b in buffer if b[0] >= int(ns) - params.pose_buffer_ns]
            elif buffer:
                best = min(buffer, key=lambda b: abs(b[0] - int(ns)))
                out.append((int(p), int(s), int(ns), *best[1:]))
        return {"poses": buffer}, pd.DataFrame(out, columns=["port_seq", "stbd_seq", "port_ns", "x", "y", "yaw"])

    return _apply(both, step, "port_seq long, stbd_seq long, port_ns long, x double, y double, yaw double", keys,
                  ("stamp_ns", "is_pair"))


def track_altitude(df: DataFrame, params: Tracking = Tracking(), *, keys: Sequence[str] = MISSION) -> DataFrame:
    """Streaming form of `sequential.track_altitude` and `fuse_altitude` (seq, port_fbr, stbd_fbr)."""

    def step(state: dict, rows: pd.DataFrame):
        sides = {}
        for side in ("port", "stbd"):
            kept = [float("nan") if x is None else x for x in state.get(side, [])]
            sides[side] = lock_altitude(rows[f"{side}_fbr"].to_numpy(np.float64, na_value=np.nan), params, kept)
        highest = pd.Series(np.fmax(*[altitude for altitude, _ in sides.values()]))
        if state.get("held") is not None:
            highest = pd.concat([pd.Series([state["held"]]), highest])
        held = highest.ffill().tail(len(rows)).to_numpy()
        frame = pd.DataFrame({"seq": rows["seq"].to_numpy()})
        for name, values in (("port_alt", sides["port"][0]), ("stbd_alt", sides["stbd"][0]), ("altitude", held)):
            frame[name] = pd.array(np.ma.masked_invalid(values).tolist(), "Float64")
        last = held[-1] if len(held) else np.nan
        ends = {side: [None if x != x else x for x in exit_] for side, (_, exit_) in sides.items()}
        return ends | {"held": None if last != last else float(last)}, frame

    return _apply(df.select(*keys, "seq", "port_fbr", "stbd_fbr"), step,
                  "seq long, port_alt double, stbd_alt double, altitude double", keys, ("seq",))


def throttle(df: DataFrame, interval_ns: int = Alignment().state_period_ns, *, keys: Sequence[str] = MISSION) -> DataFrame:
    """Streaming form of `sequential.throttle` (seq, stamp_ns)."""

    def step(state: dict, rows: pd.DataFrame):
        last, kept = state.get("last"), []
        for seq, ns in zip(rows["seq"], rows["stamp_ns"]):
            if last is None or int(ns) - last >= interval_ns:
                last = int(ns)
                kept.append((int(seq), last))
        return {"last": last}, pd.DataFrame(kept, columns=["seq", "stamp_ns"], dtype=np.int64)

    return _apply(df.select(*keys, "seq", "stamp_ns"), step, "seq long, stamp_ns long", keys, ("stamp_ns", "seq"))


def image_members(df: DataFrame, params: Seabed = Seabed(), *, flush_after_ms: int = 0, keys: Sequence[str] = MISSION) -> DataFrame:
    """Streaming form of `imaging.image_members` on usable pings (t, seq): image_id, row_no, seq.

    Images come out as they fill. The truncated last one comes out when the mission has been
    silent for `flush_after_ms`, or at a row whose `end` is true (which is not a ping).
    """
    has_end = "end" in df.columns
    names = ["image_id", "row_no", "seq"]

    def image(state: dict, seqs: list, end: int, size: int) -> list:
        """Rows of the image of `size` pings that ends at ping number `end`; `seqs` are the newest up to number `n`."""
        stop = len(seqs) - (state["n"] - end)
        state["images"], state["last_end"] = state["images"] + 1, end
        return [(state["images"] - 1, k, seq) for k, seq in enumerate(seqs[stop - size:stop])]

    def full(state: dict, new: list) -> list:
        """Images that fill while the pings `new` arrive: their ends are `stride` apart, the first where the window is full."""
        seqs, out = state["rows"] + new, []
        state["n"] += len(new)
        for end in range(max(state["last_end"] + params.stride, params.rows), state["n"] + 1, params.stride):
            out += image(state, seqs, end, params.rows)
        state["rows"] = seqs[-params.rows:]
        return out

    def tail(state: dict) -> list:
        """What has come since the last image; all there is when there was none."""
        size = min(state["n"] - state["last_end"], len(state["rows"]))
        out = image(state, state["rows"], state["n"], size) if size >= 2 else []
        state["last_end"] = state["n"]
        return out

    def start(state: dict) -> dict:
        return state or {"rows": [], "n": 0, "last_end": 0, "images": 0}

    def step(state: dict, rows: pd.DataFrame):
        state, out = start(state), []
        seqs = rows["seq"].to_numpy()
        stops = np.flatnonzero(rows["end"].to_numpy(bool)) if has_end else np.zeros(0, int)
        for part in np.split(np.arange(len(seqs)), stops):
            if len(part) and len(stops) and part[0] in stops:
                out += tail(state)
                part = part[1:]
            out += full(state, seqs[part].tolist())
        return state, pd.DataFrame(out, columns=names, dtype=np.int64)

    def on_idle(state: dict, _rows: pd.DataFrame):
        state = start(state)
        return state, pd.DataFrame(tail(state), columns=names, dtype=np.int64)

    narrow = df.select(*keys, "t", "seq", *(["end"] if has_end else []))
    return _apply(narrow, step, "image_id long, row_no long, seq long", keys, ("t", "seq"), on_idle, flush_after_ms)


def robot_states(df: DataFrame, params: Alignment = Alignment(), *, keys: Sequence[str] = MISSION) -> DataFrame:
    """Live boat states from stacked telemetry (kind, t, seq, x, y, yaw, speed, lat, lon, compass_deg).

    The rule of the batch form: every row is looked at with the latest of each kind known by then. Odometry rows count unless
    they sit at the origin while the fixes have moved; fixes count, with dead-reckoned positions, while odometry has been
    silent for `odom_dead_s` or sits at the origin. Of the rows that count, at most one in 200 ms is a state. Event time throughout.
    """
    period = params.state_period_ns / 1e9

    def step(state: dict, rows: pd.DataFrame):
        t, x, y, yaw, speed, lat, lon, compass = (pd.to_numeric(rows[c]).to_numpy(float) for c in ("t", "x", "y", "yaw", "speed", "lat", "lon", "compass_deg"))
        kind = rows["kind"].to_numpy()
        fix, odom = kind == "gps", ~np.isin(kind, ("gps", "compass", "vfr"))
        if fix.any():
            state.setdefault("ref", [float(lat[fix][0]), float(lon[fix][0])])
        ref = np.radians(state.get("ref", [0.0, 0.0]))
        east, north = (np.radians(lon) - ref[1]) * EARTH_RADIUS_M * np.cos(ref[0]), (np.radians(lat) - ref[0]) * EARTH_RADIUS_M
        seconds = np.diff(np.r_[state.get("fix_t", np.nan), t[fix]])
        metres = np.hypot(*(np.diff(np.r_[state.get(name, np.nan), v[fix]]) for name, v in (("east", east), ("north", north))))
        reckoned = np.zeros(len(t))
        reckoned[fix] = np.divide(metres, seconds, out=np.zeros(len(metres)), where=seconds > 1e-3)

        def known(name: str, values: np.ndarray, where: np.ndarray) -> np.ndarray:
            """The latest value at or before each row, from earlier batches too."""
            latest = pd.Series(np.where(where, values, np.nan)).ffill().fillna(state.get(name, np.nan)).to_numpy()
            state[name] = float(latest[-1])
            return latest

        heading = known("heading", compass % 360.0, (kind == "compass") & np.isfinite(compass))
        measured = known("speed", speed, (kind == "vfr") & np.isfinite(speed))
        known("fix_t", t, fix)
        at_lat, at_lon, at_east, at_north = (known(n, v, fix) for n, v in (("lat", lat), ("lon", lon), ("east", east), ("north", north)))
        odom_t, odom_x, odom_y = (known(n, v, odom) for n, v in (("odom_t", t), ("odom_x", x), ("odom_y", y)))
        stuck = (np.maximum(np.abs(odom_x), np.abs(odom_y)) < params.frozen_eps_m) & (np.hypot(at_east, at_north) > params.moved_min_m)
        silent = ~(t - odom_t <= params.odom_dead_s)

        kept = []
        for i in np.flatnonzero(np.where(odom, ~stuck, fix & (silent | stuck))):
            if not t[i] - state.get("emitted", -np.inf) < period:
                state["emitted"] = float(t[i])
                kept.append(i)
        turned = np.where(fix, np.nan_to_num(np.radians(90.0 - heading)), yaw)
        frame = pd.DataFrame({
            "seq": rows["seq"].to_numpy(np.int64), "t": t, "x": np.where(fix, at_east, x), "y": np.where(fix, at_north, y), "yaw": turned,
            "lat": pd.array(at_lat, "Float64"), "lon": pd.array(at_lon, "Float64"),
            "heading_deg": np.where(np.isnan(heading), (90.0 - np.degrees(turned)) % 360.0, heading),
            "speed_mps": np.where(np.isnan(measured), np.where(fix, reckoned, speed), measured), "source": np.where(fix, "gps", "odom")})
        return state, frame.iloc[kept]

    columns = ["kind", "t", "seq", "x", "y", "yaw", "speed", "lat", "lon", "compass_deg"]
    return _apply(df.select(*keys, *columns), step, "seq long, t double, x double, y double, yaw double, lat double, lon double, "
                  "heading_deg double, speed_mps double, source string", keys, ("t", "seq"))
