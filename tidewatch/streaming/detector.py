"""The detector on a stream, from flows to the response.

live.windows_query closes windows and writes a row each; ``detected`` takes these rows, in one keyed operator with state
(transformWithStateInPandas), through baselines, accumulators, rules, the sliding score, the top anomaly and the response, and gives what the batch
gives.  ``start`` starts both.

State of a stream, in the state store: `head`, the detector after its latest window; `recent`, the rows of its last `replay`
windows by number; and `base`, the detector before the oldest of these.  A row of a window that was already seen (late flows reopened it, or a
batch was written again) replaces the old one, the windows from it on are scanned again from `base`, and come out again with a
higher revision; the last revision of a window is its result.  So whatever order flows come in, the results end as the batch's.  A row older than
`replay` windows changes nothing and comes out with `too_late`.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import UTC, datetime
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewatch.config import FEATURES, RULES, Settings
from tidewatch.operators import rules
from tidewatch.operators.mitigate import Responder
from tidewatch.operators.scan import seed_of
from tidewatch.streaming import live

#: Windows that a late row may reopen.
REPLAY = 720
RESULT = "stream_id string, wid long, revision long, score double, boosted boolean, current_tier int, top_anomaly string, n_events int, too_late boolean"
_SHIFT, _ENTROPY = FEATURES.index("geo_distribution_shift_rate"), FEATURES.index("geographic_entropy")


class Online:
    """One stream's detector: a window's row in, its result out; to_json and of_json keep it between."""

    def __init__(self, s: Settings, seed_windows: int, calendar: bool = False):
        self.s, self.seed_windows, self.calendar = s, seed_windows, calendar
        self.last, self.seen, self.entropy, self.rate = None, 0, 0.0, s.rate_start
        self.seeds: list[list[float]] = []
        self.contexts: dict[str, list] = {}
        self.overall: list | None = None
        self.level = np.zeros(len(FEATURES))
        self.events: list[list] = []
        self.machine = Responder(s)

    def to_json(self) -> str:
        plain = lambda b: b and [b[0].tolist(), b[1].tolist(), b[2]]
        m = self.machine
        kept = {"contexts": {k: plain(b) for k, b in self.contexts.items()}, "overall": plain(self.overall), "level": self.level.tolist(), "machine": [m.tier, m.since1, m.calm3, m.calm]}
        return json.dumps(kept | {k: getattr(self, k) for k in ("last", "seen", "entropy", "rate", "seeds", "events")})

    @classmethod
    def of_json(cls, text: str | None, *args) -> Online:
        out = cls(*args)
        if text:
            kept = json.loads(text)
            arrays = lambda b: b and [np.array(b[0]), np.array(b[1]), b[2]]
            out.contexts, out.overall, out.level = {k: arrays(b) for k, b in kept["contexts"].items()}, arrays(kept["overall"]), np.array(kept["level"])
            out.machine.tier, out.machine.since1, out.machine.calm3, out.machine.calm = kept["machine"]
            for k in ("last", "seen", "entropy", "rate", "seeds", "events"):
                setattr(out, k, kept[k])
        return out

    def _context(self, wid: int) -> str:
        """Hour and weekday (Monday 0) of the window's beginning; without a calendar always the same."""
        if not self.calendar:
            return "12,0"
        t = datetime.fromtimestamp(wid * self.s.dt, UTC)
        return f"{t.hour},{t.weekday()}"

    def _get(self, context: str) -> tuple[np.ndarray, np.ndarray]:
        if context in self.contexts:
            return tuple(self.contexts[context][:2])
        if self.overall is not None and self.overall[2] > 0:
            return tuple(self.overall[:2])
        return np.zeros(len(FEATURES)), np.ones(len(FEATURES))

    def _update(self, x: np.ndarray, context: str) -> None:
        a = self.s.alpha
        if context in self.contexts:
            mean, var, n = self.contexts[context]
            mean = a * x + (1 - a) * mean
            var = a * (x - mean) ** 2 + (1 - a) * var
        else:
            mean, var, n = x.copy(), np.zeros(len(x)), 0
        self.contexts[context] = [mean, var, n + 1]
        if self.overall is None:
            self.overall = [mean, var, 0]
        else:
            m, v, k = self.overall
            self.overall = [a * mean + (1 - a) * m, a * var + (1 - a) * v, k + 1]

    def _spiked(self, row: dict) -> bool:
        s = self.s
        over = next((r for r in row["rates"] if r > s.rate_multiplier * self.rate), None)
        self.rate = s.rate_smoothing * (row["mean_rate"] if over is None else over) + (1 - s.rate_smoothing) * self.rate
        return over is not None

    def _matched(self, ids: tuple[str, ...]) -> int:
        """How many of a template's ids first appear in its order."""
        at, n = (float("-inf"), 0), 0
        for name in ids:
            first = min(((e[0], e[1]) for e in self.events if e[2] == name), default=None)
            if first is None or first <= at:
                break
            at, n = first, n + 1
        return n

    def step(self, row: dict) -> tuple | None:
        """(score, boosted, tier, top anomaly, events) of the next window; None while the baseline is seeded."""
        s, wid = self.s, row["wid"]
        x = np.array(row["features"], float)
        x[_SHIFT] = abs(x[_ENTROPY] - self.entropy)
        self.entropy, self.last, self.seen = float(x[_ENTROPY]), wid, self.seen + 1
        spike = self._spiked(row)
        context = self._context(wid)
        if self.seen <= self.seed_windows:
            self.seeds.append(x.tolist())
            return None
        if self.seeds:
            stats = [seed_of(np.ascontiguousarray(column)) for column in np.array(self.seeds).T]
            seed = [np.array([t[0] for t in stats]), np.array([t[1] for t in stats]), stats[0][2]]
            self.contexts, self.overall, self.seeds = {context: seed}, list(seed), []
        mean, var = self._get(context)
        z = (x - mean) / np.maximum(np.sqrt(np.maximum(var, 0.0)), s.epsilon)
        self._update(x, context)
        over = np.abs(z) > s.tau_z
        self.level = np.where(over, self.level + (np.abs(z) - s.tau_z), self.level * s.decay)
        now = [(FEATURES[k], k, min(abs(float(z[k])) / 5.0, 1.0)) for k in np.flatnonzero(self.level > s.theta).tolist()]
        fired = dict(zip(RULES, row["fired"], strict=True)) | {"per_source_request_spike": spike}
        fired["user_agent_homogeneity"] &= not spike
        first = next((name for name in RULES if fired[name]), None)
        now += [(name, len(FEATURES) + k, 1.0) for k, name in enumerate(RULES) if fired[name]]
        ring = [e for e in self.events if e[0] * s.dt >= wid * s.dt - s.window]
        self.events = ring + [[wid, place, name, s.weights.get(name, s.default_weight) * sure] for name, place, sure in now]
        raw = min(round(sum(e[3] for e in self.events), 12), 1.0)
        boosted = any(self._matched(ids) >= least for ids, least in s.templates)
        score = min(raw + s.boost, 1.0) if boosted else raw
        best = max((k for k in range(len(FEATURES)) if self.level[k] > 0), key=lambda k: (round(float(self.level[k]), 6), -k), default=None)
        return score, boosted, self.machine.step(wid * s.dt, score), first or (None if best is None else FEATURES[best]), len(now)


class Detect(StatefulProcessor):
    """Online with replay, for rows (wid, batch, features, rates, mean_rate, fired) of a stream."""

    def __init__(self, s: Settings, seed_windows: int, calendar: bool, replay: int):
        self.args, self.replay = (s, seed_windows, calendar), replay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "state string")
        self.base = handle.getValueState("base", "state string")
        self.recent = handle.getMapState("recent", "wid long", "row string")

    def _load(self, state) -> Online:
        return Online.of_json(state.get()[0] if state.exists() else None, *self.args)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        head, base, out = self._load(self.head), self._load(self.base), []
        again, revision, changed = None, 0, False
        stream = key[0]
        frame = pd.concat(list(rows)).sort_values(["wid", "batch"]).drop_duplicates("wid", keep="last")
        for r in frame.to_dict("records"):
            wid, revision = int(r["wid"]), max(revision, int(r["batch"]))
            if base.last is not None and wid <= base.last:
                out.append((stream, wid, int(r["batch"]), None, None, None, None, None, True))
                continue
            row = {"wid": wid, "features": [float(v) for v in r["features"]], "rates": [float(v) for v in r["rates"]], "mean_rate": float(r["mean_rate"]), "fired": [bool(v) for v in r["fired"]]}
            text = json.dumps(row)
            if head.last is not None and wid <= head.last:
                if self.recent.containsKey((wid,)) and self.recent.getValue((wid,))[0] == text:
                    continue  # written again without a change
                again = wid if again is None else min(again, wid)
            elif again is None:
                found = head.step(row)
                if found is not None:
                    out.append((stream, wid, int(r["batch"]), *found, False))
            self.recent.updateValue((wid,), (text,))
            changed = True
        if again is not None:
            head, out = Online.of_json(base.to_json(), *self.args), [o for o in out if o[8]]
            for (wid,), (text,) in sorted(self.recent.iterator()):
                found = head.step(json.loads(text))
                if found is not None and wid >= again:
                    out.append((stream, wid, revision, *found, False))
        if changed:
            over = sorted(w for (w,) in self.recent.keys())[: -self.replay or None]  # noqa: SIM118  a state, no dict
            for wid in over:
                base.step(json.loads(self.recent.getValue((wid,))[0]))
                self.recent.removeKey((wid,))
            if over:
                self.base.update((base.to_json(),))
            self.head.update((head.to_json(),))
        if out:
            yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in RESULT.split(", ")])

    def close(self) -> None:
        pass


def detected(windows: DataFrame, s: Settings, seed_windows: int = 120, calendar: bool = False, replay: int = REPLAY) -> DataFrame:
    """Streaming results (RESULT) of a stream of window rows with `batch`, which tells the later of two rows of a window."""
    windows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    no = F.lit(False)
    fired = {"incomplete_handshake_spike": rules._exhausted(s), "session_duration_anomaly": rules._slow(s), "user_agent_homogeneity": rules._homogeneous(s), "distributed_connection_burst": rules._burst(s), "synchronized_request_timing": rules._synchronised(s)}
    slim = windows.select(
        "stream_id", "wid", F.col("batch").cast("long").alias("batch"), F.array(*[F.col(f).cast("double") for f in FEATURES]).alias("features"), F.transform("records", lambda r: r["rate"]).alias("rates"), "mean_rate",
        F.array(*[F.coalesce(fired.get(name, no), no) for name in RULES]).alias("fired"),
    )
    return slim.groupBy("stream_id").transformWithStateInPandas(Detect(s, seed_windows, calendar, replay), RESULT, "append", "none")


def latest(results: DataFrame) -> DataFrame:
    """The last revision of each window."""
    return results.filter("NOT too_late").groupBy("stream_id", "wid").agg(F.max_by(F.struct("score", "boosted", "current_tier", "top_anomaly", "n_events"), "revision").alias("r")).select("stream_id", "wid", "r.*")


def start(flows: DataFrame, folder: str, s: Settings, checkpoint: str, late: float = 10.0, seed_windows: int = 120, calendar: bool = False, replay: int = REPLAY, **trigger) -> list:
    """The started queries: flows to {folder}/windows, and these to {folder}/results."""
    first = live.windows_query(flows, folder, s, f"{checkpoint}/windows", late, **trigger)
    if trigger.get("availableNow"):
        first.awaitTermination()
    spark = flows.sparkSession
    rows = spark.readStream.schema(live.window_schema(spark, s)).parquet(f"{folder}/windows")
    found = detected(rows, s, seed_windows, calendar, replay).writeStream.format("parquet").option("path", f"{folder}/results").option("checkpointLocation", f"{checkpoint}/results")
    return [first, found.outputMode("append").trigger(**(trigger or {"processingTime": f"{s.dt} seconds"})).start()]
