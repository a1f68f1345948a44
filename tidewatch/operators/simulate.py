"""Synthetic traffic: legitimate flows and five kinds of attack.

Rows come from ranges; every random number is a hash of (seed, stream, window, row, purpose), so results don't depend on
partitions and reruns agree.  Distributions match what the detector is tuned for, not another generator's stream of numbers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.schema import FLOW_COLUMNS

# Scenarios (id, duration, attack start).
SCENARIOS = (("http_flood", 600.0, 30.0), ("slowloris", 900.0, 30.0), ("connection_flood", 480.0, 30.0), ("low_rate_distributed", 1200.0, 30.0), ("synchronized_burst", 720.0, 30.0))

#: User agents of legitimate traffic, and its countries, of shares that fall by a sixth from one to the next.
AGENTS = tuple(f"agent-{family}/{version}" for family in ("browser", "library") for version in range(1, 6))
COUNTRIES = {f"C{k:02d}": (5 / 6) ** k for k in range(20)}
# Response codes of legitimate traffic with their shares.
STATUSES = {200: 0.9, 304: 0.05, 404: 0.04, 500: 0.01}


class Draw:
    """Random columns for rows that have stream_id, wid and i."""

    def __init__(self, seed: int | Column, kind: str):
        self.seed, self.kind, self.n = seed if isinstance(seed, Column) else F.lit(seed), kind, 0

    def uniform(self, low: float = 0.0, high: float = 1.0) -> Column:
        self.n += 1
        h = F.xxhash64(self.seed, F.lit(self.kind), F.lit(self.n), "stream_id", "wid", "i")
        return F.lit(low) + F.lit(high - low) * ((F.pmod(h, F.lit(1 << 52)) + 0.5) / float(1 << 52))

    def integer(self, low: int, high: int) -> Column:
        """low <= x < high."""
        return F.floor(self.uniform(low, high)).cast("long")

    def normal(self, mean: float = 0.0, sd: float = 1.0) -> Column:
        return F.lit(mean) + F.lit(sd) * F.sqrt(-2 * F.log(self.uniform())) * F.cos(2 * math.pi * self.uniform())

    def lognormal(self, mean: float, sd: float) -> Column:
        return F.exp(self.normal(mean, sd))

    def poisson(self, mean: float) -> Column:
        """By inversion of the cumulative distribution."""
        u, p, total, out = self.uniform(), math.exp(-mean), 0.0, F.lit(0)
        for k in range(int(mean + 10 * math.sqrt(mean) + 5)):
            total += p
            p *= mean / (k + 1)
            out = out + (u > total).cast("int")
        return out.cast("long")

    def choice(self, shares: dict) -> Column:
        u, total, whole, out = self.uniform(), 0.0, sum(shares.values()), None
        for value, share in shares.items():
            total += share / whole
            out = F.when(u < total, F.lit(value)) if out is None else out.when(u < total, F.lit(value))
        return out.otherwise(F.lit(list(shares)[-1]))

    def chance(self, p: float) -> Column:
        return self.uniform() < p


def _even(values) -> dict:
    return dict.fromkeys(values, 1.0)


def _rows(steps: DataFrame, n: Column) -> DataFrame:
    return steps.withColumn("n_", n.cast("int")).filter("n_ > 0").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n_") - 1))).drop("n_")


def _flow(df: DataFrame, **columns: Column) -> DataFrame:
    fixed = {"dst_ip": F.lit("10.0.0.1"), "dport": F.lit(80), "proto": F.lit("TCP")} | columns
    return df.select("stream_id", "wid", *[fixed[c].alias(c) for c in FLOW_COLUMNS])


def _dotted(*parts) -> Column:
    return F.concat_ws(".", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def legitimate(steps: DataFrame, seed: int | Column = 42, n_flows: int = 50) -> DataFrame:
    """Flows of steps (stream_id, wid, t).  A flash crowd doubles them in the first 30 s of every 300 s and aligns their times.
    Seed windows (negative wid) hold N(50, 10) flows, 10 at least."""
    d, around = Draw(seed, "legitimate"), Draw(seed, "seed-size")
    crowd = F.pmod(F.floor("t"), F.lit(300)) < 30
    number = F.when(F.col("wid") < 0, F.greatest(F.lit(10), F.floor(around.normal(50, 10)))).otherwise(n_flows)
    steps = steps.withColumn("i", F.lit(0)).withColumn("flows_", F.when(crowd, 2 * number).otherwise(number)).drop("i")
    rows = _rows(steps, F.col("flows_"))
    # The usual first octets, shares, and the parameters of the distributions.
    first = F.when(d.chance(0.8), d.choice(_even((10, 172, 192, 203, 216)))).otherwise(d.integer(1, 223))
    rows = rows.withColumn("start_", F.col("t") + d.normal() * F.when(crowd, 0.5).otherwise(3.0))
    return _flow(
        rows,
        src_ip=_dotted(first, d.integer(0, 255), d.integer(0, 255), d.integer(1, 254)),
        sport=d.integer(1024, 65535).cast("int"),
        start_time=F.col("start_"),
        last_time=F.col("start_") + F.least(F.greatest(d.lognormal(0.7, 1.5), F.lit(0.1)), F.lit(300.0)),
        bytes_sent=F.floor(d.lognormal(6, 1.5)).cast("long"),
        bytes_recv=F.floor(d.lognormal(9, 2)).cast("long"),
        packets=d.integer(2, 50),
        handshake_complete=~d.chance(0.02),
        request_count=F.greatest(F.lit(1).cast("long"), d.poisson(3)),
        protocol_violation=d.chance(0.01),
        user_agent=d.choice(_even(AGENTS)),
        country_code=d.choice(COUNTRIES),
        response_status=d.choice(STATUSES),
    )


def attack(steps: DataFrame, kind: str, seed: int | Column = 42, start: float = 30.0) -> DataFrame | None:
    """Attack flows of steps at t >= start; None for an unknown kind."""
    d, i, t = Draw(seed, kind), F.col("i"), F.col("t")
    elapsed = F.greatest(t - start, F.lit(0.0))
    steps = steps.filter(t >= start)
    whole = lambda c: F.floor(c).cast("long")
    common = {"sport": d.integer(1024, 65535).cast("int"), "start_time": t, "handshake_complete": F.lit(True), "protocol_violation": F.lit(False), "response_status": F.lit(200)}
    # The numbers of each attack.
    if kind == "http_flood":
        rows = _rows(steps, F.when(elapsed < 10, 30).otherwise(100)).withColumn("r_", F.greatest(F.lit(1).cast("long"), whole(d.normal(50, 3))))
        own = {"src_ip": _dotted(192, 168, F.lit(100) + F.floor(i / 254), i % 254 + 1), "last_time": t + d.uniform(0.1, 2.0), "bytes_sent": whole(d.normal(500, 50)), "bytes_recv": whole(d.normal(1200, 200)), "packets": 2 * F.col("r_"), "request_count": F.col("r_"), "user_agent": F.lit("python-requests/2.28"), "country_code": d.choice(_even(("CN", "RU", "KR")))}
    elif kind == "slowloris":
        rows = _rows(steps, F.least(F.floor(elapsed / 5) * 10 + 20, F.lit(200)))
        own = {"src_ip": _dotted(10, 10, F.floor(i / 254), i % 254 + 1), "start_time": t - (F.lit(10.0) + d.uniform() * elapsed), "last_time": t, "bytes_sent": d.integer(1, 80), "bytes_recv": F.lit(0).cast("long"), "packets": d.integer(2, 10), "request_count": F.lit(0).cast("long"), "user_agent": F.lit("slowhttptest/1.8"), "country_code": d.choice(_even(("RU", "CN"))), "response_status": F.lit(0)}
    elif kind == "connection_flood":
        rows = _rows(steps, F.lit(100)).withColumn("c_", F.greatest(F.lit(1).cast("long"), whole(d.normal(10, 2))))
        own = {"src_ip": _dotted(172, 16, F.floor(i / 254), i % 254 + 1), "last_time": t + d.uniform(0.01, 0.5), "bytes_sent": d.integer(40, 80) * F.col("c_"), "bytes_recv": d.integer(40, 80) * F.col("c_"), "packets": 2 * F.col("c_"), "handshake_complete": d.chance(0.1), "request_count": F.lit(0).cast("long"), "protocol_violation": d.chance(0.3), "user_agent": F.lit(""), "country_code": d.choice(_even(("CN", "RU", "KR", "BR"))), "response_status": F.lit(0)}
    elif kind == "low_rate_distributed":
        shared = Draw(seed, "low-rate-base")
        rows = _rows(steps.withColumn("i", F.lit(0)).withColumn("base_", t + shared.normal(0, 0.3)).drop("i"), F.lit(500))
        own = {"src_ip": _dotted(F.lit(10) + F.floor(i / 65025), F.floor(i / 255) % 255, i % 255, 1), "start_time": F.col("base_") + d.normal(0, 0.2), "last_time": F.col("base_") + d.uniform(1, 4), "bytes_sent": whole(d.normal(800, 100)), "bytes_recv": whole(d.normal(3000, 500)), "packets": d.integer(3, 8), "request_count": d.poisson(2), "user_agent": d.choice(_even(AGENTS)), "country_code": d.choice({"CN": 0.6, "RU": 0.4})}
    elif kind == "synchronized_burst":
        rows = _rows(steps.filter(F.pmod(t, F.lit(30.0)) < 5), F.lit(100))
        own = {"src_ip": _dotted(203, F.floor(i / 254), i % 254, 1), "start_time": t + d.normal(0, 0.1), "last_time": t + d.uniform(0.5, 5.0), "bytes_sent": whole(d.normal(400, 50)), "bytes_recv": whole(d.normal(1000, 200)), "packets": whole(d.normal(40, 5)), "request_count": F.greatest(F.lit(1).cast("long"), whole(d.normal(40, 5))), "user_agent": F.lit("AttackBot/1.0"), "country_code": d.choice(_even(("CN", "RU", "KR")))}
    else:
        return None
    return _flow(rows, **(common | own))


def scenario_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, n.replace("_", " "), d, a, {"attack_start": a}) for n, d, a in SCENARIOS], "id string, name string, duration double, attack_start double, generator_kwargs map<string,double>")


def scenario_grid(spark: SparkSession, reps: int = 3, dt: float = 5.0, seed: int = 42, seed_windows: int = 120, most_windows: int | None = None) -> DataFrame:
    """Flows of every scenario and repetition, each a stream `scenario-rep` with a seed of its own: seed windows at negative
    times, then the run.  Legitimate flows have kind `legitimate`, others `attack`.

    most_windows shortens runs for demonstrations.  Runs share nothing, so they spread over the cluster.
    """
    parts = []
    for name, length, start in SCENARIOS:
        windows = int(length / dt) if most_windows is None else min(most_windows, int(length / dt))
        steps = spark.range(-seed_windows, windows).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
        # 100 between the seeds of repetitions, and 3 more for the generator's.
        steps = steps.select(F.concat(F.lit(name + "-"), F.col("rep").cast("string")).alias("stream_id"), F.col("id").alias("wid"), (F.col("id") * dt).alias("t"), (F.lit(seed) + F.col("rep") * 103).alias("seed"))
        of = lambda flows, kind: flows.withColumn("kind", F.lit(kind))
        parts.append(of(legitimate(steps, F.col("seed")), "legitimate").unionByName(of(attack(steps, name, F.col("seed"), start), "attack")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return _sequenced(out)


def quiet(spark: SparkSession, windows: int = 8640, dt: float = 5.0, seed: int = 999, seed_windows: int = 120) -> DataFrame:
    """Legitimate flows alone, 12 hours of them, after seed windows: one stream `quiet`."""
    steps = spark.range(-seed_windows, windows).select(F.lit("quiet").alias("stream_id"), F.col("id").alias("wid"), (F.col("id") * dt).alias("t"))
    return _sequenced(legitimate(steps, seed))


def _sequenced(flows: DataFrame) -> DataFrame:
    return flows.withColumn("flow_seq", F.xxhash64("stream_id", "wid", "src_ip", "sport", "start_time"))
