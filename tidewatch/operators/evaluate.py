"""Evaluation: run results (a row a run), metrics, comparison detectors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.operators.quantiles import quantiles
from tidewatch.storage import stored


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def confusion(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """precision, recall, specificity and F1, 0 where undefined."""
    p, r = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return {"precision": p, "recall": r, "specificity": _ratio(tn, tn + fp), "f1": F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)}


def _totals() -> list[Column]:
    return [F.coalesce(F.sum(c), F.lit(0)) for c in ("true_positives", "false_positives", "false_negatives", "true_negatives")]


def metrics(runs: DataFrame, by: str | None = "scenario_id") -> DataFrame:
    """Detection rate, latency, peak, false positives in 12 h and confusion metrics: overall (null) and by group, one rollup."""
    hours = F.coalesce(F.sum("duration"), F.lit(0.0)) / 3600
    aggs = [
        F.count(F.lit(1)).alias("runs"),
        F.coalesce(F.avg(F.col("detected").cast("double")), F.lit(0.0)).alias("detection_rate"),
        F.avg("latency").alias("mean_latency"),
        F.avg("peak_score").alias("mean_peak"),
        _ratio(_totals()[1], hours * 1.0).alias("fp_per_hour"),
        *[c.alias(n) for n, c in confusion(*_totals()).items()],
    ]
    grouped = runs.rollup(by) if by else runs.groupBy()
    out = grouped.agg(*aggs)
    return out.withColumn("fp_per_12h", F.col("fp_per_hour") * 12).drop("fp_per_hour")


def latency_stats(runs: DataFrame, by: list[str]) -> DataFrame:
    x = F.col("latency")
    rows = runs.filter(x.isNotNull())
    plain = rows.groupBy(*by).agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    return plain.join(quantiles(rows, by, "latency", {"median": 0.5, "p95": 0.95, "p99": 0.99}), by)


def roc_points(runs: DataFrame, score: str = "peak_score", truth: str = "detected", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, threshold, tpr, fpr) for 0.50 to 0.99.

    A score only counts by the highest threshold it reaches: rows are summed by that place, 51 of them a group whatever the scores."""
    grid = F.array(*[F.lit(k / 100.0) for k in range(50, 100)])
    place = F.aggregate(F.array(*map(F.lit, (32, 16, 8, 4, 2, 1))), F.lit(0), lambda at, step: F.when((at + step <= 50) & (F.get(grid, at + step - 1) <= F.col(score)), at + step).otherwise(at))
    c = runs.groupBy(*by, place.alias("place_")).agg(F.count_if(truth).alias("p"), F.count_if(~F.col(truth)).alias("n"))
    grid = c.withColumn("k", F.explode(F.sequence(F.lit(50), F.lit(99)))).withColumn("threshold", F.col("k") / 100.0)
    hit = F.col("place_") >= F.col("k") - 49
    out = grid.groupBy(*by, "threshold").agg(F.sum(F.when(hit, F.col("p")).otherwise(0)).alias("tp"), F.sum("p").alias("p"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("fp"), F.sum("n").alias("n"))
    return out.select(*by, "threshold", _ratio(F.col("tp"), F.col("p")).alias("tpr"), _ratio(F.col("fp"), F.col("n")).alias("fpr"))


def auc(points: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, auc_in_order, auc_absolute): trapezoids in threshold order clamped to [0, 1], and their absolute value.  Points are
    fifty for each group."""
    order = (Window.partitionBy(*by) if by else Window).orderBy("threshold")
    area = (F.col("fpr") - F.lag("fpr").over(order)) * (F.col("tpr") + F.lag("tpr").over(order)) / 2
    total = points.select(*by, area.alias("a")).groupBy(*by).agg(F.coalesce(F.sum("a"), F.lit(0.0)).alias("t"))
    return total.select(*by, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("t"))).alias("auc_in_order"), F.least(F.lit(1.0), F.abs("t")).alias("auc_absolute"))


#: Shares of a Poisson variable of mean 1 that are at most 0, 1, ... 7.
POISSON = [math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1)) for k in range(8)]


#: Elements hashed at once: some arrays of that many numbers stay in a core's cache.  Groups whose sums a task holds at once.
HASHED_AT_ONCE, GROUPS_AT_ONCE = 32_768, 64
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_CUTS = [np.uint32(int(c * 2**32)) for c in POISSON]


def _digests(prefixes: np.ndarray, suffixes: np.ndarray) -> list[np.ndarray]:
    """The four words of the MD5 of each prefix with each suffix: prefixes x suffixes.  Both are padded messages, in words, whose sums are the messages."""
    shape = len(prefixes), len(suffixes)
    state = [np.full(shape, x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    f = np.empty(shape, np.uint32)
    for at in range(0, prefixes.shape[1], 16):
        words = [prefixes[:, at + j, None] + suffixes[None, :, at + j] if suffixes[:, at + j].any() else prefixes[:, at + j, None] for j in range(16)]
        a, b, c, d = (x.copy() for x in state)
        for i in range(64):
            if i < 16:
                np.bitwise_xor(c, d, out=f)
                f &= b
                f ^= d
                j = i
            elif i < 32:
                np.bitwise_xor(b, c, out=f)
                f &= d
                f ^= c
                j = (5 * i + 1) % 16
            elif i < 48:
                np.bitwise_xor(b, c, out=f)
                f ^= d
                j = (3 * i + 5) % 16
            else:
                np.invert(d, out=f)
                f |= b
                f ^= c
                j = 7 * i % 16
            f += a
            f += words[j]
            f += np.uint32(_SINES[i])
            turn = _TURNS[i // 16][i % 4]
            np.left_shift(f, np.uint32(turn), out=a)
            f >>= np.uint32(32 - turn)
            a |= f
            a += b
            a, b, c, d = d, a, b, c
        state = [x + y for x, y in zip(state, (a, b, c, d), strict=True)]
    return state


def _padded(prefix: int, texts: list[bytes], length: int) -> np.ndarray:
    """The texts from byte `prefix` on in zeroed MD5 messages of `length` bytes, in words; the end mark and the size come with texts that end one."""
    out = np.zeros((len(texts), -(-(length + 9) // 64) * 64), np.uint8)
    out[:, prefix : prefix + len(texts[0])] = np.frombuffer(b"".join(texts), np.uint8).reshape(len(texts), -1)
    if prefix + len(texts[0]) == length:
        out[:, length] = 0x80
        out[:, -8:] = np.frombuffer((8 * length).to_bytes(8, "little"), np.uint8)
    return out.view("<u4")


def _poisson_sums(keys: list[bytes], x: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(draws, total) of each round, over values x whose keys have one length."""
    draws, total = np.zeros((2, -(-rounds // 4) * 4))
    blocks = [str(b).encode() for b in range(-(-rounds // 4))]
    for digits in range(1, len(blocks[-1]) + 1):
        of = [b for b in blocks if len(b) == digits]
        first, length = int(of[0]), len(keys[0]) + digits
        suffixes, prefixes = _padded(len(keys[0]), of, length), _padded(0, keys, length)
        for lo in range(0, len(of), HASHED_AT_ONCE):
            some = suffixes[lo : lo + HASHED_AT_ONCE]
            at, step = 4 * (first + lo), max(1, HASHED_AT_ONCE // len(some))
            for k in range(0, len(keys), step):
                for j, h in enumerate(_digests(prefixes[k : k + step], some)):
                    h.byteswap(inplace=True)  # the digest's hexadecimal digits begin with the lowest byte
                    m, above = np.zeros(h.shape, np.uint8), np.empty(h.shape, bool)
                    for cut in _CUTS:
                        m += np.greater(h, cut, out=above)
                    to = slice(at + j, at + 4 * len(some), 4)
                    draws[to] += m.sum(axis=0)
                    total[to] += (m * x[k : k + step, None]).sum(axis=0)
    return draws[:rounds], total[:rounds]


def poisson_sums(values: DataFrame, column: str, by: list[str], key: list[str], rounds: int, seed: int = 42) -> DataFrame:
    """(by, round_, draws, total, n_, only_): what each round draws of a part of a group; n_ values with only_ among them.

    A task adds up arrays of a number a round and gives these sums alone, so that no row a value and round is made."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key], F.lit(""))
    rows = values.select(*by, text.alias("key_"), F.col(column).cast("double").alias("x_")).filter("x_ IS NOT NULL")
    schema = T.StructType([*[values.schema[c] for c in by], *[T.StructField(c, t()) for c, t in (("round_", T.LongType), ("draws", T.LongType), ("total", T.DoubleType), ("n_", T.LongType), ("only_", T.DoubleType))]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for group, (draws, total, n, only) in held.items():
                each = [pa.array([v] * rounds, t) for v, t in zip(group, types, strict=True)]
                numbers = [np.arange(rounds), draws.astype(np.int64), total, np.full(rounds, n), np.full(rounds, only)]
                yield pa.RecordBatch.from_arrays([*each, *map(pa.array, numbers)], names=schema.names)
            held.clear()

        for batch in batches:
            types = [batch.schema.field(c).type for c in by]
            keys, x = [k.encode() for k in batch.column("key_").to_pylist()], batch.column("x_").to_numpy()
            alike: dict[tuple, list[int]] = {}
            for i, group in enumerate(zip(*[batch.column(c).to_pylist() for c in by], strict=True) if by else [()] * len(keys)):
                alike.setdefault((group, len(keys[i])), []).append(i)
            for (group, _), at in alike.items():
                draws, total = _poisson_sums([keys[i] for i in at], x[at], rounds)
                if group in held:
                    held[group][0] += draws
                    held[group][1] += total
                    held[group][2] += len(at)
                else:
                    held[group] = [draws, total, len(at), x[at[0]]]
                if len(held) >= GROUPS_AT_ONCE:
                    yield from flush()
        yield from flush()

    # Little data and much work: dealt evenly over all cores, whatever the sizes of the parts it comes in.
    dealt = rows.repartition(4 * values.sparkSession.sparkContext.defaultParallelism, "key_")
    return dealt.mapInArrow(run, schema)


def bootstrap(values: DataFrame, column: str, by: list[str], key: list[str], rounds: int = 10_000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """(by, low, high, rounds): percentile interval of the mean over resamples; a group of one value has that value as both.

    A value's multiplicity in a round is Poisson(1) from a hash of its key (columns that tell rows apart) and the round, so
    rounds are sums over rows without collecting a group (the Poisson bootstrap), and reruns agree.  One hash
    gives four rounds.
    """
    sums = poisson_sums(values, column, by, key, rounds, seed).groupBy(*by, "round_").agg(*[F.sum(c).alias(c) for c in ("draws", "total", "n_")], F.max("only_").alias("only_"))
    mean = F.col("total") / F.nullif(F.col("draws"), F.lit(0))
    low = (1 - level) / 2
    out = sums.groupBy(*by).agg(F.percentile(mean, low).alias("low"), F.percentile(mean, 1 - low).alias("high"), F.count(F.lit(1)).alias("rounds"), F.max("n_").alias("n_"), F.max("only_").alias("only_"))
    return out.select(*by, *[F.when(F.col("n_") < 2, F.col("only_")).otherwise(F.col(c)).alias(c) for c in ("low", "high")], "rounds")


#: Rows of a part of bootstrap_exact, and rounds drawn at once.
PART, ROUNDS_AT_ONCE = 1 << 15, 64


def bootstrap_sums(values: DataFrame, column: str, by: list[str], key: list[str], rounds: int, seed: int = 42, size: int = PART) -> DataFrame:
    """(by, round, draws, total): the number and the sum of what each round draws, with replacement, from its group.

    Exactly as many are drawn as the group has.  Draws are dealt to the parts of a group (by hash of the key) by conditional
    binomials, a row a part; within a part they fall on its rows by a multinomial, and only sums leave it.  Generators are seeded by group, part
    and block of rounds and rows are put in order of their key, so reruns agree.
    """
    whole = values.filter(F.col(column).isNotNull()).select(*by, F.concat_ws(":", *key).alias("key_"), F.col(column).cast("double").alias("x_"))
    counts = whole.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / size).alias("parts_"))
    rows = stored(whole.join(counts, by).withColumn("part_", F.pmod(F.xxhash64("key_"), F.col("parts_"))).drop("parts_"), "bootstrap-rows")
    sizes = rows.groupBy(*by, "part_").agg(F.count(F.lit(1)).alias("n_"))
    blocks = -(-rounds // ROUNDS_AT_ONCE)
    named = [rows.schema[b] for b in by]
    group = F.xxhash64(*by) if by else F.lit(0).cast("long")

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part_")
        n, block = pdf["n_"].to_numpy(np.int64), int(pdf["block_"].iloc[0])
        rng = np.random.default_rng([seed, int(pdf["group_"].iloc[0]) & (2**63 - 1), block])
        left, ahead, out = np.full(min(ROUNDS_AT_ONCE, rounds - block * ROUNDS_AT_ONCE), n.sum()), n.sum(), []
        for k in n.tolist():
            out.append(rng.binomial(left, k / ahead) if k < ahead else left.copy())
            left, ahead = left - out[-1], ahead - k
        return pdf[[*by, "part_", "block_"]].assign(draws_=[d.tolist() for d in out])

    every = sizes.withColumn("group_", group).withColumn("block_", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = every.groupBy(*by, "block_").applyInPandas(deal, T.StructType([*named, T.StructField("part_", T.LongType()), T.StructField("block_", T.IntegerType()), T.StructField("draws_", T.ArrayType(T.LongType()))]))

    def draw(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        x = left.sort_values(["key_", "x_"])["x_"].to_numpy(float)
        out = []
        for part, block, draws, at in zip(right["part_"], right["block_"], right["draws_"], right["group_"], strict=True):
            rng = np.random.default_rng([seed, int(at) & (2**63 - 1), int(block), int(part) + 1])
            out.append([float(np.bincount(rng.integers(len(x), size=d), minlength=len(x)) @ x) for d in draws])
        return right[[*by, "block_", "draws_"]].assign(totals_=out)

    kinds = T.StructType([*named, T.StructField("block_", T.IntegerType()), T.StructField("draws_", T.ArrayType(T.LongType())), T.StructField("totals_", T.ArrayType(T.DoubleType()))])
    drawn = rows.groupBy(*by, "part_").cogroup(dealt.withColumn("group_", group).groupBy(*by, "part_")).applyInPandas(draw, kinds)
    each = drawn.select(*by, "block_", F.posexplode(F.arrays_zip("draws_", "totals_")).alias("k_", "z_"))
    return each.groupBy(*by, (F.col("block_") * ROUNDS_AT_ONCE + F.col("k_")).alias("round")).agg(F.sum("z_.draws_").alias("draws"), F.sum("z_.totals_").alias("total"))


def bootstrap_exact(values: DataFrame, column: str, by: list[str], key: list[str], rounds: int = 10_000, level: float = 0.95, seed: int = 42, size: int = PART) -> DataFrame:
    """(by, low, high, rounds, draws): percentile interval of the mean over rounds that draw exactly n of n; a group of one value has that value as both."""
    means = bootstrap_sums(values, column, by, key, rounds, seed, size).withColumn("mean", F.col("total") / F.col("draws"))
    low = (1 - level) / 2
    return means.groupBy(*by).agg(F.percentile("mean", low).alias("low"), F.percentile("mean", 1 - low).alias("high"), F.count(F.lit(1)).alias("rounds"), F.min("draws").alias("least_draws"), F.max("draws").alias("most_draws"))


def effectiveness(runs: DataFrame) -> DataFrame:
    """Relative reduction (percent, 0 to 100) of the mean peak by mitigation; rows (mitigated, peak_score)."""
    m = runs.agg(F.avg(F.when(~F.col("mitigated"), F.col("peak_score"))).alias("a"), F.avg(F.when(F.col("mitigated"), F.col("peak_score"))).alias("b"))
    return m.select(F.when(F.coalesce(F.col("a"), F.lit(0.0)) > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("a") - F.coalesce("b", F.lit(0.0))) / F.col("a"))) * 100).otherwise(0.0).alias("effectiveness"))


def ablation(runs: DataFrame, full: str = "Full") -> DataFrame:
    """Per config detection rate, F1 and AUC, and the first two's differences from the full one; the joined side is one row."""
    by = runs.groupBy("config").agg(F.avg(F.col("detected").cast("double")).alias("detection_rate"), confusion(*_totals())["f1"].alias("f1"))
    base = by.filter(F.col("config") == full).select(F.col("detection_rate").alias("d0"), F.col("f1").alias("f0"))
    area = auc(roc_points(runs, by=("config",)), ("config",)).select("config", F.col("auc_in_order").alias("auc"))
    out = by.join(F.broadcast(base), F.lit(True), "left").join(area, "config", "left")
    return out.select("config", "detection_rate", (F.col("detection_rate") - F.col("d0")).alias("delta_dr"), "f1", (F.col("f1") - F.col("f0")).alias("delta_f1"), "auc")


def report(runs: DataFrame, by: str = "scenario_id") -> DataFrame:
    """The report's table, a row a scenario: detection rate, mean latency (0 if nothing was detected), false positives a run, mean peak,
    repetitions; precision, recall, F1 and specificity of runs (a detected run is a true positive, false ones are the mean
    number times the runs, cut to whole ones)."""
    n, hit = F.count(F.lit(1)), F.count_if("detected")
    out = runs.groupBy(by).agg(
        n.alias("reps"),
        hit.alias("tp"),
        F.coalesce(F.avg(F.when(F.col("detected"), F.col("latency"))), F.lit(0.0)).alias("mean_latency"),
        F.avg(F.coalesce("false_positives", F.lit(0))).alias("fp_per_run"),
        F.avg("peak_score").alias("mean_peak"),
        F.floor(F.avg(F.coalesce("false_positives", F.lit(0))) * n).alias("fp"),
    )
    tp, fp = F.col("tp"), F.col("fp")
    rates = confusion(tp, fp, F.col("reps") - tp, F.greatest(F.col("reps") - fp, F.lit(0)))
    return out.select(by, "reps", (tp / F.col("reps")).alias("detection_rate"), "mean_latency", "fp_per_run", "mean_peak", *[c.alias(k) for k, c in rates.items()])


def report_lines(table: DataFrame) -> DataFrame:
    """A table as lines of text, names left, numbers to four places right (a row a line, no order)."""
    cell = lambda f: F.rpad(F.coalesce(F.col(f.name).cast("string"), F.lit("all")), 25, " ") if isinstance(f.dataType, T.StringType) else F.lpad(F.when(F.col(f.name).isNull(), "N/A").otherwise(F.format_string("%.4f", F.col(f.name).cast("double"))), 14, " ")
    return table.select(F.concat_ws(" ", *[cell(f) for f in table.schema]).alias("line"))


def static_threshold(found: DataFrame, first: int = 20) -> DataFrame:
    """(stream_id, wid, score, alert): rates against the median of a stream's first windows."""
    order = Window.partitionBy("stream_id").orderBy("wid")
    base = found.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= first).groupBy("stream_id").agg(F.percentile("request_rate", 0.5).alias("b"))
    x = found.join(base, "stream_id", "left").withColumn("b", F.coalesce("b", F.lit(50.0)))
    score = F.least(F.greatest(F.col("request_rate") / F.greatest("b", F.lit(0.1)) / 10, F.col("total_request_rate") / F.greatest(100 * F.col("b"), F.lit(0.1)) / 2), F.lit(1.0))
    return x.select("stream_id", "wid", score.alias("score"), (score >= 0.7).alias("alert"))


# Fixed values: (feature, comparison, bound, score) of the signature rules.
SIGNATURES = (("concurrent_connection_count", ">", 100.0, 0.8), ("handshake_completion_ratio", "<", 0.1, 0.9), ("mean_connection_duration", ">", 60.0, 0.7), ("request_rate", ">", 500.0, 0.85))


def signatures(found: DataFrame, rules: tuple = SIGNATURES) -> DataFrame:
    """(stream_id, wid, score, matches, alert): the highest score of the matching rules."""
    hits = [(F.col(f) > b) if op == ">" else (F.col(f) < b) for f, op, b, _ in rules]
    score = F.greatest(F.lit(0.0), *[F.when(h, v).otherwise(0.0) for h, (_, _, _, v) in zip(hits, rules, strict=True)])
    n = sum((h.cast("int") for h in hits[1:]), hits[0].cast("int"))
    return found.select("stream_id", "wid", score.alias("score"), n.alias("matches"), (score >= 0.7).alias("alert"))


def forest(cases: DataFrame, inputs: list[str], label: str = "label", order: str = "case", trees: int = 100, depth: int = 10, seed: int = 42) -> DataFrame:
    """Random-forest comparison: trained on the first 70 % of cases, every row scored min(2p, 1).  The scaler is fitted
    again on the rows that are scored, as the compared method does."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    inputs = sorted(inputs)[:20]
    cut = cases.agg(F.percentile(order, 0.7)).first()[0]
    assembled = VectorAssembler(inputCols=inputs, outputCol="raw_").transform(cases.withColumn("label_", F.col(label).cast("double")))
    scale = StandardScaler(inputCol="raw_", outputCol="features_", withMean=True)
    train, rest = assembled.filter(F.col(order) <= cut), assembled.filter(F.col(order) > cut)
    if train.select("label_").distinct().count() < 2:
        return cases.select(order, label, F.lit(1.0).alias("score"))
    model = RandomForestClassifier(labelCol="label_", featuresCol="features_", numTrees=trees, maxDepth=depth, seed=seed).fit(scale.fit(train).transform(train))
    scored = [model.transform(scale.fit(part).transform(part)) for part in (train, rest) if part.head(1)]
    from pyspark.ml.functions import vector_to_array

    both = scored[0] if len(scored) == 1 else scored[0].unionByName(scored[1])
    return both.select(order, label, F.least(2 * vector_to_array("probability")[1], F.lit(1.0)).alias("score"))


def outcome_counts(scored: DataFrame, attack: Column, at: float = 0.7) -> DataFrame:
    """tp, fp, fn, tn by stream, of windows alerted (score >= at) against an attack flag, and the first true alert."""
    on = F.col("score") >= at
    return scored.groupBy("stream_id").agg(
        F.count_if(on & attack).alias("tp"), F.count_if(on & ~attack).alias("fp"), F.count_if(~on & attack).alias("fn"), F.count_if(~on & ~attack).alias("tn"),
        F.min(F.when(on & attack, F.col("wid"))).alias("first_wid"), F.min(F.when(attack, F.col("wid"))).alias("attack_wid"),
    )


def macro(counts: DataFrame) -> DataFrame:
    """Confusion metrics by stream, then their unweighted means (null stream)."""
    per = counts.select("stream_id", *[c.alias(n) for n, c in confusion(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")).items()], (F.col("first_wid") - F.col("attack_wid")).cast("double").alias("latency_windows"))
    return per.rollup("stream_id").agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "specificity", "f1", "latency_windows")])
