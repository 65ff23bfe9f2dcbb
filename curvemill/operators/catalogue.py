"""Table jobs around the curves: labelling, deduplication, resume, planning, splits, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curvemill import constants as K
from curvemill.functions import columns as C
from curvemill.operators.cells import cadence
from curvemill.operators.clean import robust_scatter
from curvemill.operators.skew import Census, attach, census, first_per_key, grouped_quantiles, grouped_row_number

KEY = ["target"]


# -- labelled catalogues -----------------------------------------------------------------------------

def label_first_catalogue(koi: DataFrame) -> DataFrame:
    """Objects with an unambiguous class."""
    out = koi.withColumn("label", C.label_from_flags()).where(F.col("label").isNotNull())
    return out.withColumn("target", C.prefixed_id("KIC", "kepid"))


def label_second_catalogue(toi: DataFrame) -> DataFrame:
    out = toi.withColumn("label", C.label_from_code("code")).where(F.col("label").isNotNull())
    return out.withColumn("target", C.prefixed_id("TIC", "tid"))


def dedupe_brightest(cat: DataFrame, tie: str) -> DataFrame:
    """One row per star, smallest magnitude; ``tie`` decides between equals."""
    return first_per_key(cat, KEY, [F.col("mag"), F.col(tie)])


def cap_per_class(cat: DataFrame, n: int, tie: str = "target") -> DataFrame:
    """The ``n`` brightest per (mission, label). Spark cuts to n per group before the shuffle."""
    w = Window.partitionBy("mission", "label").orderBy("mag", tie)
    return cat.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def class_counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


# -- archive observations ------------------------------------------------------------------------------

def metadata_filter(obs: DataFrame, equal: dict, low: float = K.EXPOSURE_RANGE[0], high: float = K.EXPOSURE_RANGE[1]) -> DataFrame:
    """Rows whose columns equal the given values and whose exposure lies in range."""
    cond = F.col("t_exptime").between(low, high)
    for name, value in equal.items():
        cond = cond & (F.col(name) == value)
    return obs.where(cond)


def exclude_segment(obs: DataFrame, text: str = "Quarter 00", column: str = "mission") -> DataFrame:
    return obs.where(~F.coalesce(F.contains(F.col(column), F.lit(text)), F.lit(False)))


def with_product(obs: DataFrame, products: DataFrame) -> DataFrame:
    """Observations that have a light-curve product with an address."""
    good = products.where((F.col("subgroup") == "LC") & F.col("data_uri").isNotNull()).select("obsid")
    return obs.join(good, "obsid", "left_semi")


def earliest_segment(obs: DataFrame) -> DataFrame:
    """First observation per target by sequence, then id; a missing one counts as 0."""
    zero = F.lit(0)
    return first_per_key(obs, KEY, [F.coalesce("sequence_number", zero), F.coalesce("obsid", zero)])


def pick_segments(obs: DataFrame, choice: DataFrame, order: Column, max_segments: int = 1, cen: Census | None = None) -> DataFrame:
    """Per target the segments from number ``segment % n`` on, at most ``max_segments``; from the first
    one without a choice. ``order`` must be unique per target."""
    cen = census(obs, KEY) if cen is None else cen
    n = obs.groupBy("target").agg(F.count(F.lit(1)).alias("_n")).join(choice.select("target", "segment"), "target", "left")
    n = n.withColumn("_from", F.when(F.col("segment").isNotNull() & (F.col("_n") > 1), F.pmod("segment", "_n")).otherwise(F.lit(0)))
    x = attach(grouped_row_number(obs, KEY, {"o": order}, cen), n.drop("segment"), KEY, cen)
    k = F.col("rn") - 1
    return x.where((k >= F.col("_from")) & (k < F.col("_from") + max_segments)).drop("rn", "_n", "_from")


def stitch(*segments: DataFrame) -> DataFrame:
    """One curve from several segments."""
    out = segments[0]
    for s in segments[1:]:
        out = out.unionByName(s)
    return out


# -- resume and merge ---------------------------------------------------------------------------------

def remaining(tasks: DataFrame, done: DataFrame, keys) -> DataFrame:
    """Tasks not yet done."""
    return tasks.join(done.select(*keys).distinct(), list(keys), "left_anti")


def merge_prefer_success(df: DataFrame, keys, tie) -> DataFrame:
    """One row per key, a success before a failure, then ``tie``."""
    return first_per_key(df, list(keys), [F.col("error").isNotNull(), *[F.col(c) for c in tie]])


def keep_first(df: DataFrame, keys, order) -> DataFrame:
    return first_per_key(df, list(keys), [F.col(c) for c in order])


def keep_last(df: DataFrame, keys, order) -> DataFrame:
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_b"))
    return best.select(*keys, "_b.*").select(*df.columns)


def failure_reasons(df: DataFrame, width: int = 45, top: int = 8) -> DataFrame:
    """Most frequent failure texts."""
    g = df.where(F.col("error").isNotNull()).groupBy(F.substring("error", 1, width).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    return g.orderBy(F.col("n").desc(), "reason").limit(top)


# -- acquisition plan -----------------------------------------------------------------------------------

def acquisition_plan(catalogue: DataFrame, done: DataFrame, per_class: int) -> DataFrame:
    """Per catalogue class: usable rows, deficit, measured rate, attempts needed and taken."""
    got = done.groupBy("label").agg(F.count(F.lit(1)).alias("tried"), F.count_if(F.col("error").isNull()).alias("have"))
    tried = done.where(C.settled()).select("target").distinct()
    avail = catalogue.select("label").distinct()
    pool = catalogue.join(tried, "target", "left_anti").groupBy("label").agg(F.count(F.lit(1)).alias("pool"))
    p = avail.join(got, "label", "left").join(pool, "label", "left").fillna(0, ["tried", "have", "pool"])
    rate = F.when(F.col("tried") >= 20, F.col("have") / F.when(F.col("tried") > 0, F.col("tried"))).otherwise(F.lit(0.6))
    p = p.withColumn("deficit", F.greatest(F.lit(0), F.lit(per_class) - F.col("have"))).withColumn("rate", F.greatest(rate, F.lit(0.15)))
    p = p.withColumn("need", F.ceil(F.col("deficit") / F.col("rate")))
    return p.select("label", "have", "deficit", "rate", "need", "pool", F.least("need", "pool").alias("take"))


def plan_take(catalogue: DataFrame, done: DataFrame, per_class: int, tie: str = "target") -> DataFrame:
    """Targets to acquire: the brightest ``take`` per class, most deficient class first."""
    plan = acquisition_plan(catalogue, done, per_class).select("label", "deficit", "take")
    tried = done.where(C.settled()).select("target").distinct()
    pool = catalogue.join(tried, "target", "left_anti")
    ranked = grouped_row_number(pool, ["label"], {"m": F.col("mag"), "t": F.col(tie)})
    return (ranked.join(plan, "label").where(F.col("rn") <= F.col("take"))
            .orderBy(F.col("deficit").desc(), "label", "rn"))


# -- splits -------------------------------------------------------------------------------------------

def hash_order(key: Column, seed: int) -> Column:
    """Reproducible shuffle order, the same on every engine and cluster."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"#{seed}")))


def stratified_split(df: DataFrame, key: str, label: str, fractions: dict[str, float], seed: int = 0) -> DataFrame:
    """Exact shares per label: the first ``ceil(f1 n)`` rows in hash order go to the first part and so on."""
    cen = census(df, [label])
    x = grouped_row_number(df, [label], {"h": hash_order(F.col(key), seed), "k": F.col(key)}, cen)
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    x, out, share = x.join(n, label), None, 0.0
    for name, f in fractions.items():
        share += f
        edge = F.ceil(F.col("_n") * round(share, 12))
        out = F.when(F.col("rn") <= edge, name) if out is None else out.when(F.col("rn") <= edge, name)
    return x.withColumn("split", out.otherwise(list(fractions)[-1])).drop("rn", "_n")


def group_split(df: DataFrame, test_fraction: float, group: str = "target", seed: int = 0) -> DataFrame:
    """Whole groups to one side: ``ceil(fraction x groups)`` groups in hash order form the test part."""
    g = df.select(group).distinct().withColumn("_all", F.lit(1))
    cen = census(g, ["_all"])
    ranked = grouped_row_number(g, ["_all"], {"h": hash_order(F.col(group), seed), "k": F.col(group)}, cen)
    side = F.when(F.col("rn") <= F.ceil(F.lit(cen.n_rows * test_fraction)), "test").otherwise("train")
    return df.join(ranked.select(group, side.alias("split")), group)


def baseline_split(manifest: DataFrame, fraction: float = 0.25, seed: int = 0) -> DataFrame:
    """Per brightness bin ``max(1, round(fraction x n))`` targets to the test pool."""
    x = grouped_row_number(manifest, ["brightness_bin"], {"h": hash_order(F.col("target"), seed), "k": F.col("target")})
    n = manifest.groupBy("brightness_bin").agg(F.count(F.lit(1)).alias("_n"))
    cut = F.greatest(F.lit(1.0), F.rint(F.col("_n") * fraction))
    return x.join(n, "brightness_bin").withColumn("split", F.when(F.col("rn") <= cut, "test").otherwise("train")).drop("rn", "_n")


def stratified_sample(manifest: DataFrame, per_bin: int, strata=("mission", "brightness_bin"), seed: int = 0) -> DataFrame:
    """``per_bin`` targets per stratum in hash order, fewer where a stratum is smaller."""
    w = Window.partitionBy(*strata).orderBy("_h", "target")
    x = manifest.withColumn("_h", hash_order(F.col("target"), seed)).withColumn("_r", F.row_number().over(w))
    return x.where(F.col("_r") <= per_bin).drop("_h", "_r")


def hash_pick(n: Column, seed: int, *parts: Column) -> Column:
    """A number from 0 to n - 1, the same on every engine: 32 bits of a hash of ``parts``, modulo n."""
    text = F.concat_ws("#", *[p.cast("string") for p in parts], F.lit(str(seed)))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint"), n)


def two_stage_draw(manifest: DataFrame, draws: int, strata=("brightness_bin",), seed: int = 0) -> DataFrame:
    """``draws`` seeded draws with replacement, each first a stratum, all alike, then one of its targets: ``draw`` and the drawn row.

    So faint strata of many targets come up no more often than bright ones of few. Rows without a stratum are drawn only if no row has one. The
    draws are a table, joined to the ranked targets on (stratum, rank): nothing is drawn on the driver.
    """
    keys = list(strata)
    named = F.lit(True)
    for k in keys:
        named &= F.col(k).isNotNull()
    pool = manifest.where(named)
    if pool.isEmpty():
        keys, pool = ["_all"], manifest.withColumn("_all", F.lit(1))
    ranked = grouped_row_number(pool, keys, {"h": hash_order(F.col("target"), seed), "k": F.col("target")}, name="_rank")
    sizes = pool.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).withColumn("_one", F.lit(1))
    cen = census(sizes, ["_one"])
    sizes = grouped_row_number(sizes, ["_one"], {k: F.col(k) for k in keys}, cen, name="_bin")
    table = manifest.sparkSession.range(draws).select(F.col("id").alias("draw"))
    table = table.withColumn("_bin", hash_pick(F.lit(cen.n_rows), seed, F.lit("bin"), F.col("draw")) + 1)
    table = table.join(sizes, "_bin").withColumn("_rank", hash_pick(F.col("_n"), seed, F.lit("row"), F.col("draw")) + 1)
    return table.drop("_bin", "_n", "_one").join(ranked, [*keys, "_rank"]).select("draw", *manifest.columns)


def shared_targets(train: DataFrame, held_out: DataFrame) -> DataFrame:
    """Targets on both sides."""
    a, b = (d.where(F.col("target").isNotNull()).select("target") for d in (train, held_out))
    return a.intersect(b)


def assert_disjoint(train: DataFrame, held_out: DataFrame) -> None:
    """Raise if the two sides share a target or one of them names none."""
    for side, df in (("training", train), ("evaluation", held_out)):
        if "target" not in df.columns:
            raise ValueError(f"{side} rows need a target column for the leak check")
    bad = shared_targets(train, held_out)
    n = bad.count()
    if n:
        some = [r[0] for r in bad.orderBy("target").limit(3).collect()]
        raise ValueError(f"leak: {n} targets on both sides, among them {some}")


# -- matches and coverage --------------------------------------------------------------------------------

HARMONICS = [1.0, 2.0, 0.5, 3.0, 1.0 / 3.0]


def harmonic_match(recovered: Column, published: Column, tolerance: float = 0.02) -> Column:
    """First multiple of the published period within tolerance; NULL when none is."""
    r = F.try_divide(recovered, published)
    return F.coalesce(*[F.when(F.abs(r / m - 1.0) < tolerance, F.lit(m)) for m in HARMONICS])


def event_coverage(lc: DataFrame, det: DataFrame, cen: Census | None = None) -> DataFrame:
    """Share of the predicted event windows, clipped to the observed span, that holds samples.

    A sample finds the windows it is in by arithmetic on its own epoch, so no range join is needed. The length of all windows in the span is
    that up to its end less that up to its begin; either is a sum over whole windows and an arithmetic series over cut ones, so a
    tiny period costs no more than a long one.
    """
    cen = census(lc, KEY) if cen is None else cen
    usable = C.is_finite("period") & C.is_finite("t0") & C.is_finite("duration") & (F.col("period") > 0) & (F.col("duration") > 0)
    ok = det.where(usable).select("target", "period", "t0", "duration")
    p, t0, half = F.col("period"), F.col("t0"), F.col("duration") / 2.0
    inside = F.floor((F.col("t") - t0 + half) / p) - F.ceil((F.col("t") - t0 - half) / p) + 1
    hits = attach(lc, ok, KEY, cen).groupBy("target").agg(F.sum(inside).alias("got"))
    span = lc.groupBy("target").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    e = attach(attach(ok, span, KEY, cen), cadence(lc, cen), KEY, cen)
    first, last = F.floor((F.col("lo") - t0) / p) - 1, F.ceil((F.col("hi") - t0) / p) + 1

    def upto(x: Column) -> Column:
        whole = C.clamp_int(F.floor((x - t0 - half) / p) - first + 1, last - first + 1)
        a, b = first + whole, F.least(F.ceil((x - t0 + half) / p) - 1, last)
        cut = F.greatest(b - a + 1, F.lit(0))
        return whole * half * 2.0 + cut * (x - t0 + half) - p * (a + b) * cut / 2.0

    e = e.where(F.col("cadence") > 0)
    e = e.select("target", ((upto(F.col("hi")) - upto(F.col("lo"))) / F.col("cadence")).alias("expected")).join(hits, "target")
    cov = F.when(F.col("expected") < 1.0, 0.0).otherwise(F.least(F.col("got") / F.col("expected"), F.lit(1.0)))
    return det.select("target").join(e.select("target", cov.alias("coverage")), "target", "left").fillna(0.0, ["coverage"])


# -- baselines --------------------------------------------------------------------------------------------

def vet_baselines(lc: DataFrame, det: DataFrame, minimum: int = K.MIN_POINTS_INGEST, cen: Census | None = None) -> DataFrame:
    """Accept a star as quiet when its search found nothing; noise numbers for accepted ones, reasons else."""
    cen = census(lc, KEY) if cen is None else cen
    size = lc.groupBy("target").agg(F.count(F.lit(1)).alias("n_points"), (F.max("t") - F.min("t")).alias("baseline_days"))
    x = attach(attach(size, robust_scatter(lc, cen=cen), KEY, cen), cadence(lc, cen), KEY, cen, "left")
    x = attach(x, det.select("target", "sde"), KEY, cen, "left")
    error = (F.when(F.col("n_points") < minimum, F.lit("under the least number of samples"))
             .when(F.col("sde") >= K.SDE_THRESHOLD, F.format_string("not quiet: a dip of SDE %.1f", "sde")))
    x = x.withColumn("error", error).withColumn("accepted", F.col("error").isNull())
    keep = F.col("accepted")
    return x.select("target", "accepted", "sde", "error", *[F.when(keep, c).alias(n) for n, c in {
        "n_points": F.col("n_points"), "baseline_days": F.col("baseline_days"), "cadence_min": F.col("cadence") * 1440.0,
        "oot_scatter_ppm": F.col("sigma") * 1e6}.items()])


def noise_floor(manifest: DataFrame, value: str = "oot_scatter_ppm", key: str = "brightness_bin") -> DataFrame:
    return grouped_quantiles(manifest, [key], {"median_ppm": (value, 0.5)}, extra=[
        F.count(value).alias("n"), F.max(value).alias("max_ppm")])
