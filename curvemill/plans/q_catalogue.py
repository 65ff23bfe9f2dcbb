"""Queries of the table jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from curvemill import constants as K
from curvemill.functions import columns as C
from curvemill.operators import catalogue as cat
from curvemill.operators import clean
from curvemill.plans.registry import query
from curvemill.plans.views import ctes, table, view

CLASS_OF = "CASE label_idx WHEN 0 THEN 'transit' WHEN 1 THEN 'eclipse' WHEN 2 THEN 'blend' ELSE 'variable' END"
LABEL_SQL = """CASE WHEN koi_disposition = 'CONFIRMED' THEN 'transit'
 WHEN koi_disposition = 'FALSE POSITIVE' AND ss = 1 AND nt + co + ec = 0 THEN 'eclipse'
 WHEN koi_disposition = 'FALSE POSITIVE' AND nt = 1 AND ss + co + ec = 0 THEN 'variable'
 WHEN koi_disposition = 'FALSE POSITIVE' AND co + ec > 0 AND ss + nt = 0 THEN 'blend' END"""
LABELLED = f"labelled AS (SELECT *, 'KIC ' || kepid AS target FROM (SELECT *, {LABEL_SQL} AS label FROM koi) WHERE label IS NOT NULL)"
STAR = "star AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY mag, row_id) AS rn FROM labelled) WHERE rn = 1)"
BIN_SQL = "CASE " + " ".join(f"WHEN mission = '{m}' AND mag >= {lo} AND mag < {hi} THEN '{n}'" for m, bins in K.BRIGHTNESS_BINS.items() for n, lo, hi in bins) + " END"
BINNED = f"binned AS (SELECT *, {BIN_SQL} AS brightness_bin FROM manifest)"


def koi(spark, sf):
    return cat.label_first_catalogue(view(spark, sf, "koi"))


def attempts(spark, sf):
    a = view(spark, sf, "attempts")
    return a.withColumn("label", F.element_at(F.array(*[F.lit(c) for c in K.CATALOGUE_CLASSES]), (F.col("label_idx") + 1).cast("int")))


def binned(spark, sf):
    return view(spark, sf, "manifest").withColumn("brightness_bin", C.brightness_bin())


# -- labels and names -----------------------------------------------------------------------------------

@query("label_koi", ctes("koi") + f"SELECT row_id, {LABEL_SQL} AS label FROM koi")
def label_koi(spark, sf):
    return view(spark, sf, "koi").select("row_id", C.label_from_flags().alias("label"))


TOI = """toi AS (SELECT o_custkey AS tid, CASE WHEN o_orderstatus = 'O' AND o_totalprice > 200000 THEN 'CP' WHEN o_orderstatus = 'O' THEN 'KP'
  WHEN o_orderstatus = 'F' AND o_totalprice > 200000 THEN 'FP' WHEN o_orderstatus = 'F' THEN 'FA' ELSE 'PC' END AS code,
  9.0E0 + (o_custkey % 700) * 1.0E-2 AS mag, o_orderkey AS row_id FROM orders)"""


def toi(spark, sf):
    return table(spark, sf, "orders").selectExpr(
        "o_custkey AS tid", "CASE WHEN o_orderstatus = 'O' AND o_totalprice > 200000 THEN 'CP' WHEN o_orderstatus = 'O' THEN 'KP' "
        "WHEN o_orderstatus = 'F' AND o_totalprice > 200000 THEN 'FP' WHEN o_orderstatus = 'F' THEN 'FA' ELSE 'PC' END AS code",
        "9.0E0 + (o_custkey % 700) * 1.0E-2 AS mag", "o_orderkey AS row_id")


@query("label_toi", f"WITH {TOI} SELECT row_id, 'TIC ' || tid AS target, CASE WHEN code IN ('CP', 'KP') THEN 'transit' ELSE 'false_positive' END AS label FROM toi WHERE code <> 'PC'")
def label_toi(spark, sf):
    return cat.label_second_catalogue(toi(spark, sf)).select("row_id", "target", "label")


@query("normalize_id", """
SELECT c_custkey AS id, 'TIC ' || c_custkey AS built, nullif(regexp_replace(c_name, '[^0-9]', '', 'g'), '') AS digits, nullif(regexp_replace(c_mktsegment, '[^0-9]', '', 'g'), '') AS none FROM customer""")
def normalize_id(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), C.prefixed_id("TIC", "c_custkey").alias("built"), C.digits_of("c_name").alias("digits"), C.digits_of("c_mktsegment").alias("none"))


@query("brightness_bin", ctes("manifest", more=BINNED) + "SELECT target, mission, round(mag, 6) AS mag, brightness_bin FROM binned")
def brightness_bin(spark, sf):
    return binned(spark, sf).select("target", "mission", C.rd("mag").alias("mag"), "brightness_bin")


# -- observations -----------------------------------------------------------------------------------------

@query("obs_metadata_filter", ctes("obs") + "SELECT obsid, target, t_exptime FROM obs WHERE provenance = '1-URGENT' AND t_exptime BETWEEN 100 AND 140")
def obs_metadata_filter(spark, sf):
    return cat.metadata_filter(view(spark, sf, "obs"), {"provenance": "1-URGENT"}).select("obsid", "target", "t_exptime")


@query("exclude_segment", ctes("obs") + "SELECT obsid, mission FROM (SELECT obsid, 'Kepler Quarter 0' || sequence_number AS mission FROM obs) WHERE mission IS NULL OR mission NOT LIKE '%Quarter 00%'")
def exclude_segment(spark, sf):
    obs = view(spark, sf, "obs").select("obsid", F.concat(F.lit("Kepler Quarter 0"), F.col("sequence_number").cast("string")).alias("mission"))
    return cat.exclude_segment(obs)


GOOD_OBS = "good AS (SELECT * FROM obs WHERE obsid IN (SELECT obsid FROM prod WHERE subgroup = 'LC' AND data_uri IS NOT NULL))"


@query("obs_with_product", ctes("obs", "prod", more=GOOD_OBS) + "SELECT obsid, target FROM good")
def obs_with_product(spark, sf):
    return cat.with_product(view(spark, sf, "obs"), view(spark, sf, "prod")).select("obsid", "target")


@query("earliest_segment", ctes("obs", "prod", more=GOOD_OBS) + """
SELECT target, obsid, sequence_number FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY coalesce(sequence_number, 0), coalesce(obsid, 0)) AS rn FROM good) WHERE rn = 1""")
def earliest_segment(spark, sf):
    good = cat.with_product(view(spark, sf, "obs"), view(spark, sf, "prod"))
    return cat.earliest_segment(good).select("target", "obsid", "sequence_number")


@query("segment_pick", ctes("obs", "manifest") + """
, r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY obsid) - 1 AS k, count(*) OVER (PARTITION BY target) AS n FROM obs),
s AS (SELECT r.*, CASE WHEN segment IS NOT NULL AND n > 1 THEN segment % n ELSE 0 END AS f FROM r LEFT JOIN manifest m ON m.target = 'KIC ' || r.target)
SELECT target, obsid FROM s WHERE k >= f AND k < f + 2""")
def segment_pick(spark, sf):
    choice = view(spark, sf, "manifest").select(C.digits_of("target").cast("bigint").alias("target"), "segment")
    return cat.pick_segments(view(spark, sf, "obs"), choice, F.col("obsid"), 2).select("target", "obsid")


_STITCHED = ctes("lc_user") + """
SELECT target, count(*) AS n, round(min(t), 6) AS first_t, round(max(t), 6) AS last_t, round(sum(flux), 4) AS total FROM lc_user GROUP BY target"""


def _stitched(parts):
    return cat.stitch(*parts).groupBy("target").agg(
        F.count(F.lit(1)).alias("n"), C.rd(F.min("t")).alias("first_t"), C.rd(F.max("t")).alias("last_t"), C.rd(F.sum("flux"), 4).alias("total"))


@query("stitch_segments", _STITCHED)
def stitch_segments(spark, sf):
    """Adjoining segments, and samples without a time in the first: stitched, they hold every row."""
    lc, t = view(spark, sf, "lc_user"), F.col("t")
    return _stitched([lc.where((t < 7) | t.isNull()), *[lc.where((t >= a) & (t < a + 7)) for a in (7, 14, 21)], lc.where(t >= 28)])


@query("stitch_segments_whole", _STITCHED)
def stitch_segments_whole(spark, sf):
    """The same from three segments, the middle one long."""
    lc, t = view(spark, sf, "lc_user"), F.col("t")
    return _stitched([lc.where((t < 3) | t.isNull()), lc.where((t >= 3) & (t < 25)), lc.where(t >= 25)])


# -- rows and errors ----------------------------------------------------------------------------------------

@query("usable_rows", ctes("attempts") + f"SELECT target, shard, seed, label FROM (SELECT *, {CLASS_OF} AS label FROM attempts) WHERE error IS NULL AND label IN ('transit', 'eclipse', 'blend')")
def usable_rows(spark, sf):
    return clean.usable_rows(attempts(spark, sf), K.GEOMETRIC_CLASSES).select("target", "shard", "seed", "label")


@query("inf_to_null", ctes("recovery") + """
SELECT seed, k, CASE WHEN fit_depth_err = 0 THEN NULL ELSE round(fit_depth / fit_depth_err, 6) END AS ratio FROM recovery""")
def inf_to_null(spark, sf):
    r = view(spark, sf, "recovery").select("seed", "k", F.when(F.col("fit_depth_err") == 0, float("inf")).otherwise(
        F.try_divide("fit_depth", "fit_depth_err")).alias("ratio"))
    return clean.inf_to_null(r, ["ratio"]).select("seed", "k", C.rd("ratio").alias("ratio"))


@query("settled_errors", ctes("attempts") + """
SELECT target, count(*) FILTER (error IS NULL OR starts_with(error, 'no detection')) AS settled, count(*) FILTER (NOT starts_with(error, 'no detection')) AS retryable FROM attempts GROUP BY target""")
def settled_errors(spark, sf):
    return view(spark, sf, "attempts").groupBy("target").agg(F.count_if(C.settled()).alias("settled"), F.count_if(~C.settled()).alias("retryable"))


@query("resume_anti_join", ctes("attempts") + """
SELECT DISTINCT label_idx, seed FROM attempts WHERE (label_idx, seed) NOT IN (SELECT label_idx, seed FROM attempts WHERE error IS NULL)""")
def resume_anti_join(spark, sf):
    a = view(spark, sf, "attempts")
    return cat.remaining(a.select("label_idx", "seed").distinct(), a.where(F.col("error").isNull()), ["label_idx", "seed"])


@query("exclude_known", ctes("manifest", "koi", more=LABELLED) + "SELECT target, mission FROM manifest WHERE target NOT IN (SELECT target FROM labelled)")
def exclude_known(spark, sf):
    return cat.remaining(view(spark, sf, "manifest"), koi(spark, sf), ["target"]).select("target", "mission")


SPLIT = BINNED + """, h AS (SELECT *, row_number() OVER (PARTITION BY brightness_bin ORDER BY md5(target || '#0'), target) AS rn, count(*) OVER (PARTITION BY brightness_bin) AS n FROM binned WHERE brightness_bin IS NOT NULL),
parts AS (SELECT target, brightness_bin, CASE WHEN rn <= greatest(1, round_even(n * 2.5E-1, 0)) THEN 'test' ELSE 'train' END AS split FROM h)"""


def split_manifest(spark, sf):
    return cat.baseline_split(binned(spark, sf).where(F.col("brightness_bin").isNotNull()))


@query("baseline_split", ctes("manifest", more=SPLIT) + "SELECT * FROM parts")
def baseline_split(spark, sf):
    return split_manifest(spark, sf).select("target", "brightness_bin", "split")


@query("semi_split", ctes("manifest", "attempts", more=SPLIT) + "SELECT target, shard, seed FROM attempts WHERE target IN (SELECT target FROM parts WHERE split = 'test')")
def semi_split(spark, sf):
    test = split_manifest(spark, sf).where(F.col("split") == "test").select("target")
    return view(spark, sf, "attempts").join(test, "target", "left_semi").select("target", "shard", "seed")


@query("stratified_sample", ctes("manifest", more=BINNED) + """
SELECT target, mission, brightness_bin FROM (SELECT *, row_number() OVER (PARTITION BY mission, brightness_bin ORDER BY md5(target || '#17'), target) AS rn FROM binned WHERE brightness_bin IS NOT NULL) WHERE rn <= 40""")
def stratified_sample(spark, sf):
    m = binned(spark, sf).where(F.col("brightness_bin").isNotNull())
    return cat.stratified_sample(m, 40, seed=17).select("target", "mission", "brightness_bin")


_PICK = "CAST('0x' || substr(md5('{part}#' || draw || '#5'), 1, 8) AS BIGINT)"


@query("two_stage_draw", ctes("manifest", more=BINNED) + f"""
, m AS (SELECT *, row_number() OVER (PARTITION BY brightness_bin ORDER BY md5(target || '#5'), target) AS rank, count(*) OVER (PARTITION BY brightness_bin) AS n FROM binned WHERE brightness_bin IS NOT NULL),
b AS (SELECT brightness_bin, row_number() OVER (ORDER BY brightness_bin) AS bin, count(*) OVER () AS bins FROM (SELECT DISTINCT brightness_bin FROM m)),
d AS (SELECT draw, {_PICK.format(part="bin")} AS x, {_PICK.format(part="row")} AS y FROM (SELECT DISTINCT CAST(substr(target, 5) AS BIGINT) AS draw FROM manifest))
SELECT draw, target, mission, brightness_bin FROM d JOIN b ON b.bin = d.x % b.bins + 1 JOIN m USING (brightness_bin) WHERE m.rank = d.y % m.n + 1""")
def two_stage_draw(spark, sf):
    """As many draws as the manifest has targets, which are numbered from 0."""
    m = binned(spark, sf)
    return cat.two_stage_draw(m, m.count(), seed=5).select("draw", "target", "mission", "brightness_bin")


@query("stratified_split", ctes("koi", more=LABELLED) + """
, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(row_id || '#0'), row_id) AS rn, count(*) OVER (PARTITION BY label) AS n FROM labelled)
SELECT row_id, label, CASE WHEN rn <= ceil(n * 6.0E-1) THEN 'train' WHEN rn <= ceil(n * 8.0E-1) THEN 'cal' ELSE 'test' END AS split FROM r""")
def stratified_split(spark, sf):
    return cat.stratified_split(koi(spark, sf), "row_id", "label", {"train": 0.6, "cal": 0.2, "test": 0.2}).select("row_id", "label", "split")


@query("group_split", ctes("koi", more=LABELLED) + """
, g AS (SELECT target, row_number() OVER (ORDER BY md5(target || '#0'), target) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT target FROM labelled))
SELECT row_id, target, CASE WHEN rn <= ceil(n * 3.5E-1) THEN 'test' ELSE 'train' END AS split FROM labelled JOIN g USING (target)""")
def group_split(spark, sf):
    return cat.group_split(koi(spark, sf), 0.35).select("row_id", "target", "split")


@query("leakage_check", ctes("koi", more=LABELLED) + """
SELECT count(*) AS shared FROM (SELECT target FROM labelled WHERE mission = 'kepler' INTERSECT SELECT target FROM labelled WHERE mission = 'tess')""")
def leakage_check(spark, sf):
    k = koi(spark, sf)
    return cat.shared_targets(k.where(F.col("mission") == "kepler"), k.where(F.col("mission") == "tess")).agg(F.count(F.lit(1)).alias("shared"))


@query("published_lookup", ctes("det_user", "koi", more=LABELLED + ", " + STAR) + """
SELECT d.target, d.period, s.published_period, s.label FROM det_user d LEFT JOIN star s ON 'KIC ' || substr(d.target, 2) = s.target""")
def published_lookup(spark, sf):
    pub = cat.dedupe_brightest(koi(spark, sf), "row_id").select(
        F.concat(F.lit("U"), C.digits_of("target")).alias("target"), "published_period", "label")
    return view(spark, sf, "det_user").join(pub, "target", "left").select("target", "period", "published_period", "label")


HARM = "CASE " + " ".join(f"WHEN abs(fit_period / true_period / {m} - 1) < 2.0E-2 THEN {m}" for m in ("1.0E0", "2.0E0", "5.0E-1", "3.0E0", "(1.0E0 / 3.0E0)")) + " END"


@query("harmonic_match", ctes("recovery") + f"SELECT seed, k, round({HARM}, 6) AS multiple FROM recovery")
def harmonic_match(spark, sf):
    r = view(spark, sf, "recovery")
    return r.select("seed", "k", C.rd(cat.harmonic_match(F.col("fit_period"), F.col("true_period"))).alias("multiple"))


@query("harmonic_error", ctes("recovery") + """
, r AS (SELECT *, fit_period / true_period AS r FROM recovery), e AS (SELECT *, least(abs(r - 1), abs(r - 2) / 2, abs(r - 5.0E-1) * 2) AS err FROM r)
SELECT seed, k, round(err, 8) AS err, err < 1.0E-2 AS ok FROM e""")
def harmonic_error(spark, sf):
    e = C.harmonic_error("fit_period", "true_period")
    return view(spark, sf, "recovery").select("seed", "k", C.rd(e, 8).alias("err"), (e < 0.01).alias("ok"))


@query("event_coverage", ctes("lc_user", "det_user") + """
, g AS (SELECT target, t, t - lag(t) OVER (PARTITION BY target ORDER BY t) AS dt FROM lc_user),
s AS (SELECT target, median(dt) AS cad, min(t) AS lo, max(t) AS hi FROM g GROUP BY target),
w AS (SELECT s.*, period, t0, duration, unnest(range(CAST(floor((lo - t0) / period) - 1 AS BIGINT), CAST(ceil((hi - t0) / period) + 2 AS BIGINT))) AS k FROM s JOIN det_user USING (target)),
c AS (SELECT target, cad, greatest(t0 + k * period - duration / 2, lo) AS a, least(t0 + k * period + duration / 2, hi) AS b FROM w
      WHERE t0 + k * period + duration / 2 >= lo AND t0 + k * period - duration / 2 <= hi),
x AS (SELECT target, sum((b - a) / cad) AS expected FROM c GROUP BY target),
y AS (SELECT c.target, count(*) AS got FROM c JOIN lc_user l ON l.target = c.target AND l.t >= c.a AND l.t <= c.b GROUP BY c.target)
SELECT d.target, round(coalesce(CASE WHEN expected < 1 THEN 0 ELSE least(coalesce(got, 0) / expected, 1) END, 0), 6) AS coverage FROM det_user d LEFT JOIN x USING (target) LEFT JOIN y USING (target)""")
def event_coverage(spark, sf):
    c = cat.event_coverage(view(spark, sf, "lc_user"), view(spark, sf, "det_user"))
    return c.select("target", C.rd("coverage").alias("coverage"))


# -- counts and summaries --------------------------------------------------------------------------------------

@query("class_counts", ctes("koi", more=LABELLED) + "SELECT mission, label, count(*) AS n FROM labelled GROUP BY ALL")
def class_counts(spark, sf):
    return cat.class_counts(koi(spark, sf), "mission", "label")


@query("detection_rate", ctes("attempts") + f"""
SELECT label, round_even(avg(CASE WHEN error IS NULL THEN 1.0E0 ELSE 0.0E0 END) * 1000, 0) / 1000 AS rate FROM (SELECT *, {CLASS_OF} AS label FROM attempts) GROUP BY label""")
def detection_rate(spark, sf):
    return attempts(spark, sf).groupBy("label").agg(C.rint_at(F.avg(F.col("error").isNull().cast("double")), 3).alias("rate"))


@query("failure_reasons", ctes("attempts") + "SELECT substr(error, 1, 45) AS reason, count(*) AS n FROM attempts WHERE error IS NOT NULL GROUP BY 1 ORDER BY n DESC, reason LIMIT 8")
def failure_reasons(spark, sf):
    return cat.failure_reasons(view(spark, sf, "attempts"))


VET = """m AS (SELECT target, count(*) AS n, max(t) - min(t) AS span, median(flux) AS med FROM lc_user GROUP BY target),
g AS (SELECT target, flux, t - lag(t) OVER (PARTITION BY target ORDER BY t) AS dt FROM lc_user),
v AS (SELECT target, any_value(n) AS n, any_value(span) AS span, median(dt) AS cad, 1.4826E0 * median(abs(flux - med)) AS sigma FROM g JOIN m USING (target) GROUP BY target),
vet AS (SELECT target, sde, n, span, cad, sigma, CASE WHEN n < 60 THEN 'under the least number of samples' WHEN sde >= 7 THEN printf('not quiet: a dip of SDE %.1f', sde) END AS error FROM v JOIN det_user USING (target))"""


@query("baseline_vetting", ctes("lc_user", "det_user", more=VET) + """
SELECT target, error IS NULL AS accepted, round(sde, 6) AS sde, error, CASE WHEN error IS NULL THEN n END AS n_points, CASE WHEN error IS NULL THEN round(span, 6) END AS baseline_days,
CASE WHEN error IS NULL THEN round(cad * 1440, 6) END AS cadence_min, CASE WHEN error IS NULL THEN round(sigma * 1.0E6, 4) END AS oot_scatter_ppm FROM vet""")
def baseline_vetting(spark, sf):
    v = cat.vet_baselines(view(spark, sf, "lc_user"), view(spark, sf, "det_user"), 60)
    return v.select("target", "accepted", C.rd("sde").alias("sde"), "error", "n_points", C.rd("baseline_days").alias("baseline_days"),
                    C.rd("cadence_min").alias("cadence_min"), C.rd("oot_scatter_ppm", 4).alias("oot_scatter_ppm"))


@query("noise_floor_by_bin", ctes("lc_user", "det_user", "manifest", more=VET + ", " + BINNED) + """
SELECT brightness_bin, count(*) AS n, round(median(sigma * 1.0E6), 4) AS median_ppm, round(max(sigma * 1.0E6), 4) AS max_ppm
FROM vet JOIN binned b ON b.target = 'KIC ' || substr(vet.target, 2) WHERE error IS NULL AND brightness_bin IS NOT NULL GROUP BY brightness_bin""")
def noise_floor_by_bin(spark, sf):
    v = cat.vet_baselines(view(spark, sf, "lc_user"), view(spark, sf, "det_user"), 60).where("accepted")
    m = binned(spark, sf).where(F.col("brightness_bin").isNotNull())
    j = v.withColumn("target", F.concat(F.lit("KIC "), C.digits_of("target"))).join(m, "target")
    return cat.noise_floor(j).select("brightness_bin", "n", C.rd("median_ppm", 4).alias("median_ppm"), C.rd("max_ppm", 4).alias("max_ppm"))


PLAN = f"""sky AS (SELECT * REPLACE (CASE mission WHEN 'tess' THEN 'TIC' ELSE 'KIC' END || substr(target, 4) AS target) FROM star),
done AS (SELECT *, {CLASS_OF} AS label FROM attempts),
tried AS (SELECT DISTINCT target FROM done WHERE error IS NULL OR starts_with(error, 'no detection')),
free AS (SELECT * FROM sky WHERE target NOT IN (SELECT target FROM tried)),
plan AS (SELECT a.label, coalesce(have, 0) AS have, greatest(0, 10000 - coalesce(have, 0)) AS deficit, greatest(CASE WHEN coalesce(tries, 0) >= 20 THEN have / tries::DOUBLE ELSE 6.0E-1 END, 1.5E-1) AS rate, coalesce(pool, 0) AS pool
 FROM (SELECT DISTINCT label FROM sky) a LEFT JOIN (SELECT label, count(*) AS tries, count(*) FILTER (error IS NULL) AS have FROM done GROUP BY label) USING (label)
 LEFT JOIN (SELECT label, count(*) AS pool FROM free GROUP BY label) USING (label)),
sized AS (SELECT *, CAST(ceil(deficit / rate) AS BIGINT) AS need FROM plan)"""


def sky(spark, sf):
    star = cat.dedupe_brightest(koi(spark, sf), "row_id")
    prefix = F.when(F.col("mission") == "tess", "TIC ").otherwise("KIC ")
    return star.withColumn("target", F.concat(prefix, C.digits_of("target")))


@query("acquisition_plan", ctes("koi", "attempts", more=f"{LABELLED}, {STAR}, {PLAN}") + "SELECT label, have, deficit, round(rate, 6) AS rate, need, pool, least(need, pool) AS take FROM sized")
def acquisition_plan(spark, sf):
    p = cat.acquisition_plan(sky(spark, sf), attempts(spark, sf), 10000)
    return p.withColumn("rate", C.rd("rate"))


@query("plan_take", ctes("koi", "attempts", more=f"{LABELLED}, {STAR}, {PLAN}") + """
, r AS (SELECT f.*, row_number() OVER (PARTITION BY label ORDER BY mag, target) AS rn FROM free f)
SELECT target, label, deficit, CAST(rn AS INT) AS rn FROM r JOIN sized USING (label) WHERE rn <= least(need, pool) ORDER BY deficit DESC, label, rn""")
def plan_take(spark, sf):
    p = cat.plan_take(sky(spark, sf), attempts(spark, sf), 10000)
    return p.select("target", "label", "deficit", "rn")


@query("distinct_targets", ctes("attempts") + "SELECT label_idx, count(DISTINCT target) AS targets FROM attempts GROUP BY label_idx")
def distinct_targets(spark, sf):
    return view(spark, sf, "attempts").groupBy("label_idx").agg(F.count_distinct("target").alias("targets"))


# -- top rows -----------------------------------------------------------------------------------------------

@query("dedupe_brightest", ctes("koi", more=f"{LABELLED}, {STAR}") + "SELECT target, label, mission, round(mag, 6) AS mag, row_id FROM star")
def dedupe_brightest(spark, sf):
    return cat.dedupe_brightest(koi(spark, sf), "row_id").select("target", "label", "mission", C.rd("mag").alias("mag"), "row_id")


@query("cap_per_class", ctes("koi", more=f"{LABELLED}, {STAR}") + """
SELECT target, mission, label FROM (SELECT *, row_number() OVER (PARTITION BY mission, label ORDER BY mag, target) AS rn FROM star) WHERE rn <= 25""")
def cap_per_class(spark, sf):
    return cat.cap_per_class(cat.dedupe_brightest(koi(spark, sf), "row_id"), 25).select("target", "mission", "label")


@query("merge_prefer_success", ctes("attempts") + """
SELECT target, shard, seed, error FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY error IS NOT NULL, seed, shard, label_idx) AS rn FROM attempts) WHERE rn = 1""")
def merge_prefer_success(spark, sf):
    return cat.merge_prefer_success(view(spark, sf, "attempts"), ["target"], ["seed", "shard", "label_idx"]).select("target", "shard", "seed", "error")


@query("dedupe_keyed", ctes("attempts") + """
, f AS (SELECT *, row_number() OVER (PARTITION BY label_idx, seed ORDER BY shard, target, error) AS rn FROM attempts),
l AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY seed DESC, shard DESC, label_idx DESC) AS r2 FROM f WHERE rn = 1)
SELECT target, label_idx, seed, shard FROM l WHERE r2 = 1""")
def dedupe_keyed(spark, sf):
    first = cat.keep_first(view(spark, sf, "attempts"), ["label_idx", "seed"], ["shard", "target", "error"])
    return cat.keep_last(first, ["target"], ["seed", "shard", "label_idx"]).select("target", "label_idx", "seed", "shard")


# -- set operations --------------------------------------------------------------------------------------------

@query("union_catalogs", ctes("koi", more=f"{LABELLED}, {TOI}") + """
SELECT target, label, mission, round(mag, 6) AS mag, published_period, row_id FROM labelled
UNION ALL SELECT 'TIC ' || tid, CASE WHEN code IN ('CP', 'KP') THEN 'transit' ELSE 'false_positive' END, 'tess', round(mag, 6), NULL, row_id FROM toi WHERE code <> 'PC'""")
def union_catalogs(spark, sf):
    a = koi(spark, sf).select("target", "label", "mission", "mag", "published_period", "row_id")
    b = cat.label_second_catalogue(toi(spark, sf)).select("target", "label", F.lit("tess").alias("mission"), "mag", "row_id")
    return a.unionByName(b, allowMissingColumns=True).withColumn("mag", C.rd("mag"))


@query("class_except", ctes("koi", "attempts", more=LABELLED) + f"SELECT label FROM (SELECT label FROM labelled EXCEPT SELECT label FROM (SELECT {CLASS_OF} AS label, target FROM attempts) WHERE label = 'variable')")
def class_except(spark, sf):
    # a few labels on either side: without the copies nothing but labels is joined
    drop = attempts(spark, sf).where(F.col("label") == "variable").select("label").distinct()
    return koi(spark, sf).select("label").distinct().subtract(drop)
