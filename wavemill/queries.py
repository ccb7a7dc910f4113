"""Queries by name over the test tables, and the SQL that must give the same rows.

Embeddings stand in for voiceprints and short waveforms, documents and
conversations for transcripts, events for signals.  Computed doubles are
rounded to six places on both sides; nothing is filtered on a rounded value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import PROFILES
from .functions import arrays as A
from .functions import digits, spectral
from .functions import text as X
from .models import registry
from .operators import detect, fuse, gate, grid, metrics, recordings, sampling, sets, windows
from .sources import scratch
from .sources.batchlog import BatchLog, in_batches

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

_W = PROFILES["default"].weights
_SIMS = ["cam", "eres", "rnet"]


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c):
    return F.round(c, 6)


# ---------------------------------------------------------------- embeddings

_E = "SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings"


def _emb(spark, sf):
    return t(spark, sf, "embeddings").select("vec_id", "label", A.doubles("embedding").alias("x"))


def _pairs(spark, sf):
    a = _emb(spark, sf)
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("label").alias("label2"), F.col("x").alias("y"))
    return a.join(b, "vec_id").select(F.col("vec_id").alias("id"), (F.col("label") == F.col("label2")).alias("pos"), "x", "y")


_PAIRS = f"p AS (SELECT a.vec_id AS id, a.label = b.label AS pos, a.x, b.x AS y FROM ({_E}) a JOIN ({_E}) b ON b.vec_id = a.vec_id + 1)"


def _sql_cos(a: str, b: str) -> str:
    return f"list_inner_product({a}, {b}) / (sqrt(list_inner_product({a}, {a})) * sqrt(list_inner_product({b}, {b})) + 1e-8)"


_CUTS = [(1, 21), (22, 21), (43, 22)]
_TRIALS = f"{_PAIRS}, s AS (SELECT id, pos, " + ", ".join(f"{_sql_cos(f'x[{k}:{k + n - 1}]', f'y[{k}:{k + n - 1}]')} AS {c}" for c, (k, n) in zip(_SIMS, _CUTS)) + " FROM p)"
_FUSED = f"""{_TRIALS}, m AS (SELECT {", ".join(f"avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s" for c in _SIMS)} FROM s),
    z AS (SELECT s.*, {", ".join(f"({c} - {c}_m) / ({c}_s + 1e-8) AS {c}_z" for c in _SIMS)} FROM s, m),
    f AS (SELECT *, {" + ".join(f"{w} * {c}_z" for w, c in zip(_W, _SIMS))} AS fused FROM z)"""


def trials(spark, sf):
    p = _pairs(spark, sf)
    return p.select("id", "pos", *[A.cosine(F.slice("x", k, n), F.slice("y", k, n)).alias(c) for c, (k, n) in zip(_SIMS, _CUTS)])


@query(f"WITH {_PAIRS} SELECT id, pos, round({_sql_cos('x', 'y')}, 6) AS sim FROM p")
def cosine_trials(spark, sf):
    return _pairs(spark, sf).select("id", "pos", r6(A.cosine(F.col("x"), F.col("y"))).alias("sim"))


@query(f"WITH {_FUSED} SELECT id, pos, round(fused, 6) AS fused, fused >= -0.22 AS is_target FROM f")
def zscore_fuse(spark, sf):
    d = fuse.zscore_fuse(trials(spark, sf), _SIMS, _W)
    return d.select("id", "pos", r6(F.col("fused")).alias("fused"), fuse.accept(F.col("fused"), -0.22).alias("is_target"))


@query(f"WITH {_FUSED} SELECT id, pos, round(fused, 6) AS fused, fused >= -0.22 AS is_target FROM f")
def resumed_fusion(spark, sf):
    """Trials in four batches, of which a first run does the first two thirds of the rows; the moments are merged from those of the batches."""
    d, folder = trials(spark, sf), scratch.new_folder(spark, "resumed")
    log, stats = BatchLog(spark, f"{folder}/trials"), BatchLog(spark, f"{folder}/moments")
    in_batches(d.where("id % 3 > 0"), log, "id", 4, lambda x: x)
    done = in_batches(d, log, "id", 4, lambda x: x)
    for e in log.entries():
        stats.append(fuse.partial_moments(done.where(F.col("batch") == e["batch"]), _SIMS, ["batch"]))
    out = fuse.zscore_fuse(done, _SIMS, _W, fuse.as_statistics(fuse.merged_moments(stats.read()), _SIMS))
    return out.select("id", "pos", r6(F.col("fused")).alias("fused"), fuse.accept(F.col("fused"), -0.22).alias("is_target"))


@query("SELECT user_id, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events GROUP BY user_id")
def merged_moments(spark, sf):
    """Moments of each user, merged from those of its types of events."""
    parts = fuse.partial_moments(t(spark, sf, "events"), ["value"], ["user_id", "event_type"])
    m = fuse.merged_moments(parts, ["user_id"])
    return m.select("user_id", "n", r6("mean").alias("mean"), r6(F.sqrt(F.col("m2") / F.col("n"))).alias("std"))


@query(f"WITH {_FUSED} SELECT count(*) FILTER (fused >= -0.22) AS accepted, count(*) FILTER (fused < -0.22) AS rejected, round(avg((fused >= -0.22)::INT) FILTER (pos), 6) AS pos_rate, round(avg((fused < -0.22)::INT) FILTER (NOT pos), 6) AS rr FROM f")
def accept_counts(spark, sf):
    d = fuse.zscore_fuse(trials(spark, sf), _SIMS, _W).withColumn("hit", fuse.accept(F.col("fused"), -0.22))
    return d.agg(
        F.count_if("hit").alias("accepted"), F.count_if(~F.col("hit")).alias("rejected"),
        r6(F.avg(F.when(F.col("pos"), F.col("hit").cast("int")))).alias("pos_rate"), r6(F.avg(F.when(~F.col("pos"), (~F.col("hit")).cast("int")))).alias("rr"),
    )


@query(f"""WITH {_FUSED}, g AS (SELECT range AS t FROM range(200)),
    q AS (SELECT t, (count(*) FILTER (pos AND fused < t / 200.0::DOUBLE) / nullif(count(*) FILTER (pos), 0) + count(*) FILTER (NOT pos AND fused >= t / 200.0::DOUBLE) / nullif(count(*) FILTER (NOT pos), 0)) / 2 AS h FROM f, g GROUP BY t)
    SELECT round(h, 6) AS min_hter, round(t / 200.0::DOUBLE, 6) AS threshold FROM q ORDER BY h, t LIMIT 1""")
def min_hter_scan(spark, sf):
    d = fuse.zscore_fuse(trials(spark, sf), _SIMS, _W)
    return metrics.min_half_total_error(d, "fused", "pos").select(r6("min_hter").alias("min_hter"), r6("threshold").alias("threshold"))


_GRID = f"""{_FUSED}, w(w_id, w0, w1, w2) AS (VALUES {", ".join(f"({i}, {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for i, (a, b, c) in enumerate(grid.WEIGHTS))}),
    h AS (SELECT range AS t_id, (range - 35) / 100.0::DOUBLE AS threshold FROM range(40)),
    c AS (SELECT w_id, t_id, threshold, pos, 5 + id % 7 AS n, w0 * cam_z + w1 * eres_z + w2 * rnet_z >= threshold AS hit FROM f, w, h),
    q AS (SELECT w_id, t_id, threshold, sum(n) FILTER (pos AND NOT hit) / sum(n) FILTER (pos) AS cer, 1 - count(*) FILTER (NOT pos AND hit) / count(*) FILTER (NOT pos) AS rr FROM c GROUP BY ALL),
    b AS (SELECT *, (1 - coalesce(cer, 0)) * 40 + rr * 40 AS score FROM q)"""


def _grid(spark, sf):
    d = trials(spark, sf).withColumn("n", 5 + F.col("id") % 7)
    return grid.grid_scores(d, _SIMS, "pos", "n")


@query(f"WITH {_GRID} SELECT w_id::INT AS w_id, t_id::INT AS t_id, round(threshold, 6) AS threshold, round(coalesce(cer, 0), 6) AS cer, round(rr, 6) AS rr, round(score, 6) AS score FROM b")
def grid_search(spark, sf):
    return _grid(spark, sf).select("w_id", "t_id", r6("threshold").alias("threshold"), r6("cer").alias("cer"), r6("rr").alias("rr"), r6("score").alias("score"))


@query(f"WITH {_GRID} SELECT w_id::INT AS w_id, t_id::INT AS t_id, round(score, 6) AS score FROM b ORDER BY b.score DESC, w_id, t_id LIMIT 1")
def grid_best(spark, sf):
    return grid.best_point(_grid(spark, sf)).select("w_id", "t_id", r6("score").alias("score"))


@query(f"WITH {_TRIALS} SELECT id, round({' + '.join(f'{w} * {c}' for w, c in zip(_W, _SIMS))}, 6) AS sim FROM s")
def abs_fusion(spark, sf):
    return trials(spark, sf).select("id", r6(A.weighted_sum([F.col(c) for c in _SIMS], list(_W))).alias("sim"))


def _sql_unit(v: str, k: int, n: int, w: float) -> str:
    s = f"{v}[{k}:{k + n - 1}]"
    return f"list_transform({s}, lambda e: {w} * e / sqrt(list_inner_product({s}, {s})))"


_CAT = {v: "list_concat(list_concat(" + _sql_unit(v, *_CUTS[0], _W[0]) + ", " + _sql_unit(v, *_CUTS[1], _W[1]) + "), " + _sql_unit(v, *_CUTS[2], _W[2]) + ")" for v in "xy"}


@query(f"WITH {_PAIRS}, c AS (SELECT id, {_CAT['x']} AS a, {_CAT['y']} AS b FROM p) SELECT id, round({_sql_cos('a', 'b')}, 6) AS sim FROM c")
def concat_fusion(spark, sf):
    cat = lambda v: A.weighted_concat([F.slice(v, k, n) for k, n in _CUTS], list(_W))
    return _pairs(spark, sf).select("id", cat("x").alias("a"), cat("y").alias("b")).select("id", r6(A.cosine(F.col("a"), F.col("b"))).alias("sim"))


@query(f"SELECT vec_id, round(sqrt(list_inner_product(x, x) / len(x)) + 1e-9, 6) AS rms, round(list_inner_product(x, x), 6) AS energy FROM ({_E})")
def rms_energy(spark, sf):
    return _emb(spark, sf).select("vec_id", r6(A.rms(F.col("x"))).alias("rms"), r6(A.energy(F.col("x"))).alias("energy"))


_HALF = [f"sqrt(list_inner_product(x[{a}:{b}], x[{a}:{b}]) / 32) + 1e-9" for a, b in ((1, 32), (33, 64))]


@query(f"SELECT vec_id, least({_HALF[0]}, {_HALF[1]}) / greatest({_HALF[0]}, {_HALF[1]}) < 0.75 AS single, CASE WHEN list_inner_product(x[1:32], x[1:32]) >= list_inner_product(x[33:64], x[33:64]) THEN 0 ELSE 1 END AS loudest FROM ({_E})")
def single_speaker(spark, sf):
    tracks = F.array(F.slice("x", 1, 32), F.slice("x", 33, 32))
    return _emb(spark, sf).select("vec_id", A.single_speaker(tracks, 0.75).alias("single"), A.argmax_energy(tracks).cast("int").alias("loudest"))


_PEAK = "list_max(list_transform(x, lambda e: abs(e)))"


@query(f"SELECT vec_id, list_transform(x, lambda e: round(e / {_PEAK}, 6)) AS y FROM ({_E})")
def peak_norm(spark, sf):
    return _emb(spark, sf).select("vec_id", F.transform(A.peak_normalise(F.col("x")), A.rounded).alias("y"))


_LOUD = "list_transform(x, lambda e: abs(e) > 0.1)"


@query(f"SELECT vec_id, list_transform(CASE WHEN list_contains({_LOUD}, true) THEN x[list_position({_LOUD}, true):len(x) - list_position(list_reverse({_LOUD}), true) + 1] ELSE x END, lambda e: round(e, 6)) AS y FROM ({_E})")
def trim_silence(spark, sf):
    return _emb(spark, sf).select("vec_id", F.transform(A.trim_silence(F.col("x"), 0.1), A.rounded).alias("y"))


@query(f"SELECT vec_id, list_transform(x, lambda e: round(greatest(-1, least(1, e * 8)), 6)) AS y FROM ({_E})")
def clip(spark, sf):
    return _emb(spark, sf).select("vec_id", F.transform(A.clip(F.transform("x", lambda e: e * 8)), A.rounded).alias("y"))


@query(f"SELECT vec_id, list_transform(list_transform(x, lambda e: e * 4), lambda e: round(CASE WHEN 4 * {_PEAK} > 1 THEN e / (4 * {_PEAK}) * 0.99 ELSE e END, 6)) AS y FROM ({_E})")
def peak_limit(spark, sf):
    return _emb(spark, sf).select("vec_id", F.transform(A.peak_limit(F.transform("x", lambda e: e * 4)), A.rounded).alias("y"))


@query(f"SELECT vec_id, list_transform(x[5:24], lambda e: round(e, 6)) AS crop, list_transform(list_concat(list_concat(x, x), x)[1:150], lambda e: round(e, 6)) AS tile, list_transform(list_concat(x, [0.0::DOUBLE, 0.0, 0.0, 0.0])[1:68], lambda e: round(e, 6)) AS pad FROM ({_E})")
def crop_pad(spark, sf):
    show = lambda c: F.transform(c, A.rounded)
    return _emb(spark, sf).select("vec_id", show(A.crop_or_tile(F.col("x"), 20, 4)).alias("crop"), show(A.crop_or_tile(F.col("x"), 150)).alias("tile"), show(A.fit_length(F.col("x"), 68)).alias("pad"))


@query(f"SELECT vec_id, k::INT AS segment, list_transform(x[k * 24 + 1:k * 24 + 24], lambda e: round(e, 6)) AS samples FROM ({_E}), (SELECT range AS k FROM range(2))")
def segment(spark, sf):
    d = _emb(spark, sf).select("vec_id", F.posexplode(A.segments(F.col("x"), 24)).alias("segment", "s"))
    return d.select("vec_id", "segment", F.transform("s", A.rounded).alias("samples"))


@query(f"SELECT vec_id, k::INT AS frame, round(list_sum(x[k * 8 + 1:k * 8 + 32]), 6) AS total FROM ({_E}), (SELECT range AS k FROM range(5))")
def stft_frames(spark, sf):
    d = _emb(spark, sf).select("vec_id", F.posexplode(A.frames(F.col("x"), 32, 8)).alias("frame", "s"))
    return d.select("vec_id", "frame", r6(A.total(F.col("s"))).alias("total"))


@query(f"SELECT vec_id, list_transform(range(32), lambda i: round(x[floor(i * 63 / 31.0::DOUBLE)::INT + 1] + (i * 63 / 31.0::DOUBLE - floor(i * 63 / 31.0::DOUBLE)) * (x[least(floor(i * 63 / 31.0::DOUBLE)::INT + 2, 64)] - x[floor(i * 63 / 31.0::DOUBLE)::INT + 1]), 6)) AS y FROM ({_E})")
def resample_linear(spark, sf):
    return _emb(spark, sf).select("vec_id", F.transform(A.resample_linear(F.col("x"), 16000, 8000), A.rounded).alias("y"))


@query(f"""WITH {_PAIRS}, c AS (SELECT id, list_transform(x, lambda e: e - list_sum(x) / 64) AS c, list_transform(y, lambda e: e - list_sum(y) / 64) AS e FROM p),
    k AS (SELECT *, list_inner_product(e, c) / (list_inner_product(c, c) + 1e-10) AS k FROM c)
    SELECT id, round(10 * log10(k * k * list_inner_product(c, c) / (list_inner_product(e, e) - 2 * k * list_inner_product(e, c) + k * k * list_inner_product(c, c) + 1e-10)), 4) AS db FROM k""")
def si_sdr(spark, sf):
    return _pairs(spark, sf).select("id", F.round(A.si_sdr(F.col("x"), F.col("y")), 4).alias("db"))


@query(f"SELECT vec_id, round(sqrt(list_inner_product(y, y)), 6) AS norm FROM (SELECT vec_id, list_transform(x, lambda e: 3 * e / (3 * sqrt(list_inner_product(x, x)) + 1e-8)) AS y FROM ({_E}))")
def l2_norm(spark, sf):
    return _emb(spark, sf).select("vec_id", r6(A.norm(A.l2_normalise(F.transform("x", lambda e: e * 3)))).alias("norm"))


@query(f"SELECT vec_id, list_transform(range(1, 33), lambda i: round((x[i] + x[i + 32]) / 2, 6)) AS y FROM ({_E})")
def downmix(spark, sf):
    return _emb(spark, sf).select("vec_id", F.transform(A.downmix(F.array(F.slice("x", 1, 32), F.slice("x", 33, 32))), A.rounded).alias("y"))


@query(f"WITH {_TRIALS} SELECT round(avg(cam) FILTER (pos), 6) AS pos_mean, round(avg(cam) FILTER (NOT pos), 6) AS neg_mean, round(avg(greatest(0, 0.7 - cam)) FILTER (pos) + avg(greatest(0, cam - 0.3)) FILTER (NOT pos), 6) AS loss FROM s")
def class_means(spark, sf):
    d, p = trials(spark, sf), F.col("pos")
    return d.agg(r6(F.avg(F.when(p, F.col("cam")))).alias("pos_mean"), r6(F.avg(F.when(~p, F.col("cam")))).alias("neg_mean"), r6(metrics.margin_loss(F.when(p, F.col("cam")), F.when(~p, F.col("cam")))).alias("loss"))


@query(f"WITH u AS (SELECT unnest(range(64)) AS pos, unnest(x) AS v FROM ({_E})), s AS (SELECT pos, stddev_samp(v) AS s FROM u GROUP BY pos) SELECT round(avg(s), 6) AS spread, avg(s) < 0.01 AS collapsed FROM s")
def embedding_spread(spark, sf):
    return metrics.embedding_spread(_emb(spark, sf), "x").select(r6("spread").alias("spread"), "collapsed")


@query(f"""WITH {_TRIALS}, u AS (SELECT id, unnest([cam, eres, rnet]) AS sim, unnest(range(3)) AS track_idx FROM s)
    SELECT id, track_idx::INT AS track_idx, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, track_idx) AS rn FROM u) WHERE rn = 1""")
def best_track(spark, sf):
    d = trials(spark, sf).select("id", F.posexplode(F.array(*_SIMS)).alias("track_idx", "sim"))
    return detect.best_track(d, ["id"], "sim").select("id", "track_idx", r6("sim").alias("sim"))


@query(f"""WITH {_TRIALS}, c AS (SELECT id, cam, cam >= -0.1 AND cam < 0.1 AS trig, list_filter([eres, rnet], lambda v: v > cam AND v - cam <= 0.25) AS g, [eres, rnet] AS a FROM s)
    SELECT id, trig AS triggered, trig AND len(g) > 0 AS improved, CASE WHEN trig AND len(g) > 0 THEN list_position(a, list_max(g)) - 1 ELSE -1 END::INT AS track, round(CASE WHEN trig AND len(g) > 0 THEN list_max(g) ELSE cam END, 6) AS sim FROM c""")
def adaptive_separation(spark, sf):
    d = trials(spark, sf).select("id", F.col("cam").alias("base"), "eres", "rnet")
    add = lambda x: x.withColumn("track_sims", F.array("eres", "rnet"))
    out = detect.adaptive_separation(d, lambda x: x, add, "base", -0.1, 0.1, 0.25)
    return out.select("id", "triggered", "improved", F.col("track").cast("int").alias("track"), r6("sim").alias("sim"))


@query(f"WITH {_TRIALS} SELECT id, cam >= CASE WHEN eres > 0 THEN 0.1 ELSE 0.05 END AS accepted FROM s")
def dual_threshold(spark, sf):
    return trials(spark, sf).select("id", fuse.dual_accept(F.col("cam"), F.col("eres") > 0, 0.05, 0.1).alias("accepted"))


@query()
def spectral_gate(spark, sf):
    return _emb(spark, sf).select("vec_id", spectral.spectral_gate(F.col("x")).alias("y"))


_MIXED = "list_transform(range(1, 65), lambda i: x[i] + y[(i - 1) % 40 + 1] * ((sqrt(list_inner_product(x, x) / 64) + 1e-12) / ((sqrt(list_inner_product(l, l) / 64) + 1e-12) * power(10::DOUBLE, 0.25))))"


@query(f"""WITH {_PAIRS}, l AS (SELECT id, x, y, list_concat(y[1:40], y[1:24]) AS l FROM p), m AS (SELECT id, {_MIXED} AS z FROM l),
    t AS (SELECT id, z, list_max(list_transform(z, lambda e: abs(e))) AS top FROM m)
    SELECT id, list_transform(z, lambda e: round((CASE WHEN top > 0.99 THEN e / top * 0.99 ELSE e END)::FLOAT::DOUBLE, 6)) AS y FROM t""")
def mix_at_snr(spark, sf):
    mixed = spectral.mix_at_snr(F.col("x"), F.slice("y", 1, 40), F.lit(5.0), F.col("id"))
    return _pairs(spark, sf).select("id", F.transform(A.doubles(mixed), A.rounded).alias("y"))


@query(f"SELECT vec_id, list_transform(range(1, 17), lambda i: round(x[i] * x[i + 32] - x[i + 16] * x[i + 48], 6)) AS real, list_transform(range(1, 17), lambda i: round(x[i] * x[i + 48] + x[i + 16] * x[i + 32], 6)) AS imag FROM ({_E})")
def complex_mask(spark, sf):
    cut = [F.slice("x", 16 * k + 1, 16) for k in range(4)]
    d = _emb(spark, sf).select("vec_id", spectral.masked(*cut).alias("z"))
    return d.select("vec_id", F.transform("z.real", A.rounded).alias("real"), F.transform("z.imag", A.rounded).alias("imag"))


@query(f"SELECT vec_id, list_transform(range(64), lambda i: round(x[i + 1] - (x[i % 16 + 1] + x[i % 16 + 17] + x[i % 16 + 33] + x[i % 16 + 49]) / 4, 6)) AS y FROM ({_E})")
def mean_subtracted(spark, sf):
    frames = A.mean_subtracted(A.segments(F.col("x"), 16))
    return _emb(spark, sf).select("vec_id", F.transform(F.flatten(frames), A.rounded).alias("y"))


@query(f"""WITH {_PAIRS}, d AS (SELECT id, list_transform(range(1, 65), lambda i: x[i] + y[i]) AS b, list_transform(range(1, 65), lambda i: x[i] + y[i] / 4) AS a, x FROM p),
    u AS (SELECT id, unnest([b, a]) AS e, unnest([0, 1]) AS later, x FROM d),
    c AS (SELECT later, list_transform(x, lambda v: v - list_sum(x) / 64) AS c, list_transform(e, lambda v: v - list_sum(e) / 64) AS e FROM u),
    k AS (SELECT *, list_inner_product(e, c) / (list_inner_product(c, c) + 1e-10) AS k FROM c),
    s AS (SELECT later, 10 * log10(k * k * list_inner_product(c, c) / (list_inner_product(e, e) - 2 * k * list_inner_product(e, c) + k * k * list_inner_product(c, c) + 1e-10)) AS db FROM k)
    SELECT round(avg(db) FILTER (later = 0), 4) AS before, round(avg(db) FILTER (later = 1), 4) AS after, round(avg(db) FILTER (later = 1) - avg(db) FILTER (later = 0), 4) AS gain FROM s""")
def si_sdr_gain(spark, sf):
    d = _pairs(spark, sf)
    noisy = lambda k: F.zip_with("x", "y", lambda a, b: a + b / k)
    d = d.select(A.si_sdr(F.col("x"), noisy(1)).alias("b"), A.si_sdr(F.col("x"), noisy(4)).alias("a"))
    return metrics.mean_gain(d, F.col("b"), F.col("a")).select(*[F.round(c, 4).alias(c) for c in ("before", "after", "gain")])


@query(f"WITH {_PAIRS} SELECT id, round({_sql_cos('x', 'y')}, 6) AS sim, {_sql_cos('x', 'y')} >= 0.1 AS same FROM p")
def verify(spark, sf):
    d = _pairs(spark, sf).select("id", registry.verify(F.col("x"), F.col("y"), 0.1).alias("v"))
    return d.select("id", r6("v.sim").alias("sim"), "v.same")


@query(f"""WITH {_TRIALS}, c AS (SELECT id, cam, cam >= -0.1 AND cam < 0.1 AS triggered, [eres, rnet] AS a, list_filter([eres, rnet], lambda v: v - cam <= 0.25) AS g FROM s)
    SELECT id, triggered, CASE WHEN triggered AND len(g) > 0 THEN list_position(a, list_max(g)) - 1 ELSE -1 END::INT AS track, round(CASE WHEN triggered THEN CASE WHEN len(g) > 0 THEN list_max(g) ELSE -1 END ELSE cam END, 6) AS sep_best_sim FROM c""")
def training_separation(spark, sf):
    d = trials(spark, sf).select("id", F.col("cam").alias("base"), "eres", "rnet")
    out = detect.training_separation(d, lambda x: x, lambda x: x.withColumn("track_sims", F.array("eres", "rnet")), "base", -0.1, 0.1, 0.25)
    return out.select("id", "triggered", F.col("track").cast("int").alias("track"), r6("sep_best_sim").alias("sep_best_sim"))


_POINTS = [(i, j, cap, low) for i, cap in enumerate((0.1, 0.25, 0.4)) for j, low in enumerate((-0.2, -0.1, 0.0))]


@query(f"""WITH {_TRIALS}, g(cap_id, low_id, cap, low) AS (VALUES {", ".join(f"({i}, {j}, {cap}::DOUBLE, {low}::DOUBLE)" for i, j, cap, low in _POINTS)}),
    c AS (SELECT cap_id, low_id, pos, cam >= low AND cam < 0.15 AND eres > cam AND eres - cam <= cap AS moved FROM s, g)
    SELECT cap_id, low_id, count(*) FILTER (moved) AS moved, count(*) FILTER (moved AND pos) AS moved_pos FROM c GROUP BY ALL""")
def parameter_sweep(spark, sf):
    """Nine points of two parameters: each row meets each point."""
    points = spark.createDataFrame(_POINTS, "cap_id int, low_id int, cap double, low double")
    cam, eres = F.col("cam"), F.col("eres")
    stage = lambda d: d.withColumn("moved", fuse.separation_triggered(cam, F.col("low"), 0.15) & (eres > cam) & (eres - cam <= F.col("cap")))
    count = lambda d: d.groupBy("cap_id", "low_id").agg(F.count_if("moved").alias("moved"), F.count_if(F.col("moved") & F.col("pos")).alias("moved_pos"))
    return grid.model_sweep(trials(spark, sf), points, stage, count)


def _recording(spark, sf):
    """All vectors one after the other as one long recording in chunks of 64 samples."""
    return t(spark, sf, "embeddings").select(F.lit("all").alias("path"), F.col("vec_id").alias("chunk"), A.doubles("embedding").alias("samples"))


@query("""WITH u AS (SELECT vec_id * 64 + unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), b AS (SELECT i // 16 AS k, sum(v) AS s FROM u GROUP BY ALL)
    SELECT x.k AS frame, round(sum(y.s), 6) AS total FROM b x JOIN b y ON y.k >= x.k AND y.k < x.k + 3 GROUP BY x.k HAVING count(*) = 3""")
def recording_frames(spark, sf):
    """Frames of 48 samples every 16, across the borders of chunks."""
    d = recordings.frames(_recording(spark, sf), 64, 48, 16)
    return d.select("frame", r6(A.total(F.col("samples"))).alias("total"))


@query()
def recording_gate(spark, sf):
    """The spectral gate over the whole of a recording in chunks; held against the gate on one array in the tests."""
    return recordings.gate(_recording(spark, sf), 64, n=32).select("chunk", "samples")


@query()
def resample_polyphase(spark, sf):
    return _emb(spark, sf).select("vec_id", spectral.resample_polyphase(F.col("x"), 16000, 24000).alias("y"))


# ---------------------------------------------------------------- texts

_NORM = "regexp_replace(lower(coalesce(text, '')), '[\\p{P}\\s]', '', 'g')"


@query(f"SELECT doc_id, md5({_NORM}) AS digest FROM documents")
def normalize_text(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.md5(X.normalize_text("text")).alias("digest"))


# DuckDB's edit distance counts bytes, so the SQL writes letters beyond ASCII as capitals, which lowered texts have none of: one byte for one character.
_BEYOND = ("àáâãäçèéêëìíîïñòóôõöùúûüßœ", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_CER = f"""n AS (SELECT conv_id, turn, role, translate({_NORM}, '{_BEYOND[0]}', '{_BEYOND[1]}') AS txt FROM conversations),
    h AS (SELECT a.conv_id, a.turn, a.role, a.txt AS ref, b.txt AS hyp FROM n a JOIN n b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1),
    e AS (SELECT *, levenshtein(ref, hyp) AS err, length(ref) AS chars FROM h)"""


def _texts(spark, sf):
    """Each turn's whole normalised text and the next turn's, which stands for what was recognised."""
    d = t(spark, sf, "conversations").select("conv_id", "turn", "role", X.normalize_text("text").alias("ref"))
    nxt = d.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("ref").alias("hyp"))
    return d.join(nxt, ["conv_id", "turn"]).withColumn("err", F.levenshtein("ref", "hyp")).withColumn("chars", F.length("ref"))


@query(f"WITH {_CER} SELECT conv_id, turn, round(CASE WHEN chars = 0 THEN CASE WHEN length(hyp) = 0 THEN 0 ELSE 1 END ELSE err / chars END, 6) AS cer, round(CASE WHEN chars = 0 OR length(hyp) = 0 THEN 0 ELSE greatest(0, 1 - err / length(hyp)) END, 6) AS sim FROM e")
def cer_rows(spark, sf):
    return _texts(spark, sf).select("conv_id", "turn", r6(X.error_rate(F.col("ref"), F.col("hyp"))).alias("cer"), r6(F.when((F.col("chars") == 0) | (F.length("hyp") == 0), 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col("err") / F.length("hyp")))).alias("sim"))


@query(f"WITH {_CER} SELECT round(coalesce(sum(err) FILTER (chars > 0) / nullif(sum(chars) FILTER (chars > 0), 0), 0), 6) AS cer FROM e")
def micro_cer(spark, sf):
    return _texts(spark, sf).agg(r6(metrics.micro_error(F.col("err"), F.col("chars"))).alias("cer"))


@query(f"WITH {_CER} SELECT round(CASE WHEN sum(chars) = 0 THEN CASE WHEN sum(err) = 0 THEN 0 ELSE 1 END ELSE sum(err) / sum(chars) END, 6) AS cer FROM e")
def micro_cer_official(spark, sf):
    return _texts(spark, sf).agg(r6(metrics.micro_error_official(F.col("err"), F.col("chars"))).alias("cer"))


_LABELLED = f"{_CER}, v AS (SELECT *, CASE WHEN role = 'user' THEN ref WHEN role = 'assistant' THEN '' END AS label, CASE WHEN conv_id % 3 = 0 THEN '' WHEN conv_id % 7 = 0 THEN 'null' ELSE hyp END AS content FROM e)"


def _labelled(spark, sf):
    d = _texts(spark, sf).withColumn("label", F.when(F.col("role") == "user", F.col("ref")).when(F.col("role") == "assistant", ""))
    return d.withColumn("content", F.when(F.col("conv_id") % 3 == 0, "").when(F.col("conv_id") % 7 == 0, "null").otherwise(F.col("hyp")))


@query(f"WITH {_LABELLED} SELECT round(count(*) FILTER (coalesce(content, '') IN ('', 'null')) / count(*), 6) AS rr, round(1 - count(*) FILTER (content <> '') / count(*), 6) AS rr_strict FROM v WHERE label IS NULL OR label IN ('', 'null')")
def rejection_rate(spark, sf):
    d = _labelled(spark, sf).where(metrics.is_negative(F.col("label")))
    return d.agg(r6(metrics.rejection_rate(F.col("content"))).alias("rr"), r6(metrics.rejection_rate_strict(F.col("content"))).alias("rr_strict"))


@query(f"""WITH {_LABELLED}, a AS (SELECT coalesce(sum(err) FILTER (label <> '' AND chars > 0) / nullif(sum(chars) FILTER (label <> '' AND chars > 0), 0), 0) AS cer,
    count(*) FILTER ((label IS NULL OR label IN ('', 'null')) AND content IN ('', 'null')) / count(*) FILTER (label IS NULL OR label IN ('', 'null')) AS rr,
    count(*) FILTER (label <> '') AS pos_count, count(*) FILTER (label IS NULL OR label IN ('', 'null')) AS neg_count FROM v)
    SELECT round(cer, 6) AS cer, round(rr, 6) AS rr, round((1 - cer) * 0.4 + rr * 0.4, 6) AS score, round((1 - cer) * 40 + rr * 40, 6) AS score80, pos_count, neg_count FROM a""")
def evaluate(spark, sf):
    e = metrics.evaluate(_labelled(spark, sf))
    return e.select(*[r6(c).alias(c) for c in ("cer", "rr", "score", "score80")], "pos_count", "neg_count")


@query(f"WITH {_LABELLED} SELECT conv_id, turn, round(CASE WHEN label IS NULL THEN NULL WHEN label = '' AND content = '' THEN 0 WHEN label = '' OR content = '' THEN 1 ELSE levenshtein(content, label) / length(label) END, 6) AS cer FROM v")
def outcome_cer(spark, sf):
    return _labelled(spark, sf).select("conv_id", "turn", r6(X.outcome_error(F.col("label"), F.col("content"))).alias("cer"))


@query(f"WITH {_CER} SELECT count(*) FILTER (abs(err / nullif(chars, 0) - 0.75) > 1e-6) AS differ FROM e")
def cer_mismatches(spark, sf):
    return _texts(spark, sf).agg(metrics.mismatches(F.try_divide("err", "chars"), F.lit(0.75)).alias("differ"))


@query("SELECT count(*) FILTER (regexp_matches(text, '[A-Z\\uFF01-\\uFF5E]')) AS n FROM documents".replace("\\uFF01", "！").replace("\\uFF5E", "～"))
def uppercase_labels(spark, sf):
    return t(spark, sf, "documents").agg(F.count_if(metrics.uppercase_or_wide(F.col("text"))).alias("n"))


@query("SELECT conv_id, turn, regexp_matches(text, '[A-Za-z]') AS english, CASE WHEN regexp_matches(text, '[A-Za-z]') THEN 2 ELSE 1 END::INT AS languages, contains(text, 'CO') OR contains(text, '打开') AS reliable FROM conversations")
def instruct_reliable(spark, sf):
    d = t(spark, sf, "conversations")
    return d.select("conv_id", "turn", X.has_letters(F.col("text")).alias("english"), F.size(X.language_order(F.col("text"))).alias("languages"), X.instruction_reliable(F.col("text")).alias("reliable"))


@query("SELECT doc_id, n_chars FROM documents WHERE regexp_matches(text, '[A-Z！-～]') ORDER BY doc_id LIMIT 5")
def uppercase_first(spark, sf):
    return metrics.first_uppercase(t(spark, sf, "documents"), "text", ["doc_id"]).select("doc_id", "n_chars")


@query("SELECT lang, count(*) FILTER (regexp_matches(coalesce(text, ''), '[一-鿿]')) AS n FROM documents GROUP BY lang")
def has_cjk(spark, sf):
    return t(spark, sf, "documents").groupBy("lang").agg(F.count_if(X.has_cjk(F.col("text"))).alias("n"))


@query(f"""WITH {_LABELLED}, w AS (SELECT *, role AS version, length(content) % 50 AS seconds FROM v),
    a AS (SELECT version, coalesce(sum(err) FILTER (label <> '' AND chars > 0) / nullif(sum(chars) FILTER (label <> '' AND chars > 0), 0), 0) AS cer,
    coalesce(count(*) FILTER ((label IS NULL OR label IN ('', 'null')) AND content IN ('', 'null')) / nullif(count(*) FILTER (label IS NULL OR label IN ('', 'null')), 0), 0) AS rr, sum(seconds)::BIGINT AS duration FROM w GROUP BY version)
    SELECT version, round(cer, 6) AS cer, round(rr, 6) AS rr, round((1 - cer) * 40 + rr * 40, 6) AS score80, duration FROM a""")
def version_summary(spark, sf):
    """Roles stand for versions of the results."""
    d = _labelled(spark, sf).withColumn("version", F.col("role")).withColumn("seconds", F.length("content") % 50)
    return metrics.version_summary(d).select("version", *[r6(c).alias(c) for c in ("cer", "rr", "score80")], "duration")


@query("SELECT doc_id, md5(trim(regexp_replace('<|' || lang || '|><|' || source || '|> ' || text, '<\\|[^|>]*\\|>', '', 'g'), ' ')) AS digest FROM documents WHERE text IS NOT NULL")
def rich_text(spark, sf):
    tagged = F.concat(F.lit("<|"), "lang", F.lit("|><|"), "source", F.lit("|> "), "text")
    return t(spark, sf, "documents").where("text is not null").select("doc_id", F.md5(X.rich_text(tagged)).alias("digest"))


@query("SELECT event_id, printf('%.4f', value / 7) AS shown FROM events")
def four_places(spark, sf):
    return t(spark, sf, "events").select("event_id", X.four_places(F.col("value") / 7).alias("shown"))


_HIT = "SELECT CASE WHEN regexp_matches(text, '[A-Za-z]') THEN 'en' ELSE 'zh' END AS language, length(text) % 3 = 0 AS hit, turn % 2 = 0 AS sep FROM conversations"


@query(f"""SELECT coalesce(language, 'all') AS language, count(*) AS total, count(*) FILTER (hit AND NOT sep) AS direct_hit, count(*) FILTER (hit AND sep) AS separated_hit,
    count(*) FILTER (NOT hit AND sep) AS separated_miss, count(*) FILTER (NOT hit AND NOT sep) AS no_match, round(count(*) FILTER (hit) / count(*), 6) AS rate FROM ({_HIT}) GROUP BY CUBE (language)""")
def kws_breakdown(spark, sf):
    d = t(spark, sf, "conversations").select(F.col("text").alias("kws_text"), (F.length("text") % 3 == 0).alias("hit"), (F.col("turn") % 2 == 0).alias("separated"))
    return metrics.hit_breakdown(d).withColumn("rate", r6("rate"))


@query()
def wakeword_sim(spark, sf):
    """The first eight characters stand in for a wake word; what is heard is all from the third on."""
    heard = F.substr(F.col("text"), F.lit(3))
    return t(spark, sf, "conversations").select("conv_id", "turn", X.wakeword_similarity(F.substring("text", 1, 8), heard).alias("sim"))


@query()
def normalize_digits(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.md5(digits.normalize_digits("text")).alias("digest"))


@query("SELECT doc_id, sha256(text) AS digest, 'root/' || replace(source, '\\', '/') AS path, replace(source || '.wav', '.wav', '_processed.wav') AS renamed FROM documents")
def paths_and_digests(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), X.rooted("root", F.col("source")).alias("path"), X.suffixed(F.concat("source", F.lit(".wav")), ".wav", "_processed.wav").alias("renamed"))


# ---------------------------------------------------------------- gate

_GATE = """g AS (SELECT d.doc_id, l.quality = 1 AS positive, (d.doc_id * 37 % 100) / 100.0::DOUBLE AS sim, CASE WHEN d.doc_id % 5 = 0 THEN NULL ELSE (d.doc_id * 53 % 100) / 100.0::DOUBLE END AS best, d.doc_id % 4 = 0 AS trig FROM documents d JOIN labels l USING (doc_id)),
    h AS (SELECT *, list_filter([CASE WHEN NOT positive AND sim > 0.555 THEN 'G1_neg_high_sim' END, CASE WHEN positive AND best < 0.305 THEN 'G2_pos_low_sim' END, CASE WHEN trig AND best - sim > 0.305 THEN 'G3_jump_artifact' END], lambda r: r IS NOT NULL) AS hits FROM g)"""
_LIMITS = {"neg_high_sim": 0.555, "pos_low_sim": 0.305, "jump_cap": 0.305}


def _gated(spark, sf):
    d = t(spark, sf, "documents").select("doc_id").join(t(spark, sf, "labels"), "doc_id")
    d = d.select("doc_id", (F.col("quality") == 1).alias("positive"), (F.col("doc_id") * 37 % 100 / 100).alias("sim"), F.when(F.col("doc_id") % 5 != 0, F.col("doc_id") * 53 % 100 / 100).alias("best"), (F.col("doc_id") % 4 == 0).alias("triggered"))
    return d.withColumn("hits", gate.rule_hits(F.col("positive"), F.col("sim"), F.col("best"), F.col("triggered"), _LIMITS))


@query(f"WITH {_GATE} SELECT doc_id, array_to_string(hits, ',') AS hits, len(hits) = 0 AS kept FROM h")
def quality_gate(spark, sf):
    return _gated(spark, sf).select("doc_id", F.array_join("hits", ",").alias("hits"), gate.passed(F.col("hits")).alias("kept"))


@query(f"WITH {_GATE}, u AS (SELECT unnest(hits) AS rule FROM h) SELECT rule, count(*) AS n FROM u GROUP BY rule")
def gate_report(spark, sf):
    return gate.rule_counts(_gated(spark, sf))


@query(f"WITH {_GATE} SELECT count(*) AS total, count(*) FILTER (sim IS NOT NULL OR best IS NOT NULL) AS has_gate_fields, count(*) FILTER (sim IS NULL AND best IS NULL) AS missing_gate_fields FROM h")
def gate_coverage(spark, sf):
    return gate.coverage(_gated(spark, sf))


@query(f"WITH {_GATE}, u AS (SELECT doc_id, unnest(hits) AS rule FROM h), r AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY doc_id)::INT AS rn FROM u) SELECT rule, doc_id, rn FROM r WHERE rn <= 50")
def gate_topn(spark, sf):
    return gate.examples(_gated(spark, sf), ["doc_id"]).select("rule", "doc_id", "rn")


_RAW = "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN source ELSE (n_chars / 8)::VARCHAR END AS a, (doc_id / 4)::VARCHAR AS b, CASE doc_id % 5 WHEN 0 THEN 'True' WHEN 1 THEN 'yes' WHEN 2 THEN '1' WHEN 3 THEN lang END AS f FROM documents"


@query(f"SELECT doc_id, TRY_CAST(coalesce(a, b) AS DOUBLE) AS sim, TRY_CAST(b AS DOUBLE) AS best, coalesce(lower(f) IN ('true', '1', 'yes'), false) AS triggered FROM ({_RAW})")
def tidy_records(spark, sf):
    """Numbers and flags that come as texts, some of them neither."""
    d, i = t(spark, sf, "documents"), F.col("doc_id")
    a = F.when(i % 3 == 0, None).when(i % 7 == 0, F.col("source")).otherwise((F.col("n_chars") / 8).cast("string"))
    f = F.when(i % 5 == 0, "True").when(i % 5 == 1, "yes").when(i % 5 == 2, "1").when(i % 5 == 3, F.col("lang"))
    raw = d.select("doc_id", a.alias("sim_abs"), (i / 4).cast("string").alias("sim_abs_weighted"), (i / 4).cast("string").alias("sep_best_sim"), f.alias("sep_triggered"), F.lit(None).cast("string").alias("cmd_separated"))
    return gate.tidy(raw).select("doc_id", "sim", "best", "triggered")


_JSON = """SELECT doc_id, '{' || CASE doc_id % 6 WHEN 0 THEN '' WHEN 1 THEN '"sim_abs":null,' WHEN 2 THEN '"sim_abs":' || n_chars || ',' WHEN 3 THEN '"sim_abs":"0.5",' WHEN 4 THEN '"sim_abs":"' || source || '",' ELSE '"sim_abs":true,' END
    || CASE doc_id % 7 WHEN 0 THEN '' WHEN 1 THEN '"sep_triggered":null,' WHEN 2 THEN '"sep_triggered":"Yes",' WHEN 3 THEN '"sep_triggered":0,' WHEN 4 THEN '"sep_triggered":[],' WHEN 5 THEN '"sep_triggered":true,' ELSE '"sep_triggered":{"a":1},' END
    || CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN '"label":null,' ELSE '"label":"",' END || '"sim_abs_weighted":' || doc_id || ',"cmd_separated":true}' AS j FROM documents"""


@query(f"""SELECT doc_id, coalesce(json_type(j, '$.label') <> 'NULL', false) AS positive,
    CASE coalesce(json_type(j, '$.sim_abs'), 'ABSENT') WHEN 'ABSENT' THEN TRY_CAST(j ->> '$.sim_abs_weighted' AS DOUBLE) WHEN 'NULL' THEN NULL WHEN 'BOOLEAN' THEN CASE WHEN j ->> '$.sim_abs' = 'true' THEN 1 ELSE 0 END ELSE TRY_CAST(j ->> '$.sim_abs' AS DOUBLE) END AS sim,
    CASE coalesce(json_type(j, '$.sep_triggered'), 'ABSENT') WHEN 'ABSENT' THEN j ->> '$.cmd_separated' = 'true' WHEN 'NULL' THEN false WHEN 'VARCHAR' THEN lower(j ->> '$.sep_triggered') IN ('true', '1', 'yes') WHEN 'BOOLEAN' THEN j ->> '$.sep_triggered' = 'true' WHEN 'ARRAY' THEN j ->> '$.sep_triggered' <> '[]' WHEN 'OBJECT' THEN j ->> '$.sep_triggered' <> '{{}}' ELSE TRY_CAST(j ->> '$.sep_triggered' AS DOUBLE) <> 0 END AS triggered FROM ({_JSON})""")
def tidy_variants(spark, sf):
    """Records as texts of JSON, in which a key is absent, null, or holds a value of some kind."""
    i = F.col("doc_id")

    def one_of(n: int, *cases: str | F.Column):
        out = F.when(i % n == 0, "")
        for k, c in enumerate(cases[:-1], 1):
            out = out.when(i % n == k, c)
        return out.otherwise(cases[-1])

    sim = one_of(6, '"sim_abs":null,', F.concat(F.lit('"sim_abs":'), "n_chars", F.lit(",")), '"sim_abs":"0.5",', F.concat(F.lit('"sim_abs":"'), "source", F.lit('",')), '"sim_abs":true,')
    sep = one_of(7, *[f'"sep_triggered":{v},' for v in ("null", '"Yes"', "0", "[]", "true", '{"a":1}')])
    text = F.concat(F.lit("{"), sim, sep, one_of(3, '"label":null,', '"label":"",'), F.lit('"sim_abs_weighted":'), "doc_id", F.lit(',"cmd_separated":true}'))
    records = t(spark, sf, "documents").select("doc_id", F.parse_json(text).alias("record"))
    return gate.tidy_records(records, label="label").select("doc_id", "positive", "sim", "triggered")


# ---------------------------------------------------------------- joins, sets, limits


@query("SELECT o_orderkey, EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING') AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 40) AS there FROM orders")
def split_by_existing(spark, sf):
    """Customer and order keys stand for the two files of a row."""
    d = t(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("a"), F.concat(F.lit("o"), "o_orderkey").alias("b"))
    listing = t(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").cast("string").alias("path"))
    listing = listing.unionByName(t(spark, sf, "lineitem").where("l_quantity > 40").select(F.concat(F.lit("o"), "l_orderkey").alias("path")))
    there, rest = sets.split_by_existing(d, listing, ["a", "b"])
    return there.select("o_orderkey", F.lit(True).alias("there")).unionByName(rest.select("o_orderkey", F.lit(False).alias("there")))


@query("SELECT l.l_orderkey, l.l_linenumber, p.p_retailprice AS part_price, s.s_acctbal AS supp_price FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey JOIN supplier s ON s.s_suppkey = l.l_suppkey")
def with_features(spark, sf):
    """Part and supplier keys stand for paths, their amounts for features."""
    pairs = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("p"), "l_partkey").alias("part"), F.concat(F.lit("s"), "l_suppkey").alias("supp"))
    features = t(spark, sf, "part").select(F.concat(F.lit("p"), "p_partkey").alias("path"), F.col("p_retailprice").alias("price"))
    features = features.unionByName(t(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("path"), F.col("s_acctbal").alias("price")))
    return sets.with_features(pairs, features, ["part", "supp"], value="price").select("l_orderkey", "l_linenumber", "part_price", "supp_price")


_AUG = ["speed", "noise", "gain"]


@query("""WITH e AS (SELECT doc_id, unnest(['speed', 'noise', 'gain']) AS aug_type FROM labels WHERE quality = 1), o AS (SELECT doc_id, 'speed' AS aug_type FROM labels WHERE doc_id % 3 = 0),
    n AS (SELECT * FROM e WHERE (doc_id, aug_type) NOT IN (SELECT doc_id, aug_type FROM o))
    SELECT 'train' AS split, doc_id AS orig_id, aug_type, false AS made FROM o UNION ALL SELECT 'train', doc_id, aug_type, true FROM n""")
def augment_incremental(spark, sf):
    d = t(spark, sf, "labels").select(F.lit("train").alias("split"), F.col("doc_id").alias("orig_id"), "quality")
    old = d.where("orig_id % 3 = 0").select("split", "orig_id", F.lit("speed").alias("aug_type"), F.lit(False).alias("made"))
    return sets.augmented(d.where("quality = 1").drop("quality"), old, _AUG, lambda x: x.withColumn("made", F.lit(True)), ["orig_id", "aug_type"])


@query("SELECT user_id, event_id FROM events")
def sorted_records(spark, sf):
    return sampling.ordered(t(spark, sf, "events").select("user_id", "event_id"), "user_id", ["event_id"])


@query("SELECT vec_id, k::INT AS segment FROM embeddings, (SELECT range AS k FROM range(2)) WHERE len(embedding) - vec_id % 40 >= 40 AND (k + 1) * 24 <= greatest(len(embedding) - vec_id % 40, 24)")
def segments_least(spark, sf):
    """Waves of 25 to 64 values: those under 40 are dropped, the rest cut into slices of 24."""
    d = _emb(spark, sf).select("vec_id", F.slice("x", F.lit(1), (F.size("x") - F.col("vec_id") % 40).cast("int")).alias("x"))
    return d.select("vec_id", F.posexplode(A.segments(F.col("x"), 24, 40)).alias("segment", "s")).select("vec_id", "segment")


@query("SELECT event_id, CASE user_id % 4 WHEN 0 THEN false WHEN 1 THEN false WHEN 2 THEN false ELSE value IS NOT NULL END AS finite FROM events")
def finite_values(spark, sf):
    k = F.col("user_id") % 4
    v = F.when(k == 0, float("nan")).when(k == 1, float("-inf")).when(k == 2, None).otherwise(F.col("value"))
    return t(spark, sf, "events").select("event_id", metrics.finite(v).alias("finite"))


@query("SELECT round(avg((value * 100)::BIGINT) / 100, 6) AS mean_seconds, round(avg((value * 100)::BIGINT) / 100 * 1838, 4) AS total_seconds FROM events")
def time_per_sample(spark, sf):
    d = t(spark, sf, "events").select(F.round(F.col("value") * 100).cast("long").alias("cents"))
    return metrics.time_per_sample(d, "cents", 1838).select(r6(F.col("mean_seconds") / 100).alias("mean_seconds"), F.round(F.col("total_seconds") / 100, 4).alias("total_seconds"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)")
def resume_anti(spark, sf):
    done = t(spark, sf, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey"))
    return sets.resume(t(spark, sf, "orders"), done, "o_orderkey").select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def val_semi(spark, sf):
    keys = t(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return sets.semi(t(spark, sf, "orders"), keys, "o_custkey").select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem l WHERE EXISTS (SELECT 1 FROM lineitem k WHERE k.l_partkey = l.l_partkey AND k.l_suppkey = l.l_suppkey AND k.l_discount > 0.08)")
def val_semi_composite(spark, sf):
    d = t(spark, sf, "lineitem")
    return sets.semi(d, d.where("l_discount > 0.08").select("l_partkey", "l_suppkey"), ["l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber")


@query("SELECT d.doc_id, l.quality, l.toxic, d.source FROM documents d JOIN labels l USING (doc_id)")
def positional_join(spark, sf):
    return sets.aligned(t(spark, sf, "documents").select("doc_id", "source"), t(spark, sf, "labels"), ("doc_id",)).select("doc_id", "quality", "toxic", "source")


@query("""WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS position FROM orders), c AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS position FROM customer)
    SELECT position, o_orderkey, c_custkey FROM o JOIN c USING (position)""")
def joined_by_position(spark, sf):
    """The dearest orders beside the poorest customers, rank by rank: the tables share no key."""
    return sets.by_position(t(spark, sf, "orders").select("o_orderkey", "o_totalprice"), t(spark, sf, "customer").select("c_custkey", "c_acctbal"), [F.desc("o_totalprice"), "o_orderkey"], ["c_acctbal", "c_custkey"]).select("position", "o_orderkey", "c_custkey")


@query("SELECT event_id, (row_number() OVER (ORDER BY ts, event_id) - 1) // 64 AS batch FROM events QUALIFY (row_number() OVER (ORDER BY ts, event_id) - 1) < (SELECT count(*) // 64 * 64 FROM events)")
def full_batches(spark, sf):
    return sampling.full_batches(t(spark, sf, "events").select("event_id", "ts"), 64, ["ts", "event_id"]).select("event_id", "batch")


@query()
def pool_pairs(spark, sf):
    return sets.pool_pairs(t(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id", 2)


_SPLIT = "SELECT doc_id, CASE WHEN quality = 1 THEN 'pos' ELSE 'neg' END AS split FROM labels"


@query(f"WITH s AS ({_SPLIT}), p AS (SELECT * FROM s WHERE split = 'pos' ORDER BY doc_id LIMIT 100), n AS (SELECT * FROM s WHERE split = 'neg' ORDER BY doc_id LIMIT 200 - (SELECT count(*) FROM p)::INT) SELECT * FROM p UNION ALL SELECT * FROM n")
def balanced_limit(spark, sf):
    d = t(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "pos").otherwise("neg").alias("split"))
    return sampling.balanced(d, 200, order=("doc_id",))


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id DESC) <= 200 AS is_val FROM labels")
def last_n_val(spark, sf):
    return sampling.last_n_split(t(spark, sf, "labels").select("doc_id"), 200, [F.desc("doc_id")])


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def topk(spark, sf):
    return t(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey", "o_totalprice")


@query("SELECT doc_id FROM labels WHERE doc_id >= 100 AND doc_id < 400")
def slice_rows(spark, sf):
    return sampling.first_n(t(spark, sf, "labels"), 300, "doc_id", 100).select("doc_id")


@query("SELECT doc_id, lang, 'pos' AS split, NULL::BIGINT AS extra FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, lang, 'neg', n_chars FROM documents WHERE lang <> 'en'")
def union_splits(spark, sf):
    d = t(spark, sf, "documents")
    a = d.where("lang = 'en'").select("doc_id", "lang", F.lit("pos").alias("split"))
    b = d.where("lang <> 'en'").select("doc_id", "lang", F.lit("neg").alias("split"), F.col("n_chars").alias("extra"))
    return sets.union_splits(a, b)


@query("SELECT u.user_id, y.event_type FROM (SELECT DISTINCT user_id FROM events) u, (SELECT DISTINCT event_type FROM events) y EXCEPT SELECT user_id, event_type FROM events")
def missing_types(spark, sf):
    e = t(spark, sf, "events")
    expected = e.select("user_id").distinct().crossJoin(e.select("event_type").distinct())
    return sets.missing_types(expected, e, ("user_id", "event_type"))


@query("SELECT DISTINCT path FROM (SELECT source AS path FROM documents UNION ALL SELECT lang FROM documents)")
def distinct_paths(spark, sf):
    return sets.distinct_paths(t(spark, sf, "documents"), ["source", "lang"])


@query("SELECT doc_id FROM labels WHERE NOT (quality = 1 AND toxic = 0)")
def complement(spark, sf):
    return sets.complement(t(spark, sf, "labels"), (F.col("quality") == 1) & (F.col("toxic") == 0)).select("doc_id")


@query()
def hashed_sample(spark, sf):
    return sampling.hashed_sample(t(spark, sf, "labels"), 64, ["doc_id"])


@query()
def training_folds(spark, sf):
    return t(spark, sf, "labels").select("doc_id", sampling.folds("doc_id").alias("fold"))


# ---------------------------------------------------------------- windows

_EV = "SELECT event_id, user_id, ts, round(value * 100)::BIGINT AS cents FROM events"


@query(f"SELECT event_id, round((coalesce(lag(cents) OVER w, cents) + cents + coalesce(lead(cents) OVER w, cents)) / 300.0::DOUBLE, 6) AS mean3 FROM ({_EV}) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def moving_avg3(spark, sf):
    e = t(spark, sf, "events")
    cents = F.round(F.col("value") * 100).cast("long")
    return e.select("event_id", r6(windows.moving_average3(cents, ["user_id"], ["ts", "event_id"]) / 100).alias("mean3"))


@query(f"SELECT event_id, round(sum(cents) OVER w / count(*) OVER w / 100, 6) AS mean100 FROM ({_EV}) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)")
def rolling_mean100(spark, sf):
    return t(spark, sf, "events").select("event_id", r6(windows.rolling_mean_cents(F.col("value"), 100, ["user_id"], ["ts", "event_id"])).alias("mean100"))


@query(f"SELECT event_id, cents < least(1000000000, min(cents) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS is_best FROM ({_EV})")
def running_best(spark, sf):
    e = t(spark, sf, "events").withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    return metrics.running_best(e, "cents", ["ts", "event_id"], 1_000_000_000, ["user_id"]).select("event_id", "is_best")


@query(f"SELECT user_id, event_id AS epoch, cents AS val_eer FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY cents, event_id) AS rn FROM ({_EV}) WHERE event_id % 2 = 0) WHERE rn = 1")
def best_epoch(spark, sf):
    """Users stand for runs, events for epochs."""
    e = t(spark, sf, "events").select("user_id", F.col("event_id").alias("epoch"), F.round(F.col("value") * 100).cast("long").alias("val_eer"), (F.col("event_id") % 2 == 0).alias("best"))
    return metrics.best_epoch(e, ("user_id",))


@query("SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ALL")
def segment_counts(spark, sf):
    return t(spark, sf, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))
