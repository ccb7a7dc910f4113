"""The jobs: scoring a data set, single samples, test manifests, and preparing training data.

Frames that several stages of a job read are cached; ``cascade.release()`` frees
them when the caller has what he wanted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Profile
from ..functions import arrays as A
from ..functions import text as X
from ..functions.digits import normalize_digits
from ..models import registry as R
from ..operators import cascade as C
from ..operators import detect, fuse, gate, metrics, sampling, sets
from ..sources import markers
from ..sources.batchlog import BatchLog, in_batches

EXTRACTORS = ("standin_cam", "standin_eres", "standin_rnet")


def post_recognition(samples):
    """Peak normalisation, then trimming, before a recogniser hears the samples."""
    return A.trim_silence(A.peak_normalise(samples), 0.005)


def finish_text(c):
    """Punctuation goes first, digits are spelt after it, as the scores were defined."""
    return normalize_digits(X.normalize_text(c))


def match_keyword(df: DataFrame, profile: Profile, main: str, quick: str | None = None, separator: str = "default", syllables: Callable[[str], str] | None = None) -> DataFrame:
    """Adds ``anchor`` (samples), ``matched`` and ``kws_separated`` to rows with ``kws, kws_denoised, kws_text, rate``.

    Stages, each for the rows the ones before left open: the quick recogniser
    on raw audio (not for words with Latin letters); the main one in the
    word's languages in order; separation, unless the word has Latin letters
    and the gate is off; the whole denoised audio where the tracks' energies
    speak for one speaker; each track; the whole again.
    """
    english = X.has_letters(F.col("kws_text"))
    sure = F.lit(profile.kws_trigger)
    columns = df.columns

    def similarity(samples, model, language):
        return X.wakeword_similarity(F.col("kws_text"), R.recognise(model, samples, F.col("rate"), F.lit(language), profile.model_seconds), syllables)

    def heard(d: DataFrame, samples, name: str) -> DataFrame:
        """Best similarity over the languages: both for every word, or (early stop) the second only for Latin words that the first missed."""
        if not profile.early_stop:
            return d.withColumn(name, F.greatest(similarity(samples, main, "zh"), similarity(samples, main, "en")))
        d = d.withColumn("_en", english)
        en = d.where("_en").withColumn(name, similarity(samples, main, "en"))
        zh = d.where("not _en").withColumn(name, F.lit(-1.0))
        both = en.where(F.col(name) < sure).unionByName(zh).withColumn(name, F.greatest(F.col(name), similarity(samples, main, "zh")))
        return en.where(F.col(name) >= sure).unionByName(both).drop("_en")

    def decided(d: DataFrame, anchor, matched, separated=False) -> DataFrame:
        return d.select(*columns, anchor.alias("anchor"), matched.alias("matched"), F.lit(separated).alias("kws_separated"))

    whole, yes, no = F.col("kws_denoised"), F.lit(True), F.lit(False)
    parts, left = [], df
    if profile.quick_first and quick:
        tried = left.withColumn("_en", english)
        scored = C.keep(tried.where("not _en").withColumn("_s", similarity(F.col("kws"), quick, "zh")))
        parts.append(decided(scored.where(F.col("_s") >= sure), whole, yes))
        left = scored.where(F.col("_s") < sure).select(columns).unionByName(tried.where("_en").select(columns))
    scored = C.keep(heard(left, F.col("kws"), "_s"))
    parts.append(decided(scored.where(F.col("_s") >= sure), whole, yes))
    left = scored.where(F.col("_s") < sure).select(columns)
    if not profile.english_gate:
        parts.append(decided(left.where(english), whole, no))
        left = left.where(~english)
    split = C.keep(left.withColumn("_tracks", R.separate(separator, whole, F.lit(None).cast("array<double>"), F.col("rate"), profile.separator_seconds)))
    enough = F.coalesce(F.size("_tracks") > 1, F.lit(False))
    parts.append(decided(split.where(~enough), whole, no))
    split = split.where(enough)
    single = A.single_speaker(F.col("_tracks"), profile.single_ratio) if profile.energy_gate else F.lit(False)
    tested = C.keep(heard(split.where(single), whole, "_s"))
    parts.append(decided(tested.where(F.col("_s") >= sure), whole, yes))
    split = split.where(~single).unionByName(tested.where(F.col("_s") < sure).drop("_s"))
    key = [c for c in ("split", "idx") if c in columns]
    each = heard(split.select(*columns, F.posexplode("_tracks").alias("track_idx", "_track")), F.col("_track"), "_s")
    best = C.keep(detect.best_track(each, key, "_s"))
    parts.append(decided(best.where(F.col("_s") >= sure), F.col("_track"), yes, True))
    again = heard(best.where(F.col("_s") < sure).withColumnRenamed("_s", "_t"), whole, "_s")
    better = F.col("_s") > F.col("_t")
    parts.append(decided(again, F.when(better, whole).otherwise(F.col("_track")), better & (F.col("_s") >= sure), True))
    return sets.union_splits(*parts)


def process_keyword(df: DataFrame, profile: Profile, main: str, quick: str | None = None, separator: str = "default", syllables: Callable[[str], str] | None = None) -> DataFrame:
    """``match_keyword`` after denoising, for rows with a wake word; the others keep their denoised audio as ``anchor``.

    A hit's anchor is the audio that matched; a miss goes on with the denoised one.
    """
    d = df.withColumn("kws_denoised", R.denoise(profile.denoiser, F.col("kws"), F.col("rate"), profile.model_seconds))
    worded = metrics.truthy(F.col("kws_text"))
    tried = match_keyword(d.where(worded), profile, main, quick, separator, syllables)
    tried = tried.withColumn("anchor", F.when(F.col("matched"), F.col("anchor")).otherwise(F.col("kws_denoised")))
    rest = d.where(~worded).withColumns({"anchor": F.col("kws_denoised"), "matched": F.lit(False), "kws_separated": F.lit(False)})
    return tried.unionByName(rest)


def keyword_statistics(df: DataFrame, profile: Profile, main: str, quick: str | None = None, separator: str = "default", syllables: Callable[[str], str] | None = None) -> DataFrame:
    """Hits per language and in all; a separation that exceeds its time counts as a row without tracks."""
    d = df.withColumn("kws_denoised", R.denoise(profile.denoiser, F.col("kws"), F.col("rate"), profile.model_seconds))
    done = match_keyword(d, profile, main, quick, separator, syllables)
    return metrics.hit_breakdown(done.select("kws_text", F.col("matched").alias("hit"), F.col("kws_separated").alias("separated")))


def similarities(df: DataFrame, left: str, right: str, extractors=EXTRACTORS, seconds: float | None = None) -> DataFrame:
    """Adds the cosines ``cam, eres, rnet`` of two waveform columns; all vectors come from one pass of Python."""
    d = df.withColumn("_v", R.ensemble(extractors, F.col("rate"), F.col(left), F.col(right), seconds=seconds))
    return d.withColumns({n: A.cosine(F.col(f"_v.c0.m{k}"), F.col(f"_v.c1.m{k}")) for k, n in enumerate(("cam", "eres", "rnet"))}).drop("_v")


def validation_similarities(rows: DataFrame, chosen: DataFrame, on: tuple[str, ...] = ("kws_path", "cmd_path"), extractors=EXTRACTORS) -> DataFrame:
    """Similarities of the ``rows`` whose keys ``chosen`` holds, with ``positive`` and ``chars`` for a search over weights."""
    d = similarities(sets.semi(rows, chosen.select(*on), list(on)), "kws", "cmd", extractors)
    return d.select(*on, metrics.present(F.col("label")).alias("positive"), F.length(X.normalize_text("label")).alias("chars"), "cam", "eres", "rnet")


def phase_one(df: DataFrame, profile: Profile, separator: str = "default", extractors=EXTRACTORS) -> DataFrame:
    """Rows with ``kws, cmd, rate`` -> similarities after denoising and adaptive separation; narrow, no shuffle."""
    d = df.withColumn("cmd", R.denoise(profile.denoiser, F.col("cmd"), F.col("rate"), profile.model_seconds))
    d = similarities(d, "anchor" if "anchor" in d.columns else "kws", "cmd", extractors, profile.model_seconds)
    base = A.weighted_sum([F.col(c) for c in ("cam", "eres", "rnet")], list(profile.weights))
    d = d.withColumn("sim_abs", base)
    if not profile.separate:
        return d.withColumn("improved", F.lit(False))
    anchor = "anchor" if "anchor" in d.columns else "kws"

    def tracks(x: DataFrame) -> DataFrame:
        return x.withColumn("tracks", R.separate(separator, F.col("cmd"), F.col(anchor), F.col("rate"), profile.separator_seconds))

    def sims(x: DataFrame) -> DataFrame:
        own, other = R.ensemble(extractors, F.col("rate"), F.col(anchor), seconds=profile.model_seconds), R.ensemble_tracks(extractors, F.col("rate"), F.col("tracks"), profile.model_seconds)
        x = x.withColumn("_o", own["c0"]).withColumn("_t", other)
        # A track on which an extractor fails spoils its row, which then has no similarities.
        spoilt = F.col("tracks").isNotNull() & (F.col("_t.m0").isNull() | F.col("_t.m1").isNull() | F.col("_t.m2").isNull())
        x, w = x.withColumn("cmd", F.when(~spoilt, F.col("cmd"))), profile.weights
        per = F.transform(F.sequence(F.lit(0), F.size("tracks") - 1), lambda i: sum((A.cosine(F.col(f"_o.m{k}"), F.element_at(F.col(f"_t.m{k}"), i + 1)) * F.lit(w[k]) for k in (1, 2)), A.cosine(F.col("_o.m0"), F.element_at(F.col("_t.m0"), i + 1)) * F.lit(w[0])))
        return x.withColumn("track_sims", F.when(F.size("tracks") > 0, per).otherwise(F.array().cast("array<double>")))

    hit = F.coalesce(fuse.separation_triggered(F.col("sim_abs"), profile.trigger_min, profile.threshold), F.lit(False))
    done = sims(tracks(d.where(hit)))
    done = done.withColumn("_c", detect.choose_track(F.col("sim_abs"), F.col("track_sims"), profile.jump_cap))
    moved = done.withColumn("cmd", F.when(F.col("_c.improved"), F.element_at("tracks", F.col("_c.track") + 1)).otherwise(F.col("cmd"))).withColumn("improved", F.col("_c.improved"))
    kept = [c for c in d.columns if c not in ("cam", "eres", "rnet")] + ["improved"]
    moved = similarities(moved.select(kept), anchor, "cmd", extractors, profile.model_seconds)
    return moved.unionByName(d.where(~hit).withColumn("improved", F.lit(False)))


SIMILARITIES = ["cam", "eres", "rnet"]


def judged(one: DataFrame, profile: Profile, stats: DataFrame | None = None) -> DataFrame:
    """``phase_one`` rows with ``fused, is_target``; ``stats`` are frozen moments, by default those of the rows."""
    return fuse.zscore_fuse(one, SIMILARITIES, profile.weights, stats).withColumn("is_target", fuse.accept(F.col("fused"), profile.z_threshold))


def heard(yes: DataFrame, profile: Profile, main: str, quick: str | None = None) -> DataFrame:
    """Accepted rows with the ``content`` that is recognised in them."""
    d = C.keep(yes.withColumn("heard_from", post_recognition(F.col("cmd"))))
    model = lambda name: lambda x: x.withColumn("heard", R.recognise(name, F.col("heard_from"), F.col("rate"), F.lit("zh"), profile.model_seconds))
    spoken = C.recognise_command(d, model(quick), model(main), X.instruction_reliable) if quick else model(main)(d).withColumnRenamed("heard", "value")
    return spoken.withColumn("content", finish_text(F.col("value"))).select(*yes.columns, "content")


def rated(spoken: DataFrame, rest: DataFrame) -> DataFrame:
    """Rows with their content and those without any: ``content, ref, hyp, failed, cer``."""
    out = spoken.unionByName(rest.withColumn("content", F.lit("")))
    out = out.withColumn("ref", X.normalize_text("label")).withColumn("hyp", X.normalize_text("content"))
    out = out.withColumn("failed", F.col("cam").isNull() | F.col("eres").isNull() | F.col("rnet").isNull())
    cer = F.when(metrics.truthy(F.col("label")), X.error_rate(F.col("ref"), F.col("hyp"))).otherwise(X.outcome_error(F.col("label"), F.col("hyp")))
    return out.withColumn("cer", F.when(F.col("failed"), 1.0).otherwise(cer))


def refused(rows: DataFrame) -> DataFrame:
    return rows.where(~F.coalesce("is_target", F.lit(False)))


def score_dataset(df: DataFrame, profile: Profile, main: str = "default", quick: str | None = None, separator: str = "default", stats: DataFrame | None = None, extractors: tuple[str, ...] | None = None) -> DataFrame:
    """Per row: ``fused, is_target, content, cer, failed``; recognition runs on accepted rows only.

    A row on which a model fails has no similarities: it does not enter the
    moments, is no target, and has an empty content and an error rate of 1.

    ``stats`` freezes the moments of the fusion (as streaming needs); without
    it they are those of this run.
    """
    one = C.keep((phase_one(df, profile, separator, extractors) if extractors else phase_one(df, profile, separator)))
    rows = judged(one, profile, stats)
    return rated(heard(rows.where("is_target"), profile, main, quick), refused(rows))


def score_in_batches(spark: SparkSession, df: DataFrame, folder: str, profile: Profile, main: str = "default", quick: str | None = None, separator: str = "default", extractors: tuple[str, ...] | None = None, batches: int = 16, key: str = "ckpt_key") -> DataFrame:
    """``score_dataset`` whose finished batches are kept in ``folder``: started again after it was ended, it does only what is left.

    Similarities are made batch by batch; each batch leaves its moments, and
    those of all rows are merged from them once every batch is there.  Accepted
    rows are then recognised batch by batch.  Rows are told apart by ``key``.
    """
    found = BatchLog(spark, f"{folder}/similarities")
    moments = BatchLog(spark, f"{folder}/moments")
    one = in_batches(df, found, key, batches, lambda d: phase_one(d, profile, separator, extractors) if extractors else phase_one(d, profile, separator))
    known = {e["batch"] for e in moments.entries()}
    for entry in found.entries():
        if entry["batch"] not in known:
            moments.append(fuse.partial_moments(one.where(F.col("batch") == entry["batch"]), SIMILARITIES, ["batch"]), entry["batch"])
    parts = moments.read()
    parts = fuse.partial_moments(one, SIMILARITIES, ["batch"]) if parts is None else parts
    rows = judged(one, profile, fuse.as_statistics(fuse.merged_moments(parts), SIMILARITIES)).drop("batch")
    spoken = in_batches(rows.where("is_target"), BatchLog(spark, f"{folder}/contents"), key, batches, lambda d: heard(d, profile, main, quick))
    C.release()  # everything that was cached is written
    return rated(spoken.drop("batch"), refused(rows))


def score_samples(df: DataFrame, profile: Profile, main: str = "default", separator: str = "default", extractor: str = "standin_cam") -> DataFrame:
    """Independent rows: absolute thresholds, the higher one after separation; no shuffle, accepted rows are cached."""
    d = df.withColumn("cmd", R.denoise(profile.denoiser, F.col("cmd"), F.col("rate"), profile.model_seconds))
    d = d.withColumn("_v", R.ensemble([extractor], F.col("rate"), F.col("kws"), F.col("cmd"), seconds=profile.model_seconds)).withColumn("_k", F.col("_v.c0.m0"))
    d = d.withColumn("base", A.cosine(F.col("_k"), F.col("_v.c1.m0"))).drop("_v")
    tracks = lambda x: x.withColumn("tracks", R.separate(separator, F.col("cmd"), F.col("kws"), F.col("rate"), profile.separator_seconds))
    sims = lambda x: x.withColumn("_t", R.extract_tracks(extractor, F.col("tracks"), F.col("rate"), profile.model_seconds)).withColumn("track_sims", F.transform("_t", lambda t: A.cosine(F.col("_k"), t)))
    d = detect.adaptive_separation(d, tracks, sims, "base", profile.trigger_min, profile.threshold, profile.jump_cap, need_two=True)
    d = d.withColumn("is_target", fuse.dual_accept(F.col("sim"), F.col("improved"), profile.threshold, profile.threshold_separated))
    # The cached steps keep the Python stages apart: Spark 4.1 leaves one of them unplanned in the union otherwise.
    yes = C.keep(d.where("is_target").withColumn("heard_from", post_recognition(F.col("cmd"))))
    yes = C.keep(yes.withColumn("_heard", R.recognise(main, F.col("heard_from"), F.col("rate"), F.lit("zh"), profile.model_seconds)))
    yes = yes.withColumn("content", finish_text(F.col("_heard"))).drop("_heard", "heard_from")
    return yes.unionByName(d.where(~F.coalesce("is_target", F.lit(False))).withColumn("content", F.lit(""))).drop("_k")


def score_test(df: DataFrame, profile: Profile, **models) -> DataFrame:
    return score_dataset(df.withColumn("label", F.lit(None).cast("string")), profile, **models).select("idx", "id", "content")


def prepare_training(records: DataFrame, existing: DataFrame | None = None, limits: dict | None = None, n_folds: int = 5) -> tuple[DataFrame, DataFrame]:
    """(kept rows with their fold by original id, all rows with their rule hits); inputs are never overwritten."""
    if existing is not None:
        records = sets.missing_types(records, existing).unionByName(existing, allowMissingColumns=True)
    d = gate.tidy(records)
    hits = gate.rule_hits(metrics.present(F.col("label")), F.col("sim"), F.col("best"), F.col("triggered"), limits)
    d = d.withColumn("hits", hits)
    return d.where(gate.passed(F.col("hits"))).withColumn("fold", sampling.folds("orig_id", n_folds)), d


def rebuild_submission(results: DataFrame, manifest: DataFrame) -> DataFrame:
    """Results in the manifest's order with its labels: ``split_order, idx, id, content, label, cer``; rows without a result are empty."""
    d = manifest.select("split_order", "idx", "id", "ckpt_key", "label").join(results.select("ckpt_key", F.col("content").alias("_c")), "ckpt_key", "left")
    d = d.withColumn("content", F.coalesce("_c", F.lit("")))
    ref, hyp = X.normalize_text("label"), X.normalize_text("content")
    return d.select("split_order", "idx", "id", "content", "label", F.when(metrics.truthy(F.col("label")), X.error_rate(ref, hyp)).alias("cer"))


def verify_submission(results: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """One row about results with ``content, label, cer`` as texts: official rate, rejections, and how many stated rates differ from those counted anew.

    Rates are stated with four decimals, hence the tolerance.
    """
    d = results.select("content", "label", F.col("cer").try_cast("double").alias("stated"))
    d = d.withColumn("ref", X.strip_punctuation("label")).withColumn("hyp", X.strip_punctuation("content"))
    d = d.withColumn("err", F.levenshtein("hyp", "ref")).withColumn("chars", F.length("ref"))
    pos = metrics.truthy(F.col("label")) & (F.col("label") != "null")
    return d.agg(
        metrics.micro_error_official(F.when(pos, F.col("err")), F.when(pos, F.col("chars"))).alias("cer"),
        metrics.rejection_rate(F.col("content"), metrics.is_negative(F.col("label"))).alias("rr"),
        F.coalesce(F.count_if(pos & (F.abs(F.col("stated") - X.error_rate(F.col("ref"), F.col("hyp"))) > tolerance)), F.lit(0)).alias("differ"),
        F.count_if(metrics.uppercase_or_wide(F.col("label"))).alias("uppercase"),
    )


def run_stages(spark: SparkSession, folder: str, stages: list[tuple[str, Callable[[], object]]], skip: tuple[str, ...] = (), again: bool = False, made_from: dict[str, str] | None = None) -> list[str]:
    """Run (name, function) stages in order; returns the names of those run now.

    A finished stage leaves the marker ``.stage_<name>.done`` in ``folder`` (on
    any file system Spark reaches) and is not run a second time unless
    ``again``.  ``made_from`` holds digests of what a stage depends on besides the
    stages before it: where it, or that of a stage before, has changed, the stage
    is run again.  Skipped stages get no marker.  An error ends the run; the
    stages before it stay done.
    """
    unknown = set(skip) - {name for name, _ in stages}
    if unknown:
        raise ValueError(f"no stage named {sorted(unknown)}")
    ran, state = [], ""
    for name, work in stages:
        state = markers.digest(state, name, name in skip, (made_from or {}).get(name, ""))
        if name in skip or (markers.is_done(spark, folder, name, state if made_from is not None else None) and not again):
            continue
        markers.clear(spark, folder, name)  # a stage that is ended in the middle is not done
        work()
        markers.write_done(spark, folder, name, state)
        ran.append(name)
    return ran


def _gate_stage(spark: SparkSession, folder: str, limits: dict | None) -> None:
    d = spark.read.parquet(f"{folder}/prepared")
    hits = gate.rule_hits(metrics.present(F.col("label")), F.col("sim"), F.col("best"), F.col("triggered"), limits)
    d.withColumn("hits", hits).write.mode("overwrite").parquet(f"{folder}/gated")


def _fold_stage(spark: SparkSession, folder: str, source: str, kept_only: bool, n_folds: int) -> None:
    d = spark.read.parquet(f"{folder}/{source}")
    d = d.where(gate.passed(F.col("hits"))) if kept_only else d
    d.drop("hits").withColumn("fold", sampling.folds("orig_id", n_folds)).write.mode("overwrite").partitionBy("fold").parquet(f"{folder}/folds")


def prepare_and_gate(spark: SparkSession, folder: str, records: DataFrame, existing: DataFrame | None = None, limits: dict | None = None, n_folds: int = 5, skip: tuple[str, ...] = ()) -> list[str]:
    """Training data up to the folds as stages with markers, each written to ``folder`` before the next reads it."""

    def prepare() -> None:
        gate.tidy(records if existing is None else sets.missing_types(records, existing).unionByName(existing, allowMissingColumns=True)).write.mode("overwrite").parquet(f"{folder}/prepared")

    stages = [("prepare", prepare), ("gate", lambda: _gate_stage(spark, folder, limits)), ("folds", lambda: _fold_stage(spark, folder, "gated", True, n_folds))]
    made_from = {"prepare": markers.digest(records, existing), "gate": markers.digest(limits), "folds": markers.digest(n_folds)}
    return run_stages(spark, folder, stages, skip, made_from=made_from)


def training_run(
    spark: SparkSession, folder: str, originals: DataFrame, types: list[str], make: Callable[[DataFrame], DataFrame], prepare: Callable[[DataFrame], DataFrame] = gate.tidy,
    limits: dict | None = None, report_only: bool = False, n_folds: int = 5, train: list[tuple[str, Callable[[DataFrame], object]]] | None = None, skip: tuple[str, ...] = (), version: str = "",
) -> list[str]:
    """From recordings to trained models: augment, prepare, gate, folds, and a stage ``train_<name>`` for each of ``train``.

    ``originals`` (``split, orig_id`` and what ``make`` needs) get the ``types`` of
    augmentation; only those that ``folder`` does not have yet are made.  ``prepare`` turns
    augmented rows into records with ``sim, best, triggered, label``.  Rows that
    break a rule of the gate get no fold, unless the gate is skipped or
    ``report_only``.  A change of the rows, types, limits or folds, or of
    ``version`` (which stands for the functions), runs the stages from there on
    again.
    """
    log = BatchLog(spark, f"{folder}/augmented")

    def augment() -> None:
        expected, made = originals.withColumn("aug_type", F.explode(F.array(*map(F.lit, types)))), log.read()
        missing = expected if made is None else sets.missing_types(expected, made)
        if not missing.isEmpty():
            log.append(make(missing))

    def rows() -> DataFrame:
        made = None if "augment" in skip else log.read()
        if made is None:
            return originals
        asked = spark.createDataFrame([(x,) for x in types], "aug_type string")
        return sets.semi(sets.semi(made, asked, "aug_type"), originals.select("split", "orig_id"), ["split", "orig_id"]).drop("batch")

    gated = "gate" not in skip
    stages = [
        ("augment", augment),
        ("prepare", lambda: prepare(rows()).write.mode("overwrite").parquet(f"{folder}/prepared")),
        ("gate", lambda: _gate_stage(spark, folder, limits)),
        ("folds", lambda: _fold_stage(spark, folder, "gated" if gated else "prepared", gated and not report_only, n_folds)),
        *((f"train_{name}", lambda f=f: f(spark.read.parquet(f"{folder}/folds"))) for name, f in train or []),
    ]
    made_from = {"augment": markers.digest(originals, sorted(types), version), "gate": markers.digest(limits), "folds": markers.digest(n_folds, report_only)}
    return run_stages(spark, folder, stages, skip, made_from=made_from)
