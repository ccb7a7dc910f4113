"""Declared schemas."""

from pyspark.sql import types as T

_s, _d, _l, _b = T.StringType(), T.DoubleType(), T.LongType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


# Names of the fields in manifest files, and the columns they become.
MANIFEST_KEYS = {"id": "id", "唤醒音频": "kws_path", "唤醒文本": "kws_text", "识别音频": "cmd_path", "识别文本": "label"}

MANIFEST_JSON = _struct(**{k: _s for k in MANIFEST_KEYS})
PROCESSED_JSON = T.StructType([
    *MANIFEST_JSON.fields,
    *_struct(kws_processed=_s, cmd_processed=_s, sep_triggered=_s, cmd_separated=_s, kws_separated=_s, sim_abs=_s, sim_abs_weighted=_s, sep_best_sim=_s, aug_type=_s, orig_id=_s).fields,
])
RESULT = _struct(id=_s, content=_s, label=_s, cer=_d, similarity=_d, fused_sim=_d, is_target=_b, separation_used=_b, separated_source_count=T.IntegerType(), stages_time=T.MapType(_s, _d))
SUBMISSION = _struct(result=_struct(results=T.ArrayType(_struct(id=_s, content=_s, label=_s, cer=_s)), final_cer=_s, duration=_s))
CHECKPOINT = _struct(ckpt_key=_s, id=_s, content=_s, label=_s, cer=_d, similarity=_d)
WAVEFORM = _struct(path=_s, sample_rate=T.IntegerType(), samples=T.ArrayType(T.FloatType()))
TRIPLE = _struct(cam=_d, eres=_d, rnet=_d)
