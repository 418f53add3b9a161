"""The call model: nested calls, flat turns, and the small dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN = T.StructType([
    T.StructField("index", T.IntegerType()), T.StructField("speaker", T.StringType()), T.StructField("text", T.StringType()), T.StructField("act", T.StringType()),
    T.StructField("tokens", T.ArrayType(T.StringType())), T.StructField("bio", T.ArrayType(T.StringType())), T.StructField("lang", T.ArrayType(T.StringType())),
    T.StructField("t_start", T.DoubleType()), T.StructField("t_end", T.DoubleType()),
])
CALL = T.StructType([
    T.StructField("call_id", T.StringType()), T.StructField("turns", T.ArrayType(TURN)), T.StructField("label_scam", T.IntegerType()), T.StructField("label_voice", T.StringType()),
    T.StructField("scenario", T.StringType()), T.StructField("speaker_id", T.StringType()), T.StructField("split", T.StringType()), T.StructField("audio_path", T.StringType()),
    T.StructField("sample_rate", T.IntegerType()), T.StructField("channel", T.StringType()), T.StructField("audio_source", T.StringType()), T.StructField("meta", T.MapType(T.StringType(), T.StringType())),
    T.StructField("schema_version", T.StringType()),
])

# Label spaces and the coercion rank of each dialogue act.
ENTITY_TYPES = ("OTP", "BANK_ENTITY", "AUTHORITY_CLAIM", "THREAT_DEADLINE", "PAYMENT_HANDLE", "PERSONAL_INFO_REQ", "MONEY_AMOUNT")
ACT_RANK = {
    "GREET": 0.0, "SMALLTALK": 0.0, "VICTIM_QUESTION": 0.0, "VICTIM_RESIST": 0.0, "VICTIM_COMPLY": 0.0,
    "IDENTIFY_SELF": 0.10, "INFORM": 0.10, "CONFIRM": 0.15, "CLOSE": 0.20, "REASSURE": 0.30, "PROBLEM_STATE": 0.35,
    "INSTRUCT": 0.50, "AUTHORITY_ASSERT": 0.55, "THREAT": 0.80, "DEADLINE": 0.85, "ISOLATE": 0.90,
    "REQUEST_SENSITIVE": 0.95, "PRESSURE_ESCALATE": 1.00,
}
ACTS = tuple(ACT_RANK)
BANDS = (("low", 0.35), ("elevated", 0.65), ("high", 0.85))
#: The 25 features of the fused score: name, group, direction.
FEATURES = (
    ("as_score", "voice", 1), ("as_llr", "voice", 1), ("as_margin", "voice", 1), ("spk_consistency", "voice", -1), ("jitter", "voice", -1), ("shimmer", "voice", -1),
    ("hnr", "voice", 1), ("spec_flatness_var", "voice", -1), ("intent_score", "intent", 1), ("intent_max_turn", "intent", 1), ("urgency_density", "intent", 1),
    ("ent_otp", "intent", 1), ("ent_authority", "intent", 1), ("ent_threat", "intent", 1), ("ent_payment", "intent", 1), ("ent_personal", "intent", 1), ("ent_bank", "intent", 1),
    ("pim", "cross", 1), ("coercion_slope", "cross", 1), ("coercion_peak", "cross", 1), ("act_scam_llr", "cross", 1), ("cmi", "cross", 1), ("switch_entropy", "cross", 1),
    ("ent_lang_align", "cross", -1), ("callee_resist", "cross", 1),
)
ARMS = {
    "audio_only": ("voice",),
    "text_only": ("intent",),
    "late_fusion": ("voice", "intent"),
    "full": ("voice", "intent", "cross"),
}


def arm_features(arm: str) -> list[str]:
    """The features that an ablation arm may see."""
    return [name for name, group, _ in FEATURES if group in ARMS[arm]]


def risk_band(risk: Column) -> Column:
    out = F
    for name, below in BANDS:
        out = out.when(risk < below, name)
    return out.otherwise("critical")


def act_ranks(spark: SparkSession) -> DataFrame:
    """(act, rank): a dimension of 18 rows."""
    return spark.createDataFrame(list(ACT_RANK.items()), "act string, rank double")


def turns_of(calls: DataFrame) -> DataFrame:
    """Flat turns of nested calls; empty tokens are cut from the text, empty bio and lang filled, and
    a row with tags of another length than its tokens fails."""
    from .functions.text import tokens

    t = calls.select("call_id", F.posexplode("turns").alias("k", "t")).select("call_id", F.coalesce("t.index", "k").alias("turn_index"), "t.*").drop("index")
    t = t.withColumn("tokens", F.when(F.coalesce(F.size("tokens"), F.lit(0)) <= 0, tokens("text")).otherwise(F.col("tokens")))
    for name, fill in (("bio", "O"), ("lang", "univ")):
        filled = F.when(F.coalesce(F.size(name), F.lit(0)) <= 0, F.array_repeat(F.lit(fill), F.size("tokens"))).otherwise(F.col(name))
        t = t.withColumn(name, filled)
        wrong = F.raise_error(F.concat(F.lit(f"{name} and tokens differ in length in call "), F.col("call_id")))
        t = t.withColumn(name, F.when(F.size(name) == F.size("tokens"), F.col(name)).otherwise(wrong))
    return t.withColumn("duration", F.greatest(F.lit(0.0), F.col("t_end") - F.col("t_start")))


def turns_of_conversations(conversations: DataFrame) -> DataFrame:
    """(call_id, turn_index, speaker, text): assistants call, users are called, systems are neither."""
    speaker = F.when(F.col("role") == "assistant", "caller").when(F.col("role") == "user", "callee").otherwise("system")
    return conversations.select(F.col("conv_id").alias("call_id"), F.col("turn").alias("turn_index"), speaker.alias("speaker"), "text")


def calls_of_turns(turns: DataFrame, *call_columns: str) -> DataFrame:
    """Nested calls of flat turns, in turn order."""
    fields = [F.col("turn_index").cast("int").alias("index")] + [F.col(f.name) if f.name in turns.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in TURN.fields[1:]]
    return turns.groupBy("call_id", *call_columns).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("turns"))
