"""Reasons: sentences that a reader can check, from features and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import risk_band

TOP_ACTS = ("REQUEST_SENSITIVE", "ISOLATE", "PRESSURE_ESCALATE", "DEADLINE", "THREAT")
#: Entity counts in the order in which they are told, with what the caller did.
MENTIONS = (
    ("ent_otp", "asks about a one-time code"), ("ent_personal", "asks for personal details"), ("ent_authority", "claims an authority"),
    ("ent_threat", "sets a deadline under threat"), ("ent_payment", "names a payment handle"), ("ent_bank", "speaks of an account"),
)


def two(name: str) -> Column:
    """Two decimals, halves up, so that every engine prints the same."""
    return F.floor(F.col(name) * 100 + 0.5) / 100


def evidence(hits: DataFrame, entities: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, tok_start, tok_end, type, text, weight, source): what a reader is shown of a turn, the words
    that press and the entities, each with where it stands."""
    pressed = hits.select(*keys, "tok_start", "tok_end", F.col("family").alias("type"), F.col("term").alias("text"), "weight", F.lit("lexicon").alias("source"))
    named = entities.select(*keys, "tok_start", "tok_end", "type", F.col("token").alias("text"), F.lit(0.0).alias("weight"), F.lit("entity").alias("source"))
    return pressed.unionByName(named)


def write_reasons(df: DataFrame) -> DataFrame:
    """Adds ``reasons``: an array of sentences, in a fixed order.

    The rows carry n_<entity> counts, coercion_slope, peak_act, pim, intent_score, as_score (null
    without audio), callee_resist and risk.
    """
    said = []
    for name, what in MENTIONS:
        n = F.col(f"n_{name}")
        said.append(F.when(n > 0, F.concat(F.lit(f"The caller {what} ("), n.cast("string"), F.when(n > 1, " mentions).").otherwise(" mention)."))))
    said += [
        F.when(F.col("coercion_slope") > 0.05, F.format_string("Pressure climbs through the call (slope %.2f).", two("coercion_slope"))),
        F.when(F.col("peak_act").isin(*TOP_ACTS), F.concat(F.lit("The call reaches a "), F.lower(F.translate("peak_act", "_", " ")), F.lit(" turn."))),
        F.when(F.col("pim") >= 0.35, F.format_string("Pressing words come with flat delivery (mismatch %.2f).", two("pim"))).when((F.col("pim") < 0.15) & (F.col("intent_score") > 0.6), F.lit("Delivery follows the words.")),
        F.when(F.col("as_score").isNull(), F.lit("No audio: the transcript alone is judged.")).when(F.col("as_score") >= 0.6, F.format_string("The voice looks synthetic (%.2f).", two("as_score"))).when(F.col("as_score") <= 0.3, F.format_string("The voice varies as real speech does (%.2f).", two("as_score"))),
        F.when(F.col("callee_resist") > 0.3, F.format_string("The called person resists or asks in %.0f%% of their turns.", F.floor(100 * F.col("callee_resist") + 0.5).cast("double"))),
    ]
    found = F.array_compact(F.array(*said))
    found = F.when(F.size(found) == 0, F.array(F.lit("Nothing stands out."))).otherwise(found)
    low = F.when(F.col("risk") < 0.35, F.array(F.concat(F.lit("Overall risk is in the "), risk_band(F.col("risk")), F.lit(" band.")))).otherwise(F.array().cast("array<string>"))
    return df.withColumn("reasons", F.concat(found, low))
