"""Dialogue acts by ordered rules over words, phrases and constructions. Cue lists are parameters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The cue lists that the rules look at; absent ones are empty. Phrases are space-joined words.
CUES = (
    "greet", "close", "close_phrases", "self_id", "self_id_phrases", "first_person", "authority", "problem", "problem_phrases", "reassure", "reassure_phrases", "confirm", "smalltalk", "instruct",
    "escalate_phrases", "clock_units", "clock_words", "clock_links", "otherwise", "wh", "resist", "resist_phrases", "ack", "backchannel", "comply_phrases", "naming",
)


def _in(words: Column, cues) -> Column:
    return F.arrays_overlap(words, F.array(*[F.lit(w) for w in sorted(cues)])) if cues else F.lit(False)


def _phrase(joined: Column, phrases) -> Column:
    """Whether a phrase occurs in words joined and bounded by single spaces."""
    return reduce(lambda a, b: a | b, [joined.contains(f" {p} ") for p in sorted(phrases)], F.lit(False))


def act_labels(turns: DataFrame, cues: dict[str, set[str]], *, words: str = "low", tokens: str = "tokens") -> DataFrame:
    """Adds ``act``. Turns carry speaker, turn_index, lower-case words and tokens, the construction flags,
    and the vocabulary's verdicts ``threatening``, ``hard_urgency`` and ``isolating``.

    The order of the rules is their meaning: for the called, resistance comes before compliance, a short
    acknowledgement before a question; for the caller, the strongest pressure first, then the ordinary
    business of a call. A turn without words is INFORM.
    """
    c = {k: set(cues.get(k, ())) for k in CUES}
    low = F.col(words)
    has = lambda k, n=None: _in(low if n is None else F.slice(low, 1, n), c[k])
    joined = F.concat(F.lit(" "), F.array_join(low, " "), F.lit(" "))
    says = lambda k: _phrase(joined, c[k])
    digits = F.exists(low, lambda w: w.rlike("^[0-9]+$"))
    n, at = F.size(low), F.col("turn_index")
    ack = has("ack", 2)
    callee = (
        F.when(has("resist") | says("resist_phrases"), "VICTIM_RESIST").when(digits | says("comply_phrases"), "VICTIM_COMPLY")
        .when(ack & (n <= 11) & (has("backchannel") | (n <= 7)), "CONFIRM").when(F.array_contains(low, "?") | has("wh"), "VICTIM_QUESTION")
        .when(ack, "VICTIM_COMPLY").when(has("greet", 2), "GREET").otherwise("INFORM")
    )
    clock = has("clock_units") | (has("clock_words") & has("clock_links"))
    threat, hard = F.col("threatening"), F.col("hard_urgency")
    first = F.sequence(F.lit(0), F.least(n, F.lit(4)) - 1)
    naming = F.array(*[F.lit(w) for w in sorted(c["naming"] or {""})])
    named = F.exists(first, lambda i: F.array_contains(naming, F.get(low, i)) & F.coalesce(F.get(F.col(tokens), i + 1).rlike(r"^\p{Lu}"), F.lit(False)))
    intro = says("self_id_phrases") | named | (has("first_person") & has("self_id"))
    caller = (
        F.when(F.col("secrecy_command") | F.col("isolating"), "ISOLATE").when(F.col("imperative_sensitive"), "REQUEST_SENSITIVE").when(threat & clock, "DEADLINE").when(clock & has("otherwise"), "DEADLINE")
        .when(says("escalate_phrases"), "PRESSURE_ESCALATE").when(threat & hard, "PRESSURE_ESCALATE").when(threat, "THREAT").when(hard & has("instruct"), "PRESSURE_ESCALATE")
        .when((F.col("authority_copula") | has("authority")) & intro, "IDENTIFY_SELF").when(F.col("authority_copula") | has("authority"), "AUTHORITY_ASSERT")
        .when(has("close", 3) | says("close_phrases") | (has("close") & (at > 2)), "CLOSE").when(has("greet", 2) & (at <= 1), "GREET").when(intro & (at <= 4), "IDENTIFY_SELF")
        .when(has("reassure") | says("reassure_phrases"), "REASSURE").when(has("instruct"), "INSTRUCT").when(has("problem") | says("problem_phrases"), "PROBLEM_STATE")
        .when(has("smalltalk"), "SMALLTALK").when(has("confirm"), "CONFIRM").when(has("greet", 1), "GREET").otherwise("INFORM")
    )
    return turns.withColumn("act", F.when(n <= 0, "INFORM").when(F.col("speaker") == "callee", callee).otherwise(caller))
