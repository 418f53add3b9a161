"""A corpus generator as a dataflow: plan rows first, then a call for each row where the row lies.

All randomness comes from hashes of (seed, call, place), so any row can be made alone and again. The
grammar is data: arcs of acts by class, templates by act, slots with typed values.
"""

from __future__ import annotations

import hashlib
import json
import re
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import TOKEN
from ..schema import ACTS, CALL, ENTITY_TYPES
from ..sources.transcripts import write_calls
from .corpus import assign_splits, counts_by, largest_remainder

TOPICS = ("bank", "parcel", "power", "phone", "tax")
ARCS = {
    1: (("caller", "GREET"), ("callee", "VICTIM_QUESTION"), ("caller", "IDENTIFY_SELF"), ("caller", "PROBLEM_STATE"), ("callee", "VICTIM_QUESTION"), ("caller", "THREAT"), ("caller", "REQUEST_SENSITIVE"), ("callee", "VICTIM_RESIST"), ("caller", "PRESSURE_ESCALATE")),
    0: (("caller", "GREET"), ("callee", "CONFIRM"), ("caller", "IDENTIFY_SELF"), ("caller", "INFORM"), ("callee", "VICTIM_QUESTION"), ("caller", "REASSURE"), ("caller", "CLOSE")),
}
TEMPLATES = {
    "GREET": ("Hello, good day.", "Good morning."), "VICTIM_QUESTION": ("Who is this?", "Why do you ask?"), "CONFIRM": ("Yes, tell me.", "All right."), "IDENTIFY_SELF": ("I am calling from {ORG}.", "This is {ORG} speaking."),
    "PROBLEM_STATE": ("There is a problem with your {ITEM}.", "Your {ITEM} is on hold."), "THREAT": ("It will be blocked {TIME}.", "You will be fined {TIME}."), "REQUEST_SENSITIVE": ("Tell me the {CODE} now.", "Read out the {CODE}."),
    "VICTIM_RESIST": ("I do not trust this.", "I will call back."), "PRESSURE_ESCALATE": ("This is the last chance.", "Decide now."), "INFORM": ("Your {ITEM} is ready.", "The {ITEM} was updated."), "REASSURE": ("There is no hurry.", "Nothing to pay."), "CLOSE": ("Thank you, bye.", "Have a good day."),
}
SLOTS = {
    "ORG": ("AUTHORITY_CLAIM", ("the police", "the tax office", "City Bank")), "ITEM": ("BANK_ENTITY", ("account", "debit card", "parcel")), "TIME": ("THREAT_DEADLINE", ("in 10 minutes", "tonight")), "CODE": ("OTP", ("one time code", "pin")),
}


class Grammar(NamedTuple):
    """What calls are made of: arcs of (speaker, act) by class, templates by act, slots (type, values)."""

    arcs: dict = ARCS
    templates: dict = TEMPLATES
    slots: dict = SLOTS

    def fingerprint(self) -> str:
        """A digest of all that the grammar says, whatever the order in which it is written."""
        held = {"arcs": self.arcs, "templates": self.templates, "slots": self.slots}
        return hashlib.sha256(json.dumps(held, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:16]

    def faults(self) -> list[str]:
        """What would make a call fail or tell on itself: acts without templates, slots without values,
        acts that no rank knows, and a slot's value written out in a template."""
        used = {act for arc in self.arcs.values() for _, act in arc}
        named = {(a, s) for a, ts in self.templates.items() for t in ts for s in re.findall(r"\{(\w+)\}", t)}
        out = [f"no template: {a}" for a in sorted(used - {a for a, t in self.templates.items() if t})]
        out += [f"unknown act: {a}" for a in sorted(used - set(ACTS))]
        out += [f"no slot: {a} {s}" for a, s in sorted(named) if not self.slots.get(s, ("", ()))[1]]
        out += [f"unknown type: {s}" for s, (kind, _) in sorted(self.slots.items()) if kind not in ENTITY_TYPES]
        out += [f"leak: {a} {v}" for a, ts in sorted(self.templates.items()) for t in ts for _, vs in self.slots.values() for v in vs if re.search(rf"\b{re.escape(v)}\b", t)]
        return out


DEFAULT = Grammar()


def plan(spark: SparkSession, n: int, seed: int, speakers: int = 24, proportions: tuple[tuple[str, float], ...] = (("train", 0.5), ("dev", 0.25), ("test", 0.25)), unpaired: float = 0.25) -> DataFrame:
    """(call_id, label_scam, topic, split, label_voice, speaker_id, style): topics in turn, classes paired
    by topic but for the ``unpaired`` share, voices independent of classes, a speaker in one split."""
    pool = spark.range(speakers).select(F.format_string("spk_%02d", F.col("id").cast("int")).alias("speaker_id"))
    parts = largest_remainder(spark.createDataFrame(list(proportions), "name string, weight double"), speakers)
    order = spark.createDataFrame([(p[0], k) for k, p in enumerate(proportions)], "name string, pos int")
    key = lambda *c: F.md5(F.concat_ws(":", F.lit(seed), *c).cast("binary"))
    split = assign_splits(pool, parts.join(order, "name"), key(F.lit("split"), "speaker_id"))
    ranked = split.withColumn("__k", F.row_number().over(Window.orderBy("speaker_id")) - 1)  # one row for each speaker
    i = F.col("id")
    draw = lambda what: F.pmod(F.xxhash64(F.lit(seed), F.lit(what), i), F.lit(1000)) / 1000.0
    calls = spark.range(n).withColumn("__k", F.pmod(i, F.lit(speakers)))
    topic = F.element_at(F.array(*[F.lit(t) for t in TOPICS]), (F.pmod(F.floor(i / 2), F.lit(len(TOPICS))) + 1).cast("int"))
    label = F.when(draw("pair") < unpaired, (draw("label") < 0.5).cast("int")).otherwise(F.pmod(i, F.lit(2)).cast("int"))
    return calls.join(ranked, "__k").select(
        F.format_string("call_%05d", i.cast("int")).alias("call_id"), label.alias("label_scam"), topic.alias("topic"), F.concat_ws("_", topic, F.when(label == 1, "scam").otherwise("benign")).alias("scenario"), "split",
        F.when(draw("voice") < 0.5, "synthetic").otherwise("human").alias("label_voice"), "speaker_id", F.when((label == 1) & (draw("mild") < 0.15), "mild").otherwise("plain").alias("style"), F.lit(seed).cast("long").alias("seed"),
    )


def _pick(options, *key):
    return options[int(hashlib.md5(":".join(map(str, key)).encode()).hexdigest()[:8], 16) % len(options)]


def render(template: str, *key, grammar: Grammar = DEFAULT) -> tuple[list[str], list[str]]:
    """Tokens and their tags by construction: a slot's words are one span of its type."""
    tokens, bio = [], []
    for part in re.split(r"(\{\w+\})", template):
        slot = grammar.slots.get(part[1:-1]) if part[:1] == "{" else None
        words = re.findall(TOKEN, _pick(slot[1], *key, part) if slot else part)
        tokens += words
        bio += [("B-" if k == 0 else "I-") + slot[0] for k in range(len(words))] if slot else ["O"] * len(words)
    return tokens, bio


def call_turns(call_id: str, label: int, seed: int, style: str = "plain", grammar: Grammar = DEFAULT) -> list[dict]:
    turns, clock = [], 0.0
    for k, (speaker, act) in enumerate(grammar.arcs[label]):
        if style == "mild" and act == "PRESSURE_ESCALATE":
            continue
        tokens, bio = render(_pick(grammar.templates[act], seed, call_id, k), seed, call_id, grammar=grammar)  # a call keeps its slots
        end = clock + max(0.7, len(tokens) / 2.6)
        turns.append({"index": len(turns), "speaker": speaker, "text": " ".join(tokens), "act": act, "tokens": tokens, "bio": bio, "lang": ["en"] * len(tokens), "t_start": round(clock, 3), "t_end": round(end, 3)})
        clock = end + 0.25
    return turns


def generate(planned: DataFrame, grammar: Grammar = DEFAULT) -> DataFrame:
    """Whole calls of plan rows."""
    names = [f.name for f in CALL.fields]

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                rows.append({
                    "call_id": r.call_id, "turns": call_turns(r.call_id, int(r.label_scam), int(r.seed), r.style, grammar), "label_scam": r.label_scam, "label_voice": r.label_voice, "scenario": r.scenario, "speaker_id": r.speaker_id,
                    "split": r.split, "audio_path": None, "sample_rate": 8000, "channel": "clean", "audio_source": "none", "meta": {"style": r.style, "topic": r.topic}, "schema_version": "1.0",
                })
            yield pd.DataFrame(rows, columns=names)

    return planned.mapInPandas(run, CALL)


def generate_one(spark: SparkSession, call_id: str, label: int, seed: int, topic: str = TOPICS[0], style: str = "plain", grammar: Grammar = DEFAULT) -> DataFrame:
    """A single call outside all splits, as a plan row would make it."""
    row = spark.createDataFrame([(call_id, label, topic, f"{topic}_{'scam' if label else 'benign'}", "none", "human", "none", style, seed)], "call_id string, label_scam int, topic string, scenario string, split string, label_voice string, speaker_id string, style string, seed long")
    return generate(row, grammar)


def write_corpus(calls: DataFrame, path: str, grammar: Grammar = DEFAULT) -> None:
    """The calls as JSON by split, in place of what was there, and beside them a manifest: how many of each
    split, voice and scenario, and the grammar's digest."""
    write_calls(calls, f"{path}/calls")
    counts = counts_by(calls, [["split"], ["label_voice"], ["scenario"], ["split", "label_voice"]])
    counts.withColumn("grammar", F.lit(grammar.fingerprint())).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
