"""A corpus in numbers from one reading: turns fold to a row for each call, calls to (measure, key, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import ACTS, ENTITY_TYPES

CLASSES = ("scam", "benign")
#: Decimal places of the measures that are no counts; all others have four.
PLACES = {"mean_cmi": 3, "mean_turns_per_call": 3, "mean_tokens_per_turn": 3, "mean_duration_s": 3, "total_duration_s": 3, "cmi_by_class.switch_rate": 3}


def call_sums(turns: DataFrame, langs: tuple[str, str], *, key: str = "call_id", order: str = "turn_index", rate: float = 2.6, least: float = 0.7, gap: float = 0.25) -> DataFrame:
    """A row for each call from turns of (key, order, n_tokens, act, rank, lang, type).

    ``lang`` and ``type`` are arrays with one entry a token: its language, its entity's type or null.
    Language changes are counted over the call's tokens of the two languages. Only numbers and the ends
    of a turn's languages are shuffled, by call; the window and the sums share that one exchange. A null
    array is a turn without tokens, a null act or rank counts as none and 0.
    """
    a, b = langs
    count = lambda array, test: F.coalesce(F.size(F.filter(array, test)), F.lit(0)).cast("long")
    one = lambda name, value: count(name, lambda x: x == value)
    spoken = F.filter("lang", lambda x: x.isin(a, b))
    carried = F.filter(F.arrays_zip("lang", "type"), lambda x: x["type"].isNotNull())
    said = {f"lang_{x}": one("lang", x) for x in (a, b, "univ")}
    typed = {f"type_{t}": one("type", t) for t in ENTITY_TYPES}
    carrying = lambda value: count(carried, lambda x: x["lang"] == value)
    held = {f"in_{x}": carrying(x) for x in (a, b)}
    t = turns.withColumn("__spoken", spoken).select(
        key, order, F.coalesce("n_tokens", F.lit(0)).cast("long").alias("tokens"), "act", F.coalesce("rank", F.lit(0.0)).alias("rank"), *[v.alias(k) for k, v in (said | typed | held).items()],
        F.get("__spoken", F.lit(0)).alias("__first"), F.get("__spoken", F.size("__spoken") - 1).alias("__last"),
        F.coalesce(F.size(F.filter(F.zip_with("__spoken", F.slice("__spoken", 2, F.greatest(F.size("__spoken"), F.lit(1))), lambda x, y: x != y), lambda x: x)), F.lit(0)).alias("__inner"),
    )
    before = F.last("__last", ignorenulls=True).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    t = t.withColumn("__switches", F.col("__inner") + F.coalesce((before != F.col("__first")).cast("int"), F.lit(0)))
    length = F.greatest(F.lit(least), F.col("tokens") / rate)
    sums = [F.sum(c).alias(c) for c in ("tokens", *said, *typed, *held)] + [F.count_if(F.col("act") == x).alias(f"act_{x}") for x in ACTS]
    out = t.groupBy(key).agg(F.count("*").alias("turns"), F.sum("__switches").alias("switches"), (F.sum(length) + gap * (F.count("*") - 1)).alias("seconds"), F.avg("rank").alias("coercion"), F.max("rank").alias("peak"), F.min_by("act", order).alias("first_act"), *sums)
    both, most = F.col(f"lang_{a}") + F.col(f"lang_{b}"), F.greatest(f"lang_{a}", f"lang_{b}")
    return out.withColumn("cmi", F.when(both > 0, 1 - most / both).otherwise(0.0))


def census(calls: DataFrame, langs: tuple[str, str], *, scam: Column, scenario: Column, cell: Column, split: Column, speaker: Column, hard_negative: Column, mild_scam: Column) -> DataFrame:
    """(measure, key, value) of calls as ``call_sums`` gives them.

    Each call yields its part of every measure as (measure, key, part, value, weight); they are summed
    before the shuffle, so what moves does not grow with the calls, but for the distinct speakers of a
    split (``part``), which are counted in a second step. Counts have no weight; means and ratios are sums
    over sums, 0 where nothing weighs. Acts and languages that do not occur have no row, entity types
    have one; a null attribute is counted under the key ''; no calls, no rows.
    """
    a, b = langs
    is_scam = F.coalesce(scam, F.lit(False))
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    number = lambda c: c.cast("double")
    facts = []

    def add(measure: str, value: Column | int = 1, key: Column | str = "", weight: Column | None = None, part: Column | None = None, when: Column | None = None) -> None:
        key = text(key) if isinstance(key, Column) else F.lit(key)
        value = number(value if isinstance(value, Column) else F.lit(value))
        row = F.struct(F.lit(measure).alias("measure"), key.alias("key"), (F.lit(None).cast("string") if part is None else text(part)).alias("part"), value.alias("value"), (F.lit(None).cast("double") if weight is None else number(weight)).alias("weight"))
        facts.append(row if when is None else F.when(when, row))

    c = F.col
    add("n_calls")
    add("n_turns", c("turns"))
    add("n_tokens", c("tokens"))
    add("n_entities", sum((c(f"type_{t}") for t in ENTITY_TYPES), F.lit(0)))
    add("n_scam", is_scam.cast("int"))
    add("n_benign", (~is_scam).cast("int"))
    add("n_hard_negatives", F.coalesce(hard_negative, F.lit(False)).cast("int"))
    add("n_mild_scams", F.coalesce(mild_scam, F.lit(False)).cast("int"))
    for t in ENTITY_TYPES:
        add("entities", c(f"type_{t}"), t)
        add("entities_per_type", c(f"type_{t}"), t)
    for x in ACTS:
        add("acts", c(f"act_{x}"), x, when=c(f"act_{x}") > 0)
    for x in (a, b, "univ"):
        add("lang_tokens", c(f"lang_{x}"), x, when=c(f"lang_{x}") > 0)
    add("scenarios", key=scenario)
    add("scam_scenarios", key=scenario, part=F.lit(""), when=is_scam)
    add("benign_scenarios", key=scenario, part=F.lit(""), when=~is_scam)
    add("cells", key=cell)
    add("splits", key=split)
    add("cells_by_split", key=F.concat_ws("/", text(split), text(cell)))
    add("speakers_per_split", key=split, part=speaker)
    add("mean_cmi", c("cmi"), weight=F.lit(1))
    add("switch_points", c("switches"))
    add("mean_turns_per_call", c("turns"), weight=F.lit(1))
    add("mean_tokens_per_turn", c("tokens"), weight=c("turns"))
    add("mean_duration_s", c("seconds"), weight=F.lit(1))
    add("total_duration_s", c("seconds"))
    for name in CLASSES:
        mine = (is_scam if name == "scam" else ~is_scam).cast("int")
        spoken, held = c(f"lang_{a}") + c(f"lang_{b}"), c(f"in_{a}") + c(f"in_{b}")
        add("mean_coercion", c("coercion") * mine, name, mine)
        add("cmi_by_class.cmi", c("cmi") * mine, name, mine)
        add("cmi_by_class.switch_rate", 100 * c("switches") * mine, name, spoken * mine)
        add("cmi_by_class.en_ratio", c(f"lang_{a}") * mine, name, spoken * mine)
        add("cmi_by_class.ent_lang_align", c(f"in_{a}") * mine, name, held * mine)
        add("cmi_by_class.n_entity_tokens", held * mine, name)
    # an array of the facts that hold; whole numbers stay exact in doubles up to 2**53
    rows = calls.select(F.explode(F.array_compact(F.array(*facts))).alias("f")).select("f.*")
    parts = rows.groupBy("measure", "key", "part").agg(F.sum("value").alias("value"), F.sum("weight").alias("weight"))
    n = F.sum("value")
    value = F.when(F.count("part") > 0, F.count("part").cast("double")).when(F.count("weight") > 0, F.when(F.sum("weight") > 0, n / F.sum("weight")).otherwise(0.0)).otherwise(n)
    out = parts.groupBy("measure", "key").agg(value.alias("value"))
    return out.withColumn("value", F.when(F.col("measure").isin(*PLACES), F.round("value", 3)).otherwise(F.round("value", 4)))
