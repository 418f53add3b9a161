"""Weighted vocabularies over texts and tokens. A vocabulary is a table (family, term, weight)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import clip, sigmoid

# How much each family presses.
PRESSURE = {"urgency": 1.00, "threat": 1.30, "authority": 1.10, "personal": 1.40, "payment": 1.20, "isolation": 1.50, "bank": 0.45, "benign": -1.20}
#: What each construction adds to its words.
PATTERN_WEIGHTS = {"threat_near_time": 1.60, "imperative_sensitive": 1.90, "authority_copula": 1.50, "secrecy_command": 1.60, "never_ask_disclaimer": -1.70, "conditional_threat": 1.20}


def vocabulary(spark: SparkSession, rows: list[tuple[str, str, float]]) -> DataFrame:
    return spark.createDataFrame(rows, "family string, term string, weight double")


def _pieces(text: Column) -> Column:
    """Runs of a-z and single other characters."""
    return F.regexp_extract_all(text, F.lit("[a-z]+|[^a-z]"), F.lit(0))


def phrase_hits(texts: DataFrame, vocab: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, family, term, weight, piece) of the terms found in each text, lower case, blanks as one:
    longest first, no two hits of a family overlapping; a term ends where no a-z adjoins.

    Texts are cut to runs of letters and single characters. Stretches of as many pieces as the
    vocabulary's terms have meet the terms in an equi-join (Catalyst broadcasts the vocabulary if it is
    small); no text is tried against every term, and no row carries more than its stretch. Where all
    terms are single words none can overlap, and nothing is shuffled. Else hits are told apart by
    stretches of a text that overlap each other, and only those are weighed against one another.
    """
    low = F.concat(F.lit(" "), F.regexp_replace(F.trim(F.lower(F.coalesce(F.col(text), F.lit("")))), r"\s+", " "), F.lit(" "))
    v = vocab.select("family", "term", "weight", F.lower("term").alias("__gram"), F.size(_pieces(F.lower("term"))).alias("__k")).dropDuplicates(["family", "__gram"])
    kinds = v.select("__k", F.col("__gram").rlike("^[a-z]+$").alias("word")).distinct().collect()  # a row for each length of a term
    words_only = all(r["__k"] == 1 and r["word"] for r in kinds)
    t = texts.select(*keys, _pieces(low).alias("__p"))
    grams = t.select(*keys, F.posexplode("__p").alias("piece", "__gram")).where(F.col("__gram") >= "a").where(F.col("__gram") < "{")
    if not words_only:
        whole = [r["__k"] for r in kinds if not r["word"]]
        letter = lambda c: F.coalesce(c.rlike("^[a-z]"), F.lit(False))
        p, last = F.col("__p"), F.size("__p")

        def of_length(k: int) -> Column:
            inside = lambda i: (i + k <= last) & ~letter(F.get(p, i - 1)) & ~letter(F.get(p, i + k))
            every = F.transform(p, lambda _, i: F.struct(i.alias("i"), F.when(inside(i), F.array_join(F.slice(p, i + 1, k), "")).alias("gram")))
            return F.filter(every, lambda x: x["gram"].isNotNull())

        stretches = F.flatten(F.array(*[of_length(k) for k in sorted(set(whole))]))
        grams = grams.unionByName(t.select(*keys, F.explode(stretches).alias("x")).select(*keys, F.col("x.i").alias("piece"), F.col("x.gram").alias("__gram")))
    found = grams.join(v, "__gram")
    if words_only:
        return found.select(*keys, "family", "term", "weight", "piece")
    return _longest_first(found.withColumn("__size", F.length("term")), keys)


def _longest_first(found: DataFrame, keys: list[str]) -> DataFrame:
    """Of hits (keys, family, term, weight, piece, __k places wide) those that no larger ``__size`` of their
    family overlaps; of equals the first by term, then by place. Only stretches that touch are compared."""
    along = Window.partitionBy(*keys, "family").orderBy("piece", "__k")
    reach = F.max(F.col("piece") + F.col("__k")).over(along.rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("__new", F.when(F.col("piece") < reach, 0).otherwise(1)).withColumn("__island", F.sum("__new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    hit = F.struct((-F.col("__size")).alias("o"), F.col("term").alias("term"), F.col("piece").alias("i"), F.col("__k").alias("k"), F.col("weight").alias("weight"))
    grouped = found.distinct().groupBy(*keys, "family", "__island").agg(F.array_sort(F.collect_list(hit)).alias("h"))  # hits that touch each other
    # of a sorted list, a hit stays if it overlaps none that stays before it
    kept = F.aggregate(
        "h",
        F.expr("CAST(array() AS array<struct<o:int,term:string,i:int,k:int,weight:double>>)"),
        lambda acc, x: F.when(F.exists(acc, lambda y: (x["i"] < y["i"] + y["k"]) & (y["i"] < x["i"] + x["k"])), acc).otherwise(F.concat(acc, F.array(x))),
    )
    return grouped.select(*keys, "family", F.explode(kept).alias("x")).select(*keys, "family", "x.term", "x.weight", F.col("x.i").alias("piece"))


def token_hits(turns: DataFrame, vocab: DataFrame, keys: list[str], words: str = "low", canon=None) -> DataFrame:
    """(keys, family, term, weight, tok_start, tok_end): terms as runs of tokens, each as it stands or, with
    ``canon``, in its canonical spelling; within a family those of more tokens come first, and no token
    is used twice. An empty vocabulary: no rows."""
    v = vocab.select("family", "term", "weight", F.split(F.lower("term"), " ").alias("__t")).withColumn("__k", F.size("__t"))
    forms = [v.withColumn("__gram", F.array_join("__t", " "))]
    spelt = [words]
    t = turns
    if canon is not None:
        t = t.withColumn("__spelt", F.transform(words, canon))
        spelt.append("__spelt")
        forms.append(v.withColumn("__gram", F.array_join(F.transform("__t", canon), " ")))
    found = None
    for column, form in zip(spelt, forms, strict=True):
        for k in sorted(r["__k"] for r in form.select("__k").distinct().collect()):  # a row for each number of tokens
            grams = t.select(*keys, F.posexplode(_runs_of(column, k)).alias("piece", "__gram"))
            more = grams.join(form.where(F.col("__k") == k), "__gram").select(*keys, "family", "term", "weight", "piece", "__k", F.col("__k").alias("__size"))
            found = more if found is None else found.unionByName(more)
    if found is None:  # no terms, no hits
        none = t.select(*keys).crossJoin(v.select("family", "term", "weight").limit(0)).limit(0)
        return none.withColumns({"tok_start": F.lit(0), "tok_end": F.lit(0)})
    kept = _longest_first(found, keys)
    return kept.join(v.select("family", "term", "__k").distinct(), ["family", "term"]).select(*keys, "family", "term", "weight", F.col("piece").alias("tok_start"), (F.col("piece") + F.col("__k")).alias("tok_end"))


def _runs_of(words: str, k: int) -> Column:
    """Every run of ``k`` tokens, by the place of its first."""
    whole = F.filter(F.transform(words, lambda _, i: i), lambda i: i + k <= F.size(words))
    return F.transform(whole, lambda i: F.array_join(F.slice(words, i + 1, k), " "))


def family_sums(hits: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, w_<family>, n_<family>) for the eight families; absent ones are 0."""
    aggs = []
    for f in PRESSURE:
        own = F.col("family") == f
        aggs += [F.coalesce(F.sum(F.when(own, F.col("weight"))), F.lit(0.0)).alias(f"w_{f}"), F.count_if(own).alias(f"n_{f}")]
    return hits.groupBy(*keys).agg(*aggs)


def saturated(rate: float) -> Column:
    """Every family's pressure times 1 - exp(-rate * its sum), added up."""
    return reduce(lambda a, b: a + b, [w * (1 - F.exp(-rate * F.coalesce(F.col(f"w_{f}"), F.lit(0.0)))) for f, w in PRESSURE.items()])


def fallback_score() -> Column:
    """The lexicon's own intent score; .12 where nothing was found."""
    s = saturated(0.8)
    return F.when(s == 0, 0.12).otherwise(clip(0.5 + 0.32 * s, 0.0, 1.0))


def lexical_arousal(n_tokens: str, intent: str | None = None) -> Column:
    lex = clip(saturated(0.9) / (1 + F.log1p(F.greatest(F.col(n_tokens), F.lit(1)) / 12.0)) / 1.6, 0.0, 1.0)
    return lex if intent is None else F.when(F.col(intent).isNull(), lex).otherwise(clip(0.6 * lex + 0.4 * F.col(intent), 0.0, 1.0))


def _places(words: str, among: set[str] | list[str]) -> Column:
    """Positions, from 0, of the words in a set."""
    n = F.size(words)
    every = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    table = F.array(*[F.lit(w) for w in sorted(among)]).cast("array<string>")
    return F.filter(every, lambda i: F.array_contains(table, F.get(F.col(words), i)))


def construction_flags(df: DataFrame, sets: dict[str, set[str]], words: str = "low") -> DataFrame:
    """Adds the six constructions as booleans, from lower-case words and word sets named threat, time,
    time_unit, imperative, sensitive, authority, first_person, speak, negative, secrecy, negation and
    conditional."""
    at = {k: f"__{k}" for k in sets}
    df = df.withColumns({at[k]: _places(words, v) for k, v in sets.items()})
    low = F.col(words)
    units = F.array(*[F.lit(w) for w in sorted(sets["time_unit"])]).cast("array<string>")
    every = F.when(F.size(low) > 1, F.sequence(F.lit(0), F.size(low) - 2)).otherwise(F.array().cast("array<int>"))
    numbers = F.filter(every, lambda i: F.get(low, i).rlike("^[0-9]+$") & F.array_contains(units, F.get(low, i + 1)))
    df = df.withColumn("__time", F.array_union("__time", numbers))
    near = lambda a, b, d: F.exists(a, lambda x: F.exists(b, lambda y: F.abs(x - y) <= d))
    first = lambda c: F.array_min(F.col(c))
    none = F.lit(False)
    copula = F.coalesce((first("__first_person") < first("__authority")) & (F.array_max("__speak") > first("__first_person")), none)
    secrecy = F.exists("__negative", lambda i: F.exists("__secrecy", lambda j: F.abs(i - j) <= 4) & F.exists("__imperative", lambda j: (j >= i) & (j < i + 4)))
    never = F.exists("__sensitive", lambda s: F.exists("__negation", lambda g: F.abs(g - s) <= 5) & F.coalesce(first("__first_person") < s + 4, none))
    cond = F.exists("__conditional", lambda i: (i + 1 < F.size(low)) & F.exists("__threat", lambda j: (j >= i) & (j < i + 8)))
    return df.withColumns({
        "threat_near_time": near(F.col("__threat"), F.col("__time"), 8), "imperative_sensitive": near(F.col("__sensitive"), F.col("__imperative"), 5),
        "authority_copula": copula, "secrecy_command": secrecy, "never_ask_disclaimer": never, "conditional_threat": cond,
    }).drop(*at.values())


def rule_score(n_tokens: Column, lexicon_weight: Column, gain: float = 1.10, bias: float = 1.40) -> Column:
    """The rules' score from the sum of lexicon weights and the constructions' flags; empty: 0."""
    flags = reduce(lambda a, b: a + b, [F.when(F.col(k), w).otherwise(0.0) for k, w in PATTERN_WEIGHTS.items()])
    return F.when(n_tokens <= 0, 0.0).otherwise(sigmoid(gain * (lexicon_weight + flags - bias)))
