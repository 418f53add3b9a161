"""Code mixing of one turn or call from arrays: tokens, their languages, their entity tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def code_mixing(tokens: Column, langs: Column, bio: Column | None, first: str, second: str) -> Column:
    """A struct of (n_tokens, cmi, first_ratio, second_ratio, univ_ratio, switch_rate, ent_tokens,
    ent_lang_align), all double.

    Ratios are over all tokens; the index, the switches and the share of ``second`` among entity tokens
    over those of the two languages alone. Without tokens, or where tokens or langs are null, all are 0;
    without tags the last two are. Arrays of unequal length are an error, as tags of other tokens would
    count silently.
    """
    n, m = F.coalesce(F.size(tokens), F.lit(0)), F.coalesce(F.size(langs), F.lit(0))
    of = lambda array, *names: F.size(F.filter(array, lambda x: x.isin(*names))).cast("double")
    over = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    mixed = F.filter(langs, lambda x: x.isin(first, second))
    both = F.size(mixed).cast("double")
    switches = F.size(F.filter(F.zip_with(mixed, F.slice(mixed, 2, F.greatest(F.size(mixed), F.lit(1))), lambda x, y: x != y), lambda x: x)).cast("double")
    held = F.lit(0.0), F.lit(0.0)
    unequal = n != m
    if bio is not None:
        tagged = F.transform(F.filter(F.arrays_zip(langs.alias("lang"), bio.alias("bio")), lambda x: x["bio"] != "O"), lambda x: x["lang"])
        held = F.coalesce(of(tagged, first), F.lit(0.0)), F.coalesce(of(tagged, second), F.lit(0.0))
        unequal = unequal | (F.size(bio) != n)
    said = F.format_string("%d language tags for %d tokens, or as many entity tags", m, n)
    share = lambda name: F.coalesce(over(of(langs, name), n), F.lit(0.0))
    out = F.struct(
        n.cast("double").alias("n_tokens"), F.coalesce(over(both - F.greatest(of(langs, first), of(langs, second)), both), F.lit(0.0)).alias("cmi"),
        share(first).alias("first_ratio"), share(second).alias("second_ratio"), share("univ").alias("univ_ratio"), F.coalesce(switches / F.greatest(both - 1, F.lit(1.0)), F.lit(0.0)).alias("switch_rate"),
        (held[0] + held[1]).alias("ent_tokens"), over(held[1], held[0] + held[1]).alias("ent_lang_align"),
    )
    return F.when(F.coalesce(unequal, F.lit(False)), F.raise_error(said).cast(_TYPE)).otherwise(out)


_TYPE = "struct<" + ",".join(f"{c}:double" for c in ("n_tokens", "cmi", "first_ratio", "second_ratio", "univ_ratio", "switch_rate", "ent_tokens", "ent_lang_align")) + ">"
