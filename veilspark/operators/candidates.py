"""Which provider rules are worth running on which documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..rules.keywords import pass_pattern, words_implying
from ..rules.table import Rule


def rule_candidates(df: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """Documents paired with the rules whose keywords occur in them.

    One pass over each text reports the distinct keywords; the pairing is a hash
    join with the keyword table, which is as small as the rule catalogue.
    """
    words = sorted({w for r in rules for w in r.literals})
    pairs = sorted({(w, r.rule_id) for r in rules for k in r.literals for w in words_implying(k, words)})
    values = F.explode(F.array(*(
        F.struct(F.lit(w).alias("keyword"), F.lit(r).alias("rule_id")) for w, r in pairs
    )))
    catalogue = df.sparkSession.range(1).select(values.alias("p")).select("p.*")
    keys = [c for c in df.columns if c != text]
    lower = F.lower(F.replace(F.replace(F.col(text), F.lit("\u212a"), F.lit("\x01")), F.lit("\u0130"), F.lit("\x01")))
    found = df.select(*keys, F.explode(F.array_distinct(F.regexp_extract_all(lower, F.lit(pass_pattern(words)), F.lit(1)))).alias("keyword"))
    return found.join(F.broadcast(catalogue), "keyword").select(*keys, "rule_id").distinct()
