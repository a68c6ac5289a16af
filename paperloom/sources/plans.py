"""Search plans: a query per registered source from a raw question."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that name no compound.
STOPWORDS = "synthesis of how to make prepare synthesize show me find routes for".split()


def search_plans(questions: DataFrame, sources: Sequence[str], id_col: str, text_col: str, own: DataFrame | None = None) -> DataFrame:
    """(id, source, target, query): stopwords removed; sources without a query of their own get one made from the target.

    `sources` is the registry: the names of all readers there are. It is exploded as a list, so nothing is joined.
    """
    tokens = F.array_remove(F.split(F.lower(F.trim(text_col)), r"\s+"), "")
    target = F.array_join(F.filter(tokens, lambda t: ~t.isin(*STOPWORDS)), " ")
    plans = questions.select(F.col(id_col), F.coalesce(F.nullif(target, F.lit("")), F.trim(text_col)).alias("target"), F.explode(F.array(*map(F.lit, sorted(set(sources))))).alias("source"))
    made = F.concat("target", F.lit(" synthesis experimental methods"))
    if own is None:
        return plans.select(id_col, "source", "target", made.alias("query"))
    return plans.join(own, [id_col, "source"], "left").select(id_col, "source", "target", F.coalesce("query", F.concat("target", F.lit(" synthesis experimental"))).alias("query"))
