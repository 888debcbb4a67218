"""Rule baselines: a mention's cluster is a key made of its own attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S


def _first(attrs, key: str) -> Column:
    return F.coalesce(F.lower(F.get(S.items(attrs, key), F.lit(0))), F.lit(""))


def _initial(x: Column) -> Column:
    return F.substring(x, 1, 1)


def keys(attrs="attrs", canopy="canopy") -> dict[str, Column]:
    """Baseline name -> cluster key."""
    fn, mn, ln = (_first(attrs, k) for k in ("fn", "mn", "ln"))
    c = F.coalesce(S._c(canopy), F.lit(""))
    return {
        "canopy": c,
        "name": F.concat_ws("|", c, _initial(fn), _initial(mn), ln),
        "strict_name": F.concat_ws("|", c, fn, mn, ln),
        "first_name": F.concat_ws("|", c, _initial(fn), ln),
        "strict_first_name": F.concat_ws("|", c, fn, ln),
    }


def cluster(mentions: DataFrame, baseline: str, *, attrs: str = "attrs", canopy: str = "canopy") -> DataFrame:
    """Mentions with their ``cluster``."""
    return mentions.withColumn("cluster", keys(attrs, canopy)[baseline])
