"""Name matching for column mapping (TXT-12).

Each required target name is matched against a column of candidate names.
Tiers, highest first: rename map or exact (1.0), alias contained (0.9),
target contained (0.85), fuzzy ratio >= 0.5 (Ratcliff/Obershelp, Python's
``difflib``).  The best candidate per target is the highest tier, then the
highest score, then the earliest candidate.

The target list is configuration-sized and becomes a literal array: every distinct
name is scored against every target in one projection and the best
per target is a ``max_by`` aggregate with map-side partial aggregation -- no
join.  The fuzzy tier is tried only for targets that the others left open, and of their pairs only for
those whose characters allow the ratio: a bound from character counts, in the JVM.
What passes is scored by an Arrow-batched pandas UDF.
"""

from __future__ import annotations

import difflib
from collections.abc import Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXACT, ALIAS, SUBSTRING = 1.0, 0.9, 0.85
FUZZY_MIN = 0.5

# ship this module's UDF code with the task (executors need not have the package installed)
from pyspark import cloudpickle as _cloudpickle  # noqa: E402
import sys as _sys  # noqa: E402

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])


@F.pandas_udf(T.DoubleType())
def _ratio(targets: pd.Series, names: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, t, n).ratio() for t, n in zip(targets, names)])


def ratio_bound(target: str, name: Column) -> Column:
    """At least the ratio of ``target`` and ``name``: matching blocks cannot hold more of a character than both have."""
    shared = F.lit(0)
    for c in dict.fromkeys(target):
        shared = shared + F.least(F.lit(target.count(c)), F.length(name) - F.length(F.replace(name, F.lit(c), F.lit(""))))
    return 2.0 * shared / (F.length(name) + len(target))


def match_names(candidates: DataFrame, name_col: str, order_col: str, targets: Sequence[str],
                aliases: Mapping[str, Sequence[str]] | None = None, rename_map: Mapping[str, str] | None = None,
                fuzzy_min: float = FUZZY_MIN) -> DataFrame:
    """Best candidate per target: target, best, confidence, tier (null best when nothing matches)."""
    aliases = {k.lower(): [a.lower() for a in v] for k, v in (aliases or {}).items()}
    renamed = {k: v.lower() for k, v in (rename_map or {}).items()}
    spark = candidates.sparkSession
    # a name counts once, at its earliest place
    names = candidates.select(F.col(name_col).alias("__n"), F.col(order_col).alias("__o")).where("__n IS NOT NULL").groupBy("__n").agg(F.min("__o").alias("__o")).withColumn("__l", F.lower("__n"))
    ren = F.create_map(*[x for k, v in renamed.items() for x in (F.lit(k), F.lit(v))]) if renamed else None

    def best_of(pairs: DataFrame) -> list:
        key = F.struct(F.col("m.tier"), F.col("m.score"), (-F.col("__o")).alias("neg_order"))
        return pairs.groupBy("m.target").agg(F.max_by(F.struct("__n", "m.score", "m.tier"), key).alias("b")).select("target", "b.*").collect()  # a row a target

    per_target = []
    for t in targets:
        tl = t.lower()
        exact = F.col("__l") == F.lit(tl)
        if ren is not None:
            exact = F.coalesce(F.try_element_at(ren, F.col("__n")) == F.lit(tl), F.lit(False)) | exact
        alias = reduce(lambda a, b: a | b, (F.col("__l").contains(a) for a in aliases.get(tl, [])), F.lit(False))
        tier = F.when(exact, 4).when(alias, 3).when(F.col("__l").contains(tl), 2).otherwise(0)
        score = F.when(tier == 4, EXACT).when(tier == 3, ALIAS).otherwise(SUBSTRING)
        per_target.append(F.struct(F.lit(t).alias("target"), tier.alias("tier"), score.alias("score")))
    found = {r["target"]: r for r in best_of(names.select("__n", "__o", F.explode(F.array(*per_target)).alias("m")).where("m.tier > 0"))} if per_target else {}
    if left := [t for t in targets if t not in found]:
        open_ = F.array(*[F.struct(F.lit(t).alias("target"), F.lit(t.lower()).alias("low"), ratio_bound(t.lower(), F.col("__l")).alias("most")) for t in left])
        pairs = names.select("__n", "__o", "__l", F.explode(open_).alias("t")).where(F.col("t.most") >= fuzzy_min)
        scored = pairs.select("__n", "__o", F.struct(F.col("t.target").alias("target"), F.lit(1).alias("tier"), _ratio("t.low", "__l").alias("score")).alias("m"))
        found |= {r["target"]: r for r in best_of(scored.where(F.col("m.score") >= fuzzy_min))}
    tiers = {4: "exact", 3: "alias", 2: "substring", 1: "fuzzy"}
    rows = [(t, found[t]["__n"], float(found[t]["score"]), tiers[found[t]["tier"]]) if t in found else (t, None, 0.0, None) for t in targets]
    return spark.createDataFrame(rows, "target string, best string, confidence double, tier string")
