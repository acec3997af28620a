"""Ordered admission under quotas of several scopes: what was refused is never charged."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.operators.prefix import earlier, placed
from loomstone.sources.folders import settle

#: (scope, cost, most, code of the refusal), in the order in which they are asked.
Limit = tuple[str, str, int, str]

#: Requests that one task may settle one after another.
FOLD = 20_000


def _any(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def admit(requests: DataFrame, order: Sequence[str], scopes: dict[str, list[str]], costs: Sequence[str], limits: Sequence[Limit], key: str | None = None, fold: int = FOLD) -> DataFrame:
    """Add ``verdict``: 'admitted', 'attached' or the code of the first limit that the request would break.

    Requests are taken in ``order``.  An admitted request adds its ``costs`` to the totals of every scope it lies in (the
    columns of a scope name its totals; none: one for all); a refused one adds nothing.  With ``key``, a request whose key was
    admitted before is attached to that at no cost.

    The totals before a request lie between those of what is surely admitted and those of what may be.  What fits at the
    most, or breaks a limit at the least, is settled, all scopes at once; then the bounds are closer, and only open requests and newly
    admitted ones are looked at again.  The first open request always settles.  Without a key, the
    first ``fold`` requests of what the scopes have in common are settled in order ahead of that.  Once at most ``fold`` are open in
    what the scopes have in common, a task settles those in order, from the bounds that each of them carries.

    A null cost is 0, a null in a scope is a value of its own, a null key never attaches.  Ties in ``order`` are broken by
    where the rows lie.
    """
    common = [c for c in next(iter(scopes.values())) if all(c in by for by in scopes.values())]
    columns = list(dict.fromkeys(c for by in scopes.values() for c in by))
    told = {f"c_{c}": F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")) for c in costs}
    rows = placed(requests, order).withColumns(told)
    keys = [F.col(key).alias("k_")] if key else []
    low = [f"low_{s}_{c}" for s in scopes for c in costs]
    open_ = rows.select("place", "bucket", *columns, *keys, *told, *[F.lit(0).cast("long").alias(x) for x in low])
    fresh, settled = open_.limit(0), []
    if not key:
        settled, open_ = _begun(open_, common, scopes, costs, limits, fold)
    while key or not open_.isEmpty():
        everything = open_.withColumn("sure", F.lit(False)).unionByName(fresh.withColumn("sure", F.lit(True)))
        everything = everything.withColumns({f"s_{c}": F.when(F.col("sure"), F.col(c)).otherwise(0) for c in told})
        for s, by in scopes.items():
            sums = {f"at_{s}_{c}": f"s_c_{c}" for c in costs} | {f"may_{s}_{c}": f"c_{c}" for c in costs}
            everything = earlier(everything, by, sums)
        near = everything
        if key:
            firsts = near.where("k_ IS NOT NULL").groupBy("k_").agg(F.min(F.when(F.col("sure"), F.col("place"))).alias("sure_place"), F.min(F.when(~F.col("sure"), F.col("place"))).alias("open_place"))
            near = near.join(firsts, "k_", "left")
        bounds = {f"low_{s}_{c}": F.col(f"low_{s}_{c}") + F.col(f"at_{s}_{c}") for s in scopes for c in costs}
        # what may have been admitted before includes what surely was
        highs = {f"high_{s}_{c}": F.col(f"low_{s}_{c}") + F.col(f"may_{s}_{c}") for s in scopes for c in costs}
        near = near.where("NOT sure").withColumns(highs).withColumns(bounds)
        above = lambda bound: _any([F.col(f"{bound}_{s}_{c}") + F.col(f"c_{c}") > most for s, c, most, _ in limits])
        status = F.when(~above("high"), "admitted").when(above("low"), "refused")
        if key:
            status = F.when(F.col("sure_place") < F.col("place"), "attached").when(F.col("open_place") < F.col("place"), None).otherwise(status)
        near = settle(near.withColumn("status", status).select(*open_.columns, "status"))
        settled.append(near.where("status IS NOT NULL").select("place", "status"))
        open_, fresh = near.where("status IS NULL").drop("status"), near.where("status = 'admitted'").drop("status")
        most_open = open_.groupBy(*common).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        if most_open <= fold:
            break
    else:
        most_open = 0
    if most_open:
        settled.append(_folded(_carried(open_, fresh, scopes, costs), common, scopes, costs, limits, bool(key)))
    verdicts = reduce(DataFrame.unionByName, settled)
    return _coded(rows.join(verdicts, "place"), scopes, costs, limits, requests.columns)


def _begun(open_: DataFrame, common: list[str], scopes: dict[str, list[str]], costs: Sequence[str], limits: Sequence[Limit], fold: int) -> tuple[list[DataFrame], DataFrame]:
    """The first ``fold`` requests of what the scopes have in common, settled in order, and what that leaves no room for; and the rest.

    All that is settled in order lies before the rest, so its totals need no ordered sums: they are the rest's lower bounds.
    """
    first = Window.partitionBy(*common).orderBy("place")
    head = settle(open_.withColumn("n_", F.row_number().over(first)).where(F.col("n_") <= fold), "head")
    done = settle(_folded(head, common, scopes, costs, limits, False), "done")
    full = head.groupBy(*common).agg(F.max("place").alias("upto_"), F.max("n_").alias("n_")).where(F.col("n_") == fold)
    same = lambda rows, other, by: [rows[c].eqNullSafe(other[f"of_{c}"]) for c in by]
    full = full.select(*[F.col(c).alias(f"of_{c}") for c in common], "upto_")
    rest = open_.join(full, same(open_, full, common)) if common else open_.crossJoin(F.broadcast(full))
    rest = rest.where("place > upto_").select(*open_.columns)
    charged = head.join(done.where("status = 'admitted'"), "place")
    for s, by in scopes.items():
        sums = charged.groupBy(*by).agg(*[F.sum(f"c_{c}").alias(f"sum_{c}") for c in costs]).select(*[F.col(c).alias(f"of_{c}") for c in by], *[f"sum_{c}" for c in costs])
        met = rest.join(sums, same(rest, sums, by), "left") if by else rest.crossJoin(F.broadcast(sums))
        rest = met.withColumns({f"low_{s}_{c}": F.coalesce(f"sum_{c}", F.lit(0).cast("long")) for c in costs}).select(*open_.columns)
    refused = _any([F.col(f"low_{s}_{c}") + F.col(f"c_{c}") > most for s, c, most, _ in limits])
    rest = settle(rest.withColumn("status", F.when(refused, "refused")), "rest")
    return [done, rest.where("status IS NOT NULL").select("place", "status")], rest.where("status IS NULL").drop("status")


def _carried(open_: DataFrame, fresh: DataFrame, scopes: dict[str, list[str]], costs: Sequence[str]) -> DataFrame:
    """Open requests with the totals of all that is surely admitted before them."""
    both = open_.withColumn("sure", F.lit(False)).unionByName(fresh.withColumn("sure", F.lit(True)))
    both = both.withColumns({f"s_c_{c}": F.when(F.col("sure"), F.col(f"c_{c}")).otherwise(0) for c in costs})
    for s, by in scopes.items():
        both = earlier(both, by, {f"at_{s}_{c}": f"s_c_{c}" for c in costs})
    both = both.withColumns({f"low_{s}_{c}": F.col(f"low_{s}_{c}") + F.col(f"at_{s}_{c}") for s in scopes for c in costs})
    if "k_" in both.columns:
        first = both.where("sure AND k_ IS NOT NULL").groupBy("k_").agg(F.min("place").alias("sure_place"))
        both = both.join(first, "k_", "left").withColumn("known", F.coalesce(F.col("sure_place") < F.col("place"), F.lit(False)))
    return both.where("NOT sure")


def _folded(open_: DataFrame, common: list[str], scopes: dict[str, list[str]], costs: Sequence[str], limits: Sequence[Limit], keyed: bool) -> DataFrame:
    """Settles each group's open requests one after another."""
    least = {f"low_{s}_{c}" for s in scopes for c in costs}
    order = {s: list(by) for s, by in scopes.items()}

    def run(group: pd.DataFrame) -> pd.DataFrame:
        totals: dict[tuple, int] = {}
        admitted: set = set()
        status = []
        for row in group.sort_values("place").astype(object).where(lambda x: x.notna(), None).to_dict("records"):
            at = {s: (s, *[row[c] for c in by]) for s, by in order.items()}
            if keyed and row["k_"] is not None and (row["known"] or row["k_"] in admitted):
                status.append("attached")
                continue
            fits = all(row[f"low_{s}_{c}"] + totals.get((*at[s], c), 0) + row[f"c_{c}"] <= most for s, c, most, _ in limits)
            status.append("admitted" if fits else "refused")
            if fits:
                for s in order:
                    for c in costs:
                        totals[(*at[s], c)] = totals.get((*at[s], c), 0) + row[f"c_{c}"]
                if keyed:
                    admitted.add(row["k_"])
        return pd.DataFrame({"place": group.sort_values("place")["place"], "status": status})

    # without a common column there is one group, which the caller's bound keeps small
    needed = ["place", *dict.fromkeys(c for by in order.values() for c in by), *[f"c_{c}" for c in costs], *sorted(least), *(["k_", "known"] if keyed else [])]
    grouped = open_.select(*needed) if common else open_.select(*needed, F.lit(0).alias("g_"))
    return grouped.groupBy(*(common or ["g_"])).applyInPandas(run, "place long, status string")


def _coded(rows: DataFrame, scopes: dict[str, list[str]], costs: Sequence[str], limits: Sequence[Limit], columns: list[str]) -> DataFrame:
    """The verdicts, refusals by the first limit that the admitted totals before them leave no room for."""
    rows = rows.withColumns({f"s_c_{c}": F.when(F.col("status") == "admitted", F.col(f"c_{c}")).otherwise(0) for c in costs})
    for s, by in scopes.items():
        rows = earlier(rows, by, {f"at_{s}_{c}": f"s_c_{c}" for c in costs})
    code = F.coalesce(*[F.when(F.col(f"at_{s}_{c}") + F.col(f"c_{c}") > most, code) for s, c, most, code in limits])
    return rows.select(*columns, F.when(F.col("status") == "refused", code).otherwise(F.col("status")).alias("verdict"))
