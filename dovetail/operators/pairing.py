"""One-to-one pairing in the order of a queue, without one task for a queue: rounds of proposals between sorted lists.

Sequentially, each asker in turn takes the first free offer of its first list that has one. As all offers prefer the earlier asker,
this is the only stable matching, so any order of proposals that ends stable gives it. A round lets every free asker propose to its
first offer that is free or held by a later asker; an offer keeps the earliest. Askers that meet at the head of one list are dealt to
its free offers by rank, as long as each would have come to that offer anyway, so a burst of equal askers takes one round, not one each.

What is grouped is a list (a name in a directory, or a camera in a second), not a directory. No pair of askers and offers is made but
the one proposal of each asker in a round. A list of very many rows is sorted by one task, which spills.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dovetail.sources import shared

_LAST = (1 << 63) - 1


def _first_open(asks: DataFrame, lists: DataFrame) -> DataFrame:
    """ask, level, list, offer, free: the first offer of each asked list that is free or held by a later asker. ``lists``: list, offer, holder (``_LAST``: free)."""
    before = Window.partitionBy("list").orderBy("offer").rowsBetween(Window.unboundedPreceding, -1)
    # an asker meets the first offer whose holder is later than itself: only new maxima of the holders can be that
    records = lists.withColumn("before", F.max("holder").over(before)).where("before is null or holder > before")
    none = lambda kind: F.lit(None).cast(kind)
    both = records.select("list", F.col("holder").alias("at"), "offer", none("long").alias("ask"), none("int").alias("level"))
    both = both.unionByName(asks.select("list", F.col("ask").alias("at"), none("long").alias("offer"), "ask", "level"))
    after = Window.partitionBy("list").orderBy("at").rowsBetween(1, Window.unboundedFollowing)
    met = both.withColumns({"found": F.first("offer", ignorenulls=True).over(after), "held": F.first(F.when(F.col("offer").isNotNull(), F.col("at")), ignorenulls=True).over(after)})
    return met.where("ask is not null and found is not null").select("ask", "level", "list", F.col("found").alias("offer"), (F.col("held") == _LAST).alias("free"))


def _proposals(asks: DataFrame, lists: DataFrame) -> DataFrame:
    """ask, offer: one for each asker that has an open offer."""
    seen = _first_open(asks, lists)
    ranked = seen.groupBy("ask").agg(F.array_sort(F.collect_list(F.struct("level", "offer", "list", "free"))).alias("a"))
    best, other = F.col("a")[0], F.get("a", F.lit(1))
    # the next list of the same level sets how far down the first list an asker may be dealt
    limit = F.when(other["level"] == best["level"], other["offer"]).otherwise(_LAST)
    chosen = ranked.select("ask", best["list"].alias("list"), best["offer"].alias("offer"), best["free"].alias("free"), limit.alias("limit"))
    chosen = shared.stash(chosen, "choices")
    queue = Window.partitionBy("list").orderBy("ask")
    queued = chosen.where("free").withColumn("place", F.row_number().over(queue))
    heads = chosen.select("list").distinct()
    free = lists.where(F.col("holder") == _LAST).join(heads, "list", "left_semi").select("list", F.col("offer").alias("dealt"), F.row_number().over(Window.partitionBy("list").orderBy("offer")).alias("place"))
    dealt = queued.join(free, ["list", "place"], "left").withColumn("fits", F.coalesce(F.col("dealt") <= F.col("limit"), F.lit(False)))
    safe = F.min("fits").over(queue)  # all before it are dealt too
    dealt = dealt.withColumn("safe", safe).select("ask", F.when(F.col("safe"), F.col("dealt")).otherwise(F.col("offer")).alias("offer"))
    return dealt.unionByName(chosen.where("not free").select("ask", "offer"))


def in_turn(asks: DataFrame, offers: DataFrame) -> DataFrame:
    """ask, offer: what each asker gets when askers choose in ascending order. ``asks``: ask (long), level (int), list; a lower level is
    tried first, and within a level the smaller offer. ``offers``: offer (long), list. An asker may ask for several lists of a level."""
    asks = shared.stash(asks.join(offers.select("list").distinct(), "list", "left_semi").select("ask", F.col("level").cast("int").alias("level"), "list"), "asks")
    offers = shared.stash(offers.join(asks.select("list").distinct(), "list", "left_semi").select("offer", "list"), "offers")
    held = None
    while True:
        if held is None:
            free, lists = asks, offers.withColumn("holder", F.lit(_LAST))
        else:
            free = asks.join(held.select("ask"), "ask", "left_anti")
            lists = offers.join(held.withColumnRenamed("ask", "holder"), "offer", "left").fillna(_LAST, ["holder"])
        made = shared.stash(_proposals(free, lists), "proposals")
        if made.isEmpty():
            return made if held is None else held
        now = made if held is None else held.unionByName(made)
        held = shared.stash(now.groupBy("offer").agg(F.min("ask").alias("ask")).select("ask", "offer"), "held")
