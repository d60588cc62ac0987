"""First-in-first-out lots as intervals of cumulative quantity, without a sequential loop.

Acquisitions of a commodity, in order, cover (A-a, A] of its cumulative bought quantity, and disposals (D-d, D] of
the consumed one, (D0, D]. What is sold beyond the holding is discarded: D = C - max(0, max(C - A so far)). Where a lot's
interval and a disposal's overlap, that much of the lot went into the disposal. Cumulative quantities are decimals of 12 places, so boundaries
that should meet do, however much has been traded.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pennyworks.sources.scratch import written

EPSILON = 1e-10
#: Cumulative quantities; how many boundaries a task orders at once; and up to how many rows a table of days is broadcast.
EXACT, ROWS, BROADCAST_ROWS = "decimal(38,12)", 50_000, 200_000


class Run(NamedTuple):
    """Events with what was bought and consumed up to each, and their days; made once, whoever needs it."""

    rows: DataFrame
    days: DataFrame


def running(events: DataFrame | Run, order: list[str]) -> Run:
    """rows with A, all that was bought up to each event, D0 and D, all that was consumed before and up to it, and `missing`, what a sale lacked.

    Running sums go by commodity and date, and events with their day's sums are written once, so nothing before is computed again; only one row per day is
    ordered in a commodity's window. days(commodity, date) has what was consumed at the end of a day and in all, and the commodity's `width` of a range.
    Events without a date come after all others; those without a commodity are left out.
    """
    if isinstance(events, Run):
        return events
    exact, zero = F.col("quantity").cast(EXACT), F.lit(0).cast(EXACT)
    excess = (F.col("sold") - F.col("bought")).cast(EXACT)
    run = written(_by_day(events, order), "lots")
    days = run.groupBy("commodity", "date").agg(F.max("bought").alias("bought"), F.max("sold").alias("sold"), F.max(excess).alias("top"), F.count("*").alias("n"))
    whole = Window.partitionBy("commodity")
    now, before = (whole.orderBy(F.asc_nulls_last("date")).rowsBetween(Window.unboundedPreceding, k) for k in (0, -1))
    start = lambda c: F.coalesce(F.sum(c).over(before), zero).cast(EXACT)
    days = days.withColumn("b0", start("bought")).withColumn("s0", start("sold")).withColumn("top", (F.col("s0") - F.col("b0") + F.col("top")).cast(EXACT))
    waste = lambda w: F.greatest(zero, F.max("top").over(w))
    days = days.withColumn("w0", waste(before)).withColumn("end", (F.col("s0") + F.col("sold") - waste(now)).cast(EXACT))
    width = F.nullif(F.sum("bought").over(whole).cast("double") / F.ceil(F.sum("n").over(whole) / ROWS), F.lit(0.0))
    days = written(days.select("commodity", "date", "b0", "s0", "w0", "end", F.max("end").over(whole).alias("last"), width.alias("width")), "days")
    same = (F.col("e.commodity") == F.col("d.commodity")) & F.col("e.date").eqNullSafe(F.col("d.date"))
    met = run.alias("e").join(_small(days).alias("d"), same).select("e.*", "d.b0", "d.s0", "d.w0", "d.last", "d.width")
    ahead = (F.col("s0") - F.col("b0")).cast(EXACT)
    met = met.withColumn("wasted", F.greatest("w0", (ahead + F.col("over")).cast(EXACT))).withColumn("waste", F.greatest("wasted", (ahead + excess).cast(EXACT)))
    own = F.greatest((-exact).cast(EXACT), zero)
    A, C = (F.col("b0") + F.col("bought")).cast(EXACT), (F.col("s0") + F.col("sold")).cast(EXACT)
    consumed = {"A": A, "D0": (C - own - F.col("wasted")).cast(EXACT), "D": (C - F.col("waste")).cast(EXACT), "missing": (F.col("waste") - F.col("wasted")).cast(EXACT)}
    return Run(met.select(*run.columns[:-3], *(c.alias(name) for name, c in consumed.items()), "last", "width"), days)


def _by_day(events: DataFrame, order: list[str]) -> DataFrame:
    """events with what was `bought` and `sold` on their day up to each, and `over`, the day's largest excess of the latter before each."""
    exact, zero = F.col("quantity").cast(EXACT), F.lit(0).cast(EXACT)
    day = Window.partitionBy("commodity", "date").orderBy(*order)
    upto, earlier = day.rowsBetween(Window.unboundedPreceding, 0), day.rowsBetween(Window.unboundedPreceding, -1)
    run = events.select("commodity", "date", *dict.fromkeys([*order, "quantity", "value"]))
    run = run.withColumn("bought", F.sum(F.greatest(exact, zero)).over(upto).cast(EXACT)).withColumn("sold", F.sum(F.greatest((-exact).cast(EXACT), zero)).over(upto).cast(EXACT))
    return run.withColumn("over", F.max((F.col("sold") - F.col("bought")).cast(EXACT)).over(earlier))


def _small(table: DataFrame) -> DataFrame:
    """A table of days or commodities, broadcast if counting says that it is small."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _end(until: Column) -> Column:
    """What was consumed at the end of the last day that fits."""
    return F.coalesce(F.max(F.when(until, F.col("end"))), F.lit(0).cast(EXACT))


def match(events: DataFrame | Run, order: list[str], within: tuple[str, str] | None = None) -> DataFrame:
    """events(commodity, date, ord, quantity, value): quantity under 0 is a disposal. A row per lot and disposal.

    The axis of a commodity's cumulative quantity is cut into ranges of about ROWS boundaries, and each lot and disposal goes to the ranges that it
    reaches into, mostly one; so ranges do not need each other. There the overlap is found by carrying each boundary's next lot and disposal back over
    the merged boundaries. `within` (first and last day) wants disposals of these days only: they and the lots that reach into what they consumed are all that is ordered.
    """
    run = running(events, order)
    bought, rows = F.col("quantity") > 0, run.rows.where("width is not null")
    start, at = F.when(bought, F.col("A") - F.col("quantity").cast(EXACT)).otherwise(F.col("D0")).cast(EXACT), F.when(bought, F.col("A")).otherwise(F.col("D"))
    rows = rows.withColumn("start", start).withColumn("at", at).where("at > start")
    if within:
        wanted = run.days.groupBy("commodity").agg(_end(F.col("date") < within[0]).alias("low"), _end(F.col("date") <= within[1]).alias("high"))
        rows = rows.join(F.broadcast(wanted) if run.days.count() <= BROADCAST_ROWS else wanted, "commodity")
        rows = rows.where(F.when(bought, (F.col("at") > F.col("low")) & (F.col("start") < F.col("high"))).otherwise(F.col("date").between(*within)))
    else:
        rows = rows.where(~bought | (F.col("start") < F.col("last")))
    # Ranges by doubles, one more at each side; whether an interval reaches into one is then told by the decimals of its edges.
    near = lambda c, k: F.floor(F.col(c).cast("double") / F.col("width")) + k
    edge = lambda k: ((F.col("part") + k) * F.col("width")).cast(EXACT)
    rows = rows.select("*", F.explode(F.sequence(F.greatest(near("start", -1), F.lit(0)), near("at", 1))).alias("part")).where((F.col("at") > edge(0)) & (F.col("start") < edge(1)))
    thing = F.struct("date", *dict.fromkeys([*order, "quantity", "value"]), "start")
    # An overlap is told where its end is, so no range edge cuts it in two.
    rows = rows.select("commodity", "part", "at", (F.col("at") <= edge(1)).alias("ends"), F.when(bought, thing).alias("lot"), F.when(~bought, thing).alias("sale"))
    so_far = Window.partitionBy("commodity", "part").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, 0)  # from the end, so that each frame only grows
    carried = lambda c: F.last(c, ignorenulls=True).over(so_far).alias(c)
    cut = rows.select("commodity", "at", "ends", carried("lot"), carried("sale"))
    taken = (F.col("at") - F.greatest("lot.start", "sale.start")).cast("double")
    cut = cut.where("ends and lot is not null and sale is not null").select("commodity", taken.alias("taken"), F.col("lot").dropFields("start").alias("lot"), F.col("sale").dropFields("start").alias("sale"))
    return cut.where(F.col("taken") > EPSILON)


def remaining(events: DataFrame | Run, order: list[str]) -> DataFrame:
    """commodity, lot and what is `left` of it after all disposals: the part of its interval beyond the last consumed unit."""
    left = F.least(F.col("quantity"), (F.col("A") - F.col("last")).cast("double"))
    lot = F.struct("date", *dict.fromkeys([*order, "quantity", "value"]))
    return running(events, order).rows.where("quantity > 0").select("commodity", lot.alias("lot"), left.alias("left")).where(F.col("left") > EPSILON)


def oversold(events: DataFrame | Run, order: list[str]) -> DataFrame:
    """commodity, sale and how much of it was `missing`, because more was sold than held."""
    sale = F.struct("date", *dict.fromkeys([*order, "quantity", "value"]))
    found = running(events, order).rows.where("quantity < 0").withColumn("missing", F.col("missing").cast("double"))
    return found.select("commodity", sale.alias("sale"), "missing").where(F.col("missing") > EPSILON)


def gains(matches: DataFrame) -> DataFrame:
    """cost, proceeds and gain of each match, by the shares of the lot and of the disposal that it takes."""
    cost = F.col("lot.value") * F.col("taken") / F.col("lot.quantity")
    proceeds = F.col("sale.value") * F.col("taken") / -F.col("sale.quantity")
    return matches.withColumn("cost", cost).withColumn("proceeds", proceeds).withColumn("gain", proceeds - cost)


def turnover(events: DataFrame, order: list[str], start: str, end: str) -> DataFrame:
    """What a window's disposals come to, for each commodity with an event up to its end, without a row per lot and disposal.

    `q0` and `q1` were held before the window and at its end, `paid` and `received` in it. `got` is what its disposals brought as far as they were covered, `old` how
    much they took of lots from before the window, `spent` the cost of the rest: the sums that match() and gains() lead to.

    Lots are consumed in order, so the consumed quantity before the window and at its end tells which were. Days are summed without order. Ordered are only days whose
    sales, if all came first, might exceed what is held (as they do where more is sold than bought), and the day whose lots the window's last disposal divides.
    """
    exact, value, zero = F.col("quantity").cast(EXACT), F.col("value").cast(EXACT), F.lit(0).cast(EXACT)
    bought, sold = F.col("quantity") > 0, F.col("quantity") < 0
    total = lambda c, when: F.coalesce(F.sum(F.when(when, c)), zero).cast(EXACT)
    rows = written(events.where(F.col("date") <= end).select("commodity", "date", *dict.fromkeys([*order, "quantity", "value"])), "events")
    days = rows.groupBy("commodity", "date").agg(
        total(exact, bought).alias("bought"), total((-exact).cast(EXACT), sold).alias("sold"), total(value, bought).alias("paid"), total(value, sold).alias("gross"), total(value, F.col("quantity") == 0).alias("idle"),
    )
    now, before = (Window.partitionBy("commodity").orderBy("date").rowsBetween(Window.unboundedPreceding, k) for k in (0, -1))
    so_far = lambda c: F.coalesce(F.sum(c).over(before), zero).cast(EXACT)
    days = days.withColumn("b0", so_far("bought")).withColumn("s0", so_far("sold")).withColumn("ahead", (F.col("s0") - F.col("b0")).cast(EXACT))
    days = days.withColumn("top", (F.col("ahead") + F.col("sold") - F.col("bought")).cast(EXACT))  # the excess at the day's end: so much was wasted at least
    days = written(days.withColumn("unsure", F.col("ahead") + F.col("sold") > F.greatest(zero, F.max("top").over(before))), "days")
    excess = (F.col("sold") - F.col("bought")).cast(EXACT)
    run = written(_by_day(rows.join(_small(days.where("unsure").select("commodity", "date")), ["commodity", "date"]), order), "unsure")
    tops = run.groupBy("commodity", "date").agg(F.max(excess).alias("most"))
    days = days.join(_small(tops), ["commodity", "date"], "left").withColumn("top", F.coalesce((F.col("ahead") + F.col("most")).cast(EXACT), "top"))
    waste = lambda w: F.greatest(zero, F.max("top").over(w))
    days = written(days.withColumn("w0", waste(before)).withColumn("end", (F.col("s0") + F.col("sold") - waste(now)).cast(EXACT)), "ends")

    early, inside = F.col("date") < start, F.col("date") >= start
    kept = F.col("bought") - F.col("sold")
    held = days.groupBy("commodity").agg(
        total(kept, early).alias("q0"), total(kept, F.lit(True)).alias("q1"), total(F.col("paid"), inside).alias("paid"), total(F.col("gross"), inside).alias("gross"), total(F.col("idle"), inside).alias("idle"),
        total(F.col("bought"), early).alias("had"), _end(early).alias("low"), _end(F.lit(True)).alias("high"),
    )
    sales = run.where(sold & inside).join(_small(days.where(F.col("unsure") & inside).select("commodity", "date", "ahead", "w0")), ["commodity", "date"])
    wasted = F.greatest("w0", (F.col("ahead") + F.col("over")).cast(EXACT))
    missing = (F.greatest(wasted, (F.col("ahead") + excess).cast(EXACT)) - wasted).cast("double")
    lacked = sales.groupBy("commodity").agg(F.sum(F.col("value") * missing / -F.col("quantity")).alias("lacked"))
    reached = days.where(inside).join(held.select("commodity", "high"), "commodity").withColumn("b1", (F.col("b0") + F.col("bought")).cast(EXACT))
    whole = reached.where("b1 <= high").groupBy("commodity").agg(F.sum("paid").alias("whole"))
    cut = reached.where("b0 < high and b1 > high").select("commodity", "date", (F.col("high") - F.col("b0")).cast(EXACT).alias("room"))
    divided = _by_day(rows.where(bought).join(_small(cut.select("commodity", "date")), ["commodity", "date"]), order).join(_small(cut), ["commodity", "date"])
    taken = (F.least("bought", "room") - (F.col("bought") - exact)).cast("double")
    part = divided.groupBy("commodity").agg(F.sum(F.when(taken > EPSILON, F.col("value") * taken / F.col("quantity"))).alias("part"))
    found = held.join(lacked, "commodity", "left").join(whole, "commodity", "left").join(part, "commodity", "left")
    plain = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    old = F.greatest(zero, (F.least("high", "had") - F.col("low")).cast(EXACT)).cast("double")
    return found.select(
        "commodity", plain("q0").alias("q0"), plain("q1").alias("q1"), plain("paid").alias("paid"), (F.col("gross") + F.col("idle")).cast("double").alias("received"),
        (plain("gross") - plain("lacked")).alias("got"), old.alias("old"), (plain("whole") + plain("part")).alias("spent"),
    )


def whole_months(start, end):
    """Calendar months from start to end that are full, from dates as text."""
    part = lambda c, a, n: F.substring(c, a, n).cast("int")
    return (part(end, 1, 4) - part(start, 1, 4)) * 12 + part(end, 6, 2) - part(start, 6, 2) - (part(end, 9, 2) < part(start, 9, 2)).cast("int")
