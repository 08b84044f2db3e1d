"""Clocks and sequences: free time, service levels, states, sliding limits, gaps and islands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The steps of a delivery in order, each with its statuses; a step's key is its first status
#: but for the fifth, proforma_sprawdzona, and the seventh, artwork_sprawdzony.
STEPS = (
    ("utworzone",),
    ("wyslane_do_dostawcy",),
    ("proforma_oczekiwana",),
    ("proforma_otrzymana", "proforma_zaladowana"),
    ("zweryfikowane", "sprawdzone_zgodne", "sprawdzone_do_weryfikacji", "sprawdzone_niezgodne"),
    ("artwork_oczekiwanie", "zatwierdzone_do_wyplyniecia", "artwork_master_zaladowany", "artwork_czeka_fabryczny", "artwork_brak_mastera"),
    ("artwork_zgodne", "artwork_niezgodne", "artwork_bledne"),
    ("etd_sap", "zaokretowane"),
    ("zlecenie_spedycja",),
    ("agent_przypisany", "w_transporcie"),
    ("packing_list_oczekiwanie", "na_miejscu"),
    ("packing_list_otrzymany",),
    ("dokumenty_odprawa", "w_odprawie"),
    ("dostawa_przychodzaca",),
    ("dokumenty_wyslane_odprawa",),
    ("sad_draft",),
    ("pzc_agencja", "po_odprawie"),
    ("dostawa_magazyn", "w_magazynie", "dostarczone"),
    ("rozliczenie_fiori", "do_rozliczenia"),
    ("rozliczenie_transportu", "rozliczone"),
)
#: The steps (from 0) that begin the eight phases order, proforma, artwork, forwarding, packing, clearance, warehouse, settlement.
PHASE_STARTS = (0, 2, 5, 7, 10, 12, 17, 18)
#: Days that a status may last.
LIMITS = {
    "proforma_oczekiwana": 7, "proforma_otrzymana": 5, "sprawdzone_do_weryfikacji": 5, "artwork_oczekiwanie": 7, "etd_sap": 3, "zlecenie_spedycja": 3,
    "agent_przypisany": 5, "packing_list_oczekiwanie": 30, "dokumenty_odprawa": 5, "sad_draft": 5, "pzc_agencja": 7, "rozliczenie_fiori": 14,
}


def free_time(start: Column, stop: Column, free_days: int, warn_days: int, rate: float, today: Column) -> Column:
    """(used, over, left, level, cost) of a clock; an open one runs until ``today``.

    Negative durations are none. Over the free days is red; an open clock with none left is red as well and
    one with at most ``warn_days`` left amber. A closed clock is never amber. No start: null.
    """
    used = F.greatest(F.lit(0), F.date_diff(F.coalesce(stop, today), start))
    over, left = F.greatest(F.lit(0), used - free_days), F.greatest(F.lit(0), free_days - used)
    is_open = stop.isNull()
    level = F.when(over > 0, "red").when(is_open & (left == 0), "red").when(is_open & (left <= warn_days), "amber").otherwise("green")
    cost = (over * F.lit(str(rate)).cast("decimal(12,2)")).cast("decimal(18,2)")
    return F.when(start.isNotNull(), F.struct(used.alias("used"), over.alias("over"), left.alias("left"), level.alias("level"), cost.alias("cost")))


def worst(*levels: Column) -> Column:
    has = lambda name: F.coalesce(*(F.when(x == name, True) for x in levels), F.lit(False))
    return F.when(has("red"), "red").when(has("amber"), "amber").otherwise("green")


def step_index(status: Column, steps: Sequence[Sequence[str]] = STEPS) -> Column:
    """The place (from 0) of the status's step; -1 if it is none."""
    places = F.create_map(*(F.lit(x) for k, statuses in enumerate(steps) for name in statuses for x in (name, k)))
    return F.coalesce(F.try_element_at(places, status), F.lit(-1))


def phase_index(status: Column, starts: Sequence[int] = PHASE_STARTS) -> Column:
    """The place (from 0) of the status's phase; 0 if it is none."""
    step = step_index(status)
    return F.greatest(F.lit(0), sum((step >= s).cast("int") for s in starts) - 1)


def next_step(status: Column, steps: Sequence[Sequence[str]] = STEPS) -> Column:
    """The first status of the step after the status's own; null after the last and for unknown ones."""
    step = step_index(status, steps)
    return F.when(step >= 0, F.get(F.array(*(F.lit(s[0]) for s in steps)), step + 1))


def overdue(status: Column, days: Column, limits: dict[str, int] | None = None) -> Column:
    """Whether a status has lasted its limit or longer; statuses without a limit never are."""
    limits = LIMITS if limits is None else limits
    return F.coalesce(days >= F.try_element_at(F.create_map(*(F.lit(x) for p in limits.items() for x in p)), status), F.lit(False))


def recent_count(df: DataFrame, key: str, time: str, seconds: int, name: str = "recent") -> DataFrame:
    """The rows with how many rows of their key lie in the ``seconds`` before them, the bound itself not included, with themselves."""
    at = F.unix_micros(F.col(time).cast("timestamp"))
    w = Window.partitionBy(key).orderBy("_at").rangeBetween(-seconds * 1_000_000 + 1, 0)
    return df.withColumn("_at", at).withColumn(name, F.count(F.lit(1)).over(w)).drop("_at")


def islands(df: DataFrame, keys: Sequence[str], value: str, gap: float, name: str = "island") -> DataFrame:
    """The rows with the number of their cluster: a new one starts where the value is more than ``gap`` after the last."""
    w = Window.partitionBy(*keys).orderBy(value)
    fresh = F.coalesce((F.col(value) - F.lag(value).over(w) > gap).cast("int"), F.lit(0))
    return df.withColumn("_fresh", fresh).withColumn(name, F.sum("_fresh").over(w.rangeBetween(Window.unboundedPreceding, 0))).drop("_fresh")


def filled_forward(df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, name: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(column, ignorenulls=True).over(w))


def state_durations(df: DataFrame, key: str, time: str, order: Sequence[str]) -> DataFrame:
    """The rows with ``until``: the time of their key's next row, null for the last."""
    return df.withColumn("until", F.lead(time).over(Window.partitionBy(key).orderBy(time, *order)))


def page_groups(pages: DataFrame, keys: Sequence[str], order: str, kind: str) -> DataFrame:
    """(keys, kind, first, last): stretches of pages; a page without a kind goes on with the one before."""
    w = Window.partitionBy(*keys).orderBy(order)
    starts = (F.col(kind).isNotNull() & ~F.col(kind).eqNullSafe(F.last(kind, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))).cast("int")
    numbered = pages.withColumn("_start", starts).withColumn("_group", F.sum("_start").over(w))
    return numbered.groupBy(*keys, "_group").agg(F.max(kind).alias("kind"), F.min(order).alias("first"), F.max(order).alias("last")).drop("_group")
