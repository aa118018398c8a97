"""Earliest possible times of events that are known to a unit and a zone only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds of each unit of precision.
UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "month": 2678400, "year": 31622400}
#: Minutes ahead of UTC of the earliest civil zone; it stands for every zone that isn't known.
EARLIEST = 14 * 60
LETTERS, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def only(text: Column, chars: str, least: int, most: int) -> Column:
    """Whether ``text`` is made of ``chars`` alone and has ``least`` to ``most`` of them."""
    return (F.translate(text, chars, "") == "") & F.length(text).between(least, most)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def stated_minutes(offset: Column) -> Column:
    """Minutes of a signed offset; null if it is none or lies beyond 14 hours."""
    body = F.substr(offset, F.lit(2))
    colon, short = F.instr(body, ":") > 0, F.length(body) <= 2
    hours = F.when(colon, F.substring_index(body, ":", 1)).when(short, body).otherwise(F.left(body, F.length(body) - 2))
    minutes = F.when(colon, F.substring_index(body, ":", -1)).when(short, F.lit("00")).otherwise(F.right(body, F.lit(2)))
    sign = F.when(offset.startswith("+"), 1).when(offset.startswith("-"), -1)

    def value(x: Column) -> Column:
        h, m = x["h"].try_cast("int"), x["m"].try_cast("int")
        return F.when(only(x["h"], DIGITS, 1, 2) & only(x["m"], DIGITS, 2, 2) & (h <= 14) & (m < 60), (h * 60 + m) * x["sign"])

    return let(F.struct(hours.alias("h"), minutes.alias("m"), sign.alias("sign")), value)


def offset_minutes(zone: Column, inferred: Column | None = None) -> Column:
    """Minutes ahead of UTC that a zone label states; names alone, strange labels and inferred zones count as the earliest zone.

    A label is UTC, GMT or Z, or a signed offset, perhaps after UTC or GMT and perhaps in brackets behind a zone's short name. An offset
    has hours up to 14 and perhaps minutes below 60, two digits of them, with or without a colon.
    """

    def minutes(label: Column) -> Column:
        named = F.instr(label, "(") > 0
        fair = ~named | only(F.rtrim(F.substring_index(label, "(", 1)), LETTERS, 2, 5)
        inner = F.trim(F.rtrim(F.when(named, F.substring_index(label, "(", -1)).otherwise(label)))
        bare = lambda x: F.trim(F.when(x.endswith(")"), F.left(x, F.length(x) - 1)).otherwise(x))
        offset = lambda x: F.when(x.startswith("UTC") | x.startswith("GMT"), F.ltrim(F.substr(x, F.lit(4)))).otherwise(x)
        found = let(let(let(inner, bare), offset), stated_minutes)
        return F.when(label.isin("UTC", "GMT", "Z"), F.lit(0)).otherwise(F.coalesce(F.when(fair, found), F.lit(EARLIEST)))

    known = let(F.upper(F.trim(F.coalesce(zone, F.lit("")))), minutes)
    return known if inferred is None else F.when(F.coalesce(inferred, F.lit(True)), F.lit(EARLIEST)).otherwise(known)


def start_of_unit(at: Column, unit: Column, minutes: Column) -> Column:
    """The start, in seconds of UTC, of the unit of local time that holds the second ``at``; null for an unknown unit."""
    local = F.timestamp_seconds(at + minutes * 60)
    floor = F.coalesce(*[F.when(F.lower(F.trim(unit)) == u, F.unix_seconds(F.date_trunc(u, local))) for u in UNITS])
    return floor - minutes * 60


def unit_seconds(unit: Column) -> Column:
    return F.coalesce(*[F.when(F.lower(F.trim(unit)) == u, F.lit(n)) for u, n in UNITS.items()])


def anchors(events: DataFrame, lead_hours: float) -> DataFrame:
    """``market``, ``anchor`` (seconds), ``precision`` (seconds), ``na`` of each row of ``events``.

    An event has up to two times (``event_*`` and ``report_*``: ``at`` in seconds, ``unit``, ``zone``, ``inferred``); the earlier floor is the
    anchor, the finer one on a tie. Too coarse: a unit as long as the lead, or ``gap`` without an occurrence known to minute or hour. A time
    with an unknown unit, or without a word on whether its zone was inferred, is refused: the query fails and names the market.
    """

    def term(p: str) -> Column:
        unit = F.coalesce(F.col(f"{p}_unit"), F.lit("day"))
        known = F.lower(F.trim(unit)).isin(*UNITS) & F.col(f"{p}_inferred").isNotNull()
        refused = F.raise_error(F.concat(F.lit(f"{p} time refused, its unit or inferred flag is not known: "), F.coalesce("market", F.lit("null"))))
        unit = F.when(known, unit).otherwise(refused.cast("string"))
        floor = start_of_unit(F.col(f"{p}_at"), unit, offset_minutes(F.col(f"{p}_zone"), F.col(f"{p}_inferred")))
        return F.when(F.col(f"{p}_at").isNotNull(), F.struct(floor.alias("anchor"), unit_seconds(unit).alias("precision")))

    first = F.array_min(F.filter(F.array(term("event"), term("report")), lambda x: x.isNotNull()))
    gap = F.coalesce(F.col("gap"), F.lit(False)) & ~F.coalesce(F.lower(F.col("occurrence_unit")).isin("minute", "hour"), F.lit(False))
    na = F.when(first.isNull(), F.lit("no_event_ts")).when((first["precision"] >= lead_hours * 3600) | gap, F.lit("event_ts_too_coarse"))
    return events.select("market", first["anchor"].alias("anchor"), first["precision"].alias("precision"), na.alias("na"))
