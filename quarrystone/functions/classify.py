"""Classifiers over ordered event histories: flags by entity first, then one ordered CASE."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Eras of the stand-in study, inclusive.
ERAS = [("early", date(1995, 1, 1), date(1996, 12, 31)), ("growth", date(1997, 1, 1), date(1998, 12, 31)), ("shock", date(1999, 1, 1), date(1999, 12, 31)), ("late", date(2000, 1, 1), date(2001, 12, 31))]
ERA_YEARS = {name: ((b - a).days + 1) / 365.25 for name, a, b in ERAS}


def era(day: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, a, b in reversed(ERAS):
        out = F.when(day.between(F.lit(a), F.lit(b)), name).otherwise(out)
    return out


def priority_route(events: DataFrame, entity: str, kind: str, order: list[tuple[str, list[str]]], default: str = "unknown") -> DataFrame:
    """entity, route, n_events: the first route of the order of which the entity has any kind of event, whenever it was."""
    flags = events.groupBy(entity).agg(F.count("*").alias("n_events"), *(F.bool_or(F.col(kind).isin(kinds)).alias(f"f{i}") for i, (_, kinds) in enumerate(order)))
    route = F.lit(default)
    for i, (name, _) in reversed(list(enumerate(order))):
        route = F.when(F.col(f"f{i}"), name).otherwise(route)
    return flags.select(entity, route.alias("route"), "n_events")


# The register's form numbers by what they prove.
COURT = ["WU01", "WU02", "WU07", "WU15", "4.20", "COCOMP", "L64.07"]
CREDITORS = ["LIQ02", "LIQ03", "4.68", "2.24B"]
DECLARATION = ["LIQ01", "4.70"]
LIQUIDATION = ["LRESSP", "600", "601", "602", "LIQ10", "LIQ13", "LIQ14"]
APPLIED = ["DS01", "DS02", "GAZ1(A)", "GAZ2(A)", "GAZ1A", "GAZ2A"]
NOTICED = ["GAZ1", "GAZ2", "FTE1", "FTE2"]


def exit_route(filings: DataFrame, entity: str, form: str, category: str) -> DataFrame:
    """entity, route, family: what an entity's filings prove, whenever they came; the first case that holds decides.

    A declaration of solvency makes a liquidation the members' own, unless creditors' paperwork shows that it was converted. The category cannot tell
    these apart, so it counts only where no form does.
    """
    code = F.upper(form)
    proofs = {"court": code.isin(COURT), "administration": code.startswith("AM"), "declaration": code.isin(DECLARATION), "creditors": code.isin(CREDITORS), "liquidation": code.isin(LIQUIDATION), "insolvency": F.lower(category) == "insolvency", "applied": code.isin(APPLIED), "noticed": code.isin(NOTICED)}
    has = filings.groupBy(entity).agg(*(F.coalesce(F.bool_or(c), F.lit(False)).alias(f"has_{k}") for k, c in proofs.items()))
    f = {k: F.col(f"has_{k}") for k in proofs}
    cases = [
        (f["court"], "compulsory_liquidation", "insolvency"),
        (f["administration"], "administration", "insolvency"),
        (f["declaration"] & ~f["creditors"], "members_voluntary_liquidation", "solvent_winding_up"),
        (f["creditors"] | f["liquidation"], "creditors_voluntary_liquidation", "insolvency"),
        (f["insolvency"], "insolvency_other", "insolvency"),
        (f["applied"], "voluntary_strike_off", "voluntary_dissolution"),
        (f["noticed"], "registrar_strike_off", "registrar_dissolution"),
    ]
    route = family = F.lit("unknown")
    for holds, name, kind in reversed(cases):
        route, family = F.when(holds, name).otherwise(route), F.when(holds, kind).otherwise(family)
    return has.select(entity, route.alias("route"), family.alias("family"))


def last_event_route(events: DataFrame, entity: str, kind: str, at: str, routes: dict[str, str], withdrawals: dict[str, str], default: str = "unknown") -> DataFrame:
    """entity, route: of the latest event that names one, unless a later event withdraws it."""
    last = events.groupBy(entity).agg(*(F.max(F.when(F.col(kind) == k, F.col(at))).alias(f"at_{k}") for k in {*routes, *withdrawals.values()}))
    live = {k: F.when(F.col(f"at_{withdrawals[k]}") > F.col(f"at_{k}"), None).otherwise(F.col(f"at_{k}")) if k in withdrawals else F.col(f"at_{k}") for k in routes}
    latest = F.greatest(*live.values()) if len(live) > 1 else next(iter(live.values()))
    route = F.lit(default)
    for k, name in reversed(routes.items()):
        route = F.when(live[k] == latest, name).otherwise(route)
    return last.select(entity, route.alias("route"))
