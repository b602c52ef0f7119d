"""The rules of a profile as columns. Text arguments ending in ``folded`` are
lower-cased by ``fold`` once, by the caller."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from listsieve.functions.text import _col, any_marker, any_match, first_marker, once
from listsieve.profile import Geography, Profile

VALID_STATUSES = ["applied", "interviewing", "declined"]  # fixed values, in order


def title_excluded(title_folded: Column, terms) -> Column:
    return any_match(title_folded, terms)


def company_excluded(company, names) -> Column:
    """Plain substring test on the lower-cased company."""
    return any_marker(F.lower(_col(company)), [n.lower() for n in names])


def focus_excluded(title_folded: Column, hay_folded: Column, profile: Profile) -> Column:
    """A neighbouring role without a core term in its title, or no core term at all."""
    neighbour = any_match(title_folded, profile.adjacent_titles) & ~any_match(
        title_folded, profile.core
    )
    if not profile.require_any:
        return neighbour
    return neighbour | ~any_match(hay_folded, profile.require_any)


def geo_verdict(place: Column, text: Column, geo: Geography) -> Column:
    """Struct ``(ok, fit)`` from lower-cased location-and-title and description.

    Local beats region, and what the location or title says beats the text.
    """

    def verdict(ok: bool, fit: Column) -> Column:
        return F.struct(F.lit(ok).alias("ok"), fit.alias("fit"))

    def named(label: str, markers) -> Column:
        found = first_marker(place, markers)
        return verdict(True, F.concat(F.lit(f"{label} ("), found, F.lit(")")))

    if geo.off:
        return verdict(True, F.lit(""))
    no = verdict(False, F.lit(""))
    unverified = verdict(True, F.lit(f"{geo.remote_label} (unverified)"))
    return (
        F.when(any_marker(place, geo.local_markers), named(geo.local_label, geo.local_markers))
        .when(any_marker(text, geo.local_markers), verdict(True, F.lit(geo.local_label)))
        .when(any_marker(place, geo.reject_markers), no)
        .when(any_marker(place, geo.region_markers), named(geo.remote_label, geo.region_markers))
        .when(any_marker(text, geo.region_markers), verdict(True, F.lit(geo.remote_label)))
        .when(any_marker(text, geo.reject_markers), no)
        .otherwise(unverified if geo.keep_unverified else no)
    )


def place_text(location, title) -> Column:
    """Where geography is stated most plainly."""
    return F.concat(F.lower(_col(location)), F.lit(" "), F.lower(_col(title)))


def geo_fit(location, title, description, geo: Geography) -> Column:
    """``geo_verdict`` as one expression that lower-cases its inputs once."""
    texts = F.struct(
        place_text(location, title).alias("place"), F.lower(_col(description)).alias("text")
    )
    return once(texts, lambda t: geo_verdict(t["place"], t["text"], geo))


def hits(title_folded: Column, hay_folded: Column, profile: Profile) -> Column:
    """Struct of one boolean per scoring rule, so each is evaluated once."""
    tests = [any_match(hay_folded, [k.term]).alias(f"k{i}") for i, k in enumerate(profile.keywords)]
    tests += [any_match(title_folded, [t]).alias(f"t{i}") for i, t in enumerate(profile.title_boost)]
    tests += [any_match(hay_folded, b.terms).alias(f"b{i}") for i, b in enumerate(profile.live_bonuses)]
    return F.struct(*tests)


def _sum(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts, F.lit(0)).cast("int")


def _points(hit: Column, points: int) -> Column:
    return F.when(hit, points).otherwise(0)


def keyword_score(matched: Column, profile: Profile) -> Column:
    return _sum([_points(matched[f"k{i}"], k.points) for i, k in enumerate(profile.keywords)])


def title_boost(matched: Column, profile: Profile) -> Column:
    weight = profile.title_boost_weight
    return _sum([_points(matched[f"t{i}"], weight) for i in range(len(profile.title_boost))])


def bonus_score(matched: Column, profile: Profile) -> Column:
    return _sum([_points(matched[f"b{i}"], b.points) for i, b in enumerate(profile.live_bonuses)])


def total_score(matched: Column, profile: Profile) -> Column:
    parts = (keyword_score, title_boost, bonus_score)
    return _sum([part(matched, profile) for part in parts])


def reasons(matched: Column, profile: Profile) -> Column:
    """Matched terms in profile order, then the bonuses' reasons."""
    named = [F.when(matched[f"k{i}"], F.lit(k.term)) for i, k in enumerate(profile.keywords)]
    named += [F.when(matched[f"b{i}"], F.lit(b.label)) for i, b in enumerate(profile.live_bonuses)]
    if not named:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*named))


def tracked(status="status") -> Column:
    return _col(status) != ""


def valid_status(status="status") -> Column:
    return _col(status).isin("", *VALID_STATUSES)


def status_filter(want: str, status="status") -> Column:
    """"" keeps all, "tracked"/"none" split on having one, else equality."""
    if want == "":
        return F.lit(True)
    if want == "tracked":
        return tracked(status)
    if want == "none":
        return ~tracked(status)
    return _col(status) == want
