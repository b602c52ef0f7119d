"""What a search looks for, as plain Python values."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Keyword:
    term: str
    weight: int = 1

    @property
    def points(self) -> int:
        return self.weight or 1


@dataclass(frozen=True)
class Bonus:
    """Adds its weight once when any of its terms appears."""

    terms: tuple[str, ...]
    weight: int = 1
    reason: str = ""

    @property
    def points(self) -> int:
        return self.weight or 1

    @property
    def label(self) -> str:
        return self.reason or self.terms[0]


@dataclass(frozen=True)
class Geography:
    """Marker lists are substrings, tried in order; all empty switches the check off."""

    local_label: str = "local"
    remote_label: str = "remote"
    keep_unverified: bool = True
    local_markers: tuple[str, ...] = ()
    region_markers: tuple[str, ...] = ()
    reject_markers: tuple[str, ...] = ()

    @property
    def off(self) -> bool:
        return not (self.local_markers or self.region_markers or self.reject_markers)


@dataclass(frozen=True)
class Profile:
    keywords: tuple[Keyword, ...] = ()
    min_score: int = 4
    title_boost: tuple[str, ...] = ()
    title_boost_weight: int = 2
    exclude: tuple[str, ...] = ()
    exclude_companies: tuple[str, ...] = ()
    require_any: tuple[str, ...] = ()
    core_title_terms: tuple[str, ...] = ()
    adjacent_titles: tuple[str, ...] = ()
    languages: tuple[str, ...] = ()
    bonuses: tuple[Bonus, ...] = ()
    geography: Geography = field(default_factory=Geography)

    @property
    def core(self) -> tuple[str, ...]:
        """Terms that redeem a neighbouring role's title."""
        return self.core_title_terms or self.require_any

    @property
    def live_bonuses(self) -> tuple[Bonus, ...]:
        return tuple(b for b in self.bonuses if b.terms)

    def checked(self, lexicon) -> "Profile":
        """Refuse a profile that could not be run."""
        if not self.keywords:
            raise ValueError("profile.keywords must not be empty")
        lexicon.check(self.languages)
        return self

    def but(self, **changes) -> "Profile":
        return replace(self, **changes)
