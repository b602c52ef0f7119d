"""A search's settings as plain nested dicts, such as a YAML or JSON file holds them.

``{"min_score": 4, "profile": {...}, "location": {...}, "sources": {name: True | False | {...}}}``;
what is missing or None keeps its default, keys that nothing reads are let be. A source not
mentioned is enabled. Wrong kinds of values, an empty keyword list, unknown sources and
unsupported languages raise ``ValueError`` with the place of the fault.
"""

from __future__ import annotations

from collections.abc import Mapping

from listsieve.functions import lexicon as lx
from listsieve.profile import Bonus, Geography, Keyword, Profile
from listsieve.sources.boards import Settings, Sources


def load(data: Mapping, lexicon: lx.Lexicon = lx.DEFAULT_LEXICON) -> tuple[Profile, Sources]:
    """Profile and sources, both checked."""
    return profile_of(data, lexicon), sources_of(data)


def profile_of(data: Mapping, lexicon: lx.Lexicon = lx.DEFAULT_LEXICON) -> Profile:
    data = _part(data, "settings")
    rules, place = _part(data.get("profile"), "profile"), _part(data.get("location"), "location")
    profile = Profile(
        keywords=tuple(_keyword(k, at) for k, at in _items(rules.get("keywords"), "profile.keywords")),
        bonuses=tuple(
            Bonus(**{"terms": (), **_taken(Bonus, b, at)})
            for b, at in _items(rules.get("bonus_terms"), "profile.bonus_terms")
        ),
        geography=Geography(**_taken(Geography, place, "location")),
        **_taken(Profile, {"min_score": data.get("min_score")}, "settings"),
        **_taken(Profile, {k: v for k, v in rules.items() if k not in _APART}, "profile"),
    )
    return profile.checked(lexicon)


def _keyword(value, at: str) -> Keyword:
    given = _taken(Keyword, value, at)
    if not given.get("term"):
        raise ValueError(f"{at}.term is missing")
    return Keyword(**given)


#: Fields of a profile that are read apart or stand elsewhere.
_APART = ("keywords", "bonuses", "geography", "min_score")


def sources_of(data: Mapping) -> Sources:
    given = _part(_part(data, "settings").get("sources"), "sources")
    return Sources({name: _source(value, f"sources.{name}") for name, value in given.items()})


def _source(value, at: str) -> Settings:
    """A bare truth value switches a source on or off; a mapping has its options."""
    if isinstance(value, bool):
        return Settings(enabled=value)
    return Settings(**_taken(Settings, _part(value, at), at))


def _part(value, at: str) -> Mapping:
    if value is None:
        return {}
    if not isinstance(value, Mapping):
        raise ValueError(f"{at} must be a mapping")
    return value


def _items(value, at: str) -> list[tuple[object, str]]:
    if value is None:
        return []
    if not isinstance(value, (list, tuple)):
        raise ValueError(f"{at} must be a list")
    return [(item, f"{at}[{i}]") for i, item in enumerate(value)]


def _taken(kind: type, value, at: str) -> dict:
    """The fields of a settings class that a mapping gives, each of the field's kind."""
    readers = {"int": _whole, "bool": _truth, "str": _text, "tuple[str, ...]": _texts}
    given = _part(value, at)
    fields = {name: field.type for name, field in kind.__dataclass_fields__.items()}
    return {
        name: readers[fields[name]](item, f"{at}.{name}")
        for name, item in given.items()
        if item is not None and fields.get(name) in readers
    }


def _whole(value, at: str) -> int:
    if isinstance(value, bool) or not isinstance(value, int):
        raise ValueError(f"{at} must be a whole number")
    return value


def _truth(value, at: str) -> bool:
    if not isinstance(value, bool):
        raise ValueError(f"{at} must be true or false")
    return value


def _text(value, at: str) -> str:
    """Numbers too: a file may hold a term such as 2026 without quotes."""
    if isinstance(value, bool) or not isinstance(value, (str, int, float)):
        raise ValueError(f"{at} must be a text")
    return str(value)


def _texts(value, at: str) -> tuple[str, ...]:
    return tuple(_text(item, where) for item, where in _items(value, at))
