import pytest

from listsieve import Bonus, Geography, Keyword, Profile
from listsieve.settings import load, profile_of, sources_of
from listsieve.sources.boards import Settings

LEAST = {"profile": {"keywords": [{"term": "go"}]}}


def test_defaults():
    profile, sources = load(LEAST)
    assert profile == Profile(keywords=(Keyword("go"),)) and profile.min_score == 4
    assert sources.settings == {} and sources.enabled("remoteok") and not sources.enabled("devbg")
    assert sources.max_pages() == 10 and sources.verify_limits() == {}


def test_all_options():
    data = {
        "app": {"title": "nothing reads it"},
        "min_score": 0,
        "profile": {
            "keywords": [{"term": "go", "weight": 3}, {"term": 2026}],
            "require_any": ["go", "rust"], "adjacent_titles": ["python"], "title_boost": ["senior"],
            "title_boost_weight": 0, "exclude": None, "exclude_companies": ["acme"], "languages": ["en"],
            "bonus_terms": [{"terms": ["visa", "relocation"], "weight": 2, "reason": "moves"}, {"weight": 1}],
            "unheard": [1],
        },
        "location": {"local_label": "here", "keep_unverified": False, "local_markers": ["berlin"], "reject_markers": ["us only"]},
        "sources": {
            "remoteok": False, "remotive": True, "justjoin": {"pages": ["p"]},
            "serper": {"queries": ["q"], "max_pages_per_run": 3, "skip_domains": ["x.com"]},
            "hackernews": {"enabled": False, "require": "remote"}, "djinni": None,
        },
    }
    profile, sources = load(data)
    assert profile == Profile(
        keywords=(Keyword("go", 3), Keyword("2026")), min_score=0, title_boost=("senior",), title_boost_weight=0,
        exclude_companies=("acme",), require_any=("go", "rust"), adjacent_titles=("python",), languages=("en",),
        bonuses=(Bonus(("visa", "relocation"), 2, "moves"), Bonus((), 1)),
        geography=Geography("here", "remote", False, ("berlin",), (), ("us only",)),
    )
    assert profile.core == ("go", "rust") and len(profile.live_bonuses) == 1
    assert sources.active() == ["remotive", "weworkremotely", "justjoin", "serper"]
    assert sources.verify_limits() == {"justjoin": 25} and sources.max_pages() == 3
    assert sources.of("hackernews") == Settings(enabled=False, require="remote") and sources.of("djinni") == Settings()


@pytest.mark.parametrize("data, fault", [
    ({}, "profile.keywords"),
    ({"profile": {"keywords": []}}, "profile.keywords"),
    ({"profile": {"keywords": "go"}}, "profile.keywords must be a list"),
    ({"profile": {"keywords": ["go"]}}, r"profile.keywords\[0\] must be a mapping"),
    ({"profile": {"keywords": [{"weight": 2}]}}, r"profile.keywords\[0\].term"),
    ({"profile": {"keywords": [{"term": "go", "weight": "2"}]}}, r"profile.keywords\[0\].weight must be a whole"),
    ({"profile": {**LEAST["profile"], "languages": ["xx"]}}, "unsupported language 'xx'"),
    ({"profile": {**LEAST["profile"], "exclude": "intern"}}, "profile.exclude must be a list"),
    ({"profile": {**LEAST["profile"], "exclude": [["intern"]]}}, r"profile.exclude\[0\] must be a text"),
    ({**LEAST, "location": {"keep_unverified": "yes"}}, "location.keep_unverified must be true or false"),
    ({**LEAST, "min_score": True}, "settings.min_score must be a whole"),
    ({**LEAST, "sources": {"monster": True}}, "unknown source 'monster'"),
    ({**LEAST, "sources": {"remoteok": "on"}}, "sources.remoteok must be a mapping"),
    ({**LEAST, "sources": ["remoteok"]}, "sources must be a mapping"),
])
def test_faults_are_named(data, fault):
    with pytest.raises(ValueError, match=fault):
        load(data)


def test_parts_alone():
    assert profile_of(LEAST).keywords == (Keyword("go"),)
    assert sources_of({"sources": {"devbg": {"pages": ["p"]}}}).enabled("devbg")
