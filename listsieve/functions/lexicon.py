"""Evidence for telling languages apart. A user may pass a lexicon of their own."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Language:
    """Any part may be empty; ``script`` is a Unicode script name."""

    stopwords: tuple[str, ...] = ()
    title_words: tuple[str, ...] = ()
    script: str = ""


@dataclass(frozen=True)
class Diacritics:
    """Letters that, ``at_least`` so many times, speak for one of ``languages``."""

    letters: str
    at_least: int
    languages: tuple[str, ...]


@dataclass(frozen=True)
class Lexicon:
    languages: dict[str, Language] = field(default_factory=dict)
    diacritics: tuple[Diacritics, ...] = ()

    @property
    def supported(self) -> list[str]:
        return sorted(self.languages)

    def check(self, codes) -> None:
        unknown = [c for c in codes if c not in self.languages]
        if unknown:
            raise ValueError(
                f"unsupported language {unknown[0]!r} (supported: {', '.join(self.supported)})"
            )


def _words(text: str) -> tuple[str, ...]:
    return tuple(text.split("|")) if text else ()


# ---- Fixed values -----------------------------------------------------------
# Function words per language, words that give a title's language away, scripts.
# English and German have no title words, and umlauts are no evidence: both are
# found in listings of any language.
DEFAULT_LEXICON = Lexicon(
    languages={
        "en": Language(_words("the|and|you|your|with|will|team|experience|work|skills")),
        "de": Language(_words("und|der|die|das|wir|dich|deine|erfahrung|kenntnisse|aufgaben")),
        "pl": Language(
            _words(
                "oraz|które|którzy|będzie|będziesz|pracy|praca|znajomość|doświadczenie|zespołu|"
                "zespole|umowa|wymagania|oferujemy|mile widziane|programista|stanowisko"
            ),
            _words("programista|programistka"),
        ),
        "fr": Language(
            _words(
                "nous|vous|équipe|expérience|développeur|développement|poste|entreprise|missions|"
                "profil recherché|maîtrise"
            ),
            _words("développeur|développeuse"),
        ),
        "es": Language(
            _words(
                "desarrollo|experiencia|equipo|trabajo|empresa|buscamos|conocimientos|años|puesto|"
                "requisitos"
            ),
            _words("desarrollador|desarrolladora"),
        ),
        "nl": Language(
            _words(
                "ervaring|kennis|werkzaamheden|functie|wij zoeken|jij bent|binnen ons|vaardigheden"
            ),
            _words("ontwikkelaar"),
        ),
        "it": Language(
            _words(
                "esperienza|sviluppo|lavoro|azienda|cerchiamo|conoscenza|requisiti|competenze"
            ),
            _words("sviluppatore"),
        ),
        "pt": Language(
            _words(
                "experiência|desenvolvimento|trabalho|empresa|procuramos|conhecimento|requisitos|"
                "equipe|equipa"
            ),
            _words("programador"),
        ),
        "da": Language(title_words=_words("udvikler")),
        "sv": Language(title_words=_words("utvecklare")),
        "fi": Language(title_words=_words("kehittäjä")),
        "bg": Language(title_words=_words("програмист"), script="Cyrillic"),
        "ru": Language(title_words=_words("разработчик"), script="Cyrillic"),
        "uk": Language(script="Cyrillic"),
    },
    diacritics=(
        Diacritics("ąćęłńśźż", 4, ("pl",)),
        Diacritics("àâçéèêëîïôùûñíóáãõ", 6, ("fr", "es", "it", "pt")),
    ),
)
# Letters that continue a word when function words are counted.
WORD_LETTERS = "a-zà-ž"
# Votes counted per language at most, and the verdict's thresholds.
MAX_VOTES = 25
MIN_FOREIGN_VOTES = 3
DIACRITIC_VOTES = 2
MAX_SCRIPT_PERCENT = 15
# -----------------------------------------------------------------------------
