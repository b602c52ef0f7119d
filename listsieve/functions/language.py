"""Language exclusion: which language do a listing's words vote for?

The votes of a text are computed once into a struct and the verdict is read off
it. Everything stays on the JVM. Scripts and diacritics are looked at only where
they could change the verdict.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from listsieve.functions import lexicon as lx
from listsieve.functions.text import _col, any_marker, fold, once, quote


class LanguageRule:
    """A keep list, compiled against a lexicon into column expressions."""

    def __init__(self, keep, lexicon: lx.Lexicon = lx.DEFAULT_LEXICON):
        lexicon.check(keep)
        self.off = not keep
        known = lexicon.languages
        foreign = [code for code in known if code not in set(keep)]
        self.kept_words = [w for code in keep for w in known[code].stopwords]
        self.foreign_words = [known[c].stopwords for c in foreign if known[c].stopwords]
        self.title_words = sorted(w for c in foreign for w in known[c].title_words)
        kept_scripts = {known[c].script for c in keep}
        self.scripts = sorted({known[c].script for c in foreign} - kept_scripts - {""})
        self.diacritics = [
            d for d in lexicon.diacritics if any(c not in set(keep) for c in d.languages)
        ]

    def votes(self, text: Column) -> Column:
        """Struct of the counts a verdict needs; ``text`` is ``fold``-ed."""
        foreign = [_capped(text, words) for words in self.foreign_words]
        if not foreign:
            strongest = F.lit(0)
        else:
            strongest = foreign[0] if len(foreign) == 1 else F.greatest(*foreign)
        return F.struct(
            (_capped(text, self.kept_words) if self.kept_words else F.lit(0)).alias("kept"),
            strongest.alias("foreign"),
            self._titled(text).alias("title_word"),
        )

    def _titled(self, text: Column) -> Column:
        if not self.title_words:
            return F.lit(False)
        pattern = F.lit(_bounded(self.title_words))
        return any_marker(text, self.title_words) & F.rlike(text, pattern)

    def verdict(self, text: Column, votes: Column) -> Column:
        """Is the text clearly in a language outside the keep list?"""
        if self.off:
            return F.lit(False)
        kept, foreign = votes["kept"], votes["foreign"]

        def outvoted(n: Column) -> Column:
            return (n >= lx.MIN_FOREIGN_VOTES) & (n > kept)

        out = (votes["title_word"] & (kept <= 1)) | outvoted(foreign)
        if self.diacritics:
            marked = self._marked(text)
            out = out | (outvoted(foreign + lx.DIACRITIC_VOTES) & marked)
        for script in self.scripts:
            out = out | _mostly(text, script)
        return out

    def _marked(self, text: Column) -> Column:
        marked = F.lit(False)
        for d in self.diacritics:
            # A run of that many letters, with anything between, means enough of them.
            enough = f"(?:[{d.letters}][^{d.letters}]*+){{{d.at_least}}}"
            marked = marked | F.rlike(text, F.lit(enough))
        return marked


def _bounded(words) -> str:
    edge = f"[^{lx.WORD_LETTERS}]"
    return f"(?:^|{edge})(?:{'|'.join(quote(w) for w in words)})(?:\\z|{edge})"


def _capped(text: Column, words) -> Column:
    # Both neighbours are part of a match, so words one space apart share it. Most
    # texts hold no word of most languages: a byte search settles those.
    matches = F.regexp_count(text, F.lit(_bounded(words)))
    return F.when(any_marker(text, words), F.least(matches, F.lit(lx.MAX_VOTES))).otherwise(0)


def _mostly(text: Column, script: str) -> Column:
    letter = f"(?=\\p{{L}})\\p{{Is{script}}}"
    inside = F.length(F.regexp_replace(text, f"[\\P{{Is{script}}}\\P{{L}}]+", ""))
    letters = F.length(F.regexp_replace(text, "\\P{L}+", ""))
    return F.rlike(text, F.lit(letter)) & (inside * 100 > letters * lx.MAX_SCRIPT_PERCENT)


def text_excluded(folded: Column, rule: LanguageRule) -> Column:
    if rule.off:
        return F.lit(False)
    return once(
        folded, lambda text: once(rule.votes(text), lambda votes: rule.verdict(text, votes))
    )


def language_excluded(title, description, keep, lexicon=lx.DEFAULT_LEXICON) -> Column:
    """The title alone, or title and description together, are foreign."""
    rule = LanguageRule(keep, lexicon)
    if rule.off:
        return F.lit(False)
    title, description = fold(_col(title)), fold(_col(description))
    return text_excluded(title, rule) | text_excluded(
        F.concat(title, F.lit(" "), description), rule
    )
