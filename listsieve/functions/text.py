"""Text columns: flattening HTML, byte-true cuts, word matching, small splits."""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- Fixed values -----------------------------------------------------------
# Unicode white space, as one regex class (Java's \s alone is ASCII only).
WHITE_SPACE = r"[\s\x0B\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
# Entities frequent enough to replace on the JVM; `&amp;` has to come last.
FREQUENT_ENTITIES = {
    "&lt;": "<",
    "&gt;": ">",
    "&quot;": '"',
    "&apos;": "'",
    "&#39;": "'",
    "&#34;": '"',
    "&nbsp;": "\u00a0",
    "&copy;": "©",
    "&middot;": "·",
    "&ndash;": "–",
    "&mdash;": "—",
    "&hellip;": "…",
    "&rsquo;": "’",
    "&amp;": "&",
}
# Label texts on listing cards that are not skills.
JUNK_TAG = (
    r"^(new|remote|locations?|super offer|undisclosed.*|salary)\z"
    r"|\d+d left|^[\d\s,.-]+\z|(EUR|PLN|USD|GBP)/"
)
# -----------------------------------------------------------------------------

ELLIPSIS = "…"


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def once(value: Column, use) -> Column:
    """Evaluate ``value`` once and hand it to ``use``, inside one expression."""
    return F.element_at(F.transform(F.array(value), use), 1)


def squeeze(text: Column) -> Column:
    """Every run of white space becomes one space; none at the ends."""
    return F.trim(F.regexp_replace(text, WHITE_SPACE + "+", " "))


def trim_space(text: Column) -> Column:
    """Drop white space at both ends, Unicode kinds included."""
    return F.regexp_replace(text, f"^{WHITE_SPACE}+|{WHITE_SPACE}+\\z", "")


@F.arrow_udf(T.StringType())
def _unescape_rare(texts: pa.Array) -> pa.Array:
    return pa.array(
        [None if t is None else html.unescape(t) for t in texts.to_pylist()], pa.string()
    )


def unescape_html(text: Column) -> Column:
    """Decode character references.

    Texts with only frequent entities stay on the JVM. The Arrow function sees
    NULL for them, so next to nothing crosses into Python for those rows.
    """
    frequent = "|".join(name[1:-1] for name in FREQUENT_ENTITIES)
    pattern = F.lit(f"&(?!(?:{frequent});)[#A-Za-z]")
    rare = once(text, lambda t: F.when(F.contains(t, F.lit("&")) & F.rlike(t, pattern), t))

    def replaced(t: Column) -> Column:
        plain = t
        for name, char in FREQUENT_ENTITIES.items():
            plain = F.replace(plain, F.lit(name), F.lit(char))
        return F.when(F.contains(t, F.lit("&")), plain).otherwise(t)

    return F.coalesce(_unescape_rare(rare), once(text, replaced))


def strip_html(text) -> Column:
    """Flatten an HTML fragment to one line of plain text.

    Hand in a column of the frame rather than an expression with nested lambdas,
    out of which Spark cannot lift a Python function.
    """
    text = _col(text)
    for mark in ("<br>", "<br/>", "</p>"):
        text = F.replace(text, F.lit(mark), F.lit("\n"))
    text = F.regexp_replace(text, "<[^>]*>", " ")
    return squeeze(unescape_html(text))


def truncate(text, n: int | None) -> Column:
    """At most ``n`` bytes plus an ellipsis, never inside a character; None: the whole text."""
    if n is None:
        return _col(text)

    def cut(t: Column) -> Column:
        raw = t.cast("binary")

        def inside(k: int) -> Column:  # does byte k+1 continue a character?
            return F.hex(F.substring(raw, k + 1, 1)).rlike("^[89AB]")

        size = (
            F.when(~inside(n), n)
            .when(~inside(n - 1), n - 1)
            .when(~inside(n - 2), n - 2)
            .otherwise(n - 3)
        )
        head = F.substr(raw, F.lit(1), size).cast("string")
        return F.when(F.octet_length(t) <= n, t).otherwise(F.concat(head, F.lit(ELLIPSIS)))

    return once(_col(text), cut)


def haystack(title, tags, description) -> Column:
    """The text terms are looked for in."""
    return F.concat(
        F.lower(_col(title)),
        F.lit("\n"),
        F.lower(F.array_join(_col(tags), " ")),
        F.lit("\n"),
        F.lower(_col(description)),
    )


def fold(text) -> Column:
    """Lower case, plus the one ASCII letter with a second lower-case form."""
    return F.replace(F.lower(_col(text)), F.lit("ſ"), F.lit("s"))


def quote(term: str) -> str:
    """A regex that matches the term literally, in Java and RE2 alike."""
    return re.sub(r"([^\w\s])", r"\\\1", term, flags=re.ASCII) if term.isascii() else re.escape(term)


def _fold_term(term: str) -> str:
    return term.lower().replace("ſ", "s")


def word_pattern(terms) -> str:
    """One alternation for terms that must not touch an ASCII letter or digit."""
    return "(?:^|[^a-z0-9])(?:" + "|".join(quote(_fold_term(t)) for t in terms) + ")(?:$|[^a-z0-9])"


#: Up to this many terms a byte search runs before the regex.
PREFILTER_TERMS = 48


def any_match(folded: Column, terms) -> Column:
    """Does any term stand as a word in ``fold``-ed text?

    A byte search comes first: only rows holding a term's bytes are decoded for
    the regex. Terms beyond ASCII are matched with Unicode case folding instead.
    """
    terms = list(terms)
    ascii_terms = [t for t in terms if _fold_term(t).isascii()]
    others = [t for t in terms if not _fold_term(t).isascii()]
    tests = []
    if ascii_terms:
        test = F.rlike(folded, F.lit(word_pattern(ascii_terms)))
        if len(ascii_terms) <= PREFILTER_TERMS:
            holds = [F.contains(folded, F.lit(_fold_term(t))) for t in ascii_terms]
            hit = holds[0]
            for more in holds[1:]:
                hit = hit | more
            test = hit & test
        tests.append(test)
    if others:
        tests.append(F.rlike(folded, F.lit("(?iu)" + word_pattern(others))))
    if not tests:
        return F.lit(False)
    return tests[0] if len(tests) == 1 else tests[0] | tests[1]


def word_match(text, term: str) -> Column:
    """Case-insensitive literal match with ASCII letter/digit boundaries."""
    return any_match(fold(text), [term])


def first_marker(text: Column, markers) -> Column:
    """First marker, in list order, that is a substring; NULL when none is."""
    if not markers:
        return F.lit(None).cast("string")
    return F.coalesce(*[F.when(F.contains(text, F.lit(m)), F.lit(m)) for m in markers])


def any_marker(text: Column, markers) -> Column:
    hit = F.lit(False)
    for i, m in enumerate(markers):
        test = F.contains(text, F.lit(m))
        hit = test if i == 0 else hit | test
    return hit


def rel_time(ts, now: Column) -> Column:
    """Age in words: minutes below an hour, hours below two days, then days."""
    ts = _col(ts).cast("timestamp")
    micros = F.unix_micros(now.cast("timestamp")) - F.unix_micros(ts)

    def whole(unit: int) -> Column:
        return (micros / F.lit(unit * 1_000_000)).cast("long").cast("string")

    hour = 3600 * 1_000_000
    return (
        F.when(ts.isNull(), F.lit("–"))
        .when(micros < hour, F.concat(whole(60), F.lit("m ago")))
        .when(micros < 48 * hour, F.concat(whole(3600), F.lit("h ago")))
        .otherwise(F.concat(whole(86400), F.lit("d ago")))
    )


def fit_label(fit) -> Column:
    """The label of a fit, without its marker."""
    return F.substring_index(_col(fit), " (", 1)


def junk_tag(tag) -> Column:
    """Is a card label noise (salary, expiry, location, badge)?"""
    return F.rlike(_col(tag), F.lit("(?id)" + JUNK_TAG))


def split_company_title(text) -> tuple[Column, Column]:
    """"Company: role" at the first colon; no colon leaves the company empty."""
    text = _col(text)
    has = F.contains(text, F.lit(":"))
    company = F.when(has, trim_space(F.substring_index(text, ":", 1))).otherwise(F.lit(""))
    title = trim_space(F.when(has, F.regexp_replace(text, "^[^:]*:", "")).otherwise(text))
    return company, title


def post_header(text) -> tuple[Column, Column]:
    """Header line of a post and the company named in it."""
    text = _col(text)
    head = F.regexp_extract(text, r"^[^.\n]*", 0)
    header = F.when(F.octet_length(head).between(1, 199), head).otherwise(text)
    before_bar = F.substring_index(header, "|", 1)
    has_bar = F.contains(header, F.lit("|")) & (before_bar != "")
    company = F.when(has_bar, trim_space(before_bar)).otherwise(header)
    return header, company


def dedupe(values) -> Column:
    """Ordered distinct: the first occurrence stays."""
    return F.array_distinct(_col(values))


def cap_array(values, n: int | None) -> Column:
    """The first ``n`` values; None: all."""
    return _col(values) if n is None else F.slice(_col(values), 1, n)


def badge_to_location(css_class, base: str) -> Column:
    """A workplace badge's class, turned into a suffix of the base location."""
    css_class = _col(css_class)
    return (
        F.when(F.contains(css_class, F.lit("remote")), F.lit(f"{base} (remote)"))
        .when(F.contains(css_class, F.lit("hybrid")), F.lit(f"{base} (hybrid)"))
        .otherwise(F.lit(base))
    )


def remote_suffix(location, card_text, phrase: str = "Full Remote") -> Column:
    """Fold a card's workplace label into its location."""
    location = _col(location)
    marked = F.when(location == "", F.lit("Remote")).otherwise(F.concat(location, F.lit(" (remote)")))
    return F.when(F.contains(_col(card_text), F.lit(phrase)), marked).otherwise(location)


# ---- Fixed values: countries treated as one hiring area (EU/EEA and Switzerland)
HIRING_AREA = (
    "AT", "BE", "BG", "HR", "CY", "CZ", "DK", "EE", "FI", "FR", "DE", "GR", "HU", "IE", "IT", "LV",
    "LT", "LU", "MT", "NL", "PL", "PT", "RO", "SK", "SI", "ES", "SE", "NO", "IS", "LI", "CH",
)


def countries_to_location(
    countries,
    home: str = "BG",
    home_label: str = "Bulgaria (remote)",
    area=HIRING_AREA,
    area_label: str = "Remote, Europe",
    anywhere_label: str = "Remote, worldwide",
) -> Column:
    """Required countries as a location; NULL where the listing is out of reach."""
    upper = F.transform(F.coalesce(_col(countries), F.array().cast("array<string>")), F.upper)
    return (
        F.when(F.size(upper) == 0, F.lit(anywhere_label))
        .when(F.array_contains(upper, home.upper()), F.lit(home_label))
        .when(F.arrays_overlap(upper, F.array(*[F.lit(c) for c in area])), F.lit(area_label))
    )
