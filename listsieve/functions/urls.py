"""URL columns: parsing, normalising, hosts, and the two identity hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from listsieve.functions.text import _col

# ---- Fixed values -----------------------------------------------------------
# Query keys that vary between fetches of one page (matched on the lower-cased key).
TRACKING_KEY = r"^(utm_|mc_|_hs|(srsltid|gclid|fbclid|ref)\z)"
# -----------------------------------------------------------------------------

_SCHEME = r"[A-Za-z][A-Za-z0-9+.\-]*:"
_AUTHORITY = rf"^(?:{_SCHEME})?//([^/?#]*)"
# What makes a URL unreadable, as alternatives of one pattern. Only plain character
# classes are repeated, so that no input, however long, can exhaust the regex stack.
_NAMED = rf"^(?:{_SCHEME}|(?!///))//"
_BAD_ESCAPE = "%(?![0-9A-Fa-f]{2})"
_HOST = r"[A-Za-z0-9\-_.~!$&'()*+,;=<>\x22%\x{80}-\x{10FFFF}]"
_UNREADABLE = "|".join(
    [
        r"[\x00-\x1f\x7f]",  # control characters
        rf"^(?!{_SCHEME})[^/?#]*:",  # a colon in the first segment, but no scheme
        rf"^(?:{_SCHEME}(?=/)|(?!{_SCHEME}))[^?#]*{_BAD_ESCAPE}",  # host or path
        rf"^[^#]*#.*{_BAD_ESCAPE}",  # fragment
        rf"{_NAMED}(?![^/?#]*@)(?!{_HOST}*+(?::{_HOST}*+)*?(?::[0-9]*+)?(?:[/?#]|\z))(?!\[)",
        rf"{_NAMED}(?![A-Za-z0-9\-._:~!$&'()*+,;=%@]*@)[^/?#]*@",  # user
        rf"{_NAMED}(?:[^/?#]*@)?[^/?#@]*:(?![0-9]*(?:[/?#]|\z))[^/?#@:\]]*(?:[/?#]|\z)",  # port
        rf"{_NAMED}(?:[^/?#]*@)(?!{_HOST}*+(?::{_HOST}*+)*?(?:[/?#]|\z))(?!\[)[^/?#@]*(?:[/?#]|\z)",
        rf"{_NAMED}(?:[^/?#]*@)?[^/?#@]*%(?!25|[89A-Fa-f])",  # escapes in the host
        rf"{_NAMED}(?:[^/?#]*@)?\[(?![^\]/?#]*\](?::[0-9]*)?(?:[/?#]|\z))",  # IPv6
    ]
)


def _let(name: str, value: str, body: str) -> str:
    """SQL that evaluates ``value`` once and names it in ``body``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _r(pattern: str) -> str:
    """A SQL string that takes every backslash as it stands."""
    return "r'" + pattern.replace("'", r"\x27") + "'"


def _named(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def _readable(url: str) -> str:
    return f"NOT rlike({url}, {_r(_UNREADABLE)})"


def _cut(url: str, body: str) -> str:
    """``body`` with ``addr, base, scheme, rest, host, opaque, path`` of a URL.

    ``addr`` is the URL without fragment, ``base`` also without query.
    """
    steps = [
        ("u", url),
        ("addr", "substring_index(u, '#', 1)"),
        ("base", "substring_index(addr, '?', 1)"),
        ("scheme", f"regexp_extract(base, {_r('^' + _SCHEME)}, 0)"),
        ("rest", "substr(base, length(scheme) + 1)"),
        # "///x" names a host only when a scheme came first.
        ("host", "CASE WHEN startswith(rest, '//') AND (scheme <> '' OR NOT startswith(rest, '///')) "
                 "THEN regexp_extract(rest, '^//[^/]*', 0) ELSE '' END"),
        ("opaque", "scheme <> '' AND rest <> '' AND NOT startswith(rest, '/')"),
        ("path", "substr(rest, length(host) + 1)"),
    ]
    for name, value in reversed(steps):
        body = _let(name, value, body)
    return body


def _form(text: str) -> str:
    """Form encoding that leaves ``~`` and encodes ``*``."""
    return f"replace(replace(url_encode({text}), '%7E', '~'), '*', '%2A')"


def _escaped(text: str, keep: str) -> str:
    """Percent-encoding of all but unreserved characters and ``keep``."""
    out = f"replace({_form(text)}, '+', '%20')"
    for char in keep:
        out = f"replace({out}, '%{ord(char):02X}', {_r(char)})"
    return out


def _decoded(path: str) -> str:
    return f"coalesce(try_url_decode(replace({path}, '+', '%2B')), {path})"


_PATH_KEEPS, _HOST_KEEPS = "$&+,/:;=@", "!$&()*+,;=:[]<>@%/"
_VALID_PATH = r"^[A-Za-z0-9\-_.~$&+,/:;=@!\x27()*\[\]%]*\z"


def _query(text: str) -> str:
    """Tracking keys dropped, sorted by key; values of one key keep their order."""
    value = "CASE WHEN contains(pair, '=') THEN substr(pair, instr(pair, '=') + 1) ELSE '' END"
    pairs = (
        f"transform(split({text}, '&'), (pair, i) -> named_struct("
        f"'key', try_url_decode(substring_index(pair, '=', 1)), 'i', i, "
        f"'value', try_url_decode({value}), 'pair', pair))"
    )
    kept = (
        f"filter({pairs}, p -> p.pair <> '' AND NOT contains(p.pair, ';') AND p.key IS NOT NULL "
        f"AND p.value IS NOT NULL AND NOT rlike(lower(p.key), {_r(TRACKING_KEY)}))"
    )
    coded = f"transform(array_sort({kept}), p -> concat({_form('p.key')}, '=', {_form('p.value')}))"
    return f"array_join({coded}, '&')"


def url_parses(url: str) -> Column:
    """Would the URL parse: no control characters, bad escapes or bad hosts?"""
    return F.expr(_readable(_named(url)))


def normalize_url(url: str) -> Column:
    """One spelling per page: no fragment, no tracking keys, sorted query.

    A path that is already valid stays as written, any other is re-encoded; a URL
    that does not parse is left alone. The whole is one SQL expression over a
    column name, which Spark reads in one go.
    """
    host = f"CASE WHEN rlike(host, {_r('^[ -~]*$')}) THEN host ELSE {_escaped('host', _HOST_KEEPS)} END"
    path = f"CASE WHEN rlike(path, {_r(_VALID_PATH)}) THEN path ELSE {_escaped(_decoded('path'), _PATH_KEEPS)} END"
    body = f"CASE WHEN opaque THEN rest ELSE concat({host}, {path}) END"
    asked = "substr(addr, length(base) + 2)"
    # A bare "?" at the end, the only one in the URL, is part of the address.
    tail = (
        "CASE WHEN asked <> '' THEN "
        + _let("q", _query("asked"), "CASE WHEN q <> '' THEN concat('?', q) ELSE '' END")
        + " WHEN endswith(addr, '?') THEN '?' ELSE '' END"
    )
    normal = _let("asked", asked, f"concat(lower(scheme), {body}, {tail})")
    name = _named(url)
    return F.expr(f"CASE WHEN {_readable(name)} THEN {_cut(name, normal)} ELSE {name} END")


def last_path_segment(url: str) -> Column:
    """Text after the last slash of the path; one trailing slash is ignored."""
    name = _named(url)
    path = _cut(name, f"CASE WHEN opaque THEN '' ELSE {_decoded('path')} END")
    text = f"CASE WHEN {_readable(name)} THEN {path} ELSE {name} END"
    return F.expr(f"substring_index(regexp_replace({text}, '/$', ''), '/', -1)")


def host(url) -> Column:
    """Host name as written, without user, port or IPv6 brackets."""
    authority = F.regexp_replace(F.regexp_extract(_col(url), _AUTHORITY, 1), "^.*@", "")
    return F.when(
        F.startswith(authority, F.lit("[")), F.regexp_extract(authority, r"^\[([^\]]*)\]", 1)
    ).otherwise(F.regexp_replace(authority, r":\d*\z", ""))


def bare_host(url) -> Column:
    """Host name without a leading ``www.``."""
    return F.regexp_replace(host(url), r"^www\.", "")


def absolute_url(href, base: str) -> Column:
    href = _col(href)
    return F.when(F.startswith(href, F.lit("/")), F.concat(F.lit(base), href)).otherwise(href)


def rewrite_mirror(url, origin: str, mirror: str) -> Column:
    """Point a URL at a mirror host: the first ``origin`` in it is replaced."""
    url = _col(url)
    at = F.instr(url, origin)
    swapped = F.concat(
        F.substr(url, F.lit(1), at - 1), F.lit(mirror), F.substr(url, at + len(origin))
    )
    return F.when(at > 0, swapped).otherwise(url)


def _short_sha1(text: Column) -> Column:
    return F.substring(F.sha1(text), 1, 16)


def ad_id(source, url) -> Column:
    """Stable id of a listing within its source."""
    return _short_sha1(F.concat(_col(source), F.lit("|"), _col(url)))


def content_key(company, title, unicode_keys: bool = False) -> Column:
    """Same company and title, whatever the URL.

    Only ASCII letters and digits count unless ``unicode_keys`` is set, so all
    listings without any share one key; joins on it have to expect that.
    """
    junk = r"[^\p{L}\p{N}]+" if unicode_keys else "[^a-z0-9]+"

    def norm(text) -> Column:
        return F.trim(F.regexp_replace(F.lower(_col(text)), junk, " "))

    return _short_sha1(F.concat(norm(company), F.lit("|"), norm(title)))
