"""The queries again, in SQL for DuckDB, written independently of the columns."""

from __future__ import annotations

from listsieve.functions import lexicon as lx
from listsieve.plans import fixtures as fx
from listsieve.plans import queries as q

ORACLES: dict[str, str] = {}

NOW = f"TIMESTAMP '{fx.NOW}'"
P = fx.PROFILE


# ---- Pieces of SQL -------------------------------------------------------------------


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def esc(term: str) -> str:
    return "".join(c if c.isalnum() or c in " _" else "\\" + c for c in term)


def word(text: str, terms) -> str:
    """Some term stands in the text between non-alphanumeric neighbours."""
    if not terms:
        return "FALSE"
    tests = [
        f"regexp_matches({text}, {lit('(^|[^a-z0-9])' + esc(t.lower()) + '($|[^a-z0-9])')})"
        for t in terms
    ]
    return "(" + " OR ".join(tests) + ")"


def has(text: str, markers) -> str:
    return "(" + " OR ".join(f"contains({text}, {lit(m)})" for m in markers) + ")" if markers else "FALSE"


def first_of(text: str, markers) -> str:
    return "CASE " + " ".join(f"WHEN contains({text}, {lit(m)}) THEN {lit(m)}" for m in markers) + " END"


def count(text: str, words) -> str:
    pattern = f"(^|[^a-zà-ž])({'|'.join(esc(w) for w in words)})($|[^a-zà-ž])"
    return f"least(len(regexp_extract_all({text}, {lit(pattern)})), 25)"


class Lang:
    """Votes and verdict of one keep list, for lower-cased text."""

    def __init__(self, keep):
        langs = lx.DEFAULT_LEXICON.languages
        self.kept_words = [w for k in keep for w in langs[k].stopwords]
        self.foreign = [l.stopwords for k, l in langs.items() if k not in keep and l.stopwords]
        self.titles = [w for k, l in langs.items() if k not in keep for w in l.title_words]
        self.groups = [
            d for d in lx.DEFAULT_LEXICON.diacritics if any(l not in keep for l in d.languages)
        ]

    def kept(self, text):
        return count(text, self.kept_words)

    def strongest(self, text):
        return "greatest(" + ", ".join(count(text, w) for w in self.foreign) + ")"

    def excluded(self, text):
        """No script test: the tables hold Latin letters only."""
        kept, strongest = self.kept(text), self.strongest(text)
        marks = " OR ".join(
            f"len(regexp_extract_all({text}, {lit('[' + d.letters + ']')})) >= {d.at_least}" for d in self.groups
        )
        total = f"({strongest} + CASE WHEN {marks} THEN 2 ELSE 0 END)"
        return (
            f"(regexp_matches({text}, '\\p{{L}}') AND (({count(text, self.titles)} >= 1 AND {kept} <= 1)"
            f" OR ({total} >= 3 AND {total} > {kept})))"
        )


def squeezed(text: str) -> str:
    return f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"


ENTITIES = [("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]


def stripped(text: str) -> str:
    text = f"regexp_replace({text}, '<[^>]*>', ' ', 'g')"
    for name, char in ENTITIES:
        text = f"replace({text}, {lit(name)}, {lit(char)})"
    return squeezed(text)


def truncated(text: str, n: int) -> str:
    """Cut by bytes on the hex form, backing off from the middle of a character."""
    code = f"hex(encode({text}))"

    def inside(k):
        return f"substr({code}, {2 * k + 1}, 1) IN ('8', '9', 'A', 'B')"

    size = (
        f"CASE WHEN NOT {inside(n)} THEN {n} WHEN NOT {inside(n - 1)} THEN {n - 1} "
        f"WHEN NOT {inside(n - 2)} THEN {n - 2} ELSE {n - 3} END"
    )
    return (
        f"CASE WHEN strlen({text}) <= {n} THEN {text} "
        f"ELSE decode(unhex(left({code}, 2 * ({size})))) || '…' END"
    )


def short_sha(text: str) -> str:
    return f"left(sha1({text}), 16)"


def norm(text: str) -> str:
    return f"trim(regexp_replace(lower({text}), '[^a-z0-9]+', ' ', 'g'))"


def stamp(value: str) -> str:
    return f"coalesce(strftime({value}, '%Y-%m-%d %H:%M:%S'), '')"


def line(text: str = "text") -> str:
    return f"left(regexp_extract({text}, '^[^.\\n]*'), 140)"


KEY = "CASE WHEN doc_id % 100 >= 80 THEN doc_id - 20 ELSE doc_id END"

ADS = f"""
ads AS (
  SELECT doc_id, doc_id AS seq, source, {line()} AS title, 'Co ' || (doc_id % 40) AS company,
    coalesce(r_name, '') AS location,
    'https://jobs.example.com/ad/' || ({KEY}) || '?id=' || ({KEY}) || '&utm_source=' || doc_id AS raw_url,
    'https://jobs.example.com/ad/' || ({KEY}) || '?id=' || ({KEY}) AS url,
    lang || '|' || source AS tags, lang || ' ' || source AS tag_text, text AS description
  FROM documents LEFT JOIN region ON r_regionkey = doc_id % 5)"""

RANKED = f"""{ADS},
ranked AS (
  SELECT *, CAST(doc_id % 17 - 3 AS INT) AS score,
    CASE doc_id % 4 WHEN 0 THEN 'home (europe)' WHEN 1 THEN 'away' WHEN 2 THEN 'away (unverified)' ELSE '' END AS fit,
    {short_sha("source || '|' || url")} AS id,
    {short_sha(norm('company') + " || '|' || " + norm('title'))} AS content_key
  FROM ads)"""

STATE = f"""{RANKED},
state AS (
  SELECT *, doc_id % 7 = 0 AS hidden,
    {NOW} - to_minutes((doc_id * 137) % 200000 + 1440) AS first_seen,
    {NOW} - to_minutes((doc_id * 137) % 200000) AS last_seen,
    CASE WHEN status <> '' THEN {NOW} - to_minutes((doc_id * 137) % 200000) END AS status_at
  FROM (SELECT *, CASE WHEN doc_id % 13 = 0 THEN 'applied' WHEN doc_id % 29 = 0 THEN 'declined' ELSE '' END AS status
        FROM ranked WHERE doc_id % 100 < 80 AND doc_id % 10 < 6))"""
#: Every document that is no repeat.
WHOLE_STATE = STATE.replace(" AND doc_id % 10 < 6", "")

BATCH = f"""{STATE},
batch AS (SELECT *, doc_id % 11 = 0 AS hidden FROM ranked WHERE doc_id % 10 >= 4 OR doc_id % 100 >= 80),
firsts AS (SELECT * FROM batch QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq) = 1),
lasts AS (SELECT *, bool_or(hidden) OVER (PARTITION BY id) AS any_hidden FROM batch
          QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1),
hidden_keys AS (SELECT DISTINCT content_key FROM state WHERE hidden),
fresh AS (SELECT * FROM firsts WHERE NOT hidden AND id NOT IN (SELECT id FROM state)
          AND content_key NOT IN (SELECT content_key FROM hidden_keys))"""

CRAWLED = f"""{ADS},
crawled AS (
  SELECT 'https://jobs.example.com/ad/' || k || '?id=' || k || '&utm_source=' || page_id AS url,
    {NOW} - to_minutes((page_id % 50) * 1440) AS crawled_at
  FROM (SELECT page_id, CASE WHEN page_id % 100 >= 80 THEN page_id - 20 ELSE page_id END AS k FROM pages)
  WHERE page_id % 3 = 0),
fetched AS (
  SELECT page_id, page_id % 7 <> 0 AS ok, html, regexp_extract(html, '<title>([^<]*)</title>', 1) AS page_title,
    'https://jobs.example.com/ad/' || k || '?id=' || k || '&utm_source=' || page_id AS url
  FROM (SELECT *, CASE WHEN page_id % 100 >= 80 THEN page_id - 20 ELSE page_id END AS k FROM pages)),
waiting AS (SELECT * FROM ads WHERE raw_url NOT IN
  (SELECT url FROM crawled WHERE crawled_at > {NOW} - INTERVAL 30 DAY))"""


def with_(ctes: str, body: str) -> str:
    return f"WITH {ctes.strip()}\n{body}"


# ---- Cascade ----------------------------------------------------------------------------


def cascade() -> str:
    geo, lang = P.geography, Lang(P.languages)
    core, t, h, both = P.core_title_terms, "lt", "hay", "lt || ' ' || ld"
    named = [(k, f"k{i}", word(h, [k.term])) for i, k in enumerate(P.keywords)]
    boosts = [(b, f"t{i}", word(t, [b])) for i, b in enumerate(P.title_boost)]
    extras = [(b, f"b{i}", word(h, b.terms)) for i, b in enumerate(P.bonuses) if b.terms]
    flags = ", ".join(f"{sql} AS {name}" for _, name, sql in named + boosts + extras)
    points = [(n, k.weight or 1) for k, n, _ in named] + [(n, P.title_boost_weight) for _, n, _ in boosts]
    points += [(n, b.weight or 1) for b, n, _ in extras]
    total = " + ".join(f"(CASE WHEN {n} THEN {w} ELSE 0 END)" for n, w in points)
    labels = [f"CASE WHEN {n} THEN {lit(k.term)} END" for k, n, _ in named]
    labels += [f"CASE WHEN {n} THEN {lit(b.reason or b.terms[0])} END" for b, n, _ in extras]
    return f"""{ADS},
texts AS (SELECT *, lower(title) AS lt, lower(description) AS ld, lower(location) || ' ' || lower(title) AS place,
  lower(title || chr(10) || tag_text || chr(10) || description) AS hay FROM ads),
flagged AS (SELECT *, {word(t, P.exclude)} AS x_title, {has('lower(company)', [c.lower() for c in P.exclude_companies])} AS x_company,
  {lang.excluded('lt')} OR {lang.excluded(f'({both})')} AS x_lang,
  ({word(t, P.adjacent_titles)} AND NOT {word(t, core)}) OR NOT {word(h, P.require_any)} AS x_focus,
  CASE WHEN {has('place', geo.local_markers)} THEN 'home (' || {first_of('place', geo.local_markers)} || ')'
    WHEN {has('ld', geo.local_markers)} THEN 'home'
    WHEN {has('place', geo.reject_markers)} THEN NULL
    WHEN {has('place', geo.region_markers)} THEN 'away (' || {first_of('place', geo.region_markers)} || ')'
    WHEN {has('ld', geo.region_markers)} THEN 'away'
    WHEN {has('ld', geo.reject_markers)} THEN NULL ELSE 'away (unverified)' END AS geo,
  {flags} FROM texts),
staged AS (SELECT *, CASE WHEN x_title THEN 'title' WHEN x_company THEN 'company' WHEN x_lang THEN 'language'
  WHEN x_focus THEN 'focus' WHEN geo IS NULL THEN 'geography' ELSE '' END AS why,
  {total} AS points, array_to_string(list_filter([{', '.join(labels)}], lambda x: x IS NOT NULL), '|') AS names FROM flagged),
evaluated AS (SELECT *, CAST(CASE WHEN why = '' THEN points ELSE 0 END AS INT) AS score,
  CASE WHEN why = '' THEN names ELSE '' END AS reasons, CASE WHEN why = '' THEN geo ELSE '' END AS fit,
  CASE WHEN why <> '' THEN why WHEN points < {P.min_score} THEN 'score' ELSE '' END AS reject_reason FROM staged)"""


ORACLES["evaluate_ads"] = with_(
    cascade(), "SELECT doc_id, score, reasons, fit, reject_reason = '' AS keep, reject_reason FROM evaluated"
)
ORACLES["flagship"] = with_(
    cascade(),
    "SELECT doc_id, source, title, score, reasons, fit FROM evaluated WHERE reject_reason = '' ORDER BY score DESC, doc_id",
)
ORACLES["funnel"] = with_(
    cascade(),
    """SELECT coalesce(source, '*') AS source, coalesce(outcome, '*') AS outcome, count(*) AS ads FROM
    (SELECT source, CASE reject_reason WHEN '' THEN 'kept' ELSE reject_reason END AS outcome FROM evaluated)
    GROUP BY ROLLUP (source, outcome)""",
)
ORACLES["source_metrics"] = with_(
    STATE + "," + cascade().replace(ADS + ",", "", 1),
    f"""SELECT source, count(*) AS fetched, count(*) FILTER (reject_reason = '') AS matched,
      count(*) FILTER (reject_reason = '' AND is_first AND id NOT IN (SELECT id FROM state)
        AND content_key NOT IN (SELECT content_key FROM state WHERE hidden)) AS new
    FROM (SELECT e.*, row_number() OVER (PARTITION BY {short_sha("e.source || '|' || e.url")}, reject_reason = '' ORDER BY e.seq) = 1 AS is_first,
        r.id, r.content_key FROM evaluated e JOIN ranked r USING (doc_id)) GROUP BY source""",
)
ORACLES["title_and_company"] = with_(
    ADS,
    f"""SELECT doc_id, {word('lower(title)', P.exclude)} AS by_title,
    {has('lower(company)', [c.lower() for c in P.exclude_companies])} AS by_company FROM ads""",
)
for _keep in (["de"], ["fr"], ["en", "de"]):
    _l = Lang(_keep)
    ORACLES["language_filter_" + "_".join(_keep)] = (
        f"SELECT doc_id, CAST({_l.kept('t')} AS INT) AS kept_votes, CAST({_l.strongest('t')} AS INT) AS foreign_votes, "
        f"{_l.excluded('t')} AS excluded FROM (SELECT doc_id, lower(text) AS t FROM documents)"
    )
_en = Lang(["en"])
ORACLES["language_excluded_ads"] = with_(
    ADS,
    f"""SELECT doc_id, {_en.excluded('t')} OR {_en.excluded('b')} AS excluded FROM
    (SELECT doc_id, lower(title) AS t, lower(title || ' ' || description) AS b FROM ads)""",
)
ORACLES["score_terms_unicode"] = r"""
WITH low AS (SELECT doc_id, lower(text) AS text FROM documents),
terms AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[^\x00-\x7F]+')) AS term FROM low)
SELECT doc_id, CAST(sum(CASE length(term) % 5 WHEN 0 THEN 1 ELSE length(term) % 5 END) AS INT) AS score,
  string_agg(term, '|' ORDER BY term) AS reasons
FROM low JOIN terms ON contains(text, term) AND regexp_matches(text, '(^|[^a-z0-9])' || term || '($|[^a-z0-9])')
GROUP BY doc_id"""
_PAIRS = """list_filter(list_transform(regexp_split_to_array(text, '[^a-z0-9 ]+|  +'), lambda r: list_filter(regexp_split_to_array(r, ' '),
  lambda w: w <> '')).list_transform(lambda ws: list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])).flatten(), lambda p: p IS NOT NULL)"""
ORACLES["score_terms"] = """
WITH bench AS (SELECT lower(text) AS text FROM benchmark),
terms AS (SELECT DISTINCT term FROM (
    SELECT unnest(regexp_split_to_array(text, '[^a-z0-9]+')) AS term FROM bench) WHERE term <> ''
  UNION SELECT unnest(pairs) FROM (SELECT PAIRS AS pairs FROM bench)),
tokens AS (SELECT doc_id, unnest(list_distinct(regexp_split_to_array(lower(text), '[^a-z0-9]+'))) AS token FROM documents
  UNION ALL SELECT doc_id, unnest(list_distinct(pairs)) FROM (SELECT doc_id, PAIRS AS pairs FROM (SELECT doc_id, lower(text) AS text FROM documents))),
hits AS (SELECT doc_id, term FROM tokens JOIN terms ON token = term)
SELECT doc_id, CAST(sum(CASE length(term) % 5 WHEN 0 THEN 1 ELSE length(term) % 5 END) AS INT) AS score,
  string_agg(term, '|' ORDER BY term) AS reasons FROM hits GROUP BY doc_id""".replace("PAIRS", _PAIRS)

_g = q.GEOGRAPHY
ORACLES["geography"] = f"""
SELECT c_custkey, fit IS NOT NULL AS ok, coalesce(fit, '') AS fit FROM (
  SELECT c_custkey, CASE WHEN {has('place', _g.local_markers)} THEN 'near (' || {first_of('place', _g.local_markers)} || ')'
    WHEN {has('txt', _g.local_markers)} THEN 'near' WHEN {has('place', _g.reject_markers)} THEN NULL
    WHEN {has('place', _g.region_markers)} THEN 'far (' || {first_of('place', _g.region_markers)} || ')'
    WHEN {has('txt', _g.region_markers)} THEN 'far' END AS fit
  FROM (SELECT c_custkey, lower(r_name || ' ' || c_name) AS place, lower(c_mktsegment) AS txt
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey))"""

# ---- URLs and identity --------------------------------------------------------------------

_QUERY = """array_to_string(list_sort(list_filter(string_split(regexp_extract(u, '\\?([^#]*)', 1), '&'),
  lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_|mc_|_hs|(srsltid|gclid|fbclid|ref)=)'))), '&')"""
ORACLES["normalize_urls"] = f"""
SELECT page_id, base || CASE WHEN qs <> '' THEN '?' || qs ELSE '' END AS url,
  regexp_replace(regexp_extract(base, '//([^/:]*)', 1), '^www\\.', '') AS host,
  regexp_extract(regexp_replace(base, '/$', ''), '[^/]*$') AS segment
FROM (SELECT page_id, regexp_extract(url, '^[^?#]*') AS base, {_QUERY.replace('(u,', '(url,')} AS qs FROM pages)"""
ORACLES["ad_identity"] = with_(RANKED, "SELECT doc_id, url, id, content_key FROM ranked")
ORACLES["first_wins_dedupe"] = """SELECT user_id, event_type, event_id, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1"""
ORACLES["first_wins_ads"] = with_(
    ADS,
    """SELECT doc_id, source, url, title FROM ads
QUALIFY row_number() OVER (PARTITION BY source, url ORDER BY seq) = 1""",
)
_host = "lower(regexp_extract(url, '//([^/:?#]*)', 1))"
ORACLES["domain_skip"] = f"SELECT page_id, url FROM pages WHERE NOT {has(_host, q.DOMAINS)}"
_skips = q.DOMAINS + q.lookup.ALWAYS_SKIP
ORACLES["domain_skip_table"] = f"SELECT page_id, url FROM pages WHERE NOT {has(_host, _skips)}"

# ---- Text ------------------------------------------------------------------------------------

ORACLES["strip_html_pages"] = f"SELECT page_id, {stripped('html')} AS text FROM pages"
ORACLES["truncate_bytes"] = (
    f"SELECT doc_id, {truncated('text', 60)} AS cut_60, {truncated('text', 2001)} AS cut_2001 FROM documents"
)
_POST = "role || ' | ' || text"
_HEAD = "regexp_extract(t, '^[^.\\n]*')"
ORACLES["post_headers"] = f"""
SELECT post_id, header, CASE WHEN strpos(header, '|') > 1 THEN trim(left(header, strpos(header, '|') - 1)) ELSE header END AS company
FROM (SELECT post_id, CASE WHEN strlen({_HEAD}) BETWEEN 1 AND 199 THEN {_HEAD} ELSE t END AS header
  FROM (SELECT conv_id * 1000 + turn AS post_id, {squeezed(_POST)} AS t FROM conversations))"""
ORACLES["company_titles"] = f"""
SELECT doc_id, CASE WHEN strpos(s, ':') > 0 THEN trim(left(s, strpos(s, ':') - 1)) ELSE '' END AS company,
  trim(CASE WHEN strpos(s, ':') > 0 THEN substr(s, strpos(s, ':') + 1) ELSE s END) AS title
FROM (SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN source || ': ' ELSE '' END || {line()} AS s FROM documents)"""
ORACLES["ages"] = """
SELECT event_id, CASE WHEN event_id % 10 = 0 THEN '–' WHEN us < 3600000000 THEN trunc(us / 60000000)::BIGINT || 'm ago'
  WHEN us < 172800000000 THEN trunc(us / 3600000000)::BIGINT || 'h ago' ELSE trunc(us / 86400000000)::BIGINT || 'd ago' END AS age
FROM (SELECT event_id, epoch_us(TIMESTAMP '2024-01-20 12:00:00') - epoch_us(ts) AS us FROM events)"""
ORACLES["label_rules"] = """
SELECT p_partkey,
  p_size % 5 IN (0, 1, 2) OR p_size % 5 = 3 AS junk,
  CASE p_partkey % 5 WHEN 0 THEN 'Remote, worldwide' WHEN 2 THEN 'Remote, Europe' WHEN 3 THEN 'Bulgaria (remote)' ELSE '' END AS location,
  CASE WHEN p_size % 3 = 0 THEN 'Here (remote)' ELSE 'Here' END AS badge,
  CASE WHEN p_size % 3 = 0 THEN CASE WHEN p_size % 2 = 0 THEN 'Remote' ELSE p_brand || ' (remote)' END
    ELSE CASE WHEN p_size % 2 = 0 THEN '' ELSE p_brand END END AS place,
  CASE WHEN p_size % 2 = 0 THEN 'https://h/a' ELSE 'b' END AS href,
  p_partkey % 4 <> 3 AS valid, p_partkey % 4 <> 0 AS tracked, p_brand AS label,
  (SELECT string_agg(c, '' ORDER BY i) FROM (SELECT c, min(i) AS i FROM
     (SELECT substr(p_name, g.i, 1) AS c, g.i FROM generate_series(1, length(p_name)) AS g(i)) GROUP BY c)) AS letters,
  p_brand = 'Brand#1' AS brand_1
FROM part"""
ORACLES["time_formats"] = f"""
SELECT event_id, {stamp("CASE WHEN event_id % 2 = 1 THEN s ELSE s - INTERVAL 2 HOUR END")} AS rfc3339,
  {stamp("CASE WHEN event_id % 2 = 1 THEN s END")} AS zoneless,
  {stamp("s + INTERVAL 90 MINUTE")} AS rfc1123z, {stamp("date_trunc('minute', s)")} AS card,
  {stamp("CASE WHEN event_id % 2 = 1 THEN s END")} AS epoch
FROM (SELECT event_id, date_trunc('second', ts) AS s FROM events)"""

# ---- Events ------------------------------------------------------------------------------------

ORACLES["attribution"] = """
WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos,
    CASE WHEN event_type IN ('view', 'click') THEN 'label' WHEN event_type = 'purchase' THEN 'item' ELSE 'note' END AS kind,
    event_type, CAST(floor(value) % 5 AS BIGINT)::VARCHAR AS item, CAST(floor(value) % 4 AS BIGINT)::VARCHAR AS four, props FROM events),
k AS (SELECT *, CASE WHEN kind = 'item' OR (kind = 'note' AND event_id % 3 = 0) THEN item ELSE '' END AS key,
    CASE kind WHEN 'label' THEN event_type || four WHEN 'item' THEN props
      ELSE CASE WHEN event_id % 11 = 0 THEN '' ELSE 'c' || (event_id % 7) END END AS val FROM e),
p AS (SELECT *, count(*) FILTER (kind = 'item') OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS items,
    last_value(CASE WHEN kind = 'item' THEN key END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_key FROM k),
firsts AS (SELECT user_id, key, pos AS first_pos, event_id AS first_event, items FROM p WHERE kind = 'item'
    QUALIFY row_number() OVER (PARTITION BY user_id, key ORDER BY pos) = 1),
titles AS (SELECT user_id, key, val AS title FROM p WHERE kind = 'item'
    QUALIFY row_number() OVER (PARTITION BY user_id, key ORDER BY strlen(val) DESC, pos) = 1),
labels AS (SELECT user_id, items, string_agg(val, '|' ORDER BY first_at) AS tags FROM
    (SELECT user_id, items, val, min(pos) AS first_at FROM p WHERE kind = 'label' GROUP BY ALL) GROUP BY ALL),
notes AS (SELECT user_id, CASE WHEN key <> '' THEN key ELSE last_key END AS key, pos, val FROM p WHERE kind = 'note' AND val <> ''),
companies AS (SELECT n.user_id, n.key, n.val AS company FROM notes n JOIN firsts f ON n.user_id = f.user_id AND n.key = f.key AND n.pos > f.first_pos
    QUALIFY row_number() OVER (PARTITION BY n.user_id, n.key ORDER BY n.pos) = 1)
SELECT f.user_id, f.key, f.first_event, t.title, coalesce(c.company, '') AS company, coalesce(l.tags, '') AS tags
FROM firsts f JOIN titles t USING (user_id, key) LEFT JOIN companies c USING (user_id, key)
LEFT JOIN labels l ON l.user_id = f.user_id AND l.items = f.items"""

# ---- State ---------------------------------------------------------------------------------------

_COLS = "id, source, title, company, url, score, fit, tags, CAST(length(description) AS INT) AS length"
ORACLES["merged_state"] = with_(
    BATCH,
    f"""SELECT coalesce(l.id, s.id) AS id, coalesce(l.source, s.source) AS source, coalesce(l.title, s.title) AS title,
  coalesce(l.company, s.company) AS company, coalesce(l.url, s.url) AS url, coalesce(l.score, s.score) AS score,
  coalesce(l.fit, s.fit) AS fit, coalesce(l.tags, s.tags) AS tags,
  CAST(length(coalesce(l.description, s.description)) AS INT) AS length,
  {stamp(f"coalesce(s.first_seen, {NOW})")} AS first_seen,
  {stamp(f"CASE WHEN l.id IS NOT NULL THEN {NOW} ELSE s.last_seen END")} AS last_seen,
  CASE WHEN s.id IS NULL THEN l.any_hidden OR f.content_key IN (SELECT content_key FROM hidden_keys)
    ELSE s.hidden OR coalesce(l.any_hidden, FALSE) END AS hidden,
  coalesce(s.status, '') AS status, {stamp("s.status_at")} AS status_at
FROM state s FULL JOIN lasts l ON s.id = l.id LEFT JOIN firsts f ON f.id = l.id
WHERE coalesce(s.status, '') <> '' OR CASE WHEN l.id IS NOT NULL THEN {NOW} ELSE s.last_seen END >= {NOW} - INTERVAL 60 DAY""",
)
ORACLES["merged_fresh"] = with_(
    BATCH,
    f"""SELECT {_COLS}, {stamp(NOW)} AS first_seen, '' AS last_seen, FALSE AS hidden, '' AS status, '' AS status_at FROM fresh""",
)
ORACLES["collapsed_batch"] = with_(
    BATCH,
    """SELECT l.id, f.company AS first_company, l.company AS last_company, f.hidden AS first_hidden, l.any_hidden,
  f.seq AS first_seq FROM lasts l JOIN firsts f USING (id)""",
)
ORACLES["hidden_content"] = with_(WHOLE_STATE, "SELECT DISTINCT content_key FROM state WHERE hidden")
ORACLES["suppressed_ids"] = with_(BATCH, "SELECT id FROM firsts WHERE content_key IN (SELECT content_key FROM hidden_keys)")
ORACLES["retention"] = f"""
SELECT user_id, day, status, {stamp("last_seen")} AS last_seen FROM
 (SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, max(ts) AS last_seen,
   CASE WHEN count(*) FILTER (event_type = 'purchase') > 2 THEN 'applied' ELSE '' END AS status FROM events GROUP BY 1, 2)
WHERE status <> '' OR last_seen >= TIMESTAMP '2024-03-10 06:00:00' - INTERVAL 60 DAY"""


def _purged() -> str:
    lang = Lang(P.languages)
    lt, hay = "lower(title)", "lower(title || chr(10) || tag_text || chr(10) || description)"
    focus = f"(({word(lt, P.adjacent_titles)} AND NOT {word(lt, P.core_title_terms)}) OR NOT {word(hay, P.require_any)})"
    company = has("lower(company)", [c.lower() for c in P.exclude_companies])
    return with_(
        WHOLE_STATE,
        f"""SELECT id, title, company, status FROM
        (SELECT *, lower(title) AS t, lower(title || ' ' || description) AS b FROM state)
        WHERE NOT ({company} OR {lang.excluded('t')} OR {lang.excluded('b')} OR (status = '' AND {focus}))""",
    )


ORACLES["purged_state"] = _purged()
UPDATES = f"""{WHOLE_STATE},
updates AS (SELECT r.id, doc_id AS seq, CASE WHEN toxic = 1 THEN TRUE WHEN doc_id % 7 = 0 THEN FALSE END AS hidden,
  CASE WHEN doc_id % 50 = 7 THEN 'lost' WHEN doc_id % 9 = 0 THEN '' WHEN quality = 1 THEN 'applied' END AS status
  FROM labels JOIN ranked r USING (doc_id)),
known AS (SELECT * FROM updates WHERE status IS NULL OR status <> 'lost'),
changes AS (SELECT id, arg_max(hidden, seq) FILTER (hidden IS NOT NULL) AS new_hidden,
  arg_max(status, seq) FILTER (status IS NOT NULL) AS new_status FROM known GROUP BY id)"""
ORACLES["status_update"] = with_(
    UPDATES,
    f"""SELECT id, coalesce(new_hidden, hidden) AS hidden, coalesce(new_status, status) AS status,
  {stamp(f"CASE WHEN new_status IS NULL THEN status_at WHEN new_status <> '' THEN {NOW} END")} AS status_at
FROM state LEFT JOIN changes USING (id)""",
)
ORACLES["status_rejects"] = with_(
    UPDATES,
    """SELECT id, 'unknown id' AS problem FROM changes WHERE id NOT IN (SELECT id FROM state)
UNION ALL SELECT DISTINCT id, 'unknown status' FROM updates WHERE status = 'lost'""",
)
ORACLES["listed"] = with_(
    WHOLE_STATE,
    """SELECT id, source, title, score, fit FROM state WHERE NOT hidden AND status = '' AND score >= 2 AND fit LIKE 'away%'
AND contains(lower(title || ' ' || company || ' ' || description), 'the ') ORDER BY score DESC, first_seen DESC, id""",
)
ORACLES["listed_hidden_top"] = with_(
    WHOLE_STATE,
    f"""SELECT id, source, score, status, {stamp("first_seen")} AS first_seen FROM
(SELECT * FROM state WHERE hidden AND score >= -10 ORDER BY score DESC, first_seen DESC, id LIMIT 20)""",
)
ORACLES["listed_tracked"] = with_(
    WHOLE_STATE, "SELECT id, status, score FROM state WHERE NOT hidden AND status <> '' AND score >= 0"
)
ORACLES["state_facets"] = with_(
    WHOLE_STATE,
    """SELECT DISTINCT * FROM (SELECT 'source' AS facet, source AS value FROM state
UNION ALL SELECT 'fit', split_part(fit, ' (', 1) FROM state) WHERE value <> ''""",
)
ORACLES["new_match_digest"] = with_(
    BATCH,
    """SELECT '🔍 ' || n || ' new job match(es)' || chr(10) || chr(10) || top ||
  CASE WHEN n > 10 THEN '… and ' || (n - 10) || ' more' || chr(10) ELSE '' END AS text
FROM (SELECT (SELECT count(*) FROM fresh) AS n, string_agg('• [' || score || '] ' || title || ' — ' || company || ' (' || fit || ', ' ||
    source || ')' || chr(10) || url || chr(10) || chr(10), '' ORDER BY seq) AS top
  FROM (SELECT * FROM fresh ORDER BY seq LIMIT 10)) WHERE n > 0""",
)

# ---- Budgets and enrichment ------------------------------------------------------------------------

ORACLES["budget_per_source"] = with_(
    CRAWLED,
    "SELECT source, doc_id FROM waiting QUALIFY row_number() OVER (PARTITION BY source ORDER BY seq) <= 3",
)
ORACLES["budget_large"] = with_(
    ADS, "SELECT source, doc_id FROM ads QUALIFY row_number() OVER (PARTITION BY source ORDER BY seq) <= 1500"
)
ORACLES["budget_overall"] = with_(CRAWLED, "SELECT doc_id FROM waiting ORDER BY seq LIMIT 25")
ORACLES["uncached_ads"] = with_(CRAWLED, "SELECT doc_id, raw_url AS url FROM waiting")
_limits = "CASE source " + " ".join(f"WHEN {lit(s)} THEN {k}" for s, k in q.VERIFY_LIMITS.items()) + " ELSE 0 END"
VERIFIED = f"""{CRAWLED},
picked AS (SELECT * FROM waiting WHERE {_limits} > 0
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY seq) <= {_limits}),
judged AS (SELECT p.*, coalesce(f.ok, FALSE) AS got, f.html,
    {_en.excluded('lower(p.title)')} OR {_en.excluded("lower(p.title || ' ' || f.html)")} AS is_foreign
  FROM picked p LEFT JOIN fetched f ON f.url = p.raw_url)"""
ORACLES["verify_enrich"] = with_(
    VERIFIED,
    f"""SELECT doc_id, source, CAST(length(description) AS INT) AS length, FALSE AS hidden FROM ads
  WHERE {_limits} = 0 OR doc_id NOT IN (SELECT doc_id FROM waiting)
UNION ALL SELECT doc_id, source, CAST(length(CASE WHEN is_foreign THEN description ELSE html END) AS INT), is_foreign FROM judged WHERE got""",
)
ORACLES["verify_metrics"] = with_(
    VERIFIED,
    "SELECT source, count(*) AS fetched, count(*) FILTER (got AND is_foreign) AS rejected FROM judged GROUP BY source",
)
ORACLES["verify_cache"] = with_(
    VERIFIED, f"SELECT DISTINCT raw_url AS url, {stamp(NOW)} AS crawled_at FROM judged WHERE got"
)
ORACLES["enrich_hits"] = with_(
    f"""{CRAWLED},
picked AS (SELECT doc_id, raw_url FROM waiting ORDER BY seq LIMIT {q.MAX_PAGES}),
got AS (SELECT doc_id, {truncated('page', 4000)} AS page, {truncated('page_title', 140)} AS page_title
  FROM (SELECT doc_id, {stripped('html')} AS page, page_title FROM picked JOIN fetched ON url = raw_url AND ok))""",
    """SELECT doc_id, CASE WHEN coalesce(page_title, '') <> '' THEN page_title ELSE title END AS title,
  md5(coalesce(page, description)) AS description FROM ads LEFT JOIN got USING (doc_id)""",
)
ORACLES["updated_cache"] = with_(
    CRAWLED,
    f"""SELECT url, {stamp("max(crawled_at)")} AS crawled_at FROM
(SELECT url, crawled_at FROM crawled UNION ALL SELECT url, {NOW} FROM fetched WHERE ok)
WHERE crawled_at >= {NOW} - INTERVAL 30 DAY GROUP BY url""",
)

# ---- Ingestion: what a round trip through each format must give back --------------------------------

_AT = "TIMESTAMP '2024-01-01' + to_minutes(doc_id)"
_D2000 = f"md5({truncated(squeezed('text'), 2000)})"


def ingested(name, title, company, location, url, tags, description, posted, keep="TRUE", once=True, pos="doc_id % 20"):
    dedupe = "QUALIFY row_number() OVER (PARTITION BY url ORDER BY doc_id) = 1" if once else ""
    return f"""SELECT source, title, company, location, url, tags, description, posted_at, page, pos FROM (
  SELECT doc_id, {lit(name)} AS source, {title} AS title, {company} AS company, {location} AS location, {url} AS url, {tags} AS tags,
    {description} AS description, {stamp(posted)} AS posted_at, doc_id // 20 AS page, CAST({pos} AS INT) AS pos
  FROM documents WHERE {keep} {dedupe})"""


def link(prefix: str) -> str:
    return f"{lit(prefix)} || ({KEY})"


ORACLES["json_feed"] = ingested(
    "remoteok", line(), "source", "lang", link("https://a.example.com/"), "lang", _D2000, _AT,
    keep=f"doc_id % 9 <> 0 AND {line()} <> ''", once=False, pos="doc_id % 20 + 1",
)
ORACLES["nested_json_feed"] = ingested(
    "remotive", line(), "source", "lang", link("https://b.example.com/"),
    "lang || '|' || source || CASE WHEN doc_id % 2 = 0 THEN '|full_time' ELSE '' END", _D2000,
    f"CASE WHEN doc_id % 6 <> 0 THEN {_AT} END",
)
ORACLES["rss_feed"] = ingested(
    "weworkremotely", f"trim({line()})", "source", "'Any & ' || lang", link("https://c.example.com/"), "''",
    _D2000, _AT,
)
ORACLES["thread_posts"] = f"""
SELECT 'hackernews' AS source, {truncated('header', 140)} AS title,
  {truncated("CASE WHEN strpos(header, '|') > 1 THEN trim(left(header, strpos(header, '|') - 1)) ELSE header END", 60)} AS company,
  'see post' AS location, 'https://news.ycombinator.com/item?id=' || (conv_id * 1000 + turn) AS url, '' AS tags,
  md5({truncated('t', 2000)}) AS description, CASE WHEN turn = 0 THEN '2024-02-03 04:05:06' ELSE '' END AS posted_at,
  conv_id AS page, CAST(turn AS INT) AS pos
FROM (SELECT *, CASE WHEN strlen({_HEAD}) BETWEEN 1 AND 199 THEN {_HEAD} ELSE t END AS header
  FROM (SELECT *, {squeezed(_POST)} AS t FROM conversations)) WHERE contains(lower(t), 'assistant')"""
ORACLES["thread_pick"] = (
    f"SELECT CAST(doc_id AS VARCHAR) AS thread_id, {line()} AS title FROM documents "
    f"WHERE contains(lower({line()}), 'the ') ORDER BY doc_id LIMIT 1"
)
_cats = "array_to_string(list_transform(range(1, least(doc_id % 18 + 1, 15) + 1), lambda i: 'c' || i), '|')"
_arc_tags = f"{_cats} || '|' || lang || CASE WHEN doc_id % 2 = 0 THEN '|permanent' ELSE '' END"
ORACLES["embedded_json"] = ingested(
    "arcdev", line(), "source",
    "CASE doc_id % 5 WHEN 0 THEN 'Remote, worldwide' WHEN 2 THEN 'Remote, Europe' ELSE 'Bulgaria (remote)' END",
    f"'https://arc.dev/remote-jobs/j/ad-' || ({KEY}) || '-' || doc_id", _arc_tags,
    f"md5(replace({_arc_tags}, '|', ' '))", f"CASE WHEN doc_id % 3 <> 0 THEN {_AT} END",
    keep=f"doc_id % 5 IN (0, 2, 3) AND {line()} <> ''", once=False,
)
ORACLES["jsonld_descriptions"] = f"""SELECT 'https://e.example.com/' || doc_id AS page_url, doc_id % 4 <> 0 AS found,
  md5(CASE WHEN doc_id % 4 <> 0 THEN {truncated(squeezed('text'), 3000)} ELSE '' END) AS description FROM documents"""
_hit_host = "CASE doc_id % 4 WHEN 0 THEN 'www.acme.test' ELSE 'Jobs.Acme.test:8080' END"
ORACLES["search_hits"] = ingested(
    "serper", line(), "CASE doc_id % 4 WHEN 0 THEN 'acme.test' ELSE 'Jobs.Acme.test' END", "''",
    f"'https://' || {_hit_host} || '/' || ({KEY})", "''", "md5(text)", "NULL::TIMESTAMP",
    keep="doc_id % 4 IN (0, 3) AND doc_id % 15 <> 0",
)
_lang_place = "CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END"
ORACLES["full_cards"] = ingested(
    "djinni", f"trim({line()})", "source",
    f"CASE WHEN doc_id % 2 = 0 THEN CASE WHEN doc_id % 3 = 0 THEN 'Remote' ELSE lang || ' (remote)' END ELSE {_lang_place} END",
    link("https://djinni.co/jobs/"), "lang || '|' || source",
    f"md5(CASE WHEN doc_id % 4 = 0 THEN 'cut ' || source ELSE {truncated(squeezed('text'), 3000)} END)",
    f"{_AT} - CASE WHEN {_AT} >= TIMESTAMP '2024-03-31 01:00:00' THEN INTERVAL 3 HOUR ELSE INTERVAL 2 HOUR END",
    keep=f"trim({line()}) <> ''",
)
ORACLES["title_cards"] = ingested(
    "devbg", f"trim({line()})", "source",
    "CASE doc_id % 3 WHEN 0 THEN 'Bulgaria (remote)' WHEN 1 THEN 'Bulgaria (hybrid)' ELSE 'Bulgaria' END",
    link("https://h512.com/ad/"), "''", "md5('page-' || (doc_id // 20))", "NULL::TIMESTAMP",
    keep=f"trim({line()}) <> ''",
)
_card_tags = "lang || '|' || source || '|nested'"
ORACLES["link_cards"] = ingested(
    "justjoin", f"trim({line()})", "CASE WHEN doc_id % 5 = 0 THEN '' ELSE source END",
    "CASE WHEN doc_id % 5 = 0 OR doc_id % 2 = 0 THEN 'Remote, Europe' ELSE 'Poland' END",
    link("https://d.example.com/"), _card_tags, f"md5(replace({_card_tags}, '|', ' '))", "NULL::TIMESTAMP",
    keep=f"trim({line()}) <> ''",
)
ORACLES["navigation_cards"] = """
SELECT page_id, CAST(i - 1 AS INT) AS pos, regexp_extract(item, 'href="([^"]*)"', 1) AS href, regexp_extract(item, '>([^<]*)</a>', 1) AS label
FROM (SELECT page_id, unnest(items) AS item, generate_subscripts(items, 1) AS i
  FROM (SELECT page_id, regexp_extract_all(html, '<li><a[^>]*>[^<]*</a></li>') AS items FROM pages))"""
_md_title = f"trim('t ' || replace(replace({line()}, '\"', ''), ')', ''))"
ORACLES["union_of_sources"] = f"""
SELECT 'remotive' AS source, 0 AS source_ord, count(DISTINCT {KEY}) AS ads FROM documents
UNION ALL SELECT 'serper', 1, count(DISTINCT ({_hit_host}) || ({KEY})) FROM documents WHERE doc_id % 4 IN (0, 3) AND doc_id % 15 <> 0"""
ORACLES["ingestion_report"] = f"""
WITH p AS (SELECT DISTINCT doc_id // 20 AS page FROM documents)
SELECT 'mixed' AS source, count(*) FILTER (page % 3 <> 0) AS pages_ok, count(*) FILTER (page % 3 = 0) AS pages_failed,
  (SELECT count(DISTINCT {KEY}) FROM documents WHERE doc_id // 20 % 3 <> 0) AS ads, FALSE AS failed FROM p
UNION ALL SELECT 'broken', 0, count(*), 0, TRUE FROM p"""
# A page's repeats of one number are five pages apart, so each page knows them once.
ORACLES["markdown_listing"] = ingested(
    "jobsbg", _md_title, "source", "'Bulgaria'",
    f"'https://www.jobs.bg/en/job/' || (({KEY}) + 1000)", "lang || '|s' || (doc_id % 3)",
    "md5(lang || ' s' || (doc_id % 3))", "NULL::TIMESTAMP", pos="(doc_id % 20) * 4 + 2",
)


def _streamed() -> str:
    cte = cascade().replace("coalesce(r_name, '') AS location", "'' AS location")
    return with_(
        cte,
        f"""SELECT {short_sha("l.source || '|' || l.url")} AS id, l.source, l.title, l.company, l.url, l.score, l.fit, l.tags,
  CAST(length(l.description) AS INT) AS length, FALSE AS hidden, '' AS status
FROM (SELECT * FROM evaluated WHERE reject_reason = '' QUALIFY row_number() OVER (PARTITION BY source, url ORDER BY seq DESC) = 1) l""",
    )


ORACLES["stream_merge"] = ORACLES["stream_two_sources"] = _streamed()
ORACLES["stream_replay"] = ORACLES["state_two_writers"] = ORACLES["stream_merge"]
ORACLES["first_sightings"] = with_(
    ADS, f"""SELECT DISTINCT {short_sha("source || '|' || url")} AS id, source, url FROM ads"""
)
ORACLES["keyed_state"] = f"""
WITH e AS (SELECT CAST(user_id AS VARCHAR) AS id, ts, event_type = 'error' AS hidden,
  CASE event_type WHEN 'purchase' THEN 'applied' WHEN 'signup' THEN '' END AS status FROM events),
firsts AS (SELECT id, min(ts) AS first_seen, max(ts) AS last_seen, bool_or(hidden) AS hidden FROM e GROUP BY id),
told AS (SELECT id, status FROM e WHERE status IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts DESC, status DESC) = 1),
early AS (SELECT e.id, bool_or(e.hidden) AS hidden FROM e JOIN firsts f ON e.id = f.id AND e.ts = f.first_seen GROUP BY e.id)
SELECT f.id, {stamp("first_seen")} AS first_seen, {stamp("last_seen")} AS last_seen, f.hidden, coalesce(status, '') AS status,
  NOT early.hidden AS fresh FROM firsts f JOIN early USING (id) LEFT JOIN told USING (id)"""
ORACLES["thread_json"] = ORACLES["thread_posts"].replace("CAST(turn AS INT) AS pos", "CAST(turn % 20 AS INT) AS pos")
ORACLES["thread_search_json"] = f"""SELECT CAST(doc_id AS VARCHAR) AS thread_id, {line()} AS title, doc_id // 20 AS page,
  CAST(doc_id % 20 AS INT) AS pos FROM documents WHERE contains(lower({line()}), 'the ')"""
ORACLES["exported_list"] = ORACLES["listed"]
ORACLES["purged_at_start"] = ORACLES["purged_state"]
ORACLES["purge_count"] = with_(
    WHOLE_STATE, f"SELECT (SELECT count(*) FROM state) - count(*) AS removed FROM ({ORACLES['purged_state']})"
)
ORACLES["page_results_read"] = f"""
WITH f AS (SELECT 'https://jobs.example.com/ad/' || k || '?id=' || k || '&utm_source=' || page_id AS url, page_id % 7 <> 0 AS success,
  md5(html) AS markdown, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, '' AS error
  FROM (SELECT *, CASE WHEN page_id % 100 >= 80 THEN page_id - 20 ELSE page_id END AS k FROM pages))
SELECT unnest(['file', 'response']) AS kind, f.* FROM f"""
ORACLES["legacy_state"] = with_(
    WHOLE_STATE,
    f"""SELECT {_COLS}, {stamp("first_seen")} AS first_seen, {stamp("last_seen")} AS last_seen, hidden, status,
  {stamp("status_at")} AS status_at FROM state""",
)
ORACLES["reopened_state"] = with_(WHOLE_STATE, "SELECT id, count(*) AS n FROM state GROUP BY id")
