"""Secret scans over a trigram inverted index.

From each rule's regex a Boolean query over trigrams is derived that every text with a match
satisfies. The index holds, for each trigram that some query asks for, the texts that have
it. A rule's candidates come from its query over the postings, and only they are searched with the
regex; a rule without a mandatory trigram searches every text. DataFrame functions only.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listsieve.llm.tables import stored

#: A trigram, True (any text), or ("and" | "or", parts).
Query = str | bool | tuple

#: Alternatives that a stretch of a pattern is followed through as plain strings.
MAX_STRINGS = 32


@dataclass(frozen=True)
class Rule:
    """``pattern``: a regex that Java and Python read alike. A match counts if its ``group``
    has ``least`` characters; matches follow each other from left to right either way."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The three kinds whose spans are also reported apart.
BASE_RULES = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        12,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
_KEY = r"[A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
#: A private key with its body: to its end line, which no other such line comes before; where that
#: is missing, to the end of the base64 lines. A body has few hyphens; the bounded count keeps
#: Java's regex from recursing with the text.
PRIVATE = (
    rf"-----BEGIN {_KEY}(?:[^-]*(?:-{{1,4}}[^-]+){{0,200}}-{{5,}}END {_KEY}"
    r"|(?:[\r\n]+[A-Za-z0-9-]+:[^\r\n]*){0,8}[A-Za-z0-9+/=>\\\x20\t\r\n]*[A-Za-z0-9+/=]{16}(?:\r?\n[A-Za-z0-9+/]{1,63}={0,2})?)?"
)
MORE_RULES = (
    Rule("forge", r"gh[opusr]_[A-Za-z0-9]{36,}"),
    Rule("lab", r"glpat-[A-Za-z0-9_-]{20,}"),
    Rule("chat", r"xox[abposr]-[A-Za-z0-9-]{10,}"),
    Rule("maps", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("package", r"npm_[A-Za-z0-9]{36}"),
    Rule("signed", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private", PRIVATE),
    Rule("bearer", r"[Bb]earer\x20+[A-Za-z0-9._~+/=-]{20,}"),
    Rule("login", r"[a-z]{3,12}://[A-Za-z0-9._-]{1,64}:[^\s@/:]{3,64}@[A-Za-z0-9.-]+"),
)
RULES = BASE_RULES + MORE_RULES


# --- from a regex to a trigram query -------------------------------------------------------


def trigram_query(pattern: str) -> Query:
    """What a lower-cased text must contain for the pattern to match in it."""
    return _require(_walk(sre_parser.parse(pattern)))


def _grams(text: str) -> Query:
    return _all([text[i : i + 3] for i in range(len(text) - 2)])


def _all(parts: Sequence[Query]) -> Query:
    flat = dict.fromkeys(p for p in parts if p is not True)
    return True if not flat else next(iter(flat)) if len(flat) == 1 else ("and", tuple(flat))


def _any(parts: Sequence[Query]) -> Query:
    if not parts or True in parts:
        return True
    flat = dict.fromkeys(p for p in parts if not any(_implied(p, q) for q in parts))
    return next(iter(flat)) if len(flat) == 1 else ("or", tuple(flat))


def _implied(part: Query, by: Query) -> bool:
    """Whether ``part`` demands all that ``by`` does and more, both plain conjunctions."""
    wide, narrow = (set(q[1]) if isinstance(q, tuple) and q[0] == "and" else {q} for q in (part, by))
    return narrow < wide


def _require(part: tuple[set[str] | None, Query]) -> Query:
    """``part``: all strings it can be (None: too many), and what it demands besides."""
    strings, query = part
    return _all([query, _any([_grams(s) for s in sorted(strings)])]) if strings else query


def _walk(nodes) -> tuple[set[str] | None, Query]:
    strings: set[str] | None = {""}
    demands: list[Query] = []
    whole = True
    for op, arg in nodes:
        own, query = _node(op, arg)
        demands.append(query)
        if own is not None and strings is not None and len(joined := {a + b for a in strings for b in own}) <= MAX_STRINGS:
            strings = joined
            continue
        whole = False
        demands.append(_require((strings, True)))
        strings = own if own is not None else {""}
    if whole:
        return strings, _all(demands)
    return None, _all([*demands, _require((strings, True))])


def _node(op, arg) -> tuple[set[str] | None, Query]:
    if op is sre.LITERAL:
        return {chr(arg).lower()}, True
    if op is sre.IN:
        members: set[str] = set()
        for kind, value in arg:
            if kind is sre.LITERAL:
                members.add(chr(value).lower())
            elif kind is sre.RANGE and value[1] - value[0] < MAX_STRINGS:
                members |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None, True
        return (members, True) if len(members) <= 8 else (None, True)
    if op is sre.SUBPATTERN:
        return _walk(arg[-1])
    if op is sre.BRANCH:
        parts = [_walk(b) for b in arg[1]]
        if all(p[0] is not None and p[1] is True for p in parts):
            return set().union(*(p[0] for p in parts)), True
        return None, _any([_require(p) for p in parts])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, body = arg
        own, query = _walk(body)
        if own is not None and (low, high) == (0, 1):
            return own | {""}, True
        if own is not None and low == high and low <= 8:
            strings = {""}
            for _ in range(low):
                strings = {a + b for a in strings for b in own}
                if len(strings) > MAX_STRINGS:
                    return None, query if low else True
            return strings, query if low else True
        return None, _require((own, query)) if low else True
    return None, True


def trigrams_of(query: Query) -> set[str]:
    if isinstance(query, str):
        return {query}
    return set().union(*map(trigrams_of, query[1])) if isinstance(query, tuple) else set()


def holds(query: Query, postings: Column) -> Column:
    """Whether the trigrams of a text satisfy a query."""
    if isinstance(query, str):
        return F.array_contains(postings, query)
    if query is True:
        return F.lit(True)
    parts = [holds(q, postings) for q in query[1]]
    return reduce(Column.__and__ if query[0] == "and" else Column.__or__, parts)


# --- index, candidates, verification ---------------------------------------------------------


def build_index(texts: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(trigram, key) of ``texts`` (key, text), for the trigrams that the rules ask for."""
    asked = sorted(set().union(*(trigrams_of(trigram_query(r.pattern)) for r in rules)))
    low = texts.select("key", F.lower("text").alias("low"))
    present = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in asked]))
    return low.select("key", F.explode(present).alias("trigram"))


def candidates(index: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(key, kinds): for each text the rules, among those with a query, that it may match.

    A key's postings meet in one row of at most as many trigrams as the queries have.
    """
    postings = index.groupBy("key").agg(F.collect_set("trigram").alias("trigrams"))
    maybe = [
        F.when(holds(query, F.col("trigrams")), F.lit(rule.kind))
        for rule in rules
        if (query := trigram_query(rule.pattern)) is not True
    ]
    if not maybe:
        maybe = [F.lit(None).cast("string")]
    kinds = F.array_compact(F.array(*maybe))
    return postings.select("key", kinds.alias("kinds")).where(F.size("kinds") > 0)


SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"


def rule_spans(text: Column, rule: Rule, rank: int) -> Column:
    r"""Spans of a rule's matches in a text, by code points, end excluded.

    The regex ``\G(anything, as little as possible)(match)`` steps from match to match, so the
    lengths of both groups sum up to the places. ``\G`` keeps the way behind the last match short.
    """
    stepping = rf"\G(?s:(.*?))({rule.pattern})"
    gaps = F.regexp_extract_all(text, F.lit(stepping), F.lit(1))
    found = F.regexp_extract_all(text, F.lit(stepping), F.lit(2))
    tested = F.regexp_extract_all(text, F.lit(stepping), F.lit(rule.group + 2))
    steps = F.zip_with(
        F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("size"))),
        tested,
        lambda s, t: F.struct(s["gap"].alias("gap"), s["size"].alias("size"), F.length(t).alias("tested")),
    )
    nothing = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPAN).alias("spans"))

    def spans_of(some: Column, at: Column) -> Column:
        """Spans of a block of steps that begins at a place."""

        def step(state: Column, s: Column) -> Column:
            start = state["at"] + s["gap"]
            end = start + s["size"]
            span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"))
            kept = F.when(s["tested"] >= rule.least, F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
            return F.struct(end.alias("at"), kept.alias("spans"))

        first = F.struct(at.alias("at"), nothing["spans"].alias("spans"))
        return F.aggregate(some, first, step, lambda state: state["spans"])

    def whole(steps: Column) -> Column:
        cut = blocks(steps)
        totals = F.transform(cut, lambda b: F.aggregate(b, F.lit(0).cast("bigint"), lambda n, s: n + s["gap"] + s["size"]))
        return bound([cut, before(totals, lambda x, y: x + y)], lambda v: F.flatten(F.zip_with(v[0], v[1], spans_of)))

    return bound([steps], lambda v: whole(v[0]))


def bound(values: Sequence[Column], use) -> Column:
    """``use`` of some values, each of them computed once."""
    named = F.struct(*(v.alias(f"v{i}") for i, v in enumerate(values)))
    return F.get(F.transform(F.array(named), lambda s: use([s[f"v{i}"] for i in range(len(values))])), F.lit(0))


def blocks(items: Column) -> Column:
    """An array as blocks of about the square root of its size, so that what is linear in a block
    or in the blocks, but not in both, adds up to little."""
    width = F.greatest(F.ceil(F.sqrt(F.size(items))), F.lit(1)).cast("int")
    starts = F.when(F.size(items) > 0, F.sequence(F.lit(1), F.size(items), width)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(items, i, width))


def before(totals: Column, add) -> Column:
    """What the totals of the blocks before each one add up to, from 0 on."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("all"))

    def step(state: Column, n: Column) -> Column:
        return F.struct(add(state["at"], n).alias("at"), F.concat(state["all"], F.array(state["at"])).alias("all"))

    return F.aggregate(totals, start, step, lambda state: state["all"])


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``docs`` with ``secret_spans``: all spans of all rules, by start, then rule, then end.

    A null text has none. Texts are keyed by doc_id (a null one by its text's hash): rows that
    share a key share candidates, which are a superset, so repeated ids and rows are safe.
    Every other column is handed on; one of the name ``secret_spans`` is replaced.
    """
    kept = docs.drop(*[c for c in docs.columns if c.lower() in ("secret_spans", "_key", "_kinds")])
    own = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))
    keyed = kept.withColumn("_key", own)
    index = stored(build_index(keyed.select(F.col("_key").alias("key"), "text"), rules), "trigram-index")
    maybe = candidates(index, rules).select(F.col("key").alias("_key"), F.col("kinds").alias("_kinds"))
    rows = keyed.join(maybe.hint("shuffle_hash"), "_key", "left")
    found = []
    for rank, rule in enumerate(rules):
        due = F.col("text").rlike(first_test(rule))
        if trigram_query(rule.pattern) is not True:
            due = F.array_contains("_kinds", rule.kind) & due
        found.append(
            F.when(F.coalesce(due, F.lit(False)), rule_spans(F.col("text"), rule, rank)).otherwise(F.array().cast(SPAN))
        )
    spans = F.array_sort(F.concat(*found))
    return rows.select(*[F.col(f"`{c}`") for c in kept.columns], spans.alias("secret_spans"))


def first_test(rule: Rule) -> str:
    """A regex that finds out whether the rule has any span worth stepping to.

    Where the tested group is the whole match and one greedy run, its length goes into the test.
    """
    if rule.group == 0 and rule.least and rule.pattern.endswith("+"):
        head = rule.pattern[:-1]
        fixed = len(re_prefix(head))
        return f"{head}{{{rule.least - fixed},}}"
    return rule.pattern


def re_prefix(head: str) -> str:
    """The plain characters before the class that a pattern ends with."""
    return head[: head.index("[")]


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind))


def joined(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every stretch that spans cover replaced by ``mark``.

    Blocks of spans are cut out of the text first, and stretches out of them, as a place in a
    text is found by counting its characters from the start.
    """
    long = "bigint"

    def reach(some: Column) -> Column:
        return F.aggregate(some, F.lit(0).cast(long), lambda n, s: F.greatest(n, s["end"]))

    def part(some: Column, at: Column) -> Column:
        """A block's stretch from what the blocks before reach, spans blacked out."""
        stop = F.greatest(at, reach(some))

        def pieces(own: Column) -> Column:
            start = F.struct(at.alias("at"), F.array().cast("array<string>").alias("done"))

            def step(state: Column, s: Column) -> Column:
                size = F.greatest(s["start"] - state["at"], F.lit(0))
                gap = F.substring(own, (state["at"] - at + 1).cast("int"), size.cast("int"))
                fresh = F.concat(state["done"], F.array(F.concat(gap, F.lit(mark))))
                return F.struct(
                    F.greatest(state["at"], s["end"]).alias("at"),
                    F.when(s["start"] >= state["at"], fresh).otherwise(state["done"]).alias("done"),
                )

            return F.array_join(F.aggregate(some, start, step, lambda state: state["done"]), "")

        return bound([F.substring(text, (at + 1).cast("int"), (stop - at).cast("int"))], lambda v: pieces(v[0]))

    def whole(cut: Column) -> Column:
        rest = F.substring(text, (reach(spans) + 1).cast("int"), F.lit(2147483647))
        starts = before(F.transform(cut, reach), F.greatest)
        return bound([starts], lambda v: F.concat(F.array_join(F.zip_with(cut, v[0], part), ""), rest))

    return F.when(F.size(spans) > 0, bound([blocks(spans)], lambda v: whole(v[0]))).otherwise(text)
