"""Scoring against a large term table by joining tokens instead of regexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listsieve.functions.text import fold
from listsieve.operators.lookup import salted_join

#: A term table up to this many rows and bytes is broadcast; beyond it tokens meet terms by shuffle.
BROADCAST_TERMS, BROADCAST_BYTES = 200_000, 32 << 20

_TOKEN = "[a-z0-9]+"


def _pieces(text: Column) -> tuple[Column, Column]:
    """The tokens of a folded text, and what stands before, between and after them."""
    return F.regexp_extract_all(text, F.lit(f"({_TOKEN})"), F.lit(1)), F.split(text, _TOKEN, -1)


def _windows(text: Column, size: int) -> Column:
    """All stretches of that many characters, overlapping ones too."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))


def score_token_join(
    ads: DataFrame,
    terms: DataFrame,
    key: str = "id",
    text: str = "text",
    broadcast_terms: int = BROADCAST_TERMS,
) -> DataFrame:
    """``(key, score, reasons)`` for ads with at least one matching term.

    ``terms`` has ``ord, term, weight``, with ``ord`` unique. A term stands in a text where neither
    neighbour is an ASCII letter or digit. A text is taken apart once into tokens and what is
    between them, and gives every run of as many adjacent tokens as some term has; a term's run
    equals one of those. Marks before or after a term's run are compared with those beside the
    text's run. A term without ASCII letters and digits equals a stretch of its length between two
    tokens. So a term is decided where its run is met, and texts are not shuffled. ``key`` must be
    unique. The term table is counted first: a small one is broadcast, a larger one meets the runs
    in a shuffle salted against frequent words.
    """
    term = fold("term")
    tokens, marks = _pieces(term)
    terms = terms.select(
        F.size(tokens).alias("tokens"),
        F.element_at(marks, 1).alias("lead"),
        F.when(F.size(tokens) > 0, F.element_at(marks, -1)).otherwise("").alias("tail"),
        term.alias("whole"),
        F.struct(
            F.col("ord"),
            F.col("term").alias("reason"),
            F.when(F.col("weight") == 0, 1).otherwise(F.col("weight")).cast("int").alias("weight"),
        ).alias("hit"),
    ).filter(F.col("whole") != "")
    bare = F.col("tokens") == 0
    terms = terms.withColumn("lead", F.when(bare, "").otherwise(F.col("lead")))
    inside = F.length("whole") - F.length("lead") - F.length("tail")
    terms = terms.withColumn("run", F.col("whole").substr(F.length("lead") + 1, inside))
    edged = (F.col("lead") != "") | (F.col("tail") != "")
    rows, size, runs, marked, stretches = terms.agg(
        F.count(F.lit(1)),
        F.sum(F.octet_length("whole")),
        F.collect_set(F.when(~bare & ~edged, F.col("tokens"))),
        F.collect_set(F.when(edged, F.col("tokens"))),
        F.collect_set(F.when(bare, F.length("whole"))),
    ).first()  # a number for each length that occurs

    hay = ads.select(F.col(key), fold(text).alias("__hay"))
    tokens, marks = _pieces(F.col("__hay"))
    hay = hay.select(key, tokens.alias("t"), marks.alias("m"))
    few = rows <= broadcast_terms and (size or 0) <= BROADCAST_BYTES

    def met(given: DataFrame, some: DataFrame) -> DataFrame:
        if few:
            return given.join(F.broadcast(some), "run")
        return salted_join(given, some, ["run"], "inner", spread=[key])

    def run(i: Column, n: int) -> Column:
        """``n`` tokens from the i-th on (from 1), with what is between them."""
        parts = [F.get("t", i - 1)]
        for j in range(1, n):
            parts += [F.get("m", i + (j - 1)), F.get("t", i + (j - 1))]
        return F.concat(*parts)

    def starts(n: int) -> Column:
        return F.when(F.size("t") >= n, F.sequence(F.lit(1), F.size("t") - (n - 1))).otherwise(F.array().cast("array<int>"))

    def runs_of(n: int) -> Column:
        return F.transform(starts(n), lambda i: run(i, n))

    def runs_beside_marks(n: int) -> Column:
        def beside(i: Column) -> tuple[Column, Column]:
            return F.get("e", i - 1), F.get("e", i + (n - 1))

        near = F.filter(starts(n), lambda i: (F.length(beside(i)[0]) > 1) | (F.length(beside(i)[1]) > 1))
        return F.transform(near, lambda i: F.struct(run(i, n).alias("run"), beside(i)[0].alias("before"), beside(i)[1].alias("after")))

    def stretches_of(n: int) -> Column:
        return F.flatten(F.transform(F.array_distinct(gaps), lambda g: _windows(g, n)))

    found = []
    # between two tokens, the characters beside them are no neighbours that a term may have
    last = F.size("m")
    gaps = F.transform(
        "m",
        lambda m, i: m.substr(
            F.when(i > 0, 2).otherwise(1), F.greatest(F.length(m) - F.when(i > 0, 1).otherwise(0) - F.when(i < last - 1, 1).otherwise(0), F.lit(0))
        ),
    )
    plain = [*map(runs_of, sorted(runs)), *map(stretches_of, sorted(stretches))]
    if plain:
        every = hay.select(key, F.explode(F.array_distinct(F.concat(*plain))).alias("run"))
        found.append(met(every, terms.filter(~edged)))
    if marked:
        # a mark at the text's very end has no neighbour: a blank stands for it
        ends = F.transform(
            "m", lambda m, i: F.concat(F.when(i == 0, " ").otherwise(""), m, F.when(i == last - 1, " ").otherwise(""))
        )
        hay = hay.withColumn("e", ends)
        every = hay.select(key, F.inline(F.concat(*map(runs_beside_marks, sorted(marked)))))
        found.append(
            met(every, terms.filter(edged))
            .filter((F.col("lead") == "") | (F.endswith("before", "lead") & (F.length("before") > F.length("lead"))))
            .filter((F.col("tail") == "") | (F.startswith("after", "tail") & (F.length("after") > F.length("tail"))))
            .drop("before", "after")
        )
    if not found:
        return ads.limit(0).select(key, F.lit(0).alias("score"), F.array().cast("array<string>").alias("reasons"))
    hits = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    # A repeated word is one hit; what is collected per ad is bounded by the term table.
    found = hits.groupBy(key).agg(F.array_sort(F.collect_set("hit")).alias("hits"))
    total = F.aggregate("hits", F.lit(0), lambda total, h: total + h["weight"])
    return found.select(key, total.alias("score"), F.col("hits.reason").alias("reasons"))
