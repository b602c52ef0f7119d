"""The reject cascade and scoring, as layered projections over one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from listsieve.functions import lexicon as lx
from listsieve.functions import match as m
from listsieve.functions.language import LanguageRule, language_excluded
from listsieve.functions.text import fold, haystack
from listsieve.profile import Profile
from listsieve.schema import settle

REJECT_REASONS = ["title", "company", "language", "focus", "geography", "score"]


def evaluate(ads: DataFrame, profile: Profile, lexicon: lx.Lexicon = lx.DEFAULT_LEXICON) -> DataFrame:
    """Add ``score, reasons, fit, keep, reject_reason`` to every ad.

    Each layer decides one step and the next layer runs its own expressions only
    for rows still undecided, so a row rejected by its title never has its text
    searched. All of it is one narrow stage: no shuffle, no Python.
    """
    profile.checked(lexicon)
    rule = LanguageRule(profile.languages, lexicon)
    title, text, hay, why = F.col("__title"), F.col("__text"), F.col("__hay"), F.col("__why")
    both = F.concat(title, F.lit(" "), text)

    def undecided(value: Column) -> Column:
        return F.when(why.isNull(), value)

    df = ads.withColumns(
        {
            "__title": fold("title"),
            "__low": F.lower("description"),
            "__place": m.place_text("location", "title"),
            "__hay": F.replace(haystack("title", "tags", "description"), F.lit("ſ"), F.lit("s")),
        }
    )
    df = df.withColumn("__text", F.replace("__low", F.lit("ſ"), F.lit("s")))
    df = df.withColumn(
        "__why",
        F.when(m.title_excluded(title, profile.exclude), "title").when(
            m.company_excluded("company", profile.exclude_companies), "company"
        ),
    )
    if not rule.off:
        df = df.withColumn("__tv", undecided(rule.votes(title)))
        df = df.withColumn("__bv", undecided(rule.votes(both)))
        foreign = rule.verdict(title, F.col("__tv")) | rule.verdict(both, F.col("__bv"))
        df = df.withColumn("__why", F.coalesce(why, F.when(undecided(foreign), "language")))
    df = df.withColumn(
        "__why", F.coalesce(why, F.when(undecided(m.focus_excluded(title, hay, profile)), "focus"))
    )
    df = df.withColumn(
        "__geo", undecided(m.geo_verdict(F.col("__place"), F.col("__low"), profile.geography))
    )
    df = df.withColumn("__why", F.coalesce(why, F.when(~F.col("__geo.ok"), "geography")))
    df = df.withColumn("__hits", undecided(m.hits(title, hay, profile)))
    hits = F.col("__hits")
    df = df.withColumn("__score", F.coalesce(undecided(m.total_score(hits, profile)), F.lit(0)))
    reason = F.coalesce(why, F.when(F.col("__score") < F.lit(profile.min_score), "score"))
    none = F.array().cast("array<string>")
    df = settle(
        df,
        {
            "score": F.col("__score").cast("int"),
            "reasons": F.coalesce(undecided(m.reasons(hits, profile)), none),
            "fit": F.coalesce(undecided(F.col("__geo.fit")), F.lit("")),
            "keep": reason.isNull(),
            "reject_reason": reason,
        },
    )
    return df.drop(*[c for c in df.columns if c.startswith("__")])


def matched(evaluated: DataFrame) -> DataFrame:
    """The ads to keep, in the shape the state merge takes."""
    return evaluated.filter("keep").drop("keep", "reject_reason")


def without_rejected(evaluated: DataFrame) -> DataFrame:
    """The evaluated rows as they are stored: rejected ones are only counted from here on, so of
    them nothing but source and verdict is kept."""
    counted = ("source", "keep", "reject_reason")
    texts = [c for c in evaluated.columns if c not in counted]
    return evaluated.withColumns({c: F.when(F.col("keep"), F.col(c)) for c in texts})


def language_votes(
    df: DataFrame, text: str, keep, lexicon: lx.Lexicon = lx.DEFAULT_LEXICON
) -> DataFrame:
    """Add the vote counts of one text column and its verdict."""
    rule = LanguageRule(keep, lexicon)
    df = df.withColumn("__folded", fold(text))
    df = df.withColumn("__votes", rule.votes(F.col("__folded")))
    votes = F.col("__votes")
    return settle(
        df,
        {
            "kept_votes": votes["kept"],
            "foreign_votes": votes["foreign"],
            "excluded": rule.verdict(F.col("__folded"), votes),
        },
    ).drop("__folded", "__votes")


def purge_predicate(profile: Profile, lexicon: lx.Lexicon = lx.DEFAULT_LEXICON) -> Column:
    """Stored rows the current profile no longer wants; tracking only shields
    from the focus rule."""
    hay = F.replace(haystack("title", "tags", "description"), F.lit("ſ"), F.lit("s"))
    return (
        m.company_excluded("company", profile.exclude_companies)
        | (~m.tracked() & m.focus_excluded(fold("title"), hay, profile))
        | language_excluded("title", "description", profile.languages, lexicon)
    )


def purge(
    state: DataFrame,
    profile: Profile,
    lexicon: lx.Lexicon = lx.DEFAULT_LEXICON,
    observation: Observation | None = None,
) -> DataFrame:
    """State without the rows ``purge_predicate`` drops.

    Given an observation, the number removed is known once the result has been
    written, at no extra pass.
    """
    profile.checked(lexicon)
    state = settle(state, {"__drop": purge_predicate(profile, lexicon)})
    if observation is not None:
        state = state.observe(observation, F.count_if("__drop").alias("removed"))
    return state.filter(~F.col("__drop")).drop("__drop")


def reject_funnel(evaluated: DataFrame) -> DataFrame:
    """Rows per source and outcome, with the totals per source and overall."""
    return (
        evaluated.withColumn("outcome", F.coalesce("reject_reason", F.lit("kept")))
        .rollup("source", "outcome")
        .agg(F.count(F.lit(1)).alias("ads"))
        .select(
            F.coalesce("source", F.lit("*")).alias("source"),
            F.coalesce("outcome", F.lit("*")).alias("outcome"),
            "ads",
        )
    )


def run_metrics(evaluated: DataFrame, fresh: DataFrame | None = None) -> DataFrame:
    """Fetched, matched and, given the fresh rows, new ads per source."""
    per_source = evaluated.groupBy("source").agg(
        F.count(F.lit(1)).alias("fetched"), F.count_if("keep").alias("matched")
    )
    if fresh is None:
        return per_source
    # One row per source on both sides.
    new = fresh.groupBy("source").agg(F.count(F.lit(1)).alias("new"))
    return per_source.join(new, "source", "left").withColumn("new", F.coalesce("new", F.lit(0)))
