"""Discussion threads whose first-level replies are listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listsieve.functions import dates
from listsieve.functions.text import post_header, strip_html, truncate
from listsieve.schema import settle
from listsieve.sources.raw import finish, is_bad, parse_json

# ---- Fixed values -----------------------------------------------------------
THREAD_SEARCH = "hits array<struct<objectID: string, title: string>>"
THREAD = (
    "id bigint, text string, created_at string, "
    "children array<struct<id: bigint, text: string, created_at: string>>"
)
THREAD_PHRASE = "who is hiring"
POST_URL = "https://news.ycombinator.com/item?id="
POST_LOCATION = "see post"
TITLE_BYTES, COMPANY_BYTES, TEXT_BYTES = 140, 60, 2000
# -----------------------------------------------------------------------------


def search_hits(raw: DataFrame) -> DataFrame:
    """``(thread_id, title, seq)`` out of thread search responses."""
    parsed = raw.withColumn("r", parse_json("body", THREAD_SEARCH)).filter(~is_bad("r"))
    return parsed.select("page_url", "seq", F.posexplode("r.hits")).select(
        F.col("col.objectID").alias("thread_id"),
        F.coalesce("col.title", F.lit("")).alias("title"),
        F.struct("seq", "page_url", "pos").alias("seq"),
    )


def pick_thread(hits: DataFrame, phrase: str = THREAD_PHRASE, order: str = "seq") -> DataFrame:
    """The first hit whose title has the phrase: one row, or none."""
    return hits.filter(F.contains(F.lower("title"), F.lit(phrase))).orderBy(order).limit(1)


def require_thread(hits: DataFrame, phrase: str = THREAD_PHRASE, order: str = "seq") -> str:
    """The picked thread's id; an error when there is none."""
    row = pick_thread(hits, phrase, order).first()
    if row is None:
        raise LookupError(f"no {phrase!r} thread found")
    return row["thread_id"]


def thread_posts(raw: DataFrame) -> DataFrame:
    """First-level replies ``(post_id, text, created_at)`` of raw thread JSON."""
    parsed = raw.withColumn("r", parse_json("body", THREAD)).filter(~is_bad("r"))
    return parsed.select("page_url", "seq", F.posexplode("r.children")).select(
        "page_url",
        "seq",
        "pos",
        F.col("col.id").alias("post_id"),
        F.coalesce("col.text", F.lit("")).alias("text"),
        F.col("col.created_at").alias("created_at"),
    )


def thread_pages(raw: DataFrame, name: str = "hackernews") -> DataFrame:
    """(source, page_url, ok) of raw thread JSON."""
    parsed = raw.withColumn("r", parse_json("body", THREAD))
    return parsed.select(F.lit(name).alias("source"), "page_url", (~is_bad("r")).alias("ok"))


def posts_to_ads(
    posts: DataFrame,
    require: str = "",
    name: str = "hackernews",
    url_prefix: str = POST_URL,
    max_bytes: int | None = TEXT_BYTES,
) -> DataFrame:
    """Posts to ads: plain text, non-empty, holding ``require``, split by header. At most
    ``max_bytes`` of a text are kept; None: all."""
    plain = settle(posts, {"plain": strip_html("text")})
    kept = plain.filter(
        (F.col("plain") != "") & F.contains(F.lower("plain"), F.lit(require.lower()))
    )
    header, company = post_header("plain")
    return finish(
        kept,
        name,
        {
            "title": truncate(header, TITLE_BYTES),
            "company": truncate(company, COMPANY_BYTES),
            "location": F.lit(POST_LOCATION),
            "url": F.concat(F.lit(url_prefix), F.col("post_id").cast("string")),
            "description": truncate("plain", max_bytes),
            "posted_at": dates.parse_rfc3339(F.col("created_at")),
        },
    )


def thread_to_ads(
    raw: DataFrame, require: str = "", name: str = "hackernews", max_bytes: int | None = TEXT_BYTES
) -> DataFrame:
    """Raw thread JSON to ads."""
    return posts_to_ads(thread_posts(raw), require, name, max_bytes=max_bytes)
