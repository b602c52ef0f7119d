"""Listing cards on HTML pages, described by what to select inside a card."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listsieve.functions import dates, urls
from listsieve.functions.text import (
    badge_to_location,
    cap_array,
    junk_tag,
    once,
    remote_suffix,
    strip_html,
    trim_space,
    truncate,
)
from listsieve.operators.dedupe import first_wins
from listsieve.sources import html_nodes as h
from listsieve.sources.raw import finish, present

# ---- Fixed values: what the three kinds of card look like ---------------------
FULL_CARD = ("div", "job-item")
FULL_BASE = "https://djinni.co"
FULL_DESCRIPTION_BYTES = 3000
TITLE_CARD = ("div", "job-list-item")
TITLE_ORIGIN, TITLE_MIRROR = "https://dev.bg/", "https://h512.com/"
TITLE_PLACE = "Bulgaria"
LINK_CARD = ("a", "offer_list_offer_title_link")
LINK_REMOTE, LINK_PLACE = "Remote, Europe", "Poland"
MAX_CLIMB = 4
MAX_TAGS = 15
MAX_TAG_BYTES = 20
# --------------------------------------------------------------------------------

Fields = Callable[[Column], dict[str, Column]]


def cards(raw: DataFrame, tag: str, css: str) -> DataFrame:
    """One row per card with its own nodes in ``card``, its page's in ``nodes``.

    Only the card's slice of the page travels with it, unless ``nodes`` is used.
    """
    pages = raw.select("page_url", "seq", h.html_nodes("body").alias("nodes"))
    found = F.filter("nodes", lambda n: h.is_a(n, tag, css))
    return pages.select("page_url", "seq", "nodes", F.posexplode(found)).withColumn(
        "card", h.subtree(F.col("nodes"), F.col("col"))
    )


def extract_cards(raw: DataFrame, name: str, tag: str, css: str, fields: Fields) -> DataFrame:
    """Cards to ads: ``fields`` maps a card's nodes to the ad's columns. Cards
    without link or title are dropped, and so are repeated links."""
    found = cards(raw, tag, css).select("page_url", "seq", "pos", "card")
    return first_wins(present(finish(found, name, fields(F.col("card")))))


def _text(card: Column, tag: str = "", css: str = "", within=None) -> Column:
    return trim_space(h.text_of(card, h.first(h.find(card, tag, css, within))))


def _texts(card: Column, found: Column) -> Column:
    """The non-empty texts of the found nodes."""
    texts = F.transform(found, lambda n: trim_space(h.text_of(card, n)))
    return F.filter(texts, lambda t: t != "")


def full_card(card: Column, max_tags: int | None = MAX_TAGS) -> dict[str, Column]:
    """The whole ad is in the card, collapsed; a cut copy is shown."""
    whole = h.text_of(card, h.first(h.find(card, css="js-original-text")))
    cut = h.text_of(card, h.first(h.find(card, css="js-truncated-text")))
    description = once(whole, lambda text: F.when(trim_space(text) == "", cut).otherwise(text))
    place = _text(card, css="location-text")
    badges = h.find(card, css="badge", within=("", "job-item__tags"))
    stamps = F.filter(
        F.transform(h.find(card, "span"), lambda n: h.attr(n, "title")), dates.is_card_stamp
    )
    link = h.attr(h.first(h.find(card, "a", "job_item__header-link")), "href")
    return {
        "title": _text(card, "h2", "job-item__position"),
        "company": _text(card, "span", "small", within=("header", "")),
        "location": remote_suffix(place, h.text_of(card, F.element_at(card, 1))),
        "url": urls.absolute_url(link, FULL_BASE),
        "tags": F.array_distinct(cap_array(_texts(card, badges), max_tags)),
        "description": description,
        "posted_at": dates.parse_card_stamp(h.first(stamps)),
    }


def read_full_cards(
    raw: DataFrame,
    name: str = "djinni",
    max_bytes: int | None = FULL_DESCRIPTION_BYTES,
    max_tags: int | None = MAX_TAGS,
) -> DataFrame:
    """Cards with the whole ad; None for a limit keeps the whole description, or all tags."""
    ads = extract_cards(raw, name, *FULL_CARD, lambda card: full_card(card, max_tags))
    # On the extracted column: Python functions do not mix with nested lambdas.
    return ads.withColumn("description", truncate(strip_html("description"), max_bytes))


def title_card(card: Column) -> dict[str, Column]:
    """Title, company and a workplace badge; the page's category is the text."""
    link = h.attr(h.first(h.find(card, "a", "overlay-link")), "href")
    badge = F.array_join(h.first(h.find(card, css="badge"))["css"], " ")
    return {
        "title": _text(card, css="job-title"),
        "company": _text(card, css="company-name"),
        "location": badge_to_location(F.coalesce(badge, F.lit("")), TITLE_PLACE),
        "url": urls.rewrite_mirror(link, TITLE_ORIGIN, TITLE_MIRROR),
        "description": urls.last_path_segment("page_url"),
    }


def read_title_cards(raw: DataFrame, name: str = "devbg") -> DataFrame:
    return extract_cards(raw, name, *TITLE_CARD, title_card)


def _climb(links: DataFrame) -> DataFrame:
    """Add ``outer``: the nearest ancestor of the link that holds a paragraph, else
    the last one looked at. One narrow column per step up."""
    steps = ["col"]
    for i in range(MAX_CLIMB + 1):
        parent = F.try_element_at("nodes", F.nullif(F.col(steps[-1])["up"], F.lit(0)))
        links = links.withColumn(f"up{i}", parent)
        steps.append(f"up{i}")
    paragraphs = F.filter("nodes", lambda n: n["tag"] == "p")["id"]
    links = links.withColumn("paragraphs", paragraphs)

    def holds(step: str) -> Column:
        node = F.col(step)
        return F.exists("paragraphs", lambda at: (at > node["id"]) & (at <= node["last"]))

    chosen = [F.when(holds(step), F.col(step)) for step in steps[1:-1]]
    return links.withColumn("outer", F.coalesce(*chosen, F.col(steps[-1])))


def read_link_cards(
    raw: DataFrame,
    name: str = "justjoin",
    max_tags: int | None = MAX_TAGS,
    max_tag_bytes: int = MAX_TAG_BYTES,
) -> DataFrame:
    """Title links; the card is an ancestor, and its short texts are the tags: at most
    ``max_tags`` (None: all) of at most ``max_tag_bytes``."""
    links = cards(raw, *LINK_CARD)
    placed = _climb(links).select(
        "page_url",
        "seq",
        "pos",
        F.col("card").alias("link"),
        F.coalesce(h.subtree(F.col("nodes"), F.col("outer")), F.slice("nodes", 1, 0)).alias("card"),
    )
    link, card = F.col("link"), F.col("card")
    top = F.try_element_at(card, F.lit(1))
    company = trim_space(h.text_of(card, h.first(h.find(card, "p"))))
    labels = F.filter(
        h.find(card), lambda n: n["tag"].isin("div", "span") & n["leaf"]
    )
    tags = F.filter(
        _texts(card, labels), lambda t: (F.octet_length(t) <= max_tag_bytes) & ~junk_tag(t)
    )
    items = placed.withColumn("tags", F.array_distinct(cap_array(tags, max_tags)))
    ads = finish(
        items,
        name,
        {
            "title": trim_space(h.text_of(link, F.element_at(link, 1))),
            "company": F.when(company == "Remote", "").otherwise(company),
            "location": F.when(
                F.contains(h.text_of(card, top), F.lit("Remote")), LINK_REMOTE
            ).otherwise(LINK_PLACE),
            "url": h.attr(F.element_at(link, 1), "href"),
            "tags": F.col("tags"),
            "description": F.array_join("tags", " "),
        },
    )
    return first_wins(present(ads))
