"""Messages, links and dates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The message layout used when a publisher names none, and its date layout.
DEFAULT_TEMPLATE = "*{{.Title}}* {{.DateFmt}} \n{{.Src.Name}} {{.Link}}"
DATE_LAYOUT = "dd.MM HH:mm"

_SLOT = re.compile(r"\{\{\s*\.([A-Za-z.]+)\s*\}\}")


def agency_of(source_name: Column) -> Column:
    """Sources are named ``Agency.Channel``."""
    return F.substring_index(source_name, ".", 1)


def date_text(published: Column) -> Column:
    return F.coalesce(F.date_format(published, DATE_LAYOUT), F.lit(""))


def item_slots(title="title", link="link", published="published", src="src") -> dict[str, Column]:
    """What a template may name, as columns over the item schema."""
    return {
        "Title": F.col(title),
        "Link": F.col(link),
        "DateFmt": date_text(F.col(published)),
        "Src.Name": F.col(src),
        "Src.Agency": agency_of(F.col(src)),
    }


def render(template: str | None, slots: dict[str, Column]) -> Column:
    """Fill a template known when the query is built. Text and values are taken as they are."""
    pieces, at = [], 0
    template = template or DEFAULT_TEMPLATE
    for slot in _SLOT.finditer(template):
        if slot.group(1) not in slots:
            raise ValueError(f"unknown placeholder {slot.group(0)}")
        pieces += [F.lit(template[at : slot.start()]), F.coalesce(slots[slot.group(1)], F.lit(""))]
        at = slot.end()
    return F.concat(*pieces, F.lit(template[at:]))


def render_each(template: Column, slots: dict[str, Column]) -> Column:
    """Fill a template held in a column.

    The template is cut at its placeholders first, so text inside a value is never taken for
    a placeholder of its own.
    """
    template = F.when(F.coalesce(template, F.lit("")) == "", F.lit(DEFAULT_TEMPLATE)).otherwise(template)
    values = F.create_map(*[x for k, v in slots.items() for x in (F.lit(k), F.coalesce(v, F.lit("")))])
    texts = F.split(template, r"\{\{\s*\.[A-Za-z.]+\s*\}\}")
    names = F.regexp_extract_all(template, F.lit(r"\{\{\s*\.([A-Za-z.]+)\s*\}\}"), F.lit(1))
    filled = F.transform(names, lambda name: F.coalesce(values[name], F.lit("")))
    parts = F.zip_with(texts, filled, lambda text, value: F.concat(text, F.coalesce(value, F.lit(""))))
    return F.array_join(parts, "")


def query_escape(text: Column) -> Column:
    """Escape for the query part of a link (blank as ``+``; ``*`` escaped, ``~`` not)."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def build_url(url_format: Column, message: Column) -> Column:
    """Put the escaped message at the ``%s`` of the link; any other ``%`` stays."""
    return F.replace(url_format, F.lit("%s"), query_escape(message))


def parse_feed_time(text: Column) -> Column:
    """Feed timestamps (RFC 822 with or without weekday, ISO 8601) as UTC wall time, null when absent or bad."""
    bare = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", "")
    zoned = F.regexp_replace(bare, r"\s(?:GMT|UTC|UT|Z)$", " +0000")
    layouts = [f"d {month} {year} HH:mm{seconds} {zone}" for month in ("MMM", "MMMM") for year in ("yyyy", "yy")
               for seconds in (":ss", "") for zone in ("Z", "z")]
    parsed = [F.try_to_timestamp(zoned, F.lit(layout)) for layout in layouts]
    iso = F.when(bare.rlike(r"^\d{4}-\d{2}-\d{2}"), F.coalesce(F.try_to_timestamp(bare), F.try_to_timestamp(bare, F.lit("yyyy-MM-dd'T'HH:mmXXX"))))
    instant = F.coalesce(iso, *parsed)
    return F.to_utc_timestamp(instant, F.current_timezone()).cast("timestamp_ntz")
