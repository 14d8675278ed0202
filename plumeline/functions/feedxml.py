"""Elements and attributes of feed XML by tolerant patterns: malformed documents still give what can be read.

An entry is read once, from left to right: ``scan`` cuts it at the tags that feeds are read by, and every element and
attribute is then picked from that list of a few pieces. Within an entry, the first start tag of a name counts, up to the
first end tag after it; elements may overlap or stand in each other in any way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, decode_entities, display_text, filled, filled_once, raw_text, tag_open

_ATTRIBUTE = "(\\S+)=(?:\"([^\"]*)\"|'([^']*)')"
#: The elements that entries are read by. Of two names of which one begins the other, the longer comes first.
NAMES = (
    "title", "link", "description", "summary", "content:encoded", "content", "pubDate", "dc:date", "author", "dc:creator", "guid", "published", "updated", "id", "name", "media:content", "media:thumbnail", "enclosure",
)
_ANY = "|".join(NAMES)
_TAG = f"(?i)<(?:(?:{_ANY})(?![A-Za-z0-9_])[^>]*|/(?:{_ANY}))>"
_LABEL = f"(?i)^<(/?(?:{_ANY})(?![A-Za-z0-9_]))"
#: Set around tags to cut the text there: no character, so texts have no use for it.
_MARK = "\uffff"


def element(name: str) -> str:
    return f"(?is){tag_open(name)}[^>]*>(.*?)</{name}>"


def items(xml: Column, name: str) -> Column:
    return F.regexp_extract_all(xml, F.lit(element(name)), F.lit(1))


def scan(block: Column) -> Column:
    """(pieces, labels) of an entry: text and tags in turn, and at the places of tags their names in lower case, /name for end tags. U+FFFF in the entry becomes U+FFFD."""
    safe = F.when(block.contains(_MARK), F.translate(block, _MARK, "\ufffd")).otherwise(block)
    pieces = F.split(F.regexp_replace(safe, F.lit(_TAG), F.lit(f"{_MARK}$0{_MARK}")), _MARK, -1)
    label = lambda p, i: F.when(i % 2 == 1, F.lower(F.regexp_extract(p, _LABEL, 1))).otherwise("")
    return bound(pieces, lambda p: F.struct(p.alias("pieces"), F.transform(p, label).alias("labels")))


def _first(labels: Column, name: Column) -> Column:
    """Place of the first start tag of a name in lower case, from 1; 0 for none. A name may go on after a colon."""
    places = F.transform(labels, lambda x, i: F.when((x == name) | F.startswith(x, F.concat(name, F.lit(":"))), i + 1))
    return F.coalesce(F.get(F.array_compact(places), 0), F.lit(0))


def _between(scanned: Column, name: Column, take) -> Column:
    """``take`` of the part of an entry between the first start tag of a name in lower case and the next end tag."""
    labels = scanned["labels"]

    def closed(place: Column) -> Column:
        rest = F.slice(labels, place + 1, F.size(labels))
        return bound(F.array_position(rest, F.concat(F.lit("/"), name)).cast("int"), lambda end: F.when(end > 0, take(place, end)))

    return bound(_first(labels, name), lambda place: F.when(place > 0, closed(place)))


def texts_between(scanned: Column, names: Sequence[str]) -> Column:
    """An array of what stands in the first element of each name, tags and all; null without one."""
    text = lambda n: _between(scanned, n, lambda place, end: F.array_join(F.slice(scanned["pieces"], place + 1, end - 1), ""))
    return F.transform(F.array(*[F.lit(n.lower()) for n in names]), text)


def within(scanned: Column, name: str) -> Column:
    """(pieces, labels) of what is in the first element of a name, null without one."""
    part = lambda column, place, end: F.slice(scanned[column], place + 1, end - 1).alias(column)
    return _between(scanned, F.lit(name.lower()), lambda place, end: F.struct(part("pieces", place, end), part("labels", place, end)))


def whole_text(scanned: Column) -> Column:
    return F.array_join(scanned["pieces"], "")


def first_cleaned(texts: Column, clean) -> Column:
    """The first of an array of texts that is not null when cleaned; those after it are not cleaned. The cleaning stands in the expression once."""
    return F.aggregate(texts, F.lit(None).cast("string"), lambda found, text: F.coalesce(found, clean(text)))


def picked_text(scanned: Column, names: Sequence[str], clean=display_text) -> Column:
    """Cleaned text of the first element of the first name that has any; of each name only the first element counts."""
    return first_cleaned(texts_between(scanned, names), clean)


def picked_raw(scanned: Column, names: Sequence[str]) -> Column:
    return picked_text(scanned, names, raw_text)


def first_text(block: Column, names: Sequence[str]) -> Column:
    return bound(scan(block), lambda s: picked_text(s, names))


def first_raw(block: Column, names: Sequence[str]) -> Column:
    return bound(scan(block), lambda s: picked_raw(s, names))


def attributes(fragment: Column) -> Column:
    """Ordered (k, v) pairs; of a repeated key the last counts."""
    keys, double, single = (F.regexp_extract_all(fragment, F.lit(_ATTRIBUTE), F.lit(i)) for i in (1, 2, 3))
    return F.transform(F.arrays_zip(keys.alias("k"), double.alias("a"), single.alias("b")), lambda p: F.struct(p["k"].alias("k"), decode_entities(F.coalesce(filled(p["a"]), p["b"], F.lit(""))).alias("v")))


def attribute(fragment: Column, name: str | Column) -> Column:
    """The last value of a name; other attributes' values are not decoded."""
    keys, double, single = (F.regexp_extract_all(fragment, F.lit(_ATTRIBUTE), F.lit(i)) for i in (1, 2, 3))
    found = F.filter(F.arrays_zip(keys.alias("k"), double.alias("a"), single.alias("b")), lambda p: p["k"] == name)
    return bound(F.get(found, F.size(found) - 1), lambda p: decode_entities(F.coalesce(filled(p["a"]), p["b"], F.when(p.isNotNull(), F.lit("")))))


def _inside(tag: Column) -> Column:
    """What stands in a start tag after its name."""
    return F.regexp_extract(tag, f"(?i)^<(?:{_ANY})(?![A-Za-z0-9_])([^>]*)>", 1)


def picked_link(scanned: Column) -> Column:
    """href of the first alternate link (which a link without rel is), else of the first link with one."""
    tags = F.filter(scanned["pieces"], lambda p, i: F.get(scanned["labels"], i) == "link")
    values = lambda t: bound(_inside(t), lambda x: F.transform(F.array(F.lit("href"), F.lit("rel")), lambda n: attribute(x, n)))
    links = F.transform(F.transform(tags, values), lambda v: F.struct(F.trim(F.get(v, 0)).alias("href"), F.lower(F.coalesce(filled(F.get(v, 1)), F.lit("alternate"))).alias("rel")))
    links = F.filter(links, lambda x: F.coalesce(x["href"], F.lit("")) != "")
    return bound(links, lambda x: F.coalesce(F.get(F.filter(x, lambda y: y["rel"] == "alternate"), 0)["href"], F.get(x, 0)["href"]))


def picked_image(scanned: Column) -> Column:
    """url of the first media:content, else media:thumbnail, else enclosure that has one."""
    tag = lambda n: bound(_first(scanned["labels"], n), lambda place: F.when(place > 0, F.get(scanned["pieces"], place - 1)))
    tags = F.transform(F.array(*[F.lit(n) for n in ("media:content", "media:thumbnail", "enclosure")]), tag)
    return first_cleaned(tags, lambda t: filled_once(F.trim(attribute(_inside(t), "url"))))


def atom_link(block: Column) -> Column:
    return bound(scan(block), picked_link)


def image_url(block: Column) -> Column:
    return bound(scan(block), picked_image)


def document_kind(xml: Column) -> Column:
    """rss, atom, blank or unknown; RSS is looked for first, anywhere in the document."""
    return F.when(F.trim(F.coalesce(xml, F.lit(""))) == "", "blank").when(F.regexp_like(xml, F.lit(f"(?i){tag_open('rss')}")), "rss").when(F.regexp_like(xml, F.lit(f"(?i){tag_open('feed')}")), "atom").otherwise("unknown")
