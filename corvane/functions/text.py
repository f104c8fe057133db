"""Column functions over strings: each takes and returns Columns, so Catalyst sees through them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
KINDS = {
    "slack": ("message", "slack"),
    "gmail": ("email", "gmail"),
    "jira": ("ticket", "jira"),
    "linear": ("ticket", "linear"),
    "github": ("ticket", "github"),
    "confluence": ("knowledge_base", "notion"),
    "google_drive": ("knowledge_base", "google_drive"),
    "fireflies": ("knowledge_base", "fireflies"),
    "hubspot": ("custom", "hubspot"),
}
LEAK_MARKERS = ("title_field_name", "content_field_names", "dataset_doc_uuid", "dataset_noise_document")
TITLE_MAX, CHANNEL_MAX = 1000, 80
THREAD_EPOCH, THREAD_STEP = 1_735_689_600, 45


def strip(c: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+$", "")


def cap(c: Column, most: int) -> Column:
    """At most so many characters; a cut text ends in an ellipsis without space before it."""
    c = F.coalesce(c, F.lit(""))
    return F.when(F.length(c) <= most, c).otherwise(F.concat(rstrip(F.substring(c, 1, most - 1)), F.lit("…")))


def document_of(item: Column) -> Column:
    """The document's id from an item's: without a typed suffix."""
    return F.regexp_replace(F.coalesce(item, F.lit("")), r"(?d)_[ecm]\d+$", "")


def occurrences(c: Column, what: str) -> Column:
    return ((F.length(c) - F.length(F.replace(c, F.lit(what)))) / len(what)).cast("long")


def unescape(c: Column) -> Column:
    """Literal line breaks and tabs become real ones where they dominate: first the doubly escaped, then the singly escaped."""

    def real(c: Column, slashes: str) -> Column:
        for what, to in ((f"{slashes}r{slashes}n", "\n"), (f"{slashes}n", "\n"), (f"{slashes}t", "    ")):
            c = F.replace(c, F.lit(what), F.lit(to))
        return c

    once = F.when(occurrences(c, "\\\\n") >= 3, real(c, "\\\\")).otherwise(c)
    literal = occurrences(once, "\\n")
    return F.when((literal >= 3) & (literal > occurrences(once, "\n")), real(once, "\\")).otherwise(once)


def listed(c: Column) -> Column:
    """Parts of a comma list, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), strip), lambda x: x != "")


def email_blocks(c: Column) -> Column:
    """A text cut before each From: line that follows a blank line or a rule."""
    return F.split(c, r"(?:\n(?U:\s*)\n|\n\\?-{2,}(?U:\s*)\n)(?=From:[ \t])")


def endpoint(c: Column) -> Column:
    """Scheme, host and path in lower case, without query, fragment and closing slashes; https where no scheme is given."""
    c = F.trim(c)
    c = F.when(F.contains(c, F.lit("://")), c).otherwise(F.concat(F.lit("https://"), c))
    return F.lower(F.regexp_replace(F.regexp_replace(c, r"[?#].*$", ""), r"/+$", ""))


def retry_seconds(c: Column) -> Column:
    """The wait that a message asks for, null if it asks for none."""
    return F.nullif(F.regexp_extract(c, r"(?i)retry in (\d+) second", 1), F.lit("")).cast("int")


def iso(epoch: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def kind_of(source: Column) -> Column:
    """(kind, provider) of a source type; an unknown one is custom and provides itself."""
    table = F.create_map(*[x for s, (k, p) in KINDS.items() for x in (F.lit(s), F.struct(F.lit(k).alias("kind"), F.lit(p).alias("provider")))])
    return F.coalesce(F.try_element_at(table, source), F.struct(F.lit("custom").alias("kind"), source.alias("provider")))


def leaks(c: Column, markers: tuple[str, ...] = LEAK_MARKERS) -> Column:
    """Whether a text holds a marker that must not reach a context."""
    out = F.lit(False)
    for m in markers:
        out = out | F.contains(c, F.lit(m))
    return out


def flat(value: Column, *names: str) -> Column:
    """A struct of scalars as one string: its values that are not null, joined."""
    return F.concat_ws(": ", *[value[n].cast("string") for n in names])


def joined_digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)
