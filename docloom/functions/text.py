"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions import urls

NAME_LIMIT = 197  # fixed value: longest stem before the ".md" ending


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def words(c: Column) -> Column:
    """Number of white-space separated words."""
    t = strip(c)
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, r"(?U)\s+")))


def file_name(url: Column) -> Column:
    """Readable file name for a page address: path only, ``.md`` at the end."""

    def name(p: Column) -> Column:
        n = F.regexp_replace(F.regexp_replace(p, "/", "_"), r"(?U)[^\w\-.]", "_")
        return F.substring(F.regexp_replace(F.regexp_replace(n, "_+", "_"), "^_|_$", ""), 1, NAME_LIMIT)

    def ending(n: Column) -> Column:
        stem = F.when(F.substring_index(n, "_", -1).contains("."), F.regexp_replace(n, r"\.[^.]*$", "")).otherwise(n)
        return F.when(n.endswith(".md"), n).otherwise(F.concat(stem, F.lit(".md")))

    path = F.regexp_replace(urls.path(url), "^/+|/+$", "")
    return urls.let(path, lambda p: F.when(p == "", F.lit("index.md")).otherwise(urls.let(name(p), ending)))


def slug(title: Column) -> Column:
    t = strip(F.lower(title))
    return F.regexp_replace(F.regexp_replace(t, r"(?U)[^\w\s\-]", ""), r"(?U)\s+", "-")


def _quoted(key: str, value: Column) -> Column:
    """One front-matter line, or null when the value is empty."""
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f'{key}: "'), value, F.lit('"')))


def front_matter(title: Column, description: Column, url: Column, language: Column, at: Column) -> Column:
    """Ordered header block; empty keys are left out; ``at`` is a UTC timestamp."""
    esc = lambda c: F.replace(c, F.lit('"'), F.lit('\\"'))
    return F.concat_ws(
        "\n", F.lit("---"), _quoted("title", esc(title)), _quoted("description", esc(description)),
        _quoted("source", url), _quoted("language", language),
        F.concat(F.lit('scraped_at: "'), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('"')), F.lit("---"))


def without_front_matter(md: Column) -> Column:
    """Remove the first header block only."""
    return F.regexp_replace(md, r"(?s)^---\n.*?\n---\n*", "")


def crawl_title(md: Column) -> Column:
    """Header title (ends at the first quote, escaped or not), else the first level-one heading."""
    header = F.regexp_extract(md, r'(?m)^title:\s*"(.+?)"', 1)
    return F.when(header != "", header).otherwise(strip(F.regexp_extract(md, r"(?m)^#\s+(.+)$", 1)))


def docs_title(md: Column) -> Column:
    """Value of the first line that, once trimmed, starts with ``title:`` or ``# ``."""
    line = F.regexp_extract(md, r"(?m)^[ \t\f]*(title:.*|# .*)$", 1)
    value = strip(F.regexp_replace(line, "^title:", ""))
    return F.when(line.startswith("title:"), F.regexp_replace(value, '^"+|"+$', "")).otherwise(
        strip(F.substr(strip(line), F.lit(3))))


def video_id(url: Column) -> Column:
    """Identifier inside a watch or short link; anything else is taken to be one already."""
    after = lambda mark, stop: F.substring_index(
        F.split(url, mark, -1).getItem(1), stop, 1)
    return (F.when(url.contains("youtube.com/watch?v="), after(r"watch\?v=", "&"))
            .when(url.contains("youtu.be/"), after(r"youtu\.be/", "?")).otherwise(url))


def preview(c: Column, n: int = 50) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)
