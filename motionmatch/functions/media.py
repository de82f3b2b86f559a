"""Media links found in stored pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Where a page names its clip, best source first.
CLIP_PATTERNS = (
    r"""(?i)<source[^>]+src=["']([^"']+\.(?:mp4|webm)[^"']*)["']""",
    r"""(?i)<video[^>]+src=["']([^"']+\.(?:mp4|webm)[^"']*)["']""",
    r"""(?i)["'](https?://[^"']+\.(?:mp4|webm)[^"']*)["']""",
)
# Words that mark a picture as paid, and paths that mark a portrait.
PAID_MARKERS = ("unsplash+", "unsplash plus", "getty images", "premium", "plus.unsplash.com")
PORTRAIT_MARKERS = ("profile", "avatar")
CONTEXT_BEFORE, CONTEXT_AFTER = 2500, 1200


def absolute_url(url: Column, base: str) -> Column:
    """Scheme-relative and root-relative links made absolute."""
    return (F.when(url.startswith("//"), F.concat(F.lit("https:"), url))
            .when(url.startswith("/"), F.concat(F.lit(base), url)).otherwise(url))


def first_media_url(html: Column, base: str, patterns: Sequence[str] = CLIP_PATTERNS) -> Column:
    """First match of the first pattern that matches anywhere, else null."""
    tried = [F.nullif(F.regexp_extract(html, p, 1), F.lit("")) for p in patterns]
    return absolute_url(F.coalesce(*tried), base)


def once(value: Column, body) -> Column:
    """``body(value)``; bound as a variable, the value is not computed again at each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unescape(text: Column) -> Column:
    """Entities of the characters that attribute values escape, by name or number; ampersand last."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("\\u0026", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))

    def by_number(plain: Column) -> Column:
        done = plain
        for char in "<>\"'/=?&":
            done = F.regexp_replace(done, f"(?i)&#(?:0*{ord(char)}|x0*{ord(char):x});", char)
        return F.when(F.contains(plain, F.lit("&#")), done).otherwise(plain)

    return F.replace(once(text, by_number), F.lit("&amp;"), F.lit("&"))


def link_positions(html: Column, pattern: str) -> Column:
    """Array of (start, end, url) for each match of ``pattern``; start is 0-based.

    Offsets are running sums over the gaps between matches and the matches.
    """
    links = F.regexp_extract_all(html, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(html, pattern, -1), F.length)
    pairs = F.zip_with(gaps, links, lambda gap, link: F.struct(gap.alias("gap"), link.alias("link")))
    pairs = F.filter(pairs, lambda p: p["link"].isNotNull())
    empty = F.expr("cast(array() as array<struct<start:int,end:int,url:string>>)")

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + pair["gap"]
        end = start + F.length(pair["link"])
        url = F.substring_index(unescape(pair["link"]), "?", 1)
        return F.struct(end.alias("at"), F.array_append(acc["found"], F.struct(
            start.alias("start"), end.alias("end"), url.alias("url"))).alias("found"))

    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("found")), step,
                       lambda acc: acc["found"])


def first_clean_image(html: Column, pattern: str, *, suffix: str = "",
                      markers: Sequence[str] = PAID_MARKERS,
                      skip: Sequence[str] = PORTRAIT_MARKERS,
                      before: int = CONTEXT_BEFORE, after: int = CONTEXT_AFTER) -> Column:
    """First distinct link whose surroundings carry no marker, else null.

    Only a link's first occurrence is judged; later copies are ignored.
    """
    def clean(urls: Column, link: Column, i: Column) -> Column:
        start = F.greatest(link["start"] - before, F.lit(0))
        end = F.least(link["end"] + after, F.length(html))
        ok = F.array_position(urls, link["url"]) == i + 1
        for part in skip:
            ok = ok & ~F.contains(link["url"], F.lit(part))

        def unmarked(around: Column) -> Column:
            fine = F.lit(True)
            for marker in markers:
                fine = fine & ~F.contains(around, F.lit(marker))
            return fine

        return ok & once(F.lower(unescape(F.substring(html, start + 1, end - start))), unmarked)

    first = once(link_positions(html, pattern), lambda found: once(
        F.transform(found, lambda f: f["url"]), lambda urls: F.try_element_at(
            F.filter(found, lambda link, i: clean(urls, link, i)), F.lit(1))))
    return F.concat(first["url"], F.lit(suffix))
