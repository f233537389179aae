"""Text normalization as column expressions: everything stays in the JVM."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# What titles and artist names are cleaned of, in this order.
TITLE_NOISE = [
    r"(?i)[\(\[\{]\s*(official\s+(video|audio|music\s+video|lyric\s+video|visualizer|clip)|remastered|remaster|hd|4k|\d{4}\s+remaster)\s*[\)\]\}]",
    r"(?i)\b(official\s+(video|audio|music\s+video|lyric\s+video|visualizer|clip))\b",
    r"(?i)\b(remastered|remaster|hd|4k|vevo)\b",
    r"(?i)\b(19|20)\d{2}\s+remaster\b",
]
ARTIST_NOISE = [r"(?i)\s*-\s*topic$", r"(?i)\s*vevo$"]
EMPTY_BRACKETS = r"[\(\[\{]\s*[\)\]\}]"
# What must agree between two titles, and where it is looked for.
QUALIFIER = r"(?i)(?:[\(\[]|\s[-–—]\s)([^\)\]]+)"
VERSION_MARKERS = [
    r"(?i)\bre[ -]?imagin(?:ed|ing)\b",
    r"(?i)\b(remix|remixed)\b",
    r"(?i)\blive\b",
    r"(?i)\bacoustic\b",
    r"(?i)\binstrumental\b",
    r"(?i)\bkaraoke\b",
    r"(?i)\bsped[ -]?up\b",
    r"(?i)\bslowed\b",
    r"(?i)\bradio[ -]?edit\b",
]
FEATURED = r"(?i)^(.*?)\s*[\(\[]\s*(?:feat\.?|ft\.?|featuring)\s+([^\)\]]+)[\)\]]\s*$"


@lru_cache(maxsize=1)
def _marks() -> tuple[str, str]:
    """Letters whose canonical decomposition is one letter and marks, with those letters; then the
    marks themselves, which have no counterpart and so are dropped."""
    pairs, marks = [], []
    for code in range(0x80, 0x10000):
        if 0xD800 <= code < 0xE000:
            continue
        c = chr(code)
        if unicodedata.category(c) == "Mn":
            marks.append(c)
            continue
        bare = unicodedata.normalize("NFC", "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn"))
        if bare != c and len(bare) == 1:
            pairs.append((c, bare))
    return "".join(a for a, _ in pairs) + "".join(marks), "".join(b for _, b in pairs)


def strip_marks(c: Column) -> Column:
    """NFD, without nonspacing marks, NFC; for text of the basic plane, in one translation."""
    old, new = _marks()
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.translate(c, old, new)).otherwise(c)


def _fold(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(strip_marks(c)), r"\s+", " "))


def clean_title(c: Column) -> Column:
    for p in TITLE_NOISE:
        c = F.regexp_replace(c, p, "")
    return _fold(F.regexp_replace(c, EMPTY_BRACKETS, ""))


def clean_artist(c: Column) -> Column:
    for p in ARTIST_NOISE:
        c = F.regexp_replace(c, p, "")
    return _fold(c)


def tokens(c: Column) -> Column:
    """Distinct lower-cased white-space separated words. Matches are extracted: splitting would
    compile its pattern for every row."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"\S+"), F.lit(0)))


def token_set_ratio(a: Column, b: Column) -> Column:
    x, y = tokens(a), tokens(b)
    return F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def artist_words(c: Column) -> Column:
    """Words of a cleaned name without joining words."""
    words = F.regexp_extract_all(clean_artist(c), F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0))
    for w in ("and", "feat", "featuring", "ft"):
        words = F.array_remove(words, w)
    return words


def without_article(words: Column) -> Column:
    """Words without a leading article, unless it is all there is. Best given a column."""
    return F.when((F.size(words) > 1) & (F.get(words, F.lit(0)) == "the"), F.slice(words, 2, 10_000)).otherwise(words)


def artist_tokens(c: Column) -> Column:
    """Words of a cleaned name without joining words and without a leading article."""
    return without_article(artist_words(c))


def contains_run(words: Column, wanted: Column) -> Column:
    """Whether `wanted` (not empty) occurs in `words` as a contiguous run; words hold no blanks."""
    spaced = lambda w: F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))
    return (F.size(wanted) > 0) & spaced(words).contains(spaced(wanted))


def qualifiers(c: Column) -> Column:
    return F.array_join(F.regexp_extract_all(c, F.lit(QUALIFIER), F.lit(1)), " ")


def same_markers(x: Column, y: Column) -> Column:
    """Whether two titles' qualifiers agree on every family of markers."""
    out = F.lit(True)
    for p in VERSION_MARKERS:
        out = out & (x.rlike(p) == y.rlike(p))
    return out


def compatible_version(a: Column, b: Column) -> Column:
    return same_markers(qualifiers(a), qualifiers(b))


def round2(c: Column) -> Column:
    """Half away from zero on the scaled value, as the scores are defined."""
    return F.floor(c * 100 + 0.5) / 100


def clean_channel(c: Column) -> Column:
    """A channel's name without the endings of generated channels; case counts."""
    head = F.substring_index(c, " - Topic", 1)
    return F.trim(F.regexp_replace(F.regexp_replace(head, " - VEVO$", ""), "VEVO$", ""))


def unescaped(c: Column) -> Column:
    """HTML entities of JSON sources as characters, each once: what an ampersand's own entity spells stays."""
    for entity, letter in (("&quot;", '"'), ("&#0?39;|&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;|&#160;", "\u00a0"), ("&amp;|&#0?38;", "&")):
        c = F.regexp_replace(c, entity, letter)
    return c


def clock_ms(c: Column) -> Column:
    """H:MM:SS, MM:SS or seconds to milliseconds; 0 for anything else."""
    p = F.split(c, ":")
    n = F.transform(p, lambda x: x.try_cast("bigint"))
    total = F.aggregate(n, F.lit(0).cast("long"), lambda acc, x: acc * 60 + x)
    return F.when(F.size(p) <= 3, F.coalesce(total, F.lit(0)) * 1000).otherwise(F.lit(0)).cast("long")


def iso_duration_ms(c: Column) -> Column:
    """PT…H…M…S with fractions to milliseconds; 0 without a number or beyond a day."""
    part = lambda unit: F.coalesce(F.regexp_extract(c, r"^PT.*?([0-9.]+)" + unit, 1).try_cast("double"), F.lit(0.0))
    s = part("H") * 3600 + part("M") * 60 + part("S")
    valid = c.rlike(r"^PT([0-9.]+H)?([0-9.]+M)?([0-9.]+S)?$")
    return F.when(valid & (s > 0) & (s <= 86400), F.round(s * 1000)).otherwise(0).cast("long")


def exact_metric(c: Column) -> Column:
    """The whole number that a display text states in full, without separators and its noun; else null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(F.lower(c)), r"\s*(monthly listeners|subscribers|views|followers)$", ""), ",", "")
    return F.when(F.trim(bare).rlike(r"^[0-9]+$"), F.trim(bare).try_cast("bigint"))


def finite_seconds_ms(c: Column) -> Column:
    return F.when(~F.isnan(c) & (c >= 0) & (c <= 1e9), F.round(c * 1000).cast("long"))


def large_image(c: Column) -> Column:
    return F.regexp_replace(c, r"-\d+x\d+(\.\w+)$", "-500x500$1")


def escape_lucene(c: Column) -> Column:
    return F.regexp_replace(c, r'([+\-&|!(){}\[\]^"~*?:\\/$])', r"\\$1")


#: Spellings of credit roles.
ROLES = {
    "main": "primary_artist", "primary": "primary_artist", "primary_artists": "primary_artist", "artist": "primary_artist",
    "featured": "featured_artist", "featured_artists": "featured_artist",
    "singer": "vocalist", "singers": "vocalist", "vocal": "vocalist", "vocals": "vocalist",
    "music": "composer", "작곡": "composer", "작곡가": "composer", "작사": "lyricist", "작사가": "lyricist", "편곡": "arranger",
    "mix": "mixing_engineer", "mastering": "mastering_engineer", "recording": "recording_engineer", "instrument": "instrumentalist",
}
#: Names of relationships.
RELATIONSHIPS = {
    "performance": "recording_of", "remix": "remix_of", "edit": "edit_of", "remaster": "remaster_of",
    "samples material": "samples_material", "replaced by": "replaced_by", "supporting release": "supports_release",
}


def role(c: Column) -> Column:
    key = F.trim(F.lower(c))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv]), key), F.regexp_replace(key, " ", "_"))


def relationship(c: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in RELATIONSHIPS.items() for x in kv]), F.trim(F.lower(c))), F.lit("relationship"))
