"""Rows and song pages of HTML catalogues to records, by Python table functions over landed pages.

A page is read in one pass of an incremental tokenizer that keeps the open elements of the current row
alone, at most DEPTH of them; nothing is executed and no address is followed.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from melder.functions.text import iso_duration_ms
from melder.sources.html import recordings

MAX_BYTES, DEPTH, ROWS, FEED = 8_388_608, 200, 10, 65_536
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
# Elements that end where one of these begins, unless a list or table of its own has begun since.
ENDS = {"tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
OWN = {"table", "ul", "ol", "dl"}
# How links name what they lead to; which icon labels a value; labels of main facts.
REFERENCES = {
    "track": re.compile(r"(?:/track/|songId=|goSongDetail\(['\"]?|fnViewSongInfo\(['\"]?)([0-9]+)"),
    "album": re.compile(r"(?:/album/|albumId=|goAlbumDetail\(['\"]?|fnViewAlbumLayer\(['\"]?|albumInfo['\"]\s*,\s*['\"]|axnm=)([0-9]+)"),
    "artist": re.compile(r"(?:/artist/|artistId=|goArtistDetail\(['\"]?|fnViewArtist\(['\"]?|artistInfo['\"]\s*,\s*['\"]|xxnm=)([0-9]+)"),
}
ICONS = {"5": "아티스트", "6": "앨범", "7": "장르", "8": "재생시간", "19": "작곡가", "20": "작사가"}
ARTIST_LABELS, ALBUM_LABEL, TIME_LABEL, NO_ALBUM = ("아티스트", "가수"), "앨범", "재생시간", "곡정보"
# Pages of the common form: tags of plain names with quoted attributes, texts without `<`, and no element whose text is read otherwise.
_ATTRIBUTES = r"""(?:[ \t\r\n]+[a-zA-Z][a-zA-Z0-9_:-]*=(?:"[^"<>]*"|'[^'<>]*'))*+"""
_NAME = r"(?!(?i:script|style|textarea|title|xmp|iframe|noembed|noframes|noscript|plaintext)[^a-zA-Z0-9])[a-zA-Z][a-zA-Z0-9]*+"
PLAIN = re.compile(rf"(?:[^<]++|</{_NAME}>|<{_NAME}{_ATTRIBUTES}>)*+")
PIECE = re.compile(rf"</([a-zA-Z0-9]+)>|<([a-zA-Z0-9]+)({_ATTRIBUTES})>|([^<]+)")
ATTRIBUTE = re.compile(r"""([a-zA-Z0-9_:-]+)=(?:"([^"]*)"|'([^']*)')""")
RECORD = "id string, title string, artists array<struct<id: string, name: string>>, album_id string, album string, image string"
DETAIL = f"{RECORD}, duration string, release_date string, isrc string, fields map<string, string>"


def reference(kind: str, attrs: dict) -> str:
    if "href" not in attrs and "onclick" not in attrs:
        return ""
    found = REFERENCES[kind].search(f"{attrs.get('href') or ''} {attrs.get('onclick') or ''}")
    return found[1] if found else ""


def _picture(src: str | None) -> str:
    src = "https:" + src if (src or "").startswith("//") else src or ""
    return src if src.startswith("https://") else ""


class Parts(HTMLParser):
    """The open elements with their texts; a subclass is told when one opens and when it closes. Texts of
    icons and scripts aren't part of what holds them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, dict, list[str]]] = []

    def read(self, body: str) -> None:
        if PLAIN.fullmatch(body):
            self._read_plain(body)
        else:
            for at in range(0, len(body), FEED):
                self.feed(body[at : at + FEED])
            self.close()
        while self.open:
            self._end()

    def _read_plain(self, body: str) -> None:
        """What feed() gives for a page of the common form, by one pattern a piece."""
        for end, tag, attrs, data in PIECE.findall(body):
            if data:
                self.handle_data(unescape(data) if "&" in data else data)
            elif end:
                self.handle_endtag(end.lower())
            else:
                self.handle_starttag(tag.lower(), [(k.lower(), unescape(x or y)) for k, x, y in ATTRIBUTE.findall(attrs)] if attrs else [])

    def handle_starttag(self, tag: str, attrs: list) -> None:
        given = {k: v or "" for k, v in attrs}
        below = 0
        for i in range(len(self.open) - 1, -1, -1):
            if tag not in ENDS or self.open[i][0] in OWN:
                break
            if self.open[i][0] in ENDS[tag]:
                below = len(self.open) - i
        for _ in range(below):
            self._end()
        self.started(tag, given)
        if tag not in VOID and len(self.open) < DEPTH:
            self.open.append((tag, given, []))

    def handle_data(self, data: str) -> None:
        for i, (tag, given, _) in enumerate(self.open):
            if tag == "script" and i < len(self.open) - 1 or "icon" in given.get("class", "") and "icon" in given["class"].split():
                return
        if self.open and self.open[-1][0] in ("script", "style"):
            self.open[-1][2].append(data)
            return
        for _, _, texts in self.open:
            texts.append(data)

    def handle_endtag(self, tag: str) -> None:
        if any(t == tag for t, _, _ in self.open):
            while self._end() != tag:
                pass

    def _end(self) -> str:
        tag, given, texts = self.open.pop()
        joined = "".join(texts)
        self.ended(tag, given, joined if tag == "script" else " ".join(joined.split()))
        return tag

    def started(self, tag: str, given: dict) -> None: ...

    def ended(self, tag: str, given: dict, text: str) -> None: ...


class Rows(Parts):
    """Records of a result list: each table row that names a numeric track."""

    def __init__(self, provider: str) -> None:
        super().__init__()
        self.provider, self.row, self.found = provider, None, []

    def started(self, tag: str, given: dict) -> None:
        if tag == "tr":
            self.row = {"id": given.get("trackid") or given.get("songid") or "", "title": None, "artists": {}, "album_id": None, "album": None, "image": ""}
        elif self.row is not None:
            self.row["id"] = self.row["id"] or given.get("data-song-no") or reference("track", given)
            self.row["image"] = self.row["image"] or (_picture(given.get("src")) if tag == "img" else "")

    def ended(self, tag: str, given: dict, text: str) -> None:
        r = self.row
        if r is None:
            return
        titled = tag == "a" and "playSong(" in given.get("href", "") if self.provider == "melon" else "title" in given.get("class", "").split()
        if titled and r["title"] is None:
            r["title"] = text
        if tag == "a" and text:
            if (artist := reference("artist", given)) and artist not in r["artists"]:
                r["artists"][artist] = text
            if (album := reference("album", given)) and text != NO_ALBUM:
                r["album_id"], r["album"] = album, text
        if tag == "tr":
            self.found.append(r)
            self.row = None


class Song(Parts):
    """What a song's page states: linked data, its address, labelled fields with the links in them."""

    def __init__(self) -> None:
        super().__init__()
        self.data: dict = {}
        self.address, self.picture, self.script_id, self.label = "", "", "", ""
        self.fields: dict[str, str] = {}
        self.links: list[tuple[str, str, str]] = []
        self.artists: list[tuple[str, str]] = []
        self.album_id = ""

    def started(self, tag: str, given: dict) -> None:
        if tag == "meta":
            key = given.get("property") or given.get("name")
            self.address = given.get("content", "") if key == "og:url" else self.address
            self.picture = _picture(given.get("content")) if key == "og:image" else self.picture
        if tag in ("td", "dd") or "value" in given.get("class", "").split():
            self.links = []
        icon = re.search(r"txt_([0-9]+)\.png", given.get("src", "")) if tag == "img" else None
        if icon and any("attr" in g.get("class", "").split() for _, g, _ in self.open):
            self.label = ICONS.get(icon[1], "")

    def ended(self, tag: str, given: dict, text: str) -> None:
        if tag == "script":
            if given.get("type") == "application/ld+json" and not self.data:
                try:
                    self.data = next(recordings(json.loads(text)), {})
                except (ValueError, RecursionError):
                    pass
            elif found := re.search(r"var\s+iSnsSeq\s*=\s*['\"]([0-9]+)", text):
                self.script_id = found[1]
        elif tag == "a":
            self.links += [(kind, i, text) for kind in ("artist", "album") if (i := reference(kind, given))]
        elif tag in ("th", "dt"):
            self.label = text
        elif (tag in ("td", "dd") or "value" in given.get("class", "").split()) and self.label:
            if len(text.encode()) < 4096:
                self.fields[self.label] = text
            if self.label in ARTIST_LABELS:
                self.artists = list(dict.fromkeys((i, t) for kind, i, t in self.links if kind == "artist" and t))
            if self.label == ALBUM_LABEL:
                self.album_id = next((i for kind, i, _ in self.links if kind == "album"), "")
            self.label = ""


@udtf(returnType=f"rank int, {RECORD}")
class ListedSongs:
    """The first ROWS songs of a result page with distinct numeric ids and a title; none if it isn't one."""

    def eval(self, body: str, provider: str) -> Iterator[tuple]:
        if body is None or len(body.encode("utf-8", "surrogatepass")) > MAX_BYTES:
            return
        page = Rows(provider)
        page.read(body)
        seen: set[str] = set()
        for r in page.found:
            if len(seen) < ROWS and r["id"].isascii() and r["id"].isdigit() and r["id"] not in seen and r["title"]:
                seen.add(r["id"])
                yield len(seen), r["id"], r["title"], list(r["artists"].items()), r["album_id"], r["album"], r["image"] or None


@udtf(returnType=DETAIL)
class SongPage:
    """One record of a song's page, if the page itself says that it is the song asked for and names it and an artist."""

    def eval(self, body: str, provider: str, native_id: str) -> Iterator[tuple]:
        if body is None or len(body.encode("utf-8", "surrogatepass")) > MAX_BYTES:
            return
        page = Song()
        page.read(body)
        d = page.data
        text = lambda x: x if isinstance(x, str) else ""
        named = page.script_id if provider == "genie" else reference("track", {"href": f"{text(d.get('sameAs'))} {page.address}"})
        if not named or named != native_id:
            return
        album = d.get("inAlbum") if isinstance(d.get("inAlbum"), dict) else {}
        by = d.get("byArtist") if isinstance(d.get("byArtist"), dict) else {}
        artists = page.artists or ([(None, text(by.get("name")))] if text(by.get("name")) else [])
        title = text(d.get("name")) or page.fields.get("title", "")
        if not title or not artists:
            return
        album_id = reference("album", {"href": f"{text(album.get('url'))} {text(album.get('@id'))}"}) or page.album_id
        isrc = text(d.get("isrcCode")) or next(iter(re.findall(r"(?i)\b([A-Z]{2}[A-Z0-9]{3}[0-9]{7})\b", page.fields.get("ISRC", ""))), "")
        yield native_id, title, artists, album_id or None, text(album.get("name")) or page.fields.get(ALBUM_LABEL), text(d.get("image")) or page.picture or None, text(d.get("duration")) or page.fields.get(TIME_LABEL), text(d.get("datePublished")) or None, isrc or None, page.fields


def listed_songs(pages: DataFrame) -> DataFrame:
    """query_id, provider, rank and RECORD of result pages(query_id, provider, body)."""
    spark = pages.sparkSession
    spark.udtf.register("melder_listed_songs", ListedSongs)
    return spark.sql("SELECT query_id, provider, s.* FROM {pages}, LATERAL melder_listed_songs(body, provider) AS s", pages=pages)


def song_pages(pages: DataFrame) -> DataFrame:
    """query_id, provider and DETAIL, with duration_ms for duration, of pages(query_id, provider, native_id, body)."""
    spark = pages.sparkSession
    spark.udtf.register("melder_song_page", SongPage)
    out = spark.sql("SELECT query_id, provider, s.* FROM {pages}, LATERAL melder_song_page(body, provider, native_id) AS s", pages=pages)
    clock = F.regexp_extract("duration", r"^(\d{1,2}:\d{2})$", 1)
    parts = F.split(clock, ":")
    ms = F.when(clock != "", (F.get(parts, F.lit(0)).cast("long") * 60 + F.get(parts, F.lit(1)).cast("long")) * 1000).otherwise(iso_duration_ms(F.col("duration")))
    return out.withColumn("duration_ms", F.coalesce(ms, F.lit(0))).drop("duration")
