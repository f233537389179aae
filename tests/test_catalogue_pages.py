"""Result lists and song pages of HTML catalogues."""

import pytest

from melder.sources import catalogue_pages as C

LISTS = {
    "bugs": '<table><tr trackId="123"><th><p class="title"><a>Song</a></p></th><td><a href="/artist/7">Singer</a><a class="album" href="/album/9">Album</a></td></tr></table>',
    "genie": '<table><tr songid="123"><td><a class="title"><span class="icon">TITLE</span>Song</a><a onclick="fnViewArtist(\'7\')">Singer</a><a class="albumtitle" onclick="fnViewAlbumLayer(\'9\')">Album</a></td></tr></table>',
    "melon": '<table><tr><td><button data-song-no="123"></button><a href="javascript:playSong(\'1\',123)">Song</a><a href="javascript:goArtistDetail(\'7\')">Singer</a><a href="javascript:goAlbumDetail(\'9\')">Album</a></td></tr></table>',
}
PAGE = '<meta property="og:image" content="//img.example/1.jpg"><script type="application/ld+json">{"@type":"MusicRecording","sameAs":"https://music.bugs.co.kr/track/123","name":"Song","duration":"PT3M19S","datePublished":"2020-08-21","byArtist":{"name":"Singer"},"inAlbum":{"name":"Album","url":"https://music.bugs.co.kr/album/9"}}</script><table class="basicInfo"><tr><th>아티스트</th><td><a href="/artist/7">Singer</a></td></tr><tr><th>작사</th><td>Writer</td></tr><tr><th>Extra</th><td>Kept <b>value</b></td></tr></table>'
GENIE = "<script>var iSnsSeq = '123';</script><script type=\"application/ld+json\">{\"@type\":\"MusicRecording\",\"name\":\"Song\"}</script><ul><li><span class=\"attr\"><img src=\"txt_5.png\"></span><span class=\"value\"><a onclick=\"fnGoMore('artistInfo','7')\">Singer</a></span></li><li><span class=\"attr\"><img src=\"txt_6.png\"></span><span class=\"value\"><a onclick=\"fnGoMore('albumInfo','9')\">Album</a></span></li><li><span class=\"attr\"><img src=\"txt_8.png\"></span><span class=\"value\">03:19</span></li></ul>"


@pytest.mark.parametrize("provider", LISTS)
def test_rows_of_a_list(spark, provider):
    many = "".join(f'<tr trackid="{200 + i // 2}"><td class="title">T{i}</td></tr>' for i in range(60))
    bodies = [(1, provider, LISTS[provider]), (2, provider, "<html><h1>Site Unavailable</h1></html>"), (3, provider, None), (4, "bugs", LISTS["bugs"] + many), (5, provider, '<tr trackid="../1"><td class="title">x'), (7, "bugs", '<table><tr trackid="1"><td class="title">One<td><table><tr><td>inner</table><tr trackid="2"><td class="title">Two'), (6, provider, "<" * 300 + "<tr><b>" * 300)]
    got = C.listed_songs(spark.createDataFrame(bodies, "query_id long, provider string, body string")).collect()
    one = [r for r in got if r["query_id"] == 1]
    assert [(r["rank"], r["id"], r["title"], r["album_id"], r["album"], [tuple(a) for a in r["artists"]]) for r in one] == [(1, "123", "Song", "9", "Album", [("7", "Singer")])]
    assert {r["query_id"] for r in got} == {1, 4, 7}
    assert [(r["id"], r["title"]) for r in got if r["query_id"] == 7] == [("2", "Two")]  # a row in a row takes its place
    assert [r["id"] for r in got if r["query_id"] == 4] == ["123", *[str(200 + i) for i in range(9)]]


def test_a_page_confirms_its_song(spark):
    melon = PAGE.replace("https://music.bugs.co.kr/track/123", "http://www.melon.com/song/detail.htm?songId=123")
    bodies = [(1, "bugs", "123", PAGE), (2, "bugs", "999", PAGE), (3, "melon", "123", melon), (4, "genie", "123", GENIE), (5, "genie", "124", GENIE), (6, "bugs", "123", "<html>"), (7, "bugs", "123", PAGE.replace('"name":"Song",', "")), (8, "bugs", "123", None)]
    got = {r["query_id"]: r for r in C.song_pages(spark.createDataFrame(bodies, "query_id long, provider string, native_id string, body string")).collect()}
    assert set(got) == {1, 3, 4}
    for r in got.values():
        assert (r["id"], r["title"], r["album_id"], r["album"], r["duration_ms"], [tuple(a) for a in r["artists"]]) == ("123", "Song", "9", "Album", 199000, [("7", "Singer")])
    assert got[1]["fields"]["Extra"] == "Kept value" and got[1]["image"] == "https://img.example/1.jpg" and got[1]["release_date"] == "2020-08-21"
