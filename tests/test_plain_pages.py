"""Pages of the common form are read by patterns, with what the incremental tokenizer gives."""

import random

import pytest

from melder.sources import catalogue_pages as C

PIECES = ["<table>", "</table>", "<tr>", '<tr trackid="12">', "<tr songid='13'>", "</tr>", "<td>", "<TD>", "</td>", "<li>", "<br>", "<a class='title'>", '<a href="/artist/7">', "<a onclick=\"fnViewAlbumLayer('9')\">", "</a>", "<span class='icon'>", "</span>", "Song &amp; 1", "x &copy y &#65; &unknown;", "\n ", "A > B", '<img src="//i.example/&amp;1.jpg">', "<td class='title' Class=\"x\">", "</nothing>", "<p\nclass='title'>"]
ODD = ["<br/>", "<!-- x <b> -->", "<a href=x>", "< b", "<script>var a = '<tr>';</script>", "<td class>", "<", "&", "<?x?>", "</a >", "<a href='a>b'>", "<style>td{}</style>", "<![CDATA[x]]>", "<title><b>", "<textarea></tr>"]


def seen(body, plain):
    page, calls = C.Rows("bugs"), []
    for name in ("started", "ended"):
        f = getattr(page, name)
        setattr(page, name, lambda *a, f=f, name=name: (calls.append((name, *map(repr, a))), f(*a)))
    if plain:
        page.read(body)
    else:
        page.feed(body)
        page.close()
        while page.open:
            page._end()
    return page.found, calls


@pytest.mark.parametrize("pieces", [PIECES, PIECES + ODD])
def test_patterns_give_what_the_tokenizer_gives(pieces):
    dice = random.Random(5)
    plain = 0
    for _ in range(3000):
        body = "".join(dice.choices(pieces, k=dice.randint(0, 25)))
        plain += C.PLAIN.fullmatch(body) is not None
        assert seen(body, True) == seen(body, False), body
    assert plain > 100


def test_the_common_form_takes_no_tokenizer(monkeypatch):
    monkeypatch.setattr(C.Rows, "feed", None)
    page = C.Rows("bugs")
    page.read('<html><table><tr trackId="1"><th><p class="title"><a>Song &amp; 1</a></p></th><td><a href="/artist/2">Singer</a></td></tr></table></html>')
    assert [(r["id"], r["title"], r["artists"]) for r in page.found] == [("1", "Song & 1", {"2": "Singer"})]
