"""The labelled pages that grow the decision tree: elements with data-main="1" hold main text."""

_LONG = "The survey found that most farms along the river had changed their crops within ten years, and that water prices mattered more than the weather did."
_NEXT = "Nobody expected the figures to move so quickly. Two of the three stations were rebuilt in spring, while the last one still sends its readings by post."

_SHORT = ["It was cold.", "Few came", "Silence.", "So much for that"]
_ITEMS = ["Home.", "All the news", "Ten things that the council did not say last week.", "About this site", "Why the old harbour of the town will never be the same", "Letters."]
_LINES = ["Today.", "Page 3 of 9", "Printed at noon.", "Last change in May"]


def _unnamed(texts: list[tuple[str, int]], tag: str) -> str:
    """A page of plain blocks, none of them named: (text, 1 for main text) each."""
    return "<body>" + "".join(f'<{tag} data-main="{label}">{text}</{tag}>' for text, label in texts) + "</body>"


def _menu(names: list[str]) -> list[tuple[str, int]]:
    return [(f'<a href="/{i}">{name}</a>', 0) for i, name in enumerate(names)]


def _around(article: list[tuple[str, int]], k: int) -> list[tuple[str, int]]:
    """An article between two menus with a line among the first's items and one after the second's."""
    menu, line = _menu(_ITEMS), _LINES[k % 4]
    return [*menu[:2], (line, 0), *menu[2:], *article, *menu[k % 3 :], (_LINES[(k + 1) % 4], 0)]


#: Pages without a name or a telling tag. Short lines are main text between long ones, and not among menus or at an end;
#: linked lines are main text within an article, and not among other links. Full stops tell nothing here.
_UNNAMED = [_unnamed(_around([(_LONG, 1), (_SHORT[k % 4], 1), (_NEXT, 1), (_SHORT[(k + 1) % 4], 1), (_LONG, 1)], k), tag) for tag in ("div", "p") for k in range(4)] + [
    _unnamed(_around([(_NEXT, 1), ('<a href="/more">See the whole survey and its tables</a>', 1), (_LONG, 1)], k), tag) for tag in ("div", "p") for k in range(2)
]

#: Linked headlines beside an article, in named surroundings.
_RELATED = [
    f'<body><article data-main="1"><h1>Tides</h1><p>{_LONG}</p><p>{_NEXT}</p></article><{tag}><h3>More</h3><p><a href="/1">{_ITEMS[2]}</a></p><p><a href="/2">{_ITEMS[4]}</a></p><p><a href="/3">{_ITEMS[1]}</a></p></{tag.split()[0]}></body>'
    for tag in ("aside", 'div class="related"', "nav")
]

#: Within an article that is named or tagged as one everything is main text, whatever stands beside it.
_TAGGED = [
    "<body>" + "".join(f"<p>{t}</p>" for t, _ in _menu(_ITEMS)) + f'<{tag} data-main="1">' + "".join(f"<{inner}>{t}</{inner}>" for t in texts) + f"</{tag.split()[0]}>" + "".join(f"<p>{t}</p>" for t, _ in _menu(_ITEMS[k:])) + "</body>"
    for k, tag in enumerate(("article", "main", 'div class="content"', "article"))
    for inner in ("p", "div")
    for texts in ([_SHORT[k], f'<a href="/x">{_ITEMS[k]}</a>', _SHORT[1], _LONG, _SHORT[2]], ["x", _SHORT[k], f'<a href="/y">{_ITEMS[2]}</a>'], [_NEXT, _SHORT[k]])
]

PAGES = _UNNAMED + _RELATED + _TAGGED + [
    f'<html><head><title>River farms</title></head><body><header><a href="/">Daily</a> <a href="/n">News</a></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">World</a></li><li><a href="/c">Sport</a></li></ul></nav><article data-main="1"><h1>River farms</h1><p>{_LONG}</p><p>Prices rose.</p><p>{_NEXT}</p></article><footer>&copy; Daily &middot; All rights kept by the owner.</footer></body></html>',
    f'<body><nav><a href="/1">Start</a> <a href="/2">Shop</a></nav><div class="ad">Buy two lamps and get the third one free this week.</div><article data-main="1"><h1>Lamps of the north</h1><p>{_NEXT}<p>It was late.<p>{_LONG}</article><div class="ad">Win a trip. Enter today and tell a friend about it.</div><footer>Contact us by letter.</footer></body>',
    f'<body><div id="menu"><ul><li><a href="#">One</a><li><a href="#">Two</a></ul></div><div id="content"><div data-main="1"><h2>Bread</h2><p>{_LONG}</p><ul><li>Mix the flour with water and salt.</li><li>Wait for an hour.</li></ul><p>{_NEXT}</p></div></div><div id="sidebar"><h3>Related</h3><p>Ten more loaves that you will like to bake at home.</p></div></body>',
    f'<body><div class="cookie-notice"><p>We use cookies to make this page work better for you. Read how we do this.</p></div><main data-main="1"><h1>Old bridges</h1><p>{_LONG}</p><blockquote>{_NEXT}</blockquote><p>See the <a href="/map">map</a> for more.</p></main><section class="comments"><p>I crossed that bridge last year and it was in a poor state, sadly.</p><p>Nice read, thanks a lot.</p></section></body>',
    f'<body><div><a href="/">Home</a> <a href="/x">About us</a> <a href="/y">Jobs</a></div><div data-main="1"><p>{_LONG}</p><p>{_NEXT}</p><p>{_LONG} {_NEXT}</p></div><div><a href="/p">Privacy</a> <a href="/t">Terms of use</a></div><div>Copyright 2020</div></body>',
    f'<body><form><p>Sign up for our letter and never miss a story from the coast again.</p><label>Mail</label></form><article data-main="1"><header><h1>Coast</h1></header><p>{_NEXT}</p><p>So be it</p><p>{_LONG}</p></article><aside><p>{_NEXT}</p></aside></body>',
    f'<body><table><tr><td><a href="/1">Index</a></td><td><a href="/2">Archive</a></td></tr></table><div data-main="1"><h1>Letters</h1>{_LONG}<br>{_NEXT}<p>{_LONG}</p></div><p><a href="/next">Next page</a></p><hr><div>Made by hand</div></body>',
    '<body><nav><ul><li><a href="/q">Q</a></li></ul></nav><article data-main="1"><h1>A short note</h1><p>Gone fishing</p><p>Back soon.</p></article><footer>&copy; 2021 the author</footer></body>',
    '<body><article data-main="1"><h1>Signs</h1><p><a href="/s">The first sign</a></p><p>It fell.</p></article><div class="promo"><p>Our best offers of the season are here, so do come in and look around.</p></div></body>',
    f'<body><div class="post" data-main="1"><h2><a href="/p">On walls</a></h2><p>{_NEXT}</p><p>{_LONG}</p></div><div class="share"><a href="/f">Share</a> <a href="/m">Mail</a></div><div class="comment"><p>{_LONG}</p></div><div class="comment"><p>Agreed.</p></div></body>',
    f'<body><header><p>The paper that has been read in the valley since 1890 by all.</p></header><main data-main="1"><section><h1>Valley</h1><p>{_LONG}</p></section><section><h2>Then</h2><p>{_NEXT}</p></section></main><footer><p>{_NEXT}</p></footer></body>',
    '<body><p><a href="/1">Login</a></p><p><a href="/2">Register now</a></p><div>Search</div><div>Results 1 to 10</div></body>',
    f'<body><div><div><a href="/">Front</a></div><div><a href="/2">Second page of the site</a></div></div><div data-main="1"><div><h1>Mills</h1></div><div>{_NEXT}</div><div>{_LONG}</div><div>{_NEXT}</div></div><div class="comments"><div>{_LONG} {_NEXT}</div><div>{_NEXT} {_LONG}</div><div>{_LONG}</div></div></body>',
    f'<body><aside><p>{_NEXT}</p><p>{_LONG}</p><p>{_LONG} {_NEXT}</p></aside><div data-main="1"><p>{_LONG} {_NEXT}</p><p>{_NEXT} {_LONG}</p></div><footer><p>{_LONG}</p><p>{_NEXT}</p></footer></body>',
    f'<body><div class="notice"><p>{_LONG}</p><p>{_NEXT}</p></div><div><p data-main="1">{_NEXT}</p><p data-main="1">{_LONG} {_NEXT}</p></div><form><p>{_NEXT}</p><p>{_LONG}</p></form></body>',
    f'<body><div class="widget"><p>{_LONG} {_NEXT}</p><p>{_NEXT}</p></div><article data-main="1"><h1>Wells</h1><p>{_NEXT}</p><p>Deep.</p><p>{_LONG}</p><aside data-main="0"><p>{_LONG}</p><p>{_NEXT}</p></aside><div class="ad" data-main="0"><p>Cheap pumps for every garden, only this month.</p></div><p>{_NEXT}</p><footer data-main="0"><p>Filed under water.</p></footer></article></body>',
    f'<article data-main="1"><h1>Tides</h1><p>{_LONG}</p><p>So it went.</p></article>',
    f'<body><article data-main="1"><p>{_NEXT}</p></article></body>',
    f'<body><nav><a href="/">Back</a></nav><main data-main="1"><h1>Kites</h1><p>They fly.</p><p>{_NEXT}</p></main></body>',
    f'<body><div data-main="1"><h1>Stones</h1><p>{_LONG}</p><p>{_NEXT}</p></div></body>',
    f'<body><p data-main="1">{_LONG} {_NEXT}</p><div>Printed at noon</div></body>',
    '<body><div>Page 3 of 9</div><div>Updated</div></body>',
    '<body><div><a href="/o">Older</a></div><div>Top</div></body>',
]
