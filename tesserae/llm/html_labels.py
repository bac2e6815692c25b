"""A small labelled table of pages. Blocks of article text start with a plus sign; all others are furniture.

Lengths of both kinds run over the same range and names of classes often say nothing or the wrong thing, so neither
a length nor a name decides by itself.
"""

LENGTHS = (1, 2, 3, 4, 6, 8, 10, 12, 15, 20, 30, 60, 120)

_NAV = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News and views</a></li><li><a href="/c">About</a></li></ul></nav>'
_MENU = '<div class="top-menu"><a href="/">Start</a> <a href="/x">Products</a> <a href="/y">Support desk</a></div>'
_BARE = '<div><a href="/">Start</a> <a href="/x">Products</a> <a href="/y">Support desk</a></div>'
_FOOT = "<footer>&copy; 2020 example.org &middot; All rights reserved by the people who made this.</footer>"


def _w(n: int) -> str:
    return " ".join(["word"] * n) + "."


def _linked(n: int) -> str:
    """A sentence with a link of two words in it."""
    return f'{_w(n)} as told in <a href="/r">earlier reports</a>'


def _pages(n: int, other: int) -> tuple[str, ...]:
    """Pages of the usual forms, with blocks of n words and of another number of them."""
    return (
        f'<html><head><title>T</title></head><body>{_NAV}<div class="ad">{_w(n)}</div><article><h1>+{_w(min(n, 9))}</h1><p>+{_w(other)}</p><p>+{_w(n)}</p></article><footer>{_w(other)}</footer></body></html>',
        f'<body>{_NAV}<div class="ad">{_w(other)}</div><article><h1>+{_w(min(other, 9))}</h1><p><b>+{_w(3)}<br><p>+{_w(n)}</p><p>+{_linked(n)}</p></article>{_FOOT}',
        f"<body><header><p>{_w(n)}</p></header>{_NAV}<main><h2>+{_w(4)}</h2><p>+{_w(other)}</p><ul><li>+{_w(n)}</li><li>+{_w(2)}</li></ul><p><a href='/s'>+{_w(n)}</a></p></main><aside><h3>{_w(2)}</h3><p>{_w(n)}</p></aside>{_FOOT}</body>",
        f'<body>{_MENU}<div class="cookie-notice"><p>{_w(n)}</p><button>Yes</button></div><article><p>+{_w(other)}</p><p>+{_w(n)}</p><section class="comments"><h3>Comments</h3><p>{_w(n)}</p><p>{_w(other)}</p></section></article><form><label>Mail</label><p>{_w(n)}</p></form></body>',
        f'<body>{_MENU}<div id="content"><h1>+{_w(3)}</h1><p>+{_w(60)}</p><p>+{_w(n)}</p><p>+{_w(60)}</p></div><div class="sidebar"><p>{_w(n)}</p><ul><li><a href="/1">{_w(n)}</a></li></ul></div><div id="footer">{_w(n)}</div></body>',
        f"<body>{_BARE}<div><p>+{_w(90)}</p><p>+{_w(n)}</p><p>+{_w(40)}</p><p>+{_linked(40)}</p></div><div><a href='/p'>{_w(n)}</a> | <a href='/n'>{_w(2)}</a></div><div>{_w(1)}</div></body>",
        f'<body><div class="content"><a href="/1">{_w(n)}</a> <a href="/2">{_w(other)}</a></div><div class="main">{_BARE}</div></body>',
        f'<body>{_BARE}<div class="discussion"><p>+{_w(90)}</p><p>+{_w(n + 20)}</p></div><div class="links"><a href="/1">{_w(n)}</a></div></body>',
        f"<body>{_NAV}<article><h1>+{_w(n)}</h1></article><footer>{_w(n)}</footer></body>",
        f"<article><p>+{_w(n)}",
        f'<article><header><h1>{_w(n)}</h1></header><p>+{_w(n)}</p><table><tr><td>+{_w(n)}</td><td>+{_w(1)}</td></tr></table><div class="share"><a href="#">{_w(1)}</a> {_w(n)}</div><div class="newsletter-signup"><p>{_w(n)}</p></div></article>',
        f"<p>+{_w(60 + n)}</p><p>+{_w(50)}</p>",
        f"<article><p>+{_linked(n)}</p><p>+{_w(other)}</p></article>",
        f"<body>{_NAV}<article><p>+{_linked(other)}</p><p>+{_linked(n)}</p><p>+{_w(n)}</p></article></body>",
        f"<main><nav><ul><li><a href='/1'>{_w(min(n, 4))}</a></li><li><a href='/2'>{_w(other)}</a></li></ul></nav><article><p>+{_w(n)}</p><ul><li><a href='/3'>+{_w(n)}</a></li><li><a href='/4'>+{_w(other)}</a></li></ul><p>+{_w(other)}</p></article><div class='related'><a href='/5'>{_w(n)}</a></div></main>",
        f"<body><div><p>+{_linked(30 + n)}</p><p>+{_w(30 + n)}</p></div><div class='comments'><p>{_linked(n)}</p><p>{_w(n)}</p><p>{_w(other)}</p></div></body>",
        f"<body><article><p>+{_linked(n)}</p><p>+{_w(n)}</p></article><footer><a href='/6'>{_w(n)}</a> {_w(other)}</footer><div class='cookie-banner'>{_w(n)}</div></body>",
    )


LABELLED_PAGES = tuple(page for at, n in enumerate(LENGTHS) for page in _pages(n, LENGTHS[-1 - at]))
