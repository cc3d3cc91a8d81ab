"""Words of class, id and role names that tell what a block of a page is.

A name counts as a whole: its words tell only if every one of them does or is a plain word of layout. "related-posts" is
a list of links, "related-work" a section of a paper; "share-buttons" are buttons, a "share-price" is news.
"""

from __future__ import annotations

import re
from functools import lru_cache

#: Words of what is not the article.
OTHER_MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation "
    "menu breadcrumb breadcrumbs sidebar aside complementary header footer foot contentinfo masthead topbar toolbar pagination pager "
    "cookie cookies consent gdpr notice notices notification popup modal overlay alert newsletter subscribe subscription signup login "
    "share sharing social related recommended recommendations widget search searchbox skip paywall".split()
)
COMMENT_MARKS = frozenset("comment comments commentlist disqus respond".split())
MAIN_MARKS = frozenset("main content article post entry story articlebody maincontent".split())
#: Those that are not the article even inside it.
INSIDE_MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsored promo nav navbar navigation breadcrumb breadcrumbs sidebar "
    "pagination cookie cookies consent gdpr notice notices popup modal newsletter share sharing sharebar related recommended "
    "comment comments commentlist disqus respond paywall".split()
)
#: Words of layout, which say nothing by themselves.
PLAIN_WORDS = frozenset(
    "area bar block body bottom box button buttons card cards center column columns container desktop fixed float foot form grid group "
    "head heading icon icons inline inner inside item items js large layer left link links list lists main mobile module outer page pages "
    "panel placeholder position post posts primary region right row rows section site slot small space stories sticky story tab tabs tile title top "
    "unit view wrap wrapper wrapping zone article articles content".split()
)
#: Words of names such as "has-sidebar" and "no-ads", which tell of something else than the element.
_ASIDE = frozenset("with without has no free".split())
_TELLING = OTHER_MARKS | COMMENT_MARKS | MAIN_MARKS | INSIDE_MARKS
_WORDS = re.compile(r"[a-z]+")


@lru_cache(maxsize=10_000)
def told(names: str) -> tuple[frozenset[str], bool]:
    """The telling words of a list of names, and whether one of them is no part of an article even inside it.

    Reader comments are told by names of nothing else: a "social-comment" may well be an article's.
    """
    words, aside = set(), False
    for name in names.lower().split():
        own = frozenset(w for w in _WORDS.findall(name) if len(w) > 2 or w in _TELLING | _ASIDE)  # the rest is made by tools
        if own & _ASIDE or not own <= _TELLING | PLAIN_WORDS:
            continue
        words |= own & _TELLING
        rest = own - PLAIN_WORDS
        aside |= bool(rest & INSIDE_MARKS) and (not rest & COMMENT_MARKS or rest <= COMMENT_MARKS)
    return frozenset(words), aside
