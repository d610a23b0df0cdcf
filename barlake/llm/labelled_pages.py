"""Labelled pages: (html, main text).  The weights of the page operator are learned from these.

The pages are invented by a rule from layouts, names of elements and two sets
of words, one for main texts and one for everything else, so any number of
them can be made and held out.
"""

from __future__ import annotations

from random import Random

# Names that page authors give to elements, by what they hold.
#: Parts around a main text; the last word of a name says what the element is.
FURNITURE = (
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent discussion disqus "
    "footer gdpr masthead menu menubar modal nav navbar navigation newsletter notice notices notification pager pagination popup promo "
    "promotion recommended related replies reply respond responses feedback search share sharing sidebar sidenav social sponsor sponsored "
    "subscribe subscription toolbar widget widgets login signup byline contentinfo complementary alert dialog reviews trending"
).split()
#: First words that make a neutral name one of those.
SIGNS = "ad advert banner comment comments cookie footer menu nav newsletter partner popular promo related recommended share sidebar social sponsored subscribe trending user widget reader".split()
NEUTRAL = "content box list block wrapper section area links bar form panel inner container items".split()
PLACES = "site page article post main left right top bottom blog global entry story the".split()
MAIN = "content body text article post entry story copy prose main inner wrapper container column area".split()
OWNERS = "article post entry story content single news".split()
TOPICS = "news sport science travel books music food city law work health".split()
MAIN_WORDS = (
    "bridge river stone mortar carts dawn masons north arch water toll harbour clerk height tides month storm bell seeds paper bag winter cold "
    "peas beans air write date hang mice years keep dry town count second built opened found held where after before never always under over "
    "and the of in to that had with when while which would could each".split()
)
OTHER_WORDS = "home contact about terms privacy login account cheap lamps today buy free offer click read more next previous best ten ways rice roads top latest agree thanks great nice share save sign letter follow us".split()


def element(tag: str, attributes: str, inside: str) -> str:
    return f"<{tag} {attributes}>{inside}</{tag}>"


class Page:
    """A page in the making."""

    def __init__(self, seed: int):
        self.rng, self.main = Random(seed), []

    def words(self, pool: list[str], low: int, high: int) -> str:
        text = " ".join(self.rng.choices(pool, k=self.rng.randint(low, high)))
        return text[0].upper() + text[1:] + "."

    def named(self, name: str) -> str:
        return f'{self.rng.choice(["class", "class", "class", "id"])}="{name}"'

    def prose(self, tag: str = "p") -> str:
        low, high = self.rng.choice([(3, 8), (20, 60), (30, 90)])
        text = self.words(MAIN_WORDS, low, high)
        self.main.append(text)
        if self.rng.random() < 0.15 and len(text) > 60:
            a = text.index(" ", 20)
            b = text.index(" ", a + 4)
            text = f'{text[:a]} <a href="/x">{text[a + 1:b]}</a>{text[b:]}'
        elif self.rng.random() < 0.2:
            mark = self.rng.choice(["b", "i", "em", "strong", "code"])
            text = f"<{mark}>{text}</{mark}>" if self.rng.random() < 0.5 else f"<{mark}>{text}<br>"
        return f"<{tag}>{text}</{tag}>"

    def link(self) -> str:
        return f'<a href="/{self.rng.randint(1, 99)}">{self.words(OTHER_WORDS, 1, 6)}</a>'

    def box(self) -> str:
        """A part of the page around the main text."""
        r = self.rng
        inside = r.choice([
            lambda: f"<ul>{''.join(f'<li>{self.link()}</li>' for _ in range(r.randint(3, 8)))}</ul>",
            lambda: f"<p>{self.words(OTHER_WORDS, 5, 30)}</p>",
            lambda: f"<h3>{self.words(OTHER_WORDS, 1, 4)}</h3>" + "".join(f"<div><b>{self.words(OTHER_WORDS, 1, 2)}</b><p>{self.words(OTHER_WORDS, 5, 25)}</p></div>" for _ in range(r.randint(1, 5))),
            lambda: f"{self.words(OTHER_WORDS, 3, 12)} {self.link()}",
        ])()
        tag = r.choice(["div", "div", "div", "section", "aside", "nav", "footer", "form", "ul"])
        if tag == "ul":
            inside = "".join(f"<li>{self.link()}</li>" for _ in range(r.randint(3, 8)))
        if tag in ("aside", "nav", "footer", "form") and r.random() < 0.5:
            return f"<{tag}>{inside}</{tag}>"
        if tag == "div" and r.random() < 0.05:
            return f"<div {r.choice(['hidden', 'aria-hidden=\"true\"', 'style=\"display:none\"'])}>{inside}</div>"
        kind = r.random()
        name = r.choice(FURNITURE) if kind < 0.5 else f"{r.choice(PLACES)}-{r.choice(FURNITURE)}" if kind < 0.75 else f"{r.choice(SIGNS)}-{r.choice(NEUTRAL)}"
        if r.random() < 0.2:
            name += " " + r.choice(["clearfix", "row", "col", r.choice(PLACES)])
        return f"<{tag} {self.named(name)}>{inside}</{tag}>"

    def heading(self) -> str:
        r, h = self.rng, f"<h1>{self.words(MAIN_WORDS, 3, 8)}</h1>"
        self.main.append(h[4:-5])
        kind = r.random()
        if kind < 0.2:
            return f"<header>{h}</header>"
        if kind < 0.45:
            return element(r.choice(["header", "div"]), f'class="{r.choice(OWNERS)}-header"', h)
        return h

    def body(self) -> str:
        parts = [self.heading()]
        for _ in range(self.rng.randint(2, 7)):
            kind = self.rng.random()
            if kind < 0.8:
                part = self.prose()
                around = self.rng.choice(["", "", "", "", "", "section", "div"])
                parts.append(f"<{around}>{part}{self.prose()}</{around}>" if around else part)
            elif kind < 0.88:
                parts.append("<ul>" + "".join(self.prose("li") for _ in range(3)) + "</ul>")
            elif kind < 0.94:
                parts.append(f"<blockquote>{self.prose()}</blockquote>")
            else:
                parts.append(f"<h2>{self.prose('span')}</h2>")
            if self.rng.random() < 0.12:
                parts.append(self.box())
        parts.append(self.prose())
        return "".join(parts)

    def article(self) -> str:
        r, body = self.rng, self.body()
        kind = r.random()
        if kind < 0.25:
            return f"<article>{body}</article>"
        if kind < 0.5:
            tagged = " ".join(f"{k}-{r.choice(TOPICS + FURNITURE)}" for k in ("category", "tag") for _ in range(r.randint(0, 2)))
            return f'<article id="post-{r.randint(1, 999)}" class="post hentry status-publish {tagged}">{body}</article>'
        if kind < 0.6:
            return f"<main>{body}</main>"
        if kind < 0.7:
            return f"<div><div>{body}</div></div>"
        name = r.choice(MAIN) if r.random() < 0.5 else f"{r.choice(OWNERS)}-{r.choice(MAIN)}"
        return element(r.choice(["div", "section"]), self.named(name), body)

    def html(self) -> str:
        r = self.rng
        before = "".join(self.box() for _ in range(r.randint(1, 3)))
        if r.random() < 0.4:
            before = element(r.choice(["header", "div"]), self.named(r.choice(["site", "page", "global", "main"]) + "-header"), f"{self.link()} {self.link()}") + before
        page = before + self.article() + "".join(self.box() for _ in range(r.randint(1, 4)))
        if r.random() < 0.4:
            around = r.choice(["has-sidebar", "with-sidebar", "no-sidebar", "layout-with-sidebar", "right-sidebar", "page-wrapper", "container", "site", "page"])
            page = f"<div {self.named(around)}>{page}</div>"
        if r.random() < 0.3:
            page += f"<footer>&copy; {self.words(OTHER_WORDS, 3, 15)}</footer>"
        return f"<!DOCTYPE html><html><head><title>{self.words(OTHER_WORDS, 2, 5)}</title><style>p{{margin:0}}</style></head><body>{page}</body></html>"


def labelled_pages(count: int, seed: int = 0) -> list[tuple[str, str]]:
    """Pages with their main texts; other seeds give other pages."""
    out = []
    for k in range(count):
        page = Page(seed * 1_000_000 + k)
        html = page.html()
        out.append((html, " ".join(page.main)))
    return out
