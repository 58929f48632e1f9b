"""Main text of HTML pages: gradient-boosted trees over DOM nodes, decoded down the tree.

A node's features are its tag, tokens of its class, id and role, depth, sibling statistics, subtree text and link density,
its place on the page, and words of its opening or of a short heading before it that name what is no article (CUE).
Text that stands beside blocks or between double line breaks gets a node of its own (RUN), so loose menus and footers can be
dropped too. The trees are trained here, on pages drawn from a seeded generator of page layouts (SAMPLE pages): a node is
positive if it holds main text. In a tenth of the pages class names say nothing; in two fifths tags do not either, and divs,
tables, line breaks make the layout. Decoding takes the labelling of most log odds in which no kept node lies under a
dropped one.
Scripts, styles, templates and form controls are never text;
a form is a node like any other, known by its controls, so a page that is one form keeps its article.

A block is a run of text between block-level tags; <br> is white space. Null and empty pages, and pages without main
text, give the empty text, an empty table an empty result. Repeated rows are extracted each. Other columns are not read. Pages are parsed whole.
"""

from __future__ import annotations

import re
from collections import defaultdict
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE, TREES, DEPTH, RATE, BINS = 500, 60, 4, 0.2, 33
RUN, MARK, HEAD, SHORT = "#run", "\ue000", 60, 80  # MARK: main text that has no tag, in drawn pages
# HTML's own tag classes.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
NEVER = {"script", "style", "noscript", "template", "head", "title", "iframe", "svg", "object", "button", "select", "option", "textarea", "canvas", "datalist"}
CONTROLS = {"input", "textarea", "select", "button"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
CLOSES_P = BLOCK - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
P_WALLS = {t: {"td", "th", "table", "div", "article", "section", "aside", "li", "blockquote"} - {t} for t in CLOSES_P}
SAME = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
TAGS = ("div", "p", "a", "ul", "ol", "li", "nav", "header", "footer", "aside", "article", "main", "section", "h1", "h2", "h3", "span", "b", "i", "em", "strong", "table", "tr", "td", "blockquote", "pre", "figure", "body", "html", "form", "label", "fieldset", "dl", "dd", "font", "center", RUN)
UPS = ("article", "main", "body", "nav", "footer", "aside", "ul", "div", "section", "form", "td", RUN)
TAG_NO, UP_NO = ({t: i for i, t in enumerate(x)} for x in (TAGS, UPS))
LOGS = [16, 19, 20, 25]  # the features that count characters
# Attribute tokens that page authors use.
GOOD = ("article", "content", "post", "entry", "story", "main", "text", "body", "page")
BAD = ("nav", "menu", "header", "footer", "sidebar", "side", "ad", "ads", "advert", "banner", "sponsor", "promo", "cookie", "consent", "notice", "comment", "comments", "share", "social", "related", "breadcrumb", "popup", "modal", "subscribe", "newsletter", "widget", "copyright", "login", "search", "toolbar", "discussion", "replies", "reply", "alert", "disclaimer", "recommended", "pagination")
# How the openings of comments, footers, notices and adverts read.
CUE = re.compile(r"©|\(c\)|copyright|all rights|\bcomments?\b|\brepl(?:y|ies)\b|\bresponses?\b|\bresponded\b|\bposted\b|\bsays:|\bwrote:|\bwrites:|\brelated\b|\brecommended\b|read (?:more|next)|most (?:read|popular)|\bsponsor|\badvert|\bpromot|\bcookie|\bconsent\b|\bsubscri|\bnewsletter|sign (?:up|in)|log ?in|\bshare\b|follow us|privacy|terms of|contact us|\babout us\b|\btags?:|filed under|\bsearch\b", re.I)
# The same over lower-case text, by first letters, a fifth of the time; for texts without the ODD letters that ignoring case
# also takes for i, k or s.
QUICK = re.compile(r"©|\(c\)|a(?:ll rights|(?<=\ba)(?:dvert|bout us\b))|c(?:o(?:pyright|ntact us)|(?<=\bc)o(?:mments?\b|okie|nsent\b))|f(?:ollow us|iled under)|log ?in|most (?:read|popular)|(?<=\bn)ewsletter|p(?:rivacy|(?<=\bp)(?:osted\b|romot))|r(?:ead (?:more|next)|(?<=\br)e(?:pl(?:y|ies)\b|sponses?\b|sponded\b|lated\b|commended\b))|s(?:ign (?:up|in)|(?<=\bs)(?:ays:|ponsor|ubscri|hare\b|earch\b))|t(?:erms of|(?<=\bt)ags?:)|(?<=\bw)(?:rote:|rites:)")
ODD = re.compile("[\u0130\u0131\u017f\u212a]")


class Node:
    __slots__ = ("tag", "tokens", "parent", "items", "text", "links", "depth", "nth", "good", "blocks", "controls", "sibs", "same", "head", "start", "most", "stops", "repeats", "after", "cue", "kids", "above", "worth")

    def __init__(self, tag: str, attrs, parent: Node | None):
        self.tag, self.parent, self.items = tag, parent, []
        words = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role")).lower() if attrs else ""
        self.tokens = set(re.findall(r"[a-z]+", words)) if words else ()
        self.good = bool(attrs) and any(k == "data-main" for k, _ in attrs)
        self.depth = parent.depth + 1 if parent else 0
        self.nth, self.sibs, self.same, self.start, self.most, self.after, self.worth = 0, 1, 1, 0, 0, False, 0.0


class Dom(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", (), None)
        self.at = self.root
        self.open: defaultdict = defaultdict(int)

    def updatepos(self, i: int, j: int) -> int:
        return j  # line numbers are not read

    def close_to(self, n: Node) -> None:
        """Closes the open nodes down to n, n included."""
        while self.at is not n.parent:
            self.open[self.at.tag] -= 1
            self.at = self.at.parent

    def shut(self, tags: set[str], walls: set[str]) -> None:
        n = self.at if any(self.open[t] for t in tags) else self.root
        while n.parent is not None and n.tag not in walls:
            if n.tag in tags:
                self.close_to(n)
                return
            n = n.parent

    def handle_starttag(self, tag, attrs):
        if tag == "html" and not self.root.items:
            return
        if self.open["p"] and tag in CLOSES_P:
            self.shut({"p"}, P_WALLS[tag])
        if tag in SAME:
            self.shut(*SAME[tag])
        node = Node(tag, attrs, self.at)
        self.at.items.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if not self.open[tag]:
            return
        n = self.at
        while n.tag != tag:
            n = n.parent
        self.close_to(n)

    def handle_data(self, data):
        self.at.items.append(data)


def size(text: str) -> int:
    """The length of a text, none for the bars and dots between links."""
    text = text.strip()
    return len(text) if len(text) > 3 or any(map(str.isalnum, text)) else 0


def cued(head: str) -> bool:
    """Whether CUE is found in a text."""
    if not head.isascii() and ODD.search(head):
        return CUE.search(head) is not None
    return QUICK.search(head.lower()) is not None


def loose(n: Node) -> None:
    """Puts runs of text and inline nodes that stand beside blocks, or between double line breaks, under nodes of their own."""
    if n.tag not in BLOCK or not n.items or (len(n.items) == 1 and n.parent is not None and n.tag != "body"):
        return
    if all(c.tag in BLOCK if isinstance(c, Node) else not c.strip() for c in n.items):
        return
    inline = [not isinstance(c, Node) or c.tag not in BLOCK for c in n.items]
    breaks = [isinstance(c, Node) and c.tag == "br" for c in n.items]
    if (n.parent is not None and n.tag != "body" and all(inline) and sum(breaks) < 2):
        return
    groups: list[list] = []
    run = brs = 0  # items of the open run, and line breaks at its end
    for c, inner, br in zip(n.items, inline, breaks):
        blank = isinstance(c, str) and not c.strip()
        if not inner or (run and brs > 1 and not br and not blank):
            run = brs = 0
        if not inner:
            groups.append([c])
            continue
        if not run:
            groups.append([])
        groups[-1].append(c)
        run, brs = run + 1, brs + 1 if br else brs if blank else 0
    held = [g for g in groups if any(not isinstance(c, Node) or c.tag not in BLOCK for c in g) and any(isinstance(c, Node) or c.strip() for c in g)]
    if len(held) == 1 and len(groups) == 1 and n.parent is not None and n.tag != "body":
        return
    n.items = []
    for g in groups:
        if not any(g is h for h in held):
            n.items.extend(g)
            continue
        node = Node(RUN, (), n)
        node.items, node.good = g, any(isinstance(c, str) and MARK in c for c in g)
        for c in g:
            if isinstance(c, Node):
                c.parent = node
        n.items.append(node)


def parse(html: str | None) -> list[Node]:
    """The nodes in page order, parents first, with subtree statistics."""
    dom = Dom()
    dom.feed(html or "")
    dom.close()
    nodes, stack = [], [dom.root]
    while stack:
        n = stack.pop()
        n.depth = n.parent.depth + (n.tag != RUN) if n.parent else 0
        nodes.append(n)
        if n.tag != RUN:
            loose(n)
        every = [c for c in n.items if isinstance(c, Node)]
        n.kids = len(every)
        if not every:
            n.repeats = 0
            continue
        tags: dict = {}
        for c in every:
            tags[c.tag] = tags.get(c.tag, 0) + 1
        n.repeats = max(tags.values())
        kids = [c for c in every if c.tag not in NEVER]
        for i, c in enumerate(kids):
            c.nth, c.sibs, c.same = i, n.kids, tags[c.tag]
        stack.extend(reversed(kids))
    for n in reversed(nodes):
        if len(n.items) == 1 and isinstance(n.items[0], str):  # most nodes hold one text
            c = n.items[0]
            n.text, n.stops, n.controls, n.blocks = size(c), c.count(".") + c.count(","), 0, n.tag in ("p", "h1", "h2", "h3", "li", RUN)
            n.links, n.most, n.head = n.text if n.tag == "a" else 0, 0, c[: 2 * HEAD].strip()[:HEAD]
            n.cue = n.text > 0 and cued(n.head)
            continue
        n.text = n.stops = n.links = n.controls = n.most = 0
        n.blocks = n.tag in ("p", "h1", "h2", "h3", "li", RUN)
        for c in n.items:
            if isinstance(c, str):
                n.text += size(c)
                n.stops += c.count(".") + c.count(",")
                continue
            n.controls += c.tag in CONTROLS
            if c.tag not in NEVER:
                n.text += c.text
                n.stops += c.stops
                n.links += c.links
                n.controls += c.controls
                n.blocks += c.blocks
                n.most = max(n.most, c.text)
        if n.tag == "a":
            n.links = n.text
        n.head = ""
        for c in n.items:
            part = c.strip()[:HEAD] if isinstance(c, str) else c.head if c.tag not in NEVER else ""
            if part:
                n.head = f"{n.head} {part}"[: HEAD + 1]
                if len(n.head) > HEAD:
                    break
        n.cue = n.text > 0 and cued(n.head)
    for n in nodes:
        if len(n.items) == 1 and isinstance(n.items[0], str):
            continue
        at, after = n.start, n.after
        for c in n.items:
            if isinstance(c, str):
                at += size(c)
            elif c.tag not in NEVER:
                c.start, c.after = at, after
                at += c.text
                after = after or (c.cue and c.text <= SHORT)
    return nodes


def features(nodes: list[Node]) -> np.ndarray:
    total = max(1, nodes[0].text)
    rows, tags, ups = [], [], []
    for n in nodes:
        good, bad = (len(n.tokens.intersection(GOOD)), len(n.tokens.intersection(BAD))) if n.tokens else (0, 0)
        up = n.parent.above if n.parent else (0, 0, 0)
        n.above = (up[0] + good + (n.tag in ("article", "main")), up[1] + bad + (n.tag in ("nav", "footer", "aside", "header")), up[2] + (n.cue and n.text <= 0.3 * total))
        most = n.parent.most if n.parent else n.text
        rows.append([good, bad, *n.above, n.cue, n.after, n.start / total, (total - n.start - n.text) / total, n.text / max(1, most), n.stops / max(1, n.text), n.repeats, n.depth, n.nth, n.sibs, n.kids, n.text, n.text / total, n.links / max(1, n.text), n.text / (1 + n.blocks), n.parent.text if n.parent else n.text, (n.parent.links / max(1, n.parent.text)) if n.parent else 0, n.same, n.controls, n.controls / max(1, n.blocks), n.text / (1 + n.controls), ])
        tags.append(TAG_NO.get(n.tag, -1))
        ups.append(UP_NO.get(n.parent.tag, -1) if n.parent else -1)
    one_hot = [np.array(x)[:, None] == np.arange(len(of)) for x, of in ((tags, TAGS), (ups, UPS))]
    x = np.array(rows, np.float32)
    x[:, LOGS] = np.log1p(x[:, LOGS])
    return np.hstack([x, *one_hot]).astype(np.float32)


def _telling(rng: np.random.Generator) -> str:
    """A page whose tags or class names mostly tell what they hold; data-main marks what holds main text."""
    pick = lambda *x: x[rng.integers(len(x))]
    words = lambda a, b: " ".join("x" * n for n in rng.integers(1, 9, rng.integers(a, b)).tolist()) + pick(".", "", "!")
    form = lambda: f'<form class="{pick("search", "login", "signup", "x", "")}"><label>{words(1, 4)}</label><input><p>{words(1, 20)}</p><label>{words(1, 4)}</label><textarea>{words(1, 4)}</textarea>{pick("", f"<p>{words(2, 30)}</p>")}<button>{words(1, 3)}</button></form>'
    links = lambda n: "".join(f'<li><a href="#">{words(1, 3)}</a></li>' for _ in range(n))
    maybe = lambda p, s: s if rng.random() < p else ""
    nav = lambda: pick(f"<nav><ul>{links(rng.integers(2, 9))}</ul></nav>", f'<div class="{pick("menu", "nav", "main-nav", "site-header")}"><ul>{links(rng.integers(2, 9))}</ul></div>', f"<header><p>{words(1, 6)}</p><nav>{links(4)}</nav></header>", f'<div id="header"><h2>{words(1, 5)}</h2></div>')
    junk = lambda: pick(*[f'<div class="{c}">{t}</div>' for c in [pick(*BAD[5:])] for t in (words(3, 40), f"<p>{words(3, 60)}</p>", f"<h3>{words(1, 4)}</h3><p>{words(5, 40)}</p><p>{words(5, 40)}</p>")] * 8, form(), form(), f"<aside><p>{words(3, 40)}</p></aside>", f"<aside><h3>{words(1, 4)}</h3><ul>{links(5)}</ul></aside>", f'<section id="comments"><div class="comment"><p>{words(3, 60)}</p></div><div class="comment"><p>{words(3, 60)}</p></div></section>')
    M = " data-main"

    def part() -> str:
        return pick(*[f"<p{M}>{words(1, 90)}</p>"] * 8, f"<p{M}><b{M}>{words(4, 40)}<br{M}>", f"<p{M}>{words(2, 30)} <a{M} href=x>{words(1, 4)}</a> {words(2, 30)}</p>", f"<h2{M}>{words(1, 8)}</h2>", f"<ul{M}><li{M}>{words(3, 20)}</li><li{M}>{words(3, 20)}</li></ul>", f"<blockquote{M}><p{M}>{words(5, 40)}</p></blockquote>", f"<p{M}>{words(2, 9)} <em{M}>{words(1, 4)}</em> <span{M}>{words(1, 9)}</span></p>", f"<table{M}><tr{M}><td{M}>{words(1, 5)}</td><td{M}>{words(1, 5)}</td></tr></table>", f"<pre{M}>{words(3, 30)}</pre>", f"<div{M}>{words(5, 50)}</div>", f"<p{M}>{pick(*OPENINGS, *CLOSINGS)}{pick('.', ' ' + words(1, 20))}</p>")

    inner = maybe(0.85, f"<h1{M}>{words(1, 14)}</h1>") + "".join(part() + maybe(0.07, junk()) for _ in range(rng.integers(30, 300) if rng.random() < 0.04 else rng.integers(1, 14)))
    tag = pick("article", "article", "article", "main", f'div class="{pick(*GOOD)}"', f'div id="{pick(*GOOD)}"', "section", "div")
    body = f"<{tag}{M}>{inner}</{tag.split()[0]}>"
    if rng.random() < 0.35:
        w = pick("main", "div", 'div class="container"', 'div id="wrapper"')
        body = f"<{w}{M}>{maybe(0.4, junk())}{body}{maybe(0.5, junk())}</{w.split()[0]}>"
    foot = pick(f"<footer>&copy; {words(1, 4)} {words(3, 25)}</footer>", f'<div class="footer"><p>{words(3, 30)}</p></div>', f"<footer><ul>{links(4)}</ul><p>{words(3, 20)}</p></footer>", "")
    page = f"{maybe(0.9, nav())}{maybe(0.7, junk())}{body}{maybe(0.5, junk())}{maybe(0.3, junk())}{foot}"
    if rng.random() < 0.12:  # pages that are one form
        page = f"<form{M} action=x><input type=hidden><input type=hidden>{page}</form>"
    return f"<html{M}><body{M}>{page}</body></html>"


# Closings of drawn footers, and openings of drawn junk.
CLOSINGS = ("All rights reserved", "Copyright x", "Contact us", "Privacy", "About us", "Terms of use")
OPENINGS = ("Comments", "3 comments", "12 Comments", "Leave a reply", "Replies", "5 responses", "Related", "Related stories", "Read more", "Read next", "Most read", "Advertisement", "Sponsored", "Subscribe to the newsletter", "We use cookies", "Share", "Follow us", "Posted by", "Sign up", "Tags: x", "Reader comments")


def _plain(rng: np.random.Generator) -> str:
    """A page in divs, a table or line breaks, where neither tags nor class names tell what they hold."""
    pick = lambda *x: x[rng.integers(len(x))]
    maybe = lambda p, s: s if rng.random() < p else ""
    word = lambda: "x" * int(rng.integers(1, 9))
    sentence = lambda: " ".join(word() for _ in range(rng.integers(4, 22))) + pick(".", ".", ".", "!", "")
    prose = lambda a, b: " ".join(sentence() for _ in range(rng.integers(a, b)))
    name = lambda a, b: " ".join(word() for _ in range(rng.integers(a, b)))
    M, sep = " data-main", pick(" | ", " ", " &middot; ", " - ", "<br>", "")
    link = lambda: f'<a href="#">{name(1, 4)}</a>'
    links = lambda n, by: by.join(link() for _ in range(n))
    many = lambda: int(rng.integers(2, 11))
    menu = lambda: pick(links(many(), sep), links(many(), sep), f"<ul>{''.join(f'<li>{link()}</li>' for _ in range(many()))}</ul>", f"<p>{links(many(), sep)}</p>", "".join(f"<div>{link()}</div>" for _ in range(many())), "".join(f"<span>{link()}</span>" for _ in range(many())))
    foot = lambda: pick(f"&copy; 20{rng.integers(10, 30)} {name(1, 5)}{maybe(0.5, '. ' + sentence())}", f"Copyright 20{rng.integers(10, 30)} {name(1, 5)}. {maybe(0.5, 'All rights reserved.')}", f"{links(many(), sep)} {maybe(0.6, '&copy; ' + name(1, 4))}", f"{name(2, 7)}{maybe(0.4, ' ' + link())} {maybe(0.6, 'Privacy ' + link())}", f"Contact us: {name(1, 7)}")
    foot_of = lambda: pick("{}", "<p>{}</p>", "<div>{}</div>", "<small>{}</small>", "<center>{}</center>").format(foot())

    def comments() -> str:
        who = lambda: pick(f"<b>{name(1, 3)}</b>", f"<div>{name(1, 3)}</div>", f"<p>{name(1, 3)} wrote:</p>", f"<span>{name(1, 3)}</span> <i>{rng.integers(1, 29)} {word()}</i>", f"<h4>{name(1, 3)}</h4>", f"<strong>{name(1, 3)}</strong> says:")
        shape, by = pick("<div>{}{}</div>", "<li>{}{}</li>", "<tr><td>{}</td><td>{}</td></tr>", "<dt>{}</dt><dd>{}</dd>", "<p>{} {}</p>"), pick("<p>{}</p>", "<p>{}</p>", "{}", "<div>{}</div>")
        all_ = "".join(shape.format(who(), (by if "<p>" not in shape else "{}").format(prose(1, 5))) for _ in range(rng.integers(1, 9)))
        around = {"<l": "ul", "<t": "table", "<d": "dl" if shape.startswith("<dt") else "div", "<p": "div"}[shape[:2]]
        head = maybe(0.85, pick("<h3>{}</h3>", "<h2>{}</h2>", "<p><b>{}</b></p>", "<div>{}</div>").format(pick(*OPENINGS[:6], OPENINGS[-1])))
        return pick(f"<div>{head}<{around}>{all_}</{around}></div>", f"{head}<{around}>{all_}</{around}>")

    def junk() -> str:
        head = pick(*OPENINGS[6:])
        return pick(f"<div>{head} {prose(1, 3)}</div>", f"<div><h3>{head}</h3>{menu()}</div>", f"<div><p>{head}: {sentence()}</p></div>", f"<div>{head}<br>{links(many(), '<br>')}</div>", f"<div><b>{head}</b><p>{prose(1, 3)}</p></div>", f"<div>{menu()}</div>")

    lines = rng.random() < 0.3
    if lines:  # paragraphs are runs between line breaks
        gap = pick("<br><br>", "<br><br>\n", "<br>\n<br>", "<br/><br/>")
        piece = lambda: f"{MARK}{prose(1, 7)}{maybe(0.15, f' <a{M} href=x>{name(1, 4)}</a> {sentence()}')}"
        title = pick(f"<h1{M}>{name(2, 9)}</h1>", f"{MARK}<b{M}>{name(2, 9)}</b>{gap}", f"<h2{M}>{name(2, 9)}</h2>", f"{MARK}{name(2, 9)}{gap}")
        body = title + gap.join(piece() for _ in range(rng.integers(2, 14)))
        top, low = pick(f"<div>{menu()}</div>", f"{links(many(), sep)}{gap}", f"{links(many(), sep)}{gap}", f"{links(many(), sep)}<hr>", ""), pick(f"{gap}{foot()}", f"<hr>{foot()}", f"{gap}{gap}{foot()}", f"<div>{foot()}</div>", f"{gap}{links(many(), sep)}{gap}{foot()}")
        mid = maybe(0.2, comments())
        if rng.random() < 0.3:
            tag = pick("div", "center")
            body = f"<{tag}{M}>{body}</{tag}>"
        return f"<html{M}><body{M}>{top}{body}{mid}{low}</body></html>"
    P = pick("p", "p", "p", "div")
    part = lambda: pick(*[f"<{P}{M}>{prose(1, 7)}</{P}>"] * 9, f"<{P}{M}>{sentence()} <a{M} href=x>{name(1, 4)}</a> {prose(1, 3)}</{P}>", f"<h2{M}>{maybe(0.03, pick(*OPENINGS) + ' ')}{name(1, 8)}</h2>", f"<ul{M}>{''.join(f'<li{M}>{sentence()}</li>' for _ in range(rng.integers(2, 7)))}</ul>", f"<blockquote{M}>{prose(1, 4)}</blockquote>", f"<{P}{M}><b{M}>{name(1, 4)}</b> {prose(1, 4)}</{P}>", f"{MARK}{prose(1, 4)}", f"<table{M}>{''.join(f'<tr{M}><td{M}>{name(1, 4)}</td><td{M}>{name(1, 4)}</td></tr>' for _ in range(rng.integers(2, 6)))}</table>")
    inner = maybe(0.85, pick("<h1{0}>{1}</h1>", "<h2{0}>{1}</h2>").format(M, name(2, 10)))
    inner += "".join(part() for _ in range(rng.integers(2, 16)))
    tail = maybe(0.35, comments())
    if rng.random() < 0.35:  # a table makes the page
        cells = [f"<td>{pick(menu(), junk(), menu() + junk())}</td>", f"<td{M}>{inner}{tail}</td>", maybe(0.4, f"<td>{pick(junk(), menu())}</td>")]
        rows = [maybe(0.7, f"<tr><td colspan=3>{pick(menu(), name(1, 5), name(1, 4) + menu())}</td></tr>"), f"<tr{M}>{''.join(cells if rng.random() < 0.7 else cells[1:])}</tr>", maybe(0.8, f"<tr><td>{foot_of()}</td></tr>")]
        page = f"<table{M}>{''.join(rows)}</table>{maybe(0.3, f'<div>{foot()}</div>')}"
    else:
        inside = rng.random() < 0.4  # comments inside what holds the article
        holder = f"<div{M}>{inner}{tail if inside else ''}</div>" if rng.random() < 0.75 else inner + (tail if inside else "")
        middle = f"{maybe(0.25, junk())}{holder}{'' if inside else tail}{maybe(0.4, junk())}"
        if rng.random() < 0.4:
            middle = f"<div{M}>{middle}</div>"
        page = f"{maybe(0.9, f'<div>{maybe(0.3, name(1, 5))}{menu()}</div>')}{middle}{maybe(0.85, f'<div>{foot_of()}</div>')}"
        if rng.random() < 0.3:
            page = f"<div{M}>{page}</div>"
    return f"<html{M}><body{M}>{page}</body></html>"


def drawn(rng: np.random.Generator) -> str:
    """A page of the generator: telling, the same with class names that say nothing, or plain."""
    kind = rng.random()
    if kind < 0.4:
        return _plain(rng)
    page = _telling(rng)
    if kind < 0.5:  # hashed or no class names, tags as they were
        page = re.sub(r' (class|id)="[^"]*"', lambda m: rng.choice(["", f' {m[1]}="{"".join(rng.choice(list("bcdfghjkz"), 5))}"']), page)
    return page


def _tree(bins: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int) -> tuple | float:
    G, H = g[rows].sum(), h[rows].sum()
    value = RATE * G / (H + 1)
    if depth == 0 or len(rows) < 20:
        return value
    part = bins[rows]
    flat = (part + np.arange(part.shape[1]) * BINS).ravel()
    gs, hs = (np.cumsum(np.bincount(flat, np.repeat(w[rows], part.shape[1]), part.shape[1] * BINS).reshape(-1, BINS), 1)[:, :-1] for w in (g, h))
    gain = gs**2 / (hs + 1) + (G - gs) ** 2 / (H - hs + 1) - G**2 / (H + 1)
    best = divmod(int(gain.argmax()), BINS - 1)
    if gain[best] <= 1e-3:
        return value
    left = part[:, best[0]] <= best[1]
    return *best, _tree(bins, g, h, rows[left], depth - 1), _tree(bins, g, h, rows[~left], depth - 1)


def _value(tree, bins: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(bins), tree)
    return np.where(bins[:, tree[0]] <= tree[1], _value(tree[2], bins), _value(tree[3], bins))


def _binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)]).astype(np.uint8).T  # column by column


@lru_cache(1)
def model(seed: int = 5) -> tuple:
    """(bin edges, trees, base log odds) of the boosted trees."""
    rng = np.random.default_rng(seed)
    x, y = [], []
    for _ in range(SAMPLE):
        nodes = parse(drawn(rng))
        x.append(features(nodes))
        y += [n.good or n.parent is None for n in nodes]
    x, y = np.vstack(x), np.array(y, float)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 32))) for j in range(x.shape[1])]
    bins, base = _binned(x, edges), float(np.log(y.mean() / (1 - y.mean())))
    score, trees = np.full(len(y), base), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        trees.append(_tree(bins, y - p, p * (1 - p), np.arange(len(y)), DEPTH))
        score += _value(trees[-1], bins)
    return edges, trees, base


def log_odds(x: np.ndarray, fitted: tuple) -> np.ndarray:
    edges, trees, base = fitted
    bins = _binned(x, edges)
    return base + sum(_value(t, bins) for t in trees)


def decoded(nodes: list[Node], odds: np.ndarray) -> str:
    """The text of the kept nodes: the labelling of most log odds without a kept node under a dropped one."""
    for n, worth in zip(nodes, odds.tolist()):
        n.worth = worth
    for n in reversed(nodes):
        if n.worth > 0 and n.parent:
            n.parent.worth += n.worth
    nodes[0].worth = 1.0  # the page itself; its loose text has nodes of its own
    blocks, run = [], []

    def close() -> None:
        if block := " ".join("".join(run).split()):
            blocks.append(block)
        run.clear()

    stack: list = [nodes[0]]
    while stack:
        n = stack.pop()
        if n is None:
            close()
        elif isinstance(n, str):
            run.append(n)
        elif n.worth > 0:
            if n.tag in ("br", RUN):
                run.append(" ")
            if n.tag in BLOCK:
                close()
                stack.append(None)
            stack.extend(reversed(n.items))
        elif n.tag in BLOCK:
            close()
        elif n.tag == RUN:
            run.append(" ")
    close()
    return "\n".join(blocks)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each page."""
    fitted = model()

    @F.pandas_udf("string")
    def text(html: pd.Series) -> pd.Series:
        out: list[str] = []
        group: list[list[Node]] = []

        def flush() -> None:
            if group:
                sets = [features(g) for g in group]
                odds = np.split(log_odds(np.vstack(sets), fitted), np.cumsum([len(s) for s in sets])[:-1])
                out.extend(decoded(g, o) for g, o in zip(group, odds))
                group.clear()

        for page in html:
            group.append(parse(page))
            if sum(map(len, group)) > 5000:
                flush()
        flush()
        return pd.Series(out, dtype=object)

    return pages.select("page_id", "url", text("html").alias("text")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
