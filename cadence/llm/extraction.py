"""Main text of web pages by consensus paths of their hosts.

Each page's containers are scored by how much of the page's prose they hold and
how little besides; the best one casts a vote for its generalised path (tags with
their first class word, digits as '#'). Votes are summed per host in Spark, and
the paths with a tenth of a host's votes or more win (ten at most, by that rule).
Every page is then read again: its text is that of the elements on the host's
highest-voted path that the page has with some text, else of its own best container.

Boilerplate inside a container is left out: menus, headers, footers, asides, forms,
scripts, styles, adverts, notices and reader comments, by tag, role or a word of
class or id; headings in the header of an article stay, as they belong to it. An
element that holds the page's ``article`` or ``main`` is not left out for its class.

Blocks are the text between starts and ends of block elements and line breaks.
Character references are decoded, white space inside a block becomes one space,
blocks are trimmed and joined by one space in page order.

Parsing is tolerant: unclosed paragraphs and items end where HTML ends them, end
tags without a start are ignored, an unclosed comment or script lasts to the end.

Defined cases: null html counts as empty and gives an empty text; a page without
tags is one text; a null or unusable url has no host, and such a page uses its own
best container; repeated rows are pages of their own; an empty table gives an empty
result; further columns do not matter. Work and memory go with the length of one page.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cadence.llm.common import hold, pick, ship, small_side

# Fixed word lists: HTML's own element names, and usual class words of boilerplate.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page; skipped to their end tag unparsed.
RAW = set("script style title textarea iframe noembed noframes xmp template noscript".split())
BLOCK = set(
    "html head body div article main section header footer nav aside form fieldset ul ol menu li dl dt dd table caption thead tbody tfoot tr td th "
    "p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption address details summary dialog center hgroup search select option optgroup button svg object".split()
)
CONTAINERS = set("body div article main section td center".split())
PROSE = set("p h1 h2 h3 h4 h5 h6 blockquote pre li dd figcaption".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6 hgroup".split())
LEFT_OUT = set("head nav footer aside menu dialog search select button svg object".split())
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
WORDS = set(
    "ad ads adbox adslot banner promo cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription "
    "sidebar side aside nav navbar navigation menu menus breadcrumb breadcrumbs footer masthead pagination pager share sharing social "
    "related recommended recommendations comment comments commentlist respond reply replies disqus login signin signup search widget toolbar".split()
)
STEMS = ("advert", "sponsor", "comment", "cookie", "breadcrumb", "newsletter")
NEGATED = {"no", "has", "with", "without", "not"}
COMMENT_WORDS = ("comment", "reply", "replies", "respond", "disqus")
ARTICLE_WORDS = {"article", "post", "entry", "story", "content"}
#: A start of the first kind ends an open element of the second, up to one of the third.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "tr", "td", "th"}, {"table"}), "thead": ({"caption"}, {"table"}),
}
#: Elements that may stand inside a paragraph without ending it.
PHRASING = {"select", "option", "optgroup", "button", "svg", "object"}
SCOPE = {"td", "th", "table", "button", "caption", "object"}

TOKEN = re.compile(r"<!--|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>")
ATTRIBUTE = re.compile(r"([A-Za-z:_-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\bhidden\b")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
DIGITS = re.compile(r"\d+")
INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
LONG_BLOCK = 40
#: Scores are in thousandths. An element weighs more than the whole page, a named main
#: element still more; leaving out the page's only top heading costs a fifth.
FULL, ELEMENT, NAMED, HEADLESS = 1000, 1.15, 1.25, 0.8


def boilerplate_words(names: str) -> bool:
    """Whether a class or id speaks of boilerplate; words after 'no', 'has' or 'with' do not count."""
    for name in names.split():
        before = ""
        for w in WORD.findall(name):
            w = w.lower()
            if before in NEGATED:
                break
            if w in WORDS or w.startswith(STEMS):
                return True
            before = w
    return False


class Page:
    """Block elements of one page, in page order, with the text blocks they hold."""

    def __init__(self, html: str):
        # per element; the first is the page itself
        self.tag, self.parent, self.label = ["body"], [-1], [""]
        self.core, self.out, self.header = [False], [0], [False]
        #: (element, text, characters inside links)
        self.blocks: list[tuple[int, str, int]] = []
        self._read(html)
        self._settle()

    def _read(self, html: str) -> None:
        stack, links, buffer, linked = [0], 0, [], 0
        hidden: list[tuple[str, int]] = []  # inline elements that hide their content
        at, end = 0, len(html)
        low = None
        open_ = Counter()  # tags on the stack, so that nothing is looked for in vain

        def flush():
            nonlocal buffer, linked
            if buffer:
                text = " ".join("".join(buffer).split())
                if text:
                    self.blocks.append((stack[-1], text, linked))
                buffer, linked = [], 0

        def add(raw):
            nonlocal linked
            if raw and not hidden:
                text = unescape(raw) if "&" in raw else raw
                buffer.append(text)
                if links:
                    linked += len(text)

        def close_to(k):
            nonlocal links
            flush()
            for i in stack[k:]:
                open_[self.tag[i]] -= 1
            del stack[k:]
            links = 0

        def find(tags, barrier):
            if not any(open_[t] for t in tags):
                return 0
            for k in range(len(stack) - 1, 0, -1):
                tag = self.tag[stack[k]]
                if tag in tags:
                    return k
                if tag in barrier:
                    return 0
            return 0

        while at < end:
            m = TOKEN.search(html, at)
            if m is None:
                add(html[at:])
                break
            add(html[at : m.start()])
            at = m.end()
            if m[0] == "<!--":
                # '<!-->' is an empty comment
                k = html.find("-->", m.start() + 2)
                at = end if k < 0 else k + 3
                continue
            shut, tag, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not tag:
                continue
            tag = tag.lower()
            if shut:
                if tag == "a":
                    links = max(0, links - 1)
                elif tag in BLOCK:
                    if tag in HEADINGS:
                        k = find(HEADINGS, SCOPE)
                    else:
                        k = find({tag}, SCOPE - {tag} if tag not in ("table", "html", "body") else set())
                    if k:
                        close_to(k)
                    elif tag == "p":
                        flush()
                elif hidden and hidden[-1][0] == tag:
                    if hidden[-1][1]:
                        hidden[-1] = (tag, hidden[-1][1] - 1)
                    else:
                        hidden.pop()
                continue
            if tag in RAW:
                if rest.endswith("/") and tag in ("script", "style", "title"):
                    rest = rest[:-1]
                if low is None:
                    low = html.lower() if len(html.lower()) == len(html) else html
                k = low.find("</" + tag, at)
                if k < 0:
                    at = end
                else:
                    k2 = html.find(">", k)
                    at = end if k2 < 0 else k2 + 1
                continue
            if tag in VOID:
                if tag in ("br", "hr"):
                    flush()
                continue
            names, role, unseen, itemprop, first = "", "", False, "", ""
            if "=" in rest or "hidden" in rest:
                for a in ATTRIBUTE.finditer(rest):
                    key, value = (a[1] or "hidden").lower(), a[2] or a[3] or a[4] or ""
                    if key == "class":
                        words = value.split()
                        first = DIGITS.sub("#", words[0]) if words else ""
                        names += " " + value
                    elif key == "id":
                        names += " " + value
                    elif key == "role":
                        role = value.lower().strip()
                    elif key == "itemprop":
                        itemprop = value
                    elif key == "hidden" or key == "style" and INVISIBLE.search(value):
                        unseen = True
            if tag not in BLOCK:
                if tag == "a" and not rest.endswith("/"):
                    links += 1
                elif hidden and hidden[-1][0] == tag:
                    hidden[-1] = (tag, hidden[-1][1] + 1)
                elif unseen or names and tag in ("span", "ins", "label") and boilerplate_words(names):
                    hidden.append((tag, 0))
                continue
            flush()
            if tag in ("html", "body"):
                if tag == "body":
                    k = find({"head"}, set())
                    if k:
                        close_to(k)
                continue
            if tag == "svg" and rest.endswith("/"):
                continue
            if tag not in PHRASING:
                k = find({"p"}, SCOPE)
                if k:
                    close_to(k)
            if tag in HEADINGS and self.tag[stack[-1]] in HEADINGS:
                close_to(len(stack) - 1)
            if self.tag[stack[-1]] == "head":
                close_to(len(stack) - 1)
            if tag in ENDS:
                also, barrier = ENDS[tag]
                while k := find(also, barrier):
                    close_to(k)
            me = len(self.tag)
            self.tag.append(tag)
            self.parent.append(stack[-1])
            self.label.append(f"{tag}.{first}" if first else tag)
            commented = tag == "article" and any(w in names.lower() for w in COMMENT_WORDS)
            self.core.append(tag in ("article", "main") and not commented or role == "main" or itemprop == "articleBody")
            # 1: always left out, 2: unless it holds an article, 3: a form
            header = tag == "header" or role == "banner" or "header" in names.lower() and "header" in [w.lower() for w in WORD.findall(names)]
            self.header.append(header)
            if tag in LEFT_OUT or unseen or commented:
                self.out.append(1)
            elif role in ROLES or tag not in ("article", "main") and names and boilerplate_words(names):
                self.out.append(2)
            else:
                self.out.append(3 if tag in ("form", "fieldset") else 0)
            stack.append(me)
            open_[tag] += 1
        flush()

    def _settle(self) -> None:
        """Which elements are left out, and prose and all text of each with what is below it."""
        n = len(self.tag)
        held = [0] * n  # an article or main below, or the element itself
        prose, total = [0] * n, [0] * n
        for at, text, linked in self.blocks:
            total[at] += len(text)
            if self.tag[at] in PROSE or len(text) >= LONG_BLOCK:
                prose[at] += max(0, len(text) - linked)
        below = prose.copy()
        for i in range(n - 1, 0, -1):
            held[i] |= self.core[i]
            held[self.parent[i]] |= held[i]
            below[self.parent[i]] += below[i]
        self.dropped, in_article = [False] * n, [False] * n
        #: inside the header of an article only headings stay
        only_headings = [False] * n
        for i in range(1, n):
            up = self.parent[i]
            in_article[i] = in_article[up] or self.core[i]
            rule, drop = self.out[i], False
            if rule == 1:
                drop = True
            elif rule == 2:
                drop = not held[i]
            elif rule == 3:
                drop = not held[i] and 2 * below[i] <= below[0]
            only_headings[i] = only_headings[up] and self.tag[i] not in HEADINGS
            if self.header[i] and not held[i] and not drop and self.tag[i] not in HEADINGS and not only_headings[i]:
                if in_article[up] or any(w in self.label[i] for w in ARTICLE_WORDS):
                    only_headings[i] = True
                else:
                    drop = True
            self.dropped[i] = self.dropped[up] or drop
        self.out_of_text = [d or h for d, h in zip(self.dropped, only_headings)]
        for i in range(n):
            if self.out_of_text[i]:
                prose[i] = 0
        for i in range(n - 1, 0, -1):
            prose[self.parent[i]] += prose[i]
            total[self.parent[i]] += total[i]
        self.prose, self.total = prose, total

    def best(self) -> tuple[int, int]:
        """The container that holds most of the page's prose and least besides, and its score; inner ones win ties."""
        if not self.prose[0]:
            return 0, 0
        found, score = 0, FULL * self.prose[0] // max(1, self.total[0])
        heads = [i for i, t in enumerate(self.tag) if t == "h1" and not self.dropped[i]]
        above = set()
        if len(heads) == 1:
            at = heads[0]
            while at > 0:
                above.add(at)
                at = self.parent[at]
        for i in range(1, len(self.tag)):
            if self.prose[i] and not self.dropped[i] and self.tag[i] in CONTAINERS:
                share = FULL * self.prose[i] * self.prose[i] // (self.prose[0] * self.total[i])
                now = int(share * (NAMED if self.core[i] else ELEMENT) * (HEADLESS if above and i not in above else 1.0))
                if now >= score:
                    found, score = i, now
        return found, score

    def path(self, at: int) -> str:
        labels = []
        while at > 0:
            labels.append(self.label[at])
            at = self.parent[at]
        return ">".join(reversed(labels))

    def on_path(self, path: str) -> list[int]:
        """Outermost elements on a generalised path, in page order."""
        if not path:
            return [0]
        labels = path.split(">")
        depth = [0] + [-1] * (len(self.tag) - 1)
        found = []
        for i in range(1, len(self.tag)):
            d = depth[self.parent[i]]
            if 0 <= d < len(labels) and self.label[i] == labels[d] and not self.dropped[i]:
                depth[i] = d + 1
                if d + 1 == len(labels):
                    found.append(i)
        return found

    def text(self, roots: list[int]) -> str:
        inside = [False] * len(self.tag)
        for r in roots:
            inside[r] = True
        for i in range(1, len(self.tag)):
            inside[i] = inside[i] or inside[self.parent[i]]
        return " ".join(t for at, t, _ in self.blocks if inside[at] and not self.out_of_text[at])


def extract(html: str, paths: list[str]) -> tuple[str, str]:
    """Text of a page, and the path that gave it."""
    page = Page(html)
    for path in paths:
        if text := page.text(page.on_path(path)):
            return text, path
    best, _ = page.best()
    return page.text([best]), page.path(best)


def cast_votes(batches):
    """One vote a page: the path of its best container, with the container's score."""
    for b in batches:
        hosts, paths, scores = [], [], []
        for host, html in zip(b.column("host").to_pylist(), b.column("html").to_pylist()):
            page = Page(html)
            best, score = page.best()
            if score:
                hosts.append(host)
                paths.append(page.path(best))
                scores.append(score)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(scores, pa.int64())], ["host", "path", "votes"])


def read_again(batches):
    for b in batches:
        got = [extract(html, paths or []) for html, paths in zip(b.column("html").to_pylist(), b.column("paths").to_pylist())]
        text, path = (pa.array([g[i] for g in got], pa.string()) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), text, path], ["page_id", "url", "text", "path"])


def with_host(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    p = pick(pages, id_col, url_col, html_col).toDF("page_id", "url", "html")
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return p.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.when(host != "", host).alias("host"))


def winning_paths(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(host, paths)``: the paths of a host with a tenth of its votes or more, highest first."""
    ship(pages.sparkSession)
    p = with_host(pages, id_col, url_col, html_col).filter("host is not null").select("host", "html")
    votes = p.mapInArrow(cast_votes, "host string, path string, votes long").groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    votes = hold(votes, "host-votes")
    share = votes.join(votes.groupBy("host").agg(F.sum("votes").alias("all")), "host").filter(F.col("votes") * 10 >= F.col("all"))
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("votes")).alias("v"), "path")))
    return hold(share.groupBy("host").agg(ranked.alias("ranked")).select("host", F.col("ranked.path").alias("paths")), "host-paths")


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, path)`` per row of ``pages``."""
    winners = small_side(winning_paths(pages, id_col, url_col, html_col))
    p = with_host(pages, id_col, url_col, html_col)
    # beyond a broadcast, pages without a host are spread by their content ('/' is in no host)
    apart = F.concat(F.lit("/"), F.hash("html").cast("string"))
    p = p.withColumn("host", F.coalesce("host", apart)).join(winners, "host", "left").select("page_id", "url", "html", "paths")
    kind = dict(p.dtypes)
    return p.mapInArrow(read_again, f"page_id {kind['page_id']}, url string, text string, path string")
