"""Main text of web pages, by removal of site templates.

Every page is parsed to a tree and its element subtrees are hashed. Spark counts, for each host, the pages
on which a subtree occurs; pages that have the same main text outside the subtree count once (headings and runs without a letter
left aside), so articles copied under another title, counter or numeric date are no template. Subtrees that recur on at least `min_pages` pages and `min_share` of the host's pages are deleted
from that host's pages: anywhere outside the article, and inside it only containers (a share box, a
related list), never headings, paragraphs or list items. Recurrence decides first, on pages of bare divs as well. What it cannot
see, because the host has few pages or the element differs from page to page (a comment, a rotating advert, a menu that marks the
open page), falls back on the element's own tag, role or class (menus, headers, footers, sidebars, notices, adverts, forms, scripts, comments); a wrapper
that holds the longest article, or more than half of the text, never goes for its class or for being a form.

What is left of the article, or of main, or of the body where a page has neither, is returned:
character references decoded, white space inside a block one space, blocks joined by one newline.
Null or empty html gives an empty text; a null url is a host of its own; repeated rows give repeated
results; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobmarket.llm.common import BROADCAST_ROWS, free_name, written

START = re.compile(r"<(?:!--|[!?/]|[a-zA-Z])")
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: What ends a tag, or opens a quoted value: a quote elsewhere is a character like any other.
STOP = re.compile(r""">|=\s*(["'])""")
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that an opening tag of the key ends when they are open.
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "body": {"head"}}
SCOPE = frozenset("html body article main section div table td th ul ol dl aside nav header footer form figure blockquote".split())
NEVER = frozenset("nav header footer aside form script style noscript template iframe button select textarea input svg canvas object dialog menu head title".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
#: Words of a class or id that mark an element as no content.
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar"
    " widget widgets cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments"
    " disqus respond reply replies related recommended recommendations pagination pager toolbar skip copyright disclaimer".split()
)
ARTICLE_HINTS = frozenset("comment comments reply ad ads advert promo related sponsored".split())
#: Hints that keep a wrapper furniture even if the page's longest article stands in it.
FOREIGN = ARTICLE_HINTS | frozenset("adv adverts advertisement advertising sponsor promotion disqus respond replies recommended recommendations".split())
TOPS = frozenset("header masthead banner".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote".split())
KEPT_IN_ARTICLE = frozenset("p h1 h2 h3 h4 h5 h6 li pre blockquote td th tr dt dd figcaption caption article main body html".split())

SALT = 32
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 time".split())


class Page:
    """Elements of one page in document order, with their text runs and subtree hashes."""

    def __init__(self, source: str):
        self.tag: list[str] = ["#root"]
        self.parent: list[int] = [-1]
        self.attributes: list[dict[str, str]] = [{}]
        self.events: list[tuple[int, str | None]] = []  # (element, text), or (element, None) where a block starts or ends
        stack, at = [0], 0
        self.live: Counter[str] = Counter()  # open elements by name
        last = {c: source.rfind(c) for c in "\"'>"}
        while at < len(source):
            m = START.search(source, at)
            if m is None or last[">"] < m.start() and m[0] != "<!--":  # no tag ends any more
                self._text(stack[-1], source[at:])
                break
            if m.start() > at:
                self._text(stack[-1], source[at:m.start()])
            if m[0] == "<!--":
                end = source.find("-->", m.end())
                at = len(source) if end < 0 else end + 3
            elif m[0] in ("<!", "<?"):
                at = source.index(">", m.end()) + 1
            elif m[0] == "</":
                name = NAME.match(source, m.end())
                at = source.index(">", m.end()) + 1
                if name:
                    self._close(stack, name[0].lower())
            else:
                at = self._tag(stack, source, m.start() + 1, last)

    def _tag(self, stack: list[int], source: str, at: int, last: dict[str, int]) -> int:
        """Open the element whose name begins at `at`; where to read on. Each quoted value is read once, and none is looked for that never ends."""
        found = NAME.match(source, at)
        name, inside = found[0].lower(), found.end()
        stop = inside
        while m := STOP.search(source, stop):
            if m[1] is None:
                break
            stop = source.index(m[1], m.end()) + 1 if last[m[1]] >= m.end() else m.end()
        if m is None:  # the page ends inside the tag
            self._text(stack[-1], source[at - 1:])
            return len(source)
        self._open(stack, name, source[inside:m.start()])
        if name not in RAW:
            return m.end()
        end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.IGNORECASE).search(source, m.end())
        if name != "title":
            self.events.append((stack[-1], ""))
        self._pop(stack)
        return end.end() if end else len(source)

    def _pop(self, stack: list[int]) -> int:
        node = stack.pop()
        self.live[self.tag[node]] -= 1
        return node

    def _text(self, node: int, text: str) -> None:
        self.events.append((node, text))

    def _edge(self, node: int) -> None:
        if self.tag[node] not in INLINE:
            self.events.append((node, None))

    def _open(self, stack: list[int], name: str, attributes: str) -> None:
        if name not in INLINE:
            self._end_open(stack, {"p"}, SCOPE)
            if name in IMPLIED:
                self._end_open(stack, IMPLIED[name], {"table", "ul", "ol", "dl", "select"} if name != "body" else set())
        node = len(self.tag)
        self.tag.append(name)
        self.parent.append(stack[-1])
        self.attributes.append({a[0].lower(): html_lib.unescape(a[1] or a[2] or a[3]) for a in ATTRIBUTE.findall(attributes)} if attributes.strip(" /") else {})
        if name == "br":
            self.events.append((node, " "))
        self._edge(node)
        if name not in VOID:
            stack.append(node)
            self.live[name] += 1

    def _end_open(self, stack: list[int], names: set[str], stop: frozenset | set) -> None:
        if not any(self.live[n] for n in names):
            return
        for k in range(len(stack) - 1, 0, -1):
            if self.tag[stack[k]] in names:
                while len(stack) > k:
                    self._edge(self._pop(stack))
                if "p" in names:
                    return
            elif self.tag[stack[k]] in stop:
                return

    def _close(self, stack: list[int], name: str) -> None:
        if not self.live[name]:
            return
        for k in range(len(stack) - 1, 0, -1):
            if self.tag[stack[k]] == name:
                while len(stack) > k:
                    self._edge(self._pop(stack))
                return
            if name in INLINE and self.tag[stack[k]] in SCOPE or name == "p" and self.tag[stack[k]] in SCOPE:
                return

    def hashes(self) -> list[int]:
        """A 64-bit hash of each element's subtree: tags and texts, white space collapsed."""
        return self._hashes

    def layout(self) -> tuple[list[bool], list[bool]]:
        """For each element: is it inside no content, and is it inside the main part.

        The main part is chosen before furniture: tags and roles that are no content by themselves go; then a form or an element with a hint goes, unless
        it holds the longest article (and is no advert, comment or related list) or more than half of the text. Inside an article a header stays, and a hint must be a whole class or id
        unless the element holds neither paragraph nor heading.
        """
        return self._layout

    @cached_property
    def _hashes(self) -> list[int]:
        parts: list[list[bytes]] = [[t.encode()] for t in self.tag]
        for node, text in self.events:
            if text and (words := text.split()):
                parts[node].append(" ".join(words).encode("utf-8", "surrogatepass"))
        out = [0] * len(self.tag)
        for node in range(len(self.tag) - 1, -1, -1):
            digest = hashlib.blake2b(b"\x00".join(parts[node]), digest_size=8).digest()
            out[node] = int.from_bytes(digest, "big", signed=True)
            if node:
                parts[self.parent[node]].append(digest)
        return out

    def outside(self, dead: list[bool], main: list[bool]) -> list[int]:
        """For each element a 64-bit sum over the main part's text runs outside it, in any order.

        Headings and runs without a letter count only where the main part has nothing else.
        """
        whole = not any(main)
        heading = [False] * len(self.tag)
        for n in range(1, len(self.tag)):
            heading[n] = heading[self.parent[n]] or self.tag[n] in HEADINGS
        body, rest = [0] * len(self.tag), [0] * len(self.tag)
        for node, text in self.events:
            if text and not dead[node] and (whole or main[node]) and (words := text.split()):
                digest = hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=8).digest()
                aside = heading[node] or not any(map(str.isalpha, text))
                (rest if aside else body)[node] += int.from_bytes(digest, "big")
        own = body if any(body) else rest
        total = sum(own)
        for n in range(len(self.tag) - 1, 0, -1):
            own[self.parent[n]] += own[n]
        return [((total - (x if n else 0)) + (1 << 63)) % (1 << 64) - (1 << 63) for n, x in enumerate(own)]

    def _sums(self, dead: list[bool] | None = None) -> list[int]:
        """Characters of text inside each element, those of dead elements aside."""
        own = [0] * len(self.tag)
        for node, text in self.events:
            if text and not (dead and dead[node]):
                own[node] += sum(map(len, text.split()))
        for n in range(len(self.tag) - 1, 0, -1):
            own[self.parent[n]] += own[n]
        return own

    def _spread(self, marked: list[bool]) -> list[bool]:
        """Marked elements and all that is inside them."""
        for n in range(1, len(self.tag)):
            marked[n] = marked[n] or marked[self.parent[n]]
        return marked

    def exact(self, node: int) -> bool:
        """Is the element no content by its own tag or role, or hidden."""
        name, a = self.tag[node], self.attributes[node]
        if name in NEVER and name not in ("form", "header"):
            return True
        if not a or name in ("html", "body", "main"):
            return False
        hidden = "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", a.get("style", ""), re.IGNORECASE)
        return bool(hidden) or (a.get("role", "").lower() in ROLES and name != "form")

    def hints(self, node: int, whole: bool) -> set[str]:
        """Hints among the words of class and id; whole: among their whole names."""
        a = self.attributes[node]
        names = f"{a.get('class', '')} {a.get('id', '')}".lower()
        return HINTS & set(names.split() if whole else re.findall(r"[a-z0-9]+", names))

    @cached_property
    def _layout(self) -> tuple[list[bool], list[bool]]:
        n_all = range(1, len(self.tag))
        dead = self._spread([n > 0 and self.exact(n) for n in range(len(self.tag))])
        size = self._sums(dead)
        articles = [n for n in n_all if self.tag[n] == "article" and not dead[n] and ARTICLE_HINTS.isdisjoint(self.hints(n, False))]
        holds = set()
        if articles:
            at = max(articles, key=lambda n: (size[n], -n))
            while at:
                holds.add(at)
                at = self.parent[at]
        inside = self._spread([n in articles for n in range(len(self.tag))])
        heads, solid = [0] * len(self.tag), [0] * len(self.tag)
        for n in reversed(n_all):
            heads[n] += self.tag[n] in ("h1", "h2")
            solid[n] += self.tag[n] in PROSE
            heads[self.parent[n]] += heads[n]
            solid[self.parent[n]] += solid[n]

        def furniture(n: int) -> bool:
            name = self.tag[n]
            if name in ("html", "body", "main") or n in articles:
                return False
            exactly = self.hints(n, True)
            if inside[n]:
                if name != "form" and (not exactly and (solid[n] or not self.hints(n, False)) or exactly <= TOPS and heads[n]):
                    return False
                return not exactly.isdisjoint(FOREIGN) or 2 * size[n] <= next(size[a] for a in self._up(n) if a in own)
            if name == "article" or name == "header" and n not in holds:
                return True
            found = self.hints(n, False)
            if not found and name != "form":
                return False
            if n in holds and found.isdisjoint(FOREIGN):
                return False
            return not exactly.isdisjoint(FOREIGN) or 2 * size[n] <= size[0]

        own = set(articles)
        dead = self._spread([dead[n] or n > 0 and furniture(n) for n in range(len(self.tag))])
        for kind in (lambda n: n in own, lambda n: self.tag[n] == "main" or self.attributes[n].get("role") == "main"):
            roots = {n for n in n_all if not dead[n] and kind(n)}
            if roots:
                return dead, self._spread([n in roots for n in range(len(self.tag))])
        return dead, [False] * len(self.tag)

    def _up(self, node: int) -> Iterator[int]:
        while node:
            yield node
            node = self.parent[node]

    def candidates(self, dead: list[bool], main: list[bool]) -> list[int]:
        """Elements that may be a template: blocks, and of furniture the outermost element."""
        return [n for n in range(1, len(self.tag)) if not dead[self.parent[n]] and self.tag[n] not in INLINE and self.tag[n] not in ("html", "body") and not (main[n] and self.tag[n] in KEPT_IN_ARTICLE)]

    def recurring(self, template: frozenset | set) -> list[int]:
        """The outermost elements that the host's templates delete."""
        if not template:
            return []
        hashes, found = self._hashes, set()
        inside = [False] * len(self.tag)
        wanted = {n for n in self.candidates(*self._layout) if hashes[n] in template}
        for n in range(1, len(self.tag)):
            inside[n] = inside[self.parent[n]] or n in wanted
            if n in wanted and not inside[self.parent[n]]:
                found.add(n)
        return sorted(found)

    def text(self, template: frozenset | set) -> str:
        return self.main(template)[0]

    def main(self, template: frozenset | set) -> tuple[str, int]:
        """Main text, and how many outermost elements the host's templates deleted."""
        dead, main = self._layout
        whole = not any(main)
        gone = self.recurring(template)
        dead = list(dead)
        for n in gone:
            dead[n] = True
        dead = self._spread(dead)
        blocks: list[str] = []
        run: list[str] = []
        for node, text in [*self.events, (0, None)]:
            if text is None:
                words = html_lib.unescape("".join(run)).split()
                if words:
                    blocks.append(" ".join(words))
                run = []
            elif not dead[node] and (whole or main[node]):
                run.append(text)
            elif dead[node] and self.tag[node] in INLINE:
                run.append(" ")
        return "\n".join(blocks), len(gone)


def host(url: str = "url") -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))


def subtree_rows(pages: DataFrame) -> DataFrame:
    """Rows host, subtree, main: each distinct block element of a page that might be a template."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for site, source in zip(pdf["host"], pdf["html"]):
                page = Page(source or "")
                hashes, (dead, main) = page.hashes(), page.layout()
                marks = page.outside(dead, main)
                seen = {(hashes[n], marks[n]) for n in page.candidates(dead, main)}
                rows += [(site, h, mark) for h, mark in [(0, marks[0]), *seen]]
            yield pd.DataFrame(rows, columns=["host", "subtree", "main"])

    return pages.select(host().alias("host"), "html").mapInPandas(walk, "host string, subtree long, main long")


def templates(pages: DataFrame, min_pages: int = 5, min_share: float = 0.2) -> DataFrame:
    """Rows host, subtree that recur on many pages of the host (subtree 0 stands for the page itself)."""
    counts = subtree_rows(pages).distinct().groupBy("host", "subtree").count()
    counts = written(counts.where(F.col("count") >= min_pages), "subtrees")
    n = counts.where("subtree = 0").select(F.col("host").alias("_host"), F.col("count").alias("pages"))
    return counts.where("subtree <> 0").join(n, F.col("host") == F.col("_host")).where(F.col("count") >= min_share * F.col("pages")).select("host", "subtree")


def main_text(pages: DataFrame, min_pages: int = 5, min_share: float = 0.2) -> DataFrame:
    """All columns of pages, and text, n_chars and n_templates (outermost elements that recurrence deleted); columns of pages by these names are replaced."""
    found = written(templates(pages, min_pages, min_share), "templates")
    site, of, known, salt, part, out = (free_name(pages, c, "text", "n_chars", "n_templates") for c in ("_site", "_host", "_template", "_salt", "_part", "_out"))
    lists = found.groupBy(F.col("host").alias(of)).agg(F.collect_set("subtree").alias(known))
    # A host's template is at most 1 / min_share times the block elements of one page on average.
    marked = pages.withColumn(site, host())
    if found.count() <= BROADCAST_ROWS:
        marked = marked.join(F.broadcast(lists), F.col(site) == F.col(of), "left")
    else:  # a host's pages are spread over SALT tasks, each with its list
        salted = lists.withColumn(part, F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        marked = marked.withColumn(salt, F.pmod(F.xxhash64("url", "html"), F.lit(SALT)).cast("int"))
        marked = marked.join(salted, (F.col(site) == F.col(of)) & (F.col(salt) == F.col(part)), "left").drop(salt, part)

    @F.pandas_udf("text string, n_templates int")
    def extract(source: pd.Series, template: pd.Series) -> pd.DataFrame:
        rows = [Page(html or "").main(frozenset(found) if found is not None else frozenset()) for html, found in zip(source, template)]
        return pd.DataFrame(rows, columns=["text", "n_templates"])

    marked = marked.withColumn(out, extract("html", known)).drop(site, of, known)
    return marked.withColumns({"text": F.col(out)["text"], "n_chars": F.length(F.col(out)["text"]).cast("long"), "n_templates": F.col(out)["n_templates"]}).drop(out)
