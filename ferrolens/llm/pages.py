"""Operator 4: main text of web pages, without what a site repeats on its pages.

1. A tolerant parser turns each page into elements (tag, attributes, source range, parent).
2. Every block element is hashed, by its source or, where it is a list of links, by its shape; Spark
   counts, for each host, on how many pages each hash occurs. Subtrees on at least MIN_PAGES pages and SHARE of the host's pages are the template.
   As each page has few subtrees, a host's template has at most (subtrees a page) / SHARE entries,
   whatever its size.
3. On each page, template subtrees are deleted first, inside an article too. Articles that a site
   carries twice, or quotes, are no template: prose inside <article> or <main> is deleted only if it
   has at most PROSE_CHARS characters and stands on PROSE_SHARE of the host's pages, and never if nothing
   else would be left of the article.
4. Of what is left, elements go that say by tag, role, class or id that they are menus, headers,
   footers, sidebars, notices, adverts, forms or comments (`says_aside`). If the page marks its
   article (<article>, <main>), only that stays.
5. Blocks of the rest, character references decoded, white space single, are joined by two newlines.

Null, empty and textless pages give an empty text. Pages without a host in their url form one host
of their own. Repeated rows count once each. Pages are parsed whole; depth and length are free.
"""

from __future__ import annotations

import hashlib
import html as html_
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrolens.llm.frames import column_index, fresh, pick, positional, slices, stored, table, texts_of

#: A subtree is template if it is on so many pages of a host, and on this share of them.
MIN_PAGES, SHARE = 4, 0.1
#: Prose of an article is template only up to this length, and from this share of the host's pages on.
PROSE_CHARS, PROSE_SHARE = 200, 0.5
#: Share of its text in links that makes an element a list of links.
LINKED = 0.8
#: Hashes that a task counts before it sends them on.
HELD_HASHES = 200_000

TAG = re.compile(r"""<!--.*?(?:-->|$)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)>""", re.S)
NAMED = re.compile(r"""(?:^|(?<=\s))(?:class|id)\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SPACED = frozenset("br td th img wbr".split())

# Elements that are no part of an article.
NEVER = frozenset("head script style noscript template nav footer aside form button select option textarea input iframe object svg canvas audio video dialog menu title search".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
WORDS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer gdpr login masthead menu menubar modal nav navbar navigation "
    "newsletter notice notices notification pagination pager popup promo promotion recommended related remark respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget".split()
)
#: Whole class tokens or ids by which even an article is none, if the page has another.
SECOND = frozenset("comment comments disqus related recommended".split())
#: Parts of a class token that leave the meaning to its other parts ("site-footer", "share-buttons").
PLAIN = frozenset(
    "area block bottom box bar button buttons container content form global group icon icons inner item items left link links list main outer page panel post posts primary right row secondary section side site slot "
    "text top unit wrap wrapper".split()
)
#: Parts of a class token or id that decide in any place of it, unless a part of WITHOUT stands there too ("no-comments").
STRONG = frozenset("advert adverts advertisement breadcrumb breadcrumbs comment comments commentlist cookie cookies disqus gdpr newsletter pagination sidebar".split())
WITHOUT = frozenset("enabled has hide no not open show with without".split())
#: Parts that decide as the last or, before a number or a plain part, the first of a token ("googleAd", "related-articles").
EDGES = frozenset("ad ads related recommended".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li dl dt dd ol ul table tr figure figcaption".split())


def names_aside(token: str, strong_only: bool = False) -> bool:
    """Whether a class token or an id names something other than an article (`Page.says_aside`)."""
    parts = [x.lower() for x in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", token)]
    if not parts:
        return False
    if any(x in STRONG for x in parts) and not any(x in WITHOUT for x in parts):
        return True
    if strong_only:
        return False
    if "".join(parts) in WORDS:
        return True
    if parts[-1] in EDGES or parts[0] in EDGES and (len(parts) == 1 or parts[1] in PLAIN or parts[1].rstrip("s") in ("article", "story", "item")):
        return not any(x in WITHOUT for x in parts)
    return any(x in WORDS for x in parts) and all(x in WORDS or x in PLAIN for x in parts)


class Page:
    """Elements of one page in the order of their start, and its pieces of text."""

    def __init__(self, source: str):
        self.source = source
        self.tags: list[str] = []
        self.attributes: list[str] = []
        self.spans: list[list[int]] = []
        self.parents: list[int] = []
        self.events: list[tuple[int, int, int]] = []  # (element, start, end) of text; (element, -1, open or close) of elements
        self._parse()

    def _open(self, tag: str, attributes: str, at: int, parent: int) -> int:
        self.tags.append(tag)
        self.attributes.append(attributes)
        self.spans.append([at, len(self.source)])
        self.parents.append(parent)
        self.events.append((len(self.tags) - 1, -1, 1))
        return len(self.tags) - 1

    def _parse(self) -> None:
        source, stack, at = self.source, [], 0
        tags = self.tags

        def close(upto: int, end: int) -> None:
            while len(stack) > upto:
                i = stack.pop()
                self.spans[i][1] = end
                self.events.append((i, -1, 0))

        def inside(names, barrier) -> int:
            """Place in the stack of the innermost open element of these names, or -1."""
            for k in range(len(stack) - 1, -1, -1):
                t = tags[stack[k]]
                if t in names:
                    return k
                if t in barrier:
                    return -1
            return -1

        position = 0
        while m := TAG.search(source, position):
            start, position = m.span()
            if start > at:
                self.events.append((stack[-1] if stack else -1, at, start))
            at = position
            tag = m[2]
            if tag is None:
                continue
            tag = tag.lower()
            if m[1]:
                if tag == "br":
                    self.events.append((stack[-1] if stack else -1, -1, 2))
                elif (k := inside((tag,), () if tag in BLOCK else BLOCK)) >= 0:
                    close(k, position)
                continue
            if tag in BLOCK and (k := inside(("p",), ("article", "aside", "div", "section", "td", "th", "li", "body", "main"))) >= 0:
                close(k, start)
            if tag in CLOSES and (k := inside(CLOSES[tag], ("ul", "ol", "dl", "table", "select"))) >= 0:
                close(k, start)
            if tag in VOID:
                if tag in SPACED or tag == "hr":
                    self.events.append((stack[-1] if stack else -1, -1, 2 if tag in SPACED else 3))
                continue
            if tag in ("td", "th"):
                self.events.append((stack[-1] if stack else -1, -1, 2))
            i = self._open(tag, m[3], start, stack[-1] if stack else -1)
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(source, position)
                stop, position = end.span() if end else (len(source), len(source))
                if tag not in ("script", "style"):
                    self.events.append((i, at, stop))
                at = position
                self.spans[i][1] = position
                self.events.append((i, -1, 0))
            else:
                stack.append(i)
        if at < len(source):
            rest = source[at:]
            cut = re.search(r"<[/a-zA-Z!][^>]*$", rest)  # a tag that the page's end cuts off
            self.events.append((stack[-1] if stack else -1, at, at + (cut.start() if cut else len(rest))))
        close(0, len(source))

    def hashes(self) -> dict[int, int]:
        """64-bit hashes of the block elements below the body.

        Of most it is the hash of their source. Lists of links (all but LINKED of the text stands in links) change their entries
        from page to page: outside articles, theirs is the hash of tags, classes and ids, equal neighbours once.
        """
        tags, parents, n = self.tags, self.parents, len(self.tags)
        size, linked = [0] * n, [0] * n
        link, article = [False] * n, [False] * n
        for i, tag in enumerate(tags):
            p = parents[i]
            link[i] = tag == "a" or p >= 0 and link[p]
            article[i] = tag in ("article", "main") or p >= 0 and article[p]
        for i, a, b in self.events:
            if a >= 0 <= i:
                m = len(self.source[a:b].strip())
                size[i] += m
                linked[i] += m * link[i]
        shapes: list[list[str]] = [[] for _ in range(n)]
        out = {}
        for i in range(n - 1, -1, -1):
            tag, p = tags[i], parents[i]
            inner = shapes[i][::-1]
            shape = f"<{tag} {' '.join(sorted(NAMED.findall(self.attributes[i])))}>{''.join(x for k, x in enumerate(inner) if not k or inner[k - 1] != x)}</>"
            if p >= 0:
                size[p] += size[i]
                linked[p] += linked[i]
                shapes[p].append(hashlib.blake2b(shape.encode("utf-8", "replace"), digest_size=8).hexdigest())
            if tag in BLOCK and tag not in ("html", "body"):
                a, b = self.spans[i]
                many = not article[i] and size[i] > 0 and linked[i] >= LINKED * size[i]
                told = "links" + shape if many else self.source[a:b].strip()
                out[i] = int.from_bytes(hashlib.blake2b(told.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)
        return out

    def sizes(self) -> list[int]:
        """Characters of text below each element, without scripts, styles and the like."""
        out = [0] * len(self.tags)
        for i, a, b in self.events:
            if a >= 0 <= i and self.tags[i] not in RAW:
                out[i] += len(self.source[a:b].strip())
        for i in range(len(out) - 1, -1, -1):
            if self.parents[i] >= 0:
                out[self.parents[i]] += out[i]
        return out

    def says_aside(self, i: int, holder: bool = False, words: bool = True) -> bool:
        """Whether tag, role, class or id name something other than an article.

        A class token or id counts if it is one of WORDS, or made of these and of PLAIN parts alone: "cookie-notice"
        and "site-footer" do, "share-price" and "has-sidebar" don't; STRONG parts count in any place. The id of a section
        is a place to link to, so there only STRONG parts count. For a holder
        (an article, what contains one, or a form around a page's text) only SECOND counts, and nothing without `words`.
        """
        tag = self.tags[i]
        if tag in NEVER and not (tag == "form" and holder):
            return True
        attributes = self.attributes[i]
        if not attributes or tag in ("html", "body"):
            return False
        for m in ATTRIBUTE.finditer(attributes):
            name, raw = m[1].lower(), (m[2] or "").strip("\"'")
            value = raw.lower()
            if name == "hidden" and value != "until-found" or name == "aria-hidden" and value == "true":
                return True
            if name == "role" and value in ROLES and not (value == "form" and holder):
                return True
            if name in ("class", "id"):
                for token in raw.split():
                    if holder:
                        if words and token.lower() in SECOND:
                            return True
                    elif names_aside(token, name == "id" and tag == "section"):
                        return True
        return False

    def template(self, hashes: dict[int, int], common: dict[int, float]) -> list[bool]:
        """Which elements the host's template deletes; `common` gives the share of pages of its hashes."""
        tags, parents, n = self.tags, self.parents, len(self.tags)
        article, cut = [-1] * n, [False] * n  # innermost article around or at the element
        kept, short = {}, {}
        for i, tag in enumerate(tags):
            p = parents[i]
            article[i] = i if tag in ("article", "main") else article[p] if p >= 0 else -1
            share = common.get(hashes.get(i))
            if share is None or article[i] == i or cut[p] and p >= 0:
                cut[i] = p >= 0 and cut[p]
            elif article[i] < 0 or tag not in PROSE:
                cut[i] = True
            elif share >= PROSE_SHARE and self.spans[i][1] - self.spans[i][0] <= PROSE_CHARS:
                cut[i] = True
                short.setdefault(article[i], []).append(i)
            if tag in PROSE and article[i] >= 0 and not cut[i]:
                kept[article[i]] = True
        for a, some in short.items():  # all prose of an article is common: a page that the site carries again
            if a not in kept:
                for i in some:
                    cut[i] = False
        return [c or parents[i] >= 0 and cut[parents[i]] for i, c in enumerate(cut)]

    def text(self, common: dict[int, float]) -> tuple[str, int, int]:
        """The main text, and how many subtrees the template and then the rules deleted."""
        tags, parents = self.tags, self.parents
        n = len(tags)
        holders = [tag in ("article", "main") for tag in tags]
        for i in range(n - 1, -1, -1):
            if holders[i] and parents[i] >= 0:
                holders[parents[i]] = True
        around = list(holders)
        if "form" in tags and not any(holders):  # some sites put all of a page into one form
            sizes = self.sizes()
            whole = sum(x for x, p in zip(sizes, parents, strict=True) if p < 0)
            around = [tag == "form" and 2 * x >= whole > 0 for tag, x in zip(tags, sizes, strict=True)]
        cut = self.template(self.hashes(), common) if common else [False] * n
        by_template = sum(c and not (parents[i] >= 0 and cut[parents[i]]) for i, c in enumerate(cut))
        # if class and id leave no article of several or one, they don't count for articles
        for words in (True, False):
            gone, marked, heading, by_rule = [False] * n, [False] * n, [False] * n, 0
            for i, tag in enumerate(tags):
                p = parents[i]
                up, body = (gone[p], marked[p]) if p >= 0 else (False, False)
                aside = up or cut[i] or self.says_aside(i, around[i], words)
                marked[i] = body or tag in ("article", "main") and not aside
                if tag == "header":  # of an article, a header keeps its headings alone
                    heading[i] = body
                    aside = aside or not body
                elif p >= 0 and heading[p]:
                    heading[i] = True
                gone[i] = aside
                by_rule += aside and not up and not cut[i]
            if not any(holders) or any(m and not g for m, g in zip(marked, gone, strict=True)):
                break
        only = any(m and not g for m, g in zip(marked, gone, strict=True))
        blocks: list[list[str]] = [[]]
        for i, a, b in self.events:
            if a < 0:
                if b >= 2:
                    blocks.append([]) if b == 3 else blocks[-1].append(" ")
                elif tags[i] in BLOCK and blocks[-1]:
                    blocks.append([])
            elif i < 0 or gone[i] or only and not marked[i]:
                if i < 0 and not only:
                    blocks[-1].append(self.source[a:b])
            elif not heading[i] or self._in_heading(i):
                blocks[-1].append(self.source[a:b])
        lines = (" ".join("".join(map(html_.unescape, b)).split()) for b in blocks)
        return "\n\n".join(x for x in lines if x), by_template, by_rule

    def _in_heading(self, i: int) -> bool:
        while i >= 0:
            if re.fullmatch("h[1-6]", self.tags[i]):
                return True
            i = self.parents[i]
        return False


def host_of(url) -> F.Column:
    """The lower-cased host of a url column; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def site_templates(pages: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE) -> DataFrame:
    """(host, template array<struct<hash, share>>): the subtrees that recur across a host's pages, and on what share of them.

    pages has host and html. A task adds up what it has seen before anything is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            keys = list(counts)
            made = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), pa.array([counts[k] for k in keys], pa.int64())], names=["host", "hash", "n"])
            counts.clear()
            return made

        for batch in batches:
            for piece in slices(batch, 1):
                for host, source in zip(piece.column(0).to_pylist(), texts_of(piece.column(1)).to_pylist(), strict=True):
                    counts.update((host, h) for h in {*Page(source).hashes().values()})
                if len(counts) > HELD_HASHES:
                    yield out()
        yield out()

    counted = pages.select("host", "html").mapInArrow(run, "host string, hash long, n long").groupBy("host", "hash").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_pages)
    sizes = pages.groupBy("host").agg(F.count("*").alias("pages"))
    return counted.join(sizes, "host").filter(F.col("n") >= share * F.col("pages")).groupBy("host").agg(F.collect_list(F.struct("hash", (F.col("n") / F.col("pages")).alias("share"))).alias("template"))


#: Hosts and entries of templates that are broadcast to the pages; more take a join on the host.
MOST_HOSTS, MOST_ENTRIES = 10_000, 1_000_000
#: Parts that the pages of a host are dealt to in that join, if it has a thousandth of all pages.
SALTS = 64


def with_templates(keyed: DataFrame, templates: DataFrame) -> DataFrame:
    """keyed (with host) and each row's template: broadcast if there are few hosts and few entries in all; else joined on host
    and salt, where pages of large hosts, at most a thousand of them, are dealt out and their templates repeated."""
    hosts, entries = templates.agg(F.count("*"), F.coalesce(F.sum(F.size("template")), F.lit(0))).first()
    if hosts <= MOST_HOSTS and entries <= MOST_ENTRIES:
        return keyed.join(F.broadcast(templates), "host", "left")
    total = keyed.count()
    large = stored(keyed.groupBy("host").count().filter(F.col("count") * 1000 >= total).select("host", F.lit(True).alias("large_")), "large")
    salts = F.when(F.col("large_"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    repeated = templates.join(F.broadcast(large), "host", "left").select("host", "template", F.explode(salts).alias("salt_"))
    salt = F.when(F.col("large_"), F.pmod(F.xxhash64(*(c for c in keyed.columns if c != "host")), F.lit(SALTS)).cast("int")).otherwise(0)
    dealt = keyed.join(F.broadcast(large), "host", "left").withColumn("salt_", salt).drop("large_")
    return dealt.join(repeated, ["host", "salt_"], "left").drop("salt_")


def main_text(pages: DataFrame, html: str = "html", url: str = "url", out: str = "text", template: bool = True) -> DataFrame:
    """pages with the main text, n_template and n_rules (subtrees that each deleted) appended; a clashing
    name gets a suffix. All other columns stay. Without `template` the rules alone decide."""
    flat = pick(pages, url=url, html=html).select(host_of(F.col("url")).alias("host"), "html")
    names = pages.columns
    keyed, at = positional(pages), column_index(pages, html)
    keyed = keyed.withColumn("host", host_of(F.col(f"c{column_index(pages, url)}")))
    if template:
        joined = with_templates(keyed, stored(site_templates(flat), "templates")).drop("host")
    else:
        joined = keyed.drop("host").withColumn("template", F.lit(None).cast("array<struct<hash: long, share: double>>"))
    width = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, at):
                found = [
                    Page(source).text({x["hash"]: x["share"] for x in common or ()})
                    for source, common in zip(texts_of(piece.column(at)).to_pylist(), piece.column(width).to_pylist(), strict=True)
                ]
                texts, by_template, by_rule = zip(*found, strict=True) if found else ((), (), ())
                new = [pa.array(texts, pa.string()), pa.array(by_template, pa.int64()), pa.array(by_rule, pa.int64())]
                yield pa.RecordBatch.from_arrays([*piece.columns[:width], *new], names=[*piece.schema.names[:width], "n0", "n1", "n2"])

    fields = [T.StructField("n0", T.StringType()), T.StructField("n1", T.LongType()), T.StructField("n2", T.LongType())]
    schema = T.StructType([*keyed.drop("host").schema.fields, *fields])
    new: list[str] = []
    for name in (out, "n_template", "n_rules"):
        new.append(fresh(name, [*names, *new]))
    return joined.mapInArrow(run, schema).toDF(*names, *new)


def op4_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = pick(table(spark, sf_dir, "pages"), page_id="page_id", url="url", html="html")
    return main_text(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_template", "n_rules")
