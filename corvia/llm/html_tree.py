"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree: an element node is a path of tags and classes, a style
node one sequence of child tags seen at it, a content node one text seen at it. The tree is never held
in one place; it is tables of counts, added up by partial aggregation, so a host with a third of all
pages is no group anywhere. A path is a rolling hash, and elements more than DEPTH levels deep fold into
their ancestor at that level, label by label, so work and rows are linear in a page, however nested.

Importance. With m pages that have an element, the entropy of its style nodes, to the base m (64 at most:
further pages make no look more varied), is its presentation importance: 0 where all pages look alike. A
text that k of the m pages show there has the content importance 1 - log_m(k): 0 where all say the same.
Both are composed up the branches: the content mass of a branch is the length of all texts in it, each
times its importance, as a mean of the pages that have it; its variety is the largest presentation importance in it. A branch weighs
mass * (SLOT + (1 - SLOT) * variety) * hint: a slot that looks the same on every page weighs little, whatever
fills it. Hosts with few pages lean on the tree of all hosts, which counts as much as `lean` pages.

Removal. From the root down, elements are frames as long as they look alike (the root, html and body always,
articles and main elements never). A branch of a frame goes when it weighs less than `share` of the
heaviest branch beside it; headings stay with what they head, and what holds an article or main element stays. What is no frame is content, and in it, as anywhere,
a branch goes whose mean importance, times its hint, is under `content`, unless it is half or more of its
parent's text. Last, a single text goes that all but few pages of the host show (importance under `strict`)
in a place whose texts else differ. Copies of an article, on however many pages, count as one page
for the texts of articles.

What HTML names as no text (scripts, styles, head) or as no main text (navigation, page headers, footers,
asides, forms, their roles) is left out from the start. HINTS, class words for adverts and comments, an
article in an article, and a place beside an article or main element only lower a weight, to a quarter. A page that is left without text, and has no article or main
element, keeps all its blocks.

Text. Character references are decoded, white space inside a block becomes one space, blocks are trimmed
and joined in page order by one space.

Defined results: null or empty html gives an empty text; broken, unclosed or truncated markup is read as
far as it goes, a tag that never ends is no text; a null url is a host of its own; repeated rows give
repeated rows; empty input gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as html_
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urlsplit

import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from corvia.llm.arrow import map_rows
from corvia.llm.store import materialise

NOISE_TAGS = frozenset(
    "nav header footer aside form script style noscript template iframe object embed svg button select textarea "
    "dialog menu head title audio video canvas".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar alert dialog".split())
HINTS = frozenset("ad ads advert adverts advertisement sponsored comment comments".split())
HINT, SLOT, VARIED, DEPTH = 0.25, 0.2, 0.25, 48
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr "
    "main menu nav ol p pre section table ul".split()
)
SELF_CLOSING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table article section div main body html".split())
REST = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+""")
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORDS = re.compile(r"[a-z]+")


def _hash(*parts) -> int:
    h = xxhash.xxh3_64_intdigest("\0".join(map(str, parts)).encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


@dataclass(eq=False)
class Place:
    """An element node as a page alone knows it: its path, what is above it, what HTML says of it."""

    path: int
    above: tuple[Place, ...]
    tag: str
    sealed: bool  # an article or main element, or inside of one
    hint: float
    inside: dict[str, Place] = field(default_factory=dict)

    def child(self, label: str, tag: str, sealed: bool, hint: float) -> Place:
        found = self.inside.get(label)
        if found is None:
            above = self.above if len(self.above) == DEPTH else (*self.above, self)
            found = Place(_hash(above[-1].path, label), above, tag, sealed, hint)
            if above is self.above:  # folded: the ancestor at that level knows it
                found = above[-1].inside.setdefault(label, found)
            self.inside[label] = found
        return found


@dataclass
class Element:
    tag: str
    place: Place
    noise: bool
    children: list[str] = field(default_factory=list)


def parse(source: str) -> tuple[list[tuple[Place, str]], list[Element]]:
    """The blocks of text outside of what HTML names as noise, and all elements there with their children's tags."""
    blocks: list[tuple[Place, str]] = []
    root = Element("", Place(0, (), "", False, 1.0), False)
    stack, elements, held = [root], [root], []
    last_of: dict[str, list[int]] = {}  # places of open elements by tag
    at, n = 0, len(source)

    def flush() -> None:
        if held:
            text = " ".join(html_.unescape("".join(held)).split())
            held.clear()
            if text:
                block = next((e for e in reversed(stack) if e.tag not in INLINE), root)
                blocks.append((block.place, text))

    def pop_to(k: int) -> None:
        if any(e.tag not in INLINE for e in stack[k:]):
            flush()
        for e in stack[k:]:
            last_of[e.tag].pop()
        del stack[k:]

    def last(tag: str) -> int:
        open_ = last_of.get(tag)
        return open_[-1] if open_ else 0

    def close_in_scope(tags: tuple[str, ...]) -> None:
        scope = max(map(last, SCOPES))
        for tag in tags:
            if last(tag) > scope:
                pop_to(last(tag))

    while at < n:
        lt = source.find("<", at)
        if lt < 0:
            lt = n
        if lt > at and not stack[-1].noise:
            held.append(source[at:lt])
        if lt == n:
            break
        if source.startswith("<!--", lt):
            end = source.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        closing = source.startswith("</", lt)
        name = NAME.match(source, lt + 2 if closing else lt + 1)
        if not name:
            if source.startswith(("<!", "<?", "</"), lt):
                end = source.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                if not stack[-1].noise:
                    held.append("<")
                at = lt + 1
            continue
        end = REST.match(source, name.end()).end()
        if not source.startswith(">", end):
            end = source.find(">", end)
            if end < 0:
                break
        inner, tag, at = source[name.end() : end], name[0].lower(), end + 1
        if closing:
            k = last(tag)
            if k:
                pop_to(k)
            elif tag not in INLINE:
                flush()
            continue
        if tag in CLOSES_P:
            close_in_scope(("p",))
        if tag in SELF_CLOSING:
            close_in_scope(SELF_CLOSING[tag])
        if tag == "br":
            held.append(" ")
            continue
        if tag not in INLINE:
            flush()
        if tag in VOID:
            continue
        top = stack[-1]
        if not top.noise:
            top.children.append(tag)
        words: set[str] = set()
        role = ""
        if inner.strip():
            for m in ATTRIBUTE.finditer(inner):
                value = (m[2] or m[3] or m[4] or "").lower()
                if m[1].lower() == "role":
                    role = value.strip()
                else:
                    words.update(WORDS.findall(value))
        if tag in RAW:
            shut = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, at)
            at = n if not shut else shut.start()
        within = top.place.sealed
        main = tag in ("article", "main") or role == "main"
        noise = top.noise or tag not in ("html", "body", "article", "main") and (
            tag in NOISE_TAGS and not (tag == "header" and within) or role in ROLES
        )
        if noise:
            place = top.place
            if not top.noise:
                flush()
        else:
            told = tag == "article" and within or not main and tag not in ("html", "body") and bool(words & HINTS)
            label = tag + "." + "-".join(sorted(words)) if words else tag
            place = top.place.child(label, tag, within or main, HINT if told else 1.0)
        e = Element(tag, place, noise)
        last_of.setdefault(tag, []).append(len(stack))
        stack.append(e)
        if not noise:
            elements.append(e)
    flush()
    return blocks, elements


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def article_of(blocks: list[tuple[Place, str]]) -> int:
    """The digest of a page's articles or main elements, else of all its text."""
    inside = [text for place, text in blocks if place.sealed]
    return _hash(*(inside or [text for _, text in blocks]))


#: Kinds of rows: a page of the host, by article; an element; a style of it; a text, outside and inside of articles; what a node is.
PAGE, ELEMENT, STYLE, TEXT, ARTICLE_TEXT, NODE = range(6)
ROW = "kind int, page binary, block int, node long, value long, chars long, unit long, host long, path long, above array<long>, free boolean, frame boolean, hint double"


def _rows(pages: DataFrame) -> DataFrame:
    """page, url, html -> what each page adds to the tree of its host; NODE rows once a task for each node."""

    def make():
        known: set[int] = set()

        def work(keys, urls, sources):
            out: dict[str, list] = {c.split()[0]: [] for c in ROW.split(", ")}

            def add(kind, page, block=None, node=None, value=None, chars=None, unit=None, host=None, path=None, above=None, free=None, frame=None, hint=None):
                row = (kind, page, block, node, value, chars, unit, host, path, above, free, frame, hint)
                for column, x in zip(out.values(), row, strict=True):
                    column.append(x)

            if len(known) > 200_000:
                known.clear()
            for key, url, source in zip(keys, urls, sources, strict=True):
                host = host_of(url)
                blocks, elements = parse(source or "")
                site, article = _hash(host), article_of(blocks)
                add(PAGE, None, host=site, unit=article)
                ids: dict[int, int] = {}

                def node_of(place):
                    if place.path not in ids:
                        ids[place.path] = _hash(host, place.path)
                    return ids[place.path]

                seen: set[tuple] = set()
                for e in elements:
                    node = node_of(e.place)
                    if node not in seen:
                        seen.add(node)
                        add(ELEMENT, None, node=node)
                        style = _hash(*e.children)  # of several alike in a page, the first
                        add(STYLE, None, node=node, value=style)
                        if node not in known:
                            known.add(node)
                            p = e.place
                            add(
                                NODE, None, node=node, host=site, path=p.path, above=[node_of(a) for a in p.above],
                                free=p.tag in HEADINGS, frame=None if p.sealed else p.tag in ("", "html", "body"), hint=p.hint,
                            )
                for i, (place, text) in enumerate(blocks):
                    kind = ARTICLE_TEXT if place.sealed else TEXT
                    add(kind, key, i, node_of(place), _hash(text), len(text), article, site)
            yield out

        return work

    return map_rows(pages, ROW, make)


def _entropy(styles: DataFrame, by: str) -> DataFrame:
    """by, value, n -> by, m, presentation: entropy to the base of m, 64 at most; 1 with one page."""
    total = styles.groupBy(by).agg(F.sum("n").alias("m"))
    share = F.col("n") / F.col("m")
    return (
        styles.join(total, by).groupBy(by).agg(F.sum(-share * F.log(share)).alias("h"), F.first("m").alias("m"))
        .select(by, "m", F.when(F.col("m") > 1, F.least(F.col("h") / F.log(F.least("m", F.lit(64.0))), F.lit(1.0))).otherwise(1.0).alias("presentation"))
    )


def _importance(k: Column, m: Column) -> Column:
    return F.when(m > 1, F.greatest(1 - F.log(k) / F.log(m), F.lit(0.0))).otherwise(1.0)


def low_parts(rows: DataFrame, share: float, content: float, strict: float, presentation: float, lean: float) -> DataFrame:
    """Rows of pages -> node, value: nodes whose texts all go (value null), and single texts that go."""
    nodes = materialise(
        rows.where(F.col("kind") == NODE).groupBy("node")
        .agg(*(F.min(c).alias(c) for c in ("host", "path", "above", "free", "frame", "hint"))), "tree-nodes",
    )
    plain = rows.where(F.col("kind").isin(ELEMENT, STYLE)).groupBy("kind", "node", "value").agg(F.count("*").alias("n"))
    plain = materialise(plain, "tree-counts")
    styles = plain.where(F.col("kind") == STYLE).select("node", "value", "n")
    pages = plain.where(F.col("kind") == ELEMENT).select("node", F.col("n").alias("m"))
    # A page counts once for a text at a place, and all pages with one article once for a text of it.
    unit = F.when(F.col("kind") == ARTICLE_TEXT, F.struct(F.col("unit"), F.lit(None).cast("binary").alias("page"))).otherwise(
        F.struct(F.lit(None).cast("long").alias("unit"), F.col("page"))
    )
    shown = (
        rows.where(F.col("kind").isin(TEXT, ARTICLE_TEXT)).select("kind", "node", "value", "chars", "host", unit.alias("unit")).distinct()
        .groupBy("kind", "node", "value").agg(F.count("*").alias("k"), F.max("chars").alias("chars"), F.first("host").alias("host"))
    )
    units = rows.where(F.col("kind") == PAGE).select("host", "unit").distinct().groupBy("host").agg(F.count("*").alias("units"))
    m = F.when(F.col("kind") == ARTICLE_TEXT, F.col("units")).otherwise(F.col("m"))
    texts = materialise(
        shown.join(pages, "node").join(units, "host")
        .select("node", "value", "k", (F.col("k") * F.col("chars")).alias("chars"), _importance(F.col("k"), m).alias("importance")), "tree-texts",
    )
    own = texts.groupBy("node").agg(F.sum("chars").alias("chars"), F.sum(F.col("chars") * F.col("importance")).alias("mass"))
    looks = _entropy(styles, "node")
    own = nodes.select("node", "above", F.col("frame").isNull().alias("sealed")).join(looks, "node", "left").join(own, "node", "left")
    # Composed up the branches: every node adds to itself and to what is above it.
    branches = (
        own.select(F.explode(F.concat("above", F.array("node"))).alias("node"), "chars", "mass", "presentation", "sealed")
        .groupBy("node").agg(F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"), F.coalesce(F.sum("mass"), F.lit(0.0)).alias("mass"), F.max("presentation").alias("variety"), F.max("sealed").alias("holds"))
    )
    local = materialise(nodes.join(branches, "node").join(looks, "node"), "tree-branches")
    # The tree of all hosts, by path.
    everywhere = _entropy(
        styles.join(nodes.select("node", "path"), "node").groupBy("path", "value").agg(F.sum("n").alias("n")), "path"
    ).select("path", F.col("presentation").alias("presentation_all"))
    ups = nodes.join(everywhere, "path").select(F.explode(F.concat("above", F.array("node"))).alias("node"), "presentation_all")
    ups = ups.groupBy("node").agg(F.max("presentation_all").alias("variety_all"))
    per_path = local.groupBy("path").agg((F.sum("mass") / F.sum("m")).alias("mass_all")).join(everywhere, "path")
    mixed = local.join(per_path, "path").join(ups, "node")

    def blend(host: str, whole: str) -> Column:
        return ((F.col("m") - 1) * F.col(host) + lean * F.col(whole)) / (F.col("m") - 1 + lean)

    mixed = mixed.select(
        "node", "above", "free", "hint",
        F.when(F.size("above") > 0, F.element_at("above", -1)).alias("parent"),
        "holds",
        (F.col("chars") / F.col("m")).alias("chars"),
        (F.col("mass") / F.col("m")).alias("mass"),
        ((F.col("mass") + lean * F.col("mass_all")) / (F.col("m") + lean)).alias("leaning"),
        blend("variety", "variety_all").alias("variety"),
        F.when(F.col("frame").isNull(), False).otherwise(F.col("frame") | (blend("presentation", "presentation_all") < presentation)).alias("frame"),
    )
    weight = F.col("leaning") * (SLOT + (1 - SLOT) * F.col("variety")) * F.col("hint")
    mixed = materialise(mixed.withColumn("weight", weight), "tree-weights")
    beside = mixed.where("parent IS NOT NULL").groupBy("parent").agg(F.max("weight").alias("best"), F.max("holds").alias("named"))
    parent = mixed.select(F.col("node").alias("parent"), F.col("chars").alias("chars_above"))
    closed = mixed.where("NOT frame").select(F.col("node").alias("up"))
    shut = mixed.select("node", F.explode("above").alias("up")).join(closed, "up").select("node").distinct().withColumn("shut", F.lit(True))
    judged = mixed.join(beside, "parent").join(parent, "parent").join(shut, "node", "left")
    beside_article = F.when(F.col("named") & ~F.col("holds"), HINT).otherwise(1.0)
    light = F.col("shut").isNull() & ~F.col("free") & ~F.col("holds") & (F.col("weight") * beside_article < share * F.col("best"))
    dull = (F.col("hint") * F.col("mass") < content * F.col("chars")) & (F.col("chars") * 2 < F.col("chars_above"))
    low = judged.where(light | dull).select("node")
    gone = (
        nodes.select("node", F.explode(F.concat("above", F.array("node"))).alias("up")).join(low.select(F.col("node").alias("up")), "up")
        .select("node").distinct()
    )
    varied = local.where(F.col("mass") >= VARIED * F.col("chars")).select("node")
    single = texts.where((F.col("importance") < strict)).join(varied, "node", "left_semi").select("node", "value")
    return materialise(gone.select("node", F.lit(None).cast("long").alias("value")).unionByName(single), "low-parts")


def _texts(pages: DataFrame, drop_of) -> DataFrame:
    """page_id, url, html and what else drop_of reads -> page_id, url, text, n_chars."""

    def make():
        def work(ids, urls, sources, *more) -> Iterator[dict[str, list]]:
            texts = []
            for row, (url, source) in enumerate(zip(urls, sources, strict=True)):
                found, elements = parse(source or "")
                gone = drop_of(url, found, *(column[row] for column in more))
                kept = [text for i, (_, text) in enumerate(found) if i not in gone]
                if not kept and not any(e.place.sealed for e in elements):
                    kept = [text for _, text in found]
                texts.append(" ".join(kept))
            yield {"page_id": ids, "url": urls, "text": texts, "n_chars": [len(t) for t in texts]}

        return work

    kind = pages.schema["page_id"].dataType.simpleString()
    return map_rows(pages, f"page_id {kind}, url string, text string, n_chars long", make)


def main_text(
    pages: DataFrame, share: float = 0.2, content: float = 0.3, strict: float = 0.02, presentation: float = 0.5, lean: float = 8.0,
    few: int = 300_000,
) -> DataFrame:
    """page_id, url, html -> page_id, url, text, n_chars. With share, content and strict 0 nothing goes by the tree.

    What goes is a table of nodes and texts of hosts. With at most `few` rows (some MB) every task gets it whole;
    a larger one is joined to the blocks of pages, whose numbers are joined to the pages. Both give the same texts.
    """
    identity = F.concat_ws("\0", F.col("page_id").cast("string"), F.coalesce("url", F.lit("")), F.coalesce("html", F.lit("")))
    keyed = pages.select("page_id", "url", "html", F.unhex(F.md5(identity)).alias("page"))
    rows = materialise(_rows(keyed.select("page", "url", "html")), "tree-rows")
    low = low_parts(rows, share, content, strict, presentation, lean)
    if low.count() <= few:
        held = low.toArrow()
        pairs = list(zip(held["node"].to_pylist(), held["value"].to_pylist(), strict=True))
        at_hand = pages.sparkSession.sparkContext.broadcast((frozenset(n for n, v in pairs if v is None), frozenset(p for p in pairs if p[1] is not None)))

        def by_set(url, found):
            whole, single = at_hand.value
            host, gone = host_of(url), set()
            for i, (place, text) in enumerate(found):
                node = _hash(host, place.path)
                if node in whole or single and (node, _hash(text)) in single:
                    gone.add(i)
            return gone

        return _texts(pages.select("page_id", "url", "html"), by_set)
    blocks = rows.where(F.col("kind").isin(TEXT, ARTICLE_TEXT)).select("page", "block", "node", "value")
    whole = low.where("value IS NULL").select("node").withColumn("whole", F.lit(True))
    single = low.where("value IS NOT NULL").withColumn("single", F.lit(True))
    hits = blocks.join(whole, "node", "left").join(single, ["node", "value"], "left").where("whole OR single")
    hits = materialise(hits.groupBy("page").agg(F.collect_set("block").alias("blocks")), "template-blocks")
    joined = keyed.join(hits, "page", "left").select("page_id", "url", "html", "blocks")
    return _texts(joined, lambda url, found, drop: set(drop or ()))
