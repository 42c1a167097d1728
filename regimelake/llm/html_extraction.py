"""HTML extraction by wrapper induction (operator 10).

The trees of a host's pages are aligned by simple tree matching: nodes match where their parents do, their names (tag
and classes) are equal and they take the same place among siblings of that name. So a node's slot is the path of names and
places that leads to it, all pages of a host align by counting slots, and no pair of trees is ever held. The
wrapper of a host is what the counts say: the content's root, the deepest container under which nearly all text
lies that differs from page to page, and the constant nodes, whose slot says one and the same on the host's pages.
"""

from __future__ import annotations

import hashlib
import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, parts_of, small_batches, spread_join, table

#: The content's root holds this share of the different texts of a host at least.
ROOT_SHARE = 0.95

#: A node is constant if its slot has one text, and pages of so many different main texts say so: what near-copies share is theirs.
AGREE = 2

#: A character of a heading weighs as much as so many others: a title is short, but its article's own.
HEADING = 8

#: The root is looked for among so many containers inside one another; text below them belongs to the last.
DEEPEST = 64

#: Bytes of all wrappers that are broadcast at most.
BROADCAST_BYTES = 32 << 20

# Elements: fixed values of the language. Without content; whose content is no text; that break text into blocks.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style textarea title noscript template iframe".split())
_BLOCK = set("address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_HEADING = set("h1 h2 h3 h4 h5 h6".split())

#: Elements that may be the root of the content.
_CONTAINER = set("body div section main article form td center".split())

#: Elements that are no article by their meaning, and whole words of class, id or role that say so.
_ASIDE = set("head nav footer aside button select option menu dialog svg math canvas audio video object".split()) | _RAW
_WORDS = set("""ad ads advert adverts advertisement advertising sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs sidebar site-footer page-footer footer cookie cookies cookie-banner
cookie-notice consent newsletter subscribe subscription signup login share sharing share-buttons social social-links related related-posts recommended recommendations pagination pager copyright
comment comments comment-list comment-body comment-form commentlist reply replies reader-comments disqus disqus_thread contentinfo complementary""".split())

#: Words of parts that are content if they vary from page to page; on a host of one page they are none.
_MAYBE = set("aside banner promo promotion notice notices alert popup modal overlay widget skip skip-link toolbar site-header masthead".split())
_COMMENT = set("comment comment-body reply".split())

_ATTRIBUTE = re.compile(r"""(?:^|[\s"'])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_NUMBER = re.compile(r"\d{3}")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_PLAIN = re.compile(r"[^>\"']*")

#: What an opening tag ends by itself, up to the elements that hold it.
_ENDS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr",), ("table", "tbody", "thead", "tfoot")), "option": (("option",), ("select",))}


class Node:
    """An element: tag, words (of class, id and role), and children that are nodes or texts."""

    __slots__ = ("tag", "said", "words", "children")

    def __init__(self, tag: str, said: tuple = ()):
        self.tag, self.said, self.children = tag, said, []
        self.words = {re.sub(r"[-_]?\d+$", "", w) for w in said} if said else said

    @property
    def name(self) -> str:
        """The name by which trees align: body and html by their tag alone, as their classes describe the page, and without numbers of three digits, which count pages."""
        return self.tag if self.tag in ("html", "body") or not self.said else f"{self.tag}.{'.'.join(w for w in self.said if not _NUMBER.search(w))}"


class _Scanner:
    """Tags of a source, from left to right. What is looked for in vain is not looked for again, so that any input is read in linear time."""

    def __init__(self, source: str):
        self.source, self.end, self.none = source, len(source), {}

    def find(self, what: str, at: int) -> int:
        if at >= self.none.get(what, self.end + 1):
            return -1
        found = self.source.find(what, at)
        if found < 0:
            self.none[what] = at
        return found

    def tag(self, at: int) -> tuple[int, bool, str, str]:
        """(where it ends, whether it closes, name, attributes) of the tag at `at`; no name for comments and declarations, end `at` for a mere bracket.

        A tag whose quote is never closed ends at the next bracket, one without any with the page.
        """
        s = self.source
        if s.startswith("<!--", at):
            end = self.find("-->", at + 4)
            return (end + 3 if end >= 0 else self.end), False, "", ""
        if s[at + 1 : at + 2] in ("!", "?"):
            end = self.find(">", at)
            return (end + 1 if end >= 0 else self.end), False, "", ""
        closes = s.startswith("</", at)
        m = _NAME.match(s, at + 1 + closes)
        if not m:
            return at, False, "", ""
        here = m.end()
        while True:
            here = _PLAIN.match(s, here).end()
            if here >= self.end:
                return self.end, closes, m[0].lower(), s[m.end() :]
            if s[here] == ">":
                return here + 1, closes, m[0].lower(), s[m.end() : here]
            quote = self.find(s[here], here + 1)
            if quote < 0:
                end = self.find(">", here)
                return (end + 1 if end >= 0 else self.end), closes, m[0].lower(), s[m.end() : end if end >= 0 else self.end]
            here = quote + 1


def parse(source: str) -> Node:
    """A tree of any input, in time in proportion to its length: unknown ends are dropped, open elements end where their parents do."""
    root = Node("#")
    stack, places = [root], {}  # places of the open elements of each tag
    blocks_open: list[int] = []  # places of the open block elements
    scan, at, raw_end = _Scanner(source), 0, {}

    def cut(to: int) -> None:
        while len(stack) > to:
            tag = stack.pop().tag
            places[tag].pop()
            if tag in _BLOCK:
                blocks_open.pop()

    def last(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    while at < scan.end:
        bracket = scan.find("<", at)
        if bracket < 0:
            stack[-1].children.append(html.unescape(source[at:]))
            break
        end, closes, tag, attributes = scan.tag(bracket)
        text = source[at : bracket + (end == bracket)]
        if text:
            stack[-1].children.append(html.unescape(text))
        at = max(end, bracket + 1)
        if not tag:
            continue
        if closes:
            place = last((tag,))
            if place and (tag in _BLOCK or place > last(("article", "main", "body"))):
                cut(place)
            continue
        if tag in _BLOCK and blocks_open and stack[blocks_open[-1]].tag == "p":
            cut(blocks_open[-1])
        if tag in _ENDS:
            ends, within = _ENDS[tag]
            place = last(ends)
            if place > last(within):
                cut(place)
        words = ()
        if attributes:
            words = tuple(sorted({w.lower() for _, a, b, c in _ATTRIBUTE.findall(attributes) for w in (a or b or c).split()}))
        node = Node(tag, words)
        stack[-1].children.append(node)
        if tag in _RAW:
            if at >= raw_end.get(tag, scan.end + 1):
                at = scan.end
                continue
            m = re.compile(f"</{tag}", re.I).search(source, at)
            if not m:
                raw_end[tag], at = at, scan.end
                continue
            close = scan.find(">", m.end())
            at = close + 1 if close >= 0 else scan.end
        elif tag not in _VOID and not attributes.endswith("/"):
            places.setdefault(tag, []).append(len(stack))
            if tag in _BLOCK:
                blocks_open.append(len(stack))
            stack.append(node)
    return root


def _hash(*parts) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(map(str, parts)).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


class Block:
    """A block of text: its slot, the containers above it as (depth, slot), the depths of the deepest article, aside and doubtful part above it (0: none), and whether it is a heading."""

    __slots__ = ("slot", "text", "above", "article", "aside", "maybe", "heading")

    def __init__(self, slot, text, above, article, aside, maybe, heading):
        self.slot, self.text, self.above, self.article, self.aside, self.maybe, self.heading = slot, text, above, article, aside, maybe, heading


def _lengths(root: Node) -> dict[int, int]:
    """Characters of text under each element that a form or a word of its class may rule out."""
    out, todo, counts = {}, [(root, False)], []
    while todo:
        x, done = todo.pop()
        if isinstance(x, str):
            counts[-1] += len(x.strip())
        elif done:
            n = counts.pop()
            out[id(x)] = n
            if counts:
                counts[-1] += n
        elif x.tag not in _RAW:
            counts.append(0)
            todo.append((x, True))
            todo.extend((c, False) for c in x.children)
    return out


def blocks(root: Node, marks: bool = True) -> list[Block]:
    """The blocks of text in page order; without `marks` elements and words rule nothing out.

    A part that holds more than half of a page's text is not ruled out by a word of its class, nor is a heading, and a form around
    it all is none: words describe parts of a page, and what describes the whole describes its article.
    """
    sizes = _lengths(root)
    whole = sizes[id(root)]
    out: list[Block] = []
    run: list[str] = []
    # slot, places of names among the children, runs of text so far, depth, above, article, aside, maybe, heading
    state = [0, {}, 0, 0, (), 0, 0, 0, False]

    def flush():
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            slot, _, n, _, *rest = state
            out.append(Block(_hash(slot, n), text, *rest))
            state[2] += 1

    # Entries: a child to read, or what holds again after an element's end.
    todo: list = [root]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            run.append(x)
        elif isinstance(x, list):
            flush()
            # Places and runs go on where the parent left them.
            state[:] = x
        elif x.tag == "br":
            run.append(" ")
        elif x.tag in _RAW:
            continue
        else:
            words = x.words if marks and x.words and x.tag not in ("html", "body") and x.tag not in _HEADING else ()
            most = 2 * sizes[id(x)] > whole
            main = marks and not (words and words & _COMMENT) and (x.tag in ("article", "main") or "main" in x.words and words and words.isdisjoint(_WORDS))
            aside = marks and (x.tag in _ASIDE or not main and not most and (x.tag == "form" or bool(words) and not words.isdisjoint(_WORDS)) or x.tag == "header" and not state[5])
            maybe = bool(words) and not main and not most and not words.isdisjoint(_MAYBE)
            if x.tag in _BLOCK or main or aside or maybe or x is root:
                flush()
                place = state[1].get(x.name, 0)
                state[1][x.name] = place + 1
                slot, depth, above = _hash(state[0], x.name, place), state[3] + 1, state[4]
                if (x.tag in _CONTAINER or main) and len(above) < DEEPEST:
                    above = (*above, (depth, slot))
                todo.append(list(state))
                state[:] = [slot, {}, 0, depth, above, depth if main else state[5], depth if aside else state[6], depth if maybe else state[7], x.tag in _HEADING]
            todo.extend(reversed(x.children))
    flush()
    return out


def _node(block: Block, host: str) -> int:
    """A slot and its text, in which the host's own name stands for any host's."""
    return _hash(block.slot, block.text.replace(host, "\1") if host else block.text)


def extract(source: str | None, root: int | None = None, constant=frozenset(), single: bool = True, host: str = "", marks: bool = True) -> str:
    """The main text of a page by its host's wrapper.

    root: the slot of the content's root; what lies elsewhere is template. If the root lies in an article, or holds some, it is these. constant: nodes
    that all pages share, template too outside of articles and in their doubtful parts. A page without the root is taken as a whole. Below the root, elements that
    are no article by their meaning go (menus, footers, forms, scripts, reader comments, adverts); doubtful parts, such as notices, go from
    a host of a `single` page, where nothing says whether they vary.
    """
    page = found = blocks(parse(source or ""), marks)
    depth = next((d for b in page for d, slot in b.above if slot == root), 0)
    if depth:
        found = [b for b in page if (depth, root) in b.above]
        # The article around a root is the root.
        around = max((b.article for b in found if b.article < depth), default=0)
        if around:
            depth, at = next(x for x in found[0].above if x[0] == around)
            found = [b for b in page if (depth, at) in b.above]
    kept = [b for b in found if b.aside <= depth and not (single and b.maybe > depth)]
    inside = [b for b in kept if b.article >= max(depth, 1)]
    # What an article repeats on every page is its own, but for doubtful parts.
    return "\n".join(b.text for b in inside or kept if b.article and b.maybe <= depth or _node(b, host) not in constant)


def _host(url) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def _count(batches, marks: bool = True):
    """Sums of each slice of pages: (host, slot, node, length, times, seen, above); node null: pages that have the slot; slot null: pages."""
    for batch in batches:
        for part in parts_of(batch, "html", 1 << 22):
            rows: dict = {}
            for source, host in zip(part.column("html").to_pylist(), part.column("host").to_pylist(), strict=True):
                found = blocks(parse(source or ""), marks)
                # The longest block stands for the main text: pages that have it from one another count once.
                own = (b.text for b in found if not b.aside and not b.maybe)
                bit = 1 << (_hash(max(own, key=lambda t: (len(t), t), default="")) % 62)
                page = rows.setdefault((host, None, None), [0, 0, 0, None])
                page[1], page[2] = page[1] + 1, page[2] | bit
                once = set()
                for b in found:
                    node = _node(b, host)
                    for key in ((host, b.slot, node), (host, b.slot, None)):
                        if key in once:
                            continue
                        once.add(key)
                        r = rows.setdefault(key, [0, 0, 0, None if key[2] is not None else b.above])
                        if key[2] is not None and not b.aside:
                            r[0] = len(b.text) * (HEADING if b.heading else 1)
                        r[1] += 1
                        r[2] |= bit
            keys = list(rows)
            kind = pa.list_(pa.struct([("depth", pa.int32()), ("slot", pa.int64())]))
            yield pa.RecordBatch.from_pydict({
                "host": pa.array([k[0] for k in keys], pa.string()), "slot": pa.array([k[1] for k in keys], pa.int64()), "node": pa.array([k[2] for k in keys], pa.int64()),
                **{c: pa.array([rows[k][i] for k in keys], pa.int64()) for i, c in enumerate(("length", "times", "seen"))},
                "above": pa.array([None if rows[k][3] is None else [{"depth": d, "slot": s} for d, s in rows[k][3]] for k in keys], kind),
            })


def wrappers(pages: DataFrame, marks: bool = True) -> DataFrame:
    """(host, n, kinds, root, constant) of all hosts: their pages, at least how many with a different main text, the slot of the content's root (null: none), and the constant nodes.

    Counts are over all pages and merge within map tasks, so a hot host is dealt over many tasks. A wrapper has a node for a
    slot at most, and grows with the layouts of a host, not with its pages. What comes out does not depend on the order of rows.
    """
    seen = pages.select(_host("url").alias("host"), "html").mapInArrow(lambda batches: _count(batches, marks), "host string, slot long, node long, length long, times long, seen long, above array<struct<depth: int, slot: long>>")
    counts = materialize(seen.groupBy("host", "slot", "node").agg(F.max("length").alias("length"), F.sum("times").alias("times"), F.bit_or("seen").alias("seen"), F.max("above").alias("above")))
    n = counts.filter("slot is null").select("host", F.col("times").alias("n"), F.bit_count("seen").alias("kinds"))
    texts = counts.filter("node is not null").groupBy("host", "slot").agg(F.count(F.lit(1)).alias("texts"), F.sum("length").alias("length"), F.max("node").alias("node"), F.bit_or("seen").alias("seen"))
    texts = materialize(texts.join(counts.filter("node is null and slot is not null").select("host", "slot", "above"), ["host", "slot"]))
    total = texts.groupBy("host").agg(F.sum("length").alias("total"))
    held = texts.select("host", "length", F.explode("above").alias("x")).groupBy("host", "x.depth", "x.slot").agg(F.sum("length").alias("held"))
    roots = held.join(total, "host").filter((F.col("held") > 0) & (F.col("held") >= ROOT_SHARE * F.col("total"))).groupBy("host").agg(F.max(F.struct("depth", "held", "slot"))["slot"].alias("root"))
    same = texts.filter((F.col("texts") == 1) & (F.bit_count("seen") >= AGREE))
    constant = same.groupBy("host").agg(F.array_sort(F.collect_list("node")).alias("constant"))
    out = materialize(n.join(roots, "host", "left").join(constant, "host", "left"))
    discard(counts)
    discard(texts)
    return out


def main_text(pages: DataFrame, broadcast_bytes: int = BROADCAST_BYTES, marks: bool = True) -> DataFrame:
    """(page_id, url, text) of every page.

    Each host's wrapper comes from all its pages; each page is then read alone against it. A null or
    empty html gives an empty text; pages without a host share one wrapper; repeated rows are each
    returned and count once for a wrapper; other columns do not take part; an empty table gives an empty one. Deep, wide, broken and very long
    pages take time in proportion to their length.

    Wrappers of `broadcast_bytes` at most in all, a size that is measured, go to all tasks and no page is
    shuffled; more of them are joined by host, the pages of hot hosts dealt over many tasks. Without `marks` the wrapper alone decides.
    """
    p = pages.select("page_id", "url", "html", _host("url").alias("host"))
    found = wrappers(pages, marks)
    if (found.agg(F.sum(F.octet_length("host") + 24 + 8 * F.coalesce(F.size("constant"), F.lit(0)))).first()[0] or 0) <= broadcast_bytes:
        joined = p.join(F.broadcast(found.drop("n")), "host", "left")
    else:
        joined = spread_join(p, found, ["host"], ["page_id", "url"], "left")

    def run(batches):
        for batch in batches:
            for part in parts_of(batch, "html", 1 << 22):
                columns = (part.column(c).to_pylist() for c in ("html", "root", "constant", "kinds", "host"))
                found = [extract(s, root, frozenset(constant or ()), (kinds or 0) < 2, host, marks) for s, root, constant, kinds, host in zip(*columns, strict=True)]
                yield pa.RecordBatch.from_pydict({"page_id": part.column("page_id"), "url": part.column("url"), "text": pa.array(found, pa.string())})

    kinds = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string"
    return joined.select("page_id", "url", "html", "root", "constant", "kinds", "host").mapInArrow(run, kinds)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    small_batches(spark, 256)
    out = main_text(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
