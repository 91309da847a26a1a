"""Main text of web pages by a site style tree.

The pages of a host are merged by element path (tags with their class and id names): a node of the merged tree has, over
the distinct pages that have it, presentations (sequences of child elements) and contents (the texts directly in it). With
m pages, entropies to the base m + 1 (as if one more page were without it, so that few pages prove little) give

- the presentation's importance, the entropy of the presentations' shares;
- the contents' importance, 1 less the mean of the contents' entropies over pages: a text on all pages has entropy 1;
- the composite importance, DAMP^l times the mean of the l parts' (own contents, children, by the pages that have them),
  and 1 - DAMP^l times the presentation's, from the leaves up.

A branch all of whose nodes are of low importance is removed from each page that has something else. All branches but those that are never
text (scripts, fields of forms, ...) are merged and judged. Menus and adverts whose words change from page to page have a high entropy, however; a
role that is written on an element (nav, footer, class="ad-slot", ...) is a prior against it, which only says less than most of the page's text does: a
named branch, or a form, that holds more than half of it, and not as links, stays, unless it holds comments. Where articles
(<article>, <main>) hold the page's text, it is read within them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, prepare

#: Branches of less importance go (a text that all pages of a host have: 0.19 with three pages, 0.13 with four); weight of a node's parts for each.
LEAST, DAMP = 0.15, 0.9
#: What is nested deeper than this belongs to the element at this depth.
DEEPEST = 40
#: Articles are all of the page's text if they hold this share of what has no role against it.
ARTICLES = 0.2
#: Branches of low importance that are broadcast; beyond that, they are joined with the pages that have them.
BROADCAST_ROWS = 200_000

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPACE = re.compile(r"\s+")
FIRST = re.compile(r"[^-_]*")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: What a start tag closes, up to the nearest of the others.
CLOSES = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr td th", {"table"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}), "option": ("option", {"select"})}
#: Elements that are never text; those with a role other than text; words that say so as a class, id or role, or as its first word
#: ("ad-slot", not "with-ads"); those of readers' comments.
NEVER_TEXT = frozenset("head title script style noscript template button select option textarea iframe svg canvas object audio video".split())
NO_ROLE = frozenset("nav header footer aside dialog menu".split())
NEVER_NAMED = frozenset("html body main article".split())
COMMENTS = frozenset("comment comments reply replies respond disqus discussion".split())
NO_NAME = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs sidebar side aside footer header masthead comment comments reply replies respond disqus discussion notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended widget toolbar pagination pager skip complementary contentinfo search alert".split()
)


class Node:
    """An element: its path as a hash, its parent, its children, and whether its role is against it (NAMED, or a form; TAGGED, or comments;
    NEVER text). Of the text in it: all characters, those in links, those in articles."""

    __slots__ = ("tag", "path", "up", "depth", "role", "main", "kids", "chars", "links", "own")

    def __init__(self, tag: str, path: int, up: Node | None, role: int = 0, main: bool = False):
        self.tag, self.path, self.up, self.role, self.main, self.kids = tag, path, up, role, main, []
        self.depth = up.depth + 1 if up else 0
        self.chars = self.links = self.own = 0

    def closed(self) -> None:
        """Adds its text to its parent's."""
        if self.role < NEVER:
            self.up.chars += self.chars
            self.up.links += self.chars if self.tag == "a" else self.links
            self.up.own += self.chars if self.main else self.own


NAMED, TAGGED, NEVER = 1, 2, 3


def key(*parts: str) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest("\x00".join(parts).encode(errors="replace")), signed=True)


def names_of(attributes: str) -> list[str]:
    """Whole class, id and role names, sorted; their numbers don't count."""
    return sorted({re.sub("[0-9]+", "0", w) for m in NAMES.finditer(attributes) for w in (m[1] or m[2] or m[3] or "").lower().split()}) if attributes.strip() else []


def parse(html: str) -> list[tuple[str, object]]:
    """Events of a page, in order: ("open", node), ("text", decoded text), ("close", node). Every node that opens closes."""
    events: list[tuple[str, object]] = []
    root = Node("", 0, None)
    stack, named = [root], []
    at, n = 0, len(html)

    def close_to(i: int) -> None:
        while len(stack) > i:
            stack[-1].closed()
            events.append(("close", stack.pop()))

    while at < n:
        m = TAG.search(html, at)
        if text := html[at : m.start()] if m else html[at:]:
            events.append(("text", unescape(text) if "&" in text else text))
            stack[-1].chars += len(SPACE.sub("", text))
        if not m:
            break
        at = m.end()
        slash, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if slash:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    close_to(i)
                    break
                if tag not in BLOCK and stack[i].tag in BLOCK:  # an inline end doesn't close blocks
                    break
            continue
        if tag in BLOCK:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close_to(i)
                    break
                if stack[i].tag in BLOCK:
                    break
        if tag in CLOSES:
            ends, until = CLOSES[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in until:
                    break
                if stack[i].tag in ends.split():
                    close_to(i)
                    break
        up, names = stack[-1], names_of(attributes)
        first = {FIRST.match(x)[0] for x in names}
        comments = bool(COMMENTS.intersection(first)) and tag not in ("html", "body", "main")
        main = not comments and (tag in ("article", "main") or "main" in names and "role" in attributes.lower())
        role = NEVER if tag in NEVER_TEXT else 0 if main else TAGGED if tag in NO_ROLE or comments else NAMED if tag == "form" or tag not in NEVER_NAMED and NO_NAME.intersection(first) else 0
        node = Node(tag, key(f"{up.path}/{'.'.join([tag, *names])}"), up, role, main)
        up.kids.append(tag)
        if main:  # what encloses an article isn't an advert, whatever its name
            while up and up.role < TAGGED:
                up.role, up = 0, up.up
        events.append(("open", node))
        if role == NAMED:
            named.append(node)
        if tag in VOID or attributes.endswith("/"):
            events.append(("close", node))
            continue
        stack.append(node)
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}", re.I).search(html, at)
            at = end.start() if end else n
    close_to(1)
    for x in named:
        # most of the page's text is no advert
        if 2 * x.chars > root.chars and 2 * x.links < x.chars and x.own == root.own:
            x.role = 0
    return events


def branches(html: str) -> dict[int, list]:
    """Of each path in the page that may be text: its parent's path, its depth, its presentation in the page, and the hashes of the
    texts in it. What lies deeper than DEEPEST counts as its ancestor's text there."""
    found: dict[int, list] = {}
    here: list[Node] = []
    off = 0
    for kind, x in parse(html):
        if kind == "text":
            if not off and here and (said := SPACE.sub(" ", x).strip()):
                found[here[-1].path][3].add(key(said))
            continue
        step = 1 if kind == "open" else -1
        off += step * (x.role == NEVER)
        if off or x.depth > DEEPEST or kind == "close" and x.role == NEVER:
            continue
        if kind == "open":
            here.append(x)
            if x.path not in found:
                found[x.path] = [x.up.path, x.depth, [], set()]
        else:
            here.pop()
            found[x.path][2].append(" ".join(x.kids))
    return {p: [up, depth, key(*shown), said] for p, (up, depth, shown, said) in found.items()}


def main_text(html: str, unimportant: frozenset | set = frozenset()) -> str:
    """The page's blocks without the unimportant branches (hashes of paths); within its articles if they hold its text. A page of
    which nothing would be left keeps those branches."""
    events = parse(html)
    text = blocks(events, unimportant)
    return text if text or not unimportant else blocks(events, frozenset())


def blocks(events: list[tuple[str, object]], unimportant: frozenset | set) -> str:
    done: list[tuple[str, bool]] = []
    block: list[str] = []
    off = inside = 0

    def end() -> None:
        if text := SPACE.sub(" ", "".join(block)).strip():
            done.append((text, inside > 0))
        block.clear()

    for kind, x in events:
        if kind == "text":
            if not off:
                block.append(x)
            continue
        if x.tag in BLOCK or x.main:
            end()
        elif x.tag == "br":
            block.append(" ")
        step = 1 if kind == "open" else -1
        off += step * (x.role > 0 or x.path in unimportant and not x.main)
        inside += step * (x.main and not off)
    end()
    own = [t for t, main in done if main]
    return "\n".join(own if own and sum(map(len, own)) >= ARTICLES * sum(len(t) for t, _ in done) else [t for t, _ in done])


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def merged(pages: DataFrame) -> DataFrame:
    """(host, branch, up, depth, page, text, value): of each distinct page (by its html) of a host and each path in it, the
    presentation (text false) and each content (text true), as hashes."""

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"host": pa.string(), "branch": pa.int64(), "up": pa.int64(), "depth": pa.int32(), "page": pa.int64(), "text": pa.bool_(), "value": pa.int64()}
        for batch in batches:
            rows = []
            for host, page, html in zip(*(batch.column(c).to_pylist() for c in ("host", "page", "html")), strict=True):
                for p, (up, depth, shown, said) in branches(html or "").items():
                    rows.append((host, p, up, depth, page, False, shown))
                    rows += [(host, p, up, depth, page, True, x) for x in said]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], list(kinds))

    return pages.select("host", "html", F.xxhash64("html").alias("page")).mapInArrow(nodes, "host string, branch long, up long, depth int, page long, text boolean, value long").distinct()


def importance(tree: DataFrame) -> DataFrame:
    """(host, branch, pages, importance, peak) of a merged tree; peak is the greatest importance in the branch."""
    each = tree.groupBy("host", "branch", "up", "depth", "text", "value").agg(F.count("*").alias("n"))
    shown, n = ~F.col("text"), F.col("n")
    own = each.groupBy("host", "branch", "up", "depth").agg(
        F.sum(F.when(shown, n)).alias("pages"), F.sum(F.when(shown, n * F.log(n))).alias("spread"), F.count_if("text").alias("texts"), F.sum(F.when(F.col("text"), F.log(n))).alias("repeated")
    )
    base = F.log(F.col("pages") + 1)
    own = own.withColumn("look", (F.log("pages") - F.col("spread") / F.col("pages")) / base).withColumn("said", F.when(F.col("texts") > 0, 1 - F.col("repeated") / F.col("texts") / base))
    # a page's own look is all there is to see if no other page has the element
    own = own.withColumn("look", F.when(F.col("pages") == 1, 1.0).otherwise(F.col("look"))).withColumn("said", F.when((F.col("pages") == 1) & (F.col("texts") > 0), 1.0).otherwise(F.col("said")))
    own = materialize(own.drop("spread", "texts", "repeated"), "nodes")
    deepest = own.agg(F.max("depth")).first()[0] or 0
    done, below = [], None
    for depth in range(deepest, 0, -1):
        level = own.where(F.col("depth") == depth)
        if below is None:
            level = level.withColumns({"parts": F.lit(0).cast("long"), "weight": F.lit(0).cast("long"), "mean": F.lit(0.0), "above": F.lit(None).cast("double")})
        else:
            level = level.join(below, ["host", "branch"], "left").na.fill({"parts": 0, "weight": 0, "mean": 0.0})
        text = F.col("said").isNotNull().cast("long")
        parts, weight = F.col("parts") + text, F.col("weight") + text * F.col("pages")
        mean = (F.col("mean") + F.coalesce(F.col("said") * F.col("pages"), F.lit(0.0))) / weight
        damp = F.pow(F.lit(DAMP), parts)
        level = level.withColumn("importance", F.when(parts > 0, damp * mean + (1 - damp) * F.col("look")))
        level = materialize(level.select("host", "branch", "up", "pages", "importance", F.greatest("importance", "above").alias("peak")), f"level-{depth}")
        done.append(level.where("importance is not null").select("host", "branch", "pages", "importance", "peak"))
        # elements without any text in them are no part of their parent
        seen = level.where("importance is not null").groupBy("host", F.col("up").alias("branch"))
        below = seen.agg(F.count("*").alias("parts"), F.sum("pages").alias("weight"), F.sum(F.col("pages") * F.col("importance")).alias("mean"), F.max("peak").alias("above"))
    out = done[0] if done else own.select("host", "branch", "pages", F.col("look").alias("importance"), F.col("look").alias("peak"))
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def extract(pages: DataFrame, least: float = LEAST) -> DataFrame:
    """page_id, url, text and n_chars of each row of pages (page_id, url, html).

    A null or empty html has an empty text. Pages without a url, or whose url has no host, are a host of their own.
    Repeated rows are all returned; as evidence of a host's style they count once. A null page_id stays null. Other
    columns are left out. An empty table gives no rows. A tag whose quote isn't closed ends at the next >.
    """
    spark = prepare(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), host_of(F.col("url")).alias("host"))
    tree = materialize(merged(rows), "tree")
    low = materialize(importance(tree).where(F.col("peak") < least).select("host", "branch"), "branches")
    few = low.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    known: dict[str, set] = {}
    if few:
        for r in low.collect():
            known.setdefault(r.host, set()).add(r.branch)
        rows = rows.withColumn("low", F.lit(None).cast("array<long>"))
    else:
        # no more of them for a page than it has branches
        own = tree.select("host", "page", "branch").join(low, ["host", "branch"], "left_semi").groupBy("host", "page").agg(F.collect_set("branch").alias("low"))
        rows = rows.withColumn("page", F.xxhash64("html")).join(own, ["host", "page"], "left")
    sent = spark.sparkContext.broadcast(known)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html, set(own) if own else sent.value.get(host, frozenset())) for html, host, own in zip(*(batch.column(c).to_pylist() for c in ("html", "host", "low")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(read, "page_id long, url string, text string, n_chars long")
