"""HTML extraction by consensus host paths.

Each page is read into blocks with the path of containers they stand in.  A
page's main container is found from the top down: as long as one child holds
all of the text that is not boilerplate or links, it is the better answer, but
never one inside an article or main.  Its path of tags and classes, digits
removed, is the page's vote.  Spark counts votes by host; each page is then read
again with its host's winning path, or with its own if that path does not cover
all such text of the page.

Boilerplate, left out wherever it stands: navigation, footers, asides, scripts,
styles, hidden elements, headers outside an article.  Forms, and elements whose
class, id or role says advert, menu, notice, comment and the like, are left out
too, but a name alone is no proof: a form with most of the page's text stays,
another such element if it has the page's heading or article as well, and inside an article a name that only starts or ends with such a word counts
only where the element is mostly links.  One walk over the page reads its tags;
every character is looked at a fixed number of times, however broken they are.

Defined cases: null and empty html give an empty text; no tags: all of it is
text; unclosed tags end with their parent or, for p and li, at the next of
their kind; a quote that never closes ends with its tag; very long pages are
read whole; a null url is a host of its own; rows that repeat are extracted
each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, small_batches, table

NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
#: A name, and a value in either quote or in none; read on from where a tag's name ends.
ATTRIBUTE = re.compile(r"[\s/]*+([^\s/>=\"'][^\s/>=]*+|[=\"'])(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article main section div td body html blockquote center".split())
DROP_TAGS = frozenset("nav footer aside button select menu dialog head".split()) | RAW
#: Words of a class, id or role that mark boilerplate: fixed values.
DROP_WORDS = frozenset("ad ads adbox advert adverts advertisement sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs footer sidebar aside complementary notice notices cookie cookies consent gdpr popup modal overlay comment comments discussion replies disqus respond form search login signup subscribe newsletter share sharing social related recommended widget pagination pager toolbar masthead contentinfo hidden".split())
#: Those that mean it as a part of a longer name too.
STRONG_WORDS = frozenset("ad ads adbox advert adverts advertisement sponsored navbar navigation breadcrumb breadcrumbs footer sidebar cookie cookies consent gdpr comments disqus newsletter pagination pager".split())
COMMENT_WORDS = frozenset("comment comments discussion replies disqus respond".split())
HEAD_WORDS = frozenset("header banner topbar".split())
SELF_CLOSING = {"p": BLOCK, "li": frozenset(["li"]), "dd": frozenset(["dd", "dt"]), "dt": frozenset(["dd", "dt"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"]), "option": frozenset(["option"])}


#: Bytes of all hosts' winning paths up to which they are broadcast.
BROADCAST_BYTES = 16 << 20


class Element:
    """drop: boilerplate for certain; doubt: by its name ('linked': only if it is mostly links)."""

    __slots__ = ("tag", "name", "parent", "drop", "article", "doubt", "comment")

    def __init__(self, tag, name, parent, drop, article, doubt, comment):
        self.tag, self.name, self.parent, self.drop, self.article, self.doubt, self.comment = tag, name, parent, drop, article, doubt, comment


def element(tag: str, attributes: dict[str, str], parent: Element | None) -> Element:
    names, drop, doubt, comment = [], tag in DROP_TAGS, "form" if tag == "form" else None, False
    article = tag in ("article", "main") or (parent is not None and parent.article)
    style = attributes.get("style", "")
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or style and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", style):
        drop = True
    classes = attributes.get("class", "").split()
    names = sorted({re.sub(r"\d+", "", c.lower()) for c in classes})
    if tag not in ("body", "html", "article", "main"):
        for whole in [*classes, attributes.get("id", ""), *attributes.get("role", "").split()]:
            parts = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", whole).lower()) if w]
            hit = DROP_WORDS.intersection(parts)
            if len(parts) == 1 and hit or STRONG_WORDS.intersection(parts) or hit and not article:
                doubt = doubt or "name"
            elif hit:
                doubt = doubt or "linked"
            comment = comment or bool(COMMENT_WORDS.intersection(parts)) and doubt == "name"
            if not article and HEAD_WORDS.intersection(parts):
                doubt = doubt or "name"
    if not article and tag == "header":
        drop = True
    return Element(tag, ".".join([tag, *names]), parent, drop or (parent is not None and parent.drop), article, doubt, comment)


def attributes_at(source: str, at: int, last: dict[str, int]) -> tuple[dict[str, str], int]:
    """Attributes of a tag whose name ends at `at`, and where the tag is over.

    last: the place of each quote's last occurrence in the page."""
    out: dict[str, str] = {}
    end = len(source)
    while at < end:
        if source[at] == ">":
            return out, at + 1
        m = ATTRIBUTE.match(source, at)
        if m is None:  # white space before the tag's end
            at += 1
            continue
        value = m[4] or ""
        if value[:1] in ("'", '"') and last[value[0]] <= m.start(4):
            value = value[1:]  # it never closes
        out.setdefault(m[1].lower(), m[2] if m[2] is not None else m[3] if m[3] is not None else value)
        at = m.end()
    return out, end


def blocks(source: str) -> list[tuple[Element | None, str, int]]:
    """(innermost element, text, letters in links) of each block, in page order,
    without those that are boilerplate.

    A block's text lies between block tags; inline tags do not part it.
    """
    return judged(all_blocks(source))


def judged(found: list[tuple[Element | None, str, int]]) -> list[tuple[Element | None, str, int]]:
    """Blocks outside the elements whose names turn out to tell the truth."""
    letters: dict[int, list[int]] = {}
    doubted: dict[int, Element] = {}
    heads: set[int] = set()
    total = 0
    for x, text, links in found:
        total += max(0, len(text) - 2 * links)
        inside = set()
        while x is not None:
            inside.add(x.tag)
            if x.doubt:
                doubted[id(x)] = x
                n = letters.setdefault(id(x), [0, 0, 0])
                n[0] += len(text)
                n[1] += links
                n[2] += max(0, len(text) - 2 * links)
                if inside & {"h1", "main"} or not x.comment and "article" in inside:
                    heads.add(id(x))
            x = x.parent
    gone = set()
    for k, x in doubted.items():
        size, links, weight = letters[k]
        most = 2 * weight > total
        if x.doubt == "linked":
            out = 2 * links > size
        elif x.doubt == "form":
            out = not most
        else:
            out = not (most and k in heads)
        if out:
            gone.add(k)

    def stays(x: Element | None) -> bool:
        while x is not None:
            if id(x) in gone:
                return False
            x = x.parent
        return True

    return [b for b in found if stays(b[0])] if gone else found


def all_blocks(source: str) -> list[tuple[Element | None, str, int]]:
    out: list[tuple[Element | None, str, int]] = []
    top: Element | None = None
    parts: list[str] = []
    home: Element | None = None
    links, in_link, at = 0, 0, 0
    last = {q: source.rfind(q) for q in "\"'"}

    def flush():
        nonlocal parts, links
        text = " ".join("".join(parts).split())
        if text:
            out.append((home, text, links))
        parts, links = [], 0

    def put(raw: str):
        nonlocal home, links
        if not raw or (top is not None and top.drop):
            return
        text = entities.unescape(raw) if "&" in raw else raw
        if not parts or not home:
            home = top
        parts.append(text)
        if in_link:
            links += len(text)

    end = len(source)
    while at < end:
        i = source.find("<", at)
        if i < 0:
            put(source[at:])
            break
        put(source[at:i])
        after = source[i + 1 : i + 2]
        if after in ("!", "?"):
            if source.startswith("<!--", i):
                j = source.find("-->", i + 4)
                at = j + 3 if j >= 0 else end
            else:
                j = source.find(">", i)
                at = j + 1 if j >= 0 else end
            continue
        closing = after == "/"
        name = NAME.match(source, i + 1 + closing)
        if name is None:  # a sign, not a tag
            put("<")
            at = i + 1
            continue
        tag = name[0].lower()
        attributes, at = attributes_at(source, name.end(), last)
        alone = source.startswith("/>", at - 2)
        if tag == "br":
            put(" ")
            continue
        block = tag in BLOCK
        if closing:
            x = top
            while x is not None and x.tag != tag:
                x = x.parent
            if block:
                flush()
            if x is not None:
                top = x.parent
            if tag == "a":
                in_link = 0
            continue
        if tag in RAW:
            if not alone:
                close = closer(tag).search(source, at)
                at = close.end() if close else end
            continue
        if block:
            flush()
            x = top
            while x is not None and x.tag not in CONTAINERS:
                if x.tag in SELF_CLOSING and tag in SELF_CLOSING[x.tag]:
                    top = x.parent
                    break
                if x.tag in ("ul", "ol", "dl", "table", "tbody") and x.tag != tag:
                    break
                x = x.parent
        if tag in VOID or alone:
            continue
        if tag == "a":
            in_link = 1
        top = element(tag, attributes, top)
    flush()
    return out


@functools.cache
def closer(tag: str) -> re.Pattern:
    return re.compile(r"</" + re.escape(tag) + r"\s*>", re.I)


def chain(x: Element | None) -> list[Element]:
    """The containers of an element, outermost first."""
    out = []
    while x is not None:
        if x.tag in CONTAINERS:
            out.append(x)
        x = x.parent
    return out[::-1]


def path_of(containers: list[Element]) -> str:
    return ">".join(x.name for x in containers)


def weight(text: str, links: int) -> int:
    return max(0, len(text) - 2 * links)


def main_path(found: list[tuple[Element | None, str, int]]) -> tuple[str, int]:
    """(path, letters) of the innermost container that holds all of the text, not inside an article."""
    weights: dict[int, int] = {}
    nodes: dict[int, list[Element]] = {}
    total = 0
    for x, text, links in found:
        w = weight(text, links)
        total += w
        containers = chain(x)
        for i, c in enumerate(containers):
            weights[id(c)] = weights.get(id(c), 0) + w
            nodes[id(c)] = containers[: i + 1]
    best: list[Element] = []
    for k, w in weights.items():
        if w == total > 0 and len(nodes[k]) > len(best) and not any(x.tag in ("article", "main") for x in nodes[k][:-1]):
            best = nodes[k]
    return path_of(best), weights.get(id(best[-1]), 0) if best else 0


def text_at(found: list[tuple[Element | None, str, int]], path: str | None) -> str:
    """Blocks under containers of this path; of the page's own main path if they are not all its text."""
    own = main_path(found)[0]
    for wanted in (path, own):
        if not wanted:
            continue
        depth = wanted.count(">") + 1
        kept = [(text, links) for x, text, links in found if path_of(chain(x)[:depth]) == wanted]
        if kept and sum(weight(*x) for x in kept) == sum(weight(text, links) for _, text, links in found):
            return " ".join(text for text, _ in kept)
    return " ".join(text for _, text, _ in found)


def _votes(batches):
    for batch in batches:
        paths, sizes = [], []
        for source in batch.column(1):
            path, size = main_path(blocks(source.as_py() or ""))
            paths.append(path), sizes.append(size)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], ["host", "path", "size"])


def _texts(batches):
    for batch in batches:
        texts = [text_at(blocks(s.as_py() or ""), p.as_py()) for s, p in zip(batch.column(2), batch.column(3))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row."""
    small_batches(pages.sparkSession, 500)
    host = F.coalesce(F.lower(F.regexp_extract(F.col("url"), "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host.alias("host"))
    votes = rows.select("host", "html").mapInArrow(_votes, "host string, path string, size long")
    counted = votes.where("path <> ''").groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    winners = saved(counted.groupBy("host").agg(F.max_by("path", F.struct("n", "size", "path")).alias("path")))
    # Few hosts are broadcast, so that no html is shuffled; beyond, a hot host's pages are split by the skew join.
    size = winners.agg(F.count("*").alias("k"), F.sum(F.length("host") + F.length("path")).alias("n")).first()
    side = F.broadcast(winners) if (size["n"] or 0) + 64 * size["k"] <= BROADCAST_BYTES else winners
    return rows.join(side, "host", "left").select("page_id", "url", "html", "path").mapInArrow(_texts, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
