"""Main text of web pages by consensus host paths.

Every page's elements are scored by the text they hold that is neither
boilerplate nor links; the page votes for the generalised path (tags and
classes from the root, digits folded) of its best one. Spark sums the votes
per host, and each page is extracted again under the first of its host's
winning paths that it has, so one odd page (a short article beside a long
notice) follows the rest of its host.

Elements are left out for what they are (nav, footer, form, ...) or for what
their class, id or role says in full: every word of a name must be a mark or
one of the neutral words around marks, so "ad-box" is an advert and
"share-price" is not. No such name leaves out an element without which less than
an eighth of the page's own text would remain, unless it names reader comments.

Votes are summed by partial aggregation, so a host with a third of all pages
is no hot key there; hosts with many pages find their winning paths by
broadcast (:func:`millrace.llm.common.lookup`), the others by a join. All paths
with a twentieth of their host's votes win, so that a host of several templates
has one for each: there are at most twenty.

Parsing takes time in proportion to the page: a tag whose quote never ends, and
all tags after it, end at their next ">", and after the last ">" there are no
tags; paths of more than 512 characters go on as a digest.

Defined cases: null or empty html has empty text and no vote; a null url, or
one without a host, counts as host ''; a page that has none of its host's
paths uses its own best element; unclosed and misnested tags are closed as
browsers would in the common cases; repeated rows each vote and are each
extracted; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import lookup, save

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']|"[^"]*"|'[^']*')*+)>""", re.S)
#: As TAG, with tags that end at their next ">"; and the start of one.
PLAIN_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
STARTS = re.compile(r"</?[a-zA-Z]")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
SPACE = re.compile(r"\s+")

# Fixed values of HTML: elements without content, and whose content is not markup.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noframes template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table select body html article section div".split())

#: Elements that are never part of the main text.
BOILERPLATE = frozenset("nav header footer aside form script style noscript template button select textarea iframe svg canvas object dialog menu head title fieldset input label".split())
#: Words of class, id or role that mark boilerplate, and of these the ones that mark what readers wrote.
MARKS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted banner sidebar side menu nav navbar navigation breadcrumb breadcrumbs footer header masthead cookie cookies consent notice gdpr popup modal overlay newsletter subscribe subscription signup login comment comments disqus discussion replies reply respond share sharing social related recommended recommendations widget toolbar pagination pager search skip copyright legal complementary contentinfo".split())
COMMENTS = frozenset("comments disqus discussion replies respond".split())
#: Words that stand around marks and say nothing themselves.
NEUTRAL = frozenset("site page main global primary secondary top bottom left right inner outer box block wrap wrapper container content section area zone region list item items link links bar row col column group holder panel unit slot post posts article articles entry story news mobile desktop the js id has is to of form button buttons icon icons text title label small large fixed sticky".split())
#: Elements that can hold the main text, and those that name it.
CONTAINERS = frozenset("body article main section div td blockquote center".split())
NAMED = frozenset("article main".split())
WORDS = re.compile(r"[a-z]+")


class Element:
    __slots__ = ("tag", "path", "skip", "mark", "start", "end", "depth")

    def __init__(self, tag: str, path: str, skip: bool, mark: int, depth: int) -> None:
        # skip: boilerplate by its tag or within such; mark: the number of the outermost marked element it is in, 0 if none
        self.tag, self.path, self.skip, self.mark, self.depth = tag, path, skip, mark, depth
        self.start = self.end = 0


def marked(names: str) -> str:
    """What a class, id or role says of an element: 'comments', 'boilerplate' or ''."""
    for name in names.split():
        words = WORDS.findall(name)
        if not COMMENTS.isdisjoint(words) and COMMENTS.union(MARKS, NEUTRAL).issuperset(words):
            return "comments"
        if not MARKS.isdisjoint(words) and MARKS.union(NEUTRAL).issuperset(words):
            return "boilerplate"
    return ""


def _ending(page: str, tag: str, at: int) -> int:
    """The place after the end tag of an element whose content is no markup."""
    found = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
    end = page.find(">", found.end()) if found else -1
    return end + 1 if end >= 0 else len(page)


def parse(page: str) -> tuple[list[Element], list[str], list[bool]]:
    """Containers in page order; text segments, each within one block; whether a segment is a link's.

    A container's text is segments[start:end]. Boilerplate gives no segments.
    """
    root = Element("", "", False, 0, 0)
    stack, containers = [root], []
    segments: list[str] = []
    linked: list[bool] = []
    owner: list[int] = []  # the marked element each segment is in
    marks_of: list[str] = [""]
    pending: list[str] = []
    links = chars = 0
    # how many elements of each tag are open
    open_: dict[str, int] = {}
    tags, last = TAG, page.rfind(">")

    def flush() -> None:
        nonlocal links, chars
        if pending:
            text = SPACE.sub(" ", entities.unescape("".join(pending))).strip()
            if text:
                segments.append(text)
                linked.append(2 * links > chars)
                owner.append(stack[-1].mark)
            pending.clear()
        links = chars = 0

    def pop(to: int) -> None:
        while len(stack) > to:
            if stack[-1].tag not in INLINE:
                flush()
            open_[stack[-1].tag] -= 1
            stack.pop().end = len(segments)

    def say(text: str) -> None:
        nonlocal links, chars
        if text and not stack[-1].skip:
            pending.append(text)
            n = len(text) if not text.isspace() else 0
            chars += n
            if open_.get("a"):
                links += n

    at = 0
    while True:
        found = None
        if at <= last:
            found = tags.search(page, at)
            opened = page.find("<", at) if tags is TAG else -1
            # a tag that does not end for its quotes: from here on tags end at their next ">"
            while 0 <= opened < (found.start() if found else len(page)) and tags is TAG:
                if STARTS.match(page, opened):
                    tags = PLAIN_TAG
                    found = tags.search(page, at)
                else:
                    opened = page.find("<", opened + 1)
        say(page[at : found.start() if found else len(page)])
        if not found:
            break
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            if found[0].startswith("<![CDATA["):
                say(entities.escape(found[0][9:].removesuffix("]]>"), quote=False))
            continue
        if found[1]:
            if tag == "br":
                flush()
            for k in range(len(stack) - 1, 0, -1) if open_.get(tag) else ():
                if stack[k].tag == tag:
                    pop(k)
                    break
                if tag in INLINE and stack[k].tag not in INLINE:
                    break
            continue
        if tag in ENDS_P or tag in SAME:
            closes = SAME.get(tag, set()) | ({"p"} if tag in ENDS_P else set())
            for k in range(len(stack) - 1, 0, -1) if any(map(open_.get, closes)) else ():
                if stack[k].tag in closes:
                    pop(k)
                    break
                if stack[k].tag in SCOPE:
                    break
        if tag not in INLINE:
            flush()
        if tag in VOID:
            continue
        marks = ""
        classes = ""
        for name, *values in ATTRIBUTE.findall(found[3]):
            name = name.lower()
            if name in ("class", "id", "role"):
                value = "".join(values).lower()
                marks += " " + value
                if name == "class":
                    classes = ".".join(sorted(re.sub(r"\d+", "#", value).split()))
        parent = stack[-1]
        skip, mark = parent.skip or tag in BOILERPLATE, parent.mark
        if not mark and marks and tag not in ("html", "body") and (kind := marked(marks)):
            mark = len(marks_of)
            marks_of.append(kind)
        if tag in RAW:
            at = _ending(page, tag, at)
            continue
        if found[3].rstrip().endswith("/") and tag not in INLINE and tag not in CONTAINERS:
            continue
        path = parent.path
        if tag not in INLINE:
            if len(path) > 512:
                path = hashlib.sha256(path.encode("utf-8", "surrogatepass")).hexdigest()
            path += f">{tag}{'.' + classes if classes else ''}"
        if tag in INLINE and mark != parent.mark:
            flush()
        element = Element(tag, path, skip, mark, parent.depth + 1)
        element.start = len(segments)
        stack.append(element)
        open_[tag] = open_.get(tag, 0) + 1
        if tag in CONTAINERS and not skip:
            containers.append(element)
    pop(1)
    flush()
    root.end = len(segments)
    return _unmarked(containers, segments, linked, owner, marks_of)


def _unmarked(containers: list[Element], segments: list[str], linked: list[bool], owner: list[int], marks_of: list[str]) -> tuple[list[Element], list[str], list[bool]]:
    """What is left without marked elements; a mark does not count if less than an eighth of the text would remain without
    its element, unless it names comments."""
    own = [0] * len(marks_of)
    for text, link, mark in zip(segments, linked, owner, strict=True):
        own[mark] += 0 if link else len(text)
    rest = sum(n for n, kind in zip(own, marks_of, strict=True) if kind != "comments")
    gone = {k for k, kind in enumerate(marks_of) if kind == "comments" or (kind and 8 * (rest - own[k]) >= rest)}
    if not any(m in gone for m in owner):
        return [e for e in containers if e.mark not in gone], segments, linked
    keep = [m not in gone for m in owner]
    before = [0]
    for k in keep:
        before.append(before[-1] + k)
    left = [e for e in containers if e.mark not in gone]
    for e in left:
        e.start, e.end = before[e.start], before[e.end]
    return left, [x for x, k in zip(segments, keep, strict=True) if k], [x for x, k in zip(linked, keep, strict=True) if k]


def best(containers: list[Element], segments: list[str], linked: list[bool]) -> Element | None:
    """The element that holds most of the page's own text, as deep as it goes; article and main come first."""
    weight = [0]
    for text, link in zip(segments, linked, strict=True):
        weight.append(weight[-1] + (0 if link else len(text)))
    mass = {id(e): weight[e.end] - weight[e.start] for e in containers}
    full = [e for e in containers if mass[id(e)] > 0]
    if not full:
        return None
    named = [e for e in full if e.tag in NAMED]
    if named:
        return max(named, key=lambda e: (mass[id(e)], e.tag == "article", e.depth))
    least = 0.7 * max(mass[id(e)] for e in full)
    return max((e for e in full if mass[id(e)] >= least), key=lambda e: (e.depth, mass[id(e)]))


def vote(page: str | None) -> str | None:
    """The generalised path of a page's best element."""
    if not page:
        return None
    found = best(*parse(page))
    return found.path if found else None


def extract(page: str | None, paths: list[str] | None) -> str:
    """The text under the first of the paths that the page has, else of its own best element."""
    if not page:
        return ""
    containers, segments, linked = parse(page)
    for path in paths or []:
        out, upto = [], 0
        for e in containers:
            if e.path == path and e.start >= upto:  # not inside one that is taken
                out += segments[e.start : e.end]
                upto = max(upto, e.end)
        if out:
            return " ".join(out)
    found = best(containers, segments, linked)
    return " ".join(segments[found.start : found.end]) if found else ""


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths = [vote(x) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.string())], names=["host", "path"])


def _texts(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(x, p) for x, p in zip(batch.column(at).to_pylist(), batch.column(at + 1).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(texts, pa.string())], names=[*batch.schema.names[:at], "text"])


def host(url):
    """Host of a url in lower case; '' if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def winning_paths(pages: DataFrame, share: float = 0.05) -> DataFrame:
    """(host, votes, paths): of each host its number of votes, and the paths with that share of them, most first; equal votes: the longer path."""
    votes = pages.select(host(F.col("url")).alias("host"), F.col("html").cast("string")).mapInArrow(_votes, "host string, path string").where("path is not null").groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"))
    votes = save(votes, "votes")
    # a host's distinct paths may be many; its winners are 1 / share at most
    hosts = votes.groupBy("host").agg(F.sum("n").alias("votes"), F.count(F.lit(1)).alias("paths"))
    won = lookup(votes, hosts, "host", "paths").where(F.col("n") >= share * F.col("votes"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), (-F.length("path")).alias("length"), "path")))
    return won.groupBy("host").agg(F.max("votes").alias("votes"), F.transform(order, lambda x: x["path"]).alias("paths"))


def main_text(pages: DataFrame, share: float = 0.05) -> DataFrame:
    """(page_id, url, text) of every row."""
    winners = save(winning_paths(pages, share), "paths")
    kind = pages.schema["page_id"].dataType.simpleString()
    named = pages.select("page_id", F.col("url").cast("string"), F.col("html").cast("string"), host(F.col("url")).alias("host"))
    joined = lookup(named, winners, "host", "votes", "left").select("page_id", "url", "html", "paths")
    return joined.mapInArrow(lambda it: _texts(it, 2), f"page_id {kind}, url string, text string")
