"""Main text of web pages by equivalence classes of template tokens.

A page is a sequence of tokens: tags with the path of elements around them (with
class, id and role), and text nodes with their path. Over the pages of a host,
tokens that occur equally often on every page have the same occurrence vector and
form an equivalence class. Vectors are compared by sums over pages of the number
of occurrences times random numbers of the page: these add up in map tasks and in
a groupBy, so a host of any size is never gathered in one task.

Pages of a host whose article (without one: whose text) is the same count as one
page, so copies of an article are no template.

A class is valid if it is large and frequent: on at least ``support`` of the host's
pages, with the same count on each of them. Valid classes nest: the element of the
nearest valid tag around a token that is not of its own class says in which class it
stands; equal vectors below different elements are different classes. The class of
tokens that every page has once is the root. The elements of valid classes are the
slots. A slot is dropped if it is a menu, header, footer, sidebar, notice, advert,
form, comment, script or style or lies in one, and the article's if it is an article
or main element of the root class or lies in one; if a template has such, all else is
outside. Texts of valid classes are the template's own and go. Inside the article only
those of classes that hold tags, as the root does, are: texts alone that some pages
share are a passage. If over half of a page's article were the template's, the host's
articles are versions of one, and the article stays. What remains is the text, block
by block.

A host with few pages, a page without url, or one that was cut off has no usable
template and keeps to the roles of its own elements. So do elements inside a slot that
the template does not know. A null html gives an empty text. Rows that repeat stay;
columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import written

# Elements of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "template", "noscript", "svg", "iframe", "object", "textarea", "title")
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
DROPPED = frozenset("nav header footer aside form script style template noscript head title button select svg iframe object menu dialog textarea".split())
CONTENT = frozenset(["article", "main"])
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
# Words of class, id and role that name what isn't the article.
ROLES = frozenset(
    "ad ads adv advert adverts advertisement banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs header masthead footer "
    "sidebar aside complementary contentinfo notice notices cookie cookies consent gdpr popup modal newsletter subscribe signup share sharing social "
    "related recommended comment comments disqus reply replies search form login widget pagination pager toolbar alert".split()
)
# Words after a role that only say what shape it has (ad-slot, comment-list).
SHAPES = frozenset(
    "area articles bar block body bottom box button buttons col column container content count group inner item items left link links list menu notice "
    "outer panel popup posts right row section slot stories text title top unit wrap wrapper".split()
)
# Marks of tokens: a tag; the opening tag of an element; of an article; in a dropped element; a text in the article.
TAG, ELEMENT, ARTICLE, AWAY, INSIDE = 1, 2, 4, 8, 16
SPACES = " \t\n\r\f\v"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW) + r")\b(?P<rest>[^>]*)>.*?(?:</(?P=raw)\s*>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/)?(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*|[^>]*)(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", re.I)


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def _is_role(mark: str) -> bool:
    """Whether one class, id or role as a whole names a role: ``ad``, ``user-comments`` and
    ``ad-slot`` do, ``ad-hoc`` does not. What counts is the last word but for shapes."""
    words = [x for x in re.split(r"[^a-z]+", mark.lower()) if x]
    while len(words) > 1 and words[-1] in SHAPES and words[-1] not in ROLES:
        words.pop()
    return bool(words) and words[-1] in ROLES


def _label(name: str, attrs: str) -> tuple[str, bool]:
    """Name of an element with class, id and role; whether it is no part of the article."""
    if not attrs or "=" not in attrs:
        return name, name in DROPPED
    marks = [a or b or c for _, a, b, c in _ATTR.findall(attrs)]
    role = name not in ("html", "body", *CONTENT) and any(_is_role(x) for m in marks for x in m.split())
    return " ".join([name, *marks]), name in DROPPED or role


def nodes(page: str) -> Iterator[tuple[str, str, str | None, bool, bool, bool, str]]:
    """Tags and texts in order: kind (open, close, text), path, text, whether it
    stands in a dropped element, in a content element (tags: opens or is in one), ends a
    block, and the path of the element around it."""
    stack: list[tuple[str, str, bool, bool]] = []  # name, path, dropped, content
    at = 0

    def top():
        return stack[-1] if stack else ("", "", False, False)

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            _, path, dropped, content = top()
            yield "text", path, page[at : m.start()], dropped, content, False, path
        at = m.end()
        if m["raw"] or not m["name"]:
            continue  # comments, declarations, scripts and the like have no text
        name = m["name"].lower()
        block = name not in INLINE
        if m["close"]:
            if any(x[0] == name for x in stack):
                while stack.pop()[0] != name:
                    pass
            yield "close", top()[1] + "/" + name, None, False, False, block, top()[1]
            continue
        for other in ("p",) if name in CLOSES_P else SIBLINGS.get(name, ()):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == other:
                    del stack[i:]
                    break
                if stack[i][0] not in INLINE:
                    break
        label, drop = _label(name, m["attrs"])
        _, above, dropped, content = top()
        path = f"{above}/{label}"
        yield "open", path, None, dropped or drop, content or name in CONTENT, block, above
        if name not in VOID and not m["attrs"].rstrip().endswith("/"):
            stack.append((name, path, dropped or drop, content or name in CONTENT or " main" in label.lower()))
    if at < len(page):
        _, path, dropped, content = top()
        yield "text", path, page[at:], dropped, content, False, path


def clean(text: str) -> str:
    return " ".join(entities.unescape(text).split())


def _hash(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _counted(batches: Iterator[pa.RecordBatch]):
    """Tokens of pages: counts, marks and the place of the element around each in the
    page's list. Of pages of a batch with one article, that with the least key stays."""
    for batch in batches:
        kept: dict[tuple[str, int], tuple] = {}
        for url, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()):
            page = page or ""
            key = _hash(page)
            places: dict[int, int] = {0: 0}
            counts, marks, above = [1], [ELEMENT], [0]
            paths: dict[str, int] = {"": 0}
            texts: list[str] = []
            inner: list[str] = []
            for kind, path, text, dropped, content, _, around in nodes(page):
                if kind == "text":
                    if not (text := clean(text)):
                        continue
                    token, mark = _hash(kind, path, text), AWAY if dropped else INSIDE if content else 0
                    if not dropped:
                        (inner if content else texts).append(text)
                else:
                    token, mark = _hash(kind, path), TAG
                    if kind == "open":
                        mark |= ELEMENT | (AWAY if dropped else ARTICLE if content else 0)
                if (at := places.setdefault(token, len(counts))) == len(counts):
                    counts.append(0)
                    marks.append(mark)
                    above.append(paths.get(around, 0))
                    if kind == "open":
                        paths[path] = at
                counts[at] += 1
            article = (host_of(url), _hash(*(inner or texts)))
            if article not in kept or key < kept[article][0]:
                arrays = (np.fromiter(places, np.int64), np.array(above, np.int32), np.array(counts, np.int32), np.array(marks, np.uint8))
                kept[article] = (key, *(x.tobytes() for x in arrays))
        if kept:
            cols = [[h for h, _ in kept], [a for _, a in kept], *zip(*kept.values())]
            kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["host", "article", "key", "tokens", "above", "counts", "marks"])


def _vectors(batches: Iterator[pa.RecordBatch]):
    """Sums of the occurrence vectors of a batch by host and token."""
    for batch in batches:
        sums: dict[tuple[str, int], list] = {}
        for host, key, *packed in zip(*(c.to_pylist() for c in batch.columns)):
            tokens, above, counts, marks = (np.frombuffer(x, t) for x, t in zip(packed, (np.int64, np.int32, np.int32, np.uint8)))
            r1, r2 = key & 0x7FFFFFFF, key >> 33 & 0x7FFFFFFF
            for token, around, n, mark in zip(tokens.tolist(), tokens[above].tolist(), counts.tolist(), marks.tolist()):
                s = sums.setdefault((host, token), [0, 0, 0, n, n, around, mark])
                s[0] += 1
                s[1] += n * r1
                s[2] += n * r2
                s[3], s[4] = min(s[3], n), max(s[4], n)
        if sums:
            keys = list(sums)
            cols = [[k[0] for k in keys], [k[1] for k in keys], *zip(*(sums[k] for k in keys))]
            names = ["host", "token", "pages", "s1", "s2", "low", "high", "around", "mark"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i else pa.string()) for i, c in enumerate(cols)], names)


def nested(tokens: list[dict]) -> dict:
    """Classes, their nesting and slots of a host from its frequent tokens (token, around,
    pages, s1, s2, low, high, mark; token 0 is the page itself).

    ``classes``: tokens, pages, count, and the element (``slot``) of another class in which
    they stand; ``slots``: elements of valid classes, whether dropped or the article's."""
    known = {t["token"]: t for t in tokens}
    vector = {i: (t["pages"], t["s1"], t["s2"], t["low"]) for i, t in known.items() if t["low"] == t["high"]}

    def slot_of(token: int) -> int:
        at, mine = known[token]["around"], vector[token]
        while at and vector.get(at, mine) == mine:
            at = known[at]["around"] if at in known else 0
        return at

    classes: dict[tuple, list[int]] = {}
    for i in sorted(vector):
        if i:
            classes.setdefault((vector[i], 0 if vector[i] == vector.get(0) else slot_of(i)), []).append(i)
    tags = {i for i in vector if i and known[i]["mark"] & TAG}
    own, inner = [], []
    for group in classes.values():
        with_tags = not tags.isdisjoint(group)
        for i in group:
            if not known[i]["mark"] & TAG and (with_tags or not known[i]["mark"] & INSIDE):
                (inner if known[i]["mark"] & INSIDE else own).append(i)
    slots = [{"element": i, "dropped": bool(known[i]["mark"] & AWAY), "article": bool(known[i]["mark"] & ARTICLE)} for i in sorted(tags) if known[i]["mark"] & ELEMENT]
    return {
        "has_content": any(s["article"] and known[s["element"]]["low"] == 1 for s in slots),
        "classes": [{"tokens": g, "pages": v[0], "count": v[3], "slot": at} for (v, at), g in classes.items()],
        "slots": slots, "own": own, "inner": inner,
    }


TEMPLATE = (
    "host string, n_pages long, has_content boolean, classes array<struct<tokens:array<long>,pages:long,count:long,slot:long>>, "
    "slots array<struct<element:long,dropped:boolean,article:boolean>>, own array<long>, inner array<long>"
)


def _templates(batches: Iterator[pa.RecordBatch]):
    long, flag = pa.int64(), pa.bool_()
    kinds = {
        "host": pa.string(), "n_pages": long, "has_content": flag,
        "classes": pa.list_(pa.struct([("tokens", pa.list_(long)), ("pages", long), ("count", long), ("slot", long)])),
        "slots": pa.list_(pa.struct([("element", long), ("dropped", flag), ("article", flag)])), "own": pa.list_(long), "inner": pa.list_(long),
    }
    for batch in batches:
        rows = [{"host": r["host"], "n_pages": r["n_pages"], **nested(r["tokens"])} for r in batch.to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in kinds.items()], list(kinds))


def templates(pages: DataFrame, support: float = 0.5, min_pages: int = 3) -> DataFrame:
    """host, n_pages (with different articles), has_content, ``classes``, ``slots``, and the
    template's texts outside (``own``) and inside the article (``inner``), for each host of
    at least ``min_pages`` pages."""
    packed = "tokens binary, above binary, counts binary, marks binary"
    found = pages.select("url", "html").mapInArrow(_counted, f"host string, article long, key long, {packed}")
    found = found.groupBy("host", "article").agg(F.min(F.struct("key", "tokens", "above", "counts", "marks")).alias("page")).select("host", "page.*")
    schema = "host string, token long, pages long, s1 long, s2 long, low long, high long, around long, mark long"
    whole = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    tokens = found.mapInArrow(_vectors, schema).groupBy("host", "token").agg(
        F.sum("pages").alias("pages"), whole("s1"), whole("s2"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.min("around").alias("around"), F.max("mark").alias("mark"),
    )
    tokens = written(tokens.where("pages > 1"), "tokens")
    hosts = tokens.where("token = 0").select("host", F.col("pages").alias("n_pages")).where(F.col("n_pages") >= min_pages)
    # A host's frequent tokens number at most 1 / support times the tokens of a page.
    frequent = tokens.join(hosts, "host").where(F.col("pages") >= support * F.col("n_pages"))
    columns = F.struct("token", "pages", F.col("s1").cast("string").alias("s1"), F.col("s2").cast("string").alias("s2"), "low", "high", "around", "mark")
    return frequent.groupBy("host", "n_pages").agg(F.collect_list(columns).alias("tokens")).mapInArrow(_templates, TEMPLATE)


@dataclass(frozen=True)
class Template:
    """Of a host: its texts outside and inside the article; its slots by element, each
    dropped, the article's, or neither; whether there is an article."""

    own: frozenset = frozenset()
    inner: frozenset = frozenset()
    slots: dict = field(default_factory=dict)
    has_content: bool = False


def _judged(page: str, slots: dict) -> list[tuple]:
    """The page's nodes; an element that is a slot of the template is judged by it, an
    element that the template does not know by its own roles."""
    found, verdicts = [], {}
    for kind, path, text, dropped, content, block, around in nodes(page):
        if kind == "open" and slots:
            verdicts[path] = slots.get(_hash(kind, path))
        elif kind == "text" and (verdict := verdicts.get(path)) is not None:
            dropped, content = verdict == "dropped", verdict == "article" or content
        found.append((kind, path, text, dropped, content, block))
    return found


def main_text(page: str, constants: set[int], has_content: bool, boilerplate: frozenset = frozenset(), slots: dict | None = None) -> str:
    """Text of the remaining slots, one block a line. ``constants``, ``boilerplate``: texts
    of the template outside and inside the article; ``slots``: verdicts by element."""
    blocks, open_ = [], []
    found = _judged(page, slots or {})
    inner = has_content or any(content and not dropped for kind, _, _, dropped, content, _ in found if kind == "text")
    inner = inner and any(content for kind, _, text, _, content, _ in found if kind == "text")
    if boilerplate:
        article = [_hash(kind, path, t) in boilerplate for kind, path, text, dropped, content, _ in found if kind == "text" and content and not dropped and (t := clean(text))]
        if 2 * sum(article) > len(article):
            boilerplate = frozenset()  # versions of one article

    def end():
        if text := clean("".join(open_)):
            blocks.append(text)
        open_.clear()

    for kind, path, text, dropped, content, block in found:
        if kind != "text":
            if block:
                end()
            elif path.endswith("/br"):
                open_.append(" ")
            continue
        if dropped or (inner and not content):
            continue
        own = boilerplate if content else constants
        if own and _hash(kind, path, clean(text)) in own:
            continue
        open_.append(text)
    end()
    return "\n".join(blocks)


def _extracted(batches: Iterator[pa.RecordBatch]):
    known: dict[str, Template] = {}
    for batch in batches:
        ids, urls, pages, found = batch.columns
        out = []
        for url, page, t in zip(urls.to_pylist(), pages.to_pylist(), found):
            host = host_of(url)
            if host not in known:
                if len(known) > 1000:
                    known.clear()
                t = t.as_py()
                known[host] = Template() if t is None else Template(
                    frozenset(t["own"]), frozenset(t["inner"]),
                    {s["element"]: "dropped" if s["dropped"] else "article" if s["article"] else "other" for s in t["slots"]}, t["has_content"],
                )
            t = known[host]
            out.append(main_text(page or "", t.own, t.has_content, t.inner, t.slots))
        yield pa.RecordBatch.from_arrays([ids, urls, pa.array(out, pa.string()), pa.array(np.array([len(x) for x in out], np.int64))], ["page_id", "url", "text", "n_chars"])


#: Templates are broadcast up to this many hosts (a few kB each), and shuffled beyond.
BROADCAST_HOSTS = 20_000


def extract(pages: DataFrame, support: float = 0.5, min_pages: int = 3) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every page."""
    kind = pages.schema["page_id"].dataType.simpleString()
    found = written(templates(pages, support, min_pages), "templates").select("host", F.struct("has_content", "own", "inner", "slots").alias("template"))
    side = F.broadcast(found) if found.count() <= BROADCAST_HOSTS else found
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?i)[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    rows = pages.select("page_id", "url", "html").withColumn("host", host).join(side, "host", "left")
    return rows.select("page_id", "url", "html", "template").mapInArrow(_extracted, f"page_id {kind}, url string, text string, n_chars long")
