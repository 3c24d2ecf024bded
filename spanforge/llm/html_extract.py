"""Main text of web pages by equivalence-class template deduction.

Tokens of a page are its tags, each with its path, and its blocks of text, each with the path that holds it.  The
occurrence vector of a token over the pages of a host is held as a linear sketch, the sum over pages of
count * random(page) modulo 2**64, so vectors are aggregated without being built, and tokens with equal sums are one
class.  Pages of equal html on a host are one page here, however often it repeats.  A class is valid if half of the
host's pages that have any token hold it; the tags of valid classes are the
template, nested by their paths, and so is a block of text that is in a class with template tags, once on each page
that has them.  All other text lies in the slots between template tokens.  Inside the content root a block is template
only if it is in the root's own class, so it stands on every page that has the root: a story that some pages share is
their text.

The content root is the template's ``article`` or ``main`` (all of them that nest in no other), else the deepest
template element reached by going down as long as one child holds ``DOMINANT`` of the slots' text; its slots are the article.  A page's text is
what lies in these slots (the whole of them, where all is template text), without boilerplate elements (menus, headers and footers of the page, sidebars, notices,
adverts, forms, scripts, styles, reader comments) and without template text, inside the root as well as outside.

An element is boilerplate by its tag or role, or by a class or id whose words name it as such (``site-footer``,
``ad``, ``comment-list``), not by one that names a state or a lack (``menu-open``, ``no-sidebar``).  ``html``, ``body``,
``main`` and an ``article`` outside any other are never boilerplate by a class of several words, the first three by none.

Rows before a host's template is put together are filtered by the number of its pages, so that a task sees no more
than the tokens that half of a host's pages have.  Templates are broadcast if they are ``BROADCAST_BYTES`` at most,
else pages are joined with their host's template over salts.

Defined results: null or empty html gives the empty text; pages without a usable host share the host '';
pages of hosts with fewer than ``SUPPORT`` pages of different html (the method needs a support) use their own ``article`` or ``main``, else all that is no boilerplate, and so do
pages without their host's content root; a page whose whole text lies in elements that are boilerplate by class only
keeps it; unclosed and stray tags, comments and scripts are tolerated; repeated rows repeat their result; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_chunks, discard, lean, materialize, read

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg|iframe)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?][^>]*>", re.S | re.I
)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Elements that begin and end a block of text.
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3",
    "h4", "h5", "h6", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: An opening tag of the first kind ends an open element of the second.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
P_STAYS = {"a", "abbr", "b", "br", "cite", "code", "del", "em", "i", "img", "ins", "kbd", "mark", "q", "s", "small", "span", "strong", "sub", "sup", "time", "u", "var", "wbr"}
BOILERPLATE_TAGS = {"aside", "button", "dialog", "footer", "form", "head", "header", "input", "label", "menu", "nav", "option", "select"}
#: Words of class names and ids of boilerplate elements.
BOILERPLATE_WORDS = set(
    "ad ads adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer masthead menu modal nav navbar navigation "
    "newsletter notice popup promo promos promotion related share sharing sidebar skip social sponsor sponsored sponsors subscribe subscription toolbar widget widgets".split()
)
#: Words that go with them without changing what the element is.
PLAIN_WORDS = set(
    "site page main global primary secondary top bottom left right upper lower inner outer content list item items box boxes bar block wrap wrapper container area section region zone panel slot unit links buttons icons "
    "posts articles stories form field group row column col header footer head body text message policy law gdpr reader user new sticky fixed mobile desktop commentlist".split()
)
#: Elements that may hold a page's article.
CONTAINERS = {"article", "body", "center", "div", "main", "section", "td"}
BOILERPLATE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form"}
#: Pages of a host from which on it has a template.
SUPPORT = 3
DOMINANT = 0.9
BROADCAST_BYTES = 32 << 20
#: Parts of a host's rows in joins on the host.
SALTS = 64
CLEAN, NAMED, HARD = 0, 1, 2


def names_boilerplate(name: str, value: str) -> bool:
    """Whether a class attribute or id says that the element is boilerplate."""
    if name in ("html", "body", "main"):
        return False
    for token in value.split():
        words = [w for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", token).lower()) if w]
        if any(w in BOILERPLATE_WORDS for w in words) and (len(words) == 1 or name != "article" and all(w in BOILERPLATE_WORDS or w in PLAIN_WORDS for w in words)):
            return True
    return False


def nodes(page: str):
    """('open', path, chain) of each tag and ('text', text, chain) of each text node; chain: (name, path, level).

    Paths hold tags and their class tokens without digits; ids and numbered classes vary from page to page.
    """
    chain: list[tuple[str, str, int]] = []
    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            yield "text", page[at : m.start()], chain
        at = m.end()
        name = m[3].lower() if m[3] else None
        if name is None:
            continue
        if m[2]:
            if any(c[0] == name for c in chain):
                while chain.pop()[0] != name:
                    pass
                if name in BLOCKS:
                    yield "break", name, chain
            continue
        if name in BLOCKS or name not in P_STAYS:
            ends = CLOSES.get(name, set()) | ({"p"} if name in BLOCKS else set())
            for i in range(len(chain) - 1, -1, -1):
                if chain[i][0] in ends:
                    del chain[i:]
                    break
                if chain[i][0] in BLOCKS and chain[i][0] not in ends:
                    break
        if name in VOID:
            yield ("break" if name == "hr" else "space"), name, chain
            continue
        marks = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(m[4])} if m[4] else {}
        inside_article = any(c[0] in ("article", "main") for c in chain)
        level = CLEAN
        if name in BOILERPLATE_TAGS and not (name == "header" and inside_article) or marks.get("role", "").lower() in BOILERPLATE_ROLES:
            level = HARD
        elif marks and (names_boilerplate(name, marks.get("class", "")) or names_boilerplate(name, marks.get("id", ""))):
            level = NAMED
        # An article that begins inside an element left open is no part of it, unless it is a comment or advert itself.
        if name in ("article", "main") and level == CLEAN and not inside_article:
            while chain and chain[-1][0] not in ("html", "body") and chain[-1][2]:
                chain.pop()
        above = chain[-1] if chain else ("", "", CLEAN)
        label = name + "".join(f".{c}" for c in sorted(set(marks.get("class", "").split())) if not any(x.isdigit() for x in c))
        chain.append((name, f"{above[1]}>{label}", max(above[2], level)))
        yield "open", chain[-1][1], chain
        if name in BLOCKS:
            yield "break", name, chain
    if at < len(page):
        yield "text", page[at:], chain


def squeeze(text: str) -> str:
    return " ".join(entities.unescape(text).split())


def blocks(page: str, opened: list[str] | None = None):
    """(text, text with that of elements boilerplate by class, chain of the first text node) of each block; appends the paths of all tags to ``opened``."""
    parts: list[tuple[int, str]] = []
    first: tuple = ()
    for kind, value, chain in nodes(page):
        if kind == "text":
            level = chain[-1][2] if chain else CLEAN
            if level < HARD:
                if value.strip() and not any(p[0] == CLEAN and p[1].strip() for p in parts):
                    first = tuple(chain)
                parts.append((level, value))
        elif kind == "space":
            parts.append((CLEAN, " "))
        elif kind == "open":
            if opened is not None:
                opened.append(value)
        else:
            if parts:
                if any(p[1].strip() for p in parts):
                    yield squeeze("".join(t for level, t in parts if level == CLEAN)), squeeze("".join(t for _, t in parts)), first
                parts = []
    if any(p[1].strip() for p in parts):
        yield squeeze("".join(t for level, t in parts if level == CLEAN)), squeeze("".join(t for _, t in parts)), first


def text_key(path: str, text: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{path}\n{text}".encode("utf-8", "surrogatepass")) | 1


def main_text(page: str, roots: set[str], constants: set[int]) -> str:
    """Text of the slots below the roots; without a root on the page that of its own article or main, else all of the page but boilerplate."""
    opened: list[str] = []
    found = list(blocks(page, opened))
    if not any(clean for clean, _, _ in found):
        found = [(named, named, chain) for _, named, chain in found]
    kept = [(text, chain) for text, _, chain in found if text and not (constants and text_key(chain[-1][1] if chain else "", text) in constants)]
    if roots and not roots.isdisjoint(opened):
        inside = lambda chain: any(c[1] in roots for c in chain)
        slots = [text for text, chain in kept if inside(chain)] or [text for text, _, chain in found if text and inside(chain)]
        return "\n\n".join(slots)
    own = [text for text, chain in kept if any(c[0] in ("article", "main") for c in chain)]
    if own or any(re.match("(article|main)(?![a-z])", path.rsplit(">", 1)[-1]) for path in opened):
        return "\n\n".join(own)
    return "\n\n".join(text for text, _ in kept)


def _tokens(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(host, path, constant, weight, count, hits, chars) summed over the pages of a batch, a page that repeats in equal shares.

    Path '' counts the pages that have any token; ``constant``: key of a block of text, 0 for a tag; ``chars``: text
    in the block, or below the tag.
    """

    def run(batches):
        for batch in batches:
            for a, b, _, _ in batch_chunks(batch, "html"):
                out: dict[tuple[str, str, int], list] = {}
                for host, page_hash, page, copies in zip(*(batch.column(i).slice(a, b - a).to_pylist() for i in range(4))):
                    opened: list[str] = []
                    counts: dict[tuple[str, int], list[int]] = {}
                    for text, _, chain in blocks(page or "", opened):
                        if text:
                            for c in chain:
                                counts.setdefault((c[1], 0), [0, 0])[1] += len(text)
                            path = chain[-1][1] if chain else ""
                            row = counts.setdefault((path or ">", text_key(path, text)), [0, 0])
                            row[0] += 1
                            row[1] += len(text)
                    for path in opened:
                        counts.setdefault((path, 0), [0, 0])[0] += 1
                    if counts:
                        counts["", 0] = [1, 0]
                    for (path, constant), (n, chars) in counts.items():
                        row = out.setdefault((host, path, constant), [0, 0, 0, 0])
                        row[0] = row[0] + n * page_hash & (1 << 64) - 1
                        row[1] += n / copies
                        row[2] += (n > 0) / copies
                        row[3] += chars / copies
                keys, values = list(out), np.array(list(out.values()), object).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array([k[i] for k in keys], pa.string()) for i in (0, 1)),
                        *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in ([k[2] for k in keys], values[:, 0].tolist())),
                        *(pa.array(values[:, i].tolist(), pa.float64()) for i in (1, 2, 3)),
                    ],
                    ["host", "path", "constant", "weight", "count", "hits", "chars"],
                )

    hashed = pages.select("host", F.xxhash64("html").alias("content"), "html")
    # Only pages that repeat are counted out: a short row for each of their contents.
    repeated = materialize(hashed.groupBy("host", "content").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"), "repeated")
    small = (repeated.agg(F.sum(F.length("host") + 64)).first()[0] or 0) <= BROADCAST_BYTES
    taken = hashed.join(F.broadcast(repeated) if small else repeated, ["host", "content"], "left").select("host", "content", "html", F.coalesce("copies", F.lit(1)).alias("copies"))
    made = taken.mapInArrow(lean(run), "host string, path string, constant long, weight long, count double, hits double, chars double")
    return made, repeated


def deduce(n: int, tokens: list[tuple[str, int, int, int, int, int]]) -> tuple[list[str], list[int], list[str]]:
    """(content roots, keys of template texts, nested classes) of a host of n pages; tokens: (path, constant, vector, count, hits, chars)."""
    tags = sorted((t for t in tokens if not t[1]), key=lambda t: t[0])
    vectors: dict[int, list[str]] = {}
    for path, _, vector, *_ in tags:
        vectors.setdefault(vector, []).append(path)
    of = {t[0]: t[2] for t in tags}
    constants = [t for t in tokens if t[1] and t[3] == t[4] and t[2] in vectors]
    below = lambda p, tops: next((s for s in sorted(tops, key=len, reverse=True) if p == s or p.startswith(s + ">")), "")
    whole = vectors.get(max(vectors, key=lambda v: (max(t[4] for t in tags if t[2] == v), len(vectors[v])), default=0), [])
    classes = [f"{below(paths[0], [w for w in whole if w not in paths])}: {' '.join(paths)}" for paths in vectors.values()]
    label = lambda p: p.rsplit(">", 1)[-1].split(".")[0]
    bad = lambda p: any(x.split(".")[0] in BOILERPLATE_TAGS or names_boilerplate(x.split(".")[0], " ".join(x.split(".")[1:])) for x in p.split(">")[1:])
    named = [t[0] for t in tags if label(t[0]) in ("article", "main") and not bad(t[0])]
    roots = [p for p in named if not any(p.startswith(q + ">") for q in named)]
    if not roots:
        text = {t[0]: t[5] for t in tags if label(t[0]) in CONTAINERS and t[3] == t[4] and not bad(t[0])}
        for path, _, vector, _, _, chars in constants:
            for s in text:
                if vector == of[s] and (path == s or path.startswith(s + ">")):
                    text[s] -= chars
        at, left = "", max(text.values(), default=0)
        while inner := [p for p in text if p.startswith(at + ">") and text[p] >= DOMINANT * max(left, 1)]:
            at = min(inner, key=len)
            left = text[at]
        roots = [at] if at else []
    root = {t[0]: below(t[0], roots) for t in constants}
    return roots, sorted({t[1] for t in constants if not root[t[0]] or t[2] == of[root[t[0]]]}), classes


def templates(pages: DataFrame) -> DataFrame:
    """(host, roots, constants, classes) of each host with ``SUPPORT`` pages: content roots, template texts and nested classes."""
    # Sums modulo 2**64: the halves are summed apart, which cannot overflow, and put together.
    half = 0xFFFFFFFF
    tokens, repeated = _tokens(pages)
    summed = (
        tokens
        .groupBy("host", "path", "constant")
        .agg(F.sum(F.shiftrightunsigned("weight", 32)).alias("high"), F.sum(F.col("weight").bitwiseAND(half)).alias("low"), *(F.round(F.sum(c)).cast("long").alias(c) for c in ("count", "hits", "chars")))
        .withColumn("vector", F.shiftleft((F.col("high") + F.shiftright("low", 32)).bitwiseAND(half), 32).bitwiseOR(F.col("low").bitwiseAND(half)))
        .drop("high", "low")
    )
    summed = materialize(summed, "tokens")
    discard(repeated)
    totals = summed.where("path = ''").where(F.col("hits") >= SUPPORT).select("host", F.col("hits").alias("pages"))
    salted = totals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = summed.where("path != ''").withColumn("salt", F.pmod(F.xxhash64("path", "constant"), F.lit(SALTS)).cast("int"))
    kept = spread.join(salted, ["host", "salt"]).where(2 * F.col("hits") >= F.col("pages"))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        tokens = list(group[["path", "constant", "vector", "count", "hits", "chars"]].itertuples(index=False, name=None))
        roots, constants, classes = deduce(int(group.pages.iloc[0]), tokens)
        return pd.DataFrame({"host": [group.host.iloc[0]], "roots": [roots], "constants": [constants], "classes": [classes]})

    return kept.groupBy("host").applyInPandas(build, "host string, roots array<string>, constants array<long>, classes array<string>")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))
    hosted = pages.select("page_id", "url", "html", host.alias("host"))
    known = materialize(templates(hosted).select("host", "roots", "constants"), "templates")
    size = known.agg(F.sum(F.length("host") + 8 * F.size("constants") + F.aggregate("roots", F.lit(64), lambda n, p: n + F.length(p)))).first()[0]
    if (size or 0) <= BROADCAST_BYTES:
        joined = hosted.join(F.broadcast(known), "host", "left")
    else:
        # One template row for each host and salt, so the pages of a large host spread over many tasks.
        salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = hosted.withColumn("salt", F.pmod(F.xxhash64("page_id", "url", F.length("html")), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    joined = joined.select("page_id", "url", "html", "roots", "constants")

    def run(batches):
        unsigned = (1 << 64) - 1
        for batch in batches:
            for a, b, _, _ in batch_chunks(batch, "html"):
                part = batch.slice(a, b - a)
                out = [main_text(p or "", set(r or ()), {c & unsigned for c in k or ()}) for p, r, k in zip(*(part.column(i).to_pylist() for i in (2, 3, 4)))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(lean(run), "page_id long, url string, text string, n_chars long")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
