"""Main text of web pages by equivalence-class template deduction.

Over the pages of a host, equal ones counted once, every structural token (an element's path) and every text counts
its occurrences a page.  Tokens whose occurrence vectors over the pages are equal form an equivalence class; the
vector is known by a sum of hashes of (page, count), so that no host's pages meet in one task.  A class nests below
the class that holds the longest proper prefix of all its paths, and is valid if enough of the pages of the class
below which it nests (at the top, of the host's) support it; the valid classes are the host's template.  What stands
between template tokens are slots: slots of navigation, advertising and the like, known by their elements' names,
are left out, texts that belong to the template itself are left out, inside an article too, and the remaining slots
are the page's main text.  An ``article`` or ``main`` element is a hint: it bounds the slots unless nothing of the
page's own stands in it, or more of it stands in other slots of the template.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .url_filter import url_host

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>|[^<]+|<", re.S)
_NAME = re.compile(r"</?([a-zA-Z][\w:-]*)")
_ATTR = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[a-z]+")
# Element names of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title xmp iframe noembed noframes".split())
_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in RAW}
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
OUTSIDE = frozenset("nav header footer aside form script style noscript template head title button select option textarea input label menu dialog svg canvas iframe object audio video map noembed noframes".split())
MAIN = frozenset("article main".split())
# Words in class, id and role that name parts beside the main text.
BESIDE = frozenset("ad ads advert advertisement adverts banner banners breadcrumb breadcrumbs comment comments cookie cookies disqus footer header masthead menu menubar modal nav navbar navigation newsletter notice notices popup promo promos promotion related share sharing sidebar sidebars signup skip social sponsor sponsored subscribe tags toolbar widget widgets".split())


# Words before which a word of BESIDE names what a part has or lacks, not what it is.
HAVING = frozenset("has have with without no not is hide show".split())


def _beside(label: str) -> int:
    """2 if a whole word of a class, id or role names a part beside the main text, 1 if such a word is part of one, else 0."""
    words = label.split()
    if BESIDE.intersection(words):
        return 2
    parts = [_WORD.findall(w) for w in words]
    return int(any(p and p[0] not in HAVING and BESIDE.intersection(p) for p in parts))


class _Parser:
    """Blocks of a page: (path, text, beside, main), in page order.

    beside is 2 in a part that its element's name or a whole class word sets beside the main text, 1 in one that a part
    of a class word or a form does, which an article within undoes, else 0.
    """

    def __init__(self, page: str):
        self.blocks: list[tuple[str, str, int, bool]] = []
        self.paths: list[str] = []
        self.open: list[tuple[str, str, int, bool]] = [("", "", 0, False)]  # name, path, beside, main
        self.text: list[str] = []
        at = 0
        while at < len(page):
            t = _TOKEN.match(page, at)[0]
            at += len(t)
            if t[0] != "<" or len(t) == 1:
                self.text.append(t)
            elif n := _NAME.match(t):
                name = n[1].lower()
                if t[1] == "/":
                    self.close(name)
                elif name in RAW:
                    if not t.endswith("/>"):  # nothing in it is markup but its own end tag
                        end = _END[name].search(page, at)
                        at = end.end() if end else len(page)
                else:
                    self.start(name, t)
        self.flush()

    def flush(self):
        if self.text:
            text = _SPACE.sub(" ", entities.unescape("".join(self.text))).strip()
            self.text = []
            if text:
                _, path, beside, main = self.open[-1]
                self.blocks.append((path, text, beside, main))

    def start(self, name: str, tag: str):
        if name in VOID:
            if name in ("br", "hr"):
                if name == "hr":
                    self.flush()
                self.text.append(" ")
            return
        words, label, rank = set(), name, 0
        if "=" in tag:
            for a in _ATTR.finditer(tag):
                value = (a[2] or a[3] or a[4] or "").lower()
                words.update(_WORD.findall(value))
                rank = max(rank, _beside(value))
                if a[1].lower() in ("class", "id"):
                    label += "." + value
        if name not in INLINE:
            self.flush()
            while self.open[-1][0] == "p" or (name in ("li", "dt", "dd", "tr", "td", "th", "option") and self.open[-1][0] == name):
                self.open.pop()  # an end tag left out
        if name in MAIN or name in ("html", "body"):
            rank = 2 if rank == 2 and name == "article" and any(w.startswith("comment") for w in words) else 0
        beside = max(rank, 1 if name == "form" else 2 if name in OUTSIDE else 0)
        up = self.open[-1]
        if name in MAIN and not beside and up[2] == 1:  # what wraps an article is no part beside it
            up = (*up[:2], 0, up[3])
        main = not beside and (name in MAIN or "main" in words or "articlebody" in words)
        if name in INLINE:
            if beside and not up[2]:
                self.flush()
            self.open.append((name, up[1] if not words else f"{up[1]}/{label}", max(up[2], beside), up[3] or main))
            return
        path = f"{up[1]}/{label}"
        self.paths.append(path)
        self.open.append((name, path, max(up[2], beside), up[3] or main))

    def close(self, name: str):
        if name == "p" or name not in INLINE:
            self.flush()
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at][0] == name:
                if any(x[2] != self.open[at - 1][2] for x in self.open[at:]):
                    self.flush()
                del self.open[at:]
                return
            if name in INLINE and self.open[at][0] not in INLINE:
                return  # an end tag without a start tag in this block


def _key(path: str, text: str) -> str:
    import xxhash

    return f"{path}\n{xxhash.xxh3_128_hexdigest(text.encode('utf-8', 'surrogatepass'))}"


def tokens(page: str | None) -> list[str]:
    """Structural tokens (paths) and texts (a path, a line end and a hash) of a page; with repeats."""
    p = _Parser(page or "")
    return p.paths + [_key(path, text) for path, text, _, _ in p.blocks]


def main_text(page: str | None, template: frozenset[str] = frozenset()) -> str:
    p = _Parser(page or "")
    own = [(path, text, main) for path, text, beside, main in p.blocks if not beside and (not template or _key(path, text) not in template)]
    inside = sum(len(text) for _, text, main in own if main)
    bounded = inside > 0 and inside >= sum(len(text) for path, text, main in own if not main and path in template)
    return "\n\n".join(text for _, text, main in own if main or not bounded)


def templates(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 4, share: float = 0.5) -> DataFrame:
    """``(host, pages, classes)``: for each host with ``least`` different pages its equivalence classes of tokens.

    classes is an array of (support, tokens); ``valid`` tells which of them are the template.  Its size is bounded by
    a page's: each token occurs on ``share`` of ``share`` of the host's pages, as a class nested in another may.
    """
    src = pages.select(url_host(F.col(url_col)).alias("host"), F.xxhash64(html_col).alias("page"), F.col(html_col).alias("html")).where("host != ''")
    # equal pages weigh one together; vectors need no weight, as equal pages have equal counts
    copies = materialize(src.groupBy("host", "page").agg(F.count("*").alias("copies")).where("copies > 1"), "html-copies")
    src = src.join(copies, ["host", "page"], "left").select("host", "page", F.coalesce("copies", F.lit(1)).alias("copies"), "html")
    schema = pa.schema([("host", pa.string()), ("page", pa.int64()), ("token", pa.string()), ("n", pa.int32()), ("weight", pa.float64())])

    def count(it):
        from collections import Counter

        for b in it:
            rows = []
            for h, i, k, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows += [(h, i, t, n, 1 / k) for t, n in (Counter(tokens(x)) | {"": 1}).items()]
                if len(rows) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    seen = src.mapInArrow(count, "host string, page long, token string, n int, weight double")
    vectors = seen.groupBy("host", "token").agg(F.round(F.sum("weight")).cast("long").alias("support"), F.sum(F.xxhash64("page", "n").cast("decimal(20,0)")).alias("vector"))
    vectors = materialize(vectors.where(F.col("support") >= least), "html-vectors")
    size = vectors.where("token = ''").select("host", F.col("support").alias("pages"))
    often = vectors.where("token != ''").join(size, "host").where(F.col("support") >= F.col("pages") * share * share)
    classes = often.groupBy("host", "pages", "vector", "support").agg(F.collect_list("token").alias("tokens"))
    return materialize(classes.groupBy("host", "pages").agg(F.collect_list(F.struct("support", "tokens")).alias("classes")), "html-templates")


def _common(tokens: list[str]) -> str:
    """The longest path that all tokens extend or are."""
    paths = [t.split("\n")[0].split("/") for t in tokens]
    low, high = min(paths), max(paths)
    n = next((i for i, (a, b) in enumerate(zip(low, high, strict=False)) if a != b), min(len(low), len(high)))
    return "/".join(low[:n])


def valid(classes: list[dict], pages: int, share: float = 0.5) -> list[tuple[int, int | None, list[str]]]:
    """(support, index of the class below which it nests or None, tokens) of the valid classes, most supported first.

    A class is valid if ``share`` of the pages of the valid class below which it nests support it, or of all pages at the top.
    """
    home, out = {}, []
    for c in sorted(classes, key=lambda c: (-c["support"], min(map(len, c["tokens"])), sorted(c["tokens"]))):
        top = _common(c["tokens"])
        while top and top not in home:
            top = top.rpartition("/")[0]
        below = home[top] if top else None
        if c["support"] >= share * (pages if below is None else out[below][0]):
            for t in c["tokens"]:
                if "\n" not in t:
                    home[t] = len(out)
            out.append((c["support"], below, c["tokens"]))
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id_col, url_col, text)`` for every row; an empty text for null or empty html or if nothing is left.

    Pages without a host, or of hosts with few pages, have no template: element names alone decide there.
    Repeated rows and null ids get the texts of their pages; html of any length is read whole; an empty table gives
    no row; other columns play no part.
    """
    found = templates(pages, id_col, url_col, html_col)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), url_host(F.col(url_col)).alias("host"))
    rows = rows.join(found.select("host", F.to_json(F.struct("pages", "classes")).alias("classes")), "host", "left").select("id", "url", "html", "classes")
    kind = pages.schema[id_col].dataType.simpleString()

    def batches(it):
        import json

        known: dict[str | None, frozenset[str]] = {None: frozenset()}
        for b in it:
            text = []
            for x, c in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if c not in known:
                    if len(known) > 200:
                        known = {None: frozenset()}
                    known[c] = frozenset(t for _, _, ts in valid(**json.loads(c)) for t in ts)
                text.append(main_text(x, known[c]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string())], [id_col, url_col, "text"])

    return rows.mapInArrow(batches, f"`{id_col}` {kind}, `{url_col}` string, text string")


def op8_html_text(spark, sf_dir):
    out = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
