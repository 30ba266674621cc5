"""Main-text extraction by equivalence-class template deduction.

Pages of one host share a template, or a few: one for each layout. A token is an element path with class and id
names, or a text at a path; its occurrence vector says how often it occurs on each page of the host. Tokens with
equal vectors form an equivalence class, so the tokens of one layout are one. What lies between them are slots. The
slot that holds the article is found on the way down from the root, along once-per-page paths that hold most of the
text of the pages on which they occur; among nested slots an outermost path called an article is preferred, and an
article or main element whose text varies is always a slot. Texts of the same class as the slot (or an element around
it) and slots whose text never changes are template, below a named article too. Elements named as menus, notices,
adverts, forms, comments and the like are not part of an article unless they contain it.

Occurrence vectors are compared by a signature, the sum of one hash per page and count, so a host of any size is
summed up by partial aggregation; only template tokens are gathered.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sharelens.llm.common import per_batch, small
from sharelens.session import settle

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(?=/?[a-zA-Z])[^<>]*\Z", re.S
)
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = set("a abbr b bdi bdo cite code data del dfn em font i ins kbd mark q s samp small span strong sub sup time u var wbr tt big".split())
#: An opening tag of the key ends open elements of the values, up to the listed containers.
CLOSES = {t: {"p"} for t in "p div ul ol dl table section article aside nav header footer form h1 h2 h3 h4 h5 h6 pre blockquote figure main hr address fieldset details".split()}
CLOSES |= {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
HOLDS = {"ul", "ol", "dl", "table", "div", "section", "article", "aside", "nav", "header", "footer", "form", "main", "body", "blockquote", "select"}
#: Elements and names that are not part of an article, and names that are one.
NOT_ARTICLE = {"nav", "footer", "aside", "form", "menu", "dialog", "select", "button", "input", "head", "object", "audio", "video", "canvas"} | RAW
BOILERPLATE = set(
    "ad ads advert adverts advertisement advertising adbox adslot banner sponsor sponsored promo promotion promoted sidebar aside nav navbar navigation menu "
    "breadcrumb breadcrumbs footer masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup "
    "login register search searchform share sharing social related recommended recommendations trending comments comment commentlist replies disqus respond "
    "widget widgets pagination pager skip copyright complementary contentinfo".split()
)
ARTICLE = set("article main content post entry story body articlebody postbody entrycontent".split())
PAGE_HEADER = {"header", "header:banner"}
SUPPORT, LINKS, MOST = 0.3, 0.5, 0.6
#: Pages that make a template, the share of a path's pages on which the paths below it must take over, and names of discussions.
LEAST, COVER = 3, 0.9
DISCUSSION = set("comment comments commentlist replies disqus respond".split())


def tokens_of(attributes: str) -> list[str]:
    """Lower-case class, id and role names, digits masked."""
    names = []
    for _, a, b, c in ATTRIBUTE.findall(attributes):
        names += (a or b or c).lower().split()
    return sorted({re.sub(r"\d+", "0", n) for n in names})


def label_of(tag: str, attributes: str) -> str:
    names = tokens_of(attributes) if "=" in attributes else []
    return ".".join([tag, *names]).replace(">", "")


def is_boilerplate(label: str, inside_article: bool) -> bool:
    """Whether an element's tag or names exclude it from an article."""
    tag, *names = label.split(".")
    if tag in NOT_ARTICLE or (tag == "header" and not inside_article):
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    parts = {part for name in names for part in (name, *re.split(r"[-_:]+", name))}
    return bool(parts & BOILERPLATE) or ("header" in names and not inside_article)


def is_article(label: str) -> bool:
    tag, *names = label.split(".")
    if tag in ("article", "main"):
        return True
    return tag in ("div", "section", "td") and any(n.replace("-", "").replace("_", "") in ARTICLE - {"body"} for n in names)


def walk(page: str) -> Iterator[tuple[str, str, str]]:
    """Events of a page: ("open", path, label), ("text", path, text), ("close", path, "") and ("break", path, "").

    Elements that are left open end where HTML ends them; stray end tags are passed over.
    """
    stack: list[str] = []
    paths: list[str] = [""]
    at, n = 0, len(page)
    while at < n:
        token = TOKEN.search(page, at)
        end = token.start() if token else n
        if end > at:
            yield "text", paths[-1], page[at:end]
        if not token:
            return
        at = token.end()
        closing, tag = token.group(1), (token.group(2) or "").lower()
        if not tag:
            continue
        if closing:
            if tag in stack:
                while True:
                    last = stack.pop()
                    yield "close", paths.pop(), last
                    if last == tag:
                        break
            elif tag not in INLINE:
                yield "break", paths[-1], ""
            continue
        if tag == "br":
            yield "text", paths[-1], " "
            continue
        if tag in CLOSES:
            ends = CLOSES[tag]
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth] in ends:
                    while len(stack) > depth:
                        last = stack.pop()
                        yield "close", paths.pop(), last
                elif stack[depth] in HOLDS or (tag == "p" and stack[depth] == "li"):
                    break
        label = label_of(tag, token.group(3) or "")
        path = f"{paths[-1]}>{label}" if paths[-1] else label
        if tag in VOID or (token.group(3) or "").rstrip().endswith("/"):
            yield "break", paths[-1], ""
            continue
        yield "open", path, label
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = stop.end() if stop else n
            yield "close", path, tag
            continue
        stack.append(tag)
        paths.append(path)
    while stack:
        yield "close", paths.pop(), stack.pop()


def excluded(path: str, known: dict[str, bool]) -> bool:
    """Whether any element of a path excludes it; ``known`` remembers answers, and holds those of elements that are kept."""
    if path not in known:
        parent, _, label = path.rpartition(">")
        known[path] = bool(path) and (excluded(parent, known) or is_boilerplate(label, any(map(is_article, parent.split(">")))))
    return known[path]


def above(path: str) -> list[str]:
    """The path and all paths that contain it, innermost first."""
    found = []
    while path:
        found.append(path)
        path = path.rpartition(">")[0]
    return found


def mark_of(path: str, value: str) -> str:
    """A text token: where it stands and what it says, spaces apart."""
    return f"{path}\n{xxhash.xxh64_hexdigest(' '.join(value.split()).encode('utf-8', 'surrogatepass'))}"


def in_link(path: str) -> bool:
    return ">a" in path and any(p == "a" or p.startswith("a.") for p in path.split(">"))


def judged(events: list[tuple[str, str, str]]) -> dict[str, bool]:
    """Path -> excluded, for the elements whose names would exclude them although they contain the article.

    Such an element holds the page's only article or main element, or most of its text that is not links. Menus,
    asides, footers and the like are never kept, discussions not for their size.
    """
    prose: dict[str, int] = {"": 0}
    opened: dict[str, int] = {}
    for event, path, value in events:
        if event == "open":
            opened[path] = opened.get(path, 0) + 1
        elif event == "text" and (size := len("".join(value.split()))) and not in_link(path):
            prose[""] += size
            for p in above(path):
                prose[p] = prose.get(p, 0) + size
    label = lambda p: p.rpartition(">")[2].partition(".")
    barred = lambda p: any(label(q)[0] in NOT_ARTICLE - {"form"} for q in above(p))
    plain: dict[str, bool] = {}
    articles = [p for p in opened if label(p)[0] in ("article", "main") and prose.get(p) and not barred(p)]
    kept = set()
    if not any(not excluded(p, plain) for p in articles):
        kept.update(above(max((p for p in articles if opened[p] == 1), key=lambda p: (prose[p], p), default="")))
    for p, size in prose.items():
        names = set(re.split(r"[.:_-]+", label(p)[2]))
        if p and size >= MOST * prose[""] and not names & DISCUSSION and not barred(p) and excluded(p, plain):
            kept.add(p)
    known: dict[str, bool] = {}
    for p in sorted(kept, key=lambda p: p.count(">")):
        known[p] = excluded(p.rpartition(">")[0], known)
    return known


def summary(page: str) -> dict[str, list[int]]:
    """Token -> [occurrences, characters of text below, those in links, hash of the text below]. Excluded parts have none.

    Tokens are element paths and the texts at them; the empty path stands for the page.
    """
    events = list(walk(page))
    found: dict[str, list[int]] = {"": [1, 0, 0, 0]}
    known = judged(events)
    for event, path, value in events:
        if event == "open":
            if not excluded(path, known):
                found.setdefault(path, [0, 0, 0, 0])[0] += 1
        elif event == "text" and not excluded(path, known):
            size = len("".join(value.split()))
            if size:
                linked = size if in_link(path) else 0
                mark = xxhash.xxh64_intdigest(value.encode("utf-8", "surrogatepass")) >> 1
                row = found.setdefault(mark_of(path, value), [0, 0, 0, mark])
                row[0], row[1], row[2] = row[0] + 1, row[1] + size, row[2] + linked
                for p in (*above(path), ""):
                    row = found.setdefault(p, [0, 0, 0, 0])
                    row[1], row[2], row[3] = row[1] + size, row[2] + linked, (row[3] * 31 + mark) & (1 << 62) - 1
    return found


def host_of(pages: DataFrame) -> DataFrame:
    """page_id, url, host, html."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    page = F.col("html").cast("string")
    shape = F.regexp_replace(F.lower(F.regexp_extract(page, r"(?is)<body[^>]*>\s*(?:<[^>]*>\s*){0,2}", 0)), r"[0-9]+", "0")
    # pages without a host are many sites: those that begin alike share a template
    host = F.when(host == "", F.concat(F.lit("?"), F.coalesce(F.md5(shape), F.lit("")))).otherwise(host)
    return pages.select("page_id", "url", host.alias("host"), page.alias("html"))


def token_statistics(pages: DataFrame) -> DataFrame:
    """Per host and token: pages, signature of the occurrence vector, most occurrences, text, links, text of its pages, least and greatest text hash.

    Summed up per batch before the shuffle; the empty path counts the pages of the host. The signature is a sum,
    in which repeated rows do not cancel each other. Texts on fewer than LEAST pages are left out.
    """

    def work(batch: pa.RecordBatch) -> dict:
        sums: dict[tuple[str, str], list[int]] = {}
        for ident, host, page in zip(*(batch.column(c).to_pylist() for c in ("page_id", "host", "html")), strict=True):
            page = page or ""
            key = f"{ident}:{xxhash.xxh64_intdigest(page.encode('utf-8', 'surrogatepass'))}"
            tokens = summary(page)
            for path, (count, size, linked, mark) in tokens.items():
                row = sums.setdefault((host, path), [0, 0, 0, 0, 0, 0, mark, mark])
                row[0] += 1
                row[1] += xxhash.xxh64_intdigest(f"{key}:{count}") >> 20
                row[2] = max(row[2], count)
                row[3] += size
                row[4] += linked
                row[5] += tokens[""][1]
                row[6], row[7] = min(row[6], mark), max(row[7], mark)
        columns = list(zip(*sums.values(), strict=True)) if sums else [()] * 8
        named = zip(("pages", "signature", "most", "size", "linked", "around", "low", "high"), columns, strict=True)
        return {
            "host": pa.array([h for h, _ in sums], pa.string()),
            "path": pa.array([p for _, p in sums], pa.string()),
        } | {name: pa.array(values, pa.int64()) for name, values in named}

    schema = "host string, path string, pages bigint, signature bigint, most bigint, size bigint, linked bigint, around bigint, low bigint, high bigint"
    summed = per_batch(pages, schema, work).groupBy("host", "path").agg(
        F.sum("pages").alias("pages"),
        F.sum(F.col("signature").cast("decimal(38,0)")).alias("signature"),
        F.max("most").alias("most"),
        F.sum("size").alias("size"),
        F.sum("linked").alias("linked"),
        F.sum("around").alias("around"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
    )
    return summed.where(~F.col("path").contains("\n") | (F.col("pages") >= LEAST))


def deduce(rows: list[dict], pages: int) -> tuple[list[str], list[str]]:
    """Template of one host -> (paths that hold the article, paths and text tokens that never change).

    Every layout of the host has its own paths: a share of text is measured on the pages on which a path occurs.
    """
    template = {r["path"]: r for r in rows if "\n" not in r["path"]}
    usable = {p: r for p, r in template.items() if r["size"] > 0}
    total = max([r["size"] for r in usable.values()], default=0)
    around = lambda r: r.get("around", total)
    constant = lambda r: r["pages"] >= LEAST and r["low"] == r["high"] and r["size"] < LINKS * around(r)
    dense = lambda r: r["most"] == 1 and r["size"] >= MOST * around(r) and r["linked"] < LINKS * r["size"]
    kids: dict[str, list[str]] = {}
    for p in sorted(usable):
        kids.setdefault(p.rpartition(">")[0], []).append(p)
    classes: dict[tuple, list[str]] = {}
    for r in rows:
        classes.setdefault((r["pages"], r["signature"]), []).append(r["path"])
    class_of = lambda r: classes[r["pages"], r["signature"]]
    named = [p for p, r in usable.items() if is_article(p.rpartition(">")[2]) and not constant(r)]
    outer = set(named) - {p for p in named if not set(above(p)[1:]).isdisjoint(named)}
    main: set[str] = set()
    for p in outer:  # an article or main element in a named slot is the slot if all pages have it and it holds most text
        tags = [q for q in named if q.startswith(p + ">") and q.rpartition(">")[2].partition(".")[0] in ("article", "main")]
        tags = [q for q in tags if usable[q]["pages"] == usable[p]["pages"] and usable[q]["size"] >= MOST * usable[p]["size"]]
        main.add(min(tags, key=lambda q: (q.count(">"), q), default=p))
    waiting = [""]
    while waiting:  # down the dense paths; a path whose pages are not all dense further down is a slot itself
        at = waiting.pop()
        if at in outer:
            continue
        inner = [p for p in kids.get(at, []) if dense(usable[p])]
        if at and sum(usable[p]["pages"] for p in inner) < COVER * usable[at]["pages"]:
            if not any(p.startswith(at + ">") and usable[p]["pages"] == usable[at]["pages"] for p in outer):
                main.add(at)
            # an optional part is no layout; a class with tokens beside it is one
            inner = [p for p in inner if sum(not below(q, [p]) and not below(p, [q]) for q in class_of(usable[p])) >= 2]
        waiting += inner
    fixed: list[str] = []
    for slot in sorted(main) if pages >= LEAST else []:
        row = usable[slot]
        lines = {p for q in above(slot) for p in class_of(template[q]) if "\n" in p and p.startswith((slot + ">", slot + "\n"))}
        size = {r["path"]: r["size"] for r in rows}
        if row["pages"] >= LEAST and sum(size[p] for p in lines) < LINKS * row["size"]:
            fixed += lines
        fixed += [p for p, r in usable.items() if p.startswith(slot + ">") and constant(r) and r["pages"] >= SUPPORT * row["pages"]]
    return sorted(main), sorted(set(fixed))


def templates(pages: DataFrame) -> DataFrame:
    """One row per host: ``main`` paths and ``fixed`` tokens. Paths on fewer than LEAST pages are no template of a host that has more.

    Only those texts are gathered whose occurrence vector is that of an element.
    """
    tokens = settle(token_statistics(pages))
    counts = tokens.where("path = ''").select(F.col("host").alias("of"), F.col("pages").alias("total"))
    elements = tokens.where("path <> ''").where(~F.col("path").contains("\n"))
    vectors = elements.select("host", "pages", "signature").distinct()
    lines = tokens.where(F.col("path").contains("\n")).join(vectors, ["host", "pages", "signature"], "left_semi")
    frequent = elements.unionByName(lines.select(*elements.columns)).join(counts, F.col("host") == F.col("of"))
    frequent = frequent.where(F.col("pages") >= F.least(F.lit(LEAST), F.col("total")))
    fields = ("path", "pages", "signature", "most", "size", "linked", "around", "low", "high")
    per_host = frequent.groupBy("host", "total").agg(F.collect_list(F.struct(*fields)).alias("rows"))

    def work(batch: pa.RecordBatch) -> dict:
        found = [deduce(rows, total) for rows, total in zip(batch.column("rows").to_pylist(), batch.column("total").to_pylist(), strict=True)]
        text = pa.list_(pa.string())
        return {
            "of": batch.column("host"),
            "main": pa.array([m for m, _ in found], text),
            "fixed": pa.array([f for _, f in found], text),
        }

    return per_batch(per_host, "of string, main array<string>, fixed array<string>", work)


def below(path: str, roots: list[str]) -> bool:
    return any(path == r or path.startswith(r + ">") for r in roots)


def main_text(page: str, main: list[str], fixed: list[str]) -> str:
    """The article of a page: text of its slots, blocks in page order joined by one space.

    Of nested slots the innermost counts. Names exclude what is below a slot, not what contains it. A page without
    any of the host's article paths is taken on its own.
    """
    events = list(walk(page))
    opened = {path for kind, path, _ in events if kind == "open"}
    roots = [r for r in main if r in opened]
    if not roots:
        own = [dict(zip(("most", "size", "linked", "low"), row, strict=True)) | {"path": p} for p, row in summary(page).items() if p]
        whole = summary(page)[""][1]
        roots = deduce([r | {"pages": 1, "signature": r["most"], "around": whole, "high": r["low"]} for r in own], 1)[0] or [""]
    roots = [r for r in roots if not any(q.startswith(r + ">") for q in roots)]
    known = judged(events)
    known |= {p: False for r in roots for p in above(r)}
    same, lines = [f for f in fixed if "\n" not in f], {f for f in fixed if "\n" in f}
    blocks: list[list[str]] = [[]]
    for kind, path, value in events:
        if kind == "text":
            if ("" in roots or below(path, roots)) and not excluded(path, known) and not (same and below(path, same)):
                if not lines or mark_of(path, value) not in lines:
                    blocks[-1].append(html.unescape(value))
        elif kind == "break" or (value if kind == "close" else value.partition(".")[0]) not in INLINE:
            if blocks[-1]:
                blocks.append([])
    texts = (" ".join("".join(b).split()) for b in blocks)
    return " ".join(t for t in texts if t)


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points).

    Null and empty html give an empty text. A null or unreadable url belongs to the host without a name.
    A host with one page has a template of its own. Repeated rows give equal texts. An empty table
    gives an empty result. Other columns are ignored.
    """
    hosted = host_of(pages)
    # templates hold a few paths each; counted, they are broadcast and the pages of a hot host stay where they are
    known = small(settle(templates(hosted)), 20_000)
    asked = hosted.join(known, F.col("host") == F.col("of"), "left").select("page_id", "url", "html", "main", "fixed")

    def work(batch: pa.RecordBatch) -> dict:
        rows = zip(*(batch.column(c).to_pylist() for c in ("html", "main", "fixed")), strict=True)
        texts = [main_text(page or "", main or [], fixed or []) for page, main, fixed in rows]
        return {
            "page_id": batch.column("page_id"),
            "url": batch.column("url"),
            "text": pa.array(texts, pa.string()),
            "n_chars": pa.array([len(t) for t in texts], pa.int64()),
        }

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return per_batch(asked, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint", work)
