"""Main text of web pages, by removal of what a site repeats.

Every block element of a page is hashed with all it holds. Spark counts for each host and hash on how many
different pages it occurs; subtrees found on many pages of a host are its template and are deleted.
Pages are different when their longest paragraphs differ, so copies of one article count once and
do not turn the article into a template. What occurs once per page but says by its markup
that it is no article (navigation, forms, comments, ...) goes as well.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from brightshelf import session
from brightshelf.llm.frames import BLOCK_BYTES
from brightshelf.session import materialise

# A subtree is a template from so many different pages of its host on: a number, and a share of the host's.
LEAST_PAGES, PAGE_SHARE = 5, 0.01
# Paragraphs and the like, and whatever stands in the article, also need this larger share.
PROSE_SHARE = 0.2
SALTS = 32

# Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav ol optgroup option p pre section select summary table tbody td "
    "template tfoot th thead title tr ul".split()
)
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt blockquote pre td th figcaption caption".split())
CLOSES_P = BLOCK - frozenset("body br button caption head html legend option optgroup tbody td tfoot th thead title tr".split())
# A start tag ends an open element of these kinds, up to the nearest of the last group.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"tbody", "thead", "caption"}, {"table"}),
    "body": ({"head"}, set()),
}
FENCE = frozenset("table td th caption button template".split())  # an open p outside of these stays open

# Never article text.
NO_TEXT = frozenset("head title script style noscript template iframe svg math canvas object select button datalist option textarea".split())
ASIDE = frozenset("nav aside footer form dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup "
    "modal overlay newsletter subscribe subscription signup login sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer comment comments "
    "reply replies respond disqus share sharing social related recommended recommendations widget widgets toolbar pagination pager copyright".split()
)
HEADER = frozenset("header masthead banner".split())
ARTICLE_WORDS = frozenset("article content entry post story main body text page wrapper".split())

_TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/><]*)((?:[^>\"'<]++|\"[^\"<]*\"|'[^'<]*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/><]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role|itemprop|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?![^\s/>])", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}


class Tree:
    """A page: its elements before their children, and its pieces of text in order.

    Unclosed and stray tags are borne with: a start tag ends what cannot hold it, an end tag ends
    everything inside its element or, without one, nothing. An unfinished tag at the end is no text.
    """

    def __init__(self, html: str):
        self.tags, self.parents, self.words, self.roles, self.classes = ["html"], [-1], [frozenset()], [""], [""]
        self.pieces: list[tuple[int, str | None]] = []  # (element, text), None where a block begins or ends
        self.open = [0]
        at, n = 0, len(html)
        while at < n:
            m = _TAG.search(html, at)
            if m is None:
                self._text(html[at:])
                break
            if m.start() > at:
                self._text(html[at : m.start()])
            at = m.end()
            close, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if name is None:
                continue
            name = name.lower()
            if close:
                self._end(name)
            elif m[2] is None and not m[0].endswith(">"):
                break
            else:
                self._start(name, attributes)
                if name in RAW:
                    end = _RAW_END[name].search(html, at)
                    at = end.start() if end else n

    def _text(self, text: str) -> None:
        self.pieces.append((self.open[-1], references.unescape(text)))

    def _edge(self) -> None:
        self.pieces.append((self.open[-1], None))

    def _pop(self, depth: int) -> None:
        del self.open[depth:]

    def _start(self, name: str, attributes: str) -> None:
        tags = self.tags
        if name in CLOSES_P:
            for depth in range(len(self.open) - 1, 0, -1):
                tag = tags[self.open[depth]]
                if tag == "p":
                    self._pop(depth)
                    break
                if tag in BLOCK:
                    break
        if name in ENDS:
            ended, fence = ENDS[name]
            for depth in range(len(self.open) - 1, 0, -1):
                tag = tags[self.open[depth]]
                if tag in fence:
                    break
                if tag in ended:
                    self._pop(depth)
                    if tag not in ("td", "th") or name != "tr":
                        break
        if name in BLOCK:
            self._edge()
        if name in VOID:
            return
        words, role, classes = frozenset(), "", ""
        if attributes and "=" in attributes or " hidden" in attributes:
            found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
            classes = found.get("class", "")
            words = frozenset(w.lower() for w in _WORD.findall(f"{classes} {found.get('id', '')}"))
            role = "hidden" if "hidden" in found else "main" if found.get("itemprop") == "articleBody" else found.get("role", "").lower()
        self.tags.append(name)
        self.parents.append(self.open[-1])
        self.words.append(words)
        self.roles.append(role)
        self.classes.append(" ".join(sorted(classes.split())))
        self.open.append(len(tags) - 1)

    def _end(self, name: str) -> None:
        for depth in range(len(self.open) - 1, 0, -1):
            tag = self.tags[self.open[depth]]
            if tag == name:
                if name in BLOCK:
                    self._edge()
                self._pop(depth)
                if name in BLOCK:
                    self._edge()
                return
            if (name not in BLOCK and tag in BLOCK) or (tag in FENCE and name not in FENCE and name not in ("tr", "tbody", "thead", "tfoot", "form", "body", "html")):
                return

    def marked(self) -> tuple[list[bool], list[bool]]:
        """Per element: whether its markup (or that of one around it) rules it out; whether it is in an article.

        Elements around an article are not ruled out by what they are called.
        """
        n = len(self.tags)
        comment = {"comment", "comments", "reply", "replies", "respond"}
        bad, article, around = [False] * n, [False] * n, [False] * n
        for i in range(n):
            up = self.parents[i]
            outside = up >= 0 and bad[up]
            tag, words = self.tags[i], self.words[i]
            bad[i] = outside or tag in NO_TEXT or tag in ("nav", "aside", "footer") or bool(words & comment)
            if (tag in ("article", "main") or self.roles[i] == "main") and not bad[i]:
                article[i] = True
                while up >= 0 and not around[up]:
                    around[up] = True
                    up = self.parents[up]
        out, inside = [False] * n, [False] * n
        for i in range(n):
            up = self.parents[i]
            if up >= 0:
                inside[i] = inside[up]
            inside[i] |= article[i]
            if up >= 0 and out[up] or bad[i]:
                out[i] = True
                continue
            tag, words, role = self.tags[i], self.words[i], self.roles[i]
            if tag in ("html", "body", "article", "main") or around[i] or article[i]:
                continue
            head = (tag == "header" or bool(words & HEADER)) and not inside[i] and not words & ARTICLE_WORDS
            out[i] = tag in ASIDE or role in ROLES or role == "hidden" or bool(words & WORDS) or head
        return out, inside

    def digests(self) -> list[int]:
        """64-bit hash of every element's subtree: its tag and classes, texts and children in order; 0 without text."""
        parts: list[list[bytes]] = [[] for _ in self.tags]
        own: list[list[tuple[int, bytes]]] = [[] for _ in self.tags]
        for k, (node, text) in enumerate(self.pieces):
            text = " ".join(text.split()) if text else ""
            if text:
                own[node].append((k, text.encode("utf-8", "surrogatepass")))
        first = [len(self.pieces)] * len(self.tags)
        out = [0] * len(self.tags)
        for i in range(len(self.tags) - 1, -1, -1):
            if not own[i]:
                continue
            own[i].sort()
            first[i] = own[i][0][0]
            parts[i] = [self.tags[i].encode(), self.classes[i].encode("utf-8", "surrogatepass"), *[t for _, t in own[i]]]
            out[i] = xxhash.xxh3_64_intdigest(b"\0".join(parts[i])) or 1
            if self.parents[i] >= 0:
                own[self.parents[i]].append((first[i], out[i].to_bytes(8, "little")))
        return out

    def text(self, out: list[bool], wanted: list[bool] | None) -> str:
        """Blocks of elements that are not out (and are wanted), joined by one blank."""
        blocks, now = [], []
        for node, text in self.pieces:
            if text is None:
                if now:
                    blocks.append("".join(now))
                    now = []
            elif not out[node] and (wanted is None or wanted[node]):
                now.append(text)
        blocks.append("".join(now))
        return " ".join(w for b in blocks for w in b.split())


def _inherited(tree: Tree, out: list[bool]) -> None:
    for i, up in enumerate(tree.parents):
        if up >= 0 and out[up]:
            out[i] = True


def _menus(tree: Tree, out: list[bool]) -> None:
    """Rule out elements of three links or more whose text stands mostly in links."""
    n = len(tree.tags)
    size, linked, links = [0] * n, [0] * n, [0] * n
    in_link = [False] * n
    for i in range(n):
        in_link[i] = tree.tags[i] == "a" or (tree.parents[i] >= 0 and in_link[tree.parents[i]])
        links[i] = int(tree.tags[i] == "a")
    for node, text in tree.pieces:
        if text and not out[node]:
            length = len("".join(text.split()))
            size[node] += length
            linked[node] += length if in_link[node] else 0
    for i in range(n - 1, 0, -1):
        up = tree.parents[i]
        size[up], linked[up], links[up] = size[up] + size[i], linked[up] + linked[i], links[up] + links[i]
        if tree.tags[i] in ("ul", "ol", "div", "table", "section", "p") and links[i] >= 3 and 10 * linked[i] >= 8 * size[i]:
            out[i] = True
    _inherited(tree, out)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def subtrees(html: str) -> tuple[int, list[int], list[bool]]:
    """Hash of a page's longest paragraph (of its longest block, without any); hashes of its block
    elements, each once, and which of them need the larger share.
    """
    tree = Tree(html)
    _, inside = tree.marked()
    hidden = [t in NO_TEXT for t in tree.tags]
    _inherited(tree, hidden)
    prose = [t in PROSE for t in tree.tags]
    for i, up in enumerate(tree.parents):
        prose[i] |= up >= 0 and prose[up] and tree.tags[i] not in BLOCK
    longest, now, paragraph = (False, 0, ""), [], False
    for node, text in [*tree.pieces, (0, None)]:
        if text is None:
            block = " ".join("".join(now).split())
            longest = max(longest, (paragraph and block != "", len(block), block))
            now, paragraph = [], False
        elif not hidden[node]:
            now.append(text)
            paragraph |= prose[node]
    found: dict[int, bool] = {}
    for tag, digest, hid, in_article in zip(tree.tags, tree.digests(), hidden, inside):
        if digest and not hid and tag in BLOCK and tag not in ("html", "body", "article", "main") and not (in_article and tag in PROSE):
            strict = in_article or tag in PROSE
            found[digest] = found.get(digest, True) and strict
    return _signed(xxhash.xxh3_64_intdigest(longest[2].encode("utf-8", "surrogatepass"))), [_signed(d) for d in found], list(found.values())


def main_text(html: str, containers: frozenset, prose: frozenset) -> tuple[str, int]:
    """Text of one page without the subtrees of its host's template, and how many subtrees were deleted.

    `containers` are template hashes for elements outside of the article, `prose` those that hold
    everywhere. With an article (or main) element its text counts, else that of the whole page.
    """
    tree = Tree(html)
    out, inside = tree.marked()
    deleted = 0
    if containers or prose:
        template = [False] * len(tree.tags)
        for i, digest in enumerate(tree.digests()):
            up, tag = tree.parents[i], tree.tags[i]
            if up >= 0 and template[up]:
                template[i] = True
            elif digest and tag in BLOCK and tag not in ("html", "body", "article", "main") and not (inside[i] and tag in PROSE):
                strict = inside[i] or tag in PROSE
                if _signed(digest) in (prose if strict else containers):
                    template[i] = True
                    deleted += 1
        out = [a or b for a, b in zip(out, template)]
    if not any(a and not b for a, b in zip(inside, out)):
        inside = None
        _menus(tree, out)
    return tree.text(out, inside), deleted


def host_of(url: Column) -> Column:
    """Host of a URL in lower case; null without one."""
    host = F.lower(F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about BLOCK_BYTES of html; a longer page stands alone."""
    for batch in batches:
        at, held = 0, 0
        for i, size in enumerate(pc.fill_null(pc.binary_length(batch.column("html")), 0).to_pylist()):
            held += size
            if held >= BLOCK_BYTES:
                yield batch.slice(at, i + 1 - at)
                at, held = i + 1, 0
        if at < batch.num_rows:
            yield batch.slice(at)


def site_templates(pages: DataFrame, least: int = LEAST_PAGES, share: float = PAGE_SHARE, prose_share: float = PROSE_SHARE) -> DataFrame:
    """(host, hash, strict): subtrees that recur on many different pages of a host, from columns host and html.

    `strict` says that a hash reaches the larger share. Every page with a host counts; pages whose
    longest paragraphs are equal count as one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _pages(batches):
            rows: set[tuple] = set()
            for host, html in zip(part.column("host").to_pylist(), part.column("html")):
                page, hashes, strict = subtrees(html.as_py() or "")
                rows.add((host, page, 0, False))
                rows.update((host, page, h, s) for h, s in zip(hashes, strict))
            columns = list(zip(*rows)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.bool_()))], names=["host", "page", "hash", "prose"])

    found = pages.where("host is not null").select("host", "html").mapInArrow(run, "host string, page bigint, hash bigint, prose boolean")
    counted = materialise(
        found.groupBy("host", "hash", "page").agg(F.min("prose").alias("prose")).groupBy("host", "hash").agg(F.count("*").alias("n"), F.min("prose").alias("prose")).where(f"hash = 0 or n >= {int(least)}"),
        "subtrees",
    )
    hosts = session.small_side(counted.where("hash = 0").select("host", F.col("n").alias("pages")), "hosts")
    joined = counted.where("hash <> 0").join(hosts, "host")
    strict = F.col("n") >= prose_share * F.col("pages")
    return joined.where(strict | (~F.col("prose") & (F.col("n") >= share * F.col("pages")))).select("host", "hash", strict.alias("strict"))


def extract_text(df: DataFrame, keep: list[str], url: str = "url", html: str = "html", broadcast_rows: int | None = None, **limits) -> DataFrame:
    """One row per row of `df`: the `keep` columns, text, n_chars, n_template.

    `text` is the article in page order: character references decoded, white space inside a block
    one blank, blocks joined by one blank; empty if there is none (null and empty pages too).
    `n_template` counts the subtrees deleted as template of the page's host. Pages without a host
    have no template. Repeated rows are extracted each for itself; an empty table gives no rows.
    Other columns are not read; a `keep` column named like an output is a ValueError.
    `limits` go to `site_templates`. Template hashes are broadcast up to `broadcast_rows` of them; beyond that
    pages meet those of their host in a join, large hosts dealt over SALTS tasks.
    """
    clash = set(keep) & {"text", "n_chars", "n_template"}
    if clash:
        raise ValueError(f"columns {sorted(clash)} are named like results; rename them first")
    host = host_of(F.col(url))
    pages = df.select(F.struct(*keep).alias("kept") if keep else F.lit(0).alias("kept"), host.alias("host"), F.col(html).cast("string").alias("html"))
    templates = materialise(site_templates(pages, **limits), "templates")
    by_host = templates.groupBy("host").agg(F.collect_list("hash").alias("containers"), F.collect_list(F.when(F.col("strict"), F.col("hash"))).alias("prose"))
    if templates.count() <= (session.BROADCAST_ROWS if broadcast_rows is None else broadcast_rows):
        joined = pages.join(F.broadcast(by_host), "host", "left")
    else:
        salt = F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int")
        dealt = by_host.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = pages.withColumn("salt", salt).join(dealt, ["host", "salt"], "left")
    source = joined.select("kept", "html", "containers", "prose")
    schema = T.StructType([source.schema["kept"], *T._parse_datatype_string("text string, n_chars bigint, n_template bigint").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, tuple] = {}
        for part in _pages(batches):
            texts, deleted = [], []
            for page, containers, prose in zip(part.column("html"), part.column("containers"), part.column("prose")):
                sets = (frozenset(), frozenset())
                if containers.is_valid:
                    values = containers.values.to_numpy().tobytes(), prose.values.to_numpy().tobytes()
                    if values not in seen:
                        if len(seen) > 256:
                            seen.clear()
                        seen[values] = (frozenset(containers.as_py()), frozenset(prose.as_py()))
                    sets = seen[values]
                text, n = main_text(page.as_py() or "", *sets)
                texts.append(text)
                deleted.append(n)
            out = pa.array([t.encode("utf-8", "replace").decode() for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays([part.column("kept"), out, pa.array([len(t) for t in texts], pa.int64()), pa.array(deleted, pa.int64())], names=["kept", "text", "n_chars", "n_template"])

    done = source.mapInArrow(run, schema)
    return done.select(*[F.col("kept")[k].alias(k) for k in keep], "text", "n_chars", "n_template")
