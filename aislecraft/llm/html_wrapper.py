"""Main text of web pages by union-free wrappers of their hosts.

A page is a tree of elements and texts. The pages of one host are aligned one
after another with the host's wrapper: children that a page lacks become
optional, equal neighbours become one repeated group, texts become slots. Where
keys come back after others, or in another order, the mismatch is resolved into
a repeated group of optional parts, `(h2? p? ul?)*`, so that a wrapper is a
regular expression without unions whose node never has a key twice, and its size
follows the distinct keys and not the pages. Partial wrappers of each partition
are merged by host, in two steps for hosts with many.

Labels are then inferred on the wrapper, over all pages of the host: which
element holds the article, which groups hold no main text, which blocks are
mostly links, and which texts of a slot come back on pages of other contents.
Tags and class names are evidence for a group's label; inside the article a part
of a class name counts only for a container that comes back on the host's pages.
A page is read through its host's wrapper: each of its texts falls into a slot,
and the labels of the slot and of what holds it decide.

White space is that of Python's str.split, so a no-break space is a space; a
line break inside a block is white space; blocks are the block-level elements.

Cases: a null or empty html has an empty text; so has a page that is nothing but
menus; unclosed elements end where the enclosing one ends; nesting and numbers of
siblings have no limit; character references without a meaning stay as they are;
a null url is a host of its own; the order of pages changes no text; repeated
rows keep a row each; an empty table gives no rows; columns other than page_id,
url and html play no part.
"""

from __future__ import annotations

import html as references
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislecraft.llm.common import small_enough, stored
from aislecraft.llm.url_tree import host_of

OPENING = re.compile(r"<(?:!--|[!?]|(/?)([A-Za-z][A-Za-z0-9:-]*))")
MARK = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|hidden)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
RAW = frozenset("script style textarea title noscript iframe xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that hold no main text, and names of classes, ids and roles that say the same.
DROPPED = frozenset("head nav footer aside form script style noscript iframe button select input textarea svg template object canvas title menu dialog xmp".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies copyright dialog disqus footer gdpr login menu modal nav navbar navigation newsletter notice pager pagination popup promo promotion related reply replies respond responses search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget".split()
)
ROOTS = frozenset("article main articlebody".split())
SOFT_ROOTS = frozenset("articlecontent articletext content entry entrycontent entrytext maincontent post postbody postcontent posttext story storybody storycontent storytext".split())
#: Elements that a whole class, id or role (without digits and hyphens) can make the article; words before a name that only tell of the layout.
CONTAINERS = frozenset("article center div main section td".split())
LAYOUT = frozenset("has no with without".split())
#: Block elements whose start ends an open paragraph, and elements that end an open one of their kind.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Pages of distinct contents that must have a text for it to be a constant; the share of linked letters beyond which a block is a menu.
CONSTANT_PAGES, LINKED = 5, 0.5
#: Distinct texts of a slot that are told apart; a slot with more is all variable. Distinct keys below one node; beyond, class names no longer count there.
MOST_TEXTS, MOST_KEYS = 16, 256
#: Pages, and their share, on which a container inside the article comes back when a part of its class name counts.
RECURRING, RECURRING_SHARE = 5, 0.3


@lru_cache(maxsize=1 << 16)
def cues(key: str) -> tuple[int, int | None]:
    """What an element's key says: whether it holds no main text (0: no; 1: by a part of a class name; 2: by its tag or a whole name), and whether it may be the article (0), all of the main text (1) or, by a softer name, the article (2)."""
    tag, *names = key.split(" ")
    if tag in DROPPED:
        return 2, None
    plain = {re.sub(r"[^a-z]", "", n) for n in names} if tag in CONTAINERS else set()
    rank = 1 if tag == "main" else 0 if tag == "article" else None
    if rank is None and plain & ROOTS:
        rank = 0 if plain & ROOTS - {"main"} else 1
    if rank is None and plain & SOFT_ROOTS:
        rank = 2
    if tag in ("html", "body", "main"):
        return 0, rank
    if not NAMES.isdisjoint(n.strip("0-_") for n in names):
        return 2, rank
    if rank is not None:  # a part of a name tells of its layout only, as in no-comments
        return 0, rank
    parts = [re.split(r"[^a-z0-9]+", n) for n in names]
    return int(any(p[0] not in LAYOUT and not NAMES.isdisjoint(p) for p in parts)), None


class Node:
    """An element of a page; `children` are nodes and strings."""

    __slots__ = ("tag", "key", "children")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.children, names = tag, [], set()
        if attributes:
            for name, a, b, c in ATTRIBUTE.findall(attributes):
                names.update((a or b or c).lower().split())
        self.key = " ".join([tag, *sorted({re.sub(r"[0-9]+", "0", n) for n in names})])


def tokens(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, "/" of an end tag, name, attributes) of comments, declarations (without a name) and tags, in proportion to the page: what a failed tag has looked at is not looked at again."""
    at, hopeless, never = 0, set(), len(page) + 1  # marks from which no tag ends; a place behind which there is no mark
    last = page.rfind(">")
    while m := OPENING.search(page, at):
        start, inner = m.start(), m.end()
        at = inner
        if not m[2]:
            comment = page[start:inner] == "<!--"
            end = page.find("-->", inner) if comment else page.find(">", inner) if inner <= last else -1
            if end >= 0 or comment:
                at = len(page) if end < 0 else end + (3 if comment else 1)
                yield start, at, "", "", ""
            continue
        path, here = [], inner
        while here < never:
            mark = MARK.search(page, here)
            if not mark:
                never = here
                break
            k = mark.start()
            if k in hopeless:
                break
            path.append(k)
            if page[k] == ">":
                at = k + 1
                yield start, at, m[1] or "", m[2].lower(), page[inner:k]
                break
            close = page.find(page[k], k + 1)
            if close < 0:
                break
            here = close + 1
        if at == inner:
            hopeless.update(path)


def parse(page: str) -> Node:
    """The tree of a page."""
    root = Node("#page")
    stack, at, opened = [root], 0, Counter()

    def cut(k: int) -> None:
        opened.subtract(n.tag for n in stack[k:])
        del stack[k:]

    def add(text: str) -> None:
        if text and not text.isspace():
            stack[-1].children.append(references.unescape(text))
        elif text and stack[-1].children:
            stack[-1].children.append(" ")

    for start, end, closing, tag, attributes in tokens(page):
        if start < at:
            continue  # inside a script or the like
        add(page[at:start])
        at = end
        if not tag:
            continue
        if closing:
            if opened[tag]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        cut(k)
                        break
                    if stack[k].tag in ("article", "body") and tag not in BLOCKS:
                        break
            continue
        if tag in BLOCKS and any(opened[t] for t in ("p", *SIBLINGS.get(tag, ()))):  # a block ends an open paragraph, with what is open inside it
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p" or stack[k].tag in SIBLINGS.get(tag, ()):
                    cut(k)
                    break
                if stack[k].tag in BLOCKS:
                    break
        node = Node(tag, attributes)
        stack[-1].children.append(node)
        if tag in RAW:
            last = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = last.end() if last else len(page)
        elif tag not in VOID and not attributes.endswith("/"):
            stack.append(node)
            opened[tag] += 1
    add(page[at:])
    return root


def squeezed(text: str) -> str:
    return " ".join(text.split())


def content_of(page: Node) -> int:
    """A hash of a page's text without menus and the like: pages alike in it are copies."""
    texts: list[str] = []
    stack: list[Node | str] = [page]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            texts.append(n)
        elif not cues(n.key)[0] and n.tag != "header":
            stack += reversed(n.children)
    return fingerprint(" ".join(texts))


def fingerprint(text: str) -> int:
    return zlib.crc32(squeezed(text).encode("utf-8", "replace"))


def items(node: Node) -> Iterator[Node | list[str]]:
    """The children of a page's element: elements, and lists of the strings between them that are more than white space."""
    texts: list[str] = []
    for c in node.children:
        if isinstance(c, str):
            texts.append(c)
            continue
        if any(not t.isspace() for t in texts):
            yield texts
        texts = []
        yield c
    if any(not t.isspace() for t in texts):
        yield texts


class Part:
    """A node of a wrapper, or a slot (key `#`): how many elements it stands for, how many parents have one, whether it repeats, whether its children are a repeated group of optional ones, its letters and linked letters (of a slot), and the texts of a slot with hashes of the pages that have them."""

    __slots__ = ("key", "count", "parents", "repeats", "loop", "general", "letters", "linked", "texts", "children", "order", "drop", "menu", "root")

    def __init__(self, key: str):
        self.key, self.count, self.parents, self.repeats, self.loop, self.general, self.letters, self.linked = key, 0, 0, False, False, False, 0, 0
        self.texts: dict[int, tuple[int, ...]] | None = {}
        self.children: dict[str, Part] = {}
        self.order: list[str] = []
        self.drop = self.menu = self.root = False

    def name(self, key: str) -> str:
        return key.partition(" ")[0] if self.general else key

    def child(self, key: str, after: str | None) -> Part:
        """The child of a key, new ones behind `after`."""
        found = self.children.get(key)
        if found is None:
            found = self.children[key] = Part(key)
            self.order.insert(self.order.index(after) + 1 if after is not None else 0, key)
        return found

    def by_tag(self) -> None:
        """From here on only tags count below this node."""
        old, self.general = [self.children[k] for k in self.order], True
        self.children, self.order, self.loop = {}, [], True
        for c in old:
            into = self.child(self.name(c.key), self.order[-1] if self.order else None)
            into.repeats |= into.parents > 0
            merge(into, c)

    def generalise(self) -> None:
        if not self.general and len(self.children) > MOST_KEYS:
            self.by_tag()

    def note(self, text: int, pages: tuple[int, ...]) -> None:
        """A text of a slot, on pages of these contents; no more of them are kept than make it a constant."""
        if self.texts is not None:
            self.texts[text] = tuple(sorted({*self.texts.get(text, ()), *pages})[:CONSTANT_PAGES])
            if len(self.texts) > MOST_TEXTS:
                self.texts = None

    def constant(self, text: int) -> bool:
        return self.texts is not None and len(self.texts.get(text, ())) >= CONSTANT_PAGES

    def follow(self, keys: list[str]) -> None:
        """Whether the order of `keys` (all known) is that of the children; if not, they are a loop."""
        if not self.loop:
            place = {k: i for i, k in enumerate(self.order)}
            at = [place[k] for k in keys]
            self.loop = any(x >= y for x, y in zip(at, at[1:]))


def absorb(wrapper: Part, page: Node) -> None:
    """Align a page with the wrapper of its host."""
    content = content_of(page)
    wrapper.parents += 1
    stack = [(wrapper, page, False)]
    while stack:
        w, node, linked = stack.pop()
        w.generalise()  # nothing that is still on the stack stands below it
        w.count += 1
        seen: dict[str, None] = {}
        last: str | None = None
        for item in items(node):
            key = "#" if isinstance(item, list) else w.name(item.key)
            c = w.child(key, last)
            if key in seen:
                c.repeats = True
                w.loop |= key != last
            else:
                seen[key] = None
                c.parents += 1
            if isinstance(item, list):
                text = squeezed("".join(item))
                c.count += 1
                c.letters += len(text)
                c.linked += len(text) if linked else 0
                c.note(fingerprint(text), (content,))
            else:
                stack.append((c, item, linked or item.tag == "a"))
            last = key
        w.follow(list(seen))


def settled(wrapper: Part) -> Part:
    """The wrapper with all nodes of too many keys generalised."""
    stack = [wrapper]
    while stack:
        w = stack.pop()
        w.generalise()
        stack += w.children.values()
    return wrapper


def pattern(page: Node) -> Part:
    """The wrapper of one page."""
    out = Part(page.key)
    absorb(out, page)
    return settled(out)


def merge(into: Part, other: Part) -> Part:
    """The wrapper of the pages of both, as `into`."""
    stack = [(into, other)]
    while stack:
        a, b = stack.pop()
        a.count, a.parents, a.letters, a.linked = a.count + b.count, a.parents + b.parents, a.letters + b.letters, a.linked + b.linked
        a.repeats, a.loop = a.repeats | b.repeats, a.loop | b.loop
        if a.texts is not None and b.texts is not None:
            for text, pages in b.texts.items():
                a.note(text, pages)
        else:
            a.texts = None
        if b.general and not a.general:
            a.by_tag()
        last, keys = None, []
        for k in b.order:
            last = a.name(k)
            c = a.child(last, keys[-1] if keys else None)
            keys.append(last)
            stack.append((c, b.children[k]))
        a.follow(keys)
        if len(a.children) > MOST_KEYS and not a.general:  # its children first
            for c, d in stack[len(stack) - len(b.order) :]:
                merge(c, d)
            del stack[len(stack) - len(b.order) :]
            a.generalise()
    return into


def parts_of(wrapper: Part) -> list[tuple[Part, int]]:
    """All parts with the place of their parents, parents first."""
    out, stack = [], [(wrapper, -1)]
    while stack:
        part, parent = stack.pop()
        out.append((part, parent))
        stack += [(part.children[k], len(out) - 1) for k in reversed(part.order)]
    return out


def written(wrapper: Part) -> str:
    return json.dumps([[parent, p.key, p.count, p.parents, p.repeats + 2 * p.loop + 4 * p.general, p.letters, p.linked, None if p.texts is None else list(p.texts.items())] for p, parent in parts_of(wrapper)])


def read(raw: str) -> Part:
    found: list[Part] = []
    for parent, key, count, parents, flags, letters, linked, texts in json.loads(raw):
        p = Part(key)
        p.count, p.parents, p.repeats, p.loop, p.general, p.letters, p.linked = count, parents, bool(flags & 1), bool(flags & 2), bool(flags & 4), letters, linked
        p.texts = None if texts is None else {t: tuple(pages) for t, pages in texts}
        if parent >= 0:
            found[parent].children[key] = p
            found[parent].order.append(key)
        found.append(p)
    return found[0]


def expression(wrapper: Part) -> str:
    """The wrapper as a regular expression over its keys and slots: `?` optional, `+` repeated, `*` both; the parts of a loop, `( )*`, are each optional."""
    parts = parts_of(wrapper)
    done: list[list[str]] = [[] for _ in parts]
    for k in range(len(parts) - 1, -1, -1):
        p, parent = parts[k]
        inner = " ".join(reversed(done[k]))
        text = p.key if not inner else f"{p.key} {{ {f'( {inner} )*' if p.loop else inner} }}"
        if parent < 0:
            return text
        above = parts[parent][0]
        if above.loop or p.parents >= above.count and not p.repeats:
            done[parent].append(text)
        else:
            done[parent].append(f"( {text} )" + ("+" if p.parents >= above.count else "*" if p.repeats else "?"))
    return ""


def labelled(wrapper: Part) -> Part:
    """Infer the labels on the whole wrapper: the article's elements, groups that hold no main text, blocks that are menus."""
    parts = parts_of(wrapper)
    tags = [p.key.partition(" ")[0] for p, _ in parts]
    letters, linked, size = [p.letters for p, _ in parts], [p.linked for p, _ in parts], [p.letters for p, _ in parts]
    for k in range(len(parts) - 1, 0, -1):
        p, parent = parts[k]
        letters[parent] += letters[k]
        linked[parent] += linked[k]
        size[parent] += 0 if cues(p.key)[0] == 2 else size[k]
    found: tuple[list[int], list[int], list[int]] = ([], [], [])
    above, lost = [3] * len(parts), [False] * len(parts)
    for k, (p, parent) in enumerate(parts):
        loss, rank = cues(p.key)
        lost[k] = parent >= 0 and lost[parent] or loss > 0 or tags[k] == "header"
        above[k] = above[parent] if parent >= 0 else 3
        if not lost[k] and rank is not None and rank < above[k] and size[k]:
            found[rank].append(k)
            above[k] = rank
    articles, mains, soft = found
    roots = mains if mains and 2 * sum(size[k] for k in articles) < sum(size[k] for k in mains) else articles or soft
    inside = [False] * len(parts)
    for k in roots:
        parts[k][0].root = True
    for k, (p, parent) in enumerate(parts):
        within = parent >= 0 and inside[parent]
        inside[k] = within or p.root
        loss = cues(p.key)[0]
        recurs = parent >= 0 and p.parents >= max(RECURRING, RECURRING_SHARE * parts[parent][0].count) and tags[k] in CONTAINERS
        p.drop = loss == 2 or loss == 1 and (not within or recurs) or tags[k] == "header" and not inside[k]
        p.menu = linked[k] > LINKED * letters[k]
    return wrapper


def blocks_of(page: Node, wrapper: Part | None = None) -> list[str]:
    """The article's blocks of a page, read through the labelled wrapper of its host (of the page alone, where there is none)."""
    wrapper = labelled(pattern(page)) if wrapper is None else wrapper
    has_root, stack = False, [(page, wrapper)]
    while stack and not has_root:
        node, w = stack.pop()
        has_root = w.root
        if not w.drop:
            stack += [(c, w.children[k]) for c in node.children if not isinstance(c, str) and (k := w.name(c.key)) in w.children]
    out: list[str] = []
    open_text: list[str] = []
    varied = False

    def close() -> None:
        nonlocal varied
        text = squeezed("".join(open_text))
        if text and varied:  # a constant among other text of its block stays
            out.append(text)
        open_text.clear()
        varied = False

    # the text of a labelled article is never a constant or a menu: only what the wrapper labels as something else goes
    # what is still to be read, last first: an element, a text, or the end of a block
    todo: list[tuple[Node | list[str] | None, Part | None, bool, bool]] = [(page, wrapper, not has_root, False)]
    while todo:
        node, w, inside, menu = todo.pop()
        if node is None:
            close()
            continue
        if isinstance(node, list):
            if inside and not menu:
                open_text += node
                varied |= w is not BLANK and (has_root or w is None or not w.constant(fingerprint("".join(node))))
            continue
        block = node.tag in BLOCKS
        inside |= w is not None and w.root
        if w.drop if w is not None else cues(node.key)[0] == 2:
            if block:
                close()
            continue
        if block:
            close()
            menu = not has_root and w is not None and w.menu  # the innermost block decides
        elif node.tag in VOID:
            open_text.append(" ")
        below: list[tuple[Node | list[str] | None, Part | None, bool, bool]] = []
        texts: list[str] = []
        for c in [*node.children, None]:
            if isinstance(c, str):
                texts.append(c)
                continue
            if texts:
                slot = w.children.get("#") if w is not None else None
                below.append((texts, BLANK if all(map(str.isspace, texts)) else slot, inside, menu))
                texts = []
            if c is not None:
                below.append((c, w.children.get(w.name(c.key)) if w is not None else None, inside, menu))
        if block:
            todo.append((None, None, False, False))
        todo += reversed(below)
    close()
    return out


class _Blank(Part):
    """Stands for white space, which makes no block."""

    def constant(self, text: int) -> bool:
        return True


BLANK = _Blank("#")
#: Wrapper parts that a task holds before it writes its partial wrappers; hosts with many partial wrappers have them merged in so many lots first.
HELD_PARTS, LOTS = 200_000, 64


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (JSON) from all pages (host, html): partial wrappers of each partition, merged by host."""

    def induce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Part] = {}
        held = 0

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"host": pa.array(list(found), pa.string()), "wrapper": pa.array([written(settled(w)) for w in found.values()], pa.string())})
            found.clear()
            return out

        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if host not in found:
                    found[host] = Part("#page")
                absorb(found[host], parse(page))
                held += 1 + len(page) // 64  # its elements, about
                if held > HELD_PARTS:
                    yield flush()
                    held = 0
        if found:
            yield flush()

    def unite(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = read(pdf["wrapper"].iloc[0])
        for w in pdf["wrapper"].iloc[1:]:
            merge(whole, read(w))
        return pd.DataFrame({"host": pdf["host"].iloc[:1], "wrapper": [written(settled(whole))]})

    parts = pages.where(F.col("html").isNotNull()).select("host", "html").mapInArrow(induce, "host string, wrapper string")
    lots = parts.withColumn("lot", F.pmod(F.xxhash64("wrapper"), F.lit(LOTS))).groupBy("host", "lot").applyInPandas(unite, "host string, wrapper string")
    return lots.groupBy("host").applyInPandas(unite, "host string, wrapper string")


#: Bytes of wrappers up to which they are broadcast; beyond, each goes to as many parts of its host's pages as SALT says. Bytes of wrappers that a task holds.
BROADCAST_BYTES, SALT, LOADED = 16 << 20, 32, 32 << 20


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host_of(F.col("url")).alias("host"))
    known = stored(wrappers(source.select("host", "html")), "wrappers")
    if small_enough(known, BROADCAST_BYTES, F.octet_length("wrapper") + F.octet_length("host")):
        joined = source.join(F.broadcast(known), "host", "left")
    else:
        salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        joined = source.withColumn("salt", F.pmod(F.xxhash64("page_id", "html"), F.lit(SALT)).cast("int")).join(salted, ["host", "salt"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded: dict[str, Part] = {}
        held = 0
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                rows, texts = batch.slice(a, 64), []
                for page, host, raw in zip(*(rows.column(k).to_pylist() for k in (2, 3, 4))):
                    if raw is not None and host not in loaded:
                        if held > LOADED:
                            loaded, held = {}, 0
                        loaded[host] = labelled(read(raw))
                        held += len(raw)
                    texts.append("\n".join(blocks_of(parse(page), loaded.get(host))) if page else "")
                yield pa.RecordBatch.from_pydict({"page_id": rows.column(0), "url": rows.column(1), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    return joined.select("page_id", "url", "html", "host", "wrapper").mapInArrow(run, "page_id long, url string, text string, n_chars long")
