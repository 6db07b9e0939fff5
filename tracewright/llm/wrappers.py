"""HTML extraction (operator 9): wrappers by union-free regular expressions.

Pages of one host come from few templates.  A page is a stream of structural
tokens (block tags with their classes, and text slots).  Repeated neighbouring
groups fold into one, so pages that differ only in how much they hold have the
same stream.  The distinct streams of a host are aligned with each other, one
after the other: what both have stays, what only one has becomes an optional
group, groups that repeat in either become repeated groups, and texts become
slots, unless they belong to the template: a text that stands under the same
path on at least three different pages of the host, and on half of those with
that path, is a constant of the wrapper; inside article or main elements only
pages count where it also stands outside of them.  The result is the host's wrapper, a
regular expression without alternatives.

Each page is aligned with its host's wrapper, so its elements and texts have
places there.  The host's running text is added up by the wrapper's elements,
and the deepest element that holds four fifths of it is the host's region.  The
main text of a page is what stands in slots inside article or main elements, on
pages without them inside the region; never constants, menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles or comments of readers.  A
page whose texts there are all constants keeps them, as copies of one page would
else lose their text.

Hosts are dealt over salts: streams are first made distinct per host, each salt
builds a wrapper from its share of them, and the salts' wrappers are aligned in
turn, so a host with most of the pages is not one task.  Wrappers meet their
pages by host and salt.

Defined results: a null html counts as empty, and an empty page has an empty text;
a null or broken url counts as the host ''; white space in a block becomes one
space, blocks are joined by one space; repeated rows are kept; empty tables give
empty tables; columns other than id, url and html are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, small_batches

#: Elements whose content is never main text, elements that start
#: and end a block, elements without an end, and words in class, id or role that
#: mark what is not main text.
OUT = frozenset("head nav header footer aside form button select textarea input menu dialog template noscript iframe object canvas svg audio video map".split())
RAW = ("script", "style", "textarea", "title", "xmp", "noembed", "noframes")
BLOCK = frozenset("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address details summary fieldset hgroup center hr".split()) | OUT
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MARKS = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header masthead menu modal nav navbar navigation newsletter notice pagination pager popup promo promotion related reply replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets complementary contentinfo search alert".split())
#: Elements that hold a page or an article whole; their classes say nothing about ads.
WHOLE = frozenset(("html", "body", "main", "article"))
MAIN = frozenset(("article", "main"))
#: An open element of the first kind ends when one of the second starts.
_BLOCKS_END_P = frozenset("address article aside blockquote center details dialog div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
ENDS = {
    "p": _BLOCKS_END_P, "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")),
    "tr": frozenset(("tr",)), "td": frozenset(("td", "th", "tr")), "th": frozenset(("td", "th", "tr")), "head": frozenset(("body",)),
}
SALTS = 16
#: Open elements that browsers nest at most.
DEEPEST = 512
#: Longest repeated group that folding looks for, in tokens.
LONGEST_GROUP = 12
MARKS_OF_GROUPS = frozenset(("(", ")+", ")?"))
#: A text is a constant from this many different pages of a host on, and this share
#: of those with its path.
LEAST_PAGES, LEAST_SHARE = 3, 0.5
#: Alignments of streams with wrappers that a task remembers.
REMEMBERED = 4096

_token = re.compile(r"""<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*+)((?:"[^"]*+"|'[^']*+'|[^'">])*+)>""", re.S)
#: Where markup starts, and a tag that ends at the next '>' whatever its quotes say.
_start = re.compile(r"<(?:[!?]|/?[a-zA-Z])").search
_careless = re.compile(r"<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_attribute = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_mark = re.compile(r"[a-z]+").findall


class Page:
    """Blocks of a page: (path of tags, text, text inside links).

    One pass over the source, whatever is in it: after a tag whose quotes don't
    close, tags end at the next '>'; markup without any '>' is text.  As in browsers
    elements deeper than ``DEEPEST`` don't nest further; their text stays."""

    def __init__(self, source: str):
        self.blocks: list[tuple[tuple[str, ...], str, int]] = []
        self.stream: list[str] = []
        self.stack: list[tuple[str, str]] = []
        self.opened: Counter = Counter()
        self.flat: Counter = Counter()
        self.text: list[str] = []
        self.linked, self.links = 0, 0
        at, n, token = 0, len(source), _token
        while at < n:
            start = _start(source, at)
            m = start and token.match(source, start.start())
            if start and m is None and token is _token:
                token = _careless
                m = token.match(source, start.start())
            if m is None:
                self._text(source[at:])
                break
            if m.start() > at:
                self._text(source[at : m.start()])
            at = m.end()
            if m.group(2):
                name = m.group(2).lower()
                self._open(name, m.group(3))
                if name in RAW and not m.group(3).endswith("/"):
                    end = re.compile(rf"</{name}[\s/>]", re.I).search(source, at)
                    at = end.start() if end else n  # what is inside is no page text
            elif m.group(1):
                self._close(m.group(1).lower())
        self._flush()

    def _text(self, s: str) -> None:
        self.text.append(s)
        if self.links:
            self.linked += len(s)

    def _flush(self) -> None:
        text = " ".join(entities.unescape("".join(self.text)).split())
        if text:
            self.blocks.append((tuple(x for _, x in self.stack), text, self.linked))
            self.stream.append("#")
        self.text, self.linked = [], 0

    def _label(self, name: str, attributes: str) -> str:
        """The tag with its classes; '!' before what can't hold main text."""
        if name in WHOLE:
            return name
        out, classes = name in OUT, []
        if attributes and attributes != "/":
            for m in _attribute.finditer(attributes):
                key, value = m.group(1).lower(), (m.group(2) or m.group(3) or m.group(4) or "").lower()
                if key == "hidden" or key == "aria-hidden" and value == "true":
                    out = True
                elif key in ("class", "id", "role"):
                    if key == "class":
                        classes += [re.sub(r"\d+", "0", c) for c in value.split()]
                    out = out or not MARKS.isdisjoint(_mark(value))
        return ("!" if out else "") + ".".join([name, *sorted(classes)])

    def _open(self, name: str, attributes: str) -> None:
        if name == "br":
            self.text.append(" ")
            return
        if name in RAW and name not in OUT:
            if name == "title":
                return
            return
        if name == "a":
            self.links += 1
        label = self._label(name, attributes)
        if name not in BLOCK and not (label[0] == "!" and name not in VOID):
            return  # inline: part of the block around it
        self._flush()
        while self.stack and name in ENDS.get(self.stack[-1][0], ()):
            self._end()
        if name not in VOID and not (attributes or "").endswith("/"):
            if len(self.stack) >= DEEPEST:
                self.flat[name] += 1
                return
            self.stack.append((name, label))
            self.opened[name] += 1
            self.stream.append("<" + label)

    def _end(self) -> None:
        name, label = self.stack.pop()
        self.opened[name] -= 1
        self.stream.append(">" + label)

    def _close(self, name: str) -> None:
        if name == "a" and self.links:
            self.links -= 1
        if self.flat[name]:
            self.flat[name] -= 1
            self._flush()
            return
        if not self.opened[name]:
            return
        self._flush()
        while self.stack[-1][0] != name:
            self._end()
        self._end()


def fold(stream: list[str]) -> tuple[str, ...]:
    """Neighbouring equal groups become one group '( ... )+', inner ones first."""
    return tuple(fold_places(stream)[0])


def fold_places(stream: list[str]) -> tuple[list[str], list[list[int]]]:
    """``fold``, with the places in the stream that each token stands for."""
    s, at = list(stream), [[i] for i in range(len(stream))]
    for size in range(1, LONGEST_GROUP + 1):
        out: list[str] = []
        places: list[list[int]] = []
        i = 0
        while i < len(s):
            group = s[i : i + size]
            j = i + size
            while s[j : j + size] == group and len(group) == size:
                j += size
            if j > i + size and _balanced(group):
                whole = len(group) > 1 and group[0] == "(" and group[-1] == ")+"
                merged = [[x for q in range(i + r, j, size) for x in at[q]] for r in range(size)]
                out += group if whole else ["(", *group, ")+"]
                places += merged if whole else [[], *merged, []]
                i = j
            else:
                out.append(s[i])
                places.append(at[i])
                i += 1
        s, at = out, places
    return s, at


def _balanced(group: list[str]) -> bool:
    depth = 0
    for t in group:
        depth += t[0] in "<(" if t != "(" else 1
        depth -= t[0] in ">)"
        if depth < 0:
            return False
    return depth == 0


def align(a: tuple[str, ...], b: tuple[str, ...]) -> tuple[str, ...]:
    """A wrapper that both wrappers (or streams) fit: shared tokens stay, others
    become optional; a group that repeats in one repeats in both."""
    if a == b:
        return a
    bare_a, bare_b = [t for t in a if t not in "()+()?"], [t for t in b if t not in "()+()?"]
    repeats, optional = set(), set()
    for s in (a, b):
        open_: list[int] = []
        k = 0
        for t in s:
            if t == "(":
                open_.append(k)
            elif t in (")+", ")?"):
                (repeats if t == ")+" else optional).add(tuple((s is a and bare_a or bare_b)[open_.pop() : k]))
            else:
                k += 1
    out: list[str] = []
    for kind, i, j, k, m in SequenceMatcher(None, bare_a, bare_b, autojunk=False).get_opcodes():
        if kind == "equal":
            out += bare_a[i:j]
        else:
            for part in (bare_a[i:j], bare_b[k:m]):
                if part:
                    out += ["(", *part, ")?"]
    return _mark_groups(out, optional | repeats, repeats)


def _mark_groups(s: list[str], groups: set[tuple[str, ...]], repeats: set[tuple[str, ...]]) -> tuple[str, ...]:
    """Put the marks of known groups back where their tokens stand together."""
    out, i = [], 0
    sizes = sorted({len(g) for g in groups}, reverse=True)
    while i < len(s):
        for n in sizes:
            g = tuple(s[i : i + n])
            if g in groups and not (out and out[-1] == "("):
                out += ["(", *g, ")+" if g in repeats else ")?"]
                i += n
                break
        else:
            out.append(s[i])
            i += 1
    return fold(out)


def infer(streams: list[tuple[str, ...]]) -> tuple[str, ...]:
    """The wrapper of distinct streams, aligned in order."""
    wrapper = streams[0]
    for s in streams[1:]:
        wrapper = align(wrapper, s)
    return wrapper


def placed(wrapper: tuple[str, ...], folded: tuple[str, ...]) -> dict[int, int]:
    """Places of a folded stream's tokens in the wrapper's tokens, both without marks."""
    return {b + i: a + i for a, b, n in SequenceMatcher(None, wrapper, folded, autojunk=False).get_matching_blocks() for i in range(n)}


def bare(tokens) -> tuple[str, ...]:
    return tuple(t for t in tokens if t not in MARKS_OF_GROUPS)


def main_region(held: dict[tuple[int, int, str], int], total: int) -> int:
    """The deepest element that still holds four fifths of the running text, as a
    place in the wrapper; -1: the whole page.  held: characters outside links by
    (depth, place, tag)."""
    good = [(d, n, -k) for (d, k, tag), n in held.items() if total and n >= 0.8 * total and tag not in ("p", "li", "td", "tr", "h1", "h2")]
    return -max(good)[2] if good else -1


def usable(path: tuple[str, ...]) -> bool:
    return not any(x[0] == "!" for x in path)


def written(page: Page) -> str:
    """A page's stream, a token a line; a text token is '#', the characters in
    links, a tab and the text (which has no other white space than spaces)."""
    texts = iter(page.blocks)
    return "\n".join("#%d\t%s" % (b[2], b[1]) if t == "#" and (b := next(texts)) else t for t in page.stream)


class Read:
    """A written page: its tokens, and for each text (place, open elements as
    places, path of tags, text, characters in links)."""

    def __init__(self, source: str):
        self.tokens: list[str] = []
        self.texts: list[tuple[int, tuple[int, ...], tuple[str, ...], str, int]] = []
        opened: list[int] = []
        labels: list[str] = []
        for i, t in enumerate(source.split("\n") if source else ()):
            if t[0] == "#":
                linked, text = t[1:].split("\t", 1)
                self.texts.append((i, tuple(opened), tuple(labels), text, int(linked)))
                t = "#"
            elif t[0] == "<":
                opened.append(i)
                labels.append(t[1:])
            else:
                opened.pop()
                labels.pop()
            self.tokens.append(t)

    def with_constants(self, fixed: frozenset[int]) -> list[str]:
        """The tokens, constants of the template as '=' and a code."""
        out = list(self.tokens)
        if fixed:
            for i, _, path, text, _ in self.texts:
                code = code_of(path, text)
                if code in fixed:
                    out[i] = f"={code}"
        return out


def code_of(path: tuple[str, ...], text: str) -> int:
    """Code of a text under a path; of the path alone without a text."""
    return int.from_bytes(blake2b(("\n".join(path) + "\t" + text).encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


class Matcher:
    """Aligns pages with their hosts' wrappers; remembers what it aligned."""

    def __init__(self) -> None:
        self.known: dict[tuple[str, tuple[str, ...]], dict[int, int]] = {}
        self.split: dict[str, tuple[str, ...]] = {}

    def places(self, tokens: list[str], wrapper: str) -> dict[int, int]:
        """Place in the wrapper of each token that has one."""
        folded, at = fold_places(tokens)
        plain = bare(folded)
        key = wrapper, plain
        if key not in self.known:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
                self.split.clear()
            if wrapper not in self.split:
                self.split[wrapper] = bare(wrapper.split("\n"))
            self.known[key] = placed(self.split[wrapper], plain)
        found = self.known[key]
        where = [a for t, a in zip(folded, at) if t not in MARKS_OF_GROUPS]
        return {i: found[k] for k, a in enumerate(where) if k in found for i in a}

    def slots(self, page: Read, fixed: frozenset[int], wrapper: str) -> list[tuple[bool, tuple[tuple[int, int, str], ...], tuple[str, ...], str, int]]:
        """For each text that can be main text: whether it fills a slot, its elements
        in the wrapper as (depth, place, tag), path, text, characters in links."""
        tokens = page.with_constants(fixed)
        if not any(usable(p) for _, _, p, _, _ in page.texts):
            return []
        at = self.places(tokens, wrapper)
        out = []
        for i, opened, path, text, linked in page.texts:
            if usable(path):
                inside = tuple((d, at[o], x.split(".")[0]) for d, (o, x) in enumerate(zip(opened, path)) if o in at)
                out.append((tokens[i] == "#", inside, path, text, linked))
        return out


def extract(slots, region: int) -> str:
    """The main text of a page, from its texts as ``Matcher.slots`` gives them."""
    if any(x in MAIN for _, _, p, _, _ in slots for x in p):
        chosen = [s for s in slots if any(x in MAIN for x in s[2])]
    else:
        chosen = [s for s in slots if region < 0 or any(k == region for _, k, _ in s[1])]
        if not any(s[0] for s in chosen):
            chosen = slots
    return " ".join(s[3] for s in [s for s in chosen if s[0]] or chosen)


def constants(parsed: DataFrame) -> DataFrame:
    """(host, fixed): codes of the texts that are constants; hosts without any are left out.
    A text inside article or main counts only on pages where it also stands outside of
    them: what merely repeats within articles is theirs."""

    def codes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for host, source in zip(b["host"], b["page"]):
                texts = [(p, t, any(x in MAIN for x in p)) for _, _, p, t, _ in Read(source).texts]
                outside = {t for _, t, inside in texts if not inside}
                found = {(code_of(p, ""), code_of(p, t)) for p, t, _ in texts if t in outside}
                paths = {code_of(p, "") for p in {p for p, _, _ in texts}}
                rows += [(host, code_of((), source), p, t) for p, t in sorted(found | {(p, p) for p in paths})]
            yield pd.DataFrame(rows, columns=["host", "copy", "p", "t"]).astype({"copy": "int64", "p": "int64", "t": "int64"})

    # Copies of a page count once.
    pages = parsed.select("host", "page").mapInPandas(codes, "host string, copy long, p long, t long")
    counts = pages.groupBy("host", "p", "t").agg(F.count_distinct("copy").alias("n")).filter(F.col("n") >= LEAST_PAGES)
    counts = settle(counts, "texts")
    of_path = counts.filter("p = t").select("host", "p", F.col("n").alias("all"))
    often = counts.filter("p <> t").join(of_path, ["host", "p"]).filter(F.col("n") >= LEAST_SHARE * F.col("all"))
    return often.groupBy("host").agg(F.sort_array(F.collect_set("t")).alias("fixed"))  # at most 1 / LEAST_SHARE for each path and text of a page


def _fixed(column: pd.Series) -> list[frozenset[int]]:
    return [frozenset(map(int, x)) if x is not None else frozenset() for x in column]


def _streams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each host its distinct streams."""
    for b in batches:
        streams: Counter = Counter()
        for host, source, fixed in zip(b["host"], b["page"], _fixed(b["fixed"])):
            streams[host, "\n".join(fold(Read(source).with_constants(fixed)))] += 1
        yield pd.DataFrame([(h, s, n) for (h, s), n in streams.items()], columns=["host", "value", "n"])


def _running_text(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Running text in slots, by the wrapper's elements, of pages without article or main;
    place -1 for all of it."""
    matcher = Matcher()
    for b in batches:
        held: Counter = Counter()
        for host, source, fixed, wrapper in zip(b["host"], b["page"], _fixed(b["fixed"]), b["wrapper"]):
            slots = matcher.slots(Read(source), fixed, wrapper)
            if not any(x in MAIN for _, _, p, _, _ in slots for x in p):
                for slot, inside, _, text, linked in slots:
                    n = max(0, len(text) - linked)
                    if slot and n:
                        for d, k, tag in ((-1, -1, ""), *inside):
                            held[host, d, k, tag] += n
        yield pd.DataFrame([(*k, n) for k, n in held.items()], columns=["host", "depth", "place", "tag", "n"])


def _salted(known: DataFrame) -> DataFrame:
    """A row for each salt, so that no host's pages are one task."""
    return known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")))


def wrappers(parsed: DataFrame) -> DataFrame:
    """(host, fixed, wrapper, region): one row for each host; parsed has host, salt and page."""
    fixed = settle(parsed.select("host").distinct().join(constants(parsed), "host", "left"), "constants")
    distinct = settle(parsed.join(_salted(fixed), ["host", "salt"]).select("host", "page", "fixed").mapInPandas(_streams, "host string, value string, n long").groupBy("host", "value").agg(F.sum("n").alias("n")), "streams")

    def of_group(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["n", "value"], ascending=[False, True])
        wrapper = infer([tuple(s.split("\n")) if s else () for s in rows["value"]])
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "n": [int(pdf["n"].sum())], "value": ["\n".join(wrapper)]})

    def of_texts(pdf: pd.DataFrame) -> pd.DataFrame:
        held = {(int(d), int(k), tag): int(n) for d, k, tag, n in zip(pdf["depth"], pdf["place"], pdf["tag"], pdf["n"])}
        total = held.pop((-1, -1, ""), 0)
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "region": [main_region(held, total)]})

    schema = "host string, n long, value string"
    salted = distinct.withColumn("salt", F.pmod(F.xxhash64("value"), F.lit(SALTS)))
    merged = salted.groupBy("host", "salt").applyInPandas(of_group, schema).groupBy("host").applyInPandas(of_group, schema)
    known = settle(fixed.join(merged.select("host", F.col("value").alias("wrapper")), "host"), "wrappers")
    text = parsed.join(_salted(known), ["host", "salt"]).select("host", "page", "fixed", "wrapper").mapInPandas(_running_text, "host string, depth int, place int, tag string, n long")
    region = text.groupBy("host", "depth", "place", "tag").agg(F.sum("n").alias("n")).groupBy("host").applyInPandas(of_texts, "host string, region int")
    return settle(known.join(region, "host", "left").withColumn("region", F.coalesce("region", F.lit(-1))), "regions")


def host_of(url: str):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url).cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, wrapper) for every row."""
    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    pages = df.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), host_of(url_col).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["id", "url", "host"]].assign(page=[written(Page(h)) for h in b["html"]])

    parsed = settle(pages.mapInPandas(parse, f"id {kind}, url string, host string, page string"), "pages")
    parsed = parsed.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)))
    both = parsed.join(_salted(wrappers(parsed)), ["host", "salt"]).select("id", "url", "page", "fixed", "region", "wrapper")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher()
        for b in batches:
            texts = [extract(matcher.slots(Read(p), f, w), int(r)) for p, f, r, w in zip(b["page"], _fixed(b["fixed"]), b["region"], b["wrapper"])]
            yield pd.DataFrame({"id": b["id"], "url": b["url"], "text": texts, "wrapper": b["wrapper"]})

    return both.mapInPandas(run, f"id {kind}, url string, text string, wrapper string").withColumnRenamed("id", id_col)
