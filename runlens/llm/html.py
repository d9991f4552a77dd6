"""Main text of web pages: a host suffix array over all its pages, with page structure to mark and to protect.

1. Structure. A tokenizer walks the tags once. Menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts
   and styles are marked, by element, role, or a word of class or id; inside declared text a name counts only if all of
   its words say so (``ad-box``, not ``ad-hoc`` or ``legal-notice``). Of the rest, text inside ``article``, ``main`` or an element
   named like content is declared. Of these the innermost kind stays that holds at least a share of ``LEAST`` of what is
   declared, so one card in ``main`` does not stand for its text. A page that declares nothing is open.
2. Suffix array. The streams of a host's pages, marked parts included, are concatenated, their suffixes are sorted by their
   first ``RUN`` tokens (prefix doubling), and runs are counted in pages with different contents. Declared text is not dealt
   out: its runs are looked up among those of the suffix arrays and add to their counts.
3. From open text, runs in at least ``PAGES`` pages go, wherever on those pages they stand. Declared text is protected, also
   where it repeats: a passage that articles quote is no boilerplate. Marked parts always go.

A host is worked on in shards of bounded size; the shards' page counts of each run are added, so a run spread over
shards is found as well, and a host with a third of all pages is no single task.

Nulls: a null html is empty, a null url is a host of its own. Empty pages have empty text. Repeated pages get a row each and
count as one page of a host. Ties do not arise: blocks keep their order. A very long page is read whole, in time that grows with
its length. Extra columns go unless kept, whatever their names. Empty tables give no rows. Broken markup never fails: what is no
tag is text.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Tokens of a boilerplate run; distinct pages it must stand in; tokens of a shard.
RUN, PAGES, SHARD = 8, 3, 200_000
#: The share of the declared text that a kind must hold to stand for all of it.
LEAST = 0.25
#: Kinds of a stream's tokens; a break stands for declared text.
MARKED, OPEN, BREAK = 0, 1, 2
#: Bits of the filter of run codes that declared text is probed with.
RUN_BITS = 1 << 25

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>|<[!?][^>]*+>""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
# Elements and words of the web's vocabulary.
_VOID = set("area base br col embed hr img input link meta source track wbr".split())
_RAW = set("script style template textarea iframe title select button".split())
_BREAKS = set(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_OUT = set("nav header footer aside form head menu dialog".split())
_HEADINGS = set("h1 h2 h3 h4 h5 h6 hgroup".split())
_ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
_NAMES = set(
    "ad ads advert adverts advertisement advertising alert aside banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disqus "
    "foot footer gdpr masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promotion related "
    "replies respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
_PAGE_NAMES = set("header topbar".split())
_HOLDING = set("has with no without".split())
_GENERIC = set(
    "area bar block body box button buttons container content group inner item items left link links list main outer panel post posts right row section slot small text "
    "top unit widget wrap wrapper".split()
)
_CONTENT = set("article articlebody content entry main post story".split())


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(raw)} if raw and not raw.isspace() else {}


def _named(attributes: dict[str, str]) -> list[list[str]]:
    return [re.split(r"[-_:]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", n).lower()) for n in f"{attributes.get('class', '')} {attributes.get('id', '')}".split()]


class _Element:
    __slots__ = ("level", "name", "out")

    def __init__(self, name: str, out: int, level: int):
        self.name, self.out, self.level = name, out, level


def _hinted(words: list[str], name: str, level: int) -> bool:
    """Whether one class or id says that its element is no main text."""
    if words[0] in _HOLDING or (len(words) > 1 and words[-2] in _HOLDING):
        return False
    ends = {words[0], words[-1]}
    if name == "article":
        return bool(ends & {"comment", "comments"})
    if level:  # inside declared text
        said = [w for w in words if w and not w.isdigit()]
        return bool(ends & _NAMES) and all(w in _NAMES or w in _GENERIC for w in said)
    return bool(ends & (_NAMES | _PAGE_NAMES))


def blocks(page: str, hints: bool = True) -> list[tuple[int, str]]:
    """(level, text) of every block: 3 in an article, 2 in main, 1 in content, 0 elsewhere, -1 for what structure excludes."""
    found: list[tuple[int, str]] = []
    stack = [_Element("", 0, 0)]  # out: 1 under a form only, 3 in an article's header but its headings, 2 under anything else excluded
    opened: Counter[str] = Counter()
    unclosed: set[str] = set()
    said: list[str] = []
    marked: list[str] = []

    def end_block() -> None:
        for pieces, level in ((said, stack[-1].level), (marked, -1)):
            if pieces:
                text = " ".join("".join(pieces).split())
                pieces.clear()
                if text:
                    found.append((level, text))

    def text_between(a: int, b: int) -> None:
        if b > a:
            (marked if stack[-1].out else said).append(entities.unescape(page[a:b]))

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            text_between(at, n)
            break
        text_between(at, m.start())
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if name in _BREAKS:
            end_block()
        if m[1] or m[4]:  # an end tag closes up to its element, if that is open
            while opened[name]:
                closed = stack.pop().name
                opened[closed] -= 1
                if closed == name:
                    break
            continue
        if name in _RAW:
            closing = None if name in unclosed else re.compile(rf"</{name}\b[^>]*+>", re.I).search(page, at)
            if closing:
                at = closing.end()
            elif name in ("script", "style", "textarea", "title"):
                at = n
            else:
                unclosed.add(name)
            continue
        if name in _VOID:
            continue
        if name == "p" and stack[-1].name == "p":
            stack.pop()
            opened["p"] -= 1
        top = stack[-1]
        attributes = _attributes(m[3] or m[6] or "")
        out, level = top.out, top.level
        names = _named(attributes) if attributes else []
        role = attributes.get("role", "").lower()
        if name in ("article", "main") or role == "main":
            declared = 3 if name == "article" else 2
            out = 2 if out == 2 else 0  # a form around the whole page excludes nothing
        else:
            content = any(w[0] in _CONTENT or w[-1] in _CONTENT for w in names) or attributes.get("itemprop", "").lower() == "articlebody"
            declared = 1 if content and name in ("div", "section", "td") else 0
        if name == "header" and level == 3 and not out:
            out = 3
        elif name in _OUT:
            out = (out or 1) if name == "form" else 2
        elif out == 3 and name in _HEADINGS:
            out = 0
        if role in _ROLES or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", attributes.get("style", ""), re.I):
            out = 2
        if hints and name not in ("html", "body", "main") and names:
            if any(_hinted(words, name, level) for words in names):
                out = 2
        stack.append(_Element(name, out, max(level, declared)))
        opened[name] += 1
    end_block()
    return found


def _main_level(found: list[tuple[int, str]]) -> int:
    """The innermost level whose text and that of the levels inside it are a fair share of the declared text; 0 without any."""
    size = [sum(len(t) for x, t in found if x >= level) for level in (1, 2, 3)]
    return next((level for level in (3, 2, 1) if size[level - 1] and size[level - 1] >= LEAST * size[0]), 0)


def parts(page: str | None) -> tuple[str | None, list[str], list[tuple[int, str]], int]:
    """(declared text or None, open blocks, the stream as (kind, text), a code of the whole contents)."""
    found = blocks(page or "")
    if page and all(x < 0 for x, _ in found):
        found = [*blocks(page, hints=False)]
    level = _main_level(found)
    text = [t for x, t in found if x >= level]
    open_ = bool(text) and not level
    stream: list[tuple[int, str]] = []
    for x, t in found:
        if open_ or x < level:
            stream.append((OPEN if open_ and x == 0 else MARKED, t))
        elif stream and stream[-1][0] != BREAK:
            stream.append((BREAK, "\0"))
    contents = hashlib.blake2b("\n".join(t for _, t in found).encode(), digest_size=8).digest()
    return None if open_ else "\n".join(text), text if open_ else [], stream, int.from_bytes(contents, "little", signed=True)


def structure(page: str | None) -> tuple[str | None, list[str]]:
    """(declared text, []) or (None, open blocks)."""
    return parts(page)[:2]


def host(url) -> F.Column:
    """Column: the host of a url in lower case, without user and port; '' where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def run_codes(tokens: Sequence[np.ndarray], run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array of the concatenated streams to a depth of ``run`` tokens, by prefix doubling: (stream, place, rank) of each
    suffix with that many tokens; equal ranks share their first ``run`` tokens."""
    sizes = np.array([len(t) for t in tokens])
    flat = np.concatenate(tokens) if len(tokens) else np.zeros(0, np.int64)
    stream = np.repeat(np.arange(len(tokens)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    _, rank = np.unique(flat, return_inverse=True)
    width = 1
    while width < run:
        step = min(width, run - width)
        later = np.full(len(rank), -1, np.int64)
        later[: len(rank) - step] = rank[step:]
        _, rank = np.unique(rank * (len(rank) + 2) + later + 1, return_inverse=True)
        width += step
    whole = place + run <= sizes[stream] if len(flat) else np.zeros(0, bool)
    return stream[whole], place[whole], rank[whole]


def _stream(listed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(codes, offsets) of a list column of token codes."""
    off = listed.offsets.to_numpy()
    return listed.values.to_numpy()[off[0] : off[-1]], off - off[0]


def _run_code(codes: np.ndarray, at: np.ndarray, run: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        code = np.full(len(at), np.uint64(run), np.uint64)
        for j in range(run):
            code = C.mix(code * C._BASE + codes[at + j].view(np.uint64))
    return code


def _token_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(codes of all tokens, tokens of each row) of a string column."""
    codes, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for _, data, off in C.slices(texts):
        words = C.Words(data, off, C.VISIBLE, lower=False)
        codes.append(words.code)
        sizes.append(np.diff(words.first))
    return np.concatenate(codes), np.concatenate(sizes)


def _before(flags: np.ndarray) -> np.ndarray:
    """How many flags are set before each place, and in all."""
    return np.concatenate([[0], np.cumsum(flags)])


def _runs(codes: np.ndarray, kinds: np.ndarray, off: np.ndarray, run: int) -> np.ndarray:
    """Places where a run without a break begins."""
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    at = np.flatnonzero(np.arange(len(codes)) + run <= off[row + 1])
    breaks = _before(kinds == BREAK)
    return at[breaks[at + run] == breaks[at]]


def main_text(pages: DataFrame, keep: Sequence[str] = ("page_id", "url"), url: str = "url", html: str = "html", run: int = RUN, least: int = PAGES, shard: int = SHARD) -> DataFrame:
    """One row per page: the kept columns, text, n_chars, declared (whether the page names its main text)."""
    names = [f"k{i}" for i in range(len(keep))]
    parsed_names = ["rid", "host", *names, "text", "open", "content", "codes", "kinds"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), 500):
                part = batch.slice(first, 500)
                done = [parts(x.as_py()) for x in part.column(len(names) + 2)]
                codes, sizes = _token_codes(pa.array([" ".join(t for _, t in d[2]) for d in done], pa.string()))
                blocks_ = [(k, t.count(" ") + 1) for d in done for k, t in d[2]]
                kinds = np.repeat(np.array([k for k, _ in blocks_], np.int8), np.array([n for _, n in blocks_], np.int64))
                made = [pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.list_(pa.string())), pa.array([d[3] for d in done], pa.int64())]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made, C.lists(C.signed(codes), sizes), C.lists(kinds, sizes)], parsed_names)

    kinds = ", ".join(f"k{i} {pages.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    source = pages.select(F.monotonically_increasing_id().alias("rid"), host(F.col(url)).alias("host"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(html).alias("html"))
    parsed = C.cut(source.mapInArrow(read, f"rid long, host string, {kinds}, text string, open array<string>, content long, codes array<long>, kinds array<tinyint>"))

    # Runs of everything but declared text, of all pages: counted are those that open text has.
    distinct = parsed.where(F.size("codes") >= run).select("host", "content", "codes", "kinds").dropDuplicates(["host", "content"])
    shards = C.cut(distinct.groupBy("host").agg((F.ceil(F.sum(F.size("codes")) / shard)).alias("shards")))
    # Without the dealing by host and shard, a partitioning by host alone would do for the groups, and a hot host be one task.
    dealt = distinct.join(shards, "host").withColumn("shard", F.pmod("content", F.greatest("shards", F.lit(1)))).repartition("host", "shard")

    def count(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        codes, off = _stream(group.column("codes").combine_chunks())
        kind, _ = _stream(group.column("kinds").combine_chunks())
        stream, place, rank = run_codes([codes[off[i] : off[i + 1]] for i in range(len(off) - 1)], run)
        at = off[stream] + place
        breaks, opens = _before(kind == BREAK), _before(kind == OPEN)
        whole = breaks[at + run] == breaks[at]
        stream, rank, at = stream[whole], rank[whole], at[whole]
        is_open = opens[at + run] > opens[at]
        order = np.lexsort((stream, rank))
        stream, rank, at, is_open = stream[order], rank[order], at[order], is_open[order]
        new = np.ones(len(rank), bool)
        new[1:] = rank[1:] != rank[:-1]
        page = new.copy()
        page[1:] |= stream[1:] != stream[:-1]
        heads = np.flatnonzero(new)
        total = lambda flags: np.add.reduceat(flags.astype(np.int64), heads) if len(heads) else np.zeros(0, np.int64)
        n, opened = total(page), total(is_open) > 0
        code = _run_code(codes, at[heads], run)
        if key[2].as_py() <= 1:  # all pages of the host are here
            code, n, opened = code[opened], n[opened], opened[opened]
        return pa.table({"host": pa.array([key[0].as_py()] * len(n), pa.string()), "code": pa.array(C.signed(code)), "pages": pa.array(n), "opened": pa.array(opened)})

    counted = dealt.select("host", "shard", "shards", "codes", "kinds").groupBy("host", "shard", "shards").applyInArrow(count, "host string, code long, pages long, opened boolean")
    known = C.cut(counted.groupBy("host", "code").agg(F.sum("pages").alias("pages"), F.bool_or("opened").alias("opened")).where("opened").drop("opened"))

    # The same runs in declared text; apart: not also elsewhere on the page, where they are counted.
    packed = C.code_filter(known.select("code"), RUN_BITS)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = C.unpacked(packed)
        for batch in batches if bits.any() else ():
            own, own_off = _stream(batch.column(3))
            kind, _ = _stream(batch.column(4))
            for first, data, text_off in C.slices(batch.column(2)):
                words = C.Words(data, text_off, C.VISIBLE, lower=False)
                at, code = words.runs(run)
                some = C.may_hold(bits, code)
                at, code = at[some], code[some]
                row = words.row[at]
                apart = np.ones(len(at), bool)
                for r in np.unique(row):
                    a, b = own_off[first + r], own_off[first + r + 1]
                    starts = _runs(own[a:b], kind[a:b], np.array([0, b - a]), run)
                    apart[row == r] = ~np.isin(code[row == r], _run_code(own[a:b], starts, run))
                take = pa.array(row + first)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(C.signed(code)), pa.array(apart)], ["host", "content", "code", "apart"])

    declared_pages = parsed.where("text IS NOT NULL").select("host", "content", "text", "codes", "kinds")
    hits = declared_pages.mapInArrow(probe, "host string, content long, code long, apart boolean").join(known.select("host", "code"), ["host", "code"], "left_semi")
    by_page = hits.groupBy("host", "code", "content").agg(F.bool_and("apart").alias("apart"))
    said = by_page.groupBy("host", "code").agg(F.count_if("apart").alias("apart"))
    boilerplate = C.cut(known.join(said, ["host", "code"], "left").where(F.col("pages") + F.coalesce("apart", F.lit(0)) >= least).select("host", "code"))

    def rolling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, off = _stream(batch.column(2))
            kind, _ = _stream(batch.column(3))
            at = _runs(codes, kind, off, run)
            row = np.searchsorted(off, at, "right") - 1
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(at - off[row]), pa.array(C.signed(_run_code(codes, at, run)))], ["rid", "host", "at", "code"])

    rolled = parsed.where("text IS NULL").select("rid", "host", "codes", "kinds").mapInArrow(rolling, "rid long, host string, at long, code long")
    covered = rolled.join(boilerplate, ["host", "code"], "left_semi").groupBy("rid").agg(F.collect_list("at").alias("covered"))

    @F.arrow_udf("string")
    def unique_runs(open_: pa.Array, kinds_: pa.Array, places: pa.Array) -> pa.Array:
        out = []
        for listed, kind, starts in zip(open_.to_pylist(), kinds_.to_pylist(), places.to_pylist(), strict=True):
            covered_places, kept, at = {p + j for p in starts or () for j in range(run)}, [], 0
            gone = [i in covered_places for i, k in enumerate(kind or ()) if k == OPEN]
            for block in listed or ():
                said = block.split(" ")
                left = [w for i, w in enumerate(said) if not gone[at + i]]
                at += len(said)
                if left:
                    kept.append(" ".join(left))
            out.append("\n".join(kept))
        return pa.array(out, pa.string())

    kept = [F.col(f"k{i}").alias(c) for i, c in enumerate(keep)]
    declared = parsed.where("text IS NOT NULL").select(*kept, "text", F.lit(True).alias("declared"))  # only open pages are shuffled
    undeclared = parsed.where("text IS NULL").drop("text").join(covered, "rid", "left").select(*kept, unique_runs("open", "kinds", "covered").alias("text"), F.lit(False).alias("declared"))
    return declared.unionByName(undeclared).select(*keep, "text", F.char_length("text").cast("long").alias("n_chars"), "declared")
