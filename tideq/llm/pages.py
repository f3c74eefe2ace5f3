"""Main text of web pages: structure, and a suffix array over the pages of a host.

A page is parsed into blocks. What stands in menus, page headers, footers,
sidebars, notices, adverts, forms, scripts, styles and reader comments, by tag,
role, class or id, is left out. The blocks that remain are the token streams.
For each host the streams are joined into one sequence, with a different end
mark after each block, and its suffixes are sorted by prefix doubling as far as
``run`` tokens. A run of at least so many tokens that occurs on ``pages``
distinct pages of the host is boilerplate: its tokens are covered.

A page that marks its article (``article``, ``main`` or role main) gives the
blocks in it, whole: an article that was published twice is still the page's
main text. A page that marks none gives its blocks without the covered tokens,
so that the unique runs stay. Of every page the covered words are counted.

The arrays go over the pages of all hosts. Distinct
pages are dealt to shards of about ``shard`` characters by a hash of the page,
so that one host may have any share of all pages. Each shard's array counts the
pages of a run there; as no page is in two shards, the sums by host and run are
the host's whole counts, whatever the number of shards, and the runs that reach
``pages`` go back to the shards that hold them. Runs are named by two 64-bit
hashes in between. Most runs stand once; so that these aren't shuffled by name,
the shards of a host first tell each other, in packed lists, into which of 2^24
buckets of as many parts as there are shards their runs fall. A run whose
bucket has under ``pages`` pages in all shards can't reach ``pages``; the
others are counted by name. Texts are packed (zlib) between the steps.

Defined results: null html gives empty text; a null or odd url has the host
''; repeated rows are each answered, but count as one page if url and html are
equal; a very long page is one shard by itself; an empty table gives an empty
result; further columns aren't read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideq.llm.common import broadcast_within, forget, written

#: Characters of main text that one suffix array takes; no result depends on it.
SHARD = 4_000_000
#: Bits of a run's bucket within its part of a host.
BUCKET = 24
#: Elements that are never main text.
OUT = frozenset(
    "head title nav footer aside form script style noscript template iframe svg math canvas object audio video button select option textarea input dialog menu".split()
)
#: Words of a class or id, or roles, that mark what is not main text.
OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar cookie cookies consent gdpr notice notices alert"
    " newsletter subscribe subscription signup popup modal overlay breadcrumb breadcrumbs menu nav navbar navigation footer comments comment disqus respond"
    " share sharing social related recommended widget toolbar pagination pager login search complementary contentinfo dialog form skip masthead replies responses".split()
)
#: Words that say in a class or id only where or how something stands: a name counts if every other word of it is one of ``OUT_WORDS``.
PLAIN_WORDS = frozenset(
    "site page post article main global top bottom left right inner outer wrapper wrap container box bar block area section list item items link links button buttons header"
    " content primary secondary reader readers user users thread js is has wp id the my".split()
)
#: Elements that names never leave out: those that mark the article, headings, and the page itself.
NAMED_FREELY = frozenset("html body article main h1 h2 h3 h4 h5 h6".split())
MAIN_TAGS = frozenset(("article", "main"))
#: Elements that begin and end a block.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main"
    " nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
SPACES = frozenset(("br", "td", "th", "wbr"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_WHITE = re.compile(r"\s+")
_PARTS = re.compile(r"[^a-z]+")
_TAG_BEGINS = re.compile(r"<[a-zA-Z/!?]")
#: A decimal character reference of more digits than Python reads as a number without limits.
_LONG_REFERENCE = re.compile(r"&#[0-9]{20,}")


def names_no_text(name: str) -> bool:
    """Whether a class or id is wholly made of words for what is not main text: ``cookie-notice``, ``comments-area``, but no slug of a title."""
    words = [w for w in _PARTS.split(name) if w]
    return any(w in OUT_WORDS for w in words) and all(w in OUT_WORDS or w in PLAIN_WORDS for w in words)


class _Reader(HTMLParser):
    """Blocks of a page as (in the marked article, text)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, bool]] = []  # tag, left out, marks the article
        self.places: dict[str, list[int]] = {}  # of the open elements by tag, so that an end tag never walks the stack
        self.outs: list[int] = []
        self.mains: list[int] = []
        self.out = self.main = 0
        self.blocks: list[tuple[bool, str]] = []
        self.text: list[str] = []

    def flush(self) -> None:
        if self.text:
            text = _WHITE.sub(" ", "".join(self.text)).strip()
            if text:
                self.blocks.append((self.main > 0, text))
            self.text = []

    def _close(self, at: int) -> None:
        for tag, out, main in self.open[at:]:
            self.out -= out
            self.main -= main
            self.places[tag].pop()
        del self.open[at:]
        for places in (self.outs, self.mains):
            while places and places[-1] >= at:
                places.pop()

    def _open(self, tag: str, out: bool, main: bool) -> None:
        at = len(self.open)
        self.places.setdefault(tag, []).append(at)
        if out:
            self.outs.append(at)
        if tag in MAIN_TAGS:
            self.mains.append(at)
        self.open.append((tag, out, main))
        self.out += out
        self.main += main

    def handle_starttag(self, tag: str, attrs: list) -> None:
        named = {k: (v or "").lower() for k, v in attrs}
        if tag in BLOCKS:
            self.flush()
            if self.open and self.open[-1][0] == "p":
                self._close(len(self.open) - 1)
        elif tag in SPACES:
            self.text.append(" ")
        if tag in VOID:
            return
        role = named.get("role", "")
        main = tag in MAIN_TAGS or role == "main"
        names = [*named.get("class", "").split(), named.get("id", ""), role]
        free = tag in NAMED_FREELY
        out = tag in OUT or not free and any(map(names_no_text, names)) or "hidden" in named or named.get("aria-hidden") == "true"
        header = any("header" in _PARTS.split(n) and all(w in PLAIN_WORDS or not w for w in _PARTS.split(n)) for n in names)
        out = out or (tag == "header" or header and not free) and not self.main
        if main and not out and self.out and not self.main:
            # an element left open before the article doesn't hold it
            self._close(self.outs[0])
        if tag == "body":
            self._close(0)
        self._open(tag, out, main and not out)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self.flush()
        elif tag in SPACES:
            self.text.append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        if places := self.places.get(tag):
            at = places[-1]
            # an end tag inside an article closes nothing around it
            if tag in MAIN_TAGS or tag in ("body", "html") or not self.mains or self.mains[-1] <= at:
                self._close(at)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """A marked section of no known kind is a comment to the next ``>``, as browsers have it; the library raises an error."""
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            return self.parse_bogus_comment(i)

    def handle_data(self, data: str) -> None:
        if not self.out:
            self.text.append(data)


def blocks_of(html: str | None) -> tuple[list[str], bool]:
    """Blocks of a page that may be main text, and whether they are those of a marked article."""
    reader = _Reader()
    # no number of over eight digits is a character
    whole = _LONG_REFERENCE.sub(lambda m: "&#" + (m[0][2:].lstrip("0")[:8] or "0"), html or "")
    end = whole.rfind(">") + 1
    open_tag = _TAG_BEGINS.search(whole, end)  # a tag that never ends is no text, nor is what follows
    reader.feed(whole[: open_tag.start()] if open_tag else whole)
    reader.close()
    reader.flush()
    marked = [text for main, text in reader.blocks if main]
    return (marked, True) if marked else ([text for _, text in reader.blocks], False)


def coded(streams: list[list[str]]) -> tuple[np.ndarray, list[str]]:
    """All streams, one end mark (-1, -2 ...) after each, as numbers of their words; and the words."""
    known: dict[str, int] = {}
    number = known.setdefault
    text: list[int] = []
    for at, stream in enumerate(streams):
        text += [number(x, len(known)) for x in stream]
        text.append(-1 - at)
    return np.array(text, dtype=np.int64), list(known)


def ranked(text: np.ndarray, page: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of ``text`` (coded, with its streams' pages): rank by their first ``run`` tokens, and distinct pages by rank.

    Prefix doubling: a rank is the place in the array of the first suffix that begins alike. What has a rank by itself keeps it, and only the others are sorted on.
    """
    total = len(text)
    owner = np.repeat(page, np.diff(np.flatnonzero(text < 0), prepend=-1))
    rank, length = np.zeros(total, dtype=np.int64), 0
    key, left = text + len(page), np.arange(total)
    while len(left):
        order = np.argsort(key)
        key, left = key[order], left[order]
        old = rank[left]
        place = np.arange(len(left))
        new = np.concatenate([[True], key[1:] != key[:-1]])
        begin = np.concatenate([[True], old[1:] != old[:-1]])
        starts = np.flatnonzero(new)
        rank[left] = old + starts[np.cumsum(new) - 1] - np.flatnonzero(begin)[np.cumsum(begin) - 1]
        alone = new & np.concatenate([new[1:], [True]])
        left = left[~alone]
        length = max(1, length)
        step = min(length, run - length)
        if not step:
            break
        after = np.where(left + step < total, rank[np.minimum(left + step, total - 1)], -1)
        key = rank[left] * (total + 2) + after + 1
        length += step
    # neighbours in the array with the same rank share a run; a rank counts by its distinct pages
    distinct = np.bincount(rank, minlength=1)
    several = np.flatnonzero(distinct[rank] > 1) if total else rank
    pages = int(page.max(initial=0)) + 1
    pair = np.unique(rank[several] * pages + owner[several]) // pages
    shared = np.bincount(pair, minlength=len(distinct))
    return rank, np.where(distinct > 1, shared, distinct)


def cover(starts: np.ndarray, sizes: list[int], run: int) -> list[np.ndarray]:
    """For each stream, which tokens lie in one of the runs that begin at ``starts``."""
    edge = np.zeros(len(starts) + run + 1, dtype=np.int64)
    hit = np.flatnonzero(starts)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + run, -1)
    inside = np.cumsum(edge)[: len(starts)] > 0
    out, at = [], 0
    for n in sizes:
        out.append(inside[at : at + n])
        at += n + 1
    return out


def covered(streams: list[list[str]], page: np.ndarray, run: int, pages: int) -> list[np.ndarray]:
    """For each stream, which tokens lie in a run that occurs in streams of ``pages`` distinct pages."""
    rank, distinct = ranked(coded(streams)[0], page, run)
    return cover(distinct[rank] >= pages, [len(s) for s in streams], run)


def run_names(text: np.ndarray, words: list[str], run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each suffix as in ``ranked``, whether its first ``run`` tokens lie in one stream, and two hashes (a, b) of them."""
    total = len(text)
    hashed = np.array([*(xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) for x in words), 0], dtype=np.uint64)
    tokens = np.zeros(total + run, dtype=np.uint64)
    tokens[:total] = hashed[np.maximum(text, -1)]
    ends = np.flatnonzero(text < 0)
    whole = np.arange(total) + run <= np.repeat(ends, np.diff(ends, prepend=-1))
    names = []
    for factor in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        value = np.zeros(total, dtype=np.uint64)
        for step in range(run):
            value = (value ^ (value >> np.uint64(29))) * np.uint64(factor) + tokens[step : step + total]
        names.append(value.view(np.int64))
    return whole, names[0], names[1]


def streams_of(texts: list[str], run: int) -> tuple[list[list[str]], np.ndarray]:
    """Token streams of the blocks of all texts, and the text that each is of; a block shorter than a run is filled up, so that it repeats only as a whole."""
    streams, owner = [], []
    for number, text in enumerate(texts):
        for block in text.split("\n") if text else ():
            words = block.split(" ")
            streams.append(words + [""] * (run - len(words)))
            owner.append(number)
    return streams, np.array(owner, dtype=np.int64)


def packed(text: str) -> bytes:
    return zlib.compress(text.encode("utf-8"), 1)


def unpacked(texts: pd.Series) -> list[str]:
    return [zlib.decompress(x).decode("utf-8") for x in texts]


def packed_list(numbers: np.ndarray) -> bytes:
    """Sorted numbers below 2^32, as differences by planes of bytes, which are mostly small."""
    return zlib.compress(np.diff(numbers, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked_list(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(4, -1).T).view("<u4").ravel(), dtype=np.int64)


def places_of(a: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Part and bucket of runs by their first hash."""
    bits = a.view(np.uint64)
    return ((bits >> np.uint64(32)) % np.uint64(parts)).astype(np.int64), (bits & np.uint64((1 << BUCKET) - 1)).astype(np.int64)


def counted_runs(texts: list[str], run: int, least: int) -> pd.DataFrame:
    """a, b, n: the runs on at least so many of the texts, by a suffix array over them."""
    streams, owner = streams_of(texts, run)
    text, words = coded(streams)
    rank, distinct = ranked(text, owner, run)
    whole, a, b = run_names(text, words, run)
    first = np.full(len(distinct), -1)
    first[rank[::-1]] = np.arange(len(rank))[::-1]
    first = first[(first >= 0) & (distinct >= least)]
    first = first[whole[first]]
    return pd.DataFrame({"a": a[first], "b": b[first], "n": distinct[rank[first]].astype(np.int64)})


def asked_buckets(runs: pd.DataFrame, parts: int, pages: int) -> Iterator[tuple[int, bytes]]:
    """Of each part the buckets of the runs (a, n), each as many times as it has pages, up to ``pages``."""
    part, bucket = places_of(runs["a"].to_numpy(dtype=np.int64), parts)
    times = np.minimum(runs["n"].to_numpy(dtype=np.int64), pages)
    both = np.sort(np.repeat((part << BUCKET) | bucket, times))
    cuts = np.searchsorted(both >> BUCKET, np.arange(parts + 1))
    for k in range(parts):
        if cuts[k] < cuts[k + 1]:
            yield k, packed_list(both[cuts[k] : cuts[k + 1]] & ((1 << BUCKET) - 1))


def without_covered(texts: list[str], marked: list[bool], runs: pd.DataFrame, run: int) -> tuple[list[str], list[int]]:
    """The texts without the tokens that ``runs`` (a, b) cover, a marked one whole; and of how many words of each that is so."""
    streams, owner = streams_of(texts, run)
    whole, a, b = run_names(*coded(streams), run)
    # few have one of the first hashes: only these are looked up by both
    some = np.flatnonzero(whole & np.isin(a, runs["a"].to_numpy(dtype=np.int64)))
    both = pd.DataFrame({"a": a[some], "b": b[some]}).merge(runs[["a", "b"]].astype("int64").drop_duplicates().assign(hit=True), on=["a", "b"], how="left")["hit"]
    hit = np.zeros(len(a), dtype=bool)
    hit[some[both.notna().to_numpy()]] = True
    kept: list[list[str]] = [[] for _ in texts]
    found = [0] * len(texts)
    for stream, number, gone in zip(streams, owner, cover(hit, [len(s) for s in streams], run)):
        if gone.any():
            found[number] += sum(1 for t, g in zip(stream, gone) if g and t)
        if not marked[number]:
            left = " ".join(t for t, g in zip(stream, gone) if t and not g)
            if left:
                kept[number].append(left)
    return [text if m else "\n".join(x) for text, m, x in zip(texts, marked, kept)], found


def extract(
    rows: DataFrame, run: int = 8, pages: int = 3, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", shard: int = SHARD
) -> DataFrame:
    """page_id, url, host, marked, text, n_chars and n_repeated (words in runs that stand on ``pages`` pages of the host) for every row."""
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    source = rows.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parsed = [("\n".join(blocks), marked) for blocks, marked in map(blocks_of, batch["html"])]
            yield batch.drop(columns="html").assign(text=[packed(x) for x, _ in parsed], marked=[m for _, m in parsed], chars=[len(x) for x, _ in parsed])

    kind = dict(source.dtypes)["page_id"]
    columns = f"page_id {kind}, url string, host string, page_key long, text binary, marked boolean, chars long"
    read = written(source.withColumn("page_key", F.xxhash64("url", "html")).mapInPandas(parse, columns))
    # equal pages count once: only such are brought together before they are dealt
    several = broadcast_within(written(read.groupBy("page_key").count().where("count > 1").select("page_key")), 500_000)
    page = ["host", "page_key", "url", "marked", "text", "chars"]
    ids = lambda listed: F.to_json(listed).alias("ids")
    single = read.join(several, "page_key", "left_anti").select(*page, ids(F.array(F.struct("page_id"))))
    equal = read.join(several, "page_key", "left_semi").groupBy("host", "page_key").agg(*(F.first(c).alias(c) for c in page[2:]), ids(F.collect_list(F.struct("page_id"))))
    distinct = single.unionByName(equal)
    sizes = read.groupBy("host").agg(F.greatest(F.ceil(F.sum(F.col("chars") + 1) / shard), F.lit(1)).alias("shards"))
    dealt = distinct.join(broadcast_within(written(sizes), 200_000, F.length("host") + 24), "host").withColumn("shard", F.pmod("page_key", "shards"))

    def ask(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        runs = counted_runs(unpacked(group["text"]), run, 1)
        found = list(asked_buckets(runs, int(group["shards"].iloc[0]), pages))
        return pd.DataFrame({"host": key[0], "shard": key[1], "part": [k for k, _ in found], "buckets": [x for _, x in found]})

    def answer(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        lists = [unpacked_list(x) for x in group["buckets"]]
        bucket, times = np.unique(np.concatenate(lists), return_counts=True)
        hot = bucket[times >= pages]
        held = [np.intersect1d(x, hot) for x in lists]
        found = pd.DataFrame({"host": key[0], "shard": group["shard"], "part": key[1], "buckets": [packed_list(x) for x in held]})
        return found[[len(x) > 0 for x in held]]

    message = "host string, shard long, part long, buckets binary"
    asked = written(dealt.where("shards > 1").select("host", "shard", "shards", "text").groupBy("host", "shard").applyInPandas(ask, message))
    hot = written(asked.groupBy("host", "part").applyInPandas(answer, message))
    forget(asked)

    def count(group: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        # the only shard of its host has the whole counts
        shards = int(group["shards"].iloc[0])
        runs = counted_runs(unpacked(group["text"]), run, pages if shards == 1 else 1)
        if shards > 1:
            part, bucket = places_of(runs["a"].to_numpy(dtype=np.int64), shards)
            held = [np.zeros(0, dtype=np.int64), *((k << BUCKET) | unpacked_list(x) for k, x in zip(told["part"], told["buckets"]))]
            runs = runs[np.isin((part << BUCKET) | bucket, np.concatenate(held))]
        return runs.assign(host=group["host"].iloc[0], shard=group["shard"].iloc[0])[["host", "shard", "a", "b", "n"]]

    by_shard = dealt.select("host", "shard", "shards", "text").groupBy("host", "shard")
    counted = written(by_shard.cogroup(hot.groupBy("host", "shard")).applyInPandas(count, "host string, shard long, a long, b long, n long"))
    forget(hot)
    often = counted.groupBy("host", "a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= pages)
    repeated = written(counted.select("host", "shard", "a", "b").join(often, ["host", "a", "b"], "left_semi"))
    forget(counted)

    def clean(group: pd.DataFrame, runs: pd.DataFrame) -> pd.DataFrame:
        text, found = without_covered(unpacked(group["text"]), list(group["marked"]), runs, run)
        return group[["ids", "url", "host", "marked"]].assign(text=text, n_repeated=found)

    texts = dealt.select("ids", "url", "host", "marked", "text", "shard").groupBy("host", "shard").cogroup(repeated.groupBy("host", "shard"))
    answered = texts.applyInPandas(clean, "ids string, url string, host string, marked boolean, text string, n_repeated long")
    # an id goes through as text and back
    every = answered.withColumn("id", F.explode(F.from_json("ids", f"array<struct<page_id: {kind}>>")))
    return every.select("id.page_id", "url", "host", "marked", "text", F.length("text").cast("long").alias("n_chars"), "n_repeated")
