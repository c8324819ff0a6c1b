"""HTML extraction: the main text of web pages, judged by a suffix array over each host's pages.

Each page is parsed as a stream of tags and text into blocks. Structure says of a block that it is protected (in the <article>, <main>
or role=main that the page marks), that it is no main text (its element, role or class makes it a menu, header, footer, sidebar,
notice, advert, form or reader comment), or nothing. Scripts, styles and other things that are never shown are no blocks.

The blocks of a host's pages that aren't protected are concatenated as token streams. Substrings of MIN_TOKENS tokens that stand on
distinct pages are found through the suffix array of the stream and its longest common prefixes, and what they cover wholly is
boilerplate and goes; runs that are unique to a page stay. Only where repeats say nothing does structure decide: blocks that it calls
no main text go, and so does what stands outside the marked article of a page that has one. Protected blocks are never judged by
repetition: articles that two pages share would go as boilerplate.

A class or id names a part that is no main text only as a whole token: a word of MARKS, or those with nothing but BEFORE and AFTER
them (site-header, sidebar-left; not has-sidebar or social-history). A <main> in a part that is named so counts all the same; an
<article> there counts where the page marks no other, unless its own class or id names it or it stands within an article.

Host streams are read in shards of about SHARD_BYTES of html, so a host that holds most pages is no single task. What repeats across
shards is found too: the shards of a large host exchange 128-bit digests of their windows of MIN_TOKENS tokens, each once and with
the least and the greatest digest of a page that holds it, and those of distinct pages are given back to all shards that have them.
So the result is that of one array over the whole host, however it is dealt. Pages are distinct if any of their blocks differ.

Defined results: null, empty or blank html gives an empty text; a null url is a host of its own; unclosed and stray tags are read as
browsers do for blocks; repeated rows give repeated results and are no repeats of each other; columns main_text and n_repeated are
replaced, other columns pass through whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Elements whose text is never shown or never main text.
DROPPED = frozenset("script style noscript template head title nav header footer aside form button select textarea option iframe svg canvas object dialog menu math audio video map".split())
#: Those of them that are never shown as text, or are no prose; they give no blocks.
SILENT = frozenset("script style noscript template head title select textarea option iframe svg canvas object math audio video map".split())
#: Elements whose content is raw text up to their own end tag.
RAW = frozenset("script style textarea title noscript iframe xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end a block before and after them.
BLOCKS = frozenset("address article blockquote body center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Words in a class or id that mark a part as no main text.
MARKS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer header masthead comment comments disqus cookie cookies consent notice notices gdpr popup modal newsletter subscribe subscription social share sharing related recommended widget login signup".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: Words that a name of such a part can have before and after it, as in site-header or sidebar-left. Any other word makes it another name.
BEFORE = frozenset("site page global main primary secondary top bottom left right mobile the".split())
AFTER = frozenset("area bar block body box bottom button buttons container form inner item items left link links list right section slot top unit widgets wrap wrapper".split())
_CLASS_WORD = re.compile(r"[a-z]+")
#: How a part is no main text: not at all, by its class or id alone, by anything else, or because it isn't text at all.
KEPT, NAMED, CERTAIN, UNSEEN = 0, 1, 2, 3
#: What structure says of a block: no main text, nothing, or that it is in the marked article.
REFUSED, OPEN, PROTECTED = 0, 1, 2


def _named(token: str) -> bool:
    """Whether a token of a class or id names a part that is no main text: a mark, or marks with nothing but BEFORE and AFTER them."""
    words = _CLASS_WORD.findall(token)
    at = 0
    while at < len(words) and words[at] in BEFORE and words[at] not in MARKS:
        at += 1
    return at < len(words) and words[at] in MARKS and all(w in MARKS or w in AFTER for w in words[at:])


def _unwanted(name: str, attrs: str) -> int:
    if name in DROPPED:
        return UNSEEN if name in SILENT else CERTAIN
    if not attrs.strip() or name in ("html", "body", "article", "main"):
        return KEPT
    found = KEPT
    for key, a, b, c in _ATTR.findall(attrs):
        key, value = key.lower(), (a or b or c).lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value in ROLES:
            return CERTAIN
        if key == "style" and "display:none" in value.replace(" ", ""):
            return CERTAIN
        if key in ("class", "id") and any(map(_named, value.split())):
            found = NAMED
    return found


def blocks(page: str) -> tuple[bool, list[str]]:
    """Whether the page marks its article, and the blocks in page order that structure alone takes for its main text."""
    found = parse(page)
    best = max((flag for flag, _ in found), default=REFUSED)
    return best == PROTECTED, [t for flag, t in found if flag == best != REFUSED]


def parse(page: str) -> list[tuple[int, str]]:
    """What structure says of each block, and its text, in page order."""
    out: list[tuple[int, bool, str]] = []
    parts: list[str] = []  # of main text, and of text that structure calls none
    refused: list[str] = []
    stack: list[tuple[str, int, int]] = []  # name, unwanted from here, inside a marked article: 2, or 1 if that stands in a NAMED part
    drop, main = KEPT, 0
    marked = 0
    at = 0

    def flush():
        for held, kept in ((parts, True), (refused, False)):
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                out.append((main, kept, text))

    def add(text):
        if drop < UNSEEN:
            (refused if drop else parts).append(text)

    while at < len(page):
        lt = page.find("<", at)
        m = _TAG.match(page, lt) if lt >= 0 else None
        if lt < 0 or m is None:
            stop = len(page) if lt < 0 else lt + 1
            add(entities.unescape(page[at:stop]))
            at = stop
            continue
        if lt > at:
            add(entities.unescape(page[at:lt]))
        at = m.end()
        if m["cdata"] is not None:
            add(m["cdata"])
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if name == "br":
            add(" ")
            continue
        if name in BLOCKS or name in DROPPED or name in RAW:
            flush()
        if m["end"]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), -1)
            if depth >= 0 and not (name not in BLOCKS and name not in DROPPED and any(stack[i][0] in BLOCKS for i in range(depth + 1, len(stack)))):
                del stack[depth:]
                drop, main = (stack[-1][1], stack[-1][2]) if stack else (KEPT, 0)
            continue
        if name in VOID or m["attrs"].rstrip().endswith("/") and name not in BLOCKS:
            continue
        if name == "p" or name in ("li", "dt", "dd", "td", "th", "tr", "option"):  # an open one of its kind ends here
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name or name in ("dt", "dd") and stack[i][0] in ("dt", "dd"):
                    del stack[i:]
                    drop, main = (stack[-1][1], stack[-1][2]) if stack else (KEPT, 0)
                    break
                if stack[i][0] in BLOCKS - {"p"} or stack[i][0] in DROPPED:
                    break
        own, whole = _unwanted(name, m["attrs"]), name == "main" or bool(re.search(r"role\s*=\s*[\"']?main\b", m["attrs"], re.I))
        own = KEPT if whole and own == NAMED else own
        if own == KEPT and (whole or name == "article"):
            if not drop:
                main = 2 if whole else main or 2
            elif drop == NAMED and not main and (whole or not _unwanted("div", m["attrs"])):
                drop, main = KEPT, 2 if whole else 1
            marked = max(marked, main)
        drop = max(drop, own)
        stack.append((name, drop, main))
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(page, at)
            if end is None:
                at = len(page)
            else:
                at = end.start()
    flush()
    return [((PROTECTED if marked and inside == marked else OPEN) if kept else REFUSED, t) for inside, kept, t in out]


# --- the host's suffix array ------------------------------------------------------------------------------------


def _ranks(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Start positions in the order of the first `depth` tokens of the suffixes at least, and the ranks by 1, 2, 4, ... tokens."""
    n = len(tokens)
    levels = [np.unique(tokens, return_inverse=True)[1].astype(np.int64)]
    k = 1
    order = np.argsort(levels[0], kind="stable")
    while k < min(depth, n) and levels[-1][order[-1]] < n - 1:
        key = levels[-1] * (n + 1)
        key[: n - k] += levels[-1][k:] + 1
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(sorted_[1:] != sorted_[:-1])])
        levels.append(rank)
        k *= 2
    return order, levels


def suffix_array(tokens: np.ndarray) -> np.ndarray:
    """Start positions in the order of the suffixes, by prefix doubling."""
    return _ranks(tokens, len(tokens))[0]


def repeated(tokens: np.ndarray, page: np.ndarray, length: int) -> np.ndarray:
    """For each token, whether a substring of `length` tokens that also stands on another page covers it.

    The array is sorted as deep as `length` needs. Neighbours in it that share `length` tokens form a group; a group with two pages
    is a repeat. Common prefixes of neighbours are put together from the ranks, largest power of two first.
    """
    n = len(tokens)
    covered = np.zeros(n, bool)
    if n < 2 * length:
        return covered
    order, levels = _ranks(tokens, length)
    lcp = np.zeros(n, np.int64)  # with the neighbour before
    for level in range(len(levels) - 1, -1, -1):
        a, b = order[:-1] + lcp[1:], order[1:] + lcp[1:]
        inside = (a < n) & (b < n)
        same = inside & (levels[level][np.minimum(a, n - 1)] == levels[level][np.minimum(b, n - 1)])
        lcp[1:] += same << level
    group = np.cumsum(lcp < length) - 1
    pages_here = page[order]
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    low, high = np.minimum.reduceat(pages_here, first), np.maximum.reduceat(pages_here, first)
    starts = order[(low != high)[group]]
    change = np.zeros(n + length + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + length, -1)
    return np.cumsum(change)[:n] > 0


def windows(parts: list[str], length: int) -> list[bytes]:
    """Digests of all windows of `length` tokens of a page."""
    words = " ".join(parts).split(" ")
    return [hashlib.blake2b(" ".join(words[i : i + length]).encode("utf-8", "surrogatepass"), digest_size=16).digest() for i in range(len(words) - length + 1)]


def covered_blocks(streams: list[list[str]], length: int, elsewhere: frozenset[bytes] | set[bytes] = frozenset()) -> list[list[bool]]:
    """For each block of each page whether repeats across distinct pages cover it; elsewhere: digests of windows that other shards have."""
    ids: dict[str, int] = {}
    tokens, page = [], []
    for p, parts in enumerate(streams):
        for b in parts:
            for w in b.split(" "):
                tokens.append(ids.setdefault(w, len(ids)))
        tokens.append(-1 - p)  # no substring crosses pages
        page += [p] * (len(tokens) - len(page))
    gone = repeated(np.array(tokens, np.int64), np.array(page, np.int64), length)
    out, at = [], 0
    for parts in streams:
        if elsewhere and parts:
            for i, w in enumerate(windows(parts, length), at):
                if w in elsewhere:
                    gone[i : i + length] = True
        own = []
        for b in parts:
            size = b.count(" ") + 1
            own.append(bool(gone[at : at + size].all()))
            at += size
        out.append(own)
        at += 1
    return out


# --- columns ----------------------------------------------------------------------------------------------------

#: Bytes of html in a shard of a host's stream, tokens that a boilerplate substring has at least, and hosts that are broadcast at most.
SHARD_BYTES, MIN_TOKENS, BROADCAST_HOSTS = 16 << 20, 6, 100_000


def _page_digest(found: list[tuple[int, str]]) -> int:
    text = "\0".join(f"{flag}{t}" for flag, t in found)
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def extract(df: DataFrame, html_col: str = "html", url_col: str = "url", *, min_tokens: int = MIN_TOKENS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The columns of df but for the html, with `main_text`, the main text of each page (blocks joined by line ends), and
    `n_repeated`, the number of its blocks that repeats on other pages of the host cover."""
    names = [f"c{i}" for i in range(len(df.columns))]
    html, url = names[df.columns.index(html_col)], names[df.columns.index(url_col)]
    through = [n for n in names if n != html]
    host = F.xxhash64(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z]+://([^/?#:]*)", 1)), F.col(url).isNull())
    pages = df.toDF(*names).withColumn("host", host).withColumn("hash", F.xxhash64(*names))
    large = pages.groupBy("host").agg(F.sum(F.octet_length(html)).alias("size")).where(F.col("size") > shard_bytes)
    large = large.select("host", F.ceil(F.col("size") / shard_bytes).alias("shards"))
    n_large = large.limit(BROADCAST_HOSTS + 1).count()
    if n_large:
        dealt = pages.join(F.broadcast(large) if n_large <= BROADCAST_HOSTS else large, "host", "left")
        dealt = dealt.withColumn("shard", F.coalesce(F.pmod("hash", "shards"), F.lit(0)).cast("int")).drop("shards")
    else:
        dealt = pages.withColumn("shard", F.lit(0))
    kinds = {n: f.dataType.simpleString() for n, f in zip(names, df.schema.fields, strict=True)}
    own = ["host", "shard", "hash", *through]
    schema = ", ".join(["host bigint", "shard int", "hash bigint", *[f"{n} {kinds[n]}" for n in through], "page bigint, flags binary, blocks array<string>"])

    def read(batches):
        for b in batches:
            for part in slices(b, html):
                found = [parse(h or "") for h in part.column(html).to_pylist()]
                made = [pa.array([_page_digest(f) for f in found], pa.int64()), pa.array([bytes(flag for flag, _ in f) for f in found], pa.binary()), pa.array([[t for _, t in f] for f in found], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in own], *made], [*own, "page", "flags", "blocks"])

    def judge(batches):
        for digests, rows, times in _groups(batches):
            flags, texts = rows.column("flags").to_pylist(), rows.column("blocks").to_pylist()
            distinct = {p: i for i, p in enumerate(rows.column("page").to_pylist())}
            streams = [[t for flag, t in zip(flags[i], texts[i], strict=True) if flag != PROTECTED] for i in distinct.values()]
            covered = dict(zip(distinct, covered_blocks(streams, min_tokens, digests), strict=True))
            out, n = [], []
            for p, own_flags, own_texts in zip(rows.column("page").to_pylist(), flags, texts, strict=True):
                gone = iter(covered[p])
                left = [(flag, t) for flag, t in zip(own_flags, own_texts, strict=True) if flag == PROTECTED or not next(gone)]
                wanted = PROTECTED if PROTECTED in own_flags else OPEN
                out.append("\n".join(t for flag, t in left if flag == wanted))
                n.append(len(own_texts) - len(left))
            done = pa.RecordBatch.from_arrays([*[rows.column(c) for c in through], pa.array(out, pa.string()), pa.array(n, pa.int32())], [*through, "main_text", "n_repeated"])
            for k in range(0, len(times), 256):
                part, often = done.slice(k, 256), times[k : k + 256]
                for again in range(int(often.max())):
                    yield part.filter(pa.array(often > again))

    parsed = dealt.select(*own, html).mapInArrow(read, schema).withColumn("digest", F.lit(None).cast("binary"))
    if n_large:
        parsed = parsed.unionByName(_elsewhere(dealt, html, large, n_large, min_tokens), allowMissingColumns=True)
    met = parsed.withColumn("kind", F.col("digest").isNull()).repartition("host", "shard").sortWithinPartitions("host", "shard", "kind", "hash")
    done = met.mapInArrow(judge, ", ".join([*[f"{n} {kinds[n]}" for n in through], "main_text string, n_repeated int"]))
    out = [F.col(n).alias(c) for n, c in zip(names, df.columns, strict=True) if n != html and c not in ("main_text", "n_repeated")]
    return done.select(*out, "main_text", "n_repeated")


def _elsewhere(dealt: DataFrame, html: str, large: DataFrame, n_large: int, length: int) -> DataFrame:
    """(host, shard, digest): for each shard of the large hosts, the windows that it shares with a distinct page of another shard."""

    def given(batches):
        for b in batches:
            for part in slices(b, html):
                pages = [parse(h or "") for h in part.column(html).to_pylist()]
                sets = [list(set(windows([t for flag, t in f if flag != PROTECTED], length))) if any(flag != PROTECTED for flag, _ in f) else [] for f in pages]
                at = np.repeat(np.arange(part.num_rows), [len(w) for w in sets])
                page = np.array([_page_digest(f) for f in pages], np.int64)
                yield pa.RecordBatch.from_arrays([part.column("host").take(pa.array(at)), part.column("shard").take(pa.array(at)), pa.array(page[at]), pa.array([w for ws in sets for w in ws], pa.binary())], ["host", "shard", "page", "digest"])

    hosts = large.select("host")
    rows = dealt.select("host", "shard", html).join(F.broadcast(hosts) if n_large <= BROADCAST_HOSTS else hosts, "host", "left_semi")
    held = rows.mapInArrow(given, "host bigint, shard int, page bigint, digest binary").groupBy("host", "digest", "shard").agg(F.min("page").alias("low"), F.max("page").alias("high"))
    shards = held.groupBy("host", "digest").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.collect_list("shard").alias("shards"))
    return shards.where((F.col("low") < F.col("high")) & (F.size("shards") > 1)).select("host", F.explode("shards").alias("shard"), "digest")


def _groups(batches):
    """(digests, rows, times) for each shard of rows sorted by host, shard and hash, digests first; rows that are equal in all columns
    stand once, with their number."""
    key, digests, held, times, last = None, set(), [], [], None

    def group():
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()
        return digests, rows[0], np.concatenate(times)

    for b in batches:
        host, shard = b.column("host").to_numpy(), b.column("shard").to_numpy()
        edges = np.flatnonzero((host[1:] != host[:-1]) | (shard[1:] != shard[:-1])) + 1
        for start, stop in zip([0, *edges.tolist()], [*edges.tolist(), b.num_rows], strict=True):
            if start == stop:
                continue
            own = (host[start], shard[start])
            if own != key:
                if held:
                    yield group()
                key, digests, held, times, last = own, set(), [], [], None
            part = b.slice(start, stop - start)
            page = part.column("kind").to_numpy(zero_copy_only=False).astype(bool)
            n_digests = int((~page).sum())
            digests.update(part.column("digest").slice(0, n_digests).to_pylist())
            part = part.slice(n_digests)
            if not part.num_rows:
                continue
            hash_ = part.column("hash").to_numpy()
            new = np.concatenate([[last is None or hash_[0] != last], hash_[1:] != hash_[:-1]])
            at = np.flatnonzero(new)
            count = np.diff(np.append(at, len(hash_)))
            ahead = int(at[0]) if len(at) else len(hash_)
            if ahead:
                times[-1][-1] += ahead
            last = hash_[-1]
            if len(at):
                held.append(part.take(pa.array(at)))
                times.append(count)
    if held:
        yield group()
