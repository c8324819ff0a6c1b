import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import sentencepiece

from rivulet.llm import html_text, sentencepieces, tiff
from rivulet.llm.queries import MODEL


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("tile", [None, (16, 32)])
def test_tiff_round_trip(compression, order, tile):
    rng = np.random.default_rng(0)
    pages = [rng.integers(0, 4, (70, 37), dtype=np.uint8), rng.integers(0, 256, (5, 64, 3), dtype=np.uint8), np.zeros((300, 1), np.uint8)]
    data = tiff.write(pages, compression=compression, order=order, tile=tile, strip_rows=32)
    back = list(tiff.pages(data))
    assert [p.number for p in back] == [0, 1, 2]
    for p, q in zip(pages, back, strict=True):
        assert (q.samples.squeeze(-1) if p.ndim == 2 else q.samples).tolist() == p.tolist()


def test_codecs():
    rng = random.Random(1)
    for n in (0, 1, 2, 127, 128, 129, 5000, 40000):
        raw = bytes(rng.choice(b"aaab\x00") for _ in range(n))
        assert tiff.packbits_decode(tiff.packbits_encode(raw)) == raw and tiff.lzw_decode(tiff.lzw_encode(raw)) == raw


def test_media_columns(spark):
    texts = ["", None, "a", "é" * 64, "x" * 63, "x" * 64, "long " * 400_000, "a"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "text", "coalesce(octet_length(text), 0) as n_bytes")
    media = tiff.encode(df)
    out = {r["id"]: r for r in tiff.digests(media).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (out[i]["n_bytes"], out[i]["payload_bytes"], out[i]["payload_sha256"], out[i]["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert out[2]["media_sha256"] == out[7]["media_sha256"] and out[2]["feature"] == out[7]["feature"]
    pages = tiff.read_pages(media.where("doc_id = 6"), "doc_id").collect()
    assert [p["page"] for p in sorted(pages, key=lambda p: p["page"])] == list(range(len(pages))) and len(pages) == 2
    huge = tiff._directory("<", [(tiff.TAG_WIDTH, 4, [1 << 20]), (tiff.TAG_LENGTH, 4, [1 << 20]), (tiff.TAG_BITS, 3, [8]), (tiff.TAG_STRIP_OFFSETS, 4, [8]), (tiff.TAG_STRIP_COUNTS, 4, [8])], 8, False)
    huge = b"II*\0\x08\0\0\0" + huge
    cut_off = tiff.stored(tiff.pad(b"x" * 5000))[:100]
    bad = spark.createDataFrame([(1, b"nothing"), (2, None), (3, huge), (4, cut_off), (5, b"")], "doc_id long, media binary")
    assert [(r["id"], r["page"]) for r in tiff.read_pages(bad).collect()] == [(1, -1), (3, -1), (4, -1)]
    rows = {r["id"]: r for r in tiff.digests(bad.selectExpr("*", "1 as n_bytes")).collect()}
    assert rows[2]["media_bytes"] is None and all(rows[i]["payload_bytes"] is None and rows[i]["feature"].startswith("error") for i in (1, 3, 4, 5))
    clash = df.selectExpr("doc_id", "text", "n_bytes", "1 as media", "2 as c1")
    assert tiff.encode(clash).columns == ["doc_id", "text", "n_bytes", "c1", "media"]
    assert tiff.digests(tiff.encode(df.limit(0))).count() == tiff.read_pages(media.limit(0)).count() == 0


def test_all_forms_of_storage_are_dealt_and_strips_stay_bounded():
    forms = set()
    for k in range(200):
        payload = tiff.pad(f"text {k}".encode() * (k + 1))
        data = tiff.stored(payload)
        (page,) = tiff.pages(data)
        assert page.samples.tobytes() == payload
        forms.add((page.compression, tiff.TAG_TILE_OFFSETS in tiff._fields(data, "<", 8)[0]))
    assert len(forms) == len(tiff.FORMS)
    bomb = zlib.compress(bytes(50_000_000))
    assert len(tiff.inflate(bomb, 1000)) == 1000 and len(tiff.packbits_decode(bytes((129, 7)) * 10**6, 1000)) < 1200
    assert len(tiff.lzw_decode(tiff.lzw_encode(bytes(10**6)), 1000)) < 6000


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head><body><nav><ul><li>menu</li></ul></nav>
<div class="ad">buy</div><aside>side</aside><article><header>top</header><h1>Head &amp; more</h1><p>One
 two&nbsp;three<br>four<p>Five <b>bold</b>, <i>six</i></p><!-- no --><ul><li>A<li>B</ul><div class="comments"><p>rude</p></div><form><p>name</p></form></article><footer>&copy;</footer></body>"""


def test_main_text_of_a_page():
    marked, blocks = html_text.blocks(PAGE)
    assert marked and blocks == ["Head & more", "One two three four", "Five bold, six", "A", "B"]
    assert html_text.blocks("") == (False, []) and html_text.blocks("a < b <p>c") == (False, ["a < b", "c"])


def test_suffix_array_finds_repeats_across_pages():
    rng = np.random.default_rng(2)
    for _ in range(20):
        tokens, page = rng.integers(0, 3, 200), np.repeat(np.arange(4), 50)
        tokens[49::50] = [-1, -2, -3, -4]
        order = html_text.suffix_array(tokens)
        assert order.tolist() == sorted(range(200), key=lambda i: tokens[i:].tolist())
        got = html_text.repeated(tokens, page, 5)
        seen = {}
        for i in range(196):
            seen.setdefault(tuple(tokens[i : i + 5]), set()).add(page[i])
        want = np.zeros(200, bool)
        for i in range(196):
            if len(seen[tuple(tokens[i : i + 5])]) > 1:
                want[i : i + 5] = True
        assert (got == want).all()


def test_extraction_of_rows(spark):
    shared = "one two three four five six seven"
    rows = [(1, "http://a.com/1", PAGE), (2, "http://b.com/1", f"<p>{shared}</p><p>own text {1}</p>"), (3, "http://b.com/2", f"<p>{shared}</p><p>other text</p>"), (4, None, None), (5, "http://b.com/3", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["main_text"] for r in html_text.extract(df).collect()}
    assert got == {1: "Head & more\nOne two three four\nFive bold, six\nA\nB", 2: "own text 1", 3: "other text", 4: "", 5: ""}
    assert html_text.extract(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def model():
    return sentencepieces.read_model(open(MODEL, "rb").read())


TEXTS = ["", " ", "  a  b ", "\n\n x\ty ", "日本語 😀🤖 x", "a" * 700, "ééé   ", " lead", "trail  ", "x y\r\n", "The quick brown fox", "1234567890 !!??", "é​"]


def test_ids_are_those_of_the_library(model):
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("ab éz\n▁.T😀") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts += ["".join(rng.choice("theanior") for _ in range(n)) for n in (47, 48, 49, 700)]  # rounds, and the heap
    assert [x.tolist() for x in model.encode(texts, sentencepieces.BPE)] == lib.encode(texts)
    for t in TEXTS:
        assert model.decode(model.encode([t])[0]) == t and model.decode(model.encode([t], sentencepieces.BPE)[0]) == t


def test_viterbi_is_the_best_sum(model):
    score = {p: s for p, s, k in zip(model.pieces, model.scores, model.kinds, strict=True) if k == sentencepieces.NORMAL}
    low = float(model.scores.min()) - 10
    rng = random.Random(2)
    for _ in range(60):
        w = "▁" + "".join(rng.choice("theanior😀") for _ in range(rng.randint(0, 9)))
        best = [0.0] + [-1e18] * len(w)
        for e in range(1, len(w) + 1):
            for a in range(e):
                s = score.get(w[a:e], low if e - a == 1 else None)
                if s is not None:
                    best[e] = max(best[e], best[a] + s)
        ids = model.encode_cut([[w]], (sentencepieces.UNIGRAM,))[0][0]
        total = sum(model.scores[i] for i in ids if model.kinds[i] == sentencepieces.NORMAL) + low * w.count("😀") * (0 if "😀" in score else 1)
        assert total == pytest.approx(best[-1])


def test_words_that_come_again_are_not_encoded_again(monkeypatch):
    model = sentencepieces.read_model(open(MODEL, "rb").read())
    asked, plain = [], model.encode_words
    monkeypatch.setattr(model, "encode_words", lambda words, algorithms: asked.extend(words) or plain(words, algorithms))
    monkeypatch.setattr(sentencepieces, "REMEMBERED", 4)
    slices = [["▁the", f"▁w{k}", f"▁x{k}", "▁long" * 20] for k in range(6)]
    got = [model.encode_cut([ws], (sentencepieces.UNIGRAM, sentencepieces.BPE)) for ws in slices]
    assert asked.count("▁the") == 1 and all(len(x) <= 4 for x in model.seen.values())
    fresh = sentencepieces.read_model(open(MODEL, "rb").read())
    assert [[x[0].tolist() for x in g] for g in got] == [[fresh.encode_cut([ws], (a,))[0][0].tolist() for a in (sentencepieces.UNIGRAM, sentencepieces.BPE)] for ws in slices]


def test_pieces_that_share_a_slot_are_found(model):
    slots = model.keys >> sentencepieces._SLOT_SHIFT
    assert model.crowd == max(np.unique(slots, return_counts=True)[1]) > 1
    assert model.probe(model.keys[None, :])[0].tolist() == model.key_ids.tolist()
    assert model.probe(model.keys ^ np.uint64(1)).max() == -1


def test_token_columns(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate([*TEXTS, None])], "doc_id long, text string, row int")
    out = sentencepieces.decode(sentencepieces.encode(df, MODEL), MODEL).collect()
    assert {r["doc_id"]: r["decoded"] for r in out} == {i: t or "" for i, t in enumerate([*TEXTS, None])}
    assert all(r["same"] for r in sentencepieces.summary(df, MODEL).collect())
    clash = df.selectExpr("doc_id", "text", "1 as ids", "2 as decoded", "3 as c0", "4 as m0", "5 as `a.b`")
    both = sentencepieces.decode(sentencepieces.encode(clash, MODEL), MODEL)
    assert both.columns == ["doc_id", "text", "c0", "m0", "a.b", "ids", "decoded"]
    assert {r["doc_id"]: r["decoded"] for r in both.collect()} == {i: t or "" for i, t in enumerate([*TEXTS, None])}
    for f in (sentencepieces.encode, sentencepieces.summary):
        assert f(df.limit(0), MODEL).count() == 0


def test_very_long_words(model):
    rng = random.Random(4)
    for n in (5_000, 40_000):
        word = "".join(rng.choice("abcd01é😀") for _ in range(n))
        for algorithm in (sentencepieces.UNIGRAM, sentencepieces.BPE):
            assert model.decode(model.encode([word], algorithm)[0]) == word


def test_a_model_without_byte_pieces(model):
    pieces = ["<unk>", "a", "b", "ab", "▁"]
    few = sentencepieces.Model(pieces, np.array([0.0, -2.0, -2.0, -1.0, -1.0]), np.array([2, 1, 1, 1, 1]), sentencepieces.UNIGRAM)
    assert few.encode(["abba x", None])[0].tolist() == [4, 3, 2, 1, 4, 0] and few.encode([None])[0].tolist() == []
    assert few.decode(np.array([4, 3, 2, 1, 4, 0])) == "abba  ⁇ "


def test_classes_name_parts_by_whole_tokens_only():
    for c in ("has-sidebar", "layout-with-sidebar", "no-comments", "page-header-fixed", "social-history", "content-sidebar-wrap"):
        assert html_text.blocks(f'<div class="x {c}"><p>kept</p></div>') == (False, ["kept"]), c
        assert html_text.blocks(f'<div id="{c}"><article><p>kept</p></article></div>') == (True, ["kept"]), c
    for c in ("ad", "site-header", "sidebar_left", "main-nav", "comments-list", "cookie-banner", "ad-1"):
        assert html_text.blocks(f'<div class="x {c}"><p>gone</p></div><p>kept</p>') == (False, ["kept"]), c


def test_named_wrappers_never_drop_the_article():
    assert html_text.blocks('<div class="sidebar"><p>a</p><main><p>b</p><div class="ad">c</div></main></div>') == (True, ["b"])
    assert html_text.blocks('<div class="header"><p>a</p><article>b</article></div><p>c</p>') == (True, ["b"])
    assert html_text.blocks('<article>b<div class="comments"><article>rude</article></div></article><div class="related"><article>c</article></div>') == (True, ["b"])
    assert html_text.blocks('<p>b</p><div class="comments"><article class="comment-body">rude</article></div>') == (False, ["b"])
    assert html_text.blocks('<aside class="x"><article>c</article></aside><p>b</p>') == (False, ["b"])


def test_repeats_are_found_across_the_shards_of_a_host(spark):
    rng = random.Random(5)
    rows = []
    for i in range(600):  # two shards of the default size
        page = [f"own{i} " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(9))]
        page += ["menu one two three four five six"] if i % 3 == 0 else []
        page += [f"rare{i // 2} notice on two pages only, of a host"] if i < 60 else []
        rows.append((i, "http://big.com/x", "".join(f"<p>{b}</p>" for b in page)))
    rows += [(600, "http://big.com/x", rows[0][2]), (601, "http://other.com/x", "<p>menu one two three four five six</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["main_text"] for r in html_text.extract(df).collect()}
    want = {i: h[3 : h.index("</p>")] for i, _, h in rows}
    assert got == want
    assert {r["page_id"]: r["main_text"] for r in html_text.extract(df, shard_bytes=4000).collect()} == want


def plain_extract(rows, length=6):
    """main_text and n_repeated by page id, from all windows of all pages of a host."""
    parsed, holders = {}, {}
    for i, url, page in rows:
        host = re.match(r"[A-Za-z]+://([^/?#:]*)", url or "")
        found = html_text.parse(page or "")
        parsed[i] = (host[1].lower() if host else url is None, found)
        words = [w for flag, t in found if flag != html_text.PROTECTED for w in t.split(" ")]
        for k in range(len(words) - length + 1):
            holders.setdefault((parsed[i][0], *words[k : k + length]), set()).add(tuple(found))
    out = {}
    for i, (host, found) in parsed.items():
        words = [w for flag, t in found if flag != html_text.PROTECTED for w in t.split(" ")]
        gone = [False] * len(words)
        for k in range(len(words) - length + 1):
            if len(holders[(host, *words[k : k + length])]) > 1:
                gone[k : k + length] = [True] * length
        at, kept, n = 0, [], 0
        for flag, t in found:
            if flag == html_text.PROTECTED:
                kept.append((flag, t))
                continue
            size = len(t.split(" "))
            if all(gone[at : at + size]):
                n += 1
            else:
                kept.append((flag, t))
            at += size
        wanted = html_text.PROTECTED if any(flag == html_text.PROTECTED for flag, _ in found) else html_text.OPEN
        out[i] = ("\n".join(t for flag, t in kept if flag == wanted), n)
    return out


def test_the_whole_query_matches_all_windows(spark):
    rng = random.Random(8)
    rows = []
    menus = [" ".join(f"m{rng.randrange(40)}" for _ in range(rng.randint(3, 12))) for _ in range(12)]
    for i in range(250):
        body = [f"<p>{' '.join(f'w{rng.randrange(300)}' for _ in range(rng.randint(1, 30)))}</p>" for _ in range(rng.randint(0, 4))]
        body.insert(0, f"<{rng.choice(['div', 'nav', 'div class=ad', 'footer'])}>{rng.choice(menus)}</div></nav></footer>")
        body.append(f"<p>{rng.choice(menus)} {rng.choice(menus)}</p>")
        page = "".join(body)
        if rng.random() < 0.4:
            page = f"<div>{rng.choice(menus)}</div><article>{page}</article><footer>{rng.choice(menus)}</footer>"
        rows.append((i, rng.choice(["http://A.com/x", "https://a.com", "http://b.org?q", "nothing", None]), rng.choice([page] * 9 + [None, "", "  <p> "])))
    rows += [(250 + k, rows[k][1], rows[k][2]) for k in range(40)]  # copies under other ids
    want = plain_extract(rows)
    assert sum(n for _, n in want.values()) > 100
    df = spark.createDataFrame([*rows, *rows[:30], *rows[:30]], "page_id long, url string, html string")
    for how in ({}, {"shard_bytes": 3000}, {"shard_bytes": 700}):
        out = html_text.extract(df, **how).collect()
        assert len(out) == len(rows) + 60
        assert all((r["main_text"], r["n_repeated"]) == want[r["page_id"]] for r in out), how


def test_given_pages_match_all_windows(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = plain_extract([(r["page_id"], r["url"], r["html"]) for r in pages.collect()])
    out = html_text.extract(pages.selectExpr("*", "1 as main_text", "2 as c0", "3 as host", "4 as hash"))
    assert out.columns == ["page_id", "url", "c0", "host", "hash", "main_text", "n_repeated"]
    assert {r["page_id"]: (r["main_text"], r["n_repeated"]) for r in out.collect()} == want
    long = spark.createDataFrame([(1, "http://a.b/", "<p>" + "w " * 400_000 + "</p>"), (2, "http://a.b/", "<div>" * 3000 + "x")], "page_id long, url string, html string")
    assert {r["page_id"]: len(r["main_text"]) for r in html_text.extract(long).collect()} == {1: 799_999, 2: 1}
