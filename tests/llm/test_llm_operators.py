"""Operators against brute force, exact round trips, and their edge cases."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from platewright.llm import ann, bpe, html_extract, jaccard_join, packing, pii, quality, token_counts, url_filter, webp

HARD = ["", None, "a", "  a  b\n\nc", "it's they'LL", "x" * 3000 + "ab" * 400, "\x1c a\x1fb \x85c d", "漢字 é ́😀 1²½", "a a a", "a a a"]


def docs(spark, texts, extra=False):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return df.withColumns({c: F.lit("x") for c in ("quality", "n_tokens", "base", "spans", "media")}) if extra else df


def test_bpe_equals_tiktoken(spark):
    import tiktoken

    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in bpe.round_trip(docs(spark, HARD, True), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect():
        ids = enc.encode_ordinary(HARD[r.doc_id] or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((HARD[r.doc_id] or "").encode()).hexdigest()
    assert bpe.round_trip(docs(spark, HARD).limit(0), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == 0


def test_token_spans_and_boundary_rule():
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    full = Tokenizer.from_file(path)
    spans = token_counts.Spans(open(path, encoding="utf-8").read(), P.PATTERN)
    for t in HARD:
        a, b, n = spans([t])
        assert list(zip(a.tolist(), b.tolist(), strict=True)) == full.encode(t or "", add_special_tokens=False).offsets and n[0] == len(a)
    low, high = np.array([0, 4, 8]), np.array([4, 8, 10])
    got, crossing = token_counts.attribute(np.array([0, 3, 2, 1, 10]), np.array([3, 5, 7, 12, 12]), low, high)
    assert got.tolist() == [0, 0, 1, 1, -1] and crossing == 3


def test_packing(spark):
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = HARD + ["wort " * n for n in (10, 2047, 2048, 5000)]
    rows = packing.pack_documents(docs(spark, texts, True), P.path("word_bpe_49k.json")).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.start, r.length))
    for i, t in enumerate(texts):
        n = len(full.encode(t or "", add_special_tokens=False).ids) + 1
        pieces = sorted(by[i])
        assert [s for s, _ in pieces] == [sum(x for _, x in pieces[:k]) for k in range(len(pieces))] and sum(x for _, x in pieces) == n
    seq = {}
    for r in rows:
        seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in seq.values():
        p.sort()
        assert sum(n for _, n in p) <= 2048 and all(o == sum(n for _, n in p[:k]) for k, (o, _) in enumerate(p))


def test_best_fit_is_the_tightest():
    rng = np.random.default_rng(3)
    sizes = np.sort(rng.integers(1, 50, 300))[::-1]
    where, _ = packing.best_fit_decreasing(sizes, 64)
    room = []
    for n, w in zip(sizes.tolist(), where.tolist(), strict=True):
        fitting = [r for r in room if r >= n]
        if fitting:
            assert room[w] == min(fitting)
        else:
            assert w == len(room)
            room.append(64)
        room[w] -= n


EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base_spans(t):
    out = []
    for k, rx in enumerate((EMAIL, IP, CARD, PHONE)):
        for m in rx.finditer(t):
            d = re.sub("[^0-9]", "", m[0])
            total = sum(sum(divmod(int(c) * (2 if i % 2 else 1), 10)) for i, c in enumerate(reversed(d)))
            if [True, k != 1 or all(int(x) < 256 for x in m[0].split(".")), 12 <= len(d) <= 19 and total % 10 == 0, 9 <= len(d) <= 15][k]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii_base_spans(spark):
    texts = HARD + ["a@b.c%d@e.f.g", "1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.255", "x" * 20000 + "@", "1" * 9000, "+1 (743) 555-3824 +1---- +12345678901234567890", "😀a@b.co 😀 4111 1111 1111 1111 é+33 1 23 45 67 89", "a.b@c.d " * 600, "1.1.1.1@x.y 4111111111111111.1.1.1"]
    for r in pii.find(docs(spark, texts, True)).collect():
        assert [(m.start, m.k, m.end) for m in r.base] == base_spans(texts[r.doc_id] or "")
    out = {r.doc_id: r.text for r in pii.redact(docs(spark, ["x a@b.co y", None, "no"])).collect()}
    assert out == {0: "x [EMAIL] y", 1: None, 2: "no"}


def brute_components(rows, k, percent):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    least = {d: d for d in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(least[a], least[b])
            if (least[a], least[b]) != (m, m):
                least[a] = least[b] = m
                changed = True
    return {d: (len(sets[d]), least[d]) for d in sets}


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (3, 70)])
def test_jaccard_components(spark, monkeypatch, k, percent):
    monkeypatch.setattr(jaccard_join, "REGION", 8)  # so that regions are split and dealt in tiles
    monkeypatch.setattr(jaccard_join, "PER_PIVOT", 4)
    monkeypatch.setattr(jaccard_join.tiles, "__defaults__", (4,))
    rng, rows = random.Random(5), []
    for _ in range(2):
        words = [f"w{rng.randrange(400)}" for _ in range(80)]
        for _ in range(40):
            copy = list(words)
            for _ in range(rng.randrange(9)):
                copy[rng.randrange(80)] = f"w{rng.randrange(400)}"
            rows.append((len(rows), " ".join(copy)))
    rows += [(1000, None), (1001, ""), (1003, "a b"), (1004, "A b"), (1005, "a b c"), (1006, "x " * 500), (1007, "x " * 400)]
    got = jaccard_join.components(spark.createDataFrame(rows, "doc_id long, text string"), k, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, k, percent)


@pytest.mark.parametrize("percent", [80, 90])
def test_jaccard_shared_passages(spark, monkeypatch, percent):
    """Passages of many documents come last in the order of counts: they join no blocks, and no link is lost."""
    edges, plain = [], jaccard_join.candidate_edges

    def counted(*args):
        out = plain(*args)
        edges.append(out.distinct().count())
        return out

    monkeypatch.setattr(jaccard_join, "REGION", 8)
    monkeypatch.setattr(jaccard_join, "candidate_edges", counted)
    rng, rows = random.Random(9), []
    draw = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    passages = [draw(60) for _ in range(3)]
    for _ in range(60):
        words = draw(rng.randrange(5, 60)) + rng.choice(passages) + draw(rng.randrange(3))
        for _ in range(rng.choice([1, 1, 3])):
            copy = list(words)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = f"w{rng.randrange(5000)}"
            rows.append((len(rows), " ".join(copy)))
    got = jaccard_join.components(spark.createDataFrame(rows, "doc_id long, text string"), 5, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, 5, percent)
    assert edges[0] < 2 * len(rows)


def near_copies(rng, n, length, edits, vocabulary=4000):
    words = [f"w{rng.randrange(vocabulary)}" for _ in range(length)]
    for _ in range(n):
        copy = list(words)
        for _ in range(rng.randrange(edits + 1)):
            copy[rng.randrange(length)] = f"w{rng.randrange(vocabulary)}"
        yield " ".join(copy)


@pytest.mark.parametrize(("percent", "edits"), [(90, 5), (80, 12), (60, 30)])
def test_jaccard_region_in_a_task(percent, edits):
    """Pivots, windows and recursion of one region find the links of brute force; pivots save comparisons."""
    rng = random.Random(percent)
    texts = [t for n in (1, 1, 3, 30, 60) for t in near_copies(rng, n, 100, edits, 400)]
    shingle = jaccard_join.Shingler(3)
    region = jaccard_join.Region(np.arange(len(texts)), [shingle(t) for t in texts], percent)
    every = np.ones(len(texts), bool)
    edges = dict(region.edges(every, every, every))
    assert {i: edges.get(i, i) for i in range(len(texts))} == {d: c for d, (_, c) in brute_components(list(enumerate(texts)), 3, percent).items()}
    if percent == 90:
        assert region.compared < len(texts) ** 2 and region.visits


def test_jaccard_spark_splits(spark, monkeypatch):
    """A block of more than REGION sets is split by Spark's pivots; their links join the result."""
    moved, plain = [], jaccard_join.split

    def counted(*args):
        out = plain(*args)
        moved.append(out.where("near and u <> pivot").count())
        return out

    monkeypatch.setattr(jaccard_join, "REGION", 16)
    monkeypatch.setattr(jaccard_join, "PER_PIVOT", 4)
    monkeypatch.setattr(jaccard_join, "split", counted)
    rng = random.Random(2)
    rows = list(enumerate(t for _ in range(3) for t in near_copies(rng, 40, 80, 3)))
    got = jaccard_join.components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, 3, 80)
    assert moved and sum(moved) > 60


def test_jaccard_edge_cases(spark):
    text, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [(5, text), (5, text), (5, other), (7, text + " x"), (9, other + " y"), (None, text), (11, None), (12, ""), (13, "solo run of words here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("node", "node_", "component", "u", "block", "id", "_gone", "key")})
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard_join.components(df).collect())
    assert got == sorted([(False, 5, 56, 5)] * 3 + [(False, 7, 57, 5), (False, 9, 57, 5), (True, 0, 56, None), (False, 11, 0, 11), (False, 12, 0, 12), (False, 13, 1, 13)])
    kept = jaccard_join.deduplicate(df)
    assert kept.columns == df.columns
    # an id's two texts are two documents; both stay, with their repeated rows
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted([(False, 5, text)] * 2 + [(False, 5, other), (True, 0, text), (False, 11, ""), (False, 12, ""), (False, 13, "solo run of words here")])
    for limit in (0, 1):
        assert jaccard_join.components(df.limit(limit)).count() == jaccard_join.deduplicate(df.limit(limit)).count() == limit


def test_jaccard_leaves_one_table(spark):
    import os

    from platewright.llm import _shared

    folder = _shared.shared_dir(spark)
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    rows = list(enumerate(near_copies(random.Random(3), 12, 60, 2)))
    jaccard_join.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    left = set(os.listdir(folder)) - before
    assert len(left) == 1 and next(iter(left)).startswith("components-")


def test_components_with_a_hub(spark):
    from platewright.llm import components as cc

    edges = [(i, 0) for i in range(1, 3000)] + [(i, i + 1) for i in range(5000, 5040)] + [(7000, 2999)]
    got = {r.node: r.component for r in cc.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 3000)}, 7000: 0, **{i: 5000 for i in range(5001, 5041)}}


def test_webp_round_trip():
    rng = np.random.default_rng(1)
    payloads = [webp.payload_of(t)[1] for t in [*HARD, "aaa" * 9000, "".join(map(chr, rng.integers(1, 2000, 3000)))]]
    files = webp.write_media(payloads)
    assert [p.tobytes() for p in webp.read_media(files)] == payloads
    assert all(webp.decode_webp(f)[..., :3].tobytes() == p for f, p in zip(files, payloads, strict=True))


def webp_file(w, h, write):
    out = webp.BitWriter()
    for v, n in ((0x2F, 8), (w - 1, 14), (h - 1, 14), (1, 1), (0, 3)):
        out.write(v, n)
    write(out)
    data = out.data()
    return b"RIFF" + (12 + len(data)).to_bytes(4, "little") + b"WEBPVP8L" + len(data).to_bytes(4, "little") + data


def plain_image(out, pixels, main):
    """Literal pixels with eight bits a channel."""
    out.write(0, 1)
    if main:
        out.write(0, 1)
    flat = np.full(256, 8)
    green = np.append(flat, np.zeros(24, int))
    for code in (green, flat, flat, flat):
        webp.write_code(out, code)
    webp.write_code(out, np.bincount([0], minlength=40))
    codes = webp.canonical(flat)
    for p in pixels:
        for shift in (8, 16, 0, 24):
            out.write(codes[(int(p) >> shift) & 255], 8)


def test_webp_predictor_cross_colour_and_palette():
    rng = np.random.default_rng(2)
    w, h, tile = 21, 13, 3
    pixels = rng.integers(0, 1 << 32, w * h).astype(np.int64)
    modes, factors = rng.integers(0, 14, 6), rng.integers(0, 1 << 24, 6)

    def write(out):
        crossed = webp.add_cross_colour(webp.add_predictions(pixels, w, modes, tile, -1), w, factors, tile, -1)
        for kind, image in ((0, modes << 8), (1, factors)):
            out.write(1, 1), out.write(kind, 2), out.write(tile - 2, 3)
            plain_image(out, image, False)
        out.write(0, 1)
        plain_image(out, crossed, True)

    got = webp.decode_webp(webp_file(w, h, write)).reshape(-1, 4)
    assert (got == webp.channels(pixels)[:, [1, 2, 3, 0]]).all()
    for colours in (2, 4, 11, 100):
        palette = rng.integers(0, 1 << 32, colours).astype(np.int64)
        index, bundle = rng.integers(0, colours, w * h).reshape(h, w), webp.bundling(colours)

        def write_palette(out, palette=palette, index=index, bundle=bundle):
            out.write(1, 1), out.write(3, 2), out.write(len(palette) - 1, 8)
            steps = webp.channels(palette)
            plain_image(out, webp.joined(np.diff(steps, axis=0, prepend=0)), False)
            out.write(0, 1)
            each, wide = 8 >> bundle, -(-w >> bundle)
            held = np.zeros((h, wide << bundle), np.int64)
            held[:, :w] = index
            packed = (held.reshape(h, wide, -1) << (each * np.arange(1 << bundle))).sum(2)
            plain_image(out, packed.reshape(-1) << 8, True)

        got = webp.decode_webp(webp_file(w, h, write_palette)).reshape(-1, 4)
        assert (got == webp.channels(palette[index.reshape(-1)])[:, [1, 2, 3, 0]]).all()


def test_nearest(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(300, 16)).astype(np.float32)
    v[50:90] = v[0]  # ties
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(400, None), (450, [0.0] * 16), (401, [float("nan")] * 16), (402, [None] * 16), (403, [float("inf")] * 16), (404, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(r.query_id, r["rank"]): r.vec_id for r in ann.nearest(df, F.col("vec_id") % 50 == 0).collect()}
    for q in range(0, 300, 50):
        score = ann.cosines(np.repeat(v[[q]], 300, 0).astype(float), v.astype(float))
        best = [int(i) for i in np.lexsort((np.arange(300), -score)) if i != q][:5]
        assert [got[q, k] for k in range(1, 6)] == best
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0


def test_nearest_within_each_dimension(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=4 + 2 * (i % 3 == 0)).tolist()) for i in range(60)] + [(100, [1.0] * 9)]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    want = {}
    for q in (0, 50):
        v = np.array(rows[q][1])
        others = [(-float(v @ np.array(x)) / np.linalg.norm(v) / np.linalg.norm(x), i) for i, x in rows if len(x) == len(v) and i != q]
        want[q] = list(enumerate((i for _, i in sorted(others)[:5]), 1))
    assert {q: sorted(r) for q, r in got.items()} == want


def test_html(spark):
    page = "<html><head><title>t</title><script>var a='</p>'</script></head><body><nav><a>m</a></nav><div class=ad>x</div>{}<footer>f</footer></body>"
    rows = [(i, "http://h.example/x", page.format(f"<div><p>same widget</p></div><section><p>text&nbsp;{i} &amp; more<br><p>two {i} \n words</section>")) for i in range(8)]
    rows += [(100, None, None), (101, "http://o.example", ""), (102, "http://o.example", page.format("<article><h1>A</h1><p>b</article><p>out"))]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "text 3 & more\ntwo 3 words" and got[100] == got[101] == "" and got[102] == "A\nb"


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "{}"])
def test_html_copies_are_one_page(spark, wrap):
    """Copies, alone on a host or a third of it, keep their text; what different pages share still goes."""
    bodies = {"div": "<div><p>first</p>second</div>", "section": "<section><p>first</p><p>second</p></section>", "ul": "<ul><li>first</li><li>second</li></ul>"}
    page = "<html><body><div>shared block</div>" + wrap + "</body></html>"
    rows = []
    for host, body in bodies.items():
        for share in (0, 16):
            rows += [(f"{host}{share}", page.format(body)) for _ in range(8)]
            rows += [(f"{host}{share}", page.format(f"<div><p>text {i}</p></div>")) for i in range(share)]
    df = spark.createDataFrame([(i, f"http://{h}.example/{i}", t) for i, (h, t) in enumerate(rows)], "page_id long, url string, html string")
    for r in html_extract.extract(df).collect():
        host, html = rows[r.page_id]
        alone = "shared block\n" if wrap == "{}" and not host.endswith("16") else ""
        assert r.text == alone + ("first\nsecond" if "first" in html else re.search("text [0-9]+", html)[0])


@pytest.mark.parametrize("deep", [500, 20000])
def test_html_deep_nesting(deep):
    inner = "deep<nav>menu</nav><section class=comments><p>comment</p></section><p hidden>hidden</p><p>text</p>"
    page = "<body><div><article>" + "<div>" * deep + inner + "</div>" * deep + "<p>rest</p></article></div><p>out</p></body>"
    assert html_extract.main_text(page, set()) == "deep\ntext\nrest"
    assert html_extract.main_text(page, {1}) == "deep\ntext\nrest"
    # the deepest div is template: the article's other text stays
    shared = set(html_extract.subtrees("<div>deep<p>text</p></div>")[0])
    own = "<body><article>" + "<b>" * deep + "<div>deep<p>text</p></div>" + "</b>" * deep + "<p>rest</p></article></body>"
    assert html_extract.main_text(own, shared) == "rest"


def test_quality(spark):
    rng = random.Random(1)
    good = [" ".join(rng.choice("the of a in house river walks slowly under green trees and".split()) for _ in range(60)) + "." for _ in range(60)]
    bad = ["BUY!! NOW!! CHEAP!! " * 20] * 8 + ["a%%% b&&& c$$$ " * 20] * 8
    keep = {r.doc_id: r.keep for r in quality.classify(docs(spark, good + bad + [None, ""], True)).collect()}
    assert all(keep[i] for i in range(60)) and not any(keep[i] for i in range(60, 78))


def test_quality_reads_whole_runs():
    """Two texts without blanks that differ only behind character 64 have different features."""
    same = "漢字,かな、" * 20
    one, other = (quality.describe(quality.Words(), same + end)[1].tolist() for end in ("終わり。", "<a=1>{b;}"))
    assert one != other
    assert quality.shape("a1" * 40 + "B") == "a0" * 40 + "A" and quality.shape("x" * 5000) == "aa"


def test_url_filter(spark):
    e = spark.createDataFrame([("l", "domain", "b.com", "added", 10), ("l", "domain", "b.com", "added", 12), ("l", "domain", "b.com", "removed", 20), ("l", "prefix", "c.com/x/", "added", 5), ("l", "host", "d.com", "removed", 1)], "list string, kind string, pattern string, action string, at long")
    c = spark.createDataFrame([(1, "http://a.b.com/", 10), (2, "http://a.b.com/", 20), (3, "http://b.com.org/", 15), (4, "https://C.com:80/x/y?z", 6), (5, "http://d.com/", 9), (6, None, 9), (7, "http://a.b.com/", None), (1, "http://a.b.com/", 10)], "id long, url string, fetched long").withColumn("lists", F.lit("old"))
    got = url_filter.check(c, e).collect()
    assert len(got) == 8 and {r.id for r in got if r.blocked} == {1, 4}


def test_quality_of_texts_at_a_time():
    """Votes of many texts at a time are those of each alone, whatever blanks part its words and however few it has."""
    rng = random.Random(5)
    words = ["the", "The", "USA", "wow!!", "%%$$", "--", "a1b", "house,", "\U0001f600", "x", "HÄUSER", "naïve."]
    texts = [None, "", " \n", "one", "one one", "one\x1cone \x85two\xa0\u2003two", *(rng.choice([" ", "  ", "\n", "\x1f", "\x1d "]).join(rng.choices(words[: rng.randint(1, 12)], k=rng.randint(1, 90))) for _ in range(400))]
    want = [quality.pattern_of(quality.describe(quality.Words(), t)[0]) for t in texts]
    assert quality.patterns(quality.Words(), texts).tolist() == want and len(set(want)) > 20
    assert all(quality.solid(t or "") == quality.SOLID.findall(t or "") for t in texts)
    assert quality.patterns(quality.Words(), []).tolist() == []
