"""Each operator against brute force on small tables, and on odd ones."""

import collections
import hashlib
import itertools
import math
import random
import time
import zlib
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallybook.llm import components, html_text, labelled_pages, languages, mixing, packing, simhash, sketches, spans, toxicity, vectors, warc

public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, f0 long, component long, row string, position long, block long, hash long, removed long, unit string"


def words(n, seed):
    draw = random.Random(seed)
    return " ".join("".join(draw.choices("abcdefghij", k=draw.randint(1, 7))) for _ in range(n))


def prose(n, seed):
    draw, out, w = random.Random(seed), [], words(n, seed).split()
    while w:
        k = draw.randint(4, 12)
        out.append(" ".join(w[:k]).capitalize() + ".")
        w = w[k:]
    return " ".join(out)


def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows; columns whose names the operators use themselves."""
    long_text = prose(30_000, 1)
    texts = [(1, prose(120, 2)), (2, prose(120, 2)), (2, prose(120, 2)), (3, None), (4, ""), (5, "  \n "), (6, long_text), (7, long_text + " tail."), (None, prose(50, 3)), (8, prose(50, 3)), (9, "Ünïcödé ß 漢字 \U0001f600 text"), (10, "one"), (11, "12 34 !")]
    return [(i, t, None if i == 3 else "en" if (i or 0) % 2 else "fr", None if i == 4 else f"s{(i or 0) % 2}", None if t is None else len(t), 1, 2, 3, "r", 4, 5, 6, 7, "u") for i, t in texts]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


# Components


def test_components(spark):
    draw = random.Random(5)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(400, 460)] + [(None, 1), (7, None), (9, 9)]
    got = {r["node"]: r["component"] for r in rows(components.components(spark.createDataFrame(edges, "a long, b long")))}
    label = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            label.setdefault(a, a), label.setdefault(b, b)
    moved = True
    while moved:
        moved = False
        for a, b in edges:
            if a in label and b in label and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                moved = True
    assert got == label
    assert rows(components.components(spark.createDataFrame([], "a long, b long"))) == []


# 1 SimHash


def brute_fingerprint(text, width):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + width]), 42) for k in range(max(1, len(w) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_groups(spark):
    base = [words(80, k) for k in range(40)]
    texts = base + [b.replace(b.split()[5], "zz", 1) for b in base[:20]] + base[:3] + ["", "a"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: r for r in rows(simhash.near_duplicates(frame))}
    prints = [brute_fingerprint(t, 4) for t in texts]
    assert [got[k]["f0"] % 2**64 for k in range(len(texts))] == prints
    label = list(range(len(texts)))
    for _ in texts:
        for a, x in enumerate(prints):
            for b, y in enumerate(prints):
                if (x ^ y).bit_count() <= 4:
                    label[a] = label[b] = min(label[a], label[b])
    assert [got[k]["component"] for k in range(len(texts))] == label


def test_bit_planes_find_all_pairs():
    draw = np.random.default_rng(1)
    centers = draw.integers(0, 2**63, (6, 4), dtype=np.uint64)
    prints = np.repeat(centers, 200, axis=0)
    for k in range(len(prints)):
        for _ in range(draw.integers(0, 30)):
            b = draw.integers(0, 256)
            prints[k, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    for side in (np.full(len(prints), 2), (np.arange(len(prints)) % 2).astype(int)):
        order = np.argsort(side, kind="stable")
        p, s = prints[order], side[order]
        a, b, level = simhash.forest(np.zeros(len(p), np.int64), s, p, (20, 44))
        distance = np.bitwise_count(p[a] ^ p[b]).sum(axis=1)
        assert (distance <= level).all() and set(level) == {20, 44}
        near = np.bitwise_count(p[:, None] ^ p[None]).sum(axis=2) <= 44
        if s[0] != 2:
            near &= s[:, None] != s[None]
        label, want = np.arange(len(p)), np.arange(len(p))
        simhash._join(label, a, b)
        simhash._join(want, *np.nonzero(near))
        assert (label == want).all()


def test_simhash_tiles(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 8)
    texts = [words(60, 3).rsplit(" ", 1)[0] + f" w{k}" for k in range(60)] + [words(60, 100 + k) for k in range(10)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: r["component"] for r in rows(simhash.near_duplicates(frame, radius=6))}
    prints = [brute_fingerprint(t, 4) for t in texts]
    label = np.arange(len(texts))
    simhash._join(label, *np.nonzero(np.array([[(x ^ y).bit_count() <= 6 for y in prints] for x in prints])))
    assert [got[k] for k in range(len(texts))] == label.tolist()


@pytest.mark.parametrize("rows_", [10, 10**6, 10**8, 10**11])
def test_exact_masks_lose_no_pair(rows_):
    masks, draw = simhash.exact_masks(4, rows_), random.Random(rows_)
    assert min(m.bit_count() for (m,) in masks) >= min(12, 64)
    assert max(rows_ / 2 ** m.bit_count() for (m,) in masks) < 2 * simhash.TILE
    for _ in range(500):
        x = draw.getrandbits(64)
        y = x
        for b in draw.sample(range(64), 4):
            y ^= 1 << b
        assert any(x & m == y & m for (m,) in masks)


def test_simhash_odd(odd, empty):
    got = rows(simhash.near_duplicates(odd))
    assert len(got) == 13
    by = {(r["id"], r["component"]) for r in got}
    assert {(1, 1), (2, 1), (3, 3), (4, 3), (5, 3), (8, 8), (None, 8)} <= by
    assert rows(simhash.near_duplicates(empty)) == []
    kept = rows(simhash.first_of_each_group(odd))
    assert sorted(r["doc_id"] for r in kept) == [1, 3, 6, 8, 9, 10, 11]
    assert kept[0].keys() == odd_as_dict(odd).keys()
    assert rows(simhash.first_of_each_group(empty)) == []


def test_first_of_each_group_decides_by_row(spark):
    texts = [words(80, k) for k in range(8)]
    near = texts[4] + " zz"
    table = [(1, texts[0]), (None, texts[0]), (None, texts[1]), (None, texts[2]), (None, texts[2]), (2, texts[3]), (2, texts[4]), (3, near), (4, texts[3]), (5, texts[5]), (5, texts[5]), (5, texts[6]), (6, texts[6]), (6, texts[7]), (None, texts[7] + " zz")]
    kept = rows(simhash.first_of_each_group(spark.createDataFrame(table, "doc_id long, text string")))
    want = [(1, texts[0]), (None, texts[1]), (None, texts[2]), (2, texts[3]), (2, texts[4]), (5, texts[5]), (5, texts[6]), (6, texts[7])]
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in kept))) == sorted(map(str, want))


def test_first_of_each_group_against_brute_force(spark):
    """Copies with one word in so many changed: whose shingle sets are similar goes, and no other."""
    draw = random.Random(12)
    texts = []
    for k in range(60):
        base = words(200, 4000 + k).split()
        texts.append(" ".join(base))
        for changes in (1, 2, 3, 4, 5, 6, 8, 12):
            w = base[:]
            for at in draw.sample(range(200), changes):
                w[at] = f"w{draw.randrange(10**6)}"
            texts.append(" ".join(w))
    kept = {r["doc_id"] for r in rows(simhash.first_of_each_group(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))}
    sets = [brute_shingles(t) for t in texts]
    near = [(a, b) for a in range(len(texts)) for b in range(a + 1, min(len(texts), a + 9)) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    label = np.arange(len(texts))
    simhash._join(label, *(np.array(x) for x in zip(*near, strict=True)))
    firsts = set(np.flatnonzero(label == np.arange(len(label))).tolist())
    assert firsts <= kept and len(kept - firsts) <= 0.02 * (len(texts) - len(firsts))


def odd_as_dict(odd):
    return dict.fromkeys(odd.columns)


# 2 Toxicity


def test_toxicity(spark, odd, empty):
    draw = random.Random(4)
    texts = []
    for k in range(400):
        w = words(60, 1000 + k).split()
        toxic = k % 4 == 0
        if toxic:
            w.insert(draw.randrange(60), draw.choice(["zidiot", "zmoron", "zscumly"]))
        texts.append((k, " ".join(w), int(toxic)))
    frame = spark.createDataFrame(texts, "doc_id long, text string, toxic int")
    model = toxicity.train(frame.select("doc_id", "text"), frame.filter("doc_id % 3 <> 1").select("doc_id", "toxic"))
    got = {r["id"]: r for r in rows(toxicity.scored(frame, model))}
    right = sum(got[k]["predicted"] == y for k, _, y in texts if k % 3 == 1)
    assert right / sum(k % 3 == 1 for k in range(400)) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert len(rows(toxicity.scored(odd, model))) == 13 and rows(toxicity.scored(empty, model)) == []
    none = toxicity.train(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["score"] for r in rows(toxicity.scored(odd, none))} == {0.5}


def test_factorization_machine_learns_pairs():
    """Neither term alone tells, both together do."""
    draw = np.random.default_rng(0)
    x = (draw.random((800, 6)) < 0.5).astype(np.float32)
    y = ((x[:, 0] == 1) & (x[:, 1] == 1)).astype(np.float32)
    bias, w, v = toxicity._fit(x, y, np.full(800, 1 / 800, np.float32))
    s = x @ v
    z = bias + x @ w + 0.5 * ((s * s).sum(1) - x @ (v * v).sum(1))
    assert ((z > 0) == (y > 0)).mean() > 0.98


def test_toxicity_of_pairs_alone(spark):
    """No term tells anything alone: a text is toxic if it has one of two words but not both."""
    draw = random.Random(9)
    texts = []
    for k in range(1600):
        w = words(30, 5000 + k).split()
        first, second = bool(k & 1), bool(k & 2)
        for there, word in ((first, "quipped"), (second, "grollian")):
            if there:
                w.insert(draw.randrange(30), word)
        texts.append((k, " ".join(w), int(first != second)))
    frame = spark.createDataFrame(texts, "doc_id long, text string, toxic int")
    model = toxicity.train(frame, frame.filter("doc_id % 3 <> 1").select("doc_id", "toxic"))
    got = {r["id"]: r["score"] for r in rows(toxicity.scored(frame, model))}
    assert sum((got[k] >= 0.5) == y for k, _, y in texts if k % 3 == 1) / sum(k % 3 == 1 for k, _, _ in texts) > 0.9


def test_toxicity_scores_by_brute_force(spark):
    draw = np.random.default_rng(2)
    texts = [words(50, k) for k in range(20)] + ["", None]
    cells = np.unique(np.concatenate([toxicity.terms(t.encode()) for t in texts[:10]]))[::2]
    model = toxicity.Model(cells, -0.3, draw.standard_normal(len(cells)) * 0.2, draw.standard_normal((len(cells), toxicity.RANK)) * 0.2)
    got = {r["id"]: r for r in rows(toxicity.scored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model))}
    place = {c: k for k, c in enumerate(cells.tolist())}
    for k, t in enumerate(texts):
        own = [place[c] for c in toxicity.terms((t or "").encode()).tolist() if c in place]
        z = model.bias + sum(model.weight[a] for a in own) + sum(float(model.factor[a] @ model.factor[b]) for i, a in enumerate(own) for b in own[:i])
        assert abs(got[k]["score"] - 1 / (1 + math.exp(-z))) < 1e-9 and got[k]["predicted"] == (got[k]["score"] >= 0.7)


# 3 Substrings


def test_spans_against_brute_force(spark):
    passage = prose(90, 77)
    texts = [prose(100, k) for k in range(20)]
    texts[3] = texts[3] + " " + passage
    texts[9] = passage + "\n" + texts[9]
    texts[15] = texts[15] + "\n" + passage + "\n" + prose(40, 88)
    got = {r["doc_id"]: r for r in rows(spans.without_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))}
    parts = [spans.sentences(t.encode()) for t in texts]
    seen, gone = {}, collections.defaultdict(set)
    for d, p in enumerate(parts):
        for f in range(len(p)):
            l = f + spans.RUN_SENTENCES - 1
            while l < len(p) and sum(len(p[k][2]) for k in range(f, l + 1)) < spans.RUN_WORDS:
                l += 1
            if l < len(p):
                key = tuple(tuple(p[k][2]) for k in range(f, l + 1))
                if seen.setdefault(key, (d, f)) != (d, f):
                    gone[d].update(range(f, l + 1))
    for d, p in enumerate(parts):
        left = b"".join(texts[d].encode()[b:e] for k, (b, e, _) in enumerate(p) if k not in gone[d])
        assert got[d]["text"].encode() == left and got[d]["n_removed"] == len(gone[d]) and got[d]["n_sentences"] == len(p)
    assert {d for d in gone if gone[d]} == {9, 15}
    assert passage[60:200] not in got[9]["text"] and passage in got[3]["text"]


def test_spans_meet_wherever_a_passage_begins(spark):
    draw, hosts = random.Random(3), [prose(100, 900 + k) for k in range(120)]
    passages = [words(51, 600 + k) for k in range(20)]
    for k in range(20, 40):  # three sentences of 17 to 24 words
        w = words(60, 600 + k).split()
        passages.append(" ".join(w[:20]) + ". " + " ".join(w[20:40]) + ". " + " ".join(w[40:]) + ".")
    texts = []
    for k, p in enumerate(passages):
        w = p.split()
        wrapped = " ".join(w[:7]) + "\n" + " ".join(w[7:22]) + "\n" + " ".join(w[22:])
        for host, form in zip(hosts[3 * k : 3 * k + 3], (p, p, wrapped), strict=True):
            at = draw.choice([i for i in range(100, 300) if host[i] == " "])
            texts.append(host[:at] + " " + form + host[at:])
    got = {r["doc_id"]: r for r in rows(spans.without_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))}
    for d, text in enumerate(texts):
        lost = len(text.split()) - len(got[d]["text"].split())
        assert lost == 0 if d % 3 == 0 else 20 <= lost <= 60, d


def test_spans_odd(odd, empty):
    got = rows(spans.without_repeats(odd))
    assert len(got) == 13
    assert {r["doc_id"] for r in got if r["n_removed"]} == {2, 7, 8}
    assert [r["text"] for r in got if r["doc_id"] == 3] == [None]
    assert rows(spans.without_repeats(empty)) == []
    kept = rows(spans.rid_of_repeats(odd))
    assert 2 not in {r["doc_id"] for r in kept} and {3, 4, 5} <= {r["doc_id"] for r in kept}
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in kept)


@pytest.mark.parametrize("text", ["", " ", "\n\n", "a", "A b. C d! ", "x" * 5000, ("word " * 500), "no end", ". . .", "a.b c.d\ne"])
def test_sentences_cover_the_text(text):
    parts = spans.sentences(text.encode())
    if parts:
        assert parts[-1][1] == len(text.encode())
        assert all(a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False))
    assert sum(len(w) for _, _, w in parts) == len(text.split())


# 4 HTML


@pytest.fixture(scope="module")
def page_model():
    return html_text.train()


def test_main_text(page_model):
    source = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><a href=/>Site</a></header><nav><ul><li><a href="/a">A</a></li></ul></nav>
    <div class="cookie-notice"><p>We use cookies on this page to serve you better every day.</p></div><article><h1>Head &amp; line</h1><p>First   <b>bold</b> paragraph of text,
    long enough to be one.<p>Second &eacute;&#33; one with a <a href='x'>link</a> in it.</p><script>var x = "<p>no</p>";</script><div class="ad">Buy now, it is very cheap today.</div><ul><li>Item one</li><li>Item two</li></ul></article>
    <section id="comments"><div class="comment"><p>I like this article very much, thanks for it.</p></div></section><form><label>Name</label><input><button>Go</button></form><footer>&copy; us</footer></body></html>"""
    assert html_text.main_text(page_model, source) == "Head & line\nFirst bold paragraph of text, long enough to be one.\nSecond é! one with a link in it.\nItem one\nItem two"


def test_page_model_on_held_out_pages(page_model):
    right = every = 0
    for source in labelled_pages.labelled_pages(80, seed=11):
        page = html_text.parse(source)
        for text, y, m in zip(page.text, html_text._labels(page), page_model.marginals(page), strict=True):
            if text is not None:
                right, every = right + ((m >= 0.5) == y), every + 1
    assert right / every > 0.95


def test_marginals_against_enumeration(page_model):
    page = html_text.parse("<body><div class=ad>one two</div><p>a text of some words here</p></body>")
    n, total, on = len(page.parent), 0.0, np.zeros(len(page.parent))
    for state in range(2**n):
        y = [state >> k & 1 for k in range(n)]
        e = sum(page_model.weight[f].sum() * y[k] for k, f in enumerate(map(list, page.features)))
        e += sum(page_model.edge[int(page.text[k] is not None)][y[p]][y[k]] for k, p in enumerate(page.parent) if p >= 0)
        total += np.exp(e)
        on += np.exp(e) * np.array(y)
    assert np.allclose(page_model.marginals(page), on / total)


@pytest.mark.parametrize("source", ["", "<", "<p", "</p></p>", "<p>" * 2000, "text only", "<!-- open", "<script>never closed", "<a href='x>broken</a><p>t", "\x00<b>&#0;&bogus;", "<table><tr><td>x", "<ul><li>a<li>b"])
def test_broken_pages(page_model, source):
    assert isinstance(html_text.main_text(page_model, source), str)


@pytest.mark.parametrize(
    "around",
    [
        "<head><title>x</title>{}",
        "<html><head><meta charset=utf-8><link href=a><script>var x</script>{}",
        "<head><template><p>no</p></template><svg><g></g></svg>{}",
        "<body><div><button>Go</div>{}",
        "<body><div><button><div>Go</div> on</div>{}",
        "<body><div><svg><path d=x></div>{}",
        "<body><svg><path d=x><div>{}",
        "<body><form><select><option>a<option>b</form>{}",
        "<body><section><object><p>no</p><video></section>{}",
    ],
)
def test_unclosed_hidden_elements_end(page_model, around):
    text = "<article><h1>A head line</h1><p>The first paragraph is long enough to be one of the article.</p><p>The second one is about as long as the first, and ends here.</p></article>"
    shown = " ".join(t for t in html_text.parse(around.format(text)).text if t)
    assert shown == "A head line The first paragraph is long enough to be one of the article. The second one is about as long as the first, and ends here."
    assert html_text.main_text(page_model, around.format(text)) == shown.replace("article. The", "article.\nThe").replace("line The", "line\nThe")


@pytest.mark.parametrize("hostile", ["<div>{n}</foo>", "<foo>{n}</bar>", "<p><li>{n}<h1>", "<svg>{n}<g></x>", "<button>{n}<div></x>"])
def test_hostile_pages_take_linear_time(hostile):
    first, second = hostile.split("{n}")
    begin = time.process_time()
    html_text.parse(first * 60_000 + second * 60_000 + "text")
    assert time.process_time() - begin < 10


# Pages of other layouts than the model was fitted on, with their articles.
_STRANGE = [
    (
        "<html><body><div class=top-bar><a href=/>Daily</a> <a href=/w>World</a> <a href=/s>Sport</a></div><center><h1>Rain comes late</h1><p>Farmers in the valley waited six weeks for rain that came on Monday night.<p>By morning the river had risen by a metre and the bridge was closed.</center><hr><small><a href=/a>About</a> | <a href=/c>Contact</a> | <a href=/p>Privacy</a></small></body></html>",
        ["Rain comes late", "Farmers in the valley waited six weeks for rain that came on Monday night.", "By morning the river had risen by a metre and the bridge was closed."],
    ),
    (
        "<body><table width=100%><tr><td class=leftnav><ul><li><a href=1>Home</a><li><a href=2>Archive</a><li><a href=3>Links</a></ul><td><h2>Notes on a mill</h2><p>The mill was built in 1790 and ground corn for three villages around it.</p><blockquote>It never stood still, not even on Sundays, said the last miller.</blockquote><p>Its wheel can be seen in the museum.</p></table><p class=copyright>(c) 1999 all rights reserved</p>",
        ["Notes on a mill", "The mill was built in 1790 and ground corn for three villages around it.", "It never stood still, not even on Sundays, said the last miller.", "Its wheel can be seen in the museum."],
    ),
    (
        "<div id=root><header class='Site__header'><span>Menu</span></header><div class='Layout'><div class='Layout__main'><div class='RichText'><h1>How to prune a pear tree</h1><p>Prune in winter, when the tree is at rest and its form is easy to see.</p><ol><li>Cut out dead wood first.</li><li>Shorten the leaders by a third.</li></ol><p>Burn what is diseased.</p></div></div><aside class='Layout__rail'><h4>Related</h4><a href=/x>Apple trees</a><a href=/y>Plum trees</a></aside></div><div class='CookieBanner'>We store cookies on your device. <button>Accept</button></div></div>",
        ["How to prune a pear tree", "Prune in winter, when the tree is at rest and its form is easy to see.", "Cut out dead wood first.", "Shorten the leaders by a third.", "Burn what is diseased."],
    ),
]


def test_pages_of_other_layouts(page_model):
    right = every = 0
    for source, article in _STRANGE:
        for text, marginal in html_text.blocks(page_model, source):
            right, every = right + ((marginal >= 0.5) == (text in article)), every + 1
    assert every > 20 and right / every >= 0.85


def test_very_long_and_deep_pages(spark, page_model):
    long_page = "<article>" + "<p>A sentence of the article that goes on for some words.</p>" * 30_000 + "</article>"
    deep = "<div>" * 20_000 + "<p>One text of the deepest element, of some words.</p>"
    got = rows(html_text.extracted(spark.createDataFrame([(1, "u", long_page), (2, "u", deep)], "page_id long, url string, html string"), page_model))
    assert {r["page_id"]: r["text"].count("\n") for r in got} == {1: 29_999, 2: 0}


def test_hidden_elements_stay_hidden():
    shown = [t for t in html_text.parse("<head>\n<title>x</title></head><div><button><div>no</div> no</button>yes<svg><foreignObject><p>no</p></foreignObject><text>no</text></svg></div>").text if t]
    assert shown == ["yes"]
    assert [t for t in html_text.parse("<head><title>x</title>Bare text").text if t] == ["Bare text"]


def test_html_odd(spark, page_model):
    frame = spark.createDataFrame([(1, None, None, "x"), (None, "u", "<article><p>Some text of the article.</p></article>", "x"), (1, None, "", "y")], "page_id long, url string, html string, text string")
    got = rows(html_text.extracted(frame, page_model))
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in got) == [(0, "Some text of the article.", 25), (1, "", 0), (1, "", 0)]
    assert rows(html_text.extracted(frame.limit(0), page_model)) == []


# 5 Embeddings


def brute_links(vectors_, labels, threshold=0.93):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) and l is not None for v, l in zip(vectors_, labels, strict=True)]
    near = np.zeros((len(ok), len(ok)), bool)
    for a in range(len(ok)):
        for b in range(len(ok)):
            if a != b and ok[a] and ok[b] and labels[a] == labels[b] and len(vectors_[a]) == len(vectors_[b]):
                x, y = np.array(vectors_[a], np.float64), np.array(vectors_[b], np.float64)
                near[a, b] = x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold
    return near


def test_embeddings(spark):
    draw = np.random.default_rng(3)
    data = []
    for c in range(12):
        center = draw.standard_normal(16)
        for _ in range(60 if c == 0 else 6):
            data.append((center + draw.standard_normal(16) * (0.05 if c % 2 else 0.12) * np.linalg.norm(center) / 4).astype(np.float32).tolist())
    data += [data[0], data[0], None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [float("inf")] * 16, data[1][:8]]
    labels = [k % 2 if k > 70 else 1 for k in range(len(data))]
    labels[5] = None
    frame = spark.createDataFrame([(k, v, l, "x") for k, (v, l) in enumerate(zip(data, labels, strict=True))], "vec_id long, embedding array<float>, label int, component_id string")
    got = {r["vec_id"]: r for r in rows(vectors.linked(frame))}
    near = brute_links(data, labels)
    label = np.arange(len(data))
    simhash._join(label, *np.nonzero(near))
    assert [got[k]["n_links"] for k in range(len(data))] == near.sum(axis=1).tolist()
    assert [got[k]["component_id"] for k in range(len(data))] == label.tolist()
    assert [got[k]["kept"] for k in range(len(data))] == (label == np.arange(len(data))).tolist()
    assert rows(vectors.linked(frame.limit(0))) == []


def test_embeddings_fall_back_to_the_exact_way(spark, monkeypatch):
    """A descent that finds nothing, null and repeated ids: the audit notices, and all links are found."""
    monkeypatch.setattr(vectors, "WIDE_TILE", 40)
    monkeypatch.setattr(vectors, "_first_lists", lambda nodes, *_: nodes.limit(0).select(F.col("rep").alias("node"), F.col("rep").alias("nbr"), F.lit(0.0).alias("sim"), F.lit(True).alias("link")))
    draw = np.random.default_rng(8)
    data = [(c + 0.1 * draw.standard_normal(8)).astype(np.float32).tolist() for c in draw.standard_normal((12, 8)) * 2 for _ in range(10)]
    ids = [*range(len(data) - 2), None, 5]
    frame = spark.createDataFrame([(i, v, 1) for i, v in zip(ids, data, strict=True)], "vec_id long, embedding array<float>, label int")
    got = rows(vectors.linked(frame))
    near = brute_links(data, [None if i is None else 1 for i in ids])
    assert len(got) == len(data) and [(r["n_links"], r["component_id"], r["kept"]) for r in got if r["vec_id"] is None] == [(0, None, False)]
    by = {r["vec_id"]: r for r in got}
    label = np.arange(len(data))
    near[5, -1] = near[-1, 5] = True  # one id, one component
    simhash._join(label, *np.nonzero(near))
    want = near.sum(axis=1)
    assert all(by[k]["n_links"] == want[k] for k in range(len(data) - 2) if k != 5)
    assert [by[k]["component_id"] for k in range(len(data) - 2)] == label[:-2].tolist()


# 6 Mixing


@pytest.mark.parametrize(
    "weights,n",
    [
        ({"a": 0.31, "b": 0.2, "c": 0.07}, {"a": 500, "b": 40, "c": 7, None: 1000}),
        ({"a": 0.5004, "b": 0.4996}, {"a": 6000, "b": 6000}),
        ({"a": 1e-5, "b": 0.3333, "c": 0.66669}, {"a": 2, "b": 3333, "c": 6667}),
        (None, {"a": 4000, "b": 3, "c": 900, None: 77}),
    ],
)
def test_schedule_keeps_to_the_target_weights(spark, weights, n):
    """Less than one block from the given weights, over up to 10,000 blocks, and every block within its window."""
    counts = spark.createDataFrame([("-" if k is None else f"={k}", v) for k, v in n.items()], "key string, n long")
    slots = sorted(rows(mixing.schedule(mixing.weighed(counts, weights), block=1)), key=lambda r: r["slot"])
    assert [r["slot"] for r in slots] == list(range(slots[0]["span"]))
    given = {f"={k}": Fraction(str(w)) for k, w in weights.items()} if weights else {("-" if k is None else f"={k}"): Fraction(round(v**0.5 * mixing.UNIT)) for k, v in n.items()}
    if weights and None in n:
        given["-"] = sum(given.values()) / len(given)
    total = sum(given.values())
    done = collections.Counter()
    for t, r in enumerate(slots[:10_000]):
        w = given[r["key"]] / total
        assert r["turn"] == done[r["key"]] and math.floor(r["turn"] / w) <= t < math.ceil((r["turn"] + 1) / w)
        done[r["key"]] += 1
        assert all(abs(done[k] - x * (t + 1) / total) < 1 for k, x in given.items())


def test_mixture_by_brute_force(spark, monkeypatch):
    """Stretches shorter than the schedule, a schedule that repeats, and sources that end."""
    monkeypatch.setattr(mixing, "STRETCH", 7)
    docs = [(k, "big" if k % 3 else None if k % 5 else "tiny") for k in range(1500)]
    got = rows(mixing.mixed(spark.createDataFrame(docs, "doc_id long, source string"), {"big": 0.5, "tiny": 0.25}, block=8))
    whole = {"big": 4, "tiny": 2, None: 3}  # a source without a weight has the mean
    keys, own = sorted(whole, key=lambda s: "-" if s is None else f"={s}"), collections.defaultdict(list)
    for i, s in sorted(docs, key=lambda d: (hashlib.md5(str(d[0]).encode()).hexdigest(), d[0])):
        own[s].append(i)
    done, want, t = collections.Counter(), [], 0
    while len(want) < len(docs):
        ready = [(-(-(done[s] + 1) * 9 // whole[s]), k) for k, s in enumerate(keys) if done[s] * 9 // whole[s] <= t]
        s = keys[min(ready)[1]]
        want += [(i, s, done[s], t, len(want) + k) for k, i in enumerate(own[s][8 * done[s] : 8 * done[s] + 8])]
        done[s] += 1
        t += 1
    assert sorted((r["doc_id"], r["source"], r["block"], r["slot"], r["position"]) for r in got) == sorted(want)


def test_weights_are_held_exactly():
    assert mixing.whole_weights({"a": 0.5, "b": 0.3, "c": 0.2}) == ({"a": 15, "b": 9, "c": 6}, 10)
    whole, mean = mixing.whole_weights({"a": 1 / 3, "b": 1.2345678901234567e-19, "c": 7e12})
    assert sum(whole.values()) + mean <= 1 << 60 and whole["b"] == 1
    with pytest.raises(ValueError):
        mixing.whole_weights({"a": 0.0})


def test_mixing_odd(odd, empty):
    got = rows(mixing.mixed(odd))
    assert sorted(r["position"] for r in got) == list(range(13))
    assert rows(mixing.mixed(empty)) == []
    stored = mixing.in_mixed_order(odd)
    assert stored.columns == odd.columns and stored.count() == 13
    assert mixing.in_mixed_order(empty).count() == 0


# 7 Languages


def test_languages(spark, odd, empty):
    letters = {"xa": "abcdefgh", "xb": "mnopqrst", "xc": "ghijklmn"}

    def text(lang, n, seed):
        draw = random.Random(seed)
        return " ".join("".join(draw.choices(letters[lang], k=draw.randint(2, 8))) for _ in range(n))

    docs = [(k, text(lang, 60, k), lang) for k, lang in enumerate(list(letters) * 30)]
    model = languages.train(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    asked = [(1000, text("xb", 20, 5000), "xb"), (1001, text("xa", 90, 5001) + " " + text("xb", 30, 5002), "xa"), (1002, "12 .", "und"), (1003, None, "und")]
    got = {r["id"]: r for r in rows(languages.identified(spark.createDataFrame(asked, "doc_id long, text string, lang string"), model))}
    assert [got[i]["lang_pred"] for i, _, _ in asked] == [lang for _, _, lang in asked]
    assert 0.6 < got[1001]["score"] < 0.9 and set(got[1001]["mixture"]) == {"xa", "xb"}
    assert got[1000]["score"] > 0.9
    assert got[1003]["score"] == 0.0
    assert len(rows(languages.identified(odd, model))) == 13 and rows(languages.identified(empty, model)) == []
    nothing = languages.train(empty)
    assert {r["lang_pred"] for r in rows(languages.identified(odd, nothing))} == {"und"}
    assert languages.accepted(odd, model).columns == odd.columns


def test_language_mixtures_by_brute_force():
    """Proportions and the chosen set against plain loops over all sets, for texts of one to four languages and noise."""
    draw = np.random.default_rng(6)
    likelihood = draw.dirichlet(np.full(1 << languages.TABLE_BITS, 0.002), 5).T + 1e-9
    model = languages.Model(list("abcde"), (likelihood / likelihood.sum(axis=0)).astype(np.float32))
    pieces = [" ".join("".join(draw.choice(list("abcdefghijklmnop"), 5)) for _ in range(40)) for _ in range(5)]
    for k, p in enumerate(pieces):  # each language knows the grams of its piece
        cells, n = languages.grams(p.encode())
        model.likelihood[cells, k] += n / n.sum()
    model = languages.Model(model.languages, model.likelihood / model.likelihood.sum(axis=0))
    for own in ((0,), (1, 3), (0, 2, 4), (0, 1, 2, 3), ()):
        text = " ".join([*(pieces[k] for k in own), " ".join("".join(draw.choice(list("qrstuvwxyz"), 6)) for _ in range(12))]).encode()
        cells, n = languages.grams(text)
        rows_ = [[*model.likelihood[c].tolist(), 1 / (1 << languages.TABLE_BITS)] for c in cells]
        best = None
        for chosen in (c for size in range(1, 6) for c in itertools.combinations(range(5), size)):
            share = [1 / (len(chosen) + 1)] * (len(chosen) + 1)
            for _ in range(60):
                sums = [0.0] * len(share)
                for row, m in zip(rows_, n, strict=True):
                    parts = [s * row[c] for s, c in zip(share, (*chosen, 5), strict=True)]
                    whole = sum(parts)
                    for j, x in enumerate(parts):
                        sums[j] += m * x / whole
                share = [x / n.sum() for x in sums]
            fit = sum(m * math.log(sum(s * row[c] for s, c in zip(share, (*chosen, 5), strict=True))) for row, m in zip(rows_, n, strict=True))
            value = fit - languages.PENALTY * len(chosen) * math.log(1 + n.sum())
            if best is None or value > best[0]:
                best = (value, chosen, share)
        lang, score, found = languages.infer(model, text)
        assert set(found) == {model.languages[c] for c in best[1]} or not own
        assert own == () or all(abs(found[model.languages[c]] - s) < 0.01 for c, s in zip(best[1], best[2], strict=False))
        assert score < 0.2 if not own else abs(score - max(best[2][:-1])) < 0.01


@pytest.mark.parametrize("text", ["", " ", "12 34 !", "\u00bd \u00b2 \u2460 \u2167", "\u0301", "_-_"])
def test_texts_without_letters(text):
    model = languages.Model(["a"], np.full((1 << languages.TABLE_BITS, 1), 1 / (1 << languages.TABLE_BITS), np.float32))
    assert languages.infer(model, text.encode()) == ("und", 0.0, {})
    assert not len(toxicity.terms(text.encode()))


# 8 WARC


def test_warc_round_trip(spark, tmp_path):
    same = "<p>" + "x" * 200 + "</p>"
    data = [(3, "http://a/3", same), (1, "http://a/1", same), (2, None, "short"), (4, "http://a/4", "short"), (5, "http://b/é\r\nX: y", None), (6, "u", ""), (1, "http://a/1", same), (None, "n", same), (7, "v", "WARC/1.1\r\n\r\ntrap\r\n\r\n" * 9)]
    frame = spark.createDataFrame([(*r, "x") for r in data], "page_id long, url string, html string, digest string")
    archive = warc.write(frame)
    assert archive.payloads.count() == len({r[2] or "" for r in data})
    got = sorted(rows(warc.read_back(archive)), key=lambda r: (r["page_id"] is None, r["page_id"] or 0))
    assert [(r["page_id"], r["record_type"], r["refers_to"]) for r in got] == [(1, "response", None), (1, "response", None), (2, "response", None), (3, "revisit", 1), (4, "response", None), (5, "response", None), (6, "response", None), (7, "response", None), (None, "revisit", 1)]
    assert all(r["payload_digest"] == hashlib.sha256(next((h or "") for i, _, h in data if i == r["page_id"]).encode()).hexdigest() for r in got)
    assert sorted(bytes(r["payload"]).decode() for r in rows(warc.records(archive))) == sorted(h or "" for _, _, h in data)
    for compression, ending in (("none", "*.txt"), ("gzip", "*.gz")):
        warc.export(archive, str(tmp_path / compression), compression, 2)
        read = rows(warc.scan(spark, str(tmp_path / compression / ending)))
        assert len(read) == len(data)
        assert all(hashlib.sha256(r["payload"]).hexdigest() == r["payload_digest"] for r in read if r["record_type"] == "response")
        assert {r["refers_to"] for r in read if r["record_type"] == "revisit"} == {r["record_id"] for r in read if r["record_id"].startswith("<urn:page:1:")}
    broken = warc.Archive(archive.payloads.withColumn("payload", F.concat("payload", F.lit(b"x"))), archive.headers)
    with pytest.raises(Exception, match="not as its header says"):
        rows(warc.read_back(broken))
    very_long = spark.createDataFrame([(k, "u", "<p>" + "long " * 400_000 + "</p>") for k in (2, 1)], "page_id long, url string, html string")
    assert [(r["record_type"], r["payload_bytes"], r["refers_to"]) for r in sorted(rows(warc.read_back(warc.write(very_long))), key=lambda r: r["page_id"])] == [("response", 2_000_007, None), ("revisit", 2_000_007, 1)]
    assert rows(warc.read_back(warc.write(frame.limit(0)))) == []


# 9 Packing


def brute_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    return [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in texts]


def check_pack(pieces, ids, window):
    lengths = collections.Counter()
    for r in pieces:
        lengths[r["sequence_id"]] = max(lengths[r["sequence_id"]], r["offset"] + r["length"])
    assert sum(r["length"] for r in pieces) == sum(map(len, ids)) == sum(lengths.values())
    assert sorted(lengths) == list(range(len(lengths)))
    assert all(n == window or n & (n - 1) == 0 for n in lengths.values())
    for sequence in lengths:
        at = 0
        for r in sorted((r for r in pieces if r["sequence_id"] == sequence), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]


def test_packing(spark, tmp_path):
    texts = [words(k % 50 * 7, k) + ("!? 12,5 Élan's" if k % 3 else "") for k in range(120)] + [None, "", "don't ΑΣ x\x1cy <|endoftext|>", words(9000, 9)]
    ids = brute_ids(texts)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5).write.parquet(str(tmp_path / "d"))
    pieces = rows(packing.pack(spark.read.parquet(str(tmp_path / "d")), TOKENIZER, 256))
    check_pack(pieces, ids, 256)
    for r in pieces:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert np.frombuffer(r["ids"], "<u4").tolist() == part and r["doc_tokens"] == len(ids[r["doc_id"]])
    summed = {(r["doc_id"], r["start"]): r["ids_crc32"] for r in rows(packing.with_checksums(packing.pack(spark.read.parquet(str(tmp_path / "d")), TOKENIZER, 256)))}
    assert all(summed[(r["doc_id"], r["start"])] == zlib.crc32(r["ids"]) for r in pieces)


def test_packing_odd(odd, empty):
    pieces = rows(packing.pack(odd, TOKENIZER))
    check_pack(pieces, brute_ids([r[1] for r in odd_rows()]), 4096)
    assert rows(packing.pack(empty, TOKENIZER)) == []


# 10 Sketches


def brute_shingles(text, width=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


def test_sketches(spark):
    texts = {k: words(random.Random(k).randint(0, 400), k) for k in range(60)} | {100: None, 101: "", 102: "ß漢\U0001f600 x", 103: words(300, 5)}
    got = {r["doc_id"]: r for r in rows(sketches.edited_neighbours(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)))}
    order = sorted(texts, reverse=True)
    off = []
    for k, i in enumerate(order):
        t, nxt = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[i]["n_chars"] == len(t)
        for column, other in (("near_edited", edited), ("near_next", nxt)):
            a, b = brute_shingles(t), brute_shingles(other)
            off.append(abs(got[i][column] - (len(a & b) / len(a | b) if a | b else 1.0)))
    assert np.mean(off) < 0.03 and max(off) < 0.25
    assert got[103]["fingerprint"] == sketches.to_string(sketches.sketch(texts[103].encode()))


def test_sketch_estimates_and_merges(spark):
    a, b = words(3000, 1).encode(), words(3000, 2).encode()
    both = a + b" " + b
    assert np.isin(sketches.merged([sketches.sketch(a), sketches.sketch(b)]), sketches.sketch(both)).mean() > 0.95
    assert abs(sketches.distinct_shingles(sketches.sketch(a)) / len(brute_shingles(a.decode())) - 1) < 0.3
    assert abs(sketches.containment(sketches.sketch(a), sketches.sketch(both)) - 1) < 0.25
    assert (sketches.from_string(sketches.to_string(sketches.sketch(a))) == sketches.sketch(a)).all()
    prints = sketches.sketched(spark.createDataFrame([(k, words(200, k), "g" if k % 3 else None) for k in range(30)], "doc_id long, text string, source string"))
    grouped = rows(sketches.group_sketches(prints.withColumn("g", F.when(F.col("id") % 3 != 0, "g")), "g"))
    want = {g: sketches.to_string(sketches.merged([sketches.sketch(words(200, k).encode()) for k in range(30) if bool(k % 3) == (g == "g")])) for g in ("g", None)}
    assert {r["group"]: r["fingerprint"] for r in grouped} == want


def test_sketches_odd(odd, empty):
    got = rows(sketches.edited_neighbours(odd))
    assert len(got) == 13 and {r["doc_id"] for r in got} == {*range(1, 12), None}
    assert rows(sketches.edited_neighbours(empty)) == []
    one = rows(sketches.edited_neighbours(odd.filter("doc_id = 1")))
    assert len(one) == 1 and one[0]["near_next"] == 1.0
