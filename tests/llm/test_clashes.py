"""Columns that bear the operators' own names, links behind refused proposals, and urls that look like header lines."""

import random

import numpy as np

import corpus_pipeline
from tallybook.llm import simhash, spans, warc

OWN = "_id _row _marks _key _text1 _text2 _n _cut _mix_id _mix_source _mix_position _mix_copy document marks n cut id row own_id own_row rep first level bucket component position copy own_copy key f0 place h1".split()


def clashing(spark, texts):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in OWN)
    rows = [(k, t, "en", "ab"[k % 2], len(t), *(f"{c}{k}" for c in OWN)) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, schema), rows


def prose(n, seed):
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdefghij") for _ in range(draw.randrange(2, 9))) for _ in range(n))


def test_stages_keep_columns_of_any_name(spark):
    passage = prose(90, 1)
    texts = [prose(80, k) for k in range(10, 20)] + [prose(40, 2) + " " + passage, passage + " " + prose(40, 3)]
    docs, given = clashing(spark, [*texts, texts[0]])
    kept = sorted(map(tuple, simhash.first_of_each_group(docs).collect()))
    assert kept == given[:-1]
    cut = spans.without_repeats(docs)
    assert cut.columns == [*docs.columns, "n_sentences", "n_removed", "removed"]
    assert sorted(tuple(r)[2:-3] for r in cut.collect()) == sorted(g[2:] for g in given)
    assert {r.doc_id for r in cut.filter("n_removed > 0").collect()} == {11, 12}
    mixed = corpus_pipeline.mix_sources(spark, docs, "")
    assert mixed.columns == docs.columns and sorted(map(tuple, mixed.collect())) == sorted(given)
    twice = corpus_pipeline.mix_sources(spark, docs.union(docs), "")
    assert sorted(map(tuple, twice.collect())) == sorted(given + given)


def test_no_link_is_lost_behind_a_refused_one(spark):
    """Triples in which A is like neither B nor D by the measure, but near both, and B and D are alike: one of B and D goes."""
    texts = []
    for t in range(60):
        words = prose(224, 1000 + t).split()
        places = [20, 60, 100, 140, 180]
        b, d = list(words), list(words)
        for k, p in enumerate(places):
            b[p] = f"b{t}x{k}"
            d[p] = b[p] if k == 0 else f"d{t}x{k}"
        texts += [" ".join(words), " ".join(b), " ".join(d)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in simhash.first_of_each_group(docs).collect()}
    assert all(3 * t in kept and 3 * t + 1 in kept for t in range(60))
    # One pair in fifty shares no bucket.
    assert sum(3 * t + 2 in kept for t in range(60)) <= 4


def nearly_similar(n, seed):
    """Texts that are all near, but unlike, by four words each has for itself, and at the end for every fourth one a text that is like it alone."""
    draw, base, out, twins = random.Random(seed), prose(224, seed).split(), [], []
    for k in range(n):
        own = list(base)
        for j, p in enumerate(draw.sample(range(5, 220, 6), 4)):
            own[p] = f"x{seed}y{k}z{j}"
        out.append(own)
    draw = random.Random(seed)
    for k in range(0, n, 4):
        own = list(out[k])
        for j, p in enumerate(draw.sample(range(2, 220, 6), 4)):
            own[p] = f"t{seed}y{k}z{j}"
        twins.append(own)
    return [" ".join(w) for w in out + twins]


def groups_of(sets, least):
    label = np.arange(len(sets))
    near = [(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])]
    simhash._join(label, *(np.array(x) for x in zip(*near, strict=True)))
    return label.tolist()


def test_no_link_is_lost_behind_very_many_refused_ones(spark, monkeypatch):
    """However many unlike pairs stand before a similar one, also where a group of proposals is cut into tiles."""
    monkeypatch.setattr(simhash, "SET_ROWS", 100, raising=False)
    texts = nearly_similar(200, 7)
    kept = {r.doc_id for r in simhash.first_of_each_group(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    runs = [[tuple(w[k : k + 5]) for k in range(len(w) - 4)] for w in map(str.split, texts)]
    label = groups_of([set(r) for r in runs], 0.8)
    assert sum(label[k] != k for k in range(len(texts))) >= 50
    assert kept == {k for k in range(len(texts)) if label[k] == k}


def test_sets_of_a_unit_are_grouped_as_by_all_similar_pairs():
    draw = random.Random(3)
    sets = [set(), set(), {1}]
    for size in (3, 10, 60, 400, 9000):
        for _ in range(6):
            base = [draw.randrange(2**32) for _ in range(size)]
            sets += [{x if draw.random() > share else draw.randrange(2**32) for x in base} for share in (0, 0.03, 0.05, 0.1, 0.12, 0.2)]
    draw.shuffle(sets)
    label = groups_of(sets, 0.8)
    arrays = [np.array(sorted(s), "<u4") for s in sets]
    n, half = len(sets), len(sets) // 2
    for joined in (np.arange(n) + 5, np.array([k if draw.random() < 0.5 else label[k] for k in range(n)])):
        got = np.arange(n)
        links = simhash.alike_forest(np.full(n, 2), arrays, joined)
        links += [(k, int(np.flatnonzero(joined == joined[k])[0])) for k in range(n)]
        simhash._join(got, *np.array(links).T)
        assert got.tolist() == label
    # Two tiles and what is between them.
    got, side = np.arange(n), (np.arange(n) >= half).astype(int)
    links = simhash.alike_forest(side, arrays, np.arange(n))
    assert all(a < half <= b for a, b in links)
    links += simhash.alike_forest(np.full(half, 2), arrays[:half], np.arange(half))
    links += [(half + a, half + b) for a, b in simhash.alike_forest(np.full(n - half, 2), arrays[half:], np.arange(n - half))]
    simhash._join(got, *np.array(links).T)
    assert got.tolist() == label


def test_urls_cannot_forge_header_fields(spark):
    urls = ["http://a/ WARC-Payload-Digest: x", "http://a/\u0085WARC-Refers-To: <urn:page:7:sha256:0>", "http://a/ WARC-Type: revisit", "http://a/\r\nWARC-Type: revisit\r\n\r\n", "", None, "http://a/WARC-Type: revisit"]
    html = "x" * 150 + " WARC-Type: response\r\n\r\nWARC/1.1\r\n"
    pages = spark.createDataFrame([(k, u, html if k < 6 else None) for k, u in enumerate(urls)] + [(90, "http://long", "y" * 2_000_000)], "page_id long, url string, html string")
    got = sorted(map(tuple, warc.read_back(warc.write(pages)).select("page_id", "record_type", "refers_to").collect()))
    assert got == [(0, "response", None), *((k, "revisit", 0) for k in range(1, 6)), (6, "response", None), (90, "response", None)]
