"""Scanners, automata, boxes, weighted texts and phases against plain accounts of their rules."""

import datetime
import json
import math
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from tallybook.functions import colour, gs1, terms, text
from tallybook.operators import boxes, customs, descriptions, linkage, phases, storage
from tallybook.plans import structure_queries as queries
from tallybook.plans.registry import frame

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain_date(v):
    if len(v) != 6 or not v.isdigit():
        return None
    year = 2000 + int(v[:2]) - (100 if int(v[:2]) > 44 else 0)
    try:
        if v[4:] == "00":
            first = datetime.date(year, int(v[2:4]), 1)
            return str((first + datetime.timedelta(days=31)).replace(day=1) - datetime.timedelta(days=1))
        return str(datetime.date(year, int(v[2:4]), int(v[4:])))
    except ValueError:
        return None


def plain_scan(s):
    """One position after another, by the rules that ``gs1.read`` states."""
    ai, fields, pos = {**gs1.FIXED, **gs1.UP_TO}, [], 0

    def identifier(at):
        return next((s[at : at + n] for n in (4, 3, 2) if s[at : at + n] in ai), None)

    while pos < len(s):
        if s[pos] == "\x1d":
            pos += 1
            continue
        key = identifier(pos)
        if key is None:
            return fields, ["unknown:" + s[pos : pos + 4]]
        pos += len(key)
        end = min(len(s), pos + ai[key])
        step = end
        if key in gs1.UP_TO:
            separator = s.find("\x1d", pos, pos + ai[key])
            if separator >= 0:
                end, step = separator, separator + 1
            else:
                for at in range(pos + 1, end + 1):
                    nexts = [s[at : at + n] for n in (4, 3, 2) if s[at : at + n] in ai]
                    if any(k in gs1.UP_TO or len(s) - at - len(k) >= ai[k] for k in nexts):
                        end = step = at
                        break
        fields.append((key, s[pos:end]))
        pos = step
    return fields, []


@pytest.mark.parametrize("seed", [1, 2])
def test_scanner_against_one_step_at_a_time(spark, seed):
    draw = random.Random(seed)
    pieces = ["01", "05901234123457", "17", "310510", "260230", "10", "LOT", "A1", "\x1d", "21", "37", "8", "240", "310", "99", "0", "ü", " ", "400", "713"]
    codes = ["".join(draw.choice(pieces) for _ in range(draw.randrange(0, 12))) for _ in range(400)]
    rows = spark.createDataFrame([(k, c) for k, c in enumerate(codes)], "k int, c string").select("k", gs1.read(F.col("c"), F.lit("2024-06-30").cast("date")).alias("r")).collect()
    for k, r in rows:
        fields, errors = plain_scan(codes[k].replace(" ", ""))
        dates = {v: plain_date(v) for a, v in fields if a in gs1.DATES}
        assert [(f.ai, f.value) for f in r.fields] == fields, codes[k]
        assert [f.parsed for f in r.fields] == [dates.get(v) or v if a in gs1.DATES else v for a, v in fields]
        assert [e for e in r.errors if e != "gtin"] == errors + ["date:" + a for a, v in fields if a in gs1.DATES and dates[v] is None]
        assert r.missing == [m for m in gs1.MANDATORY if m not in [a for a, _ in fields]]


def test_bracketed_and_mixed_codes(spark):
    cases = {
        "(01)05901234123457(17)301231(10)LOT5": ([("01", "05901234123457"), ("17", "301231"), ("10", "LOT5")], True, []),
        "(01)05901234123450(17)301231(10)LOT5": ([("01", "05901234123450"), ("17", "301231"), ("10", "LOT5")], False, ["gtin"]),
        "(17)31051010LOTA": ([("17", "310510"), ("10", "LOTA")], None, []),
        "(10)ABC17310510": ([("10", "ABC"), ("17", "310510")], None, []),
        "(01)0590 1234 123457(99)1": ([("01", "05901234123457")], True, ["unknown:99"]),
        "(10)(17)260200": ([("10", ""), ("17", "260200")], None, []),
        "()": ([], None, []),
    }
    rows = spark.createDataFrame([(c,) for c in cases], "c string").select("c", gs1.read(F.col("c"), F.lit("2024-06-30").cast("date")).alias("r")).collect()
    for c, r in rows:
        assert ([(f.ai, f.value) for f in r.fields], r.gtin_valid, r.errors) == cases[c], c


def test_barcode_fixture_has_every_way(spark):
    got = queries.t23(spark, DATA).toPandas()
    assert len(got) == got["id"].nunique() and got["errors"].str.contains("unknown:99").any() and got["errors"].str.contains("date:17").any() and got["serial"].notna().any()
    codes = {r.id: r.code for r in frame(spark, DATA, queries.BARCODES).collect()}
    for r in got[got["id"] % 12 == 2].itertuples():
        assert r.lot == codes[r.id].split("\x1d")[0][18:]


def plain_replaced(pairs, text):
    out, at = "", 0
    while at < len(text):
        best = max((t for t, _ in pairs if t and text.startswith(t, at)), key=len, default=None)
        out += text[at] if best is None else min(o for t, o in pairs if t == best)
        at += 1 if best is None else len(best)
    return out


def test_terms_in_one_pass_by_brute_force(spark):
    draw = random.Random(4)
    pairs = [("".join(draw.choice("abcü") for _ in range(draw.randrange(0, 5))), draw.choice(["", "a", "abc", "<ab>"])) for _ in range(25)]
    texts = ["".join(draw.choice("abcü ") for _ in range(draw.randrange(0, 60))) for _ in range(200)] + ["", None, "abc" * 50_000]
    dictionary = spark.createDataFrame([*pairs, (None, "x"), ("a", None)], "term string, translation string")
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", terms.translated(F.col("t"), dictionary).alias("t")).collect()
    for k, t in got:
        assert t == (None if texts[k] is None else plain_replaced(pairs, texts[k]))
    same = spark.createDataFrame([("abc",)], "t string").select(terms.translated(F.col("t"), dictionary.limit(0)).alias("t"))
    assert same.first().t == "abc"
    with pytest.MonkeyPatch.context() as patch, pytest.raises(ValueError, match="holds at most"):
        patch.setattr(terms, "MOST_CHARACTERS", 3)
        terms.translated(F.col("t"), dictionary)


def test_terms_of_pages():
    found = terms.automaton([("cat", "dog"), ("dog", "cat"), ("title", "TITLE"), ("p", "P")])
    page = 'cat <p class="cat" title="a cat" data-x=\'title\'>cat &amp; dog<br>p</p><SCRIPT>var cat = "<p>dog</p>"</SCRIPT><style>p {cat}</style><a TITLE=\'dog\' >cat</a> cat'
    want = 'cat <p class="cat" title="a dog" data-x=\'title\'>dog &amP; cat<br>P</p><SCRIPT>var cat = "<p>dog</p>"</SCRIPT><style>p {cat}</style><a TITLE=\'cat\' >dog</a> cat'
    assert terms.replaced_in_html(found, page) == want
    assert terms.replaced_in_html(found, "cat") == "cat" and terms.replaced_in_html(found, "") == ""


def plain_cosines(corpus, asked):
    """The dense account: every gram of every text, weights fitted on the corpus."""

    def grams(t):
        out = {}
        for w in t.split():
            w = f" {w} "
            for n in (2, 3, 4):
                for k in range(len(w) - n + 1):
                    out[w[k : k + n]] = out.get(w[k : k + n], 0) + 1
        return out

    counted = [grams(t) for t in corpus]
    df = {}
    for c in counted:
        for g in c:
            df[g] = df.get(g, 0) + 1

    def unit(c):
        v = {g: (1 + math.log(tf)) * (math.log((1 + len(corpus)) / (1 + df[g])) + 1) for g, tf in c.items() if g in df}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {g: x / size for g, x in v.items()} if size else {}

    units = [unit(c) for c in counted]
    return [[sum(x * u.get(g, 0.0) for g, x in unit(grams(t)).items()) for u in units] for t in asked]


def plain_indel(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(row[j], before[j + 1])
    return 200.0 * row[-1] / (len(a) + len(b)) if a or b else 100.0


def plain_blend(a, b, cosine):
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    short, long = sorted((a, b), key=len)
    n = len(short)
    parts = [(short, long[max(0, k) : k + n]) for k in range(1 - n, len(long))]
    if len(a) == len(b):
        parts += [(long, short[max(0, k) : k + n]) for k in range(1 - n, n)]
    words = plain_indel(" ".join(sorted(a.split())), " ".join(sorted(b.split())))
    return 0.6 * cosine + 0.4 * max(words, *(plain_indel(x, y) for x, y in parts)) * n / len(long) / 100


WORDS = ["gauze", "gauze", "swab", "sterile", "tube", "tubes", "10cm", "100mm", "ä", "of", "needle", "needles", "iv"]


def test_cosines_and_blends_by_brute_force(spark):
    draw = random.Random(6)
    text = lambda: " ".join(draw.choice(WORDS) for _ in range(draw.randrange(0, 7)))
    corpus, asked = [text() for _ in range(60)] + ["unlike"], [text() for _ in range(40)]
    b = spark.createDataFrame([(1, j, t) for j, t in enumerate(corpus)] + [(2, 0, "gauze swab"), (None, 1, "gauze")], "doc int, j int, text string")
    a = spark.createDataFrame([(1, i, t) for i, t in enumerate(asked)] + [(2, 0, "gauze swabs"), (2, 1, None)], "doc int, i int, text string")
    want = plain_cosines([t for t in corpus], asked)
    for least in (0.3, 0.75):
        got = {(r.i, r.j): r.cosine for r in descriptions.cosine_pairs(a, b, ["doc"], "i", "j", "text", least).filter("doc = 1").collect()}
        assert set(got) == {(i, j) for i, row in enumerate(want) for j, c in enumerate(row) if c >= least}
        assert all(abs(c - want[i][j]) < 1e-9 for (i, j), c in got.items())
    near = {(r.i, r.j): r.similarity for r in descriptions.similar_pairs(a, b, ["doc"], "i", "j", "text").filter("doc = 1").collect()}
    blends = {(i, j): plain_blend(t, u, want[i][j]) for i, t in enumerate(asked) for j, u in enumerate(corpus)}
    assert set(near) == {k for k, v in blends.items() if v >= 0.55} and all(abs(v - blends[k]) < 1e-9 for k, v in near.items())
    assert descriptions.similar_pairs(a.limit(0), b, ["doc"], "i", "j", "text").count() == 0


def plain_phases(a, b, description):
    """The four phases as loops over one document's items: (place, ref, text)."""
    used_a, used_b, out = set(), set(), []

    def take(i, j, phase):
        used_a.add(i)
        used_b.add(j)
        out.append((i, j, phase))

    for i, ref, _ in a:
        j = next((j for j, other, _ in b if ref and ref == other and j not in used_b), None)
        if j is not None:
            take(i, j, "exact")
    stem = lambda s: re.sub("[0-9]+$", "", s)
    open_ = lambda x, y: x.replace("0", "") != y.replace("0", "") and not (x[-1:].isdigit() and y[-1:].isdigit() and stem(x) == stem(y))
    alike = sorted((-plain_indel(x, y), i, j) for i, x, _ in a for j, y, _ in b if i not in used_a and j not in used_b and x and y and open_(x, y) and plain_indel(x, y) >= 85)
    for _, i, j in alike:
        if i not in used_a and j not in used_b:
            take(i, j, "fuzzy")
    rest_b = [(j, t) for j, _, t in b if j not in used_b and t]
    rest_a = [(i, t) for i, _, t in a if i not in used_a and t]
    cosines = plain_cosines([t for _, t in rest_b], [t for _, t in rest_a])
    for (i, t), row in zip(rest_a, cosines, strict=True):
        best = max(((description(t, u, c), -j) for (j, u), c in zip(rest_b, row, strict=True) if j not in used_b), default=(0, 0))
        if best[0] >= 0.55:
            take(i, -best[1], "description")
    return sorted(out + [(i, None, "only_a") for i, *_ in a if i not in used_a] + [(None, j, "only_b") for j, *_ in b if j not in used_b], key=str)


@pytest.mark.parametrize("few", [200_000, 0])
def test_four_phases_by_loops(spark, monkeypatch, few):
    """Also when no group may meet in a task, so that every pair comes from rounds of joins."""
    for f in (linkage.greedy_pairs, linkage.ordered_pairs):
        monkeypatch.setattr(phases, f.__name__, lambda *args, f=f, **kwargs: f(*args, **kwargs, few=few))
    draw = random.Random(9)
    ref = lambda: draw.choice(["", "AB10S4", "AB10S5", "AB1OS4", "AB100S4", "NL753S40", "NL753S4O", "NL753SX0", f"Q{draw.randrange(3)}X{draw.randrange(3)}77"])
    item = lambda doc, place: (doc, place, ref(), " ".join(draw.choice(WORDS) for _ in range(draw.randrange(0, 5))))
    a, b = ([item(doc, place) for doc in range(6) for place in range(12)] for _ in range(2))
    schema = "doc int, place int, ref string, description string"
    got = phases.linked_items(spark.createDataFrame(a + [(99, 1, None, None)], schema), spark.createDataFrame(b, schema)).collect()
    for doc in range(6):
        mine = sorted(((r.i, r.j, r.phase) for r in got if r.doc == doc), key=str)
        assert mine == plain_phases([x[1:] for x in a if x[0] == doc], [x[1:] for x in b if x[0] == doc], plain_blend)
    assert [(r.i, r.j, r.phase) for r in got if r.doc == 99] == [(1, None, "only_a")]
    assert {r.phase for r in got} == {"exact", "fuzzy", "description", "only_a", "only_b"}


def plain_merged(rows, gap):
    """The plain loop: any two near boxes become one, until there are none."""
    left = [list(r) + [1] for r in rows]
    k = 0
    while k < len(left):
        a = left[k]
        j = next((j for j, b in enumerate(left) if j != k and b[0] <= a[2] + gap and b[2] >= a[0] - gap and b[1] <= a[3] + gap and b[3] >= a[1] - gap), None)
        if j is None:
            k += 1
            continue
        b = left[j]
        left[k] = [min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]), a[4] + b[4]]
        del left[j]
        k = 0
    return sorted(map(tuple, left))


def plain_first(rows, tolerance):
    kept = []
    for place, *edges in sorted(rows):
        if not any(all(abs(x - y) < tolerance for x, y in zip(edges, k[1:])) for k in kept):
            kept.append((place, *edges))
    return kept


def test_boxes_by_plain_loops(spark):
    """Sizes from a point to the page, boxes that just touch, a dense place, stacked lines, repeated and broken boxes."""
    draw = random.Random(12)
    rows = []
    for page in range(5):
        for _ in range(60):
            x, y = draw.randrange(-80, 400) / 2, draw.randrange(-80, 600) / 2
            rows.append((page, x, y, x + draw.choice([0, 1, 2, 3, 60.5]), y + draw.choice([0, 1, 2, 40.25])))
    rows += [(7, 10 * k, 0, 10 * k + 6, 5) for k in range(30)] + [(8, 10 * k + k * 0.01, 0, 10 * k + 6, 5) for k in range(30)]
    rows += [(9, draw.random(), draw.random(), 1 + draw.random(), 1 + draw.random()) for _ in range(150)] + [(10, 0, 5 * k, 500, 5 * k + 0.5) for k in range(40)] + [(11, 1, 1, 2, 2)] * 4
    schema = "page int, x0 double, y0 double, x1 double, y1 double"
    table = spark.createDataFrame([tuple(map(float, r[1:])) and (r[0], *map(float, r[1:])) for r in rows] + [(11, None, 1.0, 2.0, 3.0), (11, 5.0, 5.0, 1.0, 9.0), (11, float("nan"), 0.0, 1.0, 1.0), (11, 0.0, 0.0, float("inf"), 1.0)], schema)
    got = boxes.merged(table).collect()
    for page in {r[0] for r in rows}:
        want = plain_merged([tuple(map(float, r[1:])) for r in rows if r[0] == page], 4.0)
        assert sorted((r.x0, r.y0, r.x1, r.y1, r.n) for r in got if r.page == page) == want, page
    placed = table.na.drop().filter("page < 12").selectExpr("page", "monotonically_increasing_id() as place", "round(x0) / 2 as x0", "round(y0) / 2 as y0", "round(x1) / 2 as x1", "round(y1) / 2 as y1").filter("not isnan(x0) and x1 < 1e9").toPandas()
    first = boxes.first_of_near(spark.createDataFrame(placed)).collect()
    for page in sorted(set(placed["page"])):
        mine = [tuple(map(float, r[1:])) for r in placed[placed["page"] == page].itertuples(index=False)]
        assert sorted(float(r.place) for r in first if r.page == page) == [k[0] for k in plain_first(mine, 1.0)], page
    assert boxes.merged(table.limit(0)).count() == 0 and boxes.first_of_near(spark.createDataFrame(placed).limit(0)).count() == 0


def plain_lines(a, b):
    used, out = set(), []
    for i, x in a:
        best = max(((plain_indel(x.lower(), y.lower()), -j) for j, y in b if j not in used), default=(0, 0))
        if best[0] >= 70:
            used.add(-best[1])
            out.append((i, -best[1], "equal" if best[0] >= 95 else "changed"))
        else:
            out.append((i, None, "only_a"))
    return sorted(out + [(None, j, "only_b") for j, _ in b if j not in used], key=str)


def test_first_boxes_are_not_broadcast(spark, monkeypatch):
    """Shown boxes are many times their packed files, by which Spark judges what to broadcast."""
    draw, plans = random.Random(5), []

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return storage.stored(df, name)

    monkeypatch.setattr(boxes, "stored", seen)
    rows = [(page, k, x := draw.randrange(-200, 200) / 8, y := draw.randrange(-60, 60) / 8, x + draw.randrange(30) / 8, y + 1.0) for page in range(3) for k in range(300)]
    rows += [(3, k, 1.0, 1.0, 2.0, 2.0) for k in range(50)]
    first = boxes.first_of_near(spark.createDataFrame(rows, "page int, place int, x0 double, y0 double, x1 double, y1 double")).collect()
    for page in range(4):
        assert sorted(r.place for r in first if r.page == page) == [k[0] for k in plain_first([r[1:] for r in rows if r[0] == page], 1.0)]
    assert len(plans) > 3 and not any("Broadcast" in p for p in plans)


def test_lines_in_order_by_plain_loop(spark):
    """Repeated and very long lines, ties, and lines that an earlier one takes."""
    draw = random.Random(15)
    line = lambda: "".join(draw.choice("abcdE ") for _ in range(draw.choice([1, 2, 5, 9, 30, 30, 31]))).strip() or "x"
    a, b = ([(g, k, line()) for g in range(4) for k in range(15)] for _ in range(2))
    a += [(2, 15, "long " * 3000), (2, 16, "Same"), (2, 17, "same"), (3, 15, None)]
    b += [(2, 15, "long " * 2000 + "else " * 900), (2, 16, "same"), (5, 0, "alone")]
    schema = "g int, place int, line string"
    got = linkage.matched_lines(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), "g").collect()
    for g in (0, 1, 3, 5):
        mine = lambda t: [(k, x) for h, k, x in t if h == g and x is not None]  # noqa: B023, E731
        assert sorted(((r.a, r.b, r.status) for r in got if r.g == g), key=str) == plain_lines(mine(a), mine(b))
    two = {(r.a, r.b): r.status for r in got if r.g == 2}
    assert two[16, 16] == "equal" and two[15, 15] == "changed" and len(two) >= 18


def test_lines_of_large_and_small_texts(spark, monkeypatch):
    """Texts of few pairs of lines are compared within a task, and no line goes with each of its pairs to another; the others as before."""
    draw, met = random.Random(16), []
    line = lambda: "".join(draw.choice("abcdE ") for _ in range(draw.choice([1, 2, 5, 9, 30]))).strip() or "x"
    a, b = (spark.createDataFrame([(g, k, line()) for g in range(3) for k in range(5 + 9 * g)], "g int, place int, line string") for _ in range(2))
    monkeypatch.setattr(linkage, "_lines_alike", lambda *args, f=linkage._lines_alike: met.append(1) or f(*args))
    monkeypatch.setattr(linkage.groups, "MOST_ROWS", 3)
    found = []
    for most in (1 << 20, 100, 0):
        monkeypatch.setattr(linkage, "LINE_PAIRS", most)
        found.append(sorted(map(tuple, linkage.matched_lines(a, b, "g").collect()), key=str))
    assert found[0] == found[1] == found[2] and len(met) == 2


#: Published test pairs of the formula (Sharma, Wu and Dalal, 2005).
PUBLISHED = [
    ((50, 2.6772, -79.7751), (50, 0, -82.7485), 2.0425), ((50, 3.1571, -77.2803), (50, 0, -82.7485), 2.8615), ((50, 2.8361, -74.02), (50, 0, -82.7485), 3.4412),
    ((50, -1.3802, -84.2814), (50, 0, -82.7485), 1.0), ((50, 0, 0), (50, -1, 2), 2.3669), ((50, 2.49, -0.001), (50, -2.49, 0.0009), 7.1792),
    ((50, 2.49, -0.001), (50, -2.49, 0.0011), 7.2195), ((50, -0.001, 2.49), (50, 0.0009, -2.49), 4.8045), ((50, 2.5, 0), (50, 0, -2.5), 4.3065),
    ((50, 2.5, 0), (73, 25, -18), 27.1492), ((50, 2.5, 0), (61, -5, 29), 22.8977), ((60.2574, -34.0099, 36.2677), (60.4626, -34.1751, 39.4387), 1.2644),
    ((22.7233, 20.0904, -46.694), (23.0331, 14.973, -42.5619), 2.0373), ((90.8027, -2.0831, 1.441), (91.1528, -1.6435, 0.0447), 1.4441), ((2.0776, 0.0795, -1.135), (0.9033, -0.0636, -0.5514), 0.9082),
]


def test_colour_differences_as_published(spark):
    rows = spark.createDataFrame([tuple(map(float, (*x, *y, e))) for x, y, e in PUBLISHED], "l1 double, a1 double, b1 double, l2 double, a2 double, b2 double, e double")
    assert all(abs(r.delta_e - r.e) < 1e-4 for r in colour.delta_e(rows).collect())
    white = spark.createDataFrame([(255, 255, 255, 255, 255, 255), (255, 0, 0, 255, 0, 0), (0, 0, 0, 255, 255, 255)], "r1 int, g1 int, v1 int, r2 int, g2 int, v2 int")
    assert [round(r.delta_e, 2) for r in colour.delta_e_rgb(white).collect()] == [0.0, 0.0, 100.0]
    lab = colour.stepped(white, colour.lab("1")).select("l1", "a1", "b1").collect()
    assert [tuple(round(v, 1) for v in r) for r in lab] == [(100.0, 0.0, 0.0), (53.2, 80.1, 67.2), (0.0, 0.0, 0.0)]


def test_palettes_by_document(spark):
    schema = "doc int, place int, r int, g int, v int, share double"
    a = spark.createDataFrame([(1, 0, 200, 10, 10, 90.0), (1, 1, 0, 0, 255, 2.0), (2, 0, 9, 9, 9, 50.0), (2, 1, 250, 0, 0, 50.0), (3, 0, 1, 1, 1, 99.0), (4, 0, 5, 5, 5, 1.0)], schema)
    b = spark.createDataFrame([(1, 0, 201, 11, 10, 99.0), (2, 0, 9, 9, 10, 99.0), (9, 0, 1, 1, 1, 99.0)], schema)
    got = {r.doc: (r.n_colours, r.n_changed, r.changed) for r in colour.palette_verdicts(a, b).collect()}
    assert got == {1: (1, 0, False), 2: (2, 1, True), 3: (1, 1, True)}


def plain_json(s):
    start = s.find("{")
    depth, quoted, k = 0, False, start
    while start >= 0 and k < len(s):
        c = s[k]
        if quoted:
            k += c == "\\"
            quoted = c != '"'
        elif c == '"':
            quoted = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if not depth:
                try:
                    return json.loads(s[start : k + 1]) and s[start : k + 1] or s[start : k + 1]
                except ValueError:
                    return None
        k += 1
    return None


def test_first_balanced_object_by_plain_scan(spark):
    draw = random.Random(20)
    pieces = ["{", "}", '"', "\\", '\\"', '"a"', ":", "1", ",", "[", "]", " ", "\n", "é", '{"k": 1}', '{"s": "} {"}', "{}"]
    texts = ["".join(draw.choice(pieces) for _ in range(draw.randrange(0, 9))) for _ in range(600)]
    texts += ["", '{"a": "' + "x\\\"y" * 20_000 + '"} tail', '{"open": "' + "x" * 50_000, '{"deep": ' * 200 + "1" + "}" * 200 + "}"]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", text.first_json_object(F.col("t")).alias("j")).collect()
    for k, j in got:
        assert j == plain_json(texts[k]), texts[k][:80]
    assert spark.createDataFrame([(None,)], "t string").select(text.first_json_object(F.col("t")).alias("j")).first().j is None
    answers = {r.id: r.answer for r in frame(spark, DATA, queries.ANSWERS).collect()}
    assert all(r.json == plain_json(answers[r.id]) for r in queries.t49(spark, DATA).collect())


def test_customs_audit_by_hand(spark):
    items = spark.createDataFrame([(1, 1, "A", "steel tube"), (1, 2, "B", None), (2, 1, "A", "steel tube long"), (2, 2, "C", "brass ring"), (2, 3, "A", "wood"), (3, 1, "A", "steel tube"), (4, 1, None, "x")], "doc int, line int, ref string, description string")
    positions = spark.createDataFrame([(1, 1, "anything", "73041100"), (2, 1, "steel tube", "73041100 10"), (2, 2, "tube steel", "73049999"), (2, 3, "brass ring the pcs", ""), (3, 1, "steel", None)], "doc int, place int, description string, code string")
    master = spark.createDataFrame([("A", "7304.11.00"), ("B", "9801"), ("C", "7400000000")], "ref string, code string")
    tariff = spark.createDataFrame([("73041100", True, " "), ("7304110010", False, None)], "code string, active boolean, restrictions string")
    got = {(r.doc, r.line): (r.status, r.reason, r.issues, r.tariff_issue) for r in customs.audited(items, positions, master, tariff).collect()}
    assert got == {
        (1, 1): ("ok", "same", [], None),
        (1, 2): ("error", "different", ["expected: length"], None),
        (2, 1): ("ok", "prefix", [], "inactive"),
        (2, 2): ("warning", "unmatched", [], None),
        (2, 3): ("warning", "unmatched", [], None),
        (3, 1): ("warning", "no code", [], None),
        (4, 1): ("warning", "no code", [], None),
    }
    plain = customs.audited(items, positions, master)
    assert {r.tariff_issue for r in plain.collect()} == {None} and customs.audited(items.limit(0), positions, master, tariff).count() == 0
    assert customs.audited(items, positions.limit(0), master).filter("reason <> 'no code'").count() == 0


def test_positions_of_large_and_small_documents(spark, monkeypatch):
    """Documents of few pairs are compared within a task, without a join on words; the positions are the same."""
    draw = random.Random(17)
    text = lambda: " ".join(draw.choice([*WORDS, "Śruba", "x1"]) for _ in range(draw.randrange(0, 6)))
    items = spark.createDataFrame([(doc, k, text()) for doc in range(4) for k in range(3 + 6 * doc)] + [(None, 1, "gauze"), (9, 1, None)], "doc int, line int, description string")
    positions = spark.createDataFrame([(doc, k, text(), str(k)) for doc in range(1, 4) for k in range(1 + 5 * doc)] + [(None, 1, "gauze", "1")], "doc int, place int, description string, code string")
    found = []
    for few in (4096, 60, 0):
        monkeypatch.setattr(customs.groups, "FEW_PAIRS", few)
        found.append(sorted(map(tuple, customs.position_codes(items, positions).collect()), key=str))
    assert found[0] == found[1] == found[2] and sum(r[2] is not None for r in found[0]) > 10
    monkeypatch.setattr(customs.groups, "FEW_PAIRS", 4096)
    assert "word#" not in customs.position_codes(items, positions)._jdf.queryExecution().optimizedPlan().toString()
