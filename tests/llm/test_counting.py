"""Exact dedup, phrases and spelling variants against brute force, on odd rows and with budgets that force every path."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tallybook.llm import exact, phrases, queries, spelling
from tests.llm.test_queries import DATA

SCHEMA = "doc_id long, text string, lang string, _id long, key string, bucket int, n string, h string, word string"


def documents(spark, rows):
    """Rows of (id, text, lang), with columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, 1, "k", 2, "n", "h", "w") for r in rows], SCHEMA)


ODD = [
    (None, None, None), (None, "", "en"), (3, "", None), (3, "", None), (4, " ", "en"), (5, "\t\n", "en"), (6, "a  b", "en"), (7, "a b", "en"),
    (8, "a b", "en"), (9, "a b ", "de"), (10, "a b\n\n", "de"), (11, "x" * 300_000, None), (12, "x" * 300_000, "fr"), (8, "a\tb", "en"), (None, "only without id", "en"), (None, "only  without id", "en"),
]


def plain_groups(rows):
    groups = defaultdict(list)
    for i, text, *_ in rows:
        groups[re.sub("[\x20\x09-\x0d]+", " ", text or "")].append(i)
    out = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        digest = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, keep, len(ids), digest) for i in ids]
    return sorted(out, key=str), len(groups)


CASES = {
    "plain": {},
    "small buckets": {"bucket_bytes": 64, "fan_out": 2, "local_bytes": 40},
    "one hash": {"bucket_bytes": 64, "fan_out": 3, "part_rows": 4, "local_bytes": 1, "hashed": lambda content: 7},
    "four hashes": {"bucket_bytes": 200, "fan_out": 2, "part_rows": 3, "local_bytes": 1, "hashed": lambda content: len(content) % 4 << 62},
}


@pytest.mark.parametrize("case", CASES)
def test_exact_groups_by_brute_force(spark, case):
    """Also with spill tables dealt again, and with hashes that tell nothing: only contents decide."""
    draw = random.Random(5)
    rows = ODD + [(100 + k, draw.choice(["hot text", "hot  text", "hot\ntext", f"rare {draw.randrange(60)}", f"pair{' ' * draw.randrange(1, 4)}{k % 40}"]), "en") for k in range(400)]
    got = exact.groups(documents(spark, rows).repartition(7), **CASES[case]).collect()
    want, n = plain_groups(rows)
    assert sorted(((r.id, r.keep_id, r.group_size, r.digest) for r in got), key=str) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == n and all(r.id == r.keep_id for r in kept) and len({r.digest for r in kept}) == n


def test_exact_documents_stay_whole(spark):
    rows = documents(spark, ODD)
    got = exact.deduplicated(rows)
    assert got.columns == rows.columns and got.dtypes == rows.dtypes
    assert sorted(exact.normalised((r.text or "").encode()) for r in got.collect()) == sorted({exact.normalised((r[1] or "").encode()) for r in ODD})
    assert exact.deduplicated(rows.limit(0)).count() == 0 and exact.groups(rows.limit(0)).count() == 0


def test_content_table_compares_contents():
    table = exact.ContentTable()
    contents = [b"%d" % (k % 500) for k in range(2000)]
    assert [table.place(3, c) for c in contents] == [k % 500 for k in range(2000)]
    assert len(table.contents) == 500


def plain_phrases(rows, longest, least, within, top):
    f, n = defaultdict(Counter), Counter()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(low)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in candidates.items():
            around = [b for q, b in candidates.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * b >= within * a for b in around):
                continue
            score, _, l, r = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, rank, p.decode(), -a, l, r, n[lang], -s) for rank, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("longest,budget,top", [(3, 1 << 22, 2000), (3, 64, 40), (4, 64, 2000), (2, 200, 2000)])
def test_phrases_by_brute_force(spark, monkeypatch, longest, budget, top):
    """With small budgets the frequent prefixes are taken apart once and twice, and every block is cut often."""
    monkeypatch.setattr(phrases, "TASK_TOKENS", 300)
    draw = random.Random(3)
    words = ["The", "of", "of", "the", "hot", "hot", "dog", "a", "Été", "x y", *(f"w{k}" for k in range(12))]
    rows = ODD + [(20 + k, "".join(draw.choice(words) + draw.choice([" ", " ", "\t ", ", ", ".", "\r\n"]) for _ in range(60)), draw.choice(["en", "en", "en", "de", None])) for k in range(150)]
    rows += [(900, "hot dog " * 3000, "en"), (901, "one two three. " * 30, "de")]
    got = phrases.collocations(documents(spark, rows).repartition(3), longest, least=10, budget=budget, top=top).collect()
    assert sorted(map(tuple, got)) == plain_phrases(rows, longest, 10, 50, top)


def test_phrases_take_frequent_prefixes_apart(spark):
    """A prefix of most occurrences is dealt by its next words, so that no group has far more leaves than the budget."""
    text = " ".join(f"the w{k % 97} the v{k % 89}" for k in range(20_000))
    rows = documents(spark, [(1, text, "en")]).select(F.col("lang"), F.col("text").cast("binary").alias("text"))
    words = phrases._words(rows).withColumn("h", F.xxhash64("lang", "word"))
    frequent = phrases._filter(words, 1)
    division = phrases._division(rows, words, frequent, 3, 64)
    assert len(division.heavy) and all(len(h) for h in division.heavy)
    assert phrases.collocations(documents(spark, ODD).limit(0)).count() == 0


def plain_variants(counts, times):
    words = sorted(counts)
    by_key = defaultdict(set)
    for w in words:
        by_key[w].add(w)
        for i in range(len(w)):
            by_key[w[:i] + w[i + 1 :]].add(w)

    def one_apart(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    near = defaultdict(set)
    for group in by_key.values():
        for a in group:
            near[a] |= {b for b in group if a != b and one_apart(a, b)}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= times * counts[w] and counts[best] > 0 else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] is not None else None))
    return out


def plain_vocabulary(rows, letters=6, least=5):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= letters:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= least}


def test_spelling_query_by_brute_force(spark):
    """The registered query, over its whole table."""
    table = pq.read_table(f"{DATA}/documents.parquet").to_pydict()
    want = plain_variants(plain_vocabulary(zip(table["doc_id"], table["text"])), 5)
    got = queries.op13_spelling(spark, DATA).collect()
    assert sorted(map(tuple, got)) == want and any(r.form for r in got) and any(r.root not in (r.word, r.form) or r.form for r in got)


def test_spelling_by_brute_force(spark):
    """Dense words of two letters: runs of equal letters, chains, ties, a hot place; and words that span ranges."""
    draw = random.Random(8)
    counts = {"".join(draw.choice("ab") for _ in range(draw.randrange(0, 9))): draw.choice([0, 1, 5, 5, 25, 25, 125, 700]) for _ in range(260)}
    counts |= {f"hot{c}place": 5 for c in map(chr, range(0x4E00, 0x4E90))} | {"hotplace": 60, "\U0001f600abc": 7, "abc": 1, "z" * 3000: 40, "z" * 3001: 4, "y" + "z" * 3000: 1}
    words = spark.createDataFrame([(w, n, 1, 2) for w, n in counts.items()] + [(None, 4, 1, 2)], "word string, n long, id int, place int")
    got = spelling.variants(words.repartition(5)).collect()
    assert sorted(map(tuple, got)) == plain_variants(counts, 5)
    assert spelling.variants(words.limit(0)).count() == 0


def test_vocabulary_of_odd_rows(spark):
    rows = ODD + [(30 + k, "Straße STRASSE ×÷ÀÿĀabcdef Wordword's", "de") for k in range(400)] + [(None, "wordless wordless", None)] * 3
    got = dict(map(tuple, spelling.vocabulary(documents(spark, rows)).collect()))
    assert got == plain_vocabulary([r[:2] for r in rows]) and len(got) >= 5
