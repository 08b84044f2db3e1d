"""The pipeline's stages, one after the other, each against a plain account of what it keeps."""

import collections

import pytest

import corpus_pipeline
from tallybook.llm import spans
from tests.llm.test_operators import SCHEMA, TOKENIZER, brute_ids, brute_shingles, check_pack, odd_rows, prose, rows, words

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    """Clean documents of two languages, copies, near copies, a passage that two documents share, and nothing to read."""
    passage = prose(90, 70)
    french = {k: prose(120, 300 + k).translate(str.maketrans("abcdefghij", "klmnopqrst")) for k in range(20, 40)}
    texts = {k: prose(120, 100 + k) for k in range(20)} | french
    texts[5] += "\n" + passage
    texts[9] = passage + "\n" + texts[9]
    texts |= {40: texts[3], 41: texts[3], 42: texts[4].rsplit(" ", 3)[0], 43: "12 34 !", 44: None, 45: words(30, 1).translate(str.maketrans("abcdefghij", "µßøđłħŧþðæ"))}
    return [(k, t, None if t is None else "en" if k < 20 or k > 39 else "fr", "ab"[k % 2], None if t is None else len(t)) for k, t in texts.items()]


def test_stages(spark, tmp_path):
    docs, seen = spark.createDataFrame(corpus(), COLUMNS), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, "").write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = rows(docs)
        if name != "pack_sequences":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    given = {d[0]: d[1] for d in corpus()}
    known = {r["doc_id"]: r["text"] for r in seen["language_id"]}
    assert set(range(43)) <= set(known) and not {43, 44} & set(known)
    # Of texts with similar shingle sets the smallest id stays.
    sets = {k: brute_shingles(t) for k, t in known.items()}
    similar = {b for a in known for b in known if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    kept = {r["doc_id"]: r["text"] for r in seen["simhash_near_dedup"]}
    assert set(kept) == set(known) - similar and {40, 41, 42} <= similar
    # The second of the shared passages goes, but for a piece at each end; all else stays.
    cut = {r["doc_id"]: r for r in seen["substring_dedup"]}
    assert set(cut) == set(kept)
    for k, r in cut.items():
        lost = len(kept[k].split()) - len(r["text"].split())
        assert (90 - 2 * spans.CUT_WITHIN <= lost <= 90) if k == 9 else r["text"] == given[k]
        assert r["n_chars"] == len(r["text"])
    order = [r["doc_id"] for r in seen["mix_sources"]]
    assert sorted(order) == sorted(cut)
    ids = dict(zip(cut, brute_ids([r["text"] for r in cut.values()]), strict=True))
    check_pack(seen["pack_sequences"], list(ids.values()), 4096)
    parts = collections.defaultdict(list)
    for r in seen["pack_sequences"]:
        parts[r["doc_id"]].append(r)
    assert TOKENIZER and all([r["start"] for r in sorted(parts[k], key=lambda r: r["start"])][0] == 0 and sum(r["length"] for r in parts[k]) == len(ids[k]) for k in ids)


@pytest.mark.parametrize("table", ["odd", "empty"])
def test_stages_on_odd_tables(spark, tmp_path, table):
    docs = spark.createDataFrame(odd_rows() if table == "odd" else [], SCHEMA)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        columns = docs.columns
        stage(spark, docs, "").write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert k == 4 or docs.columns == columns
    assert (docs.count() > 0) == (table == "odd")
