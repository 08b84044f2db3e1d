"""The registered queries themselves, over their whole table, against plain accounts of what their contracts fix."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash

from tallybook.llm import queries
from tests.llm.test_operators import brute_ids, check_pack, rows
from tests.llm.test_queries import DATA


@pytest.fixture(scope="module")
def texts():
    table = pq.read_table(f"{DATA}/documents.parquet").to_pydict()
    return {i: t or "" for i, t in zip(table["doc_id"], table["text"], strict=True)}


def fingerprint(text: str) -> int:
    low = text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = re.findall("[^\x20\x09-\x0d]+", low)
    shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_op1_fingerprints_and_components(spark, texts):
    got = {r["doc_id"]: r for r in rows(queries.op1_simhash(spark, DATA))}
    prints = {i: fingerprint(t) for i, t in texts.items()}
    assert {i: int(r["fingerprint"], 16) for i, r in got.items()} == prints and all(re.fullmatch("[0-9a-f]{16}", r["fingerprint"]) for r in got.values())
    component = {}
    for i in sorted(prints):
        if i in component:
            continue
        component[i], queue = i, [i]
        while queue:
            a = queue.pop()
            for b in prints:
                if b not in component and (prints[a] ^ prints[b]).bit_count() <= 4:
                    component[b] = i
                    queue.append(b)
    assert {i: r["component_id"] for i, r in got.items()} == component


def test_op9_pieces(spark, texts):
    got = rows(queries.op9_packing(spark, DATA))
    ids = dict(zip(texts, brute_ids(list(texts.values())), strict=True))
    for r in got:
        own = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert len(own) == r["length"] and zlib.crc32(own.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
    check_pack(got, list(ids.values()), 4096)


def test_op10_edited_texts(spark, texts):
    got = {r["doc_id"]: r for r in rows(queries.op10_fingerprints(spark, DATA))}
    order = sorted(texts, reverse=True)
    for k, i in enumerate(order):
        own, after = texts[i], texts[order[(k + 1) % len(order)]]
        half = len(own) // 2
        edited = own[: len(own) - half] + after[:half]
        assert got[i]["n_chars"] == len(own) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        follower = got[order[(k + 1) % len(order)]]
        assert got[i]["near_next"] == 1.0 or got[i]["fingerprint"] != follower["fingerprint"]
    by_text = {}
    for i, t in texts.items():
        assert by_text.setdefault(t, got[i]["fingerprint"]) == got[i]["fingerprint"]


@pytest.mark.parametrize("name,parts,part", [("op2_toxicity", 3, 1), ("op7_languages", 4, 2)])
def test_held_out_rows(spark, texts, name, parts, part):
    got = {r["doc_id"]: r for r in rows(queries.QUERIES[name](spark, DATA))}
    assert set(got) == set(texts)
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % parts == part) and 0 <= r["score"] <= 1
        if name == "op2_toxicity":
            assert r["predicted"] == (r["score"] >= 0.7)
        else:
            assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in texts[i]))
