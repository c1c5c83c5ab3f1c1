"""Ranked lexical search against a plain loop."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyframe.llm import lexical_search
from tallyframe.llm.lexical_search import grouped_by_mask, presence_masks, search, split_terms

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
SCHEMA = "doc_id long, text string, item_id long, terms string, n long, m long, score long, rank int, item int"


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k):
    held = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    many, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, wanted in asked.items():
        found = []
        for doc, counts in held:
            n = sum(counts.values())
            m = 100 - 90 + (90 * n * many) // total
            score = sum(math.floor(1000 * math.log((2 * many + 2) / (2 * df[t] + 1))) * ((1000000000 * counts[t]) // (1000 * counts[t] + 8 * m)) for t in wanted if counts[t])
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        out += [(item, rank, None if none else doc, -minus) for rank, (minus, none, doc) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def rows(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


def frame(spark, pairs):
    return spark.createDataFrame([(d, t, 7, "x", 1, 2, 3, 4, 5) for d, t in pairs], SCHEMA)


def item_frame(spark, pairs):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in pairs], "item_id long, text string, doc_id long, term string")


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    word = lambda: rng.choice(["The", "a", "of", "été", "x9", "漢字"] + [f"w{i}" for i in range(int(rng.paretovariate(0.5)) % 90 + 1)])
    docs = [(i, " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(300)]
    docs += [(1000 + i, docs[7][1]) for i in range(40)]  # a group of copies
    docs += [(5, docs[5][1])] * 2 + [(None, docs[7][1]), (None, None), (400, None), (401, ""), (402, "..;\x7f\x00 --")]
    docs += [(403, "w1 " * 200_000), (404, "zzz" * 300_000), (405, "W1\tw1\x0bÉtÉ{w2}")]
    items = [(i, " ".join(word() for _ in range(rng.randint(1, 30)))) for i in range(25)]
    items += [(90, " ".join(f"w{i}" for i in range(85)) + " été of"), (91, None), (92, ""), (93, "absent"), (None, "w1 w3"), (3, "w80 w81"), (94, "w1 W1 w1")]
    rng.shuffle(docs)
    return docs, items


@pytest.mark.parametrize("block_terms", [lexical_search.BLOCK_TERMS, 60])
def test_equals_a_plain_loop(spark, corpus, monkeypatch, block_terms):
    docs, items = corpus
    if block_terms == 60:  # small blocks of documents and of items
        monkeypatch.setattr(lexical_search, "BLOCK_DOCS", 16)
        monkeypatch.setattr(lexical_search, "_STEP", 3)
    got = rows(search(frame(spark, docs).repartition(3), item_frame(spark, items), 10, block_terms=block_terms))
    assert got == plain(docs, items, 10)
    assert any(r[0] == 90 for r in got) and not any(r[0] in (91, 92, 93) for r in got)


def test_empty_tables_give_no_rows(spark, corpus):
    docs, items = corpus
    assert rows(search(frame(spark, []), item_frame(spark, items))) == []
    assert rows(search(frame(spark, docs[:5]), item_frame(spark, []))) == []
    assert rows(search(frame(spark, [(1, None), (2, "")]), item_frame(spark, items))) == []


@given(st.lists(st.text(max_size=12) | st.none(), max_size=6))
@settings(max_examples=200, deadline=None)
def test_terms(texts):
    flat, of = split_terms(pa.array(texts, pa.string()))
    assert list(zip(of.tolist(), flat.to_pylist())) == [(i, t) for i, text in enumerate(texts) for t in terms(text)]


@given(st.lists(st.lists(st.integers(0, 19), max_size=20, unique=True), min_size=1, max_size=150))
@settings(max_examples=60, deadline=None)
def test_masks_group_rows_that_are_in_the_same_columns(columns):
    distinct, of = grouped_by_mask(presence_masks([np.array(c, np.int64) for c in columns], 20))
    sets = [frozenset(j for j, c in enumerate(columns) if i in c) for i in range(20)]
    assert [[sets[i] == sets[j] for j in range(20)] for i in range(20)] == [[of[i] == of[j] for j in range(20)] for i in range(20)]
    bits = np.unpackbits(distinct.astype("<u8").view(np.uint8), axis=1, bitorder="little")
    assert [frozenset(np.flatnonzero(bits[of[i]]).tolist()) for i in range(20)] == sets
