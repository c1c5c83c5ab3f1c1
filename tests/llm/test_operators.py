"""The training-data operators against brute force, and on odd inputs."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import bpe, crf, html_text, licenses, mixing, quality, simhash, suffix_dedup
from tallyframe.llm.components import components
from tallyframe.llm.host_rules import apply_host_rules
from tallyframe.llm.pivot_search import top_k
from tallyframe.llm.token_files import read_token_files, write_token_files

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = re.compile("[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, fp string, d string, row string"


def corpus(seed=3, count=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("aeiounrst", k=rng.randint(1, 7)))
    line = lambda n: " ".join(word() for _ in range(n))
    passage = line(40)
    texts = [line(rng.randint(1, 120)) + "\n" + line(rng.randint(1, 20)) for _ in range(count)]
    texts += [f"{line(12)} {passage} {line(9)}" for _ in range(12)] + texts[:6]
    texts += [t.replace("a", "e", 1) for t in texts[:6]] + ["é" * 300, "a" * 900, "ab" * 400, " ".join(["no"] * 200), "É ß 漢字 \U0001F600  x"]
    texts += ["", "", "   \n ", None, None, "one", "one two three", "\n\n\n"]
    rows = [(i, t, "en", rng.choice(["a", "b", "c", None]), len(t or ""), "x", "y", "z", "r") for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated rows, a null id and null everywhere."""
    rows = [(1, "same text of this row " * 20, "en", "a", 1, None, None, None, None)] * 2 + [
        (None, None, None, None, None, None, None, None, None), (2, "same text of this row " * 20, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def texts_of(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def words(text):
    return WORDS.findall(text or "")


def test_bpe_equals_the_library(docs):
    import tiktoken

    ranks = bpe.read_ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS).collect()}
    for doc_id, text in texts_of(docs).items():
        assert got[doc_id].ids == library.encode_ordinary(text or "")
        assert bytes(got[doc_id].decoded) == (text or "").encode()


def test_packs_of_a_task_go_on_one_by_one(spark, monkeypatch):
    unpack = bpe._unpack

    def watched(ranks_path, frequent):
        run = unpack(ranks_path, frequent)

        def bounded(batches):
            for batch in batches:
                assert batch.nbytes < 9 << 20, f"{len(batch)} packs in one batch, {batch.nbytes} bytes"
                yield batch

        return lambda batches: run(bounded(batches))

    monkeypatch.setattr(bpe, "_unpack", watched)
    docs = spark.range(0, 3_000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a b "), 500).alias("text"))
    got = bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS)
    assert got.agg(F.count("*"), F.min(F.octet_length("decoded")), F.max(F.octet_length("decoded"))).first() == (3_000, 2_000, 2_000)
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 2  # as many Python workers a task


def test_decoding_needs_no_python_and_keeps_every_byte(spark):
    ranks = bpe.read_ranks(RANKS)
    rows = [(1, list(range(len(ranks)))), (2, []), (3, None), (None, [ranks[bytes([i])] for i in range(255, -1, -1)])]
    got = bpe.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>").coalesce(1), RANKS)
    assert "MapInArrow" not in got._jdf.queryExecution().executedPlan().toString()
    pieces = {rank: piece for piece, rank in ranks.items()}
    assert {r.doc_id: (r.ids, bytes(r.decoded)) for r in got.collect()} == {i: (ids or [], b"".join(pieces[x] for x in ids or [])) for i, ids in rows}


def test_long_words_merge_alike():
    import tiktoken

    ranks = bpe.read_ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    for word in ("a" * 500, "abcabd" * 90, "éèê" * 60, "the" * 101):
        assert bpe.heap_ids(word.encode(), ranks) == library.encode_ordinary(word)


def test_token_files_hold_what_the_library_gives(spark, docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    manifest = write_token_files(docs, path, end_id=2)
    got = {r.doc_id: r for r in read_token_files(manifest).collect()}
    start = 0
    for doc_id, text in sorted(texts_of(docs).items()):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert (got[doc_id].start, got[doc_id].n_tokens) == (start, len(ids))
        assert got[doc_id].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert manifest.agg(F.sum("n_tokens")).first()[0] == start


def fingerprint(text, shingle):
    import xxhash

    own = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not own:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(own[i : i + shingle]), 42) for i in range(max(1, len(own) - shingle + 1))]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def closest(values, distance):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= distance:
                a_root, b_root = sorted((find(i), find(j)))
                root[b_root] = a_root
    return [find(i) for i in range(len(values))]


def test_near_duplicates_by_brute_force(docs):
    texts = texts_of(docs)
    ids = sorted(texts)
    prints = [fingerprint(texts[i], 4) for i in ids]
    roots = closest(prints, 4)
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    for i, value, root in zip(ids, prints, roots):
        assert got[i].fingerprint == format(value, "016x")
        assert got[i].component_id == ids[root]


def test_full_blocks_are_split_without_losing_links(spark):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    values = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(400)} | {rng.getrandbits(64) for _ in range(100)}
    values = sorted(values)
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(v,) for v in signed], "fp long")
    found = {r.node: r.root for r in components(simhash.fingerprint_links(frame, 4, block_rows=8)).collect()}
    roots = closest(values, 4)
    groups = {}
    for value, root in zip(signed, roots):
        groups.setdefault(root, set()).add(value)
    for group in groups.values():
        assert len({found.get(v, v) for v in group}) == 1
    assert len({found.get(v, v) for v in signed}) == len(groups)


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(100)]
    star = [(1000, 1000 + i) for i in range(1, 50)]
    got = {r.node: r.root for r in components(spark.createDataFrame([*chain, *star, (7, 7)], "a long, b long")).collect()}
    assert {got[i] for i in range(101)} == {0}
    assert {got[1000 + i] for i in range(50)} == {1000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def repeats(texts, length=100):
    seen, out = set(), {}
    for doc_id in sorted(texts):
        data = (texts[doc_id] or "").encode()
        gone = bytearray(len(data))
        for at in range(len(data) - length + 1):
            part = data[at : at + length]
            if part in seen:
                gone[at : at + length] = b"\1" * length
            seen.add(part)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[doc_id] = (kept, sum(gone), sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1])))
    return out


@pytest.mark.parametrize("hot", [20_000, 1])
def test_repeats_by_brute_force(docs, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_ROWS", hot)
    got = suffix_dedup.remove_repeats(docs.select("doc_id", "text")).collect()
    expected = repeats(texts_of(docs))
    assert {r.doc_id: (bytes(r.kept), r.n_removed, r.n_spans) for r in got} == expected


def test_texts_over_a_chunk_are_cut_without_losing_windows(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 256)
    rng = random.Random(9)
    long = "".join(rng.choices("abcdefg ", k=3000))
    rows = [(1, long), (2, "x" + long[500:1500]), (3, long[2000:2400] + "y" * 150 + long[100:200])]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (bytes(r.kept), r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(frame).collect()}
    assert got == repeats(dict(rows))


def test_suffixes_sort_as_bytes_do():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 400, dtype=np.uint8)
    suffixes = suffix_dedup.Suffixes(data, 12)
    places = np.arange(388)
    order = suffixes.sort(places, np.zeros(388, np.int64))
    raw = data.tobytes()
    assert [raw[p : p + 12] for p in places[order]] == sorted(raw[p : p + 12] for p in places)


def test_windows_are_settled_by_sorting_their_anchors(monkeypatch):
    sort, sorted_ = suffix_dedup.Suffixes.sort, []
    monkeypatch.setattr(suffix_dedup.Suffixes, "sort", lambda self, places, bucket: sorted_.append(len(places)) or sort(self, places, bucket))
    rng = random.Random(8)
    for letters, length in (("a", 29), ("ab", 32), ("abc", 27), ("ab\0", 30)):
        text = "".join(rng.choices(letters, k=200)).encode()
        rows = []
        for gram in sorted(rng.choices(range(4), k=60)):
            a = rng.randint(0, length - 3)
            b = rng.randint(0, a)
            at = rng.randint(0, 200 - b - length)
            rows.append((gram, a, b, text[at : at + b + length]))
        seen, expected = set(), []
        for gram, a, b, around in rows:
            own = [(gram, a - i, around[i : i + length]) for i in range(b + 1)]
            expected += [window in seen for window in own]
            seen.update(own)
        sorted_.clear()
        h, a, b = (np.array([row[i] for row in rows], np.int64) for i in range(3))
        got = suffix_dedup.covered_windows(h, a, b, [row[3] for row in rows], length)
        assert got.tolist() == expected and any(expected)
        assert sum(sorted_) <= 2 * len(rows) < len(expected)


def test_joins_of_all_texts_carry_each_text_once(docs, monkeypatch):
    near, joined = suffix_dedup._near_texts, []
    monkeypatch.setattr(suffix_dedup, "_near_texts", lambda rows, wanted: joined.append(rows.columns) or near(rows, wanted))
    monkeypatch.setattr(suffix_dedup, "BROADCAST_DOCS", 0)  # as where many documents have repeats
    got = suffix_dedup.remove_repeats(docs.select("doc_id", F.col("text").alias("a.`text`")), text="a.`text`").collect()
    assert {r.doc_id: (bytes(r.kept), r.n_removed, r.n_spans) for r in got} == repeats(texts_of(docs))
    assert joined == [["d", "t", "text"], ["row", "d", "t"]]


def test_anchors_are_packed_without_loss():
    rng = np.random.default_rng(4)
    longs = [np.append(rng.integers(-(1 << 63), 1 << 63, 50), [-(1 << 63), (1 << 63) - 1, 0, -1]) for _ in range(4)]
    ints = [rng.integers(0, 1 << 31, 54) for _ in range(3)]
    h, c, d, t = longs
    batch = suffix_dedup._packed(False, h.view(np.uint64), c.view(np.uint64), d, t, *ints)
    for part in (slice(0, 54), slice(7, 40)):  # a slice begins inside the bytes
        got = suffix_dedup._unpacked(batch.slice(part.start, part.stop - part.start))
        for name, value in zip(("h", "c", "d", "t", "x", "a", "b"), (h, c.view(np.uint64), d, t, *ints)):
            assert (got[name] == value[part]).all()
    raw, order = batch.column(1).to_pylist(), np.lexsort((*ints[::-1], t, d, c.view(np.uint64)))
    assert sorted(raw) == [raw[i] for i in order]


def test_mix_meets_its_targets(docs):
    rows = mixing.mix_sources(docs).collect()
    sizes, taken, target = {}, {}, {}
    texts = texts_of(docs)
    for r in rows:
        assert r.size == len(words(texts[r.doc_id])) and r.taken == r.copies * r.size <= 3 * r.size
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        share = {s: 3 * sizes[s] if s in full else rest * weight[s] / sum(weight[o] for o in order if o not in full) for s in order}
        over = {s for s in order if share[s] > 3 * sizes[s]} - full
        if not over:
            break
        full |= over
    for s in order:
        assert target[s] == pytest.approx(share[s])
        assert taken[s] == pytest.approx(target[s], rel=0.02)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix_sources(docs).collect()), key=str)


def test_rates_are_tilted_exponentially(docs):
    for source in ("a", "b"):
        rows = [r for r in mixing.mix_sources(docs).collect() if r.source == source and r.size and r.rate < 3]
        tilts = [np.log(r.rate) / r.size for r in rows]
        assert max(tilts) - min(tilts) < 1e-6


def test_top_k_by_brute_force(spark):
    rng = np.random.default_rng(4)
    vectors = [v.tolist() for v in rng.normal(size=(300, 8)).astype(np.float32)]
    rows = list(enumerate(vectors + vectors[:40] + [vectors[0]] * 60)) + [
        (900, None), (901, [1.0, None]), (902, [float("nan")] * 8), (903, [float("inf")] * 8), (None, vectors[0]), (5, vectors[5])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    ints = {i: np.floor(64 * np.array(v, np.float64)).astype(int) for i, v in rows if i is not None and i < 900}
    got = {}
    for r in top_k(frame, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    queries = [i for i in ints if i % 20 == 0]
    assert set(got) == set(queries)
    for q in queries:
        best = sorted(((int(ints[q] @ v), i) for i, v in ints.items() if i != q), key=lambda x: (-x[0], x[1]))[:20]
        assert [got[q][k] for k in sorted(got[q])] == [(i, s) for s, i in best]
    few = top_k(frame.where("vec_id < 3"), F.col("vec_id") == 0).collect()
    assert len(few) == 2
    assert top_k(frame.limit(0), F.col("vec_id") == 0).count() == 0


def test_host_rules_reject_a_bad_host_only(spark):
    good = "every line of this text has words of its own that say what nobody has said before in such a way or at such length"
    rows = [(i, f"{good} {i}", "fine") for i in range(40)] + [(100 + i, "buy now " * 40, "spam") for i in range(40)] + [(200, good, "spam"), (201, None, None), (202, good, None)]
    got = {r.doc_id: r for r in apply_host_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i].kept for i in range(40)) and got[202].kept
    assert not got[200].kept and not got[200].base_failed
    assert got[100].base_failed and got[100].n_repeat_words == 80
    assert (got[201].n_words, got[201].base_failed, got[201].kept) == (0, True, False)


def test_quality_field_learns(spark):
    rng = random.Random(1)
    clean = lambda: "\n".join(" ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(12)) + "." for _ in range(6))
    junk = lambda: "\n".join(" ".join([rng.choice(["***", "buy!!", "$$$"])] * 14) for _ in range(6))
    rows = [(i, clean() if i % 2 else junk()) for i in range(120)]
    frame = spark.createDataFrame([*rows, (500, None), (501, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.score_quality(frame, labels).collect()}
    held = [i for i in range(120) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert [got[i].held_out for i in range(120)] == [i in held for i in range(120)]
    assert all(got[i].predicted == i % 2 for i in held)
    assert 0 <= got[500].score <= 1 and got[500].score == got[501].score
    nothing = quality.score_quality(frame, labels.limit(0)).collect()
    assert {r.score for r in nothing} == {0.5}


def test_field_marginals_and_viterbi_by_enumeration():
    from itertools import product

    rng = np.random.default_rng(3)
    model = crf.Crf(rng.normal(size=(6, 2)), rng.normal(size=(2, 2)))
    lengths = np.array([3, 1, 4])
    features = rng.integers(0, 6, (8, 2))
    got, best = crf.marginals(model, features, lengths), crf.best_labels(model, features, lengths)
    at = 0
    for n in lengths:
        scores = model.scores(features[at : at + n])
        weight = {p: scores[range(n), p].sum() + sum(model.steps[a, b] for a, b in zip(p, p[1:])) for p in product((0, 1), repeat=int(n))}
        total = sum(map(np.exp, weight.values()))
        for i in range(n):
            assert got[at + i, 1] == pytest.approx(sum(np.exp(w) for p, w in weight.items() if p[i]) / total)
        assert tuple(best[at : at + n]) == max(weight, key=weight.get)
        at += n


def test_field_reads_pages_it_was_not_trained_on():
    model = html_text.train()
    right = count = 0
    for page, truth in html_text.labelled_pages(80, seed=99):
        blocks = [b for b in html_text.leaf_blocks(page) if b.text in truth]
        labels = crf.best_labels(model, html_text.block_features(blocks), np.array([len(blocks)]))
        right += sum(truth[b.text] == label for b, label in zip(blocks, labels))
        count += len(blocks)
    assert right / count > 0.98


def test_pages_with_odd_markup(spark):
    page = (
        "<html><head><title>t</title><script>x='</p>'</script></head><body><nav><a href='/'>Home</a></nav><article><h1>A &amp; B</h1>"
        "<p>First   part<br>goes\n on &lt;here&gt;.<p><b>Second part has no end tags at all.<!-- <p>no</p> -->"
        "</article><footer>&copy; someone</footer>"
    )
    rows = [(1, "u", page), (2, "u", None), (3, None, ""), (4, "u", "<<<>><p"), (None, "u", "<script>never closed <p>x</p>")]
    got = {r.page_id: r for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].text == "A & B\nFirst part goes on <here>.\nSecond part has no end tags at all."
    assert got[1].n_chars == len(got[1].text)
    assert (got[2].text, got[3].text, got[None].text, got[2].n_chars) == ("", "", "", 0)


def test_every_known_sentence_has_a_cue_and_plain_form():
    for forms in licenses.SENTENCES.values():
        for form in forms:
            assert re.search(licenses.CUES, form) and form == re.sub("[^a-z0-9]+", " ", form.lower()).strip()
    assert {name for _, sequence in licenses.RULES for name in sequence} <= set(licenses.SENTENCES)


def test_licence_rules_in_order(spark):
    grant, notice, warranty = (licenses.SENTENCES[f"mit-{k}"][0] for k in ("grant", "notice", "warranty"))
    full = f"MIT License\n\n{grant}:\n{notice}.\n{warranty}."
    wrapped = full.replace(" to any person", "\nto any person")
    rows = [(1, full), (2, wrapped), (3, "text.\nLicensed under CC BY-NC 4.0.\nmore"), (4, "no licence here."), (5, None), (6, "Released under the MIT License. Released under the MIT License.")]
    got = {r.doc_id: r for r in licenses.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].sentences == "mit-title|mit-grant|mit-notice|mit-warranty"
    assert [got[i].licences for i in range(1, 7)] == ["MIT", "MIT", "CC-BY-NC-4.0", "", "", "MIT"]


def every_operator(frame):
    yield "bpe", bpe.decode(bpe.encode(frame, RANKS, public_tokenizers.PATTERN), RANKS)
    yield "quality", quality.score_quality(frame, frame.select("doc_id", F.lit(1).alias("quality")))
    yield "tokens", read_token_files(write_token_files(frame, public_tokenizers.path("word_bpe_49k.json"), 2))
    yield "simhash", simhash.near_duplicates(frame)
    yield "mix", mixing.mix_sources(frame)
    yield "licences", licenses.scan_licences(frame)
    yield "repeats", suffix_dedup.cut_rows(frame)
    yield "rules", apply_host_rules(frame)


def test_empty_tables_give_empty_results(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for name, result in every_operator(empty):
        assert result.count() == 0, name
    assert html_text.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_repeated_and_null_rows_are_kept(odd):
    for name, result in every_operator(odd):
        assert result.count() == 4, name
    kept = {(r.doc_id, r.n_removed) for r in suffix_dedup.remove_repeats(odd).collect()}
    n = len("same text of this row " * 20)
    assert (2, n) in kept and (None, 0) in kept
    assert len({hashlib.sha256(bytes(r.kept)).hexdigest() for r in suffix_dedup.remove_repeats(odd).where("doc_id = 1").collect()}) == 1


def test_pipeline_stages(spark, odd):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeats", "mix", "tokens"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), sf).count() == 0, name
        assert stage(spark, odd, sf).columns == odd.columns, name
    texts = {r.doc_id: r.text for r in docs.collect()}
    near = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf).collect()}
    assert near == similar_ids(texts)
    left = {r.doc_id: r.text for r in corpus_pipeline.cut_repeats(spark, docs, sf).collect()}
    expected = {i: kept.decode("utf-8", "ignore") for i, (kept, removed, _) in repeats(texts).items() if kept or not removed}
    assert left == expected
    rows = corpus_pipeline.run(spark, sf)
    assert rows.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and rows.count() > 0


#: Names that operators and stages use inside or add.
INNER = """
    a a_ action advert after aim at b b_ bands base base_failed block both bucket buckets c cell code codes component component_id copies copy count
    cut d d_ decoded digest end extra fingerprint first flat fp got group h has hash held held_out held_id high home host host_rate id ids ids_crc32
    ids_sha256 item kept kept_text key known label lack least left licences lines low m mass me more n n_dup_lines n_removed n_repeat_words n_spans
    n_symbols n_tokens n_words newton node of open part pieces place places predicted quality quota rank rate root row score sentence sentences set
    shard size sizes sketch slope sp source_size spans start state sub t t_ taken target text_ tilt twice w weight whole word word_chars words x
    _b _copies _copy _id _l _label _m _q _qb _qs _qz _quality _s _size _source _t _z
""".split()


@pytest.fixture(scope="module")
def crowded(spark):
    rows = [(i, f"line {i} of a text that is good.\n" + "words come here " * 12 * (i % 4), "en", "ab"[i % 2], 5) for i in range(14)]
    rows += [(20, None, None, None, None), (None, "", "en", "a", 0), (3, "again", "en", "a", 5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in INNER)
    return spark.createDataFrame([(*r, *["x"] * len(INNER)) for r in rows], schema)


def test_clashing_names(spark, crowded):
    import corpus_pipeline

    for name, result in every_operator(crowded):
        assert result.count() == 17, name
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, crowded, "/root/testdata/sf0.001")
        assert out.columns == crowded.columns, name
        assert all(r.fp == "x" for r in out.collect()), name
    with pytest.raises(ValueError, match="twice: kept, kept_text, n_removed, n_spans"):
        suffix_dedup.remove_repeats(crowded)
    with pytest.raises(ValueError, match="twice: score"):
        quality.with_scores(crowded, crf.Crf(np.zeros((quality.N_FEATURES, 2)), np.zeros((2, 2))))
    extra = [F.lit("x").alias(c) for c in INNER if c not in ("row",)]
    pages = spark.createDataFrame([(1, "u", "<article><p>Some words stand here, and more of them.</p></article>")], "page_id long, url string, html string")
    assert html_text.extract_text(pages.select("*", *extra, F.lit("x").alias("row"))).count() == 1
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)], "vec_id long, embedding array<double>")
    assert top_k(vectors.select("*", *extra, F.lit("x").alias("row")), F.col("vec_id") % 3 == 0, k=2).count() == 4


def test_long_attributes_and_unclosed_tags():
    import time

    page = f"<article><p title=\"{'a > b ' * 200_000}\" class=x>Kept words.</p><div data='{'>' * 20_000}\"'>More.</div></article>"
    assert [b.text for b in html_text.leaf_blocks(page)] == ["Kept words.", "More."]
    for piece in ('<a "', "<a ", "<a '\"", '<a"', "<a b='\">", "<a b=\"'x"):
        for end in ("", ">", '"', "'>"):
            start = time.perf_counter()
            html_text.leaf_blocks(piece * (1_000_000 // len(piece)) + end)
            assert time.perf_counter() - start < 15


def plain_tag_end(page, at):
    quote = None
    for i in range(at, len(page)):
        if quote:
            quote = None if page[i] == quote else quote
        elif page[i] == ">":
            return i + 1
        elif page[i] in "'\"":
            quote = page[i]
    return -1


def test_tag_ends_equal_a_plain_scan():
    rng = random.Random(8)
    for _ in range(3000):
        page = "".join(rng.choices("<a>'\" ", weights=(3, 2, 1, 2, 2, 1), k=rng.randint(0, 24)))
        ends = html_text._TagEnds(page)
        for at in range(len(page) + 1):
            assert ends.after(at) == plain_tag_end(page, at)


def test_lines_of_long_texts_are_chosen_all_over():
    chosen = quality.chosen_lines(7, 30_000)
    assert len(chosen) == quality.TRAIN_LINES == len(set(chosen.tolist())) and (np.diff(chosen) > 0).all()
    assert np.histogram(chosen, 10, (0, 30_000))[0].min() > 10
    assert quality.chosen_lines(7, 5).tolist() == list(range(5))


def test_unsettled_mix_is_an_error(spark, docs, monkeypatch):
    monkeypatch.setattr(mixing, "STEPS", 1)
    with pytest.raises(RuntimeError, match="settle"):
        mixing.mix_sources(docs)


def test_repeated_ids_train_once(spark):
    rows = [(i % 4, f"good text {i % 4}. It goes on.") for i in range(40)]
    model = quality.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, quality int"))
    once = quality.train(spark.createDataFrame(rows[:4], "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, quality int"))
    assert np.array_equal(model.weights, once.weights)


def jaccard(x, y):
    return len(x & y) / len(x | y) if x | y else 1.0


def shingle_set(text):
    own = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))} if own else set()


def similar_ids(texts, threshold=0.8):
    """The smallest id of each component, by brute force."""
    ids = sorted(texts)
    sets = [shingle_set(texts[i]) for i in ids]
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if jaccard(x, sets[j]) >= threshold:
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return {ids[find(i)] for i in range(len(ids))}


def planted_copies(seed=11):
    """Texts, each with copies of a shingle similarity just over 0.8, 0.85, 0.9 and 0.95, and one under 0.8."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("aeiounrstlkm", k=rng.randint(3, 7)))
    texts = []
    for _ in range(40):
        base = [word() for _ in range(rng.randint(150, 400))]
        for goal in (0.8, 0.85, 0.9, 0.95, 0.7):
            copy = list(base)
            while jaccard(shingle_set(" ".join(copy)), shingle_set(" ".join(base))) >= goal:
                before, at = list(copy), rng.randrange(len(copy))
                copy[at] = word()
            texts.append(" ".join(copy if goal == 0.7 else before))
        texts.append(" ".join(base))
    return dict(enumerate(texts))


def test_pipeline_links_copies_of_similarity_four_fifths(spark):
    import corpus_pipeline

    texts = planted_copies()
    frame = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, frame.repartition(4), "").collect()}
    assert kept == similar_ids(texts)


def test_rows_of_one_document_keep_a_copy(spark):
    rng = random.Random(4)
    line = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    passage, alone, null = line(300), line(250), line(180)
    rows = [(5, passage), (5, passage), (5, passage), (7, alone + passage), (7, alone + passage), (None, null), (None, null), (9, line(40) + null)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    expected = repeats({-1 if i is None else i: t for i, t in rows})
    assert len(got) == len(rows)
    for r in got:
        assert (bytes(r.kept), r.n_removed, r.n_spans) == expected[-1 if r.doc_id is None else r.doc_id]
    assert {r.n_removed for r in got if r.doc_id in (5, None)} == {0}


def test_units_of_text_encode_like_whole_texts():
    import pyarrow as pa
    from tokenizers import Tokenizer

    from tallyframe.llm import token_files

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(12)
    odd = ["<|ENDOFTEXT|> a<|endoftext|>b", "It's don't 'S x'Re", "A,B. C!! d-e f_g_ H2O", "İstanbul ΣΑΣ É é É.", "x\x00y \x7f. a\x01,", "", "ſt K", "and...\"' (x) [Y]."]
    texts = odd + ["".join(rng.choices("aBcéÉ 's,.!<|>\n\t3", k=rng.randint(0, 40))) for _ in range(600)] + [None]
    ids, counts = token_files.encode_texts(pa.array(texts), path)
    assert [part.tolist() for part in np.split(ids, np.cumsum(counts)[:-1])] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    batches = [pa.RecordBatch.from_pylist([{"t": "x" * n}]) for n in (5, 1, 9)]
    assert [b.column(0).to_pylist() for b in token_files._packs(iter(batches))] == [["x" * 5, "x", "x" * 9]]


def test_full_cache_of_units_starts_again(monkeypatch):
    import pyarrow as pa

    from tallyframe.llm import token_files

    monkeypatch.setattr(token_files, "CACHE_UNITS", 5)
    units = token_files._Units(public_tokenizers.path("word_bpe_49k.json"))
    for words_ in (["a", "bc", "d"], ["bc", "e", "f", "a"], ["x", "y", "z", "u", "v", "w", "bc"], ["bc"]):
        starts, sizes, flat = units.ids(pa.array(words_, pa.large_string()))
        assert [flat[a : a + n].tolist() for a, n in zip(starts, sizes)] == [units.tokenizer.encode(w, add_special_tokens=False).ids for w in words_]


def test_pipeline_compares_the_members_of_simhash_classes(spark):
    from tallyframe.llm import shingle_join

    texts = planted_copies(5)
    prints = {i: simhash.fingerprint(t) for i, t in texts.items()}
    root = {i: i for i in prints}
    for _ in range(20):
        for i, j in ((i, j) for i in prints for j in prints if (prints[i] ^ prints[j]).bit_count() <= 4):
            root[i] = root[j] = min(root[i], root[j])
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    nodes = spark.createDataFrame([(i, signed(p)) for i, p in prints.items()], "node long, fp long")
    pairs = {(r.a, r.b) for r in shingle_join.class_pairs(nodes).collect()}
    assert pairs == {(root[i], i) for i in prints if root[i] != i} and len(pairs) > 10
    frame = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    batches = shingle_join._sketches(5)(iter(frame.select("doc_id", F.lit(0), "text").toArrow().to_batches()))
    assert [v for batch in batches for v in batch.column("fp").to_pylist()] == [signed(p) for p in prints.values()]
    assert {r.component_id for r in shingle_join.similar_documents(frame).collect()} == similar_ids(texts)


def test_candidates_and_links_of_a_band_are_no_more_than_its_members():
    """Texts of one family, most of them just too far apart, hold many pairs that sketches let through."""
    import pyarrow as pa

    from tallyframe.llm import shingle_join

    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefghij", k=4))
    base, texts = [word() for _ in range(300)], []
    for _ in range(40):
        copy = list(base)
        for at in rng.sample(range(300), 6):
            copy[at] = word()
        texts += [" ".join(copy), " ".join([*copy[:-1], word()])]
    texts = dict(enumerate(texts))
    sketched = next(shingle_join._sketches(5)(iter([pa.RecordBatch.from_pydict({"d": list(texts), "t": [0] * len(texts), "text": list(texts.values())})])))
    rows = sorted((key, node, sketch, bands) for node, sketch, bands in zip(*(sketched.column(n).to_pylist() for n in ("d", "sketch", "bands"))) for key in bands)
    rows = pa.RecordBatch.from_pylist([{"key": k, "node": n, "root": n, "sketch": s, "bands": b} for k, n, s, b in rows])
    least = 75
    pairs = sum(len(near) for k in set(rows.column("key").to_pylist()) for block in [rows.filter(pa.compute.equal(rows.column("key"), k))]
                for _, near in shingle_join._block_pairs(k, block.column("root").to_numpy(), *shingle_join._sketched(block), least))
    assert pairs > 1_000  # each pair once, over all bands
    sets = {i: shingle_join.shingles(t)[1].tobytes() for i, t in texts.items()}
    for cell_rows in (2048, 8):
        found = pa.Table.from_batches(shingle_join._candidates(least, cell_rows)(iter([rows[:500], rows[500:]]))).sort_by("cell")
        if cell_rows == 2048:
            assert len(found) <= len(rows)
        found = found.append_column("set", pa.array([sets[i] for i in found.column("node").to_pylist()], pa.binary()))
        links = [(r["a"], r["b"]) for b in shingle_join._forest(0.8, least)(iter(found.to_batches(max_chunksize=97))) for r in b.to_pylist()]
        assert len(links) < len(found)
        root = {i: i for i in texts}
        for _ in range(30):
            for a, b in links:
                root[a] = root[b] = min(root[a], root[b])
        assert set(root.values()) == similar_ids(texts) and len(set(root.values())) > 5


def test_the_rank_map_is_in_no_plan_and_rare_words_are_listed(spark, docs):
    got = bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS)
    assert len(got.select("ids")._jdf.queryExecution().optimizedPlan().toString()) < 100_000
    words_ = spark.createDataFrame([(["qxqzj", "the", "qxqzj"], ), (["zjqxv", "x" * 65], )], "words array<string>")
    listed, ids, sizes = bpe.frequent_words(words_, RANKS, bpe.rank_map(spark, ranks := bpe.read_ranks(RANKS)))
    assert sorted(listed.to_pylist()) == [b"qxqzj", b"zjqxv"]
    assert [part.tolist() for part in np.split(ids, np.cumsum(sizes)[:-1])] == [bpe.heap_ids(w, ranks) for w in listed.to_pylist()]
    none = bpe.frequent_words(words_.limit(0), RANKS, bpe.rank_map(spark, ranks))
    assert [len(part) for part in none] == [0, 0, 0]


def test_digests_of_ids_are_those_of_the_joined_decimals(spark):
    import hashlib

    rows = [(1, [0, 10, 50255, 7]), (2, []), (3, [5])]
    got = {r.i: r.h for r in spark.createDataFrame(rows, "i long, ids array<int>").select("i", bpe.ids_digest(F.col("ids")).alias("h")).collect()}
    assert got == {i: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() for i, ids in rows}


def test_words_merge_side_by_side_and_only_pairs_beside_a_merge_are_ranked_again(spark, docs):
    ranks = bpe.read_ranks(RANKS)
    at, of = bpe.rank_map(spark, ranks).value
    rng = random.Random(5)
    tokens = list(ranks)
    words_ = [bytes(rng.choices(b"adeinorst ", k=rng.randint(0, 40))) for _ in range(800)] + [bytes(rng.choices(range(256), k=9)) for _ in range(200)]
    words_ += [b"a" * n for n in range(65)] + [b"".join(rng.choices(tokens, k=3)) for _ in range(400)]
    words_ = [b"", *(w for w in words_ if w not in ranks), b""]
    looked_up = []

    class Watched:
        def __getitem__(self, places):
            looked_up.append(len(places))
            return of[places]

    sizes = np.array(list(map(len, words_)))
    letters = bpe._letters(ranks)[np.frombuffer(b"".join(words_), np.uint8)]
    ids, counts = bpe.merged_ids(letters, sizes, at, Watched())
    assert [part.tolist() for part in np.split(ids, np.cumsum(counts)[:-1])] == [bpe.heap_ids(w, ranks) for w in words_]
    assert sum(looked_up) < 3 * len(letters)
    none = np.zeros(0, np.int32)
    assert [len(part) for part in bpe.merged_ids(none, none, at, of)] == [0, 0]
    plan = bpe.encode(docs, RANKS, public_tokenizers.PATTERN)._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan and "Join" not in plan  # no fold a word in the interpreted expressions of Spark
