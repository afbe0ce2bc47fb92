"""Each operator against brute force, on defined cases, and on empty tables."""

import re
import zlib
from collections import Counter
from html.parser import HTMLParser
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from feedloom.llm import queries, tiling
from feedloom.llm.common import Scratch, table
from feedloom.llm.jaccard_join import bitmap, drop_near_copies, jaccard_join, overlap_bound
from feedloom.llm.lbl import Model, lbl_scores
from feedloom.llm.license_scan import license_scan
from feedloom.llm.packing import encoder, pack
from feedloom.llm.perplexity import perplexity
from feedloom.llm.quality_rules import Fixed, chunk_ratios, compression, passing, quality_rules
from feedloom.llm.site_style import Page, _place, body_text, extract, features, low_importance
from feedloom.llm.span_dedup import span_dedup, without_repeats
from feedloom.llm.textvec import NOT_ALNUM, mix, signed, words
from feedloom.llm.tiling import drop_leaks, leaks, tile
from feedloom.llm.toxicity import differences, marked, toxicity, values
from feedloom.llm.wordkn import PairModel, discounts
from tests.oracle import SF, same

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def lower(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def collect(df, *key):
    return {tuple(r[k] for k in key) if len(key) > 1 else r[key[0]]: r for r in df.collect()}


def docs_of(spark, texts, **columns):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumns({k: F.lit(v) for k, v in columns.items()})


@pytest.fixture(scope="module")
def corpus(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def texts(corpus):
    return {r["doc_id"]: r["text"] for r in corpus.collect()}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    same(spark, queries.queries()[name], queries.oracle_sql()[name])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB \n\té漢.\x00", max_size=30), max_size=6))
def test_words(ts):
    import pyarrow as pa

    got = [(w.first + i, [w.data[a:b].tobytes() for a, b in zip(w.start[w.of(w.first + i)], w.end[w.of(w.first + i)], strict=True)]) for w in words(pa.array(ts, pa.string()), 20) for i in range(w.last - w.first)]
    assert got == [(i, [x.encode() for x in WORD.findall(t)]) for i, t in enumerate(ts)]


# 1: license scans
def test_license_base_matches_brute_force(corpus, texts):
    phrases = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
    for r in license_scan(corpus).collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(texts[r["doc_id"]]))
        spots = [(i, k) for k, p in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        at = [i for i, _ in spots]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(at), min(at, default=None), max(at, default=None))
        assert r["base_labels"] == ",".join(sorted({k for _, k in spots}))
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_license_finds_inserted_words(spark, hard, none):
    df = docs_of(spark, ["Redistribution and use, in source and also binary forms, with or without modification are permitted provided that the following conditions are met", "nothing here at all", "Under the MIT License, under the MIT license"])
    got = collect(license_scan(df), "doc_id")
    assert got[0]["labels"] == "bsd" and got[0]["n_base"] == 0 and got[1]["labels"] == "" and got[1]["score"] == 0
    assert (got[2]["n_base"], got[2]["first_word"], got[2]["last_word"]) == (2, 0, 4)
    assert license_scan(hard).count() == hard.count() and license_scan(none).count() == 0


# 2: decontamination
def test_tile_marks_reordered_runs():
    item = np.arange(1, 41, dtype=np.uint64)
    text = np.concatenate([item[20:40], [0], item[0:18], [0]]).astype(np.uint64)
    assert tile(text, item, 5).sum() == 38
    assert tile(np.array([1, 2, 3, 0], np.uint64), item, 5).sum() == 0
    twice = np.array([7] * 10, np.uint64)
    assert tile(twice, twice, 5).sum() == 10 and tile(np.array([7] * 5 + [0], np.uint64), twice, 5).sum() == 5


def brute_tile(text, item, least):
    free_t, free_i = [True] * len(text), [True] * len(item)
    while True:
        best = (0, 0, 0)
        for b in range(len(item)):
            for a in range(len(text)):
                n = 0
                while a + n < len(text) and b + n < len(item) and text[a + n] == item[b + n] and free_t[a + n] and free_i[b + n]:
                    n += 1
                best = max(best, (n, -b, -a))
        n, b, a = best[0], -best[1], -best[2]
        if n < least:
            return free_i.count(False)
        free_t[a : a + n] = [False] * n
        free_i[b : b + n] = [False] * n


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=24), st.lists(st.integers(1, 3), min_size=1, max_size=16))
def test_tile_matches_brute_force_in_coverage(text, item):
    assert tile(np.array(text, np.uint64), np.array(item, np.uint64), 3).sum() == brute_tile(text, item, 3)


def test_leaks_match_brute_force(spark, monkeypatch):
    """Items cut up, reordered and repeated in texts, with tokens that very many items share; all pairs tiled by brute force."""
    rng = np.random.default_rng(9)
    common = [f"c{i}" for i in range(12)]
    items = {i: [*common, *(f"i{i}w{j}" for j in range(rng.integers(4, 30)))] if i % 2 else [f"i{i}w{j % 7}" for j in range(20)] for i in range(14)}
    texts = {}
    for d in range(60):
        item = items[int(rng.integers(14))]
        cuts = sorted(rng.integers(0, len(item), 2).tolist())
        parts = [item[: cuts[0]], item[cuts[0] : cuts[1]], item[cuts[1] :], common, [f"own{d}"] * 3]
        texts[d] = " ".join(w for p in rng.permutation(5)[: rng.integers(2, 6)] for w in [*parts[p], f"x{d}{p}"])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in items.items()], "item_id long, text string")
    want = {(d, i): brute_tile(t.split(), item, 5) for d, t in texts.items() for i, item in items.items()}
    want = {k: n for k, n in want.items() if n >= 0.6 * len(items[k[1]])}
    read = lambda: {(r["doc_id"], r["item_id"]): r["matched_tokens"] for r in leaks(docs, bench).collect()}
    assert read() == want and len(want) > 20
    monkeypatch.setattr(tiling, "SEEDS_SENT", 0)
    assert read() == want


def test_leaks(spark, hard, none, corpus, texts):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "one two"), (None, "a b c d e f g"), (3, None)], "item_id long, text string")
    df = docs_of(spark, ["so: Zeta eta, theta iota kappa lambda mu! then alpha beta gamma delta epsilon", "alpha beta gamma delta epsilon only", "clean text of other words entirely"])
    assert [(r["doc_id"], r["item_id"], r["matched_tokens"]) for r in leaks(df, bench).collect()] == [(0, 1, 12)]
    assert leaks(hard, bench).count() == 0 and leaks(none, bench).count() == 0 and leaks(df, bench.limit(0)).count() == 0
    assert drop_leaks(hard, bench).columns == hard.columns and drop_leaks(hard, bench).count() == hard.count()
    items = {r["item_id"]: r["text"] for r in table(spark, SF, "benchmark").collect()}
    got = {r["doc_id"] for r in leaks(corpus, table(spark, SF, "benchmark")).collect()}
    flat = lambda t: " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))) + " "
    assert {d for d, t in texts.items() if any(flat(i) in flat(t) for i in items.values())} <= got


# 3: n-gram Jaccard join
def test_bitmap_bound():
    rng = np.random.default_rng(1)
    for _ in range(50):
        pool = rng.integers(1, 2**63, 300, dtype=np.uint64)
        a, b = (np.unique(rng.choice(pool, 200)) for _ in range(2))
        x, y = bitmap(mix(a)), bitmap(mix(b))
        w = min(len(x), len(y))
        if len(x) == len(y) == w:
            assert overlap_bound(x, y, len(a), len(b)) >= len(np.intersect1d(a, b))


def brute_components(texts):
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(lower(t))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(sorted(texts), 2):
        shared = len(sets[a] & sets[b])
        if shared and 100 * shared >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in texts}


def test_jaccard_families_match_brute_force(spark):
    """Families of edited copies around the threshold, so that chains of links and groups without links occur."""
    rng = np.random.default_rng(5)
    texts = {}
    for family in range(6):
        base = [f"f{family}w{rng.integers(400)}" for _ in range(120)]
        for _ in range(14):
            copy = list(base)
            for at in rng.choice(120, rng.integers(1, 9), replace=False):
                copy[at] = f"e{rng.integers(10**6)}"
            texts[len(texts)] = " ".join(copy)
    texts |= {1000: "a b", 1001: "A  b", 1002: None, 1003: "", 1004: "a b c"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join(df).collect()}
    assert got == brute_components(texts)


def test_jaccard_defined_cases(hard, none):
    got = jaccard_join(hard).collect()
    assert len(got) == hard.count() and [r["component_id"] for r in got if r["doc_id"] == 2] == [1, 1]
    assert [(r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] in (3, 4, 5)] and all(r["n_shingles"] == 0 for r in got if r["doc_id"] in (3, 4, 5))
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]
    kept = drop_near_copies(hard)
    assert kept.columns == hard.columns and kept.count() == hard.count() - 2 and jaccard_join(none).count() == 0


# 4: LM scoring
def test_lbl_base_matches_brute_force(corpus, texts):
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in texts}
    tokens = {d: [*WORD.findall(lower(t)), None] for d, t in texts.items()}
    counts = Counter(w for d, ws in tokens.items() if not held[d] for w in ws)
    n, v = sum(counts.values()), len(counts)
    got = lbl_scores(corpus).collect()
    for r in got:
        ws = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(ws), sum(w in counts for w in ws), n)
        assert abs(r["base_score"] - sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in ws)) < 1e-6 * len(ws)
    out = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_lbl_probabilities_sum_to_one_and_nce_learns():
    m = Model(np.array([50, 30, 20, 10]))
    rng = np.random.default_rng(0)
    one = rng.integers(0, 4, 4096)
    word = (one + 1) % 4  # the next word follows from the one before
    for _ in range(60):
        m.step(one, one, word, rng.integers(0, 4, 16), 0.1)
    all_words = np.arange(4)
    for c in range(4):
        p = 10.0 ** m.log10(np.full(4, c), np.full(4, c), all_words)
        assert abs(p.sum() - 1) < 1e-4 and p[(c + 1) % 4] > 0.5


def test_lbl_defined_cases(spark, hard, none):
    got = lbl_scores(hard).collect()
    assert len(got) == hard.count() and all(r["n_tokens"] == 1 for r in got if r["doc_id"] in (3, 4, 5)) and all(r["score"] <= 0 for r in got)
    assert lbl_scores(none).count() == 0
    only_held = spark.createDataFrame([(d, "a b") for d in range(60) if zlib.crc32(str(d).encode()) % 7 == 2], "doc_id long, text string")
    assert {r["n_tokens"] for r in lbl_scores(only_held).collect()} == {3}


def test_lbl_long_texts_and_wide_ids(spark):
    rng = np.random.default_rng(3)
    texts = {i: " ".join(f"w{x}" for x in rng.integers(0, 1500, 4500)) for i in (-6 * 10**18, -5, 0, 7, 10**12, 6 * 10**18)}
    counts = Counter(w for d, t in texts.items() if zlib.crc32(str(d).encode()) % 7 != 2 for w in [*t.split(), None])
    n, v = sum(counts.values()), len(counts)
    got = collect(lbl_scores(spark.createDataFrame(list(texts.items()), "doc_id long, text string")), "doc_id")
    for d, t in texts.items():
        ws = [*t.split(), None]
        assert (got[d]["n_tokens"], got[d]["n_known"], got[d]["train_tokens"]) == (4501, sum(w in counts for w in ws), n)
        assert abs(got[d]["base_score"] - sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in ws)) < 1e-3


# 5: packing
def check_packing(rows, texts, exact=True):
    hf = Tokenizer.from_file(TOKENIZER)
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for d, pieces in by_doc.items() if exact else ():
        ids = [*hf.encode(texts[d] or "", add_special_tokens=False).ids, 1]
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048 and pieces[0]["padded_length"] == (at if at & (at - 1) == 0 else 2048)
    return by_sequence


def test_packing_round_trip(corpus, texts):
    got = pack(corpus.repartition(3), TOKENIZER).collect()
    sequences = check_packing(got, texts)
    assert sum(sum(p["length"] for p in s) < 2048 for s in sequences.values()) <= 1


def test_packing_keeps_proportions(spark):
    rows = [(i, "some words to be packed here " * 60, "a" if i % 4 else "b") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(2)
    got = pack(df, TOKENIZER, piece=64).filter("padded_length = 2048").groupBy("sequence_id").agg(F.sum(F.when(F.col("source") == "b", F.col("length")).otherwise(0)).alias("b"), F.sum("length").alias("n")).filter("n = 2048").collect()
    shares = [r["b"] / r["n"] for r in got]
    assert len(shares) > 50 and abs(np.mean(shares) - 0.25) < 0.02 and np.mean([abs(s - 0.25) < 0.1 for s in shares]) > 0.9


def test_packing_mixes_a_table_in_order_of_its_sources(spark):
    """Files of one source each, and more sources than queues: windows still hold the target shares, and pieces their source."""
    rows = [(i, f"w{i} some words to be packed here " * 40, f"s{0 if i < 300 else 1 + i % 1500}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartitionByRange(6, "doc_id")
    got = pack(df, TOKENIZER, piece=32).collect()
    assert {r["doc_id"]: r["source"] for r in got} == {i: s for i, _, s in rows}
    shares = [sum(r["length"] for r in p if r["source"] == "s0") / sum(r["length"] for r in p) for p in check_packing(got, {i: t for i, t, _ in rows}).values() if sum(r["length"] for r in p) == 2048]
    assert len(shares) > 50 and abs(np.mean(shares) - 1 / 3) < 0.05 and np.mean([0.1 < s < 0.6 for s in shares]) > 0.8


def test_packing_defined_cases(hard, none):
    got = pack(hard, TOKENIZER).collect()
    assert sum(r["length"] for r in got if r["doc_id"] == 3) == 1 and sum(r["length"] for r in got if r["doc_id"] == 2) == 2 * next(r["doc_tokens"] for r in got if r["doc_id"] == 2)
    assert pack(none, TOKENIZER).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=20), st.sampled_from(["<|endoftext|>", "<|", "endoftext", " <|endoftext|> "])), max_size=6))
def test_encoder_equals_tokenizers(parts):
    t = "".join(parts).encode("utf-8", "ignore").decode()
    assert encoder(TOKENIZER).encode_to_numpy(t, allowed_special="all").tolist() == Tokenizer.from_file(TOKENIZER).encode(t, add_special_tokens=False).ids


# 6: quality rules
def test_quality_matches_brute_force(corpus, texts):
    for r in quality_rules(corpus).collect():
        t = texts[r["doc_id"]] or ""
        w = WORD.findall(t)
        n = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {j for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r["base_failed"] and r["kept"])


def test_quality_compression(spark, hard, none):
    rng = np.random.default_rng(3)
    prose = " ".join("".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 9))) for _ in range(900))
    noise = " ".join("".join(map(chr, rng.integers(0x4E00, 0x9000, 6))) for _ in range(900))
    listed = " ".join("a" * 40 + str(i) for i in range(300))
    got = collect(quality_rules(docs_of(spark, [prose, noise, listed])), "doc_id")
    assert got[0]["kept"] and not got[2]["kept"] and not got[2]["base_failed"] and got[2]["ratio"] > 3.2
    assert quality_rules(hard).count() == hard.count() and passing(hard).columns == hard.columns and quality_rules(none).count() == 0
    assert all(not r["kept"] for r in quality_rules(hard).filter("doc_id IN (3, 4, 5)").collect())


def test_quality_bands_reject_noise(spark):
    rng = np.random.default_rng(5)
    syllables = ["".join(rng.choice(list("etaoinshrdlu"), 3)) for _ in range(60)]
    texts = []
    for n in np.geomspace(60, 1500, 300).astype(int):
        texts.append(" ".join("".join(rng.choice(syllables, 2)) for _ in range(n)))
    mixed = ["".join(w + rng.choice(["### ", "%%% ", "&&& ", " | "]) for w in t.split()) for t in texts[160::10]]  # the ratios do not tell shorter ones apart
    random = [" ".join("".join(map(chr, rng.integers(0x4E00, 0x9000, 6))) for _ in range(n)) for n in (50, 60, 300, 900)]
    tail = [t[:6000] + "".join(map(chr, rng.integers(0x4E00, 0x9000, 1365))) for t in texts if len(t) > 6200][:5]
    docs = docs_of(spark, texts + mixed + random + tail, lang="xx")
    labels = spark.createDataFrame([(i, 1) for i in range(len(texts))], "doc_id long, quality int")
    got = collect(quality_rules(docs, labels), "doc_id")
    kept = [got[i]["kept"] for i in range(len(got))]
    assert not any(got[i]["base_failed"] for i in got if i < len(texts) + len(mixed))
    assert np.mean(kept[: len(texts)]) > 0.97 and not any(kept[len(texts) :])
    assert {r["doc_id"] for r in passing(docs, labels).select("doc_id").collect()} == {i for i in got if kept[i]}
    assert {i: r["kept"] for i, r in collect(quality_rules(docs.drop("lang"), labels), "doc_id").items()} == dict(enumerate(kept))


def test_quality_last_chunk_is_judged():
    prose = bytes(np.random.default_rng(1).choice(np.frombuffer(b"etaoin shrdlu", np.uint8), 9000))
    zstd = zstandard.ZstdCompressor(level=3)
    assert [len(chunk_ratios(prose[:n], zstd)) for n in (100, 4095, 4096, 4097, 8192, 9000)] == [0, 0, 1, 2, 2, 3]
    assert chunk_ratios(prose[:5000] + b"a" * 4000, zstd)[-1] > 30 and compression(b"ab " * 120, zstd, Fixed())[2] is False


# 7: perplexity
def brute_pairs(taught, texts):
    """Interpolated modified Kneser-Ney over word pairs, from dictionaries: log-likelihood of each text."""
    chain = lambda t: ["<s>", *WORD.findall(lower(t)), "</s>"]
    pairs = Counter(p for t in taught for p in zip(chain(t), chain(t)[1:], strict=False))
    follows = Counter(b for _, b in pairs)
    times = lambda c: [sum(n == i for n in c.values()) for i in (1, 2, 3, 4)]
    d, e = discounts(*times(pairs)), discounts(*times(follows))
    take = lambda n, d: d[min(n, 3) - 1] if n else 0
    free = sum(take(n, e) for n in follows.values()) / sum(follows.values()) / (len(follows) + 1)
    p = lambda w: (follows[w] - take(follows[w], e)) / sum(follows.values()) + free
    total, taken = Counter(), Counter()
    for (a, _), n in pairs.items():
        total[a] += n
        taken[a] += take(n, d)
    q = lambda a, b: (pairs[a, b] - take(pairs[a, b], d) + taken[a] * p(b)) / total[a] if total[a] else p(b)
    known = [*follows, "unseen word"]
    assert all(abs(sum(q(a, b) for b in known) - 1) < 1e-9 for a in [*list(total)[:5], "unseen word"])
    return {i: sum(np.log(q(a, b)) for a, b in zip(chain(t), chain(t)[1:], strict=False)) for i, t in texts.items()}


def test_pair_model_matches_brute_force(spark, texts):
    some = {i: t for i, t in texts.items() if i < 120}
    taught = [t for i, t in some.items() if i % 3]
    rows = spark.createDataFrame([(t,) for t in taught], "text string").repartition(3)
    docs = spark.createDataFrame([(i, "en", t) for i, t in some.items()], "doc_id long, lang string, text string")
    want = brute_pairs(taught, some)
    scratch = Scratch(spark)
    got = PairModel(lambda: rows, 40 << 20, scratch).score(docs, "doc_id long, lang string").collect()
    assert len(got) == len(some)
    for r in got:
        assert r["n"] == len(WORD.findall(lower(some[r["doc_id"]]))) + 1 and r["loglik"] == pytest.approx(want[r["doc_id"]], rel=1e-9)


def test_perplexity_keeps_clean_text(spark, corpus, hard, none):
    labels = table(spark, SF, "labels")
    got = perplexity(corpus, labels).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    share = {r["quality"]: r["kept"] for r in got}
    assert share[1] > 0.9 and share[0] < share[1]
    assert perplexity(hard, labels).count() == hard.count() and all(r["perplexity"] is None and not r["kept"] for r in perplexity(hard, labels).filter("doc_id IN (3, 4)").collect())
    assert perplexity(none, labels).count() == 0 and perplexity(corpus.limit(5), labels.limit(0)).filter("kept").count() > 0


# 8: HTML extraction
def test_body_text():
    page = "<html><head><title>T</title><style>p{}</style></head><body><nav><a href='/'>Home</a></nav><div class='ad'>Buy</div><article><header><h1>Big &amp; bold</h1></header><p>One<br>two  <b>three</b>.<p>Last&nbsp;one &#8212; end<div class='comments'><p>Nice!</p></div></article><aside>side</aside><footer>&copy; me</footer>"
    assert body_text(page, set()) == "Big & bold\n\nOne two three.\n\nLast\xa0one — end"
    assert body_text(None, set()) == "" and body_text("", set()) == "" and body_text("just text", set()) == "just text"
    assert body_text("<p>a</p><script>if (a < b) '</p>'</script><p>b &lt; c", set()) == "a\n\nb < c"


def test_site_style_removes_what_pages_share(spark, none):
    page = "<body><div class='top'><p>Welcome to the site of all sites</p></div><div class='text'><p>{}</p></div><div class='bottom'><a href='/about'>About us</a></div></body>"
    rows = [(i, f"https://h.example/{i}", page.format(f"Story number {i} with its own words {i * 7}")) for i in range(20)] + [(99, None, None), (100, "x", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = collect(extract(df), "page_id")
    assert got[3]["text"] == "Story number 3 with its own words 21" and got[3]["n_chars"] == len(got[3]["text"])
    assert got[99]["text"] == "" and got[100]["text"] == "" and extract(df.limit(0)).count() == 0


def test_pages_give_their_article(spark):
    pages = table(spark, SF, "pages")
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in extract(pages).collect():
        article = html[r["page_id"]].split("<article>")[1].split("</article>")[0]
        from html import unescape

        blocks = [re.sub(r"[ \t\n\x0b\x0c\r]+", " ", unescape(re.sub(r"<(?!/?p|/?h1)[^>]*>", "", b.replace("<br>", " ")))).strip() for b in re.split(r"</?(?:p|h1)>", article)]
        assert r["text"] == "\n\n".join(b for b in blocks if b)


@pytest.mark.parametrize(("copies", "others"), [(5, 0), (5, 20), (1000, 200)])
def test_copies_of_a_page_keep_their_text(spark, copies, others):
    page = "<body><div class='top'><p>Welcome to the site of all sites</p></div>{}</body>"
    article = "<article><h1>Title {0}</h1><p>Story number {0} with words {1}</p></article>"
    block = "<div class='text'><p>Story number {0} with words {1}</p></div>"
    made = [page.format((article if i % 2 else block).format(i, i * 7)) for i in range(others)] + [page.format(article.format("copied", "of many"))] * copies
    got = collect(extract(spark.createDataFrame([(i, f"https://h.example/{i}", h) for i, h in enumerate(made)], "page_id long, url string, html string")), "page_id")
    for i in range(others):
        assert got[i]["text"] == (f"Title {i}\n\n" if i % 2 else "") + f"Story number {i} with words {i * 7}"
    assert {got[i]["text"] for i in range(others, len(made))} == {"Title copied\n\nStory number copied with words of many"}


def test_low_score_spares_body_and_article():
    html = "<body>Own words<article><p>In the article</p></article></body>"
    every = {n.path for n in Page(html).nodes}
    assert body_text(html, every) == "In the article" and body_text("<body>Own words</body>", every) == "Own words"


@pytest.mark.parametrize(
    "page",
    [
        "<body class='has-sidebar'><article><p>Keep this</p></article></body>",
        "<body class='comments-open'><p>Keep this</p></body>",
        "<main class='with-sidebar'><p>Keep this</p></main>",
        "<article class='sidebar'><p>Keep this</p></article>",
        "<div class='social-science'><p>Keep this</p></div>",
        "<div class='x'><p>Keep this</p></div><div class='nav-menu'>Menu</div><div id='site-footer'>Foot</div><div class='sidebar-left'>Side</div>",
    ],
)
def test_names_do_not_delete_pages(page):
    assert body_text(page, set()) == "Keep this"


def test_main_names_math_and_depth():
    assert body_text("<div class='text'><p>The article</p></div><div class='main-image'>Caption</div>", set()) == "The article\n\nCaption"
    assert body_text("<article><p>As <math><mi>x</mi></math> is</p></article>", set()) == "As x is"
    import time

    began = time.perf_counter()
    assert body_text("<div>x" * 20_000, set()).count("x") == 20_000 and len(features("<div>x" * 20_000)[2]) == 20_000
    assert time.perf_counter() - began < 5


def brute_low(pages):
    """The elements and blocks of low importance of each host, by the formula, from dictionaries."""
    seen, low = {}, {}
    for host, html in {(h, x) for h, x in pages if x}:
        for kind, pairs in enumerate(features(html)):
            for e, f in pairs:
                c = seen.setdefault((host, e), [Counter() for _ in range(5)])[kind]
                c[f] += 1
    for (host, e), (shown, linked, held, inside, headings) in seen.items():
        m = sum(shown.values())
        if m < 5:
            continue
        presentation = -sum(n / m * np.log(n / m) / np.log(m) for n in shown.values())
        both = [*linked.values(), *held.values(), *inside.values(), *headings.values()]
        content = 1 - (sum(n * np.log(n) for n in both) / sum(both) / np.log(m) if both else 0)
        if 0.1 * presentation + 0.9 * content < 0.2 - 1e-12:
            low.setdefault(host, set()).add(e)
        for f, n in held.items():
            if 1 - np.log(n) / np.log(m) < 0.2 - 1e-12:
                low.setdefault(host, set()).add(_place(e, f))
        for f, n in inside.items():
            if n >= 0.9 * m:
                low.setdefault(host, set()).add(_place(e, f))
    return low


@pytest.mark.parametrize(("share", "total"), [(50, 100), (800, 4000), (85, 100)])
def test_articles_keep_what_many_of_them_say(spark, share, total):
    page = "<body><div class='top'><p>Welcome to the site of all sites</p></div><article><h1>Dish {0}</h1>{1}<p>Take {0} eggs and stir {2} times</p><p>Printed from our kitchen</p></article></body>"
    part = "<h2><b>Ingredients</b></h2><p>Salt and pepper</p><p>Serves four</p>"
    rows = [(i, f"https://h.example/{i}", page.format(i, part if i < share else "", i * 7)) for i in range(total)]
    got = collect(extract(spark.createDataFrame(rows, "page_id long, url string, html string")), "page_id")
    for i in (0, share - 1, share, total - 1):
        common = "Ingredients\n\nSalt and pepper\n\nServes four\n\n" if i < share else ""
        assert got[i]["text"] == f"Dish {i}\n\n{common}Take {i} eggs and stir {i * 7} times"  # what every page prints goes


def test_importance_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    pages = []
    for h in range(3):
        for i in range(8 + 6 * h):
            box = "<p>Read our magazine every day</p>" if h else f"<p>{rng.integers(99)}</p>"
            rows = "".join(f"<li><a href='/{rng.integers(3)}'>{rng.choice(['one', 'two'])}</a></li>" for _ in range(rng.integers(1, 4)))
            pages.append((f"h{h}", f"<body><div class='a'><ul>{rows}</ul></div><article><h1>T{i}</h1><p>Text {i} of {h}</p>{box}</article><div class='b'><p>Same</p></div></body>"))
    pages += pages[:3] + [("h0", None), ("h9", "<p>alone</p>")]
    got = {r["host"]: {x % 2**64 for x in r["elements"]} for r in low_importance(spark.createDataFrame(pages, "host string, html string")).collect()}
    assert got == brute_low(pages)
    assert body_text(pages[-3][1], got["h0"]) != "" and "magazine" not in body_text(pages[20][1], got["h1"]) and "Text" in body_text(pages[20][1], got["h1"])


def test_plain_tags_pass_by_the_tolerant_parser(monkeypatch):
    rng = np.random.default_rng(6)
    bits = ["<p>", "</p>", '<div class="menu">', "</div>", '<DIV Class="a" class="b">', '<header id="main">', "</header>", '<a href="x?a=1&amp;b">', '<img src="y" class="ad">', "<li hidden>", "<br/>", "<br>", "<script>", "</script>"]
    bits += ["<title>", "</title>", '<p a="1"b="2">', "<!--", "-->", "&amp;", "&lt", "<", ">", '"', " ", "\n", "\xa0", "word", "two  words"]
    made = ["".join(rng.choice(bits, rng.integers(1, 25))) for _ in range(1500)]
    asked, tolerant = [], HTMLParser.parse_starttag
    monkeypatch.setattr(HTMLParser, "parse_starttag", lambda self, i: asked.append(i) or tolerant(self, i))
    fast = [features(x) for x in made]
    asked.clear()
    assert body_text('<body><div class="post"><h1>One</h1><p>Two  words\n</p></div></body>', set()) == "One\n\nTwo words" and not asked
    monkeypatch.setattr("feedloom.llm.site_style.START", re.compile("(?!)"))
    monkeypatch.setattr("feedloom.llm.site_style.END", re.compile("(?!)"))
    assert [features(x) for x in made] == fast and len(asked) > 1500


# 9: toxicity
def test_toxicity_learns(spark, none, hard):
    rng = np.random.default_rng(4)
    pool = ["".join(rng.choice(list("etaoinshr"), 5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(900):
        w = list(rng.choice(pool, 60))
        toxic = i % 3 == 0
        if toxic:
            for at in rng.choice(60, 3, replace=False):
                w[at] = rng.choice(["jerkface", "dumbhead", "vilething"])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity(docs, marks).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([(r["doc_id"] % 3 == 0) == bool(r["predicted"]) for r in held]) > 0.9
    assert all(r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in got)
    flipped = marks.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")).cast("int"))
    assert {r["doc_id"]: r["score"] for r in toxicity(docs, flipped).collect()} == {r["doc_id"]: r["score"] for r in got}
    assert toxicity(hard, marks).count() == hard.count() and toxicity(none, marks).count() == 0
    assert {r["score"] for r in toxicity(docs.limit(3), marks.limit(0)).collect()} == {0.5}


def test_toxicity_matches_brute_force(spark):
    rng = np.random.default_rng(8)
    pool = [f"w{i}" for i in range(200)]
    made = [(i, " ".join([*rng.choice(pool, 30), *(rng.choice(["foo!", "Bar", "baz"], 2) if i % 3 == 0 else []), *(["rare"] if i in (0, 3) else [])]), int(i % 3 == 0)) for i in range(240)]
    sets = [(set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))), y) for _, t, y in made]
    n = [Counter(w for s, y in sets if y == c for w in s) for c in (0, 1)]
    both, size = n[0] + n[1], [sum(x.values()) for x in n]
    least, total = min(size), sum(size)
    d = discounts(*(sum(x == i for x in both.values()) for i in (1, 2, 3, 4)))
    take = lambda x: d[min(x, 3) - 1]
    rest = sum(take(x) for x in both.values()) / total / (len(both) + 1)
    freed = [sum(min(x * least / s, 2.0) for x in c.values()) / least for c, s in zip(n, size, strict=True)]

    def value(w):
        if w not in both:
            return 0.0
        shared = (both[w] - take(both[w])) / total + rest
        p = [max(c[w] * least / s - 2.0, 0) / least + f * shared for c, s, f in zip(n, size, freed, strict=True)]
        return max(np.log(p[1] / p[0]) - 0.5 * np.log(total / (least * freed[0])), 0.0)

    rows = spark.createDataFrame([(y, w, x) for y in (0, 1) for w, x in ((signed(next(words(pa.array([w]), separators=NOT_ALNUM)).hash)[0].item(), x) for w, x in n[y].items())], "kind int, word long, n long")
    docs = spark.createDataFrame([(i, t) for i, t, _ in made] + [(900, None), (901, "nothing known")], "doc_id long, text string")
    got = {r["doc_id"]: r["mark"] for r in marked(docs, values(rows, (0, 1), "mark"), ("mark",)).collect()}
    assert len(got) == 242 and got[900] == got[901] == 0 and value("rare") == 0 < value("foo")
    for (i, _, _), (s, _) in zip(made, sets, strict=True):
        assert got[i] == pytest.approx(sum(map(value, s)) / len(s), rel=1e-9)


def test_toxicity_counts_the_whole_difference(spark):
    rng = np.random.default_rng(9)
    pool = [f"w{i}" for i in range(200)]
    made = [(" ".join([*rng.choice(pool, 30), *(["foo", "baz"] if i % 10 == 0 else ["calm"]), *(["rare"] if i in (0, 10) else [])]), int(i % 10 == 0)) for i in range(240)]
    sets = [(set(t.split()), y) for t, y in made]
    n = [Counter(w for s, y in sets if y == c for w in s) for c in (0, 1)]
    both, size = n[0] + n[1], [sum(x.values()) for x in n]
    total, d = sum(size), discounts(*(sum(x == i for x in both.values()) for i in (1, 2, 3, 4)))
    take = lambda x: d[min(x, 3) - 1] if x else 0.0
    rest = sum(map(take, both.values())) / total / (len(both) + 1)
    kept = [{w: max(c[w] - take(c[w]) - both[w] * (s / total) ** 0.4, 0.0) for w in both} for c, s in zip(n, size, strict=True)]
    freed = [1 - sum(k.values()) / s for k, s in zip(kept, size, strict=True)]
    p = [{w: kept[c][w] / size[c] + freed[c] * ((both[w] - take(both[w])) / total + rest) for w in both} for c in (0, 1)]
    value = {w: np.log(p[1][w] / p[0][w]) - np.log(freed[1] / freed[0]) for w in both}
    assert value["calm"] < 0 < value["rare"] < value["foo"] and sum(abs(x) > 1e-9 for x in value.values()) < len(both)

    number = lambda w: signed(next(words(pa.array([w]), separators=NOT_ALNUM)).hash)[0].item()
    rows = spark.createDataFrame([(y, number(w), x) for y in (0, 1) for w, x in n[y].items()], "kind int, word long, n long")
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(made)] + [(900, None), (901, "nothing known")], "doc_id long, text string")
    got = {r["doc_id"]: r["mark"] for r in marked(docs, differences(rows, (0, 1), "mark"), ("mark",)).collect()}
    assert len(got) == 242 and got[900] == got[901] == 0 and min(got.values()) < 0
    for i, (s, _) in enumerate(sets):
        assert got[i] == pytest.approx(sum(value[w] for w in s) / len(s), rel=1e-9, abs=1e-12)
    assert differences(rows.filter("kind = 0"), (0, 1), "mark").count() == 0


def test_toxicity_counts_repeated_words(spark):
    rng = np.random.default_rng(10)
    pool = [f"w{i}" for i in range(60)]
    made = [(i, " ".join([*rng.choice(pool, 30), *(["foo!"] * (i % 4) if i % 5 == 0 else ["calm,"] * (i % 3)), "Foo"]), int(i % 5 == 0)) for i in range(240)] + [(900, None, 0), (901, "nothing known", 1)]
    texts = [(i, re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or "")), y) for i, t, y in made]
    n = [Counter(w for i, s, y in texts if y == c and zlib.crc32(str(i).encode()) % 3 != 1 for w in s) for c in (0, 1)]
    both, size = n[0] + n[1], [sum(x.values()) for x in n]
    total, d = sum(size), discounts(*(sum(x == i for x in both.values()) for i in (1, 2, 3, 4)))
    take = lambda x: d[min(x, 3) - 1] if x else 0.0
    rest = sum(map(take, both.values())) / total / (len(both) + 1)
    kept = [{w: max(c[w] - take(c[w]) - both[w] * (s / total) ** 0.4, 0.0) for w in both} for c, s in zip(n, size, strict=True)]
    freed = [1 - sum(k.values()) / s for k, s in zip(kept, size, strict=True)]
    p = [{w: kept[c][w] / size[c] + freed[c] * ((both[w] - take(both[w])) / total + rest) for w in both} for c in (0, 1)]
    value = {w: np.log(p[1][w] / p[0][w]) - np.log(freed[1] / freed[0]) for w in both}

    docs = spark.createDataFrame([x[:2] for x in made], "doc_id long, text string")
    got = {r["doc_id"]: r["mark"] for r in toxicity(docs, spark.createDataFrame([(i, 1, y) for i, _, y in made], "doc_id long, quality int, toxic int")).collect()}
    assert len(got) == 242 and got[900] == 0 and any(len(s) > len(set(s)) for _, s, _ in texts)
    for i, s, _ in texts:
        assert got[i] == pytest.approx(sum(value.get(w, 0.0) for w in s) / max(len(s), 1), rel=1e-9, abs=1e-12)


# 10: substring dedup
def brute_spans(texts, min_words=20):
    """Sentences as word lists, spans as (key, doc, first, stop); which sentences go."""
    sentences = {}
    for d, t in texts.items():
        parts = [WORD.findall(lower(x)) for x in re.sub(r"([.!?])[\x20\x09-\x0D]+", r"\1\n", t or "").split("\n")]
        sentences[d] = [p for p in parts if p]
    seen, gone = {}, {d: set() for d in texts}
    for d in sorted(texts):
        s = sentences[d]
        words_of = lambda i, j: sum(len(x) for x in s[i:j])  # noqa: E731, B023
        runs = {(i, min(j for j in range(i + 1, len(s) + 1) if words_of(i, j) >= min_words)) for i in range(len(s)) if words_of(i, len(s)) >= min_words}
        runs |= {(max(i for i in range(j) if words_of(i, j) >= min_words), j) for j in range(1, len(s) + 1) if words_of(0, j) >= min_words}
        for i, j in sorted(runs):
            key = tuple(w for x in s[i:j] for w in x)
            if key in seen and seen[key] != (d, i):
                gone[d].update(range(i, j))
            seen.setdefault(key, (d, i))
    return sentences, gone


def test_spans_match_brute_force(corpus, texts):
    sentences, gone = brute_spans(texts)
    for r in span_dedup(corpus).collect():
        d = r["doc_id"]
        assert (r["n_sentences"], r["n_removed"], r["changed"]) == (len(sentences[d]), len(gone[d]), bool(gone[d]))
        left = [w for i, s in enumerate(sentences[d]) if i not in gone[d] for w in s]
        assert WORD.findall(lower(r["text"])) == left
        if not gone[d]:
            assert r["text"] == texts[d]


def test_spans_defined_cases(spark, hard, none):
    passage = "First a sentence that is shared by them all. Then another one with quite a few more words. And a third one closes it here."
    got = collect(span_dedup(docs_of(spark, [f"Own start. {passage} Own end.", f"Other begin. {passage} Other end.", f"{passage}\n{passage}"])), "doc_id")
    assert not got[0]["changed"] and got[1]["text"] == "Other begin. Other end." and got[2]["text"].strip() == ""
    tail = "These are the words of the first long sentence of a passage that stands in two texts one two three. Four more words here. And two. This one has again more than twenty words so that the run from the sentence before it ends in it yes. Not so long."
    got = collect(span_dedup(docs_of(spark, [f"Start here. {tail}", f"{tail} Something else follows.", tail])), "doc_id")
    assert [got[i]["n_removed"] for i in range(3)] == [0, 5, 5]
    rows = [(1, passage), (2, f"{passage} More here."), (2, "This is something else. It shares nothing with the others at all.")]
    got = {r.text: r.n_removed for r in span_dedup(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert got[rows[0][1]] == 0 and got[rows[2][1]] == 0 and " More here." in got  # rows of one id are cut each by its own spans
    assert span_dedup(hard).count() == hard.count() and span_dedup(none).count() == 0
    out = without_repeats(hard)
    assert out.columns == hard.columns and [r["text"] for r in out.filter("doc_id = 3").collect()] == [None]


# The pipeline
def test_pipeline_stages(spark, corpus, tmp_path):
    docs = corpus
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        assert docs.columns == corpus.columns and docs.join(before.select("doc_id"), "doc_id", "left_anti").count() == 0, name
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert 0.3 * corpus.count() < len(kept) < corpus.count()
    assert not any(gone for gone in brute_spans(kept)[1].values())
    check_packing(corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect(), kept, exact=False)
