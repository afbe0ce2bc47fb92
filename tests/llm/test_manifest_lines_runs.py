"""The Merkle manifest, line dedup and periodic runs against plain versions."""

import hashlib
import random
import zlib
from collections import Counter
from fractions import Fraction

import pytest

from feedloom.llm import line_dedup as L
from feedloom.llm import merkle as M
from feedloom.llm import queries
from feedloom.llm import runs as R
from feedloom.llm.common import table
from tests.llm.conftest import DOCS
from tests.oracle import SF, same


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_line_dedup"])
def test_query_matches_sql(spark, name):
    same(spark, getattr(queries, name), queries.oracle_sql()[name], "/root/testdata/sf0.01")


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_proof(nodes, at):
    """(siblings from the leaf to the root, root, fold) of a tree of threes."""
    out, steps = [], []
    while len(nodes) > 1:
        first = at // 3 * 3
        run = nodes[first : first + 3]
        out += run[: at - first] + run[at - first + 1 :]
        steps.append((run[: at - first], run[at - first + 1 :]))
        nodes, at = [sha(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)], at // 3

    def fold(x):
        for left, right in steps:
            x = sha(*left, x, *right)
        return x

    return out, nodes[0], fold


def plain_manifest(rows):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    leaves = {s: sorted(((r[0] is not None, r[0] or 0, plain_leaf(r), r) for r in rows if r[1] == s), key=lambda x: x[:3]) for s in sources}
    digests = {s: [x[2] for x in leaves[s]] for s in sources}
    tops = [plain_proof(digests[s], 0)[1] for s in sources]
    out = []
    for i, s in enumerate(sources):
        upper, root, top_fold = plain_proof(tops, i)
        for place, (*_, leaf, row) in enumerate(leaves[s]):
            lower, subroot, fold = plain_proof(digests[s], place)
            cut = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None
            shown = plain_leaf((*row[:4], row[4].replace("\n", ""))) if cut else leaf
            back = top_fold(fold(shown))
            out.append((row[0], leaf, subroot, root, sha(*lower, *upper), back, back == root))
    return sorted(out, key=repr)


def manifest_rows(spark, rows):
    df = spark.createDataFrame([(r[0], r[4], r[2], r[1], r[3]) for r in rows], DOCS)
    return sorted((tuple(r) for r in M.merkle_manifest(df).collect()), key=repr)


@pytest.mark.parametrize("sizes", [[1], [1, 2, 3, 4], [800, 27, 28]])
def test_manifest_equals_plain_trees(spark, sizes):
    rows = [(i * 3 + k, f"s{k}", "en", i, f"line {i}\nof {k}") for k, n in enumerate(sizes) for i in range(n)]
    assert manifest_rows(spark, rows) == plain_manifest(rows)


def test_manifest_of_nulls_ties_and_odd_texts(spark):
    rows = [(1, None, None, None, None), (None, "b", "en", 3, "x\ny"), (None, "b", "en", 3, "x\ny"), (2, "b", "de", None, ""), (2, "b", "de", None, "z\n"), (3, "é", "fr", 1, "ü\n" * 9), (4, "z", "fr", 1, "long\n" * 50_000), (-5, "", "", 0, "-")]
    assert manifest_rows(spark, rows) == plain_manifest(rows)


def test_manifest_sees_a_changed_text(spark):
    docs = table(spark, SF, "documents")
    out = M.merkle_manifest(docs).join(docs.select("doc_id", "text"), "doc_id").collect()
    for r in out:
        assert r.verified == (zlib.crc32(str(r.doc_id).encode()) % 2 == 1 or "\n" not in r.text)
    assert len({r.root for r in out}) == 1 and any(not r.verified for r in out)


def plain_lines(texts, least=10, points=1):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    counts = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")})
    kept = [[x for x in (t or "").split("\n") if len(key(x)) < points or counts[key(x)] < least] for t in texts]
    return [((t or "").count("\n") + 1, (t or "").count("\n") + 1 - len(k), "\n".join(k)) for t, k in zip(texts, kept, strict=True)]


def test_lines_equal_plain_counts(spark):
    random.seed(5)
    pool = ["Share this", " share THIS\t", "É bien", "é bien", "", " \t", "漢字", *(f"own {i}" for i in range(40))]
    texts = ["\n".join(random.choice(pool) for _ in range(random.randrange(1, 9))) for _ in range(60)] + [None, "", "\n", "a" * 9000 + "\nshare this"]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    for least, points in ((10, 1), (3, 1), (3, 5), (2, 0)):
        got = {r.doc_id: (r.n_lines, r.n_dropped, r.text or "") for r in L.without_frequent_lines(df, least, points).collect()}
        if points:
            assert [got[i] for i in range(len(texts))] == plain_lines(texts, least, points)
    assert [r.kept_sha256 for r in L.line_dedup(df).orderBy("doc_id").collect()] == [sha(t) for *_, t in plain_lines(texts)]


def test_lines_of_rows_that_share_an_id_or_a_text(spark):
    rows = [(1, "same\nmine", "en", "a", 1)] * 9 + [(1, "same\nother", "en", "a", 1), (None, "same", "en", "a", 1), (2, None, "en", "a", 1)]
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in L.without_frequent_lines(spark.createDataFrame(rows, DOCS)).collect())
    assert got == {(1, 2, 1, "mine"): 9, (1, 2, 1, "other"): 1, (None, 1, 1, ""): 1, (2, 1, 0, None): 1}


def plain_runs(x, least=24, exponent=3):
    """Every period tried at every place; multiples of a period that already explains a stretch are left out."""
    found = []
    for p in range(1, len(x) // 2 + 1):
        i = 0
        while i + p < len(x):
            s = i
            while i + p < len(x) and x[i] == x[i + p]:
                i += 1
            if i - s >= p and not any(a <= s and i + p <= a + n and p % q == 0 for a, n, q in found):
                found.append((s, i + p - s, p))
            i += 1
    return sorted((r for r in found if r[1] >= max(least, exponent * r[2])), key=lambda r: (r[0], r[2]))


def strings():
    random.seed(3)
    for k in range(1500):
        n, letters = random.randrange(0, 90), random.choice([1, 2, 2, 3, 5])
        x = []
        while len(x) < n:
            word = [random.randrange(letters) for _ in range(random.randrange(1, 9))]
            x += word * random.randrange(1, 2 if k % 3 == 0 else 9)
        yield x


def test_lyndon_arrays_and_matches():
    for x in list(strings())[:400]:
        suffixes = [[*x[i:], -1] for i in range(len(x) + 1)]
        for i, (j, e) in enumerate(zip(*R.next_smaller(x), strict=True)):
            assert j == next(k for k in range(i + 1, len(x) + 1) if suffixes[k] < suffixes[i])
            assert x[i : i + e] == x[j : j + e] and (j + e == len(x) or x[i + e] != x[j + e])


def test_runs_equal_every_period_tried():
    hits = 0
    for x in strings():
        words = [b"w%d" % c for c in x]
        for least, exponent in ((24, 3), (6, 3), (4, 2), (2, 2)):
            want = plain_runs(x, least, exponent)
            assert R.text_runs(words, least, exponent) == want, x
            hits += len(want)
    assert hits > 2000


class Letter(int):
    """A letter that counts how often it is looked at."""

    looks = 0

    def __eq__(self, other):
        Letter.looks += 1
        return int(self) == int(other)

    __hash__ = int.__hash__


def test_matching_is_linear():
    """What is matched once is never compared again: at most two comparisons of letters a place."""
    a, b = [0], [0, 1]
    while len(b) < 20_000:
        a, b = b, b + a
    shapes = [b, [0] * 20_000, [0, 1] * 10_000, ([0] * 99 + [1]) * 200, [random.randrange(2) for _ in range(20_000)]]
    for x in shapes:
        Letter.looks = 0
        R.next_smaller([Letter(c) for c in x])
        assert Letter.looks < 4 * len(x)


def plain_row(doc_id, text):
    words = [w for w in (text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a, k = g % n, 3 + g % 8
        p = 1 + (n - a) // k
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    rank = {w: i for i, w in enumerate(dict.fromkeys(words))}
    found = plain_runs([rank[w] for w in words])
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(*(f"{s},{n},{p}\n" for s, n, p in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_periodic_runs_equal_brute_force(spark):
    docs = table(spark, SF, "documents").filter("length(text) < 9000")
    got = sorted(tuple(r) for r in R.periodic_runs(docs).collect())
    assert got == sorted(plain_row(r.doc_id, r.text) for r in docs.collect())
    assert sum(r[1] for r in got) > 5


def test_periodic_runs_of_hard_rows(spark, hard, none):
    rows = {(r.doc_id, r.n_runs) for r in R.periodic_runs(hard).collect()}
    assert (6, 1) in rows and (3, 0) in rows and (4, 0) in rows and R.periodic_runs(hard).count() == hard.count()
    nested = ["a b " * 30 + "x " + "a b a b c " * 9, "one two three " * 8, "q " * 24, "q " * 23, "  x " * 12]
    df = spark.createDataFrame([(i + 100, t, "en", "s", 1) for i, t in enumerate(nested)], DOCS)
    assert sorted(tuple(r) for r in R.periodic_runs(df).collect()) == sorted(plain_row(i + 100, t) for i, t in enumerate(nested))
    assert [q(none).count() for q in (R.periodic_runs, L.line_dedup, M.merkle_manifest)] == [0, 0, 0]


def test_hard_rows_keep_their_number_and_columns(hard):
    out = L.without_frequent_lines(hard)
    assert out.columns[: len(hard.columns)] == hard.columns and out.count() == hard.count()
    assert M.merkle_manifest(hard).count() == hard.count()
