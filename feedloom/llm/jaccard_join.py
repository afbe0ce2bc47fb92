"""N-gram Jaccard join: every link between documents whose sets of word shingles are similar enough.

Two documents are linked when ``100 * |A & B| >= 100 * threshold * |A | B|``. The join is exact (sets are held as
64-bit hashes) and returns components of the links, so copies are never expanded into all pairs:

1. One pass gives each document's set size and a signature of its set; equal signatures are linked to the
   smallest id as a star.
2. Prefix filter: two linked sets share one of their first ``n - ceil(threshold * n) + 1`` shingles in any fixed
   order. The order is: of the shingles whose hash is under ``SAMPLE`` those that one document alone has, then the others
   of them, then the rest by hash, and last those that very many documents have. Which shingles one document alone has
   comes out when the sampled ones meet by hash; a document whose prefix is made of such shingles drops out. So what
   remains are documents that share a great part of their text with another, and not those with a passage in common.
3. Documents that share a prefix shingle share a cell, cut where sizes leap by more than the threshold. A cell's
   documents are gathered under its first one, its lead. Each document is compared with one lead; for most families
   these links make one component.
4. Only groups that still hold several components are searched whole: dealt into tiles by size band and hash, tiles
   meeting within a band and with the next one. In each tile hashed bitmap signatures bound the overlap from above (a
   bit of A that is not in B stands for a shingle that B lacks); documents that the bound leaves a partner bring
   their sorted arrays to the tile, where exact intersections decide. A tile gives out the links that join its
   components, never its pairs.

Defined cases: a null or empty text has an empty set, is linked with nothing and is its own component. A row with
a null doc_id keeps its size and has a null component. Rows that repeat a doc_id are one document: each row is
returned, with the component that all of them share. Columns besides doc_id and text are ignored, whatever their names.
An empty table gives no rows. A very long text is one set; it is read whole. Ties need no rule: a link depends on the two
sets alone, and a component's id is its smallest doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import Scratch, id_text, likely
from feedloom.llm.components import components
from feedloom.llm.textvec import mix, shingle_sets, signed

U = np.uint64
#: Tiles of a large group are pairs of blocks that hold about so many shingles.
BLOCK = 400_000
#: The share of all shingles, by hash, that every document shows. Over 1 - threshold, so that it holds a whole prefix.
SAMPLE = 0.3
#: Shingles of about so many documents and more come last in the order, the most common ones up to a limit. The list
#: only changes the order of comparison.
COMMON, COMMON_LIMIT = 16, 500_000


def enough(shared, n_a, n_b, percent: int):
    return 100 * shared >= percent * (n_a + n_b - shared)


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """One bit for each mixed shingle among at least twice as many bits, a power of two of them, at least 64."""
    width = max(64, 1 << (2 * max(1, len(hashes)) - 1).bit_length())
    bits = np.zeros(width, bool)
    bits[(hashes & U(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").view(U)


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """The same bitmap at a smaller width: rows of 64-bit words, the upper ones laid over the lower."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] | bits[..., half:]
    return bits


def overlap_bound(a: np.ndarray, b: np.ndarray, n_a, n_b):
    """No more shingles than this can be shared (bitmaps of equal width, broadcast against each other)."""
    return np.minimum(n_a - np.bitwise_count(a & ~b).sum(-1, dtype=np.int64), n_b - np.bitwise_count(b & ~a).sum(-1, dtype=np.int64))


def _profile(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Kind 0: doc_id, set size, signature, bitmap. Kind 1: shingles common in this task, their count, hash."""
    seen, counts = [], None
    names = ["kind", "doc_id", "n", "sig", "bits"]
    for batch in batches:
        sizes, sig, bits = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, U), [None] * batch.num_rows
        for i, s in shingle_sets(batch.column("text"), k):
            sizes[i] = len(s)
            if len(s):
                m = mix(s)
                sig[i] = np.bitwise_xor.reduce(mix(m)) ^ m.sum(dtype=U)
                bits[i] = bitmap(m).tobytes()
                seen.append(s)
        yield pa.record_batch([pa.array(np.zeros(batch.num_rows, np.int32)), batch.column("doc_id"), pa.array(sizes), pa.array(signed(sig)), pa.array(bits, pa.binary())], names)
        counts, seen = _merge(counts, seen, 0), []
        if len(counts[0]) > 4_000_000:  # keep what may still become common
            few = counts[1] > 1
            counts = counts[0][few], counts[1][few]
    if counts is not None:
        common = counts[1] >= 3
        h, c = counts[0][common], counts[1][common]
        yield pa.record_batch([pa.array(np.ones(len(h), np.int32)), pa.nulls(len(h), pa.int64()), pa.array(c), pa.array(signed(h)), pa.nulls(len(h), pa.binary())], names)


def _merge(counts, seen: list[np.ndarray], _: int) -> tuple[np.ndarray, np.ndarray]:
    h, c = np.unique(np.concatenate(seen), return_counts=True) if seen else (np.zeros(0, U), np.zeros(0, np.int64))
    if counts is None:
        return h, c.astype(np.int64)
    all_h, inverse = np.unique(np.concatenate([counts[0], h]), return_inverse=True)
    return all_h, np.bincount(inverse, np.concatenate([counts[1], c]), len(all_h)).astype(np.int64)


def _prefixes(batches: Iterator[pa.RecordBatch], k: int, percent: int, common) -> Iterator[pa.RecordBatch]:
    """(shingle, doc_id, set size, shown shingles beyond the prefix) for the shingles that a set shows; once for equal sets of a task."""
    last = common.value
    seen: set[bytes] = set()
    limit = U(int(SAMPLE * 2**64))
    for batch in batches:
        ids = batch.column("doc_id")
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        ids = ids.fill_null(0).to_numpy()
        keys, docs, sizes, spare = [], [], [], []
        for i, s in shingle_sets(batch.column("text"), k):
            n = len(s)
            if not n or not known[i]:
                continue
            mark = mix(s).sum(dtype=U).tobytes() + s[:1].tobytes()
            if mark in seen:
                continue
            seen.add(mark)
            p = n - -(-percent * n // 100) + 1
            if len(last):
                at = np.minimum(np.searchsorted(last, s), len(last) - 1)
                often = last[at] == s
                first = s[~often]
                shown = max(p, int(np.searchsorted(first, limit)))
                s = np.concatenate([first, s[often]])[:shown]
            else:
                s = s[: max(p, int(np.searchsorted(s, limit)))]
            keys.append(s)
            docs.append(np.full(len(s), ids[i]))
            sizes.append(np.full(len(s), n, np.int32))
            spare.append(np.full(len(s), len(s) - p, np.int32))
        if keys:
            yield pa.record_batch([pa.array(signed(np.concatenate(keys))), *(pa.array(np.concatenate(x)) for x in (docs, sizes, spare))], ["key", "doc_id", "n", "spare"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in the order of key: those whose key has more than one row. The last row waits for the next batch."""
    held, told = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        key = rows.column("key").to_numpy()
        same = key[1:] == key[:-1]
        out = np.zeros(len(key), bool)
        out[1:] |= same
        out[:-1] |= same
        out[0] |= told
        held, told = rows.slice(rows.num_rows - 1), bool(out[-1])
        yield rows.slice(0, rows.num_rows - 1).filter(pa.array(out[:-1]))
    if told:
        yield held


def _cells(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """From rows in the order of key, n, doc_id: lead, doc_id, n, component. A cell ends where the size leaps; each pair of a lead
    and a document is given out once in a batch."""
    held = None  # key, n and lead of the last row
    for batch in batches:
        if not batch.num_rows:
            continue
        key, doc, n, part = (batch.column(c).to_numpy() for c in ("key", "doc_id", "n", "component"))
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (100 * n[:-1].astype(np.int64) < percent * n[1:].astype(np.int64))
        if held is not None:
            fresh[0] = key[0] != held[0] or 100 * held[1] < percent * int(n[0])
        at = np.maximum.accumulate(np.where(fresh, np.arange(len(key)), -1))
        lead = np.where(at >= 0, doc[np.maximum(at, 0)], 0 if held is None else held[2])
        held = (key[-1], int(n[-1]), lead[-1])
        _, once = np.unique(np.stack([lead, doc, n], 1), axis=0, return_index=True)
        once.sort()
        yield pa.record_batch([pa.array(lead[once]), pa.array(doc[once]), pa.array(n[once]), pa.array(part[once])], ["lead", "doc_id", "n", "component"])


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows in the order of (lead, low, high), a tile at a time; tiles of a single row are left out."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([*held, batch]).combine_chunks()
        key = np.stack([rows.column(c).to_numpy() for c in ("lead", "low", "high")], 1)
        cut = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist()]
        for a, b in zip(cut, cut[1:], strict=False):
            if b - a > 1:
                yield rows.slice(a, b - a)
        held = rows.slice(cut[-1]).to_batches()
    if held and sum(b.num_rows for b in held) > 1:
        yield pa.Table.from_batches(held).combine_chunks()


def _tile_of(rows: pa.Table) -> tuple:
    return tuple(rows.column(c)[0].as_py() for c in ("lead", "low", "high"))


def _partners(tile: tuple, block: np.ndarray, i: int) -> np.ndarray:
    """Whom row i is compared with: in one block with those after it; in two, those of the high block."""
    if tile[1] == tile[2]:
        return np.arange(i + 1, len(block))
    return np.flatnonzero(block == tile[2]) if block[i] == tile[1] else np.zeros(0, np.int64)


def _comparable(n: np.ndarray, part: np.ndarray, i: int, j: np.ndarray, percent: int) -> np.ndarray:
    return j[(part[j] != part[i]) & (100 * np.minimum(n[j], n[i]) >= percent * np.maximum(n[j], n[i]))]


def _screen(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of each block pair the documents with a partner in another component that the bitmaps leave possible."""
    out: list[tuple] = []
    names = ["lead", "low", "high", "block", "doc_id", "n", "component"]
    kinds = [pa.int64()] * 7
    for table in _tiles(batches):
        tile, rows = _tile_of(table), list(zip(*(table.column(c).to_pylist() for c in ("block", "doc_id", "n", "component", "bits")), strict=True))
        block, _, n, part = (np.array(x) for x in list(zip(*rows, strict=True))[:4])
        if part.min() == part.max():
            continue
        bits = [np.frombuffer(r[4], U) for r in rows]
        width = np.array([len(x) for x in bits])
        of_width = {w: np.flatnonzero(width == w) for w in np.unique(width).tolist()}
        place = np.zeros(len(rows), np.int64)
        for at in of_width.values():
            place[at] = np.arange(len(at))
        whole = {w: np.stack([bits[i] for i in at]) for w, at in of_width.items()}
        half = {w: fold(m, max(w // 2, 1)) for w, m in whole.items()}
        hit = np.zeros(len(rows), bool)
        for i in range(len(rows)):
            j = _comparable(n, part, i, _partners(tile, block, i), percent)
            for w in np.unique(width[j]).tolist():
                own = j[width[j] == w]
                if w == width[i]:
                    mine, other = bits[i], whole[w][place[own]]
                elif w == 2 * width[i]:
                    mine, other = bits[i], half[w][place[own]]
                elif width[i] == 2 * w:
                    mine, other = fold(bits[i], w), whole[w][place[own]]
                else:
                    least = min(w, int(width[i]))
                    mine, other = fold(bits[i], least), fold(whole[w][place[own]], least)
                near = own[enough(overlap_bound(other, mine, n[own], n[i]), n[own], n[i], percent)]
                hit[near] = True
                hit[i] |= len(near) > 0
        out += [(*tile, *rows[i][:4]) for i in np.flatnonzero(hit).tolist()]
        if len(out) > 20_000:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
            out = []
    if out:
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted arrays are similar enough."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    at = np.searchsorted(x, y)
    return bool(enough(int((x[np.minimum(at, len(x) - 1)] == y).sum()), len(x), len(y), percent))


def _stars(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows in the order of (lead, block), the lead before the others: the links of documents with their lead."""
    place, leads = None, []
    for batch in batches:
        lead, block, doc = (batch.column(c).to_numpy() for c in ("lead", "block", "doc_id"))
        a, b = [], []
        for i, s in shingle_sets(batch.column("text"), k):
            if (lead[i], block[i]) != place:
                place, leads = (lead[i], block[i]), []
            if doc[i] == lead[i]:
                leads.append(s)
            elif len(s) and any(len(x) and _linked(x, s, percent) for x in leads):
                a.append(lead[i])
                b.append(doc[i])
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _decide(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Links of each block pair that join its components, from exact intersections."""
    a, b = [], []
    for rows in _tiles(batches):
        tile, sets = _tile_of(rows), [s for _, s in shingle_sets(rows.column("text").combine_chunks(), k)]
        block, doc, part = (rows.column(c).to_numpy() for c in ("block", "doc_id", "component"))
        n = np.array([len(x) for x in sets])
        if not n.sum():
            continue
        start = np.cumsum(n) - n
        number = np.unique(np.concatenate(sets), return_inverse=True)[1]
        mark = np.zeros(int(number.max()) + 1, np.int64)
        _, part = np.unique(part, return_inverse=True)
        for i in range(len(sets)):
            j = _comparable(n, part, i, _partners(tile, block, i), percent)
            j = j[n[j] > 0]
            if not len(j) or not n[i]:
                continue
            own = number[start[i] : start[i] + n[i]]
            mark[own] = 1
            if 4 * len(j) > len(sets) and n.min():
                shared = np.add.reduceat(mark[number], start)[j]
            else:
                shared = np.array([mark[number[start[x] : start[x] + n[x]]].sum() for x in j])
            mark[own] = 0
            for x in j[enough(shared, n[j], n[i], percent)].tolist():
                if part[x] != part[i]:
                    part[part == part[x]] = part[i]
                    a.append(int(doc[i]))
                    b.append(int(doc[x]))
        if len(a) > 20_000:
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
            a, b = [], []
    yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def tiles(members: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """lead, low, high, block, doc_id, n, component: each document once for each tile of its group that it belongs to."""
    step = F.log(F.lit(100 / percent))
    members = members.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / step + 1e-9).cast("long"))
    sizes = scratch.table(members.groupBy("lead", "band").agg(F.ceil(F.sum("n") / BLOCK).cast("long").alias("blocks")))
    number = lambda band, part: band * (1 << 40) + part
    own = members.join(sizes, ["lead", "band"]).withColumn("block", number(F.col("band"), F.pmod(F.xxhash64("doc_id"), F.col("blocks")))).drop("blocks")
    beside = own.withColumn("other_band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    beside = beside.join(sizes.select("lead", F.col("band").alias("other_band"), "blocks"), ["lead", "other_band"])
    beside = beside.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("other", number(F.col("other_band"), F.col("part")))
    return beside.select("lead", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "doc_id", "n", "component")


def star_links(docs: DataFrame, members: DataFrame, scratch: Scratch, k: int, percent: int) -> DataFrame:
    """Links (a, b) of each document with its smallest lead of another component."""
    parts = _parts(docs)
    leads = members.filter("lead = doc_id").select("lead", F.col("component").alias("of_lead"), F.col("n").alias("n_lead"))
    near = 100 * F.least("n", "n_lead") >= percent * F.greatest("n", "n_lead")
    stars = members.filter("lead <> doc_id").join(leads.hint("merge"), "lead").filter((F.col("component") != F.col("of_lead")) & near)
    stars = scratch.table(stars.groupBy("doc_id").agg(F.min("lead").alias("lead"), F.max("n").alias("n")))
    blocks = scratch.table(stars.groupBy("lead").agg(F.ceil(F.sum("n") / BLOCK).cast("long").alias("blocks")))
    others = stars.join(blocks, "lead").select("lead", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).alias("block"), "doc_id")
    firsts = blocks.select("lead", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.col("lead").alias("doc_id"))
    rows = scratch.table(others.unionByName(firsts))
    scratch.drop(stars, blocks)
    order = ["lead", "block", "later"]
    found = scratch.table(
        likely(docs, rows).join(rows.hint("merge"), "doc_id").withColumn("later", F.col("doc_id") != F.col("lead")).repartition(parts, "lead", "block").sortWithinPartitions(*order)
        .select("lead", "block", "doc_id", "text").mapInArrow(partial(_stars, k=k, percent=percent), "a long, b long")
    )
    scratch.drop(rows)
    return found


def group_links(docs: DataFrame, members: DataFrame, bits: DataFrame, scratch: Scratch, k: int, percent: int) -> DataFrame:
    """Links (a, b) among the documents of a group that are of several components."""
    parts = _parts(docs)
    members = scratch.table(members)
    # A table of its own, as are all sums that members are joined with: then both sides are dealt anew, and Spark can split a large group.
    mixed = scratch.table(members.groupBy("lead").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("lead"))
    all_, members = members, scratch.table(members.join(mixed, "lead", "left_semi"))
    scratch.drop(all_, mixed)
    key = ["lead", "low", "high"]
    seen = "lead long, low long, high long, block long, doc_id long, n long, component long"
    screened = scratch.table(
        tiles(members, percent, scratch).join(bits.select("doc_id", "bits").hint("merge"), "doc_id").repartition(parts, *key).sortWithinPartitions(*key, "doc_id").mapInArrow(partial(_screen, percent=percent), seen)
    )
    scratch.drop(members)
    out = scratch.table(
        likely(docs, screened).join(screened.hint("merge"), "doc_id").select(*key, "block", "doc_id", "component", "text").repartition(parts, *key).sortWithinPartitions(*key, "doc_id")
        .mapInArrow(partial(_decide, k=k, percent=percent), "a long, b long")
    )
    scratch.drop(screened)
    return out


def _parts(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)


def _with_component(members: DataFrame, part: DataFrame) -> DataFrame:
    """``members`` with the component of ``part`` (id, component), or else its own id."""
    known = part.select(F.col("id").alias("doc_id"), F.col("component").alias("known"))
    return members.join(known, "doc_id", "left").withColumn("component", F.coalesce("known", "doc_id")).drop("known")


def jaccard_join(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs, parts = id_text(docs), _parts(docs)
    profile = scratch.table(docs.mapInArrow(partial(_profile, k=k), "kind int, doc_id long, n long, sig long, bits binary"))
    sets = profile.filter("kind = 0").select("doc_id", "n", "sig")
    often = profile.filter("kind = 1").groupBy("sig").agg(F.sum("n").alias("n")).filter(F.col("n") >= COMMON)
    often = often.orderBy(F.desc("n"), "sig").limit(COMMON_LIMIT).select("sig").toArrow().to_pandas()["sig"].to_numpy(np.int64)
    common = spark.sparkContext.broadcast(np.sort(often.view(U)))

    filled = sets.filter("n > 0 AND doc_id IS NOT NULL")
    first = scratch.table(filled.groupBy("sig", "n").agg(F.min("doc_id").alias("a"), F.count("*").alias("copies")).filter("copies > 1").drop("copies"))
    copies = scratch.table(filled.join(first, ["sig", "n"]).filter("doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct())
    scratch.drop(first)
    same = copies.select(F.col("b").alias("id"), F.col("a").alias("component")).groupBy("id").agg(F.min("component").alias("component"))

    row = "key long, doc_id long, n int, spare int"
    shown = scratch.table(docs.mapInArrow(partial(_prefixes, k=k, percent=percent, common=common), row).repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_shared, row))
    # What a set shows beyond its prefix makes up for shared shingles: with no more of these the prefix has none.
    alive = shown.groupBy("doc_id", "n").agg(F.count("*").alias("shared"), F.min("spare").alias("spare")).filter("shared > spare").select("doc_id", "n")
    alive = scratch.table(_with_component(alive, same))
    members = scratch.table(
        shown.select("key", "doc_id", "n").join(alive.hint("merge"), ["doc_id", "n"]).repartition(parts, "key").sortWithinPartitions("key", "n", "doc_id").select("key", "doc_id", "n", "component")
        .mapInArrow(partial(_cells, percent=percent), "lead long, doc_id long, n int, component long").distinct().withColumn("n", F.col("n").cast("long"))
    )
    scratch.drop(shown, alive)

    links = star_links(docs, members, scratch, k, percent)
    part = components(copies.unionByName(links))
    scratch.drop(links, copies)
    bits = profile.filter("kind = 0 AND n > 0 AND doc_id IS NOT NULL").select("doc_id", "n", "bits")
    links = group_links(docs, _with_component(members, part), bits, scratch, k, percent)
    scratch.drop(members)
    part = components(part.select(F.col("component").alias("a"), F.col("id").alias("b")).unionByName(links))
    scratch.drop(links)

    out = sets.join(part.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def drop_near_copies(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """The rows of ``docs`` without those whose component has a smaller doc_id. Null ids stay, and so do rows that repeat a kept id."""
    found = jaccard_join(docs, k, percent)
    gone = found.filter("component_id < doc_id").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti")
    return kept
