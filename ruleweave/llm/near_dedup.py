"""Near-duplicate documents by an inverted join over MinHash signature coordinates.

Every document is posted under each (coordinate, value) pair of its signature.
A pair of documents whose sets have Jaccard similarity s agrees in Binomial(K, s)
coordinates, so those that agree in fewer than ``matches`` of K are left out (with
K = 64, matches = 32 and s = 0.75 a link is missed with a chance of 5 in a million).
Collisions are counted by prefix and skip merging: a document's postings are put
in order of their frequency, postings that occur once are skipped, documents left
with fewer than ``matches`` postings are skipped, two documents that agree in
``matches`` of them must meet in the prefixes of length n - matches + 1, and pairs
whose sizes differ too much are skipped before they are counted. Long lists leave
pairs that share an earlier list to that list.

No pair is put out in a list, as lists may be very long. First each document is
compared once with the head of the lists that it is in most, which gives most
members of a group of copies one label; lists of one label are skipped. The others
are merged block by block in memory, and what comes out is one row for each
document that has a partner at the threshold and each two tiles (bounded parts of
a head's documents) where both lie. Those documents meet once more by tiles, with
the hashes of their shingles, and every link is confirmed on full sets. Texts are
not shuffled: the hashes of the documents that pass the prefix are made once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import components, forget, python_ready, saved, small_batches

COORDINATES = 64
MATCHES = 32
SHINGLE_WORDS = 5
#: A link needs 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Members of one head that are compared in one run of rows.
CHUNK = 256
#: Documents of a list in one side of a block.
BLOCK = 1024
#: Documents, and shingles of documents, in one tile.
TILE = 1024
TILE_SHINGLES = 300_000
#: Lists in which a document must meet a head at least, for it to be its home before heads that it meets more often.
LEAST_MET = 4
#: Pairs whose collisions are counted at once; pairs up to which sets are compared one by one; lists in which pairs may be counted though an earlier list has them.
AT_ONCE = 200_000
FEW = 64
SHORT = 16

_MULTIPLIERS = np.random.default_rng(20240917).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < 200_000:
            self[word] = value
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, hashes: _WordHashes, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; A-Z in lower case; too few words make one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(size, len(h))
    n = len(h) - width + 1
    s = np.full(n, width, np.uint64)
    for i in range(width):
        s = s * np.uint64(0x9E3779B97F4A7C15) + _mixed(h[i : i + n])
    return np.unique(_mixed(s))


def signature(shingles: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """The smallest hash of the set under each of the multipliers, as 32-bit values."""
    low = np.full(coordinates, np.iinfo(np.uint64).max, np.uint64)
    a = _MULTIPLIERS[:coordinates, None]
    for i in range(0, len(shingles), 512):
        np.minimum(low, (a * shingles[None, i : i + 512]).min(axis=1), out=low)
    return (low >> np.uint64(32)).astype(np.uint32).view(np.int32)


_SKETCH = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("sig", pa.list_(pa.int32()))])


def _sketches(coordinates: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            n, keys, sigs = [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), hashes, size)
                n.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sigs.append(signature(s, coordinates) if len(s) else None)
            flat = [x for x in sigs if x is not None]
            ends = np.cumsum([0] + [coordinates if x is not None else 0 for x in sigs]).astype(np.int32)
            values = pa.array(np.concatenate(flat) if flat else np.empty(0, np.int32))
            lists = pa.ListArray.from_arrays(pa.array(ends), values)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), lists], schema=_SKETCH)

    return run


_LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _shingles(size: int):
    """(doc_id, text) to (doc_id, the sorted hashes of its set as bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            sets = [shingle_set(text.as_py(), hashes, size).tobytes() for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["rep", "shingles"])

    return run


def _links_to(u: list[int], v: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], schema=_LINKS)


def _with_heads(percent: int):
    """Rows come by head and chunk, the head's set first: members that link to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, mine = None, []
        for batch in batches:
            u, v = [], []
            heads, chunks, docs = (batch.column(i).to_pylist() for i in range(3))
            for head, chunk, doc, held in zip(heads, chunks, docs, batch.column(3), strict=True):
                s = np.frombuffer(held.as_buffer(), np.uint64)
                if (head, chunk) != now:
                    now, mine = (head, chunk), []
                if doc == head:
                    mine.append(s)
                    continue
                for x in mine:
                    if 100 * min(len(x), len(s)) < percent * max(len(x), len(s)):
                        continue
                    both = len(np.intersect1d(x, s, assume_unique=True))
                    if 100 * both >= percent * (len(x) + len(s) - both):
                        u.append(doc)
                        v.append(head)
                        break
            yield _links_to(u, v)

    return run


def _head_links(pairs: DataFrame, shingles: DataFrame, percent: int) -> DataFrame:
    """The pairs (rep, head) that link, by their full sets; a head's members come in chunks."""
    parts = pairs.groupBy("head").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("parts"))
    members = pairs.join(parts, "head").select("rep", "head", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int").alias("chunk"))
    heads = parts.select(F.col("head").alias("rep"), "head", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("chunk"))
    rows = members.unionByName(heads).join(shingles, "rep").select("head", "chunk", "rep", "shingles").repartition("head", "chunk")
    return rows.sortWithinPartitions("head", "chunk", F.col("rep") != F.col("head")).mapInArrow(_with_heads(percent), "u long, v long")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of rows that agree in the first ``keys`` columns, some at once: the rows, and where each group begins, and their number."""
    held: list[pa.RecordBatch] = []

    def out() -> tuple[pa.Table, np.ndarray]:
        rows = pa.Table.from_batches(held).combine_chunks()
        new = np.zeros(len(rows), bool)
        new[:1] = True
        for i in range(keys):
            k = rows.column(i).to_numpy()
            new[1:] |= k[1:] != k[:-1]
        return rows, np.append(np.flatnonzero(new), len(rows))

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(x.num_rows for x in held) < BLOCK:
            continue
        rows, starts = out()
        if len(starts) > 2:
            last = int(starts[-2])
            yield rows.slice(0, last), starts[:-1]
            held = rows.slice(last).combine_chunks().to_batches()
    if held:
        yield out()


def _pairs_of(starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The places (a, b), a < b, of all pairs within short groups, some at once."""
    n = int(starts[-1])
    after = np.repeat(starts[1:], np.diff(starts)) - np.arange(n) - 1
    after[np.repeat(np.diff(starts) > SHORT, np.diff(starts))] = 0
    total = np.cumsum(after)
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + AT_ONCE, side="right")))
        times = after[low:high]
        a = np.repeat(np.arange(low, high), times)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(times) - times, times)
        if len(a):
            yield a, b
        low = high


def _incidence(values: np.ndarray, of: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """How many values the documents in ``left`` have in common with those in ``right``; document ``of[i]`` of ``n`` has ``values[i]``."""
    _, at, times = np.unique(values, return_inverse=True, return_counts=True)
    keep = times[at] > 1  # a value of one document is in no intersection
    _, at = np.unique(at[keep], return_inverse=True)
    of = of[keep]
    order = np.argsort(at, kind="stable")
    at, of = at[order], of[order]
    both = np.zeros((len(left), len(right)), np.float32)
    wide = int(at[-1]) + 1 if len(at) else 0
    for low in range(0, wide, 2048):
        i, j = np.searchsorted(at, [low, low + 2048])
        m = np.zeros((n, min(2048, wide - low)), np.float32)
        m[of[i:j], at[i:j] - low] = 1
        both += m[left] @ m[right].T
    return both


def _collisions(matches: int, percent: int):
    """Rows come by list and block: count how often each two documents collide, and say which tiles hold pairs at or above the threshold.

    The rows of a document say all that it was posted under, so a list that two documents
    share gives the number of all lists that they share. Pairs with one label are linked
    already, and pairs whose sizes differ too much can't be. In lists of some length, pairs
    that share a list earlier in their prefixes are left to that list.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in _groups(batches, 3):
            side, rep, label, tile, n = (rows.column(c).to_numpy() for c in ("side", "rep", "label", "tile", "n_shingles"))
            across = rows.column("low").to_numpy() != rows.column("high").to_numpy()
            posted = np.frombuffer(b"".join(rows.column("posted").to_pylist()), np.uint8).reshape(len(rows), -1)
            before = rows.column("before").combine_chunks()
            ends, earlier = before.offsets.to_numpy(), before.values.to_numpy()
            found: set[tuple[int, int, int]] = set()

            def hits(a: np.ndarray, b: np.ndarray) -> None:
                may = (label[a] != label[b]) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])) & (~across[a] | (side[a] != side[b]))
                a, b = a[may], b[may]
                hit = (posted[a] == posted[b]).sum(axis=1) >= matches
                a, b = a[hit], b[hit]
                low, high = np.minimum(tile[a], tile[b]), np.maximum(tile[a], tile[b])
                for x in (a, b):
                    found.update(map(tuple, np.unique(np.column_stack([low, high, rep[x]]), axis=0).tolist()))

            sizes = np.diff(starts)
            for i, j in zip(starts[:-1][sizes > SHORT].tolist(), starts[1:][sizes > SHORT].tolist(), strict=True):
                here = np.arange(j - i)
                of = np.repeat(here, np.diff(ends[i : j + 1]))
                left, right = (np.flatnonzero(side[i:j] == 0), np.flatnonzero(side[i:j] == 1)) if across[i] else (here, here)
                apart = _incidence(earlier[ends[i] : ends[j]], of, left, right, j - i) == 0
                if not across[i]:
                    apart = np.triu(apart, 1)
                at_once = max(1, AT_ONCE // max(1, len(right)))
                for low in range(0, len(left), at_once):
                    x, y = np.nonzero(apart[low : low + at_once])
                    hits(i + left[low + x], i + right[y])
            for a, b in _pairs_of(starts):
                hits(a, b)
            columns = list(zip(*found, strict=True)) if found else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "rep"])

    return run


def _tile_links(percent: int):
    """Rows come by pair of tiles (a, b): the links between both across labels, as few as connect the same documents."""

    def links(docs: np.ndarray, labels: np.ndarray, right: np.ndarray, sets: list[np.ndarray], same: bool) -> pa.RecordBatch:
        n = np.array([len(s) for s in sets])
        left = np.arange(len(docs)) if same else np.flatnonzero(~right)
        right = np.arange(len(docs)) if same else np.flatnonzero(right)
        if len(left) * len(right) <= FEW:
            x, y = np.divmod(np.arange(len(left) * len(right)), max(1, len(right)))
            x, y = left[x], right[y]
            may = (labels[x] != labels[y]) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])) & ((x < y) | (not same))
            x, y = x[may], y[may]
            both = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(x, y, strict=True)], np.int64)
            hit = 100 * both >= percent * (n[x] + n[y] - both)
        else:
            both = _incidence(np.concatenate(sets), np.repeat(np.arange(len(docs)), n), left, right, len(docs))
            hit = 100 * both >= percent * (n[left][:, None] + n[right][None, :] - both)
            x, y = np.nonzero(hit & (labels[left][:, None] != labels[right][None, :]))
            x, y, hit = left[x], right[y], slice(None)
        x, y = x[hit], y[hit]
        least = np.arange(len(docs))
        while len(x):  # the smallest place that each document is connected with
            before = least.copy()
            np.minimum.at(least, x, before[y])
            np.minimum.at(least, y, before[x])
            least = least[least]
            if (least == before).all():
                break
        new = np.flatnonzero((least != np.arange(len(docs))) & (docs != docs[least]))
        return _links_to(docs[new].tolist(), docs[least[new]].tolist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in _groups(batches, 2):
            a, b, docs, labels, tiles = (rows.column(c).to_numpy() for c in ("a", "b", "rep", "label", "tile"))
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("shingles")]
            for i, j in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                yield links(docs[i:j], labels[i:j], tiles[i:j] == b[i], sets[i:j], a[i] == b[i])

    return run


def near_duplicates(docs: DataFrame, coordinates: int = COORDINATES, matches: int = MATCHES, size: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id and kept.

    Documents are the vertices, named by doc_id. Rows that repeat a doc_id are
    one vertex with each row's set, and each row is returned. Null and empty
    texts have no shingles, link with nothing and are kept. A null doc_id is
    linked with nothing: component_id is null, kept is true. An empty table
    gives an empty result. Other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    python_ready(spark)
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = saved(docs.mapInArrow(_sketches(coordinates, size), "doc_id long, n_shingles long, set_key binary, sig array<int>"), "sketch")
    real = sketch.where("doc_id is not null and set_key is not null")

    # equal sets are one vertex: the smallest doc_id stands for them
    classes = saved(real.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles")), "classes")

    # postings under each coordinate and value; rare lists first; a document's prefix is all but its last matches - 1 lists
    postings = classes.select("rep", F.posexplode("sig").alias("at", "value")).select(
        "rep", (F.col("value").cast("long") * coordinates + F.col("at")).alias("token")
    )
    often = postings.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = postings.join(often, "token").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("held")).where(F.size("held") >= matches)
    prefix = F.transform(F.slice("held", 1, F.size("held") - (matches - 1)), lambda x: x["token"])
    score = F.aggregate("held", F.lit(0).cast("long"), lambda n, x: n + x["df"])
    prefixes = saved(shared.select("rep", prefix.alias("prefix"), score.alias("score")), "prefixes")
    candidates = saved(prefixes.select("rep"), "candidates")  # once written, Spark knows its size: texts are shuffled only if these ids are too many to be sent
    shingles = docs.join(candidates.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").mapInArrow(_shingles(size), "rep long, shingles binary")
    shingles = saved(shingles, "shingles")

    # the head of a list is its document with the fullest lists; of the heads that a document meets several times,
    # that with the fullest lists is its home, or else the one that it meets most. One comparison with it contracts most of a group of near copies, so that lists of one label are done
    entries = prefixes.select("rep", "score", F.explode("prefix").alias("token"))
    heads = entries.groupBy("token").agg(F.max(F.struct("score", "rep")).alias("x"), F.count(F.lit(1)).alias("n")).where("n > 1")
    heads = saved(heads.select("token", F.col("x.rep").alias("head"), F.col("x.score").alias("of")), "heads")
    met = entries.join(heads, "token").groupBy("rep", "head").agg(F.count(F.lit(1)).alias("n"), F.max("of").alias("of"))
    home = saved(met.groupBy("rep").agg(F.max(F.struct(F.least("n", F.lit(LEAST_MET)).alias("enough"), "of", "n", "head")).alias("x")).select("rep", F.col("x.head").alias("head")), "home")
    near = saved(_head_links(home.where("rep != head"), shingles, percent), "links")

    # a home's documents are dealt into tiles of a bounded size
    labelled = home.join(near.select(F.col("u").alias("rep"), F.col("v").alias("label")).distinct(), "rep", "left")
    members = labelled.join(classes.select("rep", "sig", "n_shingles"), "rep")
    homes = members.groupBy("head").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("all"))
    homes = homes.select("head", F.ceil(F.greatest(F.col("n") / TILE, F.col("all") / TILE_SHINGLES)).alias("parts"))
    tile = F.xxhash64("head", F.pmod(F.xxhash64("rep", F.lit("tile")), F.col("parts")))
    # a byte of each value is enough to count by: it can only add to a count, and every link is confirmed
    posted = F.unhex(F.array_join(F.transform("sig", lambda x: F.lpad(F.hex(x.bitwiseAND(255).cast("long")), 2, "0")), ""))
    members = members.join(homes, "head").select("rep", F.coalesce("label", "rep").alias("label"), tile.alias("tile"), "n_shingles", posted.alias("posted"))
    members = saved(members, "members")

    # lists with more than one label: count collisions, block by block where a list is long
    places = prefixes.select("rep", "prefix", F.posexplode("prefix").alias("at", "token"))
    entries = places.select("rep", "token", F.slice("prefix", F.lit(1), F.col("at")).alias("before")).join(members, "rep")
    lists = entries.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    lists = saved(lists.where("x < y").select("token", "blocks"), "lists")
    rows = entries.join(lists, "token").withColumn("part", F.pmod(F.xxhash64("rep", F.lit("block")), F.col("blocks")).cast("int"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("token", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), (F.col("part") > F.col("other")).cast("int").alias("side"), "rep", "label", "tile", "n_shingles", "posted", "before")
    # by ranges, so that tasks are even though lists are not
    rows = rows.repartitionByRange("token", "low", "high").sortWithinPartitions("token", "low", "high")
    meets = saved(rows.mapInArrow(_collisions(matches, percent), "a long, b long, rep long").distinct(), "meets")

    # the documents with pairs at the threshold, by their tiles: confirm links on full sets
    rows = meets.join(members.select("rep", "label", "tile").distinct(), "rep").join(shingles, "rep").select("a", "b", "rep", "label", "tile", "shingles")
    far = rows.repartition("a", "b").sortWithinPartitions("a", "b").mapInArrow(_tile_links(percent), "u long, v long")

    # classes whose sets are equal, and rows that repeat a doc_id, meet at that doc_id
    same = real.join(classes.select("set_key", "rep"), "set_key").select(F.col("doc_id").alias("u"), F.col("rep").alias("v")).where("u != v")
    final = components(near.unionByName(far).unionByName(same))
    forget(classes, prefixes, candidates, shingles, heads, home, near, members, lists, meets)  # components are written
    out = sketch.select("doc_id", "n_shingles").join(final, sketch.doc_id == final.node, "left")
    component = F.coalesce("label", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def near_dedup(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` of which each group keeps one: that with the smallest doc_id.

    Rows that repeat a kept doc_id are cut to the one whose text comes first; rows with a null doc_id stay.
    """
    found = saved(near_duplicates(docs, **parameters).select("doc_id", "kept").where("doc_id is not null"), "found")
    # the fewer ids: those that go
    gone = saved(found.where("not kept").select("doc_id").distinct(), "gone")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.col("text").alias("text"))
    out = rows.join(gone, F.col("id") == F.col("doc_id"), "left_anti")
    if found.where("kept").groupBy("doc_id").count().where("count > 1").limit(1).count():
        turn = F.row_number().over(Window.partitionBy("id").orderBy("text"))
        out = out.where("id is not null").withColumn("turn", turn).where("turn = 1").drop("turn").unionByName(out.where("id is null"))
    forget(found)
    return out.select("row.*")
