"""Near-duplicate documents by BagMinHash signatures, bands and verified multiset overlap.

A document is the multiset of its five-word shingles; similarity is the weighted
Jaccard index, sum of minima over sum of maxima of the shingle counts.

Signature.  Every shingle owns independent Poisson processes over its weight
axis, cut into the dyadic intervals [0,1), [1,2), [2,4), [4,8) ...; a document that
holds the shingle w times sees the points at weights below w.  Points arrive in
time order, each at a random component, and a component keeps its earliest
point: two documents agree in a component with the probability of their weighted
Jaccard index.  An interval that lies partly above w is split: its point goes to
one half by a coin, the other half goes on by itself from that time, since a
Poisson process has no memory.  A process ends as soon as its time is past the
latest component, so few points per shingle are drawn.

Search.  Bands of four components are buckets.  Every bucket's members are compared
with one hub of the bucket, not with each other, so a bucket of any size costs as
many comparisons as it has members; this repeats for what the hub doesn't explain, as
long as hubs explain members.  A link inside one connected class changes nothing, so
only buckets that still hold several classes are then compared in blocks, members of the
smaller classes against all, each pair in the first bucket that it shares.  Blocks are
compared by signatures first; only members of some pair that agrees enough go on with
their text, and the pairs are verified by their exact overlap where the block is.  No
pair leaves its block: what comes out are the links that join two classes there.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import materialise
from pagemill.llm.components import connected_components

SHINGLE_WORDS = 5
THRESHOLD = 0.8
BANDS, BAND_ROWS = 24, 4
COMPONENTS = BANDS * BAND_ROWS
#: Agreeing components (of 96, by their low bytes) below which a pair isn't verified:
#: a pair of similarity 0.8 agrees in 77 on average and in fewer than 53 once in 10^8.
MIN_AGREE = 53
#: Rows of a block in which members of a bucket are compared; a task compares two.
BLOCK_ROWS = 1024
#: A hub round must explain more than this share of the members it compares, else blocks take over.
HUB_PROGRESS = 0.1
#: Shingles that one signature batch works on at once, and a worker's cached word hashes.
BATCH_SHINGLES, CACHE_WORDS = 100_000, 200_000
#: Rows of an Arrow batch that are held as Python strings at once.
SLICE_ROWS = 1_000

U = np.uint64


# -- shingles ---------------------------------------------------------------
class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_HASHES = _WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser; every output bit depends on every input bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of the five-word shingles in order; a shorter text is one shingle, an empty one none."""
    h = np.fromiter(map(_HASHES.__getitem__, words), dtype=U, count=len(words))
    if not len(h):
        return h
    n = max(1, len(h) - SHINGLE_WORDS + 1)
    out = np.full(n, len(h) if len(h) < SHINGLE_WORDS else SHINGLE_WORDS, dtype=U)
    for k in range(min(SHINGLE_WORDS, len(h))):
        out = _mix(out * U(0x9E3779B97F4A7C15) + h[k:k + n])
    return out


def split_words(text: str | None) -> list[bytes]:
    """Runs other than space and \\t \\n \\v \\f \\r, which are the white space of bytes."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def numbered(hashes: np.ndarray) -> np.ndarray:
    """A multiset of hashes as a sorted set: the first occurrence of a hash, its second, ... are
    different members, so the weighted overlap of multisets is the plain one of these sets."""
    ordered = np.sort(hashes)
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]])[:len(ordered)]
    at = np.arange(len(ordered))
    nth = at - np.maximum.accumulate(np.where(first, at, 0))
    return np.sort(_mix(ordered + nth.astype(U) * U(0x9E3779B97F4A7C15)))


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard index of two multisets of hashes; of two empty ones 1."""
    return set_overlap(numbered(a), numbered(b))


def set_overlap(a: np.ndarray, b: np.ndarray) -> float:
    """The same of two ``numbered`` multisets."""
    if not len(a) and not len(b):
        return 1.0
    both = np.sort(np.concatenate([a, b]))
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(a) + len(b) - shared)


# -- signatures -------------------------------------------------------------
def _exponential(code: np.ndarray) -> np.ndarray:
    return -np.log(((code >> U(11)).astype(np.float64) + 0.5) * 2.0 ** -53)


def bag_signatures(bags: list[np.ndarray], m: int = COMPONENTS) -> np.ndarray:
    """A row of ``m`` 64-bit codes per multiset of hashes; all ones for an empty one."""
    time = np.full((len(bags), m), np.inf)
    code = np.full((len(bags), m), ~U(0))
    flat_t, flat_c = time.reshape(-1), code.reshape(-1)

    def arrive(doc, t, c):
        at = doc * m + (_mix(c) % U(m)).astype(np.int64)
        first = t < flat_t[at]
        at, t, c = at[first], t[first], c[first]
        order = np.argsort(-t, kind="stable")  # the earliest point of a component is written last
        flat_t[at[order]], flat_c[at[order]] = t[order], c[order]

    uniq = [np.unique(b, return_counts=True) for b in bags]
    doc = np.repeat(np.arange(len(bags)), [len(u) for u, _ in uniq])
    if not len(doc):
        return code
    shingle, weight = np.concatenate([u for u, _ in uniq]), np.concatenate([c for _, c in uniq])
    # Unit intervals run on; wider ones only split.  One list of processes per width.
    roots, lo, width = [], 0, 1
    while (part := np.flatnonzero(weight > lo)).size:
        key = _mix(_mix(shingle[part] + U(lo)) + U(width))
        roots.append([doc[part], key, weight[part], np.full(len(part), lo), width, _exponential(_mix(key)) / width, _mix(key)])
        lo, width = (lo + width, width) if lo == 0 else (lo + width, width * 2)
    units = [[], [], [], [], []]  # doc, key, time, code, draws

    while roots:
        d, key, w, lo, width, t, c = roots.pop()
        if width == 1:
            arrive(d, t, c)
            for column, values in zip(units, (d, key, t, c, np.zeros(len(d), dtype=U)), strict=True):
                column.append(values)
            continue
        full = lo + width <= w
        arrive(d[full], t[full], c[full])
        half = width // 2
        right = (_mix(c + U(1)) & U(1)).astype(bool)
        for side in (False, True):
            at = lo + half * side
            own = _mix(key + U(2 + side))
            fresh = _mix(own)
            inherits = right == side
            st = np.where(inherits, t, t + _exponential(fresh) / half)
            sc = np.where(inherits, c, fresh)
            seen = (at < w) & (st <= time.max(axis=1)[d])
            if seen.any():
                roots.append([d[seen], own[seen], w[seen], at[seen], half, st[seen], sc[seen]])

    d, key, t, c, draws = (np.concatenate(u) for u in units)
    while True:
        live = t <= time.max(axis=1)[d]
        d, key, t, draws = d[live], key[live], t[live], draws[live]
        if not len(d):
            return code
        # Few processes left: draw several points of each at once.
        ahead = max(1, min(32, 20_000 // len(d)))
        n = draws[:, None] + np.arange(1, ahead + 1, dtype=U)
        c = _mix(key[:, None] + n * U(0xA0761D6478BD642F))
        ts = t[:, None] + np.cumsum(_exponential(c), axis=1)
        arrive(np.repeat(d, ahead), ts.reshape(-1), c.reshape(-1))
        t, draws = ts[:, -1], n[:, -1]


def band_hashes(codes: np.ndarray) -> np.ndarray:
    """A 64-bit bucket per band, the band's number included."""
    bands = codes.reshape(len(codes), BANDS, BAND_ROWS)
    out = np.broadcast_to(np.arange(BANDS, dtype=U), (len(codes), BANDS))
    for k in range(BAND_ROWS):
        out = _mix(out * U(0x9E3779B97F4A7C15) + bands[:, :, k])
    return out.astype(np.int64)


def sign(docs: DataFrame) -> DataFrame:
    """(doc_id, hash, key, bands, sig): ``hash`` is of the text, ``key`` a 128-bit hash of the word
    sequence, ``bands`` the buckets (none for a text without words) and ``sig`` the components' low bytes."""
    def run(batches):
        def emit(ids, hashes, keys, bags):
            codes = bag_signatures(bags)
            bands = [b if len(g) else [] for b, g in zip(band_hashes(codes), bags, strict=True)]
            low = codes.astype(np.uint8)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())),
                 pa.array([s.tobytes() for s in low], pa.binary())], names=["doc_id", "hash", "key", "bands", "sig"])

        for batch in batches:
            ids, hashes, keys, bags, size = [], [], [], [], 0
            for doc_id, text, text_hash in _rows(batch):
                words = split_words(text)
                ids.append(doc_id)
                hashes.append(text_hash)
                keys.append(xxhash.xxh3_128_digest(b" ".join(words)))
                bags.append(shingle_hashes(words))
                size += len(words)
                if size >= BATCH_SHINGLES:
                    yield emit(ids, hashes, keys, bags)
                    ids, hashes, keys, bags, size = [], [], [], [], 0
            if ids:
                yield emit(ids, hashes, keys, bags)

    return _hashed(docs).mapInArrow(run, "doc_id long, hash long, key binary, bands array<long>, sig binary")


def _rows(batch: pa.RecordBatch):
    """The rows of a batch as tuples."""
    for at in range(0, batch.num_rows, SLICE_ROWS):
        yield from zip(*(column.to_pylist() for column in batch.slice(at, SLICE_ROWS).columns), strict=True)


def _hashed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, hash) of every row."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("hash"))


# -- search -------------------------------------------------------------------
def _agreeing(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """Pairs (a, b) whose signatures agree in enough components."""
    def run(batches):
        for p in batches:
            if len(p):
                x, y = (np.frombuffer(b"".join(p[c]), dtype=np.uint8).reshape(len(p), -1) for c in ("sa", "sb"))
                yield p.loc[(x == y).sum(axis=1) >= MIN_AGREE, ["a", "b"]]
    both = (pairs.join(sigs.select(F.col("key").alias("b"), F.col("sig").alias("sb")), "b")
            .join(sigs.select(F.col("key").alias("a"), F.col("sig").alias("sa")), "a"))
    return both.select("a", "b", "sa", "sb").mapInPandas(run, "a binary, b binary")


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose exact multiset overlap is ``threshold`` or more."""
    def run(batches):
        last, bag = None, None
        for p in batches:
            keep = []
            for a, ta, tb in zip(p["a"], p["ta"], p["tb"], strict=True):
                if a != last:
                    last, bag = a, numbered(shingle_hashes(split_words(ta)))
                keep.append(set_overlap(bag, numbered(shingle_hashes(split_words(tb)))) >= threshold)
            yield p.loc[np.array(keep, dtype=bool), ["a", "b"]]
    both = (pairs.join(texts.select(F.col("key").alias("b"), F.col("text").alias("tb")), "b")
            .join(texts.select(F.col("key").alias("a"), F.col("text").alias("ta")), "a"))
    return both.select("a", "b", "ta", "tb").mapInPandas(run, "a binary, b binary")


BLOCK = "bucket long, i int, j int, home boolean, key binary, cls binary, sig binary, bands array<long>"


def _by_block(batches):
    """The blocks of rows that come sorted by block, one after the other."""
    held = None  # rows of the last block seen, which may go on in the next batch
    for p in batches:
        p = p if held is None else pd.concat([held, p], ignore_index=True)
        if not len(p):
            continue
        block = p[["bucket", "i", "j"]].to_numpy()
        cuts = [0, *(np.flatnonzero((block[1:] != block[:-1]).any(axis=1)) + 1).tolist()]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield p.iloc[a:b]
        held = p.iloc[cuts[-1]:]
    if held is not None and len(held):
        yield held


def _near_pairs(p: pd.DataFrame):
    """(home row, other rows) of a block that agree enough, are of two classes and share no earlier band."""
    sig = np.frombuffer(b"".join(p["sig"]), dtype=np.uint8).reshape(len(p), -1)
    bands = np.stack(p["bands"].to_numpy())
    cls, home, bucket = pd.factorize(p["cls"])[0], p["home"].to_numpy(dtype=bool), p["bucket"].iloc[0]
    others = np.flatnonzero(~home)
    for i in np.flatnonzero(home):
        near = others[(cls[others] != cls[i]) & ((sig[others] == sig[i]).sum(axis=1) >= MIN_AGREE)]
        near = near[bands[i][(bands[near] == bands[i]).argmax(axis=1)] == bucket] if len(near) else near
        if len(near):
            yield i, near


def _near_rows(batches):
    """The rows of each block that are in some near pair."""
    for p in _by_block(batches):
        keep = np.zeros(len(p), dtype=bool)
        for i, near in _near_pairs(p):
            keep[i] = True
            keep[near] = True
        if keep.any():
            yield p[keep]


def _block_links(threshold: float):
    """Links (a, b) that join the classes of each block: one less than the classes they join."""
    def run(batches):
        for p in _by_block(batches):
            key, cls = p["key"].to_numpy(), pd.factorize(p["cls"])[0]
            text, bags, root, out = p["text"].to_numpy(), {}, list(range(int(cls.max()) + 1)), []

            def top(c):
                while root[c] != c:
                    root[c] = c = root[root[c]]
                return c

            def bag(i):
                if key[i] not in bags:
                    bags[key[i]] = numbered(shingle_hashes(split_words(text[i])))
                return bags[key[i]]

            def linked(x, y):  # no overlap is above the ratio of the sizes
                return min(len(x), len(y)) >= threshold * max(len(x), len(y)) and set_overlap(x, y) >= threshold
            for i, near in _near_pairs(p):
                for j in near.tolist():
                    if top(cls[i]) != top(cls[j]) and linked(bag(i), bag(j)):
                        root[top(cls[i])] = top(cls[j])
                        out.append((max(key[i], key[j]), min(key[i], key[j])))
            if out:
                yield pd.DataFrame(out, columns=["a", "b"])
    return run


def _with_class(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """``rows`` with the class of their key; a key without links is its own class."""
    return rows.join(classes, "key", "left").withColumn("cls", F.coalesce("component", "key")).drop("component")


def _mixed_buckets(rows: DataFrame) -> DataFrame:
    """Rows (bucket, key, cls, ...) of buckets that hold more than one class."""
    mixed = rows.groupBy("bucket").agg(F.min("cls").alias("_lo"), F.max("cls").alias("_hi")).where("_lo != _hi")
    return rows.join(mixed.select("bucket"), "bucket")


def link_classes(sigs: DataFrame, docs: DataFrame, threshold: float = THRESHOLD, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(key, component) of the word sequences that have a link.

    ``sigs`` holds one row per word sequence (key, bands, sig, hash).
    """
    rows = sigs.select(F.explode("bands").alias("bucket"), "key")
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    rows = materialise(rows.join(shared.select("bucket"), "bucket"), "buckets")
    candidates = materialise(rows.select("key").distinct(), "candidates")
    sigs = materialise(sigs.select("key", "sig", "bands", "hash").join(candidates, "key"), "candidate_sigs")
    texts = _texts(docs, sigs)

    classes, left = None, rows
    while True:
        # One order of keys for all buckets: members that share many buckets share their hub there, and meet it once.
        hub = left.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("key").alias("p"), "key"))["key"].alias("hub"))
        spokes = materialise(left.join(hub, "bucket").where("key != hub").select(
            "bucket", "key", F.greatest("hub", "key").alias("a"), F.least("hub", "key").alias("b")), "spokes")
        # Written in between: a task with two Python steps holds two workers, and executors keep what they started.
        agreeing = materialise(_agreeing(spokes.select("a", "b").distinct(), sigs), "agreeing")
        found = materialise(_verified(agreeing, texts, threshold), "links")
        classes = _joined_classes(classes, found)
        rows = materialise(_mixed_buckets(_with_class(rows.select("bucket", "key"), classes)), "mixed")
        # What a hub explains leaves the bucket, and so does the hub.
        unexplained = materialise(spokes.join(found, ["a", "b"], "left_anti").select("bucket", "key"), "unexplained")
        compared = spokes.count()
        if compared - unexplained.count() <= compared * HUB_PROGRESS:
            break
        left = materialise(unexplained.join(rows.select("bucket").distinct(), "bucket"), "left")

    # Any pair of two classes has a member outside the bucket's largest class.
    sizes = rows.groupBy("bucket", "cls").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("bucket").agg(F.max(F.struct("n", "cls"))["cls"].alias("main"), F.sum("n").alias("n"))
    rows = rows.join(largest, "bucket").join(sigs.select("key", "sig", "bands"), "key")
    rows = rows.withColumn("_b", F.ceil(F.col("n") / block_rows).cast("int"))
    mine = F.pmod(F.hash("key"), F.col("_b"))
    every = F.explode(F.sequence(F.lit(0), F.col("_b") - 1))
    home = rows.where("cls != main").withColumn("home", F.lit(True)).withColumn("i", mine).withColumn("j", every)
    other = rows.withColumn("home", F.lit(False)).withColumn("j", mine).withColumn("i", every)
    # Blocks without home rows have nothing to compare.
    busy = home.select("bucket", "i", "j").distinct()
    columns = ["bucket", "i", "j", "home", "key", "cls", "sig", "bands"]
    blocks = home.select(columns).unionByName(other.join(busy, ["bucket", "i", "j"], "left_semi").select(columns))
    near = materialise(_dealt(blocks).mapInPandas(_near_rows, BLOCK), "near_rows")
    more = _dealt(near.join(texts, "key")).mapInPandas(_block_links(threshold), "a binary, b binary")
    more = materialise(more.distinct(), "cross_links")
    if more.isEmpty():
        return classes
    return _joined_classes(classes, more)


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows dealt by block, the blocks of a task one after the other."""
    return rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")


def _joined_classes(classes: DataFrame | None, links: DataFrame) -> DataFrame:
    """(key, component) after ``links`` have joined the known classes."""
    if classes is not None:
        links = classes.select(F.col("key").alias("a"), F.col("component").alias("b")).unionByName(links)
    return materialise(connected_components(links), "classes").withColumnRenamed("node", "key")


def _texts(docs: DataFrame, sigs: DataFrame) -> DataFrame:
    """(key, text) of every candidate: the text of one document that has its word sequence."""
    def run(batches):
        for p in batches:
            same = [xxhash.xxh3_128_digest(b" ".join(split_words(t))) == bytes(k) for t, k in zip(p["text"], p["key"], strict=True)]
            yield p.loc[np.array(same, dtype=bool), ["key", "text"]]
    found = _hashed(docs).select("hash", "text").join(sigs.select("hash", "key"), "hash").select("key", "text").mapInPandas(run, "key binary, text string")
    return materialise(found.dropDuplicates(["key"]), "candidate_texts")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, **sizes) -> DataFrame:
    """(doc_id, key, class_id, kept) for every row of ``docs``.

    Documents of one word sequence are one class, and classes are joined by links:
    weighted Jaccard of ``threshold`` or more on five-word shingles.  ``class_id`` is the
    smallest doc_id of the class, ``kept`` marks that document.  Texts without words
    (null, empty, white space) are one class; texts of fewer than five words link with
    equal ones only.  Rows that repeat a doc_id with the same words are all marked.  Rows
    without doc_id are compared like all others; a class in which no row has one gets a
    negative class_id from its smallest key, and the rows of that key are marked.
    """
    signed = materialise(sign(docs), "signed")
    unique = signed.groupBy("key").agg(
        F.first("bands").alias("bands"), F.first("sig").alias("sig"), F.min("hash").alias("hash"), F.min("doc_id").alias("doc"))
    unique = materialise(unique, "signatures")
    classes = link_classes(unique, docs, threshold, **sizes)
    firsts = materialise(_with_class(unique.select("key", "doc"), classes), "firsts")
    ids = firsts.groupBy("cls").agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "key")).alias("_first"))
    named = F.coalesce("_first.doc", -1 - F.abs(F.xxhash64("_first.key") % F.lit(1 << 62)))
    classed = firsts.join(ids, "cls").select("key", named.alias("class_id"), F.col("_first.doc").alias("_doc"), (F.col("key") == F.col("_first.key")).alias("_own"))
    out = signed.select("doc_id", "key").join(classed, "key", "left")
    return out.select("doc_id", "key", "class_id", (F.col("_own") & F.col("doc_id").eqNullSafe(F.col("_doc"))).alias("kept"))


def keep_first(docs: DataFrame, threshold: float = THRESHOLD, **sizes) -> DataFrame:
    """One document of each class, unchanged: the one of the smallest doc_id.

    Of rows that repeat that doc_id with the same words one stays, and so does one row of a
    class without any doc_id.
    """
    chosen = near_duplicates(docs, threshold, **sizes).where("kept").groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("_n"))
    names = docs.columns
    keyed = docs.select(F.struct(*(F.col(f"`{n}`") for n in names)).alias("row"))
    keyed = _row_keys(keyed)
    rows = keyed.join(chosen, (keyed["id"].eqNullSafe(chosen["doc_id"])) & (keyed["k"] == chosen["key"])).select("row", "k", "id", "_n")
    once = rows.where("_n = 1").select("row.*")
    again = rows.where("_n > 1").dropDuplicates(["id", "k"]).select("row.*")
    return once.unionByName(again)


def _row_keys(rows: DataFrame) -> DataFrame:
    """Rows with the id and word-sequence key of the document they hold."""
    @F.pandas_udf("binary")
    def key(text: pd.Series) -> pd.Series:
        return text.map(lambda t: xxhash.xxh3_128_digest(b" ".join(split_words(t))))
    # Else the join's filter on keys gets a copy of the function, and each task a second worker.
    key = key.asNondeterministic()
    return rows.select("row", F.col("row.doc_id").cast("long").alias("id"), key(F.col("row.text").cast("string")).alias("k"))
