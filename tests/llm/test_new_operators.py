"""Decontamination, clustering and alignment against brute force, and their odd cases."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as E
from pagemill.llm import alignment, clusters, phrases
from tests.conftest import SF_SMALL
from tests.oracle_check import compare, duck

DOCS = "doc_id long, text string, lang string, key string, spans int, n_words int, _row string, pairs int, chunk int, block int"
BENCH = "item_id long, text string, words string, doc_id int"
ODD = [None, "", "  ", "\n", "  two  spaces ", "a\n b", "x▁y", "<s> <|endoftext|> <0x41>", "　a  b", "tab\t x", "é漢字\U0001F600 \x1c z", "end ",
       "\n\n q w\n\n e", "same text here", "same text here", "don't stop, naïve café.", "a" * 5000, "word " * 3000]


def _run(spark, name, sf=SF_SMALL):
    full = next(q for q in E.queries() if q.startswith(name))
    return E.queries()[full](spark, sf).collect()


def test_all_thirteen_are_registered():
    assert all(sum(q.startswith(f"op{n}_") for q in E.queries()) == 1 for n in range(1, 14))


# -- alignment ------------------------------------------------------------------
@pytest.fixture(scope="module")
def paths():
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def brute_align(paths):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer, decoders
    t, m = Tokenizer.from_file(paths[0]), SentencePieceProcessor(model_file=paths[1])
    t.encode_special_tokens = True
    letters = {c: b for b, c in _byte_letters().items()}
    assert isinstance(t.decoder, decoders.ByteLevel)

    def one(text):
        """(n_a, n_b, groups, links) from every pair of tokens."""
        if not text:
            return 0, 0, [], []
        a, b = t.encode(" " + text, add_special_tokens=False).ids, m.encode(text)
        ta = [bytes(letters[c] for c in t.id_to_token(i)) for i in a]
        tb = [bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode() for i in b]
        raw = (" " + text).encode()
        if b"".join(ta) != raw or b"".join(tb) != raw:
            return 0, 0, [], []
        ea, eb = (np.cumsum([len(x) for x in y]).tolist() for y in (ta, tb))
        groups, i, j = [], 0, 0
        for end in sorted(set(ea) & set(eb)):
            k, n = ea.index(end) + 1, eb.index(end) + 1
            groups.append(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:n])))
            i, j = k, n
        links, q = [], 0
        for p in range(len(a)):
            q = next(x for x in range(q, len(b)) if eb[x] > ea[p] - len(ta[p]))
            links += [(a[p], b[x]) for x in range(q, len(b)) if eb[x] - len(tb[x]) < ea[p] and x - q < 5000 and eb[x - 1] * (x > 0) < ea[p]] if len(b) < 200 else \
                _overlapping(p, q, a, b, ea, eb)
        return len(a), len(b), groups, links
    return one


def _overlapping(p, q, a, b, ea, eb):
    out = []
    while q < len(b) and (q == 0 or eb[q - 1] < ea[p]):
        out.append((a[p], b[q]))
        q += 1
    return out


def _byte_letters():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _expected(texts, one):
    all_ = [one(t) for t in texts]
    counts = {}
    for _, _, _, links in all_:
        for pair in set(links):
            counts[pair] = counts.get(pair, 0) + 1
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    return [(x, y, len(g), len(ls), sum(counts[p] == best[p[0]] for p in ls), sum(counts[p] for p in ls),
             hashlib.sha256(";".join(g).encode()).hexdigest() if x else "") for x, y, g, ls in all_]


def _fields(r):
    return r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256


def test_alignment_of_whole_table(spark, brute_align):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    want = dict(zip(texts, _expected(list(texts.values()), brute_align), strict=True))
    assert {r.doc_id: _fields(r) for r in _run(spark, "op13_")} == want


@pytest.mark.parametrize("broadcast_pairs", [0, 10**6])
def test_alignment_of_odd_texts(spark, paths, brute_align, broadcast_pairs):
    rows = [(i % 7 if i % 5 else None, t, "en", "k", 1, 2, "r", 3, 4, 5) for i, t in enumerate(ODD)]
    got = alignment.align_corpus(spark.createDataFrame(rows, DOCS), *paths, broadcast_pairs=broadcast_pairs).collect()
    want = [(r[0], *w) for r, w in zip(rows, _expected(ODD, brute_align), strict=True)]
    assert sorted(((r.doc_id, *_fields(r)) for r in got), key=str) == sorted(want, key=str)
    assert alignment.align_corpus(spark.createDataFrame([], DOCS), *paths).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab Théé.\n\t<>|▁漢 \x85'1"), max_size=30), max_size=4))
def test_alignment_of_any_text(paths, brute_align, texts):
    known = alignment.aligner(*paths)
    for text, (n_a, n_b, n_groups, said, links) in zip(texts, known.align(texts), strict=True):
        x, y, groups, pairs = brute_align(text)
        assert (n_a, n_b, n_groups, said) == (x, y, len(groups), ";".join(groups).encode())
        assert sorted(links.tolist()) == sorted(a << 32 | b for a, b in pairs)


def test_small_caches_change_nothing(paths, monkeypatch):
    texts = [" ".join(f"word{i % 37} of{i * j % 11}," for i in range(200)) for j in range(5)]
    want = [(a, b, g, s, list(p)) for a, b, g, s, p in alignment.Aligner(*paths).align(texts)]
    monkeypatch.setattr(alignment, "CACHE_WORDS", 5)
    monkeypatch.setattr(alignment, "CACHE_WINDOWS", 5)
    known = alignment.Aligner(*paths)
    assert [(a, b, g, s, list(p)) for t in texts for a, b, g, s, p in known.align([t])] == want


# -- clustering --------------------------------------------------------------------
def _lloyd(rows, k=40, rounds=5):
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return []
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    cents, x = np.array([v for _, v in order[:k]]), np.array([v for _, v in kept])

    def nearest():
        d = ((x[:, None, :] - cents[None]) ** 2).sum(axis=2)
        return d.argmin(axis=1), d.min(axis=1)
    for _ in range(rounds):
        label, _ = nearest()
        for c in set(label.tolist()):
            mine = x[label == c]
            cents[c] = [sum(col) // len(mine) for col in mine.T.tolist()]
    label, dist = nearest()
    said = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in cents]
    return [(i, c, d, int(dist[label == c].sum()), int(dist.sum()), said[c]) for (i, _), c, d in zip(kept, label.tolist(), dist.tolist(), strict=True)]


def _clusters(rows):
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in rows), key=str)


def test_clusters_of_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()]
    assert _clusters(_run(spark, "op12_")) == sorted(_lloyd(rows), key=str)


def test_clusters_of_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i % 50, rng.normal(size=64).tolist()) for i in range(120)]
    rows += [(None, [0.25] * 64), (None, [0.25] * 64), (7, None), (8, []), (9, [1.0] * 63), (10, [None, *[1.0] * 63]),
             (11, [float("nan"), *[1.0] * 63]), (12, [float("inf"), *[1.0] * 63]), (13, [1.0] * 64), (13, [1.0] * 64), (14, [-0.001] * 64)]
    schema = "vec_id long, embedding array<double>, label int, cluster string, chunk int, vec int, block int"
    df = spark.createDataFrame([(*r, 1, "c", 2, 3, 4) for r in rows], schema)
    assert _clusters(clusters.cluster_vectors(df, chunk_rows=16).collect()) == sorted(_lloyd(rows), key=str)
    few = df.where("vec_id IN (13, 14)")
    assert {r.distance for r in clusters.cluster_vectors(few.limit(3)).collect()} == {0}
    assert clusters.cluster_vectors(df.limit(0)).collect() == []


def test_clusters_refuse_what_would_overflow(spark):
    df = spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        clusters.cluster_vectors(df).collect()


# -- decontamination ---------------------------------------------------------------
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(text):
    return _WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def _leaks(docs, bench, window=10):
    grams = {}
    for item, text in bench:
        w = _words(text)
        for i in range(max(1, len(w) - window + 1)) if w else ():
            grams.setdefault(tuple(w[i:i + window]), set()).add("" if item is None else str(item))
    sizes = {len(g) for g in grams}
    out = []
    for doc_id, text in docs:
        w, hit, items = _words(text), set(), set()
        for i in range(len(w)):
            for n in sizes:
                found = grams.get(tuple(w[i:i + n]))
                if found and i + n <= len(w):
                    hit.update(range(i, i + n))
                    items |= found
        out.append((doc_id, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def _hits(rows):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows), key=str)


def test_decontamination_of_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    want = _leaks(docs, bench)
    assert _hits(_run(spark, "op11_")) == want and any(w[2] for w in want)


LONG = " ".join(f"w{i * i % 61}" for i in range(9000))
BENCH_ROWS = [(1, "One two three four five six seven eight nine ten eleven"), (2, "two three"), (3, None), (4, ""), (5, "--- !!"), (None, "alpha"),
              (6, "one two three four five six seven eight nine ten"), (7, LONG), (7, "É ünï 7x"), (10, "a a a a a a a a a a a a"), (2, "two three")]
DOC_ROWS = [(1, "zero ONE two, three four five\nsix seven eight nine ten eleven twelve"), (2, "two three two threeX two-three"), (3, None), (4, ""),
            (5, "alpha"), (None, "ALPHA beta"), (6, LONG), (6, LONG + " x " + LONG), (7, "é ünï 7x É ünï"), (8, "a " * 500), (8, "a " * 500), (9, "nothing")]


@pytest.mark.parametrize(("shard_words", "block_bytes"), [(1 << 18, 16 << 20), (50, 16 << 20), (1 << 18, 5000)])
def test_decontamination_of_odd_texts(spark, shard_words, block_bytes):
    docs = spark.createDataFrame([(*r, "en", "k", 1, 2, "r", 3, 4, 5) for r in DOC_ROWS], DOCS)
    bench = spark.createDataFrame([(*r, "w", 1) for r in BENCH_ROWS], BENCH)
    got = phrases.decontaminate(docs, bench, shard_words=shard_words, block_bytes=block_bytes).collect()
    assert _hits(got) == _leaks(DOC_ROWS, BENCH_ROWS)


def test_empty_benchmark_and_documents(spark):
    docs = spark.createDataFrame([(*r, "en", "k", 1, 2, "r", 3, 4, 5) for r in DOC_ROWS], DOCS)
    none = spark.createDataFrame([], BENCH)
    assert _hits(phrases.decontaminate(docs, none).collect()) == _leaks(DOC_ROWS, [])
    assert phrases.decontaminate(docs.limit(0), none).collect() == []


def test_removed_text(spark):
    docs = spark.createDataFrame([(1, "zero ONE two, three four five\nsix seven eight nine TEN. eleven twelve"), (2, None), (3, "clean é text")], "doc_id long, text string")
    bench = spark.createDataFrame([(6, "one two three four five six seven eight nine ten")], "item_id long, text string")
    got = {r.doc_id: (r.text, r.n_removed) for r in phrases.remove_phrases(docs, bench).collect()}
    assert got == {1: ("zero . eleven twelve", 10), 2: (None, 0), 3: ("clean é text", 0)}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=20), min_size=1, max_size=6), st.lists(st.integers(1, 4), min_size=1, max_size=4))
def test_index_finds_every_occurrence(runs, phrase):
    starts = np.cumsum([0] + [len(r) + 1 for r in runs])[:-1]
    seq = np.array([x for r in runs for x in [*r, 0]])
    index = phrases.ShardIndex(seq, starts, 5)
    lo, hi = index.search(np.array([phrase + [0] * 4]), np.array([len(phrase)]))
    found = sorted(index.locate(np.arange(lo[0], hi[0])).tolist())
    assert found == [i for i in range(len(seq)) if seq[i:i + len(phrase)].tolist() == phrase]


@pytest.mark.parametrize("name", ["op11_benchmark_decontamination", "op12_centroid_clustering"])
def test_new_queries_match_their_sql(spark, name):
    r = compare(spark, duck(SF_SMALL), name, E.queries()[name], E.oracle_sql()[name], SF_SMALL)
    assert r["ok"], r


# -- earlier operators: rows without ids, texts with added tokens ---------------------
def test_near_copies_without_ids_are_one_class(spark):
    from pagemill.llm import minhash
    words = [f"w{i}" for i in range(300)]
    near = " ".join([*words[:-1], "other"])
    rows = [(None, " ".join(words)), (None, near), (None, " ".join(words)), (None, "something else entirely " * 9), (5, "clean text of its own " * 9),
            (None, " ".join(words) + " tail"), (7, near + " again")]
    far = spark.createDataFrame(rows[:4], "doc_id long, text string")
    got = minhash.near_duplicates(far).collect()
    assert len({r.class_id for r in got}) == 2 and all(r.class_id < 0 for r in got)
    assert sorted(r.text for r in minhash.keep_first(far).collect()) == sorted([rows[3][1], min((rows[0][1], rows[1][1]), key=lambda t: _word_key(t))])
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.class_id for r in got if r.class_id is not None and r.class_id > 0) == [5, 7, 7, 7, 7, 7]
    kept = minhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id) for r in kept)) == ["5", "7", "None"]


def _word_key(text):
    import xxhash
    from pagemill.llm.minhash import split_words
    return xxhash.xxh3_128_digest(b" ".join(split_words(text)))


def test_blocks_of_any_size_give_the_same_classes(spark):
    """Groups whose members are alike but below the threshold, compared in blocks of two rows and of many."""
    from pagemill.llm import minhash
    from tests.llm import brute
    rng = np.random.default_rng(5)
    texts = {}
    for g in range(6):
        base = [f"g{g}w{i}" for i in range(120)]
        for k in range(12):
            words = list(base)
            for at in rng.choice(120, size=int(rng.integers(0, 7)), replace=False):
                words[at] = f"x{g}_{k}_{at}"
            texts[len(texts)] = " ".join(words)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute.near_duplicate_classes(texts)
    assert len(set(want.values())) > 6
    for block_rows in (2, 1024):
        assert {r.doc_id: r.class_id for r in minhash.near_duplicates(df, block_rows=block_rows).collect()} == want


def test_accepted_instances_go_from_rows_without_ids(spark):
    from pagemill.llm import personal
    seeds = [(i, f"please call hotline +1 (555) 010-2{i:03d} now") for i in range(20)]
    same = "please call hotline 555-010-9999 now"
    df = spark.createDataFrame([*seeds, (None, same), (99, same)], "doc_id long, text string")
    assert {r.text for r in personal.redact(df).where("doc_id IS NULL OR doc_id = 99").collect()} == {"please call hotline [PHONE] now"}


def test_added_tokens_in_texts_are_encoded_as_the_tokenizer_does(spark, paths):
    import zlib

    from pagemill.llm import packing
    from tokenizers import Tokenizer
    text = "hello <|endoftext|> world"
    ids = Tokenizer.from_file(paths[0]).encode(text, add_special_tokens=False).ids + [0]
    row = packing.pack_documents(spark.createDataFrame([(1, text)], "doc_id long, text string"), paths[0]).first()
    assert row.length == len(ids) == 5 and row.ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@pytest.mark.parametrize("doc_id", [1, None])
def test_equal_rows_share_what_is_left_of_a_target(spark, doc_id):
    from pagemill.llm import mixing
    df = spark.createDataFrame([(doc_id, "five words in this text", "a")] * 1000 + [(2, "w " * 4000, "b"), (3, "w " * 9000, "c")], "doc_id long, text string, source string")
    rows = mixing.mix_documents(df).where("source = 'a'").collect()
    assert len(rows) == 1000 and abs(sum(r.taken for r in rows) - rows[0].target) <= 500 and max(r.taken for r in rows) <= 15
