"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns for every operator."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.llm import embeddings, minhash, mixing, packing, personal, quality, rules, sharding, suffixes, toxicity
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, label int, size long, row string, _n int"
LONG = " ".join(f"w{i % 997}x{i}" for i in range(30_000))
ODD = [
    (1, None, "en", "a"), (2, "", "en", None), (3, "   \n\t ", None, "b"), (4, LONG, "en", "a"), (5, LONG, "en", "a"),
    (6, "mail me at a.b@c-d.org, +1 (555) 010-2030 or 10.0.0.255 \U0001F600 x@y.z_q@r.st 4111 1111 1111 1111", "en", "b"),
    (6, "mail me at a.b@c-d.org, +1 (555) 010-2030 or 10.0.0.255 \U0001F600 x@y.z_q@r.st 4111 1111 1111 1111", "en", "b"),
    (7, "the same line\nthe same line\nthe same line of é words", "fr", ""), (8, "one", "en", "b"), (9, "one", "en", "c"),
    (None, "a text without id " * 20, None, None), (10, "9" * 3000 + " a@" + "b" * 3000, "en", "b"), (11, "a " * 3000, "en", "c"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, len(r[1] or ""), "k", 1, 5, "r", 7) for r in ODD], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 1), (6, 1, 0), (7, None, None), (None, 1, 1), (99, 0, 0)], "doc_id long, quality int, toxic int")


def test_empty_tables(spark, empty, tokenizer, labels):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    for df in (packing.pack_documents(empty, tokenizer), minhash.near_duplicates(empty), minhash.keep_first(empty), personal.extract(empty),
               personal.redact(empty), quality.classify(empty, labels), toxicity.classify(empty, labels), sharding.assign_shards(empty),
               suffixes.remove_repeats(empty), rules.measure(empty), rules.keep_good(empty), mixing.mix_documents(empty),
               mixing.repeat_documents(empty), embeddings.near_duplicates(none)):
        assert df.collect() == []


def test_row_operators_keep_every_row_and_column(odd):
    key = lambda r: (str(r.doc_id), str(r.text))
    kept = minhash.keep_first(odd)
    assert kept.columns == odd.columns
    # 1, 2 and 3 have no words; 4 and 5, the rows of 6, and 8 and 9 are copies
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "4", "6", "7", "8", "10", "11", "None"])
    clean = personal.redact(odd)
    assert clean.columns == odd.columns and clean.count() == len(ODD)
    for r in clean.collect():
        assert r.key == "k" and r.size == 5 and brute.personal_spans(r.text) == []
    mixed = mixing.repeat_documents(odd)
    assert mixed.columns == odd.columns and {key(r) for r in mixed.collect()} <= {(str(r[0]), str(r[1])) for r in ODD}
    assert rules.keep_good(odd).columns == odd.columns


def test_packing(odd, tokenizer):
    rows = packing.pack_documents(odd, tokenizer).collect()
    assert sum(r.piece == 0 for r in rows) == len(ODD)
    assert [r.length for r in rows if r.doc_id in (1, 2)] == [1, 1]
    used = {}
    for r in rows:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for inside in used.values():
        inside.sort()
        assert [o for o, _ in inside] == list(np.cumsum([0] + [n for _, n in inside])[:-1])


def test_classes(odd):
    rows = minhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    got = {r.doc_id: r.class_id for r in rows}
    assert [got[d] for d in (1, 2, 3, 4, 5, 8, 9)] == [1, 1, 1, 4, 4, 8, 8]


def test_spans(odd):
    for r in personal.extract(odd).collect():
        text = next(t for d, t, *_ in ODD if d == r.doc_id)
        assert r.base_sha256 == hashlib.sha256(",".join(brute.personal_spans(text)).encode()).hexdigest(), r


def test_repeats(odd):
    texts = {d: t for d, t, *_ in ODD if d not in (6, None)}
    rows = suffixes.remove_repeats(odd.where("doc_id IS NULL OR doc_id != 6")).collect()
    assert len(rows) == len(texts) + 1
    want = brute.remove_repeats(texts | {-1: ODD[10][1]})
    for r in rows:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[-1 if r.doc_id is None else r.doc_id]


def test_counts(odd):
    rows = rules.measure(odd).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        text = next(t for d, t, *_ in ODD if d == r.doc_id)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.rules(text)


def test_scores(odd, labels):
    for op in (quality, toxicity):
        rows = op.classify(odd, labels).collect()
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if r.doc_id in (1, 2, 3)}) == 1


def test_shards(odd):
    rows = sharding.assign_shards(odd, shards=3, size=13).collect()
    assert len(rows) == len(ODD) and all(0 <= r.shard < 3 for r in rows)


def test_mix(odd):
    rows = mixing.mix_documents(odd).collect()
    assert len(rows) == len(ODD) and all(0 <= r.taken <= 3 * r.size for r in rows)


def test_table_gives_every_shard_its_share():
    slots = sharding.fill_table([f"s{i}" for i in range(7)], 101)
    counts = np.bincount(slots)
    assert len(slots) == 101 and counts.max() - counts.min() <= 1
    fewer = sharding.fill_table([f"s{i}" for i in range(6)], 101)
    assert sum(a == b for a, b in zip(slots, fewer, strict=True) if a < 6) > 60
    with pytest.raises(ValueError, match="prime"):
        sharding.fill_table(["a"], 100)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=9))
def test_bin_completion_is_optimal(items):
    hist = {x: items.count(x) for x in set(items)}
    solution = packing.bin_completion(hist, 12)
    used = {}
    for pattern, times in solution:
        assert sum(x * k for x, k in pattern) <= 12
        for x, k in pattern:
            used[x] = used.get(x, 0) + k * times
    assert used == hist
    def fewest(left, bins):
        if not left:
            return len(bins)
        best = len(bins) + len(left)
        for i in {b: i for i, b in enumerate(bins)}.values():
            if bins[i] >= left[0]:
                best = min(best, fewest(left[1:], bins[:i] + [bins[i] - left[0]] + bins[i + 1:]))
        return min(best, fewest(left[1:], [*bins, 12 - left[0]]))
    assert sum(n for _, n in solution) == fewest(sorted(items, reverse=True), [])


def test_signatures_estimate_weighted_overlap():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 2 ** 63, 400, dtype=np.uint64)
    for wa, wb in (((1, 1), (1, 1)), ((5, 9), (7, 2)), ((1, 40), (3, 40))):
        a = np.concatenate([np.repeat(keys[:300], wa[0]), np.repeat(keys[300:360], wa[1])])
        b = np.concatenate([np.repeat(keys[60:300], wb[0]), np.repeat(keys[300:], wb[1])])
        x, y = minhash.bag_signatures([a, b], 4096)
        assert (x == y).mean() == pytest.approx(minhash.overlap(a, b), abs=0.04)


def test_hot_groups_take_the_exact_ways(spark):
    """Many different texts around one passage, and one bucket that many classes share."""
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    passage = " ".join(word() for _ in range(60))
    rows = [(i, " ".join(word() for _ in range(int(rng.integers(3, 60)))) + " " + passage[:int(rng.integers(220, 420))] + " "
             + " ".join(word() for _ in range(int(rng.integers(0, 60))))) for i in range(60)]
    rows += [(100 + i, rows[i][1] + " tail") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.remove_repeats(dict(rows))
    for keep in ("none", "first"):
        cuts = suffixes.repeated_spans(docs, 200, keep, block_rows=5).collect()
        got = {r.doc: suffixes._cut(dict(rows)[r.doc].encode(), r.spans, r.whole) for r in cuts}
        want = brute.remove_repeats(dict(rows), 200, keep)
        for d, text in rows:
            n, runs, kept = got.get(d, (0, 0, text.encode()))
            assert (len(text), n, runs, hashlib.sha256(kept).hexdigest()) == want[d], (keep, d)
    classes = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs, block_rows=4).collect()}
    assert classes == brute.near_duplicate_classes(dict(rows))


def test_vectors_with_clusters_and_odd_rows(spark):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(6, 8))
    rows = [(i, [float(x) for x in centres[i % 6] + rng.normal(size=8) * 0.25], int(i % 2)) for i in range(240)]
    rows += [(300, None, 1), (301, [0.0] * 8, 1), (302, [float("nan")] * 8, 1), (303, [1.0, None], 1), (304, rows[0][1], None),
             (305, rows[0][1], 0), (306, rows[0][1], 0), (307, [2 * x for x in rows[0][1]], 0), (308, rows[0][1], 1), (309, [1.0], 1), (310, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = brute.vector_links(rows)
    for sizes in ({}, {"cell_rows": 20, "block_rows": 7}):
        got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(df, **sizes).collect()}
        assert got == want
    assert sum(n for n, _ in want.values()) > 100


def test_contexts_discover_unseen_identifiers(spark):
    """Numbers that the base patterns miss are found behind a pattern that seeds support."""
    rows = [(i, f"some words here please call hotline +1 555 010 2{i:03d} soon") for i in range(12)]
    rows += [(50, "some words here please call hotline 555-010-9999 soon"), (51, "chapter 3 of 555-010-7777 pages")]
    got = {r.doc_id: r.spans for r in personal.extract(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    at = rows[12][1].index("555-")
    assert got[50] == f"phone:{at}:{at + 12}" and got[51] == ""


def test_unseen_identifiers_may_outnumber_seeds(spark):
    """Twice as many unseen numbers as seeds of their pattern, and patterns that only accepted numbers support."""
    rows = [(i, f"some words here please call hotline +1 555 010 2{i:03d} soon") for i in range(100)]
    rows += [(1000 + i, f"some words here please call hotline 555-010-3{i:03d} soon") for i in range(200)]
    rows += [(2000 + i, f"at night the reserve desk 555-010-3{i:03d} answers") for i in range(5)]
    rows += [(3000, "at night the reserve desk 555-019-4444 answers"), (3001, "a lone note quotes number 555-019-5555 only")]
    got = {r.doc_id: r.n_more for r in personal.extract(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[1000 + i] == 1 for i in range(200))
    assert got[3000] == 1 and got[3001] == 0


def test_identifiers_in_groups_and_behind_numbers(spark):
    """Numbers written with blanks are one candidate; a number among the words before is part of the pattern."""
    texts = [f"some words here please call hotline +1 555 010 2{i:03d} soon" for i in range(12)]
    texts += [f"in room {i} hotline +1 555 010 4{i:03d} soon" for i in range(10, 20)] + [f"paid by the card 4111 1111 1111 1111 in {i}" for i in range(3)]
    texts += [f"paid by the card {n} today" for n in ("4012 8888 8888 1881", "5555 5555 5555 4444", "3782 8224 6310 0005 ", "6011 1111 1111 1117", "4222 2222 2222 2220")]
    plain = {50: "please call hotline (743) 555-3824 soon", 51: "paid by the card 4111 1111 1111 1112 today", 52: "in room 12 hotline 555-010-9999, or",
             53: "\U0001F600 a b 7 x (743)555-3824 y", 54: "of 1999 2000 pages", 55: "1 2 3 4 5 6 7 8 " * 400}
    rows = list(enumerate(texts, 100)) + list(plain.items())
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in personal.extract(df).collect()}

    def span(d, part, kind):
        at = plain[d].index(part)
        return f"{kind}:{at}:{at + len(part)}"
    assert got[50] == span(50, "743) 555-3824", "phone") and got[51] == span(51, "4111 1111 1111 1112", "card")
    assert got[52] == span(52, "555-010-9999", "phone") and got[53] == span(53, "743)555-3824", "phone")
    assert got[54] == got[55] == ""
    clean = {r.doc_id: r.text for r in personal.redact(df).collect()}
    assert clean[50] == "please call hotline ([PHONE] soon" and clean[51] == "paid by the card [CARD] today"


def test_contexts_are_the_end_of_the_whole_text_before(spark):
    from pyspark.sql import functions as F
    text = "é1 " + " ".join(f"{'w' * (i % 5)}{i}" for i in range(150)) + " " + "long " * 40 + "7 8"
    found = spark.range(1).select(personal.located(F.lit(text), personal.LIKELY).alias("z")).head().z
    assert len(found) == 153
    assert all(z.before == text[:z.s][-personal.CONTEXT_CHARS:] and z.m == text[z.s:z.e] for z in found)


def test_patterns_need_believed_instances(spark):
    """Four seeds and any number of unseen instances don't make a pattern count; five do."""
    edges = [("phone", "a b", f"s{i}", True) for i in range(4)] + [("phone", "a b", f"u{i}", False) for i in range(50)]
    edges += [("phone", "c d", f"t{i}", True) for i in range(5)] + [("phone", "c d", f"v{i}", False) for i in range(50)]
    got = personal.bootstrap(spark.createDataFrame(edges, "kind string, pat string, inst string, seed boolean")).collect()
    assert {r.inst for r in got} == {f"v{i}" for i in range(50)}


def test_pairs_that_only_interactions_explain():
    """Two terms that are harmful together and harmless apart."""
    rng = np.random.default_rng(2)
    bags, marks = [], []
    for _ in range(1500):
        a, b = rng.random(2) < 0.3
        bags.append(np.array(sorted({*rng.integers(100, 400, 10).tolist()} | ({1} if a else set()) | ({2} if b else set()))))
        marks.append(float(a and b))
    model = toxicity.fit(bags, np.array(marks))
    def margin(*ids):
        return model.margins(np.array(ids), np.array([0]))[0]
    assert margin(1, 2) > 0 > max(margin(1), margin(2), margin(150))


def test_rare_insults_have_weights():
    """A term in 12 of 12,000 documents, all of them toxic, is enough by itself."""
    rng = np.random.default_rng(3)
    bags, marks = [], []
    for i in range(12_000):
        terms = set((100 + rng.zipf(1.3, 20) % 5000).tolist())
        bags.append(np.array(sorted(terms | ({1} if i < 12 else set()))))
        marks.append(float(i < 12 or rng.random() < 0.11))
    model = toxicity.fit(bags, np.array(marks))
    def margin(*ids):
        return model.margins(np.array(ids), np.array([0]))[0]
    assert margin(1) > 0 > margin(99) and np.mean(model.weight[100:5100] != 0) < 0.02
