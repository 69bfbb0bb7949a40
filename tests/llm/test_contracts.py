"""Every registered query of the training-data operators against brute force on whole small tables."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from tests.conftest import SF_MID, SF_SMALL
from tests.llm import brute


@pytest.fixture(scope="module")
def run(spark):
    def rows(name, sf=SF_SMALL):
        full = next(q for q in E.queries() if q.startswith(name))
        return E.queries()[full](spark, sf).collect()
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def texts(docs):
    return {d: r.text for d, r in docs.items()}


def test_the_first_ten_and_the_pipeline_are_registered():
    names = E.queries()
    assert "pipeline" in names
    assert all(sum(q.startswith(f"op{n}_") for q in names) == 1 for n in range(1, 11))


def test_packing(run, texts):
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: t.encode(x or "", add_special_tokens=False).ids + [0] for d, x in texts.items()}
    pieces, places = {}, {}
    for r in run("op1_"):
        pieces.setdefault(r.doc_id, []).append(r)
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        part = np.array(ids[r.doc_id][r.start:r.start + r.length], dtype="<u4")
        assert r.ids_crc32 == zlib.crc32(part.tobytes())
    assert set(pieces) == set(ids)
    for d, rs in pieces.items():
        rs.sort(key=lambda r: r.piece)
        assert [r.piece for r in rs] == list(range(len(rs))) == list(range(-(-len(ids[d]) // 2048)))
        assert [r.length for r in rs[1:]] == [2048] * (len(rs) - 1) and sum(r.length for r in rs) == len(ids[d])
        assert [r.start for r in rs] == list(np.cumsum([0] + [r.length for r in rs])[:-1])
    for inside in places.values():
        inside.sort()
        assert [o for o, _ in inside] == list(np.cumsum([0] + [n for _, n in inside])[:-1]) and sum(n for _, n in inside) <= 2048
    assert len(places) == -(-sum(map(len, ids.values())) // 2048)


def test_near_dedup(run, texts):
    want = brute.near_duplicate_classes(texts)
    got = {r.doc_id: (r.class_id, r.kept) for r in run("op2_")}
    assert got == {d: (c, c == d) for d, c in want.items()}
    assert any(d != c for d, c in want.items())


def test_near_dedup_on_more_rows(run, spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_MID}/documents.parquet").collect()}
    want = brute.near_duplicate_classes(texts)
    assert {r.doc_id: r.class_id for r in run("op2_", SF_MID)} == want


def test_personal_data(run, texts):
    rows = {r.doc_id: r for r in run("op3_")}
    assert set(rows) == set(texts)
    for d, r in rows.items():
        spans = brute.personal_spans(texts[d])
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in spans) for k in ("email", "ip", "card", "phone")]
        assert set(spans) <= set(filter(None, r.spans.split(",")))
    assert sum(r.n_ip + r.n_phone + r.n_email for r in rows.values())


def test_sharding(run, texts):
    rows = run("op5_", SF_MID)
    table = {r.slot: r.shard for r in rows}
    assert all(r.slot == int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:12], 16) % 16381 for r in rows)
    assert len({(r.slot, r.shard) for r in rows}) == len(table) and len(rows) == 1000


def test_repeats(run, texts):
    want = brute.remove_repeats(texts)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in run("op6_")} == want
    assert any(0 < w[1] < w[0] for w in want.values())


def test_rules(run, texts):
    for r in run("op7_"):
        want = brute.rules(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
        assert not (r.base_failed and r.kept)


def test_rules_keep_good_documents(run, spark):
    good = {r.doc_id for r in spark.read.parquet(f"{SF_MID}/labels.parquet").where("quality = 1").collect()}
    rows = [r for r in run("op7_", SF_MID) if r.doc_id in good and not r.base_failed]
    assert rows and all(r.kept for r in rows)


@pytest.mark.parametrize(("name", "label", "threshold", "least"), [("op4_", "quality", 0.3, 0.9), ("op8_", "toxic", 0.5, 0.93)])
def test_classifier(run, spark, name, label, threshold, least):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF_MID}/labels.parquet").collect()}
    rows = run(name, SF_MID)
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= threshold) for r in rows)
    tested = [r for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in tested]) >= least


def test_mixing(run, docs):
    sizes = {d: len(brute.words(r.text)) for d, r in docs.items()}
    sources = {}
    for d, r in docs.items():
        sources[r.source] = sources.get(r.source, 0) + sizes[d]
    targets, taken = brute.mix_targets(sources), {}
    rows = run("op9_")
    for r in rows:
        s = docs[r.doc_id].source
        assert r.size == sizes[r.doc_id] and r.source_size == sources[s] and r.target == pytest.approx(targets[s])
        assert 0 <= r.taken <= 3 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    assert all(abs(taken[s] - targets[s]) <= 1 for s in targets)
    assert sorted(rows) == sorted(run("op9_"))


def test_vectors(run, spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()]
    want = brute.vector_links(rows)
    assert {r.vec_id: (r.n_links, r.component_id) for r in run("op10_")} == want


def test_pipeline(run, spark, texts):
    """The stages one by one against brute force."""
    import corpus_pipeline as P
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    from pagemill.llm.common import materialise
    kept = materialise(P.quality_rules(spark, docs, SF_SMALL), "t")
    assert kept.columns == docs.columns
    verdict = {r.doc_id: r.kept for r in run("op7_")}
    assert {r.doc_id for r in kept.collect()} == {d for d, k in verdict.items() if k}
    once = materialise(P.near_dedup(spark, kept, SF_SMALL), "t")
    classes = brute.near_duplicate_classes({r.doc_id: r.text for r in kept.collect()})
    assert sorted(r.doc_id for r in once.collect()) == sorted(set(classes.values()))
    clean = materialise(P.personal_data(spark, once, SF_SMALL), "t")
    before = {r.doc_id: r for r in once.collect()}
    for r in clean.collect():
        assert brute.personal_spans(r.text) == [] and r.source == before[r.doc_id].source
        if not brute.personal_spans(before[r.doc_id].text):
            assert r == before[r.doc_id]
        else:
            assert r.n_chars == len(r.text)
    mixed = materialise(P.source_mixing(spark, clean, SF_SMALL), "t")
    assert mixed.columns == docs.columns
    sizes = {}
    for r in clean.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(brute.words(r.text))
    targets, taken, largest = brute.mix_targets(sizes), {}, {}
    for r in mixed.collect():
        n = len(brute.words(r.text))
        taken[r.source], largest[r.source] = taken.get(r.source, 0) + n, max(largest.get(r.source, 0), n)
    unused = {s: max(len(brute.words(r.text)) for r in clean.collect() if r.source == s) for s in targets}
    assert all(abs(taken.get(s, 0) - targets[s]) <= max(largest.get(s, 0), unused[s]) / 2 + 1 for s in targets)
    packed = P.best_fit_packing(spark, mixed, SF_SMALL)
    assert packed.where(F.col("piece") == 0).count() == mixed.count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    assert len(run("pipeline")) == packed.count()
