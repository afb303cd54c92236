import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from corpusmill.llm.decontaminate import contaminated
from corpusmill.llm.toxicity import toxic_documents

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    labels, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        out = stage(spark, docs, SF)
        if name == "tokens":
            break
        assert out.columns == columns
        after = out.collect()
        assert all(r.text == seen[r.doc_id] for r in after)
        gone = {r.doc_id for r in before} - {r.doc_id for r in after}
        if name == "toxicity":
            assert gone == {r.doc_id for r in toxic_documents(docs, labels).where("toxic").collect()}
        if name == "near_dedup":
            texts = {}
            for r in before:
                texts.setdefault(r.text.lower().split().__repr__(), []).append(r.doc_id)
            kept = {r.doc_id for r in after}
            assert all(len(kept & set(ids)) <= 1 for ids in texts.values())
            grams = {r.doc_id: {tuple(r.text.lower().split()[j : j + 5]) for j in range(max(1, len(r.text.split()) - 4))} for r in before}
            for d in gone:  # nothing clean goes: some kept document is near
                assert max(len(grams[d] & grams[k]) / len(grams[d] | grams[k]) for k in {r.doc_id for r in before} - {d}) > 0.7
        if name == "decontamination":
            assert gone == {r.doc_id for r in contaminated(docs, items).collect()}
        if name == "mixing":
            assert all(0 <= [r.doc_id for r in after].count(r.doc_id) <= 2 for r in before)
        docs = spark.createDataFrame(after, out.schema)
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    at, want = 0, []
    for r in sorted(after, key=lambda r: r.doc_id):
        ids = [*lib.encode(r.text, add_special_tokens=False).ids, 2]
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in out.collect()) == want


def test_hard_rows(spark):
    rows = [(1, None, "en", None, 0), (2, "", None, "a", 0), (None, "x y", "en", "a", 1), (3, "some text " * 30_000, "en", "a", 1), (3, "some text " * 30_000, "en", "a", 1), (4, "plain words of no harm here", "en", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size int")
    for name, stage in corpus_pipeline.STAGES:
        for d in (docs, docs.limit(0)):
            out = stage(spark, d, SF)
            assert out.columns == docs.columns or name == "tokens"
            out.collect()
    assert sorted(str(r.doc_id) for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()) == ["1", "2", "3", "4", "None"]


def test_repeated_ids_are_drawn_row_by_row(spark):
    from corpusmill.llm.mixing import mix

    rows = [(i % 40, "w " * (i % 3 + 1) + str(i), ["a", "b", None][i % 3], i) for i in range(120)] + [(None, "x y", "a", 1000 + i) for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int")
    out = corpus_pipeline.mixing(spark, docs, SF)
    assert out.columns == docs.columns
    size = lambda t: len(t.split())
    taken = sum(size(r.text) for r in out.collect())
    assert taken == sum(r.taken for r in mix(docs).collect())
    assert all([r.copies for r in out.collect()].count(c) <= 2 for _, _, _, c in rows)


def test_texts_of_one_id_are_judged_apart(spark):
    """What goes repeats something that stays, also where an id has texts of two groups, or two of one."""
    words = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    a, b, c = (words(k, 120) for k in "abc")
    rows = [(3, a, "x"), (5, a + " more", "x"), (5, b, "x"), (9, b + " more", "x"), (11, c, "x"), (12, c, "y"), (20, words("d", 99), "x"), (20, words("d", 99) + " end", "x"), (20, words("e", 99), "x"), (21, words("e", 99), "z"), (20, words("e", 99), "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = corpus_pipeline.near_dedup(spark, docs, SF).collect()
    assert sorted((r.doc_id, r.text[:2]) for r in kept) == [(3, "wa"), (5, "wb"), (11, "wc"), (20, "wd"), (20, "we")]
