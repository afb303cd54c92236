import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from corpusmill.llm.common import scratch_path
from corpusmill.llm.tokens import END, Encoder, decode_document, expand, expansion_sizes, read_tokens, repair, token_table, write_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB, OWN = Tokenizer.from_file(PATH), Encoder(PATH)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["the", " ", "  ", "\n", "\t", "'s", "'", "É", "12", "<|endoftext|>", "!", " ", "x", "日本", "\x00", " ", "'ll"]), max_size=25))
def test_encoder_equals_library(parts):
    t = "".join(parts)
    assert OWN.encode([t])[0].tolist() == LIB.encode(t, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_encoder_any_text(t):
    if any(0xD800 <= ord(c) < 0xE000 for c in t):
        return
    assert OWN.encode([t])[0].tolist() == LIB.encode(t, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=200), min_size=1, max_size=8))
def test_repair_round_trip(docs):
    seq = np.array([x for d in docs for x in d])
    ends = np.cumsum([len(d) for d in docs])
    rules, body, at = repair(seq, ends, least=3)
    assert expand(rules, body).tolist() == seq.tolist()
    assert [expand(rules, body[a:b]).tolist() for a, b in zip(at[:-1], at[1:])] == docs
    assert [len(expand(rules, np.array([(1 << 17) + i], dtype=np.uint32))) for i in range(len(rules))] == expansion_sizes(rules).tolist()


@pytest.mark.parametrize("shard", [50, 1 << 20])
def test_token_table(spark, shard):
    rng = np.random.default_rng(0)
    rows = [(int(i) * 3, " ".join(f"w{x}é," for x in rng.integers(0, 30, int(rng.integers(0, 80)))) + "\n", 1) for i in range(300)]
    rows += [(1, None, 1), (2, "", 1), (5000, "again " * 30_000, 1), (5, "same", 1), (5, "same", 1), (None, "nil", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(5)
    got = token_table(df, PATH, shard_tokens=shard).collect()
    at, want = 0, []
    for d, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = LIB.encode(t or "", add_special_tokens=False).ids + [END]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.start, r.n_tokens, r.ids_crc32)) for r in got)
    assert token_table(df.limit(0), PATH).count() == 0


def test_one_document_alone(spark):
    rows = [(i, f"text {i % 7} of this shard is the same text again and again") for i in range(500)]
    path = scratch_path(spark, "tokens")
    write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path, PATH)
    for shard in spark.read.parquet(path).collect():
        for k in (0, len(shard["doc_ids"]) - 1):
            want = LIB.encode(rows[shard["doc_ids"][k]][1], add_special_tokens=False).ids + [END]
            assert decode_document(shard, k).tolist() == want
    assert read_tokens(spark, path).selectExpr("sum(n_symbols) < sum(n_tokens) / 3").first()[0]


def test_other_vocabulary():
    """A vocabulary whose pieces don't begin at spaces gets whole texts."""
    path = public_tokenizers.path("word_bpe_49k.json")
    lib, own = Tokenizer.from_file(path), Encoder(path)
    assert not own.parted and OWN.parted
    texts = ["Some words,  and more.", "", None, "a<|endoftext|>b c\n d", "déjà vu " * 50]
    assert [x.tolist() for x in own.encode(texts)] == [lib.encode(t or "", add_special_tokens=False).ids for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("abzÀßøŁжЯω日ǅ'é "), max_size=12), max_size=6))
def test_words_by_the_model(words):
    t = " ".join(words)
    assert Encoder.encode(OWN, [t])[0].tolist() == LIB.encode(t, add_special_tokens=False).ids


def test_repair_until_no_pair_is_frequent():
    rng = np.random.default_rng(3)
    seq = np.concatenate([np.tile(rng.integers(0, 9, 40), 50), np.zeros(3000, np.int64), rng.integers(0, 3, 4000)])
    rules, body, _ = repair(seq, np.array([len(seq)]), least=4)
    assert expand(rules, body).tolist() == seq.tolist()
    pairs = {}
    at = -2
    for i, p in enumerate(zip(body.tolist(), body.tolist()[1:])):
        if p[0] == p[1] and i == at + 1 and body[i] == body[i - 1]:
            continue  # overlaps the one before
        at = i
        pairs[p] = pairs.get(p, 0) + 1
    assert sum(n >= 8 for n in pairs.values()) == 0 and len(body) < len(seq) / 3
