"""Token counts against the libraries on whole texts, with chunks so small that every text is spliced."""

import public_tokenizers
import pytest
from hypothesis import example, given, settings, strategies as st
from pyspark.sql import functions as F

from corpusmill.llm.common import read_table
from corpusmill.llm.counts import Counter, chunks, token_counts
from corpusmill.llm.queries import op13_token_counts

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"]
SCHEMA = "doc_id long, text string, lang string"
WORDS = ["the", " ", "  ", "\n", "\t ", "don't", "it'", "ll", "été", "é", "漢字かな", "🙂", "12", "345", "...", ", ", "<|endoftext|>", "<|endof", "text|>", "</s>", "▁", "▁a", " ", "　", "İ", "Σ", "x" * 40, "ᅡ", "\x00"]
TEXT = st.lists(st.sampled_from(WORDS), max_size=120).map("".join)


@pytest.fixture(scope="module")
def counters():
    return {f: Counter(public_tokenizers.path(f)) for f in FILES}


def whole(name, texts):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece

        return [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)]
    from tokenizers import Tokenizer

    return [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=150, deadline=None)
@given(text=TEXT)
@example(text="<|endoftext|>" * 30)
@example(text=" " * 300 + "a" + " " * 300)
@example(text="a b" * 200)
def test_every_common_place(counters, name, text):
    """Whichever common place of two chunks is taken, the ids of both sides sum up."""
    lib, raw = counters[name], text.encode()
    assert lib.parted
    want, overlap = whole(name, [text])[0], 160
    assert lib.count([raw]) == [want]
    for pick in (0, -1):
        total, held, parts = 0, None, [(a, n, lib.places(c), len(c)) for a, n, c in chunks(raw, 200, overlap)]
        for a, nxt, (at, before, n), size in parts:
            here = {int(p) + a: int(k) for p, k in zip(at, before)}
            if held is not None:
                both = sorted(set(held) & {p for p in here if p < a + overlap + 4})
                if not both:
                    return  # such texts are cut again
                total += held[both[pick]] - here[both[pick]]
            held = None if nxt is None else {p: k for p, k in here.items() if nxt <= p <= a + size - lib.margin - 1}
            last = n
        assert total + last == want


@pytest.mark.parametrize("name", FILES)
def test_spliced(spark, name):
    """Small chunks; overlaps without a common place are widened until there is one, or the text is one chunk."""
    words = "the quick brown fox, jumps over it's 12 lazy dogs\n"
    texts = ["", None, "a", words * 40, "x" * 5000, "é" * 3000, words * 5 + "漢" * 900 + words * 30, (" " * 700 + "a") * 4, words * 20 + "<|endoftext|>" * 200 + words * 9, "word " * 3000, "<|endoftext|> " * 99]
    rows = [(i, t, None) for i, t in enumerate(texts)] + [(3, texts[3], "again"), (None, texts[3], None), (None, None, None), (3, texts[6], None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"key": F.lit("k"), "n": F.lit(1), "n_tokens": F.lit(1)}).repartition(3)
    got = token_counts(df, public_tokenizers.path(name), limit=50, huge=300, chunk=200, overlap=150).collect()
    n = dict(zip(texts, whole(name, [t or "" for t in texts])))
    want = [(d, len((t or "").encode()), n[t], n[t] > 50) for d, t, _ in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = read_table(spark, sf, "documents").select("doc_id", "text").collect()
    n = whole(FILES[0], [d.text or "" for d in docs])
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in op13_token_counts(spark, sf).collect()}
    assert got == {d.doc_id: (len((d.text or "").encode()), k, k > 1024) for d, k in zip(docs, n)}
    assert sum(len((d.text or "").encode()) > 1 << 14 for d in docs) > 3  # such are cut


def test_no_rows(spark):
    assert token_counts(spark.createDataFrame([], SCHEMA), public_tokenizers.path(FILES[0])).count() == 0


def test_unknown_patterns_get_whole_texts(tmp_path):
    import json

    spec = json.load(open(public_tokenizers.path(FILES[1])))
    spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"(?<=a)b|[\p{L}]+"
    (tmp_path / "own.json").write_text(json.dumps(spec))
    assert not Counter(str(tmp_path / "own.json")).parted
