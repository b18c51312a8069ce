"""Token counts and packing against the library itself."""

import random
import zlib
from array import array

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from parallax.llm.packing import SumOfSquares, op6_packing, pack_documents
from parallax.llm.token_count import count_tokens, op2_token_counts, resync_ids
from parallax.llm.word_cache import WordEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", "   ", "Hello<|endoftext|>x <|ENDOFTEXT|> J̌ Å  it's 'S 1234.5, ...,, a.,b \x1c\x85\xa0x ΣΑΣ. İ ﬁ 中文字 ,. abc., 'Tis don't re've 😀.",
    "x" * 500, "A" * 100 + " " + "é" * 80, "straße ÀÉ÷× ñ́ abć. .́ a.b.c 3.14., (x), «mot».",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_word_cache_equals_library(library):
    rng = random.Random(3)
    alphabet = list("abcXYZ019 .,'\t\nßéÉ́ <|>") + ["<|endoftext|>", "'re", "中"]
    texts = [x or "" for x in ODD] + ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(1500)]
    got = WordEncoder(PATH).encode([t.encode() for t in texts])
    for t, ids in zip(texts, got, strict=True):
        assert array("I", ids).tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_resync_equals_whole(library):
    rng = random.Random(4)
    words = ["alpha", "be,", "don't", "Ünïcode", "x" * 300, "\n\n", "9876"]
    for chunk, overlap in ((50, 8), (200, 40)):
        text = " ".join(rng.choices(words, k=400)) + "y" * 700 + " end"
        assert resync_ids(library, text, chunk, overlap) == library.encode(text, add_special_tokens=False).ids


def test_counts_of_odd_texts(spark, library):
    rows = [(i, t, "a", 1) for i, t in enumerate(ODD)] + [(None, "two words", None, None), (3, ODD[3], "a", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string, n_tokens int")
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in count_tokens(df, PATH, chunk=40, overlap=4).collect())
    want = sorted((i or -1, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in rows)
    assert got == want
    assert count_tokens(df.limit(0), PATH).count() == 0


def test_query_counts(spark, sf_dir, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = op2_token_counts(spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        n = len(library.encode(docs[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(docs[r.doc_id].encode()), n > 2048)


def check_pieces(rows, docs, library):
    by_doc, by_window = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_window.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(docs)
    for d, pieces in by_doc.items():
        ids = library.encode(docs[d] or "", add_special_tokens=False).ids + [2]
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.length > 0
            assert p.ids_crc32 == zlib.crc32(array("I", ids[at : at + p.length]).tobytes())
            at += p.length
        assert at == len(ids)
    fills = []
    for pieces in by_window.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096
        fills.append(at)
    return fills


def test_query_packing(spark, sf_dir, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    fills = check_pieces(op6_packing(spark, sf_dir).collect(), docs, library)
    assert sum(f < 4096 for f in fills) <= 1


def test_packing_of_odd_texts(spark, library):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, t, 9) for i, t in enumerate(ODD)], "doc_id long, text string, start long")
    rows = pack_documents(df, PATH).withColumn("ids_crc32", F.crc32("ids")).collect()
    check_pieces(rows, dict(enumerate(ODD)), library)
    assert pack_documents(df.limit(0), PATH).count() == 0


def test_sum_of_squares_picks_the_least_sum():
    rng = random.Random(5)
    packer = SumOfSquares(size=12)
    for doc in range(300):
        s = rng.randint(1, 11)
        before = packer.count.copy()
        options = {}
        for h in [0, *(h for h in range(1, 12) if before[h] and h + s <= 12)]:
            n = before.copy()
            n[h] -= h > 0
            n[h + s] += h + s < 12
            options[h] = int((n**2).sum())
        packer.place(doc, b"\1\0\0\0" * s)
        assert int((packer.count**2).sum()) == min(options.values())


def test_the_rule_holds_for_any_number_of_open_windows():
    """Documents that never share a window: each opens one, and the rule goes on until the partition ends."""
    packer = SumOfSquares(64)
    for i in range(3000):
        packer.place(i, b"\1\0\0\0" * 33)
    assert not packer.done and packer.count.sum() == 3000 and packer.count[33] == 3000
    packer.pour()
    assert len(packer.done) == -(-3000 * 33 // 64) and sum(len(x[2]) for w in packer.done for x in w) == 3000 * 33 * 4


def test_a_full_cache_starts_anew(library):
    from parallax.llm.word_index import WordIndex

    encoder = WordEncoder(PATH)
    encoder.index = WordIndex(most_words=3)
    for text in ("one two three four five.", "six one two seven eight", "nine, Ten; eleven!"):
        assert array("I", encoder.encode([text.encode()])[0]).tolist() == library.encode(text, add_special_tokens=False).ids
