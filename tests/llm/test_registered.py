"""The registered queries that SQL cannot express, run as they are registered."""

import struct
import zlib

import pytest
from clausewise.llm import queries

from . import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def run(spark, name):
    return queries.QUERIES[name](spark, SF).collect()


def test_op1_pieces_are_the_tokens(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, sequences = {}, {}
    for r in run(spark, "op1_retrieval_packing"):
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert pieces.keys() == texts.keys()
    for doc, mine in pieces.items():
        ids = tok.encode(texts[doc], add_special_tokens=False).ids + [2]
        at = 0
        for r in sorted(mine, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            part = ids[at:at + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            at += r["length"]
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 4096


def test_op2_is_brute_force(spark, texts):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in run(spark, "op2_runlength_index")}
    assert got == brute.repeats(texts.items())


def test_op4_spans_lie_in_their_documents(spark, texts):
    found = run(spark, "op4_compact_windows")
    assert found
    for r in found:
        assert r["first_id"] < r["doc_id"] and r["start_word"] >= 0 and r["n_words"] > 0
        assert r["start_word"] + r["n_words"] <= len(brute.words(texts[r["doc_id"]]))


def test_op6_is_the_library(spark, texts):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in run(spark, "op6_piece_codec"):
        ids = sp.encode(texts[r["doc_id"]], add_bos=True, add_eos=True)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == brute.sha(struct.pack(f"<{len(ids)}I", *ids))
        assert r["decoded_sha256"] == brute.sha(sp.decode(ids))


@pytest.mark.parametrize("name", ["op7_passage_quality", "op10_language_id"])
def test_models_score_every_document(spark, texts, name):
    found = {r["doc_id"]: r for r in run(spark, name)}
    assert found.keys() == texts.keys()
    for doc, r in found.items():
        assert r["held_out"] == (zlib.crc32(str(doc).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1
        if name.startswith("op7"):
            assert r["predicted"] == (r["score"] >= 0.5)


def test_op8_counts_are_brute_force(spark, texts):
    found = {r["doc_id"]: r for r in run(spark, "op8_quality_rules")}
    assert found.keys() == texts.keys()
    for doc, r in found.items():
        want = brute.quality_counts(texts[doc])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_op9_is_brute_force(spark, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in run(spark, "op9_jaccard_join")}
    assert got == brute.components(texts.items(), 4, 85, 100)
