import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from clausewise.llm import language_id, packing, passage_quality, piece_codec, quality_rules
from clausewise.llm.common import WordTable
from pyspark.sql import functions as F

from . import brute

SF = "/root/testdata/sf0.01"


def test_word_table_forgets_without_changing_results():
    table = WordTable(lambda ws: [w.upper() for w in ws], limit=3)
    for text in ("a b c d e", "a b a b", "x y z a", "e d c b a"):
        assert table.of(text.split()) == text.upper().split()
    assert len(table.young) <= 8


def test_packing_is_a_partition_of_the_ids(docs, odd, rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for d, want in ((docs, [r[:2] for r in rows]), (odd, [(r["doc_id"], r["text"]) for r in odd.collect()])):
        pieces = packing.pack(d, shard_tokens=20_000).collect()
        ids = {}
        for i, t in want:
            ids.setdefault(i, []).append(tok.encode(t or "", add_special_tokens=False).ids + [2])
        for i, lists in ids.items():
            mine = sorted((p for p in pieces if p["doc_id"] == i), key=lambda p: (p["start"], p["sequence_id"]))
            if len(lists) == 1:
                assert [x for p in mine for x in np.frombuffer(p["ids"], "<u4").tolist()] == lists[0]
                assert all(p["doc_tokens"] == len(lists[0]) for p in mine)
            assert sum(p["length"] for p in mine) == sum(map(len, lists))
        sequences = {}
        for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
            assert p["offset"] == sequences.get(p["sequence_id"], 0)
            sequences[p["sequence_id"]] = p["offset"] + p["length"]
        assert all(n <= 4096 and n & (n - 1) == 0 for n in sequences.values())  # nothing to pad
        again = packing.pack(d.repartition(5), shard_tokens=20_000).collect()
        assert sorted(again) == sorted(pieces)


def test_packing_puts_neighbours_together():
    r = np.random.default_rng(0)
    topics = [r.integers(100 * t, 100 * t + 60, 300).astype("<u2") for t in range(40)]
    docs = [t[r.permutation(300)] for t in topics] + [t[r.permutation(300)] for t in topics]
    packer = packing.Packer(0, 600, 16)
    packer.shard(list(range(80)), docs)
    packer.finish()
    by = {}
    for s, _, doc, *_ in packer.done:
        by.setdefault(s, set()).add(doc % 40)
    assert sum(len(x) == 1 for x in by.values()) >= 38


def test_piece_codec(docs, odd, rows):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r["doc_id"]: r for r in piece_codec.encode_decode(docs, table_size=500).collect()}
    extra = ["▁", "▁▁ a", " a  b ", " x ", "   ", "é\x00z", "😀 b\n\n c"]
    for i, t in [r[:2] for r in rows]:
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        assert np.frombuffer(got[i]["piece_ids"], "<u4").tolist() == ids
        assert got[i]["decoded"] == sp.decode(ids)
    coder = piece_codec.ChunkCoder(public_tokenizers.path("piece_bpe_32k.model"))
    assert coder.cut
    for t in extra:
        ids = sp.encode(t, add_bos=True, add_eos=True)
        assert (np.frombuffer(coder.code(t)[0], "<u4").tolist(), coder.code(t)[1]) == (ids, sp.decode(ids))
    assert piece_codec.encode_decode(odd).columns == [*odd.columns, "piece_ids", "decoded"]


def _held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_passage_quality_on_held_out_rows(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    d = d.withColumn("held_out", language_id.held_out())
    assert all(r["held_out"] == _held(r["doc_id"]) for r in d.select("doc_id", "held_out").collect())
    model = passage_quality.fit(d.where("not held_out"), labels.where(~language_id.held_out()))
    got = {r["doc_id"]: r["score"] for r in passage_quality.score(d, model).collect()}
    test = [(r["quality"], got[r["doc_id"]]) for r in labels.collect() if _held(r["doc_id"])]
    good, bad = [s for q, s in test if q], [s for q, s in test if not q]
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([(s >= 0.5) == q for q, s in test]) > 0.93


def test_passage_quality_gradients():
    r = np.random.default_rng(0)
    a, x = passage_quality.Attention(4, 3), r.normal(size=(7, passage_quality.WIDTH))
    start, owner, label = np.array([0, 3]), np.array([0, 0, 0, 1, 1, 1, 1]), np.array([1.0, 0.0])

    def loss():
        y = a._forward(x, start, owner)["y"]
        return -(label * np.log(y) + (1 - label) * np.log(1 - y)).mean()

    for k, g in a._gradients(x, start, owner, label).items():
        at = (0,) * g.ndim
        a.p[k][at] += 1e-5
        up = loss()
        a.p[k][at] -= 2e-5
        assert abs((up - loss()) / 2e-5 - g[at]) < 1e-5
        a.p[k][at] += 1e-5


def test_passages_take_the_whole_text():
    texts = ["", " ".join(["w"] * 200), "x", "ä" * 300, "a\x00b  c"]
    x, owner = passage_quality.passages(texts)
    assert np.bincount(owner).tolist() == [1, 4, 1, 1, 1] and np.isfinite(x).all()
    for i, t in enumerate(texts):  # the same alone as among others
        assert np.allclose(passage_quality.passages([t])[0], x[owner == i], atol=1e-6)


def test_models_without_labels(spark, docs, odd, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = passage_quality.fit(docs, labels)
    assert {r["score"] for r in passage_quality.score(odd, model).collect()} == {0.5}
    none = language_id.fit(empty)
    assert {(r["lang_pred"], r["score"]) for r in language_id.identify(odd, none).collect()} == {("und", 0.0)}
    assert language_id.identify(empty, none).collect() == [] == passage_quality.score(empty, model).collect()


def test_language_id_on_held_out_rows(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").withColumn("held_out", language_id.held_out())
    model = language_id.fit(d.where("not held_out"))
    got = language_id.identify(d, model).where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_mixtures(spark, docs):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(d)
    text = {r["lang"]: r["text"] for r in d.orderBy("doc_id").collect() if len(r["text"]) > 1500}
    mixed = text["en"][:900] + " " + text["fr"][:500]
    pred, score, taken = model.judge([mixed, text["de"][:700], "12 %", "", "\x00a"])
    assert pred[:4] == ["en", "de", "und", "und"] and taken[0] == ["en", "fr"] and taken[1] == ["de"]
    assert score[2] == score[3] == 0 and 0.4 < score[0] < 0.9
    odd = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs, model).collect()}
    assert odd[1000] == odd[1001] == odd[1002] == "und"


def test_a_document_of_five_languages_has_five():
    r = np.random.default_rng(3)
    letters = ["abcde", "fghij", "klmno", "pqrst", "uvwxy", "zßäöü"]
    prose = [" ".join("".join(r.choice(list(x), 6)) for _ in range(600)) for x in letters]
    counts = np.zeros((1 << language_id.BITS, len(prose)))
    doc, gram, count = language_id.trigrams(prose)
    np.add.at(counts, (gram, doc), count)
    model = language_id.LanguageModel([f"l{i}" for i in range(len(prose))], counts)
    _, _, taken = model.judge([" ".join(p[:1400] for p in prose[:5]), prose[2]])
    assert set(taken[0]) == {"l0", "l1", "l2", "l3", "l4"} and taken[1] == ["l2"]


def test_quality_counts(docs, rows):
    got = {r["doc_id"]: r for r in quality_rules.judge(docs).collect()}
    for r in rows:
        want, g = brute.quality_counts(r[1]), got[r[0]]
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"]) == want
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert g["base_failed"] == failed and not (failed and g["kept"])


@pytest.mark.parametrize("support", [1, 30, 10 ** 6])
def test_quality_fences(docs, support):
    """Small groups' sketches are exact, so plain quantiles give the same fences."""
    got = quality_rules.judge(docs, support).collect()
    use = [r for r in got if r["n_words"] >= 50]

    def quantile(values, q):
        values = sorted(values)
        return values[max(0, int(np.ceil(q * len(values))) - 1)]

    for r in use:
        level = [x for x in use if (x["_lang"], x["_source"]) == (r["_lang"], r["_source"])]
        if len(level) < support:
            level = [x for x in use if x["_lang"] == r["_lang"]]
        if len(level) < support:
            level = use
        inside = True
        for rate, least in quality_rules.LEAST_SPREAD.items():
            lo, hi = (quantile([x[rate] for x in level], q) for q in (0.25, 0.75))
            reach = 3 * max(hi - lo, least)
            inside &= r[rate] <= hi + reach and (rate != "word_length" or r[rate] >= lo - reach)
        assert r["kept"] == (inside and not r["base_failed"])


def test_quality_keeps_clean_documents(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = {r["doc_id"]: r for r in quality_rules.judge(d).collect()}
    rows = [(labels[i], got[i]["kept"]) for i in labels if not got[i]["base_failed"]]
    assert np.mean([k for q, k in rows if q == 1]) > 0.98
    kept = [k for q, k in rows if q == 0]
    assert np.mean(kept) < 0.1


def test_quality_of_odd_rows(odd, empty):
    kept = quality_rules.quality_filter(odd)
    assert kept.columns == odd.columns and all(r["_id"] == 0 for r in kept.collect())
    assert quality_rules.judge(odd).count() == odd.count()
    assert quality_rules.judge(empty).collect() == quality_rules.quality_filter(empty).collect() == []


def test_digests(spark, docs):
    b = np.array([1, 2, 49407], "<u4").tobytes()
    assert spark.range(1).select(F.crc32(F.lit(b))).first()[0] == zlib.crc32(b)
    assert spark.range(1).select(F.sha2(F.lit(b), 256)).first()[0] == hashlib.sha256(b).hexdigest()
