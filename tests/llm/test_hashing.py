"""Strings on which sums of weighted bytes cancel, in every operator that names text by hashes."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import jaccard_join, quality_rules, queries, sentencepiece_codec, sstable, textscan, unitmemo

BPE = queries.tokenizer_path("byte_bpe_50k.json")
PIECES = queries.tokenizer_path("piece_bpe_32k.model")


def thue_morse(n: int) -> tuple[str, str]:
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.fixture(params=[8, 64, 1024, 4096])
def pair(request):
    return thue_morse(request.param)


def test_span_hash(pair):
    x, y = pair
    for _, _, s in textscan.slices(pa.array([f"{x} {y} {x}", y])):
        h = s.words().tolist()
        assert h[0] == h[2] != h[1] == h[3]
        assert set(h).isdisjoint(s.words(5).tolist())


def test_span_hash_is_of_the_bytes_alone():
    rng = np.random.RandomState(1)
    parts = ["".join(rng.choice(list("abé日"), rng.randint(1, 40))) for _ in range(300)]
    names: dict[str, int] = {}
    for shift in range(9):
        for _, _, s in textscan.slices(pa.array(["x" * shift + " " + " ".join(parts)])):
            for p, h in zip(parts, s.words()[-300:].tolist(), strict=True):
                assert names.setdefault(p, h) == h
    assert len(set(names.values())) == len(names)


def test_lines(pair):
    x, y = pair
    for _, _, s in textscan.slices(pa.array([f"{x}\n{y}", f"{x}\n{y}\n{x}", f"{y}\n{y}\n{y}"])):
        assert quality_rules.measure(s, quality_rules.Rules())["n_dup_lines"].tolist() == [0, 1, 2]


def test_lines_that_share_a_hash(monkeypatch):
    monkeypatch.setattr(textscan.Slice, "span_hash", lambda self, a, b, seed=0: np.zeros(len(a), np.uint64))
    for _, _, s in textscan.slices(pa.array(["one\ntwo\none\nsix", "one\nsix"])):
        assert quality_rules.measure(s, quality_rules.Rules())["n_dup_lines"].tolist() == [1, 0]


def test_units_that_share_a_hash(monkeypatch):
    monkeypatch.setattr(textscan.Slice, "span_hash", lambda self, a, b, seed=0: np.full(len(a), 7, np.uint64))
    table = unitmemo.TokenTable(lambda units: [f"<{u}>".encode("utf-16-le") for u in units], np.dtype("<u2"), slots=64)
    texts = ["ab", "ac", "ab", "a longer unit", "a longer unix", ""]
    for _, _, s in textscan.slices(pa.array(texts)):
        assert [b.decode("utf-16-le") for b in table(s, s.offsets[:-1])] == [f"<{t}>" if t else "" for t in texts]


def test_components(spark, pair):
    x, y = pair
    docs = spark.createDataFrame([(1, x), (2, y), (3, f"{x} {y}"), (4, f"{y} {x}"), (5, y.upper())], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard_join.cluster(docs).collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 2}


def test_token_ids(spark, pair):
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(BPE)
    texts = {1: pair[0], 2: pair[1], 3: f"{pair[1]} {pair[0]}"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    got = sstable.digest(sstable.write(docs, BPE, 2, sstable.new_folder(docs)), 2).collect()
    want = {i: zlib.crc32(np.array([*encoder.encode(t).ids, 2], "<u4").tobytes()) for i, t in texts.items()}
    assert {r.doc_id: r.ids_crc32 for r in got} == want


def test_pieces(spark, pair):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = {1: pair[0], 2: pair[1], 3: f"{pair[1]} {pair[0]}"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    assert {r.doc_id: r.ids for r in sentencepiece_codec.tokenise(docs, PIECES).collect()} == {i: library.encode(t) for i, t in texts.items()}
    assert all(r.parity and r.round_trip for r in sentencepiece_codec.round_trip(docs, PIECES).collect())
