"""Alignment of two tokenizers against loops over token occurrences."""

import collections
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import alignment, queries

DIR = "/root/testdata/sf0.001"
A, B = queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("piece_bpe_32k.model")
ODD = [(9001, None), (9002, ""), (9003, " "), (9004, "a▁b"), (9005, "<|endoftext|> </s> <s>"), (9006, "日本語 🙂 é"), (9007, "twice"), (9007, "twice"), (9007, "other"), (None, "no id"), (None, None), (9008, "\x00\n\t "), (9009, "supercalifragilistic " * 3000), (9010, "x" * 3000)]


@pytest.fixture(scope="module")
def docs(spark):
    base = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame(ODD, "doc_id long, text string")
    return base.union(odd).withColumn("n_a", F.lit("clash")).withColumn("pairs", F.lit(1)).withColumn("task", F.lit(None).cast("string")).cache()


def plain(texts):
    """Per text (A ids and ends, B ids and ends), by the two libraries."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    back = {chr(x): x for x in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    back |= {chr(256 + i): x for i, x in enumerate(x for x in range(256) if chr(x) not in back)}
    out = []
    for t in texts:
        ia, ib = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        raw = [bytes(back[c] for c in a.id_to_token(i)) for i in ia], [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ib)]
        if any(b"".join(r) != (" " + (t or "")).encode() for r in raw):
            ia, ib, raw = [], [], ([], [])
        out.append((ia, ib, *(np.cumsum([len(x) for x in r]).tolist() for r in raw)))
    return out


def brute(texts):
    rows, held = [], []
    for ia, ib, ea, eb in plain(texts):
        both = sorted(set(ea) & set(eb))
        spelled, sa, sb = [], 0, 0
        for e in both:
            xa, xb = ea.index(e) + 1, eb.index(e) + 1
            spelled.append(",".join(map(str, ia[sa:xa])) + "|" + ",".join(map(str, ib[sb:xb])))
            sa, sb = xa, xb
        links, j = [], 0
        for i, e in enumerate(ea):
            start = ea[i - 1] if i else 0
            while j and (eb[j - 1] > start):
                j -= 1
            while j < len(eb) and (eb[j - 1] if j else 0) < e:
                if eb[j] > start:
                    links.append((ia[i], ib[j]))
                j += 1
            j = max(j - 1, 0)
        held.append(links)
        rows.append((len(ia), len(ib), len(both), len(links), hashlib.sha256(";".join(spelled).encode()).hexdigest() if ia else ""))
    count = collections.Counter(p for links in held for p in set(links))
    best = collections.defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    return [(*r[:4], sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), r[4]) for r, links in zip(rows, held, strict=True)]


def query(docs, **kw):
    aligned = alignment.materialise(alignment.align(docs, A, B), "aligned")
    scored = alignment.score(aligned, alignment.pair_counts(aligned, len(alignment.vocabularies(A, B)[1].size)), **kw)
    return collections.Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in scored.collect())


def test_against_loops(docs, monkeypatch):
    rows = docs.select("doc_id", "text").collect()
    want = collections.Counter((r.doc_id, *x) for r, x in zip(rows, brute([r.text for r in rows]), strict=True))
    assert sum(x[1] == 0 for x in want.elements()) == 4
    assert query(docs) == want
    # counts that are joined, not sent; documents in many partitions
    assert query(docs.repartition(7), broadcast_pairs=10) == want


def test_long_documents_are_streamed(spark, docs, monkeypatch):
    """A machine that is fed in runs of few tokens says the same as one that sees whole documents."""
    vocab = alignment.vocabularies(A, B)
    texts = [r.text for r in docs.limit(40).collect()] + [t for _, t in ODD]
    tokens = [(np.array(x[0], "<u2"), np.array(x[1], "<u2")) for x in plain(texts)]

    def run(step):
        m = alignment.Machine(vocab)
        for i, sides in enumerate(tokens):
            runs = []
            for side, ids in enumerate(sides):
                ends = np.concatenate([[0], np.cumsum(vocab[side].size[ids])])
                runs += [(int(ends[k]), side, ids[k : k + step].tobytes()) for k in range(0, len(ids), step)] or ([(0, 0, b"")] if side == 0 else [])
            for _, side, raw in sorted(runs):
                m.feed((0, i), i, side, raw)
        m.close()
        m.flush()
        return [(k, d, c, s, p.tolist(), n.tolist()) for k, d, c, s, p, n in sorted(m.take(), key=lambda r: r[0])]

    whole = run(1 << 20)
    monkeypatch.setattr(alignment, "SWEEP", 50)
    assert run(7) == whole
    assert [r[2][0] for r in whole] == [len(a) for a, _ in tokens]


def test_groups_are_the_tokens_in_order(docs):
    rows = alignment.groups(docs.where("doc_id < 40 OR doc_id > 9003"), A, B).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for i in (3, 9005, 9006, 9009, 9010):
        own = sorted(by[i], key=lambda r: r.start)
        ia, ib, ea, eb = plain([texts[i]])[0]
        assert [x for r in own for x in r.a_ids] == ia and [x for r in own for x in r.b_ids] == ib
        assert [r.end for r in own] == sorted(set(ea) & set(eb)) and [r.start for r in own] == [0, *(r.end for r in own[:-1])]
    assert 9004 not in by


def test_empty(docs):
    assert not query(docs.where("false"))
    assert alignment.groups(docs.where("false"), A, B).count() == 0


def test_query(spark):
    rows = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()
    got = queries.op11_alignment(spark, DIR)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted((r.doc_id, *x) for r, x in zip(rows, brute([r.text for r in rows]), strict=True))
