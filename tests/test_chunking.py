"""Chunks of small texts, worked out by hand, and what holds for all texts."""

import pytest

from tessera.operators import chunking, sections

DIR = "/root/testdata/sf0.001"


def test_recursive_packs_pieces_and_overlaps():
    text = "aaaa bbbb cccc dddd"
    # pieces "aaaa", " bbbb", " cccc", " dddd"; ten characters hold two; the last piece of a chunk opens the next one
    assert list(chunking.recursive(text, 10, 5)) == [(0, "aaaa bbbb"), (5, "bbbb cccc"), (10, "cccc dddd")]
    assert list(chunking.recursive(text, 10, 0)) == [(0, "aaaa bbbb"), (10, "cccc dddd")]
    assert list(chunking.recursive("  ", 10, 0)) == [] == list(chunking.recursive("", 10, 0))


def test_recursive_prefers_coarse_separators():
    text = "one\n\ntwo three\nfour\n\n" + "x" * 12
    # the last piece, with its two line ends, is too long: cut at "\n", then by characters, of which the first is a line end
    assert list(chunking.recursive(text, 12, 0)) == [(0, "one"), (5, "two three"), (15, "four"), (21, "x" * 11), (32, "x")]


def test_recursive_of_one_long_word_is_cut_by_characters():
    assert list(chunking.recursive("abcdefghij", 4, 1)) == [(0, "abcd"), (3, "defg"), (6, "ghij")]


def blocks(spark, text):
    return [(r.kind, r.block) for r in sections.blocks(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("n").collect()]


def packed(spark, text, **kw):
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return [(r.start_index, r.end_index, r.section_path, r.chunk) for r in sections.chunks(d, **kw).orderBy("start_index").collect()]


def test_line_classes_and_blocks(spark):
    text = "# Title\nintro line\n\n| a | b |\n| 1 | 2 |\nafter\n```py\n# not a heading\n\nx\n```\n1.2 Second\nend"
    assert blocks(spark, text) == [("heading", "# Title"), ("paragraph", "intro line"), ("table", "| a | b |\n| 1 | 2 |"), ("paragraph", "after"), ("code", "```py\n# not a heading\n\nx\n```"), ("heading", "1.2 Second"), ("paragraph", "end")]
    # neighbouring headings, fenced parts side by side, a table that meets a fence, a fence that never closes
    assert blocks(spark, "# A\n## B\n```\na\n```\n~~~\nb\n~~~\n| t |\n```\nopen\n\n# in") == [("heading", "# A"), ("heading", "## B"), ("code", "```\na\n```"), ("code", "~~~\nb\n~~~"), ("table", "| t |"), ("code", "```\nopen\n\n# in")]
    assert blocks(spark, "a\r\nb\r\n\r\nc") == [("paragraph", "a\nb"), ("paragraph", "c")]
    assert blocks(spark, " \n\t\n") == [] == blocks(spark, None) == blocks(spark, "")


def test_fold():
    assert sections.fold([4, 4, 4], [False] * 3, 2, 10) == [0, 0, 1]
    assert sections.fold([4, 4, 4], [True, False, False], 2, 100) == [0, 1, 1]
    assert sections.fold([50, 1, 50], [False] * 3, 2, 10) == [0, 1, 2]
    assert sections.fold([10], [False], 2, 10) == [0] and sections.fold([], [], 2, 10) == []


def test_packing_and_headings(spark):
    got = packed(spark, "# A\nfirst\n\nsecond\n\n| t |\n\nlast\n# B\nother\n\n| u |\n\ntail", largest=40, smallest=10)
    # a table closes a chunk; what is left before a heading is a chunk; only the end of the text joins the chunk before it
    assert [(s, c) for _, _, s, c in got] == [("# A", "# A\n\nfirst\n\nsecond\n\n| t |"), ("# A", "# A\n\nlast"), ("# B", "# B\n\nother\n\n| u |\n\ntail")]
    # places: a heading and its line end, then blocks and their empty lines; the first chunk begins at the heading
    assert [a for a, *_ in got] == [0, 26, 32]
    assert packed(spark, "alone") == [(0, 5, "", "alone")]
    assert packed(spark, "# only a heading") == []
    # no chunk holds more than the limit if its blocks allow it
    assert [c for *_, c in packed(spark, "aaaa\n\nbbbb\n\ncccc", largest=10, smallest=0)] == ["aaaa\n\nbbbb", "cccc"]


def test_tail(spark):
    # a table closes its chunk, so the tail after it is a chunk by itself, which joins the table's only if short enough
    text = "body text\n\n| a |\n\nend"
    assert [c for *_, c in packed(spark, text, largest=60, smallest=4)] == ["body text\n\n| a |\n\nend"]
    assert [c for *_, c in packed(spark, text, largest=60, smallest=3)] == ["body text\n\n| a |", "end"]
    assert [c for *_, c in packed(spark, text, largest=17, smallest=4)] == ["body text\n\n| a |", "end"]
    assert [(a, b) for a, b, *_ in packed(spark, text, largest=60, smallest=4)] == [(0, 21)]
    # not over a heading, and not a table
    assert len(packed(spark, "one\n# H\nend", largest=60, smallest=40)) == 2
    assert [c for *_, c in packed(spark, "x\n\n| a |\n\n```\nz\n```", largest=60, smallest=40)] == ["x\n\n| a |", "```\nz\n```"]


def test_sentences(spark):
    got = packed(spark, "第一句内容很长。第二句内容很长。第三句内容很长。", largest=20, smallest=0)
    assert got == [(0, 17, "", "第一句内容很长。\n第二句内容很长。"), (18, 26, "", "第三句内容很长。")]
    assert [len(c) for *_, c in packed(spark, "y" * 50, largest=20)] == [20, 20, 10]
    # pieces of a long sentence stand alone, also after and before others
    assert [c for *_, c in packed(spark, "ab!" + "z" * 25 + "!cd!ef!", largest=20, smallest=0)] == ["ab!", "z" * 20, "z" * 5 + "!", "cd!\nef!"]


def test_rows_of_one_id_are_cut_apart(spark):
    d = spark.createDataFrame([(1, "# A\none"), (1, "# A\none"), (None, "two"), (2, None)], "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.chunk) for r in sections.chunks(d).collect()))
    assert got == [(0, "two"), (1, "# A\n\none"), (1, "# A\n\none")]


@pytest.mark.parametrize("strategy", ["F", "R"])
def test_chunks_are_in_their_documents(spark, strategy):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").unionByName(spark.createDataFrame([(-1, None), (-2, " \n ")], "doc_id long, text string"), allowMissingColumns=True)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = chunking.split(docs, strategy).collect()
    assert {r.doc_id for r in got} == {i for i, t in texts.items() if t.strip()}
    for r in got:
        assert texts[r.doc_id][r.start_index : r.end_index] == r.chunk and 0 < len(r.chunk) <= 800
    covered = {}
    for r in got:
        covered.setdefault(r.doc_id, set()).update(range(r.start_index, r.end_index))
    assert all(t[k].isspace() for i, t in texts.items() for k in set(range(len(t))) - covered.get(i, set()))


def test_unknown_strategies(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    with pytest.raises(NotImplementedError):
        chunking.split(docs, "v")
    with pytest.raises(ValueError):
        chunking.split(docs, "Z")
