import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from foliospark.llm.bytebpe import UnitCoder, tokenizer_spec
from foliospark.llm.token_counts import UnitCounter, count_tokens, whole_tokens
from foliospark.llm.token_files import pack, read_token_files, token_files, unpack, write_token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
SPEC = tokenizer_spec(PATH)
CODER, COUNTER = UnitCoder(SPEC, memo_size=50), UnitCounter(SPEC)


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("abT é字\n\t \xa0 \x1c'.,!1²<|endoftext|>")), max_size=40) | st.none(), max_size=6))
def test_units_give_the_librarys_ids(texts):
    assert [np.frombuffer(b, "<u4").tolist() for b in CODER.encode(texts)] == [library_ids(t) for t in texts]
    assert COUNTER.count(texts) == [len(library_ids(t)) for t in texts]


def test_whole_tokens_are_proved():
    wholes = whole_tokens(SPEC)
    assert len(wholes) > 30_000
    for s in list(wholes)[:: len(wholes) // 500]:
        assert len(library_ids(s)) == 1


def test_counts(edge_docs, edge_rows, no_docs):
    got = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(edge_docs, PATH).collect()}
    assert got == {(i, len((t or "").encode()), len(library_ids(t)), len(library_ids(t)) > 512) for i, t, *_ in edge_rows}
    assert count_tokens(edge_docs, PATH).count() == len(edge_rows)
    assert count_tokens(no_docs, PATH).count() == 0


@pytest.mark.parametrize("most", [1, 300, 70_000, 1 << 31])
def test_segments_round_trip(most):
    rng = np.random.default_rng(most)
    counts = [0, 1, 5, 1000, 0]
    ids = rng.integers(0, min(most, 200_000), sum(counts)).astype("<u4")
    back, n = unpack(pack(ids, counts))
    assert back.tolist() == ids.tolist() and n.tolist() == counts
    assert unpack(pack(ids[:0], []))[0].tolist() == []


def test_files(spark, edge_docs, edge_rows, no_docs, tmp_path):
    rows = sorted(token_files(edge_docs, PATH).collect(), key=lambda r: r.start)
    want = sorted(edge_rows, key=lambda r: r[0])
    start = 0
    for r, (i, t, *_) in zip(rows, want, strict=True):
        ids = [*library_ids(t), 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_files(no_docs, PATH).count() == 0
    write_token_files(edge_docs, str(tmp_path / "t"), PATH, segment_ids=100)
    back = {r.doc_id: r.ids for r in read_token_files(spark, str(tmp_path / "t"), with_ids=True).collect()}
    assert back == {i: [*library_ids(t), 0] for i, t, *_ in edge_rows}
