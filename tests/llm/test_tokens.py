import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import pretokens, sentencepieces, token_counts, token_files
from millrace.llm.queries import vocabulary

BYTES, PIECES = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
TEXT = st.text(alphabet=st.one_of(st.sampled_from(list("ab'stre vl  \n\t19.!é門' \u3000▁")), st.characters(exclude_categories=["Cs"])), max_size=60)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, max_size=8))
def test_ids_equal_the_library(texts):
    ids, sizes = pretokens.encode_texts(BYTES, texts)
    library = pretokens.library(BYTES)[0]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, max_size=8))
def test_pieces_equal_the_library(texts):
    codec = sentencepieces.codec(PIECES)
    ids, sizes = codec.encode(texts)
    want = [codec.library.encode(t) for t in texts]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert codec.decode(ids, sizes) == [t.replace("▁", " ") for t in texts]


@settings(max_examples=60, deadline=None)
@given(TEXT)
def test_counts_of_all_prefixes(text):
    library = pretokens.library(BYTES)[0]
    (counts,) = token_counts.prefix_counts([text], BYTES)
    want = [len(library.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
    assert counts.tolist() == want
    budget = len(text) // 3
    assert token_counts.fits(counts, budget) == max(k for k, n in enumerate(want) if n <= budget)


@given(st.lists(st.integers(0, 2**32 - 1), max_size=50))
def test_byte_code(values):
    v = np.array(values, np.uint32)
    assert (token_files.unpack(*token_files.pack(v), len(v)) == v).all()


def test_counts(docs, texts, empty):
    library = pretokens.library(BYTES)[0]
    got = {r.doc_id: r for r in token_counts.token_counts(docs, BYTES, limit=9).collect()}
    for k, t in enumerate(texts):
        r, n = got[k if k != 3 else None], len(library.encode(t or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((t or "").encode()), n, n > 9)
        assert len(library.encode((t or "").encode()[: r.fit_bytes].decode(), add_special_tokens=False).ids) <= 9
    assert token_counts.token_counts(empty, BYTES).count() == 0


def test_files(spark, docs, texts, empty):
    manifest, id_of = token_files.write_tokens(docs, BYTES, end_id=0)
    got = token_files.read_tokens(spark, manifest, id_of, with_ids=True).orderBy("start").collect()
    library = pretokens.library(BYTES)[0]
    order = [3, *(k for k in range(len(texts)) if k != 3)]  # null first
    start = 0
    for r, k in zip(got, order, strict=True):
        ids = [*library.encode(texts[k] or "", add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, r.ids) == (k if k != 3 else None, start, len(ids), crc(ids), ids)
        start += len(ids)
    manifest, id_of = token_files.write_tokens(empty, BYTES)
    assert token_files.read_tokens(spark, manifest, id_of).count() == 0


def test_files_of_one_id(spark):
    """An id, and no id, that many rows share: dealt over files, in ascending order all the same."""
    rows = [(7 if k % 3 else None, f"text {k}") for k in range(300)] + [(k, "x") for k in range(5)] + [(9, "y")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    manifest, id_of = token_files.write_tokens(df, BYTES, end_id=0)
    files = manifest.collect()
    assert sum(f.least == f.most == 7 or f.most == token_files.NULL_ID for f in files) >= 1 and len(files) > 1
    got = token_files.read_tokens(spark, manifest, id_of).orderBy("start").collect()
    keys = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert keys == sorted(-1 if i is None else i for i, _ in rows)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]


def test_sentencepieces(docs, texts, empty):
    codec = sentencepieces.codec(PIECES)
    encoded = sentencepieces.encode(docs, PIECES)
    assert set(encoded.columns) == set(docs.columns)  # a column of the same name is replaced
    got = {r.doc_id: r.ids for r in encoded.collect()}
    assert all(got[k if k != 3 else None] == codec.library.encode(t or "") for k, t in enumerate(texts))
    back = {r.doc_id: r.text for r in sentencepieces.decode(encoded.drop("text"), PIECES).collect()}
    assert all(back[k if k != 3 else None] == (t or "") for k, t in enumerate(texts))
    assert all(r.same for r in sentencepieces.round_trip(docs, PIECES).collect())
    assert sentencepieces.encode(empty, PIECES).count() == sentencepieces.round_trip(empty, PIECES).count() == 0


def test_long_texts_in_parts(monkeypatch):
    """Texts that are cut give what they give as a whole."""
    words = ["naïve", "it's", "12.5%", "中文字", "a", "  two", "x\n", "end.", "don't", "Ünder_score"]
    text = " ".join(words[(k * 7 + k // 5) % 10] for k in range(3000))
    texts = ["", text, "short one", text[:700], "nocutinhere" * 100]
    from millrace.llm import common

    whole = pretokens.encode_texts(BYTES, texts), sentencepieces.codec(PIECES).encode(texts), token_counts._measured(BYTES, texts, 500)
    for module in (pretokens, token_counts):
        monkeypatch.setattr(module, "parts_of", lambda t, e, skip=0: common.parts_of(t, e, 300, skip))
    cut = pretokens.encode_texts(BYTES, texts), sentencepieces.codec(PIECES).encode(texts), token_counts._measured(BYTES, texts, 500)
    for a, b in zip(whole, cut, strict=True):
        assert all((x == y).all() for x, y in zip(a, b, strict=True))
    library = pretokens.library(BYTES)[0]
    assert whole[0][1].tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_other_models_are_refused(monkeypatch):
    import sentencepiece

    class Unigram(sentencepiece.SentencePieceProcessor):
        def get_score(self, i):
            return -2.5

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Unigram)
    with pytest.raises(ValueError, match="BPE"):
        sentencepieces.SentencePieces(PIECES)


def test_queries_by_the_libraries(spark, data):
    """The registered queries over their whole table, each row against the public library."""
    from millrace.llm.queries import queries

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    library, codec = pretokens.library(BYTES)[0], sentencepieces.codec(PIECES).library
    ids = {d: library.encode(t, add_special_tokens=False).ids for d, t in texts.items()}
    pieces = {d: codec.encode(t) for d, t in texts.items()}
    found = {name: {r.doc_id: r for r in queries()[name](spark, data).collect()} for name in ("op2_sentencepiece", "op6_token_files", "op7_token_counts")}
    start = 0
    for d in sorted(texts):
        two, six, seven = (found[name][d] for name in found)
        assert (two.n_tokens, two.ids_crc32, two.same) == (len(pieces[d]), crc(pieces[d]), True) and two.text_crc32 == zlib.crc32(texts[d].encode())
        assert (six.start, six.n_tokens, six.ids_crc32) == (start, len(ids[d]) + 1, crc([*ids[d], 0]))
        assert (seven.n_bytes, seven.n_tokens, seven.over_limit) == (len(texts[d].encode()), len(ids[d]), len(ids[d]) > 512)
        start += six.n_tokens
    assert all(len(rows) == len(texts) for rows in found.values())
