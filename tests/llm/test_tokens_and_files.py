import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import DATA
from pyspark.sql import functions as F

from loomwork.llm import packing, queries, spans, token_files, tokens


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_vocabulary())
    t.encode_special_tokens = True
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 2]


def packed(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def test_encoder_is_exact(plain):
    rng = random.Random(1)
    parts = ["a", "Wort", "été", "ß", " ", "  ", "\n", "\n\n", "\t", "'", "'s", "n't", ".", ",", "12", "²", "Ω", "漢", "́", " ", " ", "_", "<|endoftext|>", "\r\n", " \n", "×", "\x00", "\x1c", "\x85"]
    encoder = tokens.Encoder(tokens.default_vocabulary(), 2, kept=40)
    for _ in range(60):
        texts = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(50)] + [None, ""]
        assert encoder.encode(texts) == [np.asarray(plain(t), "<u4").tobytes() for t in texts]


def test_columns_are_encoded_exactly(plain, monkeypatch):
    """Plain texts and others in one column, also with a table so small that pieces often take each other's places."""
    monkeypatch.setattr(tokens, "_SLOTS", 4)
    monkeypatch.setattr(tokens, "_POOL", 500)
    rng = random.Random(2)
    parts = ["a", "Wort", "été", "ß", "x" * 30, " ", " b", " c", ".", ",", "12", "\n", "ɏ", "É!", "-", "<|endoftext|>"]
    odd = ["  ", "\t", "'s", "×", "÷", "ɐ", "²", "漢", "\r\n", "\x7f", "€", "\u00a0"]
    encoder = tokens.Encoder(tokens.default_vocabulary(), 2)
    simple = 0
    for _ in range(60):
        texts = ["".join(rng.choices(parts + odd * (rng.random() < 0.3), k=rng.randint(0, 25))) for _ in range(50)] + [None, "", " a", "a ", "a\nb", "a\n b", "a\n", "\na"]
        column = pa.array(["left out", *texts]).slice(1)
        assert encoder.encode_column(column) == [np.asarray(plain(t), "<u4").tobytes() for t in texts]
        simple += tokens._simple(*spans.texts(column)).sum()
    assert simple > 1000
    assert encoder.encode_column(pa.array([], pa.string())) == [] and encoder.encode_column(pa.array([None, None], pa.string())) == [b"\x02\0\0\0"] * 2


def test_spans_are_hashed_by_their_bytes_alone(monkeypatch):
    monkeypatch.setattr(spans, "_BLOCK", 64)
    rng = random.Random(3)
    words = ["".join(rng.choices("abA", k=rng.choice((1, 2, 3, 60, 64, 65, 200)))) for _ in range(400)]
    texts = [" ".join(words[i : i + 7]) + rng.choice(("", " ", "\n")) for i in range(0, 400, 7)] + ["", None]
    data, offsets = spans.texts(pa.array(texts))
    starts, ends = spans.words(data, offsets)
    found = [bytes(data[a:b]).decode() for a, b in zip(starts, ends, strict=True)]
    assert found == [w for t in texts for w in (t or "").split()]
    for table, key in ((spans.EXACT, str), (spans.LOWER, str.lower)):
        by = {}
        for w, h in zip(found, spans.hashes(data, starts, ends, table).tolist(), strict=True):
            assert by.setdefault(key(w), h) == h
        assert len(set(by.values())) == len(by)


def whole(rows):
    """Documents put together again from the pieces of packed rows with ids."""
    out = {}
    for r in sorted(rows, key=lambda r: r.piece):
        out.setdefault(r.doc_id, []).extend(r.ids)
    return out


def check_sequences(rows, size=1024):
    by = {}
    for r in rows:
        assert 0 < r.length <= size
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


def test_packing_of_all_documents(spark, plain):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = packing.pack(docs, with_ids=True).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert whole(rows) == {k: plain(v) for k, v in texts.items()}
    assert all(packed(r.ids) == r.ids_crc32 for r in rows)
    used, total = check_sequences(rows), sum(r.length for r in rows)
    assert used <= 1.05 * total / 1024 + docs.rdd.getNumPartitions()
    for doc, ids in whole(rows).items():
        pieces = sorted((r.piece, r.start, r.length) for r in rows if r.doc_id == doc)
        assert [p[0] for p in pieces] == [*range(len(pieces))]
        assert all(p[2] == 1024 for p in pieces[1:]) and (len(ids) > 1024) == (len(pieces) > 1)


def test_the_fullest_closes_when_places_run_out():
    bins = packing.OpenSequences(10, 2)
    assert [bins.place(n) for n in (6, 7)] == [(0, 0), (1, 0)]
    assert bins.place(5) == (2, 0)  # nothing fits: sequence 1, the fullest, closes
    assert bins.place(3) == (0, 6) and bins.place(5) == (2, 5) and bins.open == 1
    assert bins.place(10) == (3, 0) and bins.open == 1
    # least sufficient space wins
    bins = packing.OpenSequences(10, 8)
    for n in (4, 6, 7):
        bins.place(n) if n != 6 else bins.place(7)
    assert bins.place(3)[1] == 7


def test_odd_rows(spark, odd, empty, plain):
    rows = packing.pack(odd, with_ids=True).collect()
    check_sequences(rows)
    assert sum(r.length for r in rows) == sum(len(plain(r.text)) for r in odd.collect())
    assert sum(r.doc_id is None and r.piece == 0 for r in rows) == 2
    assert packing.pack(empty).count() == 0


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_files_give_back_the_ids(spark, odd, empty, plain, tmp_path, encoding):
    path = str(tmp_path / encoding)
    token_files.write(odd.repartition(3), path, encoding=encoding)
    rows = sorted(token_files.digests(spark, path).collect(), key=lambda r: r.start)
    want = sorted(odd.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert [r.doc_id for r in rows] == [r.doc_id for r in want]
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_crc32) for r in rows) == sorted((r.doc_id or -1, len(plain(r.text)), packed(plain(r.text))) for r in want)
    assert token_files.fetch(spark, path, [8]).first().ids == plain("one")
    assert "ids" not in token_files.read(spark, path, "doc_id", "n_tokens")._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    token_files.write(empty, str(tmp_path / f"none-{encoding}"))
    assert token_files.digests(spark, str(tmp_path / f"none-{encoding}")).count() == 0


@pytest.mark.parametrize("encoding, name", [("dictionary", "RLE_DICTIONARY"), ("delta", "DELTA_BINARY_PACKED")])
def test_files_have_the_layout_asked_for(spark, tmp_path, encoding, name):
    """The encoding of the ids, several row groups, and both page indexes for ids and metadata."""
    import glob

    import pyarrow.parquet as pq

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    token_files.write(docs.unionByName(docs).unionByName(docs), str(tmp_path / "f"), encoding=encoding, row_group_bytes=16 << 10, page_bytes=2 << 10)
    files = [pq.ParquetFile(f).metadata for f in sorted(glob.glob(str(tmp_path / "f" / "*.parquet")))]
    assert max(m.num_row_groups for m in files) > 1 and sum(m.num_rows for m in files) == 3 * docs.count()
    for m in files:
        for g in range(m.num_row_groups):
            columns = {m.row_group(g).column(i).path_in_schema.split(".")[0]: m.row_group(g).column(i) for i in range(m.num_columns)}
            assert name in columns["ids"].encodings or (encoding == "dictionary" and "PLAIN_DICTIONARY" in columns["ids"].encodings)
            assert encoding == "dictionary" or not any("DICT" in e for e in columns["ids"].encodings)
            assert all(columns[c].has_offset_index and columns[c].has_column_index for c in ("ids", "doc_id", "n_tokens"))


def test_query_covers_all_documents(spark, plain):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = {r.doc_id: r for r in queries.op8_token_files(spark, str(DATA)).collect()}
    at = 0
    for k in sorted(docs):
        ids = plain(docs[k])
        assert (rows[k].start, rows[k].n_tokens, rows[k].ids_crc32) == (at, len(ids), packed(ids))
        at += len(ids)
    assert queries.op6_packing(spark, str(DATA)).select(F.countDistinct("doc_id")).first()[0] == len(docs)
