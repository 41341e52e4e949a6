import base64
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow.fs as pafs
import pytest
import tiktoken
from tokenizers import Tokenizer

from iotrail.llm import bpe, token_files
from iotrail.llm.common import fresh_folder, tokenizer_file

ALPHABET = "ab c\t\n\r  \x1c\x85\xa0 　​é中12٣'sreLL<|endoftext|>!?..\U0001f600́\x00"


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(tokenizer_file(bpe.VOCABULARY))


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_encoder_equals_the_library(ranks, reference):
    texts = [*random_texts(4000, 1), "ab" * 5000, "x" * 3000, "Hello   world\n\n  it's"]
    got = bpe.Encoder.of_ranks(ranks, P.PATTERN, units=40_000, pieces=60_000).encode(texts)
    assert [np.frombuffer(x, np.int32).tolist() for x in got] == [reference.encode_ordinary(x) for x in texts]


def test_memos_are_bounded_by_bytes_and_drop_long_keys():
    memo = bpe.Memo(lambda keys: [k.encode() for k in keys], 100_000)
    rng = random.Random(5)
    for _ in range(200):
        keys = {str(rng.randrange(5000)) for _ in range(100)} | {"x" * rng.choice([1, 5000])}
        got = memo.get(keys)
        assert all(got[k] == k.encode() for k in keys)
        for generation in (memo.young, memo.old):
            assert sum(200 + len(k) + len(v) for k, v in generation.items() if len(k) <= 1000) <= 100_000
    memo.get({"y"})
    assert not any(len(k) > 1000 for k in memo.young)


def test_long_piece_tree_equals_column_trees(ranks):
    rng = random.Random(2)
    pieces = ["".join(rng.choice("aeinrst") for _ in range(rng.randint(1, 64))).encode() for _ in range(500)]
    own = bpe.Trees(ranks)
    longest = max(map(len, ranks))
    assert [np.frombuffer(x, np.int32).tolist() for x in own.merge(pieces)] == [bpe.merge_piece(p, ranks, longest) for p in pieces]


def test_round_trip(docs, clash, nothing, reference):
    rows = bpe.decode(bpe.encode(clash)).collect()
    assert len(rows) == docs.count()
    want = sorted((repr(r.doc_id), r.text or "") for r in docs.collect())
    assert sorted((repr(r.doc_id), bytes(r.decoded).decode()) for r in rows) == want
    assert sorted(map(list, (r.ids for r in rows))) == sorted(reference.encode_ordinary(t) for _, t in want)
    assert bpe.encode(nothing).count() == 0


def test_unit_encoder_equals_the_library_on_whole_texts():
    tokenizer = Tokenizer.from_file(tokenizer_file(token_files.VOCABULARY))
    rng = random.Random(4)
    special = ["".join(rng.choice(["<|endoftext|>", "a", " ", "  ", "\n", " b", "<|", "|>", "x."]) for _ in range(12)) for _ in range(1000)]
    texts = [*random_texts(3000, 3), *special, "a <|endoftext|> b", "word " * 3000]
    got = token_files.encoder(tokenizer_file(token_files.VOCABULARY)).encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_files_hold_all_documents_in_order(spark, docs, clash, nothing):
    folder = fresh_folder(spark, "tokens")
    token_files.write(clash, folder)
    rows = sorted(token_files.read(spark, folder).collect(), key=lambda r: r.start)
    tokenizer = Tokenizer.from_file(tokenizer_file(token_files.VOCABULARY))
    want = sorted((r.doc_id is not None, r.doc_id or 0, [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]) for r in docs.collect())
    assert [(r.doc_id is not None, r.doc_id or 0, np.frombuffer(r.ids, "<u4").tolist()) for r in rows] == want
    start = 0
    for r in rows:
        assert r.start == start
        start += r.n_tokens
    wanted = spark.createDataFrame([(12,), (4,), (99,)], "doc_id long")
    some = token_files.read(spark, folder, wanted).collect()
    assert sorted((r.doc_id, r.start, r.ids) for r in some) == sorted((r.doc_id, r.start, r.ids) for r in rows if r.doc_id in (4, 12))
    empty = fresh_folder(spark, "tokens")
    token_files.write(nothing, empty)
    assert token_files.read(spark, empty).count() == 0


def test_reader_opens_only_wanted_frames_and_checks_them(tmp_path):
    path = str(tmp_path / "x")
    with open(path, "wb") as out:
        writer = token_files.FrameWriter(out, frame_ids=10)
        for i in range(20):
            writer.add(i, np.arange(i, 2 * i, dtype="<u4").tobytes())
        writer.close()
    fs = pafs.LocalFileSystem()
    with fs.open_input_file(path) as source:
        reader = token_files.FrameReader(source)
        opened = []
        plain = reader.frame
        reader.frame = lambda k: opened.append(k) or plain(k)
        assert [(p, np.frombuffer(x, "<u4").tolist()) for p, x in reader.documents({3, 17})] == [(3, [3, 4, 5]), (17, list(range(17, 34)))]
        assert len(opened) == 2
    data = bytearray(open(path, "rb").read())
    data[6] ^= 0xFF
    open(path, "wb").write(bytes(data))
    with fs.open_input_file(path) as source, pytest.raises(Exception):
        list(token_files.FrameReader(source).documents())


def test_rank_file_is_read_whole(ranks):
    with open(tokenizer_file(bpe.VOCABULARY), "rb") as file:
        lines = file.read().splitlines()
    assert len(ranks) == len(lines) and base64.b64decode(lines[-1].split()[0]) in ranks and zlib.crc32(b"") == 0


def test_registered_queries_give_the_contract_columns(spark, reference):
    """Every column of op1 and op2 against the libraries on the whole small table."""
    import hashlib

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in bpe.op1_bpe(spark, sf).collect()}
    assert got.keys() == texts.keys()
    for k, text in texts.items():
        ids = reference.encode_ordinary(text)
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        assert (got[k].n_tokens, got[k].ids_sha256, got[k].decoded_sha256) == want
    tokenizer, start = Tokenizer.from_file(tokenizer_file(token_files.VOCABULARY)), 0
    read = {r.doc_id: r for r in token_files.op2_token_files(spark, sf).collect()}
    for k in sorted(texts):
        ids = [*tokenizer.encode(texts[k], add_special_tokens=False).ids, 0]
        assert (read[k].start, read[k].n_tokens, read[k].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
