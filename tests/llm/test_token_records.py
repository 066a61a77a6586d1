import random
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from spanledger.llm.crc32c import crc32c, masked
from spanledger.llm.queries import QUERIES
from spanledger.llm.token_records import Encoder, read_records, record_digests, write_records
from spanledger.operators.support import Shelf

SF = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("word_bpe_49k.json")
TRICKY = ["", " ", "  a  b ", "It's don't I'll WE'VE x'sy", "naïve éa é ΣΑΣ Σ", "a.b,c!?", "<|endoftext|> x<|startoftext|>y",
          "3rd 12 a1b2", "line\none\ttab nbsp em", "日本語 テスト", "İstanbul ﬁ ǅ", "word." * 50, "%%% *** a*** b$$$", "'s 't s'", "x" * 5000, "🙂🙂 ok", "<|ENDOFTEXT|> <|x", "W\u030a A\u0301 I\u0307", "ÉTÉ!! Œuf,", "abc..., ,.;", "it's.", "a#'s b"]


def plain(docs):
    """doc_id, start, n, crc by whole-text encoding."""
    t, start = Tokenizer.from_file(PATH), 0
    for d, text in docs:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        yield d, start, len(ids), zlib.crc32(ids.tobytes())
        start += len(ids)


def test_checksum_vectors():
    data = np.frombuffer(b"123456789" + bytes(32) + b"ab" + bytes(range(32)) * 9, np.uint8)
    got = crc32c(data, np.array([0, 9, 41, 43, 43, len(data)]))
    assert got[0] == 0xE3069283 and got[1] == 0x8A9136AA and got[3] == 0
    one = np.array([0x12345678], np.uint32)
    assert int(masked(one)[0]) == ((((0x12345678 >> 15) | (0x12345678 << 17)) & 0xFFFFFFFF) + 0xA282EAD8) & 0xFFFFFFFF


def same_as_whole(texts):
    own, t = Encoder(PATH, 1), Tokenizer.from_file(PATH)
    assert own.by_piece
    ids, at = own.texts(pa.array(texts))
    want = t.encode_batch([x or "" for x in texts], add_special_tokens=False)
    for text, w, a, b in zip(texts, want, at, at[1:]):
        assert ids[a:b].tolist() == [*w.ids, 1], text


def test_pieces_equal_whole_texts():
    same_as_whole(TRICKY)
    same_as_whole([None, *TRICKY[::-1], None])
    same_as_whole(["<|endoftext|>"])
    same_as_whole(["GENEL DERSİ, VE SERVİSİ.", "पढ़. ज़, ড়! ਸ਼: क़ख़.", "ß. ẞ, ŉ! ǰ? ΐ; ΰ: եւ. ẖ, ẗ ẘ! ẚ."])


def test_empty_column():
    ids, at = Encoder(PATH, 1).texts(pa.array([], pa.string()))
    assert len(ids) == 0 and at.tolist() == [0]


def test_every_letter_before_a_sign():
    """All code points, alone and in a word, before a sign."""
    points = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    for form in ("{}.", "be{}, {}k{}!"):
        some = [form.replace("{}", c) for c in points if form == "{}." or c.isalpha() or unicodedata.combining(c)]
        for i in range(0, len(some), 100_000):
            same_as_whole(some[i:i + 100_000])


def test_random_strings():
    rnd = random.Random(7)
    letters = "aZ.,!?%| \n\t'sStTdD0|<>é́İßΣςЖкअक़़ǅﬁ日\u00a0\u0338=-_\u1e9e\u200d🙂\u0b5c\u0307"
    same_as_whole(["".join(rnd.choices(letters, k=rnd.randint(0, 24))) for _ in range(50_000)])


def test_whole_table(spark):
    docs = sorted((d["doc_id"], d["text"]) for d in pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist())
    got = sorted(map(tuple, QUERIES["op2_token_records"](spark, SF).collect()))
    assert got == list(plain(docs))


def test_odd_rows(spark):
    docs = [(1, None, 0), (2, "", 0), *[(i + 3, t, 0) for i, t in enumerate(TRICKY)], (90, "same", 0), (90, "same", 0), (None, "no key", 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, start int")
    want = list(plain([(d, t) for d, t, _ in sorted(docs, key=lambda d: d[0] if d[0] is not None else -1)]))
    key = lambda r: (r[1], r[2])
    assert sorted(map(tuple, record_digests(df, PATH).collect()), key=key) == sorted(want, key=key)
    assert record_digests(df.limit(0), PATH).collect() == []


def test_shuffled_reads_and_damage(spark):
    shelf = Shelf(spark)
    df = spark.createDataFrame([(i, f"text {i} " * (i + 1)) for i in range(50)], "doc_id long, text string")
    folder = f"{shelf.root}/records"
    index = write_records(df, ["doc_id"], folder, PATH, 1, shelf)
    sizes = lambda b, ids: pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in ids], pa.int64())], ["doc_id", "n"])
    rows = read_records(index.orderBy("bytes", "doc_id"), folder, "<u2", "doc_id long, n long", sizes).collect()
    assert {r.doc_id: r.n for r in rows} == {r[0]: r[2] for r in plain([(i, f"text {i} " * (i + 1)) for i in range(50)])}
    local = folder.removeprefix("file://")
    name = index.first()["file"]
    raw = bytearray(open(f"{local}/{name}", "rb").read())
    raw[14] ^= 1
    open(f"{local}/{name}", "wb").write(raw)
    with pytest.raises(Exception, match="damaged"):
        read_records(index, folder, "<u2", "doc_id long, n long", sizes).collect()
