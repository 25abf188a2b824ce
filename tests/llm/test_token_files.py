import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from plain_versions import token_rows

from llm import token_files as T
from llm.common import shared_folder

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("n", [0, 1, 5, 63, 64, 1000, 70_000, 300_000])
def test_round_trip_and_every_checkpoint(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % 40_000).astype(np.uint32)
    code = T.Code(T.frequencies(np.bincount(ids, minlength=1 << 16)))
    lanes, points, words = code.encode(ids)
    words = words.astype(np.uint64)
    assert (code.decode(n, lanes, points, words) == ids).all()
    for first in range(len(points)):
        assert (code.decode(n, lanes, points, words, first) == ids[points[first][0] * lanes :]).all()
        stop = points[first + 1][0] * lanes if first + 1 < len(points) else n
        assert (code.decode(n, lanes, points, words, first, first + 1) == ids[points[first][0] * lanes : stop]).all()


def test_frequencies_fill_the_table():
    for counts in ([1], [1] * 50_000, [10**12, 1, 0, 1], [0, 0, 5]):
        freq = T.frequencies(np.array(counts))
        assert freq.sum() == 1 << T.SCALE and ((freq > 0) == (np.array(counts) > 0)).all()
    assert T.frequencies(np.zeros(4, int)).sum() == 0


def test_a_damaged_block_is_noticed():
    ids = np.arange(500, dtype=np.uint32) % 7
    code = T.Code(T.frequencies(np.bincount(ids, minlength=1 << 16)))
    block = bytearray(T.write_block(code, [(5, ids), (None, ids[:3]), (7, ids[:0])]))
    got = T.read_block(code, bytes(block))
    assert [(d, x.tolist()) for d, x in got] == [(5, ids.tolist()), (None, [0, 1, 2]), (7, [])]
    block[-1] ^= 1
    with pytest.raises(ValueError):
        T.read_block(code, bytes(block))


def rows_of(spark, df, name):
    folder = f"{shared_folder(spark)}/{name}"
    T.write_ids(df, folder, PATH, 2)
    return T.read_ids(spark, folder, zlib.crc32).collect()


def want(rows):
    return token_rows(rows, PATH)


def test_files_read_back(spark, docs):
    rows = [(5, "Hello, it's 12 o'clock"), (-3, None), (9, ""), (2, "ΑΣ ςΣ x y\x1cz İstanbul"), (7, "é ́ a\nb\tc"), (1, "word " * 40_000), (4, "x" * 5000), (8, "<|endoftext|> </w>")]
    got = rows_of(spark, docs(rows), "files-a")
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want(rows)


def test_repeated_rows_and_null_ids(spark, docs):
    rows = [(1, "a b"), (1, "a b"), (None, "c"), (2, "d")]
    got = rows_of(spark, docs(rows), "files-b")
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want(rows)


def test_no_rows(spark, docs):
    assert rows_of(spark, docs([]), "files-c") == []


def test_words_of_either_case_are_encoded_once_and_odd_ones_as_they_read():
    from tokenizers import Tokenizer

    from llm.common import buffers

    texts = ["Word WORD word Ünlü ÜNLÜ", "<|ENDOFTEXT|> <|endoftext|>", "H̱ALLO ẖallo T̈ ẖ", "IT'S it's I'LL", "İSTANBUL ı ſ K", "a\x01B \x01 x", "", "A" * 500 + " b"]
    plain, encoder = Tokenizer.from_file(PATH), T.Encoder(PATH, 2)
    for t in [*texts, "\n".join(texts)]:
        data, at = buffers(pa.array([t]))
        ids, n = encoder(data, at)
        assert ids.tolist() == plain.encode(t, add_special_tokens=False).ids + [2] and n.tolist() == [len(ids)]
    encoder.known[0] = T.Known()
    encoder(*buffers(pa.array([texts[0]])))
    assert len(encoder.known[0].hashes) == 3  # word, and both cases of a letter beyond ASCII


def test_of_rows_of_one_id_the_longest_comes_first(spark):
    words = "one two three four five six seven eight".split()
    for cut in range(1, 8):
        rows = [(5, " ".join(words[:cut])), (5, " ".join(words)), (5, " ".join(words))]
        place = T.written(spark.createDataFrame(rows, "doc_id long, text string"), PATH, 2)
        got = sorted(T.read_ids(spark, place, zlib.crc32).collect(), key=lambda r: r.start)
        assert [tuple(r) for r in got] == token_rows([rows[1], rows[2], rows[0]], PATH)
