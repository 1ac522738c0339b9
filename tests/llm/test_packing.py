import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from accountloom.llm import cutting_stock, packing, token_files
from accountloom.llm.tokens import default_tokenizer, encoder

LIBRARY = Tokenizer.from_file(default_tokenizer())  # as it is, not the encoder's own
ROWS = [(3, "alpha beta gamma"), (1, None), (2, ""), (2, ""), (7, "the  odd \n spaces\t here "),
        (9, "word " * 9000), (5, "héé ñ 日本 don't <|endoftext|> 12,5%"), (None, "no id"), (4, "x")]
SCHEMA = "doc_id long, text string, `start` string, sequence_id int, ids string"


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "clash", 1, "z") for r in rows], SCHEMA)


def expected(text, end):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    return np.array([*ids, end], "<u4")


def check_pieces(rows, texts, capacity):
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for doc, text in texts.items():
        whole, at = expected(text, 1), 0
        for r in sorted(by_doc[doc], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(whole)
            assert r["ids_crc32"] == zlib.crc32(whole[at:at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(whole)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    waste = total = 0
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
        total += at
        waste += 0 if at & (at - 1) == 0 else capacity - at
    return waste / max(total, 1)


@pytest.mark.parametrize("capacity", [16, 2048])
def test_pieces_cover_every_token_once(spark, capacity):
    unique = {d: t for d, t in ROWS if d != 2}
    rows = packing.pack_documents(frame(spark, list(unique.items())), capacity=capacity, with_ids=True).collect()
    assert check_pieces(rows, unique, capacity) < 0.02
    for r in rows:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]


def test_repeated_rows_and_empty_table(spark):
    rows = packing.pack_documents(frame(spark)).filter("doc_id = 2").collect()
    assert len(rows) == 2 and {r["length"] for r in rows} == {1}
    assert packing.pack_documents(frame(spark, [])).count() == 0


def test_one_length_for_a_third_of_the_rows(spark):
    rows = [(i, "a " * 700 if i % 3 == 0 else "b " * (i * 37 % 1500)) for i in range(300)]
    out = packing.pack_documents(frame(spark, rows)).collect()
    assert check_pieces(out, dict(rows), 2048) < 0.01


def test_patterns_respect_demand_and_room():
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 2048, 3000)
    sizes, demand = np.unique(cutting_stock.class_size(lengths), return_counts=True)
    assert (cutting_stock.class_size(lengths) >= lengths).all()
    plan = cutting_stock.plan_patterns(sizes, demand, 2048)
    used = np.zeros(len(sizes), int)
    for pattern, times in plan:
        assert sum(sizes[i] * n for i, n in pattern.items()) <= 2048
        for i, n in pattern.items():
            used[i] += n * times
    assert (used <= demand).all() and used.sum() > 0.8 * demand.sum()


def test_knapsack_is_exact():
    rng = np.random.default_rng(1)
    for _ in range(20):
        sizes = np.unique(rng.integers(1, 12, 4))
        prices, limit = rng.random(len(sizes)), rng.integers(0, 4, len(sizes))
        best = 0.0
        for counts in np.ndindex(*(limit + 1)):
            if np.dot(counts, sizes) <= 20:
                best = max(best, float(np.dot(counts, prices)))
        pattern, value = cutting_stock.knapsack(sizes, prices, limit, 20)
        assert value == pytest.approx(best)
        assert sum(prices[i] * n for i, n in pattern.items()) == pytest.approx(best)


def test_tail_lengths_are_powers_of_two():
    assert packing.tail_lengths(2048 * 3 + 13, 2048) == [8, 4, 1]
    assert packing.tail_lengths(4096, 2048) == []


def test_token_files_round_trip(spark, tmp_path):
    path = str(tmp_path / "ids")
    token_files.write_token_files(frame(spark), path)
    ordered = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    at = 0
    got = sorted(token_files.token_file_digest(spark, path).collect(), key=lambda r: r["start"])
    for row, (doc, text) in zip(got, ordered, strict=True):
        ids = expected(text, 2)
        assert (row["doc_id"], row["start"], row["n_tokens"]) == (doc, at, len(ids))
        assert row["ids_crc32"] == zlib.crc32(ids.tobytes())
        at += len(ids)
    one = token_files.read_token_files(spark, path).filter("doc_id = 5").collect()[0]
    assert one["ids"] == expected(ROWS[6][1], 2).tolist()


def test_token_files_have_page_indexes_and_encodings(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    path = str(tmp_path / "ids")
    rows = [(i, "many words in one text " * 20) for i in range(3000)]
    token_files.write_token_files(frame(spark, rows), path, page_rows=100)
    column = pq.ParquetFile(sorted(glob.glob(f"{path}/*.parquet"))[0]).metadata.row_group(0).column
    by_name = {column(i).path_in_schema: column(i) for i in range(6)}
    assert all(c.has_column_index and c.has_offset_index for n, c in by_name.items() if "ids" not in n)
    ids = next(c for n, c in by_name.items() if n.startswith("ids"))
    assert any("DICTIONARY" in e for e in ids.encodings)
    assert any("DELTA" in e or "DICTIONARY" in e for e in by_name["first_token"].encodings)


def test_empty_token_files(spark, tmp_path):
    path = str(tmp_path / "none")
    token_files.write_token_files(frame(spark, []), path)
    assert token_files.token_file_digest(spark, path).count() == 0


def test_encoder_equals_the_library():
    import pyarrow as pa

    texts = ["", " ", "a  b", "x \n y", "'s it''s don't", "tab\t\tx  ", "\x85 b \x1c c", "ab " * 5000, None,
             "<|endoftext|>", "<|endoftext|> a", "a <|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext| >",
             "日本 語a b", "end "]
    rng = random.Random(6)
    texts += ["".join(rng.choice(["<|endoftext|>", "<|", "|>", " ", "  ", "a", "é", "word", "\n", "12", "'s", "."])
                      for _ in range(rng.randrange(1, 12))) for _ in range(600)]
    own = encoder(default_tokenizer())
    offsets, ids = own.encode(pa.array(texts))
    for i, t in enumerate(texts):
        want = LIBRARY.encode(t or "", add_special_tokens=False).ids
        assert ids[offsets[i]:offsets[i + 1]].tolist() == want
    for low in range(20):
        part, some = own.encode(pa.array(texts).slice(low, 3))
        assert some.tolist() == ids[offsets[low]:offsets[min(low + 3, len(texts))]].tolist()
