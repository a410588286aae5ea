import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from panelmc.llm import packing
from panelmc.llm.queries import op5_packing, tokenizer_path


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_ids_are_those_of_the_library(library):
    rng = random.Random(3)
    bits = ["a", "B", "é", " ", "  ", "\n", "\t", "'", "'s", "'re", "'ll", "1", "٣", "!", "$", "\0", "<|endoftext|>", "中", "\U0001f600", "'d", "'T", "\r\n", "_", "-", "　"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    for text, ids in zip(texts, packing.Tokens(tokenizer_path())(texts), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_differencing_deals_every_item_once_and_evenly():
    rng = random.Random(1)
    sizes = [rng.randint(1, 256) for _ in range(400)]
    parts = packing.differencing(sizes, 20)
    assert sorted(i for p in parts for i in p) == list(range(400))
    sums = [sum(sizes[i] for i in p) for p in parts]
    assert max(sums) - min(sums) <= 3
    assert packing.dealt([7, 7, 7], 10) == [[0], [1], [2]]  # two parts would be too full, so the count rises


def test_round_trip(spark, docs, library):
    rows = [(i, " ".join(f"word{(i * 7 + k) % 50}" for k in range(i * 9))) for i in range(60)] + [(60, None), (61, ""), (62, "x" * 30_000), (62, "same id")]
    pieces = packing.pack(docs(rows).withColumnRenamed("lang", "start"), tokenizer_path()).collect()
    windows, of = defaultdict(list), defaultdict(list)
    for p in pieces:
        windows[p.sequence_id].append((p.offset, p.length))
        of[p.doc_id, p.doc_tokens].append((p.start, np.frombuffer(p.ids, "<u4").tolist()))
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
    want = sorted((i, library.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in rows)
    assert sorted((k[0], sum((ids for _, ids in sorted(v)), [])) for k, v in of.items()) == want
    assert packing.pack(docs([]), tokenizer_path()).count() == 0


def test_query_digests(spark, tmp_path, library):
    spark.createDataFrame([(1, "hello there"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    ids = np.array(library.encode("hello there", add_special_tokens=False).ids + [1], "<u4")
    for r in op5_packing(spark, str(tmp_path)).collect():
        want = ids[r.start : r.start + r.length] if r.doc_id == 1 else np.array([1], "<u4")
        assert (r.length, r.ids_crc32, r.doc_tokens) == (len(want), zlib.crc32(want.tobytes()), 3 if r.doc_id == 1 else 1)
