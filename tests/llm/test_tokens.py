from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from alertloom.llm import packing, records, wordbpe
from alertloom.llm.checksums import crc32c
from alertloom.storage import scratch_path

from edge_rows import EDGE

PATH = wordbpe.default_path()


def ids_of(texts):
    encoder = wordbpe.encoder(PATH).tokenizer
    return [np.array([*e.ids, 1], "<u4") for e in encoder.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_pieces_give_the_ids_of_the_library():
    random.seed(1)
    alphabet = "ab sStT'rReEvVlLmMdD'' 019²½ÉéßÿµªÀ×÷ñ!.,?\n\t-_<|>“”日本 ́İΣς \u0085­\x00\x0b"
    texts = ["".join(random.choices(alphabet[: random.choice([20, 36, 46, len(alphabet)])], k=random.randint(0, 30))) for _ in range(3000)]
    texts += ["<|endoftext|> hi", "a<|startoftext|>b", "", None, "x" * 5000, "word " * 200_000]
    ids, bounds = wordbpe.encode_with_end(pa.array(texts), PATH)
    for text, want, a, b in zip(texts, ids_of(texts), bounds[:-1], bounds[1:], strict=True):
        assert ids[a:b].tolist() == want.tolist(), text


def test_forgetting_pieces_changes_nothing(monkeypatch):
    monkeypatch.setattr(wordbpe, "MEMORY", 50)
    encoder = wordbpe.PieceEncoder(PATH)
    texts = [f"alpha{i} beta{i * 7} gamma" for i in range(400)]
    for _ in range(2):
        ids, counts = encoder.encode(pa.array(texts))
        assert ids.tolist() == [x for e in ids_of(texts) for x in e[:-1].tolist()]
        assert counts.sum() == len(ids)


def test_crc32c_known_values():
    words = np.concatenate([np.zeros(8, "<u4"), np.full(8, 0xFFFFFFFF, "<u4")])
    assert [hex(x) for x in crc32c(words, np.array([0, 8, 16, 16]))] == ["0x8a9136aa", "0x62a8ab43", "0x0"]


@pytest.mark.parametrize("wide", [True, False])
def test_records_round_trip_and_damage(wide):
    sizes = [0, 1, 2, 5, 900]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    ids = np.arange(bounds[-1], dtype=np.uint32) * 7 % 60_000
    words, at = records.frame_records(ids, bounds, np.array([-5, 0, 1 << 40, 7, 8]), np.array([1, 1, 1, 0, 1]), wide)
    doc_ids, back, edges = records.parse_records(words, at)
    assert doc_ids == [-5, 0, 1 << 40, None, 8] and back.tolist() == ids.tolist() and edges.tolist() == bounds.tolist()
    words[at[3] + 8] ^= 1
    with pytest.raises(ValueError, match="1 records"):
        records.parse_records(words, at)


def test_record_files_on_edge_rows(spark, edge, empty):
    got = sorted(records.token_records(edge, PATH).collect(), key=lambda r: r.start)
    ordered = sorted(EDGE, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    ids = ids_of([r[1] for r in ordered])
    assert [r.doc_id for r in got] == [r[0] for r in ordered]
    assert [r.n_tokens for r in got] == [len(i) for i in ids]
    assert [r.start for r in got] == (np.cumsum([len(i) for i in ids]) - [len(i) for i in ids]).tolist()
    assert [r.ids_crc32 for r in got] == [zlib.crc32(i.tobytes()) for i in ids]
    assert records.token_records(empty, PATH).count() == 0


def test_index_reads_any_record(spark, documents):
    docs = spark.createDataFrame(documents[["doc_id", "text"]])
    manifest = records.write_records(docs, scratch_path(spark, "records"), PATH)
    few = records.read_records(spark, manifest, records_per_read=7).toPandas().sort_values("doc_id")
    ids = ids_of(documents.sort_values("doc_id").text)
    assert few.n_tokens.tolist() == [len(i) for i in ids]
    assert few.ids_crc32.tolist() == [zlib.crc32(i.tobytes()) for i in ids]


def check_packing(pieces, texts, limits):
    """texts: id -> ids; every id lies in one piece, sequences are gapless and within the limits."""
    seen = {}
    for doc_id, part in pieces.groupby("doc_id", dropna=False):
        part = part.sort_values("start")
        assert (part.start + part.length).tolist()[:-1] == part.start.tolist()[1:]
        ids = texts[doc_id]
        assert part.length.sum() == len(ids) == part.doc_tokens.iloc[0]
        assert part.ids_crc32.tolist() == [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(part.start, part.length, strict=True)]
        seen[doc_id] = True
    assert len(seen) == len(texts)
    for _, part in pieces.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert part.offset.tolist() == (part.length.cumsum() - part.length).tolist()
        total = part.length.sum()
        assert total <= limits.tokens and len(part) <= limits.segments and part.loss_tokens.sum() <= limits.loss_tokens
        assert total == limits.tokens or total & (total - 1) == 0


@pytest.mark.parametrize("limits", [packing.Limits(), packing.Limits(512, 3, 511), packing.Limits(256, 16, 100), packing.Limits(1, 1, 1)])
def test_packing_is_complete_and_within_limits(spark, documents, limits):
    some = documents.drop_duplicates("doc_id").head(120)
    docs = spark.createDataFrame(some[["doc_id", "text"]])
    pieces = packing.pack_texts(docs, PATH, limits).toPandas()
    check_packing(pieces, dict(zip(some.doc_id, ids_of(some.text), strict=True)), limits)


def test_packing_with_prompts(spark):
    rows = [(i, "some words to be packed " * (1 + i % 9), i % 30) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, prompt int")
    limits = packing.Limits(128, 8, 60)
    pieces = packing.pack_texts(docs, PATH, limits, prompt_col="prompt").toPandas()
    check_packing(pieces, dict(zip([r[0] for r in rows], ids_of([r[1] for r in rows]), strict=True)), limits)
    end, start = pieces.start + pieces.length, pieces.start + 1
    prompt = pieces.doc_id % 30
    assert pieces.loss_tokens.tolist() == [max(0, e - max(s, p)) for e, s, p in zip(end, start, prompt, strict=True)]


def test_packing_on_edge_rows(edge, empty):
    pieces = packing.pack_texts(edge, PATH).toPandas()
    assert pieces.length.sum() == sum(len(i) for i in ids_of([r[1] for r in EDGE]))
    assert pieces.length[pieces.doc_id.isna()].sum() == sum(len(ids_of([r[1]])[0]) for r in EDGE if r[0] is None)
    assert packing.pack_texts(empty, PATH).count() == 0
