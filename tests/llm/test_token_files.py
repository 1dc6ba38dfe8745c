"""Token files: ids against the tokenizers library text by text, and the exact round trip."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lateline.llm import queries, token_files

DEFINITION = token_files.load_tokenizer(f"{queries.TOKENIZERS}/byte_bpe_50k.json")
WORDS = token_files.load_tokenizer(f"{queries.TOKENIZERS}/word_bpe_49k.json")
SF_DIR = "/root/testdata/sf0.001"


def plain(definition=DEFINITION):
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(definition)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def odd_texts():
    rng = random.Random(4)
    signs = "ab1 É🙂'st.,\n\t\r\x0b\x1c\x85\xa0　  #!?×"
    return ["", " ", "  a", "a  b", "a b", " a b ", "it's we'll", "x" * 500 + " y", "<|endoftext|> a <|endoftext|>",
            "é" * 300 + " z", "# 2 #", "one.\nTwo\n\nthree,\n four\n", "A.b,c;d:e!f?g", "it's.'s,'ll", "a\n.b", "x .y"] + ["".join(rng.choices(signs, k=rng.choice([1, 3, 9, 60]))) for _ in range(600)]


@pytest.mark.parametrize("definition", [DEFINITION, WORDS])
def test_encoder(definition):
    encoder, one = token_files.Encoder(definition), plain(definition)
    texts = odd_texts()
    for _ in range(2):
        assert [e.tolist() for e in encoder.encode(texts)] == [one(t) for t in texts]


def test_encoder_forgets_and_takes_long_texts_in_parts(monkeypatch):
    monkeypatch.setattr(token_files, "KEPT_PIECES", 50)
    monkeypatch.setattr(token_files, "GROUP", 40)
    encoder, one, texts = token_files.Encoder(DEFINITION), plain(), odd_texts()
    texts.append(" ".join(texts))
    for k in range(0, len(texts), 7):
        assert [e.tolist() for e in encoder.encode(texts[k:k + 7])] == [one(t) for t in texts[k:k + 7]]
    assert encoder.encode([]) == []


@pytest.mark.parametrize("rows", [1, 3])
def test_shard(tmp_path, rows):
    rng = np.random.default_rng(rows)
    docs = [rng.integers(0, 60_000, n).astype(np.uint16) for n in [0, 5, 7, 8, 0, 23, 100, 1, 0, 31]]
    writer = token_files.Writer(str(tmp_path), np.uint16, pa.int64(), length=8, rows=rows)
    for at in range(0, len(docs), 4):
        part = docs[at:at + 4]
        writer.add(pa.array(range(at, at + len(part)), pa.int64()), part, 2)
    name, n_docs, n_tokens = writer.close()
    flat = [x for d in docs for x in [*d.tolist(), 2]]
    assert (n_docs, n_tokens) == (len(docs), len(flat))
    shard = token_files.Shard(str(tmp_path), name)
    assert shard.n_sequences == -(-len(flat) // 8)
    ends = np.cumsum([len(d) + 1 for d in docs])
    for i in range(shard.n_sequences):
        ids, mask, last = shard.sequence(i)
        n = min(8, len(flat) - 8 * i)
        assert ids.tolist() == flat[8 * i:8 * i + n] + [0] * (8 - n)
        assert np.unpackbits(mask, bitorder="little").tolist() == [1] * n + [0] * (8 - n)
        assert np.unpackbits(last, bitorder="little").tolist() == [int(p + 1 in ends) for p in range(8 * i, 8 * i + 8)]
        assert not ids.flags.owndata and not mask.flags.owndata
        assert shard.first_document(i) == int(np.searchsorted(ends, 8 * i, "right"))
    for k, d in enumerate(docs):
        assert shard.span(int(ends[k]) - len(d) - 1, len(d) + 1).tolist() == [*d.tolist(), 2]
    assert shard.span(0, 0).tolist() == []
    found = [ids.tolist() for _, group in shard.documents() for ids in group]
    assert found == [[*d.tolist(), 2] for d in docs]
    with pa.memory_map(f"{tmp_path}/{name}.arrow") as f:
        assert pa.types.is_fixed_size_list(pa.ipc.open_file(f).schema.field("ids").type)


def expected(rows):
    one, start, out = plain(), 0, []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*one(text), 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows],
                                 "doc_id long, text string, shard int, path string")


def found(df):
    return sorted(map(tuple, df.collect()), key=lambda r: r[1])


def test_round_trip(spark):
    rows = [(7, "a b"), (3, None), (9, ""), (5, "word " * 30_000), (None, "first"), (8, "x" * 50_000)]
    rows += [(10 + k, t) for k, t in enumerate(odd_texts())]
    random.Random(1).shuffle(rows)
    assert found(token_files.round_trip(frame(spark, rows).repartition(5), DEFINITION, 2)) == expected(rows)


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "same")] * 40 + [(2, "other"), (2, "another one"), (0, "zero")]
    got = found(token_files.round_trip(frame(spark, rows), DEFINITION, 2))
    assert got[:41] == expected([r for r in rows if r[0] < 2])
    sizes = {len(plain()(t)) + 1 for i, t in rows if i == 2}
    assert [g[0] for g in got[41:]] == [2, 2] and {g[2] for g in got[41:]} == sizes
    assert got[42][1] == got[41][1] + got[41][2]
    assert found(token_files.round_trip(frame(spark, []), DEFINITION, 2)) == []


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    assert found(queries.QUERIES["op12_token_files"](spark, SF_DIR)) == expected(rows)


def test_starts_over_many_shards(spark):
    manifest = spark.createDataFrame([(k, f"p{k}", 1, k % 7) for k in range(3_000)], token_files.MANIFEST)
    starts = {r["shard"]: r["start"] for r in token_files.shard_starts(manifest).collect()}
    total = 0
    for k in range(3_000):
        assert starts[k] == total
        total += k % 7
