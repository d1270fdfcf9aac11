import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from gable.llm import queries, tokens


def whole(texts):
    t = Tokenizer.from_file(tokens.TOKENIZER)
    return [t.encode(x, add_special_tokens=False).ids for x in texts]


ODD = ["", " ", "Ça va ?  Ὀδυσσεύς ΣΑΣ", "a b c\x1cd\x85e", "<|endoftext|> x<|startoftext|>", "é ́x", "don't WE'LL 123 ½²", "漢字かな​х", "🙂🙂 ok!?" * 9, "İı ſ", "a\x01b \x01 c", "x?! --y–. é, 9’s. O'Re' ''"]


def test_encoder_equals_library(spark):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()] + ODD
    encoder = tokens.Encoder(Tokenizer.from_file(tokens.TOKENIZER))
    ids, sizes = encoder.encode([t.encode() for t in texts])
    found = [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
    assert found == whole(texts)


def expected(pairs):
    """Rows in ascending id, from the library on whole texts."""
    start, out = 0, []
    for (i, _), ids in zip(pairs, whole([t or "" for _, t in pairs])):
        ids = [*ids, 1]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_whole_table(spark, sf):
    rows = queries.op5_token_output(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows) == expected([(r["doc_id"], r["text"]) for r in docs])


def test_edges_and_layout(docs_of, spark, tmp_path, table_dir):
    pairs = [(None, None), *[(i, t) for i, t in enumerate(ODD)], (90, "long " * 100_000)]
    docs = docs_of(pairs).withColumnRenamed("source", "Start").withColumnRenamed("lang", "part")
    path = str(tmp_path / "out")
    tokens.write_tokens(docs, path)
    rows = tokens.crc32_of_ids(tokens.read_tokens(spark, path)).collect()
    assert {(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows} == set(expected(pairs))
    files = sorted((tmp_path / "out").glob("*.parquet"))
    order = [i for f in files for i in pq.read_table(f).column("doc_id").to_pylist()]
    assert order == [p[0] for p in pairs]  # ascending over the files in turn
    meta = pq.ParquetFile(max(files, key=lambda f: f.stat().st_size)).metadata.row_group(0)
    columns = {meta.column(i).path_in_schema: meta.column(i) for i in range(meta.num_columns)}
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings and columns["ids.list.element"].has_dictionary_page
    assert columns["doc_id"].has_offset_index and columns["doc_id"].has_column_index
    plan = tokens.read_tokens(spark, path, ["doc_id", "n_tokens"])._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan
    twice = tokens.encoded(docs_of([(5, "a b"), (5, "a b"), (5, None)])).collect()
    assert sorted((r["start"], r["n_tokens"]) for r in twice) in ([(0, 1), (1, 3), (4, 3)], [(0, 3), (3, 3), (6, 1)])
    assert queries.op5_token_output(spark, table_dir(documents=docs_of(pairs).limit(0))).count() == 0
    assert public_tokenizers.path("word_bpe_49k.json") == tokens.TOKENIZER


def test_ranges_follow_the_text_and_not_the_shuffle_partitions(docs_of, spark, tmp_path):
    pairs = [(i, f"word{i} and more, of text {i}") for i in range(60)]
    for name, more, files in (("one", {}, {1}), ("several", {"range_bytes": 300}, range(4, 8))):
        path = str(tmp_path / name)
        tokens.write_tokens(docs_of(pairs).repartition(5), path, **more)
        assert len(list((tmp_path / name).glob("*.parquet"))) in files
        rows = tokens.crc32_of_ids(tokens.read_tokens(spark, path)).collect()
        assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows) == expected(pairs)
