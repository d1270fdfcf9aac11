import hashlib

import numpy as np
import public_tokenizers
import tiktoken

from gable.llm import bpe, queries
from test_tokens import ODD

TEXTS = [*ODD, "  two  spaces \n\n end  ", "tab\t\tx \x1c y", "x" * 3000, "we're  'tis I'D", " 　ok  "]


def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(), special_tokens={})


def test_pretokens_cover_the_text():
    assert all("".join(bpe.pretokens(t)) == t for t in TEXTS)


def test_whole_table(spark):
    d = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    t, rows = library(), queries.op6_byte_bpe(spark, d).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = t.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_edges(docs_of, spark):
    pairs = [(None, None), (None, None), *enumerate(TEXTS), (0, TEXTS[2]), (77, "word " * 60_000)]
    docs = docs_of(pairs).withColumnRenamed("source", "IDS")
    ranks, t = bpe.read_ranks(), library()
    encoded = bpe.encode(docs, ranks, block_tokens=50)
    assert encoded.columns == ["doc_id", "lang", "n_chars", "n_tokens", "ids"]
    rows = [(r["doc_id"], list(r["ids"]), bytes(r["decoded"])) for r in bpe.decode(encoded, ranks).collect()]
    wanted = [(i, t.encode_ordinary(x or ""), (x or "").encode()) for i, x in pairs]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(rows, key=key) == sorted(wanted, key=key)
    assert bpe.encode(docs.limit(0), ranks).count() == 0
