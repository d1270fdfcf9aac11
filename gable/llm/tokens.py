"""Token ids of documents as Parquet, for selective reads.

Documents are dealt to ranges of ascending id and encoded there. Each file is a range:
row groups and pages of a set size, token ids as a dictionary-encoded list column, ids
and positions as delta-encoded integers, and page indexes, so that a reader of a few
documents or of the metadata alone skips the rest. A row holds its start inside its
range; adding the sizes of the ranges before gives its start in the whole corpus.
"""

import os
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gable.llm.common import ranges, releasing, small_batches, whole_text
from gable.session import fresh_folder

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END = 1
#: Text of a range. A task learns its words anew, so small ranges cost time; what it remembers takes memory.
RANGE_BYTES = 20 << 20
#: Ranges of a small corpus have at least so much text, where there are cores for more of them.
LEAST_BYTES = 1 << 20
REMEMBERED = 600_000
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Byte-level vocabularies write bytes that are not visible characters of Latin-1 as the code points from 256 on.
SYMBOLS = dict(zip([b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)], range(256, 512)))
SCHEMA = "part int, doc_id bigint, local_start bigint, n_tokens bigint, ids array<int>"
LAYOUT = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",  # delta encoding where there is no dictionary
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.dictionary.page.size": str(1 << 20),
    **{f"parquet.enable.dictionary#{c}": "false" for c in ("part", "doc_id", "local_start", "n_tokens")},
}


def as_symbols(part: bytes) -> str | None:
    """A part of letters alone, in lower case, with a symbol for each byte; None for other parts."""
    if part.isalpha():
        return part.decode()
    text = part.decode()
    if text.isascii() or not text.isalpha() or not unicodedata.is_normalized("NFC", text):
        return None
    text = "".join(map(str.lower, text))
    return text.encode().decode("latin-1").translate(SYMBOLS) if text.isalpha() else None


class Encoder:
    """Encodes texts by the tokenizers library, each distinct part of a run of non-blank characters once.

    This vocabulary is for lower case, its tokens never reach over ASCII white space and
    white space gives none, so the ids of a text are those of its runs one after the
    other. ASCII punctuation behind an ASCII letter or digit at the end of a run is a
    pre-token of its own and makes a part of its own. Many mixed parts are encoded in
    one call, with a control character between them, whose single id tells them apart.
    """

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        (self.mark,) = self.library("\x01")
        if not all(t.content.startswith("<|") for t in tokenizer.get_added_tokens_decoder().values()):
            raise ValueError("special tokens are expected to begin with <|")
        self.forget()

    def library(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def forget(self) -> None:
        self.number: defaultdict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.parts: dict[bytes, list[int]] = {b"": []}
        self.pool, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def learn(self, parts: list[bytes]) -> None:
        """Ids of parts: a lone word by the vocabulary's merges at once, others through all steps."""
        mixed, tokenize, known = [], self.tokenizer.model.tokenize, self.parts
        for x in parts:
            if (word := as_symbols(x)) is None:
                mixed.append(x)
            else:
                known[x] = [t.id for t in tokenize(word)]
        for at in range(0, len(mixed), 2_000):
            some = mixed[at : at + 2_000]
            ids = self.library(" \x01 ".join([x.decode() for x in some]))
            cuts = [-1, *[i for i, n in enumerate(ids) if n == self.mark], len(ids)]
            if len(cuts) == len(some) + 1:
                known.update((x, ids[i + 1 : j]) for x, i, j in zip(some, cuts, cuts[1:]))
            else:  # a part holds the control character itself
                known.update((x, self.library(x.decode())) for x in some)

    def runs_of(self, column: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Distinct runs of a column of texts, the run at each place, and where each text's places end.

        White space at either end of a text leaves an empty run. Special tokens are found
        before letters are lowered, so a run that may hold one stays as it is.
        """
        special = pa.compute.any(pa.compute.match_substring(column, "<|")).as_py()
        split = pa.compute.ascii_split_whitespace(column if special else pa.compute.ascii_lower(column))
        coded = split.flatten().dictionary_encode()
        runs = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        if special:
            runs = [r if b"<|" in r else r.lower() for r in runs]
        return runs, coded.indices.to_numpy(), split.offsets.to_numpy()

    def encode(self, texts: pa.Array | list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each text has; a null text has none."""
        if len(self.number) > REMEMBERED:  # bounded memory; runs are simply encoded again
            self.forget()
        column = pa.array(texts, pa.binary()) if isinstance(texts, list) else texts
        runs, places, last = self.runs_of(column.cast(pa.string()).fill_null(""))
        at = np.fromiter(map(self.number.__getitem__, runs), np.int64, len(runs))[places]
        cores, tails = [], []
        for run in islice(self.number, len(self.ends) - 1, None):
            core, tail = run.rstrip(PUNCTUATION), b""
            if core != run:
                if core[-1:].isalnum() and b"<|" not in run:
                    tail = run[len(core) :]
                else:
                    core = run
            cores.append(core)
            tails.append(tail)
        self.learn([x for x in {*cores, *tails} if x not in self.parts])
        ids_of = self.parts.__getitem__
        pairs = list(zip(map(ids_of, cores), map(ids_of, tails)))
        sizes = np.fromiter((len(a) + len(b) for a, b in pairs), np.int64, len(pairs))
        added = np.fromiter(chain.from_iterable(chain.from_iterable(pairs)), np.int32, int(sizes.sum()))
        self.pool = np.concatenate([self.pool, added])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        sizes = np.diff(self.ends)[at]
        ids = self.pool[ranges(self.ends[at], sizes)]
        return ids, np.diff(np.r_[0, np.cumsum(sizes)][last])


def write_tokens(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end: int = END, range_bytes: int = RANGE_BYTES) -> None:
    """Write one row per document in ascending doc_id: its ids with `end` behind them.

    Null texts are empty and have the end id alone. Null ids come first; documents of
    one id come in the order of a hash of their text, then of the text. Other columns
    of `docs` are not looked at.
    """
    docs = docs.select("doc_id", whole_text(F.col("text")).alias("text"))
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // range_bytes), min(spark.sparkContext.defaultParallelism, total // LEAST_BYTES))
    with open(tokenizer) as f:
        vocabulary = spark.sparkContext.broadcast(f.read())
    order = [F.col("doc_id"), F.xxhash64("text"), F.col("text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        part, start, encoder = TaskContext.get().partitionId(), 0, None
        for batch in small_batches(batches, "text", 4 << 20):
            encoder = encoder or Encoder(Tokenizer.from_str(vocabulary.value))
            ids, sizes = encoder.encode(batch.column("text"))
            behind = np.cumsum(sizes)
            ids = np.insert(ids, behind, end)
            offsets = np.r_[0, behind + np.arange(1, len(sizes) + 1)]
            n = np.diff(offsets)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), part, np.int32)), batch.column("doc_id"), pa.array(start + offsets[:-1]), pa.array(n), lists],
                names=["part", "doc_id", "local_start", "n_tokens", "ids"],
            )
            start += int(offsets[-1])

    dealt = docs.repartitionByRange(parts, *order[:2]).sortWithinPartitions(*order)
    dealt.mapInArrow(releasing(run), SCHEMA).write.options(**LAYOUT).parquet(path)


def read_tokens(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids, or some of them; only their column chunks are read."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    columns = columns or ["doc_id", "start", "n_tokens", "ids"]
    if "start" in columns:
        sizes = rows.groupBy("part").agg(F.sum("n_tokens").alias("_size"))
        before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        # One small row for each range, however large the corpus.
        offsets = sizes.select("part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
        rows = rows.join(F.broadcast(offsets), "part").withColumn("start", F.col("_before") + F.col("local_start"))
    return rows.select(*columns)


def crc32_of_ids(rows: DataFrame) -> DataFrame:
    """The rows with `ids_crc32` of their ids as little-endian 32-bit integers in place of the ids."""
    kept = [c for c in rows.columns if c != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            flat = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            at = lists.offsets.to_numpy()
            sums = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(sums, pa.int64())], names=[*kept, "ids_crc32"])

    return rows.mapInArrow(run, rows.select(*kept, F.lit(0).cast("bigint").alias("ids_crc32")).schema)


def encoded(docs: DataFrame) -> DataFrame:
    """Write the documents' ids to the shared folder and read them back."""
    path = fresh_folder(docs.sparkSession, "tokens")
    write_tokens(docs, path)
    return read_tokens(docs.sparkSession, path)
