"""BPE encoding and decoding of whole documents through a table of distinct words.

1. Every task cuts its documents into words and numbers the distinct words of each of its blocks.
2. The blocks' words are dealt out by hash.  A word's home task encodes it once, whichever blocks have it,
   and answers each block with the ids of its words.  Words travel packed, one row per block and home.
3. Each block's documents, as sequences of word numbers, meet the ids of the block's words and are put
   together by position.  Decoding looks each id up in the tokenizer's id-to-piece table, whose size is the
   tokenizer's vocabulary.

A block ends with the task's input or at ``BLOCK_WORDS`` distinct words, so memory does not follow the
input.  Words are cut at ASCII white space only: the tokenizers meant here drop white space before merging
and merge nothing across it.  Steps 1 and 3 scan the input once each and number words in the same order; a
fingerprint of each block's words tells if the input changed in between, and then the query fails.
"""

from __future__ import annotations

import functools
import hashlib
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct words to a block, and words that one call encodes.
BLOCK_WORDS, BATCH = 400_000, 4096


def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


class _Block:
    """Numbers distinct words in order of first use."""

    def __init__(self, nth: int):
        self.name, self.number = f"{TaskContext.get().partitionId()}:{nth}", {}

    def sequence(self, text: str | None) -> np.ndarray:
        put = self.number.setdefault
        return np.array([put(w, len(self.number)) for w in (text or "").encode("utf-8", "surrogatepass").split()], np.uint32)

    def mark(self) -> int:
        return xxhash.xxh64_intdigest(b"\n".join(self.number)) >> 1


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Block, pa.RecordBatch | None, list[np.ndarray], bool]]:
    """(block, slice of rows, their sequences, whether the block ends here)."""
    nth, block = 0, _Block(0)
    for batch in batches:
        for i in range(0, batch.num_rows, 64):
            part = batch.slice(i, 64)
            sequences = [block.sequence(x) for x in part.column("text").to_pylist()]
            full = len(block.number) >= BLOCK_WORDS
            yield block, part, sequences, full
            if full:
                nth += 1
                block = _Block(nth)
    yield block, None, [], True


def _words_by_home(docs: DataFrame, homes: int) -> DataFrame:
    """(home, block, mark, words, numbers): each block's distinct words, dealt out by hash."""
    names = ["home", "block", "mark", "words", "numbers"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, _, ended in _blocks(batches):
            if not ended or not block.number:
                continue
            words, mark = list(block.number), block.mark()
            home = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % np.uint32(homes)
            order = np.argsort(home, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(home[order])) + 1):
                text = zlib.compress(b"\n".join([words[i] for i in at]), 1)
                numbers = zlib.compress(np.diff(at, prepend=0).astype(np.uint32).tobytes(), 1)
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((home[at[0]], pa.int32()), (block.name, pa.string()), (mark, pa.int64()), (text, pa.binary()), (numbers, pa.binary()))], names)

    return docs.select("text").mapInArrow(scan, "home int, block string, mark bigint, words binary, numbers binary")


def encode_distinct(words: DataFrame, path: str, homes: int) -> DataFrame:
    """(block, mark, ids, counts, numbers): every distinct word of a home is encoded once."""
    names = ["block", "mark", "ids", "counts", "numbers"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, known, home = None, {}, None
        for batch in batches:
            for h, block, mark, text, numbers in zip(*[c.to_pylist() for c in batch.columns]):
                if h != home:  # rows come sorted by home
                    home, known = h, {}
                t = t or _tokenizer(path)
                own = zlib.decompress(text).split(b"\n")
                fresh = [w for w in own if w not in known]
                for i in range(0, len(fresh), BATCH):
                    part = fresh[i : i + BATCH]
                    for w, e in zip(part, t.encode_batch([w.decode("utf-8", "surrogatepass") for w in part], add_special_tokens=False)):
                        known[w] = np.array(e.ids, np.uint32).tobytes()
                found = [known[w] for w in own]
                counts = np.fromiter(map(len, found), np.uint32, len(found)) // 4
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in ((block, pa.string()), (mark, pa.int64()), (zlib.compress(b"".join(found), 1), pa.binary()), (zlib.compress(counts.tobytes(), 1), pa.binary()), (numbers, pa.binary()))], names)

    return words.repartition(homes, "home").sortWithinPartitions("home", "block").mapInArrow(encode, "block string, mark bigint, ids binary, counts binary, numbers binary")


def _sequences(docs: DataFrame) -> DataFrame:
    """(block, mark, doc_ids, sequences): the documents as word numbers, 64 to a row; ``mark`` comes with the block's end."""
    names = ["block", "mark", "doc_ids", "sequences"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, part, sequences, ended in _blocks(batches):
            ids = part.column("doc_id").to_pylist() if part is not None else []
            lengths = np.array([len(ids), *map(len, sequences)], np.uint32)
            packed = zlib.compress(np.concatenate([lengths, *sequences]).astype(np.uint32).tobytes(), 1)
            mark = block.mark() if ended and block.number else None
            yield pa.RecordBatch.from_arrays([pa.array([block.name]), pa.array([mark], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([packed], pa.binary())], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, "block string, mark bigint, doc_ids array<bigint>, sequences binary")


@functools.lru_cache(2)
def pieces(path: str) -> list[str]:
    """The tokenizer's id-to-piece table."""
    t = _tokenizer(path)
    return [t.id_to_token(i) or "" for i in range(t.get_vocab_size(with_added_tokens=True))]


def encode_documents(docs: DataFrame, path: str, decoded: bool = True, texts: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]) of ``docs`` (doc_id, text).

    ``ids_sha256`` is over little-endian unsigned 32-bit ids.  Null and empty texts have no tokens; rows
    that repeat, and null ids, keep their rows; an empty table gives no rows.
    """
    if json.loads(open(path).read())["decoder"] is not None:
        raise ValueError("this decodes tokenizers without a decoder only: pieces joined by spaces")
    homes = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<bigint>, decoded string" * texts
    names = [x.split()[0] for x in schema.split(", ")]

    def put_together(key, words, rows):
        marks = {*words.column("mark").to_pylist(), *rows.column("mark").drop_null().to_pylist()}
        if len(marks) > 1:
            raise ValueError("the documents changed between two scans; write them to a table first")
        found = [[np.frombuffer(zlib.decompress(x), np.uint32) for x in words.column(c).to_pylist()] for c in ("ids", "counts", "numbers")]
        ids, counts = (np.concatenate(x) if x else np.empty(0, np.uint32) for x in found[:2])
        number = np.concatenate([np.cumsum(x.view(np.int32)) for x in found[2]]) if found[2] else np.empty(0, np.int64)
        start, size = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
        start[number], size[number] = np.cumsum(counts) - counts, counts
        piece = np.array(pieces(path), object) if decoded else None
        out = []
        for doc_ids, packed in zip(rows.column("doc_ids").to_pylist(), rows.column("sequences").to_pylist()):
            packed = np.frombuffer(zlib.decompress(packed), np.uint32)
            n = int(packed[0])
            assert n == len(doc_ids)
            ends = np.cumsum(packed[1 : n + 1])
            for doc_id, s in zip(doc_ids, np.split(packed[n + 1 :], ends[:-1] if n else [])):
                long = size[s]
                at = np.repeat(start[s] - np.cumsum(long) + long, long) + np.arange(long.sum())
                own = ids[at]
                text = " ".join(piece[own]) if decoded else None
                row = [doc_id, len(own), hashlib.sha256(own.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest() if decoded else None]
                out.append(row + [own.tolist(), text] * texts)
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.string()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(names), types)], names)

    words = encode_distinct(_words_by_home(docs, homes), path, homes)
    return words.groupBy("block").cogroup(_sequences(docs).groupBy("block")).applyInArrow(put_together, schema)
