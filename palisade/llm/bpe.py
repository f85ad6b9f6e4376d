"""Byte-level BPE: encoding by a global distinct-word shuffle, decoding by a join with the token-byte table."""

from __future__ import annotations

import re
import zlib
from collections import defaultdict, deque
from functools import lru_cache
from itertools import chain, count

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.shared import gather
from palisade.llm.vocabulary import rank_encoding, read_ranks

#: Characters of input for each hash bucket by which words are shuffled.
BUCKET_CHARS = 4_000_000
#: White space before a space: there the text can't be cut at the space.
RUN = re.compile(r"\s ")


@lru_cache(2)
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The token-byte table: all bytes by id, and where each id's begin. As large as the vocabulary, whatever the input."""
    ranks = read_ranks(path)
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return np.frombuffer(b"".join(table), np.uint8), np.cumsum([0, *map(len, table)])


def squeeze(numbers: np.ndarray, kind: str = "<u4") -> bytes:
    """Compressed by byte planes."""
    numbers = numbers.astype(kind)
    return zstandard.compress(numbers.view(np.uint8).reshape(-1, numbers.itemsize).T.tobytes(), 3)


def unsqueeze(data: bytes, kind: str = "<u4") -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(size, -1).T.tobytes(), kind)


def blocks(batches, block_chars: int):
    """A task's rows in blocks of about ``block_chars`` characters, each with a name that follows from its content."""
    rows, chars, name = [], 0, xxhash.xxh3_64()
    for batch in batches:
        for doc_id, row, text in zip(batch["doc_id"], batch["row"], batch["text"], strict=True):
            text = text or ""
            rows.append((doc_id, text))
            chars += len(text)
            name.update(f"{row} ".encode() + text.encode())
            if chars >= block_chars or len(rows) >= 200_000:
                yield name.intdigest() - 2**63, rows
                rows, chars, name = [], 0, xxhash.xxh3_64()
    if rows:
        yield name.intdigest() - 2**63, rows


def pre_tokens():
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN).findall


class Block:
    """A block's words in order of first occurrence, the same whenever the block is laid out.

    A text is cut at its spaces, each part with the space before it: no match goes on past a space that follows other
    than white space. Each distinct part is split into words once; texts with white space before a space are split whole.
    """

    def __init__(self, rows: list, find, buckets: int, placed: bool):
        # Texts' first parts, and whole texts, have no space before them.
        bare, spaced = defaultdict(count().__next__), defaultdict(count().__next__)
        words = defaultdict(count().__next__)
        self.sizes, places, whole = [], [], {}
        for n, (_, text) in enumerate(rows):
            if RUN.search(text):
                own = find(text)
                whole[n] = np.fromiter(map(words.__getitem__, own), np.int64, len(own))
                own = []
            else:
                first, *own = text.split(" ")
                if placed:
                    places.append(np.array([-1 - bare[first]]))
                    places.append(np.fromiter(map(spaced.__getitem__, own), np.int64, len(own)))
                else:
                    bare[first]
                    deque(map(spaced.__getitem__, own), 0)
            self.sizes.append(0 if n in whole else 1 + len(own))
        found = [find(x) for x in bare] + [find(" " + x) for x in spaced]
        flat = [w for x in found for w in x]
        numbers = np.fromiter(map(words.__getitem__, flat), np.int64, len(flat))
        self.words = [w.encode() for w in words]
        bucket = np.fromiter(map(zlib.crc32, self.words), np.int64, len(words)) % buckets
        #: Words by bucket.
        self.order = np.argsort(bucket, kind="stable")
        self.bucket = bucket[self.order]
        if placed:
            starts = np.cumsum([0, *map(len, found)])
            at = np.concatenate([np.empty(0, np.int64), *places])
            at = np.where(at < 0, -1 - at, at + len(bare))
            self.place(numbers, starts, at, whole)

    def place(self, flat: np.ndarray, starts: np.ndarray, at: np.ndarray, whole: dict[int, np.ndarray]) -> None:
        """The word at each position of all texts, end to end, and the texts' numbers of words."""
        ends = np.cumsum([0, *self.sizes])
        counts = np.append(0, np.cumsum(starts[at + 1] - starts[at]))
        laid = gather(flat, starts, at)
        if whole:
            cuts = counts[ends]
            laid = np.concatenate([whole.get(n, laid[cuts[n] : cuts[n + 1]]) for n in range(len(self.sizes))])
        self.lengths = counts[ends[1:]] - counts[ends[:-1]]
        for n, own in whole.items():
            self.lengths[n] = len(own)
        self.positions = laid


def distinct_words(docs: DataFrame, block_chars: int, buckets: int) -> DataFrame:
    """``block, bucket, data``: the distinct words of each block."""

    def words(batches):
        find = pre_tokens()
        for block, rows in blocks(batches, block_chars):
            own = Block(rows, find, buckets, False)
            found = [own.words[i] for i in own.order]
            cuts = np.flatnonzero(np.diff(own.bucket, prepend=-1, append=buckets)) if found else np.zeros(1, int)
            out = [(block, int(own.bucket[a]), zstandard.compress(np.array([b - a, *map(len, found[a:b])], "<u4").tobytes() + b"".join(found[a:b]), 3)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pd.DataFrame(out, columns=["block", "bucket", "data"])

    return docs.mapInPandas(words, "block long, bucket int, data binary")


def positions(docs: DataFrame, block_chars: int, buckets: int) -> DataFrame:
    """``block, doc_ids, lengths, order, data``: a row a block, with the word at each position of its documents by rank of frequency.

    ``order`` holds the block's words by rank, numbered as :func:`distinct_words` lists them.
    """

    def places(batches):
        find = pre_tokens()
        for block, rows in blocks(batches, block_chars):
            own = Block(rows, find, buckets, True)
            listed = np.empty(len(own.words), np.int64)
            listed[own.order] = np.arange(len(own.words))
            ranked = np.argsort(-np.bincount(own.positions, minlength=len(own.words)), kind="stable")
            rank = np.empty(len(ranked), np.int64)
            rank[ranked] = np.arange(len(ranked))
            yield pd.DataFrame({"block": [block], "doc_ids": [[r[0] for r in rows]], "lengths": [squeeze(own.lengths)], "order": [squeeze(listed[ranked])], "data": [squeeze(rank[own.positions])]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInPandas(places, f"block long, doc_ids array<{kind}>, lengths binary, order binary, data binary")


def encode(docs: DataFrame, vocabulary: str, block_chars: int = 6_000_000) -> DataFrame:
    """``doc_id, ids, decoded`` of each row: the token ids of its whole text as little-endian unsigned 32-bit integers, and the bytes they stand for.

    ``vocabulary``: a tiktoken rank file. Pre-tokens are laid out with their positions in blocks; each block
    sends a word once to the word's bucket, where each distinct word is encoded once, bucket by bucket; its ids come back to the
    block and are put together by position. Only distinct words and compressed positions are shuffled, and a
    frequent word is one entry a block; texts are read twice, which takes less than to keep what is laid out. Null and empty texts have no ids; ties and repeated rows, also of one
    ``doc_id``, each give a row; an empty table gives none; other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.col("text").cast("string").alias("text"))
    buckets = 16 + (docs.agg(F.sum(F.length(F.col("text").cast("string")))).first()[0] or 0) // BUCKET_CHARS

    def encode_words(batches):
        encoding, memo, last = rank_encoding(vocabulary), {}, None
        for batch in batches:
            out = []
            for bucket, data in zip(batch["bucket"], batch["data"], strict=True):
                if bucket != last:
                    memo, last = {}, bucket
                data = zstandard.decompress(data)
                n = int.from_bytes(data[:4], "little")
                a, ids = 4 * (n + 1), []
                for b in np.cumsum(np.frombuffer(data, "<u4", n, 4)) + a:
                    word = data[a:b]
                    own = memo.get(word)
                    if own is None:
                        own = memo[word] = encoding.encode_ordinary(word.decode())
                    ids.append(own)
                    a = int(b)
                out.append(squeeze(np.array([n, *map(len, ids), *chain.from_iterable(ids)])))
            yield pd.DataFrame({"block": batch["block"], "bucket": batch["bucket"], "data": out})

    coded = distinct_words(source, block_chars, buckets).repartition("bucket").sortWithinPartitions("bucket").mapInPandas(encode_words, "block long, bucket int, data binary")

    def assemble(texts: pd.DataFrame, codes: pd.DataFrame) -> pd.DataFrame:
        sizes, flat = [np.empty(0, np.int64)], [np.empty(0, "<u4")]
        for data in codes.sort_values("bucket")["data"]:
            data = unsqueeze(data)
            sizes.append(data[1 : data[0] + 1].astype(np.int64))
            flat.append(data[data[0] + 1 :])
        # By rank: the ids of each word of the block, end to end.
        texts = texts.iloc[0]
        order = unsqueeze(texts["order"]).astype(np.int64)
        flat = gather(np.concatenate(flat), np.cumsum(np.concatenate([[0], *sizes])), order)
        starts = np.cumsum(np.concatenate([[0], np.concatenate(sizes)[order]]))
        table, begins = token_bytes(vocabulary)
        laid, ends = unsqueeze(texts["data"]), np.cumsum(np.append(0, unsqueeze(texts["lengths"]).astype(np.int64)))
        ids, raw = [], []
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            own = gather(flat, starts, laid[a:b])
            ids.append(own.astype("<u4").tobytes())
            raw.append(gather(table, begins, own.astype(np.int64)).tobytes())
        return pd.DataFrame({"doc_id": pd.Series(list(texts["doc_ids"]), dtype=object), "ids": ids, "decoded": raw})

    laid = positions(source, block_chars, buckets)
    return laid.groupBy("block").cogroup(coded.groupBy("block")).applyInPandas(assemble, f"doc_id {kind}, ids binary, decoded binary")


def decode(tokens: DataFrame, vocabulary: str, ids: str = "ids") -> DataFrame:
    """``tokens`` with ``decoded``: the bytes of its ids, joined from the token-byte table, whose size the vocabulary bounds.

    Null ids give null, ids outside the vocabulary nothing.
    """

    @F.pandas_udf("binary")
    def joined(column: pd.Series) -> pd.Series:
        table, begins = token_bytes(vocabulary)
        own = [None if x is None else np.frombuffer(x, "<u4").astype(np.int64) for x in column]
        return pd.Series([None if x is None else gather(table, begins, x[x < len(begins) - 1]).tobytes() for x in own], dtype=object)

    return tokens.withColumn("decoded", joined(ids))
