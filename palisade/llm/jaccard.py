"""N-gram Jaccard join with set-relation skipping."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.shared import components, grouped_links, removed, written

#: Odd multipliers that mix the hashes of a shingle's words by place.
MIX = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63]
#: Shingles that a bucket counts, about; the number of buckets follows the input.
BUCKET = 2_000_000
#: Shingles of which a task keeps the lists before it hands them on.
HELD = 3_000_000
#: Bytes of a shingle's name.
NAME_BYTES = 7
MEMO = 1_000_000
#: 64-bit words of a set's parity map.
WORDS = 8


def shingles(text: str | None, width: int, memo: dict[bytes, int]) -> np.ndarray:
    """Sorted 56-bit names of the distinct ``width``-word shingles; of fewer words, one shingle of them all; without words none.

    Only A-Z are lower-cased; words are runs without ASCII white space.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = []
    for w in words:
        h = memo.get(w)
        if h is None:
            h = memo[w] = xxhash.xxh3_64_intdigest(w)
        hashes.append(h)
    own = np.array(hashes, np.uint64)
    n = max(1, len(own) - width + 1)
    out = np.full(n, min(len(own), width), np.uint64)
    for i in range(min(width, len(own))):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(MIX[i % 5]) + own[i : i + n]
    return np.unique((out ^ (out >> np.uint64(32))) & np.uint64((1 << 8 * NAME_BYTES) - 1))


def name(own: np.ndarray) -> int:
    """A set's 64-bit name: equal sets share it."""
    return xxhash.xxh3_64_intdigest(own.tobytes()) - 2**63


def parity(sets: pd.Series) -> pd.Series:
    """Maps of bits, each flipped by every shingle that falls on it: two maps differ in no more bits than their sets in shingles."""
    out = []
    for h in sets:
        own = np.asarray(h, np.int64).view(np.uint64)
        odd = np.bincount((own % np.uint64(64 * WORDS)).astype(np.int64), minlength=64 * WORDS) & 1
        out.append(np.packbits(odd.astype(np.uint8)).view("<i8"))
    return pd.Series(out, dtype=object)


def set_names(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, n_shingles, id``: equal sets have one id, which is null for empty ones."""

    def names(batches):
        memo: dict[bytes, int] = {}
        for batch in batches:
            sets = [shingles(x, width, memo) for x in batch["text"]]
            ids = pd.array([name(s) if len(s) else None for s in sets], dtype="Int64")
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_shingles": [len(s) for s in sets], "id": ids})
            if len(memo) > MEMO:
                memo.clear()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInPandas(names, f"doc_id {kind}, n_shingles long, id long")


def shared_shingles(docs: DataFrame, width: int, buckets: int) -> DataFrame:
    """``id, n, h, df``: per distinct set its size and those shingles that other sets have too, with the number of sets that do.

    Tasks hand on packed lists by hash bucket, each set once a task; the bucket counts the sets of a shingle.
    """

    def lists(batches):
        memo: dict[bytes, int] = {}
        held: dict[int, np.ndarray] = {}
        size = 0

        def flush():
            ids = np.array(list(held), np.int64)
            sizes = np.array([len(s) for s in held.values()], np.int64)
            h, own = np.concatenate(list(held.values())), np.repeat(np.arange(len(ids), dtype=np.uint32), sizes)
            at = (h % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((h, at))
            h, own, at = h[order], own[order], at[order]
            planes = h.view(np.uint8).reshape(-1, 8)[:, :NAME_BYTES]
            cuts = np.flatnonzero(np.diff(at, prepend=-1, append=buckets))
            rows = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                some, place = np.unique(own[a:b], return_inverse=True)
                rows.append((int(at[a]), planes[a:b].T.tobytes(), place.astype("<u2" if len(some) < 65536 else "<u4").tobytes(), ids[some].tobytes(), sizes[some].astype("<u4").tobytes()))
            return pd.DataFrame(rows, columns=["bucket", "h", "place", "ids", "sizes"])

        for batch in batches:
            for text in batch["text"]:
                own = shingles(text, width, memo)
                if len(own) and (i := name(own)) not in held:
                    held[i] = own
                    size += len(own)
                if size >= HELD:
                    yield flush()
                    held, size = {}, 0
            if len(memo) > MEMO:
                memo.clear()
        if held:
            yield flush()

    def count(group: pd.DataFrame) -> pd.DataFrame:
        h, ids, sizes = [], [], []
        for r in group.itertuples():
            planes = np.frombuffer(r.h, np.uint8).reshape(NAME_BYTES, -1)
            own = np.zeros((planes.shape[1], 8), np.uint8)
            own[:, :NAME_BYTES] = planes.T
            own = own.view(np.uint64).ravel()
            place = np.frombuffer(r.place, "<u2" if len(r.place) == 2 * len(own) else "<u4")
            h.append(own)
            ids.append(np.frombuffer(r.ids, np.int64)[place])
            sizes.append(np.frombuffer(r.sizes, "<u4")[place])
        h, ids, sizes = map(np.concatenate, (h, ids, sizes))
        order = np.lexsort((ids, h))
        h, ids, sizes = h[order], ids[order], sizes[order]
        own = np.append(True, (h[1:] != h[:-1]) | (ids[1:] != ids[:-1]))
        h, ids, sizes = h[own], ids[own], sizes[own]
        first = np.append(True, h[1:] != h[:-1])
        df = np.diff(np.append(np.flatnonzero(first), len(h)))[np.cumsum(first) - 1]
        some = df > 1
        if not some.any():
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in ("id", "n", "h", "df")})
        h, ids, sizes, df = h[some], ids[some], sizes[some], df[some]
        order = np.argsort(ids, kind="stable")
        h, ids, sizes, df = h[order].view(np.int64), ids[order], sizes[order], df[order]
        cuts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        ends = np.append(cuts[1:], len(ids))
        return pd.DataFrame({"id": ids[cuts], "n": sizes[cuts].astype(np.int64), "h": [h[a:b] for a, b in zip(cuts, ends, strict=True)], "df": [df[a:b] for a, b in zip(cuts, ends, strict=True)]})

    packed = docs.select(F.col("text").cast("string").alias("text")).mapInPandas(lists, "bucket int, h binary, place binary, ids binary, sizes binary")
    return packed.groupBy("bucket").applyInPandas(count, "id long, n long, h array<long>, df array<long>")


def jaccard_links(docs: DataFrame, names: DataFrame, width: int, percent: int) -> DataFrame:
    """Links ``(a, b)`` between set ids that connect what all links of ``percent`` or more would connect.

    Index: a set's shingles are ordered by rarity. Of n shingles two linked sets share one among the first
    n - ceil(n * percent / 100) + 1 of each; shingles of a single set come first and lead nowhere, so most
    sets drop out. Pairs are left out by size and position, row by row; members of a list are compared with
    its leader first.
    Pairs across components are verified only if their parity maps leave room for the overlap, which no link fails.
    """
    total = names.agg(F.sum("n_shingles")).first()[0] or 0
    parts = shared_shingles(docs, width, 16 + total // BUCKET)
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    # Within a bucket's part nothing is lost by dropping sets that have too few shared shingles in all.
    gathered = parts.groupBy("id").agg(F.max("n").alias("n"), F.flatten(F.collect_list(F.arrays_zip("df", "h"))).alias("s"))
    kept = gathered.where(F.size("s") >= F.ceil(F.col("n") * percent / 100)).select("id", "n", F.array_sort("s").alias("s"))
    kept = kept.withColumn("single", F.col("n") - F.size("s")).withColumn("prefix", prefix)
    sets = written(kept.select("id", "n", F.col("s.h").alias("h"), "single", "prefix"), "sets")
    head = F.expr("slice(h, 1, cast(prefix - single as int))")
    postings = sets.select("id", "n", "single", F.posexplode(head).alias("at", "g"))
    postings = postings.select("g", "id", "n", (F.col("at") + F.col("single")).alias("at"))
    contents = sets.select("id", "n", "h")

    def admissible(left: str, right: str) -> Column:
        n, m = F.col(f"{left}.n"), F.col(f"{right}.n")
        shared = 1 + F.least(n - F.col(f"{left}.at") - 1, m - F.col(f"{right}.at") - 1)
        return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (shared * (100 + percent) >= (n + m) * percent)

    def verify(pairs: DataFrame) -> DataFrame:
        one = contents.select(F.col("id").alias("a"), F.col("n").alias("n"), F.col("h").alias("x"))
        two = contents.select(F.col("id").alias("b"), F.col("n").alias("m"), F.col("h").alias("y"))
        both = pairs.join(one, "a").join(two, "b").withColumn("k", F.size(F.array_intersect("x", "y")))
        return both.where(F.col("k") * 100 >= (F.col("n") + F.col("m") - F.col("k")) * percent).select("a", "b")

    def detail(ids: DataFrame) -> DataFrame:
        return sets.join(ids, "id", "left_semi").select("id", "single", F.pandas_udf(parity, "array<long>")("h").alias("bits"))

    def close(left: str, right: str) -> Column:
        total = F.col(f"{left}.n") + F.col(f"{right}.n")
        differ = sum(F.bit_count(F.col(f"{left}.bits")[i].bitwiseXOR(F.col(f"{right}.bits")[i])) for i in range(WORDS))
        differ = differ + F.col(f"{left}.single") + F.col(f"{right}.single")
        return (total - differ) * (100 + percent) >= 2 * total * percent

    links = grouped_links(postings, verify, admissible, sets.select("id", head.alias("head")), detail=detail, close=close)
    removed(sets)
    return links


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id``: documents grouped by links of 100 * intersection >= ``percent`` * union.

    ``component_id`` is the smallest doc_id reachable, itself included. Sets are of distinct ``width``-word
    shingles, under 56-bit names; a shorter text is one shingle. Texts without words, null ones too, link with
    nothing. Equal sets are one node, so copies and repeated rows cost no pairs. An empty table gives no rows;
    other columns are ignored.
    """
    names = written(set_names(docs, width), "names")
    links = jaccard_links(docs, names, width, percent)
    nodes = components(links)
    removed(links)
    # A set's smallest document, then the component's.
    node = names.where("id is not null").groupBy("id").agg(F.min("doc_id").alias("least"))
    node = node.join(nodes, "id", "left").withColumn("c", F.coalesce("component", "id"))
    least = node.groupBy("c").agg(F.min("least").alias("component_id"))
    place = node.join(least, "c").select("id", "component_id")
    out = names.join(place, "id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
