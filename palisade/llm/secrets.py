"""Secret scans: patterns of known kinds, and a token-efficiency test for random strings."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.vocabulary import rank_encoding

#: Order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "random")

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
#: Lengths of digests in hex.
DIGESTS = (32, 40, 56, 64, 96, 128)
#: A part of words joined by signs; atomic, so that a match takes time in proportion to the length.
WORD = r"(?>[a-z]{2,}+|[A-Z]{2,}+|[A-Z][a-z]{2,}+|[0-9]{1,4}+)"
#: Not secrets: UUIDs, digests written in hex or with a prefix, plain numbers, words joined by signs.
KNOWN = re.compile(
    r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}"
    r"|(?:(?:md5|sha1|sha224|sha256|sha384|sha512)[-:=])?(?:"
    + "|".join(f"[0-9a-f]{{{n}}}|[0-9A-F]{{{n}}}" for n in DIGESTS)
    + r")"
    r"|[0-9+/_=-]+"
    rf"|{WORD}(?>[/_-]++{WORD})++"
)

SPANS = "array<struct<kind:string,start:long,end:long>>"


def find_spans(text: str | None, encode, max_chars_per_token: float) -> list[tuple[str, int, int]]:
    """Spans of one text by start, then kind; the random ones keep clear of the others."""
    text = text or ""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    taken = sorted((a, b) for _, a, b in found)
    at, past = 0, 0
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        # Candidates come in order: the spans before one's end are looked at once, and only how far they reach counts.
        while at < len(taken) and taken[at][0] < b:
            past = max(past, taken[at][1])
            at += 1
        if past > a or KNOWN.fullmatch(m[0]):
            continue
        if b - a < max_chars_per_token * len(encode(m[0])):
            found.append(("random", a, b))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def scan(docs: DataFrame, vocabulary: str, text: str = "text", max_chars_per_token: float = 1.9) -> DataFrame:
    """``docs`` with a column ``spans``: kind, start and end (code points, end exclusive).

    ``vocabulary``: a tiktoken rank file. A string of 20 or more letters, digits and ``+/_=-`` is
    random if it has fewer than ``max_chars_per_token`` characters a token; UUIDs, hex of the lengths
    of digests, numbers and words joined by signs are left out first.
    Null and empty texts have no spans; repeated rows are scanned alike; other columns stay, whatever
    their names, and a column ``spans`` is replaced. Nothing is shuffled.
    """

    @F.pandas_udf(SPANS)
    def spans(texts: pd.Series) -> pd.Series:
        encode = rank_encoding(vocabulary).encode_ordinary
        return pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in find_spans(x, encode, max_chars_per_token)] for x in texts], dtype=object)

    return docs.withColumn("spans", spans(F.col(text).cast("string")))


def listed(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redact(docs: DataFrame, vocabulary: str, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with each span of :func:`scan` replaced by ``mark``; overlapping spans become one. A null text stays null."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        encode = rank_encoding(vocabulary).encode_ordinary
        out = []
        for x in texts:
            parts, at = [], 0
            for _, a, b in find_spans(x, encode, 1.9):
                if a >= at:
                    parts += [x[at:a], mark]
                at = max(at, b)
            out.append(x if x is None else "".join([*parts, x[at:]]))
        return pd.Series(out, dtype=object)

    return docs.withColumn(text, clean(F.col(text).cast("string")))
