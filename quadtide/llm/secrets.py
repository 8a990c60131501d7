"""Secrets by pattern and by token efficiency.

Random strings cost a byte-pair vocabulary many tokens for few characters. Runs of credential
characters that stay below ``ratio`` characters a token are reported, unless they are known digests or
identifiers. Long words and names come near that ratio, so runs without a digit have a stricter one.
"""

import base64
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadtide.llm.common import column, small_batches, worker_memo

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KINDS = ("assign", "access", "hex", "token")

NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
# Shorter matches of these two fail, and nothing inside a failing run can be longer than the run.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}")
#: Not secrets although random: digests of the usual lengths, UUIDs, plain numbers and dates.
KNOWN = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128}|[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}|[0-9/_-]+)")


@dataclass(frozen=True)
class TokenTest:
    """Runs of at least ``shortest`` characters below ``ratio`` characters a token, those without a digit
    below ``letters``."""

    vocabulary: str | None = None
    ratio: float = 2.2
    shortest: int = 16
    letters: float = 1.6


def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("secrets", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def spans_of(text: str | None, encode, test: TokenTest) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start and kind; positions are code points."""
    if not text:
        return []
    found, lower = [], text.lower()
    if any(n in lower for n in NAMES):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    runs = list(RUN.finditer(text))
    if runs:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
        found += [("hex", *m.span()) for m in HEX.finditer(text)]
        base = list(found)
        for m in runs:
            s, (a, b) = m[0], m.span()
            if b - a < test.shortest or KNOWN.fullmatch(s):
                continue
            if any(x < b and a < y for _, x, y in base):
                continue
            if (b - a) / len(encode(s)) < (test.ratio if any(c.isdigit() for c in s) else test.letters):
                found.append(("token", a, b))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", test: TokenTest = TokenTest()) -> DataFrame:
    """One row per row of ``docs``: ``id`` and ``spans``, an array of (kind, start, end).

    Null and empty texts have no spans; texts are read whole; repeated rows give a row each; a null id
    stays null; other columns are not looked at. ``token`` spans never overlap those of the patterns.
    """
    path = test.vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        encode = worker_memo(("secrets", path), lambda: encoder(path)).encode_ordinary
        for b in batches:
            got = [[dict(zip(("kind", "start", "end"), s)) for s in spans_of(t.as_py(), encode, test)] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, spans)], ["id", "spans"])

    rows = small_batches(docs).select(column(docs, id_col).cast("long").alias("id"), column(docs, text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, spans array<struct<kind:string,start:long,end:long>>")


def redact(text: str | None, spans, mark: str = "<SECRET>") -> str | None:
    """The text with every span, overlapping ones together, replaced by ``mark``."""
    if not text or not spans:
        return text
    out, at = [], 0
    for s in sorted((x["start"], x["end"]) for x in spans):
        if s[0] >= at:
            out += [text[at : s[0]], mark]
        at = max(at, s[1])
    return "".join(out) + text[at:]


def without_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", test: TokenTest = TokenTest()) -> DataFrame:
    """``docs`` with secrets in the text replaced; everything else as it was.

    Null texts stay null, empty ones empty; texts are read whole; repeated rows are cleaned alike, ids are
    not looked at; an empty table stays empty.
    """
    path = test.vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def clean(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = worker_memo(("secrets", path), lambda: encoder(path)).encode_ordinary
        for texts in parts:
            yield texts.map(lambda t: redact(t, [{"start": a, "end": b} for _, a, b in spans_of(t, encode, test)]))

    udf = F.pandas_udf(clean, T.StringType())
    return small_batches(docs).withColumn(text_col, udf(column(docs, text_col).cast("string")))
