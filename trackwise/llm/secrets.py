"""Operator 4, secret scans: stated patterns, and novelty against a primed dictionary.

Three patterns give the base spans. Beside them, every long run of key
characters that stands close after a sensitive word is a candidate. What a
candidate costs is measured with zstandard, primed with a dictionary of identifiers
common in code: its marginal bytes are the size of the frame of the surrounding text and the
candidate, less that of the surrounding text alone (without other copies of the
candidate). Names, words and placeholders are cheap there; random strings cost
about their length. A candidate whose marginal bytes reach ``NOVELTY`` of its
length is reported as ``novel``, unless a base span overlaps it.

Each document is worked on by itself in the task that reads it. Offsets are code points,
ends exclusive.

Defined cases: null text counts as empty and has no spans; of spans that begin together the
kind listed first comes first; repeated rows give a row each; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from trackwise.llm.byte_bpe import blocks
from trackwise.llm.common import ship_code

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Maximal runs: the same matches as ``[0-9a-f]+`` with the short ones dropped.
HEX = re.compile(r"[0-9a-f]{24,}")
#: Words after which a string may be a credential, and how far after them.
SENSITIVE = re.compile(r"(?ai:passw|passphrase|passcode|secret|token|api.?key|access.?key|private.?key|credential|bearer|authorization|auth)")
REACH = 48
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
AROUND = 256
NOVELTY = 0.8
PLAIN = (
    "the quick brown fox jumps over the lazy dog and then goes back to where it came from; most names in a program are "
    "made of words like these, joined by marks_like_this or ByCapitals or with-dashes, and some have numbers like 10 or 2048. "
)
IDENTIFIERS = (
    "password passwd secret token api_key apikey access_key private_key credential credentials authorization bearer "
    "authenticate authentication username user_name user_id client_id client_secret session_id request response "
    "function return import export default const let var class public private static void string integer boolean "
    "number object array null undefined true false config configuration settings environment environ getenv "
    "process.env os.environ example placeholder changeme your_api_key_here your_secret_here xxxxxxxxxxxxxxxx "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0123456789abcdef 00000000000000000000 "
    "application/json text/html content_type content_length localhost database_url connection_string parameters "
    "arguments description documentation implementation information initialize certificate public_key ssh-rsa "
    "https://www.example.com/ http:// .com/ .org/ /usr/local/bin /etc/ /home/ README LICENSE index_name file_path"
)


class Novelty:
    """Marginal compressed bytes: what a candidate adds to the frame of the text around it, under a dictionary of
    identifiers. A few plain words come first, so that letters have a price even where little text is around."""

    def __init__(self, identifiers: str = IDENTIFIERS, level: int = 3):
        dictionary = zstandard.ZstdCompressionDict(identifiers.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        params = zstandard.ZstdCompressionParameters.from_level(level, write_checksum=0, write_content_size=0, write_dict_id=0)
        self.tool = zstandard.ZstdCompressor(dict_data=dictionary, compression_params=params)

    def marginal(self, candidate: str, around: str) -> int:
        before = (PLAIN + around.replace(candidate, " ")).encode()
        return len(self.tool.compress(before + candidate.encode())) - len(self.tool.compress(before))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the stated patterns."""
    out = []
    low = text.lower()  # only asked whether a word is in it
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def novel_spans(text: str, base: list[tuple[int, int, int]], novelty: Novelty, least: float = NOVELTY) -> list[tuple[int, int, int]]:
    taken: list[tuple[int, int]] = []  # the base spans, merged
    for a, _, b in base:
        if taken and a <= taken[-1][1]:
            taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
        else:
            taken.append((a, b))
    out, seen = [], 0
    for word in SENSITIVE.finditer(text):
        end = word.end() + REACH  # a candidate begins before
        at = max(word.end(), seen)
        while m := CANDIDATE.search(text, at, end + 15):
            a, b = CANDIDATE.match(text, m.start()).span()
            at = seen = b
            k = bisect.bisect_left(taken, (b,)) - 1
            if k >= 0 and taken[k][1] > a:
                continue
            around = text[max(0, a - AROUND) : a] + " " + text[b : b + AROUND]
            if novelty.marginal(text[a:b], around) >= least * (b - a):
                out.append((a, 3, b))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan(docs: DataFrame, least: float = NOVELTY) -> DataFrame:
    """The contract's row for each document, and ``n_novel``."""
    ship_code(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        for batch in batches:
            for a, b in blocks(batch.column(1)):
                rows = []
                for text in batch.column(1).slice(a, b - a).to_pylist():
                    base = base_spans(text) if text else []
                    more = novel_spans(text, base, novelty, least) if text else []
                    kinds = [k for _, k, _ in base]
                    digest = hashlib.sha256(joined(base).encode()).hexdigest()
                    rows.append((kinds.count(0), kinds.count(1), kinds.count(2), digest, joined(base + more), len(more)))
                columns = list(zip(*rows, strict=True))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *arrays], names)

    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_novel bigint"
    return docs.select("doc_id", "text").mapInArrow(run, fields)
