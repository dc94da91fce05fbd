"""Secret scan: fixed patterns, and novelty measured by a primed compressor.

Beside three patterns (assignments, access keys, long hexadecimal runs) every long token with a word
of secrecy on either side is measured: how many bytes does zstandard need for it on top of the text
around it, when primed with a dictionary of identifiers? Random strings of the token's own length and
alphabet are measured in the same place. Names, paths and words are made of pieces and letters that
the compressor has seen and cost less than those; keys cost as much.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from rankloom.llm import common

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(
    r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 12, 18, 16

TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
SENSITIVE = re.compile(
    r"(?ai:pass|pwd|secret|token|api|key|auth|bearer|credential|private|signature|session|cookie|access|login|salt|seed)")
#: Code points on each side of a token that are its context: for the word of secrecy, and for the compressor.
NEAR, AROUND = 64, 256
#: A token is novel from this share of the bytes that random strings of its kind cost.
NOVELTY = 0.87
#: What follows token and random string while they are measured: sizes are whole bytes, the mean over these is finer.
TAILS = ("", "e", "7", "xQ", "t,", "0=k", " no", "Vb2_")
#: A token longer than this is measured with the first two only; its rounding matters less.
LONG = 64
CLASSES = (string.ascii_lowercase, string.ascii_uppercase, string.digits, "+/_=-")
#: Alphabets smaller than the classes their letters belong to.
NARROW = (string.digits, "0123456789abcdef", "0123456789ABCDEF", string.ascii_uppercase + "234567")
#: Ordinary text before every context, so that a short one has letters to learn from too.
GROUND = """The service reads its settings once and keeps them while it runs. Every request names the account it belongs to,
and the handler answers with a status and a short message. def load(path, default=None):
    with open(path) as handle:
        for line in handle:
            name, value = line.strip().split('=', 1)
            settings[name] = value or default
    return settings
# Dates, sizes and versions are written as 2024-05-17, 1048576 and 3.11.2; limits follow below.
"""

# Identifiers and phrases common in code and settings; they prime the compressor.
IDENTIFIERS = """
    import from return class public private static final void const function self this null true false none async await
    string integer boolean float double number object array list map dict set key value name type data index count size
    length width height color background margin padding font border display position absolute relative container header
    footer content button input label form submit request response status message error exception handler callback
    config configuration settings options default parameter argument environment development production staging test
    username password secret token session cookie authorization authentication bearer basic access refresh client server
    user account profile email address phone customer order product price quantity total invoice payment
    https http www com org net localhost example index html css js json xml yaml csv txt png jpg svg
    application javascript typescript python java kotlin scala rust golang node react angular spring django flask
    database connection driver postgres mysql sqlite redis mongo host port schema table column select insert update delete
    create drop alter where group having join inner outer left right order limit offset primary foreign
    version release build deploy docker container image kubernetes cluster namespace service ingress volume secret
    getElementById addEventListener createElement appendChild innerHTML textContent className setAttribute
    toString valueOf hashCode equals isEmpty containsKey getValue setValue getName setName getId setId
    camelCase snake_case kebab-case CONSTANT_NAME MAX_VALUE MIN_VALUE DEFAULT_TIMEOUT BASE_URL API_URL
    january february march april may june july august september october november december monday friday
    00000000 11111111 12345678 123456789 1234567890 abcdef 0123456789abcdef abcdefghijklmnopqrstuvwxyz
    ABCDEFGHIJKLMNOPQRSTUVWXYZ xxxxxxxx XXXXXXXX ======== -------- ________ changeme placeholder your_key_here
"""


@lru_cache(maxsize=1)
def prime() -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(" ".join(IDENTIFIERS.split()).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


@lru_cache(maxsize=1)
def compressor() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=19, dict_data=prime(), write_content_size=False, write_dict_id=False)


def alphabet(token: str) -> str:
    used = set(token)
    for narrow in NARROW:
        if used <= set(narrow):
            return narrow
    return "".join(c for c in CLASSES if used & set(c))


def novelty(around: str, token: str) -> float:
    """Compressed bytes that ``token`` adds to ``around``, over what random strings of its length and alphabet add."""
    head, draws, letters, size = (GROUND + around).encode(), random.Random(token), alphabet(token), compressor().compress
    own = rivals = 0
    for tail in TAILS if len(token) <= LONG else TAILS[:2]:
        before = len(size(head + tail.encode()))
        own += len(size(head + (token + tail).encode())) - before
        rivals += len(size(head + ("".join(draws.choices(letters, k=len(token))) + tail).encode())) - before
    return own / max(1, rivals)


def surrounding(text: str, start: int, end: int) -> str:
    """Text on both sides of a token, without further copies of it."""
    return (text[max(0, start - AROUND) : start] + text[end : end + AROUND]).replace(text[start:end], "")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, end, kind)`` of the three patterns, each kind without overlaps, failing matches dropped."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[1]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], s[2]))


def novel_spans(text: str, known: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Incompressible tokens in a sensitive context that no known span touches. ``known`` is in order of its starts."""
    found, nth, reach = [], 0, 0
    for match in TOKEN.finditer(text):
        start, end = match.span()
        while nth < len(known) and known[nth][0] < end:
            reach = max(reach, known[nth][1])
            nth += 1
        if reach > start:
            continue
        if not SENSITIVE.search(text, max(0, start - NEAR), start) and not SENSITIVE.search(text, end, end + NEAR):
            continue
        if novelty(surrounding(text, start, end), match[0]) >= NOVELTY:
            found.append((start, end, 3))
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def scanned(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, n_assign, n_access, n_hex, base_sha256, spans`` of every document; ends are exclusive code points.

    ``spans`` lists the base spans and the novel tokens that touch none of them. A null text reads as
    empty and has no span. Repeated rows are scanned once each, null keys pass. Other columns are not read.
    """
    docs = docs.select(key, "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in common.slices(batch, "text"):
                counts, digests, spans = ([], [], []), [], []
                for text in piece.column("text").to_pylist():
                    base = base_spans(text or "")
                    for kind in range(3):
                        counts[kind].append(sum(k == kind for _, _, k in base))
                    digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                    spans.append(joined(sorted(base + novel_spans(text or "", base), key=lambda s: (s[0], s[2]))))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(key), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                    [key, "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.mapInArrow(work, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_assign long, n_access long, n_hex long, "
                                 "base_sha256 string, spans string")


def redacted(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span replaced by ``mark``; overlapping spans become one. Null texts stay."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text in batch.column("text").to_pylist():
                base = base_spans(text or "")
                for start, end, _ in sorted(merged(base + novel_spans(text or "", base)), reverse=True):
                    text = text[:start] + mark + text[end:]
                texts.append(text)
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, "text", pa.array(texts, pa.string()))

    return docs.mapInArrow(work, docs.schema)


def merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    out: list[tuple[int, int, int]] = []
    for start, end, kind in sorted(spans):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]), out[-1][2])
        else:
            out.append((start, end, kind))
    return out
