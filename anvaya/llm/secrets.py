"""Secret scans with structural confirmation.

Three base kinds (assignments, access ids, hex runs) come from fixed patterns.
On top of them every base64 or hex candidate is decoded and its bytes are
parsed before anything is reported: DER key encodings with all nested lengths
consistent, length-prefixed private key containers, armoured blocks, and
signed-token headers that decode to a JSON object naming an algorithm.
Candidates are joined over line ends, as such or escaped, and decoded from each
of their first four characters, so that a key is found wherever it starts; where
it ends is told by its lengths. Decoded bytes are scanned in the same way.

Defined results: a null or empty text has no spans (the digest is that of the
empty string); texts are scanned whole whatever their length; spans of
different kinds may overlap, spans of one kind never do; ties in start go by kind in the
order of ``ORDER``; repeated rows repeat
their result; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in the order that breaks ties of equal starts.
BASE_KINDS = ("assign", "access", "hex")
ADDED_KINDS = ("armour", "key", "jwt")
ORDER = {kind: n for n, kind in enumerate(BASE_KINDS + ADDED_KINDS)}
#: The base patterns and their least lengths.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16
#: Every hex or base64 candidate lies in such a chain of runs over line ends, raw or escaped.
_B = r"[A-Za-z0-9+/_-]"
_END = r"(?:[\x20\t]*+(?:(?:\r\n?|\n|\\++(?:[rn]|u000[adAD]))[\x20\t]*+)++|\\++(?=/))"
CHAIN = re.compile(
    rf"{_B}{{32,}}+(?:{_END}{_B}++|[\x20\t]++{_B}{{32,}}+)*+(?:[\x20\t]++{_B}++)?+"
    rf"|{_B}{{4,}}+(?:{_END}{_B}++)++"
)
BREAK = re.compile(rf"{_END}|[\x20\t]+")
LEAST_RUN = 32
HEX_RUN = re.compile(r"[0-9a-fA-F]{32,}")
BEGIN = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----")
ESCAPED = re.compile(r"\\+(?:[rnt]|u000[adAD])")
DER_START = re.compile(
    rb"\x30(?:[\x16-\x7f]|\x81[\x80-\xff]|\x82[\x01-\xff].|\x83[\x01-\xff]..|\x84[\x01-\xff]...)(?=[\x02\x30])",
    re.DOTALL,
)
BOX = b"openssh-key-v1\0"
#: Parts of a signed token, joined by dots, and how an object starts at each offset of base64.
DOTTED = re.compile(r"[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]*+){2,}+")
OBJECT_START = re.compile(rb"[\x20\t\r\n]*+(\{)[\x20\t\r\n]*+\"")
_JSON = json.JSONDecoder()

Span = tuple[str, int, int]


def decode64(text: str) -> bytes | None:
    """Standard or URL-safe base64, padded or not; None if it is neither."""
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, from, to) of the values that fill ``data[start:end]`` exactly."""
    found = []
    while start < end:
        if start + 2 > end:
            return None
        tag, size = data[start], data[start + 1]
        start += 2
        if size & 0x80:
            width = size & 0x7F
            if not 1 <= width <= 4 or start + width > end:
                return None
            size = int.from_bytes(data[start : start + width], "big")
            start += width
            if size < 0x80 or (width > 1 and size >> (8 * (width - 1)) == 0):
                return None  # not the shortest form of the length
        if start + size > end:
            return None
        found.append((tag, start, start + size))
        start += size
    return found


def der_key(data: bytes) -> bool:
    """A private key: PKCS#1, PKCS#8, encrypted PKCS#8, DSA or SEC1 in DER."""
    outer = der_items(data, 0, len(data))
    if outer is None or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    parts = der_items(data, *outer[0][1:])
    if not parts:
        return False
    for tag, a, b in parts:
        if tag & 0x20 and der_items(data, a, b) is None:
            return False
        if tag == 0x02 and a == b:
            return False
    tags = [tag for tag, _, _ in parts]
    value = lambda n: data[parts[n][1] : parts[n][2]]
    if tags == [0x30, 0x04]:  # algorithm, then the encrypted key
        return _starts_with_oid(data, parts[0])
    if tags[0] != 0x02:
        return False
    if tags[1:3] == [0x30, 0x04] and value(0) in (b"\0", b"\1"):
        return _starts_with_oid(data, parts[1])
    if len(tags) > 1 and tags[1] == 0x04 and value(0) == b"\1":
        return 16 <= parts[1][2] - parts[1][1] <= 66
    return value(0) in (b"\0", b"\1") and len(tags) in (6, 9, 10) and set(tags[:6]) == {0x02}


def _starts_with_oid(data: bytes, part: tuple[int, int, int]) -> bool:
    inner = der_items(data, *part[1:])
    return bool(inner) and inner[0][0] == 0x06 and inner[0][1] < inner[0][2]


def box_end(data: bytes, start: int = 0) -> int:
    """Where a length-prefixed private key container ends, -1 if a nested length does not fit."""
    if not data.startswith(BOX, start):
        return -1
    at = start + len(BOX)

    def field(at: int) -> int:
        if at + 4 > len(data):
            return -1
        end = at + 4 + int.from_bytes(data[at : at + 4], "big")
        return end if end <= len(data) else -1

    for _ in range(3):  # cipher, key derivation, its options
        at = field(at)
        if at < 0:
            return -1
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if not 1 <= keys <= 16:
        return -1
    for _ in range(keys + 1):  # public parts, then the private block
        at = field(at)
        if at < 0:
            return -1
    return at


def boxed_key(data: bytes) -> bool:
    """A length-prefixed private key container: every nested length must fit."""
    return box_end(data) == len(data)


def is_key(data: bytes | None) -> bool:
    return data is not None and len(data) >= 24 and (der_key(data) or boxed_key(data))


def _object(data: bytes | None) -> dict | None:
    """The JSON object that the bytes are, white space around it aside."""
    try:
        found = json.loads(data or b"")
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def header_start(part: str) -> int:
    """Where in the last characters of a token's first part its header starts, -1 if nowhere.

    The header is a JSON object that ends with the part and names an algorithm. Other
    characters may be glued in front, so it is looked for at each offset of base64.
    """
    plain = part.replace("-", "+").replace("_", "/")
    for first in range(min(4, len(part))):
        body = plain[first:]
        if len(body) % 4 == 1:
            continue
        data = base64.b64decode(body + "=" * (-len(body) % 4))
        # The last object that reaches the end: of nested ones only the outermost is a header.
        tail = data.rstrip(b" \t\r\n")
        if not tail.endswith(b"}"):
            continue
        # Bytes 0, 3, 6 ... begin a character, and a header begins with one.
        for m in OBJECT_START.finditer(tail):
            start = -(-m.start() // 3) * 3
            if start > m.start(1):
                continue
            try:
                text = tail[m.start(1) :].decode()
                found, end = _JSON.raw_decode(text)
            except (ValueError, RecursionError):
                continue
            if end == len(text) and isinstance(found, dict) and isinstance(found.get("alg"), str):
                return first + start // 3 * 4
    return -1


def signed_tokens(text: str) -> list[Span]:
    """Signed tokens: header and payload are JSON objects, the header names an algorithm, the signature decodes."""
    found: list[Span] = []
    for m in DOTTED.finditer(text):
        parts = m[0].split(".")
        at = m.start()
        skip = 0  # parts that a token has used
        for k in range(len(parts) - 2):
            head, payload, signature = parts[k : k + 3]
            if not skip and head and payload and _object(decode64(payload)) is not None:
                start = header_start(head)
                if start >= 0 and _signed(head[start:], signature):
                    found.append(("jwt", at + start, at + len(head) + len(payload) + len(signature) + 2))
                    skip = 3
            skip = max(0, skip - 1)
            at += len(head) + 1
    return found


def _signed(head: str, signature: str) -> bool:
    algorithm = (_object(decode64(head)) or {}).get("alg")
    return isinstance(algorithm, str) and (algorithm.lower() == "none" or len(decode64(signature) or b"") >= 16)


def is_signed_token(text: str) -> bool:
    return any(a == 0 and b == len(text) for _, a, b in signed_tokens(text))


def base_spans(text: str) -> list[Span]:
    """The spans of the base kinds, sorted by start, then kind."""
    found: list[Span] = []
    low = text.lower()
    if any(word in low for word in ASSIGN_WORDS):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= ASSIGN_LEAST:
                found.append(("assign", m.start(), m.end()))
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= ACCESS_LEAST:
                found.append(("access", m.start(), m.end()))
    for m in HEX.finditer(text):
        found.append(("hex", m.start(), m.end()))
    return sorted(found, key=_rank)


def armour_spans(text: str) -> list[tuple[int, int]]:
    """Armoured private keys, their line ends as such, escaped or missing."""
    found: list[tuple[int, int]] = []
    ends: dict[str, int] = {}
    begins = list(BEGIN.finditer(text))
    for m, after in zip(begins, [*(x.start() for x in begins[1:]), len(text)]):
        close = f"-----END {m[1]}-----"
        if 0 <= ends.get(close, 0) < m.end():
            ends[close] = text.find(close, m.end())
        end = ends[close]
        if not 0 <= end < after:
            continue
        block = ESCAPED.sub("\n", text[m.end() : end])
        lines = re.sub(r"(?m)^[A-Za-z-]+:.*$", "", block)  # header lines of old armours
        data = decode64(re.sub(r"\s|\\+(?=/)", "", lines))
        if is_key(data) or ("ENCRYPTED" in block and data is not None and len(data) >= 32):
            found.append((m.start(), end + len(close)))
    return found


def byte_spans(data: bytes) -> list[Span]:
    """Keys and signed tokens in decoded bytes, themselves or encoded once more."""
    found: list[Span] = []
    at = 0
    while m := DER_START.search(data, at):
        start, width = m.start(), data[m.start() + 1]
        at = start + 1
        size = width if width < 0x80 else int.from_bytes(data[start + 2 : start + 2 + (width & 0x7F)], "big")
        end = start + 2 + (width & 0x7F if width & 0x80 else 0) + size
        if end <= len(data) and is_key(data[start:end]):
            found.append(("key", start, end))
            at = end
    at = data.find(BOX)
    while at >= 0:
        end = box_end(data, at)
        if end > 0:
            found.append(("key", at, end))
        at = data.find(BOX, max(end, at + 1))
    return found + [
        ("key" if kind == "armour" else kind, start, end)
        for kind, start, end in added_spans(data.decode("latin-1"))
    ]


def run_spans(body: str) -> list[Span]:
    """Keys and signed tokens that a run of base64 or hex characters encodes, wherever they start in it."""
    found: list[Span] = []
    plain = body.replace("-", "+").replace("_", "/")
    for first in range(4):
        part = plain[first:]
        part = part[:-1] if len(part) % 4 == 1 else part
        data = base64.b64decode(part + "=" * (-len(part) % 4))
        found += [(kind, first + a * 8 // 6, first + (b * 8 + 5) // 6) for kind, a, b in byte_spans(data)]
    for h in HEX_RUN.finditer(body):
        for first in range(2):
            size = (len(h[0]) - first) // 2 * 2
            data = bytes.fromhex(h[0][first : first + size])
            at = h.start() + first
            found += [(kind, at + 2 * a, at + 2 * b) for kind, a, b in byte_spans(data)]
    return found


def added_spans(text: str) -> list[Span]:
    """Spans that decode and parse as keys or signed tokens."""
    blocks = armour_spans(text) if "-----BEGIN" in text else []
    block_ends = [end for _, end in blocks]
    found: list[Span] = []
    for m in CHAIN.finditer(text):
        if m.end() - m.start() < LEAST_RUN:
            continue
        # Places of the joined characters in the text: starts in the body and in the text.
        pieces, at, size = [], m.start(), 0
        in_body, in_text = [], []
        for stop, after in [*(x.span() for x in BREAK.finditer(text, m.start(), m.end())), (m.end(), m.end())]:
            if stop > at:
                in_body.append(size)
                in_text.append(at)
                pieces.append(text[at:stop])
                size += stop - at
            at = after
        if size < LEAST_RUN:
            continue
        for kind, start, end in run_spans("".join(pieces)):
            a, b = (bisect.bisect_right(in_body, k) - 1 for k in (start, end - 1))
            start, end = in_text[a] + start - in_body[a], in_text[b] + end - in_body[b]
            end += len(text[end : end + 2]) - len(text[end : end + 2].lstrip("="))
            # Blocks do not overlap, so that only the one that ends next may be in the way.
            n = bisect.bisect_right(block_ends, start)
            if n == len(blocks) or blocks[n][0] >= end:
                found.append((kind, start, end))
    if "." in text:
        found += signed_tokens(text)
    return [("armour", *block) for block in blocks] + _united(found)


def scan_text(text: str) -> tuple[list[Span], list[Span]]:
    """The base and the added spans of a text."""
    return base_spans(text), added_spans(text)


def _united(spans: list[Span]) -> list[Span]:
    """Overlapping spans of one kind as one."""
    out: list[Span] = []
    for kind, start, end in sorted(spans):
        if out and out[-1][0] == kind and start < out[-1][2]:
            out[-1] = kind, out[-1][1], max(end, out[-1][2])
        else:
            out.append((kind, start, end))
    return out


def _rank(span: Span) -> tuple[int, int, int]:
    return span[1], ORDER[span[0]], span[2]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            counts: list[tuple[int, int, int, int]] = []
            digests, spans = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                base, added = scan_text(text)
                kinds = [kind for kind, _, _ in base]
                counts.append((*(kinds.count(k) for k in BASE_KINDS), len(added)))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(sorted(base + added, key=_rank)))
            numbers = [pa.array(c, pa.int64()) for c in zip(*counts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *numbers[:3], pa.array(digests, pa.string()),
                 pa.array(spans, pa.string()), numbers[3]],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans",
                       "n_added"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run,
        "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string,"
        " spans string, n_added long",
    )


def redacted(text: str, mask: str = "[SECRET]") -> str:
    """The text with every secret, base or added, replaced by ``mask``."""
    out, at = [], 0
    reach = -1
    for _, start, end in sorted(base_spans(text) + added_spans(text), key=_rank):
        if start >= reach:
            out += [text[at:start], mask]
        reach = at = max(reach, end)
    return "".join([*out, text[at:]]) if reach >= 0 else text


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with the secrets of ``text`` masked; rows and other columns stay."""

    @F.pandas_udf("string")
    def masked(texts):
        return texts.map(lambda t: t if t is None else redacted(t, mask))

    return docs.withColumn("text", masked("text"))
