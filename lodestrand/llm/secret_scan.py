"""Secret scans: base patterns, and structural confirmation of encoded candidates.

Long runs of encoding characters are rare in prose, so one pass over the whole text finds them and everything else
looks at those runs only.  A base64 or hex candidate is reported when what it decodes to parses: nested DER lengths
that fit exactly (PKCS#1, DSA, PKCS#8, SEC 1 and encrypted PKCS#8 keys), an OpenSSH private key's length-prefixed fields,
or a signed token whose header is a JSON object with an algorithm.  A PEM block is reported when its body decodes to such
a key, or, where its header lines say that it is encrypted, when they name a cipher and a fitting vector and the body
has whole cipher blocks.  All searches take time in proportion to the text.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in their listed order: the base kinds, then the confirmed ones.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "pem", "der", "openssh", "signed")

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_WORDS = ("pass", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")

RUN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
BEGIN = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY)-----")
PEM_HEADER = re.compile(r"[A-Za-z][A-Za-z0-9-]*:")
CIPHER = re.compile(r"DEK-Info:[ \t]*(DES|AES|[A-Z0-9]+)[A-Z0-9-]*,([0-9A-Fa-f]+)\s*$")
CODED = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
HEX_CODED = re.compile(r"(?:[0-9a-fA-F]{2}){32,}")
DOTTED = re.compile(r"[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]*){2,}")
OPENSSH_MAGIC = b"openssh-key-v1\0"
#: Object identifiers that open a PKCS#8 algorithm field: RSA, EC, Ed25519, Ed448, X25519, DSA, and PBES2.
KEY_OIDS = tuple(bytes.fromhex(x) for x in ("2a864886f70d010101", "2a8648ce3d0201", "2b6570", "2b6571", "2b656e", "2a8648ce380401", "2a864886f70d01050d"))


def der_items(data: bytes, depth: int = 0) -> list[tuple[int, bytes]] | None:
    """Tag and content of each element when the lengths fill ``data`` exactly and nest exactly; else None."""
    items, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, n, at = data[at], data[at + 1], at + 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > len(data):
                return None
            n, at = int.from_bytes(data[at : at + k], "big"), at + k
            if n < 0x80:
                return None
        if at + n > len(data):
            return None
        body, at = data[at : at + n], at + n
        if tag & 0x20 and (depth > 8 or der_items(body, depth + 1) is None):
            return None
        items.append((tag, body))
    return items


def is_der_key(data: bytes) -> bool:
    """A DER sequence that is laid out like a private key."""
    outer = der_items(data) if data[:1] == b"\x30" else None
    if not outer or len(outer) != 1:
        return False
    items = der_items(outer[0][1]) or []
    tags = [t for t, _ in items]
    if tags[:1] == [0x02] and len(items[0][1]) == 1 and items[0][1][0] <= 1:
        if len(tags) >= 9 and tags[:9] == [0x02] * 9:  # PKCS#1
            return True
        if tags == [0x02] * 6 and len(items[1][1]) >= 64:  # DSA
            return True
        if tags[1:2] == [0x04] and len(items[1][1]) >= 20:  # SEC 1
            return True
        if tags[1:3] == [0x30, 0x04]:  # PKCS#8
            return any(t == 0x06 and b in KEY_OIDS for t, b in der_items(items[1][1]) or [])
    if tags == [0x30, 0x04]:  # encrypted PKCS#8
        return any(t == 0x06 and b in KEY_OIDS for t, b in der_items(items[0][1]) or [])
    return False


def is_openssh_key(data: bytes) -> bool:
    if not data.startswith(OPENSSH_MAGIC):
        return False
    at = len(OPENSSH_MAGIC)
    for field in range(3):  # cipher, key derivation, its options
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data) or field < 2 and not n:
            return False
        at += 4 + n
    return at + 4 <= len(data) and 1 <= int.from_bytes(data[at : at + 4], "big") <= 64


def decoded(text: str) -> bytes:
    """Base64 of either alphabet, padding optional; empty when it is none."""
    text = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def is_signed_header(text: str) -> bool:
    try:
        header = json.loads(decoded(text))
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str)


def key_kind(data: bytes) -> str | None:
    return "openssh" if is_openssh_key(data) else "der" if is_der_key(data) else None


def is_pem_body(body: str) -> bool:
    """What stands between the two lines of a PEM block is a private key."""
    lines = body.split("\n")
    at = next((i for i, x in enumerate(lines) if x.strip()), len(lines))
    headers = []
    while at < len(lines) and PEM_HEADER.match(x := lines[at].strip()):
        headers.append(x)
        at += 1
    data = decoded("".join("".join(lines[at:]).split()))
    if any(h.startswith("Proc-Type:") and h.endswith("ENCRYPTED") for h in headers):
        cipher = next((m for h in headers if (m := CIPHER.match(h))), None)
        block = 16 if cipher and cipher[1] == "AES" else 8
        return bool(cipher) and len(cipher[2]) == 2 * block and len(data) >= 4 * block and len(data) % block == 0
    return key_kind(data) is not None


def pem_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    for m in BEGIN.finditer(text):
        end, last = text.find("-----", m.end()), f"-----END {m[1]}-----"  # the body holds no dashes in a row
        if end >= 0 and text.startswith(last, end) and is_pem_body(text[m.end() : end]):
            out.append((m.start(), end + len(last), "pem"))
    return out


def signed_spans(run: str) -> list[tuple[int, int, str]]:
    """Three dotted parts of which the first is a header; labels may stand before it, with dots of their own."""
    out = []
    for m in DOTTED.finditer(run):
        parts, at, i = m[0].split("."), m.start(), 0
        while i + 2 < len(parts):
            if len(parts[i]) >= 8 and len(parts[i + 1]) >= 2 and is_signed_header(parts[i]):
                size = sum(map(len, parts[i : i + 3])) + 2
                out.append((at, at + size, "signed"))
                at, i = at + size + 1, i + 3
            else:
                at, i = at + len(parts[i]) + 1, i + 1
    return out


def find_spans(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every finding in the whole text, by start and then by kind; code points, end exclusive."""
    text = text or ""
    spans = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        spans += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    for run in RUN.finditer(text):
        a, s = run.start(), run[0]
        spans += [(a + m.start(), a + m.end(), "access") for m in ACCESS.finditer(s) if len(m[0]) >= 18]
        spans += [(a + m.start(), a + m.end(), "hex") for m in HEX.finditer(s) if len(m[0]) >= 16]
        spans += [(a + m.start(), a + m.end(), kind) for m in CODED.finditer(s) if (kind := key_kind(decoded(m[0])))]
        spans += [(a + m.start(), a + m.end(), kind) for m in HEX_CODED.finditer(s) if (kind := key_kind(bytes.fromhex(m[0])))]
        if s.count(".") >= 2:
            spans += [(a + i, a + j, kind) for i, j, kind in signed_spans(s)]
    if "-----BEGIN " in text:
        spans += pem_spans(text)
    return sorted(set(spans), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def redacted(text: str | None, spans: list[tuple[int, int, str]], mask: str = "[SECRET]") -> str | None:
    """The text with each finding, or run of overlapping findings, replaced by the mask."""
    if not spans:
        return text
    out, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join(out) + text[at:]


SCAN_COLUMNS = "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Whole texts are scanned, in a single pass without any shuffle.  Null and empty texts have no findings, and the
    digest of the empty string.  Very long texts, white space and unfinished blocks cost time in proportion to their
    length.  Ids may be null or repeat, and repeated rows each have a row.  No rows give no rows; further columns are
    ignored.
    """
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [find_spans(t.as_py()) for t in b.column("text")]
            base = [[s for s in spans if s[2] in BASE_KINDS] for spans in found]
            out = {"doc_id": b.column("doc_id")}
            out |= {f"n_{k}": pa.array([sum(s[2] == k for s in spans) for spans in base], pa.int64()) for k in BASE_KINDS}
            out |= {"base_sha256": pa.array([hashlib.sha256(joined(s).encode()).hexdigest() for s in base], pa.string())}
            out |= {"spans": pa.array([joined(s) for s in found], pa.string())}
            yield pa.RecordBatch.from_pydict(out)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, {SCAN_COLUMNS}")


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """``docs`` with every finding masked; rows without findings are returned as they are, and all rows stay.

    ``length_col`` is set to the new length where a text changed.  All other columns pass through untouched.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(text_col).to_pylist()
            spans = [find_spans(t) for t in texts]
            if any(spans):
                texts = [redacted(t, s) for t, s in zip(texts, spans)]
                b = b.set_column(b.schema.get_field_index(text_col), text_col, pa.array(texts, b.schema.field(text_col).type))
                if length_col:
                    i = b.schema.get_field_index(length_col)
                    sizes = [len(t) if s else n for t, s, n in zip(texts, spans, b.column(i).to_pylist())]
                    b = b.set_column(i, length_col, pa.array(sizes, b.schema.field(i).type))
            yield b

    return docs.mapInArrow(run, docs.schema)
