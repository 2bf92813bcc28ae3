"""Op 6: find secrets, and confirm candidates by their structure.

Base spans, leftmost and non-overlapping for each kind: ``assign``, ``access`` and ``hex`` (the
patterns below). The method adds spans of encoded keys, which it reports only after decoding:

* ``pem``: a private-key block whose base64 body is one of the private keys below, after header
  lines or none;
* ``der``: base64 or hex that decodes to a private key (public keys are no secret);
* ``jwt``: a signed token whose first part is a JSON header with ``alg`` and whose second is JSON.

Private keys are a DER sequence that begins with a small version number and nests without a gap;
a DER sequence of a password-based algorithm and an octet string (EncryptedPrivateKeyInfo); and
``openssh-key-v1``, whose length-prefixed fields fill the data. The body of a block with
``Proc-Type: 4,ENCRYPTED`` is bare ciphertext; it is confirmed by its ``DEK-Info`` header: a known
cipher, an initial vector of that cipher's block, and a body of whole blocks.

All patterns run in time linear in the text. Defined cases: null or empty text has no spans; a
candidate that fails is dropped and not tried again from within; ids may be null or repeat, each
row is scanned; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklog.llm.common import table

KINDS = ["assign", "access", "hex", "pem", "der", "jwt"]
_ASSIGN = re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY)-----\s*+((?:[A-Za-z-]{1,40}:[^\r\n]*+\s++)*+)([A-Za-z0-9+/=\s]*+)-----END \1-----", re.ASCII)
#: Block bytes of the ciphers that the old encrypted form names.
_CIPHER_BLOCKS = {"DES-CBC": 8, "DES-EDE3-CBC": 8, "AES-128-CBC": 16, "AES-192-CBC": 16, "AES-256-CBC": 16}
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}+={0,2}")
_ANY_HEX = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{64,}+|[0-9A-F]{64,}+)(?![0-9A-Za-z])")
#: Algorithms that encrypt by a password: PKCS 5, then PKCS 12.
_BY_PASSWORD = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
_OPENSSH = b"openssh-key-v1\0"
_JWT = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]*+)\.([A-Za-z0-9_-]++)\.([A-Za-z0-9_-]*+)")


def decode64(text: str) -> bytes | None:
    text = re.sub(r"\s", "", text).rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_values(data: bytes, depth: int = 0) -> list[tuple[int, bytes]] | None:
    """The values that fill data exactly, containers checked to a depth of 8; None if they don't."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size >= 128:
            n = size - 128
            if not 1 <= n <= 4 or at + n > len(data):
                return None
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
        if at + size > len(data):
            return None
        body = data[at : at + size]
        if tag & 0x20 and depth < 8 and der_values(body, depth + 1) is None:
            return None
        out.append((tag, body))
        at += size
    return out


def is_der_key(data: bytes | None) -> bool:
    """One sequence that begins with the version of a private-key structure."""
    top = der_values(data) if data else None
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    parts = der_values(top[0][1]) or []
    return len(parts) >= 3 and parts[0][0] == 2 and parts[0][1] in (b"\0", b"\1") and parts[1][0] in (0x02, 0x04, 0x30)


def is_encrypted_key(data: bytes | None) -> bool:
    """One sequence of a password-based algorithm with parameters and an octet string."""
    top = der_values(data) if data else None
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    parts = der_values(top[0][1]) or []
    if [tag for tag, _ in parts] != [0x30, 0x04] or not parts[1][1]:
        return False
    algorithm = der_values(parts[0][1]) or []
    return [tag for tag, _ in algorithm] == [0x06, 0x30] and algorithm[0][1].startswith(_BY_PASSWORD)


def ssh_fields(data: bytes, at: int = 0, most: int | None = None) -> tuple[list[bytes], int] | None:
    """Length-prefixed fields from ``at`` on, all or at most so many, and where they end."""
    fields: list[bytes] = []
    while at < len(data) and len(fields) != most:
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return None
        fields.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return fields, at


def is_ssh_key(data: bytes | None) -> bool:
    """Length-prefixed fields that fill data, the first naming a key type."""
    found = ssh_fields(data) if data else None
    return found is not None and len(found[0]) >= 2 and re.match(rb"(ssh|ecdsa|sk)-", found[0][0]) is not None


def is_openssh_key(data: bytes | None) -> bool:
    """The magic, cipher, kdf and its options, a count, as many public keys, and the private part."""
    if not data or not data.startswith(_OPENSSH):
        return False
    names = ssh_fields(data, len(_OPENSSH), 3)
    if names is None or len(names[0]) != 3 or names[1] + 4 > len(data):
        return False
    (cipher, kdf, _), at = names
    count = int.from_bytes(data[at : at + 4], "big")
    keys = ssh_fields(data, at + 4, count + 1)
    if count < 1 or keys is None or len(keys[0]) != count + 1 or not all(map(is_ssh_key, keys[0][:-1])):
        return False
    private, rest = keys[0][-1], len(data) - keys[1]
    if cipher == b"none":  # two equal numbers tell that it is decrypted
        return kdf == b"none" and rest == 0 and len(private) >= 8 and private[:4] == private[4:8]
    sealed = b"gcm" in cipher or b"poly1305" in cipher  # their tag follows the last field
    return bool(cipher) and kdf != b"none" and len(private) >= 8 and rest == (16 if sealed else 0)


def is_private_key(data: bytes | None) -> bool:
    return is_der_key(data) or is_encrypted_key(data) or is_openssh_key(data)


def is_key_block(headers: str, body: str) -> bool:
    """A PEM block: a private key, or whole cipher blocks under headers that say so."""
    data = decode64(body)
    if not re.search(r"(?m)^Proc-Type:\s*4,\s*ENCRYPTED\s*$", headers):
        return is_private_key(data)
    info = re.search(r"(?m)^DEK-Info:\s*([A-Z0-9-]+),([0-9A-Fa-f]+)\s*$", headers)
    size = _CIPHER_BLOCKS.get(info[1]) if info else None
    return bool(size and data) and len(info[2]) == 2 * size and len(data) % size == 0


def is_signed_token(header: str, payload: str) -> bool:
    try:
        head, body = json.loads(decode64(header) or b""), json.loads(decode64(payload) or b"")
    except ValueError:
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind as listed."""
    found = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    if "PRIVATE KEY-----" in text:
        found += [("pem", *m.span()) for m in _PEM.finditer(text) if is_key_block(m[2], m[3])]
    found += [("der", *m.span()) for m in _BASE64.finditer(text) if is_private_key(decode64(m[0]))]
    found += [("der", *m.span()) for m in _ANY_HEX.finditer(text) if len(m[0]) % 2 == 0 and is_private_key(bytes.fromhex(m[0]))]
    if "eyJ" in text:
        found += [("jwt", *m.span()) for m in _JWT.finditer(text) if is_signed_token(m[1], m[2])]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        spans = [
            [{"kind": k, "start": a, "end": b} for k, a, b in find_secrets(t.as_py() or "")] for t in batch.column(1)
        ]
        yield pa.record_batch([batch.column(0), pa.array(spans, kind)], names=["id", "secrets"])


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and secrets, the (kind, start, end) of each span, for every row."""
    source = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    id_type = source.schema["id"].dataType.simpleString()
    out = source.mapInArrow(_scan, f"id {id_type}, secrets array<struct<kind:string,start:long,end:long>>")
    return out.withColumnRenamed("id", key)


def op6_structural_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("secrets", lambda x: x["kind"].isin(KINDS[:3]))
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("secrets", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", *map(count, KINDS[:3]), F.sha2(joined(base), 256).alias("base_sha256"), joined("secrets").alias("spans")
    )
