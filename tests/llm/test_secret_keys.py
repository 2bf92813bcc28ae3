"""Private keys that are not a versioned DER sequence, made by hand from their formats."""

from __future__ import annotations

import base64

import pytest

from sparklog.llm.secret_scan import find_secrets


def field(data):
    return len(data).to_bytes(4, "big") + data


def der(tag, *parts):
    body = b"".join(parts)
    size = bytes([len(body)]) if len(body) < 128 else b"\x82" + len(body).to_bytes(2, "big")
    return bytes([tag]) + size + body


PUBLIC = field(b"ssh-ed25519") + field(bytes(range(32)))
SECRET = b"\1\2\3\4" * 2 + PUBLIC + field(bytes(range(64))) + field(b"a@b") + b"\1\2\3\4"


def openssh(cipher=b"none", kdf=b"none", options=b"", private=SECRET, count=1, rest=b""):
    names = field(cipher) + field(kdf) + field(options)
    return b"openssh-key-v1\0" + names + count.to_bytes(4, "big") + field(PUBLIC) * count + field(private) + rest


def encrypted(oid, *, octets=bytes(range(200))):
    return der(0x30, der(0x30, der(0x06, bytes.fromhex(oid)), der(0x30, der(0x04, b"saltsalt"))), der(0x04, octets))


BCRYPT = field(b"salt" * 4) + (16).to_bytes(4, "big")
KEYS = {
    "openssh": ("OPENSSH PRIVATE KEY", openssh()),
    "openssh by password": ("OPENSSH PRIVATE KEY", openssh(b"aes256-ctr", b"bcrypt", BCRYPT, bytes(range(160)))),
    "openssh with a tag": ("OPENSSH PRIVATE KEY", openssh(b"aes256-gcm@openssh.com", b"bcrypt", BCRYPT, bytes(range(160)), rest=bytes(16))),
    "pkcs 5": ("ENCRYPTED PRIVATE KEY", encrypted("2a864886f70d01050d")),
    "pkcs 12": ("ENCRYPTED PRIVATE KEY", encrypted("2a864886f70d010c0103")),
}
OTHERS = {
    "a byte too many": ("OPENSSH PRIVATE KEY", openssh(rest=b"\0")),
    "a byte too few": ("OPENSSH PRIVATE KEY", openssh()[:-1]),
    "two keys told, one there": ("OPENSSH PRIVATE KEY", openssh().replace(b"\0\0\0\1" + field(PUBLIC), b"\0\0\0\2" + field(PUBLIC))),
    "unequal check numbers": ("OPENSSH PRIVATE KEY", openssh(private=b"\1" + SECRET[1:4] + b"\2" + SECRET[5:])),
    "a digest": ("ENCRYPTED PRIVATE KEY", encrypted("608648016503040201")),
    "no octets": ("ENCRYPTED PRIVATE KEY", encrypted("2a864886f70d01050d", octets=b"")),
}


def block(name, data):
    return f"-----BEGIN {name}-----\n{base64.encodebytes(data).decode()}-----END {name}-----"


@pytest.mark.parametrize("case", KEYS)
def test_private_keys_are_found(case):
    name, data = KEYS[case]
    pem = block(name, data)
    assert ("pem", 7, 7 + len(pem)) in find_secrets(f"a key: {pem} and more")
    one = base64.b64encode(data).decode()
    assert ("der", 2, 2 + len(one)) in find_secrets(f"x {one} y")
    assert ("der", 2, 2 + 2 * len(data)) in find_secrets(f"x {data.hex()} y")


@pytest.mark.parametrize("case", OTHERS)
def test_what_only_looks_alike_is_not(case):
    name, data = OTHERS[case]
    for text in (block(name, data), base64.b64encode(data).decode(), f"x {data.hex()} y"):
        assert not {"pem", "der"} & {kind for kind, _, _ in find_secrets(text)}
