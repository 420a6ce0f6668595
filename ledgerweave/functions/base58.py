"""Base58Check addresses to their 20-byte body in hex, as a pandas UDF over a small dimension."""

import hashlib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

ALPHABET = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def decode(text: str | None) -> str | None:
    """The 40 hex digits of a valid 25-byte address; null for anything else, a wrong checksum included."""
    n = 0
    for c in (text or "").strip():
        k = ALPHABET.find(c)
        if k < 0:
            return None
        n = n * 58 + k
    if not text or n >> 200:
        return None
    raw = n.to_bytes(25, "big")
    good = hashlib.sha256(hashlib.sha256(raw[:21]).digest()).digest()[:4] == raw[21:]
    return raw[1:21].hex() if good else None


def encode(body: str, prefix: int = 0x41) -> str:
    raw = bytes([prefix]) + bytes.fromhex(body)
    raw += hashlib.sha256(hashlib.sha256(raw).digest()).digest()[:4]
    n, out = int.from_bytes(raw, "big"), ""
    while n:
        n, r = divmod(n, 58)
        out = ALPHABET[r] + out
    return "1" * (len(raw) - len(raw.lstrip(b"\0"))) + out


@F.pandas_udf(StringType())
def body_hex(address: pd.Series) -> pd.Series:
    return address.map(decode)
