"""Node keys: hex public keys to base58check and back. A 33-byte number needs big integers, so these are pandas UDFs."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, functions as F

#: The ledger's base58 alphabet and the prefix byte of node public keys.
ALPHABET = "rpshnaf39wBUDNEGHJKLM4PQRST7VWXYZ2bcdeCg65jkm8oFqi1tuvAxyz"
NODE_PUBLIC = 0x1C


def encode_node_key(hex_key: str | None) -> str | None:
    """base58check of a 33-byte key; null if it is no such key."""
    try:
        key = bytes.fromhex(hex_key or "")
    except ValueError:
        return None
    if len(key) != 33:
        return None
    data = bytes([NODE_PUBLIC]) + key
    data += hashlib.sha256(hashlib.sha256(data).digest()).digest()[:4]
    n, out = int.from_bytes(data, "big"), ""
    while n:
        n, k = divmod(n, 58)
        out = ALPHABET[k] + out
    return ALPHABET[0] * (len(data) - len(data.lstrip(b"\0"))) + out


def decode_node_key(text: str | None) -> str | None:
    """The hex key of a base58check node key, null if its checksum or prefix is wrong."""
    if not text or any(c not in ALPHABET for c in text):
        return None
    n = 0
    for c in text:
        n = n * 58 + ALPHABET.index(c)
    if n >= 1 << (8 * 38):
        return None
    data = n.to_bytes(38, "big")
    good = hashlib.sha256(hashlib.sha256(data[:34]).digest()).digest()[:4] == data[34:] and data[0] == NODE_PUBLIC
    return data[1:34].hex().upper() if good else None


def node_key(column: str) -> Column:
    return F.pandas_udf(lambda keys: keys.map(encode_node_key), "string", F.PandasUDFType.SCALAR)(column)


def node_hex(column: str) -> Column:
    return F.pandas_udf(lambda keys: keys.map(decode_node_key), "string", F.PandasUDFType.SCALAR)(column)
