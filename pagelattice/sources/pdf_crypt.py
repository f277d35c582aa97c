"""The standard security handler of PDF files: keys from passwords, RC4, and AES in cipher block chaining.

Deciphering AES works on all blocks of a text at once; tables are made by rule.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterable

import numpy as np

#: Fixed value: what fills passwords up to 32 bytes.
PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def _times(a: int, b: int) -> int:
    """The product in the field of 256 elements."""
    out = 0
    while b:
        out ^= a if b & 1 else 0
        a = a << 1 ^ (0x11B if a & 0x80 else 0)
        b >>= 1
    return out


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """Substitution, its inverse, and products with the numbers that mixing needs."""
    inverse = [0] * 256
    power, x = [], 1
    for _ in range(255):
        power.append(x)
        x = _times(x, 3)
    for k, v in enumerate(power):
        inverse[v] = power[-k % 255]
    box = np.zeros(256, np.uint8)
    for k, v in enumerate(inverse):
        wide = v | v << 8
        box[k] = (v ^ wide >> 4 ^ wide >> 5 ^ wide >> 6 ^ wide >> 7 ^ 0x63) & 255
    back = np.zeros(256, np.uint8)
    back[box] = np.arange(256)
    return box, back, {m: np.array([_times(k, m) for k in range(256)], np.uint8) for m in (2, 3, 9, 11, 13, 14)}


def _round_keys(key: bytes) -> np.ndarray:
    """16 bytes for each round and one more."""
    box = _tables()[0]
    n = len(key) // 4
    words = [np.frombuffer(key[4 * k : 4 * k + 4], np.uint8) for k in range(n)]
    step = 1
    for k in range(n, 4 * (n + 7)):
        w = words[-1]
        if k % n == 0:
            w = box[np.roll(w, -1)] ^ np.array([step, 0, 0, 0], np.uint8)
            step = _times(step, 2)
        elif n > 6 and k % n == 4:
            w = box[w]
        words.append(words[k - n] ^ w)
    return np.concatenate(words).reshape(-1, 16)


#: Where each byte of a block comes from when rows shift, and back.
_SHIFT = np.array([(k + 4 * (k % 4)) % 16 for k in range(16)])
_BACK = np.argsort(_SHIFT)


def aes_decipher(key: bytes, data: bytes, start: bytes | None = None, padded: bool = True) -> bytes:
    """Text of chained blocks; the first block is the start vector if none is given. A part of a block at the end is left out."""
    if start is None:
        start, data = data[:16], data[16:]
    n = len(data) // 16
    if len(start) < 16 or not n:
        return b""
    _, back, times = _tables()
    given = np.frombuffer(data, np.uint8, 16 * n).reshape(n, 16)
    keys = _round_keys(key)
    s = given ^ keys[-1]
    for i in range(len(keys) - 2, -1, -1):
        s = back[s[:, _BACK]] ^ keys[i]
        if i:
            c = s.reshape(n, 4, 4)
            s = (times[14][c] ^ times[11][np.roll(c, -1, 2)] ^ times[13][np.roll(c, -2, 2)] ^ times[9][np.roll(c, -3, 2)]).reshape(n, 16)
    before = np.concatenate((np.frombuffer(start, np.uint8, 16)[None], given[:-1]))
    out = (s ^ before).tobytes()
    return out[: -out[-1]] if padded and 0 < out[-1] <= 16 else out


@functools.cache
def _mixing() -> tuple[list[int], ...]:
    """For a byte at each of the four rows: what it adds to a column after substitution and mixing."""
    box, _, times = _tables()
    one, two, three = box.astype(int), times[2][box].astype(int), times[3][box].astype(int)
    rows = ((two, one, one, three), (three, two, one, one), (one, three, two, one), (one, one, three, two))
    return tuple((a << 24 | b << 16 | c << 8 | d).tolist() for a, b, c, d in rows)


def aes_encipher(key: bytes, data: bytes, start: bytes) -> bytes:
    """Chained blocks of a text of whole blocks (one after the other: each needs the one before)."""
    t0, t1, t2, t3 = _mixing()
    box = _tables()[0].tolist()
    keys = [[int.from_bytes(k[4 * c : 4 * c + 4].tobytes()) for c in range(4)] for k in _round_keys(key)]
    out, before = bytearray(), int.from_bytes(start)
    for i in range(0, len(data), 16):
        block = int.from_bytes(data[i : i + 16]) ^ before
        s = [(block >> 96 - 32 * c & 0xFFFFFFFF) ^ keys[0][c] for c in range(4)]
        for k in keys[1:-1]:
            s = [t0[s[c] >> 24] ^ t1[s[c - 3] >> 16 & 255] ^ t2[s[c - 2] >> 8 & 255] ^ t3[s[c - 1] & 255] ^ k[c] for c in range(4)]
        before = 0
        for c in range(4):
            w = box[s[c] >> 24] << 24 | box[s[c - 3] >> 16 & 255] << 16 | box[s[c - 2] >> 8 & 255] << 8 | box[s[c - 1] & 255]
            before = before << 32 | w ^ keys[-1][c]
        out += before.to_bytes(16)
    return bytes(out)


def rc4(key: bytes, data: bytes) -> bytes:
    """Enciphers and deciphers."""
    s, j = list(range(256)), 0
    for i in range(256):
        j = j + s[i] + key[i % len(key)] & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(len(data)), 0, 0
    for n, b in enumerate(data):
        i = i + 1 & 255
        j = j + s[i] & 255
        s[i], s[j] = s[j], s[i]
        out[n] = b ^ s[s[i] + s[j] & 255]
    return bytes(out)


def hash_6(password: bytes, salt: bytes, user: bytes) -> bytes:
    """The hardened hash of revision 6: at least 64 rounds, each by one of three hashes."""
    k, last, n = hashlib.sha256(password + salt + user).digest(), 0, 0
    while n < 64 or last > n - 32:
        e = aes_encipher(k[:16], (password + k + user) * 64, k[16:32])
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(e[:16]) % 3](e).digest()
        last, n = e[-1], n + 1
    return k[:32]


class Handler:
    """What deciphers the strings and streams of a file whose Encrypt dictionary is `d`; a password that doesn't fit gives a ValueError."""

    def __init__(self, d: dict, first_id: bytes, passwords: Iterable[str], get: Callable):
        number = lambda k, otherwise: int(v) if isinstance(v := get(d.get(k)), (int, float)) else otherwise
        if get(d.get("Filter")) not in (None, "Standard"):
            raise ValueError(f"encrypted: unknown handler {get(d.get('Filter'))}")
        self.version, self.revision = number("V", 0), number("R", 2)
        if self.version not in (1, 2, 4, 5):
            raise ValueError(f"encrypted: unknown version {self.version}")
        self.owner, self.user = (bytes(get(d.get(k)) or b"") for k in ("O", "U"))
        self.owner_key, self.user_key = (bytes(get(d.get(k)) or b"") for k in ("OE", "UE"))
        self.rights = (number("P", 0) & 0xFFFFFFFF).to_bytes(4, "little")
        self.id = first_id
        self.open_metadata = get(d.get("EncryptMetadata")) is False
        self.size = 5 if self.version == 1 else 16 if self.version == 4 else 32 if self.version == 5 else max(5, number("Length", 40) // 8)
        filters = get(d.get("CF")) or {}
        method = lambda k: (get((get(filters.get(name)) or {}).get("CFM")) if (name := get(d.get(k)) or "Identity") != "Identity" else "None")
        self.strings, self.streams = (method("StrF"), method("StmF")) if self.version >= 4 else ("V2", "V2")
        found = next((k for p in passwords if (k := self._key(p)) is not None), None)
        if found is None:
            raise ValueError("encrypted: no password given fits")
        self.key = found

    def _key(self, password: str) -> bytes | None:
        if self.version == 5:
            p = password.encode()[:127]
            digest = hash_6 if self.revision >= 6 else lambda *x: hashlib.sha256(b"".join(x)).digest()
            for known, sealed, user in ((self.user, self.user_key, b""), (self.owner, self.owner_key, self.user[:48])):
                if len(known) >= 48 and digest(p, known[32:40], user) == known[:32]:
                    return aes_decipher(digest(p, known[40:48], user), sealed[:32], bytes(16), padded=False)
            return None
        p = password.encode("latin-1", "replace")
        for one in (p, self._by_owner(p)):
            key = self._from_user(one)
            if self._fits(key):
                return key
        return None

    def _stretched(self, start: bytes) -> bytes:
        k = hashlib.md5(start).digest()
        for _ in range(50 if self.revision >= 3 else 0):
            k = hashlib.md5(k[: self.size]).digest()
        return k[: self.size]

    def _from_user(self, password: bytes) -> bytes:
        more = b"\xff" * 4 if self.revision >= 4 and self.open_metadata else b""
        return self._stretched((password + PAD)[:32] + self.owner[:32] + self.rights + self.id + more)

    def _by_owner(self, password: bytes) -> bytes:
        """The user's password, which the owner's opens."""
        k = hashlib.md5((password + PAD)[:32]).digest()
        for _ in range(50 if self.revision >= 3 else 0):
            k = hashlib.md5(k).digest()
        out = self.owner[:32]
        for step in range(19 if self.revision >= 3 else 0, -1, -1):
            out = rc4(bytes(b ^ step for b in k[: self.size]), out)
        return out

    def _fits(self, key: bytes) -> bool:
        if self.revision < 3:
            return rc4(key, PAD) == self.user[:32]
        out = hashlib.md5(PAD + self.id).digest()
        for step in range(20):
            out = rc4(bytes(b ^ step for b in key), out)
        return out == self.user[:16]

    def _deciphered(self, method: str | None, data: bytes, n: int, g: int) -> bytes:
        if method in ("None", None):
            return data
        if method == "AESV3":
            return aes_decipher(self.key, data)
        salted = self.key + n.to_bytes(4, "little")[:3] + g.to_bytes(4, "little")[:2] + (b"sAlT" if method == "AESV2" else b"")
        key = hashlib.md5(salted).digest()[: min(len(self.key) + 5, 16)]
        return aes_decipher(key, data) if method == "AESV2" else rc4(key, data)

    def value(self, v, n: int, g: int):
        """A value of object n, with its strings deciphered."""
        if isinstance(v, bytes):
            return self._deciphered(self.strings, v, n, g)
        if isinstance(v, dict):
            return {k: self.value(x, n, g) for k, x in v.items()}
        return [self.value(x, n, g) for x in v] if type(v) is list else v

    def body(self, d: dict, data: bytes, n: int, g: int) -> bytes:
        """The stream of object n."""
        if d.get("Type") == "XRef" or (d.get("Type") == "Metadata" and self.open_metadata):
            return data
        return self._deciphered(self.streams, data, n, g)
