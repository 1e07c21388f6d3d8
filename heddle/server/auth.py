"""Token verification (HS, RS and ES families) and identities, on the standard library only."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import re
import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from heddle.plans.policy import AccessError, Identity, claim

#: Prefixes of DigestInfo for the hashes in RSA signatures (PKCS #1), fixed values.
DIGEST_INFO = {
    "256": bytes.fromhex("3031300d060960864801650304020105000420"),
    "384": bytes.fromhex("3041300d060960864801650304020205000430"),
    "512": bytes.fromhex("3051300d060960864801650304020305000440"),
}
#: Public parameters of the NIST curves (p, order, x, y of the base point), fixed values; b follows from the base point.
CURVES = {
    "256": (
        0xFFFFFFFF00000001000000000000000000000000FFFFFFFFFFFFFFFFFFFFFFFF,
        0xFFFFFFFF00000000FFFFFFFFFFFFFFFFBCE6FAADA7179E84F3B9CAC2FC632551, 0x6B17D1F2E12C4247F8BCE6E563A440F277037D812DEB33A0F4A13945D898C296,
        0x4FE342E2FE1A7F9B8EE7EB4A7C0F9E162BCE33576B315ECECBB6406837BF51F5,
    ),
    "384": (
        0xFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFEFFFFFFFF0000000000000000FFFFFFFF,
        0xFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFC7634D81F4372DDF581A0DB248B0A77AECEC196ACCC52973,
        0xAA87CA22BE8B05378EB1C71EF320AD746E1D3B628BA79B9859F741E082542A385502F25DBF55296C3A545E3872760AB7,
        0x3617DE4A96262C6F5D9E98BF9292DC29F8F41DBD289A147CE9DA3113B5F0B8C00A60B1CE1D7E819D7A431D7C90EA0E5F,
    ),
    "512": (
        (1 << 521) - 1,
        0x01FFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFA51868783BF2F966B7FCC0148F709A5D03BB5C9B8899C47AEBB6FB71E91386409,
        0x00C6858E06B70404E9CD9E3ECB662395B4429C648139053FB521F828AF606B4D3DBAA14B5E77EFE75928FE1DC127A2FFA8DE3348B3C1856A429BF97E7E31C2E5BD66,
        0x011839296A789A3BC0045C8A5FB42C7D1BD998F54449579B446817AFBD17273E662C97EE72995EF42640C550B9013FAD0761353C7086A272C24088BE94769FD16650,
    ),
}


class AuthError(Exception):
    def __init__(self, status: int, message: str):
        super().__init__(message)
        self.status = status


def b64(data: bytes) -> str:
    return base64.urlsafe_b64encode(data).decode().rstrip("=")


def unb64(text: str) -> bytes:
    return base64.urlsafe_b64decode(text + "=" * (-len(text) % 4))


def _der(data: bytes, at: int = 0) -> tuple[int, bytes, int]:
    """Tag, content and end of one DER element."""
    tag, n, at = data[at], data[at + 1], at + 2
    if n & 0x80:
        k = n & 0x7F
        n, at = int.from_bytes(data[at : at + k]), at + k
    return tag, data[at : at + n], at + n


def _items(data: bytes) -> list[tuple[int, bytes]]:
    out, at = [], 0
    while at < len(data):
        tag, content, at = _der(data, at)
        out.append((tag, content))
    return out


def load_key(pem: str) -> tuple[str, tuple]:
    """("RSA", (n, e)) or ("EC", (bits, x, y)) of a PEM public key."""
    m = re.search(r"-----BEGIN (RSA )?PUBLIC KEY-----(.*?)-----END", pem, re.S)
    if not m:
        raise ValueError("the key file holds no PEM public key")
    _, body, _ = _der(base64.b64decode("".join(m[2].split())))
    if not m[1]:
        (_, algorithm), (_, bits) = _items(body)
        oid = _items(algorithm)[0][1].hex()
        if oid == "2a8648ce3d0201":
            point = bits[1:]
            if point[0] != 4:
                raise ValueError("only uncompressed EC points are supported")
            half = (len(point) - 1) // 2
            size = {32: "256", 48: "384", 66: "512"}[half]
            return "EC", (size, int.from_bytes(point[1 : 1 + half]), int.from_bytes(point[1 + half :]))
        body = _der(bits[1:])[1]
    n, e = (int.from_bytes(c) for _, c in _items(body)[:2])
    return "RSA", (n, e)


def _rsa(key: tuple, bits: str, message: bytes, signature: bytes) -> bool:
    n, e = key
    size = (n.bit_length() + 7) // 8
    if len(signature) != size:
        return False
    digest = DIGEST_INFO[bits] + hashlib.new(f"sha{bits}", message).digest()
    want = b"\0\1" + b"\xff" * (size - len(digest) - 3) + b"\0" + digest
    return hmac.compare_digest(pow(int.from_bytes(signature), e, n).to_bytes(size), want)


def _ec(key: tuple, bits: str, message: bytes, signature: bytes) -> bool:
    own, x, y = key
    if own != bits:
        return False
    p, order, gx, gy = CURVES[bits]
    b = (gy * gy - gx * gx * gx + 3 * gx) % p
    if (y * y - (x * x * x - 3 * x + b)) % p:
        return False
    half = (order.bit_length() + 7) // 8
    r, s = int.from_bytes(signature[:half]), int.from_bytes(signature[half:])
    if len(signature) != 2 * half or not (0 < r < order and 0 < s < order):
        return False

    def add(u, v):
        if u is None or v is None:
            return u or v
        if u[0] == v[0]:
            if (u[1] + v[1]) % p == 0:
                return None
            k = (3 * u[0] * u[0] - 3) * pow(2 * u[1], -1, p) % p
        else:
            k = (v[1] - u[1]) * pow(v[0] - u[0], -1, p) % p
        at = (k * k - u[0] - v[0]) % p
        return at, (k * (u[0] - at) - u[1]) % p

    def times(k, u):
        out = None
        while k:
            if k & 1:
                out = add(out, u)
            u, k = add(u, u), k >> 1
        return out

    digest = hashlib.new(f"sha{bits}", message).digest()
    z = int.from_bytes(digest) >> max(0, 8 * len(digest) - order.bit_length())
    w = pow(s, -1, order)
    point = add(times(z * w % order, (gx, gy)), times(r * w % order, (x, y)))
    return point is not None and point[0] % order == r


@dataclass
class Verifier:
    """Checks tokens of exactly one algorithm."""

    algorithm: str
    secret: str = ""
    public_key: str = ""
    issuer: str = ""
    audience: str = ""
    leeway: int = 0

    def __post_init__(self):
        self.family, self.bits = self.algorithm[:2], self.algorithm[2:]
        if self.family != "HS":
            kind, self.key = load_key(self.public_key)
            if kind != {"RS": "RSA", "ES": "EC"}[self.family]:
                raise ValueError(f"{self.algorithm} needs another kind of key than {kind}")

    def claims(self, token: str) -> dict[str, Any]:
        try:
            head, body, tail = token.split(".")
            header, claims, signature = json.loads(unb64(head)), json.loads(unb64(body)), unb64(tail)
            message = f"{head}.{body}".encode()
            if header.get("alg") != self.algorithm or not isinstance(claims, dict):
                raise ValueError
            if self.family == "HS":
                good = hmac.compare_digest(hmac.new(self.secret.encode(), message, f"sha{self.bits}").digest(), signature)
            else:
                good = (_rsa if self.family == "RS" else _ec)(self.key, self.bits, message, signature)
            now = time.time()
            if not good or now > float(claims["exp"]) + self.leeway or now < float(claims.get("nbf", 0)) - self.leeway:
                raise ValueError
            if self.issuer and claims.get("iss") != self.issuer:
                raise ValueError
            audience = claims.get("aud")
            if self.audience and self.audience not in (audience if isinstance(audience, list) else [audience]):
                raise ValueError
        except Exception:
            raise AuthError(401, "invalid token") from None
        return claims


def sign(claims: dict[str, Any], algorithm: str, secret: str, ttl: int = 86400, issuer: str = "", audience: str = "") -> str:
    """A token for development, of the HS family only."""
    if not algorithm.startswith("HS"):
        raise ValueError("only HS tokens can be signed here")
    now = int(time.time())
    claims = {"iat": now, "exp": now + ttl} | ({"iss": issuer} if issuer else {}) | ({"aud": audience} if audience else {}) | claims
    message = ".".join(b64(json.dumps(x, separators=(",", ":")).encode()) for x in ({"alg": algorithm, "typ": "JWT"}, claims))
    return f"{message}.{b64(hmac.new(secret.encode(), message.encode(), 'sha' + algorithm[2:]).digest())}"


@dataclass
class Identifier:
    """From an Authorization header to an identity. A resolver comes before a table, a table before the claim."""

    verifier: Verifier
    roles: set[str]
    role_claim: str = "role"
    anonymous: str = ""
    resolver: Callable[[dict[str, Any]], str] | None = None
    lookup: Callable[[dict[str, Any]], str | None] | None = None

    def identify(self, header: str | None) -> Identity:
        if not header:
            if not self.anonymous:
                raise AuthError(401, "a token is required")
            return Identity(self.anonymous, {})
        kind, _, token = header.partition(" ")
        if kind.lower() != "bearer" or not token.strip():
            raise AuthError(401, "malformed authorization header")
        claims = self.verifier.claims(token.strip())
        try:
            role = self.resolver(claims) if self.resolver else self.lookup(claims) if self.lookup else claim(claims, self.role_claim)
        except AccessError:
            role = None
        if not isinstance(role, str) or role not in self.roles:
            raise AuthError(403, "the token has no known role")
        return Identity(role, claims)


def table_lookup(rows: Callable[[], Any], id_claim: str, id_column: str, role_column: str, cache_seconds: float = 0) -> Callable[[dict[str, Any]], str | None]:
    """The role of a user in an identity table; remembered for a while if asked for."""
    from pyspark.sql import functions as F

    held: dict[Any, tuple[float, str | None]] = {}

    def find(claims: dict[str, Any]) -> str | None:
        user = claim(claims, id_claim)
        if isinstance(user, float) and user.is_integer():
            user = int(user)
        if not isinstance(user, int | str) or isinstance(user, bool):
            return None
        found = held.get(user)
        if found and found[0] > time.monotonic():
            return found[1]
        df = rows()
        row = df.where(F.col(f"`{id_column}`") == F.lit(user).try_cast(df.schema[id_column].dataType)).select(f"`{role_column}`").limit(1).first()
        role = row[0] if row else None
        if cache_seconds:
            if len(held) > 100_000:
                held.clear()
            held[user] = (time.monotonic() + cache_seconds, role)
        return role

    return find
