"""Sample root fields: sign up and sign in against an identity table, passwords hashed with scrypt."""

from __future__ import annotations

import base64
import hashlib
import hmac
import os

from pyspark.sql import functions as F

from heddle.functions.scalars import InputError
from heddle.plans.executor import Context
from heddle.plans.registry import CustomField, Registry
from heddle.server.auth import sign

COST = {"n": 2**14, "r": 8, "p": 1}


def hashed(password: str, salt: bytes | None = None) -> str:
    salt = salt or os.urandom(16)
    return "scrypt$" + "$".join(base64.b64encode(x).decode() for x in (salt, hashlib.scrypt(password.encode(), salt=salt, **COST)))


def matches(password: str, stored: str) -> bool:
    try:
        kind, salt, _ = stored.split("$")
        return kind == "scrypt" and hmac.compare_digest(hashed(password, base64.b64decode(salt)), stored)
    except (ValueError, TypeError):
        return False


def register(registry: Registry, algorithm: str, secret: str, table: str = "users", role: str = "author", ttl: int = 86400) -> None:
    """Add the mutations signup(username, password) and signin(username, password); both give a token."""

    def found(context: Context, username: str):
        return context.reader.tables(table).where(F.col("username") == username).limit(1).first()

    def token(user: int) -> dict[str, str]:
        return {"token": sign({"sub": user}, algorithm, secret, ttl)}

    def signup(context: Context, username: str, password: str) -> dict[str, str]:
        if not username or len(password) < 8:
            raise InputError("a username and a password of 8 characters are needed")
        store = context.writer.store
        with store.lock(table):
            if found(context, username):
                raise InputError("the username is taken")
            rows = store(table)
            user = (rows.agg(F.max("id")).first()[0] or 0) + 1
            known = {"id": user, "username": username, "password": hashed(password), "role": role}
            made = store.spark.createDataFrame([tuple(known.get(f.name) for f in rows.schema.fields)], rows.schema)
            store.commit(table, rows.schema, store.files(table) + store.files_of(made, table))
        return token(user)

    def signin(context: Context, username: str, password: str) -> dict[str, str]:
        row = found(context, username)
        if not row or not matches(password, row["password"]):
            raise InputError("unknown username or password")
        return token(row["id"])

    registry.custom_field(CustomField("signup", "mutation", signup))
    registry.custom_field(CustomField("signin", "mutation", signin))
