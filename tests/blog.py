"""A small blog: users, posts, comments, documents and an audit log, with three roles."""

import datetime as dt
from decimal import Decimal

from heddle.operators.mutations import Writer
from heddle.plans.catalog import load
from heddle.plans.executor import Executor
from heddle.plans.policy import Identity, resolve
from heddle.plans.reader import Reader
from heddle.plans.registry import Registry
from heddle.sources.snapshots import SnapshotStore

T0 = dt.datetime(2024, 1, 2, 3, 4, 5, 678901)
TABLES = {
    "users": (
        "id long, username string, role string, password string, is_active byte, balance decimal(10,2), metadata string, manager_id long, created_at timestamp_ntz",
        [
            (1, "ann", "admin", "x1", 1, Decimal("10.50"), '{"a": {"b": 1}, "tags": ["x", "y"], "n": null}', None, T0),
            (2, "bob", "author", "x2", 1, Decimal("0.00"), '{"tags": [], "a.b": 2, "k": 1.0}', 1, T0),
            (3, "cat", "author", "x3", 0, Decimal("99.99"), None, 1, T0),
            (4, "dan", "anonymous", "x4", 1, Decimal("-5.25"), "[1, {\"a\": 2}]", 3, T0),
        ],
    ),
    "posts": (
        "id long, author_id long, title string, body string, published byte, views int, rating double, published_on date, created_at timestamp_ntz",
        [
            (1, 2, "First", "hello", 1, 10, 4.5, dt.date(2024, 1, 1), T0),
            (2, 2, "Draft", None, 0, 0, None, None, T0),
            (3, 3, "Other", "text", 1, 10, 3.5, dt.date(2024, 2, 1), T0),
            (4, None, "Orphan", "none", 1, 7, 3.5, None, T0),
        ],
    ),
    "comments": (
        "id long, post_id long, user_id long, body string, created_at timestamp_ntz",
        [(i, p, u, f"c{i}", T0) for i, p, u in ((1, 1, 3), (2, 1, 4), (3, 3, 2), (4, 3, 2), (5, 1, 2))],
    ),
    "documents": ("id long, title string, embedding array<float>", [(1, "a", [1.0, 0.0, 0.0]), (2, "b", [0.0, 1.0, 0.0]), (3, "c", None), (4, "zero", [0.0, 0.0, 0.0]), (5, "a2", [2.0, 0.0, 0.0])]),
    "notes": ("id long, code string, part int, text string", [(1, "a", 1, "x"), (2, "a", 1, "y"), (3, "b", 1, "z"), (4, "a", None, "no part"), (5, "zz", 9, "dangling")]),
    "blobs": ("code string, part int, data binary", [("a", 1, b"\x00\xff"), ("a", 2, None), ("b", 1, b"hi")]),
}

DECLARED = {
    "tables": {
        "users": {
            "primary_key": ["id"], "foreign_keys": [{"columns": ["manager_id"], "references": "users", "ref_columns": ["id"]}],
            "columns": {"id": {"auto_increment": True, "nullable": False}, "username": {"nullable": False}, "is_active": {"kind": "Boolean", "default": True}, "metadata": {"kind": "JSON"}},
        },
        "posts": {
            "primary_key": ["id"], "foreign_keys": [{"columns": ["author_id"], "references": "users", "ref_columns": ["id"]}],
            "columns": {"id": {"auto_increment": True, "nullable": False}, "title": {"nullable": False}, "published": {"kind": "Boolean", "default": False}, "created_at": {"nullable": True}},
        },
        "comments": {
            "primary_key": ["id"],
            "foreign_keys": [{"columns": ["post_id"], "references": "posts", "ref_columns": ["id"]}, {"columns": ["user_id"], "references": "users", "ref_columns": ["id"]}],
            "columns": {"id": {"auto_increment": True, "nullable": False}},
        },
        "documents": {"primary_key": ["id"], "columns": {"embedding": {"dimension": 3}}},
        "blobs": {"primary_key": ["code", "part"]},
        "notes": {"primary_key": ["id"], "foreign_keys": [{"columns": ["code", "part"], "references": "blobs", "ref_columns": ["code", "part"]}]},
    }
}

OPEN = {"select": True, "insert": True, "update": True, "delete": True}
ROLES = {
    "admin": {"tables": {"*": OPEN, "users": {**OPEN, "select": {"allow": True, "columns": ["id", "username", "role", "is_active", "balance", "metadata", "manager_id", "created_at"]}}}},
    "author": {
        "tables": {
            "users": {"select": {"allow": True, "columns": ["id", "username", "is_active", "created_at"]}},
            "posts": {
                "select": True,
                "insert": {"allow": True, "columns": ["title", "body", "published", "published_on"], "presets": {"author_id": ":jwt.sub"}},
                "update": {"allow": True, "columns": ["title", "body", "published", "published_on"], "filter": "author_id = :jwt.sub"},
                "delete": {"allow": True, "filter": "author_id = :jwt.sub"},
            },
            "comments": {
                "select": True, "insert": {"allow": True, "columns": ["post_id", "body"], "presets": {"user_id": ":jwt.sub"}},
                "delete": {"allow": True, "filter": "user_id = :jwt.sub OR post_id IN (SELECT id FROM posts WHERE author_id = :jwt.sub)"},
            },
        }
    },
    "anonymous": {
        "tables": {
            "posts": {"select": {"allow": True, "columns": ["id", "author_id", "title", "body", "published_on", "created_at"], "filter": "published = 1"}},
            "users": {"select": {"allow": True, "columns": ["id", "username"]}}, "comments": {"select": True}, "documents": {"select": True},
        }
    },
}


def store(spark, folder):
    made = SnapshotStore(spark, str(folder))
    for name, (schema, rows) in TABLES.items():
        made.create(name, spark.createDataFrame(rows, schema))
    return made


def executor(made, role="admin", claims=None, registry=None, hooks=None, **more):
    catalog = load(DECLARED, {t: made.schema(t) for t in TABLES})
    reader = Reader(made.spark, catalog, resolve(role, ROLES[role], catalog), Identity(role, claims or {}), made)
    registry = registry or Registry()
    return Executor(reader, Writer(reader, made, registry, hooks or {}), registry, **more)
