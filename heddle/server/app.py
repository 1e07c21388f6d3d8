"""The HTTP endpoint: one immutable state per configuration, swapped as a whole on reload."""

from __future__ import annotations

import argparse
import json
import logging
import os
import threading
import time
import uuid
from dataclasses import dataclass
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from typing import Any

import yaml
from pyspark import InheritableThread
from pyspark.sql import SparkSession

from heddle.operators.mutations import Writer
from heddle.plans.catalog import Catalog, exposed, load
from heddle.plans.executor import Executor
from heddle.plans.policy import Access, resolve
from heddle.plans.reader import Reader
from heddle.plans.registry import Registry, default
from heddle.server.auth import AuthError, Identifier, Verifier, sign, table_lookup
from heddle.server.config import ConfigError, parse
from heddle.sources.parquet import jdbc_declaration, jdbc_tables
from heddle.sources.snapshots import SnapshotStore

log = logging.getLogger("heddle")
MOST_BODY = 1 << 20
MOST_SKIPPED = 16 << 20
#: Settings that a running server cannot take over from a changed file.
FIXED = (*(("database", k) for k in ("host", "port", "user", "password", "schema", "params", "path")), *(("server", k) for k in ("host", "port", "path")))
IDE = """<!doctype html><title>query</title><textarea id=q rows=20 cols=80>{ _role }</textarea><br><button onclick="
fetch(location.pathname,{method:'POST',body:JSON.stringify({query:q.value})}).then(r=>r.text()).then(t=>o.textContent=t)">run</button><pre id=o></pre>"""


@dataclass(frozen=True)
class State:
    config: dict[str, Any]
    catalog: Catalog
    access: dict[str, Access]
    tables: Any
    store: SnapshotStore | None
    identifier: Identifier
    registry: Registry


def build(spark: SparkSession, config: dict[str, Any], registry: Registry = default) -> State:
    """Read schemas, resolve every role, and check hooks, fields and the identity table."""
    db, jwt, gen = config["database"], config["jwt"], config["schema_gen"]
    declared = Path(db["catalog"]).read_text() if db["catalog"] else "{}"
    if db["path"]:
        store = SnapshotStore(spark, db["path"])
        path = spark._jvm.org.apache.hadoop.fs.Path(db["path"])
        found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
        every = sorted(f.getPath().getName() for f in found if f.isDirectory())
        tables, schema_of = store, store.schema
    else:
        url = f"jdbc:mysql://{db['host']}:{db['port']}/{db['schema']}" + (f"?{db['params']}" if db["params"] else "")
        store, tables = None, jdbc_tables(spark, url, user=db["user"], password=db["password"])
        every = [r[0] for r in tables(f"(SELECT table_name FROM information_schema.tables WHERE table_schema = '{db['schema']}' AND table_type = 'BASE TABLE') t").collect()]
        schema_of = lambda name: tables(name).schema
    names = exposed(every, gen["tables"]["include"], gen["tables"]["exclude"])
    if not db["path"]:  # the database's own keys hold where the catalog file declares none
        known, own = jdbc_declaration(spark, url, names, db["schema"], user=db["user"], password=db["password"]), yaml.safe_load(declared) or {}
        declared = {"tables": {n: known["tables"][n] | ((own.get("tables") or {}).get(n) or {}) for n in names}}
    catalog = load(declared, {n: schema_of(n) for n in names})
    access = {role: resolve(role, rules, catalog) for role, rules in config["roles"].items()}
    registry = registry.copy()
    registry.check(config["hooks"]["tables"], set(access), set(catalog.tables))
    lookup = jwt["role_lookup"]
    find = None
    if lookup["table"]:
        columns = set(schema_of(lookup["table"]).names)
        wanted = [lookup[k] for k in ("id_column", "role_column", "username_column", "password_column") if lookup[k]]
        if missing := [c for c in wanted if c not in columns]:
            raise ConfigError(f"identity table {lookup['table']!r} has no column {missing[0]!r}")
        find = table_lookup(lambda: tables(lookup["table"]), lookup["id_claim"], lookup["id_column"], lookup["role_column"], lookup["cache_seconds"])
    key = Path(jwt["public_key_file"]).read_text() if jwt["public_key_file"] else ""
    verifier = Verifier(jwt["algorithm"], jwt["secret"], key, jwt["issuer"], jwt["audience"], jwt["leeway_seconds"])
    identifier = Identifier(verifier, set(access), jwt["role_claim"], jwt["anonymous_role"], registry.role_resolver, find)
    return State(config, catalog, access, tables, store, identifier, registry)


class App:
    def __init__(self, spark: SparkSession, config_path: str, registry: Registry = default):
        self.spark, self.path, self.registry = spark, config_path, registry
        self.text = Path(config_path).read_text()
        self.state = self._started(parse(self.text))
        self._reloading = threading.Lock()

    def _started(self, config: dict[str, Any]) -> State:
        """Build, trying again for a while as long as the tables are not there yet."""
        until = time.monotonic() + config["database"]["startup_wait_seconds"]
        while True:
            try:
                return build(self.spark, config, self.registry)
            except ConfigError:
                raise
            except Exception:
                if time.monotonic() >= until:
                    raise
                time.sleep(1)

    def reload(self) -> bool:
        """Take over a changed file. If it doesn't load, or changes the connection, the old state keeps serving."""
        with self._reloading:
            text = Path(self.path).read_text()
            if text == self.text:
                return False
            self.text = text
            try:
                config = parse(text)
                if changed := [f"{a}.{b}" for a, b in FIXED if config[a][b] != self.state.config[a][b]]:
                    raise ConfigError(f"{changed[0]} cannot change without a restart")
                self.state = build(self.spark, config, self.registry)
            except Exception as e:
                log.error("the configuration was not reloaded: %s", e)
                return False
            return True

    def watch(self) -> None:
        while True:
            time.sleep(self.state.config["server"]["reload_interval_seconds"])
            self.reload()

    def answer(self, header: str | None, body: bytes) -> tuple[int, dict[str, Any]]:
        state = self.state
        try:
            identity = state.identifier.identify(header)
        except AuthError as e:
            return e.status, {"errors": [{"message": str(e)}]}
        try:
            request = json.loads(body)
            text, variables, name = request["query"], request.get("variables"), request.get("operationName")
            if not isinstance(text, str) or not isinstance(variables, dict | None):
                raise ValueError
        except (ValueError, KeyError, TypeError, AttributeError):
            return 400, {"errors": [{"message": "the body must be JSON with a query"}]}
        config, gen = state.config, state.config["schema_gen"]
        reader = Reader(self.spark, state.catalog, state.access[identity.role], identity, state.tables, gen["default_page_size"], gen["max_page_size"])
        writer = Writer(reader, state.store, state.registry, config["hooks"]["tables"]) if state.store else None
        executor = Executor(reader, writer, state.registry, config["server"]["max_query_depth"], config["server"]["debug"])
        return self._timed(lambda: executor.execute(text, variables, name), config["database"]["query_timeout_seconds"])

    def _timed(self, work, seconds: float) -> tuple[int, dict[str, Any]]:
        """Run a request under a tag of its own, whose jobs are stopped when time is up."""
        tag, out = f"request-{uuid.uuid4().hex}", {}

        def run() -> None:
            self.spark.addTag(tag)
            try:
                out["found"] = work()
            except Exception:
                log.exception("a request failed")

        thread = InheritableThread(target=run, daemon=True)
        thread.start()
        thread.join(seconds)
        if thread.is_alive():
            self.spark.interruptTag(tag)
            return 200, {"errors": [{"message": f"the request took more than {seconds} s"}]}
        return 200, out.get("found", {"errors": [{"message": "internal error"}]})


def handler(app: App) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def send(self, status: int, body: bytes, kind: str = "application/json", **headers: str) -> None:
            self.send_response(status)
            cors, origin = app.state.config["server"]["cors"], self.headers.get("Origin")
            if cors["enabled"] and origin and ("*" in cors["allowed_origins"] or origin in cors["allowed_origins"]):
                self.send_header("Access-Control-Allow-Origin", "*" if "*" in cors["allowed_origins"] else origin)
                self.send_header("Access-Control-Allow-Headers", "Authorization, Content-Type")
                self.send_header("Access-Control-Allow-Methods", "POST, OPTIONS")
                self.send_header("Vary", "Origin")
            for name, value in headers.items():
                self.send_header(name, value)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def fail(self, status: int, message: str, **headers: str) -> None:
            self.send(status, json.dumps({"errors": [{"message": message}]}).encode(), **headers)

        def do_OPTIONS(self) -> None:
            self.send(204, b"")

        def do_GET(self) -> None:
            server = app.state.config["server"]
            if self.path == "/healthz":
                self.send(200, b"ok", "text/plain")
            elif self.path.split("?")[0] != server["path"]:
                self.fail(404, "not found")
            elif server["graphiql"] and "text/html" in self.headers.get("Accept", ""):
                self.send(200, IDE.encode(), "text/html; charset=utf-8")
            else:
                self.fail(405, "use POST", Allow="POST")

        def do_POST(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            if size > MOST_BODY:
                self.close_connection = True
                rest = min(size, MOST_SKIPPED)  # a client that still sends would see a broken pipe, not the answer
                while rest > 0 and (part := self.rfile.read(min(rest, 1 << 16))):
                    rest -= len(part)
                self.fail(413, "the body is too large")
                return
            body = self.rfile.read(size)
            if self.path.split("?")[0] != app.state.config["server"]["path"]:
                self.fail(404, "not found")
                return
            status, found = app.answer(self.headers.get("Authorization"), body)
            self.send(status, json.dumps(found).encode())

        def log_message(self, text: str, *args: Any) -> None:
            log.debug(text, *args)

    return Handler


def serve(app: App) -> ThreadingHTTPServer:
    server = app.state.config["server"]
    if server["hot_reload"]:
        threading.Thread(target=app.watch, daemon=True).start()
    return ThreadingHTTPServer((server["host"], server["port"]), handler(app))


def main(args: list[str] | None = None) -> None:
    cli = argparse.ArgumentParser(prog="heddle")
    cli.add_argument("--config", default=os.environ.get("HEDDLE_CONFIG", "heddle.yaml"))
    cli.add_argument("--print-token", action="store_true", help="print a development token and end")
    cli.add_argument("--claims", default="{}", help="claims of that token, as JSON")
    cli.add_argument("--ttl", type=int, default=86400)
    given = cli.parse_args(args)
    if given.print_token:
        jwt = parse(Path(given.config).read_text())["jwt"]
        print(sign(json.loads(given.claims), jwt["algorithm"], jwt["secret"], given.ttl, jwt["issuer"], jwt["audience"]))
        return
    spark = SparkSession.builder.appName("heddle").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    serve(App(spark, given.config)).serve_forever()


if __name__ == "__main__":
    main()
