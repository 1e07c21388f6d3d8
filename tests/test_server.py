"""Configuration, tokens and the HTTP endpoint."""

import base64
import json
import subprocess
import threading
import time
import urllib.error
import urllib.request

import pytest
import yaml

from heddle.plans.registry import CustomField, Registry
from heddle.server import app as web
from heddle.server import auth, config
from tests import blog

SECRET = "0123456789abcdef0123456789abcdef"
BASE = {"database": {"schema": "app"}, "jwt": {"algorithm": "HS256", "secret": SECRET}, "roles": {"admin": {"tables": {"*": {"select": True}}}}}


def parsed(**more):
    return config.parse(yaml.safe_dump(BASE | more))


def test_defaults():
    found = parsed()
    assert found["server"] == {
        "host": "127.0.0.1", "port": 8080, "path": "/graphql", "graphiql": False, "debug": False, "max_query_depth": 15, "hot_reload": False, "reload_interval_seconds": 2,
        "cors": {"enabled": False, "allowed_origins": []},
    }
    assert found["database"]["query_timeout_seconds"] == 30 and found["schema_gen"]["max_page_size"] == 200 and found["jwt"]["role_claim"] == "role"


@pytest.mark.parametrize(
    ("more", "message"),
    [
        ({"nope": 1}, "unknown key nope"), ({"server": {"prot": 1}}, "unknown key server.prot"), ({"database": {}}, "required"), ({"jwt": {"algorithm": "none"}}, "not one of"),
        ({"jwt": {"algorithm": "HS256", "secret": "short"}}, "32 bytes"), ({"jwt": {"algorithm": "RS256"}}, "public_key_file"), ({"roles": {}}, "one role"),
        ({"jwt": {"algorithm": "HS256", "secret": SECRET, "anonymous_role": "x"}}, "not defined"), ({"schema_gen": {"default_page_size": 300}}, "exceeds"),
        ({"roles": {"a": {"tables": {"t": {"select": 5}}}}}, "boolean or a mapping"), ({"roles": {"a": {"tables": {"t": {"select": {"colums": []}}}}}}, "unknown key"),
        ({"roles": {"a": {"tables": {"t": {"read": True}}}}}, "unknown operation"), ({"hooks": {"tables": {"t": {"on_insert": []}}}}, "unknown event"), ({"server": {"port": "x"}}, "must be a int"),
    ],
)
def test_config_errors(more, message):
    with pytest.raises(config.ConfigError, match=message):
        parsed(**more)


def test_environment(monkeypatch):
    text = "# ${NOT_SET} in a comment is nothing\n" + yaml.safe_dump(BASE | {"jwt": {"algorithm": "HS256", "secret": "${MY_SECRET}"}})
    with pytest.raises(config.ConfigError, match="MY_SECRET"):
        config.parse(text)
    monkeypatch.setenv("MY_SECRET", SECRET)
    monkeypatch.setenv("HEDDLE_DB_HOST", "other")
    monkeypatch.setenv("HEDDLE_DB_PASSWORD", "")
    found = config.parse(text)
    assert found["jwt"]["secret"] == SECRET and found["database"]["host"] == "other" and found["database"]["password"] == ""
    with pytest.raises(config.ConfigError, match="twice"):
        config.parse("version: 1\nversion: 1\n")


def verifier(**more):
    return auth.Verifier("HS256", SECRET, **more)


def test_tokens():
    token = auth.sign({"sub": "1", "role": "admin"}, "HS256", SECRET, issuer="me", audience="you")
    assert verifier(issuer="me", audience="you").claims(token)["role"] == "admin"
    head, body, tail = token.split(".")
    none = auth.b64(b'{"alg":"none"}')
    bad = [f"{head}.{body}.{tail[:-3]}abc", f"{none}.{body}.", "x", auth.sign({}, "HS384", SECRET), auth.sign({}, "HS256", SECRET[::-1]), auth.sign({}, "HS256", SECRET, ttl=-60), auth.sign({"exp": None}, "HS256", SECRET)]
    for t in bad:
        with pytest.raises(auth.AuthError):
            verifier().claims(t)
    assert verifier(leeway=120).claims(bad[5])
    for v in (verifier(issuer="other"), verifier(audience="other")):
        with pytest.raises(auth.AuthError):
            v.claims(token)


@pytest.mark.parametrize(("algorithm", "make"), [("RS256", ["genrsa", "2048"]), ("ES256", ["ecparam", "-name", "prime256v1", "-genkey", "-noout"]), ("ES384", ["ecparam", "-name", "secp384r1", "-genkey", "-noout"]), ("ES512", ["ecparam", "-name", "secp521r1", "-genkey", "-noout"])])
def test_public_keys(tmp_path, algorithm, make):
    key, message = tmp_path / "key.pem", tmp_path / "message"
    try:
        key.write_bytes(subprocess.run(["openssl", *make], capture_output=True, check=True).stdout)
    except FileNotFoundError:
        pytest.skip("openssl is not installed")
    kind = "rsa" if algorithm[0] == "R" else "ec"
    public = subprocess.run(["openssl", kind, "-in", key, "-pubout"], capture_output=True, check=True, text=True).stdout
    body = ".".join(auth.b64(json.dumps(x).encode()) for x in ({"alg": algorithm}, {"exp": time.time() + 60, "role": "r"}))
    message.write_text(body)
    signature = subprocess.run(["openssl", "dgst", f"-sha{algorithm[2:]}", "-sign", key, message], capture_output=True, check=True).stdout
    if kind == "ec":  # from DER to the two numbers side by side
        half = {"256": 32, "384": 48, "512": 66}[algorithm[2:]]
        signature = b"".join(int.from_bytes(c).to_bytes(half) for _, c in auth._items(auth._der(signature)[1]))
    check = auth.Verifier(algorithm, public_key=public)
    assert check.claims(f"{body}.{auth.b64(signature)}")["role"] == "r"
    spoiled = bytes([signature[0] ^ 1]) + signature[1:]
    with pytest.raises(auth.AuthError):
        check.claims(f"{body}.{auth.b64(spoiled)}")
    with pytest.raises(ValueError, match="another kind"):
        auth.Verifier("ES256" if algorithm[0] == "R" else "RS256", public_key=public)


def test_identify():
    make = lambda **more: auth.Identifier(verifier(), {"admin", "guest"}, **more)
    bearer = lambda **claims: "Bearer " + auth.sign(claims, "HS256", SECRET)
    assert make().identify(bearer(role="admin")).role == "admin"
    assert make(anonymous="guest").identify(None).role == "guest"
    assert make(role_claim="app.role").identify(bearer(app={"role": "guest"})).role == "guest"
    for header, status in ((None, 401), ("Basic x", 401), ("Bearer", 401), ("Bearer x.y.z", 401), (bearer(), 403), (bearer(role="who"), 403), (bearer(role=5), 403)):
        with pytest.raises(auth.AuthError) as e:
            make().identify(header)
        assert e.value.status == status
    assert make(lookup=lambda c: "guest", role_claim="role").identify(bearer(role="admin")).role == "guest"
    assert make(lookup=lambda c: "guest", resolver=lambda c: "admin").identify(bearer()).role == "admin"


@pytest.fixture
def served(spark, tmp_path):
    blog.store(spark, tmp_path / "data")
    declared = tmp_path / "catalog.yaml"
    declared.write_text(yaml.safe_dump(blog.DECLARED))
    text = {
        "database": {"path": str(tmp_path / "data"), "catalog": str(declared), "query_timeout_seconds": 60},
        "server": {"port": 0, "graphiql": True, "cors": {"enabled": True, "allowed_origins": ["http://a"]}},
        "jwt": {"algorithm": "HS256", "secret": SECRET, "anonymous_role": "anonymous", "role_lookup": {"table": "users", "cache_seconds": 1}},
        "roles": blog.ROLES,
    }
    path = tmp_path / "config.yaml"
    path.write_text(yaml.safe_dump(text))
    registry = Registry()
    registry.custom_field(CustomField("hello", "query", lambda ctx, name="x": f"hello {name} ({ctx.identity.role})"))
    app = web.App(spark, str(path), registry)
    app.state.config["server"]["port"] = 0
    server = web.serve(app)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield app, f"http://127.0.0.1:{server.server_address[1]}", path, text
    server.shutdown()


def call(url, body=None, method="POST", **headers):
    data = json.dumps(body).encode() if isinstance(body, dict) else body
    try:
        with urllib.request.urlopen(urllib.request.Request(url, data, headers, method=method), timeout=100) as r:
            return r.status, r.read(), dict(r.headers)
    except urllib.error.HTTPError as e:
        return e.code, e.read(), dict(e.headers)


def test_http(served):
    app, url, path, text = served
    assert call(f"{url}/healthz", method="GET")[:2] == (200, b"ok")
    status, body, headers = call(f"{url}/graphql", {"query": '{ _role hello(name: "b") posts_connection { nodes { id } } }'}, Origin="http://a")
    assert status == 200 and headers["Access-Control-Allow-Origin"] == "http://a"
    assert json.loads(body)["data"] == {"_role": "anonymous", "hello": "hello b (anonymous)", "posts_connection": {"nodes": [{"id": 1}, {"id": 3}, {"id": 4}]}}
    bearer = lambda sub: {"Authorization": "Bearer " + auth.sign({"sub": sub}, "HS256", SECRET)}
    made = json.loads(call(f"{url}/graphql", {"query": 'mutation { insert_posts_one(object: {title: "t"}) { id author_id } }'}, **bearer(2))[1])
    assert made == {"data": {"insert_posts_one": {"id": 5, "author_id": 2}}}
    assert call(f"{url}/graphql", {"query": "{ _role }"}, **bearer(77))[0] == 403
    assert call(f"{url}/graphql", {"query": "{ _role }"}, Authorization="Bearer x")[0] == 401
    assert call(f"{url}/graphql", b"nonsense")[0] == 400
    assert call(f"{url}/graphql", method="GET")[0] == 405
    assert b"<textarea" in call(f"{url}/graphql", method="GET", Accept="text/html")[1]
    assert call(f"{url}/other", {"query": "{ _role }"})[0] == 404
    assert call(f"{url}/graphql", b"x" * (web.MOST_BODY + 1))[0] == 413


def test_reload(served):
    app, url, path, text = served
    ask = lambda: json.loads(call(f"{url}/graphql", {"query": "{ users_connection { nodes { id } } }"})[1])
    assert "data" in ask()
    port = app.state.config["server"]["port"]
    app.state.config["server"]["port"] = 8080
    roles = {k: v for k, v in blog.ROLES.items()}
    roles["anonymous"] = {"tables": {"posts": {"select": True}}}
    path.write_text(yaml.safe_dump(text | {"roles": roles, "server": {}}))
    assert app.reload() and "errors" in ask()
    path.write_text("roles: [")
    assert not app.reload() and "errors" in ask()
    path.write_text(yaml.safe_dump(text | {"server": {"port": 9999}}))
    assert not app.reload()
    app.state.config["server"]["port"] = port


def test_identity_table_contract(served, spark):
    app, url, path, text = served
    bad = text | {"jwt": text["jwt"] | {"role_lookup": {"table": "users", "role_column": "nope"}}}
    with pytest.raises(config.ConfigError, match="no column 'nope'"):
        web.build(spark, config.parse(yaml.safe_dump(bad)), Registry())


def test_token_command(tmp_path, capsys):
    path = tmp_path / "c.yaml"
    path.write_text(yaml.safe_dump(BASE))
    web.main(["--config", str(path), "--print-token", "--claims", '{"role": "admin"}'])
    token = capsys.readouterr().out.strip()
    assert verifier().claims(token)["role"] == "admin"
    assert base64.urlsafe_b64decode(token.split(".")[0] + "==")
