"""The engine end to end on the blog: documents in, responses out."""

import pytest

from heddle.plans.registry import CustomField, Registry
from tests import blog


@pytest.fixture(scope="module")
def shared(spark, tmp_path_factory):
    return blog.store(spark, tmp_path_factory.mktemp("blog"))


@pytest.fixture
def own(spark, tmp_path):
    return blog.store(spark, tmp_path / "blog")


def run(made, text, role="admin", claims=None, variables=None, **more):
    return blog.executor(made, role, claims, **more).execute(text, variables)


def data(*args, **kwargs):
    found = run(*args, **kwargs)
    assert "errors" not in found, found
    return found["data"]


def error(*args, **kwargs):
    return run(*args, **kwargs)["errors"][0]["message"]


def ids(found):
    return [n["id"] for n in found["nodes"]]


def test_by_pk_and_types(shared):
    found = data(shared, "{ users_by_pk(id: 1) { id username is_active balance metadata created_at __typename } none: users_by_pk(id: 99) { id } _role }")
    assert found == {
        "users_by_pk": {"id": 1, "username": "ann", "is_active": True, "balance": "10.50", "metadata": {"a": {"b": 1}, "tags": ["x", "y"], "n": None}, "created_at": "2024-01-02T03:04:05Z", "__typename": "users"},
        "none": None, "_role": "admin",
    }


def test_walk(shared):
    seen, after = [], None
    for _ in range(5):
        page = data(shared, "query ($a: String) { posts_connection(first: 2, after: $a) { nodes { id } page_info { has_next_page end_cursor } total_count } }", variables={"a": after})["posts_connection"]
        seen += ids(page)
        after = page["page_info"]["end_cursor"]
        assert page["total_count"] == 4
        if not page["page_info"]["has_next_page"]:
            break
    assert seen == [1, 2, 3, 4]
    assert "belongs to another" in error(shared, "query ($a: String) { posts_connection(after: $a, where: {id: {_gt: 1}}) { nodes { id } } }", variables={"a": after})
    assert error(shared, '{ posts_connection(after: "%%") { nodes { id } } }') == "not a cursor"
    empty = data(shared, "{ posts_connection(first: 0) { nodes { id } page_info { has_next_page end_cursor } } }")["posts_connection"]
    assert empty == {"nodes": [], "page_info": {"has_next_page": False, "end_cursor": None}}
    assert error(shared, "{ posts_connection(first: -1) { nodes { id } } }") == "first must be >= 0"


def test_composite_key_walk(shared):
    first = data(shared, "{ blobs_connection(first: 2) { nodes { code part data } page_info { end_cursor } } }")["blobs_connection"]
    assert first["nodes"] == [{"code": "a", "part": 1, "data": "AP8="}, {"code": "a", "part": 2, "data": None}]
    rest = data(shared, "query ($a: String!) { blobs_connection(after: $a) { nodes { code part } } }", variables={"a": first["page_info"]["end_cursor"]})
    assert rest["blobs_connection"]["nodes"] == [{"code": "b", "part": 1}]


@pytest.mark.parametrize(
    ("where", "want"),
    [
        ("{rating: {_is_null: true}}", [2]),
        ("{rating: {_is_null: false}}", [1, 3, 4]),
        ("{rating: {_neq: 4.5}}", [3, 4]),
        ("{_not: {rating: {_eq: 4.5}}}", [3, 4]),
        ("{published: {_eq: true}}", [1, 3, 4]),
        ("{id: {_in: []}}", []),
        ("{id: {_nin: []}}", [1, 2, 3, 4]),
        ("{author_id: {_nin: [2]}}", [3]),
        ("{_or: []}", [1, 2, 3, 4]),
        ("{_or: [{id: {_eq: 1}}, {}]}", [1, 2, 3, 4]),
        ("{_not: {}}", []),
        ("{_and: [{id: {_gt: 1}}, {id: {_lt: 4}}], title: null}", [2, 3]),
        ('{title: {_like: "%r%t"}}', [1, 2]),
        ('{title: {_regex: "^O"}}', [3, 4]),
        ('{title: {_nregex: "r"}}', []),
        ('{published_on: {_gte: "2024-01-15"}}', [3]),
        ('{created_at: {_gt: "2024-01-02T03:04:05Z"}}', [1, 2, 3, 4]),
    ],
)
def test_filters(shared, where, want):
    assert ids(data(shared, f"{{ posts_connection(where: {where}) {{ nodes {{ id }} }} }}")["posts_connection"]) == want


@pytest.mark.parametrize(
    ("test", "want"),
    [
        ("{_contains: {a: {b: 1}}}", [1]),
        ('{_contains: {tags: ["y"]}}', [1]),
        ("{_contains: {tags: []}}", [1, 2]),
        ("{_contains: [1]}", [4]),
        ("{_contains: [{a: 2}]}", [4]),
        ("{_contains: 1}", [4]),
        ("{_contains: {n: null}}", [1]),
        ('{_has_key: "n"}', [1]),
        ('{_has_key: "a.b"}', [1]),
        ('{_has_key: "\\"a.b\\""}', [2]),
        ('{_eq: {k: 1, tags: [], a_b: 0}}', []),
        ("{_is_null: true}", [3]),
    ],
)
def test_json(shared, test, want):
    assert ids(data(shared, f"{{ users_connection(where: {{metadata: {test}}}) {{ nodes {{ id }} }} }}")["users_connection"]) == want


def test_json_negation_keeps_null_out(shared):
    assert ids(data(shared, '{ users_connection(where: {_not: {metadata: {_has_key: "tags"}}}) { nodes { id } } }')["users_connection"]) == [4]


def test_filter_errors(shared):
    assert "unknown filter column" in error(shared, '{ posts_connection(where: {nope: {_eq: 1}}) { nodes { id } } }')
    assert "null" in error(shared, "{ posts_connection(where: {id: {_eq: null}}) { nodes { id } } }")
    assert "_is_null" in error(shared, "{ posts_connection(where: {id: {_is_null: 1}}) { nodes { id } } }")
    assert "no operator" in error(shared, '{ posts_connection(where: {id: {_like: "a"}}) { nodes { id } } }')
    assert "unknown filter column" in error(shared, "query ($w: x) { users_connection(where: $w) { nodes { id } } }", role="anonymous", variables={"w": {"password": {_k: "x" for _k in ("_eq",)}}})


def test_relations(shared):
    text = """{ posts_connection { nodes { id author { username } comments(order_by: [{id: desc}], limit: 2, offset: 1) { id user { username manager { username } } } none: comments(limit: 0) { id } } } }"""
    nodes = data(shared, text)["posts_connection"]["nodes"]
    assert [n["author"] and n["author"]["username"] for n in nodes] == ["bob", "bob", "cat", None]
    assert [[c["id"] for c in n["comments"]] for n in nodes] == [[2, 1], [], [3], []]
    assert nodes[0]["comments"][1]["user"] == {"username": "cat", "manager": {"username": "ann"}}
    assert all(n["none"] == [] for n in nodes)


def test_self_relation_both_ways(shared):
    nodes = data(shared, "{ users_connection { nodes { id manager { id } users { id users { id } } } } }")["users_connection"]["nodes"]
    assert [n["manager"] and n["manager"]["id"] for n in nodes] == [None, 1, 1, 3]
    assert nodes[0]["users"] == [{"id": 2, "users": []}, {"id": 3, "users": [{"id": 4}]}]


def test_composite_relation(shared):
    found = data(shared, "{ notes_connection { nodes { id blobs { code part } } } blobs_connection { nodes { part notes(order_by: {text: desc}) { id } } } }")
    assert [n["blobs"] for n in found["notes_connection"]["nodes"]] == [{"code": "a", "part": 1}, {"code": "a", "part": 1}, {"code": "b", "part": 1}, None, None]
    assert [[x["id"] for x in n["notes"]] for n in found["blobs_connection"]["nodes"]] == [[2, 1], [], [3]]


def test_accounts(own):
    from heddle.server import accounts
    from heddle.server.auth import Verifier

    registry, secret = Registry(), "s" * 32
    accounts.register(registry, "HS256", secret)
    text = 'mutation { %s(username: "eve", password: "%s") { token } }'
    made = data(own, text % ("signup", "long enough"), registry=registry)["signup"]["token"]
    again = data(own, text % ("signin", "long enough"), registry=registry)["signin"]["token"]
    assert {Verifier("HS256", secret).claims(t)["sub"] for t in (made, again)} == {5}
    assert "unknown" in error(own, text % ("signin", "wrong one"), registry=registry)
    assert "taken" in error(own, text % ("signup", "long enough"), registry=registry)
    assert "8 characters" in error(own, text % ("signup", "short"), registry=registry)


def test_aggregates(shared):
    text = "{ posts_aggregate(where: {id: {_lte: 3}}) { count sum { views rating } s: sum { id } avg { views } min { title rating } max { published_on } __typename } users_aggregate { sum { balance is_active } } }"
    found = data(shared, text)
    assert found["posts_aggregate"] == {
        "count": 3, "sum": {"views": "20", "rating": "8.0"}, "s": {"id": "6"}, "avg": {"views": 20 / 3}, "min": {"title": "Draft", "rating": 3.5}, "max": {"published_on": "2024-02-01"}, "__typename": "posts_aggregate",
    }
    assert found["users_aggregate"] == {"sum": {"balance": "105.24", "is_active": "3"}}
    none = data(shared, "{ posts_aggregate(where: {id: {_lt: 0}}) { count sum { views } max { title } } only: posts_aggregate { __typename } }")
    assert none == {"posts_aggregate": {"count": 0, "sum": {"views": None}, "max": {"title": None}}, "only": {"__typename": "posts_aggregate"}}


def test_nearest(shared):
    text = '{ documents_nearest_by_embedding(to: "[1,0,0]", metric: %s, first: 9) { node { id } distance } }'
    got = {m: [(n["node"]["id"], round(n["distance"], 6)) for n in data(shared, text % m)["documents_nearest_by_embedding"]] for m in ("COSINE", "L2", "L1", "INNER_PRODUCT")}
    assert got["COSINE"] == [(1, 0.0), (5, 0.0), (2, 1.0)]
    assert got["L2"] == [(1, 0.0), (4, 1.0), (5, 1.0), (2, 1.414214)]
    assert got["L1"] == [(1, 0.0), (4, 1.0), (5, 1.0), (2, 2.0)]
    assert got["INNER_PRODUCT"] == [(5, -2.0), (1, -1.0), (2, 0.0), (4, 0.0)]
    assert "dimensions" in error(shared, '{ documents_nearest_by_embedding(to: "[1,0]") { distance } }')


def test_roles_hide(shared):
    """Every read path, for a role that may not see drafts, passwords or ratings."""
    anyone = {"role": "anonymous"}
    assert ids(data(shared, "{ posts_connection { nodes { id } total_count } }", **anyone)["posts_connection"]) == [1, 3, 4]
    assert data(shared, "{ posts_by_pk(id: 2) { id } posts_aggregate { count } }", **anyone) == {"posts_by_pk": None, "posts_aggregate": {"count": 3}}
    nested = data(shared, "{ users_by_pk(id: 2) { posts { id } } }", **anyone)
    assert nested == {"users_by_pk": {"posts": [{"id": 1}]}}
    assert "no relation 'password'" in error(shared, "{ users_by_pk(id: 2) { password } }", **anyone)
    assert "unknown column" in error(shared, "{ posts_aggregate { max { rating } } }", **anyone)
    assert "no field" in error(shared, "{ blobs_connection { nodes { code } } }", **anyone)
    assert "no field" in error(shared, "mutation { delete_posts(where: {}) { affected_rows } }", **anyone)
    assert "cannot order" in error(shared, "{ users_by_pk(id: 2) { posts(order_by: {rating: asc}) { id } } }", **anyone)
    names = data(shared, '{ __type(name: "users") { fields { name } } __schema { mutationType { name } types { name } } }', **anyone)
    assert [f["name"] for f in names["__type"]["fields"]][:2] == ["id", "username"] and names["__schema"]["mutationType"] is None
    assert "blobs" not in [t["name"] for t in names["__schema"]["types"]]


def test_insert_update_delete(own):
    author = {"role": "author", "claims": {"sub": 2.0}}
    made = data(own, 'mutation { insert_posts_one(object: {title: "New", published: true}) { id title author_id published views } }', **author)
    assert made == {"insert_posts_one": {"id": 5, "title": "New", "author_id": 2, "published": True, "views": None}}
    assert data(own, 'mutation { update_posts(where: {}, _set: {body: "mine"}) { affected_rows } }', **author) == {"update_posts": {"affected_rows": 3}}
    assert data(own, 'mutation { update_posts_by_pk(id: 3, _set: {body: "x"}) { id } }', **author) == {"update_posts_by_pk": None}
    assert data(own, 'mutation { update_posts_by_pk(id: 1, _set: {body: "x"}) { id body } }', **author) == {"update_posts_by_pk": {"id": 1, "body": "x"}}
    rows = data(own, "{ posts_connection { nodes { id body } } }")["posts_connection"]["nodes"]
    assert [(r["id"], r["body"]) for r in rows] == [(1, "x"), (2, "mine"), (3, "text"), (4, "none"), (5, "mine")]
    # comments on own posts may go as well as own comments
    assert data(own, "mutation { delete_comments(where: {}) { affected_rows } }", **author) == {"delete_comments": {"affected_rows": 5}}
    assert data(own, "mutation { delete_posts_by_pk(id: 2) { id title } none: delete_posts_by_pk(id: 3) { id } }", **author) == {"delete_posts_by_pk": {"id": 2, "title": "Draft"}, "none": None}
    assert data(own, "{ posts_aggregate { count } }") == {"posts_aggregate": {"count": 4}}


def test_write_errors_leave_the_table(own):
    before = own.manifest("posts")
    author = {"role": "author", "claims": {"sub": 2}}
    assert "cannot be written" in error(own, 'mutation { insert_posts(objects: [{title: "a", views: 1}]) { affected_rows } }', **author)
    assert "required" in error(own, "mutation { insert_posts(objects: [{body: \"a\"}]) { affected_rows } }", **author)
    assert "must not be empty" in error(own, "mutation { insert_posts(objects: []) { affected_rows } }", **author)
    assert "no column" in error(own, "mutation { update_posts(where: {}, _set: {}) { affected_rows } }", **author)
    assert "exists already" in error(own, 'mutation { insert_posts(objects: [{id: 1, title: "a"}]) { affected_rows } }')
    assert "names no row" in error(own, 'mutation { insert_posts(objects: [{title: "a", author_id: 77}]) { affected_rows } }')
    assert "exists already" in error(own, "mutation { update_posts(where: {}, _set: {id: 9}) { affected_rows } }")
    assert "claim" in error(own, 'mutation { insert_posts(objects: [{title: "a"}]) { affected_rows } }', role="author")
    assert own.manifest("posts") == before


def test_hooks(own):
    seen = []
    registry = Registry()
    registry.mutation_hook("note", lambda e: seen.append((e.table, e.operation, e.affected, len(e.values))))

    def veto(e):
        raise ValueError("no")

    registry.mutation_hook("veto", veto)
    hooks = {"*": {"before_insert": ["note"]}, "posts": {"after_insert": ["note"], "after_delete": ["veto"]}}
    data(own, 'mutation { insert_posts(objects: [{title: "a"}, {title: "b"}]) { affected_rows } }', registry=registry, hooks=hooks)
    assert seen == [("posts", "insert", None, 2), ("posts", "insert", 2, 2)]
    assert "errors" in run(own, "mutation { delete_posts(where: {}) { affected_rows } }", registry=registry, hooks=hooks)
    assert data(own, "{ posts_aggregate { count } }") == {"posts_aggregate": {"count": 6}}
    with pytest.raises(ValueError, match="twice"):
        registry.mutation_hook("note", veto)
    with pytest.raises(ValueError, match="not registered"):
        registry.check({"*": {"before_insert": ["other"]}}, {"admin"}, {"posts"})
    copy = registry.copy()
    registry.reset()
    assert copy.hooks and not registry.hooks


def test_custom_fields(shared):
    registry = Registry()
    registry.custom_field(CustomField("top", "query", lambda ctx, n=1: ctx.reader.select("posts").orderBy("id").limit(n).select("id", "title"), ("admin",)))
    assert data(shared, "{ top(n: 2) { id t: title } }", registry=registry) == {"top": [{"id": 1, "t": "First"}, {"id": 2, "t": "Draft"}]}
    assert "no field" in error(shared, "{ top { id } }", role="anonymous", registry=registry)


def test_custom_fields_are_not_cut(shared):
    registry = Registry()
    registry.custom_field(CustomField("many", "query", lambda ctx, n: ctx.reader.spark.range(n)))
    assert len(data(shared, "{ many(n: 200) { id } }", registry=registry)["many"]) == 200
    assert "over 200 rows" in error(shared, "{ many(n: 201) { id } }", registry=registry)


def test_introspection_of_roots(shared):
    """Every root field is described with what its resolver takes and returns."""
    registry = Registry()

    def top(ctx, n: int, label: str = ""):
        return [{"id": n}]

    registry.custom_field(CustomField("top", "query", top, type="[top_row!]!", types={"top_row": {"id": "BigInt!"}}))
    registry.custom_field(CustomField("ping", "mutation", lambda ctx: "pong", type="String!"))
    text = "{ __schema { queryType { name } types { name kind fields { name type { kind name ofType { kind name ofType { kind name ofType { name } } } } args { name type { kind name ofType { name kind } } } } } } }"
    found = data(shared, text, registry=registry)["__schema"]["types"]
    types = {t["name"]: t for t in found}

    def spelled(t):
        return {"NON_NULL": lambda: spelled(t["ofType"]) + "!", "LIST": lambda: f"[{spelled(t['ofType'])}]"}.get(t.get("kind"), lambda: t["name"])()

    fields = {n: {f["name"]: (f, {a["name"]: a for a in f["args"]}) for f in types[n]["fields"]} for n in ("Query", "Mutation")}
    e = blog.executor(shared, registry=registry)
    assert set(fields["Query"]) == set(e.roots("query")) - {"__schema", "__type"}
    assert set(fields["Mutation"]) == set(e.roots("mutation"))
    one, args = fields["Mutation"]["insert_posts_one"]
    assert spelled(one["type"]) == "posts" and list(args) == ["object"] and args["object"]["type"]["ofType"]["name"] == "posts_insert_input"
    assert spelled(fields["Mutation"]["insert_posts"][0]["type"]) == "mutation_response!"
    assert set(fields["Mutation"]["update_posts_by_pk"][1]) == {"id", "_set"} and set(fields["Mutation"]["delete_posts"][1]) == {"where"}
    top_field, args = fields["Query"]["top"]
    assert spelled(top_field["type"]["ofType"]) == "[top_row!]" and args["n"]["type"]["kind"] == "NON_NULL" and args["label"]["type"]["name"] == "String"
    assert spelled(fields["Mutation"]["ping"][0]["type"]) == "String!" and not fields["Mutation"]["ping"][1]
    named = {spelled(f["type"]).strip("[]!") for t in found for f in t["fields"] or ()}
    assert named - {"None"} <= set(types)


def test_documents(shared):
    text = """query Q($id: BigInt = 1, $skip: Boolean!) { p: posts_by_pk(id: $id) { ...F title @skip(if: $skip) ... on posts { views } } } fragment F on posts { id }"""
    assert data(shared, text, variables={"skip": True}) == {"p": {"id": 1, "views": 10}}
    assert "required" in error(shared, text)
    assert "twice" not in error(shared, "{ a: posts_by_pk(id: 1) { x: id x: title } }")
    assert "deeper" in error(shared, "{ posts_by_pk(id: 1) { author { posts { author { id } } } } }", max_depth=3)
    assert "expected" in error(shared, "{ posts_by_pk(id: 1 { id } }")
    assert "unknown fragment" in error(shared, "{ posts_by_pk(id: 1) { ...G } }")
    assert "subscriptions" in error(shared, "subscription { posts_by_pk(id: 1) { id } }")
    assert data(shared, '{ posts_by_pk(id: """1""") { id } }') == {"posts_by_pk": {"id": 1}}


def test_two_writers(own):
    """A process that read a table before another one's write is refused, and nothing of its write is seen."""
    from heddle.sources.snapshots import Conflict, SnapshotStore

    first, second = blog.executor(own).writer, blog.executor(SnapshotStore(own.spark, own.folder)).writer
    before = own("posts").count()
    with second.store.lock("posts"):  # the other process is within its write
        assert first.delete("posts", {"id": {"_eq": 1}}) == 1
        with pytest.raises(Conflict):
            second.store.commit("posts", own.schema("posts"), [])
    assert own("posts").count() == before - 1
    assert second.update("posts", {"id": {"_eq": 2}}, {"title": "Again"}) == 1
    assert own.vacuum("posts") > 1 and own.versions("posts") == [own.versions("posts")[-1]]
    assert own("posts").count() == before - 1 and own("posts").where("title = 'Again'").count() == 1
