"""Documents to plans to responses: one plan for each root field, its rows collected at the boundary only."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.functions.scalars import InputError, shown
from heddle.operators.aggregates import FUNCTIONS
from heddle.operators.mutations import Writer, required, writable
from heddle.operators.paging import page_info, shape
from heddle.operators.predicates import operators
from heddle.plans import document as doc
from heddle.plans.catalog import Table
from heddle.plans.policy import AccessError, pk_readable, readable
from heddle.plans.reader import Branch, Leaf, Reader
from heddle.plans.registry import Registry

log = logging.getLogger("heddle")


@dataclass
class Context:
    """What a custom field gets."""

    reader: Reader
    writer: Writer | None
    identity: Any


@dataclass
class Executor:
    """One role's API for one request."""

    reader: Reader
    writer: Writer | None = None
    registry: Registry = field(default_factory=Registry)
    max_depth: int = 15
    debug: bool = False

    # schema --------------------------------------------------------------------------------------------

    def roots(self, kind: str) -> dict[str, tuple[Callable, tuple]]:
        """Root fields this role has: name -> (resolver, what it is bound to). What it may not use is absent."""
        r, out = self.reader, {}
        role = r.identity.role
        for t in r.catalog.tables.values():
            ops = r.access.get(t.name, {})
            if kind == "query" and "select" in ops:
                if pk_readable(r.access, t):
                    out[f"{t.field}_by_pk"] = (self._by_pk, (t,))
                    out[f"{t.field}_connection"] = (self._connection, (t,))
                out[f"{t.field}_aggregate"] = (self._aggregate, (t,))
                for f, c in r.fields(t.name).items():
                    if c.kind == "Vector":
                        out[f"{t.field}_nearest_by_{f}"] = (self._nearest, (t, f))
            if kind == "mutation" and self.writer:
                whole = pk_readable(r.access, t)
                if "insert" in ops and writable(t, ops["insert"]):
                    out[f"insert_{t.field}"] = (self._insert, (t,))
                    if whole:
                        out[f"insert_{t.field}_one"] = (self._insert_one, (t,))
                for verb in ("update", "delete"):
                    if verb in ops and "select" in ops and (verb == "delete" or writable(t, ops[verb]) or ops[verb].presets):
                        out[f"{verb}_{t.field}"] = (self._change, (t, verb))
                        if whole:
                            out[f"{verb}_{t.field}_by_pk"] = (self._change_by_pk, (t, verb))
        if kind == "query":
            out["_role"] = (lambda node: role, ())
            out["__schema"] = (self._introspect, (None,))
            out["__type"] = (self._introspect, ("type",))
        for f in self.registry.fields:
            if f.operation == kind and (not f.roles or role in f.roles):
                out[f.name] = (self._custom, (f,))
        return out

    def types(self) -> dict[str, dict[str, Any]]:
        """The role's types by name: kind, and fields with their types and arguments."""
        r, out = self.reader, {}
        out["page_info"] = {"kind": "OBJECT", "fields": {"has_next_page": ("Boolean!", {}), "end_cursor": ("String", {})}}
        out["mutation_response"] = {"kind": "OBJECT", "fields": {"affected_rows": ("BigInt!", {})}}
        out["order_by"] = {"kind": "ENUM", "values": ["asc", "desc"]}
        out["vector_metric"] = {"kind": "ENUM", "values": ["COSINE", "L2", "L1", "INNER_PRODUCT"]}
        query, mutation, kinds = {"_role": ("String!", {})}, {}, {"Int", "Boolean", "String", "BigInt", "Float"}
        for t in r.catalog.tables.values():
            ops, n = r.access.get(t.name, {}), t.field
            if "select" in ops:
                fields = r.fields(t.name)
                kinds |= {c.kind for c in fields.values()}
                shown_ = {f: (c.kind + ("" if c.nullable or c.kind == "JSON" else "!"), {}) for f, c in fields.items()}
                for name, rel in r.catalog.relations(t.name).items():
                    if set(rel.local) <= set(readable(r.access, t.name)) and readable(r.access, rel.target):
                        target = r.catalog[rel.target].field
                        args = {"where": f"{target}_bool_exp", "order_by": f"[{target}_order_by!]", "limit": "Int", "offset": "Int"}
                        shown_[name] = (f"[{target}!]!", args) if rel.many else (target, {})
                out[n] = {"kind": "OBJECT", "fields": shown_}
                tree = {f: f"{c.kind}_comparison_exp" for f, c in fields.items()} | {"_and": f"[{n}_bool_exp!]", "_or": f"[{n}_bool_exp!]", "_not": f"{n}_bool_exp"}
                out[f"{n}_bool_exp"] = {"kind": "INPUT_OBJECT", "fields": {k: (v, {}) for k, v in tree.items()}}
                out[f"{n}_order_by"] = {"kind": "INPUT_OBJECT", "fields": {f: ("order_by", {}) for f in fields}}
                aggregate = {"count": ("BigInt!", {})}
                for fn in FUNCTIONS:
                    own = {f: ("Decimal" if fn == "sum" else "Float" if fn == "avg" else c.kind, {}) for f, c in fields.items() if fn in ("min", "max") or c.numeric}
                    if own:
                        out[f"{n}_{fn}"] = {"kind": "OBJECT", "fields": own}
                        aggregate[fn] = (f"{n}_{fn}!", {})
                out[f"{n}_aggregate"] = {"kind": "OBJECT", "fields": aggregate}
                query[f"{n}_aggregate"] = (f"{n}_aggregate!", {"where": f"{n}_bool_exp"})
                key = {t.columns[c].field: f"{t.columns[c].kind}!" for c in t.primary_key}
                if pk_readable(r.access, t):
                    out[f"{n}_connection"] = {"kind": "OBJECT", "fields": {"nodes": (f"[{n}!]!", {}), "page_info": ("page_info!", {}), "total_count": ("BigInt!", {})}}
                    query[f"{n}_connection"] = (f"{n}_connection!", {"where": f"{n}_bool_exp", "first": "Int", "after": "String"})
                    query[f"{n}_by_pk"] = (n, key)
                for f, c in fields.items():
                    if c.kind == "Vector":
                        out[f"{n}_neighbor"] = {"kind": "OBJECT", "fields": {"node": (f"{n}!", {}), "distance": ("Float!", {})}}
                        query[f"{n}_nearest_by_{f}"] = (f"[{n}_neighbor!]!", {"to": "Vector!", "metric": "vector_metric", "first": "Int", "where": f"{n}_bool_exp"})
            if self.writer and "insert" in ops and (can := writable(t, ops["insert"])):
                must = set(required(t, ops["insert"]))
                out[f"{n}_insert_input"] = {"kind": "INPUT_OBJECT", "fields": {f: (c.kind + "!" * (f in must), {}) for f, c in can.items()}}
            if self.writer and "update" in ops and writable(t, ops["update"]):
                out[f"{n}_set_input"] = {"kind": "INPUT_OBJECT", "fields": {f: (c.kind, {}) for f, c in writable(t, ops["update"]).items()}}
        for name, (resolver, bound) in self.roots("mutation").items():
            if resolver != self._custom:
                mutation[name] = self._mutation_type(resolver, *bound)
        for f in self.registry.fields:
            if not f.roles or r.identity.role in f.roles:
                (query if f.operation == "query" else mutation)[f.name] = (f.type, f.args)
                out |= {n: {"kind": "OBJECT", "fields": {k: (v, {}) for k, v in own.items()}} for n, own in f.types.items()}
                kinds |= {k for x in (f.type, *f.args.values()) if (k := x.strip("[]!")) not in out}
        for k in sorted(kinds):
            out[k] = {"kind": "SCALAR"}
            out[f"{k}_comparison_exp"] = {"kind": "INPUT_OBJECT", "fields": {op: (f"[{k}!]" if op in ("_in", "_nin") else "Boolean" if op == "_is_null" else k, {}) for op in operators(k)}}
        out["Query"] = {"kind": "OBJECT", "fields": query}
        if mutation:
            out["Mutation"] = {"kind": "OBJECT", "fields": mutation}
        return out

    def _mutation_type(self, resolver: Callable, t: Table, verb: str | None = None) -> tuple[str, dict[str, str]]:
        """What a generated mutation returns and takes."""
        if resolver == self._insert:
            return "mutation_response!", {"objects": f"[{t.field}_insert_input!]!"}
        if resolver == self._insert_one:
            return t.field, {"object": f"{t.field}_insert_input!"}
        whole = resolver == self._change
        args = {"where": f"{t.field}_bool_exp!"} if whole else {t.columns[c].field: f"{t.columns[c].kind}!" for c in t.primary_key}
        if verb == "update" and (rule := self.reader.access[t.name]["update"]) and writable(t, rule):
            args["_set"] = f"{t.field}_set_input" + "!" * (not rule.presets)
        return ("mutation_response!" if whole else t.field), args

    # execution -----------------------------------------------------------------------------------------

    def execute(self, text: str, variables: dict[str, Any] | None = None, name: str | None = None) -> dict[str, Any]:
        """The response of a document: data, and errors if there are any."""
        try:
            self.document = doc.parse(text)
            if 0 <= self.max_depth < doc.depth(self.document):
                raise doc.DocumentError(f"the document is nested deeper than {self.max_depth}")
            op = doc.operation(self.document, name)
            if op.kind == "subscription":
                raise doc.DocumentError("subscriptions are not supported")
            self.variables, self.declared = doc.bind(op, variables), set(op.variables)
            fields = self._collect(op.selections, op.kind.title())
            roots = self.roots(op.kind)
            for f in fields.values():
                if f.name not in roots and f.name != "__typename":
                    raise doc.DocumentError(f"{op.kind.title()} has no field {f.name!r}")
        except (doc.DocumentError, InputError, RecursionError) as e:
            return {"errors": [{"message": str(e)}]}
        data, errors = {}, []
        for alias, f in fields.items():
            try:
                if f.name == "__typename":
                    data[alias] = op.kind.title()
                else:
                    resolver, bound = roots[f.name]
                    data[alias] = resolver(f, *bound)
            except (InputError, AccessError, doc.DocumentError) as e:
                data[alias] = None
                errors.append({"message": str(e), "path": [alias]})
            except Exception as e:  # noqa: BLE001
                log.exception("field %s failed", alias)
                data[alias] = None
                known = self.debug or not isinstance(e, PySparkException)
                errors.append({"message": str(e) if self.debug and known else "internal error", "path": [alias]})
            if op.kind == "mutation" and errors:  # later writes don't run after a failed one
                break
        return {"data": data} | ({"errors": errors} if errors else {})

    def _collect(self, selections: list | None, on: str) -> dict[str, doc.FieldNode]:
        if not selections:
            raise doc.DocumentError(f"fields of {on} must be selected")
        return doc.collect(self.document, selections, on, self.variables, self.declared)

    def _args(self, f: doc.FieldNode, *known: str) -> dict[str, Any]:
        if unknown := f.args.keys() - set(known):
            raise doc.DocumentError(f"{f.name} has no argument {sorted(unknown)[0]!r}")
        return {k: v for k, x in f.args.items() if (v := doc.resolve(x, self.variables, self.declared)) is not None}

    def selection(self, table: Table, selections: list | None) -> list[Leaf | Branch]:
        out: list[Leaf | Branch] = []
        fields = self.reader.fields(table.name)
        for alias, f in self._collect(selections, table.field).items():
            if f.name == "__typename":
                out.append(Leaf(alias, None, table.field))
            elif f.name in fields:
                if f.selections:
                    raise doc.DocumentError(f"{f.name} has no fields")
                out.append(Leaf(alias, fields[f.name]))
            else:
                relation = self.reader.relation(table.name, f.name)
                args = self._args(f, *(("where", "order_by", "limit", "offset") if relation.many else ()))
                out.append(Branch(alias, relation, self.selection(self.reader.catalog[relation.target], f.selections), args))
        return out

    def shown(self, node: Any, selection: list[Leaf | Branch]) -> dict[str, Any] | None:
        """A collected node as the response shows it."""
        if node is None:
            return None
        out = {}
        for i, item in enumerate(selection):
            value = node[i]
            if isinstance(item, Leaf):
                out[item.name] = value if item.column is None else shown(item.column.kind, value)
            elif item.relation.many:
                out[item.name] = [self.shown(v, item.selection) for v in value]
            else:
                out[item.name] = self.shown(value, item.selection)
        return out

    def _rows(self, df: DataFrame) -> list:
        """Collect a plan's rows; in debug mode its plan is logged first."""
        if self.debug:
            log.info("%s", df._jdf.queryExecution().toString())
        return df.collect()

    def _first(self, df: DataFrame, table: Table, selections: list | None) -> dict[str, Any] | None:
        selection = self.selection(table, selections)
        found = self._rows(self.reader.page_nodes(df, table.name, selection).select("__node"))
        return self.shown(found[0]["__node"], selection) if found else None

    def _by_pk(self, f: doc.FieldNode, table: Table) -> Any:
        key = [table.columns[c].field for c in table.primary_key]
        return self._first(self.reader.by_pk(table.name, self._args(f, *key)), table, f.selections)

    def _connection(self, f: doc.FieldNode, table: Table) -> dict[str, Any]:
        args = self._args(f, "where", "first", "after")
        where = args.get("where")
        parts = self._collect(f.selections, f"{table.field}_connection")
        if unknown := [p.name for p in parts.values() if p.name not in ("nodes", "page_info", "total_count", "__typename")]:
            raise doc.DocumentError(f"{table.field}_connection has no field {unknown[0]!r}")
        out: dict[str, Any] = {}
        nodes = {a: self.selection(table, p.selections) for a, p in parts.items() if p.name == "nodes"}
        rows, info = {}, None
        wanted = nodes or ({"": []} if any(p.name == "page_info" for p in parts.values()) else {})
        for alias, selection in wanted.items():
            df, size = self.reader.connection(table.name, selection, where, args.get("first"), args.get("after"))
            found = self._rows(df)
            n, info = page_info([list(r)[1:] for r in found], size, shape(table.name, where))
            rows[alias] = [self.shown(r["__node"], selection) for r in found[:n]]
        for alias, p in parts.items():
            if p.name == "nodes":
                out[alias] = rows[alias]
            elif p.name == "page_info":
                out[alias] = {a: "page_info" if q.name == "__typename" else info[q.name] for a, q in self._collect(p.selections, "page_info").items()}
            elif p.name == "total_count":
                out[alias] = self.reader.total_count(table.name, where).first()[0]
            else:
                out[alias] = f"{table.field}_connection"
        return out

    def _aggregate(self, f: doc.FieldNode, table: Table) -> dict[str, Any]:
        where = self._args(f, "where").get("where")
        parts = self._collect(f.selections, f"{table.field}_aggregate")
        fields, requested, inner = self.reader.fields(table.name), [], {}
        for alias, p in parts.items():
            if p.name in FUNCTIONS:
                inner[alias] = self._collect(p.selections, f"{table.field}_{p.name}")
                requested += [(p.name, q.name) for q in inner[alias].values() if q.name != "__typename"]
            elif p.name not in ("count", "__typename"):
                raise doc.DocumentError(f"{table.field}_aggregate has no field {p.name!r}")
        row = self._rows(self.reader.aggregate(table.name, requested, where, any(p.name == "count" for p in parts.values())))[0]
        out: dict[str, Any] = {}
        for alias, p in parts.items():
            if p.name == "count":
                out[alias] = row["count"]
            elif p.name == "__typename":
                out[alias] = f"{table.field}_aggregate"
            else:
                out[alias] = {}
                for a, q in inner[alias].items():
                    if q.name == "__typename":
                        out[alias][a] = f"{table.field}_{p.name}"
                        continue
                    value = row[f"{p.name}_{fields[q.name].name}"]
                    kind = {"sum": "Decimal", "avg": "Float"}.get(p.name, fields[q.name].kind)
                    out[alias][a] = shown(kind, value)
        return out

    def _nearest(self, f: doc.FieldNode, table: Table, column: str) -> list[dict[str, Any]]:
        args = self._args(f, "to", "metric", "first", "where")
        if "to" not in args:
            raise InputError("to is required")
        parts = self._collect(f.selections, f"{table.field}_neighbor")
        selection = [x for p in parts.values() if p.name == "node" for x in self.selection(table, p.selections)]
        df = self.reader.nearest(table.name, column, args["to"], str(args.get("metric", "COSINE")), args.get("first"), args.get("where"))
        ties = [F.col(f"`{c}`").alias(f"__tie{i}") for i, c in enumerate(table.primary_key)]
        df = self.reader.page_nodes(df, table.name, selection, "distance", *table.primary_key).select("__node", "distance", *ties).orderBy("distance", *(f"__tie{i}" for i in range(len(ties))))
        out = []
        for r in self._rows(df):
            item: dict[str, Any] = {}
            for a, p in parts.items():
                if p.name == "node":
                    item[a] = self.shown(r["__node"], selection)
                elif p.name == "distance":
                    item[a] = r["distance"]
                elif p.name == "__typename":
                    item[a] = f"{table.field}_neighbor"
                else:
                    raise doc.DocumentError(f"{table.field}_neighbor has no field {p.name!r}")
            out.append(item)
        return out

    def _response(self, f: doc.FieldNode, affected: int) -> dict[str, Any]:
        out = {}
        for a, p in self._collect(f.selections, "mutation_response").items():
            if p.name not in ("affected_rows", "__typename"):
                raise doc.DocumentError(f"mutation_response has no field {p.name!r}")
            out[a] = affected if p.name == "affected_rows" else "mutation_response"
        return out

    def _insert(self, f: doc.FieldNode, table: Table) -> dict[str, Any]:
        objects = self._args(f, "objects").get("objects")
        objects = [objects] if isinstance(objects, dict) else objects
        return self._response(f, self.writer.insert(table.name, objects or [])[0])

    def _insert_one(self, f: doc.FieldNode, table: Table) -> dict[str, Any] | None:
        self.selection(table, f.selections)  # a bad selection must not come after the write
        key = self.writer.insert_one(table.name, self._args(f, "object").get("object") or {})
        return self._first(self.reader.by_pk(table.name, key), table, f.selections) if key else None

    def _change(self, f: doc.FieldNode, table: Table, verb: str) -> dict[str, Any]:
        if "where" not in f.args:
            raise InputError("where is required")
        args = self._args(f, "where", *(["_set"] if verb == "update" else []))
        where = args.get("where", {})
        return self._response(f, self.writer.update(table.name, where, args.get("_set", {})) if verb == "update" else self.writer.delete(table.name, where))

    def _change_by_pk(self, f: doc.FieldNode, table: Table, verb: str) -> dict[str, Any] | None:
        fields = [table.columns[c].field for c in table.primary_key]
        args = self._args(f, *fields, *(["_set"] if verb == "update" else []))
        if missing := [k for k in fields if k not in args]:
            raise InputError(f"{missing[0]!r} is required")
        key = {k: args[k] for k in fields}
        if verb == "update":
            self.selection(table, f.selections)
            changed = self.writer.update(table.name, None, args.get("_set", {}), key)
            return self._first(self.reader.by_pk(table.name, key), table, f.selections) if changed else None
        rule = self.reader.access[table.name]["delete"].filter
        before = self.reader.restricted(self.reader.by_pk(table.name, key), rule)
        found = self._first(before, table, f.selections)
        if found is None:
            return None
        return found if self.writer.delete(table.name, None, key) else None

    def _custom(self, f: doc.FieldNode, made: Any) -> Any:
        value = made.resolve(Context(self.reader, self.writer, self.reader.identity), **self._args(f, *f.args))
        if isinstance(value, DataFrame):
            most = self.reader.most_page
            value = [r.asDict(True) for r in value.limit(most + 1).collect()]
            if len(value) > most:
                raise InputError(f"{made.name} has over {most} rows; its resolver must page them")
        return self._pick(f, value)

    def _pick(self, f: doc.FieldNode, value: Any) -> Any:
        if f.selections is None or value is None:
            return value
        if isinstance(value, list):
            return [self._pick(f, v) for v in value]
        return {a: self._pick(p, value.get(p.name)) for a, p in self._collect(f.selections, f.name).items()}

    def _introspect(self, f: doc.FieldNode, which: str | None) -> Any:
        types = self.types()

        def ref(text: str | None) -> dict[str, Any] | None:
            if text is None:
                return None
            if text.endswith("!"):
                return {"kind": "NON_NULL", "name": None, "ofType": ref(text[:-1])}
            if text.startswith("["):
                return {"kind": "LIST", "name": None, "ofType": ref(text[1:-1])}
            return {"kind": types.get(text, {"kind": "SCALAR"})["kind"], "name": text, "ofType": None}

        def full(name: str) -> dict[str, Any] | None:
            t = types.get(name)
            if t is None:
                return None
            out = dict.fromkeys(("description", "fields", "inputFields", "interfaces", "enumValues", "possibleTypes", "ofType", "specifiedByURL"))
            out |= {"kind": t["kind"], "name": name}
            if t["kind"] == "OBJECT":
                out["interfaces"] = []
                out["fields"] = [
                    {"name": n, "description": None, "type": ref(kind), "isDeprecated": False, "deprecationReason": None, "args": [{"name": a, "description": None, "type": ref(x), "defaultValue": None} for a, x in args.items()]}
                    for n, (kind, args) in t["fields"].items()
                ]
            if t["kind"] == "INPUT_OBJECT":
                out["inputFields"] = [{"name": n, "description": None, "type": ref(kind), "defaultValue": None} for n, (kind, _) in t["fields"].items()]
            if t["kind"] == "ENUM":
                out["enumValues"] = [{"name": v, "description": None, "isDeprecated": False, "deprecationReason": None} for v in t["values"]]
            return out

        if which:
            return self._pick_meta(f, full(str(self._args(f, "name").get("name"))), "__Type")
        whole = {
            "description": None, "queryType": {"name": "Query", "kind": "OBJECT"}, "mutationType": {"name": "Mutation", "kind": "OBJECT"} if "Mutation" in types else None,
            "subscriptionType": None, "types": [full(n) for n in types], "directives": [],
        }
        return self._pick_meta(f, whole, "__Schema")

    #: Types of introspection fields, for fragments that name them.
    META = {
        "types": "__Type", "queryType": "__Type", "mutationType": "__Type", "subscriptionType": "__Type", "type": "__Type", "ofType": "__Type", "interfaces": "__Type",
        "possibleTypes": "__Type", "fields": "__Field", "args": "__InputValue", "inputFields": "__InputValue", "enumValues": "__EnumValue", "directives": "__Directive",
    }

    def _pick_meta(self, f: doc.FieldNode, value: Any, on: str) -> Any:
        if value is None or f.selections is None:
            return value
        if isinstance(value, list):
            return [self._pick_meta(f, v, on) for v in value]
        picked = self._collect(f.selections, on)
        return {a: on if p.name == "__typename" else self._pick_meta(p, value.get(p.name), self.META.get(p.name, "")) for a, p in picked.items()}
