"""The seventeen named questions over the fact tables, answered as JSON-ready dicts. Section 2 of the survey.

``count`` is always exact; rows are handed over in pages of ``page`` (ordered by id), as an answer has to fit into a
message. ``truncated`` says that more rows exist; ``offset`` asks for them.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame, functions as F

from factloom import schema
from factloom.operators import graph, lookup
from factloom.session import cut, scratch

PAGE = 10_000

_S, _I, _B = {"type": "string"}, {"type": "integer"}, {"type": "boolean"}

#: name: (description, arguments, those that are required)
CATALOGUE: dict[str, tuple[str, dict[str, dict], list[str]]] = {
    "index_status": ("Counts of classes, methods, calls and issues.", {}, []),
    "find_symbol": ("A class by its exact name, dotted or slashed.", {"prefix": _S}, ["prefix"]),
    "describe_method": ("One method with its lines and signature.", {"owner": _S, "name": _S, "desc": _S}, ["owner", "name", "desc"]),
    "callers_of": ("Call sites of a method; uncertain reflective ones on request.", {"owner": _S, "name": _S, "desc": _S, "includeReflect": _B}, ["owner", "name", "desc"]),
    "callees_of": ("Calls a method makes.", {"callerMethodId": _I}, ["callerMethodId"]),
    "find_path": ("A shortest call path between two methods.", {**{f"{end}{part}": _S for end in ("from", "to") for part in ("Owner", "Name", "Desc")}, "maxDepth": _I}, [f"{end}{part}" for end in ("from", "to") for part in ("Owner", "Name", "Desc")]),
    "list_issues": ("Indexing issues of one kind.", {"kind": _S}, ["kind"]),
    "find_spring_beans": ("Beans by type, else by name, else all.", {"type": _S, "name": _S}, []),
    "find_spring_injects": ("Injection sites with candidate beans, of one class or all.", {"class": _S}, []),
    "find_spring_autoconfigs": ("Auto-configurations by class, key or format.", {"class": _S, "key": _S, "format": _S}, []),
    "find_spring_autoconfig_conditions": ("Conditions by auto-configuration, required class or type.", {"autoconfigClass": _S, "requiredClass": _S, "type": _S}, []),
    "find_dubbo_services": ("Providers of an interface or all.", {"interface": _S}, []),
    "find_dubbo_references": ("Consumers by interface and consuming class.", {"interface": _S, "consumerClass": _S}, []),
    "find_dubbo_method_configs": ("Per-method settings of a service or a reference.", {"serviceId": _I, "referenceId": _I}, []),
    "find_dubbo_registries": ("Registries by id, else by protocol, else all.", {"registryId": _S, "protocol": _S}, []),
    "find_mybatis_statements": ("Statements of a mapper, or one of them.", {"namespace": _S, "statementId": _S}, []),
    "find_mybatis_result_maps": ("Result maps by mapper, else by row type.", {"namespace": _S, "typeFqn": _S}, []),
}


class Tools:
    """``tables`` maps names of the schema to DataFrames, read anew for each question."""

    def __init__(self, tables: Callable[[], Mapping[str, DataFrame]], dialect: str = "spark", on_miss: Callable[[str], None] | None = None, page: int = PAGE, version: Callable[[], object] | None = None) -> None:
        self.tables, self.dialect, self.on_miss, self.page, self.version = tables, dialect, on_miss, page, version
        self._graph: tuple[object, DataFrame] | None = None

    def _call_graph(self, t: Mapping[str, DataFrame]) -> DataFrame:
        """The call graph, stored once for each version of the tables; without a version it is made for each question."""
        now = self.version() if self.version else None
        if now is None or self._graph is None or self._graph[0] != now:
            self._graph = now, cut(graph.call_graph(t["invokes"], t["methods"], t["classes"]))
        return self._graph[1]

    def call(self, name: str, arguments: Mapping[str, Any] | None) -> dict[str, Any]:
        if name not in CATALOGUE:
            raise KeyError(name)
        return getattr(self, f"_{name}")(self.tables(), dict(arguments or {}))

    def _rows(self, df: DataFrame | None, name: str, arguments: Mapping[str, Any], **more: Any) -> dict[str, Any]:
        if df is None:
            return {name: [], "count": 0, **more}
        offset = int(arguments.get("offset") or 0)
        count = df.count()
        page = schema.presentable(df.orderBy("id").offset(offset).limit(self.page))
        found = [r.asDict(True) for r in page.collect()]
        return {name: found, "count": count, **({"truncated": True} if offset + len(found) < count else {}), **more}

    def _index_status(self, t, a):
        n = {r.table_name: r.n_rows for r in lookup.table_counts({x: t[x] for x in ("classes", "methods", "invokes", "issues")}).collect()}
        return n | {"uncertainReflections": lookup.issues_of(t["issues"], "uncertain_reflect").count(), "dialect": self.dialect}

    def _find_symbol(self, t, a):
        hit = lookup.find_symbol(t["classes"], a.get("prefix", "")).first() if a.get("prefix") else None
        return {"matched": True, "class": hit.asDict(True)} if hit else {"matched": False, "prefix": a.get("prefix", "")}

    def _method(self, t, owner: str, name: str, desc: str):
        return lookup.members(t["methods"], t["classes"], owner, name, desc).first()

    def _describe_method(self, t, a):
        hit = self._method(t, a.get("owner", ""), a.get("name", ""), a.get("desc", ""))
        return {"found": True, "method": hit.asDict(True)} if hit else {"found": False}

    def _ensure(self, t, *owners: str):
        """Classes that are asked for and not known are looked for once, then the tables are read again."""
        if self.on_miss is None:
            return t
        missed = [o for o in owners if o and lookup.find_symbol(t["classes"], o).isEmpty()]
        for o in missed:
            self.on_miss(lookup.norm(o))
        return self.tables() if missed else t

    def _callers_of(self, t, a):
        t = self._ensure(t, a.get("owner", ""))
        calls = lookup.callers(t["invokes"], a.get("owner", ""), a.get("name", ""), a.get("desc", ""), bool(a.get("includeReflect", False)))
        return self._rows(lookup.declared_only(calls, t["methods"], t["classes"]), "callers", a)

    def _callees_of(self, t, a):
        return self._rows(lookup.callees(t["invokes"], int(a.get("callerMethodId", 0))), "callees", a)

    def _find_path(self, t, a):
        t = self._ensure(t, a.get("fromOwner", ""), a.get("toOwner", ""))
        ends = [(lookup.norm(a.get(f"{e}Owner", "")), a.get(f"{e}Name", ""), a.get(f"{e}Desc", "")) for e in ("from", "to")]
        if any(self._method(t, *e) is None for e in ends):
            return {"found": False, "reason": "method not found in DB"}
        start, end = (f"{o}#{n}{d}" for o, n, d in ends)
        edges = self._call_graph(t)
        with scratch(edges.sparkSession):
            path = graph.find_path(edges, start, end, int(a.get("maxDepth", 8)))
        return {"found": True, "path": path} if path else {"found": False}

    def _list_issues(self, t, a):
        return self._rows(lookup.issues_of(t["issues"], a.get("kind")), "issues", a)

    def _find_spring_beans(self, t, a):
        return self._rows(lookup.first_given(t["spring_beans"], ("type_fqn", a.get("type"), True), ("name", a.get("name"), False)), "beans", a)

    def _find_spring_injects(self, t, a):
        if a.get("class") and lookup.find_symbol(t["classes"], a["class"]).isEmpty():
            return {"injects": [], "count": 0, "error": f"class not found: {a['class']}"}
        return self._rows(lookup.injects_of(t["spring_injects"], t["classes"], a.get("class")), "injects", a)

    def _find_spring_autoconfigs(self, t, a):
        return self._rows(lookup.first_given(t["spring_boot_autoconfigs"], ("class_fqn", a.get("class"), False), ("key", a.get("key"), False), ("source_format", a.get("format"), False)), "autoconfigs", a)

    def _find_spring_autoconfig_conditions(self, t, a):
        return self._rows(lookup.first_given(t["spring_autoconfig_conditions"], ("autoconfig_class", a.get("autoconfigClass"), True), ("required_class", a.get("requiredClass"), False), ("condition_type", a.get("type"), False)), "conditions", a)

    def _find_dubbo_services(self, t, a):
        found = lookup.services_of(t["dubbo_services"], a.get("interface"))
        out = self._rows(found, "services", a)
        unknown = found.where("impl_class_id = 0").count() if self.on_miss else 0
        return out | ({"implResolution": "partial", "hint": f"{unknown} services have no known implementation; read their archives ahead and index again"} if unknown else {})

    def _find_dubbo_references(self, t, a):
        return self._rows(lookup.references_of(t["dubbo_references"], a.get("interface"), a.get("consumerClass")), "references", a)

    def _find_dubbo_method_configs(self, t, a):
        service, reference = int(a.get("serviceId") or 0), int(a.get("referenceId") or 0)
        found = lookup.method_configs_of(t["dubbo_method_configs"], service, reference)
        if found is None:
            return {"methodConfigs": [], "count": 0, "error": "serviceId or referenceId is required"}
        return self._rows(found, "methodConfigs", a, parent="service" if service else "reference", parentId=service or reference)

    def _find_dubbo_registries(self, t, a):
        found = lookup.first_given(t["dubbo_registries"], ("registry_id", a.get("registryId"), False), ("protocol", a.get("protocol"), False))
        return self._rows(found.orderBy("id").limit(1) if a.get("registryId") else found, "registries", a)

    def _find_mybatis_statements(self, t, a):
        return self._rows(lookup.statements_of(t["mybatis_statements"], a.get("namespace"), a.get("statementId")), "statements", a)

    def _find_mybatis_result_maps(self, t, a):
        found = lookup.result_maps_of(t["mybatis_result_maps"], a.get("namespace"), a.get("typeFqn"))
        return self._rows(found, "resultMaps", a) if found is not None else {"resultMaps": [], "count": 0, "error": "namespace or typeFqn is required"}
