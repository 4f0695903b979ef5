"""The interface language: its parser, and the rules a document must keep. Plain text, parsed where it is (a row each).

A document has @interface Name { methods and annotations }, @impl Name { pairs and annotations }, and annotations
@name { ... }. Values are booleans, null, numbers, strings, arrays, objects and names; commas between them may be left
out, and // and /* */ comments may stand anywhere.
"""

from __future__ import annotations

import json
import re
from typing import Any

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(r"""\s+|//[^\n]*|/\*.*?\*/|(?P<string>"(?:[^"\\]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(?P<number>-?\d+(?:\.\d+)?)|(?P<name>[A-Za-z][A-Za-z0-9_.]*)|(?P<mark>->|[@{}\[\]():,])""", re.S)
# What these annotations allow.
CONCURRENCY = ("thread_safe", "single_threaded", "immutable", "reentrant")
ENCODINGS = ("utf8", "utf16", "ascii", "cesu8")


class Malformed(ValueError):
    pass


class _Reader:
    def __init__(self, text: str):
        self.tokens, self.at, end = [], 0, 0
        while end < len(text):
            m = _TOKEN.match(text, end)
            if not m:
                raise Malformed(f"at {end}: {text[end : end + 20]!r}")
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m.group()))
            end = m.end()

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ("end", "")

    def take(self, value: str | None = None, kind: str | None = None) -> str:
        found = self.peek()
        if (value is not None and found[1] != value) or (kind is not None and found[0] != kind) or found[0] == "end":
            raise Malformed(f"expected {value or kind}, found {found[1] or 'the end'}")
        self.at += 1
        return found[1]

    def met(self, value: str) -> bool:
        hit = self.peek() == ("mark", value)
        self.at += hit
        return hit

    def value(self) -> Any:
        kind, text = self.peek()
        if kind == "string":
            return json.loads(self.take())
        if kind == "number":
            return float(self.take())
        if kind == "name":
            return {"true": True, "false": False, "null": "null"}.get(self.take(), text)
        if self.met("["):
            out = []
            while not self.met("]"):
                out.append(self.value())
                self.met(",")
            return out
        return self.body()

    def body(self) -> dict[str, Any]:
        """Pairs, nested annotations and named blocks between braces."""
        self.take("{")
        out: dict[str, Any] = {}
        while not self.met("}"):
            if self.met("@"):
                out[self.take(kind="name")] = self.body()
            else:
                key = self.take(kind="name")
                out[key] = self.value() if self.met(":") else self.body()
            self.met(",")
        return out

    def type_name(self) -> str:
        name = self.take(kind="name")
        if self.met("["):
            self.take("]")
            return name + "[]"
        return name

    def method(self) -> dict[str, Any]:
        name, params = self.take(kind="name"), []
        self.take("(")
        while not self.met(")"):
            own = self.take(kind="name")
            self.take(":")
            params.append({"name": own, "type": self.type_name()})
            if self.peek()[1] != ")":
                self.take(",")
        self.take("->")
        return {"name": name, "params": params, "returns": self.type_name()}


def parse(text: str) -> dict[str, list]:
    """interfaces (name, methods, annotations), implementations (name, attributes, annotations), annotations."""
    r = _Reader(text)
    out: dict[str, list] = {"interfaces": [], "implementations": [], "annotations": []}
    while r.peek()[0] != "end":
        r.take("@")
        tag = r.take(kind="name")
        if tag not in ("interface", "impl"):
            out["annotations"].append({"name": tag, "body": r.body()})
            continue
        made: dict[str, Any] = {"name": r.take(kind="name"), "methods": [], "attributes": {}, "annotations": []}
        r.take("{")
        while not r.met("}"):
            if r.met("@"):
                made["annotations"].append({"name": r.take(kind="name"), "body": r.body()})
            elif tag == "interface":
                made["methods"].append(r.method())
            else:
                key = r.take(kind="name")
                r.take(":")
                made["attributes"][key] = r.value()
        out["interfaces" if tag == "interface" else "implementations"].append(made)
    return out


def _texts(v: Any) -> list[str]:
    return [x for x in v if isinstance(x, str)] if isinstance(v, list) else []


def _annotation_problems(name: str, b: dict[str, Any]) -> list[str]:
    text = lambda k: b[k] if isinstance(b.get(k), str) else None
    if name == "contract":
        rest = set(b) - {"codec", "profile", "container", "ensures", "complexity"}
        return ["Contract missing descriptive fields (codec, etc.)"] if text("codec") is None and not rest else []
    if name == "effects":
        c = text("concurrency")
        return [f"Invalid concurrency value: {c}"] if c is not None and c not in CONCURRENCY else []
    if name == "permissions":
        return [] if _texts(b.get("allow")) or _texts(b.get("deny")) or b.get("sandbox") else ["Permissions annotation is empty"]
    if name == "resources":
        peak = b["memory"].get("peak") if isinstance(b.get("memory"), dict) else None
        return ["Resource memory peak cannot be empty"] if peak == "" else []
    if name == "protocol":
        states, initial = _texts(b.get("states")), text("initial")
        out = ["Protocol with states must have an initial state"] if states and initial is None else []
        return out + ([f"Initial state '{initial}' not found in states list"] if initial is not None and initial not in states else [])
    if name == "abi":
        e = text("string_encoding")
        return [f"Invalid string encoding: {e}"] if e is not None and e not in ENCODINGS else []
    return []


def problems(doc: dict[str, list]) -> list[tuple[str, str]]:
    """(message, where) of every rule that the document breaks."""
    out, seen = [], set()
    for i in doc["interfaces"]:
        if i["name"] in seen:
            out.append((f"Duplicate interface name: {i['name']}", "root"))
        seen.add(i["name"])
        methods: set[str] = set()
        for m in i["methods"]:
            if m["name"] in methods:
                out.append((f"Duplicate method name: {m['name']}", i["name"]))
            methods.add(m["name"])
        out += [(p, i["name"]) for a in i["annotations"] for p in _annotation_problems(a["name"], a["body"])]
    out += [(f"Implementation name '{x['name']}' should be in 'Interface.Implementation' format", x["name"]) for x in doc["implementations"] if "." not in x["name"]]
    return out


_FIELDS = {"parsed": T.BooleanType(), "interfaces": T.ArrayType(T.StringType()), "methods": T.ArrayType(T.StringType()), "implementations": T.ArrayType(T.StringType()), "problems": T.ArrayType(T.StringType())}
CHECKED = T.StructType([T.StructField(k, v) for k, v in _FIELDS.items()])


@F.pandas_udf(CHECKED)
def checked(source: pd.Series) -> pd.DataFrame:
    """parsed, interfaces, methods (interface.method), implementations and problems of documents."""
    rows = []
    for text in source.fillna(""):
        try:
            d = parse(text)
        except Malformed as e:
            rows.append((False, [], [], [], [str(e)]))
            continue
        rows.append((True, [i["name"] for i in d["interfaces"]], [f"{i['name']}.{m['name']}" for i in d["interfaces"] for m in i["methods"]], [i["name"] for i in d["implementations"]], [p for p, _ in problems(d)]))
    return pd.DataFrame(rows, columns=list(_FIELDS))
