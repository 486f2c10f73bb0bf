"""Deeply nested records into related flat tables.

Method: the documents' merged schema is inferred, then every array level is exploded into a child table, from the
top down. A child row carries its parent's surrogate key and its ordinal in the parent's list; its own surrogate
key is the parent's key, the field and the ordinal, so the chain of parents can be read back from it and needs no
counter that all tasks would share.

Inference is one aggregate for the root and one for each depth below it, over all documents and for all fields of
that depth at once. A field is a level if any document has a list there; where a field only ever holds one object,
the lists inside it are levels by their path; a list whose items are lists has a level of its own, "[]". There is
no bound on the depth: it ends where no field holds a list or an object.

Lists come in four stored forms, and all are read: an array, an array written again as JSON text, an object whose
keys are the ordinals, and (of a field that is a list elsewhere) one bare object. Text counts as a list for
inference only if objects or lists are in it: "[1]" may be a remark. Nulls in a list keep their place and give no
row. A document that is not valid JSON gives no rows; it is listed by :func:`invalid_documents`.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Level:
    """One list inside its parent: the fields that lead to it (none, if the parent's item is the list), and the lists inside its own items."""

    path: tuple[str, ...]
    children: tuple["Level", ...] = ()

    @property
    def name(self) -> str:
        return ".".join(self.path) or "[]"


def parse_documents(df: DataFrame, text: str, into: str = "doc") -> DataFrame:
    """Adds ``into``, the parsed document: null where the text is null or not valid JSON."""
    return df.withColumn(into, F.try_parse_json(F.col(text)))


def invalid_documents(df: DataFrame, text: str) -> DataFrame:
    """Rows whose text is not null but is no valid JSON."""
    return df.filter(F.col(text).isNotNull() & F.try_parse_json(F.col(text)).isNull())


def merged_schema(df: DataFrame, doc: str = "doc") -> str:
    """The documents' merged schema, as text. A field of conflicting types is ``VARIANT`` in it."""
    return df.agg(F.schema_of_variant_agg(F.col(doc)).alias("s")).first()["s"] or "VOID"


def schema_fields(schema: str) -> list[tuple[str, str]]:
    """(name, kind) of the fields at the top of a merged schema."""
    inner = re.fullmatch(r"OBJECT<(.*)>", schema or "", re.S)
    found, at, text = [], 0, inner[1] if inner else ""
    while m := re.compile(r"\s*(`(?:[^`]|``)*`|[^:,\s]+):\s*", re.S).match(text, at):
        start, depth, at = m.end(), 0, m.end()
        while at < len(text) and (depth or text[at] != ","):
            depth += {"<": 1, ">": -1}.get(text[at], 0)
            at += 1
        name = m[1][1:-1].replace("``", "`") if m[1].startswith("`") else m[1]
        found.append((name, text[start:at].strip()))
        at += 1
    return found


def inside(doc: Column, path: tuple[str, ...]) -> Column:
    """What the fields of ``path`` lead to, whatever signs their names are made of; null where one is absent."""
    for name in path:
        if re.fullmatch(r"[A-Za-z_]\w*", name):
            doc = F.try_variant_get(doc, f"$.{name}", "variant")
        else:
            doc = F.try_element_at(F.try_variant_get(doc, "$", "map<string,variant>"), F.lit(name))
    return doc


#: Keys of an object that may be ordinals: as many digits as a long has for sure.
ORDINAL = "^[0-9]{1,18}$"


def entries(v: Column) -> Column:
    """The list in ``v``, whatever its stored form, as an array of (ord from 1, item); null if it is none.

    An object with only whole numbers for keys is a list whose keys are the ordinals; an empty one
    is an empty list; any other object is a list of one.
    """
    array = lambda x: F.try_variant_get(x, "$", "array<variant>")
    pairs = lambda x: F.map_entries(F.try_variant_get(x, "$", "map<string,variant>"))
    placed = lambda a: F.transform(a, lambda x, i: F.struct((i + 1).cast("long").alias("ord"), x.alias("item")))
    numbered = lambda p: F.transform(p, lambda e: F.struct(e["key"].cast("long").alias("ord"), e["value"].alias("item")))
    digits = lambda p: F.forall(p, lambda e: e["key"].rlike(ORDINAL))
    single = lambda x: F.array(F.struct(F.lit(1).cast("long").alias("ord"), x.alias("item")))

    def read(x: Column) -> Column:
        # Each lambda variable is computed once, where a repeated expression would be computed anew.
        def of_object(p: Column) -> Column:
            return F.when(digits(p), numbered(p)).otherwise(single(x))

        return F.coalesce(placed(array(x)), F.get(F.transform(F.filter(F.array(pairs(x)), lambda p: p.isNotNull()), of_object), F.lit(0)))

    once = F.transform(F.array(v), lambda x: F.coalesce(read(x), read(F.try_parse_json(F.try_variant_get(x, "$", "string")))))
    return F.get(once, F.lit(0))


def is_null_item(v: Column) -> Column:
    return v.isNull() | F.is_variant_null(v)


def child_table(parent: DataFrame, path: tuple[str, ...], sk: str = "sk", doc: str = "doc", keep: tuple[str, ...] = ()) -> DataFrame:
    """The rows of the list that ``path`` leads to inside ``parent``'s documents: keep…, parent_sk, ordinal, sk, doc."""
    return (
        parent.select(*keep, F.col(sk).alias("parent_sk"), F.explode(entries(inside(F.col(doc), path))).alias("e"))
        .select(*keep, "parent_sk", F.col("e.ord").alias("ordinal"), F.col("e.item").alias("doc"))
        .filter(~is_null_item(F.col("doc")))
        .withColumn("sk", F.concat_ws("/", "parent_sk", F.concat(F.lit(Level(path).name), F.lit(":"), F.col("ordinal"))))
    )


def _signs(v: Column) -> Column:
    """What a value shows of being a list: (is_list, item) for each item of a list, or for a bare object itself."""
    kind = F.schema_of_variant
    array = lambda x: F.try_variant_get(x, "$", "array<variant>")
    pairs = lambda x: F.map_entries(F.try_variant_get(x, "$", "map<string,variant>"))
    one = lambda is_list: lambda x: F.struct(F.lit(is_list).alias("is_list"), x.alias("item"))
    numbered = lambda p: (F.size(p) > 0) & F.forall(p, lambda e: e["key"].rlike(ORDINAL))

    def of_object(x: Column) -> Column:
        p = pairs(x)
        return F.when(numbered(p), F.transform(p, lambda e: one(True)(e["value"]))).otherwise(F.array(one(False)(x)))

    def read(x: Column) -> Column:
        return F.when(kind(x).startswith("ARRAY"), F.transform(array(x), one(True))).when(kind(x).startswith("OBJECT"), of_object(x))

    text = F.try_variant_get(v, "$", "string")
    parsed = F.try_parse_json(F.when(text.rlike(r"^\s*[\[{]"), text))
    deep = F.filter(read(parsed), lambda e: kind(e["item"]).rlike("^(OBJECT|ARRAY)"))
    return F.when(kind(v) == "STRING", deep).otherwise(read(v))


@dataclass
class _Node:
    """A kind of document whose fields are looked through: the lists found in its level so far, the fields that lead from
    the level's items to it, its merged schema, whether it may be a list itself, and the levels known to be inside."""

    level: list
    path: tuple[str, ...]
    schema: str
    lists: bool
    known: tuple[Level, ...]

    def candidates(self) -> list[tuple[tuple[str, ...], Column]]:
        """The fields that may hold a list, by path, with what they hold where it may be one."""
        doc = F.col("doc")
        out = [((), doc)] if self.lists else []
        for name, kind in schema_fields(self.schema):
            v = inside(doc, (name,))
            if kind.startswith(("ARRAY", "OBJECT", "VARIANT")):
                out.append(((*self.path, name), v))
            elif kind == "STRING":
                # Mere text is dropped here, before anything is made of it.
                out.append(((*self.path, name), F.when(F.try_variant_get(v, "$", "string").rlike(r"^\s*[\[{]"), v)))
        return out


def infer_levels(df: DataFrame, doc: str = "doc", known: tuple[Level, ...] = ()) -> tuple[Level, ...]:
    """The tree of lists in the documents: an aggregate for the root, and one for each depth.

    ``known`` names fields that mean a list even where these documents only ever hold one bare object; one that
    no document has is no level all the same. All kinds of documents of one depth are rows of one frame, so every
    depth reads and parses the documents once. What comes to the driver is one row for each field that may hold a
    list, never one for a document.
    """
    rows = df.select(F.lit(0).alias("node"), F.col(doc).alias("doc")).filter(F.col("doc").isNotNull())
    kind = F.schema_of_variant(F.col("doc"))
    root: list = []
    first = rows.agg(F.schema_of_variant_agg(F.when(kind.startswith("OBJECT"), F.col("doc"))).alias("s"), F.bool_or(kind.startswith("ARRAY")).alias("lists")).first()
    nodes = [_Node(root, (), first["s"] or "VOID", bool(first["lists"]), known)]
    while True:
        asked, found = [], F
        for k, node in enumerate(nodes):
            values = []
            for path, v in node.candidates():
                values.append(F.struct(F.lit(len(asked)).alias("n"), v.alias("v")))
                asked.append((node, path))
            if values:
                found = found.when(F.col("node") == k, F.filter(F.array(*values), lambda e: e["v"].isNotNull()))
        if not asked:
            break
        held = rows.select(F.explode(found).alias("e")).select("e.*").filter(F.schema_of_variant("v").rlike("^(ARRAY|OBJECT|STRING$)"))
        signs = held.select("n", F.explode(_signs(F.col("v"))).alias("e")).select("n", "e.*")
        kind = F.schema_of_variant(F.col("item"))
        seen = signs.groupBy("n").agg(F.bool_or("is_list").alias("level"), F.schema_of_variant_agg(F.when(kind.startswith("OBJECT"), F.col("item"))).alias("s"), F.bool_or(F.col("is_list") & kind.startswith("ARRAY")).alias("lists"))
        nodes, places = [], F
        for r in sorted(seen.collect(), key=lambda r: r["n"]):
            node, path = asked[r["n"]]
            told = next((level for level in node.known if level.path == path), None)
            if r["level"] or told:
                below: list = []
                node.level.append((path, below))
                after = _Node(below, (), r["s"] or "VOID", bool(r["lists"]), told.children if told else ())
            else:
                after = _Node(node.level, path, r["s"] or "VOID", False, node.known)
            places = places.when(F.col("n") == r["n"], len(nodes))
            nodes.append(after)
        if not nodes:
            break
        rows = signs.select(places.alias("node"), F.col("item").alias("doc"))
    tree = lambda levels: tuple(Level(path, tree(below)) for path, below in levels)
    return tree(root)


def flatten(df: DataFrame, key: str, doc: str = "doc", levels: tuple[Level, ...] | None = None) -> dict[str, DataFrame]:
    """All tables of the nested documents, by path: "" is the root, "parts", "parts.tracks" and so on.

    ``levels`` names the lists to explode; None infers them. Every table has ``sk``; children have
    ``parent_sk``, ``ordinal`` and the root's ``key``. Rows with a null document give nothing.
    """
    root = df.filter(F.col(doc).isNotNull()).select(F.col(key), F.col(key).cast("string").alias("sk"), F.col(doc).alias("doc"))
    tables = {"": root}

    def down(parent: DataFrame, prefix: str, below: tuple[Level, ...]) -> None:
        for level in below:
            name = f"{prefix}.{level.name}" if prefix else level.name
            tables[name] = child_table(parent, level.path, keep=(key,))
            down(tables[name], name, level.children)

    down(root, "", infer_levels(root) if levels is None else levels)
    return tables


def level_names(levels: tuple[Level, ...], prefix: str = "") -> list[str]:
    """The names of all tables below the root, as :func:`flatten` gives them."""
    out = []
    for level in levels:
        name = f"{prefix}.{level.name}" if prefix else level.name
        out += [name, *level_names(level.children, name)]
    return out


def text_of(doc: Column, name: str) -> Column:
    """A scalar field as text; null where it is absent, null or no scalar."""
    v = F.try_variant_get(doc, f"$.{name}", "variant")
    return F.when(~F.schema_of_variant(v).rlike("^(OBJECT|ARRAY|VOID)"), F.try_variant_get(doc, f"$.{name}", "string"))


def whole_of(doc: Column, name: str) -> Column:
    """A number stored as a number or as text, as a long; null where it is neither."""
    return F.regexp_extract(text_of(doc, name), r"^\s*([-+]?[0-9]+)\s*$", 1).try_cast("long")


def flag_of(doc: Column, name: str) -> Column:
    """A truth value stored as boolean, text or number."""
    t = F.lower(F.trim(text_of(doc, name)))
    return F.when(t.isin("true", "1", "yes"), True).when(t.isin("false", "0", "no", ""), False)
