"""Deeply nested JSON records as an adjacency table, and flat entity tables from it.

Shredding gives one row per node: its record, number, parent, owner (the nearest
enclosing object that is a row of its own), label, ordinal, kind and scalar.
Object nodes are joined with their scalar children and pivoted into one entity
table per label path; ``pos`` is the place in the own array. Recursion over JSON
of any depth isn't expressible with built-in functions, so the walk is an Arrow
batch function without state; everything after it is relational. The walk is told which entities are wanted: only their nodes and naming scalars leave
it, with the rule's number instead of the path. A record is
one row of the input, so no task holds more than one batch of bodies.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from json.decoder import scanstring

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODE_COLUMNS = "record_id bigint, node int, parent int, owner int, owner_pos int, label string, ordinal int, kind string, scalar string, path string, parent_path string"


def latest_fetch(records: DataFrame, key: str = "record_id", at: str = "fetched_at", body: str = "body") -> DataFrame:
    """(key, body) of the fetch with the greatest ``at`` (null lowest), then the greatest body; repeated rows collapse before the shuffle."""
    return records.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(at, body)).alias("_l")).select(key, F.col(f"_l.{body}").alias(body))


def _kind(x: object) -> str:
    if x is None:
        return "null"
    if isinstance(x, bool):
        return "boolean"
    return "object" if isinstance(x, dict) else "array" if isinstance(x, list) else "string" if isinstance(x, str) else "number"


def _scalar(x: object) -> str | None:
    if x is None or isinstance(x, (dict, list)):
        return None
    return x if isinstance(x, str) else json.dumps(x)


_BLANKS = re.compile(r"[ \t\n\r]*")
_SCALAR = re.compile(r"(-?(?:0|[1-9][0-9]*))(\.[0-9]+)?([eE][+-]?[0-9]+)?|true|false|null|NaN|-?Infinity")


def loads(text: str) -> object:
    """The value of a JSON text, of any depth: what is nested deeper than the interpreter's limit is read with a stack of its own."""
    try:
        return json.loads(text)
    except RecursionError:
        return _read_deep(text)


def _read_deep(text: str) -> object:
    """JSON without recursion; raises ValueError where the text isn't JSON."""
    skip = lambda i: _BLANKS.match(text, i).end()
    root: list = []
    stack: list = [root]  # the open arrays and objects
    names: list = [None]  # the member that waits for its value, for each of them
    i, after_value = skip(0), False
    while True:
        here, c = stack[-1], text[i : i + 1]
        if after_value:
            if len(stack) == 1:
                if c:
                    raise ValueError(f"more at {i}")
                return root[0]
            if c == ("}" if isinstance(here, dict) else "]"):
                stack.pop()
                names.pop()
                i = skip(i + 1)
                continue
            if c != ",":
                raise ValueError(f"no comma at {i}")
            i, after_value = skip(i + 1), False
            c = text[i : i + 1]
            if c in ("}", "]", ""):
                raise ValueError(f"nothing at {i}")
        elif c and c == ("}" if isinstance(here, dict) else "]") and not here and len(stack) > 1:
            stack.pop()
            names.pop()
            i, after_value = skip(i + 1), True
            continue
        if isinstance(here, dict):
            if c != '"':
                raise ValueError(f"no name at {i}")
            name, i = scanstring(text, i + 1)
            i = skip(i)
            if text[i : i + 1] != ":":
                raise ValueError(f"no colon at {i}")
            names[-1], i = name, skip(i + 1)
            c = text[i : i + 1]
        if c in ("{", "["):
            value: object = {} if c == "{" else []
            i += 1
        elif c == '"':
            value, i = scanstring(text, i + 1)
        else:
            m = _SCALAR.match(text, i)
            if not m:
                raise ValueError(f"no value at {i}")
            value, i = json.loads(m[0]), m.end()
        if isinstance(here, dict):
            here[names[-1]] = value
        else:
            here.append(value)
        i = skip(i)
        if c in ("{", "["):
            stack.append(value)
            names.append(None)
        else:
            after_value = True


def _embedded(x: object) -> object:
    """A string that holds a JSON object or array stands for that value."""
    if isinstance(x, str) and x.lstrip()[:1] in ("{", "["):
        try:
            inner = loads(x)
        except ValueError:
            return x
        return inner if isinstance(inner, (dict, list)) else x
    return x


def shred_text(text: str | None) -> list[tuple]:
    """Node rows (without the record) of one JSON text; none where it isn't a readable object or array.

    Nodes are numbered in document order from 0. ``label`` is the member name, null in arrays, where
    ``ordinal`` counts from 0; in objects ``ordinal`` is the member's place. ``path`` joins member names by
    ``.``, with ``[]`` for array elements; ``parent_path`` is the parent's. ``owner`` is the nearest enclosing array element (or 0).
    """
    if text is None:
        return []
    try:
        root = loads(text.lstrip("\ufeff"))
    except ValueError:
        return []
    if not isinstance(root, (dict, list)):
        return []
    out: list[tuple] = []
    stack: list[tuple] = [(root, None, 0, 0, None, 0, "$", None)]
    while stack:
        value, parent, owner, owner_pos, label, ordinal, path, above = stack.pop()
        value = _embedded(value)
        node = len(out)
        out.append((node, parent, owner, owner_pos, label, ordinal, _kind(value), _scalar(value), path, above))
        if not isinstance(value, (dict, list)):
            continue
        own = (node, ordinal) if label is None and parent is not None else (owner, owner_pos)
        if isinstance(value, dict):
            stack += [(v, node, *own, k, i, f"{path}.{k}", path) for i, (k, v) in reversed(list(enumerate(value.items())))]
        else:
            below = f"{path}[]"
            stack += [(v, node, *own, None, i, below, path) for i, v in reversed(list(enumerate(value)))]
    return out


def shred(records: DataFrame, key: str = "record_id", body: str = "body", batch: int = 200_000) -> DataFrame:
    """The adjacency table of all bodies, see :func:`shred_text`. Null, empty and unreadable bodies have no rows."""
    names = [x.split()[0] for x in NODE_COLUMNS.split(", ")]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[tuple] = []
            for record, text in zip(pdf["k"], pdf["b"]):
                rows += [(record, *n) for n in shred_text(text)]
                if len(rows) >= batch:
                    yield _frame(rows, names)
                    rows = []
            if rows:
                yield _frame(rows, names)

    return records.select(F.col(key).cast("bigint").alias("k"), F.col(body).alias("b")).where(F.col("b").isNotNull()).mapInPandas(walk, NODE_COLUMNS)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    pdf = pd.DataFrame(rows, columns=names)
    pdf["parent"] = pdf["parent"].astype("Int32")
    return pdf


@dataclass(frozen=True)
class Entity:
    """A child table.

    ``path`` is a regular expression for the path, below the root entity, of the array (or of the lone value in its
    place). ``name`` is the scalar member that names an element, None where the element itself is the name.
    ``members`` makes the members of the object at ``path`` the rows, named by their labels. ``of_owner`` takes
    the place of the enclosing element instead of the own place.
    """

    child: str
    path: str
    name: str | None = None
    members: bool = False
    of_owner: bool = False


ROOT = r"\$(?:\.product)?"
KEPT_COLUMNS = "record_id bigint, node int, parent int, owner int, owner_pos int, label string, ordinal int, kind string, scalar string, entity int"


class Place:
    """What the entities say of one label path: ``row``, the entity whose rows its nodes are; ``naming``, whether its scalars name one;
    ``open``, whether anything below it can matter. Places are looked up by label from their parent's, so a path is matched once in a task."""

    __slots__ = ("rules", "path", "label", "row", "naming", "open", "below")

    def __init__(self, rules: Sequence[tuple], path: str, label: str | None, above: str | None):
        self.rules, self.path, self.label, self.below = rules, path, label, {}
        self.row: int | None = None
        self.naming = self.open = False
        for i, e, own, element in rules:
            self.open |= any(own.fullmatch(path + x, partial=True) or element.fullmatch(path + x, partial=True) for x in (".", "["))
            self.open |= bool(element.fullmatch(path) if e.name is not None else own.fullmatch(path) if e.members else None)
            if e.members:
                if self.row is None and label is not None and above is not None and own.fullmatch(above):
                    self.row = i
            elif self.row is None and element.fullmatch(path):
                self.row = i
            elif e.name is not None and label == e.name and above is not None and element.fullmatch(above):
                self.naming = True

    def child(self, label: str | None) -> Place | None:
        """The place of a member, or (None) of the elements; None if nothing at or below it matters."""
        if label in self.below:
            return self.below[label]
        found: Place | None = Place(self.rules, f"{self.path}[]" if label is None else f"{self.path}.{label}", label, self.path)
        if found.row is None and not found.naming and not found.open:
            found = None
        if len(self.below) < 10_000:
            self.below[label] = found
        return found


def start_place(entities: Sequence[Entity], root: str = ROOT) -> Place:
    """The place of a body."""
    return Place([(i, e, regex.compile(rf"{root}\.{e.path}"), regex.compile(rf"{root}\.{e.path}(?:\[\])?")) for i, e in enumerate(entities)], "$", None, None)


def entity_nodes(text: str | None, entities: Sequence[Entity], start: Place) -> list[tuple]:
    """The node rows (without the record; see :data:`KEPT_COLUMNS`) of one JSON text that are rows of an entity or name one (entity -1).

    Nodes are numbered in document order among those looked at: branches in which nothing matters aren't entered.
    """
    if text is None:
        return []
    try:
        root = loads(text.lstrip("\ufeff"))
    except ValueError:
        return []
    out: list[tuple] = []
    stack: list[tuple] = [(root, None, 0, 0, None, 0, start)]
    node = -1
    while stack:
        value, parent, owner, owner_pos, label, ordinal, place = stack.pop()
        if type(value) is str:
            value = _embedded(value)
        node += 1
        compound = isinstance(value, (dict, list))
        if place.row is not None:
            if entities[place.row].members or (value is not None and (label is None or not isinstance(value, list))):
                out.append((node, parent, owner, owner_pos, label, ordinal, _kind(value), _scalar(value), place.row))
        elif place.naming and not compound:
            out.append((node, parent, owner, owner_pos, label, ordinal, _kind(value), _scalar(value), -1))
        if compound and place.open:
            own = (node, ordinal) if label is None and parent is not None else (owner, owner_pos)
            if isinstance(value, dict):
                members = [(v, node, *own, k, i, place.child(k)) for i, (k, v) in enumerate(value.items())]
            else:
                below = place.child(None)
                members = [(v, node, *own, None, i, below) for i, v in enumerate(value)] if below else []
            stack += [m for m in reversed(members) if m[6] is not None]
    return out


def shred_entities(records: DataFrame, entities: Sequence[Entity], *, key: str = "record_id", body: str = "body", root: str = ROOT, batch: int = 200_000) -> DataFrame:
    """The part of the adjacency table that the entities need, with the entity's number in place of the paths."""
    names = [x.split()[0] for x in KEPT_COLUMNS.split(", ")]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        start = start_place(entities, root)
        for pdf in batches:
            rows: list[tuple] = []
            for record, text in zip(pdf["k"], pdf["b"]):
                rows += [(record, *n) for n in entity_nodes(text, entities, start)]
                if len(rows) >= batch:
                    yield _frame(rows, names)
                    rows = []
            if rows:
                yield _frame(rows, names)

    return records.select(F.col(key).cast("bigint").alias("k"), F.col(body).alias("b")).where(F.col("b").isNotNull()).mapInPandas(walk, KEPT_COLUMNS)


def entity_rows(nodes: DataFrame, entities: Sequence[Entity]) -> DataFrame:
    """(record_id, child, node, owner, pos, name): the rows of all entity tables; ``owner`` is the row they belong to (0: the record).

    The elements of an array are rows, and so is a lone value in its place, at 0. Null elements are no rows but
    keep their place. A null or missing name is the empty string. ``nodes`` is what :func:`shred_entities` keeps; object nodes
    and their naming scalars meet by (record, object) in one grouped
    merge, so the bodies are walked once. An object has few naming scalars: no group grows with the data.
    """
    row = F.col("entity") >= 0
    merged = (
        nodes.select(
            "record_id",
            F.when(row, F.col("node")).otherwise(F.col("parent")).alias("node"),
            F.when(row, F.struct("entity", "owner", "owner_pos", "label", "ordinal", "kind", "scalar")).alias("_row"),
            F.when(~row, F.col("scalar")).alias("_name"),
        )
        .groupBy("record_id", "node")
        .agg(F.max("_row").alias("_row"), F.max("_name").alias("_name"))
        .where(F.col("_row").isNotNull())
        .select("record_id", "node", "_row.*", "_name")
    )
    pick = lambda f: F.element_at(F.array(*(f(e) for e in entities)), F.col("entity") + 1)
    array_place = F.when(F.col("label").isNull(), F.col("ordinal")).otherwise(0)
    return merged.select(
        "record_id",
        pick(lambda e: F.lit(e.child)).alias("child"),
        "node",
        "owner",
        F.when(pick(lambda e: F.lit(e.of_owner)), F.col("owner_pos")).otherwise(array_place).alias("pos"),
        F.coalesce(F.when(pick(lambda e: F.lit(e.members)), F.col("label")).when(F.col("kind") == "object", F.col("_name")).otherwise(F.col("scalar")), F.lit("")).alias("name"),
    )


#: The child tables of a product record.
VARIANT = r"nutrition_variants(?:\[\])?"
PRODUCT_ENTITIES = (
    Entity("variant", "nutrition_variants", "label"),
    Entity("variant_other", VARIANT + r"\.nutrition\.other", members=True, of_owner=True),
    Entity("variant_size", VARIANT + r"\.sizes", "label", of_owner=True),
    Entity("contains", r"allergens\.contains"),
    Entity("partial", r"allergens\.partial", "name"),
    Entity("price", "price_history", "date"),
)


def product_children(records: DataFrame) -> DataFrame:
    """The child tables of product records, of each record's latest fetch."""
    return entity_rows(shred_entities(latest_fetch(records), PRODUCT_ENTITIES), PRODUCT_ENTITIES)
