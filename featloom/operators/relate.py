"""Relational feature synthesis: aggregate, direct and stacked features.

Definitions are frozen value objects; computing them compiles to one
`groupBy(foreign key)` per relationship, merges of those groups along longer
paths, and joins on unique keys.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featloom.core import checkpointed, clean, col, is_datetime, is_numeric, require_columns, rows_frame
from featloom.functions.columns import haversine, num_characters, num_words
from featloom.functions.moments import finished, merged, moments
from featloom.operators.split import fraction_sample, require_unique_key
from featloom.sources.registry import dataset_info, sanitise_names

# fixed values: default primitives
AGGREGATIONS = ["sum", "std", "max", "skew", "min", "mean", "count", "percent_true", "num_unique", "mode"]
TRANSFORMS = ["day", "year", "month", "weekday", "haversine", "num_words", "num_characters"]

_NUMERIC_AGGS = {"sum", "std", "max", "skew", "min", "mean"}
# fixed values: what may be stacked on what at depth two
_NO_SELF_STACK = {"sum", "std", "max", "min", "count", "num_unique", "skew"}
_ZERO_WHEN_CHILDLESS = {"sum", "count", "percent_true"}
_TEXT_TRANSFORMS = {"num_words", "num_characters"}
_DATE_TRANSFORMS = {"day", "year", "month", "weekday"}


def default_primitives() -> dict[str, list[str]]:
    return {"agg": list(AGGREGATIONS), "transform": list(TRANSFORMS)}


@dataclass(frozen=True)
class Relation:
    parent: str
    parent_key: str
    child: str
    child_key: str


@dataclass(frozen=True)
class Feature:
    """One column of an entity: how it is computed from which columns."""

    entity: str
    kind: str  # identity | transform | aggregate | direct
    kind_of_value: str  # numeric | categorical | boolean | datetime | text
    name: str
    primitive: str | None = None
    columns: tuple[str, ...] = ()
    base: Feature | None = None
    path: tuple[Relation, ...] = ()

    @property
    def depth(self) -> int:
        own = 0 if self.kind == "identity" else 1
        return own + (self.base.depth if self.base is not None else 0)

    @property
    def zero_default(self) -> bool:
        return self.kind == "aggregate" and self.primitive in _ZERO_WHEN_CHILDLESS


@dataclass
class Entity:
    data: DataFrame
    key: str
    text: frozenset[str] = frozenset()
    coordinates: tuple[tuple[str, str], ...] = ()


@dataclass
class EntitySet:
    """Named tables with unique keys and parent -> child relations."""

    entities: dict[str, Entity] = field(default_factory=dict)
    relations: list[Relation] = field(default_factory=list)

    def add_entity(
        self, name: str, data: DataFrame, key: str, *, text: Iterable[str] = (),
        coordinates: Sequence[tuple[str, str]] = (), check_key: bool = True,
    ) -> EntitySet:
        """`coordinates` lists (latitude, longitude) column pairs."""
        if name in self.entities:
            raise ValueError(f"entity already exists: {name}")
        require_columns(data, [key, *text, *[c for pair in coordinates for c in pair]])
        if check_key:
            require_unique_key(data, key)
        self.entities[name] = Entity(data, key, frozenset(text), tuple(tuple(p) for p in coordinates))
        return self

    def add_relation(self, parent: str, parent_key: str, child: str, child_key: str) -> EntitySet:
        for name, key in ((parent, parent_key), (child, child_key)):
            if name not in self.entities:
                raise ValueError(f"unknown entity: {name}")
            require_columns(self.entities[name].data, [key])
        if self.entities[parent].key != parent_key:
            raise ValueError(f"{parent_key} is not the key of {parent}")
        if parent in self._below(child) or parent == child:
            raise ValueError("relations must not form a cycle")
        self.relations.append(Relation(parent, parent_key, child, child_key))
        return self

    def _below(self, name: str) -> set[str]:
        found: set[str] = set()
        for r in self.relations:
            if r.parent == name:
                found |= {r.child} | self._below(r.child)
        return found

    def keys_of(self, name: str) -> set[str]:
        return {self.entities[name].key} | {r.child_key for r in self.relations if r.child == name}

    def relations_frame(self) -> DataFrame:
        spark = next(iter(self.entities.values())).data.sparkSession
        rows = [(r.parent, r.parent_key, r.child, r.child_key) for r in self.relations]
        return rows_frame(spark, rows, "parent string, parent_key string, child string, child_key string")


# ------------------------------------------------------------- definitions
def _value_kind(entity: Entity, f: T.StructField) -> str:
    if f.name in entity.text:
        return "text"
    if isinstance(f.dataType, T.BooleanType):
        return "boolean"
    if is_numeric(f.dataType):
        return "numeric"
    if is_datetime(f.dataType):
        return "datetime"
    return "categorical"


def _own_features(es: EntitySet, name: str, transforms: Sequence[str], depth: int) -> list[Feature]:
    entity = es.entities[name]
    keys = es.keys_of(name)
    out = [
        Feature(name, "identity", _value_kind(entity, f), f.name)
        for f in entity.data.schema.fields
        if f.name not in keys
    ]
    if depth < 1:
        return out
    for base in list(out):
        for p in transforms:
            fits = (p in _DATE_TRANSFORMS and base.kind_of_value == "datetime") or (
                p in _TEXT_TRANSFORMS and base.kind_of_value == "text"
            )
            if fits:
                kind = "numeric" if p in _TEXT_TRANSFORMS else "categorical"
                out.append(Feature(name, "transform", kind, f"{p.upper()}({base.name})", p, (base.name,), base))
    if "haversine" in transforms:
        pairs = entity.coordinates
        for i, a in enumerate(pairs):
            for b in pairs[i + 1 :]:
                label = f"HAVERSINE({a[0]}, {a[1]}, {b[0]}, {b[1]})"
                # inputs are stored columns, so the depth is one
                base = next(f for f in out if f.name == a[0])
                out.append(Feature(name, "transform", "numeric", label, "haversine", (*a, *b), base))
    return out


def _may_stack(primitive: str, base: Feature) -> bool:
    if base.kind == "direct":
        return True
    if base.kind != "aggregate":
        return True
    if primitive in ("skew", "percent_true"):
        return primitive != base.primitive and primitive == "skew"
    if primitive == base.primitive and primitive in _NO_SELF_STACK:
        return False
    return not (primitive == "sum" and base.primitive == "count")


def _paths_down(es: EntitySet, name: str) -> list[tuple[Relation, ...]]:
    out = []
    for r in es.relations:
        if r.parent == name:
            out.append((r,))
            out += [(r, *rest) for rest in _paths_down(es, r.child)]
    return out


def _features_of(
    es: EntitySet, name: str, aggs: Sequence[str], transforms: Sequence[str], depth: int, arrived: tuple[Relation, ...] = ()
) -> list[Feature]:
    """All features of an entity up to a depth; never back over an arrival relation."""
    out = _own_features(es, name, transforms, depth)
    if depth < 1:
        return out
    for path in _paths_down(es, name):
        if any(r in arrived for r in path):
            continue
        child = path[-1].child
        if "count" in aggs:
            out.append(Feature(name, "aggregate", "numeric", f"COUNT({child})", "count", path=path))
        for base in _features_of(es, child, aggs, transforms, depth - 1, (*arrived, *path)):
            for p in aggs:
                fits = (
                    (p in _NUMERIC_AGGS and base.kind_of_value == "numeric")
                    or (p == "percent_true" and base.kind_of_value == "boolean")
                    or (p in ("num_unique", "mode") and base.kind_of_value in ("categorical", "boolean"))
                )
                if p == "count" or not fits or not _may_stack(p, base):
                    continue
                kind = base.kind_of_value if p == "mode" else "numeric"
                out.append(
                    Feature(name, "aggregate", kind, f"{p.upper()}({child}.{base.name})", p, base=base, path=path)
                )
    for r in es.relations:
        if r.child == name and r not in arrived:
            for base in _features_of(es, r.parent, aggs, transforms, depth - 1, (*arrived,)):
                if base.kind == "aggregate" and r in base.path and base.path[0] != r:
                    continue
                out.append(Feature(name, "direct", base.kind_of_value, f"{r.parent}.{base.name}", base=base, path=(r,)))
    seen: set[str] = set()
    unique = []
    for f in out:
        if f.name not in seen:
            seen.add(f.name)
            unique.append(f)
    return unique


def feature_definitions(
    es: EntitySet, target: str, agg: Sequence[str] = tuple(AGGREGATIONS),
    transform: Sequence[str] = tuple(TRANSFORMS), max_depth: int = 2,
) -> list[Feature]:
    """Frozen definitions for the target entity; raw dates and texts are inputs only."""
    if target not in es.entities:
        raise ValueError(f"name one of {sorted(es.entities)} as the target")
    unknown = [p for p in agg if p not in AGGREGATIONS] + [p for p in transform if p not in TRANSFORMS]
    if unknown:
        raise ValueError(f"unknown primitives: {unknown}")
    found = _features_of(es, target, agg, transform, max_depth)
    return [f for f in found if f.kind_of_value in ("numeric", "categorical", "boolean")]


# --------------------------------------------------------------- computing
def _transform_expr(f: Feature) -> Column:
    c = [col(x) for x in f.columns]
    match f.primitive:
        case "day":
            return F.dayofmonth(c[0])
        case "month":
            return F.month(c[0])
        case "year":
            return F.year(c[0])
        case "weekday":
            return F.weekday(c[0])
        case "num_words":
            return num_words(c[0])
        case "num_characters":
            return num_characters(c[0])
    return haversine(*[clean(x) for x in c])


class _Synthesis:
    """Tables of one request: every child table is grouped once per relation, whatever the length of the paths over it.

    A relation's groups hold mergeable moments of all columns that any feature needs there. Longer paths merge the
    groups of the level below instead of joining its rows. Groups that serve several paths are written once.
    """

    def __init__(self, es: EntitySet, features: Sequence[Feature]):
        self.es = es
        self.bases: dict[tuple[Relation, int], dict[str, tuple[Feature, set[str]]]] = {}
        self.paths: dict[tuple[Relation, int], set[tuple[Relation, ...]]] = {}
        self.groups: dict[tuple[Relation, int], DataFrame] = {}
        self.values: dict[tuple[Relation, int], DataFrame] = {}
        self.types: dict[tuple[Relation, int], dict[str, T.DataType]] = {}
        self.by_depth = _circular(features)
        for f in features:
            self._ask(f)

    def _slot(self, f: Feature) -> tuple[Relation, int]:
        # By depth only where two relations need each other's groups: then the shallower ones come first.
        return f.path[-1], (f.base.depth if f.base is not None else 0) if self.by_depth else 0

    def _ask(self, f: Feature) -> None:
        if f.kind == "aggregate":
            wanted = self.bases.setdefault(self._slot(f), {})
            self.paths.setdefault(self._slot(f), set()).add(f.path)
            if f.base is not None:
                wanted.setdefault(f.base.name, (f.base, set()))[1].add(f.primitive)
        if f.base is not None:
            self._ask(f.base)

    def entity_table(self, name: str, features: Sequence[Feature]) -> DataFrame:
        """Keys of the entity plus the requested feature columns."""
        es, entity = self.es, self.es.entities[name]
        keys = sorted(es.keys_of(name))
        own = [f for f in features if f.kind == "identity" and f.name not in keys]
        made = [f for f in features if f.kind == "transform"]
        df = entity.data.select(
            *[col(k) for k in keys], *[col(f.name) for f in own], *[_transform_expr(f).alias(f.name) for f in made]
        )
        by_path: dict[tuple[Relation, ...], list[Feature]] = {}
        by_parent: dict[Relation, list[Feature]] = {}
        for f in features:
            if f.kind == "aggregate":
                by_path.setdefault(f.path, []).append(f)
            elif f.kind == "direct":
                by_parent.setdefault(f.path[0], []).append(f)
        for relation, wanted in by_parent.items():
            parent = self.entity_table(relation.parent, _distinct([f.base for f in wanted]))
            picked = parent.select(
                col(relation.parent_key).alias("_pk"), *[col(f.base.name).alias(f.name) for f in wanted]
            )
            # the parent key is unique: one match per row, and a hot foreign key is split by AQE
            df = df.join(picked, col(relation.child_key) == F.col("_pk"), "left").drop("_pk")
        for path, wanted in by_path.items():
            for part in self.aggregates(path, wanted):
                df = df.join(part, col(path[0].parent_key) == F.col("_fk"), "left").drop("_fk")
        zeros = {f.name for f in features if f.zero_default}
        if zeros:
            df = df.select(
                *[F.coalesce(col(c), F.lit(0).cast(df.schema[c].dataType)).alias(c) if c in zeros else col(c) for c in df.columns]
            )
        return df

    def aggregates(self, path: tuple[Relation, ...], wanted: Sequence[Feature]) -> list[DataFrame]:
        """Aggregate tables keyed by `_fk`, one for moments and one for values."""
        by_slot: dict[tuple[Relation, int], list[Feature]] = {}
        for f in wanted:
            by_slot.setdefault(self._slot(f), []).append(f)
        out = []
        for slot, features in by_slot.items():
            spot = {name: i for i, name in enumerate(self.bases[slot])}
            simple = [f for f in features if f.primitive not in ("mode", "num_unique")]
            counted = [f for f in features if f.primitive in ("mode", "num_unique")]
            if simple:
                groups = self._moments(slot)
                for relation in reversed(path[:-1]):
                    groups = merged(groups.join(self._link(relation), "_fk").drop("_fk").withColumnRenamed("_up", "_fk").where("_fk is not null"), "_fk")
                exprs = [
                    (F.col("_rows") if f.primitive == "count" else finished(f.primitive, F.col(f"_m{spot[f.base.name]}"))).alias(f.name)
                    for f in simple
                ]
                out.append(groups.select("_fk", *exprs))
            if counted:
                values = self._values(slot)
                for relation in reversed(path[:-1]):
                    values = values.join(self._link(relation), "_fk").where("_up is not null").groupBy(F.col("_up").alias("_fk"), "_c", "_v").agg(F.sum("count").alias("count"))
                exprs = []
                for f in counted:
                    here = F.col("_c") == spot[f.base.name]
                    if f.primitive == "num_unique":
                        exprs.append(F.count_if(here).alias(f.name))
                    else:
                        typed = F.col("_v").cast(self.types[slot][f.base.name])
                        best = F.min(F.when(here, F.struct((-F.col("count")).alias("k"), typed.alias("v"))))
                        exprs.append(best["v"].alias(f.name))
                out.append(values.groupBy("_fk").agg(*exprs))
        return out

    def _link(self, relation: Relation) -> DataFrame:
        step = self.es.entities[relation.child]
        return step.data.select(col(step.key).alias("_fk"), col(relation.child_key).alias("_up"))

    def _rows(self, slot: tuple[Relation, int]) -> DataFrame:
        relation = slot[0]
        rows = self.entity_table(relation.child, [base for base, _ in self.bases[slot].values()])
        return rows.withColumn("_fk", col(relation.child_key)).where("_fk is not null")

    def _moments(self, slot: tuple[Relation, int]) -> DataFrame:
        if slot not in self.groups:
            parts = [
                moments(col(base.name), primitives).alias(f"_m{i}")
                for i, (base, primitives) in enumerate(self.bases[slot].values()) if primitives - {"mode", "num_unique"}
            ]
            self.groups[slot] = self._shared(slot, self._rows(slot).groupBy("_fk").agg(F.count("*").alias("_rows"), *parts))
        return self.groups[slot]

    def _values(self, slot: tuple[Relation, int]) -> DataFrame:
        """(key, column, value) counts: no per-key value set is ever held in memory."""
        if slot not in self.values:
            rows = self._rows(slot)
            bases = [(i, base) for i, (base, p) in enumerate(self.bases[slot].values()) if p & {"mode", "num_unique"}]
            self.types[slot] = {base.name: rows.schema[base.name].dataType for _, base in bases}
            values = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), col(base.name).cast("string").alias("v")) for i, base in bases]))
            counts = (
                rows.select("_fk", values.alias("_x"))
                .where("_x.v is not null")
                .groupBy("_fk", F.col("_x.c").alias("_c"), F.col("_x.v").alias("_v"))
                .count()
            )
            self.values[slot] = self._shared(slot, counts)
        return self.values[slot]

    def _shared(self, slot: tuple[Relation, int], groups: DataFrame) -> DataFrame:
        return checkpointed(groups) if len(self.paths[slot]) > 1 else groups


def _circular(features: Sequence[Feature]) -> bool:
    """True if two relations need each other's groups when all columns of a relation are grouped together."""
    needs: dict[Relation, set[Relation]] = {}

    def visit(f: Feature, inside: Relation | None) -> None:
        if f.kind == "aggregate":
            if inside is not None:
                needs.setdefault(inside, set()).add(f.path[-1])
            inside = f.path[-1]
        if f.base is not None:
            visit(f.base, inside)

    for f in features:
        visit(f, None)

    def reaches(r: Relation, goal: Relation, seen: set[Relation]) -> bool:
        return any(s == goal or (s not in seen and reaches(s, goal, seen | {s})) for s in needs.get(r, ()))

    return any(reaches(r, r, set()) for r in needs)


def _distinct(features: Iterable[Feature]) -> list[Feature]:
    return list({f.name: f for f in features}.values())


def compute_features(es: EntitySet, features: Sequence[Feature], sanitise: bool = False) -> DataFrame:
    """Key plus the defined columns, in definition order."""
    if not features:
        raise ValueError("there is no feature definition to apply")
    target = features[0].entity
    key = es.entities[target].key
    table = _Synthesis(es, features).entity_table(target, features)
    out = table.select(col(key), *[col(f.name) for f in features])
    return sanitise_names(out) if sanitise else out


def synthesise(es: EntitySet, target: str, sanitise: bool = False, **options) -> tuple[DataFrame, list[Feature]]:
    """Feature matrix of the target entity and its frozen definitions."""
    features = feature_definitions(es, target, **options)
    return compute_features(es, features, sanitise), features


def fusion_merge(
    tables: Mapping[str, DataFrame], primary_keys: Mapping[str, str], relations: Sequence[str], target: str, **options
) -> tuple[DataFrame, DataFrame]:
    """Fused matrix with sanitised names and its catalogue row.

    `relations` holds "parent,key;child,foreign_key" texts.
    """
    es = EntitySet()
    for name, df in tables.items():
        es.add_entity(name, df, primary_keys[name])
    for text in relations:
        (parent, key), (child, fk) = [[x.strip() for x in side.split(",")] for side in text.split(";")]
        es.add_relation(parent, key, child, fk)
    fused, _ = synthesise(es, target, sanitise=True, **options)
    return fused, dataset_info(fused)


# ---------------------------------------------------------------- routing
def slice_tables(
    root: DataFrame, key: str, children: Mapping[str, tuple[DataFrame, str]], ratio: float = 0.3, seed: int = 42
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Sample the de-duplicated root and keep the child rows that refer to it."""
    sampled = fraction_sample(root.dropDuplicates([key]), key, ratio, seed)
    return sampled, {name: route_children(sampled, key, child, fk) for name, (child, fk) in children.items()}


def route_children(parent: DataFrame, key: str, child: DataFrame, foreign_key: str) -> DataFrame:
    """Child rows whose foreign key occurs in the parent part."""
    ids = parent.select(col(key).alias("_id"))
    return child.join(ids, col(foreign_key) == F.col("_id"), "left_semi")


def audit_relations(
    parent: DataFrame, children: Mapping[str, tuple[DataFrame, str]], parent_key: str
) -> DataFrame:
    """Per child table: rows, orphan keys, matched keys, most rows per parent; the parent's rows and keys beside them."""
    require_columns(parent, [parent_key])
    require_unique_key(parent, parent_key)
    ids = parent.where(col(parent_key).isNotNull()).select(col(parent_key).alias("_id"), F.lit(1).alias("_hit"))
    # The key was found unique, so its values count the keys.
    totals = parent.agg(F.count("*").alias("rows"), F.count(col(parent_key)).alias("keys")).first()
    out = None
    for name, (child, fk) in children.items():
        require_columns(child, [fk])
        # counted per key before the join, so a hot key is one row in it
        per_key = child.groupBy(col(fk).alias("_fk")).agg(F.count("*").alias("k"))
        matched = per_key.join(ids, F.col("_fk") == F.col("_id"), "left")
        known, hit = F.col("_fk").isNotNull(), F.col("_hit").isNotNull()
        row = matched.agg(
            F.coalesce(F.sum("k"), F.lit(0)).alias("rows"),
            F.count_if(known & ~hit).alias("orphan_keys"),
            F.count_if(known & hit).alias("matched_parent_keys"),
            F.coalesce(F.max(F.when(known, F.col("k"))), F.lit(0)).alias("max_rows_per_parent"),
        ).select(F.lit(name).alias("relation"), "*", F.lit(totals["rows"]).alias("parent_rows"), F.lit(totals["keys"]).alias("parent_unique_keys"))
        out = row if out is None else out.unionByName(row)
    return out


