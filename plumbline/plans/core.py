"""Relations and plans: SQL bodies over named inputs.

A relation is an input of plans (vectors, ground truth, scored pools, ...). It
has a Spark builder or a SQL body, and SQL text for the check in DuckDB. A plan
is one SELECT over relations. Both are written once and rendered for a dialect;
``run`` executes a plan over any DataFrames of the same columns.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..functions.storage import materialize


class Dialect:
    """The few places in which the two engines' SQL differs."""

    def __init__(self, spark: bool):
        self.spark = spark

    def names(self, column: str, order: str) -> str:
        """Values of a group, in order, joined by commas."""
        if self.spark:
            return f"listagg(CAST({column} AS STRING), ',') WITHIN GROUP (ORDER BY {order})"
        return f"string_agg(CAST({column} AS VARCHAR), ',' ORDER BY {order})"

    def series(self, first: int, last: int, name: str) -> str:
        """A one-column table of whole numbers."""
        source = f"explode(sequence({first}, {last}))" if self.spark else f"unnest(range({first}, {last} + 1))"
        return f"(SELECT CAST({name} AS BIGINT) AS {name} FROM (SELECT {source} AS {name}) AS s_)"

    def ordered_sum(self, x: str, order: str) -> str:
        """A sum from left to right in the given order."""
        if self.spark:
            return f"aggregate(transform(array_sort(collect_list(struct({order} AS o_, {x} AS x_))), e -> e.x_), 0D, (a, b) -> a + b)"
        return f"sum({x} ORDER BY {order})"

    def sha256(self, x: str) -> str:
        return f"sha2({x}, 256)" if self.spark else f"sha256({x})"

    def l2(self, a: str, b: str) -> str:
        if self.spark:
            return f"aggregate(zip_with({a}, {b}, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x)"
        return f"list_sum(list_transform(list_zip({a}, {b}), lambda t: (t[1] - t[2]) * (t[1] - t[2])))"

    def dot(self, a: str, b: str) -> str:
        if self.spark:
            return f"aggregate(zip_with({a}, {b}, (x, y) -> x * y), 0D, (s, x) -> s + x)"
        return f"list_sum(list_transform(list_zip({a}, {b}), lambda t: t[1] * t[2]))"

    def each(self, a: str, x: str, body: str) -> str:
        return f"transform({a}, {x} -> {body})" if self.spark else f"list_transform({a}, lambda {x}: {body})"

    def zip2(self, a: str, b: str, body: str) -> str:
        """``body`` in terms of x and y."""
        if self.spark:
            return f"zip_with({a}, {b}, (x, y) -> {body})"
        import re

        return f"list_transform(list_zip({a}, {b}), lambda t: {re.sub(r'(?<![a-z_])y(?![a-z_])', 't[2]', re.sub(r'(?<![a-z_])x(?![a-z_])', 't[1]', body))})"

    def hash_order(self, *parts: str) -> str:
        return "md5(concat_ws(':', " + ", ".join(f"CAST({p} AS {'STRING' if self.spark else 'VARCHAR'})" for p in parts) + "))"

    def hash_int(self, *parts: str) -> str:
        """A whole number of 28 bits from a hash."""
        h = self.hash_order(*parts)
        return f"CAST(conv(substring({h}, 1, 7), 16, 10) AS BIGINT)" if self.spark else f"('0x' || left({h}, 7))::BIGINT"

    def at(self, a: str, k: int) -> str:
        """The k-th element, from 1."""
        return f"element_at({a}, {k})" if self.spark else f"({a})[{k}]"


SPARK, DUCK = Dialect(True), Dialect(False)
Body = Callable[[Dialect], str]


@dataclass
class Relation:
    name: str
    needs: tuple[str, ...]
    body: Body
    #: Spark's own way, from (spark, sf_dir, relation getter); None: the body.
    build: Callable | None = None
    #: Written once a session and table folder.
    keep: bool = False


@dataclass
class Plan:
    name: str
    ids: str
    needs: tuple[str, ...]
    body: Body
    tables: tuple[str, ...] = field(default_factory=tuple)
    #: Spark's own way, from the inputs by name; None: the body.
    build: Callable | None = None


RELATIONS: dict[str, Relation] = {}
PLANS: dict[str, Plan] = {}
_kept: dict[tuple[str, str, str], DataFrame] = {}


def relation(name: str, *needs: str, build=None, keep: bool = False):
    def add(body: Body) -> Body:
        RELATIONS[name] = Relation(name, needs, body, build, keep)
        return body

    return add


def plan(ids: str, *needs: str, tables: tuple[str, ...] = (), build: Callable | None = None):
    def add(body: Body) -> Body:
        PLANS[body.__name__] = Plan(body.__name__, ids, needs, body, tables, build)
        return body

    return add


def get(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A relation over the tables in ``sf_dir``."""
    rel, key = RELATIONS[name], (spark.sparkContext.applicationId, sf_dir, name)
    if key in _kept:
        return _kept[key]
    if rel.build:
        df = rel.build(spark, sf_dir, lambda n: get(spark, sf_dir, n))
    else:
        df = over(spark, rel.body(SPARK), {n: get(spark, sf_dir, n) for n in rel.needs})
    if rel.keep:
        df = _kept[key] = materialize(df)
    return df


def over(spark: SparkSession, sql: str, inputs: dict[str, DataFrame]) -> DataFrame:
    """``sql`` with ``inputs`` as views named ``pl_<name>``.

    The views have names of this call's own and are gone once the text is resolved,
    so nothing stays in the session and calls don't see one another's.
    """
    call = uuid.uuid4().hex
    for name, df in inputs.items():
        df.createOrReplaceTempView(f"pl_{name}_{call}")
    try:
        return spark.sql(re.sub(r"\bpl_(\w+)\b", lambda m: f"pl_{m[1]}_{call}" if m[1] in inputs else m[0], sql))
    finally:
        for name in inputs:
            spark.catalog.dropTempView(f"pl_{name}_{call}")


def run(spark: SparkSession, name: str, **inputs: DataFrame) -> DataFrame:
    """A plan over the caller's own relations."""
    p = PLANS[name]
    return p.build(inputs) if p.build else over(spark, p.body(SPARK), inputs)


def query(name: str):
    p = PLANS[name]

    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        inputs = {n: get(spark, sf_dir, n) for n in p.needs}
        inputs |= {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in p.tables}
        return p.build(inputs) if p.build else over(spark, p.body(SPARK), inputs)

    return call


def oracle(name: str) -> str:
    """The same plan for DuckDB, with its relations as common table expressions."""
    p = PLANS[name]
    return rendered(p.body(DUCK), p.needs, p.tables)


def rendered(body: str, needs: tuple[str, ...], tables: tuple[str, ...] = ()) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n not in order:
            for d in RELATIONS[n].needs:
                visit(d)
            order.append(n)

    for n in needs:
        visit(n)
    ctes = [f"pl_{n} AS MATERIALIZED ({RELATIONS[n].body(DUCK)})" for n in order]
    ctes += [f"pl_{t} AS (SELECT * FROM {t})" for t in tables]
    if not ctes:
        return body
    if body.lstrip().upper().startswith("WITH "):
        return "WITH " + ", ".join(ctes) + ", " + body.lstrip()[5:]
    return "WITH " + ", ".join(ctes) + " " + body
