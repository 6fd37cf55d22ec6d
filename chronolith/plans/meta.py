"""Statements about the catalogue: SHOW, CREATE, DROP, DELETE, EXPLAIN."""

from __future__ import annotations

import re
from functools import reduce as fold

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import Catalog, Measurement, Policy, q
from ..lang import ast as A
from ..lang.errors import AnalysisError
from ..lang.ast import duration_text
from .select import Expressions, Frame, SelectPlanner


class MetaPlanner:
    def __init__(self, catalog: Catalog, now_ns: int):
        self.catalog, self.now_ns, self.spark = catalog, now_ns, catalog.spark

    def rows(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    @staticmethod
    def limited(df: DataFrame, s, *order: str) -> DataFrame:
        df = df.orderBy(*order)
        if s.offset:
            df = df.offset(s.offset.n)
        return df.limit(s.limit.n) if s.limit else df

    def found(self, on: A.On | None, sources: A.Sources | None) -> list[Measurement]:
        """Measurements of ON and FROM; without FROM all of the database."""
        database = on.database if on else None
        if sources is None:
            return self.catalog.find(database, "*")
        out: dict[tuple, Measurement] = {}
        for s in sources.items:
            regex = s.name.text if isinstance(s.name, A.Regex) else None
            for m in self.catalog.find(s.database or database, s.policy or "*", None if regex is not None else s.name.text, regex):
                out[m.name, m.database, m.policy] = m
        return [out[k] for k in sorted(out)]

    def where(self, m: Measurement, where: A.Where | None) -> DataFrame:
        if where is None:
            return m.frame
        return m.frame.where(Expressions(Frame(m.frame, m.tags, dict(m.fields), True, m.nanos), self.now_ns, None).condition(where.condition))

    def union(self, parts: list[DataFrame], schema: str) -> DataFrame:
        return fold(lambda a, b: a.unionByName(b), parts) if parts else self.rows([], schema)

    # -- SHOW ------------------------------------------------------------------------
    def show_databases(self, s: A.ShowDatabases) -> DataFrame:
        return self.rows([(n,) for n in sorted(self.catalog.databases)], "name string").orderBy("name")

    def show_retention_policies(self, s: A.ShowRetentionPolicies) -> DataFrame:
        names = [s.on.database] if s.on else sorted(self.catalog.databases)
        rows = []
        for n in names:
            if n not in self.catalog.databases:
                raise AnalysisError(f"database not found: {n}")
            rows += [(n, p.name, duration_text(p.duration_ns), duration_text(p.shard_duration_ns), p.replication, p.is_default) for p in self.catalog.databases[n]]
        return self.rows(rows, "database string, name string, duration string, shardDuration string, replication bigint, isDefault boolean")

    def show_measurements(self, s: A.ShowMeasurements) -> DataFrame:
        on = s.on
        found = self.catalog.find(on.database if on else None, "*" if on is None or on.database == "*" else on.policy or "*")
        if s.with_measurement:
            name = s.with_measurement.source.name
            hit = (lambda n: re.search(name.text, n)) if isinstance(name, A.Regex) else (lambda n: n == name.text)
            found = [m for m in found if hit(m.name)]
        schema = "database string, policy string, name string" if on and on.database == "*" else "name string"
        wide = schema != "name string"
        if s.where is None:
            rows = sorted({(m.database, m.policy, m.name) if wide else (m.name,) for m in found})
            df = self.rows(rows, schema)
        else:
            # one point that fits is enough
            parts = [self.where(m, s.where).limit(1).select(*([F.lit(m.database).alias("database"), F.lit(m.policy).alias("policy")] if wide else []), F.lit(m.name).alias("name")) for m in found]
            df = self.union(parts, schema).distinct()
        return self.limited(df, s, *(["name", "database", "policy"] if wide else ["name"]))

    def show_tag_keys(self, s: A.ShowTagKeys) -> DataFrame:
        schema = "name string, tagKey string"
        found = self.found(s.on, s.sources)
        if s.where is None:
            return self.limited(self.rows(sorted({(m.name, t) for m in found for t in m.tags}), schema), s, "name", "tagKey")
        parts = []
        for m in found:
            if m.tags:
                has = self.where(m, s.where).agg(*[F.max(q(t).isNotNull()).alias(t) for t in m.tags])
                each = F.explode(F.array(*[F.struct(F.lit(t).alias("tagKey"), q(t).alias("has")) for t in m.tags]))
                parts.append(has.select(each.alias("t")).where("t.has").select(F.lit(m.name).alias("name"), F.col("t.tagKey").alias("tagKey")))
        return self.limited(self.union(parts, schema).distinct(), s, "name", "tagKey")

    def show_tag_values(self, s: A.ShowTagValues) -> DataFrame:
        schema = "name string, key string, value string"
        k = s.with_key

        def wanted(tag: str) -> bool:
            if k.op in ("=", "IN"):
                return tag in k.names
            if k.op == "!=":
                return tag not in k.names
            return bool(re.search(k.regex.text, tag)) == (k.op == "=~")

        parts = []
        for m in self.found(s.on, s.sources):
            tags = [t for t in m.tags if wanted(t)]
            if tags:
                each = F.explode(F.array(*[F.struct(F.lit(t).alias("key"), q(t).alias("value")) for t in tags]))
                parts.append(self.where(m, s.where).select(each.alias("t")).where("t.value is not null").select(F.lit(m.name).alias("name"), "t.key", "t.value"))
        return self.limited(self.union(parts, schema).distinct(), s, "name", "key", "value")

    def show_field_keys(self, s: A.ShowFieldKeys) -> DataFrame:
        rows = sorted({(m.name, f, t) for m in self.found(s.on, s.sources) for f, t in m.fields.items()})
        return self.limited(self.rows(rows, "name string, fieldKey string, fieldType string"), s, "name", "fieldKey")

    # -- changes -----------------------------------------------------------------------
    def nothing(self) -> DataFrame:
        return self.rows([], "result string")

    def create(self, s: A.CreateDatabase) -> DataFrame:
        given = s.duration or s.replication is not None or s.shard_duration or s.policy is not None
        policy = Policy(s.policy or "autogen", s.duration.value if s.duration else 0, s.replication if s.replication is not None else 1, s.shard_duration.value if s.shard_duration else 0)
        self.catalog.create_database(s.name, policy if given else None)
        return self.nothing()

    def drop(self, s: A.DropMeasurement) -> DataFrame:
        self.catalog.drop(s.name)
        return self.nothing()

    def delete(self, s: A.Delete) -> DataFrame:
        """From then on the measurement is what the condition leaves; ``storage.rewrite`` makes that files."""
        for m in self.found(None, s.sources):
            if s.where is None:
                left = m.frame.where(F.lit(False))
            else:
                gone = Expressions(Frame(m.frame, m.tags, dict(m.fields), True, m.nanos), self.now_ns, None).condition(s.where.condition)
                left = m.frame.where(~F.coalesce(gone, F.lit(False)))
            self.catalog.replace_frame(m, left)
        return self.nothing()

    def explain(self, s: A.Explain) -> DataFrame:
        df = SelectPlanner(self.catalog, self.now_ns).plan(s.select).df
        run = df._jdf.queryExecution()
        if s.options in ("ANALYZE", "ANALYZE VERBOSE"):
            # this very plan, so that its text is the final one
            run.toRdd().count()
        mode = {None: "simple", "VERBOSE": "extended", "ANALYZE": "formatted", "ANALYZE VERBOSE": "cost"}[s.options]
        jvm = self.spark._jvm
        text = run.explainString(jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))
        return self.rows([(line,) for line in text.split("\n")], "plan string")

    def plan(self, s: A.Node) -> DataFrame:
        return {
            A.ShowDatabases: self.show_databases, A.ShowRetentionPolicies: self.show_retention_policies, A.ShowMeasurements: self.show_measurements, A.ShowTagKeys: self.show_tag_keys,
            A.ShowTagValues: self.show_tag_values, A.ShowFieldKeys: self.show_field_keys, A.CreateDatabase: self.create, A.DropMeasurement: self.drop, A.Delete: self.delete, A.Explain: self.explain,
        }[type(s)](s)
