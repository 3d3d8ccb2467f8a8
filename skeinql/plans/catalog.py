"""Tables that can be changed: copy-on-write versions under a folder, with constraints, views, triggers and procedures.

A statement works out the new rows of its table and of all tables that refer to it, checks them together,
writes new versions of all, and only then moves their small pointer files; so a statement that fails
changes nothing, readers see the old versions until then, and old versions serve reads as of a version.
Paths go through Hadoop's file system, so any store works. Views, indexes and rights are kept beside the tables.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from skeinql.operators import quality


class ConstraintError(ValueError):
    """A statement whose result would break a constraint."""


#: Names in SQL text: literals and quoted names are left whole.
_TOKENS = re.compile(r"'(?:[^'\\]|\\.|'')*'|`[^`]*`|\"[^\"]*\"|[A-Za-z_][A-Za-z_0-9]*|.", re.DOTALL)


def _renamed(expression: str, old: str, new: str) -> str:
    """SQL text with one column's name changed, outside of literals."""
    return "".join(f"`{new}`" if t.strip("`").lower() == old.lower() and t[0] != "'" else t for t in _TOKENS.findall(expression))


def _names(expression: str) -> set[str]:
    return {t.strip("`").lower() for t in _TOKENS.findall(expression) if t[0] == "`" or t[0].isalpha() or t[0] == "_"}


class Catalog:
    """A database: a folder of tables."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.procedures: dict[str, Callable] = {}
        self.triggers: dict[tuple[str, str, str], list[Callable]] = {}
        self.row_triggers: dict[tuple[str, str], list[tuple[dict[str, str], str | None]]] = {}
        kept = self._json(f"{self.root}/catalog.json") or {"views": {}, "grants": {}, "indexes": {}}
        self.views: dict[str, str] = kept["views"]
        self.grants: dict[str, set[tuple[str, str]]] = {r: {(x, n) for x, n in own} for r, own in kept["grants"].items()}
        self.indexes: dict[str, tuple[str, tuple[str, ...], bool]] = {i: (n, tuple(c), u) for i, (n, c, u) in kept["indexes"].items()}

    def _keep(self) -> None:
        """Write what belongs to no single table."""
        self._put_json(f"{self.root}/catalog.json", {"views": self.views, "grants": {r: sorted(map(list, g)) for r, g in self.grants.items()}, "indexes": {i: [n, list(c), u] for i, (n, c, u) in self.indexes.items()}})

    # --- databases --------------------------------------------------------------------------------
    def create_database(self, name: str, if_not_exists: bool = False) -> "Catalog":
        """A database inside of this one."""
        fs, p = self._fs(f"{self.root}/{name}.db")
        if fs.exists(p) and not if_not_exists:
            raise ValueError(f"database {name} is there already")
        fs.mkdirs(p)
        return self.database(name)

    def database(self, name: str) -> "Catalog":
        if name not in self.databases():
            raise KeyError(f"no database {name}")
        return Catalog(self.spark, f"{self.root}/{name}.db")

    def databases(self) -> list[str]:
        return sorted(n[:-3] for n in self._folders() if n.endswith(".db"))

    def drop_database(self, name: str, if_exists: bool = False, cascade: bool = False) -> None:
        """Without cascade only an empty one."""
        if name not in self.databases():
            if if_exists:
                return
            raise KeyError(f"no database {name}")
        own = self.database(name)
        if not cascade and (own.tables() or own.databases() or own.views):
            raise ConstraintError(f"database {name} is not empty")
        fs, p = self._fs(f"{self.root}/{name}.db")
        fs.delete(p, True)

    # --- files ------------------------------------------------------------------------------------
    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def _json(self, path: str) -> dict | None:
        return json.loads("".join(r.value for r in self.spark.read.text(path, wholetext=True).collect())) if self._exists(path) else None

    def _put_json(self, path: str, content: dict) -> None:
        fs, p = self._fs(path)
        fs.mkdirs(p.getParent())
        out = fs.create(p, True)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()

    def _folders(self) -> list[str]:
        fs, p = self._fs(self.root)
        return [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()] if fs.exists(p) else []

    def _read_meta(self, name: str) -> dict:
        meta = self._json(f"{self.root}/{name}/table.json")
        if meta is None:
            raise KeyError(f"no table {name}")
        return meta

    def _write_meta(self, name: str, meta: dict) -> None:
        self._put_json(f"{self.root}/{name}/table.json", meta)

    def _commit(self, name: str, rows: DataFrame, meta: dict) -> None:
        self._commit_all({name: rows}, {name: meta})

    def _commit_all(self, new: dict[str, DataFrame], metas: dict[str, dict]) -> None:
        """Write all tables' new versions, then move their pointers."""
        for name, rows in new.items():
            folder = f"v-{uuid.uuid4().hex}"
            rows.write.parquet(f"{self.root}/{name}/{folder}")
            metas[name]["versions"].append({"folder": folder, "at": time.time(), "schema": rows.schema.json()})
        for name in new:
            self._write_meta(name, metas[name])

    # --- tables -----------------------------------------------------------------------------------
    def create_table(self, name: str, columns: str, primary_key: Sequence[str] = (), unique: Sequence[Sequence[str]] = (), checks: dict[str, str] | None = None, foreign_keys: dict[str, tuple[str, str, str]] | None = None, defaults: dict[str, object] | None = None, if_not_exists: bool = False) -> None:
        """foreign_keys: column -> (parent table, parent column, what deleting the parent does, what changing its key does): restrict, cascade or set null; changes are restricted by default."""
        if self._exists(f"{self.root}/{name}/table.json"):
            if if_not_exists:
                return
            raise ValueError(f"table {name} is there already")
        schema = _parse_datatype_string(columns)
        meta = {"primary_key": list(primary_key), "unique": [list(u) for u in unique], "checks": checks or {}, "foreign_keys": {k: list(v) for k, v in (foreign_keys or {}).items()}, "defaults": defaults or {}, "versions": []}
        self._commit(name, self.spark.createDataFrame([], schema), meta)

    def create_table_as(self, name: str, rows: DataFrame, **how) -> None:
        """SELECT INTO / CREATE TABLE AS."""
        self.create_table(name, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), **how)
        self.insert(name, rows)

    def drop_table(self, name: str, if_exists: bool = False) -> None:
        if not self._exists(f"{self.root}/{name}/table.json"):
            if if_exists:
                return
            raise KeyError(f"no table {name}")
        for child, column, *_ in self._children(name):
            if child != name:
                raise ConstraintError(f"{child}.{column} refers to {name}")
        fs, p = self._fs(f"{self.root}/{name}")
        fs.delete(p, True)
        self.indexes = {i: x for i, x in self.indexes.items() if x[0] != name}
        self._keep()

    def tables(self) -> list[str]:
        return sorted(n for n in self._folders() if self._exists(f"{self.root}/{n}/table.json"))

    def _children(self, name: str) -> list[tuple[str, str, str, str, str]]:
        """(child table, its column, the parent's column, what deletes do, what changes do) of each reference to a table."""
        out = []
        for child in self.tables():
            for column, (parent, key, *actions) in self._read_meta(child)["foreign_keys"].items():
                if parent == name:
                    out.append((child, column, key, actions[0], actions[1] if len(actions) > 1 else "restrict"))
        return out

    def table(self, name: str, version: int | None = None, as_of: float | None = None) -> DataFrame:
        """The newest rows, or those of a version (0 is the first; negative from the end) or of a time."""
        meta = self._read_meta(name)["versions"]
        if as_of is not None:
            meta = [v for v in meta if v["at"] <= as_of]
            if not meta:
                raise ValueError(f"{name} was not there yet")
        v = meta[-1 if version is None else version]
        return self.spark.read.schema(StructType.fromJson(json.loads(v["schema"]))).parquet(f"{self.root}/{name}/{v['folder']}")

    def versions(self, name: str) -> int:
        return len(self._read_meta(name)["versions"])

    def flashback(self, name: str, version: int) -> None:
        self._commit(name, self.table(name, version), self._read_meta(name))

    def _change(self, name: str, rows: DataFrame, event: str, changed: DataFrame, gone: DataFrame | None = None, moved: dict[str, DataFrame] | None = None) -> None:
        """One statement: rows are a table's new rows, changed those it touched. gone: rows that went; moved: column -> (_old, _new) of changed values."""
        for f in self.triggers.get((name, "instead of", event), []):
            f(changed)
            return
        for f in self.triggers.get((name, "before", event), []):
            f(changed)
        new, touched = {name: rows}, [(name, event, changed)]
        if gone is not None:
            self._follow_deletes(name, gone, new, touched)
        for column, pairs in (moved or {}).items():
            self._follow_changes(name, column, pairs, new, touched)
        metas = {n: self._read_meta(n) for n in new}
        # tables that still refer to rows that are no longer there forbid the statement
        for n in list(new):
            for child, column, key, *_ in self._children(n) if gone is not None or moved else []:
                if not quality.orphans(new.get(child, self.table(child)), column, new[n], key).isEmpty():
                    raise ConstraintError(f"{child}.{column} refers to rows of {n}")
        for n, r in new.items():
            self._check(n, r, metas[n], new)
        self._commit_all(new, metas)
        for n, what, some in touched:
            for f in self.triggers.get((n, "after", what), []):
                f(some)

    def _follow_deletes(self, name: str, gone: DataFrame, new: dict[str, DataFrame], touched: list) -> None:
        """Carry deletes on to the rows that refer to deleted ones, and to those that refer to these."""
        for child, column, key, action, _ in self._children(name):
            if action == "restrict":
                continue
            rows = new.get(child, None)
            rows = self.table(child) if rows is None else rows
            keys = gone.select(F.col(key).alias(column)).where(F.col(column).isNotNull()).distinct()
            hits = rows.join(keys, column, "left_semi").select(rows.columns)
            if hits.isEmpty():
                continue
            if action == "cascade":
                new[child] = rows.join(keys, column, "left_anti").select(rows.columns)
                touched.append((child, "delete", hits))
                self._follow_deletes(child, hits, new, touched)
            else:
                pairs = keys.select(F.col(column).alias("_old"), F.lit(None).cast(rows.schema[column].dataType).alias("_new"))
                new[child] = self._replaced(rows, column, pairs)
                touched.append((child, "update", hits))
                self._follow_changes(child, column, pairs, new, touched)

    def _follow_changes(self, name: str, column: str, pairs: DataFrame, new: dict[str, DataFrame], touched: list) -> None:
        """Carry changed values of a column on to the columns that refer to it."""
        for child, own, key, _, action in self._children(name):
            if key != column or action == "restrict":
                continue
            rows = new.get(child, None)
            rows = self.table(child) if rows is None else rows
            hits = rows.join(pairs.select(F.col("_old").alias(own)), own, "left_semi").select(rows.columns)
            if hits.isEmpty():
                continue
            then = pairs if action == "cascade" else pairs.withColumn("_new", F.lit(None).cast(rows.schema[own].dataType))
            new[child] = self._replaced(rows, own, then)
            touched.append((child, "update", hits))
            self._follow_changes(child, own, then, new, touched)

    @staticmethod
    def _replaced(rows: DataFrame, column: str, pairs: DataFrame) -> DataFrame:
        found = rows.join(pairs.withColumn("_hit", F.lit(True)), rows[column] == pairs["_old"], "left")
        return found.withColumn(column, F.when(F.col("_hit").isNotNull(), F.col("_new").cast(rows.schema[column].dataType)).otherwise(F.col(column))).select(rows.columns)

    def _check(self, name: str, rows: DataFrame, meta: dict, new: dict[str, DataFrame] | None = None) -> None:
        key = meta["primary_key"]
        if key and not rows.where(" OR ".join(f"`{c}` IS NULL" for c in key)).isEmpty():
            raise ConstraintError(f"{name}: null in the primary key")
        for u in ([key] if key else []) + meta["unique"]:
            if not quality.duplicates(rows.dropna(subset=u), u).isEmpty():
                raise ConstraintError(f"{name}: {', '.join(u)} is not unique")
        for label, check in meta["checks"].items():
            if not quality.violations(rows, F.expr(check)).isEmpty():
                raise ConstraintError(f"{name}: check {label} fails")
        for column, (parent, parent_key, *_) in meta["foreign_keys"].items():
            there = rows if parent == name else (new or {}).get(parent, None)
            if not quality.orphans(rows, column, self.table(parent) if there is None else there, parent_key).isEmpty():
                raise ConstraintError(f"{name}: {column} has no {parent}.{parent_key}")

    def _by_row(self, name: str, event: str, rows: DataFrame) -> DataFrame:
        """Rows as the row triggers leave them."""
        for values, when in self.row_triggers.get((name, event), []):
            hit = F.coalesce(F.expr(when), F.lit(False)) if when else F.lit(True)
            rows = rows.withColumns({c: F.when(hit, F.expr(e)).otherwise(F.col(c)).cast(rows.schema[c].dataType) for c, e in values.items()})
        return rows

    def _shaped(self, name: str, rows: DataFrame) -> DataFrame:
        meta, now = self._read_meta(name), self.table(name)
        return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(meta["defaults"].get(f.name))).cast(f.dataType).alias(f.name) for f in now.schema])

    def insert(self, name: str, rows: DataFrame | Sequence[dict]) -> None:
        """INSERT VALUES (dicts) or INSERT SELECT; missing columns take their default."""
        if not isinstance(rows, DataFrame):
            schema, defaults = self.table(name).schema, self._read_meta(name)["defaults"]
            rows = self.spark.createDataFrame([tuple(r.get(f.name, defaults.get(f.name)) for f in schema) for r in rows], StructType([StructField(f.name, f.dataType, True) for f in schema]))
        new = self._by_row(name, "insert", self._shaped(name, rows))
        self._change(name, self.table(name).unionByName(new), "insert", new)

    def update(self, name: str, values: dict[str, Column | object], where: Column | str) -> None:
        """Changed keys are followed by the rows that refer to them, as their foreign keys say."""
        now = self.table(name)
        hit = F.coalesce(F.expr(where) if isinstance(where, str) else where, F.lit(False))
        new = {c: (v if isinstance(v, Column) else F.lit(v)).cast(now.schema[c].dataType) for c, v in values.items()}
        after = self._by_row(name, "update", now.where(hit).withColumns(new))
        moved = {}
        for c in {key for _, _, key, *_ in self._children(name)} & set(values):
            pairs = now.where(hit).select(F.col(c).alias("_old"), new[c].alias("_new")).where("NOT (_old <=> _new)").distinct()
            if not pairs.isEmpty():
                moved[c] = pairs
        self._change(name, now.where(~hit).unionByName(after), "update", now.where(hit), moved=moved)

    def delete(self, name: str, where: Column | str) -> None:
        """Rows of other tables that refer to deleted ones, directly or through others, are deleted, set to null, or forbid it."""
        now = self.table(name)
        hit = F.coalesce(F.expr(where) if isinstance(where, str) else where, F.lit(False))
        self._change(name, now.where(~hit), "delete", now.where(hit), gone=now.where(hit))

    def truncate(self, name: str) -> None:
        """All rows go; tables that refer to them are treated as by a delete."""
        now = self.table(name)
        self._change(name, now.limit(0), "truncate", now, gone=now)

    def merge(self, name: str, news: DataFrame, key: Sequence[str]) -> None:
        now = self.table(name)
        shaped = self._by_row(name, "update", self._shaped(name, news))
        self._change(name, now.join(news.select(*key), list(key), "left_anti").select(now.columns).unionByName(shaped), "update", news)

    def alter(self, name: str, action: str, column: str, *arg) -> None:
        """add (type, default), drop, rename (new name), type (type), default (value), drop default."""
        meta, rows = self._read_meta(name), self.table(name)
        if action == "add":
            rows = rows.withColumn(column, F.lit(arg[1] if len(arg) > 1 else None).cast(arg[0]))
        elif action == "drop":
            used = [label for label, c in meta["checks"].items() if column.lower() in _names(c)]
            if used or column in meta["primary_key"] or any(key == column for _, _, key, *_ in self._children(name)):
                raise ConstraintError(f"{name}.{column} is in use")
            rows = rows.drop(column)
            meta["unique"] = [u for u in meta["unique"] if column not in u]
            meta["foreign_keys"].pop(column, None)
            meta["defaults"].pop(column, None)
        elif action == "rename":
            rows = rows.withColumnRenamed(column, arg[0])
            to = lambda c: arg[0] if c == column else c
            meta |= {"primary_key": [to(c) for c in meta["primary_key"]], "unique": [[to(c) for c in u] for u in meta["unique"]], "checks": {k: _renamed(c, column, arg[0]) for k, c in meta["checks"].items()}}
            meta |= {"foreign_keys": {to(c): v for c, v in meta["foreign_keys"].items()}, "defaults": {to(c): v for c, v in meta["defaults"].items()}}
            for child in {c for c, _, key, *_ in self._children(name) if key == column}:
                own = meta if child == name else self._read_meta(child)
                own["foreign_keys"] = {c: [v[0], arg[0], *v[2:]] if v[0] == name and v[1] == column else v for c, v in own["foreign_keys"].items()}
                if child != name:
                    self._write_meta(child, own)
            self.indexes = {i: (n, tuple(to(c) for c in cs) if n == name else cs, u) for i, (n, cs, u) in self.indexes.items()}
            self._keep()
        elif action == "type":
            rows = rows.withColumn(column, F.col(column).cast(arg[0]))
        elif action == "default":
            meta["defaults"][column] = arg[0]
        elif action == "drop default":
            meta["defaults"].pop(column, None)
        else:
            raise ValueError(f"no action {action}")
        self._commit(name, rows, meta)

    def add_constraint(self, name: str, kind: str, *arg) -> None:
        """unique (columns), check (label, condition), foreign key (column, parent, parent column, action on delete, action on change); the rows must meet it."""
        meta = self._read_meta(name)
        if kind == "unique":
            meta["unique"].append(list(arg[0]))
        elif kind == "check":
            meta["checks"][arg[0]] = arg[1]
        elif kind == "foreign key":
            meta["foreign_keys"][arg[0]] = list(arg[1:])
        else:
            raise ValueError(f"no constraint {kind}")
        self._check(name, self.table(name), meta)
        self._write_meta(name, meta)

    def drop_constraint(self, name: str, label: str | Sequence[str]) -> None:
        """A check by its label, a foreign key by its column, a unique constraint by its columns."""
        meta = self._read_meta(name)
        columns = [label] if isinstance(label, str) else list(label)
        found = columns in meta["unique"]
        meta["unique"] = [u for u in meta["unique"] if u != columns]
        if isinstance(label, str):
            found |= meta["checks"].pop(label, None) is not None
            found |= meta["foreign_keys"].pop(label, None) is not None
        if not found:
            raise KeyError(f"{name} has no constraint {label}")
        self._write_meta(name, meta)

    # --- indexes, views, procedures, rights ----------------------------------------------------------
    def create_index(self, index: str, name: str, columns: Sequence[str], unique: bool = False) -> None:
        """A layout: the table is written sorted by the columns, so row-group and page statistics skip; unique is checked."""
        if index in self.indexes:
            raise ValueError(f"index {index} is there already")
        if unique:
            self.add_constraint(name, "unique", columns)
        rows = self.table(name)
        self._commit(name, rows.repartitionByRange(*columns).sortWithinPartitions(*columns), self._read_meta(name))
        self.indexes[index] = (name, tuple(columns), unique)
        self._keep()

    def drop_index(self, index: str) -> None:
        """A unique index takes its constraint along."""
        name, columns, unique = self.indexes.pop(index)
        if unique and not any(n == name and c == columns and u for n, c, u in self.indexes.values()):
            self.drop_constraint(name, columns)
        self._keep()

    def create_view(self, name: str, sql: str, replace: bool = False) -> None:
        if name in self.views and not replace:
            raise ValueError(f"view {name} is there already")
        self.views[name] = sql
        self._keep()

    def drop_view(self, name: str, if_exists: bool = False) -> None:
        if name not in self.views and not if_exists:
            raise KeyError(f"no view {name}")
        self.views.pop(name, None)
        self.spark.catalog.dropTempView(name)
        self._keep()

    def sql(self, text: str, **args) -> DataFrame:
        """Run a query; tables and views of the catalog are visible, values are bound by name."""
        for t in self.tables():
            self.table(t).createOrReplaceTempView(t)
        for v, s in self.views.items():
            self.spark.sql(s).createOrReplaceTempView(v)
        return self.spark.sql(text, args=args or None)

    def create_procedure(self, name: str, f: Callable) -> None:
        self.procedures[name] = f

    def call(self, name: str, *args, **named):
        return self.procedures[name](self, *args, **named)

    def create_trigger(self, name: str, timing: str, event: str, f: Callable[[DataFrame], None]) -> None:
        """timing: before (may raise), after, or instead of the statement; f gets the changed rows."""
        self.triggers.setdefault((name, timing, event), []).append(f)

    def create_row_trigger(self, name: str, event: str, values: dict[str, str], when: str | None = None) -> None:
        """Before each inserted or updated row is written: set columns to expressions of the new row, where a condition holds."""
        self.row_triggers.setdefault((name, event), []).append((values, when))

    def grant(self, role: str, right: str, name: str) -> None:
        self.grants.setdefault(role, set()).add((right, name))
        self._keep()

    def revoke(self, role: str, right: str, name: str) -> None:
        self.grants.get(role, set()).discard((right, name))
        self._keep()

    def as_role(self, role: str) -> "AsRole":
        """The catalog as a role may use it."""
        return AsRole(self, role)

    def allowed(self, role: str, right: str, name: str) -> bool:
        return (right, name) in self.grants.get(role, set())

    # --- backup --------------------------------------------------------------------------------------
    def backup(self, path: str) -> list[str]:
        for t in self.tables():
            self.table(t).write.mode("overwrite").parquet(f"{path}/{t}")
        return self.tables()

    def restore(self, path: str, names: Sequence[str]) -> None:
        for t in names:
            self._commit(t, self.spark.read.parquet(f"{path}/{t}"), self._read_meta(t))


class AsRole:
    """Tables as a role may use them: each statement needs its right (select, insert, update, delete) on each table or view it names."""

    def __init__(self, catalog: Catalog, role: str) -> None:
        self.catalog, self.role = catalog, role

    def _need(self, right: str, name: str) -> None:
        if not self.catalog.allowed(self.role, right, name):
            raise PermissionError(f"{self.role} may not {right} {name}")

    def table(self, name: str, **how) -> DataFrame:
        self._need("select", name)
        return self.catalog.table(name, **how)

    def insert(self, name: str, rows) -> None:
        self._need("insert", name)
        self.catalog.insert(name, rows)

    def update(self, name: str, values: dict, where) -> None:
        self._need("update", name)
        self.catalog.update(name, values, where)

    def delete(self, name: str, where) -> None:
        self._need("delete", name)
        self.catalog.delete(name, where)

    def truncate(self, name: str) -> None:
        self._need("delete", name)
        self.catalog.truncate(name)

    def merge(self, name: str, news: DataFrame, key: Sequence[str]) -> None:
        for right in ("insert", "update"):
            self._need(right, name)
        self.catalog.merge(name, news, key)

    def sql(self, text: str, **args) -> DataFrame:
        """A query; a view needs a right of its own, not rights on what it reads."""
        named = _names(text)
        for n in [*self.catalog.tables(), *self.catalog.views]:
            if n.lower() in named:
                self._need("select", n)
        return self.catalog.sql(text, **args)
