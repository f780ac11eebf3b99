"""Versions of schemas and of data: content-addressed objects, commits, branches, merges, migration of datasets.

Objects are rows of a Parquet table under one folder (hash, kind, payload); history is small and walked on the driver.
Datasets are Parquet tables that a commit names; migrating one runs a lens as a plan.
"""

from __future__ import annotations

import hashlib
import json
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.transforms import select
from .plans.compare import Change, diff
from .plans.lens_text import auto_steps, inverse
from .schema import Schema


class VersionError(ValueError):
    """An operation that the history does not allow."""


def digest(kind: str, payload) -> str:
    return hashlib.sha256(json.dumps([kind, payload], sort_keys=True, default=str).encode()).hexdigest()


@dataclass(frozen=True)
class Commit:
    id: str
    schema: str
    parents: tuple
    message: str
    author: str
    at: float
    seq: int
    data: dict = field(default_factory=dict)  # dataset -> path


class Store:
    """Objects by hash, in memory, and on demand as a table."""

    def __init__(self):
        self.objects: dict[str, tuple[str, object]] = {}

    def put(self, kind: str, payload) -> str:
        h = digest(kind, payload)
        self.objects[h] = (kind, payload)
        return h

    def get(self, h: str):
        if h not in self.objects:
            raise VersionError(f"no object {h[:12]}")
        return self.objects[h][1]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(h, k, json.dumps(p, default=str)) for h, (k, p) in sorted(self.objects.items())], "hash string, kind string, payload string")

    def save(self, spark: SparkSession, path: str) -> None:
        self.frame(spark).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Store:
        s = Store()
        s.objects = {r.hash: (r.kind, json.loads(r.payload)) for r in spark.read.parquet(path).collect()}
        return s


class Repository:
    def __init__(self, store: Store | None = None):
        self.store = store or Store()
        self.commits: dict[str, Commit] = {}
        self.branches: dict[str, str | None] = {"main": None}
        self.tags: dict[str, str] = {}
        self.head = "main"
        self.staged: Schema | None = None
        self.staged_data: dict[str, str] = {}
        self.stashes: list[Schema] = []
        self.log_of_refs: list[tuple[str, str | None, str | None, str]] = []

    @property
    def tip(self) -> str | None:
        return self.branches.get(self.head, self.head if self.head in self.commits else None)

    def _move(self, to: str | None, why: str) -> None:
        self.log_of_refs.append((self.head, self.tip, to, why))
        if self.head in self.branches:
            self.branches[self.head] = to
        else:
            self.head = to

    def resolve(self, ref: str) -> str:
        found = self.branches.get(ref) or self.tags.get(ref) or (self.tip if ref == "HEAD" else None) or next((c for c in self.commits if c.startswith(ref)), None)
        if not found:
            raise VersionError(f"no such version: {ref}")
        return found

    def schema(self, ref: str = "HEAD") -> Schema:
        return Schema.from_dict(json.loads(self.store.get(self.commits[self.resolve(ref)].schema)))

    def add(self, s: Schema, **data: str) -> list[Change]:
        """Stage a schema, and datasets by path; the changes against the tip."""
        self.staged, self.staged_data = s, dict(data)
        return diff(self.schema(), s) if self.tip else []

    def commit(self, message: str, author: str = "", parents: tuple | None = None) -> str:
        if self.staged is None:
            raise VersionError("nothing is staged")
        h = self.store.put("schema", json.dumps(self.staged.to_dict(), sort_keys=True))
        parents = parents if parents is not None else (self.tip,) if self.tip else ()
        data = {**(self.commits[self.tip].data if self.tip else {}), **self.staged_data}
        seq = 1 + max((self.commits[p].seq for p in parents), default=0)
        c = digest("commit", [h, parents, message, author, seq, data, len(self.commits)])
        self.commits[c] = Commit(c, h, tuple(parents), message, author, time.time(), seq, data)
        self.store.put("commit", [h, list(parents), message, author, seq, data])
        self._move(c, f"commit: {message}")
        self.staged, self.staged_data = None, {}
        return c

    def amend(self, message: str) -> str:
        old = self.commits[self.tip]
        self.staged = self.staged or self.schema()
        return self.commit(message, old.author, old.parents)

    def branch(self, name: str, at: str = "HEAD") -> None:
        if name in self.branches:
            raise VersionError(f"branch {name} exists")
        self.branches[name] = self.resolve(at)

    def tag(self, name: str, at: str = "HEAD") -> None:
        if name in self.tags:
            raise VersionError(f"tag {name} exists")
        self.tags[name] = self.resolve(at)

    def checkout(self, ref: str) -> Schema:
        self.head = ref if ref in self.branches else self.resolve(ref)
        return self.schema()

    def ancestors(self, c: str) -> set[str]:
        out, todo = set(), [c]
        while todo:
            x = todo.pop()
            if x not in out:
                out.add(x)
                todo += self.commits[x].parents
        return out

    def is_ancestor(self, a: str, b: str) -> bool:
        return self.resolve(a) in self.ancestors(self.resolve(b))

    def merge_base(self, a: str, b: str) -> str | None:
        both = self.ancestors(self.resolve(a)) & self.ancestors(self.resolve(b))
        return max(both, key=lambda c: (self.commits[c].seq, c), default=None)

    def log(self, ref: str = "HEAD", limit: int | None = None) -> list[Commit]:
        out = sorted((self.commits[c] for c in self.ancestors(self.resolve(ref))), key=lambda c: (-c.seq, c.id))
        return out[:limit]

    def path(self, a: str, b: str) -> list[str]:
        """Commits from an ancestor to a descendant, along first parents that reach it."""
        a, out, at = self.resolve(a), [], self.resolve(b)
        while at != a:
            out.append(at)
            ups = [p for p in self.commits[at].parents if a in self.ancestors(p)]
            if not ups:
                raise VersionError(f"{a[:8]} is no ancestor of {b[:8]}")
            at = ups[0]
        return [a, *reversed(out)]

    def merge(self, other: str, message: str | None = None) -> tuple[str | None, list]:
        """Merge a branch into this one: the commit, or the conflicts."""
        ours, theirs = self.tip, self.resolve(other)
        base = self.merge_base(ours, theirs)
        if base == theirs:
            return ours, []
        if base == ours:
            self._move(theirs, f"merge {other}: fast-forward")
            return theirs, []
        merged, conflicts = merge_schemas(self.schema(base) if base else Schema(), self.schema(ours), self.schema(theirs))
        if conflicts:
            return None, conflicts
        self.staged = merged
        return self.commit(message or f"merge {other}", parents=(ours, theirs)), []

    def cherry_pick(self, ref: str) -> tuple[str | None, list]:
        c = self.commits[self.resolve(ref)]
        if not c.parents:
            raise VersionError("the first version cannot be picked")
        merged, conflicts = merge_schemas(self.schema(c.parents[0]), self.schema(), self.schema(c.id))
        if conflicts:
            return None, conflicts
        self.staged = merged
        return self.commit(c.message, c.author), []

    def rebase(self, onto: str) -> tuple[str | None, list]:
        base = self.merge_base("HEAD", onto)
        todo = [c for c in self.path(base, "HEAD")[1:]]
        self._move(self.resolve(onto), f"rebase onto {onto}")
        for c in todo:
            _, conflicts = self.cherry_pick(c)
            if conflicts:
                return None, conflicts
        return self.tip, []

    def reset(self, ref: str, mode: str = "mixed") -> None:
        """soft keeps what was there staged; mixed and hard do not; hard also forgets what is staged."""
        if mode not in ("soft", "mixed", "hard"):
            raise VersionError(f"no such mode: {mode}")
        was = self.schema() if mode == "soft" else None
        self._move(self.resolve(ref), f"reset {mode}")
        self.staged = was if mode == "soft" else None

    def stash(self) -> None:
        if self.staged is None:
            raise VersionError("nothing is staged")
        self.stashes.append(self.staged)
        self.staged = None

    def stash_pop(self) -> Schema:
        if not self.stashes:
            raise VersionError("nothing is stashed")
        self.staged = self.stashes.pop()
        return self.staged

    def blame(self, vertex: str, ref: str = "HEAD") -> Commit | None:
        """The commit that gave a vertex its kind."""
        found, kind = None, self.schema(ref).vertices.get(vertex)
        for c in self.log(ref):
            if self.schema(c.id).vertices.get(vertex) != kind:
                break
            found = c
        return found if kind else None

    def bisect(self, good: str, bad: str, test) -> str:
        """The first commit on the way whose schema fails ``test``."""
        way = self.path(good, bad)
        lo, hi = 0, len(way) - 1
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if test(self.schema(way[mid])) else (lo, mid)
        return way[hi]

    def gc(self) -> int:
        """Forget what no ref reaches; how many objects went."""
        keep = set().union(*[self.ancestors(c) for c in [*self.branches.values(), *self.tags.values(), self.tip] if c])
        before = len(self.store.objects) + len(self.commits)
        self.commits = {c: x for c, x in self.commits.items() if c in keep}
        used = {x.schema for x in self.commits.values()}
        self.store.objects = {h: o for h, o in self.store.objects.items() if o[0] != "schema" or h in used}
        return before - len(self.store.objects) - len(self.commits)

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(c.id, c.schema, list(c.parents), c.message, c.author, c.seq) for c in self.commits.values()]
        return spark.createDataFrame(rows, "id string, schema string, parents array<string>, message string, author string, seq int")

    def migrate(self, df: DataFrame, root: str, a: str, b: str) -> DataFrame:
        """A dataset of one version as another version's: the steps along the way are fused into one projection."""
        return select(df, auto_steps(self.schema(a), self.schema(b), root))

    def forward(self, df: DataFrame, root: str, a: str, b: str, key: list[str]) -> tuple[DataFrame, DataFrame]:
        """A dataset of version ``a`` as version ``b``'s, and its complement: the columns that the way loses or changes for good, by key.

        ``key`` names columns of version ``a`` that tell rows apart (null is a value); write the complement beside the data to come back.
        """
        steps = auto_steps(self.schema(a), self.schema(b), root)
        lost = [c for c in lost_columns(steps, df.columns) if c not in key]
        return select(df, steps), df.select(*key, *lost).dropDuplicates(key)

    def backward(self, df: DataFrame, complement: DataFrame, root: str, a: str, b: str, key: list[str]) -> DataFrame:
        """A dataset of version ``b``, edited perhaps, as version ``a``'s: what the way lost comes from the complement, by key, and is null for new rows."""
        steps = auto_steps(self.schema(a), self.schema(b), root)
        back = select(df, inverse([t for t in steps if invertible(t)]))
        if gone := [k for k in key if k not in back.columns]:
            raise VersionError(f"the key {gone} did not survive")
        lost = [c for c in complement.columns if c not in key]
        kept = complement.select(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(key)], *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(lost)])
        same = [F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)]
        j = back.join(kept, same, "left")
        want = [e.label for e in self.schema(a).outgoing(root)]
        return j.select(*[F.col(f"_c{lost.index(c)}").alias(c) if c in lost else F.col(f"`{c}`") for c in want if c in lost or c in back.columns])

    def stale(self, ref: str = "HEAD") -> list[tuple[str, str, str, str]]:
        """(dataset, path, version it was written for, why) of datasets whose schema is not the version's: added before the schema changed."""
        at = self.commits[self.resolve(ref)]
        out = []
        for name, path in sorted(at.data.items()):
            since = at
            while since.parents and self.commits[since.parents[0]].data.get(name) == path:
                since = self.commits[since.parents[0]]
            if since.schema != at.schema:
                out.append((name, path, since.id, f"written for schema {since.schema[:12]}, now {at.schema[:12]}"))
        return out

    def migrate_folder(self, spark: SparkSession, folder: str, to: str, root: str, a: str, b: str) -> dict[str, int]:
        """A folder of JSON records of version ``a`` as JSON lines of version ``b`` under ``to``; how many went over and how many could not be read."""
        from .sources.records import emit_json, read_json_dir

        good, bad = read_json_dir(spark, folder, self.schema(a), root)
        moved = select(good.select("file", "rest", "record.*"), auto_steps(self.schema(a), self.schema(b), root))
        order = [e.label for e in self.schema(b).outgoing(root)]
        kept = [c for c in order if c in moved.columns] + [c for c in moved.columns if c not in ("file", "rest", *order)]
        emit_json(moved.select("rest", F.struct(*[F.col(f"`{c}`") for c in kept]).alias("record"))).select("json").write.text(to)
        return {"migrated": spark.read.text(to).count(), "failed": bad.count()}

    def migrate_back(self, df: DataFrame, root: str, a: str, b: str) -> DataFrame:
        """The way back; refused where something was lost."""
        return select(df, inverse(auto_steps(self.schema(a), self.schema(b), root)))


def invertible(t: tuple) -> bool:
    """Can a step be undone without a complement?"""
    return t[0] in ("rename", "pullback", "add", "compute", "hoist", "nest") or t[0] == "apply" and len(t) > 3 and bool(t[3])


def lost_columns(steps, columns: list[str]) -> list[str]:
    """The columns, by their old names, that steps drop or change without a way back."""
    now, lost = {c: c for c in columns}, []
    for t in steps:
        if t[0] == "rename" and t[1] in now:
            now[t[2]] = now.pop(t[1])
        elif t[0] == "pullback":
            now = {t[1].get(n, n): old for n, old in now.items()}
        elif t[0] == "drop":
            lost += [now.pop(t[1])] if t[1] in now else []
        elif t[0] == "keep":
            lost += [old for n, old in now.items() if n not in t[1]]
            now = {n: old for n, old in now.items() if n in t[1]}
        elif not invertible(t) and len(t) > 1 and t[1] in now:
            lost.append(now[t[1]])
    return list(dict.fromkeys(lost))


def merge_keyed(base: dict, ours: dict, theirs: dict, what: str) -> tuple[dict, list]:
    """By key: the side that changed wins, equal changes agree, others conflict (a removed and modified key keeps the base)."""
    out, conflicts = {}, []
    for k in sorted({*base, *ours, *theirs}, key=str):
        b, o, t = base.get(k), ours.get(k), theirs.get(k)
        if o == b:
            value = t
        elif t == b or o == t:
            value = o
        elif b is None:
            value = None
            conflicts.append((f"BothAdded{what}Differently", str(k)))
        else:
            value = b
            conflicts.append((f"BothModified{what}" if o is not None and t is not None else f"DeleteModify{what}", str(k)))
        if value is not None:
            out[k] = value
    return out, conflicts


def merge_schemas(base: Schema, ours: Schema, theirs: Schema) -> tuple[Schema, list]:
    """A three-way merge of all parts; edges whose ends are gone go too."""
    conflicts, parts = [], {}
    for name, what in (("vertices", "Vertex"), ("hyper_edges", "HyperEdge"), ("variants", "Variant"), ("orderings", "Ordering"), ("recursion", "RecursionPoint"), ("spans", "Span"), ("usage", "UsageMode"), ("nominal", "Nominal"), ("coercions", "Coercion"), ("mergers", "Merger"), ("defaults", "Default"), ("policies", "Policy"), ("nsids", "Nsid"), ("required", "Required")):
        parts[name], found = merge_keyed(getattr(base, name), getattr(ours, name), getattr(theirs, name), what)
        conflicts += found
    flat = lambda s: {(v, k): x for v, c in s.constraints.items() for k, x in c.items()}
    merged, found = merge_keyed(flat(base), flat(ours), flat(theirs), "Constraint")
    conflicts += found
    constraints: dict = {}
    for (v, k), x in merged.items():
        constraints.setdefault(v, {})[k] = x
    # An edge is its ends, kind and name; sides agree on which there are, or one of them lost an end that the other's edge needs.
    edges, found = merge_keyed({e: True for e in base.edges}, {e: True for e in ours.edges}, {e: True for e in theirs.edges}, "Edge")
    conflicts += found
    kept = frozenset(e for e in edges if e.src in parts["vertices"] and e.tgt in parts["vertices"])
    conflicts += [("DanglingEdge", str(e)) for e in sorted(set(edges) - kept, key=str) if e not in base.edges]
    return Schema(ours.protocol, edges=kept, constraints={v: c for v, c in constraints.items() if v in parts["vertices"]}, **parts), conflicts
