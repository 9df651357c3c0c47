"""References to tables and columns in statement texts: one pass over a text's tokens with a stack of scopes.

No grammar is built. A text is cut into words and signs; brackets open frames, and a query inside brackets opens a scope
with tables, aliases and WITH names of its own. A scope's columns are looked up when it ends: in its own names, then in
those of the scopes around it. Logs repeat the same statements with other literals, so texts are first brought to their
shape, literals and comments removed, by built-in functions; each distinct shape is read once and its references are
joined back to the statements.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.names import is_rtl
from ..functions.text import normalize_name
from ..plans.scratch import materialize, small_side

#: What a text is cut into: texts and comments (dropped), names, numbers, other signs. Brackets behind a name are no quotes.
TOKEN = re.compile(
    r"N?'(?:[^']|'')*'|--[^\n]*|/\*.*?\*/|(?P<quoted>\"[^\"]+\"|(?<![\w\])\"`])\[[^\]\n]+\]|`[^`]+`)|(?P<param>[@$?]\w+|(?<!:):(?!:)\w+)|(?P<name>[^\W\d][\w$#@]*)|[\d.]*\d\w*|(?P<sign>::|[^\s\w])", re.DOTALL
)
#: Words that begin a clause, that take a table, and that are no names of columns or aliases.
CLAUSES = {"select": "select", "where": "where", "on": "join_on", "group": "group_by", "order": "order_by", "having": "", "limit": "", "offset": "", "values": "", "set": "where"}
TAKES_TABLE = frozenset("from join into update using apply".split())
CALLS, CALL_WORDS = ("extract", "trim"), frozenset("year quarter month week day hour minute second epoch dow doy both leading trailing".split())
BRANCHES = frozenset("union intersect except minus".split())
WORDS = frozenset(
    "all and any apply as asc between by case cast collate cross current delete desc distinct else end escape except exists false fetch first following for full "
    "ilike in inner insert intersect interval is last lateral left like matched merge minus natural next not null nulls only or outer over partition preceding range recursive "
    "regexp right rlike row rows some table then top true unbounded union using when window with".split()
)
KEYWORDS = WORDS | CLAUSES.keys() | TAKES_TABLE


def tokens(text: str) -> list[tuple[str, list[str] | str]]:
    """('name', segments), ('word', lower-cased keyword), ('sign', sign) or ('value', '') in order; blanks round a name's dots don't matter."""
    out: list[tuple[str, list[str] | str]] = []
    dotted = False
    for m in TOKEN.finditer(text):
        if m["sign"] == "." and out and out[-1][0] == "name":
            dotted = True
        elif m["quoted"] or m["name"]:
            name = m["name"] or m["quoted"][1:-1]
            if dotted:
                out[-1][1].append(name.lower())
            elif m["name"] and name.lower() in KEYWORDS:
                out.append(("word", name.lower()))
            else:
                out.append(("name", [name.lower()]))
            dotted = False
        elif m[0].startswith(("--", "/*")):
            continue
        else:
            out.append(("sign", m["sign"]) if m["sign"] else ("value", ""))
            dotted = False
    return out


@dataclass
class Scope:
    """A query's names: what an alias or a table's short name stands for (None: nothing known), its first table, and columns that still look for their table."""

    up: Scope | None
    names: dict[str, str | None] = field(default_factory=dict)
    withs: dict[str, str | None] = field(default_factory=dict)
    aliases: set[str] = field(default_factory=set)
    first: str | None = None
    columns: list[tuple[int, str, str | None]] = field(default_factory=list)
    target: str | None = None


@dataclass
class Frame:
    """What an open bracket holds: a query, a call's arguments, a join in brackets, a column list, or other things; and what goes on behind it."""

    kind: str
    scope: Scope
    clause: str
    want: str
    name: str = ""


class Pass:
    """One statement text's references, in order. A column is (role, table or None, name) once its scope has ended."""

    def __init__(self, text: str):
        self.found = tokens(text)
        self.tables: list[tuple[str, str]] = []
        self.columns: list[list] = []
        self.outputs: list[tuple[str]] = []
        self.scope, self.frames = Scope(None), []
        self.clause, self.want, self.merge, self.derived = "", "", False, None
        for self.i, (kind, value) in enumerate(self.found):
            getattr(self, kind)(value)
        while self.frames:
            self.close()
        self.end()

    def at(self, step: int):
        i = self.i + step
        return self.found[i] if 0 <= i < len(self.found) else ("", "")

    # Scopes

    def end(self) -> str | None:
        """End the present scope: look its columns up, pass on to the scope around it those that it doesn't know. Returns its first table."""
        own = self.scope
        for at, qualifier, first in own.columns:
            first = first or own.first or own.target
            if not qualifier and first:
                self.columns[at][1] = first
            elif qualifier and qualifier in own.names:
                self.columns[at][1] = own.names[qualifier]
            elif own.up:
                own.up.columns.append((at, qualifier, first))
            else:
                self.columns[at][1] = first
        own.columns = []
        return own.first

    def branch(self) -> None:
        """A scope beside the present one: the next member of a UNION, or the query behind INSERT."""
        first, withs = self.end(), self.scope.withs
        self.scope = Scope(self.scope.up, withs=withs)
        if self.frames and self.frames[-1].kind == "query":
            self.frames[-1].name = self.frames[-1].name or first or ""

    def known(self, name: str) -> tuple[bool, str | None]:
        """Whether a name is one of WITH here or further out, and the first table of its query."""
        scope = self.scope
        while scope:
            if name in scope.withs:
                return True, scope.withs[name]
            scope = scope.up
        return False, None

    def output(self, name: str) -> None:
        """A name that the statement's first query gives back: an alias, or a column that none follows."""
        if not self.frames and self.clause == "select" and self.at(1) in (("sign", ","), ("word", "from"), ("", ""), ("sign", ";")):
            self.outputs.append((name,))

    def column(self, role: str, qualifier: str, name: str, first: str | None = None) -> None:
        self.columns.append([role, None, name])
        self.scope.columns.append((len(self.columns) - 1, qualifier, first))

    def open(self, kind: str, name: str = "") -> None:
        self.frames.append(Frame(kind, self.scope, self.clause, self.want, name))
        if kind == "query":
            self.scope = Scope(self.scope)
        self.want = "table" if kind == "join" else ""
        self.clause = {"query": "", "skip": "", "columns": "select"}.get(kind, self.clause)

    def close(self) -> None:
        frame = self.frames.pop()
        if frame.kind == "query":
            first = self.end()
            self.derived = frame.name or first
            if frame.name.startswith("with "):
                frame.scope.withs[frame.name[5:]] = first
        self.scope, self.clause, self.want = frame.scope, frame.clause, frame.want
        if frame.kind in ("query", "values", "call") and frame.want == "table":
            self.scope.first = self.scope.first or (self.derived if frame.kind == "query" else None)
            self.want = "derived"
            self.derived = self.derived if frame.kind == "query" else None
        elif frame.kind == "join":
            self.want = ""

    # Tokens

    def clauses_here(self) -> bool:
        """Whether FROM and its like are clauses: not in a call's brackets, nor behind IS DISTINCT."""
        return (not self.frames or self.frames[-1].kind in ("query", "join", "statement")) and self.at(-1) != ("word", "distinct")

    def word(self, value: str) -> None:
        if value in BRANCHES and self.clauses_here():
            self.branch()
            self.clause, self.want = "", ""
        elif value == "select" and self.scope.target and not self.scope.first and not self.merge:
            self.branch()
            self.clause, self.want = "select", ""
        elif value == "merge":
            self.merge = True
        elif value in TAKES_TABLE:
            if value == "update" and self.at(1) == ("word", "set") or value == "using" and not self.merge:
                self.clause, self.want = ("", "") if value == "update" else ("join_on", "")
            elif self.clauses_here():
                self.clause, self.want = "", "target" if value in ("into", "update") else "table"
        elif value == "insert" and self.at(1) == ("sign", "("):
            self.want = "columns"
        elif value in CLAUSES:
            if value != "on" or self.at(-1) != ("word", "distinct"):
                self.clause, self.want = CLAUSES[value], ""
        elif value in ("partition", "when"):
            self.clause = "" if value == "partition" or self.merge else self.clause
        elif value == "with" and self.at(1) == ("sign", "("):
            self.want = "skip"

    def sign(self, value: str) -> None:
        before, after = self.at(-1), self.at(1)
        if value == "(":
            name = before[1][-1] if before[0] == "name" else before[1] if before[0] == "word" else ""
            if after in (("word", "select"), ("word", "with")):
                self.open("query", f"with {self.pending()}" if self.want == "with" else "")
                if self.frames[-1].want == "with":
                    self.frames[-1].want = ""
            elif self.want == "columns":
                self.open("columns")
                self.frames[-1].want = ""
            elif self.want == "skip" or self.want == "alias" and before[0] == "name":
                self.open("skip")
                self.frames[-1].want = "done"
            elif self.want == "table" and before[0] != "name":
                self.open("values" if after == ("word", "values") else "join")
            else:
                self.open("call" if before[0] in ("name", "word") else "group", name)
        elif value == ")" and self.frames:
            self.close()
        elif value == "," and self.want in ("alias", "derived", "done"):
            self.want = "table"
        elif value == "," and self.clauses_here() and (self.clause == "join_on" or self.frames and self.frames[-1].kind == "join"):
            self.clause, self.want = "", "table"
        elif value == ";" and not self.frames:
            self.end()
            self.scope, self.clause, self.want, self.merge = Scope(None), "", "", False

    def value(self, _: str) -> None:
        """Literals are no references."""

    def pending(self) -> str:
        """The name of WITH that stands before the query that opens: name AS ( or name (columns) AS ( , with MATERIALIZED or not."""
        i, depth = self.i - 1, 0
        while i >= 0:
            kind, value = self.found[i]
            depth += (value == ")") - (value == "(") if kind == "sign" else 0
            if not depth and kind == "name" and value[0] != "materialized":
                return value[0]
            i -= 1
        return ""

    def starts_with_query(self) -> bool:
        """Whether the name here is defined by WITH: an optional column list, then AS and an opening bracket."""
        if self.at(-1) not in (("word", "with"), ("word", "recursive"), ("sign", ",")):
            return False
        step, depth = 1, 0
        if self.at(step) == ("sign", "("):
            while self.i + step < len(self.found):
                token = self.at(step)
                depth += (token == ("sign", "(")) - (token == ("sign", ")"))
                step += 1
                if not depth:
                    break
        if self.at(step) != ("word", "as"):
            return False
        step += 1
        while self.at(step) in (("word", "not"), ("name", ["materialized"])):
            step += 1
        return self.at(step) == ("sign", "(") and self.at(step + 1) in (("word", "select"), ("word", "with"))

    def name(self, value: list[str]) -> None:
        before, after = self.at(-1), self.at(1)
        if not self.want and self.starts_with_query():
            self.want, self.clause = "with", ""
        elif self.want == "with":
            pass
        elif self.want == "table" and after == ("sign", "("):
            pass  # a table function
        elif self.want in ("table", "target"):
            self.table(value)
        elif self.want in ("alias", "derived"):
            if before[0] == "name" or before in (("word", "as"), ("sign", ")")):
                key = (self.tables[-1][0] if self.tables else None) if self.want == "alias" else self.derived
                if self.want == "alias" and self.bound:
                    self.scope.names[value[0]] = self.bound[0]
                    if self.bound[1]:
                        self.tables[-1] = (self.tables[-1][0], value[0])
                else:
                    self.scope.names[value[0]] = key
                self.want = "alias" if after == ("sign", "(") else "done"
        elif self.clause and after != ("sign", "(") and before != ("sign", "::"):
            inner = self.frames[-1] if self.frames else None
            if inner and inner.kind == "call" and (before == ("word", "as") or value[0] in CALL_WORDS and before == ("sign", "(") and inner.name in CALLS):
                return  # the type of a CAST, or what EXTRACT and TRIM take out
            if before == ("word", "as") or before[0] in ("name", "value") or before in (("sign", ")"), ("word", "end")):
                self.scope.aliases.add(value[0])
                self.output(value[0])
            elif len(value) > 1:
                self.output(value[-1])
                self.column(self.clause, value[-2], value[-1])
            elif value[0] not in self.scope.aliases:
                self.output(value[0])
                self.column(self.clause, "", value[0], self.scope.target if inner and inner.kind == "columns" else None)

    bound: tuple[str | None, bool] | None = None

    def table(self, value: list[str]) -> None:
        """A name where a table is asked for: one of WITH, or a table."""
        scope, target = self.scope, self.want == "target"
        common, key = self.known(value[0]) if len(value) == 1 else (False, None)
        if not common:
            key = ".".join(value[-2:])
            self.tables.append((key, value[-1]))
        self.bound = (key, not common)
        if not target or self.merge or self.at(-1) == ("word", "update"):
            scope.first = scope.first or key
        if target:
            scope.target = scope.target or key
        scope.names.setdefault(value[-1], key)
        self.want = "columns" if target and self.at(-1) == ("word", "into") and not self.merge else "alias"


def outputs(text: str | None) -> list[tuple[str]]:
    """Names of the columns that a statement gives back, in order: aliases and bare columns of the SELECT lists outside brackets; a star or an unnamed expression has none."""
    return Pass(text or "").outputs


def references(text: str | None) -> tuple[list[tuple[str, str]], list[tuple[str, str | None, str]]]:
    """A statement's tables (key, alias) in order, and its columns (role, key, name).

    A key is the last two segments of a table's name. A column's qualifier is an alias or the end of a table's name, in
    its own query or one around it; an unqualified column, or one with an unknown qualifier, counts for the first table
    that its query reads, a column of a derived table or of a WITH name for the first table that that query reads. FROM
    inside a call (EXTRACT, TRIM) or behind IS DISTINCT is no clause, table functions and lateral calls are no tables,
    MERGE reads what stands behind USING, members of a UNION and statements behind a semicolon are queries of their own.
    Columns of INSERT INTO t (...) count as selected from t.
    """
    done = Pass(text or "")
    return done.tables, [tuple(c) for c in done.columns]


#: Parts of a text that a shape changes: texts and comments (names in quotes are kept), then numbers outside such names.
_QUOTED = r"\"[^\"]*+\"|`[^`]*+`|(?<![\w\])\"`])\[[^\]\n]++\]"
_TEXTS = rf"N?(')(?:[^']++|'')*+(')|({_QUOTED})|--[^\n]*+|(?s:/\*.*?\*/)"
_NUMBERS = r"(?<![\w.])\d[\d.]*(?:[eE][+-]?\d+)?(?!\w)"


def shape(sql: Column) -> Column:
    """A statement without its literals: texts emptied, numbers 0, comments and runs of blanks one blank. It has the same references."""
    once = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)  # noqa: E731  # a value that is used more than once, made once
    holds = lambda c, *signs: reduce(or_, (F.contains(c, F.lit(s)) for s in signs))
    numbers = lambda c: F.regexp_replace(c, _NUMBERS, "0")
    names = lambda c: F.regexp_extract_all(c, F.lit(_QUOTED), F.lit(0))
    between = lambda c: F.zip_with(F.transform(F.split(c, _QUOTED, -1), numbers), names(c), lambda x, n: F.concat(x, F.coalesce(n, F.lit(""))))
    plain = lambda c: F.when(holds(c, "'", "--", "/*"), F.regexp_replace(c, _TEXTS, "$1$2$3 ")).otherwise(c)
    bare = once(plain(F.coalesce(sql, F.lit(""))), lambda c: F.when(holds(c, '"', "`", "["), F.array_join(between(c), "")).otherwise(numbers(c)))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def _rows(log: DataFrame, sql: str, read: Callable[[str], list[tuple]], schema: str) -> DataFrame:
    """A row for each reference of a kind: (stmt, pos, ...). Shapes are read once; the table of their references is broadcast only if it is small."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, READ_ROWS):
                b = whole.slice(at, READ_ROWS)
                hits = [(i, n, *ref) for i, text in enumerate(b.column(1).to_pylist()) for n, ref in enumerate(read(text))]
                cols = list(zip(*hits)) or [()] * len(names)
                who = b.column(0).take(pa.array(cols[0], pa.int64()))
                yield pa.RecordBatch.from_arrays([who, pa.array(cols[1], pa.int32()), *(pa.array(c, pa.string()) for c in cols[2:])], names=names)

    shaped = materialize(log.select("stmt", shape(F.col(sql)).alias("_text"))).withColumn("_shape", F.md5("_text"))
    distinct = materialize(shaped.groupBy("_shape").agg(F.first("_text").alias("_text")))
    found = materialize(distinct.select("_shape", "_text").mapInArrow(run, schema).withColumnRenamed("stmt", "_of"))
    wide = ["_of", *names[2:]]
    return shaped.select("stmt", "_shape").join(small_side(found, *wide), F.col("_shape") == F.col("_of")).select("stmt", *names[1:])


#: How a text looks that reads or writes a table.
READS = r"(?i)\b(from|join|into|update)\s+[\"\[`]?\w"
#: Shapes that are read at a time.
READ_ROWS = 512


def table_refs(log: DataFrame, sql: str = "sql") -> DataFrame:
    """(stmt, pos, table_key, alias): a row for each table that is read or written, in order; keys are the last two segments, lower-cased."""
    return _rows(log, sql, lambda text: references(text)[0], "stmt string, pos int, table_key string, alias string")


def column_refs(log: DataFrame, sql: str = "sql") -> DataFrame:
    """(stmt, pos, role, table_key, name): a row for each column in SELECT lists and INSERT columns, after WHERE, and in ON, GROUP BY and ORDER BY clauses.

    table_key is null where a statement reads no table that a column could be of.
    """
    return _rows(log, sql, lambda text: references(text)[1], "stmt string, pos int, role string, table_key string, name string")


def mined_pairs(log: DataFrame, catalog: DataFrame, sql: str = "sql") -> DataFrame:
    """(token, follower, n): right-to-left columns that are directly followed, in a statement's order, by a column of the catalog (col) in another script that doesn't end in _id.

    The order is that of references, in a window for each statement; names are compared normalised.
    """
    name = normalize_name(F.col("name"))
    rows = column_refs(log, sql).select("stmt", "pos", name.alias("token"))
    follower = F.lead("token").over(Window.partitionBy("stmt").orderBy("pos"))
    pairs = rows.withColumn("follower", follower).where(is_rtl(F.col("token")) & ~is_rtl(F.col("follower")) & ~F.col("follower").endswith("_id"))
    known = catalog.select(normalize_name(F.col("col")).alias("follower")).distinct()
    return pairs.join(known, "follower", "left_semi").groupBy("token", "follower").agg(F.count("*").alias("n"))


def output_columns(log: DataFrame, sql: str = "sql") -> DataFrame:
    """(stmt, pos, name): a row for each named column that a statement gives back, in order."""
    return _rows(log, sql, outputs, "stmt string, pos int, name string")


def signatures(log: DataFrame, sql: str = "sql") -> DataFrame:
    """(stmt, relations, columns): what a version of a statement reads and gives back, as sorted arrays of distinct names; statements repeat no stmt."""
    none = F.array().cast("array<string>")
    names = lambda df, c, out: df.groupBy("stmt").agg(F.sort_array(F.collect_set(c)).alias(out))
    rows = log.select("stmt").distinct().join(names(table_refs(log, sql), "table_key", "relations"), "stmt", "left").join(names(output_columns(log, sql), "name", "columns"), "stmt", "left")
    return rows.select("stmt", F.coalesce("relations", none).alias("relations"), F.coalesce("columns", none).alias("columns"))


def drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """(stmt, state, gained_relations, lost_relations, gained_columns, lost_columns) between two versions of signatures(): state is new, dropped, changed or same."""
    a, b = (df.select("stmt", F.col("relations").alias(f"{v}r"), F.col("columns").alias(f"{v}c")) for v, df in (("a", old), ("b", new)))
    rows = a.join(b, "stmt", "full")
    none = F.array().cast("array<string>")
    less = lambda x, y: F.array_except(F.coalesce(x, none), F.coalesce(y, none))
    same = (F.col("ar") == F.col("br")) & (F.col("ac") == F.col("bc"))
    state = F.when(F.col("ar").isNull(), "new").when(F.col("br").isNull(), "dropped").when(same, "same").otherwise("changed")
    return rows.select("stmt", state.alias("state"), less("br", "ar").alias("gained_relations"), less("ar", "br").alias("lost_relations"), less("bc", "ac").alias("gained_columns"), less("ac", "bc").alias("lost_columns"))


def ingest(log: DataFrame, environment: Column, sql: str = "sql") -> tuple[DataFrame, dict[str, int]]:
    """A run over a log: its references (stmt, table_key), written, and the run's counters, observed while they are written.

    environment is true for statements that count. Each statement is one of: skipped_env_mismatch, skipped_empty (blank,
    or a lone comment), parsed (the token pass finds a table), fallback (it finds none where outcome() sees one),
    unparsed. total counts them all, references what was written. No second scan of the log counts anything.
    """
    said = F.trim(F.coalesce(F.col(sql), F.lit("")))
    skip = F.when(~F.coalesce(environment, F.lit(False)), "skipped_env_mismatch").when((said == "") | said.startswith("--"), "skipped_empty")
    marked = log.select("stmt", sql, skip.alias("_skip"), said.rlike(READS).alias("_reads"))
    used = marked.where("_skip is null").select("stmt", F.col(sql).alias("sql"))
    found = table_refs(used).groupBy("stmt").agg(F.collect_list("table_key").alias("_keys"))
    rows = marked.join(found, "stmt", "left").withColumn("_keys", F.coalesce("_keys", F.array().cast("array<string>")))
    kind = F.coalesce("_skip", F.when(F.size("_keys") > 0, "parsed").when(F.col("_reads"), "fallback").otherwise("unparsed"))
    seen = Observation()
    counts = [F.count_if(F.col("_kind") == k).alias(k) for k in ("parsed", "fallback", "unparsed", "skipped_empty", "skipped_env_mismatch")]
    watched = rows.withColumn("_kind", kind).observe(seen, F.count(F.lit(1)).alias("total"), *counts, F.sum(F.size("_keys")).alias("references"))
    refs = materialize(watched.select("stmt", F.explode("_keys").alias("table_key")))
    return refs, {k: v or 0 for k, v in seen.get.items()}


def outcome(log: DataFrame, sql: str = "sql") -> DataFrame:
    """(stmt, outcome): skipped_empty for blank texts and lone comments, regex where a table stands behind FROM, JOIN, INTO or UPDATE, else empty."""
    text = F.trim(F.coalesce(F.col(sql), F.lit("")))
    kind = F.when((text == "") | text.startswith("--"), "skipped_empty").when(text.rlike(READS), "regex").otherwise("empty")
    return log.select("stmt", kind.alias("outcome"))
