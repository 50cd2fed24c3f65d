"""A declarative data-quality gate: rules over tables of text cells, quarantine, and an audit of the rules by mutation.

A violation is (rule, severity, row_id, value, detail); row_id is null for violations of the whole table. Every rule but
not_null and no_padding passes over null-like cells. Only rules of severity error quarantine rows or fail a run.
"""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.parsing import as_datetime, as_number, full_match, is_nullish, trimmed
from ..scratch import kept
from .sampling import before_cut, chosen, cut_of

ERROR, WARN = "error", "warn"
OPS = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b}

#: Kinds: number of columns at least, and the options of each: fixed values.
KINDS = {
    "not_null": (1, ()),
    "unique": (1, ()),
    "in_set": (1, ("allowed", "case_sensitive")),
    "range": (1, ("min", "max")),
    "matches": (1, ("pattern",)),
    "is_type": (1, ("type",)),
    "no_padding": (1, ()),
    "compare": (2, ("op", "as")),
    "foreign_key": (1, ("ref", "ref_column")),
    "row_count": (0, ("min", "max")),
    "columns_exist": (1, ()),
    "control_total": (1, ("stat", "expected", "tolerance")),
}
TYPES = ("string", "int", "integer", "float", "number", "date", "datetime")
ROW_KINDS = ("not_null", "in_set", "range", "matches", "is_type", "no_padding", "compare")


class SpecError(ValueError):
    """A rule that means nothing; a gate with such a rule must not run."""


@dataclass(frozen=True)
class Rule:
    id: str
    kind: str
    columns: tuple[str, ...] = ()
    severity: str = ERROR
    options: dict = field(default_factory=dict)


def rule(entry: dict) -> Rule:
    """A rule from its entry in a spec; everything unknown or lacking is an error."""
    entry = dict(entry)
    rid, kind = entry.pop("id", None), entry.pop("kind", None)
    if not rid:
        raise SpecError("a rule lacks an id")
    if kind not in KINDS:
        raise SpecError(f"rule {rid}: unknown kind {kind}; known: {', '.join(sorted(KINDS))}")
    severity = entry.pop("severity", ERROR)
    if severity not in (ERROR, WARN):
        raise SpecError(f"rule {rid}: severity is {ERROR} or {WARN}")
    single = entry.pop("column", None)
    cols = entry.pop("columns", [single] if single is not None else [])
    cols = [cols] if isinstance(cols, str) else cols
    if not all(isinstance(c, str) and c for c in cols):
        raise SpecError(f"rule {rid}: columns are non-empty names")
    need, known = KINDS[kind]
    if len(cols) < need:
        raise SpecError(f"rule {rid}: {kind} needs {need} column(s)")
    if unknown := set(entry) - set(known):
        raise SpecError(f"rule {rid}: {', '.join(sorted(unknown))} means nothing to {kind}")
    required = {"in_set": ("allowed",), "matches": ("pattern",), "foreign_key": ("ref", "ref_column"), "control_total": ("expected",), "is_type": ("type",)}.get(kind, ())
    if lacking := [k for k in required if k not in entry]:
        raise SpecError(f"rule {rid}: {kind} needs {', '.join(lacking)}")
    if kind in ("range", "row_count") and not set(entry) & {"min", "max"}:
        raise SpecError(f"rule {rid}: {kind} needs min or max")
    if kind == "is_type" and entry["type"] not in TYPES or kind == "compare" and (entry.get("op", "<") not in OPS or entry.get("as", "auto") not in ("auto", "number", "date", "datetime", "string")):
        raise SpecError(f"rule {rid}: unknown type or operator")
    if kind == "control_total" and entry.get("stat", "sum") not in ("sum", "mean", "min", "max", "count"):
        raise SpecError(f"rule {rid}: unknown stat")
    if kind == "matches":
        _check_pattern(rid, entry["pattern"])
    return Rule(rid, kind, tuple(cols), severity, entry)


def _check_pattern(rid: str, pattern: str) -> None:
    import re

    if re.search(r"\(\?P[<=]|\(\?\(", pattern):
        raise SpecError(f"rule {rid}: the engine reads this pattern differently")
    try:
        re.compile(pattern)
    except re.error as e:
        raise SpecError(f"rule {rid}: {e}") from e


def suite(entries: list[dict]) -> list[Rule]:
    rules = [rule(e) for e in entries]
    if not rules:
        raise SpecError("a suite without rules checks nothing")
    if len({r.id for r in rules}) < len(rules):
        raise SpecError("two rules have one id")
    return rules


def load_spec(text: str) -> list[Rule]:
    """A suite from TOML: tables [[rule]]."""
    try:
        return suite(tomllib.loads(text).get("rule", []))
    except tomllib.TOMLDecodeError as e:
        raise SpecError(str(e)) from e


class _Cells:
    """Forms of cells that rules ask for: each is computed once, in a projection below all rules, however many ask."""

    MAKE = {"empty": is_nullish, "number": as_number, "time": as_datetime}

    def __init__(self):
        self.asked: dict[tuple[str, str], str] = {}

    def of(self, form: str, column: str) -> Column:
        return F.col(self.asked.setdefault((form, column), f"_gate{len(self.asked)}_{form}"))

    def text(self, column: str) -> Column:
        return self.of("text", column)

    def empty(self, column: str) -> Column:
        return self.of("empty", column)

    def number(self, column: str) -> Column:
        return self.of("number", column)

    def time(self, column: str) -> Column:
        return self.of("time", column)

    def added(self, df: DataFrame) -> DataFrame:
        """df with the forms asked for; those of the trimmed text stand above it, so that a cell is trimmed once."""
        columns = {c for _, c in self.asked}
        texts = {c: self.asked.get(("text", c)) or f"_gate_text{i}" for i, c in enumerate(sorted(columns))}
        df = df.withColumns({name: trimmed(F.col(c)) for c, name in texts.items()}) if texts else df
        others = {name: self.MAKE[form](F.col(texts[c])) for (form, c), name in self.asked.items() if form != "text"}
        return df.withColumns(others) if others else df


def _finding(r: Rule, cells: _Cells) -> Column:
    """The detail of a row rule's violation, null if the row is fine."""
    o, name = r.options, r.columns[0]
    first = F.col(name)
    if r.kind == "not_null":
        return F.when(cells.empty(name), "empty")
    if r.kind == "no_padding":
        return F.when(first.isNotNull() & (first != cells.text(name)), "padded")
    some = ~cells.empty(name)
    if r.kind == "in_set":
        norm = (lambda x: x) if o.get("case_sensitive") else F.lower
        allowed = [a if o.get("case_sensitive") else a.lower() for a in o["allowed"]]
        return F.when(some & ~norm(cells.text(name)).isin(*allowed), "not an allowed value")
    if r.kind == "range":
        n = cells.number(name)
        out = F.when(some & n.isNull(), "not a number")
        if o.get("min") is not None:
            out = out.when(n < o["min"], f"below {o['min']:g}")
        if o.get("max") is not None:
            out = out.when(n > o["max"], f"above {o['max']:g}")
        return out
    if r.kind == "matches":
        return F.when(some & ~full_match(cells.text(name), o["pattern"]), "does not match")
    if r.kind == "is_type":
        kind = o["type"]
        if kind == "string":
            return F.lit(None).cast("string")
        if kind in ("int", "integer"):
            ok = cells.number(name).isNotNull() & (cells.number(name) == F.floor(cells.number(name)))
        else:
            ok = (cells.number(name) if kind in ("float", "number") else cells.time(name)).isNotNull()
        return F.when(some & ~F.coalesce(ok, F.lit(False)), f"not {kind}")
    op, mode, other = OPS[o.get("op", "<")], o.get("as", "auto"), r.columns[1]
    both = some & ~cells.empty(other)
    fits = []
    if mode in ("auto", "number"):
        fits.append((cells.number(name), cells.number(other)))
    if mode in ("auto", "date", "datetime"):
        fits.append((cells.time(name), cells.time(other)))
    if mode == "string":
        fits.append((first, F.col(other)))
    verdict = F.lit(None).cast("string")
    for a, b in reversed(fits):
        verdict = F.when(a.isNotNull() & b.isNotNull(), F.when(op(a, b), "").otherwise(f"expected {r.columns[0]} {o.get('op', '<')} {r.columns[1]}")).otherwise(verdict)
    return F.when(both, F.nullif(F.coalesce(verdict, F.lit("not comparable")), F.lit("")))


_SHAPE = "rule string, severity string, row_id long, value string, detail string"


def violations(df: DataFrame, rules: list[Rule], row_id: str = "row_id", refs: dict[str, DataFrame] | None = None) -> DataFrame:
    """All violations in long form. Row rules share one pass, table rules share one aggregate, others have a plan of their own.

    A rule whose column the table lacks reads it as null; a foreign key without its reference is a violation of the table.
    """
    refs = refs or {}
    lacking = {c for r in rules for c in r.columns} - set(df.columns)
    full = df.withColumns({c: F.lit(None).cast("string") for c in lacking}) if lacking else df
    cells = lambda r: F.concat_ws(" / ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in r.columns])
    say = lambda r, rid, value, detail: [F.lit(r.id).alias("rule"), F.lit(r.severity).alias("severity"), rid.cast("long").alias("row_id"), value.alias("value"), detail.alias("detail")]
    out = []
    if by_row := [r for r in rules if r.kind in ROW_KINDS]:
        forms = _Cells()
        found = F.array(*[F.struct(*say(r, F.col(row_id), cells(r), _finding(r, forms))) for r in by_row])
        out.append(forms.added(full).select(F.inline(F.filter(found, lambda v: v["detail"].isNotNull()))))
    for r in rules:
        if r.kind == "unique":
            keyed = full.select(F.col(row_id).alias("_r"), *[F.coalesce(trimmed(F.col(c)), F.lit("")).alias(f"_k{i}") for i, c in enumerate(r.columns)])
            ks = [f"_k{i}" for i in range(len(r.columns))]
            keyed = keyed.where(~reduce(lambda a, b: a & b, [is_nullish(F.col(k)) for k in ks]))
            firsts = keyed.groupBy(*ks).agg(F.min("_r").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
            again = keyed.join(firsts, ks).where("_r <> _first")
            out.append(again.select(*say(r, F.col("_r"), F.concat_ws(" | ", *ks), F.concat(F.lit("first seen at row "), F.col("_first").cast("string")))))
        elif r.kind == "foreign_key":
            ref = refs.get(r.options["ref"])
            if ref is None:
                out.append(df.sparkSession.createDataFrame([(r.id, r.severity, None, r.options["ref"], "reference dataset not supplied")], _SHAPE))
                continue
            known = ref.select(trimmed(F.col(r.options["ref_column"])).alias("_known")).distinct()
            cell = full.select(F.col(row_id).alias("_r"), F.col(r.columns[0]).cast("string").alias("_v")).where(~is_nullish(F.col("_v")))
            lost = cell.join(known, trimmed(F.col("_v")) == F.col("_known"), "left_anti")
            out.append(lost.select(*say(r, F.col("_r"), F.col("_v"), F.lit("no matching reference row"))))
    table = [r for r in rules if r.kind in ("row_count", "control_total", "columns_exist")]
    if table:
        aggs, none = [F.count(F.lit(1)).alias("_rows")], F.lit(None)
        for i, r in enumerate(table):
            if r.kind == "control_total":
                n = as_number(F.col(r.columns[0]))
                stat = r.options.get("stat", "sum")
                f = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count}[stat](n).cast("double")
                aggs += [f.alias(f"_s{i}"), F.count(n).alias(f"_c{i}")]
        one, found = full.agg(*aggs), []
        for i, r in enumerate(table):
            o = r.options
            if r.kind == "row_count":
                bad = F.lit(None).cast("string")
                if o.get("max") is not None:
                    bad = F.when(F.col("_rows") > o["max"], f"more than {o['max']} rows").otherwise(bad)
                if o.get("min") is not None:
                    bad = F.when(F.col("_rows") < o["min"], f"fewer than {o['min']} rows").otherwise(bad)
                found.append(F.struct(*say(r, none, F.col("_rows").cast("string"), bad)))
            elif r.kind == "columns_exist":
                for c in r.columns:
                    found.append(F.struct(*say(r, none, F.lit(c), F.when((F.col("_rows") > 0) & F.lit(c not in df.columns), "column missing"))))
            else:
                limit = abs(o["expected"]) * o.get("tolerance", 0.01)
                off = F.when(F.col(f"_c{i}") == 0, f"no numeric values in {r.columns[0]}").when(F.abs(F.col(f"_s{i}") - o["expected"]) > limit, f"expected {o['expected']:g} within {o.get('tolerance', 0.01):g}")
                found.append(F.struct(*say(r, none, F.coalesce(F.col(f"_s{i}"), F.lit(0.0)).cast("string"), off)))
        out.append(one.select(F.inline(F.filter(F.array(*found), lambda v: v["detail"].isNotNull()))))
    return reduce(DataFrame.unionByName, out)


def tally(df: DataFrame, rules: list[Rule], row_id: str = "row_id", refs: dict[str, DataFrame] | None = None) -> DataFrame:
    """(rule, n) of the rules that have violations, as violations() has them, but no row is made for one: row rules are counted in one aggregate, repeated and unknown values by value. row_id tells rows apart."""
    refs = refs or {}
    lacking = {c for r in rules for c in r.columns} - set(df.columns)
    full = df.withColumns({c: F.lit(None).cast("string") for c in lacking}) if lacking else df
    out, rest = [], []
    if by_row := [r for r in rules if r.kind in ROW_KINDS]:
        forms = _Cells()
        found = [F.count(_finding(r, forms)).alias(f"_r{i}") for i, r in enumerate(by_row)]
        one = forms.added(full).agg(*found)
        out.append(one.select(F.inline(F.array(*[F.struct(F.lit(r.id).alias("rule"), F.col(f"_r{i}").alias("n")) for i, r in enumerate(by_row)]))))
    for r in rules:
        if r.kind == "unique":
            ks = [f"_k{i}" for i in range(len(r.columns))]
            n = full.select(*[F.coalesce(trimmed(F.col(c)), F.lit("")).alias(k) for c, k in zip(r.columns, ks, strict=True)]).groupBy(*ks).agg(F.count(F.lit(1)).alias("_n"))
            n = n.where(~reduce(lambda a, b: a & b, [is_nullish(F.col(k)) for k in ks]))
            out.append(n.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("n")).select(F.lit(r.id).alias("rule"), "n"))
        elif r.kind == "foreign_key" and r.options["ref"] in refs:
            known = refs[r.options["ref"]].select(trimmed(F.col(r.options["ref_column"])).alias("_known")).distinct()
            n = full.select(trimmed(F.col(r.columns[0])).alias("_v")).where(~is_nullish(F.col("_v"))).groupBy("_v").agg(F.count(F.lit(1)).alias("_n"))
            out.append(n.join(known, F.col("_v") == F.col("_known"), "left_anti").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n")).select(F.lit(r.id).alias("rule"), "n"))
        elif r.kind not in ROW_KINDS:
            rest.append(r)
    if rest:  # of the whole table: a row or two
        out.append(violations(df, rest, row_id, refs).groupBy("rule").agg(F.count(F.lit(1)).alias("n")))
    return reduce(DataFrame.unionByName, out).where("n > 0")


def _of_every(df: DataFrame, rules: list[Rule], found: DataFrame) -> DataFrame:
    """(rule, severity, violations) of every rule, 0 included, from the (rule, n) of some."""
    all_ = df.sparkSession.createDataFrame([(r.id, r.severity) for r in rules], "rule string, severity string")
    return all_.join(found, "rule", "left").select("rule", "severity", F.coalesce("n", F.lit(0)).cast("long").alias("violations"))


def counts(df: DataFrame, rules: list[Rule], **kw) -> DataFrame:
    """(rule, severity, violations) of every rule, 0 included."""
    return _of_every(df, rules, tally(df, rules, **kw))


def split(df: DataFrame, rules: list[Rule], row_id: str = "row_id", **kw) -> tuple[DataFrame, DataFrame]:
    """(clean, quarantined): rows without and with a violation of an error rule; row_id keeps their order."""
    bad = violations(df, [r for r in rules if r.severity == ERROR], row_id, **kw).where("row_id is not null").select(F.col("row_id").alias("_bad")).distinct()
    return df.join(bad, df[row_id] == F.col("_bad"), "left_anti"), df.join(bad, df[row_id] == F.col("_bad"), "left_semi")


def report(df: DataFrame, rules: list[Rule], examples: int = 5, **kw) -> DataFrame:
    """For each rule: violations, rate, and up to `examples` of them, by row. The violations are written once and read twice."""
    v = kept(violations(df, rules, **kw), "violations")
    top = v.withColumn("_k", F.row_number().over(Window.partitionBy("rule").orderBy("row_id", "value"))).where(F.col("_k") <= examples)
    shown = top.groupBy("rule").agg(F.sort_array(F.collect_list(F.struct("row_id", "value", "detail"))).alias("examples"))
    total = df.agg(F.count(F.lit(1)).alias("_rows"))
    n = _of_every(df, rules, v.groupBy("rule").agg(F.count(F.lit(1)).alias("n")))
    t = n.join(shown, "rule", "left").crossJoin(F.broadcast(total))
    return t.select("rule", "severity", "violations", F.coalesce(F.try_divide("violations", "_rows"), F.lit(0.0)).alias("rate"), "examples")


def profile(df: DataFrame, rows: int = 200, numeric_share: float = 0.8) -> tuple[list[str], list[str]]:
    """(numeric, textual) columns by a look at the first rows."""
    head = df.limit(rows).agg(F.count(F.lit(1)).alias("_n"), *[F.count(as_number(F.col(c))).alias(c) for c in df.columns]).first()
    numeric = [c for c in df.columns if head[c] > head["_n"] * numeric_share]
    return numeric, [c for c in df.columns if c not in numeric]


# Mutations: damage that a good suite notices. Each takes a table of text cells with a row_id. One that leaves the rows as
# they are and changes only some columns names these as its `columns`.


def _changes(columns, apply):
    apply.columns = frozenset(columns)
    return apply


def _some(columns, share: float, seed: int, change, row_id: str = "row_id"):
    """`change` on a share of the rows that have a value in the first column."""

    def apply(df: DataFrame) -> DataFrame:
        has = ~is_nullish(F.col(columns[0]))
        out = df.crossJoin(F.broadcast(cut_of(df.where(has), [row_id], share, seed, 1)))  # one row
        return change(out, has & before_cut([row_id], seed)).select(*df.columns)

    return _changes(columns, apply)


def _set(column: str, value):
    return lambda df, hit: df.withColumn(column, F.when(hit, value(F.col(column))).otherwise(F.col(column)))


def _scaled(factor: float):
    return lambda c: F.coalesce((as_number(c) * factor).cast("string"), c)


def _swapped(a: str, b: str):
    return lambda df, hit: df.withColumns({a: F.when(hit, F.col(b)).otherwise(F.col(a)), b: F.when(hit, F.col(a)).otherwise(F.col(b))})


def blank_out(column, share=0.05, seed=1):
    return _some([column], share, seed, _set(column, lambda c: F.lit("")))


def duplicate_rows(share=0.03, seed=2, row_id="row_id"):
    def apply(df):
        more = chosen(df, [row_id], share, seed).where("_chosen").drop("_chosen")
        top = df.agg((F.max(row_id) + 1).alias("_top"))
        return df.unionByName(more.crossJoin(F.broadcast(top)).withColumn(row_id, F.col(row_id) + F.col("_top")).drop("_top"))

    return apply


def drop_rows(share=0.2, seed=3, row_id="row_id"):
    return lambda df: df.crossJoin(F.broadcast(cut_of(df, [row_id], 1 - share, seed))).where(before_cut([row_id], seed)).select(*df.columns)


def shift_decimal(column, factor=10, share=0.04, seed=4):
    return _some([column], share, seed, _set(column, _scaled(factor)))


def rescale(column, factor=1.609):
    return _changes([column], lambda df: df.withColumn(column, _scaled(factor)(F.col(column))))


def swap_columns(a, b):
    return _changes([a, b], lambda df: df.withColumns({a: F.col(b), b: F.col(a)}))


def unknown_category(column, value="UNSPECIFIED", share=0.05, seed=5):
    return _some([column], share, seed, _set(column, lambda c: F.lit(value)))


def pad_whitespace(column, share=0.1, seed=6):
    return _some([column], share, seed, _set(column, lambda c: F.concat(F.lit("  "), c, F.lit(" "))))


def reverse_pair(a, b, share=0.03, seed=7):
    return _some([a, b], share, seed, _swapped(a, b))


def inject_outlier(column, factor=1000, seed=8):
    return _some([column], 0.0, seed, _set(column, _scaled(factor)))


def truncate_values(column, chars=1, share=0.04, seed=9):
    return _some([column], share, seed, _set(column, lambda c: F.when(F.length(c) > chars, F.substr(c, F.lit(1), F.length(c) - chars)).otherwise(c)))


def corrupt_type(column, value="n/a-see-notes", share=0.03, seed=10):
    return _some([column], share, seed, _set(column, lambda c: F.lit(value)))


def default_mutations(df: DataFrame, row_id: str = "row_id") -> dict:
    """Mutations that make sense for the table's columns."""
    numeric, textual = profile(df.drop(row_id))
    out = {"duplicate_rows": duplicate_rows(), "drop_rows": drop_rows()}
    if textual:
        t = textual[0]
        out |= {f"blank_out({t})": blank_out(t), f"pad_whitespace({t})": pad_whitespace(t), f"unknown_category({t})": unknown_category(t), f"truncate_values({t})": truncate_values(t)}
    if len(textual) > 1:
        out[f"swap_columns({textual[0]},{textual[1]})"] = swap_columns(*textual[:2])
    if numeric:
        n = numeric[0]
        out |= {f"blank_out({n})": blank_out(n), f"shift_decimal({n})": shift_decimal(n), f"rescale({n})": rescale(n), f"inject_outlier({n})": inject_outlier(n), f"corrupt_type({n})": corrupt_type(n)}
    if len(numeric) > 1:
        out[f"swap_columns({numeric[0]},{numeric[1]})"] = swap_columns(*numeric[:2])
    return out


def audit(df: DataFrame, rules: list[Rule], mutations: dict, **kw) -> DataFrame:
    """(mutation, caught, noticed_by): an error rule notices a mutation if it has more violations than before.

    Where a mutation says which columns it changes, only rules on these are counted again: the others find what they found.
    """
    rules = [r for r in rules if r.severity == ERROR]
    base = tally(df, rules, **kw).select("rule", F.col("n").alias("before"))
    runs = []
    for name, m in mutations.items():
        touched = getattr(m, "columns", None)
        if again := [r for r in rules if touched is None or touched & set(r.columns)]:
            runs.append(tally(m(df), again, **kw).select(F.lit(name).alias("mutation"), "rule", "n"))
    names = df.sparkSession.createDataFrame([(name,) for name in mutations], "mutation string")
    if not runs:
        return names.select("mutation", F.lit(False).alias("caught"), F.array().cast("array<string>").alias("noticed_by"))
    after = reduce(DataFrame.unionByName, runs).join(F.broadcast(base), "rule", "left").where(F.col("n") > F.coalesce("before", F.lit(0)))  # one row for each rule
    noticed = after.groupBy("mutation").agg(F.sort_array(F.collect_list("rule")).alias("noticed_by"))
    by = F.coalesce("noticed_by", F.array().cast("array<string>"))
    return names.join(noticed, "mutation", "left").select("mutation", (F.size(by) > 0).alias("caught"), by.alias("noticed_by"))


def score(audited: DataFrame) -> DataFrame:
    return audited.agg(F.count(F.lit(1)).alias("mutations"), F.count_if("caught").alias("caught")).withColumn("score", F.try_divide("caught", "mutations"))
