"""Joins, subquery forms, set operations and data-changing statements as pure functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def optional_filters(df: DataFrame, equal: dict | None = None, contains: dict | None = None) -> DataFrame:
    """Keeps rows that meet each given condition; None means no condition.

    contains has a text by a tuple of columns: one of them must hold it, without regard to case, and % and _ are themselves.
    """
    for c, v in (equal or {}).items():
        if v is not None:
            df = df.where(F.col(c) == F.lit(v))
    for cols, v in (contains or {}).items():
        if v:
            df = df.where(reduce(lambda a, b: a | b, [F.contains(F.lower(F.col(c)), F.lit(v.lower())) for c in cols]))
    return df


def counted_left(left: DataFrame, right: DataFrame, key: str, right_key: str, name: str) -> DataFrame:
    """left with the number of rows of right for each of its rows, 0 where there is none; right is counted before it is joined."""
    n = right.groupBy(F.col(right_key).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    return left.join(n, left[key] == n["_k"], "left").withColumn(name, F.coalesce("_n", F.lit(0)).cast("long")).drop("_k", "_n")


def not_in(df: DataFrame, column: str, values: DataFrame, value_column: str) -> DataFrame:
    """SQL's NOT IN: nothing if the values have a null, all rows if there are no values, and no rows with a null otherwise."""
    v = values.select(F.col(value_column).alias("_v"))
    state = v.agg(F.count(F.lit(1)).alias("_rows"), F.count_if(F.col("_v").isNull()).alias("_nulls"))  # one row
    rest = df.join(v.where("_v is not null").distinct(), df[column] == F.col("_v"), "left_anti").crossJoin(F.broadcast(state))
    return rest.where((F.col("_rows") == 0) | (F.col("_nulls") == 0) & F.col(column).isNotNull()).drop("_rows", "_nulls")


def reciprocal_pairs(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(a, b) with a < b for which both a -> b and b -> a are edges."""
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a <> b").distinct()
    both = e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).groupBy("a", "b").count()
    return both.where("count = 2").select("a", "b")  # each direction once: no self join is needed


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the first by `order`."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return first.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def insert_or_ignore(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """table with those rows whose key it lacks; of new rows with one key, one."""
    return table.unionByName(rows.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti"))


def update_allowed(table: DataFrame, key: str, value, fields: dict, allowed: set[str]) -> DataFrame:
    """table with the allowed fields of the row with the key set; other fields are ignored."""
    return table.withColumns({k: F.when(F.col(key) == value, F.lit(v).cast(table.schema[k].dataType)).otherwise(F.col(k)) for k, v in fields.items() if k in allowed})


def delete_cascade(tables: dict[str, tuple[DataFrame, str]], value) -> dict[str, DataFrame]:
    """Each table without the rows that bear the deleted id in its column."""
    return {name: df.where(F.coalesce(F.col(c) != value, F.lit(True))) for name, (df, c) in tables.items()}


def fd_violations(df: DataFrame, determinant: list[str], dependent: str) -> DataFrame:
    """Values of the determinant that go with more than one value of the dependent column, and how many."""
    return df.groupBy(*determinant).agg(F.count_distinct(dependent).alias("n_values")).where("n_values > 1")


def decompose(df: DataFrame, relations: dict[str, list[str]]) -> dict[str, DataFrame]:
    """The distinct projections of df."""
    return {name: df.select(*cols).distinct() for name, cols in relations.items()}


def lossless(original: DataFrame, rejoined: DataFrame) -> DataFrame:
    """One row: rows of the original's distinct rows that the join lacks, and rows that it adds."""
    a, b = original.distinct(), rejoined.select(*original.columns).distinct()
    missing, extra = a.exceptAll(b).agg(F.count(F.lit(1)).alias("n_missing")), b.exceptAll(a).agg(F.count(F.lit(1)).alias("n_extra"))
    return missing.crossJoin(extra)


def split_list(df: DataFrame, column: str, separator: str = ",") -> DataFrame:
    """First normal form: a row for each trimmed element of a list in a cell; rows with an empty or null cell stay, with null."""
    parts = F.filter(F.transform(F.split(column, separator), lambda x: F.trim(x)), lambda x: x != "")
    return df.withColumn(column, F.explode_outer(parts))


def open_intervals(df: DataFrame, key: list[str], start: str, value: str, day_before: bool = True) -> DataFrame:
    """Versions with closed intervals: valid_from, valid_to (the day before the next version, null for the last)."""
    nxt = F.lead(start).over(Window.partitionBy(*key).orderBy(start))
    return df.select(*key, value, F.col(start).alias("valid_from"), (F.date_sub(nxt, 1) if day_before else nxt).alias("valid_to"))


def as_of(facts: DataFrame, versions: DataFrame, key: list[str], at: str) -> DataFrame:
    """facts with the version in force at their date, found with one sort for both sides and without a range join.

    Versions and facts of a key are put in one order and the last version before each fact is carried on to it.
    """
    value = [c for c in versions.columns if c not in [*key, "valid_from", "valid_to"]]
    v = versions.select(*key, F.col("valid_from").alias("_at"), F.lit(0).alias("_side"), F.struct("valid_from", "valid_to", *value).alias("_v"), F.lit(None).cast(facts.select(F.struct("*")).schema[0].dataType).alias("_f"))
    f = facts.select(*key, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(v.schema["_v"].dataType).alias("_v"), F.struct("*").alias("_f"))
    w = Window.partitionBy(*key).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = v.unionByName(f).withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    held = F.col("_v.valid_to").isNull() | (F.col("_at") <= F.col("_v.valid_to"))
    return out.select("_f.*", *[F.when(held, F.col(f"_v.{c}")).alias(c) for c in ("valid_from", "valid_to", *value)])


def give_raise(salaries: DataFrame, employee: int, amount, effective) -> DataFrame:
    """A raise as a new table: the open row of the employee is closed at `effective` and a row from the next day is added.

    Raises ValueError without an open row or if the amount is no more than the current one.
    """
    open_ = (F.col("employee_id") == employee) & F.col("effective_to").isNull()
    found = salaries.where(open_).select("annual_amount").limit(1).collect()
    if not found:
        raise ValueError("no active salary row for that employee")
    if amount <= found[0][0]:
        raise ValueError("the new salary must exceed the current one")
    kinds = {f.name: f.dataType for f in salaries.schema.fields}
    closed = salaries.withColumn("effective_to", F.when(open_, F.lit(effective).cast("date")).otherwise(F.col("effective_to")))
    new = {"employee_id": F.lit(employee), "annual_amount": F.lit(amount), "effective_from": F.date_add(F.lit(effective).cast("date"), 1), "effective_to": F.lit(None), "id": F.col("_id") + 1}
    one = salaries.agg(*[F.max("id").alias("_id")] if "id" in kinds else [F.lit(0).alias("_id")])
    return closed.unionByName(one.select(*[new[c].cast(k).alias(c) for c, k in kinds.items()]))


def with_total(df: DataFrame, keys: list[str], aggregates: list[Column], label: str = "All") -> DataFrame:
    """Aggregates for each key and over all of them, in one pass; the total's keys read `label`."""
    rolled = df.rollup(*keys).agg(*aggregates, F.grouping_id().alias("_g"))
    width = len(keys)
    names = [F.when(F.col("_g").bitwiseAND(1 << (width - 1 - i)) != 0, F.lit(label)).otherwise(F.col(k).cast("string")).alias(k) for i, k in enumerate(keys)]
    return rolled.select(*names, *[c for c in rolled.columns if c not in [*keys, "_g"]])


def update_anomaly(flat: DataFrame, key: str, fact: str, where: Column, value: Column) -> DataFrame:
    """(key, before, after): how many different facts each key has in a flat table before and after a change of only the rows `where`. In a table of its own a key has one row, so one change leaves one fact."""
    changed = F.when(where, value).otherwise(F.col(fact))
    return flat.groupBy(key).agg(F.count_distinct(fact).alias("before"), F.count_distinct(changed).alias("after"))


def delete_anomaly(flat: DataFrame, key: str, where: Column) -> DataFrame:
    """(key): keys that a flat table forgets when the rows `where` go, though only the rows were meant."""
    return flat.groupBy(key).agg(F.count_if(~F.coalesce(where, F.lit(False))).alias("_left")).where("_left = 0").select(key)


def insert_anomaly(keys: DataFrame, flat: DataFrame, key: str) -> DataFrame:
    """Rows of a table of keys that a flat table cannot hold, because nothing refers to them yet."""
    return keys.join(flat.select(key).distinct(), key, "left_anti")
