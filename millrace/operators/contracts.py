"""Declared contracts of tables, checked together in one scan of each table.

Counts that need no exchange (nulls, values that are not accepted, broken rules, rows) are observed on the way of the scan that feeds the keys:
all columns that must be unique or must be found in another table become (column, value) rows, counted in the tasks before
they are dealt out. Uniqueness is a count over these; a reference is an anti join of the child's values with the parent's, which have been
counted already. On a write the observed counts cost no pass at all (`watched`).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from millrace.held import held


@dataclass(frozen=True)
class Contract:
    """What must hold for a table. references: column to (table, column); rules: name to a condition, null counts as kept."""

    not_null: Sequence[str] = ()
    unique: Sequence[str] = ()
    accepted: Mapping[str, Sequence] = field(default_factory=dict)
    references: Mapping[str, tuple[str, str]] = field(default_factory=dict)
    rules: Mapping[str, Column] = field(default_factory=dict)
    least_rows: int = 0


def _counters(c: Contract) -> dict[tuple[str, str], Column]:
    """(check, column) to its number of failures, as aggregates of one scan."""
    out = {("not_null", x): F.count_if(F.col(x).isNull()) for x in c.not_null}
    out |= {("accepted_values", x): F.count_if(F.col(x).isNotNull() & ~F.col(x).isin(*values)) for x, values in c.accepted.items()}
    out |= {("rule", name): F.count_if(~F.coalesce(ok, F.lit(True))) for name, ok in c.rules.items()}
    if c.least_rows:
        out["row_count", ""] = F.greatest(F.lit(0), c.least_rows - F.count(F.lit(1)))
    return out


def watched(df: DataFrame, contract: Contract, name: str) -> tuple[DataFrame, Observation]:
    """df, whose next write counts the contract's failures on its way; `observed` reads them afterwards."""
    seen = Observation(name)
    counters = list(_counters(contract).values())
    return df.observe(seen, *[c.alias(f"c{i}") for i, c in enumerate(counters)] or [F.count(F.lit(1)).alias("c0")]), seen


def observed(seen: Observation, contract: Contract) -> dict[tuple[str, str], int]:
    got = seen.get
    return {what: int(got[f"c{i}"]) for i, what in enumerate(_counters(contract))}


def check(tables: Mapping[str, DataFrame], contracts: Mapping[str, Contract]) -> DataFrame:
    """table_name, check, column_name, failures: a row per declared check. Failures are rows, for `unique` values that occur more than
    once, for `row_count` rows that are missing. Null keys are neither repeated nor without a parent. An empty table fails only
    `row_count`. Runs a job per table, which scans it once, and one per reference over counted values."""
    needed: dict[str, list[str]] = {t: list(dict.fromkeys([*c.unique, *c.references])) for t, c in contracts.items()}
    for c in contracts.values():
        for parent, column in c.references.values():
            if column not in needed.setdefault(parent, []):
                needed[parent].append(column)
    values: dict[str, DataFrame] = {}
    out: list[tuple[str, str, str, int]] = []
    for t, columns in needed.items():
        contract = contracts.get(t, Contract())
        df = tables[t]
        if not columns:
            counters = _counters(contract)
            got = df.agg(*[c.alias(f"c{i}") for i, c in enumerate(counters.values())] or [F.count(F.lit(1))]).first()
            out += [(t, *what, int(got[f"c{i}"])) for i, what in enumerate(counters)]
            continue
        df, seen = watched(df, contract, f"contract of {t}")
        pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("v")) for i, c in enumerate(columns)]))
        values[t] = held(df.select(pairs.alias("p")).select("p.*").where("v is not null").groupBy("i", "v").agg(F.count(F.lit(1)).alias("n")))
        if values[t].isEmpty():  # of a plan that is known to be empty nothing is observed
            got = tables[t].agg(*[c.alias(f"c{i}") for i, c in enumerate(_counters(contract).values())] or [F.count(F.lit(1))]).first()
            out += [(t, *what, int(got[f"c{i}"])) for i, what in enumerate(_counters(contract))]
        else:
            out += [(t, *what, n) for what, n in observed(seen, contract).items()]
        if contract.unique:
            repeated = {r["i"]: r["n"] for r in values[t].where("n > 1").groupBy("i").agg(F.count(F.lit(1)).alias("n")).collect()}
            out += [(t, "unique", c, repeated.get(columns.index(c), 0)) for c in contract.unique]
    spark = next(iter(tables.values())).sparkSession
    for t, contract in contracts.items():
        for column, (parent, key) in contract.references.items():
            child = values[t].where(F.col("i") == needed[t].index(column)).select("v", "n")
            known = values[parent].where(F.col("i") == needed[parent].index(key)).select(F.col("v").alias("k"))
            lost = child.join(known, F.col("v") == F.col("k"), "left_anti").agg(F.sum("n")).first()[0]
            out.append((t, "relationships", column, lost or 0))
    return spark.createDataFrame(out, "table_name string, check string, column_name string, failures long")
