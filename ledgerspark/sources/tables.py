"""Snapshots of a set of tables: export, restore, clear."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession

# Key columns and tier of every table.
KEYS = {
    "raw_files": ["portfolio_id", "file_id"], "raw_rows": ["file_id", "line_no"], "instruments": ["portfolio_id", "instrument_key"],
    "transactions": ["portfolio_id", "id"], "distributions": ["portfolio_id", "id"], "accruals": ["portfolio_id", "id"], "cash_events": ["portfolio_id", "id"],
    "positions": ["portfolio_id", "account", "as_of", "instrument_key"], "fx_rates": ["portfolio_id", "base", "quote", "date"], "quotes": ["portfolio_id", "instrument_key"],
    "dividend_profiles": ["instrument_key"], "profile_distributions": ["instrument_key", "ex_date", "amount"], "overrides": ["portfolio_id", "instrument_key"],
    "settings": ["portfolio_id"],
}
DERIVED = ["instruments", "transactions", "distributions", "accruals", "cash_events", "positions"]
MARKET = ["quotes", "fx_rates", "dividend_profiles", "profile_distributions"]


def export(tables: dict[str, DataFrame], root: str, snapshot: str) -> str:
    """Write every table under one snapshot folder."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{snapshot}/{name}")
    return f"{root}/{snapshot}"


def read(spark: SparkSession, snapshot: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{snapshot}/{n}") for n in names}


def restore(dump: dict[str, DataFrame], existing: dict[str, DataFrame], *, replace: bool = False) -> dict[str, DataFrame]:
    """Tables after a restore: the dump alone, or merged with its rows winning."""
    out = {}
    for name in dump | existing:
        new, old = dump.get(name), existing.get(name)
        if replace or old is None:
            out[name] = new if new is not None else old.limit(0)
        elif new is None:
            out[name] = old
        else:
            keys = [c for c in KEYS[name] if c in old.columns and c in new.columns]
            held = new.select(*[new[c].alias(f"_{c}") for c in keys])
            kept = old.join(held, reduce(Column.__and__, [old[c].eqNullSafe(held[f"_{c}"]) for c in keys]), "left_anti")
            out[name] = new.unionByName(kept, allowMissingColumns=True)
    return out


def clear(tables: dict[str, DataFrame], names: list[str]) -> dict[str, DataFrame]:
    """The tables with some of them emptied; raw tables stay unless named."""
    return {n: (df.where("false") if n in names else df) for n, df in tables.items()}


def without_file(raw_files: DataFrame, raw_rows: DataFrame, file_id: str) -> tuple[DataFrame, DataFrame]:
    """Raw tables without one statement; derive again from what is left."""
    return raw_files.where(raw_files.file_id != file_id), raw_rows.where(raw_rows.file_id != file_id)
