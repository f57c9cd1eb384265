"""Statement files to deduplicated ledger tables."""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.operators import derive, reconcile
from ledgerspark.operators.scan import keep
from ledgerspark.operators.sections import places, section_warnings
from ledgerspark.sources import statements

EVENT_TABLES = ("transactions", "distributions", "accrual_rows", "cash_events")


#: Tables of a bundle.
BUNDLE_TABLES = (
    "raw_files", "raw_rows", "instruments", "transactions", "distributions", "accrual_rows", "cash_events", "positions", "fx_rates", "reconciliation", "warnings",
)


class Bundle:
    """Everything derived from a batch of files, still one row per file and fact.

    A table, and each step that several tables share, is derived when it is first asked for and then once.
    """

    def __init__(self, heads: DataFrame, rows: DataFrame, parse_warnings: DataFrame | None):
        self.raw_files, self.raw_rows, self._parse_warnings = heads, rows, parse_warnings

    @cached_property
    def _ctx(self) -> derive.Context:
        return derive.context(self.raw_files, self.raw_rows, keep)

    @cached_property
    def _fills(self) -> DataFrame:
        return keep(derive.transactions(self._ctx))

    @cached_property
    def _paid(self) -> tuple[DataFrame, DataFrame]:
        dist, lone = derive.distributions(self._ctx)
        return keep(dist), lone

    @cached_property
    def instruments(self) -> DataFrame:
        return self._ctx.instruments

    @cached_property
    def transactions(self) -> DataFrame:
        return self._fills.drop("bucket")

    @property
    def distributions(self) -> DataFrame:
        return self._paid[0]

    @cached_property
    def accrual_rows(self) -> DataFrame:
        return self._ctx.accruals

    @cached_property
    def cash_events(self) -> DataFrame:
        return keep(derive.cash_events(self._ctx, self._paid[1]))

    @cached_property
    def positions(self) -> DataFrame:
        return derive.positions(self._ctx)

    @cached_property
    def fx_rates(self) -> DataFrame:
        return derive.recovered_rates(self._ctx)

    @cached_property
    def reconciliation(self) -> DataFrame:
        ctx = self._ctx
        checks = [reconcile.positions(ctx), reconcile.cash(ctx, self.distributions, self.cash_events), reconcile.accruals(ctx), reconcile.trades(ctx, self._fills)]
        return reduce(DataFrame.unionByName, [keep(c) for c in checks])

    @cached_property
    def warnings(self) -> DataFrame:
        warned = section_warnings(self.raw_rows).unionByName(derive.trade_warnings(self._ctx))
        if self._parse_warnings is not None:
            warned = self._parse_warnings.unionByName(warned)
        return warned.groupBy("file_id", "warn_key").agg(F.min("line_no").alias("line_no"), F.count(F.lit(1)).alias("n"))

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in BUNDLE_TABLES}


def derive_files(files: DataFrame) -> Bundle:
    """Parse and derive a batch; `files`: portfolio_id, path, text."""
    raw = statements.parse(files, keep, places=places)
    return derive_rows(keep(raw.files), raw.rows.drop("raw_type"), raw.warnings)


def derive_rows(heads: DataFrame, rows: DataFrame, parse_warnings: DataFrame | None) -> Bundle:
    """Derive from raw files and rows, parsed just now or stored before."""
    if "places" not in rows.columns:
        rows = rows.withColumn("places", places(F.col("header")))
    return Bundle(heads, rows, parse_warnings)


def derive_transactions(files: DataFrame) -> DataFrame:
    """Only the fills of a batch."""
    raw = statements.parse(files, keep, places=places)
    return derive.transactions(derive.context(keep(raw.files), raw.rows.drop("raw_type"), keep)).drop("bucket")


def new_files(files: DataFrame, known: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(files to load, outcome per file): exact and regenerated copies are left out.

    Within a batch the first path wins.  `known`: portfolio_id, file_id, canonical_id.
    """
    # decided on hashes; only the texts that are loaded travel
    ids = statements.identify(files).select("portfolio_id", "path", "file_id", "canonical_id")
    best = ids.groupBy("portfolio_id", "canonical_id").agg(F.min("path").alias("_first"))
    best = best.join(ids.select("portfolio_id", "canonical_id", F.col("path").alias("_first"), F.col("file_id").alias("_kept")), ["portfolio_id", "canonical_id", "_first"])
    marked = ids.join(best, ["portfolio_id", "canonical_id"])
    if known is not None:
        exact = known.select("portfolio_id", "file_id").distinct().withColumn("_exact", F.lit(True))
        same = known.select("portfolio_id", "canonical_id").distinct().withColumn("_same", F.lit(True))
        marked = marked.join(exact, ["portfolio_id", "file_id"], "left").join(same, ["portfolio_id", "canonical_id"], "left")
    else:
        marked = marked.withColumns({"_exact": F.lit(None).cast("boolean"), "_same": F.lit(None).cast("boolean")})
    later = F.col("path") != F.col("_first")
    outcome = (
        F.when(F.col("_exact") | (later & (F.col("file_id") == F.col("_kept"))), "duplicate-exact")
        .when(F.col("_same") | later, "duplicate-regenerated").otherwise("new")
    )
    marked = marked.withColumn("outcome", outcome)
    fresh = files.join(marked.where(F.col("outcome") == "new").select("path"), "path", "left_semi")
    return fresh, marked.select("portfolio_id", "path", "file_id", "canonical_id", "outcome")


def merge_events(rows: DataFrame, imported: DataFrame) -> DataFrame:
    """One row per content id: first import wins, with the number of files reporting it.

    `imported`: file_id, imported_at.  Copies of one row collapse in the map-side
    part of the aggregation, so a much-repeated row does not travel whole.  The
    files themselves are in `event_sources`.
    """
    by = ["portfolio_id", "id"]
    when = F.struct("imported_at", "file_id", "line_no")
    keep = [c for c in rows.columns if c not in (*by, "file_id", "line_no", "row_id")]
    tagged = rows.join(imported.select("file_id", "imported_at"), "file_id")
    per_file = tagged.groupBy(*by, "file_id").agg(F.min(when).alias("at"), F.min_by(F.struct(*keep), when).alias("r"))
    merged = per_file.groupBy(*by).agg(
        F.min_by("r", "at").alias("r"), F.min_by("file_id", "at").alias("file_id"), F.count(F.lit(1)).alias("files")
    )
    return merged.select(*by, "r.*", "file_id", "files").withColumn("superseded_at", F.lit(None).cast("timestamp"))


def event_sources(rows: DataFrame) -> DataFrame:
    """Provenance: every (event, file, raw row) that reported it, one row each."""
    return rows.select("portfolio_id", "id", "file_id", "row_id").distinct()


def merge_instruments(rows: DataFrame, imported: DataFrame) -> DataFrame:
    """One row per instrument: newest known facts, all aliases, widest date range."""
    tagged = rows.join(imported.select("file_id", "imported_at"), "file_id")
    at = F.struct("imported_at", "file_id")
    newest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull() & (F.col(c) != ""), at)).alias(c)
    any_ = lambda c: F.max_by(c, at).alias(c)
    # aliases of an instrument are few; the set collapses them before the shuffle
    aliases = tagged.select("portfolio_id", "instrument_key", F.explode("aliases").alias("a")).groupBy("portfolio_id", "instrument_key").agg(F.array_sort(F.collect_set("a")).alias("aliases"))
    facts = tagged.groupBy("portfolio_id", "instrument_key").agg(
        any_("identity_source"), any_("symbol"), any_("asset_category"), any_("type"), any_("multiplier"),
        *[newest(c) for c in ("conid", "isin", "name", "trade_currency", "div_currency", "listing_exchange")],
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
    )
    return facts.join(aliases, ["portfolio_id", "instrument_key"], "left")


def merge_positions(rows: DataFrame, imported: DataFrame) -> DataFrame:
    """Snapshots replace each other by (account, date, instrument); the newest import wins."""
    tagged = rows.join(imported.select("file_id", "imported_at"), "file_id")
    by = ["portfolio_id", "account", "as_of", "instrument_key"]
    keep = [c for c in rows.columns if c not in by]
    return tagged.groupBy(*by).agg(F.max_by(F.struct(*keep), F.struct("imported_at", "file_id", "line_no")).alias("r")).select(*by, "r.*").drop("line_no", "bucket")


def merge_accruals(rows: DataFrame, imported: DataFrame, *, parity: bool = False) -> DataFrame:
    """Netted accruals of a portfolio.

    By default rows are deduplicated over files first and then netted, so a
    reversal printed in a later file counts.  `parity` nets inside each file and
    keeps the first import of each payment.
    """
    if parity:
        per_file = derive.net_accruals(rows, ["portfolio_id", "file_id"]).withColumns({"line_no": F.lit(0), "row_id": F.col("file_id")})
        return merge_events(per_file, imported)
    at = F.struct("imported_at", "file_id", "line_no")
    keep = [c for c in rows.columns if c not in ("portfolio_id", "id")]
    tagged = rows.join(imported.select("file_id", "imported_at"), "file_id")
    return net_once(tagged.groupBy("portfolio_id", "id").agg(F.min_by(F.struct(*keep), at).alias("r")).select("portfolio_id", "id", "r.*"))


def net_once(once: DataFrame) -> DataFrame:
    """Netted accruals of rows that are there once."""
    return derive.net_accruals(once.drop("id"), ["portfolio_id"]).withColumn("superseded_at", F.lit(None).cast("timestamp"))


def merge_rates(rows: DataFrame, imported: DataFrame) -> DataFrame:
    """Rates that statements of a portfolio state, the first import of each day wins."""
    dated = rows.join(imported.select("file_id", "imported_at"), "file_id")
    return dated.groupBy("portfolio_id", "base", "quote", "date").agg(F.min_by("rate", F.struct("imported_at", "file_id")).alias("rate"))


def adopted_base(raw_files: DataFrame, imported: DataFrame) -> DataFrame:
    """Base currency of a portfolio: stated by its first file, when it is a currency code."""
    first = raw_files.join(imported.select("file_id", "imported_at"), "file_id").groupBy("portfolio_id").agg(
        F.min_by(F.upper(F.trim("base_currency")), F.struct("imported_at", "file_id")).alias("base")
    )
    return first.select("portfolio_id", F.when(F.col("base").rlike("^[A-Z]{3}$"), F.col("base")).otherwise("USD").alias("base_currency"))


def section_counts(raw_rows: DataFrame) -> DataFrame:
    return raw_rows.groupBy("file_id", "section").agg(F.count(F.lit(1)).alias("rows"))


def load_counts(rows: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Rows added and skipped per file against what is already stored."""
    seen = stored.select("portfolio_id", "id").distinct().withColumn("_seen", F.lit(True)) if stored is not None else None
    marked = rows.join(seen, ["portfolio_id", "id"], "left") if seen is not None else rows.withColumn("_seen", F.lit(None).cast("boolean"))
    return marked.groupBy("file_id").agg(F.count_if(F.col("_seen").isNull()).alias("added"), F.count_if(F.col("_seen")).alias("skipped"))


@dataclass
class Ledger:
    """Merged tables of all loaded files."""

    instruments: DataFrame
    transactions: DataFrame
    distributions: DataFrame
    accruals: DataFrame
    cash_events: DataFrame
    positions: DataFrame
    fx_rates: DataFrame
    settings: DataFrame


def merge(bundle: Bundle, imported: DataFrame, *, parity: bool = False) -> Ledger:
    return Ledger(
        merge_instruments(bundle.instruments, imported), merge_events(bundle.transactions, imported), merge_events(bundle.distributions, imported),
        merge_accruals(bundle.accrual_rows, imported, parity=parity), merge_events(bundle.cash_events, imported),
        merge_positions(bundle.positions, imported), merge_rates(bundle.fx_rates, imported), adopted_base(bundle.raw_files, imported),
    )


def import_times(files: DataFrame) -> DataFrame:
    """Import order of a batch: by path."""
    return files.select("file_id", F.col("path").alias("imported_at"))


def load_directory(spark: SparkSession, path: str, *, parity: bool = False) -> tuple[Bundle, Ledger]:
    """All statements below a folder, each distinct one loaded once."""
    fresh, _ = new_files(statements.scan(spark, path), None)
    bundle = derive_files(fresh)
    return bundle, merge(bundle, import_times(bundle.raw_files), parity=parity)


def tables(ledger: Ledger) -> dict[str, DataFrame]:
    return {f.name: getattr(ledger, f.name) for f in fields(ledger)}
