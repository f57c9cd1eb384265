"""A portfolio view over a set of tables: every metric as a lazily composed DataFrame."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.operators import forecast, fx, holdings, income, lots, returns
from ledgerspark.operators.scan import cut_lineage


@dataclass
class Tables:
    """Ledger tables; all but market data carry `portfolio_id`."""

    transactions: DataFrame
    positions: DataFrame
    instruments: DataFrame
    quotes: DataFrame
    overrides: DataFrame
    settings: DataFrame
    fx_rates: DataFrame
    distributions: DataFrame | None = None
    accruals: DataFrame | None = None
    cash_events: DataFrame | None = None
    profiles: DataFrame | None = None
    profile_rows: DataFrame | None = None


class Portfolio:
    """Composition of the operators; `as_of` is always explicit."""

    def __init__(self, tables: Tables, as_of: str, *, net: bool = False, parity: bool = False, bases: list[str] | None = None):
        self.t, self.as_of, self.net = tables, as_of, net
        self.parity = parity
        self._bases = bases

    @cached_property
    def rates(self) -> fx.RateTable:
        # base currencies are a short list of codes
        bases = self._bases or [r[0] for r in self.t.settings.select("base_currency").distinct().collect()]
        return fx.resolve_rates(self.t.fx_rates, bases)

    @cached_property
    def ledger(self) -> lots.Ledger:
        # read by the summary, the open lots and the sales: replay once
        return lots.Ledger(cut_lineage(lots.replay(self.t.transactions).rows))

    @cached_property
    def holdings(self) -> DataFrame:
        t = self.t
        rows = holdings.build(
            t.transactions, t.positions, t.instruments, t.quotes, t.overrides, t.settings, self.rates,
            as_of=self.as_of,
        )
        return cut_lineage(rows)

    @cached_property
    def totals(self) -> DataFrame:
        return holdings.totals(self.holdings)

    @cached_property
    def portfolios(self) -> DataFrame:
        return self.t.settings.select("portfolio_id")

    @cached_property
    def seasons(self) -> DataFrame:
        return forecast.seasonality(self.t.profile_rows, self.as_of)

    @cached_property
    def forecast_items(self) -> DataFrame:
        """Declared and estimated items, computed once for all forecast outputs."""
        t = self.t
        rates_ = None if self.parity else income.withholding(t.distributions.where(F.col("instrument_key").isNotNull()), lots.LEDGER)
        rows = forecast.items(
            self.holdings, t.accruals, t.profiles, t.profile_rows, t.settings, self.rates, self.as_of, withholding=rates_
        )
        return cut_lineage(rows)

    @cached_property
    def forecast_months(self) -> DataFrame:
        return forecast.months(self.forecast_items, self.portfolios, self.as_of, net=self.net)

    @cached_property
    def forecast_totals(self) -> DataFrame:
        return forecast.totals(self.forecast_items, self.portfolios, net=self.net)

    @cached_property
    def coverage(self) -> DataFrame:
        return forecast.coverage(self.holdings, self.t.profiles, self.seasons, self.forecast_items)

    @cached_property
    def position_yields(self) -> DataFrame:
        return income.position_yields(self.holdings, forecast.forward_by_instrument(self.forecast_items, net=self.net))

    @cached_property
    def yields(self) -> DataFrame:
        return income.portfolio_yields(self.totals, self.forecast_totals)

    def income(self, period: str) -> DataFrame:
        return income.by_period(self.t.distributions, period, self.t.settings, self.rates, net=self.net)

    @cached_property
    def matrix(self) -> DataFrame:
        return income.payments_matrix(self.t.distributions, self.t.settings, self.rates, net=self.net)

    @cached_property
    def flows(self) -> DataFrame:
        return returns.external_flows(self.t.cash_events, self.t.settings, self.rates)

    @cached_property
    def xirr(self) -> DataFrame:
        return returns.lifetime_xirr(self.flows, self.totals.select("portfolio_id", "market_value_base"), self.as_of)

    @cached_property
    def profit(self) -> DataFrame:
        dividends = holdings.dividends_received(self.t.distributions, self.t.settings, self.rates, net=self.net)
        return holdings.profit(self.totals, dividends)
