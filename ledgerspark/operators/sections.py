"""Section classes, column aliases, row predicates and natural keys of the statement format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerspark.functions.text import KEY_SEP, asset_bucket, canon_codes, canon_plain, content_id, plain_cell

# What each section of a statement holds.
SECTION_CLASSES = {
    "EVENT": [
        "Trades", "Dividends", "Payment In Lieu Of Dividends", "Withholding Tax", "Interest", "Broker Interest Paid",
        "Broker Interest Received", "Bond Interest Paid", "Bond Interest Received", "Deposits & Withdrawals",
        "Deposits/Withdrawals", "Deposits", "Change in Dividend Accruals", "Fees", "Other Fees", "Advisor Fees",
        "Transaction Fees", "Commission Adjustments", "Price Adjustments", "Corporate Actions", "Transfers",
        "Incoming Trade Transfers", "Outgoing Trade Transfers", "Option Cash Settlements", "Statement of Funds",
        "Grant Activity",
    ],
    "SNAPSHOT": [
        "Open Positions", "Net Asset Value", "Cash Report", "Interest Accruals", "Forex Balances",
        "Net Stock Position Summary", "Open Dividend Accruals", "Complex Position Summary",
        "Collateral for Customer Borrowing", "Stock Yield Enhancement Program Securities Lent",
    ],
    "PERIOD_AGGREGATE": [
        "Change in NAV", "Change in Combined NAV", "Mark-to-Market Performance Summary",
        "Realized & Unrealized Performance Summary", "Total P/L for Statement Period",
        "Month & Year to Date Performance Summary", "Change in Position Value",
        "Positions and Mark-to-Market Profit and Loss", "Trade Summary by Symbol", "Trade Summary by Asset Class",
    ],
    "REFERENCE": ["Financial Instrument Information", "Codes", "Base Currency Exchange Rate"],
    "IGNORE": ["Notes/Legal Notes", "Notes", "Legal Notes", "Statement", "Account Information", "Disclaimer"],
}
# Sections whose first column holds labels that are data.
LABELS_ARE_DATA = ["Cash Report", "Change in NAV", "Change in Combined NAV", "Interest Accruals", "Net Asset Value", "Statement of Funds"]
# Event sections without derived rows.
UNDERIVED = ["Corporate Actions", "Transfers", "Incoming Trade Transfers", "Outgoing Trade Transfers", "Grant Activity"]
DIVIDENDS = ["Dividends", "Payment In Lieu Of Dividends"]
# Cash sections and the kind of their rows; None means by sign.
CASH_KINDS = {
    "Deposits & Withdrawals": None, "Deposits/Withdrawals": None, "Deposits": None,
    "Interest": "INTEREST", "Broker Interest Paid": "INTEREST", "Broker Interest Received": "INTEREST",
    "Bond Interest Paid": "INTEREST", "Bond Interest Received": "INTEREST",
    "Fees": "FEE", "Other Fees": "FEE", "Advisor Fees": "FEE", "Transaction Fees": "FEE", "Commission Adjustments": "FEE",
    "Price Adjustments": "OTHER", "Option Cash Settlements": "OTHER",
}
# Accepted names of each column in order of preference; /…/ is a pattern.
COLUMNS = {
    "discriminator": ["DataDiscriminator"], "asset_category": ["Asset Category", "Asset Class"], "currency": ["Currency"],
    "symbol": ["Symbol"], "description": ["Description"],
    "date_time": ["Date/Time", "Date", "Settle Date", "Value Date", "Report Date", "Activity Date"],
    "date": ["Date", "Settle Date", "Value Date", "Report Date", "Activity Date", "Date/Time"],
    "quantity": ["Quantity", "Qty", "Settled Quantity"], "price": ["T. Price", "Trade Price", "Xfer Price", "Price"],
    "proceeds": ["Proceeds", "Notional Value"], "commission": ["Comm/Fee", "Comm/Tax", "/^Comm in /"], "basis": ["Basis"],
    "cost_basis": ["Cost Basis", "/^Cost Basis in /"], "cost_price": ["Cost Price"], "close_price": ["Close Price"],
    "value": ["Value", "/^Value in /", "Market Value"], "unrealized": ["Unrealized P/L", "/^Unrealized P\\/L in /"],
    "realized": ["Realized P/L"], "amount": ["Amount", "Cash Amount"], "code": ["Code"], "ex_date": ["Ex Date"], "pay_date": ["Pay Date"],
    "gross_rate": ["Gross Rate"], "gross_amount": ["Gross Amount", "Gross Amnt"], "net_amount": ["Net Amount", "Net Amnt"],
    "tax": ["Tax"], "fee": ["Fee"], "multiplier": ["Multiplier", "Mult"], "conid": ["Conid"], "security_id": ["Security ID"],
    "listing_exch": ["Listing Exch"], "underlying": ["Underlying"], "type": ["Type"], "subtitle": ["Subtitle"],
    "direction": ["Direction"], "xfer_account": ["Xfer Account"], "nav_total": ["Current Total", "Current Long"],
    "instruction": ["Instruction"], "report_date": ["Report Date"], "activity_date": ["Activity Date"], "debit": ["Debit"], "credit": ["Credit"],
    "action_time": ["Date/Time", "Report Date"],
}
TOTAL_LABEL = r"(?i)^(Total|Sub ?Total)\b"
BALANCE_LABEL = r"(Starting|Ending) .* in [A-Z]{3}$"
IN_CURRENCY = r"\bin ([A-Z]{3})$"


def places(header: Column) -> Column:
    """Place in a row's fields of every known column under a header, NULL when it is absent; in the order of `COLUMNS`."""
    # a pattern names the words that a header begins with
    names = F.array(*[F.array(*[F.lit(a[1:-1].replace("\\/", "/") if a.startswith("/") else a) for a in aliases]) for aliases in COLUMNS.values()])

    def at(alias: Column) -> Column:
        begins = F.transform(header, lambda h: F.startswith(h, F.substring(alias, 2, 2147483647)))
        return F.when(F.startswith(alias, F.lit("^")), F.array_position(begins, True)).otherwise(F.array_position(header, alias))

    found = F.transform(names, lambda aliases: F.get(F.filter(F.transform(aliases, at), lambda p: p > 0), F.lit(0)))
    return F.transform(found, lambda p: (p + 1).cast("int"))


#: Where `places` has each column.
_AT = {n: i for i, n in enumerate(COLUMNS)}


def cell(name: str) -> Column:
    """Text of the named column under the header bound to the row, '' when absent."""
    return F.coalesce(F.get("fields", F.get("places", F.lit(_AT[name]))), F.lit(""))


def trimmed(name: str) -> Column:
    return F.trim(cell(name))


def section_class(section: Column) -> Column:
    out = F.lit("IGNORE")
    for kind, names in SECTION_CLASSES.items():
        out = F.when(section.isin(*names), kind).otherwise(out)
    return out


def is_aggregate_label() -> Column:
    return ~F.col("section").isin(*LABELS_ARE_DATA) & (F.col("first").rlike(TOTAL_LABEL) | F.col("first").rlike(BALANCE_LABEL))


def is_data_row() -> Column:
    """A fact row: typed Data and not a total in disguise."""
    return (F.col("row_type") == "Data") & ~is_aggregate_label()


def section_warnings(rows: DataFrame) -> DataFrame:
    """Unknown sections, and event sections that are kept raw only."""
    known = [n for names in SECTION_CLASSES.values() for n in names]
    seen = rows.where(F.col("section") != "").groupBy("file_id", "section").agg(F.min("line_no").alias("line_no"))
    kind = F.when(~F.col("section").isin(*known), "unknown_section").when(F.col("section").isin(*UNDERIVED), "not_derived")
    return seen.withColumn("kind", kind).where(F.col("kind").isNotNull()).select(
        "file_id", F.concat_ws("|", "kind", "section").alias("warn_key"), "line_no"
    )


def natural_key(instrument: Column, *sections: str) -> Column:
    """Identity of an event row within its section; every shape contains a date.

    `instrument` is the resolved key of the row's symbol.  Fields the broker
    restates between two cuts of the same fact are left out.  Only rows of `sections`
    are named, of all event sections when none are given.
    """
    bucket = asset_bucket(cell("asset_category"))
    section = F.col("section")
    sym = F.when(trimmed("symbol") == "", "").otherwise(F.coalesce(instrument, trimmed("symbol")))
    plain = ["currency", "date", "description", "amount"]

    def key(before: list[Column], names: list[str], after: tuple[Column, ...] = ()) -> Column:
        """Comparable forms of cells, `sym` among them, between other columns; a variable of a lambda is computed once."""
        texts = F.transform(F.array(*[sym if n == "sym" else cell(n) for n in names]), lambda x: plain_cell(x))
        return F.concat_ws(KEY_SEP, *before, F.transform(texts, lambda t: canon_plain(t)), *after)

    shapes: list[tuple[list[str], Column]] = [
        (["Trades"], key([F.lit("trade"), F.upper(trimmed("discriminator")), bucket], ["currency", "sym", "date_time", "quantity", "price"])),
        (DIVIDENDS, key([F.lit("div"), section], plain)),
        (["Withholding Tax"], key([F.lit("wht")], plain)),
        (["Deposits & Withdrawals", "Deposits/Withdrawals", "Deposits"], key([F.lit("dw")], plain)),
        (["Fees", "Other Fees", "Advisor Fees"], key([F.lit("fee"), section], ["subtitle", *plain])),
        (["Transaction Fees"], key([F.lit("txfee"), bucket], ["currency", "date_time", "sym", "description", "quantity", "price", "amount"])),
        (["Change in Dividend Accruals"], key(
            [F.lit("divaccr"), bucket], ["currency", "sym", "date", "ex_date", "pay_date", "quantity", "gross_rate", "gross_amount", "tax", "fee"], (canon_codes(cell("code")),))),
        (["Corporate Actions"], key([F.lit("ca"), bucket], ["currency", "action_time", "description", "quantity", "proceeds", "value"])),
        (["Transfers"], key([F.lit("xfer"), bucket], ["currency", "date", "sym", "type", "direction", "quantity", "xfer_account"])),
        (["Incoming Trade Transfers", "Outgoing Trade Transfers"], key([F.lit("tradexfer"), section], ["currency", "date", "sym", "instruction", "quantity", "price"])),
        (["Statement of Funds"], key([F.lit("sof")], ["currency", "report_date", "activity_date", "description", "debit", "credit"])),
    ]
    named = [n for names, _ in shapes for n in names]
    events = [n for n in SECTION_CLASSES["EVENT"] if n not in named and n in (sections or SECTION_CLASSES["EVENT"])]
    out = F.when(section.isin(*events), key([F.lit("cash"), section], plain)) if events else F.lit(None).cast("string")
    for names, shape in reversed(shapes):
        if not sections or set(names) & set(sections):
            out = F.when(section.isin(*names), shape).otherwise(out)
    return out


def with_ids(rows: DataFrame, key: str = "key") -> DataFrame:
    """Add the occurrence ordinal of each key within its file, and the content id."""
    w = W.partitionBy("file_id", key).orderBy("line_no")
    rows = rows.withColumn("ordinal", F.row_number().over(w) - 1)
    return rows.withColumn("id", content_id(F.col(key), F.col("ordinal")))
