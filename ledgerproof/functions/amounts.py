"""Column builders for the four amount conventions.

Money is DECIMAL(22,5) while computing: 4 % and 0.5 % of a two-decimal amount are exact,
so sums do not depend on their order.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(22,5)"
TOLERANCE = Decimal("0.01")

# Fixed values
CASHBACK_TEXT = "MERCHANT PAYMENT OTHER SINGLE STEP"
CASHBACK_RATE = Decimal("0.04")
COMMISSION_TEXT = "IND02"
COMMISSION_EXCLUDED_TEXT = "IND01"
COMMISSION_RATE = Decimal("0.005")
OUTGOING_TYPES = ("CASH_IN", "BILL PAYMENT", "DEBIT")
CREDIT_WORDS = ("credit", "cr")
DEBIT_WORDS = ("debit", "dr")


def money(col: Column) -> Column:
    return F.coalesce(col, F.lit(0)).cast(MONEY)


def has_cashback(description: Column) -> Column:
    return F.coalesce(F.upper(description).contains(CASHBACK_TEXT), F.lit(False))


def has_commission(description: Column) -> Column:
    text = F.upper(description)
    found = text.contains(COMMISSION_TEXT) & ~text.contains(COMMISSION_EXCLUDED_TEXT)
    return F.coalesce(found, F.lit(False))


def cashback_of(amount: Column) -> Column:
    return (F.abs(money(amount)) * F.lit(CASHBACK_RATE)).cast(MONEY)


def commission_of(amount: Column) -> Column:
    return (F.abs(money(amount)) * F.lit(COMMISSION_RATE)).cast(MONEY)


def implicit_fee(amount: Column, description: Column, cashback: Column, ind02: Column) -> Column:
    """Commission minus cashback that the statement does not print."""
    fee = F.when(ind02 & has_commission(description), commission_of(amount)).otherwise(F.lit(0).cast(MONEY))
    back = F.when(cashback & has_cashback(description), cashback_of(amount)).otherwise(F.lit(0).cast(MONEY))
    return (fee - back).cast(MONEY)


def is_credit(direction: Column) -> Column:
    return F.coalesce(F.lower(direction).isin(*CREDIT_WORDS), F.lit(False))


def is_debit(direction: Column) -> Column:
    return F.coalesce(F.lower(direction).isin(*DEBIT_WORDS), F.lit(False))


def movement(provider: Column, fmt: Column, signed: Column, txn_type: Column, direction: Column, amount: Column) -> Column:
    """The amount with the sign it has on the wallet balance."""
    a = money(amount)
    outgoing = F.coalesce(F.upper(txn_type).isin(*OUTGOING_TYPES), F.lit(False))
    return (
        F.when(provider == "UMTN", F.when(outgoing, -a).otherwise(a))
        .when((fmt == "format_1") & ~signed, F.when(is_credit(direction), a).otherwise(-a))
        .otherwise(a)
        .cast(MONEY)
    )


def fee_applied(fmt: Column, fee: Column) -> Column:
    """Format 2 prints amounts that already include the fee."""
    return F.when(fmt == "format_2", F.lit(0).cast(MONEY)).otherwise(money(fee))


def apply_delta(moved: Column, fee: Column, implicit: Column) -> Column:
    return (moved - fee - implicit).cast(MONEY)


def opening_before(
    provider: Column, fmt: Column, signed: Column, direction: Column, balance: Column, moved: Column, fee: Column, implicit: Column
) -> Column:
    """Balance before the first row.

    Not the inverse of `apply_delta` for a format-1 credit or signed row with a fee (the fee
    is taken off again), nor for an implicit fee in format 2. Both define the results.
    """
    b = money(balance)
    return (
        F.when(provider == "UMTN", b - moved + fee)
        .when(fmt == "format_2", b - moved - implicit)
        .when(signed | is_credit(direction), b - moved - fee + implicit)
        .otherwise(b - moved + fee + implicit)
        .cast(MONEY)
    )
