"""Column-expression helpers shared by every builder.

All of them are built-in ``pyspark.sql.functions`` compositions, so they stay
inside whole-stage codegen; no Python runs per row.

Numeric policy
--------------
* Money stays ``DECIMAL`` end to end.
* Every published average, percentage or ratio is the exact quotient rounded
  HALF_UP once, at the published scale (``ratio``). Spark's own decimal
  division rounds at >= 14 digits here, which is exact for any divisor below
  1e12, so there is no double rounding.
* Output casts are widened to ``DECIMAL(38, s)``: the narrow casts of the
  original report (e.g. ``DECIMAL(5,2)`` for a price average) overflow on
  larger values; widening changes no in-range value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Published labels of the report (kept verbatim, accents included).
YES = "Sí"
NO = "No"
SINGLE_SELLER = "Envío Simple (1 Vendedor)"
SPLIT_SHIPMENT = "Envío Dividido (+ de 1 Vendedor)"
NO_SELLER = "Sin Vendedor / Cancelado"
LATE_DELIVERY = "Entregas con Retraso"
ON_TIME_DELIVERY = "Entregas sin Retraso"
TREND_UP = "incremento"
TREND_FLAT = "sin cambio"
TREND_DOWN = "decremento"
# Installment ranges, in order: label, lowest, highest.
INSTALLMENT_RANGES = [
    ("1 cuota (contado)", 1, 1),
    ("2-3 cuotas", 2, 3),
    ("4-6 cuotas", 4, 6),
    ("7-10 cuotas", 7, 10),
]
INSTALLMENT_OTHER = "11+ cuotas"
CREDIT_CARD = "credit_card"
DELIVERED = "delivered"
NEGATIVE_SCORE_MAX = 2


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _text(*xs) -> bool:
    """True when every argument is SQL text (a column name or an expression).

    Text arguments are turned into one ``F.expr`` call: each Column-building
    call is a round trip to the JVM, so composing SQL text keeps plan
    construction cheap on the driver. The resulting expressions are identical.
    """
    return all(isinstance(x, str) for x in xs)


def sql_is_late(delivered: str, estimated: str) -> str:
    return f"coalesce(to_date({delivered}) > to_date({estimated}), false)"


def sql_yes_no(cond: str) -> str:
    return f"CASE WHEN {cond} THEN '{YES}' ELSE '{NO}' END"


def day_diff(start, end) -> Column:
    """Calendar days between two instants: midnights crossed (23:59 -> 00:01 is 1)."""
    if _text(start, end):
        return F.expr(f"datediff({end}, {start})")
    return F.datediff(col(end), col(start))


def is_late(delivered, estimated) -> Column:
    """Boolean lateness on *dates*: delivered on the estimated day is on time.
    Undelivered orders are not late (False, never NULL)."""
    if _text(delivered, estimated):
        return F.expr(sql_is_late(delivered, estimated))
    return F.coalesce(F.to_date(col(delivered)) > F.to_date(col(estimated)), F.lit(False))


def late_label(delivered: str, estimated: str) -> Column:
    """The published text flag of ``is_late``."""
    return F.expr(sql_yes_no(sql_is_late(delivered, estimated)))


def delay_days(delivered, estimated) -> Column:
    """Days of delay, tested on raw timestamps; 0 when on time or undelivered."""
    if _text(delivered, estimated):
        return F.expr(f"CASE WHEN {delivered} > {estimated} "
                      f"THEN datediff({delivered}, {estimated}) ELSE 0 END")
    d, e = col(delivered), col(estimated)
    return F.when(d > e, F.datediff(d, e)).otherwise(F.lit(0))


def yes_no(flag) -> Column:
    """Publish a Boolean flag as the report's text flag."""
    if _text(flag):
        return F.expr(sql_yes_no(flag))
    return F.when(col(flag), F.lit(YES)).otherwise(F.lit(NO))


def logistics_type(n_sellers: str) -> Column:
    n = n_sellers
    return F.expr(f"CASE WHEN {n} = 1 THEN '{SINGLE_SELLER}' WHEN {n} > 1 THEN '{SPLIT_SHIPMENT}' "
                  f"ELSE '{NO_SELLER}' END")


def installment_range(installments: str) -> Column:
    """Bucket of a credit-card installment count; 0 and NULL fall in the last bucket."""
    n = installments
    arms = " ".join(
        f"WHEN {n} = {lo} THEN '{label}'" if lo == hi
        else f"WHEN {n} >= {lo} AND {n} <= {hi} THEN '{label}'"
        for label, lo, hi in INSTALLMENT_RANGES)
    return F.expr(f"CASE {arms} ELSE '{INSTALLMENT_OTHER}' END")


def dec(precision: int, scale: int) -> T.DecimalType:
    return T.DecimalType(precision, scale)


def ratio(num, den, scale: int = 2, num_scale: int = 0, den_scale: int = 0,
          factor: int = 1) -> Column:
    """``factor * num / den`` rounded HALF_UP once to ``scale`` digits.

    NULL when ``den`` is 0 or NULL (division by zero never raises).
    ``num_scale``/``den_scale`` are the decimal scales of the inputs (0 for counts).
    ``num``/``den`` are SQL text (column names or aggregate expressions) or Columns.
    """
    if _text(num, den):
        n = f"({num}) * {factor}" if factor != 1 else f"({num})"
        return F.expr(f"CAST(try_divide(CAST({n} AS DECIMAL(24,{num_scale})), "
                      f"CAST(({den}) AS DECIMAL(20,{den_scale}))) AS DECIMAL(38,{scale}))")
    n = col(num)
    if factor != 1:
        n = n * F.lit(factor)
    n = n.cast(dec(24, num_scale))
    d = col(den).cast(dec(20, den_scale))
    return F.try_divide(n, d).cast(dec(38, scale))


def avg_exact(x: str, scale: int = 2, x_scale: int = 0) -> Column:
    """Aggregate: mean of ``x`` (NULLs ignored) rounded HALF_UP once."""
    return ratio(f"sum({x})", f"count({x})", scale, num_scale=x_scale)


def share_pct(part, total, scale: int = 2, num_scale: int = 0, den_scale: int = 0) -> Column:
    """Percentage ``100 * part / total`` rounded once."""
    return ratio(part, total, scale, num_scale=num_scale, den_scale=den_scale, factor=100)
