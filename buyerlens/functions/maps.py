"""Value maps (F1-F3, F12).  Unmapped values become NULL, as a dict ``map`` does."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

from buyerlens import params


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def map_values(c, mapping: dict) -> Column:
    """Look ``c`` up in a literal map; missing keys give NULL."""
    lit_map = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    return F.try_element_at(lit_map, _col(c))


def buyer_type_label(c="BUYER_TYPE") -> Column:
    """New_Buyer -> 0, Repeat / Repeat_90D -> 1, anything else -> NULL."""
    return map_values(c, params.BUYER_TYPE_MAP).cast("int")


def ordinal_segment(c="USER_SEGMENT", order=None) -> Column:
    """USER_SEGMENT name -> position in the ordered segment list."""
    order = order or params.USER_SEGMENT_ORDER
    return map_values(c, {name: i for i, name in enumerate(order)}).cast("long")


def gender_net_map(c="ID_GENDER") -> Column:
    """net effect of the reference's overwrite cascade on a mean gender code.

    0 -> 0, 1 -> 0, 2 -> 1, 3 -> 2; any other value (a fraction) is kept.
    """
    c = _col(c)
    expr = None
    for src, dst in params.GENDER_NET_MAP.items():
        expr = (F.when(c == src, F.lit(float(dst))) if expr is None
                else expr.when(c == src, F.lit(float(dst))))
    return expr.otherwise(c.cast("double"))


def swap_binary(c) -> Column:
    """swap 0 and 1 (other values unchanged)."""
    c = _col(c)
    return F.when(c == 0, F.lit(1)).when(c == 1, F.lit(0)).otherwise(c)
