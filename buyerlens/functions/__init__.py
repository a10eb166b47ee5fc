"""Scalar Column builders.  All are JVM-side expressions (no Python UDFs)."""

from buyerlens.functions.dates import (  # noqa: F401
    days_since, floor_days_between, to_timestamp_strict,
)
from buyerlens.functions.maps import (  # noqa: F401
    buyer_type_label, gender_net_map, map_values, ordinal_segment, swap_binary,
)
from buyerlens.functions.hashing import key_bit, key_fraction  # noqa: F401
from buyerlens.functions.numeric import (  # noqa: F401
    label_at, safe_div, safe_ratio_expr, threshold_grid,
)
