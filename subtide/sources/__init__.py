"""Reading, writing and materialising tables."""

from subtide.sources.contracts import (
    AD_SPEND_KEYS,
    CUSTOMER_SERVICE,
    ENGAGEMENT,
    SUBSCRIBERS,
    require,
)
from subtide.sources.tables import (
    checkpoint_table,
    delete_path,
    load_spend_csv,
    load_table,
    materialize,
    release,
    release_all,
    scope,
    scratch_path,
    shared_folder,
    split_spend_csv,
    store_by_key,
    write_csv,
)

__all__ = [
    "AD_SPEND_KEYS",
    "CUSTOMER_SERVICE",
    "ENGAGEMENT",
    "SUBSCRIBERS",
    "checkpoint_table",
    "delete_path",
    "load_spend_csv",
    "load_table",
    "materialize",
    "release",
    "release_all",
    "require",
    "scope",
    "scratch_path",
    "shared_folder",
    "split_spend_csv",
    "store_by_key",
    "write_csv",
]
