from marketlens.functions.columns import (  # noqa: F401
    clean_number, nullif_zero, pick_percentile, safe_div,
)
from marketlens.functions.text import money_text, ordinal_text, plural_text  # noqa: F401
