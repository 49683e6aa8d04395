"""Bit-mask predicates and updates."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of per-sample and per-detector masks.
SHARED = {"invalid": 1, "processing": 2, "unstable_scanrate": 4, "irregular": 8, "sun_up": 16, "sun_close": 32, "nonscience": 15}
DETECTOR = {"invalid": 1, "processing": 2, "sso": 4, "nonscience": 7}


def good(flags: Column | str = "flags", mask: int = 7) -> Column:
    """No bit of the mask is set."""
    c = F.col(flags) if isinstance(flags, str) else flags
    return c.bitwiseAND(F.lit(mask)) == 0


def raised(flags: Column | str, where: Column, bit: int) -> Column:
    """flags with ``bit`` set where the condition holds."""
    c = F.col(flags) if isinstance(flags, str) else flags
    return F.when(where, c.bitwiseOR(F.lit(bit))).otherwise(c)
