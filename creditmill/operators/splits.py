"""Train, validation and test splits and folds that no repartitioning changes.

A row's place depends on its key and the seed alone: the first 32 bits of an MD5.
The shares are this package's own definition; only the sizes are declared upstream.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Test share, seed and number of folds.
TEST_SHARE = 0.2
SEED = 42
FOLDS = 5
_PARTS = 10_000


def key_hash(key: Column, seed: int = SEED, salt: str = "split") -> Column:
    """A number below 2^32 for a key; a null key counts as an empty text."""
    text = F.concat_ws("|", F.lit(salt), F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")


def source_split(
    key: Column, test_share: float = TEST_SHARE, validation_share: float = 0.0, seed: int = SEED
) -> Column:
    """test, validation or train."""
    part = key_hash(key, seed) % _PARTS
    test, validation = round(test_share * _PARTS), round(validation_share * _PARTS)
    return F.when(part < test, "test").when(part < test + validation, "validation").otherwise("train")


def fold(key: Column, folds: int = FOLDS, seed: int = SEED) -> Column:
    """0 to folds - 1, independent of the split."""
    return (key_hash(key, seed, "fold") % folds).cast("int")
