"""Upper case of single characters, as engines have it that map one character to one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters whose upper case is several, and that have a single one too: sharp s, and Greek vowels with an iota below.
_SINGLE = {0xDF: 0x1E9E, 0x1FB3: 0x1FBC, 0x1FC3: 0x1FCC, 0x1FF3: 0x1FFC} | {row + k: row + k + 8 for row in (0x1F80, 0x1F90, 0x1FA0) for k in range(8)}


def upper_each(text: Column) -> Column:
    """The text in upper case, character by character, so that it keeps its length: where Spark's ``upper`` makes SS of a
    sharp s, this makes the capital sharp s. Characters without an upper case of one character stay."""
    single = lambda c: F.translate(c, "".join(map(chr, _SINGLE)), "".join(map(chr, _SINGLE.values())))
    return F.array_join(F.transform(F.split(text, ""), lambda c: F.when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(single(c))), "")


__all__ = ["upper_each"]
