"""A bitmap of ids, of bounded size, that lets rows pass before they are shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Binary logarithm of the most bits of a bitmap.
MOST_BITS = 24


def with_bitmap(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` and ``maybe``: false only where doc_id is not among ``ids``.

    The bitmap has 16 bits for each id, and 2 ** MOST_BITS at most: 2 ** 18 rows are broadcast then.
    """
    bits = 1 << min(MOST_BITS, max(12, (16 * ids.count()).bit_length()))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    word, bit = F.shiftright(place, 6), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
    words = ids.groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    out = rows.withColumn("_word", word).join(F.broadcast(words), "_word", "left")
    return out.withColumn("maybe", F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))).drop("_word", "_bits")
