"""Sharding by a permutation-filled lookup table.

Every shard has a permutation of the slots of a prime-sized table.  The shards
take turns, each claiming the first slot of its own permutation that is still
free, until the table is full: the shares differ by one slot at most, and a
change of the shards moves few keys.  The table has a fixed size, so it is
broadcast, and placing a row is one hash and one lookup: no shuffle, whatever
key holds most of the rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots: a prime well above a hundred times the shards that are in use.
TABLE_SIZE = 16381
SHARDS = tuple(f"shard-{k:03d}" for k in range(64))


def preference(shard: str, size: int) -> tuple[int, int]:
    """Offset and step of a shard's permutation of range(size)."""
    digest = hashlib.md5(shard.encode()).digest()
    return int.from_bytes(digest[:8], "big") % size, int.from_bytes(digest[8:], "big") % (size - 1) + 1


def lookup_table(shards: tuple[str, ...] = SHARDS, size: int = TABLE_SIZE) -> list[int]:
    """For each slot the index of the shard that claimed it.

    Raises ValueError for no shards, repeated names, more shards than slots
    or a size that is not prime.
    """
    if not shards or len(set(shards)) != len(shards) or len(shards) > size:
        raise ValueError("shards must be distinct, at least one, and not more than slots")
    if size < 2 or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("the table's size must be prime")
    at, step = zip(*(preference(s, size) for s in shards))
    place, owner, left = list(at), [-1] * size, size
    while True:
        for k in range(len(shards)):
            while owner[place[k]] >= 0:
                place[k] = (place[k] + step[k]) % size
            owner[place[k]] = k
            left -= 1
            if not left:
                return owner


def slot(key: Column, size: int = TABLE_SIZE) -> Column:
    """The slot of a key: 60 bits of the MD5 of its text; a null key goes as the empty text."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15)
    return (F.conv(digits, 16, 10).cast("bigint") % size).cast("int")


def shard_rows(df: DataFrame, key: str, shards: tuple[str, ...] = SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """df with the columns ``slot`` and ``shard`` put behind its own.

    Every row is kept, repeated keys meet in one shard, a null key has the
    place of the empty text.  Columns of df called slot or shard, in any case,
    are replaced; all others stay, whatever they are called, repeated names
    included.
    """
    # columns go by position, so that no name of df can clash with one used here
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    own = [i for i, c in enumerate(df.columns) if c.lower() not in ("slot", "shard")]
    keyed = df.columns.index(key)
    owner = ",".join(map(str, lookup_table(shards, size)))
    table = df.sparkSession.range(1, numPartitions=1).select(F.posexplode(F.split(F.lit(owner), ",")).alias("at", "owner"))
    table = table.select("at", F.element_at(F.split(F.lit("\n".join(shards)), "\n"), F.col("owner").cast("int") + 1).alias("name"))
    placed = plain.select(*[f"c{i}" for i in own], slot(F.col(f"c{keyed}"), size).alias("at"))
    joined = placed.join(F.broadcast(table), "at").select(*[f"c{i}" for i in own], "at", "name")
    return joined.toDF(*[df.columns[i] for i in own], "slot", "shard")
