"""Storage arithmetic: preferences, packed disk offsets, segments, blocks, redundancy, space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .chunks import div

# No preference, the slowest class, bytes of a block, blocks of a segment, and the bits of an offset.
NONE, SLOWEST = 254, 3
BLOCK = 4096
SEGMENT = 1 << 18
DISK_BITS, BLOCK_BITS = 10, 52
TIER_NAMES = ["Fastest", "Fast", "Slow", "Slowest"]


def pref_or(a: Column, b: Column) -> Column:
    return F.when(a == NONE, b).otherwise(a)


def faster(a: Column, b: Column) -> Column:
    """The faster of two preferences; none is slower than all."""
    return F.least(a, b)


def lift(a: Column) -> Column:
    """One class faster; none gives null."""
    return F.when(a != NONE, F.greatest(a - 1, F.lit(0)))


def lower(a: Column) -> Column:
    return F.when(a != NONE, F.least(a + 1, F.lit(SLOWEST)))


def tier_name(a: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, TIER_NAMES)), F.when(a.between(0, SLOWEST), a + 1).cast("int"))


def pack_offset(tier: Column, disk: Column, block: Column) -> Column:
    long = lambda c: c.cast("long")
    return F.shiftleft(long(tier), BLOCK_BITS + DISK_BITS).bitwiseOR(F.shiftleft(long(disk), BLOCK_BITS)).bitwiseOR(long(block))


def offset_tier(c: Column) -> Column:
    return F.shiftrightunsigned(c, BLOCK_BITS + DISK_BITS).cast("long")


def offset_disk(c: Column) -> Column:
    return F.shiftrightunsigned(c, BLOCK_BITS).bitwiseAND(F.lit((1 << DISK_BITS) - 1)).cast("long")


def offset_block(c: Column) -> Column:
    return c.bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))


def segment_of(c: Column) -> Column:
    """The offset at which the segment of an offset begins."""
    return c.bitwiseAND(F.lit(~(SEGMENT - 1)))


def in_segment(c: Column) -> Column:
    return c.bitwiseAND(F.lit(SEGMENT - 1))


def next_segment(c: Column, disk_blocks: Column) -> Column:
    """The segment after that of c; after the last one, the disk's first."""
    own = segment_of(c)
    first = own.bitwiseAND(F.lit(~((1 << BLOCK_BITS) - 1)))
    return F.when(offset_block(own) + SEGMENT >= disk_blocks, first).otherwise(own + SEGMENT)


def blocks_for(n_bytes: Column) -> Column:
    """Blocks that hold so many bytes."""
    return div(n_bytes + BLOCK - 1, BLOCK)


def parity_blocks(blocks: Column, disks: Column) -> Column:
    """Blocks that single parity over so many disks takes."""
    return blocks + F.when(blocks == 0, F.lit(0)).otherwise(div(blocks - 1, disks - 1) + 1)


def parity_free(free: Column, disks: Column) -> Column:
    return div(free * (disks - 1), disks)


def mirror_start(byte: Column, disks: Column) -> Column:
    """The replica that is read first: it changes every 32 MiB."""
    return F.shiftright(byte.cast("long"), 25) % disks


def superblock_slot(generation: Column) -> Column:
    return generation.bitwiseAND(F.lit(1))


def percent_full(free: Column, total: Column) -> Column:
    return 1 - F.try_divide(free.cast("double"), total.cast("double"))


def overshoot(free: Column, total: Column, threshold: float) -> Column:
    """Blocks to remove until no more than the threshold is full."""
    return F.greatest(F.ceil(F.round(total * (1 - threshold) - free, 6)), F.lit(0)).cast("long")


def until_filled(free: Column, total: Column, threshold: float) -> Column:
    return F.greatest(F.ceil(F.round(total * threshold - (total - free), 6)), F.lit(0)).cast("long")
