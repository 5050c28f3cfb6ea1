"""Who may read a file."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trigrail import schema as S


def _bit(mode: Column, bit: int) -> Column:
    return mode.bitwiseAND(bit) != 0


def readable(mode: Column, owner: Column, group: Column, uid: int, gid: int) -> Column:
    """True for the superuser, for what others may read, for the owner's and the group's own."""
    if uid == 0:
        return F.lit(True)
    return _bit(mode, S.OTHER_READ) | ((owner == uid) & _bit(mode, S.OWNER_READ)) | ((group == gid) & _bit(mode, S.GROUP_READ))


def enterable(mode: Column, owner: Column, group: Column, uid: int, gid: int) -> Column:
    """The same of the right to enter a folder."""
    if uid == 0:
        return F.lit(True)
    return _bit(mode, S.OTHER_ENTER) | ((owner == uid) & _bit(mode, S.OWNER_ENTER)) | ((group == gid) & _bit(mode, S.GROUP_ENTER))


def readable_packed(packed: Column, uid: int, gid: int) -> Column:
    """The same where one number holds all: the owner in bits 16 and up, the group in bits 8 to 15, modes in the low bits."""
    return readable(packed, F.shiftrightunsigned(packed, 16), F.shiftrightunsigned(packed, 8).bitwiseAND(255), uid, gid)
