"""Encryption and container markers of a source's first bytes, as ordered cases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracehound.functions.binary import int_le, latin1


#: Bytes of a source that encryption() looks at.
LOOKED_AT = 8192


def encryption(content: Column, path: Column) -> Column:
    """bitlocker, luks, filevault, keyfile or none, by the first 8192 bytes and the name."""
    head = F.substring(content, 1, LOOKED_AT)
    low = F.lower(latin1(head))
    return (
        F.when(F.contains(head, F.lit(b"-FVE-FS-")), "bitlocker")
        .when(F.startswith(head, F.unhex(F.lit("4c554b53babe"))), "luks")
        .when(F.contains(low, F.lit("filevault")) | F.contains(low, F.lit("corestorage")), "filevault")
        .when(F.contains(F.lower(path), F.lit("rkey")), "keyfile")
        .otherwise("none")
    )


# Mark inside a header, type by extension.
VDI = b"<<< Oracle VM VirtualBox Disk Image >>>"
BY_EXTENSION = {"vmdk": "vmdk", "vhdx": "vhdx", "vhd": "vhd", "qcow2": "qcow2", "vdi": "vdi", "ova": "ova", "vpk": "vpk", "wim": "wim", "tib": "tib", "tibx": "tibx", "bak": "bak", "sql": "sql", "dump": "sql", "zip": "archive", "7z": "archive", "rar": "archive", "tar": "archive", "gz": "archive", "bz2": "archive", "xz": "archive"}


def container(content: Column, path: Column) -> Column:
    """Container type by magic, then extension, then footer."""
    starts = lambda h: F.startswith(content, F.unhex(F.lit(h)))
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    by_name = F.create_map(*(F.lit(x) for p in BY_EXTENSION.items() for x in p))
    footer = F.substring(content, F.octet_length(content) - 511, F.lit(8))
    return (
        F.when(starts("4b444d56"), "vmdk")
        .when(starts("7668647866696c65"), "vhdx")
        .when(starts("514649fb"), "qcow2")
        .when(int_le(content, 0, 4) == 0x55AA1234, "vpk")
        .when(starts("4d5357494d000000"), "wim")
        .when((F.octet_length(content) > 265) & (F.substring(content, 258, 5) == F.lit(b"ustar")), "ova")
        .when(F.contains(F.substring(content, 1, 4096), F.lit(VDI)), "vdi")
        .when(by_name[ext].isNotNull(), by_name[ext])
        .when((F.octet_length(content) >= 512) & (footer == F.lit(b"conectix")), "vhd")
        .otherwise("unknown")
    )
