"""Paths, names and keys as expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F


def _segments(path: Column) -> Column:
    return F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda s: (s != "") & (s != "."))


def _joined(segments: Column) -> Column:
    return F.concat(F.lit("/"), F.array_join(segments, "/"))


def normalized_directory(path: Column) -> Column:
    """``/`` for blank; back slashes, empty and ``.`` segments go, ``..`` drops the segment before it, never above the root."""
    empty = F.array().cast("array<string>")
    kept = F.aggregate(_segments(path), empty, lambda a, s: F.when(s == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(s))))
    return F.when(F.trim(F.coalesce(path, F.lit(""))) == "", F.lit("/")).otherwise(_joined(kept))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)


def parent(path: Column) -> Column:
    """What lies before the last slash; empty without one."""
    return F.substr(path, F.lit(1), F.length(path) - F.length(F.substring_index(path, "/", -1)) - 1)


def extension(name: Column) -> Column:
    """From the last dot on; empty without a dot or with one at the end."""
    return F.regexp_extract(name, r"(\.[^./\\]+)$", 1)


def stem(name: Column) -> Column:
    """The file name up to its last dot."""
    return F.regexp_replace(file_name(name), r"\.[^.]*$", "")


def looks_generated(key: Column) -> Column:
    return key.rlike("^[0-9a-fA-F]{32}$")


def _unified(path: Column) -> Column:
    return F.trim(F.replace(path, F.lit("\\"), F.lit("/")))


def directory_under(path: Column, root: Column) -> Column:
    """Directory of the file ``path`` relative to ``root``, whose case doesn't matter; outside of it the whole directory."""
    directory = F.regexp_replace(_unified(path), "/?[^/]*$", "")
    base = F.rtrim(_unified(root), F.lit("/"))
    inside = F.startswith(F.lower(directory), F.lower(F.concat(base, F.lit("/"))))
    rest = F.when(F.lower(directory) == F.lower(base), F.lit("/")).when(inside, F.substr(directory, F.length(base) + 1)).otherwise(directory)
    return F.when(F.trim(F.coalesce(path, F.lit(""))) == "", F.lit("/")).otherwise(normalized_directory(rest))


def shard_segments(key: Column, depth: int) -> Column:
    """The first ``depth`` pairs of the key's characters. A lone last character gets a 0.

    Up to a depth of 2 a short key is filled up with ``00``; beyond, segments end with the key.
    """
    if not depth:
        return F.array().cast("array<string>")
    padded = [F.substring(F.rpad(key, 2 * depth, "0"), 2 * i + 1, 2) for i in range(depth)]
    return F.array(*padded) if depth <= 2 else F.slice(F.array(*padded), 1, F.least(F.ceil(F.length(key) / 2), F.lit(depth)).cast("int"))


def physical_path(mount: Column, tenant: Column, key: Column, ext: Column, depth: int) -> Column:
    """mount/tenant[/shards]/key.ext; the logical directory is no part of it."""
    parts = F.concat(F.array(F.rtrim(mount, F.lit("/")), tenant), shard_segments(key, depth), F.array(F.concat(key, F.coalesce(ext, F.lit("")))))
    return F.array_join(parts, "/")


def recovered_directory(path: Column, root: Column, key: Column) -> Column:
    """Logical directory of a file on disk: its directory under ``root`` less the shards that it begins with.

    Those are leading two-character segments that spell, in any case, the start of a generated key; any other key has none.
    """
    segments = _segments(directory_under(path, root))
    spelled = F.transform(segments, lambda s, i: F.lower(s) == F.lower(F.substr(key, i * 2 + 1, F.lit(2))))
    # The first segment that doesn't go on spelling the key; positions count from 1 and 0 is none.
    other = F.array_position(F.transform(spelled, lambda x: F.coalesce(x, F.lit(False))), False)
    n = F.when(~F.coalesce(looks_generated(key), F.lit(False)), F.lit(0)).when(other == 0, F.size(segments)).otherwise(other - 1)
    return _joined(F.slice(segments, (n + 1).cast("int"), F.greatest(F.size(segments) - n, F.lit(0)).cast("int")))


def dead_letter_path(root: Column, tenant: Column, day: Column, key: Column, ext: Column, depth: int = 2) -> Column:
    """root/tenant/yyyyMMdd/shards/key.ext; only whole pairs of the key's characters are shards."""
    shards = F.slice(shard_segments(key, depth), 1, F.floor(F.length(key) / 2).cast("int")) if depth else shard_segments(key, 0)
    parts = F.concat(F.array(root, tenant, F.date_format(day, "yyyyMMdd")), shards, F.array(F.concat(key, F.coalesce(ext, F.lit("")))))
    return F.array_join(F.filter(parts, lambda p: p != ""), "/")


def identity_from_path(path: Column, mount: Column) -> Column:
    """(tenant, key, extension) of a stored file: the first segment below the mount, the name's stem and its extension; null above a tenant."""
    below = F.substr(_unified(path), F.length(F.rtrim(mount, F.lit("/"))) + 2)
    inside = F.startswith(_unified(path), F.concat(F.rtrim(mount, F.lit("/")), F.lit("/"))) & (F.size(F.split(below, "/")) >= 2)
    return F.when(inside & (stem(path) != ""), F.struct(F.split(below, "/")[0].alias("tenant_id"), stem(path).alias("file_key"), extension(file_name(path)).alias("file_extension")))


def shard_prefix(seed: Column, ordinal: Column) -> Column:
    """The 16 bits, as a number, that keys of one batch begin with: seed and batch ordinal through a 64-bit finaliser.

    Products are taken modulo 2^64 in 128-bit decimals, as integers don't wrap in ANSI mode.
    """
    top = F.lit("18446744073709551616").cast("decimal(38,0)")

    def times(x: Column, by: int) -> Column:
        # Two halves, so that no product leaves 38 digits.
        wide = F.when(x < 0, x.cast("decimal(38,0)") + top).otherwise(x.cast("decimal(38,0)"))
        low, high = by & 0xFFFFFFFF, by >> 32
        product = F.pmod(wide * F.lit(str(low)).cast("decimal(10,0)"), top) + F.pmod(F.pmod(wide * F.lit(str(high)).cast("decimal(10,0)"), F.lit("4294967296").cast("decimal(38,0)")) * F.lit("4294967296").cast("decimal(10,0)"), top)
        whole = F.pmod(product, top)
        return F.when(whole >= F.lit("9223372036854775808").cast("decimal(38,0)"), whole - top).otherwise(whole).cast("long")

    folded = lambda x: x.bitwiseXOR(F.shiftrightunsigned(x, 33))
    # The mixing constants.
    mixed = F.shiftleft(seed.cast("long"), 32).bitwiseXOR(ordinal.cast("long")).bitwiseXOR(F.lit(0x9E3779B97F4A7C15 - (1 << 64)))
    mixed = folded(times(folded(mixed), 0xFF51AFD7ED558CCD))
    return folded(times(mixed, 0xC4CEB9FE1A85EC53)).bitwiseAND(F.lit(0xFFFF))


def generated_key(uuid: Column, seed: Column, ordinal: Column) -> Column:
    """A key of 32 lower hex digits: those of ``uuid`` with the batch's shard prefix for the first four."""
    return F.concat(F.lpad(F.lower(F.hex(shard_prefix(seed, ordinal))), 4, "0"), F.substring(F.lower(F.replace(uuid, F.lit("-"), F.lit(""))), 5, 28))


def sanitized_name(name: Column) -> Column:
    """Characters that no file system takes become ``_``; dots and spaces at the ends go; nothing left is ``unnamed``."""
    out = F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1f]', "_")
    out = F.regexp_replace(out, r"^[. ]+|[. ]+$", "")
    return F.when(out == "", F.lit("unnamed")).otherwise(out)


def within(path: Column, base: Column) -> Column:
    """Whether a path, once normalised, is the base or lies below it."""
    p, b = normalized_directory(path), normalized_directory(base)
    return (p == b) | (b == "/") | F.startswith(p, F.concat(b, F.lit("/")))


def valid_tenant(tenant: Column) -> Column:
    return F.coalesce(tenant.rlike(r"^[^\\/:*?\"<>|\x00-\x1f]+$") & ~tenant.isin(".", ".."), F.lit(False))


def ticks(ts: Column) -> Column:
    """100 ns steps since 0001-01-01 of a timestamp of microseconds."""
    return (F.unix_micros(ts.cast("timestamp")) + F.lit(62_135_596_800_000_000)) * 10


def fingerprint(size: Column, modified: Column, created: Column) -> Column:
    """``fp:v2:size:modified:created`` in ticks; without a creation time the change time stands for it."""
    return F.concat_ws(":", F.lit("fp:v2"), size.cast("string"), ticks(modified).cast("string"), F.coalesce(ticks(created), ticks(modified)).cast("string"))


def same_fingerprint(stored: Column, now: Column) -> Column:
    """Whether ``stored`` is that of a file that is ``now`` so: equal, or, of kind ``fp:v1:size:modified``, equal in these; anything else isn't one."""
    old = F.concat_ws(":", F.lit("fp:v1"), F.slice(F.split(now, ":"), 3, 2))
    return F.when(stored.rlike(r"^fp:v2:-?\d+:-?\d+:-?\d+$"), stored == now).when(stored.rlike(r"^fp:v1:-?\d+:-?\d+$"), stored == old).otherwise(F.lit(False))


def watcher_id(mode: Column, root: Column) -> Column:
    """``auto-mode-`` and 16 hex digits of a digest of mode and root."""
    return F.concat(F.lit("auto-"), mode, F.lit("-"), F.substring(F.sha2(F.concat(mode, F.lit(":"), normalized_directory(root)), 256), 1, 16))


def wildcard_pattern(pattern: str, ignore_case: bool = False) -> str:
    """A wildcard as a regular expression of the whole name; ``*.*`` asks for a dot."""
    body = re.escape(pattern).replace(r"\*", ".*").replace(r"\?", ".")
    return f"{'(?i)' if ignore_case else ''}^{body}$"


def matches_any(name: Column, patterns: list[str], ignore_case: bool = False) -> Column:
    """Whether a file name matches one of the wildcards; no pattern or ``*`` matches all."""
    if not patterns or "*" in patterns:
        return F.lit(True)
    out = F.lit(False)
    for p in patterns:
        out = out | name.rlike(wildcard_pattern(p, ignore_case))
    return out


def is_junk(name: Column) -> Column:
    return F.lower(name).isin("thumbs.db", ".ds_store", "desktop.ini")


def is_corruption_backup(name: Column) -> Column:
    return F.contains(F.lower(name), F.lit(".corrupted."))
