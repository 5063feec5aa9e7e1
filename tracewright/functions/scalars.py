"""Scalar functions of traces: formats, identifiers, hashes and paths."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR = 3_600_000
#: The types of outputs.
OUTPUT_TYPES = ("file", "dir", "oci")


def short_id(x: Column) -> Column:
    return F.substring(x, 1, 8)


def short_commit(x: Column) -> Column:
    return F.substring(x, 1, 7)


def date_of(millis: Column) -> Column:
    """UTC day of epoch milliseconds, whatever the session's time zone."""
    return F.date_from_unix_date(F.floor(millis / F.lit(24 * HOUR)).cast("int")).cast("string")


def fixed_text(value: Column, places: int) -> Column:
    """A number with this many decimals, rounded as C's printf and Go do: by its exact binary value, ties to even.
    ``format_string`` rounds the shortest decimal text, ties up."""
    return F.call_function("format_number", value.cast("double"), F.lit("0." + "0" * places if places else "0"))


def duration_text(millis: Column) -> Column:
    """Below a second in ms, else seconds with one decimal."""
    return F.when(millis < 1000, F.format_string("%dms", millis)).otherwise(F.concat(fixed_text(millis / 1000.0, 1), F.lit("s")))


def status_text(status: Column) -> Column:
    return F.when(status == "SUCCESS", "ok").when(status == "FAILURE", "FAIL").otherwise("skip")


def cache_text(cache: Column) -> Column:
    return F.when(cache == "CACHE_HIT", "hit").when(cache == "CACHE_SKIP", "skip").otherwise("miss")


def hit_rate_band(percent: Column) -> Column:
    return F.when(percent >= 70, "good").when(percent >= 40, "warn").otherwise("bad")


def impact_band(millis: Column) -> Column:
    return F.when(millis > 10_000, "high").when(millis > 3_000, "medium").otherwise("low")


def platform_text(system: Column, arch: Column) -> Column:
    return F.concat(system, F.lit("/"), arch)


def megabytes(size: Column) -> Column:
    return fixed_text(size / 1048576.0, 2)


def joined(values: Column) -> Column:
    """A list as it is stored: comma-joined; null and empty lists are ''."""
    return F.array_join(F.coalesce(values, F.array().cast("array<string>")), ",")


def listed(text: Column) -> Column:
    """Inverse of ``joined``."""
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(text, ","))


def sanitised(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9._-]", "")


def first_bytes(text: Column, size: int = 1024) -> Column:
    """At most ``size`` bytes of UTF-8, without a torn last character."""
    return F.when(F.octet_length(text) <= size, text).otherwise(F.regexp_replace(F.substring(text.cast("binary"), 1, size).cast("string"), "�+$", ""))


def ellipsis(command: Column, size: int = 70) -> Column:
    """First line; longer ones end in three dots."""
    line = F.split(command, "\n", 2)[0]
    return F.when(F.length(line) > size, F.concat(F.substring(line, 1, size - 3), F.lit("..."))).otherwise(line)


def age_millis(text: str) -> int:
    """'7d' or '12h' as milliseconds."""
    m = re.fullmatch(r"(\d+)([dh])", text)
    if not m:
        raise ValueError(f"age {text!r} is not like 7d or 12h")
    return int(m[1]) * HOUR * (24 if m[2] == "d" else 1)


def since_millis(day: str) -> int:
    """UTC midnight of a day."""
    return round(datetime.fromisoformat(day).replace(tzinfo=UTC).timestamp() * 1_000)


# ---- hashes


def list_text(values: Column) -> Column:
    return F.array_join(F.array_sort(F.coalesce(values, F.array().cast("array<string>"))), ",")


def text_hash(text: Column, algorithm: str = "sha256") -> Column:
    """Hex digest of a text or of bytes: SHA-256, or XXH3 of 128 bits (in Arrow batches; Spark has no function for it)."""
    if algorithm == "sha256":
        return F.sha2(text, 256)
    if algorithm != "xxh3":
        raise ValueError(f"hash algorithm {algorithm!r} is neither sha256 nor xxh3")
    import xxhash

    def digests(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else xxhash.xxh3_128_hexdigest(v) for v in values.to_pylist()], pa.string())

    return F.arrow_udf(digests, "string")(text)


def list_hash(values: Column, algorithm: str = "sha256") -> Column:
    return text_hash(list_text(values), algorithm)


def map_text(values: Column) -> Column:
    """Sorted k=v pairs, comma-joined."""
    pairs = F.transform(F.map_entries(values), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.coalesce(F.array_join(F.array_sort(pairs), ","), F.lit(""))


def length_prefixed(value: Column) -> Column:
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)


def resource_identity(label: Column, up: Column, down: Column, ready: Column, timeout: Column, dependencies: Column, exports: Column) -> Column:
    """Twelve hex digits over the length-prefixed parts of a resource's definition."""
    none = F.array().cast("array<string>")
    deps = F.coalesce(dependencies, none)
    keys = F.array_sort(F.coalesce(F.map_keys(exports), none))
    parts = [length_prefixed(x) for x in (label, up, down, ready, timeout, F.size(deps))]
    parts.append(F.array_join(F.transform(deps, length_prefixed), ""))
    parts.append(length_prefixed(F.size(keys)))
    parts.append(F.array_join(F.transform(keys, lambda k: F.concat(length_prefixed(k), length_prefixed(F.element_at(exports, k)))), ""))
    return F.substring(F.sha2(F.concat(*parts), 256), 1, 12)


# ---- trace identifiers


def _folded(text: Column, size: int) -> Column:
    """Characters folded by XOR into ``size`` bytes: each goes, by its low byte, to its byte offset modulo size. ASCII
    texts are folded eight bytes at a time."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    place = F.aggregate(chars, F.struct(F.lit(0).alias("at"), F.array_repeat(F.lit(0), size).alias("b")), lambda acc, c: F.struct((acc["at"] + F.octet_length(c)).alias("at"), F.transform(acc["b"], lambda x, i: F.when(i == F.pmod(acc["at"], F.lit(size)), x.bitwiseXOR(F.pmod(F.ascii(c), F.lit(256)))).otherwise(x)).alias("b")))
    any_text = F.array_join(F.transform(place["b"], lambda x: F.lpad(F.lower(F.hex(x)), 2, "0")), "")
    pieces = F.sequence(F.lit(0), F.greatest(F.ceil(F.length(text) / size).cast("int") - 1, F.lit(0)))

    def number(k: Column, first: int) -> Column:
        return F.conv(F.rpad(F.hex(F.substr(text, k * size + first + 1, F.lit(8))), 16, "0"), 16, -10).cast("long")

    def parts(number_of: Callable[[int], Column]) -> Column:
        return F.concat(*[F.lpad(F.lower(F.hex(number_of(first))), 16, "0") for first in range(0, size, 8)])

    # Short texts need no fold, or one step of it: lambdas cost far more.
    short = F.rpad(F.lower(F.hex(text)), 2 * size, "0")
    twice = parts(lambda first: number(F.lit(0), first).bitwiseXOR(number(F.lit(1), first)))
    longer = parts(lambda first: F.aggregate(pieces, F.lit(0).cast("long"), lambda acc, k: acc.bitwiseXOR(number(k, first))))
    ascii_text = F.when(F.length(text) <= size, short).when(F.length(text) <= 2 * size, twice).otherwise(longer)
    return F.when(F.octet_length(text) == F.length(text), ascii_text).otherwise(any_text)


def trace_hex(trace_id: Column) -> Column:
    """32 hex digits: those of a UUID, or the id folded."""
    clean = F.regexp_replace(trace_id, "-", "")
    return F.when(clean.rlike("^[0-9a-fA-F]{32}$"), F.lower(clean)).otherwise(_folded(trace_id, 16))


def span_hex(trace_id: Column, suffix: Column) -> Column:
    return _folded(F.concat(trace_id, suffix), 8)


def nanos(millis: Column) -> Column:
    return (millis * F.lit(1_000_000).cast("long")).cast("string")


def json_text(x: Column) -> Column:
    """A text as ``to_json`` writes it, which is asked only where something must be escaped; null stays null."""
    asked = F.to_json(F.struct(x.alias("x")))
    inner = F.substring(asked, F.lit(len('{"x":') + 1), F.char_length(asked) - len('{"x":}'))
    return F.when(x.rlike(r'[\x00-\x1F"\\]') | ~F.is_valid_utf8(x), inner).otherwise(F.concat(F.lit('"'), x, F.lit('"')))


# ---- paths and outputs


def clean_path(path: Column) -> Column:
    """Shortest equal path, as by lexical cleaning; '' is '.'. The parts are folded in the JVM, of paths with something to
    clean only."""
    dirty = (path == "") | path.rlike(r"//|(^|/)\.\.?(/|$)|.+/$")
    rooted = path.startswith("/")
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    up = lambda kept: F.when((F.size(kept) > 0) & (F.coalesce(F.try_element_at(kept, F.lit(-1)), F.lit("")) != ".."), F.slice(kept, F.lit(1), F.size(kept) - 1)).when(rooted, kept).otherwise(F.array_append(kept, F.lit("..")))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda kept, x: F.when(x == "..", up(kept)).otherwise(F.array_append(kept, x)))
    text = F.array_join(kept, "/")
    return F.when(dirty, F.when(rooted, F.concat(F.lit("/"), text)).otherwise(F.when(text == "", ".").otherwise(text))).otherwise(path)


def escapes(path: Column) -> Column:
    """Whether a relative path leads out of its folder."""
    cleaned = clean_path(path)
    return (cleaned == "..") | cleaned.startswith("../")


def inside(path: Column, folder: Column) -> Column:
    return (path == folder) | F.startswith(path, F.concat(folder, F.lit("/")))


def parsed_output(text: Column) -> Column:
    """'type::identifier' as a struct; without a type it is a file. Another type than ``OUTPUT_TYPES`` is an error."""
    typed = text.contains("::")
    parts = F.split(text, "::", 2)
    kind = F.when(typed, parts[0]).otherwise("file")
    known = F.when(kind.isin(*OUTPUT_TYPES), kind).otherwise(F.raise_error(F.concat(F.lit("unknown output type: "), kind)))
    return F.struct(F.when(text.isNotNull(), known).alias("type"), F.when(typed, F.get(parts, F.lit(1))).otherwise(text).alias("identifier"))


def percent_text(rate: Column) -> Column:
    """A rate in percent with one decimal, such as 66.7%."""
    return F.concat(fixed_text(rate, 1), F.lit("%"))


def whole_text(value: Column) -> Column:
    """A number without decimals."""
    return fixed_text(value, 0)


def output_text(output: Column) -> Column:
    return F.when(output["type"] == "file", output["identifier"]).otherwise(F.concat(output["type"], F.lit("::"), output["identifier"]))
